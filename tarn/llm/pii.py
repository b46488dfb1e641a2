"""Operator 8: personal data by weak supervision, in DataFrame operations only.

Base spans of four kinds (email, ip, card, phone) come from fixed patterns with checks and always stay. Candidates are wider: matches
that failed a check, and narrower forms inside or beside them (a card next to other digits, a phone number that runs into the next
number, a spelled-out email address). Five labelers vote +1, 0 or -1 on every base span and candidate: validity (checksum, ranges,
lengths), a gazetteer (top-level domains, issuers, country codes), context words, boundaries and shape. Votes are counted over all
documents by kind and pattern of votes, at most 4 * 3^5 rows, and expectation-maximisation on these counts estimates each labeler's
reliability on both sides and each pattern's probability; a logistic span classifier is trained on those soft labels and judges each candidate.

Everything about a text stays in its row: no text is shuffled. Group patterns are possessive, so long runs neither backtrack nor
nest, and a text is only matched against patterns whose rarest character it holds. Positions count code points, ends are exclusive. Spans of one kind are
in order and apart, so places are running sums and overlaps are found by halving, and words around a span come from blocks of the text: a text of very many spans costs its
length times a logarithm, not its square.

Cases: null text counts as empty; texts without personal data have no spans; texts of any length are read whole; repeated rows give a
row each; other columns are ignored by `find` and kept by `redact`; an empty table gives an empty table and the prior classifier.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import documents, unpacked

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns. A match may begin where the last one ended or where no character of its first class stands
#: before it: elsewhere the match would have begun earlier or fails as that one did.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates that the base patterns leave: whole numbers and addresses in narrower or wider forms.
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9])(?!\.[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+|00)?(?:[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])",
}
GAZETTEER = {
    "tld": "com org net edu gov mil int info biz io dev app eu de fr es it nl be at ch uk us ca au nz jp cn in br mx pl se no dk fi pt ie".split(),
    "country": "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 354 358 380 420 421".split(),
}
CONTEXT = {
    "email": ("mail|e-mail|email|contact|kontakt|correo|courriel|write to|write us", "version|package"),
    "ip": ("ip|host|server|addr|address|login|client|from", "version|release|section|chapter|build"),
    "card": ("card|visa|mastercard|amex|credit|debit|pay|karte|carte|tarjeta", "isbn|order|invoice|serial|token|hash|tracking|id"),
    "phone": ("tel|phone|call|fax|mobile|cell|whatsapp|telefon|anruf|appel|llama", "order|invoice|isbn|serial|token|part no|version"),
}
LABELERS = ["valid", "gazetteer", "context", "boundary", "shape"]
#: What is held of each labeler before any vote is seen: how often it is right, of spans that are personal data and of those that aren't, and
#: how many votes that belief is worth. It says which of two mirror-image solutions is meant, and gives way to a few dozen votes.
BELIEF = [(0.9, 20.0), (0.7, 6.0), (0.7, 6.0), (0.6, 6.0), (0.6, 6.0)]

Span = "array<struct<s:int,e:int,h:string>>"


def bind(value, f: Callable) -> Callable[[Column], Column]:
    """f with its first argument given; Spark counts the parameters of a lambda."""
    return lambda x: f(value, x)


#: Values that a running sum or maximum works out one by one behind a known one; code points of a block of a text.
CHUNK, BLOCK = 128, 512


def once(x: str, name: str, body: str) -> str:
    """SQL of a body in which a value has a name; it is worked out once, however often it is named."""
    return f"get(transform(array({x}), {name} -> {body}), 0)"


def running(values: str, op: str) -> str:
    """SQL: for each value of an array of whole numbers the sum ('+') or maximum ('greatest') of those before it, 0 at first. Only every CHUNK-th is appended to an array; the others
    follow from the one before them, so the work follows the values and not their square."""
    joined = "greatest(t, get(v, j))" if op == "greatest" else f"t {op} get(v, j)"
    over = lambda first, last, start: f"aggregate(if({last} >= {first}, sequence({first}, {last}), array()), {start}, (t, j) -> {joined})"
    heads = f"aggregate(if(size(v) > 0, sequence(0, (size(v) - 1) div {CHUNK}), array()), named_struct('t', 0, 'out', cast(array() as array<int>)), (acc, k) -> named_struct('t', {over(f'cast(k * {CHUNK} as int)', f'cast(least(size(v), (k + 1) * {CHUNK}) - 1 as int)', 'acc.t')}, 'out', concat(acc.out, array(acc.t))), acc -> acc.out)"
    each = f"transform(v, (x, i) -> {over(f'i - i % {CHUNK}', 'i - 1', f'get(h, cast(i div {CHUNK} as int))')})"
    return once(values, "v", once(heads, "h", each))


def matched(text: str, pattern: str, gate: Column) -> Column:
    """The matches of a pattern in a column as structs of start, end and text, in order; nothing is matched unless the gate holds."""
    p = "'" + pattern.replace("\\", "\\\\") + "'"
    zipped = f"filter(zip_with(regexp_extract_all({text}, {p}, 0), transform(split({text}, {p}, -1), g -> length(g)), (h, g) -> named_struct('hit', h, 'gap', coalesce(g, 0))), x -> x.hit is not null)"
    at = running("transform(z, x -> x.gap + length(x.hit))", "+")
    placed = "transform(z, (x, i) -> named_struct('s', get(p, i) + x.gap, 'e', get(p, i) + x.gap + length(x.hit), 'h', x.hit))"
    return F.when(gate, F.expr(once(zipped, "z", once(at, "p", placed)))).otherwise(F.array().cast(Span))


def blocks_of(text: Column) -> Column:
    """A text in blocks, so that a part of it is found without reading it from its beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part(blocks: str, at: str, n: str) -> str:
    """SQL: n code points of a text from a place, counted from 0; fewer at its end."""
    whole = f"array_join(transform(sequence(cast(q.at div {BLOCK} as int), cast((q.at + q.n - 1) div {BLOCK} as int)), j -> coalesce(get({blocks}, j), '')), '')"
    return once(f"named_struct('at', {at}, 'n', {n})", "q", f"if(q.n > 0, substring({whole}, cast(q.at % {BLOCK} as int) + 1, q.n), '')")


_SPAN_AND = "named_struct('s', c.s, 'e', c.e, 'h', c.h, 'before', lower(w.before), 'prior', w.prior, 'next', w.next)"


def around(blocks: str, spans: str) -> str:
    """SQL: spans with the 30 code points before them in lower case, and the ones next to them on both sides."""
    near = ", ".join(f"'{name}', {part(blocks, at, n)}" for name, at, n in (("before", "greatest(c.s - 30, 0)", "least(c.s, 30)"), ("prior", "greatest(c.s - 1, 0)", "least(c.s, 1)"), ("next", "c.e", "1")))
    return f"transform({spans}, c -> {once(f'named_struct({near})', 'w', _SPAN_AND)})"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether 13 to 19 digits pass Luhn's check."""
    at = F.sequence(F.lit(1), F.length(number))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.when(F.length(number).between(13, 19), F.aggregate(at, F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def small_parts(x: Column) -> Column:
    parts = F.transform(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda h: F.lit(True),
    "ip": small_parts,
    "card": lambda h: luhn(digits(h)),
    "phone": lambda h: F.length(digits(h)).between(9, 15),
}


def gates(text: Column) -> dict[str, Column]:
    return {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": F.contains(text, F.lit("+"))}


def wide_gates(text: Column) -> dict[str, Column]:
    return {"email": text.rlike(r"[\[(]at[\])]"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": text.rlike(r"[0-9]{3}[ .-][0-9]{3}")}


def overlaps(spans: str, c: str) -> str:
    """SQL: whether a span meets one of others that are in order and apart: the last that begins before its end tells, and is found by halving."""
    mid = "shiftright(a.lo + a.hi, 1)"
    halved = f"if(get({spans}, {mid}).s < {c}.e, named_struct('lo', {mid}, 'hi', a.hi), named_struct('lo', a.lo, 'hi', {mid}))"
    last = f"aggregate(sequence(0, cast(ceil(log2(size({spans}) + 1)) as int)), named_struct('lo', -1, 'hi', size({spans})), (a, _) -> if(a.hi - a.lo > 1, {halved}, a), a -> a.lo)"
    return f"if(size({spans}) > 0, coalesce(get({spans}, {last}).e > {c}.s, false), false)"


def apart(spans: str, others: list[str]) -> str:
    """SQL: the spans that meet none of several arrays of others, each in order."""
    meets = " or ".join(overlaps(f"o.o{i}", "x") for i in range(len(others)))
    held = "named_struct(" + ", ".join(f"'o{i}', {x}" for i, x in enumerate(others)) + ")"
    return f"if(size({spans}) > 0, {once(held, 'o', f'filter({spans}, x -> not ({meets}))')}, {spans})"


def votes(kind: str, c: Column) -> list[Column]:
    """The five votes on a span of a kind with what stands around it, in the order of LABELERS."""
    h, number, before, prior_char, next_char = c["h"], digits(c["h"]), c["before"], c["prior"], c["next"]
    sign = lambda good, bad: F.when(bad, -1).when(good, 1).otherwise(0)
    good, bad = CONTEXT[kind]
    says = [
        sign(before.rlike(rf"\b(?:{good})\b"), before.rlike(rf"\b(?:{bad})\b")),
        sign(F.lit(True), prior_char.rlike("[A-Za-z0-9_]") | next_char.rlike("[A-Za-z0-9_]")),
    ]
    if kind == "email":
        tld = F.lower(F.regexp_extract(h, r"([A-Za-z0-9-]+)$", 1))
        return [sign(tld.rlike("^[a-z]{2,}$"), ~tld.rlike("^[a-z]{2,}$")), sign(tld.isin(GAZETTEER["tld"]), F.lit(False)), *says, sign(F.length(h) <= 60, F.length(h) > 200)]
    if kind == "ip":
        first = F.regexp_extract(h, "^0*([0-9]{1,3})", 1).try_cast("int")
        return [sign(small_parts(h), ~small_parts(h)), sign(first.between(1, 223) & (first != 127), (first == 0) | (first > 255)), *says, sign(~h.rlike(r"(^|\.)0[0-9]"), h.rlike(r"(^|\.)0[0-9]"))]
    if kind == "card":
        issuer = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
        return [sign(luhn(number), ~luhn(number)), sign(number.rlike(issuer), ~number.rlike(issuer)), *says, sign(F.length(number).isin(15, 16), F.length(h) > 23)]
    size = F.length(number)
    country = F.regexp_extract(h, r"^(?:\+|00)([0-9]{1,3})(?:[ .(-]|$)", 1)
    return [sign(size.between(9, 15), ~size.between(9, 15)), sign(country.isin(GAZETTEER["country"]), F.lit(False)), *says, sign(h.rlike(r"^(?:\+|00|\()") & h.rlike("[ .()-]"), ~h.rlike("[ .()+-]"))]


def candidates(docs: DataFrame, text: Column) -> DataFrame:
    """Adds __text, __base_<kind> (checked base spans) and __cand_<kind> (candidates that overlap no base span)."""
    out = docs.withColumn("__text", F.coalesce(text, F.lit("")))
    t = F.col("__text")
    narrow, wide = gates(t), wide_gates(t)
    out = out.withColumns({f"__hit_{k}": matched("__text", BASE[k], narrow[k]) for k in KINDS} | {f"__wide_{k}": matched("__text", WIDER[k], wide[k]) for k in KINDS})
    out = out.withColumns({f"__base_{k}": F.filter(F.col(f"__hit_{k}"), bind(k, lambda k, x: VALID[k](x["h"]))) for k in KINDS})
    # matches of the right length that failed, unless a narrower form stands for them
    out = out.withColumn("__failed", F.filter(F.col("__hit_card"), lambda x: F.length(digits(x["h"])).between(13, 19) & ~luhn(digits(x["h"]))))
    out = out.withColumn("__wide_card", F.expr(f"array_sort(concat(__wide_card, {apart('__failed', ['__wide_card'])}))"))
    some = sum([F.size(f"__hit_{k}") + F.size(f"__wide_{k}") for k in KINDS], F.lit(0)) > 0
    bases = [f"__base_{k}" for k in KINDS]
    return out.withColumns({"__blocks": F.when(some, blocks_of(t)).otherwise(F.array().cast("array<string>"))} | {f"__cand_{k}": F.expr(apart(f"__wide_{k}", bases)) for k in KINDS})


class Classifier:
    """Weights of the span classifier by kind: a bias, then up and down weights of each labeler."""

    def __init__(self, weights: dict[str, list[float]], reliability: dict[str, list[tuple[float, float]]]):
        self.weights, self.reliability = weights, reliability

    def chance(self, kind: str, cast: list[Column]) -> Column:
        w = self.weights[kind]
        z = F.lit(w[0])
        for i, v in enumerate(cast):
            z = z + F.when(v > 0, w[1 + 2 * i]).when(v < 0, w[2 + 2 * i]).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def estimate(counts: dict[tuple[int, ...], int], rounds: int = 2000, still: float = 1e-7) -> tuple[dict[tuple[int, ...], float], list[tuple[float, float]]]:
    """Expectation-maximisation over patterns of votes: the probability that each is personal data, and how often each labeler is right of
    spans that are and of spans that aren't. A labeler that says the same of all thus weighs nothing; silence says nothing.

    Reliabilities are free: they begin at BELIEF, whose few pseudo-votes are all that holds them; rounds end when none moves."""
    share, right = 0.5, [(r, r) for r, _ in BELIEF]
    total = sum(counts.values())
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for p in counts:
            odds = math.log(share) - math.log(1 - share)
            for v, (yes, no) in zip(p, right):
                if v:
                    odds += math.log(yes) - math.log(1 - no) if v > 0 else math.log(1 - yes) - math.log(no)
            post[p] = 1 / (1 + math.exp(min(50.0, max(-50.0, -odds))))
        share = (sum(n * post[p] for p, n in counts.items()) + 1) / (total + 2)
        before, right = right, []
        for i, (r, worth) in enumerate(BELIEF):
            cast = {s: [(n * post[p], n * (1 - post[p])) for p, n in counts.items() if p[i] == s] for s in (1, -1)}
            sums = {s: [sum(x) for x in zip(*rows)] or [0.0, 0.0] for s, rows in cast.items()}
            right.append(((sums[1][0] + r * worth) / (sums[1][0] + sums[-1][0] + worth), (sums[-1][1] + r * worth) / (sums[1][1] + sums[-1][1] + worth)))
        if max(abs(x - y) for a, b in zip(right, before) for x, y in zip(a, b)) < still:
            break
    return post, right


def train(post: dict[tuple[int, ...], float], counts: dict[tuple[int, ...], int], start: list[float], rounds: int = 1000, hold: float = 1e-3) -> list[float]:
    """Logistic weights on the soft labels; every pattern of votes counts by the logarithm of its number. The pull to the start is that
    of a thousandth of all rows: it decides only what no vote speaks of."""
    w = list(start)
    rows = [([1.0, *(x for v in p for x in (float(v > 0), float(v < 0)))], post[p], math.log1p(n)) for p, n in counts.items()]
    total = sum(n for *_, n in rows) or 1.0
    for _ in range(rounds):
        grad = [hold * (a - b) for a, b in zip(w, start)]
        for x, y, n in rows:
            z = sum(a * b for a, b in zip(w, x))
            miss = (1 / (1 + math.exp(min(50.0, max(-50.0, -z)))) - y) * n / total
            grad = [g + miss * b for g, b in zip(grad, x)]
        w = [a - 1.0 * g for a, g in zip(w, grad)]
    return w


#: The classifier before any data: bias, then each labeler's weights for and against.
START = [-1.5, 2.5, -4.0, 1.0, -1.0, 1.0, -1.0, 0.8, -1.0, 1.0, -1.0]


def learn(docs: DataFrame, text_col: str = "text") -> Classifier:
    """Votes over all documents, reliabilities, and the span classifier."""
    rows = candidates(docs.select(F.col(text_col).alias("text")), F.col("text"))
    near = lambda k: F.expr(around("__blocks", f"concat(__base_{k}, __cand_{k})"))
    every = F.concat(*[F.transform(near(k), bind(k, lambda k, c: F.struct(F.lit(k).alias("kind"), *[v.alias(n) for n, v in zip(LABELERS, votes(k, c))]))) for k in KINDS])
    counted = rows.select(F.explode(every).alias("v")).select("v.*").groupBy("kind", *LABELERS).agg(F.count("*").alias("n")).collect()
    weights, reliability = {}, {}
    for k in KINDS:
        counts = {tuple(r[x] for x in LABELERS): r["n"] for r in sorted(counted) if r["kind"] == k}
        post, reliability[k] = estimate(counts) if counts else ({}, [(r, r) for r, _ in BELIEF])
        weights[k] = train(post, counts, START) if counts else START
    return Classifier(weights, reliability)


def find(docs: DataFrame, model: Classifier, text: Column, chance: float = 0.5) -> DataFrame:
    """Adds __base_<kind> and __all_<kind>: base spans, and those with the added ones, in order of start."""
    out = candidates(docs, text)
    kept = {k: F.filter(F.expr(around("__blocks", f"__cand_{k}")), bind(k, lambda k, c: model.chance(k, votes(k, c)) >= chance)) for k in KINDS}
    out = out.withColumns({f"__add_{k}": F.transform(kept[k], lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["h"].alias("h"))) for k in KINDS})
    # of two added spans that overlap, the kind listed first stays; those of a kind are apart
    mine = {k: apart(f"__add_{k}", [f"__add_{x}" for x in KINDS[:i]]) if i else f"__add_{k}" for i, k in enumerate(KINDS)}
    return out.withColumns({f"__all_{k}": F.expr(f"array_sort(concat(__base_{k}, {mine[k]}))") for k in KINDS})


def listed(prefix: str) -> Column:
    return F.array_join(F.concat(*[F.transform(F.col(f"{prefix}_{k}"), bind(k, lambda k, x: F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string")))) for k in KINDS]), ",")


def redacted() -> Column:
    """The text with every span replaced by its kind; spans that overlap become one mark, of the one that begins first."""
    marks = "array_sort(concat(" + ", ".join(f"transform(__all_{k}, x -> named_struct('s', x.s, 'e', x.e, 'mark', '<{k.upper()}>'))" for k in KINDS) + "))"
    rest = once("array_max(transform(m, x -> x.e))", "last", part("__blocks", "last", "length(__text) - last"))
    each = once(running("transform(m, x -> x.e)", "greatest"), "p", f"transform(m, (x, i) -> if(x.s >= get(p, i), concat({part('__blocks', 'get(p, i)', 'x.s - get(p, i)')}, x.mark), ''))")
    return F.expr(once(marks, "m", f"if(size(m) = 0, __text, array_join(concat({each}, array({rest})), ''))"))


def redact(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """The rows given with personal data in their text replaced; null texts stay null."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    text = F.col("__row").getField(text_col)
    return unpacked(find(rows, model, text), docs.columns, **{text_col: F.when(text.isNotNull(), redacted())})


def op8_pii_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = find(docs, learn(docs), F.col("text"))
    return found.select("doc_id", *[F.size(f"__base_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(listed("__base").cast("binary"), 256).alias("base_sha256"), listed("__all").alias("spans"))


QUERIES = {"op8_pii_weak": op8_pii_weak}
SQL: dict[str, str] = {}
