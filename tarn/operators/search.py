"""Search and explainable ranking: a token index, exact vector search, hybrid scores, field-weighted relevance, excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import fold, occurrences, plain
from tarn.operators.containment import name_hits
from tarn.operators.windows import keep_best


def tokens(df: DataFrame, key: str, fields: dict[str, float], least: int = 3, stop: tuple[str, ...] = ()) -> DataFrame:
    """The index (key, token, weight): folded tokens of each field, each with the sum of its fields' weights over its occurrences."""
    out = None
    for name, weight in fields.items():
        one = df.select(key, F.explode(F.split(plain(F.col(name)), " ")).alias("token")).withColumn("weight", F.lit(float(weight)))
        out = one if out is None else out.unionByName(one)
    out = out.where(F.length("token") >= least)
    out = out.where(~F.col("token").isin(*stop)) if stop else out
    return out.groupBy(key, "token").agg(F.sum("weight").alias("weight"))


def token_search(index: DataFrame, key: str, words: list[str], k: int) -> DataFrame:
    """The k keys with the highest sums of weight over the query's tokens, damped by sqrt; more distinct tokens found win ties."""
    hit = index.where(F.col("token").isin(*words)).groupBy(key).agg(F.round(F.sum(F.sqrt("weight")), 6).alias("score"), F.count("*").alias("found"))
    return hit.orderBy(F.desc("score"), F.desc("found"), F.asc(key)).limit(k)


def cosine(x: Column, query: list[float]) -> Column:
    """The cosine of a vector with a constant one, null for a zero vector."""
    q = F.array(*[F.lit(float(v)) for v in query])
    dot = F.aggregate(F.zip_with(x, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    size = sum(v * v for v in query) ** 0.5
    return F.when((norm > 0) & F.lit(size > 0), dot / (norm * F.lit(size or 1.0)))


def vector_topk(df: DataFrame, key: str, vector: str, query: list[float], k: int, least: float | None = None) -> DataFrame:
    """Exact search: (key, score) of the k most similar vectors, at or above a floor."""
    out = df.select(key, cosine(F.col(vector), query).alias("score")).where("score IS NOT NULL")
    out = out.where(F.col("score") >= least) if least is not None else out
    return out.orderBy(F.desc("score"), F.asc(key)).limit(k)


def hybrid(vector: Column, text: Column, weight: float = 0.4) -> Column:
    """A share of the vector score and the rest from a text score out of 100."""
    return weight * vector + (1 - weight) * F.least(text / 100, F.lit(1.0))


def relevance(title: Column, fields: dict[str, tuple[Column, float]], term: str) -> Column:
    """A title's first match counts (exact 100, contained 50, begins a word 40 more); other fields add their weight per occurrence."""
    t, q = fold(F.trim(title)), term.lower()
    score = F.when(t == q, 100.0).when(F.contains(t, F.lit(q)), F.when(t.rlike(rf"\b{q}"), 90.0).otherwise(50.0)).otherwise(0.0)
    for x, weight in fields.values():
        score = score + weight * F.coalesce(F.least(occurrences(fold(x), q), F.lit(10)), F.lit(0))
    return score


def locations(df: DataFrame, key: str, fields: dict[str, int], term: str) -> DataFrame:
    """(key, location, n, excerpt): where a term occurs, fields with their priority."""
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(c).alias("location"), F.col(c).alias("text")) for c, p in fields.items()])).alias("f")
    one = df.select(key, rows).select(key, "f.*")
    at = F.instr(F.lower("text"), term.lower())
    out = one.where(at > 0).withColumn("n", occurrences(F.lower("text"), term.lower()))
    return out.select(key, "priority", "location", "n", F.substring(F.col("text"), F.greatest(at - 20, F.lit(1)), F.lit(60)).alias("excerpt"))


def passages(df: DataFrame, key: str, text: str, words: list[str], k: int = 2, most: int = 340) -> DataFrame:
    """The k passages (lines) of each text with most of the words, cut at `most` characters."""
    one = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("place", "passage"))
    score = sum([F.contains(F.lower("passage"), F.lit(w)).cast("int") for w in words], F.lit(0))
    return keep_best(one.withColumn("score", score).where("score > 0"), [key], F.desc("score"), F.asc("place"), k=k).withColumn("passage", F.substring("passage", 1, most))


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, own: DataFrame | None = None) -> DataFrame:
    """(key, name): names whose words occur in texts, folded, as `name_hits` finds them. own: (key, name), names that a text has
    for its own and that don't count as mentioned."""
    words = lambda x: F.split(plain(F.col(x)), " ")
    wanted = names.select(F.col(name), words(name).alias("__p")).where(F.col("__p")[0] != "")
    found = name_hits(texts.select(key, words(text).alias("__p")), key, "__p", wanted, name).select(key, name).distinct()
    return found.join(own.select(key, name), [key, name], "left_anti") if own is not None else found


def index_or_scan(found: DataFrame, scan: DataFrame) -> DataFrame:
    """What the index gives; the scan's rows only if it gives none."""
    none = found.agg((F.count("*") == 0).alias("__none"))
    return found.unionByName(scan.join(F.broadcast(none)).where("__none").drop("__none"))


#: What a match in each field is worth, and what the first match of a title or substance is multiplied by.
POINTS = {"title": 100, "title part": 50, "word start": 40, "close": 70, "near": 45, "far": 25, "substance": 80, "substance part": 35, "form": 15, "dosage": 12, "section title": 10, "section": 3, "subsection": 5}
PART = {"title word": 1.5, "title start": 1.2, "title inside": 0.8, "substance word": 1.3, "substance start": 1.1, "important title": 2.0, "important": 1.5, "subsection text": 0.8}


def _ladder(*steps: tuple[Column, Column | float, Column | float], otherwise: tuple[Column, Column] | None = None) -> Column:
    """(points, n) of the first step whose condition holds."""
    pair = lambda points, n: F.struct((points if isinstance(points, Column) else F.lit(float(points))).cast("double").alias("points"), (n if isinstance(n, Column) else F.lit(float(n))).cast("double").alias("n"))
    out = F.when(F.lit(False), pair(0, 0))
    for condition, points, n in steps:
        out = out.when(condition, pair(points, n))
    return out.otherwise(pair(*(otherwise or (0, 0))))


def title_match(title: Column, term: str, fuzzy: Column | None = None) -> Column:
    """(points, n) of a term in a title: the title itself, a word of it, its start, the start of a word, anywhere; else by similarity."""
    words, q, n = F.split(title, r"\s+"), F.lit(term), occurrences(title, term)
    steps = [
        (title == q, POINTS["title"], 1), (F.array_contains(words, term), POINTS["title part"] * PART["title word"], 1), (title.startswith(term), POINTS["title part"] * PART["title start"], 1),
        (F.exists(words, lambda w: w.startswith(term)), POINTS["word start"], 1), (F.contains(title, q), n * POINTS["title part"] * PART["title inside"], n),
    ]
    if fuzzy is not None and len(term) >= 4:
        steps += [(fuzzy >= 0.85, POINTS["close"], 1), (fuzzy >= 0.75, POINTS["near"], 1), (fuzzy >= 0.65, POINTS["far"], 0.5)]
    return _ladder(*steps)


def substance_match(x: Column, term: str) -> Column:
    n = occurrences(x, term)
    part = POINTS["substance part"]
    return _ladder((x == term, POINTS["substance"], 1), (F.array_contains(F.split(x, r"\s+"), term), part * PART["substance word"], 1), (x.startswith(term), part * PART["substance start"], 1), (n > 0, n * part, n))


def counted(x: Column, term: str, weight: float) -> Column:
    n = occurrences(x, term).cast("double")
    return F.struct((n * weight).alias("points"), n.alias("n"))


def full_relevance(title: Column, substances: Column, form: Column, dosages: Column, sections: Column, terms: list[str], fuzzy: dict[str, Column] | None = None) -> Column:
    """A struct (score, matches) of a record for a query's terms. sections: array of (title, text, important, below); below: a subsection.

    Every field adds its matches; of a title and a substance only the best kind of match counts. Several terms found in title or substances
    raise the score by a tenth each; a record with nothing found has 0, and one weak match counts half."""
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    none = "array<struct<points:double,n:double>>"
    listed = lambda xs, f: F.coalesce(F.transform(xs, f), F.array().cast(none))

    def of(term: str) -> list[Column]:
        important = lambda s, more: F.when(s["important"], more).otherwise(1.0)
        headed = lambda s: F.when(~F.contains(low(s["title"]), F.lit(term)), 0.0).when(s["below"], POINTS["subsection"] * important(s, PART["important"])).otherwise(POINTS["section title"] * important(s, PART["important title"]))
        worded = lambda s: occurrences(low(s["text"]), term) * F.when(s["below"], POINTS["subsection"] * PART["subsection text"]).otherwise(POINTS["section"] * important(s, PART["important"]))
        number = lambda s: (F.contains(low(s["title"]), F.lit(term)).cast("double") + occurrences(low(s["text"]), term)).cast("double")
        return [
            F.array(title_match(low(title), term, (fuzzy or {}).get(term))),
            listed(substances, lambda x: substance_match(low(x), term)),
            F.array(counted(low(form), term, POINTS["form"])),
            listed(dosages, lambda x: counted(low(x), term, POINTS["dosage"])),
            listed(sections, lambda s: F.struct((headed(s) + worded(s)).cast("double").alias("points"), number(s).alias("n"))),
        ]

    every = F.concat(*[c for term in terms for c in of(term)])
    text = F.concat(low(title), F.lit(" "), low(F.array_join(substances, " ")))
    several = sum([F.contains(text, F.lit(t)).cast("int") for t in dict.fromkeys(terms)], F.lit(0)).cast("double")
    start = F.struct(F.lit(0.0).alias("points"), F.lit(0.0).alias("n"))
    sums = F.aggregate(every, start, lambda acc, x: F.struct((acc["points"] + x["points"]).alias("points"), (acc["n"] + x["n"]).alias("n")))

    def judged(x: Column) -> Column:
        score, n = x["points"] * F.when(x["several"] > 1, 1 + (x["several"] - 1) * 0.1).otherwise(1.0), x["n"]
        return F.struct(F.when(n == 0, 0.0).when((n == 1) & (score < 5), score * 0.5).otherwise(score).alias("score"), n.alias("matches"))

    # Each step takes the one before as a variable of a function over an array of one, so that it stands in the plan once.
    flat = F.transform(F.array(sums), lambda x: F.struct(x["points"].alias("points"), x["n"].alias("n"), several.alias("several")))
    return F.transform(flat, judged)[0]


def sentence_around(text: Column, term: str, most: int = 300) -> Column:
    """The first sentence that holds a term, cut at so many characters; null if none does."""
    hit = F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.contains(F.lower(s), F.lit(term.lower())))
    return F.left(F.trim(F.get(hit, F.lit(0))), F.lit(most))
