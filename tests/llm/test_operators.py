"""The numbered operators against brute force, and on awkward tables."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.llm import bpe, crf, jaccard, langid, licenses, mixing, neardup, pii, quality, queries, urlfilter
from tests.llm.fixtures import WORD, awkward, roots, shingles, table

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_queries_are_the_thirteen(spark):
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))


# 1: quality


def test_quality_ranks_held_out_rows(spark, sf):
    out = by_id(queries.queries()["op1_quality_fourier"](spark, "/root/testdata/sf0.01"))
    labels = {i: q for i, q, _ in table("labels", "/root/testdata/sf0.01")}
    assert len(out) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    known = [(out[i]["score"], q) for i, q in labels.items() if i in out and out[i]["held_out"] and q is not None]
    good, bad = [s for s, q in known if q], [s for s, q in known if not q]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.85, auc


def test_quality_equals_plain_numpy(spark):
    """Features, ridge by folds and calibration over the same statistics, without Spark."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    stats = quality.profile(docs, "doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y"))
    got = {r["id"]: r["score"] for r in quality.apply(stats, quality.learn(stats, labels, features=48)).collect()}
    x = {r["id"]: np.frombuffer(r["x"]) for r in stats.collect()}
    known = stats.join(labels, "id").select("id", "y", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(quality.FOLDS)).alias("f")).collect()
    a, y, fold = np.stack([x[r["id"]] for r in known]), np.array([r["y"] for r in known]), np.array([r["f"] for r in known])
    mean, scale = a.mean(0), a.std(0)
    rng = np.random.default_rng(1)
    w, b = rng.standard_normal((quality.D, 48)) / (0.7 * np.sqrt(quality.D)), rng.uniform(0, 2 * np.pi, 48)
    wave = lambda v: np.concatenate([np.ones((len(v), 1)), np.sqrt(2 / 48) * np.cos(np.clip((v - mean) / np.where(scale > 1e-9, scale, 1), -6, 6) @ w + b)], axis=1)

    def ridge(z, t):
        hold = np.full(49, 1e-3 * len(z))
        hold[0] = 1e-9
        return np.linalg.solve(z.T @ z + np.diag(hold), z.T @ t)

    z, raw = wave(a), np.zeros(len(y))
    for f in range(quality.FOLDS):
        raw[fold == f] = z[fold == f] @ ridge(z[fold != f], y[fold != f])
    bins = np.round(np.clip(raw, -2, 3) * 400)
    level = np.array([y[bins == k].mean() for k in np.unique(bins)])
    at, n = np.unique(bins, return_counts=True)
    pools = [[i] for i in range(len(at))]
    value = lambda p: np.average(level[p], weights=n[p])
    i = 0
    while i < len(pools) - 1:  # pools that don't rise are one
        if value(pools[i]) >= value(pools[i + 1]):
            pools[i : i + 2] = [pools[i] + pools[i + 1]]
            i = max(i - 1, 0)
        else:
            i += 1
    places, heights = [np.average(at[p] / 400, weights=n[p]) for p in pools], [value(p) for p in pools]
    whole = ridge(z, y)
    ids = sorted(x)
    want = np.clip(np.interp(wave(np.stack([x[i] for i in ids])) @ whole, places, heights), 0, 1)
    assert np.allclose([got[i] for i in ids], want, atol=1e-5)


def test_quality_statistics_equal_plain_python():
    """Each statistic by its definition, over words, lines and characters of a text."""
    classes = {"letter": "[A-Za-z]", "upper": "[A-Z]", "digit": "[0-9]", "stop": "[.!?]", "comma": "[,;:]", "bang": "!", "mark": "[#*$%&]", "angle": r"[<>{}\[\]()]", "bar": r"[|/\\_\-=+~^]", "at": "@", "quote": "['\"`]"}

    def plain(text):
        raw, words = text.encode(), [w.encode() for w in WORD.findall(text)]
        if not words:
            return [-1.0] + [0.0] * (quality.D - 1)
        n, k, sizes = len(raw), len(words), np.array([len(w) for w in words], float)
        low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
        lines = [x for x in raw.split(b"\n") if x.strip()]
        pairs, p = list(zip(low, low[1:])), np.array(sorted(Counter(raw).values())) / n
        head = [np.log1p(n), np.log1p(k), sizes.mean(), sizes.std(), len(set(low)) / k, max(Counter(low).values()) / k, len(set(pairs)) / max(1, k - 1), sum(a == b for a, b in pairs) / max(1, k - 1), np.log1p(len(lines)), np.log1p(n / len(lines))]
        head += [1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines), len(zlib.compress(raw, 1)) / (n + 20), -(p * np.log2(p)).sum(), (sizes <= 1).sum() / k]
        return head + [np.sqrt(len(re.findall(c.encode(), raw)) / n) for c in classes.values()] + [np.sqrt(sum(b > 127 for b in raw) / n)]

    texts = ["The cat. The CAT! the cat\n\nA a a <b> {x} 12 $5 #1 a@b.c", "", " \n", "é 你好 naïve", "one", "x\nx\nx y?", "a|b/c_d-e=f+g~h^ `q' \"r\"; s: t, " * 40]
    assert np.allclose(quality.statistics(pa.array([*texts, None])), [plain(x) for x in [*texts, ""]])


def test_quality_of_repeated_ids_is_the_same_in_every_run(spark):
    rows = [(i % 20, f"word{i} " * (i + 3) + ("Fine text. " * (i % 3))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    runs = [sorted(map(tuple, quality.score(docs.repartition(n, "text"), labels).collect())) for n in (1, 5)]
    assert len(runs[0]) == 60 and np.allclose([r[1] for r in runs[0]], [r[1] for r in runs[1]], atol=1e-6)


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (5, 1), (99, 1), (None, 1), (7, None)], "doc_id long, quality int")
    rows = quality.score(awkward(spark), labels).collect()
    assert len(rows) == 17 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(awkward(spark, True), labels).count() == 0
    assert {r["score"] for r in quality.score(awkward(spark), labels.limit(0)).collect()} == {0.5}
    kept = quality.select(awkward(spark), labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y")))
    assert kept.columns == awkward(spark).columns and kept.count() <= 17


def test_isotonic():
    at, to = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 0.8, 0.2, 1]), np.ones(4))
    assert to.tolist() == [0, 0.5, 1] and at.tolist() == [0, 1.5, 3]


# 2: BPE


def test_bpe_equals_the_library(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.tokenizer_path())
    tok.no_truncation()
    tok.no_padding()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(awkward(spark).select("doc_id", "text"))
    texts = sorted((r["text"] or "" for r in docs.collect()))
    want = []
    for t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    got = [(r[1], r[2], r[3]) for r in bpe.digests(docs, bpe.tokenizer_path()).collect()]
    assert Counter(got) == Counter(want)
    assert bpe.digests(awkward(spark, True), bpe.tokenizer_path()).count() == 0
    apart = bpe.decode(bpe.encode(docs, bpe.tokenizer_path()), bpe.tokenizer_path()).collect()
    assert sorted(sha(r["text"]) for r in apart) == sorted(x[2] for x in want) and sum(len(r["ids"]) for r in apart) == sum(x[0] for x in want)


def test_bpe_random_words():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(bpe.tokenizer_path()), bpe.automaton(bpe.tokenizer_path())
    rng = np.random.default_rng(3)
    pieces = [" the", "ing", "aaaa", "\u00e9", "'s", "  ", "\n", "0", "99", "\u4f60", "Qq", "\U0001f600", "zzzz", "-", "=="]
    for _ in range(3000):
        t = "".join(rng.choice(pieces, rng.integers(1, 30)))
        assert own.encode(t) == tok.encode(t, add_special_tokens=False).ids, repr(t)
        assert own.decode(own.encode(t)) == t


def test_bpe_table_is_whole_before_texts():
    """Arcs against what the library itself does with each pair of tokens."""
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(bpe.tokenizer_path()), bpe.Automaton(bpe.tokenizer_path())
    letters = sorted(i for label, i in own.ids.items() if label.isalpha() and label.isascii())
    rng = np.random.default_rng(9)
    for p, t in zip(rng.choice(letters, 4000).tolist(), rng.choice(letters, 4000).tolist()):
        assert own.has_arc(p, t) == (tok.encode((own.labels[p] + own.labels[t]).decode(), add_special_tokens=False).ids == [p, t])
    # three letters, two merges, by hand: states and arcs of a, b, ab, abb
    behind, kind, arcs = bpe.compiled(4, [(0, 1, 2), (2, 1, 3)])
    arc = lambda p, t: bool(arcs[behind[p], kind[t] >> 3] >> (kind[t] & 7) & 1)
    assert [[arc(p, t) for t in range(4)] for p in range(4)] == [[True, False, True, True], [True] * 4, [True, False, True, True], [True] * 4]


# 3: URL filters


def test_urls_by_hand(spark):
    urls = ["http://A.com/en/x", "https://example.com/en/7", "http://x.example.com/en/71?q", "http://net/de/1", "http://example.net/de/8", "ftp://notexample.net/de/8", "org/es/", None, "", "http://b.org", "http://b.org/es/#x", "://com/en/", "http://com/en", "x://y://com/en/", "http://q.org?/es/", "http://cheap-pills.biz/", "http://www.casino-royal.io/a", "http://h.net/de/wp-login.php"]
    rows = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(0, urls[0], None, None)], "page_id long, url string, host string, rule string")
    out = urlfilter.judge(rows, urlfilter.compiled(urlfilter.BASE, urlfilter.PATTERNS)).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        u = urls[r["page_id"]] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        assert (r["host"], r["path"]) == (host, path)
        fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.BASE if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert r["rule"] == (max(fits)[1] if fits else None), u
        if fits:
            assert r["verdict"] == max(fits)[2]
        elif not host + path:
            assert r["verdict"] == "allow"
    said = {urls[r["page_id"]]: (r["verdict"], r["pattern"]) for r in out}
    assert said["http://cheap-pills.biz/"] == ("block", "pills") and said["http://www.casino-royal.io/a"] == ("block", "casino") and said["http://h.net/de/wp-login.php"] == ("allow", "login")
    assert urlfilter.judge(rows.limit(0), urlfilter.compiled(urlfilter.BASE, urlfilter.PATTERNS)).count() == 0


def test_urls_of_thousands_of_rules(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefg"), 3))
    base = list({(h, p): (v, h, p) for v, h, p in (("block" if rng.random() < 0.5 else "allow", f"{word()}.{rng.choice(['com', 'org'])}", f"/{word()}/") for _ in range(2500))}.values())
    base += [("allow", "com", "/"), ("block", "org", "/x"), ("block", "com", "/abc")]
    urls = [f"https://{rng.choice(['', 'www.'])}{word()}.{rng.choice(['com', 'org', 'net'])}/{word()}/{word()}?q" for _ in range(1500)] + [f"http://{h}{p}a" for _, h, p in base[:300]]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(rows, urlfilter.compiled(base, [])).collect()}
    for i, u in enumerate(urls):
        host, path = re.match(r"https?://([^/]*)([^?]*)", u).groups()
        fits = [(len(h + p), h + p, v) for v, h, p in base if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == ((max(fits)[1], max(fits)[2]) if fits else (None, "allow")), u


# 4: language


def test_language_held_out(spark):
    out = by_id(queries.queries()["op4_lang_ppm"](spark, "/root/testdata/sf0.01"))
    truth = {r[0]: r[2] for r in table("documents", "/root/testdata/sf0.01")}
    held = [(r["lang_pred"], truth[i]) for i, r in out.items() if r["held_out"] and truth[i] and r["lang_pred"] != "und"]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    assert np.mean([a == b for a, b in held]) > 0.9


def test_language_awkward(spark):
    docs = awkward(spark)
    trees = langid.learn(docs, "doc_id", "text", "lang", 4000, 60_000)
    rows = langid.identify(docs, trees).collect()
    assert len(rows) == 17 and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 13)} == {"und"}
    assert langid.learn(awkward(spark, True), "doc_id", "text", "lang", 4000, 60_000) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


def test_language_keeps_every_byte_and_context(spark):
    letters = [chr(c) for c in (*range(0x4E00, 0x4E00 + 300), *range(0x430, 0x450), *range(0x10D0, 0x10F0), *range(97, 123))]
    made = np.random.default_rng(5)
    texts = {lang: ["".join(made.choice(letters, 60)) + " " + "abc"[i] * 9 for _ in range(12)] for i, lang in enumerate(("aa", "bb", "cc"))}
    docs = spark.createDataFrame([(f"{k}{i}", x, k) for k, v in texts.items() for i, x in enumerate(v)], "doc_id string, text string, lang string")
    trees = langid.learn(docs, "doc_id", "text", "lang", 1000)

    def length(text, seen):
        """Method C over plain dictionaries."""
        raw, total = b"   " + text.encode(), 0.0
        for i in range(3, len(raw)):
            p = 1 / 256
            for k in range(4):
                n = seen.get(raw[i - k : i], {})
                if n:
                    p = n[raw[i]] / (sum(n.values()) + len(n)) if raw[i] in n else p * len(n) / (sum(n.values()) + len(n))
            total -= np.log2(p)
        return total

    counts = {}
    for lang, every in texts.items():
        seen = counts[lang] = {}
        for text in every:
            raw = b"   " + text.encode()
            for i in range(3, len(raw)):
                for k in range(4):
                    n = seen.setdefault(raw[i - k : i], {})
                    n[raw[i]] = n.get(raw[i], 0) + 1
    import pyarrow as pa

    tried = [texts["aa"][0], texts["cc"][3][5:30], "zzz \u4e10\u0431 q", "\u00e9\u0434"]
    want = [[length(x, counts[lang]) for lang in trees.langs] for x in tried]
    assert np.allclose(trees.lengths(pa.array(tried)), want, rtol=1e-4)


def test_language_of_a_long_text_in_pieces(spark):
    import pyarrow as pa

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    trees = langid.learn(docs, "doc_id", "text", "lang", 1000)
    text = "  ".join(r["text"] for r in docs.where("text IS NOT NULL").orderBy("doc_id").limit(40).collect()) + " \u4f60\u597d ... x"
    whole = trees.lengths(pa.array([text]))
    assert all(np.allclose(trees.lengths(pa.array([text]), piece), whole, rtol=1e-9) for piece in (1000, 4097, 7))


# 5: licenses


def test_licenses_awkward(spark):
    text = "x " * 50 + licenses.TEMPLATES["mit"] + " y" * 50 + " all  RIGHTS reserved"
    docs = awkward(spark).unionByName(spark.createDataFrame([(50, text, "en", "a", None, "i", "s", "h", "t", "x", "r", "g"), (51, licenses.TEMPLATES["mit"][:60], "en", "a", None, "i", "s", "h", "t", "x", "r", "g")], awkward(spark).schema))
    assert {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()} == {(50, "mit"), (50, "all-rights-reserved")}
    assert licenses.scan(awkward(spark, True)).count() == 0


def test_licenses_equal_brute_force_without_bands_or_anchors(spark):
    """Edited copies of every template in prose: all windows of all classes, every word an anchor."""
    rng = np.random.default_rng(12)
    docs = {}
    for i, (name, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        for rate in (0.0, 0.02, 0.06):
            words = [w if rng.random() > rate else f"edit{rng.integers(0, 99)}" for w in text.split()]
            docs[len(docs)] = " ".join([*(f"a{k}" for k in range(int(rng.integers(0, 60)))), *words, *(f"b{k}" for k in range(int(rng.integers(0, 40))))])
    want = {}
    for i, text in docs.items():
        w = licenses.words_of(text)
        for (k, size), names in licenses.classes(licenses.TEMPLATES).items():
            step = max(1, size // 4)
            runs = [tuple(w[a : a + k]) for a in range(max(0, len(w) - k + 1))]
            for n in names:
                own = licenses.words_of(licenses.TEMPLATES[n])
                holds = {tuple(own[a : a + k]) for a in range(len(own) - k + 1)}
                best = max((len(holds & set(runs[a : a + size + step - k + 1])) / len(holds) for a in range(0, len(w), step)), default=0)
                if best >= 0.75:
                    want[i, n] = best
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want) and {n for _, n in want} == set(licenses.TEMPLATES)


# 6: Jaccard


def brute_jaccard(docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = Counter()
    for ids in holders.values():
        for a in range(len(ids)):
            for b in range(a):
                shared[ids[b], ids[a]] += 1
    links = [p for p, n in shared.items() if 100 * n >= 75 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    return {i: (len(sets[i]), root) for i, root in roots(sets, links).items()}


def got_classes(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_jaccard_equals_brute_force(spark, sf):
    docs = {r[0]: r[1] for r in table("documents", sf)}
    assert got_classes(queries.queries()["op6_jaccard_groups"](spark, sf)) == brute_jaccard(docs)


@pytest.mark.parametrize("group", [2, 64])
def test_jaccard_chains_of_edits(spark, group):
    """Chains of small edits around the threshold, copies and shared passages."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(120))
    docs, at = {}, 0
    for _ in range(12):
        words = [f"v{x}" for x in rng.integers(0, 4000, int(rng.integers(30, 160)))]
        for _ in range(int(rng.integers(2, 9))):
            docs[at] = " ".join(words) + (" " + passage if rng.random() < 0.3 else "")
            at += 1
            words = [w if rng.random() > 0.03 else f"e{rng.integers(0, 9999)}" for w in words]
    docs |= {at + i: docs[i % 7] for i in range(10)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    assert got_classes(jaccard.jaccard_classes(df, group=group)) == brute_jaccard(docs)


def test_jaccard_awkward(spark):
    docs = awkward(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id is not null").collect()}
    out = jaccard.jaccard_classes(docs)
    assert got_classes(out) == brute_jaccard(texts) | {None: (2, None)} and out.count() == docs.count()
    assert jaccard.jaccard_classes(awkward(spark, True)).count() == 0
    # rows of equal id are documents of their own where rows are chosen
    docs = docs.unionByName(docs.where("doc_id = 10").selectExpr(*[f"{'CAST(11 AS BIGINT)' if c == 'doc_id' else c} AS {c}" for c in docs.columns]))
    first = jaccard.first_of_each(docs)
    assert first.columns == docs.columns
    stay = [i for i, (_, c) in brute_jaccard(texts).items() if i == c]
    assert Counter(r["doc_id"] for r in first.collect()) == Counter([None, *stay]) and 11 in stay
    assert jaccard.first_of_each(awkward(spark, True)).count() == 0


def test_jaccard_long_columns(spark):
    """Columns over many groups leave in blocks; streams break within columns."""
    rng = np.random.default_rng(11)
    common = " ".join(f"c{i}" for i in range(60))
    docs = {i: common + " " + " ".join(f"u{i}x{k}" for k in range(int(rng.integers(5, 20)))) for i in range(120)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    want = brute_jaccard(docs)
    assert got_classes(jaccard.jaccard_classes(df, group=2, long=7)) == want and len({c for _, c in want.values()}) > 1

    cells = [(t, c, c, 20, 20, 20) for t in range(0, 12, 2) for c in range(int(rng.integers(1, 90)))] + [(100, 5, 5, 20, 20, 20), (101, 1, 1, 20, 20, 0), (101, 2, 2, 20, 20, 0), (102, 1, 7, 20, 20, 20), (102, 1, 8, 20, 20, 20)]
    table = spark.createDataFrame(cells, "token long, class long, group long, low long, high long, h long")
    met = {}
    for t, c, g, *_ in cells:
        met.setdefault(t, []).append((c, g))
    pairs = {(max(a, b)[1], min(a, b)[1]) for t, own in met.items() if t != 101 for a in own for b in own if a[0] != b[0]}
    for long in (3, 10, 4096):
        for parts in (1, 4):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            try:
                assert {tuple(r) for r in jaccard.columns(table, (3, 4), long).collect()} == pairs, (long, parts)
            finally:
                spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_jaccard_of_very_long_texts(spark):
    words = [f"w{i}" for i in range(120_000)]
    docs = {1: " ".join(words), 2: " ".join(words[:100_000]), 3: " ".join(words[60_000:]), 4: " ".join(words[:-3])}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert got_classes(jaccard.jaccard_classes(df)) == brute_jaccard(docs)


# 7: embeddings


def test_embeddings_equal_brute_force(spark, sf):
    rows = table("embeddings", sf)
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= 0.9, 1))
    links = [(ids[a], ids[b]) for a, b in zip(i, j)]
    n, root = Counter(v for p in links for v in p), roots(ids, links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.queries()["op7_embedding_neardup"](spark, sf).collect()}
    want = {v: (n[v], root[v], root[v] == v) for v in ids}
    assert all(got[v][0] <= want[v][0] for v in ids) and sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())
    assert sum(got[v] == want[v] for v in ids) >= 0.99 * len(ids)


def test_embeddings_awkward(spark):
    rows = [(1, [1, 0, 0, 0]), (2, [2, 0, 0, 0]), (3, [1, 0.1, 0, 0]), (4, None), (5, []), (6, [0.0] * 4), (7, [1.0, None, 0, 0]), (8, [float("nan"), 1, 0, 0]), (9, [float("inf"), 1, 0, 0]), (10, [1.0, 0, 0]), (None, [1.0, 0, 0, 0]), (2, [2.0, 0, 0, 0]), (11, [1e-200, 0, 0, 0]), (12, [0.0, 1, 0, 0])]
    df = spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], 1, "c", "d") for i, v in rows], "vec_id long, embedding array<double>, label int, id string, d string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_classes(df).collect()}
    want = {i: (0, i) for i in (4, 5, 6, 7, 8, 9, 10, 12)} | {i: (3, 1) for i in (1, 2, 3, 11)}
    assert got == want
    assert neardup.near_classes(df.limit(0)).count() == 0


def test_embeddings_recall_of_thousands(spark):
    """Planted pairs of every closeness over many cells: none is missed that brute force finds, none is too many."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((2500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal((2500, 64))
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cos = rng.uniform(0.88, 0.995, (2500, 1))
    x = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * other])
    assert neardup.plan(len(x), 0.9, 64, 1e-4)[0] >= 6
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_classes(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), cell=64).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = np.argwhere(np.triu(unit @ unit.T >= 0.9, 1))
    want, n = roots(range(len(x)), link.tolist()), Counter(link.ravel().tolist())
    wrong = sum(got[i] != (n[i], want[i]) for i in range(len(x)))
    assert wrong <= 4 and len(link) > 1500 and all(got[i][0] <= n[i] for i in range(len(x)))


def test_embedding_codes_bound_products():
    """Estimates have no bias to speak of, bounds hold for every pair, in few dimensions too, and packed rows give back what was packed."""
    rng = np.random.default_rng(8)
    for d in (1, 2, 3, 7, 16, 64, 300):
        x = rng.standard_normal((300, d))
        x[150:] = x[:150] + rng.uniform(0.05, 1, (150, 1)) * rng.standard_normal((150, d))
        x[0] = np.eye(d)[0]
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        rows = neardup.pack_rows(unit, 5, 3)
        code, factor = neardup.codes_in(rows, d)
        assert (code == neardup.codes(unit)[0]).all() and (neardup.keys_in(rows, d, 5, 3) == neardup.keys(unit, 5, 3)).all()
        est, true = neardup.estimates(code, factor), unit @ unit.T
        for threshold in (0.3, 0.6, 0.9, 0.97):
            maybe = neardup.undecided(est, factor, est, factor, threshold, 6.0)
            assert maybe[true >= threshold].all()
        if d >= 64:
            off = (est @ est.T - true)[np.triu_indices(300, 1)]
            assert abs(off.mean()) < 0.005 and np.abs(off).max() < 0.16
            assert not neardup.undecided(est, factor, est, factor, 0.9, 6.0)[true < 0.6].any()


def test_embeddings_small_blocks(spark):
    """Hot cells are cut into blocks that meet two by two; nothing is counted twice."""
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((4, 16))
    x = np.concatenate([c + 0.12 * rng.standard_normal((40, 16)) for c in centre])
    x = np.concatenate([x, x[:15]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in neardup.near_classes(df, cell=16, block=8, miss=1e-6).collect()}
    want = {i: int(link[i].sum()) - 1 for i in range(len(x))}
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.999 * sum(want.values())


# 8: personal data


def base_spans(text):
    luhn = lambda d: sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m[0])]


def check_base(rows, texts):
    for r in rows:
        want = base_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS], r["doc_id"]
        spans = [":".join(map(str, x)) for x in want]
        assert r["base_sha256"] == sha(",".join(spans)), r["doc_id"]
        assert set(spans) <= set(r["spans"].split(",")) | {""}


def test_pii_base_spans(spark):
    docs = {r[0]: r[1] for r in table("documents", "/root/testdata/sf0.01")}
    rows = queries.queries()["op8_pii_weak"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    check_base(rows, docs)


def test_pii_awkward(spark, tmp_path):
    odd = ["a@b", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "0256.1.1.1 00255.1.1.1", "4111-1111-1111-1111 4111111111111111 4111 1111 1111 1112", "+1 23 +44 20 7946 0958 x", "+0(1)2.3-4 567890 12", "\U0001f600 \u00e9 z@q.io \U0001f600 1.1.1.1", "a.b@c.d" * 50, "..%+@x.y-", "1" * 400, "@" * 500, "a@" * 300 + "b.c", "me (at) ex.com"]
    docs = awkward(spark).unionByName(spark.createDataFrame([(100 + i, t, "en", "a", None, "i", "s", "h", "t", "x", "r", "g") for i, t in enumerate(odd)], awkward(spark).schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.queries()["op8_pii_weak"](spark, str(tmp_path)).collect()
    assert len(rows) == 17 + len(odd)
    check_base(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    model = pii.learn(docs)
    pii.redact(docs, model).write.parquet(f"{tmp_path}/clean")
    clean = spark.read.parquet(f"{tmp_path}/clean")
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert {(r["__text"], r["h"]) for r in clean.collect()} == {("t", "h")}
    assert by_id(clean)[101 + 6]["text"] == "\U0001f600 \u00e9 <EMAIL> \U0001f600 <IP>"
    assert pii.redact(awkward(spark, True), pii.learn(awkward(spark, True))).count() == 0


def test_pii_of_very_many_spans(spark):
    """A text of 60,000 spans is found and marked in time that follows its length; spans that touch blocks and chunks are placed right."""
    parts = [f"mail user{i}@host{i % 97}.com \U0001f600 ip 10.{i % 256}.3.4 tel +1 555 010 {i % 10000:04d}," for i in range(20_000)]
    docs = spark.createDataFrame([(i, " ".join(parts[:n])) for i, n in enumerate((0, 1, 127, 128, 129, 257, 20_000))], "doc_id long, text string").cache()
    model = pii.Classifier({k: pii.START for k in pii.KINDS}, {})
    began = time.time()
    rows = pii.find(docs, model, F.col("text")).select("doc_id", *[F.size(f"__base_{k}").alias(f"n_{k}") for k in pii.KINDS], F.sha2(pii.listed("__base").cast("binary"), 256).alias("base_sha256"), pii.listed("__all").alias("spans")).collect()
    assert time.time() - began < 60
    check_base(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).collect()}
    assert clean[6] == " ".join(["mail <EMAIL> \U0001f600 ip <IP> tel <PHONE>,"] * 20_000) and clean[0] == ""


def plain_spans(text, model):
    """All spans: base ones, and candidates that the classifier takes, in plain Python."""
    digits = lambda h: re.sub("[^0-9]", "", h)
    luhn = lambda d: 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
    base = base_spans(text)
    meet = lambda x, y: x[1] < y[2] and x[2] > y[1]

    def votes(kind, s, e):
        h, n = text[s:e], digits(text[s:e])
        before, good, bad = text[max(0, s - 30) : s].lower(), *pii.CONTEXT[kind]
        sign = lambda g, b: -1 if b else int(bool(g))
        says = [sign(re.search(rf"\b(?:{good})\b", before), re.search(rf"\b(?:{bad})\b", before)), sign(True, re.match("[A-Za-z0-9_]", text[s - 1 : s]) or re.match("[A-Za-z0-9_]", text[e : e + 1]))]
        if kind == "email":
            tld = re.search(r"([A-Za-z0-9-]+)$", h)
            tld = tld[1].lower() if tld else ""
            return [1 if re.fullmatch("[a-z]{2,}", tld) else -1, int(tld in pii.GAZETTEER["tld"]), *says, sign(len(h) <= 60, len(h) > 200)]
        if kind == "ip":
            ok, first = all(int(p) <= 255 for p in h.split(".")), int(h.split(".")[0])
            return [1 if ok else -1, sign(1 <= first <= 223 and first != 127, first == 0 or first > 255), *says, -1 if re.search(r"(^|\.)0[0-9]", h) else 1]
        if kind == "card":
            return [1 if luhn(n) else -1, 1 if re.match("4|5[1-5]|2[2-7]|3[47]|6011|65", n) else -1, *says, sign(len(n) in (15, 16), len(h) > 23)]
        code = re.match(r"(?:\+|00)([0-9]{1,3})(?:[ .(-]|$)", h)
        return [1 if 9 <= len(n) <= 15 else -1, int(bool(code) and code[1] in pii.GAZETTEER["country"]), *says, sign(re.match(r"\+|00|\(", h) and re.search("[ .()-]", h), not re.search("[ .()+-]", h))]

    added = {}
    for k in pii.KINDS:
        found = [(k, m.start(), m.end()) for m in re.finditer(pii.WIDER[k], text)]
        if k == "card":
            failed = [(k, m.start(), m.end()) for m in re.finditer(r"[0-9](?:[\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and not luhn(digits(m[0]))]
            found += [x for x in failed if not any(meet(x, y) for y in found)]
        found = [x for x in found if not any(meet(x, y) for y in base)]
        w = model.weights[k]
        z = lambda v: w[0] + sum(w[1 + 2 * i] if x > 0 else w[2 + 2 * i] if x < 0 else 0 for i, x in enumerate(v))  # noqa: B023, E731
        added[k] = [x for x in found if z(votes(*x)) >= 0]
    out = []
    for i, k in enumerate(pii.KINDS):
        mine = [x for x in added[k] if not any(meet(x, y) for j in pii.KINDS[:i] for y in added[j])]
        mine = [x for x in mine if not any(y[1] < x[1] and y[2] > x[1] for y in added[k])]
        out += sorted({*mine, *(x for x in base if x[0] == k)}, key=lambda x: x[1:])
    return out


def test_pii_added_spans_equal_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = ["me (at) ex.com or me [at] ex [dot] com", "call 4111 1111 1111 1111 2222", "tel 555 010 9999", "order 4111 1111 1111 1112", "card 4111 1111 1111 1112", "+1 (826) 555-4081 190.137.223.204", "host 1.2.3.4.5", "00 44 207 946 0958 x"]
    docs = docs.unionByName(spark.createDataFrame([(-1 - i, x) for i, x in enumerate(odd)], "doc_id long, text string"))
    model = pii.learn(docs)
    every = pii.find(docs, model, F.col("text")).select("doc_id", "text", pii.listed("__all").alias("spans")).collect()
    want = {r["doc_id"]: ",".join(":".join(map(str, x)) for x in plain_spans(r["text"] or "", model)) for r in every}
    assert {r["doc_id"]: r["spans"] for r in every} == want
    assert any(len(plain_spans(x, model)) > len(base_spans(x)) for x in odd)


def test_pii_recovers_reliabilities():
    """The votes decide, whatever is believed of labelers before."""
    rng = np.random.default_rng(0)
    for truth, share in (((0.5, 0.95, 0.95, 0.9, 0.5), 0.4), ((0.98, 0.9, 0.95, 0.9, 0.9), 0.5), ((0.9, 0.7, 0.8, 0.6, 0.55), 0.3)):
        y = rng.random(20_000) < share
        cast = np.array([np.where(rng.random(len(y)) < r, np.where(y, 1, -1), np.where(y, -1, 1)) * (rng.random(len(y)) < 0.8) for r in truth]).T
        post, right = pii.estimate(Counter(map(tuple, cast.tolist())))
        assert np.allclose(right, np.array(truth)[:, None], atol=0.04), (truth, right)
        assert np.mean([(post[tuple(v)] > 0.5) == t for v, t in zip(cast.tolist(), y)]) > 0.8


# 9: mixing


def test_mixing_targets(spark):
    rows = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([("a", 100), ("b", 10), ("c", 10), (None, 80)], "source string, source_size long")).collect()}
    total, weights, cap = 200, {"a": 1, "b": 2, "c": 3, None: 1}, {"a": 300, "b": 30, "c": 30, None: 240}
    want, free = {}, dict(weights)
    while free:
        rest = total - sum(want.values())
        share = {s: rest * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > cap[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = cap[s]
            del free[s]
    assert rows == pytest.approx(want)


def test_mixing_awkward(spark):
    docs = awkward(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == 17 and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["doc_id"]: r["size"] for r in rows} == {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs.collect()}
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert mixing.mix(awkward(spark, True)).count() == 0
    out = mixing.mixture(docs)
    times = Counter(r["doc_id"] for r in out.collect())
    assert out.columns == docs.columns and {r["__hash"] for r in out.collect()} == {"x"}
    assert all(times[r["doc_id"]] % max(r["times"], 1) == 0 for r in rows)
    assert sum(len(WORD.findall(r["text"] or "")) for r in out.collect()) == sum(r["taken"] for r in rows)


def test_mixing_at_the_limit(spark):
    """A source whose target is its limit is taken three times whole, its empty documents too."""
    rows = [(i, "w " * 50, "a") for i in range(20)] + [(100 + i, "x y" if i % 2 else "", "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert {r["times"] for r in got if r["doc_id"] >= 100} == {3} and {(r["source_size"], r["target"]) for r in got} == {(1000, 920.0), (40, 120.0)}
    assert Counter(r["doc_id"] for r in mixing.mixture(docs).where("source = 'b'").collect()) == {100 + i: 3 for i in range(40)}


def test_mixing_many_sources(spark):
    """More sources than fit a window of one task are ranked in order of their code points."""
    names = [None, "", "\U0001f600", "z", "\u00e9", *(f"s{i:04d}" for i in range(500))]
    table = spark.createDataFrame([(n, 10 + i % 7) for i, n in enumerate(names)], "source string, source_size long").repartition(7)
    order = sorted((n for n in names if n is not None), key=lambda n: [ord(c) for c in n]) + [None]
    weight = {n: i % 3 + 1 for i, n in enumerate(order)}
    got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.targets(table).collect()}
    size = {n: 10 + i % 7 for i, n in enumerate(names)}
    target, free = {}, dict(weight)
    while free:
        level = (sum(size.values()) - sum(target.values())) / sum(free.values())
        over = [n for n in free if 3 * size[n] < level * free[n]]
        if not over:
            target |= {n: level * w for n, w in free.items()}
            break
        for n in over:
            target[n] = 3 * size[n]
            del free[n]
    assert got.keys() == target.keys() and all(abs(got[n][1] - target[n]) < 1e-9 for n in target)


def test_mixing_comes_near_targets(spark):
    rows = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")).collect()
    taken, aim, largest = Counter(), {}, Counter()
    for r in rows:
        taken[r["source_size"]] += r["taken"]
        aim[r["source_size"]] = r["target"]
        largest[r["source_size"]] = max(largest[r["source_size"]], r["size"])
    assert all(abs(taken[s] - aim[s]) <= largest[s] for s in aim)


# 10: quality rules


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = defaultdict(list)
    for i in range(len(words) - 4):
        runs[tuple(words[i : i + 5])].append(i)
    again = {i + k for at in runs.values() if len(at) > 1 for i in at for k in range(5)}
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


def check_rules(rows, texts):
    for r in rows:
        got = tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == brute_rules(texts[r["doc_id"]]), r["doc_id"]
        assert not (r["base_failed"] and r["kept"])


def test_rules_equal_brute_force(spark, sf):
    docs = {r[0]: r[1] for r in table("documents", sf)}
    check_rules(queries.queries()["op10_line_crf"](spark, sf).collect(), docs)


def test_rules_awkward(spark):
    odd = ["a b\nc d\na b\n\na b\r\n", "x\n\nx\n", "\n\n\n", "one two three four five one two three four five six", "a a a a a a a", "\u2028 \u00a0x\n\u2028 \u00a0x"]
    docs = awkward(spark).unionByName(spark.createDataFrame([(100 + i, t, "en", "a", None, "i", "s", "h", "t", "x", "r", "g") for i, t in enumerate(odd)], awkward(spark).schema))
    labels = spark.createDataFrame([(4, 1), (13, 0), (None, 1), (5, None), (4, 1)], "doc_id long, quality int")
    rows = crf.judge(docs, crf.learn(docs, labels)).collect()
    assert len(rows) == 17 + len(odd)
    check_rules(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert crf.judge(awkward(spark, True), crf.learn(awkward(spark, True), labels.limit(0))).count() == 0


def test_rules_learn_from_one_row_of_an_id(spark):
    """An id of very many rows reaches the driver once, and the field is the same as with one row of it."""
    lines = lambda i: "\n".join(f"line {i} number {j} of a text." if j % 3 else "* | menu" for j in range(12))
    one = spark.createDataFrame([(i, lines(i)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    many = one.unionByName(spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(lines(7)).alias("text")))
    a, b = crf.learn(one, labels), crf.learn(many, labels)
    assert a.keys() == b.keys() and all(np.array_equal(a[k], b[k]) for k in a)


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(2)
    model = {"w": rng.standard_normal(crf.N), "t": rng.standard_normal((2, 2))}
    lines = np.array([3, 0, 6, 1])
    bits = rng.integers(0, 1 << crf.N, lines.sum())
    emit = crf._expand(bits) @ model["w"]
    got, at = crf.viterbi(model, bits, lines).tolist(), 0
    for n in lines.tolist():
        value = lambda y, at=at: sum(emit[at + i] * v for i, v in enumerate(y)) + sum(model["t"][a, b] for a, b in zip(y, y[1:]))
        assert tuple(got[at : at + n]) == max(product((0, 1), repeat=n), key=value)
        at += n


def plain_bits(text):
    """The features of each line of a text that has a word, and its words."""
    out, seen = [], set()
    for line in text.split("\n"):
        words = WORD.findall(line)
        if not words:
            continue
        n, chars = len(words), sum(map(len, words))
        count = lambda ok: sum(map(ok, line))  # noqa: B023, E731
        symbols, upper, lower = count(lambda c: c in crf.SYMBOLS), count(lambda c: "A" <= c <= "Z"), count(lambda c: "a" <= c <= "z")
        digits, bangs = count(lambda c: "0" <= c <= "9"), count(lambda c: c == "!")
        flags = [n <= 2, 3 <= n <= 5, 6 <= n <= 11, 12 <= n <= 24, n >= 25, 50 * symbols > chars, 12 * symbols > chars, upper > lower, 5 * digits > chars, 33 * bangs > chars, n >= 6 and 2 * len(set(words)) < n,
                 any(a == b == c for a, b, c in zip(words, words[1:], words[2:])), words[-1][-1] in ".?!", any(w in set(crf.SYMBOLS) | {"-", "/"} for w in words), line in seen, True]
        seen.add(line)
        out.append((sum(1 << k for k, f in enumerate(flags) if f), n))
    return out


def test_kept_equals_a_plain_version(spark, sf):
    """Features, decoding over all paths of short chains and by a plain recursion of long ones, share of content, verdict."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = ["A B C\n- x / y\nA B C\nThe end of it is here now, isn't it?", "WOW!!! BUY BUY BUY\nwords and more words in a line that goes on and on for long enough now.\n\n1 2 3", "x"]
    docs = docs.unionByName(spark.createDataFrame([(-1 - i, x) for i, x in enumerate(odd)], "doc_id long, text string"))
    model = crf.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = by_id(crf.judge(docs, model))
    for i, text in ((r["doc_id"], r["text"] or "") for r in docs.collect()):
        lines = plain_bits(text)
        best = {0: (0.0, ()), 1: (0.0, ())} if lines else {0: (0.0, ())}
        for k, (bits, _) in enumerate(lines):
            emit = sum(w for f, w in enumerate(model["w"]) if bits >> f & 1)
            best = {y: max(((best[x][0] + (model["t"][x, y] if k else 0) + emit * y, (*best[x][1], y)) for x in ((0, 1) if k else (y,))), key=lambda v: v[0]) for y in (0, 1)}
        path = max(best.values(), key=lambda v: v[0])[1]
        words = sum(n for _, n in lines)
        share = sum(n for y, (_, n) in zip(path, lines) if y) / max(words, 1)
        assert abs(got[i]["content_share"] - share) < 1e-9 and got[i]["kept"] == (not brute_rules(text)[-1] and share >= 0.3), i


def test_field_is_the_most_likely():
    """The fitted field against the likelihood summed over all labellings: no small step makes it better."""
    from itertools import product

    rng = np.random.default_rng(6)
    lines = np.array([3, 1, 4, 2])
    bits, labels, weights = rng.integers(0, 1 << crf.N, lines.sum()), rng.integers(0, 2, lines.sum()), 1.0 / lines

    def gain(w, t):
        x, at, out = crf._expand(bits), 0, 0.0
        for n, weight in zip(lines, weights):
            value = lambda y, at=at: sum((x[at + i] @ w) * v for i, v in enumerate(y)) + sum(t[a, b] for a, b in zip(y, y[1:]))
            out += weight * (value(labels[at : at + n].tolist()) - np.log(sum(np.exp(value(y)) for y in product((0, 1), repeat=int(n)))))
            at += n
        start = crf.prior()
        return out / weights.sum() - 1e-3 * (((w - start["w"]) ** 2).sum() + ((t - start["t"]) ** 2).sum())

    model = crf.fit(bits, lines, labels, weights, rounds=6000)
    best = gain(model["w"], model["t"])
    for k in range(crf.N):
        for step in (-0.1, 0.1):
            moved = model["w"].copy()
            moved[k] += step
            assert gain(moved, model["t"]) <= best + 1e-4
    for a, b in product((0, 1), repeat=2):
        for step in (-0.1, 0.1):
            moved = model["t"].copy()
            moved[a, b] += step
            assert gain(model["w"], moved) <= best + 1e-4
