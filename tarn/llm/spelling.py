"""Operator 11: grouping of spelling variants by a forward and a reversed sorted dictionary.

Words are counted over all texts, and those of at least `least` code points and `often` occurrences are the dictionary. Two words are near if one
inserted, deleted or replaced code point makes one the other. One edit leaves a half of the shorter word intact, so near words share their
first half, or else their last half: they stand in one block of the dictionary sorted from the left, or of the one sorted from the right.

A block is what stands between two places of a sorted dictionary: words with the first `a` and the last `b` code points in common, of one length (for
replacements) or of two neighbouring ones (for insertions). Blocks are counted first, with sums by task before the shuffle. A block of more than
`most` words is subdivided before it is ever gathered: what is uncertain between its two ends is halved in the same way, and a word goes on in two
blocks, with a longer beginning and with a longer end in common. This ends by itself, as words that agree but for one place are as many as there are letters. Small
blocks are then ranges of the two sorted dictionaries, read range by range and verified by edit distance. A pair that shares both halves counts in the
block of the beginning only: a block of an end has a `bar`, a beginning that its pairs must not share. What leaves a block is one row a
word, with its number of near words and the best of them.

A word's form is its near word of most occurrences (of equally frequent ones the first in code point order), if it is `ratio` times as frequent. Forms are
followed to the last by jumps that double, as each step is `ratio` times as frequent there are few.

Cases: null and empty texts have no words; a null id is written as nothing before the colon of a hash; repeated rows count again; texts and
words of any length count whole; other columns are ignored; an empty table has an empty dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import documents, light, settle

#: What a block is: its kind, the length of its shorter words, how much of beginning and end they share, the beginning that pairs must not share.
KEY = ["kind", "short", "a", "b", "bar", "left", "right"]
FREE = (1 << 31) - 1


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, often: int = 5, slip: int = 199) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased. Where `slip` divides the hash of id and run, the run has lost a code point (0: never); shorter
    runs than `least` can't give a word and are not looked at."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-zÀ-ÿ]{{{max(least, 1)},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("run"))
    rows = rows.select("id", low.alias("run"))
    if slip:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        rows = rows.select(F.when(h % slip == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run")).alias("run"))
    return rows.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where((F.col("n") >= often) & (F.length("word") >= least))


def half(kind: Column, open_: Column) -> Column:
    """How much of an uncertain length near words share at one of its ends: of replacements the lower half, of insertions the upper."""
    return F.floor((open_ + F.when(kind == "insert", 1).otherwise(0)) / 2).cast("int")


def block(kind: Column, short: Column, a: Column, b: Column, bar: Column) -> Column:
    return F.struct(kind.alias("kind"), short.cast("int").alias("short"), a.cast("int").alias("a"), b.cast("int").alias("b"), bar.cast("int").alias("bar"))


def keyed(rows: DataFrame, blocks: Column) -> DataFrame:
    """(KEY, word, n): a row for each of the blocks of a word; `right` is the end read from the right."""
    out = rows.select("word", "n", F.explode(blocks).alias("k")).select("k.*", "word", "n")
    tail = F.length("word") - F.col("b")
    return out.withColumns({"left": F.substring("word", F.lit(1), F.col("a")), "right": F.reverse(F.substring("word", tail + 1, F.col("b")))})


def dictionaries(words: DataFrame) -> DataFrame:
    """The places of each word in both dictionaries: among words of its length, and as the shorter and the longer of two lengths."""
    size, none, free = F.length("word"), F.lit(0), F.lit(FREE)
    out = []
    for kind, short in ((F.lit("replace"), size), (F.lit("insert"), size), (F.lit("insert"), size - 1)):
        h = half(kind, short)
        out += [block(kind, short, h, none, free), block(kind, short, none, h, h)]
    return keyed(words, F.filter(F.array(*out), lambda k: k["short"] >= 0))


def subdivided(rows: DataFrame) -> DataFrame:
    """The two blocks in which each word of a block goes on."""
    c = {k: F.col(k) for k in KEY}
    h = half(c["kind"], c["short"] - c["a"] - c["b"])
    further = F.array(block(c["kind"], c["short"], c["a"] + h, c["b"], c["bar"]), block(c["kind"], c["short"], c["a"], c["b"] + h, F.least(c["bar"], c["a"] + h)))
    return keyed(rows, further)


def near_words(words: DataFrame, most: int = 32) -> DataFrame:
    """(word, n_near, best: (less, word)): of each word with near words, their number and the best of them; less: its n, negative. words: (word, n), settled."""
    rows, small = dictionaries(words), []
    divisible = half(F.col("kind"), F.col("short") - F.col("a") - F.col("b")) > 0
    while True:
        full = settle(rows.where(divisible).groupBy(*KEY).agg(F.count("*").alias("members")).where(F.col("members") > most).select(*KEY))
        if not full.limit(1).count():
            small.append(rows)
            break
        small.append(rows.join(light(full, 40), KEY, "left_anti"))
        rows = settle(subdivided(rows.join(light(full, 40), KEY, "left_semi")))
    found = None
    for part in small:
        counted = verified(part)
        found = counted if found is None else found.unionByName(counted)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def verified(rows: DataFrame) -> DataFrame:
    """(word, n_near, best) of each word with near words within a block. The dictionaries are dealt by ranges of their order, so a block is read where it
    lies and not dealt again."""
    members = rows.repartitionByRange(*KEY).groupBy(*KEY).agg(F.collect_list(F.struct("word", "n")).alias("m")).where(F.size("m") > 1)

    def near(u: Column, v: Column) -> Column:
        lengths = F.when(F.col("kind") == "insert", F.length(u["word"]) != F.length(v["word"])).otherwise(u["word"] != v["word"])
        fresh = (F.col("bar") == FREE) | (F.substring(u["word"], F.lit(1), F.col("bar")) != F.substring(v["word"], F.lit(1), F.col("bar")))
        return lengths & fresh & (F.levenshtein(u["word"], v["word"], 1) == 1)

    def of(u: Column) -> Column:
        others = F.transform(F.filter("m", lambda v: near(u, v)), lambda v: F.struct((-v["n"]).alias("less"), v["word"].alias("word")))
        return F.struct(u["word"].alias("word"), F.size(others).cast("long").alias("n_near"), F.array_min(others).alias("best"))

    each = F.filter(F.transform("m", of), lambda x: x["n_near"] > 0)
    return members.select(F.explode(each).alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last. forms: (word, form), settled."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        jump = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = settle(now.join(light(jump, 40), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return now


def variants(words: DataFrame, ratio: int = 5, most: int = 32) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n), settled."""
    found = words.join(near_words(words, most), "word", "left")
    kept = -F.col("best.less") >= ratio * F.col("n")
    told = settle(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(kept, F.col("best.word")).alias("form"), F.when(kept, -F.col("best.less")).alias("form_n")))
    last = roots(told.where(F.col("form").isNotNull()).select("word", "form"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(settle(vocabulary(documents(spark, sf_dir))))


#: The same in SQL: the hash byte by byte over a table made by its rule; near words share what is left when one code point is left out of one or both.
_SQL = """
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) WHERE length(r) >= 6 GROUP BY ALL),
coded AS (SELECT run, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) AS h FROM coded, tab),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed) GROUP BY word HAVING sum(k) >= 5 AND length(word) >= 6),
d AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
e AS (SELECT a.word, b.word AS other FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.rest UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.rest),
b AS (SELECT e.word, count(*) AS n_near, arg_min(other, (-n, other)) AS form, max(n) AS form_n FROM e JOIN v ON v.word = e.other GROUP BY e.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
w(word, root, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT w.word, f.form, step + 1 FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM w GROUP BY word) l ON l.word = f.word
"""

QUERIES = {"op11_spelling_variants": op11_spelling_variants}
SQL = {"op11_spelling_variants": _SQL}
