"""Operator 9: mixing sources to target weights by hash-threshold histograms.

A document's size is its number of words, its hash 60 bits of the MD5 of its id. Each source's target is its share of all sizes by
weight, at most `most` times its own size, the excess shared anew by weight. A source is taken whole as often as its target allows;
the rest is a budget: sizes are summed by source and 10 leading bits of the hash, the bucket in which the budget ends is found, and
only that bucket is refined by the next 10 bits, until one hash is left. Documents whose hash is under the threshold are taken once more
(the one on it if that comes nearer the target). Nothing is sorted; the histograms have at most 2^10 rows a source, and a larger budget
takes a superset of a smaller one.

Cases: null and empty texts have size 0 and take nothing; a null source is a source, the last one; null ids share one hash; rows that
repeat an id are taken or left together; other columns stay; an empty table gives an empty table. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.common import WORD, documents, light, packed, settle, unpacked

BITS, LEVELS = 10, 6


def sized(docs: DataFrame, text_col: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def hashed(id_col: str = "doc_id") -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds `rank`, from 0, in code point order, null last. Ranges of sources are counted each by itself and moved by the ranges before them, so
    there may be as many sources as there are documents."""
    key = F.col("source").asc_nulls_last()
    parts = settle(sources.repartitionByRange(key).sortWithinPartitions(key).withColumn("__part", F.spark_partition_id()))
    own = parts.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1)
    sizes = {r["__part"]: r["n"] for r in parts.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    before, moved = 0, []
    for part in sorted(sizes):
        moved += [F.lit(part), F.lit(before)]
        before += sizes[part]
    offset = F.element_at(F.create_map(*moved), F.col("__part")) if moved else F.lit(0)
    return own.withColumn("rank", F.col("__at") + offset).drop("__part", "__at")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target): from (source, source_size).

    The excess of full sources is shared again until none is above its limit: each round is one sum over the sources."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    w = settle(ranked(sizes).withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double")))
    level, full = None, -1
    while True:
        above = F.col("cap") <= level * F.col("weight") if level is not None else F.lit(False)
        r = w.agg(F.sum("source_size").cast("double").alias("total"), F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("caps"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("free"), F.count_if(above).alias("full")).first()
        if r["full"] == full or not r["free"]:
            break
        full, level = r["full"], (r["total"] - r["caps"]) / r["free"]
    target = F.col("cap") if level is None or not r["free"] else F.least("cap", F.lit(level) * F.col("weight"))
    return w.select("source", "source_size", target.alias("target"))


def thresholds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(of, source_size, target, whole, budget, last): a row for each source: how often all of it is taken, and the last hash taken once more."""
    base = settle(docs.select(F.col(source_col).alias("source"), sized(docs, text_col).alias("size"), hashed(id_col).alias("hash")))
    aims = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    aims = aims.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0))
    aims = settle(aims.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))
    found = aims.select(F.col("source").alias("s"), "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("under"), F.lit(0).cast("long").alias("on"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = base.join(sided(found), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", shift + BITS) == F.col("prefix")))
        bars = inside.groupBy("s", F.shiftright("hash", shift).alias("p")).agg(F.sum("size").alias("n"), F.first("budget").alias("budget"), F.first("under").alias("under"))
        bars = bars.withColumn("upto", F.col("under") + F.sum("n").over(Window.partitionBy("s").orderBy("p")))
        # the first bucket that goes beyond the budget
        edge = bars.where("upto > budget").groupBy("s").agg(F.min(F.struct("p", "upto", "n", "budget")).alias("e"))
        found = settle(edge.select("s", "e.budget", F.col("e.p").alias("prefix"), (F.col("e.upto") - F.col("e.n")).alias("under"), F.col("e.n").alias("on")))
    line = found.select("s", F.when(F.col("under") + F.col("on") / 2 <= F.col("budget"), F.col("prefix")).otherwise(F.col("prefix") - 1).alias("last"))
    return settle(aims.join(line, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("of"), "source_size", "target", "whole", aims["budget"], "last"))


def sided(sources: DataFrame) -> DataFrame:
    """A table of sources, broadcast where its bytes are few."""
    return light(sources, 48)


def times() -> Column:
    """How often a document is taken, from its hash and its source's row of thresholds."""
    once_more = F.coalesce(F.col("__hash") <= F.col("last"), F.lit(False)) & (F.col("budget") > 0)
    return (F.col("whole") + once_more.cast("long")).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(id, size, source_size, target, taken, times): a row for each document."""
    aims = sided(thresholds(docs, id_col, text_col, source_col, weights, most))
    base = docs.select(F.col(id_col), F.col(source_col).alias("__source"), sized(docs, text_col).alias("size"), hashed(id_col).alias("__hash"))
    out = base.join(aims, F.col("__source").eqNullSafe(F.col("of"))).withColumn("times", times())
    return out.select(id_col, "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), "times")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it, with their own columns."""
    aims = sided(thresholds(docs, id_col, text_col, source_col, weights, most))
    marked = packed(docs, id_col, __source=F.col(source_col), __hash=hashed(id_col)).join(aims, F.col("__source").eqNullSafe(F.col("of"))).withColumn("times", times()).where("times > 0")
    return unpacked(marked.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))), docs.columns)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(docs: str = "documents") -> str:
    return f"""
WITH b AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM b GROUP BY source),
w AS (SELECT source, source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio,
        (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w),
l AS (SELECT arg_min(rate, ratio) AS level FROM r WHERE ratio >= rate),
t AS (SELECT source, source_size, least(cap, level * weight) AS target FROM r, l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
u AS (SELECT source, h, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM b GROUP BY source, h)
SELECT b.doc_id, b.size, q.source_size, q.target,
       CAST(b.size * (q.whole + CASE WHEN q.source_size > 0 AND (u.upto - u.n) + u.n / 2 <= q.target - q.whole * q.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM b JOIN q ON b.source IS NOT DISTINCT FROM q.source JOIN u ON b.source IS NOT DISTINCT FROM u.source AND b.h = u.h
"""


QUERIES = {"op9_mix_sources": op9_mix_sources}
SQL = {"op9_mix_sources": mix_sql()}
