"""Counts, facets, histograms and audits. What the stores left to chance on ties is settled by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.windows import running


def top_counts(df: DataFrame, key: str, k: int, name: str = "n", drop_empty: bool = True) -> DataFrame:
    """The k most frequent values; equals by name. An empty or missing key is left out after the cut if so asked."""
    out = df.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), F.asc_nulls_last(key)).limit(k)
    return out.where(F.col(key).isNotNull()) if drop_empty else out


def exploded_top(df: DataFrame, values: Column, k: int, least: int = 3) -> DataFrame:
    """The k most frequent lower-cased values of an array that have at least so many characters."""
    one = df.select(F.explode(values).alias("value")).select(F.lower(F.trim("value")).alias("value")).where(F.length("value") >= least)
    return top_counts(one, "value", k)


def pivot_counts(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts by two keys as a table; the values of the second are given, so no pass looks for them."""
    return df.groupBy(row).pivot(column, values).count().fillna(0)


def share_histogram(df: DataFrame, bucket: Column, value: str, places: int = 2) -> DataFrame:
    """Rows, mean, sum and share of all rows of each bucket."""
    out = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(value), places).alias("mean"), F.round(F.sum(value), places).alias("total"))
    return out.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def census(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): independent counts, so an empty table is a row of 0."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def coverage(df: DataFrame, key: str) -> DataFrame:
    """(key, n, rank, cumulative share): what the most frequent values cover, equals by name."""
    out = running(df.groupBy(key).agg(F.count("*").alias("n")), [F.desc("n"), F.asc_nulls_last(key)], "n")
    total = df.count()
    return out.select(key, "n", "rank", F.round(F.col("so_far") / total, 6).alias("covered"))


def facets(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(facet, value): the distinct values of several columns or arrays, in one scan."""
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), c.cast("string").alias("value")) for k, c in columns.items()])).alias("f")
    return df.select(stacked).select("f.*").where("value IS NOT NULL AND value != ''").distinct()


def audit(df: DataFrame, required: list[str], texts: list[str], key: str) -> DataFrame:
    """One row: how many values are missing or empty in each column, how many keys repeat, and whether all is well."""
    checks = [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in required] + [F.count_if(F.col(c) == "").alias(f"empty_{c}") for c in texts]
    one = df.agg(F.count("*").alias("n"), *checks, (F.count(key) - F.countDistinct(key)).alias("repeated"))
    return one.withColumn("sound", sum([F.col(c) for c in one.columns[1:]], F.lit(0)) == 0)


def repeated(df: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rate(part: Column, whole: Column, places: int = 1) -> Column:
    """A percentage, 0 where there is nothing to divide by."""
    return F.coalesce(F.round(100.0 * part / F.nullif(whole, F.lit(0)), places), F.lit(0.0))
