"""Unions by priority, differences of keys, and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.operators.windows import keep_best


def union_first(parts: list[DataFrame], key: str, *ties: Column) -> DataFrame:
    """The union of tables with one row a key, from the first table that has it."""
    out = None
    for i, df in enumerate(parts):
        one = df.withColumn("__part", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return keep_best(out, [key], F.col("__part"), *ties).drop("__part")


def union_best(parts: list[DataFrame], key: str, score: str) -> DataFrame:
    """One row a key with its best score over all tables."""
    out = parts[0].select(key, score)
    for df in parts[1:]:
        out = out.unionByName(df.select(key, score))
    return out.groupBy(key).agg(F.max(score).alias(score))


def diff_keys(official: DataFrame, local: DataFrame, key: str, same: Column) -> DataFrame:
    """Adds `state` to the full outer join: created, withdrawn, changed or unchanged. Columns are prefixed o_ and l_."""
    o = official.select(*[F.col(c).alias(f"o_{c}") for c in official.columns])
    m = local.select(*[F.col(c).alias(f"l_{c}") for c in local.columns])
    out = o.join(m, F.col(f"o_{key}") == F.col(f"l_{key}"), "full")
    state = F.when(F.col(f"l_{key}").isNull(), "created").when(F.col(f"o_{key}").isNull(), "withdrawn").when(same, "unchanged").otherwise("changed")
    return out.withColumn("state", state)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of a total order, with the total and the number of pages on each row."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.join(F.broadcast(total)).withColumns({"pages": F.ceil(F.col("total") / size).cast("long"), "has_more": F.col("total") > number * size})


def page_then_sort(df: DataFrame, cut: list[Column], number: int, size: int, order: list[Column]) -> DataFrame:
    """A page cut in one order and shown in another."""
    return df.orderBy(*cut).offset((number - 1) * size).limit(size).orderBy(*order)


def in_order_of(df: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows of the ids given, with their place in that list."""
    at = F.array_position(F.array(*map(F.lit, ids)), F.col(key))
    return df.where(F.col(key).isin(*ids)).withColumn("place", at)
