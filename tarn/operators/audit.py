"""Audits of raw records: which types the values of JSON documents have, path by path, before anything is typed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.session import cut

#: Kinds of values, by how the type of a VARIANT begins.
KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BIGINT": "int", "DOUBLE": "number", "DECIMAL": "number", "FLOAT": "number", "BOOLEAN": "bool", "VOID": "null"}


def kind_of(v: Column) -> Column:
    """The kind of a VARIANT; null where there is none."""
    first = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return F.when(v.isNotNull(), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), first), F.lower(first)))


def type_counts(df: DataFrame, raw: str) -> DataFrame:
    """(path, kind, n): how many values of each kind stand at each path of the documents of a column of JSON texts. '$' is the document itself,
    '.name' a field, '[]' the elements of an array. Texts that are no JSON have the kind 'malformed', null texts the kind 'missing'.

    One level of nesting is taken apart at a time, as rows, until nothing nested is left; levels are cut, so each is worked out once."""
    v = F.try_parse_json(F.col(raw))
    level = df.select(F.lit("$").alias("path"), v.alias("v"), F.when(F.col(raw).isNull(), "missing").when(v.isNull(), "malformed").otherwise(kind_of(v)).alias("kind"))
    counts = None
    while True:
        level = cut(level)
        own = level.groupBy("path", "kind").agg(F.count("*").alias("n"))
        counts = own if counts is None else counts.unionByName(own)
        nested = level.where(F.col("kind").isin("object", "array"))
        if not nested.limit(1).count():
            return counts
        parts = nested.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "value"))
        level = parts.select(F.when(F.col("kind") == "array", F.concat("path", F.lit("[]"))).otherwise(F.concat("path", F.lit("."), "key")).alias("path"), F.col("value").alias("v"), kind_of(F.col("value")).alias("kind"))


def is_kind(v: Column, path: str, *kinds: str) -> Column:
    """Whether the value at a path of a VARIANT is of one of these kinds; false where it is missing, so that its negation finds missing values, too."""
    return F.coalesce(kind_of(F.try_variant_get(v, path, "variant")).isin(*kinds), F.lit(False))


def audit(df: DataFrame, raw: str, required: list[str], typed: dict[str, tuple[str, ...]], filled: list[str] = ()) -> DataFrame:
    """(check, path, n): over all documents, in one pass: values that are missing or null, values that are not of a kind, arrays and strings that are
    empty. A text that is no JSON misses everything."""
    v = F.col("__v")
    at = lambda path: F.try_variant_get(v, path, "variant")
    checks = [("all", "$", F.lit(True)), *(("missing", p, ~F.coalesce(kind_of(at(p)) != "null", F.lit(False))) for p in required)]
    checks += [(f"not {' or '.join(kinds)}", p, ~is_kind(v, p, *kinds)) for p, kinds in typed.items()]
    checks += [("empty", p, F.coalesce(F.to_json(at(p)).isin("[]", '""'), F.lit(False))) for p in filled]
    rows = df.select(F.try_parse_json(F.col(raw)).alias("__v"))
    counted = rows.agg(*[F.count_if(c).alias(f"c{i}") for i, (_, _, c) in enumerate(checks)])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.lit(path).alias("path"), F.col(f"c{i}").alias("n")) for i, (name, path, _) in enumerate(checks)])).alias("x")).select("x.*")


def strings_of(df: DataFrame, raw: str, skipped: list[str] = ()) -> DataFrame:
    """(text): the distinct strings that JSON documents hold at any depth, empty ones and those under the keys named left out. Taken apart level by level, as `type_counts`."""
    v = F.try_parse_json(F.col(raw))
    level, out = df.select(v.alias("v"), kind_of(v).alias("kind")).where("v IS NOT NULL"), None
    while True:
        level = cut(level)
        own = level.where("kind = 'string'").select(F.try_variant_get("v", "$", "string").alias("text")).where("text != ''")
        out = own if out is None else out.unionByName(own)
        nested = level.where(F.col("kind").isin("object", "array"))
        if not nested.limit(1).count():
            return out.distinct()
        parts = nested.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "value"))
        kept = F.col("key").isNull() | ~F.col("key").isin(*skipped) if skipped else F.lit(True)
        level = parts.where(kept).select(F.col("value").alias("v"), kind_of(F.col("value")).alias("kind"))
