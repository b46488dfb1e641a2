"""Queries that audit raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators import audit as A
from tarn.plans.registry import Tables, query

#: A raw record of each part, whose values are of several types: sizes as numbers, texts and null, a nested list of mixed values, fields that are left out.
RAW_SQL = """
SELECT p_partkey, CASE WHEN p_partkey % 97 = 0 THEN '{broken' WHEN p_partkey % 89 = 0 THEN NULL ELSE '{"name":"' || p_name || '"' || CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 3 = 0 THEN ',"size":"' || p_size || '"' WHEN p_size % 5 = 0 THEN ',"size":null' ELSE ',"size":' || p_size END
  || ',"details":' || CASE WHEN p_size % 7 = 0 THEN '[]' ELSE '{"brand":"' || p_brand || '","on":' || CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END || ',"tags":[' || CASE WHEN p_size % 2 = 0 THEN '' ELSE p_size || ',"' || p_type || '",{"deep":[1.5,null]}' END || ']}' END || '}' END AS raw FROM part
"""


def raw_parts(t: Tables) -> DataFrame:
    size, text = F.col("p_size"), lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    number = size.cast("string")
    sized = F.when(size % 4 == 0, "").when(size % 3 == 0, text(',"size":"', number, '"')).when(size % 5 == 0, ',"size":null').otherwise(text(',"size":', number))
    tags = F.when(size % 2 == 0, "").otherwise(text(number, ',"', F.col("p_type"), '",{"deep":[1.5,null]}'))
    details = F.when(size % 7 == 0, "[]").otherwise(text('{"brand":"', F.col("p_brand"), '","on":', F.when(size > 25, "true").otherwise("false"), ',"tags":[', tags, "]}"))
    raw = F.when(F.col("p_partkey") % 97 == 0, "{broken").when(F.col("p_partkey") % 89 != 0, text('{"name":"', F.col("p_name"), '"', sized, ',"details":', details, "}"))
    return t.part.select("p_partkey", raw.alias("raw"))


_KIND = "CASE WHEN {0} IN ('UBIGINT', 'BIGINT', 'HUGEINT') THEN 'int' WHEN {0} = 'DOUBLE' THEN 'number' WHEN {0} = 'VARCHAR' THEN 'string' WHEN {0} = 'BOOLEAN' THEN 'bool' ELSE lower({0}) END"


def _tree(rows: str, raw: str) -> str:
    return f"""
SELECT path, kind, count(*) AS n FROM (
  SELECT regexp_replace(j.fullkey, '\\[\\d+\\]', '[]', 'g') AS path, {_KIND.format("j.type")} AS kind FROM ({rows}) r, json_tree(r.{raw}) j WHERE json_valid(r.{raw})
  UNION ALL SELECT '$', CASE WHEN {raw} IS NULL THEN 'missing' ELSE 'malformed' END FROM ({rows}) WHERE {raw} IS NULL OR NOT json_valid({raw})) GROUP BY ALL
"""


@query(_tree("SELECT props FROM events", "props"))
def event_types(t: Tables) -> DataFrame:
    """how often the properties of events hold values of each type, path by path."""
    return A.type_counts(t.events, "props")


@query(_tree(RAW_SQL, "raw"))
def record_types(t: Tables) -> DataFrame:
    """the same over nested records of mixed types."""
    return A.type_counts(raw_parts(t), "raw")


@query(f"""
WITH r AS (SELECT CASE WHEN json_valid(raw) THEN raw END AS raw FROM ({RAW_SQL})), k AS (SELECT json_type(raw, '$.name') AS name, json_type(raw, '$.size') AS size, json_type(raw, '$.details') AS details, json_type(raw, '$.details.tags') AS tags, CAST(raw -> '$.details.tags' AS VARCHAR) AS own, CAST(raw -> '$.details' AS VARCHAR) AS whole FROM r)
SELECT 'all' AS check, '$' AS path, count(*) AS n FROM k
UNION ALL SELECT 'missing', '$.name', count(*) FROM k WHERE coalesce(name, 'NULL') = 'NULL' UNION ALL SELECT 'missing', '$.size', count(*) FROM k WHERE coalesce(size, 'NULL') = 'NULL' UNION ALL SELECT 'missing', '$.details.tags', count(*) FROM k WHERE coalesce(tags, 'NULL') = 'NULL'
UNION ALL SELECT 'not object', '$.details', count(*) FROM k WHERE details IS DISTINCT FROM 'OBJECT' UNION ALL SELECT 'not array', '$.details.tags', count(*) FROM k WHERE tags IS DISTINCT FROM 'ARRAY'
UNION ALL SELECT 'not int or number', '$.size', count(*) FROM k WHERE coalesce(size, '') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE')
UNION ALL SELECT 'empty', '$.details.tags', count(*) FROM k WHERE own = '[]' UNION ALL SELECT 'empty', '$.details', count(*) FROM k WHERE whole = '[]'
""")
def record_audit(t: Tables) -> DataFrame:
    """Counts of missing, wrongly typed and empty fields of nested records, negated types included."""
    typed = {"$.details": ("object",), "$.details.tags": ("array",), "$.size": ("int", "number")}
    return A.audit(raw_parts(t), "raw", ["$.name", "$.size", "$.details.tags"], typed, ["$.details.tags", "$.details"])
