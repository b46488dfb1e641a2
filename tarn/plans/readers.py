"""Readers over files that Spark writes from the given tables: each query writes a table in a format to the shared folder, reads it back with the reader, and uses it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.plans.registry import Tables, query
from tarn.session import scratch
from tarn.sources import files as S
from tarn.sources import pages as H


#: About how many orders a file of orders has.
FILE_ORDERS = 20_000


def place(t: Tables, name: str) -> str:
    """A new folder that all executors share; it goes when the session ends."""
    return f"{scratch(t.spark)}/{name}-{uuid.uuid4().hex}"


def as_csv(t: Tables, df: DataFrame, **options: str) -> str:
    path = place(t, "csv")
    df.write.options(header=True, quote='"', escape='"', quoteAll=True, emptyValue="", **options).csv(path)
    return path


@query("SELECT doc_id, text, lang FROM documents WHERE doc_id % 2 = 0 OR text IS NOT NULL")
def csv_records(t: Tables) -> DataFrame:
    """Documents as CSV with a header, quotes and line ends within fields, read back by a stated schema."""
    rows = S.records(t.spark, as_csv(t, t.documents.select("doc_id", "text", "lang")), "doc_id long, text string, lang string")
    return rows.where(f"{S.BAD} IS NULL").select("doc_id", "text", "lang")


@query("SELECT o_orderkey AS src, l_partkey AS dst, l_quantity AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def json_arrays(t: Tables) -> DataFrame:
    """Files that are each one array of records with nested edges; a file has the orders of a few customers, so files grow in number with the table."""
    files = max(8, -(-t.orders.count() // FILE_ORDERS))
    lines = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("quantity"))).alias("edges"))
    one = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.pmod(F.xxhash64("o_custkey"), F.lit(files)).alias("file"), F.to_json(F.struct(F.col("o_orderkey").alias("id"), "edges")).alias("x"))
    path = place(t, "json")
    lined = one.repartition(files, "file").sortWithinPartitions("file")
    lined.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("x"), ",\n"), F.lit("]")).alias("value")).write.partitionBy("file").text(path)
    rows = S.array_of(t.spark, f"{path}/*", "id long, edges array<struct<id:long,quantity:double>>")
    return S.nested_edges(rows, "id", "edges", "id", "quantity")


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part WHERE p_size > 10
""")
def xml_elements(t: Tables) -> DataFrame:
    """Elements of XML files with several ids, the primary one first, restricted to the ids that are asked for."""
    ids = F.array(F.struct((-F.col("p_partkey")).cast("string").alias("_VALUE"), F.lit(None).cast("string").alias("_primary")), F.struct(F.col("p_partkey").cast("string").alias("_VALUE"), F.lit("true").alias("_primary")))
    path = place(t, "xml")
    t.part.select(F.when(F.col("p_partkey") % 2 == 0, ids).otherwise(F.slice(F.reverse(ids), 1, 1)).alias("id"), F.col("p_name").alias("name")).write.format("xml").options(rowTag="item", rootTag="items").save(path)
    read = S.xml_records(t.spark, path, "item", "id array<struct<_VALUE:string,_primary:string>>, name string").select(S.primary_id(F.col("id")).alias("id"), "name")
    return S.only_wanted(read, "id", t.part.where("p_size > 10").select(F.col("p_partkey").cast("string")))


@query("""
SELECT p_name AS name, CAST(max(p_partkey) AS VARCHAR) AS id, 'é' || arg_max(p_brand, p_partkey) AS brand FROM part GROUP BY p_name
""")
def positional_dump(t: Tables) -> DataFrame:
    """A dump without a header in Latin-1, blank and short rows among others; of a repeated key the last row stands."""
    path = place(t, "dump")
    sorted_ = t.part.orderBy("p_partkey").select(F.concat(F.lit(" "), "p_name").alias("a"), F.col("p_partkey").cast("string").alias("b"), F.concat(F.lit("é"), "p_brand").alias("c"))
    odd = F.explode(F.array(F.concat_ws("\t", "a", "b", "c"), F.lit(" \t \t"), F.concat_ws("\t", "a", "b")))
    sorted_.coalesce(1).select(odd.alias("value")).write.option("header", False).option("encoding", "ISO-8859-1").option("quote", "").option("sep", "\x01").csv(path)
    return S.positional(t.spark, path, ["name", "id", "brand"], "name")


@query("""
SELECT DISTINCT 'P-' || p_partkey AS id, unnest(list_filter([trim(p_name), lower(p_type)], lambda x: x <> '')) AS substance FROM part
""")
def substance_edges(t: Tables) -> DataFrame:
    """Edges from a column of substances between semicolons, ids with a prefix, empty items left out."""
    listed = t.part.select(F.col("p_partkey").cast("string").alias("key"), F.concat(F.lit(" "), "p_name", F.lit(" ; ;"), F.lower("p_type"), F.lit(";"), "p_name").alias("list"))
    return S.substances_of(S.records(t.spark, as_csv(t, listed), "key string, list string"), "key", "list", "P-")


@query("""
SELECT CAST(l_partkey AS VARCHAR) AS src, CAST(l_suppkey AS VARCHAR) AS dst, CASE WHEN l_linenumber % 2 = 0 THEN 50 ELSE CAST(l_linenumber AS INTEGER) END AS risk FROM lineitem
""")
def interaction_records(t: Tables) -> DataFrame:
    """Pairs with a risk, 50 where the file has no integer."""
    risk = F.when(F.col("l_linenumber") % 2 == 0, "unknown").otherwise(F.concat(F.lit(" "), F.col("l_linenumber").cast("string")))
    rows = t.lineitem.select(F.col("l_partkey").cast("string").alias("a"), F.col("l_suppkey").cast("string").alias("b"), risk.alias("risk"))
    return S.interactions_of(S.records(t.spark, as_csv(t, rows), "a string, b string, risk string"), "a", "b", "risk")


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, left(repeat(p_type, 4), 20) AS atc_code, left(repeat(p_brand, 20), 100) AS therapeutic_class, 'R' AS source, 95 AS confidence_score FROM part
""")
def compound_records(t: Tables) -> DataFrame:
    """Compounds of a registry, codes and families cut."""
    rows = t.part.select(F.concat(F.lit(" "), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("name"), F.repeat("p_type", 4).alias("code"), F.repeat("p_brand", 20).alias("family"))
    return S.compounds(S.records(t.spark, as_csv(t, rows), "key string, name string, code string, family string"), "R", 95, "key", "name", "code", "family")


@query("""
WITH l AS (SELECT 'L' || p_partkey AS label, p_name AS g, p_brand AS b FROM part WHERE p_partkey % 7 = 0), d AS (SELECT p_partkey AS drug, p_name, p_type FROM part WHERE p_partkey % 11 = 0)
SELECT DISTINCT label, CAST(drug AS VARCHAR) AS drug FROM l JOIN d ON lower(g) IN (lower(p_name), lower(p_type)) OR lower(b) IN (lower(p_name), lower(p_type))
""")
def label_links(t: Tables) -> DataFrame:
    """Labels and the drugs that have their generic or brand name, in any case."""
    labels = t.part.where("p_partkey % 7 = 0").select(F.concat(F.lit("L"), "p_partkey").alias("spl_id"), F.upper("p_name").alias("generic_name"), F.col("p_brand").alias("brand_name"))
    drugs = t.part.where("p_partkey % 11 = 0").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.lit("").alias("generic_name"), F.col("p_type").alias("brand_name"))
    read = lambda df: S.records(t.spark, as_csv(t, df), ", ".join(f"{c} string" for c in df.columns))
    return S.label_edges(read(labels), read(drugs))


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, CASE WHEN p_size % 3 = 0 THEN 80 ELSE CAST(p_size AS INTEGER) END AS confidence_score, CASE WHEN p_size % 2 = 0 THEN p_type END AS form FROM part WHERE p_partkey % 5 <> 0
""")
def graph_files(t: Tables) -> DataFrame:
    """A node file of a graph by its load: texts trimmed, empty ones missing, failed casts by their default, rows without a key left out."""
    own = {"id": F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey").cast("string")), "title": F.concat(F.col("p_name"), F.lit("  ")), "confidence_score": F.when(F.col("p_size") % 3 == 0, "none").otherwise(F.col("p_size").cast("string")), "form": F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(" ")}
    load = S.LOADS["drugs"]
    folder = place(t, "graph")
    t.part.select(*[F.coalesce(own.get(c, F.lit("")), F.lit("")).alias(c) for c in load.columns.split()]).write.options(header=True, quoteAll=True).csv(f"{folder}/drugs.csv")
    return S.graph_tables(t.spark, folder, {"drugs": load})["drugs"].select("id", "title", "confidence_score", "form")


@query("""
WITH l AS (SELECT doc_id, i, trim(x) AS line FROM (SELECT doc_id, unnest(x) AS x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 4 = 2 THEN i || '. PART ' || upper(left(regexp_replace(x, '[^a-zA-Z]', '', 'g'), 1)) || 'X' ELSE x END) AS x FROM documents))),
s AS (SELECT *, regexp_matches(line, '^\\d+\\.\\s+[A-Z][A-Z\\s]+$|^\\d+\\.\\d+\\s+[A-Z][A-Z\\s]+$|^[A-Z][A-Z\\s]{2,}:$') AS h FROM l WHERE line <> ''),
n AS (SELECT *, sum(CAST(h AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM s)
SELECT doc_id, CAST(section AS BIGINT) AS section, arg_min(line, i) AS title, count(*) - 1 AS lines FROM n WHERE section > 0 GROUP BY doc_id, section
""")
def heading_slices(t: Tables) -> DataFrame:
    """Sections of extracted texts by lines that are headings."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when((i + 1) % 4 == 2, F.concat((i + 1).cast("string"), F.lit(". PART "), F.upper(F.left(F.regexp_replace(x, "[^a-zA-Z]", ""), F.lit(1))), F.lit("X"))).otherwise(x))
    found = H.heading_sections(t.documents.select("doc_id", F.array_join(lines, "\n").alias("text")), "doc_id", "text")
    return found.select("doc_id", "section", "title", F.size("lines").cast("long").alias("lines"))
