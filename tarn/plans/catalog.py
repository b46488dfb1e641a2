"""Queries over catalogues: filters, facets, counts, pages, set operations. Tables stand in for the roles of a catalogue: parts for
products, suppliers for makers, lineitems for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators import aggregates as A
from tarn.operators import filters as P
from tarn.operators import sets as S
from tarn.operators import windows as W
from tarn.plans.registry import Tables, query


@query("""
SELECT p_partkey, p_name, p_size FROM part
WHERE p_type = 'PROMO' AND (p_brand IS NULL OR p_brand <> 'Brand#2') AND p_size IN (1, 5, 9, 14, 23, 36, 45) AND p_name IS NOT NULL AND p_name <> ''
""")
def filter_project(t: Tables) -> DataFrame:
    """F01-F05, F13."""
    keep = P.every(F.col("p_type") == "PROMO", P.not_equal(F.col("p_brand"), "Brand#2"), F.col("p_size").isin(1, 5, 9, 14, 23, 36, 45), P.present(F.col("p_name")))
    return t.part.where(keep).select("p_partkey", "p_name", "p_size")


@query("""
SELECT p_partkey, len(list_filter(sizes, lambda x: x > 0)) AS n FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN [] ELSE [p_size] END AS sizes, p_retailprice FROM part)
WHERE len(sizes) > 0 AND p_retailprice >= 1000 AND p_retailprice < 1080
""")
def array_size_range(t: Tables) -> DataFrame:
    """Missing and empty arrays, comparisons."""
    sizes = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array("p_size"))
    rows = t.part.withColumn("sizes", sizes).where((F.size("sizes") > 0) & (F.col("p_retailprice") >= 1000) & (F.col("p_retailprice") < 1080))
    return rows.select("p_partkey", F.size(F.filter("sizes", lambda x: x > 0)).cast("long").alias("n"))


@query("""
SELECT p_partkey FROM (SELECT p_partkey, list_distinct([lower(p_type) || ';' || split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]) AS routes FROM part)
WHERE len(list_filter(routes, lambda v: list_contains(string_split(v, ';'), 'red'))) > 0
""")
def nested_token_filter(t: Tables) -> DataFrame:
    """a token of a list within an array."""
    words = F.split("p_name", " ")
    routes = F.array_distinct(F.array(F.concat_ws(";", F.lower("p_type"), words[0]), words[1]))
    return t.part.withColumn("routes", routes).where(P.any_has_token(F.col("routes"), "red")).select("p_partkey")


@query("""
SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'bolt') ORDER BY p_name, p_partkey LIMIT 6
""")
def autocomplete(t: Tables) -> DataFrame:
    """A literal in title or substance, six rows at most."""
    q = "bolt"
    return t.part.where(P.some(P.contains_literal(F.col("p_name"), q), P.contains_literal(F.col("p_brand"), q))).orderBy("p_name", "p_partkey").limit(6).select("p_partkey", "p_name")


@query("""
SELECT p_partkey, starts_with(p_name, 'red') AS starts, regexp_matches(p_name, '(?i)g[ei]') AS pattern FROM part WHERE regexp_matches(p_name, '(?i)^(red|hot) .*(ring|gear)$') AND length(p_name) > 2
""")
def regex_filter(t: Tables) -> DataFrame:
    """F09, F15, F20."""
    return t.part.where(P.matches(F.col("p_name"), "^(red|hot) .*(ring|gear)$") & (F.length("p_name") > 2)).select("p_partkey", F.col("p_name").startswith("red").alias("starts"), P.matches(F.col("p_name"), "g[ei]").alias("pattern"))


@query("""
SELECT * FROM (SELECT nullif(p_brand, 'Brand#7') AS brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, brand NULLS LAST LIMIT 10) WHERE brand IS NOT NULL
""")
def cut_then_drop(t: Tables) -> DataFrame:
    """missing keys count for the cut and go after it."""
    return A.top_counts(t.part.select(F.nullif(F.col("p_brand"), F.lit("Brand#7")).alias("brand")), "brand", 10)


BANDS = [(0.08, "critical"), (0.05, "high"), (0.02, "moderate")]


@query("""
SELECT CASE WHEN l_discount >= 0.08 THEN 'critical' WHEN l_discount >= 0.05 THEN 'high' WHEN l_discount >= 0.02 THEN 'moderate' ELSE 'low' END AS bucket,
       count(*) AS n, round(avg(l_discount), 4) AS mean, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY 1
""")
def bucket_case(t: Tables) -> DataFrame:
    """Levels by steps, with mean and sum."""
    return t.lineitem.groupBy(P.bucket(F.col("l_discount"), BANDS, "low").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 4).alias("mean"), F.round(F.sum("l_quantity"), 4).alias("total"))


@query("""
SELECT bucket, n, round(total / n, 2) AS mean, total, round(100.0 * n / sum(n) OVER (), 1) AS share FROM (
  SELECT CASE WHEN l_quantity >= 40 THEN '>=40' WHEN l_quantity >= 20 THEN '20-39' WHEN l_quantity >= 10 THEN '10-19' WHEN l_quantity >= 5 THEN '5-9' ELSE '<5' END AS bucket,
         count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY 1)
""")
def histogram_share(t: Tables) -> DataFrame:
    """Shares of buckets."""
    steps = [(40.0, ">=40"), (20.0, "20-39"), (10.0, "10-19"), (5.0, "5-9")]
    return A.share_histogram(t.lineitem, P.bucket(F.col("l_quantity"), steps, "<5"), "l_quantity")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 4")
def topk_group_count(t: Tables) -> DataFrame:
    """A01, A02, O01."""
    return A.top_counts(t.part, "p_type", 4)


@query("SELECT p_type, count(*) AS n, min(p_name) AS example FROM part WHERE p_size > 10 GROUP BY p_type")
def first_example(t: Tables) -> DataFrame:
    """A group's count and an example."""
    return t.part.where("p_size > 10").groupBy("p_type").agg(F.count("*").alias("n"), F.min("p_name").alias("example"))


@query("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1
""")
def pivot_state(t: Tables) -> DataFrame:
    """Type by state."""
    return A.pivot_counts(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT DISTINCT trim(x) AS value FROM (SELECT unnest(string_split(replace(p_name, ' ', ';') || '; ' || lower(p_type), ';')) AS x FROM part) WHERE trim(x) <> ''")
def explode_distinct(t: Tables) -> DataFrame:
    """Distinct items of lists within texts."""
    lists = F.array(F.concat(F.replace("p_name", F.lit(" "), F.lit(";")), F.lit("; "), F.lower("p_type")))
    return t.part.select(F.explode(X.routes(lists)).alias("value")).distinct()


@query("""
SELECT count(DISTINCT lower(trim(w))) AS words, count(DISTINCT nullif(p_size, 7)) + max(CASE WHEN p_size = 7 THEN 1 ELSE 0 END) AS sizes FROM (SELECT p_size, unnest(string_split(p_name, ' ')) AS w FROM part)
""")
def distinct_normalised(t: Tables) -> DataFrame:
    """Distinct values of arrays; a stored null counts as a value."""
    rows = t.part.select(F.explode(F.split("p_name", " ")).alias("w"), F.nullif(F.col("p_size"), F.lit(7)).alias("size"))
    return rows.agg(F.countDistinct(F.lower(F.trim("w"))).alias("words"), (F.countDistinct("size") + F.max(F.col("size").isNull().cast("int"))).cast("long").alias("sizes"))


@query("SELECT w AS value, count(*) AS n FROM (SELECT lower(trim(unnest(string_split(p_name, ' ')))) AS w FROM part) WHERE length(w) >= 4 GROUP BY w ORDER BY n DESC, w LIMIT 5")
def exploded_top(t: Tables) -> DataFrame:
    """Most frequent items of arrays."""
    return A.exploded_top(t.part, F.split("p_name", " "), 5, 4)


@query("""
SELECT letter, CASE letter WHEN 'E' THEN 'economy' WHEN 'S' THEN 'small or standard' ELSE 'other' END AS label, n, round(100.0 * n / sum(n) OVER (), 2) AS share
FROM (SELECT upper(left(trim(p_type), 1)) AS letter, count(*) AS n FROM part GROUP BY 1)
""")
def prefix_group(t: Tables) -> DataFrame:
    """A10: counts by first letter with labels."""
    out = t.part.groupBy(F.upper(F.left(F.trim("p_type"), F.lit(1))).alias("letter")).agg(F.count("*").alias("n"))
    label = F.coalesce(F.element_at(F.create_map(*map(F.lit, ["E", "economy", "S", "small or standard"])), F.col("letter")), F.lit("other"))
    return out.select("letter", label.alias("label"), "n", A.rate(F.col("n"), F.sum("n").over(W.Window.partitionBy()), 2).alias("share"))


@query("""
SELECT l_partkey, round(avg(l_extendedprice), 2) AS mean, round(max(l_extendedprice), 2) AS top, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS total
FROM lineitem GROUP BY l_partkey HAVING count(*) > 5 ORDER BY mean DESC, l_partkey LIMIT 3
""")
def having_top3(t: Tables) -> DataFrame:
    """Groups of more than five, the three with the highest mean."""
    g = t.lineitem.groupBy("l_partkey").agg(F.round(F.avg("l_extendedprice"), 2).alias("mean"), F.round(F.max("l_extendedprice"), 2).alias("top"), F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("total"))
    return g.where("n > 5").orderBy(F.desc("mean"), "l_partkey").limit(3)


@query("""
SELECT l_suppkey, count(*) AS n, round(avg(l_discount), 4) AS mean, list_sort(list(DISTINCT l_returnflag)) AS flags
FROM lineitem WHERE l_discount >= 0.08 GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 5
""")
def top5_with_names(t: Tables) -> DataFrame:
    """The most frequent of a level, with collected names."""
    g = t.lineitem.where("l_discount >= 0.08").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 4).alias("mean"), F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    return g.orderBy(F.desc("n"), "l_suppkey").limit(5)


@query("""
SELECT 'report' AS source, count(*) AS n, count(DISTINCT l_discount) AS levels, min(l_quantity) AS least, max(l_quantity) AS most, round(avg(l_quantity), 4) AS mean FROM lineitem
""")
def global_stats(t: Tables) -> DataFrame:
    """One row over all relations."""
    return t.lineitem.agg(F.lit("report").alias("source"), F.count("*").alias("n"), F.countDistinct("l_discount").alias("levels"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.round(F.avg("l_quantity"), 4).alias("mean"))


@query("""
SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'nothing', count(*) FROM part WHERE p_size < 0
""")
def census(t: Tables) -> DataFrame:
    """Independent counts."""
    return A.census({"customer": t.customer, "part": t.part, "supplier": t.supplier, "nothing": t.part.where("p_size < 0")})


@query("""
SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS year, count(DISTINCT o_custkey) AS customers, CAST(sum(CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END) AS BIGINT) AS large, min(o_orderkey) AS first
FROM orders GROUP BY 1, 2, 3
""")
def cond_sum(t: Tables) -> DataFrame:
    """Several keys, distinct and conditional counts."""
    return t.orders.groupBy("o_orderstatus", "o_orderpriority", F.year("o_orderdate").cast("long").alias("year")).agg(F.countDistinct("o_custkey").alias("customers"), F.sum(F.when(F.col("o_totalprice") > 250000, 1).otherwise(0)).alias("large"), F.min("o_orderkey").alias("first"))


@query("SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_pairs(t: Tables) -> DataFrame:
    """Pairs that are stored more than once, in either direction."""
    return A.repeated(t.lineitem.select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")), ["a", "b"])


@query("""
SELECT p_brand, min(p_size) AS rank, arg_min(p_name, (p_size, p_name)) AS level, list_sort(list(DISTINCT p_type)) AS agencies FROM part GROUP BY p_brand
""")
def min_rank_union(t: Tables) -> DataFrame:
    """Least rank, the level at it, and the union of names."""
    return t.part.groupBy("p_brand").agg(F.min("p_size").alias("rank"), F.min_by("p_name", F.struct("p_size", "p_name")).alias("level"), F.array_sort(F.collect_set("p_type")).alias("agencies"))


@query("""
SELECT p_name, n, rank, round(sum(n) OVER (ORDER BY rank) / sum(n) OVER (), 6) AS covered FROM (SELECT p_name, n, CAST(row_number() OVER (ORDER BY n DESC, p_name) AS INTEGER) AS rank FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name))
""")
def cumulative_coverage(t: Tables) -> DataFrame:
    """What the most frequent patterns cover."""
    return A.coverage(t.part, "p_name")


@query("""
SELECT DISTINCT facet, value FROM (SELECT 'brand' AS facet, p_brand AS value FROM part UNION ALL SELECT 'size', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT 'type', p_type FROM part UNION ALL SELECT 'word', split_part(p_name, ' ', 2) FROM part)
WHERE value <> ''
""")
def facets(t: Tables) -> DataFrame:
    """The option lists of a search form, in one scan."""
    return A.facets(t.part, {"brand": F.col("p_brand"), "size": F.col("p_size"), "type": F.col("p_type"), "word": F.split("p_name", " ")[1]})


@query("""
SELECT count(*) AS n, count(*) FILTER (p_name IS NULL) AS missing_p_name, count(*) FILTER (p_size IS NULL) AS missing_p_size, count(*) FILTER (p_brand = '') AS empty_p_brand,
       count(p_partkey) - count(DISTINCT p_partkey) AS repeated, count(*) FILTER (p_name IS NULL OR p_size IS NULL OR p_brand = '') + count(p_partkey) - count(DISTINCT p_partkey) = 0 AS sound FROM part
""")
def quality_audit(t: Tables) -> DataFrame:
    """Missing, empty and repeated values in one pass."""
    return A.audit(t.part, ["p_name", "p_size"], ["p_brand"], "p_partkey")


@query("""
SELECT band, count(*) AS n, round(100.0 * count(*) FILTER (quality = 1) / nullif(count(*), 0), 1) AS rate FROM (SELECT CAST(floor((doc_id % 100) / 10) * 10 AS INTEGER) AS band, quality FROM labels) GROUP BY band
""")
def score_bands(t: Tables) -> DataFrame:
    """Counts and guarded rates by band."""
    rows = t.labels.select((F.floor((F.col("doc_id") % 100) / 10) * 10).cast("int").alias("band"), "quality")
    return rows.groupBy("band").agg(F.count("*").alias("n"), A.rate(F.count_if(F.col("quality") == 1), F.count("*")).alias("rate"))


@query("""
SELECT value, count(*) AS n FROM (SELECT p_name AS value FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT p_brand FROM part) GROUP BY value
""")
def unpivot_bearers(t: Tables) -> DataFrame:
    """Distinct texts over several columns and how many rows bear them."""
    return t.part.select(F.explode(F.array("p_name", "p_type", "p_brand")).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


@query("""
SELECT name, arg_min(p_partkey, (kind, p_partkey)) AS id FROM (SELECT p_name AS name, 0 AS kind, p_partkey FROM part UNION ALL SELECT split_part(p_name, ' ', 2), 1, p_partkey FROM part) GROUP BY name
""")
def first_wins(t: Tables) -> DataFrame:
    """A dictionary in which names beat synonyms and earlier records later ones."""
    names = t.part.select(F.col("p_name").alias("name"), F.lit(0).alias("kind"), "p_partkey").union(t.part.select(F.split("p_name", " ")[1], F.lit(1), "p_partkey"))
    return names.groupBy("name").agg(F.min_by("p_partkey", F.struct("kind", "p_partkey")).alias("id"))


PAGE = "SELECT p_partkey, p_name FROM part WHERE p_type = 'SMALL' ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40"


@query(f"""
SELECT r.*, total, CAST(ceil(total / 20.0) AS BIGINT) AS pages, total > 60 AS has_more FROM ({PAGE}) r, (SELECT count(*) AS total FROM part WHERE p_type = 'SMALL')
""")
def paged_search(t: Tables) -> DataFrame:
    """A page with totals."""
    return S.page(t.part.where("p_type = 'SMALL'").select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")], 3, 20)


@query("""
SELECT o_orderkey, text_date, year * 10000 + month * 100 + day AS key FROM (
  SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS text_date, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day FROM orders)
ORDER BY key DESC, o_orderkey LIMIT 25
""")
def french_date_sort(t: Tables) -> DataFrame:
    """Dates written dd/mm/yyyy sorted by their key, the whole result and then the page."""
    rows = t.orders.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("text_date"))
    return rows.withColumn("key", X.date_key(F.col("text_date"))).orderBy(F.desc("key"), "o_orderkey").limit(25)


@query("SELECT o_orderkey, key FROM (SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS key FROM orders ORDER BY o_orderkey LIMIT 12 OFFSET 12) ORDER BY key DESC, o_orderkey")
def page_then_sort(t: Tables) -> DataFrame:
    """The page is cut first and then sorted."""
    rows = t.orders.select("o_orderkey", X.date_key(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("key"))
    return S.page_then_sort(rows, [F.col("o_orderkey")], 2, 12, [F.desc("key"), F.col("o_orderkey")])


@query("SELECT p_partkey, p_name, list_position([17, 3, 99, 42, 7], p_partkey) AS place FROM part WHERE p_partkey IN (17, 3, 99, 42, 7)")
def order_of_ids(t: Tables) -> DataFrame:
    """Rows in the order of an index's ids."""
    out = S.in_order_of(t.part.select("p_partkey", "p_name"), "p_partkey", [17, 3, 99, 42, 7])
    return out.withColumn("place", F.col("place").cast("int"))


@query("""
SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY (p_type = 'PROMO') DESC, p_size, length(p_name), p_partkey) AS k FROM part) WHERE k = 1
""")
def representative(t: Tables) -> DataFrame:
    """The representative of a group by four criteria."""
    return W.keep_best(t.part, ["p_brand"], (F.col("p_type") == "PROMO").desc(), F.col("p_size"), F.length("p_name"), F.col("p_partkey")).select("p_brand", "p_partkey", "p_name")


@query("""
SELECT key, arg_min(origin, part) AS origin FROM (SELECT p_partkey AS key, 'official' AS origin, 0 AS part FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'local', 1 FROM part WHERE p_partkey % 2 = 0) GROUP BY key
""")
def union_priority(t: Tables) -> DataFrame:
    """A union in which the first table wins."""
    a = t.part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("key"), F.lit("official").alias("origin"))
    b = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), F.lit("local").alias("origin"))
    return S.union_first([a, b], "key")


@query("""
SELECT p_partkey AS key, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 THEN 'both' WHEN p_partkey % 7 <> 0 THEN 'created' ELSE 'orphan' END AS side FROM part WHERE p_partkey % 7 <> 0 OR p_partkey % 5 <> 0
""")
def diff_sets(t: Tables) -> DataFrame:
    """Differences both ways and the intersection."""
    a, b = t.part.where("p_partkey % 7 != 0").select(F.col("p_partkey").alias("key")), t.part.where("p_partkey % 5 != 0").select(F.col("p_partkey").alias("key"))
    side = lambda df, name: df.select("key", F.lit(name).alias("side"))
    return side(a.join(b, "key", "left_semi"), "both").union(side(a.join(b, "key", "left_anti"), "created")).union(side(b.join(a, "key", "left_anti"), "orphan"))


@query("""
SELECT c_custkey AS key, max(score) AS score FROM (SELECT c_custkey, round(c_acctbal / 100, 2) AS score FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, CAST(c_nationkey AS DOUBLE) FROM customer WHERE c_acctbal > 0) GROUP BY c_custkey
""")
def union_best(t: Tables) -> DataFrame:
    """The best score of several variants."""
    a = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"), F.round(F.col("c_acctbal") / 100, 2).alias("score"))
    b = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("double").alias("score"))
    return S.union_best([a, b], "key", "score")


def first_kinds(lines: DataFrame, part: DataFrame) -> DataFrame:
    """(l_orderkey, kinds): the first three distinct kinds of each order, by line."""
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_type"))), lambda x: x["p_type"])
    return rows.groupBy("l_orderkey").agg(F.slice(F.array_distinct(kinds), 1, 3).alias("kinds"))


@query("""
SELECT l_orderkey, list_slice(list(p_type ORDER BY l_linenumber, l_partkey), 1, 3) AS kinds FROM (SELECT l_orderkey, l_linenumber, l_partkey, p_type,
  row_number() OVER (PARTITION BY l_orderkey, p_type ORDER BY l_linenumber, l_partkey) AS k FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE k = 1 GROUP BY l_orderkey
""")
def array_union_capped(t: Tables) -> DataFrame:
    """A union of arrays that keeps first places, cut at three."""
    return first_kinds(t.lineitem, t.part)


@query("""
SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k <= 3
""")
def retain_last3(t: Tables) -> DataFrame:
    """The last three versions of a key."""
    return W.latest(t.orders, ["o_custkey"], "o_orderdate", 3, F.asc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderdate")


@query("""
SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM events GROUP BY user_id
""")
def keep_best(t: Tables) -> DataFrame:
    """The best row of each key, the first on ties."""
    return W.keep_best(t.events, ["user_id"], F.desc("value"), F.asc("event_id")).select("user_id", "event_id", "value")


@query("""
SELECT doc_id, line, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), chars) AS "end" FROM (
  SELECT doc_id, chars, line, CAST(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(x) AS INTEGER) AS start FROM (
    SELECT doc_id, CAST(length(text) + 1 AS INTEGER) AS chars, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents))
""")
def lead_landmarks(t: Tables) -> DataFrame:
    """Landmarks of a text end where the next one begins. Positions come from running sums over the lines of a text."""
    lines = t.documents.select("doc_id", (F.length("text") + 1).alias("chars"), F.posexplode(F.split("text", "\n")).alias("line", "x"))
    w = W.Window.partitionBy("doc_id").orderBy("line")
    at = lines.withColumn("start", (F.sum(F.length("x") + 1).over(w) - F.length("x")).cast("int"))
    return W.landmark_ends(at, "doc_id", "start", F.col("chars")).select("doc_id", F.col("line").cast("long").alias("line"), "start", "end")


@query("""
SELECT conv_id, min(turn) + 1 AS first_turn, greatest(0, 25 - 15 * min(turn)) AS points FROM conversations WHERE role = 'assistant' GROUP BY conv_id
""")
def rank_decay(t: Tables) -> DataFrame:
    """The ordinal of the first match and points that fall with it."""
    turns = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    first = F.filter("r", lambda x: x["role"] == "assistant")[0]["turn"]
    return turns.where(F.exists("r", lambda x: x["role"] == "assistant")).select("conv_id", (first + 1).alias("first_turn"), F.greatest(F.lit(0).cast("long"), 25 - 15 * first).alias("points"))


@query()
def rate_window(t: Tables) -> DataFrame:
    """Two events of a user within three hours at most; rejected ones don't count."""
    return W.limited(t.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", 2, 3 * 3600, "event_id")


@query()
def quota_classes(t: Tables) -> DataFrame:
    """Greedy quota over several classes, one row a signature."""
    rows = t.part.select(F.col("p_brand").alias("list"), "p_partkey", F.when(F.col("p_size") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("p_type", F.split("p_name", " ")[0])).alias("classes"), F.col("p_name").alias("signature"), (-F.col("p_size")).alias("merit"))
    return W.quota(rows, ["list"], "classes", "signature", ["merit", "p_partkey"], 2)


@query("""
SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size, p_partkey) AS k FROM part) WHERE k <= 2
""")
def quota_single_class(t: Tables) -> DataFrame:
    """W02, W04 with one class a row: a window."""
    return W.keep_best(t.part, ["p_brand", "p_type"], F.col("p_size"), F.col("p_partkey"), k=2).select("p_brand", "p_partkey")
