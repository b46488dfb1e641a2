"""Queries over records as a whole: lists, projections, keys of content, look-ups with a last resort, translated records, texts that stand for a record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators import audit as A
from tarn.operators import filters as P
from tarn.operators.windows import keep_best
from tarn.plans import sync as Y
from tarn.plans.audits import RAW_SQL, raw_parts
from tarn.plans.registry import Tables, query
from tarn.plans.sections import SECTIONS_SQL, sections
from tarn.sources import pages as H


@query("""
SELECT doc_id, list_sum(list_transform(x, lambda s: length(s))) AS total, list_transform(list_filter(x, lambda s: length(s) > 20), lambda s: left(s, 3) || '.') AS heads, x[1] AS first, x[len(x)] AS last, x[2:4] AS some,
  list_reduce(list_transform(x, lambda s: length(s)), lambda a, b: greatest(a, b)) AS longest, len(list_filter(x, lambda s: contains(s, 'the'))) > 0 AS any_the, len(list_filter(x, lambda s: s = '')) = 0 AS none_empty
FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)
""")
def list_expressions(t: Tables) -> DataFrame:
    """Reduce, comprehension with a condition, first, last, slice, any and none over the lines of a text."""
    x, size = F.col("x"), lambda s: F.length(s)
    rows = t.documents.where("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("x"))
    return rows.select(
        "doc_id", F.aggregate(x, F.lit(0).cast("long"), lambda a, s: a + F.length(s)).alias("total"), F.transform(F.filter(x, lambda s: size(s) > 20), lambda s: F.concat(F.left(s, F.lit(3)), F.lit("."))).alias("heads"), x[0].alias("first"), F.element_at(x, -1).alias("last"), F.slice(x, 2, 3).alias("some"),
        F.aggregate(x, F.lit(0).cast("long"), lambda a, s: F.greatest(a, F.length(s).cast("long"))).alias("longest"), F.exists(x, lambda s: F.contains(s, F.lit("the"))).alias("any_the"), F.forall(x, lambda s: s != "").alias("none_empty"),
    )


@query("""
SELECT p.*, coalesce(m.makers, []) AS makers, coalesce(m.n, 0) AS orders FROM part p LEFT JOIN (SELECT l_partkey, list_slice(list_sort(list(DISTINCT l_suppkey)), 1, 5) AS makers, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) m ON l_partkey = p_partkey
""")
def map_projection(t: Tables) -> DataFrame:
    """A record with all its fields, and more of its own: the makers and the number of its orders."""
    more = t.lineitem.groupBy("l_partkey").agg(F.slice(F.array_sort(F.collect_set("l_suppkey")), 1, 5).alias("makers"), F.countDistinct("l_orderkey").alias("n"))
    rows = t.part.alias("d").join(more, F.col("d.p_partkey") == F.col("l_partkey"), "left")
    projected = F.struct("d.*", F.coalesce("makers", F.array().cast("array<long>")).alias("makers"), F.coalesce("n", F.lit(0)).cast("long").alias("orders"))
    return rows.select(projected.alias("p")).select("p.*")


@query("""
SELECT key, count(*) AS n, min(p_partkey) AS first FROM (SELECT p_partkey, CAST(to_json({'brand': p_brand, 'details': {'half': p_size // 2, 'kind': p_type}, 'name': split_part(p_name, ' ', 1)}) AS VARCHAR) AS key FROM part) GROUP BY key
""")
def content_keys(t: Tables) -> DataFrame:
    """Records are the same if their JSON with sorted keys is."""
    kept = F.struct(F.split("p_name", " ")[0].alias("name"), F.struct(F.col("p_type").alias("kind"), F.floor(F.col("p_size") / 2).alias("half")).alias("details"), F.col("p_brand").alias("brand"))
    rows = t.part.select("p_partkey", kept.alias("v"))
    return rows.select("p_partkey", F.to_json(Y.sorted_fields(F.col("v"), rows.schema["v"].dataType)).alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("""
WITH s AS (SELECT p_partkey, p_name, p_size, split_part(p_name, ' ', 1) AS word FROM part JOIN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1) ON l_partkey = p_partkey),
f AS (SELECT DISTINCT word AS form, 0 AS rank FROM s UNION SELECT DISTINCT left(p_name, 2), 1 FROM part)
SELECT a.p_partkey, x.p_partkey AS found FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS w FROM part) a LEFT JOIN (
  SELECT * FROM (SELECT w, p_partkey, row_number() OVER (PARTITION BY w ORDER BY rank, length(p_name), p_name, p_partkey) AS k FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part) JOIN (VALUES (0), (1)) r(rank) ON true
    JOIN s ON starts_with(p_name, CASE WHEN rank = 0 THEN w ELSE left(w, 2) END)) WHERE k = 1) x ON x.w = a.w
""")
def single_substance_fallback(t: Tables) -> DataFrame:
    """A name's written forms by rank against titles that begin with them, only of products with exactly one substance (here: one maker), the shortest title first."""
    single = t.lineitem.groupBy("l_partkey").agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b")).where("a = b").select("l_partkey")
    products = t.part.join(single, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select(F.col("p_partkey").alias("found"), F.col("p_name").alias("title"))
    word = F.split("p_name", " ")[0]
    forms = t.part.select(word.alias("w")).distinct().select("w", F.posexplode(F.array("w", F.left("w", F.lit(2)))).alias("rank", "form"))
    starts = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("title"), F.lit(12))), lambda n: F.left("title", n)))
    met = forms.join(products.withColumn("key", starts), F.left("form", F.lit(12)) == F.col("key")).where(F.startswith("title", "form"))
    best = keep_best(met, ["w"], F.col("rank"), F.length("title"), F.col("title"), F.col("found")).select("w", "found")
    return t.part.select("p_partkey", word.alias("w")).join(best, "w", "left").select("p_partkey", "found")


PHRASES = [("red gear", "major"), ("ring small", "moderate"), ("bolt", "minor"), ("blue old widget", "major")]


@query(f"""
SELECT p_partkey, CASE WHEN exact IS NOT NULL THEN exact ELSE loose END AS level, CASE WHEN exact IS NOT NULL THEN 'phrase' WHEN loose IS NOT NULL THEN 'words' END AS how FROM (SELECT p_partkey,
  CASE {" ".join(f"WHEN contains(x, '{p}') THEN '{v}'" for p, v in PHRASES)} END AS exact, CASE {" ".join(f"WHEN {' AND '.join(f'''contains(x, '{w}')''' for w in p.split())} THEN '{v}'" for p, v in PHRASES)} END AS loose FROM (SELECT p_partkey, lower(p_type) || ' ' || p_name || ' ' || p_name AS x FROM part))
""")
def rule_words(t: Tables) -> DataFrame:
    """The first rule whose phrase a name contains; only where none does, the first all of whose words it contains."""
    rows = t.part.select("p_partkey", F.concat_ws(" ", F.lower("p_type"), "p_name", "p_name").alias("x"))
    level, how = P.phrase_or_words(F.col("x"), PHRASES)
    return rows.select("p_partkey", level.alias("level"), how.alias("how"))


@query(f"""
SELECT DISTINCT j.atom ->> '$' AS text FROM ({RAW_SQL}) r, json_tree(r.raw) j WHERE json_valid(r.raw) AND j.type = 'VARCHAR' AND NOT regexp_matches(j.fullkey, '\\.(brand|deep)([.\\[]|$)') AND j.atom ->> '$' <> ''
""")
def record_strings(t: Tables) -> DataFrame:
    """The distinct strings of nested records, at any depth, without those under certain keys."""
    return A.strings_of(raw_parts(t), "raw", ["brand", "deep"])


@query("""
WITH o AS (SELECT p_partkey AS id, 'u' || p_partkey AS url, p_name FROM part WHERE p_partkey % 3 <> 0), tr AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS original_id, 'u' || p_partkey AS url, upper(p_name) AS title, p_partkey FROM part WHERE p_partkey % 5 <> 0)
SELECT 'u' || k AS url, x.id AS original_id, coalesce(tr.title, x.p_name) AS title, CASE WHEN x.id IS NULL THEN 'unlinked' WHEN tr.title IS NULL THEN 'created' ELSE 'fetched' END AS state
FROM (SELECT p_partkey AS k FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 5 <> 0) LEFT JOIN o x ON x.id = k LEFT JOIN tr ON tr.p_partkey = k
""")
def translated_records(t: Tables) -> DataFrame:
    """Each record with its translation, fetched by the id of the original or else by its address, created where there is none; translations whose original is gone stay unlinked."""
    key = F.col("p_partkey")
    url = F.concat(F.lit("u"), key.cast("string"))
    originals = t.part.where(key % 3 != 0).select(key.alias("id"), url.alias("url"), F.col("p_name").alias("title"))
    stored = t.part.where(key % 5 != 0).select(F.when(key % 2 == 0, key).alias("original_id"), url.alias("url"), F.upper("p_name").alias("title"))
    return Y.linked(originals, stored)


GROUPS = {"indications": ["that", "ción"], "dosage": ["schen"], "against": ["eau"], "effects": ["then", "era"], "warnings": ["ue", "wh"]}
_GROUP_SQL = ", ".join(f"string_agg(CASE WHEN section > 0 AND ({' OR '.join(f'''contains(lower(title), '{w}')''' for w in words)}) THEN nullif(list_aggregate(list_transform(blocks, lambda b: b.text), 'string_agg', ' '), '') END, ' ' ORDER BY section) AS {g}" for g, words in GROUPS.items())


@query(f"""{SECTIONS_SQL}, g AS (SELECT page_id, {_GROUP_SQL} FROM tree GROUP BY page_id),
bare AS (SELECT page_id, url, html, regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g') AS bare FROM pages)
SELECT page_id, concat_ws(' | ', title, title, lang, host, doses, indications, dosage, against, effects, warnings) AS text FROM (SELECT page_id, nullif(coalesce(nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>([^<]+)</h1>', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<title[^>]*>([^<]+)</title>', 1)), '')), '') AS title,
  nullif(regexp_extract(html, 'lang="(\\w+)"', 1), '') AS lang, nullif(regexp_extract(url, '//([^/?#]*)', 1), '') AS host, nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(bare, '\\b(\\d+(?:[.,]\\d+)?\\s?(?:mg|g|µg|ml|UI)(?:/\\w+)?)\\b', 1))), ' '), '') AS doses, g.* EXCLUDE (page_id) FROM bare LEFT JOIN g USING (page_id))
""")
def page_embedding_text(t: Tables) -> DataFrame:
    """The text that stands for a page: its title twice, language, host, doses, and five groups of sections by keywords, without empty parts."""
    own, facts = sections(t), H.page_facts(F.col("html"))
    rows = t.pages.select("page_id", facts["title"].alias("title"), H.first_of(F.col("html"), r'lang="(\w+)"').alias("lang"), H.first_of(F.col("url"), "//([^/?#]*)").alias("host"), F.array_join(F.sort_array(facts["dosages"]), " ").alias("doses"))
    texts = H.keyword_groups(own, "page_id", GROUPS)
    out = rows.join(texts, "page_id", "left")
    return out.select("page_id", F.concat_ws(" | ", *[F.nullif(F.col(c), F.lit("")) for c in ("title", "title", "lang", "host", "doses", *GROUPS)]).alias("text"))
