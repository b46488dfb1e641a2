"""Queries over texts: scalar functions, search and ranking, entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import fuzzy as Z
from tarn.functions import text as X
from tarn.operators import containment as B
from tarn.operators import elastic as L
from tarn.operators import filters as P
from tarn.operators import resolve as E
from tarn.operators import search as V
from tarn.operators.windows import keep_best
from tarn.plans.registry import Tables, query

#: Folding in DuckDB is strip_accents, which is equal on the letters of the tables.
FOLD = "lower(strip_accents({}))"


@query()
def text_keys(t: Tables) -> DataFrame:
    """Folded text, key and slug. DuckDB folds some letters otherwise, so a test holds this against brute force."""
    return t.documents.select("doc_id", X.fold(F.col("text")).alias("folded"), X.squash_key(F.col("text")).alias("key"), X.slug(F.col("text")).alias("slug"))


@query("""
SELECT o_orderkey, [o_orderpriority, trim(lower(o_orderstatus)) || ' ' || CAST(o_orderkey % 7 AS VARCHAR) || ',5 mg', 'order ' || o_orderkey] AS items, substr(lower(o_orderpriority), 3) AS name,
       CASE WHEN contains(p, ' ') THEN [p, split_part(p, ' ', 1)] ELSE [p] END AS prefixes, CAST(o_custkey AS VARCHAR) AS spec
FROM (SELECT *, trim(lower(regexp_replace(o_orderpriority, '[^A-Za-z]+', ' ', 'g'))) AS p FROM orders)
""")
def treatment_parsing(t: Tables) -> DataFrame:
    """Items of a free text with decimals, names without doses, leading words, ids in links."""
    dose = F.concat(F.lower("o_orderstatus"), F.lit(" "), (F.col("o_orderkey") % 7).cast("string"), F.lit(",5 mg"))
    rows = t.orders.select("o_orderkey", F.concat("o_orderpriority", F.lit("; "), dose, F.lit(", order "), "o_orderkey", F.lit(" .")).alias("text"),
                           F.concat("o_orderpriority", F.lit(" "), F.lit("("), "o_orderkey", F.lit(") 2,5 mg/"), F.lower("o_orderstatus")).alias("named"),
                           F.trim(F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]+", " "))).alias("words"), F.concat(F.lit("https://x.example/?a=1&specid="), "o_custkey", F.lit("#t")).alias("link"))
    return rows.select("o_orderkey", X.split_items(F.col("text")).alias("items"), X.strip_dose(F.col("named")).alias("name"), X.word_prefixes(F.col("words")).alias("prefixes"), X.id_in(F.col("link")).alias("spec"))


@query("""
SELECT p_partkey, CASE WHEN length(code) = 7 THEN [substr(code, 1, 1), substr(code, 1, 3), substr(code, 1, 4), substr(code, 1, 5), code] ELSE [] END AS levels, [ 'DB' || p_partkey, 'DB' || p_size] AS ids,
       p_size / 2.0 AS comma, CASE WHEN p_size % 3 = 0 THEN 80 ELSE p_size END AS fallback, CAST(p_size AS BIGINT) AS counted, p_size % 2 = 0 AS truth
FROM (SELECT *, upper(left(p_type, 1)) || lpad(CAST(p_size AS VARCHAR), 2, '0') || upper(substr(p_name, 1, 2)) || CASE WHEN p_size % 5 = 0 THEN '' ELSE lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') END AS code FROM part)
""")
def code_parsing(t: Tables) -> DataFrame:
    """C11, C12 and the typed defaults: code levels, ids, decimal commas, integers with defaults, counts written as floats, truth words."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    size = F.col("p_size")
    rows = t.part.select("p_partkey", "p_size", F.concat(F.upper(F.left("p_type", F.lit(1))), two(size), F.upper(F.substring("p_name", 1, 2)), F.when(size % 5 == 0, "").otherwise(two(F.col("p_partkey") % 100))).alias("code"),
                         F.concat(F.lit("DrugBank:DB"), "p_partkey", F.lit(", other:1, DrugBank:DB"), "p_size").alias("xrefs"), F.when(size % 3 != 0, size.cast("string")).alias("maybe"))
    return rows.select("p_partkey", X.code_levels(F.col("code")).alias("levels"), X.ids_in(F.col("xrefs")).alias("ids"), X.number(F.replace((F.col("p_size") / 2).cast("string"), F.lit("."), F.lit(","))).alias("comma"),
                       X.int_or(F.col("maybe"), 80).alias("fallback"), X.count_of(F.concat(F.col("p_size").cast("string"), F.lit(".0"))).alias("counted"), X.truth(F.when(F.col("p_size") % 2 == 0, "Oui").otherwise("Non")).alias("truth"))


@query("""
SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'promotion' WHEN 'SMALL' THEN 'petit' ELSE p_type END AS word, split_part(p_name, ' ', 1) || ', ' || lower(p_type) AS routes,
       replace(p_name, split_part(p_name, ' ', 1), '{X}') AS pattern, md5(p_name) AS hash, CAST(('0x' || substr(sha256(p_name), 1, 16))::UHUGEINT % 9223372036854775808::UHUGEINT AS BIGINT) AS id FROM part
""")
def vocabulary_routes(t: Tables) -> DataFrame:
    """Vocabulary, list reformatting, masked names, content hashes and 63-bit ids."""
    first = F.split("p_name", " ")[0]
    return t.part.select("p_partkey", X.vocabulary(F.col("p_type"), {"PROMO": "promotion", "SMALL": "petit"}).alias("word"), F.array_join(X.routes(F.array(F.concat(first, F.lit("; "), F.lower("p_type")))), ", ").alias("routes"),
                         F.replace("p_name", first, F.lit("{X}")).alias("pattern"), F.md5("p_name").alias("hash"), X.stable_id(F.col("p_name")).alias("id"))


@query("""
SELECT doc_id, n, [x[1]] AS parts, len(x) AS lines FROM (SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n, string_split(text, chr(10)) AS x FROM documents)
""")
def list_functions(t: Tables) -> DataFrame:
    """Size, head, slice; occurrences that don't overlap."""
    lines = F.split("text", "\n")
    return t.documents.select("doc_id", X.occurrences(F.col("text"), "the").alias("n"), F.slice(lines, 1, 1).alias("parts"), F.size(lines).cast("long").alias("lines"))


@query("""
SELECT item_id, regexp_matches(lower(strip_accents(text)), '\\bthes?\\b') AS cited, len(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[,;.\\n]+'), lambda s: regexp_matches(s, '\\bth') AND regexp_matches(s, '\\ber'))) > 0 AS together FROM benchmark
""")
def cited_terms(t: Tables) -> DataFrame:
    """Whole words, and words of one clause."""
    return t.benchmark.select("item_id", P.cites(F.col("text"), "the").alias("cited"), P.in_one_segment(F.col("text"), "th er").alias("together"))


@query()
def negated_terms(t: Tables) -> DataFrame:
    """a term that no negator shortly before it in its clause denies."""
    return t.documents.select("doc_id", Z.affirmed("the", ["of", "le"])("text").alias("affirmed"))


_Q = [round(0.125 * (1 if i % 3 else -1), 3) for i in range(64)]


@query(f"""
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}::DOUBLE[]), 9) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 40
""")
def vector_topk(t: Tables) -> DataFrame:
    """Exact cosine search."""
    return V.vector_topk(t.embeddings, "vec_id", "embedding", _Q, 40).withColumn("score", F.round("score", 9))


@query(f"""
SELECT vec_id, round(0.4 * v + 0.6 * least(label * 20 / 100.0, 1.0), 9) AS score FROM (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}::DOUBLE[]) AS v FROM embeddings)
WHERE v >= 0.05 AND 0.4 * v + 0.6 * least(label * 20 / 100.0, 1.0) >= 0.15
""")
def hybrid_rank(t: Tables) -> DataFrame:
    """A vector score above a floor mixed with a text score."""
    return hybrid_hits(t)


def hybrid_hits(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", "label", V.cosine(F.col("embedding"), _Q).alias("v")).where("v >= 0.05")
    score = V.hybrid(F.col("v"), F.col("label") * 20)
    return rows.where(score >= 0.15).select("vec_id", F.round(score, 9).alias("score"))


@query("""
WITH k AS (SELECT p_partkey, w, count(*) * 10.0 AS weight FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part) GROUP BY ALL UNION ALL SELECT p_partkey, lower(p_type), 5.0 FROM part),
i AS (SELECT p_partkey, w, sum(weight) AS weight FROM k WHERE length(w) >= 3 GROUP BY ALL)
SELECT p_partkey, round(sum(sqrt(weight)), 6) AS score, count(*) AS found FROM i WHERE w IN ('red', 'promo', 'gear') GROUP BY p_partkey ORDER BY score DESC, found DESC, p_partkey LIMIT 30
""")
def token_search(t: Tables) -> DataFrame:
    """A weighted token index."""
    return V.token_search(V.tokens(t.part, "p_partkey", {"p_name": 10, "p_type": 5}), "p_partkey", ["red", "promo", "gear"], 30)


@query("""
SELECT p_partkey, CASE WHEN p_name = 'red ring' THEN 100.0 WHEN contains(p_name, 'red ring') THEN 50.0 ELSE 0.0 END + 15.0 * CASE WHEN contains(lower(p_type), 'red ring') THEN 1 ELSE 0 END + 3.0 * least(CAST((length(p_name) - length(replace(p_name, 'red ring', ''))) / 8 AS BIGINT), 10) AS score
FROM part WHERE score > 0
""")
def field_relevance(t: Tables) -> DataFrame:
    """Relevance weighted by field."""
    score = V.relevance(F.col("p_name"), {"type": (F.col("p_type"), 15.0), "name": (F.col("p_name"), 3.0)}, "red ring")
    return t.part.select("p_partkey", score.alias("score")).where("score > 0")


@query("""
SELECT doc_id, priority, location, CAST((length(text) - length(replace(lower(text), 'en', ''))) / 2 AS BIGINT) AS n, substr(text, greatest(instr(lower(text), 'en') - 20, 1), 60) AS excerpt
FROM (SELECT doc_id, 1 AS priority, 'lang' AS location, lang AS text FROM documents UNION ALL SELECT doc_id, 2, 'source', source FROM documents UNION ALL SELECT doc_id, 3, 'text', text FROM documents) WHERE instr(lower(text), 'en') > 0
""")
def excerpt(t: Tables) -> DataFrame:
    """In which fields of a record a term occurs, how often, and the text around it."""
    return V.locations(t.documents, "doc_id", {"lang": 1, "source": 2, "text": 3}, "en")


@query("""
SELECT doc_id, place, score, left(passage, 340) AS passage FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS k FROM (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS place, x[i] AS passage, CAST(contains(lower(x[i]), 'then') AS INTEGER) + CAST(contains(lower(x[i]), 'once') AS INTEGER) + CAST(contains(lower(x[i]), 'thing') AS INTEGER) AS score
  FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))) WHERE score > 0) WHERE k <= 2
""")
def passages(t: Tables) -> DataFrame:
    """The two passages of each text with most of a question's words."""
    return V.passages(t.documents, "doc_id", "text", ["then", "once", "thing"])


@query()
def mention_join(t: Tables) -> DataFrame:
    """Sentences of the benchmark that documents mention, word by word; those that a document begins with are its own. DuckDB
    folds some letters otherwise, so a test holds this against brute force."""
    sentences = F.explode(F.split("text", r"[.!?\n]+"))
    folded = lambda x: X.plain(F.col(x))
    names = t.benchmark.select(sentences.alias("x")).select(folded("x").alias("name")).where("name != ''").distinct()
    own = t.documents.select("doc_id", folded("text").alias("x"), F.get(F.split("text", r"[.!?\n]+", 2), F.lit(0)).alias("head")).select("doc_id", folded("head").alias("name")).where("name != ''")
    return V.mentions(t.documents, "doc_id", "text", names, "name", own)


@query("""
WITH names AS (SELECT DISTINCT trim(lower(w)) AS name FROM (SELECT unnest([split_part(p_name, ' ', 2), p_type, left(p_name, 5), p_name || ' ' || p_size, 'x' || p_brand]) AS w FROM part)), titles AS (SELECT DISTINCT p_name AS title FROM part)
SELECT name, coalesce(min(title) FILTER (title = name), min(title)) AS title FROM names JOIN titles ON contains(title, name) OR contains(name, title) GROUP BY name
""")
def first_containment(t: Tables) -> DataFrame:
    """Of each name the first title in order that holds it or that it holds, by the rarest run of three characters."""
    words = F.array(F.get(F.split("p_name", " "), F.lit(1)), F.col("p_type"), F.left("p_name", F.lit(5)), F.concat("p_name", F.lit(" "), F.col("p_size").cast("string")), F.concat(F.lit("x"), "p_brand"))
    return B.first_containing(t.part.select(F.explode(words).alias("name")), "name", t.part.select(F.col("p_name").alias("title")), "title")


@query("""
WITH titles AS (SELECT DISTINCT upper(left(p_name, 2 + p_partkey % 12)) AS title FROM part), lines AS (SELECT p_partkey, p_name || ' / ' || p_brand AS line FROM part)
SELECT p_partkey, count(*) AS titles, max(title) AS longest FROM lines JOIN titles ON starts_with(lower(line), lower(title)) GROUP BY p_partkey
""")
def title_prefixes(t: Tables) -> DataFrame:
    """Titles that begin the lines of a record, in any case, by their first eight characters."""
    titles = t.part.select(F.upper(F.left("p_name", (2 + F.col("p_partkey") % 12).cast("int"))).alias("title")).distinct()
    lines = t.part.select("p_partkey", F.concat("p_name", F.lit(" / "), "p_brand").alias("line"))
    each = B.prefix_join(titles, "title", lines.select("line").distinct(), "line").groupBy("line").agg(F.count("*").alias("n"), F.max("title").alias("most"))
    return lines.join(each, "line").groupBy("p_partkey").agg(F.sum("n").alias("titles"), F.max("most").alias("longest"))


@query()
def masked_names(t: Tables) -> DataFrame:
    """Names of parts, and the beginnings of the benchmark's texts, masked in whole documents, the longest first. Tested by brute force."""
    heads = t.benchmark.select(F.array_join(F.slice(F.split("text", " "), F.lit(1), (1 + F.col("item_id") % 5).cast("int")), " ").alias("name"), F.concat(F.lit("{"), F.col("item_id").cast("string"), F.lit("}")).alias("mark"))
    names = t.part.select(F.col("p_name").alias("name"), F.concat(F.lit("{"), "p_type", F.lit("}")).alias("mark")).unionByName(heads)
    return B.masked(t.documents, "doc_id", "text", names, "name", "mark")


@query("""
SELECT p_partkey, p_name FROM part WHERE p_name = 'purple ring' OR (NOT EXISTS (SELECT 1 FROM part WHERE p_name = 'purple ring') AND regexp_matches(p_name, 'r.{0,2}i.{0,2}n.{0,2}g') AND p_type = 'PROMO')
""")
def index_then_scan(t: Tables) -> DataFrame:
    """The index first, an elastic pattern if it finds nothing."""
    rows = t.part.select("p_partkey", "p_name", "p_type")
    return V.index_or_scan(rows.where("p_name = 'purple ring'"), rows.where((F.col("p_type") == "PROMO") & F.col("p_name").rlike(".{0,2}".join("ring")))).select("p_partkey", "p_name")


MISSPELT = "gizmoo blu"


@query(f"""
SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?is)' || array_to_string(['g', 'i', 'z', 'm', 'o', 'o', 'b', 'l', 'u'], '.{{0,2}}')) OR regexp_matches(p_name, '(?is)g.*i.*z.*m.*o.*o') OR regexp_matches(p_name, '(?is)b.*l.*u') OR list_has_any(string_split(p_name, ' '), ['gizmoo', 'blu'])
""")
def elastic_titles(t: Tables) -> DataFrame:
    """Titles that a misspelt query may mean: its letters with few between, a word's letters scattered, or a word as it is."""
    return L.elastic(t.part.select("p_partkey", "p_name"), "p_partkey", "p_name", MISSPELT)


@query()
def fuzzy_supplement(t: Tables) -> DataFrame:
    """Hits of the vector search, and titles that only a fuzzy search finds at 0.8 of their similarity. Tested by brute force."""
    hits = hybrid_hits(t).select(F.col("vec_id").alias("p_partkey"), "score")
    rows = L.supplemented(hits, t.part.select("p_partkey", "p_name"), "p_partkey", "p_name", MISSPELT)
    return rows.select("p_partkey", F.round("score", 9).alias("score"), "source")


@query("""
SELECT p_partkey, concat_ws(' | ', p_name, p_name, nullif(p_brand, 'Brand#1'), lower(p_type)) AS text FROM part
""")
def embedding_text(t: Tables) -> DataFrame:
    """The text that stands for a record, its title twice, without empty parts."""
    return t.part.select("p_partkey", F.concat_ws(" | ", "p_name", "p_name", F.nullif(F.col("p_brand"), F.lit("Brand#1")), F.lower("p_type")).alias("text"))


@query()
def fuzzy_scores(t: Tables) -> DataFrame:
    """Similarity of names, and how well a name answers a misspelt query."""
    other = keep_best(t.part, ["p_name"], F.col("p_partkey")).select("p_name")
    return other.select("p_name", F.round(Z.ratcliff(F.col("p_name"), F.lit("red wiget")), 6).alias("similar"), F.round(Z.fuzzy_in("gizmoo blue", 0.7)(F.col("p_name")), 6).alias("found"))


@query()
def sentence_chunks(t: Tables) -> DataFrame:
    """Whole sentences packed into chunks, and abbreviated heads."""
    return t.benchmark.select("item_id", F.explode(Z.sentence_chunks(200)("text")).alias("chunk")).select("item_id", X.abbreviate(F.col("chunk"), 60).alias("head"), F.length("chunk").alias("size"))


SALTS = ["sulfate", "chloride", "acetate"]


@query("""
WITH a AS (SELECT p_name AS norm, min(p_partkey) AS id FROM part GROUP BY p_name),
i AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' sulfate' WHEN 2 THEN 'chloride of ' || p_name ELSE p_name || 'x' END AS name FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 100.0 WHEN 3 THEN round(100.0 * 2 * length(norm) / (2 * length(norm) + 1), 4) ELSE 94.0 END AS score, CASE p_partkey % 4 WHEN 0 THEN 'exact' WHEN 3 THEN 'fuzzy' ELSE 'reduced' END AS rule, id
FROM i JOIN part USING (p_partkey) JOIN a ON a.norm = part.p_name
""")
def cascade_match(t: Tables) -> DataFrame:
    """Exact, then without salts, then fuzzy within a block; each level sees what the ones before left."""
    alias = E.aliases(t.part, "p_partkey", "p_name")
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.lit(" sulfate"))).when(k == 2, F.concat(F.lit("chloride of "), "p_name")).otherwise(F.concat("p_name", F.lit("x")))
    return E.cascade(t.part.select("p_partkey", name.alias("name")), "p_partkey", "name", alias, SALTS)


@query("""
SELECT p_partkey, text, priority FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS text, 0 AS priority FROM part
  UNION ALL SELECT p_partkey, unnest([p_brand, lower(p_type)]), 1 FROM part UNION ALL SELECT p_partkey, p_name, 2 FROM part) WHERE length(text) > 2
""")
def candidate_priorities(t: Tables) -> DataFrame:
    """What may name a record's substance, the most reliable first."""
    return E.candidates(t.part, "p_partkey", F.split("p_name", " "), F.concat("p_brand", F.lit("; "), F.lower("p_type"), F.lit(",a")), F.col("p_name"))


@query("""
WITH a AS (SELECT p_name AS norm, min(p_partkey) AS id FROM part GROUP BY p_name), g AS (SELECT DISTINCT 'le ' || p_name AS source, p_name AS target FROM part WHERE length(p_name) % 2 = 0),
i AS (SELECT p_partkey, p_name, CASE p_partkey % 3 WHEN 0 THEN 'le ' || p_name WHEN 1 THEN 'sulfate of le ' || p_name ELSE p_name END AS name FROM part)
SELECT p_partkey, id, CASE p_partkey % 3 WHEN 0 THEN 98.0 WHEN 1 THEN 92.0 ELSE 100.0 END AS score, CASE p_partkey % 3 WHEN 0 THEN 'translated' WHEN 1 THEN 'reduced and translated' ELSE 'exact' END AS rule
FROM i JOIN a ON norm = p_name WHERE p_partkey % 3 = 2 OR length(p_name) % 2 = 0
""")
def translated_match(t: Tables) -> DataFrame:
    """Names in another language by a glossary, whole and without their salt. Names are too short for a fuzzy match with an article."""
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.concat(F.lit("le "), "p_name")).when(k == 1, F.concat(F.lit("sulfate of le "), "p_name")).otherwise(F.col("p_name"))
    glossary = t.part.where(F.length("p_name") % 2 == 0).select(F.concat(F.lit("le "), "p_name").alias("source"), F.col("p_name").alias("target")).distinct()
    return E.cascade(t.part.select("p_partkey", name.alias("name")), "p_partkey", "name", E.aliases(t.part, "p_partkey", "p_name"), SALTS, 99.0, glossary)


@query("""
SELECT p_brand AS key, list_slice(list(id ORDER BY score DESC, id), 1, 3) AS ids, max(score) AS score FROM (SELECT p_brand, p_size AS id, max(CAST(90 + p_partkey % 11 AS DOUBLE)) AS score FROM part WHERE 90 + p_partkey % 11 >= 95 GROUP BY ALL) GROUP BY p_brand
""")
def three_best_ids(t: Tables) -> DataFrame:
    """Ids at or above a threshold, the best score of each, three at most."""
    found = t.part.select(F.col("p_brand").alias("key"), F.col("p_size").alias("id"), (90 + F.col("p_partkey") % 11).cast("double").alias("score"), F.lit("exact").alias("rule"), F.lit(0).alias("priority"))
    return E.best_three(found, "key", 95.0).select("key", "ids", "score")


@query("""
WITH a AS (SELECT p_name AS norm, min(p_partkey) AS id FROM part WHERE p_size > 10 GROUP BY p_name UNION ALL SELECT 'red', 1000000)
SELECT p_partkey, CASE WHEN p_size % 4 = 0 AND p_size >= 20 THEN p_size ELSE coalesce(a.id, CASE WHEN starts_with(p_name, 'red ') THEN 1000000 END) END AS id,
       CASE WHEN p_size % 4 = 0 AND p_size >= 20 THEN 60.0 + p_size WHEN a.id IS NOT NULL OR starts_with(p_name, 'red ') THEN 85.0 END AS score FROM part LEFT JOIN a ON a.norm = p_name
""")
def match_or_title(t: Tables) -> DataFrame:
    """A match worked out before if it is sure enough, else the title, else its first word."""
    alias = E.aliases(t.part.where("p_size > 10"), "p_partkey", "p_name").select("norm", "id").unionByName(t.spark.range(1).select(F.lit("red").alias("norm"), F.lit(1000000).cast("long").alias("id")))
    before = t.part.where("p_size % 4 = 0").select("p_partkey", F.col("p_size").cast("long").alias("id"), (60.0 + F.col("p_size")).alias("score"))
    return E.match_or_title(t.part, "p_partkey", "p_name", before, alias)


@query("""
WITH n AS (SELECT p_name || ' ' || p_size AS norm, min(p_partkey) AS id FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1), w AS (SELECT p_name || ' ' || p_size || ' forte' AS norm, min(p_partkey) AS id FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1)
SELECT p_partkey, p_name || ' ' || p_size AS phrase, n.id FROM part JOIN n ON n.norm = p_name || ' ' || p_size JOIN w ON w.norm = p_name || ' ' || p_size || ' forte'
""")
def resolving_phrases(t: Tables) -> DataFrame:
    """What an extraction found counts if it names exactly one id; the shortest run of words that names it stands."""
    name = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"))
    names = t.part.select(name.alias("norm"), F.col("p_partkey").alias("id")).unionByName(t.part.select(F.concat(name, F.lit(" forte")).alias("norm"), F.col("p_partkey").alias("id")))
    return E.resolving(t.part.select("p_partkey", F.concat(name, F.lit(" forte")).alias("text")), "p_partkey", "text", names)


@query("""
SELECT p_partkey, len(list_filter([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)], lambda x: regexp_matches(x, '(?i)\\b\\d+\\s*(DH|CH|K|LM)\\b'))) = 2 AS diluted,
       contains(lower(p_name), 'red') OR contains('red', lower(p_name)) AS lenient FROM part
""")
def substance_guards(t: Tables) -> DataFrame:
    """All substances diluted; containment in either direction."""
    words = F.split("p_name", " ")
    return t.part.select("p_partkey", F.forall(words, lambda x: x.rlike(r"(?i)\b\d+\s*(?:DH|CH|K|LM)\b")).alias("diluted"), (F.contains(F.lower("p_name"), F.lit("red")) | F.contains(F.lit("red"), F.lower("p_name"))).alias("lenient"))


@query("""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages
""")
def html_facts(t: Tables) -> DataFrame:
    """Facts that patterns find in pages."""
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


def _relevance_sql(terms: list[str]) -> str:
    """Points of all fields of a part, term by term: (points, matches)."""
    points, n, several = [], [], []
    for q in terms:
        size = len(q)
        times = lambda x: f"CAST((length({x}) - length(replace({x}, '{q}', ''))) / {size} AS INTEGER)"  # noqa: B023, E731
        points.append(f"CASE WHEN p_name = '{q}' THEN 100 WHEN list_contains(w, '{q}') THEN 75 WHEN starts_with(p_name, '{q}') THEN 60 WHEN starts_with(w[2], '{q}') THEN 40 ELSE {times('p_name')} * 40 END")
        n.append(f"CASE WHEN list_contains(w, '{q}') OR starts_with(p_name, '{q}') OR starts_with(w[2], '{q}') THEN 1 ELSE {times('p_name')} END")
        for word in ("w[1]", "w[2]"):
            points.append(f"CASE WHEN {word} = '{q}' THEN 80 WHEN starts_with({word}, '{q}') THEN 35 * 1.1 ELSE {times(word)} * 35 END")
            n.append(f"CASE WHEN {word} = '{q}' OR starts_with({word}, '{q}') THEN 1 ELSE {times(word)} END")
        points += [f"{times('lower(p_type)')} * 15", f"{times('z')} * 12", f"CASE WHEN contains(lower(p_brand), '{q}') THEN CASE WHEN p_size > 25 THEN 20 ELSE 10 END ELSE 0 END + {times('p_name')} * CASE WHEN p_size > 25 THEN 4.5 ELSE 3 END", f"CASE WHEN contains(lower(p_type), '{q}') THEN CASE WHEN p_size > 25 THEN 7.5 ELSE 5 END ELSE 0 END + {times('p_name')} * 4"]
        n += [times("lower(p_type)"), times("z"), f"CAST(contains(lower(p_brand), '{q}') AS INTEGER) + {times('p_name')}", f"CAST(contains(lower(p_type), '{q}') AS INTEGER) + {times('p_name')}"]
        several.append(f"CAST(contains(p_name, '{q}') AS INTEGER)")
    return f"SELECT p_partkey, {' + '.join(points)} AS points, {' + '.join(n)} AS matches, {' + '.join(several)} AS several FROM (SELECT *, string_split(p_name, ' ') AS w, CAST(p_size AS VARCHAR) || ' mg' AS z FROM part)"


_TERMS = ["red", "ge", "1", "ll"]


@query(f"""
SELECT p_partkey, CAST(matches AS DOUBLE) AS matches, round(CASE WHEN matches = 0 THEN 0 WHEN matches = 1 AND score < 5 THEN score * 0.5 ELSE score END, 6) AS score FROM (SELECT *, points * CASE WHEN several > 1 THEN 1 + (several - 1) * 0.1 ELSE 1 END AS score FROM ({_relevance_sql(_TERMS)}))
""")
def search_relevance(t: Tables) -> DataFrame:
    """Relevance over all fields of a record: ladders for title and substances, sums for the others, bonus and penalty."""
    important = F.col("p_size") > 25
    sections = F.array(F.struct(F.col("p_brand").alias("title"), F.col("p_name").alias("text"), important.alias("important"), F.lit(False).alias("below")), F.struct(F.col("p_type").alias("title"), F.col("p_name").alias("text"), important.alias("important"), F.lit(True).alias("below")))
    found = V.full_relevance(F.col("p_name"), F.split("p_name", " "), F.col("p_type"), F.array(F.concat(F.col("p_size").cast("string"), F.lit(" mg"))), sections, _TERMS)
    return t.part.select("p_partkey", found.alias("r")).select("p_partkey", "r.matches", F.round("r.score", 6).alias("score"))


@query("""
SELECT doc_id, left(trim(x[1]), 300) AS sentence FROM (SELECT doc_id, list_filter(string_split(replace(replace(replace(replace(text, chr(10), chr(1)), '. ', '.' || chr(1)), '! ', '!' || chr(1)), '? ', '?' || chr(1)), chr(1)), lambda s: contains(lower(s), 'tion')) AS x
  FROM (SELECT doc_id, regexp_replace(text, '[ \\t\\r\\f\\x0B]+', ' ', 'g') AS text FROM documents)) WHERE len(x) > 0
""")
def sentence_excerpts(t: Tables) -> DataFrame:
    """The first sentence that holds a term."""
    one = F.regexp_replace("text", r"[ \t\r\f\x0B]+", " ")
    return t.documents.select("doc_id", V.sentence_around(one, "tion").alias("sentence")).where("sentence IS NOT NULL")


_WORDS = ["red", "promo", "brand#2", "gear"]


@query(f"""
SELECT p_partkey, {" + ".join(f"CAST(contains(lower(p_name), '{w}') OR contains(lower(p_type), '{w}') OR contains(lower(p_brand), '{w}') AS INTEGER)" for w in _WORDS)} AS hits, 0.5 AS similarity FROM part WHERE hits > 0 ORDER BY hits DESC, p_partkey LIMIT 30
""")
def keyword_candidates(t: Tables) -> DataFrame:
    """Keywords of a closed list in any of several fields, thirty rows, at a similarity of their own."""
    hits = sum([P.some(*[P.contains_literal(F.col(c), w) for c in ("p_name", "p_type", "p_brand")]).cast("int") for w in _WORDS], F.lit(0))
    return t.part.select("p_partkey", hits.alias("hits"), F.lit(0.5).alias("similarity")).where("hits > 0").orderBy(F.desc("hits"), "p_partkey").limit(30)


@query("""
SELECT doc_id, aim FROM (SELECT doc_id, CASE WHEN least(a, b, c) = 1000000000 THEN 'none' WHEN a <= b AND a <= c THEN 'pain' WHEN b <= c THEN 'fever' ELSE 'sleep' END AS aim FROM (
  SELECT doc_id, coalesce(nullif(instr(text, 'tion'), 0), 1000000000) AS a, coalesce(nullif(instr(text, 'onen'), 0), 1000000000) AS b, coalesce(nullif(instr(text, 'schen'), 0), 1000000000) AS c FROM documents))
""")
def principal_objective(t: Tables) -> DataFrame:
    """Of several aims the one that a text names first; equals by their order."""
    return t.documents.select("doc_id", P.earliest(F.col("text"), {"pain": ("tion",), "fever": ("onen",), "sleep": ("schen",)}, "none").alias("aim"))
