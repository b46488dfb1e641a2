"""The rule engine over the tables: parts stand in for products and candidates, orders for prescriptions, customers for patients."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators import filters as P
from tarn.operators import graph as G
from tarn.operators import search as V
from tarn.operators import sets as S
from tarn.operators.windows import keep_best
from tarn.plans import rules as R
from tarn.plans.graphs import EDGES_SQL
from tarn.plans.registry import Tables, query
from tarn.session import cut, light
from tarn.sources.pages import date_in

CASE = R.Case(
    expected=("PROMO", "SMALL", "LARGE", "ECONOMY"), never=("STANDARD",), relieving=("SMALL",), history=("old gear", "blue"), local_routes="^(hot)$",
    rules=(R.Rule("no bolts", r"\bbolts?\b"), R.Rule("renal", r"\banvil\b", ("LARGE",), "demote", "watch"), R.Rule("pressure", r"^new\b", ("PROMO",), "watch", "demote")),
)
TREATED = (3, 17, 42)


def candidates(t: Tables) -> DataFrame:
    """Products in the form that every stage reads (R01): what a table lacks is empty or missing, never left out."""
    words = F.split("p_name", " ")
    unclassed = F.col("p_size") % 13 == 0
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), words[1].alias("substance"), F.when(unclassed, F.array().cast("array<string>")).otherwise(F.array("p_type")).alias("groups"),
                         F.when(~unclassed, F.col("p_type")).alias("cls"), F.when(F.col("p_brand") == "Brand#13", "stopped").when(F.col("p_brand") == "Brand#2", "").when(F.col("p_brand") != "Brand#3", "marketed").alias("status"),
                         words[0].alias("route"), F.concat(F.lit("For use; "), "p_name", F.lit(". Not for all.")).alias("notice"), (F.col("p_size") * 2).alias("raw"))


def treatments(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_partkey").isin(*TREATED)).select(F.col("p_partkey").alias("t_id"), F.split("p_name", " ")[1].alias("t_substance"), F.col("p_type").alias("t_class"), (F.col("p_size") % 2 == 0).alias("cumulative"))


def controlled(t: Tables) -> DataFrame:
    treated = treatments(t)
    return R.controls(candidates(t), CASE, treated, G.edges_between(t.lineitem, "l_orderkey", "l_partkey", treated.select(F.col("t_id").alias("id"))))


CONTROLS_SQL = f"""
WITH {EDGES_SQL},
c AS (SELECT p_partkey AS id, p_name AS title, split_part(p_name, ' ', 2) AS substance, CASE WHEN p_size % 13 = 0 THEN NULL ELSE p_type END AS cls,
        CASE WHEN p_brand = 'Brand#13' THEN 'stopped' WHEN p_brand = 'Brand#2' THEN '' WHEN p_brand <> 'Brand#3' THEN 'marketed' END AS status, split_part(p_name, ' ', 1) AS route, p_size * 2 AS raw FROM part),
tr AS (SELECT p_partkey AS t_id, split_part(p_name, ' ', 2) AS s, p_type AS k, CAST(p_size % 2 = 0 AS INTEGER) AS cumulative FROM part WHERE p_partkey IN {TREATED}),
d AS (SELECT c.*, substance IN (SELECT s FROM tr) AS same, (SELECT min(cumulative) FROM tr WHERE k = cls) AS cum,
        CASE WHEN status <> '' AND status <> 'marketed' THEN 'not marketed' WHEN route = 'hot' THEN 'local route' END AS r1,
        CASE WHEN cls = 'STANDARD' THEN 'not a treatment' WHEN cls NOT IN ('PROMO', 'SMALL', 'LARGE', 'ECONOMY') THEN 'class not expected' END AS r2,
        CASE WHEN regexp_matches(title, '\\bbolts?\\b') THEN 'no bolts' END AS r4,
        CAST(regexp_matches(title, '\\banvil\\b') AS INTEGER) + CAST(NOT starts_with(title, 'new ') AND coalesce(cls = 'PROMO', false) AS INTEGER) AS demotions,
        (contains(title, 'old') AND contains(title, 'gear')) OR contains(title, 'blue') AS warned, id IN (SELECT dst FROM u WHERE src IN (SELECT t_id FROM tr)) AS interacts FROM c),
s AS (SELECT *, CASE WHEN NOT same AND cum = 0 THEN 'class must not be doubled' END AS r3, CASE WHEN same THEN 'same substance' WHEN cum = 1 THEN 'class doubled' END AS alert FROM d),
n AS (SELECT *, greatest(0, raw - 40 * CAST(warned AS INTEGER) - CASE WHEN coalesce(alert = 'class doubled', false) THEN 10 ELSE 20 END * CAST(interacts AS INTEGER) - 15 * demotions) AS score,
        r1 IS NULL AND r2 IS NULL AND r3 IS NULL AND r4 IS NULL AS kept FROM s),
b AS (SELECT cls AS k, arg_min(id, (-score, id)) AS best FROM n WHERE kept AND cls IS NOT NULL GROUP BY cls),
f AS (SELECT n.*, CASE WHEN NOT kept THEN NULL WHEN best = id AND cls = 'SMALL' THEN 'adjuvant' WHEN best = id THEN 'first line' ELSE 'alternative' END AS line FROM n LEFT JOIN b ON cls = k),
z AS (SELECT *, CASE WHEN r1 IS NOT NULL THEN 'eligibility' WHEN r2 IS NOT NULL THEN 'class' WHEN r3 IS NOT NULL THEN 'redundancy' WHEN r4 IS NOT NULL THEN 'constraint' WHEN score < 40 THEN 'threshold' END AS stage,
        coalesce(r1, r2, r3, r4, CASE WHEN score < 40 AND raw >= 40 THEN 'penalised' WHEN score < 40 THEN 'no link to the diagnosis' END) AS reason FROM f)
"""


@query(f"{CONTROLS_SQL} SELECT id, stage, reason, score, raw, alert, line FROM z")
def prescription_controls(t: Tables) -> DataFrame:
    """All stages over all products; every row has its verdict."""
    return controlled(t).select("id", F.col("reject_stage").alias("stage"), F.col("reject_reason").alias("reason"), "score", "raw", "alert", "line")


@query(f"{CONTROLS_SQL} SELECT stage, CAST(list_position(['eligibility', 'class', 'redundancy', 'constraint', 'threshold'], stage) AS INTEGER) AS place, count(*) AS n FROM z WHERE stage IS NOT NULL GROUP BY stage")
def rejections_by_stage(t: Tables) -> DataFrame:
    """How many rows each stage rejected, in the order of the stages."""
    return R.rejected_by_stage(controlled(t))


@query(f"{CONTROLS_SQL} SELECT id, score, line FROM z WHERE stage IS NULL ORDER BY warned, cls IS NULL, -score, id LIMIT 20")
def prescription_pool(t: Tables) -> DataFrame:
    """The pool that a screen shows: what passed, flagged rows and rows without a class last, twenty at most."""
    kept = controlled(t).where("reject_stage IS NULL")
    return kept.orderBy("warned", F.col("cls").isNull(), F.desc("score"), "id").limit(20).select("id", "score", "line")


QUERY = [round(0.125 * (1 if i % 3 else -1), 3) for i in range(64)]
KEYWORDS = ["promo", "brand#2", "gear"]
#: How many candidates each source gives: hits of the vector search, of keywords, and products of the expected classes.
GIVES = {"vector": 50, "keywords": 30, "class": 60}
POOL_SQL = f"""
c AS (SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size % 13 = 0 THEN NULL ELSE p_type END AS cls, CASE WHEN p_brand = 'Brand#13' THEN 'stopped' WHEN p_brand = 'Brand#2' THEN '' WHEN p_brand <> 'Brand#3' THEN 'marketed' END AS status, split_part(p_name, ' ', 1) AS route, p_type, p_brand FROM part),
v AS (SELECT id, title, similarity, 0 AS part, 'vector' AS origin FROM c JOIN (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {QUERY}::DOUBLE[]), 9) AS similarity FROM embeddings) ON vec_id = id WHERE similarity >= 0.0),
k AS (SELECT id, title, CAST(0.5 AS DOUBLE) AS similarity, 1 AS part, 'keywords' AS origin FROM c WHERE {" OR ".join(f"contains(lower({x}), '{w}')" for x in ("title", "p_type", "p_brand") for w in KEYWORDS)}),
g AS (SELECT id, title, CAST(NULL AS DOUBLE) AS similarity, 2 AS part, 'class' AS origin FROM c WHERE cls IN ('PROMO', 'SMALL', 'LARGE', 'ECONOMY')),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY similarity DESC NULLS LAST, id) AS n, count(*) OVER (PARTITION BY origin) AS total FROM (SELECT * FROM v UNION ALL SELECT * FROM k UNION ALL SELECT * FROM g))
  WHERE n <= CASE origin WHEN 'vector' THEN 50 WHEN 'keywords' THEN 30 ELSE 60 END),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part) AS turn FROM s) WHERE turn = 1),
h AS (SELECT * FROM f WHERE origin <> 'class' OR title NOT IN (SELECT title FROM f WHERE origin <> 'class')),
r AS (SELECT h.id, origin, similarity, cls IS NULL AS unclassed,
  CASE WHEN status <> '' AND status <> 'marketed' THEN 'eligibility' WHEN route = 'hot' THEN 'eligibility' WHEN cls = 'STANDARD' OR cls NOT IN ('PROMO', 'SMALL', 'LARGE', 'ECONOMY') THEN 'class' END AS stage,
  CASE WHEN status <> '' AND status <> 'marketed' THEN 'not marketed' WHEN route = 'hot' THEN 'local route' WHEN cls = 'STANDARD' THEN 'not a treatment' WHEN cls NOT IN ('PROMO', 'SMALL', 'LARGE', 'ECONOMY') THEN 'class not expected' END AS reason FROM h JOIN c ON c.id = h.id),
z AS (SELECT *, CASE WHEN stage IS NULL THEN CAST(row_number() OVER (PARTITION BY stage IS NULL ORDER BY origin <> 'class', unclassed, similarity DESC NULLS LAST, id) AS INTEGER) END AS n FROM r),
p AS (SELECT id, origin, similarity, CASE WHEN n > 20 THEN 'pool' ELSE stage END AS reject_stage, CASE WHEN n > 20 THEN 'beyond the pool' ELSE reason END AS reject_reason, CASE WHEN n <= 20 THEN n END AS place FROM z)"""


def pooled(t: Tables) -> DataFrame:
    rows = candidates(t)
    titled = rows.select("id", "title")
    hits = t.embeddings.select(F.col("vec_id").alias("id"), F.round(V.cosine(F.col("embedding"), QUERY), 9).alias("similarity")).where("similarity >= 0.0").join(titled, "id")
    some = P.some(*[P.contains_literal(F.col(c), w) for c in ("p_name", "p_type", "p_brand") for w in KEYWORDS])
    named = t.part.where(some).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit(0.5).alias("similarity"))
    classed = rows.where(F.arrays_overlap("groups", R.strings(CASE.expected))).select("id", "title", F.lit(None).cast("double").alias("similarity"))
    found = R.assembled([("vector", hits, GIVES["vector"]), ("keywords", named, GIVES["keywords"]), ("class", classed, GIVES["class"])], "class")
    return R.pool(found, rows, CASE, "class")


@query(f"WITH {POOL_SQL} SELECT * FROM p")
def assembled_pool(t: Tables) -> DataFrame:
    """A pool from vector hits, keywords and expected classes, each with its limit and named as the origin, through eligibility and class; twenty are shown, and
    what is not says why."""
    return pooled(t)


#: Current treatments are the products whose id leaves 7 when divided by 50; those of a size over 5 are known.
_TWO = f"""WITH {EDGES_SQL}, {POOL_SQL},
a AS (SELECT p_partkey AS id, p_size FROM part WHERE p_partkey % 50 = 7 ORDER BY p_partkey LIMIT {R.MOST_TREATMENTS}), b AS (SELECT id FROM p WHERE reject_stage IS NULL OR reject_stage = 'pool' ORDER BY id LIMIT {R.MOST_CANDIDATES}),
x AS (SELECT a.id AS treatment, b.id AS suggestion, weight FROM a JOIN u ON u.src = a.id JOIN b ON b.id = u.dst WHERE p_size > 5)"""


def two_lists(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Treatments and suggestions with their limits, the known names of both, and the interactions between the two lists."""
    current = R.capped(t.part.where("p_partkey % 50 = 7").select(F.col("p_partkey").alias("id"), "p_size"), R.MOST_TREATMENTS, F.asc("id"))
    offered = cut(R.capped(pooled(t).where("coalesce(reject_stage, 'pool') = 'pool'").select("id"), R.MOST_CANDIDATES, F.asc("id")))
    known = current.where("p_size > 5").select("id")
    matched = known.select(F.lit("treatment").alias("side"), "id").unionByName(offered.select(F.lit("suggestion").alias("side"), "id"))
    return current, offered, matched, G.edges_between(t.lineitem, "l_orderkey", "l_partkey", known, offered.select("id"))


@query(f"{_TWO} SELECT treatment, suggestion, weight FROM x")
def two_list_interactions(t: Tables) -> DataFrame:
    """The interactions between two resolved lists, each with its limit; only groups that hold a treatment are paired."""
    return two_lists(t)[3].select(F.col("src").alias("treatment"), F.col("dst").alias("suggestion"), "weight")


@query(f"""{_TWO}
SELECT *, CASE WHEN treatments = 0 THEN 'no treatment' WHEN suggestions = 0 THEN 'no suggestion' WHEN checked = 0 THEN 'not matched' WHEN found > 0 THEN 'found' ELSE 'none' END AS state FROM (SELECT *, known_treatments * known_suggestions AS checked FROM (
  SELECT (SELECT count(*) FROM a) AS treatments, (SELECT count(*) FROM b) AS suggestions, (SELECT count(*) FROM a WHERE p_size > 5) AS known_treatments, (SELECT count(*) FROM b) AS known_suggestions,
    (SELECT count(*) FROM x) AS found, (SELECT count(*) > {R.MOST_TREATMENTS} FROM part WHERE p_partkey % 50 = 7) OR (SELECT count(*) > {R.MOST_CANDIDATES} FROM p WHERE coalesce(reject_stage, 'pool') = 'pool') AS truncated))
""")
def interaction_report(t: Tables) -> DataFrame:
    """The state of a check of interactions, what it rests on, and whether a limit cut it."""
    return R.interaction_report(*two_lists(t))


@query("""
SELECT id, rule, level FROM (
  SELECT p_partkey AS id, 'no bolts' AS rule, CASE WHEN regexp_matches(p_name, '\\bbolts?\\b') THEN 'exclude' END AS level FROM part
  UNION ALL SELECT p_partkey, 'renal', CASE WHEN regexp_matches(p_name, '\\banvil\\b') THEN 'demote' WHEN p_type = 'LARGE' AND p_size % 13 <> 0 THEN 'watch' END FROM part
  UNION ALL SELECT p_partkey, 'pressure', CASE WHEN regexp_matches(p_name, '^new\\b') THEN 'watch' WHEN p_type = 'PROMO' AND p_size % 13 <> 0 THEN 'demote' END FROM part) WHERE level IS NOT NULL
""")
def rule_levels(t: Tables) -> DataFrame:
    """A rule matches by name at its level, else by class at the weaker one."""
    return R.levels(candidates(t), "id", "title", "groups", CASE.rules)


MARKERS = {"pain": ("thion", "whin"), "fever": ("onen", "ther"), "sleep": ("elly", "schen")}
_AIMS = ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(strip_accents(text)), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{a}' END" for a, words in MARKERS.items())


@query(f"""
SELECT doc_id, CASE WHEN len(a) = 0 THEN 'unknown' WHEN list_has_any(a, ['pain', 'sleep']) THEN 'yes' ELSE 'no' END AS verdict, len(a) AS n FROM (SELECT doc_id, list_filter([{_AIMS}], lambda x: x IS NOT NULL) AS a FROM documents)
""")
def indication_verdicts(t: Tables) -> DataFrame:
    """Whether what a text supports answers what is sought; a text without markers is no reason against."""
    a = R.aims(F.col("text"), MARKERS)
    return t.documents.select("doc_id", a.alias("a")).select("doc_id", R.indication_verdict(R.strings(("pain", "sleep")), F.col("a")).alias("verdict"), F.size("a").cast("long").alias("n"))


@query("""
SELECT item_id, CASE WHEN len(x) > 0 THEN x ELSE y END AS classes FROM (SELECT item_id,
  list_sort(list_distinct(flatten([CASE WHEN regexp_matches(lower(strip_accents(text)), '\\bthin?s?\\b') THEN ['A02', 'B01'] ELSE [] END, CASE WHEN regexp_matches(lower(strip_accents(text)), '\\bblees?\\b') THEN ['B01', 'C09'] ELSE [] END]))) AS x,
  list_sort(list_distinct(CASE WHEN regexp_matches(lower(strip_accents(text)), '\\bands?\\b') THEN ['N02'] ELSE [] END)) AS y FROM benchmark)
""")
def classes_of_diagnosis(t: Tables) -> DataFrame:
    """Classes of the conditions that a text names, those of its aims where it names none."""
    table = [("thin?", ("A02", "B01")), ("blee", ("B01", "C09"))]
    return t.benchmark.select("item_id", R.expected_classes(F.col("text"), table, [("and", ("N02",))]).alias("classes"))


@query("""
WITH c AS (SELECT p_brand, upper(left(p_type, 1)) || lpad(CAST(p_size % 3 AS VARCHAR), 2, '0') AS grp, p_size FROM part),
k AS (SELECT p_brand, grp, p_size >= 30 AS mixed FROM c),
g AS (SELECT p_brand, list_sort(list(DISTINCT grp) FILTER (NOT mixed)) AS own, list_sort(list(DISTINCT grp)) AS every FROM k GROUP BY p_brand)
SELECT p_brand AS substance, CASE WHEN len(own) > 0 THEN own ELSE every END AS groups FROM g
""")
def own_groups_of_substance(t: Tables) -> DataFrame:
    """Groups of a substance without codes of combinations, unless it has no others. Codes are at most a few hundred for a substance."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    size = F.col("p_size")
    code = F.concat(F.lower(F.left("p_type", F.lit(1))), two(size % 3), F.lit("AB"), two(F.when(size >= 30, size + 20).otherwise(size)))
    return t.part.groupBy(F.col("p_brand").alias("substance")).agg(F.collect_set(code).alias("codes")).select("substance", R.own_groups(F.col("codes")).alias("groups"))


@query("""
SELECT id, score, reasons FROM (SELECT p_partkey AS id, least(100, greatest(0, CASE WHEN contains(p_name, 'gear') THEN 40 ELSE 0 END + CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 25 ELSE 0 END + CASE WHEN p_size < 10 THEN 30 ELSE 0 END
   + CASE WHEN nullif(p_brand, 'Brand#1') = 'Brand#2' THEN 15 ELSE 0 END - CASE WHEN step > 2 THEN 25 * (step - 2) ELSE 0 END)) AS score,
  list_filter([CASE WHEN contains(p_name, 'gear') THEN 'indication' END, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'class' END, CASE WHEN p_size < 10 THEN 'population' END, CASE WHEN nullif(p_brand, 'Brand#1') = 'Brand#2' THEN 'evidence' END], lambda x: x IS NOT NULL) AS reasons
  FROM (SELECT *, CASE WHEN starts_with(p_type, 'L') THEN 4 WHEN starts_with(p_type, 'P') OR starts_with(p_type, 'ST') THEN 3 WHEN starts_with(p_type, 'S') THEN 1 ELSE 0 END AS step FROM part))
""")
def relevance_points(t: Tables) -> DataFrame:
    """Points with their reasons, less a penalty for each step above the intensity; out of 100."""
    step = R.step_of(F.col("p_type"), [(4, ("L",)), (3, ("P", "ST")), (1, ("S",))])
    points = [("indication", 40, F.contains("p_name", F.lit("gear"))), ("class", 25, F.col("p_type").isin("PROMO", "SMALL")), ("population", 30, F.col("p_size") < 10), ("evidence", 15, F.nullif(F.col("p_brand"), F.lit("Brand#1")) == "Brand#2")]
    score, reasons = R.relevance(points, R.step_penalty(step, F.lit(2)))
    return t.part.select(F.col("p_partkey").alias("id"), score.alias("score"), reasons.alias("reasons"))


@query("""
WITH s AS (SELECT doc_id, x[i] AS sentence, i FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(1)), chr(1)) AS x FROM (SELECT doc_id, regexp_replace(replace(replace(text, ';', ','), '·', ','), '\\.\\s+', '. ', 'g') AS text FROM documents)))),
h AS (SELECT * FROM (VALUES ('the and', 'the', 'and'), ('of thin', 'of', 'thin')) AS h(term, a, b))
SELECT doc_id, term, arg_min(sentence, i) AS sentence FROM s, h WHERE contains(lower(strip_accents(sentence)), a) AND contains(lower(strip_accents(sentence)), b) GROUP BY doc_id, term
""")
def contraindication_flags(t: Tables) -> DataFrame:
    """Items of a history all of whose words one sentence holds, with the first such sentence."""
    text = F.regexp_replace(F.translate("text", ";·", ",,"), r"\.\s+", ". ")
    found = t.documents.select("doc_id", F.explode(R.contraindications(text, ("the and", "of thin"))).alias("c"))
    return found.select("doc_id", "c.term", "c.sentence")


@query("""
SELECT p_brand, coalesce(exact, below, top, '') AS text FROM (SELECT p_brand, arg_min(p_name, p_partkey) FILTER (p_size = 43) AS exact, arg_min(p_name, p_partkey) FILTER (p_size // 10 = 4) AS below, arg_min(p_type, p_partkey) FILTER (p_size // 10 = 4) AS top FROM part GROUP BY p_brand)
""")
def section_of_number(t: Tables) -> DataFrame:
    """The text of a section by its number: subsections first, then sections. A document has a few dozen sections."""
    number = F.floor(F.col("p_size") / 10).cast("string")
    below = F.when(F.col("p_size") >= 40, F.array(F.struct(F.concat(F.lit(" "), number, F.lit("."), F.col("p_size") % 10, F.lit(" x")).alias("title"), F.col("p_name").alias("text"))))
    section = F.struct("p_partkey", F.concat(number, F.lit(". X")).alias("title"), F.col("p_type").alias("text"), below.alias("subsections"))
    docs = t.part.groupBy("p_brand").agg(F.array_sort(F.collect_list(section)).alias("sections"))
    found = F.coalesce(F.nullif(R.section_text(F.col("sections"), "4.3"), F.lit("")), R.section_text(F.col("sections"), "4"))
    return docs.select("p_brand", found.alias("text"))


@query(f"""
WITH {EDGES_SQL}, l AS (SELECT l_orderkey AS rx, count(*) AS lines, count(p_partkey) AS matched FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 25 GROUP BY 1),
x AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25),
f AS (SELECT a.l_orderkey AS rx, count(*) AS found FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey JOIN e ON src = a.l_partkey AND dst = b.l_partkey AND weight >= 2 GROUP BY 1)
SELECT o_orderkey AS rx, coalesce(lines, 0) AS lines, coalesce(matched, 0) AS matched, coalesce(found, 0) AS found,
       CASE WHEN coalesce(lines, 0) = 0 THEN 'no treatment' WHEN o_orderstatus = 'P' THEN 'not verifiable' WHEN matched = 0 THEN 'not matched' WHEN coalesce(found, 0) > 0 THEN 'found' ELSE 'none' END AS state
FROM orders LEFT JOIN l ON o_orderkey = l.rx LEFT JOIN f ON o_orderkey = f.rx
""")
def prescription_check(t: Tables) -> DataFrame:
    """For every prescription its lines, how many are matched, how many pairs interact, and a state that tells `none` from
    `not checked`."""
    listed = t.part.where("p_size > 25").select("p_partkey")
    lines = t.lineitem.select("l_orderkey", "l_partkey").join(light(listed), F.col("l_partkey") == F.col("p_partkey"), "left")
    counted = lines.groupBy(F.col("l_orderkey").alias("rx")).agg(F.count("*").alias("lines"), F.count("p_partkey").alias("matched"))
    pairs = G.pairs_within(lines.where("p_partkey IS NOT NULL"), "l_orderkey", "l_partkey", G.tasks(t.lineitem))
    strong = pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).where("weight >= 2").select("a", "b")
    found = pairs.join(strong, ["a", "b"]).groupBy(F.col("l_orderkey").alias("rx")).agg(F.count("*").alias("found"))
    out = t.orders.select(F.col("o_orderkey").alias("rx"), "o_orderstatus").join(counted, "rx", "left").join(found, "rx", "left").fillna(0, ["lines", "matched", "found"])
    return out.select("rx", "lines", "matched", "found", R.interaction_state(F.col("lines"), F.lit(1), F.col("matched"), F.col("found"), F.col("o_orderstatus") != "P").alias("state"))


@query("""
SELECT l_orderkey AS rx, l_linenumber AS line, l_partkey AS product FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)
""")
def unmatched_lines(t: Tables) -> DataFrame:
    """Lines whose product isn't known; they are reported, never dropped."""
    return t.lineitem.join(t.part.where("p_size > 25"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select(F.col("l_orderkey").alias("rx"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("product"))


@query("""
SELECT c_custkey AS patient, rule, level FROM (SELECT c_custkey, 'renal' AS rule, CASE WHEN contains(lower(c_mktsegment), 'build') THEN 'exclude' END AS level FROM customer
  UNION ALL SELECT c_custkey, 'cardiac', CASE WHEN c_mktsegment = 'MACHINERY' THEN 'watch' WHEN c_nationkey % 5 = 0 THEN 'demote' END FROM customer) WHERE level IS NOT NULL
""")
def treatment_review(t: Tables) -> DataFrame:
    """Existing treatments in free text against the rules: flagged, never removed."""
    rules = (R.Rule("renal", "build"), R.Rule("cardiac", "^machinery$", ("0",), "watch", "demote"))
    rows = t.customer.select(F.col("c_custkey").alias("patient"), F.col("c_mktsegment").alias("name"), F.array((F.col("c_nationkey") % 5).cast("string")).alias("classes"))
    return R.levels(rows, "patient", "name", "classes", rules)


FALLBACK = [("PROMO", "red gear", "first line"), ("SMALL", "blue bolt", "alternative"), ("LARGE", "new rod", "first line")]


@query(f"""
SELECT p_partkey AS id, coalesce(t.conduct, 'none') AS conduct, coalesce(t.line, 'none') AS line FROM part LEFT JOIN (VALUES {', '.join(map(str, FALLBACK))}) t(k, conduct, line) ON p_type = k
""")
def clinical_fallback(t: Tables) -> DataFrame:
    """The curated conduct of a diagnosis where no candidate is left."""
    table = F.create_map(*[x for k, c, n in FALLBACK for x in (F.lit(k), F.struct(F.lit(c).alias("c"), F.lit(n).alias("n")))])
    hit = F.element_at(table, F.col("p_type"))
    return t.part.select(F.col("p_partkey").alias("id"), F.coalesce(hit["c"], F.lit("none")).alias("conduct"), F.coalesce(hit["n"], F.lit("none")).alias("line"))


@query(f"""
WITH {EDGES_SQL}, q AS (SELECT p_partkey AS id, p_name, p_brand FROM part WHERE p_partkey % 50 = 0),
a AS (SELECT q.id, p.p_name AS title, 0 AS kind, min(p.p_partkey) AS other FROM q JOIN part p ON p.p_brand = q.p_brand AND p.p_name <> q.p_name GROUP BY ALL),
a6 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY title) AS k FROM a) WHERE k <= 6),
b AS (SELECT q.id, p.p_name AS title, 1 AS kind, min(p.p_partkey) AS other FROM q JOIN part p ON split_part(p.p_name, ' ', 2) = split_part(q.p_name, ' ', 2) AND p.p_partkey <> q.id AND p.p_name <> q.p_name
      WHERE NOT EXISTS (SELECT 1 FROM u WHERE src = q.id AND dst = p.p_partkey) GROUP BY ALL),
b8 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY title) AS k FROM b) WHERE k <= 8),
w AS (SELECT *, row_number() OVER (PARTITION BY id, title ORDER BY kind) AS d FROM (SELECT * FROM a6 UNION ALL SELECT * FROM b8)),
z AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kind, title) AS place FROM w WHERE d = 1)
SELECT id, title, other, kind, CAST(place AS INTEGER) AS place FROM z WHERE place <= 12
""")
def alternatives(t: Tables) -> DataFrame:
    """For each product asked for (ids divisible by 50) against all: six of the same maker by title, then eight of a shared kind that don't
    interact with it, each title once, twelve in all."""
    p = t.part.where("p_name IS NOT NULL").select("p_partkey", F.col("p_name").alias("title"), "p_brand", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("kind_of"))
    q = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id"), F.col("title").alias("own"), "p_brand", "kind_of")
    makers = keep_best(p.groupBy("p_brand", "title").agg(F.min("p_partkey").alias("other")), ["p_brand"], F.col("title"), k=7)
    same = keep_best(q.join(makers, "p_brand").where("title != own"), ["id"], F.col("title"), k=6).select("id", "title", "other", F.lit(0).alias("kind"))
    near = G.first_without_edge(q.select("id", "own", "kind_of"), p.select(F.col("p_partkey").alias("other"), "title", "kind_of"), G.edges_between(t.lineitem, "l_orderkey", "l_partkey", q.select("id")), "kind_of", 8)
    graph = near.select("id", "title", "other", F.lit(1).alias("kind"))
    once = keep_best(same.unionByName(graph), ["id", "title"], F.col("kind"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("kind", "title"))).where("place <= 12").select("id", "title", "other", "kind", "place")


@query(f"""
WITH {EDGES_SQL}, d AS (SELECT p_partkey AS id, p_name FROM part WHERE p_type IN ('PROMO', 'SMALL'))
SELECT id FROM d WHERE id NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.1) AND id NOT IN (SELECT dst FROM u WHERE src IN {TREATED} AND weight >= 2)
""")
def profile_recommendation(t: Tables) -> DataFrame:
    """What treats any of a list, without an absolute contraindication and without a severe interaction with a co-treatment."""
    treats = t.part.where(F.col("p_type").isin("PROMO", "SMALL")).select(F.col("p_partkey").alias("id"))
    absolute = t.lineitem.where("l_returnflag = 'R' AND l_discount >= 0.1").select(F.col("l_partkey").alias("id"))
    severe = G.edges_between(t.lineitem, "l_orderkey", "l_partkey", treatments(t).select(F.col("t_id").alias("id"))).where("weight >= 2").select(F.col("dst").alias("id"))
    return treats.join(absolute, "id", "left_anti").join(severe, "id", "left_anti")


@query(f"""
WITH {EDGES_SQL}, n AS (SELECT DISTINCT dst AS id FROM u WHERE src = 10 UNION SELECT 10)
SELECT 'node' AS part, 'p' || n.id AS a, NULL AS b, left(p_name, 6) || CASE WHEN length(p_name) > 6 THEN '…' ELSE '' END AS label FROM n JOIN part ON p_partkey = n.id
UNION ALL SELECT 'edge', 'p' || src, 'p' || dst, CAST(weight AS VARCHAR) FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)
""")
def ego_graph(t: Tables) -> DataFrame:
    """The nodes around a node with labels cut short, and the edges among them, each once."""
    of = lambda *ids: G.edges_between(t.lineitem, "l_orderkey", "l_partkey", *ids)
    around = of(t.spark.range(10, 11)).select(F.col("dst").alias("id")).union(t.spark.range(10, 11))
    name = lambda x: F.concat(F.lit("p"), F.col(x).cast("string"))
    label = F.concat(F.left("p_name", F.lit(6)), F.when(F.length("p_name") > 6, "…").otherwise(""))
    nodes = around.join(t.part, F.col("id") == F.col("p_partkey")).select(F.lit("node").alias("part"), name("id").alias("a"), F.lit(None).cast("string").alias("b"), label.alias("label"))
    inside = of(around, around).where("src < dst")
    return nodes.unionByName(inside.select(F.lit("edge").alias("part"), name("src").alias("a"), name("dst").alias("b"), F.col("weight").cast("string").alias("label")))


@query("""
WITH s AS (SELECT p_partkey, p_name AS a, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand || ' ' || p_type END AS b, p_type AS c FROM part)
SELECT p_partkey AS id, round(100.0 * (CAST(length(trim(a)) >= 10 AS INTEGER) + CAST(length(trim(coalesce(nullif(b, ''), c))) >= 10 AS INTEGER)) / 2, 1) AS score,
       list_filter([CASE WHEN length(trim(a)) < 10 THEN 'title' END, CASE WHEN length(trim(coalesce(nullif(b, ''), c))) < 10 THEN 'notice' END], lambda x: x IS NOT NULL) AS missing,
       contains(a, 'red') OR 100.0 * (CAST(length(trim(a)) >= 10 AS INTEGER) + CAST(length(trim(coalesce(nullif(b, ''), c))) >= 10 AS INTEGER)) / 2 < 80 AS refused FROM s
""")
def collection_check(t: Tables) -> DataFrame:
    """The first source that has a field gives it; fields of ten characters at least; refused under 80 % or by a veto."""
    first = F.coalesce(F.nullif(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat("p_brand", F.lit(" "), "p_type")), F.lit("")), F.col("p_type"))
    score, missing = R.collected({"title": F.col("p_name"), "notice": first})
    return t.part.select(F.col("p_partkey").alias("id"), score.alias("score"), missing.alias("missing"), (F.contains("p_name", F.lit("red")) | (score < 80)).alias("refused"))


@query("""
SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 1.0 WHEN p_size <= 20 OR NOT (nullif(p_brand, 'Brand#1') <> '' AND p_type <> '') IS TRUE THEN CASE WHEN p_size > 20 THEN 0.6 ELSE 0.3 END + CASE WHEN nullif(p_brand, 'Brand#1') IS NULL THEN 0 ELSE 0.2 END ELSE 0.8 END AS evidence,
       CASE WHEN contains(p_name, 'gear') THEN 'drive' WHEN contains(p_name, 'ring') THEN 'seal' ELSE 'other' END AS family,
       list_sort(list_filter([CASE WHEN contains(p_name, 'red') OR contains(p_name, 'hot') THEN 'warm' END, CASE WHEN contains(p_name, 'bolt') THEN 'fastener' END], lambda x: x IS NOT NULL)) AS flags,
       coalesce(CASE WHEN p_size % 4 = 0 THEN p_brand END, CASE WHEN contains(p_name, 'rod') THEN 'pushes' WHEN contains(p_name, 'plate') THEN 'covers' END, CASE p_type WHEN 'PROMO' THEN 'major' ELSE 'minor' END) AS mechanism FROM part
""")
def interaction_scores(t: Tables) -> DataFrame:
    """Scores of evidence, families by the first keyword, flags by markers, and texts filled where there are none."""
    level = F.when(F.col("p_size") > 40, "high").when(F.col("p_size") > 20, "medium")
    severity = F.when(F.col("p_type") == "PROMO", "major").otherwise("minor")
    return t.part.select(F.col("p_partkey").alias("id"), R.evidence(level, F.nullif(F.col("p_brand"), F.lit("Brand#1")), F.col("p_type")).alias("evidence"), R.first_rule(F.col("p_name"), [("gear", "drive"), ("ring", "seal")], "other").alias("family"),
                         R.flags(F.col("p_name"), {"warm": ("red", "hot"), "fastener": ("bolt",)}).alias("flags"),
                         R.filled(F.when(F.col("p_size") % 4 == 0, F.col("p_brand")).otherwise(""), F.col("p_name"), [("rod", "pushes"), ("plate", "covers")], severity, {"major": "major", "minor": "minor"}).alias("mechanism"))


@query("""
SELECT c_custkey AS patient, CASE WHEN age >= 90 THEN '90+' ELSE CAST(age // 10 * 10 AS VARCHAR) || '-' || CAST(age // 10 * 10 + 9 AS VARCHAR) END AS band, m AS month FROM (SELECT c_custkey, c_custkey % 100 AS age, (SELECT max(strftime(o_orderdate, '%Y-%m')) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer)
""")
def deidentified(t: Tables) -> DataFrame:
    """Dates to months, ages to bands."""
    months = t.orders.groupBy("o_custkey").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM").alias("month"))
    return t.customer.join(months, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("patient"), R.age_band(F.col("c_custkey") % 100).alias("band"), "month")


@query("""
WITH m AS (SELECT user_id, event_type AS measure, max(value) AS value FROM events GROUP BY ALL),
r AS (SELECT * FROM (VALUES ('pressure', 1, 'view', 200.0), ('pressure', 2, 'click', 150.0), ('sugar', 1, 'purchase', 250.0)) r(rule, place, measure, least))
SELECT user_id, rule, place, measure, value FROM (SELECT m.user_id, r.rule, r.place, measure, value, row_number() OVER (PARTITION BY user_id, rule ORDER BY place) AS k FROM m JOIN r USING (measure) WHERE value >= least) WHERE k = 1
""")
def first_crossed(t: Tables) -> DataFrame:
    """of each rule's conditions the first that is crossed fires, once."""
    measures = t.events.groupBy("user_id", F.col("event_type").alias("measure")).agg(F.max("value").alias("value"))
    rules = t.spark.createDataFrame([("pressure", 1, "view", 200.0), ("pressure", 2, "click", 150.0), ("sugar", 1, "purchase", 250.0)], "rule string, place int, measure string, least double")
    return P.first_crossed(measures, rules, ["user_id"]).select("user_id", "rule", "place", "measure", "value")


@query("""
SELECT doc_id, CASE WHEN regexp_matches(head, '^(the|and) ') OR length(head) < 6 OR replace(head, ' ', '') = 'thion' THEN 'extraction fault' ELSE 'changed source' END AS kind FROM (SELECT doc_id, lower(trim(split_part(text, chr(10), 1))) AS head FROM documents)
""")
def divergence_kinds(t: Tables) -> DataFrame:
    """a title that an extraction broke, or a change at the source."""
    head = F.lower(F.trim(F.split("text", "\n")[0]))
    return t.documents.select("doc_id", P.divergence(head, F.lit("thion"), "^(the|and) ").alias("kind"))


@query("""
SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role = 'user' AND length(text) > 40) WHERE k <= 2
""")
def visible_comments(t: Tables) -> DataFrame:
    """what a role may see, published only, newest first."""
    rows = t.conversations.select("conv_id", "turn", "text", F.array("role").alias("visibility"), (F.length("text") > 40).alias("published"))
    return keep_best(P.visible(rows, "visibility", "user", "published"), ["conv_id"], F.desc("turn"), k=2).select("conv_id", "turn", "text")


@query("""
SELECT p_partkey AS id, list_position(['red', 'hot', 'new'], split_part(p_name, ' ', 1)) AS place, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'unknown' END AS label FROM part WHERE split_part(p_name, ' ', 1) IN ('red', 'hot', 'new')
""")
def curated_order(t: Tables) -> DataFrame:
    """The position in a curated list decides the order."""
    first = F.split("p_name", " ")[0]
    return S.in_order_of(t.part.withColumn("word", first), "word", ["red", "hot", "new"]).select(F.col("p_partkey").alias("id"), F.col("place").cast("int").alias("place"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("unknown").alias("label"))


@query("""
SELECT item_id, text_date, CASE WHEN d BETWEEN 1 AND 31 THEN 20240000 + m * 100 + d ELSE 0 END AS key FROM (SELECT item_id, item_id % 12 + 1 AS m, item_id % 28 + 1 AS d, lpad(CAST(item_id % 28 + 1 AS VARCHAR), 2, '0') || '/' || lpad(CAST(item_id % 12 + 1 AS VARCHAR), 2, '0') || '/2024' AS text_date FROM benchmark)
""")
def probe_dates(t: Tables) -> DataFrame:
    """A date in the bytes of a page, of whatever encoding, and its key."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    day, month = F.col("item_id") % 28 + 1, F.col("item_id") % 12 + 1
    raw = F.encode(F.concat(F.lit("é ANSM - Mis à jour le : "), two(day), F.lit("/"), two(month), F.lit("/2024 x")), "iso-8859-1")
    return t.benchmark.select("item_id", date_in(raw).alias("text_date")).withColumn("key", X.date_key(F.col("text_date")))
