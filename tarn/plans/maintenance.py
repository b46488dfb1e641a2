"""Incremental maintenance and the work queue over the tables: orders stand in for records, their even part for what is stored and their odd
part for what comes in; events stand in for jobs and actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators import graph as G
from tarn.operators import windows as W
from tarn.operators.windows import keep_best
from tarn.plans import sync as Y
from tarn.plans.registry import Tables, query
from tarn.sources import sinks as K
from tarn.streaming import jobs as J


def stored(t: Tables) -> DataFrame:
    """What the store has: all but every fifth record, with a status of its own."""
    return t.orders.where("o_orderkey % 5 != 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("price"), F.lit("old").alias("origin"))


def incoming(t: Tables) -> DataFrame:
    """What comes in: every third record twice, the later row with another price; a state is missing where the key ends in 9."""
    one = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 10 != 9, F.col("o_orderpriority")).alias("state"), F.col("o_totalprice").alias("price"), F.lit("new").alias("origin"), F.lit(0).alias("seq"))
    return one.unionByName(one.withColumns({"price": F.col("price") + 1, "seq": F.lit(1)}))


IN_SQL = """
old AS (SELECT o_orderkey AS id, o_orderstatus AS state, o_totalprice AS price, 'old' AS origin FROM orders WHERE o_orderkey % 5 <> 0),
new AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 <> 9 THEN o_orderpriority END AS state, o_totalprice + 1 AS price, 'new' AS origin FROM orders WHERE o_orderkey % 3 = 0)"""


@query(f"""
WITH {IN_SQL} SELECT coalesce(old.id, new.id) AS id, CASE WHEN new.id IS NULL THEN old.state ELSE new.state END AS state, CASE WHEN new.id IS NULL THEN old.price ELSE new.price END AS price, coalesce(old.origin, new.origin) AS origin FROM old FULL JOIN new ON old.id = new.id
""")
def keyed_upsert(t: Tables) -> DataFrame:
    """The batch's last row of a key wins; columns that are set on insertion only stay."""
    return Y.upsert(stored(t), incoming(t), ["id"], ["origin"], F.desc("seq")).select("id", "state", "price", "origin")


@query(f"WITH {IN_SQL} SELECT old.id, coalesce(nullif(old.state, 'P'), new.state) AS state, old.price, old.origin FROM old LEFT JOIN new ON old.id = new.id")
def keep_first_values(t: Tables) -> DataFrame:
    """A value that is there stays; one that is missing is filled."""
    own = stored(t).withColumn("state", F.nullif(F.col("state"), F.lit("P")))
    return Y.keep_first(own, incoming(t), ["id"], ["state"]).select("id", "state", "price", "origin")


@query("SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, l_returnflag AS kind FROM lineitem")
def edges_with_properties(t: Tables) -> DataFrame:
    """Other properties make another edge; equal ones are one."""
    e = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind"))
    return Y.merge_edges(e.where("kind != 'R'"), e)


@query("SELECT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst, max(l_quantity) AS weight FROM lineitem GROUP BY ALL")
def undirected_merge(t: Tables) -> DataFrame:
    """One edge for each unordered pair."""
    e = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("weight"))
    return G.canonical(e).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


FIELDS, ALLOWED = ["state", "price", "origin"], ["state", "price"]
PLAN_SQL = f"""
{IN_SQL},
j AS (SELECT coalesce(old.id, new.id) AS id, CASE WHEN old.id IS NULL THEN 'created' WHEN new.id IS NULL THEN 'withdrawn' ELSE 'known' END AS side, old.state AS s0, new.state AS s1, old.price AS p0, new.price AS p1, old.origin AS o0, new.origin AS o1 FROM old FULL JOIN new ON old.id = new.id),
f AS (SELECT id, side AS state, 'state' AS path, s0 AS x, s1 AS y, s0 IS DISTINCT FROM s1 AS d FROM j UNION ALL SELECT id, side, 'price', NULL, NULL, p0 IS DISTINCT FROM p1 FROM j UNION ALL SELECT id, side, 'origin', o0, o1, o0 IS DISTINCT FROM o1 FROM j)"""


def changes(t: Tables) -> DataFrame:
    return Y.plan(stored(t), incoming(t).where("seq = 1").drop("seq"), "id", FIELDS, ALLOWED)


@query(f"WITH {PLAN_SQL} SELECT id, path, state, CASE WHEN path = 'origin' THEN 'rejected' ELSE 'change' END AS verdict, x AS before, y AS after FROM f WHERE d")
def change_plan(t: Tables) -> DataFrame:
    """What would change, created and withdrawn records too, with the verdict of the list of fields. Prices are left out of the texts."""
    text = lambda c: F.when(F.col("path") != "price", F.col(c)).alias(c)
    return changes(t).select("id", "path", "state", "verdict", text("before"), text("after"))


@query(f"WITH {PLAN_SQL} SELECT id, count(*) FILTER (path <> 'origin') AS changes, count(*) FILTER (path = 'origin') AS rejected, count(*) FILTER (path <> 'origin') > 0 AS would_write FROM f WHERE d GROUP BY id")
def plan_summary(t: Tables) -> DataFrame:
    """A record's changes, rejections, and whether anything would be written."""
    return Y.summary(changes(t), "id").select("id", "changes", "rejected", "would_write")


@query("SELECT unnest(['a change outside the list', 'a rejection inside the list', 'an unknown path', 'a change that changes nothing', 'a path twice']) AS rule, 0 AS n")
def plan_invariants(t: Tables) -> DataFrame:
    """Five rules that no plan breaks."""
    return Y.broken_invariants(changes(t), "id", FIELDS, ALLOWED)


@query(f"WITH {IN_SQL} SELECT old.id, CASE WHEN new.id IS NULL THEN old.state ELSE new.state END AS state, CASE WHEN new.id IS NULL THEN old.price ELSE new.price END AS price, old.origin FROM old LEFT JOIN new ON old.id = new.id")
def plan_applied(t: Tables) -> DataFrame:
    """The table after the plan; to missing is a change."""
    return Y.apply_plan(stored(t), changes(t).where("state = 'known'"), "id", ["state", "price"]).select("id", "state", "price", "origin")


@query("SELECT o_orderkey AS id, o_orderstatus AS state, o_totalprice AS price, 'old' AS origin FROM orders WHERE o_orderkey % 5 <> 0")
def plan_rolled_back(t: Tables) -> DataFrame:
    """The history of the plan takes the table back to what it was."""
    known = changes(t).where("state = 'known'")
    after = Y.apply_plan(stored(t), known, "id", ["state", "price"])
    return Y.roll_back(after, Y.history(known, "id", F.lit(1)), "id", ["state", "price"]).select("id", "state", "price", "origin")


@query("""
SELECT p_partkey AS id, field, official, local FROM (SELECT p_partkey, 'title' AS field, p_name AS official, CASE WHEN p_size % 3 = 0 THEN upper(replace(p_name, ' ', '-')) WHEN p_size % 3 = 1 THEN p_name ELSE p_name || 'x' END AS local, lower(p_name) AS a FROM part
  UNION ALL SELECT p_partkey, 'status', nullif(p_type, 'PROMO'), lower(p_type), NULL FROM part) WHERE official IS NOT NULL AND (field = 'status' OR ends_with(local, 'x') AND local <> official)
""")
def normalised_divergences(t: Tables) -> DataFrame:
    """Titles differ by their normal form, administrative values exactly; what the official side lacks is no divergence."""
    name, rest = F.col("p_name"), F.col("p_size") % 3
    local = F.when(rest == 0, F.upper(F.replace(name, F.lit(" "), F.lit("-")))).when(rest == 1, name).otherwise(F.concat(name, F.lit("x")))
    return Y.divergences(t.part.select(F.col("p_partkey").alias("id"), name.alias("title"), F.nullif(F.col("p_type"), F.lit("PROMO")).alias("status")), t.part.select(F.col("p_partkey").alias("id"), local.alias("title"), F.lower("p_type").alias("status")), "id", ["title"], ["status"])


@query("""
WITH n AS (SELECT (SELECT count(*) FROM orders) AS expected, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS a, (SELECT count(*) FROM orders WHERE o_totalprice > 100000) AS b)
SELECT store, n, expected, expected - n AS gap FROM (SELECT 'index' AS store, a AS n, expected FROM n UNION ALL SELECT 'graph', b, expected FROM n)
""")
def store_convergence(t: Tables) -> DataFrame:
    """Counts of derived stores against their source."""
    return Y.convergence(t.orders, {"index": t.orders.where("o_orderstatus != 'P'"), "graph": t.orders.where("o_totalprice > 100000")})


@query("""
SELECT measure, value, "limit", level FROM (SELECT event_type AS measure, max(value) AS value FROM events GROUP BY 1) m JOIN (VALUES ('error', 10.0, 'critical'), ('click', 100000.0, 'warning'), ('view', 50.0, 'warning')) r(measure, "limit", level) USING (measure) WHERE value > "limit"
""")
def alerts_over_limits(t: Tables) -> DataFrame:
    """Measures beyond their limits."""
    measures = t.events.groupBy(F.col("event_type").alias("measure")).agg(F.max("value").alias("value"))
    return Y.alerts(measures, {"error": (10.0, "critical"), "click": (100000.0, "warning"), "view": (50.0, "warning")})


@query("""
WITH a AS (SELECT user_id, CAST(value AS BIGINT) % 10 AS item, event_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'toggle' END AS action FROM events),
g AS (SELECT *, max(CASE WHEN action = 'delete' THEN event_id END) OVER (PARTITION BY user_id, item) AS gone FROM a)
SELECT user_id, item FROM g WHERE gone IS NULL OR event_id > gone GROUP BY ALL HAVING count(*) FILTER (action = 'toggle') % 2 = 1
""")
def favourites(t: Tables) -> DataFrame:
    """A log of toggles and deletes gives the favourites that are set. Casts of values round half to even in the statement, so items come
    from rounded values here too."""
    log = t.events.select("user_id", (F.bround("value", 0).cast("long") % 10).alias("item"), F.when(F.col("event_type") == "error", "delete").otherwise("toggle").alias("action"), "ts", "event_id")
    return Y.last_state(log, ["user_id", "item"], "action", "ts", "event_id")


@query("""
WITH j AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 4 = 0 THEN 'running' ELSE 'pending' END AS state, CAST(event_id % 7 AS INTEGER) AS priority, event_id % 50 AS available, event_id % 90 AS lease FROM events)
SELECT user_id, event_id AS job_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, event_id) AS k FROM j WHERE (state = 'pending' AND available <= 30) OR (state = 'running' AND lease < 40)) WHERE k = 1
""")
def jobs_to_reserve(t: Tables) -> DataFrame:
    """The job to reserve for each worker group: due, or running under a lapsed lease; highest priority, then oldest."""
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 4 == 0, "running").otherwise("pending")
    jobs = t.events.select("user_id", F.col("event_id").alias("job_id"), state.alias("state"), (F.col("event_id") % 7).cast("int").alias("priority"), (F.col("event_id") % 50).alias("available_at"), (F.col("event_id") % 90).alias("lease_until"), F.col("event_id").alias("created_at"))
    return J.reservable(jobs, 30, ["user_id"], lapsed=40).select("user_id", "job_id", "priority")


@query("""
SELECT event_id AS job_id, CASE WHEN tries >= 3 THEN 'failed' ELSE 'pending' END AS state, CASE WHEN tries < 3 THEN CASE tries WHEN 0 THEN 60 WHEN 1 THEN 60 WHEN 2 THEN 300 END END AS wait FROM (SELECT event_id, CAST(event_id % 5 AS INTEGER) AS tries FROM events WHERE event_type = 'error')
""")
def retry_delays(t: Tables) -> DataFrame:
    """Failed attempts wait 60, 300 and 1,500 seconds; the third one ends the job."""
    tries = (F.col("event_id") % 5).cast("int")
    return t.events.where("event_type = 'error'").select(F.col("event_id").alias("job_id"), *J.after_failure(tries))


@query("""
SELECT event_id AS job_id, CASE WHEN event_id % 3 = 0 AND event_id % 100 < 60 THEN CASE WHEN event_type = 'click' THEN 'done' ELSE 'running' END ELSE 'refused' END AS outcome FROM events
""")
def holder_actions(t: Tables) -> DataFrame:
    """Extending and completing count only from the holder under a live lease."""
    held = J.holds(F.when(F.col("event_id") % 3 == 0, "w1").otherwise("w2"), F.lit("w1"), F.col("event_id") % 100, F.lit(60))
    return t.events.select(F.col("event_id").alias("job_id"), F.when(~held, "refused").when(F.col("event_type") == "click", "done").otherwise("running").alias("outcome"))


@query("SELECT event_id AS job_id, CASE WHEN event_type IN ('error', 'purchase') THEN 'pending' ELSE event_type END AS state, CASE WHEN event_type IN ('error', 'purchase') THEN 0 ELSE CAST(event_id % 5 AS INTEGER) END AS attempts FROM events")
def jobs_rearmed(t: Tables) -> DataFrame:
    """Only jobs that have ended are armed again."""
    jobs = t.events.select(F.col("event_id").alias("job_id"), F.col("event_type").alias("state"), (F.col("event_id") % 5).cast("int").alias("attempts"))
    return J.rearm(jobs, ("error", "purchase"))


@query("""
SELECT page_id, CASE WHEN s >= 500 THEN 'error' WHEN s = 404 THEN 'withdrawn' WHEN found IS NULL THEN 'broken' WHEN found = known THEN 'unchanged' ELSE 'changed' END AS state FROM (
  SELECT page_id, CASE page_id % 7 WHEN 0 THEN 500 WHEN 1 THEN 404 ELSE 200 END AS s, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS found, CASE WHEN page_id % 2 = 0 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) ELSE 'other' END AS known FROM pages)
""")
def probe_states(t: Tables) -> DataFrame:
    """What a probe of a page says of the record that it feeds."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    status = F.when(F.col("page_id") % 7 == 0, 500).when(F.col("page_id") % 7 == 1, 404).otherwise(200)
    return t.pages.select("page_id", Y.probe_state(F.when(F.col("page_id") % 2 == 0, title).otherwise("other"), F.nullif(title, F.lit("")), status).alias("state"))


@query("""
SELECT 'scrape:' || o_orderkey AS job_id, CASE WHEN o_orderkey % 5 <> 0 THEN 'known' ELSE 'pending' END AS state FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 5 <> 0 AND o_orderstatus = 'F'
""")
def detected_and_enqueued(t: Tables) -> DataFrame:
    """What was detected is enqueued once; jobs that are there keep their state."""
    job = lambda df, state: df.select(F.concat(F.lit("scrape:"), F.col("o_orderkey").cast("string")).alias("job_id"), F.lit(state).alias("state"))
    queue, found = job(t.orders.where("o_orderkey % 5 != 0 AND o_orderstatus IN ('P', 'F')"), "known"), job(t.orders.where("o_orderstatus = 'P'"), "pending")
    return Y.upsert(queue, found, ["job_id"], ["state"])


@query("SELECT p_partkey, p_name FROM part WHERE p_size % 4 <> 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0)")
def to_do(t: Tables) -> DataFrame:
    """What has no record of having been done."""
    done = t.lineitem.where("l_discount = 0").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.where("p_size % 4 != 0").join(done, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("""
WITH m AS (SELECT p_name AS source, upper(p_name) AS target FROM part WHERE p_size % 2 = 0 GROUP BY ALL)
SELECT p_partkey, coalesce(target, p_name) AS title, target IS NOT NULL AS translated FROM part LEFT JOIN m ON trim(p_name) = source
""")
def translations_applied(t: Tables) -> DataFrame:
    """A table of texts applied to records; unknown text stays."""
    table = t.part.where("p_size % 2 = 0").select(F.col("p_name").alias("source")).distinct().withColumn("target", F.upper("source"))
    out = t.part.join(table, F.trim("p_name") == F.col("source"), "left")
    return out.select("p_partkey", F.coalesce("target", "p_name").alias("title"), F.col("target").isNotNull().alias("translated"))


@query("SELECT source, min(k) AS kind FROM (SELECT p_name AS source, 0 AS k FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_name, 1 FROM part) GROUP BY source")
def cached_pairs(t: Tables) -> DataFrame:
    """Only pairs that aren't there yet are added."""
    have = t.part.where("p_size % 2 = 0").select(F.col("p_name").alias("source")).distinct().withColumn("kind", F.lit(0))
    return Y.upsert(have, t.part.select(F.col("p_name").alias("source")).distinct().withColumn("kind", F.lit(1)), ["source"], ["kind"])


@query("""
SELECT round(100.0 * sum(CASE WHEN translated IS NOT NULL THEN n ELSE 0 END) / sum(n), 1) AS covered, count(*) AS patterns FROM (SELECT p_name, count(*) AS n, CASE WHEN regexp_matches(p_name, '^(red|hot) (gear|ring)$') THEN 'x' END AS translated FROM part GROUP BY p_name)
""")
def translation_coverage(t: Tables) -> DataFrame:
    """How much of all texts the templates translate; a text that isn't all translated counts for none of it."""
    made = X.by_template(F.col("p_name"), [(r"^(\w+) (\w+)$", "{2} {1}")], {"red": "rouge", "hot": "chaud", "gear": "roue", "ring": "bague"})
    counted = t.part.groupBy("p_name").agg(F.count("*").alias("n")).withColumn("made", made)
    return counted.agg(F.round(100.0 * F.sum(F.when(F.col("made").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n"), 1).alias("covered"), F.count("*").alias("patterns"))


@query("""
SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^(red|hot) (gear|ring)$') THEN CASE split_part(p_name, ' ', 2) WHEN 'gear' THEN 'roue' ELSE 'bague' END || ' ' || CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'rouge' ELSE 'chaud' END END AS made FROM part
""")
def template_translation(t: Tables) -> DataFrame:
    """C14: the first template that a text fits, its parts by a glossary; null unless all parts are known."""
    return t.part.select("p_partkey", X.by_template(F.col("p_name"), [(r"^(\w+) (\w+)$", "{2} {1}")], {"red": "rouge", "hot": "chaud", "gear": "roue", "ring": "bague"}).alias("made"))


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_record(t: Tables) -> DataFrame:
    """The record that stands for its owner: the latest."""
    return keep_best(t.orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))


@query("""
WITH n AS (SELECT count(*) AS expected FROM embeddings) SELECT v.version, n.expected, CASE v.version WHEN 'short' THEN (SELECT count(*) FROM embeddings WHERE vec_id % 97 <> 0) ELSE n.expected END AS actual, v.version = 'whole' AS ok FROM n, (VALUES ('whole'), ('short'), ('changed'), ('swapped')) v(version)
""")
def rebuild_gates(t: Tables) -> DataFrame:
    """Whether an index that was built anew may replace its source: equal counts and equal rows. Versions are whole, short, with a changed row, and with a row in place of another."""
    rows = K.vectors(t.embeddings, "vec_id", "embedding", "label")
    first, second = t.embeddings.agg(F.min("vec_id").alias("k")), t.embeddings.where("vec_id > 0").agg(F.min("vec_id").alias("k"))
    doubled = t.embeddings.join(second, F.col("vec_id") == F.col("k"), "left_anti").unionByName(t.embeddings.join(first, F.col("vec_id") == F.col("k"), "left_semi"))
    short = t.embeddings.where("vec_id % 97 != 0")
    versions = {"whole": rows.repartition(3, "point"), "short": K.vectors(short, "vec_id", "embedding", "label"), "changed": rows.withColumn("label", F.when(F.col("point") % 7 == 0, F.col("label") + 1).otherwise(F.col("label"))), "swapped": K.vectors(doubled, "vec_id", "embedding", "label")}
    return K.gates(rows, versions)


_CRAWL_SQL = """
p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url, html, page_id >= (SELECT (max(page_id) + 1) // 2 FROM pages) AS now FROM pages),
l AS (SELECT now, url, arg_max(html, page_id) AS html FROM p WHERE contains(coalesce(url, ''), '://') GROUP BY now, url),
s AS (SELECT coalesce(a.url, b.url) AS url, CASE WHEN b.url IS NULL THEN 'withdrawn' WHEN NOT contains(coalesce(b.html, ''), '</html>') THEN 'broken' WHEN a.url IS NULL THEN 'created' WHEN md5(a.html) = md5(b.html) THEN 'unchanged' ELSE 'changed' END AS state
  FROM (SELECT * FROM l WHERE NOT now) a FULL JOIN (SELECT * FROM l WHERE now) b ON a.url = b.url
  UNION ALL SELECT url, 'error' FROM p WHERE now AND NOT contains(coalesce(url, ''), '://'))"""


def crawled(t: Tables) -> DataFrame:
    """The pages of an earlier and of a later crawl (the lower and the upper half of ids) by address without its query: the last page of each, and its state."""
    half = t.pages.agg(F.floor((F.max("page_id") + 1) / 2).alias("half"), F.lit(1).alias("g"))
    rows = t.pages.select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"), "html", F.lit(1).alias("g")).join(half, "g").withColumn("now", F.col("page_id") >= F.col("half"))
    sound = F.contains(F.coalesce("url", F.lit("")), F.lit("://"))
    last = rows.where(sound).groupBy("now", "url").agg(F.max_by(F.struct(F.md5(F.col("html").cast("binary")).alias("hash"), F.contains(F.coalesce("html", F.lit("")), F.lit("</html>")).alias("whole")), "page_id").alias("p")).select("now", "url", "p.*")
    states = Y.probed(last.where("NOT now").drop("now"), last.where("now").drop("now"), "url")
    return states.unionByName(rows.where(F.col("now") & ~sound).select("url", F.lit("error").alias("state")))


@query(f"WITH {_CRAWL_SQL} SELECT url, state FROM s")
def crawl_states(t: Tables) -> DataFrame:
    """What became of each address between two crawls: changed, unchanged, withdrawn, created, broken, in error."""
    return crawled(t)


@query(f"WITH {_CRAWL_SQL} SELECT state, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS rate FROM s GROUP BY state")
def crawl_rates(t: Tables) -> DataFrame:
    """How many addresses are in each state, and their share."""
    counted = crawled(t).groupBy("state").agg(F.count("*").alias("n"))
    return Y.rated(counted, "n")


@query("SELECT vec_id, CAST(('0x' || substr(sha256(CAST(vec_id AS VARCHAR)), 1, 16))::UHUGEINT % 9223372036854775808::UHUGEINT AS BIGINT) AS point, len(embedding) AS size FROM embeddings")
def vector_records(t: Tables) -> DataFrame:
    """Records for a vector store with ids that are the same in every run."""
    return K.vectors(t.embeddings, "vec_id", "embedding", "vec_id").select("vec_id", "point", F.size("vector").cast("long").alias("size"))


@query()
def seeded_sample(t: Tables) -> DataFrame:
    """A hundred rows at random, the same in every run."""
    return K.sample_of(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 100)


@query("""
WITH RECURSIVE w AS (SELECT text, row_number() OVER (ORDER BY length(text), text) AS k FROM (SELECT DISTINCT unnest([p_name, p_type, p_brand]) AS text FROM part) WHERE text NOT IN (SELECT p_name FROM part WHERE p_size % 2 = 0)),
l(k, text, lot, held) AS (SELECT k, text, CAST(0 AS BIGINT), CAST(length(text) AS BIGINT) FROM w WHERE k = 1
  UNION ALL SELECT w.k, w.text, CASE WHEN held + length(w.text) > 400 THEN lot + 1 ELSE lot END, CASE WHEN held + length(w.text) > 400 THEN length(w.text) ELSE held + length(w.text) END FROM l JOIN w ON w.k = l.k + 1)
SELECT text, lot FROM l
""")
def texts_in_lots(t: Tables) -> DataFrame:
    """The distinct texts of several columns that a cache lacks, packed by length into lots of 400 characters at most."""
    every = t.part.select(F.explode(F.array("p_name", "p_type", "p_brand")).alias("text")).distinct()
    cached = t.part.where("p_size % 2 = 0").select(F.col("p_name").alias("text"))
    return W.lots(every.join(cached, "text", "left_anti"), "text", 400)
