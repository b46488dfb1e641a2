"""Steps whose work follows their input, against plain Python on small odd tables."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from tarn.operators import containment as B
from tarn.operators import elastic as L
from tarn.operators import graph as G
from tarn.plans import graphs, queries, readers
from tarn.plans.registry import Tables
from tarn.sources import files as S
from tarn.sources import pages as H


def rows(spark, folder, name):
    return sorted(tuple(r) for r in queries.queries()[name](spark, str(folder)).collect())


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_alternatives_pair_no_row_with_all_of_its_maker(spark, tmp_path):
    """The product asked for interacts with all of one title and with the first of another; names of one word have a kind, too."""
    names = {50: "red gear", 1: "a gear", 2: "a gear", 3: "b gear", 4: "b gear", 5: "c gear", 6: "plain", 7: "red gear", 100: "plain", 8: None, 9: "d gear"}
    spark.createDataFrame([(k, x, "m" if k != 9 else None) for k, x in names.items()], "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    orders = {1: [50, 1], 2: [50, 2, 3], 3: [4, 5]}
    spark.createDataFrame([(o, p) for o, parts in orders.items() for p in parts], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    same = lambda own: [(x, min(k for k in names if names[k] == x)) for x in sorted({x for k, x in names.items() if x and x != own and k != 9})]
    got = rows(spark, tmp_path, "alternatives")
    assert got == sorted([(50, x, k, 0, i) for i, (x, k) in enumerate(same("red gear"), 1)] + [(50, "d gear", 9, 1, 5)] + [(100, x, k, 0, i) for i, (x, k) in enumerate(same("plain"), 1)])


def test_lines_are_never_broadcast(spark):
    """Titles are, as they are few; the lines' keys are many times what their files let one expect."""
    titles, lines = spark.range(5000).selectExpr("concat('t', id) AS t"), spark.range(10).selectExpr("concat('T', id, ' x') AS l")
    df = B.prefix_join(titles, "t", lines, "l")
    assert df.count() == 10 and "BuildRight" not in df._jdf.queryExecution().executedPlan().toString()
    few = B.prefix_join(titles.limit(3), "t", lines, "l")
    assert few.count() == 3 and "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()


def test_references_end_with_a_semicolon(spark):
    pages = spark.createDataFrame([(1, "<h1>a&amp;b&amp</h1><p class='x&y'>&copy; R&D &lt;x&gt; &#65;&#x42; &nosuch; &amp;lt; &</p>")], "page_id long, html string")
    (r,) = H.html_sections(pages, "page_id", "html").where("section = 1").collect()
    assert r["title"] == "a&b&amp" and [c["text"] for c in r["content"]] == ["© R&D <x> AB &nosuch; &lt; &"]


def test_edges_are_dealt_by_the_rows_of_their_table(spark, sf, monkeypatch):
    t = Tables(spark, sf)
    monkeypatch.setattr(G, "TASK_ROWS", 500)
    e = graphs.edges(t)
    assert plan(e).count(f"RepartitionByExpression [l_orderkey") == 2 and f", {-(-t.lineitem.count() // 500)}" in plan(e)
    assert "Expand" not in plan(queries.queries()["undirected_degree"](spark, sf))


def test_lines_of_one_number_still_count_for_their_edge(spark, tmp_path):
    spark.createDataFrame([(1, 5, 1), (1, 6, 1), (1, 5, 2), (2, 5, 3), (2, 6, 1), (None, 5, 1), (3, None, 1)], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert rows(spark, tmp_path, "prescription_pairs") == [(1, 1, 2, 2), (2, 1, 3, 2)]


def test_labels_meet_drugs_once_by_their_sets_of_names(spark):
    labels = spark.createDataFrame([("L1", "A ", "b"), ("L1", "a", None), ("L2", "", "c"), ("L3", "x", "x")], "spl_id string, generic_name string, brand_name string")
    drugs = spark.createDataFrame([("D1", "a", "B", "b"), ("D2", "c", "", None), ("D2", "A", "", "c")], "id string, title string, generic_name string, brand_name string")
    df = S.label_edges(labels, drugs)
    assert sorted(map(tuple, df.collect())) == [("L1", "D1"), ("L1", "D2"), ("L2", "D2")] and not plan(df).startswith("Aggregate")


def test_a_title_is_scored_once(spark):
    titles = spark.createDataFrame([(i, "gizmo blue") for i in range(5)], "id long, title string")
    df = L.similar(titles, "id", "title", "gizmoo blu")
    assert [(r["id"], r["similarity"] > 0.6) for r in df.orderBy("id").collect()] == [(i, True) for i in range(5)] and "Aggregate [title" in plan(df)


def test_names_of_substances_are_worked_out_step_by_step(spark):
    df = spark.createDataFrame([(["Sel de sodium bicarbonate ..... 3 mg", "solution de zinc ..... 1 g", "Contient 3 mg de fer et 5 mg de cuivre (base)."],)], "x array<string>").select(H.composition(F.col("x")).alias("s"))
    assert df.first()["s"] and plan(df).count("regexp_replace") < 40


def test_sections_leave_a_task_in_batches(spark):
    texts = [(i, "1. A\n" + "word " * 30_000 + "\n2. B\nend") for i in range(60)]
    df = H.plan_sections(spark.createDataFrame(texts, "id long, text string").coalesce(1), "id", "text")
    assert H.BATCH_CHARS <= 1 << 20 and sorted((r["id"], r["number"]) for r in df.select("id", "number").collect()) == [(i, n) for i in range(60) for n in "12"]


def test_files_of_orders_grow_in_number(spark, sf, monkeypatch):
    monkeypatch.setattr(readers, "FILE_ORDERS", 50)
    df = queries.queries()["json_arrays"](spark, sf)
    assert len(df.inputFiles()) > 20 and df.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_pairs_of_every_product(spark, tmp_path, monkeypatch):
    """No product is left out for its id, in however many blocks a name's products are joined."""
    monkeypatch.setattr(G, "BLOCK", 3)
    parts = [(k, "n" if k % 2 else None if k == 8 else "m", "B", "ECONOMY" if k < 6 else "PROMO") for k in range(1, 12)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 1), (1, 3), (1, 9), (2, 2), (2, 7)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    linked = {frozenset(x) for x in ((1, 3), (1, 9), (3, 9), (2, 7))}
    name = {p[0]: p[1] for p in parts}
    assert rows(spark, tmp_path, "shared_neighbor_alternatives") == sorted((a, b, name[a]) for a in name for b in name if a != b and name[a] and name[a] == name[b] and frozenset((a, b)) not in linked)
    assert rows(spark, tmp_path, "class_pairs") == sorted((a, b, "major") for a in range(1, 6) for b in range(6, 12) if frozenset((a, b)) not in linked)


def test_pairs_of_a_name_take_little_room(spark, tmp_path):
    """Other products stand in one order after each product, so that a written result repeats itself."""
    spark.range(6400).selectExpr("id AS p_partkey", "concat('name ', id % 16) AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(6400).selectExpr("id % 3000 AS l_orderkey", "id AS l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    queries.queries()["shared_neighbor_alternatives"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    n = spark.read.parquet(f"{tmp_path}/out").count()
    assert n == 16 * 400 * 399 - 2 * 400 and sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.6 * n


def test_pairs_of_classes_take_little_room(spark, tmp_path):
    spark.range(12000).selectExpr("id AS p_partkey", "concat('B', id % 8) AS p_brand", "IF(id DIV 8 % 2 = 0, 'ECONOMY', 'PROMO') AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(2).selectExpr("1 AS l_orderkey", "8 * id AS l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    queries.queries()["class_pairs"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    n = spark.read.parquet(f"{tmp_path}/out").count()
    assert n == 8 * (750 * 751 // 2) - 1 and sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.6 * n


def test_left_rows_travel_in_slices(spark):
    """Rows of one key with the same other columns are sent as arrays; rows of the left that repeat are kept, those without an id fall out."""
    left = spark.createDataFrame([(i // 2, "k", "x" if i % 3 else None) for i in range(600)] + [(None, "k", "x")], "a long, key string, more string")
    right = spark.createDataFrame([(i, "k") for i in (1, 1, 2, None)], "b long, key string")
    df = G.unlinked(left, "a", right, "b", ["key"], spark.createDataFrame([(0, 1), (0, 9), (7, 2)], "src long, dst long"))
    met = sorted(((i // 2, "k", "x" if i % 3 else "", b) for i in range(600) for b in (1, 1, 2) if (i // 2, b) not in ((0, 1), (7, 2))))
    assert sorted((r["a"], r["key"], r["more"] or "", r["b"]) for r in df.collect()) == met and "collect_list(a" in plan(df)


def test_walks_are_made_once_in_tasks_that_grow(spark, tmp_path, monkeypatch):
    """No step is left to a fixed number of tasks; of a walk and its way back one is made; walks back to their own start are two."""
    monkeypatch.setattr(G, "TASK_ROWS", 20)
    orders = {o: sorted({(o * 7 + i * i * 11 + i) % 24 * 25 for i in range(2 + o % 4)}) for o in range(40)}
    spark.createDataFrame([(o, p) for o, parts in orders.items() for p in parts], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    nodes = sorted({p for parts in orders.values() for p in parts})
    spark.createDataFrame([(p,) for p in [*nodes, 5000, None]], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    w = {}
    for parts in orders.values():
        for a in parts:
            for b in parts:
                if a != b:
                    w[a, b] = w.get((a, b), 0) + 1
    found = {}
    for start in (x for x in nodes if x % 50 == 0):
        walks = [([start], 0)]
        for hops in (1, 2, 3):
            walks = [([*at, y], s + w[at[-1], y]) for at, s in walks for y in nodes if (at[-1], y) in w and (len(at) < 2 or y != at[-2])]
            for at, s in walks:
                if at[-1] % 50 == 0:
                    found.setdefault((start, at[-1], hops), []).append(s)
    df = queries.queries()["paths_le3"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted((*k, len(v), float(max(v))) for k, v in found.items()) and any(a == b for a, b, _ in found)
    dealt = [x for x in plan(df).splitlines() if "RepartitionByExpression" in x]
    assert len(dealt) >= 8 and not any(x.rstrip().endswith("], 1") for x in dealt) and sum("RepartitionByExpression [a" in x for x in dealt) == 3


def test_walks_are_sent_packed(spark, sf, monkeypatch):
    """Packs of walks, of ids of any sign and size, give each two ends in both directions with their number and risk, and are a few bytes a walk once compressed; edges are dealt by one end and not sent again."""
    monkeypatch.setattr(G, "WALKS", 300)
    draw = random.Random(7)
    for ids in ([*range(0, 900, 50)], [-(2**62), -3, 0, 5, 2**31, 2**62]):
        walks = [(draw.choice(ids), draw.choice(ids), float(draw.randint(3, 9))) for _ in range(2000)]
        found = {}
        for a, b, risk in walks:
            for x in [(a, b), (b, a)]:
                found.setdefault(x, []).append(risk)
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*walks[i : i + 70])], ["first", "last", "risk"]) for i in range(0, 2000, 70)]
        sent = list(G._sent(batches, 3))
        got = [tuple(r.values()) for batch in G._counted(iter(sent)) for r in batch.to_pylist()]
        assert got == sorted((*k, len(v), max(v)) for k, v in found.items()) and len(sent) > 5
    assert list(G._counted(iter([]))) == [] and list(G._sent(iter([]), 3)) == []
    monkeypatch.setattr(G, "WALKS", 1 << 20)
    many = pa.RecordBatch.from_arrays([pa.array([draw.randrange(0, 1_200_000, 50) for _ in range(100_000)]) for _ in "ab"] + [pa.array([float(draw.randint(3, 5)) for _ in range(100_000)])], ["first", "last", "risk"])
    (packs,) = G._sent([many], 4)
    assert sum(len(pa.compress(x.as_py(), "lz4", asbytes=True)) for x in packs.column(1)) < 7 * 100_000
    dealt = [x for x in plan(queries.queries()["paths_le3"](spark, sf)).splitlines() if "RepartitionByExpression" in x]
    assert sum("RepartitionByExpression [src" in x for x in dealt) <= 3 and sum("RepartitionByExpression [ab" in x for x in dealt) == 1
    whole = rows(spark, sf, "paths_le3")
    monkeypatch.setattr(G, "BESIDE", 1)
    assert len(whole) > 3 and rows(spark, sf, "paths_le3") == whole
