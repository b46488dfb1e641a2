"""Queries over all rows, on small tables with rows of any key, against brute force."""

import re
from itertools import combinations

import pytest

from tarn.functions import text as X
from tarn.operators import graph as G
from tarn.operators import search as V
from tarn.plans import queries

#: Orders and their parts; none of the orders is a multiple of ten.
ORDERS = {1: [3, 17, 42], 13: [3, 17], 103: [42, 99, 10], 107: [10, 50, 100], 9: [100, 7, 150], 11: [150, 50, 3]}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("small")
    lines = [(o, p, 500, i) for o, parts in ORDERS.items() for i, p in enumerate(parts, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{folder}/lineitem.parquet")
    parts = [(p, "name" if p in (3, 42, 8) else f"name {p}") for p in (3, 7, 8, 10, 17, 42, 50, 99, 100, 150)]
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def rows(spark, small, name):
    return sorted(tuple(r) for r in queries.queries()[name](spark, small).collect())


def graph():
    out = {}
    for parts in ORDERS.values():
        for a, b in combinations(sorted(set(parts)), 2):
            out[a, b] = out.get((a, b), 0) + 1
    return out


def around(node):
    return {b if a == node else a for a, b in graph() if node in (a, b)}


def test_edges_of_all_orders(spark, small):
    e = graph()
    nodes = {x for pair in e for x in pair}
    best = sorted(((x, len(around(x)), len(around(x))) for x in nodes), key=lambda r: (-r[1], r[0]))[:8]
    assert rows(spark, small, "undirected_degree") == sorted(best)
    assert rows(spark, small, "undirected_count") == [(len(e), 2 * len(e))]
    assert rows(spark, small, "network_topn") == [(a, b, w, 1) for (a, b), w in e.items() if w >= 2]
    ids = [3, 17, 42, 99, 250, 600, 1200, 1999]
    assert rows(spark, small, "pair_analysis") == sorted((a, b, e.get((a, b), 0), "found" if (a, b) in e else "none") for a, b in combinations(ids, 2))


def test_pairs_that_interact_in_any_order(spark, small):
    assert (3, 42, "name") not in rows(spark, small, "shared_neighbor_alternatives")
    want = [(o, i + 1, j + 1, graph()[tuple(sorted((parts[i], parts[j])))]) for o, parts in ORDERS.items() for i, j in combinations(range(len(parts)), 2)]
    assert rows(spark, small, "prescription_pairs") == sorted(want)


def test_paths_and_neighbours_over_all_edges(spark, small):
    found, listed = {}, []
    ends = (50, 100, 150)
    for start in ends:
        walks = [(start, (), 0)]
        for hops in (1, 2, 3):
            walks = [(y, (*used, pair), w + graph()[pair]) for x, used, w in walks for y in around(x) if (pair := tuple(sorted((x, y)))) not in used]
            for last, used, w in walks:
                if last in ends:
                    found.setdefault((start, last, hops), []).append(w)
                listed.append((start, last, hops, tuple(used), w))
    assert rows(spark, small, "paths_le3") == sorted((*k, len(v), float(max(v))) for k, v in found.items())
    edges = spark.createDataFrame([({"a": a, "b": b}, a, b, w) for (a, b), w in graph().items()], "edge_id struct<a:long,b:long>, src long, dst long, weight long")
    every = G.paths(edges, spark.createDataFrame([(x,) for x in ends], "node long"), 3).collect()
    assert sorted((r["first"], r["last"], r["hops"], tuple(tuple(e) for e in r["edge_ids"]), r["weight"]) for r in every) == sorted(listed)
    one = around(10)
    two = {y for x in one for y in around(x)} - one - {10}
    assert rows(spark, small, "two_hop_neighborhood") == sorted([(x, 1) for x in one] + [(x, 2) for x in two])


def test_orphans_are_in_no_order(spark, small):
    assert rows(spark, small, "orphans") == [(8,)]


def test_rows_beyond_the_first_ids(spark, tmp_path):
    lines = [(5000, 1, 1, 1), (5000, 2, 1, 2), (5000, 1, 1, 3), (5000, 3, 1, 4), (5000, 4, 1, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "b", "n", 3), (2, "a", "n", 4), (3, "c", "m", 5), (4, "d", "m", 6), (500, "b", "m", 7)], "p_partkey long, p_type string, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(500, "ab\nc\n\nd")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(900, 7)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(7, 2)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(2,)], "r_regionkey int").write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([(700, 5, "F", "4-NOT SPECIFIED")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert rows(spark, tmp_path, "array_union_capped") == [(5000, ["b", "a", "c"])]
    assert rows(spark, tmp_path, "duplicate_lines") == [(5000, 1, 2, [1, 3])]
    assert rows(spark, tmp_path, "lead_landmarks") == [(500, 0, 1, 4), (500, 1, 4, 6), (500, 2, 6, 7), (500, 3, 7, 8)]
    assert ("c900", "world", 3) in rows(spark, tmp_path, "hierarchy_closure")
    assert rows(spark, tmp_path, "treatment_parsing") == [(700, ["4-NOT SPECIFIED", "f 0,5 mg", "order 700"], "not specified", ["not specified", "not"], "5")]
    assert [r[0] for r in rows(spark, tmp_path, "code_parsing")] == [1, 2, 3, 4, 500]
    assert (500, 3, "m") in rows(spark, tmp_path, "shared_neighbor_alternatives")


def test_ancestors_of_any_depth(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "child long, parent long")
    got = {(r["node"], r["ancestor"]): r["depth"] for r in G.ancestors(chain).collect()}
    assert got == {(i, j): j - i for i in range(101) for j in range(i, 101)}
    assert G.ancestors(spark.createDataFrame([(0, 1), (1, 0), (2, 2), (3, None)], "child long, parent long")).count() == 5 and G.ancestors(chain.limit(0)).count() == 0


def folded(text):
    return text.lower().translate(str.maketrans(X.ACCENTED, X.PLAIN))


def words(text):
    return re.sub("[^a-z0-9]+", " ", folded(text)).strip().split(" ")


def test_whole_texts_with_any_letter(spark, tmp_path):
    texts = {1: "Die Straße führt nach Köln. " * 20 + "Ende\nhier", 2: "L'œuvre d'un élève, Łódź og Ærø " * 9, 3: "x" * 500 + "\nthe end", 4: "", 5: "grüße aus köln " * 3}
    heads = ["Straße führt nach", "Köln", "œuvre d'un", "Łódź og", "verylongfirstword secondword", "aus Köln"]
    texts[6] = "see VeryLongFirstWord, secondword ..."
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(heads)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    slug = lambda x: re.sub("^-+|-+$", "", re.sub("[^a-zA-Z0-9]+", "-", x.lower()))
    assert rows(spark, tmp_path, "text_keys") == sorted((i, folded(x), re.sub("[^a-z0-9]", "", folded(x)), slug(x)) for i, x in texts.items())
    assert rows(spark, tmp_path, "list_functions") == sorted((i, x.count("the"), x.split("\n")[:1], len(x.split("\n"))) for i, x in texts.items())
    sentences = lambda x: [" ".join(words(p)) for p in re.split(r"[.!?\n]+", x)]
    names = {n for x in heads for n in sentences(x) if n}
    want = sorted((i, n) for i, x in texts.items() for n in names if f" {n} " in f" {' '.join(words(x))} " and n != sentences(x)[0])
    assert rows(spark, tmp_path, "mention_join") == want and {n for _, n in want} == names


def test_mentions_of_any_number_of_words(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "c")], "doc_id long, text string")
    names = spark.createDataFrame([("c",), ("b c d",), ("a b",), ("d a",)], "name string")
    assert sorted(map(tuple, V.mentions(docs, "doc_id", "text", names, "name").collect())) == [(1, "a b"), (1, "b c d"), (1, "c"), (2, "c")]
    assert V.mentions(docs, "doc_id", "text", names.limit(0), "name").count() == 0
