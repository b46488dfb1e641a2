"""Elastic search and its fuzzy supplement against plain Python over all titles."""

import difflib
import random
import re

from tarn.functions.fuzzy import plain_full
from tarn.operators import elastic as L
from tarn.plans import queries
from tarn.plans.texts import MISSPELT


def meant(query, title):
    q = plain_full(query)
    ways = [".{0,2}".join(c for c in q if c.isalnum())] + [".*".join(p) for p in q.split() if len(p) >= 3]
    return title is not None and len(query) >= 3 and (any(re.search(w, title, re.I | re.S) for w in ways if w) or bool(set(q.split()) & set(plain_full(title).split())))


def likeness(query, title, least):
    q, t = plain_full(query), plain_full(title)
    if q in t:
        return 1.0
    near = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    best = max([s for a in q.split() for b in t.split() if (s := near(a, b)) >= least], default=0.0)
    if best < least and len(q.split()) > 1:
        words, n = t.split(), len(q.split())
        best = max([best, *(near(q, " ".join(words[i : i + n])) for i in range(len(words) - n + 1))])
    return best


def test_patterns_run_on_posted_titles_only(spark):
    rng = random.Random(2)
    titles = ["gizmo blue", "Gxxizmo", "g i z m o o", "DOLIPRANE 500", "doli\nprane", "dolpirane", "éléphant", "elephant", None, "", "blu", "a.b"] + ["".join(rng.choice("dolipranegzmbu ") for _ in range(rng.randrange(3, 25))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    for query in ("gizmoo blu", "doliprane", "élé", "a.b", "zz", "", "oo oo", "b"):
        assert {r["id"] for r in L.elastic(df, "id", "title", query).collect()} == {i for i, x in enumerate(titles) if meant(query, x)}, query
    posted = L.postings(df, "id", "title")
    assert L.elastic(df, "id", "title", "doliprane", posted).count() == L.elastic(df, "id", "title", "doliprane").count()


def test_fuzzy_supplement_equals_plain_python(spark, sf):
    hits = {r["vec_id"]: r["score"] for r in queries.queries()["hybrid_rank"](spark, sf).collect() if r["score"] >= 0.15}
    want = {i: (round(s, 9), "vector") for i, s in hits.items()}
    for r in spark.read.parquet(f"{sf}/part.parquet").collect():
        if r["p_partkey"] not in hits and meant(MISSPELT, r["p_name"]) and likeness(MISSPELT, r["p_name"], 0.6) >= 0.6:
            score = 0.8 * likeness(MISSPELT, r["p_name"], 0.7)
            if score >= 0.15:
                want[r["p_partkey"]] = (round(score, 9), "fuzzy")
    got = {r["p_partkey"]: (r["score"], r["source"]) for r in queries.queries()["fuzzy_supplement"](spark, sf).collect()}
    assert got == want and {s for _, s in want.values()} == {"vector", "fuzzy"}
