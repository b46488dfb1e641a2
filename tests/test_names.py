"""Names in texts: masks, containment and prefixes against plain Python."""

import re

from pyspark.sql import functions as F

from tarn.operators import containment as B
from tarn.plans import queries
from tests.test_brute import table


def plain_mask(text, marks):
    """The longest name first, then in order, then from the left; what is masked is taken."""
    if text is None:
        return None, 0
    own = re.findall(r"[^\W_]+|(?:\W|_)+", text)
    low, taken, put = [x.lower() for x in own], [False] * len(own), {}
    for name in sorted(marks, key=lambda n: (-len(n), n)):
        t = [x.lower() for x in re.findall(r"[^\W_]+|(?:\W|_)+", name)]
        for i in range(len(low) - len(t) + 1):
            if low[i : i + len(t)] == t and not any(taken[i : i + len(t)]):
                taken[i : i + len(t)] = [True] * len(t)
                put[i] = (len(t), marks[name])
    out, i = [], 0
    while i < len(own):
        out.append(put[i][1] if i in put else own[i])
        i += put[i][0] if i in put else 1
    return "".join(out), len(put)


def test_masked_names_equal_plain_python(spark, sf):
    marks = {}
    for name, mark in [(p["p_name"].lower(), "{%s}" % p["p_type"]) for p in table(spark, sf, "part")] + [(" ".join(b["text"].split(" ")[: 1 + b["item_id"] % 5]).lower(), "{%d}" % b["item_id"]) for b in table(spark, sf, "benchmark")]:
        if name.strip():
            marks[name] = min(mark, marks.get(name, mark))
    got = {r["doc_id"]: (r["text"], r["n"]) for r in queries.queries()["masked_names"](spark, sf).collect()}
    assert got == {d["doc_id"]: plain_mask(d["text"], marks) for d in table(spark, sf, "documents")} and sum(n for _, n in got.values()) > 10


def test_masks_go_by_length(spark):
    marks = {"insulin": "{a}", "insulin glargine": "{b}", "glargine of x y": "{c}", "vitamin e": "{d}", "": "{e}", "c++": "{f}", "épo": "{g}"}
    texts = {1: "Insulin glargine raises INSULIN; insulin-glargine and insulinoma.", 2: None, 3: "", 4: "insulin glargine of x y, Vitamin E. vitamin  e", 5: "ÉPO and c++, C++ c+", 6: "insulin " * 5000}
    names = spark.createDataFrame(list(marks.items()) + [(None, "{z}"), ("INSULIN", "{z}")], "name string, mark string")
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    del marks[""]
    got = {r["id"]: (r["text"], r["n"]) for r in B.masked(docs, "id", "text", names, "name", "mark").collect()}
    assert got == {i: plain_mask(x, marks) for i, x in texts.items()} and got[1][0] == "{b} raises {a}; {a}-glargine and insulinoma."
    assert B.masked(docs, "id", "text", names.limit(0), "name", "mark").where("n > 0").count() == 0


def test_containment_both_ways(spark):
    words = ["a", "ab", "abc", "abcd", "bcd", "zzz", "abcabc", "é", "caféine", "caf", "", None, "x" * 3000, "yx"]
    left, right = spark.createDataFrame([(w,) for w in words], "a string"), spark.createDataFrame([(w,) for w in reversed(words)], "b string")
    real = [w for w in words if w]
    assert {tuple(r) for r in B.contained(left, "a", right, "b").collect()} == {(a, b) for a in real for b in real if a in b}
    got = {r["a"]: r["b"] for r in B.first_containing(left, "a", right.where("b != 'bcd'"), "b").collect()}
    titles = [w for w in real if w != "bcd"]
    assert got == {a: a if a in titles else min(b for b in titles if a in b or b in a) for a in real}


def test_prefixes(spark):
    titles = ["Abcdefgh", "abcdefghij", "AB", "zz", "", None, "abcdefghi X"]
    lines = ["ABCDEFGHIJ k", "abc", "abcdefghi x y", "", None, "a"]
    df = B.prefix_join(spark.createDataFrame([(x,) for x in titles], "t string"), "t", spark.createDataFrame([(x,) for x in lines], "l string"), "l")
    assert sorted(map(tuple, df.select("t", "l").collect())) == sorted((t, x) for t in titles for x in lines if t and x and x.lower().startswith(t.lower()))


def test_names_are_met_in_one_join(spark):
    """Names of many lengths are no more joins than names of one."""
    docs = spark.createDataFrame([(1, "a b c d e f g")], "id long, text string").withColumn("t", F.split("text", " "))
    names = spark.createDataFrame([(" ".join("abcdefg"[i:j]),) for i in range(7) for j in range(i + 1, 8)], "name string").withColumn("t", F.split("name", " "))
    found = B.name_hits(docs, "id", "t", names, "name")
    assert found.count() == 28 and found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3


ODD = {1: "Insulin glargine raises INSULIN; insulin-glargine and insulinoma.", 2: None, 3: "", 4: "insulin glargine of x y, Vitamin E. vitamin  e", 5: "ÉPO and c++, C++ c+ İnsulin ΣΑΣ", 6: "insulin " * 500, 7: "\x01 a\x01b", 8: "x y"}
MARKS = {"insulin": "{ä}", "insulin glargine": "{b}", "glargine of x y": "{c}", "vitamin e": "{d}", "c++": "{f}", "épo": "{g}", "i̇nsulin": "{h}", "σας": "{i}", "a\x01b": "{j}", "x y": "{k}"}


def tokened(df, column):
    return df.withColumn("t", F.transform(B.pieces(F.col(column)), F.lower))


def test_few_names_are_found_within_the_tasks_of_the_texts(spark):
    """Texts are read once and go nowhere; the same hits and masks as when names are joined."""
    docs = spark.createDataFrame(list(ODD.items()), "id long, text string")
    names = spark.createDataFrame(list(MARKS.items()), "name string, mark string")
    df = B.masked(docs, "id", "text", names, "name", "mark")
    seen = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in seen and "Generate" not in seen and seen.count("regexp_extract_all") == 1
    assert {r["id"]: (r["text"], r["n"]) for r in df.collect()} == {i: plain_mask(x, MARKS) for i, x in ODD.items()}
    hits = B.name_hits(tokened(docs, "text"), "id", "t", tokened(names.unionByName(names.selectExpr("upper(name) AS name", "mark")), "name"), "name")
    seen = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in seen and "Generate" not in seen
    joined = B.name_joins(tokened(docs, "text"), "id", "t", tokened(names.unionByName(names.selectExpr("upper(name) AS name", "mark")), "name"), "name")
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, joined.collect())) and hits.dtypes == joined.dtypes


def test_names_that_are_too_many_to_be_sent_are_joined(spark, monkeypatch):
    monkeypatch.setattr(B, "CARRIED", 0)
    docs = spark.createDataFrame(list(ODD.items()), "id long, text string")
    df = B.masked(docs, "id", "text", spark.createDataFrame(list(MARKS.items()), "name string, mark string"), "name", "mark")
    assert "Join" in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"]: (r["text"], r["n"]) for r in df.collect()} == {i: plain_mask(x, MARKS) for i, x in ODD.items()}
    names = spark.createDataFrame([(x,) for x in ("b c d", "a", "c d")], "name string").withColumn("t", F.split("name", " "))
    found = B.name_hits(spark.createDataFrame([(1, "a b c d")], "id long, text string").withColumn("t", F.split("text", " ")), "id", "t", names, "name")
    assert sorted(map(tuple, found.collect())) == [(1, "a", 1, 1), (1, "b c d", 2, 3), (1, "c d", 3, 2)]


def test_mentions_send_no_words_of_documents(spark, sf):
    """What leaves a task is a name that a document holds; only the names that it begins with are joined."""
    seen = queries.queries()["mention_join"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert seen.count("Join") == 1 and "LeftAnti" in seen and "Generate" not in seen and seen.count("MapInArrow") == 1
