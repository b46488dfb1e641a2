"""Queries and operators without SQL against plain Python, awkward rows among them, and the queue as a stream."""

import datetime as dt
import difflib
import random
import re
import unicodedata
from collections import defaultdict

from pyspark.sql import functions as F

from tarn.functions import fuzzy as Z
from tarn.functions import text as X
from tarn.operators import resolve as E
from tarn.operators import windows as W
from tarn.plans import queries
from tarn.plans import rules as R
from tarn.plans import sync as Y
from tarn.streaming import jobs as J


def got(spark, sf, name):
    return [r.asDict() for r in queries.queries()[name](spark, sf).collect()]


def table(spark, sf, name):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]


def fold(x):
    return "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn").lower()


def limit(events, most, seconds):
    out, held = {}, defaultdict(list)
    for e in sorted(events, key=lambda e: (e["ts"], e["event_id"])):
        near = [x for x in held[e["user_id"]] if (e["ts"] - x).total_seconds() < seconds]
        out[e["event_id"]] = len(near) < most
        held[e["user_id"]] = near + [e["ts"]] * out[e["event_id"]]
    return out


def test_rate_window(spark, sf):
    want = limit(table(spark, sf, "events"), 2, 3 * 3600)
    assert {r["event_id"]: r["allowed"] for r in got(spark, sf, "rate_window")} == want and not all(want.values())


def test_rate_limit_of_null_keys_and_ties(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, None, at + dt.timedelta(seconds=i // 2)) for i in range(6)] + [(9, 1, None), (10, 1, at), (11, 1, at), (12, 1, at)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").repartition(4)
    allowed = {r["event_id"]: r["allowed"] for r in W.limited(df, "user_id", "ts", 2, 60, "event_id").collect()}
    assert [k for k, v in allowed.items() if v] and {k for k, v in allowed.items() if v} == {0, 1, 9, 10, 11}
    assert W.limited(df.limit(0), "user_id", "ts", 2, 60).count() == 0


def test_quota(spark, sf):
    kept = defaultdict(set)
    lists = defaultdict(list)
    for r in table(spark, sf, "part"):
        lists[r["p_brand"]].append((-r["p_size"], r["p_partkey"], [] if r["p_size"] % 7 == 0 else [r["p_type"], r["p_name"].split(" ")[0]], r["p_name"]))
    for brand, rows in lists.items():
        had, seen = defaultdict(int), set()
        for _, key, own, sign in sorted(rows):
            if not own:
                kept[brand].add(key)
            elif sign not in seen and any(had[c] < 2 for c in own):
                kept[brand].add(key)
                seen.add(sign)
                for c in own:
                    had[c] += 1
    rows = got(spark, sf, "quota_classes")
    assert {(r["list"], r["p_partkey"]) for r in rows} == {(b, k) for b, keys in kept.items() for k in keys} and len(rows) == sum(map(len, kept.values()))


def test_negated_terms(spark, sf):
    def affirmed(text):
        t = fold(text)
        hits = [m.start() for m in re.finditer(r"\bthes?\b", t)]
        return any(not re.search(r"\b(of|le)\b", re.split("[,.;]", t[max(0, h - 24) : h])[-1]) for h in hits)

    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents")}
    rows = {r["doc_id"]: r["affirmed"] for r in got(spark, sf, "negated_terms")}
    assert rows == {i: None if x is None else affirmed(x) for i, x in texts.items()} and {True, False} <= set(rows.values())


def test_fuzzy_scores(spark, sf):
    names = {r["p_name"] for r in table(spark, sf, "part")}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()

    def found(name):
        query, words = "gizmoo blue", name.split()
        if query in name:
            return 1.0
        best = max((s for w in words for q in query.split() if (s := ratio(q, w)) >= 0.7), default=0.0)
        return best if best >= 0.7 else max([best, *(ratio(query, " ".join(words[i : i + 2])) for i in range(len(words) - 1))])

    rows = got(spark, sf, "fuzzy_scores")
    assert {r["p_name"] for r in rows} == names
    assert all(abs(r["similar"] - ratio(r["p_name"], "red wiget")) < 1e-6 and abs(r["found"] - found(r["p_name"])) < 1e-6 for r in rows)


def test_sentence_chunks(spark, sf):
    texts = {r["item_id"]: r["text"] for r in table(spark, sf, "benchmark")}
    chunks = defaultdict(list)
    for i, x in texts.items():
        for c in Z.chunks_of(x, 200):
            assert 0 < len(c) <= 200
            chunks[i].append(c)
        assert re.sub(r"\s", "", "".join(chunks[i])) == re.sub(r"\s", "", x)
        whole = [s.strip() for s in re.findall(r".+?(?:[.!?](?=\s|$)|$)\s*", x, re.S) if s.strip()]
        for a, b in zip(chunks[i], chunks[i][1:]):  # no chunk could take the next one's first sentence
            first = next((s for s in whole if b.startswith(s)), None)
            assert first is None or len(a) + 1 + len(first) > 200
    sizes = defaultdict(list)
    for r in got(spark, sf, "sentence_chunks"):
        sizes[r["item_id"]].append(r["size"])
    assert {i: sorted(map(len, c)) for i, c in chunks.items()} == {i: sorted(s) for i, s in sizes.items()}


def test_abbreviated_heads(spark):
    text = "one two three four five"
    heads = {n: spark.range(1).select(X.abbreviate(F.lit(text), n).alias("x")).first()["x"] for n in (30, 10, 4, 3)}
    assert heads == {30: text, 10: "one two…", 4: "one…", 3: "one…"}


def packed(texts, most):
    """Lots one text after the other, as sizes and members."""
    out, held = [], 0
    for x in sorted(texts, key=lambda x: (len(x or ""), x is not None, x or "")):
        if not out or held and held + len(x or "") > most:
            out.append([])
            held = 0
        out[-1].append(x)
        held += len(x or "")
    return out


def test_lots(spark, sf):
    rows = got(spark, sf, "texts_in_lots")
    part = table(spark, sf, "part")
    want = {x for r in part for x in (r["p_name"], r["p_type"], r["p_brand"])} - {r["p_name"] for r in part if r["p_size"] % 2 == 0}
    assert {(r["lot"], r["text"]) for r in rows} == {(i, x) for i, lot in enumerate(packed(want, 400)) for x in lot}


def test_lots_are_the_same_in_any_partitions(spark):
    rng = random.Random(8)
    for most in (1, 7, 10, 33):
        texts = [None if rng.random() < 0.02 else "".join(rng.choice("abcé") for _ in range(int(rng.expovariate(0.15)))) for _ in range(400)] + ["x"] * 50 + [""] * 5
        want = sorted((i, x or "") for i, lot in enumerate(packed(texts, most)) for x in lot)
        for parts in (1, 5):
            df = spark.createDataFrame([(x,) for x in texts], "text string").repartition(parts)
            assert sorted((r["lot"], r["text"] or "") for r in W.lots(df, "text", most).collect()) == want, (most, parts)
        few = [x for x in texts if x and len(x) > most]
        assert sorted((r["lot"], r["text"]) for r in W.lots(spark.createDataFrame([(x,) for x in few], "text string"), "text", most).collect()) == sorted((i, x) for i, lot in enumerate(packed(few, most)) for x in lot)
    assert W.lots(spark.createDataFrame([], "text string"), "text", 10).collect() == []


def test_seeded_sample(spark, sf):
    rows = got(spark, sf, "seeded_sample")
    assert len({r["o_orderkey"] for r in rows}) == 100 and rows == got(spark, sf, "seeded_sample")


def test_common_subsequences():
    def slow(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    import random

    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé ") for _ in range(rng.randrange(90))) for _ in "ab")
        assert Z.common(a, b) == slow(a, b)
    assert Z.indel_ratio("", "") == 100 and Z.indel_ratio("a", "") == 0
    assert Z.set_ratio("methyl aminolevulinate", "aminolevulinate de methyl") == 100 and Z.set_ratio("", "a") == 0


def test_resolution_guards(spark):
    alias = E.aliases(spark.createDataFrame([(1, "acide alendronique", []), (2, "carbonate de calcium", []), (3, "amikacin", ["amikacine base"]), (4, "sodium", []), (5, "salbutamol", [])], "k long, n string, syn array<string>"), "k", "n", "syn")
    items = spark.createDataFrame([(1, "acide zoledronique"), (2, "carbonate de lithium"), (3, "Amikacin sulfate"), (4, "sodium chloride"), (5, "salbutamols"), (6, "amikacine base"), (7, None), (8, ""), (9, "sulfate de salbutamol")], "id long, name string")
    rows = {r["id0"]: (r["id"], r["rule"]) for r in E.cascade(items.withColumnRenamed("id", "id0"), "id0", "name", alias, ["sulfate", "chloride"]).collect()}
    assert rows == {3: (3, "reduced"), 5: (5, "fuzzy"), 6: (3, "synonym"), 9: (5, "reduced")}


def test_text_without_doses(spark):
    tries = {"Ventoline 100 µg/bouffée le soir": "ventoline", "Aspirine 5 % gel": "aspirine % gel", "Eau 2 gtte par jour": "eau", "Insuline 10 u.i. matin": "insuline", "Doliprane (1 cp) 500mg, 2 bouffées": "doliprane", "": "", "B12": "b12"}
    rows = spark.createDataFrame([(k,) for k in tries], "x string").select("x", X.strip_dose(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == tries | {"Aspirine 5 % gel": rows[1]["y"]} and "5" not in rows[1]["y"]
    keys = spark.createDataFrame([("L'Ibuprofène 200 mg comprimé TEVA",), ("x 5 % y",), (None,)], "x string").select(X.inn_key(F.col("x"), [*X.FORMS, "teva"]).alias("y")).collect()
    assert [r["y"] for r in keys] == ["l ibuprofene", "x y", None]


def test_items_are_stripped_of_marks(spark):
    rows = spark.createDataFrame([(" • a, ",), ("– b*",), ("c",), (None,)], "x string").select(X.strip_list_marks(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in rows] == ["a", "b", "c", None]


def test_codes_of_combinations(spark):
    codes = [["n02be01", "N02BE51"], ["N02BE51"], ["N02AJ06"], ["A"], [], None, [None, " "]]
    rows = spark.createDataFrame([(c,) for c in codes], "c array<string>").select(R.own_groups(F.col("c"), ("N02AJ",)).alias("g")).collect()
    assert [r["g"] for r in rows] == [["N02"], ["N02"], ["N02"], ["A"], [], [], []]


def test_expired_rows_of_upserts(spark):
    kind = "k long, a string, b string"
    old = spark.createDataFrame([(1, "x", "x"), (2, None, "y"), (None, "n", "n")], kind)
    new = spark.createDataFrame([(1, None, "z"), (3, "c", None), (3, "d", "d"), (None, "m", "m")], kind)
    rows = sorted((tuple(r) for r in Y.upsert(old, new, ["k"], ["b"]).collect()), key=str)
    assert rows == sorted([(1, None, "x"), (2, None, "y"), (3, "d", "d"), (None, "m", "n")], key=str)
    assert Y.upsert(old.limit(0), new.limit(0), ["k"]).count() == 0


def actions():
    rows = [("j1", 1, 0.0, "enqueue", ""), ("j1", 2, 1.0, "reserve", "w1"), ("j1", 3, 2.0, "reserve", "w2"), ("j1", 4, 700.0, "reserve", "w2"), ("j1", 5, 710.0, "complete", "w1"), ("j1", 6, 720.0, "fail", "w2"), ("j1", 7, 730.0, "reserve", "w1"), ("j1", 8, 1030.0, "reserve", "w1"),
            ("j1", 9, 1031.0, "fail", "w1"), ("j2", 10, 0.0, "enqueue", ""), ("j2", 11, 0.0, "enqueue", ""), ("j2", 12, 5.0, "reserve", "w1"), ("j2", 13, 6.0, "extend", "w1"), ("j2", 14, 7.0, "complete", "w1"), ("j2", 15, 8.0, "enqueue", "")]
    return [(j, e, float(a), x, w) for j, e, a, x, w in rows]


KIND = "job_id string, event_id long, at double, action string, worker string"


def check_queue(rows):
    said = {r["event_id"]: (r["accepted"], r["state"], r["attempts"]) for r in rows}
    assert [k for k, v in said.items() if not v[0]] and sorted(k for k, v in said.items() if not v[0]) == [3, 5, 7, 11]
    assert said[4] == (True, "running", 2) and said[6][1] == "pending" and said[9] == (True, "failed", 3) and said[14][1] == "done" and said[15] == (True, "pending", 0)


def test_queue_as_a_table_and_as_a_stream(spark, tmp_path):
    events = spark.createDataFrame(actions(), KIND)
    check_queue(J.run_queue(events).collect())
    for i, part in enumerate(([0, 1, 2, 9, 10], [3, 4, 5, 11, 12], [6, 7, 8, 13, 14])):
        spark.createDataFrame([actions()[k] for k in part], KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{i}")
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    running = J.run_queue(stream).writeStream.format("memory").queryName("queue_states").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    running.awaitTermination()
    check_queue(spark.table("queue_states").collect())


def test_incremental_upserts_of_a_stream(spark, tmp_path):
    kind, held = "k long, v string", {"n": 0}
    first = spark.createDataFrame([], kind)
    first.write.parquet(f"{tmp_path}/v0")
    read = lambda: spark.read.schema(kind).parquet(f"{tmp_path}/v{held['n']}")

    def write(df):
        df.write.parquet(f"{tmp_path}/v{held['n'] + 1}")
        held["n"] += 1

    for i, rows in enumerate(([(1, "a"), (2, "b")], [(2, "c"), (3, "d")])):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(J.upsert_each_batch(read, write, lambda old, new: Y.upsert(old, new, ["k"]))).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in read().collect()) in ([(1, "a"), (2, "c"), (3, "d")], [(1, "a"), (2, "b"), (3, "d")])
