"""Operators 11 to 13 against brute force, and on awkward tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tarn.llm import queries, repeats, spelling, whitening
from tarn.llm.common import settle
from tests.llm.fixtures import WORD, awkward, table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 11: spelling


def plain_vocabulary(docs, least=6, often=5):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= often}


def plain_variants(n, ratio=5):
    """Every word against every other that is the same after one place is left out of either or both."""
    near, holes = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            if (less := w[:i] + w[i + 1 :]) in n:
                near[w].add(less)
                near[less].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def told(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = told(queries.queries()["op11_spelling_variants"](spark, sf))
    want = plain_variants(plain_vocabulary([(r[0], r[1]) for r in table("documents", sf)]))
    assert got == want and len(got) > 1000 and any(v[0] for v in got.values())


@pytest.mark.parametrize("most", [1, 2, 5, 1000])
def test_spelling_of_skewed_dictionaries(spark, most):
    """Beginnings and ends that a third of all words share, words of one letter and of none, and letters of two and four bytes."""
    rng = np.random.default_rng(most)
    words = {"common" + "".join(rng.choice(list("abé"), rng.integers(0, 5))) for _ in range(150)} | {"".join(rng.choice(list("ab"), rng.integers(0, 5))) + "ending" for _ in range(150)}
    words |= {"".join(rng.choice(list("abc\U0001f600"), rng.integers(0, 7))) for _ in range(300)} | {"", "a", "b"}
    n = {w: int(rng.integers(1, 200)) for w in sorted(words)}
    given = settle(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert told(spelling.variants(given, most=most)) == plain_variants(n)


def test_spelling_of_chains(spark):
    """Forms are followed to the last, over more steps than one jump."""
    n = {"aaaaaaaa"[:k] + "bbbbbbbb"[k:]: 6**k for k in range(9)}
    got = told(spelling.variants(settle(spark.createDataFrame(list(n.items()), "word string, n long"))))
    assert got == plain_variants(n) and got["bbbbbbbb"][1] == "aaaaaaaa"


def test_spelling_ties_go_to_the_first_word(spark):
    n = {"carton": 1, "carbon": 9, "cartoon": 9, "cárton": 9}
    got = told(spelling.variants(settle(spark.createDataFrame(list(n.items()), "word string, n long"))))
    assert got["carton"] == ("carbon", "carbon", 1, 3, 9)


@pytest.mark.parametrize("empty", [False, True])
def test_spelling_awkward(spark, empty):
    docs = awkward(spark, empty)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["word"]: r["n"] for r in spelling.vocabulary(docs, often=1).collect()}
    assert got == plain_vocabulary(rows, often=1)
    long = "x" * 30_000
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, f"{long} {long[1:]} Straße ÄPFEL{i}") for i in range(6)], "doc_id long, text string"))
    n = plain_vocabulary([(r[0], r[1]) for r in more.collect()])
    assert told(spelling.variants(settle(spelling.vocabulary(more)))) == plain_variants(n) if not empty else True


# 12: repeats


def plain_repeats(rows, length=35):
    """For each row: words, words that go, text of the others."""
    docs = [WORD.findall(t or "") for t in rows]
    starts = Counter(tuple(w[p : p + length]) for w in docs for p in range(len(w) - length + 1))
    out = []
    for w in docs:
        gone = bytearray(len(w))
        for p in range(len(w) - length + 1):
            if starts[tuple(w[p : p + length])] > 1:
                gone[p : p + length] = b"\1" * length
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def test_repeats_equal_brute_force(spark, sf):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.queries()["op12_substring_dedup"](spark, sf).collect()}
    docs = table("documents", sf)
    want = {d[0]: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, (n, k, t) in zip(docs, plain_repeats([d[1] for d in docs]))}
    assert got == want and any(k for _, k, _ in want.values())


@pytest.mark.parametrize(("length", "chunk"), [(35, 2_000_000), (35, 60), (7, 500), (8, 100), (2, 50), (1, 50)])
def test_repeats_at_any_offset(spark, length, chunk):
    """Passages of every length about the limit, at every offset to the blocks, within a document and over documents, in chunks of any size."""
    rng = np.random.default_rng(length)
    new = iter(range(10**9))
    fresh = lambda k: [f"w{next(new)}" for _ in range(k)]
    passages = [fresh(k) for k in range(length - 1, length + 3) if k]
    texts = []
    for i in range(60):
        words = fresh(int(rng.integers(0, 2 * length)))
        for _ in range(int(rng.integers(0, 3))):
            words += passages[rng.integers(0, len(passages))] + fresh(int(rng.integers(0, 30)))
        texts.append(" ".join(words))
    texts += [" ".join(["a"] * k) for k in (length - 1, length, length + 1, 3 * length)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in repeats.without_repeats(docs, length=length, chunk=chunk).collect()}
    assert got == dict(enumerate(plain_repeats(texts, length)))


def test_repeats_of_one_passage_in_very_many_rows(spark):
    """A passage that every row has, a row that says one word very often, and rows with nothing in common."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"own{i} {passage} end{i}") for i in range(3000)] + [(5000, "x " * 100_000), (5001, " ".join(f"z{i}" for i in range(300)))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), chunk=5000).collect()}
    assert got == {**{i: (42, 40, f"own{i} end{i}") for i in range(3000)}, 5000: (100_000, 100_000, ""), 5001: (300, 0, rows[-1][1])}


@pytest.mark.parametrize("empty", [False, True])
def test_repeats_awkward(spark, empty):
    """Nulls, repeated rows and ids, ids that are strings."""
    docs = awkward(spark, empty)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for name in ("doc_id", "id"):
        found = repeats.without_repeats(docs, id_col=name)
        assert found.columns == [name, "n_words", "n_removed", "kept"]
        got = sorted((str(r[name]), r["n_words"], r["n_removed"], r["kept"]) for r in found.collect())
        assert got == sorted((str(i) if name == "doc_id" else "i", *w) for (i, _), w in zip(rows, plain_repeats([t for _, t in rows])))


# 13: whitening


def plain_whitening(vectors, k=16):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    keep = min(k, int((e > 1e-11 * e[0]).sum()) if e[0] > 0 else 0)
    return n, ((n * x - s) ** 2).sum(1), ((n * x - s) / n) @ v[:, :keep] / np.sqrt(e[:keep]), e[:keep] / e.sum()


def check_whitening(df, ids, vectors, k=16):
    n, deviation, white, share = plain_whitening(vectors, k)
    rows = sorted((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in df.collect())
    assert len(rows) == len(ids) * white.shape[1] and len({r[6] for r in rows}) <= 1 and all(r[6] < 1e-6 for r in rows)
    order = np.argsort(ids, kind="stable")
    of = lambda c: [r for r in rows if r[1] == c]  # noqa: E731  in order of the ids, which may repeat
    got = np.array([[r[4] for r in of(c + 1)] for c in range(white.shape[1])]).T
    want = white[order]
    assert np.abs(got - want * np.sign((got * want).sum(0))).max() < 1e-8
    assert [r[2] for r in rows] == [n] * len(rows) and [r[3] for r in of(1)] == deviation[order].tolist()
    assert np.allclose([of(c + 1)[0][5] for c in range(white.shape[1])], share, rtol=1e-9)


def test_whitening_equals_numpy(spark, sf):
    rows = [r for r in table("embeddings", sf) if r[1] is not None]
    check_whitening(queries.queries()["op13_embedding_whitening"](spark, sf), [r[0] for r in rows], [r[1] for r in rows])


@pytest.mark.parametrize(("d", "k"), [(1, 16), (3, 16), (16, 16), (40, 5), (200, 4)])
def test_whitening_of_any_dimension(spark, d, k):
    rng = np.random.default_rng(d)
    v = rng.standard_normal((300, d)) * np.geomspace(10, 1, d) @ np.linalg.qr(rng.standard_normal((d, d)))[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    check_whitening(whitening.components_of(df, k=k), list(range(300)), v, k)


def test_lanczos_breaks_down_and_starts_again():
    """Few distinct eigenvalues exhaust a Krylov space at once; a bound on the basis forces restarts."""
    rng = np.random.default_rng(3)
    for values, k, most in (([5.0] * 10 + [1.0] * 50, 4, 256), ([9.0, 9, 9, 4, 4, 1, 0, 0, 0, 0], 3, 256), ([0.0] * 12, 3, 256), (np.geomspace(1, 1e-3, 300), 4, 24), (np.linspace(1, 2, 120), 6, 30)):
        values = np.array(values)
        q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
        a = q * values @ q.T
        e, v = whitening.lanczos(lambda b, a=a: a @ b, len(values), k, most=most)
        assert np.allclose(e, np.sort(values)[::-1][:k], atol=1e-12 * max(values.max(), 1)) and np.allclose(v.T @ v, np.eye(k), atol=1e-12)
        assert np.abs(a @ v - v * e).max() <= 1e-8 * max(values.max(), 1)


def test_whitening_awkward(spark):
    """Nulls, other lengths, repeated vectors and ids, clashing names, very large entries."""
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(0)
    sound = [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(20)]
    odd = [(50, None), (51, []), (52, [1.0, None, 2.0, 3.0]), (53, [nan, 0.0, 0.0, 0.0]), (54, [inf, 0.0, 0.0, 0.0]), (55, [1.0]), (56, [1e300, 0.0, 0.0, 0.0]), (3, sound[3][1]), (60, sound[3][1])]
    df = spark.createDataFrame([(i, v, "x", "n", 1.0) for i, v in sound + odd], "vec_id long, embedding array<double>, x string, id string, whitened double")
    kept = [r for r in sound + odd if r[1] and len(r[1]) == 4 and None not in r[1] and np.isfinite(r[1]).all() and abs(r[1][0]) < 1e100]
    check_whitening(whitening.components_of(df), [r[0] for r in kept], [r[1] for r in kept])
    assert whitening.components_of(df.limit(0)).collect() == [] and whitening.components_of(df.where("vec_id in (3, 60)")).collect() == []
    null = spark.createDataFrame([(None, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [2.0, 5.0])], "vec_id long, embedding array<float>")
    assert sorted(str(r["vec_id"]) for r in whitening.components_of(null).collect()) == ["1"] * 4 + ["None"] * 2


def test_whitening_beyond_longs(spark):
    """Where n * x or a deviation is no long, integers stay exact; a deviation that no long holds is null."""
    big = [(i, [float((1 << 44) + i * i), float(i)]) for i in range(5000)]
    out = whitening.components_of(spark.createDataFrame(big, "vec_id long, embedding array<double>"))
    x = [[64 * int(a) + 1_000_000 for a in v] for _, v in big]
    n, s = len(x), [sum(c) for c in zip(*x)]
    want = {i: sum((n * a - t) ** 2 for a, t in zip(v, s)) for i, v in enumerate(x)}
    assert {r["vec_id"]: r["deviation"] for r in out.collect()} == {i: v if v < 1 << 63 else None for i, v in want.items()}
    assert any(v >= 1 << 63 for v in want.values())
