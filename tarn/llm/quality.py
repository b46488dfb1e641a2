"""Operator 1: a quality classifier. Random Fourier features of document statistics approximate a Gaussian kernel; normal equations,
summed in each partition and then over partitions, fit ridge scores; isotonic regression calibrates them to 0..1.

Every document's statistics are worked out once and settled as a small table. Each learning row belongs to one of four folds by a hash
of its id; the sums are kept by fold, so that the same pass yields the model of all rows and the models that leave a fold out, whose scores
of that fold calibrate. The driver sees sums whose size depends on the number of features only, and at most 2,001 bins of scores.

Cases: null text counts as empty and is scored; labels of null, of unknown ids and repeated labels of an id (their mean counts) are
borne; of rows that repeat an id, the one whose statistics sort last is learned from, and each gets a row; other columns are ignored; without labels to learn from every score is the prior 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import documents, light, portions, settle, utf8, word_bounds, word_hashes

FOLDS = 4
#: Rows of one partition of learning sums.
ROWS = 10_000
_CLASSES = {"letter": [*range(65, 91), *range(97, 123)], "upper": range(65, 91), "digit": range(48, 58), "stop": b".!?", "comma": b",;:", "bang": b"!", "mark": b"#*$%&", "angle": b"<>{}[]()", "bar": b"|/\\_-=+~^", "at": b"@", "quote": b"'\"`", "high": range(128, 256)}
_CLASS = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS[list(_bytes), _k] = 1
D = 15 + len(_CLASSES)


def statistics(texts) -> np.ndarray:
    """A row of D statistics for each text of an Arrow string array."""
    raw, offsets = utf8(texts)
    starts, ends, first = word_bounds(raw, offsets)
    hashes = word_hashes(raw, starts, ends, lower=True)
    sizes = (ends - starts).astype(float)
    blob = raw.tobytes()
    out = np.zeros((len(offsets) - 1, D))
    for i, (a, b, w0, w1) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), first[:-1].tolist(), first[1:].tolist())):
        if w0 == w1:
            out[i, 0] = -1
            continue
        own, h, s = raw[a:b], hashes[w0:w1], sizes[w0:w1]
        n, k = b - a, w1 - w0
        seen = np.bincount(own, minlength=256)
        p = seen[seen > 0] / n
        uniq, times = np.unique(h, return_counts=True)
        pair = h[1:] ^ (h[:-1] << np.uint64(1))
        lines = blob[a:b].split(b"\n")
        full = [x for x in lines if x.strip()]
        packed = len(zlib.compress(blob[a:b], 1))
        out[i] = [
            np.log1p(n), np.log1p(k), s.mean(), s.std(), len(uniq) / k, times.max() / k, len(np.unique(pair)) / max(1, k - 1), (h[1:] == h[:-1]).sum() / max(1, k - 1),
            np.log1p(len(full)), np.log1p(n / len(full)), 1 - len(set(full)) / len(full), sum(x.rstrip()[-1:] in b".!?" for x in full) / len(full),
            packed / (n + 20), -(p * np.log2(p)).sum(), (s <= 1).sum() / k, *np.sqrt(seen @ _CLASS / n),
        ]
    return out


def profile(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x): the statistics of every whole text as doubles in bytes."""

    def run(batches: Iterator):
        for batch in batches:
            for part in portions(batch, 1):
                x = statistics(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "x"])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("x", T.BinaryType())]))


class Fourier:
    """Standardised statistics, then cosines of random projections: inner products approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, width: float, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.w = rng.standard_normal((D, features)) / (width * np.sqrt(D))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        wave = np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)
        return np.concatenate([np.ones((len(x), 1)), wave], axis=1)


class Model:
    """Ridge weights over Fourier features, and the steps of the calibration."""

    def __init__(self, fourier: Fourier | None = None, weights: np.ndarray | None = None, at: np.ndarray | None = None, to: np.ndarray | None = None):
        self.fourier, self.weights, self.at, self.to = fourier, weights, at, to

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(x), 0.5)
        return np.round(np.clip(np.interp(self.fourier(x) @ self.weights, self.at, self.to), 0, 1), 9)


def isotonic(at: np.ndarray, mean: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over points in order: the middle and the level of each pool."""
    pools: list[list[float]] = []  # weight, sum of levels, sum of places
    for x, y, k in zip(at.tolist(), mean.tolist(), n.tolist()):
        pools.append([k, k * y, k * x])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def _unpack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, D)


def learn(stats: DataFrame, labels: DataFrame, features: int = 192, width: float = 0.7, ridge: float = 1e-3) -> Model:
    """stats: (id, x); labels: (id, y) with y from 0 to 1."""
    spark = stats.sparkSession
    y = labels.where(F.col("id").isNotNull() & F.col("y").isNotNull()).groupBy("id").agg(F.avg("y").alias("y"))
    rows = settle(stats.groupBy("id").agg(F.max("x").alias("x")).join(y, "id").select("x", "y", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(FOLDS)).cast("int").alias("fold")))
    n = rows.count()
    if not n:
        return Model()
    rows = rows.coalesce(max(1, n // ROWS))

    def parts_of(batches: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for g in batches:
            if g.num_rows:
                yield _unpack(g.column("x").to_pylist()), g.column("y").to_numpy(), g.column("fold").to_numpy()

    def moments(batches: Iterator):
        total = np.zeros((3, D))
        for x, _, _ in parts_of(batches):
            total += [np.full(D, len(x)), x.sum(0), (x * x).sum(0)]
        yield pa.RecordBatch.from_pydict({"k": pa.array([0], pa.int32()), "sums": [total.ravel().tolist()]})

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.stack(g.column("sums").to_pylist()).sum(0) for g in batches)
        yield pa.RecordBatch.from_pydict({**{f"k{i}": pa.array([v.as_py()], pa.int32()) for i, v in enumerate(key)}, "sums": [total.tolist()]})

    total = np.array(rows.mapInArrow(moments, "k int, sums array<double>").groupBy("k").applyInArrow(added, "k0 int, sums array<double>").first()["sums"]).reshape(3, D)
    mean = total[1] / total[0]
    fourier = Fourier(mean, np.sqrt(np.maximum(total[2] / total[0] - mean**2, 0)), features, width)
    held = spark.sparkContext.broadcast(fourier)

    def equations(batches: Iterator):
        sums = np.zeros((FOLDS, features + 1, features + 2))
        for x, t, fold in parts_of(batches):
            z = held.value(x)
            for f in range(FOLDS):
                own = z[fold == f]
                sums[f] += np.concatenate([own.T @ own, (own.T @ t[fold == f])[:, None]], axis=1)
        at = [(f, i) for f in range(FOLDS) for i in range(features + 1)]
        yield pa.RecordBatch.from_pydict({"fold": pa.array([f for f, _ in at], pa.int32()), "i": pa.array([i for _, i in at], pa.int32()), "sums": [sums[x].tolist() for x in at]})

    parts = rows.mapInArrow(equations, "fold int, i int, sums array<double>").groupBy("fold", "i").applyInArrow(added, "k0 int, k1 int, sums array<double>").collect()
    sums = np.zeros((FOLDS, features + 1, features + 2))
    for r in parts:
        sums[r["k0"], r["k1"]] = r["sums"]

    def solve(a: np.ndarray) -> np.ndarray:
        hold = np.full(features + 1, ridge * max(a[0, 0], 1.0))
        hold[0] = 1e-9
        return np.linalg.solve(a[:, :-1] + np.diag(hold), a[:, -1])

    whole = sums.sum(0)
    weights = solve(whole)
    others = spark.sparkContext.broadcast(np.stack([solve(whole - sums[f]) if (whole - sums[f])[0, 0] > 0 else weights for f in range(FOLDS)]))

    def out_of_fold(batches: Iterator):
        for x, y, fold in parts_of(batches):
            raw = (held.value(x) * others.value[fold]).sum(1)
            yield pa.RecordBatch.from_pydict({"bin": np.round(np.clip(raw, -2, 3) * 400).astype(np.int32), "y": y})

    bins = sorted(rows.mapInArrow(out_of_fold, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).collect())
    at, to = isotonic(np.array([r["bin"] / 400 for r in bins]), np.array([r["y"] for r in bins]), np.array([float(r["n"]) for r in bins]))
    return Model(fourier, weights, at, to)


def apply(stats: DataFrame, model: Model) -> DataFrame:
    """(id, score) of every row of statistics."""
    held = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator):
        for batch in batches:
            score = held.value(_unpack(batch.column(1).to_pylist())) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["id", "score"])

    return stats.select("id", "x").mapInArrow(run, T.StructType([stats.schema["id"], T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score) of every whole text, learned from the labels given."""
    stats = settle(profile(docs, id_col, text_col))
    model = learn(stats, labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")))
    return apply(stats, model).withColumnRenamed("id", id_col)


def select(docs: DataFrame, labels: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is `least` or more, with their own columns. labels: (id, y). Rows are scored where they are."""
    known = labels.where(F.col("id").isNotNull() & F.col("y").isNotNull()).select("id").distinct()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = own.join(light(known), "id", "left_semi")
    held = docs.sparkSession.sparkContext.broadcast(learn(settle(profile(own, "id", "text")), labels))
    at = docs.columns.index(text_col)

    def run(batches: Iterator):
        for batch in batches:
            for part in portions(batch, at):
                yield part.filter(pa.array(held.value(statistics(part.column(at))) >= least))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def op1_quality_fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = score(documents(spark, sf_dir), labels)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op1_quality_fourier": op1_quality_fourier}
SQL: dict[str, str] = {}
