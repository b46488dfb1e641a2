"""Operator 13: whitening of embeddings by matrix-free block Lanczos.

Each component c of a vector becomes the integer x = floor(scale * c) + shift. The fit list has each distinct x vector once: n of them, with
sums S by dimension. The covariance V of the fit list is never formed. A pass multiplies it with a block B of columns: every task
sums X'(XB) over its rows, where a row of X is (n * x - S) / n, centred in integers before it becomes a double, and Spark adds the sums of
the tasks. What a pass brings to the driver is one number for each dimension and column, however many rows there are.

The driver holds the Krylov basis Q and its products VQ, a column for each vector multiplied so far. Every new block is orthogonalised
against the whole basis twice. A direction that has no length left (a breakdown) is replaced by a random one orthogonal to the basis. Ritz
pairs come from Q'VQ; it ends when the residuals |Vy - ey| of the wanted ones fall under `tolerance` times the largest eigenvalue, or when they have come
near and fall no more (rounding), or when the basis spans the space. A basis of over `most` columns is cut down to its leading Ritz vectors, which
are multiplied anew, and goes on from the same residual block, so memory is bounded by dimensions * most doubles.

The trace of V is the sum of the deviations, sum over dimensions of (n * x - S)^2, over n^3; explained is an eigenvalue's share of it.

Cases: rows whose vector is null or empty, or holds null or non-finite components, or components whose scaled size is 2^52 or more
(where integers of doubles are no longer exact), go; where vectors have several lengths, the most frequent one is the space (of equally
frequent ones the greatest) and others go; a null or repeated id is kept, each row has its results; equal vectors count once in the fit.
Eigenvalues under 1e-11 of the largest count as zero and have no component: a table of one distinct vector, or an empty one, has no result.
A deviation beyond a long is null. The sign of a component makes its largest entry positive. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import settle

#: Numbers of a matrix that a task works on at once.
CELLS = 1 << 20


class Model(NamedTuple):
    """What whitening needs of the fit list; `axes` has a column for each component."""

    n: int
    sums: list[int]
    top: int
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(id, x): the integers of sound vectors of the space."""
    given = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = given.where((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float(1 << 52))))
    lengths = sound.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("d")).limit(1).collect()
    return sound.where(F.size("v") == (lengths[0]["d"] if lengths else 0)).select("id", F.transform("v", lambda c: F.floor(c * scale) + shift).alias("x"))


def matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    """Where it starts, and the x vectors as rows, in parts of about CELLS numbers."""
    lists = batch.column(column)
    if len(lists):
        x = lists.flatten().to_numpy().reshape(len(lists), -1)
        step = max(1, CELLS // x.shape[1])
        for at in range(0, len(x), step):
            yield at, x[at : at + step]


def moved(x: np.ndarray, n: int, sums: list[int], top: int) -> np.ndarray:
    """n * x - S, exactly: as longs where they hold it, else as Python's integers. top: the largest |x|."""
    if n * top < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int], top: int) -> np.ndarray:
    return (moved(x, n, sums, top) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: list[int], top: int) -> list[int]:
    far = moved(x, n, sums, top)
    most = int(abs(far).max())
    return (far * far if most * most * x.shape[1] < 1 << 62 else far.astype(object) ** 2).sum(1).tolist()


def summed(fit: DataFrame, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sums over all rows of `part`, `size` doubles of a matrix of rows: each task adds up its own, Spark adds the tasks'."""

    def run(batches: Iterator):
        total = np.zeros(size)
        for batch in batches:
            for _, x in matrices(batch, 0):
                total += part(x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "value"])

    rows = fit.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[rows.column("at").to_numpy()] = rows.column("value").to_numpy()
    return out


def totals(fit: DataFrame) -> tuple[int, list[int], int]:
    """The number of rows, the exact sums by dimension, and the largest |x|. Sums travel in two halves, so that none overflows."""

    def run(batches: Iterator):
        n, top, high, low = 0, 0, None, None
        for batch in batches:
            for _, x in matrices(batch, 0):
                n, top = n + len(x), max(top, int(np.abs(x).max()))
                upper, lower = (x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0)
                high, low = (upper, lower) if high is None else (high + upper, low + lower)
        if n:
            d = len(high)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(high), pa.array(low), pa.array([n] * d, pa.int64()), pa.array([top] * d, pa.int64())], names=["at", "high", "low", "n", "top"])

    rows = sorted(fit.mapInArrow(run, "at int, high long, low long, n long, top long").groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n"), F.max("top").alias("top")).collect())
    return (rows[0]["n"], [(r["high"] << 26) + r["low"] for r in rows], rows[0]["top"]) if rows else (0, [], 0)


def orthogonal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns that span what the block has outside the basis; a column with no length left is replaced by a random one."""
    out = basis
    for v in block.T:
        size = np.linalg.norm(v)
        while True:
            length = np.linalg.norm(v)
            for _ in range(2):
                v = v - out @ (out.T @ v)
            if np.linalg.norm(v) > 1e-12 * max(length, size) > 0:
                break
            v, size = rng.standard_normal(len(v)), 0.0
        v = v / np.linalg.norm(v)
        out = np.column_stack([out, v - out @ (out.T @ v)])
        out[:, -1] /= np.linalg.norm(out[:, -1])
    return out[:, basis.shape[1] :]


def lanczos(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, tolerance: float = 1e-14, most: int = 256, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix of d rows and their unit eigenvectors, from its products with blocks of k columns."""
    k = min(k, d)
    rng = np.random.default_rng(seed)
    basis = images = np.zeros((d, 0))
    block = orthogonal(rng.standard_normal((d, k)), basis, rng)
    least, idle = np.inf, 0
    while True:
        image = product(block)
        basis, images = np.column_stack([basis, block]), np.column_stack([images, image])
        inner = basis.T @ images
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = basis @ turn[:, :k]
        off = float(np.linalg.norm(images @ turn[:, :k] - vectors * values[:k], axis=0).max())
        scale = max(abs(values[0]), np.finfo(float).tiny)
        idle = idle + 1 if off > 0.5 * least else 0
        least = min(least, off)
        if basis.shape[1] == d or off <= tolerance * scale or (idle >= 3 and off <= 1e-10 * scale):
            return values[:k], vectors / np.linalg.norm(vectors, axis=0)
        outside = image - basis @ (basis.T @ image)
        if basis.shape[1] + k > max(most, 4 * k):
            keep = max(most, 4 * k) // 2
            basis = np.linalg.qr(basis @ turn[:, :keep])[0]
            images = product(basis)
        block = orthogonal(outside[:, : d - basis.shape[1]], basis, rng)


def learn(fit: DataFrame, k: int = 16) -> Model:
    """fit: (x), each vector once."""
    n, sums, top = totals(fit)
    d = len(sums)
    if not n:
        return Model(0, [], 0, np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)

    def product(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums, top)
            return c.T @ (c @ block)

        return summed(fit, block.size, part).reshape(block.shape) / n

    values, axes = lanczos(product, d, k)
    sound = values > 1e-11 * max(values[0], 0.0)
    values, axes = values[sound], axes[:, sound]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    m = len(values)

    def spread(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums, top) @ axes / np.sqrt(values)
        return np.concatenate([(w.T @ w).ravel(), [float(sum(deviations(x, n, sums, top))) / n / n]])

    last = summed(fit, m * m + 1, spread) / n
    return Model(n, sums, top, axes, values, float(last[-1]), float(np.abs(last[:-1].reshape(m, m) - np.eye(m)).max()) if m else 0.0)


def apply(rows: DataFrame, model: Model) -> DataFrame:
    """(id, deviation, whitened) of (id, x): whitened has an entry for each component."""
    n, sums, top, axes, values = model[:5]
    shrunk = axes / np.sqrt(values)

    def run(batches: Iterator):
        for batch in batches:
            for at, x in matrices(batch, 1):
                w = centred(x, n, sums, top) @ shrunk
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                far = [v if v < 1 << 63 else None for v in deviations(x, n, sums, top)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), pa.array(far, pa.int64()), lists], names=["id", "deviation", "whitened"])

    return rows.select("id", "x").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, scale: int = 64, shift: int = 1_000_000) -> tuple[DataFrame, Model]:
    """(id, deviation, whitened) of every sound row, and the model: whitened vectors of at most k components."""
    rows = quantised(vectors, id_col, vec_col, scale, shift)
    model = learn(settle(rows.select("x").distinct()), k)
    return apply(rows, model), model


def components_of(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16) -> DataFrame:
    """A row for each sound row and component."""
    rows, model = whiten(vectors, id_col, vec_col, k)
    shares = F.lit([float(v / model.trace) for v in model.values] or [0.0])
    out = rows.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
SQL: dict[str, str] = {}
