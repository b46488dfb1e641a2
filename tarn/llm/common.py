"""Helpers that the operators of this package share: settled tables, word kernels, connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.session import scratch

#: The white space that separates words: \x20 and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Java form of a word.
WORD = r"[^\x20\x09-\x0D]+"


def settle(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing before it. The table goes when
    the driver ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def light(rows: DataFrame, width: int = 8, most_bytes: int = 32 << 20) -> DataFrame:
    """The side of a join, broadcast only where its bytes in memory, from a count of its rows, are few; width: bytes of a column."""
    return F.broadcast(rows) if rows.count() * (32 + width * len(rows.columns)) <= most_bytes else rows


def packed(df: DataFrame, id_col: str, **more: Column) -> DataFrame:
    """(__row, __id, ...): the rows of df as one column, so that no name of theirs clashes with those of an operator."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(id_col).alias("__id"), *[v.alias(k) for k, v in more.items()])


def unpacked(df: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The rows that `packed` made one column, with the columns named in new replaced."""
    return df.select(*[new.get(c, F.col("__row").getField(c)).alias(c) for c in names])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_VALUES_LOWER = _VALUES.copy()
_VALUES_LOWER[65:91] = _VALUES[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        size = 1 << max(19, int(n).bit_length())
        out = np.empty(size, np.uint64)
        out[0] = 1
        done = 1
        with np.errstate(over="ignore"):
            while done < size:
                step = min(done, size - done)
                out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
        _POWERS[base] = out
    return _POWERS[base][:n]


#: Large tables that operators keep in a worker from task to task; they go when the worker turns to another operator's texts.
HELD: list[dict] = []


def utf8(texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array on end, and where each text begins (one more: the end). Null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for held in HELD:
        held.clear()
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def portions(batch, text: int, most: int = 1 << 19):
    """Slices of a record batch with about that many bytes of text each, so that arrays stay small; a longer text comes alone."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of all words in byte positions, and the first word's index of each text (one more: the end)."""
    if not len(raw):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[raw]
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(raw)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word; lower: A-Z count as a-z."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((_VALUES_LOWER if lower else _VALUES)[raw] * _powers(_R, len(raw)), out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * _powers(_R_INV, len(raw) + 1)[starts])


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words on end, from the hashes of the words."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        n = len(words) - k + 1
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    return mix64(out)


def shingle_sets(texts, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of the k-word shingles of each text, A-Z lower-cased; a text of fewer words has its whole sequence as one."""
    raw, offsets = utf8(texts)
    starts, ends, first = word_bounds(raw, offsets)
    words = word_hashes(raw, starts, ends, lower=True)
    runs = run_hashes(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            out.append(run_hashes(np.concatenate([words[a:b], np.array([b - a], np.uint64)]), b - a + 1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Connected components of (a, b) links: (id, component), component the smallest id that links reach.

    Every round, each id takes the smallest label among its own and its neighbours' and then its label's label, so paths
    shorten by half. Sums by key are pre-aggregated, hence a node with very many links is no hot group. Each round is a written table."""
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to"))).where("id != to").distinct()
    both = settle(both)
    labels = settle(both.groupBy("id").agg(F.least(F.min("to"), F.first("id")).alias("component")))
    for _ in range(most):
        near = both.join(labels.select(F.col("id").alias("to"), F.col("component").alias("c")), "to").groupBy("id").agg(F.min("c").alias("c"))
        step = labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = settle(step.join(jump, "component", "left").select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        changed = new.where("component != old").limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most} rounds")
