"""Operator 7: near-duplicates among embeddings by randomised-rotation binary codes.

Every unit vector is rotated by a seeded random orthogonal matrix and stored as a binary code of four bits a component, the first its sign,
with a correction factor f, the inner product of the rotated vector with its code of length 1. The inner product of two codes over both
factors estimates the inner product of the vectors; with s = sqrt(1 - f^2) / f for each, its error is at most s_a / f_b + s_b for certain, and
eps / sqrt(d - 1) times that but for a chance that falls with exp(-eps^2). Pairs whose upper confidence bound is under the threshold go;
the others, and only they, are computed again in double precision.

Pairs come from tables keyed by sign bits of further rotations. The number of bits follows the number of vectors, so that cells
stay small, and the number of tables makes a pair at the threshold meet in one of them but for a chance of `miss`; closer pairs
meet far more surely. A cell over `block` vectors is cut into blocks that meet two by two, each in a task of its own. A pair that meets
in several tables counts in the first, which the bits of all keys tell. Equal vectors are one row with a weight throughout.

To a cell go the code, the factor and the key bits, never the vector. What leaves it is the vectors that the codes leave undecided with some
other for which this table is the first; only these are joined to their vectors and meet once more, in doubles. What leaves that step
is one row a vector: its links, and the least id it is connected with there. No pairs leave a task.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different length do not
link; rows that repeat an id count once (the vector that sorts last); ids are integers, rows of null id are left out; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import components, light, settle


#: Width of a step of the code, in standard deviations of a component: the least mean square error of 16 even steps for a normal variable.
STEP = 0.335


@lru_cache(64)
def rotation(d: int, k: int) -> np.ndarray:
    """The k-th random orthogonal matrix of d dimensions."""
    q, r = np.linalg.qr(np.random.default_rng([d, k, 7]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def plan(n: int, threshold: float, cell: int, miss: float) -> tuple[int, int]:
    """Bits of a key and number of tables for n vectors."""
    bits = max(2, round(np.log2(max(n, 1) / cell))) if n > cell else 1
    meet = (1 - np.arccos(threshold) / np.pi) ** bits
    return bits, max(1, int(np.ceil(np.log(miss) / np.log(1 - meet))))


def keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(n, tables): the cell of each vector in each table."""
    d = unit.shape[1]
    signs = np.concatenate([unit @ rotation(d, 1 + k) > 0 for k in range(-(-bits * tables // d))], axis=1)[:, : bits * tables]
    return signs.reshape(len(unit), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of rotated vectors, 0 to 15 a component (8 and more: positive), and correction factors."""
    u = unit @ rotation(unit.shape[1], 0)
    code = np.clip(np.floor(u * (np.sqrt(unit.shape[1]) / STEP)), -8, 7).astype(np.int64) + 8
    levels = code - 7.5
    return code.astype(np.uint8), ((u * levels).sum(1) / np.sqrt((levels * levels).sum(1))).astype(np.float32)


def estimates(code: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The code of length 1 over its factor: products of two such rows estimate inner products."""
    levels = code.astype(np.float32) - np.float32(7.5)
    return levels / (np.sqrt((levels * levels).sum(1)) * factor)[:, None]


def undecided(a: np.ndarray, fa: np.ndarray, b: np.ndarray, fb: np.ndarray, threshold: float, eps: float) -> np.ndarray:
    """Whether the upper confidence bound of each a with each b reaches the threshold. The bound of a row takes the least sure b of the block, so that
    it is one number a row; factors hardly differ."""
    d = a.shape[1]
    fa, fb = fa.astype(np.float64), float(fb.min())
    sa, sb = np.sqrt(np.maximum(1 - fa * fa, 0)) / fa, np.sqrt(max(1 - fb * fb, 0.0)) / fb
    sure = min(eps / np.sqrt(max(d - 1, 1)), 1.0)
    least = threshold - 1e-4 - (sure * (sa / fb + sb) + sa * sb)
    return a @ b.T >= least.astype(np.float32)[:, None]


def pack_rows(unit: np.ndarray, bits: int, tables: int) -> list[bytes]:
    """Of each vector the code (two components a byte), the factor (4 bytes) and the bits of all keys."""
    code, factor = codes(unit)
    if code.shape[1] % 2:
        code = np.concatenate([code, np.zeros((len(code), 1), np.uint8)], axis=1)
    nibbles = code[:, 0::2] << 4 | code[:, 1::2]
    marks = np.packbits((keys(unit, bits, tables)[:, :, None] >> np.arange(bits) & 1).reshape(len(unit), -1).astype(bool), axis=1)
    return [r.tobytes() for r in np.concatenate([nibbles, factor.reshape(-1, 1).view(np.uint8), marks], axis=1)]


def codes_in(column, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and factors from packed rows."""
    raw = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)
    half = -(-d // 2)
    code = np.stack([raw[:, :half] >> 4, raw[:, :half] & 15], axis=2).reshape(len(raw), -1)[:, :d]
    return code, np.ascontiguousarray(raw[:, half : half + 4]).view(np.float32)[:, 0]


def keys_in(column, d: int, bits: int, tables: int) -> np.ndarray:
    """(n, tables): the cells of packed rows."""
    raw = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)[:, -(-d // 2) + 4 :]
    return np.unpackbits(raw, axis=1)[:, : bits * tables].reshape(len(raw), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def first_here(ka: np.ndarray, kb: np.ndarray, i: np.ndarray, j: np.ndarray, t: int) -> np.ndarray:
    """Whether table t is the first in which the pairs i, j meet."""
    new = np.ones(len(i), bool)
    for at in range(0, len(i) if t else 0, 100_000):
        new[at : at + 100_000] = ~(ka[i[at : at + 100_000], :t] == kb[j[at : at + 100_000], :t]).any(1)
    return new


def unit_of(v) -> np.ndarray | None:
    """The unit vector in double precision; null of vectors that link with nothing. Scaled first, so that very small or large components neither
    vanish nor overflow."""
    x = np.asarray([] if v is None else v, dtype=np.float64)
    top = np.abs(x).max() if len(x) else 0.0
    if not (np.isfinite(x).all() and top > 0):
        return None
    x = x / top
    return x / np.sqrt((x * x).sum())


def units_of(column, kind) -> np.ndarray:
    """The unit vectors of sound vectors of one length, from their bytes."""
    x = np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def near_classes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, eps: float = 6.0, cell: int = 1024, miss: float = 1e-4, block: int = 1024) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector."""
    single = vectors.schema[vec_col].dataType.elementType.typeName() == "float"
    given = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("v"))
    kind = np.float32 if single else np.float64
    if given.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").limit(1).count():
        given = settle(given.groupBy("id").agg(F.max("v").alias("v")))
    sizes = {r["d"]: r["n"] for r in given.where("size(v) > 0").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    plans = {d: plan(n, threshold, cell, miss) for d, n in sizes.items()}

    def pack(batches: Iterator):
        import pandas as pd

        for g in batches:
            units = [unit_of(v) for v in g["v"]]
            size = np.array([0 if u is None else len(u) for u in units], np.int64)
            out = pd.DataFrame({"id": g["id"].to_numpy(), "d": size, "same": b"", "raw": b"", "packed": b""}, dtype=object)
            for d in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == d)
                unit = np.stack([units[i] for i in at]) + 0.0
                out.loc[at, "same"] = pd.Series([blake2b(u.tobytes(), digest_size=16).digest() for u in unit], index=at)
                out.loc[at, "raw"] = pd.Series([np.asarray(g["v"].iloc[i], kind).tobytes() for i in at], index=at)
                out.loc[at, "packed"] = pd.Series(pack_rows(unit, *plans[d]), index=at)
            yield out.astype({"id": np.int64, "d": np.int32})

    base = settle(given.mapInPandas(pack, "id long, d int, same binary, raw binary, packed binary"))
    reps = settle(base.where("d > 0").groupBy("d", "same").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.min_by("packed", "id").alias("packed")))

    def count_cells(batches: Iterator):
        import pandas as pd

        for g in batches:
            for d, own in g.groupby("d"):
                bits, tables = plans[int(d)]
                cells, n = np.unique(keys_in(own["packed"], int(d), bits, tables) + (np.arange(tables) << bits), return_counts=True)
                yield pd.DataFrame({"d": int(d), "cell": cells, "n": n})

    def tables(batches: Iterator):
        import pandas as pd

        for g in batches:
            for d, own in g.groupby("d"):
                bits, tables = plans[int(d)]
                for at in range(0, len(own), 500):
                    part = own.iloc[at : at + 500]
                    cells = keys_in(part["packed"], int(d), bits, tables) + (np.arange(tables) << bits)
                    rep = {c: np.repeat(part[c].to_numpy(), tables) for c in ("rep", "weight", "packed")}
                    yield pd.DataFrame({"d": int(d), "cell": cells.ravel(), "id": rep["rep"], "weight": rep["weight"], "packed": rep["packed"]})

    counts = reps.select("d", "packed").mapInPandas(count_cells, "d int, cell long, n long")
    full = settle(counts.groupBy("d", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > block).select("d", "cell", F.ceil(F.col("n") / block).cast("long").alias("blocks")))
    entries = reps.select("d", "rep", "weight", "packed").mapInPandas(tables, "d int, cell long, id long, weight long, packed binary")
    dealt = entries.join(light(full), ["d", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("d", "cell", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "weight", "packed")

    def sides(key, g):
        """The two sides of a group in order of ids, the table and the plan; none where nothing can meet."""
        d, cell, x, y = (int(k) for k in key)
        g = g.sort_values("id", kind="stable")
        left, right = (g, g) if x == y else (g[g["own"] == x], g[g["own"] == y])
        bits, count = plans[d]
        return (left, right, d, cell >> bits, bits, count) if len(g) > 1 and len(left) and len(right) else None

    def by_codes(key, g):
        import pandas as pd

        found = sides(key, g)
        need = np.zeros(0, np.int64)
        if found:
            left, right, d, t, bits, count = found
            code_b, fb = codes_in(right["packed"], d)
            code_a, fa = (code_b, fb) if left is right else codes_in(left["packed"], d)
            a, b = estimates(code_a, fa), estimates(code_b, fb)
            kb = keys_in(right["packed"], d, bits, count)
            ka = kb if left is right else keys_in(left["packed"], d, bits, count)
            use_a, use_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
            for at in range(0, len(a), 512):
                maybe = undecided(a[at : at + 512], fa[at : at + 512], b, fb, threshold, eps)
                i, j = np.nonzero(np.triu(maybe, at + 1) if left is right else maybe)
                new = first_here(ka, kb, i + at, j, t)
                use_a[i[new] + at], use_b[j[new]] = True, True
            need = np.unique(np.concatenate([left["id"].to_numpy()[use_a], right["id"].to_numpy()[use_b]]))
        out = g[g["id"].isin(need)]
        return pd.DataFrame({c: out[c] for c in ("d", "cell", "x", "y", "own", "id", "weight")})

    def in_doubles(key, g):
        import pandas as pd

        found = sides(key, g)
        none = pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        if not found:
            return none
        left, right, d, t, bits, count = found
        b = units_of(right["raw"], kind)
        a = b if left is right else units_of(left["raw"], kind)
        link = np.zeros((len(a), len(b)), bool)
        for at in range(0, len(a), 512):
            link[at : at + 512] = a[at : at + 512] @ b.T >= threshold
        i, j = np.nonzero(np.triu(link, 1) if left is right else link)
        new = first_here(keys_in(left["packed"], d, bits, count), keys_in(right["packed"], d, bits, count), i, j, t)
        i, j = i[new], j[new]
        if not len(i):
            return none
        ids_a, ids_b, wa, wb = left["id"].to_numpy(), right["id"].to_numpy(), left["weight"].to_numpy(), right["weight"].to_numpy()
        ids = np.unique(np.concatenate([ids_a[i], ids_b[j]]))
        p, q = np.searchsorted(ids, ids_a[i]), np.searchsorted(ids, ids_b[j])
        links = np.bincount(p, weights=wb[j], minlength=len(ids)) + np.bincount(q, weights=wa[i], minlength=len(ids))
        root = np.arange(len(ids))
        while True:
            low = root.copy()
            np.minimum.at(low, p, root[q])
            np.minimum.at(low, q, root[p])
            low = low[low]
            if (low == root).all():
                break
            root = low
        return pd.DataFrame({"id": ids, "links": links.astype(np.int64), "root": ids[root]})

    near = settle(dealt.groupBy("d", "cell", "x", "y").applyInPandas(by_codes, "d int, cell long, x long, y long, own long, id long, weight long"))
    doubles = near.join(base.where("d > 0").select("id", "raw", "packed"), "id")
    met = settle(doubles.groupBy("d", "cell", "x", "y").applyInPandas(in_doubles, "id long, links long, root long"))
    classes = components(met.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
    counted = met.groupBy("id").agg(F.sum("links").alias("links"))
    named = reps.select("d", "same", "rep", "weight").join(counted.withColumnRenamed("id", "rep"), "rep", "left").join(classes.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("d", "same", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = base.select("id", "d", "same").join(named, ["d", "same"], "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def op7_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op7_embedding_neardup": op7_embedding_neardup}
SQL: dict[str, str] = {}
