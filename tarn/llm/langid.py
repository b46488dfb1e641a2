"""Operator 4: language identification by prediction by partial matching.

Each language has a variable-order context tree over bytes (orders 0 to 3) with escape probabilities (method C): in a context with N
bytes of q kinds, a byte seen n times has n / (N + q), and an escape to the next shorter context has q / (N + q). The statistics are
frozen after learning, so the code length of each byte in each context is worked out once; scoring adds exact code lengths, and
the language with the least total wins. Texts are lower-cased and everything but letters becomes one space, in learning and in scoring.

A tree keeps every byte and every context seen in learning, as sorted arrays for each order: the n-grams seen with their code lengths,
and the contexts seen with the cost of an escape. A slice of texts looks up each of its distinct 4-grams once in each language.
Learning counts 4-grams over at most `per_lang` rows a language, chosen by a hash of the id; only that sample bounds the model.

Cases: null text, empty text and texts without a letter give `und` and score 0; ties go to the language that sorts first; without
rows to learn from everything is `und`; null lang is not learned from; repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import documents, portions, settle, utf8

SPACE = 0x20
_NORMAL = np.full(256, SPACE, np.uint8)
_NORMAL[97:123] = np.arange(97, 123)
_NORMAL[65:91] = np.arange(97, 123)
_NORMAL[128:] = np.arange(128, 256)
_PAD = "   "


def normal(texts, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal bytes of an Arrow string array on end, each text behind three spaces, or behind the three normal bytes given; where each text
    begins (with one more: the end); and whether a byte is one of those three."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    raw, offsets = utf8(pc.binary_join_element_wise(pa.scalar(_PAD), lower, pa.scalar("")))
    raw = _NORMAL[raw]
    if before is not None:
        raw[:3] = before
    pad = np.zeros(len(raw), bool)
    for i in range(3):
        pad[offsets[:-1] + i] = True
    blank = raw == SPACE
    keep = ~blank | pad
    keep[1:] |= ~blank[:-1]
    index = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=index[1:])
    return raw[keep], index[offsets], pad[keep]


def grams(texts, langs: list[str]) -> list[tuple[str, int, int]]:
    code, offsets, pad = coded(texts)
    own = np.repeat(np.arange(len(langs)), np.diff(offsets))
    out = []
    for lang in sorted(set(langs)):
        mine = np.array([x == lang for x in langs])
        codes, n = np.unique(code[mine[own] & ~pad], return_counts=True)
        out += [(lang, c, k) for c, k in zip(codes.tolist(), n.tolist())]
    return out


def coded(texts, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As normal, with the 4-gram that ends at each byte in place of the byte."""
    raw, offsets, pad = normal(texts, before)
    r = raw.astype(np.uint32)
    code = np.zeros(len(r), np.uint32)
    code[3:] = (r[:-3] << 24) | (r[1:-2] << 16) | (r[2:-1] << 8) | r[3:]
    return code, offsets, pad


def place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted keys have each wanted one, and whether they have it."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Tree:
    """The frozen tree of one language: for each order the n-grams seen with their code lengths, and the contexts seen with the cost
    of an escape (bits)."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        self.orders: list[tuple[np.ndarray, ...]] = []
        for k in range(4):
            grams, own = np.unique((codes & ((1 << 8 * (k + 1)) - 1)).astype(np.uint32), return_inverse=True)
            count = np.bincount(own, n, len(grams))
            contexts, of = np.unique(grams >> 8, return_inverse=True)
            total, kinds = np.bincount(of, count, len(contexts)), np.bincount(of, minlength=len(contexts))
            self.orders.append((grams, (-np.log2(count / (total + kinds)[of])).astype(np.float32), contexts, (-np.log2(kinds / (total + kinds))).astype(np.float32)))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each 4-gram behind the three others."""
        out = np.full(len(codes), 8, np.float32)
        for k, (grams, own, contexts, escape) in enumerate(self.orders):
            code = codes & np.uint32((1 << 8 * (k + 1)) - 1)
            at, seen = place(contexts, code >> 8)
            out += np.where(seen, escape[at], 0)
            at, seen = place(grams, code)
            out = np.where(seen, own[at], out)
        return out


class Trees:
    """The frozen trees of all languages."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.trees = [Tree(*counts[lang]) for lang in self.langs]

    def lengths(self, texts, piece: int = 1 << 19) -> np.ndarray:
        """Code length in bits of each text in each language. A text that comes alone and is long is read piece by piece, each behind the last
        bytes of the one before, so that memory doesn't grow with it."""
        if len(texts) == 1 and len(texts[0].as_py() or "") > piece:
            import pyarrow as pa

            text, total, before = texts[0].as_py(), np.zeros((1, len(self.trees))), None
            for at in range(0, len(text), piece):
                part = pa.array([text[at : at + piece]], pa.string())
                total += self._lengths(part, before)
                before = normal(part, before)[0][-3:]
            return total
        return self._lengths(texts, None)

    def _lengths(self, texts, before: np.ndarray | None) -> np.ndarray:
        code, offsets, pad = coded(texts, before)
        kinds, own = np.unique(code, return_inverse=True)
        table = np.stack([tree.bits(kinds) for tree in self.trees], 1)
        bits = table.take(own, axis=0)
        bits[pad] = 0
        return np.add.reduceat(bits, offsets[:-1], axis=0, dtype=np.float64)


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, keep: int | None = None) -> Trees | None:
    """Trees from the rows given; at most about per_lang rows a language, with all their 4-grams, or the commonest `keep` a language if
    that is asked for."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_lang / n))])
    rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))

    def count(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for part in portions(batch, 0):
                found = grams(part.column(0), part.column(1).to_pylist())
                yield pa.RecordBatch.from_pydict({"lang": pa.array([x[0] for x in found], pa.string()), "code": pa.array([x[1] for x in found], pa.int64()), "n": pa.array([x[2] for x in found], pa.int64())})

    counted = settle(rows.select("text", "lang").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")))
    if keep is not None:
        least = {k: 1 for k in sizes}
        tally = counted.groupBy("lang", F.least("n", F.lit(4096)).alias("n")).agg(F.count("*").alias("kinds")).collect()
        for lang in sizes:
            held = 0
            for n, kinds in sorted(((r["n"], r["kinds"]) for r in tally if r["lang"] == lang), reverse=True):
                held += kinds
                if held > keep:
                    least[lang] = n + 1
                    break
        cut = F.create_map(*[F.lit(x) for k, n in least.items() for x in (k, n)])
        counted = counted.where(F.col("n") >= cut[F.col("lang")])
    found = counted.toPandas()
    out = {k: (g["code"].to_numpy(np.int64), g["n"].to_numpy(np.int64)) for k, g in found.groupby("lang")}
    return Trees(out) if out else None


def identify(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text; score is the share of the winner under equal priors."""
    held = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator):
        import pyarrow as pa
        import pyarrow.compute as pc

        trees = held.value
        for batch in batches:
            for part in portions(batch, 1):
                lettered = np.asarray(pc.fill_null(pc.match_substring_regex(part.column(1), r"\p{L}"), False))
                lang, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if trees is not None and lettered.any():
                    bits = trees.lengths(part.column(1))
                    odds = np.exp2(bits.min(1, keepdims=True) - bits)
                    best = bits.argmin(1)
                    score = np.where(lettered, odds[np.arange(len(best)), best] / odds.sum(1), 0.0)
                    lang = [trees.langs[b] if x else "und" for b, x in zip(best.tolist(), lettered.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def op4_lang_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trees = learn(docs.where(~held_out()), "doc_id", "text", "lang", per_lang=4000)
    return identify(docs, trees).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_lang_ppm": op4_lang_ppm}
SQL: dict[str, str] = {}
