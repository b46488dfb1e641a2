"""Operator 10: quality rules by line labelling: a linear-chain conditional random field marks the lines of a document as content or
boilerplate by Viterbi decoding, and the share of words in content lines decides whether the document is kept.

Features of a line are bits: bands of its length in words, of its shares of symbols, capitals, digits and repeated words, its end mark,
separators, and whether it repeats an earlier line. The field is learned by maximum likelihood on at most `most` labelled documents
(chosen by a hash of the id, none of over `lines` lines; only the bits of their lines reach the driver): lines take the quality label of their document, and
weights are held to a prior that states what boilerplate looks like, which also serves where no labels exist.

Base rules: word_chars, n_symbols, n_dup_lines and n_repeat_words count whole texts; base_failed is n_words < 10 or
100 * n_repeat_words > 20 * n_words.

Cases: null text has no words and no lines; an empty text too, and both fail the base rules; lines without a word are no line of the
chain; texts of any length are read whole; repeated rows give a row each; other columns are ignored; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import documents, light, portions, run_hashes, settle, utf8, word_bounds, word_hashes

#: The symbols that count.
SYMBOLS = "#*$%&|<>"
#: What each bit of a line says, and the prior weight for content (minus: boilerplate).
FEATURES = [
    ("1 or 2 words", -0.2), ("3 to 5 words", 0.1), ("6 to 11 words", 0.5), ("12 to 24 words", 0.8), ("25 or more words", 0.8),
    ("over 2 % symbols", -1.5), ("over 8 % symbols", -1.5), ("over half capitals", -1.5), ("over 20 % digits", -0.5),
    ("over 3 % exclamation marks", -1.0), ("under half of the words distinct, of 6 or more", -2.0), ("the same word three times on end", -1.0),
    ("ends in a full stop, question or exclamation mark", 0.5), ("holds a separator between words", -1.0), ("equals an earlier line", -1.0), ("always", 0.3),
]
N = len(FEATURES)
_IS = {name: np.zeros(256, bool) for name in ("symbol", "upper", "lower", "digit", "bang")}
_IS["symbol"][[ord(c) for c in SYMBOLS]] = True
_IS["upper"][65:91] = True
_IS["lower"][97:123] = True
_IS["digit"][48:58] = True
_IS["bang"][ord("!")] = True
_LEAD = np.ones(256, bool)  # bytes that begin a code point
_LEAD[0x80:0xC0] = False


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def profile(texts) -> dict[str, np.ndarray]:
    """Base counts of each text of an Arrow string array, and its lines: bits, words, and how many lines each text has."""
    raw, offsets = utf8(texts)
    n = len(offsets) - 1
    starts, ends, first = word_bounds(raw, offsets)
    hashes = word_hashes(raw, starts, ends, lower=False)
    n_words = np.diff(first)
    lead = _sums(_LEAD[raw])
    chars = lead[ends] - lead[starts]
    chars_to = np.concatenate([[0], np.cumsum(chars)])
    symbol = _sums(_IS["symbol"][raw])

    repeat = np.zeros(n, np.int64)
    runs = run_hashes(hashes, 5)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b - a > 5:
            own = runs[a : b - 4]
            order = np.argsort(own, kind="stable")
            ranked = own[order]
            same = np.zeros(len(own), bool)
            equal = ranked[1:] == ranked[:-1]
            same[order[1:][equal]] = True
            same[order[:-1][equal]] = True
            if same.any():
                cover = np.zeros(b - a + 1, np.int64)
                at = np.flatnonzero(same)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + 5, -1)
                repeat[i] = int((np.cumsum(cover) > 0).sum())

    # lines: between offsets and behind each \n; those without a word are left out
    begin = np.sort(np.concatenate([offsets[:-1], np.flatnonzero(raw == 10) + 1]))
    stop = np.concatenate([begin[1:] - 1, [len(raw)]]) if len(begin) else begin
    is_last = np.zeros(len(begin), bool)
    own = np.searchsorted(offsets[1:], begin, side="right") if n else np.zeros(0, np.int64)
    own = np.minimum(own, max(n - 1, 0))
    is_last[:-1] = own[1:] != own[:-1]
    stop = np.where(is_last, offsets[np.minimum(own + 1, n)], stop)
    w0, w1 = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
    # a line that begins where a text ends belongs to that text and is empty; it has no word, so it goes
    some = w1 > w0
    begin, stop, w0, w1 = begin[some], stop[some], w0[some], w1[some]
    own = np.searchsorted(first, w0, side="right") - 1
    size = w1 - w0
    line_hash = word_hashes(raw, begin, stop, lower=False)
    length = stop - begin
    dup = np.zeros(len(own), bool)
    order = np.lexsort((np.arange(len(own)), line_hash, length, own))
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        dup[b] = (own[a] == own[b]) & (line_hash[a] == line_hash[b]) & (length[a] == length[b])

    count = lambda name: (lambda c: c[stop] - c[begin])(_sums(_IS[name][raw]))
    words_chars = np.maximum(chars_to[w1] - chars_to[w0], 1)
    n_symbol, upper, lower, digit, bang = symbol[stop] - symbol[begin], count("upper"), count("lower"), count("digit"), count("bang")
    own_line = np.repeat(np.arange(len(own)), size)
    order = np.lexsort((hashes, own_line))
    fresh = np.ones(len(hashes), bool)
    if len(order) > 1:
        fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (own_line[order][1:] != own_line[order][:-1])
    distinct = np.bincount(own_line[order][fresh], minlength=len(own))
    triple = np.zeros(len(hashes), bool)
    if len(hashes) > 2:
        triple[2:] = (hashes[2:] == hashes[1:-1]) & (hashes[1:-1] == hashes[:-2]) & (own_line[2:] == own_line[:-2])
    triples = np.bincount(own_line[triple], minlength=len(own))
    last = raw[ends[w1 - 1] - 1] if len(own) else np.zeros(0, np.uint8)
    single = (ends - starts == 1) & (_IS["symbol"][raw[starts]] | (raw[starts] == ord("-")) | (raw[starts] == ord("/"))) if len(starts) else np.zeros(0, bool)
    singles = _sums(single)
    bits = np.zeros(len(own), np.int64)
    for k, flag in enumerate(
        [size <= 2, (size >= 3) & (size <= 5), (size >= 6) & (size <= 11), (size >= 12) & (size <= 24), size >= 25,
         50 * n_symbol > words_chars, 12 * n_symbol > words_chars, upper > lower, 5 * digit > words_chars,
         33 * bang > words_chars, (size >= 6) & (2 * distinct < size), triples > 0,
         np.isin(last, [46, 63, 33]), singles[w1] - singles[w0] > 0, dup, np.ones(len(own), bool)]
    ):
        bits |= flag.astype(np.int64) << k
    return {
        "n_words": n_words, "word_chars": chars_to[first[1:]] - chars_to[first[:-1]], "n_symbols": symbol[offsets[1:]] - symbol[offsets[:-1]],
        "n_dup_lines": np.bincount(own[dup], minlength=n), "n_repeat_words": repeat, "bits": bits, "sizes": size, "lines": np.bincount(own, minlength=n),
    }


def _expand(bits: np.ndarray) -> np.ndarray:
    return ((bits[:, None] >> np.arange(N)) & 1).astype(np.float64)


def prior() -> dict[str, np.ndarray]:
    return {"w": np.array([w for _, w in FEATURES]), "t": np.array([[0.5, -0.5], [-0.5, 0.5]])}


def _grid(lines: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each place in the chain: the texts that have it (longest first), and the positions of their lines."""
    at = np.concatenate([[0], np.cumsum(lines)[:-1]]) if len(lines) else lines
    order = np.argsort(-lines, kind="stable")
    sizes = lines[order]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        live = order[: int(np.searchsorted(-sizes, -k, side="left"))]
        yield live, at[live] + k


def viterbi(model: dict[str, np.ndarray], bits: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The best labels (1: content) of the lines of all texts at once."""
    emit = np.zeros((len(bits), 2))
    emit[:, 1] = _expand(bits) @ model["w"] if len(bits) else 0
    best = np.zeros((len(lines), 2))
    back = np.zeros((len(bits), 2), np.int8)
    steps = []
    for k, (live, at) in enumerate(_grid(lines)):
        if k:
            through = best[live][:, :, None] + model["t"][None]  # from, to
            back[at] = through.argmax(1)
            best[live] = through.max(1) + emit[at]
        else:
            best[live] = emit[at]
        steps.append((live, at))
    out = np.zeros(len(bits), np.int8)
    now = best.argmax(1).astype(np.int8)
    for k in range(len(steps) - 1, -1, -1):
        live, at = steps[k]
        out[at] = now[live]
        now[live] = back[at, now[live]]
    return out


def fit(bits: np.ndarray, lines: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 120, hold: float = 2e-3) -> dict[str, np.ndarray]:
    """Maximum likelihood of the field by forward and backward sums, with weights held to the prior. labels, weights: of lines, of texts."""
    start = prior()
    model = {k: v.copy() for k, v in start.items()}
    if not len(bits):
        return model
    x = _expand(bits)
    steps = list(_grid(lines))
    own = np.repeat(np.arange(len(lines)), lines)
    y = np.zeros((len(bits), 2))
    y[np.arange(len(bits)), labels] = 1
    total = weights.sum()
    m1, m2 = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    lse = lambda v, axis: (lambda top: np.log(np.exp(v - top).sum(axis, keepdims=True)) + top)(v.max(axis, keepdims=True)).squeeze(axis)
    for it in range(1, rounds + 1):
        emit = np.zeros((len(bits), 2))
        emit[:, 1] = x @ model["w"]
        fore, aft = emit.copy(), np.zeros((len(bits), 2))
        for k, (live, at) in enumerate(steps):
            if k:
                fore[at] = lse(fore[at - 1][:, :, None] + model["t"][None], 1) + emit[at]
        for k in range(len(steps) - 1, 0, -1):
            live, at = steps[k]
            aft[at - 1] = lse((emit[at] + aft[at])[:, None, :] + model["t"][None], 2)
        z = np.zeros(len(lines))
        z[steps[0][0]] = lse(fore[steps[0][1]] + aft[steps[0][1]], 1)
        p = np.exp(fore + aft - z[own][:, None])
        grad = {"w": ((y[:, 1] - p[:, 1]) * weights[own]) @ x / total, "t": np.zeros((2, 2))}
        for k, (live, at) in enumerate(steps):
            if k:
                pair = np.exp(fore[at - 1][:, :, None] + model["t"][None] + (emit[at] + aft[at])[:, None, :] - z[live][:, None, None])
                true = y[at - 1][:, :, None] * y[at][:, None, :]
                grad["t"] += ((true - pair) * weights[live][:, None, None]).sum(0) / total
        for k, v in model.items():
            g = grad[k] - hold * (v - start[k])
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            v += 0.08 * (m1[k] / (1 - 0.9**it)) / (np.sqrt(m2[k] / (1 - 0.99**it)) + 1e-9)
    return model


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 3000, lines: int = 2000) -> dict[str, np.ndarray]:
    """Learns the field from about `most` labelled documents at most, none of them of more than so many lines; both bound what reaches the
    driver, 2 bytes a line. Of rows that repeat an id one is learned from, the one whose lines sort last, so an id of very many rows is one row before anything is gathered."""
    n = labels.count()
    chosen = labels.where(F.col(label_col).isNotNull() & (F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) < min(1.0, most / max(n, 1)) * (1 << 20)))
    chosen = chosen.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for part in portions(batch, 0):
                found = profile(part.column(0))
                cut = np.concatenate([[0], np.cumsum(found["lines"])])
                packed = [found["bits"][a:b].astype("<u2").tobytes() if b - a <= lines else b"" for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array(packed, pa.binary()), part.column(1)], names=["id", "bits", "y"])

    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(light(chosen), "id").select("text", "y", "id")
    kind = T.StructType([known.schema["id"], T.StructField("bits", T.BinaryType()), T.StructField("y", T.IntegerType())])
    rows = known.mapInArrow(run, kind).groupBy("id").agg(F.max("bits").alias("bits"), F.max("y").alias("y")).collect()
    rows = sorted((r for r in rows if len(r["bits"])), key=lambda r: (r["y"], r["bits"]))
    if not rows:
        return prior()
    bits = np.concatenate([np.frombuffer(r["bits"], "<u2") for r in rows]).astype(np.int64)
    sizes = np.array([len(r["bits"]) // 2 for r in rows])
    y = np.array([r["y"] for r in rows])
    # each document counts once, however many lines it has
    return fit(bits, sizes, np.repeat(y, sizes), 1.0 / sizes)


def judge(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", share: float = 0.3) -> DataFrame:
    """(id, base counts, base_failed, content_share, kept) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for part in portions(batch, 1):
                found = profile(part.column(1))
                label = viterbi(held.value, found["bits"], found["lines"])
                own = np.repeat(np.arange(part.num_rows), found["lines"])
                content = np.bincount(own, weights=found["sizes"] * label, minlength=part.num_rows) / np.maximum(found["n_words"], 1)
                failed = (found["n_words"] < 10) | (100 * found["n_repeat_words"] > 20 * found["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(found[k].astype(np.int64)) for k in _BASE), pa.array(failed), pa.array(content), pa.array(~failed & (content >= share))],
                    names=[id_col, *_BASE, "base_failed", "content_share", "kept"],
                )

    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(k, T.LongType()) for k in _BASE)]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op10_line_crf": op10_line_crf}
SQL: dict[str, str] = {}
