"""Operator 12: removal of word sequences that repeat, found by fixed-block anchors.

A window is `length` words on end of one document. A word goes if a window that covers it has a word sequence which also starts somewhere else.

1. Every document is cut into blocks of half a window (rounded up), one after the other. Any window holds a whole block of its document, and if the
   window repeats, that block is also found, at whatever offset, where it repeats. So blocks are the index, and the windows of a block's length that
   start at any word are the probes. Both are dealt by ranges of their hashes: probes as sorted gaps of some two bytes a word without their
   documents, blocks with document and number. A range marks which of its codes are met twice; blocks of such codes are the hits.
2. Hits are extended: only the windows around a hit, those that hold its block, can repeat. Their hashes of 64 bits are dealt by ranges with their places and
   counted. Those of a chunk of texts (about `chunk` words) are counted before they are dealt, so a sequence that is met a million times
   is sent once a chunk, and what a range holds of it grows with the chunks only.
3. Repeated windows that follow each other closely are one maximal repeat; a document gets the spans of its repeats, and texts lose the words in them.

Codes of probes have so many bits that few blocks are hits by chance, whatever the size of the input (such hits cost time, never a word). Two different
windows count as equal with a chance of 2^-64 a pair.

Texts are read three times. Hits and spans reach them by a broadcast if their bytes, summed first, are at most 32 MB, else by a shuffle join.

Cases: null, empty and short texts lose nothing; texts of any length count whole; where ids repeat or are null, each row is a document of its
own (rows are numbered in a written copy first), so two rows of one text remove each other's words; other columns stay and may have any names; an empty
table gives an empty table. Kept words are joined by one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import documents, portions, run_hashes, settle, utf8, word_bounds, word_hashes

#: A place that needs no answer: its chunk knows already that the window repeats.
KNOWN = np.uint32(0xFFFFFFFF)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, text): key tells every row, the id itself where ids are distinct whole numbers."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    whole = rows.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole and not rows.groupBy("id").agg(F.count("*").alias("k")).where("k > 1 or id is null").limit(1).count():
        return rows.select(F.col("id").cast("long").alias("key"), "id", "text")
    return settle(rows.select(F.monotonically_increasing_id().alias("key"), "id", "text"))


def beside(texts: DataFrame, rows: DataFrame, size: Column, how: str, most_bytes: int = 32 << 20) -> DataFrame:
    """texts joined with rows by key; rows are broadcast if their bytes are few."""
    total = rows.agg(F.sum(size + 64)).first()[0] or 0
    return texts.join(F.broadcast(rows) if total <= most_bytes else rows, "key", how)


def ends_of(first: np.ndarray) -> np.ndarray:
    """For each word of a batch, the end of its text."""
    return np.repeat(first[1:], np.diff(first))


def runs_from(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k words from each place, and whether they lie in one text; as long as the words less k - 1."""
    hashes = run_hashes(words, k)
    return hashes, np.arange(len(hashes)) + k <= ends_of(first)[: len(hashes)]


def words_in(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the first of each text."""
    raw, offsets = utf8(texts)
    starts, ends, first = word_bounds(raw, offsets)
    return word_hashes(raw, starts, ends, lower=False), first


def gaps_of(codes: np.ndarray) -> tuple[bytes, bool]:
    """Sorted codes as differences, two bytes each where they fit."""
    gaps = np.diff(codes, prepend=0)
    wide = bool(len(gaps)) and int(gaps.max()) > 65535
    return gaps.astype(np.uint32 if wide else np.uint16).tobytes(), wide


def hits(texts: DataFrame, length: int, size: int, chunk: int) -> DataFrame:
    """(key, no): the blocks whose words are also found elsewhere, and a few by chance. size: bytes of all texts."""
    block = (length + 1) // 2
    bits = max(32, int(np.ceil(np.log2(max(size, 1) / 4))) + 5)
    ranges = max(10, bits - 26)
    slots = bits - ranges
    shift, low = np.uint64(64 - bits), np.uint64((1 << slots) - 1)
    fields = [("range", pa.int32()), ("gaps", pa.binary()), ("wide", pa.bool_()), ("again", pa.binary()), ("codes", pa.binary()), ("keys", pa.binary()), ("nos", pa.binary())]

    def deal(batches: Iterator):
        def flush():
            probes = np.sort(np.concatenate(probing))
            fresh = np.concatenate([[True], probes[1:] != probes[:-1]])
            at = np.flatnonzero(fresh)
            probes, twice = probes[fresh], np.diff(np.append(at, len(probes))) > 1
            codes, keys, nos = (np.concatenate([x[i] for x in anchors]) for i in range(3))
            order = np.argsort(codes, kind="stable")
            codes, keys, nos = codes[order], keys[order], nos[order]
            edges = np.arange((1 << ranges) + 1, dtype=np.uint64) << np.uint64(slots)
            p, c = np.searchsorted(probes, edges), np.searchsorted(codes, edges)
            rows: dict[str, list] = {name: [] for name, _ in fields}
            for r in np.flatnonzero(np.diff(p)).tolist():
                own = (probes[p[r] : p[r + 1]] & low).astype(np.int64)
                gaps, wide = gaps_of(own)
                span = slice(c[r], c[r + 1])
                for name, value in zip(rows, (r, gaps, wide, own[twice[p[r] : p[r + 1]]].astype(np.uint32).tobytes(), (codes[span] & low).astype(np.uint32).tobytes(), keys[span].tobytes(), nos[span].tobytes())):
                    rows[name].append(value)
            return pa.RecordBatch.from_pydict(rows, schema=pa.schema(fields))

        probing, anchors, held = [], [], 0
        for batch in batches:
            for part in portions(batch, 1):
                words, first = words_in(part.column(1))
                hashes, whole = runs_from(words, first, block)
                sizes = np.diff(first)
                whole &= np.repeat(sizes >= length, sizes)[: len(hashes)]
                no = (np.arange(len(words)) - np.repeat(first[:-1], sizes))[: len(hashes)]
                anchor = whole & (no % block == 0)
                of = np.repeat(part.column(0).to_numpy(), sizes)[: len(hashes)]
                probing.append(hashes[whole] >> shift)
                anchors.append((hashes[anchor] >> shift, of[anchor], (no[anchor] // block).astype(np.int32)))
                held += len(probing[-1])
                if held >= chunk:
                    yield flush()
                    probing, anchors, held = [], [], 0
        if held:
            yield flush()

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, waiting = np.zeros(1 << slots, bool), np.zeros(1 << slots, bool), []
        for g in batches:
            for gaps, wide, again in zip(g.column("gaps"), g.column("wide").to_pylist(), g.column("again")):
                at = np.cumsum(np.frombuffer(gaps.as_buffer(), np.uint32 if wide else np.uint16).astype(np.int64))
                twice[at] |= once[at]
                once[at] = True
                twice[np.frombuffer(again.as_buffer(), np.uint32)] = True
            waiting.append([np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in g.column(name)]) for name, kind in (("codes", np.uint32), ("keys", np.int64), ("nos", np.int32))])
        for codes, keys, nos in waiting:
            found = twice[codes]
            if found.any():
                yield pa.RecordBatch.from_arrays([pa.array(keys[found]), pa.array(nos[found])], names=["key", "no"])

    dealt = texts.select("key", "text").mapInArrow(deal, "range int, gaps binary, wide boolean, again binary, codes binary, keys binary, nos binary")
    return dealt.groupBy("range").applyInArrow(meet, "key long, no int")


def extended(marked: DataFrame, length: int, size: int, chunk: int) -> DataFrame:
    """(chunk, range, codes, places, keys, bases): windows around hits, dealt by ranges of their hashes. marked: (key, text, nos).

    A place is the index of a word within its chunk. Rows of range -1 hold what a chunk knows by itself: the documents with the index of their first words, and
    the places of windows that it has met twice."""
    block = (length + 1) // 2
    ranges = int(np.clip(np.ceil(np.log2(max(size, 1) / 4)) - 18, 10, 20))
    shift = np.uint64(64 - ranges)
    fields = [("chunk", pa.int64()), ("range", pa.int32()), ("codes", pa.binary()), ("places", pa.binary()), ("keys", pa.binary()), ("bases", pa.binary())]

    def deal(batches: Iterator):
        from pyspark import TaskContext

        task, done = TaskContext.get().partitionId() << 32, 0
        codes, places, keys, bases, held = [], [], [], [], 0

        def flush():
            code, place = np.concatenate(codes), np.concatenate(places)
            order = np.argsort(code, kind="stable")
            code, place = code[order], place[order]
            fresh = np.concatenate([[True], code[1:] != code[:-1]]) if len(code) else np.zeros(0, bool)
            at = np.flatnonzero(fresh)
            times = np.diff(np.append(at, len(code)))
            own = place[np.repeat(times > 1, times)]
            code, place = code[at], np.where(times > 1, KNOWN, place[at])
            cut = np.searchsorted(code >> shift, np.arange((1 << ranges) + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cut)).tolist()
            rows = {"chunk": [task | done] * (len(full) + 1), "range": [-1, *full], "codes": [None, *(code[cut[r] : cut[r + 1]].tobytes() for r in full)], "places": [own.tobytes(), *(place[cut[r] : cut[r + 1]].tobytes() for r in full)]}
            rows |= {"keys": [np.array(keys, np.int64).tobytes(), *[None] * len(full)], "bases": [np.array(bases, np.int64).tobytes(), *[None] * len(full)]}
            return pa.RecordBatch.from_pydict(rows, schema=pa.schema(fields))

        for batch in batches:
            for part in portions(batch, 1):
                words, first = words_in(part.column(1))
                hashes, _ = runs_from(words, first, length)
                for key, a, b, nos in zip(part.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), part.column(2)):
                    ends = np.sort(nos.values.to_numpy()).astype(np.int64) * block
                    at = (ends[:, None] - np.arange(block - 1, -1, -1)).ravel()
                    at = np.unique(at[(at >= 0) & (at <= b - a - length)])
                    codes.append(hashes[a + at])
                    places.append((held + at).astype(np.uint32))
                    keys.append(key)
                    bases.append(held)
                    held += b - a
                    if held >= chunk:
                        yield flush()
                        done += 1
                        codes, places, keys, bases, held = [], [], [], [], 0
        if held:
            yield flush()

    return marked.select("key", "text", "nos").mapInArrow(deal, "chunk long, range int, codes binary, places binary, keys binary, bases binary")


def repeated(windows: DataFrame) -> DataFrame:
    """(chunk, places): of each chunk, places of windows that another chunk has, too."""

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, places, chunks = [], [], []
        for g in batches:
            for code, place, name in zip(g.column("codes"), g.column("places"), g.column("chunk").to_pylist()):
                codes.append(np.frombuffer(code.as_buffer(), np.uint64).copy())
                places.append(np.frombuffer(place.as_buffer(), np.uint32).copy())
                chunks.append(np.full(len(codes[-1]), name, np.int64))
        code, place, name = np.concatenate(codes), np.concatenate(places), np.concatenate(chunks)
        order = np.argsort(code, kind="stable")
        same = code[order][1:] == code[order][:-1]
        met = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        met = met[place[met] != KNOWN]
        met = met[np.argsort(name[met], kind="stable")]
        names, at = np.unique(name[met], return_index=True)
        if len(names):
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.tobytes() for x in np.split(place[met], at[1:])], pa.binary())], names=["chunk", "places"])

    return windows.where("range >= 0").select("range", "chunk", "codes", "places").groupBy("range").applyInArrow(meet, "chunk long, places binary")


def spans(windows: DataFrame, length: int) -> DataFrame:
    """(key, begins, ends): of documents with repeats, the words that go, as spans in order that neither meet nor overlap."""
    heads = windows.where("range = -1").select("chunk", "places", "keys", "bases")
    more = repeated(windows).select("chunk", "places", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("bases"))

    def gather(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, bases = [], None, None
        for g in batches:
            held += [np.frombuffer(v.as_buffer(), np.uint32).copy() for v in g.column("places")]
            for k, b in zip(g.column("keys"), g.column("bases")):
                if k.is_valid:
                    keys, bases = np.frombuffer(k.as_buffer(), np.int64).copy(), np.frombuffer(b.as_buffer(), np.int64).copy()
        place = np.sort(np.concatenate(held)).astype(np.int64)
        if not len(place):
            return
        of = np.searchsorted(bases, place, "right") - 1
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (place[1:] > place[:-1] + length)])
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(place)) - 1
        whose = of[begin]
        docs, at = np.unique(whose, return_index=True)
        cuts = pa.array(np.append(at, len(whose)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array((x - bases[whose]).astype(np.int32))) for x in (place[begin], place[last] + length)]
        yield pa.RecordBatch.from_arrays([pa.array(keys[docs]), *lists], names=["key", "begins", "ends"])

    return heads.unionByName(more).groupBy("chunk").applyInArrow(gather, "key long, begins array<int>, ends array<int>")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35, chunk: int = 2_000_000) -> DataFrame:
    """(id, n_words, n_removed, kept) of every row: its words, those that go, and the text of the others."""
    texts = numbered(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = settle(hits(texts, length, size, chunk).groupBy("key").agg(F.collect_list("no").alias("nos")))
    windows = settle(extended(beside(texts, found, 4 * F.size("nos"), "inner"), length, size, chunk))
    gone = settle(spans(windows, length))

    def run(batches: Iterator):
        for batch in batches:
            for part in portions(batch, 1):
                total, removed, kept = [], [], []
                for text, begins, ends in zip(part.column(1), part.column(2), part.column(3)):
                    words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                    total.append(len(words))
                    if begins.is_valid:
                        a, b = begins.values.to_pylist(), ends.values.to_pylist()
                        words = [w for x, y in zip([0, *b], [*a, len(words)]) for w in words[x:y]]
                    removed.append(total[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).view(pa.string())], names=["id", "n_words", "n_removed", "kept"])

    rows = beside(texts, gone, 8 * F.size("begins"), "left").select("id", "text", "begins", "ends")
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same in SQL, window by window.
_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
s AS (SELECT doc_id, p, array_to_string(l[p : p + 34], ' ') AS x FROM (SELECT doc_id, l, unnest(range(1, len(l) - 33)) AS p FROM w WHERE len(l) >= 35)),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY x) AS n FROM s) WHERE n > 1),
k AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS i FROM w) ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(len(l) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

QUERIES = {"op12_substring_dedup": op12_substring_dedup}
SQL = {"op12_substring_dedup": _SQL}
