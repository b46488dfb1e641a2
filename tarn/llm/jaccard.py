"""Operator 6: n-gram Jaccard join by a token-group matrix.

Documents are sets of 64-bit hashes of five-word shingles; two link when 100 * intersection >= 75 * union. Steps:

1. One pass gives each document its set's size, a 128-bit digest and its eight least hashes. Equal sets become one representative.
2. Similar documents are brought into groups: each representative is compared exactly with the first document under its least hashes, so
   every comparison is with one leader and never among all members. Verified links give classes, cut into groups of about `group` members.
3. The matrix: a column for each token, with the groups that hold it. Only the columns that can decide are made: of a set of n
   shingles, the first n - ceil(3n/4) + 1 in a fixed order; a partner must share one of them. In that order come tokens last
   that are frequent in the corpus (counted over all tokens of all documents), as passages that many documents share. A group
   of several members has one row in a column, with the bounds of its members' sizes.
4. Columns are sorted by token and read as a stream, so that a task holds one column at a time; a column of more than `long` groups leaves
   in blocks, and these meet two by two in tasks of their own. Columns give pairs of groups of different classes.
5. A member's overlap with the union of the other group's tokens bounds its overlap with any of its members; only groups with an
   overlap of 3/4 of the member's size are opened, and their members compared exactly.
6. Components of all links found. No link between different classes is lost: the prefix and the union bounds are exact.

What grows with a group of copies or near copies is a row a document. The frequent tokens that every task gets are at most `most_hot`
(the threshold of frequency rises until they are), 4 bytes each. Rows whose texts are read again are found by a broadcast of
ids if these take at most 32 MB, else by a shuffle join.

Cases: null and empty texts and texts without words have size 0 and link with nothing; under five words the whole sequence is the one
shingle; texts of any length count whole; of rows that repeat an id the text that sorts last stands for the id, and each of them gets
its own size and the id's component; rows of null id have a size and no component, and link with nothing; ids are integers; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import components, documents, light, packed, portions, settle, shingle_sets, unpacked

KEYS = 8


def profile(docs: DataFrame) -> DataFrame:
    """(id, n, d1, d2, keys): size, digest and least hashes of the set of every whole text. docs: (id, text)."""

    def run(batches: Iterator):
        for batch in batches:
            for part in portions(batch, 1):
                sets = shingle_sets(part.column(1))
                with np.errstate(over="ignore"):
                    d1 = [int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0 for s in sets]
                    d2 = [int((s * (s | np.uint64(1)) ^ (s >> np.uint64(7))).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
                flat = np.concatenate([s[:KEYS] for s in sets]).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum([min(KEYS, len(s)) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "n", "d1", "d2", "keys"])

    return docs.mapInArrow(run, "id long, n long, d1 long, d2 long, keys array<long>")


def attach(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """texts (id, text) with the rows of the same id (id, ...)."""
    return texts.join(light(rows), "id")


def token_sets(rows: DataFrame, short: bool = False) -> DataFrame:
    """(id, ..., tokens) from (id, text, ...): whole sets as bytes; short: the upper 24 bits of each token, in order."""
    more = [c for c in rows.columns if c not in ("id", "text")]

    def run(batches: Iterator):
        for batch in batches:
            for part in portions(batch, 1):
                sets = shingle_sets(part.column(1))
                if short:
                    sets = [(s >> np.uint64(40)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3] for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", *more, "tokens"])

    return rows.select("id", "text", *more).mapInArrow(run, ", ".join(["id long", *(f"{c} long" for c in more), "tokens binary"]))


def long_codes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def verify(pairs: DataFrame, texts: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The (a, b) of the pairs given whose sets link. Only sets of a travel, each to its b."""
    num, den = threshold

    def run(batches: Iterator):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = den * shared >= num * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    a = token_sets(attach(texts, pairs.select(F.col("a").alias("id"), "b"))).select(F.col("id").alias("a"), "b", F.col("tokens").alias("x"))
    b = token_sets(attach(texts, pairs.select(F.col("b").alias("id")).distinct())).select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    return a.join(b, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def hot_tokens(docs: DataFrame, total: int, most_hot: int) -> np.ndarray:
    """The upper halves of the tokens that more texts hold than a threshold, sorted: the least threshold of 8 or more that leaves
    at most most_hot tokens.

    Each task sorts the tokens of its texts and writes them by range, as gaps of two bytes; each range has a counter for each of
    its tokens, whatever the size of the corpus."""
    bits = int(np.clip(np.ceil(np.log2(max(total, 1) / (1 << 22))), 10, 20))

    def deal(batches: Iterator):
        def flush(held):
            t = np.sort(np.concatenate(held))
            fresh = np.concatenate([[True], t[1:] != t[:-1]])
            uniq, n = t[fresh], np.diff(np.append(np.flatnonzero(fresh), len(t)))
            cut = np.searchsorted(uniq, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32 - bits))
            rows = {"range": [], "gaps": [], "wide": [], "more": []}
            for k in np.flatnonzero(np.diff(cut)).tolist():
                own = uniq[cut[k] : cut[k + 1]].astype(np.int64) - (k << (32 - bits))
                gaps, times = np.diff(own, prepend=0), n[cut[k] : cut[k + 1]]
                wide = bool(gaps.max() > 65535)
                again = times > 1
                rows["range"].append(k)
                rows["gaps"].append(gaps.astype(np.uint32 if wide else np.uint16).tobytes())
                rows["wide"].append(wide)
                rows["more"].append(np.stack([own[again], times[again] - 1]).astype(np.uint32).tobytes())
            return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("range", pa.int32()), ("gaps", pa.binary()), ("wide", pa.bool_()), ("more", pa.binary())]))

        held, size = [], 0
        for batch in batches:
            for part in portions(batch, 0):
                for s in shingle_sets(part.column(0)):
                    held.append((s >> np.uint64(32)).astype(np.uint32))
                    size += len(s)
                if size > 3_000_000:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def tally(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << (32 - bits), np.uint32)
        for g in batches:
            for gaps, wide, more in zip(g.column("gaps"), g.column("wide").to_pylist(), g.column("more")):
                n[np.cumsum(np.frombuffer(gaps.as_buffer(), np.uint32 if wide else np.uint16).astype(np.int64))] += 1
                at, times = np.frombuffer(more.as_buffer(), np.uint32).reshape(2, -1)
                n[at] += times
        hot = np.flatnonzero(n > 8)
        yield pa.RecordBatch.from_arrays([pa.array(hot + (key[0].as_py() << (32 - bits)), pa.int64()), pa.array(n[hot].astype(np.int64))], names=["token", "n"])

    found = settle(docs.select(docs.columns[1]).mapInArrow(deal, "range int, gaps binary, wide boolean, more binary").groupBy("range").applyInArrow(tally, "token long, n long"))
    # how many tokens have each of at most some hundred classes of frequency
    level = F.floor(F.log2("n") * 8)
    least, held = 0, 0
    for r in sorted(found.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect(), reverse=True):
        held += r["k"]
        if held > most_hot:
            least = r["level"] + 1
            break
    found = found.where(level >= least).select("token").toPandas()
    return np.sort(found["token"].to_numpy(np.int64)).astype(np.uint32)


def prefixes(docs: DataFrame, hot: np.ndarray, threshold: tuple[int, int]) -> DataFrame:
    """(id, h, tokens): how many tokens of each set are frequent, and those of its tokens one of which any partner shares, frequent
    ones last in the order. The lowest bit of a token says whether it is frequent."""
    num, den = threshold
    held = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator):
        hot = held.value
        for batch in batches:
            for part in portions(batch, 1):
                out, frequent = [], []
                for s in shingle_sets(part.column(1)):
                    n, h = len(s), 0
                    s = s & ~np.uint64(1)
                    if not n:
                        out.append(s)
                        frequent.append(0)
                        continue
                    most = n - -(-num * n // den) + 1
                    if len(hot):
                        upper = (s >> np.uint64(32)).astype(np.uint32)
                        late = hot[np.minimum(np.searchsorted(hot, upper), len(hot) - 1)] == upper
                        s, h = np.concatenate([s[~late], s[late] | np.uint64(1)]), int(late.sum())
                    out.append(s[:most])
                    frequent.append(h)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(frequent, pa.int64()), tokens], names=["id", "h", "tokens"])

    return docs.mapInArrow(run, "id long, h long, tokens array<long>")


CELL = ["token", "class", "group", "low", "high", "h"]


def matrix(entries: DataFrame) -> DataFrame:
    """(token, class, group, low, high, h): a row for each token of a group, with the bounds of its members' sizes and the most
    frequent tokens that one of them has. entries: (id, class, group, k, n, h, tokens), k the size of the class."""
    rows = lambda which: entries.where(which).select(F.explode("tokens").alias("token"), "class", "group", "n", "h")
    one = rows("k = 1").select("token", "class", "group", F.col("n").alias("low"), F.col("n").alias("high"), "h")
    return one.unionByName(rows("k > 1").groupBy("token", "class", "group").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("h").alias("h")))


def fitting(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Whether cells of one column (last axis: class, group, low, high, h, frequent) can have members that link.

    Sets that share a token which isn't frequent meet in its column. Those that meet in the column of a frequent token only can
    thus share frequent tokens at most, which bounds their overlap by h."""
    num, den = threshold
    fits = (a[..., 0] != b[..., 0]) & (den * a[..., 3] >= num * b[..., 2]) & (den * b[..., 3] >= num * a[..., 2])
    return fits & ((a[..., 5] == 0) | ((num + den) * np.minimum(a[..., 4], b[..., 4]) >= num * (a[..., 2] + b[..., 2])))


def crossing(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int], same: bool) -> Iterator[np.ndarray]:
    """The pairs of groups of two blocks of a column that fit, the one of the greater class first; a few hundred rows at a time."""
    for at in range(0, len(a), 256):
        i, j = np.nonzero(fitting(a[at : at + 256, None], b[None], threshold))
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        yield ordered(a[i], b[j])


def ordered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    swap = a[:, 0] < b[:, 0]
    return np.stack([np.where(swap, b[:, 1], a[:, 1]), np.where(swap, a[:, 1], b[:, 1])], 1)


def columns(cells: DataFrame, threshold: tuple[int, int], long: int = 4096) -> DataFrame:
    """(q, g): pairs of groups of different classes that meet in a column of the matrix."""

    def meet(batches: Iterator):
        found: list[np.ndarray] = []
        names = ["q", "g", "token", "block", "cells"]

        def pairs() -> pa.RecordBatch:
            p = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            found.clear()
            none = pa.nulls(len(p), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), none, none, pa.nulls(len(p), pa.binary())], names=names)

        def block(rows: np.ndarray, k: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array(rows[:1, 0]), pa.array([k], pa.int64()), pa.array([marked(rows).tobytes()], pa.binary())], names=names)

        def marked(rows: np.ndarray) -> np.ndarray:
            return np.concatenate([rows[:, 1:], rows[:, :1] & 1], axis=1)

        def whole(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Columns that are there whole: long ones leave in blocks."""
            cell, token = marked(rows), rows[:, 0]
            begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.append(begin, len(token)))
            small = np.repeat(size <= 8, size)
            for d in range(1, 8):
                i = np.flatnonzero((token[d:] == token[:-d]) & small[d:])
                i = i[fitting(cell[i], cell[i + d], threshold)]
                found.append(ordered(cell[i], cell[i + d]))
            for at, n in zip(begin[size > 8].tolist(), size[size > 8].tolist()):
                own = cell[at : at + n]
                if own[:, 0].min() == own[:, 0].max():
                    continue
                if n > long:
                    yield from (block(rows[at + k : min(at + k + long, at + n)], k // long) for k in range(0, n, long))
                else:
                    found.extend(crossing(own, own, threshold, True))
            if sum(map(len, found)) > 200_000:
                yield pairs()

        held, size, blocks = [], 0, 0  # rows not yet compared; how many; blocks of the column at their end that have left
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns], 1))
            size += batch.num_rows
            if size < 12 * long:
                continue
            rows = np.concatenate(held)
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # where the last column begins
            if blocks and cut:
                own = int(np.searchsorted(rows[:, 0], rows[0, 0], side="right"))
                yield block(rows[:own], blocks)
                rows, cut, blocks = rows[own:], cut - own, 0
            yield from whole(rows[:cut])
            rows = rows[cut:]
            while len(rows) > long:
                yield block(rows[:long], blocks)
                rows, blocks = rows[long:], blocks + 1
            held, size = [rows], len(rows)
        rows = np.concatenate(held) if held else np.zeros((0, len(CELL)), np.int64)
        if blocks and len(rows):
            own = int(np.searchsorted(rows[:, 0], rows[0, 0], side="right"))
            yield block(rows[:own], blocks)
            rows = rows[own:]
        if len(rows):
            yield from whole(rows)
        yield pairs()

    def meet_blocks(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = key[1].as_py(), key[2].as_py()
        blocks = {k: np.frombuffer(v, np.int64).reshape(-1, len(CELL)) for b in batches for k, v in zip(b.column("block").to_pylist(), b.column("cells").to_pylist())}
        for p in crossing(blocks[x], blocks[y], threshold, x == y):
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["q", "g"])

    met = settle(cells.select(CELL).repartition("token").sortWithinPartitions("token").mapInArrow(meet, "q long, g long, token long, block long, cells binary"))
    pairs, blocks = met.where("token IS NULL").select("q", "g"), met.where("token IS NOT NULL").drop("q", "g")
    many = blocks.groupBy("token").agg(F.max("block").alias("last"))
    dealt = blocks.join(many, "token").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    dealt = dealt.select("token", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "cells")
    return pairs.unionByName(dealt.groupBy("token", "x", "y").applyInArrow(meet_blocks, "q long, g long")).distinct()


def qualify(pairs: DataFrame, members: DataFrame, texts: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The (q, g) of which document q overlaps the union of group g so far that a member can link. pairs: (q, g) of groups; members:
    (id, g, k), k the size of the class. 24 bits of a token serve, as they can only make the bound larger."""
    num, den = threshold

    def union(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, held = None, np.zeros(0, np.uint32)
        for g in batches:
            sets = [long_codes(t.as_py()) for t in g.column("tokens")]
            low = min([*map(len, sets), *([] if low is None else [low])])
            held = np.unique(np.concatenate([held, *sets]))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([low], pa.int64()), pa.array([held.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()], pa.binary())], names=["g", "low", "union"])

    def run(batches: Iterator):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, low, y) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4))):
                x, y = long_codes(x.as_py()), long_codes(y.as_py())
                shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
                keep[i] = (num + den) * shared >= num * (len(x) + max(low, -(-num * len(x) // den)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["q", "g"])

    asked = pairs.join(members.select(F.col("g").alias("q"), "id"), "q").select("id", "g")
    opened = settle(members.join(pairs.select("g").distinct(), "g", "left_semi").select("id", "g", "k"))
    alone, several = (token_sets(attach(texts, opened.where(which).select("id", "g")), short=True) for which in ("k = 1", "k > 1"))
    unions = several.groupBy("g").applyInArrow(union, "g long, low long, union binary").unionByName(alone.select("g", F.floor(F.octet_length("tokens") / 3).alias("low"), F.col("tokens").alias("union")))
    queries = token_sets(attach(texts, asked), short=True).select(F.col("id").alias("q"), "g", "tokens")
    return queries.join(unions, "g").select("q", "g", "tokens", "low", "union").mapInArrow(run, "q long, g long")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (3, 4), group: int = 64, most_hot: int = 1 << 22, long: int = 4096) -> DataFrame:
    """(id, n_shingles, component_id) of every document."""
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    each = settle(profile(every))
    sets, texts = each.where("id IS NOT NULL"), every.where("id IS NOT NULL")
    again = sets.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").limit(1).count() > 0
    if again:
        texts = settle(texts.groupBy("id").agg(F.max("text").alias("text")))
        sets = settle(profile(texts))
    equal = sets.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.min_by("keys", "id").alias("keys"))
    reps = settle(equal)

    # groups: each representative against the leaders under its least hashes
    keyed = reps.select("rep", "n", F.explode("keys").alias("key"))
    lead = keyed.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("lead"), F.count("*").alias("k")).where("k > 1").select("key", F.col("lead.rep").alias("b"), F.col("lead.n").alias("m"))
    star = keyed.join(lead, "key").where(f"rep != b and {threshold[1]} * least(n, m) >= {threshold[0]} * greatest(n, m)")
    star = settle(star.groupBy(F.col("rep").alias("a"), "b").agg(F.count("*").alias("k")).where("k >= 2").select("a", "b"))
    links = settle(verify(star, texts, threshold))
    first = components(links)
    # a class of one has no row among the links; only linked ones are counted
    linked = first.join(light(first.groupBy("component").agg(F.count("*").alias("k"))), "component").select(F.col("id").alias("rep"), "component", "k")
    classes = reps.join(linked, "rep", "left").select("rep", "n", F.coalesce("component", "rep").alias("class"), F.coalesce("k", F.lit(1)).alias("k"))
    block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("k") / group).cast("long"))
    classes = settle(classes.withColumn("group", F.when(F.col("k") <= group, F.col("class")).otherwise(F.xxhash64("class", block))))

    # the matrix over groups, and the groups that its columns bring together
    total = sets.agg(F.sum("n")).first()[0] or 0
    hot = hot_tokens(texts, total, most_hot)
    entries = settle(attach(prefixes(texts, hot, threshold), classes.withColumnRenamed("rep", "id")))
    met = settle(columns(matrix(entries), threshold, long))
    last = first
    if met.limit(1).count():
        groups = met.select("g").unionByName(met.select(F.col("q").alias("g"))).distinct()
        members = settle(classes.select(F.col("group").alias("g"), F.col("rep").alias("id"), "k").join(groups, "g", "left_semi"))
        opened = settle(qualify(met, members, texts, threshold))
        pairs = settle(opened.join(members.select("g", F.col("id").alias("b")), "g").select(F.col("q").alias("a"), "b"))
        last = components(links.unionByName(verify(pairs, texts, threshold)))
    named = reps.join(last.withColumnRenamed("id", "rep"), "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    found = sets.join(named, ["n", "d1", "d2"], "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    if again:
        found = each.where("id IS NOT NULL").select("id", "n").join(found.select("id", "component"), "id")
    found = found.unionByName(each.where("id IS NULL").select("id", "n", F.lit(None).cast("long").alias("component")))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which no row before them is linked to by any chain: of each class the row of least id stays, null last. Rows
    that repeat an id, and rows of null id, are documents of their own: one goes only if its text is linked with one that stays."""
    names = docs.columns
    if docs.groupBy(id_col).agg(F.count("*").alias("__n")).where(F.col(id_col).isNull() | (F.col("__n") > 1)).limit(1).count():
        rows = settle(packed(docs, id_col, __key=F.monotonically_increasing_id()))
        classes = settle(jaccard_classes(rows.select("__key", F.col("__row").getField(text_col).alias("__text")), "__key", "__text"))
        order = F.struct(F.col("__id").isNull(), "__id", "__key")
        gone = rows.select("__id", "__key").join(classes, "__key").groupBy("component_id").agg(F.min(order).alias("first"), F.count("*").alias("k")).where("k > 1")
        gone = classes.join(gone, "component_id").where(F.col("__key") != F.col("first.__key")).select(F.col("__key").alias("__gone"))
        return unpacked(rows.join(light(settle(gone)), F.col("__key") == F.col("__gone"), "left_anti"), names)
    classes = settle(jaccard_classes(docs, id_col, text_col))
    gone = classes.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone"))
    return unpacked(packed(docs, id_col).join(light(gone), F.col("__id").cast("long") == F.col("__gone"), "left_anti"), names)


def op6_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir))


QUERIES = {"op6_jaccard_groups": op6_jaccard_groups}
SQL: dict[str, str] = {}
