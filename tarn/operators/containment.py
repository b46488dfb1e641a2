"""Names in texts and texts in names: joins on containment and on prefixes that are equality joins on keys, with a check of the rest."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.session import cut, light

#: Runs of letters and digits, and what stands between them; together they are the text.
PIECES = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"


def pieces(x: Column) -> Column:
    """A text as words and gaps in turn."""
    return F.regexp_extract_all(x, F.lit(PIECES), F.lit(0))


def runs(tokens: Column, lead: int) -> Column:
    """(at, gram) for each place and each number of tokens up to `lead` that fits there; at counts from 1. Each length is made from the one before, so the work
    follows the tokens."""
    grams, out = tokens, []
    for size in range(1, lead + 1):
        if size > 1:
            rest = F.slice(tokens, F.lit(size), F.greatest(F.size(tokens), F.lit(1)))
            grams = F.zip_with(grams, rest, lambda g, t: F.concat(g, F.lit("\x01"), t))
        out.append(F.filter(F.transform(grams, lambda g, i: F.struct((i + 1).alias("at"), g.alias("gram"))), lambda x: x["gram"].isNotNull()))
    return F.concat(*out)


#: The most bytes of names that are sent to every task; more are joined.
CARRIED = 32 << 20


def carried(names: DataFrame, tokens: str) -> list | None:
    """The rows of names, whose tokens are an array of that name, if they are few; else nothing."""
    size = names.agg(F.sum(F.octet_length(F.array_join(tokens, "")) + 16 * F.size(tokens) + 200)).first()[0] or 0
    return names.collect() if size <= CARRIED else None


def steps_of(names: list[list[str]]) -> tuple:
    """Names as a tree of tokens: the tokens, the sorted steps (node * number of tokens + token), the nodes that they lead to, and of each node the name that ends there, or -1."""
    tokens = {t: i for i, t in enumerate(dict.fromkeys(t for x in names for t in x))}
    steps, ends = {}, [-1]
    for k, x in enumerate(names):
        node = 0
        for t in x:
            step = node * len(tokens) + tokens[t]
            if step not in steps:
                steps[step] = len(ends)
                ends.append(-1)
            node = steps[step]
        ends[node] = k
    keys = np.array(sorted(steps), np.int64)
    return list(tokens), keys, np.array([steps[k] for k in keys.tolist()], np.int64), np.array(ends, np.int64)


def places(texts, tree: tuple) -> tuple[np.ndarray, ...]:
    """(row, at, name, n): where the names of a tree occur in an Arrow array of arrays of tokens; at counts from 0, n: tokens of the name. All places are taken a token further at a
    time, so only those where a name may go on are held against it."""
    import pyarrow as pa
    import pyarrow.compute as pc

    tokens, keys, to, ends = tree
    flat, stop = texts.flatten(), np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    ids = pc.fill_null(pc.index_in(flat, value_set=pa.array(tokens, flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.flatnonzero(ids >= 0)
    begun, row, node, out = at, np.searchsorted(stop, at, side="right"), np.zeros(len(at), np.int64), []
    while len(at):
        step = node * len(tokens) + ids[at]
        k = np.minimum(np.searchsorted(keys, step), len(keys) - 1)
        on = keys[k] == step
        begun, row, at, node = begun[on], row[on], at[on] + 1, to[k[on]]
        met = ends[node] >= 0
        out.append((row[met], begun[met], ends[node[met]], at[met] - begun[met]))
        on = at < stop[row]
        on[on] = ids[at[on]] >= 0
        begun, row, at, node = begun[on], row[on], at[on], node[on]
    row, begun, name, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 4
    return row, begun - np.concatenate([[0], stop])[row], name, n


def slices(batches: Iterator, rows: int = 500) -> Iterator:
    """Record batches in pieces of a bounded number of rows, so that what is worked out for a piece stays small."""
    for g in batches:
        for i in range(0, g.num_rows, rows):
            yield g.slice(i, rows)


def name_hits(texts: DataFrame, key: str, tokens: str, names: DataFrame, name: str, lead: int = 2) -> DataFrame:
    """(key, name, at, n): where names (text) occur in texts, both as arrays of tokens in columns of the name given; n: tokens of the name, at counts from 1.

    Names that are few go to every task, which reads its texts once; nothing else of the texts leaves a task. More names meet texts in a join (`name_joins`)."""
    few = carried(names.where(F.size(tokens) > 0).select(name, tokens).distinct(), tokens)
    if few is None:
        return name_joins(texts, key, tokens, names, name, lead)
    of: dict[tuple, list[str]] = {}
    for own, t in few:
        of.setdefault(tuple(t), []).append(own)
    tree, first = steps_of(list(of)), np.cumsum([0, *map(len, of.values())])
    listed = [x for own in of.values() for x in own]

    def run(batches: Iterator):
        import pyarrow as pa

        own = pa.array(listed, pa.string())
        for g in slices(batches):
            row, at, k, n = places(g.column(1), tree)
            times = (first[1:] - first[:-1])[k]
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            columns = [g.column(0).take(pa.array(np.repeat(row, times))), own.take(pa.array(np.repeat(first[k], times) + nth)), pa.array(np.repeat(at + 1, times).astype(np.int32)), pa.array(np.repeat(n, times).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, name, "at", "n"])

    return texts.select(key, tokens).mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, {name} string, at int, n int")


def name_joins(texts: DataFrame, key: str, tokens: str, names: DataFrame, name: str, lead: int = 2) -> DataFrame:
    """As `name_hits`, for any number of names: they meet texts in one join, on their first `lead` tokens or on all if they have fewer. Longer names are then held against the tokens
    that follow, text by text. `key` has to be unique; a null or empty array has no hits. The names are broadcast if they are few."""
    known = names.where(F.size(tokens) > 0).select(name, F.col(tokens).alias("__t"), F.array_join(F.slice(tokens, 1, lead), "\x01").alias("gram")).distinct()
    grams = texts.select(key, F.explode(runs(F.col(tokens), lead)).alias("g")).select(key, "g.*")
    met = grams.join(light(known, 200), "gram").select(key, name, "at", F.size("__t").alias("n"), "__t")
    whole = met.where(F.col("n") <= lead).drop("__t")
    open_ = met.where(F.col("n") > lead).groupBy(key).agg(F.collect_list(F.struct(name, "at", "n", F.col("__t").alias("t"))).alias("__c"))
    held = texts.select(key, F.col(tokens).alias("__all")).join(open_, key)
    same = lambda c: F.forall(F.sequence(F.lit(0), c["n"] - 1), lambda j: F.coalesce(F.get("__all", c["at"] - 1 + j) == F.get(c["t"], j), F.lit(False)))
    sound = held.select(key, F.explode(F.filter("__c", same)).alias("c"))
    return whole.unionByName(sound.select(key, f"c.{name}", "c.at", "c.n"))


def masked(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, mark: str) -> DataFrame:
    """(key, text, n): whole texts with the names that they hold replaced by the marks of the names, the longest name first, in any case, at the edges of words;
    n: names replaced. Of names of one length the first in order goes first, of one name the leftmost; what a mark covers is not masked
    again. names: (name, mark), one mark a name; texts without a name stay as they are, null too."""
    cutup = texts.select(key, F.col(text).alias("__text"), pieces(F.col(text)).alias("__own"))
    cutup = cutup.select(key, "__text", F.transform("__own", F.lower).alias("__p"), F.transform("__own", F.octet_length).alias("__bytes"))
    known = names.where(F.trim(name) != "").groupBy(name).agg(F.min(mark).alias("__mark")).select(F.transform(pieces(F.col(name)), F.lower).alias("__p"), "__mark").withColumn("__name", F.array_join("__p", ""))
    known = known.groupBy("__name", "__p").agg(F.min("__mark").alias("__mark"))
    schema = f"{key} {texts.schema[key].dataType.simpleString()}, text string, n long"

    def put(text: str | None, spans: Iterator[tuple[int, int, str]]) -> tuple[str | None, int]:
        """A text with the spans (from byte, to byte, mark), the first before others, replaced."""
        own, marks = (text or "").encode(), {}
        taken = bytearray(len(own))
        for a, b, m in spans:
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                marks[a] = (b, m)
        parts, at = [], 0
        for a in sorted(marks):
            parts += [own[at:a], marks[a][1].encode()]
            at = marks[a][0]
        return (b"".join([*parts, own[at:]]).decode(), len(marks)) if marks else (text, 0)

    def batch(keys, out: list[tuple[str | None, int]]):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([keys, pa.array([x for x, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], names=[key, "text", "n"])

    few = carried(known, "__p")
    if few is not None:
        few = sorted(few, key=lambda r: (-len(r["__name"]), r["__name"]))  # a name's number is its turn
        tree, marks = steps_of([r["__p"] for r in few]), [r["__mark"] for r in few]

        def run(batches: Iterator):
            import pyarrow.compute as pc

            for g in slices(batches):
                row, at, k, n = places(g.column(2), tree)
                begin = np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(g.column(2)), 0).to_numpy(zero_copy_only=False)]))
                byte = np.cumsum(np.concatenate([[0], g.column(3).flatten().to_numpy(zero_copy_only=False)]))
                order = np.lexsort((at, k, row))
                row, at, k, n = row[order], at[order], k[order], n[order]
                zero, first = byte[begin[row]], begin[row] + at
                spans = list(zip((byte[first] - zero).tolist(), (byte[first + n] - zero).tolist(), [marks[i] for i in k.tolist()]))
                bounds = np.searchsorted(row, np.arange(g.num_rows + 1)).tolist()
                yield batch(g.column(0), [put(text, spans[a:b]) if b > a else (text, 0) for text, a, b in zip(g.column(1).to_pylist(), bounds, bounds[1:])])

        return cutup.mapInArrow(run, schema)

    found = name_joins(cutup, key, "__p", known, "__name", 3).join(light(known.select("__name", "__mark"), 100), "__name")
    spans = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.length("__name")).alias("longest"), F.col("__name").alias("name"), "at", "n", F.col("__mark").alias("mark")))).alias("__spans"))

    def run_joined(batches: Iterator):
        for g in batches:
            out = []
            for text, sizes, spans in zip(g.column(1).to_pylist(), g.column(2).to_pylist(), g.column(3).to_pylist()):
                byte = [0, *accumulate(sizes or ())]
                out.append(put(text, ((byte[s["at"] - 1], byte[s["at"] - 1 + s["n"]], s["mark"]) for s in spans or ())))
            yield batch(g.column(0), out)

    return cutup.join(spans, key, "left").select(key, "__text", F.when(F.col("__spans").isNotNull(), F.col("__bytes")).alias("__bytes"), "__spans").mapInArrow(run_joined, schema)


def prefix_join(titles: DataFrame, title: str, lines: DataFrame, line: str, lead: int = 8) -> DataFrame:
    """Rows of titles with the rows of lines that begin with the title, in any case. Titles meet lines on their first `lead` characters, or on all if they
    have fewer, then the whole title is held against the line. Empty and null titles begin nothing. The titles are broadcast if they are few; lines, of which each stands
    under up to `lead` keys, never are, whatever their files let one expect."""
    begun = light(titles.where(F.length(title) > 0).withColumn("__key", F.left(F.lower(title), F.lit(lead))), 200)
    starts = F.transform(F.sequence(F.lit(1), F.least(F.length(line), F.lit(lead))), lambda n: F.left(F.lower(line), n))
    keyed = lines.where(F.length(line) > 0).withColumn("__key", F.explode(starts))
    return begun.join(keyed.hint("shuffle_merge"), "__key").where(F.startswith(F.lower(line), F.lower(title))).drop("__key")


def grams_of(x: Column, size: int) -> Column:
    """The distinct runs of `size` characters; a shorter text is its own."""
    last = F.length(x) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(x, i, F.lit(size))))).otherwise(F.array(x))


def contained(inner: DataFrame, a: str, outer: DataFrame, b: str, size: int = 3) -> DataFrame:
    """(a, b): texts of one side that lie anywhere within texts of the other. Each inner text is looked for by the rarest of its runs of `size` characters among
    all runs of the outer texts; shorter inner texts by all runs of their length. Pairs that share that run are held against each other."""
    small = inner.select(a).where(F.length(a) > 0).distinct()
    large = cut(outer.select(b).where(F.length(b) > 0).distinct())
    out = None
    for n in range(1, size + 1):
        own = small.where(F.length(a) == n) if n < size else small.where(F.length(a) >= n)
        posted = large.where(F.length(b) >= n).select(b, F.explode(grams_of(F.col(b), n)).alias("gram"))
        counts = posted.groupBy("gram").agg(F.count("*").alias("times"))
        rarest = own.select(a, F.explode(grams_of(F.col(a), n)).alias("gram")).join(counts, "gram", "left")
        anchor = rarest.groupBy(a).agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "gram")).alias("r")).where("r.times > 0").select(a, F.col("r.gram").alias("gram"))
        pairs = anchor.join(posted, "gram").where(F.contains(F.col(b), F.col(a))).select(a, b)
        out = pairs if out is None else out.unionByName(pairs)
    return out


def first_containing(names: DataFrame, a: str, titles: DataFrame, b: str, size: int = 3) -> DataFrame:
    """(a, b): of each name the first title in order that holds it or that it holds, in lower case and trimmed. A name equal to a title is that title's."""
    left, right = names.select(F.trim(F.lower(a)).alias("__a")), titles.select(F.trim(F.lower(b)).alias("__b"))
    both = contained(left, "__a", right, "__b", size).unionByName(contained(right, "__b", left, "__a", size).select("__a", "__b"))
    return both.groupBy("__a").agg(F.coalesce(F.min(F.when(F.col("__a") == F.col("__b"), F.col("__b"))), F.min("__b")).alias(b)).withColumnRenamed("__a", a)
