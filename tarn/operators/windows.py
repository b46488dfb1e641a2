"""Best of a key, quotas, versions, landmarks and limits of rate."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.session import cut


def keep_best(df: DataFrame, keys: list[str], *order: Column, k: int = 1) -> DataFrame:
    """The first k rows of each key in an order, which has to be total."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def latest(df: DataFrame, keys: list[str], at: str, k: int = 1, *ties: Column) -> DataFrame:
    return keep_best(df, keys, F.desc(at), *ties, k=k)


def landmark_ends(df: DataFrame, doc: str, start: str, end: Column | None = None) -> DataFrame:
    """Each landmark ends where the next of its document begins; the last one at `end`."""
    nxt = F.lead(start).over(Window.partitionBy(doc).orderBy(start))
    return df.withColumn("end", F.coalesce(nxt, end) if end is not None else nxt)


def running(df: DataFrame, order: list[Column], value: str) -> DataFrame:
    """Adds `rank`, from 1, and `so_far`, the sum of a value up to each row, in a total order of all rows. Ranges of the order are ranked each by
    itself and moved by the sums of the ranges before them: what the driver sees is one row a range, and no task sees all rows."""
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    w = Window.partitionBy("__part").orderBy(*order)
    own = parts.withColumns({"rank": F.row_number().over(w), "so_far": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    n, total, moves = 0, 0, []
    for r in sorted(parts.groupBy("__part").agg(F.count("*").alias("n"), F.sum(value).alias("s")).collect()):
        moves += [F.lit(r["__part"]), F.struct(F.lit(n).alias("n"), F.lit(total).alias("s"))]
        n, total = n + r["n"], total + r["s"]
    if not moves:
        return own.drop("__part")
    move = F.element_at(F.create_map(*moves), F.col("__part"))
    return own.withColumns({"rank": (F.col("rank") + move["n"]).cast("int"), "so_far": F.col("so_far") + move["s"]}).drop("__part")


def limited(df: DataFrame, key: str, at: str, most: int, seconds: int, tie: str | None = None) -> DataFrame:
    """Adds `allowed`: whether an event comes while fewer than `most` allowed ones of its key lie within so many seconds before.

    Rejected events don't count, so an event depends on the decisions before it: events of a key are decided in order of time, then of `tie`,
    as a stream of batches that are already sorted by key, with at most `most` times kept. A null key is a key; an event of null time is
    not limited and doesn't count."""
    parts = df.repartition(F.col(key)).sortWithinPartitions(key, at, *([tie] if tie else []))
    order = [df.columns.index(key), df.columns.index(at)]

    def run(batches: Iterator):
        import pyarrow as pa

        first, now, held = True, None, []
        for g in batches:
            allowed = []
            for k, t in zip(*(g.column(i).to_pylist() for i in order)):
                if first or k != now:
                    first, now, held = False, k, []
                held = [x for x in held if t is not None and (t - x).total_seconds() < seconds] if t is not None else held
                allowed.append(t is None or len(held) < most)
                if allowed[-1] and t is not None:
                    held.append(t)
            yield pa.RecordBatch.from_arrays([*g.columns, pa.array(allowed, pa.bool_())], names=[*g.schema.names, "allowed"])

    return parts.mapInArrow(run, T.StructType([*parts.schema.fields, T.StructField("allowed", T.BooleanType())]))


def quota(df: DataFrame, keys: list[str], classes: str, signature: str, order: list[str], k: int) -> DataFrame:
    """Greedy quota within each list (keys): a row stays if any of its classes has had fewer than k, in order; rows without a class always
    stay; of rows with one signature the first that is taken stays.

    A list is decided as a stream of rows that are already sorted, so a list of any length needs the counts of its classes and the signatures
    taken (at most k rows for each class), never its rows."""
    parts = df.repartition(*[F.col(c) for c in keys]).sortWithinPartitions(*keys, *order)
    at = [df.columns.index(c) for c in (*keys, classes, signature)]

    def run(batches: Iterator):
        import pyarrow as pa

        now: object = run
        had: dict[str, int] = {}
        seen: set = set()
        for g in batches:
            keep = []
            for *key, own, sign in zip(*(g.column(i).to_pylist() for i in at)):
                if key != now:
                    now, had, seen = key, {}, set()
                own = [c for c in own or [] if c]
                ok = not own or (not sign or sign not in seen) and any(had.get(c, 0) < k for c in own)
                if ok and own:
                    seen.add(sign)
                    for c in own:
                        had[c] = had.get(c, 0) + 1
                keep.append(ok)
            yield g.filter(pa.array(keep, pa.bool_()))

    return parts.mapInArrow(run, df.schema)


def lots(df: DataFrame, text: str, most: int) -> DataFrame:
    """Adds `lot`: texts packed by ascending length, then by the text, into lots of at most so many characters; a longer text is a lot of its own. Null counts as empty.

    Texts of one length fill lots evenly, so where a length begins follows from how many texts there are of each shorter one: what the driver sees is a
    count for each length up to `most`. Texts get their place by ranges, so the lots are the same however many partitions there are."""
    size = F.least(F.coalesce(F.length(text), F.lit(0)), F.lit(most + 1))
    rows = running(df.withColumn("__size", size), [F.col("__size").asc(), F.length(text).asc_nulls_first(), F.col(text).asc_nulls_first(), F.xxhash64(*[F.col(c) for c in df.columns]).asc()], "__size")
    counts = {r["__size"]: r["n"] for r in rows.groupBy("__size").agg(F.count("*").alias("n")).collect()}
    plan, before, lot, held = [], 0, 0, 0
    for n in sorted(counts):
        if n > most:  # each alone; the first takes the open lot if that is empty
            plan.append((n, before, 0, lot, lot + (held > 0), 1))
            break
        room = (most - held) // n if n else counts[n]
        each = most // n if n else 1
        fits = room if held else min(room, each) if n else room
        start = lot + (held > 0 or lot > 0 or fits > 0)
        plan.append((n, before, fits, lot, start, each))
        left = counts[n] - fits
        if left > 0:
            lot, held = start + (left - 1) // each, ((left - 1) % each + 1) * n
        else:
            held += counts[n] * n
        before += counts[n]
    if not plan:
        return df.withColumn("lot", F.lit(None).cast("long"))
    sizes = df.sparkSession.createDataFrame(plan, "__size int, __before long, __fits long, __open long, __next long, __each long")
    place = F.col("rank") - 1 - F.col("__before")
    lot_of = F.when(place < F.col("__fits"), F.col("__open")).otherwise(F.col("__next") + F.floor((place - F.col("__fits")) / F.col("__each")))
    return rows.join(F.broadcast(sizes), "__size").select(*df.columns, lot_of.cast("long").alias("lot"))
