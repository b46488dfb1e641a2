"""Incremental maintenance of versioned tables: upserts, plans of changes, history and roll-back, convergence and alerts.

Plain Parquet has no MERGE: a new version is a full outer join of the old one with the batch, written beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.text import squash_key
from tarn.operators.windows import keep_best


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], insert_only: list[str] = (), order: Column | None = None) -> DataFrame:
    """The next version: the batch's first row of each key in the order wins but for the columns that are set on insertion only; without an
    order, the row that sorts last by all its columns."""
    last = keep_best(batch, keys, order) if order is not None else batch.groupBy(*keys).agg(F.max(F.struct(*[c for c in batch.columns if c not in keys])).alias("__r")).select(*keys, "__r.*")
    t, b = target.alias("t"), last.withColumn("__new", F.lit(True)).alias("b")
    joined = t.withColumn("__old", F.lit(True)).alias("t").join(b, [F.col(f"t.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")
    pick = lambda c: F.coalesce(f"t.{c}", f"b.{c}") if c in insert_only or c in keys else F.when(F.col("b.__new"), F.col(f"b.{c}")).otherwise(F.col(f"t.{c}"))
    return joined.select(*[pick(c).alias(c) for c in target.columns])


def keep_first(target: DataFrame, batch: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The target with the batch's values where it has none."""
    b = batch.groupBy(*keys).agg(*[F.min(c).alias(f"__{c}") for c in columns])
    return target.join(b, keys, "left").select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in target.columns])


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges whose properties are part of their key: other properties make another edge."""
    return old.unionByName(new).distinct()


def unpivot(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, path, value) with a row for every column, null values too."""
    return df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")).select(key, "p.path", "p.value")


def plan(before: DataFrame, after: DataFrame, key: str, columns: list[str], allowed: list[str]) -> DataFrame:
    """(key, path, before, after, state, verdict): fields that differ, `change` if the path may be written, else `rejected`; rows on one side
    only are `created` or `withdrawn`. Neither side is null-blind: from missing to a value is a change."""
    b, a = (df.select(key, F.struct(*columns).alias(name)) for df, name in ((before, "b"), (after, "a")))
    both = b.join(a, key, "full").withColumn("state", F.when(F.col("b").isNull(), "created").when(F.col("a").isNull(), "withdrawn").otherwise("known"))
    fields = F.array(*[F.struct(F.lit(c).alias("path"), F.col("b")[c].cast("string").alias("before"), F.col("a")[c].cast("string").alias("after")) for c in columns])
    out = both.select(key, "state", F.explode(fields).alias("f")).select(key, "f.*", "state").where(~F.col("before").eqNullSafe(F.col("after")))
    return out.withColumn("verdict", F.when(F.col("path").isin(*allowed), "change").otherwise("rejected"))


def summary(changes: DataFrame, key: str) -> DataFrame:
    """(key, changes, rejected, bytes, would_write): one row a record of a plan; bytes is how much longer its fields become."""
    one = F.col("verdict") == "change"
    grown = F.coalesce(F.octet_length("after"), F.lit(0)) - F.coalesce(F.octet_length("before"), F.lit(0))
    return changes.groupBy(key).agg(F.count_if(one).alias("changes"), F.count_if(~one).alias("rejected"), F.sum(F.when(one, grown).otherwise(0)).alias("bytes"), (F.count_if(one) > 0).alias("would_write"))


def broken_invariants(changes: DataFrame, key: str, columns: list[str], allowed: list[str]) -> DataFrame:
    """(rule, n): what no plan may hold; rules that hold have n = 0."""
    repeated = changes.groupBy(key, "path").agg(F.count("*").alias("n")).where("n > 1")
    checks = {
        "a change outside the list": changes.where((F.col("verdict") == "change") & ~F.col("path").isin(*allowed)),
        "a rejection inside the list": changes.where((F.col("verdict") == "rejected") & F.col("path").isin(*allowed)),
        "an unknown path": changes.where(~F.col("path").isin(*columns)),
        "a change that changes nothing": changes.where(F.col("before").eqNullSafe(F.col("after"))),
        "a path twice": repeated,
    }
    out = None
    for rule, rows in checks.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def normal(x: Column) -> Column:
    """A value as it is compared: without accents, case, marks and spaces; empty is missing."""
    return F.nullif(squash_key(x.cast("string")), F.lit(""))


def divergences(official: DataFrame, local: DataFrame, key: str, loose: list[str], exact: list[str]) -> DataFrame:
    """(key, field, official, local): fields that differ, the loose ones by their normal form, the exact ones by their value; a field that the
    official side lacks is no divergence."""
    o, m = (df.select(F.col(key), F.struct(*loose, *exact).alias(name)) for df, name in ((official, "o"), (local, "m")))
    differs = lambda c: ~F.col("o")[c].eqNullSafe(F.col("m")[c]) if c in exact else ~normal(F.col("o")[c]).eqNullSafe(normal(F.col("m")[c]))
    fields = F.array(*[F.when(F.col("o")[c].isNotNull() & differs(c), F.struct(F.lit(c).alias("field"), F.col("o")[c].cast("string").alias("official"), F.col("m")[c].cast("string").alias("local"))) for c in (*loose, *exact)])
    return o.join(m, key).select(key, F.explode(F.filter(fields, lambda f: f.isNotNull())).alias("f")).select(key, "f.*")


def last_state(events: DataFrame, keys: list[str], action: str, at: str, tie: str) -> DataFrame:
    """The keys whose last action sets them: toggles flip, so an odd number of them sets; a delete unsets whatever was before."""
    gone = F.max(F.when(F.col(action) == "delete", F.struct(at, tie))).over(Window.partitionBy(*keys))
    live = events.withColumn("__gone", gone).where(F.col("__gone").isNull() | (F.struct(at, tie) > F.col("__gone")))
    return live.groupBy(*keys).agg(F.count_if(F.col(action) == "toggle").alias("__n")).where("__n % 2 = 1").drop("__n")


def apply_plan(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The table with the plan's changes; a change to null is a change."""
    wide = changes.where("verdict = 'change'").groupBy(key).agg(*[F.max(F.when(F.col("path") == c, F.struct(F.col("after").alias("v")))).alias(f"__{c}") for c in columns])
    out = df.join(wide, key, "left")
    return out.select(*[F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}.v").cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def history(changes: DataFrame, key: str, at: Column) -> DataFrame:
    """(key, published_at, previous, changed): what the plan replaced, as a map of paths to former values."""
    own = changes.where("verdict = 'change'")
    entries = F.array_sort(F.collect_list(F.struct("path", "before")))
    return own.groupBy(key).agg(F.map_from_entries(entries).alias("previous"), F.array_sort(F.collect_list("path")).alias("changed")).withColumn("published_at", at)


def roll_back(df: DataFrame, versions: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The table as before the latest version of each key: paths that the version changed take their former values, null too."""
    last = keep_best(versions, [key], F.desc("published_at")).select(key, "previous")
    out = df.join(last, key, "left")
    return out.select(*[F.when(F.map_contains_key(F.coalesce("previous", F.create_map().cast("map<string,string>")), F.lit(c)), F.col("previous")[c].cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def convergence(source: DataFrame, stores: dict[str, DataFrame]) -> DataFrame:
    """(store, n, expected, gap): independent counts of each derived store against the source, in one row each."""
    out = source.agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("store"), "n")
    for name, df in stores.items():
        out = out.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n"))
    wide = out.agg(F.max(F.when(F.col("store").isNull(), F.col("n"))).alias("expected"), F.collect_list(F.when(F.col("store").isNotNull(), F.struct("store", "n"))).alias("s"))
    return wide.select("expected", F.inline("s")).select("store", "n", "expected", (F.col("expected") - F.col("n")).alias("gap"))


def alerts(measures: DataFrame, limits: dict[str, tuple[float, str]]) -> DataFrame:
    """(measure, value, limit, level): the measures (measure, value) beyond their limits."""
    rows = F.create_map(*[x for k, (limit, level) in limits.items() for x in (F.lit(k), F.struct(F.lit(float(limit)).alias("limit"), F.lit(level).alias("level")))])
    return measures.withColumn("r", rows[F.col("measure")]).where(F.col("value") > F.col("r.limit")).select("measure", "value", "r.limit", "r.level")


def probe_state(known: Column, found: Column, status: Column) -> Column:
    """What a probe of a source page says: error, withdrawn, broken, unchanged or changed."""
    return F.when(status >= 500, "error").when(status == 404, "withdrawn").when(found.isNull(), "broken").when(known.eqNullSafe(found), "unchanged").otherwise("changed")


def sorted_fields(x: Column, kind: T.DataType) -> Column:
    """A struct with its fields in the order of their names, within its structs too, so that its JSON is a key of its content."""
    if not isinstance(kind, T.StructType):
        return x
    return F.struct(*[sorted_fields(x[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])


def linked(originals: DataFrame, stored: DataFrame) -> DataFrame:
    """(url, original_id, title, state): stored translations (original_id, url, title) of originals (id, url, title), found by id, else by address; 'created' from the original where there is
    none, 'unlinked' where the original is gone. One translation an original: that found by id before that found by address."""
    ids = originals.select("id", F.col("url").alias("__url"), F.col("title").alias("__title"))
    by_id = ids.join(stored.where("original_id IS NOT NULL").groupBy(F.col("original_id").alias("id")).agg(F.min("title").alias("__a")), "id", "left")
    both = by_id.join(stored.where("original_id IS NULL").groupBy(F.col("url").alias("__url")).agg(F.min("title").alias("__b")), "__url", "left")
    found = F.coalesce("__a", "__b")
    out = both.select(F.col("__url").alias("url"), F.col("id").alias("original_id"), F.coalesce(found, "__title").alias("title"), F.when(found.isNull(), "created").otherwise("fetched").alias("state"))
    gone = stored.join(ids.select(F.col("id").alias("original_id")), "original_id", "left_anti").join(ids.select(F.col("__url").alias("url")), "url", "left_anti")
    return out.unionByName(gone.select("url", F.lit(None).cast("long").alias("original_id"), "title", F.lit("unlinked").alias("state")))


def probed(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, state) of two probes (key, hash, whole): withdrawn if only the earlier has it, broken if the later isn't whole, created if only the later has it, else unchanged or changed
    by the hash of the content."""
    a, b = before.select(F.col(key).alias("__ka"), F.col("hash").alias("__ha")), now.select(F.col(key).alias("__kb"), F.col("hash").alias("__hb"), F.col("whole").alias("__whole"))
    state = F.when(F.col("__kb").isNull(), "withdrawn").when(~F.col("__whole"), "broken").when(F.col("__ka").isNull(), "created").when(F.col("__ha") == F.col("__hb"), "unchanged").otherwise("changed")
    return a.join(b, F.col("__ka") == F.col("__kb"), "full").select(F.coalesce("__ka", "__kb").alias(key), state.alias("state"))


def rated(counts: DataFrame, n: str) -> DataFrame:
    """Adds `rate`, the share of a count in percent; 0 where the sum is. counts: few rows, a kind each."""
    total = F.sum(n).over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("rate", F.round(F.when(total > 0, 100.0 * F.col(n) / total).otherwise(0.0), 6))
