"""Where tables go: versions of a keyed table beside each other, exports, vectors by stable id, and a rebuild that is only switched to if whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.text import stable_id
from tarn.plans.sync import upsert


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The version that the pointer names, null before the first."""
    try:
        name = spark.read.schema("version string").json(f"{folder}/current").first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return spark.read.parquet(f"{folder}/{name['version']}") if name else None


def publish(df: DataFrame, folder: str, version: str, least: int | None = None) -> bool:
    """Writes a version and switches the pointer to it; with `least` only if it has so many rows when read again. Readers see the old version or
    the new one, never a part."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{folder}/{version}")
    if least is not None and spark.read.parquet(f"{folder}/{version}").count() < least:
        return False
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{folder}/current")
    return True


def digest(df: DataFrame, *columns: str) -> DataFrame:
    """One row (rows, sum, mix) that tells whether two tables hold the same rows, in whatever order and however often each: the number of rows, and sums of two hashes
    of a row modulo 2^64. Equal tables agree; unlike ones agree with a chance of about 2^-64."""
    cells = [F.col(c) for c in (columns or df.columns)]
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("rows"), F.coalesce(part(1), F.lit(0)).alias("sum"), F.coalesce(part(2), F.lit(0)).alias("mix"))


def gates(source: DataFrame, versions: dict[str, DataFrame]) -> DataFrame:
    """(version, expected, actual, ok): of each version whether it equals its source in count and digest, as one table; a row a version."""
    want = digest(source).select(F.col("rows").alias("expected"), F.struct("rows", "sum", "mix").alias("__want"))
    out = None
    for name, df in versions.items():
        one = digest(df, *source.columns).select(F.lit(name).alias("version"), "rows", F.struct("rows", "sum", "mix").alias("__got"))
        out = one if out is None else out.unionByName(one)
    both = out.withColumn("g", F.lit(1)).join(want.withColumn("g", F.lit(1)), "g")
    return both.select("version", "expected", F.col("rows").alias("actual"), (F.col("__want") == F.col("__got")).alias("ok"))


def rebuild(source: DataFrame, folder: str, version: str) -> dict:
    """Writes a version beside the one in use, reads it again, and switches to it only if it has as many rows as the source and the same rows. Returns what was expected and found,
    with `ok`; a version that isn't whole stays unused, and the pointer where it was. source: as it should be found, read once more for the comparison."""
    spark = source.sparkSession
    source.write.mode("overwrite").parquet(f"{folder}/{version}")
    built = spark.read.schema(source.schema).parquet(f"{folder}/{version}")
    return switched(source, built, folder, version)


def switched(source: DataFrame, built: DataFrame, folder: str, version: str) -> dict:
    """Switches the pointer of a folder to a version if what was built equals its source in count and digest."""
    want, got = digest(source).first(), digest(built, *source.columns).first()
    ok = want == got
    if ok:
        source.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{folder}/current")
    return {"ok": ok, "expected": want["rows"], "actual": got["rows"], "same_rows": tuple(want)[1:] == tuple(got)[1:]}


def upsert_into(batch: DataFrame, folder: str, version: str, keys: list[str], insert_only: list[str] = (), order: Column | None = None) -> DataFrame:
    """The next version of a keyed table: the one before with the batch merged in, written beside it and switched to."""
    spark = batch.sparkSession
    old = current(spark, folder)
    old = old if old is not None else batch.limit(0)
    publish(upsert(old, batch, keys, insert_only, order), folder, version)
    return current(spark, folder)


def vectors(df: DataFrame, key: str, vector: str, *payload: str) -> DataFrame:
    """(point, vector, payload...): records for a vector store, with an id that is the same in every run."""
    return df.select(stable_id(F.col(key).cast("string")).alias("point"), F.col(vector).alias("vector"), *payload)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, in a file for each partition."""
    df.write.mode("overwrite").json(path)


def sample_of(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows at random, the same for the same seed: those of least hash."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(n)
