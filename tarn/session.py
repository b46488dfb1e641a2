"""The session that the library is used with; every setting can be overridden by the cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "tarn", **conf: str) -> SparkSession:
    """ANSI mode, UTC and adaptive execution; sizes of shuffles are left to adaptive coalescing."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.ansi.enabled": "true"} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def _until_exit(spark: SparkSession, folder: str) -> str:
    """The folder, made if it isn't there; it goes when the session's driver ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return folder


def shared(spark: SparkSession) -> str:
    """The folder of this session's checkpoints, which the driver and all executors share: in spark.checkpoint.dir, or where the session keeps its checkpoints. A session
    on one machine that has none gets a temporary one; on a cluster that is an error. It goes when the driver ends."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tarn-"))
    return _until_exit(spark, context._jsc.sc().getCheckpointDir().get())


def scratch(spark: SparkSession) -> str:
    """This session's folder for tables in between, in spark.checkpoint.dir or beside the checkpoints. It goes when the driver ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or shared(spark)
    return _until_exit(spark, f"{folder.rstrip('/')}/tarn-{spark.sparkContext.applicationId}")


def cut(df: DataFrame) -> DataFrame:
    """The same rows worked out once, their lineage ended by a checkpoint in the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def light(rows: DataFrame, width: int = 32, most_bytes: int = 32 << 20) -> DataFrame:
    """The side of a join, broadcast only where its bytes in memory, from a count of its rows, are few; width: bytes of a column."""
    return F.broadcast(rows) if rows.count() * (32 + width * len(rows.columns)) <= most_bytes else rows
