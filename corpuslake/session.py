"""A session with the settings that the engine is tuned for; all are defaults that a cluster may override."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "corpuslake", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where it is unset a temporary folder of this machine serves a local session
    (tests, the benchmark); on a cluster it is an error, as executors would not see it.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="corpuslake-")
        spark.conf.set("spark.checkpoint.dir", where)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one; the folder goes when the driver ends."""
    where = f"{shared_dir(spark).rstrip('/')}/corpuslake/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, where)
    return where


def remove(spark: SparkSession, where: str) -> None:
    """A scratch folder goes."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has gone: whoever owns the shared folder cleans it
        pass


#: Spark's setting by which a query's shuffle files go when it ends, and not only when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_parquet(df: DataFrame, where: str) -> None:
    """``df`` written as Parquet; the shuffle files of that go with it, as its result is read from then on."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(where)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def cut_lineage(df: DataFrame, where: str | None = None) -> DataFrame:
    """``df`` written below the shared folder (to ``where``, a name from ``scratch``, for tables that are removed on the way) and read back, once; what is lost with an executor is read again, not made again."""
    where = where or scratch(df.sparkSession, "cut")
    write_parquet(df, where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
