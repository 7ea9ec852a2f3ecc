"""Shared working folders.

Operators that cut lineage or keep files between stages write them below the
folder named by ``spark.checkpoint.dir``: every executor and the driver see it.
A folder of our own is set only where that setting is missing (tests).
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from corpuslake.session import write_parquet


def shared_dir(spark: SparkSession) -> str:
    """The URI of the shared folder that the session names."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        set_before = spark.sparkContext.getCheckpointDir()
        if set_before:
            return set_before
        where = "file://" + tempfile.mkdtemp(prefix="corpuslake-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def _remove(spark: SparkSession, uri: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has gone: whoever owns the shared folder cleans it
        pass


#: Folders made in this process, in order.
MADE: list[str] = []


def release(spark: SparkSession, uris: list[str], docs: DataFrame) -> None:
    """Remove those folders from disk and list that ``docs`` does not read."""
    read = docs.inputFiles() if uris else []
    for uri in list(uris):
        name = uri.rpartition("/")[2]
        if not any(f"/{name}/" in x for x in read):
            _remove(spark, uri)
            uris.remove(uri)


def new_workspace(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the driver ends."""
    uri = f"{shared_dir(spark).rstrip('/')}/corpuslake/{name}-{uuid.uuid4().hex}"
    MADE.append(uri)
    atexit.register(_remove, spark, uri)
    return uri


def materialise(df: DataFrame, uri: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage is cut, lost executors cost nothing."""
    write_parquet(df, uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def partitions_for(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """Partitions of about ``bytes_each`` input bytes, never fewer than the session's shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-min(size, 1 << 60) // bytes_each), 200_000) if size < 1 << 50 else least)


def filesystem(uri: str):
    """A pyarrow filesystem and the path in it, for use inside tasks."""
    import pyarrow.fs as pafs

    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def publish(uri: str, write) -> None:
    """``write(sink)`` into a file that appears whole or not at all; a retried task replaces it."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with fs.open_output_stream(draft) as sink:
        write(sink)
    fs.move(draft, path)
