"""Streams of notes: files as they appear, and the state of each note over event time.

State lives in Spark's state store by note; what leaves a micro-batch is merged into
the store by key, so only files that hold one of its notes are written again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuslake.functions import text as X
from corpuslake.operators.lifecycle import embedding_plan
from corpuslake.sources.tables import Store

SCHEMA = "path string, content string, content_hash string"
DAY = 86_400_000


def note_stream(spark: SparkSession, root: str, files_each: int | None = None) -> DataFrame:
    """(path, content, content_hash, ts) of notes as their files appear; ts is the file's time."""
    reader = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md")
    if files_each:
        reader = reader.option("maxFilesPerTrigger", files_each)
    rows = reader.format("text").load(root)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), X.content_hash(F.col("value")).alias("content_hash"), F.col("_metadata.file_modification_time").alias("ts"))


def newest(versions: DataFrame) -> DataFrame:
    """One row of each path: the latest by ts, ties by content hash; by arrival alone if there is no ts."""
    columns = [c for c in versions.columns if c != "path"]
    order = F.struct(*[c for c in ("ts", "content_hash") if c in columns])
    return versions.groupBy("path").agg(F.max_by(F.struct(*columns), order).alias("v")).select("path", "v.*")


def keep_current(stream: DataFrame, store: Store, checkpoint: str, on_change: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Merge each micro-batch into the store's ``notes``; ``on_change`` gets the paths that were added or changed.

    Of several versions of a note the newest by ts stays, whatever order they come in.
    """

    def apply(batch: DataFrame, _: int) -> None:
        latest = newest(batch)
        old = store.read("notes", SCHEMA + (", ts timestamp" if "ts" in batch.columns else ""))
        if "ts" in batch.columns:
            later = old.select("path", F.col("ts").alias("had"))
            latest = latest.join(later, "path", "left").where("had is null or ts >= had").drop("had")
        changed = embedding_plan(old.join(latest.select("path"), "path", "left_semi"), latest).where(F.col("action").isin("add", "change"))
        if on_change is not None:
            on_change(changed)
        store.merge("notes", latest, ["path"])

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ------------------------------------------------------------ state over event time


def batch_states(events: DataFrame, now: str, dormant_days: int = 180) -> DataFrame:
    """What ``states`` comes to when the watermark has reached ``now``: one row for each path, by plain aggregations."""
    span = F.expr(f"INTERVAL {dormant_days} DAYS")
    known = events.where("path is not null and ts is not null")
    last = known.groupBy("path").agg(F.max(F.struct("ts", F.coalesce("content_hash", F.lit("")).alias("content_hash"))).alias("last"))
    before = known.join(last.select("path", F.col("last.ts").alias("at")), "path").where("ts < at").groupBy("path").agg(F.max("ts").alias("before"))
    status = F.when(F.col("last.ts") + span < F.lit(now).cast("timestamp"), "dormant").otherwise("active")
    woken = F.coalesce(F.col("last.ts") > F.col("before") + span, F.lit(False))
    return last.join(before, "path", "left").select("path", "last.ts", "last.content_hash", status.alias("status"), woken.alias("woken"))


def states(events: DataFrame, disorder: str = "1 day", dormant_days: int = 180) -> DataFrame:
    """events (path, ts, content_hash), a stream -> path, ts, content_hash, status, woken whenever one of them changes.

    The newest version counts, by ts and then by hash. A note is dormant once the
    watermark is more than ``dormant_days`` past it, which a timer finds without new
    rows, and active again with a newer version; woken says that the newest version
    came more than that after the one before it. Rows may come in any order, but not
    more than ``disorder`` behind the latest: then the outcome is that of a batch.
    """
    span = dormant_days * DAY

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, digest, before, _ = state.get
            state.update((at, digest, before, "dormant"))
        else:
            at, digest, before, _ = state.get if state.exists else (None, "", None, "active")
            for frame in frames:
                for us, h in zip(frame["us"], frame["content_hash"].fillna("")):
                    if at is None or us > at:
                        at, digest, before = us, h, at
                    elif us == at:
                        digest = max(digest, h)
                    elif before is None or us > before:
                        before = us
            status = "active" if at // 1000 + span >= state.getCurrentWatermarkMs() else "dormant"
            state.update((int(at), digest, None if before is None else int(before), status))
            if status == "active":
                state.setTimeoutTimestamp(at // 1000 + span)
        at, digest, before, status = state.get
        woken = before is not None and at - before > span * 1000
        yield pd.DataFrame({"path": [key[0]], "us": [at], "content_hash": [digest], "status": [status], "woken": [woken]})

    rows = events.select("path", F.col("ts").cast("timestamp").alias("ts"), "content_hash").where("path is not null and ts is not null").withWatermark("ts", disorder)
    # times as numbers: a frame's timestamps would be local ones
    grouped = rows.withColumn("us", F.unix_micros("ts")).groupBy("path")
    found = grouped.applyInPandasWithState(step, "path string, us long, content_hash string, status string, woken boolean", "at long, hash string, before long, status string", "update", GroupStateTimeout.EventTimeTimeout)
    return found.select("path", F.timestamp_micros("us").alias("ts"), "content_hash", "status", "woken")


def keep_states(events: DataFrame, store: Store, checkpoint: str, disorder: str = "1 day", dormant_days: int = 180, table: str = "note_states") -> StreamingQuery:
    """Merge the states of a stream of events into a table of the store, by path."""

    def apply(batch: DataFrame, _: int) -> None:
        store.merge(table, batch, ["path"])

    return states(events, disorder, dormant_days).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
