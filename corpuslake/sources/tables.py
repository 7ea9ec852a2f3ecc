"""The tables that results are kept in: Parquet files below one root, and logs of appended JSON or CSV.

A writer puts new files beside the old ones and then switches one pointer, so a
reader sees all tables of a commit or none of them, and a failure at any step
leaves the last commit as it was. Files are never changed; ``vacuum`` removes those
that no commit in use names. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER, COMMITS = "_current", "_commits"


class DuplicateKeys(ValueError):
    """Rows that a table keyed by some columns would hold twice."""


class Store:
    """Named tables below one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        """Where a log of that name is."""
        return f"{self.root}/{name}"

    # -------------------------------------------------------- the pointer

    def _hadoop(self, uri: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(uri)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _text(self, uri: str) -> str | None:
        fs, p = self._hadoop(uri)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, uri: str, text: str) -> None:
        """A small file that appears whole, in place of the one of that name."""
        jvm, draft = self.spark._jvm, f"{uri}.{uuid.uuid4().hex}"
        fs, p = self._hadoop(draft)
        out = fs.create(p, True)
        out.write(text.encode())
        out.close()
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), conf)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(fs.makeQualified(p), fs.makeQualified(self._hadoop(uri)[1]), options)

    def tables(self) -> dict[str, list[str]]:
        """Files and folders of every table of the current commit."""
        name = self._text(f"{self.root}/{POINTER}")
        return json.loads(self._text(f"{self.root}/{COMMITS}/{name}")) if name else {}

    def commit(self, changed: dict[str, list[str]]) -> None:
        """Switch to a state in which some tables have other files; the switch itself is one rename."""
        state, name = self.tables() | changed, f"{uuid.uuid4().hex}.json"
        self._put(f"{self.root}/{COMMITS}/{name}", json.dumps(state))
        self._put(f"{self.root}/{POINTER}", name)

    # -------------------------------------------------------- whole tables

    def exists(self, name: str) -> bool:
        return name in self.tables()

    def stage(self, name: str, df: DataFrame, cluster_by: Iterable[str] = ()) -> str:
        """The folder of new files of a table, which no reader sees before a commit."""
        place, keys = f"{self.root}/{name}/{uuid.uuid4().hex}", list(cluster_by)
        if keys:
            df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        df.write.parquet(place)
        return place

    def discard(self, place: str) -> None:
        """Remove a staged folder that no commit names."""
        fs, p = self._hadoop(place)
        fs.delete(p, True)

    def write(self, name: str, df: DataFrame, cluster_by: Iterable[str] | None = None, key: Iterable[str] = ()) -> DataFrame:
        """Replace a table as a whole; it may be made from its own former rows. With a key, rows that repeat it are an error."""
        place = self.stage(name, df, cluster_by or ())
        check_unique(self.spark.read.parquet(place), key)
        self.commit({name: [place]})
        return self.read(name)

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """A table; with a schema, a missing one is empty."""
        found = self.tables().get(name)
        if found is None and schema is not None:
            return self.spark.createDataFrame([], schema)
        if found is None:
            raise KeyError(f"no table {name!r} in {self.root}")
        return self.spark.read.parquet(*found)

    # -------------------------------------------------------- changes by key

    def merge(self, name: str, new: DataFrame, key: list[str], gone: DataFrame | None = None, cluster_by: Iterable[str] | None = None) -> DataFrame:
        """Rows of ``new`` in place of those of the same key, and without the keys of ``gone``.

        Only files that hold such a key are written again; the others stay as they
        are. A key is null if any of its columns is, and equals no other.
        """
        if not self.exists(name):
            return self.write(name, new if gone is None else new.join(gone.select(*key).distinct(), key, "left_anti"), cluster_by or key, key)
        files = self._files(name)
        fresh = self.stage(f"{name}.new", new)  # read more than once, and perhaps made from the table itself
        new = self.spark.read.parquet(fresh)
        check_unique(new, key)
        keys = new.select(*key) if gone is None else new.select(*key).unionByName(gone.select(*key))
        keys = keys.distinct()
        old = self.read(name)
        hit = old.select(*key, F.col("_metadata.file_path").alias("file")).join(keys, key, "left_semi").select("file").distinct()
        found = {unquote(urlsplit(r.file).path) for r in hit.collect()}  # names of files
        touched = [f for f in files if urlsplit(f).path in found]
        kept = [f for f in files if f not in touched]
        rest = new
        if touched:
            rest = self.spark.read.schema(old.schema).parquet(*touched).join(keys, key, "left_anti").unionByName(new, allowMissingColumns=True)
        elif set(old.columns) - set(new.columns):
            rest = old.limit(0).unionByName(new, allowMissingColumns=True)
        place = self.stage(name, rest, cluster_by or key)
        self.commit({name: [*kept, place]})
        return self.read(name)

    def _files(self, name: str) -> list[str]:
        """Data files of a table."""
        out = []
        for uri in self.tables()[name]:
            fs, p = self._hadoop(uri)
            for s in fs.listStatus(p):
                if not s.getPath().getName().startswith(("_", ".")):
                    out.append(s.getPath().toString())
        return out

    def vacuum(self) -> int:
        """Remove files and folders of tables that the current commit does not name, and former commits; how many went."""
        named = {self._hadoop(u)[1].toUri().getPath() for v in self.tables().values() for u in v}
        current, gone = self._text(f"{self.root}/{POINTER}"), 0
        fs, root = self._hadoop(self.root)
        known = set(self.tables()) | {f"{n}.new" for n in self.tables()}
        for name in known:
            top = self._hadoop(self.path(name))[1]
            for s in fs.listStatus(top) if fs.exists(top) else []:
                path = s.getPath().toUri().getPath()
                if path in named:
                    continue
                inside = [n for n in named if n.startswith(path + "/")]
                for f in fs.listStatus(s.getPath()) if inside else [s]:
                    if f.getPath().toUri().getPath() not in inside:
                        fs.delete(f.getPath(), True)
                        gone += 1
        for s in fs.listStatus(self._hadoop(f"{self.root}/{COMMITS}")[1]) if current else []:
            if s.getPath().getName() != current and not s.getPath().getName().endswith(".crc"):
                fs.delete(s.getPath(), True)
                gone += 1
        return gone

    # -------------------------------------------------------- logs

    def append_json(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").json(self.path(name))

    def append_csv(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").option("header", True).csv(self.path(name))

    def read_log(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).json(self.path(name))


def check_unique(df: DataFrame, key: Iterable[str]) -> None:
    """An error that names some keys, if rows share a key."""
    key = list(key)
    if not key:
        return
    twice = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise DuplicateKeys(f"{', '.join(key)}: " + "; ".join(str(tuple(r[k] for k in key)) for r in twice))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], gone: DataFrame | None = None) -> DataFrame:
    """Rows of ``old`` whose key ``new`` does not bring and ``gone`` does not name, and all of ``new``."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    if gone is not None:
        kept = kept.join(gone.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def rewrite_keys(table: DataFrame, renames: DataFrame) -> DataFrame:
    """A table keyed by path with renamed paths: renames (old, new)."""
    return table.join(renames.withColumnsRenamed({"old": "path", "new": "__new"}), "path", "left").withColumn("path", F.coalesce("__new", "path")).drop("__new")


def archive(store: Store, names: Iterable[str], orphans: DataFrame, date: str) -> dict[str, int]:
    """Move rows of orphaned paths out of tables into ``archive_<table>``, with the date; both sides of all tables change in one commit.

    orphans: path. Tables that are missing, or hold no such row, stay as they are.
    Returns how many rows moved. Moving the same paths again moves nothing.
    """
    lost, changed, moved = orphans.select("path").where("path is not null").distinct(), {}, {}
    for name in names:
        if not store.exists(name):
            continue
        table, target = store.read(name), f"archive_{name}"
        out = table.join(lost, "path", "left_semi").withColumn("archived_on", F.lit(date))
        place = store.stage(target, out)
        n = store.spark.read.parquet(place).count()
        if n:
            changed[target] = [*store.tables().get(target, []), place]
            changed[name] = [store.stage(name, table.join(lost, "path", "left_anti"))]
            moved[name] = n
    if changed:
        store.commit(changed)
    return moved


def save_results(store: Store, query: str, results: DataFrame, method: str, as_of: str) -> None:
    """Append a result set with its provenance."""
    results.select(F.lit(query).alias("query"), F.lit(method).alias("method"), F.lit(as_of).alias("saved_at"), "path", "score").write.mode("append").parquet(store.path("saved_results"))
