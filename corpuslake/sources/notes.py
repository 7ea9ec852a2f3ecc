"""Note scans: a tree of Markdown files as the notes relation.

Spark's scan leaves out names that start with ``_`` or ``.`` and empty files;
those are listed through the store's own file system and read by the same kind of task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.config import EngineConfig
from corpuslake.functions import paths as P
from corpuslake.functions import text as X
from corpuslake.functions.links import ATTACHMENT_SUFFIXES

NOTE_SCHEMA = "path string, content string, size_bytes long, mtime timestamp"


def _hidden(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> list[tuple[str, str, int, float]]:
    """Files below root that Spark's scan skips, hidden or empty ones: (path, uri, size, seconds)."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(conf)
    top = fs.makeQualified(top)
    found, entries = [], fs.listFiles(top, True)
    base = top.toUri().getPath().rstrip("/") + "/"
    while entries.hasNext():
        e = entries.next()
        path = e.getPath().toUri().getPath().removeprefix(base)
        if path.lower().endswith(suffixes) and (not e.getLen() or any(s[0] in "_." for s in path.split("/") if s)):
            found.append((path, e.getPath().toString(), e.getLen(), e.getModificationTime() / 1000))
    return found


def _read_text(batches):
    import pyarrow.fs as pafs

    for pdf in batches:
        out = []
        for uri in pdf["uri"]:
            fs, path = (pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else pafs.FileSystem.from_uri(uri)
            with fs.open_input_stream(path) as f:
                out.append(f.read().decode("utf-8", "replace"))
        yield pdf.assign(content=out)[["path", "content", "size_bytes", "mtime"]]


def files(spark: SparkSession, root: str, suffix: str = ".md", hidden: bool = True) -> DataFrame:
    """Every file of a suffix below root: path, content, size_bytes, mtime. A missing root is an error."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
    seen = reader.text(root, wholetext=True).select(
        P.relative(F.col("_metadata.file_path"), _plain(spark, root)).alias("path"), F.col("value").alias("content"),
        F.col("_metadata.file_size").alias("size_bytes"), F.col("_metadata.file_modification_time").alias("mtime"),
    )
    more = _hidden(spark, root, (suffix,)) if hidden else []
    if not more:
        return seen
    rows = spark.createDataFrame(more, "path string, uri string, size_bytes long, seconds double").withColumn("mtime", F.timestamp_seconds("seconds"))
    return seen.unionByName(rows.mapInPandas(_read_text, NOTE_SCHEMA))


def _plain(spark: SparkSession, root: str) -> str:
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(top).toUri().getPath()


def scan_notes(spark: SparkSession, root: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """All notes that the exclude rules leave."""
    found = files(spark, root)
    keep = ~P.excluded(F.col("path"), config.exclude_dirs, config.exclude_top_files) & ~F.col("path").startswith(config.memory_prefix) & ~F.col("path").startswith(config.extracts_prefix)
    return found.where(keep)


def scan_memory(spark: SparkSession, root: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The memory tree without its archive."""
    return files(spark, root).where(F.col("path").startswith(config.memory_prefix) & ~F.col("path").contains("/.archive/"))


def scan_extracts(spark: SparkSession, root: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Extracted sidecars, names with a leading underscore left out."""
    return files(spark, root).where(F.col("path").startswith(config.extracts_prefix) & ~P.file_name(F.col("path")).startswith("_"))


def scan_indexable(spark: SparkSession, root: str, scope: str = "all", config: EngineConfig = EngineConfig()) -> DataFrame:
    """Notes with extracts, memory, or both; a path counts once."""
    if scope not in ("notes", "memory", "all"):
        raise ValueError(f"unknown scope {scope!r}")
    parts = []
    if scope in ("notes", "all"):
        parts += [scan_notes(spark, root, config), scan_extracts(spark, root, config)]
    if scope in ("memory", "all"):
        parts.append(scan_memory(spark, root, config))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["path"])


def scan_docs(spark: SparkSession, root: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Markdown files below ``docs/``, whatever the exclude rules say: targets of links, though no notes."""
    return files(spark, root).where(F.col("path").startswith("docs/"))


def link_targets(notes: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(path, basename, aliases) of all that a link can name: described notes, and docs (path, content); a path counts once, as a note."""
    named = notes.select("path", "basename", "aliases")
    if docs is None:
        return named
    more = docs.select("path", P.stem(F.col("path")).alias("basename"), X.aliases(F.coalesce("content", F.lit(""))).alias("aliases"))
    return named.unionByName(more.join(notes.select("path"), "path", "left_anti"))


def inbox(notes: DataFrame) -> DataFrame:
    """Notes at the root."""
    return notes.where(~F.col("path").contains("/"))


def describe(notes: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """notes with basename, category, archived, size_lines, aliases and content_hash."""
    path, content = F.col("path"), F.coalesce("content", F.lit(""))
    return notes.withColumns(
        {
            "basename": P.stem(path),
            "category": P.category(path, config.inbox),
            "archived": P.archived(path, config.archive_markers),
            "size_lines": F.size(X.lines(content)),
            "aliases": X.aliases(content),
            "content_hash": X.content_hash(content),
        }
    )


def chunk_table(notes: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(path, chunk_index, chunk_text); an empty note has one empty chunk."""
    return notes.select("path", F.posexplode(X.chunks(F.col("content"), config.chunk_chars, config.chunk_overlap)).alias("chunk_index", "chunk_text"))


def attachments(spark: SparkSession, root: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(key, path): attachment files by lower-cased name and stem, keys that only one path has."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select(P.relative(F.col("path"), _plain(spark, root)).alias("path"))
    )
    return attachment_keys(found.where(P.suffix(F.col("path")).isin(*ATTACHMENT_SUFFIXES) & ~P.excluded(F.col("path"), config.exclude_dirs, config.exclude_top_files)))


def attachment_keys(found: DataFrame) -> DataFrame:
    keyed = found.select("path", F.explode(F.array_distinct(F.array(F.lower(P.file_name(F.col("path"))), F.lower(P.stem(F.col("path")))))).alias("key"))
    return keyed.groupBy("key").agg(F.min("path").alias("path"), F.max("path").alias("last")).where("path = last").select("key", "path")
