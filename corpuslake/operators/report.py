"""Manifests, topics, maps, health and profiles as relations; Markdown only at the end, from small ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.config import EngineConfig
from corpuslake.functions import paths as P
from corpuslake.functions import text as X


def entries(notes: DataFrame, summaries: DataFrame | None = None, tags: DataFrame | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(path, title, date, category, summary, tags) of notes."""
    p, t = F.col("path"), F.coalesce("content", F.lit(""))
    rows = notes.select("path", F.coalesce(X.heading(t), P.stem(p)).alias("title"), P.leading_date(P.file_name(p)).alias("date"), P.category(p, config.inbox).alias("category"))
    rows = rows.join(summaries.select("path", "summary"), "path", "left") if summaries is not None else rows.withColumn("summary", F.lit(None).cast("string"))
    return rows.join(tags.select("path", "tags"), "path", "left") if tags is not None else rows.withColumn("tags", F.array().cast("array<string>"))


def category_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def sparse_categories(counts: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    return counts.where(F.col("n") < config.sparse_category)


def inbox_listing(rows: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    return rows.where(F.col("category") == config.inbox).orderBy(F.desc("date"), "path")


def category_listing(rows: DataFrame, category: str, most: int = 100) -> DataFrame:
    """A category's notes, newest first, with the beginning of their summaries."""
    return rows.where(F.col("category") == category).select("path", "title", "date", F.substring("summary", 1, most).alias("summary")).orderBy(F.desc("date"), F.desc(P.file_name(F.col("path"))))


def topics(rows: DataFrame) -> DataFrame:
    """(tag, n, path, date): the inverted tag index, one row for each note of a tag; a tag of any size stays distributed."""
    one = rows.select("path", "date", F.explode(F.array_distinct("tags")).alias("tag"))
    n = one.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return one.join(n, "tag").select("tag", "n", "path", "date")


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans by archived flag and category."""
    return orphans.groupBy("archived", "category").agg(F.count(F.lit(1)).alias("n"))


def health(notes: DataFrame, orphans: DataFrame, config: EngineConfig = EngineConfig(), inbox_alert: int = 5, orphan_alert: int = 20) -> DataFrame:
    """One row of counts and alerts. notes: path, category, archived; orphans: path, archived."""
    n = notes.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("category") == config.inbox).alias("inbox"), F.countDistinct("category").alias("categories"))
    o = orphans.agg(F.count(F.lit(1)).alias("orphans"), F.count_if(~F.col("archived")).alias("active_orphans"), F.count_if("archived").alias("archived_orphans"))
    return n.join(F.broadcast(o), on=F.lit(True)).withColumn("inbox_alert", F.col("inbox") > inbox_alert).withColumn("orphan_alert", F.col("active_orphans") > orphan_alert)


def confidence_mix(edges: DataFrame) -> DataFrame:
    """Edges by confidence, with their share in percent."""
    n = edges.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.bround(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def profile(files: DataFrame, orphans: int, config: EngineConfig = EngineConfig()) -> DataFrame:
    """One row on a corpus from files (path, content): sizes, the tier of thresholds that fits, and hints."""
    ext = P.suffix(F.col("path"))
    c = files.agg(
        F.count_if(ext == ".md").alias("notes"), F.count_if(ext.isin(".docx", ".xlsx", ".pptx", ".pdf")).alias("office"),
        F.count_if(ext.isin(".doc", ".xls", ".ppt")).alias("legacy"), F.countDistinct(X.field(F.coalesce("content", F.lit("")), "host")).alias("hosts"),
    )
    tier = lambda a, b, d: F.when(F.col("notes") < 100, a).when(F.col("notes") <= 500, b).otherwise(d)
    ratio = F.when(F.col("notes") > 0, F.lit(orphans) / F.col("notes")).otherwise(0.0)
    hint = lambda test, name: F.when(test, F.lit(name))
    hints = F.array(hint(F.col("notes") + F.col("office") < 10, "tiny"), hint(F.col("office") > F.col("notes"), "office-heavy"), hint(F.col("legacy") > 0, "legacy-office"), hint(ratio > 0.3, "many-orphans"), hint(F.col("hosts") >= 2, "several-hosts"))
    return c.select("*", ratio.alias("orphan_ratio"), tier(5, 5, 10).alias("inbox_threshold"), tier(10, 20, 40).alias("orphan_threshold"), tier(2, 3, 3).alias("sparse_threshold"), F.array_compact(hints).alias("hints"))


def markdown(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """A report of small tables, at most ``most`` rows of each."""
    out = [f"# {title}"]
    for name, df in tables.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(most).collect()]
    return "\n".join(out) + "\n"


def synthesis_name(theme: str, taken: set[str]) -> str:
    """A draft's name; what is taken is never overwritten."""
    n, name = 1, theme
    while name in taken:
        n += 1
        name = f"{theme}-v{n}"
    return name
