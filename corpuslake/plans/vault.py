"""A second virtual corpus, with every kind of link: aliases, ambiguous names, inline links, docs, attachments and all that can be wrong with one.

Notes are the documents in nested directories. Every 21st is called ``readme``, every
23rd lies in an archive, every 9th has aliases; links are appended by rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.config import EngineConfig
from corpuslake.operators import graph
from corpuslake.plans.catalogue import kept, query, table
from corpuslake.session import cut_lineage
from corpuslake.sources import notes as N

CONFIG = EngineConfig()


def _group(i: Column) -> Column:
    return F.floor(i / 20) % 5


def _link(when: Column, *parts) -> Column:
    """A link behind a blank, where a rule holds."""
    return F.when(when, F.concat(F.lit(" "), *(p if isinstance(p, Column) else F.lit(p) for p in parts))).otherwise("")


def vault(spark: SparkSession, sf: str) -> DataFrame:
    """Described notes."""
    d = table(spark, sf, "documents")
    n, i = d.count(), F.col("doc_id")
    group = F.concat("source", F.lit("/g"), _group(i).cast("string"))
    path = (
        F.when(i % 21 == 3, F.concat(group, F.lit("/x"), i, F.lit("/readme.md")))
        .when(i % 23 == 4, F.concat("source", F.lit("/archive/d"), i, F.lit(".md")))
        .otherwise(F.concat(group, F.lit("/d"), i, F.lit(".md")))
    )
    front = F.when(i % 9 == 1, F.concat(F.lit("---\naliases: [al"), i, F.lit(", other"), i, F.lit("]\n---\n"))).otherwise("")
    tail = F.concat(
        F.lit("\n"),
        _link(i % 2 == 0, "[[d", (i * 7 + 3) % n, "]]"),
        _link(i % 3 == 0, "[[readme|start]]"),
        _link(i % 4 == 1, "[[al", (i * 5 + 1) % n, "#part]]"),
        _link(i % 5 == 2, "[see (it)](../g", _group(i + 20), "/d", (i + 20) % n, ".md#top)"),
        _link(i % 6 == 1, "[[docs/guide", i % 4, "]]"),
        _link(i % 7 == 2, "[[pic", i % 6, ".png]]"),
        _link(i % 8 == 3, "[gone](gone%20by/g", i, ".md)"),
        _link(i % 10 == 4, "[[link]]"),
        _link(i % 11 == 6, "[x]([y/z", i, ".md)"),
        F.lit("\n```\n[[fenced]] [f](a/fenced.md)\n```\n`[[coded]]`"),
    )
    return N.describe(d.select("doc_id", path.alias("path"), F.concat(front, F.coalesce("text", F.lit("")), tail).alias("content")), CONFIG)


def docs(spark: SparkSession) -> DataFrame:
    """docs/guide0.md to docs/guide2.md."""
    return spark.range(3).select(F.concat(F.lit("docs/guide"), "id", F.lit(".md")).alias("path"), F.lit("").alias("content"))


def attachments(spark: SparkSession) -> DataFrame:
    """pic0.png, pic2.png and pic4.png, the last one twice, so that its name is no key."""
    names = spark.createDataFrame([("a/pic0.png",), ("a/Pic2.PNG",), ("a/pic4.png",), ("b/pic4.png",)], "path string")
    return N.attachment_keys(names)


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Links of the vault with their targets, stored once."""

    def make() -> DataFrame:
        notes = vault(spark, sf)
        return cut_lineage(graph.resolve(graph.links(notes), N.link_targets(notes, docs(spark))))

    return kept(spark, sf, "vault links", make)


@query
def vault_links(spark, sf):
    return resolved(spark, sf).select("source", "syntax", "display", "raw", "target")


@query
def vault_ambiguous(spark, sf):
    """Links to the name that every 21st note bears."""
    return resolved(spark, sf).where("raw = 'readme'").select("source", "target")


@query
def vault_edges(spark, sf):
    return graph.link_edges(resolved(spark, sf)).select("src", "dst", "link_syntax", "count", "raw_target")


@query
def vault_degrees(spark, sf):
    n = graph.nodes(vault(spark, sf).select("path"), graph.link_edges(resolved(spark, sf)), CONFIG)
    return n.select("path", "category", "archived", "in_degree_wiki", "out_degree_wiki")


def _classes(spark, sf):
    return graph.classify_broken(graph.broken(resolved(spark, sf)), attachments(spark), CONFIG)


@query
def vault_broken(spark, sf):
    return _classes(spark, sf).select("source", "syntax", "raw", "category", "attachment", "reason")


@query
def vault_broken_categories(spark, sf):
    """All seven classes."""
    return _classes(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query
def vault_orphans(spark, sf):
    """Notes that no link names, and notes that no edge reaches."""
    notes = vault(spark, sf)
    named = graph.orphans_by_stem(notes.select("path", "basename"), resolved(spark, sf).select("raw")).select(F.lit("stem").alias("by"), "path")
    nodes = graph.nodes(notes.select("path"), graph.link_edges(resolved(spark, sf)), CONFIG)
    return named.unionByName(graph.orphans_by_graph(nodes).select(F.lit("graph").alias("by"), "path"))


@query
def vault_backlinks(spark, sf):
    """Links to the first readme of the least source, with the lines they stand in counted from the end of their note."""
    target = resolved(spark, sf).where("raw = 'readme'").agg(F.min("target")).first()[0] or ""
    found = graph.link_backlinks(resolved(spark, sf), target)
    return found.select("source", "link_type", "raw")


@query
def vault_path(spark, sf):
    """The shortest path between two notes, step by step, over links of both syntaxes."""
    ends = {r.doc_id: r.path for r in vault(spark, sf).where("doc_id in (1, 158)").select("doc_id", "path").collect()}
    edges = graph.link_edges(resolved(spark, sf)).withColumn("type", F.col("link_syntax")).withColumn("edge_ord", F.concat_ws("|", "src", "dst", "type"))
    found = graph.shortest_path(edges, ends[1], ends[158])
    return spark.createDataFrame([(i, x["path"], x["edge_type"]) for i, x in enumerate(found)], "step int, path string, edge_type string")
