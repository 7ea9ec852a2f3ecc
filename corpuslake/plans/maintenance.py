"""One maintenance run: every derived table from the notes, in dependency order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.config import EngineConfig
from corpuslake.operators import bm25, dense, graph, lifecycle, models, report
from corpuslake.sources import notes as N
from corpuslake.sources.tables import Store, upsert


class MaintenancePlan:
    """notes are written once and read by every later stage; related notes come after the vectors they need."""

    def __init__(self, store: Store, config: EngineConfig = EngineConfig(), embedder: models.Embedder | None = None):
        self.store, self.config, self.embedder = store, config, embedder

    def run(self, scanned: DataFrame, policy: DataFrame | None = None, attachment_keys: DataFrame | None = None, docs: DataFrame | None = None) -> dict[str, DataFrame]:
        store, config = self.store, self.config
        old = store.read("notes", "path string, content_hash string").select("path", "content_hash")
        changes = store.write("changes", lifecycle.rename_plan(old, N.describe(scanned, config)))
        notes = store.write("notes", N.describe(scanned, config))
        chunks = store.write("chunks", N.chunk_table(notes, config))
        bm25.build(chunks, config, store=store)
        gates = lifecycle.gate(notes.select("path", "size_bytes"), policy, config)
        related = None
        if self.embedder is not None:
            known = store.read("embeddings", "path string, chunk_index int, chunk_text string, embedding array<float>, content_hash string")
            plan = lifecycle.embedding_plan(known, notes, gates)
            todo = chunks.join(plan.where(F.col("action").isin("add", "change")).select("path"), "path", "left_semi")
            fresh = models.embed(todo, self.embedder).join(notes.select("path", "content_hash"), "path")
            gone = plan.where(F.col("action").isin("delete", "change"))
            vectors = store.write("embeddings", upsert(known.join(gone.select("path"), "path", "left_anti"), fresh, ["path", "chunk_index"]))
            related = store.write("related", dense.related(dense.mean_vectors(vectors), "path", config.related_top, config.related_least))
        links = store.write("links", graph.resolve(graph.links(notes), N.link_targets(notes, docs)))
        edges = graph.link_edges(links)
        if related is not None:
            edges = edges.unionByName(graph.semantic_edges(related, config))
        edges = store.write("edges", edges)
        nodes = graph.nodes(notes.drop("content"), edges, config)
        nodes = store.write("nodes", nodes.join(graph.communities(nodes, edges), "path"))
        keys = attachment_keys if attachment_keys is not None else store.spark.createDataFrame([], "key string, path string")
        broken = store.write("broken_links", graph.classify_broken(graph.broken(links), keys, config))
        health = store.write("health", report.health(notes, graph.orphans_by_graph(nodes), config))
        return {"changes": changes, "notes": notes, "chunks": chunks, "links": links, "edges": edges, "nodes": nodes, "broken_links": broken, "health": health}
