"""The query API over a store of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.config import EngineConfig
from corpuslake.functions import paths as P
from corpuslake.functions import text as X
from corpuslake.operators import bm25, dense, graph, ranking
from corpuslake.operators.models import Embedder
from corpuslake.sources.tables import Store


class KnowledgeEngine:
    """Search, graph and lint queries; every method returns a lazy relation."""

    def __init__(self, spark: SparkSession, store: Store, config: EngineConfig = EngineConfig(), embedder: Embedder | None = None):
        self.spark, self.store, self.config, self.embedder = spark, store, config, embedder

    # -------------------------------------------------------- search

    def bm25(self, query: str, k: int = 10, scope: str = "all", dedupe: bool = False) -> DataFrame:
        keep = None if scope == "all" else P.in_scope(F.col("path"), scope, self.config.memory_prefix)
        return bm25.search(bm25.Index.load(self.store, self.config), query, k, keep, dedupe)

    def dense(self, query: str, k: int = 5, scope: str = "notes") -> DataFrame:
        if self.embedder is None:
            raise ValueError("dense search needs an embedder")
        vectors = self.store.read("embeddings").where(P.in_scope(F.col("path"), scope, self.config.memory_prefix))
        scores = dense.search(vectors, list(self.embedder.embed([query])[0]), None)
        return ranking.decayed(scores, self._ages(), self.config.decay, k)

    def hybrid(self, query: str, k: int = 5, scope: str = "notes", weights: tuple[float, float] | None = None) -> DataFrame:
        sparse = self.bm25(query, 2 * k, scope).select("path", "score")
        return ranking.fuse(self.dense(query, 2 * k, scope), sparse, weights or self.config.weights, k)

    def search(self, query: str, mode: str = "auto", k: int = 5, scope: str = "notes") -> DataFrame:
        """mode: auto (dense with escalation if there are vectors, else bm25), bm25, dense, hybrid. k is held to 1..50."""
        k = min(50, max(1, k))
        lite = self.embedder is None or not self.store.exists("embeddings")
        if mode == "bm25" or (mode == "auto" and lite):
            return self.bm25(query, k, scope)
        if mode == "dense":
            return self.dense(query, k, scope)
        if mode == "hybrid":
            return self.hybrid(query, k, scope)
        if mode != "auto":
            raise ValueError(f"unknown mode {mode!r}")
        found = self.dense(query, k, scope)
        missed = ranking.tag_miss(found, self._tags(), query, self.config.extracts_prefix).first().tag_miss
        ages = self._ages()

        def age(path: str) -> float | None:
            row = ages.where(F.col("path") == path).first()
            return row.age_years if row else None

        return ranking.escalate(found, query, k, age=age, tag_missed=missed, hybrid=lambda n, w: self.hybrid(query, n, scope, w), config=self.config)[0]

    def check_duplicate(self, query: str, scope: str = "notes") -> DataFrame:
        """The ten nearest, without escalation."""
        return self.search(query, "bm25" if self.embedder is None else "dense", 10, scope)

    def _ages(self) -> DataFrame:
        return self.store.read("notes").select("path", ranking.age_years(self.config.as_of, F.col("mtime")).alias("age_years"))

    def _tags(self) -> DataFrame:
        return self.store.read("notes").select("path", X.frontmatter_tags(F.coalesce("content", F.lit(""))).alias("tags"))

    # -------------------------------------------------------- graph

    def neighbors(self, path: str, max_hops: int = 2) -> DataFrame:
        return graph.neighbors(self.store.read("edges"), path, max_hops, least=self.config.semantic_edge)

    def path(self, source: str, target: str) -> list[dict[str, str]]:
        return graph.shortest_path(self.store.read("edges"), source, target)

    def backlinks(self, target: str) -> DataFrame:
        return graph.find_backlinks(self.store.read("edges"), self.store.read("links"), target)

    def orphans(self) -> DataFrame:
        return graph.orphans_by_stem(self.store.read("notes"), self.store.read("links"))
