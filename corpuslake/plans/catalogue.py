"""The query catalogue: every operator over a virtual corpus made from the given tables.

Notes are the documents under ``source/`` (every 10th in an archive, every 20th
in the memory tree); links are appended by rule; semantic edges are pairs of
embeddings over a cosine threshold. ``catalogue_sql`` has the same queries as SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.config import EngineConfig
from corpuslake.functions import links as L
from corpuslake.functions import paths as P
from corpuslake.functions import text as X
from corpuslake.functions import vectors as V
from corpuslake.operators import bm25, dense, graph, lifecycle, lint, policy, ranking, report
from corpuslake.session import cut_lineage, scratch
from corpuslake.sources.notes import chunk_table
from corpuslake.sources.tables import Store
from corpuslake.streaming.notes_stream import keep_states

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, Query] = {}
AS_OF = "2024-01-31 00:00:00"
CONFIG = EngineConfig(as_of=AS_OF, semantic_edge=0.30, semantic_inferred=0.35, related_least=0.30, memory_prefix="memory/", large_bytes=3000)
QUERY = "the thanedble erbleed and onion of these nding"
QUERIES = (QUERY, "les mentaux de la tion", "der heit und verein")
TERMS = ("the", "of", "tion", "ing", "les", "die", "zzzz")
SEM = EngineConfig(as_of=AS_OF, semantic_edge=0.30, semantic_inferred=0.35)


def query(f: Query) -> Query:
    CATALOGUE[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def round6(c: str = "score") -> Column:
    return F.round(c, 6)


# ------------------------------------------------------------ the virtual corpus


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """path 'd<id>', content."""
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("content"))


def notes(spark: SparkSession, sf: str) -> DataFrame:
    where = F.when(F.col("doc_id") % 20 == 0, "memory/").when(F.col("doc_id") % 10 == 0, F.concat("source", F.lit("/archive/"))).otherwise(F.concat("source", F.lit("/")))
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", F.concat(where, F.lit("d"), "doc_id", F.lit(".md")).alias("path"), F.concat(F.lit("d"), "doc_id").alias("basename"),
        F.coalesce("text", F.lit("")).alias("content"), ((F.col("doc_id") * 37) % 1100).alias("age_days"), F.array().cast("array<string>").alias("aliases"),
    )


def linked(spark: SparkSession, sf: str) -> DataFrame:
    """notes whose content ends in two links by rule and, for every 13th, a dangling one."""
    n = table(spark, sf, "documents").count()
    i = F.col("doc_id")
    tail = F.concat(
        F.lit("\n[[d"), (i * 7 + 3) % n, F.lit("]] [[d"), (i * i + 1) % n, F.lit("|x]]"),
        F.when(i % 13 == 0, F.concat(F.lit(" [[missing"), i, F.lit("]]"))).otherwise(""),
    )
    return notes(spark, sf).withColumn("content", F.concat("content", tail))


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Links with their targets, stored once."""

    def make() -> DataFrame:
        n = linked(spark, sf)
        return cut_lineage(graph.resolve(graph.links(n), n.select("path", "basename", "aliases")))

    return kept(spark, sf, "links", make)


def link_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.link_edges(resolved(spark, sf))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("v"), "vec_id").alias("path"), "embedding", "label")


def similar(spark: SparkSession, sf: str) -> DataFrame:
    """(a, b, similarity) of the 8 nearest vectors of each that reach 0.30."""
    return dense.related(vectors(spark, sf), "vec_id", 8, 0.30)


def sem_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Stored, as a query reads them several times and all pairs stand behind them."""
    edges = graph.semantic_edges(similar(spark, sf).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), round6("similarity").alias("similarity")), SEM)
    return cut_lineage(edges)


def sem_nodes(spark: SparkSession, sf: str, edges: DataFrame) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.concat(F.lit("c"), "label").alias("category"), F.lit(False).alias("archived"), "label")
    return graph.nodes(v, edges, SEM)


_kept: dict[tuple[str, str, str], object] = {}


def kept(spark: SparkSession, sf: str, name: str, make):
    """What ``make()`` returns, made once in a session for the tables in ``sf``: stored tables that several queries read."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def index(spark: SparkSession, sf: str) -> bm25.Index:
    return kept(spark, sf, "index", lambda: bm25.build(chunk_table(docs(spark, sf), CONFIG), CONFIG))


def query_vector(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    return list(table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).first().embedding)


# ------------------------------------------------------------ text and retrieval


@query
def chunk_windows(spark, sf):
    c = X.chunks(F.col("content"))
    return docs(spark, sf).select("doc_id", F.size(c).alias("n_chunks"), F.length(c[0]).alias("first_len"), F.length(F.element_at(c, -1)).alias("last_len"))


@query
def token_stats(spark, sf):
    t = X.tokenize(F.col("content"))
    return docs(spark, sf).select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query
def bm25_corpus_stats(spark, sf):
    stats = bm25.corpus_stats(bm25.tokens_of(chunk_table(docs(spark, sf), CONFIG)))
    return stats.select("n", round6("avgdl").alias("avgdl"))


@query
def bm25_term_stats(spark, sf):
    return index(spark, sf).term_stats.where(F.col("term").isin(*TERMS)).select("term", "df", round6("idf").alias("idf"))


@query
def bm25_vocabulary(spark, sf):
    """Every term of the index."""
    return index(spark, sf).term_stats.select("term", "df", round6("idf").alias("idf"))


@query
def bm25_search(spark, sf):
    return bm25.search(index(spark, sf), QUERY, 10).select("path", "chunk_index", round6().alias("score"))


@query
def bm25_search_scoped(spark, sf):
    n = kept(spark, sf, "note index", lambda: bm25.build(chunk_table(notes(spark, sf), CONFIG), CONFIG))
    return bm25.search(n, QUERY, 10, P.in_scope(F.col("path"), "notes", CONFIG.memory_prefix), dedupe=True).select("path", round6().alias("score"))


@query
def bm25_search_many(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return bm25.search_many(index(spark, sf), q, 3).select("query_id", "rank", "path", "chunk_index", round6().alias("score"))


@query
def dense_topk(spark, sf):
    v = vectors(spark, sf).withColumn("path", F.concat(F.lit("label"), "label"))
    return dense.search(v, query_vector(spark, sf), 5).select("path", round6().alias("score"))


@query
def dense_decay(spark, sf):
    v = vectors(spark, sf)
    ages = v.select("path", ((F.col("vec_id") * 37) % 1100 / 365.25).alias("age_years"))
    return ranking.decayed(dense.search(v, query_vector(spark, sf), None), ages, CONFIG.decay, 10).select("path", round6().alias("score"))


@query
def mean_vectors(spark, sf):
    m = dense.mean_vectors(table(spark, sf, "embeddings"), "label")
    return m.select("label", F.posexplode("embedding").alias("pos", "x")).select("label", "pos", round6("x").alias("x"))


@query
def related_notes(spark, sf):
    return similar(spark, sf).select("a", "b", round6("similarity").alias("similarity"))


@query
def hybrid_fusion(spark, sf):
    v = vectors(spark, sf).withColumn("path", F.concat(F.lit("d"), "vec_id"))
    sides = (dense.search(v, query_vector(spark, sf), 20), bm25.search(index(spark, sf), QUERY, 20).select("path", "score"))
    return ranking.fuse(*sides, CONFIG.weights, 10).select("path", round6().alias("score"))


@query
def escalation_decision(spark, sf):
    """Triggers for five queries, each the sum of two vectors; the ages are made from ids."""
    v = vectors(spark, sf)
    q = v.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), V.doubles(F.col("embedding")).alias("x")).join(v.select((F.col("vec_id") - 100).alias("query_id"), V.doubles(F.col("embedding")).alias("y")), "query_id").select("query_id", F.zip_with("x", "y", lambda a, b: a + b).alias("q"))
    scored = v.join(F.broadcast(q), on=F.lit(True)).select("query_id", "vec_id", "path", F.round(V.cosine_search(F.col("q"), F.col("embedding")), 6).alias("score"))
    best = scored.groupBy("query_id").agg(F.max_by(F.struct("path", "vec_id", "score"), F.struct("score", (-F.col("vec_id")).alias("m"))).alias("b")).select("query_id", "b.*")
    age = (F.col("vec_id") * 37) % 1100 / 365.25
    lo, hi = CONFIG.gray_zone
    return best.select("query_id", "path", "score", (F.col("score") < CONFIG.escalation_below).alias("low_confidence"), (F.col("score").between(lo, hi) & (age > CONFIG.gray_zone_years)).alias("gray_zone"))


@query
def duplicate_check(spark, sf):
    text = table(spark, sf, "benchmark").where("item_id = 0").first().text
    return bm25.search(index(spark, sf), text, 10, dedupe=True).select("path", round6().alias("score"))


@query
def iterative_merge(spark, sf):
    i = index(spark, sf)
    rounds = ranking.iterate(QUERIES[0], lambda q: bm25.search(i, q, 5, dedupe=True), lambda q, n, found: list(QUERIES[1:]), 2, 5)
    out = None
    for n, rows, _ in rounds:
        part = rows.select(F.lit(n).alias("round"), "path", round6().alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------ paths, hashes, maintenance


@query
def path_features(spark, sf):
    p = F.col("path")
    return notes(spark, sf).select("path", P.category(p, CONFIG.inbox).alias("category"), P.archived(p, CONFIG.archive_markers).alias("archived"), P.stem(p).alias("stem"), P.leading_date(P.file_name(p)).alias("date"), P.in_scope(p, "memory", CONFIG.memory_prefix).alias("in_memory"))


@query
def content_hashes(spark, sf):
    return docs(spark, sf).groupBy(X.content_hash(F.col("content")).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query
def rename_diff(spark, sf):
    d = docs(spark, sf).withColumn("content_hash", X.content_hash(F.col("content")))
    old = d.where("doc_id % 3 <> 0").select(F.concat(F.lit("old/"), "path").alias("path"), "content_hash")
    new = d.where("doc_id % 2 = 0").select(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("new/"), "path")).otherwise(F.concat(F.lit("old/"), "path")).alias("path"), "content_hash")
    return lifecycle.rename_plan(old, new)


@query
def rename_changed(spark, sf):
    """As rename_diff, but half of the files that moved have changed too."""
    d = docs(spark, sf).withColumn("content_hash", X.content_hash(F.col("content")))
    old = d.where("doc_id % 3 <> 0").select(F.concat(F.lit("old/"), "path").alias("path"), "content", "content_hash")
    changed = F.concat("content", F.lit("\nadded to d"), "doc_id", F.lit(" in a later year"))
    new = d.where("doc_id % 2 = 0").withColumn("content", F.when(F.col("doc_id") % 8 == 0, changed).otherwise(F.col("content"))).select(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("new/"), "path")).otherwise(F.concat(F.lit("old/"), "path")).alias("path"), "content", X.content_hash(F.col("content")).alias("content_hash"))
    return lifecycle.rename_plan(old, new, similar=0.8)


@query
def rename_history(spark, sf):
    """Renames of documents, one to five in a row, as one each."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 5 + 1).cast("int"))).alias("step"))
    name = lambda k: F.concat(F.lit("d"), F.col("doc_id"), F.lit("_"), k)
    back = (F.col("doc_id") % 7 == 0) & (F.col("step") == F.col("doc_id") % 5 + 1)
    rows = d.select((F.col("step") * 10).alias("seq"), name(F.col("step") - 1).alias("old"), F.when(back, name(F.lit(0))).otherwise(name(F.col("step"))).alias("new"))
    return lifecycle.close_renames(rows)


@query
def planted_secrets(spark, sf):
    """Kinds of credentials in documents that some were appended to by rule."""
    i, h = F.col("doc_id"), F.md5(F.col("doc_id").cast("string"))
    parts = (F.concat(F.lit(" sk-"), h), F.concat(F.lit(" AKIA"), F.upper(F.substring(h, 1, 16))), F.concat(F.lit(" ghp_"), h, F.lit("abcd")), F.concat(F.lit(" xoxb-"), h), F.concat(F.lit(" AIza"), h, F.lit("abc")), F.lit("\n-----BEGIN RSA PRIVATE KEY-----\n"), F.concat(F.lit(" sk-"), F.substring(h, 1, 19)))
    tail = F.concat(*[F.when(i % (7 + k) == k, p).otherwise("") for k, p in enumerate(parts)])
    return docs(spark, sf).select("path", F.explode(lint.secrets_in(F.concat("content", tail))).alias("kind"))


@query
def incremental_plan(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("path"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size_bytes"), X.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    known = d.where("doc_id % 7 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, "changed").otherwise(F.col("content_hash")).alias("content_hash"))
    current = d.where("doc_id % 11 <> 0")
    return lifecycle.embedding_plan(known, current, lifecycle.gate(current.select("path", "size_bytes"), _policy(d), CONFIG))


def _policy(d: DataFrame) -> DataFrame:
    return d.where("doc_id % 3 <> 0").select("path", F.when(F.col("doc_id") % 9 == 1, "allow").when(F.col("doc_id") % 9 == 2, "llm_skip").otherwise("skip").alias("action"))


@query
def oversize_gate(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("path"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size_bytes"))
    return lifecycle.gate(d.select("path", "size_bytes"), _policy(d), CONFIG)


# ------------------------------------------------------------ graph


@query
def wikilink_edges(spark, sf):
    return link_edges(spark, sf).select("src", "dst", "count", "raw_target")


@query
def broken_links(spark, sf):
    return lint.broken_links(graph.broken(resolved(spark, sf))).select("source", "raw", "syntax", "reason")


@query
def broken_categories(spark, sf):
    keys = spark.createDataFrame([], "key string, path string")
    rows = graph.classify_broken(graph.broken(resolved(spark, sf)), keys, CONFIG)
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query
def backlinks(spark, sf):
    return graph.backlinks(link_edges(spark, sf), notes(spark, sf).where("doc_id = 5").first().path)


@query
def orphans_stem(spark, sf):
    n = linked(spark, sf)
    return graph.orphans_by_stem(n.select("path", "basename"), graph.links(n)).select("path")


@query
def orphans_graph(spark, sf):
    return graph.orphans_by_graph(graph.nodes(notes(spark, sf).select("path"), link_edges(spark, sf), CONFIG)).select("path")


@query
def node_degrees(spark, sf):
    n = graph.nodes(notes(spark, sf).select("path"), link_edges(spark, sf), CONFIG)
    return n.select("path", "category", "archived", "in_degree_wiki", "out_degree_wiki", "in_degree_semantic", "out_degree_semantic").unionByName(
        sem_nodes(spark, sf, sem_edges(spark, sf)).select("path", "category", "archived", "in_degree_wiki", "out_degree_wiki", "in_degree_semantic", "out_degree_semantic")
    )


@query
def god_nodes(spark, sf):
    return graph.god_nodes(graph.nodes(notes(spark, sf).select("path"), link_edges(spark, sf), CONFIG)).select("path", "total_in")


@query
def cross_category(spark, sf):
    edges = sem_edges(spark, sf)
    return graph.cross_category(edges, sem_nodes(spark, sf, edges)).select("src", "dst", "src_cat", "dst_cat", round6("weight").alias("weight"))


def _community_stats(spark, sf):
    edges = sem_edges(spark, sf)
    nodes = sem_nodes(spark, sf, edges)
    members = nodes.select("path", F.col("label").alias("community_id"), F.concat(F.lit("k"), (F.col("path").cast("long") % 3).cast("string")).alias("category"), (F.col("in_degree_wiki") + F.col("in_degree_semantic")).alias("total_in"))
    return graph.community_stats(members, edges)


@query
def community_stats(spark, sf):
    c = F.array_join(F.transform("categories", lambda x: F.concat_ws("=", x["category"], x["n"].cast("string"))), ",")
    return _community_stats(spark, sf).select("community_id", "size", "cohesion", c.alias("categories"), F.array_join("hubs", ",").alias("hubs"))


@query
def deviation_signals(spark, sf):
    return graph.deviation_signals(_community_stats(spark, sf), CONFIG)


@query
def neighbors_2hop(spark, sf):
    start = notes(spark, sf).where("doc_id = 1").first().path
    return graph.neighbors(link_edges(spark, sf), start, 2).select("path", "edge_type", "weight", "hop")


@query
def shortest_path_len(spark, sf):
    ends = {r.doc_id: r.path for r in notes(spark, sf).where("doc_id in (1, 42)").select("doc_id", "path").collect()}
    found = graph.shortest_path(link_edges(spark, sf), ends[1], ends[42])
    return spark.createDataFrame([(ends[1], ends[42], len(found) - 1)], "src string, dst string, hops int")


@query
def louvain_communities(spark, sf):
    edges = sem_edges(spark, sf)
    return graph.communities(sem_nodes(spark, sf, edges).select("path", "archived"), edges)


# ------------------------------------------------------------ reports, lifecycle, lint


@query
def tags_topics(spark, sf):
    rows = table(spark, sf, "conversations").select(F.concat(F.lit("t"), "conv_id", F.lit("_"), "turn").alias("path"), F.lit("-").alias("date"), F.array("role").alias("tags"))
    return report.topics(rows).groupBy("tag").agg(F.max("n").alias("n"), F.min("path").alias("first_path"))


@query
def manifest_counts(spark, sf):
    counts = report.category_counts(report.entries(notes(spark, sf), config=CONFIG))
    sparse = EngineConfig(sparse_category=40)
    return counts.join(report.sparse_categories(counts, sparse).select("category", F.lit(True).alias("s")), "category", "left").select("category", "n", F.coalesce("s", F.lit(False)).alias("sparse"))


@query
def health_summary(spark, sf):
    n = graph.nodes(notes(spark, sf).select("path"), link_edges(spark, sf), CONFIG)
    return report.health(n, graph.orphans_by_graph(n), CONFIG)


@query
def orphan_report(spark, sf):
    n = graph.nodes(notes(spark, sf).select("path"), link_edges(spark, sf), CONFIG)
    return report.orphan_counts(graph.orphans_by_graph(n))


@query
def confidence_mix(spark, sf):
    return report.confidence_mix(sem_edges(spark, sf))


@query
def trend_append(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query
def workflow_frequency(spark, sf):
    f = lifecycle.frequency(table(spark, sf, "events").withColumn("path", F.concat(F.lit("u"), "user_id")), "2024-01-25 12:00:00", days=30)
    return f.select("path", "frequency", F.date_format("last_used", "yyyy-MM-dd").alias("last_day"))


@query
def note_states(spark, sf):
    """The states of users' events, as a stream leaves them in a store."""

    def make() -> DataFrame:
        place = scratch(spark, "events")  # a stream reads a folder; all that lies there is one micro-batch, and timers make another
        e = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("content_hash"))
        e.write.parquet(place)
        rows = spark.readStream.schema(e.schema).parquet(place)
        store = Store(spark, scratch(spark, "states"))
        keep_states(rows, store, scratch(spark, "stream"), "1 hour", 7).awaitTermination()
        return store.read("note_states")

    rows = kept(spark, sf, "states", make)
    return rows.select("path", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "content_hash", "status", "woken")


@query
def lifecycle_channels(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    i = F.col("doc_id")
    day = lambda n: F.date_format(F.date_sub(F.lit(AS_OF).cast("date"), n.cast("int")), "yyyy-MM-dd")
    memory = d.select(
        F.concat(F.lit("m"), "doc_id").alias("path"), F.element_at(F.array(*map(F.lit, ("workflow", "feedback", "project", "reference"))), (i % 4 + 1).cast("int")).alias("type"),
        F.when(i % 5 != 0, (i % 10) / 100).alias("frequency"), day((i * 37) % 500).alias("last_used"),
        F.when(i % 3 == 0, "dormant").otherwise("active").alias("liveness"), F.when(i % 7 != 0, day((i * 53) % 500)).alias("last_confirmed"), (i % 6).cast("int").alias("confirmed_count"),
        F.when(i % 2 == 0, F.when(i % 8 == 2, "complete").otherwise("active")).alias("status"), day((i * 11) % 200).alias("completed_at"), F.lit(None).cast("timestamp").alias("changed_at"),
    )
    return lifecycle.memory_signals(memory, CONFIG).select("path", "type", "signal")


@query
def active_session(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("model"), "ts", "user_id")
    found = lifecycle.active_session(rows, F.col("user_id") == 8, "2024-01-20 00:00:00", 86400)
    return found.select("model", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "active", "degraded")


@query
def orphan_concepts(spark, sf):
    p = table(spark, sf, "pages")
    spans = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'<a href="[^"]*">([^<]{2,30})</a>'), F.lit(1)), lambda t: F.trim(t))
    rows = p.select(F.concat(F.lit("p"), "page_id").alias("path"), F.explode(spans).alias("term")).withColumn("code", F.lit(False))
    names = table(spark, sf, "nation").select(F.col("n_name").alias("basename"))
    return lint.orphan_concepts(lint.filter_terms(rows), names)


def _long_words(spark, sf) -> DataFrame:
    """Words of eight letters or more of the benchmark, as terms."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{8,}"), F.lit(0))
    return table(spark, sf, "benchmark").select(F.explode(words).alias("term")).distinct()


@query
def term_contexts(spark, sf):
    """The first four documents of each term and what stands around it there."""
    hits = lint.term_hits(docs(spark, sf), _long_words(spark, sf))
    return lint.term_contexts(hits).select("term", "notes", "path", "context")


@query
def contradiction_candidates(spark, sf):
    hits = lint.term_hits(docs(spark, sf), _long_words(spark, sf)).select("term", "path")
    return lint.contradiction_candidates(hits)


@query
def private_paths(spark, sf):
    """Which of the paths made from documents are private."""
    name = F.element_at(F.array(*map(F.lit, (".aws/credentials", "x.aws/config", "a.gnupg/k.txt", ".SSH/known", "my Password.md", "plain.md", "id_rsa", "token/plain.md"))), (F.col("doc_id") % 8 + 1).cast("int"))
    d = table(spark, sf, "documents").select(F.concat("source", F.lit("/"), F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("d"), F.col("doc_id"), F.lit("/"))), name).alias("path"))
    return d.where(lint.private_path(F.col("path"))).select("path")


@query
def stale_years(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("path"), F.concat(F.lit("Order of "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" is open.")).alias("content"))
    return lint.stale_years(o, 2026).select("path", "year", "context")


@query
def secret_scan(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    p = table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("path"), F.coalesce("html", F.lit("")).alias("content"))
    return d.unionByName(p).select("path", F.explode(lint.secrets_in(F.col("content"))).alias("kind"))


@query
def page_links(spark, sf):
    hrefs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'href="([^"]*)"'), F.lit(1))
    rows = table(spark, sf, "pages").select("page_id", F.explode(hrefs).alias("target"))
    return rows.where(L.internal_candidate(F.col("target"))).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("first_target"))


@query
def repo_profile(spark, sf):
    files = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id", F.when(F.col("doc_id") % 4 == 0, ".docx").when(F.col("doc_id") % 50 == 1, ".doc").otherwise(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    p = report.profile(files, 10, CONFIG)
    return p.select("notes", "office", "legacy", "hosts", round6("orphan_ratio").alias("orphan_ratio"), "inbox_threshold", "orphan_threshold", "sparse_threshold", F.array_join("hints", ",").alias("hints"))


@query
def token_coverage(spark, sf):
    """Directory tokens against file tokens: which sources no note stands under."""
    wanted = table(spark, sf, "documents").select(F.concat("source", F.lit("/")).alias("token")).distinct().unionByName(spark.createDataFrame([("absent/",)], "token string"))
    given = notes(spark, sf).select(F.col("path").alias("token"))
    return policy.unmatched_tokens(wanted, given)


@query
def category_top_notes(spark, sf):
    """The three longest notes of each category."""
    n = notes(spark, sf).select("path", P.category(F.col("path"), CONFIG.inbox).alias("category"), F.length("content").alias("n_chars"))
    w = Window.partitionBy("category").orderBy(F.desc("n_chars"), "path")
    return n.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
