"""BM25 with the odds-ratio weight (N - df + .5) / (df + .5), without a logarithm by default.

The index is a block-max index. Chunks are numbered in one pass over the notes and
512 of them make a cell; a block holds the postings of one term in one cell and the
greatest gain that a posting of it can bring, without the term's weight. Blocks are
stored clustered by term, so that a query's terms prune row groups, and the bounds
are a column of their own, which is read without the postings.

A search adds up bounds for each cell, scores the most promising cell of each query
and takes its k-th best score as a threshold. Cells whose bounds stay below it are
never read. In the others the terms of least bound that together stay below it are
not essential (MaxScore): no chunk that only has those can be among the best, so
candidates come from the essential terms, and the others' blocks are read only
where a candidate is left. No hot term is ever gathered, and all queries run in one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.config import EngineConfig
from corpuslake.functions import text as X
from corpuslake.functions.arrow import release, tidy
from corpuslake.session import cut_lineage, scratch
from corpuslake.sources.tables import Store

#: Chunks of a cell, as a power of two.
CELL_BITS = 11
#: Bits of the count and of the length in a posting; both stop at what they can hold, far over any chunk's.
TF_BITS = 22
TF_MOST = (1 << TF_BITS) - 1
#: Scores are ranked by six decimals, so bounds may fall short of a threshold by that much.
SLACK = 1e-6
TABLES = ("bm25_chunks", "bm25_blocks", "bm25_terms", "bm25_corpus")


def weight(n: Column, df: Column, form: str = "odds") -> Column:
    odds = F.greatest(F.lit(0.0), (n - df + 0.5) / (df + 0.5))
    return odds if form == "odds" else F.log1p(odds)


def impact(tf, dl, avgdl: float, k1: float, b: float):
    """A posting's gain without its term's weight; numbers, arrays or columns."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


@dataclass(frozen=True)
class Index:
    """chunks(doc, path, chunk_index, dl, tokens), blocks(term, cell, bound, postings), term_stats(term, df, idf), corpus_stats(n, avgdl) of one row."""

    chunks: DataFrame
    blocks: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    config: EngineConfig = EngineConfig()

    @staticmethod
    def load(store: Store, config: EngineConfig = EngineConfig()) -> Index:
        return Index(*(store.read(t) for t in TABLES), config)


def tokens_of(chunks: DataFrame) -> DataFrame:
    """(path, chunk_index, tokens, dl); an empty chunk counts, with length 0."""
    return chunks.select("path", "chunk_index", X.tokenize(F.col("chunk_text")).alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def _blocks(batches, cell_bits: int, avgdl: float, config: EngineConfig):
    """Arrow batches (doc, dl, tokens joined by blanks), ascending by doc, as blocks term, cell, bound, postings; a cell's chunks at a time.

    A cell is named by its first chunk, so that one which a scan divides is two.

    A posting is one number: the chunk's place behind that one, the term's count, the chunk's length.
    """

    def blocks(rows: pa.Table) -> pa.RecordBatch:
        doc, dl = (rows.column(c).to_numpy() for c in ("doc", "dl"))
        codes = pc.split_pattern(rows.column("tokens").filter(pa.array(dl > 0)).combine_chunks(), " ").flatten().dictionary_encode()
        place = np.repeat(np.arange(len(doc)), dl)
        found, tf = np.unique(codes.indices.to_numpy().astype(np.int64) * len(doc) + place, return_counts=True)
        term, at = found // len(doc), found % len(doc)
        first = np.flatnonzero(np.diff(term, prepend=-1))
        packed = doc[at] - doc[0] << 2 * TF_BITS | np.minimum(tf, TF_MOST) << TF_BITS | np.minimum(dl[at], TF_MOST)
        ends = np.append(first, len(found)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(packed))
        bound = np.maximum.reduceat(impact(tf, dl[at], avgdl, config.k1, config.b), first) if len(first) else np.zeros(0)
        return pa.record_batch([codes.dictionary.take(pa.array(term[first])), pa.array(np.full(len(first), doc[0], np.int64)), pa.array(bound), lists], names=["term", "cell", "bound", "postings"])

    held, cell = [], None
    for b in batches:
        cells = np.asarray(b.column(0)) >> cell_bits
        cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1), len(cells)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if cell is not None and cells[lo] != cell:
                yield blocks(pa.Table.from_batches(held))
                held = []
            cell = int(cells[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield blocks(pa.Table.from_batches(held))


def build(chunks: DataFrame, config: EngineConfig = EngineConfig(), form: str = "odds", store: Store | None = None, cell_bits: int = CELL_BITS) -> Index:
    """The index of chunks (path, chunk_index, chunk_text), in a store or below the shared folder. Notes are read once; all four tables appear in one commit."""
    store = store or Store(chunks.sparkSession, scratch(chunks.sparkSession, "bm25"))
    read = chunks.sparkSession.read.parquet
    # numbered where they lie, so a cell's chunks follow each other in one file; the numbers are written before anything uses them
    numbered = tokens_of(chunks).select(F.monotonically_increasing_id().alias("doc"), "path", "chunk_index", "dl", F.array_join("tokens", " ").alias("tokens"))
    tokens = store.stage("bm25_chunks", numbered)
    stats = corpus_stats(read(tokens)).first()
    places = {"bm25_chunks": store.stage("bm25_chunks", read(tokens).drop("tokens")), "bm25_corpus": store.stage("bm25_corpus", chunks.sparkSession.createDataFrame([stats], "n long, avgdl double"))}
    made = read(tokens).select("doc", "dl", "tokens").mapInArrow(tidy(lambda batches: _blocks(batches, cell_bits, stats.avgdl, config)), "term string, cell long, bound double, postings array<long>")
    # written as they come, since a sort by range reads its input twice
    loose = store.stage("bm25_blocks", made)
    store.discard(tokens)
    places["bm25_blocks"] = store.stage("bm25_blocks", read(loose), ["term", "cell"])
    store.discard(loose)
    terms = read(places["bm25_blocks"]).groupBy("term").agg(F.sum(F.size("postings").cast("long")).alias("df")).withColumn("idf", weight(F.lit(stats.n), F.col("df"), form))
    places["bm25_terms"] = store.stage("bm25_terms", terms, ["term"])
    store.commit({name: [place] for name, place in places.items()})
    return Index.load(store, config)


# ------------------------------------------------------------ search

#: Queries that share one reading of a cell's blocks.
BATCH = 1024


def _scores(asked: DataFrame, index: Index) -> DataFrame:
    """asked (query_id, batch, term, cell, idf, most, least) -> query_id, doc, score of the chunks whose score reaches ``least``.

    A cell's blocks meet the queries of a batch in one task: at most 2 ** cell_bits
    chunks and BATCH queries. For each query terms go by rising bound; those whose
    bounds together stay below ``least`` are not essential and are looked up for the
    candidates only that the others leave.
    """
    c, avgdl = index.config, index.corpus_stats.first().avgdl
    wanted = asked.select("term", "cell", "batch").distinct()
    blocks = index.blocks.select("term", "cell", "postings").join(wanted, ["term", "cell"]).select(F.col("cell").alias("of_cell"), F.col("batch").alias("of_batch"), "term", "postings")
    rows = asked.select("cell", "batch", "query_id", "term", "idf", "most", "least")
    kind = dict(asked.dtypes)["query_id"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        of: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        first, size = right.column("cell")[0].as_py(), 0
        for term, postings in zip(left.column("term").to_pylist(), left.column("postings")):
            p = np.asarray(postings.values)
            tf, dl = p >> TF_BITS & TF_MOST, p & TF_MOST
            of[term] = p >> 2 * TF_BITS, impact(tf, dl, avgdl, c.k1, c.b)
            size = max(size, int(of[term][0].max()) + 1)
        queries = right.column("query_id").combine_chunks().dictionary_encode()
        each: dict[int, dict[str, list[float]]] = {}  # query -> term -> idf, most, least
        for q, term, *rest in zip(queries.indices.to_pylist(), *(right.column(x).to_pylist() for x in ("term", "idf", "most", "least"))):
            each.setdefault(q, {})[term] = rest
        number, docs, scores = [], [], []
        for q, terms in each.items():
            order = sorted(terms, key=lambda t: (terms[t][1], t))
            least = terms[order[0]][2]
            bounds = np.cumsum([terms[t][1] for t in order])
            essential = int(np.searchsorted(bounds, least))
            if essential == len(order):
                continue
            total = np.zeros(size)
            for t in order[essential:]:
                at, gain = of[t]
                total[at] += terms[t][0] * gain
            rest = bounds[essential - 1] if essential else 0.0
            open_ = (total > 0) & (total + rest >= least)
            if essential and open_.any():
                for t in order[:essential]:
                    at, gain = of[t]
                    some = open_[at]
                    total[at[some]] += terms[t][0] * gain[some]
            found = np.flatnonzero(open_ & (total >= least))
            number.append(np.full(len(found), q))
            docs.append(found + first)
            scores.append(total[found])
        join = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        ids = queries.dictionary.take(join(number, pa.int64()))
        found = pa.table({"query_id": ids, "doc": join(docs, pa.int64()), "score": join(scores, pa.float64())})
        of.clear()
        release()
        return found

    return blocks.groupBy("of_cell", "of_batch").cogroup(rows.groupBy("cell", "batch")).applyInArrow(score, f"query_id {kind}, doc long, score double")


def _found(scored: DataFrame, index: Index, keep: Column | None, dedupe: bool) -> DataFrame:
    """scored (query_id, doc, score) as query_id, path, chunk_index, score; with dedupe each path's best chunk."""
    out = scored.where("score > 0").join(index.chunks.select("doc", "path", "chunk_index"), "doc").select("query_id", "path", "chunk_index", "score")
    if keep is not None:
        out = out.where(keep)
    return _best_of_path(out) if dedupe else out


def _best_of_path(rows: DataFrame) -> DataFrame:
    best = rows.groupBy("query_id", "path").agg(F.max(F.struct("score", (-F.col("chunk_index")).alias("minus"))).alias("best"))
    return best.select("query_id", "path", (-F.col("best.minus")).alias("chunk_index"), "best.score")


def search_many(
    index: Index, queries: DataFrame, k: int = 3, keep: Column | None = None, dedupe: bool = False, only: list[str] | None = None, count: Callable[[str, DataFrame], None] | None = None
) -> DataFrame:
    """queries (query_id, text) -> (query_id, rank, path, chunk_index, score) of the k best chunks with a positive score.

    Repeated words of a query count once, unknown ones not at all. ``keep`` filters
    paths before ranks are given, ``dedupe`` leaves each path its best chunk. ``only``
    are the words that the queries can have, if they are few. ``count`` is called with
    a name and the blocks (query_id, term, cell): "asked" all of the queries' terms,
    "seeds" those read for the threshold, "later" those read after it.
    """
    words = queries.select("query_id", F.explode(F.array_distinct(X.tokenize(F.col("text")))).alias("term"))
    terms, blocks = index.term_stats, index.blocks
    if only is not None:
        terms, blocks = terms.where(F.col("term").isin(only)), blocks.where(F.col("term").isin(only))
    asked = words.join(terms.where("idf > 0").select("term", "idf"), "term").join(blocks.select("term", "cell", "bound"), "term")
    batch = F.pmod(F.xxhash64("query_id"), F.lit(-(-queries.count() // BATCH) or 1)).cast("int").alias("batch")
    asked = cut_lineage(asked.select("query_id", batch, "term", "idf", "cell", (F.col("idf") * F.col("bound")).alias("most")))
    index = Index(index.chunks, blocks, terms, index.corpus_stats, index.config)

    seeds = asked.groupBy("query_id", "cell").agg(F.sum("most").alias("all")).groupBy("query_id").agg(F.max_by("cell", F.struct("all", "cell")).alias("cell"))
    first = asked.join(seeds, ["query_id", "cell"], "left_semi")
    begun = cut_lineage(_found(_scores(first.withColumn("least", F.lit(0.0)), index), index, keep, dedupe))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"))  # one cell's chunks at most
    at = begun.withColumn("r", F.row_number().over(by_score)).where(F.col("r") == k).select("query_id", (F.col("score") - SLACK).alias("least"))
    # cells whose bounds stay below the threshold are not read
    open_ = asked.join(seeds, ["query_id", "cell"], "left_anti").join(at, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    all_ = Window.partitionBy("query_id", "cell")  # a query's words
    later = cut_lineage(open_.withColumn("all", F.sum("most").over(all_)).where("all >= least").drop("all"))
    if count is not None:
        for name, rows in (("asked", asked), ("seeds", first), ("later", later)):
            count(name, rows)
    total = _scores(later, index)
    found = begun.unionByName(_found(total, index, keep, dedupe))
    if dedupe:
        found = _best_of_path(found)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "path", "chunk_index")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "path", "chunk_index", "score")


def search(index: Index, query: str, k: int = 10, keep: Column | None = None, dedupe: bool = False) -> DataFrame:
    """(path, chunk_index, score) of the k best chunks with a positive score, in order: ``search_many`` with one query, whose words reach the scans."""
    asked = index.blocks.sparkSession.createDataFrame([(0, query)], "query_id int, text string")
    words = [r.t for r in asked.select(F.explode(F.array_distinct(X.tokenize(F.col("text")))).alias("t")).collect()]
    found = search_many(index, asked, k, keep, dedupe, words)
    return found.orderBy("rank").select("path", "chunk_index", "score")
