"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

Vectors are integers. Every component is a posting of its dimension; its impact
is quantised to a power-of-two level of its magnitude. A block of vectors keeps
its postings in segments by level, and all segments are processed by descending
level, so the large contributions of every vector come first. After each level
the unprocessed part of a vector's score is bounded by the product of the
query's and the vector's remaining norms (Cauchy-Schwarz, from exact remaining
sums of squares). A query stops in a block only once the number of vectors whose
upper bound reaches its threshold, its k-th best proven lower bound so far, is
at most ``rescore`` or no level is left; these possible members are rescored
exactly in integers. The threshold carries over from block to block of a task.

Queries go to the tasks in chunks of bounded size, each chunk one pass over the
vectors; what is shuffled is k rows for each query and task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.lean import lean

BLOCK = 2048
QUERIES = 4096
TILE = 256
#: Components below this magnitude keep sums of 2**13 products exact in float64.
_SAFE = 1 << 20


def quantise(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, x array<double>) with x = floor(scale * component); vectors null, empty of id, or with null or non-finite components are left out."""
    raw = F.col("embedding").cast("array<double>")
    bad = F.exists(raw, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(raw, lambda v: F.rint(v * scale) - F.when(F.rint(v * scale) > v * scale, 1.0).otherwise(0.0)).alias("x"))
    )


class Index:
    """The postings of one block by impact level, largest first."""

    def __init__(self, x: np.ndarray):
        self.x = x
        size = np.abs(x)
        level = np.where(size >= 1, np.frexp(np.maximum(size, 1))[1], 0)
        self.segments = []
        left = (x * x).sum(axis=1)
        for l in range(int(level.max(initial=0)), 0, -1):
            part = np.where(level == l, x, 0.0)
            if part.any():
                left = left - (part * part).sum(axis=1)
                self.segments.append((part, np.sqrt(np.maximum(left, 0.0))))


def _search(index: Index, q: np.ndarray, norm: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int, rescore: int):
    """Possible members of each query's top k: pairs (query, vector), a superset that the threshold proves complete."""
    n = len(index.x)
    score = np.zeros((len(q), n))
    active = np.arange(len(q))
    rows, cols = [], []
    segments = index.segments or [(np.zeros_like(index.x), np.zeros(n))]
    for i, (part, left) in enumerate(segments):
        score[active] += q[active] @ part.T
        slack = norm[active, None] * left[None, :] * (1 + 1e-9) + 1e-6
        low = np.where(own[active], -np.inf, score[active] - slack)
        if n >= k:
            floor[active] = np.maximum(floor[active], np.partition(low, n - k, axis=1)[:, n - k])
        may = (score[active] + slack >= floor[active, None]) & ~own[active]
        stop = (may.sum(axis=1) <= rescore) | (i == len(segments) - 1)
        r, c = np.nonzero(may[stop])
        rows.append(active[stop][r])
        cols.append(c)
        active = active[~stop]
        if not len(active):
            break
    return np.concatenate(rows), np.concatenate(cols)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of paired rows; beyond 64 bits they saturate."""
    if len(a) and max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) >= _SAFE:
        most = 2**63 - 1
        return np.array([max(-most - 1, min(most, sum(int(x) * int(y) for x, y in zip(p, q)))) for p, q in zip(a, b)], np.int64)
    return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    order = np.lexsort((ids, -score.astype(np.float64) if len(score) and np.abs(score.astype(np.float64)).max() >= 2**53 else -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], ids[keep], score[keep]


def _stack(arrays: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(arrays), width))
    for i, a in enumerate(arrays):
        out[i, : min(width, len(a))] = a[:width]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, rescore: int = 64) -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank (from 1), vec_id, score.

    vectors and queries: (vec_id long, x array<double> of whole numbers), as
    ``quantise`` makes them. A query's own vec_id is no candidate. Ties go to the
    smaller vec_id. Rows that repeat a vec_id are candidates each. Vectors of
    different lengths meet as if the shorter were padded with zeros. With fewer
    candidates than k all are returned; no vectors or no queries give no rows.
    Scores beyond 64 bits saturate.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    out = None
    chunk: list = []

    def run(chunk_rows: list) -> DataFrame:
        width = max(len(r.x) for r in chunk_rows)
        shared = sc.broadcast((np.array([r.vec_id for r in chunk_rows], np.int64), _stack([np.array(r.x) for r in chunk_rows], width)))

        def search(batches):
            qid, q = shared.value
            norm = np.sqrt((q * q).sum(axis=1))
            floor = np.full(len(q), -np.inf)
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            for b in batches:
                for lo in range(0, b.num_rows, BLOCK):
                    part = b.slice(lo, BLOCK)
                    ids = np.asarray(part.column(0)).astype(np.int64)
                    flat, off = part.column(1).flatten(), np.asarray(part.column(1).offsets)
                    flat, off = np.asarray(flat), off - off[0]
                    if (np.diff(off) == q.shape[1]).all():
                        x = flat.reshape(len(ids), q.shape[1])
                    else:
                        x = _stack([flat[a:z] for a, z in zip(off[:-1], off[1:])], q.shape[1])
                    index = Index(x)
                    found = [best]
                    for t in range(0, len(q), TILE):
                        s = slice(t, t + TILE)
                        r, c = _search(index, q[s], norm[s], qid[s, None] == ids[None, :], floor[s], k, rescore)
                        found.append((r + t, ids[c], _exact(q[s][r], x[c])))
                    best = _best(*(np.concatenate(z) for z in zip(*found)), k)
            yield pa.record_batch([pa.array(qid[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "vec_id", "score"])

        return vectors.mapInArrow(lean(search), "query_id long, vec_id long, score long")

    for row in queries.select("vec_id", "x").dropDuplicates(["vec_id"]).toLocalIterator():
        chunk.append(row)
        if len(chunk) == QUERIES:
            part = run(chunk)
            out, chunk = part if out is None else out.unionByName(part), []
    if chunk:
        part = run(chunk)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
