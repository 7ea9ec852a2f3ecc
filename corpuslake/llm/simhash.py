"""SimHash near-duplicates with pigeonring candidate filtering.

A 64-bit fingerprint is a ring of ``SEGMENTS`` segments. If two fingerprints
differ in at most ``distance`` bits, some segment starts a chain all of whose
prefixes stay within the proportional budget: the first l segments of the chain
differ in at most floor(l * distance / SEGMENTS) bits. With more segments than
allowed differences that budget is 0 for l = 1, so equal segments are join
keys. A candidate's chain is followed from its key, one segment after the other,
and only candidates that keep to every budget come to the full Hamming check. A key with
more than ``dense`` distinct fingerprints is split by the chain's second
segment: its budget is met by the segment itself and its one-bit variants.

Only distinct fingerprints take part, each under the smallest doc_id that has
it, so exact copies cost nothing. Each task returns a spanning forest of the
links that it found, never all pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm import bytewords as bw
from corpuslake.llm import simhash_sets
from corpuslake.llm.components import components
from corpuslake.llm.lean import lean
from corpuslake.llm.workspace import materialise, new_workspace

SEGMENTS, BITS = 4, 16
SLICE = 2 << 20
U = np.uint64


def fingerprints_of(column: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprints (uint64) of a string column: bit set where over half the shingles' XXH64 have it."""
    from xxhash import xxh64_intdigest as digest

    data, off = bw.buffers(column)
    out = np.zeros(len(off) - 1, U)
    for lo, hi in bw.slices(off, SLICE):
        raw = bw.LOWER[data[off[lo] : off[hi]]]
        w = bw.Words(raw, off[lo : hi + 1] - off[lo], bw.SPACED)
        flat = np.where(bw.SPACED[raw], raw, np.uint8(32)).tobytes()
        counts = np.where(w.count >= shingle, w.count - shingle + 1, np.minimum(w.count, 1))
        first = np.concatenate(([0], np.cumsum(counts)))
        total = int(first[-1])
        if not total:
            continue
        # the first word of each shingle, and how many words it has
        doc = np.repeat(np.arange(hi - lo), counts)
        at = w.first[:-1][doc] + (np.arange(total) - first[doc])
        size = np.minimum(w.count[doc], shingle)
        start, end = w.start[at], w.end[at + size - 1]
        # joined by single spaces already if the span is as long as that makes it
        through = np.concatenate(([0], np.cumsum(w.end - w.start)))
        plain = end - start == through[at + size] - through[at] + size - 1
        if plain.all():
            values = [digest(flat[a:b], seed) for a, b in zip(start.tolist(), end.tolist())]
        else:
            values = [digest(flat[a:b] if ok else b" ".join(flat[a:b].split()), seed) for a, b, ok in zip(start.tolist(), end.tolist(), plain.tolist())]
        h = np.array(values, U)
        sums = np.zeros((hi - lo, 64), np.int64)
        for a in range(0, total, 1 << 18):
            part, owner = h[a : a + (1 << 18)], doc[a : a + (1 << 18)]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            sums[owner[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
        over = (2 * sums > counts[:, None]).astype(np.uint8)
        out[lo:hi] = np.packbits(over, axis=1, bitorder="little").view(U)[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) of each row of docs (doc_id, text). Null or wordless text: 0; a null doc_id stays null."""

    def run(batches):
        for b in batches:
            fp = fingerprints_of(b.column(1), shingle).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


class Forest:
    """Union-find over positions; keeps the edges that joined two trees."""

    def __init__(self, n: int):
        self.up, self.kept = list(range(n)), []

    def add(self, a: list[int], b: list[int]) -> None:
        up, kept = self.up, self.kept
        for x, y in zip(a, b):
            i, j = x, y
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            while up[j] != j:
                up[j] = up[up[j]]
                j = up[j]
            if i != j:
                up[max(i, j)] = min(i, j)
                kept.append((x, y))


def chained(a: np.ndarray, b: np.ndarray, segment: np.ndarray, distance: int, counts: list | None = None) -> np.ndarray:
    """Places of the pairs within ``distance`` whose chain from ``segment`` on keeps to every proportional budget.

    Each prefix is looked at only where the one before it holds, the whole ring
    last; ``counts`` gets how many pairs came to each.
    """
    left = np.arange(len(a))
    total = np.zeros(len(a), np.int64)
    for l in range(1, SEGMENTS + 1):
        if counts is not None:
            counts.append(len(left))
        at = ((segment[left] + l - 1) % SEGMENTS * BITS).astype(U)
        total = total + np.bitwise_count((a[left] ^ b[left]) >> at & U(0xFFFF))
        keep = total <= l * distance // SEGMENTS  # for the last prefix the full Hamming check
        left, total = left[keep], total[keep]
    return left


def _links(key: np.ndarray, exact: np.ndarray, fp: np.ndarray, segment: np.ndarray, distance: int, forest: Forest) -> None:
    """Feed the forest with the links among rows of equal key; of each pair one row at least is exact."""
    n = len(key)
    if n < 2:
        return
    edge = np.flatnonzero(np.diff(key, prepend=key[0] ^ U(1)))
    size = np.diff(np.append(edge, n))

    def check(i: np.ndarray, j: np.ndarray) -> None:
        keep = exact[i] | exact[j]
        i, j = i[keep], j[keep]
        keep = chained(fp[i], fp[j], segment[i], distance)
        forest.add(i[keep].tolist(), j[keep].tolist())

    small = np.repeat(size <= 64, size)
    for d in range(1, min(64, int(size.max(initial=0)))):
        i = np.flatnonzero((key[:-d] == key[d:]) & small[:-d])
        if not len(i):
            break
        for a in range(0, len(i), 1 << 20):
            check(i[a : a + (1 << 20)], i[a : a + (1 << 20)] + d)
    for at, count in zip(edge[size > 64].tolist(), size[size > 64].tolist()):
        tile = 512
        for a in range(at, at + count, tile):
            rows = np.arange(a, min(a + tile, at + count))
            for b in range(a, at + count, tile):
                cols = np.arange(b, min(b + tile, at + count))
                i, j = (x.ravel() for x in np.meshgrid(rows, cols, indexing="ij"))
                keep = i < j
                check(i[keep], j[keep])


def links(prints: DataFrame, distance: int = 3, dense: int = 1024) -> DataFrame:
    """Distinct fingerprints (fp, node) -> edges (a, b) between nodes that connect every pair within ``distance`` bits.

    ``distance`` must be below SEGMENTS. Rows with a null node are left out.
    """
    if not 0 <= distance < SEGMENTS:
        raise ValueError(f"distance must be from 0 to {SEGMENTS - 1}")
    spark = prints.sparkSession
    # some 100,000 rows to a task, however many there are
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-SEGMENTS * prints.count() // 100_000))
    seg = lambda i: F.shiftrightunsigned("fp", BITS * i).bitwiseAND(F.lit(0xFFFF))
    keyed = prints.where("node is not null").select("fp", "node", F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), seg(i).alias("k"), seg((i + 1) % SEGMENTS).alias("k2")) for i in range(SEGMENTS)])).alias("x")).select("fp", "node", "x.*")
    heavy = keyed.groupBy("segment", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense).select("segment", "k", F.lit(True).alias("heavy"))
    # at most rows / dense heavy keys, and never more than SEGMENTS * 2**BITS: a bounded side
    marked = keyed.join(F.broadcast(heavy), ["segment", "k"], "left")
    budget = 2 * distance // SEGMENTS
    variants = [0] + ([1 << b for b in range(BITS)] if budget else [])
    if budget > 1:
        raise ValueError("budgets over 1 for two segments are not indexed")
    sub = F.when(F.col("heavy"), F.array(*[F.lit(v) for v in variants])).otherwise(F.array(F.lit(-1)))
    rows = marked.select("fp", "node", "segment", "k", "k2", F.explode(sub).alias("v")).select(
        "fp", "node", "segment",
        (F.col("segment").cast("long") * (1 << 40) + F.col("k") * (1 << 20) + F.when(F.col("v") < 0, F.lit(1 << 17)).otherwise(F.col("k2").bitwiseXOR(F.col("v")))).alias("key"),
        (F.col("v") <= 0).alias("exact"),
    )

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        key, fp, node, segment, exact = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "fp", "node", "segment", "exact"))
        order = np.argsort(key, kind="stable")
        key, fp, node, segment, exact = key[order].astype(U), fp[order].view(U), node[order], segment[order].astype(np.int64), exact[order]
        # positions of one node are one tree from the start
        nodes, same = np.unique(node, return_inverse=True)
        forest = Forest(len(key))
        lead = np.full(len(nodes), -1, np.int64)
        lead[same[::-1]] = np.arange(len(key))[::-1]
        repeat = np.flatnonzero(lead[same] != np.arange(len(key)))
        forest.add(lead[same[repeat]].tolist(), repeat.tolist())
        forest.kept.clear()
        _links(key, exact, fp, segment, distance, forest)
        if forest.kept:
            e = np.array(forest.kept, np.int64)
            yield pa.record_batch([pa.array(node[e[:, 0]]), pa.array(node[e[:, 1]])], names=["a", "b"])

    return rows.repartition(parts, "key").mapInArrow(lean(run), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3, similarity: tuple[int, int] | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text, ...): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of at most ``distance`` bits
    reach, itself included. Null, empty and wordless texts have fingerprint 0 and
    link like any other. Rows that repeat a doc_id are all returned. A row
    without doc_id gets the component of its fingerprint, null if no row with a
    doc_id has it. Extra columns are ignored; no rows give no rows.

    With a ``similarity`` (over, under) fingerprints only prune, within a wide
    radius that takes the place of ``distance``, and texts are linked if the sets of
    their shingles have a Jaccard similarity of over / under or more; the result
    is then (doc_id, component_id) of the rows with a doc_id: ``simhash_sets``.
    """
    if similarity:
        return simhash_sets.similar(docs, shingle, *similarity)
    spark = docs.sparkSession
    place = new_workspace(spark, "simhash")
    marks = materialise(fingerprints(docs, shingle), f"{place}/prints")
    prints = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("node")), f"{place}/distinct")
    found = components(links(prints, distance))
    classes = prints.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marks.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
