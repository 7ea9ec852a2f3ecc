"""Best-fit packing with swap-based local search, planned on the histogram of lengths.

How well bins fill depends on lengths alone, and there are at most ``capacity``
of those. So the plan is made from counts by length: groups of equal bins,
each a pattern (which lengths, how many of each) and how many bins have it.
Best-fit decreasing makes the first plan; the local search then takes pairs of
groups of underfull bins and moves a piece, exchanges one for one or two for
one, in as many bins as the two groups pair up, as long as the sum of squared
fills rises, until bins empty or the bound of total / capacity is met. Its cost
depends on the capacity, not on the number of documents.

Pieces find their place by their rank among pieces of equal length: an index in
their own task plus the counts of the tasks before it. A length that a third of
all pieces share is split like any other.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.lean import lean
from corpuslake.llm.tokens import encoder
from corpuslake.llm.workspace import materialise, new_workspace

#: Improving steps of the local search; a step works on whole groups of bins.
STEPS = 4000
#: Underfull groups that a step looks at, from the emptiest and the fullest side.
LOOK = 48


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Best-fit decreasing on counts by length: groups (pattern, bins)."""
    by_gap: dict[int, list[tuple[Counter, int]]] = {}
    done: list[tuple[Counter, int]] = []

    def put(pattern: Counter, bins: int) -> None:
        gap = capacity - sum(l * c for l, c in pattern.items())
        if gap:
            by_gap.setdefault(gap, []).append((pattern, bins))
        else:
            done.append((pattern, bins))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            gap = min((g for g in by_gap if g >= length), default=None)
            if gap is None:
                pattern, bins, each = Counter(), left, capacity // length
            else:
                (pattern, bins), each = by_gap[gap].pop(), gap // length
                if not by_gap[gap]:
                    del by_gap[gap]
            full = min(bins, left // each)
            rest = left - full * each if full < bins else 0
            if full:
                put(pattern + Counter({length: each}), full)
            if full < bins and rest and rest < each:
                put(pattern + Counter({length: rest}), 1)
                left -= rest
                if gap is not None and bins - full - 1:
                    put(pattern, bins - full - 1)
            elif gap is not None and bins - full:
                put(pattern, bins - full)
            left -= full * each
    return done + [x for group in by_gap.values() for x in group]


def _exchange(a: Counter, gap: int, b: Counter) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """What the emptier bin b gives and gets so that the fuller bin a, with ``gap`` free, gains most: (from b, from a)."""
    mine, yours = sorted(a), sorted(b)
    best, found = 0, None
    for x in yours:
        if best < x <= gap:
            best, found = x, ((x,), ())
    if best == gap:
        return found
    have = set(mine)
    pairs = [(x + y, (x, y)) for i, x in enumerate(yours) for y in yours[i:] if x != y or b[x] > 1]
    twos = [(x + y, (x, y)) for i, x in enumerate(mine) for y in mine[i:] if x != y or a[x] > 1]
    for give, what in [(x, (x,)) for x in yours] + pairs:
        for gain in range(gap, best, -1):
            if give - gain in have:
                best, found = gain, (what, (give - gain,))
                break
    sums = dict(twos)
    for x in yours:
        for gain in range(gap, best, -1):
            if x - gain in sums:
                best, found = gain, ((x,), sums[x - gain])
                break
    return found


def improve(groups: list[tuple[Counter, int]], capacity: int, steps: int = STEPS) -> list[tuple[Counter, int]]:
    """Local search over underfull bins; every step raises the sum of squared fills."""
    merged: Counter = Counter()
    for pattern, bins in groups:
        merged[tuple(sorted(pattern.items()))] += bins
    fill = lambda key: sum(l * c for l, c in key)
    total = sum(fill(k) * n for k, n in merged.items())
    least = -(-total // capacity)
    failed: set = set()
    for _ in range(steps):
        if sum(n for k, n in merged.items() if k) <= least:
            break
        under = sorted((k for k, n in merged.items() if n and k and fill(k) < capacity), key=lambda k: (fill(k), k))
        step = None
        for b in under[:LOOK]:
            for a in reversed(under[-LOOK:]):
                if fill(a) < fill(b) or (a == b and merged[a] < 2) or (a, b) in failed:
                    continue
                step = _exchange(Counter(dict(a)), capacity - fill(a), Counter(dict(b)))
                if step:
                    break
                failed.add((a, b))
            if step:
                break
        if not step:
            break
        give, get = Counter(step[0]), Counter(step[1])
        bins = merged[a] // 2 if a == b else min(merged[a], merged[b])
        new_a = Counter(dict(a)) + give
        new_a.subtract(get)
        new_b = Counter(dict(b)) + get
        new_b.subtract(give)
        for key, change in ((a, -bins), (b, -bins), (tuple(sorted((+new_a).items())), bins), (tuple(sorted((+new_b).items())), bins)):
            merged[key] += change
            if not merged[key]:
                del merged[key]
    return [(Counter(dict(k)), n) for k, n in sorted(merged.items()) if k and n]


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Where ranks of each length go: rows (length, first rank, pieces in a bin, first sequence, offset), sorted."""
    rows, seen, sequence = [], Counter(), 0
    for pattern, bins in improve(best_fit(counts, capacity), capacity):
        offset = 0
        for length in sorted(pattern, reverse=True):
            c = pattern[length]
            rows.append((length, seen[length], c, sequence, offset))
            seen[length] += c * bins
            offset += length * c
        sequence += bins
    assert seen == Counter(counts), "the plan must place every piece"
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T))


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, ids (null unless kept), part, nth (place among the part's pieces of its length)."""

    def run(batches):
        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            for lo, hi, ids, bounds in enc.column(b.column(1), end_id):
                out: list[list] = [[] for _ in range(8)]
                raw = memoryview(ids.astype("<u4").tobytes())
                for row, first, last in zip(range(lo, hi), bounds[:-1].tolist(), bounds[1:].tolist()):
                    total = last - first
                    head = total % capacity
                    cuts = ([0] if head else []) + list(range(head, total, capacity)) + [total]
                    for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
                        body = raw[4 * (first + a) : 4 * (first + z)]
                        for column, value in zip(out, (row, i, a, z - a, zlib.crc32(body), bytes(body) if keep_ids else None, part, int(seen[z - a]))):
                            column.append(value)
                        seen[z - a] += 1
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
                columns = [pa.array(x, t) for x, t in zip(out, types)]
                columns[0] = b.column(0).take(columns[0])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "nth"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, nth long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Pack docs (doc_id, text) into sequences of at most ``capacity`` ids.

    Returns for each piece doc_id, piece (from 0), start, length, ids_crc32,
    ids (little-endian uint32, null unless ``keep_ids``), sequence_id, offset. A document is its ids and
    ``end_id``; null text counts as empty. Only documents over the capacity are
    cut, into full pieces behind a first one that may be shorter. Rows that repeat
    a doc_id, or have none, are packed each; their doc_id comes back as it is.
    Other columns are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer, end_id, capacity, keep_ids), f"{new_workspace(spark, 'packing')}/pieces")
    by_part = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    shared = spark.sparkContext.broadcast(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches):
        p = shared.value
        key = (p["length"] << 44) + p["rank"]
        for b in batches:
            length, rank = (np.asarray(b.column(i)).astype(np.int64) for i in (3, 6))
            row = np.searchsorted(key, (length << 44) + rank, "right") - 1
            bin_, slot = np.divmod(rank - p["rank"][row], p["each"][row])
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(p["sequence"][row] + bin_), pa.array(p["offset"][row] + slot * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"])

    return ranked.mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")
