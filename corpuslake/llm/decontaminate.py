"""Benchmark decontamination by a prefix-filtered set join.

Each item becomes windows of ``window`` consecutive words (one window of all its
words if it has fewer). A window is a set of positioned shingles; to contain it
whole, a document must hold every one of them, so a prefix of one shingle
suffices, and the rarest by document frequency over all documents is taken.
Documents join on those prefix shingles; the shingle's place in the window and
the document's length bound where the window can lie; the words there are then
compared one by one and the bytes after that.

Item windows go to the tasks in blocks of bounded size, each in a pass of its
own over the documents, so any number of items works.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuslake.llm import bytewords as bw
from corpuslake.llm.lean import lean

SHINGLE = 3
SLICE = 4 << 20
#: UTF-8 bytes of item text in one block; what a task holds is some twenty times as much.
BLOCK_BYTES = 4 << 20
U = np.uint64
_BITS = 22


def _lowered(texts: pa.Array):
    data, off = bw.buffers(texts)
    for lo, hi in bw.slices(off, SLICE):
        yield lo, hi, bw.Words(bw.LOWER[data[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo], bw.ALNUM)


class Block:
    """The distinct windows of some items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        self.items_of: dict[bytes, set[str]] = defaultdict(set)
        for item, text in items:
            if not text:
                continue
            raw = bw.LOWER[np.frombuffer(text.encode(), np.uint8)]
            w = bw.Words(raw, np.array([0, len(raw)]), bw.ALNUM)
            words = [raw[a:b].tobytes() for a, b in zip(w.start, w.end)]
            for s in range(max(1, len(words) - window + 1)):
                if words:
                    self.items_of[b" ".join(words[s : s + window])].add(item)
        self.windows = sorted(self.items_of)
        text = pa.array([x.decode() for x in self.windows], pa.string())
        data, off = bw.buffers(text)
        w = bw.Words(data, off, bw.ALNUM)
        h = w.hashes()
        self.hashes = [h[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        self.sizes = sorted({min(SHINGLE, len(x)) for x in self.hashes})
        self.shingles = [bw.shingles(x, min(SHINGLE, len(x))) ^ U(min(SHINGLE, len(x))) for x in self.hashes]
        self.keys = np.unique(np.concatenate(self.shingles)) if self.shingles else np.zeros(0, U)

    def prefixes(self, frequency: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
        """Rarest shingle of each window -> (window, place); ties by hash."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, s in enumerate(self.shingles):
            place = min(range(len(s)), key=lambda j: (frequency.get(int(s[j]), 0), int(s[j]), j))
            found[int(s[place])].append((i, place))
        return dict(found)


class _Probe:
    """Finds the few shingles of documents that are in a set of keys."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.keys >> U(64 - _BITS)).astype(np.int64)] = True

    def hits(self, w: bw.Words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        s = bw.shingles(h, size) ^ U(size)
        if not len(s) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.table[(s >> U(64 - _BITS)).astype(np.int64)])
        found = s[at]
        place = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        at = at[self.keys[place] == found]
        doc = np.searchsorted(w.first, at, "right") - 1
        at = at[at + size <= w.first[doc + 1]]
        return at, s[at]


def _frequencies(texts: DataFrame, block: Block) -> dict[int, int]:
    """Documents that hold each shingle of the block: counted over all documents, one row for each shingle and task, then summed."""
    shared = texts.sparkSession.sparkContext.broadcast((block.keys, block.sizes))

    def count(batches):
        keys, sizes = shared.value
        probe, total = _Probe(keys), np.zeros(len(keys), np.int64)
        for b in batches:
            for _, _, w in _lowered(b.column(0)):
                h = w.hashes()
                for size in sizes:
                    at, s = probe.hits(w, h, size)
                    doc = np.searchsorted(w.first, at, "right") - 1
                    pairs = np.unique(np.stack([doc, np.searchsorted(probe.keys, s)], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
                    np.add.at(total, pairs[:, 1], 1)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(probe.keys[some].view(np.int64)), pa.array(total[some])], names=["k", "n"])

    rows = texts.select("text").mapInArrow(lean(count), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # bounded by the block's shingles
    return {r.k & (2**64 - 1): r.n for r in rows}


def _blocks(items: DataFrame, most: int):
    """Items in blocks of bounded bytes, read one after the other."""
    rows, size = [], 0
    for r in items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator():
        rows.append((r.item_id, r.text))
        size += 4 * len(r.text)
        if size > most:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Words of each document that item windows cover.

    docs: text and any other columns, which come back unchanged; items: item_id,
    text. Adds n_words, n_hit (words inside any occurrence of a window), items
    (array of the item_ids, as strings and sorted so, that have an occurring
    window), spans (array of maximal hit word ranges start, end). Columns of
    those names in docs are replaced. Words: A-Z lower-cased, then runs of
    letters a-z, digits and non-ASCII characters. Null, empty and wordless
    documents have no words; null, empty and wordless items have no window; an
    item without id hits words but is not listed. Repeated rows are treated
    alike. No items: nothing is hit.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    sc = docs.sparkSession.sparkContext
    added = ("n_words", "n_hit", "items", "spans")
    docs = docs.drop(*added)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    blocks = [Block(rows, window) for rows in _blocks(items, block_bytes)] or [Block([], window)]
    kinds = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
    place = docs.columns.index("text")

    def scan(block: Block):
        shared = sc.broadcast((block.windows, block.hashes, {k: sorted(x for x in v if x is not None) for k, v in block.items_of.items()}, block.prefixes(_frequencies(texts, block) if len(block.keys) else {}), block.sizes))

        def run(batches):
            windows, hashes, items_of, prefix, sizes = shared.value
            probe = _Probe(np.array(sorted(prefix), U))
            for b in batches:
                out = {k: [] for k in added}
                for lo, hi, w in _lowered(b.column(place)):
                    h = w.hashes()
                    cover = np.zeros(len(h) + 1, np.int32)
                    hit_items: dict[int, set[str]] = defaultdict(set)
                    for size in sizes:
                        at, s = probe.hits(w, h, size)
                        for p, key in zip(at.tolist(), s.tolist()):
                            d = int(np.searchsorted(w.first, p, "right")) - 1
                            for i, offset in prefix[key]:
                                a, z = p - offset, p - offset + len(hashes[i])
                                if min(SHINGLE, len(hashes[i])) != size or a < w.first[d] or z > w.first[d + 1] or not np.array_equal(h[a:z], hashes[i]):
                                    continue
                                if b" ".join(w.data[x:y].tobytes() for x, y in zip(w.start[a:z], w.end[a:z])) != windows[i]:
                                    continue
                                cover[a] += 1
                                cover[z] -= 1
                                hit_items[d].update(items_of[windows[i]])
                    hit = np.cumsum(cover[:-1]) > 0
                    total = np.concatenate(([0], np.cumsum(hit)))
                    counts = total[w.first[1:]] - total[w.first[:-1]]
                    out["n_words"] += w.count.tolist()
                    out["n_hit"] += counts.tolist()
                    out["items"] += [sorted(hit_items.get(d, ())) for d in range(hi - lo)]
                    out["spans"] += [_ranges(hit[w.first[d] : w.first[d + 1]]) if counts[d] else [] for d in range(hi - lo)]
                types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(out[k], t) for k, t in zip(added, types))], names=[*b.schema.names, *added])

        return run

    frame = docs.mapInArrow(scan(blocks[0]), _with(docs, kinds))
    # later blocks see the same rows with the answers so far: a narrow plan, no shuffle
    for block in blocks[1:]:
        kept = frame.withColumnsRenamed({k: f"__{k}" for k in added})
        again = kept.mapInArrow(lean(scan(block)), _with(kept, kinds))
        both = F.concat(F.flatten(F.transform("__spans", lambda s: F.sequence(s["start"], s["end"] - 1))), F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1))))
        hit = F.array_sort(F.array_distinct(both))
        starts = F.filter(hit, lambda x: ~F.array_contains(hit, x - 1))
        ends = F.filter(hit, lambda x: ~F.array_contains(hit, x + 1))
        frame = again.select(
            *docs.columns, "n_words", F.size(hit).cast("long").alias("n_hit"), F.array_sort(F.array_union("__items", "items")).alias("items"),
            F.zip_with(starts, ends, lambda a, z: F.struct(a.alias("start"), (z + 1).alias("end"))).alias("spans"),
        )
    return frame


def _with(frame: DataFrame, ddl: str) -> StructType:
    return StructType([*frame.schema.fields, *StructType.fromDDL(ddl).fields])


def _ranges(hit: np.ndarray) -> list[dict[str, int]]:
    turn = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": a, "end": z} for a, z in zip(turn[::2].tolist(), turn[1::2].tolist())]
