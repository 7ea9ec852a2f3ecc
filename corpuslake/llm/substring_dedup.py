"""Repeated passages across documents by seed and extend.

Seeds: winnowed anchors. Of the k-word shingles in every window of ``window``
words the one with the least hash (leftmost of equals) is an anchor, so equal
windows always share their anchor, and an anchor that only one document holds
rules out all windows that chose it. Anchors that several documents hold are
extended to both sides, to every window that chose them; an extension holds
where the whole window recurs. Overlapping and adjacent extended windows merge
into maximal repeats, none shorter than ``window`` words.

Texts never cross a shuffle: map tasks park them in the shared folder, and what
travels is one packed entry for each distinct anchor or window of a chunk
(its hash, smallest doc_id and whether several have it). A passage in a third
of all documents thus arrives at its reducer once for each chunk, not once for
each document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm import bytewords as bw
from corpuslake.llm import exchange as ex
from corpuslake.llm.lean import lean
from corpuslake.llm.workspace import filesystem, new_workspace, partitions_for, publish

SHINGLE = 5
CHUNK = 6 << 20
U = np.uint64
_TEXTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


class Chunk:
    """The windows of some documents and the anchors that they choose."""

    def __init__(self, ids: pa.Array, texts: pa.Array, window: int):
        k = min(SHINGLE, window)
        data, off = bw.buffers(texts)
        self.words = w = bw.Words(data, off, bw.SPACED)
        self.h = h = w.hashes()
        self.known = np.asarray(ids.is_valid())
        self.ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        self.doc = w.doc()
        n = len(h) - window + 1
        if n <= 0:
            self.starts = self.choice = self.anchor = np.zeros(0, np.int64)
            self.key = np.zeros(0, U)
            return
        g = bw.shingles(h, k)
        ok = bw.inside(w.first, window, len(h)) & self.known[self.doc[:n]]
        least, where = g[:n].copy(), np.zeros(n, np.int64)
        for o in range(1, window - k + 1):
            c = g[o : o + n]
            better = c < least
            np.copyto(least, c, where=better)
            where[better] = o
        self.starts = np.flatnonzero(ok)
        at = (np.arange(n) + where)[self.starts]
        new = np.diff(at, prepend=-1) != 0
        self.choice = np.cumsum(new) - 1
        self.anchor = at[new]
        self.key = bw.mix(g[self.anchor] ^ U(0x5851F42D4C957F2D))

    def window_keys(self, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes, of 64 and 32 bits, of the windows at starts."""
        if not len(starts):
            return np.zeros(0, U), np.zeros(0, np.uint32)
        one, two = bw.shingles(self.h, window), bw.shingles(self.h ^ U(0x2545F4914F6CDD1D), window, 0xDA942042E4DD58B5)
        return bw.mix(one[starts]), (two[starts] >> U(32)).astype(np.uint32)


def _unique(keys: list[np.ndarray], docs: np.ndarray):
    """Sorted unique keys (the first is most significant): order, group of each sorted row, group starts, least and greatest doc."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    at = np.flatnonzero(new)
    d = docs[order]
    low = np.minimum.reduceat(d, at) if len(at) else d
    high = np.maximum.reduceat(d, at) if len(at) else d
    return order, np.cumsum(new) - 1, at, low, high


def _emit(part: int, chunk: int, keys: list[np.ndarray], docs: np.ndarray, buckets: int):
    order, _, at, low, high = _unique(keys, docs)
    keys = [k[order][at] for k in keys]
    cuts = ex.cut(keys[0], buckets)
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        s = slice(int(cuts[b]), int(cuts[b + 1]))
        yield b, ex.message(ex.DATA, part, chunk, b, [np.diff(keys[0][s], prepend=U(0)), *(k[s] for k in keys[1:]), low[s], (high[s] != low[s]).astype(np.uint8)])


def _answer(batches, buckets: int, shared: bool):
    """For each message: indexes of its keys that several documents hold (shared), or that a smaller document holds than the sender knows."""
    for b, found in ex.gather(batches).items():
        data = [m for m in found if m[0] == ex.DATA]
        for kind, part, chunk, bucket, arrays in found:
            if kind == ex.FORWARD:
                yield part % buckets, ex.message(ex.FORWARD, part, chunk, bucket, arrays)
        if not data:
            continue
        keys = [np.concatenate([np.cumsum(m[4][0], dtype=U) for m in data])] + [np.concatenate([m[4][i] for m in data]) for i in range(1, len(data[0][4]) - 2)]
        low, many = (np.concatenate([m[4][i] for m in data]) for i in (-2, -1))
        order, group, at, least, most = _unique(keys, low)
        hit = np.zeros(len(low), bool)
        if shared:
            hit[order] = ((least != most) | np.maximum.reduceat(many[order], at).astype(bool))[group]
        else:
            hit[order] = least[group] < low[order]
        first = 0
        for _, part, chunk, bucket, arrays in data:
            n = len(arrays[0])
            yes = np.flatnonzero(hit[first : first + n]).astype(np.uint32)
            first += n
            if len(yes):
                yield part % buckets, ex.message(ex.DATA, part, chunk, bucket, [ex.gaps(yes)])


def _by_chunk(batches) -> dict:
    """Answers as part -> chunk -> [(bucket, indexes)], and what was forwarded as part -> chunk -> arrays."""
    hits: dict[int, dict[int, list]] = {}
    passed: dict[int, dict[int, list]] = {}
    for found in ex.gather(batches).values():
        for kind, part, chunk, bucket, arrays in found:
            if kind == ex.FORWARD:
                passed.setdefault(part, {})[chunk] = arrays
            else:
                hits.setdefault(part, {}).setdefault(chunk, []).append((bucket, np.cumsum(arrays[0], dtype=np.int64)))
    return {part: (chunks, hits.get(part, {})) for part, chunks in passed.items()}


def _parked(place: str, part: int):
    fs, path = filesystem(f"{place}/{part}.arrows")
    with fs.open_input_stream(path) as source, pa.ipc.open_stream(source) as stream:
        yield from enumerate(stream)


def repeated_windows(docs: DataFrame, window: int = 13) -> DataFrame:
    """Remove words that a window repeated from a smaller doc_id covers.

    docs: doc_id long, text string; other columns are ignored. Returns for each
    row doc_id, n_words, n_removed, text (kept words joined by one space),
    spans (array of removed maximal word ranges start, end). A null or wordless
    text has no words and an empty kept text. A row without doc_id takes no part:
    nothing is removed from it or on its account. Rows that repeat a doc_id do not
    count as smaller than each other. The input must be a scan or another plan
    whose partitions come out the same when a lost one is made again.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    spark = docs.sparkSession
    place = new_workspace(spark, "substrings")
    n = partitions_for(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def seed(batches):
        part = TaskContext.get().partitionId()
        emitted: list = []

        def write(sink):
            with pa.ipc.new_stream(sink, _TEXTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                number = 0
                for b in batches:
                    ids, text = b.column(0), b.column(1).cast(pa.string())
                    _, off = bw.buffers(text)
                    for lo, hi in bw.slices(off, CHUNK):
                        i, t = ids.slice(lo, hi - lo), text.slice(lo, hi - lo)
                        out.write_batch(pa.record_batch([i, t], schema=_TEXTS))
                        c = Chunk(i, t, window)
                        emitted.extend(_emit(part, number, [c.key], c.ids[c.doc[c.anchor]], n))
                        emitted.append((part % n, ex.message(ex.FORWARD, part, number, 0, [])))
                        number += 1

        publish(f"{place}/{part}.arrows", write)
        yield from ex.rows(emitted)

    def share(batches):
        yield from ex.rows(_answer(batches, n, True))

    def extend(batches):
        def out():
            for part, (_, hits) in _by_chunk(batches).items():
                for number, b in _parked(place, part):
                    c = Chunk(b.column(0), b.column(1), window)
                    order, group, at, *_ = _unique([c.key], c.ids[c.doc[c.anchor]])
                    cuts = ex.cut(c.key[order][at], n)
                    held = np.zeros(len(at), bool)
                    for bucket, indexes in hits.get(number, ()):
                        held[cuts[bucket] + indexes] = True
                    several = np.zeros(len(order), bool)
                    several[order] = held[group]
                    starts = c.starts[several[c.choice]]
                    yield from _emit(part, number, list(c.window_keys(starts, window)), c.ids[c.doc[starts]], n)
                    yield part % n, ex.message(ex.FORWARD, part, number, 0, [ex.gaps(starts.astype(np.uint32))])

        yield from ex.rows(out())

    def first(batches):
        yield from ex.rows(_answer(batches, n, False))

    def keep(batches):
        for part, (passed, hits) in _by_chunk(batches).items():
            for number, b in _parked(place, part):
                c = Chunk(b.column(0), b.column(1), window)
                starts = np.cumsum(passed[number][0].astype(np.int64))
                docs_at = c.ids[c.doc[starts]]
                keys = list(c.window_keys(starts, window))
                order, group, at, low, _ = _unique(keys, docs_at)
                smaller = np.zeros(len(at), bool)
                cuts = ex.cut(keys[0][order][at], n)
                for bucket, indexes in hits.get(number, ()):
                    smaller[cuts[bucket] + indexes] = True
                gone = np.zeros(len(starts), bool)
                gone[order] = smaller[group] | (docs_at[order] > low[group])
                yield _kept(b, c, starts[gone], window)

    seeds = texts.mapInArrow(lean(seed), ex.SCHEMA)
    shared = ex.route(seeds, n).mapInArrow(lean(share), ex.SCHEMA)
    windows = ex.route(shared, n).mapInArrow(lean(extend), ex.SCHEMA)
    repeats = ex.route(windows, n).mapInArrow(lean(first), ex.SCHEMA)
    return ex.route(repeats, n).mapInArrow(lean(keep), "doc_id long, n_words long, n_removed long, text string, spans array<struct<start:int,end:int>>")


def _kept(batch: pa.RecordBatch, c: Chunk, starts: np.ndarray, window: int) -> pa.RecordBatch:
    w = c.words
    total = len(w.start)
    cover = np.zeros(total + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    removed = np.cumsum(cover[:-1]) > 0
    lost = np.concatenate(([0], np.cumsum(removed)))
    n_removed = lost[w.first[1:]] - lost[w.first[:-1]]
    stay = np.flatnonzero(~removed)
    size = w.end[stay] - w.start[stay] + 1
    ends = np.cumsum(size)
    take = np.repeat(w.start[stay] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    flat = w.data[np.minimum(take, max(0, len(w.data) - 1))] if len(take) else np.zeros(0, np.uint8)
    flat[ends - 1] = 32
    through = np.concatenate(([0], ends))[np.searchsorted(stay, w.first)]
    flat_bytes = flat.tobytes()
    texts = [flat_bytes[a : max(a, b - 1)] for a, b in zip(through[:-1].tolist(), through[1:].tolist())]
    # maximal ranges: a removed word that follows a kept one or begins its document starts one
    turn = removed.copy()
    if total:
        turn[1:] &= ~removed[:-1] | (c.doc[1:] != c.doc[:-1])
        stop = removed.copy()
        stop[:-1] &= ~removed[1:] | (c.doc[1:] != c.doc[:-1])
    else:
        stop = removed
    a, z = np.flatnonzero(turn), np.flatnonzero(stop) + 1
    base = w.first[:-1][c.doc[a]] if len(a) else a
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(a, w.first).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array((a - base).astype(np.int32)), pa.array((z - base).astype(np.int32))], names=["start", "end"]),
    )
    return pa.record_batch(
        [batch.column(0), pa.array(w.count.astype(np.int64)), pa.array(n_removed.astype(np.int64)), pa.array(texts, pa.binary()).cast(pa.string()), spans],
        names=["doc_id", "n_words", "n_removed", "text", "spans"],
    )
