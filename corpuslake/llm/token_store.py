"""Token-id files with Elias-Fano document boundaries.

A store is a folder of shards in ascending doc_id order. A shard is

    8 bytes  magic ``CLTOK1\\0\\0``
    7 x u64  documents, ids, bytes of an id, sizes of the three sections below, and
             how many documents, the first ones, have no doc_id
    section  doc_ids of the others, Elias-Fano (less the smallest)
    section  ends: for each document the ids up to its end, Elias-Fano
    section  ids, little-endian, of the stated width

An Elias-Fano section is ``n, low bits, base`` (3 x i64), the low bits packed,
the high bits as a unary bit vector and one u32 count for each 512 of its bits,
from which ``select`` finds any entry: about 2 + log2(universe / n) bits for an
entry, instead of 64.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.lean import lean
from corpuslake.llm.tokens import encoder
from corpuslake.llm.workspace import filesystem, materialise, new_workspace, partitions_for, publish

MAGIC = b"CLTOK1\0\0"
SUPER = 512


class EliasFano:
    """A non-decreasing sequence of integers."""

    def __init__(self, n: int, low_bits: int, base: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bits, self.base, self.low, self.high, self.ranks = n, low_bits, base, low, high, ranks

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        base = int(values[0])
        v = values.astype(np.uint64) - np.uint64(base & (2**64 - 1))
        low_bits = max(0, (max(1, int(v[-1])) // n).bit_length() - 1)
        fields = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(fields.astype(np.uint8).ravel(), bitorder="little")
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(at[-1]) // SUPER + 1) * SUPER, np.uint8)
        bits[at] = 1
        ranks = np.concatenate(([0], np.cumsum(bits.reshape(-1, SUPER).sum(axis=1, dtype=np.int64))))[:-1].astype(np.uint32)
        return cls(n, low_bits, base, low, np.packbits(bits, bitorder="little"), ranks)

    def to_bytes(self) -> bytes:
        return struct.pack("<qqqqq", self.n, self.low_bits, self.base, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.ranks.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, base, a, b = struct.unpack_from("<qqqqq", raw)
        body = np.frombuffer(raw, np.uint8, offset=40)
        return cls(n, low_bits, base, body[:a], body[a : a + b], body[a + b :].view("<u4"))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bit = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bit.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def select(self, i: int) -> int:
        """Entry i, from the counts and one superblock."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.ranks, i, "right")) - 1
        bits = np.unpackbits(self.high[block * SUPER // 8 : (block + 1) * SUPER // 8], bitorder="little")
        at = block * SUPER + int(np.flatnonzero(bits)[i - int(self.ranks[block])])
        return self.base + ((at - i) << self.low_bits) + int(self._lows(np.array([i]))[0])

    def all(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        i = np.arange(self.n)
        return self.base + ((at - i) << self.low_bits) + self._lows(i)


def _shard(nameless: int, doc_ids: np.ndarray, lengths: np.ndarray, ids: bytes, width: int):
    keys = EliasFano.encode(doc_ids).to_bytes()
    ends = EliasFano.encode(np.cumsum(lengths)).to_bytes()
    yield MAGIC + struct.pack("<7Q", len(lengths), len(ids) // width, width, len(keys), len(ends), len(ids), nameless)
    yield keys
    yield ends
    yield ids


class Shard:
    """One shard, read from an open pyarrow file."""

    def __init__(self, file):
        head = file.read(64)
        if head[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.n, self.total, self.width, a, b, c, self.nameless = struct.unpack_from("<7Q", head, 8)
        self.file, self.first = file, 64 + a + b
        self.doc_ids = EliasFano.from_bytes(file.read(a))
        self.ends = EliasFano.from_bytes(file.read(b))

    def ids(self, start: int, end: int) -> np.ndarray:
        self.file.seek(self.first + start * self.width)
        return np.frombuffer(self.file.read((end - start) * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        """The ids of document i, by two selects."""
        return self.ids(self.ends.select(i - 1) if i else 0, self.ends.select(i))


def write_store(docs: DataFrame, tokenizer: str, end_id: int, uri: str) -> DataFrame:
    """Write docs (doc_id, text) as a store below ``uri``; returns its manifest (shard, path, n_docs, n_ids).

    Ascending doc_id; rows that repeat a doc_id follow each other by the hash of
    their text. Null text counts as empty; every document ends with ``end_id``.
    Rows without doc_id come first. Other columns are ignored. Shards are files of their own, replaced whole if a task is run again.
    """
    n = partitions_for(docs)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(n, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
    )

    def run(batches):
        shard = TaskContext.get().partitionId()
        enc = encoder(tokenizer, uri)
        width = 2 if max(enc.size, end_id + 1) <= 1 << 16 else 4
        keys, lengths, parts, nameless = [], [], [], 0
        for b in batches:
            nameless += b.column(0).null_count
            keys.append(np.asarray(b.column(0).drop_null()).astype(np.int64))
            for _, _, ids, bounds in enc.column(b.column(1), end_id):
                lengths += np.diff(bounds).tolist()
                parts.append(ids.astype(f"<u{width}").tobytes())
        if not lengths:
            return
        path = f"{uri}/shard-{shard:06d}.tok"
        publish(path, lambda sink: [sink.write(x) for x in _shard(nameless, np.concatenate(keys), np.array(lengths), b"".join(parts), width)])
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([path]), pa.array([len(lengths)]), pa.array([sum(lengths)])], names=["shard", "path", "n_docs", "n_ids"])

    return materialise(ordered.mapInArrow(lean(run), "shard int, path string, n_docs long, n_ids long"), f"{uri}/manifest")


def read_store(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary as little-endian uint32) of each document, from the shards.

    start counts the ids of all documents before it in the store. The manifest's
    rows, one for each shard, are summed on the driver.
    """
    shards = sorted(manifest.collect(), key=lambda r: r.shard)
    base, rows = 0, []
    for r in shards:
        rows.append((r.path, base))
        base += r.n_ids
    spark = manifest.sparkSession
    jobs = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))

    def run(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, at = filesystem(path)
                with fs.open_input_file(at) as f:
                    s = Shard(f)
                    ids, ends = pa.concat_arrays([pa.nulls(s.nameless, pa.int64()), pa.array(s.doc_ids.all().astype(np.int64))]), s.ends.all()
                    starts = np.concatenate(([0], ends[:-1]))
                    for lo in range(0, s.n, 1024):
                        a, z = int(starts[lo]), int(ends[min(lo + 1024, s.n) - 1])
                        flat = s.ids(a, z).astype("<u4").tobytes()
                        body = [flat[4 * (x - a) : 4 * (y - a)] for x, y in zip(starts[lo : lo + 1024].tolist(), ends[lo : lo + 1024].tolist())]
                        part = slice(lo, lo + 1024)
                        yield pa.record_batch([ids[part], pa.array(starts[part] + base), pa.array(ends[part] - starts[part]), pa.array(body, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return jobs.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids binary")


def store(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write a store in the shared folder and read it back."""
    return read_store(write_store(docs, tokenizer, end_id, new_workspace(docs.sparkSession, "tokens")))


