"""A packed shuffle: numpy columns travel as one binary row for each chunk and bucket.

A map task emits messages (bucket, payload); ``route`` deals them by bucket;
``gather`` reads a partition back. A message carries the map partition and chunk
that it came from, so that a reducer can answer with indexes into the sender's
own sorted unique keys. Keys are made unique in each chunk before they leave,
so a key that a third of all rows hold arrives once for each chunk at most.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

DATA, FORWARD = 0, 1
SCHEMA = "bucket int, payload binary"
U = np.uint64


def _turned(a: np.ndarray) -> np.ndarray:
    """``a.T``, copied a plane at a time."""
    out = np.empty(a.shape[::-1], np.uint8)
    if len(a) > len(out):
        for k in range(len(out)):
            out[k] = a[:, k]
    else:
        for k in range(len(a)):
            out[:, k] = a[k]
    return out


def message(kind: int, part: int, chunk: int, bucket: int, arrays: list[np.ndarray]) -> bytes:
    """Arrays go as byte planes, compressed: high bytes of small numbers cost nothing."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    out = [struct.pack("<qqqqq", kind, part, chunk, bucket, len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        body = squeeze(_turned(a.view(np.uint8).reshape(len(a), a.itemsize))) if len(a) else b""
        out += [struct.pack("<8sqq", a.dtype.str.encode(), len(a), len(body)), body]
    return b"".join(out)


def parse(payload: bytes) -> tuple[int, int, int, int, list[np.ndarray]]:
    kind, part, chunk, bucket, n = struct.unpack_from("<qqqqq", payload)
    at, arrays, expand = 40, [], zstandard.ZstdDecompressor().decompress
    for _ in range(n):
        name, count, size = struct.unpack_from("<8sqq", payload, at)
        at += 24
        dtype = np.dtype(name.rstrip(b"\0").decode())
        if count:
            planes = np.frombuffer(expand(payload[at : at + size]), np.uint8).reshape(dtype.itemsize, count)
            arrays.append(_turned(planes).view(dtype).reshape(count))
        else:
            arrays.append(np.zeros(0, dtype))
        at += size
    return kind, part, chunk, bucket, arrays


def rows(messages: Iterable[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Record batches of SCHEMA, of a few MB each."""
    keys, bodies, size = [], [], 0
    for bucket, payload in messages:
        keys.append(bucket)
        bodies.append(payload)
        size += len(payload)
        if size > 4 << 20:
            yield pa.record_batch([pa.array(keys, pa.int32()), pa.array(bodies, pa.binary())], names=["bucket", "payload"])
            keys, bodies, size = [], [], 0
    if keys:
        yield pa.record_batch([pa.array(keys, pa.int32()), pa.array(bodies, pa.binary())], names=["bucket", "payload"])


def route(df: DataFrame, n: int) -> DataFrame:
    """Deal messages to the partition that their bucket numbers."""
    return df.repartitionById(n, df["bucket"])


def gather(batches: Iterable[pa.RecordBatch]) -> dict[int, list]:
    """The messages of a partition by bucket."""
    found: dict[int, list] = defaultdict(list)
    for b in batches:
        for key, payload in zip(b.column(0).to_pylist(), b.column(1)):
            found[key].append(parse(payload.as_py()))
    return found


def bucket_edges(n: int) -> np.ndarray:
    """The first 64-bit key of each of n equal ranges."""
    return np.array([(i << 64) // n for i in range(n)], U)


def cut(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each bucket begins in sorted keys; one entry more than buckets."""
    return np.append(np.searchsorted(keys, bucket_edges(n)), len(keys))


def gaps(indexes: np.ndarray) -> np.ndarray:
    return np.diff(indexes, prepend=indexes.dtype.type(0)) if len(indexes) else indexes
