"""WARC archives and their capture index, merged externally.

Writers take locally sorted captures (URL key, timestamp, id) and leave an
archive of gzip members and a run: an index file in the same order. Runs are
merged by loser trees. While there are more than ``FAN_IN`` runs, groups of that
many become longer runs; the last pass merges by key ranges, so that any number
of tasks share it, each with one buffered block for each run. Ranges are cut on
the whole key (URL key, timestamp, id): a URL with a third of all captures is
shared by many of them. The result is one globally ordered capture history.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.lean import lean
from corpuslake.llm.workspace import filesystem, materialise, new_workspace, partitions_for, publish

FAN_IN = 128
BLOCK_ROWS = 2048
SAMPLES = 8
NO_ID = 2**63 - 1
RUN = pa.schema([("url_key", pa.string()), ("ts", pa.string()), ("id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
HISTORY = "range int, position long, url_key string, ts string, id long, file string, offset long, length long"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Sort-friendly key: host labels reversed, lower-cased, without scheme, user, default port, ``www`` and fragment; null is empty."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"(?s)#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(80|443)?$", ""), r"^www\d*\.", "")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


# ---------------------------------------------------------------- records


def _safe(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(name: str, url: str | None, ts: str, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit that refers to the response with an equal one."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {ts[:4]}-{ts[4:6]}-{ts[6:8]}T{ts[8:10]}:{ts[10:12]}:{ts[12:14]}Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(member: bytes) -> dict:
    """The record in a gzip member; a response whose payload does not match its digest raises."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers = fields.get("WARC-Refers-To")
    return {"type": fields["WARC-Type"], "size": size, "digest": digest, "payload": payload, "refers_to": int(refers[len("<urn:page:") : -1]) if refers else None}


# ---------------------------------------------------------------- loser tree


class LoserTree:
    """Merges sorted iterators: each pop replays one path of log2(k) comparisons."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources, self.k = sources, len(sources)
        self.head = [next(s, None) for s in sources]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, i: int) -> None:
        """Send source i up; the loser of each match stays in its node."""
        node = (i + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = i
                return
            if self._before(self.tree[node], i):
                i, self.tree[node] = self.tree[node], i
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k:
            i = self.tree[0]
            if self.head[i] is None:
                return
            yield self.head[i]
            self.head[i] = next(self.sources[i], None)
            self._play(i)


def _rows(uri: str, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """The rows of a run from low up to high, a block at a time."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        file = pq.ParquetFile(f)
        for g in range(file.num_row_groups):
            stats = file.metadata.row_group(g).column(0).statistics
            if stats is not None and stats.has_min_max and ((high is not None and stats.min > high[0]) or (low is not None and stats.max < low[0])):
                continue
            t = file.read_row_group(g)
            for row in zip(*(t.column(c).to_pylist() for c in RUN.names)):
                if high is not None and row[:3] >= high:
                    return
                if low is None or row[:3] >= low:
                    yield row


def _write_run(uri: str, rows: Iterator[tuple]) -> tuple[int, list[tuple]]:
    """A run file of rows already in order; returns its size and evenly spaced keys."""
    count, keys = 0, []

    def write(sink):
        nonlocal count
        with pq.ParquetWriter(sink, RUN) as out:
            block: list[tuple] = []

            def flush():
                nonlocal count
                keys.extend(r[:3] for r in block[:: max(1, BLOCK_ROWS // SAMPLES)])
                count += len(block)
                out.write_table(pa.table([pa.array(x, t) for x, t in zip(zip(*block), RUN.types)], schema=RUN))
                block.clear()

            for row in rows:
                block.append(row)
                if len(block) == BLOCK_ROWS:
                    flush()
            if block:
                flush()

    publish(uri, write)
    step = max(1, len(keys) // SAMPLES)
    return count, keys[::step]


_MANIFEST = "run string, n long, keys array<struct<url_key:string,ts:string,id:long>>"


def _manifest(uri: str, n: int, keys: list[tuple]) -> pa.RecordBatch:
    key = pa.struct([("url_key", pa.string()), ("ts", pa.string()), ("id", pa.int64())])
    return pa.record_batch([pa.array([uri]), pa.array([n], pa.int64()), pa.array([[dict(zip(("url_key", "ts", "id"), k)) for k in keys]], pa.list_(key))], names=["run", "n", "keys"])


# ---------------------------------------------------------------- operators


def write_archives(pages: DataFrame, uri: str, min_bytes: int = 0) -> DataFrame:
    """Archives and runs of pages (id long, url, ts 'yyyyMMddHHmmss', payload string) below ``uri``; returns the manifest of runs.

    Of records with equal payloads of at least ``min_bytes`` UTF-8 bytes the one
    with the smallest id is a response, the others revisit it; those that repeat
    that id are responses too, and so is every record where no equal one has an
    id. A null payload is empty, a null url has no target, a null ts is the epoch.
    """
    body = F.coalesce(F.col("payload").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.coalesce("ts", F.lit("19700101000000")).alias("ts"),
        body.alias("payload"), F.sha1(body.cast("binary")).alias("sha"), url_key(F.col("url").cast("string")).alias("url_key"),
    )
    owners = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "owner")
    same = F.col("id").eqNullSafe(F.col("owner")) | (F.octet_length("payload") < min_bytes)
    sized = rows.join(owners, "sha", "left").withColumn("refers_to", F.when(~same, F.col("owner")))
    sorted_runs = sized.select("url_key", "ts", F.coalesce("id", F.lit(NO_ID)).alias("key_id"), "id", "url", "payload", "refers_to", "sha").sortWithinPartitions("url_key", "ts", "key_id", "sha")

    def run(batches):
        part = TaskContext.get().partitionId()
        path, done = f"{uri}/archive-{part:06d}.warc.gz", []

        def index(sink):
            at = number = 0
            for b in batches:
                for key, ts, key_id, own, url, payload, refers in zip(*(b.column(i).to_pylist() for i in range(7))):
                    member = record(str(own) if own is not None else f"none-{part}-{number}", url, ts, payload.encode(), refers)
                    sink.write(member)
                    yield key, ts, key_id, path, at, len(member)
                    at += len(member)
                    number += 1

        def write(sink):
            done.append(_write_run(f"{uri}/run-{part:06d}.parquet", index(sink)))

        publish(path, write)
        n, keys = done[0]
        if n:
            yield _manifest(f"{uri}/run-{part:06d}.parquet", n, keys)

    return materialise(sorted_runs.mapInArrow(lean(run), _MANIFEST), f"{uri}/manifest")


def merge_runs(manifest: DataFrame, uri: str, ranges: int, fan_in: int = FAN_IN) -> DataFrame:
    """The globally ordered capture history of all runs, by (range, position)."""
    spark = manifest.sparkSession
    runs = [r.asDict(recursive=True) for r in manifest.collect()]  # a row for each run: name, size, a few keys
    level = 0
    while len(runs) > fan_in:
        level += 1
        groups = [(i, [r["run"] for r in runs[i : i + fan_in]]) for i in range(0, len(runs), fan_in)]

        def merge(batches, level=level):
            for b in batches:
                for i, names in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    out = f"{uri}/level-{level}/run-{i:06d}.parquet"
                    yield _manifest(out, *_write_run(out, iter(LoserTree([_rows(x, None, None) for x in names]))))

        jobs = spark.createDataFrame(groups, "i int, names array<string>").repartition(len(groups))
        runs = [r.asDict(recursive=True) for r in materialise(jobs.mapInArrow(lean(merge), _MANIFEST), f"{uri}/level-{level}/manifest").collect()]
    names = [r["run"] for r in runs]
    weighed = sorted(((k["url_key"], k["ts"], k["id"]), r["n"] / len(r["keys"])) for r in runs for k in r["keys"])
    total, cuts, sums = sum(w for _, w in weighed), [], []
    for _, w in weighed:
        sums.append((sums[-1] if sums else 0.0) + w)
    for i in range(1, ranges):
        cut = weighed[min(len(weighed) - 1, bisect.bisect_left(sums, total * i / ranges))][0] if weighed else None
        if cut is not None and (not cuts or cut > cuts[-1]):
            cuts.append(cut)
    shared = spark.sparkContext.broadcast((names, cuts))  # at most ``fan_in`` names and one key for each range

    def last(batches):
        names, cuts = shared.value
        for b in batches:
            for r in b.column(0).to_pylist():
                low, high = cuts[r - 1] if r else None, cuts[r] if r < len(cuts) else None
                block, position = [], 0
                for row in LoserTree([_rows(x, low, high) for x in names]):
                    block.append((r, position, *row[:2], None if row[2] == NO_ID else row[2], *row[3:]))
                    position += 1
                    if len(block) == BLOCK_ROWS:
                        yield _history(block)
                        block = []
                if block:
                    yield _history(block)

    jobs = spark.range(len(cuts) + 1).select(F.col("id").cast("int").alias("bucket"))
    return jobs.repartitionById(len(cuts) + 1, "bucket").mapInArrow(lean(last), HISTORY)


def _history(block: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), *RUN.types]
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*block), types)], names=["range", "position", *RUN.names])


def read_archives(history: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that a history points to, each archive read once and in order of its offsets.

    Adds payload_bytes, payload_digest, record_type, refers_to, and payload
    (binary; null unless asked for, and for revisits). Responses are checked
    against their digests.
    """
    n = partitions_for(history)

    def run(batches):
        names = ["payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        handle, opened = None, None
        for b in batches:
            out: list[list] = [[] for _ in names]
            for file, offset, length in zip(*(b.column(i).to_pylist() for i in (5, 6, 7))):
                if file != opened:
                    if handle:
                        handle.close()
                    fs, path = filesystem(file)
                    handle, opened = fs.open_input_file(path), file
                r = parse(handle.read_at(length, offset))
                for column, value in zip(out, (r["size"], r["digest"], r["type"], r["refers_to"], r["payload"] if with_payload and r["type"] == "response" else None)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, t) for x, t in zip(out, types))], names=[*b.schema.names, *names])
        if handle:
            handle.close()

    grouped = history.repartition(n, "file", F.floor(F.col("offset") / (32 << 20))).sortWithinPartitions("file", "offset")
    return grouped.mapInArrow(lean(run), HISTORY + ", payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def capture_history(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives of pages (id, url, ts, payload) in the shared folder, merge their runs, and read every record back.

    One row for each page, repeated ids included; extra columns are ignored and
    no pages give no rows.
    """
    uri = f"{new_workspace(pages.sparkSession, 'warc')}/{uuid.uuid4().hex[:8]}"
    manifest = write_archives(pages, uri, min_bytes)
    return read_archives(merge_runs(manifest, uri, partitions_for(pages)))
