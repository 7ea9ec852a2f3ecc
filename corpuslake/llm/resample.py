"""Importance resampling of documents towards a target distribution of hashed word n-grams.

A streaming CRC ring turns a text into buckets in one scan: it keeps the running
zlib states of the last n word starts, extends each by a space and the next word,
and emits every state. The buckets of a document are parked beside its id in the
shared folder, so texts are read once and never cross a shuffle. Bucket counts of
the corpus and of the target give each bucket a gain; a document's weight is the
mean gain, Gumbel noise from its id makes a weighted draw without replacement, and
the highest scores are drawn. Ranks come from a range sort and the sizes of its
partitions, so that no task sees more than its range.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.lean import lean
from corpuslake.llm.workspace import materialise, new_workspace, partitions_for

#: Words of lower-cased text, in UTF-8 bytes: the non-ASCII characters are the bytes from 0x80 on.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_PLACE = (1 << 33) - 1


def ring_states(text: bytes, n: int) -> tuple[int, array]:
    """Words of a text and the CRC-32 of each run of 1 to n consecutive words, joined by a space."""
    crc, states, words = zlib.crc32, array("I"), 0
    ring: list[int] = []
    for found in WORD.finditer(text.lower()):
        word = found[0]
        if len(ring) == n:
            del ring[0]
        if ring:
            spaced = b" " + word
            ring = [crc(spaced, state) for state in ring]
        ring.append(crc(word))
        states.extend(ring)
        words += 1
    return words, states


def _bucket_type(buckets: int):
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def _scan(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, found: the buckets of all features as unsigned integers."""
    kind = _bucket_type(buckets)

    def run(batches):
        for b in batches:
            words, found = [], []
            for text in b.column(1):
                k, states = ring_states((text.as_py() or "").encode(), n)
                words.append(k)
                found.append((np.frombuffer(states, np.uint32) % np.uint32(buckets)).astype(kind).tobytes() if k else b"")
            yield pa.record_batch([b.column(0), pa.array(words, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "n_words", "found"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, found binary")


def _counts(parked: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket, over all documents; a task sends one row for each bucket."""
    kind = _bucket_type(buckets)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for found in b.column(0):
                total += np.bincount(np.frombuffer(found.as_py(), kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    rows = parked.select("found").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # a row for each bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousands of the log ratio of each bucket's smoothed shares in target and corpus, rounded down."""
    b, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = [(t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def _weights(parked: DataFrame, gain: np.ndarray) -> DataFrame:
    """parked with n_features and weight, the mean gain rounded down."""
    kind = _bucket_type(len(gain))

    def run(batches):
        for b in batches:
            features, weight = [], []
            for found in b.column(2):
                at = np.frombuffer(found.as_py(), kind)
                features.append(len(at))
                weight.append(int(gain[at].sum()) // len(at) if len(at) else 0)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(features, pa.int64()), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return parked.mapInArrow(lean(run), f"doc_id {dict(parked.dtypes)['doc_id']}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, least_words: int = 20, percent: int = 25, seed: str = "7") -> DataFrame:
    """docs (doc_id, text), target (text) -> doc_id, n_words, n_features, weight, score, rank of every document.

    Features are all runs of 1 to ``n`` consecutive words, repeats counted, in
    ``buckets`` buckets by CRC-32. Of the N documents of ``least_words`` words or
    more, floor(percent * N / 100) are drawn and ranked from 1 by falling score;
    ties go to the smaller doc_id (null first), then to fewer features. Others have
    no rank. A null or empty text has no words, no features and weight 0. A null
    doc_id counts as an empty id; rows that repeat a doc_id are drawn each, with
    the same noise. Other columns are ignored. Without documents there are no rows,
    without target texts all counts of the target are 0.
    """
    spark = docs.sparkSession
    place = new_workspace(spark, "resample")
    parked = materialise(_scan(docs, n, buckets), f"{place}/parked")
    wanted = materialise(_scan(target.select(F.lit(0).alias("doc_id"), "text"), n, buckets), f"{place}/target")
    gain = gains(_counts(parked, buckets), _counts(wanted, buckets))

    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = _weights(parked, gain).withColumn("score", F.col("weight") + noise).withColumn("fit", F.col("n_words") >= least_words)
    scored = materialise(scored, f"{place}/scored")
    # rows that are alike in all three may change places: the number of the row only splits a crowd of them
    keys = (F.desc("fit"), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"))
    split = scored.withColumn("row", F.monotonically_increasing_id())
    placed = split.repartitionByRange(partitions_for(scored), *keys, "row").sortWithinPartitions(*keys)
    placed = materialise(placed.drop("row").withColumn("place", F.monotonically_increasing_id()), f"{place}/placed")
    part = F.shiftright("place", 33).alias("part")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.count_if("fit").alias("fit"))
    drawn = (sizes.agg(F.sum("fit")).first()[0] or 0) * percent // 100
    # one row for each partition of the sort
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("before"))
    rank = F.col("before") + F.col("place").bitwiseAND(_PLACE) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("fit") & (rank <= drawn), rank).alias("rank"))
