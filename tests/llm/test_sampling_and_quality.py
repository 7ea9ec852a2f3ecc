"""Importance resampling and quality rules against plain Python."""

import collections
import hashlib
import math
import re
import struct
import zlib
from pathlib import Path

import pytest
import xxhash

from corpuslake.llm import quality, queries, resample

DATA = Path("/root/testdata/sf0.001")


def features(text, n=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain_resample(docs, target, buckets=10000, least=20, percent=25):
    corpus, wanted = collections.Counter(), collections.Counter()
    found = [(i, *features(t)) for i, t in docs]
    for _, _, f in found:
        corpus.update(x % buckets for x in f)
    for t in target:
        wanted.update(x % buckets for x in features(t)[1])
    s_all, t_all = sum(corpus.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((corpus[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, f in found:
        weight = sum(gain[x % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    drawn = percent * len(fit) // 100
    return sorted([(*r[:4], k + 1) for k, r in enumerate(fit[:drawn])] + [(*r[:4], None) for r in fit[drawn:]] + [(*r[:4], None) for r in rows if r[4] < least], key=repr)


def test_ring_states_are_the_checksums_of_joined_words():
    for text in ("", "one", "Über  den, 12 x\x00y", "a b c d e " * 50):
        for n in (1, 2, 3):
            words, states = resample.ring_states(text.encode(), n)
            assert (words, sorted(states)) == (features(text, n)[0], sorted(features(text, n)[1]))


def test_resample_equals_a_plain_one(spark):
    filler = [f"word{i % 7} other{i % 11} " * (i % 30) for i in range(90)]
    docs = [*enumerate(filler), (None, "a b " * 20), (None, None), (7, filler[29]), (7, filler[29]), (500, ""), (501, "x y " * 60000), (502, "É ß " * 30)]
    target = ["word1 other1 word2 other2 " * 9, None, ""]
    rows = spark.createDataFrame([(i, t, 0, 0, 0.5) for i, t in docs], "doc_id long, text string, rank int, place int, score double").repartition(5)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in resample.resample(rows, items).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=repr) == plain_resample(docs, target)
    assert resample.resample(rows.limit(0), items).count() == 0
    few = [(i, t) for i, t in docs if i is not None and i < 50]
    got = [tuple(r) for r in resample.resample(rows.where("doc_id < 50"), items.limit(0)).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=repr) == plain_resample(few, [])


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_op12_equals_a_plain_one(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = [tuple(r) for r in queries.op12_resample(spark, str(DATA)).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=repr) == plain_resample(docs, target)


# ------------------------------------------------------------ quality


def plain_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    repeated = {i + j for starts in at.values() if len(starts) > 1 for i in starts for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), n < 20 or 100 * len(repeated) > 30 * n


def xx(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed)


def plain_quality(docs, labels):
    """(id, weight, kept) by dictionaries."""
    pair = lambda a, b: xx(struct.pack("<Q", b), xx(struct.pack("<Q", a)))
    of = {}
    for i, q, t in labels:
        if i is not None:
            of.setdefault(i, []).append((q, t))
    half = {i: xx(str(i).encode()) >> 1 & 1 for i, v in of.items() if min(x[0] for x in v) == 1 and max(x[1] or 0 for x in v) == 0}
    raw, good, rows = collections.Counter(), collections.Counter(), []
    for i, t in docs:
        h = [xx(x.encode()) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        f = [x % quality.BUCKETS for x in h + [pair(a, b) for a, b in zip(h, h[1:])]]
        raw.update(f)
        if half.get(i) == 0:
            good.update(f)
        rows.append((i, f, plain_base(t)[5]))
    s_all, t_all, b = sum(raw.values()), sum(good.values()), quality.BUCKETS
    if not t_all:
        return [(i, None, not failed) for i, _, failed in rows], None
    gain = lambda x: math.floor(1000 * math.log((good[x] + 1) * (s_all + b) / ((raw[x] + 1) * (t_all + b))))
    weights = [(i, sum(map(gain, f)) // len(f) if f else None, failed) for i, f, failed in rows]
    unseen = sorted(w for i, w, failed in weights if half.get(i) == 1 and not failed)
    if not unseen:
        return [(i, w, not failed) for i, w, failed in weights], None

    def at(q):
        x = q * (len(unseen) - 1)
        lo = math.floor(x)
        return unseen[lo] + (x - lo) * (unseen[min(lo + 1, len(unseen) - 1)] - unseen[lo])

    limit = math.floor(2 * at(0.01) - at(0.5))
    return [(i, w, not failed and (w is None or w >= limit)) for i, w, failed in weights], limit


BASE = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"


def check_quality(spark, docs, labels):
    rows = spark.createDataFrame([(i, t, 1, 0.5, "x") for i, t in docs], "doc_id long, text string, quality int, half double, h string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    got = quality.scan(rows, marks).collect()
    text = sorted(((i, *plain_base(t)) for i, t in docs), key=repr)
    assert sorted(((r.doc_id, *(r[c] for c in BASE)) for r in got), key=repr) == text
    plain, limit = plain_quality(docs, labels)
    assert sorted(((r.doc_id, r.weight, r.kept) for r in got), key=repr) == sorted(plain, key=repr)
    assert not got or got[0].limit == limit


def test_quality_edge_cases_equal_plain_ones(spark):
    clean = [(i, " ".join(f"w{(i * 7 + j * j) % 40}" for j in range(30 + i))) for i in range(40)]
    junk = [(100 + i, " ".join(f"z{i}{j}%%%" for j in range(40))) for i in range(5)]
    odd = [(None, None), (200, ""), (201, " \t\n"), (202, "a b c d e f g h " * 3 + "x"), (203, "line one\nline one\n\n \nline one\r\n"), (204, "é#ß | 日本 <x> & 100%"), (205, "same " * 9), (206, "one two three four five six seven eight nine " * 9000), (207, "\x0b a\x1cb\x85c d \x0c")]
    repeated = [(3, clean[3][1]), (3, clean[3][1])]
    check_quality(spark, clean + junk + odd + repeated, [(i, 1, 0) for i in range(30)] + [(100, 0, 0), (31, 1, 1), (None, 1, 0), (5, 0, 0), (6, 1, None), (6, 1, 0)])
    check_quality(spark, clean[:4] + odd, [])
    check_quality(spark, clean[:4], [(0, 1, 0)])
    check_quality(spark, [], [(0, 1, 0)])


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_op13_equals_a_plain_one_and_keeps_clean_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = queries.op13_quality(spark, str(DATA)).collect()
    plain, _ = plain_quality(docs, labels)
    assert sorted((r.doc_id, r.weight, r.kept) for r in got) == sorted(plain)
    assert sorted((r.doc_id, *(r[c] for c in BASE)) for r in got) == sorted((i, *plain_base(t)) for i, t in docs)
    clean = {i for i, q, t in labels if q == 1 and t == 0}
    held = [r for r in got if r.doc_id in clean and not r.base_failed]
    assert sum(r.kept for r in held) >= 0.99 * len(held)


def test_all_trusted_documents_count_however_many_labels_there_are(spark):
    signed = lambda i: (xx(str(i).encode()) ^ 1 << 63) - (1 << 63)
    late = sorted(range(60_000), key=signed)[-40:]
    docs = [(i, " ".join(f"w{(i * k) % 97}" for k in range(1, 30))) for i in late] + [(-1, "x y z " * 20)]
    check_quality(spark, docs, [(i, 1, 0) for i in range(60_000)])


def test_only_texts_that_may_be_trusted_are_shuffled_for_the_counts(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20_000)] + [(None, "no id")], "doc_id long, t string")
    ids = spark.range(0, 20_000, 5).withColumnRenamed("id", "doc_id")
    ids = ids.where(quality._half(quality._hash_of_id()) == 0)
    wanted = {r.doc_id for r in ids.collect()}
    left = [r.doc_id for r in quality._likely(docs, ids).collect()]
    assert wanted <= set(left) and len(left) < 1.05 * len(wanted)
    none = quality._likely(docs, ids.limit(0))
    assert none.count() == 0
    names = ids.select(quality.F.format_string("%06d", "doc_id").alias("doc_id"))  # 000005 and 5 are one number
    assert quality._likely(docs, names).count() == docs.count()
