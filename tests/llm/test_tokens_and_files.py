"""Tokenisation, token store, packing and WARC archives: exact round trips."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.llm import packing, queries, token_store, tokens, warc
from corpuslake.llm.lean import release
from corpuslake.llm.tokens import Encoder
from corpuslake.llm.workspace import filesystem, new_workspace

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def reference(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path(name))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_encoder_equals_the_library(name):
    r = random.Random(4)
    parts = [*"abcXYZ'’.,!-_09  ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "é", "É", "ß", "İ", "ñ", "Σ", "中文", "é", "²", "µ", "×", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "😀", " ", "\x1c"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(20000)] + ["", " ", "a ", " a", "\n"]
    e = Encoder(queries.tokenizer_path(name))
    got = [np.frombuffer(x, "<u4").tolist() for i in range(0, len(texts), 301) for x in e.encode(texts[i : i + 301])]
    assert got == reference(name, texts)


@pytest.mark.parametrize("name", [WORD, "byte_bpe_50k.json"])
def test_encoder_learns_runs_and_not_their_combinations(name):
    words = [f"{a}{b}ing" for a in ("tal", "wal", "lÉ", "ço") for b in "klmnrst"]
    texts = [" ".join(f"{w}{mark}{v}" for v in words for mark in (",", ".\n", "-12")) for w in words]
    e = Encoder(queries.tokenizer_path(name))
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == reference(name, texts)
    assert len(e.keys) <= 2 * (len(words) + 3)  # of 2352 pieces


def test_encoder_learns_words_that_differ_in_case_once():
    words = [f"{a}{b}ing" for a in ("tal", "wal", "gaé") for b in "klmnrst"]
    texts = [f"{w.capitalize()} {w} x{w}'S J\u030c{w} {w.upper() if w.isascii() else w}" for w in words]
    e = Encoder(queries.tokenizer_path(WORD))
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == reference(WORD, texts)
    assert len(e.keys) <= 3 * len(words) + 2  # a word, and two pieces that an apostrophe and a mark keep as they are


def test_encoder_keeps_its_memo_within_a_job_alone():
    path = queries.tokenizer_path(WORD)

    def task(job, text):
        e = tokens.encoder(path, job)
        known = len(e.keys)
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == reference(WORD, [text])[0]
        release()
        return known

    assert [task("a", "one two"), task("a", "two three"), task("b", "one two"), task(None, "one"), task(None, "one")] == [0, 2, 0, 0, 0]


def test_elias_fano_round_trip_and_space():
    r = np.random.default_rng(1)
    for values in ([], [5], [0, 0, 0], [-7, -7, 3, 10**12], np.sort(r.integers(0, 10**7, 5000)), np.arange(2000)):
        v = np.array(values, np.int64)
        e = token_store.EliasFano.from_bytes(token_store.EliasFano.encode(v).to_bytes())
        assert e.all().tolist() == v.tolist()
        assert [e.select(i) for i in range(0, len(v), 37)] == v[::37].tolist()
    ends = np.cumsum(r.integers(1, 2000, 20000))
    assert len(token_store.EliasFano.encode(ends).to_bytes()) < 2 * len(ends)
    with pytest.raises(IndexError):
        token_store.EliasFano.encode(np.array([1])).select(1)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string").repartition(3)


def test_token_store_round_trip(spark):
    r = random.Random(8)
    rows = [(i * 3 - 30, " ".join(r.choice(["the", "naïve", "x1", "Ünder"]) for _ in range(r.randint(0, 40)))) for i in range(60)]
    rows += [(500, None), (501, ""), (3, "twin"), (502, "long " * 30000)]
    got = token_store.store(docs(spark, rows), queries.tokenizer_path(WORD), 1).orderBy("start").collect()
    assert [x.doc_id for x in got] == sorted(i for i, _ in rows)
    assert [x.start for x in got] == np.concatenate(([0], np.cumsum([x.n_tokens for x in got])[:-1])).tolist()
    ids = dict(zip([i for i, _ in rows], reference(WORD, [t or "" for _, t in rows])))
    for x in got:
        if x.doc_id != 3:
            assert np.frombuffer(x.ids, "<u4").tolist() == ids[x.doc_id] + [1]
    assert token_store.store(docs(spark, [(None, "a"), (1, "b")]), queries.tokenizer_path(WORD), 1).orderBy("start").select("doc_id").collect()[0].doc_id is None
    assert token_store.store(docs(spark, []), queries.tokenizer_path(WORD), 1).count() == 0
    manifest = token_store.write_store(docs(spark, rows[:20]), queries.tokenizer_path(WORD), 1, new_workspace(spark, "t")).collect()
    fs, path = filesystem(manifest[0].path)
    with fs.open_input_file(path) as f:
        s = token_store.Shard(f)
        assert s.document(0).tolist() == ids[s.doc_ids.select(0)] + [1]


def check_packing(rows, got, capacity, end):
    pieces, bins = defaultdict(list), defaultdict(list)
    for x in got:
        pieces[x.doc_id].append(x)
        bins[x.sequence_id].append((x.offset, x.length))
    for fill in bins.values():
        at = 0
        for offset, length in sorted(fill):
            assert offset == at
            at += length
        assert at <= capacity
    ids = reference(BYTE, [t or "" for _, t in rows])
    for (i, _), x in zip(rows, ids):
        x = [*x, end]
        mine = sorted(pieces[i], key=lambda p: p.piece)
        if len({k for k, _ in rows}) == len(rows):
            assert [p.start for p in mine] == np.concatenate(([0], np.cumsum([p.length for p in mine])[:-1])).tolist()
            assert sum(p.length for p in mine) == len(x)
            assert all(p.length == capacity for p in mine[1:])
            assert all(p.ids_crc32 == zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) for p in mine)
    return len(bins)


def test_packing_places_every_piece(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["the", "of", "x"]) for _ in range(r.choice([1, 3, 9, 20, 31, 70, 200])))) for i in range(150)]
    rows += [(900, None), (901, ""), (None, "no id")]
    got = packing.pack(docs(spark, rows), queries.tokenizer_path(BYTE), 0, 32).collect()
    n = check_packing(rows, got, 32, 0)
    assert n <= -(-sum(x.length for x in got) // 32) + 1
    with_ids = packing.pack(docs(spark, rows[:3]), queries.tokenizer_path(BYTE), 0, 32, keep_ids=True).collect()
    assert all(zlib.crc32(x.ids) == x.ids_crc32 for x in with_ids)
    assert packing.pack(docs(spark, []), queries.tokenizer_path(BYTE), 0, 32).count() == 0


def test_local_search_empties_bins():
    """Lengths for which best-fit decreasing is not best: the search must find the bound."""
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 2}  # sum 40: four bins of 10
    groups = packing.best_fit(counts, 10)
    better = packing.improve(groups, 10)
    assert sum(n for _, n in better) <= sum(n for _, n in groups)
    r = random.Random(9)
    for _ in range(30):
        counts = Counter(r.randint(1, 60) for _ in range(80))
        before = packing.best_fit(counts, 100)
        after = packing.improve(before, 100)
        total = Counter()
        for p, n in after:
            assert sum(k * c for k, c in p.items()) <= 100
            for k, c in p.items():
                total[k] += c * n
        assert total == counts and sum(n for _, n in after) <= sum(n for _, n in before)
        squares = lambda g: sum(n * sum(k * c for k, c in p.items()) ** 2 for p, n in g)
        assert squares(after) >= squares(before)
        packing.plan(counts, 100)


def test_loser_tree_merges():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((r.randint(0, 9), i, j) for j in range(r.randint(0, 8))) for i in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(x for run in runs for x in run)


def test_warc_records_and_revisits(spark):
    html = ["<p>a</p>", "", None, "é\r\n\r\nx", "<p>a</p>", "", "<p>a</p>", "WARC/1.1\r\n" * 1000]
    rows = [(10 - i, f"http://www.B.a:80/{i % 3}#f" if i != 2 else None, "20240101000000", h, 1) for i, h in enumerate(html)]
    rows += [(None, "x y\r\nz", None, "<p>a</p>", 1), (3, "http://a.b/", "20240101000000", "twin", 1), (3, "http://a.b/", "20240101000000", "twin", 1)]
    pages = spark.createDataFrame(rows, "id long, url string, ts string, payload string, offset int").repartition(3)
    for least in (0, 5):
        got = warc.capture_history(pages, least).collect()
        assert len(got) == len(rows)
        owner = {}
        for i, _, _, h, _ in rows:
            if i is not None:
                owner[h or ""] = min(i, owner.get(h or "", i))
        want = []
        for i, _, _, h, _ in rows:
            p = (h or "").encode()
            refers = owner.get(h or "") if i != owner.get(h or "") and len(p) >= least else None
            want.append((i, len(p), warc.digest_of(p), "response" if refers is None else "revisit", refers))
        assert sorted(((x.id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got), key=str) == sorted(want, key=str)
        keys = [x.url_key for x in sorted(got, key=lambda x: (x.range, x.position))]
        assert keys == sorted(keys)
    assert warc.capture_history(pages.limit(0)).count() == 0


def test_runs_merge_in_several_passes(spark):
    pages = spark.range(400).select("id", F.concat(F.lit("http://a.b/"), (F.col("id") % 3).cast("string")).alias("url"), F.lit("20240101000000").alias("ts"), F.lit("x").alias("payload")).repartition(9)
    uri = new_workspace(spark, "runs")
    rows = warc.merge_runs(warc.write_archives(pages, uri), uri, 5, fan_in=3).collect()
    keys = [(x.url_key, x.ts, x.id) for x in sorted(rows, key=lambda x: (x.range, x.position))]
    assert len(keys) == 400 and keys == sorted(keys) and max(x.range for x in rows) > 0


def test_damaged_records_are_found():
    member = warc.record("1", "http://a/", "20240101000000", b"payload", None)
    assert warc.parse(member)["payload"] == b"payload"
    bad = warc.gzip.compress(zlib.decompress(member, 31).replace(b"payload", b"pay1oad"))
    with pytest.raises(ValueError):
        warc.parse(bad)
