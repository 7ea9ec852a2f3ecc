"""The block-max index against a plain BM25, and how much of it a search reads."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslake.operators import bm25
from corpuslake.sources.tables import Store


def plain(chunks, query, k, keep=lambda p: True, dedupe=False):
    tokens = [(p, i, re.findall("[a-z0-9]+", t.lower())) for p, i, t in chunks]
    n, avgdl = len(tokens), sum(len(t) for *_, t in tokens) / len(tokens)
    df = collections.Counter(x for *_, t in tokens for x in set(t))
    found = []
    for p, i, t in tokens:
        tf = collections.Counter(t)
        score = sum(max(0.0, (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in set(re.findall("[a-z0-9]+", query.lower())) if tf[w])
        if score > 0 and keep(p):
            found.append((p, i, score))
    if dedupe:
        best = {}
        for p, i, s in found:
            best[p] = max(best.get(p, (s, -i)), (s, -i))
        found = [(p, -i, s) for p, (s, i) in best.items()]
    return [(p, i, round(s, 6)) for p, i, s in sorted(found, key=lambda x: (-round(x[2], 6), x[0], x[1]))][:k]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(f"p{i // 2:04}", i % 2, " ".join(r.choices(words, weights, k=r.randint(0, 60)))) for i in range(1200)]
    rows += [("rare", 0, "w250 w251 w252 w250"), ("rare", 1, "W250, w251"), ("same1", 0, "w7 w8"), ("same0", 0, "w7 w8"), ("empty", 0, "")]
    return rows


def test_searches_equal_a_plain_one(spark, corpus, tmp_path):
    chunks = spark.createDataFrame(corpus, "path string, chunk_index int, chunk_text string").repartition(3)
    index = bm25.build(chunks, store=Store(spark, str(tmp_path)), cell_bits=4)
    r = random.Random(6)
    texts = ["w250 w251 w252", "w7 w8", "w0 w1", "", "unknown", "w290"] + [" ".join(f"w{r.randrange(300)}" for _ in range(r.randint(1, 9))) for _ in range(12)]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    for k, keep, test, dedupe in ((1, None, lambda p: True, False), (5, None, lambda p: True, True), (7, F.col("path") > "p0300", lambda p: p > "p0300", False), (2000, None, lambda p: True, False)):
        got = collections.defaultdict(list)
        for x in sorted(bm25.search_many(index, queries, k, keep, dedupe).collect(), key=lambda x: x.rank):
            got[x.query_id].append((x.path, x.chunk_index, round(x.score, 6)))
        for q, t in enumerate(texts):
            assert got[q] == plain(corpus, t, k, test, dedupe), (t, k)
    assert [(x.path, x.chunk_index, round(x.score, 6)) for x in bm25.search(bm25.Index.load(Store(spark, str(tmp_path))), texts[0], 4).collect()] == plain(corpus, texts[0], 4)


def test_a_search_reads_few_blocks(spark, corpus):
    chunks = spark.createDataFrame(corpus, "path string, chunk_index int, chunk_text string").repartition(3)
    index = bm25.build(chunks, cell_bits=4)
    queries = spark.createDataFrame([(0, "w250 w251 w252 w2 w3 w4 w5")], "query_id int, text string")
    read = {}
    assert bm25.search_many(index, queries, 2, count=lambda name, rows: read.update({name: rows.count()})).count() == 2
    assert read["seeds"] + read["later"] < read["asked"] / 4
    blocks = index.blocks.select("term", "cell", F.size("postings").alias("n"), "bound").collect()
    assert all(b.n <= 16 for b in blocks) and len({(b.term, b.cell) for b in blocks}) == len(blocks) and max(b.bound for b in blocks) < 2.5
