"""Shortest paths from both ends against a plain search."""

import random

import pytest

from corpuslake.operators import graph


def plain_path(rows, source, target):
    near = {}
    for o, (a, b, t) in enumerate(rows):
        if a != b:
            near.setdefault(a, []).append((o, b, t))
            near.setdefault(b, []).append((o, a, t))
    dist, level = {source: 0}, [source]
    while level:
        level = [b for a in level for _, b, _ in near.get(a, []) if b not in dist and not dist.update({b: dist[a] + 1})]
    if target not in dist:
        return []
    out, at = [], target
    while at != source:
        _, prev, t = min((o, a, t) for o, a, t in near[at] if dist.get(a) == dist[at] - 1)
        out.append((at, t))
        at = prev
    return [(source, "start"), *out[::-1]]


def run(spark, rows, pairs):
    df = spark.createDataFrame([(a, b, t, o) for o, (a, b, t) in enumerate(rows)], "src string, dst string, type string, edge_ord int").repartition(3)
    for source, target in pairs:
        assert [(x["path"], x["edge_type"]) for x in graph.shortest_path(df, source, target)] == plain_path(rows, source, target), (source, target)


def test_random_graphs(spark):
    r = random.Random(7)
    rows = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}", r.choice("xyz")) for _ in range(75)] + [("alone", "alone", "x")]
    run(spark, rows, [("n1", "n2"), ("n3", "n50"), ("n1", "alone"), ("n5", "absent")])


def test_a_long_path_and_a_hub(spark):
    rows = [(f"p{i:03}", f"p{i + 1:03}", "xy"[i % 2]) for i in range(24)] + [("hub", f"leaf{i}", "h") for i in range(5000)] + [("hub", "p010", "h")]
    run(spark, rows, [("p000", "p024"), ("leaf7", "p014")])
