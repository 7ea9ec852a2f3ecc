"""Communities over relations against a plain Louvain, and related notes against all pairs."""

import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.operators import dense, graph



def plain_louvain(pairs: list[tuple[str, str, float]], total: float, levels: int = 10, least: float = 1e-4) -> dict[str, str]:
    """Communities of a connected graph as node -> smallest member. Nodes are visited in order, so equal inputs give equal results."""
    members = {n: [n] for p in pairs for n in p[:2]}
    graph: dict[str, dict[str, float]] = defaultdict(dict)
    loops: dict[str, float] = defaultdict(float)
    for a, b, w in pairs:
        graph[a][b] = graph[a].get(b, 0.0) + w
        graph[b][a] = graph[a][b]
    for _ in range(levels):
        degree = {n: sum(graph[n].values()) + 2 * loops[n] for n in members}
        home = {n: n for n in members}
        weight = dict(degree)
        moved_any, gained = False, 1.0
        while gained > least:
            gained = 0.0
            for n in sorted(members):
                to: dict[str, float] = defaultdict(float)
                for x, w in graph[n].items():
                    to[home[x]] += w
                here = home[n]
                weight[here] -= degree[n]
                worth = {c: w - weight[c] * degree[n] / (2 * total) for c, w in to.items()}
                stay = to.get(here, 0.0) - weight[here] * degree[n] / (2 * total)
                best = min(worth, key=lambda c: (-worth[c], c), default=here)
                if best != here and worth[best] > stay + 1e-12:
                    gained += (worth[best] - stay) / total
                    home[n], moved_any = best, True
                weight[home[n]] += degree[n]
        if not moved_any:
            break
        merged: dict[str, list[str]] = defaultdict(list)
        for n, c in home.items():
            merged[c] += members[n]
        new_graph: dict[str, dict[str, float]] = defaultdict(dict)
        new_loops: dict[str, float] = defaultdict(float)
        for n in members:
            new_loops[home[n]] += loops[n]
            for x, w in graph[n].items():
                if home[x] == home[n]:
                    new_loops[home[n]] += w / 2
                else:
                    new_graph[home[n]][home[x]] = new_graph[home[n]].get(home[x], 0.0) + w
        members, graph, loops = dict(merged), new_graph, new_loops
    return {x: min(group) for group in members.values() for x in group}


def quality(pairs, labels):
    m = sum(w for *_, w in pairs)
    ends = defaultdict(float)
    for a, b, w in pairs:
        ends[labels[a]] += w
        ends[labels[b]] += w
    return sum(w for a, b, w in pairs if labels[a] == labels[b]) / m - sum((k / (2 * m)) ** 2 for k in ends.values())


def cliques():
    rows = [(f"c{i:02}_{a}", f"c{i:02}_{b}", 1.0) for i in range(12) for a in range(5) for b in range(a)]
    return rows + [(f"c{i:02}_0", f"c{(i + 1) % 12:02}_1", 1.0) for i in range(12)]


def planted():
    r = random.Random(2)
    return [(f"n{a:03}", f"n{b:03}", r.choice([0.5, 1.0, 2.0])) for a in range(150) for b in range(a) if r.random() < (0.25 if a % 6 == b % 6 else 0.02)]


def star():
    return [("hub", f"leaf{i:03}", 1.0) for i in range(80)] + [(f"leaf{i:03}", f"leaf{i + 1:03}", 1.0) for i in range(0, 80, 2)]


@pytest.mark.parametrize("make", [cliques, planted, star])
def test_modularity_is_that_of_a_plain_louvain(spark, make):
    pairs = [(min(a, b), max(a, b), w) for a, b, w in make()]
    df = spark.createDataFrame(pairs, "a string, b string, w double")
    found = graph.louvain(df)
    labels = {r.path: r.leader for r in found.collect()}
    assert set(labels) == {x for p in pairs for x in p[:2]}
    groups = defaultdict(list)
    for path, leader in labels.items():
        groups[leader].append(path)
    assert all(leader == min(paths) for leader, paths in groups.items())
    got = quality(pairs, labels)
    assert got >= 0.99 * quality(pairs, plain_louvain(pairs, sum(w for *_, w in pairs)))
    assert abs(graph.modularity(df, found) - got) < 1e-9
    if make is cliques:
        assert {r.path: r.leader for r in graph.louvain(df.repartition(7)).collect()} == labels


def test_a_round_moves_many_nodes_at_once(spark):
    r = random.Random(5)
    near = {(min(a, b), max(a, b)) for a in range(300) for b in r.sample(range(300), 4) if a != b}
    pairs = [(f"n{a:03}", f"n{b:03}", 1.0) for a, b in sorted(near)]
    adjacent = spark.createDataFrame(pairs + [(b, a, w) for a, b, w in pairs], "src string, dst string, w double")
    state = adjacent.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).select("node", F.col("node").alias("comm"), "k")
    rows, seen = graph._wishes(adjacent, state, 2.0 * len(pairs), 1, 0.5)
    labels = {x.node: x.comm for x in graph._admitted(graph.cut_lineage(rows), 2.0 * len(pairs), 1).collect()}
    alone = {x: x for x in labels}
    assert seen.get["want"] == seen.get["n"] == len(labels) == 300
    assert abs(seen.get["inner"] / 2 / len(pairs) - seen.get["squares"] / 4 / len(pairs) ** 2 - quality(pairs, alone)) < 1e-9
    assert sum(a != b for a, b in labels.items()) > 60
    assert quality(pairs, labels) > quality(pairs, alone) + 0.05


def test_no_edges(spark):
    df = spark.createDataFrame([], "a string, b string, w double")
    assert graph.louvain(df).count() == 0 and graph.modularity(df, graph.louvain(df)) == 0.0


def all_pairs(vectors, top, least):
    out = set()
    for a, x in vectors:
        near = []
        for b, y in vectors:
            if a != b:
                n = np.linalg.norm(x) * np.linalg.norm(y)
                near.append((-round(float(np.dot(x, y) / n) if n else 0.0, 6), b))
        out |= {(a, b, -s) for s, b in sorted(near)[:top] if -s >= least}
    return out


def test_related_notes_meet_only_near_blocks(spark):
    g = np.random.default_rng(3)
    around = g.normal(size=(12, 16))
    rows = [(f"v{i:03}", (around[i % 12] + 0.1 * g.normal(size=16)).astype(np.float32)) for i in range(240)]
    rows += [("zero", np.zeros(16, np.float32)), *((f"twin{i}", rows[0][1]) for i in range(30)), ("far", -rows[0][1])]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in rows] + [("null", None)], "path string, embedding array<float>").repartition(3)
    exact = [(k, v.astype(np.float64)) for k, v in rows]
    for top, least, block in ((8, 0.7, 8), (3, 0.95, 16), (5, -2.0, 16), (300, 0.9, 2048)):
        seen = {}
        got = dense.related(df, "path", top, least, block, count=lambda name, n: seen.update({name: n})).collect()
        assert {(r.a, r.b, round(r.similarity, 6)) for r in got} == all_pairs(exact, top, least)
        if block == 8:
            assert seen["met"] < seen["pairs"] / 3
    assert dense.related(df.limit(0)).count() == 0 and dense.related(df.where("path = 'far'")).count() == 0


def test_related_notes_shuffle_a_vector_once_however_many_blocks_meet(spark):
    g = np.random.default_rng(4)

    def shuffled(n):
        rows = [(i, v.tolist()) for i, v in enumerate(g.normal(size=(n, 64)))]
        df = spark.createDataFrame(rows, "path long, embedding array<float>")
        wrote = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
        before = wrote()
        got = dense.related(df, "path", 2, 0.0, 16).collect()
        assert len(got) == 2 * n
        time.sleep(1)  # the store of figures lags behind
        return wrote() - before

    small, large = shuffled(160), shuffled(640)
    assert large < 8 * small
