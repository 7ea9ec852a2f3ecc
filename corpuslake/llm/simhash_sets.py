"""SimHash near-duplicates at radii too wide for equal segments, decided by Jaccard similarity.

Sets of word shingles of similarity 0.8 differ in some twenty of 128 fingerprint
bits, too many for any segment to be equal reliably. So candidates meet another
way: two sets of similarity t or more share one of the first
n - ceil(t * n) + 1 members of each in any one order of all shingles (n: the
set's size), and these are the join keys. What travels under a key is the
fingerprint; the pigeonring chain of segments prunes the candidates, then the
full Hamming check, and only what is left is compared by whole sets. ``RADIUS``
lies some four standard deviations above the distance expected at similarity
0.8 (of sets of five members; over five for large ones), and as many below that
of unlike sets, so that the filter loses less than one such pair in ten thousand.

In the order used, shingles that a sample of documents repeats come last, which
spares crowded keys; what the sample holds changes the cost and never the result.

Under each key a spanning forest of the close fingerprints is kept. The
components of all forests hold every similar pair, so each set travels once, to
its component's task, where sets are compared exactly as far as links found
before leave them apart. A large component is dealt as pairs of blocks, a task
each. The result is components: pairs within one need not be listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm import bytewords as bw
from corpuslake.llm.components import components
from corpuslake.llm.lean import lean
from corpuslake.llm.workspace import materialise, new_workspace, partitions_for

SLICE = 2 << 20
#: Documents whose shingles are counted to find frequent ones, and the count from which one is frequent.
SAMPLE, FREQUENT = 4096, 3
#: Sets of a component that one task compares with each other, or with as many others.
BLOCKED = 1024
#: Sets wanted by a pass are marked in so many bits.
MARKS = 26
#: Sets, and shingles that they share, which are compared at once.
TILE, BLOCK = 256, 1 << 14
#: Bits that fingerprints of similar sets may differ in, of 128 in RING segments.
RADIUS, RING = 42, 8
U = np.uint64


def shingle_sets(column: pa.Array, shingle: int):
    """(first row, last row, sets, offsets, signatures, fingerprints) of slices of a string column.

    A set holds the ascending hashes of a text's distinct shingles, of all its
    words if they are fewer. Equal sets have equal signatures.
    """
    data, off = bw.buffers(column)
    for lo, hi in bw.slices(off, SLICE):
        w = bw.Words(bw.LOWER[data[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo], bw.SPACED)
        h = w.hashes()
        at = np.flatnonzero(bw.inside(w.first, shingle, len(h)))
        values, owners = [bw.shingles(h, shingle)[at]], [w.doc()[at]]
        for k in range(1, shingle):
            few = np.flatnonzero(w.count == k)
            values.append(bw.shingles(h, k)[w.first[few]] if len(few) else np.zeros(0, U))
            owners.append(few)
        value, owner = np.concatenate(values), np.concatenate(owners)
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[new], owner[new]
        cuts = np.searchsorted(owner, np.arange(hi - lo + 1))
        total = np.concatenate((np.zeros(1, U), np.cumsum(bw.mix(value ^ U(0x5851F42D4C957F2D)), dtype=U)))
        yield lo, hi, value, cuts, bw.mix((total[cuts[1:]] - total[cuts[:-1]]) ^ bw.mix(np.diff(cuts).astype(U))), majority(value, cuts)


def majority(value: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The fingerprint of each set, two words: a bit is 1 if over half of its members' hashes have it."""
    size = np.diff(cuts)
    owner, sums = np.repeat(np.arange(len(size)), size), np.zeros((len(size), 128), np.int64)
    for lo in range(0, len(value), 1 << 16):
        part, own = value[lo : lo + (1 << 16)], owner[lo : lo + (1 << 16)]
        both = np.stack([part, bw.mix(part ^ U(0x8CB92BA72F3D8DD7))], 1)
        bits, at = np.unpackbits(both.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little"), np.flatnonzero(np.diff(own, prepend=-1))
        sums[own[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    return np.packbits(2 * sums > size[:, None], axis=1, bitorder="little").view(U)


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether fingerprints are within RADIUS bits: a chain of segments within budget from some start, then the full check on what has one."""
    apart = np.bitwise_count((a ^ b).view(np.uint16))
    left, ok = np.arange(len(a)), np.zeros(len(a), bool)
    for start in range(RING):
        rows, total = left, np.zeros(len(left), np.int64)
        for l in range(RING):
            total = total + apart[rows, (start + l) % RING]
            stay = total <= (l + 1) * RADIUS // RING
            rows, total = rows[stay], total[stay]
        ok[rows] = True
        left = left[~ok[left]]
    some = np.flatnonzero(ok)
    ok[some] = apart[some].sum(axis=1) <= RADIUS
    return ok


def _unseen(sig: np.ndarray, ok: np.ndarray, seen: set) -> np.ndarray:
    """Whether each row is ``ok`` and the first of its signature in this task."""
    out = np.zeros(len(sig), bool)
    for i in np.flatnonzero(ok).tolist():
        if (s := int(sig[i])) not in seen:
            seen.add(s)
            out[i] = True
    return out


def prefixes(value: np.ndarray, cuts: np.ndarray, frequent: np.ndarray, over: int, under: int) -> np.ndarray:
    """Whether each member belongs to its set's prefix for similarity over / under; ``frequent`` ascends."""
    size = np.diff(cuts)
    owner = np.repeat(np.arange(len(size)), size)
    last = np.zeros(len(value), bool)
    if len(frequent) and len(value):
        last = frequent[np.minimum(np.searchsorted(frequent, value), len(frequent) - 1)] == value
    lasts = np.concatenate(([0], np.cumsum(last)))
    within = np.arange(len(value)) - cuts[:-1][owner]
    rank_last = lasts[:-1] - lasts[cuts[:-1]][owner]
    rare = size - (lasts[cuts[1:]] - lasts[cuts[:-1]])
    rank = np.where(last, rare[owner] + rank_last, within - rank_last)
    return rank < (size - -(-over * size // under) + 1)[owner]


def _sized(n: np.ndarray, i: np.ndarray, j: np.ndarray, over: int, under: int) -> np.ndarray:
    return np.minimum(n[i], n[j]) * under >= np.maximum(n[i], n[j]) * over


def _spread(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the pairs i, j are joined: the least that each reaches."""
    while len(i):
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            break
    return label


def _forest(sig: np.ndarray, n: np.ndarray, fp: np.ndarray, over: int, under: int) -> np.ndarray:
    """The least place that each set of one key reaches over pairs of like size and close fingerprints."""
    order = np.argsort(n, kind="stable")
    n, fp = n[order], fp[order]

    def near(i, j):
        keep = _sized(n, i, j, over, under)
        i, j = i[keep], j[keep]
        keep = close(fp[i], fp[j])
        return i[keep], j[keep]

    label = np.arange(len(n))
    if len(n) > 8:  # chains first: what they join need not be compared
        for k in range(3):
            chain = np.argsort(bw.mix(sig[order].view(U) ^ U(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)), kind="stable")
            label = _spread(label, *near(chain[:-1], chain[1:]))
    for lo in range(0, len(n), TILE):
        hi = min(lo + TILE, len(n))
        last = int(np.searchsorted(n * over, int(n[hi - 1]) * under, "right"))  # longer ones are too long for all of them
        for at in range(lo, last, 4 * TILE):
            i, j = (x.ravel() for x in np.meshgrid(np.arange(lo, hi), np.arange(at, min(last, at + 4 * TILE)), indexing="ij"))
            keep = (i < j) & (label[i] != label[j])
            label = _spread(label, *near(i[keep], j[keep]))
    out = np.empty(len(n), np.int64)
    out[order] = order[label]
    return out


def _share(batches, over: int, under: int):
    """Edges (a, b) of a spanning forest of the close sets under each key."""
    batches = list(batches)
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    del batches
    key, sig, n, one, two = (t.column(c).combine_chunks().to_numpy() for c in ("key", "sig", "n", "one", "two"))
    del t
    order = np.lexsort((sig, key))
    key, sig, n, fp = key[order], sig[order], n[order].astype(np.int64), np.stack([one[order], two[order]], 1).view(U)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
    key, sig, n, fp = key[new], sig[new], n[new], fp[new]
    edge = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    size = np.diff(np.append(edge, len(key)))
    twos = edge[size == 2]
    twos = twos[_sized(n, twos, twos + 1, over, under)]
    twos = twos[close(fp[twos], fp[twos + 1])]
    found = [np.stack([sig[twos], sig[twos + 1]], 1)]
    for lo, m in zip(edge[size > 2].tolist(), size[size > 2].tolist()):
        label = _forest(sig[lo : lo + m], n[lo : lo + m], fp[lo : lo + m], over, under)
        child = np.flatnonzero(label != np.arange(m))
        if len(child):
            found.append(np.stack([sig[lo + child], sig[lo + label[child]]], 1))
    e = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
    for lo in range(0, len(e), 1 << 16):
        yield pa.record_batch([pa.array(e[lo : lo + (1 << 16), k].copy()) for k in (0, 1)], names=["a", "b"])


def _group_links(sig: np.ndarray, label: np.ndarray, sets: list, over: int, under: int):
    """Similar pairs that join the different labels of one group as far as any of its pairs do."""
    size = np.array([len(x) for x in sets], np.int64)
    fp = majority(np.concatenate(sets), np.concatenate(([0], np.cumsum(size))))
    _, label, count = np.unique(label, return_inverse=True, return_counts=True)
    # those of the commonest label come last and are not compared with each other
    order = np.argsort(count[label], kind="stable")
    for a in range(0, len(order), TILE):
        for b in range(a, len(order), TILE):
            i, j = order[a : a + TILE], order[b : b + TILE]
            cross = (label[i][:, None] != label[j][None, :]) & _sized(size, i[:, None], j[None, :], over, under)
            r, c = np.nonzero(cross)
            cross[r, c] = close(fp[i[r]], fp[j[c]])
            i, j, cross = i[cross.any(1)], j[cross.any(0)], cross[cross.any(1)][:, cross.any(0)]
            if not len(i):
                continue
            x, y = (np.concatenate([sets[k] for k in part]) for part in (i, j))
            common = np.intersect1d(x, y)
            rows = []
            for part, members in ((i, x), (j, y)):
                at = np.minimum(np.searchsorted(common, members), len(common) - 1) if len(common) else np.zeros(0, np.int64)
                yes = common[at] == members if len(common) else np.zeros(0, bool)
                rows.append((np.repeat(np.arange(len(part)), size[part])[: len(yes)][yes], at[yes]))
            both = np.zeros(cross.shape, np.float64)
            for lo in range(0, len(common), BLOCK):
                left, right = (np.zeros((len(part), BLOCK), np.float32) for part in (i, j))
                for out, (row, at) in zip((left, right), rows):
                    yes = (at >= lo) & (at < lo + BLOCK)
                    out[row[yes], at[yes] - lo] = 1
                both += left @ right.T
            good = cross & (both * under >= over * (size[i][:, None] + size[j][None, :] - both))
            for r, c in zip(*(k.tolist() for k in np.nonzero(good))):
                if label[i[r]] != label[j[c]]:
                    label[label == label[j[c]]] = label[i[r]]
                    yield int(sig[i[r]]), int(sig[j[c]])


def _across(batches, over: int, under: int):
    """Links (a, b) within each tile; rows (comp, i, j, sig, members) come in order of comp, i, j."""
    def out(rows):
        sets = [x[1] for x in rows]
        e = list(_group_links(np.array([x[0] for x in rows]), np.arange(len(rows)), sets, over, under))
        return pa.record_batch([pa.array([x for x, _ in e], pa.int64()), pa.array([y for _, y in e], pa.int64())], names=["a", "b"])

    held, last = [], None
    for batch in batches:
        marks = zip(*(batch.column(k).to_pylist() for k in range(3)))
        for mark, sig, x in zip(marks, batch.column(3).to_pylist(), batch.column(4)):
            if held and mark != last:
                yield out(held)
                held = []
            last = mark
            held.append((sig, np.frombuffer(x.as_buffer(), U)))
    if held:
        yield out(held)


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int, uri: str) -> DataFrame:
    """(sig, members) of the wanted signatures."""
    spark = docs.sparkSession
    marks = wanted.select((F.col("sig").bitwiseAND((1 << MARKS) - 1)).alias("slot"))
    words = marks.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(1 << (MARKS - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    # a bounded side: 8 MB whatever the input
    shared = spark.sparkContext.broadcast(table.view(U))

    def run(batches):
        bits, seen = shared.value, set()
        for b in batches:
            for _, _, value, cuts, sig, _ in shingle_sets(b.column(0), shingle):
                slot = sig & U((1 << MARKS) - 1)
                rows = np.flatnonzero(_unseen(sig, (bits[slot >> U(6)] >> (slot & U(63))) & U(1) > 0, seen))
                yield pa.record_batch([pa.array(sig[rows].view(np.int64)), pa.array([value[cuts[r] : cuts[r + 1]].tobytes() for r in rows.tolist()], pa.binary())], names=["sig", "members"])

    held = docs.select("text").mapInArrow(lean(run), "sig long, members binary").join(wanted, "sig", "left_semi").dropDuplicates(["sig"])
    return materialise(held, uri)


def similar(docs: DataFrame, shingle: int = 5, over: int = 4, under: int = 5) -> DataFrame:
    """(doc_id, component_id) of each row of docs (doc_id, text, ...) with a doc_id.

    component_id is the smallest doc_id that links reach, itself included. Texts
    are linked if the sets of their shingles of ``shingle`` words (ASCII
    lower-cased, cut at ASCII white space) have a Jaccard similarity of
    over / under or more. Null, empty and wordless texts are equal to each other.
    Rows of one doc_id are linked. Shingles and sets are told apart by 64-bit
    hashes. ``docs`` is read several times.
    """
    if not 0 < over <= under:
        raise ValueError("the similarity must be over 0 and at most 1")
    spark = docs.sparkSession
    place = new_workspace(spark, "similar")
    n = partitions_for(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    every = max(1, docs.count() // SAMPLE)

    def scan(batches):
        for b in batches:
            for lo, hi, value, cuts, sig, _ in shingle_sets(b.column(1), shingle):
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(sig.view(np.int64)), pa.nulls(hi - lo, pa.int64())], names=["doc_id", "sig", "shingle"])
                taken = np.repeat(sig % U(every) == 0, np.diff(cuts))
                if k := int(taken.sum()):
                    yield pa.record_batch([pa.nulls(k, pa.int64()), pa.array(sig.view(np.int64).repeat(np.diff(cuts))[taken]), pa.array(value[taken].view(np.int64))], names=["doc_id", "sig", "shingle"])

    scanned = materialise(docs.mapInArrow(lean(scan), "doc_id long, sig long, shingle long"), f"{place}/scanned")
    marks = scanned.where("shingle is null").select("doc_id", "sig")
    counted = scanned.where("shingle is not null").distinct().groupBy("shingle").count().where(F.col("count") >= FREQUENT)
    frequent = spark.sparkContext.broadcast(np.sort(counted.select("shingle").toArrow().column(0).to_numpy().view(U)))

    def keys(batches):
        seen: set = set()
        for b in batches:
            for _, _, value, cuts, sig, fp in shingle_sets(b.column(1), shingle):
                yes = prefixes(value, cuts, frequent.value, over, under)
                size = np.diff(cuts)
                yes &= np.repeat(_unseen(sig, size > 0, seen), size)
                yield pa.record_batch([pa.array(value[yes].view(np.int64)), pa.array(sig.view(np.int64).repeat(size)[yes]), pa.array(size.astype(np.int32).repeat(size)[yes]), *(pa.array(np.ascontiguousarray(fp[:, k]).view(np.int64).repeat(size)[yes]) for k in (0, 1))], names=["key", "sig", "n", "one", "two"])

    keyed = docs.mapInArrow(lean(keys), "key long, sig long, n int, one long, two long").repartition(n, "key")
    near = materialise(keyed.mapInArrow(lean(lambda x: _share(x, over, under)), "a long, b long").distinct(), f"{place}/near")
    near = components(near)
    # the component's least node is not listed: it stands for itself
    near = materialise(near.select(F.col("node").alias("sig"), F.col("component").alias("comp")).unionByName(near.select(F.col("component").alias("sig"), F.col("component").alias("comp")).distinct()), f"{place}/components")
    held = _sets(docs, near.select("sig"), shingle, f"{place}/sets")
    blocks = near.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCKED).alias("blocks"))
    rows = near.join(blocks, "comp").withColumn("own", F.pmod(F.xxhash64("sig"), "blocks")).select("comp", "sig", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sig").join(held, "sig").select("comp", "i", "j", "sig", "members")
    links = rows.repartition(n, "comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(lean(lambda x: _across(x, over, under)), "a long, b long")
    links = materialise(links, f"{place}/links")
    # rows of one doc_id belong together
    least = marks.groupBy("doc_id").agg(F.min("sig").alias("a"), F.max("sig").alias("z")).where("a <> z").select("doc_id", "a")
    same = marks.join(least, "doc_id").select("a", F.col("sig").alias("b")).where("a <> b")
    found = components(links.unionByName(same)).withColumnRenamed("node", "sig")
    first = marks.groupBy("sig").agg(F.min("doc_id").alias("doc")).join(found, "sig", "left").select("sig", "doc", F.coalesce("component", "sig").alias("label"))
    first = materialise(first, f"{place}/first")
    classes = first.join(first.groupBy("label").agg(F.min("doc").alias("component_id")), "label").select("sig", "component_id")
    return marks.join(classes, "sig").select("doc_id", "component_id")
