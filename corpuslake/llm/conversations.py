"""Repair of the structure of conversations by cheapest edits.

A repaired conversation has role initials ``(s?(ua)+)?``. Every row is kept,
given another role or deleted, and empty rows may be inserted anywhere; positions
times the four states of that pattern are the nodes of a graph whose arcs are
edits. Minimum costs from the start and to the end tell which arcs are tight, that
is on a cheapest path; a set of nodes then walks along tight arcs and takes the
arc of the least letter at each step, which gives the ASCII-least audit.

Rows are reduced before anything is sorted: alike rows of one turn become one row
with a count, and a text becomes a hash, a fault and the first characters that
order ties. The reduced rows are sorted by range, so a conversation of any size is
cut into blocks. A block's minimum costs are a 4 by 4 matrix; the matrices of a
conversation are chained (one for each partition of the sort at most), which gives
each block its costs at both edges, and the sets that enter blocks are chained in
the same way. No task holds more than a block, and texts meet the edits by key.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.lean import at_end, lean
from corpuslake.llm.workspace import materialise, new_workspace, partitions_for

SPACE = " \t\n\x0b\x0c\r"
#: Characters of role and text that order rows of one turn, before a hash of both does.
HEAD = 32
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Faults of a row, in order.
CLEAN, CUT, DUPLICATE, BLANK = range(4)
#: State after an initial: 0 nothing yet, 1 behind s, 2 behind u, 3 behind a.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
INITIALS, ENDS, NEVER = "sua", (0, 3), 1 << 40
_LEGAL = {(0, 1), (1, 2), (2, 1)}
KEY = 16


# ------------------------------------------------------------ costs along rows


def _relative(costs) -> tuple[int, tuple[int, ...]]:
    """The least cost, and all costs without it."""
    least = min(costs)
    return least, tuple(c - least if c < NEVER else NEVER for c in costs)


def _settle(costs, back: bool = False) -> list[int]:
    """Costs with insertions at the same place taken into account."""
    out = list(costs)
    for _ in range(3):
        for c in "ua":
            for q, t in NEXT[c].items():
                a, b = (t, q) if back else (q, t)
                out[b] = min(out[b], out[a] + INSERT)
    return [min(x, NEVER) for x in out]


def _arcs(code: int) -> list[tuple[str, int, int, int]]:
    """(letter, state, next state, cost) of the edits of one row; code is initial + 4 * fault."""
    initial, fault = code % 4, code // 4
    arcs = [("D", q, q, DELETE) for q in range(4)]
    if fault < DUPLICATE:
        more = TRUNCATED if fault == CUT else 0
        if initial < 3:
            arcs += [("K", q, t, KEEP + more) for q, t in NEXT[INITIALS[initial]].items()]
        arcs += [("R", q, t, REROLE + more) for c in "ua" for q, t in NEXT[c].items()]
    return arcs


@lru_cache(None)
def _after(costs: tuple[int, ...], code: int) -> tuple[int, tuple[int, ...]]:
    """Costs from the start behind a row."""
    out = [NEVER] * 4
    for _, q, t, c in _arcs(code):
        out[t] = min(out[t], costs[q] + c)
    return _relative(_settle(out))


@lru_cache(None)
def _before(costs: tuple[int, ...], code: int) -> tuple[int, tuple[int, ...]]:
    """Costs to the end in front of a row."""
    out = [NEVER] * 4
    for _, q, t, c in _arcs(code):
        out[q] = min(out[q], costs[t] + c)
    return _relative(_settle(out, back=True))


@lru_cache(None)
def _step(ahead: tuple[int, ...], here: tuple[int, ...], beyond: tuple[int, ...], code: int | None, nodes: int, room_here: int, room_beyond: int) -> tuple[str, int]:
    """The least letter of a tight arc from a set of nodes, and the set it leads to.

    ahead are costs from the start, here and beyond costs to the end before and
    behind the row; an arc is tight if its cost with both is what is left of the optimum.
    """
    if code is not None and (to := _union(t for a, q, t, c in _arcs(code) if a == "D" and nodes >> q & 1 and ahead[q] + c + beyond[t] == room_beyond)):
        return "D", to
    if code is None and any(nodes >> q & 1 and ahead[q] + here[q] == room_here and here[q] == min(here) and q in ENDS for q in range(4)):
        return "", nodes
    if to := _union(t for c in "ua" for q, t in NEXT[c].items() if nodes >> q & 1 and ahead[q] + INSERT + here[t] == room_here):
        return "I", to
    for letter in "KR" if code is not None else "":
        if to := _union(t for a, q, t, c in _arcs(code) if a == letter and nodes >> q & 1 and ahead[q] + c + beyond[t] == room_beyond):
            return letter, to
    raise ValueError("no tight arc leaves these nodes")


def _union(states) -> int:
    out = 0
    for q in states:
        out |= 1 << q
    return out


@at_end
def _forget() -> None:
    for f in (_after, _before, _step):
        f.cache_clear()


START = tuple(_settle([0, NEVER, NEVER, NEVER]))
END = tuple(_settle([0 if q in ENDS else NEVER for q in range(4)], back=True))


def transfer(codes, copies) -> list[int]:
    """Least costs from each state in front of a block to each behind it, row by row."""
    out: list[int] = []
    for q in range(4):
        base, costs = _relative(_settle([0 if p == q else NEVER for p in range(4)]))
        for code, n in zip(codes, copies):
            d, costs = _after(costs, code)
            base += d + DELETE * (n - 1)
        out += [base + c if c < NEVER else NEVER for c in costs]
    return out


def walk(codes, copies, ahead, beyond, optimum: int, nodes: int, last: bool):
    """(audit, kept, cost, nodes behind the block): the least letters of tight arcs from a set of nodes.

    kept are (row, edit, initial of the new role) of what stays; an insertion has row -1.
    Of several copies all but the first go, right behind it.
    """
    n = len(codes)
    offset, costs = [0] * (n + 1), [None] * (n + 1)
    offset[n], costs[n] = _relative(beyond)
    for i in range(n - 1, -1, -1):
        d, costs[i] = _before(costs[i + 1], codes[i])
        offset[i] = offset[i + 1] + d + DELETE * (copies[i] - 1)
    base, f = _relative(ahead)
    letters, kept, cost = [], [], 0
    for i in range(n + 1 if last else n):
        code = codes[i] if i < n else None
        more = DELETE * (copies[i] - 1) if i < n else 0
        while True:
            j = min(i + 1, n)
            letter, nodes = _step(f, costs[i], costs[j], code, nodes, optimum - base - offset[i], optimum - base - offset[j] - more)
            if letter == "I":
                letters.append("I")
                kept.append((-1, "I", "ua"[nodes >> 3 & 1]))
                cost += INSERT
                continue
            break
        if code is None:
            break
        letters.append(letter + "D" * (copies[i] - 1))
        cost += more + {"D": DELETE, "K": KEEP, "R": REROLE}[letter]
        if letter != "D":
            cost += TRUNCATED if code // 4 == CUT else 0
            kept.append((i, letter, "sua"[(nodes >> 2 & 1) + 2 * (nodes >> 3 & 1)]))
        d, f = _after(f, code)
        base += d + more
    return "".join(letters), kept, cost, nodes


# ------------------------------------------------------------ rows to blocks


def _key() -> Column:
    """16 bytes of the SHA-256 of a row's conversation, role and text: what only rows of one conversation that are alike share."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    named = F.concat_ws(":", F.length(conv).cast("string"), F.length("role").cast("string"), F.concat(conv, "role", "text"))
    return F.unhex(F.substring(F.sha2(named, 256), 1, 2 * KEY))


def _plain(conversations: DataFrame) -> DataFrame:
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role"), one("text"))


def _reduced(rows: DataFrame) -> DataFrame:
    """One row for alike rows of one turn: heads, key, code of the initial and the fault but duplicates, n."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), CLEAN).otherwise(CUT)
    first = F.left(F.col("role"), F.lit(1))
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return rows.groupBy("conv_id", "turn", F.left("role", F.lit(HEAD)).alias("role_head"), F.left("text", F.lit(HEAD)).alias("text_head"), _key().alias("key"), initial.alias("initial"), fault.alias("fault")).agg(F.count(F.lit(1)).alias("n"))


def _marked(reduced: DataFrame) -> DataFrame:
    """reduced with the code of the initial and the fault: what an earlier turn has too is a duplicate."""
    order = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    first = reduced.groupBy("key").agg(F.min(order).alias("o")).select(F.col("key").alias("k"), F.col("o.turn").alias("t"), F.lit(True).alias("first"))
    same = (F.col("key") == F.col("k")) & F.col("turn").eqNullSafe(F.col("t"))
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    return reduced.join(first, same, "left").select("conv_id", "turn", "role_head", "text_head", "key", (F.col("initial") + 4 * fault).cast("int").alias("code"), "n")


_STATS = ["rows", "blank", "duplicate", "truncated", "illegal", "first", "last", "turns", "low_turn", "high_turn"]


def _stats(codes: list[int], copies: list[int], turns: list[int | None]) -> list[int | None]:
    blank = duplicate = truncated = illegal = 0
    before = None
    for code, n in zip(codes, copies):
        initial, fault = code % 4, code // 4
        illegal += n - 1 + (before is not None and (before, initial) not in _LEGAL)
        before = initial
        blank += n if fault == BLANK else 0
        duplicate += n if fault == DUPLICATE else n - 1 if fault < DUPLICATE else 0
        truncated += fault == CUT
    known = [t for t in turns if t is not None]
    distinct = sum(a != b for a, b in zip(known, known[1:])) + 1 if known else 0
    return [sum(copies), blank, duplicate, truncated, illegal, codes[0] % 4, codes[-1] % 4, distinct, known[0] if known else None, known[-1] if known else None]


def _blocks(marked: DataFrame, parts: int) -> DataFrame:
    """One row for each conversation and partition of the sort: codes, copies and keys of its rows, statistics, and at the partition's edges the matrix."""
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role_head"), F.asc("text_head"), F.asc("key")]
    placed = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = placed.select("conv_id", "turn", "key", "code", "n", F.spark_partition_id().alias("part"))
    kind = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {kind}, part int, edge boolean, codes binary, copies array<long>, keys binary, matrix array<long>, " + ", ".join(f"{c} long" for c in _STATS)

    def run(batches):
        types = None
        block: list = []  # conv_id, part, first of the partition, codes, copies, keys, turns
        done: list = []

        def close(edge: bool) -> None:
            conv, part, first, codes, copies, keys, turns = block
            edge = edge or first
            done.append([conv, part, edge, bytes(codes), copies, b"".join(keys), transfer(codes, copies) if edge else None, *_stats(codes, copies, turns)])

        def batch():
            columns = list(zip(*done))
            arrays = [pa.array(columns[0], types), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.list_(pa.int64())), pa.array(columns[5], pa.binary()), pa.array(columns[6], pa.list_(pa.int64()))]
            arrays += [pa.array(c, pa.int64()) for c in columns[7:]]
            done.clear()
            return pa.record_batch(arrays, names=["conv_id", "part", "edge", "codes", "copies", "keys", "matrix", *_STATS])

        for b in batches:
            types = b.column(0).type
            for conv, turn, key, code, n, part in zip(*(c.to_pylist() for c in b.columns)):
                if not block or block[0] != conv:
                    if block:
                        close(False)
                        if len(done) >= 1000:
                            yield batch()
                    block = [conv, part, not block, [], [], [], []]
                block[3].append(code)
                block[4].append(n)
                block[5].append(key)
                block[6].append(turn)
        if block:
            close(True)
            yield batch()

    return rows.mapInArrow(lean(run), schema)


# ------------------------------------------------------------ chains over blocks


def _chain_costs(blocks: DataFrame) -> DataFrame:
    """edge blocks (conv_id, part, matrix) with costs from the start, costs to the end, the optimum, and whether it is the last one."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        m = [np.array(x, np.int64).reshape(4, 4) for x in frame["matrix"]]
        ahead, beyond = [np.array(START)], [np.array(END)]
        for x in m:
            ahead.append(np.minimum((ahead[-1][:, None] + x).min(axis=0), NEVER))
        for x in reversed(m):
            beyond.append(np.minimum((x + beyond[-1][None, :]).min(axis=1), NEVER))
        optimum = int((ahead[-1] + np.array(END)).min())
        beyond = beyond[::-1]
        return pd.DataFrame({
            "conv_id": frame["conv_id"], "part": frame["part"], "ahead": [x.tolist() for x in ahead[:-1]], "beyond": [x.tolist() for x in beyond[1:]],
            "optimum": optimum, "final": [False] * (len(m) - 1) + [True],
        })

    kind = dict(blocks.dtypes)["conv_id"]
    return blocks.groupBy("conv_id").applyInPandas(run, f"conv_id {kind}, part int, ahead array<long>, beyond array<long>, optimum long, final boolean")


def _exits(blocks: DataFrame) -> DataFrame:
    """For each edge block and each set of nodes that may enter it the set that leaves it (0 where none may)."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                args = list(r["codes"]), r["copies"], r["ahead"], r["beyond"], r["optimum"]
                t = np.array(transfer(*args[:2])).reshape(4, 4)
                here = (t + np.array(r["beyond"])[None, :]).min(axis=1)
                tight = [q for q in range(4) if r["ahead"][q] + here[q] == r["optimum"]]
                found = [0] * 16
                for subset in range(1, 1 << len(tight)):
                    nodes = _union(q for i, q in enumerate(tight) if subset >> i & 1)
                    found[nodes] = walk(*args, nodes, False)[3]
                out.append(found)
            yield pa.record_batch([b.column("conv_id"), b.column("part"), pa.array(out, pa.list_(pa.int32()))], names=["conv_id", "part", "exits"])

    kind = dict(blocks.dtypes)["conv_id"]
    return blocks.mapInArrow(lean(run), f"conv_id {kind}, part int, exits array<int>")


def _chain_sets(exits: DataFrame) -> DataFrame:
    """(conv_id, part, nodes): the set that enters each edge block."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        nodes, enter = 1, []
        for x in frame["exits"]:
            enter.append(nodes)
            nodes = int(x[nodes])
        return pd.DataFrame({"conv_id": frame["conv_id"], "part": frame["part"], "nodes": enter})

    kind = dict(exits.dtypes)["conv_id"]
    return exits.groupBy("conv_id").applyInPandas(run, f"conv_id {kind}, part int, nodes int")


def _answers(blocks: DataFrame) -> DataFrame:
    """(conv_id, part, audit, cost, kept: place in the block, edit, initial, key) of every block; those within a partition stand for a whole conversation."""

    def run(batches):
        kept_type = pa.list_(pa.struct([("seq", pa.int64()), ("edit", pa.string()), ("initial", pa.string()), ("key", pa.binary())]))
        for b in batches:
            audits, costs, all_kept = [], [], []
            for r in b.to_pylist():
                codes, copies, keys = list(r["codes"]), r["copies"], r["keys"]
                if r["nodes"] is None:
                    t = np.array(transfer(codes, copies)).reshape(4, 4)
                    optimum = int((t[0] + np.array(END)).min())
                    audit, kept, cost, _ = walk(codes, copies, START, END, optimum, 1, True)
                else:
                    audit, kept, cost, _ = walk(codes, copies, r["ahead"], r["beyond"], r["optimum"], r["nodes"], r["final"])
                audits.append(audit)
                costs.append(cost)
                all_kept.append([{"seq": s, "edit": e, "initial": c, "key": keys[KEY * i : KEY * i + KEY] if i >= 0 else None} for s, (i, e, c) in enumerate(kept)])
            yield pa.record_batch([b.column("conv_id"), b.column("part"), pa.array(audits, pa.string()), pa.array(costs, pa.int64()), pa.array(all_kept, kept_type)], names=["conv_id", "part", "audit", "cost", "kept"])

    kind = dict(blocks.dtypes)["conv_id"]
    return blocks.mapInArrow(lean(run), f"conv_id {kind}, part int, audit string, cost long, kept array<struct<seq:long,edit:string,initial:string,key:binary>>")


def _same(a: DataFrame, b: DataFrame, how: str, *keys: str) -> DataFrame:
    """A join on conv_id, null equal to null, and other keys."""
    renamed = b.withColumnsRenamed({k: f"__{k}" for k in ("conv_id", *keys)})
    on = F.col("conv_id").eqNullSafe(F.col("__conv_id"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return a.join(renamed, on, how).drop(*(f"__{k}" for k in ("conv_id", *keys)))


def _report(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("part")  # a row for each partition of the sort at most
    legal = F.lit(False)
    for a, b in _LEGAL:
        legal = legal | ((F.col("before") == a) & (F.col("first") == b))
    # a turn that two blocks share counts once; a block without turns stands before all that have some
    seen = blocks.select("conv_id", "part", *_STATS).withColumns({"before": F.lag("last").over(w), "before_turn": F.lag("high_turn").over(w)})
    counted = seen.withColumns({"illegal": F.col("illegal") + F.when(F.col("before").isNotNull() & ~legal, 1).otherwise(0), "turns": F.col("turns") - F.when(F.col("before_turn") == F.col("low_turn"), 1).otherwise(0)})
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    gaps = F.least(F.coalesce(wide("high") - wide("low") + 1 - wide("turns"), F.lit(0)), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    stats = counted.groupBy("conv_id").agg(F.min("low_turn").alias("low"), F.max("high_turn").alias("high"), F.sum("turns").alias("turns"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "")
    edits = answers.groupBy("conv_id").agg(F.sum("cost").alias("cost"), audit.alias("audit"))
    return _same(stats.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal"), edits, "inner")


def repair(conversations: DataFrame, bytes_each: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """conversations (conv_id, turn, role, text) -> (report, rows).

    report, a row for each conv_id that has rows: gaps (turns that are missing
    between the least and the greatest), blank, duplicate, truncated (rows by their
    first fault), illegal (neighbours whose role initials are not su, ua or au),
    cost, audit (K keep, R another role, D delete, I insert, in order). rows, what
    the repair leaves: conv_id, place (ascending along a conversation), edit, role, text.

    A null role or text is one space. A conversation's rows go by turn, null first;
    rows of one turn by the first HEAD characters of role and of text and then by a
    hash of both, so repeated rows are neighbours. conv_id null is a conversation too.
    Rows and texts are equal if 128 bits of their SHA-256 are. A gap count over a
    long is cut to it. Other columns are ignored; no rows give no rows.
    """
    place = new_workspace(conversations.sparkSession, "conversations")
    rows = _plain(conversations)
    reduced = materialise(_reduced(rows), f"{place}/reduced")
    blocks = materialise(_blocks(_marked(reduced), partitions_for(reduced, bytes_each)), f"{place}/blocks")
    edges = blocks.where("edge")
    costs = materialise(_chain_costs(edges.select("conv_id", "part", "matrix")), f"{place}/costs")
    exits = _exits(_same(edges.select("conv_id", "part", "codes", "copies"), costs, "inner", "part"))
    enter = _same(costs, materialise(_chain_sets(exits), f"{place}/sets"), "inner", "part")
    answers = materialise(_answers(_same(blocks.select("conv_id", "part", "codes", "copies", "keys"), enter, "left", "part")), f"{place}/answers")

    kept = answers.select("conv_id", "part", F.explode("kept").alias("x")).select("conv_id", (F.shiftleft(F.col("part").cast("long"), 33) + F.col("x.seq")).alias("place"), "x.edit", "x.initial", "x.key")
    texts = rows.select("conv_id", "role", "text", _key().alias("key")).drop("conv_id").dropDuplicates(["key"])
    found = kept.join(texts, "key", "left")
    role = F.when(F.col("edit") == "K", F.col("role")).when(F.col("initial") == "u", "user").otherwise("assistant")
    return _report(blocks, answers), found.select("conv_id", "place", "edit", role.alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """repaired rows -> (conv_id, sha256 of role:text, newline-joined). SHA-256 is sequential, so a conversation's rows stream through one task, one row in memory at a time."""
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches):
        conv, h = None, None
        for b in batches:
            ids, found = [], []
            for c, role, text in zip(*(x.to_pylist() for x in b.columns)):
                if h is None or c != conv:
                    if h is not None:
                        ids.append(conv)
                        found.append(h.hexdigest())
                    conv, h = c, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            yield pa.record_batch([pa.array(ids, b.column(0).type), pa.array(found, pa.string())], names=["conv_id", "sha256"])
            types = b.column(0).type
        if h is not None:
            yield pa.record_batch([pa.array([conv], types), pa.array([h.hexdigest()], pa.string())], names=["conv_id", "sha256"])

    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "role", "text")
    return placed.mapInArrow(lean(run), f"conv_id {kind}, sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by crc32 of conv_id:turn, modulo 20; a null is one space, but for a null turn, which stays.

    0 drops the row, 1 empties its text, 2 removes its full stops, question and
    exclamation marks, 3 repeats it, 4 gives it the role user.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    role = F.when(kind == 4, "user").otherwise(one("role"))
    times = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return conversations.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")
