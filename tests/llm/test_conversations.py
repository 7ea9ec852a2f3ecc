"""Repair of conversations against an exhaustive search for the cheapest and least edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache
from pathlib import Path

import pytest

from corpuslake.llm import conversations, queries

DATA = Path("/root/testdata/sf0.001")
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_repair(rows):
    """rows (turn, role, text) in order -> gaps, blank, duplicate, truncated, illegal, cost, audit, hash."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    n = len(rows)

    @lru_cache(None)
    def best(i, q, inserts):
        """(cost, edits, repaired rows) from row i in state q."""
        found = []
        if i == n and q in (0, 3):
            found.append((0, "", ()))
        if inserts < 3:
            for role in ("user", "assistant"):
                if (q, role[0]) in NEXT:
                    c, e, r = best(i, NEXT[q, role[0]], inserts + 1)
                    found.append((c + 5, "I" + e, ((role, ""), *r)))
        if i < n:
            _, role, text = rows[i]
            c, e, r = best(i + 1, q, 0)
            found.append((c + 2, "D" + e, r))
            if faults[i] in ("", "truncated"):
                more = 5 if faults[i] else 0
                for new, letter, price in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    if (q, new[:1]) in NEXT:
                        c, e, r = best(i + 1, NEXT[q, new[:1]], 0)
                        found.append((c + price + more, letter + e, ((new, text), *r)))
        return min(found, key=lambda x: x[:2]) if found else (10**9, "", ())

    for i in range(n, -1, -1):  # no deep recursion
        for q in range(4):
            best(i, q, 0)
    cost, audit, repaired = best(0, 0, 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


def in_order(rows, conv):
    def key(r):
        name = "-" if conv is None else f"={conv}"
        code = hashlib.sha256(f"{len(name)}:{len(r[1])}:{name}{r[1]}{r[2]}".encode()).digest()[:16]
        return r[0] is not None, r[0] or 0, r[1][:32].encode(), r[2][:32].encode(), code

    return sorted(rows, key=key)


def plain_damage(rows):
    """rows (conv_id, turn, role, text) -> {conv_id: rows after damage}, all conv_ids included."""
    out = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else str(x)
        role, text = one(role), one(text)
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        out[conv] += [row, row] if kind == 3 else [row]
    return out


NAMES = "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"


def random_rows(r, n, conv):
    roles = ["user", "assistant", "system", "tool", "", "ua", None, "u" * 70]
    texts = ["Yes.", "No!", "cut", "", " \t\n", "Why?  ", "é", None, "long " * 40 + "x.", "long " * 40 + "y.", "\x0bend.\x0c"]
    weights = [30, 30, 4, 2, 1, 2, 1, 1]
    return [(conv, r.choice([None, *range(n)]) if r.random() < 0.3 else i, r.choices(roles, weights)[0], r.choice(texts) if r.random() < 0.7 else f"text {r.random()}.") for i in range(n)]


def test_walks_of_any_division_equal_the_exhaustive_search():
    r = random.Random(5)
    for _ in range(300):
        rows = in_order([(t, role or " ", text if text is not None else " ") for _, t, role, text in random_rows(r, r.randint(1, 12), 1)], 1)
        wanted = plain_repair(rows)
        codes, copies, seen = [], [], set()
        for i, (t, role, text) in enumerate(rows):
            bare = text.strip(SPACE)
            if i and rows[i - 1] == (t, role, text):
                copies[-1] += 1
                continue
            fault = conversations.BLANK if not bare else conversations.DUPLICATE if (role, text) in seen else conversations.CLEAN if bare[-1] in ".!?" else conversations.CUT
            seen.add((role, text))
            codes.append({"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + 4 * fault)
            copies.append(1)
        cuts = sorted(r.choices(range(len(codes) + 1), k=2))
        parts = [(codes[a:b], copies[a:b]) for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        m = [conversations.np.array(conversations.transfer(*p)).reshape(4, 4) for p in parts]
        ahead, beyond = [list(conversations.START)], [list(conversations.END)]
        for x in m:
            ahead.append((conversations.np.array(ahead[-1])[:, None] + x).min(axis=0).clip(max=conversations.NEVER).tolist())
        for x in reversed(m):
            beyond.insert(0, (x + conversations.np.array(beyond[0])[None]).min(axis=1).clip(max=conversations.NEVER).tolist())
        optimum = min(a + b for a, b in zip(ahead[-1], conversations.END))
        nodes, audit, cost = 1, "", 0
        for i, p in enumerate(parts):
            a, _, c, nodes = conversations.walk(*p, ahead[i], beyond[i + 1], optimum, nodes, i == 2)
            audit, cost = audit + a, cost + c
        assert (cost, audit) == wanted[5:7] and cost == optimum


@pytest.mark.parametrize("bytes_each", [8 << 20, 400])
def test_repair_equals_the_exhaustive_search(spark, bytes_each):
    r = random.Random(9)
    rows = [x for conv in range(25) for x in random_rows(r, r.randint(1, 14), conv)]
    rows += random_rows(r, 6, None) + [(100, 1, "user", "Again."), (100, 2, "assistant", "Again.")] * 40 + [(101, i, "au"[i % 2] + "x", f"Turn {i}." if i % 7 else "cut") for i in range(300)]
    rows += [(102, None, None, None), (103, -(2**63), "user", "Far."), (103, 2**63 - 1, "assistant", "x" * 500_000 + ".")]
    df = spark.createDataFrame([(*x, 1, "k", 0) for x in rows], "conv_id long, turn long, role string, text string, n int, key string, part int").repartition(5)
    report, repaired = conversations.repair(df, bytes_each)
    digests = {x.conv_id: x.sha256 for x in conversations.digests(repaired).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {x.conv_id: (*(x[c] for c in NAMES[:-1]), digests.get(x.conv_id, empty)) for x in report.collect()}
    of = {}
    for conv, turn, role, text in rows:
        of.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    wanted = {conv: plain_repair(in_order(v, conv)) for conv, v in of.items()}
    wanted[103] = (min(wanted[103][0], 2**63 - 1), *wanted[103][1:])
    assert got == wanted
    roles = {}
    for x in sorted(repaired.collect(), key=lambda x: x.place):
        roles.setdefault(x.conv_id, []).append((x.role or " ")[0])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in roles.values())


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    report, rows = conversations.repair(df)
    assert report.count() == 0 and rows.count() == 0 and conversations.digests(rows).count() == 0


def test_op11_on_hard_rows(spark, tmp_path):
    r = random.Random(3)
    rows = [x for conv in [None, *range(60)] for x in random_rows(r, r.randint(1, 5), conv)]
    rows = list({(c, t): (c, t, a, b) for c, t, a, b in rows}.values())
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.conv_id: tuple(x[c] for c in NAMES) for x in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == {conv: plain_repair(in_order(v, conv)) for conv, v in plain_damage(rows).items()}


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_op11_equals_the_exhaustive_search(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {x.conv_id: tuple(x[c] for c in NAMES) for x in queries.op11_conversation_repair(spark, str(DATA)).collect()}
    assert got == {conv: plain_repair(in_order(v, conv)) for conv, v in plain_damage(rows).items()}
