"""SimHash, substring dedup, decontamination and line dedup against brute force."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from corpuslake.llm import bytewords, decontaminate, exchange, line_dedup, simhash, simhash_sets, substring_dedup, workspace

SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def corpus():
    """Words that repeat, copies, near copies, odd white space, empty and null texts, a very long one."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["Été", "naïve", "日本", "X-1"]
    text = lambda n: r.choice([" ", " ", "  ", "\n", "\t"]).join(r.choice(words) for _ in range(n))
    rows = [(i, text(r.randint(1, 60))) for i in range(80)]
    rows += [(100 + i, rows[i][1]) for i in range(20)]
    rows += [(130 + i, rows[i][1] + " " + text(3)) for i in range(20)]
    passage = text(30)
    rows += [(200 + i, text(5) + " " + passage + " " + text(5)) for i in range(30)]
    return rows + [(300, None), (301, ""), (302, " \n "), (None, rows[0][1]), (303, text(20000)), (5, rows[5][1])]


def frame(spark, rows, parts=3):
    """Extra columns have the names of results."""
    data = [(i, t, "x", 7) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, n_words string, component_id int").repartition(parts)


def test_words_are_cut_at_documents_and_classes():
    import numpy as np
    import pyarrow as pa

    texts = ["a b", "", "cé-d", None, " x "]
    data, off = bytewords.buffers(pa.array(texts))
    for table, regex in ((bytewords.SPACED, SPACED), (bytewords.ALNUM, ALNUM)):
        w = bytewords.Words(data, off, table)
        got = [[bytes(w.data[a:b]).decode() for a, b in zip(w.start[f:z], w.end[f:z])] for f, z in zip(w.first, w.first[1:])]
        assert got == [regex.findall(t or "") for t in texts]
    same = bytewords.Words(*bytewords.buffers(pa.array(["ab cd ab"])), bytewords.SPACED).hashes()
    assert same[0] == same[2] != same[1] and isinstance(same, np.ndarray)


def test_simhash_matches_brute_force(spark, corpus):
    got = simhash.near_duplicates(frame(spark, corpus), distance=3).collect()
    prints = []
    for i, t in corpus:
        w = SPACED.findall(lower(t))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    up = {f: f for _, f in prints}

    def find(f):
        while up[f] != f:
            f = up[f]
        return f

    distinct = sorted(up)
    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a ^ b).bit_count() <= 3:
                up[find(a)] = find(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    want = sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in prints), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_simhash_links_of_crowded_segments(spark):
    """Chains, and keys with more fingerprints than ``dense``, give the components of brute force."""
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(12)]
    found = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(25)})
    signed = [f - (1 << 64) if f >> 63 else f for f in found]
    prints = spark.createDataFrame(list(zip(signed, range(len(found)))), "fp long, node long")
    for dense in (2, 1000):
        edges = simhash.links(prints, 3, dense).collect()
        assert all((found[e.a] ^ found[e.b]).bit_count() <= 3 for e in edges)
        labels = {r_.node: r_.component for r_ in simhash.components(simhash.links(prints, 3, dense)).collect()}
        up = list(range(len(found)))

        def find(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for i in range(len(found)):
            for j in range(i):
                if (found[i] ^ found[j]).bit_count() <= 3:
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
        assert [labels.get(i, i) for i in range(len(found))] == [find(i) for i in range(len(found))]


@pytest.mark.parametrize("window", [13, 3])
def test_substring_dedup_matches_brute_force(spark, corpus, window):
    got = substring_dedup.repeated_windows(frame(spark, corpus), window).collect()
    first = {}
    for i, t in sorted((x for x in corpus if x[0] is not None), key=lambda x: x[0]):
        w = SPACED.findall(t or "")
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    want = []
    for i, t in corpus:
        w = SPACED.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g), [k for k, g in enumerate(gone) if g]))
    rows = [(r.doc_id, r.n_words, r.n_removed, r.text, [k for s in r.spans for k in range(s.start, s.end)]) for r in got]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_decontamination_matches_brute_force(spark, corpus):
    r = random.Random(1)
    long_words = ALNUM.findall(lower(corpus[-2][1]))
    items = [(str(k), " ".join(long_words[s : s + n])) for k, (s, n) in enumerate((r.randint(0, 500), r.choice([1, 2, 5, 10, 14])) for _ in range(12))]
    items += [("e", ""), ("n", None), (None, "naïve w3"), ("twin", items[0][1])]
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id string, text string, n_hit int")
    windows = {}
    for k, t in items:
        w = ALNUM.findall(lower(t))
        for s in range(max(1, len(w) - 9)):
            if w:
                windows.setdefault(tuple(w[s : s + 10]), set()).add(k)
    want = []
    for i, t in corpus:
        w, found = ALNUM.findall(lower(t)), set()
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if ks := windows.get(tuple(w[s : s + n])):
                    hit[s : s + n] = [True] * n
                    found |= ks
        want.append((i, len(w), sum(hit), sorted(k for k in found if k), [k for k, h in enumerate(hit) if h]))
    for block in (1 << 20, 60):
        got = decontaminate.contamination(frame(spark, corpus), bench, 10, block)
        rows = [(x.doc_id, x.n_words, x.n_hit, list(x["items"]), [k for s in x.spans for k in range(s.start, s.end)]) for x in got.collect()]
        assert sorted(rows, key=str) == sorted(want, key=str)
        assert "component_id" in got.columns


def test_edit_distances_are_exact_up_to_the_limit():
    r = random.Random(1)
    a, b = [], []
    for _ in range(600):
        x = "".join(r.choice("abc") for _ in range(r.randint(0, 25)))
        y = list(x)
        for _ in range(r.randint(0, 4)):
            k = r.randint(0, len(y))
            y[k : k + r.randint(0, 1)] = r.choice(["", "a", "é", "𝄞"])
        a.append(x)
        b.append("".join(y))
    for limit in (1, 2, 3):
        assert line_dedup.edit_distances(a, b, limit).tolist() == [min(edit(x, y), limit + 1) for x, y in zip(a, b)]


@pytest.mark.parametrize("crowded", [64, 2])
def test_line_dedup_matches_brute_force(spark, monkeypatch, crowded):
    """With crowded keys in tiles of three lines, too: classes and numbers of links."""
    monkeypatch.setattr(line_dedup, "CROWDED", crowded)
    monkeypatch.setattr(line_dedup, "TILE", 3)
    r = random.Random(3)
    base = ["".join(r.choice("abcde é") for _ in range(r.randint(5, 14))) for _ in range(40)]

    def line():
        y = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            k = r.randint(0, len(y))
            y[k : k + r.randint(0, 1)] = r.choice(["", "a", "𝄞"])
        return "".join(y)

    docs = [(i, "\n".join(line() for _ in range(r.randint(0, 6)))) for i in range(90)]
    docs += [(900, None), (901, ""), (902, "\n\n"), (None, docs[0][1])]
    first = {}
    for i, t in docs:
        for n, x in enumerate((t or "").split("\n")):
            if i is not None and t is not None and len(x) >= 6:
                first[x] = min(first.get(x, (i, n)), (i, n))
    lines, up, links = sorted(first), {x: x for x in first}, dict.fromkeys(first, 0)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(lines):
        for b in lines[k + 1 :]:
            if abs(len(a) - len(b)) <= 2 and edit(a, b) <= 2:
                links[a] += 1
                links[b] += 1
                up[find(a)] = find(b)
    lead = {}
    for x in lines:
        lead[find(x)] = min(lead.get(find(x), first[x]), first[x])
    want = []
    for i, t in docs:
        kept, n_links, places = [], 0, []
        for n, x in enumerate([] if t is None else t.split("\n")):
            known = i is not None and len(x) >= 6
            places.append(lead[find(x)] if known else (None, None))
            n_links += links[x] if known else 0
            if not known or places[-1] == (i, n):
                kept.append(x)
        total = 0 if t is None else len(t.split("\n"))
        want.append((i, None if t is None else "\n".join(kept), total, total - len(kept), n_links, [p[0] for p in places], [p[1] for p in places]))
    data = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_links int").repartition(3)
    got = line_dedup.dedup_lines(data, 2, 6).collect()
    rows = [(x.doc_id, x.text, x.n_lines, x.n_removed, x.n_links, x.class_docs, x.class_lines) for x in got]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert simhash.near_duplicates(none).count() == 0
    assert substring_dedup.repeated_windows(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, items).count() == 0
    clean = decontaminate.contamination(frame(spark, [(1, "a b"), (2, None)]), items).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in clean) == [(1, 2, 0, []), (2, 0, 0, [])]
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(none, 5, 6)


def test_chains_prune_before_the_hamming_check():
    """Of pairs with an equal segment few come to the later prefixes, and none within the distance is lost that some chain has."""
    import numpy as np

    r = np.random.default_rng(3)
    a = r.integers(0, 2**63, 20000).astype(np.uint64) * np.uint64(2) + r.integers(0, 2, 20000).astype(np.uint64)
    b = r.integers(0, 2**63, 20000).astype(np.uint64)
    b[:500] = a[:500] ^ (np.uint64(1) << r.integers(0, 64, 500).astype(np.uint64))
    distance, found = np.bitwise_count(a ^ b), set()
    for segment in range(simhash.SEGMENTS):
        counts = []
        found |= set(simhash.chained(a, b, np.full(len(a), segment), 3, counts).tolist())
        assert counts[0] == 20000 and counts[1] < 1000 and counts[2] <= counts[1]
    assert found == set(np.flatnonzero(distance <= 3).tolist())


def test_wide_radius_keeps_pairs_of_similarity_080():
    """20,000 pairs of sets at or just over similarity 0.8, small and large: fingerprints lose at most two."""
    import numpy as np

    r = np.random.default_rng(5)
    lost = 0
    for size, extra in ((4, 1), (8, 2), (36, 9), (180, 45)):
        for _ in range(5000):
            v = r.integers(0, 2**63, size + extra).astype(np.uint64) * np.uint64(2) + r.integers(0, 2, size + extra).astype(np.uint64)
            fp = simhash_sets.majority(np.concatenate((v, v[:size])), np.array([0, size + extra, 2 * size + extra]))
            lost += not simhash_sets.close(fp[:1], fp[1:])[0]
    assert lost <= 2


def similar_by_brute_force(rows):
    sets = []
    for i, t in rows:
        w = SPACED.findall(lower(t))
        sets.append((i, {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {" ".join(w)} if w else set()))
    up = {i: i for i, _ in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            both = len(x & y)
            if i == j or 5 * both >= 4 * (len(x) + len(y) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in up}


def test_similar_documents_match_brute_force(spark, corpus, monkeypatch):
    """Edits about the threshold, a crowded group of near copies, a passage in many documents, exact copies, short texts."""
    r = random.Random(11)
    fresh = lambda n: [f"v{r.randrange(100000)}" for _ in range(n)]
    rows = [x for x in corpus if x[0] is not None]
    for i in range(60):
        w = fresh(r.choice([6, 9, 30, 150]))
        rows.append((1000 + 2 * i, " ".join(w)))
        for k in r.sample(range(len(w)), max(1, len(w) * r.choice([1, 2, 3, 4]) // 100)):
            w[k] = "changed"
        rows.append((1001 + 2 * i, " ".join(w)))
    base, passage = fresh(80), fresh(30)
    for i in range(60):
        w = list(base)
        for k in r.sample(range(80), r.randint(0, 2)):
            w[k] = f"x{i}"
        rows.append((2000 + i, " ".join(w)))
        rows.append((3000 + i, " ".join(fresh(40) + passage + fresh(40))))
    want = similar_by_brute_force(rows)
    for sample, blocked in ((4096, 1024), (20, 7)):
        monkeypatch.setattr(simhash_sets, "SAMPLE", sample)
        monkeypatch.setattr(simhash_sets, "BLOCKED", blocked)
        got = simhash.near_duplicates(frame(spark, rows), shingle=5, similarity=(4, 5)).collect()
        assert len(got) == len(rows)
        assert {x.doc_id: x.component_id for x in got} == want
    assert simhash.near_duplicates(frame(spark, []), shingle=5, similarity=(4, 5)).count() == 0


def test_pipeline_drops_documents_of_similarity_080(spark, tmp_path):
    """Two changed words among 100 leave 86 of 106 shingles in common."""
    import corpus_pipeline

    r = random.Random(4)
    rows = []
    for i in range(30):
        w = [f"v{r.randrange(100000)}" for _ in range(100)]
        rows.append((2 * i, " ".join(w)))
        w[20] = w[70] = "changed"
        rows.append((2 * i + 1, " ".join(w)))
    left = corpus_pipeline.near_deduped(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(x.doc_id for x in left.collect()) == list(range(0, 60, 2))


def test_long_lines_link_up_to_a_fortieth_of_their_length(spark):
    """The registered bands, by figures that do not come from them: as many edits link, one more does not."""
    from corpuslake.llm.queries import LINE_BANDS

    r, rows, want = random.Random(9), [], []
    for k, (length, edits) in enumerate([(320, 8), (360, 9), (680, 17), (1240, 31), (3000, 31)]):
        for n, removed in ((edits, 1), (edits + 1, 0)):
            line = "".join(r.choice("abcdefgh ") for _ in range(length))
            at = {int((i + 0.5) * length / n) for i in range(n)}
            first = 100 * k + 10 * removed
            rows += [(first, line), (first + 1, "".join("#" if i in at else c for i, c in enumerate(line)))]
            want += [(first, 0), (first + 1, removed)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), bands=LINE_BANDS).collect()
    assert sorted((x.doc_id, x.n_removed) for x in got) == sorted(want)


def test_long_line_within_three_edits_is_repeated(spark):
    """Of 138 characters three differ."""
    from corpuslake.llm.queries import LINE_BANDS

    line = " ".join(f"word{i:02d}" for i in range(20))[:138]
    rows = [(1, line), (2, line.replace("07", "99").replace("12", "18"))]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), bands=LINE_BANDS).collect()
    assert sorted((x.doc_id, x.n_removed) for x in got) == [(1, 0), (2, 1)]


def test_line_bands_match_brute_force(spark):
    """Short lines repeat exactly or within 1 edit; of long lines more edits count, with few words or many."""
    from corpuslake.llm.queries import LINE_BANDS

    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    base = [word(n) for n in (1, 3, 11, 12, 20, 23, 24, 70, 75, 130, 170)] + [" ".join(word(5) for _ in range(n)) for n in (12, 20, 28, 29, 40)]
    base += ["All rights reserved."]
    lines = []
    for x in base * 5:
        y = list(x)
        for _ in range(r.choice([0, 0, 1, 2, 3, 4, 5])):
            k = r.randint(0, len(y))
            y[k : k + r.randint(0, 1)] = r.choice(["", "z", " "])
        lines.append("".join(y))
    lines += ["", " ", " ", "\r"]
    r.shuffle(lines)
    known = sorted({x for x in lines if x.strip()})
    most = lambda n: max(e for least, e in LINE_BANDS if least <= n)
    up = {x: x for x in known}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(known):
        for b in known[:k]:
            e = most(min(len(a), len(b)))
            if abs(len(a) - len(b)) <= e and edit(a, b) <= e:
                up[find(a)] = find(b)
    seen, want = set(), []
    for i, x in enumerate(lines):
        again = x.strip() and find(x) in seen
        want.append((i, 1 if again else 0))
        seen.add(find(x) if x.strip() else None)
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3), bands=LINE_BANDS).collect()
    assert sorted((x.doc_id, x.n_removed) for x in got) == want


def test_tiles_read_parked_blocks_so_that_lines_travel_once(spark, tmp_path):
    place = f"file://{tmp_path}"
    rows = [(7, i % 3, i, 5, 6, 8, f"line {i}") for i in range(60)] + [(9, 0, 99, 1, 2, 3, "é\U0001f600")]
    df = spark.createDataFrame(rows, "home long, own long, h long, info long, one long, two long, text string").repartition(2, "home", "own").sortWithinPartitions("home", "own")
    found = df.mapInArrow(lambda x: line_dedup._blocks(x, place), "home long, own long, file int, at long, size long").collect()
    assert {(r.home, r.own) for r in found} == {(7, 0), (7, 1), (7, 2), (9, 0)}
    read = line_dedup._reader(place)
    for r in found:
        got = read(r.file, r.at, r.size)
        assert sorted(zip(got["h"].to_pylist(), got["text"])) == sorted((x[2], x[6]) for x in rows if x[:2] == (r.home, r.own))


def test_shuffle_files_go_when_a_table_is_written(spark, tmp_path):
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = held()
    df = spark.range(1000).repartition(3, "id")
    out = workspace.materialise(df, f"file://{tmp_path}/t")
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and out.count() == 1000


def test_every_place_of_a_band_lies_inside_its_lines_and_columns_travel_as_planes():
    for least, edits in [(3, 1), (12, 1), (24, 2), (63, 31), (1240, 31)]:
        texts = ["".join(chr(97 + (7 * i * i + i * n) % 26) for i in range(n)) for n in (least, least + 1, least + edits + 40)]
        c = line_dedup.Chunk(pa.array([1, 2, 3], pa.int64()), texts, least)
        keys, lines, roles = c.keys([(least, edits)], 0)
        segment, off = line_dedup._places(edits)
        size = least // (edits + 1)
        plain = []
        for i in range(3):
            s, e = int(c.start[c.one[i]]), int(c.end[c.one[i]])
            for k, d in zip(segment.tolist(), off.tolist()):
                a = s + k * size + d if k < (edits + 2) // 2 else e + (k - edits - 1) * size + d
                assert s <= a and a + size <= e
                h = c.part(np.array([a]), np.array([a + size])) ^ line_dedup.bw.mix(np.array([least * 64 + k + 1], np.uint64))
                plain.append((int(line_dedup.bw.mix(h)[0]), i, 2 if d else 3))
        assert list(zip(keys.tolist(), lines.tolist(), roles.tolist())) == plain
    for a in (np.arange(1000, dtype=np.int64) << 40, np.arange(5, dtype=np.uint32), np.zeros(1, np.uint8)):
        planes = exchange._turned(a.view(np.uint8).reshape(len(a), a.itemsize))
        assert planes.tobytes() == a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
        assert exchange.parse(exchange.message(0, 1, 2, 3, [a]))[4][0].tolist() == a.tolist()


def test_distances_take_a_limit_for_each_pair_and_skip_what_both_lines_begin_and_end_with(monkeypatch):
    r = random.Random(9)
    a, b = ["", "", "aa", "same", "x" * 70], ["", "b", "a", "same", "x" * 64]
    for _ in range(120):
        x = [r.choice("ab é\U0001d11e\ud800") for _ in range(r.randint(0, 140))]
        y = list(x)
        for _ in range(r.randint(0, 12)):
            k = r.randint(0, len(y))
            y[k : k + r.randint(0, 2)] = r.choice(["", "a", "bb", "é"])
        a.append("".join(x))
        b.append("".join(y))
    limits = np.array([r.choice([0, 1, 2, 5, 8, 15, 16, 31]) for _ in a])
    want = [min(edit(x, y), limit + 1) for x, y, limit in zip(a, b, limits.tolist())]
    for cells in (1 << 21, 300):
        monkeypatch.setattr(line_dedup, "CELLS", cells)
        assert line_dedup.edit_distances(a, b, limits).tolist() == want
    monkeypatch.setattr(line_dedup, "CELLS", 1 << 21)
    matches, compared = line_dedup._matches, []
    monkeypatch.setattr(line_dedup, "_matches", lambda pattern, text, *x: compared.append(text.size) or matches(pattern, text, *x))
    lines = [f"{'long front ' * 90}{k:04d} {k * k:06d}{' long back' * 90}" for k in range(40)]
    assert line_dedup.edit_distances(lines[1:], lines[:-1], 9).tolist() == [edit(x[985:1005], y[985:1005]) for x, y in zip(lines[1:], lines)]
    assert 0 < sum(compared) <= 39 * 20


def test_keys_are_found_among_sorted_ones():
    r = np.random.default_rng(3)
    for size, low in [(1, 0), (2, 63), (500, 0), (500, 20), (500, 50)]:
        keys = np.unique(r.integers(0, 2**64, size, np.uint64) >> np.uint64(low) << np.uint64(low))
        others = r.integers(0, 2**64, 3000, np.uint64) >> np.uint64(low) << np.uint64(low)
        asked = np.unique(np.concatenate((others, keys[::2], np.array([0, 2**64 - 1], np.uint64))))
        for some in (asked, asked[:0], keys, keys[-1:], keys[:1]):
            at, row = line_dedup._finder(keys)(some)
            assert at.tolist() == np.flatnonzero(np.isin(some, keys)).tolist() and (keys[row] == some[at]).all()
