"""Operators on inline fixtures: resolution, traversal, communities, ranking, lint, lifecycle, policy."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpuslake.config import EngineConfig
from corpuslake.operators import bm25, dense, graph, lifecycle, lint, models, policy, ranking, report
from corpuslake.plans.engine import KnowledgeEngine
from corpuslake.plans.maintenance import MaintenancePlan
from corpuslake.sources import formats, notes, office, tables


@pytest.fixture(scope="module")
def vault(tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    files = {
        "a/one.md": "---\naliases: [uno]\ntags: [graph]\n---\n# One\n[[two]] [[two|x]] [three](../b/three.md) [[missing]]\n",
        "a/two.md": "# Two\n[[uno]] [[./one]] [self](two.md)\n```\n[[three]]\n```\n",
        "b/three.md": "# Three\n[[dup]] [gone](nope/x.md)\n", "b/dup.md": "dup in b", "a/dup.md": "dup in a [[b/three]]",
        "inbox note.md": "Loose [[dup]]", "README.md": "# no", "_draft.md": "[[two]]", ".hid.md": "hidden", "venv/x.md": "no", "old archive/z.md": "[[two]]",
        "memory/workflow/w.md": "---\ntype: workflow\nfrequency: 0.01\nlast_used: 2025-01-01\n---\n", "memory/.archive/x.md": "x", "empty.md": "",
        "b/pic.png": "x", "b/doc.docx": "x",
    }
    for name, body in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    return str(root)


def test_scan_keeps_hidden_and_drops_excluded(spark, vault):
    got = {r.path: r.content for r in notes.scan_notes(spark, vault).collect()}
    assert set(got) == {"a/one.md", "a/two.md", "b/three.md", "b/dup.md", "a/dup.md", "inbox note.md", "_draft.md", ".hid.md", "old archive/z.md", "empty.md"}
    assert got["_draft.md"] == "[[two]]" and got["empty.md"] == ""
    assert [r.path for r in notes.scan_memory(spark, vault).collect()] == ["memory/workflow/w.md"]
    assert notes.scan_indexable(spark, vault, "all").count() == 11
    with pytest.raises(ValueError):
        notes.scan_indexable(spark, vault, "none")
    with pytest.raises(Exception, match="."):
        notes.scan_notes(spark, vault + "/nowhere").count()
    keys = {r.key: r.path for r in notes.attachments(spark, vault).collect()}
    assert keys == {"pic.png": "b/pic.png", "pic": "b/pic.png", "doc.docx": "b/doc.docx", "doc": "b/doc.docx"}


def test_links_edges_and_broken(spark, vault):
    n = notes.describe(notes.scan_notes(spark, vault)).cache()
    found = graph.resolve(graph.links(n), n).cache()
    edges = {(r.src, r.dst, r.link_syntax): (r["count"], r.raw_target) for r in graph.link_edges(found).collect()}
    assert edges == {
        ("a/one.md", "a/two.md", "wiki"): (2, "two"), ("a/one.md", "b/three.md", "md"): (1, "../b/three.md"), ("a/two.md", "a/one.md", "wiki"): (2, "uno"),
        ("b/three.md", "b/dup.md", "wiki"): (1, "dup"), ("a/dup.md", "b/three.md", "wiki"): (1, "b/three"), ("inbox note.md", "a/dup.md", "wiki"): (1, "dup"),
        ("_draft.md", "a/two.md", "wiki"): (1, "two"), ("old archive/z.md", "a/two.md", "wiki"): (1, "two"),
    }
    broken = {(r.source, r.raw): r.reason for r in graph.broken(found).collect()}
    assert broken == {("a/one.md", "missing"): "basename not found: missing", ("b/three.md", "nope/x.md"): "path not found: nope/x.md"}
    nodes = {r.path: r for r in graph.nodes(n, graph.link_edges(found)).collect()}
    assert nodes["a/two.md"].in_degree_wiki == 3 and nodes["a/two.md"].out_degree_wiki == 1 and nodes["old archive/z.md"].archived
    assert sum(r.in_degree_wiki for r in nodes.values()) == sum(r.out_degree_wiki for r in nodes.values()) == len(edges)
    orphans = {r.path for r in graph.orphans_by_stem(n, graph.links(n)).collect()}
    assert "empty.md" in orphans and "b/dup.md" not in orphans
    assert {r.source for r in graph.find_backlinks(graph.link_edges(found), found, "b/dup.md").collect()} == {"b/three.md"}


def test_broken_link_classes(spark):
    rows = [("wiki", "PDF", "a/x.md"), ("md", "docs/a.md", "a/x.md"), ("wiki", "x/README.md", "a/x.md"), ("wiki", "idea", "my archive/x.md"), ("md", "../pic.png", "a/x.md"), ("md", "[b](c/d", "a/x.md"), ("wiki", "idea", "a/x.md"), ("wiki", "a/b", "a/x.md"), ("wiki", "i" * 31, "a/x.md")]
    data = spark.createDataFrame([(i, s, "", r, p, "") for i, (s, r, p) in enumerate(rows)], "i int, syntax string, display string, raw string, source string, reason string")
    keys = spark.createDataFrame([("pic.png", "b/pic.png")], "key string, path string")
    got = [r.category for r in graph.classify_broken(data, keys).orderBy("i").collect()]
    assert got == ["CLIP-JUNK", "META-DOC", "META-DOC", "ARCHIVED", "ATTACHMENT-EXISTS", "SYNTAX-NOISE", "CONCEPT-CANDIDATE", "REAL-BROKEN", "REAL-BROKEN"]


def edges_frame(spark, rows):
    return spark.createDataFrame([(a, b, t, w, i) for i, (a, b, t, w) in enumerate(rows)], "src string, dst string, type string, weight double, edge_ord int")


def test_traversals_equal_plain_search(spark):
    r = random.Random(3)
    rows = [(f"n{r.randint(0, 14)}", f"n{r.randint(0, 14)}", "user-wikilink", r.choice([0.5, 0.75, 1.0])) for _ in range(30)]
    e = edges_frame(spark, rows)
    for hops in (1, 2, 4):
        dist, frontier = {"n0": 0}, ["n0"]
        for h in range(1, hops):
            frontier = list({b for a, b, _, w in rows if a in frontier and w >= 0.75 and b not in dist})
            dist |= dict.fromkeys(frontier, h)
        want = sorted((b, dist[a] + 1, w) for a, b, _, w in rows if a in dist and w >= 0.75)
        assert sorted((x.path, x.hop, x.weight) for x in graph.neighbors(e, "n0", hops).collect()) == want
    adj = defaultdict(set)
    for a, b, *_ in rows:
        adj[a].add(b)
        adj[b].add(a)
    dist, frontier = {"n0": 0}, ["n0"]
    while frontier:
        frontier = [b for b in {b for a in frontier for b in adj[a]} if b not in dist and not dist.update({b: 1 + min(dist[a] for a in adj[b] if a in dist)})]
    for target in ("n5", "n9"):
        path = graph.shortest_path(e, "n0", target)
        assert len(path) - 1 == dist.get(target, -1) and (not path or (path[0]["path"], path[-1]["path"]) == ("n0", target))
    assert graph.shortest_path(e, "n0", "n0") == [{"path": "n0", "edge_type": "self"}] and graph.shortest_path(e, "n0", "absent") == []


def test_communities_have_the_promised_properties(spark):
    clique = lambda names: [(a, b, "user-wikilink", 1.0) for i, a in enumerate(names) for b in names[i + 1 :]]
    rows = clique("abcd") + clique("efg") + [("d", "e", "semantic", 0.1), ("y", "z", "semantic", 1.0), ("q", "a", "semantic", 1.0)]
    nodes = spark.createDataFrame([(n, n == "q") for n in "abcdefgyzqx"], "path string, archived boolean")
    got = {r.path: r.community_id for r in graph.communities(nodes, edges_frame(spark, rows)).collect()}
    assert got["q"] == -2 and got["x"] == -1
    assert [got[n] for n in "abcd"] == [0] * 4 and [got[n] for n in "efg"] == [1] * 3 and got["y"] == got["z"] == 2


def test_bm25_keeps_empty_chunks_and_ignores_unknown_words(spark):
    chunks = spark.createDataFrame([("a", 0, "x y y"), ("b", 0, ""), ("c", 0, "y z"), ("c", 1, "y")], "path string, chunk_index int, chunk_text string")
    i = bm25.build(chunks)
    stats = i.corpus_stats.first()
    assert stats.n == 4 and stats.avgdl == 1.5
    idf = {r.term: r.idf for r in i.term_stats.collect()}
    assert idf == {"x": 3.5 / 1.5, "y": 1.5 / 3.5, "z": 3.5 / 1.5}
    got = bm25.search(i, "y Y unknown", 10).collect()
    score = lambda tf, dl: idf["y"] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 1.5))
    assert {(r.path, r.chunk_index): round(r.score, 9) for r in got} == {("a", 0): round(score(2, 3), 9), ("c", 0): round(score(1, 2), 9), ("c", 1): round(score(1, 1), 9)}
    assert bm25.search(i, "nothing", 5).count() == 0 and bm25.search(i, "y", 5, dedupe=True).count() == 2


def test_decay_fusion_and_escalation(spark):
    ages = spark.createDataFrame([("a", 0.99), ("b", 1.0), ("c", 2.0), ("d", None)], "path string, age_years double")
    scores = spark.createDataFrame([(p, 1.0) for p in "abcde"], "path string, score double")
    assert {r.path: r.score for r in ranking.decayed(scores, ages, (1.0, 0.8, 0.5)).collect()} == {"a": 1.0, "b": 0.8, "c": 0.5, "d": 1.0, "e": 1.0}
    d = spark.createDataFrame([("a", 0.9), ("b", 0.5)], "path string, score double")
    s = spark.createDataFrame([("b", 4.0), ("c", 2.0)], "path string, score double")
    assert {r.path: round(r.score, 6) for r in ranking.fuse(d, s).collect()} == {"a": 0.6, "b": round(0.6 * 0.5 / 0.9 + 0.4, 6), "c": 0.2}
    assert ranking.fuse(d.limit(0), s.limit(0)).count() == 0
    assert [x.score for x in ranking.fuse(d.where("path = 'a'"), s.limit(0)).collect()] == [0.0]
    assert ranking.triggers(0.55, 1.5, True) == ["low_confidence", "tag_miss", "gray_zone"] and ranking.triggers(0.9, 5, False) == []
    out, why, branches = ranking.escalate(d, "q", 3, age=lambda p: None, tag_missed=True, hybrid=lambda k, w: s)
    assert why == ["tag_miss"] and branches == ["hybrid"] and [r.path for r in out.collect()] == ["b", "c", "a"]
    chunks = spark.createDataFrame([("a", 0, "t"), ("b", 0, "u")], "path string, chunk_index int, chunk_text string")
    assert [r.path for r in ranking.rerank(d, chunks, lambda rows: [1.0, 9.0]).collect()] == ["b", "a"]
    assert [r.path for r in ranking.rerank(d, chunks, lambda rows: 1 / 0).collect()] == ["a", "b"]
    tags = spark.createDataFrame([("a", ["graphs"]), ("b", [])], "path string, tags array<string>")
    assert ranking.tag_miss(d, tags, "what graph", "x/").first().tag_miss is False and ranking.tag_miss(d, tags, "other", "x/").first().tag_miss is True


def test_related_and_mean_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "path string, embedding array<float>")
    for block in (2, 100):
        assert {(r.a, r.b) for r in dense.related(v, least=0.7, block=block).collect()} == {("a", "b"), ("b", "a")}
    m = dense.mean_vectors(v.unionByName(spark.createDataFrame([("a", [0.0, 1.0])], v.schema)))
    assert {r.path: r.embedding for r in m.collect()}["a"] == [0.5, 0.5]


def test_renames_must_be_one_to_one(spark):
    f = lambda rows: spark.createDataFrame(rows, "path string, content_hash string")
    old = f([("a", "1"), ("b", "2"), ("c", "3"), ("d", "3"), ("e", "4"), ("k", "9"), ("g", "7")])
    new = f([("a2", "1"), ("b1", "2"), ("b2", "2"), ("c2", "3"), ("e", "5"), ("k", "9"), ("g2", "8")])
    got = {(r.action, r.old_path, r.new_path) for r in lifecycle.rename_plan(old, new, spark.createDataFrame([("g", "g2")], "old string, new string")).collect()}
    assert got == {("rename", "a", "a2"), ("archive", "b", None), ("archive", "c", None), ("archive", "d", None), ("rename", "g", "g2")}
    table = tables.rewrite_keys(f([("a", "1"), ("z", "0")]), spark.createDataFrame([("a", "a2")], "old string, new string"))
    assert {r.path for r in table.collect()} == {"a2", "z"}


def test_memory_signals_on_boundaries(spark):
    c = EngineConfig(as_of="2026-01-01 00:00:00")
    rows = [
        ("w1", "workflow", 0.04, "2025-07-05", None, None, None, None, None, "BORDERLINE"), ("w2", "workflow", 0.049, "2025-07-04", None, None, None, None, None, "DECAY"),
        ("w3", "workflow", 0.02, "2025-07-05", None, None, None, None, None, "ACTIVE"), ("w4", "workflow", None, "2025-07-05", None, None, None, None, None, "UNKNOWN"),
        ("f1", "feedback", None, None, "active", "2025-07-04", 5, None, None, "DORMANT"), ("f2", "feedback", None, None, "active", "2025-07-05", 3, None, None, "STABLE"),
        ("f3", "feedback", None, None, "dormant", "2024-12-31", 0, None, None, "ARCHIVE"), ("f4", "feedback", None, None, "dormant", "2025-01-01", 0, None, None, "DORMANT"),
        ("f5", "feedback", None, None, None, None, 9, None, None, "UNKNOWN"), ("f6", "feedback", None, None, "odd", "2020-01-01", 0, None, None, "ACTIVE"),
        ("p1", "project", None, None, None, None, None, "complete", "2025-10-02", "STALE"), ("p2", "project", None, None, None, None, None, "complete", "2025-10-03", "FRESH"),
        ("p3", "project", None, None, None, None, None, "active", "2020-10-03", "ACTIVE"), ("r", "reference", None, None, None, None, None, None, None, "INACTIVE"),
    ]
    m = spark.createDataFrame(rows, "path string, type string, frequency double, last_used string, liveness string, last_confirmed string, confirmed_count int, status string, completed_at string, want string").withColumn("changed_at", F.lit(None).cast("timestamp"))
    assert [(r.path, r.signal) for r in lifecycle.memory_signals(m, c).collect() if r.signal != r.want] == []


def test_gates_and_plans(spark):
    c = EngineConfig(large_bytes=10)
    files = spark.createDataFrame([("s", 10), ("a", 11), ("k", 11), ("l", 11), ("p", 11)], "path string, size_bytes long")
    rules = spark.createDataFrame([("- `a` -> allow\nk -> skip\nk -> skip\nl -> skip\nl -> llm_skip",)], "text string")
    pol = formats.large_file_policy(rules)
    assert {r.path: r.gate for r in lifecycle.gate(files, pol, c).collect()} == {"s": "pass", "a": "pass", "k": "skip", "l": "llm_skip", "p": "pending"}
    ledger = spark.createDataFrame([("p", 11, "2020-01-01", "2020-01-02")], "path string, size_bytes long, first_detected string, last_seen string")
    assert {(r.path, r.first_detected) for r in lifecycle.oversize_ledger(files, ledger, pol, "2026-01-01", c).collect()} == {("p", "2020-01-01"), ("k", "2026-01-01")}


def test_lint(spark):
    n = spark.createDataFrame([("a", "**GraphRAG** **GraphRAG** `Spark` `spark` **知识图谱** in 2019-04 x"), ("b", "**GraphRAG** **知识图谱** 2030 and 2018 year"), ("c", "x2019 20190 nothing 2025"), ("d", "**知识图谱**")], "path string, content string")
    terms = lint.concept_terms(n)
    names = spark.createDataFrame([("graphrags",)], "basename string")
    assert [(r.term, r["count"]) for r in lint.orphan_concepts(terms, names).collect()] == [("知识图谱", 3)]
    assert {(r.path, r.year) for r in lint.stale_years(n, 2026).collect()} == {("a", 2019), ("b", 2018)}
    ctx = lint.concept_contexts(spark.createDataFrame([("a", "First. " + "x" * 100 + " the Term here. Last.")], "path string, content string"), "term").first().context
    assert "the Term here" in ctx and "Last" in ctx
    key = "sk-" + "a1" * 10
    hits = spark.createDataFrame([(key,), ("sk-short",), ("AK" + "IA" + "A" * 16,), ("-----BEGIN " + "RSA PRIVATE KEY-----",)], "c string")
    assert [r.x for r in hits.select(lint.secrets_in(F.col("c")).alias("x")).collect()] == [["api_key"], [], ["access_key"], ["private_key"]]
    files = spark.createDataFrame([("我的密码.md",), ("My-Passwd.txt",), ("id_rsa",), ("note.md",), ("身份证1.jpg",)], "n string")
    assert [r.x for r in files.select(lint.private_name(F.col("n")).alias("x")).collect()] == [True, True, True, False, True]


def test_policy(spark):
    tokens = lambda *t: spark.createDataFrame([(x,) for x in t], "token string")
    assert {r.token for r in policy.unmatched_tokens(tokens("a/", "b/c.md", "d.md", "e/"), tokens("`a/x.md`", "./b/", "d.md")).collect()} == {"e/"}
    calls = spark.createDataFrame([("1", "Edit", {"file_path": "./a/private/x.md"}), ("2", "Glob", {"path": "a/private/y"}), ("3", "Write", {"path": "docs/CHANGELOG.md", "n": "z"})], "call_id string, tool string, input map<string,string>")
    p = policy.tool_paths(calls)
    assert [r.call_id for r in policy.private_access(p, ["**/private/**"]).collect()] == ["1"]
    assert [r.call_id for r in policy.redirected_edits(p, "CHANGELOG.md").collect()] == ["3"]
    assert [(r.call_id, r.rule) for r in policy.first_denial(p, [("docs/**", "no"), ("**/x.md", "never")]).orderBy("call_id").collect()] == [("1", 1), ("3", 0)]
    plans = spark.createDataFrame([("a", "- [x] 1\n- [X] 2"), ("b", "- [ ] 1\n- [x] 2"), ("c", "none")], "path string, content string")
    assert [r.path for r in policy.archive_ready(plans).collect()] == ["a"]


def test_sidecars_plans_and_bands(spark):
    files = spark.createDataFrame([("plans/active/a.md", "---\nstatus: active\n---"), ("plans/active/b.md", "---\nstatus: done\n---"), ("plans/active/README.md", "x"), ("plans/completed/c.md", "x"), ("x.md", "")], "path string, content string")
    assert {r.path for r in policy.status_mismatches(policy.plan_files(files)).collect()} == {"plans/active/b.md", "plans/completed/c.md"}
    side = spark.createDataFrame([("s/a.md", "---\nsource: a.md\n---"), ("s/b.md", "---\nsource: c.md\n---"), ("s/d.md", "")], "path string, content string")
    assert [(r.path, r.problem) for r in policy.sidecar_issues(policy.sidecar_sources(side, "s/")).collect()] == [("s/b.md", "wrong"), ("s/d.md", "missing")]
    rel = spark.createDataFrame([("a", "x/b.md", 0.85), ("a", "c", 0.755), ("a", "d", 0.69)], "a string, b string, similarity double")
    assert {(r.target, r.band) for r in graph.related_bands(rel).collect()} == {("b", "strong"), ("c", "weak")}
    assert {r.weight for r in graph.semantic_edges(rel, legacy_rounding=True).collect()} == {0.85, 0.76}
    assert formats.protected_directories("# Protected dirs\n- `a/`\n- b/c\n* 1【x】\n## other\n- d") == {"a", "1【x】"} and formats.protected_directories("", "p, q") == {"p", "q"}


def test_formats_and_reports(spark):
    log = spark.createDataFrame([("# log\n## 2024-02-02\n### [10:00] New\nbody\n### Plain\n## 2024-01-01\n### 9:30 Old\nx y\n",)], "text string")
    e = formats.log_entries(log).cache()
    assert [(r.date, r.time, r.title, r.body) for r in e.orderBy("day_pos", "pos").collect()] == [("2024-02-02", "10:00", "New", "body"), ("2024-02-02", None, "Plain", ""), ("2024-01-01", "9:30", "Old", "x y")]
    assert formats.recent(e, 10, "2024-02-05").count() == 2 and formats.show(e, match="X Y").count() == 1 and formats.titles(e, 1).first().title == "New"
    assert formats.replace_section("a <b>old<e> c", "new", "<b>", "<e>") == "a <b>\nnew\n<e> c" and formats.replace_section("", "n", "<b>", "<e>") == "<b>\nn\n<e>\n"
    assert report.synthesis_name("t", {"t", "t-v2"}) == "t-v3"
    assert "| a |" in report.markdown("R", {"x": spark.createDataFrame([(1,)], "a int")})


def test_office_text(spark, tmp_path):
    import zipfile

    def pack(name, files):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for k, v in files.items():
                z.writestr(k, v)

    w = 'xmlns:w="w"'
    pack("a.docx", {"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>x</w:t></w:p></w:tc><w:tc><w:p><w:t>y</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
    pack("b.XLSX", {"xl/workbook.xml": '<w><sheets><sheet name="S"/></sheets></w>', "xl/sharedStrings.xml": "<sst><si><t>k</t></si></sst>", "xl/worksheets/sheet1.xml": '<w><row><c t="s"><v>0</v></c><c><v>5</v></c></row></w>'})
    pack("c.pptx", {"ppt/slides/slide1.xml": '<sld xmlns:a="a"><a:p><a:t>Title</a:t></a:p></sld>', "ppt/notesSlides/notesSlide1.xml": '<sld xmlns:a="a"><a:t>said</a:t></sld>'})
    (tmp_path / "bad.docx").write_text("no zip")
    (tmp_path / "old.doc").write_text("x")
    got = {r.path: (r.text, r.status) for r in office.extract(office.scan_office(spark, str(tmp_path))).collect()}
    assert got["a.docx"] == ("Hello\nx | y", "ok") and got["b.XLSX"] == ("## Sheet: S\nk | 5", "ok") and got["c.pptx"] == ("## Slide 1\nTitle\nNotes: said", "ok") and got["bad.docx"][1] == "fail"
    assert [r.path for r in office.scan_legacy(spark, str(tmp_path)).collect()] == ["old.doc"]


def test_maintenance_then_queries(spark, vault, tmp_path):
    store, model = tables.Store(spark, str(tmp_path)), models.HashingEmbedder(32)
    scanned = notes.scan_notes(spark, vault)
    for _ in range(2):
        out = MaintenancePlan(store, EngineConfig(related_least=0.2, semantic_edge=0.3), model).run(scanned)
    assert out["changes"].count() == 0 and out["nodes"].count() == 10
    engine = KnowledgeEngine(spark, store, EngineConfig(), model)
    assert engine.search("dup", "bm25", 3).first().path in ("a/dup.md", "b/dup.md", "inbox note.md")
    for mode in ("auto", "dense", "hybrid"):
        assert engine.search("three dup", mode, 3).count() > 0
    assert {r.source for r in engine.backlinks("a/two.md").collect()} >= {"a/one.md"}
    assert engine.path("inbox note.md", "b/three.md")[-1]["path"] == "b/three.md"
    assert engine.neighbors("a/one.md").count() > 0 and engine.check_duplicate("dup in a").count() > 0


def test_note_stream_upserts(spark, tmp_path):
    from corpuslake.streaming.notes_stream import SCHEMA, keep_current, note_stream

    root, store, seen = tmp_path / "in", tables.Store(spark, str(tmp_path / "out")), []
    root.mkdir()
    (root / "a.md").write_text("one")
    for _ in range(2):
        keep_current(note_stream(spark, str(root)), store, str(tmp_path / "cp"), lambda d: seen.append({r.action for r in d.collect()})).awaitTermination(120)
        (root / "b.md").write_text("two")
    assert {r.content for r in store.read("notes", SCHEMA).collect()} == {"one", "two"} and seen == [{"add"}, {"add"}]


def test_similar_renames_are_the_same_however_many_hashes_count_as_common(spark, monkeypatch):
    g = random.Random(5)
    word = lambda: f"w{g.randrange(4000)}"
    shared = " ".join(word() for _ in range(40))
    old = [(f"o{i:02}", f"{shared} " + " ".join(word() for _ in range(40 + 5 * i))) for i in range(24)]
    new = [(f"n{p[1:]}", t if i % 5 == 0 else t + " " + " ".join(word() for _ in range(3 * (i % 4)))) for i, (p, t) in enumerate(old)]
    frames = [spark.createDataFrame(x, "path string, content string").select("path", lifecycle.signature(F.col("content")).alias("sig")).cache() for x in (old, new + [("blank", " "), ("none", None)])]
    assert dict(frames[0].dtypes)["sig"] == "array<bigint>"  # eight bytes for a hash, not its text
    left, right = ({r.path: set(r.sig or ()) for r in x.collect()} for x in frames)
    alike = {(a, b): len(x & y) / max(len(x), len(y)) for a, x in left.items() for b, y in right.items() if x & y}
    alike = {k: v for k, v in alike.items() if v >= 0.8}
    top = lambda i, k: min((-v, *p) for p, v in alike.items() if p[i] == k)[1:]
    want = {p for p in alike if top(0, p[0]) == p and top(1, p[1]) == p}
    assert len(want) > 10
    for most in (0, 3, 100_000):
        monkeypatch.setattr(lifecycle, "COMMON", most)
        assert {(r.old, r.new) for r in lifecycle.similar_renames(*frames).collect()} == want
