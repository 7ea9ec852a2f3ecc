"""Column functions on inline fixtures."""

import pytest
from pyspark.sql import functions as F

from corpuslake.functions import globs, links, paths, text, vectors

import re


def apply(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_tokens_of_cjk_latin_and_accents(spark):
    got = apply(spark, ["知", "知识", "知识库", "AI知识 x1", "Café", "", "12-a"], text.tokenize)
    assert got == [["知", "知"], ["知识", "知", "识", "知识"], ["知识库", "知", "识", "库", "知识", "识库"], ["ai", "知识", "知", "识", "知识", "x1"], ["caf"], [], ["12", "a"]]


@pytest.mark.parametrize("n,lengths", [(0, [0]), (3000, [3000]), (3001, [3000, 301]), (5700, [3000, 3000]), (5701, [3000, 3000, 301])])
def test_window_lengths(spark, n, lengths):
    assert [len(c) for c in apply(spark, ["é" * n], text.chunks)[0]] == lengths


def test_sections_follow_second_level_headings_only(spark):
    values = ["## a\nx\n## b", "\n \n## a", "x\n## a", "### a\n## b", "##　a", "a\r## b", "##x", "a\n##\tb", "a ## b"]
    assert apply(spark, values, text.sections) == [["## a\nx\n", "## b"], ["## a"], ["x\n", "## a"], ["### a\n", "## b"], ["##　a"], ["a\r## b"], ["##x"], ["a\n", "##\tb"], ["a ## b"]]


def test_lines_are_those_of_splitlines(spark):
    values = ["a\nb", "a\r\nb\n", "", "\n", "a b\x0bc\x1dd\x85e", "\n\na"]
    assert apply(spark, values, text.lines) == [v.splitlines() for v in values]


def test_content_lines_skip_fences_and_inline_code(spark):
    value = "a `x` b\n```\n[[no]]\n~~~\n```\nc\n~~~py\nd\n```\n~~~\ne"
    assert [(r.line_no, r.line) for r in apply(spark, [value], text.content_lines)[0]] == [(1, "a  b"), (6, "c"), (11, "e")]


def test_front_matter_forms(spark):
    values = ["---\naliases: [a, 'b' ,\"c\"]\n---\nx", "---\naliases:\n  - a\n  - \"b c\"\n---", "---\nalias: one\n---", "no", "---\naliases: [x]"]
    assert apply(spark, values, text.aliases) == [["a", "b", "c"], ["a", "b c"], ["one"], [], []]
    tags = ["---\ntags: [A, b]\n---", "---\ntags:\n  - X\n  - y\n---", "---\ntags: p, Q\n---", "---\nt: 1\n---"]
    assert apply(spark, tags, text.frontmatter_tags) == [["a", "b"], ["x", "y"], ["p", "q"], []]
    fields = ["---\nstatus: done\n---", "---\nmetadata:\n  x: 1\n  status: 'old'\n---", "---\nother: 1\n---", "status: no"]
    assert apply(spark, fields, lambda c: text.field(c, "status")) == ["done", "old", None, None]
    assert apply(spark, ["---\nsource: a\nb: 1\n---\nx", "none"], lambda c: text.set_field(c, "source", F.lit("new"))) == ["---\nsource: new\nb: 1\n---\nx", "none"]
    assert [tuple(x) for x in apply(spark, ["---\na: 1\n---\nb", "---\nopen", "b"], text.strict_split)] == [("a: 1\n", "b", True), ("", "---\nopen", False), ("", "b", True)]


def test_front_matter_map(spark):
    got = apply(spark, ["---\na: 1\nb: 'x: y'\na: 2\nc:\n  - z\n---", "none"], text.frontmatter_map)
    assert got == [{"a": "1", "b": "x: y"}, {}]


def test_titles_tags_and_slugs(spark):
    assert apply(spark, ["x\n# T \n", "## no", "\n" * 31 + "# late"], text.heading) == ["T", None, None]
    assert apply(spark, ["#b x #a/c y#no\n##no #b"], text.inline_tags) == [["a/c", "b"]]
    assert apply(spark, ["- #x\n- #y z\n-  #x\n#no"], text.tag_lines) == [["x", "y"]]
    assert apply(spark, ["Héllo, wörld! 知识", "!!", "a" * 60], text.slug) == ["Héllo-wörld-知识", "untitled", "a" * 50]
    assert apply(spark, ["---\na: 1\n---\n# h\n\n first line\nmore"], text.first_line) == ["first line"]
    assert apply(spark, ["2024-02-30", "2024-02-29x", "no", None], lambda c: text.date_of(c).cast("string")) == [None, "2024-02-29", None, None]
    assert apply(spark, ["GraphRAG", "graph", "AI系统", "知识图谱", "了解", "x架构"], text.proper_noun) == [True, False, True, True, False, True]


def test_inline_link_scanner():
    cases = {
        "[a](b.md)": [("a", "b.md")], "![a](b.png)": [], "[a](b(c)d.md) [e](f)": [("a", "b(c)d.md"), ("e", "f")],
        r"[a\]b](c\)d)": [("a\\]b", "c\\)d")], "[a](< x y.md >)": [("a", "x y.md")], "[a] (b)": [], "[a](b": [], "[[w]] [x](y)": [("x", "y")], "[a](b)![c](d)[e](f)": [("a", "b"), ("e", "f")],
    }
    for line, want in cases.items():
        assert links.scan_inline_links(line) == want, line


def test_wiki_targets_and_candidates(spark):
    assert apply(spark, ["[[a]] [[ b |c]] [[d#e|f]] [[#x]] [[g\\]]"], links.wiki_targets) == [["a", "b", "d", "g\\"]]
    cases = {"a/b": True, "b.md": True, "x.pdf": True, "http://a.b/c.md": False, "mailto:a": False, "www.x.com/a": False, "a@b.md": False, "#x": False, "example.com/a": False, "x.xyz": False, "plain": False, "a%20b/c.md#h": True, "a/b?x": True, "": False, "%zz/a": True}
    assert apply(spark, list(cases), links.internal_candidate) == list(cases.values())


def test_paths(spark):
    values = ["a.md", "x/y/20240102_b.md", "x/.hid", "x/old archive/c.tar.gz"]
    assert apply(spark, values, paths.stem) == ["a", "20240102_b", ".hid", "c.tar"]
    assert apply(spark, values, paths.suffix) == [".md", ".md", "", ".gz"]
    assert apply(spark, values, lambda p: paths.category(p, "(inbox)")) == ["(inbox)", "x", "x", "x"]
    assert apply(spark, values, lambda p: paths.archived(p, ("archive",))) == [False, False, False, True]
    assert apply(spark, values, lambda p: paths.leading_date(paths.file_name(p))) == ["-", "2024-01-02", "-", "-"]
    assert apply(spark, ["a/../b/./c", "../x", "a//b", "a/b/../../.."], paths.normalised) == ["b/c", "../x", "a/b", ".."]
    assert apply(spark, ["README.md", "x/README.md", ".git/a", "a/venv/b", "venv"], lambda p: paths.excluded(p, {"venv", ".git"}, {"README.md"})) == [True, False, True, True, False]
    pairs = spark.createDataFrame([("a/b/c.md", "a/b/d.md", 2), ("a/b/c.md", "a/x/d.md", 1), ("c.md", "a/d.md", 0), ("a/b/c", "a/b/c/d", 2)], "a string, b string, n long")
    assert all(r.n == r.m for r in pairs.select("n", paths.common_directories(F.col("a"), F.col("b")).alias("m")).collect())
    with pytest.raises(ValueError):
        paths.in_scope(F.col("p"), "some", "m/")


def test_globs():
    match = lambda p, x: bool(re.match(globs.segment_regex(p), x))
    assert [match("a/**/b*.md", x) for x in ("a/b.md", "a/x/y/bc.md", "a/b/c.md")] == [True, True, False]
    assert [match("a/**", x) for x in ("a", "a/b", "ab")] == [True, True, False] and match("**", "x/y") and not match("*", "x/y")
    assert re.match(globs.fnmatch_regex("n[!a]te*.md"), "note/x.md") and not re.match(globs.fnmatch_regex("n[!o]te*"), "note")


def test_cosines(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 2.0], [2.0, 4.0])], "a array<float>, b array<float>")
    got = rows.select(vectors.cosine_related(F.col("a"), F.col("b")).alias("r"), vectors.cosine_search(F.col("a"), F.col("b")).alias("s")).collect()
    assert got[0].r == 0 and got[0].s == 0 and abs(got[1].r - 1) < 1e-12 and abs(got[1].s - 1) < 1e-9
