"""The store: commits as a whole, merges by key, archives."""

import pytest

from corpuslake.sources.tables import DuplicateKeys, Store, archive

STEPS = ("stage", "_put", "commit")


def frame(spark, rows, schema="path string, n int"):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_write_read_and_keys(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert not s.exists("t") and s.read("t", "path string").count() == 0
    with pytest.raises(KeyError):
        s.read("t")
    s.write("t", frame(spark, [("a", 1), ("b", 2)]), ["path"], key=["path"])
    with pytest.raises(DuplicateKeys, match="a"):
        s.write("t", frame(spark, [("a", 1), ("a", 2)]), key=["path"])
    assert rows(s.read("t")) == [("a", 1), ("b", 2)]
    s.write("t", s.read("t").selectExpr("path", "n + 1 AS n"))
    assert rows(s.read("t")) == [("a", 2), ("b", 3)]
    s.write("empty", frame(spark, []))
    assert s.read("empty").count() == 0 and s.read("empty").columns == ["path", "n"]


@pytest.mark.parametrize("step", range(6))
def test_a_failure_at_any_step_leaves_the_old_tables(spark, tmp_path, monkeypatch, step):
    s = Store(spark, str(tmp_path))
    s.commit({"t": [s.stage("t", frame(spark, [("a", 1)]))], "u": [s.stage("u", frame(spark, [("a", 1)]))]})
    calls = []

    def failing(name):
        real = getattr(Store, name)

        def run(self, *args, **kwargs):
            calls.append(name)
            if len(calls) == step + 1:
                raise OSError("lost")
            return real(self, *args, **kwargs)

        return run

    for name in ("stage", "_put"):
        monkeypatch.setattr(Store, name, failing(name))
    try:
        s.commit({"t": [s.stage("t", frame(spark, [("b", 2)]))], "u": [s.stage("u", frame(spark, [("b", 2)]))]})
        failed = False
    except OSError:
        failed = True
    monkeypatch.undo()
    wanted = [("a", 1)] if failed else [("b", 2)]
    assert failed == (step < 4)
    assert rows(s.read("t")) == rows(s.read("u")) == wanted
    s.vacuum()
    assert rows(s.read("t")) == rows(s.read("u")) == wanted


def test_merge_writes_only_files_that_hold_a_key(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.commit({"t": [s.stage("t", frame(spark, [(f"k{i:02}", i) for i in range(40)]).repartitionByRange(4, "path"))]})
    before = set(s._files("t"))
    assert len(before) == 4
    s.merge("t", frame(spark, [("k00", -1), ("new", 7)]), ["path"], gone=frame(spark, [("k01", 0), ("absent", 0)]))
    after = set(s._files("t"))
    assert len(before & after) == 3
    assert rows(s.read("t")) == sorted([("k00", -1), ("new", 7), *((f"k{i:02}", i) for i in range(2, 40))])
    with pytest.raises(DuplicateKeys):
        s.merge("t", frame(spark, [("x", 1), ("x", 2)]), ["path"])
    s.merge("t", s.read("t").where("n = 7").selectExpr("path", "n * 0 AS n"), ["path"])
    assert ("new", 0) in rows(s.read("t")) and s.read("t").count() == 40
    s.merge("t", frame(spark, []), ["path"])
    assert s.read("t").count() == 40 and s.vacuum() > 0 and s.read("t").count() == 40
    assert rows(s.merge("fresh", frame(spark, [("a", 1), ("b", 2)]), ["path"], gone=frame(spark, [("b", 0)]))) == [("a", 1)]


def test_archive_moves_orphans_of_all_tables_at_once(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.write("summaries", frame(spark, [("a", 1), ("b", 2)]))
    s.write("tags", frame(spark, [("b", 5), ("b", 6), ("c", 7)]))
    lost = frame(spark, [("b",), ("b",), (None,), ("zzz",)], "path string")
    assert archive(s, ["summaries", "tags", "absent"], lost, "2024-01-31") == {"summaries": 1, "tags": 2}
    assert rows(s.read("summaries")) == [("a", 1)] and rows(s.read("tags")) == [("c", 7)]
    assert rows(s.read("archive_tags")) == [("b", 5, "2024-01-31"), ("b", 6, "2024-01-31")]
    assert archive(s, ["summaries", "tags"], lost, "2024-02-01") == {} and s.read("archive_tags").count() == 2
