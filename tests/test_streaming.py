"""States of notes over event time: any order of arrival gives what a batch gives."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corpuslake.sources.tables import Store
from corpuslake.streaming.notes_stream import batch_states, keep_states, newest

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
SCHEMA = "path string, ts timestamp, content_hash string"


def events():
    r = random.Random(8)
    rows = [(f"p{r.randrange(25)}", START + datetime.timedelta(hours=r.randrange(24 * 90)), f"h{r.randrange(5)}") for _ in range(300)]
    return rows + [("old", START, "a"), ("old", START, "b"), ("back", START, "a"), ("back", START + datetime.timedelta(days=85), None), (None, START, "x"), ("last", START + datetime.timedelta(days=90), "z")]


@pytest.mark.parametrize("seed", [0, 1])
def test_shuffled_arrival_gives_the_batch_result(spark, tmp_path, seed):
    rows = events()
    random.Random(seed).shuffle(rows)
    for i in range(6):
        spark.createDataFrame(rows[i::6], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    store = Store(spark, f"{tmp_path}/out")
    query = keep_states(stream, store, f"{tmp_path}/checkpoint", "120 days", 20)
    query.awaitTermination()
    now = START + datetime.timedelta(days=90 - 120)
    fields = ("path", "ts", "content_hash", "status", "woken")
    plain = lambda df: sorted(tuple(str(r[c]) for c in fields) for r in df.collect())
    got = store.read("note_states")
    wanted = batch_states(spark.createDataFrame(rows, SCHEMA), now.strftime("%Y-%m-%d %H:%M:%S"), 20)
    assert plain(got) == plain(wanted) and got.count() == 28
    assert got.where("path = 'old'").first().content_hash == "b" and got.where("path = 'back'").first().woken


def test_timers_make_notes_dormant_and_newer_versions_wake_them(spark, tmp_path):
    store, checkpoint = Store(spark, f"{tmp_path}/out"), f"{tmp_path}/checkpoint"
    day = lambda n: START + datetime.timedelta(days=n)

    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        keep_states(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), store, checkpoint, "1 day", 10).awaitTermination()
        return {r.path: (r.status, r.woken) for r in store.read("note_states").collect()}

    assert arrive([("a", day(0), "x"), ("b", day(8), "x")]) == {"a": ("active", False), "b": ("active", False)}
    assert arrive([("c", day(15), "x")]) == {"a": ("dormant", False), "b": ("active", False), "c": ("active", False)}
    assert arrive([("a", day(15), "y")])["a"] == ("active", True)
    got = arrive([("c", day(40), "x")])
    assert got == {"a": ("dormant", True), "b": ("dormant", False), "c": ("active", True)}


def test_newest_version_does_not_depend_on_order(spark):
    rows = [("a", 1, "x", START), ("a", 2, "y", START + datetime.timedelta(days=1)), ("a", 3, "z", START + datetime.timedelta(days=1)), ("b", 4, "q", START)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "path string, n int, content_hash string, ts timestamp").repartition(3, F.rand(1))
        assert sorted((r.path, r.n) for r in newest(df).collect()) == [("a", 3), ("b", 4)]
