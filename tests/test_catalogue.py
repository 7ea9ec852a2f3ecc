"""Catalogue queries against their SQL, where the test tables are there."""

from pathlib import Path

import pytest

import __spark_entry__

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["token_stats", "bm25_search_scoped", "dense_decay", "related_notes", "rename_diff", "incremental_plan", "wikilink_edges", "broken_links", "community_stats", "lifecycle_channels", "stale_years", "page_links", "bm25_vocabulary", "rename_changed", "term_contexts", "note_states", "vault_links", "vault_broken"]

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    plain = lambda v: round(float(v), 6) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[k]) for k in columns) for r in df.collect()), key=repr)
    cursor = c.execute(__spark_entry__.oracle_sql()[name])
    at = [[d[0] for d in cursor.description].index(k) for k in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)


def test_every_query_of_the_core_has_sql():
    missing = {n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"} - set(__spark_entry__.oracle_sql())
    assert missing == {"louvain_communities"}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
