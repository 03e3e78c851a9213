import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["build_profiles", "match_topics_any", "cluster_from_groups", "topic_funnel", "assemble_digest"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("orders", "documents", "pages", "events"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    rows = lambda x: sorted(map(repr, x))
    assert rows(tuple(r) for r in got.select(*columns).collect()) == rows(want.select(", ".join(columns)).fetchall())
