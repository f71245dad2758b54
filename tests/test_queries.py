"""Every registered spatial query against its SQL on the same tables."""

import duckdb
import pytest

from parallaxis.plans import oracle, queries, scenes, scenes_oracle, structures, structures_oracle
from parallaxis.plans.visible import mark_visible
from parallaxis.sources import fixtures

QUERIES, SQL = queries.QUERIES | scenes.QUERIES | structures.QUERIES, oracle.SQL | scenes_oracle.SQL | structures_oracle.SQL
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(x):
    return x + 0.0 if isinstance(x, float) else x


def in_order(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    found = con.execute(SQL[name])
    names, rows = in_order([d[0] for d in found.description], found.fetchall())
    mine, own = in_order(df.columns, df.collect())
    assert mine == names
    assert own == rows and rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["label", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_labels_take_all_cameras(spark, sf):
    count = lambda cameras: {r["label"]: r["count"] for r in mark_visible(fixtures.points(spark, sf, 2.0), cameras, 8).groupBy("label").count().collect()}
    got = {r["label"]: r["n"] for r in QUERIES["mark_visible_labels"](spark, sf).collect()}
    assert got == count(fixtures.cameras(spark, sf)) != count(fixtures.cameras(spark, sf).where("cam_idx % 6 = 0"))
