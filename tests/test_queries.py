"""Every query with an oracle against DuckDB at sf0.001."""

import os

import duckdb
import pytest

from zonarium.plans import catalogue

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def flat(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(flat, v)) + "]"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(flat(r[k]) for k in order) for r in data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_duckdb(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rel = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["bm25_topk", "bm25_benchmark_topk", "relevance_filter", "vector_topk", "nearest_within_radius"])
def test_ties_as_in_duckdb(spark, name):
    """Rankings on a table with ties, with sums added in other orders."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{LARGER}/{t}.parquet'")
    rel = con.sql(catalogue.ORACLE_SQL[name])
    want = rows(rel.columns, rel.fetchall())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = catalogue.QUERIES[name](spark, LARGER)
            assert rows(df.columns, df.collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_flagship_is_registered():
    assert catalogue.FLAGSHIP in catalogue.QUERIES
