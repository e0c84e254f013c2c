"""Queries on rows that the small tables do not have: values on a limit, many rows in one place, odd dates."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import rows

from zonarium.operators import spatial
from zonarium.plans import catalogue


def check(spark, folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(folder))
    rel = con.sql(catalogue.ORACLE_SQL[name])
    got = rows(df.columns, df.collect())
    assert sorted(df.columns) == sorted(rel.columns) and got == rows(rel.columns, rel.fetchall())
    return df, got


def test_contradictions_on_the_limit(spark, tmp_path):
    """A ratio of exactly 1.5 times 1.15 is no contradiction."""
    k = F.col("id")
    spark.range(3000).select(k.alias("o_orderkey"), (17250 + k % 300 * 172.5).alias("o_totalprice"), F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    check(spark, tmp_path, "contradictions", "orders")


def test_dates_as_written(spark, tmp_path):
    texts = [(0, "12/13/1998 and 1/2/2003"), (1, "99.99.099"), (2, "API 12 on 31/0/1999"), (3, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check(spark, tmp_path, "instrument_mentions", "documents")


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """As many suppliers and customers as stand several in every place."""
    folder = tmp_path_factory.mktemp("crowded")
    spark.range(6_000).select(F.col("id").alias("s_suppkey")).write.parquet(f"{folder}/supplier.parquet")
    spark.range(4_000).select(F.col("id").alias("c_custkey"), F.lit(0.0).alias("c_acctbal")).write.parquet(f"{folder}/customer.parquet")
    return folder


def test_equal_zones_meet_equal_points_once(spark, crowded, monkeypatch):
    from zonarium.plans import place_queries as q

    met = []
    join = q.spatial_join
    monkeypatch.setattr(q, "spatial_join", lambda p, z, rings: met.append((p.count(), z.count())) or join(p, z, rings))
    check(spark, crowded, "zones_with_holes_at_points", "customer", "supplier")
    assert met == [(1000, 3000)]


def test_nearest_of_many_in_one_place(spark, crowded, monkeypatch):
    met = []
    within = spatial.within_radius
    monkeypatch.setattr(spatial, "within_radius", lambda p, o, *a: met.append((p.count(), o.count())) or within(p, o, *a))
    check(spark, crowded, "nearest_within_radius", "customer", "supplier")
    assert met == [(1000, 3000)]


@pytest.mark.parametrize("name, source, key", [("measured_setback", "part", "p_partkey"), ("hinted_tables", "part", "p_partkey"), ("gml_shapes", "supplier", "s_suppkey")])
def test_costly_rows_of_one_small_file_go_to_every_core(spark, tmp_path, name, source, key):
    spark.range(0, 600, 1, 1).select(F.col("id").alias(key), (F.col("id") % 50 + 1).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/{source}.parquet")
    df, _ = check(spark, tmp_path, name, source)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_block_values_are_those_with_traces(spark):
    from zonarium.functions import ordinance as o

    texts = ["Altura máxima de 7,50 metros. Muro con altura máxima de 2 metros. Ocupación do 40 %.", "6,10 metros para 2 plantas e 9,35 metros para 3 plantas", "nada", None]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    both = t.select(o.block_parameters(F.col("t")).alias("a"), o.block_values(F.col("t")).alias("b")).collect()
    assert [[(p.parameter, p.value) for p in r.a or []] for r in both] == [[tuple(p) for p in r.b or []] for r in both] and both[0].b and both[1].b


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_setbacks_are_measured_a_batch_at_a_time(spark, tmp_path):
    """No loop of interpreted expressions over corners and edges, and one call of Python for all columns."""
    spark.range(0, 3000, 1, 1).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    df, _ = check(spark, tmp_path, "measured_setback", "part")
    made = plan(df).split("Initial Plan")[0]
    assert made.count("ArrowEvalPython") == 1 and "transform(" not in made


def test_habitability_sorts_rooms_once(spark, tmp_path):
    """Equal quantities, largest rooms without an area, single rooms and more rooms than the table of minima has."""
    k = F.col("id")
    lines = spark.range(4000).select((k % 701).alias("l_orderkey"), (k * 7 % 13).alias("l_partkey"), (k % 5 + 1).cast("int").alias("l_linenumber"), (k * 31 % 45).cast("double").alias("l_quantity"))
    lines.unionByName(lines.where("l_orderkey < 90").withColumn("l_linenumber", F.col("l_linenumber") + 5)).write.parquet(f"{tmp_path}/lineitem.parquet")
    df, got = check(spark, tmp_path, "habitability", "lineitem")
    assert len(got) > 600 and plan(catalogue.QUERIES["habitability"](spark, str(tmp_path))).count("Sort [") == 1


def test_habitability_checks_sort_rooms_once(spark, tmp_path):
    spark.range(300).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    check(spark, tmp_path, "habitability_verdicts", "orders")
    made = plan(catalogue.QUERIES["habitability_checks"](spark, str(tmp_path)))
    assert made.count("Sort [") <= 3 and made.count("SortMergeJoin") <= 1  # rooms, dwellings, and dwellings for the join


def test_rooms_and_dwellings_that_do_not_meet(spark):
    from zonarium.operators import habitability as h

    columns = "id long, pos int, nombre string, tipo string, superficie double, ancho double, lado double, acristalada double, ventilacion double, exterior int"
    rooms = spark.createDataFrame([(1, 1, "salon", "estancia_mayor", 26.0, 3.0, 3.4, 4.0, 1.5, 1), (9, 1, "salon", "estancia_mayor", 8.0, 3.0, 3.4, 1.0, None, 1)], columns)
    dwellings = spark.createDataFrame([(1, "x", 2.6, True), (2, "x", None, False), (1, "y", 2.4, True)], "id long, operacion string, altura double, completo boolean")
    got = h.habitability_checks(spark, dwellings, rooms).collect()
    of = lambda i: sorted((r.codigo, r.estado) for r in got if r.id == i)
    assert of(9) == [("iluminacion_salon", "cumple"), ("ventilacion_salon", "no_verificable")]
    assert ("altura_libre", "no_verificable") in of(2) and ("programa_estancia_mayor", "no_verificable") in of(2) and not any(c.startswith("exterior") for c, _ in of(2))
    assert [c for c, _ in of(1)].count("altura_libre") == 2 == [c for c, _ in of(1)].count("superficie_e1") and [c for c, _ in of(1)].count("iluminacion_salon") == 1
