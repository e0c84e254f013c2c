"""Literal expectations for functions and readers."""

import json

import pytest
from pyspark.sql import functions as F

from zonarium.functions import geometry as g
from zonarium.functions import rules, sequential, sun
from zonarium.functions import text as t
from zonarium.operators import lookups, metrics, quality, retrieval, spatial, windows
from zonarium.sources import readers, sinks
from zonarium.sources.literals import relation


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_numbers(spark):
    r = one(spark, t.spanish_number(F.lit("10.000,5")), t.spanish_number(F.lit("1.000")), t.spanish_number(F.lit("1,5")), t.spanish_number(F.lit("x")), t.fraction(F.lit("40 %")), t.number(F.lit("0,7")), t.formatted(F.lit(12.5)), t.formatted(F.lit(12.0)))
    assert tuple(r) == (10000.5, 1000.0, 1.5, None, 0.4, 0.7, "12,5", "12")


def test_terms_and_codes(spark):
    r = one(spark, t.terms(F.lit("El Plan de ORDENACIÓN, año 2008 y más")), t.code_key(F.lit("u1.2-b")), t.subzone_key(F.lit(" U 1-2.")), t.area_code(F.lit("pp 3-b")), t.zone_class(F.lit("Casco Histórico")))
    assert r[0] == ["plan", "ordenacion", "ano", "2008"]
    assert tuple(r)[1:] == ("U12B", "u12", "PP-3-B", "historico")


def test_parapet_is_no_height(spark):
    assert one(spark, t.extracted_height(F.lit("peto de 1,10 m; altura maxima 8,5 m")))[0] == 8.5


def test_percentile_interpolates(spark):
    assert spark.range(1, 11).agg(F.percentile("id", 0.9)).first()[0] == pytest.approx(9.1)


def test_rank_fusion(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "k string, rank int")
    got = {r["k"]: r["score"] for r in retrieval.reciprocal_ranks([a, b], "k").collect()}
    assert got["y"] == pytest.approx(1 / 62 + 1 / 61) and got["y"] > got["x"] > got["z"]


def test_costs(spark):
    c = rules.conversion_costs(*(F.lit(x) for x in (100.0, 400.0, 5000.0, 300.0, 120000.0, 900.0)))
    r = one(spark, *(v.alias(k) for k, v in c.items()))
    assert (r["obra"], r["inversion"], r["por_m2"], r["beneficio"]) == (40000.0, 45300.0, 453.0, 74700.0)
    none = rules.conversion_costs(*(F.lit(None).cast("double") for _ in range(6)))
    assert set(one(spark, *none.values())) == {None}


def test_sun_at_noon_in_june(spark):
    e, a = sun.sun(F.lit(42.0), F.lit(0.0), F.lit(172), F.lit(12))
    r = one(spark, e, a)
    assert r[0] == pytest.approx(71.4, abs=0.3) and r[1] == pytest.approx(180, abs=3)


def test_mercator_round_trip(spark):
    x, y = sun.mercator(F.lit(-8.7), F.lit(42.2))
    lon, lat = sun.from_mercator(x, y)
    assert tuple(one(spark, lon, lat)) == pytest.approx((-8.7, 42.2))


def test_ring(spark):
    ring = g.rectangle(F.lit(0.0), F.lit(4.0), F.lit(0.0), F.lit(3.0))
    r = one(spark, g.area(ring), g.length(ring), g.contains(ring, F.lit(1.0), F.lit(1.0)), g.contains(ring, F.lit(5.0), F.lit(1.0)), F.size(g.closed(F.slice(ring, 1, 4))), F.size(g.shadow_ring(ring, F.lit(1.0), F.lit(1.0))))
    assert tuple(r) == (12.0, 14.0, True, False, 5, 11)


def test_inset(spark):
    box = g.inset_rectangle(*(F.lit(float(x)) for x in (0, 20, 0, 20, 3, 2, 5)), F.lit("south"))
    assert tuple(one(spark, box)[0]) == (2.0, 18.0, 3.0, 15.0)
    assert one(spark, g.inset_rectangle(*(F.lit(float(x)) for x in (0, 3, 0, 20, 3, 2, 5)), F.lit("south")))[0] is None


def test_convex_inset_and_hull():
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    inner = sequential.inset_convex(square, 2.0)
    assert {(round(x, 6), round(y, 6)) for x, y in inner} == {(2.0, 2.0), (8.0, 2.0), (8.0, 8.0), (2.0, 8.0)}
    assert sequential.inset_convex(square, 6.0) == [] or len(sequential.inset_convex(square, 6.0)) < 3
    assert set(sequential.convex_hull([*square, (5.0, 5.0)])) == set(square)


def test_chunks_overlap_and_cover(spark):
    from zonarium.functions import text as t

    text = "Frase numero uno. " * 400
    df = spark.createDataFrame([(text,), ("  ",), ("a",), ("x" * 4000,), (None,)], "t string")
    chunks, blank, short, solid, null = (r[0] for r in df.select(t.sentence_chunks(F.col("t"))).collect())
    assert all(len(c) <= 1800 for c in chunks) and chunks[0].startswith("Frase") and all(c.endswith(".") for c in chunks[:-1])
    assert blank == [] and short == ["a"] and [len(c) for c in solid] == [1800, 1800, 640] and null == []
    assert all(len(c) <= 320 for c in sequential.split_recursive(text))


def test_precedence(spark):
    plans = relation(spark, [("v", "", 1.0, 1), ("v", "a", 2.0, 2), ("w", "b", 3.0, 3)], ("m", "s", "h", "o"))
    asked = spark.createDataFrame([(1, "v", "a"), (2, "v", "zz"), (3, "w", ""), (4, "w", "zz"), (5, "x", "a")], "id int, m string, s string")
    got = {r["id"]: r["rule"]["h"] if r["rule"] else None for r in lookups.precedence_lookup(asked, plans, "m", "s", "o").collect()}
    assert got == {1: 2.0, 2: 1.0, 3: 3.0, 4: None, 5: None}


def test_range_join_open_ends(spark):
    v = spark.createDataFrame([(x,) for x in (3.0, 6.0, 11.9, 30.0)], "w double")
    r = relation(spark, [(None, 6.0, 1), (6.0, 12.0, 2), (12.0, None, 3)], ("lo", "hi", "k"))
    assert {x["w"]: x["k"] for x in lookups.range_join(v, r, "w", "lo", "hi", 5.0).collect()} == {3.0: 1, 6.0: 2, 11.9: 2, 30.0: 3}


def test_radius(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double")
    o = spark.createDataFrame([("a", 3.0, 4.0), ("b", -3.0, -4.1), ("c", 0.0, 0.0)], "k string, ox double, oy double")
    assert {r["k"] for r in spatial.within_radius(p, o, 5.0).collect()} == {"a", "c"}


def test_sessions_split_only_beyond_the_gap(spark):
    e = spark.sql("select 1 u, timestamp'2024-01-01 00:00:00' t, 1 i union all select 1, timestamp'2024-01-01 00:30:00', 2 union all select 1, timestamp'2024-01-01 01:00:01', 3")
    assert [r["session"] for r in windows.sessions(e, "u", "t", 1800, "i").orderBy("i").collect()] == [1, 1, 2]


def test_fill_forward_stops_at_the_gap(spark):
    d = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 4, None), (1, 5, "b")], "k int, o int, v string")
    assert [r["f"] for r in windows.fill_forward(d, ["k"], "o", "v", 2, "f").orderBy("o").collect()] == ["a", "a", None, "b"]


def test_histogram_quantile(spark):
    h = metrics.histogram(spark.range(100).selectExpr("1 k", "cast(id as double) v"), ["k"], "v", [10.0, 50.0, 99.0])
    assert metrics.histogram_quantile(h, ["k"], 0.5).first()["quantile"] == pytest.approx(48.95, abs=0.1)


def test_consolidation_ties_go_to_the_first(spark):
    d = spark.createDataFrame([("x", 1, 5.0, "n", None), ("x", 2, 7.0, "s", "p2"), ("x", 3, None, "s", "p3"), ("x", 4, 1.0, "n", None)], "m string, o int, h double, d string, p string")
    r = quality.consolidated(d, ["m"], ["h"], "d", "p", "o").first()
    assert (r["h"], r["d"], r["p"]) == (7.0, "n", "p2")


def test_plan_csv(spark, tmp_path):
    f = tmp_path / "plan.csv"
    f.write_text("municipio, subzona,altura_maxima_m,otro\n# nota\nVigo , centro,\"12.5\",z\nLugo,,x,\n", encoding="utf-8")
    rows = readers.plan_csv(spark, str(f)).orderBy("municipio").collect()
    assert [(r["municipio"], r["altura_maxima_m"], r["extra"].get("otro")) for r in rows] == [("Lugo", None, None), ("Vigo", 12.5, "z")]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.plan_csv(spark, str(tmp_path / "bad.csv"))


def test_inventory_csv(spark, tmp_path):
    f = tmp_path / "inv.csv"
    f.write_bytes('36057;"Vigo";"PXOM";01/02/2008;"Vixente ñ"\n'.encode("latin-1"))
    assert readers.inventory_csv(spark, str(f)).first()["estado"] == "Vixente ñ"


def test_geojson_and_buildings(spark, tmp_path):
    f = tmp_path / "z.geojson"
    f.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"code": "A"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}}]}))
    r = readers.geojson(spark, str(f), "code: string").select("code", "geom_type", g.area(F.col("rings")[0]).alias("a")).first()
    assert tuple(r) == ("A", "Polygon", 2.0)
    b = tmp_path / "b.json"
    ring = [{"lon": x, "lat": y} for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]
    b.write_text(json.dumps({"elements": [{"id": 1, "type": "way", "tags": {"height": "7 m"}, "geometry": ring}, {"id": 2, "type": "way", "tags": {}, "geometry": ring[:2]}]}))
    rows = readers.building_json(spark, str(b)).collect()
    assert len(rows) == 1 and len(rows[0]["ring"]) == 5


def test_pos_list_swaps(spark):
    r = one(spark, readers.pos_list(F.lit("42.1 -8.7 42.2 -8.6"), F.lit(True)))[0]
    assert [(p["x"], p["y"]) for p in r] == [(-8.7, 42.1), (-8.6, 42.2)]


def test_gml(spark, tmp_path):
    f = tmp_path / "a.gml"
    f.write_text('<?xml version="1.0"?><c xmlns:b="urn:x"><b:Building><b:luso>V</b:luso><b:sfc>120.5</b:sfc></b:Building><b:Building><b:luso>C</b:luso><b:sfc>80</b:sfc></b:Building></c>')
    rows = readers.gml_features(spark, str(f), "Building", "luso string, sfc double").collect()
    assert sum(r["sfc"] for r in rows) == 200.5


def test_json_lines_skip_broken(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in readers.json_lines(spark, str(f), "a long").collect()) == [1, 2]


def test_newest_release():
    assert readers.newest_release(["s3/release/2024-01-17/x", "s3/release/2025-03-19.1/x", "other"]).endswith("2025-03-19.1/x")


def test_slim_feature_and_cityjson(spark):
    b = spark.range(1).select("id", g.rectangle(F.lit(0.0), F.lit(1.23456789), F.lit(0.0), F.lit(1.0)).alias("ring"), F.lit(3.0).alias("h"))
    f = json.loads(b.select(sinks.slim_feature(["id"], "ring")).first()[0])
    assert f["geometry"]["coordinates"][0][1] == [1.234568, 0.0]
    c = sinks.cityjson(b, "id", "ring", "h").first()
    assert (c["n_vertices"], c["n_faces"]) == (8, 6) and json.loads(c["document"])["type"] == "CityJSON"


def test_upsert_stream(spark, tmp_path):
    from zonarium.streaming.sessions import fold_batches, newest_rows, upsert_batches

    src = tmp_path / "in"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, o int, v string").coalesce(1).write.parquet(str(src))
    q = upsert_batches(spark.readStream.schema("k int, o int, v string").parquet(str(src)), "k", "o", str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    newest = lambda name: {(r["k"], r["v"]) for r in newest_rows(spark, str(tmp_path / name), "k").collect()}
    assert newest("out") == {(1, "b"), (2, "c")}
    spark.createDataFrame([(2, 0, "d"), (3, 1, "e"), (3, 1, "e")], "k int, o int, v string").write.mode("append").parquet(str(src))
    again = upsert_batches(spark.readStream.schema("k int, o int, v string").parquet(str(src)), "k", "o", str(tmp_path / "out"), str(tmp_path / "check"))
    again.awaitTermination()
    assert newest("out") == {(1, "b"), (2, "d"), (3, "e")}
    fold_batches(spark, str(tmp_path / "out"), "k", str(tmp_path / "folded"))
    assert newest("folded") == newest("out")


def test_percentiles_by_sketch(spark):
    from zonarium.operators.spatial import zonal_percentile

    px = spark.range(20_000).select((F.col("id") % 2).alias("zone"), F.col("id").cast("double").alias("v"))
    exact, near = ({r["zone"]: r["p"] for r in zonal_percentile(px, "zone", "v", 0.9, 5, a).collect()} for a in (None, 1000))
    assert all(abs(exact[z] - near[z]) <= 20_000 / 1000 for z in exact)


def test_paged_source(spark, tmp_path):
    from zonarium.sources.paged import PagedFeatures

    for start, n in ((0, 2), (2, 1)):
        (tmp_path / f"p{start}.json").write_text(json.dumps({"features": [{"properties": {"k": start + i, "x": None}, "geometry": {"type": "Point"}} for i in range(n)]}))
    spark.dataSource.register(PagedFeatures)
    rows = spark.read.format("paged_features").option("url", f"file://{tmp_path}/p{{start}}.json").option("pages", 3).option("size", 2).load().collect()
    assert sorted(int(r["properties"]["k"]) for r in rows) == [0, 1, 2]


def test_volumes():
    import struct

    from zonarium.sources import volumes as v

    ring = [{"x": 0, "y": 0}, {"x": 2, "y": 0}, {"x": 2, "y": 1}, {"x": 0, "y": 1}, {"x": 0, "y": 0}]
    document, buffer = v.gltf(ring, 3)
    assert document["accessors"][0]["count"] == 8 and document["accessors"][1]["count"] == 3 * (2 + 2 + 8)
    packed = v.glb(document, buffer)
    assert struct.unpack("<4sII", packed[:12]) == (b"glTF", 2, len(packed)) and len(packed) % 4 == 0
    assert "IFCEXTRUDEDAREASOLID" in v.ifc("b1", ring, 3)


def test_first_variant_and_ladder(spark):
    from zonarium.operators import ladders

    p = one(spark, ladders.first_source([("a", F.lit(None).cast("double")), ("b", F.lit(2.0))]))[0]
    assert (p["value"], p["source"]) == (2.0, "b")


def test_rule_rows(spark):
    from zonarium.functions.parse import rule_rows

    lines = ["MUNICIPIO A", "altura 7", "Subzona x", "altura 9", "MUNICIPIO B", "ocupacion 30"]
    df = spark.createDataFrame([(1, n, s) for n, s in enumerate(lines)], "doc int, n int, line string")
    got = {(r["muni"], r["sub"]): (r["altura"], r["ocupacion"]) for r in rule_rows(df, "doc", "n", "line").collect()}
    assert got == {("A", ""): (7.0, None), ("A", "x"): (9.0, None), ("B", ""): (None, 30.0)}


def test_least_gap_of_odd_rings(spark, monkeypatch):
    """As by built-in functions on every pair of a corner and an edge: rings of all lengths, empty, null and with unknown corners, edges without length."""
    import random

    from zonarium.functions import outlines

    r = random.Random(5)
    one = lambda: r.choice([None, *[(r.choice([None, float("nan"), float("inf"), *[r.uniform(-9, 9)] * 40]), float(r.randint(-3, 3)))] * 30])
    ring = lambda: None if r.random() < 0.05 else [one() for _ in range(r.choice([0, 1, 2, 3, 5, 40]))]
    data = [(k, ring(), ring()) for k in range(400)]
    df = spark.createDataFrame(data, "id long, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>").repartition(3).cache()

    def pairs(a, b):
        edges = df.select("id", F.posexplode(b).alias("n", "s"))
        ends = edges.select("id", (F.col("n") - 1).alias("n"), F.col("s").alias("e"))
        every = df.select("id", F.explode(a).alias("p")).join(edges.join(ends, ["id", "n"]), "id")
        return every.select("id", g.point_segment_distance(*(F.col(c) for c in ("p.x", "p.y", "s.x", "s.y", "e.x", "e.y"))).alias("d"))

    want = dict(pairs("a", "b").union(pairs("b", "a")).groupBy("id").agg(F.min("d").alias("d")).collect())
    got = {i: d for i, d in df.select("id", g.least_gap(F.col("a"), F.col("b"))).collect()}
    assert {i: repr(d) for i, d in got.items()} == {i: repr(want.get(i)) for i, _, _ in data}
    assert len({repr(d) for d in got.values()}) > 100 and None in got.values()

    batch = df.toArrow().combine_chunks()
    a, b = batch["a"].chunk(0), batch["b"].chunk(0)
    whole = outlines.gaps(a, b)
    monkeypatch.setattr(outlines, "PAIRS", 7)
    assert repr(outlines.gaps(a, b).to_pylist()) == repr(whole.to_pylist())
    assert repr(outlines.gaps(a[100:], b[100:]).to_pylist()) == repr(whole[100:].to_pylist()) and len(outlines.gaps(a[:0], b[:0])) == 0


def test_more_geometry(spark):
    ring = g.rectangle(F.lit(0.0), F.lit(4.0), F.lit(0.0), F.lit(2.0))
    x = g.crossing(*(F.lit(float(v)) for v in (0, 0, 4, 4, 0, 4, 4, 0)))
    none = g.crossing(*(F.lit(float(v)) for v in (0, 0, 1, 0, 0, 1, 1, 1)))
    small = g.rectangle(F.lit(-8.7), F.lit(-8.6999), F.lit(42.2), F.lit(42.2001))
    r = one(spark, g.centre(ring), x, none, g.footprint_m2(small), g.area(g.projected(small)), g.padded(F.lit(-8.0), F.lit(42.0)), g.minimap(ring, g.bounds(ring), 100.0, 100.0))
    assert tuple(r[0]) == (2.0, 1.0) and tuple(r[1]) == (2.0, 2.0) and r[2] is None
    assert r[3] == pytest.approx(r[4], rel=0.01) and r[5]["xmax"] > -8.0 > r[5]["xmin"]
    assert max(p["x"] for p in r[6]) == 100.0


def test_provenance(spark):
    from zonarium.functions import provenance as v

    a, b = v.point(F.lit(None).cast("double"), "m", "official", "plan"), v.point(F.lit(9.0), "m", "estimated", "osm")
    r = one(spark, a, v.best([a, b]), v.rank(F.lit("measured")))
    assert r[0]["data_quality"] == "unavailable" and r[0]["source"] is None and r[1]["value"] == 9.0 and r[2] == 1
    with pytest.raises(ValueError):
        v.point(F.lit(1.0), "m", "guessed", "x")


def test_simplify_and_parameters(spark):
    assert sequential.simplify([(0, 0), (1, 0.001), (2, 0), (3, 5)], 0.01) == [(0, 0), (2, 0), (3, 5)]
    text = "El peto tendrá una altura de 1,10 m. Altura máxima: 7 m. Ocupación máxima del 40 %. Edificabilidad 0,7 m2/m2. Parcela mínima de 1.250 m2. Retranqueo 3 m"
    got = {k: v["value"] for k, v in sequential.extract_parameters(text, 4).items()}
    assert got == {"altura_maxima_m": 7.0, "ocupacion_max": 0.4, "edificabilidad_max_m2_m2": 0.7, "parcela_minima_m2": 1250.0, "retranqueo_min_m": 3.0}
    df = spark.createDataFrame([("a", 1, text), ("b", 2, None)], "k string, p int, t string")
    assert sequential.parameters(df, "k", "p", "t").count() == 5


def test_more_readers(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a;b\n1;2,5\n")
    assert readers.sniffed_csv(spark, str(tmp_path / "s.csv")).first()["b"] == "2,5"
    spark.range(3).selectExpr("id", "named_struct('xmin', double(id), 'xmax', id + 0.5D, 'ymin', 0D, 'ymax', 1D) bbox").write.parquet(str(tmp_path / "f"))
    f = readers.footprints(spark, str(tmp_path / "f"), 0.9, 0.0, 1.2, 1.0)
    assert [r["id"] for r in f.collect()] == [1] and "bbox.xmin" in f._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "o").mkdir()
    (tmp_path / "o/1.json").write_text('[{"k": "U1", "h": 7}, {"k": "U2", "h": 9}]')
    (tmp_path / "o/2.json").write_text('[{"k": "U1", "h": 8}]')
    assert {r["k"]: r["h"] for r in readers.merged_json(spark, str(tmp_path / "o"), "k string, h int", "k").collect()} == {"U1": 8, "U2": 9}
    assert readers.plan_provider(spark, "csv", str(tmp_path / "none.csv")).count() == 7 and readers.plan_provider(spark, "none").count() == 0


def test_asof_join(spark):
    left = spark.createDataFrame([("a", 5), ("a", 0), ("b", 3)], "k string, t long")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y")], "k string, s long, v string")
    got = {(r["k"], r["t"]): r["o"] for r in windows.asof_join(left, right, ["k"], "t", "s", "v", "o").collect()}
    assert got == {("a", 5): "y", ("a", 0): None, ("b", 3): None}


def test_model_hooks(spark):
    from zonarium.functions import models

    d = spark.createDataFrame([(1, "a b", "a c"), (2, "a b", "a b")], "id int, q string, x string")
    assert [r["id"] for r in models.rerank(d, "q", "x").orderBy(F.desc("rerank")).collect()] == [2, 1]
    assert models.embed(d, "x", lambda xs: [[float(len(x))] for x in xs]).first()["embedding"] == [3.0]
