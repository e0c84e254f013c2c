"""Sources and writers: conditions sent to a service, layers in GML pages, files that appear when all tasks have succeeded."""

import json
import os
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from zonarium.sources import volumes
from zonarium.sources.gml_pages import GmlPages
from zonarium.sources.paged import layer
from zonarium.sources.volume_files import VolumeFiles

FEATURES = [{"properties": {"muni": ["Vigo", "Lugo", "O'Grove"][k % 3], "height": 3.5 + k, "note": None}, "geometry": {"type": "Polygon", "coordinates": [[[k, k], [k + 2, k], [k + 2, k + 1], [k, k]]]}} for k in range(10)]


@pytest.fixture()
def service():
    """Pages of two; applies an equality on ``muni``, a least height and a box, and keeps the addresses asked for."""
    asked = []

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            args = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
            asked.append(args)
            rows = FEATURES
            for part in args["where"].split(" AND "):
                if part.startswith("muni="):
                    rows = [f for f in rows if "'" + f["properties"]["muni"].replace("'", "''") + "'" == part[5:]]
                elif part.startswith("height>="):
                    rows = [f for f in rows if f["properties"]["height"] >= float(part[8:])]
            if args.get("bbox"):
                a, b, c, d = map(float, args["bbox"].split(","))
                rows = [f for f in rows if (p := f["geometry"]["coordinates"][0][0]) and p[0] <= c and p[0] + 2 >= a and p[1] <= d and p[1] + 1 >= b]
            body = json.dumps({"features": rows[int(args["start"]) : int(args["start"]) + 2]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/x?start={{start}}&where={{where}}&bbox={{bbox}}", asked
    server.shutdown()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_conditions_go_to_the_service(spark, service):
    url, asked = service
    df = layer(spark, url, "muni string, height double", size="2").where("muni = 'Vigo' and height >= 6")
    assert sorted(r.height for r in df.collect()) == [6.5, 9.5, 12.5]
    said = [a["where"] for a in asked]
    assert said and all("muni='Vigo'" in w and "height>=6.0" in w for w in said)
    assert "Filter (" not in plan(df)


def test_quotes_and_boxes_go_too(spark, service):
    url, asked = service
    df = layer(spark, url, "muni string, height double", size="2").where("muni = 'O''Grove' and xmin <= 6 and xmax >= 4 and ymin <= 100 and ymax >= 0")
    assert [r.xmin for r in df.collect()] == [2.0, 5.0]
    assert asked[0]["bbox"] == "4.0,0.0,6.0,100.0" and "muni='O''Grove'" in asked[0]["where"] and "Filter (" not in plan(df)


def test_other_conditions_stay(spark, service):
    url, asked = service
    df = layer(spark, url, "muni string, height double", size="2").where("xmin <= 1 and length(muni) = 4 and properties['muni'] = 'Lugo'")
    assert [r.height for r in df.collect()] == [4.5] and "Filter (" in plan(df) and not asked[0].get("bbox") and "muni" not in asked[0]["where"].replace("muni IS NOT NULL", "")


def member(k, ring):
    return f"<gml:featureMember><ms:zone><gml:boundedBy><gml:Envelope srsName='EPSG:4326'/></gml:boundedBy><ms:code>Z{k}</ms:code><ms:msGeometry><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>{ring}</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></ms:msGeometry></ms:zone></gml:featureMember>"


def page(path, members):
    path.write_text(f"<wfs:FeatureCollection xmlns:wfs='w' xmlns:gml='g' xmlns:ms='m'>{''.join(members)}</wfs:FeatureCollection>")


def read_gml(spark, folder, **options):
    spark.dataSource.register(GmlPages)
    return spark.read.format("gml_pages").options(url=f"file://{folder}/p{{start}}.xml", layer="zone", size="3", **options).load()


@pytest.mark.parametrize("lanes", ["1", "2"])
def test_a_broken_feature_does_not_end_the_layer(spark, tmp_path, lanes):
    good = "42.0 -8.0 42.5 -8.0 42.5 -8.5 42.0 -8.0"
    page(tmp_path / "p0.xml", [member(0, good), member(1, "no numbers here"), member(2, good)])
    page(tmp_path / "p3.xml", [member(3, good), member(4, good), member(5, good)])
    page(tmp_path / "p6.xml", [member(6, good)])
    rows = sorted((r.start, r.position, r.properties["code"], r.parts[0][0][0].x) for r in read_gml(spark, tmp_path, lanes=lanes).collect())
    assert rows == [(0, 0, "Z0", -8.0), (0, 2, "Z2", -8.0), (3, 0, "Z3", -8.0), (3, 1, "Z4", -8.0), (3, 2, "Z5", -8.0), (6, 0, "Z6", -8.0)]


def test_ends_of_a_layer(spark, tmp_path):
    good = "42.0 -8.0 42.5 -8.0 42.5 -8.5 42.0 -8.0"
    page(tmp_path / "p0.xml", [member(k, good) for k in range(3)])
    assert read_gml(spark, tmp_path).count() == 3  # the next page is not there
    (tmp_path / "p3.xml").write_text("<wfs:FeatureCollection xmlns:wfs='w'><broken")
    with pytest.raises(Exception, match="(?i)parse|token|closed"):
        read_gml(spark, tmp_path).collect()
    assert read_gml(spark, tmp_path, pages="1").count() == 3
    with pytest.raises(Exception, match="(?i)no such file|not found|urlopen"):
        read_gml(spark, tmp_path / "nowhere").collect()


RINGS = [[(0, 0), (8, 0), (8, 6), (0, 6)], [(2, 2), (4, 2), (4, 4.5), (2, 4.5)]]


def bodies(spark, names):
    rings = [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in RINGS]
    return spark.createDataFrame([(n, 3.0 + k, rings) for k, n in enumerate(names)], "name string, height double, rings array<array<struct<x:double,y:double>>>").repartition(3)


def write(df, path, form, mode="append"):
    df.sparkSession.dataSource.register(VolumeFiles)
    df.write.format("volume_files").option("form", form).mode(mode).save(str(path))


def test_files_read_back_with_their_volumes(spark, tmp_path):
    write(bodies(spark, ["a", "b", "c", "d"]), tmp_path / "v", "glb")
    assert sorted(os.listdir(tmp_path / "v")) == ["_SUCCESS", "a.glb", "b.glb", "c.glb", "d.glb"]
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.glb").load(str(tmp_path / "v")).orderBy("path").collect()
    assert [volumes.volume(*volumes.glb_mesh(bytes(r.content))) for r in read] == pytest.approx([43 * (3.0 + k) for k in range(4)])
    write(bodies(spark, ["z"]), tmp_path / "v", "ifc", "overwrite")
    assert sorted(os.listdir(tmp_path / "v")) == ["_SUCCESS", "z.ifc"] and "WITHVOIDS" in (tmp_path / "v" / "z.ifc").read_text()
    for form in ("gltf", "cityjson"):
        write(bodies(spark, ["q"]), tmp_path / form, form)
        assert json.loads((tmp_path / form / f"q.{form}").read_text())


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    bad = bodies(spark, ["a", "b", "c", "d", "bad/name"])
    with pytest.raises(Exception, match="no name of a file"):
        write(bad, tmp_path / "v", "glb")
    assert [f for _, _, files in os.walk(tmp_path / "v") for f in files] == []
    with pytest.raises(Exception, match="form is one of"):
        write(bodies(spark, ["a"]), tmp_path / "w", "png")


def test_shape_of_written_city(spark, tmp_path):
    write(bodies(spark, ["a"]), tmp_path / "c", "cityjson")
    shell = json.loads((tmp_path / "c" / "a.cityjson").read_text())["CityObjects"]["a"]["geometry"][0]["boundaries"][0]
    assert len(shell) == 10 and len(shell[0]) == len(shell[1]) == 2


def test_first_good_mirror_wins_and_a_failed_box_grows(spark, tmp_path):
    from zonarium.sources.mirrors import raced_extracts

    answer = {"elements": [{"id": 7, "type": "way", "tags": {"height": "9"}, "geometry": [{"lon": 1.0, "lat": 2.0}]}]}
    (tmp_path / "good-10.0.json").write_text(json.dumps(answer))
    (tmp_path / "grown-20.0.json").write_text(json.dumps(answer))
    (tmp_path / "bad-10.0.json").write_text("no json")
    mirrors = [f"file://{tmp_path}/{{north}}-nothing.json", f"file://{tmp_path}/bad-{{north}}.json", f"file://{tmp_path}/good-{{north}}.json"]
    places = spark.createDataFrame([(1, 0.0, 0.0, 10.0)], "id int, lon double, lat double, reach double")
    one = raced_extracts(places, "id", mirrors, factors=(1.0, 2.0)).first()
    assert one.mirror.endswith("good-10.0.json") and one.factor == 1.0 and one.elements[0].id == 7 and one.elements[0].tags == {"height": "9"}
    grown = raced_extracts(places, "id", [f"file://{tmp_path}/grown-{{north}}.json"], factors=(1.0, 2.0)).first()
    assert grown.factor == 2.0 and grown.error is None and len(grown.elements) == 1
    none = raced_extracts(places, "id", mirrors[:2], factors=(1.0, 2.0)).first()
    assert none.mirror is None and none.elements is None and none.error


def test_page_records_are_added(spark, tmp_path):
    from zonarium.sources.sinks import page_records, write_page_records

    pages = spark.createDataFrame([("vigo", "a.pdf", 1, " uno "), ("vigo", "a.pdf", 2, None)], "m string, f string, n int, t string")
    for _ in range(2):
        write_page_records(page_records(pages, "m", "f", "n", "t"), f"file://{tmp_path}/r")
    back = spark.read.json(f"file://{tmp_path}/r")
    assert back.count() == 4 and {r.text for r in back.collect()} == {"uno", ""} and back.select("file_md5").distinct().count() == 1
