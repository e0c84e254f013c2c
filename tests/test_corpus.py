"""Articles, answers and diagnostics on small texts; joins by cells and ranges whose rows do not grow with the zone or the range."""

import pytest
from pyspark.sql import functions as F

from zonarium.operators import corpus
from zonarium.operators.lookups import range_join
from zonarium.operators.spatial import cell_join

LEAD = "Preámbulo " * 50


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, 1, LEAD + "\nArtículo 1. Uno"), (1, 2, "sigue uno\n  ARTIGO 2 bis - Dous\nArtículo 2 bis. copia"), (1, 3, None), (1, 4, "cola\nDisposición adicional 3ª\ntexto\nAnexo IV. Planos"),
        (2, 1, "sin cabeceras"), (3, 1, "corto\nartigo 7: sete"), (4, 1, None),
    ]
    return spark.createDataFrame(rows, "doc int, page int, text string")


def test_articles_begin_at_their_headings(pages):
    got = [(r.doc, r.ref, r.page, " ".join(r.text.split())) for r in corpus.articles(pages, "doc", "page", "text").orderBy("doc", "start").collect()]
    assert [(d, ref, p) for d, ref, p, _ in got] == [
        (1, "EXPOSICION_MOTIVOS", 1), (1, "Art. 1", 1), (1, "Art. 2", 2), (1, "Disposición adicional 3ª", 4), (1, "Anexo IV", 4), (2, "DOCUMENTO", 1), (3, "Art. 7", 1), (4, "DOCUMENTO", 1),
    ]
    texts = {(d, ref): x for d, ref, _, x in got}
    assert texts[1, "Art. 1"] == "Artículo 1. Uno sigue uno" and "copia" in texts[1, "Art. 2"] and texts[1, "Art. 2"].endswith("cola") and texts[1, "Anexo IV"] == "Anexo IV. Planos"


def test_chunks_keep_the_article_and_page(pages):
    got = corpus.corpus_chunks(corpus.articles(pages, "doc", "page", "text"), 200, 20).collect()
    assert {r.doc for r in got} == {1, 2, 3} and max(len(r.text) for r in got) <= 200
    lead = sorted((r.chunk, r.page) for r in got if r.ref == "EXPOSICION_MOTIVOS")
    assert len(lead) >= 3 and {p for _, p in lead} == {1}


def test_answers_cite_their_own_place(spark):
    chunks = spark.createDataFrame([("vigo", 1, "La altura de cornisa será de nueve metros"), ("vigo", 2, "Piscinas y jardines"), ("lugo", 3, "altura altura altura"), ("lugo", 4, "otra cosa")], "ine string, id int, text string")
    questions = spark.createDataFrame([(1, "vigo", "¿Qué altura de cornisa?"), (2, "lugo", "altura"), (3, "ourense", "altura"), (4, "vigo", "zzz")], "qid int, ine string, question string")
    got = {r.qid: r for r in corpus.consult(chunks, questions, "ine", ["id"], "text", 3).collect()}
    assert [c.id for c in got[1].citations] == [1] and "altura" in got[1].citations[0].extract and got[1].answer and got[1].data_quality == "official"
    assert [c.id for c in got[2].citations] == [3]
    assert got[3].data_quality == "unavailable" and got[3].answer is None and got[3].instructions and got[3].citations == []
    assert got[4].data_quality == "official" and got[4].answer is None and got[4].instructions is None


def test_diagnostic_of_one_building(spark):
    rows = [(1, 10.5, 4, 80.0, 9.0, 0.4, 1.2, 3.0, "official"), (2, 8.0, 2, None, 9.0, None, None, None, "PILOT"), (3, 8.0, 2, None, 9.0, None, None, None, "ambiguous"), (4, None, None, None, 9.0, None, None, None, "official"), (5, 10.0, 1, None, 9.0, None, None, None, "pilot")]
    df = spark.createDataFrame(rows, "id int, height double, levels int, footprint double, altura_max double, ocupacion_max double, edificabilidad_max double, retranqueo_min double, status string")
    got = {}
    for r in corpus.building_diagnostic(df, "id").collect():
        got.setdefault(r.id, {})[r.parametro] = r
    assert set(got[1]) == {"altura", "plantas", "ocupacion", "edificabilidad", "retranqueo"} and got[1]["altura"].cumple is False and got[1]["plantas"].diferencia == 1.0 and got[1]["altura"].verdict == "supera_altura"
    assert got[2]["altura"].cumple is None and got[2]["altura"].orientativo == "dentro" and got[2]["altura"].verdict == "orientativo_dentro" and got[5]["altura"].verdict == "orientativo_supera"
    assert list(got[3]) == [None] and got[3][None].verdict == "sin_dato" and got[3][None].status == "ambiguous"
    assert got[4]["altura"].cumple is None and got[4]["altura"].verdict == "compatible"


def test_cells_of_zones_of_any_size(spark):
    zones = [("a", 0.0, 1.0, 0.0, 1.0), ("b", -1e6, 1e6, -1e6, 1e6), ("c", 5.0, 900.0, 5.0, 6.0), ("d", None, 1.0, 0.0, 1.0)]
    z = spark.createDataFrame(zones, "z string, xmin double, xmax double, ymin double, ymax double")
    p = spark.createDataFrame([(k, float(k % 31) / 2, float(k % 17) / 2) for k in range(500)], "id int, x double, y double")
    got = sorted((r.id, r.z) for r in cell_join(p, z, 0.5).collect())
    assert got == sorted((i, n) for i, x, y in [(r.id, r.x, r.y) for r in p.collect()] for n, a, b, c, d in zones if a is not None and a <= x < b and c <= y < d)


@pytest.mark.parametrize("values", [[0.5, 3.0, 6.0, 7.9, 1e5, -1e6], []])
def test_ranges_with_open_ends(spark, values):
    ranges = [("low", None, 3.0), ("mid", 3.0, 6.0), ("high", 6.0, None), ("all", None, None), ("far", 2e7, None), ("deep", None, -2e7)]
    r = spark.createDataFrame(ranges, "n string, lo double, hi double")
    v = spark.createDataFrame([(x,) for x in values], "v double")
    got = sorted((x.v, x.n) for x in range_join(v, r, "v", "lo", "hi", 2.0).collect())
    assert got == sorted((x, n) for x in values for n, a, b in ranges if (a is None or x >= a) and (b is None or x < b))
    assert "NestedLoop" not in range_join(v, r, "v", "lo", "hi", 2.0)._jdf.queryExecution().executedPlan().toString()


def test_words_around_a_hit(spark):
    from zonarium.functions import text as t

    got = spark.createDataFrame([("x" * 300 + " altura " + "y" * 300, "altura"), ("corto", "nada"), ("corto", None)], "t string, w string").select(t.snippet(F.col("t"), F.col("w"), 40).alias("s")).collect()
    assert "altura" in got[0].s and got[0].s.startswith("…") and got[1].s == got[2].s == "corto"
