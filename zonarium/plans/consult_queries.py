"""Queries over articles, answers from one municipality's chunks, document lists, building diagnostics and sheet headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonarium.functions import geometry as g
from zonarium.functions import ordinance as o
from zonarium.functions import text as t
from zonarium.operators import corpus
from zonarium.plans import retrieval_queries as q
from zonarium.plans.cases import Cases
from zonarium.plans.registry import Registry, table
from zonarium.sources.sinks import page_records

R = Registry()
C = F.col


def _cores(spark: SparkSession) -> int:
    """So many tasks that no core is idle while rows of few bytes cost much; a number that is asked for is not cut down by their size."""
    return 4 * spark.sparkContext.defaultParallelism


_HEADED = "CASE WHEN turn % 3 = 1 THEN 'Artículo ' || (turn + conv_id % 5) || '. ' || text WHEN turn % 5 = 3 THEN 'Disposición final primera' || chr(10) || text ELSE text END"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, turns as pages; some pages begin an article or a provision."""
    n = C("turn")
    article = F.concat(F.lit("Artículo "), (n + C("conv_id") % 5).cast("string"), F.lit(". "), "text")
    text = F.when(n % 3 == 1, article).when(n % 5 == 3, F.concat(F.lit("Disposición final primera\n"), "text")).otherwise(C("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))


@R.add(
    f"""WITH p AS (SELECT conv_id, turn, {_HEADED} AS text, CASE WHEN turn % 3 = 1 THEN 'Art. ' || (turn + conv_id % 5) WHEN turn % 5 = 3 THEN 'Disposición final primera' END AS ref FROM conversations),
    s AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, count(ref) OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM p),
    b AS (SELECT conv_id, k, min(start) AS start, arg_min(turn, start) AS page, arg_min(ref, start) AS ref, sum(length(text) + 1) - 1 AS n, max(max(k)) OVER (PARTITION BY conv_id) AS top FROM s GROUP BY conv_id, k)
    SELECT conv_id AS doc, coalesce(ref, CASE WHEN top = 0 THEN 'DOCUMENTO' ELSE 'EXPOSICION_MOTIVOS' END) AS ref, start::BIGINT AS start, page, (n + CASE WHEN k < top THEN 1 ELSE 0 END)::BIGINT AS n_chars FROM b
    WHERE k > 0 OR top = 0 OR n + 1 > 400"""
)
def article_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and provisions of documents given as pages, each with the page it begins on."""
    a = corpus.articles(_pages(spark, sf_dir), "conv_id", "turn", "text")
    return a.select("doc", "ref", C("start").cast("long").alias("start"), "page", F.length("text").cast("long").alias("n_chars"))


@R.add()
def article_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index build from pages to chunks in one step."""
    chunks = corpus.corpus_chunks(corpus.articles(_pages(spark, sf_dir), "conv_id", "turn", "text"))
    return chunks.select("doc", "ref", "page", "chunk", F.length("text").alias("n_chars"))


_PLACES = ["src0", "src3", "src5", "nowhere"]


@R.add(
    f"""WITH q AS (SELECT qid * 10 + i AS qid, p AS source, question FROM (VALUES {", ".join(f"({i}, '{x}')" for i, x in q.QUESTIONS)}) v(qid, question), (SELECT unnest({_PLACES}) AS p, unnest(range(0, {len(_PLACES)})) AS i)),
    asked AS (SELECT DISTINCT qid, source, unnest(list_distinct({q._terms_sql("question")})) AS term FROM q),
    d AS (SELECT doc_id, source, {q._terms_sql("text")} AS t FROM documents), s AS (SELECT source, count(*) AS n, avg(len(t)) AS mean FROM d GROUP BY source),
    x AS (SELECT doc_id, source, len(t) AS l, unnest(t) AS term FROM d), tf AS (SELECT doc_id, source, l, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM asked) GROUP BY ALL), df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY ALL),
    sc AS (SELECT qid, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))) AS score FROM tf JOIN df USING (source, term) JOIN s USING (source) JOIN asked USING (source, term) GROUP BY qid, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc), c AS (SELECT qid, list(doc_id ORDER BY rank) AS docs, round(max(score), 3) AS best FROM r WHERE rank <= 6 GROUP BY qid)
    SELECT q.qid, q.source, CASE WHEN s.source IS NULL THEN 'unavailable' ELSE 'official' END AS data_quality, docs IS NOT NULL AS answered, coalesce(docs, []) AS docs, best FROM q LEFT JOIN s USING (source) LEFT JOIN c USING (qid)"""
)
def municipal_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question to four places, one of which has no documents: quality, whether there is an answer, and what it cites."""
    rows = [(i * 10 + k, p, x) for i, x in q.QUESTIONS for k, p in enumerate(_PLACES)]
    questions = spark.createDataFrame(rows, "qid bigint, source string, question string")
    a = corpus.consult(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), questions, "source", ["doc_id"], "text")
    return a.select("qid", "source", "data_quality", C("answer").isNotNull().alias("answered"), F.transform("citations", lambda c: c["doc_id"]).alias("docs"), F.get("citations", F.lit(0))["score"].alias("best"))


_DATED = "SELECT o_orderkey, o_custkey % 40 AS ine, o_orderkey % 6 AS idclase, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN ' ' END AS adopted, CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') ELSE '' END AS gazette FROM orders"


@R.add(
    f"""WITH d AS (SELECT *, coalesce(nullif(trim(adopted), ''), nullif(trim(gazette), ''), '') AS date FROM ({_DATED}) WHERE idclase IN (1, 2, 3, 5)), n AS (SELECT *, count(*) OVER (PARTITION BY ine, idclase) AS of_class, row_number() OVER (PARTITION BY ine ORDER BY date DESC, o_orderkey) AS place FROM d)
    SELECT ine, o_orderkey, idclase, date, of_class, place FROM n"""
)
def documents_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of six classes, of which four count: newest first, with the number of their class."""
    k, day = C("o_orderkey"), C("o_orderdate").cast("date")
    text = lambda d: F.date_format(d, "yyyy-MM-dd")
    d = table(spark, sf_dir, "orders").select(
        "o_orderkey", (C("o_custkey") % 40).alias("ine"), (k % 6).alias("idclase"), F.when(k % 3 == 0, text(day)).when(k % 3 == 1, " ").alias("adopted"), F.when(k % 4 < 2, text(F.date_add(day, 30))).otherwise("").alias("gazette")
    )
    listed = corpus.documents_by_class(d, "ine", "idclase", ["adopted", "gazette"], (1, 2, 3, 5))
    place = F.row_number().over(W.partitionBy("ine").orderBy(F.desc("date"), "o_orderkey"))
    return listed.select("ine", "o_orderkey", "idclase", "date", "of_class", place.alias("place"))


@R.add(
    """WITH b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 > 0 THEN 4.0 + o_orderkey % 20 END::DOUBLE AS height, CASE WHEN o_orderkey % 5 > 0 THEN (1 + o_orderkey % 8)::INT END AS levels, CASE WHEN o_orderkey % 4 > 0 THEN 80.0 END::DOUBLE AS footprint,
        CASE WHEN o_orderkey % 9 > 0 THEN 7.0 + o_orderkey % 11 END::DOUBLE AS altura_max, CASE WHEN o_orderkey % 2 = 0 THEN 0.4 END::DOUBLE AS ocupacion_max, CASE WHEN o_orderkey % 3 = 0 THEN 1.2 END::DOUBLE AS edificabilidad_max, CASE WHEN o_orderkey % 6 < 3 THEN 3.0 END::DOUBLE AS retranqueo_min,
        CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'pilot' WHEN 2 THEN 'Ambiguous' WHEN 3 THEN 'unavailable' ELSE 'official' END AS status FROM orders),
    f AS (SELECT *, greatest(1, floor(altura_max / 3))::DOUBLE AS floors, round(height - altura_max, 2) AS over, lower(coalesce(status, '')) AS s, status IS NULL OR lower(status) IN ('ambiguous', 'unavailable') AS silent FROM b),
    g AS (SELECT *, levels - CASE WHEN altura_max IS NOT NULL THEN floors END AS more, s = 'pilot' AS pilot FROM f),
    v AS (SELECT *, CASE WHEN silent THEN 'sin_dato' WHEN pilot THEN CASE WHEN coalesce(over > 0, false) OR coalesce(more > 0, false) THEN 'orientativo_supera' ELSE 'orientativo_dentro' END WHEN coalesce(over > 0, false) OR coalesce(more > 0, false) THEN 'supera_altura' ELSE 'compatible' END AS verdict FROM g),
    r AS (SELECT k, 'altura' AS parametro, height AS edificio, altura_max AS norma, over AS diferencia, over <= 0 AS cumple, pilot FROM v WHERE NOT silent AND altura_max IS NOT NULL
      UNION ALL SELECT k, 'plantas', levels, floors, more, more <= 0, pilot FROM v WHERE NOT silent AND altura_max IS NOT NULL AND levels IS NOT NULL
      UNION ALL SELECT k, 'ocupacion', footprint, ocupacion_max, NULL, NULL, pilot FROM v WHERE NOT silent AND ocupacion_max IS NOT NULL AND footprint IS NOT NULL
      UNION ALL SELECT k, 'edificabilidad', NULL, edificabilidad_max, NULL, NULL, pilot FROM v WHERE NOT silent AND edificabilidad_max IS NOT NULL
      UNION ALL SELECT k, 'retranqueo', NULL, retranqueo_min, NULL, NULL, pilot FROM v WHERE NOT silent AND retranqueo_min IS NOT NULL)
    SELECT v.k AS o_orderkey, parametro, edificio, norma, diferencia, CASE WHEN NOT r.pilot THEN cumple END AS cumple, CASE WHEN r.pilot AND cumple IS NOT NULL THEN CASE WHEN cumple THEN 'dentro' ELSE 'supera' END END AS orientativo, verdict,
        CASE WHEN silent THEN s WHEN v.pilot THEN 'pilot' ELSE 'verified' END AS status FROM v LEFT JOIN r USING (k)"""
)
def building_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as buildings against their subzone, a row for each limit, with the verdict."""
    k = C("o_orderkey")
    status = F.when(k % 8 == 0, None).when(k % 8 == 1, "pilot").when(k % 8 == 2, "Ambiguous").when(k % 8 == 3, "unavailable").otherwise("official")
    b = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 7 > 0, 4.0 + k % 20).alias("height"), F.when(k % 5 > 0, (1 + k % 8).cast("int")).alias("levels"), F.when(k % 4 > 0, 80.0).alias("footprint"), F.when(k % 9 > 0, 7.0 + k % 11).alias("altura_max"),
        F.when(k % 2 == 0, 0.4).alias("ocupacion_max"), F.when(k % 3 == 0, 1.2).alias("edificabilidad_max"), F.when(k % 6 < 3, 3.0).alias("retranqueo_min"), status.alias("status"),
    )
    return corpus.building_diagnostic(b, "o_orderkey")


_SHEETS = [(1, "FICHA\nCATEGORÍA RIRU DISTRITO {c} AR-T {b}\nPLANO ORDENACIÓN:  {a}   b"), (2, "CATEGORÍA URBA DISTRITO {c}\nnada más"), (3, "Zona AR-K {a} sin cabecera"), (4, "texto")]
_SHEETS_AT = Cases(_SHEETS, ("id", "t"), source="documents", key="doc_id", whole=("t",))


@R.add(
    rf"""WITH {_SHEETS_AT.sql("x")}, b AS (SELECT id, t, regexp_extract(t, 'CATEGOR[ÍI]A\s*(RIRU|URBA|PEP)?\s*DISTRITO\s*(\d+)', ['c', 'd'], 'i') AS h FROM x)
    SELECT id, upper(nullif(h.c, '')) AS categoria, nullif(h.d, '') AS distrito, nullif(trim(regexp_replace(regexp_extract(t, 'PLANO ORDENACI[OÓ]N:\s*([^\n]+)', 1, 'i'), '\s+', ' ', 'g')), '') AS plano,
      replace(coalesce(nullif(regexp_extract(t, 'DISTRITO\s*\d+\s*(AR-[A-Z]+\s*\d+)', 1, 'i'), ''), nullif(regexp_extract(t, '(AR-[A-Z]+\s*\d+)', 1), '')), ' ', '-') AS codigo FROM b"""
)
def sheet_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category, district, drawing and code of area sheets."""
    h = t.sheet_header(C("t"))
    return _SHEETS_AT.frame(spark, sf_dir).select("id", h["categoria"].alias("categoria"), h["distrito"].alias("distrito"), h["plano_ordenacion"].alias("plano"), h["codigo_ar"].alias("codigo"))


_SECTIONS = [
    (1, "índice\na) - Condiciones del edificio en fila ({c}.1)\nprimero {a}\nb) Condiciones en bloque (subzona {c}.2)\nsegundo"),
    (2, "Configuración intensiva\nA < {c} m 3\n1{c} ≤ A < 2{c} m 4\nA ≥ {b} m 8\nConfiguración periférica\nA < {a} m 2\n2.- fin"),
    (3, "nada"),
]
_SECTIONS_AT = Cases(_SECTIONS, ("id", "t"), source="documents", key="doc_id", whole=("t",))


@R.add()
def lettered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by letter that name their subzone."""
    s = _SECTIONS_AT.frame(spark, sf_dir).select("id", F.explode(o.lettered_sections(C("t"))).alias("s"))
    return s.select("id", "s.subzona", F.length("s.texto").alias("n_chars"))


@R.add()
def floors_by_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floors by street width for each configuration of a block, by subzone."""
    s = _SECTIONS_AT.frame(spark, sf_dir).select("id", F.explode(o.block_floor_tables(C("t"))).alias("s"))
    return s.select("id", "s.subzona", F.size("s.rows").alias("rows"))


_CODED = [(1, "En la Ordenanza U 7, altura de {a} m"), (2, "U10 hasta {c} m de fondo"), (3, "Ordenanza U9: altura {a} m"), (4, "residencial, retranqueo mínimo {c} m y altura {a} m")]
_CODED_AT = Cases(_CODED, ("id", "t"), source="documents", key="doc_id", whole=("t",))


@R.add()
def heights_near_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height phrases in texts that name one of the wanted ordinances."""
    return _CODED_AT.frame(spark, sf_dir).select("id", o.height_near_codes(C("t"), ("U7", "U10")).alias("h")).where("h is not null").select("id", "h.kind", "h.words")


@R.add()
def fallback_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without a model: the plan's values where there are some, else what the text says."""
    plan = {"altura_maxima_m": F.when(C("id") % 3 == 0, 9.0), "retranqueo_min_m": F.lit(None).cast("double")}
    said = o.question_fields(C("t"))
    return _CODED_AT.frame(spark, sf_dir).select("id", o.fallback_summary(F.lit("Vigo"), F.when(C("id") % 2 == 0, "U7"), plan, said).alias("summary"))


@R.add(
    """WITH w AS (SELECT conv_id, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, coalesce(text, ''))) AS file_md5 FROM conversations GROUP BY conv_id)
    SELECT 'page_text' AS kind, role AS municipio, conv_id AS fuente, file_md5, turn AS page_number, md5(trim(text, ' ')) AS digest FROM conversations JOIN w USING (conv_id)"""
)
def page_text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as scanned documents: a record for each page with the checksum of the whole."""
    r = page_records(table(spark, sf_dir, "conversations"), "role", "conv_id", "turn", "text")
    return r.select("kind", "municipio", "fuente", "file_md5", "page_number", F.md5("text").alias("digest"))


@R.add(
    """WITH x AS (SELECT p_partkey AS k, 20.0::DOUBLE + p_size AS w, 15.0::DOUBLE + p_partkey % 12 AS h, 1.0::DOUBLE + (p_partkey % 5) * 0.75::DOUBLE AS l, 2.0::DOUBLE + (p_partkey % 3) * 0.5::DOUBLE AS b, 1.5::DOUBLE + (p_partkey % 7) * 0.25::DOUBLE AS r, 2.25::DOUBLE AS t, CASE WHEN p_partkey % 6 > 0 THEN (p_partkey % 4)::DOUBLE END AS need FROM part)
    SELECT k AS p_partkey, round(least(l, b, r, t), 2) AS measured, CASE WHEN need IS NULL THEN 'no_verificable' WHEN round(least(l, b, r, t), 2) >= need - 0.01::DOUBLE THEN 'cumple' ELSE 'no_cumple' END AS retranqueo FROM x"""
)
def measured_setback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as parcels with a building: the least gap between their outlines, judged with a tolerance of a centimetre."""
    k = C("p_partkey")
    w, h, left, bottom, right = 20.0 + C("p_size"), 15.0 + k % 12, 1.0 + (k % 5) * 0.75, 2.0 + (k % 3) * 0.5, 1.5 + (k % 7) * 0.25
    gap = g.least_gap(g.rectangle(left, w - right, bottom, h - 2.25), g.rectangle(F.lit(0.0), w, F.lit(0.0), h))
    parts = table(spark, sf_dir, "part").repartition(_cores(spark), "p_partkey")  # measuring costs more than dealing
    p = parts.select("p_partkey", F.round(gap, 2).alias("measured"), F.when(k % 6 > 0, (k % 4).cast("double")).alias("need"))
    verdict = F.when(C("need").isNull(), "no_verificable").when(C("measured") >= C("need") - 0.01, "cumple").otherwise("no_cumple")
    return p.select("p_partkey", "measured", verdict.alias("retranqueo"))


@R.add(
    """WITH x AS (SELECT p_partkey AS k, p_size::DOUBLE AS s, p_partkey % 4 AS kind FROM part)
    SELECT k AS p_partkey, CASE WHEN kind = 0 THEN CASE WHEN s > 0 AND s <= 60 THEN s END WHEN kind = 1 THEN NULL END AS altura, CASE WHEN kind = 2 AND s <= 15 THEN s END AS retranqueo, CASE WHEN kind = 3 THEN CASE WHEN s <= 1 THEN s ELSE s / 100 END END AS ocupacion FROM x
    WHERE (kind = 0 AND s > 0 AND s <= 60) OR (kind = 2 AND s <= 15) OR (kind = 3 AND s <= 100)"""
)
def hinted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tables of cells: read only if one of the first two rows says what a table of limits says."""
    k, s = C("p_partkey"), C("p_size").cast("string")
    line = lambda *cells: F.array(*(c if not isinstance(c, str) else F.lit(c) for c in cells))
    tables = (
        F.when(k % 4 == 0, F.array(line("Parámetro", "Valor"), line("Altura de cornisa", F.concat(s, F.lit(" m")), "900")))
        .when(k % 4 == 1, F.array(line("Nombre", "Cifra"), line("otra", "cosa"), line("Altura", s)))
        .when(k % 4 == 2, F.array(line("Concepto", "Separación"), line("Separación a linderos", s)))
        .otherwise(F.array(line("Ocupación", F.concat(s, F.lit(" %")))))
    )
    found = table(spark, sf_dir, "part").repartition(_cores(spark), "p_partkey").select("p_partkey", o.hinted_limits(tables).alias("l")).where("l is not null")
    return found.select("p_partkey", C("l.altura_maxima_m").alias("altura"), C("l.retranqueo_min_m").alias("retranqueo"), C("l.ocupacion_max").alias("ocupacion"))
