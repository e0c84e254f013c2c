"""More queries: as-of joins, nested documents, street widths, carried headings, literal-text tables, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonarium.functions import geometry as g
from zonarium.functions import sun
from zonarium.functions import text as t
from zonarium.operators import lookups, retrieval, spatial, windows
from zonarium.plans.cases import Cases
from zonarium.plans.registry import Registry, table
from zonarium.sources.literals import relation, values_sql

R = Registry()
C = F.col


@R.add(
    """WITH s AS (SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations),
    q AS (SELECT DISTINCT conv_id, pos FROM conversations, (VALUES (0), (150), (400), (2000)) v(pos))
    SELECT conv_id, pos, max_by(turn, start) AS turn FROM q JOIN s USING (conv_id) WHERE start <= pos GROUP BY conv_id, pos"""
)
def page_of_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn that holds a position of the joined conversation."""
    c = table(spark, sf_dir, "conversations")
    s = windows.offsets(c, ["conv_id"], "turn", "text").select("conv_id", "turn", C("start").cast("long").alias("start"))
    q = c.select("conv_id").distinct().select("conv_id", F.explode(F.array(*(F.lit(p).cast("long") for p in (0, 150, 400, 2000)))).alias("pos"))
    return windows.asof_join(q, s, ["conv_id"], "pos", "start", "turn", "turn")


_SEGMENTS = [(1, 0.0, 20.0, 100.0, 22.0), (2, 0.0, 60.0, 100.0, 55.0), (3, 50.0, 0.0, 52.0, 100.0)]


@R.add(
    f"""WITH {values_sql("seg", _SEGMENTS, ("sid", "ax", "ay", "bx", "yb"))}, p AS (SELECT s_suppkey, (s_suppkey * 53 % 1000)::DOUBLE / 10 AS x, (s_suppkey * 29 % 1000)::DOUBLE / 10 AS y FROM supplier),
    u AS (SELECT *, greatest(0.0, least(1.0, ((x - ax) * (bx - ax) + (y - ay) * (yb - ay)) / (pow(bx - ax, 2) + pow(yb - ay, 2)))) AS k FROM p CROSS JOIN seg),
    d AS (SELECT s_suppkey, sid, sqrt(pow(x - ax - k * (bx - ax), 2) + pow(y - ay - k * (yb - ay), 2)) AS d FROM u),
    r AS (SELECT s_suppkey, first(sid ORDER BY round(d, 9), sid) AS sid, round(2 * min(d), 4) AS ancho FROM d GROUP BY s_suppkey)
    SELECT s_suppkey, sid, CASE WHEN s_suppkey % 6 = 0 THEN 15.0 WHEN ancho BETWEEN 3 AND 45 THEN ancho END::DOUBLE AS ancho, CASE WHEN s_suppkey % 6 = 0 THEN 'oficial' WHEN ancho BETWEEN 3 AND 45 THEN 'estimado' END AS fuente FROM r"""
)
def street_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest street axis of each building, the width taken from it, an official width first (few axes: each meets every building)."""
    k = C("s_suppkey")
    p = table(spark, sf_dir, "supplier").select("s_suppkey", ((k * 53 % 1000).cast("double") / 10).alias("x"), ((k * 29 % 1000).cast("double") / 10).alias("y"))
    axes = F.array(*(F.struct(F.lit(i).alias("sid"), *(F.lit(v).alias(n) for v, n in zip(xy, ("ax", "ay", "bx", "by"), strict=True))) for i, *xy in _SEGMENTS))
    d = F.transform(axes, lambda s: F.struct(F.round(g.point_segment_distance(C("x"), C("y"), s["ax"], s["ay"], s["bx"], s["by"]), 9).alias("d"), s["sid"].alias("sid")))
    near = p.select("s_suppkey", F.array_min(d).alias("n")).select("s_suppkey", C("n.sid").cast("long").alias("sid"), F.round(2 * C("n.d"), 4).alias("w"))
    official, estimated = F.when(k % 6 == 0, 15.0), F.when(C("w").between(3, 45), C("w"))
    return near.select("s_suppkey", "sid", F.coalesce(official, estimated).alias("ancho"), F.when(official.isNotNull(), "oficial").when(estimated.isNotNull(), "estimado").alias("fuente"))


_TILES = [("t1", 0.0, 50.0, 0.0, 50.0), ("t2", 50.0, 100.0, 0.0, 50.0), ("t3", 0.0, 100.0, 50.0, 100.0), ("t4", 40.0, 60.0, 40.0, 60.0)]


@R.add(
    f"""WITH {values_sql("tiles", _TILES, ("tile", "xmin", "xmax", "ymin", "ymax"))}, p AS (SELECT c_custkey, (c_custkey * 37 % 1000)::DOUBLE / 10 AS x, (c_custkey * 91 % 1000)::DOUBLE / 10 AS y FROM customer)
    SELECT tile, count(*) AS n, min(c_custkey) AS first FROM p JOIN tiles ON x >= xmin AND x < xmax AND y >= ymin AND y < ymax GROUP BY tile"""
)
def tiles_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles by their bounds alone: which files a set of points needs."""
    from zonarium.plans.rule_queries import _points

    hit = spatial.cell_join(_points(spark, sf_dir), relation(spark, _TILES, ("tile", "xmin", "xmax", "ymin", "ymax")), 25.0)
    return hit.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first"))


@R.add("WITH r AS (SELECT p_brand AS k, p_type AS v, p_size AS file, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_type) AS rn FROM part) SELECT k, v, file FROM r WHERE rn = 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is an entry of the file numbered by its size; entries of later files override those of earlier ones."""
    p = table(spark, sf_dir, "part").select(C("p_brand").alias("k"), C("p_type").alias("v"), C("p_size").alias("file"))
    return p.groupBy("k").agg(F.min(F.struct((-C("file")).alias("f"), "v")).alias("r")).select("k", "r.v", (-C("r.f")).alias("file"))


@R.add("SELECT count(*) FILTER (e.vec_id IS NULL) AS missing, count(*) FILTER (d.doc_id IS NULL) AS orphaned, count(*) FILTER (e.vec_id IS NOT NULL AND d.doc_id IS NOT NULL) AS valid FROM (SELECT vec_id FROM embeddings) e FULL JOIN (SELECT doc_id FROM documents) d ON d.doc_id = e.vec_id")
def index_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the keys of a vector index are those of the corpus."""
    e, d = table(spark, sf_dir, "embeddings").select("vec_id"), table(spark, sf_dir, "documents").select("doc_id")
    j = e.join(d, e["vec_id"] == d["doc_id"], "full")
    return j.agg(F.count_if(C("vec_id").isNull()).alias("missing"), F.count_if(C("doc_id").isNull()).alias("orphaned"), F.count_if(C("vec_id").isNotNull() & C("doc_id").isNotNull()).alias("valid"))


_NESTED = [(1, "PXOM", '[{"name":"a","parts":["x.pdf",""]},{"name":"b","parts":["y.pdf","z.pdf"]}]'), (2, "PE", '[{"name":"c","parts":[]}]'), (3, "PXOM", "[]")]
_NESTED_AT = Cases(_NESTED, ("id", "clase", "doc"))


@R.add(
    f"""WITH {_NESTED_AT.sql("d")}, c AS (SELECT id, clase, unnest(from_json(doc, '[{{"name":"VARCHAR","parts":["VARCHAR"]}}]')) AS c FROM d), p AS (SELECT id, clase, c.name AS name, unnest(c.parts) AS part FROM c)
    SELECT clase, id, name, 'https://example.org/' || id || '/' || part AS url FROM p WHERE trim(part) <> ''"""
)
def nested_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents flattened twice, blank paths dropped, addresses built."""
    d = _NESTED_AT.frame(spark, sf_dir).select("id", "clase", F.explode(F.from_json("doc", "array<struct<name: string, parts: array<string>>>")).alias("c"))
    p = d.select("id", "clase", "c.name", F.explode("c.parts").alias("part")).where(F.trim("part") != "")
    return p.select("clase", "id", "name", F.concat(F.lit("https://example.org/"), C("id").cast("string"), F.lit("/"), "part").alias("url"))


@R.add("SELECT l_orderkey, max(CASE WHEN l_returnflag <> 'R' THEN l_linenumber END) AS sobre, coalesce(max(CASE WHEN l_returnflag = 'R' THEN l_linenumber END), 0) AS bajo, count(*) AS partes FROM lineitem GROUP BY l_orderkey")
def floors_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floors above and below ground and the number of parts."""
    n, below = C("l_linenumber"), C("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.when(~below, n)).alias("sobre"), F.coalesce(F.max(F.when(below, n)), F.lit(0)).alias("bajo"), F.count(F.lit(1)).alias("partes"))


@R.add(
    """WITH c AS (SELECT conv_id, turn, role, nullif(regexp_extract(text, '([A-Z][a-z]{7,})', 1), '') AS head FROM conversations), n AS (SELECT *, count(head) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS gr FROM c)
    SELECT conv_id, max(head) AS head, min(turn) AS first, max(turn) AS last, count(*) AS rows FROM n WHERE gr > 0 GROUP BY conv_id, gr"""
)
def carried_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under the sheet header that stands above them, with the span of pages."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.nullif(F.regexp_extract("text", "([A-Z][a-z]{7,})", 1), F.lit("")).alias("head"))
    return windows.carried_block(c, ["conv_id"], "turn", "head")


@R.add(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, lag(l_returnflag) OVER w AS pf, lag(l_quantity) OVER w AS pq, l_returnflag AS f FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey))
    SELECT count(*) AS kept, sum(l_quantity) AS total FROM l WHERE NOT coalesce(pf = f AND l_quantity - pq < 3, false)"""
)
def repeated_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows less those that repeat their predecessor's reference too soon after it."""
    i = table(spark, sf_dir, "lineitem").withColumn("o", F.struct("l_linenumber", "l_suppkey", "l_partkey"))
    return windows.suppressed_repeats(i, ["l_orderkey"], "o", "l_returnflag", "l_quantity", 3).agg(F.count(F.lit(1)).alias("kept"), F.sum("l_quantity").alias("total"))


_BUILT = [(1, 14.0, 12.0, 0.55, 0.5, None, 1.2), (2, 9.0, 12.0, 0.3, 0.5, 0.9, 1.2), (3, None, 12.0, 0.5, None, 1.3, 1.2)]
_BUILT_COLUMNS = ("id", "alt", "alt_max", "ocu", "ocu_max", "edi", "edi_max")
_BUILT_AT = Cases(_BUILT, _BUILT_COLUMNS, vary={"alt": 0.75, "ocu": 0.05, "edi": 0.2})


@R.add(
    f"""WITH {_BUILT_AT.sql("b")}, r AS (SELECT id, unnest(['altura', 'ocupacion', 'edificabilidad']) AS param, unnest([alt, ocu, edi]) AS observed, unnest([alt_max, ocu_max, edi_max]) AS required FROM b)
    SELECT id, param, observed, required, CASE WHEN observed IS NULL OR required IS NULL THEN 'no_verificable' WHEN observed <= required THEN 'cumple' ELSE 'no_cumple' END AS estado, round(observed - required, 4) AS exceso FROM r"""
)
def comparison_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A building against its zone, one row for each parameter."""
    b = _BUILT_AT.frame(spark, sf_dir)
    rows = F.array(*(F.struct(F.lit(n).alias("param"), C(a).alias("observed"), C(m).alias("required")) for n, a, m in (("altura", "alt", "alt_max"), ("ocupacion", "ocu", "ocu_max"), ("edificabilidad", "edi", "edi_max"))))
    r = b.select("id", F.explode(rows).alias("r")).select("id", "r.*")
    over = C("observed") - C("required")
    return r.select("*", F.when(over.isNull(), "no_verificable").when(over <= 0, "cumple").otherwise("no_cumple").alias("estado"), F.round(over, 4).alias("exceso"))


_ORDINANCE = [
    (1, "Altura segun ancho: menos de 6 m: 3 plantas {a},5 m; de 6 a 12 m: 4 plantas 13 m; de 12 a 18 m: 5 plantas 16,5 m"),
    (2, "Altura: ancho de la calle + {c} m"),
    (3, "Altura: ancho x 1,{c}"),
    (4, "sin tabla; de 6 a 12 m: 4 plantas 13 m"),
]
_ORDINANCE_AT = Cases(_ORDINANCE, ("id", "body"), source="documents", key="doc_id", whole=("body",))


@R.add(
    f"""WITH {_ORDINANCE_AT.sql("o")}, m AS (SELECT id, body, regexp_extract_all(body, 'de ([0-9]+) a ([0-9]+) m: ([0-9]+) plantas ([0-9]+(?:,[0-9]+)?) m', 0) AS f, regexp_extract(body, 'menos de ([0-9]+) m: ([0-9]+) plantas', 1) AS low FROM o)
    SELECT id, CASE WHEN len(f) + (low <> '')::INT >= 2 THEN len(f) + (low <> '')::INT ELSE 0 END::BIGINT AS filas, CASE WHEN len(f) + (low <> '')::INT >= 2 THEN list_max([try_cast(replace(x, ',', '.') AS DOUBLE) FOR x IN regexp_extract_all(body, 'plantas ([0-9]+(?:,[0-9]+)?) m', 1)]) END AS mayor,
    CASE WHEN regexp_matches(body, 'ancho[^;]*\\+ ?[0-9]') THEN '+' WHEN regexp_matches(body, 'ancho[^;]* x ?[0-9]') THEN '*' END AS formula, try_cast(replace(nullif(regexp_extract(body, 'ancho[^;]*(?:\\+| x) ?([0-9]+(?:,[0-9]+)?)', 1), ''), ',', '.') AS DOUBLE) AS op FROM m"""
)
def heights_by_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width tables (two rows at least) and width formulas in ordinance texts."""
    b = C("body")
    rows = F.size(F.regexp_extract_all("body", F.lit(r"de ([0-9]+) a ([0-9]+) m: ([0-9]+) plantas ([0-9]+(?:,[0-9]+)?) m"), F.lit(0))) + b.rlike("menos de ([0-9]+) m: ([0-9]+) plantas").cast("int")
    tops = F.array_max(F.transform(F.regexp_extract_all("body", F.lit(r"plantas ([0-9]+(?:,[0-9]+)?) m"), F.lit(1)), lambda x: t.number(x)))
    op = t.number(F.nullif(F.regexp_extract("body", r"ancho[^;]*(?:\+| x) ?([0-9]+(?:,[0-9]+)?)", 1), F.lit("")))
    return _ORDINANCE_AT.frame(spark, sf_dir).select(
        "id", F.when(rows >= 2, rows).otherwise(0).cast("long").alias("filas"), F.when(rows >= 2, tops).alias("mayor"), F.when(b.rlike(r"ancho[^;]*\+ ?[0-9]"), "+").when(b.rlike("ancho[^;]* x ?[0-9]"), "*").alias("formula"), op.alias("op")
    )


_USES = [(1, "Usos permitidos:"), (2, "- Residencial en todas"), (3, "  las {c} plantas"), (4, "- Comercial hasta {b} m2"), (5, "Condiciones"), (6, "texto suelto")]
_USES_AT = Cases(_USES, ("n", "line"))


@R.add(
    f"""WITH {_USES_AT.sql("l")}, m AS (SELECT *, n // 6 AS doc, starts_with(line, '- ') AS s, starts_with(line, '  ') AS c FROM l), gr AS (SELECT *, sum(CASE WHEN c THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY n) AS gid FROM m)
    SELECT min(n) AS n, string_agg(regexp_replace(trim(line), '^- ', ''), ' ' ORDER BY n) AS uso FROM gr GROUP BY doc, gid HAVING bool_or(s)"""
)
def uses_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulleted uses of many documents with their continuation lines."""
    lines = _USES_AT.frame(spark, sf_dir).withColumn("doc", F.expr("n div 6"))
    s = windows.segments(lines, ["doc"], "n", ~F.startswith("line", F.lit("  ")))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: F.regexp_replace(F.trim(x["line"]), "^- ", "")), " ")
    return s.groupBy("doc", "segment").agg(F.min("n").alias("n"), said.alias("uso"), F.bool_or(F.startswith("line", F.lit("- "))).alias("b")).where("b").select("n", "uso")


_MENTIONS = [(1, "API-1", "aprobado definitivamente"), (2, "API-1", "eliminado del plan"), (3, "API-2", "aprobado"), (4, "API-3", "sin mas"), (5, "API-2", "aprobado de nuevo")]
_MENTIONS_AT = Cases(_MENTIONS, ("n", "code", "ctx"), each=("code",))


@R.add(
    f"""WITH {_MENTIONS_AT.sql("m")}, s AS (SELECT *, CASE WHEN contains(ctx, 'eliminad') THEN 'eliminado' WHEN contains(ctx, 'aprobad') THEN 'vigente' END AS st FROM m)
    SELECT code, count(*) AS mentions, CASE WHEN count(DISTINCT st) > 1 THEN 'mixto' ELSE max(st) END AS estado, min(n) AS first FROM s GROUP BY code"""
)
def inline_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States that the mentions of an instrument give it; conflicting ones are mixed."""
    st = F.when(F.contains("ctx", F.lit("eliminad")), "eliminado").when(F.contains("ctx", F.lit("aprobad")), "vigente")
    m = _MENTIONS_AT.frame(spark, sf_dir).withColumn("st", st)
    return m.groupBy("code").agg(F.count(F.lit(1)).alias("mentions"), F.when(F.count_distinct("st") > 1, "mixto").otherwise(F.max("st")).alias("estado"), F.min("n").alias("first"))


_ANSWERS = [
    (1, "La altura es de {a} m (art. {b}) y 45 % [F1]", "art. 62: altura de 12 m y ocupacion 45 %", 2), (2, "Son {b} m segun el art. 99 [F3]", "art. 62: altura de {b} m", 1), (3, "No consta", "", 0),
]
_ANSWERS_AT = Cases(_ANSWERS, ("id", "answer", "sources", "n"))


@R.add(
    f"""WITH {_ANSWERS_AT.sql("a")}, x AS (SELECT *, list_distinct(regexp_extract_all(answer, '([0-9]+(?:[.,][0-9]+)?)', 1)) AS ns, regexp_extract_all(sources, '([0-9]+(?:[.,][0-9]+)?)', 1) AS ss,
        [CAST(k AS INT) FOR k IN regexp_extract_all(answer, '\\[F([0-9]+)\\]', 1)] AS cites FROM a)
    SELECT id, len([k FOR k IN ns IF NOT list_contains(ss, k) AND CAST(replace(k, ',', '.') AS DOUBLE) > 31])::BIGINT AS unsupported, coalesce(list_max(cites) > n, false) AS bad_citation, CASE WHEN n >= 2 THEN 'alta' WHEN n = 1 THEN 'media' ELSE 'baja' END AS calidad, CASE WHEN n = 0 THEN 'unavailable' ELSE 'documental' END AS modo FROM x"""
)
def answer_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers without a source, citations beyond the sources, quality and mode of an answer."""
    from zonarium.operators.quality import source_quality

    a = _ANSWERS_AT.frame(spark, sf_dir)
    loose = F.filter(F.array_except(t.numbers(C("answer")), t.numbers(C("sources"))), lambda k: k.cast("double") > 31)
    cites = F.transform(F.regexp_extract_all("answer", F.lit(r"\[F([0-9]+)\]"), F.lit(1)), lambda k: k.cast("int"))
    n = C("n")
    return a.select("id", F.size(loose).cast("long").alias("unsupported"), F.coalesce(F.array_max(cites) > n, F.lit(False)).alias("bad_citation"), source_quality([n > 0, n > 1]).alias("calidad"), F.when(n == 0, "unavailable").otherwise("documental").alias("modo"))


@R.add(
    """WITH x AS (SELECT c_custkey, -9.0 + (c_custkey % 600) / 100.0 AS lon, 42.0 + (c_custkey % 150) / 100.0 AS lat FROM customer)
    SELECT CASE WHEN lon <= -6 THEN 'EPSG:25829' ELSE 'EPSG:25830' END AS crs, count(*) AS n, count(*) FILTER (lon BETWEEN -9.4 AND -6.6 AND lat BETWEEN 41.7 AND 43.9) AS in_region, round(avg(111320 * cos(radians(lat))), 3)::DOUBLE AS m_per_degree, count(*) FILTER (abs(lon + 8.0) < 0.01) AS near_meridian FROM x GROUP BY ALL"""
)
def reference_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric system by longitude, region test, local scale, coordinate agreement."""
    k = C("c_custkey")
    x = table(spark, sf_dir, "customer").select((-9.0 + F.round((k % 600) / 100.0, 2)).alias("lon"), (42.0 + (k % 150) / 100.0).alias("lat"))
    x = x.withColumn("lon", F.round("lon", 2))
    inside = C("lon").between(-9.4, -6.6) & C("lat").between(41.7, 43.9)
    return x.groupBy(sun.metric_crs(C("lon")).alias("crs")).agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("in_region"), F.round(F.avg(111320 * F.cos(F.radians("lat"))), 3).alias("m_per_degree"), F.count_if(F.abs(C("lon") + 8.0) < 0.01).alias("near_meridian"))


@R.add(
    "SELECT date_trunc('day', ts) AS day, event_type AS route, CASE WHEN event_type = 'error' THEN '5xx' WHEN value < 5 THEN '4xx' ELSE '2xx' END AS status, count(*) AS n FROM events GROUP BY ALL"
)
def request_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by day, route and class of status."""
    status = F.when(C("event_type") == "error", "5xx").when(C("value") < 5, "4xx").otherwise("2xx")
    return table(spark, sf_dir, "events").groupBy(F.expr("date_trunc('DAY', ts)").cast("timestamp_ntz").alias("day"), C("event_type").alias("route"), status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@R.add(
    """WITH x AS (SELECT p_partkey, p_name, p_size, CASE WHEN p_size % 4 > 0 THEN p_size::DOUBLE END AS h, CASE WHEN p_size % 3 = 0 THEN 'north' END AS d, CASE WHEN p_size % 6 = 0 THEN 3.0 END AS s FROM part)
    SELECT p_partkey, coalesce(h, 9.0)::DOUBLE AS altura, CASE WHEN s IS NOT NULL THEN d END AS direccion, s::DOUBLE AS retranqueo FROM x"""
)
def patched_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank heights take the default, directions without setbacks are dropped."""
    s = C("p_size")
    setback = F.when(s % 6 == 0, 3.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.when(s % 4 > 0, s.cast("double")), F.lit(9.0)).alias("altura"), F.when(setback.isNotNull(), F.when(s % 3 == 0, "north")).alias("direccion"), setback.alias("retranqueo"))


@R.add(
    """WITH x AS (SELECT s_suppkey, 5.0 + s_suppkey % 20 AS alt, s_suppkey % 3 AS alzados, CASE WHEN s_suppkey % 4 = 0 THEN 'catalogado' END AS cat FROM supplier)
    SELECT s_suppkey, array_to_string([w FOR w IN [CASE WHEN alzados = 0 THEN 'sin_alzado' END, CASE WHEN cat IS NOT NULL AND alt > 12 THEN 'catalogado_alto' END, CASE WHEN alzados > 1 THEN 'varios_alzados' END] IF w IS NOT NULL], ',') AS avisos FROM x"""
)
def historic_height_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings for heights that facade plans settle."""
    k = C("s_suppkey")
    w = F.array_compact(F.array(F.when(k % 3 == 0, "sin_alzado"), F.when((k % 4 == 0) & (5.0 + k % 20 > 12), "catalogado_alto"), F.when(k % 3 > 1, "varios_alzados")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(w, ",").alias("avisos"))


@R.add()
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a keyword search through the re-ranking hook with its default score (shared terms over length)."""
    from zonarium.functions.models import rerank

    d = table(spark, sf_dir, "documents")
    q = relation(spark, [(1, "thonha reesh onha")], ("qid", "question"))
    hits = lookups.top_k(retrieval.bm25(d, q, "doc_id", "text", "qid", "question"), ["qid"], 20, F.desc(F.round("score", 9)), C("doc_id")).drop("rank")
    pairs = hits.join(d.select("doc_id", "text"), "doc_id").join(F.broadcast(q), "qid")
    scored = rerank(pairs.select("qid", "doc_id", "question", "text"), "question", "text")
    return lookups.top_k(scored, ["qid"], 5, F.desc("rerank"), C("doc_id")).select("qid", "doc_id", "rank", F.round("rerank", 6).alias("rerank"))


