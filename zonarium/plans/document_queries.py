"""Queries over inventories, pages, codes and literal texts: filters, ladders, matches, line parsing, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonarium.functions import parse
from zonarium.functions import text as t
from zonarium.operators import ladders, lookups, retrieval
from zonarium.plans.cases import Cases
from zonarium.plans.registry import Registry, table
from zonarium.plans.rule_queries import _PIP, _hits, _points
from zonarium.sources.literals import relation, values_sql

R = Registry()
C = F.col


@R.add("SELECT n_nationkey, n_name FROM nation WHERE strip_accents(lower(trim(n_name))) LIKE '%nation_1%' OR n_nationkey = 7")
def inventory_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a part of the accent-free name or by code."""
    n = table(spark, sf_dir, "nation")
    return n.where(F.contains(t.fold(F.trim("n_name")), F.lit("nation_1")) | (C("n_nationkey") == 7)).select("n_nationkey", "n_name")


@R.add(
    """WITH p AS (SELECT c_custkey, c_mktsegment, (c_custkey * 37 % 1000)::DOUBLE / 10 AS x, (c_custkey * 91 % 1000)::DOUBLE / 10 AS y, c_acctbal FROM customer)
    SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'otro') AS uso, round(coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0), 2) AS valor FROM p WHERE x BETWEEN 20 AND 45 AND y BETWEEN 10 AND 60 ORDER BY c_custkey LIMIT 100"""
)
def layer_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features in a box, at most a hundred in key order (the layer's own limit), properties with defaults."""
    p = _points(spark, sf_dir).join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    kept = p.where(C("x").between(20, 45) & C("y").between(10, 60)).orderBy("c_custkey").limit(100)
    return kept.select("c_custkey", F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("otro")).alias("uso"), F.round(F.coalesce(F.when(C("c_acctbal") > 0, C("c_acctbal")), F.lit(0.0)), 2).alias("valor"))


@R.add(
    """SELECT p_partkey, list_sort([x FOR x IN [CASE WHEN p_size > 10 THEN 'size=' || p_size END, CASE WHEN p_brand <> 'Brand#11' THEN 'brand=' || p_brand END, CASE WHEN p_partkey % 2 = 0 THEN 'type=' || p_type END] IF x IS NOT NULL]) AS props FROM part"""
)
def null_free_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties as a map without its nulls."""
    m = F.create_map(F.lit("size"), F.when(C("p_size") > 10, C("p_size").cast("string")), F.lit("brand"), F.when(C("p_brand") != "Brand#11", C("p_brand")), F.lit("type"), F.when(C("p_partkey") % 2 == 0, C("p_type")))
    kept = F.map_filter(m, lambda k, v: v.isNotNull())
    return table(spark, sf_dir, "part").select("p_partkey", F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("props"))


@R.add("SELECT page_id FROM pages WHERE (contains(lower(html), 'esti') OR contains(lower(html), 'verheit')) AND (starts_with(url, 'https://m.') OR starts_with(url, 'https://blog.') OR starts_with(url, 'http://'))")
def keyword_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.lower("html")
    any_word = F.exists(F.array(F.lit("esti"), F.lit("verheit")), lambda k: F.contains(body, k))
    any_section = F.exists(F.array(*map(F.lit, ("https://m.", "https://blog.", "http://"))), lambda p: F.startswith(C("url"), p))
    return table(spark, sf_dir, "pages").where(any_word & any_section).select("page_id")


@R.add(
    """SELECT l_orderkey, max(CASE WHEN l_quantity BETWEEN 2 AND 40 THEN l_quantity END) AS altura, min(CASE WHEN l_discount * 100 BETWEEN 1 AND 15 THEN round(l_discount * 100, 2) END) AS retranqueo, max(CASE WHEN l_tax * 100 <= 5 THEN round(l_tax * 100, 2) END) AS edificabilidad, min(l_linenumber) || '-' || max(l_linenumber) AS paginas FROM lineitem GROUP BY l_orderkey"""
)
def plausible_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes of the plausible values only, and the span of pages they stand on."""
    q, d, x = C("l_quantity"), C("l_discount") * 100, C("l_tax") * 100
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max(F.when(q.between(2, 40), q)).alias("altura"), F.min(F.when(d.between(1, 15), F.round(d, 2))).alias("retranqueo"), F.max(F.when(x <= 5, F.round(x, 2))).alias("edificabilidad"), F.concat_ws("-", F.min("l_linenumber").cast("string"), F.max("l_linenumber").cast("string")).alias("paginas")
    )


@R.add(
    """WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 7.0 + o_orderkey % 9 END AS medida, CASE WHEN o_orderkey % 3 = 0 THEN 9.0 END AS capa, 12.0 AS estimada FROM orders)
    SELECT o_orderkey, coalesce(medida, capa, estimada)::DOUBLE AS altura, CASE WHEN medida IS NOT NULL THEN 'measured' WHEN capa IS NOT NULL THEN 'official' ELSE 'estimated' END AS data_quality, CASE WHEN (medida IS NOT NULL)::INT + (capa IS NOT NULL)::INT >= 2 THEN 'alta' WHEN medida IS NOT NULL OR capa IS NOT NULL THEN 'media' ELSE 'baja' END AS calidad FROM h"""
)
def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source that has a value, with its label and how many sources there were."""
    from zonarium.operators.quality import source_quality

    k = C("o_orderkey")
    measured, layer = F.when(k % 5 == 0, 7.0 + k % 9), F.when(k % 3 == 0, 9.0)
    point = ladders.first_source([("measured", measured), ("official", layer), ("estimated", F.lit(12.0))])
    return table(spark, sf_dir, "orders").select("o_orderkey", point.alias("p"), source_quality([measured.isNotNull(), layer.isNotNull()]).alias("calidad")).select("o_orderkey", C("p.value").alias("altura"), C("p.source").alias("data_quality"), "calidad")


_AREAS = [("PP-3-B", "a"), ("PP-4", "b"), ("pe-1", "c"), ("UA-7", "d")]
_ASKED = [(1, "PP-3-B"), (2, "PP-4-A"), (3, "PE-1"), (4, "UA-7-C"), (5, "XX"), (6, "ua-7")]
_ASKED_AT = Cases(_ASKED, ("id", "code"), source="part", key="p_partkey")


@R.add(
    f"""WITH {values_sql("a", _AREAS, ("code", "sheet"))}, {_ASKED_AT.sql("q")},
    v AS (SELECT id, unnest([code, upper(code), lower(code), regexp_replace(upper(code), '-[A-Z]$', '')]) AS v, unnest([1, 2, 3, 4]) AS p FROM q),
    r AS (SELECT id, a.code, sheet, row_number() OVER (PARTITION BY id ORDER BY p) AS rn FROM v JOIN a ON a.code = v)
    SELECT q.id, r.code AS found, sheet FROM q LEFT JOIN r ON r.id = q.id AND rn = 1"""
)
def variant_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code as it is, in upper and lower case, then without its letter; the first that exists."""
    q, a = _ASKED_AT.frame(spark, sf_dir), relation(spark, _AREAS, ("code", "sheet"))
    c = C("code")
    return ladders.first_variant(q, "id", [c, F.upper(c), F.lower(c), F.regexp_replace(F.upper(c), "-[A-Z]$", "")], a, "code").select("id", C("hit.code").alias("found"), C("hit.sheet").alias("sheet"))


@R.add(
    f"""WITH {_PIP}, o AS (SELECT c_custkey, count(DISTINCT code) FILTER (estado = 'official') AS n, min(code) FILTER (estado = 'official') AS oficial, min(code) FILTER (estado = 'pilot') AS piloto FROM hits GROUP BY c_custkey)
    SELECT p.c_custkey, CASE WHEN n > 1 THEN 'ambiguo' WHEN n = 1 THEN 'oficial' WHEN piloto IS NOT NULL THEN 'orientativo' ELSE 'sin_cobertura' END AS estado, CASE WHEN n = 1 THEN oficial WHEN coalesce(n, 0) = 0 THEN piloto END AS code FROM pts p LEFT JOIN o USING (c_custkey)"""
)
def official_over_pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One official zone counts, several are ambiguous, a pilot zone only guides, none stays none."""
    official, pilot = F.when(C("estado") == "official", C("code")), F.when(C("estado") == "pilot", C("code"))
    o = _hits(spark, sf_dir).groupBy("c_custkey").agg(F.count_distinct(official).alias("n"), F.min(official).alias("oficial"), F.min(pilot).alias("piloto"))
    state = F.when(C("n") > 1, "ambiguo").when(C("n") == 1, "oficial").when(C("piloto").isNotNull(), "orientativo").otherwise("sin_cobertura")
    code = F.when(C("n") == 1, C("oficial")).when(F.coalesce("n", F.lit(0)) == 0, C("piloto"))
    return _points(spark, sf_dir).select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", state.alias("estado"), code.alias("code"))


_LADDER = [
    (1, "U1", None, None, None, None, None), (2, None, "U2", None, None, None, None), (3, "ZZ", "U2", None, None, None, None), (4, None, None, "PP-1", None, None, None), (5, None, None, None, "EQ", None, None),
    (6, None, None, None, None, "U3,U4", None), (7, None, None, None, None, None, "U5"), (8, None, None, None, None, None, None),
]
_LADDER_COLUMNS = ("id", "indicada", "capa", "ambito", "dotacion", "proximas", "piloto")
_LADDER_AT = Cases(_LADDER, _LADDER_COLUMNS)


@R.add(
    f"""WITH {_LADDER_AT.sql("c")} SELECT id,
    CASE WHEN indicada IN ('U1', 'U2', 'U3') THEN 'indicada' WHEN capa IS NOT NULL THEN 'capa_oficial' WHEN ambito IS NOT NULL THEN 'ambito' WHEN dotacion IS NOT NULL THEN 'dotacion' WHEN piloto IS NOT NULL THEN 'piloto' WHEN proximas IS NOT NULL THEN 'candidatas' ELSE 'sin_dato' END AS estado,
    CASE WHEN indicada IN ('U1', 'U2', 'U3') THEN indicada WHEN capa IS NOT NULL THEN capa WHEN ambito IS NOT NULL THEN ambito WHEN dotacion IS NOT NULL THEN dotacion WHEN piloto IS NOT NULL THEN piloto END AS codigo,
    CASE WHEN indicada IN ('U1', 'U2', 'U3') OR capa IS NOT NULL THEN 'alta' WHEN ambito IS NOT NULL OR dotacion IS NOT NULL THEN 'media' WHEN piloto IS NOT NULL OR proximas IS NOT NULL THEN 'baja' END AS confianza FROM c"""
)
def ordinance_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _LADDER_AT.frame(spark, sf_dir)
    s = ladders.ordinance_state(C("indicada"), C("indicada").isin("U1", "U2", "U3"), C("capa"), C("ambito"), C("dotacion"), C("piloto"), C("proximas"))
    return c.select("id", s.alias("s")).select("id", "s.estado", "s.codigo", "s.confianza")


@R.add(
    """WITH d AS (SELECT doc_id, lang, source, floor(n_chars / 50)::BIGINT AS size, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}'))) AS ws FROM documents),
    s AS (SELECT a.doc_id, b.doc_id AS other, round(len(list_intersect(a.ws, b.ws)) / greatest(len(a.ws), 1), 6) AS share FROM d a JOIN d b USING (lang, source, size) WHERE a.doc_id % 20 = 0 AND b.doc_id <> a.doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, other) AS rn, lead(share) OVER (PARTITION BY doc_id ORDER BY share DESC, other) AS second FROM s)
    SELECT doc_id, other, round(share, 4) AS share FROM r WHERE rn = 1 AND share >= 0.02 AND (second IS NULL OR share > second)"""
)
def document_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an id divisible by 20 against all: joined on language, source and size, the tie broken by word overlap: enough, and strictly the best.

    Documents with the same words are one class before the join, so a group of copies is one candidate; a class of
    several documents ties with itself and is the best of nobody.
    """
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), F.lit(1))))
    by = ["lang", "source", "size"]
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.floor(C("n_chars") / 50).alias("size"), words.alias("ws"))
    classes = d.groupBy(*by, C("ws").alias("wt")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    j = d.where("doc_id % 20 = 0").join(classes, by)
    own = C("ws") == C("wt")
    others = C("n") - own.cast("int")
    share = F.round(F.size(F.array_intersect("ws", "wt")) / F.greatest(F.size("ws"), F.lit(1)), 6)
    scored = j.where(others > 0).select("doc_id", F.when(own & (C("low") == C("doc_id")), C("high")).otherwise(C("low")).alias("other"), share.alias("share"), others.alias("others"))
    best = scored.groupBy("doc_id").agg(F.max("share").alias("share"), F.max_by("other", "share").alias("other"))
    tied = scored.join(best.select("doc_id", "share"), ["doc_id", "share"]).groupBy("doc_id").agg(F.sum("others").alias("ties"))
    return best.join(tied, "doc_id").where("ties = 1 and share >= 0.02").select("doc_id", "other", F.round("share", 4).alias("share"))


@R.add("SELECT o_orderkey, round(o_totalprice * (0.5 + (o_orderkey % 11) / 10.0), 3)::DOUBLE AS dicho, abs(o_orderkey % 11 / 10.0 - 0.5) > 0.25 AS discrepa FROM orders")
def claims_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claimed value against the official one: more than a quarter apart is a contradiction."""
    share = 0.5 + (C("o_orderkey") % 11) / 10.0
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(C("o_totalprice") * share, 3).alias("dicho"), (F.abs(F.round(share - 1, 6)) > 0.25).alias("discrepa"))


@R.add(
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents), best AS (SELECT doc_id, 0 AS pri, rank FROM r WHERE rank <= 20),
    x AS (SELECT doc_id, 1 AS pri, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS rank FROM documents WHERE contains(text, 'AKIA') OR doc_id % 97 = 0), y AS (SELECT * FROM x WHERE rank <= 5),
    u AS (SELECT * FROM best UNION ALL SELECT * FROM y), d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pri, rank) AS rn FROM u)
    SELECT doc_id, pri, rank FROM d WHERE rn = 1"""
)
def pool_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twenty, five exact hits injected behind them, each document once."""
    d = table(spark, sf_dir, "documents")
    best = d.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20).select("doc_id", F.lit(0).alias("pri"), F.row_number().over(W.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    exact = d.where(F.contains("text", F.lit("AKIA")) | (C("doc_id") % 97 == 0)).select("doc_id", F.length("text").alias("n")).orderBy(F.desc("n"), "doc_id").limit(5)
    extra = exact.select("doc_id", F.lit(1).alias("pri"), F.row_number().over(W.orderBy(F.desc("n"), "doc_id")).alias("rank"))
    return best.unionByName(extra).groupBy("doc_id").agg(F.min(F.struct("pri", "rank")).alias("k")).select("doc_id", "k.pri", "k.rank")


@R.add(
    """WITH b AS (SELECT p_brand, list_transform(list_sort(list({'s': p_size, 'k': p_partkey, 'f': p_retailprice})), lambda x: CASE WHEN x.s < 5 THEN '<5' ELSE x.s::VARCHAR END || '→' || replace(regexp_replace(printf('%.2f', x.f), '\\.?0+$', ''), '.', ',')) AS l FROM part GROUP BY p_brand)
    SELECT p_brand, array_to_string(l[1:4], '; ') AS txt FROM b"""
)
def width_table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows by their lower bound, written out with decimal commas."""
    rows = F.array_sort(F.collect_list(F.struct(C("p_size").alias("s"), C("p_partkey").alias("k"), C("p_retailprice").alias("f"))))
    said = F.transform(F.slice("l", 1, 4), lambda x: F.concat(F.when(x["s"] < 5, "<5").otherwise(x["s"].cast("string")), F.lit("→"), t.formatted(x["f"])))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(rows.alias("l")).select("p_brand", F.array_join(said, "; ").alias("txt"))


_LINES_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"


@R.add(
    f"""WITH {_LINES_SQL}, k AS (SELECT doc_id, n, line, length(line) > 0 AND length(regexp_replace(line, '[^A-ZÁÉÍÓÚÑÄÖÜ]', '', 'g')) >= 0.02 * length(line) AND length(line) <= 80 AS head FROM l)
    SELECT doc_id, count(*) FILTER (head) AS heads, min(n) FILTER (head) AS first_head FROM k GROUP BY doc_id"""
)
def header_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines short and capital enough to be headers."""
    k = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    head = parse.looks_like_header(C("line"), 0.02, 80)
    return k.select("doc_id", (C("n") + 1).alias("n"), head.alias("head")).groupBy("doc_id").agg(F.count_if("head").alias("heads"), F.min(F.when(C("head"), C("n"))).cast("long").alias("first_head"))


@R.add(
    """WITH s AS (SELECT doc_id, [x FOR x IN [trim(y) FOR y IN string_split(replace(text, chr(10), ' '), '. ')] IF length(x) > 20 AND length(regexp_replace(x, '[^A-Z]', '', 'g')) < 0.9 * length(x)] AS k FROM documents)
    SELECT doc_id, md5(array_to_string(k[1:3], '. ')) AS digest, len(k[1:3])::BIGINT AS n FROM s"""
)
def first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three sentences that are no headings."""
    s = F.filter(F.transform(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. "), lambda x: F.trim(x)), lambda x: (F.length(x) > 20) & (F.length(F.regexp_replace(x, "[^A-Z]", "")) < 0.9 * F.length(x)))
    return table(spark, sf_dir, "documents").select("doc_id", F.slice(s, 1, 3).alias("k")).select("doc_id", F.md5(F.array_join("k", ". ")).alias("digest"), F.size("k").cast("long").alias("n"))


@R.add("SELECT doc_id, concat_ws(':', source, lang, doc_id::VARCHAR) AS chunk_key, regexp_replace(lower(source || '/' || lang), '[^a-z0-9]+', '_', 'g') AS safe_key, md5(text) AS digest FROM documents")
def stable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(":", "source", "lang", C("doc_id").cast("string")).alias("chunk_key"), F.regexp_replace(F.lower(F.concat("source", F.lit("/"), "lang")), "[^a-z0-9]+", "_").alias("safe_key"), F.md5("text").alias("digest"))


@R.add("SELECT event_id, ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY AS fresh, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, CASE WHEN month(ts) = 1 THEN 2024 END AS year FROM events")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an entry is within its seven days at a given moment, and its time stamp as text."""
    ts = C("ts")
    return table(spark, sf_dir, "events").select("event_id", (ts >= F.expr("timestamp_ntz'2024-01-31' - interval 7 days")).alias("fresh"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), F.when(F.month(ts) == 1, 2024).alias("year"))


_COVER = [(1, "Bosque de eucalipto"), (2, "Tejido urbano continuo"), (3, "Marisma y zona húmeda"), (4, "Cultivo herbáceo"), (5, "Autopista y terrenos asociados"), (6, None)]
_COVER_AT = Cases(_COVER, ("id", "label"), source="documents", key="doc_id", whole=("label",))


@R.add(
    f"""WITH {_COVER_AT.sql("c")}, f AS (SELECT *, strip_accents(lower(label)) AS s FROM c)
    SELECT id, CASE WHEN regexp_matches(s, 'urban|edific|industr|autop') THEN 'artificial' WHEN regexp_matches(s, 'bosque|forest|matorral') THEN 'forestal' WHEN regexp_matches(s, 'humed|marisma|agua|rio') THEN 'agua' ELSE 'agricola' END AS clase,
    CASE WHEN regexp_matches(s, 'bosque|forest') THEN 'incendio' WHEN regexp_matches(s, 'humed|marisma') THEN 'humedal' WHEN regexp_matches(s, 'autop|carretera') THEN 'infraestructura' END AS alerta FROM f"""
)
def land_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _COVER_AT.frame(spark, sf_dir).select("id", parse.cover_class(C("label")).alias("clase"), parse.cover_alert(C("label")).alias("alerta"))


_BODIES = [(1, "eyJhIjogMSwgInNoYXBlIjogIkEifQ==", "uso=vivienda;altura={a}", 'texto {"ok": true, "n": {a}} fin'), (2, "eyJhIjogMn0=", "altura={b}", "sin json"), (3, "e30=", "", "{}")]
_BODIES_AT = Cases(_BODIES, ("id", "body", "kv", "llm"))


@R.add(
    f"""WITH {_BODIES_AT.sql("b")} SELECT id, json_extract(decode(from_base64(body)), '$.a')::BIGINT AS a, json_extract_string(decode(from_base64(body)), '$.shape') AS shape,
    nullif(regexp_extract(kv, 'altura=([^;]*)', 1), '') AS altura, json_extract(nullif(regexp_extract(llm, '(\\{{.*\\}})', 1), ''), '$.n')::BIGINT AS n FROM b"""
)
def json_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies from base64 JSON, key=value lines and JSON found inside text."""
    b = _BODIES_AT.frame(spark, sf_dir)
    body = F.from_json(F.unbase64("body").cast("string"), "a bigint, shape string")
    found = F.from_json(F.nullif(F.regexp_extract("llm", r"(\{.*\})", 1), F.lit("")), "n bigint")
    return b.select("id", body["a"].alias("a"), body["shape"].alias("shape"), F.try_element_at(F.str_to_map("kv", F.lit(";"), F.lit("=")), F.lit("altura")).alias("altura"), found["n"].alias("n"))


_XML = [
    (1, "<c><u><luso>V</luso><sfc>1{b}.5</sfc><ant>19{b}</ant></u><u><luso>C</luso><sfc>{a}</sfc><ant>{b}</ant></u></c>"),
    (2, "<c><u><luso>V</luso><sfc>{b}</sfc></u></c>"),
]
_XML_AT = Cases(_XML, ("id", "doc"))


@R.add(
    f"""WITH {_XML_AT.sql("x")}, v AS (SELECT id, regexp_extract_all(doc, '<luso>([^<]*)</luso>', 1) AS usos, [try_cast(s AS DOUBLE) FOR s IN regexp_extract_all(doc, '<sfc>([^<]*)</sfc>', 1)] AS m2, [try_cast(s AS BIGINT) FOR s IN regexp_extract_all(doc, '<ant>([^<]*)</ant>', 1)] AS anos FROM x)
    SELECT id, list_sum(m2) AS total, len(usos)::BIGINT AS unidades, list_min([a FOR a IN anos IF a > 1800 AND a < 2100]) AS ano FROM v"""
)
def cadastre_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of a cadastre document: area, count, first year."""
    d = _XML_AT.frame(spark, sf_dir)
    area = F.transform(F.xpath("doc", F.lit("//sfc/text()")), lambda x: x.try_cast("double"))
    years = F.filter(F.transform(F.xpath("doc", F.lit("//ant/text()")), lambda x: x.try_cast("bigint")), lambda y: (y > 1800) & (y < 2100))
    return d.select("id", F.aggregate(area, F.lit(0.0), lambda s, x: s + x).alias("total"), F.size(F.xpath("doc", F.lit("//luso/text()"))).cast("long").alias("unidades"), F.array_min(years).alias("ano"))


_LAYERS = [(1, "36057", "PXOM 2008 (historico)", 1), (2, "36057", "Modificacion puntual 2015", 2), (3, "36057", "PXOM 2025", 3), (4, "15030", "Otra capa 1999", 1), (5, "15030", "Normas subsidiarias 2001", 2)]
_LAYERS_AT = Cases(_LAYERS, ("id", "ine", "name", "ord"), each=("ine",))


@R.add(
    f"""WITH {_LAYERS_AT.sql("l")}, k AS (SELECT *, CASE WHEN regexp_matches(lower(name), 'historic') THEN 3 WHEN regexp_matches(lower(name), 'puntual') THEN 2 WHEN regexp_matches(lower(name), 'pxom|plan xeral') THEN 0 ELSE 1 END AS p FROM l),
    r AS (SELECT *, row_number() OVER (PARTITION BY ine ORDER BY p, ord) AS rn FROM k) SELECT ine, id, name, regexp_extract(name, '([0-9]{{4}})', 1) AS year FROM r WHERE rn = 1 AND p < 2"""
)
def layer_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer in force: general plans first, historical ones and amendments never."""
    n = F.lower("name")
    p = F.when(n.rlike("historic"), 3).when(n.rlike("puntual"), 2).when(n.rlike("pxom|plan xeral"), 0).otherwise(1)
    ranked = lookups.top_k(_LAYERS_AT.frame(spark, sf_dir).withColumn("p", p).where("p < 2"), ["ine"], 1, C("p"), C("ord"))
    return ranked.select("ine", "id", "name", F.regexp_extract("name", "([0-9]{4})", 1).alias("year"))


_ODT = [(1, "MUNICIPIO Vigo"), (2, "Subzona U1"), (3, "altura {a}"), (4, "ocupacion {b}"), (5, "Subzona U2"), (6, "altura {c}"), (7, "MUNICIPIO Lugo"), (8, "altura {a}"), (9, "Subzona R1"), (10, "altura {b}")]
_ODT_AT = Cases(_ODT, ("n", "line"))


@R.add(
    f"""WITH {_ODT_AT.sql("l")}, w AS (SELECT *, n // 10 AS doc FROM l), m AS (SELECT *, last_value(nullif(regexp_extract(line, '^MUNICIPIO (.*)$', 1), '') IGNORE NULLS) OVER (PARTITION BY doc ORDER BY n) AS muni, max(CASE WHEN starts_with(line, 'MUNICIPIO') THEN n END) OVER (PARTITION BY doc ORDER BY n) AS blk FROM w),
    s AS (SELECT *, last_value(nullif(regexp_extract(line, '^Subzona (.*)$', 1), '') IGNORE NULLS) OVER (PARTITION BY doc, blk ORDER BY n) AS sub FROM m)
    SELECT doc, muni, coalesce(sub, '') AS sub, max(try_cast(regexp_extract(line, '^altura ([0-9.]+)$', 1) AS DOUBLE)) AS altura, max(try_cast(regexp_extract(line, '^ocupacion ([0-9.]+)$', 1) AS DOUBLE)) AS ocupacion FROM s WHERE regexp_matches(line, '^(altura|ocupacion)') GROUP BY doc, muni, sub"""
)
def lines_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of many documents to rule rows: municipality and subzone carried down, values gathered."""
    lines = _ODT_AT.frame(spark, sf_dir).withColumn("doc", F.expr("n div 10"))
    return parse.rule_rows(lines, "doc", "n", "line")


@R.add(
    """WITH c AS (SELECT doc_id, source, unnest(range(0, greatest(1, length(text)), 1680)) AS s, text FROM documents), k AS (SELECT source, doc_id, len(regexp_extract_all(strip_accents(lower(substring(text, s::INT + 1, 1800))), '[a-z0-9]{3,}')) AS n FROM c)
    SELECT source, count(DISTINCT doc_id) AS documents, count(*) AS chunks, sum(n)::BIGINT AS tokens FROM k GROUP BY source"""
)
def corpus_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index build in numbers: documents, chunks and tokens of each source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.length("text")) - 1, F.lit(1680))).alias("s"))
    n = F.size(F.regexp_extract_all(t.fold(F.substring(C("text"), C("s") + 1, F.lit(1800))), F.lit("([a-z0-9]{3,})"), F.lit(1)))
    return d.select("source", "doc_id", n.alias("n")).groupBy("source").agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("tokens"))


@R.add()
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword ranking of the expanded question, deduplicated by content, fused with a second ranking."""
    d = table(spark, sf_dir, "documents")
    q = relation(spark, [(1, "thonha reesh onha")], ("qid", "question")).select("qid", t.expanded(C("question")).alias("question"))
    words = retrieval.bm25(d, q, "doc_id", "text", "qid", "question")
    hits = words.join(d.select("doc_id", "n_chars", "text"), "doc_id").drop("qid")
    once = retrieval.best_of_content(hits.select("doc_id", "text", "score"), "text", F.round("score", 9), "doc_id").select("doc_id", "score")
    a = once.orderBy(F.desc("score"), "doc_id").limit(50).select("doc_id", F.row_number().over(W.orderBy(F.desc("score"), "doc_id")).alias("rank"))
    b = hits.select("doc_id", "n_chars").orderBy("n_chars", "doc_id").limit(50).select("doc_id", F.row_number().over(W.orderBy("n_chars", "doc_id")).alias("rank"))
    fused = retrieval.reciprocal_ranks([a, b], "doc_id").orderBy(F.desc("score"), "doc_id").limit(10)
    return fused.select("doc_id", F.round("score", 6).alias("score"))


@R.add(
    """WITH r AS (SELECT 'p_name' AS c, count(*) - count(nullif(p_name, '')) AS m FROM part UNION ALL SELECT 'p_size', count(*) FILTER (p_size < 5) FROM part UNION ALL SELECT 'p_type', count(*) FILTER (p_type LIKE 'S%') FROM part)
    SELECT string_agg('| ' || c || ' | ' || m || ' |', chr(10) ORDER BY m DESC, c) AS report FROM r"""
)
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coverage table as Markdown: most missing first, then by name."""
    p = table(spark, sf_dir, "part").agg(F.count_if(C("p_name").isNull() | (C("p_name") == "")).alias("p_name"), F.count_if(C("p_size") < 5).alias("p_size"), F.count_if(F.startswith("p_type", F.lit("S"))).alias("p_type"))
    rows = F.array_sort(F.array(*(F.struct((-C(c)).alias("m"), F.lit(c).alias("c")) for c in ("p_name", "p_size", "p_type"))))
    return p.select(F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), r["c"], F.lit(" | "), (-r["m"]).cast("string"), F.lit(" |"))), "\n").alias("report"))


@R.add(
    """WITH x AS (SELECT o_orderkey, ['urbano', 'nucleo', 'rustico', 'urbanizable'][(o_orderkey % 4)::INT + 1] AS clase, o_orderkey % 3 = 0 AS protegido, 100.0 + o_orderkey % 300 AS parcela, 0.4 AS limite, 20.0 + o_orderkey % 60 AS ocupado, 10.0 + o_orderkey % 40 AS piscina FROM orders)
    SELECT o_orderkey, CASE WHEN clase = 'rustico' AND protegido THEN 'no_apto' WHEN clase IN ('rustico', 'urbanizable') THEN 'condicionado' ELSE 'apto' END AS verdict, round(parcela * limite - ocupado - piscina * 0.5, 2)::DOUBLE AS margen, round((ocupado + piscina * 0.5) / parcela * 100, 2)::DOUBLE AS pct FROM x"""
)
def zoning_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land-class verdict and the room left for a pool."""
    from zonarium.functions.rules import land_verdict, pool_margin

    k = C("o_orderkey")
    cls = F.element_at(F.array(*map(F.lit, ("urbano", "nucleo", "rustico", "urbanizable"))), (k % 4 + 1).cast("int"))
    parcel, used, pool = 100.0 + k % 300, 20.0 + k % 60, 10.0 + k % 40
    return table(spark, sf_dir, "orders").select("o_orderkey", land_verdict(cls, k % 3 == 0).alias("verdict"), F.round(pool_margin(parcel, F.lit(0.4), used, pool, F.lit(0.5)), 2).alias("margen"), F.round((used + pool * 0.5) / parcel * 100, 2).alias("pct"))


@R.add(
    """WITH px AS (SELECT l_suppkey AS b, l_extendedprice / 1000 AS z, l_returnflag = 'N' AS ground FROM lineitem),
    a AS (SELECT b, count(*) AS n, quantile_cont(z, 0.9) AS top, count(*) FILTER (ground) AS g, quantile_cont(z, 0.5) FILTER (ground) AS base FROM px GROUP BY b)
    SELECT b, n, CASE WHEN n >= 10 AND g >= 5 AND top - base BETWEEN 0 AND 60 THEN round(top - base, 4) END AS altura FROM a"""
)
def point_cloud_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ninetieth percentile of all points less the median of the ground, if there are enough of both."""
    from zonarium.operators.spatial import cloud_height

    px = table(spark, sf_dir, "lineitem").select(C("l_suppkey").alias("b"), (C("l_extendedprice") / 1000).alias("z"), (C("l_returnflag") == "N").alias("ground"))
    return cloud_height(px, "b", "z", "ground")
