"""Queries over rules, zones and the relational tables: look-ups, grades, geometry, sun, quality, exports."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonarium.functions import geometry as g
from zonarium.functions import rules, sun
from zonarium.functions import text as t
from zonarium.operators import lookups, quality, spatial
from zonarium.plans.cases import Cases
from zonarium.plans.registry import Registry, table
from zonarium.sources import literals as L
from zonarium.sources.literals import relation, values_sql

R = Registry()
C = F.col

_PLANS = values_sql("plans", L.PLANS, L.PLAN_COLUMNS)
_ZONES = values_sql("zones", L.ZONES, L.ZONE_COLUMNS)
_WIDTHS = values_sql("widths", L.WIDTHS, L.WIDTH_COLUMNS)
_MUNI = "CASE c_nationkey % 4 WHEN 0 THEN 'Vigo' WHEN 1 THEN ' A Coruña' WHEN 2 THEN 'LUGO' ELSE 'Ourense' END"
_SUB = "CASE c_custkey % 5 WHEN 0 THEN 'Centro' WHEN 1 THEN 'U1.2' WHEN 2 THEN '' WHEN 3 THEN 'Ensanche' ELSE 'otro' END"
_KEYS = f"""k AS (SELECT c_custkey, regexp_replace(trim(strip_accents(lower({_MUNI}))), '\\s+', ' ', 'g') AS municipio, regexp_replace(strip_accents(lower(trim({_SUB}))), '[\\s-]', '', 'g') AS subzona, c_acctbal FROM customer)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as requests for a municipality and a subzone."""
    n = C("c_nationkey") % 4
    s = C("c_custkey") % 5
    muni = F.when(n == 0, "Vigo").when(n == 1, " A Coruña").when(n == 2, "LUGO").otherwise("Ourense")
    sub = F.when(s == 0, "Centro").when(s == 1, "U1.2").when(s == 2, "").when(s == 3, "Ensanche").otherwise("otro")
    return table(spark, sf_dir, "customer").select("c_custkey", t.municipality_key(muni).alias("municipio"), t.subzone_key(sub).alias("subzona"), "c_acctbal")


def _plans(spark: SparkSession) -> DataFrame:
    return relation(spark, L.PLANS, L.PLAN_COLUMNS)


_LOOKUP = f"""{_PLANS}, {_KEYS},
    m AS (SELECT k.*, p.subzona AS rule_subzona, p.altura_maxima_m, p.retranqueo_min_m, p.ocupacion_max, p.edificabilidad,
                 row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN p.subzona = k.subzona THEN 0 WHEN p.subzona = '' THEN 1 ELSE 2 END, p.ord) AS rn
          FROM k LEFT JOIN plans p ON p.municipio = k.municipio AND (p.subzona = k.subzona OR p.subzona = '' OR k.subzona = ''))"""


@R.add(f"WITH {_LOOKUP} SELECT c_custkey, municipio, subzona, rule_subzona, altura_maxima_m, retranqueo_min_m FROM m WHERE rn = 1")
def plan_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact subzone, else the municipality's default, else (no subzone asked) its first rule."""
    out = lookups.precedence_lookup(_requests(spark, sf_dir), _plans(spark), "municipio", "subzona", "ord")
    return out.select("c_custkey", "municipio", "subzona", C("rule.subzona").alias("rule_subzona"), "rule.altura_maxima_m", "rule.retranqueo_min_m")


_DIRTY_AT = Cases(L.PLANS_DIRTY, L.DIRTY_COLUMNS, source="part", key="p_partkey", vary={"altura": 0.5, "ocupacion": 0.1}, each=("subzona",))
_DIRTY = _DIRTY_AT.sql("d")


@R.add(
    f"""WITH {_DIRTY}, e AS (SELECT "row", [x for x in [
        CASE WHEN municipio IS NULL OR trim(municipio) = '' THEN 'municipio' END, CASE WHEN altura <= 0 THEN 'altura' END, CASE WHEN retranqueo < 0 THEN 'retranqueo' END,
        CASE WHEN ocupacion < 0 OR ocupacion > 1 THEN 'ocupacion' END, CASE WHEN front_direction IS NOT NULL AND lower(front_direction) NOT IN ('north', 'south', 'east', 'west') THEN 'direccion' END,
        CASE WHEN front_direction IS NOT NULL AND setback_front IS NULL AND setback_side IS NULL THEN 'direccion_sin_retranqueo' END] if x IS NOT NULL] AS errors,
        row_number() OVER (PARTITION BY lower(trim(municipio)), lower(trim(subzona)) ORDER BY "row") > 1 AS duplicate FROM d)
    SELECT "row", array_to_string(errors, ',') AS errors, duplicate FROM e"""
)
def plan_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _DIRTY_AT.frame(spark, sf_dir)
    errors = quality.plan_errors(C("municipio"), C("altura"), C("retranqueo"), C("ocupacion"), C("front_direction"), [C("setback_front"), C("setback_side")])
    marked = quality.duplicated(d.withColumn("errors", errors), [F.lower(F.trim("municipio")), F.lower(F.trim("subzona"))], "row")
    return marked.select("row", F.array_join("errors", ",").alias("errors"), "duplicate")


@R.add(
    """WITH c AS (SELECT count(*) AS n, count(nullif(trim(p_name), '')) AS a, count(nullif(trim(p_brand), '')) AS b, count(nullif(trim(p_type), '')) AS c, count(p_size) AS d FROM part)
    SELECT unnest(['p_name', 'p_brand', 'p_type', 'p_size']) AS "column", unnest([a, b, c, d]) AS present, unnest([n - a, n - b, n - c, n - d]) AS missing FROM c"""
)
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.coverage(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type", "p_size"])


@R.add(
    """WITH s AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS o FROM part GROUP BY ALL),
    m AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, o) AS rn FROM s)
    SELECT p.p_brand, max(p_size) AS p_size, max(p_retailprice) AS p_retailprice, any_value(m.p_type) AS p_type, min_by(p_name, p_partkey) AS p_name
    FROM part p JOIN m ON m.p_brand = p.p_brand AND rn = 1 GROUP BY p.p_brand"""
)
def consolidate_max_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.consolidated(table(spark, sf_dir, "part"), ["p_brand"], ["p_size", "p_retailprice"], "p_type", "p_name", "p_partkey")


_CODES = [("BRAND1",), ("BRAND12",), ("BRAND2",), ("BRAND45X",), ("BRAND34",)]


@R.add(
    f"""WITH {values_sql("codes", _CODES, ("code",))}, k AS (SELECT DISTINCT regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') AS brand FROM part),
    p AS (SELECT brand, max_by(code, length(code)) AS parent FROM k JOIN codes ON starts_with(brand, code) GROUP BY brand),
    c AS (SELECT brand, min(code) AS child, count(*) AS n FROM k JOIN codes ON starts_with(code, brand) GROUP BY brand)
    SELECT brand, coalesce(parent, CASE WHEN n = 1 THEN child END) AS code FROM k LEFT JOIN p USING (brand) LEFT JOIN c USING (brand)"""
)
def prefix_code_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(t.code_key(C("p_brand")).alias("brand")).distinct()
    return lookups.longest_prefix(brands, relation(spark, _CODES, ("code",)), "brand", "code")


@R.add(
    f"""WITH {_WIDTHS} SELECT l_orderkey, l_linenumber, l_quantity AS ancho, plantas, round(coalesce(altura_m, CASE formula WHEN '*' THEN l_quantity * op_m ELSE l_quantity + op_m END), 4) AS altura
    FROM lineitem JOIN widths ON (ancho_min_m IS NULL OR l_quantity >= ancho_min_m) AND (ancho_max_m IS NULL OR l_quantity < ancho_max_m)"""
)
def range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as street widths against the width table, formulas evaluated."""
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C("l_quantity").alias("ancho"))
    j = lookups.range_join(i, relation(spark, L.WIDTHS, L.WIDTH_COLUMNS), "ancho", "ancho_min_m", "ancho_max_m", 6.0)
    height = F.coalesce("altura_m", F.when(C("formula") == "*", C("ancho") * C("op_m")).otherwise(C("ancho") + C("op_m")))
    return j.select("l_orderkey", "l_linenumber", "ancho", "plantas", F.round(height, 4).alias("altura"))


_POINTS = "pts AS (SELECT c_custkey, (c_custkey * 37 % 1000)::DOUBLE / 10 AS x, (c_custkey * 91 % 1000)::DOUBLE / 10 AS y, c_acctbal FROM customer)"
_PIP = f"""{_ZONES}, {_POINTS}, hits AS (SELECT c_custkey, x, y, code, limite, estado, (xmax - xmin) * (ymax - ymin) AS area FROM pts JOIN zones ON x >= xmin AND x < xmax AND y >= ymin AND y < ymax)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", ((k * 37 % 1000).cast("double") / 10).alias("x"), ((k * 91 % 1000).cast("double") / 10).alias("y"), "c_acctbal")


def _zones(spark: SparkSession) -> DataFrame:
    z = relation(spark, L.ZONES, L.ZONE_COLUMNS)
    return z.withColumn("ring", g.rectangle(C("xmin"), C("xmax"), C("ymin"), C("ymax"))).withColumn("area", g.area(C("ring")))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.cell_join(_points(spark, sf_dir), _zones(spark), 20.0)


@R.add(f"WITH {_PIP} SELECT c_custkey, list_sort(list(DISTINCT code)) AS codes, count(DISTINCT code) > 1 AS ambiguous FROM hits GROUP BY c_custkey")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).groupBy("c_custkey").agg(F.array_sort(F.collect_set("code")).alias("codes")).withColumn("ambiguous", F.size("codes") > 1)


@R.add(f"WITH {_PIP} SELECT c_custkey, first(code ORDER BY area, code) AS code, min(area) AS area FROM hits GROUP BY c_custkey")
def smallest_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).groupBy("c_custkey").agg(F.min_by("code", F.struct("area", "code")).alias("code"), F.min("area").alias("area"))


@R.add(
    """WITH z AS (SELECT s_suppkey, (s_suppkey * 53 % 1000)::DOUBLE / 10 AS ox, (s_suppkey * 29 % 1000)::DOUBLE / 10 AS oy FROM supplier),
    p AS (SELECT c_custkey, (c_custkey * 37 % 1000)::DOUBLE / 10 AS x, (c_custkey * 91 % 1000)::DOUBLE / 10 AS y FROM customer),
    d AS (SELECT c_custkey, s_suppkey, sqrt(pow(x - ox, 2) + pow(y - oy, 2)) AS d FROM p JOIN z ON sqrt(pow(x - ox, 2) + pow(y - oy, 2)) <= 8),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(d, 9), s_suppkey) AS rank FROM d)
    SELECT c_custkey, s_suppkey, round(d, 4) AS distance, rank FROM r WHERE rank <= 3"""
)
def nearest_within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("s_suppkey")
    z = table(spark, sf_dir, "supplier").select("s_suppkey", ((k * 53 % 1000).cast("double") / 10).alias("ox"), ((k * 29 % 1000).cast("double") / 10).alias("oy"))
    near = spatial.nearest_within(_points(spark, sf_dir), z, "s_suppkey", 8.0, 3)
    return lookups.top_k(near, ["c_custkey"], 3, F.round("distance", 9), C("s_suppkey")).select("c_custkey", "s_suppkey", F.round("distance", 4).alias("distance"), "rank")


@R.add("SELECT l_suppkey AS zone, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(quantile_cont(l_extendedprice, 0.9), 4) END AS p90 FROM lineitem WHERE l_quantity <= 40 GROUP BY l_suppkey")
def zonal_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = table(spark, sf_dir, "lineitem").where("l_quantity <= 40").select(C("l_suppkey").alias("zone"), "l_extendedprice")
    return spatial.zonal_percentile(px, "zone", "l_extendedprice", 0.9, 5).select("zone", "n", F.round("p", 4).alias("p90"))


_TAGS = "tags AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_size || ' m' WHEN p_size % 5 = 1 THEN 'x' END AS height, CASE WHEN p_size % 3 = 0 THEN (p_size // 3)::VARCHAR END AS levels, CASE p_size % 4 WHEN 0 THEN 'Apartments' WHEN 1 THEN 'retail' WHEN 2 THEN 'warehouse' END AS kind FROM part)"
_HEIGHT = f"""{_TAGS}, n AS (SELECT *, try_cast(trim(replace(lower(height), 'm', '')) AS DOUBLE) AS h, try_cast(levels AS DOUBLE) AS l FROM tags),
    hs AS (SELECT p_partkey, round(CASE WHEN h IS NOT NULL THEN greatest(2.5, h) WHEN l IS NOT NULL THEN greatest(3.0, l * 3.2) WHEN lower(kind) = 'apartments' THEN 18 WHEN kind = 'retail' THEN 12 WHEN kind = 'warehouse' THEN 8 ELSE 9 END, 4)::DOUBLE AS height,
        CASE WHEN h IS NOT NULL THEN 'osm_height' WHEN l IS NOT NULL THEN 'osm_levels' WHEN kind IS NOT NULL THEN 'building_type' ELSE 'default' END AS source, h IS NULL AS estimated FROM n)"""


def _heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C("p_size")
    tagged = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(s % 5 == 0, F.concat(s.cast("string"), F.lit(" m"))).when(s % 5 == 1, "x").alias("height"),
        F.when(s % 3 == 0, F.floor(s / 3).cast("string")).alias("levels"),
        F.when(s % 4 == 0, "Apartments").when(s % 4 == 1, "retail").when(s % 4 == 2, "warehouse").alias("kind"),
    )
    h = rules.height_from_tags(C("height"), C("levels"), C("kind"))
    return tagged.select("p_partkey", h.alias("h")).select("p_partkey", F.round("h.height", 4).alias("height"), "h.source", "h.estimated")


@R.add(f"WITH {_HEIGHT} SELECT * FROM hs")
def height_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heights(spark, sf_dir)


_GRADE = """CASE WHEN limite IS NULL AND regimen = 'alzados_ordenacion' THEN 'altura_alzados' WHEN limite IS NULL AND tabla IS NOT NULL THEN 'altura_tabla' WHEN limite IS NULL AND subzona IS NOT NULL THEN 'sin_limite'
    WHEN limite IS NULL THEN 'sin_dato' WHEN height <= limite AND estado = 'pilot' THEN 'orientativo_dentro' WHEN height <= limite THEN 'compatible' WHEN estado = 'pilot' THEN 'orientativo_supera'
    WHEN tope > limite AND height <= tope THEN 'supera_cornisa' ELSE 'supera_altura' END"""


@R.add(
    f"""WITH {_HEIGHT}, x AS (SELECT p_partkey, height, CASE WHEN p_partkey % 9 < 5 THEN 10.0 + p_partkey % 7 END AS limite, CASE WHEN p_partkey % 4 = 0 THEN 'pilot' ELSE 'official' END AS estado, CASE WHEN p_partkey % 5 = 1 THEN 20.0 END AS tope,
        CASE WHEN p_partkey % 9 = 5 THEN 'alzados_ordenacion' END AS regimen, CASE WHEN p_partkey % 9 = 6 THEN 'tabla' END AS tabla, CASE WHEN p_partkey % 9 = 7 THEN 'U1' END AS subzona FROM hs)
    SELECT p_partkey, {_GRADE} AS status, round(CASE WHEN height > limite THEN height - limite END, 2)::DOUBLE AS exceso, CASE WHEN height - limite > 1.5 THEN 'considerable' WHEN height - limite > 0 THEN 'marginal' END AS causa FROM x"""
)
def compliance_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("p_partkey")
    x = _heights(spark, sf_dir).select(
        "p_partkey", "height", F.when(k % 9 < 5, 10.0 + k % 7).alias("limite"), F.when(k % 4 == 0, "pilot").otherwise("official").alias("estado"), F.when(k % 5 == 1, 20.0).alias("tope"),
        F.when(k % 9 == 5, "alzados_ordenacion").alias("regimen"), F.when(k % 9 == 6, "tabla").alias("tabla"), F.when(k % 9 == 7, "U1").alias("subzona"),
    )
    status = rules.grade(C("height"), C("limite"), C("estado"), C("tope"), C("regimen"), C("tabla"), C("subzona"))
    over = C("height") - C("limite")
    return x.select("p_partkey", status.alias("status"), F.round(F.when(over > 0, over), 2).alias("exceso"), rules.excess_cause(over).alias("causa"))


@R.add(
    f"""WITH {_PIP}, z AS (SELECT c_custkey, first(code ORDER BY area, code) AS code, first(limite ORDER BY area, code) AS limite, first(estado ORDER BY area, code) AS estado, count(DISTINCT code) AS n FROM hits GROUP BY c_custkey),
    b AS (SELECT p.c_custkey, p.x, round(3 + (p.c_custkey * 13 % 300)::DOUBLE / 10, 1) AS height, code, limite, estado, coalesce(n, 0) AS n, c_nationkey FROM pts p JOIN customer USING (c_custkey) LEFT JOIN z USING (c_custkey)),
    s AS (SELECT b.*, n_name, NULL AS tope, NULL AS regimen, NULL AS tabla, NULL AS subzona FROM b JOIN nation ON n_nationkey = c_nationkey)
    SELECT n_name, coalesce(code, 'none') AS code, {_GRADE} AS status, count(*) AS n, round(avg(height), 4) AS mean_height, round(quantile_cont(height, 0.9), 4) AS p90 FROM s GROUP BY ALL"""
)
def flagship_graded_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings joined to the smallest zone around them, graded, and summed up by nation and zone."""
    z = _hits(spark, sf_dir).groupBy("c_custkey").agg(F.min_by(F.struct("code", "limite", "estado"), F.struct("area", "code")).alias("z"))
    p = _points(spark, sf_dir).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    b = p.join(z, "c_custkey", "left").select("c_nationkey", F.round(3 + (C("c_custkey") * 13 % 300).cast("double") / 10, 1).alias("height"), "z.*")
    nation = table(spark, sf_dir, "nation").select(C("n_nationkey").alias("c_nationkey"), "n_name")
    graded = b.join(lookups.small(nation), "c_nationkey").withColumn("status", rules.grade(C("height"), C("limite"), C("estado")))
    return graded.groupBy("n_name", F.coalesce("code", F.lit("none")).alias("code"), "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("height"), 4).alias("mean_height"), F.round(F.percentile("height", 0.9), 4).alias("p90"))


@R.add(
    f"""WITH {_LOOKUP}, x AS (SELECT c_custkey, 100.0 + c_custkey % 400 AS parcel, 60.0 + c_custkey % 300 AS built, ocupacion_max AS o, edificabilidad AS e, coalesce(retranqueo_min_m, 0) AS s, c_custkey % 7 = 0 AS d FROM m WHERE rn = 1)
    SELECT c_custkey, CASE WHEN parcel * o < built * 0.99 THEN 'ocupacion' WHEN parcel * e < built * 0.99 THEN 'edificabilidad' WHEN (d OR s > 0) AND built <= parcel * 0.99 THEN 'retranqueos' ELSE 'altura' END AS factor FROM x"""
)
def limiting_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lookups.precedence_lookup(_requests(spark, sf_dir), _plans(spark), "municipio", "subzona", "ord")
    k = C("c_custkey")
    return out.select("c_custkey", rules.limiting_factor(100.0 + k % 400, 60.0 + k % 300, C("rule.ocupacion_max"), C("rule.edificabilidad"), F.coalesce(C("rule.retranqueo_min_m"), F.lit(0.0)), k % 7 == 0).alias("factor"))


_BOX = "SELECT o_orderkey, 10.0 + o_orderkey % 30 AS w, 8.0 + o_orderkey % 20 AS h, (o_orderkey % 6)::DOUBLE AS front, (o_orderkey % 4)::DOUBLE AS side, (o_orderkey % 9)::DOUBLE AS back, ['north', 'south', 'east', 'west'][(o_orderkey % 4)::INT + 1] AS d FROM orders"


@R.add(
    f"""WITH b AS ({_BOX}), e AS (SELECT *, CASE d WHEN 'south' THEN front WHEN 'north' THEN back ELSE side END AS s, CASE d WHEN 'north' THEN front WHEN 'south' THEN back ELSE side END AS n,
        CASE d WHEN 'west' THEN front WHEN 'east' THEN back ELSE side END AS we, CASE d WHEN 'east' THEN front WHEN 'west' THEN back ELSE side END AS ea FROM b),
    a AS (SELECT o_orderkey, CASE WHEN we < w - ea AND s < h - n THEN (w - ea - we) * (h - n - s) END AS area, [x for x in [CASE WHEN side = 0 THEN 'sin_retranqueo_lateral' END, CASE WHEN d = 'north' THEN 'frente_por_defecto' END] if x IS NOT NULL] AS reasons FROM e)
    SELECT o_orderkey, round(area, 4) AS area, array_to_string(reasons, ',') AS reasons, CASE WHEN area IS NULL OR area <= 0 THEN 'no_apto' WHEN len(reasons) > 0 THEN 'condicionado' ELSE 'apto' END AS viability FROM a"""
)
def viability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as parcels: a rectangle drawn in by its setbacks, and the verdict."""
    k = C("o_orderkey")
    direction = F.element_at(F.array(*map(F.lit, ("north", "south", "east", "west"))), (k % 4 + 1).cast("int"))
    b = table(spark, sf_dir, "orders").select("o_orderkey", (10.0 + k % 30).alias("w"), (8.0 + k % 20).alias("h"), (k % 6).cast("double").alias("front"), (k % 4).cast("double").alias("side"), (k % 9).cast("double").alias("back"), direction.alias("d"))
    box = g.inset_rectangle(F.lit(0.0), C("w"), F.lit(0.0), C("h"), C("front"), C("side"), C("back"), C("d"))
    reasons = F.array_compact(F.array(F.when(C("side") == 0, "sin_retranqueo_lateral"), F.when(C("d") == "north", "frente_por_defecto")))
    a = b.select("o_orderkey", box.alias("box"), reasons.alias("reasons")).withColumn("area", (C("box.xmax") - C("box.xmin")) * (C("box.ymax") - C("box.ymin")))
    return a.select("o_orderkey", F.round("area", 4).alias("area"), F.array_join("reasons", ",").alias("reasons"), rules.viability(C("area"), C("reasons")).alias("viability"))


@R.add(
    """WITH x AS (SELECT o_orderkey, 5.0 + o_orderkey % 20 AS alt, CASE WHEN o_orderkey % 3 > 0 THEN 12.0 END AS lim, CASE WHEN o_orderkey % 5 = 0 THEN 16.0 END AS cap, 100.0 + o_orderkey % 300 AS parcel, 250.0 AS small, o_totalprice / 100 AS built, 1.5 AS ratio, o_orderkey % 4 AS uses, o_orderpriority = '1-URGENT' AS single FROM orders),
    e AS (SELECT o_orderkey, [w for w in [CASE WHEN alt > coalesce(CASE WHEN lim IS NOT NULL THEN cap END, lim) * 1.1 THEN 'altura' END, CASE WHEN parcel > 0 AND parcel < small THEN 'parcela_minima' END,
        CASE WHEN parcel > 0 AND built / parcel > ratio * 1.15 THEN 'edificabilidad' END, CASE WHEN single AND uses > 2 THEN 'usos' END] if w IS NOT NULL] AS warnings FROM x)
    SELECT o_orderkey, array_to_string(warnings, ',') AS warnings FROM e"""
)
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("o_orderkey")
    w = rules.contradictions(5.0 + k % 20, F.when(k % 3 > 0, 12.0), F.when(k % 5 == 0, 16.0), 100.0 + k % 300, F.lit(250.0), C("o_totalprice") / 100, F.lit(1.5), k % 4, C("o_orderpriority") == "1-URGENT")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(w, ",").alias("warnings"))


_COST_ROWS = [
    (1, 100.0, 400.0, 5000.0, 300.0, 120000.0, 900.0), (2, 50.0, 800.0, 4500.0, 800.0, 120000.0, 600.0), (3, None, 400.0, 5000.0, None, 9000.0, None), (4, 80.0, None, None, None, 1.0, 10.0), (5, 0.0, 10.0, None, 100.0, None, 0.0),
]
_COST_COLUMNS = ("id", "area", "per_m2", "fixed", "fees", "sale", "rent")
_COST_AT = Cases(_COST_ROWS, _COST_COLUMNS, vary={"area": 12.5, "fees": 100.0})


@R.add(
    f"""WITH {_COST_AT.sql("c")}, w AS (SELECT *, round(area * per_m2, 2) AS obra FROM c),
    t AS (SELECT *, CASE WHEN obra IS NULL AND fixed IS NULL AND fees IS NULL THEN NULL ELSE round(coalesce(obra, 0) + coalesce(fixed, 0) + coalesce(fees, 0), 2) END AS inversion FROM w)
    SELECT id, obra, inversion, CASE WHEN area > 0 THEN round(inversion / area, 2) END AS por_m2, round(sale - inversion, 2) AS beneficio, CASE WHEN inversion > 0 THEN round((sale - inversion) / inversion * 100, 2) END AS roi_pct,
      CASE WHEN rent > 0 THEN round(inversion / rent, 1) END AS payback_meses, CASE WHEN rent > 0 AND inversion > 0 THEN round(rent * 12 / inversion * 100, 2) END AS rentabilidad_pct FROM t"""
)
def conversion_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _COST_AT.frame(spark, sf_dir)
    return c.select("id", *(v.alias(k) for k, v in rules.conversion_costs(C("area"), C("per_m2"), C("fixed"), C("fees"), C("sale"), C("rent")).items()))


_ROOM = ", ".join(f"({k}, {v}::DOUBLE)" for k, v in L.ROOM_MINIMUM.items())
_OTHER = ", ".join(f"({k}, {i + 1}, {v}::DOUBLE)" for k, vs in L.OTHER_MINIMUM.items() for i, v in enumerate(vs))


@R.add(
    f"""WITH e1(b, need) AS (VALUES {_ROOM}), eo(b, i, need) AS (VALUES {_OTHER}),
    r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity % 11 = 0 THEN NULL ELSE l_quantity END AS area, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(area, 0) DESC, l_linenumber, pos) AS i FROM r WHERE pos > 1),
    c AS (SELECT r.l_orderkey, area, need FROM r JOIN e1 ON b = least(greatest(n, 1), 6) WHERE pos = 1 UNION ALL SELECT o.l_orderkey, area, need FROM o JOIN eo ON b = least(greatest(n, 1), 6) AND eo.i = o.i),
    s AS (SELECT l_orderkey, count(*) AS checks, count(*) FILTER (area < need) AS fails, count(*) FILTER (area IS NULL) AS unknowns FROM c GROUP BY l_orderkey)
    SELECT l_orderkey, checks, fails, unknowns, CASE WHEN fails > 0 THEN 'no_cumple' WHEN unknowns > 0 THEN 'no_verificable' ELSE 'cumple' END AS estado FROM s"""
)
def habitability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dwellings, lines as rooms: the largest is the main room, the others follow by area."""
    from pyspark.sql import Window as W

    i = table(spark, sf_dir, "lineitem")
    by = W.partitionBy("l_orderkey")
    area = F.when(C("l_quantity") % 11 != 0, C("l_quantity"))
    # all rooms in the order of the others, which is the only sort; the main one is found by its key, and those behind it move up
    order = F.row_number().over(by.orderBy(F.desc(F.coalesce(area, F.lit(0.0))), "l_linenumber", F.desc("l_quantity"), "l_partkey"))
    r = i.select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", area.alias("area"), order.alias("j"))
    main_key = F.max(F.struct("l_quantity", -C("l_linenumber"), -C("l_partkey"), (-C("j")).alias("j"))).over(by)
    r = r.select("l_orderkey", "area", "j", (-main_key["j"]).alias("main"), F.count(F.lit(1)).over(by).alias("n"))
    r = r.withColumn("b", F.least(F.greatest("n", F.lit(1)), F.lit(6)).cast("int"))
    main = F.element_at(F.create_map(*(x for k, v in L.ROOM_MINIMUM.items() for x in (F.lit(k), F.lit(v)))), C("b"))
    others = F.create_map(*(x for k, v in L.OTHER_MINIMUM.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    need = F.when(C("j") == C("main"), main).otherwise(F.get(F.element_at(others, C("b")), C("j") - (C("j") > C("main")).cast("int") - 1))
    checked = r.withColumn("need", need).where(C("need").isNotNull()).withColumn("state", rules.check(C("area"), C("need")))
    s = checked.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("checks"), F.count_if(C("state") == "no_cumple").alias("fails"), F.count_if(C("state") == "no_verificable").alias("unknowns"))
    return s.withColumn("estado", rules.overall(C("fails"), C("unknowns")))


_SUN = """d AS (SELECT *, 2 * pi() / 365.0::DOUBLE * (doy - 1 + (hour - 12) / 24.0::DOUBLE) AS ga FROM p),
    e AS (SELECT *, 0.006918 - 0.399912 * cos(ga) + 0.070257 * sin(ga) - 0.006758 * cos(2 * ga) + 0.000907 * sin(2 * ga) - 0.002697 * cos(3 * ga) + 0.001480 * sin(3 * ga) AS de,
        229.18::DOUBLE * (0.000075 + 0.001868 * cos(ga) - 0.032077 * sin(ga) - 0.014615 * cos(2 * ga) - 0.040849 * sin(2 * ga)) AS eq FROM d),
    f AS (SELECT *, (hour * 60 + eq + 4.0 * lon) / 4.0 - 180.0 AS an FROM e),
    h AS (SELECT *, degrees(asin(greatest(-1.0, least(1.0, sin(radians(lat)) * sin(de) + cos(radians(lat)) * cos(de) * cos(radians(an)))))) AS el FROM f),
    a AS (SELECT *, degrees(acos(greatest(-1.0, least(1.0, (sin(de) * cos(radians(lat)) - cos(de) * sin(radians(lat)) * cos(radians(an))) / greatest(cos(radians(el)), 1e-10))))) AS az0 FROM h),
    sun AS (SELECT *, round(el, 2) AS elevation, round(CASE WHEN an > 0 THEN 360.0 - az0 ELSE az0 END, 2) AS azimuth FROM a)"""


@R.add(
    f"""WITH {values_sql("dates", L.SOLAR_DATES, ("name", "doy"))}, {values_sql("sides", L.ORIENTATIONS, ("side", "facade", "ord"))},
    p AS (SELECT n_nationkey, name, doy, hour::DOUBLE AS hour, 42.0::DOUBLE + n_nationkey / 10.0::DOUBLE AS lat, -8.0::DOUBLE + n_nationkey / 7.0::DOUBLE AS lon FROM nation CROSS JOIN dates CROSS JOIN range(4, 22) r(hour)), {_SUN},
    l AS (SELECT n_nationkey, side, ord, count(*) FILTER (elevation > 0.5 AND least(abs(azimuth - facade) % 360, 360 - abs(azimuth - facade) % 360) <= 45) AS hours FROM sun CROSS JOIN sides GROUP BY ALL)
    SELECT n_nationkey, sum(hours)::BIGINT AS total, first(side ORDER BY hours DESC, ord) AS best, first(side ORDER BY hours, ord) AS worst FROM l GROUP BY n_nationkey"""
)
def solar_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sun hours by facade over four dates, best and worst facade of each place."""
    n = C("n_nationkey")
    places = table(spark, sf_dir, "nation").select("n_nationkey", (42.0 + n / 10.0).alias("lat"), (-8.0 + n / 7.0).alias("lon"))
    days = F.array(*(F.lit(d) for _, d in L.SOLAR_DATES))
    grid = places.select("*", F.explode(days).alias("doy")).select("*", F.explode(F.transform(F.sequence(F.lit(4), F.lit(21)), lambda h: h.cast("double"))).alias("hour"))
    elevation, azimuth = sun.sun(C("lat"), C("lon"), C("doy"), C("hour"))
    seen = grid.select("n_nationkey", elevation.alias("el"), azimuth.alias("az"))
    sums = seen.groupBy("n_nationkey").agg(*(F.count_if(sun.facade_lit(C("az"), C("el"), F.lit(a))).alias(s) for s, a, _ in L.ORIENTATIONS))
    ranked = F.array(*(F.struct((-C(s)).alias("h"), F.lit(o).alias("o"), F.lit(s).alias("side")) for s, _, o in L.ORIENTATIONS))
    least = F.array(*(F.struct(C(s).alias("h"), F.lit(o).alias("o"), F.lit(s).alias("side")) for s, _, o in L.ORIENTATIONS))
    total = sum((C(s) for s, _, _ in L.ORIENTATIONS[1:]), C("N"))
    return sums.select("n_nationkey", total.alias("total"), F.array_min(ranked)["side"].alias("best"), F.array_min(least)["side"].alias("worst"))


@R.add(
    f"""WITH p AS (SELECT s_suppkey, 172 AS doy, hour::DOUBLE AS hour, 42.5::DOUBLE AS lat, -8.5::DOUBLE AS lon, 5.0::DOUBLE + s_suppkey % 40 AS height FROM supplier CROSS JOIN range(6, 21) r(hour)), {_SUN},
    s AS (SELECT *, CASE WHEN elevation > 0.5 THEN height / tan(radians(elevation)) END AS length FROM sun)
    SELECT s_suppkey, round(max(length), 4) AS longest, round(min(length), 4) AS shortest, count(length) AS lit FROM s GROUP BY s_suppkey"""
)
def shadow_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (5.0 + C("s_suppkey") % 40).alias("height"), F.explode(F.transform(F.sequence(F.lit(6), F.lit(20)), lambda h: h.cast("double"))).alias("hour"))
    elevation, _ = sun.sun(F.lit(42.5), F.lit(-8.5), F.lit(172), C("hour"))
    x = s.select("s_suppkey", sun.shadow_length(C("height"), elevation).alias("length"))
    return x.groupBy("s_suppkey").agg(F.round(F.max("length"), 4).alias("longest"), F.round(F.min("length"), 4).alias("shortest"), F.count("length").alias("lit"))


@R.add(
    """WITH x AS (SELECT n_nationkey, 9 AS z, 230 + n_nationkey AS tx, 180 + n_nationkey AS ty FROM nation)
    SELECT n_nationkey, round(tx / pow(2, z) * 360 - 180, 4) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * ty / pow(2, z))))), 4) AS north, round(6378137.0::DOUBLE * radians(-8.0 + n_nationkey), 2) AS mx,
        round(6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(42.0 + n_nationkey / 10.0::DOUBLE) / 2)), 2) AS my FROM x"""
)
def tile_bbox_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = C("n_nationkey")
    west, north = sun.tile_edge(F.lit(9), 230 + n, 180 + n)
    mx, my = sun.mercator(-8.0 + n, 42.0 + n / 10.0)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.round(west, 4).alias("west"), F.round(north, 4).alias("north"), F.round(mx, 2).alias("mx"), F.round(my, 2).alias("my"))


@R.add(
    """WITH x AS (SELECT n_nationkey, radians(42.0 + n_nationkey / 10.0::DOUBLE) AS la, -9.0 + n_nationkey / 20.0::DOUBLE AS lon FROM nation),
    k AS (SELECT *, 6378137.0::DOUBLE AS a, 0.00669438002290::DOUBLE AS e2 FROM x),
    n AS (SELECT *, e2 / (1 - e2) AS ep, a / sqrt(1 - e2 * pow(sin(la), 2)) AS nn, pow(tan(la), 2) AS t, e2 / (1 - e2) * pow(cos(la), 2) AS c, cos(la) * radians(lon + 9.0) AS d,
        a * ((1 - e2 / 4 - 3 * pow(e2, 2) / 64 - 5 * pow(e2, 3) / 256) * la - (3 * e2 / 8 + 3 * pow(e2, 2) / 32 + 45 * pow(e2, 3) / 1024) * sin(2 * la) + (15 * pow(e2, 2) / 256 + 45 * pow(e2, 3) / 1024) * sin(4 * la) - 35 * pow(e2, 3) / 3072 * sin(6 * la)) AS m FROM k)
    SELECT n_nationkey, round(0.9996::DOUBLE * nn * (d + (1 - t + c) * pow(d, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * pow(d, 5) / 120) + 500000, 3) AS east,
        round(0.9996::DOUBLE * (m + nn * tan(la) * (d * d / 2 + (5 - t + 9 * c + 4 * c * c) * pow(d, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * pow(d, 6) / 720)), 3) AS north FROM n"""
)
def utm29(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = C("n_nationkey")
    east, north = sun.utm29(-9.0 + n / 20.0, 42.0 + n / 10.0)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@R.add(
    """WITH u AS (SELECT l_orderkey, p_brand AS uso, sum(l_quantity) AS m2, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
    SELECT l_orderkey, sum(m2) AS total, first(uso ORDER BY m2 DESC, uso) AS principal, count(*) AS usos, sum(n)::BIGINT AS unidades, coalesce(sum(m2) FILTER (uso = 'Brand#11'), 0) AS comercial FROM u GROUP BY l_orderkey"""
)
def use_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas by use, then totals and the largest use of each building."""
    j = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(table(spark, sf_dir, "part").select(C("p_partkey").alias("l_partkey"), C("p_brand").alias("uso")), "l_partkey")
    u = j.groupBy("l_orderkey", "uso").agg(F.sum("l_quantity").alias("m2"), F.count(F.lit(1)).alias("n"))
    return u.groupBy("l_orderkey").agg(F.sum("m2").alias("total"), F.min(F.struct((-C("m2")).alias("m"), C("uso")))["uso"].alias("principal"), F.count(F.lit(1)).alias("usos"), F.sum("n").alias("unidades"), F.coalesce(F.sum(F.when(C("uso") == "Brand#11", C("m2"))), F.lit(0.0)).alias("comercial"))


@R.add("WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rn FROM part) SELECT p_brand, p_partkey, p_size FROM r WHERE rn = 1")
def keep_better(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.keep_better(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", C("p_size"), "p_partkey")


@R.add("SELECT r_regionkey, substring(sha256(string_agg(n_nationkey || ':' || n_name, '|' ORDER BY n_nationkey || ':' || n_name)), 1, 16) AS manifest_key FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def manifest_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(C("n_regionkey").alias("r_regionkey"), F.concat_ws(":", C("n_nationkey").cast("string"), "n_name").alias("p"))
    j = n.join(table(spark, sf_dir, "region").select("r_regionkey"), "r_regionkey")
    return j.groupBy("r_regionkey").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("p")), "|"), 256), 1, 16).alias("manifest_key"))


@R.add("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS version FROM orders")
def upsert_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of every order, and new rows for those that are finished; new ones win."""
    o = table(spark, sf_dir, "orders")
    old = o.select("o_orderkey", F.lit("old").alias("version"))
    new = o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("new").alias("version"))
    return lookups.upsert(old, new, "o_orderkey")


@R.add(
    f"""WITH {_LOOKUP}, x AS (SELECT c_custkey, 4.0 + c_custkey % 18 AS h, altura_maxima_m AS lim, ocupacion_max AS o, 40.0 + c_custkey % 200 AS foot, 120.0 + c_custkey % 250 AS parcel, (1 + c_custkey % 6) AS floors FROM m WHERE rn = 1)
    SELECT c_custkey, CASE WHEN lim IS NULL THEN 'no_verificable' WHEN h <= lim THEN 'cumple' ELSE 'no_cumple' END AS altura, CASE WHEN lim IS NULL THEN 'no_verificable' WHEN floors <= floor(lim / 3.2) THEN 'cumple' ELSE 'no_cumple' END AS plantas,
      CASE WHEN o IS NULL THEN 'no_verificable' WHEN foot / parcel * 100 <= floor(o * 100) THEN 'cumple' ELSE 'no_cumple' END AS ocupacion, round(foot * floors / parcel, 4) AS edificabilidad,
      greatest(parcel * o - foot, 0) AS libre FROM x"""
)
def report_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lookups.precedence_lookup(_requests(spark, sf_dir), _plans(spark), "municipio", "subzona", "ord")
    k, lim, o = C("c_custkey"), C("rule.altura_maxima_m"), C("rule.ocupacion_max")
    h, foot, parcel, floors = 4.0 + k % 18, 40.0 + k % 200, 120.0 + k % 250, 1 + k % 6
    verdict = lambda known, ok: F.when(known.isNull(), "no_verificable").when(ok, "cumple").otherwise("no_cumple")
    return out.select(
        "c_custkey", verdict(lim, h <= lim).alias("altura"), verdict(lim, floors <= F.floor(lim / rules.FLOOR_M)).alias("plantas"), verdict(o, foot / parcel * 100 <= F.floor(o * 100)).alias("ocupacion"),
        F.round(foot * floors / parcel, 4).alias("edificabilidad"), F.when(o.isNull(), F.lit(0.0)).otherwise(F.greatest(parcel * o - foot, F.lit(0.0))).alias("libre"),
    )


@R.add(
    """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN 50.0 + o_orderkey % 200 END AS foot, 3.0 + o_orderkey % 15 AS h, 100.0 + o_orderkey % 400 AS parcel, 0.75 + (o_orderkey % 5) / 4.0 AS ratio FROM orders)
    SELECT o_orderkey, floor(coalesce(foot * greatest(round(h / 3), 1), parcel * ratio) / 90)::BIGINT AS viviendas FROM x"""
)
def dwelling_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.dwellings(F.when(k % 4 > 0, 50.0 + k % 200), 3.0 + k % 15, 100.0 + k % 400, 0.75 + (k % 5) / 4.0).alias("viviendas"))


@R.add("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"), F.grouping_id().alias("level"))


@R.add("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_final, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS none FROM customer")
def semi_anti_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").groupBy(C("o_custkey").alias("c_custkey")).agg(F.max((C("o_orderstatus") == "F")).alias("final"))
    return c.join(o, "c_custkey", "left").select("c_custkey", F.coalesce("final", F.lit(False)).alias("has_final"), C("final").isNull().alias("none"))


@R.add("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").where(C("l_shipdate") <= F.expr("timestamp_ntz'1998-09-02'"))
    return i.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(C("l_extendedprice") * (1 - C("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


_RINGS = [(1, 0.0, 10.0, 0.0, 8.0), (2, 0.0, 30.0, 0.0, 12.0), (3, 5.0, 9.5, 2.0, 4.0)]
_RINGS_AT = Cases(_RINGS, ("id", "xmin", "xmax", "ymin", "ymax"), source="supplier", key="s_suppkey", vary={"xmax": 1.5, "ymax": 0.25})


@R.add(
    f"""WITH {_RINGS_AT.sql("b")} SELECT id, round((xmax - xmin) * (ymax - ymin), 4) AS area, round(2 * (xmax - xmin + ymax - ymin), 4) AS perimeter, xmin, xmax, ymin, ymax,
    (6 > xmin AND 6 < xmax AND 3 > ymin AND 3 < ymax) AS inside, round(sqrt(pow(greatest(xmin - 40, 0, 40 - xmax), 2)), 4) AS gap FROM b"""
)
def geometry_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _RINGS_AT.frame(spark, sf_dir).withColumn("ring", g.rectangle(C("xmin"), C("xmax"), C("ymin"), C("ymax")))
    box = g.bounds(C("ring"))
    gap = g.point_segment_distance(F.lit(40.0), C("ymin"), C("xmax"), C("ymin"), C("xmax"), C("ymax"))
    return b.select("id", F.round(g.area(C("ring")), 4).alias("area"), F.round(g.length(C("ring")), 4).alias("perimeter"), box["xmin"].alias("xmin"), box["xmax"].alias("xmax"), box["ymin"].alias("ymin"), box["ymax"].alias("ymax"), g.contains(C("ring"), F.lit(6.0), F.lit(3.0)).alias("inside"), F.round(gap, 4).alias("gap"))


@R.add()
def cityjson_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    from zonarium.sources.sinks import cityjson

    b = _RINGS_AT.frame(spark, sf_dir).withColumn("ring", g.rectangle(C("xmin"), C("xmax"), C("ymin"), C("ymax"))).withColumn("height", F.lit(9.0))
    return cityjson(b, "id", "ring", "height")


_DATES = [(1, "0{c}/07/20{b}"), (2, "{c}-{a}-{b}"), (3, "31/02/2020"), (4, "x"), (5, "12.05.1993")]
_DATES_AT = Cases(_DATES, ("id", "d"))


@R.add(
    f"""WITH {_DATES_AT.sql("s")}, p AS (SELECT id, regexp_extract(d, '([0-9]{{1,2}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{2,4}})', 1) AS dd, regexp_extract(d, '([0-9]{{1,2}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{2,4}})', 2) AS mm, regexp_extract(d, '([0-9]{{1,2}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{2,4}})', 3) AS yy FROM s)
    SELECT id, CAST(try_cast(lpad(CASE WHEN length(yy) = 2 THEN '19' || yy ELSE yy END, 4, '0') || '-' || lpad(mm, 2, '0') || '-' || lpad(dd, 2, '0') AS DATE) AS VARCHAR) AS iso,
    dayofyear(try_cast(lpad(CASE WHEN length(yy) = 2 THEN '19' || yy ELSE yy END, 4, '0') || '-' || lpad(mm, 2, '0') || '-' || lpad(dd, 2, '0') AS DATE)) AS doy FROM p"""
)
def spanish_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: F.regexp_extract("d", r"([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{2,4})", k)
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("19"), part(3))).otherwise(part(3))
    day = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")).try_cast("date")
    return _DATES_AT.frame(spark, sf_dir).select("id", day.cast("string").alias("iso"), F.dayofyear(day).cast("long").alias("doy"))


