"""Habitability of dwellings as a relational check: rooms against a table of requirements by number of rooms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonarium.functions.rules import check
from zonarium.sources.literals import KITCHEN_MINIMUM, OTHER_MINIMUM, ROOM_MINIMUM, relation

C = F.col
REQUIREMENT_COLUMNS = ("tipo", "k", "cubo", "codigo", "medida", "minimo")

# Least free heights, widths and squares in metres, service areas in square metres, daylight shares.
HEIGHT_CHANGE_OF_USE, HEIGHT_OTHERWISE = 2.4, 2.5
MAIN_WIDTH, MAIN_SQUARE = 2.7, 3.3
LARGE_ROOM, LARGE_WIDTH, LARGE_SQUARE, SMALL_WIDTH, SMALL_SQUARE = 12.0, 2.6, 2.6, 2.0, 2.2
SERVICES = {"bano": (5.0, 1.6), "lavadero": (1.5, None), "tendedero": (1.5, None)}
KITCHEN_WIDTH, TOILET, TOILET_FROM = 1.8, (1.5, 1.2), 4
DAYLIGHT, VENTILATION = 8, 3


def requirements() -> list[tuple]:
    """(kind of room, its rank, rooms counted up to six, code, measure, least value)."""
    out: list[tuple] = []
    for b in range(1, 7):
        out += [("estancia_mayor", 1, b, "superficie_e1", "superficie", ROOM_MINIMUM[b]), ("estancia_mayor", 1, b, "ancho_e1", "ancho", MAIN_WIDTH), ("estancia_mayor", 1, b, "cuadrado_e1", "lado", MAIN_SQUARE)]
        for k, area in enumerate(OTHER_MINIMUM.get(b, []), 1):
            large = area >= LARGE_ROOM
            out += [("estancia", k, b, f"superficie_e{k + 1}", "superficie", area), ("estancia", k, b, f"ancho_e{k + 1}", "ancho", LARGE_WIDTH if large else SMALL_WIDTH), ("estancia", k, b, f"cuadrado_e{k + 1}", "lado", LARGE_SQUARE if large else SMALL_SQUARE)]
        services = {"cocina": (KITCHEN_MINIMUM[b], KITCHEN_WIDTH), **SERVICES, "almacenamiento": (float(b), None)} | ({"aseo": TOILET} if b >= TOILET_FROM else {})
        for kind, (area, width) in services.items():
            out.append((kind, 1, b, f"superficie_{kind}", "superficie", area))
            if width is not None:
                out.append((kind, 1, b, f"ancho_{kind}", "ancho", width))
    return out


def habitability_checks(spark: SparkSession, dwellings: DataFrame, rooms: DataFrame) -> DataFrame:
    """(id, codigo, estado, observado, minimo) of every check.

    ``dwellings`` has id, operacion, altura and completo; ``rooms`` has id, pos, nombre, tipo, superficie, ancho, lado,
    acristalada, ventilacion and exterior (1, 0 or null).  A piece that is not there fails if the programme was declared complete and is
    not verifiable otherwise.  Rooms are ranked in their dwelling (others by area, then as listed), so every step is keyed by the dwelling.
    """
    by_area = F.when(C("tipo") == "estancia", -F.coalesce("superficie", F.lit(0.0))).otherwise(0.0)
    living = C("tipo").isin("estancia_mayor", "estancia")
    second = C("tipo").isin("estancia", "cocina")
    needed = requirements()
    pieces = {piece: 1 << at for at, piece in enumerate(dict.fromkeys((kind, k) for kind, k, *_ in needed))}
    bit = F.coalesce(*(F.when((C("tipo") == kind) & (C("k") == k), F.lit(one).cast("long")) for (kind, k), one in pieces.items()), F.lit(0).cast("long"))
    every = W.partitionBy("id")
    # one sort of the rooms serves ranks, counts and the join; each row then makes its own checks, a dwelling's first room also those of the dwelling
    ranks = {"_place": F.row_number().over(every.orderBy("tipo", "_by", "pos")), "k": F.row_number().over(W.partitionBy("id", "tipo").orderBy("_by", "pos"))}
    r = rooms.repartition("id").withColumn("_by", by_area).withColumns(ranks)
    r = r.withColumns({
        "n": F.count_if(living).over(every),
        "mayores": F.count_if(C("tipo") == "estancia_mayor").over(every),
        "segunda": F.max(F.when(second, C("exterior"))).over(every),
        "primera": F.max(F.when((C("tipo") == "estancia_mayor") & (C("k") == 1), C("exterior"))).over(every),
        "hay": F.bit_or(bit).over(every),
    })
    cubo = lambda n: F.least(F.greatest(n, F.lit(1)), F.lit(6)).cast("long")
    d = dwellings.select("id", "operacion", "altura", "completo", F.row_number().over(every.orderBy("operacion")).alias("_copy"))
    j = r.join(d, "id", "full_outer").fillna(0, ["n", "mayores", "hay"]).withColumn("_b", cubo(C("n")))
    none = F.lit(None).cast("double")
    row = lambda code, state, seen=none, least=none: F.struct(code.alias("codigo"), state.alias("estado"), seen.cast("double").alias("observado"), least.cast("double").alias("minimo"))

    name = lambda kind, k: f"programa_estancia_E{k + 1}" if kind == "estancia" else f"programa_{kind}"
    wanted = lambda b: F.array(*(F.struct(F.lit(name(kind, k)).alias("codigo"), F.lit(pieces[kind, k]).cast("long").alias("bit")) for kind, k, cubo, _, measure, _ in needed if cubo == b and measure == "superficie"))
    missing = F.filter(F.element_at(F.array(*map(wanted, range(1, 7))), C("_b").cast("int")), lambda p: C("hay").bitwiseAND(p["bit"]) == 0)
    absent = F.transform(missing, lambda p: row(p["codigo"], F.when(C("completo"), "no_cumple").otherwise("no_verificable")))
    least = F.when(C("operacion") == "cambio_uso_local_a_vivienda", HEIGHT_CHANGE_OF_USE).otherwise(HEIGHT_OTHERWISE)
    whole = F.array(
        row(F.lit("altura_libre"), check(C("altura"), least), C("altura"), least),
        F.when(C("mayores") > 1, row(F.lit("estancia_mayor_unica"), F.lit("no_cumple"), C("mayores"), F.lit(1.0))),
        F.when(C("mayores") > 0, row(F.lit("exterior_e1"), check(C("primera"), F.lit(1)), C("primera"), F.lit(1.0))),
        F.when(C("n") > 1, row(F.lit("exterior_secundaria"), check(C("segunda"), F.lit(1)), C("segunda"), F.lit(1.0))),
    )

    measures = ("superficie", "ancho", "lado")
    asked: dict[tuple, dict] = {}
    for kind, k, b, code, measure, value in needed:
        asked.setdefault((kind, k, b), {})[measure] = (code, value)
    need = relation(spark, [(*key, *(x for m in measures for x in of.get(m, (None, None)))) for key, of in asked.items()], ("tipo", "k", "_b", *(f"_{m}_{x}" for m in measures for x in ("codigo", "minimo"))))
    j = j.join(F.broadcast(need), ["tipo", "k", "_b"], "left")  # some sixty literals
    there = F.array(*(F.when(C(f"_{m}_codigo").isNotNull(), row(C(f"_{m}_codigo"), check(C(m), C(f"_{m}_minimo")), C(m), C(f"_{m}_minimo"))) for m in measures))
    lit = (living | (C("tipo") == "cocina")) & C("superficie").isNotNull()
    light, air = C("superficie") / DAYLIGHT, C("superficie") / DAYLIGHT / VENTILATION
    airy = F.array(
        F.when(lit, row(F.concat(F.lit("iluminacion_"), C("nombre")), check(C("acristalada"), light), C("acristalada"), light)),
        F.when(lit, row(F.concat(F.lit("ventilacion_"), C("nombre")), check(C("ventilacion"), air), C("ventilacion"), air)),
    )
    known, nothing = C("_copy").isNotNull(), F.filter(there, lambda _: F.lit(False))  # a room of no dwelling meets no programme
    checks = F.concat(
        F.when(known & (F.coalesce("_place", F.lit(1)) == 1), F.concat(whole, absent)).otherwise(nothing),
        F.when(known, there).otherwise(nothing),
        F.when(F.coalesce("_copy", F.lit(1)) == 1, airy).otherwise(nothing),
    )
    return j.select("id", F.explode(checks).alias("_c")).where("_c is not null").select("id", "_c.*")


def habitability_verdict(checks: DataFrame) -> DataFrame:
    """(id, estado, checks, fails, unknowns): any failure fails, else anything unknown leaves it open."""
    s = checks.groupBy("id").agg(F.count(F.lit(1)).alias("checks"), F.count_if(C("estado") == "no_cumple").alias("fails"), F.count_if(C("estado") == "no_verificable").alias("unknowns"))
    return s.withColumn("estado", F.when(C("fails") > 0, "no_cumple").when(C("unknowns") > 0, "no_verificable").otherwise("cumple"))
