"""Planning rules as Column expressions: heights, grades, costs, habitability, envelopes in numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR_M = 3.2


def height_from_tags(height: Column, levels: Column, kind: Column) -> Column:
    """(height, source, estimated): a stated height, else floors, else the kind of building, else nine metres."""
    stated = F.regexp_replace(F.lower(height), "m", "")
    h = F.trim(stated).try_cast("double")
    n = F.trim(levels).try_cast("double")
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    typed = F.when(k.isin("apartments", "office", "hospital", "hotel"), 18.0).when(k.isin("commercial", "retail", "school", "church"), 12.0).when(k.isin("industrial", "warehouse"), 8.0)
    value = F.coalesce(F.greatest(F.lit(2.5), F.when(h.isNotNull(), h)), F.lit(None).cast("double"))
    return F.struct(
        F.when(h.isNotNull(), value).when(n.isNotNull(), F.greatest(F.lit(3.0), n * FLOOR_M)).otherwise(F.coalesce(typed, F.lit(9.0))).alias("height"),
        F.when(h.isNotNull(), "osm_height").when(n.isNotNull(), "osm_levels").when(typed.isNotNull(), "building_type").otherwise("default").alias("source"),
        h.isNull().alias("estimated"),
    )


def grade(height: Column, limit: Column, status: Column, cap: Column | None = None, regime: Column | None = None, width_table: Column | None = None, subzone: Column | None = None) -> Column:
    """Compliance of a height with a zone: one of nine statuses, pilot zones only as orientation."""
    nothing = F.lit(None)
    cap = nothing.cast("double") if cap is None else cap
    regime = nothing.cast("string") if regime is None else regime
    width_table = nothing.cast("string") if width_table is None else width_table
    subzone = nothing.cast("string") if subzone is None else subzone
    pilot = F.lower(F.coalesce(status, F.lit(""))) == "pilot"
    return (
        F.when(limit.isNull() & (regime == "alzados_ordenacion"), "altura_alzados")
        .when(limit.isNull() & width_table.isNotNull(), "altura_tabla")
        .when(limit.isNull() & subzone.isNotNull(), "sin_limite")
        .when(limit.isNull() | height.isNull(), "sin_dato")
        .when((height <= limit) & pilot, "orientativo_dentro")
        .when(height <= limit, "compatible")
        .when(pilot, "orientativo_supera")
        .when((cap > limit) & (height <= cap), "supera_cornisa")
        .otherwise("supera_altura")
    )


def excess_cause(excess: Column) -> Column:
    return F.when(excess > 1.5, "considerable").when(excess > 0, "marginal")


def conversion_costs(area: Column, per_m2: Column, fixed: Column, fees: Column, sale: Column, rent: Column) -> dict[str, Column]:
    """Costs and returns of a conversion from the parts that are present; missing is not zero."""
    works = F.round(area * per_m2, 2)
    parts = F.filter(F.array(works, fixed, fees), lambda x: x.isNotNull())
    total = F.when(F.size(parts) > 0, F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), 2))
    profit = F.round(sale - total, 2)
    return {
        "obra": works,
        "inversion": total,
        "por_m2": F.when(area > 0, F.round(total / area, 2)),
        "beneficio": profit,
        "roi_pct": F.when(total > 0, F.round(profit / total * 100, 2)),
        "payback_meses": F.when(rent > 0, F.round(total / rent, 1)),
        "rentabilidad_pct": F.when((rent > 0) & (total > 0), F.round(rent * 12 / total * 100, 2)),
    }


def check(observed: Column, required: Column) -> Column:
    """Pass, fail, or not verifiable without a measure."""
    return F.when(observed.isNull(), "no_verificable").when(observed >= required, "cumple").otherwise("no_cumple")


def overall(fails: Column, unknowns: Column) -> Column:
    return F.when(fails > 0, "no_cumple").when(unknowns > 0, "no_verificable").otherwise("cumple")


def limiting_factor(parcel: Column, built: Column, occupancy: Column, ratio: Column, setback: Column, directional: Column) -> Column:
    """What binds first: occupancy, floor-area ratio, setbacks, else height (one per cent of slack)."""
    return (
        F.when(parcel * occupancy < built * 0.99, "ocupacion")
        .when(parcel * ratio < built * 0.99, "edificabilidad")
        .when((directional | (setback > 0)) & (built <= parcel * 0.99), "retranqueos")
        .otherwise("altura")
    )


def contradictions(height: Column, limit: Column, cap: Column, parcel: Column, smallest: Column, built: Column, ratio: Column, uses: Column, single_family: Column) -> Column:
    """Warnings where a building's data clash with its ordinance; limits with their tolerance are decimals, so a value on the limit passes."""
    beyond = lambda limit, tolerance: F.round(limit * tolerance, 9)
    against = F.coalesce(F.when(limit.isNotNull(), cap), limit)
    return F.array_compact(
        F.array(
            F.when(height > beyond(against, 1.1), "altura"),
            F.when((parcel > 0) & (parcel < smallest), "parcela_minima"),
            F.when((parcel > 0) & (built / parcel > beyond(ratio, 1.15)), "edificabilidad"),
            F.when(single_family & (uses > 2), "usos"),
        )
    )


def viability(envelope: Column, reasons: Column) -> Column:
    """No envelope: unfit; any reservation: conditional; else fit."""
    return F.when(envelope.isNull() | (envelope <= 0), "no_apto").when(F.size(reasons) > 0, "condicionado").otherwise("apto")


def dwellings(footprint: Column, height: Column, parcel: Column, ratio: Column) -> Column:
    """Buildable area over 90 m2, whole dwellings only."""
    area = F.coalesce(footprint * F.greatest(F.round(height / 3, 0), F.lit(1.0)), parcel * ratio)
    return F.floor(area / 90)


def pool_margin(parcel: Column, limit: Column, occupied: Column, pool: Column, counts: Column) -> Column:
    """Area left under the occupancy limit after a pool that counts at the given share."""
    return parcel * limit - occupied - pool * counts


def land_verdict(land: Column, protected: Column) -> Column:
    """Fit, conditional or unfit by land class: protected rustic land is out, other open land needs more."""
    return F.when((land == "rustico") & protected, "no_apto").when(land.isin("rustico", "urbanizable"), "condicionado").otherwise("apto")


# What each class of land says about housing, its article and restriction.
LAND_RULES = {
    "urbanizable": ("ART27", True),
    "nucleo_rural": ("ART13", True),
    "urbano": ("ART17", True),
    "rustico": ("ART31_32", False),
}


def land_class(zone: Column) -> Column:
    """The class of land that a zone's name stands for; an unknown name stays as it is."""
    z = F.lower(F.trim(F.coalesce(zone, F.lit(""))))
    return (
        F.when(z.contains("urbano") & z.contains("consolid"), "urbano_consolidado")
        .when(z.contains("urbano"), "urbano")
        .when(z.contains("nucleo") | z.contains("núcleo"), "nucleo_rural")
        .when(z.contains("urbanizable"), "urbanizable")
        .when(z.contains("rustic") | z.contains("rústic"), "rustico")
        .otherwise(z)
    )


def zoning(zone: Column, use: Column) -> Column:
    """(class, fit for housing, article): only a housing use gets an answer, and rustic or unknown land says no."""
    kind = land_class(zone)
    housing = F.lower(F.coalesce(use, F.lit(""))).startswith("residen")
    base = F.when(kind.startswith("urbano"), "urbano").when(kind.isin("urbanizable", "nucleo_rural"), kind).otherwise("rustico")
    fit, article = F.lit(None).cast("boolean"), F.lit(None).cast("string")
    for name, (code, allowed) in LAND_RULES.items():
        fit = F.when(base == name, F.when(housing, F.lit(allowed))).otherwise(fit)
        article = F.when(base == name, F.lit(code)).otherwise(article)
    return F.struct(kind.alias("zona"), fit.alias("apto_residencial"), article.alias("articulo"))


# What stands in when neither request nor plan gives a limit.
DEFAULT_HEIGHT, DEFAULT_SETBACK = 12.0, 3.0


def effective_parameters(height: Column, setback: Column, plan_height: Column, plan_setback: Column, direction: Column, has_axis: Column, plan_direction: Column, plan_has_sides: Column, use_plan_front: Column) -> Column:
    """Limits that hold for a parcel: the request's, else the plan's, else the defaults, and where the front came from."""
    by_default = direction.isNull() & ~has_axis & use_plan_front & plan_direction.isNotNull() & plan_has_sides
    known = F.coalesce(height, plan_height)
    return F.struct(
        F.coalesce(known, F.lit(DEFAULT_HEIGHT)).alias("altura"),
        F.coalesce(setback, plan_setback, F.when(known.isNull(), F.lit(DEFAULT_SETBACK))).alias("retranqueo"),
        F.coalesce(direction, F.when(by_default, plan_direction)).alias("frente"),
        F.when(direction.isNotNull(), "request").when(by_default, "plan_default").otherwise("none").alias("origen_frente"),
        known.isNull().alias("por_defecto"),
    )


def assessment(has_geometry: Column, envelope: Column, not_applied: Column, axis_ignored: Column, front_source: Column) -> Column:
    """(verdict, reasons): without a parcel conditional, without an envelope unfit, with any reservation conditional."""
    reasons = F.array_compact(
        F.array(
            F.when(~has_geometry, "sin_geometria"),
            F.when(has_geometry & (envelope.isNull() | (envelope <= 0)), "sin_envolvente"),
            F.when(has_geometry & (envelope > 0) & not_applied, "retranqueo_direccional_no_aplicado"),
            F.when(has_geometry & (envelope > 0) & axis_ignored, "eje_ignorado"),
            F.when(has_geometry & (envelope > 0) & (front_source == "plan_default"), "frente_del_plan"),
        )
    )
    verdict = F.when(~has_geometry, "condicionado").when(envelope.isNull() | (envelope <= 0), "no_apto").when(F.size(reasons) > 0, "condicionado").otherwise("apto")
    return F.struct(verdict.alias("viabilidad"), reasons.alias("motivos"))


def historic_height_warnings(in_plan: Column, regime: Column, height: Column, floors: Column, block: Column, has_drawing: Column) -> Column:
    """Warnings for parcels of the historic plan: its drawings set the height, and more floors stand than are declared."""
    drawn = in_plan & (regime == "alzados_ordenacion")
    return F.array_compact(
        F.array(
            F.when(drawn, F.when(height.isNull(), "alzado_sin_medida").when(block.isNull() | (block == ""), "comparar_con_alzado_de_su_manzana").otherwise("comparar_con_alzado_de_manzana")),
            F.when(drawn & height.isNotNull() & ~has_drawing, "plano_no_localizado"),
            F.when(in_plan & (floors > 0) & (height / FLOOR_M > floors + 1.5), "sobreedificacion"),
        )
    )


def ordinance_conflict(given: Column, known: Column, official: Column, official_quality: Column) -> Column:
    """What is wrong with a given ordinance: unknown to the plan, or another than the official layer's (codes may be prefixes)."""
    a, b = (F.regexp_replace(F.upper(c), "[^A-Z0-9]", "") for c in (known, official))
    differs = (official_quality == "official") & official.isNotNull() & ~a.startswith(b) & ~b.startswith(a)
    return F.when(given.isNull(), F.lit(None)).when(known.isNull(), F.when(official.isNull(), "ignorada").otherwise("no_existe")).when(differs, "difiere_de_la_capa")


def pool_viability(parcel: Column, footprint: Column, limit_pct: Column, pool: Column, counts: Column) -> Column:
    """(quality, present %, limit, margin, what the pool counts, fit, resulting %): nulls where the data are missing."""
    known = parcel.isNotNull() & (parcel > 0)
    used = F.coalesce(footprint, F.lit(0.0))
    limit = parcel * limit_pct / 100
    with_limit = known & limit_pct.isNotNull() & (limit_pct > 0)
    part = lambda ok, x, digits, name: F.when(ok, F.round(x, digits)).alias(name)
    return F.struct(
        F.when(known, "estimated").otherwise("unavailable").alias("calidad"),
        part(known & (footprint > 0), footprint / parcel * 100, 1, "ocupacion_actual_pct"),
        part(with_limit, limit, 1, "limite_m2"),
        part(with_limit, limit - used, 1, "margen_m2"),
        part(with_limit, pool * counts, 1, "computa_m2"),
        F.when(with_limit, pool * counts <= limit - used).alias("viable"),
        part(with_limit, (used + pool * counts) / parcel * 100, 1, "resultante_pct"),
    )


NUMERIC_FIELDS = ("altura_maxima_m", "retranqueo_min_m", "setback_front_m", "setback_side_m", "setback_back_m", "ocupacion_max", "edificabilidad_max_m2_m2", "parcela_min_m2", "frente_min_m")


def cleaned_plan_row(columns: list[str], default_height_for: tuple[str, ...] = ("a coruña", "a coruna"), default_height: str = "9") -> dict[str, Column]:
    """A plan's text columns put right: points for commas, no direction without sided setbacks, a cautious height where one city gives none."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    out = {c: F.col(c) for c in columns}
    out["municipio"] = blank("municipio")
    out["subzona"] = F.regexp_replace(blank("subzona"), r"\.+$", "")
    for c in NUMERIC_FIELDS:
        if c in out:
            out[c] = F.replace(blank(c), F.lit(","), F.lit("."))
    if "front_direction_default" in out:
        sided = [c for c in ("setback_front_m", "setback_side_m", "setback_back_m") if c in out]
        any_side = F.concat(*(blank(c) for c in sided)) != "" if sided else F.lit(False)
        out["front_direction_default"] = F.when(any_side, blank("front_direction_default")).otherwise("")
    if "altura_maxima_m" in out:
        theirs = F.lower(out["municipio"]).isin(*default_height_for)
        out["altura_maxima_m"] = F.when(theirs & (out["altura_maxima_m"] == ""), default_height).otherwise(out["altura_maxima_m"])
    return out


def patched_heights(heights: Column, subzone: Column, patch: dict[str, str]) -> Column:
    """Blank heights filled by the subzone's code."""
    known = F.create_map(*(F.lit(x) for kv in patch.items() for x in kv))
    return F.coalesce(F.nullif(F.trim(heights), F.lit("")), F.element_at(known, F.trim(subzone)), heights)


def compared(observed: Column, limit: Column, at_least: bool = False, slack: float = 0.0) -> Column:
    """Pass, fail or not verifiable of a building's figure against its zone's, with some slack."""
    fits = observed >= limit - slack if at_least else observed <= limit + slack
    return F.when(observed.isNull() | limit.isNull(), "no_verificable").when(fits, "cumple").otherwise("no_cumple")
