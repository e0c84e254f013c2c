"""Decisions that take the first source, variant or rung that has an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_source(sources: list[tuple[str, Column]]) -> Column:
    """(value, source) of the first source with a value; both null if none has one."""
    label = None
    for name, value in sources:
        label = F.when(value.isNotNull(), name) if label is None else label.when(value.isNotNull(), name)
    return F.struct(F.coalesce(*(v for _, v in sources)).alias("value"), label.alias("source"))


def first_variant(asked: DataFrame, key: str, variants: list[Column], known: DataFrame, code: str) -> DataFrame:
    """Each asked row with the known row of the first of its variants that exists (``hit``)."""
    tried = asked.select(key, F.posexplode(F.array(*variants)).alias("_p", code))
    best = tried.join(known, code).groupBy(key).agg(F.min_by(F.struct(*known.columns), "_p").alias("hit"))
    return asked.join(best, key, "left")


def ordinance_state(stated: Column, exists: Column, layer: Column, area: Column, facility: Column, pilot: Column, near: Column) -> Column:
    """How an ordinance was found, which it is, and how sure that is; neighbours are only candidates."""
    rungs = [("indicada", F.when(exists, stated), "alta"), ("capa_oficial", layer, "alta"), ("ambito", area, "media"), ("dotacion", facility, "media"), ("piloto", pilot, "baja")]
    state = sure = None
    for name, code, confidence in rungs:
        state = F.when(code.isNotNull(), name) if state is None else state.when(code.isNotNull(), name)
        sure = F.when(code.isNotNull(), confidence) if sure is None else sure.when(code.isNotNull(), confidence)
    return F.struct(
        state.when(near.isNotNull(), "candidatas").otherwise("sin_dato").alias("estado"),
        F.coalesce(*(c for _, c, _ in rungs)).alias("codigo"),
        sure.when(near.isNotNull(), "baja").alias("confianza"),
    )
