"""Values with their origin: what is missing stays unavailable and is never filled in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From most to least reliable.
QUALITIES = ("official", "measured", "estimated", "unavailable")


def point(value: Column, unit: str, quality: str, source: str, reference: Column | None = None) -> Column:
    """A value with unit, quality and source; a null value is unavailable whatever its source."""
    if quality not in QUALITIES:
        raise ValueError(f"unknown quality {quality}")
    known = value.isNotNull()
    return F.struct(
        value.cast("double").alias("value"),
        F.lit(unit).alias("unit"),
        F.when(known, quality).otherwise("unavailable").alias("data_quality"),
        F.when(known, source).alias("source"),
        F.when(known, reference if reference is not None else F.lit(None).cast("string")).alias("source_ref"),
    )


def best(points: list[Column]) -> Column:
    """The first available of several points, else the last one."""
    return F.coalesce(*(F.when(p["data_quality"] != "unavailable", p) for p in points), points[-1])


def rank(quality: Column) -> Column:
    """Position in QUALITIES, for ordering."""
    return F.coalesce(*(F.when(quality == q, k) for k, q in enumerate(QUALITIES)))
