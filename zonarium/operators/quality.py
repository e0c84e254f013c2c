"""Table quality: coverage, validation, consolidation, evaluation against gold answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, present, missing): blank strings and nulls are missing; one pass over the table."""
    present = [F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).alias(c) for c in columns]
    row = df.agg(F.count(F.lit(1)).alias("_all"), *present)
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("present")) for c in columns))).alias("_c")
    return row.select("_all", cells).select("_c.column", "_c.present", (F.col("_all") - F.col("_c.present")).alias("missing"))


def plan_errors(key: Column, height: Column, setback: Column, occupancy: Column, direction: Column, setbacks: list[Column]) -> Column:
    """Broken rules of a plan row, in the order of the rules."""
    some = F.coalesce(*setbacks)
    return F.array_compact(
        F.array(
            F.when(key.isNull() | (F.trim(key) == ""), "municipio"),
            F.when(height <= 0, "altura"),
            F.when(setback < 0, "retranqueo"),
            F.when((occupancy < 0) | (occupancy > 1), "ocupacion"),
            F.when(direction.isNotNull() & ~F.lower(direction).isin("north", "south", "east", "west"), "direccion"),
            F.when(direction.isNotNull() & some.isNull(), "direccion_sin_retranqueo"),
        )
    )


def duplicated(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """Marks the second and later rows of a key."""
    return df.withColumn("duplicate", F.row_number().over(W.partitionBy(*keys).orderBy(order)) > 1)


def consolidated(df: DataFrame, by: list[str], largest: list[str], mode: str, first: str, order: str) -> DataFrame:
    """One row a key: maxima without nulls, the most frequent value (ties: first seen), the first hint.

    Both levels of the mode are aggregations, so a frequent key is combined before the shuffle.
    """
    counts = df.groupBy(*by, mode).agg(
        F.count(mode).alias("_n"), F.min(order).alias("_o"), *(F.max(c).alias(c) for c in largest), F.min_by(F.when(F.col(first).isNotNull(), F.struct(F.col(order), F.col(first))), F.when(F.col(first).isNotNull(), F.col(order))).alias("_f")
    )
    return counts.groupBy(*by).agg(*(F.max(c).alias(c) for c in largest), F.max_by(mode, F.struct("_n", -F.col("_o"))).alias(mode), F.min("_f").alias("_f")).select(*by, *largest, mode, F.col(f"_f.{first}").alias(first))


def overlap_scores(answer: Column, gold: Column) -> dict[str, Column]:
    """Precision, recall and F1 of two token sets."""
    a, g = F.array_distinct(answer), F.array_distinct(gold)
    both = F.size(F.array_intersect(a, g)).cast("double")
    p = F.when(F.size(a) > 0, both / F.size(a)).otherwise(0.0)
    r = F.when(F.size(g) > 0, both / F.size(g)).otherwise(0.0)
    return {"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4)}


def source_quality(flags: list[Column]) -> Column:
    """Grade by how many sources answered."""
    n = sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))
    return F.when(n >= 2, "alta").when(n == 1, "media").otherwise("baja")
