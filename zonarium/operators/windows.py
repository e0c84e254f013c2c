"""Order-dependent operators: fill-forward, segments, sessions, last turns, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fill_forward(df: DataFrame, by: list[str], order: str, value: str, gap: int, out: str) -> DataFrame:
    """The last non-null value before or at a row, if it stands at most ``gap`` positions back."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(order).alias("o"))), ignorenulls=True).over(w)
    return df.withColumn("_l", last).withColumn(out, F.when(F.col(order) - F.col("_l.o") <= gap, F.col("_l.v"))).drop("_l")


def segments(df: DataFrame, by: list[str], order: str, is_header: Column) -> DataFrame:
    """Numbers runs of rows from one header to the next (0 before the first)."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("segment", F.sum(is_header.cast("int")).over(w))


def offsets(df: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """Start of each text when a group's texts are joined by one character."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("start", F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0)))


def last_rows(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each group, newest first."""
    return df.withColumn("back", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("back") <= n)


def sessions(df: DataFrame, by: str, at: str, gap_seconds: int, tie: str) -> DataFrame:
    """Numbers each key's sessions from 1; a gap of more than ``gap_seconds`` starts a new one."""
    w = W.partitionBy(by).orderBy(at, tie)
    apart = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    starts = F.coalesce((apart > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    return df.withColumn("_s", starts).withColumn("session", F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_s")


def suppressed_repeats(df: DataFrame, by: list[str], order: str, ref: str, position: str, near: int) -> DataFrame:
    """Drops a header that repeats its predecessor's reference fewer than ``near`` characters later."""
    w = W.partitionBy(*by).orderBy(order)
    again = (F.lag(ref).over(w) == F.col(ref)) & (F.col(position) - F.lag(position).over(w) < near)
    return df.withColumn("_a", again).where(~F.coalesce("_a", F.lit(False))).drop("_a")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, start: str, value: str, out: str) -> DataFrame:
    """Each left row with the value of the last right row of its group that starts at or before it.

    Both sides are laid into one ordered sequence and the value is carried forward: one shuffle on
    the group, no range join.
    """
    r = right.select(*by, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(value).alias("v")).alias("_v"), F.lit(None).cast(left.schema.simpleString()).alias("_row"))
    rows = left.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    w = W.partitionBy(*by).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    both = r.unionByName(rows).withColumn("_c", F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_row.*", F.col("_c.v").alias(out))


def carried_block(df: DataFrame, by: list[str], order: str, header: str) -> DataFrame:
    """Rows grouped under the last header at or before them: header, first and last position, rows."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    g = df.withColumn("_g", F.count(header).over(w)).where("_g > 0")
    return g.groupBy(*by, "_g").agg(F.max(header).alias(header), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("rows")).drop("_g")
