"""Look-ups with precedence, prefixes, ranges and nearest keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A relation up to this many rows is broadcast after counting; beyond it the joins shuffle.
SMALL_ROWS = 100_000
#: A range is filed under at most about so many buckets.
FILED = 256


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a bounded count shows it to be small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def precedence_lookup(requests: DataFrame, rules: DataFrame, key: str, subkey: str, order: str) -> DataFrame:
    """Each request with its rule: exact subkey, else the key's default (blank subkey), else without a subkey the first rule.

    The candidates of a key are folded to one row before the join, so a request meets one row.
    """
    default = F.min_by(F.struct(*rules.columns), F.struct(F.when(F.col(subkey) == "", 0).otherwise(1), F.col(order)))
    first = rules.groupBy(key).agg(default.alias("_first"), F.max((F.col(subkey) == "").cast("int")).alias("_has_default"))
    exact = rules.groupBy(key, subkey).agg(F.min_by(F.struct(*rules.columns), F.col(order)).alias("_exact"))
    out = requests.join(small(exact), [key, subkey], "left").join(small(first), key, "left")
    usable = (F.col("_has_default") == 1) | (F.coalesce(F.col(subkey), F.lit("")) == "")
    return out.withColumn("rule", F.coalesce("_exact", F.when(usable, F.col("_first")))).drop("_exact", "_first", "_has_default")


def longest_prefix(keys: DataFrame, codes: DataFrame, key: str, code: str) -> DataFrame:
    """Each key with its exact code, else the longest code it starts with, else the only code that starts with it.

    Codes are few and short: a key is cut into its prefixes and joined by equality.
    """
    longest = codes.agg(F.max(F.length(code)).alias("n"))
    distinct = keys.select(key).distinct()
    cut = distinct.join(F.broadcast(longest), F.lit(True)).select(key, F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(key), F.col("n"))))).alias("k"))
    parents = cut.withColumn(code, F.substring(F.col(key), F.lit(1), F.col("k"))).join(codes, code).groupBy(key).agg(F.max_by(code, "k").alias("_parent"))
    heads = codes.select(code, F.explode(F.sequence(F.lit(1), F.length(code))).alias("k")).select(code, F.substring(F.col(code), F.lit(1), F.col("k")).alias(key))
    children = heads.join(distinct, key).groupBy(key).agg(F.min(code).alias("_child"), F.count(F.lit(1)).alias("_n"))
    found = distinct.join(parents, key, "left").join(children, key, "left").select(key, F.coalesce("_parent", F.when(F.col("_n") == 1, F.col("_child"))).alias(code))
    return keys.join(found, key, "left")


def range_join(values: DataFrame, ranges: DataFrame, value: str, low: str, high: str, bucket: float) -> DataFrame:
    """Each value with the ranges low <= value < high (null ends are open), by equality on buckets.

    A range is filed under the buckets it touches, on the finest of a few levels (each ``FILED`` times as coarse as the last)
    where those are at most ``FILED`` and one; a value looks in its bucket of every level in use.  An open end reaches to the least or
    greatest value there is.
    """
    ends = ranges.agg(F.count_if(F.col(low).isNull() | F.col(high).isNull())).first()[0]
    least, greatest = values.agg(F.min(value), F.max(value)).first() if ends else (None, None)
    begin = F.coalesce(F.col(low), F.least(F.lit(least).cast("double"), F.col(high))).cast("double")
    end = F.coalesce(F.col(high), F.greatest(F.lit(greatest).cast("double"), F.col(low)) + bucket).cast("double")
    filed = ranges.withColumn("_from", begin).withColumn("_to", end).where("_from is not null and _to is not null")
    width = (F.col("_to") - F.col("_from")) / bucket
    level = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(width, F.lit(1.0))) / math.log(FILED) - 1)).cast("int")
    at = lambda x: F.floor(x / (F.lit(float(bucket)) * F.pow(F.lit(float(FILED)), F.col("_l"))))
    filed = filed.withColumn("_l", level)
    levels = sorted(r["_l"] for r in filed.select("_l").distinct().collect())
    v = values.withColumn("_l", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("_b", at(F.col(value)))
    filed = filed.withColumn("_b", F.explode(F.sequence(at(F.col("_from")), at(F.col("_to")))))
    fits = (F.col(low).isNull() | (F.col(value) >= F.col(low))) & (F.col(high).isNull() | (F.col(value) < F.col(high)))
    return v.join(small(filed), ["_l", "_b"]).where(fits).drop("_b", "_l", "_from", "_to")


def nearest_key(left: DataFrame, right: DataFrame, by: str, at: str, other: str, most: int) -> DataFrame:
    """Each left row with the right row of its group whose ``other`` is nearest to ``at`` (at most ``most`` apart, ties: smaller).

    The right side is filed under every key within reach, so the join is an equality.
    """
    near = right.withColumn(at, F.explode(F.sequence(F.col(other) - most, F.col(other) + most)))
    best = near.groupBy(by, at).agg(F.min_by(F.struct(*right.columns), F.struct(F.abs(F.col(at) - F.col(other)), F.col(other))).alias("nearest"))
    return left.join(best, [by, at], "left")


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys in the order they were first seen."""
    return df.groupBy(key).agg(F.min(order).alias("first_seen")).orderBy("first_seen")


def keep_better(df: DataFrame, key: str, score: Column, order: str) -> DataFrame:
    """One row a key: the highest score, the earlier row of equals."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(score, -F.col(order))).alias("_r"))
    return best.select("_r.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key; others stay."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def top_k(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def strictly_best(scored: DataFrame, key: str, score: str, tie: str, least: float) -> DataFrame:
    """The best row of each key if its score is high enough and no other row has the same."""
    ranked = top_k(scored, [key], 2, F.desc(score), F.col(tie))
    second = F.lead(score).over(W.partitionBy(key).orderBy("rank"))
    return ranked.withColumn("_n", second).where((F.col("rank") == 1) & (F.col(score) >= least) & (F.col("_n").isNull() | (F.col(score) > F.col("_n")))).drop("_n", "rank")
