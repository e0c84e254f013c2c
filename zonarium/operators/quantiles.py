"""Exact percentiles of groups of any size, without bringing a group together.

A sketch brackets the wanted ranks, an exact count says how many values lie below and within the bracket, and the next
pass sketches only what is within, so every pass leaves a few ten-thousandths of a group.  What is left is counted by
distinct value.  All steps are aggregations that combine before the shuffle, whatever a group's share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonarium.operators.lookups import small
from zonarium.sources.scratch import materialised

#: Sketches are off by at most a rank in so many; brackets reach so many of those to either side.
ACCURACY, REACH = 10_000, 4
#: A bracket with so few values is counted out.
FEW = 50_000
PASSES = 12


def exact_percentiles(rows: DataFrame, group: str, value: str, q: float, few: int = FEW, accuracy: int = ACCURACY) -> DataFrame:
    """(group, n, p): the percentile by linear interpolation between the two nearest ranks; nulls do not count.

    Groups without a value have a null percentile.  The brackets of all groups are broadcast if they are few, else joined.
    """
    v = rows.select(group, F.col(value).cast("double").alias("_v"))
    sizes = v.groupBy(group).agg(F.count("_v").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    at = F.lit(float(q)) * (F.col("n") - 1)
    now = sizes.select(group, "n", "_lo", "_hi", at.alias("_at"), F.floor(at).alias("_r0"), F.ceil(at).alias("_r1"), F.lit(0).cast("long").alias("_below"), F.col("n").alias("_in"))
    now = materialised(now, "brackets")
    key = v[group]
    for _ in range(PASSES):
        wide = now.where((F.col("_in") > few) & (F.col("_lo") < F.col("_hi")))
        if wide.isEmpty():
            break
        b = small(wide.withColumnRenamed(group, "_g"))
        kept = v.join(b, key.eqNullSafe(F.col("_g"))).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        rank = lambda r: (F.col(r) - F.col("_below") + 0.5) / F.col("_in")
        off = REACH / accuracy
        # the sketch takes constant ranks only: of a fine grid of them the two around the wanted ones are picked
        grid = [k / 1000 for k in range(1001)]
        sketch = kept.groupBy(group).agg(F.percentile_approx("_v", grid, accuracy).alias("_grid"))
        place = lambda x: F.greatest(F.lit(1), F.least(F.lit(1001), x)).cast("int")
        low, high = F.floor((rank("_r0") - off) * 1000) + 1, F.ceil((rank("_r1") + off) * 1000) + 1
        picked = wide.join(small(sketch.withColumnRenamed(group, "_g")), wide[group].eqNullSafe(F.col("_g"))).drop("_g")
        picked = picked.withColumn("_nlo", F.element_at("_grid", place(low))).withColumn("_nhi", F.element_at("_grid", place(high))).drop("_grid")
        picked = materialised(picked, "bracketed")
        c = small(picked.withColumnRenamed(group, "_g"))
        inner = v.join(c, key.eqNullSafe(F.col("_g"))).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        counts = inner.groupBy(group).agg(F.count_if(F.col("_v") < F.col("_nlo")).alias("_less"), F.count_if(F.col("_v").between(F.col("_nlo"), F.col("_nhi"))).alias("_within"))
        judged = picked.join(counts.withColumnRenamed(group, "_g"), picked[group].eqNullSafe(F.col("_g"))).drop("_g")
        holds = (F.col("_below") + F.col("_less") <= F.col("_r0")) & (F.col("_r1") < F.col("_below") + F.col("_less") + F.col("_within"))
        new = judged.select(
            group, "n",
            F.when(holds, F.col("_nlo")).otherwise(F.col("_lo")).alias("_lo"), F.when(holds, F.col("_nhi")).otherwise(F.col("_hi")).alias("_hi"),
            "_at", "_r0", "_r1", F.when(holds, F.col("_below") + F.col("_less")).otherwise(F.col("_below")).alias("_below"), F.when(holds, F.col("_within")).otherwise(F.col("_in")).alias("_in"),
        )
        rest = now.where((F.col("_in") <= few) | (F.col("_lo") >= F.col("_hi")) | F.col("_lo").isNull())
        before = now.agg(F.sum("_in")).first()[0]
        now = materialised(rest.unionByName(new), "brackets")
        if now.agg(F.sum("_in")).first()[0] >= before:  # equal values fill the brackets: their distinct values are few
            break
    b = small(now.withColumnRenamed(group, "_g"))
    left = v.join(b, key.eqNullSafe(F.col("_g"))).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    cells = left.groupBy(group, "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(group).orderBy("_v"))
    placed = cells.withColumn("_upto", upto).join(b, cells[group].eqNullSafe(F.col("_g"))).withColumn("_upto", F.col("_upto") + F.col("_below"))
    ends = placed.groupBy(group).agg(F.min(F.when(F.col("_upto") > F.col("_r0"), F.col("_v"))).alias("_a"), F.min(F.when(F.col("_upto") > F.col("_r1"), F.col("_v"))).alias("_b"))
    out = now.join(ends.withColumnRenamed(group, "_g"), now[group].eqNullSafe(F.col("_g")), "left")
    return out.select(group, "n", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.col("_r0"))).alias("p"))
