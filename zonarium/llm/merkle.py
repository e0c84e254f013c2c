"""Merkle manifest of a table: one root that any changed, lost or added row changes, and a proof for every row.

Every row is hashed into a leaf over its named columns.  Within each group the leaves, in order of the id, become a tree:
each level numbers its nodes, divides the numbers by the fanout, and hashes the sorted children of each quotient into a
parent, until a group has one node, its subroot.  The subroots, in order of the group, become a tree in the same way,
whose node is the root.  Then the levels are joined from the root down: every node hands its children its own proof
with their siblings put before it, so a level's join moves as many rows as the level has nodes, and all levels together
move about as many rows as there are leaves.

Leaves are numbered without a task that sees a whole group: rows are range-partitioned by group and id, numbered by
``row_number`` within a partition, and shifted by the counts of the partitions before.  Each level is a table in the
shared folder, so lost executors cost a level at most, and every join is on (group, number), which is a key of one row.

Edge cases: a null value is hashed as ``-``, so it differs from an empty text; a null group comes first; rows with
a null id come first in their group; ties of an id are ordered by the leaf, and equal rows are leaves of their own, whose
proofs may be told apart by place only; one row is its own subroot, and root; an empty table gives an empty manifest;
columns that are not named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonarium.sources.scratch import materialised

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<before:string,after:string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 bytes' count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """Hexadecimal SHA-256 of the encoded values, in the given order."""
    return F.sha2(F.concat(*(encoded(v) for v in values)), 256)


def group_key(group: Column) -> Column:
    """A text that is never null and sorts nulls first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``idx``, the place of a row in its group ``g`` from 0, and ``n``, the rows of the group.

    Equal rows are spread over partitions too, by a last range key without meaning.
    """
    placed = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("g", *order, "_tie")
    placed = materialised(placed.withColumn("_part", F.spark_partition_id()), name)
    counts = placed.groupBy("_part", "g").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", "g", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_at"), F.sum("_c").over(Window.partitionBy("g")).alias("n"))
    within = F.row_number().over(Window.partitionBy("_part", "g").orderBy(*order, "_tie"))
    return placed.withColumn("_k", within).join(starts, ["_part", "g"]).withColumn("idx", F.col("_at") + F.col("_k") - 1).drop("_part", "_tie", "_k", "_at")


class Forest:
    """The levels of one tree for each group: ``levels[k]`` has (g, idx, n, h), above the leaves also ``kids``."""

    def __init__(self, leaves: DataFrame, name: str, fanout: int) -> None:
        """``leaves`` has g, idx, n, h and whatever else a leaf carries along."""
        if fanout < 2:
            raise ValueError("a node has two children at least")
        self.fanout = fanout
        self.carried = [c for c in leaves.columns if c not in ("g", "idx", "n", "h")]
        self.levels = [materialised(leaves, f"{name}-0")]
        widest = self.levels[0].agg(F.max("n")).first()[0] or 0
        while widest > 1:
            self.levels.append(materialised(self._above(self.levels[-1]), f"{name}-{len(self.levels)}"))
            widest = -(-widest // fanout)

    def _above(self, level: DataFrame) -> DataFrame:
        """Parents of the nodes of groups that have several."""
        child = F.struct("idx", "h", *(c for c in self.carried if c in level.columns))
        runs = level.where("n > 1").groupBy("g", F.expr(f"idx div {self.fanout}").alias("_up")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(child)).alias("kids"))
        up = F.expr(f"(n + {self.fanout - 1}) div {self.fanout}")
        return runs.select("g", F.col("_up").alias("idx"), up.alias("n"), F.sha2(F.array_join(F.col("kids")["h"], ""), 256).alias("h"), "kids")

    def tops(self) -> DataFrame:
        """(g, h) of the one node left of each group."""
        out = self.levels[0].where("n = 1").select("g", "h")
        for level in self.levels[1:]:
            out = out.unionByName(level.where("n = 1").select("g", "h"))
        return out

    def leaves_with_proofs(self, tops: DataFrame) -> DataFrame:
        """Every leaf with the columns of its group's row in ``tops``, whose ``proof`` is what lies above the tree.

        Parents hold their children's columns, so the leaves themselves are not joined again.
        """
        handed = [c for c in tops.columns if c not in ("g", "proof")]
        down: DataFrame | None = None
        for depth in range(len(self.levels) - 1, 0, -1):
            level = self.levels[depth]
            here = level.where("n = 1").select("g", "idx", "kids").join(tops, "g")
            if down is not None:
                here = here.unionByName(level.where("n > 1").select("g", "idx", "kids").join(down, ["g", "idx"]))
            # a run is an array of at most ``fanout`` hashes, so what stands before and after a child is short
            run = here.select("g", *handed, "proof", F.posexplode("kids").alias("_pos", "_kid"), F.col("kids")["h"].alias("_hs"))
            before = F.array_join(F.slice("_hs", F.lit(1), F.col("_pos")), "")
            after = F.array_join(F.slice("_hs", F.col("_pos") + 2, F.lit(self.fanout)), "")
            kid = ["idx"] if depth > 1 else ["h", *self.carried]
            step = F.array(F.struct(before.alias("before"), after.alias("after")))
            down = run.select("g", *(F.col(f"_kid.{c}").alias(c) for c in kid), *handed, F.concat(step, "proof").alias("proof"))
        alone = self.levels[0].where("n = 1").select("g", "h", *self.carried).join(tops, "g").select("g", "h", *self.carried, *handed, "proof")
        return alone if down is None else alone.unionByName(down)


def merkle_manifest(
    docs: DataFrame, carry: dict[str, Column] | None = None, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", fanout: int = 2
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``leaf``, ``subroot``, ``root`` and ``proof``, an array of (before, after) hashes.

    ``carry`` names further expressions of the input that each leaf takes along, a claimed hash to be checked for instance.
    """
    carry = carry or {}
    leaves = docs.select(
        group_key(F.col(group_col)).alias("g"), F.col(id_col).cast("long").alias("doc_id"), leaf_hash(*(F.col(c) for c in columns)).alias("h"),
        *(v.alias(f"c_{k}") for k, v in carry.items()),
    )
    leaves = materialised(leaves, "merkle-leaves")
    forest = Forest(numbered(leaves, ["doc_id", "h"], "merkle-ranges"), "merkle", fanout)
    subroots = materialised(forest.tops().select(F.lit("").alias("g"), F.col("g").alias("of"), "h"), "merkle-subroots")
    over = Forest(numbered(subroots, ["of"], "merkle-groups"), "merkle-over", fanout)
    root = over.tops().select("g", F.col("h").alias("root"), F.expr(f"cast(array() as {_STEPS})").alias("proof"))
    tops = over.leaves_with_proofs(root).select(F.col("of").alias("g"), F.col("h").alias("subroot"), "root", "proof")
    tops = materialised(tops, "merkle-tops")
    out = forest.leaves_with_proofs(tops)
    return out.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", "proof", *(F.col(f"c_{k}").alias(k) for k in carry))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def siblings(proof: Column) -> Column:
    """All hashes of a proof in order, joined."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")
