"""A vector index of inverted lists: centres fitted on a bounded sample, every vector in the list of its nearest centre.

A search looks into the lists of the nearest centres of each question.  The index is a table sorted by list; a list
that holds more than its share is shared out over salts, to each of which the questions are sent, so a third of all
vectors in one place is many tasks.  How many lists are looked into is fitted with the centres: as many as hold the wanted
share of the nearest neighbours that sample vectors have among the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonarium.operators.lookups import small, top_k
from zonarium.operators.retrieval import CELLS


@dataclass(frozen=True)
class Lists:
    """Parameters: how many lists, how many vectors the centres are fitted on, rounds of fitting, vectors a salt; how many lists are
    looked into, or the recall for which that is fitted with so many sample questions for so many neighbours each."""

    lists: int = 64
    sample: int = 20_000
    rounds: int = 8
    probes: int | None = None
    recall: float = 0.95
    asked: int = 1_000
    neighbours: int = 10
    salted: int = 200_000
    digits: int = 9


def fitted_centres(vectors: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Centres by Lloyd's rounds from spread-out rows: each next one is a row far from those chosen."""
    rng = np.random.default_rng(11)
    if len(vectors) <= lists:
        return np.unique(vectors, axis=0)
    chosen = [vectors[rng.integers(len(vectors))]]
    gap = ((vectors - chosen[0]) ** 2).sum(axis=1)
    for _ in range(1, lists):
        if not gap.sum():
            break
        chosen.append(vectors[rng.choice(len(vectors), p=gap / gap.sum())])
        gap = np.minimum(gap, ((vectors - chosen[-1]) ** 2).sum(axis=1))
    centres = np.array(chosen)
    for _ in range(rounds):
        near = _nearest(vectors, centres, 1)[:, 0]
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _nearest(vectors: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest centres of each vector, nearest first."""
    apart = (centres * centres).sum(axis=1) - 2 * vectors @ centres.T
    return np.argsort(apart, axis=1, kind="stable")[:, :k]


def fitted_probes(vectors: np.ndarray, centres: np.ndarray, how: Lists) -> int:
    """Lists that the nearest centres' order must reach for the wanted share of neighbours by dot product and by distance, whichever needs more."""
    some = np.random.default_rng(12).permutation(len(vectors))[: how.asked]
    home = _nearest(vectors, centres, 1)[:, 0]
    order = np.argsort(_nearest(vectors[some], centres, len(centres)), axis=1)  # by list: its place
    needed = 1
    for norm in (0.0, 1.0):
        at = []
        for part in np.array_split(np.arange(len(some)), max(1, len(some) * len(vectors) // (1 << 22))):
            score = norm * (vectors * vectors).sum(axis=1) - (1 + norm) * vectors[some[part]] @ vectors.T
            score[np.arange(len(part)), some[part]] = np.inf
            near = np.argpartition(score, min(how.neighbours, len(vectors) - 1) - 1, axis=1)[:, : how.neighbours]
            at.append(np.take_along_axis(order[part], home[near], axis=1).ravel())
        needed = max(needed, int(np.quantile(np.concatenate(at), how.recall, method="higher")) + 1)
    return needed


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, width)


def write_lists(vectors: DataFrame, key: str, vector: str, path: str, how: Lists | None = None) -> None:
    """Builds the index of all vectors below ``path``; null vectors and those of another width than the sample's are left out."""
    how = how or Lists()
    every = vectors.select(F.col(key).cast("long").alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("key is not null and v is not null and size(v) > 0")
    some = every.orderBy(F.xxhash64("key"), "key").limit(how.sample).toPandas()["v"]
    width = int(np.bincount([len(v) for v in some]).argmax()) if len(some) else 0
    centres = fitted_centres(np.array([v for v in some if len(v) == width]).reshape(-1, max(width, 1)), how.lists, how.rounds)
    known = np.array([v for v in some if len(v) == width]).reshape(-1, max(width, 1))
    probes = how.probes or (fitted_probes(known, centres, how) if len(known) > 1 else 1)
    spark = vectors.sparkSession
    spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.parquet(f"{path}/probes")
    spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = _nearest(_matrix(b.column(1), width), centres, 1)[:, 0] if len(b) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *b.columns], ["list", "key", "v"])

    filed = every.where(F.size("v") == width).mapInArrow(file, "list int, key bigint, v array<double>")
    filed.repartitionByRange("list", "key").sortWithinPartitions("list", "key").write.parquet(f"{path}/vectors")


def search_lists(spark: SparkSession, path: str, questions: DataFrame, qid: str, vector: str, k: int, how: Lists | None = None, measure: str = "dot") -> DataFrame:
    """(qid, key, rank, score): the best ``k`` of the vectors in the lists probed, the question's own key left out.

    ``measure`` is ``dot`` (largest first) or ``l2`` (smallest first); ties of the rounded score go to the smaller key.
    """
    how = how or Lists()
    stored = spark.read.parquet(f"{path}/centres").orderBy("list").toPandas()
    centres = np.array(stored["centre"].tolist())
    width = centres.shape[1] if len(centres) else 0
    probes = how.probes or spark.read.parquet(f"{path}/probes").first()["probes"]
    filed = spark.read.parquet(f"{path}/vectors")
    sizes = filed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / how.salted).cast("int").alias("salts"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = _nearest(_matrix(b.column(1), width), centres, probes) if len(b) else np.zeros((0, 1), int)
            row = np.repeat(np.arange(len(b)), near.shape[1])
            got = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), *got.columns], ["list", "qid", "q"])

    asked = questions.select(F.col(qid).cast("long").alias("qid"), F.transform(vector, lambda x: x.cast("double")).alias("q")).where(F.col("qid").isNotNull() & (F.size("q") == width))
    probing = asked.mapInArrow(probe, "list int, qid bigint, q array<double>").join(small(sizes), "list")
    probing = probing.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    dealt = filed.join(small(sizes), "list").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int")).drop("salts")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v = (_matrix(x.column(c).combine_chunks(), width) for x, c in ((left, "q"), (right, "v")))
        ids, keys = left.column("qid").to_numpy(), right.column("key").to_numpy()
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for part in np.array_split(np.arange(len(ids)), max(1, -(-len(ids) * len(keys) // CELLS))):
            if not len(part) or not len(keys):
                continue
            score = q[part] @ v.T
            if measure == "l2":
                score = (q[part] ** 2).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * score
            rank = np.round(score if measure == "l2" else -score, how.digits)
            rank[ids[part][:, None] == keys[None, :]] = np.inf
            most = min(k, rank.shape[1])
            last = np.partition(rank, most - 1, axis=1)[:, most - 1 :][:, :1]
            a, b = np.nonzero((rank <= last) & np.isfinite(rank))
            order = np.lexsort((keys[b], rank[a, b], a))
            a, b = a[order], b[order]
            a, b = (x[np.arange(len(order)) - np.searchsorted(a, a) < k] for x in (a, b))
            out.append((ids[part][a], keys[b], score[a, b]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["qid", "key", "score"])

    by = ["list", "salt"]
    met = probing.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(meet, "qid bigint, key bigint, score double")
    rank = F.round("score", how.digits)
    return top_k(met, ["qid"], k, F.asc(rank) if measure == "l2" else F.desc(rank), F.asc("key")).select("qid", "key", "rank", "score")
