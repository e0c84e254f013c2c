"""Ranking: BM25, vectors, rank fusion, content deduplication, context packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonarium.functions import text as t
from zonarium.operators.lookups import small, top_k
from zonarium.sources.scratch import materialised

K1, B, RRF_K = 1.5, 0.75, 60
SMALL_TERMS = 5_000
#: So many scores of vectors are held at a time, whatever the batch.
CELLS = 1 << 20


def bm25(docs: DataFrame, queries: DataFrame, doc: str, text: str, query: str, question: str) -> DataFrame:
    """(query, doc, score) of every document with a query term.

    Documents are tokenised once: what is kept of each is its length and its query terms, so neither
    the statistics nor the shuffles touch the corpus again.  Up to ``SMALL_TERMS`` distinct query
    terms are tested inside the scan, more by a join.
    """
    asked = queries.select(query, F.explode(F.array_distinct(t.terms(F.col(question)))).alias("term"))
    wanted = [r["term"] for r in asked.select("term").distinct().limit(SMALL_TERMS + 1).collect()]
    few = len(wanted) <= SMALL_TERMS
    tokens = docs.select(doc, t.terms(F.col(text)).alias("_t"))
    hits = F.filter("_t", lambda w: w.isin(wanted)) if few else F.col("_t")
    kept = materialised(tokens.select(doc, F.size("_t").alias("len"), hits.alias("_t")), "tokens")
    stats = kept.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    found = kept.select(doc, "len", F.explode("_t").alias("term"))
    tf = (found if few else found.join(asked.select("term").distinct(), "term", "left_semi")).groupBy(doc, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    scored = tf.join(df, "term").join(F.broadcast(stats), F.lit(True)).withColumn("part", part)
    return scored.join(small(asked), "term").groupBy(query, doc).agg(F.sum("part").alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, key: str, vector: str, asked: str, k: int, measure: str = "dot", block: int = 1 << 15, digits: int = 9) -> DataFrame:
    """(qid, key, score) of at least the ``k`` best rows for every row that the condition ``asked`` chooses, itself left out.

    Exact: the queries are taken in blocks of about ``block`` (by hash of the key), each block is broadcast to one pass over all
    vectors, and every Arrow batch keeps its best ``k`` of a query by one matrix product; the caller ranks what is
    left.  Ties in the score rounded to ``digits`` go to the smaller key.  ``measure`` is ``dot`` (largest first) or
    ``l2``, the squared distance (smallest first).  Null vectors, and those of another length than a query, are left out.
    """
    spark = vectors.sparkSession
    every = vectors.select(F.col(key).cast("long").alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("k is not null and v is not null")
    queries = vectors.where(asked).select(F.col(key).cast("long").alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("k is not null and v is not null")
    blocks = max(1, -(-queries.count() // block))
    schema = f"qid bigint, {key} bigint, score double"
    out = spark.createDataFrame([], schema)
    for number in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == number).toPandas() if blocks > 1 else queries.toPandas()
        width, keys = mine["v"].map(len).to_numpy(int), mine["k"].to_numpy(np.int64)
        held = spark.sparkContext.broadcast({int(n): (keys[width == n], np.stack([np.asarray(v, np.float64) for v in mine["v"][width == n]])) for n in np.unique(width)})
        out = out.unionByName(every.mapInArrow(_best_of_batch(held, k, measure, digits, key), schema))
    return out


def _best_of_batch(held, k: int, measure: str, digits: int, key: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions = held.value
        for batch in batches:
            lists = batch.column(1)
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            keys, width = batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy())
            for size, (ids, vectors) in questions.items():
                rows = np.flatnonzero(width == size)
                if not len(rows):
                    continue
                here = flat[off[rows][:, None] + np.arange(size)]
                for part in np.array_split(np.arange(len(ids)), -(-len(ids) // max(1, CELLS // len(rows)))):
                    asked = vectors[part]
                    score = asked @ here.T
                    if measure == "l2":
                        score = (asked * asked).sum(1)[:, None] + (here * here).sum(1)[None, :] - 2 * score
                    rank = np.round(score if measure == "l2" else -score, digits)
                    rank[ids[part][:, None] == keys[rows][None, :]] = np.inf
                    last = np.partition(rank, min(k, rank.shape[1]) - 1, axis=1)[:, min(k, rank.shape[1]) - 1]
                    q, r = np.nonzero((rank <= last[:, None]) & np.isfinite(rank))
                    order = np.lexsort((keys[rows[r]], rank[q, r], q))
                    q, r = q[order], r[order]
                    first = np.searchsorted(q, q)
                    q, r = (x[np.arange(len(q)) - first < k] for x in (q, r))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part[q]]), pa.array(keys[rows[r]]), pa.array(score[q, r])], ["qid", key, "score"])

    return scan


def reciprocal_ranks(rankings: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """Sum over rankings (key, 1-based rank) of 1 / (k + rank)."""
    every = rankings[0].select(key, "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select(key, "rank"))
    return every.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def best_of_content(docs: DataFrame, text: str, score: Column, key: str) -> DataFrame:
    """One document (without its text) for each content signature: highest score, then smallest key; empty signatures all stay."""
    rest = [c for c in docs.columns if c != text]
    s = docs.select(*rest, t.signature(F.col(text)).alias("_s"))
    kept = s.where(F.col("_s") != "").groupBy("_s").agg(F.max_by(F.struct(*rest), F.struct(score, -F.col(key))).alias("_r")).select("_r.*")
    return kept.unionByName(s.where((F.col("_s") == "") | F.col("_s").isNull()).select(*rest))


def packed(pieces: DataFrame, by: str, rank: str, text: str, piece: int = 500, room: int = 1000) -> DataFrame:
    """Pieces cut and taken in rank order until the first that would overflow the room."""
    cut = pieces.withColumn("piece", F.concat(F.lit("- "), F.substring(text, 1, piece)))
    used = F.sum(F.length("piece")).over(W.partitionBy(by).orderBy(rank).rowsBetween(W.unboundedPreceding, 0))
    cut = cut.withColumn("used", used)
    return cut.where(F.col("used") <= room)  # lengths are positive: the first overflow ends the prefix


def relevant(hits: DataFrame, by: str, key: str) -> DataFrame:
    """Weak bests (under 3) keep three hits of 0.6 of the best, strong ones five of 0.4.

    Scores are sums whose last bits depend on the order of addition, so they are compared rounded.
    """
    h = hits.withColumn("score", F.round("score", 9)).withColumn("best", F.max(F.round("score", 9)).over(W.partitionBy(by)))
    share = F.when(F.col("best") < 3, 0.6).otherwise(0.4)
    ranked = top_k(h.where(F.col("score") >= F.round(share * F.col("best"), 9)), [by], 5, F.desc("score"), F.asc(key))
    return ranked.where(F.col("rank") <= F.when(F.col("best") < 3, 3).otherwise(5)).drop("best")
