"""Queries answered from stored indexes, and exact percentiles of zones of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonarium.operators import quantiles, search_index, vector_index
from zonarium.plans import retrieval_queries as q
from zonarium.plans.registry import Registry, table
from zonarium.sources.literals import relation
from zonarium.sources.scratch import folder

R = Registry()
C = F.col


def _searched(spark: SparkSession, sf_dir: str, questions: DataFrame, k: int) -> DataFrame:
    """Builds the index of all documents, then asks it."""
    path = folder(spark, "index")
    search_index.write_index(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    found = search_index.search(search_index.read_index(spark, path), questions, "qid", "question", k)
    return found.select("qid", C("doc").alias("doc_id"), "rank", F.round("score", 3).alias("score"))


@R.add(q.R.sql["bm25_topk"])
def indexed_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking of ``bm25_topk`` from a stored index."""
    return _searched(spark, sf_dir, relation(spark, q.QUESTIONS, ("qid", "question")), 10)


@R.add(q.R.sql["bm25_benchmark_topk"])
def indexed_benchmark_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking of ``bm25_benchmark_topk`` from a stored index."""
    questions = table(spark, sf_dir, "benchmark").where("item_id % 10 = 0").select(C("item_id").alias("qid"), C("text").alias("question"))
    return _searched(spark, sf_dir, questions, 5)


@R.add()
def vector_lists_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every id divisible by 20, from inverted lists over all rows; recall is tested against ``vector_topk``."""
    e, path = table(spark, sf_dir, "embeddings"), folder(spark, "lists")
    vector_index.write_lists(e, "vec_id", "embedding", path)
    found = vector_index.search_lists(spark, path, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)
    return found.select("qid", C("key").alias("vec_id"), "rank", F.round("score", 4).alias("score"))


@R.add(
    """WITH z AS (SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'hot' WHEN l_suppkey % 3 = 1 THEN 'z' || l_suppkey % 7 END AS zone, l_extendedprice AS v, l_quantity AS w FROM lineitem)
    SELECT zone, count(v) AS n, round(quantile_cont(v, 0.9), 4) AS p90, round(quantile_cont(w, 0.5), 4) AS median FROM z GROUP BY zone"""
)
def exact_zone_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of zones, one of which holds a third of all rows, by brackets that close in."""
    k = C("l_suppkey")
    z = table(spark, sf_dir, "lineitem").select(F.when(k % 3 == 0, "hot").when(k % 3 == 1, F.concat(F.lit("z"), (k % 7).cast("string"))).alias("zone"), C("l_extendedprice").alias("v"), C("l_quantity").alias("w"))
    high = quantiles.exact_percentiles(z, "zone", "v", 0.9)
    middle = quantiles.exact_percentiles(z, "zone", "w", 0.5).select(C("zone").alias("_z"), C("p").alias("m"))
    return high.join(middle, high["zone"].eqNullSafe(C("_z"))).select("zone", "n", F.round("p", 4).alias("p90"), F.round("m", 4).alias("median"))
