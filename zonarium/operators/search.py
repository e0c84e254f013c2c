"""Search over two corpora: lexical and vector legs fused, and retrieval that widens until the law itself is among the hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonarium.functions import text as t
from zonarium.functions.models import rerank
from zonarium.operators.lookups import top_k
from zonarium.operators.retrieval import RRF_K, bm25

# The lead of a municipal hit, how many of the fused hits a model sees, and the weights of sources and of the article asked for.
MUNICIPAL_LEAD, TOPIC_WEIGHT, RERANKED = 0.5, 1.5, 10
SOURCE_WEIGHTS = {"ley 2/2016": 1.15, "decreto 143/2016": 0.9}
ARTICLE_WEIGHT = 1.2
FIRST_POOL, WIDE_POOL, SHOWN = 8, 128, 6

C = F.col


def unified_search(corpora: dict[str, DataFrame], questions: DataFrame, near: DataFrame | None = None, k: int = 10, shown: int = 6, score: Callable | None = None) -> DataFrame:
    """(qid, rank, key, scope, score, fused) of the fragments shown for each question.

    ``corpora`` maps a scope to fragments (key, text), ``questions`` has qid and question, ``near`` the vector leg (qid, key,
    position from 1).  Each scope is ranked by BM25 on the expanded question, municipal hits lead by a little, equal contents
    count once, topic words add, and the order is fused with the vector leg by reciprocal ranks; with ``score`` a
    model reorders the first ten.  Every step is keyed by the question.
    """
    asked = questions.select("qid", t.expanded(C("question")).alias("question"))
    every: DataFrame | None = None
    texts: DataFrame | None = None
    for scope, fragments in corpora.items():
        hits = top_k(bm25(fragments, asked, "key", "text", "qid", "question"), ["qid"], k, F.desc("score"), F.asc("key"))
        lead = MUNICIPAL_LEAD if scope == "municipal" else 0.0
        one = hits.select("qid", "key", F.lit(scope).alias("scope"), (F.round("score", 9) + lead).alias("score"))
        every = one if every is None else every.unionByName(one)
        own = fragments.select("key", "text", F.lit(scope).alias("scope"))
        texts = own if texts is None else texts.unionByName(own)
    named = every.join(texts, ["key", "scope"]).withColumn("_s", t.signature(C("text")))
    first = F.row_number().over(W.partitionBy("qid", "_s").orderBy(F.desc("score"), "key"))
    unique = named.withColumn("_n", first).where((C("_n") == 1) | (C("_s") == "")).drop("_n", "_s")
    boosted = unique.join(questions, "qid").withColumn("score", C("score") + TOPIC_WEIGHT * t.topic_hits(C("question"), C("text")))
    found = boosted.select("qid", "key", "scope", "score", "text", F.lit(0).alias("late"), F.lit(0).alias("position"))
    if near is not None:
        known = found.select("qid", "key")
        late = near.join(known, ["qid", "key"], "left_anti").join(texts, "key").select("qid", "key", "scope", F.lit(0.0).alias("score"), "text", F.lit(1).alias("late"), "position")
        found = found.unionByName(late)
    place = F.row_number().over(W.partitionBy("qid").orderBy("late", F.desc("score"), "position", "key"))
    ranked = found.withColumn("place", place)
    fused = 1.0 / (RRF_K + C("place"))
    if near is not None:
        ranked = ranked.drop("position").join(near.select("qid", "key", C("position").alias("seen")), ["qid", "key"], "left")
        fused = fused + F.coalesce(1.0 / (RRF_K + C("seen")), F.lit(0.0))
        order = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("fused"), "place"))
    else:
        order = C("place")
    ordered = ranked.withColumn("fused", F.round(fused, 9)).withColumn("rank", order)
    if score is not None:
        pairs = ordered.where(C("rank") <= RERANKED).join(questions, "qid")
        judged = rerank(pairs.withColumn("text", F.substring("text", 1, 1200)), "question", "text", score)
        again = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("rerank"), "rank"))
        best = judged.withColumn("again", again).drop("rank", "question", "rerank").withColumnRenamed("again", "rank")
        ordered = best.unionByName(ordered.where(C("rank") > RERANKED).select(*best.columns))
    return ordered.where(C("rank") <= shown).select("qid", "rank", "key", "scope", F.round("score", 6).alias("score"), "fused")


def source_weight(source: Column, article: Column, wanted: Column) -> Column:
    """What a fragment's score is multiplied by: its source's weight, and more for the article asked for."""
    low, w = F.lower(F.coalesce(source, F.lit(""))), F.lit(1.0)
    for name, factor in reversed(SOURCE_WEIGHTS.items()):
        w = F.when(low.contains(name), F.lit(factor)).otherwise(w)
    return w * F.when(article == wanted, F.lit(ARTICLE_WEIGHT)).otherwise(F.lit(1.0))


def staged_retrieval(hits: DataFrame, fragments: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, rank, key, weighted, attempt) of the six fragments of the first attempt that has the law among them.

    ``hits`` has qid, key, position (from 1, as far as the wide pool) and score, ``fragments`` key, kind, source, article and
    size, ``questions`` qid and wanted (an article's number or null).  Attempt 1 is the first pool, with the wanted article of the law added if
    it is not there; 2 the wide pool; 3 the wanted article of the law, by size; if none has the law, the first stands.
    """
    f = fragments.withColumn("article", F.regexp_extract("article", r"(\d+)", 1))
    q = questions.select("qid", "wanted")
    scored = hits.join(f, "key").join(q, "qid").withColumn("weighted", C("score") * source_weight(C("source"), C("article"), C("wanted")))
    law = C("kind") == "ley"
    exact = f.where(law).join(F.broadcast(q.where("wanted is not null")), C("article") == C("wanted"))
    best_exact = top_k(exact, ["qid"], SHOWN, F.desc("size"), F.asc("key")).drop("rank")
    first = scored.where(C("position") <= FIRST_POOL)
    has = first.where(law & (C("article") == C("wanted"))).select("qid").distinct()
    missing = best_exact.join(has, "qid", "left_anti").join(first.select("qid", "key"), ["qid", "key"], "left_anti")
    seen = hits.select("qid", "key", C("score").alias("_score"))
    added = missing.join(seen, ["qid", "key"], "left").withColumn("weighted", F.coalesce("_score", F.lit(0.0)) * source_weight(C("source"), C("article"), C("wanted")))
    one = first.select("qid", "key", "kind", "size", "weighted", F.lit(1).alias("attempt")).unionByName(added.select("qid", "key", "kind", "size", "weighted", F.lit(1).alias("attempt")))
    two = scored.where(C("position") <= WIDE_POOL).select("qid", "key", "kind", "size", "weighted", F.lit(2).alias("attempt"))
    three = best_exact.select("qid", "key", "kind", "size", F.lit(0.0).alias("weighted"), F.lit(3).alias("attempt"))
    every = one.unionByName(two).unionByName(three)
    cut = top_k(every, ["qid", "attempt"], SHOWN, F.desc("weighted"), F.desc("size"), F.asc("key"))
    lawful = cut.groupBy("qid").agg(F.coalesce(F.min(F.when(law, C("attempt"))), F.lit(1)).alias("attempt"))
    return cut.join(lawful, ["qid", "attempt"]).select("qid", "rank", "key", F.round("weighted", 6).alias("weighted"), "attempt")


def fixed_fragments(fragments: DataFrame, ordinance: str, area: str) -> DataFrame:
    """Fragments with what is known for certain in front: the ordinance's sheet at 99, the area's at 98, each if there is one."""
    certain = [(ordinance, "ordenanza", 99.0), (area, "ambito", 98.0)]
    out = fragments.select("qid", F.lit("fragmento").alias("kind"), "text", C("score").cast("double").alias("score"))
    for column, kind, points in certain:
        sheet = fragments.where(C(column).isNotNull() & (C(column) != "")).select("qid", F.lit(kind).alias("kind"), C(column).alias("text"), F.lit(points).alias("score"))
        out = out.unionByName(sheet.distinct())
    return out
