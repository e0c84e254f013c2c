"""Stored indexes against the scans they replace, and percentiles against sorting."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonarium.operators import quantiles, search_index, vector_index
from zonarium.operators import retrieval as r
from zonarium.operators.lookups import top_k

SF = "/root/testdata/sf0.01"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 1.0])
def test_percentiles_close_in_on_a_hot_group(spark, q):
    rng = np.random.default_rng(2)
    values = {"hot": np.concatenate([rng.normal(0, 100, 4000), np.full(3000, 7.25)]), "ties": np.repeat([1.0, 2.0], [400, 401]), "one": np.array([5.0]), "wide": 10.0 ** rng.uniform(-200, 200, 900), None: rng.integers(0, 9, 300).astype(float)}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("hot", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {x.g: (x.n, x.p) for x in quantiles.exact_percentiles(df, "g", "v", q, few=60, accuracy=500).collect()}
    assert got.pop("nothing") == (0, None) and got.keys() == values.keys()
    for g, vs in values.items():
        assert got[g][0] == len(vs) and got[g][1] == pytest.approx(float(np.quantile(vs, q)), rel=1e-9)


def test_percentiles_of_no_rows(spark):
    assert quantiles.exact_percentiles(spark.createDataFrame([], "g string, v double"), "g", "v", 0.5).count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(8)
    words = [f"palabra{k}" for k in range(60)]
    weight = 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(words, rng.integers(1, 30), p=weight / weight.sum())) for _ in range(500)] + ["", "palabra0 " * 40]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)] + [(600, None)], "id long, text string")
    questions = spark.createDataFrame([(1, "palabra0 palabra7"), (2, "palabra55"), (3, "palabra3 palabra3 palabra20 palabra41"), (4, "nada"), (5, "palabra59 palabra0 palabra1")], "qid int, question string")
    return docs, questions


@pytest.mark.parametrize("block", [4, 128])
def test_index_ranks_like_the_scan(spark, corpus, tmp_path, monkeypatch, block):
    docs, questions = corpus
    monkeypatch.setattr(search_index, "BLOCK", block)
    monkeypatch.setattr(search_index, "FIRST_PARTS", 2)
    search_index.write_index(docs, "id", "text", f"file://{tmp_path}/i")
    index = search_index.read_index(spark, f"file://{tmp_path}/i")
    found = search_index.search(index, questions, "qid", "question", 7)
    want = top_k(r.bm25(docs, questions, "id", "text", "qid", "question"), ["qid"], 7, F.desc(F.round("score", 9)), F.asc("id"))
    rows = lambda df, doc: sorted((x.qid, x["rank"], x[doc], round(x.score, 8)) for x in df.collect())
    assert rows(found, "doc") == rows(want, "id") and found.count() > 20
    few = questions.where("qid = 2")
    opened, every = search_index.opened_blocks(index, few, "question")
    assert 0 < opened < every / 10


def test_blocks_bound_their_postings(spark, corpus, tmp_path, monkeypatch):
    docs, _ = corpus
    monkeypatch.setattr(search_index, "BLOCK", 8)
    search_index.write_index(docs, "id", "text", f"file://{tmp_path}/i")
    index = search_index.read_index(spark, f"file://{tmp_path}/i")
    hot = index.terms.orderBy(F.desc("df")).first()
    blocks = index.blocks.where(F.col("term") == hot.term).collect()
    assert hot.parts >= hot.df / 8 and sum(len(b.postings) for b in blocks) == hot.df and max(len(b.postings) for b in blocks) <= 40
    for b in blocks:
        assert b.top == pytest.approx(max(p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.len / index.mean_length)) for p in b.postings))


@pytest.mark.parametrize("measure", ["dot", "l2"])
def test_all_lists_are_the_exact_search(spark, tmp_path, measure):
    rng = np.random.default_rng(6)
    vectors = [(k, [float(x) for x in rng.normal(size=6)]) for k in range(200)] + [(300 + k, [1.0] + [0.0] * 5) for k in range(120)] + [(900, None), (901, [1.0, 2.0]), (None, [0.0] * 6)]
    df = spark.createDataFrame(vectors, "id long, v array<double>")
    how = vector_index.Lists(lists=9, probes=9, salted=20)
    vector_index.write_lists(df, "id", "v", f"file://{tmp_path}/l", how)
    asked = df.where("id % 20 = 0")
    got = vector_index.search_lists(spark, f"file://{tmp_path}/l", asked, "id", "v", 4, how, measure)
    exact = r.nearest(df.where("size(v) = 6"), "id", "v", "id % 20 = 0", 4, measure)
    score = F.round("score", 9)
    want = top_k(exact, ["qid"], 4, F.asc(score) if measure == "l2" else F.desc(score), F.asc("id"))
    assert sorted((x.qid, x["rank"], x.key) for x in got.collect()) == sorted((x.qid, x["rank"], x.id) for x in want.collect())
    assert spark.read.parquet(f"file://{tmp_path}/l/vectors").count() == 320


@there
def test_recall_of_the_lists(spark):
    from zonarium.plans import catalogue

    pairs = lambda name: {(x.qid, x.vec_id) for x in catalogue.QUERIES[name](spark, SF).collect()}
    exact, found = pairs("vector_topk"), pairs("vector_lists_topk")
    assert len(found) == len(exact) and len(exact & found) >= 0.9 * len(exact)


def test_counted_terms_are_the_terms(spark):
    from zonarium.functions import text as t

    texts = ["Ñandú ÑANDÚ nandu el la más Mas DE que", "İstanbul KELVINK Ångstrom Ångstrom", "a1b2 ab abc_abcd'xyz 12 123 ß ſoße", "été été ÉTÉ \U0001d400bcd ΣΑΣ", "municipio cómo como", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, x string").select("id", "x", t.terms(F.col("x")).alias("t"))
    for row in df.collect():
        counts = t.counted_terms(row.x)
        assert sorted(row.t or []) == sorted(w for w, n in counts.items() for _ in range(n))


def test_postings_are_counted_in_their_document(spark, tmp_path, monkeypatch):
    """No table has a row for every posting; rows of one document and length count as one, and a block may cross batches."""
    monkeypatch.setattr(search_index, "BLOCK", 8)
    monkeypatch.setattr(search_index, "CHUNK", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    made = []
    keep = search_index.materialised
    monkeypatch.setattr(search_index, "materialised", lambda df, name: made.append(name) or keep(df, name))
    try:
        docs = spark.createDataFrame([(k % 90, f"comun comun palabra{k % 90}") for k in range(100)] + [(200, None), (None, "comun")], "id long, text string")
        search_index.write_index(docs, "id", "text", f"file://{tmp_path}/i")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert made == ["chunks", "terms"]
    index = search_index.read_index(spark, f"file://{tmp_path}/i")
    blocks = index.blocks.where("term = 'comun'").collect()
    got = {p.doc: (p.tf, p.len) for b in blocks for p in b.postings}
    assert index.documents == 101 and index.mean_length == 3.0 and sum(len(b.postings) for b in blocks) == 90 == len(got)
    assert got == {k: (4 if k < 10 else 2, 3) for k in range(90)} and len(blocks) > 8


def test_scores_held_at_a_time_are_bounded():
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    vectors = np.random.default_rng(4).normal(size=(10_000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(list(vectors))], ["k", "v"])
    held = SimpleNamespace(value={8: (np.arange(600), vectors[:600])})
    tracemalloc.start()
    got = [b for b in r._best_of_batch(held, 3, "dot", 9, "k")(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(b) for b in got) == 1800 and peak < 80e6
