"""The quality classifier: statistics, the discriminant against plain formulas, held-out accuracy, odd tables."""

import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonarium.llm import quality_classifier as qc
from zonarium.llm import textbatch as tb

SF = "/root/testdata/sf0.01"


def plain_statistics(text, few=20.0):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars = len(words), sum(map(len, words))
    lengths = [len(w) for w in words]
    spread = float(np.var(lengths)) if words else 0.0
    count = lambda signs: sum(text.count(c) for c in signs)
    latin = [c for c in text if "\xc0" <= c <= "\xff"]
    upper = len(re.findall("[A-Z]", text)) + sum(c <= "\xde" for c in latin)
    lower = len(re.findall("[a-z]", text)) + sum(c > "\xde" for c in latin)
    seen, inside = set(), set()
    for k in range(n - 2):
        triple = tuple(words[k : k + 3])
        if triple in seen:
            inside |= {k, k + 1, k + 2}
        seen.add(triple)
    share = lambda a, b: math.asin(math.sqrt(a / (b + few)))
    return [
        math.log1p(n), math.log((few + chars) / (few / 5 + n)), math.log1p(spread),
        share(count("#$%&*|<>=~^_+@\\{}[]"), chars), share(count(".,;:'\"()-"), chars), share(count("!?"), chars), share(count("0123456789"), chars),
        share(upper, upper + lower), share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n), share(len(inside), n),
        math.log((few / 2 + len(set(words))) / (few / 2 + n)), math.log((1 + n) / (1 + text.count("\n"))),
    ]


def test_statistics_equal_plain(spark, odd_docs):
    got = qc.with_statistics(odd_docs, 20.0).collect()
    assert len(got) == odd_docs.count()
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    for r in got:
        assert any(np.allclose(r.x, plain_statistics(t), atol=1e-9) for t in texts[r.doc_id])


def test_slices_do_not_matter():
    import pyarrow as pa

    texts = ["one Two two!", "", "ÄÖÜ äöü é", "a b c a b c a b c", "# $ %", "x\ny\nz"] * 50
    off, raw = tb.utf8(pa.array(texts))
    whole = qc.statistics(off, raw, 20.0)
    each = np.concatenate([qc.statistics(off[k : k + 2] - off[k], raw[off[k] : off[k + 1]], 20.0) for k in range(len(texts))])
    assert np.allclose(whole, each)


def test_log_odds_are_those_of_the_densities():
    rng = np.random.default_rng(5)
    d = len(qc.STATISTICS)
    x = {0: rng.normal(size=(300, d)) * 2 + 1, 1: rng.normal(size=(900, d)) @ np.triu(np.ones((d, d)))}
    how = qc.Discriminant(temper=1.0)
    model = qc.model_from({k: (float(len(v)), v.sum(0), v.T @ v) for k, v in x.items()}, how)
    both = np.concatenate([x[0], x[1]])
    z = {k: (v - both.mean(0)) / (both.std(0) + 1e-6) for k, v in x.items()}
    pooled = sum(len(v) / len(both) * np.cov(v.T, bias=True) for v in z.values())
    points = rng.normal(size=(20, d)) * 3
    want = np.zeros(20)
    for k, sign in ((0, -1), (1, 1)):
        kin = how.kin / (len(z[k]) + how.kin)
        cov = (1 - how.ridge) * ((1 - kin) * np.cov(z[k].T, bias=True) + kin * pooled) + how.ridge * np.eye(d)
        diff = (points - both.mean(0)) / (both.std(0) + 1e-6) - z[k].mean(0)
        density = -0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) - 0.5 * np.linalg.slogdet(cov)[1] + math.log(len(z[k]) / len(both))
        want += sign * density
    assert np.allclose(model.log_odds(points), want, atol=1e-8)


def test_sums_equal_numpy(spark, odd_docs):
    measured = qc.with_statistics(odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"]), 20.0)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 13)] + [(1, None), (None, 1), (2, 7), (99, 1)], "doc_id long, quality int")
    how = qc.Discriminant()
    model = qc.fit(measured, labels, how)
    use = [(r.doc_id % 2, np.array(r.x)) for r in measured.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    sums = {k: (float(sum(y == k for y, _ in use)), sum(x for y, x in use if y == k), sum(np.outer(x, x) for y, x in use if y == k)) for k in (0, 1)}
    points = np.array([x for _, x in use])
    assert np.allclose(model.log_odds(points), qc.model_from(sums, how).log_odds(points), atol=1e-6)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = qc.quality_scores(docs, labels)
    assert got.count() == docs.count()
    rows = got.where("held_out").join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in good) >= 0.98 * len(good) and sum(r.predicted for r in bad) <= 0.05 * len(bad)
    assert min(r.score for r in good) > 0 and sum(g.score > b.score for g in good for b in bad) >= 0.99 * len(good) * len(bad)
    assert all((r.score >= 0.5) == (r.predicted == 1) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_held_out_labels_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(qc.is_held_out(F.col("doc_id"), qc.Discriminant()), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in qc.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (9, 1), (12, 0), (6, 1), (8, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = qc.quality_scores(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert qc.quality_scores(no_docs, labels).count() == 0
    assert {r.score for r in qc.quality_scores(odd_docs, labels.limit(0)).collect()} == {0.5}
    one = {r.score for r in qc.quality_scores(odd_docs, labels.where("quality = 1")).collect()}
    assert len(one) == 1 and one.pop() > 0.5
