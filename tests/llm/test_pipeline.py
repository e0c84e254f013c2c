"""Mixing and the pipeline."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonarium.llm import mixing as mx

SF = "/root/testdata/sf0.01"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def mixed_docs(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for k in range(600):
        kind = k % 3
        words = [f"w{x}" for x in rng.integers(0, 60, 80)]
        if kind == 1:
            words = ["spam###"] * 60 + words[:20]
        if kind == 2:
            words[::9] = ["nasty", "vile", "awful", "nasty", "vile", "awful", "nasty", "vile", "awful"]
        rows.append((k, " ".join(words), f"s{k % 4}", 1.0))
        if k % 2 == 0:
            labels.append((k, int(kind != 1), int(kind == 2)))
    rows += [(None, None, None, None), (9000, "", "s0", 0.0), (9000, "", "s0", 0.0)]
    labels += [(None, 1, 0), (77777, 1, 1), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, rate double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_posteriors_and_targets(spark):
    docs, labels = mixed_docs(spark)
    mix = mx.Mix(weights={"clean": 0.6, "low": 0.3, "toxic": 0.1})
    out = mx.mix_sources(docs, labels, mix).toPandas()
    assert len(out) == docs.count() and (out["rate"] >= 0).all()
    known = out[out["doc_id"].between(0, 599)]
    kind = known["doc_id"].astype(int) % 3
    assert (known["p_clean"][kind == 0] > 0.9).mean() > 0.95
    assert (known["p_low"][kind == 1] > 0.9).mean() > 0.95 and (known["p_toxic"][kind == 2] > 0.9).mean() > 0.95
    total = out["n_tokens"].sum()
    for d, w in mix.weights.items():
        assert (out["expected_tokens"] * out[f"p_{d}"]).sum() == pytest.approx(w * total, abs=0.005 * total)


def test_rates_are_the_projected_gradient(spark):
    p = [(1000, [1.0, 0.0, 0.0]), (500, [0.5, 0.5, 0.0]), (300, [0.0, 0.2, 0.8]), (300, [0.0, 0.2, 0.8])]
    mix = mx.Mix(weights={"clean": 0.8, "low": 0.2, "toxic": 0.0}, tolerance=1e-6, rounds=80)
    members = spark.createDataFrame(p, "n_tokens long, p array<double>")
    steps, target, _ = mx.fit_rates(members, mix)
    got = [r["r"] for r in members.select(mx.rate(F.col("p"), steps).alias("r")).collect()]
    n, q = np.array([x for x, _ in p], float), np.array([y for _, y in p])
    w = np.linalg.inv((q * n[:, None]).T @ q + 1e-9 * ((q * n[:, None]).T @ q).max() * np.eye(3))
    r = np.ones(4)
    for _ in range(len(steps)):
        r = np.maximum(0, r - q @ (w @ ((r * n) @ q - np.array(target))))
    assert got == pytest.approx(r.tolist(), abs=1e-6) and got[2] == got[3]


def test_kept_columns_and_domains_left_out(spark):
    """The text and columns of any name pass through; what is left out is gone before the rates are fitted."""
    docs, labels = mixed_docs(spark)
    odd = docs.select("*", *(F.lit(n).alias(n) for n in ("f", "p", "_w", "_kept", "n_tokens")))
    mix = mx.Mix(weights={"clean": 0.6, "low": 0.4, "toxic": 0.0}, leave_out={"toxic": 0.5})
    out = mx.mix_sources(odd, labels, mix, keep=tuple(odd.columns))
    rows = out.collect()
    assert set(odd.columns) <= set(out.columns) and len(out.columns) == len(set(out.columns))
    assert {(r["f"], r["p"], r["_w"], r["_kept"]) for r in rows} == {("f", "p", "_w", "_kept")}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in rows) and all(r["p_toxic"] < 0.5 for r in rows)
    assert {k for k in range(600) if k % 3 != 2} - {r["doc_id"] for r in rows} == set()
    total = sum(r["n_tokens"] for r in rows)
    reached = [sum(r["expected_tokens"] * r[f"p_{d}"] for r in rows) / total for d in mx.DOMAINS]
    worst = max(abs(x - mix.weights[d]) for x, d in zip(reached, mx.DOMAINS, strict=True))
    assert worst < 0.02 and all(r["target_miss"] == pytest.approx(worst, abs=0.002) for r in rows)


def test_every_posterior_adds_up_to_one(spark):
    docs, labels = mixed_docs(spark)
    for r in mx.mix_sources(docs, labels).collect():
        assert r["p_clean"] + r["p_low"] + r["p_toxic"] == pytest.approx(1, abs=1e-9) and min(r["p_clean"], r["p_low"], r["p_toxic"]) >= 0


def test_nothing_to_mix(spark):
    docs, labels = mixed_docs(spark)
    assert mx.mix_sources(docs.limit(0), labels).collect() == []
    flat = mx.mix_sources(docs, labels.limit(0)).select("p_clean", "p_low", "p_toxic").distinct().collect()
    assert len(flat) == 1 and list(flat[0]) == pytest.approx([1 / 3] * 3, abs=0.005)


@there
def test_held_out_toxic_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    model_labels = labels.where("doc_id % 3 <> 0")
    out = mx.mix_sources(docs, model_labels).join(labels.where("doc_id % 3 = 0 and quality = 1"), "doc_id")
    r = out.agg(F.avg(F.when(F.col("toxic") == 1, (F.col("p_toxic") >= 0.5).cast("int"))).alias("caught"), F.avg(F.when(F.col("toxic") == 0, (F.col("p_toxic") >= 0.5).cast("int"))).alias("wrong")).first()
    assert r["caught"] > 0.85 and r["wrong"] < 0.02


@there
def test_pipeline_stages_agree_with_the_operators(spark):
    import corpus_pipeline as cp

    from zonarium.llm import decontaminate as dc
    from zonarium.llm import near_copies as nc
    from zonarium.llm import quality_rules as qr
    from zonarium.llm import secret_scan as ss
    from zonarium.llm import simhash_dedup as sh

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    kept = sh.written(cp.STAGES[0][1](spark, docs, SF), "t")
    assert kept.columns == columns and ids(kept) == ids(qr.quality_rules(docs).where("kept"))
    single = sh.written(cp.STAGES[1][1](spark, kept, SF), "t")
    marked, links = nc.near_copy_links(kept)
    kind = {r["doc_id"]: r["kind"] for r in marked.collect()}
    stays = set(ids(single))
    assert single.columns == columns and len({kind[i] for i in stays}) == len(stays)
    assert all(len({a, b} & {kind[i] for i in stays}) < 2 for a, b in links.collect())
    clean = sh.written(cp.STAGES[2][1](spark, single, SF), "t")
    leaked = set(ids(dc.contaminated(single, bench)))
    assert clean.columns == columns and leaked and ids(clean) == [i for i in ids(single) if i not in leaked]
    safe = sh.written(cp.STAGES[3][1](spark, clean, SF), "t")
    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    net = ss.default_network()
    for r in safe.collect():
        found = ss.find([before[r["doc_id"]]], net)[0]
        assert r["text"] == ss.redacted(before[r["doc_id"]], found) and not ss.base_findings(r["text"]) and (not found or r["n_chars"] == len(r["text"]))
    last = cp.STAGES[4][1](spark, safe, SF)
    assert set(columns) <= set(last.columns) and {"rate", "target_miss"} <= set(last.columns)
    texts = {r["doc_id"]: r["text"] for r in safe.collect()}
    assert all(r["text"] == texts[r["doc_id"]] and r["p_toxic"] < 0.5 for r in last.collect())
    assert set(ids(last)) <= set(ids(safe)) and ids(cp.run(spark, SF)) == ids(last)


def test_no_telling_feature_is_lost(spark):
    """Every chosen feature counts, whichever bits its code shares with another's."""
    rng = np.random.default_rng(5)
    codes = rng.integers(-(2**63), 2**63, 2_000).tolist()
    codes += [c ^ (1 << 60) for c in codes[:20]]
    weights = {c: [round(0.5 + k / 1000, 3), -1.0] for k, c in enumerate(codes)}
    df = spark.createDataFrame([(c, [c, c ^ 1]) for c in codes], "c long, f array<long>")
    got = df.select("c", mx.Classifier(weights, []).evidence(F.col("f")).alias("e")).collect()
    assert {r["c"]: r["e"] for r in got} == weights


def test_every_stage_takes_odd_tables(spark, odd_docs, no_docs, tmp_path):
    """Nulls, repeated rows and ids, long texts, clashing names and empty tables, stage by stage."""
    import corpus_pipeline as cp

    odd_docs.limit(0).select(F.col("doc_id").alias("item_id"), "text").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    odd_docs.limit(0).select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(str(tmp_path / "none" / "labels.parquet"))
    some = odd_docs.where("doc_id in (1, 6) or doc_id is null").select(F.col("doc_id").alias("item_id"), "text")
    some.write.parquet(str(tmp_path / "some" / "benchmark.parquet"))
    odd_docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic")).write.parquet(str(tmp_path / "some" / "labels.parquet"))
    rows = {name: {kind: f(spark, docs, str(tmp_path / sf)) for kind, docs, sf in (("odd", odd_docs, "some"), ("bare", odd_docs, "none"), ("none", no_docs, "some"))} for name, f in cp.STAGES}
    for name, kinds in rows.items():
        assert kinds["none"].collect() == []
        if name != "mixing":
            assert all(df.columns == odd_docs.columns for df in kinds.values())
    count = {name: (len(kinds["odd"].collect()), len(kinds["bare"].collect())) for name, kinds in rows.items()}
    total = odd_docs.count()
    assert count["secret scans"] == (total, total) and count["mixing"][1] == total and count["decontamination"][1] == total
    assert 0 < count["quality rules"][0] < total and 0 < count["near duplicates"][0] < total and 0 < count["decontamination"][0] < total
