"""The pipeline's near duplicates hold to the fingerprints of operator 6."""


def test_one_document_stays_of_each_component_of_fingerprints(spark):
    import corpus_pipeline as cp

    from zonarium.llm import simhash_dedup as sh

    often = "alpha beta gamma delta epsilon zeta eta " * 60
    tails = [" ".join(f"{c}{k}" for k in range(20)) for c in "pqr"]
    texts = [often + tails[0], often + tails[1], often.upper() + tails[2], " ".join(tails), None, ""]
    docs = spark.createDataFrame([(10 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    component = {r["doc_id"]: r["component_id"] for r in sh.simhash_dedup(docs).collect()}
    assert component == {10: 10, 11: 10, 12: 10, 13: 13, 14: 14, 15: 14}
    assert sorted(r["doc_id"] for r in cp.near_duplicates(spark, docs, "").collect()) == sorted(set(component.values()))
