from collections import Counter

from test_ops import components

import corpus_pipeline
from lurewatch.llm import packing, quality_classifier, quality_rules, secret_scan


def test_stages_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_classifier.fit(quality_classifier.training_rows(spark, sf_dir))
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, sf_dir)
    sizes = quality_classifier._Sizes(model.good, model.bad)
    want = {r["doc_id"] for r in docs.collect() if sum(w * x for w, x in zip(model.weights, sizes.features(r["text"]), strict=True)) >= 0}
    assert {r["doc_id"] for r in good.collect()} == want and good.columns == docs.columns
    ruled = stages[1](spark, good, sf_dir)
    kept = {r["doc_id"] for r in quality_rules.verdicts(docs).select("doc_id", "kept").collect() if r["kept"]}
    assert {r["doc_id"] for r in ruled.collect()} == want & kept and ruled.columns == docs.columns
    one = stages[2](spark, ruled, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in ruled.collect()}
    first, _ = components(texts, 5, 80)
    assert one.columns == docs.columns and Counter(r["doc_id"] for r in one.collect()) == Counter(i for i in texts if first[i] == i)
    clean = stages[3](spark, one, sf_dir)
    assert clean.columns == docs.columns and clean.count() == one.count()
    left = secret_scan.scan(clean).selectExpr("inline(secrets)").filter("class = 'live'").count()
    assert left == 0
    places = stages[4](spark, clean, sf_dir)
    left = {r["doc_id"]: r for r in clean.collect()}
    tokens, filled, met = Counter(), Counter(), set()
    for r in places.collect():
        assert r["offset"] >= 0 and r["offset"] + r["n_tokens"] <= packing.CAPACITY and r["start"] == r["piece"] * packing.CAPACITY
        tokens[r["doc_id"]] += r["n_tokens"]
        filled[r["bin"]] += r["n_tokens"]
        key = (r["bin"], left[r["doc_id"]]["source"])
        assert key not in met
        met.add(key)
    library = packing.Encoder(packing.ranks()).of
    assert dict(tokens) == {i: len(library.encode_ordinary(r["text"] or "")) for i, r in left.items()} and max(filled.values()) <= packing.CAPACITY


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
