"""Stages of the pipeline, and operators at their edges: odd and empty tables, names that clash, values too large."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import ODD, empty_docs, odd_docs

import corpus_pipeline
from lurewatch.llm import exact_topk, packing, secret_scan, toxicity, url_filter

HELPERS = ("_hidden", "_hide", "row", "hidden", "secrets", "place", "copy", "_row", "_score", "_key", "kept", "cluster", "n_tokens", "piece", "g")


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_and_empty_tables(spark, sf_dir, k):
    stage = corpus_pipeline.STAGES[k][1]
    docs = odd_docs(spark).unionAll(odd_docs(spark)).withColumns({c: F.lit(7) for c in HELPERS})
    out, none = stage(spark, docs, sf_dir), stage(spark, empty_docs(spark), sf_dir)
    assert none.count() == 0
    if k < 4:
        assert out.columns == docs.columns and none.columns == empty_docs(spark).columns
        rows = out.collect()
        assert all(r[c] == 7 for r in rows for c in HELPERS)
        if k == 3:
            assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    else:
        assert out.agg(F.sum("n_tokens")).first()[0] > 0


def test_run_of_empty_tables(spark, sf_dir, tmp_path):
    empty_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_an_id_are_packed_in_groups(spark):
    n = 12_000
    df = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("one two "), F.col("id").cast("string")).alias("text"), (F.col("id") % 300).cast("string").alias("source"))
    out = packing.pack(df.repartition(5))
    groups = [r["count"] for r in out.groupBy(F.shiftright("bin", 32).alias("g")).count().collect()]
    assert sum(groups) == n and max(groups) <= 1.1 * packing.GROUP


def test_hidden_secrets_keep_a_column_of_that_name(spark):
    df = spark.createDataFrame([(1, "password = abcdefgh12345678", 3, "mine"), (2, "plain", 5, "mine")], "doc_id long, text string, n_chars long, _hidden string").withColumn("source", F.lit("s"))
    got = {r["doc_id"]: r for r in secret_scan.hide_live_secrets(spark, df, "").collect()}
    assert got[1]["_hidden"] == "mine" and got[1]["text"] == "<SECRET>" and got[1]["n_chars"] == len(got[1]["text"]) and (got[2]["text"], got[2]["n_chars"]) == ("plain", 5)


def test_copies_of_a_text_are_one_owner(spark):
    key, other = "token = a1b2c3d4e5f6g7h8", "token = zz99yy88xx77ww66"
    rows = [(i, f"once {key}", f"s{i}") for i in range(5)] + [(10 + i, f"text {i} {other}", f"s{i}") for i in range(5)]
    got = {r["doc_id"]: r["secrets"][0] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), one_of_copies=True).collect()}
    assert all(got[i]["class"] == "live" and got[i]["n_owners"] == 1 for i in range(5)) and all(got[10 + i]["class"] == "example" for i in range(5))


def test_url_filter_without_labelled_rows(spark):
    model = url_filter.fit(spark.createDataFrame([(None, 1.0), ("http://a.b/", None)], "url string, label double"))
    pages = spark.createDataFrame([(1, "https://some.net/es/x"), (2, "https://else.org/"), (3, None)], "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["block_probability"]) for r in url_filter.judge(pages, model).collect()}
    assert model is None and got == {1: ("block", 0.0), 2: ("allow", 0.0), 3: ("allow", 0.0)}


@pytest.mark.parametrize("vector", [[1e30, 0.0], [0.5] * 2_048])
def test_vectors_too_large_for_exact_products_are_refused(spark, vector):
    df = spark.createDataFrame([(0, vector), (50, [0.5] * len(vector))], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        exact_topk.top_k(df, F.col("vec_id") % 50 == 0).collect()


def test_largest_allowed_vectors_are_exact(spark):
    x = float(np.float32(262_143.9))
    df = spark.createDataFrame([(i, [x if (i + j) % 3 else -x for j in range(2_047)]) for i in range(3)], "vec_id long, embedding array<float>")
    q = [[int(np.floor(256 * (x if (i + j) % 3 else -x))) for j in range(2_047)] for i in range(3)]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in exact_topk.top_k(df, F.col("vec_id") == 0).collect()}
    assert got == {(0, i): sum(a * b for a, b in zip(q[0], q[i], strict=True)) for i in (1, 2)}


def test_toxicity_is_its_formula(spark, sf_dir):
    model = toxicity.fit(toxicity.training_rows(spark, sf_dir))
    got = {r["doc_id"]: r for r in toxicity.op6_toxicity(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        z = sum(model.weights.get(k, 0.0) * v for k, v in toxicity.features(r["text"] or "").items())
        above = [1 / (1 + np.exp(-np.clip(z - t, -30, 30))) for t in model.thresholds]
        each = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
        mine = got[r["doc_id"]]
        assert np.isclose(mine["severity"], sum(k * p for k, p in enumerate(each))) and np.isclose(mine["p_toxic"], above[0])
        assert each[mine["grade"]] >= max(each) - 1e-12 and mine["toxic"] == (mine["p_toxic"] >= toxicity.CUT)


def test_odd_texts_reach_every_stage():
    assert None in ODD and "" in ODD and any(len(t or "") > 50_000 for t in ODD)
