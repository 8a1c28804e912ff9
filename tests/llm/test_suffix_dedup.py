import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import ODD, empty_docs, odd_docs

from lurewatch.llm import suffix_dedup


def by_hand(docs, length):
    """(doc_id, bytes, spans, kept) by a table of every string; docs: (doc_id, text), of which equal ids have equal texts."""
    seen, out = {}, []
    for i, t in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = True
            else:
                seen[b[s : s + length]] = True
        edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        out.append((i, len(b), [tuple(map(int, e)) for e in edge.reshape(-1, 2)], bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in df.collect()), key=repr)


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus(seed, count=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé日 ") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    passages = [prose(rng, n, words) for n in (8, 14, 20, 40, 80, 300)]
    docs = []
    for i in range(count):
        parts = [prose(rng, rng.randint(0, 60), words) for _ in range(rng.randint(1, 4))]
        parts = [p + (rng.choice(passages) if rng.random() < 0.7 else "") for p in parts]
        docs.append((i * 3 % 1000, "".join(parts)))
    docs += [(2000 + i, docs[i % 9][1]) for i in range(40)]  # exact copies
    docs += [(3000 + i, passages[4][:77] + str(i) * (i % 5)) for i in range(60)]  # a line shorter than a string
    return docs


@pytest.mark.parametrize(("length", "seed"), [(100, 1), (32, 2), (255, 3)])
def test_brute_force(spark, length, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = rows_of(suffix_dedup.without_repeats(df, length))
    assert got == by_hand(docs, length) and any(r[2] for r in got)


@pytest.mark.parametrize("limits", [{"HOT_HERE": 2}, {"HOT": 3}, {"GROUP": 5}, {"CHUNK": 700}, {"CHUNK": 300, "HOT_HERE": 1, "GROUP": 9}, {"HOT_HERE": 1, "SINGLES": 40}])
def test_limits_change_nothing(spark, monkeypatch, limits):
    """Workers get the limits with the functions, which are sent by value here."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(suffix_dedup)
    for k, v in limits.items():
        monkeypatch.setattr(suffix_dedup, k, v)
    docs = corpus(7, 60) + [(5000, "ab" * 900), (5001, "a" * 1500), (5002, "b" + "a" * 400), (5003, "a" * 99), (5004, "a" * 100)]
    try:
        got = rows_of(suffix_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)))
    finally:
        cloudpickle.unregister_pickle_by_value(suffix_dedup)
    assert got == by_hand(docs, 100)


def test_odd_rows(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (None, "a b c d e f")]
    df = odd_docs(spark).selectExpr("*", "1 AS o", "2 AS d", "3 AS copies", "4 AS start")
    assert rows_of(suffix_dedup.without_repeats(df)) == by_hand(docs, 100)
    assert suffix_dedup.without_repeats(empty_docs(spark)).collect() == []


def test_repeated_rows_shared_ids_and_null_ids(spark):
    a, b = "first text of this id " * 9, "another text of the same id, longer " * 9
    docs = [(1, a), (1, a), (1, b), (1, "short"), (1, "short"), (None, a), (None, a), (None, b + "!"), (0, None), (0, None)]
    got = rows_of(suffix_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)))
    whole = lambda t: [(0, len(t))]
    assert [r[2] for r in got if r[0] is None and r[1] == len(a)] == [whole(a)] * 2 and [r for r in got if r[1] == 5] == [(1, 5, [], b"short")] * 2
    ones = [r for r in got if r[:2] == (1, len(a))]
    assert len(ones) == 2 and sum(r[2] == whole(a) for r in ones) == 1 and [r for r in got if r[0] == 0] == [(0, 0, [], b"")] * 2


def test_phrases_cover_every_string_once_and_depend_on_it_alone():
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 100, 5000).astype(np.uint8)
    ends = np.array([50, 149, 150, 2500, 2500, 5000])
    text, at, n, _ = suffix_dedup.parse(raw, ends)
    covered = sorted(s for a, k in zip(at, n, strict=True) for s in range(a, a + k))
    assert covered == [s for a, b in zip([0, *ends[:-1]], ends, strict=True) for s in range(a, b - 99)] and n.max() <= 85
    assert all((ends[t] - np.diff(np.r_[0, ends])[t] <= a) and a + k + 99 <= ends[t] for t, a, k in zip(text, at, n, strict=True))
    twice = np.r_[raw, raw]
    _, at2, n2, key2 = suffix_dedup.parse(twice, np.array([5000, 10_000]))
    assert np.array_equal(at2[at2 >= 5000] - 5000, at2[at2 < 5000]) and np.array_equal(key2[at2 >= 5000], key2[at2 < 5000]) and n2.sum() == 2 * 4901


def test_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in by_hand(docs, 100)]
    got = suffix_dedup.op12_suffix_dedup(spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want) and got.agg(F.sum("n_removed")).first()[0] > 0
