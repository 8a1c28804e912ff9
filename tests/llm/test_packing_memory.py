"""What a worker keeps between tasks of near-duplicates and packing, and the steps of their components."""

import tracemalloc

import numpy as np
import pytest

from lurewatch.llm import graph, near_dedup, tokens


def test_hashing_keeps_little():
    rng = np.random.default_rng(5)
    tracemalloc.start()
    try:
        for size in (1 << 21, 1 << 20, 3 << 17, 1000):
            near_dedup.word_hashes(rng.integers(32, 120, size).astype(np.uint8), np.array([size]))
        assert tracemalloc.get_traced_memory()[0] < 20 << 20
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize(("bits", "most"), [(2, 40), (5, 1 << 17), (20, 1 << 17)])
def test_counts_whatever_the_table_forgets(monkeypatch, bits, most):
    monkeypatch.setattr(tokens, "PLACE_BITS", bits)
    monkeypatch.setattr(tokens, "COUNTED", most)
    rng = np.random.default_rng(6)
    texts = ["", None, "a" * 300, " \n\n\t x  y", "don't 123 été 　 z", "\ud800 q", "b" * 65 + " " + "b" * 66]
    texts += [" ".join(f"w{i}{'x' * (i % 70)}" for i in rng.integers(0, 80, 60)) for _ in range(30)]
    encoder, want = tokens.Encoder(tokens.ranks()), [len(x) // 2 for x in tokens.Encoder(tokens.ranks()).encode(texts)]
    assert encoder.count(texts) == want and encoder.count(texts[::-1]) == want[::-1]
    assert len(encoder.known) == 1 << bits and not len(encoder.pool)


def test_stars_need_no_round_and_least_values_few_rows(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "materialize", lambda df, name, f=graph.materialize: written.append(name) or f(df, name))
    stars = [(k, 100 * k + i) for k in range(1, 5) for i in range(1, 8)]
    got = {tuple(r) for r in graph.connected_components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {(b, a) for a, b in stars} | {(a, a) for a, _ in stars} and len(written) == 1
    chain = [(i + 1, i) for i in range(40)] + [(500, 7), (500, 501), (None, 3), (9, 9)]
    got = {tuple(r) for r in graph.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {(i, 0) for i in [*range(41), 500, 501]}
