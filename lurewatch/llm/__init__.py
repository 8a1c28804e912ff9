"""Operators that prepare text and vectors for training, with one registered query each."""

from lurewatch.llm import bpe, exact_topk, near_dedup, packing, quality_classifier, quality_rules, resampling, secret_scan, suffix_dedup, toxicity, training_order, url_filter, whitening

_MODULES = (quality_rules, quality_classifier, near_dedup, exact_topk, url_filter, toxicity, packing, secret_scan, training_order, bpe, resampling, suffix_dedup, whitening)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
