"""Toxicity: cumulative-link ordinal regression on sparse text features; output is the expected severity."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.llm.common import labelled_sample, table

#: Severity grades are 0 to GRADES - 1. Bound of the labelled sample: rows per label, and characters of a row.
GRADES, MAX_ROWS, MAX_CHARS = 3, 3_000, 16_384
#: Features kept (those that lean most to the toxic class), fewest sampled documents of one, word prefixes that count as features, strength of the penalty.
FEATURES, LEAST_DOCS, PREFIXES, RIDGE = 2_048, 3, (4, 5), 1e-3
#: Probability of any toxicity from which on a text counts as toxic.
CUT = 0.35
#: Most words whose features a task remembers.
REMEMBERED = 200_000
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]  # ascending; one between each grade and the next


def features(text: str | None) -> dict[str, float]:
    """Sparse features of a whole text: words and word prefixes, each with the logarithm of its count."""
    out: Counter[str] = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        out[word] += n
        for k in PREFIXES:
            if len(word) > k:
                out[word[:k] + "*"] += n
    return {k: math.log1p(n) for k, n in out.items()}


@dataclass(frozen=True)
class _Flat:
    """Sparse rows in flat arrays, a few bytes an entry, so that the labelled sample stays small in the driver."""

    names: list[str]
    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    n_rows: int

    def per_name(self, of_rows: np.ndarray | None = None) -> np.ndarray:
        """In how many of the rows each name is found."""
        return np.bincount(self.col if of_rows is None else self.col[of_rows[self.row]], minlength=len(self.names))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.n_rows)

    def transposed_times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * v[self.row], len(self.names))

    def only(self, names: list[str]) -> _Flat:
        """The columns of these names, in their order."""
        place = {k: i for i, k in enumerate(names)}
        new = np.array([place.get(k, -1) for k in self.names], np.int32)[self.col]
        kept = new >= 0
        return _Flat(names, self.row[kept], new[kept], self.value[kept], self.n_rows)


def _flat(rows: Iterable[Mapping[str, float]]) -> _Flat:
    at: dict[str, int] = {}
    col, value, size = array("i"), array("f"), array("i")
    for row in rows:
        col.extend(at.setdefault(k, len(at)) for k in row)
        value.extend(row.values())
        size.append(len(row))
    sizes = np.frombuffer(size, np.int32) if size else np.zeros(0, np.int32)
    whole = [np.frombuffer(x, t) if x else np.zeros(0, t) for x, t in ((col, np.int32), (value, np.float32))]
    return _Flat(list(at), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), *whole, len(sizes))


def fit_grades(texts: list[str], grades: np.ndarray) -> Model:
    """Weights shared by ordered thresholds: P(grade > k) = logistic(weights . x - threshold k)."""
    rows = _flat(features(t) for t in texts)
    found, toxic = rows.per_name(), rows.per_name(grades > 0)
    share = (grades > 0).mean() if len(grades) else 0.0
    leaning = np.flatnonzero((found >= LEAST_DOCS) & (toxic > found * share))
    lean = {rows.names[i]: (toxic[i] - found[i] * share) / np.sqrt(found[i]) for i in leaning}
    names = sorted(lean, key=lambda k: (-lean[k], k))[:FEATURES]
    if not names or not 0 < share < 1:
        return Model({}, tuple(4.0 + k for k in range(GRADES - 1)))
    x = rows.only(names)
    del rows
    above = np.stack([grades > k for k in range(GRADES - 1)], 1)
    w, start, gaps = np.zeros(len(names)), 1.0, np.zeros(GRADES - 2)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, start, gaps)]
    for step in range(1, 301):
        theta = start + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        p = 1 / (1 + np.exp(-np.clip(x.times(w)[:, None] - theta, -30, 30)))
        error = (p - above) / x.n_rows
        to_theta = -error.sum(0)
        grads = [x.transposed_times(error.sum(1)) + RIDGE * w, to_theta.sum(), np.array([to_theta[j + 1 :].sum() * np.exp(gaps[j]) for j in range(GRADES - 2)])]
        moves = []
        for (m, v), g in zip(state, grads, strict=True):
            m[...], v[...] = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            moves.append(0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8))
        w, start, gaps = w - moves[0], start - moves[1], gaps - moves[2]
    theta = start + np.concatenate([[0], np.cumsum(np.exp(gaps))])
    return Model({k: float(v) for k, v in zip(names, w, strict=True) if v}, tuple(map(float, theta)))


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id") -> Model:
    """Fits on at most MAX_ROWS rows per label (lowest hash of the key first), none over MAX_CHARS characters.

    The label only says whether a text is toxic. Among toxic texts the grade follows from how much of the text
    leans to the toxic class: those above the median share of such words get the highest grade. Labels other
    than 0 and 1 and null texts are left out; if one label is missing nothing is found toxic.
    """
    sample = labelled_sample(labelled, text, label, key, MAX_ROWS, MAX_CHARS)
    texts, y = [t for t, _, _ in sample], np.array([of for _, of, _ in sample], int)
    if len(set(y)) == 2:
        words = _flat(Counter(_WORD.findall(t.lower())) for t in texts)
        leaning = words.per_name(y == 1) > 0.9 * words.per_name()
        share = words.times(leaning.astype(float)) / np.maximum(1, words.times(np.ones(len(words.names))))
        del words
        y = y + ((y == 1) & (share > np.median(share[y == 1])))
    return fit_grades(texts, y)


class _Scorer:
    """Weighted features of texts, as features() has them; a word's own few features are looked up once."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights, self.of = weights, {}

    def __call__(self, text: str | None) -> float:
        if len(self.of) > REMEMBERED:
            self.of = {}
        count: Counter[str] = Counter()
        for word, n in Counter(_WORD.findall((text or "").lower())).items():
            keys = self.of.get(word)
            if keys is None:
                names = (word, *(word[:k] + "*" for k in PREFIXES if len(word) > k))
                keys = self.of[word] = tuple(k for k in names if k in self.weights)
            for k in keys:
                count[k] += n
        return sum(self.weights[k] * math.log1p(n) for k, n in sorted(count.items()))


def severity(text: Column, model: Model) -> Column:
    """Struct of severity (expected grade, double), p_toxic (double) and grade (int, likeliest); null texts count as empty."""

    @F.pandas_udf("severity double, p_toxic double, grade int")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        theta, weighed = np.array(model.thresholds), _Scorer(model.weights)
        for batch in batches:
            z = np.array([weighed(t) for t in batch], float).reshape(-1, 1)
            p = 1 / (1 + np.exp(-np.clip(z - theta, -30, 30)))
            each = np.c_[np.ones(len(p)), p] - np.c_[p, np.zeros(len(p))]
            yield pd.DataFrame({"severity": p.sum(1), "p_toxic": p[:, 0], "grade": each.argmax(1).astype("int32")})

    return judged(text)


def grade(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds severity, p_toxic, grade and toxic (p_toxic of CUT or more) to every row; empty in, empty out.

    Columns of these four names in the input are replaced, all others stay.
    """
    own = "_s" + "_" * max(map(len, docs.columns))  # no column has so long a name
    out = docs.withColumn(own, severity(F.col(text), model))
    return out.withColumns({c: F.col(f"{own}.{c}") for c in ("severity", "p_toxic", "grade")}).withColumn("toxic", F.col("p_toxic") >= CUT).drop(own)


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grade(docs, fit(training_rows(spark, sf_dir))).select("doc_id", "severity", "p_toxic", "grade", "toxic")


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES = {}
