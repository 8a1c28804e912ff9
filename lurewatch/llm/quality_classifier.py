"""Quality classifier: texts that a dictionary of good text compresses better than one of bad text score high."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.llm.common import labelled_sample, table

#: Bytes of a dictionary, bytes of the pieces that a text is compressed in, compression level.
DICT_BYTES, PIECE, LEVEL = 64 << 10, 512, 3
#: Bound of the labelled sample: rows per label, and characters of a row that may enter it.
MAX_ROWS, MAX_CHARS = 2_000, 16_384


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


class _Sizes:
    """Compressed sizes of a text under each dictionary and under none."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        plain = {"level": LEVEL, "write_content_size": False, "write_dict_id": False, "write_checksum": False}
        self.by = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in (good, bad)] + [zstandard.ZstdCompressor(**plain)]

    def features(self, text: str | None) -> tuple[float, float, float]:
        """1, normalised size difference, plain compression ratio; pieces keep long texts as telling as short ones."""
        data = (text or "").encode("utf-8", "replace")
        good = bad = plain = 0
        for i in range(0, len(data), PIECE):
            piece = data[i : i + PIECE]
            good += len(self.by[0].compress(piece))
            bad += len(self.by[1].compress(piece))
            plain += len(self.by[2].compress(piece))
        return (1.0, (bad - good) / (bad + good), plain / len(data)) if data else (1.0, 0.0, 1.0)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton steps on standardised columns; the weights returned are for the raw columns."""
    mean, deviation = x[:, 1:].mean(0), x[:, 1:].std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x[:, 1:] - mean) / deviation]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= step
    slopes = w[1:] / deviation
    return np.r_[w[0] - slopes @ mean, slopes]


def fit(labelled: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id") -> Model:
    """Builds the dictionaries on one half of a bounded labelled sample and calibrates on the other.

    The sample holds at most MAX_ROWS rows per label (lowest hash of the key first), none over MAX_CHARS
    characters; rows of one key count once. Labels other than 0 and 1 and null texts are left out. With a label missing in either half the model
    is neutral: every score is one half.
    """
    sample = labelled_sample(labelled, text, label, key, MAX_ROWS, MAX_CHARS)
    build, hold = [r for r in sample if r[2] % 2 == 0], [r for r in sample if r[2] % 2]
    dictionaries = []
    for y in (1, 0):
        pieces = [d[i : i + PIECE] for t, of, _ in build if of == y for d in [t.encode("utf-8", "replace")] for i in range(0, len(d), PIECE)]
        try:
            dictionaries.append(zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes())
        except zstandard.ZstdError:  # too few pieces to train on: they are the dictionary themselves
            dictionaries.append(b"".join(pieces)[-DICT_BYTES:])
    if any(len(d) < 8 for d in dictionaries) or len({r[1] for r in hold}) < 2:
        return Model(b"", b"", (0.0, 0.0, 0.0))
    sizes = _Sizes(*dictionaries)
    weights = _logistic(np.array([sizes.features(t) for t, _, _ in hold]), np.array([y for _, y, _ in hold], float))
    return Model(*dictionaries, tuple(map(float, weights)))


def score(text: Column, model: Model) -> Column:
    """Score of a text from 0 to 1 (double); null and empty texts get the score of a difference of nought."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = _Sizes(model.good, model.bad)
        for batch in batches:
            x = np.array([sizes.features(t) for t in batch]).reshape(-1, 3)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30))))

    return scored(text)


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents that are not held out: crc32 of the id as text, modulo 3, is not 1."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held_out(F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    model = fit(training_rows(spark, sf_dir))
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return docs.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier, fitted as in op2, does not reject.

    Each row is judged for itself, a repeated one each time; a null text as an empty one. All columns stay as they are,
    whatever their names; an empty table gives an empty one.
    """
    model = fit(training_rows(spark, sf_dir))
    names = docs.columns
    scored = docs.select(F.struct(*[F.col(c) for c in names]).alias("_row"), score(F.col("text"), model).alias("_score"))
    return scored.filter("_score >= 0.5").select("_row.*")


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
ORACLES = {}
