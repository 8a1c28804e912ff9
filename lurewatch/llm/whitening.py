"""Embedding whitening: exact centred scatter from the cluster, cyclic Jacobi on the driver, the matrix broadcast."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.llm.common import table

#: Steps of a unit and what is added to them; components that are returned; rows that are multiplied at a time.
STEPS, OFFSET, COMPONENTS, ROWS = 1_024, 100_000, 8, 4_096
#: Longest vector: its scatter and its matrix are what the driver holds and broadcasts. Largest component, in steps.
MAX_DIM, MAX_STEPS = 4_096, 1 << 52


@dataclass(frozen=True)
class Model:
    """Of the vectors of one length: their number, sums, eigenvalues by falling size, unit eigenvectors as columns, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def kept(self, components: int) -> np.ndarray:
        """Which of the first components have variance."""
        return self.values[:components] > len(self.sums) * np.finfo(float).eps * max(self.values.max(initial=0), 0)

    def matrix(self, components: int) -> np.ndarray:
        """Columns that a centred vector is projected on; one without variance gives no number."""
        e = np.where(self.kept(components), self.values[:components], np.nan)
        return self.vectors[:, :components] / np.sqrt(e)


def steps(vector: Column) -> Column:
    """floor(1024 * c) + 100000 of every component; null for a vector that is null, empty, or holds a null or non-finite component."""
    c = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    large = F.exists(c, lambda v: F.abs(v * STEPS) >= MAX_STEPS)
    x = F.transform(c, lambda v: F.floor(v * STEPS).cast("bigint") + OFFSET)
    return F.when((F.size(vector) > 0) & fine, F.when(large, F.raise_error(F.lit("a component is too large for whitening in whole steps"))).otherwise(x))


def _rows(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), steps(F.col(vector)).alias("x")).filter("x IS NOT NULL")
    long = F.raise_error(F.concat(F.lit("vectors are longer than "), F.lit(str(MAX_DIM))))
    return rows.withColumn("x", F.when(F.size("x") <= MAX_DIM, F.col("x")).otherwise(long))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of a batch's rows and their vectors as a matrix, at most ROWS of one length at a time."""
    lists = batch.column("x")
    length, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(length) - length
    for d in np.unique(length):
        at = np.flatnonzero(length == d)
        for some in np.array_split(at, -(-len(at) // ROWS)):
            yield some, flat[first[some][:, None] + np.arange(d)]


def _gram(y: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns, as Python's integers: in doubles while these hold whole numbers, else slowly."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 1 << 53:
        f = y.astype(float)
        return np.rint(f.T @ f).astype(np.int64).astype(object)
    big = y.astype(object)
    return big.T @ big


def _decimals(values: list[list[int]]) -> pa.Array:
    return pa.array([[Decimal(int(v)) for v in row] for row in values], pa.list_(pa.decimal128(38, 0)))


def _summed(parts: DataFrame, keys: list[str]) -> list:
    """Sums of the arrays `part` of all tasks, place by place, in the cluster."""
    each = parts.select(*keys, F.posexplode("part").alias("j", "v"))
    return each.groupBy(*keys, "j").agg(F.sum("v").alias("v")).collect()


def _sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Of each length: the number of vectors and their sums. A task sends one row a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_length(batch):
                new = np.r_[len(x), x.astype(object).sum(0) if np.abs(x).max() > 1 << 48 else x.sum(0).astype(object)]
                held[x.shape[1]] = held.get(x.shape[1], 0) + new
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), _decimals(list(held.values()))], names=["dim", "part"])

    out: dict[int, list[int]] = {}
    for r in _summed(rows.select("x").mapInArrow(run, "dim int, part array<decimal(38,0)>"), ["dim"]):
        out.setdefault(r["dim"], [0] * (r["dim"] + 1))[r["j"]] = int(r["v"])
    return {d: (v[0], v[1:]) for d, v in out.items()}


def _scatter(rows: DataFrame, centre: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Of each length: sums of products of vectors less their rounded means, exact. A task sends one row a row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_length(batch):
                held[x.shape[1]] = held.get(x.shape[1], 0) + _gram(x - centre[x.shape[1]])
        for d, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), _decimals(list(m))], names=["dim", "i", "part"])

    out = {d: np.zeros((d, d), object) for d in centre}
    for r in _summed(rows.select("x").mapInArrow(run, "dim int, i int, part array<decimal(38,0)>"), ["dim", "i"]):
        out[r["dim"]][r["i"], r["j"]] = int(r["v"])
    return out


def jacobi(v: np.ndarray, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors (columns) of a symmetric matrix.

    Sweeps over all pairs, a rotation for each that is not yet nought beside its diagonal; the relative test keeps
    small eigenvalues accurate. Of each vector the largest component is positive.
    """
    a, q = np.array(v, float), np.eye(len(v))
    tiny = np.finfo(float).eps
    for _ in range(most):
        turned = False
        for i in range(len(a) - 1):
            for j in range(i + 1, len(a)):
                if abs(a[i, j]) <= tiny * math.sqrt(abs(a[i, i] * a[j, j])):
                    continue
                turned = True
                half = (a[j, j] - a[i, i]) / (2 * a[i, j])
                t = math.copysign(1, half) / (abs(half) + math.hypot(1, half))
                c = 1 / math.hypot(1, t)
                turn = np.array([[c, t * c], [-t * c, c]])
                a[:, [i, j]] = a[:, [i, j]] @ turn
                a[[i, j], :] = turn.T @ a[[i, j], :]
                a[i, j] = a[j, i] = 0.0
                q[:, [i, j]] = q[:, [i, j]] @ turn
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    q = q[:, order]
    sign = np.sign(q[np.abs(q).argmax(0), np.arange(len(q))])
    return np.diag(a)[order], q * np.where(sign < 0, -1.0, 1.0)


def fit(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> dict[int, Model]:
    """A model for each length of vectors: all of them are read, twice. An empty table gives none.

    Sums and scatter are whole numbers, so neither the order of tasks nor cancellation touches the covariance. What
    reaches the driver are dim * dim sums, whatever the number of rows and tasks.
    """
    rows = _rows(vectors, vec_id, vector)
    sums = _sums(rows)
    centre = {d: np.array([round(s / n) for s in of], np.int64) for d, (n, of) in sums.items()}
    scatter = _scatter(rows, centre)
    out = {}
    for d, (n, of) in sums.items():
        rest = np.array([s - n * int(c) for s, c in zip(of, centre[d], strict=True)], object)  # what rounding the means left
        exact = n * scatter[d] - np.outer(rest, rest)
        v = np.array([[int(e) / (n * n) for e in row] for row in exact])
        out[d] = Model(n, of, *jacobi(v), trace=float(np.trace(v)))
    return out


def _deviations(x: np.ndarray, model: Model) -> tuple[np.ndarray, list[int | None]]:
    """n * x - sums, and the sums of its squares: null where one is too large for a long."""
    n, d = model.n, len(model.sums)
    small = n * int(np.abs(x).max(initial=0)) < 1 << 61 and max(map(abs, model.sums)) < 1 << 61
    far = x * n - np.array(model.sums, np.int64) if small else x.astype(object) * n - np.array(model.sums, object)
    if small and int(np.abs(far).max(initial=0)) ** 2 * d < 1 << 62:
        return far, (far * far).sum(1).tolist()
    squares = (far.astype(object) ** 2).sum(1)
    return far, [int(s) if s < 1 << 63 else None for s in squares]


def _whitened(x: np.ndarray, model: Model, components: int) -> tuple[np.ndarray, list[int | None]]:
    far, deviation = _deviations(x, model)
    return (far / model.n).astype(float) @ model.matrix(components), deviation


def identity_error(rows: DataFrame, models: dict[int, Model], components: int) -> dict[int, float]:
    """Of each length: the largest absolute entry of the covariance of the whitened vectors less the identity, over components with variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_length(batch):
                d = x.shape[1]
                z = _whitened(x, models[d], components)[0][:, models[d].kept(components)]
                held[d] = held.get(d, 0) + np.r_[z.sum(0), (z.T @ z).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["dim", "part"])

    out: dict[int, np.ndarray] = {}
    for r in _summed(rows.select("x").mapInArrow(run, "dim int, part array<double>"), ["dim"]):
        k = int(models[r["dim"]].kept(components).sum())
        out.setdefault(r["dim"], np.zeros(k + k * k))[r["j"]] = r["v"]
    errors = dict.fromkeys(models, 0.0)
    for d, v in out.items():
        k = int(models[d].kept(components).sum())
        mean = v[:k] / models[d].n
        errors[d] = float(np.abs(v[k:].reshape(k, k) / models[d].n - np.outer(mean, mean) - np.eye(k)).max(initial=0))
    return errors


def whiten(vectors: DataFrame, models: dict[int, Model] | None = None, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component.

    Vectors that are null, empty, or hold null or non-finite components take no part; a null vec_id and repeated rows
    stay. Vectors of each length have a model of their own (see fit()), and those of d components give d rows if that
    is fewer. A component without variance gives a null `whitened`; if none has any, `explained` is 0. A deviation too
    large for a long is null. A component of 2**52 steps or more, and a vector over MAX_DIM, end the run with a message.
    An empty table gives an empty table. Other columns are not read.
    """
    models = fit(vectors, vec_id, vector) if models is None else models
    rows = _rows(vectors, vec_id, vector)
    errors = identity_error(rows, models, components)
    held = vectors.sparkSession.sparkContext.broadcast((models, errors))
    names = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, error = held.value
        for batch in batches:
            for at, x in _by_length(batch):
                m, d = of[x.shape[1]], x.shape[1]
                z, deviation = _whitened(x, m, components)
                k = z.shape[1]
                ids = batch.column("vec_id").take(pa.array(np.repeat(at, k)))
                explained = m.values[:k] / m.trace if m.trace > 0 else np.zeros(k)
                columns = [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(ids), m.n, np.int64)), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(z.ravel(), from_pandas=True), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(ids), error[d])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=list(names))

    return rows.mapInArrow(run, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 8 whitened components of every embedding."""
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLES = {}
