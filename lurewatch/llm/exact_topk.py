"""Exact top-k search: bounds from segment means and deviations, coarse to fine, then exact products of survivors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurewatch.llm.common import table

#: Segments of a vector at each resolution, and rows of a block of queries and of candidates.
LEVELS, QUERY_BLOCK, BLOCK = (1, 4, 16), 2_048, 16_384
#: Bounds within which every product fits a long: 2**52 times 2**11.
LARGEST, MAX_DIM = 1 << 26, 2_047


def quantise(vector: Column) -> Column:
    """floor(256 * x) of every component; null for a vector that is null, empty, or holds a null or non-finite component.

    A vector whose products might not fit a long (a component of LARGEST or more, over MAX_DIM components) ends the run.
    """
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    far = F.exists(x, lambda v: F.abs(v * 256) >= LARGEST) | (F.size(x) > MAX_DIM)
    whole = F.transform(x, lambda v: F.floor(v * 256).cast("bigint"))
    return F.when((F.size(x) > 0) & fine, F.when(far, F.raise_error(F.lit("a vector is too large for exact products in a long"))).otherwise(whole))


class _Stats:
    """Per level: scaled means and deviations of the segments, and what they leave open of the squared length.

    |q - x|^2 is at least the squared distance of these statistics, which bounds the product from above.
    """

    def __init__(self, rows: np.ndarray) -> None:
        self.levels = []
        half = (rows**2).sum(1) / 2
        for n in (n for n in LEVELS if n <= rows.shape[1]):
            cuts = np.linspace(0, rows.shape[1], n + 1).astype(int)
            parts = [rows[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            g = np.stack([f * math.sqrt(p.shape[1]) for p in parts for f in (p.mean(1), p.std(1))], 1)
            self.levels.append((g, half - (g**2).sum(1) / 2))


def best_of_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best candidates of a block for each query, ties to the smaller id."""
    qf, xf = q.astype(float), x.astype(float)
    qs, xs = _Stats(qf), _Stats(xf)
    slack = 1e-9 * (1 + np.abs(qf).max(initial=0) * np.abs(xf).max(initial=0)) * x.shape[1]
    out = []
    for start in range(0, len(q), 256):
        rows = slice(start, start + 256)
        (gq, rq), (gx, rx) = qs.levels[0], xs.levels[0]
        bounds = gq[rows] @ gx.T + rq[rows, None] + rx
        for j, bound in enumerate(bounds):
            i = start + j
            bound[ids == q_ids[i]] = -np.inf
            at = np.flatnonzero(bound > -np.inf)
            floor = -np.inf
            for level in range(len(qs.levels)):
                if level:
                    bound = xs.levels[level][0][at] @ qs.levels[level][0][i] + qs.levels[level][1][i] + xs.levels[level][1][at]
                else:
                    bound = bound[at]
                if len(at) > k:
                    seeds = at[np.argpartition(-bound, k - 1)[:k]]
                    floor = max(floor, float((x[seeds] @ q[i]).min()))
                    at = at[bound >= floor - slack]
            score = x[at] @ q[i]
            best = np.lexsort((ids[at], -score))[:k]
            out += [(int(q_ids[i]), int(ids[at[b]]), int(score[b])) for b in best]
    return out


def _rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    values = t.column("v").combine_chunks()
    flat = (values.values if isinstance(values, pa.ListArray) else pa.concat_arrays([c.flatten() for c in values.chunks])).to_numpy()
    return t.column("id").to_numpy(), flat.reshape(t.num_rows, -1)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k highest inner products of quantised vectors; fewer rows if there are fewer.

    Every block of queries meets every block of candidates. Rows with a null id or a vector without a quantised
    form take no part; only vectors of one length are compared; rows with the query's id are its own. A repeated
    candidate row counts each time, a repeated query id once (with its smallest vector). An empty table gives an
    empty table. Vectors too large for exact products end the run with a message (see quantise()).
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), quantise(F.col(vector)).alias("v"), is_query.alias("is_query")).filter("id IS NOT NULL AND v IS NOT NULL")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    blocks, query_blocks = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(n_queries / QUERY_BLOCK))
    own = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dim = F.size("v").alias("dim")
    queries = rows.filter("is_query").groupBy("id").agg(F.min("v").alias("v")).select("id", "v", own(query_blocks).alias("qb"), every(blocks).alias("cb"), dim)
    candidates = rows.select("id", "v", every(query_blocks).alias("qb"), own(blocks).alias("cb"), dim)

    def meet(q: pa.Table, x: pa.Table) -> pa.Table:
        found = best_of_block(*_rows(q), *_rows(x), k) if q.num_rows and x.num_rows else []
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    keys = ("qb", "cb", "dim")
    met = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(meet, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best partners of every vector whose id is divisible by 50, among all other vectors."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id AND len(q.v) = len(x.v)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

QUERIES = {"op4_exact_topk": op4_exact_topk}
ORACLES = {"op4_exact_topk": SQL}
