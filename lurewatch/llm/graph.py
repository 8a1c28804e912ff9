"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import forget, materialize


#: Tasks over which the rows of one key are dealt.
SALTS = 16


def join_spread(rows: DataFrame, of_key: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join of rows with a table that has one row a key; the rows of a key meet it in SALTS places, dealt by `by`."""
    every = of_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(every, [key, "_salt"]).drop("_salt")


def _with_least(edges: DataFrame) -> DataFrame:
    """edges with m: the least v of each u. A u meets its edges in SALTS places at most, but in none where it has none."""
    salted = edges.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    least = salted.groupBy("u").agg(F.min("v").alias("m"), F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_at"))
    every = least.withColumn("_salt", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit("_at", k) == 1))).drop("_at")
    return salted.join(every, ["u", "_salt"]).drop("_salt")


def _is_done(edges: DataFrame) -> bool:
    """Whether edges from u down to v are stars: every u has one v, and no v is a u."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")), F.struct(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below > 1 OR below + above > 1").count() == 0


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = _with_least(down).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node that has an edge to another one.

    edges: two columns of nodes (long). Loops, repeats and nulls are allowed. Every round is written to the
    shared folder, so the lineage stays short; only whether a round is the last one comes to the driver.
    """
    a, b = edges.columns
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    now = materialize(edges.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "components")
    while not _is_done(now):
        new = materialize(_small_star(_large_star(now)).filter("u <> v").distinct(), "components")
        forget(now)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
