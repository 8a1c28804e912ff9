"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.sources.scratch import scratch, written

#: One or more of the white-space characters that separate words.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text in order; a null or blank text has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit("\x20\x09\x0a\x0b\x0c\x0d"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACES, -1))


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once for every use of it: a lambda over a one-element array names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def before_each(items: Column, total: Callable[[Column], Column], block: int = 128) -> Column:
    """For each item, `total` of all items before it; arrays are summed up block by block, so long ones stay cheap.

    total: array to one value, which may also be applied to values of its own; of an empty array it is the neutral one.
    """

    def with_blocks(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: total(F.slice(v, F.greatest(b, F.lit(0)) * block + 1, F.lit(block))))
        return bind(blocks, lambda b: bind(F.transform(b, lambda _, i: total(F.slice(b, F.lit(1), i))), lambda heads: placed(v, heads)))

    def placed(v: Column, heads: Column) -> Column:
        def one(_: Column, i: Column) -> Column:
            k = F.floor(i / block).cast("int")
            return total(F.array(F.get(heads, k), total(F.slice(v, k * block + 1, i - k * block))))

        return F.transform(v, one)

    return bind(items, lambda v: F.when(F.size(v) > 0, with_blocks(v)).otherwise(v))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: short lineage that outlives any executor."""
    return written(df, name)


def labelled_sample(labelled: DataFrame, text: str, label: str, key: str, most: int, longest: int) -> list[tuple[str, int, int]]:
    """(text, label, hash of the key) of the `most` lowest hashes per label among labels 0 and 1 and texts up to `longest`.

    The cut is found on hashes alone, so that texts are read only where they enter the sample and no text below the cut
    is shuffled. Rows that share a key and a label count once, with their least text.
    """
    rows = labelled.filter(F.col(label).isin(0, 1) & F.col(text).isNotNull() & (F.char_length(text) <= longest))
    rows = rows.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), F.xxhash64(F.col(key)).alias("h"))
    hashes = rows.select("label", "h").distinct()
    cuts = {y: hashes.filter(F.col("label") == y).orderBy("h").limit(most).agg(F.max("h")).first()[0] for y in (0, 1)}
    cuts = {y: h for y, h in cuts.items() if h is not None}
    if not cuts:
        return []
    taken = F.lit(False)
    for y, h in cuts.items():
        taken |= (F.col("label") == y) & (F.col("h") <= h)
    # The plain bound is the one that reaches the texts below their join with the labels.
    kept = rows.filter((F.col("h") <= max(cuts.values())) & taken).groupBy("label", "h").agg(F.min("text").alias("text"))
    return sorted((tuple(r) for r in kept.select("text", "label", "h").collect()), key=lambda r: (r[1], r[2]))


def forget(df: DataFrame) -> None:
    """Deletes a table written by materialize()."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
