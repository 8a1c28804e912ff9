"""Joins under hot keys: heavy hitters by a mergeable sketch, a join that keeps their rows where they are, and a filter for large tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of all rows from which a key is hot, and items that the sketch tracks: it misses none of that share.
HOT_SHARE, TRACKED = 1 / 200, 8_192
#: Bits for each key of a filter; most words of 32,768 bits that a filter has (they are sent to every worker: 32 MB at most).
BITS, WORD, MAX_WORDS = 12, 32_768, 8_192


def _as_text(keys: list[str]) -> Column:
    """One text that tells keys apart, nulls from empty texts too."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in keys])


class Profile:
    """What one pass over rows says about their keys: number of rows, of distinct keys (about), and the hot keys."""

    def __init__(self, rows: DataFrame, keys: list[str], share: float = HOT_SHARE) -> None:
        most = int(1 / share) + 1
        named = rows.select(_as_text(keys).alias("k"))
        r = named.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("k").alias("d"), F.expr(f"approx_top_k(k, {most}, {TRACKED})").alias("t")).first()
        self.keys, self.rows, self.distinct = keys, r["n"], r["d"]
        self.hot = [x["item"] for x in r["t"] or [] if x["count"] >= max(2, share * r["n"])]

    def is_hot(self) -> Column:
        return _as_text(self.keys).isin(self.hot) if self.hot else F.lit(False)


def join_keyed(rows: DataFrame, of_key: DataFrame, profile: Profile) -> DataFrame:
    """Left join of rows with a table that has one row a key at most. Rows of hot keys are not shuffled: the table's few rows for them go to every worker.

    There are at most 1 / share hot keys, so what is broadcast is bounded whatever the tables hold. A null key finds nothing.
    """
    keys = profile.keys
    if not profile.hot:
        return rows.join(of_key, keys, "left")
    hot = F.broadcast(of_key.filter(profile.is_hot()).limit(len(profile.hot)))
    cold = rows.filter(~profile.is_hot()).join(of_key.filter(~profile.is_hot()), keys, "left")
    return cold.unionByName(rows.filter(profile.is_hot()).join(hot, keys, "left"))


def _bits(keys: list[str], words: int) -> tuple[Column, Column, Column]:
    """Word of a key, and two places in it."""
    h = F.xxhash64(F.lit(2), *keys)
    return F.pmod(F.xxhash64(*keys), F.lit(words)), F.pmod(h, F.lit(WORD)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(WORD))


def key_filter(distinct: DataFrame, keys: list[str], about: int) -> tuple[DataFrame, int]:
    """A Bloom filter of keys as a table (word, bits) of bounded size, made by bitmap aggregation in the workers; and its number of words."""
    words = max(1, min(MAX_WORDS, -(-about * BITS // WORD)))
    word, one, two = _bits(keys, words)
    places = distinct.select(word.alias("_word"), F.explode(F.array(one, two)).alias("p"))
    return places.groupBy("_word").agg(F.expr("bitmap_construct_agg(p)").alias("_bits")), words


def prefilter(table: DataFrame, distinct: DataFrame, keys: list[str], about: int) -> DataFrame:
    """Rows of a large table whose keys may be among the distinct ones, before any shuffle of the table: no match is lost, few others stay."""
    bits, words = key_filter(distinct, keys, about)
    word, one, two = _bits(keys, words)
    is_set = lambda p: F.getbit(F.conv(F.hex(F.substr("_bits", (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long"), (p % 8).cast("int")) == 1
    met = table.withColumn("_word", word).join(F.broadcast(bits), "_word")
    return met.filter(is_set(one) & is_set(two)).select(*table.columns)
