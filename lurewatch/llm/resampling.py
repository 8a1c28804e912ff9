"""Importance resampling towards a target: array-scored weights, an exact histogram of whole scores, ranks by its suffix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lurewatch.llm.common import ascii_lower, bind, materialize, table

#: Buckets of features, words a document needs to be drawn, share that is drawn in per cent, seed of the noise.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
#: What separates words once A to Z are lower-cased: all of ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def buckets(text: Column) -> Column:
    """Bucket of every word of a text, in order; a null text has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1)
    # Only the first and the last part can be empty.
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: (F.crc32(w.cast("binary")) % BUCKETS).cast("int"))


def bucket_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """bucket, n over whole texts; buckets without a word are missing. Counts are summed in each task before the shuffle."""
    return texts.select(F.explode(buckets(F.col(text))).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> list[int]:
    """Gain of each bucket in thousandths of a nat: how much commoner it is in the target, both counted with one more in each bucket.

    As many numbers as there are buckets reach the driver, whatever the size of the tables.
    """
    spark = corpus.sparkSession
    both = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    rows = sorted((r["bucket"], r["s"], r["t"]) for r in both.collect())
    of_s, of_t = sum(r[1] for r in rows) + BUCKETS, sum(r[2] for r in rows) + BUCKETS
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1.0) * F.lit(float(of_s)) / ((d("s") + 1.0) * F.lit(float(of_t)))
    found = spark.createDataFrame(rows, "bucket int, s long, t long").select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("bigint").alias("gain")).collect()
    return [g for _, g in sorted((r["bucket"], r["gain"]) for r in found)]


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id in whole thousandths; a null id counts as an empty one."""
    h = F.conv(F.substr(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), F.lit(1), F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("bigint")


def scored(docs: DataFrame, gain: list[int], seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_features, weight (floored mean gain, 0 without a word), score (weight and noise). The gains are an array that every task holds."""
    of = F.split(F.lit(",".join(map(str, gain))), ",", -1).cast("array<bigint>")  # folded into a constant
    total = lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, k: a + F.get(of, k))
    both = bind(buckets(F.col(text)), lambda b: F.struct(F.size(b).cast("bigint").alias("n"), total(b).alias("g")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), both.alias("b"))
    n, g = F.col("b.n"), F.col("b.g")
    floored = F.when(n > 0, F.expr("(b.g - pmod(b.g, b.n)) div b.n")).otherwise(F.lit(0).cast("bigint"))
    return rows.select("doc_id", n.alias("n_features"), floored.alias("weight"), (floored + noise(F.col("doc_id"), seed)).alias("score"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank: a row per input row; rank 1, 2, ... for those drawn, else null.

    Drawn are, of the N documents with `least` words or more, the floor(percent * N / 100) highest scores, ties to the
    smaller doc_id. Scores go into an exact histogram: whole thousandths of logarithms, so its rows are bounded by their
    range (some 10**5), not by the documents. Its suffix sums give the rank before each score and the score where the
    draw ends. Rows that reach that score are sorted by range, so that no score has to fit one task, and are numbered
    within their score; the offsets of a range are bounded by the scores and the ranges.

    A null text has no words; a null id is hashed as an empty one and comes after all others of its score; rows that
    share an id are drawn each for itself, at equal scores those of fewer words first; an empty table gives an empty one, an empty target is a target without words.
    Other columns are not read.
    """
    docs, target = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), target.select(F.col(text).alias("text"))
    rows = materialize(scored(docs, gains(bucket_counts(docs), bucket_counts(target)), seed), "scores")
    able = F.col("n_features") >= least
    counts = {r["score"]: r["n"] for r in rows.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn, above, before = percent * sum(counts.values()) // 100, 0, {}
    for s in sorted(counts, reverse=True):
        if above >= drawn:
            break
        before[s] = above
        above += counts[s]
    if not before:
        return rows.withColumn("rank", F.lit(None).cast("bigint"))
    enters = able & (F.col("score") >= min(before))
    by = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features"]
    spread = rows.filter(enters).withColumn("_tie", F.monotonically_increasing_id())  # ties of one id are cut into ranges too
    ranges = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = materialize(spread.repartitionByRange(ranges, *by, "_tie").withColumn("_range", F.spark_partition_id()), "drawn")
    here: dict[int, int] = {}
    offsets = []
    for r in sorted(held.groupBy("_range", "score").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["_range"]):
        offsets.append((r["_range"], r["score"], before[r["score"]] + here.get(r["score"], 0)))
        here[r["score"]] = here.get(r["score"], 0) + r["n"]
    offset = docs.sparkSession.createDataFrame(offsets, "_range int, score long, _before long")
    own = F.row_number().over(Window.partitionBy("_range", "score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "_tie"))
    rank = (F.col("_before") + F.col("_own")).cast("bigint")
    numbered = held.withColumn("_own", own).join(offset, ["_range", "score"]).withColumn("rank", F.when(rank <= drawn, rank))
    names = ["doc_id", "n_features", "weight", "score"]
    return numbered.select(*names, "rank").unionByName(rows.filter(~enters).select(*names, F.lit(None).cast("bigint").alias("rank")))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the texts of the benchmark."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# CRC-32 is worked out byte by byte with a table made from its polynomial.
SQL = """
WITH RECURSIVE poly(i, k, c) AS (
  SELECT i::BIGINT, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM poly WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
split AS (
  SELECT 's' AS kind, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 't', NULL, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') FROM benchmark
), each AS (SELECT kind, doc_id, unnest(w) AS w FROM split),
word AS (
  SELECT w, xor(list_reduce(list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i::INT + 1, 2))::BIGINT), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM each), crc
), n AS (SELECT bucket, count(*) FILTER (kind = 's') AS s, count(*) FILTER (kind = 't') AS t FROM each JOIN word USING (w) GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM n),
gain AS (SELECT bucket, floor(1000.0::DOUBLE * ln((n.t + 1)::DOUBLE * (total.s + 10000) / ((n.s + 1)::DOUBLE * (total.t + 10000))))::BIGINT AS g FROM n, total),
mean AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS g FROM each JOIN word USING (w) JOIN gain USING (bucket) WHERE kind = 's' GROUP BY doc_id),
score AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END AS weight,
    floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS z
  FROM documents d LEFT JOIN mean ON mean.doc_id = d.doc_id
), able AS (SELECT doc_id, row_number() OVER (ORDER BY weight + z DESC, doc_id) AS r, count(*) OVER () AS n FROM score WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight::BIGINT AS weight, (weight + z)::BIGINT AS score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank
FROM score s LEFT JOIN able a ON a.doc_id = s.doc_id
"""

QUERIES = {"op11_resampling": op11_resampling}
ORACLES = {"op11_resampling": SQL}
