"""URL filter: host and path rules, then a logistic regression on hashed character n-grams; built-in functions only."""

from __future__ import annotations

import csv
from importlib.resources import files
from importlib.resources.abc import Traversable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.llm.common import ascii_lower, table

#: Rule (host and path prefix, joined) and verdict.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Lengths of the n-grams, buckets of the feature hash, and the most labelled URLs that a fit takes.
GRAMS, BUCKETS, MAX_LABELLED = (3, 4, 5), 1 << 14, 10_000
#: A small labelled table (url, label; 1: block): junk such as betting, pills, adult, click tracking, link farms, scams, and
#: sites that carry prose. Half of it each.
LABELLED = files(__package__) / "labelled_urls.csv"


def labelled_urls(spark: SparkSession, file: Traversable = LABELLED) -> DataFrame:
    """The labelled table that comes with the library, or one like it: url, label (1.0: block)."""
    with file.open(encoding="utf-8", newline="") as rows:
        return spark.createDataFrame([(r["url"], float(r["label"])) for r in csv.DictReader(rows)], "url string, label double")


def host(url: Column) -> Column:
    """Host with A to Z lower-cased: after the first `://` up to `/`, `?`, `#` or the end; empty if there is none."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, as one CASE; null where none fits. Equal lengths: first in the table."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in reversed(sorted(rules, key=lambda r: -len(r[0]))):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path; each text is cut into characters once, so that long ones stay linear."""
    def of(chars: Column) -> Column:
        return F.flatten(F.array(*[F.transform(F.slice(chars, 1, F.greatest(F.size(chars) - (n - 1), F.lit(0))), _joiner(chars, n)) for n in GRAMS]))

    return F.flatten(F.transform(F.array(F.split(F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$")), "")), of))


def _joiner(chars: Column, n: int):
    return lambda c, i: F.concat(*[F.coalesce(F.get(chars, i + k), F.lit("")) for k in range(n)])


def fit(labelled: DataFrame) -> PipelineModel | None:
    """Fits hashed n-grams -> logistic regression on at most MAX_LABELLED rows (url, label); None if no row has both."""
    rows = labelled.filter("url IS NOT NULL AND label IS NOT NULL").orderBy(F.xxhash64("url"), "url").limit(MAX_LABELLED)
    rows = rows.select(grams(host(F.col("url")), path(F.col("url"))).alias("grams"), "label")
    if rows.isEmpty():
        return None
    steps = [HashingTF(inputCol="grams", outputCol="features", numFeatures=BUCKETS, binary=True), LogisticRegression(regParam=0.01, maxIter=50)]
    return Pipeline(stages=steps).fit(rows)


def judge(pages: DataFrame, model: PipelineModel | None, url: str = "url", rules=RULES) -> DataFrame:
    """Adds host, path, rule, block_probability and verdict (allow or block) to every row.

    A fitting rule decides; else the model does (block from one half up). A null URL or one without `://` has
    an empty host and path and is judged by the model alone. Equal URLs get equal verdicts; an empty table gives
    an empty table. Without a model what no rule fits is allowed (probability 0). Columns of these names in the input are replaced.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_probability")]
    out = pages.select(F.struct(*names).alias("_row"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": rule, "_said": said})
    if model is not None:
        out = model.transform(out.withColumn("grams", grams(F.col("host"), F.col("path"))))
    p = F.lit(0.0) if model is None else vector_to_array("probability")[1]
    return out.select("_row.*", "host", "path", "rule", p.alias("block_probability"), F.coalesce("_said", F.when(p >= 0.5, "block").otherwise("allow")).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), fit(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict", "block_probability")


QUERIES = {"op5_url_filter": op5_url_filter}
ORACLES = {}
