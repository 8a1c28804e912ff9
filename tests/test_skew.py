import re

from pyspark.sql import functions as F

from lurewatch.operators import enrich, skew


def rows(spark, n=30_000):
    """Look-ups of which a third name one URL, a tenth none (null), and the rest are few a key."""
    k = F.when(F.col("id") % 3 == 0, "https://campaign.example/").when(F.col("id") % 10 == 1, None).otherwise(F.concat(F.lit("u"), (F.col("id") % 7001).cast("string")))
    return spark.range(n).repartition(8).select(F.col("id").alias("email_id"), F.lit("urls").alias("kind"), F.lit(0).alias("pos"), k.alias("indicator"))


def feed(spark, n=200_000):
    u = F.when(F.col("id") == 0, "https://campaign.example/").otherwise(F.concat(F.lit("u"), (F.col("id") * 5).cast("string")))
    return spark.range(n).select(F.lit("urls").alias("kind"), u.alias("indicator"), F.lit(True).alias("found"), (F.col("id") % 3).cast("int").alias("malicious"))


def test_profile_finds_every_hot_key(spark):
    p = skew.Profile(rows(spark), ["kind", "indicator"])
    assert p.rows == 30_000 and len(p.hot) == 2 and rows(spark).filter(p.is_hot()).count() == rows(spark).filter("indicator IS NULL OR indicator = 'https://campaign.example/'").count()
    assert skew.Profile(rows(spark, 0), ["kind", "indicator"]).hot == [] and skew.Profile(spark.range(100), ["id"]).hot == []


def test_enrichment_equals_the_plain_join(spark):
    long, known = rows(spark), feed(spark)
    out = enrich.enrich_long(long, known)
    want = long.join(known, ["kind", "indicator"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    assert out.count() == long.count() and out.select(*want.columns).exceptAll(want).isEmpty()


def test_rows_of_a_hot_key_are_spread(spark):
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = enrich.enrich_long(rows(spark), feed(spark))
        sizes = sorted(r["count"] for r in out.withColumn("p", F.spark_partition_id()).filter("indicator = 'https://campaign.example/' OR indicator IS NULL").groupBy("p").count().collect())
        every = sorted(r["count"] for r in out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) >= 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2] and every[-1] <= 2 * every[len(every) // 2]


def test_feed_is_cut_before_its_shuffle(spark):
    known = rows(spark).select("kind", "indicator").distinct()
    cut = skew.prefilter(feed(spark), known, ["kind", "indicator"], 7002)
    met = feed(spark).join(known, ["kind", "indicator"], "left_semi")
    assert met.exceptAll(cut).isEmpty() and met.count() <= cut.count() < met.count() + 0.15 * 200_000
    plan = cut._jdf.queryExecution().sparkPlan().toString()
    above = plan[: plan.index("BroadcastHashJoin")]
    assert "Exchange" not in above and "SortMergeJoin" not in plan
    joined = known.join(cut, ["kind", "indicator"])
    assert re.search(r"Join", joined._jdf.queryExecution().sparkPlan().toString())


def test_filter_has_a_bounded_size(spark):
    bits, words = skew.key_filter(spark.range(1000), ["id"], 10**12)
    assert words == skew.MAX_WORDS and bits.agg(F.max(F.length("_bits"))).first()[0] * 8 == skew.WORD
    assert skew.prefilter(spark.range(5000), spark.range(0), ["id"], 0).count() == 0


def test_all_three_feeds(spark):
    mails = spark.sql("SELECT 'a' AS email_id, named_struct('urls', array('u1', 'u2', 'u3'), 'domains', array('d'), 'ips', array('i'), 'hashes', array()) AS iocs UNION ALL SELECT 'b', named_struct('urls', array(), 'domains', array(), 'ips', array(), 'hashes', array())")
    known = spark.createDataFrame([("urls", "u1", True, 3), ("ips", "i", True, 0)], "kind string, indicator string, found boolean, malicious int")
    abuse, scan = spark.createDataFrame([("i", 90)], "ip string, score int"), spark.createDataFrame([("u2", 7), ("u3", 8)], "url string, score int")
    out = {r["email_id"]: r["enrichment"] for r in enrich.enrich_mails(mails, known, abuse, scan).collect()}
    a = out["a"]
    assert a["urls"]["u1"]["malicious"] == 3 and a["urls"]["u2"]["scan"]["score"] == 7 and a["urls"]["u3"]["scan"] is None and not a["urls"]["u3"]["found"]
    assert a["ips"]["i"]["abuse"]["score"] == 90 and a["domains"]["d"]["abuse"] is None and not a["domains"]["d"]["found"] and out["b"]["urls"] is None
