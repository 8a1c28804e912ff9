import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from lurewatch.operators import findings
from lurewatch.operators.ledger import Ledger



def now():
    return F.lit("2024-02-20").cast("timestamp")


def ledger(spark, path, n=300):
    rows = spark.range(n).select("id", F.concat(F.lit("e"), "id").alias("email_id"), F.timestamp_seconds(1_704_067_200 + (F.col("id") % 10) * 86_400).alias("processed_at"))
    out = Ledger(spark, str(path))
    out.append("findings", rows.coalesce(1))
    day = F.to_date("processed_at").alias("day")
    out.append("actions", rows.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("step"), F.col("id").alias("finding_id"), day).coalesce(1))
    out.append("logs", rows.select("email_id", F.lit("said").alias("body"), day).coalesce(1))
    return out


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for t in ("findings", "actions", "logs") for d, _, names in os.walk(f"{path}/{t}") for f in names if f.endswith(".parquet")}


def test_delete_and_restore_count_what_changed(spark, tmp_path):
    t = ledger(spark, tmp_path)
    before = files_of(tmp_path)
    assert t.soft_delete(ids(spark, 3, 13, 13, 999_999), F.lit("2024-02-01")) == 2
    assert t.soft_delete(ids(spark, 3, 14), F.lit("2024-02-02")) == 1
    assert t.restore(ids(spark, 13, 15)) == 1 and t.restore(ids(spark, 13)) == 0
    got = {r["id"]: r["deleted_at"] for r in t.findings().filter("deleted_at IS NOT NULL").collect()}
    assert got == {3: datetime.datetime(2024, 2, 1), 14: datetime.datetime(2024, 2, 2)} and t.findings().count() == 300
    assert files_of(tmp_path) == before  # no finding was rewritten


def test_purge_of_one_day_touches_that_day_alone(spark, tmp_path):
    t = ledger(spark, tmp_path)
    t.soft_delete(ids(spark, *range(3, 300, 20)), F.lit("2024-02-13"))  # 15 of the 30 of the 4th
    t.soft_delete(ids(spark, 6), F.lit("2024-02-13 00:00:01"))
    before = files_of(tmp_path)
    gone = t.expired(now())
    plan = t.remaining("findings", gone, [datetime.date(2024, 1, 4)])._jdf.queryExecution().sparkPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan or "PartitionFilters: [(day" in plan or "day#" in plan[plan.index("PartitionFilters") :][:80]
    assert t.purge(now()) == 15
    after = files_of(tmp_path)
    assert {f for f in before if after.get(f) != before[f]} == {f for f in before if "day=2024-01-04" in f}
    assert t.findings().count() == 285 and t._raw("actions").count() == 570 and t._raw("logs").count() == 285
    assert t.findings().filter("deleted_at IS NOT NULL").count() == 1 and t.purge(now()) == 0
    assert t._raw("actions").join(t.findings().select(F.col("id").alias("finding_id")), "finding_id", "left_anti").isEmpty()


def test_a_day_of_which_nothing_is_left_goes(spark, tmp_path):
    t = ledger(spark, tmp_path)
    t.soft_delete(ids(spark, *range(5, 300, 10)), F.lit("2024-01-10"))
    assert t.purge(now()) == 30 and not any("day=2024-01-06" in f for f in files_of(tmp_path)) and t.findings().count() == 270 and t.purge(now()) == 0


def test_ledger_equals_the_plain_changes(spark, tmp_path):
    t, rng = ledger(spark, tmp_path), random.Random(5)
    plain = t.findings()
    plain = spark.createDataFrame(plain.collect(), plain.schema)
    for k in range(4):
        some, back = [rng.randrange(300) for _ in range(60)], [rng.randrange(300) for _ in range(20)]
        at = F.lit(f"2024-02-{10 + k}").cast("timestamp")
        t.soft_delete(ids(spark, *some), at)
        t.restore(ids(spark, *back))
        plain = findings.restore_findings(findings.soft_delete(plain, ids(spark, *some), at), ids(spark, *back))
        plain = spark.createDataFrame(plain.collect(), plain.schema)
    n = t.purge(now())
    kept, _, _ = findings.purge_expired(plain, spark.createDataFrame([], "finding_id long"), spark.createDataFrame([], "email_id string"), now())
    assert n == plain.count() - kept.count() > 0
    names = ["id", "email_id", "processed_at", "deleted_at"]
    assert t.findings().select(*names).exceptAll(kept.select(*names)).isEmpty() and t.findings().count() == kept.count()


@pytest.mark.parametrize(("n", "newest"), [(None, False), (None, True), (7, True), (1, False), (5000, True)])
def test_newest_of_each_source(spark, n, newest):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(3000), f"m{i}") for i in range(9000)] + [("c", 1, "x"), ("c", 1, "x"), ("c", None, "y")]
    df = spark.createDataFrame(rows, "source string, pos long, email_id string").withColumn("body", F.lit("b")).repartition(6)
    got = {}
    for r in findings.select_messages(df, n, newest).collect():
        got.setdefault(r["source"], []).append((r["pos"], r["email_id"]))
    most = min(n or 2000, 2000)
    for s in ("a", "b", "c", None):
        mine = sorted(((p, e) for x, p, e in rows if x == s), key=lambda k: (k[0] is None, (-1 if newest else 1) * (k[0] or 0), k[1]))[:most]
        assert sorted(got[s], key=repr) == sorted(mine, key=repr)
    plan = findings.select_messages(df, n, newest)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
