"""Findings laid out by day: deletions as markers merged when read, purges that rewrite only the days they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.functions import policy

#: Tables of a ledger and the column by which their rows belong to a finding.
OWNED = {"findings": "id", "actions": "finding_id", "logs": "email_id"}


class Ledger:
    """Tables findings, actions and logs under one folder, each by `day` of the finding, and the markers of deletions.

    A day is the date of a finding's `processed_at`; rows of actions and logs carry the day of their finding, so that
    a purge finds them without looking elsewhere. Changes of few rows are small files of markers beside the days.
    One writer at a time; a ledger to which no finding was added, or of which all were purged, cannot be read.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, table: str, rows: DataFrame) -> None:
        """Adds rows; findings need id, email_id and processed_at, the others their finding's day."""
        rows = rows.withColumn("day", F.to_date("processed_at")) if table == "findings" and "day" not in rows.columns else rows
        rows.write.mode("append").partitionBy("day").parquet(f"{self.path}/{table}")

    def _raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    def _exists(self, table: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(at) and any(f.getPath().getName().startswith("day=") for f in fs.listStatus(at))

    def markers(self) -> DataFrame:
        """id, email_id, day, deleted_at of the last word on each finding that was ever deleted or restored; null: restored."""
        if not self._exists("markers"):
            return self.spark.createDataFrame([], "id bigint, email_id string, day date, deleted_at timestamp")
        return self._raw("markers").groupBy("id", "email_id", "day").agg(F.max_by("deleted_at", "change").alias("deleted_at"))

    def findings(self) -> DataFrame:
        """All findings with deleted_at, null for live ones."""
        return self._raw("findings").drop("deleted_at").join(self.markers().select("id", "day", "deleted_at"), ["id", "day"], "left")

    def _mark(self, rows: DataFrame, deleted_at: Column) -> int:
        """Writes markers for findings, once each; how many. The number of the change orders them."""
        change = 1 + (self._raw("markers").agg(F.max("change")).first()[0] if self._exists("markers") else 0)
        new = rows.select("id", "email_id", "day", deleted_at.cast("timestamp").alias("deleted_at"), F.lit(change).cast("bigint").alias("change"))
        new.write.mode("append").partitionBy("day").parquet(f"{self.path}/markers")
        return self._raw("markers").filter(F.col("change") == change).count()

    def soft_delete(self, ids: DataFrame, now: Column) -> int:
        """Marks the named findings (column id) that live as deleted; how many did."""
        return self._mark(self.findings().filter("deleted_at IS NULL").join(ids.select("id").distinct(), "id", "left_semi"), now)

    def restore(self, ids: DataFrame) -> int:
        """Takes deletions back; how many there were."""
        return self._mark(self.markers().filter("deleted_at IS NOT NULL").join(ids.select("id").distinct(), "id", "left_semi"), F.lit(None))

    def expired(self, now: Column, days: int = policy.RETENTION_DAYS) -> DataFrame:
        return self.markers().filter(F.col("deleted_at") <= now - F.expr(f"INTERVAL {days} DAYS"))

    def remaining(self, table: str, gone: DataFrame, days: list) -> DataFrame:
        """Rows of the given days that a purge of `gone` (id, email_id, day) leaves. Only these days are read."""
        key = OWNED.get(table, "id")
        return self._raw(table).filter(F.col("day").isin(days)).join(gone.select(F.col("email_id" if key == "email_id" else "id").alias(key), "day"), [key, "day"], "left_anti")

    def purge(self, now: Column, days: int = policy.RETENTION_DAYS) -> int:
        """Removes what has been deleted for `days` days or more, with its actions, logs and markers; how many findings went.

        Dates alone reach the driver. Days of which something is left are overwritten as a whole, one by one exchanged
        when the new files are complete; days of which nothing is left are taken away. Findings go last but
        for the markers, so that a purge that breaks off is done again by the next one.
        """
        at = f"{self.path}/expired"
        self.expired(now, days).select("id", "email_id", "day").write.mode("overwrite").parquet(at)
        gone = self.spark.read.parquet(at)
        touched, n = [r["day"] for r in gone.select("day").distinct().collect()], gone.count()
        if not n:
            return 0
        for table in ("logs", "actions", "findings", "markers"):
            if not self._exists(table):
                continue
            left = self.remaining(table, gone, touched)
            kept = {r["day"] for r in left.select("day").distinct().collect()}
            if kept:
                left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.path}/{table}")
            self._drop(table, [d for d in touched if d not in kept])
            self.spark.catalog.refreshByPath(f"{self.path}/{table}")
        return n

    def _drop(self, table: str, days: list) -> None:
        for d in days:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/day={d}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
