"""Batches of several tables that readers see whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class CommitLog:
    """Tables under one folder, written batch by batch; a batch counts from the moment its file appears in `commits`.

    Data go to `table/run=...`, a new run for every attempt, so that an attempt that breaks off leaves nothing that
    readers see. The file is made under another name and renamed, and names the batch's key: a batch that runs again
    after its commit does nothing. One writer at a time, as a stream has it.
    """

    def __init__(self, spark: SparkSession, out: str) -> None:
        self.spark, self.out = spark, out.rstrip("/")

    def _path(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.out}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def commits(self) -> list[tuple[int, str, str]]:
        """(number, run, key) of every batch that counts, in order. One short name a batch reaches the driver."""
        fs, at = self._path("commits")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted((int(n), run, key) for n, run, key in (name.split("~", 2) for name in names if name[0] not in "_."))

    def has(self, key: str) -> bool:
        return any(k == key for _, _, k in self.commits())

    def write(self, key: str, tables: dict[str, DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]]) -> bool:
        """Writes tables in the given order and commits them as one; false if a batch of this key counts already.

        A table may be a function of a reader of those written before it, so that they agree whatever is worked out anew.
        """
        if self.has(key):
            return False
        run = "r" + uuid.uuid4().hex
        path = lambda name: f"{self.out}/{name}/run={run}"
        for name, t in tables.items():
            df = t if isinstance(t, DataFrame) else t(lambda x: self.spark.read.parquet(path(x)))
            df.write.mode("overwrite").parquet(path(name))
        number = max((n for n, _, _ in self.commits()), default=-1) + 1
        fs, new = self._path(f"commits/_{run}")
        fs.create(new, False).close()
        if not fs.rename(new, self._path(f"commits/{number:012d}~{run}~{key}")[1]):
            raise OSError(f"batch {key} could not be committed")
        return True

    def read(self, table: str, schema: StructType | str | None = None, last: bool = False) -> DataFrame:
        """Rows of all batches that count (or of the last one), and `batch`, their number. Without any batch a schema is needed."""
        runs = self.commits()[-1:] if last else self.commits()
        if not runs:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read.option("mergeSchema", "true")
        rows = reader.option("basePath", f"{self.out}/{table}").parquet(*[f"{self.out}/{table}/run={r}" for _, r, _ in runs])
        number = self.spark.createDataFrame([(r, n) for n, r, _ in runs], "run string, batch long")
        return rows.join(F.broadcast(number), "run").drop("run")

    def vacuum(self, table: str) -> int:
        """Deletes the data of attempts that do not count; how many. Not while a batch is being written."""
        counted = {r for _, r, _ in self.commits()}
        fs, at = self._path(table)
        left = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().removeprefix("run=") not in counted] if fs.exists(at) else []
        return sum(bool(fs.delete(p, True)) for p in left)
