"""Snapshots of a table by step: the latest and the best are pointed to, old ones go, the best stays."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..errors import DataError


class Snapshots:
    """A folder of Parquet snapshots in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str, keep_last: int | None = None):
        self.spark, self.folder, self.keep_last = spark, folder, keep_last
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self) -> dict:
        """The newest of the pointer files: each write is a new file, so there is always a whole one."""
        names = self._names("pointers-")
        return json.loads(self.spark.read.text(f"{self.folder}/{names[-1]}").first()[0]) if names else {"steps": []}

    def _names(self, prefix: str) -> list[str]:
        path = self._path(self.folder)
        if not self._fs.exists(path):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(path)) if n.startswith(prefix))

    def save(self, df: DataFrame, step: int, metric: float) -> list[int]:
        """Returns the steps that were deleted."""
        df.write.mode("overwrite").parquet(f"{self.folder}/step-{step:012d}")
        p = self._pointers()
        steps = [s for s in p["steps"] if s != step] + [step]
        if p.get("best_metric") is None or metric > p["best_metric"]:
            p |= {"best": step, "best_metric": metric}
        pruned = [s for s in steps[: -self.keep_last] if s != p["best"]] if self.keep_last else []
        p |= {"latest": step, "steps": [s for s in steps if s not in pruned]}
        old = self._names("pointers-")
        self.spark.createDataFrame([(json.dumps(p),)], "value string").coalesce(1).write.text(f"{self.folder}/pointers-{len(old) and int(old[-1][9:]) + 1:012d}")
        for name in [*old, *(f"step-{s:012d}" for s in pruned)]:
            self._fs.delete(self._path(f"{self.folder}/{name}"), True)
        return pruned

    def steps(self) -> list[int]:
        """The steps that are there."""
        return self._pointers()["steps"]

    def load(self, which: str = "latest") -> DataFrame:
        step = self._pointers().get(which)
        if step is None:
            raise DataError(f"{self.folder} has no {which} snapshot")
        return self.spark.read.parquet(f"{self.folder}/step-{step:012d}")
