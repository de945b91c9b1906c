"""Incremental reuse: facts by content hash."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_key(files: DataFrame, config: str = "") -> DataFrame:
    """``files`` with ``sha``, a hash of content and configuration."""
    return files.withColumn("sha", F.sha2(F.concat_ws("\0", F.col("content"), F.lit(config)), 256))


def directory_key(files: DataFrame) -> DataFrame:
    """One hash of all files, whatever their order."""
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha")), ":"), 256).alias("sha"))


class FactCache:
    """Observations kept as Parquet by tool and content hash. ``mode``: "use"
    reads and adds; "refresh" computes all and adds what is new; "bypass" leaves the table alone.
    Paths are put on after the lookup, so that equal files don't take each other's."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def stored(self) -> DataFrame | None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return self.spark.read.parquet(self.path) if p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p) else None

    def observe(self, files: DataFrame, tool: str, extract: Callable[[DataFrame], DataFrame], config: str = "", mode: str = "use") -> DataFrame:
        keyed = content_key(files, config)
        if mode == "bypass":
            return extract(files)
        known = self.stored() if mode == "use" else None
        known = known.filter(F.col("tool_key") == tool) if known is not None else None
        unique = keyed.dropDuplicates(["sha"])
        fresh = unique if known is None else unique.join(known.select("sha").distinct(), "sha", "left_anti")
        # A file without facts leaves a row of nulls, or it would be read each time.
        facts = extract(fresh.select("path", "version", "content")).drop("version")
        rows = fresh.select("sha", F.col("path").alias("file")).join(facts, "file", "left").drop("file").withColumns({"run": F.lit(f"{time.time_ns():020d}"), "tool_key": F.lit(tool)})
        rows.write.mode("append").partitionBy("tool_key").parquet(self.path)
        found = self._latest(self.spark.read.parquet(self.path).filter(F.col("tool_key") == tool)).drop("tool_key").filter("kind IS NOT NULL")
        return keyed.select("sha", F.col("path").alias("file"), "version").join(found, "sha").drop("sha")

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        """The rows of each content's last run: facts that are equal within it stay as many as they are."""
        last = rows.groupBy("tool_key", "sha").agg(F.max("run").alias("run"))
        return rows.join(last, ["tool_key", "sha", "run"]).drop("run")

    def stats(self) -> DataFrame:
        """Contents and facts of each tool; no rows where nothing is stored yet."""
        rows = self.stored()
        if rows is None:
            return self.spark.createDataFrame([], "tool_key string, files long, facts long")
        return self._latest(rows).groupBy("tool_key").agg(F.countDistinct("sha").alias("files"), F.count("kind").alias("facts"))

    def evict(self, keep: int = 1) -> None:
        """Leaves the last ``keep`` runs of each content; the table is written anew and then takes the old one's place."""
        from pyspark.sql import Window as W

        rows = self.stored()
        if rows is None:
            return
        rank = F.dense_rank().over(W.partitionBy("tool_key", "sha").orderBy(F.desc("run")))
        new = f"{self.path}.new"
        rows.withColumn("__rank", rank).filter(F.col("__rank") <= keep).drop("__rank").write.mode("overwrite").partitionBy("tool_key").parquet(new)
        jvm = self.spark._jvm
        old, fresh = jvm.org.apache.hadoop.fs.Path(self.path), jvm.org.apache.hadoop.fs.Path(new)
        fs = old.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(old, True)
        fs.rename(fresh, old)
