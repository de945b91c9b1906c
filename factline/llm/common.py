"""Helpers shared by the operators: shared-folder tables, fresh names, shapes."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a session that
    doesn't (tests, a notebook in local mode) gets a temporary one; on a
    cluster a missing setting is an error, since a machine-local folder would
    lose data with its executor.
    """
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    named = tempfile.mkdtemp(prefix="factline-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


_OPEN: list[list[str]] = []


def stash(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    survives lost executors, and gives the planner true sizes, so that it
    broadcasts a table only when the file is below its threshold. With ``keep`` it
    outlives the innermost :func:`scratch`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if len(_OPEN) > keep:
        _OPEN[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are stashed inside are deleted at its end: nothing that is
    still to be computed may read them."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, such that no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def plainly(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The columns (all, if not given) under the names c0, c1, ..., whatever their own hold."""
    return df.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns or df.columns)))


def own(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the operator's own columns; an input column whose name
    clashes with one of them (in any case) gives way."""
    names = {c.lower() for c in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*kept, *(v.alias(k) for k, v in columns.items()))


def pieces(df: DataFrame, bytes_column: str | None = None, target: int = 32 << 20, least: int = 1) -> int:
    """How many partitions of about ``target`` bytes hold ``df``'s column."""
    total = df.agg(F.sum(F.octet_length(bytes_column)).alias("b")).first()["b"] or 0
    return max(least, -(-total // target))


def small(written: DataFrame, most: int = 64 << 20) -> DataFrame:
    """A table from :func:`stash`, marked for broadcast if its files hold
    ``most`` bytes or fewer; a larger one joins by a shuffle."""
    size = written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(written) if int(str(size)) <= most else written
