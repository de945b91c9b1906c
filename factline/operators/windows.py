"""Operators over ordered rows of a file: runs, look-back, look-ahead, as-of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], hit: Column, least: int) -> DataFrame:
    """Runs of ``least`` or more consecutive rows for which ``hit`` holds: the
    keys, the first row's order columns, and ``length``."""
    keyed = df.withColumns({"__all": F.row_number().over(W.partitionBy(*by).orderBy(*order)), "__hit": hit})
    runs = keyed.filter("__hit").withColumn("__run", F.col("__all") - F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return runs.groupBy(*by, "__run").agg(*(F.min(c).alias(c) for c in order), F.count("*").alias("length")).filter(F.col("length") >= least).drop("__run")


def look_back(by: Sequence[str], order: Sequence[str], hit: Column, rows: int) -> Column:
    """Whether ``hit`` holds in one of the ``rows`` rows before."""
    return F.coalesce(F.max(hit.cast("int")).over(W.partitionBy(*by).orderBy(*order).rowsBetween(-rows, -1)), F.lit(0)) == 1


def look_ahead(by: Sequence[str], order: Sequence[str], hit: Column) -> Column:
    """Whether ``hit`` holds in any later row."""
    return F.coalesce(F.max(hit.cast("int")).over(W.partitionBy(*by).orderBy(*order).rowsBetween(1, W.unboundedFollowing)), F.lit(0)) == 1


def as_of(by: Sequence[str], order: Sequence[str], value: Column) -> Column:
    """The last value that isn't null, up to this row."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def as_of_join(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, columns: Sequence[str]) -> DataFrame:
    """Each left row with ``columns`` of the right row of the same keys that is
    the last at or before it. One union and one window: no row pairs are made."""
    kept = left.columns
    names = [f"__l{k}" for k in range(len(kept))]
    a = left.select(*by, at, F.lit(1).alias("__side"), *(F.col(c).alias(n) for c, n in zip(kept, names)))
    b = right.select(*by, at, F.lit(0).alias("__side"), F.struct(*columns).alias("__right"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy(at, "__side").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("__right", F.last("__right", ignorenulls=True).over(w)).filter("__side = 1")
    return both.select(*(F.col(n).alias(c) for c, n in zip(kept, names)), *(F.col(f"__right.{c}").alias(c) for c in columns))


def fence_mask(by: Sequence[str], order: Sequence[str], fence: Column) -> Column:
    """Whether a row is inside a fenced stretch, its fences included."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return fence | (F.sum(fence.cast("int")).over(w) % 2 == 1)


def parent_by_depth(df: DataFrame, by: Sequence[str], order: str, depth: str, most: int) -> DataFrame:
    """``df`` with ``parent``, the order value of the nearest row before of a
    smaller depth. Depths are 1 to ``most``: one running maximum for each, so that one
    sort does, and no row meets another."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    last = [F.max(F.when(F.col(depth) == d, F.col(order))).over(w) for d in range(1, most)]
    above = [F.when(F.col(depth) > d, x) for d, x in zip(range(1, most), last)]
    return df.withColumn("parent", F.array_max(F.array(*above)) if above else F.lit(None))


def leading_run(by: Sequence[str], order: Sequence[str], hit: Column) -> Column:
    """Whether a row is in the first run of rows for which ``hit`` holds."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    begun = F.max(hit.cast("int")).over(w) == 1
    first = F.min(F.when(hit, F.struct(*order))).over(W.partitionBy(*by))
    broken = F.max(F.when(~hit & (F.struct(*order) > first), 1).otherwise(0)).over(w)
    return begun & hit & (broken == 0)


def context_lines(by: Sequence[str], order: Sequence[str], value: Column, before: int, after: int) -> Column:
    """The values of the rows around, in order."""
    return F.collect_list(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(-before, after))
