"""Filters, counts, mappings and differences of fact tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factline.functions.scalars import finding_id

PRIORITIES = ("P1", "P2", "P3", "P4", "P5")


def lookup(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    """A constant table as a CASE; cheaper than a join for a few entries."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def dimension(spark, table: Mapping[str, object], key: str, value: str) -> DataFrame:
    """A constant table as rows."""
    return spark.createDataFrame(list(table.items()), [key, value])


def rank_of(priority: Column, unknown: int = 5) -> Column:
    return lookup(priority, {p: k + 1 for k, p in enumerate(PRIORITIES)}, unknown)


def priority_cut(df: DataFrame, least: str, column: str = "priority") -> DataFrame:
    """Rows of priority ``least`` or more urgent; an unknown limit is P4."""
    most = {p: k + 1 for k, p in enumerate(PRIORITIES)}.get(least, 4)
    return df.filter(rank_of(F.col(column)) <= most)


def kind_filter(df: DataFrame, kinds: Sequence[str], keep: bool = True) -> DataFrame:
    hit = F.col("kind").isin(*kinds)
    return df.filter(hit if keep else ~hit)


def nested_kind_filter(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Filters the structs in an array; parents stay, with empty arrays if need be."""
    return df.withColumn(column, F.filter(F.col(column), lambda o: o["kind"] == kind))


def zero_filled(df: DataFrame, kinds: Sequence[str], by: str = "kind") -> DataFrame:
    """A count for every kind of the list, 0 where there is none."""
    dim = df.sparkSession.createDataFrame([(k,) for k in kinds], [by])
    return dim.join(df.groupBy(by).agg(F.count("*").alias("__n")), by, "left").select(by, F.coalesce("__n", F.lit(0)).alias("n"))


def to_findings(obs: DataFrame, mapping: Sequence[tuple[str, str, str, float | None]]) -> DataFrame:
    """Observations of mapped kinds whose metric reaches the mapping's threshold
    (none: all), with the finding's kind, priority and id. ``mapping``: kind,
    finding kind, priority, threshold."""
    dim = obs.sparkSession.createDataFrame(list(mapping), "kind string, finding_kind string, priority string, threshold double")
    out = obs.join(F.broadcast(dim), "kind").filter("threshold IS NULL OR metric >= threshold")
    return out.withColumn("id", finding_id(F.col("file"), F.col("line"), F.col("finding_kind")))


def dedupe(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("__k = 1").drop("__k")


def run_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """added, resolved, changed or same for every key of two runs."""
    b = before.select(F.col(key), F.col(value).alias("before"), F.lit(True).alias("__b"))
    a = after.select(F.col(key), F.col(value).alias("after"), F.lit(True).alias("__a"))
    state = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "resolved").when(~F.col("before").eqNullSafe(F.col("after")), "changed").otherwise("same")
    return b.join(a, key, "full_outer").select(key, "before", "after", state.alias("state"))


def pivot_with_totals(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts per row and column value, a total column and a total row."""
    return df.rollup(row).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values), F.count("*").alias("total"), F.grouping(row).alias("is_total"))


def hot_groups(df: DataFrame, by: str, least: int) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def split_matches(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of either side without a partner."""
    return left.join(right, list(keys), "left_anti"), right.join(left, list(keys), "left_anti")


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, within: int) -> DataFrame:
    """Rows of equal keys whose positions differ by ``within`` at most. Positions
    are cut into bands as wide: a left row looks into three, so that a hash join does it."""
    width = 2 * within + 1
    l = left.withColumn("__band", F.explode(F.array(*(F.floor(F.col(at) / width) + k for k in (-1, 0, 1)))))
    names = {c: f"{c}_r" for c in right.columns if c not in keys}
    r = right.select(*keys, *(F.col(c).alias(n) for c, n in names.items())).withColumn("__band", F.floor(F.col(f"{at}_r") / width))
    return l.join(r, [*keys, "__band"]).filter(F.abs(F.col(at) - F.col(f"{at}_r")) <= within).drop("__band")


def first_containing(left: DataFrame, right: DataFrame, text: str, part: str, order: str) -> DataFrame:
    """For each left row the first right row, by ``order``, whose ``part`` its ``text`` contains."""
    hit = left.select(text).distinct().join(right.select(part, order), F.col(text).contains(F.col(part)))
    return left.join(hit.groupBy(text).agg(F.min_by(part, order).alias(part)), text).select(*left.columns, part)
