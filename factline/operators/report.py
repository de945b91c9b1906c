"""Rendering of small results: markdown tables, findings JSON, fixed-width tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.operators.facts import PRIORITIES, pivot_with_totals


def fixed_width(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """One ``text`` per row, each column cut or padded to its width."""
    cell = lambda c, w: F.rpad(F.when(F.length(c) > w, F.concat(F.substring(c, 1, w - 3), F.lit("..."))).otherwise(F.coalesce(c, F.lit(""))), w, " ")
    return df.select(F.concat_ws("  ", *(cell(F.col(c).cast("string"), w) for c, w in widths.items())).alias("text"))


def markdown(df: DataFrame) -> str:
    """A result of a few rows as a markdown table; it is brought to the driver."""
    rows = df.collect()
    show = lambda v: "" if v is None else str(v).replace("|", "\\|")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line([show(v) for v in r]) for r in rows)])


def summary(findings: DataFrame) -> str:
    """Category by priority with totals, and the files with three findings or more."""
    table = pivot_with_totals(findings, "category", "priority", PRIORITIES).orderBy("is_total", "category")
    table = table.select(F.when(F.col("is_total") == 1, "Total").otherwise(F.col("category")).alias("category"), *PRIORITIES, "total")
    hot = findings.groupBy("file").agg(F.count("*").alias("n")).filter("n >= 3").orderBy(F.desc("n"), "file")
    return f"## Findings\n\n{markdown(table)}\n\n## Hot files\n\n{markdown(hot)}\n"


def write_findings(findings: DataFrame, path: str) -> None:
    findings.coalesce(1).write.mode("overwrite").json(path)
