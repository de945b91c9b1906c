"""Queries over events taken as observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.plans.registry import query, table

#: kind -> priority; kinds that are missing here rank as P4.
PRIORITY = {"purchase": "P1", "signup": "P2", "click": "P3", "error": "P1"}


def _case(column: str, mapping: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {arms} ELSE '{default}' END"


@query(
    "kind_priority_counts",
    f"""SELECT {_case('event_type', PRIORITY, 'P4')} AS priority, event_type AS kind, count(*) AS n
        FROM events GROUP BY 1, 2""",
)
def kind_priority_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .select(F.col("event_type").alias("kind"))
        .withColumn("priority", F.expr(_case("kind", PRIORITY, "P4")))
        .groupBy("priority", "kind")
        .agg(F.count("*").alias("n"))
    )
