"""Several operators in a row: markdown facts, findings from start to report,
intent and parity scores, incremental reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from factline.functions import scalars as S
from factline.operators import extract, facts, matching
from factline.operators.interpret import TABLES, interpret
from factline.operators.rules import case_sql
from factline.plans.observations import MAPPING, OBS_SQL, observations, values
from factline.plans.registry import query, table

_MARKDOWN = [p for p in extract.PATTERNS if p.tool == "markdown" and p.kind in ("TABLE_ROW", "BLOCKQUOTE", "HEADING", "TASK")]
#: Line starts that become marks, so that the documents are markdown.
_MARKS = {"A": "# A", "The": "> The", "In": "- [x] In", "On": "| On"}
_LINES = f"SELECT doc_id, CASE {' '.join(f"WHEN starts_with(t, '{k}') THEN concat('{v}', substr(t, {len(k) + 1}){', chr(124)' * (v[0] == '|')})" for k, v in _MARKS.items())} ELSE t END AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents)"


@query("markdown_facts", " UNION ALL ".join(f"SELECT doc_id, '{p.kind}' AS kind, count(*) AS n FROM ({_LINES}) WHERE regexp_matches(t, '{p.regex}') GROUP BY 1" for p in _MARKDOWN))
def markdown_facts(spark, sf_dir):
    content = F.col("text")
    for k, v in _MARKS.items():
        content = F.regexp_replace(content, f"(?m)^{k}(.*)$", f"{v}$1|" if v[0] == "|" else f"{v}$1")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("disk").alias("version"), content.alias("content"))
    o = facts.kind_filter(extract.observe(d, ("markdown",)), [p.kind for p in _MARKDOWN])
    return o.groupBy(F.col("file").cast("long").alias("doc_id"), "kind").agg(F.count("*").alias("n"))


@query(
    "findings_report",
    f"""WITH o AS ({OBS_SQL}), m(kind, finding_kind, priority, threshold) AS (VALUES {values(MAPPING)}),
        f AS (SELECT left(sha256(concat_ws(':', file, (line // 10)::VARCHAR, finding_kind)), 12) AS id, finding_kind, priority, file, line FROM o JOIN m USING (kind) WHERE threshold IS NULL OR metric >= threshold),
        d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY line) = 1)
        SELECT finding_kind AS category, count(*) FILTER (WHERE priority = 'P1') AS p1, count(*) FILTER (WHERE priority = 'P2') AS p2, count(*) FILTER (WHERE priority = 'P3') AS p3, count(*) AS total, grouping(finding_kind)::INT AS is_total
        FROM d GROUP BY ROLLUP(finding_kind)""",
)
def findings_report(spark, sf_dir):
    o = observations(spark, sf_dir)
    f = facts.to_findings(o.withColumnsRenamed({"line": "at"}).withColumn("line", F.floor(F.col("at") / 10)), MAPPING)
    d = facts.priority_cut(facts.dedupe(f, ["id"], [F.asc("at")]), "P5").withColumnRenamed("finding_kind", "category")
    out = facts.pivot_with_totals(d, "category", "priority", ["P1", "P2", "P3"])
    return out.select("category", F.col("P1").alias("p1"), F.col("P2").alias("p2"), F.col("P3").alias("p3"), "total", F.col("is_total").cast("int").alias("is_total"))


_HALF = "SELECT user_id, event_type, event_id AS line, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events WHERE event_id % 2 = "


@query(
    "intent_report",
    f"""WITH j AS (SELECT b.line AS before_line, a.line AS after_line, CASE WHEN b.line IS NOT NULL AND a.line IS NOT NULL THEN greatest(0.6::DOUBLE, 1 - abs(a.value - b.value) / 100) END AS similarity,
          coalesce(b.value > 90, false) AS flagged_location, coalesce(b.event_type = 'error', false) AS flagged_kind, coalesce(b.event_type = 'click' AND b.value < 20, false) AS expected_removal
          FROM ({_HALF}0) b FULL JOIN ({_HALF}1) a ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.k = b.k),
        c AS (SELECT {case_sql(TABLES['intent'], 'NONE')} AS kind FROM j)
        SELECT kind, count(*) AS n, floor(100 * sum((kind IN ('PRESERVED', 'CHANGED', 'INTENTIONALLY_REMOVED'))::INT * count(*)) OVER () / nullif(sum((kind <> 'ADDED')::INT * count(*)) OVER (), 0)::DOUBLE + 0.5)::BIGINT AS score FROM c GROUP BY kind""",
)
def intent_report(spark, sf_dir):
    """Before and after, matched by occurrence, classified and scored."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    k = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("event_id"))
    half = lambda p, s: e.filter(F.col("event_id") % 2 == p).select("user_id", "event_type", k.alias("k"), F.col("event_id").alias(f"{s}_line"), F.col("value").alias(f"{s}_value"))
    j = half(0, "before").join(half(1, "after"), ["user_id", "event_type", "k"], "full_outer")
    was = F.col("before_line").isNotNull()
    j = j.withColumns(
        {
            "similarity": F.when(was & F.col("after_line").isNotNull(), F.greatest(F.lit(0.6), F.lit(1.0) - F.abs(F.col("after_value") - F.col("before_value")) / 100)),
            "flagged_location": F.coalesce(F.col("before_value") > 90, F.lit(False)),
            "flagged_kind": was & (F.col("event_type") == "error"),
            "expected_removal": F.coalesce(was & (F.col("event_type") == "click") & (F.col("before_value") < 20), F.lit(False)),
        }
    )
    n = interpret(j, "intent").groupBy("kind").agg(F.count("*").alias("n"))
    kept = F.sum(F.when(F.col("kind").isin("PRESERVED", "CHANGED", "INTENTIONALLY_REMOVED"), F.col("n")).otherwise(0))
    score = n.agg(S.round_half_up(100 * kept / F.sum(F.when(F.col("kind") != "ADDED", F.col("n")).otherwise(0))).cast("long").alias("score"))
    return n.crossJoin(score)


@query(
    "parity_report",
    "WITH s AS (SELECT o_orderkey, o_custkey, o_orderpriority AS name, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS k, floor(o_totalprice / 1000) AS w FROM orders) SELECT x.o_orderkey, CASE WHEN y.o_orderkey IS NULL THEN 'NOT_PORTED' WHEN 10 * y.w > 12 * x.w THEN 'EXPANDED' WHEN 10 * y.w < 8 * x.w THEN 'REDUCED' ELSE 'PARITY' END AS status FROM s x LEFT JOIN s y ON y.o_custkey = x.o_custkey + 1 AND y.name = x.name AND y.k = x.k",
)
def parity_report(spark, sf_dir):
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey"))
    s = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("name"), k.alias("k"), F.floor(F.col("o_totalprice") / 1000).alias("w"))
    t = s.select((F.col("o_custkey") - 1).alias("o_custkey"), "name", "k", F.col("w").alias("target"))
    j = s.join(t, ["o_custkey", "name", "k"], "left")
    return j.select("o_orderkey", F.expr("CASE WHEN target IS NULL THEN 'NOT_PORTED' WHEN 10 * target > 12 * w THEN 'EXPANDED' WHEN 10 * target < 8 * w THEN 'REDUCED' ELSE 'PARITY' END").alias("status"))


@query(
    "name_match_remainder",
    "WITH b AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 2 = 0), a AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 2 = 1) SELECT a.p_partkey FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.p_brand = a.p_brand AND b.p_name = a.p_name AND b.k = a.k)",
)
def name_match_remainder(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey")
    b, a = p.filter("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "b"), p.filter("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "a")
    hit = matching.kth_occurrence(b, a, ["p_brand", "p_name"], "b", "a")
    return a.select(F.col("a").alias("p_partkey")).join(hit.select(F.col("a").alias("p_partkey")), "p_partkey", "left_anti")
