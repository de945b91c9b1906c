"""Filters, mappings, findings and counts over events taken as observations:
kind = event_type, file = u<user_id>, line = event_id, evidence = props."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.functions import scalars as S
from factline.operators import facts
from factline.plans.registry import query, table

OBS_SQL = "SELECT event_type AS kind, concat('u', user_id) AS file, event_id AS line, value AS metric, props AS evidence, ts FROM events"
KINDS = ("click", "error", "purchase", "signup", "view", "refund", "heartbeat")
FAMILY = {"click": "interaction", "view": "interaction", "purchase": "commerce", "refund": "commerce", "signup": "account"}
LAYER = {"click": "fe", "view": "fe", "purchase": "bff", "refund": "bff", "signup": "shared"}
MAPPING = (("purchase", "large-purchase", "P1", 50.0), ("error", "failure", "P2", None), ("click", "hot-click", "P3", 90.0))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("kind"), F.concat(F.lit("u"), "user_id").alias("file"), F.col("event_id").alias("line"), F.col("value").alias("metric"), F.col("props").alias("evidence"), "ts")


def values(rows) -> str:
    q = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
    return ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows)


def case(column: str, mapping: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE '{default}' END"


@query("kind_filter", f"SELECT kind, file, line, metric FROM ({OBS_SQL}) WHERE kind IN ('purchase', 'error')")
def kind_filter(spark, sf_dir):
    return facts.kind_filter(observations(spark, sf_dir), ["purchase", "error"]).select("kind", "file", "line", "metric")


@query("ignored_kinds", f"SELECT kind, count(*) AS n FROM ({OBS_SQL}) WHERE kind NOT IN ('click', 'view') GROUP BY 1")
def ignored_kinds(spark, sf_dir):
    return facts.kind_filter(observations(spark, sf_dir), ["click", "view"], keep=False).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "nested_kind_filter",
    f"SELECT file, len(list_filter(list(kind), lambda k: k = 'purchase')) AS n_purchases, count(*) AS n_all FROM ({OBS_SQL}) GROUP BY file",
)
def nested_kind_filter(spark, sf_dir):
    files = observations(spark, sf_dir).groupBy("file").agg(F.collect_list(F.struct("kind", "line")).alias("obs"), F.count("*").alias("n_all"))
    return facts.nested_kind_filter(files, "obs", "purchase").select("file", F.size("obs").cast("long").alias("n_purchases"), "n_all")


@query("kind_count", f"SELECT kind, count(*) AS n FROM ({OBS_SQL}) GROUP BY kind")
def kind_count(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query("kind_summary_zero_filled", f"SELECT d.kind, count(o.kind) AS n FROM (VALUES {values((k,) for k in KINDS)}) d(kind) LEFT JOIN ({OBS_SQL}) o ON o.kind = d.kind GROUP BY 1")
def kind_summary_zero_filled(spark, sf_dir):
    return facts.zero_filled(observations(spark, sf_dir), KINDS)


@query(
    "layer_kind_ratio",
    f"""SELECT {case('kind', LAYER, 'other')} AS layer, kind, count(*) AS n, count(*) FILTER (WHERE metric > 50) AS raw,
        floor(100.0::DOUBLE * count(*) FILTER (WHERE metric > 50) / count(*) + 0.5)::BIGINT AS percent FROM ({OBS_SQL}) GROUP BY 1, 2""",
)
def layer_kind_ratio(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("layer", facts.lookup(F.col("kind"), LAYER, "other"))
    raw = F.count_if(F.col("metric") > 50)
    return o.groupBy("layer", "kind").agg(F.count("*").alias("n"), raw.alias("raw"), S.round_half_up(F.lit(100.0) * raw / F.count("*")).cast("long").alias("percent"))


@query("compliance_split", f"SELECT file, count(*) FILTER (WHERE kind = 'error') AS violations, count(*) FILTER (WHERE kind <> 'error') AS compliant FROM ({OBS_SQL}) GROUP BY file")
def compliance_split(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("file").agg(F.count_if(F.col("kind") == "error").alias("violations"), F.count_if(F.col("kind") != "error").alias("compliant"))


@query("kind_routing", f"SELECT {case('kind', FAMILY, 'all')} AS family, count(*) AS n, count(DISTINCT file) AS files FROM ({OBS_SQL}) GROUP BY 1")
def kind_routing(spark, sf_dir):
    return observations(spark, sf_dir).withColumn("family", facts.lookup(F.col("kind"), FAMILY, "all")).groupBy("family").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


@query("priority_cut", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 25 THEN 'P2' WHEN l_quantity >= 15 THEN 'P3' ELSE 'P4' END AS priority FROM lineitem WHERE l_quantity >= 15")
def priority_cut(spark, sf_dir):
    q = F.col("l_quantity")
    p = F.when(q >= 25, "P2").when(q >= 15, "P3").otherwise("P4")
    return facts.priority_cut(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", p.alias("priority")), "P3")


@query(
    "threshold_mapping",
    f"""SELECT file, line, m.finding_kind, m.priority, left(sha256(concat_ws(':', file, line::VARCHAR, m.finding_kind)), 12) AS id
        FROM ({OBS_SQL}) o JOIN (VALUES {values(MAPPING)}) m(kind, finding_kind, priority, threshold) ON m.kind = o.kind WHERE m.threshold IS NULL OR metric >= m.threshold""",
)
def threshold_mapping(spark, sf_dir):
    return facts.to_findings(observations(spark, sf_dir), MAPPING).select("file", "line", "finding_kind", "priority", "id")


@query("finding_id", "SELECT o_orderkey, left(sha256(concat_ws(':', o_orderpriority, o_orderkey::VARCHAR, o_orderstatus)), 12) AS id FROM orders")
def finding_id(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.finding_id(F.col("o_orderpriority"), F.col("o_orderkey"), F.col("o_orderstatus")).alias("id"))


@query(
    "dedupe_best_confidence",
    f"""SELECT file, kind, line, confidence FROM (SELECT file, kind, line, CASE WHEN metric >= 66 THEN 'high' WHEN metric >= 33 THEN 'medium' ELSE 'low' END AS confidence,
        CASE WHEN metric >= 66 THEN 3 WHEN metric >= 33 THEN 2 ELSE 1 END AS r FROM ({OBS_SQL})) QUALIFY row_number() OVER (PARTITION BY file, kind ORDER BY r DESC, line) = 1""",
)
def dedupe_best_confidence(spark, sf_dir):
    m = F.col("metric")
    o = observations(spark, sf_dir).withColumn("confidence", F.when(m >= 66, "high").when(m >= 33, "medium").otherwise("low"))
    rank = facts.lookup(F.col("confidence"), {"high": 3, "medium": 2, "low": 1})
    return facts.dedupe(o, ["file", "kind"], [F.desc(rank), F.asc("line")]).select("file", "kind", "line", "confidence")


@query("findings_sorted", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY left(o_orderpriority, 1)::INT, o_custkey, o_orderkey)::INT AS place FROM orders")
def findings_sorted(spark, sf_dir):
    from pyspark.sql import Window as W

    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(W.partitionBy("o_orderstatus").orderBy(rank, "o_custkey", "o_orderkey")).alias("place"))


@query(
    "run_diff",
    """WITH b AS (SELECT user_id AS key, max(event_type) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), a AS (SELECT user_id AS key, max(event_type) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1)
       SELECT coalesce(b.key, a.key) AS key, b.v AS before, a.v AS after, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'resolved' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS state
       FROM b FULL JOIN a ON a.key = b.key""",
)
def run_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    run = lambda k: e.filter(F.col("event_id") % 2 == k).groupBy(F.col("user_id").alias("key")).agg(F.max("event_type").alias("v"))
    return facts.run_diff(run(0), run(1), "key", "v")


@query("set_distinct_signals", f"SELECT file, list_sort(list_distinct(list(kind))) AS kinds, concat(count(DISTINCT kind), '/', {len(KINDS)}) AS score FROM ({OBS_SQL}) GROUP BY file")
def set_distinct_signals(spark, sf_dir):
    kinds = F.array_sort(F.collect_set("kind"))
    return observations(spark, sf_dir).groupBy("file").agg(kinds.alias("kinds"), F.concat(F.size(kinds).cast("string"), F.lit(f"/{len(KINDS)}")).alias("score"))


@query("json_evidence", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k, json_extract_string(props, '$.k')::INT >= 50 AS heavy FROM events")
def json_evidence(spark, sf_dir):
    k = F.expr("variant_get(parse_json(props), '$.k', 'int')")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), (k >= 50).alias("heavy"))


@query(
    "evidence_subset",
    f"""SELECT kind, count(*) AS n, count(*) FILTER (WHERE json_extract_string(evidence, '$.k')::INT = 7) AS k7 FROM ({OBS_SQL}) GROUP BY kind""",
)
def evidence_subset(spark, sf_dir):
    k = F.get_json_object("evidence", "$.k").cast("int")
    return observations(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(k == 7).alias("k7"))


@query(
    "group_flags",
    f"""SELECT file, bool_or(kind = 'error') AS has_error, bool_or(kind = 'purchase') AS has_purchase, bool_and(metric > 0) AS all_positive, count(*) FILTER (WHERE kind = 'click') AS clicks,
        list_sort(list(line) FILTER (WHERE kind = 'signup')) AS signups, max(metric) AS top FROM ({OBS_SQL}) GROUP BY file""",
)
def group_flags(spark, sf_dir):
    lines = F.array_sort(F.collect_list(F.when(F.col("kind") == "signup", F.col("line"))))
    o = observations(spark, sf_dir).groupBy("file").agg(
        F.bool_or(F.col("kind") == "error").alias("has_error"), F.bool_or(F.col("kind") == "purchase").alias("has_purchase"), F.bool_and(F.col("metric") > 0).alias("all_positive"),
        F.count_if(F.col("kind") == "click").alias("clicks"), lines.alias("signups"), F.max("metric").alias("top"))
    return o.withColumn("signups", F.when(F.size("signups") > 0, F.col("signups")))


@query("flagged_locations", f"SELECT o.file, o.line, o.kind, f.line IS NOT NULL AS flagged FROM ({OBS_SQL}) o LEFT JOIN (SELECT DISTINCT concat('u', user_id) AS file, event_id AS line, event_type AS kind FROM events WHERE value > 95) f ON (f.file, f.line, f.kind) = (o.file, o.line, o.kind)")
def flagged_locations(spark, sf_dir):
    o = observations(spark, sf_dir)
    flags = o.filter("metric > 95").select("file", "line", "kind").distinct().withColumn("flagged", F.lit(True))
    return o.join(flags, ["file", "line", "kind"], "left").select("file", "line", "kind", F.coalesce("flagged", F.lit(False)).alias("flagged"))


@query("union_streams", f"SELECT source, count(*) AS n FROM (SELECT 'events' AS source, line AS id FROM ({OBS_SQL}) UNION ALL SELECT 'orders', o_orderkey FROM orders UNION ALL SELECT 'parts', p_partkey FROM part) GROUP BY source")
def union_streams(spark, sf_dir):
    a = observations(spark, sf_dir).select(F.lit("events").alias("source"), F.col("line").alias("id"))
    b = table(spark, sf_dir, "orders").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"))
    c = table(spark, sf_dir, "part").select(F.lit("parts").alias("source"), F.col("p_partkey").alias("id"))
    return a.unionByName(b).unionByName(c).groupBy("source").agg(F.count("*").alias("n"))


@query("route_xref", "SELECT c_custkey AS key, 'no_orders' AS gap FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) UNION SELECT o_custkey, 'no_customer' FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def route_xref(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    a = c.join(o.filter("o_totalprice > 300000"), c["c_custkey"] == o["o_custkey"], "left_anti").select(F.col("c_custkey").alias("key"), F.lit("no_orders").alias("gap"))
    b = o.join(c.filter("c_acctbal > 0"), c["c_custkey"] == o["o_custkey"], "left_anti").select(F.col("o_custkey").alias("key"), F.lit("no_customer").alias("gap"))
    return a.union(b).distinct()


@query("unmatched_novel", "WITH b AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), a AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1) SELECT user_id, event_type, 'unmatched' AS side FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = b.user_id AND a.event_type = b.event_type) UNION ALL SELECT user_id, event_type, 'novel' FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.user_id = b.user_id AND a.event_type = b.event_type)")
def unmatched_novel(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    half = lambda k: e.filter(F.col("event_id") % 2 == k).select("user_id", "event_type").distinct()
    b, a = facts.split_matches(half(0), half(1), ["user_id", "event_type"])
    return b.withColumn("side", F.lit("unmatched")).unionByName(a.withColumn("side", F.lit("novel")))
