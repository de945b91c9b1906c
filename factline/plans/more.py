"""Smaller operators: merges, depths, limits, theta joins, formatted numbers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factline.functions import scalars as S
from factline.operators import facts
from factline.plans.observations import values
from factline.plans.registry import query, table

CONVENTIONS = (("license", "(?i)licen[sc]e"), ("secret", "token *="), ("table", "[|].*[|]"), ("rights", "All rights reserved"))


@query("import_merge", "SELECT l_orderkey, l_returnflag, list_sort(list_distinct(list(l_suppkey))) AS suppliers, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2")
def import_merge(spark, sf_dir):
    """Entries of one source merge: the union of what they name, at the first's line."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_set("l_suppkey")).alias("suppliers"), F.min("l_linenumber").alias("first_line"))


@query(
    "nesting_depth",
    "WITH s AS (SELECT user_id, event_id, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events) SELECT user_id, greatest(0, max(d))::BIGINT AS depth FROM s GROUP BY 1",
)
def nesting_depth(spark, sf_dir):
    step = facts.lookup(F.col("event_type"), {"click": 1, "purchase": -1}, 0)
    d = F.sum(step).over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0))
    return table(spark, sf_dir, "events").select("user_id", d.alias("d")).groupBy("user_id").agg(F.greatest(F.lit(0).cast("long"), F.max("d")).alias("depth"))


@query("convention_scan", f"SELECT doc_id, c.name FROM documents JOIN (VALUES {values(CONVENTIONS)}) c(name, pattern) ON regexp_matches(text, c.pattern)")
def convention_scan(spark, sf_dir):
    """Every rule against every text: the rules, a fixed few, are broadcast, and only the texts are read."""
    rules = spark.createDataFrame(list(CONVENTIONS), "name string, pattern string")
    return table(spark, sf_dir, "documents").crossJoin(F.broadcast(rules)).filter(F.expr("regexp_like(text, pattern)")).select("doc_id", "name")


@query("convention_drift", f"SELECT source, name, count(*) AS n, CASE WHEN count(*) > 5 THEN 'drift' ELSE 'aligned' END AS state FROM documents JOIN (VALUES {values(CONVENTIONS)}) c(name, pattern) ON regexp_matches(text, c.pattern) GROUP BY 1, 2")
def convention_drift(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    n = F.count("*")
    return convention_scan(spark, sf_dir).join(d, "doc_id").groupBy("source", "name").agg(n.alias("n"), F.when(n > 5, "drift").otherwise("aligned").alias("state"))


_TENTHS = "format('{:.1f}', floor(strlen(text) / %s::DOUBLE * 10 + 0.5) / 10)"


@query("size_text", f"SELECT doc_id, CASE WHEN strlen(text) < 1024 THEN concat(strlen(text), ' B') WHEN strlen(text) < 1048576 THEN concat({_TENTHS % 1024}, ' KB') ELSE concat({_TENTHS % 1048576}, ' MB') END AS size FROM documents")
def size_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.bytes_text(F.octet_length("text")).alias("size"))


@query("head_limit", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey)[1:5] AS first_five FROM orders GROUP BY 1")
def head_limit(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.slice(F.array_sort(F.collect_list("o_orderkey")), 1, 5).alias("first_five"))


@query("argmax", "SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS best, max(o_totalprice) AS top FROM orders GROUP BY 1")
def argmax(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_totalprice").alias("best"), F.max("o_totalprice").alias("top"))


@query("expanded_tests", "SELECT l_orderkey, (count(*) + sum(CASE WHEN l_quantity >= 25 THEN l_linenumber - 1 ELSE 0 END))::BIGINT AS n FROM lineitem GROUP BY 1")
def expanded_tests(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count("*") + F.sum(F.when(F.col("l_quantity") >= 25, F.col("l_linenumber") - 1).otherwise(0))).alias("n"))


@query("indirect_specs", "SELECT p_partkey, list_sort(list_distinct(list(l_suppkey) FILTER (WHERE l_returnflag = 'R'))) AS specs, count(l_orderkey) AS consumers FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def indirect_specs(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")))).alias("specs"), F.count("*").alias("consumers"))
    p = table(spark, sf_dir, "part").join(l, F.col("l_partkey") == F.col("p_partkey"), "left")
    return p.select("p_partkey", F.when(F.size("specs") > 0, F.col("specs")).alias("specs"), F.coalesce("consumers", F.lit(0)).alias("consumers"))


@query("set_operations", "(SELECT user_id, 'both' AS side FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT ALL SELECT user_id FROM events WHERE event_type = 'purchase')) UNION ALL (SELECT user_id, 'left' FROM (SELECT user_id FROM events WHERE event_type = 'click' EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'purchase'))")
def set_operations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a, b = e.filter("event_type = 'click'").select("user_id"), e.filter("event_type = 'purchase'").select("user_id")
    return a.intersectAll(b).withColumn("side", F.lit("both")).unionByName(a.exceptAll(b).withColumn("side", F.lit("left")))


@query("table_rows", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), h AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS g FROM l WHERE contains(t, '|')) SELECT doc_id, min(line) AS line, count(*) AS length FROM h GROUP BY doc_id, g")
def table_rows(spark, sf_dir):
    from factline.operators.windows import islands

    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "t")).select("doc_id", (F.col("k") + 1).cast("long").alias("line"), "t")
    return islands(d, ["doc_id"], ["line"], F.col("t").contains("|"), 1)
