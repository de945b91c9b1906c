"""Joins, cascades, scores and pivots over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factline.functions import scalars as S
from factline.operators import facts
from factline.operators.matching import unique_suffix
from factline.operators.rules import Rule, cascade, case_sql
from factline.plans.registry import query, table

STATUS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("category_priority_pivot", "SELECT o_orderstatus AS category, " + ", ".join(f"count(*) FILTER (WHERE o_orderpriority = '{p}') AS p{p[0]}" for p in STATUS) + ", count(*) AS total, grouping(o_orderstatus)::INT AS is_total FROM orders GROUP BY ROLLUP(o_orderstatus)")
def category_priority_pivot(spark, sf_dir):
    out = facts.pivot_with_totals(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "category"), "category", "o_orderpriority", STATUS)
    return out.select("category", *(F.col(f"`{p}`").alias(f"p{p[0]}") for p in STATUS), "total", F.col("is_total").cast("int").alias("is_total"))


@query("hot_groups", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 300")
def hot_groups(spark, sf_dir):
    return facts.hot_groups(table(spark, sf_dir, "lineitem"), "l_suppkey", 300)


@query(
    "component_signals",
    """WITH o AS (SELECT o_custkey, count(*) AS n, bool_or(o_orderstatus = 'F') AS any_f, max(o_totalprice) AS top FROM orders GROUP BY 1)
       SELECT c_custkey, (coalesce(n, 0) > 0)::INT + coalesce(any_f, false)::INT + (coalesce(top, 0) > 200000)::INT + (c_acctbal > 5000)::INT AS signals,
       CASE WHEN coalesce(n, 0) = 0 THEN 'LEAF' WHEN (coalesce(n, 0) > 0)::INT + coalesce(any_f, false)::INT + (coalesce(top, 0) > 200000)::INT + (c_acctbal > 5000)::INT >= 3 THEN 'CONTAINER' ELSE 'AMBIGUOUS' END AS kind
       FROM customer LEFT JOIN o ON o_custkey = c_custkey""",
)
def component_signals(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.bool_or(F.col("o_orderstatus") == "F").alias("any_f"), F.max("o_totalprice").alias("top"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    flags = [F.coalesce("n", F.lit(0)) > 0, F.coalesce("any_f", F.lit(False)), F.coalesce("top", F.lit(0.0)) > 200000, F.col("c_acctbal") > 5000]
    signals = sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))
    return c.select("c_custkey", signals.alias("signals"), F.when(~flags[0], "LEAF").when(signals >= 3, "CONTAINER").otherwise("AMBIGUOUS").alias("kind"))


@query("hook_semi_join", "SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45)")
def hook_semi_join(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45")
    return table(spark, sf_dir, "orders").join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey", "o_orderstatus")


CASCADE = (
    Rule("VIP", "c_mktsegment = 'BUILDING' AND c_acctbal > 8000", "high"),
    Rule("DEBTOR", "c_acctbal < 0", "high", manual=True),
    Rule("BUILDER", "c_mktsegment = 'BUILDING'", "medium"),
    Rule("SOLVENT", "c_acctbal > 5000", "low", candidate=True),
)


@query(
    "rule_cascade",
    f"SELECT c_custkey, {case_sql(CASCADE, 'OTHER')} AS kind, {case_sql(CASCADE, 'low', 'confidence')} AS confidence, " + " + ".join(f"({r.condition})::INT" for r in CASCADE) + " AS n_matched FROM customer",
)
def rule_cascade(spark, sf_dir):
    out = cascade(table(spark, sf_dir, "customer"), CASCADE, Rule("OTHER", "true", "low"))
    return out.select("c_custkey", "kind", "confidence", F.size("matched").alias("n_matched"))


@query("near_boundary", "SELECT p_partkey, len(list_filter([790.0::DOUBLE, 1200.0::DOUBLE], lambda t: abs(p_retailprice - t) / t <= 0.2::DOUBLE)) > 0 AS near FROM part")
def near_boundary(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.near_boundary(F.col("p_retailprice"), [790.0, 1200.0, 0.0]).alias("near"))


@query(
    "risk_score",
    """WITH l AS (SELECT l_partkey, max(l_linenumber) AS cc, count(*) AS n, count(DISTINCT l_suppkey) AS consumers FROM lineitem GROUP BY 1),
       r AS (SELECT p_partkey, coalesce(cc, 1)::DOUBLE / 5 + coalesce(n, 0)::DOUBLE / 100 + coalesce(consumers, 0)::DOUBLE / 10 AS risk FROM part LEFT JOIN l ON l_partkey = p_partkey)
       SELECT p_partkey, floor(risk * 100 + 0.5) / 100 AS risk, CASE WHEN risk >= 4 THEN 'HIGH' WHEN risk >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS class FROM r""",
)
def risk_score(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max("l_linenumber").alias("cc"), F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("consumers"))
    p = table(spark, sf_dir, "part").join(l, F.col("l_partkey") == F.col("p_partkey"), "left")
    risk = F.coalesce("cc", F.lit(1)).cast("double") / 5 + F.coalesce("n", F.lit(0)).cast("double") / 100 + F.coalesce("consumers", F.lit(0)).cast("double") / 10
    return p.select("p_partkey", S.round_half_up(risk, 2).alias("risk"), F.when(risk >= 4, "HIGH").when(risk >= 2, "MEDIUM").otherwise("LOW").alias("class"))


@query("test_gap", "SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'P2' WHEN p_size >= 20 THEN 'P3' ELSE 'P4' END AS priority, CASE WHEN p_type LIKE '%STEEL' THEN 'high' ELSE 'medium' END AS confidence FROM part WHERE NOT (p_size < 5) AND p_brand <> 'Brand#11'")
def test_gap(spark, sf_dir):
    size = F.col("p_size")
    p = table(spark, sf_dir, "part").filter((size >= 5) & (F.col("p_brand") != "Brand#11"))
    return p.select("p_partkey", F.when(size >= 40, "P2").when(size >= 20, "P3").otherwise("P4").alias("priority"), F.when(F.col("p_type").endswith("STEEL"), "high").otherwise("medium").alias("confidence"))


@query(
    "parity_status",
    """WITH l AS (SELECT l_orderkey, count(*) AS lines, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1)
       SELECT o_orderkey, CASE WHEN lines IS NULL THEN 'NOT_PORTED' WHEN total / o_totalprice > 2 THEN 'EXPANDED' WHEN total / o_totalprice < 0.4 THEN CASE WHEN lines >= 4 THEN 'PARITY' ELSE 'REDUCED' END ELSE 'PARITY' END AS status,
       CASE WHEN lines IS NULL THEN 'high' WHEN abs(total / o_totalprice - 0.4) / 0.4 < 0.2 OR abs(total / o_totalprice - 2) / 2 < 0.2 THEN 'low' ELSE 'high' END AS confidence FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
)
def parity_status(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_extendedprice").alias("total"))
    o = table(spark, sf_dir, "orders").join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left").withColumn("ratio", F.col("total") / F.col("o_totalprice"))
    status = F.expr("CASE WHEN lines IS NULL THEN 'NOT_PORTED' WHEN ratio > 2 THEN 'EXPANDED' WHEN ratio < 0.4D THEN CASE WHEN lines >= 4 THEN 'PARITY' ELSE 'REDUCED' END ELSE 'PARITY' END")
    confidence = F.expr("CASE WHEN lines IS NULL THEN 'high' WHEN abs(ratio - 0.4D) / 0.4D < 0.2D OR abs(ratio - 2) / 2 < 0.2D THEN 'low' ELSE 'high' END")
    return o.select("o_orderkey", status.alias("status"), confidence.alias("confidence"))


@query(
    "weighted_score",
    """WITH w AS (SELECT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 3.0::DOUBLE WHEN '2-HIGH' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, o_orderstatus AS s FROM orders)
       SELECT o_custkey, coalesce(floor(100 * sum(CASE WHEN s <> 'P' THEN w * (s = 'F')::INT + 0.5 * w * (s = 'O')::INT END) / sum(CASE WHEN s <> 'P' THEN w END) + 0.5), 100.0)::DOUBLE AS score FROM w GROUP BY 1""",
)
def weighted_score(spark, sf_dir):
    s = F.col("o_orderstatus")
    w = facts.lookup(F.col("o_orderpriority"), {"1-URGENT": 3.0, "2-HIGH": 2.0}, 1.0)
    o = table(spark, sf_dir, "orders").select("o_custkey", w.alias("w"), s.alias("s"))
    got = F.sum(F.when(F.col("s") != "P", F.col("w") * (F.col("s") == "F").cast("int") + F.lit(0.5) * F.col("w") * (F.col("s") == "O").cast("int")))
    return o.groupBy("o_custkey").agg(F.coalesce(S.round_half_up(100 * got / F.sum(F.when(F.col("s") != "P", F.col("w")))), F.lit(100.0)).alias("score"))


@query(
    "deduction_score",
    "WITH w(flag, weight) AS (VALUES ('R', 20), ('A', 10)) SELECT l_orderkey, greatest(0, 100 - sum(coalesce(weight, 5)))::BIGINT AS score FROM lineitem LEFT JOIN w ON flag = l_returnflag GROUP BY 1",
)
def deduction_score(spark, sf_dir):
    w = facts.lookup(F.col("l_returnflag"), {"R": 20, "A": 10}, 5)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.greatest(F.lit(0).cast("long"), 100 - F.sum(w)).alias("score"))


@query(
    "verdict",
    "SELECT l_orderkey, bool_or(l_returnflag = 'R' AND l_quantity > 45) AS blocked, CASE WHEN bool_or(l_returnflag = 'R' AND l_quantity > 45) THEN 'BLOCKED' WHEN 100 - 10 * count(*) FILTER (WHERE l_returnflag = 'R') >= 90 THEN 'READY' WHEN 100 - 10 * count(*) FILTER (WHERE l_returnflag = 'R') >= 60 THEN 'CONDITIONAL' ELSE 'REJECTED' END AS verdict FROM lineitem GROUP BY 1",
)
def verdict(spark, sf_dir):
    r = F.col("l_returnflag") == "R"
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(r & (F.col("l_quantity") > 45)).alias("blocked"), (100 - 10 * F.count_if(r)).alias("score"))
    return l.select("l_orderkey", "blocked", F.when(F.col("blocked"), "BLOCKED").when(F.col("score") >= 90, "READY").when(F.col("score") >= 60, "CONDITIONAL").otherwise("REJECTED").alias("verdict"))


@query(
    "gates",
    "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice < 1000) = 0 AS no_small, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') > 0 AS any_urgent, count(*) FILTER (WHERE o_totalprice < 1000) = 0 AND count(*) FILTER (WHERE o_orderpriority = '1-URGENT') > 0 AS pass FROM orders GROUP BY 1",
)
def gates(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg((F.count_if(F.col("o_totalprice") < 1000) == 0).alias("no_small"), (F.count_if(F.col("o_orderpriority") == "1-URGENT") > 0).alias("any_urgent"))
    return g.withColumn("pass", F.col("no_small") & F.col("any_urgent"))


@query("group_mean_monotone", "WITH m AS (SELECT l_returnflag AS grade, avg(l_quantity) AS mean FROM lineitem GROUP BY 1) SELECT grade, floor(mean * 1000 + 0.5) / 1000 AS mean, coalesce(mean >= lag(mean) OVER (ORDER BY grade), true) AS rises FROM m")
def group_mean_monotone(spark, sf_dir):
    from pyspark.sql import Window as W

    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grade")).agg(F.avg("l_quantity").alias("mean"))
    w = W.partitionBy(F.lit(1)).orderBy("grade")
    return m.select("grade", S.round_half_up(F.col("mean"), 3).alias("mean"), F.coalesce(F.col("mean") >= F.lag("mean").over(w), F.lit(True)).alias("rises"))


@query(
    "mutation_clusters",
    """WITH c AS (SELECT l_orderkey, l_suppkey % 10 AS line, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2), s AS (SELECT l_orderkey, floor(1000.0::DOUBLE * count(*) FILTER (WHERE l_returnflag = 'R') / count(*) + 0.5) / 10 AS score FROM lineitem GROUP BY 1)
       SELECT s.l_orderkey, score, coalesce(max(n), 0) AS largest, count(line) AS clusters FROM s LEFT JOIN c ON c.l_orderkey = s.l_orderkey GROUP BY 1, 2""",
)
def mutation_clusters(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 10).alias("line"), (F.col("l_returnflag") == "R").alias("killed"))
    per = l.groupBy("l_orderkey", "line").agg(F.count("*").alias("n"), F.count_if("killed").alias("k"))
    left = F.col("n") - F.col("k")
    # Both groupings nest, so the second needs no shuffle of the rows again.
    return per.groupBy("l_orderkey").agg(S.round_half_up(100.0 * F.sum("k") / F.sum("n"), 1).alias("score"), F.max(left).alias("largest"), F.count_if(left > 0).alias("clusters"))


@query("array_overlap_split", "WITH o AS (SELECT l_orderkey AS k, list(l_suppkey) AS s FROM lineitem GROUP BY 1) SELECT a.k, count(b.k) AS splits FROM o a LEFT JOIN o b ON b.k = a.k + 1 AND list_has_any(a.s, b.s) GROUP BY 1")
def array_overlap_split(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list("l_suppkey").alias("s"))
    b = o.select((F.col("k") - 1).alias("k"), F.col("s").alias("t"))
    return o.join(b, "k", "left").select("k", F.coalesce(F.arrays_overlap("s", "t"), F.lit(False)).cast("long").alias("splits"))


@query(
    "suffix_unique",
    """WITH e AS (SELECT DISTINCT concat(p_brand, '.', split_part(p_name, ' ', 1)) AS entry FROM part), n AS (SELECT p_partkey, concat('X.', split_part(p_name, ' ', 1)) AS name FROM part),
       t AS (SELECT regexp_extract(entry, '([^.]+)$', 1) AS tail, count(*) AS c, min(entry) AS only FROM e GROUP BY 1)
       SELECT p_partkey, coalesce(e.entry, t.only) AS entry FROM n LEFT JOIN e ON e.entry = n.name LEFT JOIN t ON c = 1 AND tail = regexp_extract(name, '([^.]+)$', 1)""",
)
def suffix_unique(spark, sf_dir):
    p, first = table(spark, sf_dir, "part"), F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    entries = p.select(F.concat("p_brand", F.lit("."), first).alias("entry")).distinct()
    return unique_suffix(p.select("p_partkey", F.concat(F.lit("X."), first).alias("name")), entries, "name", "entry").select("p_partkey", "entry")


@query("last_wins_lookup", "WITH m AS (SELECT l_orderkey, arg_max(l_suppkey, l_linenumber * 100000000 + l_suppkey) AS supp FROM lineitem GROUP BY 1) SELECT o_orderkey, supp FROM orders LEFT JOIN m ON l_orderkey = o_orderkey")
def last_wins_lookup(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_suppkey", F.col("l_linenumber") * F.lit(100000000) + F.col("l_suppkey")).alias("supp"))
    return table(spark, sf_dir, "orders").join(m, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "supp")


@query("helper_outcome", "SELECT l_orderkey, l_linenumber, CASE WHEN s_suppkey IS NOT NULL AND s_acctbal > 0 THEN 'resolved' WHEN s_suppkey IS NOT NULL THEN 'unresolved' ELSE 'ignored' END AS outcome FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey")
def helper_outcome(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    l = table(spark, sf_dir, "lineitem").join(s, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return l.select("l_orderkey", "l_linenumber", F.when(F.col("s_acctbal") > 0, "resolved").when(F.col("s_suppkey").isNotNull(), "unresolved").otherwise("ignored").alias("outcome"))


@query("test_weight", "SELECT l_orderkey, greatest(1, count(*) + 2 * count(*) FILTER (WHERE l_returnflag = 'R') + sum(CASE WHEN l_quantity >= 30 THEN greatest(l_linenumber, 3) ELSE 0 END))::BIGINT AS weight FROM lineitem GROUP BY 1")
def test_weight(spark, sf_dir):
    n = F.count("*") + 2 * F.count_if(F.col("l_returnflag") == "R") + F.sum(F.when(F.col("l_quantity") >= 30, F.greatest("l_linenumber", F.lit(3))).otherwise(0))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.greatest(F.lit(1).cast("long"), n).alias("weight"))


_RANGES = ("^1.2.0", "~1.4", ">=2.0.0 <3.0.0", "1.x", "0.1.0 - 1.3.5", "^0.3.0 || >4", "*")


@query(
    "semver_satisfies",
    "WITH v AS (SELECT DISTINCT p_size % 6 AS a, p_size % 7 AS b, (p_partkey % 9)::INT AS c FROM part), k AS (SELECT *, a * 10000 + b * 100 + c AS n FROM v) SELECT concat(a, '.', b, '.', c) AS version, n >= 10200 AND n < 20000 AS r0, n >= 10400 AND n < 10500 AS r1, n >= 20000 AND n < 30000 AS r2, a = 1 AS r3, n >= 100 AND n <= 10305 AS r4, (n >= 300 AND n < 400) OR a > 4 AS r5, true AS r6 FROM k",
)
def semver_satisfies(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_size") % 6).alias("a"), (F.col("p_size") % 7).alias("b"), (F.col("p_partkey") % 9).alias("c")).distinct()
    v = p.select(F.concat_ws(".", "a", "b", "c").alias("version"))
    return v.select("version", *(S.satisfies(F.col("version"), F.lit(r)).alias(f"r{k}") for k, r in enumerate(_RANGES)))
