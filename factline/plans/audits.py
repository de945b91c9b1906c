"""An audit's derivations over rows made from the fixed tables. The SQL is written by hand, not from the operators' tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factline.operators import audit as A
from factline.plans.registry import query, table

#: Paths and kinds that both sides start from.
PATH = "concat(CASE p_partkey % 7 WHEN 0 THEN 'src/pages/api/' WHEN 1 THEN 'src/server/' WHEN 2 THEN 'src/shared/' WHEN 3 THEN 'src/__tests__/' WHEN 4 THEN 'src/fixtures/' WHEN 5 THEN 'src/ui/' ELSE 'src/pages/' END, CASE p_size % 6 WHEN 0 THEN 'useA' WHEN 1 THEN 'PanelTable' WHEN 2 THEN 'StackedBar' WHEN 3 THEN 'b.stories' WHEN 4 THEN 'ProgressBar.spec' ELSE 'ChartTip' END, p_partkey, '.tsx')"
_KINDS = "EFFECT_LOCATION HOOK_CALL PROP_FIELD TOAST_CALL WINDOW_MUTATION JSX_IIFE STATIC_IMPORT RAW_TO_FIXED ZERO_CONFLATION TEST_COVERAGE FUNCTION_COMPLEXITY TRUST_BOUNDARY_CAST RAW_ROLE_CHECK RAW_ROLE_EQUALITY HANDLER_INLINE_LOGIC CONTAINER_MISSING_ERROR MOCK_DECLARATION ASSERTION_CALL EFFECT_REF_TOUCH OTHER_KIND"
KIND = f"CASE p_partkey % 20 {' '.join(f'WHEN {k} THEN {chr(39)}{x}{chr(39)}' for k, x in enumerate(_KINDS.split()))} END"
_FOUND = "bug-x as-any non-null-assertion RAW_ROLE_CHECK trust-boundary-gap ddau-violation circular-dep dead-export complexity-hotspot test-gap mock-internal style branded-type-gap"
FOUND = f"CASE p_partkey % 13 {' '.join(f'WHEN {k} THEN {chr(39)}{x}{chr(39)}' for k, x in enumerate(_FOUND.split()))} END"


def rows(spark, sf_dir, source, /, **columns):
    return table(spark, sf_dir, source).select(*(F.expr(x).alias(c) for c, x in columns.items()))


def of(source, /, **columns):
    return "(SELECT " + ", ".join(f"{x} AS {c}" for c, x in columns.items()) + f" FROM {source})"


def over(source, /, **columns):
    """The same rows for either engine."""
    return of(source, **columns), lambda spark, sf_dir: rows(spark, sf_dir, source, **columns)


PARTS, parts = over("part", id="p_partkey", path=PATH, kind=KIND, found=FOUND, line="p_size", cc="p_size % 40")
_TRACK = "CASE WHEN path LIKE 'src/pages/api/%' OR path LIKE 'src/server/%' THEN 'bff' ELSE 'fe' END"
_CATEGORY = "CASE WHEN found LIKE 'bug%' OR found IN ('trust-boundary-gap', 'as-any', 'non-null-assertion', 'RAW_ROLE_CHECK') THEN 'Bug' WHEN found IN ('ddau-violation', 'circular-dep', 'dead-export', 'complexity-hotspot', 'branded-type-gap') THEN 'Architecture' WHEN found IN ('test-gap', 'mock-internal') THEN 'Testing' ELSE 'Style' END"


@query("track_filter", f"SELECT id, path FROM {PARTS} WHERE path LIKE 'src/pages/api/%' OR path LIKE 'src/server/%'")
def track_filter(spark, sf_dir):
    return parts(spark, sf_dir).filter(A.track(F.col("path")) == "bff").select("id", "path")


SCOPED, scoped_rows = over("part", id="p_partkey", raw="concat(CASE p_size % 3 WHEN 0 THEN './' WHEN 1 THEN '' ELSE './/' END, 'src//m', p_partkey % 50, '.ts')")


@query("scope_filter", f"SELECT id, 'src/m7.ts' AS file FROM {SCOPED} WHERE raw IN ('./src//m7.ts', 'src//m7.ts', './/src//m7.ts')")
def scope_filter(spark, sf_dir):
    file = F.regexp_replace(F.regexp_replace("raw", "/+", "/"), r"^(\./)+", "")
    return scoped_rows(spark, sf_dir).select("id", file.alias("file")).filter("file = 'src/m7.ts'")


@query("exclusion_lists", f"SELECT id FROM {PARTS} WHERE NOT regexp_matches(path, 'fixtures/|__tests__') AND kind NOT LIKE '%PROP%' AND kind NOT LIKE '%MOCK%' AND found NOT IN ('style', 'as-any')")
def exclusion_lists(spark, sf_dir):
    p = parts(spark, sf_dir).filter(~A.holds_any(F.col("path"), ("fixtures/", "__tests__")) & ~A.holds_any(F.col("kind"), ("PROP", "MOCK")) & ~F.col("found").isin("style", "as-any"))
    return p.select("id")


@query("canonical_exempt", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 3)")
def canonical_exempt(spark, sf_dir):
    canonical = table(spark, sf_dir, "customer").filter("c_nationkey < 3").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(canonical, "o_custkey", "left_anti").select("o_orderkey")


@query("substring_any", f"SELECT id, path LIKE '%pages/api/%' OR path LIKE '%server/%' AS dynamic FROM {PARTS}")
def substring_any(spark, sf_dir):
    return parts(spark, sf_dir).select("id", A.holds_any(F.col("path"), ("pages/api/", "server/")).alias("dynamic"))


COVER, cover = over("part", id="p_partkey", spec="p_partkey % 4 = 0", indirect="p_partkey % 3", cc="1 + p_size % 20", lines="p_size * 10", consumers="p_partkey % 9")
_COVERED = f"SELECT id, CASE WHEN spec THEN 'TESTED' WHEN indirect > 0 THEN 'INDIRECTLY_TESTED' ELSE 'UNTESTED' END AS coverage, cc / 5.0 + lines / 100.0 + consumers / 10.0 AS score FROM {COVER}"
_RISK = "CASE WHEN coverage = 'UNTESTED' AND score >= 3 THEN 'HIGH' WHEN coverage = 'UNTESTED' AND score >= 1.2 OR coverage = 'INDIRECTLY_TESTED' AND score >= 3 THEN 'MEDIUM' ELSE 'LOW' END"


def _covered(spark, sf_dir):
    c = cover(spark, sf_dir).withColumn("coverage", A.coverage(F.col("spec"), F.col("indirect")))
    return c.withColumn("risk", A.risk_class(F.expr("cast(cc / 5.0BD + lines / 100.0BD + consumers / 10.0BD as double)"), F.col("coverage")))


@query("coverage_priority", f"SELECT id, coverage, risk, CASE WHEN coverage = 'UNTESTED' AND risk = 'HIGH' THEN 'P2' WHEN coverage = 'UNTESTED' AND risk = 'MEDIUM' THEN 'P3' ELSE 'P4' END AS priority FROM (SELECT *, {_RISK} AS risk FROM ({_COVERED}))")
def coverage_priority(spark, sf_dir):
    return _covered(spark, sf_dir).select("id", "coverage", "risk", A.gap_priority(F.col("risk"), F.col("coverage")).alias("priority"))


@query("gap_gate", f"SELECT id FROM (SELECT *, {_RISK} AS risk FROM ({_COVERED})) WHERE coverage <> 'TESTED' AND risk <> 'LOW'")
def gap_gate(spark, sf_dir):
    return _covered(spark, sf_dir).filter(A.emits_gap(F.col("coverage"), F.col("risk"))).select("id")


@query(
    "finding_projection",
    f"SELECT substr(sha256(concat(path, ':', line, ':', found)), 1, 12) AS id, {_CATEGORY} AS category, {_TRACK} AS track, CASE WHEN kind = 'FUNCTION_COMPLEXITY' THEN concat('CC=', cc, ' in ', found) WHEN kind = 'TRUST_BOUNDARY_CAST' THEN concat('Trust boundary cast: ', found) WHEN kind = 'RAW_ROLE_CHECK' THEN 'Raw role check outside canonical files' WHEN kind = 'RAW_ROLE_EQUALITY' THEN 'Raw role equality outside canonical files' WHEN kind = 'HANDLER_INLINE_LOGIC' THEN concat('Inline handler logic (', cc, ' lines)') WHEN kind = 'CONTAINER_MISSING_ERROR' THEN 'Missing error handling in container' ELSE concat(kind, ' at ', path, ':', line) END AS evidence FROM {PARTS}",
)
def finding_projection(spark, sf_dir):
    from factline.functions.scalars import finding_id

    c = F.col
    return parts(spark, sf_dir).select(finding_id(c("path"), c("line"), c("found")).alias("id"), A.category(c("found")).alias("category"), A.track(c("path")).alias("track"), A.evidence(c("kind"), c("path"), c("line"), c("found"), c("cc")).alias("evidence"))


@query("kind_groups", f"SELECT coalesce(CASE WHEN kind LIKE 'EFFECT%' THEN 'effect' WHEN kind = 'HOOK_CALL' THEN 'hook' WHEN kind = 'PROP_FIELD' THEN 'component' WHEN kind IN ('TOAST_CALL', 'WINDOW_MUTATION') THEN 'sideEffect' WHEN kind = 'JSX_IIFE' THEN 'jsx' WHEN kind = 'STATIC_IMPORT' THEN 'import' WHEN kind = 'RAW_TO_FIXED' THEN 'numberFormat' WHEN kind = 'ZERO_CONFLATION' THEN 'nullDisplay' WHEN kind = 'TEST_COVERAGE' THEN 'testCoverage' END, 'all only') AS bucket, count(*) AS n FROM {PARTS} GROUP BY 1")
def kind_groups(spark, sf_dir):
    return parts(spark, sf_dir).groupBy(F.coalesce(A.group_of(F.col("kind")), F.lit("all only")).alias("bucket")).agg(F.count("*").alias("n"))


@query("category_track", f"SELECT {_CATEGORY} AS category, {_TRACK} AS track, count(*) AS n FROM {PARTS} GROUP BY 1, 2")
def category_track(spark, sf_dir):
    return parts(spark, sf_dir).groupBy(A.category(F.col("found")).alias("category"), A.track(F.col("path")).alias("track")).agg(F.count("*").alias("n"))


@query("path_layers", f"SELECT id, CASE WHEN path LIKE '%\\_\\_tests\\_\\_/%' ESCAPE '\\' OR path LIKE '%.spec.%' THEN 'test' WHEN path LIKE '%fixtures/%' OR path LIKE '%.fixture.%' THEN 'fixture' WHEN path LIKE '%src/server/%' OR path LIKE '%src/pages/api/%' THEN 'bff' WHEN path LIKE '%src/shared/%' THEN 'shared' ELSE 'fe' END AS layer FROM {PARTS}")
def path_layers(spark, sf_dir):
    return parts(spark, sf_dir).select("id", A.layer(F.col("path")).alias("layer"))


@query("test_allow_list", f"SELECT kind, count(*) AS n FROM {PARTS} WHERE path LIKE '%tests%' AND kind IN ('MOCK_DECLARATION', 'ASSERTION_CALL') OR path NOT LIKE '%tests%' GROUP BY 1")
def test_allow_list(spark, sf_dir):
    p = parts(spark, sf_dir).filter(~F.contains("path", F.lit("tests")) | F.col("kind").isin(*A.TEST_KINDS))
    return p.groupBy("kind").agg(F.count("*").alias("n"))


@query("no_stories", f"SELECT id FROM {PARTS} WHERE NOT regexp_matches(path, '[.]stories[0-9]*[.]tsx?$')")
def no_stories(spark, sf_dir):
    return parts(spark, sf_dir).filter(~F.col("path").rlike(r"\.stories\d*\.tsx?$")).select("id")


_EXPORTS, _exports = over("part", file="concat(CASE p_size % 10 WHEN 0 THEN 'src/pages/' ELSE 'src/' END, 'f', p_partkey % 300, '.ts')", name="CASE p_size % 9 WHEN 0 THEN 'default' WHEN 1 THEN '* from ./x' ELSE concat('n', p_size) END", is_reexport="p_partkey % 11 = 0")
_EDGES, _edges = over("supplier", src="concat(CASE s_suppkey % 4 WHEN 0 THEN 'src/index.ts' ELSE concat('src/f', s_suppkey % 40, '.ts') END)", dst="concat('src/f', s_suppkey * 7 % 300, '.ts')", name="CASE s_suppkey % 6 WHEN 0 THEN '*' WHEN 1 THEN '* as all' ELSE concat('n', s_suppkey % 50) END")
_PASSED, _passed = over("nation", file="'src/index.ts'", name="CASE n_nationkey WHEN 24 THEN '* from ./y' ELSE concat('n', n_nationkey) END")


@query(
    "dead_export_chain",
    f"""SELECT file, name, count(*) AS n FROM {_EXPORTS} x WHERE file NOT LIKE '%pages/%' AND NOT is_reexport AND name NOT LIKE '* from %'
AND NOT EXISTS (SELECT 1 FROM {_EDGES} e WHERE e.dst = x.file AND (e.name = x.name OR e.name = '*' OR e.name LIKE '* as %' OR x.name = 'default'))
AND NOT EXISTS (SELECT 1 FROM {_EDGES} e JOIN {_PASSED} r ON r.file = e.src WHERE e.dst = x.file AND e.src LIKE '%index.ts' AND r.name <> '* from ./y' AND r.name = x.name) GROUP BY 1, 2""",
)
def dead_export_chain(spark, sf_dir):
    passed = _passed(spark, sf_dir).filter("name <> '* from ./y'")
    return A.dead_export_chain(_exports(spark, sf_dir), _edges(spark, sf_dir), passed).groupBy("file", "name").agg(F.count("*").alias("n"))


@query("barrel_stars", f"SELECT file, name, count(*) AS n FROM {_EXPORTS} x WHERE file NOT LIKE '%pages/%' AND NOT is_reexport AND name NOT LIKE '* from %' AND NOT EXISTS (SELECT 1 FROM {_EDGES} e WHERE e.dst = x.file AND (e.src LIKE '%index.ts' OR e.name = x.name OR e.name LIKE '*%' OR x.name = 'default')) GROUP BY 1, 2")
def barrel_stars(spark, sf_dir):
    """A barrel that passes a file on whole keeps all its exports."""
    return A.dead_export_chain(_exports(spark, sf_dir), _edges(spark, sf_dir), _passed(spark, sf_dir)).groupBy("file", "name").agg(F.count("*").alias("n"))


@query("consumer_edges", "SELECT p_partkey, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def consumer_edges(spark, sf_dir):
    """Per edge, not per consumer."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "part").join(n, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"))


MAPPED = (("m0.ts", "a.spec.ts"), ("m1.ts", "b.spec.ts"), ("m2.ts", "gone.spec.ts"))


@query("file_mapping", "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'a.spec.ts' WHEN 1 THEN 'b.spec.ts' WHEN 2 THEN 'TARGET_FILE_MISSING' ELSE 'NO_FILE_MAPPING' END AS outcome FROM supplier")
def file_mapping(spark, sf_dir):
    """Basename to its target by a fixed table; then whether the target is there."""
    s = rows(spark, sf_dir, "supplier", s_suppkey="s_suppkey", path="concat('e2e/m', s_suppkey % 5, '.ts')").withColumn("base", F.regexp_extract("path", "[^/]*$", 0))
    to, there = spark.createDataFrame(list(MAPPED), "base string, target string"), spark.createDataFrame([("a.spec.ts",), ("b.spec.ts",)], "there string")
    s = s.join(F.broadcast(to), "base", "left").join(F.broadcast(there), F.col("target") == F.col("there"), "left")
    return s.select("s_suppkey", F.when(F.col("target").isNull(), "NO_FILE_MAPPING").when(F.col("there").isNull(), "TARGET_FILE_MISSING").otherwise(F.col("there")).alias("outcome"))


_TESTS, _tests = over("orders", file="o_custkey % 100", test="o_orderkey", scope="o_orderkey % 3")
_MOCKS, _mocks = over("customer", file="c_custkey % 100", scope="CASE WHEN c_nationkey % 4 < 3 THEN c_nationkey % 4 END", target="c_custkey")


@query("scoped_mocks", f"SELECT t.test, count(*) AS n, sum(m.target)::BIGINT AS targets FROM {_TESTS} t JOIN {_MOCKS} m ON m.file = t.file AND (m.scope IS NULL OR m.scope = t.scope) GROUP BY 1")
def scoped_mocks(spark, sf_dir):
    """Mocks are summed by file and scope before they meet the tests, so rows grow with either table, not with their product."""
    sums = _mocks(spark, sf_dir).groupBy("file", "scope").agg(F.count("*").alias("n"), F.sum("target").alias("targets"))
    return A.scoped(_tests(spark, sf_dir), sums, ["file"], "scope").groupBy("test").agg(F.sum("n").alias("n"), F.sum("targets").alias("targets"))


_JSX, _jsx = over("lineitem", file="l_suppkey", component="l_partkey % 5", kind="CASE l_linenumber WHEN 1 THEN 'JSX_RETURN_BLOCK' WHEN 2 THEN 'JSX_TERNARY_CHAIN' WHEN 3 THEN 'JSX_IIFE' WHEN 4 THEN 'JSX_INLINE_HANDLER' ELSE 'JSX_INLINE_STYLE' END", lines="cast(l_quantity as int)", depth="CASE WHEN l_tax > 0.02 THEN l_orderkey % 5 END", statements="l_orderkey % 7")


@query("component_groups", f"SELECT file, component, coalesce(max(CASE kind WHEN 'JSX_RETURN_BLOCK' THEN lines END), 0) AS return_lines, sum(CASE kind WHEN 'JSX_TERNARY_CHAIN' THEN 1 ELSE 0 END)::BIGINT AS n_ternaries, coalesce(max(CASE kind WHEN 'JSX_TERNARY_CHAIN' THEN depth END), 0) AS depth, max(CASE kind WHEN 'JSX_IIFE' THEN 1 ELSE 0 END) = 1 AS has_iife, coalesce(max(CASE kind WHEN 'JSX_INLINE_HANDLER' THEN statements END), 0) AS handler_statements, count(DISTINCT kind) AS n_kinds FROM {_JSX} GROUP BY 1, 2")
def component_groups(spark, sf_dir):
    return A.component_groups(_jsx(spark, sf_dir))


_SIGNALS, _signals = over("customer", id="c_custkey", s="c_custkey % 4", c="c_custkey % 3", r="c_custkey % 2", t="c_nationkey % 2", suffix="c_acctbal > 5000", folder="c_mktsegment = 'BUILDING'")


@query("container_signals", f"SELECT id, (CASE WHEN s > 1 THEN 2 WHEN s = 1 THEN 1 ELSE 0 END + sign(c) + sign(r) + sign(t) + CASE WHEN suffix THEN 1 ELSE 0 END + CASE WHEN folder THEN 1 ELSE 0 END)::INT AS signals FROM {_SIGNALS}")
def container_signals(spark, sf_dir):
    return _signals(spark, sf_dir).select("id", A.container_signals(*(F.col(x) for x in ("s", "c", "r", "t", "suffix", "folder"))).alias("signals"))


_STATUS = "CASE l_linenumber % 4 WHEN 0 THEN 'PARITY' WHEN 1 THEN 'REDUCED' WHEN 2 THEN 'EXPANDED' ELSE 'NOT_PORTED' END"
_RUN, _run = over("lineitem", file="l_orderkey", status=_STATUS, weight="l_suppkey % 6", skipped="l_tax > 0.05", source="l_partkey % 5", target="l_suppkey % 3")


@query("test_scores", f"SELECT file, CASE WHEN total > 0 THEN floor(got / total * 100 + 0.5)::INT WHEN skips THEN 100 ELSE 0 END AS score, total, got AS matched FROM (SELECT file, sum(weight) FILTER (WHERE NOT skipped) AS t, coalesce(t, 0)::BIGINT AS total, coalesce(sum(CASE status WHEN 'REDUCED' THEN weight / 2.0 WHEN 'NOT_PORTED' THEN 0 ELSE weight END) FILTER (WHERE NOT skipped), 0)::DOUBLE AS got, bool_or(skipped) AS skips FROM {_RUN} GROUP BY file)")
def test_scores(spark, sf_dir):
    return A.test_scores(_run(spark, sf_dir), "file")


@query("unit_scores", f"SELECT file, total, floor(got * 10 + 0.5) / 10 AS matched, parity, reduced, expanded, not_ported, floor(got / total * 1000 + 0.5) / 10 AS score FROM (SELECT file, sum(w) AS total, sum(CASE status WHEN 'NOT_PORTED' THEN 0 WHEN 'REDUCED' THEN CASE WHEN source > 0 THEN target::DOUBLE / source * w ELSE w END ELSE w END) AS got, count(*) FILTER (WHERE status = 'PARITY') AS parity, count(*) FILTER (WHERE status = 'REDUCED') AS reduced, count(*) FILTER (WHERE status = 'EXPANDED') AS expanded, count(*) FILTER (WHERE status = 'NOT_PORTED') AS not_ported FROM (SELECT *, greatest(source, 1)::DOUBLE AS w FROM {_RUN}) GROUP BY file)")
def unit_scores(spark, sf_dir):
    return A.unit_scores(_run(spark, sf_dir), "file")


_PLAN = "CASE l_linenumber WHEN 1 THEN 'PROMPT_FILE_MISSING' WHEN 2 THEN 'PLAN_HEADER_MISSING' WHEN 3 THEN 'PROMPT_DEPENDENCY_CYCLE' WHEN 4 THEN 'STANDING_ELEMENT_MISSING' WHEN 5 THEN 'SKILL_REFERENCE' WHEN 6 THEN 'PLAN_HEADER_INVALID' ELSE 'NEW_KIND' END"
_SKILL = "CASE l_linenumber WHEN 1 THEN 'STALE_FILE_PATH' WHEN 2 THEN 'MISSING_SECTION' WHEN 3 THEN 'CONVENTION_DRIFT' WHEN 4 THEN 'MISSING_SECTION_ROLE' WHEN 5 THEN 'ROLE_REQUIREMENT_MISSING' WHEN 6 THEN 'INVALID_ROLE_ANNOTATION' ELSE 'SECTION_COMPLETE' END"
_SCORED, _scored = over("lineitem", id="l_suppkey % 50 * 1000 + l_orderkey % 1000", plan=_PLAN, skill=_SKILL)


@query("plan_score", f"SELECT id, score, CASE WHEN blockers > 0 THEN 'BLOCKED' WHEN score >= 90 THEN 'CERTIFIED' WHEN score >= 60 THEN 'CONDITIONAL' ELSE 'BLOCKED' END AS verdict FROM (SELECT id, greatest(0, 100 - sum(CASE plan WHEN 'PROMPT_FILE_MISSING' THEN 20 WHEN 'PLAN_HEADER_MISSING' THEN 8 WHEN 'PROMPT_DEPENDENCY_CYCLE' THEN 30 WHEN 'STANDING_ELEMENT_MISSING' THEN 3 WHEN 'SKILL_REFERENCE' THEN 0 WHEN 'PLAN_HEADER_INVALID' THEN 1 ELSE 5 END))::INT AS score, count(*) FILTER (WHERE plan IN ('PROMPT_FILE_MISSING', 'PROMPT_DEPENDENCY_CYCLE')) AS blockers FROM {_SCORED} GROUP BY id)")
def plan_score(spark, sf_dir):
    from factline.operators.interpret import interpret

    s = _scored(spark, sf_dir).groupBy("id").agg(A.weighted_score(F.col("plan"), A.PLAN_WEIGHTS, A.OTHER_WEIGHT).alias("score"), F.count_if(F.col("plan").isin(*A.PLAN_BLOCKERS)).alias("n_blockers"))
    return interpret(s, "plan").select("id", "score", F.col("kind").alias("verdict"))


@query("skill_score", f"SELECT id, greatest(0, 100 - 5 * count(*) FILTER (WHERE skill IN ('STALE_FILE_PATH', 'INVALID_ROLE_ANNOTATION')) - 3 * count(*) FILTER (WHERE skill IN ('MISSING_SECTION', 'ROLE_REQUIREMENT_MISSING')) - 10 * count(*) FILTER (WHERE skill = 'CONVENTION_DRIFT') - 2 * count(*) FILTER (WHERE skill = 'MISSING_SECTION_ROLE'))::INT AS score FROM {_SCORED} GROUP BY id")
def skill_score(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("id").agg(A.weighted_score(F.col("skill"), A.SKILL_WEIGHTS, 0).alias("score"))


@query("track_priority_pivot", f"SELECT {_TRACK} AS track, " + ", ".join(f"count(*) FILTER (WHERE line % 5 = {k}) AS P{k + 1}" for k in range(5)) + f" FROM {PARTS} GROUP BY 1")
def track_priority_pivot(spark, sf_dir):
    p = parts(spark, sf_dir).select(A.track(F.col("path")).alias("track"), F.concat(F.lit("P"), F.col("line") % 5 + 1).alias("priority"))
    return p.groupBy("track").pivot("priority", [f"P{k}" for k in range(1, 6)]).count().fillna(0)


_PEERS, _peers = over("lineitem", root="l_suppkey", status="CASE l_linenumber % 3 WHEN 0 THEN 'PEER_DEP_SATISFIED' WHEN 1 THEN 'PEER_DEP_VIOLATED' ELSE 'PEER_DEP_OPTIONAL_MISSING' END")


@query("peer_counts", f"SELECT root, sum((status = 'PEER_DEP_SATISFIED')::INT)::BIGINT AS satisfied, sum((status = 'PEER_DEP_VIOLATED')::INT)::BIGINT AS violated, sum((status = 'PEER_DEP_OPTIONAL_MISSING')::INT)::BIGINT AS optional_missing, count(*) AS total FROM {_PEERS} GROUP BY 1")
def peer_counts(spark, sf_dir):
    n = lambda x: F.count_if(F.col("status") == x)
    return _peers(spark, sf_dir).groupBy("root").agg(n("PEER_DEP_SATISFIED").alias("satisfied"), n("PEER_DEP_VIOLATED").alias("violated"), n("PEER_DEP_OPTIONAL_MISSING").alias("optional_missing"), F.count("*").alias("total"))


@query("field_totals", "SELECT p_brand, count(*) AS total, count(DISTINCT l_suppkey) AS files FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def field_totals(spark, sf_dir):
    b = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return table(spark, sf_dir, "lineitem").join(b, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count("*").alias("total"), F.countDistinct("l_suppkey").alias("files"))


_USES, _uses = over("lineitem", file="l_suppkey", name="CASE l_linenumber % 3 WHEN 0 THEN '*' WHEN 1 THEN concat('* as n', l_partkey % 4) ELSE concat('n', l_partkey % 4) END", src="l_orderkey")


@query("consumer_lists", f"SELECT file, CASE WHEN name LIKE '* as %' THEN substr(name, 6) ELSE name END AS name, count(*) AS n, min(src) AS first, max(src) AS last FROM {_USES} WHERE name <> '*' GROUP BY 1, 2")
def consumer_lists(spark, sf_dir):
    """Edges per file and name: none for a whole file, an alias under what it names; sizes and ends instead of a list that can be of any length."""
    u = _uses(spark, sf_dir).filter("name <> '*'").withColumn("name", F.regexp_replace("name", r"^\* as ", ""))
    return u.groupBy("file", "name").agg(F.count("*").alias("n"), F.min("src").alias("first"), F.max("src").alias("last"))


@query("delete_candidates", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) >= 3")
def delete_candidates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n")).filter("n >= 3")


@query("helper_assertions", "SELECT l_suppkey, l_partkey % 7 AS fn, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def helper_assertions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 7).alias("fn"), "l_returnflag").agg(F.count("*").alias("n"))


@query("metric_order", "SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS place FROM part")
def metric_order(spark, sf_dir):
    """By the metric, largest first; equal ones as they came."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")).alias("place"))


@query("line_column_order", "SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS parts FROM lineitem GROUP BY 1")
def line_column_order(spark, sf_dir):
    s = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(s, lambda x: x["l_partkey"]).alias("parts"))


@query("earliest_argmax", "SELECT l_orderkey, l_partkey AS best FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS k FROM lineitem) WHERE k = 1")
def earliest_argmax(spark, sf_dir):
    """Of equal best ones, the earliest."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_quantity", -F.col("l_linenumber"), -F.col("l_partkey"))).alias("best"))


@query("import_union", "SELECT l_orderkey, list(s ORDER BY k, s) AS names FROM (SELECT l_orderkey, l_suppkey % 5 AS s, min(l_linenumber) AS k FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def import_union(spark, sf_dir):
    """Names of one source in the order in which they are first seen."""
    s = F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_suppkey") % 5).alias("s"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_distinct(F.transform(s, lambda x: x["s"])).alias("names"))


_PAIRS, _pairs = over("lineitem", id="l_orderkey * 10 + l_linenumber", source="l_partkey % 6", target="l_suppkey % 7", gone="l_linenumber = 5", routes="l_linenumber - 3", resolved="l_orderkey % 4", strong="l_partkey % 5", kept="l_suppkey % 3")
_RATIO = "CASE WHEN NOT gone THEN (target + 1)::DOUBLE / greatest(source + 1 - 2 * greatest(routes, 0), 1) END"


def _ratio():
    return F.when(~F.col("gone"), A.weight_ratio((F.col("source") + 1).cast("double"), (F.col("target") + 1).cast("double"), F.col("routes")))


@query("normalised_ratio", f"SELECT id, {_RATIO} AS ratio FROM {_PAIRS}")
def normalised_ratio(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", _ratio().alias("ratio"))


@query("matched_status", f"SELECT id, CASE WHEN gone THEN 'NOT_PORTED' WHEN r > 2 THEN 'EXPANDED' WHEN r < 0.4 THEN CASE WHEN source > 0 AND resolved >= source OR source = 0 AND resolved > 0 THEN 'PARITY' ELSE 'REDUCED' END WHEN strong > 2 AND kept = 0 AND target > 0 THEN 'REDUCED' ELSE 'PARITY' END AS status FROM (SELECT *, {_RATIO} AS r FROM {_PAIRS})")
def matched_status(spark, sf_dir):
    c = F.col
    return _pairs(spark, sf_dir).select("id", A.parity_of(_ratio(), c("source"), c("target"), c("resolved"), c("strong"), c("kept")).alias("status"))


@query("file_status", f"SELECT id, CASE WHEN target = 0 THEN 'EMPTY' WHEN target > source THEN 'EXPANDED' WHEN target < source OR resolved = 0 THEN 'SHRUNK' ELSE 'PARITY' END AS status FROM {_PAIRS}")
def file_status(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", A.file_status(F.col("source"), F.col("target"), F.col("resolved") > 0).alias("status"))


@query("novel_names", "SELECT l_orderkey, count(*) AS n FROM lineitem x WHERE NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_linenumber <= 2 AND y.l_suppkey % 10 = x.l_suppkey % 10) GROUP BY 1")
def novel_names(spark, sf_dir):
    """Tests whose name no matched one has: by name, so that equal names go together."""
    t = rows(spark, sf_dir, "lineitem", l_orderkey="l_orderkey", name="l_suppkey % 10", line="l_linenumber")
    matched = t.filter("line <= 2").select("l_orderkey", "name").distinct()
    return t.join(matched, ["l_orderkey", "name"], "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


_OWN, _own = over("part", file="p_partkey % 60", name="concat('n', p_size)")
_STAR, _star = over("supplier", file="s_suppkey % 60", target="(s_suppkey * 7 + 1) % 60")


@query("star_exports", f"WITH RECURSIVE r(file, node) AS (SELECT file, target FROM {_STAR} UNION SELECT r.file, s.target FROM r JOIN {_STAR} s ON s.file = r.node) SELECT file, name FROM {_OWN} UNION SELECT r.file, o.name FROM r JOIN {_OWN} o ON o.file = r.node")
def star_exports(spark, sf_dir):
    return A.star_exports(_own(spark, sf_dir), _star(spark, sf_dir))


@query("gap_rows", "SELECT event_id, concat('| ', strftime(ts, '%Y-%m-%d'), ' | ', event_type, ' | (auto-logged) | ', event_type, ' | open |') AS row FROM events")
def gap_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", A.gap_row(F.col("ts"), F.col("event_type")).alias("row"))


_SKILLS, _skills = over("part", id="p_partkey", name="concat(CASE p_size % 6 WHEN 0 THEN 'build-' WHEN 1 THEN 'refactor-' WHEN 2 THEN 'audit-' WHEN 3 THEN 'orchestrate-' WHEN 4 THEN 'rebuild-' ELSE 'build' END, 'x')")


@query("skill_categories", f"SELECT id, CASE WHEN starts_with(name, 'build-') THEN 'build' WHEN starts_with(name, 'refactor-') THEN 'refactor' WHEN starts_with(name, 'audit-') THEN 'audit' WHEN starts_with(name, 'orchestrate-') THEN 'orchestrate' ELSE 'other' END AS category FROM {_SKILLS}")
def skill_categories(spark, sf_dir):
    return _skills(spark, sf_dir).select("id", A.skill_category(F.col("name")).alias("category"))


@query("structural_kinds", f"SELECT id, CASE WHEN c = 0 AND h = 0 THEN 'utility' WHEN c = 0 THEN 'hook' WHEN h > 0 AND path LIKE '%/use%' THEN 'hook' WHEN h = 0 THEN 'component' ELSE 'mixed' END AS kind FROM (SELECT id, path, id % 3 AS c, line % 2 AS h FROM {PARTS})")
def structural_kinds(spark, sf_dir):
    return parts(spark, sf_dir).select("id", A.structural_kind(F.col("path"), F.col("id") % 3, F.col("line") % 2).alias("kind"))


_SHOWN, _shown = over("part", id="p_partkey", path=PATH, fn="CASE p_partkey % 5 WHEN 0 THEN 'renderTable' WHEN 1 THEN 'ProgressCell' WHEN 2 THEN 'toolbar' WHEN 3 THEN 'other' END")


@query("percentage_context", f"SELECT id, coalesce(f, p, 'unknown') AS context, CASE WHEN f IS NOT NULL AND p IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence FROM (SELECT id, CASE fn WHEN 'renderTable' THEN 'table' WHEN 'ProgressCell' THEN 'progressBar' WHEN 'toolbar' THEN 'spaceConstrained' END AS f, CASE WHEN path LIKE '%PanelTable%' THEN 'table' WHEN path LIKE '%ProgressBar%' THEN 'progressBar' WHEN path LIKE '%StackedBar%' THEN 'spaceConstrained' WHEN path LIKE '%ChartTip%' THEN 'chartTooltip' END AS p FROM {_SHOWN})")
def percentage_context(spark, sf_dir):
    context, confidence = A.percentage_context(F.col("fn"), F.col("path"))
    return _shown(spark, sf_dir).select("id", context.alias("context"), confidence.alias("confidence"))


@query("verdict_codes", "SELECT c_custkey, CASE WHEN c_custkey % 101 < 70 THEN 2 WHEN c_nationkey > 15 OR c_custkey % 101 < 90 THEN 1 ELSE 0 END AS code FROM customer")
def verdict_codes(spark, sf_dir):
    c = rows(spark, sf_dir, "customer", c_custkey="c_custkey", score="c_custkey % 101", dropped="greatest(c_nationkey - 15, 0)")
    return c.select("c_custkey", A.verdict_code(F.col("score"), F.col("dropped")).alias("code"))


_CATCH, _catch = over("lineitem", file="l_orderkey", line="l_linenumber", rethrows="l_partkey % 7 = 0", reports="l_partkey % 5 = 0", logs="l_suppkey % 4 = 0", responds="l_suppkey % 9 = 0", calls_back="l_suppkey % 11 = 0")


@query("catch_sinks", f"WITH s AS (SELECT file, line, CASE WHEN rethrows THEN 'rethrow' WHEN reports THEN 'newrelic' WHEN logs THEN 'console' WHEN responds THEN 'response' WHEN calls_back THEN 'callback' END AS sink FROM {_CATCH}) SELECT file, line, sink FROM s WHERE sink IS NOT NULL UNION ALL SELECT file, min(line), 'swallowed' FROM s GROUP BY file HAVING count(sink) = 0")
def catch_sinks(spark, sf_dir):
    return A.sinks_of(_catch(spark, sf_dir), ["file"])


@query("mean_difference", "SELECT c_mktsegment, avg(CASE WHEN c_nationkey < 10 THEN c_acctbal END) - avg(CASE WHEN c_nationkey >= 10 THEN c_acctbal END) AS difference FROM customer GROUP BY 1")
def mean_difference(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_mktsegment")
    return c.agg((F.avg(F.when(F.col("c_nationkey") < 10, F.col("c_acctbal"))) - F.avg(F.when(F.col("c_nationkey") >= 10, F.col("c_acctbal")))).alias("difference"))


@query("evidence_pairs", "SELECT l_orderkey, count(*) AS n FROM (SELECT DISTINCT l_orderkey, unnest(['k=' || l_returnflag, 's=' || l_linestatus, 'p=' || (l_partkey % 9)]) AS e FROM lineitem) WHERE e IN ('k=R', 's=O', 'p=3', 'p=4') GROUP BY 1 HAVING count(*) FILTER (WHERE e IN ('k=R', 's=O')) = 2")
def evidence_pairs(spark, sf_dir):
    """Evidence exploded into k=v, and groups whose pairs hold all wanted ones."""
    l = table(spark, sf_dir, "lineitem")
    e = l.select("l_orderkey", F.explode(F.array(F.concat(F.lit("k="), "l_returnflag"), F.concat(F.lit("s="), "l_linestatus"), F.concat(F.lit("p="), F.col("l_partkey") % 9))).alias("e")).distinct()
    e = e.filter(F.col("e").isin("k=R", "s=O", "p=3", "p=4")).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("e").isin("k=R", "s=O")).alias("must"))
    return e.filter("must = 2").select("l_orderkey", "n")
