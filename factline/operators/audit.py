"""What an audit derives from facts: tracks, layers, groups, evidence, coverage, parity and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BFF = ("src/pages/api/", "src/server/")
#: Layers by what a path holds, the first that fits.
LAYERS = (("test", ("__tests__/", ".spec.")), ("fixture", ("fixtures/", ".fixture.")), ("bff", ("src/server/", "src/pages/api/")), ("shared", ("src/shared/",)))
CATEGORIES = {
    "Architecture": ("branded-type-gap", "circular-dep", "complexity-hotspot", "cross-domain-coupling", "ddau-violation", "dead-export", "eliminable-effect", "handler-inline-logic", "missing-concern"),
    "Bug": ("RAW_ROLE_CHECK", "RAW_ROLE_EQUALITY", "as-any", "non-null-assertion", "trust-boundary-gap"),
    "Testing": ("mock-internal", "test-gap"),
}
_effect = "LOCATION DEP_ENTRY STATE_SETTER_CALL FETCH_CALL TIMER_CALL NAVIGATION_CALL STORAGE_CALL TOAST_CALL CLEANUP_PRESENT ASYNC_CALL PROP_READ CONTEXT_READ REF_TOUCH DOM_API BODY_DEP_CALL"
_jsx = "TERNARY_CHAIN GUARD_CHAIN TRANSFORM_CHAIN IIFE INLINE_HANDLER INLINE_STYLE COMPLEX_CLASSNAME RETURN_BLOCK"
#: Groups of observation kinds; others belong to none.
GROUPS = {
    "effect": tuple(f"EFFECT_{x}" for x in _effect.split()),
    "hook": ("HOOK_CALL", "HOOK_IMPORT", "HOOK_DEFINITION"),
    "component": ("COMPONENT_DECLARATION", "PROP_FIELD"),
    "sideEffect": tuple(f"{x}_CALL" for x in ("CONSOLE", "TOAST", "TIMER", "POSTHOG")) + ("WINDOW_MUTATION",),
    "jsx": tuple(f"JSX_{x}" for x in _jsx.split()),
    "import": tuple(f"{x}_IMPORT" for x in ("STATIC", "DYNAMIC", "REEXPORT", "SIDE_EFFECT")) + ("EXPORT_DECLARATION", "CIRCULAR_DEPENDENCY", "DEAD_EXPORT_CANDIDATE"),
    "numberFormat": tuple(f"FORMAT_{x}_CALL" for x in ("NUMBER", "INT", "DURATION", "CELL_VALUE")) + ("RAW_TO_FIXED", "RAW_TO_LOCALE_STRING", "PERCENTAGE_DISPLAY", "INTL_NUMBER_FORMAT"),
    "nullDisplay": ("EMPTY_STATE_MESSAGE", "FALSY_COALESCE_FALLBACK", "HARDCODED_PLACEHOLDER", "NO_FALLBACK_CELL", "NULL_COALESCE_FALLBACK", "ZERO_CONFLATION"),
    "testCoverage": ("TEST_COVERAGE",),
}
#: Kinds that count in test files.
TEST_KINDS = tuple(sorted("TEST_SUBJECT_IMPORT TEST_HELPER_IMPORT TEST_BLOCK TEST_HELPER_DELEGATION MOCK_DECLARATION MOCK_TARGET_RESOLVED MOCK_INTERNAL SPY_DECLARATION ASSERTION_CALL IMPLEMENTATION_ASSERTION TIMER_NEGATIVE_ASSERTION RENDER_CALL PROVIDER_WRAPPER AFTER_EACH_BLOCK DESCRIBE_BLOCK CLEANUP_CALL MISSING_CLEANUP FIXTURE_IMPORT SHARED_MUTABLE_IMPORT DATA_SOURCING_VIOLATION SEQUENTIAL_MOCK_RESPONSE PLAYWRIGHT_IMPORT".split()))
_costs = {
    30: "PROMPT_DEPENDENCY_CYCLE PRE_FLIGHT_BLOCKED",
    20: "VERIFICATION_BLOCK_MISSING PROMPT_FILE_MISSING",
    10: "PROMPT_VERIFICATION_MISSING PRE_FLIGHT_MARK_MISSING CLEANUP_FILE_MISSING",
    8: "PRE_FLIGHT_CONDITIONAL PLAN_HEADER_MISSING",
    5: "CLIENT_SIDE_AGGREGATION PROMPT_MODE_UNSET RECONCILIATION_TEMPLATE_MISSING",
    3: "STANDING_ELEMENT_MISSING",
    1: "PLAN_HEADER_INVALID",
    0: "PLAN_PROMPT_COUNT PLAN_FILE_REFERENCE_DENSITY PROMPT_CHAIN_DEPTH PROMPT_FAN_OUT PROMPT_DEPENDENCY_EDGE_COUNT SKILL_REFERENCE FILE_PATH_REFERENCE DEFERRED_CLEANUP_REFERENCE NAMING_CONVENTION_INSTRUCTION PRE_FLIGHT_CERTIFIED",
}
#: What a plan's observation costs; unlisted kinds cost OTHER_WEIGHT.
PLAN_WEIGHTS = {k: cost for cost, kinds in _costs.items() for k in kinds.split()}
OTHER_WEIGHT = 5
PLAN_BLOCKERS = ("PROMPT_DEPENDENCY_CYCLE", "PROMPT_FILE_MISSING", "VERIFICATION_BLOCK_MISSING", "PRE_FLIGHT_BLOCKED")
SKILL_WEIGHTS = {"STALE_FILE_PATH": 5, "STALE_COMMAND": 5, "BROKEN_CROSS_REF": 5, "BROKEN_DOC_REF": 5, "MISSING_SECTION": 3, "CONVENTION_DRIFT": 10, "MISSING_SECTION_ROLE": 2, "ROLE_REQUIREMENT_MISSING": 3, "INVALID_ROLE_ANNOTATION": 5}
STRONG_MATCHERS = tuple(f"to{x}" for x in ("ContainText", "HaveAttribute", "HaveCount", "HaveText", "HaveValue"))
#: A function's name comes before its file's path; the first word found decides.
PERCENT_FUNCTIONS = (("table", ("table",)), ("progressBar", ("progress",)), ("spaceConstrained", ("stacked", "bar")))
PERCENT_PATHS = (("table", ("Table", "Column")), ("progressBar", ("ProgressBar",)), ("spaceConstrained", ("StackedBar",)), ("chartTooltip", ("Chart", "Tooltip")))


def holds_any(c: Column, parts: tuple[str, ...]) -> Column:
    """Whether a string holds one of some substrings; a null holds none."""
    return F.coalesce(reduce(lambda a, b: a | b, (F.contains(c, F.lit(p)) for p in parts)), F.lit(False))


def first_fit(c: Column, table: tuple[tuple[str, tuple[str, ...]], ...], other: str | None) -> Column:
    """The name of the first entry one of whose substrings ``c`` holds."""
    out = F.lit(other)
    for name, parts in reversed(table):
        out = F.when(holds_any(c, parts), F.lit(name)).otherwise(out)
    return out


def member(c: Column, table: dict[str, tuple[str, ...]], other: str | None) -> Column:
    """The name of the entry that lists ``c``."""
    out = F.lit(other)
    for name, kinds in reversed(table.items()):
        out = F.when(c.isin(*kinds), F.lit(name)).otherwise(out)
    return out


def track(path: Column) -> Column:
    return F.when(reduce(lambda a, b: a | b, (F.startswith(path, F.lit(p)) for p in BFF)), "bff").otherwise("fe")


def layer(path: Column) -> Column:
    return first_fit(path, LAYERS, "fe")


def category(finding: Column) -> Column:
    return F.when(F.startswith(finding, F.lit("bug")), "Bug").otherwise(member(finding, CATEGORIES, "Style"))


def group_of(kind: Column) -> Column:
    return member(kind, GROUPS, None)


def evidence(kind: Column, file: Column, line: Column, subject: Column, number: Column) -> Column:
    """An observation in words; ``subject`` and ``number`` are what its kind measures, if it does."""
    text = lambda c, other: F.coalesce(c.cast("string"), F.lit(other))
    return (
        F.when(kind == "FUNCTION_COMPLEXITY", F.concat(F.lit("CC="), text(number, "undefined"), F.lit(" in "), text(subject, "anonymous")))
        .when(kind == "TRUST_BOUNDARY_CAST", F.concat(F.lit("Trust boundary cast: "), text(subject, "unknown")))
        .when(kind == "RAW_ROLE_CHECK", F.lit("Raw role check outside canonical files"))
        .when(kind == "RAW_ROLE_EQUALITY", F.lit("Raw role equality outside canonical files"))
        .when(kind == "HANDLER_INLINE_LOGIC", F.concat(F.lit("Inline handler logic ("), text(number, "?"), F.lit(" lines)")))
        .when(kind.isin("CONTAINER_MISSING_LOADING", "CONTAINER_MISSING_ERROR", "CONTAINER_MISSING_EMPTY"), F.concat(F.lit("Missing "), F.lower(F.element_at(F.split(kind, "_"), -1)), F.lit(" handling in container")))
        .otherwise(F.concat(kind, F.lit(" at "), file, F.lit(":"), text(line, "undefined")))
    )


def coverage(has_spec: Column, n_indirect: Column) -> Column:
    return F.when(has_spec, "TESTED").when(n_indirect > 0, "INDIRECTLY_TESTED").otherwise("UNTESTED")


def risk_class(score: Column, covered: Column, high: float = 3.0, medium: float = 1.2) -> Column:
    """Untested files by both thresholds; indirectly tested ones rise to MEDIUM at the high one only."""
    return (
        F.when((covered == "UNTESTED") & (score >= high), "HIGH")
        .when((covered == "UNTESTED") & (score >= medium), "MEDIUM")
        .when((covered == "INDIRECTLY_TESTED") & (score >= high), "MEDIUM")
        .otherwise("LOW")
    )


def gap_priority(risk: Column, covered: Column) -> Column:
    bare = covered == "UNTESTED"
    return F.when((risk == "HIGH") & bare, "P2").when(((risk == "MEDIUM") & bare) | ((risk == "HIGH") & (covered == "INDIRECTLY_TESTED")), "P3").otherwise("P4")


def emits_gap(covered: Column, risk: Column) -> Column:
    return (covered != "TESTED") & (risk != "LOW")


def weight_ratio(source: Column, target: Column, fewer_routes: Column | None = None) -> Column:
    """Target's weight to the source's; with a baseline of mock handlers, each route that
    the target needs no more takes 2 from the source, which keeps 1 at least."""
    return target / (source if fewer_routes is None else F.greatest(source - F.greatest(fewer_routes, F.lit(0)) * 2, F.lit(1)))


def parity_of(ratio: Column, source: Column, target: Column, resolved: Column, source_strong: Column, target_strong: Column) -> Column:
    """Status of a matched test (a null ratio: no target): assertions of either, those that the target's helpers
    resolve to, and strong matchers of either."""
    floor = ((source > 0) & (resolved >= source)) | ((source == 0) & (resolved > 0))
    lost = (source_strong > 2) & (target_strong == 0) & (target > 0)
    return F.when(ratio.isNull(), "NOT_PORTED").when(ratio > 2.0, "EXPANDED").when((ratio < 0.4) & floor, "PARITY").when((ratio < 0.4) | lost, "REDUCED").otherwise("PARITY")


def file_status(source: Column, target: Column, any_signal: Column) -> Column:
    plain = F.when(target == 0, "EMPTY").when(target > source, "EXPANDED").when(target < source, "SHRUNK").otherwise("PARITY")
    return F.when(~any_signal & (plain == "PARITY"), "SHRUNK").otherwise(plain)


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def test_scores(tests: DataFrame, by: str) -> DataFrame:
    """Per group: score of tests (status, weight, skipped): all of the weight of PARITY and EXPANDED,
    half of REDUCED; skipped ones don't count, all skipped is 100, and none is 0."""
    w, s = F.when(~F.col("skipped"), F.col("weight")).otherwise(F.lit(0)), F.col("status")
    got = F.sum(w * F.when(s.isin("PARITY", "EXPANDED"), 1.0).when(s == "REDUCED", 0.5).otherwise(0.0))
    score = F.when(F.sum(w) > 0, _half_up(got / F.sum(w) * 100)).when(F.bool_or("skipped"), 100).otherwise(0).cast("int")
    return tests.groupBy(by).agg(score.alias("score"), F.sum(w).alias("total"), got.alias("matched"))


def unit_scores(tests: DataFrame, by: str) -> DataFrame:
    """Per group: score of tests (status, source, target: assertions), REDUCED ones by the share of
    assertions that is left, to one decimal."""
    w, s = F.greatest(F.col("source"), F.lit(1)).cast("double"), F.col("status")
    part = F.when(s.isin("PARITY", "EXPANDED"), w).when(s == "REDUCED", F.when(F.col("source") > 0, F.col("target") / F.col("source") * w).otherwise(w)).otherwise(0.0)
    n = lambda x: F.count_if(s == x)
    score = F.when(F.sum(w) > 0, _half_up(F.sum(part) / F.sum(w) * 1000) / 10).otherwise(0.0)
    return tests.groupBy(by).agg(F.sum(w).alias("total"), (_half_up(F.sum(part) * 10) / 10).alias("matched"), n("PARITY").alias("parity"), n("REDUCED").alias("reduced"), n("EXPANDED").alias("expanded"), n("NOT_PORTED").alias("not_ported"), score.alias("score"))


def weighted_score(kind: Column, weights: dict[str, int], other: int) -> Column:
    """100 less what the kinds of a group cost, 0 at least."""
    cost = F.lit(other)
    for k, w in weights.items():
        cost = F.when(kind == k, F.lit(w)).otherwise(cost)
    return F.greatest(F.lit(0).cast("long"), 100 - F.sum(cost)).cast("int")


def skill_category(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, "^(build|refactor|audit|orchestrate)-", 1), F.lit("")), F.lit("other"))


def structural_kind(path: Column, components: Column, hooks: Column) -> Column:
    named = path.rlike("/use[A-Z]")
    return F.when((components == 0) & (hooks == 0), "utility").when((hooks > 0) & ((components == 0) | named), "hook").when(hooks == 0, "component").otherwise("mixed")


def percentage_context(function: Column, path: Column) -> tuple[Column, Column]:
    """The context that a percentage is shown in, and "high" where function and path both tell one."""
    f, p = first_fit(F.lower(function), PERCENT_FUNCTIONS, None), first_fit(path, PERCENT_PATHS, None)
    return F.coalesce(f, p, F.lit("unknown")), F.when(f.isNotNull() & p.isNotNull(), "high").otherwise("medium")


def container_signals(services: Column, contexts: Column, routers: Column, toasts: Column, suffix: Column, folder: Column) -> Column:
    """Signals that a component is a container; several services are one more."""
    return reduce(lambda a, b: a + b, (x.cast("int") for x in (services > 0, contexts > 0, routers > 0, toasts > 0, suffix, folder, services >= 2)))


def component_groups(observations: DataFrame) -> DataFrame:
    """Template facts by file and component: kind, lines (of a return block), depth (of a ternary), statements (of a handler)."""
    kind = F.col("kind")
    most = lambda k, c: F.coalesce(F.max(F.when(kind == k, F.coalesce(F.col(c), F.lit(0)))), F.lit(0))
    return observations.groupBy("file", "component").agg(most("JSX_RETURN_BLOCK", "lines").alias("return_lines"), F.count_if(kind == "JSX_TERNARY_CHAIN").alias("n_ternaries"), most("JSX_TERNARY_CHAIN", "depth").alias("depth"), F.bool_or(kind == "JSX_IIFE").alias("has_iife"), most("JSX_INLINE_HANDLER", "statements").alias("handler_statements"), F.countDistinct("kind").alias("n_kinds"))


def sinks_of(flags: DataFrame, by: list[str]) -> DataFrame:
    """Every sink of every catch, in order of its statements: ``reports``, ``logs``, ``responds`` and
    ``calls_back`` (the first that holds is a statement's) or ``rethrows``; a catch without any has "swallowed"."""
    sink = F.when(F.col("rethrows"), "rethrow").when(F.col("reports"), "newrelic").when(F.col("logs"), "console").when(F.col("responds"), "response").when(F.col("calls_back"), "callback")
    found = flags.select(*by, "line", sink.alias("sink"))
    none = found.groupBy(*by).agg(F.max("sink").alias("sink"), F.min("line").alias("line")).filter("sink IS NULL").select(*by, "line", F.lit("swallowed").alias("sink"))
    return found.filter("sink IS NOT NULL").unionByName(none)


def dead_export_chain(exports: DataFrame, edges: DataFrame, reexports: DataFrame) -> DataFrame:
    """Exports (file, name) that nothing uses: none of the edges (src, dst, name) names them or all of their
    file ("*", "* as x"; any name, for a default), and no barrel (``index.*``) that imports the file passes them on
    (``reexports``: file, name; "* from x" passes all). Pages, and exports that are passed on themselves, are not looked at."""
    own = exports.filter(~F.col("file").rlike(r"(^|/)pages/") & ~F.col("is_reexport") & ~F.col("name").startswith("* from "))
    use = edges.select(F.col("dst").alias("file"), "name").distinct()
    left = own.join(use, ["file", "name"], "left_anti")
    whole = use.filter((F.col("name") == "*") | F.col("name").startswith("* as ")).select("file").distinct()
    left = left.join(whole, "file", "left_anti")
    default = use.select("file").distinct().withColumn("name", F.lit("default"))
    left = left.join(default, ["file", "name"], "left_anti")
    barrel = edges.filter(F.col("src").rlike(r"(^|/)index\.[jt]sx?$")).select(F.col("src").alias("b"), F.col("dst").alias("file")).distinct()
    passed = barrel.join(reexports.select(F.col("file").alias("b"), "name"), "b").select("file", "name").distinct()
    left = left.join(passed, ["file", "name"], "left_anti")
    return left.join(passed.filter(F.col("name").startswith("* from ")).select("file").distinct(), "file", "left_anti")


def scoped(tests: DataFrame, mocks: DataFrame, on: list[str], scope: str) -> DataFrame:
    """Mocks of each test: those of its own scope and those without one. Two equi-joins, not one with an OR."""
    anywhere = tests.join(mocks.filter(F.col(scope).isNull()).drop(scope), on)
    return anywhere.unionByName(tests.join(mocks, [*on, scope]), allowMissingColumns=True)


def star_exports(exports: DataFrame, stars: DataFrame) -> DataFrame:
    """Names that a file offers: its own (file, name) and those of the files that it passes on whole
    (``stars``: file, target), at any distance; rings end where nothing new comes."""
    from factline.operators.graph import reach

    hops = reach(stars.select(F.col("file").alias("src"), F.col("target").alias("dst")).distinct(), stars.select(F.col("file").alias("node")).distinct())
    passed = hops.join(exports.select(F.col("file").alias("node"), "name"), "node").select(F.col("root").alias("file"), "name")
    return exports.select("file", "name").unionByName(passed).distinct()


def verdict_code(score: Column, dropped: Column) -> Column:
    return F.when(score < 70, 2).when((dropped > 0) | (score < 90), 1).otherwise(0)


def gap_row(day: Column, kind: Column) -> Column:
    """A line of the log of unknown queries."""
    return F.concat(F.lit("| "), F.date_format(day, "yyyy-MM-dd"), F.lit(" | "), kind, F.lit(" | (auto-logged) | "), kind, F.lit(" | open |"))
