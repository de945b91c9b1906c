"""Interpreters: ordered rule tables over grouped facts. Conditions are SQL that
Spark and other engines read alike; :func:`interpret` compiles a table into one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.operators.rules import Rule, cascade

#: One row per effect: flags and counts of what its body does.
EFFECTS = (
    Rule("DERIVED_STATE", "n_setters > 0 AND n_deps > 0 AND NOT has_fetch AND NOT has_timer AND NOT has_dom AND NOT has_storage AND NOT has_cleanup AND reads_only_deps", "high", "sets state from its own dependencies"),
    Rule("DERIVED_STATE", "setter_mirrors_prop", "high", "copies a prop into state"),
    Rule("EVENT_HANDLER_DISGUISED", "has_toast AND n_deps > 0 AND NOT has_fetch", "medium", "reacts to a value with a message"),
    Rule("EVENT_HANDLER_DISGUISED", "has_navigation AND n_deps > 0 AND NOT has_cleanup", "medium", "navigates when a value changes"),
    Rule("TIMER_RACE", "has_timer AND NOT has_cleanup", "high", "a timer is never cleared", manual=True),
    Rule("DOM_EFFECT", "touches_ref OR has_dom", "high", "works on the document"),
    Rule("NECESSARY", "n_deps = 0 AND has_cleanup", "high", "runs once and cleans up"),
    Rule("EXTERNAL_SUBSCRIPTION", "has_cleanup", "high", "subscribes and cleans up"),
    Rule("NECESSARY", "has_fetch OR has_storage", "medium", "reads or writes outside the component"),
)
#: One row per hook call: its name and where it is imported from.
HOOKS = (
    Rule("REACT_BUILTIN", "is_builtin", "high"),
    Rule("LIKELY_AMBIENT_HOOK", "is_ambient", "high"),
    Rule("LIKELY_CONTEXT_HOOK", "name LIKE 'use%Scope' AND length(name) > 8", "high", "named as a scope"),
    Rule("LIKELY_SERVICE_HOOK", "import_source LIKE '%/services/%' OR import_source LIKE '%/queries/%'", "high", "imported from a service"),
    Rule("LIKELY_CONTEXT_HOOK", "import_source LIKE '%/context%' OR import_source LIKE '%/providers/%'", "high", "imported from a provider"),
    Rule("LIKELY_AMBIENT_HOOK", "import_source LIKE '%dom-utils%'", "medium", "imported from document helpers"),
    Rule("LIKELY_SERVICE_HOOK", "name LIKE 'use%Query' OR name LIKE 'use%Mutation'", "medium", "named as a query", candidate=True),
    Rule("LIKELY_CONTEXT_HOOK", "name LIKE 'use%Context'", "medium", "named as a context", candidate=True),
    Rule("LIKELY_STATE_HOOK", "name LIKE 'use%State' OR name LIKE 'use%Store'", "medium", "named as state", candidate=True),
    Rule("UNKNOWN_HOOK", "name LIKE 'use%'", "low", "nothing tells what it is", manual=True),
)
OWNERSHIP = (
    Rule("LAYOUT_SHELL", "is_layout", "high"),
    Rule("CONTAINER", "signals >= 3", "high"),
    Rule("CONTAINER", "signals = 2", "medium", candidate=True),
    Rule("DDAU_COMPONENT", "n_props > 0 AND n_container_hooks = 0 AND n_side_effects = 0", "high"),
    Rule("DDAU_COMPONENT", "n_props > 0 AND n_container_hooks = 0", "medium"),
    Rule("LEAF_VIOLATION", "n_container_hooks > 0 AND is_leaf", "high"),
    Rule("AMBIGUOUS", "true", "low", manual=True),
)
EXTRACTION = (
    Rule("EXTRACTION_CANDIDATE", "return_lines > 150 OR n_iife > 0", "high"),
    Rule("EXTRACTION_CANDIDATE", "return_lines > 100 OR (n_ternaries >= 2 AND depth >= 2)", "medium"),
)
HOTSPOT = (
    Rule("COMPLEXITY_HOTSPOT", "n_kinds >= 4", "high"),
    Rule("COMPLEXITY_HOTSPOT", "n_kinds = 3 AND has_substantive", "medium"),
    Rule("COMPLEXITY_HOTSPOT", "handler_statements >= 4", "medium"),
)
DEAD_CODE = (
    Rule("DEAD_EXPORT", "n_consumers = 0 AND NOT dynamic", "high"),
    Rule("POSSIBLY_DEAD_EXPORT", "n_consumers = 0", "medium", candidate=True),
    Rule("CIRCULAR_DEPENDENCY", "in_cycle", "high"),
    Rule("DEAD_BARREL_REEXPORT", "is_reexport AND n_outside = 0", "medium"),
    Rule("FRAGILE_EXPORT", "n_consumers = 1", "low", candidate=True),
)
DISPLAY = (
    Rule("WRONG_PLACEHOLDER", "placeholder IN ('N/A', 'n/a', '--', '–', '-')", "high"),
    Rule("MISSING_PLACEHOLDER", "is_nullable AND placeholder IS NULL AND in_cell", "medium", candidate=True),
    Rule("FALSY_COALESCE_NUMERIC", "operator = '||' AND is_numeric", "high"),
    Rule("HARDCODED_DASH", "is_dash_literal", "medium"),
    Rule("ZERO_NULL_CONFLATION", "truthy_test AND is_numeric", "high"),
    Rule("WRONG_EMPTY_MESSAGE", "is_empty_message AND NOT is_standard_message", "medium"),
    Rule("RAW_FORMAT_BYPASS", "raw_format", "high"),
    Rule("PERCENTAGE_PRECISION_MISMATCH", "is_percentage AND decimals <> expected_decimals", "high"),
)
MOCKS = (
    Rule("MOCK_BOUNDARY_COMPLIANT", "is_boundary_package", "high"),
    Rule("MOCK_BOUNDARY_COMPLIANT", "is_boundary_path", "high"),
    Rule("MOCK_THIRD_PARTY", "target NOT LIKE '.%' AND target NOT LIKE '@/%'", "medium"),
    Rule("MOCK_INTERNAL_VIOLATION", "exports_hook", "high", "mocks its own hook"),
    Rule("MOCK_DOMAIN_BOUNDARY", "exports_domain", "medium"),
    Rule("MOCK_INTERNAL_VIOLATION", "exports_component", "high", "mocks its own component"),
    Rule("MOCK_INTERNAL_VIOLATION", "resolved", "medium"),
    Rule("MOCK_UNRESOLVED", "true", "low", manual=True),
)
STRATEGY = (
    Rule("playwright", "has_playwright", "high"),
    Rule("integration-providers", "has_render AND has_provider", "high"),
    Rule("unit-render", "has_render", "high"),
    Rule("unit-pure", "has_provider", "medium"),
    Rule("unit-pure", "true", "high"),
)
BRANCHES = (
    Rule("NULL_COALESCE", "operator = '??'", "high"),
    Rule("FLAG_GATE", "reads_flag", "high"),
    Rule("NULL_CHECK", "compares_null", "high"),
    Rule("TYPE_DISPATCH", "compares_discriminant", "high"),
    Rule("ERROR_CHECK", "names_error", "high"),
    Rule("DATA_GUARD", "negates_data", "medium"),
    Rule("LOADING_CHECK", "names_loading", "medium"),
    Rule("BOOLEAN_STATE", "names_boolean", "medium"),
    Rule("OTHER", "true", "low"),
)
INTENT = (
    Rule("PRESERVED", "similarity >= 0.8", "high"),
    Rule("CHANGED", "similarity >= 0.6", "medium"),
    Rule("ADDED", "before_line IS NULL", "high"),
    Rule("INTENTIONALLY_REMOVED", "flagged_location", "high"),
    Rule("INTENTIONALLY_REMOVED", "flagged_kind", "low", candidate=True),
    Rule("INTENTIONALLY_REMOVED", "expected_removal", "low", candidate=True),
    Rule("ACCIDENTALLY_DROPPED", "true", "high", manual=True),
)
UNIT_PARITY = (
    Rule("EXPANDED", "source_weight = 0 AND target_weight > 0", "high"),
    Rule("PARITY", "source_weight = 0", "high"),
    Rule("NOT_PORTED", "target_weight IS NULL", "high"),
    Rule("EXPANDED", "10 * target_weight > 12 * source_weight", "high"),
    Rule("REDUCED", "10 * target_weight < 8 * source_weight", "high"),
    Rule("PARITY", "true", "high"),
)
COVERAGE = (
    Rule("TESTED", "has_dedicated_spec", "high"),
    Rule("INDIRECTLY_TESTED", "n_indirect_specs > 0", "medium"),
    Rule("UNTESTED", "true", "high"),
)
#: One row per finding: ``sub_kind`` of a bug, ``metric`` of a hotspot, ``risk`` of a test gap,
#: ``confidence`` of an internal mock, ``is_type_only`` of a ring. What no rule fits is P4.
PRIORITY = (
    Rule("P1", "finding = 'bug' AND sub_kind IN ('authz', 'crash', 'CVE-critical')"),
    Rule("P2", "finding = 'bug'"),
    Rule("P1", "finding = 'complexity-hotspot' AND metric >= 25"),
    Rule("P2", "finding = 'complexity-hotspot' AND metric >= 15"),
    Rule("P3", "finding = 'complexity-hotspot'"),
    Rule("P2", "finding = 'test-gap' AND risk = 'HIGH'"),
    Rule("P4", "finding = 'test-gap' AND risk = 'LOW'"),
    Rule("P3", "finding = 'test-gap'"),
    Rule("P3", "finding = 'mock-internal' AND confidence = 'high'"),
    Rule("P5", "finding = 'circular-dep' AND is_type_only"),
    Rule("P1", "finding IN ('RAW_ROLE_CHECK', 'RAW_ROLE_EQUALITY')"),
    Rule("P2", "finding = 'trust-boundary-gap'"),
    Rule("P3", "finding IN ('cross-domain-coupling', 'ddau-violation', 'eliminable-effect')"),
    Rule("P5", "finding = 'style'"),
)
#: One row per statement of a catch; :func:`factline.operators.audit.sinks_of` gives a catch all of its sinks.
ERROR_SINK = (
    Rule("rethrow", "rethrows", "high"),
    Rule("newrelic", "reports", "high"),
    Rule("console", "logs", "high"),
    Rule("response", "responds", "high"),
    Rule("callback", "calls_back", "medium"),
    Rule("swallowed", "true", "high", manual=True),
)
ERROR_HANDLED = (
    Rule("HANDLED", "is_mutation AND (on_error OR reads_error OR toast_on_error OR try_catch)", "high"),
    Rule("HANDLED", "NOT is_mutation AND (reads_error OR on_error OR has_boundary)", "high"),
    Rule("UNHANDLED", "true", "high"),
)
CONCERNS = (
    Rule("not-applicable", "concern = 'permission' AND NOT applicable", "high"),
    Rule("not-applicable", "concern = 'loading' AND mutation_only", "high"),
    Rule("handled", "signal", "high"),
    Rule("missing", "true", "medium"),
)
PLAN = (
    Rule("BLOCKED", "n_blockers > 0"),
    Rule("CERTIFIED", "score >= 90"),
    Rule("CONDITIONAL", "score >= 60"),
    Rule("BLOCKED", "true"),
)
SKILL = (
    Rule("STALE_PATH", "kind_of = 'path' AND resolves = false", "high"),
    Rule("BROKEN_CROSS_REF", "kind_of = 'ref' AND resolves = false", "high"),
    Rule("UNKNOWN_COMMAND", "kind_of = 'command' AND command_class = 'other'", "low"),
    Rule("MISSING_SECTION", "kind_of = 'section' AND resolves = false", "medium"),
    Rule("DRIFT", "kind_of = 'convention' AND n_superseded > 0", "high"),
    Rule("ALIGNED", "kind_of = 'convention' AND n_current > 0", "high"),
)

TABLES = {
    "effects": EFFECTS, "hooks": HOOKS, "ownership": OWNERSHIP, "extraction": EXTRACTION, "hotspot": HOTSPOT, "dead_code": DEAD_CODE, "display": DISPLAY, "mocks": MOCKS, "strategy": STRATEGY, "branches": BRANCHES,
    "intent": INTENT, "unit_parity": UNIT_PARITY, "coverage": COVERAGE, "priority": PRIORITY, "error_sink": ERROR_SINK, "error_handled": ERROR_HANDLED, "concerns": CONCERNS, "plan": PLAN, "skill": SKILL,
}


def interpret(df: DataFrame, table: str, default: Rule | None = None) -> DataFrame:
    """Assessments of the named rule table; a row that several rules fit has
    ``near_boundary`` set."""
    out = cascade(df, TABLES[table], default)
    return out.withColumn("near_boundary", F.size(F.array_distinct("matched")) > 1)
