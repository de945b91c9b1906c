"""Every rule table over flags derived from the fixed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factline.operators.interpret import TABLES, interpret
from factline.operators.rules import Rule
from factline.plans.registry import query, table

#: table -> source, id and the inputs that its conditions name, as SQL for either engine.
INPUTS: dict[str, tuple[str, str, dict[str, str]]] = {
    "effects": ("orders", "o_orderkey", {"n_setters": "o_custkey % 3", "n_deps": "o_orderkey % 4", "has_fetch": "o_custkey % 5 = 0", "has_timer": "o_custkey % 7 = 1", "has_dom": "o_custkey % 11 = 3", "has_storage": "o_custkey % 13 = 2", "has_cleanup": "o_orderkey % 3 = 0", "reads_only_deps": "o_custkey % 2 = 0", "setter_mirrors_prop": "o_custkey % 17 = 0", "has_toast": "o_custkey % 6 = 5", "has_navigation": "o_custkey % 9 = 4", "touches_ref": "o_orderkey % 10 = 7"}),
    "hooks": ("part", "p_partkey", {"name": "concat('use', CASE p_partkey % 6 WHEN 0 THEN 'TeamQuery' WHEN 1 THEN 'AuthContext' WHEN 2 THEN 'PanelState' WHEN 3 THEN 'TeamScope' WHEN 4 THEN 'Thing' ELSE 'SaveMutation' END)", "import_source": "CASE p_size % 5 WHEN 0 THEN 'src/services/a' WHEN 1 THEN 'src/providers/b' WHEN 2 THEN 'lib/dom-utils' WHEN 3 THEN 'src/context/x' ELSE NULL END", "is_builtin": "p_partkey % 19 = 0", "is_ambient": "p_partkey % 23 = 0"}),
    "ownership": ("customer", "c_custkey", {"is_layout": "c_mktsegment = 'MACHINERY'", "signals": "c_custkey % 5", "n_props": "c_nationkey % 4", "n_container_hooks": "c_custkey % 3", "n_side_effects": "c_custkey % 2", "is_leaf": "c_acctbal > 0"}),
    "extraction": ("part", "p_partkey", {"return_lines": "p_size * 4", "n_iife": "p_partkey % 29", "n_ternaries": "p_partkey % 4", "depth": "p_size % 4"}),
    "hotspot": ("part", "p_partkey", {"n_kinds": "p_partkey % 6", "has_substantive": "p_size > 25", "handler_statements": "p_size % 7"}),
    "dead_code": ("supplier", "s_suppkey", {"n_consumers": "s_suppkey % 4", "dynamic": "s_nationkey % 2 = 0", "in_cycle": "s_suppkey % 7 = 0", "is_reexport": "s_suppkey % 3 = 0", "n_outside": "s_suppkey % 5"}),
    "display": ("lineitem", "l_orderkey * 10 + l_linenumber", {"placeholder": "CASE l_linenumber WHEN 1 THEN 'N/A' WHEN 2 THEN '-' WHEN 3 THEN 'none' END", "is_nullable": "l_quantity > 20", "in_cell": "l_tax > 0.04", "operator": "CASE WHEN l_discount > 0.05 THEN '||' ELSE '??' END", "is_numeric": "l_returnflag = 'R'", "is_dash_literal": "l_linestatus = 'O' AND l_quantity > 45", "truthy_test": "l_quantity < 10", "is_empty_message": "l_quantity > 40", "is_standard_message": "l_tax > 0.02", "raw_format": "l_quantity = 17", "is_percentage": "l_linestatus = 'F'", "decimals": "l_linenumber", "expected_decimals": "2"}),
    "mocks": ("part", "p_partkey", {"target": "CASE p_partkey % 4 WHEN 0 THEN './local' WHEN 1 THEN '@/shared' WHEN 2 THEN 'axios' ELSE '../up' END", "is_boundary_package": "p_partkey % 11 = 2", "is_boundary_path": "p_size = 3", "exports_hook": "p_size % 5 = 1", "exports_domain": "p_size % 7 = 2", "exports_component": "p_size % 3 = 0", "resolved": "p_size > 20"}),
    "strategy": ("customer", "c_custkey", {"has_playwright": "c_custkey % 7 = 0", "has_provider": "c_custkey % 2 = 0", "has_render": "c_custkey % 3 = 0"}),
    "branches": ("orders", "o_orderkey", {"operator": "CASE o_orderkey % 8 WHEN 0 THEN '??' ELSE '&&' END", "reads_flag": "o_custkey % 9 = 0", "compares_null": "o_custkey % 5 = 0", "compares_discriminant": "o_custkey % 7 = 0", "names_error": "o_orderstatus = 'P'", "negates_data": "o_orderkey % 6 = 1", "names_loading": "o_orderkey % 6 = 2", "names_boolean": "o_orderkey % 6 = 3"}),
    "intent": ("lineitem", "l_orderkey * 10 + l_linenumber", {"similarity": "CASE WHEN l_returnflag = 'N' THEN l_quantity / 50 END", "before_line": "CASE WHEN l_linenumber > 1 THEN l_linenumber END", "flagged_location": "l_quantity > 40", "flagged_kind": "l_tax > 0.06", "expected_removal": "l_discount > 0.08"}),
    "unit_parity": ("lineitem", "l_orderkey * 10 + l_linenumber", {"source_weight": "floor(l_quantity / 10)", "target_weight": "CASE WHEN l_linenumber <> 4 THEN l_quantity / 10 END"}),
    "coverage": ("part", "p_partkey", {"has_dedicated_spec": "p_size > 30", "n_indirect_specs": "p_partkey % 3"}),
    "priority": ("part", "p_partkey", {"finding": "CASE p_partkey % 12 WHEN 0 THEN 'bug' WHEN 1 THEN 'complexity-hotspot' WHEN 2 THEN 'test-gap' WHEN 3 THEN 'mock-internal' WHEN 4 THEN 'circular-dep' WHEN 5 THEN 'RAW_ROLE_CHECK' WHEN 6 THEN 'trust-boundary-gap' WHEN 7 THEN 'eliminable-effect' WHEN 8 THEN 'dead-export' WHEN 9 THEN 'style' WHEN 10 THEN 'as-any' ELSE 'new-kind' END", "metric": "p_size", "sub_kind": "CASE p_size % 4 WHEN 0 THEN 'authz' WHEN 1 THEN 'CVE-critical' WHEN 2 THEN 'CVE-high' END", "risk": "CASE p_size % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' END", "confidence": "CASE p_size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' END", "is_type_only": "p_size % 2 = 0"}),
    "error_sink": ("orders", "o_orderkey", {"reports": "o_custkey % 6 = 0", "logs": "o_custkey % 4 = 0", "responds": "o_custkey % 5 = 0", "calls_back": "o_custkey % 7 = 0", "rethrows": "o_custkey % 3 = 0"}),
    "error_handled": ("orders", "o_orderkey", {"is_mutation": "o_orderkey % 2 = 0", "on_error": "o_custkey % 5 = 0", "reads_error": "o_custkey % 3 = 0", "toast_on_error": "o_custkey % 7 = 0", "try_catch": "o_custkey % 11 = 0", "has_boundary": "o_custkey % 13 = 0"}),
    "concerns": ("orders", "o_orderkey", {"concern": "CASE o_orderkey % 4 WHEN 0 THEN 'loading' WHEN 1 THEN 'error' WHEN 2 THEN 'empty' ELSE 'permission' END", "applicable": "o_custkey % 2 = 0", "mutation_only": "o_custkey % 3 = 0", "signal": "o_custkey % 5 < 3"}),
    "plan": ("customer", "c_custkey", {"n_blockers": "CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END", "score": "c_custkey % 101"}),
    "skill": ("part", "p_partkey", {"kind_of": "CASE p_partkey % 5 WHEN 0 THEN 'path' WHEN 1 THEN 'ref' WHEN 2 THEN 'command' WHEN 3 THEN 'section' ELSE 'convention' END", "resolves": "p_size > 10", "command_class": "CASE WHEN p_size % 2 = 0 THEN 'other' ELSE 'git' END", "n_superseded": "p_size % 3", "n_current": "p_size % 2"}),
}
OTHER = Rule("NONE", "true", "low")
#: table -> its rules as a SQL expression of "KIND confidence", written by hand after the specification.
SQL: dict[str, str] = {
    "effects": """CASE WHEN n_setters >= 1 AND n_deps >= 1 AND reads_only_deps AND NOT (has_fetch OR has_timer OR has_dom OR has_storage OR has_cleanup) OR setter_mirrors_prop THEN 'DERIVED_STATE high'
        WHEN n_deps >= 1 AND (has_toast AND NOT has_fetch OR has_navigation AND NOT has_cleanup) THEN 'EVENT_HANDLER_DISGUISED medium' WHEN has_timer AND NOT has_cleanup THEN 'TIMER_RACE high' WHEN touches_ref OR has_dom THEN 'DOM_EFFECT high'
        WHEN has_cleanup THEN CASE n_deps WHEN 0 THEN 'NECESSARY high' ELSE 'EXTERNAL_SUBSCRIPTION high' END WHEN has_fetch OR has_storage THEN 'NECESSARY medium' END""",
    "hooks": """CASE WHEN is_builtin THEN 'REACT_BUILTIN high' WHEN is_ambient THEN 'LIKELY_AMBIENT_HOOK high' WHEN regexp_matches(name, '^use.+Scope$') THEN 'LIKELY_CONTEXT_HOOK high'
        WHEN regexp_matches(coalesce(import_source, ''), '/(services|queries)/') THEN 'LIKELY_SERVICE_HOOK high' WHEN regexp_matches(coalesce(import_source, ''), '/(context|providers/)') THEN 'LIKELY_CONTEXT_HOOK high' WHEN contains(coalesce(import_source, ''), 'dom-utils') THEN 'LIKELY_AMBIENT_HOOK medium'
        WHEN regexp_matches(name, '^use.*(Query|Mutation)$') THEN 'LIKELY_SERVICE_HOOK medium' WHEN regexp_matches(name, '^use.*Context$') THEN 'LIKELY_CONTEXT_HOOK medium' WHEN regexp_matches(name, '^use.*(State|Store)$') THEN 'LIKELY_STATE_HOOK medium' ELSE 'UNKNOWN_HOOK low' END""",
    "ownership": """CASE WHEN is_layout THEN 'LAYOUT_SHELL high' WHEN signals > 2 THEN 'CONTAINER high' WHEN signals = 2 THEN 'CONTAINER medium' WHEN n_props > 0 AND n_container_hooks = 0 THEN CASE n_side_effects WHEN 0 THEN 'DDAU_COMPONENT high' ELSE 'DDAU_COMPONENT medium' END
        WHEN n_container_hooks > 0 AND is_leaf THEN 'LEAF_VIOLATION high' ELSE 'AMBIGUOUS low' END""",
    "extraction": "CASE WHEN return_lines > 150 OR n_iife >= 1 THEN 'EXTRACTION_CANDIDATE high' WHEN return_lines > 100 OR least(n_ternaries, depth) >= 2 THEN 'EXTRACTION_CANDIDATE medium' END",
    "hotspot": "CASE WHEN n_kinds > 3 THEN 'COMPLEXITY_HOTSPOT high' WHEN n_kinds = 3 AND has_substantive OR handler_statements > 3 THEN 'COMPLEXITY_HOTSPOT medium' END",
    "dead_code": "CASE WHEN n_consumers = 0 THEN CASE WHEN dynamic THEN 'POSSIBLY_DEAD_EXPORT medium' ELSE 'DEAD_EXPORT high' END WHEN in_cycle THEN 'CIRCULAR_DEPENDENCY high' WHEN is_reexport AND n_outside = 0 THEN 'DEAD_BARREL_REEXPORT medium' WHEN n_consumers = 1 THEN 'FRAGILE_EXPORT low' END",
    "display": """CASE WHEN placeholder IN ('N/A', '-') THEN 'WRONG_PLACEHOLDER high' WHEN placeholder IS NULL AND is_nullable AND in_cell THEN 'MISSING_PLACEHOLDER medium' WHEN is_numeric AND operator = '||' THEN 'FALSY_COALESCE_NUMERIC high' WHEN is_dash_literal THEN 'HARDCODED_DASH medium'
        WHEN is_numeric AND truthy_test THEN 'ZERO_NULL_CONFLATION high' WHEN is_empty_message AND NOT is_standard_message THEN 'WRONG_EMPTY_MESSAGE medium' WHEN raw_format THEN 'RAW_FORMAT_BYPASS high' WHEN is_percentage AND decimals <> expected_decimals THEN 'PERCENTAGE_PRECISION_MISMATCH high' END""",
    "mocks": """CASE WHEN is_boundary_package OR is_boundary_path THEN 'MOCK_BOUNDARY_COMPLIANT high' WHEN NOT starts_with(target, '.') AND NOT starts_with(target, '@/') THEN 'MOCK_THIRD_PARTY medium' WHEN exports_hook THEN 'MOCK_INTERNAL_VIOLATION high'
        WHEN exports_domain THEN 'MOCK_DOMAIN_BOUNDARY medium' WHEN exports_component THEN 'MOCK_INTERNAL_VIOLATION high' WHEN resolved THEN 'MOCK_INTERNAL_VIOLATION medium' ELSE 'MOCK_UNRESOLVED low' END""",
    "strategy": "CASE WHEN has_playwright THEN 'playwright high' WHEN has_render THEN CASE WHEN has_provider THEN 'integration-providers high' ELSE 'unit-render high' END WHEN has_provider THEN 'unit-pure medium' ELSE 'unit-pure high' END",
    "branches": """CASE WHEN operator = '??' THEN 'NULL_COALESCE high' WHEN reads_flag THEN 'FLAG_GATE high' WHEN compares_null THEN 'NULL_CHECK high' WHEN compares_discriminant THEN 'TYPE_DISPATCH high' WHEN names_error THEN 'ERROR_CHECK high'
        WHEN negates_data THEN 'DATA_GUARD medium' WHEN names_loading THEN 'LOADING_CHECK medium' WHEN names_boolean THEN 'BOOLEAN_STATE medium' ELSE 'OTHER low' END""",
    "intent": "CASE WHEN similarity >= 0.8 THEN 'PRESERVED high' WHEN similarity >= 0.6 THEN 'CHANGED medium' WHEN before_line IS NULL THEN 'ADDED high' WHEN flagged_location THEN 'INTENTIONALLY_REMOVED high' WHEN flagged_kind OR expected_removal THEN 'INTENTIONALLY_REMOVED low' ELSE 'ACCIDENTALLY_DROPPED high' END",
    "unit_parity": "CASE WHEN source_weight = 0 THEN CASE WHEN coalesce(target_weight, 0) > 0 THEN 'EXPANDED high' ELSE 'PARITY high' END WHEN target_weight IS NULL THEN 'NOT_PORTED high' WHEN target_weight * 10 > source_weight * 12 THEN 'EXPANDED high' WHEN target_weight * 10 < source_weight * 8 THEN 'REDUCED high' ELSE 'PARITY high' END",
    "coverage": "CASE WHEN has_dedicated_spec THEN 'TESTED high' WHEN n_indirect_specs = 0 THEN 'UNTESTED high' ELSE 'INDIRECTLY_TESTED medium' END",
    "priority": """CASE finding WHEN 'bug' THEN CASE WHEN sub_kind IN ('authz', 'CVE-critical') THEN 'P1 high' ELSE 'P2 high' END WHEN 'complexity-hotspot' THEN CASE WHEN metric < 15 THEN 'P3 high' WHEN metric < 25 THEN 'P2 high' ELSE 'P1 high' END
        WHEN 'test-gap' THEN CASE risk WHEN 'HIGH' THEN 'P2 high' WHEN 'LOW' THEN 'P4 high' ELSE 'P3 high' END WHEN 'mock-internal' THEN CASE confidence WHEN 'high' THEN 'P3 high' END WHEN 'circular-dep' THEN CASE WHEN is_type_only THEN 'P5 high' END
        WHEN 'RAW_ROLE_CHECK' THEN 'P1 high' WHEN 'trust-boundary-gap' THEN 'P2 high' WHEN 'eliminable-effect' THEN 'P3 high' WHEN 'style' THEN 'P5 high' END""",
    "error_sink": "CASE WHEN rethrows THEN 'rethrow high' WHEN reports THEN 'newrelic high' WHEN logs THEN 'console high' WHEN responds THEN 'response high' WHEN calls_back THEN 'callback medium' ELSE 'swallowed high' END",
    "error_handled": "CASE WHEN on_error OR reads_error OR CASE WHEN is_mutation THEN toast_on_error OR try_catch ELSE has_boundary END THEN 'HANDLED high' ELSE 'UNHANDLED high' END",
    "concerns": "CASE WHEN concern = 'permission' AND NOT applicable OR concern = 'loading' AND mutation_only THEN 'not-applicable high' WHEN signal THEN 'handled high' ELSE 'missing medium' END",
    "plan": "CASE WHEN n_blockers > 0 OR score < 60 THEN 'BLOCKED high' WHEN score < 90 THEN 'CONDITIONAL high' ELSE 'CERTIFIED high' END",
    "skill": """CASE kind_of WHEN 'path' THEN CASE WHEN NOT resolves THEN 'STALE_PATH high' END WHEN 'ref' THEN CASE WHEN NOT resolves THEN 'BROKEN_CROSS_REF high' END WHEN 'command' THEN CASE command_class WHEN 'other' THEN 'UNKNOWN_COMMAND low' END
        WHEN 'section' THEN CASE WHEN NOT resolves THEN 'MISSING_SECTION medium' END WHEN 'convention' THEN CASE WHEN n_superseded > 0 THEN 'DRIFT high' WHEN n_current > 0 THEN 'ALIGNED high' END END""",
}


def _register(name: str) -> None:
    source, key, inputs = INPUTS[name]
    rows = f"SELECT {key} AS id, " + ", ".join(f"{sql} AS {c}" for c, sql in inputs.items()) + f" FROM {source}"

    @query(f"cascade_{name}", f"SELECT id, split_part(x, ' ', 1) AS kind, split_part(x, ' ', 2) AS confidence FROM (SELECT id, coalesce({SQL[name]}, 'NONE low') AS x FROM ({rows}))")
    def run(spark, sf_dir):
        df = table(spark, sf_dir, source).select(F.expr(key).alias("id"), *(F.expr(sql).alias(c) for c, sql in inputs.items()))
        return interpret(df, name, OTHER).select("id", "kind", "confidence")


for _name in INPUTS:
    _register(_name)
