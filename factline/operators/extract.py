"""Extractors: source lines to observations, as one table of line patterns.

Files are cut into lines by one Arrow function (:mod:`factline.operators.code`): comments are
blanked, imports over several lines put on one, and each line gets the innermost named function that it is
in. Every pattern is a regular expression over what is left, and gives a fact for each
of its matches. Whole files are read, and nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factline.operators.code import lines
from factline.operators.windows import as_of
from factline.ship import ship


@dataclass(frozen=True)
class Pattern:
    """``kind`` where ``regex`` matches; ``name`` is the group that names the subject."""

    tool: str
    kind: str
    regex: str
    name: int = 0
    keep_comments: bool = False
    unless: str | None = None


P = Pattern
PATTERNS = (
    P("imports", "STATIC_IMPORT", r"^\s*import\s+(?!type\b).*?from\s+['\"]([^'\"]+)['\"]", 1),
    P("imports", "TYPE_IMPORT", r"^\s*import\s+type\b.*?from\s+['\"]([^'\"]+)['\"]", 1),
    P("imports", "SIDE_EFFECT_IMPORT", r"^\s*import\s+['\"]([^'\"]+)['\"]", 1),
    P("imports", "DYNAMIC_IMPORT", r"\bimport\(\s*['\"]([^'\"]+)['\"]", 1),
    P("imports", "REEXPORT", r"^\s*export\s+(?:type\s+)?(?:\*|\{[^}]*\}).*?from\s+['\"]([^'\"]+)['\"]", 1),
    P("exports", "EXPORT_DECLARATION", r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function|const|let|class|interface|type|enum)\s*\*?\s*([A-Za-z_$][\w$]*)", 1),
    P("env", "PROCESS_ENV_ACCESS", r"\bprocess\.env\.([A-Z_][A-Z0-9_]*)", 1),
    P("env", "ENV_WRAPPER_ACCESS", r"\b(?:clientEnv|serverEnv)\.(\w+)", 1),
    P("env", "RAW_ENV_IMPORT", r"=\s*process\.env\s*;?\s*$"),
    P("side-effects", "CONSOLE_CALL", r"\bconsole\.(log|warn|error|info|debug)\s*\(", 1),
    P("side-effects", "TOAST_CALL", r"\btoast(?:\.(\w+))?\s*\(", 1),
    P("side-effects", "TIMER_CALL", r"\b(setTimeout|setInterval|requestAnimationFrame)\s*\(", 1),
    P("side-effects", "POSTHOG_CALL", r"\bposthog\.([\w.]+)\s*\(", 1),
    P("side-effects", "WINDOW_MUTATION", r"\b(window\.location(?:\.\w+)?|document\.(?:title|cookie))\s*=[^=]", 1),
    P("storage", "DIRECT_STORAGE_CALL", r"\b(?:localStorage|sessionStorage)\.(getItem|setItem|removeItem|clear|key)\s*\(", 1),
    P("storage", "COOKIE_CALL", r"\bCookies\.(get|set|remove)\s*\(", 1),
    P("storage", "TYPED_STORAGE_CALL", r"\b(readStorage|writeStorage|removeStorage)\s*[(<]", 1),
    P("storage", "JSON_PARSE_CALL", r"\bJSON\.parse\s*\(", unless=r"\.(?:safeParse|parse)\(\s*JSON\.parse"),
    P("storage", "JSON_PARSE_ZOD_GUARDED", r"\.(?:safeParse|parse)\(\s*JSON\.parse"),
    P("type-safety", "AS_ANY_CAST", r"\bas\s+any\b"),
    P("type-safety", "AS_UNKNOWN_AS_CAST", r"\bas\s+unknown\s+as\b"),
    P("type-safety", "NON_NULL_ASSERTION", r"([\w\])])!(?=[.;,)\]\[])", 1),
    P("type-safety", "EXPLICIT_ANY_ANNOTATION", r":\s*any\b|<any\b|\bany\[\]"),
    P("type-safety", "CATCH_ERROR_ANY", r"\bcatch\s*\(\s*\w+\s*:\s*any\s*\)"),
    P("type-safety", "TS_DIRECTIVE", r"@ts-(ignore|expect-error|nocheck)", 1, True),
    P("type-safety", "ESLINT_DISABLE", r"eslint-disable(?:-next-line|-line)?\s*([^*]*)", 1, True),
    P("hooks", "HOOK_CALL", r"\b(use[A-Z]\w*)\s*(?:<[^>]*>)?\(", 1),
    P("effects", "EFFECT_LOCATION", r"\b(useEffect|useLayoutEffect)\s*\(", 1),
    P("effects", "EFFECT_TIMER_CALL", r"\b(setTimeout|setInterval)\s*\(", 1),
    P("effects", "EFFECT_STATE_SETTER_CALL", r"\b(set[A-Z]\w*)\s*\(", 1, unless=r"\bset(?:Timeout|Interval)\b"),
    P("effects", "EFFECT_FETCH_CALL", r"\b(fetch|axios(?:\.\w+)?|fetchApi)\s*\(", 1),
    P("effects", "EFFECT_NAVIGATION_CALL", r"\b(?:router\.(push|replace)|navigate)\s*\(", 1),
    P("effects", "EFFECT_REF_TOUCH", r"\b(\w*[rR]ef)\.current\b", 1),
    P("effects", "EFFECT_CLEANUP_PRESENT", r"\breturn\s*\(\)\s*=>"),
    P("data-layer", "QUERY_HOOK_DEFINITION", r"\b(useQuery|useInfiniteQuery|useSuspenseQuery)\s*[(<]", 1),
    P("data-layer", "MUTATION_HOOK_DEFINITION", r"\b(useMutation)\s*[(<]", 1),
    P("data-layer", "API_ENDPOINT", r"['\"`](/api/[^'\"`?]*)", 1),
    P("data-layer", "QUERY_INVALIDATION", r"\b(invalidateQueries|setQueryData|refetchQueries)\s*\(", 1),
    P("feature-flags", "FLAG_HOOK_CALL", r"\b(useFeatureFlags?|useFlag\w*)\s*\(", 1),
    P("feature-flags", "FLAG_READ", r"\b(?:featureFlags|flags)\.(\w+)", 1),
    P("authz", "RAW_ROLE_CHECK", r"\b\w*[rR]oles?\s*(?:===|!==|\.includes\()\s*['\"]?(\w+)", 1),
    P("branded", "UNBRANDED_ID_PARAM", r"\b(\w+Id)\s*\??\s*:\s*(?:string|number)\b", 1),
    P("jsx", "JSX_TERNARY_CHAIN", r"\{[^{}]*\?[^{}?.]*<\w"),
    P("jsx", "JSX_GUARD_CHAIN", r"\{[^{}]*&&\s*\(?\s*<\w"),
    P("jsx", "JSX_TRANSFORM_CHAIN", r"\.(?:filter|map|reduce|sort|flatMap)\([^)]*\).*\.(filter|map|reduce|sort|flatMap)\(", 1),
    P("jsx", "JSX_INLINE_HANDLER", r"\b(on[A-Z]\w*)=\{\s*(?:async\s*)?\(?[^)]*\)?\s*=>", 1),
    P("jsx", "JSX_INLINE_STYLE", r"\bstyle=\{\{"),
    P("jsx", "JSX_COMPLEX_CLASSNAME", r"\bclassName=\{[^}]*\?"),
    P("behavioral", "STATE_INITIALIZATION", r"\[\s*(\w+)\s*,[^\]]*\]\s*=\s*use(?:Query)?State\b", 1),
    P("behavioral", "NULL_COERCION_DISPLAY", r"(?:\?\?|\|\|)\s*(['\"][^'\"]*['\"])", 1),
    P("behavioral", "TYPE_COERCION_BOUNDARY", r"\b(String|Number|Boolean|parseInt|parseFloat)\s*\(", 1),
    P("behavioral", "RENDER_CAP", r"\.(slice|take|splice)\(\s*0\s*,\s*\d+", 1),
    P("null-display", "NULL_COALESCE_FALLBACK", r"(?:\?\?|\|\|)\s*['\"]([-–—]{1,2}|N/A|n/a)['\"]", 1),
    P("null-display", "HARDCODED_DASH", r">\s*([-–—])\s*<", 1),
    P("number-format", "TO_FIXED", r"\.toFixed\((\d*)\)", 1),
    P("number-format", "TO_LOCALE_STRING", r"\.toLocaleString\("),
    P("number-format", "FORMATTER_CALL", r"\b(format(?:Number|Int|Percent|Currency|Duration)\w*)\s*\(", 1),
    P("number-format", "PERCENT_TEMPLATE", r"\$\{[^}]+\}%"),
    P("date-usage", "RAW_DATE_CONSTRUCTOR", r"\bnew\s+Date\s*\("),
    P("date-usage", "RAW_DATE_STATIC", r"\bDate\.(now|parse|UTC)\s*\(", 1),
    P("date-usage", "DATE_FORMATTING", r"\.to(?:Locale(?:Date|Time)|ISO|UTC|Date|Time)String\("),
    P("date-usage", "TEMPORAL_USAGE", r"\bTemporal\.(\w+)", 1),
    P("error-flow", "CATCH_BLOCK", r"\bcatch\s*(?:\(\s*(\w+)[^)]*\))?\s*\{", 1),
    P("error-flow", "RETHROW", r"\bthrow\s+(\w+)", 1),
    P("errors", "TRY_BLOCK", r"\btry\s*\{"),
    P("errors", "ON_ERROR_HANDLER", r"\bonError\s*[:=]"),
    P("concerns", "LOADING_SIGNAL", r"\b(isLoading|isPending|isFetching)\b", 1),
    P("concerns", "ERROR_SIGNAL", r"\b(isError|error)\b", 1),
    P("concerns", "EMPTY_SIGNAL", r"\.length\s*(?:===\s*0|<\s*1)"),
    P("concerns", "PERMISSION_SIGNAL", r"\b(canAccess|hasPermission|usePermissions?)\b", 1),
    P("test-quality", "MOCK_DECLARATION", r"\bvi\.mock\(\s*['\"]([^'\"]+)['\"]", 1),
    P("test-quality", "SPY_DECLARATION", r"\bvi\.spyOn\(\s*([\w.]+)", 1),
    P("test-quality", "ASSERTION_CALL", r"\bexpect\s*\(.*?\)\.?(?:not\.|resolves\.|rejects\.)?(\w+)?\s*\(", 1),
    P("test-quality", "RENDER_CALL", r"\b(render|renderHook)\s*\(", 1),
    P("test-quality", "TEST_BLOCK", r"\b(?:it|test)(?:\.\w+)*\(\s*['\"`]([^'\"`]*)", 1),
    P("test-quality", "DESCRIBE_BLOCK", r"\bdescribe(?:\.\w+)*\(\s*['\"`]([^'\"`]*)", 1),
    P("test-quality", "CLEANUP_CALL", r"\b(afterEach|afterAll)\s*\(", 1),
    P("pw-parity", "PW_NAVIGATION", r"\bpage\.goto\(\s*['\"`]([^'\"`]*)", 1),
    P("pw-parity", "PW_ROUTE_INTERCEPT", r"\bpage\.route\(\s*['\"`]([^'\"`]*)", 1),
    P("nr-client", "NR_NREUM_CALL", r"\b(?:window\.)?NREUM\.(\w+)", 1),
    P("nr-client", "NR_REPORT_ERROR_CALL", r"\b(reportError|noticeError)\s*\(", 1),
    P("nr-server", "OTEL_RECORD_ERROR", r"\b(recordError|setSpanAttributes|withSpan)\s*\(", 1),
    P("handler", "HANDLER_EXPORT", r"^\s*export\s+default\s+(?:async\s+)?(?:function\s*)?(\w*)", 1),
    P("complexity", "BRANCH_POINT", r"\b(if|for|while|case|catch)\b\s*[({'\"\w]", 1),
    P("complexity", "LOGICAL_BRANCH", r"&&|\|\||\?\?"),
    P("markdown", "HEADING", r"^(#{1,6})\s+\S", 1),
    P("markdown", "CODE_FENCE", r"^\s*(```|~~~)", 1),
    P("markdown", "TABLE_ROW", r"^\s*\|.*\|\s*$"),
    P("markdown", "LINK", r"\[[^\]]*\]\(([^)\s]+)", 1),
    P("markdown", "TASK", r"^\s*[-*]\s+\[([ xX])\]", 1),
    P("markdown", "BLOCKQUOTE", r"^\s*>"),
    P("markdown", "ROLE_ANNOTATION", r"<!--\s*role:\s*([\w-]+)", 1),
)
TOOLS = tuple(sorted({p.tool for p in PATTERNS}))


def masked_lines(files: DataFrame) -> DataFrame:
    """Lines with ``code``, what is outside of comments, and ``parent``, the function they are in."""
    ship(files.sparkSession)

    def cut(batches):
        for b in batches:
            for r in range(b.num_rows):
                path, version, text = (b[c][r].as_py() for c in ("path", "version", "content"))
                rows = lines(text or "")
                for lo in range(0, len(rows), 20_000):
                    n, raw, code, parent = zip(*rows[lo : lo + 20_000])
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(n), pa.string()), pa.array([version] * len(n), pa.string()), pa.array(raw, pa.string()), pa.array(n, pa.int32()), pa.array(code, pa.string()), pa.array(parent, pa.string())], names=["path", "version", "text", "line", "code", "parent"])

    return files.select("path", "version", "content").mapInArrow(cut, "path string, version string, text string, line int, code string, parent string")


def observe(files: DataFrame, tools: tuple[str, ...] | None = None) -> DataFrame:
    """``tool, kind, file, version, line, parent, name, text`` of every match of a pattern
    of the tools (all, if none are given), so a line has as many facts as there are matches."""
    unknown = set(tools or ()) - set(TOOLS)
    if unknown:
        raise ValueError(f"unknown tools {sorted(unknown)}; there are {', '.join(TOOLS)}")
    chosen = [p for p in PATTERNS if not tools or p.tool in tools]

    def each(p: Pattern) -> Column:
        text = F.col("text" if p.keep_comments or p.tool == "markdown" else "code")
        found = F.transform(F.regexp_extract_all(text, F.lit(p.regex), F.lit(p.name)), lambda x: F.struct(F.lit(p.tool).alias("tool"), F.lit(p.kind).alias("kind"), x.alias("name")))
        return F.when(~text.rlike(p.unless), found).otherwise(F.slice(found, 1, 0)) if p.unless else found

    rows = masked_lines(files).withColumn("o", F.explode(F.flatten(F.array(*map(each, chosen)))))
    return rows.select("o.tool", "o.kind", F.col("path").alias("file"), "version", "line", "parent", F.trim("o.name").alias("name"), F.trim("text").alias("text"))


def complexity(files: DataFrame) -> DataFrame:
    """Per function: 1 + its branch points, and the deepest nesting of braces in it."""
    rows = masked_lines(files).filter("parent IS NOT NULL")
    by = ["path", "version", "parent"]
    n = F.size(F.regexp_extract_all("code", F.lit(r"\b(?:if|for|while|case|catch)\b\s*[({'\"\w]|&&|\|\||\?\?|\?(?![.?:])"), F.lit(0)))
    depth = F.sum(F.length(F.regexp_replace("code", r"[^{]", "")) - F.length(F.regexp_replace("code", r"[^}]", ""))).over(W.partitionBy(*by).orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumns({"n": n, "depth": depth}).groupBy(*by).agg((1 + F.sum("n")).alias("complexity"), F.greatest(F.lit(0), F.max("depth")).alias("depth"), F.min("line").alias("line"))


def effect_flags(observations: DataFrame) -> DataFrame:
    """The effects table's inputs: what stands between an effect's line and the next one of its function."""
    by = ["file", "version", "parent"]
    o = observations.filter("tool IN ('effects', 'side-effects', 'storage')")
    o = o.withColumn("effect_line", as_of(by, ["line"], F.when(F.col("kind") == "EFFECT_LOCATION", F.col("line")))).filter("effect_line IS NOT NULL")
    has = lambda *kinds: F.bool_or(F.col("kind").isin(*kinds))
    return o.groupBy(*by, "effect_line").agg(
        F.count_if(F.col("kind") == "EFFECT_STATE_SETTER_CALL").alias("n_setters"),
        F.max(F.size(F.filter(F.split(F.regexp_extract("text", r"\[([^\]]*)\]\s*\)\s*;?\s*$", 1), ","), lambda d: F.trim(d) != ""))).alias("n_deps"),
        has("EFFECT_FETCH_CALL").alias("has_fetch"), has("EFFECT_TIMER_CALL", "TIMER_CALL").alias("has_timer"), has("WINDOW_MUTATION").alias("has_dom"), has("DIRECT_STORAGE_CALL", "TYPED_STORAGE_CALL").alias("has_storage"),
        has("EFFECT_CLEANUP_PRESENT").alias("has_cleanup"), has("TOAST_CALL").alias("has_toast"), has("EFFECT_NAVIGATION_CALL").alias("has_navigation"), has("EFFECT_REF_TOUCH").alias("touches_ref"), F.lit(True).alias("reads_only_deps"), F.lit(False).alias("setter_mirrors_prop"),
    )


def import_edges(files: DataFrame, extensions: tuple[str, ...] = (".ts", ".tsx", "/index.ts", "/index.tsx"), aliases: dict[str, str] | None = None) -> DataFrame:
    """``src, dst, name, line, reexport``: relative imports, and those of a prefix in ``aliases`` (prefix to folder),
    resolved against the listing by the first extension that exists; one row per specifier."""
    aliases = aliases or {}
    near = "|".join([r"\.{1,2}/", *(re.escape(a) for a in aliases)])
    line = masked_lines(files).filter(F.col("code").rlike(rf"\bfrom\s*['\"](?:{near})"))
    spec = F.regexp_extract("code", r"^\s*(?:import|export)\s+(?:type\s+)?(.*?)\s*from\s*['\"]", 1)
    target = F.regexp_extract("code", r"from\s*['\"]([^'\"]+)['\"]", 1)
    names = F.filter(F.transform(F.split(F.regexp_replace(spec, r"[{}]", ","), ","), lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"^\s*type\s+", ""), r"(\w)\s+as\s+\w+\s*$", "$1"))), lambda s: s != "")
    # A default import has no braces around its name.
    rows = line.select(F.col("path").alias("src"), "line", F.col("code").rlike(r"^\s*export\b").alias("reexport"), F.split(F.regexp_replace("path", r"/[^/]*$", ""), "/").alias("dir"), target.alias("target"), F.explode(names).alias("name"))
    up = F.size(F.regexp_extract_all("target", F.lit(r"\.\./"), F.lit(0)))
    stem = F.concat(F.array_join(F.slice("dir", F.lit(1), F.greatest(F.size("dir") - up, F.lit(1))), "/"), F.lit("/"), F.regexp_replace("target", r"^(\.{1,2}/)+", ""))
    for prefix, folder in aliases.items():
        stem = F.when(F.startswith("target", F.lit(prefix)), F.concat(F.lit(folder), F.substring("target", len(prefix) + 1, 1 << 20))).otherwise(stem)
    tried = rows.select("src", "line", "reexport", "name", stem.alias("stem")).withColumn("try", F.explode(F.array(*(F.struct(F.lit(k).alias("rank"), F.concat("stem", F.lit(e)).alias("path")) for k, e in enumerate(extensions)))))
    listing = files.select(F.col("path").alias("dst")).distinct()
    return tried.join(listing, F.col("try.path") == F.col("dst")).groupBy("src", "line", "reexport", "name").agg(F.min_by("dst", "try.rank").alias("dst"))


def exports_of(files: DataFrame) -> DataFrame:
    return observe(files, ("exports",)).select("file", "name", "line").distinct()
