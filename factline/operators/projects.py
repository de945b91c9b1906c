"""Relations between a project's parts: peer dependencies, routes, fields, rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.functions import scalars as S
from factline.operators.extract import masked_lines
from factline.operators.facts import first_containing


def peer_status(peers: DataFrame, installed: DataFrame) -> DataFrame:
    """``peers`` (package, peer, range, optional) against ``installed`` (name,
    version): satisfied, unsatisfied, missing or, for optional ones, absent."""
    j = peers.join(installed.select(F.col("name").alias("peer"), "version"), "peer", "left")
    ok = S.satisfies(F.col("version"), F.col("range"))
    status = F.when(F.col("version").isNull() & F.col("optional"), "absent").when(F.col("version").isNull(), "missing").when(ok, "satisfied").otherwise("unsatisfied")
    return j.select("package", "peer", "range", "version", status.alias("status"))


def api_path(route: Column | str) -> Column:
    """A route file's path as the path it serves."""
    c = F.regexp_replace(route, r"^.*?/(?=api/)", "/")
    return F.regexp_replace(F.regexp_replace(c, r"\.(t|j)sx?$", ""), "/index$", "")


def route_gaps(served: DataFrame, mocked: DataFrame) -> DataFrame:
    """``served`` (path, is_stub) against ``mocked`` (path): stubs, mocks that
    nothing serves, and routes without a mock."""
    stub = served.filter("is_stub").select("path", F.lit("STUB_ROUTE").alias("kind"))
    missing = mocked.join(served, "path", "left_anti").select("path", F.lit("MISSING_ROUTE").alias("kind"))
    unmocked = served.filter("NOT is_stub").join(mocked, "path", "left_anti").select("path", F.lit("UNMOCKED_ROUTE").alias("kind"))
    return stub.unionByName(missing).unionByName(unmocked).distinct()


def gap_users(calls: DataFrame, gaps: DataFrame) -> DataFrame:
    """For each call (file, line, url) the first gap whose path its url contains."""
    paths = gaps.filter("kind IN ('STUB_ROUTE', 'MISSING_ROUTE')").select(F.col("path").alias("gap")).distinct()
    c = calls.withColumn("route", S.template_to_route(F.col("url")))
    return first_containing(c, paths.withColumn("rank", F.col("gap")), "route", "gap", "rank")


def field_refs(files: DataFrame, field: str) -> DataFrame:
    """Where a field's name is used, and how."""
    c = F.col("code")
    kind = (
        F.when(c.rlike(rf"\?\.{field}\b"), "optional-access")
        .when(c.rlike(rf"\.{field}\b"), "property-access")
        .when(c.rlike(rf"\{{[^}}:]*\b{field}\b[^}}:]*\}}\s*="), "destructuring")
        .when(c.rlike(rf"['\"]{field}['\"]"), "string-literal")
        .when(c.rlike(rf"\b{field}\??\s*:"), "definition")
        .when(c.rlike(rf"\b{field}\b"), "identifier")
    )
    return masked_lines(files).select(F.col("path").alias("file"), "line", kind.alias("kind"), F.trim("code").alias("context")).filter("kind IS NOT NULL")


#: Literal placeholders and raw formats, and what stands for them.
REWRITES = ((r"(\?\?|\|\|)\s*['\"](?:N/A|n/a|--|-|–)['\"]", "$1 NO_VALUE"), (r"\b([\w.]+)\.toFixed\(\d*\)", "formatNumber($1)"), (r"\b([\w.]+)\.toLocaleString\(\)", "formatInt($1)"))


def rewrites(files: DataFrame) -> DataFrame:
    """Lines that the display rules would change: ``old`` and ``new``; nothing is written."""
    new = F.col("code")
    for pattern, to in REWRITES:
        new = F.regexp_replace(new, pattern, to)
    return masked_lines(files).select(F.col("path").alias("file"), "line", F.col("code").alias("old"), new.alias("new")).filter("old <> new")
