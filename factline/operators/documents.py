"""Markdown documents as data: headings, tables, references, plans and skills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factline.functions import scalars as S
from factline.operators import graph
from factline.operators.audit import OTHER_WEIGHT, PLAN_BLOCKERS, PLAN_WEIGHTS
from factline.operators.facts import lookup
from factline.operators.interpret import interpret
from factline.operators.windows import as_of, fence_mask, leading_run, parent_by_depth
from factline.sources.files import lines_of

BY, ORDER = ["path"], ["line"]
#: Sections whose lack has a kind of its own.
SECTION_KINDS = {"Verification": "VERIFICATION_BLOCK_MISSING"}


def marked_lines(docs: DataFrame) -> DataFrame:
    """Lines with ``fenced``, ``depth`` and ``title`` (of headings outside fences),
    ``role`` (annotated, inherited by the headings below it) and ``header`` (in the leading quote)."""
    l = lines_of(docs.select("path", "content"))
    l = l.withColumn("fenced", fence_mask(BY, ORDER, F.col("text").rlike(r"^\s*(```|~~~)")))
    mark = F.when(~F.col("fenced"), F.regexp_extract("text", r"^(#{1,6})\s+\S", 1))
    l = l.withColumns({"depth": F.nullif(F.length(mark), F.lit(0)), "title": F.when(F.length(mark) > 0, F.trim(F.regexp_replace("text", r"^#+\s+", "")))})
    l = l.withColumn("header", leading_run(BY, ORDER, F.col("text").rlike(r"^\s*>")))
    # An annotation belongs to the next heading if only blank or other comment lines are between.
    note = F.nullif(F.regexp_extract("text", r"^\s*<!--\s*role:\s*([\w-]+)\s*-->", 1), F.lit(""))
    passes = F.col("text").rlike(r"^\s*$|^\s*<!--|^\s*---\s*$")
    state = F.when(note.isNotNull(), note).when(~passes, F.lit("\0"))
    before = F.last(state, ignorenulls=True).over(W.partitionBy(*BY).orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1))
    return l.withColumn("own_role", F.when(F.col("depth").isNotNull() & (before != "\0"), before))


def headings(docs: DataFrame) -> DataFrame:
    """Headings with the line of their parent and the role they have or inherit."""
    h = parent_by_depth(marked_lines(docs).filter("depth IS NOT NULL"), BY, "line", "depth", 6).select("path", "line", "depth", "title", "parent", "own_role")
    # A heading's ancestors are the last ones of lesser depths above it: the nearest role among
    # them is the last of its depth that no shallower heading has followed since.
    by = W.partitionBy(*BY).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    at = [F.last(F.when(F.col("depth") <= d, F.struct("depth", "line", "own_role")), ignorenulls=True).over(by) for d in range(1, 7)]
    h = h.withColumns({f"__at{d}": x for d, x in enumerate(at, 1)})
    role = F.lit(None).cast("string")
    for d in range(1, 7):
        one = F.col(f"__at{d}")
        role = F.when((one["depth"] == d) & (d <= F.col("depth")), F.coalesce(one["own_role"], role)).otherwise(role)
    h = h.withColumn("role", role)
    return h.select("path", "line", "depth", "title", "parent", "role")


def tables(docs: DataFrame) -> DataFrame:
    """A row per body row of a pipe table: ``header`` and ``cells``."""
    l = marked_lines(docs).filter(~F.col("fenced")).withColumn("is_row", F.col("text").rlike(r"^\s*\|.*\|\s*$"))
    n = F.row_number().over(W.partitionBy(*BY).orderBy(*ORDER))
    rows = l.withColumn("n", n).filter("is_row").withColumn("t", F.col("n") - F.row_number().over(W.partitionBy(*BY).orderBy(*ORDER)))
    k = F.row_number().over(W.partitionBy("path", "t").orderBy("line"))
    rows = rows.withColumns({"k": k, "cells": S.cells(F.col("text"))}).withColumn("header", F.first("cells").over(W.partitionBy("path", "t").orderBy("line")))
    return rows.filter("k > 2").select("path", "line", F.transform("header", F.lower).alias("header"), "cells")


def prompts(docs: DataFrame) -> DataFrame:
    """Prompt tables: number, file and the numbers it depends on."""
    cell = lambda name: F.try_element_at("cells", F.nullif(F.array_position("header", F.lit(name)).cast("int"), F.lit(0)))
    return tables(docs).filter(F.array_contains("header", "prompt")).select("path", "line", cell("#").alias("id"), F.regexp_extract(cell("prompt"), r"([\w./-]+\.md)", 1).alias("file"), S.dependencies(F.coalesce(cell("depends on"), F.lit(""))).alias("needs"))


def plan_observations(docs: DataFrame, listing: DataFrame, sections: tuple[str, ...] = ("Verification", "Prompts")) -> DataFrame:
    """``path, kind, line, name`` of what a plan lacks. ``listing`` (path) are the files there are."""
    p = prompts(docs).withColumn("full", F.concat(F.regexp_replace("path", r"[^/]*$", ""), F.col("file")))
    missing = p.filter("file <> ''").join(listing.select(F.col("path").alias("there")), F.col("full") == F.col("there"), "left_anti").select("path", F.lit("PROMPT_FILE_MISSING").alias("kind"), "line", F.col("file").alias("name"))
    needs = p.select("path", "line", "id", F.explode("needs").alias("need"))
    ids = p.select("path", F.col("id").alias("need")).distinct()
    unknown = needs.join(ids, ["path", "need"], "left_anti").select("path", F.lit("UNKNOWN_DEPENDENCY").alias("kind"), "line", F.col("need").alias("name"))
    key = lambda c: F.concat_ws("\0", "path", c)
    edges = needs.join(ids, ["path", "need"], "left_semi").select(key("need").alias("src"), key("id").alias("dst"))
    ring = graph.cycles(edges).select(F.split(F.col("path")[0], "\0")[0].alias("path"), F.lit("PROMPT_DEPENDENCY_CYCLE").alias("kind"), F.lit(0).alias("line"), F.array_join(F.transform("path", lambda x: F.split(x, "\0")[1]), " -> ").alias("name"))
    l = marked_lines(docs)
    tasks = l.filter(~F.col("fenced") & F.col("text").rlike(r"^\s*[-*]\s+\[ \]")).select("path", F.lit("OPEN_TASK").alias("kind"), "line", F.trim("text").alias("name"))
    bare = l.groupBy("path").agg(F.bool_or("header").alias("h")).filter("NOT h").select("path", F.lit("PLAN_HEADER_MISSING").alias("kind"), F.lit(1).alias("line"), F.lit("header").alias("name"))
    wanted = docs.select("path").crossJoin(F.broadcast(docs.sparkSession.createDataFrame([(s,) for s in sections], "name string")))
    have = l.filter("title IS NOT NULL").select("path", F.col("title").alias("name")).distinct()
    lacks = wanted.join(have, ["path", "name"], "left_anti").select("path", lookup(F.col("name"), SECTION_KINDS, "MISSING_SECTION").alias("kind"), F.lit(1).alias("line"), "name")
    out = missing
    for x in (unknown, ring, tasks, bare, lacks):
        out = out.unionByName(x)
    return out


def plan_verdicts(docs: DataFrame, observations: DataFrame) -> DataFrame:
    """Score (100 less the weights, 0 at least) and verdict of every plan."""
    cost = observations.groupBy("path").agg(F.sum(lookup(F.col("kind"), {**PLAN_WEIGHTS, "OPEN_TASK": 0}, OTHER_WEIGHT)).alias("cost"), F.count_if(F.col("kind").isin(*PLAN_BLOCKERS)).alias("n_blockers"))
    p = docs.select("path").join(cost, "path", "left").select("path", F.greatest(F.lit(0), 100 - F.coalesce("cost", F.lit(0))).cast("int").alias("score"), F.coalesce("n_blockers", F.lit(0)).alias("n_blockers"))
    return interpret(p, "plan").select("path", "score", "n_blockers", F.col("kind").alias("verdict"))


def skill_references(docs: DataFrame, listing: DataFrame, current: tuple[str, ...] = (), superseded: tuple[str, ...] = ()) -> DataFrame:
    """Paths, links and commands of documents, and conventions, with whether
    they hold: the inputs of the ``skill`` rules."""
    l = marked_lines(docs)
    code = F.regexp_extract_all("text", F.lit(r"`([\w./-]+/[\w.-]+\.\w+)`"), F.lit(1))
    link = F.regexp_extract_all("text", F.lit(r"\]\(([^)#\s:]+)\)"), F.lit(1))
    refs = l.filter(~F.col("fenced")).select("path", "line", F.explode(F.concat(F.transform(code, lambda x: F.struct(F.lit("path").alias("kind_of"), x.alias("name"))), F.transform(link, lambda x: F.struct(F.lit("ref").alias("kind_of"), x.alias("name"))))).alias("r")).select("path", "line", "r.*")
    there = listing.select(F.col("path").alias("p"), F.lit(True).alias("resolves"))
    own = F.concat(F.regexp_replace("path", r"[^/]*$", ""), F.col("name"))
    refs = refs.withColumn("p", F.when(F.col("kind_of") == "ref", own).otherwise(F.col("name"))).join(there, "p", "left").select("path", "line", "kind_of", "name", F.coalesce("resolves", F.lit(False)).alias("resolves"), F.lit(None).cast("string").alias("command_class"))
    commands = l.filter(F.col("fenced") & ~F.col("text").rlike(r"^\s*(```|~~~|$)")).select("path", "line", F.lit("command").alias("kind_of"), F.trim("text").alias("name"), F.lit(True).alias("resolves"), S.command_class(F.col("text")).alias("command_class"))
    count = lambda words: sum((F.when(F.col("text").contains(w), 1).otherwise(0) for w in words), F.lit(0))
    out = refs.unionByName(commands).withColumns({"n_superseded": F.lit(0), "n_current": F.lit(0)})
    if current or superseded:
        c = l.groupBy("path").agg(F.sum(count(superseded)).cast("int").alias("n_superseded"), F.sum(count(current)).cast("int").alias("n_current"))
        out = out.unionByName(c.select("path", F.lit(0).alias("line"), F.lit("convention").alias("kind_of"), F.lit("convention").alias("name"), F.lit(True).alias("resolves"), F.lit(None).cast("string").alias("command_class"), "n_superseded", "n_current"))
    return out
