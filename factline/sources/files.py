"""Text, JSON, markdown and git sources as DataFrames."""

from __future__ import annotations

import json
import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.functions.scalars import glob_to_regex

SKIPPED = ("node_modules", ".next", "dist", ".git")
TEST = r"\.(spec|test)\.tsx?$|/__tests__/"
SCHEMA = "path string, version string, content string"


def scan_files(spark: SparkSession, path: str, which: str = "production", glob: str = "*.{ts,tsx}", version: str = "disk") -> DataFrame:
    """``path, version, content, is_test`` of files under a directory (or of a glob):
    production files, tests or all. Declaration files, binary files and build folders are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    rel = F.regexp_replace("path", "^file:/*", "/")
    files = raw.select(rel.alias("path"), F.lit(version).alias("version"), F.decode("content", "UTF-8").alias("content"))
    return select_files(files, which)


def select_files(files: DataFrame, which: str = "production") -> DataFrame:
    folder = "(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"
    files = files.filter(~F.col("path").rlike(folder) & ~F.col("path").endswith(".d.ts") & ~F.col("content").contains("\0"))
    files = files.withColumn("is_test", F.col("path").rlike(TEST))
    return files if which == "all" else files.filter(F.col("is_test") if which == "test" else ~F.col("is_test"))


def scan_git(spark: SparkSession, repo: str, ref: str = "HEAD", glob: str = "**") -> DataFrame:
    """Files of a commit, ``version`` being the ref. The driver lists them; their
    contents are read where the rows are, so the repository must be on a shared path."""
    listed = subprocess.run(["git", "-C", repo, "ls-tree", "-r", "--name-only", "-z", ref], capture_output=True, check=True).stdout.decode().split("\0")
    names = spark.createDataFrame([(n,) for n in listed if n], "path string").filter(F.col("path").rlike(glob_to_regex(glob)))

    def show(batches):
        for pdf in batches:
            got = [subprocess.run(["git", "-C", repo, "show", f"{ref}:{p}"], capture_output=True) for p in pdf["path"]]
            yield pdf.assign(version=ref, content=[g.stdout.decode(errors="replace") if g.returncode == 0 else None for g in got])

    return names.mapInPandas(show, SCHEMA).filter("content IS NOT NULL")


def lines_of(files: DataFrame) -> DataFrame:
    """A row per line, numbered from 1."""
    rows = files.select(*[c for c in files.columns if c != "content"], F.posexplode(F.split("content", "\n")).alias("__k", "text"))
    return rows.withColumn("line", F.col("__k") + 1).drop("__k")


def mentions(files: DataFrame, target: str) -> DataFrame:
    """Files that could use ``target``: their text holds its base name (its folder's,
    for an index file). What doesn't mention it can't."""
    stem = os.path.splitext(os.path.basename(target))[0]
    name = os.path.basename(os.path.dirname(target)) if stem == "index" else stem
    return files.filter(F.col("content").contains(name) & (F.col("path") != target))


def scan_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def load_config(defaults: dict, path: str | None = None) -> dict:
    """Defaults with a JSON file's values over them: objects merge, lists are replaced,
    unknown keys stay; a missing or broken file changes nothing."""

    def merge(a, b):
        return {**a, **{k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}}

    try:
        with open(path) as f:
            return merge(defaults, json.load(f))
    except (OSError, TypeError, ValueError):
        return dict(defaults)
