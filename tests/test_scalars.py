import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factline.functions import scalars as S


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "version,wanted,holds",
    [
        ("1.2.3", "^1.2.0", True), ("2.0.0", "^1.2.0", False), ("0.2.9", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("0.0.4", "^0.0.3", False), ("0.0.3", "^0.0.3", True),
        ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False), ("1.9.9", "~1", True), ("1.2.3", "1.2.x", True), ("1.3.0", "1.2.x", False), ("1.5.0", "1", True), ("2.0.0", "1", False),
        ("1.0.0", ">=1.0.0 <2.0.0", True), ("2.0.0", ">=1.0.0 <2.0.0", False), ("2.0.0", "<=1.9.9 || >=2.0.0", True), ("1.4.0", "1.2.0 - 1.5.0", True), ("1.6.0", "1.2.0 - 1.5.0", False),
        ("1.5.9", "1.2 - 1.5", True), ("18.3.1", "*", True), ("18.3.1", "", True), ("nonsense", "*", False), ("1.0.0-alpha.2", ">=1.0.0-alpha.1", True), ("1.0.0-alpha.10", ">1.0.0-alpha.9", True),
        ("1.0.0-beta", ">=1.0.0", False), ("1.2.3", ">1.2", False), ("1.3.0", ">1.2", True), ("1.2.3", "= 1.2.3", True), ("1.2.4", "1.2.3", False), ("1.2.3", "< 1.2.3", False),
    ],
)
def test_satisfies(spark, version, wanted, holds):
    assert one(spark, S.satisfies(F.lit(version), F.lit(wanted))) is holds


def test_rounding_goes_up_on_both_sides_of_zero(spark):
    rows = spark.createDataFrame([(2.5,), (-2.5,), (0.5,), (-0.5,)], "x double").select(S.round_half_up(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in rows] == [3.0, -2.0, 1.0, 0.0]


def test_truncate(spark):
    assert one(spark, S.truncate_text(F.lit("  a\n b  c  "), 10)) == "a b c"
    assert one(spark, S.truncate_text(F.lit("abcdefghijk"), 8)) == "abcde..."
    assert one(spark, S.truncate_text(F.lit(None).cast("string"), 8)) is None


def test_templates(spark):
    assert one(spark, S.template_to_route(F.lit("`/a/${ id }/b`"))) == "/a/[id]/b"
    assert one(spark, S.fill_template(F.lit("${a}-${b}-${c}"), {"a": F.lit(1), "b": F.lit("x")})) == "1-x-${c}"
    assert one(spark, S.fill_printf(F.lit("%s is %d%% of %s"), F.array(F.lit("a"), F.lit("5")))) == "a is 5% of %s"
    assert one(spark, S.fill_printf(F.lit("plain"), F.array(F.lit("a")))) == "plain"


def test_paths(spark):
    assert one(spark, S.base_name(F.lit("a/b/c.spec.ts"))) == "c.spec.ts"
    assert one(spark, S.dir_name(F.lit("a/b/c.ts"))) == "a/b"
    assert one(spark, S.dir_name(F.lit("c.ts"))) == "."
    assert one(spark, S.extension(F.lit("a.b/c.ts"))) == ".ts"
    assert one(spark, S.common_ancestor(F.array(F.lit("a/b/c.ts"), F.lit("a/b/d/e.ts"), F.lit("a/b/x.ts")))) == "a/b"
    assert one(spark, S.common_ancestor(F.array(F.lit("a/b.ts"), F.lit("c/b.ts")))) == ""


@pytest.mark.parametrize("glob,path,hit", [("src/*.ts", "src/a.ts", True), ("src/*.ts", "src/x/a.ts", False), ("src/**.ts", "src/x/a.ts", True), ("a?c", "abc", True), ("a.c", "abc", False)])
def test_globs(spark, glob, path, hit):
    assert one(spark, F.lit(path).rlike(S.glob_to_regex(glob))) is hit


def test_tables_and_lists(spark):
    assert one(spark, S.cells(F.lit("| a | b||"))) == ["a", "b", ""]
    assert one(spark, S.dependencies(F.lit("a, b  c -- "))) == ["a", "b", "c"]
    assert one(spark, S.unquote(F.lit("'-'"))) == "-"


def test_setters_and_commands(spark):
    assert one(spark, S.setter_mirrors(F.lit("setName"), F.lit("name")))
    assert one(spark, S.setter_mirrors(F.lit("setName"), F.lit("initialName")))
    assert not one(spark, S.setter_mirrors(F.lit("setName"), F.lit("title")))
    assert [one(spark, S.command_class(F.lit(c))) for c in ("npx tsc --noEmit", "npx vitest run", "git status", "npm install", "echo x")] == ["typecheck", "test", "git", "npm", "other"]


def test_sizes_and_sets(spark):
    assert one(spark, S.bytes_text(F.lit(512))) == "512 B" and one(spark, S.bytes_text(F.lit(2048))) == "2.0 KB"
    assert one(spark, S.overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")))) == 0.5
    assert one(spark, S.overlap(F.array().cast("array<string>"), F.array(F.lit("a")))) == 0.0
    assert one(spark, S.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    assert one(spark, S.near_boundary(F.lit(12.0), [10.0, 0.0])) and not one(spark, S.near_boundary(F.lit(13.0), [10.0, 0.0]))


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=30))
def test_normalising_twice_changes_nothing(spark, s):
    once = one(spark, S.normalise_name(F.lit(s)))
    assert one(spark, S.normalise_name(F.lit(once))) == once
