from pyspark.sql import functions as F

from factline.operators import documents as D
from factline.operators import projects as J
from factline.operators.interpret import interpret

PLAN = """> Status: draft
> Owner: x

# Plan
<!-- role: intro -->

## Prompts
| # | Prompt | Depends on |
|---|---|---|
| 1 | a.md | -- |
| 2 | [b](b.md) | 1, 3 |
| 3 | c.md | 2 |
| 4 | d.md | 9 |

### Detail
- [ ] open
```
# not a heading
| not | a | table |
```
## Next
"""


def docs(spark, *rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_headings_inherit_roles(spark):
    got = [(r["title"], r["depth"], r["parent"], r["role"]) for r in D.headings(docs(spark, ("p/plan.md", PLAN))).orderBy("line").collect()]
    assert got == [("Plan", 1, None, None), ("Prompts", 2, 4, "intro"), ("Detail", 3, 7, "intro"), ("Next", 2, 4, None)]


def test_plan(spark):
    d = docs(spark, ("p/plan.md", PLAN), ("q/plan.md", "> ok\n\n## Prompts\n\n## Verification\n"))
    listing = spark.createDataFrame([("p/a.md",), ("p/b.md",), ("p/c.md",)], "path string")
    o = D.plan_observations(d, listing)
    assert sorted((r["path"], r["kind"], r["name"]) for r in o.collect()) == [
        ("p/plan.md", "OPEN_TASK", "- [ ] open"), ("p/plan.md", "PROMPT_DEPENDENCY_CYCLE", "2 -> 3"), ("p/plan.md", "PROMPT_FILE_MISSING", "d.md"), ("p/plan.md", "UNKNOWN_DEPENDENCY", "9"), ("p/plan.md", "VERIFICATION_BLOCK_MISSING", "Verification")]
    assert {r["path"]: (r["score"], r["verdict"]) for r in D.plan_verdicts(d, o).collect()} == {"p/plan.md": (25, "BLOCKED"), "q/plan.md": (100, "CERTIFIED")}


def test_skill(spark):
    text = "See `src/a.ts` and `src/gone.ts`, [there](x.md), [nowhere](y.md).\n```\ngit status\nfrobnicate\n```\nuse oldThing\n"
    refs = D.skill_references(docs(spark, ("s/SKILL.md", text)), spark.createDataFrame([("src/a.ts",), ("s/x.md",)], "path string"), ("newThing",), ("oldThing",))
    assert sorted((r["kind"], r["name"]) for r in interpret(refs, "skill").collect()) == [("BROKEN_CROSS_REF", "y.md"), ("DRIFT", "convention"), ("STALE_PATH", "src/gone.ts"), ("UNKNOWN_COMMAND", "frobnicate")]


def test_peers(spark):
    peers = spark.createDataFrame([("a", "react", "^18.0.0", False), ("b", "react", "^17", False), ("c", "none", "*", False), ("d", "none", "*", True)], "package string, peer string, range string, optional boolean")
    got = {r["package"]: r["status"] for r in J.peer_status(peers, spark.createDataFrame([("react", "18.2.0")], "name string, version string")).collect()}
    assert got == {"a": "satisfied", "b": "unsatisfied", "c": "missing", "d": "absent"}


def test_routes(spark):
    served = spark.createDataFrame([("/api/a", False), ("/api/b", True), ("/api/c", False)], "path string, is_stub boolean")
    gaps = J.route_gaps(served, spark.createDataFrame([("/api/a",), ("/api/z/[id]",)], "path string"))
    assert sorted((r["path"], r["kind"]) for r in gaps.collect()) == [("/api/b", "STUB_ROUTE"), ("/api/c", "UNMOCKED_ROUTE"), ("/api/z/[id]", "MISSING_ROUTE")]
    calls = spark.createDataFrame([("f.ts", 3, "`/api/z/${id}/more`"), ("f.ts", 4, "/api/a")], "file string, line int, url string")
    assert [(r["line"], r["gap"]) for r in J.gap_users(calls, gaps).collect()] == [(3, "/api/z/[id]")]
    assert spark.range(1).select(J.api_path(F.lit("src/pages/api/x/index.ts")).alias("p")).first()["p"] == "/api/x"


def test_fields_and_rewrites(spark):
    code = "const { total } = row;\nx.total + y?.total\n// total\nconst s = v ?? 'N/A';\nconst t = row.total.toFixed(2);\ntype R = { total: number };\n"
    f = spark.createDataFrame([("a.ts", "disk", code)], "path string, version string, content string")
    assert [(r["line"], r["kind"]) for r in J.field_refs(f, "total").orderBy("line").collect()] == [(1, "destructuring"), (2, "optional-access"), (5, "property-access"), (6, "definition")]
    assert [(r["line"], r["new"]) for r in J.rewrites(f).orderBy("line").collect()] == [(4, "const s = v ?? NO_VALUE;"), (5, "const t = formatNumber(row.total);")]
