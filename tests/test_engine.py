import json
import subprocess

import pytest

from factline.engine import Engine
from factline.operators import extract, report
from factline.operators.cache import FactCache
from factline.sources.files import lines_of, load_config, mentions, scan_files, scan_git, scan_json
from factline.streaming.incremental import kind_counts, refresh, stream_files

FILES = {
    "src/a.tsx": """import { useState, useEffect } from 'react';
import { helper, unused as other } from './lib/b';
/* as any in a comment
   console.log('no') */
export function Panel({ teamId }: { teamId: string }) {
  const [n, setN] = useState(0); // as any
  useEffect(() => {
    setTimeout(() => setN(1), 10);
  }, [teamId]);
  if (n > 1 && teamId) { console.log(n); }
  const v = (n as any).x;
  return <div>{n ? <b>-</b> : null}<Widget /></div>;
}
""",
    "src/lib/b.ts": "export const helper = (x: number) => {\n  if (x) { return x; }\n  return process.env.API_KEY;\n};\nexport const unused = 1;\nexport const dead = 2;\nimport { c } from '../c';\n",
    "src/c/index.ts": "import { helper } from '../lib/b';\nexport const c = () => JSON.parse(helper(1));\n",
    "src/a.spec.tsx": "import { Panel } from './a';\ndescribe('Panel', () => { it('shows', () => { expect(1).toBe(1); }); });\nvi.mock('./lib/b');\n",
    "src/types.d.ts": "export type T = any;\n",
    "node_modules/x.ts": "export const x = 1 as any;\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = tmp_path_factory.mktemp("code")
    for name, text in FILES.items():
        (r / name).parent.mkdir(parents=True, exist_ok=True)
        (r / name).write_text(text)
    return r


@pytest.fixture(scope="module")
def engine(spark, root):
    return Engine(spark, str(root))


def short(rows, root, *cols):
    return sorted(tuple(str(r[c]).replace(f"{root}/", "") for c in cols) for r in rows.collect())


def test_scans(spark, root):
    assert short(scan_files(spark, str(root)), root, "path") == [("src/a.tsx",), ("src/c/index.ts",), ("src/lib/b.ts",)]
    assert short(scan_files(spark, str(root), "test"), root, "path") == [("src/a.spec.tsx",)]
    assert lines_of(scan_files(spark, str(root), "test")).count() == 4
    near = mentions(scan_files(spark, str(root)), f"{root}/src/c/index.ts")
    assert short(near, root, "path") == [("src/a.tsx",), ("src/lib/b.ts",)]


def test_observations_skip_comments(engine, root):
    assert short(engine.query("as-any"), root, "file", "line", "parent") == [("src/a.tsx", "11", "Panel")]
    assert short(engine.query("side-effects"), root, "kind", "line") == [("CONSOLE_CALL", "10"), ("TIMER_CALL", "8")]
    assert short(engine.query("env"), root, "kind", "name", "parent") == [("PROCESS_ENV_ACCESS", "API_KEY", "helper")]
    assert {r["kind"]: r["n"] for r in engine.query("test-quality", test_files="test", count=True).collect()} == {"ASSERTION_CALL": 1, "DESCRIBE_BLOCK": 1, "MOCK_DECLARATION": 1, "TEST_BLOCK": 1}
    assert engine.query("storage", kind="JSON_PARSE_CALL").count() == 1
    with pytest.raises(ValueError, match="unknown query"):
        engine.query("nothing")
    with pytest.raises(ValueError, match="unknown tools"):
        extract.observe(engine.files, ("nothing",))


def test_graph_of_imports(engine, root):
    assert short(engine.edges(), root, "src", "dst", "name") == [("src/a.spec.tsx", "src/a.tsx", "Panel"), ("src/a.tsx", "src/lib/b.ts", "helper"), ("src/a.tsx", "src/lib/b.ts", "unused"), ("src/c/index.ts", "src/lib/b.ts", "helper"), ("src/lib/b.ts", "src/c/index.ts", "c")]
    assert short(engine.consumers(f"{root}/src/lib/b.ts"), root, "file") == [("src/a.tsx",), ("src/c/index.ts",)]
    assert short(engine.query("dead-exports"), root, "file", "name") == [("src/lib/b.ts", "dead")]
    assert engine.query("circular").count() == 1
    assert short(engine.symbol("Panel"), root, "file", "via") == [("src/a.spec.tsx", "import")]
    assert short(engine.symbol("Widget"), root, "file", "via") == [("src/a.tsx", "render")]


def test_interpreters(engine, root):
    assert short(engine.query("interpret-effects"), root, "kind", "effect_line") == [("TIMER_RACE", "7")]
    hooks = dict(short(engine.query("interpret-hooks"), root, "name", "kind"))
    assert hooks == {"useState": "REACT_BUILTIN", "useEffect": "REACT_BUILTIN"}
    dead = {(r["name"], r["kind"]) for r in engine.query("interpret-dead-code").collect()}
    assert ("dead", "DEAD_EXPORT") in dead and ("helper", "CIRCULAR_DEPENDENCY") in dead
    cc = {r["name"]: r["complexity"] for r in engine.query("complexity-report").collect()}
    assert cc["helper"] == 2 and cc["Panel"] == 4


def test_audit_report_and_diff(spark, engine, root, tmp_path):
    first = engine.audit()["findings"]
    rows = first.collect()
    assert [r["priority"] for r in rows] == sorted(r["priority"] for r in rows) and len({r["id"] for r in rows}) == len(rows)
    assert {"as-any", "eliminable-effect", "raw-env", "trust-boundary-gap", "dead-export", "circular-dep", "branded-type-gap"} <= {r["finding"] for r in rows}
    text = report.summary(first)
    assert "| Total |" in text and "Hot files" in text
    report.write_findings(first, str(tmp_path / "f"))
    old = spark.read.json(str(tmp_path / "f")).filter("finding <> 'as-any'")
    assert [r["state"] for r in engine.audit(previous=old)["diff"].collect()] == ["added"]
    assert engine.audit("P1")["findings"].count() == 0
    assert [(r["finding"], r["priority"], r["category"], r["track"]) for r in engine.audit("P2")["findings"].collect()] == [("trust-boundary-gap", "P2", "Bug", "fe")]
    assert engine.audit(track="bff")["findings"].count() == 0
    assert {r["track"]: r["P4"] for r in engine.audit()["summary"].collect()}["fe"] >= 3
    assert len(report.fixed_width(first, {"file": 12, "finding": 10}).first()["text"]) == 24


def test_cache_reads_only_what_is_new(spark, root, tmp_path):
    cache, seen = FactCache(spark, str(tmp_path / "cache")), []

    def run(files):
        seen.append(files.count())
        return extract.observe(files, ("type-safety",))

    files = scan_files(spark, str(root), "all")
    twin = files.unionByName(files.filter("path LIKE '%a.tsx'").selectExpr("'/copy.tsx' AS path", "version", "content", "is_test"))
    a = cache.observe(twin, "type-safety", run)
    assert short(a.filter("kind = 'AS_ANY_CAST'"), root, "file") == [("/copy.tsx",), ("src/a.tsx",)]
    cache.observe(twin, "type-safety", run).collect()
    assert seen == [4, 0]
    cache.observe(twin, "type-safety", run, config="other").collect()
    cache.observe(twin, "type-safety", run, mode="bypass").collect()
    assert seen == [4, 0, 4, 5]
    assert cache.stats().first()["facts"] >= 1


def test_streams(spark, root, tmp_path):
    cache = FactCache(spark, str(tmp_path / "cache"))
    q = refresh(stream_files(spark, str(root)), cache, "env", lambda f: extract.observe(f, ("env",)), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert cache.stored().filter("kind IS NOT NULL").count() == 1
    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    s = kind_counts(events).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    s.awaitTermination(120)
    assert spark.sql("SELECT sum(n) AS n FROM counts").first()["n"] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_git_json_and_configuration(spark, root, tmp_path):
    repo = tmp_path / "g"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (repo / "a.ts").write_text("export const a = 1;\n")
    run("add", ".")
    run("commit", "-qm", "x")
    (repo / "a.ts").write_text("changed")
    assert [tuple(r) for r in scan_git(spark, str(repo), "HEAD", "*.ts").collect()] == [("a.ts", "HEAD", "export const a = 1;\n")]
    (tmp_path / "c.json").write_text(json.dumps({"a": {"x": 2}, "list": [9], "new": 1}))
    assert load_config({"a": {"x": 1, "y": 1}, "list": [1, 2]}, str(tmp_path / "c.json")) == {"a": {"x": 2, "y": 1}, "list": [9], "new": 1}
    assert load_config({"a": 1}, None) == {"a": 1}
    assert scan_json(spark, str(tmp_path / "c.json")).first()["new"] == 1


MULTI = {
    "src/x.ts": """import {
  one, // the first
  type Two,
} from './lib';
import * as all from "@/deep/y";
export {
  one as renamed,
} from './lib';
const s = "// no comment", t = 'import { no } from "./lib"';
export const outer = (a: number) => {
  const inner = () => {
    return (a as any) + (s as any);
  };
  /* as any
     over lines */ const v = a as any;
  return inner() + v;
};
export function last({ a, b }: { a: number; b: number }) { return a!.x + b!.y; }
const after = 1 as any;
""",
    "src/lib/index.ts": "export { one } from './one';\nexport * from './two';\nexport { gone } from './one';\n",
    "src/lib/one.ts": "export const one = 1;\nexport const gone = 2;\nexport const dead = 3;\n",
    "src/lib/two.ts": "export type Two = 1;\nexport const free = 4;\n",
    "src/deep/y.ts": "export const y = 1;\n",
    "src/pages/api/z.ts": "export const handler = 1;\n",
    "src/server/w.ts": "export const w = 1;\n",
}


def test_code_over_several_lines(spark):
    files = spark.createDataFrame([(p, "disk", t) for p, t in MULTI.items()], "path string, version string, content string")
    e = Engine(spark, files, aliases={"@/": "src/"})
    assert sorted((r["src"], r["dst"], r["name"], r["line"], r["reexport"]) for r in e.edges().filter("src = 'src/x.ts'").collect()) == [
        ("src/x.ts", "src/deep/y.ts", "* as all", 5, False), ("src/x.ts", "src/lib/index.ts", "Two", 1, False), ("src/x.ts", "src/lib/index.ts", "one", 1, False), ("src/x.ts", "src/lib/index.ts", "one", 6, True)]
    assert sorted((r["line"], r["parent"]) for r in e.query("as-any").collect()) == [(12, "inner"), (12, "inner"), (15, "outer"), (19, None)]
    assert sorted((r["line"], r["parent"]) for r in e.query("type-safety", kind="NON_NULL_ASSERTION").collect()) == [(18, "last"), (18, "last")]
    assert sorted((r["file"], r["name"]) for r in e.dead_exports().collect()) == [("src/lib/one.ts", "dead"), ("src/server/w.ts", "w"), ("src/x.ts", "last"), ("src/x.ts", "outer")]
    dead = {(r["file"], r["name"]): r["kind"] for r in e.dead_code().collect()}
    assert dead["src/server/w.ts", "w"] == dead["src/pages/api/z.ts", "handler"] == "POSSIBLY_DEAD_EXPORT" and dead["src/lib/index.ts", "gone"] == "DEAD_BARREL_REEXPORT" and ("src/lib/index.ts", "one") not in dead


def test_cache_keeps_equal_facts_and_the_last_run(spark, tmp_path):
    files = spark.createDataFrame([("a.ts", "disk", "const a = (x as any) + (y as any);\n")], "path string, version string, content string")
    cache = FactCache(spark, str(tmp_path / "c"))
    assert cache.stats().collect() == []
    run = lambda f: extract.observe(f, ("type-safety",))
    for mode in ("use", "refresh", "use"):
        assert cache.observe(files, "t", run, mode=mode).filter("kind = 'AS_ANY_CAST'").count() == 2
    stored = cache.stored().count()
    cache.evict()
    assert cache.stored().count() == stored // 2 and cache.stats().first()["facts"] == stored // 2
    assert cache.observe(files, "t", run).count() == stored // 2


def test_an_engine_with_a_cache_gives_the_same(spark, engine, root, tmp_path):
    cached = Engine(spark, str(root), cache=FactCache(spark, str(tmp_path / "c")))
    want = sorted(map(tuple, engine.audit()["findings"].collect()))
    assert sorted(map(tuple, cached.audit()["findings"].collect())) == want
    n = cached.cache.stored().count()
    assert sorted(map(tuple, cached.audit()["findings"].collect())) == want and cached.cache.stored().count() == n
