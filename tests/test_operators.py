import itertools
import random

import pytest
from pyspark.sql import functions as F

from factline.operators import facts, graph, matching, windows
from factline.operators.rules import Rule, cascade


def greedy_brute(pairs):
    """pairs: (group, left, right, score, same)."""
    out, used = [], set()
    for g, l, r, s, n in sorted(pairs, key=lambda p: (-(p[3] + 0.05 * p[4]), -p[4], p[1], p[2])):
        if (g, "l", l) not in used and (g, "r", r) not in used:
            used |= {(g, "l", l), (g, "r", r)}
            out.append((g, l, r))
    return sorted(out)


def sequential_brute(pairs):
    out, used = [], set()
    for g, l in sorted({(p[0], p[1]) for p in pairs}):
        own = [p for p in pairs if p[:2] == (g, l) and (g, p[2]) not in used]
        if own:
            best = min(own, key=lambda p: (-p[3], p[2]))
            used.add((g, best[2]))
            out.append((g, l, best[2]))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_against_brute_force(spark, seed):
    rng = random.Random(seed)
    # Scores in quarters, so that ties are common.
    pairs = [(g, l, r, rng.randrange(8) / 8, rng.random() < 0.3) for g in range(4) for l, r in itertools.product(range(7), range(6)) if rng.random() < 0.7]
    df = spark.createDataFrame(pairs, "g int, l int, r int, score double, same boolean")
    got = matching.greedy(df, ["g"], "l", "r", matching.match_order("score", "same", "l", "r"))
    assert sorted((x.g, x.l, x.r) for x in got.collect()) == greedy_brute(pairs)
    got = matching.sequential(df, ["g"], "l", "r", "score")
    assert sorted((x.g, x.l, x.r) for x in got.collect()) == sequential_brute(pairs)


def test_matching_of_nothing(spark):
    df = spark.createDataFrame([], "g int, l int, r int, score double, same boolean")
    assert matching.greedy(df, ["g"], "l", "r", matching.match_order("score", "same", "l", "r")).collect() == []


def test_cycles_and_chains(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (2, 1), (5, 6), (6, 7), (5, 7)]
    e = spark.createDataFrame(edges, "src int, dst int")
    assert sorted(tuple(r["path"]) for r in graph.cycles(e).collect()) == [(1, 2), (1, 2, 3), (4,)]
    assert {r["node"]: r["depth"] for r in graph.longest_chain(e).collect()} == {5: 0, 6: 1, 7: 2}
    got = {(r["root"], r["node"]): r["steps"] for r in graph.reach(e, spark.createDataFrame([(5,), (3,)], "node int")).collect()}
    assert got == {(5, 5): 0, (5, 6): 1, (5, 7): 1, (3, 3): 0, (3, 1): 1, (3, 4): 1, (3, 2): 2}
    sql = {(r["root"], r["node"]): r["steps"] for r in graph.recursive_reach_sql(spark, e, 6).collect()}
    assert sql[5, 7] == 1 and sql[3, 2] == 2


def test_used_exports(spark):
    e = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "z")], "file string, name string")
    u = spark.createDataFrame([("a", "x"), ("b", "*"), ("c", "* as z")], "dst string, name string")
    assert [tuple(r) for r in graph.used_exports(e, u).collect()] == [("a", "y")]


def test_cascade_first_match_wins_and_null_is_no_match(spark):
    rules = [Rule("A", "x > 10"), Rule("B", "x > 5", "medium", "over five"), Rule("C", "y = 'q'", "low", candidate=True)]
    df = spark.createDataFrame([(11, "q"), (7, None), (None, "q"), (1, "z")], "x int, y string")
    got = [(r["kind"], r["confidence"], r["matched"], r["is_candidate"]) for r in cascade(df, rules, Rule("NONE", "true", "low")).collect()]
    assert got == [("A", "high", ["A", "B", "C"], False), ("B", "medium", ["B"], False), ("C", "low", ["C"], True), ("NONE", "low", [], False)]
    assert cascade(df, rules).count() == 3


def test_band_join_is_exact(spark):
    rng = random.Random(3)
    a, b = [(rng.randrange(3), rng.randrange(60)) for _ in range(50)], [(rng.randrange(3), rng.randrange(60)) for _ in range(50)]
    got = facts.band_join(spark.createDataFrame(a, "k int, at int"), spark.createDataFrame(b, "k int, at int"), ["k"], "at", 4)
    want = sorted((k, x, y) for k, x in a for j, y in b if j == k and abs(x - y) <= 4)
    assert sorted((r["k"], r["at"], r["at_r"]) for r in got.collect()) == want


def test_windows(spark):
    df = spark.createDataFrame([(1, k, c) for k, c in enumerate("..xxx..xx.xxxx")], "f int, line int, c string")
    assert [tuple(r) for r in windows.islands(df, ["f"], ["line"], F.col("c") == "x", 3).orderBy("line").collect()] == [(1, 2, 3), (1, 10, 4)]
    lead = df.withColumn("h", windows.leading_run(["f"], ["line"], F.col("c") == "x")).filter("h")
    assert [r["line"] for r in lead.orderBy("line").collect()] == [2, 3, 4]
    deep = spark.createDataFrame([(1, k, d) for k, d in enumerate([1, 2, 3, 2, 3, 3, 1, 3])], "f int, line int, depth int")
    assert [r["parent"] for r in windows.parent_by_depth(deep, ["f"], "line", "depth", 3).orderBy("line").collect()] == [None, 0, 1, 0, 3, 3, None, 6]


def test_suffixes_and_occurrences(spark):
    names = spark.createDataFrame([("A.go",), ("B.run",), ("C.dup",), ("none",)], "name string")
    entries = spark.createDataFrame([("A.go",), ("X.run",), ("Y.dup",), ("Z.dup",)], "entry string")
    assert {r["name"]: r["entry"] for r in matching.unique_suffix(names, entries, "name", "entry").collect()} == {"A.go": "A.go", "B.run": "X.run", "C.dup": None, "none": None}


def test_diff_states(spark):
    b, a = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "y"), (4, "z"), (3, None)], "k int, v string")
    assert {r["k"]: r["state"] for r in facts.run_diff(b, a, "k", "v").collect()} == {1: "same", 2: "changed", 3: "same", 4: "added"}


def test_cycles_of_any_length(spark):
    ring = [(k, (k + 1) % 11) for k in range(11)] + [(20, 21), (21, 20), (3, 30), (30, 31)]
    edges = spark.createDataFrame(ring, "src long, dst long")
    assert sorted(r["length"] for r in graph.cycles(edges).collect()) == [2, 11]
    assert [r["length"] for r in graph.cycles(edges, 8).collect()] == [2]


def test_cycles_in_a_task_and_by_joins_are_the_same(spark):
    import itertools
    import random

    from factline.operators import graph

    for seed in range(4):
        rng = random.Random(seed)
        edges = {(rng.randrange(7), rng.randrange(7)) for _ in range(13)} | {(20, 21), (21, 22), (30, 30)}
        want = {p for n in range(1, 8) for p in itertools.permutations(range(7), n) if p[0] == min(p) and all(e in edges for e in zip(p, p[1:] + p[:1]))} | {(30,)}
        df = spark.createDataFrame(sorted(edges), "src long, dst long")
        small, joined = ({tuple(r["path"]) for r in x.collect()} for x in (graph.cycles(df), graph.cycles(df, held=0)))
        assert small == joined == want
    ring = [(k, (k + 1) % 5000) for k in range(5000)]
    assert [len(p) for p in graph.simple_cycles(ring)] == [5000]


def test_overlap_join_equals_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    make = lambda n: [(k, sorted({w for w in words if rng.random() < rng.choice([0.1, 0.4, 0.9])})) for k in range(n)]
    a, b = [*make(40), (100, []), (101, ["w0"])], [*make(40), (100, []), (101, ["w0"]), (102, words)]
    for least in (0.2, 0.5, 1.0):
        got = matching.overlap_join(spark.createDataFrame(a, "l int, w array<string>"), spark.createDataFrame(b, "r int, w array<string>"), "l", "r", "w", least)
        share = {(i, j): len(set(x) & set(y)) / max(len(x), len(y)) for i, x in a for j, y in b if x or y}
        assert {(r.l, r.r): round(r.overlap, 9) for r in got.collect()} == {k: round(v, 9) for k, v in share.items() if v >= least}


def test_equal_rows_each_get_their_first_part(spark):
    left = spark.createDataFrame([(1, "ab"), (1, "ab"), (2, None), (3, "x")], "k int, text string")
    right = spark.createDataFrame([("b", 2), ("a", 1)], "part string, rank int")
    assert sorted(facts.first_containing(left, right, "text", "part", "rank").collect()) == [(1, "ab", "a"), (1, "ab", "a")]


def test_jaccard_pairs_in_blocks_equal_all_pairs(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(9)]
    rows = [(rng.choice("gh"), k // 2, [w for w in words if rng.random() < rng.choice([0.0, 0.2, 0.6])]) for k in range(60)]
    df = spark.createDataFrame([*rows, ("g", 99, None), (None, 98, ["w0"]), (None, 97, ["w0"]), ("h", None, ["w0"])], "g string, k int, w array<string>")
    share = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 1.0
    want = sorted((k, l, share(x, y)) for g, k, x in rows for h, l, y in rows if g == h and k < l and share(x, y) >= 0.3)
    for block in (3, 7, 100):
        got = matching.jaccard_pairs(df, ["g"], "k", "w", 0.3, block)
        assert sorted(map(tuple, got.collect())) == want
    # A small table may have many pairs: all cores get some of them.
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("kind", ["int", "long"])
def test_reach_in_tasks_and_by_joins_are_the_same(spark, kind):
    rng = random.Random(11)
    edges = [(rng.randrange(-5, 40), rng.randrange(-5, 40) * 3) for _ in range(70)] + [(1, 1), (2, 6), (6, 2)] * 2
    roots = [(k,) for k in [*range(-6, 45), 2, 1000, None, None]]
    e, start = spark.createDataFrame(edges, f"src {kind}, dst {kind}"), spark.createDataFrame(roots, f"node {kind}")
    for most in (None, 0, 1, 3):
        held, joined = graph.reach(e, start, most), graph.reach(e, start, most, held=0)
        assert held.dtypes == joined.dtypes == [("root", "bigint" if kind == "long" else "int"), ("node", "bigint" if kind == "long" else "int"), ("steps", "int")]
        assert sorted(map(repr, held.collect())) == sorted(map(repr, joined.collect()))
    # No round joins what was found before.
    assert "Join" not in graph.reach(e, start)._jdf.queryExecution().optimizedPlan().toString()
    empty = spark.createDataFrame([], f"src {kind}, dst {kind}")
    assert sorted(graph.reach(empty, start.dropna().limit(2)).collect()) == sorted(graph.reach(empty, start.dropna().limit(2), held=0).collect())


def test_reach_takes_more_roots_than_it_looks_at_together(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(graph, "AT_ONCE", 50)
    n = np.arange(1, 3000)
    g = graph._Graph(np.concatenate([n, n]), np.concatenate([n // 2, n // 3]))
    got = {(r, x): s for part in g.reach(np.arange(4000), None) for r, x, s in zip(*(c.tolist() for c in part))}
    want = {}
    for r in range(4000):
        front, k = {r}, 0
        while front:
            want |= {(r, x): k for x in front}
            front, k = {y for x in front if 0 < x < 3000 for y in (x // 2, x // 3) if (r, y) not in want}, k + 1
    assert got == want


def test_overlap_join_held_equals_the_join(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(30)]
    make = lambda n: [(f"i{k}", [w for w in words if rng.random() < rng.choice([0.1, 0.4, 0.9])]) for k in range(n)] + [("none", None), ("empty", [])]
    a, b = spark.createDataFrame(make(40), "l string, w array<string>"), spark.createDataFrame([*make(50), ("new", ["x"])], "r string, w array<string>")
    for meetings, cells in ((1 << 22, 1 << 22), (40, 1 << 22), (1 << 22, 100), (1, 1)):
        monkeypatch.setattr(matching, "MEETINGS", meetings)
        monkeypatch.setattr(matching, "CELLS", cells)
        held, joined = (sorted(map(tuple, matching.overlap_join(a, b, "l", "r", "w", 0.4, **more).collect())) for more in ({}, {"held": 0}))
        assert held == joined and len(held) > 100
    nothing = matching.overlap_join(a.limit(0), b, "l", "r", "w", 0.4)
    assert nothing.collect() == [] and nothing.dtypes == [("l", "string"), ("r", "string"), ("overlap", "double")]
    # Nothing of the right side is shuffled.
    assert "Exchange" not in matching.overlap_join(a, b, "l", "r", "w", 0.4)._jdf.queryExecution().executedPlan().toString()
