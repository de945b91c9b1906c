import itertools
import random
import re

import numpy as np
import pytest

from factline.llm import jaccard as J


def grams(text, n=J.N):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, least=J.LEAST):
    out = {}
    for (a, s), (b, t) in itertools.combinations([(i, grams(x)) for i, x in rows if i is not None], 2):
        if a != b and s and t and len(s & t) / len(s | t) >= least:
            key = min(a, b), max(a, b)
            out[key] = max(out.get(key, 0), len(s & t) / len(s | t))
    return out


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    rows = []
    shared = " ".join(word() for _ in range(60))
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(4, 120))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            rows.append(" ".join(word() if rng.random() < 0.06 else w for w in base))
        if rng.random() < 0.3:
            rows.append(" ".join(base) + " " + shared)
    rows += [rows[0], rows[0].upper(), "Été à Paris, l'été", "été à paris l été", "one", "ONE.", "", "...", None]
    return [(k, t) for k, t in enumerate(rows)]


def test_join_against_brute_force(spark):
    rows = corpus()
    rows += [(None, rows[0][1]), (rows[0][0], rows[0][1]), (500, rows[3][1] + " x"), (500, "another text of this id altogether")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, Jaccard string").repartition(3)
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in J.jaccard_join(df).collect()}
    assert got == pytest.approx(brute(rows))
    assert len(got) > 20


def classes_brute(rows, least=J.LEAST):
    """(class, copies, links) of each id, from all pairs of distinct sets."""
    nodes = {}
    for i, t in rows:
        if i is not None and (g := frozenset(grams(t))):
            nodes.setdefault(g, set()).add(i)
    linked = {g: {h for h in nodes if h != g and len(g & h) / len(g | h) >= least} for g in nodes}
    label, todo = {}, set(nodes)
    while todo:
        part, edge = set(), [next(iter(todo))]
        while edge:
            g = edge.pop()
            if g not in part:
                part.add(g)
                edge += linked[g]
        todo -= part
        label |= dict.fromkeys(part, min(i for g in part for i in nodes[g]))
    out = {i: (i, 0, 0) for i, _ in rows if i is not None}
    for g, ids in nodes.items():
        for i in ids:
            c, k, n = out[i]
            out[i] = min(c, label[g]), k + len(ids) - 1, n + sum(len(nodes[h]) for h in linked[g])
    return out


def classes(df):
    return {r["doc_id"]: (r["class_id"], r["n_copies"], r["n_links"]) for r in J.jaccard_classes(df).collect()}


def test_classes_against_brute_force(spark):
    rows = corpus(3)
    rows += [(None, rows[0][1]), rows[0], (500, rows[3][1] + " x"), (500, "another text of this id altogether"), (501, "word " * 40_000 + "end"), (502, "word " * 40_000 + "end")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, Class_Id string").repartition(3)
    assert classes(df) == classes_brute(rows)
    assert J.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_many_near_copies_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(f"v{rng.randrange(9)}" if rng.random() < 0.02 else w for w in base)) for k in range(300)]
    rows += [(1000 + k, " ".join([*base[:55], f"x{k}"])) for k in range(20)]
    want = classes_brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert classes(df) == want
    monkeypatch.setattr(J, "BLOCK", 50)
    monkeypatch.setattr(J, "LEAF", 8)
    assert classes(df) == want
    kept = {r["doc_id"] for r in J.deduplicate(df).collect()}
    assert kept == {c for c, _, _ in want.values()}


def test_components_of_long_chains(spark):
    rng = random.Random(3)
    name = rng.sample(range(10_000), 400)
    edges = [(name[k], name[k + 1]) for k in range(299)] + [(name[k], name[300]) for k in range(301, 400)]
    got = {r["node"]: r["root"] for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(name[:300], min(name[:300])), **dict.fromkeys(name[300:], min(name[300:]))}


def test_deduplicate_keeps_one_of_each_group(spark):
    rows = corpus(1)
    df = spark.createDataFrame([*rows, (None, rows[0][1]), rows[5], rows[5]], "doc_id long, text string")
    kept = [tuple(r) for r in J.deduplicate(df).collect()]
    root = {i: i for i, _ in rows}
    for a, b in sorted(brute(rows)):
        x, y = sorted((root[a], root[b]))
        root = {k: x if v == y else v for k, v in root.items()}
    want = sorted(i for i, _ in rows if root[i] == i)
    assert sorted(i for i, _ in kept if i is not None) == want
    assert sum(i is None for i, _ in kept) == 1


def test_blocks_of_a_large_region_find_the_same(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join(f"v{rng.randrange(50)}" if rng.random() < 0.03 else w for w in base)) for k in range(40)]
    monkeypatch.setattr(J, "BLOCK", 9)
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == pytest.approx(brute(rows))


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_voronoi_recursion_is_exact(least):
    rng = np.random.default_rng(7)
    sets = []
    for _ in range(25):
        base = rng.integers(0, 1 << 40, 60).astype(np.uint64)
        for _ in range(rng.integers(1, 20)):
            own = base.copy()
            own[rng.random(60) < rng.choice([0.02, 0.1, 0.3])] += np.uint64(1 + rng.integers(9))
            sets.append(np.unique(own))
    want = {}
    for a, b in itertools.combinations(range(len(sets)), 2):
        k = len(np.intersect1d(sets[a], sets[b]))
        if (j := k / (len(sets[a]) + len(sets[b]) - k)) >= least:
            want[a, b] = j
    assert J.voronoi_pairs(sets, least, leaf=8) == pytest.approx(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_join(df).collect() == [] and J.deduplicate(df).collect() == []
