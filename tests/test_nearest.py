"""Matching by distance against all pairs, with the operators that take pairs and with plain loops."""

import math
import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from factline.operators import matching, nearest

KINDS = [
    lambda r: round(r.expovariate(1 / 50), 2),
    lambda r: round(r.random() * 3, 1),
    lambda r: r.choice([math.nan, math.inf, -math.inf, 0.5, -0.5, 0.0, -0.0, 7.25, 1e17]),
    lambda r: 1 + r.randrange(6) * 2e-16 * r.choice([1, 50]),
    lambda r: r.choice([5.0, 5.1, 5.2, 90.0]),
]


def pairs(left, right, least):
    scored = [(i, j, 1.0 - abs(v - w) / 100.0, nearest._floor(v) == nearest._floor(w)) for v, i in left for w, j in right]
    return [p for p in scored if p[2] != p[2] or p[2] >= least]


def brute_sequential(left, right, least):
    found, used, out = pairs(left, right, least), set(), []
    for i in sorted({p[0] for p in found}):
        own = [p for p in found if p[0] == i and p[1] not in used]
        if own:
            p = min(own, key=lambda p: (p[2] != p[2], 0 if p[2] != p[2] else -p[2], p[1]))
            used.add(p[1])
            out.append(p[:3])
    return out


def brute_greedy(left, right, least):
    used, out = set(), []
    for p in sorted(pairs(left, right, least), key=lambda p: (p[2] == p[2], 0 if p[2] != p[2] else -(p[2] + (0.05 if p[3] else 0.0)), not p[3], p[0], p[1])):
        if ("l", p[0]) not in used and ("r", p[1]) not in used:
            used |= {("l", p[0]), ("r", p[1])}
            out.append(p[:3])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_choices_without_pairs_equal_those_of_all_pairs(seed):
    rng = random.Random(seed)
    for n in range(300):
        kinds = [rng.choice(KINDS) for _ in range(rng.choice([1, 2, 3]))]
        ids = lambda m: [rng.randrange(m) for _ in range(m)] if n % 4 == 0 else rng.sample(range(40), m)  # noqa: B023, E731
        left, right = ([(rng.choice(kinds)(rng), i) for i in ids(rng.randrange(1, 14))] for _ in "lr")
        for least in (0.6, 0.95):
            assert repr(sorted(nearest.sequential(left, right, 100.0, least))) == repr(sorted(brute_sequential(left, right, least)))
            got, want = nearest.greedy(left, right, 100.0, least, 0.05), brute_greedy(left, right, least)
            assert sorted(p[:2] for p in got) == sorted(p[:2] for p in want)
            if n % 4:  # an id at two values may leave the score open
                assert repr(sorted(got)) == repr(sorted(want))


def test_a_group_of_many_rows_needs_none_of_its_pairs():
    """400,000,000 pairs, of which no list is made."""
    rng = random.Random(9)
    left, right = ([(round(rng.expovariate(1 / 50), 2), 2 * k + odd) for k in range(20_000)] for odd in (0, 1))
    for choose in (nearest.sequential, partial(nearest.greedy, head_start=0.05)):
        got = choose(left, right, scale=100.0, least=0.6)
        assert len({p[0] for p in got}) == len({p[1] for p in got}) == len(got) > 19_000


def test_match_equals_the_operators_of_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), k, rng.choice([None, *(rng.choice(KINDS[:3])(rng) for _ in range(9))])) for k in range(120)]
    df = spark.createDataFrame(rows, "g int, k long, v double")
    left, right = df.filter("k % 2 = 0").withColumnsRenamed({"k": "l", "v": "x"}), df.filter("k % 2 = 1").withColumnsRenamed({"k": "r", "v": "y"})
    every = left.join(right, "g").select("g", "l", "r", (F.lit(1.0) - F.abs(F.col("x") - F.col("y")) / 100.0).alias("score"), (F.floor("x") == F.floor("y")).alias("same")).filter("score >= 0.6D")
    got = lambda choose, **more: sorted(repr(tuple(x)) for x in nearest.match(left, right, ["g"], "l", "r", "x", "y", partial(choose, scale=100.0, least=0.6, **more)).collect())
    want = lambda df: sorted(repr((x.l, x.r, math.nan if x.score is None else x.score)) for x in df.collect())  # noqa: E731  # pandas makes null of NaN
    assert got(nearest.sequential) == want(matching.sequential(every, ["g"], "l", "r", "score"))
    assert got(nearest.greedy, head_start=0.05) == want(matching.greedy(every, ["g"], "l", "r", matching.match_order("score", "same", "l", "r")))
