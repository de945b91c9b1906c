"""One-to-one matching of numbers by their distance, within a group and without its pairs.

A pair's score is 1 less the distance over a scale; ``least``, the least that counts, is 0 or more. Scores fall on either side
of a value, so what is best is next to it."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factline.ship import ship

#: Values further apart than this share of the scale never have equal scores by rounding.
APART = 1e-11
_TOP = 2**63 - 1


def _floor(v: float) -> int:
    """As Spark's floor of a double."""
    if v != v:
        return 0
    return _TOP if v >= _TOP else -_TOP - 1 if v <= -_TOP - 1 else math.floor(v)


class _Stacks:
    """Right ids whose score with a left value is no number (NaN, or equal infinities), the least free one first."""

    def __init__(self, right: list[tuple], used: set):
        self.right, self.used, self.made = sorted(right, key=lambda x: x[1], reverse=True), used, {}
        self.any = any(not math.isfinite(v) for v, _ in right)

    def least(self, v: float, same: bool | None = None):
        """``same``: only those of the same floor, or only those of others."""
        if math.isfinite(v):
            if not self.any or (same is not None and (_floor(v) == 0) != same):
                return None
            key, fit = "nan", lambda w: w != w
        elif v == v:
            key, fit = (v, same), lambda w: (w == v and same is not False) or (w != w and not same)
        else:
            key, fit = ("all", same), lambda w: same is None or (_floor(w) == 0) == same
        if key not in self.made:
            self.made[key] = [i for w, i in self.right if fit(w)]
        ids = self.made[key]
        while ids and ids[-1] in self.used:
            ids.pop()
        return ids[-1] if ids else None


class _Free:
    """What is free of a group's finite values, in order. ``left`` and ``right`` have each value's ids, the least last;
    one that was taken goes wherever else it stands. Values with nothing free are skipped in almost constant time."""

    def __init__(self, left: list[tuple], right: list[tuple], used_left: set, used_right: set):
        self.values = sorted({v for v, _ in left} | {v for v, _ in right})
        at = {v: k for k, v in enumerate(self.values)}
        self.n = len(self.values)
        self.left, self.right = [[] for _ in at], [[] for _ in at]
        for side, rows in ((self.left, left), (self.right, right)):
            for v, i in sorted(rows, key=lambda x: x[1], reverse=True):
                side[at[v]].append(i)
        self.used_left, self.used_right = used_left, used_right
        self.up, self.down = list(range(self.n + 1)), list(range(-1, self.n))  # down is shifted by one

    def lefts(self, k: int):
        ids = self.left[k]
        while ids and ids[-1] in self.used_left:
            ids.pop()
        return ids[-1] if ids else None

    def rights(self, k: int):
        ids = self.right[k]
        while ids and ids[-1] in self.used_right:
            ids.pop()
        return ids[-1] if ids else None

    def above(self, k: int) -> int | None:
        """The first value from ``k`` on that has anything free."""
        up = self.up
        while k < self.n:
            if up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            elif self.rights(k) is None and self.lefts(k) is None:
                up[k] = k + 1
            else:
                return k
        return None

    def below(self, k: int) -> int | None:
        down = self.down
        while k >= 0:
            if down[k + 1] != k:
                down[k + 1] = down[down[k + 1] + 1]
                k = down[k + 1]
            elif self.rights(k) is None and self.lefts(k) is None:
                down[k + 1] = k - 1
            else:
                return k
        return None


def sequential(left: list[tuple], right: list[tuple], scale: float, least: float) -> list[tuple]:
    """(left id, right id, score): left rows (value, id) choose in order of their ids, each the best free right row, the
    least id of equals. Scores that are no number come last."""
    used: set = set()
    stacks = _Stacks(right, used)
    free = _Free([], [x for x in right if math.isfinite(x[0])], set(), used)
    rows: dict = {}
    for v, i in left:
        rows.setdefault(i, []).append(v)
    out = []
    for i in sorted(rows):
        best = None
        for v in rows[i]:
            if not math.isfinite(v):
                continue
            at = bisect_left(free.values, v)
            for k, seek, way in ((free.above(at), free.above, 1), (free.below(at - 1), free.below, -1)):
                first = None
                while k is not None:
                    s = 1.0 - abs(v - free.values[k]) / scale
                    if s < least or (first is not None and s < first):
                        break
                    first = s
                    if best is None or (-s, free.rights(k)) < best:
                        best = (-s, free.rights(k))
                    k = seek(k + way)
        if best is None:
            odd = [r for v in rows[i] if (r := stacks.least(v)) is not None]
            best = (math.nan, min(odd)) if odd else None
        if best is not None:
            used.add(best[1])
            out.append((i, best[1], -best[0]))
    return out


def greedy(left: list[tuple], right: list[tuple], scale: float, least: float, head_start: float = 0.0) -> list[tuple]:
    """(left id, right id, score), the best pair first: by score, those of equal floors ``head_start`` ahead, then these, then by ids.
    Scores that are no number come first, as in Spark's descending order.

    No pair is better than the best of two neighbours that are free. So each left value asks its neighbours alone; one that has another
    left value next to it waits until that is gone, unless values are so near that rounding makes scores equal, or ids stand at several values."""
    out, used_left, used_right = [], set(), set()
    stacks = _Stacks(right, used_right)
    if stacks.any or any(not math.isfinite(v) for v, _ in left):
        for same in (True, False):
            rows: dict = {}
            for v, i in left:
                rows.setdefault(i, []).append(v)
            for i in sorted(rows):
                odd = [] if i in used_left else [r for v in rows[i] if (r := stacks.least(v, same)) is not None]
                if odd:
                    out.append((i, min(odd), math.nan))
                    used_left.add(i)
                    used_right.add(min(odd))
    left, right = ([x for x in rows if math.isfinite(x[0]) and x[1] not in used] for rows, used in ((left, used_left), (right, used_right)))
    free = _Free(left, right, used_left, used_right)
    values, lefts, rights = free.values, free.lefts, free.rights
    floors = [_floor(v) for v in values]
    once = len({i for _, i in left}) == len(left) and len({i for _, i in right}) == len(right)
    apart = once and all(b - a > APART * scale for a, b in zip(values, values[1:]))

    def best(x: int) -> tuple | None:
        """(-rank, not same, right id, its place) of the best right row that a left value sees."""
        found = None
        for way, seek in ((0, None), (-1, free.below), (1, free.above)):
            k, first = (seek(x + way) if way else x), None
            while k is not None:
                r = rights(k)
                if r is not None:
                    s, same = 1.0 - abs(values[x] - values[k]) / scale, floors[x] == floors[k]
                    key = (-(s + (head_start if same else 0.0)), not same)
                    if s < least or (first is not None and key > first):
                        break
                    first = key
                    if found is None or (*key, r) < found[:3]:
                        found = (*key, r, k)
                if not way or apart:
                    break
                k = seek(k + way)
            if apart and found is not None and found[3] == x:
                break
        return found

    heap: list[tuple] = []
    turn = [0] * len(values)

    def push(x: int | None) -> None:
        """What the value asked for before no longer counts."""
        if x is not None and (l := lefts(x)) is not None:
            turn[x] += 1
            if (found := best(x)) is not None:
                heapq.heappush(heap, (*found[:2], l, 0 if once else found[2], x, turn[x]))

    for x in range(len(values)):
        push(x)
    while heap:
        *key, l, r, x, t = heapq.heappop(heap)
        if t != turn[x]:
            continue
        found = best(x)
        if lefts(x) != l or found is None or [*found[:2]] != key or (not once and found[2] != r):
            push(x)
            continue
        r, k = found[2:]
        out.append((l, r, 1.0 - abs(values[x] - values[k]) / scale))
        used_left.add(l)
        used_right.add(r)
        near = {x}
        for gone in {x, k}:
            if lefts(gone) is None or rights(gone) is None:
                near |= {free.below(gone - 1), free.above(gone + 1)}
        for y in near:
            push(y)
    return out


def match(left: DataFrame, right: DataFrame, by: Sequence[str], left_id: str, right_id: str, left_value: str, right_value: str, choose: Callable[[list, list], list]) -> DataFrame:
    """``left_id``, ``right_id`` and ``score`` of the pairs that ``choose`` makes of each group's (value, id) rows. Rows with a null are
    left out. A task holds a group's rows, never its pairs: time and memory grow with the rows."""
    spark = left.sparkSession
    ship(spark)
    side = lambda df, i, v, is_left: df.select(*by, F.col(i).cast("long").alias("__id"), F.col(v).cast("double").alias("__value"), F.lit(is_left).alias("__left"))
    rows = side(left, left_id, left_value, True).unionByName(side(right, right_id, right_value, False))
    for c in rows.columns:  # dropna would take NaN as well
        rows = rows.filter(F.col(c).isNotNull())

    def of_group(table: pa.Table) -> pa.Table:
        sides: tuple[list, list] = ([], [])
        for i, v, is_left in zip(table["__id"].to_pylist(), table["__value"].to_pylist(), table["__left"].to_pylist()):
            sides[not is_left].append((v, i))
        found = choose(*sides) if all(sides) else []
        columns = zip(*found) if found else ([], [], [])
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=[left_id, right_id, "score"])

    out = T.StructType([T.StructField(left_id, T.LongType()), T.StructField(right_id, T.LongType()), T.StructField("score", T.DoubleType())])
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).groupBy(*by).applyInArrow(of_group, out)
