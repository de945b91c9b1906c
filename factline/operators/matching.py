"""One-to-one matching of two fact tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factline.functions.scalars import jaccard
from factline.ship import ship

#: Least similarity of a pair, and the head start of pairs of equal names.
LEAST, HEAD_START = 0.6, 0.05


def similarity(same_context: Column, same_name: Column, evidence_a: Column, evidence_b: Column, line_a: Column, line_b: Column) -> Column:
    """Half context (0.7 of it for equal primary names alone), 0.35 Jaccard of
    evidence and 0.15 nearness of lines."""
    ctx = F.when(same_context, F.lit(1.0)).when(same_name, F.lit(0.7)).otherwise(F.lit(0.0))
    return F.lit(0.5) * ctx + F.lit(0.35) * jaccard(evidence_a, evidence_b) + F.lit(0.15) * F.exp(-F.abs(line_a - line_b) / F.lit(50.0))


def greedy(pairs: DataFrame, by: Sequence[str], left: str, right: str, order: Sequence[Column]) -> DataFrame:
    """Best first, each end used once, within each group ``by``. ``order`` must be
    total. A pair that is the best of both its ends is taken and both ends go, again
    and again; that gives the sequential result, since no later choice can take either end."""
    from factline.operators.graph import _written

    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    left_pairs = _written(pairs.withColumn("__rank", rank), "greedy")
    taken = None
    while True:
        best_l = F.min("__rank").over(W.partitionBy(*by, left))
        best_r = F.min("__rank").over(W.partitionBy(*by, right))
        marked = left_pairs.withColumns({"__l": best_l, "__r": best_r})
        win = _written(marked.filter("__rank = __l AND __rank = __r").drop("__l", "__r"), "win")
        if win.isEmpty():
            break
        taken = win if taken is None else taken.unionByName(win)
        left_pairs = _written(left_pairs.join(win.select(*by, left), [*by, left], "left_anti").join(win.select(*by, right), [*by, right], "left_anti"), "rest")
    return (taken if taken is not None else left_pairs.limit(0)).drop("__rank")


def match_order(score: str, same_name: str, left: str, right: str) -> list[Column]:
    """By similarity, equal names 0.05 ahead; then equal names; then places."""
    return [F.desc(F.col(score) + F.when(F.col(same_name), F.lit(HEAD_START)).otherwise(F.lit(0.0))), F.desc(same_name), F.asc(left), F.asc(right)]


def sequential(pairs: DataFrame, by: Sequence[str], left: str, right: str, score: str) -> DataFrame:
    """Left rows choose in order; each takes the best free right row, the earliest
    of equals. Groups are independent; inside one, choices follow one another."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        used, keep = set(), []
        for _, own in pdf.sort_values([left, score, right], ascending=[True, False, True], kind="stable").groupby(left, sort=True):
            free = own[~own[right].isin(used)]
            if len(free):
                used.add(free.iloc[0][right])
                keep.append(free.index[0])
        return pdf.loc[keep]

    return pairs.groupBy(*by).applyInPandas(choose, pairs.schema)


def kth_occurrence(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: str, right_order: str) -> DataFrame:
    """The k-th left row of a key with the k-th right row of it."""
    k = lambda o: F.row_number().over(W.partitionBy(*keys).orderBy(o))
    return left.withColumn("k", k(left_order)).join(right.withColumn("k", k(right_order)), [*keys, "k"])


#: Rows of either side that one task compares at once, and pairs that a task is given.
BLOCK, PAIRS = 2048, 1 << 22


def jaccard_pairs(rows: DataFrame, by: Sequence[str], key: str, words: str, least: float, block: int = BLOCK) -> DataFrame:
    """Pairs ``a`` < ``b`` of keys (integers) within a group ``by`` whose distinct ``words`` (arrays of strings without nulls) have a
    Jaccard similarity of ``least`` (over 0) or more; 1 if both are empty, none for null keys, groups or words.

    The pairs themselves grow with the square of a group. Large groups are cut into blocks and each two blocks meet in one place, which holds
    no more than they and their pairs; equal sets are compared once. Tasks are as many as the pairs that there could be ask for, however few bytes go in."""
    ship(rows.sparkSession)
    rows = rows.select(*by, F.col(key).cast("long").alias("__key"), F.col(words).alias("__words"))
    for c in rows.columns:
        rows = rows.filter(F.col(c).isNotNull())
    many = rows.groupBy(*by).count().agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0] or 0.0
    group = W.partitionBy(*by)
    m = F.ceil(F.count("*").over(group) / F.lit(block)).cast("int")
    rows = rows.withColumns({"__m": m, "__k": F.floor((F.row_number().over(group.orderBy("__key")) - 1) / F.lit(block)).cast("int")})
    rows = rows.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__m") - 1)))
    rows = rows.select(*by, F.least("__k", "__o").alias("__i"), F.greatest("__k", "__o").alias("__j"), "__k", "__key", "__words")
    at = [*by, "__i", "__j"]

    def compare(table: pa.Table) -> pa.Table:
        i, j = table["__i"][0].as_py(), table["__j"][0].as_py()
        k, keys = table["__k"].to_numpy(), table["__key"].to_numpy()
        sets, of = {}, np.empty(len(keys), np.int64)
        for n, w in enumerate(table["__words"].to_pylist()):
            of[n] = sets.setdefault(frozenset(w), len(sets))
        sizes, lists = np.array([len(x) for x in sets]), {}
        for n, x in enumerate(sets):
            for w in x:
                lists.setdefault(w, []).append(n)
        holds = {w: np.array(x) for w, x in lists.items()}
        order = np.lexsort((keys, of))
        mine, theirs = order[k[order] == i], order[k[order] == j]
        first = np.searchsorted(of[mine], np.arange(len(sets) + 1))
        second = np.searchsorted(of[theirs], np.arange(len(sets) + 1))
        out = ([], [], [])
        for n, x in enumerate(sets):
            own = keys[mine[first[n] : first[n + 1]]]
            if not len(own):
                continue
            common = np.bincount(np.concatenate([holds[w] for w in x]), minlength=len(sets)) if x else np.zeros(len(sets), np.int64)
            union = sizes + len(x) - common
            share = np.where(union > 0, common / np.maximum(union, 1), 1.0)
            good = np.flatnonzero(share >= least)
            runs = second[good + 1] - second[good]
            ends = np.cumsum(runs)
            if not len(ends) or not ends[-1]:
                continue
            at = theirs[np.arange(ends[-1]) + np.repeat(second[good] - (ends - runs), runs)]
            a, b = np.repeat(own, len(at)), np.tile(keys[at], len(own))
            score = np.tile(np.repeat(share[good], runs), len(own))
            keep = a < b if i == j else a != b
            out[0].append(np.minimum(a, b)[keep])
            out[1].append(np.maximum(a, b)[keep])
            out[2].append(score[keep])
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        return pa.table({"a": join(out[0], np.int64), "b": join(out[1], np.int64), "jaccard": join(out[2], np.float64)})

    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, min(100_000, round(many / 2 / PAIRS)))
    return rows.repartition(tasks, *at).groupBy(*at).applyInArrow(compare, "a long, b long, jaccard double")


#: Words, and characters of words, of a left side that every task may hold.
HELD_WORDS, HELD_CHARACTERS = 1 << 20, 1 << 24


def overlap_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, words: str, least: float, held: int = HELD_WORDS) -> DataFrame:
    """Pairs whose distinct ``words`` (arrays without nulls; ids are unique) overlap by ``least`` or more, as a share of the longer list.

    A left side of ``held`` words or fewer (they are counted) is held by every task, which counts what right lists share with it as they pass:
    none of the right side moves. A larger one is joined. Two lists with enough in common share one of the rarest words of each, all but its last ``least`` n - 1, so
    only those are joined, never the commonest ones; the pairs found are then compared outright. Empty lists have no pairs."""
    n, characters = left.agg(F.sum(F.size(words)), F.sum(F.aggregate(words, F.lit(0).cast("long"), lambda x, w: x + F.length(w)))).first()
    if (n or 0) <= held and (characters or 0) <= HELD_CHARACTERS:
        return _overlap_held(left, right, left_id, right_id, words, least)
    need = lambda n: F.greatest(F.lit(1), F.ceil(n * F.lit(float(least)) - F.lit(1e-9)))
    flat = lambda df, i: df.select(F.col(i).alias("__id"), F.size(words).alias("__n"), F.explode(words).alias("__t"))
    # Lists too short or too long for every left one have no partner, and aren't taken apart.
    low, high = left.filter(F.size(words) > 0).agg(F.min(F.size(words)), F.max(F.size(words))).first()
    n = F.size(words)
    right = right.filter((n >= need(F.lit(low))) & (F.lit(high) >= need(n)))
    l, r = flat(left, left_id), flat(right, right_id)
    seen = l.select("__t").unionByName(r.select("__t")).groupBy("__t").agg(F.count("*").alias("__f"))

    def rare(df: DataFrame) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("__id").orderBy("__f", "__t"))
        return df.join(seen, "__t").withColumn("__k", rank).filter(F.col("__k") <= F.col("__n") - need(F.col("__n")) + 1)

    a = rare(l).select("__t", F.col("__id").alias(left_id), F.col("__n").alias("__nl"))
    b = rare(r).select("__t", F.col("__id").alias(right_id), F.col("__n").alias("__nr"))
    sized = (F.col("__nl") >= need(F.col("__nr"))) & (F.col("__nr") >= need(F.col("__nl")))
    pairs = a.join(b, "__t").filter(sized).select(left_id, right_id).distinct()
    pairs = pairs.join(left.select(left_id, F.col(words).alias("__l")), left_id).join(right.select(right_id, F.col(words).alias("__r")), right_id)
    share = F.size(F.array_intersect("__l", "__r")) / F.greatest(F.size("__l"), F.size("__r"))
    return pairs.select(left_id, right_id, share.alias("overlap")).filter(F.col("overlap") >= F.lit(float(least)))


#: Words of right lists that meet left ones, and cells of right by left rows, that a task counts at once.
MEETINGS, CELLS = 1 << 22, 1 << 22


def _overlap_held(left: DataFrame, right: DataFrame, left_id: str, right_id: str, words: str, least: float) -> DataFrame:
    """Every right list's words are looked up among the left side's, and its meetings with each left list counted."""
    ship(left.sparkSession)
    mine = left.select(F.col(left_id).alias("i"), F.col(words).alias("w")).filter(F.size("w") > 0).toArrow()
    ids, lists = mine["i"].combine_chunks(), mine["w"].combine_chunks()
    flat = lists.flatten()
    vocabulary = flat.unique()
    at, of = pc.index_in(flat, vocabulary).to_numpy(), pc.list_parent_indices(lists).to_numpy()
    of = of[np.argsort(at, kind="stable")]  # the left lists of each word
    first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(vocabulary)))])
    sizes = pc.list_value_length(lists).to_numpy()
    sent = left.sparkSession.sparkContext.broadcast((ids, vocabulary, of, first, sizes))
    out = T.StructType([left.select(left_id).schema[0], right.select(right_id).schema[0], T.StructField("overlap", T.DoubleType())])

    def run(batches):
        ids, vocabulary, of, first, sizes = sent.value
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            theirs, lists = b.column(0), b.column(1)
            long = pc.list_value_length(lists).to_numpy()
            hit = pc.index_in(lists.flatten(), vocabulary)
            known = hit.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(long)), long)[known]
            hit = hit.drop_null().to_numpy()
            many = first[hit + 1] - first[hit]
            # Parts of whole right lists, of few enough meetings and rows.
            meetings = np.concatenate([[0], np.cumsum(np.bincount(row, weights=many, minlength=len(long)).astype(np.int64))])
            start = 0
            while start < len(long):
                end = int(np.searchsorted(meetings, meetings[start] + MEETINGS, side="right")) - 1
                end = min(max(end, start + 1), start + max(1, CELLS // max(1, len(sizes))), len(long))
                lo, hi = np.searchsorted(row, [start, end])
                m = many[lo:hi]
                ends = np.cumsum(m)
                if len(ends) and ends[-1]:
                    met = of[np.arange(ends[-1]) + np.repeat(first[hit[lo:hi]] - (ends - m), m)]
                    cells = np.bincount(np.repeat(row[lo:hi] - start, m) * len(sizes) + met, minlength=(end - start) * len(sizes))
                    found = np.flatnonzero(cells)
                    r, l = found // len(sizes) + start, found % len(sizes)
                    share = cells[found] / np.maximum(sizes[l], long[r])
                    good = share >= least
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(l[good])), theirs.take(pa.array(r[good])), pa.array(share[good])], names=out.names)
                start = end

    return right.select(right_id, words).mapInArrow(run, out)


def unique_suffix(names: DataFrame, entries: DataFrame, name: str, entry: str) -> DataFrame:
    """Each name's entry: the equal one, else the only one that ends with a dot and the name's last part."""
    tail = lambda c: F.regexp_extract(F.col(c), r"([^.]+)$", 1)
    only = entries.groupBy(tail(entry).alias("__tail")).agg(F.count("*").alias("__n"), F.min(entry).alias("__only"))
    exact = entries.select(F.col(entry).alias("__exact"))
    out = names.join(exact, F.col(name) == F.col("__exact"), "left").join(only.filter("__n = 1"), tail(name) == F.col("__tail"), "left")
    return out.select(*names.columns, F.coalesce("__exact", "__only").alias(entry))
