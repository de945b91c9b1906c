"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.common import fresh, own, stash

SEED = 20
#: Share of each source is proportional to its document count to this power.
TEMPERATURE = 0.7
#: A Poisson table holds what lies within so many deviations (and STEPS) of the mean; beyond is less than 2**-52 of the mass.
DEVIATIONS, STEPS = 12, 24
#: Copies that one task makes of a row; a row of more is spread over tasks.
COPIES = 1000


def _pick(seed: int, parts: str) -> str:
    """52 uniform bits of an MD5 as a long; spelt alike in Spark and DuckDB."""
    return f"substring(md5(concat('{seed}', ':', {parts})), 1, 13)"


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    size: float = 1.0,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Each row, repeated Poisson(rate of its source) times, in random order.

    ``weights`` maps a source to its target weight (any scale; a source that is
    missing there gets 0 and vanishes); without it a source's weight is its
    row count to the power ``TEMPERATURE``. Rate = size * total rows * share /
    rows of the source, so that the expected output has ``size`` times the
    input's rows, in the target proportions. The count of a row inverts the
    Poisson distribution at a uniform number hashed from (seed, id): the same
    row always gets the same count, on any cluster and after any retry. The distribution is
    tabulated outwards from its mode and divided by its sum, so that no rate is too
    large for it. A row of more than ``COPIES`` copies is spread over tasks before it is
    multiplied. Weights of 0 (or all of them 0) give no rows.

    Columns: the input's, then ``copy_no`` (from 0) and ``shuffle_key``; input
    columns of those names give way. A null source is a source of its own.
    Rows with the same id (or a null id) share their count and keys. Text is never
    looked at. An empty table gives an empty one. The global shuffle sends
    every copy to the partition its key says and sorts by the key there.
    """
    spark = docs.sparkSession
    src, n, total, w, rate, cdf, low, u = (fresh(docs, x) for x in ("_mix_source", "_mix_n", "_mix_total", "_mix_w", "_mix_rate", "_mix_cdf", "_mix_low", "_mix_u"))
    source, ident = F.col(f"`{source_col}`"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rows = docs.groupBy(source.alias(src)).agg(F.count("*").alias(n))
    if weights is None:
        rows = rows.withColumn(w, F.pow(F.col(n).cast("double"), F.lit(TEMPERATURE)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], f"`{src}_k` string, `{w}` double")
        rows = rows.join(given, F.col(src).cast("string").eqNullSafe(F.col(f"{src}_k")), "left").drop(f"{src}_k").fillna(0.0, [w])
    sums = rows.agg(F.sum(n).alias(total), F.sum(w).alias(f"{w}_sum"))
    rates = rows.crossJoin(sums).select(src, F.when(F.col(f"{w}_sum") > 0, F.lit(float(size)) * F.col(total) * F.col(w) / F.col(f"{w}_sum") / F.col(n)).otherwise(0.0).alias(rate))
    rates = rates.filter(F.col(rate) > 0).withColumn(low, F.expr(f"cast(greatest(0, floor({rate} - {DEVIATIONS} * sqrt({rate}) - {STEPS})) as int)"))
    # Written first, so that the planner sees its true size: a few sources are
    # broadcast without a hint, millions of them join by shuffle.
    rates = stash(rates.withColumn(cdf, F.expr(_table(rate, low))).drop(rate), "rates")
    uniform = (F.conv(F.expr(_pick(seed, f"coalesce(cast(`{id_col}` as string), '')")), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    counted = docs.withColumn(u, uniform).join(rates, source.eqNullSafe(F.col(src)))
    times = F.col(low) + F.size(F.filter(F.col(cdf), lambda c: c <= F.col(u)))
    counted = counted.withColumn(n, times).filter(F.col(n) > 0).drop(src, cdf, low)
    each = lambda df: df.withColumn(u, F.explode(F.sequence(F.lit(0), F.col(n) - 1))).drop(n)
    if (rates.agg(F.max(F.col(low) + F.size(cdf))).first()[0] or 0) <= COPIES:
        out = each(counted)
    else:
        part = counted.filter(F.col(n) > COPIES).withColumn(w, F.explode(F.sequence(F.lit(0), F.expr(f"cast(({n} - 1) div {COPIES} as int)"))))
        part = part.repartition(F.xxhash64(ident, F.col(w))).withColumn(n, F.least(F.lit(COPIES), F.col(n) - F.col(w) * COPIES))
        many = each(part).withColumn(u, F.col(u) + F.col(w) * COPIES).drop(w)
        out = each(counted.filter(F.col(n) <= COPIES)).unionByName(many)
    key = F.md5(F.concat_ws(":", F.lit(str(seed + 1)), ident, F.col(u).cast("string")))
    out = own(out, copy_no=F.col(u), shuffle_key=key).drop(u)
    return out.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


def _table(rate: str, low: str) -> str:
    """P(X <= k) for k from ``low`` on: masses relative to the mode's, outwards from there, summed and divided by their sum."""
    mode, high = f"cast(floor({rate}) as int)", f"cast(ceil({rate} + {DEVIATIONS} * sqrt({rate}) + {STEPS}) as int)"
    up = f"aggregate(sequence({mode} + 1, {high}), array(1D), (a, k) -> concat(a, array(element_at(a, -1) * {rate} / k)))"
    down = f"if({mode} > {low}, aggregate(sequence({mode}, {low} + 1, -1), array(1D), (a, k) -> concat(a, array(element_at(a, -1) * k / {rate}))), array(1D))"
    mass = f"concat(slice(reverse({down}), 1, size({down}) - 1), {up})"
    run = f"aggregate({mass}, array(0D), (a, x) -> concat(a, array(element_at(a, -1) + x)), a -> slice(a, 2, size(a) - 1))"
    return f"aggregate(array({run}), array(0D), (z, a) -> transform(a, c -> c / element_at(a, -1)))"


def poisson(rate: float, u: float) -> int:
    """The inversion for one row, for tests."""
    if rate <= 0:
        return 0
    low, mode = max(0, math.floor(rate - DEVIATIONS * math.sqrt(rate) - STEPS)), math.floor(rate)
    up, down = [1.0], [1.0]
    for k in range(mode + 1, math.ceil(rate + DEVIATIONS * math.sqrt(rate) + STEPS) + 1):
        up.append(up[-1] * rate / k)
    for k in range(mode, low, -1):
        down.append(down[-1] * k / rate)
    mass = [*down[:0:-1], *up]
    run = []
    for x in mass:
        run.append((run[-1] if run else 0.0) + x)
    return low + sum(c / run[-1] <= u for c in run)


def oracle() -> str:
    return f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE * sum(n) OVER () * pow(n::DOUBLE, {TEMPERATURE}) / sum(pow(n::DOUBLE, {TEMPERATURE})) OVER () / n AS rate FROM n),
b AS (SELECT source, rate, greatest(0, floor(rate - {DEVIATIONS} * sqrt(rate) - {STEPS}))::INT AS low, ceil(rate + {DEVIATIONS} * sqrt(rate) + {STEPS})::INT AS high FROM r),
up AS (SELECT source, rate, high, floor(rate)::INT AS k, 1.0::DOUBLE AS p FROM b
       UNION ALL SELECT source, rate, high, k + 1, p * rate / (k + 1) FROM up WHERE k < high),
down AS (SELECT source, rate, low, floor(rate)::INT AS k, 1.0::DOUBLE AS p FROM b
         UNION ALL SELECT source, rate, low, k - 1, p * k / rate FROM down WHERE k > low),
p AS (SELECT source, k, p FROM up UNION ALL SELECT source, k, p FROM down WHERE k < floor(rate)),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) / sum(p) OVER (PARTITION BY source) AS cdf FROM p),
d AS (SELECT *, (('0x' || substr(md5(concat('{SEED}', ':', coalesce(doc_id::VARCHAR, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / pow(2, 52) AS u FROM documents),
t AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT min(low) FROM b WHERE b.source IS NOT DISTINCT FROM d.source) + count(c.k) AS times
      FROM (SELECT *, row_number() OVER () AS rid FROM d) d LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source AND c.cdf <= d.u GROUP BY d.rid, d.doc_id, d.text, d.lang, d.source, d.n_chars)
SELECT doc_id, text, lang, source, n_chars, copy_no::INT AS copy_no, md5(concat_ws(':', '{SEED + 1}', coalesce(doc_id::VARCHAR, ''), copy_no::VARCHAR)) AS shuffle_key
FROM (SELECT *, unnest(range(times)) AS copy_no FROM t)"""
