import numpy as np
import pytest
from pyspark.sql import functions as F

from factline.llm.sharding import SEED, fisher_yates, shard, write_shards

SCHEMA = "doc_id long, text string, source string, Shard string"


def rows(df):
    return [tuple(r) for r in df.orderBy("shard", "position").collect()]


def test_every_row_comes_out_once_with_dense_positions(spark):
    data = [(i, "x" * (i % 40), "s", "clash") for i in range(500)] + [(None, None, None, None), (7, "same", "s", "c"), (7, "same", "s", "c"), (8, "", "s", "c"), (9, "long " * 50_000, "s", "c")]
    df = spark.createDataFrame(data, SCHEMA)
    out = shard(df, bucket_bytes=60_000)
    assert out.columns == ["doc_id", "text", "source", "shard", "position"]
    got = out.collect()
    assert sorted((repr(tuple(r)[:3]) for r in got)) == sorted(repr(x[:3]) for x in data)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["position"])
    assert len(by) > 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_the_same_whatever_the_input_order(spark):
    df = spark.createDataFrame([(i, f"t{i}", "s", "c") for i in range(300)], SCHEMA)
    again = shard(df.repartition(7).orderBy(F.desc("doc_id")), bucket_bytes=400)
    assert rows(shard(df, bucket_bytes=400)) == rows(again)


def test_an_empty_table(spark):
    assert shard(spark.createDataFrame([], SCHEMA)).collect() == []


def test_order_depends_on_the_seed_and_is_a_permutation():
    a, b = fisher_yates(1000, 1, 0), fisher_yates(1000, 2, 0)
    assert sorted(a) == list(range(1000)) and not np.array_equal(a, b)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_buckets(n):
    assert sorted(fisher_yates(n, 3, 5)) == list(range(n))


def test_places_are_uniform():
    first = [fisher_yates(5, s, 0)[0] for s in range(4000)]
    assert (abs(np.bincount(first, minlength=5) - 800) < 120).all()


def test_rows_that_repeat_fill_all_buckets(spark):
    df = spark.range(100_000).repartition(7).selectExpr("1L as doc_id", "'same text' as text", "'s' as source", "'c' as Shard")
    rest = spark.createDataFrame([(k, "other", "s", "c") for k in range(200)], SCHEMA)
    out = shard(df.unionByName(rest), bucket_bytes=90_000).groupBy("shard").count().collect()
    n = [r["count"] for r in out]
    assert len(n) == 11 and sum(n) == 100_200 and max(n) < 1.1 * min(n)
    again = shard(df.unionByName(rest), bucket_bytes=90_000).groupBy("shard").count().collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_against_a_second_shuffle(spark):
    """Buckets by Spark's hash of the row; in each, rows in canonical order, swapped one by one from the end."""
    data = [(i, "text " * (i % 7), "s") for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = sorted(map(tuple, shard(df, bucket_bytes=2000).select("shard", "position", "doc_id").collect()))
    n = -(-sum(len(t) for _, t, _ in data) // 2000)
    hashes = df.select("doc_id", F.xxhash64(F.lit(SEED), "doc_id", "doc_id", "text", "source").alias("h")).collect()
    want = []
    for b in range(n):
        own = [r["doc_id"] for r in sorted(hashes, key=lambda r: r["h"]) if r["h"] % n == b]
        draw = np.random.Generator(np.random.PCG64([SEED, b])).integers(0, np.arange(len(own), 1, -1)).tolist()
        for i, j in zip(range(len(own) - 1, 0, -1), draw):
            own[i], own[j] = own[j], own[i]
        want += [(b, k, x) for k, x in enumerate(own)]
    assert got == sorted(want)


def test_written_shards(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.createDataFrame([(i, f"t{i}", "s", "c") for i in range(300)], SCHEMA)
    out = shard(df, bucket_bytes=400)
    back = write_shards(out, str(tmp_path / "shards"))
    assert rows(back.select(out.columns)) == rows(out)
    files = sorted((tmp_path / "shards").glob("shard=*/*.parquet"))
    assert len(files) == out.select("shard").distinct().count()
    for f in files:
        assert pq.ParquetFile(f).read(["position"])["position"].to_pylist() == list(range(pq.ParquetFile(f).metadata.num_rows))
    empty = shard(df.limit(0))
    assert write_shards(empty, str(tmp_path / "none")).collect() == []


def test_names_with_dots(spark):
    df = spark.createDataFrame([(i, f"t{i}", 1) for i in range(50)] * 2, "`a.b` long, `c.d` string, `m.n` int")
    out = shard(df, bucket_bytes=60, id_col="a.b", text_col="c.d")
    assert out.columns == ["a.b", "c.d", "m.n", "shard", "position"] and len(out.collect()) == 100
