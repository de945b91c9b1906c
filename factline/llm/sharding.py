"""Two-pass external shuffle: scatter into buckets, then Fisher-Yates in each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factline.llm.common import pieces, plainly, small, stash
from factline.llm.tokens import trim
from factline.ship import ship

SEED = 41
#: Text bytes that one bucket should hold.
BUCKET_BYTES = 32 << 20


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """The order in which a bucket's n records (in canonical order) are read."""
    order = np.arange(n)
    if n > 1:
        # One draw below i + 1 for each i, from the bucket's own stream.
        at = np.random.Generator(np.random.PCG64([seed, bucket])).integers(0, np.arange(n, 1, -1))
        seq = order.tolist()
        for i, j in zip(range(n - 1, 0, -1), at.tolist()):
            seq[i], seq[j] = seq[j], seq[i]
        order = np.array(seq)
    return order


def _numbered(docs: DataFrame, keys: list[Column], h: str, salt: str) -> DataFrame:
    """``docs`` with a seeded hash ``h`` of all columns and, in ``salt``, the place
    among equal rows of those that occur more than once (0 for others).

    Only hashes are counted, combined before they are shuffled. Repeated rows alone are then
    numbered: within a task by occurrence, and by task; since they are equal, it doesn't
    matter which gets which number, and a retried task gives the same numbers out."""
    row = docs.withColumn(h, F.xxhash64(*keys))
    twice = stash(row.groupBy(F.col(h).alias("__twice")).agg(F.count("*").alias("n")).filter("n > 1").select("__twice"), "shard-repeated")
    if twice.isEmpty():
        return row.withColumn(salt, F.lit(0).cast("long"))
    row = row.withColumn(salt, F.lit(0).cast("long"))
    at = F.col(h) == F.col("__twice")

    def number(batches):
        seen: dict[int, int] = {}
        task = TaskContext.get().partitionId() << 40
        for b in batches:
            place = []
            for x in b[h].to_pylist():
                seen[x] = k = seen.get(x, 0) + 1
                place.append(task + k)
            yield b.set_column(b.schema.names.index(salt), salt, pa.array(place, pa.int64()))

    again = row.join(small(twice), at, "left_semi")
    return row.join(small(twice), at, "left_anti").unionByName(again.mapInArrow(number, again.schema))


def shard(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows with ``shard`` and ``position``, shuffled.

    Pass one counts the text bytes, sets as many buckets as hold them at
    ``bucket_bytes`` each, and scatters rows by a seeded hash of all their
    columns and the id; each bucket is one partition. Pass two sorts the bucket
    into its canonical order (hash, id, text), runs a Fisher-Yates shuffle seeded
    by (seed, bucket) and emits it, so a retried task gives the same order.

    Every row comes out once. Rows that repeat in all columns are numbered and scattered
    by their number as well, so that a table of one row a million times fills all buckets alike
    (which buckets they are in then depends on how the input is partitioned; being equal,
    it doesn't matter which of them gets which position). Null ids,
    texts and other columns are kept as they are. Input columns called
    ``shard`` or ``position`` give way. An empty table gives an empty one. Very
    long texts only make their bucket larger.
    """
    ship(docs.sparkSession)
    buckets = pieces(docs, f"`{text_col}`", bucket_bytes)
    kept = [c for c in docs.columns if c.lower() not in ("shard", "position")]
    # Plain names on the way: Arrow functions take no columns with dots in their names.
    plain = plainly(docs, kept)
    ident, text = (F.col(f"c{kept.index(c)}") for c in (id_col, text_col))
    types = dict(plain.dtypes)
    keys = [F.lit(seed), ident, *(F.col(c) for c in plain.columns if not types[c].startswith(("map", "variant")))]
    base = _numbered(plain, keys, h := "hash", salt := "salt")
    place = F.when(F.col(salt) > 0, F.xxhash64(F.lit(seed), F.col(h), F.col(salt))).otherwise(F.col(h))
    base = base.withColumn("shard", F.pmod(place, F.lit(buckets)).cast("int"))
    inner = base.repartitionById(buckets, F.col("shard")).sortWithinPartitions("shard", h, ident, text)
    schema = T.StructType([*plain.schema, T.StructField("shard", T.IntegerType(), False), T.StructField("position", T.LongType(), False)])
    names = schema.names

    def shuffled(batches):
        t = [b for b in batches if b.num_rows]
        if not t:
            return
        t = pa.Table.from_batches(t)
        ids = t["shard"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True])
        for a, z in zip(cuts[:-1], cuts[1:]):
            part = t.slice(a, z - a)
            order = pa.array(fisher_yates(z - a, seed, int(ids[a])))
            part = part.drop_columns([h, salt])
            for k in range(0, z - a, 2000):
                cut = order[k : k + 2000]
                piece = part.take(cut).combine_chunks()
                piece = piece.append_column("position", pa.array(np.arange(k, k + len(cut)), pa.int64()))
                yield from piece.select(names).to_batches()
                del piece
                trim()
            del part, order
        del t
        trim()

    return inner.mapInArrow(shuffled, schema).toDF(*kept, "shard", "position")


def write_shards(sharded: DataFrame, path: str) -> DataFrame:
    """Writes what :func:`shard` gives under ``path``, a folder ``shard=N`` of one Parquet file a
    bucket, rows in the order of their positions, and reads it back. ``path`` must be a folder that all executors
    share and must not exist. An empty table writes an empty folder."""
    sharded.write.partitionBy("shard").parquet(path)
    return sharded.sparkSession.read.schema(sharded.schema).parquet(path)
