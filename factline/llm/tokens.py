"""Words and n-grams of whole Arrow batches as 64-bit hashes, in numpy.

A word is a run of ASCII letters and digits and of any non-ASCII characters,
in lower case. Nothing loops over documents or words in Python: a batch's
UTF-8 buffer is cut and hashed at once, eight bytes a step.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def trim() -> None:
    """Gives freed memory back to the system. A Python worker outlives its
    task and shares its executor's memory with others; what the allocator
    keeps for later would count against them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> _U(30))) * _B
    x = (x ^ (x >> _U(27))) * _C
    return x ^ (x >> _U(31))


def utf8(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one after the other, and where each row
    begins (one entry more than rows). Nulls are empty."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; none crosses rows."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = IS_WORD[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads, tails = at[:-1][at[:-1] < len(raw)], at[1:][at[1:] > 0] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashed(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    size = end - begin
    h = mix(size.astype(np.uint64) * _A)
    if not len(begin):
        return h
    eight = np.ndarray((len(raw) + 1,), np.uint64, np.concatenate([raw, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    live, k = slice(None), 0
    while True:
        left = size[live] - k
        piece = eight[begin[live] + k]
        short = left < 8
        piece = np.where(short, piece & ((_U(1) << (np.where(short, left, 0).astype(np.uint64) * _U(8))) - _U(1)), piece)
        h[live] = mix(h[live] ^ piece) + _A
        k += 8
        live = np.flatnonzero(size > k) if k == 8 else live[size[live] > k]
        if not len(live):
            return h


def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the row it is in."""
    raw, at = utf8(pc.utf8_lower(text.cast(pa.large_string())))
    begin, end = spans(raw, at)
    return hashed(raw, begin, end), np.searchsorted(at, begin, "right") - 1


def ngrams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n words within rows; a row of fewer words, but one at
    least, has a single one: all its words."""
    if not len(h):
        return h, row
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[start, len(row)])
    g = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        g = mix(g + h[k : k + len(g)]) + _A
    whole = row[: len(g)] == row[n - 1 :]
    g, at = g[whole], row[: len(whole)][whole]
    few = np.flatnonzero(size < n)
    if len(few):
        extra = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            has = size[few] > k
            extra = np.where(has, mix(extra + h[np.minimum(start[few] + k, len(h) - 1)]) + _A, extra)
        g, at = np.r_[g, extra], np.r_[at, row[start[few]]]
        order = np.argsort(at, kind="stable")
        g, at = g[order], at[order]
    return g, at


def sets(g: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, sorted by row, then hash; rows come sorted."""
    if not len(g):
        return g, row
    g = g.copy()
    cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True]).tolist()
    for a, z in zip(cut[:-1], cut[1:]):
        g[a:z].sort()
    new = np.r_[True, (g[1:] != g[:-1]) | (row[1:] != row[:-1])]
    return g[new], row[new]


def chunks(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.Table]:
    """The rows in tables of about ``most`` bytes of ``column``: batches are cut
    and joined. A single row may hold more."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        each = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        # Rows go together until the running total passes the next multiple.
        part = (size + np.cumsum(each) - each) // most
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for a, z in zip(cut[:-1], cut[1:]):
            held.append(b.slice(a, z - a))
            size += int(each[a:z].sum())
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


#: Partitions that owners are spread over at most; one may hold several, one after the other.
PARTITIONS = 20_000


def to_owners(asked, own: int):
    """Requests at their owners: a partition each, or several in a row."""
    from pyspark.sql import functions as F

    if own <= PARTITIONS:
        return asked.repartitionById(own, F.col("owner"))
    return asked.repartition(PARTITIONS, F.col("owner")).sortWithinPartitions("owner")


def each_owner(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one owner after the other."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ids = b["owner"].to_numpy()
        cut = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), b.num_rows]
        for a, z in zip(cut[:-1], cut[1:]):
            if held and held[-1]["owner"][0].as_py() != ids[a]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte (all lowest bytes first), so that a codec sees
    the empty high bytes together."""
    x = np.ascontiguousarray(x)
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(b: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def stash_tokens(docs, id_col: str, text_col: str, name: str, split=None):
    """A table in the shared folder with a row per chunk of documents: its
    number, ``ids``, words per document (``sizes``), the chunk's distinct word
    hashes (``vocab``) and each word's place among them (``at``).

    It is several times smaller than the texts, is read again instead of
    them, and fixes which documents make up a chunk, so that counts asked for
    by a chunk come back to the same documents. ``split`` (of sizes, word hashes and
    their rows) marks documents that go into chunks of their own, of odd numbers.
    """
    from pyspark import TaskContext
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from factline.llm.common import stash
    from factline.ship import ship

    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), *(T.StructField(c, T.BinaryType()) for c in ("sizes", "vocab", "at"))])

    def packed(chunk, ids, sizes, h):
        vocab, at = np.unique(h, return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x], pa.binary()) for x in (planes(sizes), vocab.tobytes(), planes(at.astype(np.uint32))))],
            names=["chunk", "ids", "sizes", "vocab", "at"],
        )

    def cut(batches):
        chunk = TaskContext.get().partitionId() << 32
        for t in chunks(batches, "text"):
            h, row = words(t["text"].combine_chunks() if isinstance(t["text"], pa.ChunkedArray) else t["text"])
            ids = t["id"].combine_chunks() if isinstance(t["id"], pa.ChunkedArray) else t["id"]
            if isinstance(ids, pa.ChunkedArray):
                ids = pa.concat_arrays(ids.chunks)
            sizes = np.bincount(row, minlength=t.num_rows).astype(np.int32)
            if split is None:
                yield packed(chunk, ids, sizes, h)
            else:
                mark = split(sizes, h, row)
                for odd in (False, True):
                    mine = mark == odd
                    if mine.any():
                        yield packed(chunk + odd, ids.filter(pa.array(mine)), sizes[mine], h[mine[row]])
            chunk += 2
            del t, h, row, ids, sizes
            trim()

    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return stash(picked.mapInArrow(cut, schema), name)


def opened(sizes: bytes, vocab: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's word hashes, the document of each, and all documents' sizes."""
    n = unplanes(sizes, np.int32)
    return np.frombuffer(vocab, np.uint64)[unplanes(at, np.uint32)], np.repeat(np.arange(len(n)), n), n
