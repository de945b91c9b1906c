"""N-gram Jaccard join: exact, over Voronoi regions of pivot documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factline.llm import tokens as K
from factline.llm.common import fresh, scratch, small, stash

N = 5
#: Two documents join at this Jaccard similarity of their n-gram sets.
LEAST = 0.5
#: Documents that one task compares in memory; larger regions are cut into
#: blocks, and every pair of blocks is a task.
BLOCK = 1500
#: Regions of so many documents or fewer are compared without pivots.
LEAF = 128
#: Windows that leave regions of this share of the sets or more are no use.
SMALLER = 0.7
#: Bytes of n-grams that a block holds at most, but for a single document.
BLOCK_BYTES = 48 << 20
#: Keys that one owner counts in memory.
OWNED = 2_000_000


def prefix_length(size: np.ndarray, least: float) -> np.ndarray:
    """Sets of this size that share ``least`` share one of so many first elements, in any one order of all elements."""
    return size - np.ceil(least * size - 1e-9).astype(np.int64) + 1


def _shared(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """How many elements each of ``sets`` shares with each of ``others``."""
    both = sets + (others or [])
    flat = np.concatenate(both)
    at = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, idx, df = np.unique(flat, return_inverse=True, return_counts=True)
    idx, at = idx[(keep := df[idx] > 1)], at[keep]
    _, idx = np.unique(idx, return_inverse=True)
    m = len(sets)
    out = np.zeros((m, len(both) - m if others is not None else m), np.float32)
    order = np.argsort(idx, kind="stable")
    idx, at = idx[order], at[order]
    width = 2048
    for lo in range(0, int(idx[-1]) + 1 if len(idx) else 0, width):
        a, z = np.searchsorted(idx, (lo, lo + width))
        x = np.zeros((len(both), width), np.float32)
        x[at[a:z], idx[a:z] - lo] = 1
        out += x[:m] @ (x[m:] if others is not None else x).T
    return out


def _jaccard(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    inter = _shared(sets, others).astype(np.float64)
    a = np.array([len(s) for s in sets], np.float64)
    b = a if others is None else np.array([len(s) for s in others], np.float64)
    return inter / (a[:, None] + b[None, :] - inter)


def _outright(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i < j of a similarity of ``least``, by comparing all of them, a stripe of rows at a time."""
    inter, size = _shared(sets), np.array([len(s) for s in sets], np.float64)
    found = []
    for lo in range(0, len(sets), 256):
        part = inter[lo : lo + 256].astype(np.float64)
        j = part / (size[lo : lo + 256, None] + size[None, :] - part)
        a, b = np.nonzero(np.triu(j >= least - 1e-12, lo + 1))
        found.append((a + lo, b, j[a, b]))
    return tuple(np.concatenate(x) for x in zip(*found))


def region_pairs(sets: list[np.ndarray], least: float, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (i < j) of a similarity of ``least`` and their similarities, exactly and once each.

    Beyond ``leaf`` sets, about sqrt(m) of them are pivots and each set's home
    is the nearest. If d(x, y) <= delta, then d(x, home of y) <= d(x, home of x)
    + 2 delta and <= the home's radius + delta: sets within these windows are
    copied into a region, which is joined in the same way. Regions that the
    windows no longer make smaller are compared outright.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    todo = [np.arange(len(sets))]
    delta = 1 - least
    while todo:
        own = todo.pop()
        mine = [sets[i] for i in own]
        if len(own) > leaf:
            step = max(1, len(own) // min(64, int(len(own) ** 0.5)))
            d = 1 - _jaccard(mine, mine[::step])
            home = d.argmin(1)
            near = d[np.arange(len(own)), home]
            radius = np.full(d.shape[1], -1.0)
            np.maximum.at(radius, home, near)
            inside = (d <= near[:, None] + 2 * delta + 1e-9) & (d <= radius[None, :] + delta + 1e-9)
            inside[np.arange(len(own)), home] = True
            parts = {r.tobytes(): r for r in (np.flatnonzero(inside[:, q]) for q in range(d.shape[1]) if radius[q] >= 0)}
            if max(map(len, parts.values())) < SMALLER * len(own) and sum(len(r) ** 2 for r in parts.values()) < len(own) ** 2:
                todo += [own[r] for r in parts.values() if len(r) > 1]
                continue
        if len(own) > 1:
            a, b, j = _outright(mine, least)
            found.append((own[a], own[b], j))
    a, b, j = (np.concatenate(x) for x in zip(*found))
    _, once = np.unique(a * len(sets) + b, return_index=True)
    return a[once], b[once], j[once]


def voronoi_pairs(sets: list[np.ndarray], least: float, leaf: int = LEAF) -> dict[tuple[int, int], float]:
    """:func:`region_pairs` by pair."""
    return {(a, b): j for a, b, j in zip(*(x.tolist() for x in region_pairs(sets, least, leaf)))}


def _forest(m: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the pairs connect, one fewer than members: each to the least of all."""
    root = np.arange(m)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            break
        root = new
    rest = np.flatnonzero(root != np.arange(m))
    return root[rest], rest


def _requests(n: int, bits: int, own: int):
    """A chunk's distinct n-gram keys and in how many of its documents each is, by owner."""

    def ask(batches):
        for b in batches:
            for r in range(b.num_rows):
                chunk = b["chunk"][r].as_py()
                h, row, _ = K.opened(*(b[c][r].as_py() for c in ("sizes", "vocab", "at")))
                g, _ = K.sets(*K.ngrams(h, row, n))
                key, count = np.unique(g >> np.uint64(64 - bits), return_counts=True)
                cut = np.searchsorted(key, np.arange(own + 1, dtype=np.uint64) << np.uint64(bits - own.bit_length() + 1)) if own > 1 else np.array([0, len(key)])
                rows = [(o, a, z) for o, (a, z) in enumerate(zip(cut[:-1], cut[1:])) if z > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o for o, _, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([K.planes(np.diff(key[a:z], prepend=np.uint64(0))) for _, a, z in rows], pa.binary()), pa.array([K.planes(count[a:z].astype(np.uint32)) for _, a, z in rows], pa.binary())],
                    names=["owner", "chunk", "keys", "counts"],
                )
                del h, row, g, key, count
                K.trim()

    return ask


def _answer(batches):
    """For each request, the class of every key's document count: 0 for one
    document in all, then 8 to a doubling."""
    for t in K.each_owner(batches):
        yield from _told_by(t)
        K.trim()


def _told_by(t: pa.Table):
    asked = [np.cumsum(K.unplanes(x, np.uint64)) for x in t["keys"].to_pylist()]
    count = np.concatenate([K.unplanes(x, np.uint32) for x in t["counts"].to_pylist()])
    size = [len(x) for x in asked]
    _, idx = np.unique(np.concatenate(asked), return_inverse=True)
    df = np.bincount(idx, weights=count)
    cls = np.minimum(255, np.round(8 * np.log2(df))).astype(np.uint8)[idx]
    out = np.split(cls, np.cumsum(size)[:-1])
    yield pa.RecordBatch.from_arrays([t["owner"].combine_chunks().cast(pa.int32()), t["chunk"].combine_chunks().cast(pa.int64()), pa.array([x.tobytes() for x in out], pa.binary())], names=["owner", "chunk", "classes"])


def _candidates(n: int, bits: int, least: float, id_type: pa.DataType):
    """Documents whose rarest elements others have as well: only they can have partners."""

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("owner")
        cls = np.frombuffer(b"".join(right["classes"].to_pylist()), np.uint8)
        ids, node, size, blob, keys = [], [], [], [], []
        for own, sizes, vocab, at in zip(left["ids"], left["sizes"].to_pylist(), left["vocab"].to_pylist(), left["at"].to_pylist()):
            h, row, _ = K.opened(sizes, vocab, at)
            g, row = K.sets(*K.ngrams(h, row, n))
            if not len(g):
                continue
            short = g >> np.uint64(64 - bits)
            seen, idx = np.unique(short, return_inverse=True)
            if len(seen) != len(cls):
                raise ValueError("an answer is missing")
            c = cls[idx]
            begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            length = np.diff(np.r_[begin, len(row)])
            prefix = prefix_length(length, least)
            alone = np.add.reduceat((c == 0).astype(np.int64), begin)
            sign = np.add.reduceat(K.mix(g), begin)
            values = own.values
            for k in np.flatnonzero(alone < prefix):
                a, z = begin[k], begin[k] + length[k]
                # Rarest first; the key settles ties, so that all documents agree on one order.
                order = np.lexsort((short[a:z], c[a:z]))[alone[k] : prefix[k]]
                ids.append(values[int(row[a])])
                node.append(int(np.int64(K.mix(sign[k : k + 1] + np.uint64(length[k]))[0].astype(np.int64))))
                size.append(int(length[k]))
                blob.append(g[a:z].tobytes())
                keys.append(np.unique(short[a:z][order]).astype(np.int64))
        K.trim()
        offsets = np.cumsum([0, *(len(x) for x in keys)])
        return pa.table(
            [pa.array([x.as_py() for x in ids], id_type), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(blob, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys) if keys else [], pa.int64()))],
            names=["id", "node", "size", "grams", "keys"],
        )

    return pick


def _join_regions(least: float, what: str):
    """Rows come sorted by (pivot, i, j); each such task is one region, or a pair of its blocks.
    ``what``: "pairs" (each in one region only), "forest", edges that connect what joins, or
    "links", these and, with a null ``b``, how many documents a node joins.

    Two nodes may share several regions. Their pair counts in that of the least
    pivot that they share, so nothing has to be made distinct afterwards."""

    def solve(key, node, block, weight, blobs, pivots):
        order = np.argsort(node, kind="stable")
        node, block = node[order], block[order]
        a, b, j = region_pairs([np.frombuffer(blobs[k], np.uint64) for k in order], least)
        if what != "pairs":
            x, y = _forest(len(node), a, b)
            yield node[x], node[y], np.zeros(len(x)), np.zeros(len(x), bool)
        if what == "forest":
            return
        keep = block[a] != block[b] if key[1] != key[2] else np.ones(len(a), bool)
        lesser = [np.array(p, np.int64) for p in pivots]
        lesser = [p[p < key[0]].view(np.uint64) for p in (lesser[k] for k in order)]
        if any(map(len, lesser)) and keep.any():
            keep &= _shared(lesser)[a, b] == 0
        a, b, j = a[keep], b[keep], j[keep]
        if what == "pairs":
            yield node[a], node[b], j, np.zeros(len(a), bool)
            return
        weight = np.array(weight, np.float64)[order]
        n = np.bincount(a, weights=weight[b], minlength=len(node)) + np.bincount(b, weights=weight[a], minlength=len(node))
        some = np.flatnonzero(n)
        yield node[some], node[some], n[some], np.ones(len(some), bool)

    def run(batches):
        now, rows, freed = None, [], 0

        def flush():
            nonlocal rows, freed
            if len(rows) > 1:
                node, block, weight, blobs, pivots = zip(*rows)
                freed += sum(map(len, blobs))
                for a, b, j, alone in solve(now, np.array(node), np.array(block), weight, blobs, pivots):
                    for lo in range(0, len(a), 100_000):
                        cut = slice(lo, lo + 100_000)
                        yield pa.RecordBatch.from_arrays([pa.array(a[cut], pa.int64()), pa.array(b[cut], pa.int64(), mask=alone[cut]), pa.array(j[cut], pa.float64())], names=["a", "b", "value"])
            rows = []
            if freed > 8 << 20:
                freed = 0
                K.trim()

        for x in batches:
            for p, i, j, *row in zip(*(x[c].to_pylist() for c in ("pivot", "i", "j", "node", "block", "weight", "grams", "pivots"))):
                if (p, i, j) != now:
                    yield from flush()
                    now = (p, i, j)
                rows.append(row)
        yield from flush()
        K.trim()

    return run


def _found(docs: DataFrame, n: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """Documents that may have partners: id, node, size, n-grams and first keys."""
    tok = K.stash_tokens(docs, id_col, text_col, "jaccard-tokens")
    total = tok.agg(F.sum(F.octet_length("at"))).first()[0] or 0
    total //= 4
    # Short keys only count and find; what they mix up costs time, never a result.
    bits = min(63, max(24, int(total).bit_length() + 9))
    own = 1 << max(2, int(total // OWNED).bit_length())
    asked = tok.select("chunk", "sizes", "vocab", "at").mapInArrow(_requests(n, bits, own), "owner int, chunk long, keys binary, counts binary")
    told = K.to_owners(asked, own).mapInArrow(_answer, "owner int, chunk long, classes binary")
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("grams", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    from pyspark.sql.pandas.types import to_arrow_type

    found = tok.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_candidates(n, bits, least, to_arrow_type(id_type)), schema)
    return stash(found, "jaccard-candidates", keep=True)


def _solved(docs: DataFrame, n: int, least: float, id_col: str, text_col: str, what: str) -> tuple[DataFrame, DataFrame]:
    """(id, node) of documents that may have partners, and the rows (a, b, value) of
    :func:`_join_regions`, a node being a distinct n-gram set."""
    with scratch(docs.sparkSession):
        found = _found(docs, n, least, id_col, text_col)
    member = found.select("id", "node").filter("id IS NOT NULL").distinct()
    postings = found.select("node", F.explode("keys").alias("key")).distinct()
    by_key = postings.groupBy(F.col("key").alias("k")).agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot <> last").select("k", "pivot")
    stars = stash(postings.join(by_key, F.col("key") == F.col("k")).select("pivot", "node").distinct(), "jaccard-regions")
    sets = found.select(F.col("node").alias("v"), "grams", "size").dropDuplicates(["v"])
    if what != "forest":
        pivots = stars.groupBy(F.col("node").alias("w")).agg(F.collect_list("pivot").alias("pivots"))
        weight = member.groupBy(F.col("node").alias("u")).agg(F.count("*").cast("double").alias("weight"))
        sets = sets.join(pivots, F.col("v") == F.col("w")).join(weight, F.col("v") == F.col("u"), "left").select("v", "grams", "size", "pivots", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    else:
        sets = sets.select("*", F.array().cast("array<bigint>").alias("pivots"), F.lit(1.0).alias("weight"))
    size = found.select(F.col("node").alias("u"), "size").distinct()
    blocks = stars.join(size, F.col("node") == F.col("u")).groupBy(F.col("pivot").alias("p")).agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("size") * 8 / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
    place = stars.join(blocks, F.col("pivot") == F.col("p")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    member_of = place.join(sets, F.col("node") == F.col("v"))
    task = F.expr("explode(transform(sequence(0, blocks - 1), k -> struct(least(k, block) as i, greatest(k, block) as j)))")
    tasks = member_of.select("pivot", "node", "block", "weight", "grams", "pivots", task.alias("t")).select("pivot", "t.i", "t.j", "node", "block", "weight", "grams", "pivots")
    edges = tasks.repartition(F.col("pivot"), F.col("i"), F.col("j")).sortWithinPartitions("pivot", "i", "j", "node").mapInArrow(_join_regions(least, what), "a long, b long, value double")
    return member, stash(edges, "jaccard-edges")


def jaccard_join(docs: DataFrame, n: int = N, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_a`` < ``doc_b`` and ``jaccard`` of all pairs of documents whose
    sets of word n-grams have a Jaccard similarity of ``least`` or more.

    Words are runs of letters and digits in lower case; a document of fewer
    than n words has one element, all its words; a null, empty or wordless one
    has none and joins nothing. Documents with a null id can't be named
    and are left out. Rows of one id are one document: its copies don't join
    each other, and of several similarities between two ids the largest is given. Other columns are
    ignored. An empty table gives an empty one. A group of m copies has m (m - 1) / 2
    pairs: where groups are large, :func:`jaccard_classes` says the same in a row a document.

    How: documents become chunks of word hashes. Every n-gram is counted over
    all documents. In the order rarest first, a document whose first elements
    (as many as any partner would have to share one of) all occur in it alone has no partner. For the rest,
    each shared first element names a pivot, the least of the documents that
    have it among their first: a document belongs to the regions of these
    pivots and is at a distance of 1 or without shared first elements from all others. So two documents that join always share
    a region. Regions join exactly by :func:`region_pairs`; those over
    ``BLOCK`` documents or ``BLOCK_BYTES`` in pairs of blocks. n-grams are 64-bit hashes.
    """
    member, edges = _solved(docs, n, least, id_col, text_col, "pairs")
    x, y = member.select(F.col("id").alias("ia"), F.col("node").alias("na")), member.select(F.col("id").alias("ib"), F.col("node").alias("nb"))
    same = x.join(y, F.col("na") == F.col("nb")).filter("ia < ib").select("ia", "ib", F.lit(1.0).alias("jaccard"))
    cross = edges.join(x, F.col("a") == F.col("na")).join(y, F.col("b") == F.col("nb")).filter("ia <> ib")
    cross = cross.select(F.least("ia", "ib").alias("ia"), F.greatest("ia", "ib").alias("ib"), F.col("value").alias("jaccard"))
    return same.unionByName(cross).groupBy(F.col("ia").alias("doc_a"), F.col("ib").alias("doc_b")).agg(F.max("jaccard").alias("jaccard"))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node that it is connected to, of all that ``edges`` (a, b) name.

    Each round, nodes take the least root of their neighbours and then their
    root's own root, so that a chain of d edges takes about log2(d) rounds."""
    links = stash(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "jaccard-links")
    root = links.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"))
    while True:
        root = stash(root, "jaccard-roots")
        other = root.select(F.col("node").alias("b"), F.col("root").alias("theirs"))
        met = links.join(other, "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        hooked = stash(root.join(met, "node").select("node", F.least("root", "theirs").alias("root"), (F.col("theirs") < F.col("root")).alias("moved")), "jaccard-roots")
        if hooked.filter("moved").isEmpty():
            return root
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
        root = hooked.join(above, "root").select("node", F.col("above").alias("root"))


def _labels(member: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node and the least id of all that it is connected to."""
    root = member.join(components(edges.filter("b IS NOT NULL")), "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))
    root = stash(root, "jaccard-labels")
    label = root.groupBy(F.col("root").alias("r")).agg(F.min("id").alias("label"))
    return root.select("node", "root").distinct().join(label, F.col("root") == F.col("r")).select("node", "label")


def groups(docs: DataFrame, n: int = N, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``keeper`` of every document that may have a partner: the
    keeper is the least id of all that it joins, directly or by a chain, or its own.
    Null ids, wordless texts and documents that can't have partners are not listed."""
    member, edges = _solved(docs, n, least, id_col, text_col, "forest")
    return member.join(_labels(member, edges), "node").groupBy("id").agg(F.min("label").alias("keeper"))


def jaccard_classes(docs: DataFrame, n: int = N, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per id: ``doc_id``, ``class_id``, ``n_copies`` and ``n_links``.

    The join of :func:`jaccard_join` without its pairs spelt out: ``class_id`` is the least id of all
    that the document joins, directly or by a chain, or its own; ``n_copies`` counts the other documents of the
    same n-gram set, ``n_links`` those of other sets at a similarity of ``least`` or more, each of them.

    Null, empty and wordless texts have no set: they are their own class and have no
    copies and no links. Rows of a null id are left out and count for nobody. Rows of
    one id: repeated ones are one document; of different texts, their counts are added up (links and copies among them
    as well) and the least class is given. Other columns are ignored; an empty table gives an empty one.
    Every pair within a region is compared, but only sums a document and edges of a
    spanning forest leave a task.
    """
    member, edges = _solved(docs, n, least, id_col, text_col, "links")
    label = _labels(member, edges)
    links = edges.filter("b IS NULL").groupBy(F.col("a").alias("l")).agg(F.sum("value").cast("long").alias("links"))
    copies = member.groupBy(F.col("node").alias("c")).agg((F.count("*") - 1).alias("copies"))
    node = label.join(copies, F.col("node") == F.col("c")).join(links, F.col("node") == F.col("l"), "left").select("node", "label", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    told = member.join(node, "node").select("id", "label", "copies", "links")
    zero = F.lit(0).cast("long")
    every = docs.select(F.col(f"`{id_col}`").alias("id")).filter("id IS NOT NULL").select("id", F.col("id").alias("label"), zero.alias("copies"), zero.alias("links"))
    return told.unionByName(every).groupBy(F.col("id").alias("doc_id")).agg(F.min("label").alias("class_id"), F.sum("copies").alias("n_copies"), F.sum("links").alias("n_links"))


def deduplicate(docs: DataFrame, n: int = N, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows, one document of each group of :func:`groups`: that of
    the least id. A row that repeats a kept one in id and text goes as well. Rows of a null id and
    wordless texts stay."""
    g, t = fresh(docs, "__gone"), fresh(docs, "__twice")
    with scratch(docs.sparkSession):
        found = groups(docs, n, least, id_col, text_col)
        gone = stash(found.filter("keeper <> id").select(F.col("id").alias(g)), "jaccard-gone", keep=True)
    kept = docs.join(small(gone), F.col(f"`{id_col}`") == F.col(g), "left_anti")
    # Repeated rows are rare: only rows of ids that occur twice are compared.
    n_rows = kept.select(F.col(f"`{id_col}`").alias(t)).groupBy(t).agg(F.count("*").alias("n_rows"))
    twice = stash(n_rows.filter(f"n_rows > 1 AND {t} IS NOT NULL").select(t), "jaccard-twice")
    if twice.isEmpty():
        return kept
    at = F.col(f"`{id_col}`") == F.col(t)
    return kept.join(small(twice), at, "left_anti").unionByName(kept.join(small(twice), at, "left_semi").dropDuplicates([id_col, text_col]))


def oracle(n: int = N, least: float = LEAST) -> str:
    """SQL of :func:`jaccard_classes`: all pairs, and connection by a recursive query."""
    run = " || ' ' || ".join(f"w[k + {i}]" for i in range(n))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT rid, doc_id, unnest(CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE [{run} FOR k IN range(1, len(w) - {n - 2})] END) AS g FROM d WHERE len(w) > 0),
s AS (SELECT rid, doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS node FROM g GROUP BY rid, doc_id),
m AS (SELECT DISTINCT doc_id, node FROM s),
one AS (SELECT node, min(rid) AS rid, min(n) AS n FROM s GROUP BY node),
u AS (SELECT one.node, one.n, g.g FROM g JOIN one ON g.rid = one.rid),
e AS (SELECT x.node AS a, y.node AS b FROM u x JOIN u y ON x.g = y.g AND x.node <> y.node GROUP BY x.node, y.node, x.n, y.n HAVING count(*)::DOUBLE / (x.n + y.n - count(*)) >= {least}),
c AS (SELECT node, node AS root FROM one UNION SELECT e.b, c.root FROM c JOIN e ON c.node = e.a),
t AS (SELECT node, count(*) AS members, min(doc_id) AS least FROM m GROUP BY node),
k AS (SELECT c.node, min(t.least) AS class_id FROM c JOIN t ON t.node = c.root GROUP BY c.node),
l AS (SELECT e.a AS node, sum(t.members) AS links FROM e JOIN t ON t.node = e.b GROUP BY e.a)
SELECT i.doc_id, coalesce(min(k.class_id), i.doc_id) AS class_id, coalesce(sum(t.members - 1), 0)::BIGINT AS n_copies, coalesce(sum(l.links), 0)::BIGINT AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) i LEFT JOIN m ON m.doc_id = i.doc_id LEFT JOIN t ON t.node = m.node LEFT JOIN k ON k.node = m.node LEFT JOIN l ON l.node = m.node
GROUP BY i.doc_id"""
