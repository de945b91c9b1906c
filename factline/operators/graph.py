"""Graph operators over edges (src, dst)."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from factline.ship import ship


def _shared(spark: SparkSession) -> str:
    """The folder that all executors share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="factline-"))
    return context.getCheckpointDir()


def _written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage between rounds, in the folder that all executors share."""
    _shared(df.sparkSession)
    return df.checkpoint()


#: Edges of a graph that every worker may hold as arrays, and pairs of root and node that one looks at together.
HELD, AT_ONCE = 1 << 24, 1 << 20


def reach(edges: DataFrame, start: DataFrame, most: int | None = None, held: int = HELD) -> DataFrame:
    """``root``, ``node`` and the fewest steps from one to the other, for every
    node that the roots in ``start`` (column node) reach.

    Where nodes are integers without nulls and edges ``held`` or fewer (they are counted), the roots are spread over tasks, each with all the
    edges: nothing but the graph and the roots moves, and time grows with the rows that come out. Otherwise each round joins only what is new."""
    found = start.select(F.col("node").alias("root"), "node", F.lit(0).alias("steps")).distinct()
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if all(isinstance(f.dataType, whole) for f in [edges.schema["src"], edges.schema["dst"], found.schema["node"]]):
        path = f"{_shared(edges.sparkSession)}/reach-{uuid.uuid4().hex}"
        edges.select("src", "dst").distinct().write.parquet(path)
        edges = edges.sparkSession.read.parquet(path)
        n, nulls = edges.agg(F.count("*"), F.count_if(F.col("src").isNull() | F.col("dst").isNull())).first()
        if n <= held and not nulls and (uri := _readable(edges.sparkSession, path)):
            return _reach_held(edges, found, most, uri)
    front, k = found, 0
    # Each round's nodes are written once; what is found is their union.
    while most is None or k < most:
        k += 1
        nxt = front.join(edges, front["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = _written(nxt.join(found, ["root", "node"], "left_anti").withColumn("steps", F.lit(k)), f"reach-{k}")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


class _Graph:
    """Edges as arrays: ``nodes`` in order, and for each the places of those it leads to, from ``first`` on."""

    def __init__(self, src: np.ndarray, dst: np.ndarray):
        self.nodes = np.unique(np.concatenate([src, dst]))
        at = np.searchsorted(self.nodes, src).astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(self.nodes)))])
        self.to = np.searchsorted(self.nodes, dst[np.argsort(at, kind="stable")]).astype(np.int32)

    def reach(self, roots: np.ndarray, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Roots, nodes and steps, in parts. As many roots go together as their fronts allow; one alone may go beyond ``AT_ONCE``."""
        at = np.searchsorted(self.nodes, roots)
        known = at < len(self.nodes)
        known[known] = self.nodes[at[known]] == roots[known]
        yield roots[~known], roots[~known], np.zeros(np.count_nonzero(~known), np.int32)
        roots, share = at[known], 1.0
        begin = 0
        while begin < len(roots):
            # At first few; then as many as the last ones' results ask for.
            some = roots[begin : begin + max(1, int(64 if begin == 0 else AT_ONCE / share))]
            begin += len(some)
            seen, out = self._from(some.astype(np.int64), most), 0
            for part in seen:
                out += len(part[0])
                yield part
            share = max(1.0, out / len(some))

    def _from(self, some: np.ndarray, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n, k = len(self.nodes), 0
        front = seen = np.arange(len(some)) * n + some  # a root's number and a node as one
        while len(front):
            who, node = front // n, front % n
            yield self.nodes[some[who]], self.nodes[node], np.full(len(front), k, np.int32)
            if k == most:
                break
            k += 1
            begin, many = self.first[node], self.first[node + 1] - self.first[node]
            ends = np.cumsum(many)
            if not len(ends) or not ends[-1]:
                break
            nxt = np.repeat(who * n, many) + self.to[np.arange(ends[-1]) + np.repeat(begin - (ends - many), many)]
            nxt.sort()
            nxt = nxt[np.concatenate([[True], nxt[1:] != nxt[:-1]])]
            at = np.searchsorted(seen, nxt)
            at[at == len(seen)] = len(seen) - 1
            front = nxt[seen[at] != nxt]
            seen = np.concatenate([seen, front])
            seen.sort(kind="stable")  # two runs in order: they are merged


def _readable(spark: SparkSession, path: str) -> str | None:
    """The folder's address, if Arrow can read there without Spark."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = re.sub("^file:/+", "file:///", p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString())
    try:
        system, at = fs.FileSystem.from_uri(uri)
        return uri if system.get_file_info(at).type == fs.FileType.Directory else None
    except (pa.ArrowException, OSError, ValueError):
        return None


_GRAPHS: dict[str, _Graph] = {}


def _graph(uri: str) -> _Graph:
    """A worker reads it once, and keeps the last one."""
    if uri not in _GRAPHS:
        _GRAPHS.clear()
        system, at = fs.FileSystem.from_uri(uri)
        edges = pq.read_table(at, filesystem=system)
        src, dst = (edges[c].to_numpy() for c in ("src", "dst"))
        if len(src) and max(src.max(), dst.max()) < 2**31 and min(src.min(), dst.min()) >= -(2**31):
            src, dst = src.astype(np.int32), dst.astype(np.int32)
        del edges
        _GRAPHS[uri] = _Graph(src, dst)
    return _GRAPHS[uri]


def _reach_held(edges: DataFrame, found: DataFrame, most: int | None, uri: str) -> DataFrame:
    """Roots are spread over three tasks for each core."""
    spark = edges.sparkSession
    ship(spark)
    out = T.StructType([found.schema["root"], found.select("node").unionByName(edges.select(F.col("dst").alias("node"))).schema["node"], found.schema["steps"]])
    kinds = [to_arrow_type(f.dataType) for f in out]

    def run(batches):
        for b in batches:
            roots = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in _graph(uri).reach(roots, most):
                yield pa.RecordBatch.from_arrays([pa.array(x).cast(kind) for x, kind in zip(part, kinds)], names=["root", "node", "steps"])

    known = found.select("root").filter("root IS NOT NULL").repartition(3 * spark.sparkContext.defaultParallelism)
    return known.mapInArrow(run, out).unionByName(found.filter("root IS NULL"))


def longest_chain(edges: DataFrame) -> DataFrame:
    """Each node's depth: steps on the longest path that ends there. Nodes on or
    behind a cycle have none, and are left out. Rounds peel off nodes all of whose
    predecessors are done, as many as the longest chain has."""
    edges = edges.select("src", "dst").distinct()
    left = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    done, k = None, 0
    while True:
        ready = _written(left.join(edges, F.col("node") == F.col("dst"), "left_anti").withColumn("depth", F.lit(k)), f"depth-{k}")
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        names = ready.select(F.col("node").alias("gone"))
        left = _written(left.join(names, F.col("node") == F.col("gone"), "left_anti"), f"left-{k}")
        edges = _written(edges.join(names, F.col("src") == F.col("gone"), "left_anti"), f"edges-{k}")
        k += 1
    return done if done is not None else left.withColumn("depth", F.lit(0)).limit(0)


#: Edges that one task may hold to list cycles; larger graphs grow paths by joins.
EDGES = 1 << 20


def cycles(edges: DataFrame, most: int | None = None, held: int = EDGES) -> DataFrame:
    """Every simple cycle (of up to ``most`` nodes, if given), once, begun at its least node:
    ``path`` and ``length``. A graph of ``held`` edges or fewer (they are counted) is searched by one task,
    by strongly connected components (:func:`simple_cycles`). In a larger one paths grow by
    joins, a round for each step, and only through nodes above their first, so that each
    cycle is found in one rotation alone."""
    e = edges.select("src", "dst").distinct()
    if most is None and e.limit(held + 1).count() <= held:
        kind = e.schema["src"].dataType
        paths_of = pa.list_(to_arrow_type(kind))

        def search(batches):
            pairs = [p for b in batches for p in zip(b["src"].to_pylist(), b["dst"].to_pylist())]
            for path in simple_cycles(pairs):
                yield pa.RecordBatch.from_arrays([pa.array([path], paths_of)], names=["path"])

        ship(edges.sparkSession)
        return e.repartition(1).mapInArrow(search, T.StructType([T.StructField("path", T.ArrayType(kind))])).withColumn("length", F.size("path"))
    paths = e.filter("src < dst").select(F.array("src", "dst").alias("path"))
    found = e.filter("src = dst").select(F.array("src").alias("path"))
    k = 1
    while most is None or k < most:
        k += 1
        last, first = F.element_at("path", -1), F.element_at("path", 1)
        closed = paths.join(e, (last == F.col("src")) & (first == F.col("dst")), "left_semi")
        found = found.unionByName(closed)
        if most is None or k < most:
            grown = paths.join(e, last == F.col("src")).filter((F.col("dst") > first) & ~F.array_contains("path", F.col("dst")))
            paths = _written(grown.select(F.concat("path", F.array("dst")).alias("path")), f"paths-{k}")
            if paths.isEmpty():
                break
    return found.withColumn("length", F.size("path"))


def _strong(after: dict, nodes: list) -> list[set]:
    """Strongly connected components of a graph, without recursion (Tarjan)."""
    index, low, on, stack, out = {}, {}, set(), [], []
    for start in nodes:
        if start in index:
            continue
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        work = [(start, iter(after.get(start, ())))]
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(after.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = set()
                    while v not in part:
                        w = stack.pop()
                        on.discard(w)
                        part.add(w)
                    out.append(part)
    return out


def simple_cycles(pairs: list[tuple]) -> Iterator[list]:
    """Simple cycles of a graph, each from its least node: within strongly connected components, where a node that
    led nowhere is blocked until something on the path behind it is free again (Johnson)."""
    after: dict = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    todo = _strong(after, sorted(after))
    while todo:
        part = todo.pop()
        s = min(part)
        inner = {v: sorted(after.get(v, set()) & part) for v in part}
        if len(part) == 1 and not inner[s]:
            continue
        path, blocked, waits, closed = [s], {s}, {v: set() for v in part}, set()
        stack = [(s, list(reversed(inner[s])))]
        while stack:
            v, rest = stack[-1]
            if rest:
                w = rest.pop()
                if w == s:
                    yield list(path)
                    closed.update(path)
                elif w not in blocked:
                    path.append(w)
                    stack.append((w, list(reversed(inner[w]))))
                    closed.discard(w)
                    blocked.add(w)
                continue
            if v in closed:
                free = [v]
                while free:
                    x = free.pop()
                    if x in blocked:
                        blocked.discard(x)
                        free += waits[x]
                        waits[x] = set()
            else:
                for w in inner[v]:
                    waits[w].add(v)
            stack.pop()
            path.pop()
        left = part - {s}
        todo += _strong({v: set(inner[v]) & left for v in left}, sorted(left))


def fan_out(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))


def used_exports(exports: DataFrame, uses: DataFrame) -> DataFrame:
    """Exports (file, name) without those that some use (dst, name) takes: by its
    name, by ``*`` or by ``* as name``. Three hash anti joins instead of one with an OR."""
    named = uses.select(F.col("dst").alias("file"), "name")
    star = uses.filter("name = '*'").select(F.col("dst").alias("file"))
    aliased = uses.filter("name LIKE '* as %'").select(F.col("dst").alias("file"), F.expr("substring(name, 6)").alias("name"))
    return exports.join(named, ["file", "name"], "left_anti").join(star, "file", "left_anti").join(aliased, ["file", "name"], "left_anti")


def recursive_reach_sql(spark: SparkSession, edges: DataFrame, most: int) -> DataFrame:
    """:func:`reach` of all nodes as one recursive query, for small graphs."""
    edges.select("src", "dst").distinct().createOrReplaceTempView("__edges")
    return spark.sql(
        f"""WITH RECURSIVE r(root, node, steps) AS (
            SELECT src, dst, 1 FROM __edges UNION ALL
            SELECT r.root, e.dst, r.steps + 1 FROM r JOIN __edges e ON e.src = r.node WHERE r.steps < {most})
        SELECT root, node, min(steps) AS steps FROM r GROUP BY root, node"""
    )
