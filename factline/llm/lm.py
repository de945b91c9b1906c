"""LM scoring by deleted interpolation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factline.llm import tokens as K
from factline.llm.common import stash

SEED = 83
#: One document in so many is held out to learn the weights.
HELD = 10
#: Contexts are bucketed by the power of two of their count; the last is open.
BUCKETS = 24
ROUNDS = 40
#: Keys that one owner counts in memory.
OWNED = 1_500_000
_START = np.uint64(0x5BF03635D1A7C9E1)


def held_out(sizes: np.ndarray, h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether each document of a chunk is held out: by a hash of its words."""
    sign = np.zeros(len(sizes), np.uint64)
    if len(h):
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        sign[row[begin]] = np.add.reduceat(K.mix(h + np.uint64(SEED)), begin)
    return K.mix(sign) % np.uint64(HELD) == 0


def _keys(sizes, vocab, at):
    """A chunk's distinct words and the start (hashes of low bit 0), its distinct bigrams
    (low bit 1), the places among them of each word, its context (the word before it, or the
    start) and their bigram, and all documents' sizes."""
    v, a, n = np.frombuffer(vocab, np.uint64), K.unplanes(at, np.uint32), K.unplanes(sizes, np.int32)
    one = np.uint64(1)
    both = np.r_[v, _START]
    uni, place = np.unique(both & ~one, return_inverse=True)
    before = np.empty(len(a), np.uint32)
    before[1:] = a[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = len(v)
    bi, j = np.unique(K.mix(K.mix(both)[before] + v[a]) | one, return_inverse=True)
    return uni, place[a], place[before], bi, j, n


def _by_owner(uni: np.ndarray, bi: np.ndarray, shift: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts both kinds of keys together by owner, and the owners in it."""
    owner = (np.r_[uni, bi] >> shift).astype(np.uint32)
    if len(owner) and int(owner.max()) < 1 << 16:
        owner = owner.astype(np.uint16)
    order = np.argsort(owner, kind="stable")
    return order, owner[order].astype(np.int64)


def _ask(own: int, shift: np.uint64):
    """Per owner: the chunk's keys, and how often each occurs as a word (or
    bigram) and as a context."""

    def ask(batches):
        for b in batches:
            for r in range(b.num_rows):
                uni, i, c, bi, j, _ = _keys(*(b[x][r].as_py() for x in ("sizes", "vocab", "at")))
                nu = len(uni)
                count = lambda k, m: np.bincount(k, minlength=m).astype(np.uint32)
                each = [np.r_[count(i, nu), count(j, len(bi))], np.r_[count(c, nu), np.zeros(len(bi), np.uint32)]]
                order, owner = _by_owner(uni, bi, shift)
                key, each = np.r_[uni, bi][order], [x[order] for x in each]
                cut = np.searchsorted(owner, np.arange(own + 1))
                rows = [(o, a, z) for o, (a, z) in enumerate(zip(cut[:-1], cut[1:])) if z > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o for o, _, _ in rows], pa.int32()), pa.array([b["chunk"][r].as_py()] * len(rows), pa.int64()), pa.array([K.planes(np.diff(key[a:z], prepend=np.uint64(0))) for _, a, z in rows], pa.binary()), pa.array([K.planes(np.concatenate([x[a:z] for x in each])) for _, a, z in rows], pa.binary())],
                    names=["owner", "chunk", "keys", "counts"],
                )
                del uni, i, c, bi, j, key, each, order, owner
                K.trim()

    return ask


def _answer(batches):
    """The same rows with the corpus's counts in place of the chunk's (for chunks of held-out
    documents, also the counts in held-out ones), and how many words the owner knows."""
    for t in K.each_owner(batches):
        yield from _told_by(t)
        K.trim()


def _told_by(t: pa.Table):
    asked = [np.cumsum(K.unplanes(x, np.uint64)) for x in t["keys"].to_pylist()]
    size = [len(x) for x in asked]
    odd = t["chunk"].to_numpy() % 2 == 1
    held = np.repeat(odd, size)
    known, idx = np.unique(np.concatenate(asked), return_inverse=True)
    del asked
    told = []
    count = [K.unplanes(x, np.uint32).reshape(2, -1) for x in t["counts"].to_pylist()]
    for k in range(2):
        each = np.concatenate([x[k] for x in count])
        told.append(np.bincount(idx, weights=each).astype(np.uint64))
        told.append(np.bincount(idx[held], weights=each[held], minlength=len(known)).astype(np.uint64))
    # One more row for the owner's distinct words; the start alone is none.
    n_known = int(((told[0] > 0) & (known & np.uint64(1) == 0)).sum())
    yield pa.RecordBatch.from_arrays([t["owner"].combine_chunks().cast(pa.int32())[:1], pa.array([-1], pa.int64()), pa.array([str(n_known).encode()], pa.binary())], names=["owner", "chunk", "counts"])
    cut = np.r_[0, np.cumsum(size)]
    # Small numbers: their empty planes vanish in the codec.
    out = [K.planes(np.concatenate([x[idx[a:z]] for x in (told if o else told[::2])])) for o, a, z in zip(odd, cut[:-1], cut[1:])]
    yield pa.RecordBatch.from_arrays([t["owner"].combine_chunks().cast(pa.int32()), t["chunk"].combine_chunks().cast(pa.int64()), pa.array(out, pa.binary())], names=["owner", "chunk", "counts"])


def _told(left: pa.Table, right: pa.Table, shift: np.uint64):
    """Counts of a chunk's words and bigrams (as such, and as contexts; for an odd chunk each
    followed by that in held-out documents), and the places of each word, its context and bigram."""
    right = right.sort_by("owner")
    n_counts = 4 if left["chunk"][0].as_py() % 2 else 2
    got = np.concatenate([K.unplanes(x, np.uint64).reshape(n_counts, -1) for x in right["counts"].to_pylist()] or [np.zeros((n_counts, 0), np.uint64)], axis=1)
    uni, i, c, bi, j, n = _keys(left["sizes"][0].as_py(), left["vocab"][0].as_py(), left["at"][0].as_py())
    order, _ = _by_owner(uni, bi, shift)
    if len(i) and got.shape[1] != len(order):
        raise ValueError("an answer is missing")
    by = np.zeros((n_counts, len(order)))
    by[:, order[: got.shape[1]]] = got
    return by[:, : len(uni)], by[:, len(uni) :], i, c, j, n


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.frexp(context)[1]).astype(np.int64)


def weights(cells: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (bucket, [bigram, word, uniform]) by EM. ``cells``: rows
    of bucket, p2, p1, p0 and how many held-out words they stand for."""
    lam = np.full((BUCKETS, 3), 1 / 3)
    lam[0] = (0.0, 0.5, 0.5)
    if not len(cells):
        return lam
    k, p, n = cells[:, 0].astype(int), cells[:, 1:4], cells[:, 4]
    for _ in range(rounds):
        part = lam[k] * p
        part *= (n / part.sum(1))[:, None]
        new = np.stack([np.bincount(k, weights=part[:, j], minlength=BUCKETS) for j in range(3)], 1)
        total = new.sum(1, keepdims=True)
        lam = np.where(total > 0, new / np.maximum(total, 1e-300), lam)
    return lam


def _fit(n_left: int, uniform: float):
    """The weights of one bucket, from its cells."""

    def fit(t: pa.Table) -> pa.Table:
        n, bucket = t["n"].to_numpy().astype(float), t["bucket"].to_numpy()
        context, word, two = (t[c].to_numpy() / n for c in ("context", "word", "two"))
        p2 = np.divide(two, context, out=np.zeros(len(n)), where=context > 0)
        lam = weights(np.stack([bucket.astype(float), np.minimum(p2, 1), word / n_left, np.full(len(n), uniform), n], 1))[bucket[0]]
        return pa.table([pa.array(x) for x in (bucket[:1], lam[:1], lam[1:2], lam[2:])], names=["bucket", "two", "word", "uniform"])

    return fit


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``log_prob`` (mean
    natural logarithm of a word's probability) and ``perplexity``.

    P(w | v) = a_b c(v w) / c(v) + b_b c(w) / n + c_b / (distinct words + 1): maximum-likelihood
    estimates of the corpus (each document starts with a start symbol),
    mixed with weights that depend on the bucket b of the context's count
    c(v), its power of two. The weights are learned by expectation-maximisation on the
    held-out tenth of documents (by a hash of their words), whose own counts (and words in n) are
    deleted from the estimates meanwhile; the scores then use all counts.
    No document, word or n-gram is left out. For the weights alone, held-out words whose three counts
    are alike are one cell: exactly for counts below 16, in steps of 1/8 doubling, averaged, beyond. So
    a bucket has a bounded number of cells at any size of the corpus; each is fitted by a task of its own, and the driver
    gets three numbers a bucket. A bucket without held-out words keeps equal weights.

    A null or wordless text has 0 words and null scores. Null ids and repeated
    rows give a row each; an empty table gives an empty one; other columns are
    ignored. Counts are asked for by chunk and told by hash ranges, so memory
    is bounded by ``OWNED`` keys and a chunk's words, however large the corpus.
    """
    tok = K.stash_tokens(docs, id_col, text_col, "lm-tokens", held_out)
    total = (tok.agg(F.sum(F.octet_length("at"))).first()[0] or 0) // 4
    own = 1 << max(2, int(total // OWNED).bit_length())
    shift = np.uint64(64 - (own.bit_length() - 1))
    asked = tok.select("chunk", "sizes", "vocab", "at").mapInArrow(_ask(own, shift), "owner int, chunk long, keys binary, counts binary")
    told = stash(K.to_owners(asked, own).mapInArrow(_answer, "owner int, chunk long, counts binary"), "lm-counts")
    both = lambda where: tok.filter(where).groupBy("chunk").cogroup(told.filter(where).groupBy("chunk"))

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _CELLS.empty_table()
        u, b, i, c, j, _ = _told(left, right, shift)
        context = u[2][c] - u[3][c]
        word, two = u[0][i] - u[1][i], b[0][j] - b[1][j]
        # Words of the same three counts are one cell; logarithmic steps of 1/8 beyond small counts.
        step = lambda x: np.where(x < 16, x, np.round(8 * np.log2(np.maximum(x, 1))) + 1000).astype(np.int64)
        key = ((bucket(context) << 11 | step(context)) << 11 | step(word)) << 11 | step(two)
        key, inv, n = np.unique(key, return_inverse=True, return_counts=True)
        total = [np.bincount(inv, weights=x, minlength=len(n)) for x in (context, word, two)]
        del u, b, i, c, j, inv, context, word, two
        K.trim()
        return pa.table([pa.array(key), *map(pa.array, total), pa.array(n.astype(np.int64))], schema=_CELLS)

    # Held-out documents only: their chunks are the odd ones.
    cells = both("chunk >= 0 AND chunk % 2 = 1").applyInArrow(gather, "cell long, context double, word double, two double, n long")
    cells = cells.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("context", "word", "two", "n"))).withColumn("bucket", F.shiftrightunsigned("cell", 33).cast("int"))
    n_words = max(int(total), 1)
    n_held = (tok.filter("chunk % 2 = 1").agg(F.sum(F.octet_length("at"))).first()[0] or 0) // 4
    uniform = 1.0 / (1 + (told.filter("chunk < 0").agg(F.sum(F.expr("cast(decode(counts, 'utf-8') as bigint)"))).first()[0] or 0))
    lam = weights(np.zeros((0, 5)))
    fitted = cells.groupBy("bucket").applyInArrow(_fit(max(n_words - n_held, 1), uniform), "bucket int, two double, word double, uniform double")
    for k, *mixed in fitted.collect():
        lam[k] = mixed

    id_type = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(id_type)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        u, b, i, c, j, sizes = _told(left, right, shift)
        row = np.repeat(np.arange(len(sizes)), sizes)
        context = u[len(u) // 2][c]
        k = bucket(context)
        p = lam[k, 0] * b[0][j] / np.maximum(context, 1) + lam[k, 1] * u[0][i] / n_words + lam[k, 2] * uniform
        del u, b, i, c, j, k, context
        K.trim()
        mean = np.bincount(row, weights=np.log(p), minlength=len(sizes)) / np.maximum(sizes, 1)
        none = sizes == 0
        ids = left["ids"].combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        return pa.table([ids.flatten().cast(arrow_id), pa.array(sizes.astype(np.int64)), pa.array(mean, mask=none), pa.array(np.exp(-mean), mask=none)], names=["doc_id", "n_words", "log_prob", "perplexity"])

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_words", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("perplexity", T.DoubleType())])
    return both("chunk >= 0").applyInArrow(score, schema)


_CELLS = pa.schema([("cell", pa.int64()), *((c, pa.float64()) for c in ("context", "word", "two")), ("n", pa.int64())])
