"""Benchmark decontamination by latent semantic retrieval."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factline.llm import tokens as K
from factline.llm.common import fresh, pieces, scratch, small, stash
from factline.ship import ship

SEED = 53
#: Dimensions of the latent space, and words of a passage that it is fitted on.
RANK, PASSAGE = 128, 64
#: Least cosine of a window and an item for the exact checks to be made.
COSINE = 0.35
#: Least share of an item's words, of its answer's and of its rarer words that
#: must follow in order in a window; from SURE on, the answer doesn't matter.
LCS, ANSWER, RARE, SURE = 0.6, 0.6, 0.5, 0.85
#: A word of more than this share of documents has no weight. The corpus counts
#: as PRIOR documents more, so that a few documents don't make every word common.
COMMON, PRIOR = 0.05, 1000
#: Items with less than this share of weighted words, or of the usual weight a word,
#: are weak: the cosine can miss them, so they are searched for by their words. Of
#: items with so few weighted words, shorter ones than SHORT must be there to SURE.
WEAK, SHORT = 0.25, 16
#: Shorter items, of whose words any text has a few in order, must be there word for word.
LEAST_WORDS = 5
#: Rows that one sum adds up at a time.
PIECE = 64
#: Bytes of items that are searched for in one go; more take several.
ITEM_BYTES = 8 << 20


@dataclass
class Items:
    """Benchmark items as places in the sorted vocabulary."""

    ids: list
    vocab: np.ndarray
    words: list[np.ndarray]
    answers: list[np.ndarray]
    #: Items of fewer than LEAST_WORDS words, and these.
    short: list[tuple[object, np.ndarray]]


def answer_of(text: str) -> str:
    """The last sentence, or of a single one, or where it has fewer than three
    words, the last quarter of the text, three words at least."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+", text.strip()) if p]
    if len(parts) > 1 and len(parts[-1].split()) >= 3:
        return parts[-1]
    w = text.split()
    return " ".join(w[-max(3, len(w) // 4) :])


def items_of(rows: list) -> Items:
    texts = [r[1] or "" for r in rows]
    h, row = K.words(pa.array(texts, pa.string()))
    ah, arow = K.words(pa.array([answer_of(t) for t in texts], pa.string()))
    vocab = np.unique(h)
    cut = lambda x, at: np.split(np.searchsorted(vocab, x), np.searchsorted(at, np.arange(1, len(rows))))
    each = list(zip(cut(h, row), cut(ah, arow))) if rows else []
    keep = [k for k, (w, _) in enumerate(each) if len(w) >= LEAST_WORDS]
    short = [(rows[k][0], w) for k, (w, _) in enumerate(each) if 0 < len(w) < LEAST_WORDS]
    return Items([rows[k][0] for k in keep], vocab, [each[k][0] for k in keep], [each[k][1] for k in keep], short)


def known_words(docs: DataFrame, vocab: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Chunks of documents reduced to the words that some item has, and their
    places: all that matching and retrieval look at."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), *(T.StructField(c, T.BinaryType()) for c in ("sizes", "gaps", "at"))])

    def cut(batches):
        # A table of 2^20 slots answers most words without a search.
        slot = np.zeros(1 << 20, bool)
        slot[(vocab >> np.uint64(44)).astype(np.int64)] = True
        for t in K.chunks(batches, "text"):
            h, row = K.words(t["text"].combine_chunks())
            first = np.searchsorted(row, np.arange(t.num_rows))
            maybe = np.flatnonzero(slot[(h >> np.uint64(44)).astype(np.int64)])
            at = np.searchsorted(vocab, h[maybe])
            hit = vocab[np.minimum(at, len(vocab) - 1)] == h[maybe] if len(vocab) else np.zeros(0, bool)
            maybe, at = maybe[hit], at[hit]
            doc = row[maybe]
            pos = maybe - first[doc]
            gap = np.diff(pos, prepend=0)
            new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, int)
            gap[new] = pos[new]
            ids = t["id"].combine_chunks()
            ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
            blobs = (K.planes(np.bincount(doc, minlength=t.num_rows).astype(np.int32)), K.planes(gap.astype(np.uint32)), K.planes(at.astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x], pa.binary()) for x in blobs)], names=["ids", "sizes", "gaps", "at"])
            del t, h, row, maybe, at, hit, doc, pos, gap, ids, blobs
            K.trim()

    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return stash(picked.mapInArrow(cut, schema), "known-words")


def _opened(sizes: bytes, gaps: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Document, place in it and vocabulary number of each known word."""
    n = K.unplanes(sizes, np.int32)
    doc = np.repeat(np.arange(len(n)), n)
    run = np.cumsum(K.unplanes(gaps, np.uint32).astype(np.int64))
    begin = np.cumsum(n) - n
    has = n > 0
    before = np.zeros(len(n), np.int64)
    before[has] = run[begin[has]] - K.unplanes(gaps, np.uint32)[begin[has]]
    return doc, run - before[doc], K.unplanes(at, np.uint32).astype(np.int64), len(n)


def _each(batches):
    for b in batches:
        for k in range(b.num_rows):
            yield b["ids"][k], *_opened(b["sizes"][k].as_py(), b["gaps"][k].as_py(), b["at"][k].as_py())


def document_counts(known: DataFrame, n_vocab: int) -> tuple[np.ndarray, np.ndarray, int]:
    """In how many documents each word is, its squared frequency over passages, and how many documents there are."""

    def count(batches):
        df, energy, n = np.zeros(n_vocab, np.int64), np.zeros(n_vocab, np.int64), 0
        for _, doc, pos, at, docs in _each(batches):
            n += docs
            each = np.sort(doc * n_vocab + at)
            df += np.bincount(each[np.flatnonzero(np.diff(each, prepend=-1))] % n_vocab, minlength=n_vocab)
            _, cell, tf = _passages(doc, pos, at, n_vocab)
            energy += np.bincount(cell, weights=tf * tf, minlength=n_vocab).astype(np.int64)
            del doc, pos, at, each, cell, tf
            K.trim()
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int32()), pa.array([n, *df[used].tolist()], pa.int64()), pa.array([0, *energy[used].tolist()], pa.int64())], names=["word", "df", "energy"])

    rows = known.mapInArrow(count, "word int, df long, energy long").groupBy("word").agg(F.sum("df").alias("df"), F.sum("energy").alias("energy")).collect()
    df, energy, n = np.zeros(n_vocab), np.zeros(n_vocab), 0
    for w, x, e in rows:
        if w < 0:
            n = x
        else:
            df[w], energy[w] = x, e
    return df, energy, n


def _passages(doc: np.ndarray, pos: np.ndarray, at: np.ndarray, n_vocab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage number, word and frequency of each filled cell of a chunk's passage by word matrix."""
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z
    part = pos // PASSAGE
    new = np.r_[True, (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])]
    key, tf = np.unique((np.cumsum(new) - 1) * n_vocab + at, return_counts=True)
    return key // n_vocab, key % n_vocab, tf


def sums(value: np.ndarray, rows: np.ndarray, head: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """The sums of ``value[rows]``, each row ``times`` its number, from every head up to the next: a step
    adds one row to all sums that have as many, several times faster than ``reduceat``; long ones go in pieces."""
    size = np.diff(np.r_[head, len(rows)])
    if len(head) and size.max() > PIECE:
        n = -(-size // PIECE)
        first = np.cumsum(n) - n
        begin = np.repeat(head, n) + PIECE * (np.arange(int(n.sum())) - np.repeat(first, n))
        return sums(sums(value, rows, begin, times), np.arange(len(begin)), first)
    order = np.argsort(-size, kind="stable")
    begin, size = head[order], size[order]
    out = np.zeros((len(head), value.shape[1]), value.dtype)
    for k in range(int(size[0]) if len(size) else 0):
        live = begin[: np.searchsorted(-size, -k)] + k
        x = value[rows[live]]
        if times is not None:
            x *= times[live, None]
        out[: len(live)] += x
    back = np.empty_like(out)
    back[order] = out
    return back


def gram_times(known: DataFrame, weight: np.ndarray, q: np.ndarray, items: list[np.ndarray]) -> np.ndarray:
    """A'A q, where A holds the weighted passages of all documents and the items:
    each partition adds up its own; blocks of words are then added up, first over groups of
    partitions, as many as a group has members, so that no task reads from all."""
    n_vocab, rank, block = len(weight), q.shape[1], 512
    groups = math.ceil(known.rdd.getNumPartitions() ** 0.5)
    wq = (weight[:, None] * q).astype(np.float32)

    def product(seg, word, tf):
        if not len(seg):
            return np.zeros((n_vocab, rank), np.float32)
        head = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        tf = tf.astype(np.float32)
        aq = sums(wq, word, head, tf)
        mine = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(seg)]))
        order = np.argsort(word, kind="stable")
        w = word[order]
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        out = np.zeros((n_vocab, rank), np.float32)
        out[w[first]] = sums(aq, mine[order], first, tf[order]) * weight[w[first], None].astype(np.float32)
        return out

    def multiply(batches):
        total, group = np.zeros((n_vocab, rank), np.float64), TaskContext.get().partitionId() % groups
        for _, doc, pos, at, _ in _each(batches):
            on = weight[at] > 0
            total += product(*_passages(doc[on], pos[on], at[on], n_vocab))
            del doc, pos, at, on
            K.trim()
        for k in range(0, n_vocab, block):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([group], pa.int32()), pa.array([total[k : k + block].tobytes()], pa.binary())], names=["block", "group", "part"])
        del total
        K.trim()

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros_like(np.frombuffer(t["part"][0].as_py(), np.float64))
        for x in t["part"]:
            total += np.frombuffer(x.as_py(), np.float64)
        K.trim()
        return pa.table([t["block"][:1].cast(pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "group", "part"])

    schema = "block int, group int, part binary"
    parts = known.select("ids", "sizes", "gaps", "at").mapInArrow(multiply, schema)
    rows = parts.groupBy("block", "group").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema).select("block", "part").collect()
    doc = np.repeat(np.arange(len(items)), [len(w) for w in items])
    y = product(*_passages(doc, np.zeros(len(doc), np.int64), np.concatenate(items) if items else np.zeros(0, np.int64), n_vocab)).astype(np.float64)
    for b, part in rows:
        x = np.frombuffer(part, np.float64).reshape(-1, rank)
        y[b : b + len(x)] += x
    return y


def randomised_svd(known: DataFrame, weight: np.ndarray, items: list[np.ndarray], rank: int = RANK, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors and values of the passage matrix: a
    random start, one power iteration, and a Rayleigh-Ritz step."""
    rank = min(rank, len(weight))
    start = np.random.default_rng(seed).standard_normal((len(weight), rank))
    q, _ = np.linalg.qr(gram_times(known, weight, start, items))
    small = q.T @ gram_times(known, weight, q, items)
    value, turn = np.linalg.eigh((small + small.T) / 2)
    return q @ turn[:, ::-1], np.sqrt(np.maximum(value[::-1], 0))


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each element of a."""
    place: dict[int, int] = {}
    for k, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if m := place.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def verdict(item: np.ndarray, answer: np.ndarray, rare: np.ndarray, seen: np.ndarray) -> tuple[float, float] | None:
    """Shares of an item's and its answer's words that ``seen`` has in order, if
    they make a leak: ``LCS`` of the item, ``RARE`` of its words that have weight, and ``ANSWER`` of the
    answer (or ``SURE`` of the item)."""
    s = seen.tolist()
    share = lcs(item.tolist(), s) / len(item)
    if share < LCS:
        return None
    own = item[rare[item]]
    if len(own) and lcs(own.tolist(), seen[rare[seen]].tolist()) < RARE * len(own):
        return None
    told = lcs(answer.tolist(), s) / len(answer) if len(answer) else share
    return (share, told) if told >= ANSWER or share >= SURE else None


def classes(items: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Items by the least power of two (8 at least) that holds their words."""
    size = np.array([max(8, 1 << int(len(w) - 1).bit_length()) for w in items])
    return {int(c): np.flatnonzero(size == c) for c in np.unique(size)}


def weak_items(items: Items, weight: np.ndarray, df: np.ndarray) -> dict[int, tuple[np.ndarray, bool]]:
    """Items that the cosine can't be relied on for: their rarer words, and if
    they are common. Weighted words are the rarer ones; a common item, of too few of
    these, has the rarer half of its own words besides."""
    told = np.array([(weight[w] > 0).mean() for w in items.words])
    mass = np.array([(weight[w] ** 2).mean() for w in items.words])
    out = {}
    if not items.words:
        return out
    for i in np.flatnonzero((told < WEAK) | (mass < WEAK * np.median(mass))).tolist():
        w, common = items.words[i], bool(told[i] < WEAK)
        out[i] = np.unique(w[(weight[w] > 0) | (common & (df[w] <= np.median(df[w])))]), common
    return out


def _run_key(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of word numbers."""
    key = np.zeros(len(words), np.uint64)
    for w in words.T:
        key = K.mix(key + w.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return key


def _least_mass(words: np.ndarray, mass: np.ndarray) -> float:
    """The least weight that words can have in all which pass :func:`verdict` for an
    item: that of the lightest ``RARE`` of its words with weight."""
    own = np.sort(mass[words[mass[words] > 0]])
    return float(own[: math.ceil(RARE * len(own) - 1e-9)].sum())


def _search(items: Items, weight: np.ndarray, space: np.ndarray, df: np.ndarray):
    rare = weight > 0
    word_vec = (weight[:, None] * space).astype(np.float32)
    mass_of = weight**2
    by, weak = {}, weak_items(items, weight, df)
    for size, own in classes(items.words).items():
        own = own[[int(i) not in weak for i in own]]
        if not len(own):
            continue
        vec = np.stack([word_vec[items.words[i]].sum(0) for i in own])
        norm = np.linalg.norm(vec, axis=1, keepdims=True)
        mass = min(_least_mass(items.words[i], mass_of) for i in own)
        by[size] = own, (vec / np.maximum(norm, 1e-30)).T.astype(np.float32), mass

    def candidates(doc, pos, at):
        """Documents, first words, items and cosines of windows three half-lengths
        wide, one beginning every half-length, and how many words that is."""
        on = rare[at]
        d, p, a = doc[on], pos[on], at[on]
        if not len(a):
            return
        for size, (own, unit, mass) in by.items():
            half = size // 2
            cell = p // half
            head = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (cell[1:] != cell[:-1])])
            # Two empty cells before each document and two behind it; only filled cells are kept.
            last = np.zeros(int(d[-1]) + 1, np.int64)
            np.maximum.at(last, d, cell)
            base = np.r_[0, np.cumsum(last + 5)][:-1]
            where = base[d[head]] + cell[head] + 2
            n = int(where[-1]) + 4
            slot = np.full(n + 2, len(head))
            slot[where] = np.arange(len(head))
            m = np.r_[np.add.reduceat(mass_of[a], head), 0.0]
            # Windows begin up to two cells before a document too, so that each cell is in three of them.
            begins = np.zeros(n, bool)
            for k in range(3):
                begins[where - k] = True
            starts = np.flatnonzero(begins)
            # What the exact checks look at: the window and a margin, which is less than a cell, on either side.
            total = sum(m[slot[starts + k]] for k in range(-1, 4))
            starts = starts[total >= mass * (1 - 1e-9)]
            for lo in range(0, len(starts), 20_000):
                s = starts[lo : lo + 20_000]
                used = np.zeros(len(head) + 1, bool)
                for k in range(3):
                    used[slot[s + k]] = True
                cells = np.flatnonzero(used[:-1])
                if not len(cells):
                    continue
                end = np.r_[head, len(a)]
                size_of = end[cells + 1] - end[cells]
                tok = np.repeat(end[cells] - np.r_[0, np.cumsum(size_of)[:-1]], size_of) + np.arange(int(size_of.sum()))
                vec = np.zeros((len(cells) + 1, word_vec.shape[1]), np.float32)
                vec[:-1] = sums(word_vec, a[tok], np.r_[0, np.cumsum(size_of)[:-1]])
                local = np.full(len(head) + 1, len(cells))
                local[cells] = np.arange(len(cells))
                v = vec[local[slot[s]]] + vec[local[slot[s + 1]]] + vec[local[slot[s + 2]]]
                cos = (v @ unit) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
                x, y = np.nonzero(cos >= COSINE)
                owner = np.searchsorted(base, s[x], "right") - 1
                yield owner, (s[x] - base[owner] - 2) * half, own[y], cos[x, y], 3 * half

    number = np.full(len(weight), -1)

    def likely(item, lo, hi, at):
        """Which of the places ``lo`` to ``hi`` hold as many of an item's words, in any
        order, as a leak must hold in its own: a bound on :func:`lcs`."""
        w, times = np.unique(items.words[item], return_counts=True)
        number[w] = np.arange(len(w))
        size = hi - lo
        tok = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        of = number[at[tok]]
        on = of >= 0
        n = np.bincount((np.repeat(np.arange(len(lo)), size) * len(w) + of)[on], minlength=len(lo) * len(w))
        number[w] = -1
        return np.minimum(n.reshape(len(lo), len(w)), times).sum(1) / len(items.words[item]) >= LCS

    def checked(doc, pos, at):
        """(document, item, cosine, first and last place) of the candidates that may pass :func:`verdict`."""
        stride = int(pos.max()) + 1 if len(pos) else 1
        key = doc * stride + pos
        for d, first, item, cos, width in candidates(doc, pos, at):
            # A quarter more on either side: an item may lie across the edge.
            lo = np.searchsorted(key, d * stride + np.maximum(first - width // 4, 0))
            hi = np.searchsorted(key, d * stride + np.minimum(first + width + width // 4, stride))
            order = np.argsort(item, kind="stable")
            cut = np.flatnonzero(np.diff(item[order], prepend=-1, append=-1))
            block = max(1, (1 << 20) // (2 * width))
            for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
                for k in range(a, z, block):
                    x = order[k : min(k + block, z)]
                    i = int(item[x[0]])
                    x = x[likely(i, lo[x], hi[x], at)]
                    yield from zip(d[x].tolist(), [i] * len(x), cos[x].tolist(), lo[x].tolist(), hi[x].tolist())

    size_of_item = {int(i): size for size, own in classes(items.words).items() for i in own}

    def by_words(doc, pos, at):
        """(document, first word, words, weak item, its rarer words as a mask) of all
        windows, of the same places, that hold as many of these words as a leak must."""
        mark = np.zeros(len(weight), bool)
        for i, (own, _) in weak.items():
            half = size_of_item[i] // 2
            need = RARE * int(np.isin(items.words[i], own).sum())
            mark[:] = False
            mark[own] = True
            t = np.flatnonzero(mark[at])
            if not len(t):
                continue
            cell = pos[t] // half
            # A window's margins lie in the cells before and behind it.
            stride = int(cell.max()) + 8
            cells, n = np.unique(doc[t] * stride + cell + 2, return_counts=True)
            starts = np.unique(np.concatenate([cells - k for k in range(3)]))
            starts = starts[starts % stride >= 2]
            total = np.zeros(len(starts), np.int64)
            for k in range(-1, 4):
                where = np.minimum(np.searchsorted(cells, starts + k), len(cells) - 1)
                total += np.where(cells[where] == starts + k, n[where], 0)
            for x in starts[total >= need].tolist():
                yield x // stride, (x % stride - 2) * half, 3 * half, i, mark

    runs: dict[int, dict[int, list[int]]] = {}
    for k, (_, w) in enumerate(items.short):
        runs.setdefault(len(w), {}).setdefault(_run_key(w[None, :])[0], []).append(k)
    wanted = {n: np.array(sorted(x), np.uint64) for n, x in runs.items()}

    def word_for_word(doc, pos, at):
        """(document, short item) where its words stand one after the other."""
        for n, keys in wanted.items():
            if len(at) < n:
                continue
            here = np.flatnonzero((doc[n - 1 :] == doc[: len(doc) - n + 1]) & (pos[n - 1 :] - pos[: len(pos) - n + 1] == n - 1))
            key = _run_key(at[here[:, None] + np.arange(n)])
            hit = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key)
            for x, k in zip(doc[here[hit]].tolist(), key[hit].tolist()):
                yield from ((x, i) for i in runs[n][k])

    def cosine(words, seen):
        a, b = word_vec[words].sum(0), word_vec[seen].sum(0)
        return float(a @ b / max(float(np.linalg.norm(a) * np.linalg.norm(b)), 1e-30))

    def search(batches):
        for ids, doc, pos, at, _ in _each(batches):
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            begin = np.searchsorted(doc, np.arange(int(doc[-1]) + 2)) if len(doc) else []
            for d, item, cos, lo, hi in checked(doc, pos, at):
                got = verdict(items.words[item], items.answers[item], rare, at[lo:hi])
                if got and (got[0], cos) > best.get((d, item), (0, 0, 0))[::2]:
                    best[d, item] = (got[0], got[1], cos)
            for d, first, width, item, mark in by_words(doc, pos, at):
                a, z = begin[d], begin[d + 1]
                lo, hi = np.searchsorted(pos[a:z], (first - width // 4, first + width + width // 4))
                seen = at[a + lo : a + hi]
                got = verdict(items.words[item], items.answers[item], mark, seen)
                if not got or got[0] < SURE and weak[item][1] and len(items.words[item]) < SHORT:
                    continue
                cos = cosine(items.words[item], seen)
                if (d, item) not in best or (got[0], cos) > best[d, item][::2]:
                    best[d, item] = (got[0], got[1], cos)
            rows = [(ids[d].as_py(), items.ids[i], c, s, t) for (d, i), (s, t, c) in sorted(best.items())]
            rows += [(ids[d].as_py(), items.short[i][0], cosine(w := items.short[i][1], w), 1.0, 1.0) for d, i in sorted(set(word_for_word(doc, pos, at)))]
            if rows:
                yield rows
            del doc, pos, at, begin
            K.trim()

    return search


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row and benchmark item that leaked into it:
    ``doc_id``, ``item_id``, ``cosine`` of the window and the item in the latent
    space, ``lcs`` and ``answer``, the shares of the item's and its answer's
    words that the window has in the item's order.

    Passages (64 words) of all documents, and the items, make a TF-IDF matrix
    over the items' words, a word's idf being divided by its column's norm so
    that frequent words don't take up all dimensions. Its leading singular vectors
    (:func:`randomised_svd`) make the latent space. Every document is then cut into
    overlapping windows for every size of item, and each window whose cosine to
    an item is ``COSINE`` or more goes through the exact checks of :func:`verdict`.
    Items that leaked so widely, or are so plain, that their words have little or no
    weight (:func:`weak_items`) have no useful cosine: every window that holds enough of their rarer words
    goes through these checks.

    Before the cosine, windows go that can't hold enough of any item's weight to pass these checks.
    Items of fewer than ``LEAST_WORDS`` words are found where they stand word for word.

    Null and empty texts hold no leak; items without a word are not searched for. Null ids and repeated rows give rows of their
    own, and so do items that share an id; other columns are ignored; an empty table on either side gives an empty one.
    Only items are held in memory (``ITEM_BYTES`` at a time); documents are read once,
    and kept as the places of words that some item has.
    """
    types = (docs.schema[id_col].dataType, bench.schema[item_col].dataType)
    schema = T.StructType([T.StructField("doc_id", types[0]), T.StructField("item_id", types[1]), *(T.StructField(c, T.DoubleType()) for c in ("cosine", "lcs", "answer"))])
    b = bench.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{item_text_col}`").cast("string").alias("t"))
    parts = pieces(b, "t", ITEM_BYTES)
    out = None
    for k in range(parts):
        part = _part(docs, b.filter(F.pmod(F.xxhash64("t"), F.lit(parts)) == k), id_col, text_col, schema)
        out = part if out is None else out.unionByName(part)
    return out


def _part(docs: DataFrame, b: DataFrame, id_col: str, text_col: str, schema: T.StructType) -> DataFrame:
    items = items_of(sorted(map(tuple, b.collect()), key=repr))
    if not items.words and not items.short:
        return docs.sparkSession.createDataFrame([], schema)
    known = known_words(docs, items.vocab, id_col, text_col)
    df, energy, n = document_counts(known, len(items.vocab))
    weight = np.where(df <= COMMON * (n + PRIOR), np.log((n + PRIOR) / (df + 1)), 0.0)
    own = np.bincount(np.concatenate([*items.words, np.zeros(0, np.int64)]), minlength=len(weight))
    weight = weight / np.sqrt(np.maximum(energy + own, 1)) ** 0.5
    space = randomised_svd(known, weight, items.words)[0] if items.words else np.ones((len(weight), 1))
    search = _search(items, weight, space, df)
    names = schema.names
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in schema]

    def found(batches):
        for rows in search(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), arrow)], names=names)

    return known.mapInArrow(found, schema)


def remove_leaks(docs: DataFrame, bench: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's rows without those whose text holds a benchmark item, as
    :func:`decontaminate` finds it. It goes by text, so null and repeated ids don't matter."""
    key, leak = F.md5(F.col(f"`{text_col}`").cast("string")), fresh(docs, "__leak")
    with scratch(docs.sparkSession):
        found = decontaminate(docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("text")), bench, "key", "text")
        leaks = stash(found.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias(leak)).distinct(), "leaks", keep=True)
    return docs.join(small(leaks), key == F.col(leak), "left_anti")
