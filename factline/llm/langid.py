"""Language ID: multilingual mixtures by expectation-maximisation."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factline.llm import tokens as K
from factline.llm.common import plainly
from factline.ship import ship

#: The classifier is fitted on so many labelled documents a language at most,
#: those of the least hashes, and the label of a language needs LEAST of them.
SAMPLE, LEAST = 400, 3
SEED = 31
#: Byte trigrams are hashed into so many bits; every slot starts at ALPHA.
BITS, ALPHA = 16, 0.5
#: A document's proportions are done once none moves by CLOSE in a round of
#: expectation-maximisation, or after ROUNDS; languages of less than LEAST_SHARE of its words aren't listed.
ROUNDS, CLOSE, LEAST_SHARE = 100, 1e-3, 0.005
#: Each further language of a set costs so many times ln(words + 1).
COST = 3.0
#: The component of words that no language explains: every trigram alike.
NONE = "zxx"
#: A document is rejected if its languages explain less than this share of its words.
ACCEPT = 0.5

_LETTER = K.IS_WORD.copy()
_LETTER[48:58] = False


def grams(raw: np.ndarray) -> np.ndarray:
    """The slot of the trigram around each byte; what isn't a letter is a space."""
    b = np.where(_LETTER[raw], raw, np.uint8(32)).astype(np.uint32)
    p = np.r_[np.uint32(32), b, np.uint32(32)]
    code = (p[:-2] << np.uint32(16)) | (p[1:-1] << np.uint32(8)) | p[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.uint16)


def cut(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all bytes, where each word begins and ends, and its row."""
    raw, at = K.utf8(pc.utf8_lower(text.cast(pa.large_string())))
    if not len(raw):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint16), z, z, z
    inside = _LETTER[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads, tails = at[:-1][at[:-1] < len(raw)], at[1:][at[1:] > 0] - 1
    first[heads], last[tails] = inside[heads], inside[tails]
    begin = np.flatnonzero(first)
    return grams(raw), begin, np.flatnonzero(last) + 1, np.searchsorted(at, begin, "right") - 1


def fit(texts: list[str], labels: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages, in order, and the log-probability of each slot in each."""
    langs = sorted({x for x in labels if x is not None and labels.count(x) >= LEAST and x != NONE})
    table = np.zeros((len(langs), 1 << BITS), np.float32)
    for k, lang in enumerate(langs):
        g, begin, end, _ = cut(pa.array([t for t, x in zip(texts, labels) if x == lang], pa.large_string()))
        inside = np.zeros(len(g) + 1, np.int64)
        np.add.at(inside, begin, 1)
        np.add.at(inside, end, -1)
        n = np.bincount(g[np.cumsum(inside[:-1]) > 0], minlength=1 << BITS) + ALPHA
        table[k] = np.log(n / n.sum())
    return langs, table


def likelihoods(text: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's log-likelihood in every language and, last, in none; its row."""
    g, begin, end, row = cut(text)
    out = np.empty((len(table) + 1, len(begin)), np.float32)
    for k, logs in enumerate(table):
        run = np.r_[0.0, np.cumsum(logs[g], dtype=np.float64)]
        out[k] = run[end] - run[begin]
    out[-1] = (end - begin) * -(BITS * math.log(2))
    return out, row


def mixture(like: np.ndarray, row: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's proportions and log-likelihood: EM from equal shares of the components
    ``allowed`` (component by document) until it converges, for each document by itself. ``like`` is relative to
    each word's best component; documents' words are contiguous, each has one at least."""
    head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[head, len(row)])
    share = (allowed / allowed.sum(0)).astype(np.float32)
    left, words, begin, n = np.arange(len(size)), like, head, size
    for _ in range(ROUNDS):
        part = np.repeat(share[:, left], n, axis=1)
        part *= words
        total = part.sum(0)
        np.maximum(total, 1e-30, out=total)
        part /= total
        new = (np.add.reduceat(part, begin, axis=1) / n).astype(np.float32)
        moved = np.abs(new - share[:, left]).max(0) >= CLOSE
        share[:, left] = new
        if not moved.any():
            break
        if not moved.all():
            words, left, n = words[:, np.repeat(moved, n)], left[moved], n[moved]
            begin = np.cumsum(n) - n
    part = np.repeat(share, size, axis=1)
    part *= like
    return share, np.add.reduceat(np.log(np.maximum(part.sum(0), 1e-30)), head)


def infer(text: pa.Array, langs: list[str], table: np.ndarray):
    """Per row of ``text``: number of words, and the chosen languages with their
    proportions, largest first (ties by code)."""
    n = len(text)
    logs, row = likelihoods(text, table)
    words = np.bincount(row, minlength=n)
    chosen: list[list[tuple[str, float]]] = [[] for _ in range(n)]
    docs = np.flatnonzero(words)
    if not len(docs) or not langs:
        return words, chosen
    like = np.exp(logs - logs.max(0))
    few = len(langs)
    share, _ = mixture(like, row, np.ones((few + 1, len(docs)), np.float32))
    order = np.argsort(-np.round(share[:few], 6), axis=0, kind="stable")
    best, final = np.full(len(docs), -np.inf), np.zeros_like(share)
    size, cost = words[docs], COST * np.log(words[docs] + 1)
    for m in range(1, few + 1):
        # Words are relative to their best component, so no set's likelihood is
        # above 0: documents that are better already than the cost alone are done.
        left = np.flatnonzero(best < 1e-3 * size - cost * (m - 1))
        if not len(left):
            break
        allowed = np.zeros((few + 1, len(left)), np.float32)
        allowed[order[:m, left], np.arange(len(left))] = 1
        allowed[few] = 1
        on = np.zeros(len(docs), bool)
        on[left] = True
        on = np.repeat(on, size)
        got, fits = mixture(like[:, on], row[on], allowed)
        fits = fits - cost[left] * (m - 1)
        better = fits > best[left]
        now = left[better]
        best[now], final[:, now] = fits[better], np.where(allowed > 0, got, 0)[:, better]
    for k, d in enumerate(docs.tolist()):
        got = [(langs[x], float(final[x, k])) for x in np.argsort(-final[:few, k], kind="stable") if final[x, k] > LEAST_SHARE]
        chosen[d] = got
    return words, chosen


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int = SAMPLE) -> tuple[list[str], list[str]]:
    """Up to ``most`` labelled texts of each language, by the hash of their ids."""
    d = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"), F.xxhash64(F.lit(SEED), F.col(f"`{id_col}`")).alias("h")).filter("lang IS NOT NULL")
    n = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # Only about twice as many rows as are kept are sorted.
    near = F.lit(False)
    for lang, k in n.items():
        near = near | ((F.col("lang") == lang) & (F.pmod("h", F.lit(1 << 30)) <= int(min(1.0, (2 * most + 50) / k) * (1 << 30))))
    d = d.filter(near).withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", F.md5("text")))).filter(F.col("k") <= most)
    rows = d.filter("text IS NOT NULL").select("lang", "text").collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def language_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", labelled: DataFrame | None = None) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``lang`` (largest
    proportion; "zxx" if none), ``share``, ``languages`` and ``proportions``
    (largest first), and ``accepted``.

    Every word has a likelihood in each language, the product of its byte
    trigrams' (from ``labelled``, the input itself if not given, at most ``SAMPLE`` documents a
    language), and in none, where all trigrams are alike. Expectation-maximisation
    gives a document's proportions; sets of the 1, 2, ... strongest languages, up to all, are then
    fitted alone, and the one of the highest likelihood less ``COST`` ln(words + 1) for each further language
    is chosen. Each fit goes on until it has converged (``CLOSE``). Languages of up to ``LEAST_SHARE``
    of the words aren't listed. Accepted is a document whose languages explain ``ACCEPT`` of its words.

    A null or wordless text (digits and signs are no words) has no languages and is not
    accepted. Without labels nothing is. Null ids and repeated rows give a row each; ties go to the
    first code; an empty table gives an empty one; other columns are ignored. Nothing
    but the sample is shuffled; whole texts are read.
    """
    ship(docs.sparkSession)
    langs, table = fit(*sample(docs if labelled is None else labelled, id_col, text_col, lang_col))
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_words", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType())), T.StructField("proportions", T.ArrayType(T.DoubleType())), T.StructField("accepted", T.BooleanType())])

    def run(batches):
        for t in K.chunks(batches, "text", 2 << 20):
            words, chosen = infer(t["text"].combine_chunks(), langs, table)
            top = [c[0] if c else (NONE, 0.0) for c in chosen]
            yield from pa.table(
                [t["id"], pa.array(words, pa.int64()), pa.array([x for x, _ in top]), pa.array([s for _, s in top]), pa.array([[x for x, _ in c] for c in chosen], pa.list_(pa.string())), pa.array([[s for _, s in c] for c in chosen], pa.list_(pa.float64())), pa.array([sum(s for _, s in c) >= ACCEPT for c in chosen])],
                names=schema.names,
            ).to_batches()
            del t, words, chosen, top
            K.trim()

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)


def keep_languages(docs: DataFrame, langs: tuple[str, ...] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that :func:`language_mixture` accepts (and whose main language is among ``langs``, if given), unchanged."""
    ship(docs.sparkSession)
    known, table = fit(*sample(docs, id_col, text_col, lang_col))

    def run(batches):
        for t in K.chunks(batches, text, 2 << 20):
            _, chosen = infer(t[text].combine_chunks(), known, table)
            good = [bool(c) and sum(s for _, s in c) >= ACCEPT and (langs is None or c[0][0] in langs) for c in chosen]
            yield from t.filter(pa.array(good, pa.bool_())).to_batches()
            del t, chosen
            K.trim()

    # Arrow functions take no columns with dots in their names.
    plain, text = plainly(docs), f"c{docs.columns.index(text_col)}"
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
