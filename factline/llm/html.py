"""HTML extraction by two-pass block rules."""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factline.llm.quality import STOP
from factline.llm.tokens import trim
from factline.ship import ship

#: Characters below which a block is short, and above which stop words alone decide.
SHORT, LONG = 70, 200
#: Stop words a word of text has at least, for a near-good and a good block; low, as the list has the very commonest only.
STOP_LOW, STOP_HIGH = 0.12, 0.18
LINKS = 0.2
#: A short heading counts if so many characters of other blocks, or fewer, stand between it and a good one.
HEADING = 200

_RAW = "script|style|noscript|template|svg|iframe|object|textarea|select|title|math"
_BLOCK = frozenset("address article aside blockquote body caption center col colgroup dd dialog details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li link main menu meta nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_MARK = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<raw>{_RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)",
    re.S | re.I,
)
_STOP = frozenset(STOP)
_EDGE = ".,;:!?\"'()[]{}«»“”„…%#$&*|<>-–—"


def blocks(page: str) -> list[tuple[str, int, bool, str]]:
    """(text, characters in links, whether a heading, class of the first pass)
    of each block: text between tags that begin or end one, or between two
    line breaks in a row. Comments, scripts, styles and other contents that aren't text go."""
    out: list[tuple[str, int, bool, str]] = []
    parts: list[str] = []
    linked, in_link, heading, breaks = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, min(linked, len(text)), heading > 0, first_pass(text, min(linked, len(text)))))
        parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked, breaks
        if "&" in piece:
            piece = entities.unescape(piece)
        if not piece.isspace():
            breaks = 0
            if in_link:
                linked += len(" ".join(piece.split()))
        parts.append(piece)

    at = 0
    for m in _MARK.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, end = tag.lower(), bool(m["end"] or m["end2"])
        if tag == "a":
            in_link = 0 if end else 1
        elif tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks == 2:
                flush()
        elif tag in _BLOCK:
            flush()
            breaks = 0
            in_link = 0
            if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
                heading = 0 if end else 1
    if at < len(page):
        add(page[at:])
    flush()
    return out


def first_pass(text: str, linked: int) -> str:
    """The class that a block's own text gives: good, bad, short or near."""
    if linked / len(text) > LINKS or "\xa9" in text:
        return "bad"
    if len(text) < SHORT:
        return "bad" if linked else "short"
    words = text.lower().split()
    density = sum(w.strip(_EDGE) in _STOP for w in words) / len(words)
    if density >= STOP_HIGH:
        return "good" if len(text) > LONG else "near"
    return "near" if density >= STOP_LOW else "bad"


def second_pass(found: list[tuple[str, int, bool, str]]) -> list[bool]:
    """Whether each block is content. Short and near-good blocks inherit from the
    nearest decided ones on both sides, beyond either end of the page being bad:
    from two of one kind theirs; between good and bad a near-good block is good, and a
    short one only if a near-good stands between it and the bad one. A short heading ahead of
    a good block within ``HEADING`` characters counts as near-good."""
    first = [c for *_, c in found]
    size = [len(t) for t, *_ in found]
    start = list(first)
    gap, good = 0, False
    for k in range(len(found) - 1, -1, -1):
        if first[k] == "good":
            gap, good = 0, True
            continue
        if found[k][2] and first[k] == "short" and good and gap <= HEADING:
            start[k] = "near"
        gap += size[k]

    def sides(labels: list[str], kinds: tuple[str, ...]) -> tuple[list[str], list[str]]:
        before, after, last = [], [""] * len(labels), "bad"
        for c in labels:
            before.append(last)
            last = c if c in kinds else last
        last = "bad"
        for k in range(len(labels) - 1, -1, -1):
            after[k] = last
            last = labels[k] if labels[k] in kinds else last
        return before, after

    before, after = sides(start, ("good", "bad"))
    near_before, near_after = sides(start, ("good", "bad", "near"))
    out = []
    for k, c in enumerate(start):
        b, a = before[k], after[k]
        if c == "short":
            if a == b:
                out.append(a == "good")
            else:
                out.append((b == "bad" and near_before[k] == "near") or (a == "bad" and near_after[k] == "near"))
        elif c == "near":
            out.append("good" in (a, b))
        else:
            out.append(c == "good")
    return out


def extract(page: str | None) -> tuple[int, int, str]:
    """Blocks, blocks of content, and the content, a block a line."""
    found = blocks(page or "")
    kept = [t for (t, *_), good in zip(found, second_pass(found)) if good]
    return len(found), len(kept), "\n".join(kept)


def extract_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id``, ``n_blocks``, ``n_good`` and ``text``.

    Pass one classes each block by its share of stop words (four languages), its
    length and its link density; pass two gives the ambiguous ones the label of their
    nearest decided neighbours (:func:`second_pass`). A null or empty page has no
    blocks and an empty text. Null ids and repeated rows give a row each; an empty table
    gives an empty one; other columns are ignored. Whole pages are read, in
    Arrow batches, and nothing is shuffled.
    """
    ship(pages.sparkSession)
    id_type = pages.schema[id_col].dataType
    schema = T.StructType([T.StructField("page_id", id_type), T.StructField("n_blocks", T.IntegerType()), T.StructField("n_good", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                got = [extract(x) for x in part["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array([x for x, _, _ in got], pa.int32()), pa.array([x for _, x, _ in got], pa.int32()), pa.array([x for _, _, x in got], pa.string())], names=schema.names)
        trim()

    return pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").cast("string").alias("html")).mapInArrow(run, schema)
