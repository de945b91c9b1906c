"""Quality rules: a threshold table compiled into one Spark projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP = (
    "the of and to in is that for it as with be on by at this are from was a an or "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es "
    "de la le et les des en un du une que est pour qui dans par sur au pas avec "
    "el y los del se las por con no para su al lo como"
).split()
SYMBOLS = "#%&$*!|<>{}[]~^=+_\\"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """``name`` fails where ``metric`` is outside [low, high]; texts with fewer
    words than ``from_words`` are too short for the ratio to mean anything."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


RULES = (
    Rule("empty", "n_words", low=1),
    Rule("long", "n_words", high=1_000_000),
    Rule("symbols", "symbol_ratio", high=0.05),
    Rule("capitals", "capital_ratio", high=0.4),
    Rule("word_length", "word_length", low=2.0, high=20.0, from_words=20),
    Rule("stop_words", "stop_ratio", low=0.05, from_words=50),
    Rule("repeated_lines", "repeated_line_ratio", high=0.4),
    Rule("short_lines", "short_line_ratio", high=0.9, from_words=100),
)


def metrics(text: Column) -> dict[str, Column]:
    """Every metric as a built-in expression; a null text counts as empty and a
    ratio of an empty text is 0."""
    t = F.coalesce(text, F.lit(""))
    words = F.split(t, "[ \\t\\n\\r]+")
    n_chars = F.length(t)
    solid = F.length(F.translate(t, " \t\n\r", ""))
    n_words = F.size(F.filter(words, lambda w: w != ""))
    stop = F.size(F.filter(F.split(F.lower(t), "[ \\t\\n\\r.,;:!?]+"), lambda w: w.isin(STOP)))
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    n_lines = F.size(lines)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "n_chars": n_chars,
        "n_words": n_words,
        "n_lines": n_lines,
        "word_length": ratio(solid, n_words),
        "symbol_ratio": ratio(n_chars - F.length(F.translate(t, SYMBOLS, "")), n_chars),
        "capital_ratio": ratio(n_chars - F.length(F.translate(t, UPPER, "")), n_chars),
        "stop_ratio": ratio(stop, n_words),
        "repeated_line_ratio": ratio(n_lines - F.size(F.array_distinct(lines)), n_lines),
        "short_line_ratio": ratio(F.size(F.filter(lines, lambda x: F.length(x) < 20)), n_lines),
    }


def broken(rule: Rule, m: dict[str, Column]) -> Column:
    bad = F.lit(False)
    if rule.low is not None:
        bad = bad | (m[rule.metric] < F.lit(rule.low))
    if rule.high is not None:
        bad = bad | (m[rule.metric] > F.lit(rule.high))
    return bad & (m["n_words"] >= rule.from_words) if rule.from_words else bad


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, metrics, ``failed`` (names of broken rules in
    table order, joined by commas, empty if none) and ``keep``.

    A null or empty text breaks ``empty`` only by its word count (ratios are
    0). Null ids and repeated rows pass through one for one; an empty table
    gives an empty one; other columns are ignored, whatever their names. The
    metrics sit in one projection below the verdicts, so each is computed once
    a row and nothing is shuffled.
    """
    m = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *(v.alias(k) for k, v in metrics(F.col(f"`{text_col}`").cast("string")).items()))
    of = {c: F.col(c) for c in m.columns}
    failed = F.concat_ws(",", *(F.when(broken(r, of), F.lit(r.name)) for r in rules))
    return m.withColumn("failed", failed).withColumn("keep", F.col("failed") == "")


def oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    stop = ", ".join(map(quote, sorted(set(STOP))))
    arms = []
    for r in RULES:
        bad = [f"{r.metric} < {r.low}"] * (r.low is not None) + [f"{r.metric} > {r.high}"] * (r.high is not None)
        test = "(" + " OR ".join(bad) + ")" + f" AND n_words >= {r.from_words}"
        arms.append(f"CASE WHEN {test} THEN {quote(r.name)} END")
    ws = "chr(9)||chr(10)||chr(13)||' '"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
a AS (SELECT doc_id, x, list_filter(string_split(x, chr(10)), lambda l: l <> '') AS lines,
        len(list_filter(regexp_split_to_array(x, '[ \\t\\n\\r]+'), lambda w: w <> '')) AS n_words,
        len(list_filter(regexp_split_to_array(lower(x), '[ \\t\\n\\r.,;:!?]+'), lambda w: w IN ({stop}))) AS stops FROM t),
b AS (SELECT doc_id, length(x)::INT AS n_chars, n_words::INT AS n_words, len(lines)::INT AS n_lines,
        CASE WHEN n_words > 0 THEN length(translate(x, {ws}, '')) / n_words ELSE 0.0::DOUBLE END AS word_length,
        CASE WHEN length(x) > 0 THEN (length(x) - length(translate(x, {quote(SYMBOLS)}, ''))) / length(x) ELSE 0.0::DOUBLE END AS symbol_ratio,
        CASE WHEN length(x) > 0 THEN (length(x) - length(translate(x, {quote(UPPER)}, ''))) / length(x) ELSE 0.0::DOUBLE END AS capital_ratio,
        CASE WHEN n_words > 0 THEN stops / n_words ELSE 0.0::DOUBLE END AS stop_ratio,
        CASE WHEN len(lines) > 0 THEN (len(lines) - len(list_distinct(lines))) / len(lines) ELSE 0.0::DOUBLE END AS repeated_line_ratio,
        CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda l: length(l) < 20)) / len(lines) ELSE 0.0::DOUBLE END AS short_line_ratio FROM a),
c AS (SELECT *, concat_ws(',', {', '.join(arms)}) AS failed FROM b)
SELECT *, failed = '' AS keep FROM c"""
