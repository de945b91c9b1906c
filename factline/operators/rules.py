"""Ordered rule tables, compiled into one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """The first rule whose condition (SQL over the row) holds gives the class."""

    kind: str
    condition: str
    confidence: str = "high"
    rationale: str = ""
    candidate: bool = False
    manual: bool = False


def cascade(df: DataFrame, rules: Sequence[Rule], default: Rule | None = None) -> DataFrame:
    """``df`` with kind, confidence, rationale, is_candidate, requires_manual_review,
    and ``matched``, the kinds of all rules that hold. A null condition doesn't
    hold. Rows that no rule fits get ``default`` or, without one, go."""
    holds = [F.coalesce(F.expr(r.condition), F.lit(False)) for r in rules]

    def pick(value) -> Column:
        out = F.lit(value(default)) if default else F.lit(None)
        for r, h in zip(reversed(rules), reversed(holds)):
            out = F.when(h, F.lit(value(r))).otherwise(out)
        return out

    matched = F.filter(F.array(*(F.when(h, F.lit(r.kind)) for r, h in zip(rules, holds))), lambda x: x.isNotNull())
    out = df.withColumns(
        {
            "kind": pick(lambda r: r.kind),
            "confidence": pick(lambda r: r.confidence),
            "rationale": pick(lambda r: r.rationale),
            "is_candidate": pick(lambda r: r.candidate),
            "requires_manual_review": pick(lambda r: r.manual),
            "matched": matched,
        }
    )
    return out if default else out.filter(F.col("kind").isNotNull())


def case_sql(rules: Sequence[Rule], default: str | None, field: str = "kind") -> str:
    """The same cascade as a SQL CASE."""
    q = lambda s: "'" + str(s).replace("'", "''") + "'"
    arms = " ".join(f"WHEN {r.condition} THEN {q(getattr(r, field))}" for r in rules)
    return f"CASE {arms} ELSE {q(default) if default is not None else 'NULL'} END"
