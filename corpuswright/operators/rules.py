"""Conditions on text as data: one description, read as a Spark column or as SQL.

A condition names fields; the fields are lower-case text columns that are never null. Lists of parts become one
regular expression, so a text is scanned once a list.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(part: str) -> str:
    """A part as a regular expression that both engines read alike."""
    return re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", part)


@dataclass(frozen=True)
class Rule:
    column: Callable[[], Column]
    sql: str

    def __and__(self, other: Rule) -> Rule:
        return Rule(lambda: self.column() & other.column(), f"({self.sql} AND {other.sql})")

    def __or__(self, other: Rule) -> Rule:
        return Rule(lambda: self.column() | other.column(), f"({self.sql} OR {other.sql})")

    def __invert__(self) -> Rule:
        return Rule(lambda: ~self.column(), f"(NOT {self.sql})")


def matches(field: str, pattern: str) -> Rule:
    quoted = pattern.replace("'", "''")
    return Rule(lambda: F.col(field).rlike(pattern), f"regexp_matches({field}, '{quoted}')")


def has(field: str, parts: tuple[str, ...] | list[str]) -> Rule:
    """Some part occurs in the field, as a substring."""
    return matches(field, "|".join(literal(p) for p in parts)) if parts else never()


def always() -> Rule:
    return Rule(lambda: F.lit(True), "true")


def never() -> Rule:
    return Rule(lambda: F.lit(False), "false")


def number_of(field: str, parts: tuple[str, ...] | list[str]) -> Column:
    """How many of the parts occur in the field, as substrings."""
    if not parts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(p) for p in parts]), lambda p: F.col(field).contains(p)))


def number_sql(field: str, parts: tuple[str, ...] | list[str]) -> str:
    quote = lambda p: p.replace("'", "''")
    return "(0" + "".join(f" + contains({field}, '{quote(p)}')::INT" for p in parts) + ")"


def at_least(field: str, parts: tuple[str, ...] | list[str], n: int) -> Rule:
    return Rule(lambda: number_of(field, parts) >= n, f"({number_sql(field, parts)} >= {n})")


@dataclass(frozen=True)
class Verdict:
    """What holds if its condition is the first that holds."""

    when: Rule
    reason: str
    level: str
    coverage: float = 0.0


def decided(verdicts: list[Verdict]) -> Column:
    """struct(passed, reason, level, coverage) of the first verdict whose condition holds; the last one's always does."""
    out = None
    for v in verdicts[:-1]:
        s = _outcome(v)
        out = F.when(v.when.column(), s) if out is None else out.when(v.when.column(), s)
    return _outcome(verdicts[-1]) if out is None else out.otherwise(_outcome(verdicts[-1]))


def _outcome(v: Verdict) -> Column:
    return F.struct(F.lit(v.level in PASSING).alias("passed"), F.lit(v.reason).alias("reason"), F.lit(v.level).alias("level"), F.lit(v.coverage).alias("coverage"))


def decided_sql(verdicts: list[Verdict], part: str) -> str:
    """SQL of one part of the verdict: reason, level or coverage."""
    value = lambda v: f"{v.coverage}::DOUBLE" if part == "coverage" else "'" + getattr(v, part).replace("'", "''") + "'"
    return "CASE " + " ".join(f"WHEN {v.when.sql} THEN {value(v)}" for v in verdicts[:-1]) + f" ELSE {value(verdicts[-1])} END" if len(verdicts) > 1 else value(verdicts[0])


PASSING = ("DIRECT_MATCH", "STRONG_RELATED")
