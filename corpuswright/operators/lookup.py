"""Anchors, rules and cue words against text: the theta joins of the library.

The lists are small parameters, so the join is a literal array folded inside codegen: no shuffle, no
nested loop over rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuswright.functions.text import wide_as_letter


def spaced(text: Column) -> Column:
    """Lower-case words between single blanks, a blank at either end; '  ' for null."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def hits(text: Column, anchors: list[str], match: str = "substring") -> Column:
    """How many of the distinct anchors occur; 0 for null text.

    Single words are looked up in the text's word array at once, so the text is normalised once and the
    generated code does not grow with the list.
    """
    anchors = list(dict.fromkeys(a.lower() for a in anchors))
    if match == "word":
        single, longer = [a for a in anchors if " " not in a], [a for a in anchors if " " in a]
        n = F.size(F.array_intersect(F.array(*[F.lit(a) for a in single]), F.split(spaced(text), " "))) if single else F.lit(0)
        return reduce(lambda a, b: a + b, [spaced(text).contains(f" {a} ").cast("int") for a in longer], n)
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [low.contains(a).cast("int") for a in anchors], F.lit(0))


def any_hit(text: Column, anchors: list[str], match: str = "substring") -> Column:
    return hits(text, anchors, match) > 0


def matched(text: Column, anchors: list[str], match: str = "substring") -> Column:
    """The anchors that occur, in list order, without case and without repetition."""
    anchors = list(dict.fromkeys(a.lower() for a in anchors))
    if match == "word" and not any(" " in a for a in anchors):
        return F.array_intersect(F.array(*[F.lit(a) for a in anchors]), F.split(spaced(text), " "))
    low = spaced(text) if match == "word" else F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.contains(f" {a} " if match == "word" else a), F.lit(a)) for a in anchors]))


def first_rule(text: Column, rules, field: int = 1) -> Column:
    """Label of the first rule whose part occurs in the lower-case text, else null."""
    low = F.lower(text)
    out = None
    for rule in rules:
        cond = low.contains(rule[0])
        out = F.when(cond, rule[field]) if out is None else out.when(cond, rule[field])
    return out


def alternatives(pattern: str) -> list[str]:
    """Alternatives of the group that a pattern opens with behind a word boundary; [] for other patterns."""
    if not pattern.startswith(r"\b("):
        return []
    depth, out, now = 0, [], ""
    for c in pattern[2:]:
        depth += (c == "(") - (c == ")")
        if depth == 0:
            return [*out, now]
        if c == "|" and depth == 1:
            out, now = [*out, now], ""
        elif not (c == "(" and depth == 1):
            now += c
    return []


def weighted_rules(text: Column, rules) -> Column:
    """Sum of the weights of the regular expressions that match the lower-case text; 0 for null.

    The text is prepared once. Rules that list single words are answered from the set of its words; of the others only
    those are run of which some alternative's first letters occur. Both are exact.
    """
    plain: dict[str, list[int]] = {}
    rest = []
    for i, (pattern, weight) in enumerate(rules):
        parts = alternatives(pattern)
        if parts and pattern == rf"\b({'|'.join(parts)})\b" and all(re.fullmatch("[a-z0-9]+", p) for p in parts):
            for p in parts:
                plain.setdefault(p, []).append(i)
        else:
            leads = [m[0] for m in (re.match("[a-z]{2,}", p) for p in parts) if m]
            # an optional last letter is not part of what must occur
            leads = [x[:-1] if p[len(x) : len(x) + 1] in ("?", "*", "{") else x for x, p in zip(leads, parts)] if len(leads) == len(parts) else []
            rest.append((pattern, weight, [x for x in leads if x] if all(leads) else []))
    low = wide_as_letter(text)
    # one lambda in SQL text: the plan is parsed at once instead of built call by call
    total = "0.0d"
    if plain:
        words = "array(" + ", ".join(f"'{w}'" for w in plain) + ")"
        by_word = "map(" + ", ".join(f"'{w}', array({', '.join(map(str, ids))})" for w, ids in plain.items()) + ")"
        weights = "array(" + ", ".join(f"{float(w)}d" for _, w in rules) + ")"
        found = f"array_distinct(flatten(transform(array_intersect({words}, split(t, '[^a-z0-9_]+')), w -> {by_word}[w])))"
        total = f"aggregate({found}, 0.0d, (s, i) -> s + get({weights}, i))"
    for pattern, weight, leads in rest:
        hit = f"t rlike r'{pattern}'"
        if leads:
            hit = "(" + " or ".join(f"contains(t, '{x}')" for x in leads) + f") and {hit}"
        total += f" + case when {hit} then {float(weight)}d else 0.0d end"
    return F.get(F.call_function("transform", F.array(low), F.expr(f"t -> {total}")), F.lit(0))
