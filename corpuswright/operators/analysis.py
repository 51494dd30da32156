"""Clustering, evidence lookup, evaluation and report tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswright.functions.stem import ascii_words, stemmed
from corpuswright.functions.text import words
from corpuswright.lexicon import SEVERITIES
from corpuswright.operators.ranking import distributed_rank
from corpuswright.session import materialise


def leader_clusters(weights: DataFrame, item: str, cut: float = 0.15, block: int = 5_000) -> DataFrame:
    """(item, leader): in order of item, each joins the most similar leader of at least ``cut``, else leads.

    The order makes it sequential. Items go through in blocks of ``block``: a round joins the block's vectors with all
    leaders so far on shared terms, distributed; only what is left, the block's own order, is settled in one task. Leaders are a
    written table. Ties go to the earlier leader; an item without terms leads itself.
    """
    one = weights.groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    one = distributed_rank(one.withColumn("_all", F.lit(0)), ["_all"], [item], "_p").drop("_all")
    one = materialise(one.withColumn("_round", F.floor((F.col("_p") - 1) / block).cast("int")), "vectors")
    kind = weights.schema[item].dataType.simpleString()
    schema = f"`{item}` {kind}, leader {kind}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        leaders, out = [], []
        for key, v, norm, old, sim in sorted(zip(pdf[item], pdf["v"], pdf["norm"], pdf["old"], pdf["sim"]), key=lambda x: x[0]):
            v = dict(v)
            best, at = (sim, old) if sim == sim and sim is not None and sim >= cut else (cut, None)
            for other, u, un in leaders:
                s = sum(x * u[t] for t, x in v.items() if t in u) / (norm * un) if norm and un else 0.0
                if s > best or (s == best and at is None):
                    best, at = s, other
            if at is None:
                leaders.append((key, v, norm))
                at = key
            out.append((key, at))
        return pd.DataFrame(out, columns=[item, "leader"])

    rounds = (one.agg(F.max("_round")).first()[0] or 0) + 1
    done, leading = None, None
    for r in range(rounds):
        part = one.where(F.col("_round") == r)
        if leading is None:
            part = part.withColumn("old", F.lit(None).cast(kind)).withColumn("sim", F.lit(None).cast("double"))
        else:
            flat = lambda df, k, n: df.select(F.col(item).alias(k), F.col("norm").alias(n), F.explode("v").alias("term", f"w_{k}"))
            dots = flat(part, "a", "na").join(flat(leading, "b", "nb"), "term").groupBy("a", "b", "na", "nb").agg(F.sum(F.col("w_a") * F.col("w_b")).alias("dot"))
            dots = dots.withColumn("sim", F.col("dot") / (F.col("na") * F.col("nb"))).where(F.col("sim") >= cut)
            best = dots.groupBy("a").agg(F.max("sim").alias("sim"), F.min_by("b", F.struct(-F.col("sim"), "b")).alias("old"))
            part = part.join(best.withColumnRenamed("a", item), item, "left")
        got = materialise(part.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, schema), "led")
        new = one.where(F.col("_round") == r).join(got.where(F.col(item) == F.col("leader")).select(item), item)
        leading = materialise(new if leading is None else leading.unionByName(new), "leaders") if r + 1 < rounds else leading
        done = got if done is None else done.unionByName(got)
    return done


def cyclic(values: tuple[str, ...], position: Column) -> Column:
    """Value at position (from 1) of an endlessly repeated list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(position - 1, F.lit(len(values))) + 1).cast("int"))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == SEVERITIES[0], 3).when(severity == SEVERITIES[1], 2).otherwise(1)


def grams(words_: Column, n: int) -> Column:
    """Sequences of n of the words, joined by blanks; [] if there are fewer. ``words_`` should be a plain
    column: an expression would be computed anew for every gram."""
    if n == 1:
        return words_
    last = F.size(words_) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words_, i, n), " "))).otherwise(F.array().cast("array<string>"))


def rouge_n(pairs: DataFrame, key: str, candidate: str, reference: str, n: int, stems: bool = False) -> DataFrame:
    """(key, overlap, candidate_grams, reference_grams, f1): clipped multiset overlap of n-grams, of words or of their stems."""
    tokens = (lambda c: stemmed(ascii_words(F.col(c)))) if stems else (lambda c: words(F.col(c)))
    sides = []
    for side, c in ((0, candidate), (1, reference)):
        flat = pairs.select(key, tokens(c).alias("_w")).select(key, F.explode(grams(F.col("_w"), n)).alias("_gram"))
        sides.append(flat.groupBy(key, "_gram").agg(F.count("*").alias("_n")).select(key, "_gram", *[(F.col("_n") if side == k else F.lit(0).cast("long")).alias(f"_{k}") for k in (0, 1)]))
    per = sides[0].unionByName(sides[1]).groupBy(key, "_gram").agg(F.sum("_0").alias("_0"), F.sum("_1").alias("_1"))
    s = per.groupBy(key).agg(F.sum(F.least("_0", "_1")).alias("overlap"), F.sum("_0").alias("candidate_grams"), F.sum("_1").alias("reference_grams"))
    f1 = F.when(F.col("candidate_grams") + F.col("reference_grams") > 0, F.lit(2.0) * F.col("overlap") / (F.col("candidate_grams") + F.col("reference_grams"))).otherwise(F.lit(0.0))
    return s.withColumn("f1", f1)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def rouge_l(pairs: DataFrame, key: str, candidate: str, reference: str, stems: bool = False) -> DataFrame:
    """(key, lcs, f1) of the sequences of words or stems; null texts count as empty."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b)])

    lcs = F.pandas_udf(run, "int")
    tokens = (lambda c: stemmed(ascii_words(F.col(c)))) if stems else (lambda c: words(F.col(c)))
    pairs = pairs.select(key, tokens(candidate).alias("_c"), tokens(reference).alias("_r"))
    c, r = F.col("_c"), F.col("_r")
    rows = pairs.select(key, F.size(c).alias("n"), F.size(r).alias("m"), lcs(c, r).alias("lcs"))
    return rows.select(key, "lcs", F.when(F.col("n") + F.col("m") > 0, F.lit(2.0) * F.col("lcs") / (F.col("n") + F.col("m"))).otherwise(F.lit(0.0)).alias("f1"))


def status_rollup(rows: DataFrame, status: str, relevant: Column) -> DataFrame:
    """One row: overall status from the status of each source; skipped sources do not count as active.

    Anything relevant makes a success, a partial one where some source failed, was empty or skipped. Without: all skipped; all
    active ones empty; all active ones failed; no source returned anything (RETRIEVAL_FAILED); else no results.
    """
    s = rows.agg(
        F.count("*").alias("sources"), F.count_if(F.col(status).isin("SOURCE_UNAVAILABLE", "AUTHENTICATION_FAILED", "RATE_LIMITED")).alias("failed"), F.count_if(F.col(status) == "NO_RESULTS").alias("empty"),
        F.count_if(F.col(status) == "SKIPPED_NO_CREDENTIALS").alias("skipped"), F.coalesce(F.max(relevant.cast("int")), F.lit(0)).alias("relevant"))
    active = F.col("sources") - F.col("skipped")
    overall = (
        F.when((F.col("relevant") > 0) & ((F.col("failed") > 0) | (F.col("skipped") > 0) | (F.col("empty") > 0)), "PARTIAL_SUCCESS").when(F.col("relevant") > 0, "SUCCESS").when(active == 0, "SKIPPED_NO_CREDENTIALS")
        .when(F.col("empty") == active, "NO_RESULTS").when(F.col("failed") == active, "SOURCE_UNAVAILABLE").when(F.col("failed") + F.col("empty") == active, "RETRIEVAL_FAILED").otherwise("NO_RESULTS")
    )
    return s.withColumn("overall", overall)
