"""Scores as column expressions, and the pairwise and graph measures of sentences.

Equal arithmetic in every engine: doubles, explicit rounding, tie-breakers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswright.functions.text import terms, word_set
from corpuswright.lexicon import OBJECTIVE_CUES, OTHER_WEIGHT, SECTION_WEIGHT, STOP_WORDS, TECHNICAL_RULES
from corpuswright.operators.lookup import weighted_rules
from corpuswright.operators.ranking import distributed_rank
from corpuswright.operators.rules import has, number_of
from corpuswright.operators.skew import skew_join
from corpuswright.session import materialise
from corpuswright.topics import DEEPFAKE, GENERAL, MULTI_AGENT, SEGMENTATION, Topic

TERM = re.compile(r"[^\W_][\w-]*\w")


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def technical_score(text: Column, rules=TECHNICAL_RULES) -> Column:
    return F.least(F.lit(1.0), weighted_rules(text, rules) / F.lit(2.0))


def composite(rank: Column, technical: Column, section: Column, weight: float = 0.5) -> Column:
    """(rank + weight * technical) * weight of the section."""
    w = None
    for name, value in SECTION_WEIGHT.items():
        cond = section == name
        w = F.when(cond, F.lit(value)) if w is None else w.when(cond, F.lit(value))
    return (rank + F.lit(weight) * technical) * w.otherwise(F.lit(OTHER_WEIGHT))


def paper_score(t: Topic, semantic: Column, gate: Column | None = None) -> Column:
    """Five factors of a paper for a topic: core .35, mechanism .25, aim .20, semantic .10, words of the topic .10;
    between .72 and .98, 0 where the gate fails. For columns added by :func:`gates.paper_fields`."""
    core, mechanism = t["core"], t["mechanism"]
    a = F.when(has("title_", core).column(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), number_of("text_", core) / F.lit(float(max(1, min(3, len(core)))))))
    b = F.least(F.lit(1.0), number_of("text_", mechanism) / F.lit(float(max(1, min(2, len(mechanism))))))
    c = F.when(has("text_", OBJECTIVE_CUES).column(), F.lit(1.0)).otherwise(F.lit(0.7))
    keys = key_words(t)
    e = number_of("text_", keys) / F.lit(float(max(1, len(keys))))
    total = F.lit(0.35) * a + F.lit(0.25) * b + F.lit(0.20) * c + F.lit(0.10) * semantic + F.lit(0.10) * e
    score = clip(F.lit(0.65) + F.lit(0.33) * total, 0.72, 0.98)
    return score if gate is None else F.when(gate, score).otherwise(F.lit(0.0))


def key_words(t: Topic) -> list[str]:
    """Words of the topic string that count as key words."""
    return [w for w in re.sub(r"[^a-z0-9\s]", "", t.text.lower()).split() if len(w) > 2 and w not in t["generic"]]


def rank_label(score: Column) -> Column:
    return F.when(score >= 0.85, "High").when(score >= 0.75, "Medium").otherwise("Low")


# Groups of anchors that count double in a title or abstract, by kind of topic.
DOUBLE_GROUPS = {MULTI_AGENT: ("agent", "several"), DEEPFAKE: ("synthetic", "audio"), SEGMENTATION: ("segmentation", "medical"), GENERAL: ()}


def patent_score(t: Topic, gate: Column, weights: tuple[float, float, float, float] = (0.30, 0.40, 0.20, 0.10)) -> Column:
    """Score of a patent for a topic: title, abstract, claims (or description) and coverage, weighted; 85 to 98 for a
    direct, 70 to 84 for a strong match, else 0. For columns added by :func:`gates.patent_fields`; weights are renormalised.

    Anchors of the kind count 2 each, those of a general topic 1; claims count general anchors only.
    """
    total = sum(weights) or 1.0
    double = [a for g in DOUBLE_GROUPS[t.kind] for a in t[g]]
    points = lambda f: number_of(f, t["domain"]) + 2 * number_of(f, double)
    a = F.least(F.lit(1.0), points("abstract_") / F.lit(3.5))
    s = F.lit(weights[0]) * F.least(F.lit(1.0), points("title_") / F.lit(2.5)) + F.lit(weights[1]) * a
    s = s + F.lit(weights[2]) * F.when(F.col("claims_") != "", F.least(F.lit(1.0), number_of("claims_", t["domain"]) / F.lit(2.5))).otherwise(a * F.lit(0.9))
    s = (s + F.lit(weights[3]) * gate["coverage"]) / F.lit(total)
    direct = F.rint(clip(F.lit(85.0) + s * F.lit(13.0), 85.0, 98.0)).cast("int")
    strong = F.rint(clip(F.lit(70.0) + s * F.lit(14.0), 70.0, 84.0)).cast("int")
    return F.when(gate["level"] == "DIRECT_MATCH", direct).when(gate["level"] == "STRONG_RELATED", strong).otherwise(0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays as doubles; null if a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / F.nullif(size(a) * size(b), F.lit(0.0))


def term_weights(items: DataFrame, group: list[str], item: str, text: str, stop=STOP_WORDS) -> DataFrame:
    """(group, item, term, w): tf = count / length, idf = ln((1 + n) / (1 + df)) + 1 in the group.

    Counts combine before each shuffle. n counts all items of the group, also those without terms.
    """
    base = items.select(*group, item, terms(F.col(text), stop).alias("terms"))
    n = base.groupBy(*group).agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("occurrences"))
    tf = base.select(*group, item, F.size("terms").alias("len"), F.explode("terms").alias("term")).groupBy(*group, item, "len", "term").agg(F.count("*").alias("c"))
    tf = materialise(tf, "tf")
    df = tf.groupBy(*group, "term").agg(F.count("*").alias("df"))
    w = F.col("c") / F.col("len") * (F.ln((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))
    return skew_join(tf.join(df, [*group, "term"]), n, group, "occurrences").select(*group, item, "term", w.alias("w"))


def document_weights(items: DataFrame, item: str, text: str, stop=STOP_WORDS, least: int = 3) -> DataFrame:
    """(item, term, w): raw count * ln(1 + N / df) over all items."""
    base = items.select(item, terms(F.col(text), stop, least).alias("terms"))
    tf = base.select(item, F.explode("terms").alias("term")).groupBy(item, "term").agg(F.count("*").alias("c"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = base.agg(F.count("*").alias("n")).first()["n"]
    return tf.join(df, "term").select(item, "term", (F.col("c") * F.ln(F.lit(1.0) + F.lit(float(n)) / F.col("df"))).alias("w"))


def cosine_edges(weights: DataFrame, group: list[str], item: str, cut: float) -> DataFrame:
    """(group, a, b, sim), a < b: items of a group whose term vectors reach the cut.

    Only for groups of bounded size (sampled to at most 150 items by :func:`sampled`): pairs meet on shared
    terms, which turns the theta join into an equi-join with partial sums.
    """
    norm = weights.groupBy(*group, item).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    a = weights.select(*group, "term", F.col(item).alias("a"), F.col("w").alias("wa"))
    b = weights.select(*group, "term", F.col(item).alias("b"), F.col("w").alias("wb"))
    dots = a.join(b, [*group, "term"]).where("a < b").groupBy(*group, "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    na, nb = norm.select(*group, F.col(item).alias("a"), F.col("norm").alias("na")), norm.select(*group, F.col(item).alias("b"), F.col("norm").alias("nb"))
    sim = F.col("dot") / (F.col("na") * F.col("nb"))
    return dots.join(na, [*group, "a"]).join(nb, [*group, "b"]).select(*group, "a", "b", sim.alias("sim")).where(F.col("sim") >= cut)


def all_cosine_edges(weights: DataFrame, group: list[str], item: str, cut: float, block: int = 256) -> DataFrame:
    """(group, a, b, sim), a < b: as :func:`cosine_edges`, for groups of any size and without a sample.

    A group is cut into blocks of about ``block`` items; every pair of blocks is one dense product in a
    task, so no task holds a group and no partial sum is shuffled. Items without terms have no edge.
    """
    vectors = weights.groupBy(*group, item).agg(F.collect_list(F.struct("term", "w")).alias("vector"))
    vectors = materialise(vectors.select(*group, item, F.col("vector.term").alias("terms"), F.col("vector.w").alias("ws")), "vectors")
    n = vectors.groupBy(*group).agg(F.count("*").alias("items"), F.count("*").alias("weight")).where("items > 1")
    placed = skew_join(vectors, n, group, "weight").withColumn("blocks", F.ceil(F.col("items") / F.lit(block)))
    placed = placed.withColumn("k", F.pmod(F.xxhash64(item), "blocks")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.withColumn("lo", F.least("k", "j")).withColumn("hi", F.greatest("k", "j"))
    # at most two blocks a row
    gathered = placed.groupBy(*group, "lo", "hi").agg(F.collect_list(F.struct(F.col(item).alias("item"), (F.col("k") == F.col("lo")).alias("left"), "terms", "ws")).alias("members"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, size = [], 0
            for *names, lo, hi, members in zip(*(b[g] for g in group), b["lo"], b["hi"], b["members"]):
                index: dict[str, int] = {}
                for m in members:
                    for t in m["terms"]:
                        index.setdefault(t, len(index))
                unit = np.zeros((len(members), len(index)))
                for i, m in enumerate(members):
                    unit[i, [index[t] for t in m["terms"]]] = m["ws"]
                unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
                ids = np.array([m["item"] for m in members])
                if lo == hi:
                    sim = unit @ unit.T
                    x, y = np.nonzero(np.triu(sim >= cut, 1))
                    found, one, two = sim[x, y], ids[x], ids[y]
                else:
                    left = np.array([m["left"] for m in members])
                    sim = unit[left] @ unit[~left].T
                    x, y = np.nonzero(sim >= cut)
                    found, one, two = sim[x, y], ids[left][x], ids[~left][y]
                if len(found):
                    first = one < two
                    out.append(pd.DataFrame({**dict(zip(group, names)), "a": np.where(first, one, two), "b": np.where(first, two, one), "sim": found}))
                    size += len(found)
                if size > 100_000:
                    yield pd.concat(out)
                    out, size = [], 0
            if out:
                yield pd.concat(out)

    kind = {f.name: f.dataType.simpleString() for f in weights.schema}
    return gathered.mapInPandas(scan, ", ".join([*(f"`{g}` {kind[g]}" for g in group), f"a {kind[item]}", f"b {kind[item]}", "sim double"]))


def sampled(items: DataFrame, group: list[str], order: list[str], most: int = 150) -> DataFrame:
    """At most ``most`` items of each group, evenly over its order: positions int(i * n / most).

    Positions come from a distributed rank, so a group of any size is never sorted in one task.
    """
    ranked = distributed_rank(items, group, order, "pos")
    n = ranked.groupBy(*group).agg(F.count("*").alias("size"), F.count("*").alias("weight"))
    i = F.col("pos") - 1
    # position p is taken if some i < most has int(i * n / most) = p, that is ceil(p * most / n) < (p + 1) * most / n
    first = F.ceil(i * F.lit(most) / F.col("size"))
    taken = (F.col("size") <= most) | (F.floor(first * F.col("size") / F.lit(float(most))) == i) & (first < most)
    return skew_join(ranked, n, group, "weight").where(taken)


def graph_rank(items: DataFrame, group: list[str], item: str, text: str, order: list[str], damping: float = 0.85, rounds: int = 25, most: int = 150, stop=STOP_WORDS) -> DataFrame:
    """(group, item, score): rank of each item in the similarity graph of its group.

    At most ``most`` items of a group are ranked (evenly sampled), the rest keep 1 / n. Groups are
    bounded by the sample, so each is one small dense matrix in a task. n = 1 scores 1. Rows with a null
    group are left out.
    """
    chosen = materialise(sampled(items.select(*group, item, *[c for c in order if c != item and c not in group], F.coalesce(text, F.lit("")).alias("_text")), group, order, most), "sampled")
    stop_set = frozenset(stop)
    # at most ``most`` members a row
    gathered = chosen.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("pos", F.col(item).alias("item"), "_text"))).alias("members"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, values = [], []
            for members in b["members"]:
                ids += [m["item"] for m in members]
                values.append(rank_texts([m["_text"] for m in members], stop_set, damping, rounds))
            yield pd.DataFrame({item: ids, "score": np.concatenate(values) if values else np.zeros(0)})

    kind = items.schema[item].dataType.simpleString()
    ranked = gathered.select("members").mapInPandas(scan, f"`{item}` {kind}, score double")
    n = items.groupBy(*group).agg(F.count("*").alias("n"), F.count("*").alias("weight"))
    cols = [*group, item]
    return skew_join(items.select(*cols).join(ranked, item, "left"), n, group, "weight").select(*cols, F.coalesce("score", F.lit(1.0) / F.col("n")).alias("score"))


def rank_texts(texts: list[str], stop: frozenset[str], damping: float, rounds: int) -> np.ndarray:
    """Scores of the texts of one group by the random walk over their term cosines."""
    n = len(texts)
    if n == 1:
        return np.ones(1)
    docs = [[w for w in TERM.findall(t.lower()) if len(w) >= 2 and w not in stop] for t in texts]
    index: dict[str, int] = {}
    for d in docs:
        for w in d:
            index.setdefault(w, len(index))
    m = np.zeros((n, max(1, len(index))))
    for i, d in enumerate(docs):
        for w in d:
            m[i, index[w]] += 1.0 / len(d)
    m *= np.log((1.0 + n) / (1.0 + (m > 0).sum(axis=0))) + 1.0
    norm = np.sqrt((m * m).sum(axis=1))
    norm[norm == 0] = 1.0
    m /= norm[:, None]
    sim = m @ m.T
    np.fill_diagonal(sim, 0.0)
    out = sim.sum(axis=1)
    flow = np.divide(sim, out[:, None], out=np.zeros_like(sim), where=out[:, None] > 0)
    s = np.full(n, 1.0 / n)
    for _ in range(rounds):
        s = (1.0 - damping) / n + damping * (flow.T @ s)
    return s


def jaccard(a: Column, b: Column) -> Column:
    """Of two texts' word sets; 0 if either is empty."""
    x, y = word_set(a), word_set(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(both / (F.size(x) + F.size(y) - both))
