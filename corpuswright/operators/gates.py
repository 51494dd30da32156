"""Topic gates: which papers and patents belong to a topic. Rules apply top to bottom, for four kinds of topics.

Fields are added once (:func:`paper_fields`, :func:`patent_fields`); every gate then is one expression on them, so
several topics share a scan. Nulls count as empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswright.operators.lookup import hits
from corpuswright.operators.rules import Verdict, always, at_least, decided, has, matches
from corpuswright.topics import DEEPFAKE, MULTI_AGENT, SEGMENTATION, Topic

SAMPLE = 5000  # characters of the full text that a paper gate reads, as stated
# Words in front of an anchor that deny it.
NEGATION = r"\b(?:without|no|not|lacks?)\s+(?:any\s+)?(?:multi-agent|multiagent|multi agent)"
SEVERAL = ("multi-agent", "multiagent", "multi agent")
# What a work is about that only looks like the topic: (field, parts, reason).
LOOKALIKES = (
    ("text_", ("reinforcement learning", "q-learning", "policy gradient"), "single-agent reinforcement learning"),
    ("title_", ("robot for", "robotic arm", "lawn mowing", "plant care", "industrial robot", "vacuum cleaner"), "physical robot"),
    ("title_", ("packet routing", "telecommunications network", "routing data", "network routing"), "network routing"),
    ("title_", ("fermi paradox", "super-intelligence"), "fermi paradox"),
    ("title_", ("explainable artificial intelligence",), "generic explanation"),
    ("title_", ("clinical decision", "clinical triage"), "clinical application"),
)


def negations_removed(text: Column) -> Column:
    """Text without denied anchors ('without multi-agent ...'), so that they count for nothing."""
    return F.regexp_replace(text, NEGATION, "")


def paper_fields(papers: DataFrame, title: str = "title", abstract: str = "abstract", full_text: str | None = None) -> DataFrame:
    """``papers`` with title_, abstract_, text_ (both and the start of the full text) and head_ (without denials)."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    full = F.lower(F.substring(F.coalesce(full_text, F.lit("")), 1, SAMPLE)) if full_text else F.lit("")
    out = papers.withColumn("title_", low(title)).withColumn("abstract_", low(abstract))
    out = out.withColumn("text_", F.concat("title_", F.lit(" "), "abstract_", F.lit(" "), full))
    return out.withColumn("head_", negations_removed(F.concat("title_", F.lit(" "), "abstract_")))


PAPER_FIELDS_SQL = (
    "lower(trim(coalesce(title, ''))) AS title_, lower(trim(coalesce(abstract, ''))) AS abstract_, lower(trim(coalesce(title, ''))) || ' ' || lower(trim(coalesce(abstract, ''))) || ' ' || lower(left(coalesce(full_text, ''), "
    f"{SAMPLE})) AS text_, regexp_replace(lower(trim(coalesce(title, ''))) || ' ' || lower(trim(coalesce(abstract, ''))), '{NEGATION}', '', 'g') AS head_"
)


def paper_verdicts(t: Topic) -> list[Verdict]:
    """Verdicts of a literature topic, for columns added by :func:`paper_fields`."""
    domain = has("text_", t["domain"])
    if t.kind == MULTI_AGENT:
        named = has("text_", (*SEVERAL, "multiple agents"))
        several = has("head_", t["several"])
        agent = has("text_", t["agent"]) | (has("text_", ("agent",)) & has("text_", ("software", "neural", "learning", "algorithm", "model", "llm")))
        out = [Verdict(has("title_", (e,)) | (has("abstract_", (e,)) & ~named), f"excluded: {e}", "REJECTED") for e in t["exclusion"]]
        out.append(Verdict(~(domain | matches("text_", r"\b(?:ai|ml|marl|rl|llm|llms|nlp)\b")), "no domain", "REJECTED"))
        if t.several:
            out += [Verdict(~several & has(f, parts), reason, "REJECTED") for f, parts, reason in LOOKALIKES]
            out.append(Verdict(~several, "no multi-agent evidence", "REJECTED"))
        else:
            out.append(Verdict(~agent & ~several, "no agent evidence", "REJECTED"))
        direct = has("title_", ("multi-agent", "multiagent", "multi agent", "marl", "multi-agents", "multiple agents"))
        direct = direct | (has("abstract_", ("multi-agent",)) & has("abstract_", ("propose", "survey", "introduce", "study", "develop", "framework", "algorithm", "architecture")))
        return [*out, Verdict(direct, "passed", "DIRECT_MATCH", 1.0), Verdict(always(), "passed", "STRONG_RELATED", 1.0)]
    if t.kind == DEEPFAKE:
        named = has("text_", ("deepfake", "voice spoof", "synthetic speech", "audio spoof"))
        out = [Verdict(has("title_", (e,)) | (has("abstract_", (e,)) & ~named), f"excluded: {e}", "REJECTED") for e in t["exclusion"]]
        return [*out, Verdict(~domain, "no domain", "REJECTED"), Verdict(~has("text_", t["core"]), "no core concept", "REJECTED"), Verdict(always(), "passed", "DIRECT_MATCH", 1.0)]
    if t.kind == SEGMENTATION:
        out = [Verdict(has("title_", (e,)), f"excluded: {e}", "REJECTED") for e in t["exclusion"]]
        return [*out, Verdict(~domain, "no domain", "REJECTED"), Verdict(~has("text_", t["mechanism"]), "no mechanism", "REJECTED"), Verdict(always(), "passed", "DIRECT_MATCH", 1.0)]
    enough = at_least("text_", t["core"], max(1, len(t["core"]) // 2))
    return [Verdict(enough, "passed", "DIRECT_MATCH", 1.0), Verdict(always(), "no core concept", "REJECTED")]


def patent_fields(patents: DataFrame) -> DataFrame:
    """``patents`` with title_, abstract_, claims_ (the description where they are blank) and text_."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    out = patents.withColumn("title_", low("title")).withColumn("abstract_", low("abstract"))
    out = out.withColumn("claims_", low(F.coalesce(F.nullif("claims", F.lit("")), "description")))
    return out.withColumn("text_", F.concat_ws(" ", "title_", "abstract_", "claims_"))


PATENT_FIELDS_SQL = (
    "lower(coalesce(title, '')) AS title_, lower(coalesce(abstract, '')) AS abstract_, lower(coalesce(nullif(claims, ''), description, '')) AS claims_, "
    "lower(coalesce(title, '')) || ' ' || lower(coalesce(abstract, '')) || ' ' || lower(coalesce(nullif(claims, ''), description, '')) AS text_"
)


def patent_verdicts(t: Topic) -> list[Verdict]:
    """Verdicts of a patent topic, for columns added by :func:`patent_fields`."""
    reject = lambda when, reason: Verdict(when, reason, "REJECTED")
    if t.kind == MULTI_AGENT:
        agent, several = has("text_", t["agent"]), has("text_", t["several"])
        ai = has("text_", t["ai"]) | matches("text_", r"\bai\b")
        ai_gate = ai | (has("text_", ("agent",)) & has("text_", ("neural", "learning", "algorithm", "software", "model")))
        out = [
            reject(has("text_", t["other_agents"]) & ~(agent | several), "other kind of agent"),
            reject(has("text_", t["machines"]) & ~agent, "physical machine"),
            reject(has("text_", t["telecom"]) & ~agent & ~ai, "network routing"),
            reject(~ai_gate, "no intelligence"),
            reject(~(agent | (ai & has("text_", ("agent",)))), "no software agent"),
        ]
        if t.several:
            return [*out, Verdict(several, "passed", "DIRECT_MATCH", 1.0), Verdict(always(), "single agent", "ADJACENT", 0.5)]
        return [*out, Verdict(agent, "passed", "DIRECT_MATCH", 0.9), Verdict(always(), "passed", "STRONG_RELATED", 0.9)]
    if t.kind == DEEPFAKE:
        audio, synthetic, found = has("text_", t["audio"]), has("text_", t["synthetic"]), has("text_", t["detection"])
        plain = has("text_", t["plain_audio"])
        return [
            reject(~audio & has("text_", t["visual"]), "visual only"),
            reject(~audio & has("text_", t["markers"]), "chemical marker"),
            reject(~audio, "no audio"),
            Verdict(synthetic & found & ~plain, "passed", "DIRECT_MATCH", 1.0),
            Verdict(has("text_", t["security"]) & found & ~plain, "passed", "STRONG_RELATED", 0.8),
            Verdict(always(), "plain audio", "ADJACENT", 0.3),
        ]
    if t.kind == SEGMENTATION:
        return [
            reject(has("text_", t["industrial"]) & ~has("text_", t["surely_medical"]), "industrial"),
            reject(~has("text_", t["medical"]), "not medical"),
            reject(~has("text_", t["image"]), "no imaging"),
            Verdict(~has("text_", t["segmentation"]), "no segmentation", "ADJACENT", 0.4),
            Verdict(always(), "passed", "DIRECT_MATCH", 1.0),
        ]
    words = t["domain"]
    if not words:
        return [Verdict(always(), "passed", "DIRECT_MATCH", 1.0)]
    n = len(words)
    # one verdict for each number of words, so that the coverage is a constant of the verdict
    out = [Verdict(at_least("text_", words, k), "passed", "DIRECT_MATCH" if k == n else "STRONG_RELATED", k / n) for k in range(n, max(1, n // 2) - 1, -1)]
    out += [Verdict(at_least("text_", words, k), "no core concept", "REJECTED", k / n) for k in range(max(1, n // 2) - 1, 0, -1)]
    return [*out, Verdict(always(), "no core concept", "REJECTED")]


def paper_gate(t: Topic) -> Column:
    """struct(passed, reason, level, coverage) of a literature topic."""
    return decided(paper_verdicts(t))


def patent_gate(t: Topic) -> Column:
    """struct(passed, reason, level, coverage) of a patent topic; ADJACENT and REJECTED do not pass."""
    return decided(patent_verdicts(t))


def general_gate(text: Column, words: list[str]) -> Column:
    """Level by how many of a free topic's words occur: all, half, fewer."""
    n = hits(text, words, "word")
    return F.when(F.lit(len(words)) == 0, "DIRECT").when(n >= len(words), "DIRECT").when(n >= max(1, len(words) // 2), "STRONG").otherwise("REJECTED")


def topic_words(topic: str, generic: tuple[str, ...]) -> list[str]:
    """Significant words of a topic string, in order."""
    return list(dict.fromkeys(w for w in topic.lower().split() if len(w) > 2 and w not in generic))
