"""Semantics of the core operators on small cases: definitions, edge cases, brute force, properties."""

import json
import math
import random
import subprocess
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuswright.functions import text as tx
from corpuswright.operators import analysis, compress, dedup, filters, gates, joins, lookup, ranking, scores, sections, similar
from corpuswright.operators.graph import components
from corpuswright.operators.skew import skew_join
from corpuswright.sources import payloads, replay
from corpuswright.streaming import events


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, col, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, tx.clean_html(F.col("t")), t="<p>A&amp;B</p><script>x</script><div>C <b>d</b></div><!-- no -->") == "A&B\nC d"
    assert one(spark, tx.strip_markup(F.col("t")), t="a &lt;i&gt;b&lt;/i&gt;\n c") == "a b c"
    assert one(spark, tx.title_key(F.col("t")), t="On Ärger: 2!") == "onrger2" and one(spark, tx.unicode_title_key(F.col("t")), t="On Ärger: 2!") == "onärger2"
    assert one(spark, tx.title_key(F.col("t")), t=None) == ""
    assert one(spark, tx.word_count(F.col("t")), t=None) == 0 and one(spark, tx.word_count(F.col("t")), t=" a\n b ") == 2
    assert one(spark, tx.token_estimate(F.col("t")), t="w " * 100) == 114 and one(spark, tx.token_estimate(F.col("t")), t="w") == 1
    assert one(spark, tx.patent_key(F.col("t")), t="https://p.example/patent/US-1234567-B2/en") == "US1234567B2"
    assert one(spark, tx.unfence(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, tx.slug(F.col("t")), t=" A b: C ") == "a_b_c" and one(spark, tx.ascii_safe(F.col("t")), t="aé漢") == "a??"
    assert one(spark, tx.looks_like_html(F.col("t")), t="a < b > c") is False


def test_token_estimate_equals_binary_double(spark):
    df = spark.range(1, 2001).select(F.col("id").alias("n"), tx.token_estimate(F.repeat(F.lit("w "), F.col("id").cast("int"))).alias("t"))
    assert all(r.t == max(1, int(r.n * 1.15)) for r in df.collect())


def test_sections(spark):
    text = "Title line\n\n1. Introduction\nFirst text.\nINTRODUCTION,\n\nMethods\nSecond text.\n\nDiscussion and Conclusion\n" + "A" * 60 + ".\n\n" + "B" * 60 + "."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "no heading here"), (4, "")], "doc_id long, text string")
    got = rows(sections.sections(docs).select("doc_id", "block", "half", "label"))
    assert got == [(1, 0, 0, "unknown"), (1, 1, 0, "introduction"), (1, 2, 0, "methodology"), (1, 3, 0, "discussion"), (1, 3, 1, "conclusion"), (3, 0, 0, "unknown")]
    merged = rows(sections.merged_sections(sections.sections(docs)).select("doc_id", "label"))
    assert (1, "conclusion") in merged and len(merged) == 6
    assert one(spark, sections.reclassified(F.col("t"), F.col("h")), t="[1] A\n[2] B\n[3] C\n[4] D", h="x") == "references"
    assert one(spark, sections.reclassified(F.col("t"), F.col("h")), t=None, h=None) == "unknown"


def test_filters(spark):
    assert one(spark, filters.usable(F.col("t")), t="w " * 300) is True and one(spark, filters.usable(F.col("t")), t="w " * 299) is False
    assert one(spark, filters.usable(F.col("t")), t="Access denied " + "w " * 400) is False and one(spark, filters.usable(F.col("t")), t=None) is False
    assert one(spark, filters.has_abstract(F.col("t")), t="No abstract available.") is False and one(spark, filters.has_abstract(F.col("t")), t="one two three four five") is True
    assert one(spark, filters.coverage(F.col("f"), F.col("a")), f="w " * 700, a=None) == "full_paper" and one(spark, filters.coverage(F.col("f"), F.col("a")), f=None, a=None) == "unavailable"
    assert one(spark, filters.verbatim(F.col("s"), F.col("t")), s="a  b\nc", t="a b c") is True and one(spark, filters.verbatim(F.col("s"), F.col("t")), s=None, t="a") is False
    text, name = filters.best_text([("x", F.col("a")), ("y", F.col("b"))], 3)
    assert one(spark, name, a="one", b="one two three") == "y"


def test_lookup(spark):
    assert one(spark, lookup.hits(F.col("t"), ["ai", "Index"], "word"), t="He said: index, AI") == 2
    assert one(spark, lookup.hits(F.col("t"), ["ai"], "word"), t="He said") == 0 and one(spark, lookup.hits(F.col("t"), ["ai"]), t="He said") == 1
    assert one(spark, lookup.hits(F.col("t"), ["deep index", "x"], "word"), t="a deep index") == 1
    assert one(spark, lookup.matched(F.col("t"), ["B", "a", "b"], "word"), t="a b") == ["b", "a"]
    assert one(spark, lookup.first_rule(F.col("t"), (("b", "1"), ("a", "2"))), t="AB") == "1" and one(spark, lookup.first_rule(F.col("t"), (("b", "1"),)), t="x") is None


def verdict_of(spark, topic, **paper):
    from corpuswright.topics import literature_topic

    df = spark.createDataFrame([(paper.get("title"), paper.get("abstract"), paper.get("full_text"))], "title string, abstract string, full_text string")
    return gates.paper_fields(df, full_text="full_text").select(gates.paper_gate(literature_topic(topic)).alias("g")).first().g


def test_paper_gate_by_kind(spark):
    agents = "Multi agents in Artificial Intelligience"
    g = verdict_of(spark, agents, title="Cooperative multi-agent reinforcement learning", abstract="We study neural policies.")
    assert g.passed and g.level == "DIRECT_MATCH"
    g = verdict_of(spark, agents, title="Planning at scale", abstract="Distributed agents share a neural network for machine learning.")
    assert g.passed and g.level == "STRONG_RELATED"
    assert verdict_of(spark, agents, title="Sanctions on Iran and markets", abstract="political economy").reason == "excluded: sanctions on iran"
    assert verdict_of(spark, agents, title="Deep Q-learning", abstract="An ai method without multi-agent interaction").reason == "single-agent reinforcement learning"
    assert verdict_of(spark, agents, title="Packet routing", abstract="ai for networks").reason == "network routing"
    assert verdict_of(spark, agents, title="Explainable artificial intelligence", abstract="ai").reason == "generic explanation"
    assert verdict_of(spark, agents, title="Bees", abstract="honey").reason == "no domain"
    assert verdict_of(spark, "agentic planning", title="A tool", abstract="An llm agent plans").passed and not verdict_of(spark, "agentic planning", title="A tool", abstract="ai only").passed
    assert verdict_of(spark, "deepfake audio", title="Voice cloning", abstract="synthetic speech").passed and verdict_of(spark, "deepfake audio", title="Hearing aid", abstract="audio").reason == "excluded: hearing aid"
    assert verdict_of(spark, "deepfake audio", title="Loud sound", abstract=None).reason == "no core concept"
    assert verdict_of(spark, "mri segmentation", title="Organ contouring", abstract="in patient scans").passed and verdict_of(spark, "mri segmentation", title="Brain scan", abstract="").reason == "no mechanism"
    assert verdict_of(spark, "glacier melt rates", title="Glacier", abstract=None).passed and not verdict_of(spark, "glacier melt rates", title=None, abstract=None).passed
    assert verdict_of(spark, "deepfake audio", title="x", abstract="y", full_text="z" * 4990 + " voice of fake speakers").reason == "no core concept"


def test_patent_gate_and_scores(spark):
    from corpuswright.topics import patent_topic

    def judge(topic, title=None, abstract=None, claims=None, description=None):
        df = spark.createDataFrame([(title, abstract, claims, description)], "title string, abstract string, claims string, description string")
        t = patent_topic(topic)
        r = gates.patent_fields(df).select(gates.patent_gate(t).alias("g"), scores.patent_score(t, gates.patent_gate(t)).alias("s")).first()
        return r.g.level, r.g.coverage, r.s

    assert judge("multi-agent systems", "Multi-agent orchestration", "ai agents plan by machine learning")[:2] == ("DIRECT_MATCH", 1.0)
    assert judge("multi-agent systems", "Assistant", "An ai agent answers")[:2] == ("ADJACENT", 0.5)
    assert judge("multi-agent systems", "Cleaning agent", "A chemical agent")[0] == "REJECTED" and judge("multi-agent systems", "Lawn mower", "autonomous")[0] == "REJECTED"
    assert judge("deepfake audio", "Detecting synthetic speech", "")[0] == "DIRECT_MATCH" and judge("deepfake audio", "Sound level meter", "audio")[0] == "ADJACENT"
    assert judge("deepfake audio", "Face swap detection", "")[0] == "REJECTED"
    assert judge("ct scan segmentation", "Tumor segmentation", "in a scan volume")[0] == "DIRECT_MATCH" and judge("ct scan segmentation", "Patient imaging", "")[0] == "ADJACENT"
    assert judge("glacier melt sensor", "Glacier melt sensor") == ("DIRECT_MATCH", 1.0, 90) and judge("glacier melt sensor", "melt", None, None, "nothing")[0] == "STRONG_RELATED"
    assert judge("glacier melt sensor", None)[0] == "REJECTED" and judge("glacier melt sensor", None)[2] == 0
    assert one(spark, gates.general_gate(F.col("t"), ["a", "b", "c"]), t="a") == "STRONG"
    assert one(spark, scores.technical_score(F.col("t")), t=None) == 0.0 and one(spark, scores.technical_score(F.col("t")), t="accuracy of 91%") == pytest.approx(0.5)


def test_topics(spark):
    from corpuswright import topics

    for raw, name in (("Multi agents in Intelligience Artificial", "Multi-agent artificial intelligence"), ("multiagent reinfocement learning", "Multi-agent reinforcement learning"), ("deep-fak voice", "Deepfake audio detection"),
                      ("segmetation by neural nets", "Medical image segmentation using deep learning"), (" Melt rates ", "Melt rates"), (None, "")):
        assert topics.normalise_topic(raw) == name and one(spark, topics.normalised(F.col("t")), t=raw) == name
        found = topics.searches(raw or "")
        got = one(spark, topics.search_strings(topics.normalised(F.col("t")), topics.topic_kind(topics.normalised(F.col("t")))), t=raw)
        assert got == found and len(found) <= 10 and all(len(q.split()) > 1 for q in found[1:])
    assert topics.expansions("financial model drift")[:2] == ["financial model drift", "financial forecasting model"] and len(topics.expansions("agentic planning of tasks")) == 8
    assert topics.expansions("x") == ["x"]


def test_live_sentences(spark):
    got = one(spark, tx.live_sentences(F.col("t")), t="Dr. J. K. Smith et al. saw 3.5 kg. It fell. and so on. 95% CI was 1.2 (p < 0.05). ok. Done!")
    assert got == ["Dr. J. K. Smith et al. saw 3.5 kg.", "It fell. and so on.", "95% CI was 1.2 (p < 0.05). ok.", "Done!"]
    assert one(spark, tx.live_sentences(F.col("t")), t=None) == [] and one(spark, tx.live_sentences(F.col("t")), t="  ") == []


def test_distributed_rank(spark):
    rnd = random.Random(1)
    data = [(rnd.choice("aab"), rnd.randrange(50), i) for i in range(300)] + [(None, 1, 1000), (None, 0, 1001)]
    df = spark.createDataFrame(data, "g string, v int, i int")
    got = {r.i: r.rank for r in ranking.distributed_rank(df, ["g"], ["v", "i"]).where("g is not null").collect()}
    for g in "ab":
        for k, (_, _, i) in enumerate(sorted(x for x in data if x[0] == g), 1):
            assert got[i] == k
    assert ranking.distributed_rank(df.where("false"), ["g"], ["v"]).count() == 0


def test_sampled_positions(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), F.col("id").alias("i")).unionByName(spark.range(20).select(F.lit("h").alias("g"), F.col("id").alias("i")))
    got = scores.sampled(df, ["g"], ["i"], 150).collect()
    assert sorted(r.i for r in got if r.g == "g") == [int(k * 1000 / 150) for k in range(150)] and sum(r.g == "h" for r in got) == 20


def test_graph_rank_small_groups(spark):
    df = spark.createDataFrame([("p", 1, "alpha beta gamma"), ("p", 2, "alpha beta delta"), ("p", 3, "omega"), ("q", 4, "alone"), ("r", 5, None)], "g string, i long, t string")
    got = {r.i: r.score for r in scores.graph_rank(df, ["g"], "i", F.col("t"), ["i"]).collect()}
    assert got[4] == got[5] == 1.0 and got[1] == pytest.approx(got[2]) and got[3] == pytest.approx(0.05)
    assert 0 < got[3] < got[1] <= 1


def test_keep_first_and_merges(spark):
    df = spark.createDataFrame([(3, "A b", "x"), (1, "a-B", "y"), (2, None, "z")], "record_id long, title string, source string")
    got = {r.key: (r.n, r["first"].record_id) for r in dedup.keep_first(df, tx.title_key(F.col("title")), "record_id").collect()}
    assert got == {"ab": (2, 1), "": (1, 2)}
    again = dedup.keep_first(df.where("record_id = 1"), tx.title_key(F.col("title")), "record_id").collect()
    assert [r.n for r in again] == [1]


def fold_reference(data):
    """Plain statement of the two-key merge in order of arrival."""
    groups, by_id, by_title = {}, {}, {}
    for seq, pid, title in sorted(data):
        p = "".join(c for c in (pid or "") if c.isalnum()).upper()
        t = "".join(c for c in (title or "").lower() if c.isascii() and c.isalnum())
        g = by_id.get(p) if p else None
        if g is None and t:
            g = by_title.get(t)
        if g is None:
            if not p and not t:
                continue
            g = seq
            by_id[p or t] = g
            if t:
                by_title[t] = g
        groups.setdefault(g, []).append(seq)
    return sorted((g, len(v)) for g, v in groups.items())


def test_merge_two_keys_equals_ordered_fold(spark):
    rnd = random.Random(2)
    for _ in range(3):
        data = [(i, rnd.choice([None, "", *[f"US100000{k}A1" for k in range(6)]]), rnd.choice([None, "-", *[f"title {k}" for k in range(5)]])) for i in range(40)]
        df = spark.createDataFrame([(i, p, None, t, "s") for i, p, t in data], "record_id long, patent_id string, publication_number string, title string, source string")
        got = rows(dedup.merge_two_keys(df, "record_id", ["title"]).select("group_seq", "rows"))
        assert got == sorted(fold_reference(data), key=repr)


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(1000, 1080)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = sorted((x, find(x)) for x in {v for e in edges if e[0] != e[1] for v in e})
    assert sorted(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())) == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_skew_join(spark):
    many = spark.createDataFrame([(1, i) for i in range(90)] + [(k, 0) for k in range(2, 12)] + [(None, 1)], "k int, v int")
    one_ = many.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).withColumn("w", F.col("k") * 10)
    got = skew_join(many, one_, ["k"], "n", 100, 3)
    assert got.count() == 100 and "n" not in got.columns


def test_similar_classes_against_brute_force(spark):
    rnd = random.Random(4)
    data = [(rnd.choice("pq"), i, " ".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(0, 9)))) for i in range(80)]
    df = spark.createDataFrame([*data, ("p", 900, None), (None, 901, "a b")], "g string, i long, t string")
    _, links = similar.similar_classes(df, "g", "i", "t", 0.7)
    cls = {}
    for g, i, t in data:
        if t:
            cls.setdefault((g, frozenset(t.split())), i)
    items = list(cls.items())
    want = sorted((g, min(i, j), max(i, j)) for k, ((g, x), i) in enumerate(items) for (h, y), j in items[:k] if g == h and len(x & y) >= 0.7 * len(x | y))
    assert sorted((r.group_key, r.a, r.b) for r in links.collect()) == want and want


def test_budgeted_properties(spark):
    rnd = random.Random(5)
    secs = ["introduction", "methodology", "results", "references"]
    data = [(i, f"P{i % 3}", rnd.choice(secs), " ".join(f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(5, 25))), rnd.random()) for i in range(300)]
    df = spark.createDataFrame([*data, (900, None, "results", "x", 1.0), (901, "P0", "results", None, 1.0)], "row_id long, paper_id string, section string, text string, composite double")
    got = compress.budgeted(df).collect()
    used, total = {}, {}
    for i, p, s, t, _ in data:
        if s != "references":
            total[p] = total.get(p, 0) + max(1, int(len(t.split()) * 1.15))
    for r in got:
        used[r.paper] = used.get(r.paper, 0) + r.tokens
    kept = {r.seq for r in got}
    assert len(kept) == len(got) and not any(data[i][2] == "references" for i in kept)
    assert all(0.65 <= used[p] / total[p] <= 0.76 for p in total)


def test_budgeted_maxima_and_reasons(spark):
    """Each section stops at its own maximum; every sentence kept says why."""
    data = [(s * 10_000 + i, "P", name, f"w{s}x{i} a{s}x{i} b{s}x{i}", 1.0 - i * 1e-5) for s, (name, n) in enumerate((("abstract", 120), ("introduction", 1100), ("results", 2100), ("odd", 2100))) for i in range(n)]
    df = spark.createDataFrame(data, "row_id long, paper_id string, section string, text string, composite double")
    got = compress.budgeted(df, floor=1.0, goal=1.0, ceiling=1.0).collect()
    n = {}
    for r in got:
        n[r.seq // 10_000] = n.get(r.seq // 10_000, 0) + 1
    assert n == {0: 50, 1: 1000, 2: 2000, 3: 2000}
    data = [(1, "plain one", 0.9, 9.0), (2, "cuts latency by 40 %", 0.9, 5.0), (3, "plain two", 0.9, 4.0), (4, "cuts energy by 50 %", 0.0, 3.0), (5, "plain three", None, 2.0)]
    df = spark.createDataFrame([(i, "P", "abstract", t, c, r) for i, t, r, c in data], "row_id long, paper_id string, section string, text string, composite double, r double")
    got = {r.seq: r.reason for r in compress.budgeted(df, floor=1.0, goal=1.0, ceiling=1.0, rank="r").collect()}
    assert got == {1: "min_coverage", 2: "textrank+technical", 3: "textrank", 4: "technical", 5: "budget_fill"}


def test_provenance_id(spark):
    df = spark.createDataFrame([("P1", "results", 3), ("P1", "x", 120), (None, "abc", 1)], "p string, s string, i int")
    assert [r.x for r in df.select(compress.provenance_id(F.col("p"), F.col("s"), F.col("i")).alias("x")).collect()][:2] == ["P1-RESU-03", "P1-XXXX-120"]


def test_leader_clusters_and_evidence(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta gamma"), (3, "omega psi")], "i long, t string")
    got = dict(analysis.leader_clusters(scores.document_weights(df, "i", "t"), "i").collect())
    assert got == {1: 1, 2: 1, 3: 3}
    # blocks of any size give what one pass gives
    rnd = random.Random(4)
    many = spark.createDataFrame([(i, " ".join(rnd.choice("alpha beta gamma delta omega sigma kappa lambda theta".split()) for _ in range(3))) for i in range(60)], "i long, t string")
    w = scores.document_weights(many, "i", "t")
    assert rows(analysis.leader_clusters(w, "i", 0.5)) == rows(analysis.leader_clusters(w, "i", 0.5, block=7))
    assert analysis.leader_clusters(w.where("false"), "i").count() == 0


def test_gap_evidence(spark):
    from corpuswright.operators import gaps

    papers = spark.createDataFrame([("a", 1, "Fine. However this abstract falls short of the mark.", True), ("b", 2, None, True), ("c", 3, "No abstract.", False), ("d", 4, "However it is short of all marks here.", True)], "paper_id string, record_id int, abstract string, eligible boolean")
    said = spark.createDataFrame([("a", "results", "However R.", "a-RESU-02", 2, 2), ("a", "discussion", "It is limited.", "a-DISC-09", 9, 3), ("b", "introduction", "However.", "b-INTR-01", 1, 4)], "paper_id string, section string, text string, sentence_id string, original_index int, row_id long")
    texts = spark.createDataFrame([("b", 1, "Short. " + "x" * 200 + ". The second part lacks a proof of any kind. More."), ("c", 2, None)], "paper_id string, section_id int, text string")
    found = gaps.evidence(papers, said, texts)
    got = {r.paper_id: (r.stage, r.section, r.sentence_id, r.evidence) for r in found.collect()}
    assert got == {"a": (1, "discussion", "a-DISC-09", "It is limited."), "b": (2, "limitations", "b-LIM-01", "The second part lacks a proof of any kind"), "c": (None,) * 4, "d": (3, "abstract", "d-ABS-01", "However it is short of all marks here")}
    g = {r.gap_id: (r.paper_id, r.severity, r.stage, r.reference) for r in gaps.gap_records(papers, found, "record_id").collect()}
    assert g["GAP-01"] == ("a", "Critical", 1, "a | discussion | a-DISC-09 | It is limited.") and g["GAP-03"][:2] == ("d", "Low") and g["GAP-04"] == ("c", "Low", None, None)


def test_cyclic(spark):
    assert [r.x for r in spark.range(1, 5).select(analysis.cyclic(("a", "b", "c"), F.col("id")).alias("x")).collect()] == ["a", "b", "c", "a"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
    assert analysis.lcs_length(a, b) == table[-1][-1]


def test_rouge(spark):
    df = spark.createDataFrame([(1, "the cat sat", "the cat ran"), (2, None, "x"), (3, "a", "a")], "k long, c string, r string")
    assert {r.k: round(r.f1, 4) for r in analysis.rouge_n(df, "k", "c", "r", 1).collect()} == {1: 0.6667, 2: 0.0, 3: 1.0}
    assert {r.k: (r.lcs, round(r.f1, 4)) for r in analysis.rouge_l(df, "k", "c", "r").collect()} == {1: (2, 0.6667), 2: (0, 0.0), 3: (1, 1.0)}


def test_status_rollup(spark):
    def overall(*states):
        df = spark.createDataFrame([(s,) for s in states], "status string")
        return analysis.status_rollup(df, "status", F.col("status") == "SUCCESS").first().overall

    assert overall("SUCCESS", "SUCCESS") == "SUCCESS" and overall("SUCCESS", "NO_RESULTS") == "PARTIAL_SUCCESS"
    assert overall("SKIPPED_NO_CREDENTIALS") == "SKIPPED_NO_CREDENTIALS" and overall("RATE_LIMITED", "SOURCE_UNAVAILABLE") == "SOURCE_UNAVAILABLE" and overall("NO_RESULTS") == "NO_RESULTS"


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i long, k string")
    build = spark.createDataFrame([(1, "a", "old"), (2, "a", "new")], "s long, k string, v string")
    assert rows(joins.last_wins(left, build, "k", "s", ["v"]).select("i", "build_v")) == [(1, "new"), (2, None), (3, None)]
    assert rows(joins.positional(left.select("i"), build.select("s"), "i", "s").select("i", "s")) == [(1, 1), (2, 2), (3, None)]
    vec = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "id long, v array<double>")
    got = rows(joins.nearest(vec, "id", "v", 50, 2).select("q", "id", "rank"))
    assert got == [(0, 1, 1), (0, 2, 2)]


def test_connectors(spark, tmp_path):
    bodies = {
        "graph__1.json": json.dumps({"data": [{"title": "T", "year": 2020, "authors": [{"name": "A B"}], "externalIds": {"DOI": "10.1/x"}, "citationCount": 3}]}),
        "office__1.json": json.dumps({"ops:world-patent-data": {"ops:biblio-search": {"ops:search-result": {"ops:publication-reference": {"document-id": {"country": {"$": "EP"}, "doc-number": {"$": "123"}, "kind": {"$": "A1"}}}}}}}),
        "office__2.json": json.dumps({"ops:world-patent-data": {"ops:biblio-search": {"ops:search-result": {"ops:publication-reference": [{"document-id": [{"@document-id-type": "docdb", "country": "XX", "doc-number": "9"}, {"@document-id-type": "epodoc", "country": {"$": "US"}, "doc-number": {"$": "5"}, "kind": {"$": "B2"}}]}, {"document-id": {"country": "US", "doc-number": "6", "kind": "B2"}}]}}}}),
        "feed__1.xml": "<feed><entry><title>On  X</title><published>2021-05-01</published><id>u</id><author><name>N</name></author></entry><entry><title>Y</title><published>bad</published><id>v</id></entry></feed>",
        "works__1.json": json.dumps({"results": [{"title": "W", "publication_year": 2019, "abstract_inverted_index": {"b": [1], "a": [0, 2]}}]}),
        "dead__1.error": "429",
        "none__1.json": "{}",
        "bad__1.json": "{not json",
    }
    for n, b in bodies.items():
        (tmp_path / n).write_text(b)
    spark.dataSource.register(replay.ReplaySource)
    load = lambda c, **o: spark.read.format("replay").option("path", str(tmp_path)).option("connector", c).options(**o).load()
    assert {r.connector: r.status for r in load("").collect()} == {"graph": "SUCCESS", "office": "SUCCESS", "feed": "SUCCESS", "works": "SUCCESS", "dead": "RATE_LIMITED", "none": "NO_RESULTS", "bad": "SUCCESS"}
    assert [r.status for r in load("graph", credentials="no").collect()] == ["SKIPPED_NO_CREDENTIALS"]
    g = payloads.graph_api(load("graph")).first()
    assert (g.title, g.authors, g.doi, g.citations) == ("T", ["A B"], "10.1/x", 3) and payloads.graph_api(load("bad")).count() == 0
    assert rows(payloads.office_search(load("office")).select("patent_id")) == [("EP123A1",), ("US5B2",), ("US6B2",)]
    detail = spark.createDataFrame([("EP123A1", json.dumps({"ops:world-patent-data": {"ops:exchange-documents": {"ops:exchange-document": [{"bibliographic-data": {
        "invention-title": [{"@lang": "de", "$": "Eins"}, {"@lang": "en", "$": "One"}], "parties": {"applicants": {"applicant": {"applicant-name": {"name": {"$": "Acme"}}}}, "inventors": {"inventor": [{"inventor-name": {"name": {"$": "A B"}}}]}},
        "publication-reference": {"document-id": {"date": {"$": "20200102"}}}}}]}, "ops:abstract": {"@lang": "en", "p": [{"$": "Text."}, "More."]}}})), ("US5B2", "{broken")], "patent_id string, payload string")
    office = {r.patent_id: r for r in payloads.office_patents(load("office"), detail).collect()}
    assert (office["EP123A1"].title, office["EP123A1"].abstract, office["EP123A1"].applicant, office["EP123A1"].inventors, office["EP123A1"].publication_date) == ("One", "Text. More.", "Acme", ["A B"], "20200102")
    assert office["US5B2"].title == "" and office["US6B2"].jurisdiction == "US" and office["US6B2"].retrieval_status == "SUCCESS"
    assert rows(payloads.atom_feed(load("feed")).select("title", "year")) == [("On X", 2021), ("Y", None)]
    assert payloads.works_api(load("works")).first().abstract == "a b a"
    assert payloads.boolean_expressions(["large glass method", "x"], "t") == ['SRC:PAT AND ("t")', 'SRC:PAT AND ("large" AND "glass")']


def test_article_xml(spark):
    x = "<article><front><article-meta><abstract><p>Short.</p></abstract></article-meta></front><body><sec><title>1. Intro</title><p>A <i>b</i>.</p><sec><title>1.1 Deep</title><p>C.</p></sec></sec></body></article>"
    df = spark.createDataFrame([(1, x), (2, "<broken"), (3, None)], "k long, x string")
    assert rows(payloads.article_sections(df, "k", "x").select("k", "depth", "title", "chars")) == [(1, 0, "Abstract", 6), (1, 1, "Intro", 4), (1, 2, "Deep", 2)]


def test_stream_equals_batch(spark, tmp_path):
    import datetime as dt

    data = [(i, dt.datetime(2024, 1, 1, i % 5, i % 60), 1, "ab"[i % 2], 1.0, "{}") for i in range(200)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    df = spark.createDataFrame(data + data[:50], schema)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    q = events.hourly(events.event_stream(spark, str(tmp_path / "in"), "10 days")).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("hours")) == rows(events.hourly(df.dropDuplicates(["event_id"])))
    s = events.ingest_texts(spark, str(tmp_path / "in"), schema, lambda b: b.select("event_id").distinct(), str(tmp_path / "out"), str(tmp_path / "cp"))
    s.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("event_id").distinct().count() == 200


def test_core_stands_without_the_llm_package():
    code = "import sys; sys.modules['corpuswright.llm'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('p')]; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0


def test_empty_tables(spark):
    """Operators on empty tables give empty results."""
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sections.sections(docs).count() == 0 and filters.verdicts(docs, sections.sections(docs)).count() == 0
    items = spark.createDataFrame([], "g string, i long, t string")
    assert scores.graph_rank(items, ["g"], "i", F.col("t"), ["i"]).count() == 0 and similar.similar_classes(items, "g", "i", "t", 0.7)[1].count() == 0
    assert scores.term_weights(items, ["g"], "i", "t").count() == 0
    assert joins.nearest(spark.createDataFrame([], "id long, v array<double>"), "id", "v", 50, 2).count() == 0


def test_all_edges_against_brute_force(spark, tmp_path):
    """Every sentence of a section of more than 150 takes part, across blocks."""
    from corpuswright.plans.registry import QUERIES

    rnd = random.Random(3)
    data = [(i, "P", "results" if i < 300 else "abstract", " ".join(f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(3, 9)))) for i in range(340)]
    data += [(900, "Q", "results", "alone here"), (901, "P", "results", "the of"), (902, None, "results", "w1 w2"), (903, "P", "results", None)]
    df = spark.createDataFrame(data, "row_id long, paper_id string, section string, text string")
    df.write.parquet(f"{tmp_path}/extracted_sentences.parquet")
    vectors = {}
    for sec in ("results", "abstract"):
        bags = {i: t.split() if i != 901 else [] for i, p, s, t in data if p == "P" and s == sec and t}
        df_ = {w: sum(w in b for b in bags.values()) for b in bags.values() for w in b}
        for i, b in bags.items():
            vectors[i] = (sec, {w: b.count(w) / len(b) * (math.log((1 + len(bags)) / (1 + df_[w])) + 1) for w in b})
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, (_, v) in vectors.items()}
    want = {(a, b): s for a in vectors for b in vectors if a < b and vectors[a][0] == vectors[b][0] and norm[a] and norm[b]
            and (s := sum(x * vectors[b][1].get(w, 0) for w, x in vectors[a][1].items()) / norm[a] / norm[b]) >= 0.3}
    got = {(r.a, r.b): r.sim for r in QUERIES["q14b_all_edges"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and len(got) > 1000 and all(abs(got[k] - want[k]) < 1e-5 for k in got)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r.x for r in df.select(scores.cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert math.isclose(got[0], 0.8) and got[1] is None


def test_verdicts(spark):
    body = "We measured the thing and it worked well enough. It did so again later. And once more. " * 8
    docs = spark.createDataFrame([(1, None), (2, " "), (3, "Methods\nShort text."), (4, "Introduction\nWe begin.\nMethods\n" + body), (5, "References\n" + body + "\nFunding\nNone."), (6, "word " * 80), (7, "Abstract\n" + body + "\nReferences\nOne.")], "doc_id long, text string")
    got = dict(filters.verdicts(docs, sections.sections(docs)).collect())
    assert got == {1: "reject: empty", 2: "reject: empty", 3: "reject: below minimum", 4: "accept", 5: "reject: no research section", 6: "reject: no discourse", 7: "reject: no research section"}


def test_digests_are_verbatim_and_unique(spark):
    from corpuswright.operators import pipeline

    rnd = random.Random(6)
    text = lambda: "\n".join(h + "\n" + " ".join(f"The w{rnd.randrange(99)} improves w{rnd.randrange(99)} in trial w{rnd.randrange(99)} here." for _ in range(12)) for h in ("Introduction", "Methods", "Results", "References"))
    docs = spark.createDataFrame([(i, text()) for i in range(4)] + [(9, None), (10, "")], "doc_id long, text string")
    got = pipeline.digests(docs).collect()
    source = {r.doc_id: " ".join(r.text.split()) for r in docs.collect() if r.text}
    assert {r.doc_id for r in got} == {0, 1, 2, 3} and len({r.row_id for r in got}) == len(got)
    assert all(r.text in source[r.doc_id] for r in got) and {r.section for r in got} == {"introduction", "methodology", "results"}


def test_rank_keeps_null_keys(spark):
    from corpuswright.operators.ranking import distributed_rank

    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "i int, g string")
    got = sorted((r.i, r.g, r["rank"]) for r in distributed_rank(df, ["g"], ["i"]).collect())
    assert got == [(1, None, 1), (2, None, 2), (3, "a", 1), (4, "a", 2)]


def test_stems(spark):
    """Worked examples of the published rules, and ROUGE of stems."""
    from corpuswright.functions.stem import stem

    pairs = "caresses caress ponies poni ties tie cats cat agreed agre plastered plaster motoring motor conflated conflat hopping hop falling fall filing file happy happi relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal triplicate triplic formalize formal electrical electr hopefulness hope revival reviv allowance allow inference infer adjustable adjust probate probat rate rate cease ceas controlling control roll roll sky sky dying dy"
    words = pairs.split()
    assert {w: stem(w) for w in words[::2]} == dict(zip(words[::2], words[1::2]))
    df = spark.createDataFrame([(1, "Relations hopping", "relational hop test"), (2, None, "x")], "k int, a string, b string")
    assert {r.k: (r.overlap, round(r.f1, 3)) for r in analysis.rouge_n(df, "k", "a", "b", 1, stems=True).collect()} == {1: (2, 0.8), 2: (0, 0.0)}
    assert {r.k: r.lcs for r in analysis.rouge_l(df, "k", "a", "b", stems=True).collect()} == {1: 2, 2: 0}
