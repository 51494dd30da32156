"""Queries on scores, ranks, gates, joins, evaluation and nested formats, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuswright import lexicon as lx
from corpuswright.functions import text as tx
from corpuswright import topics
from corpuswright.operators import analysis, filters, gaps, gates, joins, ranking, scores
from corpuswright.operators.rules import decided_sql, has, number_sql
from corpuswright.plans.text_queries import squeeze, tech_sql
from corpuswright.session import table
from corpuswright.sources import payloads

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


STOPS = ", ".join(f"'{w}'" for w in lx.STOP_WORDS)


CLUSTER = ", ".join(f"'{w}'" for w in lx.CLUSTER_STOPS)


def terms_sql(c: str, least: int = 2, stops: str = STOPS) -> str:
    return rf"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '{tx.TERM}'), lambda w: length(w) >= {least} AND NOT list_contains([{stops}], w))"


@query(f"""WITH t AS (SELECT paper_id, section, row_id, {terms_sql('text')} AS ts FROM extracted_sentences WHERE paper_id IS NOT NULL AND section IS NOT NULL AND text IS NOT NULL),
  n AS (SELECT paper_id, section, count(*) AS n FROM t GROUP BY ALL), f AS (SELECT paper_id, section, row_id, len(ts) AS l, unnest(ts) AS term FROM t),
  tf AS (SELECT paper_id, section, row_id, l, term, count(*) AS c FROM f GROUP BY ALL), df AS (SELECT paper_id, section, term, count(*) AS df FROM tf GROUP BY ALL)
  SELECT row_id, term, w, rank FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY w DESC, term) AS rank FROM (
   SELECT row_id, term, round(c / l::DOUBLE * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE), 6) AS w FROM tf JOIN df USING (paper_id, section, term) JOIN n USING (paper_id, section))) WHERE rank <= 3""")
def q09_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """The three strongest terms of each sentence of a section (a top-k report)."""
    rows = table(spark, d, "extracted_sentences").where("paper_id is not null and section is not null and text is not null")
    w = scores.term_weights(rows, ["paper_id", "section"], "row_id", "text").select("row_id", "term", F.round("w", 6).alias("w"))
    return ranking.top_n(w, ["row_id"], [F.desc("w"), "term"], 3)


def _sample_sql(most: int) -> str:
    return f"""o AS (SELECT paper_id, section, row_id, text, row_number() OVER (PARTITION BY paper_id, section ORDER BY row_id) - 1 AS i, count(*) OVER (PARTITION BY paper_id, section) AS m FROM extracted_sentences WHERE paper_id IS NOT NULL AND section IS NOT NULL AND text IS NOT NULL),
  k AS (SELECT * FROM o WHERE m <= {most} OR i IN (SELECT floor(j * m / {most}.0::DOUBLE) FROM range({most}) r(j)))"""


@query(f"""WITH {_sample_sql(150)}, t AS (SELECT paper_id, section, row_id, {terms_sql('text')} AS ts FROM k),
  n AS (SELECT paper_id, section, count(*) AS n FROM t GROUP BY ALL), f AS (SELECT paper_id, section, row_id, len(ts) AS l, unnest(ts) AS term FROM t),
  tf AS (SELECT paper_id, section, row_id, l, term, count(*) AS c FROM f GROUP BY ALL), df AS (SELECT paper_id, section, term, count(*) AS df FROM tf GROUP BY ALL),
  w AS (SELECT paper_id, section, row_id, term, c / l::DOUBLE * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS w FROM tf JOIN df USING (paper_id, section, term) JOIN n USING (paper_id, section)),
  nm AS (SELECT row_id, sqrt(sum(w * w)) AS nm FROM w GROUP BY row_id),
  p AS (SELECT x.paper_id, x.section, x.row_id AS a, y.row_id AS b, sum(x.w * y.w) AS dot FROM w x JOIN w y ON x.paper_id = y.paper_id AND x.section = y.section AND x.term = y.term AND x.row_id < y.row_id GROUP BY ALL)
  SELECT paper_id, section, a, b, round(dot / (na.nm * nb.nm), 6) AS sim FROM p JOIN nm na ON na.row_id = a JOIN nm nb ON nb.row_id = b WHERE dot / (na.nm * nb.nm) >= 0.3""")
def q14_cosine_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges among at most 150 evenly sampled sentences of each section, as the graph rank takes them."""
    rows = table(spark, d, "extracted_sentences").where("paper_id is not null and section is not null and text is not null").select("paper_id", "section", "row_id", "text")
    chosen = scores.sampled(rows, ["paper_id", "section"], ["row_id"], 150)
    w = scores.term_weights(chosen, ["paper_id", "section"], "row_id", "text")
    return scores.cosine_edges(w, ["paper_id", "section"], "row_id", 0.3).withColumn("sim", F.round("sim", 6))


@query()
def q14b_all_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges among all sentences of each section, whatever its size."""
    rows = table(spark, d, "extracted_sentences").where("paper_id is not null and section is not null and text is not null").select("paper_id", "section", "row_id", "text")
    w = scores.term_weights(rows, ["paper_id", "section"], "row_id", "text")
    return scores.all_cosine_edges(w, ["paper_id", "section"], "row_id", 0.3).withColumn("sim", F.round("sim", 6))


@query(f"""WITH RECURSIVE {_sample_sql(150)}, t AS (SELECT paper_id, section, row_id, {terms_sql('text')} AS ts FROM k),
  n AS (SELECT paper_id, section, count(*) AS n FROM t GROUP BY ALL), f AS (SELECT paper_id, section, row_id, len(ts) AS l, unnest(ts) AS term FROM t),
  tf AS (SELECT paper_id, section, row_id, l, term, count(*) AS c FROM f GROUP BY ALL), df AS (SELECT paper_id, section, term, count(*) AS df FROM tf GROUP BY ALL),
  w AS (SELECT paper_id, section, row_id, term, c / l::DOUBLE * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS w FROM tf JOIN df USING (paper_id, section, term) JOIN n USING (paper_id, section)),
  nm AS (SELECT row_id, sqrt(sum(w * w)) AS nm FROM w GROUP BY row_id),
  p AS (SELECT x.row_id AS a, y.row_id AS b, sum(x.w * y.w) / (any_value(na.nm) * any_value(nb.nm)) AS s FROM w x JOIN w y ON x.paper_id = y.paper_id AND x.section = y.section AND x.term = y.term AND x.row_id <> y.row_id JOIN nm na ON na.row_id = x.row_id JOIN nm nb ON nb.row_id = y.row_id GROUP BY 1, 2),
  o2 AS (SELECT a, sum(s) AS tot FROM p GROUP BY a), e AS (SELECT p.a, p.b, s / tot AS q FROM p JOIN o2 USING (a)),
  r(round, row_id, score) AS (SELECT 0, t.row_id, 1.0::DOUBLE / n FROM t JOIN n USING (paper_id, section)
    UNION ALL SELECT r0.round + 1, t.row_id, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(inflow, 0.0) END FROM (SELECT DISTINCT round FROM r) r0, t JOIN n USING (paper_id, section)
      LEFT JOIN (SELECT e.b, sum(e.q * r.score) AS inflow FROM r JOIN e ON e.a = r.row_id GROUP BY e.b) i ON i.b = t.row_id WHERE r0.round < 25)
  SELECT row_id, round(score, 6) AS score FROM r WHERE round = 25
  UNION ALL SELECT o.row_id, round(1.0::DOUBLE / m, 6) FROM o WHERE o.row_id NOT IN (SELECT row_id FROM k)""")
def q16_graph_rank(spark: SparkSession, d: str) -> DataFrame:
    """M8, M9: rank of every sentence in the similarity graph of its section."""
    rows = table(spark, d, "extracted_sentences").where("paper_id is not null and section is not null and text is not null").select("paper_id", "section", "row_id", "text")
    out = scores.graph_rank(rows, ["paper_id", "section"], "row_id", F.col("text"), ["row_id"])
    return out.select("row_id", F.round("score", 6).alias("score"))


@query("""SELECT row_id, paper_id, section, original_index FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, section ORDER BY coalesce(textrank_score, 0) DESC, row_id) AS r FROM extracted_sentences) WHERE r <= 2""")
def q16b_top_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Top sentences of a section, in reading order."""
    rows = table(spark, d, "extracted_sentences").withColumn("s", F.coalesce("textrank_score", F.lit(0.0)))
    return ranking.top_n(rows, ["paper_id", "section"], [F.desc("s"), "row_id"], 2).select("row_id", "paper_id", "section", "original_index").orderBy("paper_id", "section", "original_index")


# Topics of the gate queries: the three known kinds and a general one.
LITERATURE = {"agents": topics.literature_topic("Multi agents in Artificial Intelligience"), "single": topics.literature_topic("agentic planning"), "speech": topics.literature_topic("deepfake audio detection"), "imaging": topics.literature_topic("medical image segmentation"), "free": topics.literature_topic(lx.TOPIC)}
PATENTS = {"agents": topics.patent_topic("multi-agent systems"), "single": topics.patent_topic("agentic planning"), "speech": topics.patent_topic("deepfake audio detection"), "imaging": topics.patent_topic("medical image segmentation"), "free": topics.patent_topic("speech token pipeline for clinical gait")}
FULL_SQL = "(SELECT p.*, f.full_text FROM papers p LEFT JOIN (SELECT paper_id, arg_max(original_text, row(length(original_text), -section_id)) AS full_text FROM paper_sections WHERE captured_from IN ('xml', 'pdf') AND original_text IS NOT NULL AND paper_id IS NOT NULL GROUP BY paper_id) f USING (paper_id))"


def _papers_with_text(spark: SparkSession, d: str) -> DataFrame:
    """Papers with the longest article text captured for them, as gate fields."""
    texts = table(spark, d, "paper_sections").where("captured_from in ('xml', 'pdf') and original_text is not null and paper_id is not null")
    full = texts.groupBy("paper_id").agg(F.max_by("original_text", F.struct(F.length("original_text"), -F.col("section_id"))).alias("full_text"))
    return gates.paper_fields(table(spark, d, "papers").join(full, "paper_id", "left"), full_text="full_text")


def _gates_sql(topics_: dict, verdicts) -> str:
    return ", ".join(f"{decided_sql(verdicts(t), 'reason')} AS {n}_reason, {decided_sql(verdicts(t), 'level')} AS {n}_level, {decided_sql(verdicts(t), 'coverage')} AS {n}_coverage" for n, t in topics_.items())


def _gated(rows: DataFrame, topics_: dict, gate) -> DataFrame:
    rows = rows.select("record_id", *[gate(t).alias(n) for n, t in topics_.items()])
    return rows.select("record_id", *[F.col(f"{n}.{part}").alias(f"{n}_{part}") for n in topics_ for part in ("reason", "level", "coverage")])


@query(f"SELECT record_id, {_gates_sql(LITERATURE, gates.paper_verdicts)} FROM (SELECT record_id, {gates.PAPER_FIELDS_SQL} FROM {FULL_SQL})")
def q21_paper_gate(spark: SparkSession, d: str) -> DataFrame:
    """Verdict of every paper, its text included, for each kind of topic."""
    return _gated(_papers_with_text(spark, d), LITERATURE, gates.paper_gate)


@query(f"SELECT record_id, {_gates_sql(PATENTS, gates.patent_verdicts)} FROM (SELECT record_id, {gates.PATENT_FIELDS_SQL} FROM patents)")
def q22_patent_gate(spark: SparkSession, d: str) -> DataFrame:
    """Verdict of every patent for each kind of topic, with ADJACENT and coverage."""
    return _gated(gates.patent_fields(table(spark, d, "patents")), PATENTS, gates.patent_gate)


def _score_sql(t: topics.Topic) -> str:
    core, mech, keys = t["core"], t["mechanism"], scores.key_words(t)
    return f"""CASE WHEN {decided_sql(gates.paper_verdicts(t), 'level')} IN ('DIRECT_MATCH', 'STRONG_RELATED') THEN greatest(0.72::DOUBLE, least(0.98::DOUBLE, 0.65::DOUBLE + 0.33::DOUBLE * (0.35::DOUBLE * CASE WHEN {has('title_', core).sql} THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, {number_sql('text_', core)} / {max(1, min(3, len(core)))}.0::DOUBLE) END
  + 0.25::DOUBLE * least(1.0::DOUBLE, {number_sql('text_', mech)} / {max(1, min(2, len(mech)))}.0::DOUBLE) + 0.20::DOUBLE * CASE WHEN {has('text_', lx.OBJECTIVE_CUES).sql} THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END + 0.10::DOUBLE * 0.65::DOUBLE + 0.10::DOUBLE * ({number_sql('text_', keys)} / {max(1, len(keys))}.0::DOUBLE)))) ELSE 0.0::DOUBLE END"""


SCORED = ("speech", "free")
SCORE_FROM = f"(SELECT record_id, paper_id, source, {gates.PAPER_FIELDS_SQL} FROM {FULL_SQL})"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = _papers_with_text(spark, d)
    out = [F.round(scores.paper_score(LITERATURE[n], F.lit(0.65), gates.paper_gate(LITERATURE[n])["passed"]), 3).alias(n) for n in SCORED]
    return rows.select("record_id", "paper_id", "source", *out)


@query(f"SELECT record_id, {', '.join(f'round({_score_sql(LITERATURE[n])}, 3) AS {n}' for n in SCORED)} FROM {SCORE_FROM}")
def q23_paper_score(spark: SparkSession, d: str) -> DataFrame:
    """M1, M1a-M1e: score of every paper for a known and a free topic, 0 where the gate fails."""
    return _scored(spark, d).select("record_id", *SCORED)


@query(f"""SELECT source, rank, n, floor(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY source) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS share FROM (
  SELECT source, CASE WHEN s >= 0.85 THEN 'High' WHEN s >= 0.75 THEN 'Medium' ELSE 'Low' END AS rank, count(*) AS n FROM (SELECT source, round({_score_sql(LITERATURE['speech'])}, 3) AS s FROM {SCORE_FROM}) GROUP BY ALL)""")
def q24_rank_buckets(spark: SparkSession, d: str) -> DataFrame:
    """M2, A1, A2: buckets with percentages; the window runs over the aggregate."""
    rows = _scored(spark, d).groupBy("source", scores.rank_label(F.col("speech")).alias("rank")).agg(F.count("*").alias("n"))
    return rows.withColumn("share", tx.ratio4(F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy("source"))))


def _patent_score_sql(t: topics.Topic) -> str:
    double = [a for g in scores.DOUBLE_GROUPS[t.kind] for a in t[g]]
    points = lambda f: f"({number_sql(f, t['domain'])} + 2 * {number_sql(f, double)})"
    a = f"least(1.0::DOUBLE, {points('abstract_')} / 3.5::DOUBLE)"
    s = f"""((0.3::DOUBLE * least(1.0::DOUBLE, {points('title_')} / 2.5::DOUBLE) + 0.4::DOUBLE * {a} + 0.2::DOUBLE * CASE WHEN claims_ <> '' THEN least(1.0::DOUBLE, {number_sql('claims_', t['domain'])} / 2.5::DOUBLE) ELSE {a} * 0.9::DOUBLE END
      + 0.1::DOUBLE * {decided_sql(gates.patent_verdicts(t), 'coverage')}) / {0.30 + 0.40 + 0.20 + 0.10}::DOUBLE)"""
    level = decided_sql(gates.patent_verdicts(t), "level")
    return f"""CASE {level} WHEN 'DIRECT_MATCH' THEN CAST(round_even(greatest(85.0::DOUBLE, least(98.0::DOUBLE, 85.0::DOUBLE + {s} * 13.0::DOUBLE)), 0) AS INTEGER) WHEN 'STRONG_RELATED' THEN CAST(round_even(greatest(70.0::DOUBLE, least(84.0::DOUBLE, 70.0::DOUBLE + {s} * 14.0::DOUBLE)), 0) AS INTEGER) ELSE 0 END"""


PATENT_SCORES = f"(SELECT record_id, {', '.join(f'{_patent_score_sql(PATENTS[n])} AS {n}' for n in SCORED)} FROM (SELECT record_id, {gates.PATENT_FIELDS_SQL} FROM patents))"


def _patents_scored(spark: SparkSession, d: str) -> DataFrame:
    rows = gates.patent_fields(table(spark, d, "patents").select("record_id", "title", "abstract", "claims", "description"))
    return rows.select("record_id", *[scores.patent_score(PATENTS[n], gates.patent_gate(PATENTS[n])).alias(n) for n in SCORED])


@query(f"SELECT record_id, speech, free, CAST(row_number() OVER (ORDER BY greatest(speech, free) DESC, record_id) AS INTEGER) AS rank FROM {PATENT_SCORES} WHERE greatest(speech, free) >= 70")
def q25_patent_score(spark: SparkSession, d: str) -> DataFrame:
    """Patents that pass their gate with 70 points or more, ranked over the whole table without a single-task sort."""
    rows = _patents_scored(spark, d).withColumn("back", -F.greatest(*SCORED)).where("back <= -70").withColumn("all", F.lit(0))
    return ranking.distributed_rank(rows, ["all"], ["back", "record_id"]).select("record_id", *SCORED, "rank")


@query(f"SELECT record_id, greatest(speech, free) AS score FROM {PATENT_SCORES} WHERE greatest(speech, free) >= 70 ORDER BY score DESC, record_id LIMIT 5")
def q25b_patent_slice(spark: SparkSession, d: str) -> DataFrame:
    """Sort, then the first five (a top-k report; Spark keeps five rows a partition)."""
    rows = _patents_scored(spark, d).select("record_id", F.greatest(*SCORED).alias("score")).where("score >= 70")
    return rows.orderBy(F.desc("score"), "record_id").limit(5)


ABSTRACTS = "coalesce(title, '') || ' ' || coalesce(abstract, '')"


@query(f"""WITH t AS (SELECT record_id, unnest({terms_sql(ABSTRACTS, 3, CLUSTER)}) AS term FROM papers), tf AS (SELECT record_id, term, count(*) AS c FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
  n AS (SELECT count(*) AS n FROM papers) SELECT record_id, term, round(c * ln(1.0::DOUBLE + n::DOUBLE / df), 6) AS w FROM tf JOIN df USING (term), n""")
def q26_document_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the terms of every title and abstract."""
    rows = table(spark, d, "papers").select("record_id", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit(""))).alias("text"))
    return scores.document_weights(rows, "record_id", "text", lx.CLUSTER_STOPS).withColumn("w", F.round("w", 6))


@query()
def q26b_leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Leader clusters of all titles of patents, in order of record."""
    rows = table(spark, d, "patents").select("record_id", "title")
    return analysis.leader_clusters(scores.document_weights(rows, "record_id", "title", lx.CLUSTER_STOPS), "record_id")


CUED = "regexp_matches(lower({c}), '" + "|".join(lx.EVIDENCE_CUES) + "')"
LIMITED = "regexp_matches(lower({c}), '" + "|".join(lx.LIMIT_WORDS) + "')"
STAGES = "list_position([" + ", ".join(f"'{x}'" for x in gaps.STAGE_SECTIONS) + "], section)"
PIECES = "list_filter(list_transform(string_split({c}, '.'), lambda x: trim(x)), lambda x: length(x) > {n} AND " + LIMITED.format(c="x") + " AND NOT contains(lower(x), 'no abstract') AND length(x) < {m})[1]"
EVIDENCE_SQL = f"""p AS (SELECT paper_id, min(record_id) AS record_id, arg_min(abstract, record_id) AS abstract, arg_min(eligible, record_id) AS eligible FROM (SELECT record_id, paper_id, coalesce(abstract, '') AS abstract, CASE WHEN coalesce(access_status, '') <> '' THEN access_status = 'FULL_TEXT_AVAILABLE' ELSE coalesce(coverage_type, 'unavailable') IN ('full_paper', 'partial_paper') END AS eligible FROM papers WHERE paper_id IS NOT NULL) GROUP BY paper_id),
  s AS (SELECT paper_id, arg_min(section, k) AS section, arg_min(coalesce(sentence_id, chr(0)), k) AS sid, arg_min(text, k) AS t FROM (SELECT *, row({STAGES}, coalesce(original_index, -1), row_id) AS k FROM extracted_sentences WHERE selected AND paper_id IS NOT NULL AND {STAGES} > 0 AND {CUED.format(c='text')}) GROUP BY paper_id),
  f AS (SELECT paper_id, arg_min(t, section_id) AS t FROM (SELECT paper_id, section_id, {PIECES.format(c='original_text', n=30, m=300)} AS t FROM paper_sections WHERE captured_from IN ('xml', 'pdf') AND paper_id IS NOT NULL AND length(original_text) > 200) WHERE t IS NOT NULL GROUP BY paper_id),
  e AS (SELECT p.paper_id, CASE WHEN s.t IS NOT NULL THEN 1 WHEN f.t IS NOT NULL THEN 2 WHEN {PIECES.format(c='abstract', n=20, m=1000000000)} IS NOT NULL THEN 3 END AS stage, CASE WHEN s.t IS NOT NULL THEN s.section WHEN f.t IS NOT NULL THEN 'limitations' WHEN {PIECES.format(c='abstract', n=20, m=1000000000)} IS NOT NULL THEN 'abstract' END AS section,
    CASE WHEN s.t IS NOT NULL THEN nullif(s.sid, chr(0)) WHEN f.t IS NOT NULL THEN p.paper_id || '-LIM-01' WHEN {PIECES.format(c='abstract', n=20, m=1000000000)} IS NOT NULL THEN p.paper_id || '-ABS-01' END AS sentence_id, coalesce(s.t, f.t, {PIECES.format(c='abstract', n=20, m=1000000000)}) AS evidence, record_id, eligible
    FROM p LEFT JOIN s USING (paper_id) LEFT JOIN f USING (paper_id))"""


def _evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    papers = table(spark, d, "papers").where("paper_id is not null")
    papers = papers.groupBy("paper_id").agg(F.min_by(F.struct("record_id", F.coalesce("abstract", F.lit("")).alias("abstract"), filters.eligible(F.col("access_status"), F.col("coverage_type")).alias("eligible")), "record_id").alias("p")).select("paper_id", "p.*")
    said = table(spark, d, "extracted_sentences").where("selected and paper_id is not null")
    texts = table(spark, d, "paper_sections").where("captured_from in ('xml', 'pdf') and paper_id is not null").select("paper_id", "section_id", F.col("original_text").alias("text"))
    return papers, gaps.evidence(papers, said, texts)


@query(f"WITH {EVIDENCE_SQL} SELECT paper_id, stage, section, sentence_id, evidence, CASE WHEN sentence_id IS NOT NULL THEN concat_ws(' | ', paper_id, section, sentence_id, left(evidence, 120)) END AS reference FROM e")
def q27_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of each paper's limits by stage, with its reference."""
    found = _evidence(spark, d)[1]
    return found.withColumn("reference", gaps.reference(F.col("paper_id"), F.col("section"), F.col("sentence_id"), F.col("evidence")))


@query(f"""WITH {EVIDENCE_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY (NOT eligible)::INT, record_id) AS position FROM e)
  SELECT 'GAP-' || lpad(position::VARCHAR, greatest(2, length(position::VARCHAR))::INTEGER, '0') AS gap_id, paper_id, CASE WHEN NOT eligible THEN 'Low' ELSE CASE (position - 1) % 3 WHEN 0 THEN 'Critical' WHEN 1 THEN 'Moderate' ELSE 'Low' END END AS severity,
   CASE WHEN eligible THEN stage END AS stage, CASE WHEN eligible THEN sentence_id END AS sentence_id, CASE WHEN eligible AND sentence_id IS NOT NULL THEN concat_ws(' | ', paper_id, section, sentence_id, left(evidence, 120)) END AS reference FROM r""")
def q56_gap_records(spark: SparkSession, d: str) -> DataFrame:
    """One gap record a paper, papers without evidence last and marked."""
    papers, found = _evidence(spark, d)
    return gaps.gap_records(papers, found, "record_id").select("gap_id", "paper_id", "severity", "stage", "sentence_id", "reference")


@query("SELECT severity, count(*) AS n, min(record_id) AS first FROM (SELECT record_id, CASE (row_number() OVER (ORDER BY record_id) - 1) % 3 WHEN 0 THEN 'Critical' WHEN 1 THEN 'Moderate' ELSE 'Low' END AS severity FROM papers) GROUP BY severity")
def q28_cyclic(spark: SparkSession, d: str) -> DataFrame:
    """Cyclic labels by position, counted, in order of severity."""
    rows = ranking.distributed_rank(table(spark, d, "papers").select("record_id").withColumn("all", F.lit(0)), ["all"], ["record_id"])
    rows = rows.select("record_id", analysis.cyclic(lx.SEVERITIES, F.col("rank")).alias("severity"))
    return rows.groupBy("severity").agg(F.count("*").alias("n"), F.min("record_id").alias("first")).orderBy(F.desc(analysis.severity_rank(F.col("severity"))))


@query("""SELECT source, count(*) AS n, round(avg(relevance_score), 6) AS mean, min(relevance_score) AS low, max(relevance_score) AS high, CAST(count_if(relevance_score >= 0.75) AS BIGINT) AS good,
  CASE WHEN avg(relevance_score) >= 0.75 THEN 'pass' WHEN avg(relevance_score) >= 0.5 THEN 'warn' ELSE 'fail' END AS status, count(DISTINCT paper_id) AS papers, coalesce(bool_and(abstract IS NOT NULL), false) AS complete, round(avg((abstract IS NOT NULL)::INT::DOUBLE), 6) AS supported FROM papers GROUP BY source""")
def q29_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates with targets, and the rate of rows with an abstract."""
    m = F.avg("relevance_score")
    return table(spark, d, "papers").groupBy("source").agg(
        F.count("*").alias("n"), F.round(m, 6).alias("mean"), F.min("relevance_score").alias("low"), F.max("relevance_score").alias("high"), F.count_if(F.col("relevance_score") >= 0.75).alias("good"),
        F.when(m >= 0.75, "pass").when(m >= 0.5, "warn").otherwise("fail").alias("status"), F.countDistinct("paper_id").alias("papers"), F.coalesce(F.bool_and(F.col("abstract").isNotNull()), F.lit(False)).alias("complete"), F.round(F.avg(F.col("abstract").isNotNull().cast("double")), 6).alias("supported"))


@query(f"SELECT record_id, md5({squeeze('abstract')}) AS hash, len(list_distinct(string_split({squeeze('abstract')}, ' '))) AS words FROM papers WHERE {squeeze('abstract')} <> ''")
def q30_inverted_index(spark: SparkSession, d: str) -> DataFrame:
    """Abstracts to an inverted index and back; the hash shows that nothing is lost."""
    index = payloads.inverted_index(table(spark, d, "papers"), "record_id", "abstract")
    back = payloads.from_inverted_index(index, "record_id", "index")
    return index.select("record_id", F.size("index").alias("words")).join(back, "record_id").select("record_id", F.md5("text").alias("hash"), "words")


PARAS = r"array_to_string(list_transform(string_split(regexp_replace(coalesce(text, ''), '[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}]', ' ', 'g'), chr(10) || chr(10)), lambda p: trim(regexp_replace(p, '[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))), chr(10) || chr(10))"


@query(f"SELECT doc_id, 0 AS ord, 1 AS depth, 'Text' AS title, length({PARAS})::INTEGER AS chars, md5({PARAS}) AS hash FROM documents UNION ALL SELECT doc_id, 1, 2, 'Inner', 4, md5('deep') FROM documents")
def q31_article_xml(spark: SparkSession, d: str) -> DataFrame:
    """Nested article XML built from each document, parsed to labelled sections."""
    return payloads.article_sections(payloads.as_article_xml(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "xml")


ELIGIBLE = "(CASE WHEN coalesce(access_status, '') <> '' THEN access_status = 'FULL_TEXT_AVAILABLE' ELSE coalesce(coverage_type, 'unavailable') IN ('full_paper', 'partial_paper') END)"


@query(f"""SELECT 'eligible' AS side, count(*) AS n, sum(record_id) AS ids FROM papers p WHERE {ELIGIBLE} AND EXISTS (SELECT 1 FROM paper_sections s WHERE s.paper_id = p.paper_id)
  UNION ALL SELECT 'no text', count(*), sum(record_id) FROM papers p WHERE {ELIGIBLE} AND NOT EXISTS (SELECT 1 FROM paper_sections s WHERE s.paper_id = p.paper_id) UNION ALL SELECT 'not eligible', count(*), sum(record_id) FROM papers WHERE NOT {ELIGIBLE}""")
def q34_split(spark: SparkSession, d: str) -> DataFrame:
    """Complement split by semi and anti join."""
    papers, sections = table(spark, d, "papers").select("record_id", "paper_id", filters.eligible(F.col("access_status"), F.col("coverage_type")).alias("ok")), table(spark, d, "paper_sections").select("paper_id")
    real = papers.where("ok")
    sides = (("eligible", real.join(sections, "paper_id", "left_semi")), ("no text", real.join(sections, "paper_id", "left_anti")), ("not eligible", papers.where("not ok")))
    out = [x.agg(F.count("*").alias("n"), F.sum("record_id").alias("ids")).select(F.lit(k).alias("side"), "n", "ids") for k, x in sides]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(r"""WITH k AS (SELECT *, regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]', '', 'g') AS key FROM papers), b AS (SELECT key, arg_max(doi, record_id) AS doi, max(record_id) AS by_id FROM k WHERE doi IS NOT NULL AND doi <> '' GROUP BY key)
  SELECT k.record_id, coalesce(nullif(k.doi, ''), b.doi) AS doi, b.by_id FROM k LEFT JOIN b ON k.key = b.key AND k.key <> ''""")
def q35_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Last build row of a title key wins; empty keys match nothing."""
    rows = table(spark, d, "papers").select("record_id", "doi", tx.title_key(F.col("title")).alias("key"))
    build = rows.where("doi is not null and doi <> '' and key <> ''")
    out = joins.last_wins(rows, build, "key", "record_id", ["doi"])
    return out.select("record_id", F.coalesce(F.nullif("doi", F.lit("")), "build_doi").alias("doi"), F.col("build_seq").alias("by_id"))


@query("""SELECT a.i::INTEGER AS position, a.record_id, b.patent FROM (SELECT record_id, row_number() OVER (ORDER BY record_id) AS i FROM papers) a LEFT JOIN (SELECT record_id AS patent, row_number() OVER (ORDER BY record_id) AS i FROM patents) b USING (i)""")
def q36_zip(spark: SparkSession, d: str) -> DataFrame:
    """Positional join, null-extended."""
    return joins.positional(table(spark, d, "papers").select("record_id"), table(spark, d, "patents").select(F.col("record_id").alias("patent")), "record_id", "patent")


@query("""WITH q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q, v.vec_id AS id, round(list_dot_product(e, v.embedding::DOUBLE[]) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6) AS sim FROM q, embeddings v WHERE v.vec_id <> q)
  SELECT q, id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS rank FROM s) WHERE rank <= 5""")
def q39_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """M1d: the five nearest of every fiftieth vector among all (search against all rows)."""
    return joins.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", 50, 5)


@query("""WITH s AS (SELECT source, CASE WHEN count(*) < 100 THEN 'NO_RESULTS' WHEN max(n_chars) > 20000 THEN 'RATE_LIMITED' ELSE 'SUCCESS' END AS status FROM documents GROUP BY source),
  c AS (SELECT count(*) AS sources, count_if(status IN ('SOURCE_UNAVAILABLE', 'AUTHENTICATION_FAILED', 'RATE_LIMITED')) AS failed, count_if(status = 'NO_RESULTS') AS empty, count_if(status = 'SKIPPED_NO_CREDENTIALS') AS skipped, coalesce(max((status = 'SUCCESS')::INT), 0) AS relevant FROM s)
  SELECT *, CASE WHEN relevant > 0 AND (failed > 0 OR skipped > 0 OR empty > 0) THEN 'PARTIAL_SUCCESS' WHEN relevant > 0 THEN 'SUCCESS' WHEN sources = skipped THEN 'SKIPPED_NO_CREDENTIALS' WHEN empty = sources - skipped THEN 'NO_RESULTS' WHEN failed = sources - skipped THEN 'SOURCE_UNAVAILABLE' WHEN failed + empty = sources - skipped THEN 'RETRIEVAL_FAILED' ELSE 'NO_RESULTS' END AS overall FROM c""")
def q40_status(spark: SparkSession, d: str) -> DataFrame:
    """Status of each source and the overall one."""
    status = F.when(F.count("*") < 100, "NO_RESULTS").when(F.max("n_chars") > 20000, "RATE_LIMITED").otherwise("SUCCESS")
    rows = table(spark, d, "documents").groupBy("source").agg(status.alias("status"))
    return analysis.status_rollup(rows, "status", F.col("status") == "SUCCESS")


@query("""SELECT source, record_id, relevance_score, CAST(row_number() OVER (PARTITION BY source ORDER BY CASE relevance_rank WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END DESC, relevance_score DESC NULLS LAST, record_id) AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY retrieved_at, record_id) AS r FROM papers) WHERE r <= 20""")
def q41_limit_then_rank(spark: SparkSession, d: str) -> DataFrame:
    """O3, O1: the first 20 arrivals of a source, then ranked (the limit is the feature)."""
    first = ranking.top_n(table(spark, d, "papers"), ["source"], ["retrieved_at", "record_id"], 20, "r")
    order = F.when(F.col("relevance_rank") == "High", 3).when(F.col("relevance_rank") == "Medium", 2).otherwise(1)
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(order), F.desc_nulls_last("relevance_score"), "record_id"))
    return first.select("source", "record_id", "relevance_score", place.alias("place"))


@query("SELECT event_type, k, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL) GROUP BY ALL")
def q42_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON family: keys of a property object."""
    rows = table(spark, d, "events").where("props is not null").select("event_type", F.explode(F.json_object_keys("props")).alias("k"))
    return rows.groupBy("event_type", "k").agg(F.count("*").alias("n"))


def _rouge_sql(n: int) -> str:
    w = rf"regexp_extract_all(lower(coalesce({{c}}, '')), '[\p{{{{L}}}}\p{{{{N}}}}_]+')"
    g = lambda c: f"SELECT record_id, unnest(CASE WHEN len({w.format(c=c)}) >= {n} THEN list_transform(range(1, len({w.format(c=c)}) - {n} + 2), lambda i: array_to_string({w.format(c=c)}[i:i + {n - 1}], ' ')) ELSE [] END) AS g FROM papers"
    return f"""SELECT record_id, sum(least(c, r)) AS overlap, sum(c) AS candidate_grams, sum(r) AS reference_grams, round(2.0::DOUBLE * sum(least(c, r)) / (sum(c) + sum(r)), 6) AS f1 FROM (
      SELECT record_id, g, sum(c) AS c, sum(r) AS r FROM (SELECT record_id, g, 1 AS c, 0 AS r FROM ({g('title')}) UNION ALL SELECT record_id, g, 0, 1 FROM ({g('abstract')})) GROUP BY ALL) GROUP BY record_id"""


@query(_rouge_sql(1).replace("{{", "{").replace("}}", "}"))
def q43_rouge1(spark: SparkSession, d: str) -> DataFrame:
    """ROUGE-1: title against abstract."""
    return analysis.rouge_n(table(spark, d, "papers"), "record_id", "title", "abstract", 1).withColumn("f1", F.round("f1", 6))


@query(_rouge_sql(2).replace("{{", "{").replace("}}", "}"))
def q43b_rouge2(spark: SparkSession, d: str) -> DataFrame:
    """ROUGE-2."""
    return analysis.rouge_n(table(spark, d, "papers"), "record_id", "title", "abstract", 2).withColumn("f1", F.round("f1", 6))


@query()
def q43c_rougel(spark: SparkSession, d: str) -> DataFrame:
    """ROUGE-L by a bit-parallel longest common subsequence."""
    return analysis.rouge_l(table(spark, d, "papers"), "record_id", "title", "abstract").withColumn("f1", F.round("f1", 6))


@query()
def q43d_rouge_stems(spark: SparkSession, d: str) -> DataFrame:
    """ROUGE-1, ROUGE-2 and ROUGE-L of stems: title against abstract."""
    rows = table(spark, d, "papers").select("record_id", "title", "abstract")
    one, two = (analysis.rouge_n(rows, "record_id", "title", "abstract", n, stems=True).select("record_id", F.round("f1", 6).alias(f"rouge{n}")) for n in (1, 2))
    longest = analysis.rouge_l(rows, "record_id", "title", "abstract", stems=True).select("record_id", F.round("f1", 6).alias("rouge_l"))
    return longest.join(one, "record_id", "left").join(two, "record_id", "left").na.fill(0.0)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT DISTINCT event_id, ts, event_type, value FROM events) GROUP BY ALL")
def q44_windowed(spark: SparkSession, d: str) -> DataFrame:
    """Extension: hourly counts of the event stream, the batch form of the streaming plan."""
    from corpuswright.streaming.events import hourly

    return hourly(table(spark, d, "events").dropDuplicates(["event_id"])).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query(f"""SELECT paper_id, text, row_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, row_id) AS rank FROM (SELECT paper_id, row_id, text, round({tech_sql('text')}, 6) AS score FROM extracted_sentences WHERE text IS NOT NULL)) WHERE rank <= 3""")
def q00_flagship(spark: SparkSession, d: str) -> DataFrame:
    """The three most technical sentences of each paper with their identifier."""
    rows = table(spark, d, "extracted_sentences").where("text is not null").select("paper_id", "row_id", "text", F.round(scores.technical_score(F.col("text")), 6).alias("score"))
    return ranking.top_n(rows, ["paper_id"], [F.desc("score"), "row_id"], 3)
