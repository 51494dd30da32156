"""Queries on whole pipelines and report tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright import lexicon as lx
from corpuswright.functions import text as tx
from corpuswright.operators import compress, filters, gates, pipeline, report
from corpuswright.plans import text_queries
from corpuswright.plans.text_queries import hits
from corpuswright.session import table
from corpuswright.sources import fulltext

Q, SQL = {}, {}
METRICS_SQL = text_queries.SQL["q19_metrics"]


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def q47_digests(spark: SparkSession, d: str) -> DataFrame:
    """Section 2.15 end to end: documents to their verbatim digests."""
    return pipeline.digests(table(spark, d, "documents").select("doc_id", "text"))


@query("SELECT 'papers' AS part, count(*) AS n FROM papers UNION ALL SELECT 'patents', count(*) FROM patents UNION ALL SELECT 'sections', count(*) FROM paper_sections")
def q48_cover(spark: SparkSession, d: str) -> DataFrame:
    """R1."""
    return report.cover_counts(papers=table(spark, d, "papers"), patents=table(spark, d, "patents"), sections=table(spark, d, "paper_sections"))


@query("""SELECT source, record_id, CASE WHEN length(t) > 40 THEN left(t, 37) || '...' ELSE t END AS title, CASE WHEN len(authors) > 5 THEN array_to_string(authors[1:5], ', ') || ' et al.' ELSE coalesce(array_to_string(authors, ', '), '') END AS people, rank
  FROM (SELECT *, coalesce(title, '') AS t, row_number() OVER (PARTITION BY source ORDER BY relevance_score DESC NULLS LAST, record_id) AS rank FROM papers) WHERE rank <= 3""")
def q49_deck(spark: SparkSession, d: str) -> DataFrame:
    """R2, K5: best rows of each source, cut to the widths of the grid (a top-k report)."""
    rows = report.deck(table(spark, d, "papers"), "source", "relevance_score", "record_id", 3)
    return rows.select("source", "record_id", report.cut(F.col("title"), 40).alias("title"), report.people(F.col("authors")).alias("people"), "rank")


@query("""SELECT CAST(row_number() OVER (ORDER BY v DESC NULLS LAST, record_id) AS INTEGER) AS place, CASE WHEN length(coalesce(title, '')) > 30 THEN left(title, 27) || '...' ELSE coalesce(title, '') END AS label, v AS value
  FROM (SELECT *, CAST(floor(relevance_score * 100.0::DOUBLE) AS INTEGER) AS v FROM papers) QUALIFY place <= 5""")
def q50_series(spark: SparkSession, d: str) -> DataFrame:
    """Chart series of the five best (a top-k report)."""
    return report.series(table(spark, d, "papers"), "title", F.col("relevance_score") * F.lit(100.0), 5, "record_id")


@query(r"""WITH t AS (SELECT paper_id, captured_from AS place, original_text AS t, length(original_text) AS l FROM paper_sections WHERE paper_id IS NOT NULL AND original_text IS NOT NULL),
  m AS (SELECT DISTINCT paper_id FROM papers), b AS (SELECT paper_id, place, max(len(string_split(trim(regexp_replace(t, '\s+', ' ', 'g')), ' '))) AS w FROM (SELECT *, rank() OVER (PARTITION BY paper_id, place ORDER BY l DESC) AS r FROM t) WHERE r = 1 GROUP BY ALL)
  SELECT m.paper_id, CASE WHEN x.w >= 40 THEN 'xml' WHEN p.w >= 40 THEN 'pdf' END AS found FROM m LEFT JOIN b x ON x.paper_id = m.paper_id AND x.place = 'xml' LEFT JOIN b p ON p.paper_id = m.paper_id AND p.place = 'pdf'""")
def q51_waterfall(spark: SparkSession, d: str) -> DataFrame:
    """First usable text of each paper in the order of places."""
    texts = table(spark, d, "paper_sections").where("paper_id is not null and original_text is not null").select("paper_id", F.col("captured_from").alias("place"), F.col("original_text").alias("text"))
    return fulltext.waterfall(table(spark, d, "papers").select("paper_id").distinct(), "paper_id", texts, ["xml", "pdf"], 40).select("paper_id", "found")


DOIS = "SELECT lower(doi) AS d, min(url) AS u FROM papers WHERE doi IS NOT NULL GROUP BY lower(doi)"


@query(f"SELECT p.record_id, r.u AS resolved_url FROM papers p LEFT JOIN ({DOIS}) r ON r.d = lower(nullif(p.doi, ''))")
def q52_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Addresses by doi from a resolver table."""
    papers = table(spark, d, "papers").select("record_id", "doi", "url")
    return fulltext.resolved(papers, papers).select("record_id", "resolved_url")


FIELD = ("orchard", "glacier", "vineyard")


@query(f"SELECT doc_id, CASE WHEN {hits('text', FIELD, True)} > 0 THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END AS factor, CASE WHEN {hits('text', gates.topic_words(lx.TOPIC, lx.GENERIC_TOPIC_WORDS), True)} >= 3 THEN 'DIRECT' WHEN {hits('text', gates.topic_words(lx.TOPIC, lx.GENERIC_TOPIC_WORDS), True)} >= 1 THEN 'STRONG' ELSE 'REJECTED' END AS level FROM documents")
def q53_domain(spark: SparkSession, d: str) -> DataFrame:
    """F5, L6 and the general gate of F3, F4."""
    words = gates.topic_words(lx.TOPIC, lx.GENERIC_TOPIC_WORDS)
    return table(spark, d, "documents").select("doc_id", filters.domain_factor(F.col("text"), list(FIELD)).alias("factor"), gates.general_gate(F.col("text"), words).alias("level"))


@query(r"""SELECT record_id, md5(trim(regexp_replace(regexp_replace(coalesce(abstract, ''), '[^\x00-\x7F]', '?', 'g'), '\s+', ' ', 'g'))) AS ascii, left(regexp_replace(lower(trim(title)), '[^a-z0-9]+', '_', 'g'), 60) AS slug,
  CASE WHEN regexp_matches(left(publication_date, 4), '^[0-9]{4}$') THEN CAST(left(publication_date, 4) AS INTEGER) END AS year FROM patents""")
def q54_normalised(spark: SparkSession, d: str) -> DataFrame:
    """N4, N15, N16, date functions of 2.13."""
    return table(spark, d, "patents").select("record_id", F.md5(tx.squeeze(tx.ascii_safe(F.coalesce("abstract", F.lit(""))))).alias("ascii"), tx.slug(F.col("title")).alias("slug"), tx.year_of(F.col("publication_date")).alias("year"))


def _cut_sql(c: str, n: int) -> str:
    return f"CASE WHEN length(coalesce({c}, '')) > {n} THEN left(coalesce({c}, ''), {n} - 3) || '...' ELSE coalesce({c}, '') END"


@query(f"SELECT {_cut_sql('record_id::VARCHAR', 20)} AS record_id, {_cut_sql('title', 35)} AS title, {_cut_sql('abstract', 30)} AS abstract, {_cut_sql('source', 25)} AS source, {_cut_sql('coverage_type', 30)} AS coverage_type, {_cut_sql('relevance_rank', 30)} AS relevance_rank FROM papers")
def q58_grid(spark: SparkSession, d: str) -> DataFrame:
    """Comparison grid of all papers, fields cut to their widths."""
    return report.grid(table(spark, d, "papers"), record_id=20, title=35, abstract=30, source=25, coverage_type=30, relevance_rank=30)


DETAILS = {"title": "Title", "abstract": "Abstract", "doi": "Identifier", "coverage_type": "Coverage"}


@query("SELECT record_id, place::INTEGER AS place, label, CASE WHEN content IN ('', 'Not extracted') THEN 'Not available in abstract.' ELSE content END AS content FROM (" + " UNION ALL ".join(f"SELECT record_id, {i + 1} AS place, '{l}' AS label, coalesce({c}, '') AS content FROM papers" for i, (c, l) in enumerate(DETAILS.items())) + ")")
def q58b_details(spark: SparkSession, d: str) -> DataFrame:
    """Labelled details of every paper."""
    return report.details(table(spark, d, "papers"), "record_id", DETAILS)


@query(f"SELECT record_id, {_cut_sql('title', 23)} AS title, coalesce(nullif(trim(applicant), ''), nullif(trim(assignee), ''), 'Unknown') AS holder, CAST(relevance_score AS INTEGER) AS score, CAST(row_number() OVER (ORDER BY relevance_score DESC NULLS LAST, record_id) AS INTEGER) AS rank FROM patents")
def q58c_patent_grid(spark: SparkSession, d: str) -> DataFrame:
    """Patent grid with ranks from a distributed sort."""
    from corpuswright.operators.ranking import distributed_rank

    rows = table(spark, d, "patents").select("record_id", report.cut(F.col("title"), 23).alias("title"), F.coalesce(F.nullif(F.trim("applicant"), F.lit("")), F.nullif(F.trim("assignee"), F.lit("")), F.lit("Unknown")).alias("holder"), F.col("relevance_score").cast("int").alias("score"))
    rows = rows.withColumn("_all", F.lit(0)).withColumn("_back", F.coalesce(-F.col("score"), F.lit(1)))
    return distributed_rank(rows, ["_all"], ["_back", "record_id"]).drop("_all", "_back")


@query(f"SELECT * FROM (SELECT paper_id, tokens, kept_tokens, round_even(reduction_ratio * 100.0::DOUBLE, 1) AS reduction, round_even(section_coverage * 100.0::DOUBLE, 0) AS coverage, CASE WHEN round_even(reduction_ratio * 100.0::DOUBLE, 1) >= 60 THEN 'high' WHEN round_even(reduction_ratio * 100.0::DOUBLE, 1) >= 30 THEN 'medium' ELSE 'low' END AS grade FROM ({METRICS_SQL}) WHERE tokens > 0)")
def q58d_compression_table(spark: SparkSession, d: str) -> DataFrame:
    """Compression table of papers with tokens."""
    return report.compression_table(text_queries.q19_metrics(spark, d), "paper_id")


@query("SELECT relevance_rank AS severity, count(*) AS n FROM papers GROUP BY relevance_rank")
def q58e_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each bucket; buckets without rows do not appear."""
    return report.nonzero_counts(table(spark, d, "papers"), "relevance_rank").withColumnRenamed("relevance_rank", "severity")


@query("SELECT CAST(row_number() OVER (ORDER BY v DESC NULLS LAST, record_id) AS INTEGER) AS place, left(coalesce(patent_id, ''), 30) AS label, v AS value FROM (SELECT *, CAST(relevance_score AS INTEGER) AS v FROM patents WHERE length(coalesce(patent_id, '')) <= 30) QUALIFY place <= 5")
def q58f_patent_series(spark: SparkSession, d: str) -> DataFrame:
    """Chart series of the five best patents (a top-k report)."""
    return report.series(table(spark, d, "patents").where(F.length(F.coalesce("patent_id", F.lit(""))) <= 30), "patent_id", F.col("relevance_score"), 5, "record_id")


@query(f"""SELECT paper_id, tokens, kept_tokens, CASE WHEN coverage_type = 'abstract_only' THEN 'not_evaluated' ELSE 'evaluated' END AS status, CASE WHEN tokens > 500 AND kept_tokens < round_even(0.65::DOUBLE * tokens, 0) THEN CAST(round_even(0.65::DOUBLE * tokens, 0) - kept_tokens AS BIGINT) ELSE 0 END AS shortfall
  FROM ({METRICS_SQL}) LEFT JOIN (SELECT paper_id, arg_min(coalesce(coverage_type, ''), record_id) AS coverage_type FROM papers GROUP BY paper_id) USING (paper_id)""")
def q59_flags(spark: SparkSession, d: str) -> DataFrame:
    """Shortfall and evaluation status of each paper as metrics."""
    cover = table(spark, d, "papers").where("paper_id is not null").groupBy("paper_id").agg(F.min_by(F.coalesce("coverage_type", F.lit("")), "record_id").alias("coverage_type"))
    return compress.with_flags(text_queries.q19_metrics(spark, d), cover, "paper_id").select("paper_id", "tokens", "kept_tokens", "status", "shortfall")


@query("SELECT record_id, concat_ws(chr(10), nullif(title, ''), nullif(CASE WHEN len(authors) > 5 THEN array_to_string(authors[1:5], ', ') || ' et al.' ELSE coalesce(array_to_string(authors, ', '), '') END, ''), year::VARCHAR) AS header FROM papers")
def q59b_headers(spark: SparkSession, d: str) -> DataFrame:
    """K5: head lines of the fact sheets."""
    return compress.fact_sheet_header(table(spark, d, "papers"), "record_id")


@query(f"SELECT source, n, mean FROM (SELECT source, count(*) AS n, round(avg(relevance_score), 6) AS mean FROM papers WHERE source IS NOT NULL GROUP BY source)")
def q60_metrics_file(spark: SparkSession, d: str) -> DataFrame:
    """K1, K2: metrics written as JSON lines in a folder of their own, and read back."""
    import uuid

    from corpuswright.session import shared_dir

    path = f"{shared_dir(spark)}/corpuswright-metrics/{uuid.uuid4().hex}"
    report.write_metrics(table(spark, d, "papers").where("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("relevance_score"), 6).alias("mean")), path)
    return spark.read.schema("source string, n long, mean double").json(path)


@query("SELECT record_id, left(coalesce(title, ''), 300) AS title, substring(coalesce(abstract, ''), 1, 1200) AS abstract, source FROM papers")
def q61_projection(spark: SparkSession, d: str) -> DataFrame:
    """compact projection, long fields cut (the cut is the feature)."""
    return table(spark, d, "papers").select("record_id", F.substring(F.coalesce("title", F.lit("")), 1, 300).alias("title"), F.substring(F.coalesce("abstract", F.lit("")), 1, 1200).alias("abstract"), "source")


PKEY = text_queries.PKEY.format(c="coalesce(nullif(trim(patent_id), ''), publication_number)")


@query(f"""SELECT record_id, 'https://patents.google.com/patent/' || k || '/en' AS open_link, CASE WHEN left(k, 2) = 'US' THEN 'https://ppubs.uspto.gov/pubwebapp/external.html?q=' || k || '&db=USPAT' END AS us_link,
  CASE WHEN left(k, 2) IN ('EP', 'WO', 'DE', 'GB', 'FR', 'CN', 'JP', 'KR', 'CA', 'NL') THEN 'https://worldwide.espacenet.com/patent/search?q=pn%3D' || k END AS office_link, url_encode(coalesce(title, '')) AS quoted FROM (SELECT *, {PKEY} AS k FROM patents) WHERE k <> ''""")
def q62_links(spark: SparkSession, d: str) -> DataFrame:
    """N12, N2, map and url functions: registry links of every patent."""
    key = tx.patent_key(F.coalesce(F.nullif(F.trim("patent_id"), F.lit("")), F.col("publication_number")))
    rows = table(spark, d, "patents").select("record_id", key.alias("k"), "title").where("k <> ''").withColumn("m", tx.registry_links(F.col("k")))
    return rows.select("record_id", F.col("m")["Google Patents"].alias("open_link"), F.try_element_at("m", F.lit("USPTO Public Search")).alias("us_link"), F.try_element_at("m", F.lit("Espacenet")).alias("office_link"), F.replace(F.replace(tx.quoted(F.coalesce("title", F.lit(""))), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")).alias("quoted"))


@query(r"""SELECT record_id, trim(regexp_replace(regexp_replace(replace(replace('<i>' || coalesce(title, '') || '</i>&nbsp;x &amp; y', '&nbsp;', ' '), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain,
  trim(regexp_replace(regexp_replace(coalesce(abstract, ''), '[ \t]+', ' ', 'g'), '\n\s*\n\s*', chr(10) || chr(10), 'g')) AS lines FROM patents""")
def q63_markup(spark: SparkSession, d: str) -> DataFrame:
    """One line without markup; white space with paragraphs kept."""
    marked = F.concat(F.lit("<i>"), F.coalesce("title", F.lit("")), F.lit("</i>&nbsp;x &amp; y"))
    return table(spark, d, "patents").select("record_id", tx.strip_markup(marked).alias("plain"), tx.squeeze_lines(F.coalesce("abstract", F.lit(""))).alias("lines"))


@query(r"""WITH k AS (SELECT record_id, title, regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]', '', 'g') AS key FROM papers) SELECT key, min(record_id) AS first_id, count(*) AS n FROM k WHERE key <> '' AND NOT regexp_matches(lower(trim(title)), '^(unknown|untitled|unknown title|no title|n/a)$') GROUP BY key""")
def q64_known_titles(spark: SparkSession, d: str) -> DataFrame:
    """F8: first row of each title that is neither empty nor a stand-in."""
    from corpuswright.operators import dedup

    rows = table(spark, d, "papers").select("record_id", "title").where("not lower(trim(title)) rlike '^(unknown|untitled|unknown title|no title|n/a)$'")
    return dedup.keep_first(rows, tx.title_key(F.col("title")), "record_id").where("key <> ''").select("key", F.col("first.record_id").alias("first_id"), "n")


@query("""SELECT record_id, source FROM papers p WHERE NOT EXISTS (SELECT 1 FROM (SELECT paper_id FROM paper_sections GROUP BY paper_id HAVING bool_and(coalesce(trim(original_text), '') = '')) b WHERE b.paper_id = p.paper_id)""")
def q65_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose build row flags them are dropped; those without a build row stay."""
    from corpuswright.operators import joins

    empty = table(spark, d, "paper_sections").where("paper_id is not null").groupBy("paper_id").agg(F.bool_and(F.trim(F.coalesce("original_text", F.lit(""))) == "").alias("empty"))
    return joins.kept_of(table(spark, d, "papers").select("record_id", "source", "paper_id"), empty, "paper_id", "empty").select("record_id", "source")
