"""Queries on topics and on services: payloads are built from the tables in each service's form and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright import topics
from corpuswright.functions import text as tx
from corpuswright.plans.text_queries import PKEY
from corpuswright.session import table
from corpuswright.sources import fulltext, payloads

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _contains(c: str, parts) -> str:
    return "regexp_matches(" + c + ", '" + "|".join(parts) + "')"


def _topic_sql() -> str:
    low = "lower(trim(coalesce(title, '')))"
    for wrong, right in topics.SPELLING:
        low = rf"regexp_replace({low}, '\b{wrong}\b', '{right}', 'g')"
    low = rf"regexp_replace({low}, '\bintelligence\s+artificial\b', 'artificial intelligence', 'g')"
    name = "CASE " + " ".join("WHEN " + " AND ".join(_contains("low", p) for p in parts) + f" THEN '{n}'" for parts, n in topics.canonical_names()) + " ELSE trim(coalesce(title, '')) END"
    kind = "CASE " + " ".join(f"WHEN {_contains('lower(name)', parts)} THEN '{k}'" for k, parts in topics.LITERATURE_TRIGGERS) + f" ELSE '{topics.GENERAL}' END"
    stops = ", ".join(f"'{w}'" for w in topics.TOPIC_STOPS)
    words = rf"list_filter(regexp_split_to_array(regexp_replace(lower(name), '[^a-zA-Z0-9\s\-]', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND NOT list_contains([{stops}], w))[1:4]"
    known = " ".join(f"WHEN kind = '{k}' THEN [" + ", ".join(f"'{x}'" for x in strings) + "]" for k, strings in topics.LITERATURE_SEARCHES.items())
    general = "CASE WHEN len(ws) >= 2 THEN [" + ", ".join(f"array_to_string(ws[1:3], ' ') || ' {x}'" for x in topics.GENERAL_SUFFIXES["literature"]) + "] ELSE [] END"
    return f"""WITH a AS (SELECT record_id, title, {low} AS low FROM papers), b AS (SELECT record_id, {name} AS name FROM a), c AS (SELECT *, {kind} AS kind, {words} AS ws FROM b)
      SELECT record_id, name, kind, array_to_string(list_concat(CASE WHEN name <> '' THEN [name] ELSE [] END, list_filter(CASE {known} ELSE {general} END, lambda x: lower(x) <> lower(name)))[1:10], '|') AS searches FROM c"""


@query(_topic_sql())
def q55_topics(spark: SparkSession, d: str) -> DataFrame:
    """Every title as a topic: its normal form, kind and search strings."""
    rows = table(spark, d, "papers").select("record_id", topics.normalised(F.col("title")).alias("name")).withColumn("kind", topics.topic_kind(F.col("name")))
    return rows.select("record_id", "name", "kind", F.array_join(topics.search_strings(F.col("name"), F.col("kind")), "|").alias("searches"))


def _requests(rows: DataFrame, key: str, element: Column, wrap, per: int = 5) -> DataFrame:
    """(request, payload): ``per`` neighbouring rows of ``key`` an answer, elements in order."""
    grouped = rows.select(F.floor(F.col(key) / per).alias("request"), F.col(key).alias("_k"), element.alias("e")).groupBy("request").agg(F.array_sort(F.collect_list(F.struct("_k", "e"))).alias("es"))
    return grouped.select("request", F.to_json(wrap(F.transform("es", lambda x: x["e"]))).alias("payload"))


FIELDS = "coalesce(trim(regexp_replace(title, '\\s+', ' ', 'g')), '')"
TEXT = "(SELECT *, {k} AS k FROM patents WHERE title IS NOT NULL AND NOT regexp_matches(coalesce(title, '') || coalesce(abstract, '') || coalesce(assignee, ''), '[<>&]'))".format(k=PKEY.format(c="coalesce(nullif(trim(patent_id), ''), publication_number)"))
ONE = "(SELECT k, arg_min(coalesce(trim(regexp_replace(title, '\\s+', ' ', 'g')), ''), record_id) AS title, arg_min(coalesce(trim(regexp_replace(abstract, '\\s+', ' ', 'g')), ''), record_id) AS abstract, arg_min(coalesce(trim(regexp_replace(assignee, '\\s+', ' ', 'g')), ''), record_id) AS assignee, arg_min(coalesce(publication_date, ''), record_id) AS day FROM {t} WHERE k <> '' GROUP BY k)".format(t=TEXT)


def _source_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "patents").where("title is not null").where("not concat(title, coalesce(abstract, ''), coalesce(assignee, '')) rlike '[<>&]'")
    return rows.withColumn("k", tx.patent_key(F.coalesce(F.nullif(F.trim("patent_id"), F.lit("")), F.col("publication_number")))).where("k <> ''")


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("patent_id", "title", "abstract", "assignee", "publication_date", "jurisdiction", F.array_join("sources", ",").alias("sources"), "retrieval_status")


OFFICE = "CASE WHEN regexp_matches(left(k, 2), '^[A-Z]{2}$') THEN left(k, 2) ELSE 'US' END"


def _expected(source: str, assignee: str = "assignee", title: str = "title", day: str = "day", office: str = OFFICE, where: str = "true") -> str:
    return f"SELECT k AS patent_id, {title} AS title, abstract, {assignee} AS assignee, {day} AS publication_date, {office} AS jurisdiction, '{source}' AS sources, 'SUCCESS' AS retrieval_status FROM {ONE} WHERE {where}"


@query(_expected("Google Patents", "coalesce(nullif(assignee, ''), 'Patent Holder')", "coalesce(nullif(title, ''), 'Patent ' || k)"))
def q57_clustered(spark: SparkSession, d: str) -> DataFrame:
    """Nested clusters of results, first arrival of each id."""
    element = F.struct(F.concat(F.lit("patent/"), "k", F.lit("/en")).alias("id"), F.struct("title", F.col("abstract").alias("snippet"), "assignee", F.col("publication_date").alias("filing_date")).alias("patent"))
    wrapped = _requests(_source_rows(spark, d), "record_id", element, lambda es: F.struct(F.struct(F.array(F.struct(es.alias("result"))).alias("cluster")).alias("results")))
    return _shown(payloads.clustered_patents(wrapped, enough=None))


@query(_expected("EPO", office="left(k, 2)", where="regexp_matches(k, '^[A-Z]{2}[0-9]+[A-Z][0-9]?$')"))
def q57b_office(spark: SparkSession, d: str) -> DataFrame:
    """Search answers, then one detail answer a document."""
    rows = _source_rows(spark, d).where("k rlike '^[A-Z]{2}[0-9]+[A-Z][0-9]?$'")
    leaf = lambda c: F.struct(c.alias("$"))
    reference = F.struct(F.struct(leaf(F.substring("k", 1, 2)).alias("country"), leaf(F.regexp_extract("k", "^[A-Z]{2}([0-9]+)", 1)).alias("doc-number"), leaf(F.regexp_extract("k", "^[A-Z]{2}[0-9]+(.*)$", 1)).alias("kind")).alias("document-id"))
    search = _requests(rows, "record_id", reference, lambda es: F.struct(F.struct(F.struct(F.struct(es.alias("ops:publication-reference")).alias("ops:search-result")).alias("ops:biblio-search")).alias("ops:world-patent-data")))
    one = rows.groupBy("k").agg(F.min_by(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "abstract", "assignee", "publication_date")]), "record_id").alias("r")).select("k", "r.*")
    biblio = F.struct(
        F.array(F.struct(F.lit("en").alias("@lang"), F.col("title").alias("$"))).alias("invention-title"), F.struct(F.struct(F.struct(F.struct(leaf(F.col("assignee")).alias("name")).alias("applicant-name")).alias("applicant")).alias("applicants")).alias("parties"),
        F.struct(F.struct(leaf(F.col("publication_date")).alias("date")).alias("document-id")).alias("publication-reference"))
    world = F.struct(F.struct(F.struct(biblio.alias("bibliographic-data")).alias("ops:exchange-document")).alias("ops:exchange-documents"), F.struct(F.lit("en").alias("@lang"), F.array(leaf(F.col("abstract"))).alias("p")).alias("ops:abstract"))
    details = one.select(F.col("k").alias("patent_id"), F.to_json(F.struct(world.alias("ops:world-patent-data"))).alias("payload"))
    found = payloads.office_search(search, None).join(payloads.office_details(details), "patent_id", "left").withColumn("publication_number", F.concat("country", "number", "kind")).withColumnRenamed("country", "jurisdiction").withColumnRenamed("place", "_at")
    return _shown(payloads._patent(found.drop("number", "kind"), "EPO", ["_at"], None))


@query(_expected("Lens"))
def q57c_lens(spark: SparkSession, d: str) -> DataFrame:
    """Objects for title and abstract, owners, inventors."""
    text = lambda c: F.struct(F.col(c).alias("text")).alias(c)
    element = F.struct(F.col("record_id").cast("string").alias("lens_id"), F.col("k").alias("publication_number"), text("title"), text("abstract"), F.array(F.struct(F.col("assignee").alias("name"))).alias("owners"), "publication_date")
    return _shown(payloads.lens_patents(_requests(_source_rows(spark, d), "record_id", element, lambda es: F.struct(es.alias("data")))))


@query(_expected("PatentsView", office="'US'", where="left(k, 2) = 'US'"))
def q57d_civic(spark: SparkSession, d: str) -> DataFrame:
    """Granted patents with their organisation."""
    element = F.struct(F.col("k").alias("patent_number"), F.col("title").alias("patent_title"), F.col("abstract").alias("patent_abstract"), F.col("publication_date").alias("patent_date"), F.array(F.struct(F.col("assignee").alias("assignee_organization"))).alias("assignee_organization"))
    return _shown(payloads.civic_patents(_requests(_source_rows(spark, d).where("k like 'US%'"), "record_id", element, lambda es: F.struct(es.alias("patents")))))


@query(_expected("EuropePMC", office="CASE WHEN regexp_matches(left(k, 2), '^[A-Z]{2}$') THEN left(k, 2) ELSE 'WO' END", where="title <> ''"))
def q57e_archive(spark: SparkSession, d: str) -> DataFrame:
    """Results of the archive's search."""
    element = F.struct(F.col("k").alias("id"), "title", F.col("assignee").alias("authorString"), F.col("abstract").alias("abstractText"), F.col("publication_date").alias("pubYear"))
    return _shown(payloads.archive_patents(_requests(_source_rows(spark, d), "record_id", element, lambda es: F.struct(F.struct(es.alias("result")).alias("resultList"))), enough=None))


PAPERS = "(SELECT * FROM papers WHERE NOT regexp_matches(coalesce(title, '') || coalesce(abstract, '') || coalesce(array_to_string(authors, ''), ''), '[<>&]'))"
SQUEEZED = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@query(f"""SELECT 'graph' AS service, title, abstract, year, doi, url, array_to_string(authors, '|') AS authors, citations FROM {PAPERS} UNION ALL
  SELECT 'registry', title, {SQUEEZED.format(c='abstract')}, year, doi, url, array_to_string(authors, '|'), NULL FROM {PAPERS} UNION ALL
  SELECT 'biomedical', title, {SQUEEZED.format(c='abstract')}, CASE WHEN year BETWEEN 1000 AND 9999 THEN year END, doi, 'https://bio-index.example/id/' || record_id, replace(array_to_string(authors, ', '), ', ', '|'), citations FROM {PAPERS} UNION ALL
  SELECT 'journals', title, abstract, CASE WHEN year BETWEEN 1000 AND 9999 THEN year END, doi, url, array_to_string(authors, '|'), NULL FROM {PAPERS}""")
def q66_literature(spark: SparkSession, d: str) -> DataFrame:
    """All papers in the form of four literature services, read back."""
    rows = table(spark, d, "papers").where("not concat(coalesce(title, ''), coalesce(abstract, ''), coalesce(array_join(authors, ''), '')) rlike '[<>&]'")
    named = F.transform("authors", lambda a: F.struct(a.alias("name")))
    graph = F.struct("title", "abstract", "year", "url", F.col("citations").alias("citationCount"), named.alias("authors"), F.struct(F.col("doi").alias("DOI")).alias("externalIds"))
    registry = F.struct(F.array("title").alias("title"), "abstract", F.col("doi").alias("DOI"), F.col("url").alias("URL"), F.transform("authors", lambda a: F.struct(a.alias("given"))).alias("author"), F.struct(F.array(F.array("year")).alias("date-parts")).alias("issued"))
    bio = F.struct("title", F.col("abstract").alias("abstractText"), F.col("year").cast("string").alias("pubYear"), "doi", F.col("record_id").cast("string").alias("id"), F.array_join("authors", ", ").alias("authorString"), F.col("citations").alias("citedByCount"))
    journal = F.struct(F.struct("title", "abstract", F.col("year").cast("string").alias("year"), named.alias("author"), F.array(F.struct(F.lit("doi").alias("type"), F.col("doi").alias("id"))).alias("identifier"), F.array(F.struct(F.lit("fulltext").alias("type"), "url")).alias("link")).alias("bibjson"))
    read = (
        ("graph", payloads.graph_api(_requests(rows, "record_id", graph, lambda es: F.struct(es.alias("data"))))),
        ("registry", payloads.registry_api(_requests(rows, "record_id", registry, lambda es: F.struct(F.struct(es.alias("items")).alias("message"))))),
        ("biomedical", payloads.biomedical_api(_requests(rows, "record_id", bio, lambda es: F.struct(F.struct(es.alias("result")).alias("resultList"))))),
        ("journals", payloads.journal_api(_requests(rows, "record_id", journal, lambda es: F.struct(es.alias("results"))))),
    )
    out = None
    for name, df in read:
        part = df.select(F.lit(name).alias("service"), "title", "abstract", "year", "doi", "url", F.array_join("authors", "|").alias("authors"), "citations")
        out = part if out is None else out.unionByName(part)
    return out


@query(r"SELECT record_id, regexp_extract(url, '(?i)/(?:abs|pdf|html)/([0-9]{4}\.[0-9]{4,5}|[a-z-]+/[0-9]{7})', 1) AS preprint, upper(regexp_extract(url, '(?i)(PMC[0-9]+)', 1)) AS archive FROM (SELECT record_id, coalesce(url, '') || '/abs/' || lpad((record_id % 10000)::VARCHAR, 4, '0') || '.12345v2?x=pmc' || record_id AS url FROM papers)")
def q67_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of preprints and archive articles in addresses."""
    url = F.concat(F.coalesce("url", F.lit("")), F.lit("/abs/"), F.lpad((F.col("record_id") % 10000).cast("string"), 4, "0"), F.lit(".12345v2?x=pmc"), F.col("record_id").cast("string"))
    return table(spark, d, "papers").select("record_id", fulltext.preprint_id(url).alias("preprint"), fulltext.archive_id(url).alias("archive"))
