"""Queries on scans, cleaning, sections, filters and duplicates, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright import lexicon as lx
from corpuswright.functions import text as tx
from corpuswright.operators import compress, dedup, filters, lookup, occurrences, ranking, sections, similar
from corpuswright.operators.rules import literal
from corpuswright.session import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def case_contains(col: str, rules, field: int = 1, other: str = "NULL") -> str:
    return "CASE " + " ".join("WHEN contains(lower(" + col + "), '" + r[0].replace("'", "''") + f"') THEN '{r[field]}'" for r in rules) + f" ELSE {other} END"


def squeeze(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"


def words(c: str) -> str:
    return f"(CASE WHEN {squeeze(c)} = '' THEN 0 ELSE len(string_split({squeeze(c)}, ' ')) END)"


def tokens(c: str) -> str:
    return f"(CASE WHEN {words(c)} = 0 THEN 0 ELSE greatest(1, CAST(floor({words(c)} * 1.15::DOUBLE) AS INTEGER)) END)"


def hits(c: str, anchors, word: bool = False) -> str:
    low = f"lower(coalesce({c}, ''))"
    if word:
        low = rf"(' ' || regexp_replace({low}, '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' ')"
        return "(" + " + ".join(f"contains({low}, ' {a} ')::INT" for a in anchors) + ")"
    return "(" + " + ".join(f"contains({low}, '{a}')::INT" for a in anchors) + ")"


TITLE_KEY = "regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]', '', 'g')"
FOLD4 = lambda x: f"floor(({x}) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE"


@query("""SELECT kind, source, count(*) AS n, sum(length(coalesce(t, ''))) AS chars FROM (
  SELECT 'paper' AS kind, source, title AS t FROM papers UNION ALL SELECT 'patent', source, title FROM patents UNION ALL SELECT 'document', source, text FROM documents) GROUP BY ALL""")
def q01_union(spark: SparkSession, d: str) -> DataFrame:
    """Union of connectors by name, missing columns allowed."""
    parts = [table(spark, d, t).select(F.lit(k).alias("kind"), "source", F.col(c).alias("t")) for k, t, c in (("paper", "papers", "title"), ("patent", "patents", "title"), ("document", "documents", "text"))]
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return rows.groupBy("kind", "source").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("t", F.lit("")))).alias("chars"))


@query(f"""SELECT md5(k) AS key, count(*) AS n, min(record_id) AS first_id, arg_min(source, record_id) AS first_source FROM (SELECT *, {TITLE_KEY} AS k FROM papers) GROUP BY k""")
def q02_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """First row by title key."""
    rows = dedup.keep_first(table(spark, d, "papers").select("record_id", "title", "source"), tx.title_key(F.col("title")), "record_id")
    return rows.select(F.md5("key").alias("key"), "n", F.col("first.record_id").alias("first_id"), F.col("first.source").alias("first_source"))


@query(f"SELECT doc_id, {words('text')} AS words, {tokens('text')} AS tokens FROM documents")
def q03_words_tokens(spark: SparkSession, d: str) -> DataFrame:
    """N4, N10, N11."""
    return table(spark, d, "documents").select("doc_id", tx.word_count(F.col("text")).alias("words"), tx.token_estimate(F.col("text")).alias("tokens"))


def _page(text: str) -> str:
    return f"'<html><style>a {{b}}</style><nav>menu</nav><!-- x --><div class=\"c\"><p>' || replace({text}, chr(10), '</p><p>') || '</p></div><script>var a = 1;</script>&amp;&nbsp;&lt;end&gt;</html>'"


def _clean_sql() -> str:
    t = _page("original_text")
    t = f"regexp_replace({t}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in tx.NOISE_TAGS:
        t = rf"regexp_replace({t}, '(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?i)</?(?:{'|'.join(tx.BLOCK_TAGS)})(?:\s[^>]*)?/?>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    for name, char in tx.ENTITIES:
        t = "replace(" + t + f", '{name}', '" + char.replace("'", "''") + "')"
    t = rf"regexp_replace({t}, '[ \t]+', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({t}, ' *\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT section_id, length(c) AS chars, md5(c) AS hash, regexp_matches({_page('original_text')}, '<[A-Za-z][^>]{{0,50}}>') AS html FROM (SELECT section_id, original_text, {_clean_sql()} AS c FROM paper_sections WHERE original_text IS NOT NULL)")
def q04_clean_html(spark: SparkSession, d: str) -> DataFrame:
    """Page to text."""
    page = F.concat(F.lit('<html><style>a {b}</style><nav>menu</nav><!-- x --><div class="c"><p>'), F.replace("original_text", F.lit("\n"), F.lit("</p><p>")), F.lit("</p></div><script>var a = 1;</script>&amp;&nbsp;&lt;end&gt;</html>"))
    rows = table(spark, d, "paper_sections").where("original_text is not null").select("section_id", page.alias("html")).withColumn("c", tx.clean_html(F.col("html")))
    return rows.select("section_id", F.length("c").alias("chars"), F.md5("c").alias("hash"), tx.looks_like_html(F.col("html")).alias("html"))


def _heading_sql(x: str) -> str:
    label = f"coalesce({case_contains(f'trim({x})', lx.COMBINED_RULES)}, {case_contains(f'trim({x})', lx.HEADING_RULES)})"
    return rf"""(length(trim({x})) < 100 AND NOT regexp_matches(trim({x}), '[.,]$') AND regexp_matches(trim({x}), '^(?:[0-9]+[.0-9]* +)?[A-Z]') AND regexp_matches(trim({x}), '[a-zA-Z]{{3,}}')
  AND len(regexp_split_to_array(trim({x}), ' +')) <= 12 AND {label} IS NOT NULL)"""


LINES_SQL = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
  h AS (SELECT doc_id, pos, line, {_heading_sql('line')}::INT AS head FROM l),
  b AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM h)"""


@query(f"{LINES_SQL} SELECT doc_id, CAST(block AS INTEGER) AS block, count(*) AS lines, max(CASE WHEN head = 1 THEN trim(line) END) AS heading FROM b GROUP BY doc_id, block")
def q05_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks by a running heading counter."""
    rows = sections.blocks(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return rows.select("doc_id", "block", F.col("lines").cast("long").alias("lines"), "heading")


@query(f"SELECT section_name, coalesce({case_contains('section_name', lx.COMBINED_RULES)}, {case_contains('section_name', lx.HEADING_RULES)}) AS label, {case_contains('section_name', lx.COMBINED_RULES, 2)} AS second, count(*) AS n FROM paper_sections GROUP BY section_name")
def q06_heading_label(spark: SparkSession, d: str) -> DataFrame:
    """First rule wins."""
    rows = table(spark, d, "paper_sections").groupBy("section_name").agg(F.count("*").alias("n"))
    return rows.select("section_name", sections.section_label(F.col("section_name")).alias("label"), sections.second_label(F.col("section_name")).alias("second"), "n")


def _any(c: str, parts) -> str:
    alternatives = "|".join(literal(p) for p in parts).replace("'", "''")
    return f"regexp_matches({c}, '{alternatives}')"


def _class_sql(text: str, heading: str) -> str:
    """Class of an unlabelled block; one expression, so that other queries can use it."""
    lines = f"list_filter(list_transform(string_split(coalesce({text}, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    cited = rf"len(list_filter({lines}, lambda x: regexp_matches(x, '^\[[0-9]+\]|^[0-9]+\.\s+[A-Z]') OR {_any('lower(x)', lx.REFERENCE_MARKS)}))"
    low, prose = f"lower(coalesce({text}, ''))", _any(f"lower(coalesce({text}, ''))", lx.RESEARCH_PROSE)
    return f"""CASE WHEN trim({low}) = '' THEN 'unknown' WHEN {_any(f"lower(coalesce({heading}, ''))", lx.REFERENCE_HEADINGS)} THEN 'references'
   WHEN {cited} >= greatest(4, floor(len({lines}) * 0.6::DOUBLE)) AND NOT {prose} THEN 'references' WHEN {_any(low, lx.FUNDING_PHRASES)} AND len({lines}) <= 8 AND NOT {prose} THEN 'funding'
   WHEN {_any(low, lx.CONFLICT_PHRASES)} AND len({lines}) <= 6 THEN 'conflict_of_interest' WHEN {_any(low, lx.CONTRIBUTION_PHRASES)} AND len({lines}) <= 8 THEN 'author_contributions'
   WHEN {_any(low, lx.THANKS_PHRASES)} AND len({lines}) <= 8 AND NOT {prose} THEN 'acknowledgments' ELSE 'unknown' END"""


@query(f"SELECT section_id, {_class_sql('original_text', 'section_name')} AS class FROM paper_sections")
def q07_reclassify(spark: SparkSession, d: str) -> DataFrame:
    """X4."""
    return table(spark, d, "paper_sections").select("section_id", sections.reclassified(F.col("original_text"), F.col("section_name")).alias("class"))


MARKED = r"string_split(regexp_replace({c}, '([^0-9\s][.!?])\s+(\p{{Lu}})', '\1' || chr(1) || '\2', 'g'), chr(1))"


@query(f"SELECT doc_id, len({MARKED.format(c='text')}) AS sentences, {MARKED.format(c='text')}[1] AS first, len(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: length(x) > 30)) AS pieces FROM documents WHERE text IS NOT NULL")
def q08_split(spark: SparkSession, d: str) -> DataFrame:
    """Portable sentence splitter and the naive one."""
    rows = table(spark, d, "documents").where("text is not null").withColumn("s", tx.mark_sentences(F.col("text")))
    return rows.select("doc_id", F.size("s").alias("sentences"), F.col("s")[0].alias("first"), F.size(tx.period_pieces(F.col("text"))).alias("pieces"))


KEPT_SQL = "trim(coalesce(text, ''))"
for _ in range(2):
    KEPT_SQL = rf"regexp_replace({KEPT_SQL}, '{tx.ABBREVIATION}', '\1\2' || chr(2) || '\3', 'g')"
PARTS_SQL = rf"""string_split(regexp_replace({KEPT_SQL}, '([.!?]["'')\]]*)\s+(["''(\[]?[\p{{Lu}}0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))"""


@query(rf"""WITH p AS (SELECT doc_id, list_filter(list_transform({PARTS_SQL}, lambda x: trim(replace(x, chr(2), '.'))), lambda x: x <> '') AS ps FROM documents),
  u AS (SELECT doc_id, unnest(ps) AS s, generate_subscripts(ps, 1) AS i FROM p), g AS (SELECT *, (i = 1 OR NOT (len(regexp_split_to_array(s, '\s+')) < 3 AND NOT regexp_matches(s, '^\p{{Lu}}') AND NOT regexp_matches(s, '[0-9=><+±%-]')))::INT AS new FROM u),
  n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g), j AS (SELECT doc_id, k, string_agg(s, ' ' ORDER BY i) AS s FROM n GROUP BY doc_id, k)
  SELECT doc_id, count(*) AS sentences, md5(string_agg(s, '|' ORDER BY k)) AS hash FROM j WHERE len(regexp_split_to_array(s, '\s+')) >= 2 OR regexp_matches(s, '[a-zA-Z0-9]') GROUP BY doc_id""")
def q08b_live_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with their fragments merged."""
    rows = table(spark, d, "documents").select("doc_id", tx.live_sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    return rows.select("doc_id", F.size("s").cast("long").alias("sentences"), F.md5(F.array_join("s", "|")).alias("hash"))


def _usable(c: str, least: int = 300) -> str:
    head = f"lower(substring(coalesce({c}, ''), 1, 3000))"
    return f"(CASE WHEN {words(c)} < {least} THEN false WHEN {hits(head, lx.ERROR_PHRASES)} > 0 THEN false WHEN {hits(head, lx.LANDING_PHRASES)} >= 2 AND {words(c)} < 500 THEN false ELSE true END)"


@query(f"SELECT doc_id, {_usable('text', 100)} AS usable FROM documents")
def q10_usable(spark: SparkSession, d: str) -> DataFrame:
    """F1, with a bound that these texts reach."""
    return table(spark, d, "documents").select("doc_id", filters.usable(F.col("text"), 100).alias("usable"))


TOKENS_OF = "(CASE WHEN {w} = 0 THEN 0 ELSE greatest(1, CAST(floor({w} * 1.15::DOUBLE) AS INTEGER)) END)"
LABEL_SQL = f"coalesce({case_contains('heading', lx.COMBINED_RULES)}, {case_contains('heading', lx.HEADING_RULES)}, {_class_sql('body', 'heading')})"
TALK = "(" + " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INT" for w in lx.DISCOURSE) + ")"
WRAP = "len(list_filter(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '), lambda w: list_contains([" + ", ".join(f"'{w}'" for w in lx.WRAPPER_WORDS) + "], regexp_replace(w, '^[.,;:\"''()\\[\\]]+|[.,;:\"''()\\[\\]]+$', '', 'g'))))"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


# the second half of a combined heading counts as part of the first here: no document of the test data has one
@query(f"""{LINES_SQL}, k AS (SELECT doc_id, block, max(CASE WHEN head = 1 THEN trim(line) END) AS heading, {STRIP.format("coalesce(string_agg(CASE WHEN head = 0 THEN line END, chr(10) ORDER BY pos), '')")} AS body FROM b GROUP BY doc_id, block),
  c AS (SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN heading END AS heading, body FROM k WHERE body <> ''), s AS (SELECT doc_id, {LABEL_SQL} AS label, {tokens('body')} AS n FROM c),
  r AS (SELECT doc_id, count_if(label NOT IN ({', '.join(f"'{x}'" for x in (*lx.NON_RESEARCH, 'abstract'))})) AS research, count_if(label NOT IN ({', '.join(f"'{x}'" for x in (*lx.NON_RESEARCH, 'abstract', 'unknown'))})) AS known, count_if(label = 'abstract') AS abstracts,
    sum(CASE WHEN label NOT IN ({', '.join(f"'{x}'" for x in (*lx.NON_RESEARCH, 'abstract'))}) THEN n ELSE 0 END) AS rt FROM s GROUP BY doc_id),
  v AS (SELECT text, {words('text')} AS w, r.* FROM documents LEFT JOIN r USING (doc_id))
  SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'reject: empty' WHEN coalesce(research, 0) = 0 THEN 'reject: no research section' WHEN w < 50 THEN 'reject: below minimum'
   WHEN {WRAP} > 0.4::DOUBLE * w AND w > 500 THEN 'reject: publisher wrapper' WHEN abstracts > 0 AND known = 0 AND rt < 1000 THEN 'reject: abstract and unlabelled text only'
   WHEN known = 0 AND abstracts = 0 AND (len(regexp_extract_all(text, '[a-zA-Z0-9][.!?](?:\\s|$)')) < 3 OR {TALK} < 2) THEN 'reject: no discourse' WHEN {TOKENS_OF.format(w='w')} > 3000 AND rt < 400 THEN 'reject: wrapper' ELSE 'accept' END AS verdict FROM v) GROUP BY verdict""")
def q11_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """F2 with X5: histogram of structural verdicts."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return filters.verdicts(docs, sections.sections(docs)).groupBy("verdict").agg(F.count("*").alias("n"))


def _abstract_ok(c: str) -> str:
    missing = ", ".join(f"'{m}'" for m in lx.NO_ABSTRACT)
    return f"(NOT starts_with(lower(trim(coalesce({c}, ''))), '[') AND rtrim(lower(trim(coalesce({c}, ''))), '.') NOT IN ({missing}) AND {words(c)} >= 5)"


HEAD_SQL = "lower(substring(coalesce(original_text, ''), 1, 3000))"


@query(f"""WITH f AS (SELECT paper_id, sum({words('original_text')}) AS w, max({hits(HEAD_SQL, lx.ERROR_PHRASES)} > 0) AS e, max({hits(HEAD_SQL, lx.LANDING_PHRASES)}) AS l FROM paper_sections WHERE paper_id IS NOT NULL GROUP BY paper_id),
  u AS (SELECT paper_id, w, w >= 60 AND NOT e AND NOT (l >= 2 AND w < 500) AS ok FROM f)
  SELECT record_id, CASE WHEN ok AND w >= 120 THEN 'full_paper' WHEN ok THEN 'partial_paper' WHEN {_abstract_ok('abstract')} THEN 'abstract_only' ELSE 'unavailable' END AS coverage FROM papers LEFT JOIN u USING (paper_id)""")
def q12_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage from the sections that are there, else from the abstract."""
    parts = filters.coverage_of_parts(table(spark, d, "paper_sections").where("paper_id is not null"), "paper_id", "original_text", 120, 60)
    rows = table(spark, d, "papers").select("record_id", "paper_id", "abstract").join(parts, "paper_id", "left")
    cover = F.when(F.col("full"), "full_paper").when(F.col("usable"), "partial_paper").when(filters.has_abstract(F.col("abstract")), "abstract_only").otherwise("unavailable")
    return rows.select("record_id", cover.alias("coverage"))


@query(r"""WITH w AS (SELECT coalesce(paper_id, '') AS g, row_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'))) AS ws FROM extracted_sentences),
  c AS (SELECT g, ws, min(row_id) AS id FROM w WHERE len(ws) > 0 GROUP BY g, ws)
  SELECT x.g AS group_key, x.id AS a, y.id AS b, round(len(list_intersect(x.ws, y.ws)) / (len(x.ws) + len(y.ws) - len(list_intersect(x.ws, y.ws)))::DOUBLE, 6) AS jaccard
  FROM c x JOIN c y ON x.g = y.g AND x.id < y.id WHERE len(list_intersect(x.ws, y.ws)) / (len(x.ws) + len(y.ws) - len(list_intersect(x.ws, y.ws)))::DOUBLE >= 0.7""")
def q13_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Near copies among the sentences of a paper, between classes of equal word sets."""
    rows = table(spark, d, "extracted_sentences").select("paper_id", "row_id", "text")
    return similar.similar_classes(rows, "paper_id", "row_id", "text", 0.7)[1].withColumn("jaccard", F.round("jaccard", 6))


def tech_sql(c: str) -> str:
    wide = f"regexp_replace(lower(coalesce({c}, '')), '{lx.WIDE_LETTERS}', 'x', 'g')"
    total = " + ".join(f"CASE WHEN regexp_matches({wide}, '{p}') THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for p, w in lx.TECHNICAL_RULES)
    return f"least(1.0::DOUBLE, (0.0::DOUBLE + {total}) / 2.0::DOUBLE)"


@query(f"SELECT paper_id, count(*) AS n, count_if(round({tech_sql('text')}, 6) >= 0.25) AS technical, sum(CAST(round(round({tech_sql('text')}, 6) * 1000000.0::DOUBLE) AS BIGINT)) AS millionths FROM extracted_sentences GROUP BY paper_id")
def q15_technical(spark: SparkSession, d: str) -> DataFrame:
    """M4, F11."""
    from corpuswright.operators.scores import technical_score

    rows = table(spark, d, "extracted_sentences").select("paper_id", F.round(technical_score(F.col("text")), 6).alias("s"))
    return rows.groupBy("paper_id").agg(F.count("*").alias("n"), F.count_if(F.col("s") >= 0.25).alias("technical"), F.sum(F.round(F.col("s") * F.lit(1000000.0)).cast("long")).alias("millionths"))


MIN_CASE = "CASE section " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lx.MIN_SENTENCES.items()) + f" ELSE {lx.OTHER_MIN} END"


@query(f"""SELECT paper_id, section, row_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, section ORDER BY coalesce(textrank_score, 0) DESC, row_id) AS rank FROM extracted_sentences)
  WHERE rank <= {MIN_CASE}""")
def q17_minimum_cover(spark: SparkSession, d: str) -> DataFrame:
    """Best sentences of each section up to its minimum."""
    rows = table(spark, d, "extracted_sentences").withColumn("score", F.coalesce("textrank_score", F.lit(0.0)))
    return compress.minimum_cover(rows, "paper_id", "section", "score", ["row_id"]).select("paper_id", "section", "row_id", "rank")


@query()
def q17b_budget(spark: SparkSession, d: str) -> DataFrame:
    """W4, M11, section 2.15: greedy fill of each paper's budget, with reasons."""
    from corpuswright.operators.scores import composite, technical_score

    rows = table(spark, d, "extracted_sentences").select("row_id", "paper_id", F.coalesce("section", F.lit("unknown")).alias("section"), "text", F.coalesce("textrank_score", F.lit(0.0)).alias("r"))
    rows = rows.withColumn("composite", F.round(composite(F.col("r"), technical_score(F.col("text")), F.col("section")), 9))
    return compress.budgeted(rows, rank="r").select(F.col("paper").alias("paper_id"), F.col("seq").alias("row_id"), "reason", "tokens")


SEC4 = "upper(left(rpad(regexp_replace(e.section, '[^A-Za-z]', '', 'g'), 4, 'x'), 4))"


@query(rf"""WITH s AS (SELECT DISTINCT paper_id, original_text FROM paper_sections WHERE original_text IS NOT NULL AND paper_id IS NOT NULL)
  SELECT e.row_id, concat_ws('-', e.paper_id, {SEC4}, lpad(e.original_index::VARCHAR, greatest(2, length(e.original_index::VARCHAR))::INTEGER, '0')) AS prov,
   coalesce(bool_or(contains(s.original_text, e.text) OR contains({squeeze('s.original_text')}, {squeeze('e.text')})), false) AS verbatim
  FROM extracted_sentences e LEFT JOIN s ON s.paper_id = e.paper_id GROUP BY ALL""")
def q18_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Identifier of a sentence and whether its text stands in a section of its paper."""
    prov = compress.provenance_id(F.col("paper_id"), F.col("section"), F.col("original_index"))
    # a text that occurs as it is occurs squeezed as well, so one test does for both; a null or blank one always does, as in the SQL
    e = table(spark, d, "extracted_sentences").select("row_id", prov.alias("prov"), "paper_id", tx.squeeze_plain(F.coalesce("text", F.lit(""))).alias("t"))
    s = table(spark, d, "paper_sections").select("paper_id", tx.squeeze_plain(F.col("original_text")).alias("body"))
    found = occurrences.occurring(e.where("t <> ''"), s, "paper_id", "t", "body").withColumn("ok", F.lit(True))
    return e.join(found, ["paper_id", "t"], "left").groupBy("row_id", "prov").agg(F.bool_or(F.coalesce("ok", F.col("t") == "")).alias("verbatim"))


NONRES = ", ".join(f"'{s}'" for s in lx.NON_RESEARCH)


@query(f"""WITH t AS (SELECT *, {tokens('text')} AS tk, {words('text')} AS wd, section NOT IN ({NONRES}) AS res FROM extracted_sentences WHERE paper_id IS NOT NULL),
  a AS (SELECT paper_id, sum(tk) AS tokens, sum(wd) AS words, count(DISTINCT section) AS sections, count(DISTINCT CASE WHEN res THEN section END) AS research FROM t GROUP BY paper_id),
  b AS (SELECT paper_id, sum(tk) AS kt, count(*) AS k, count(DISTINCT section) AS cov, count(DISTINCT CASE WHEN res THEN section END) AS rcov, sum(coalesce(source_verified::INT, 0)) AS ver FROM t WHERE selected GROUP BY paper_id),
  r AS (SELECT a.*, coalesce(kt, 0) AS kept_tokens, coalesce(k, 0) AS kept_sentences, CASE WHEN tokens > 0 THEN least(1.0::DOUBLE, {FOLD4('coalesce(kt, 0) / tokens::DOUBLE')}) ELSE 0.0::DOUBLE END AS retained_ratio, coalesce(cov, 0) AS cov, coalesce(rcov, 0) AS rcov, coalesce(ver, 0) AS ver
        FROM a LEFT JOIN b USING (paper_id))
  SELECT paper_id, tokens, words, kept_tokens, kept_sentences, retained_ratio, {FOLD4('1.0::DOUBLE - retained_ratio')} AS reduction_ratio, CASE WHEN sections > 0 THEN {FOLD4('cov / sections::DOUBLE')} ELSE 0.0::DOUBLE END AS section_coverage,
   CASE WHEN research > 0 THEN {FOLD4('rcov / research::DOUBLE')} ELSE 0.0::DOUBLE END AS research_coverage, CASE WHEN kept_sentences > 0 THEN {FOLD4('ver / kept_sentences::DOUBLE')} ELSE 1.0::DOUBLE END AS faithfulness FROM r""")
def q19_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Compression metrics of each paper from its sentence table."""
    rows = table(spark, d, "extracted_sentences")
    return compress.compression_metrics(rows.where("selected"), rows, "paper_id", "section", "text")


ORDER_CASE = "CASE section " + " ".join(f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(lx.SECTION_ORDER)) + f" ELSE {len(lx.SECTION_ORDER) + 1} END"


@query(f"""WITH s AS (SELECT paper_id, section, string_agg(text, chr(10) ORDER BY original_index NULLS FIRST, row_id) AS body FROM extracted_sentences WHERE selected AND paper_id IS NOT NULL AND text IS NOT NULL AND section IS NOT NULL GROUP BY paper_id, section)
  SELECT paper_id, md5(sheet) AS hash, length(sheet) AS chars FROM (SELECT paper_id, string_agg('## ' || section || chr(10) || body, chr(10) || chr(10) ORDER BY {ORDER_CASE}, section) AS sheet FROM s GROUP BY paper_id)""")
def q20_fact_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Text of the selected sentences in reading order."""
    rows = compress.fact_sheet_text(table(spark, d, "extracted_sentences").where("selected"), "paper_id", "section", "original_index", "text", "row_id")
    return rows.select("paper_id", F.md5("sheet").alias("hash"), F.length("sheet").alias("chars"))


PKEY = "upper(regexp_replace(regexp_extract(regexp_replace(coalesce({c}, ''), '/[a-z]{{2}}$', ''), '[^/]*$'), '[^A-Za-z0-9]', '', 'g'))"


@query(f"SELECT record_id, key, regexp_matches(key, '^(?:US|EP|WO|CN|JP|KR|DE|FR|GB|CA|AU|IN)[0-9]{{4,}}[A-Z]?[0-9]?$') AS valid, 'https://patents.example/patent/' || key || '/en' AS link FROM (SELECT record_id, {PKEY.format(c='publication_number')} AS key FROM patents)")
def q32_patent_key(spark: SparkSession, d: str) -> DataFrame:
    """N7, N8, N12."""
    rows = table(spark, d, "patents").select("record_id", tx.patent_key(F.col("publication_number")).alias("key"))
    return rows.select("record_id", "key", tx.valid_patent_key(F.col("key")).alias("valid"), tx.patent_url(F.col("key")).alias("link"))


HOSTS = (("journal", "Journal"), ("review", "Review"), ("papers", "Repository"), ("lab", "Laboratory"))


@query(f"SELECT host, label, count(*) AS n FROM (SELECT lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host, CASE {' '.join(f'''WHEN contains(source_url, '{p}') THEN '{l}' ''' for p, l in HOSTS)} ELSE 'Other' END AS label FROM paper_sections) GROUP BY ALL")
def q33_url_label(spark: SparkSession, d: str) -> DataFrame:
    """N13, url functions."""
    rows = table(spark, d, "paper_sections").select(tx.url_host(F.col("source_url")).alias("host"), tx.source_label(F.col("source_url"), HOSTS, "Other").alias("label"))
    return rows.groupBy("host", "label").agg(F.count("*").alias("n"))


MERGE_FIELDS = ("title", "abstract", "claims", "description", "publication_date", "priority_date", "applicant")
REAL = ", ".join(f"'{x}'" for x in dedup.PLACEHOLDERS)


def _first_sql(c: str) -> str:
    plain = f"arg_min({c}, record_id) FILTER (WHERE {c} IS NOT NULL AND trim({c}) <> '')"
    return f"coalesce(arg_min({c}, record_id) FILTER (WHERE {c} IS NOT NULL AND trim({c}) <> '' AND {c} NOT IN ({REAL})), {plain})" if c == "applicant" else plain


@query(f"""SELECT key, min(record_id) AS first_seq, count(*) AS rows, array_to_string(list_sort(list_filter(list_distinct(flatten(list(list_concat([source], coalesce(sources, []))))), lambda x: x IS NOT NULL)), ',') AS sources,
  array_to_string(arg_min(inventors, record_id) FILTER (WHERE len(inventors) > 0), '|') AS inventors, {', '.join(f"{_first_sql(c)} AS {c}" for c in MERGE_FIELDS)}
  FROM (SELECT *, {PKEY.format(c="coalesce(nullif(trim(patent_id), ''), publication_number)")} AS key FROM patents) WHERE key <> '' GROUP BY key""")
def q37_merge(spark: SparkSession, d: str) -> DataFrame:
    """D3 by one key, A8: first non-empty values, an applicant that names somebody first, united sources."""
    key = tx.patent_key(F.coalesce(F.nullif(F.trim("patent_id"), F.lit("")), F.col("publication_number")))
    rows = dedup.merge_by_key(table(spark, d, "patents"), key, "record_id", [*MERGE_FIELDS, "inventors"], listed="sources")
    return rows.select("key", "first_seq", "rows", F.array_join("merged_sources", ",").alias("sources"), F.array_join("inventors", "|").alias("inventors"), *MERGE_FIELDS)


@query()
def q37b_merge_two_keys(spark: SparkSession, d: str) -> DataFrame:
    """D3 in full: by publication key, else by title, in order of arrival."""
    rows = dedup.merge_two_keys(table(spark, d, "patents"), "record_id", [*MERGE_FIELDS, "inventors"], listed="sources")
    return rows.select("group_seq", "rows", F.array_join("merged_sources", ",").alias("sources"), F.array_join("inventors", "|").alias("inventors"), *MERGE_FIELDS)


@query("""SELECT lang, q, first_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY first_id) AS rank FROM (
  SELECT coalesce(lang, '') AS lang, lower(trim(q)) AS k, arg_min(q, doc_id) AS q, min(doc_id) AS first_id FROM (SELECT doc_id, lang, array_to_string(string_split(text, ' ')[1:3], ' ') AS q FROM documents WHERE text IS NOT NULL) WHERE trim(q) <> '' GROUP BY ALL)) WHERE rank <= 8""")
def q38_expand(spark: SparkSession, d: str) -> DataFrame:
    """Case-insensitive ordered distinct with a cap (the cap is the feature)."""
    rows = table(spark, d, "documents").where("text is not null").select(F.coalesce("lang", F.lit("")).alias("lang"), F.col("doc_id").alias("first_id"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("q"))
    return dedup.distinct_texts_capped(rows, "lang", "q", "first_id", 8).select("lang", "q", "first_id", "rank")


@query(r"SELECT doc_id, sum(k) AS hits, string_agg(a, ',' ORDER BY i) FILTER (WHERE k = 1) AS anchors FROM (SELECT doc_id, a, i, contains(' ' || regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g') || ' ', ' ' || a || ' ')::INT AS k FROM documents, (VALUES (1, 'retrieval'), (2, 'index'), (3, 'corpus'), (4, 'query')) v(i, a)) GROUP BY doc_id")
def q45_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of a lexicon against every text, as words."""
    core = lx.anchors("core")
    found = lookup.matched(F.col("text"), core, "word")
    return table(spark, d, "documents").select("doc_id", lookup.hits(F.col("text"), core, "word").cast("long").alias("hits"), F.nullif(F.array_join(found, ","), F.lit("")).alias("anchors"))


@query("SELECT doc_id, source, CAST(rank AS INTEGER) AS rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents)")
def q46_distributed_rank(spark: SparkSession, d: str) -> DataFrame:
    """W1, W2 without sorting a source in one task."""
    return ranking.distributed_rank(table(spark, d, "documents").select("doc_id", "source"), ["source"], ["doc_id"])
