"""Evidence of limits in papers, and the gap records built on it.

Stages of the evidence of a paper, the first that finds something wins: a cue word in the selected sentences of its limitation,
discussion, methodology and result sections (in this order); a limit word in a piece of its full text; one in a piece
of its abstract; its stated challenges; its problem statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswright.lexicon import EVIDENCE_CUES, LIMIT_WORDS, SEVERITIES
from corpuswright.operators.analysis import cyclic
from corpuswright.operators.ranking import distributed_rank
from corpuswright.operators.rules import literal

# Sections of the first stage in order, and what a missing field says.
STAGE_SECTIONS = ("limitations", "discussion", "methodology", "results")
MISSING = ("Not extracted", "Not available in abstract.", "Not detailed")
# Causes, effects and openings named in turn where a paper's own words say nothing of them; a parameter.
TEMPLATES = (
    ("no adaptation to drifting inputs", "batch training", "quality decays in use", "update weights online"),
    ("no reading of what features decide", "opaque representations", "experts cannot check results", "attribute outputs to inputs"),
    ("no test on data from elsewhere", "data that cannot be shared", "fit to one site only", "evaluate over many sites"),
    ("too slow for small devices", "unpruned layers", "large servers are needed", "prune and quantise"),
    ("no handling of missing inputs", "complete records are assumed", "faults spoil predictions", "impute before use"),
)


def has_word(text: Column, words: tuple[str, ...]) -> Column:
    return F.lower(text).rlike("|".join(literal(w) for w in words))


def first_piece(text: Column, longer_than: int, shorter_than: int | None = None) -> Column:
    """First piece between full stops that holds a limit word and does not speak of a missing abstract; else null."""
    pieces = F.transform(F.split(text, r"\."), lambda p: F.trim(p))
    fit = lambda p: (F.length(p) > longer_than) & has_word(p, LIMIT_WORDS) & ~F.lower(p).contains("no abstract")
    if shorter_than:
        return F.get(F.filter(pieces, lambda p: fit(p) & (F.length(p) < shorter_than)), F.lit(0))
    return F.get(F.filter(pieces, fit), F.lit(0))


def stated(column: Column) -> Column:
    """The text of a field, null where it is blank or says that it is missing."""
    return F.when((F.trim(F.coalesce(column, F.lit(""))) != "") & ~column.isin(*MISSING), column)


def evidence(papers: DataFrame, sentences: DataFrame, texts: DataFrame, paper: str = "paper_id") -> DataFrame:
    """(paper, stage, section, sentence_id, evidence) of each paper of ``papers`` (paper, abstract, and challenges and
    problem_statement if it has them); stage null where nothing was found.

    ``sentences``: paper, section, text, sentence_id, original_index, row_id of the selected sentences. ``texts``: paper, section_id, text.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in STAGE_SECTIONS]), F.col("section"))
    said = sentences.where(F.col("section").isin(*STAGE_SECTIONS) & has_word(F.col("text"), EVIDENCE_CUES))
    said = said.groupBy(paper).agg(F.min_by(F.struct("section", "sentence_id", "text"), F.struct(rank.alias("r"), F.coalesce("original_index", F.lit(-1)).alias("i"), F.col("row_id").alias("k"))).alias("s"))
    piece = texts.where(F.length("text") > 200).select(paper, "section_id", first_piece(F.col("text"), 30, 300).alias("t")).where("t is not null")
    piece = piece.groupBy(paper).agg(F.min_by("t", F.col("section_id")).alias("t"))
    rows = papers.join(said, paper, "left").join(piece, paper, "left")
    have = set(papers.columns)
    field = lambda c: stated(F.col(c)) if c in have else F.lit(None).cast("string")
    challenge, problem = field("challenges"), field("problem_statement")
    abstract = first_piece(F.col("abstract"), 20)
    pid = F.col(paper)
    pack = lambda stage, section, sid, text: F.struct(F.lit(stage).alias("stage"), section.alias("section"), sid.alias("sentence_id"), text.alias("evidence"))
    limits, none = F.lit("limitations"), F.lit(None).cast("string")
    found = (
        F.when(F.col("s").isNotNull(), pack(1, F.col("s.section"), F.col("s.sentence_id"), F.col("s.text")))
        .when(F.col("t").isNotNull(), pack(2, limits, F.concat(pid, F.lit("-LIM-01")), F.col("t")))
        .when(abstract.isNotNull(), pack(3, F.lit("abstract"), F.concat(pid, F.lit("-ABS-01")), abstract))
        .when(challenge.isNotNull(), pack(4, limits, F.concat(pid, F.lit("-CHAL-01")), challenge))
        .when(problem.isNotNull(), pack(5, limits, none, problem))
    )
    return rows.select(paper, found.alias("e")).select(paper, "e.stage", "e.section", "e.sentence_id", "e.evidence")


def reference(paper: Column, section: Column, sentence_id: Column, text: Column) -> Column:
    """'paper | section | sentence | first 120 characters'; null without a sentence."""
    return F.when(sentence_id.isNotNull(), F.concat_ws(" | ", paper, section, sentence_id, F.substring(text, 1, 120)))


def gap_records(papers: DataFrame, found: DataFrame, seq: str, paper: str = "paper_id", templates=TEMPLATES) -> DataFrame:
    """(gap_id, paper, position, severity, stage, section, sentence_id, evidence, reference, cause): one record a paper.

    ``papers``: paper, seq, eligible. Eligible papers come first, numbered by ``seq``, with severities and templates in turn;
    the others follow, of low severity and without evidence. Positions come from a distributed rank.
    """
    both = papers.select(paper, seq, (~F.col("eligible")).cast("int").alias("late"), F.lit(0).alias("_all"))
    ranked = distributed_rank(both, ["_all"], ["late", seq], "position")
    open_ = F.col("late") == 0
    turn = F.pmod(F.col("position") - 1, F.lit(len(templates))).cast("int")
    cause = F.get(F.array(*[F.lit(f"{a}: {b}; {c}; {d}") for a, b, c, d in templates]), turn)
    gap_id = F.concat(F.lit("GAP-"), F.lpad(F.col("position").cast("string"), F.greatest(F.lit(2), F.length(F.col("position").cast("string"))), F.lit("0")))
    rows = ranked.join(found, paper, "left")
    only = lambda c: F.when(open_, F.col(c)).alias(c)
    rows = rows.select(gap_id.alias("gap_id"), paper, "position", F.when(open_, cyclic(SEVERITIES, F.col("position"))).otherwise(SEVERITIES[-1]).alias("severity"), *[only(c) for c in ("stage", "section", "sentence_id", "evidence")], F.when(open_, cause).alias("cause"))
    return rows.withColumn("reference", reference(F.col(paper), F.col("section"), F.col("sentence_id"), F.col("evidence")))
