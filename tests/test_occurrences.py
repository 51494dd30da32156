"""Sentences that occur in the texts of their key, without pairs of both."""

import random

import duckdb
import pytest

from corpuswright.operators.occurrences import occurring
from corpuswright.plans import registry


@pytest.mark.parametrize("bits", [29, 12])
def test_occurring_against_brute_force(spark, bits):
    """Random stretches and strangers of every length; at 12 bits the sentences go through in slices, a crowded key in all."""
    rnd = random.Random(bits)
    make = lambda n: "".join(rnd.choice("ab é检 ") for _ in range(n))
    texts = [(rnd.choice(["p", "p", "p", "q", "r", None]), make(rnd.choice([0, 1, 7, 40, 300, 900]))) for _ in range(120)] + [("q", "x" * 700), ("z", "")]
    given = [("p", None), (None, "a"), ("z", ""), ("z", "a"), ("none", ""), ("q", "x" * 513), ("q", "x" * 701), ("q", "x")]
    for key, t in texts:
        for _ in range(6):
            lo = rnd.randrange(len(t) + 1)
            own = t[lo : lo + rnd.choice([0, 1, 2, 3, 5, 8, 13, 16, 17, 64, 100, 500])]
            given += [(key, own), (rnd.choice("pqr"), own), (key, own[:-1] + "b"), (key, "a" + own)]
    e, s = spark.createDataFrame(given, "k string, t string"), spark.createDataFrame(texts, "k string, body string").repartition(5)
    out = [tuple(r) for r in occurring(e, s, "k", "t", "body", max_bits=bits).collect()]
    occurs = lambda key, t: any(k == key and t in body for k, body in texts)
    assert len(out) == len(set(out)) and all(occurs(*r) for r in out)
    want = {(k, t) for k, t in given if k is not None and t is not None and occurs(k, t)}
    assert want == set(out) & set(given) and len(want) > 200 and len(set(given) - want) > 200
    assert occurring(e.where("false"), s, "k", "t", "body").count() == 0 and occurring(e, s.where("false"), "k", "t", "body").count() == 0


def q18(spark, tmp_path, sentences, sections):
    """(Spark's rows, the SQL's rows, the plan of q18_provenance over these tables)"""
    e = spark.createDataFrame(sentences, "row_id long, paper_id string, section string, text string, original_index int")
    s = spark.createDataFrame(sections, "paper_id string, original_text string")
    con = duckdb.connect()
    for name, df in (("extracted_sentences", e), ("paper_sections", s)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    df = registry.QUERIES["q18_provenance"](spark, str(tmp_path))
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    return order(df.collect()), order(con.execute(registry.ORACLES["q18_provenance"]).fetchall()), df._jdf.queryExecution().optimizedPlan().toString()


def test_provenance_of_odd_rows(spark, tmp_path):
    sections = [("A", "One  two\n three. Four\u000bfive"), ("A", "One  two\n three. Four\u000bfive"), ("A", None), ("B", ""), ("C", " \n"), (None, "One two")]
    texts = ["One two three.", "two\n\nthree", "wo", "One two three. Four", "Four five", "Four\u000bfive", "　two ", "five six", "", "  ", None, "ONE", "三"]
    sentences = [(100 * k + i, p, "results", t, i) for k, p in enumerate(["A", "B", "C", "D", None]) for i, t in enumerate(texts)]
    sentences += [sentences[0], sentences[0], (0, "A", "results", "nowhere", 0), (0, "A", "methods", "nowhere", 0), (None, "A", None, "wo", None)]
    got, want, _ = q18(spark, tmp_path, sentences, sections)
    assert got == want and {r[2] for r in got} == {True, False}


def test_provenance_forms_no_pairs_of_a_paper(spark, tmp_path):
    """A paper with many sentences and sections: they meet by text, not each with each."""
    sections = [("P", f"Section {i} says so. It ends with {i * 7}.") for i in range(300)]
    sentences = [(i, "P", "results", f"It ends with {i}.", i) for i in range(300)]
    got, want, plan = q18(spark, tmp_path, sentences, sections)
    assert got == want and sum(r[2] for r in got) == len([i for i in range(300) if i % 7 == 0])
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and all("paper_id" in j and "(t#" in j for j in joins)
