"""Template of a host whose head and foot stand on the same pages."""

import pytest

pytest.importorskip("corpuswright.llm")

from corpuswright.llm import boilerplate


def test_head_and_foot_of_one_class(spark):
    """Menu and copyright share one occurrence vector; its mean position is the middle of the page."""
    pages = []
    for i in range(5):
        word = ("amber", "birch", "cedar", "delta", "ember")[i]
        body = [f"{word} title of the {word} page", *(f"The {word} part {word * (k + 1)} tells something long about {word} {word * k}s." for k in range(8))]
        lines = ["Advertise with the journal today", "Archive of all older volumes", *body, "All rights are reserved by the press and its authors.", "Every reader accepts the terms of the press."]
        pages.append((i, "\n".join(lines), f"https://one.example/{i}", "en"))
    df = spark.createDataFrame(pages, "section_id long, original_text string, source_url string, lang string")
    got = {}
    for s, n in boilerplate.outside_lines(df).collect():
        got.setdefault(s, set()).add(n)
    assert got == {i: {0, 1, 11, 12} for i in range(5)}


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abdegiklmnoprstu") for _ in range(rnd.randrange(4, 9))) for _ in range(n))


def test_roles_learnt_from_other_hosts(spark):
    """What the software of many hosts inserts is known on a host with one page only; headings and captions stay."""
    import random

    rnd = random.Random(3)
    pages, want = [], {}
    for i in range(60):
        host = f"host{i // 6}x.example" if i < 54 else f"single{i}.example"
        lines, out = ["Sign in to your library", f"Home > {prose(rnd, 1)} > {prose(rnd, 2)}", ""], {0, 1}
        lines.append(f"{prose(rnd, 6)}")
        for k in range(3):
            if rnd.random() < 0.3:
                lines.append("Methods" if k == 1 else f"Figure {k}: {prose(rnd, 3)}")
            lines.append(f"{prose(rnd, 14)}. {prose(rnd, 12)}.")
            if k == i % 3:
                out.add(len(lines))
                lines.append("Share this page with a friend")
        lines += ["", "Related pages"]
        out.add(len(lines) - 1)
        for _ in range(2):
            out.add(len(lines))
            lines.append(prose(rnd, 5))
        if i % 2:
            out.add(len(lines))
            lines.append("Share this page with a friend")
        out.add(len(lines))
        lines.append(f"reader{rnd.randrange(99)}: {prose(rnd, 6)}.")
        out.add(len(lines))
        lines.append("Built with the paper press engine 4.2")
        pages.append((i, "\n".join(lines), f"https://{host}/{i}", "en"))
        want[i] = out
    df = spark.createDataFrame(pages, "section_id long, original_text string, source_url string, lang string")
    got = {i: set() for i in range(60)}
    for s, n in boilerplate.outside_lines(df).collect():
        got[s].add(n)
    wrong = {i: (sorted(got[i] - want[i]), sorted(want[i] - got[i])) for i in want if got[i] != want[i]}
    found = sum(len(got[i] & want[i]) for i in want)
    assert found >= 0.98 * sum(map(len, want.values())) and found >= 0.98 * sum(map(len, got.values())), wrong
