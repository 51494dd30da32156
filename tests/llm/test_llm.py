"""Small cases for every training-data operator: definitions, brute force, nulls, ties, empty tables."""

import random

import pytest

pytest.importorskip("corpuswright.llm")

from corpuswright.llm import boilerplate, contamination, name_variants, near_duplicates, packing, sentences, shared_spans, survivors
from corpuswright.llm.wordseq import words_of


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- problem 1


def page(i, lang, host, body, foot):
    head = ["Home / News / Contact", f"We use cookies on {host} to count visits to our pages.", ""]
    return (i, "\n".join(head + body + foot), f"https://{host}/a/{i}", lang)


def test_outside_lines(spark):
    pages, rnd = [], random.Random(0)
    some = lambda n: " ".join("".join(rnd.choice("abdeiklmnorstu") for _ in range(6)) for _ in range(n))
    for i in range(12):
        host = f"site{i % 3}.example"
        lang = ("en", "de", "fr")[i // 4]
        body = [f"{some(5)} {i}", f"{some(9)}.", f"{some(1)}", f"{some(8)} and {some(3)}."]
        pages.append(page(i, lang, host, body, ["Related articles", some(5), "Powered by PressEngine 4.2"]))
    df = spark.createDataFrame(pages, "section_id long, original_text string, source_url string, lang string")
    got = {}
    for s, n in rows(boilerplate.outside_lines(df)):
        got.setdefault(s, set()).add(n)
    for i in range(12):
        assert got[i] == {0, 1, 7, 8, 9}, (i, got[i])


def test_outside_lines_edges(spark):
    schema = "section_id long, original_text string, source_url string, lang string, token string, host int"
    empty = spark.createDataFrame([], schema)
    assert rows(boilerplate.outside_lines(empty)) == []
    odd = spark.createDataFrame([(1, None, None, None, "x", 1), (2, "", "u", "en", "x", 1), (3, "One line of text that ends.", None, None, None, None), (3, "One line of text that ends.", None, None, None, None)], schema)
    assert rows(boilerplate.outside_lines(odd)) == []


# ---- problem 2

PATENTS = "record_id long, patent_id string, publication_number string, title string, abstract string, publication_date string, source string, sources array<string>, retrieved_at timestamp"
TRUST = "source string, trust_rank int"


def patents(spark, data):
    import datetime as dt

    at = lambda d: dt.datetime(2024, 1, d) if d else None
    return spark.createDataFrame([(i, p, n, t, a, d, s, ss, at(r)) for i, p, n, t, a, d, s, ss, r in data], PATENTS)


def test_survivors(spark):
    trust = spark.createDataFrame([("reg", 1), ("lens", 2), ("view", 3)], TRUST)
    full = "Apparatus for glacier sensing comprising a lattice"
    data = [
        (1, "US-10000001-A1", None, "Apparatus for glacier sensing", "Long text that ends.", "2020-13-01", "reg", ["REG", " lens"], 1),
        (2, None, "us10000001a1", full, "Long text that", "1.2.2020", "view", [None, ""], 2),
        (3, "https://x.example/patent/US10000001A1", "", "N/A", "Long text that ends. And more …", "2020", "lens", ["lens"], 3),
        (4, "EP 10000,002 B1", None, "Alone", "Alone.", "2020-01-01", "reg", ["reg"], 1),
        (5, "nothing", None, "No number", "x.", "2020-01-01", "reg", ["reg"], 1),
    ]
    got = rows(survivors.survivors(patents(spark, data), trust))
    # the first title and both unfinished abstracts are cut off; the first abstract is a part of a longer one as well
    assert [(f, p) for g, f, p in got if g == 1 and f != "abstract"] == [("publication_date", "2"), ("sources", "lens"), ("sources", "reg"), ("title", "2")]
    assert {g for g, _, _ in got} == {1}


def test_survivors_priority_and_ties(spark):
    trust = spark.createDataFrame([("reg", 1), ("lens", 2)], TRUST)
    same = "Method of operating a pump"
    data = [
        (9, "US10000003A1", None, same, None, "20200101", "lens", None, 5),
        (8, "US10000003A1", None, same, None, "2020/01/02", "reg", None, 2),
        (7, "US10000003", None, same + " again", None, "unknown", "reg", None, 3),
        (6, "US10000003", None, same + " again", None, None, "reg", None, 3),
        (5, "US10000003", None, "-", None, None, "other", None, None),
    ]
    got = dict(((f, p) for _, f, p in rows(survivors.survivors(patents(spark, data), trust))))
    assert got == {"title": "6", "publication_date": "8"}
    assert rows(survivors.survivors(patents(spark, []), trust)) == []


def test_survivors_rounds_agree(spark):
    """Many distinct values go through several rounds and give what one round gives."""
    trust = spark.createDataFrame([("reg", 1)], TRUST)
    rnd = random.Random(5)
    data = [(i, "JP10000009A1", None, f"Device number {rnd.randrange(10**6)} with part {i}", None, None, "reg", None, rnd.randrange(1, 28)) for i in range(60)]
    one = rows(survivors.survivors(patents(spark, data), trust))
    many = rows(survivors.survivors(patents(spark, data), trust, chunk=8))
    assert one == many and len(one) == 1


def test_consensus_majority():
    mk = lambda i, v, n: {"record_id": i, "value": v, "n": n, "trust": 1, "ts": 0}
    picked = survivors.choose("title", [mk(1, "a red panel of glass", 1), mk(2, "a blue panel of glass", 3), mk(3, "a blue panel of brass", 1)], "trust")
    assert picked["record_id"] == 2


def test_calendar_day():
    assert str(survivors.calendar_day("31.12.2020")) == "2020-12-31" and str(survivors.calendar_day("7 May 2019")) == "2019-05-07"
    assert survivors.calendar_day("2022-13-45") is None and survivors.calendar_day("2022-02-30") is None and survivors.calendar_day("2017-03") is None


# ---- problem 3


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    data, texts = [], {}
    for i in range(40):
        base = [rnd.choice(vocab) for _ in range(60)]
        for j in range(3):
            w = list(base)
            for _ in range(rnd.randrange(0, 9)):
                w[rnd.randrange(60)] = rnd.choice(vocab)
            k = i * 3 + j
            data.append((k, None if k % 5 == 0 else "Title words", " ".join(w)))
    data += [(500, "T", "too short"), (501, None, None), (502, "x", ""), (503, data[0][1], data[0][2]), (503, data[0][1], data[0][2])]
    for k, t, a in data:
        w = words_of(a)
        if len(w) >= 20:
            w = words_of(t) + w
            texts[k] = set(zip(w, w[1:], w[2:]))
    want = sorted((a, b) for a in texts for b in texts if a < b and 2 * len(texts[a] & texts[b]) >= len(texts[a] | texts[b]))
    df = spark.createDataFrame(data, "record_id long, title string, abstract string")
    got = rows(near_duplicates.near_duplicate_pairs(df, n=3, threshold=0.5))
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)
    assert rows(near_duplicates.near_duplicate_pairs(df.where("false"), n=3, threshold=0.5)) == []


def test_hot_bucket_is_split_and_loses_nothing(spark):
    keys = spark.createDataFrame([(i, 10, 7) for i in range(60)], "id long, size int, bucket long")
    got = rows(near_duplicates.candidates(keys, 0.5, block=8))
    assert len(got) == 60 * 59 // 2


def test_groups(spark):
    base = " ".join(f"w{i}" for i in range(80))
    data = [(1, "", base), (2, "", base), (3, "", base + " tail"), (4, "", " ".join(f"x{i}" for i in range(80)))]
    df = spark.createDataFrame(data, "record_id long, title string, abstract string")
    assert rows(near_duplicates.near_duplicate_groups(df)) == [(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 0)]


def test_weighted_near_duplicates(spark):
    """Counts as weights: pairs by probability Jaccard, against brute force."""
    from collections import Counter

    rnd = random.Random(8)
    texts = {}
    for i in range(60):
        words = [f"w{rnd.randrange(6)}" for _ in range(40)] if i % 3 == 0 else texts[i - 1].split()
        if i % 3:
            words = words[:]
            words[rnd.randrange(40)] = f"x{i}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame([(i, None, t) for i, t in texts.items()], "record_id long, title string, abstract string")
    got = rows(near_duplicates.near_duplicate_pairs(df, n=2, threshold=0.6, weights="count", bands=96, width=3))

    def grams(t):
        w = words_of(t)
        return Counter(zip(w, w[1:]))

    def jp(x, y):
        every = set(x) | set(y)
        return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in every) for i in set(x) & set(y))

    bags = {i: grams(t) for i, t in texts.items()}
    want = sorted((a, b) for a in bags for b in bags if a < b and jp(bags[a], bags[b]) >= 0.6)
    assert len(want) > 10 and got == want


# ---- problem 4


@pytest.mark.parametrize(
    "text, want",
    [
        ("Dr. Lee saw approx. 3 cases. It was 3.5 in Fig. 2.[9] Then it ended", ["Dr. Lee saw approx. 3 cases.", "It was 3.5 in Fig. 2.[9]", "Then it ended"]),
        ('They asked "Does it scale? We doubt it." and left. Next one!', ['They asked "Does it scale? We doubt it." and left.', "Next one!"]),
        ("(It was left out.) The rest stayed.", ["(It was left out.)", "The rest stayed."]),
        ("2.1 A heading\n\nText of the\nparagraph. pH was 7.", ["2.1 A heading", "Text of the\nparagraph.", "pH was 7."]),
        ("Am 3. März fiel z. B. der Wert. Siehe Nr. 9. Ende", ["Am 3. März fiel z. B. der Wert.", "Siehe Nr. 9.", "Ende"]),
        ("作者写道：“不稳定。我们停止了。”随后更换了模块。真的吗？！（除外。）好", ["作者写道：“不稳定。我们停止了。”随后更换了模块。", "真的吗？！", "（除外。）", "好"]),
        ("「不安定だ。止めた。」と述べた。値は2.5である。", ["「不安定だ。止めた。」と述べた。", "値は2.5である。"]),
        ("मान 6.6 था। डॉ. Bredon ने कहा। क्या?", ["मान 6.6 था।", "डॉ. Bredon ने कहा।", "क्या?"]),
        ("ค่าเฉลี่ยคือ 4.7 หน่วย นพ. Takuk วัด 530 ฉบับด้วยตัวแทน การทดลอง 2 ครั้ง", ["ค่าเฉลี่ยคือ 4.7 หน่วย", "นพ. Takuk วัด 530 ฉบับด้วยตัวแทน", "การทดลอง 2 ครั้ง"]),
        ("  \n \n", []),
    ],
)
def test_split(text, want):
    assert [text[a:b] for a, b in sentences.split(text)] == want


def test_split_loses_no_character():
    rnd = random.Random(2)
    alphabet = "ab A.!?。“”\"()（）\n 1ก"
    for _ in range(500):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 60)))
        spans = sentences.split(t)
        assert all(a < b and not t[a].isspace() and not t[b - 1].isspace() for a, b in spans)
        assert "".join("".join(t[a:b].split()) for a, b in spans) == "".join(t.split())


def test_sentences_edges(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, ""), ("a", 3, "One. Two."), ("a", 4, "x" * 200_000)], "origin string, row_id long, text string")
    assert rows(sentences.sentences(df)) == [("a", 3, 0, 4), ("a", 3, 5, 9), ("a", 4, 0, 200_000)]


# ---- problem 5


def test_trie_equals_brute_force():
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(3, 9))) for _ in range(300)})
    trie = name_variants.Trie()
    for w in words:
        trie.add(w, w)
    for w in words[:80]:
        for k in (1, 2):
            assert {x for x in words if name_variants.edits(w, x, k)} <= {x for x, _ in trie.near(w, k)}


def test_name_entities(spark):
    names = [
        "Abigail Matrorapaski", "matrorapaski, abigail", "Dr. Abigail Matrorapaski", "A. Matrorapaski", "MATRORAPASKI Abigail", "Abigail Matrorapasky", "Abby Matrorapaski",
        "Bruno Matrorapaski", "Metisopi Robotics GmbH", "METISOPI ROBOTICS", "Metisopi", "The Metisopi Robotics", "Metisopi Energy Inc.", "University of Bramamuzi", "Bramamuzi, University", "N/A", "", None, "Unknown", "1234",
    ]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    forms = spark.createDataFrame([("Abigail", "Abby")], "given_name string, short_form string")
    got = {}
    for n, e in name_variants.entities(df, forms).collect():
        got.setdefault(e, set()).add(n)
    groups = sorted(map(sorted, got.values()))
    assert sorted(["Abigail Matrorapaski", "matrorapaski, abigail", "Dr. Abigail Matrorapaski", "A. Matrorapaski", "MATRORAPASKI Abigail", "Abigail Matrorapasky", "Abby Matrorapaski"]) in groups
    assert ["Bruno Matrorapaski"] in groups and ["Bramamuzi, University", "University of Bramamuzi"] in groups
    # two firms share the brand: the bare brand word belongs to neither
    assert sorted(["Metisopi Robotics GmbH", "METISOPI ROBOTICS", "The Metisopi Robotics"]) in groups and ["Metisopi"] in groups
    assert not any(n in g for g in groups for n in ("N/A", "", "Unknown", "1234"))
    pairs = rows(name_variants.variant_pairs(name_variants.entities(df.where("name like '%Bramamuzi%'"))))
    assert pairs == [("Bramamuzi, University", "University of Bramamuzi")]
    assert rows(name_variants.entities(df.where("false"))) == []


def test_shard_blocks_agree(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("bdkl") + rnd.choice("aeo") for _ in range(5)).capitalize() for _ in range(40)]
    names = [f"Zofia {b}" for b in base] + [f"Zofia {b[:4]}x{b[4:]}" for b in base[:10]]
    df = spark.createDataFrame([(n,) for n in set(names)], "name string")
    a = rows(name_variants.variant_pairs(name_variants.entities(df)))
    b = rows(name_variants.variant_pairs(name_variants.entities(df, block=7)))
    assert a == b and len(a) >= 10


# ---- problem 6


def test_fill_is_the_best_multiset():
    from itertools import product

    rnd = random.Random(6)
    for _ in range(60):
        counts = {n: rnd.randrange(1, 4) for n in rnd.sample(range(1, 30), 4)}
        cap = rnd.randrange(max(counts), 60)
        lengths = sorted(counts, reverse=True)
        used = dict(packing.fill(counts, lengths, cap))
        best = max(s for ks in product(*[range(counts[n] + 1) for n in lengths]) if ks[0] >= 1 and (s := sum(k * n for k, n in zip(ks, lengths))) <= cap)
        assert sum(n * k for n, k in used.items()) == best and all(counts[n] >= k for n, k in used.items())


def test_pack(spark):
    rnd = random.Random(7)
    counts = [(i, rnd.choice([0, 1, 5, 37, 100, 101, 250, 999])) for i in range(400)]
    df = spark.createDataFrame(counts, "doc_id long, tokens long")
    windows = spark.createDataFrame([(1, 100), (2, 512), (3, None), (4, 0)], "window_id int, capacity_tokens int")
    out = packing.pack(df, windows).toPandas()
    out["n"] = out.end_token - out.start_token
    for w, cap in ((1, 100), (2, 512)):
        part = out[out.window_id == w]
        assert part.groupby("bin_id").n.sum().max() <= cap
        assert part.groupby("doc_id").n.sum().to_dict() == dict(counts)
        whole = part.groupby("doc_id").size()
        assert all(whole[i] == max(1, -(-t // cap)) for i, t in counts)
        total = sum(t for _, t in counts)
        assert part.bin_id.nunique() <= 1.01 * total / cap + 3
    assert set(out.window_id) == {1, 2}
    assert packing.pack(df.where("false"), windows).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None)], "doc_id long, text string")
    assert rows(packing.token_counts(df)) == [(1, 2), (2, 0)]


# ---- problem 7


def brute_leak(words, item):
    import math

    if any(words[i : i + 12] == item[j : j + 12] for j in range(len(item) - 11) for i in range(len(words) - 11)):
        return True
    need, room = math.ceil(0.75 * len(item)), int(1.5 * len(item))
    for s in range(len(words)):
        part = words[s : s + room]
        row = [0] * (len(item) + 1)
        for w in part:
            last = 0
            for j, x in enumerate(item, 1):
                last, row[j] = row[j], last + 1 if w == x else max(row[j], row[j - 1])
        if row[-1] >= need:
            return True
    return False


def test_leaks_against_brute_force():
    rnd = random.Random(8)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(4, 30)))) for i in range(12)]
    docs = []
    for _ in range(120):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 60))]
        part = rnd.choice(items)[1].split()
        part = [x for x in part if rnd.random() > 0.2 * rnd.random()]
        for _ in range(rnd.randrange(0, 8)):
            part.insert(rnd.randrange(len(part) + 1), rnd.choice(vocab))
        at = rnd.randrange(len(w) + 1)
        docs.append(" ".join(w[:at] + part + w[at:]))
    got = contamination.Matcher(items).match(docs)
    want = sorted((t, k) for t, d in enumerate(docs) for k, x in items if brute_leak(d.split(), x.split()))
    assert got == want and want


def test_leaks_edges(spark):
    items = spark.createDataFrame([(1, "Alpha, beta; gamma DELTA"), (2, None), (3, "..."), (4, "zz")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha beta Gamma y delta"), (2, None), (3, ""), (4, "... ---"), (1, "x alpha beta Gamma y delta"), (5, "alpha gamma beta")], "doc_id long, text string")
    assert rows(contamination.leaks(docs, items)) == [(1, 1)]
    assert rows(contamination.leaks(docs, items, per_set=1)) == [(1, 1)]
    assert rows(contamination.leaks(docs.where("false"), items)) == []
    assert rows(contamination.leaks(docs, items.where("false"))) == []


# ---- problem 8


def brute_spans(docs, length):
    seen = {}
    for d, t in docs:
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], set()).add(d)
    out = []
    for d, t in dict(docs).items():
        cur = None
        for i in range(len(t) - length + 1):
            if len(seen[t[i : i + length]]) > 1:
                if cur and i <= cur[1]:
                    cur[1] = i + length
                else:
                    if cur:
                        out.append((d, *cur))
                    cur = [i, i + length]
        if cur:
            out.append((d, *cur))
    return sorted(out)


@pytest.mark.parametrize("small_group", [64, 1])
def test_shared_spans_against_brute_force(spark, small_group):
    rnd = random.Random(9)
    pool = ["".join(rnd.choice("abcd é漢") for _ in range(rnd.randrange(30, 120))) for _ in range(8)]
    docs = []
    for i in range(60):
        t = "".join(rnd.choice(["".join(rnd.choice("xyz") for _ in range(rnd.randrange(0, 30))), rnd.choice(pool), rnd.choice(pool)[rnd.randrange(20) :]]) for _ in range(rnd.randrange(1, 6)))
        docs.append((i, t))
    docs += [(100, "aaaa" * 40), (101, "aaaa" * 35), (102, "b" * 200), (103, docs[0][1])]
    df = spark.createDataFrame([*docs, (200, None), (201, ""), (202, "short")], "doc_id long, text string")
    got = rows(shared_spans.shared_spans(df, length=32, small_group=small_group))
    assert got == brute_spans(docs, 32)


def test_shared_spans_hot_and_empty(spark):
    common = "".join(random.Random(1).choice("abcdefgh ") for _ in range(100))
    docs = [(i, f"{i:05d}" + common + f"{i * 7:07d}") for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(shared_spans.shared_spans(df, length=40, hot_keys=5)) == brute_spans(docs, 40)
    assert rows(shared_spans.shared_spans(df.where("false"))) == []


def test_saturating_sketch_never_underestimates():
    import numpy as np

    keys = np.arange(5000, dtype=np.uint64)
    a, b = shared_spans.Sketch(10), shared_spans.Sketch(10)
    a.add(keys[:3000])
    b.add(keys[2000:])
    parts = {}
    for s in (a, b):
        for k, p in s.blocks():
            parts.setdefault(k, []).append(p)
    planes = shared_spans.repeated_filter([(k, shared_spans.seen_again(shared_spans.merged(p))) for k, p in parts.items()], 10, 2)
    assert shared_spans.estimated_repeated(keys[2000:3000], planes, 10).all()


def test_lattice_prefers_closed_quotations():
    cut = lambda t: [t[a:b] for a, b in sentences.split(t)]
    assert cut('He said "Stop. Wait." and left. Then "all. was" still. End.') == ['He said "Stop. Wait." and left.', 'Then "all. was" still.', "End."]
    assert cut('A "mark is lost. Next one. Last.') == ['A "mark is lost.', "Next one.", "Last."]
    assert cut("It rose (see Fig. 3. There it is.) again. Done.") == ["It rose (see Fig. 3. There it is.) again.", "Done."]


def test_scripts_without_stops():
    """Gaps of Lao, Khmer and Burmese text end a sentence only at a sign; runs are read whole, whatever their length."""
    cut = lambda t: [t[a:b] for a, b in sentences.split(t)]
    assert cut("ພວກເຮົາວັດແທກ ແລະບັນທຶກແລ້ວ ດັ່ງນັ້ນຜົນດີ") == ["ພວກເຮົາວັດແທກ ແລະບັນທຶກແລ້ວ", "ດັ່ງນັ້ນຜົນດີ"]
    assert cut("យើងវាស់ និងកត់ត្រាហើយ ដូច្នេះលទ្ធផលល្អ") == ["យើងវាស់ និងកត់ត្រាហើយ", "ដូច្នេះលទ្ធផលល្អ"]
    assert cut("ကျွန်ုပ်တို့တိုင်းသည် ရလဒ်ကောင်း") == ["ကျွန်ုပ်တို့တိုင်းသည်", "ရလဒ်ကောင်း"]
    long = "ก" * 300 + "แล้ว"
    assert cut(f"{long} ผลดี") == [long, "ผลดี"]
