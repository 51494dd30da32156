"""Sentence boundaries across languages and scripts.

Problem 4. Every sentence of every text with its place.

How it works
------------
A text is cut at blank lines; a heading on its own line is a unit. What is left is read in one of
two ways:

* *Spaced scripts and scripts with their own full stops.* The end marks and closing marks of a paragraph are the
  nodes of a lattice, its edges are possible sentences. A node is weighed by what stands around it: a full
  stop by the word before it (abbreviations that never end a sentence, that need a number behind
  them, or that may end one; initials, unless a number makes them a unit; ordinals) and by the word behind it
  (capital, digit, small letter), a closing mark by what it closes. An edge pays for every quotation mark and
  bracket that it leaves open. The best path is found in one pass, linear in the nodes: of all earlier nodes with
  the same marks open only the best matters.
* *Scripts without spaces and full stops* (Thai, Lao, Khmer, Burmese where unmarked). A word lattice over a
  dictionary is solved for the fewest unknown letters, then the fewest words, for the whole run of letters on either
  side of each gap; the gap is then classified by the word it follows (final particles, units, conjunctions) and
  the word it precedes (opening words, words that cannot open). The dictionaries are a parameter; those given are
  small, the Thai one the largest. In Lao, Khmer and Burmese text a gap ends a sentence only behind a final particle
  or in front of an opening word.

Texts are independent, so the whole work is one ``mapInPandas`` without any shuffle.

Defined results: null, empty and blank texts give no row; a text without any end mark is one
sentence a paragraph; very long texts are read whole; repeated rows give their sentences again
for each row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Abbreviations, lower case, without their last full stop.
NEVER = set(
    "dr prof mr mrs ms mme mlle st sr sra dra dres vs cf e.g i.e viz ex bzw ca z.b d.h u.a sog ggf inkl evtl hr fr frau ing dipl c.-à-d p.ex p.ej ej ee sres rev gen col lt capt sgt hon pres gov см т.е т.к т.н напр им акад проф доц д-р डॉ प्रो श्री د أ م นพ พญ ดร ศ รศ ผศ mt ft op fig figs".split()
)
NUMBERED = set("no nos nr nrn sec sect eq eqs v vol vols ver vers approx p pp pág págs pag chap ch abb tab art núm num ref refs рис табл стр гл разд n° para app ex bd anm s".split())
PERHAPS = set("inc corp ltd co bros etc u.s u.k u.s.a a.m p.m mon tue wed thu fri sat sun jan feb mar apr jun jul aug sep sept oct nov dec al usw aprox env uu jr d.c ph.d no".split())
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jänner jahr jahrhundert tag woche monat mal kapitel abschnitt schritt platz rang stock januars jahrestag quartal".split())
BEFORE_ORDINAL = set("am im zum vom beim der die das dem den des seit bis ab nach".split())

MARK = re.compile(r"[.!?…。！？．｡؟।॥။។۔]+|[\"“”„«»‹›「」『』（）()【】]")
PARAGRAPH = re.compile(r"\n[^\S\n]*(?:\n\s*)+")
CLOSERS = "”’»›」』）)】]"
REFERENCE = re.compile(r"(?:\[\d+(?:\s?[,–-]\s?\d+)*\]|[¹²³⁰-⁹]+)+")
PAIRS = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "【": "】"}
OWN_STOP = set("。！？．｡")
SOUTH_STOP = set("।॥။។۔؟")
CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿가-힯]")
LINE_HEADING = re.compile(r"^(?:\d+(?:\.\d+)*\.?|[IVX]+\.|§\s?\d+)\s+\S.{0,70}$")
SPACELESS = re.compile(r"[฀-໿ក-៿က-႟]")

# A small Thai dictionary by the part its words play at a gap.
THAI_OPEN = "การทดลอง ค่าเฉลี่ย ค่าเฉลี่ยคือ นพ. พญ. ดร. นาย นาง ผล งาน เรา ผู้วิจัย นักวิจัย อย่างไรก็ตาม นอกจากนี้ ดังนั้น ต่อมา จากนั้น ในขณะที่ เมื่อ หลัง หลังการ ภายใต้ ใน โดย ด้วย ตัว แบบจำลอง ระบบ เซนเซอร์ หุ่นยนต์ ช่อง ชุดข้อมูล ดัชนี สำหรับ ตาม เพื่อ ถ้า หาก สุดท้าย บทความ วิธี".split()
THAI_JOIN = "และ หรือ แต่ ที่ ซึ่ง อัน เพราะ กับ ว่า จึง ก็ คือ เป็น ของ ต่อ แก่ แด่ โดยที่ เนื่องจาก รวมทั้ง รวมถึง ตลอดจน ได้แก่ เช่น".split()
THAI_FINAL = "ครับ ค่ะ คะ นะ จ้ะ จ๊ะ สิ ซิ เถอะ เลย แล้ว ไหม หรือไม่ อีกด้วย ด้วย".split()
THAI_OTHER = "ควบคุม กระจาย แบบ วางแผน ปรับตัว แทน ร่วมมือ ร่วม ทนทาน สวมใส่ เคลื่อนที่ สัญญาณ แสง ทาง คลินิก ข้อมูล ติดตาม วัด ลด เพิ่ม จำกัด ปรับปรุง อธิบาย แทนที่ ทำนาย ความแม่นยำ ความหน่วง เสถียรภาพ คุณภาพ ภาพ หน่วย หน่วยความจำ ความจำ เวลา ฝึกสอน เวลาฝึกสอน พลังงาน ใช้ อัตรา ความผิดพลาด ภาระ สูง ต่ำ ต้นทุน ทุก พื้นที่ ภาคสนาม การสอบเทียบ ไม่ ต้อง ปรับ มือ ฉบับ ครั้ง ราย ตัวอย่าง แสดง แสดงว่า คน วัน ปี เดือน มี ได้ ให้ จะ ถูก มาก น้อย กว่า".split()
# Common words of three other scripts, by the part they play at a gap.
LAO_OPEN = "ນອກຈາກນີ້ ດັ່ງນັ້ນ ຢ່າງໃດກໍຕາມ ຫຼັງຈາກນັ້ນ ພວກເຮົາ ຂ້າພະເຈົ້າ ທ່ານ ການທົດລອງ ຜົນ".split()
LAO_JOIN = "ແລະ ຫຼື ແຕ່ ທີ່ ຊຶ່ງ ເພາະ ກັບ ວ່າ ຂອງ ໃນ ໂດຍ ເປັນ ຄື ຈຶ່ງ ຕໍ່".split()
LAO_FINAL = "ແລ້ວ ເດີ ບໍ ນໍ ເນາະ ແດ່ ໄດ໋".split()
KHMER_OPEN = "ដូច្នេះ លើសពីនេះ ទោះយ៉ាងណា បន្ទាប់មក យើង ខ្ញុំ គាត់ ការពិសោធន៍ លទ្ធផល".split()
KHMER_JOIN = "និង ឬ ប៉ុន្តែ ដែល ព្រោះ ពីព្រោះ ជាមួយ ថា របស់ ក្នុង ដោយ ជា គឺ ដើម្បី".split()
KHMER_FINAL = "ហើយ ទេ ណា ផង ចុះ".split()
BURMESE_OPEN = "ထို့ကြောင့် ထို့ပြင် သို့သော် ထို့နောက် ကျွန်ုပ်တို့ ကျွန်တော် သူ ရလဒ်".split()
BURMESE_JOIN = "နှင့် သို့မဟုတ် ကြောင့် ၏ တွင် ဖြင့် အတွက် ဟု".split()
BURMESE_FINAL = "သည် တယ် မည် မယ် ပါသည် ပါတယ် ဘူး လား ပြီ".split()


class Dictionary:
    """Words of one script by the part they play at a gap; ``cuts``: whether a gap without any sign ends a sentence."""

    def __init__(self, opening: list[str], joining: list[str], final: list[str], other: list[str] = (), cuts: bool = False):
        self.opening, self.joining, self.final, self.cuts = tuple(opening), frozenset(joining), frozenset(final), cuts
        self.words = frozenset([*opening, *joining, *final, *other])
        self.longest = max(map(len, self.words), default=1)


DICTIONARIES = {
    "thai": Dictionary(THAI_OPEN, THAI_JOIN, THAI_FINAL, THAI_OTHER, cuts=True), "lao": Dictionary(LAO_OPEN, LAO_JOIN, LAO_FINAL),
    "khmer": Dictionary(KHMER_OPEN, KHMER_JOIN, KHMER_FINAL), "burmese": Dictionary(BURMESE_OPEN, BURMESE_JOIN, BURMESE_FINAL),
}


def script_of(c: str) -> str:
    return "thai" if c < "\u0e80" else "lao" if c < "\u0f00" else "burmese" if c < "\u1100" else "khmer"


def lattice(run: str, words: frozenset[str], longest: int = 24) -> list[str]:
    """The run cut into words: fewest letters outside the dictionary, then fewest words."""
    n = len(run)
    best: list[tuple[int, int, int]] = [(0, 0, 0)] + [(1 << 30, 0, 0)] * n
    for i in range(n):
        unknown, count, _ = best[i]
        step = (unknown + 1, count + 1, i)
        if step < best[i + 1]:
            best[i + 1] = step
        for j in range(i + 2, min(n, i + longest) + 1):
            if run[i:j] in words:
                step = (unknown, count + 1, i)
                if step < best[j]:
                    best[j] = step
    out, j = [], n
    while j:
        i = best[j][2]
        out.append(run[i:j])
        j = i
    return out[::-1]


RUN = re.compile(r"[฀-໿ក-៿က-႟.]+")


def spaceless(text: str, lo: int, hi: int, dictionaries: dict[str, Dictionary]) -> list[int]:
    """Boundaries (ends of sentences) at the gaps of a paragraph in a script without full stops."""
    cuts = []
    runs = [(lo + m.start(), lo + m.end()) for m in RUN.finditer(text[lo:hi])]
    ends, starts = {e: s for s, e in runs}, dict(runs)
    known: dict[int, list[str]] = {}

    def cut(s: int, e: int, d: Dictionary) -> list[str]:
        """Words of the run from s to e, found once."""
        if s not in known:
            known[s] = lattice(text[s:e], d.words, d.longest)
        return known[s]

    for m in re.finditer(r"\s+", text[lo:hi]):
        a, b = lo + m.start(), lo + m.end()
        before = text[a - 1]
        left, right = ends.get(a), starts.get(b)
        if before in "!?។။ฯ":
            cuts.append(a)
            continue
        d = dictionaries[script_of(text[b] if right is not None else before)]
        opens = right is not None and text.startswith(d.opening, b)
        if left is None:  # a number or a foreign word before the gap: the phrase goes on unless a strong opening follows
            if right is not None and text.startswith(d.opening[:6], b) and not before.isdigit():
                cuts.append(a)
            continue
        if right is None or before == ".":  # a number or a foreign word follows, or an abbreviation precedes
            continue
        first = cut(b, right, d)[0]
        last = cut(left, a, d)[-1]
        if last in d.final and last != "ด้วย":
            cuts.append(a)
        elif last in d.joining or (first in d.joining and not opens):
            continue
        elif opens or d.cuts:
            cuts.append(a)
    return cuts


def word_before(text: str, lo: int, i: int) -> tuple[str, int]:
    """The word that ends at i, without opening marks, and where it starts."""
    k = i
    while k > lo and not text[k - 1].isspace() and text[k - 1] not in "(\"“„«‹「『（[—–/":
        k -= 1
    return text[k:i], k


def opens(text: str, j: int, hi: int) -> bool:
    """Whether a sentence of a cased script could start at j."""
    while j < hi and text[j] in "\"“„«‹([¿¡'‘—–- *•":
        j += 1
    if j >= hi:
        return False
    c = text[j]
    return not c.islower() or (j + 1 < hi and text[j + 1].isupper())


def full_stop(text: str, lo: int, hi: int, i: int, j: int) -> bool:
    """Whether the full stop at i, whose gap ends at j, ends a sentence."""
    word, k = word_before(text, lo, i)
    low = word.lower()
    nxt = text[j]
    if low in NEVER:
        return False
    if low in NUMBERED:
        if nxt.isdigit():
            return False
        if low not in PERHAPS and len(low) > 1 and low not in ("s", "no", "app", "para", "art"):
            return False
    head = text[lo:k].rstrip()
    if len(word) == 1 and word.isalpha():
        number = bool(head) and (head[-1].isdigit() or head[-1] == "%")
        if CJK.match(word):
            return True
        if word == "д" and head.endswith("т."):
            return True
        if not number:
            return False
    if low in PERHAPS:
        return True
    if word.isdigit() and len(word) <= 2:
        prior = re.search(r"(\S+)$", head)
        follow = re.match(r"[^\W\d_]+", text[j:hi])
        if prior and follow and prior[1].lower() in BEFORE_ORDINAL and follow[0].lower() in MONTHS:
            return False
        if follow and follow[0].lower() in MONTHS and follow[0].lower() not in ("mal", "tag", "rang", "platz"):
            return False
    return True


OPEN_COST = 3.0  # of a sentence for each mark it leaves open
FAMILY = {c: k for k, (o, z) in enumerate([("“„", "”“"), ("«", "»"), ("‹", "›"), ("「", "」"), ("『", "』"), ("（(", "）)"), ("【", "】")]) for c in o}
CLOSE_FAMILY = {"”": 0, "»": 1, "›": 2, "」": 3, "』": 4, "）": 5, ")": 5, "】": 6}


def marks(text: str, lo: int, hi: int) -> list[tuple[int, int, tuple[int, ...], int]]:
    """(start, end, how many marks of each family are open behind it, where the mark that it closes was opened) of every
    end mark, quotation mark and bracket; -1 for no opening."""
    depth = [0] * 8  # the last: straight quotation marks
    opened: list[list[int]] = [[] for _ in range(8)]
    out = []
    for m in MARK.finditer(text, lo, hi):
        i, j = m.span()
        t, at = m[0], -1
        if t == '"':
            if depth[7]:
                at, depth[7] = opened[7].pop(), 0
            else:
                opened[7].append(i)
                depth[7] = 1
        elif t == "“" and "„" in text[lo:i] and opened[0] and text[opened[0][-1]] == "„":
            at = opened[0].pop()
            depth[0] -= 1
        elif t in FAMILY:
            opened[FAMILY[t]].append(i)
            depth[FAMILY[t]] += 1
        elif t in CLOSE_FAMILY:
            k = CLOSE_FAMILY[t]
            if opened[k]:
                at = opened[k].pop()
                depth[k] -= 1
            elif k != 5:  # a list mark such as 1) closes nothing
                depth[k] -= 1
        out.append((i, j, tuple(depth), at))
    return out


def behind(text: str, i: int, j: int, lo: int, hi: int) -> tuple[int, float] | None:
    """(where the sentence would end, weight) of an end mark from i to j; None if none can end there."""
    e = j
    while e < hi and text[e] in "’'" and (e + 1 >= hi or text[e + 1].isspace()):
        e += 1
    r = REFERENCE.match(text, e, hi)
    e = r.end() if r else e
    if e >= hi:
        return None
    t, c = text[i:j], text[e]
    k = e
    while k < hi and text[k].isspace():
        k += 1
    if t.strip(".…") == "" and len(t) > 1 or "…" in t:
        good = c.isspace() and k < hi and text[k].isupper() or (c == "\n" and not text[k : k + 1].islower())
    elif any(x in OWN_STOP for x in t) or any(x in SOUTH_STOP for x in t):
        good = True
    elif c.isspace():
        good = k < hi and opens(text, k, hi) and (t != "." or full_stop(text, lo, hi, i, k))
    elif i > lo and CJK.match(text[i - 1]) and (CJK.match(c) or c in "（「“"):
        good = True
    elif c.isupper() and i > lo and (text[i - 1].islower() or text[i - 1] in "%)]") and (e + 1 >= hi or text[e + 1].islower() or text[e + 1].isspace()):
        # no space behind the end mark
        word, _ = word_before(text, lo, i)
        good = "." not in word and "/" not in word and "@" not in word and len(word) > 1 and word.lower() not in NEVER
    else:
        return None
    return e, 1.0 if good else -1.0


def closed(text: str, i: int, j: int, opened: int, lo: int, hi: int) -> tuple[int, float] | None:
    """The same for a closing mark behind an end mark."""
    if not (text[i - 1] in ".!?…。！？．｡।؟" or (text[i - 1].isspace() and text[lo:i].rstrip()[-1:] in ".!?…。！？।؟")):
        return None
    e = j
    while e < hi and text[e] in CLOSERS:
        e += 1
    r = REFERENCE.match(text, e, hi)
    e = r.end() if r else e
    if e >= hi:
        return None
    c = text[e]
    if text[i] in "）」』】" or CJK.match(c) or text[i - 1] in OWN_STOP:
        if c in "とっ、，,；;でにをがはも" and text[i] in "」』":
            return None
        head = text[lo:opened].rstrip() if opened >= 0 else "x"
        first = not head or head[-1] in ".!?…。！？．｡」』”]）"
        return e, 1.0 if first or c.isspace() or c in "（「『“" else -1.0
    if not c.isspace():
        return None
    k = e
    while k < hi and text[k].isspace():
        k += 1
    return e, 1.0 if k < hi and opens(text, k, hi) and text[k] not in "—–-,;" else -1.0


def boundaries(text: str, lo: int, hi: int) -> list[int]:
    """Ends of sentences of a paragraph: the best path through its lattice."""
    nodes: list[tuple[int, float, tuple[int, ...]]] = []
    zero = (0,) * 8
    state = zero
    for i, j, depth, opened in marks(text, lo, hi):
        t = text[i:j]
        if t[0] in MARKS_OF_PAIRS:
            found = closed(text, i, j, opened, lo, hi) if opened >= 0 else None
        else:
            found = behind(text, i, j, lo, hi)
        state = depth
        if found is not None and found[1] > 0:
            nodes.append((found[0], found[1], state))
    # best path to each node; earlier nodes with the same marks open differ in their value only
    best: dict[tuple[int, ...], tuple[float, int]] = {zero: (0.0, -1)}
    back, value = [], []
    for n, (_, weight, open_) in enumerate(nodes):
        score, prior = max(((v - OPEN_COST * sum(abs(x - y) for x, y in zip(open_, o)), p) for o, (v, p) in best.items()), key=lambda z: z[0])
        back.append(prior)
        value.append(score + weight)
        if open_ not in best or value[n] >= best[open_][0]:
            best[open_] = (value[n], n)
    score, n = max(((v - OPEN_COST * sum(abs(x - y) for x, y in zip(state, o)), p) for o, (v, p) in best.items()), key=lambda z: z[0])
    cuts = []
    while n >= 0:
        cuts.append(nodes[n][0])
        n = back[n]
    return sorted(set(cuts))


MARKS_OF_PAIRS = set("\"“”„«»‹›「」『』（）()【】")


def pieces(text: str) -> Iterator[tuple[int, int]]:
    """Paragraphs and headings: ranges that no sentence crosses."""
    at = 0
    for m in [*PARAGRAPH.finditer(text), None]:
        lo, hi = at, m.start() if m else len(text)
        at = m.end() if m else at
        if "\n" not in text[lo:hi]:
            yield lo, hi
            continue
        begin = line = lo
        rows = text[lo:hi].split("\n")
        fresh = True  # the line before ended a sentence, or there is none
        for n, row in enumerate(rows):
            bare = row.strip()
            nxt = rows[n + 1].strip() if n + 1 < len(rows) else ""
            if fresh and LINE_HEADING.match(bare) and bare[-1] not in ".!?:;,。！？-" and (not nxt or not nxt[0].islower()) and len(bare.split()) <= 9 and len(bare) < 60:
                if line > begin:
                    yield begin, line
                yield line, line + len(row)
                begin = line + len(row)
                fresh = True
            elif bare:
                fresh = bare[-1] in ".!?。！？।؟\"”»)]"
            line += len(row) + 1
        if begin < hi:
            yield begin, hi


def split(text: str, dictionaries: dict[str, Dictionary] = DICTIONARIES) -> list[tuple[int, int]]:
    """(start, end) of each sentence, outer white space left out."""
    out: list[tuple[int, int]] = []
    for lo, hi in pieces(text):
        while hi > lo and text[hi - 1].isspace():
            hi -= 1
        if hi <= lo:
            continue
        part = text[lo:hi]
        if SPACELESS.search(part) and len(SPACELESS.findall(part)) * 3 > len(part):
            while text[lo].isspace():
                lo += 1
            cuts = spaceless(text, lo, hi, dictionaries)
        else:
            cuts = boundaries(text, lo, hi)
        s = lo
        for e in [*cuts, hi]:
            a, b = s, e
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if b > a:
                out.append((a, b))
            s = e
    return out


def sentences(texts: DataFrame, dictionaries: dict[str, Dictionary] = DICTIONARIES) -> DataFrame:
    """(origin, row_id, start_char, end_char) of every sentence; ``texts``: origin, row_id, text."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            origin, ids, lo, hi = [], [], [], []
            for o, r, t in zip(b["origin"], b["row_id"], b["text"]):
                spans = split(t, dictionaries)
                origin += [o] * len(spans)
                ids += [r] * len(spans)
                lo += [s for s, _ in spans]
                hi += [e for _, e in spans]
            yield pd.DataFrame({"origin": origin, "row_id": np.array(ids, dtype=np.int64), "start_char": np.array(lo, dtype=np.int32), "end_char": np.array(hi, dtype=np.int32)})

    return texts.select("origin", "row_id", "text").where("row_id is not null and text is not null and text <> ''").mapInPandas(scan, "origin string, row_id long, start_char int, end_char int")
