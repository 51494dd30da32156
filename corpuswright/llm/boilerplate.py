"""Main body of web pages: template deduction from equivalence classes.

Problem 1. Which non-blank lines of a page belong to the site and not to the article.

How it works
------------
1. Lines become *tokens*: the whole line, its sentences and menu items, its opening and closing, its skeleton
   of marks; numbers, user names and the site's own name are masked. Each is a 64-bit hash. A page is tokenised
   once; from then on only hashes move, never text.
2. Tokens of a host with the same occurrence vector over its pages form an equivalence class. The vector is kept
   as an order-free hash, so a class is a group-by and no list of pages is gathered. A frequent class is valid if
   its tokens keep their order on all pages and, unless it is the root (largest support), if it always stands in
   the same gap of the root. Root and nested valid classes are the host's template; the gap of the root with most
   prose is the slot of the article.
3. On each page the article's region is the stretch of largest score: prose counts by its length, template
   lines, lines outside the slot and repeated lines count against it.
4. Sites share their software, and what it inserts stands on some pages only. So the role of every token that
   repeats is learnt from all pages: how often it lies outside the regions found. Tokens of the article
   (headings, captions, stock sentences) hardly ever do. A token that occurs on pages of several languages in a mix
   that prose does not have is a template token as well. What follows a template line on all its pages tells
   whether its own slot holds links or the article.
5. With these roles the region of each page is found again: the slot between head and foot from the first line
   that is no template, without the template lines in it and without the link slots they open.

Tables that hold one row a host or a token join pages through hot-key splits; the template of a host has at most
twice the tokens of its average page, so its array is bounded by a page.

Defined results: null and empty texts give no row; a page without a readable address belongs to no host and has no
template of its own; a page without a language says nothing on the mix; a page without prose and without any other
line that is no template is outside as a whole, unless nothing in it is known; repeated rows of one section_id give
each line once; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswright.operators.skew import skew_join
from corpuswright.session import materialise, release

PIECE = re.compile(r"[぀-ヿ一-鿿]|[^\W\d_]+|\d+|[^\w\s]")
CJK = re.compile(r"[぀-ヿ一-鿿]")
USER = re.compile(r"\b[a-z]+\d+\b")
SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
ITEM = re.compile(r"\s{2,}|\s[|·/•]\s|\]\([^)]*\)\s*\[?|^\[|\]\([^)]*\)$")
INNER_END = re.compile(r"[.!?]\s+\S|[。！？]")
END = re.compile(r"[.!?。！？؟।][\"”’»)\]」』]*\s*$")
DIGIT = re.compile(r"\d")
NUMBER = re.compile(r"^\W*\d[\d.,]*\W*$")
# Marks inside phrases and numbers; they neither close an opening nor open a closing.
INNER_MARKS = set("-'’,.，、。・％%()（）+=")

# kinds of tokens, kept in the lowest three bits
WHOLE, OPENING, CLOSING, FIRST_WORDS, LAST_WORDS, SKELETON = range(6)
PROSE, NUMERIC, CONTINUED, TITLE = 1, 2, 4, 8


def token(kind: int, words: list[str]) -> int:
    h = xxhash.xxh64_intdigest(" ".join(words), seed=kind)
    return (h & ~7 | kind) - 2**63


def pieces(text: str) -> list[str]:
    return ["0" if p[0].isdigit() else p for p in PIECE.findall(text)]


def letters(text: str) -> int:
    """Length of a line; a character of a dense script counts twice."""
    return len(text) if text.isascii() else len(text) + len(CJK.findall(text))


@lru_cache(maxsize=65_536)
def line_tokens(low: str, ends: bool) -> tuple[int, tuple[tuple[int, int], ...], tuple[int, ...], int] | None:
    """(whole, ((sentence or item, its words), ...), openings and closings, skeleton) of a masked line; 0 for none."""
    all_pieces = pieces(low)
    if not all_pieces:
        return None
    whole = token(WHOLE, all_pieces)
    segments = []
    parts = [s for item in ITEM.split(low) for s in SENTENCE.split(item or "")]
    if parts == [low]:
        segments = [(whole, len(all_pieces))] if any(p[0].isalnum() for p in all_pieces) else []
    else:
        for s in parts:
            ps = pieces(s)
            if any(p[0].isalnum() for p in ps):
                segments.append((token(WHOLE, ps), len(ps)))
    edges = []
    first = next((i for i, p in enumerate(all_pieces[:6]) if not p[0].isalnum() and p not in INNER_MARKS), None)
    if first is not None and len(all_pieces) > first + 1:
        edges.append(token(OPENING, all_pieces[: first + 1]))
    long = ends and len(all_pieces) > 8 and not any(CJK.match(p) for p in all_pieces[:4])
    tail = all_pieces[:-1] if ends else all_pieces
    last = next((i for i in range(len(tail) - 1, max(len(tail) - 7, 0), -1) if not tail[i][0].isalnum() and tail[i] not in INNER_MARKS and tail[i] not in ":：”\""), None)
    if last is not None:
        edges.append(token(CLOSING, all_pieces[last:]))
    if long:
        edges += [token(FIRST_WORDS, all_pieces[:4]), token(LAST_WORDS, all_pieces[-5:])]
    bones: list[str] = []
    for p in all_pieces:
        b = p if p == "0" or not p[0].isalnum() else "*"
        if not bones or bones[-1] != b or b not in "*0":
            bones.append(b)
            if len(bones) > 9:
                break
    return whole, tuple(segments), tuple(edges), token(SKELETON, bones) if len(bones) <= 9 else 0


def page_host(url: str | None) -> tuple[str, str]:
    m = re.match(r"^[a-z][\w+.-]*://([^/?#:]+)", (url or "").strip().lower())
    host = m[1] if m else ""
    return host, host.split(".")[0]


def encoded(text: str, host: str, name: str) -> tuple[list[int], list[int], list[int]]:
    """(tokens, counts, code): the page's distinct tokens, how often each occurs, and its lines as numbers.

    A line is: number, flags, letters, place of its whole, n, n x (place of the segment, words), m, m x place of
    an edge, place of the skeleton; places refer to ``tokens``, -1 is none.
    """
    places: dict[int, int] = {}
    counts: list[int] = []

    def place(t: int) -> int:
        i = places.setdefault(t, len(counts))
        if i == len(counts):
            counts.append(0)
        counts[i] += 1
        return i

    code: list[int] = []
    before = ""  # the line right above
    lines = text.split("\n")
    for i, raw in enumerate(lines):
        line = raw.strip()
        if not line:
            before = ""
            continue
        low = line.lower()
        if host and name in low:
            low = low.replace(host, " HOST ").replace(name, " SITE ")
        if DIGIT.search(low):
            low = USER.sub("USER", low)
        ends = bool(END.search(line))
        size = letters(line)
        t = line_tokens(low, ends)
        below = USER.sub("USER", lines[i + 1].strip()) if i + 1 < len(lines) else ""
        flags = 0
        if (size >= 20 and ends) or (size >= 40 and (INNER_END.search(line) or below[:1].islower())) or (ends and before and low[0].islower() and line[0].islower()):
            flags |= PROSE
        if NUMBER.match(line):
            flags |= NUMERIC
        if len(before) >= 60 and not END.search(before) and not CJK.search(before) and (ends or SENTENCE.search(line)):
            flags |= CONTINUED
        if t is None:
            code += [i, flags, size, -1, 0, 0, -1]
        else:
            whole, segments, edges, bones = t
            if sum(n for _, n in segments) >= 4:
                flags |= TITLE
            code += [i, flags, size, place(whole), len(segments)]
            for s, n in segments:
                code += [place(s), n]
            code.append(len(edges))
            code += [place(e) for e in edges]
            code.append(place(bones) if bones else -1)
        before = line
    return list(places), counts, code


class Line:
    __slots__ = ("no", "flags", "size", "whole", "segments", "edges", "bones")


def lines_of(code: np.ndarray) -> list[Line]:
    out, c, at = [], code.tolist(), 0
    while at < len(c):
        line = Line()
        line.no, line.flags, line.size, line.whole, n = c[at : at + 5]
        at += 5
        line.segments = [(c[k], c[k + 1]) for k in range(at, at + 2 * n, 2)]
        at += 2 * n
        m = c[at]
        line.edges = c[at + 1 : at + 1 + m]
        line.bones = c[at + 1 + m]
        at += m + 2
        out.append(line)
    return out


def role_of(line: Line, role: dict[int, str]) -> str | None:
    """T (template), A (article) or None: the whole line decides, then its segments, then its edges."""
    r = role.get(line.whole)
    if r:
        return r
    words = sum(n for _, n in line.segments)
    share = lambda k: sum(n for s, n in line.segments if role.get(s) == k)
    if words and share("T") >= 0.6 * words:
        return "T"
    if any(role.get(e) == "T" for e in line.edges):
        return "T"
    if words and share("A") >= 0.6 * words:
        return "A"
    if role.get(line.bones) == "T":
        return "T"
    return "A" if any(role.get(e) == "A" for e in line.edges) else None


def largest(score: list[float]) -> tuple[int, int]:
    """First and last place of the stretch with the largest sum; (0, -1) if nothing is above 0."""
    best, lo, hi, now, start = 0.0, 0, -1, 0.0, 0
    for i, v in enumerate(score):
        if now <= 0:
            now, start = 0.0, i
        now += v
        if now > best:
            best, lo, hi = now, start, i
    return lo, hi


def region(lines: list[Line], role: dict[int, str], again: set[int], site: set[int], slot: tuple[int, int] | None, learnt: bool) -> tuple[int, int, set[int], list[str | None]]:
    """(first, last, more, kinds): the article's stretch, lines beyond it that belong to it, T, P or A of each line.

    ``again``: tokens that repeat over all pages; ``site``: those of the host's template; ``slot``: lines of the root's gap.
    """
    score, kinds = [], []
    for k, x in enumerate(lines):
        r = role_of(x, role)
        if r is None and x.whole in site:
            r = "T"
        prose = bool(x.flags & PROSE) and any(s not in again for s, _ in x.segments)
        if x.flags & CONTINUED and k and kinds[-1] == "P" and lines[k - 1].size >= 60:
            prose, r = True, None
        if r == "T":
            v = -0.5 if learnt else -1.0
        elif prose:
            v = max(1.5 if learnt else 0.0, min(6.0, x.size / 80))
        elif r == "A":
            v = 0.2
        elif x.flags & NUMERIC:
            v = 0.1
        elif x.whole in again:
            v = -0.5
        else:
            v = -0.3
        if slot is not None and not slot[0] < x.no < slot[1]:
            v = min(v, -0.5)
        score.append(v)
        kinds.append("T" if r == "T" else "P" if prose else "A" if r == "A" or x.flags & NUMERIC else None)
    lo, hi = largest(score)
    more: set[int] = set()
    if hi >= lo:
        # behind the stretch: what leads to further lines of the article, across at most two template lines
        waiting: list[int] = []
        missed = 0
        for k in range(hi + 1, len(lines)):
            if kinds[k] == "T":
                missed, waiting = missed + 1, []
            elif missed > 2:
                break
            else:
                waiting.append(k)
            if kinds[k] == "A" or (kinds[k] == "P" and not missed):
                more.update(waiting)
                waiting = []
        # above it: from the title on, the first line of the head that is no template
        free = [k for k in range(lo) if kinds[k] != "T" and lines[k].whole >= 0]
        titles = [k for k in free if lines[k].flags & TITLE]
        if titles:
            more.update(k for k in free if k >= (titles[0] if learnt else titles[-1]))
    return lo, hi, more, kinds


def slot_lines(lines: list[Line], root: list[int], gap: int) -> tuple[int, int] | None:
    """Numbers of the root's lines before and behind gap ``gap``."""
    spots = root_lines(lines, root)
    if not spots:
        return None
    return (spots[gap - 1] if gap else -1), (spots[gap] if gap < len(spots) else 1 << 30)


def root_lines(lines: list[Line], root: list[int]) -> list[int]:
    keep = set(root)
    return [x.no for x in lines if x.whole in keep]


def outside_lines(pages: DataFrame, least_pages: int = 3, share: float = 0.5, least_hosts: int = 3, least_mix: float = 0.08, least_share: float = 0.001) -> DataFrame:
    """(section_id, line_no) of every non-blank line of a page that is not part of its article.

    ``pages``: section_id, original_text, source_url, lang. A token repeats, and can have a role, from ``least_share``
    of all pages on (``least_pages`` at least): in a larger collection more prose repeats by chance.
    """
    base = pages.select("section_id", "original_text", "source_url", F.lower(F.substring(F.trim(F.coalesce("lang", F.lit(""))), 1, 2)).alias("lang")).where("section_id is not null and original_text is not null")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sid, text, url, lang in zip(b["section_id"], b["original_text"], b["source_url"], b["lang"]):
                host, name = page_host(url)
                tokens, counts, code = encoded(text, host, name)
                if code:
                    key = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=sid & (2**63 - 1)) - 2**63
                    out.append((sid, key, xxhash.xxh64_intdigest(host) - 2**63 if host else 0, lang, tokens, counts, code))
            yield pd.DataFrame(out, columns=["section_id", "page", "host", "lang", "tokens", "counts", "code"])

    read = materialise(base.mapInPandas(scan, "section_id long, page long, host long, lang string, tokens array<long>, counts array<int>, code array<int>"), "pages")

    # how often each token occurs on the pages of a host (0: no host); combined before the shuffle
    seen = read.select("page", "host", F.explode(F.arrays_zip("tokens", "counts")).alias("t")).select("page", "host", F.col("t.tokens").alias("token"), F.col("t.counts").alias("n"))
    by_host = materialise(seen.groupBy("token", "host").agg(F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count("*").alias("support")), "tokens")
    pages_in_all = read.count()
    enough = max(least_pages, least_share * pages_in_all)
    known = by_host.groupBy("token").agg(F.sum("support").alias("pages"), F.count_if(F.col("host") != 0).alias("hosts")).where(F.col("pages") >= enough)
    known = materialise(known, "known")
    repeats = known.agg(F.sum("pages")).first()[0] or 0

    # templates of hosts: frequent classes, at most 1 / share times the tokens of an average page
    sizes = read.where("host <> 0").groupBy("host").agg(F.count("*").alias("weight")).where(F.col("weight") >= least_pages)
    sizes = materialise(sizes, "hosts")
    often = by_host.where((F.col("host") != 0) & (F.col("support") >= least_pages)).join(sizes, "host").where(F.col("support") >= share * F.col("weight"))
    often = often.groupBy("host", "weight").agg(F.collect_list(F.struct("token", "vector", "support")).alias("frequent"))
    often = materialise(often.select("host", "weight", F.col("frequent.token").alias("f_token"), F.col("frequent.vector").alias("f_class"), F.col("frequent.support").alias("f_support")), "frequent")

    def nest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each page: the order of every frequent class, its gap in the root, the prose of the root's gaps."""
        for b in batches:
            out = []
            for host, tokens, code, ft, fc, fs in zip(b["host"], b["tokens"], b["code"], b["f_token"], b["f_class"], b["f_support"]):
                root = root_class(ft, fc, fs)
                of = {t: c for t, c in zip(ft.tolist(), fc.tolist()) if t & 7 == WHOLE}
                place = {i: of[t] for i, t in enumerate(tokens.tolist()) if t in of}
                lines = lines_of(code)
                orders: dict[int, list[int]] = {}
                gaps: dict[int, list[int]] = {}
                prose: Counter = Counter()
                gap = 0
                for x in lines:
                    c = place.get(x.whole)
                    if c is None:
                        if x.flags & PROSE:
                            prose[gap] += x.size
                        continue
                    orders.setdefault(c, []).append(int(tokens[x.whole]))
                    gaps.setdefault(c, []).append(gap)
                    gap += c == root
                for c, o in orders.items():
                    g = gaps[c]
                    out.append((host, c, xxhash.xxh64_intdigest(np.array(o, dtype=np.int64).tobytes()) - 2**63, min(g), max(g), 0))
                # rows of gaps carry letters and no class
                out += [(host, 0, 0, g, g, n) for g, n in prose.items()]
            yield pd.DataFrame(out, columns=["host", "class", "order", "low", "high", "letters"])

    placed = skew_join(read.select("host", "tokens", "code"), often, ["host"], "weight", pages_in_all).mapInPandas(nest, "host long, class long, order long, low int, high int, letters long")
    placed = placed.groupBy("host", "class", F.when(F.col("letters") > 0, F.col("low")).alias("gap"))
    placed = materialise(placed.agg((F.min("order") == F.max("order")).alias("ordered"), (F.min("low") == F.max("high")).alias("nested"), F.sum("letters").alias("letters")), "placed")
    valid = placed.where("gap is null").groupBy("host").agg(F.collect_list(F.struct("class", "ordered", "nested")).alias("v"))
    main = placed.where("gap is not null").groupBy("host").agg(F.max_by("gap", F.struct("letters", -F.col("gap"))).alias("gap"))
    template = often.join(valid.select("host", F.col("v.class").alias("v_class"), F.col("v.ordered").alias("v_ordered"), F.col("v.nested").alias("v_nested")), "host").join(main, "host", "left")
    template = materialise(template, "templates")
    columns = ["f_token", "f_class", "f_support", "v_class", "v_ordered", "v_nested", "gap"]
    # a host without template keeps its pages: its row says so
    bare = read.select("host").distinct().join(template.select("host"), "host", "left_anti").join(read.groupBy("host").agg(F.count("*").alias("weight")), "host")
    template = materialise(template.unionByName(bare, allowMissingColumns=True), "templates")

    tokens = read.select("page", "lang", F.explode("tokens").alias("token"))
    marks = materialise(skew_join(tokens, known.select("token", F.col("pages").alias("weight")), ["token"], "weight", repeats), "marks")
    mixed = marks.where("lang <> ''").groupBy("token", "lang").agg(F.count("*").alias("n")).groupBy("token").agg(F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("minor"))
    mixed = mixed.where((F.col("all") >= enough) & (F.col("minor") >= 3) & (F.col("minor") >= least_mix * F.col("all"))).select("token", F.lit(True).alias("mixed"))
    again = marks.groupBy("page").agg(F.collect_set("token").alias("again"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of every repeated token: lines inside and outside of the regions, links and article behind it."""
        for b in batches:
            tally: dict[int, list[int]] = {}
            for row in b.itertuples(index=False):
                lines, site, slot = opened(row)
                repeated = places(row.tokens, row.again)
                lo, hi, more, kinds = region(lines, {}, repeated, site, slot, False)
                ts = row.tokens
                for k, x in enumerate(lines):
                    out = not (lo <= k <= hi or k in more)
                    for p in {x.whole, *(s for s, _ in x.segments), *x.edges, x.bones}:
                        if p in repeated:
                            tally.setdefault(int(ts[p]), [0, 0, 0, 0])[out] += 1
                    if k >= lo and kinds[k] in ("T", None) and x.whole in repeated and k + 1 < len(lines):
                        y = lines[k + 1]
                        if kinds[k + 1] == "P" or y.whole not in repeated:
                            tally.setdefault(int(ts[x.whole]), [0, 0, 0, 0])[2 + (kinds[k + 1] is None)] += 1
            yield pd.DataFrame([(t, *v) for t, v in tally.items()], columns=["token", "inside", "outside", "text", "links"])

    whole = skew_join(read.join(again, "page", "left"), template.select("host", "weight", *columns), ["host"], "weight", pages_in_all)
    whole = materialise(whole.select("section_id", "page", "tokens", "code", "again", *columns), "opened")
    release(read, by_host, often, placed, template)
    sums = whole.mapInPandas(learn, "token long, inside long, outside long, text long, links long").groupBy("token").agg(*[F.sum(c).alias(c) for c in ("inside", "outside", "text", "links")])
    kind = F.col("token").bitwiseAND(7)
    lies = F.col("outside") / (F.col("inside") + F.col("outside"))
    least = F.when(kind == SKELETON, 0.9).when(kind.isin(CLOSING, FIRST_WORDS, LAST_WORDS), 0.7).otherwise(0.45)
    words = ~kind.isin(SKELETON) & F.coalesce("mixed", F.lit(False))
    roles = sums.where("inside + outside > 0").join(known.where(F.col("hosts") >= least_hosts), "token").join(mixed, "token", "left")
    roles = roles.withColumn("role", F.when((lies >= least) | words, "T").when(lies <= 0.3, "A")).where("role is not null")
    roles = materialise(roles.select("token", "role", (F.col("links") > F.col("text")).alias("links"), F.col("pages").alias("weight")), "roles")
    mine = skew_join(marks.select("page", "token"), roles, ["token"], "weight", repeats).groupBy("page").agg(F.collect_set(F.struct("token", "role", "links")).alias("r"))
    mine = mine.select("page", F.col("r.token").alias("r_token"), F.col("r.role").alias("r_role"), F.col("r.links").alias("r_links"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, nos = [], []
            for row in b.itertuples(index=False):
                lines, site, slot = opened(row)
                repeated = places(row.tokens, row.again)
                role, links = {}, set()
                if row.r_token is not None:
                    at = {t: i for i, t in enumerate(row.tokens.tolist())}
                    for t, r, l in zip(row.r_token.tolist(), row.r_role.tolist(), row.r_links.tolist()):
                        role[at[t]] = r
                        if l:
                            links.add(at[t])
                lo, hi, more, kinds = region(lines, role, repeated, site, slot, True)
                listing = False
                for k, x in enumerate(lines):
                    if k in more:
                        continue
                    if not lo <= k <= hi or kinds[k] == "T":
                        gone, listing = True, lo <= k <= hi and x.whole in links
                    else:
                        # a line that the next one continues is text, not a link
                        runs_on = x.size >= 60 and k + 1 < len(lines) and lines[k + 1].flags & CONTINUED and kinds[k + 1] != "T"
                        gone = listing = listing and kinds[k] is None and not runs_on
                    if gone and (role or site or hi >= lo):
                        ids.append(row.section_id)
                        nos.append(x.no)
            yield pd.DataFrame({"section_id": np.array(ids, dtype=np.int64), "line_no": np.array(nos, dtype=np.int32)})

    return whole.join(mine, "page", "left").mapInPandas(extract, "section_id long, line_no int").distinct()


def root_class(tokens: np.ndarray, classes: np.ndarray, supports: np.ndarray) -> int | None:
    """The class of largest support, then of most lines."""
    lines = Counter(c for t, c in zip(tokens.tolist(), classes.tolist()) if t & 7 == WHOLE)
    support = dict(zip(classes.tolist(), supports.tolist()))
    return max(lines, key=lambda c: (support[c], lines[c], c), default=None)


def places(tokens: np.ndarray, some: np.ndarray | None) -> set[int]:
    if some is None:
        return set()
    keep = set(some.tolist())
    return {i for i, t in enumerate(tokens.tolist()) if t in keep}


def opened(row) -> tuple[list[Line], set[int], tuple[int, int] | None]:
    """Lines of a page, places of its host's template tokens, and the lines around the article's slot."""
    lines = lines_of(row.code)
    if row.f_token is None or row.v_class is None:
        return lines, set(), None
    root = root_class(row.f_token, row.f_class, row.f_support)
    good = {c for c, o, n in zip(row.v_class.tolist(), row.v_ordered.tolist(), row.v_nested.tolist()) if o and (n or c == root)}
    of = {t: c for t, c in zip(row.f_token.tolist(), row.f_class.tolist()) if c in good}
    site = {i: of[t] for i, t in enumerate(row.tokens.tolist()) if t in of}
    slot = None
    if root in good and row.gap is not None and row.gap == row.gap:
        slot = slot_lines(lines, [i for i, c in site.items() if c == root], int(row.gap))
    return lines, set(site), slot
