"""Variant spellings of names: sharded trie join with edit automata and token permutations.

Problem 5. Strings that mean the same person or organisation.

How it works
------------
1. Only distinct strings go on, so copies cost nothing. Each is parsed into a *node*: the set of
   its full words, folded (case, accents, digraphs for umlauts), without titles, degrees, initials,
   legal forms and country marks; abbreviated kinds of organisation are spelled out. The set has no
   order, which is the check of token permutations. Stand-ins for a missing name are no node.
2. Nodes that agree in all words but one meet in the *shard* of the other words. The differing
   words of a shard form a trie, which an edit automaton (insertion, deletion, replacement,
   exchange of neighbours; one edit, two from eight letters on) walks for each word. A shard of
   many words is cut into blocks that meet pairwise in separate tasks.
   Two words that both stand in many names are two names and no typing error; many is a share of all names.
3. In the shard, known short forms of given names link as well, and a name with a short form also
   enters the shards of the names it may be short for.
4. Names with initials, and organisations named by brand word alone, link to the one entity that
   fits (initials, then middle initial; brand, then legal form); where several fit, to none.
5. Components of nodes are the entities.

Defined results: null, blank and stand-in names give no pair; a name without letters is no name;
a string links to itself never; equal strings from several columns count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswright.operators.graph import components
from corpuswright.operators.skew import skew_join
from corpuswright.session import materialise

# Strings that stand for no name.
STAND_INS = {
    "", "-", "--", "n/a", "na", "none", "null", "nil", "unknown", "unknown applicant", "unknown assignee", "unknown author", "unknown inventor",
    "anonymous", "not available", "not provided", "unassigned", "tbd", "?", "no author", "various", "et al", "et al.", "individual",
}
# Common short forms of given names beside those of the given table.
SHORT_FORMS = {
    "steve": ["stephen", "steven"], "greg": ["gregory"], "paco": ["francisco"], "chuck": ["charles"], "charlie": ["charles"], "lola": ["dolores"], "andy": ["andrew"],
    "sasha": ["alexander", "alexandra"], "alex": ["alexander", "alexandra"], "chris": ["christopher", "christian"], "misha": ["mikhail"], "jenny": ["jennifer"], "hans": ["johannes"],
    "becky": ["rebecca"], "debbie": ["deborah"], "beppe": ["giuseppe"], "gabe": ["gabriel"], "nick": ["nicholas"], "ben": ["benjamin"], "dave": ["david"], "pete": ["peter"],
    "kathy": ["katherine"], "katie": ["katherine"], "maggie": ["margaret"], "meg": ["margaret"], "beth": ["elizabeth"], "betty": ["elizabeth"], "rob": ["robert"], "rick": ["richard"],
    "rich": ["richard"], "will": ["william"], "ed": ["edward"], "eddie": ["edward"], "jimmy": ["james"], "johnny": ["john"], "joey": ["joseph"], "danny": ["daniel"], "pat": ["patricia"],
    "patty": ["patricia"], "susie": ["susan"], "vic": ["victoria"], "kolya": ["nikolai"], "vanya": ["ivan"], "pancho": ["francisco"], "nacho": ["ignacio"], "toni": ["anton", "antonia"],
}
# Legal forms and kinds of organisations with their abbreviations.
LEGAL = {
    "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "gmbh": "gmbh", "gesellschaft": "gmbh", "mbh": "gmbh", "ag": "ag", "aktiengesellschaft": "ag", "ltd": "ltd",
    "limited": "ltd", "llc": "llc", "co": "co", "company": "co", "sa": "sa", "societe": "sa", "anonyme": "sa", "plc": "plc", "bv": "bv", "nv": "nv", "kk": "kk", "oy": "oy", "ab": "ab", "spa": "spa", "srl": "srl",
}
KINDS = {
    "university": ["univ"], "institute": ["inst"], "technology": ["tech"], "technologies": ["tech"], "polytechnic": ["polytech", "poly"], "hospital": ["hosp"], "college": ["coll"], "research": ["res"],
    "centre": ["ctr", "center", "cent"], "laboratories": ["lab", "labs", "laboratory"], "biologics": ["biol"], "materials": ["matls", "mat", "mater"], "instruments": ["instr", "instrs"], "networks": ["netw", "nets"],
    "systems": ["sys", "syst"], "energy": ["ener", "engy"], "optics": ["opt"], "robotics": ["robot", "rob"], "motors": ["mot", "mtrs"], "foods": ["fds", "food"],
}
PUBLIC = {"university", "institute", "polytechnic", "hospital", "college", "research", "centre"}
KIND_OF = {a: k for k, v in KINDS.items() for a in v} | {k: k for k in KINDS}
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "phd", "md", "msc", "dipl", "ing", "jr", "sr", "ii", "iii", "mba", "bsc"}
FILLERS = {"the", "of", "for", "and", "de", "der", "la"}
SMALL = 10_000  # rows of a table of short forms
LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th"})


def fold(word: str) -> str:
    low = unicodedata.normalize("NFKD", word.lower().translate(LETTERS))
    low = "".join(c for c in low if not unicodedata.combining(c)).translate(LETTERS)
    return re.sub(r"([oua])e", r"\1", low)


def kind_of(word: str) -> str | None:
    k = KIND_OF.get(word)
    if k is None and len(word) >= 6:
        k = next((x for x in KINDS if abs(len(x) - len(word)) <= 1 and edits(x, word, 1)), None)
    return k


def parse(name: str | None) -> dict | None:
    """kind 'person' (words, initials), 'org' (brand words, kinds, legal form), or None."""
    if name is None or name.strip().lower() in STAND_INS or not any(c.isalpha() for c in name):
        return None
    plain = re.sub(r"\([^)]*\)", " ", name)
    flat = [fold(w) for w in re.findall(r"[^\W_]+", plain.replace(".", ""))]
    legal = sorted({LEGAL[w] for w in flat if w in LEGAL})
    rest = [w for w in flat if w not in LEGAL and w not in FILLERS]
    kinds = [kind_of(w) for w in rest]
    if "institute" in kinds:
        kinds = ["technology" if k == "technologies" else k for k in kinds]
    else:
        kinds = ["technologies" if k == "technology" else k for k in kinds]
    brand = sorted({w for w, k in zip(rest, kinds) if k is None})
    named = sorted({k for k in kinds if k})
    if legal or named or len(rest) == 1 and len(plain.split()) == 1:
        return {"kind": "org", "words": brand, "types": named, "legal": " ".join(legal), "initials": ""} if brand else None
    words, initials = [], []
    raw = re.findall(r"[^\W\d_]+", plain)
    shout = plain.upper() == plain
    for i, w in enumerate(raw):
        low = fold(w)
        if low in TITLES and len(raw) > 2:
            continue
        if len(w) == 1 or (len(w) <= 2 and w.isupper() and not shout and (i == len(raw) - 1 or i == 0)):
            initials += [c for c in low]
        else:
            words.append(low)
    if not words or (len(words) == 1 and not initials):
        return None if not words else {"kind": "org", "words": words, "types": [], "legal": "", "initials": ""}
    return {"kind": "person", "words": sorted(set(words)), "types": [], "legal": "", "initials": "".join(initials[:3])}


def edits(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` edits (with exchanges of neighbours) lead from a to b."""
    if abs(len(a) - len(b)) > most:
        return False
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1] <= most


def allowance(a: int, b: int) -> int:
    """Edits allowed between words of these lengths."""
    n = min(a, b)
    return 2 if n >= 8 else 1 if n >= 4 else 0


class Trie:
    """Words with their payloads; nodes know which lengths lie below, to cut walks short."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, payload) -> None:
        node = self.root
        for i, c in enumerate(word):
            span = node.get("span")
            left = len(word) - i
            node["span"] = (left, left) if span is None else (min(span[0], left), max(span[1], left))
            node = node.setdefault(c, {})
        node.setdefault("end", []).append((word, payload))

    def near(self, word: str, most: int) -> Iterator[tuple[str, object]]:
        """Entries within ``most`` edits, by a bit-parallel automaton: state r has bit i set if the
        path so far matches the first i letters with r edits."""
        n = len(word)
        mask: dict[str, int] = defaultdict(int)
        for i, c in enumerate(word):
            mask[c] |= 1 << i
        full, goal = (1 << n + 1) - 1, 1 << n
        start = [(1 << r + 1) - 1 & full for r in range(most + 1)]
        stack = [(self.root, start, [0] * (most + 1))]
        while stack:
            node, rows, held = stack.pop()
            if "end" in node and rows[most] & goal:
                yield from node["end"]
            for c, child in node.items():
                if len(c) > 1:
                    continue
                m = mask.get(c, 0)
                new, hold = [], []
                for r in range(most + 1):
                    state = (rows[r] & m) << 1
                    if r:
                        low, up = rows[r - 1], new[r - 1]
                        # replaced, inserted in the path, left out of the path, neighbours exchanged
                        state |= low << 1 | low | up << 1 | (held[r - 1] & m) << 2
                    new.append(state & full)
                    # letters i and i + 1 exchanged: this letter is the second, the next must be the first
                    hold.append(rows[r] & (m >> 1))
                if new[most]:
                    span = child.get("span", (0, 0))
                    low = new[most].bit_length() - 1
                    first = (new[most] & -new[most]).bit_length() - 1
                    if "end" in child or (span[0] <= n - first + most and span[1] >= n - low - most):
                        stack.append((child, new, hold))


def node_key(kind: str, words: list[str], types: list[str]) -> str:
    return kind[0] + ":" + " ".join(words) + ("|" + " ".join(types) if types else "")


def number(key: str) -> int:
    return xxhash.xxh64_intdigest(key) - 2**63


def distinct_names(papers: DataFrame, patents: DataFrame) -> DataFrame:
    """(name) of every distinct string in the four columns."""
    parts = [papers.select(F.explode("authors").alias("name")), patents.select(F.explode("inventors").alias("name")), patents.select(F.col("assignee").alias("name")), patents.select(F.col("applicant").alias("name"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("name is not null").distinct()


def entities(names: DataFrame, short_forms: DataFrame | None = None, block: int = 10_000, rare: float = 5e-5) -> DataFrame:
    """(name, entity) of each name that means somebody; ``names``: distinct strings in column name.

    Two words that differ by an edit are two names if both are common: in more than ``rare`` of all entries (two at
    least) each and neither ten times as often as the other.
    """
    forms = {k: set(v) for k, v in SHORT_FORMS.items()}
    if short_forms is not None:  # a small fixed table
        for r in short_forms.select("given_name", "short_form").where("given_name is not null and short_form is not null").limit(SMALL + 1).collect():
            if len(forms) > SMALL:
                raise ValueError(f"more than {SMALL} short forms")
            forms.setdefault(fold(r.short_form.strip()), set()).add(fold(r.given_name.strip()))
    forms = {fold(k): {fold(x) for x in v} for k, v in forms.items()}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name in b["name"]:
                p = parse(name)
                if p is None:
                    continue
                if p["kind"] == "person" and len(p["words"]) == 1:
                    form, key = "initials", f"i:{p['words'][0]} {p['initials']}"
                elif p["kind"] == "org" and not p["types"]:
                    form, key = "brand", f"b:{' '.join(p['words'])} {p['legal']}"
                else:
                    form, key = p["kind"], node_key(p["kind"], p["words"], p["types"])
                middle = p["initials"][:1] if form == "person" else ""
                out.append((name, number(key), form, p["words"], p["types"], p["legal"], p["initials"] if form == "initials" else middle))
            yield pd.DataFrame(out, columns=["name", "node", "form", "words", "types", "legal", "initials"])

    parsed = materialise(names.mapInPandas(read, "name string, node long, form string, words array<string>, types array<string>, legal string, initials string"), "names")
    full = parsed.where(F.col("form").isin("person", "org")).groupBy("node").agg(F.first("form").alias("form"), F.first("words").alias("words"), F.first("types").alias("types"))
    spots = full.select("node", "form", "types", F.posexplode("words").alias("i", "word"), "words")
    others = F.array_join(F.array_remove(F.col("words"), F.col("word")), " ")
    shard = F.concat_ws(":", "form", others, F.array_join("types", " "))
    spots = spots.select("node", "word", shard.alias("shard"), "form")
    # a short form also stands in the shards of the names it may be short for: its other word may be misspelt
    known = F.create_map(*[x for k, v in sorted(forms.items()) for x in (F.lit(k), F.array(*[F.lit(g) for g in sorted(v)]))])
    given = F.explode(known[F.element_at(F.split("shard", ":"), 2)])
    longer = spots.where("form = 'person' and shard not like '% %'").select("node", "word", given.alias("given"), "form")
    spots = materialise(spots.withColumn("own", F.lit(True)).unionByName(longer.select("node", "word", F.concat(F.lit("person:"), "given", F.lit(":")).alias("shard"), "form", F.lit(False).alias("own"))), "shards")
    degree = spots.where("own").groupBy("form", "word").agg(F.count("*").alias("degree"))
    sizes = spots.groupBy("shard").agg(F.count("*").alias("size")).where("size > 1")
    count = spots.count()
    rows = skew_join(spots, sizes.withColumn("weight", F.col("size")), ["shard"], "weight", count)
    rows = skew_join(rows, degree.withColumn("weight", F.col("degree")), ["form", "word"], "weight", count)
    blocks = F.ceil(F.col("size") / block).cast("int")
    rows = rows.withColumn("b", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least("b", j).alias("x"), F.greatest("b", j).alias("y")))
    cells = rows.select("shard", "node", "word", "degree", "form", F.explode(meets).alias("cell"))
    # entries after they went to the blocks they meet in: a crowded shard is spread over as many buckets as it needs
    buckets = max(32, (sizes.agg(F.sum(F.col("size") * F.ceil(F.col("size") / block))).first()[0] or 0) // 20_000)
    seldom = max(2.0, rare * count)
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64("shard", "cell"), F.lit(buckets)).cast("int"))
    # the walk costs far more than its bytes say: a stated number of partitions is not coalesced
    cells = cells.repartition(min(buckets, 20_000), "bucket")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby(["shard", pdf["cell"].map(lambda c: (c["x"], c["y"]))], sort=False) if len(pdf) else []:
            words = part["word"].tolist()
            person = part["form"].iat[0] == "person"
            items = list(zip(words, part["node"].tolist(), part["degree"].tolist()))
            trie = Trie()
            for w, node, d in items:
                trie.add(w, (node, d))
            for w, node, d in items:
                for x, (other, e) in trie.near(w, allowance(len(w), len(w))):
                    if other > node and w != x and edits(w, x, allowance(len(w), len(x))) and (min(d, e) <= seldom or max(d, e) >= 10 * min(d, e)):
                        out.append((node, other))
            if person:
                at = defaultdict(list)
                for w, node, _ in items:
                    at[w].append(node)
                for w, node, _ in items:
                    long = [n for g in forms.get(w, ()) for n in at.get(g, ())]
                    if len(set(long)) == 1:
                        out.append((node, long[0]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    links = materialise(cells.groupBy("bucket").applyInPandas(walk, "u long, v long").distinct(), "links")
    comp = components(links, "u", "v")
    comp = full.select("node").join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("entity"))
    comp = materialise(comp, "entities")

    # initials: surname and first initial must fit one entity; a known middle initial decides
    middles = parsed.where("form = 'person' and initials <> ''").groupBy("node").agg(F.min("initials").alias("middle"))
    persons = spots.where("form = 'person' and own").select("node", F.col("word").alias("given"), F.element_at(F.split("shard", ":"), 2).alias("surname"))
    persons = persons.join(comp, "node").join(middles, "node", "left").select("surname", F.substring("given", 1, 1).alias("first"), "entity", "middle")
    people = persons.groupBy("surname", "first", "entity").agg(F.min("middle").alias("middle"))
    short = parsed.where("form = 'initials'").select("node", F.col("words")[0].alias("surname"), F.substring("initials", 1, 1).alias("first"), F.substring("initials", 2, 1).alias("second")).distinct()
    fit = short.join(people, ["surname", "first"]).where("second = '' or middle is null or middle = second")
    fit = fit.withColumn("sure", F.expr("second <> '' and middle = second"))
    fit = only_one(fit)
    # brands: companies of the legal form named, else companies, else any organisation
    orgs = parsed.where("form = 'org'").select("node", F.array_join("words", " ").alias("brand"), "types", "legal").join(comp, "node")
    firms = orgs.groupBy("brand", "entity").agg(F.collect_set("legal").alias("legals"), F.max(F.size(F.array_intersect("types", F.array(*[F.lit(x) for x in sorted(PUBLIC)])))).alias("public"))
    brands = parsed.where("form = 'brand'").select("node", F.array_join("words", " ").alias("brand"), "legal").distinct()
    meet = brands.join(firms, "brand")
    meet = meet.withColumn("sure", F.expr("(legal <> '' and array_contains(legals, legal)) or (legal = '' and public = 0)")).where("not (legal <> '' and public > 0)")
    home = only_one(meet)

    leftover = parsed.select("node").distinct().join(comp, "node", "left_anti").join(fit.unionByName(home), "node", "left_anti")
    whole = comp.unionByName(fit).unionByName(home).unionByName(leftover.select("node", F.col("node").alias("entity")))
    return parsed.select("name", "node").join(whole, "node").select("name", "entity")


def only_one(fits: DataFrame) -> DataFrame:
    """(node, entity) where exactly one sure entity, or else exactly one at all, fits the node."""
    sure = F.when(F.col("sure"), F.col("entity"))
    found = fits.groupBy("node").agg(F.min(sure).alias("s"), F.max(sure).alias("t"), F.min("entity").alias("a"), F.max("entity").alias("b"))
    pick = F.when(F.col("s") == F.col("t"), F.col("s")).when(F.col("s").isNull() & (F.col("a") == F.col("b")), F.col("a"))
    return found.select("node", pick.alias("entity")).where("entity is not null")


def variant_pairs(named: DataFrame) -> DataFrame:
    """(name_a, name_b), smaller first by code point: all pairs of names of one entity."""
    a, b = named.withColumnRenamed("name", "name_a"), named.withColumnRenamed("name", "name_b")
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()
