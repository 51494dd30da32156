"""Column functions for cleaning, normalising and counting text. All stay inside codegen.

Every function maps null to null unless its docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuswright.lexicon import WIDE_LETTERS

# Elements whose content is noise, and elements that end a line.
NOISE_TAGS = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript", "iframe", "svg")
BLOCK_TAGS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "br", "section", "article", "table")
# Character entities and what they stand for; the ampersand comes last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&ndash;", "-"), ("&mdash;", "-"), ("&amp;", "&"))
WORD = r"[\p{L}\p{N}_]+"
TERM = r"[\p{L}\p{N}][\p{L}\p{N}_-]*[\p{L}\p{N}_]"


def unescape(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def clean_html(html: Column, noise: tuple[str, ...] = NOISE_TAGS, blocks: tuple[str, ...] = BLOCK_TAGS) -> Column:
    """Text of a page: noise elements and comments gone, a line for each block, tags stripped."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in noise:
        text = F.regexp_replace(text, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{'|'.join(blocks)})(?:\s[^>]*)?/?>", "\n")
    text = unescape(F.regexp_replace(text, r"<[^>]+>", " "))
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r" *\n\s*", "\n"), r"^\s+|\s+$", "")


def strip_markup(text: Column) -> Column:
    """One line: entities first, then tags, then white space (titles and abstracts of patents)."""
    return squeeze(F.regexp_replace(unescape(text), r"<[^>]+>", " "))


def looks_like_html(text: Column) -> Column:
    return text.rlike(r"<[A-Za-z][^>]{0,50}>")


def squeeze(text: Column) -> Column:
    """White space to single blanks, none outside."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# Characters of the Unicode class Zs.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def squeeze_plain(text: Column) -> Column:
    """As ``squeeze``, with DuckDB's white space: no vertical tab inside, no blank of any width outside."""
    return F.trim(F.regexp_replace(text, r"[\t\n\f\r ]+", " "), F.lit(BLANKS))


def squeeze_lines(text: Column) -> Column:
    """White space within lines to single blanks, at most one blank line between paragraphs."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n\s*\n\s*", "\n\n"))


def title_key(title: Column) -> Column:
    """Letters a to z and digits of the lower-cased title; '' for null. Other scripts collapse to ''."""
    return F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]", "")


def unicode_title_key(title: Column) -> Column:
    """Letters and digits of any script, lower-cased; '' for null."""
    return F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}]", "")


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null and blank."""
    plain = squeeze(F.coalesce(text, F.lit("")))
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, " ")))


def token_estimate(text: Column) -> Column:
    """floor(1.15 * words), at least 1; 0 for null and blank. Binary doubles, as stated."""
    words = word_count(text)
    return F.when(words == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(words * F.lit(1.15).cast("double")).cast("int")))


def words(text: Column) -> Column:
    """Lower-case words of any script, in order; [] for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def terms(text: Column, stop: tuple[str, ...], least: int = 2) -> Column:
    """Words of at least ``least`` (two or more) letters, digits, low lines and inner hyphens that are no stop words, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= least) & ~w.isin(*stop))


def wide_as_letter(text: Column) -> Column:
    """Lower case, letters beyond ASCII replaced by one, so that word boundaries are those of any script; '' for null."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WIDE_LETTERS, "x")


def mark_sentences(text: Column) -> Column:
    """Sentences by a portable rule: an end mark behind a non-digit, white space, a capital."""
    marked = F.regexp_replace(text, r"([^0-9\s][.!?])\s+(\p{Lu})", "$1\u0001$2")
    return F.split(marked, "\u0001")


def period_pieces(text: Column, longer_than: int = 30) -> Column:
    """Pieces between full stops, trimmed, longer than a bound."""
    return F.filter(F.transform(F.split(text, r"\."), lambda s: F.trim(s)), lambda s: F.length(s) > longer_than)


def ascii_safe(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def escape_markup(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def slug(text: Column, longest: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), 1, longest)


def unfence(text: Column) -> Column:
    """A JSON answer without the fence of a code block around it."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?s)^```[a-z]*\s*|\s*```$", ""))


def patent_key(number: Column) -> Column:
    """Last path segment, letters and digits, upper case; a language tail such as /en is skipped."""
    tail = F.regexp_replace(F.coalesce(number, F.lit("")), r"/[a-z]{2}$", "")
    return F.upper(F.regexp_replace(F.substring_index(tail, "/", -1), "[^A-Za-z0-9]", ""))


def valid_patent_key(key: Column) -> Column:
    """Office of two letters, digits and an optional kind code."""
    return key.rlike("^(?:US|EP|WO|CN|JP|KR|DE|FR|GB|CA|AU|IN)[0-9]{4,}[A-Z]?[0-9]?$")


def patent_url(key: Column, base: str = "https://patents.example/patent/") -> Column:
    return F.concat(F.lit(base), key, F.lit("/en"))


def quoted(text: Column) -> Column:
    """Percent-encoded for an address; blanks as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


# Offices whose documents a registry shows, and the registry's name and address.
REGISTRIES = (
    (("US",), "USPTO Public Search", "https://ppubs.uspto.gov/pubwebapp/external.html?q={}&db=USPAT"),
    (("EP", "WO", "DE", "GB", "FR", "CN", "JP", "KR", "CA", "NL"), "Espacenet", "https://worldwide.espacenet.com/patent/search?q=pn%3D{}"),
)


def registry_links(key: Column) -> Column:
    """map registry -> address of a patent key: the open index always, the office's own registry where there is one; empty for ''."""
    pairs = [F.struct(F.lit("Google Patents").alias("n"), F.concat(F.lit("https://patents.google.com/patent/"), key, F.lit("/en")).alias("u"))]
    for offices, name, address in REGISTRIES:
        left, right = address.split("{}")
        pairs.append(F.when(F.substring(key, 1, 2).isin(*offices), F.struct(F.lit(name).alias("n"), F.concat(F.lit(left), key, F.lit(right)).alias("u"))))
    pairs.append(F.struct(F.lit("Lens.org").alias("n"), F.concat(F.lit("https://www.lens.org/lens/patent/"), key).alias("u")))
    return F.when(key == "", F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(F.array_compact(F.array(*pairs))))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def source_label(url: Column, rules: tuple[tuple[str, str], ...], other: str) -> Column:
    """Label of the first rule whose part occurs in the address."""
    out = None
    for part, label in rules:
        out = F.when(url.contains(part), label) if out is None else out.when(url.contains(part), label)
    return out.otherwise(other)


def year_of(text: Column) -> Column:
    """Year in the first four characters, null if they are no digits."""
    return F.when(F.substring(text, 1, 4).rlike("^[0-9]{4}$"), F.substring(text, 1, 4).cast("int"))


# Abbreviations and initials whose full stop ends no sentence.
ABBREVIATION = r"(^|[^\p{L}\p{N}_])(e\.g|i\.e|et al|vs|cf|Fig|Figs|Eq|Eqs|Sec|No|Dr|Prof|Mr|Mrs|Ms|St|approx|resp|[A-Z])\.(\s)"


def live_sentences(text: Column, fewest: int = 3) -> Column:
    """Sentences as the live pipeline takes them: ends of sentences in front of a capital, digit or quotation mark; pieces of
    fewer than ``fewest`` words that start with no capital and hold no number or sign join the sentence before;
    of the rest those with two words or some letter or digit stay. [] for null and blank.

    Decimals, initials, abbreviations of one or two letters and enumerations do not end a sentence.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    # an end mark that an abbreviation, an initial or a number explains is set aside for the time of the split
    kept = t
    for _ in range(2):  # neighbours share the blank between them
        kept = F.regexp_replace(kept, ABBREVIATION, "$1$2\u0002$3")
    parts = F.split(F.regexp_replace(kept, r"([.!?][\"')\]]*)\s+([\"'(\[]?[\p{Lu}0-9])", "$1\u0001$2"), "\u0001")
    parts = F.filter(F.transform(parts, lambda p: F.trim(F.replace(p, F.lit("\u0002"), F.lit(".")))), lambda p: p != "")
    small = lambda p: (F.size(F.split(p, r"\s+")) < fewest) & ~p.rlike(r"^\p{Lu}") & ~p.rlike(r"[0-9=><+±%-]")
    joined = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda out, p: F.when((F.size(out) > 0) & small(p), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat_ws(" ", F.element_at(out, -1), p)))).otherwise(F.concat(out, F.array(p))),
    )
    return F.filter(joined, lambda p: (F.size(F.split(p, r"\s+")) >= 2) | p.rlike("[a-zA-Z0-9]"))


def ratio4(x: Column) -> Column:
    """Round half up to 4 places in plain double steps (equal in every engine)."""
    return F.floor(x * F.lit(10000.0) + F.lit(0.5)) / F.lit(10000.0)
