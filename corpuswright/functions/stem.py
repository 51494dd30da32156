"""Word stems by Porter's published suffix rules, in the widespread variant that keeps four-letter -ies and -ied words apart.

``stemmed`` works on arrays of words in Arrow batches; each distinct word of a task is stemmed once.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and what they become, by step.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c not in "aeiou" and not (c == "y" and i > 0 and out[i - 1]))
    return out


def measure(stem: str) -> int:
    """Number of times a vowel is followed by a consonant."""
    c = consonants(stem)
    return sum(not a and b for a, b in zip(c, c[1:]))


def has_vowel(stem: str) -> bool:
    return not all(consonants(stem))


def short_end(stem: str) -> bool:
    """Consonant, vowel, consonant other than w, x and y; or vowel and consonant alone."""
    c = consonants(stem)
    if len(stem) >= 3:
        return c[-3] and not c[-2] and c[-1] and stem[-1] not in "wxy"
    return len(stem) == 2 and not c[0] and c[1]


def replaced(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    """The longest suffix that fits is replaced if what stays has a measure above 0."""
    for end, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(end):
            stem = word[: -len(end)]
            kept = stem + "l" if end == "logi" else stem
            return stem + new if measure(kept) > 0 else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of a lower-case word; words of up to three letters stay."""
    if len(word) <= 3:
        return word
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("ies"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        end = next((e for e in ("ed", "ing") if word.endswith(e) and has_vowel(word[: -len(e)])), None)
        if end:
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and consonants(word)[-1]:
                word = word if word[-1] in "lsz" else word[:-1]
            elif measure(word) == 1 and short_end(word):
                word += "e"
    if word.endswith("y") and len(word) > 2 and consonants(word)[-2]:
        word = word[:-1] + "i"
    word = replaced(replaced(word, STEP_2), STEP_3)
    end = next((e for e in sorted(STEP_4, key=len, reverse=True) if word.endswith(e)), None)
    if end and measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not short_end(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stemmed(words: Column) -> Column:
    """Array of stems of an array of words; null for null."""
    return F.pandas_udf(lambda s: s.map(lambda ws: None if ws is None else [stem(w) for w in ws]), "array<string>")(words)


def ascii_words(text: Column) -> Column:
    """Lower-case runs of a to z and digits, as the usual ROUGE implementation takes them; [] for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
