"""Words as the found queries define them: maximal runs of letters and digits, lower-cased."""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(r"[^\W_]+")
U64 = np.uint64


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the entropy of 64-bit keys over all bits (public splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x
