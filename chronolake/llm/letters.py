"""Texts as streams of folded letters."""

from __future__ import annotations

import unicodedata

import numpy as np

# Cyrillic and Greek letters that scans confuse with Latin ones of the same shape.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "с": "c", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ο": "o", "ν": "v", "υ": "u"}

_UNKNOWN = -1
_folds = np.full(0x110000, _UNKNOWN, np.int32)


def _fold(cp: int) -> int:
    """The folded letter of a code point, 0 for what is no letter (marks, digits, punctuation, blanks)."""
    for ch in unicodedata.normalize("NFKD", chr(cp)).casefold():
        if unicodedata.category(ch)[0] == "L":
            return ord(LOOKALIKES.get(ch, ch))
    return 0


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fold(points: np.ndarray) -> np.ndarray:
    """Folded letter of each code point: case, accents and look-alikes set aside; 0 where there is no letter."""
    out = _folds[points]
    if (out == _UNKNOWN).any():
        for cp in np.unique(points[out == _UNKNOWN]):
            _folds[cp] = _fold(int(cp))
        out = _folds[points]
    return out


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All letters of the texts in one array, and the place where each text's letters begin (one more at the end)."""
    texts = [t or "" for t in texts]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    folded = fold(code_points("".join(texts)))
    kept = folded > 0
    before = np.r_[0, np.cumsum(kept)]
    return folded[kept], before[np.r_[0, np.cumsum(lengths)]]
