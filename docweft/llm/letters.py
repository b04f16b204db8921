"""Words of many texts at once, as numpy arrays over their code points."""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np

_TABLE = 0x30000
# Script ranges (first, last code point); letters outside all of them are "other", script 0.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2A6DF)],
    "hangul": [(0xAC00, 0xD7AF)],
}


class Words(NamedTuple):
    """Lower-case letters of all words in a row, and where words and texts begin."""

    letters: np.ndarray  # code points
    word_at: np.ndarray  # first letter of each word
    sizes: np.ndarray  # letters per word
    text_of: np.ndarray  # text of each word
    starts: np.ndarray  # place of each word in its text
    script: np.ndarray  # script of each word's first letter


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(_TABLE, dtype=np.uint32)
    letter = np.zeros(_TABLE, dtype=bool)
    for c in range(_TABLE):
        char = chr(c)
        if char.isalpha():
            letter[c] = True
            small = char.lower()
            if len(small) == 1:
                lower[c] = ord(small)
    script = np.zeros(_TABLE, dtype=np.int64)
    for number, ranges in enumerate(SCRIPTS.values(), start=1):
        for low, high in ranges:
            script[low : high + 1] = number
    return lower, letter, script


def words_of(texts: list[str]) -> Words:
    lower, letter, script = _tables()
    points = np.frombuffer("\x00".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    points = np.minimum(points, _TABLE - 1)
    is_letter = letter[points]
    at = np.flatnonzero(is_letter)
    inside = np.zeros(len(points) + 1, dtype=bool)
    inside[1:] = is_letter
    first = np.flatnonzero(is_letter & ~inside[:-1])
    word_at = np.searchsorted(at, first)
    sizes = np.diff(np.append(word_at, len(at)))
    begins = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    text_of = np.searchsorted(begins, first, side="right") - 1
    return Words(lower[points[at]], word_at, sizes, text_of, first - begins[text_of], script[points[first]])
