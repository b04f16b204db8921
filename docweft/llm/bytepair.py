"""Byte-level byte-pair vocabularies and the cutting of texts into pre-tokens.

Tokens are numbered here by the order in which merging makes them: 0 to 255 are
the bytes, 256 + r is the result of merge r. ``ids`` maps those numbers to the
ids of the vocabulary file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import regex

# Fixed value: the pre-token pattern of this vocabulary.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_chars() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file."""
    shown = {b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


_LEVEL = {b: char for char, b in byte_chars().items()}


def byte_level(text: str) -> str:
    """The text's UTF-8 bytes as the characters of a vocabulary file."""
    return text.encode("utf-8").decode("latin-1").translate(_LEVEL)


class Vocabulary:
    """Tokens, merges and special strings of one vocabulary file, given as text."""

    def __init__(self, source: str):
        data = json.loads(source)
        known = data["model"]["vocab"]
        chars = byte_chars()
        number = {char: b for char, b in chars.items()}
        self.tokens: list[bytes] = [bytes([b]) for b in range(256)]
        names = [""] * 256
        for char, b in chars.items():
            names[b] = char
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        for merge in data["model"]["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = number[left], number[right]
            made = len(self.tokens)
            if left + right in number:
                raise ValueError(f"two merges make the token {left + right!r}")
            number[left + right] = made
            names.append(left + right)
            self.pairs[a, b] = made
            self.halves.append((a, b))
            self.tokens.append(self.tokens[a] + self.tokens[b])
        self.ids = [known[name] for name in names]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        found = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self._special = re.compile(f"({found})") if found else None

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """The text cut at special strings: ``(is special, part)``."""
        if self._special is None or not any(s in text for s in self.special):
            if text:
                yield False, text
            return
        for part in self._special.split(text):
            if part:
                yield part in self.special, part

    def merged(self, word: bytes) -> list[int]:
        """Tokens of a short string, by merging the pair of lowest rank, leftmost first."""
        pairs, out = self.pairs, list(word)
        while len(out) > 1:
            ranks = [pairs.get(p, 1 << 60) for p in zip(out, out[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 60:
                break
            at = ranks.index(best)
            out[at : at + 2] = [best]
        return out


@cache
def vocabulary(source: str) -> Vocabulary:
    return Vocabulary(source)


def read_source(path: str | None) -> str:
    return Path(path or default_path()).read_text(encoding="utf-8")


def spaced(text: str) -> list[str] | None:
    """The text cut before its spaces, the space taken off, or ``None`` where that isn't safe.

    A pre-token can hold a space only at its start or in a run of white space, so
    single spaces are borders; runs and spaces at either end are not handled here.
    """
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return None
    return text.split(" ")
