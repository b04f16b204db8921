"""Column expressions over text: words, chunks, names, previews and templates."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The blanks that, like the space, separate words.
BLANKS = ("\t", "\r", "\n")
WORD_BREAK = "[ \\t\\r\\n]+"
# A citation of a preprint, its id in group 1, in any letter case.
CITATION = "(?i)arXiv:(\\d+\\.\\d+\\d*(?:v\\d+)?)\\b"
# What is dropped from a page before its text is read.
PAGE_BODIES = "(?is)<(script|style)[^>]*>.*?</(script|style)>"
PAGE_TAGS = "(?s)<[^>]*>"


def spaced(text: Column) -> Column:
    """A text in lower case whose blanks are all spaces."""
    out = F.lower(text)
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(" "))
    return out


def words(text: Column) -> Column:
    """Lower-cased words of a text, in order, without empty ones.

    Every blank becomes a space first: a split at one character needs no regex.
    """
    return F.array_remove(F.split(spaced(text), " "), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def blank_tokens(text: Column) -> Column:
    return F.split(text, " ")


def chunk_array(tokens: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` tokens, neighbours sharing ``overlap``, joined by blanks.

    The last window starts early enough that no chunk holds overlap only. The
    tokens must be a column of their own, or they are cut anew for each window.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must lie between 0 and size - 1")
    starts = F.sequence(
        F.lit(0), F.greatest(F.size(tokens) - F.lit(overlap + 1), F.lit(0)), F.lit(size - overlap)
    )
    return F.transform(starts, lambda s: F.array_join(F.slice(tokens, s + 1, size), " "))


def path_tail(path: Column, drop: str = ".pdf") -> Column:
    """Last component of a path, every occurrence of ``drop`` removed."""
    return F.replace(F.substring_index(path, "/", -1), F.lit(drop), F.lit(""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))


def user_slug(user: Column) -> Column:
    return F.replace(F.substring_index(user, "@", 1), F.lit("."), F.lit("_"))


def function_name(tool: Column) -> Column:
    return F.replace(tool, F.lit("__"), F.lit("."))


def preview(text: Column, chars: int) -> Column:
    """First characters of a text; the dots are always appended."""
    return F.concat(F.substr(text, F.lit(1), F.lit(chars)), F.lit("..."))


def without_phrase(text: Column, phrase: str) -> Column:
    return F.replace(text, F.lit(phrase), F.lit(""))


def page_text(html: Column) -> Column:
    """Readable text of a page: bodies of scripts and styles and all tags dropped."""
    bare = F.regexp_replace(F.regexp_replace(html, PAGE_BODIES, " "), PAGE_TAGS, " ")
    return F.trim(F.regexp_replace(bare, WORD_BREAK, " "))


def citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))


def same_paper(left: Column, right: Column) -> Column:
    """Ids name the same paper when their first ten characters agree."""
    return F.substr(left, F.lit(1), F.lit(10)) == F.substr(right, F.lit(1), F.lit(10))


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """Fill ``{name}`` places of a fixed template, each exactly once.

    The template is cut before the values go in, so braces inside a value stay
    as they are.
    """
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        name = piece[1:-1] if piece.startswith("{") and piece.endswith("}") else None
        if name in values:
            parts.append(F.coalesce(values[name], F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def fill_column(template: Column, values: Mapping[str, Column]) -> Column:
    """As :func:`fill`, for templates that differ from row to row."""
    pieces = F.split(template, "(?=\\{)|(?<=\\})")

    def one(piece: Column) -> Column:
        filled = piece
        for name, value in values.items():
            filled = F.when(piece == F.lit("{" + name + "}"), F.coalesce(value, F.lit(""))).otherwise(filled)
        return filled

    return F.array_join(F.transform(pieces, one), "")
