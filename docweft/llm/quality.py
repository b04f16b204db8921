"""Quality rules: how much of a text repeats itself.

Words become 64-bit values, and prefix sums of a polynomial give the hash of any
run of words in one subtraction, so windows of several lengths are hashed for a
whole batch of texts at once. A window that holds a repeated longer window is
repeated itself; each length therefore looks only where the one before it found
something. Characters are counted once however many windows cover them. A text is
rejected where too many of its characters lie in windows, or in lines, that stood
in it before. All comparisons are between integers.

Defined cases: a null text has no words, as an empty one; both fail the base rule.
A text of any length is judged whole; memory follows the longest text. Null or
repeated ``doc_id`` are rows like others, the order of equal rows has no meaning,
other columns of the input are not looked at, and an empty table gives an empty
result. Two different windows are taken for equal with probability 2^-64.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.common import documents, per_text, query

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
REPEAT = 3
MOST_REPEATED = 50

# The published limits, in percent of the characters, for windows of so many words.
WINDOWS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
# Fixed value: the published limit for repeated lines, in percent of the characters.
MOST_LINE_CHARS = 20

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

BASE_COLUMNS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
MORE_COLUMNS = ["n_lines bigint", "dup_line_chars bigint", *[f"dup_chars_{n} bigint" for n in WINDOWS]]


class Bag(NamedTuple):
    """The words of many texts in a row."""

    value: np.ndarray  # a 64-bit value per word, equal for equal words only
    chars: np.ndarray  # code points per word
    text: np.ndarray  # the text of each word
    n_texts: int


def _mixed(values: np.ndarray) -> np.ndarray:
    """64-bit finaliser of the splitmix generator: a bijection."""
    z = values + _U64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U64(27))) * _U64(0x94D049BB133111EB)
    return z ^ (z >> _U64(31))


def words_of(texts: list[str]) -> Bag:
    # Splitting bytes cuts at exactly the six ASCII white-space characters.
    lists = [t.encode("utf-8").split() for t in texts]
    sizes = [len(words) for words in lists]
    coded = pa.array([w for words in lists for w in words], pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.array([len(w.decode("utf-8")) for w in coded.dictionary.to_pylist()], dtype=np.int64)
    with np.errstate(over="ignore"):
        value = _mixed(codes.astype(_U64))
    return Bag(value, chars[codes], np.repeat(np.arange(len(texts)), sizes), len(texts))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=_U64)


class Windows:
    """Hashes of all runs of words, by prefix sums."""

    def __init__(self, bag: Bag):
        n = len(bag.value)
        self.bag = bag
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, dtype=_U64)
            np.cumsum(bag.value * _powers(_BASE, n), out=self.sums[1:])
        self.back = _powers(_INVERSE, n)

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the windows of ``size`` words that begin at ``at``, different in different texts."""
        with np.errstate(over="ignore"):
            run = (self.sums[at + size] - self.sums[at]) * self.back[at]
            return _mixed(run ^ _mixed(self.bag.text[at].astype(_U64)))

    def inside(self, at: np.ndarray, size: int) -> np.ndarray:
        """Those of ``at`` whose window does not leave its text."""
        at = at[at + size <= len(self.bag.text)]
        return at[self.bag.text[at] == self.bag.text[at + size - 1]]


def repeats(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries occur more than once, and which of them occurred before."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(hashes)
    sorted_ = hashes[order]
    begins = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    sizes = np.diff(np.append(begins, n))
    again, before = np.zeros(n, bool), np.ones(n, bool)
    again[order] = np.repeat(sizes > 1, sizes)
    before[np.minimum.reduceat(order, begins)] = False
    return again, before


def covered(begins: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``size`` words that begins at ``begins``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + size, -1)
    return np.cumsum(edge[:-1]) > 0


def repetition(bag: Bag) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Per text: words in windows of ``REPEAT`` words that occur twice, and per size the characters in windows seen before."""
    n = len(bag.value)
    windows = Windows(bag)
    at = windows.inside(np.arange(n), REPEAT)
    again, _ = repeats(windows.hashes(at, REPEAT))
    at = at[again]
    words = np.bincount(bag.text[covered(at, REPEAT, n)], minlength=bag.n_texts)
    chars = {}
    for size in WINDOWS:
        at = windows.inside(at, size)
        again, before = repeats(windows.hashes(at, size))
        inside = covered(at[before], size, n)
        chars[size] = np.bincount(bag.text[inside], bag.chars[inside], minlength=bag.n_texts).astype(np.int64)
        at = at[again]
    return words, chars


def lines_of(text: str) -> tuple[int, int, int]:
    """Lines that have a word, those of them that stood before, and the characters in the latter's words."""
    seen: set[str] = set()
    n = copies = chars = 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            n += 1
            if line in seen:
                copies += 1
                chars += len(line.translate(_NO_WHITE))
            else:
                seen.add(line)
    return n, copies, chars


_NO_WHITE = dict.fromkeys(map(ord, WHITE))


def _measures(texts: list[str], batch: pa.RecordBatch) -> dict[str, pa.Array]:
    bag = words_of(texts)
    words, chars = repetition(bag)
    lines = np.array([lines_of(t) for t in texts], dtype=np.int64).reshape(len(texts), 3)
    symbols = [sum(map(t.count, SYMBOLS)) for t in texts]
    return {
        "doc_id": batch.column("doc_id"),
        "n_words": pa.array(np.bincount(bag.text, minlength=len(texts)), pa.int64()),
        "word_chars": pa.array(np.bincount(bag.text, bag.chars, minlength=len(texts)).astype(np.int64)),
        "n_symbols": pa.array(symbols, pa.int64()),
        "n_dup_lines": pa.array(lines[:, 1]),
        "n_repeat_words": pa.array(words, pa.int64()),
        "n_lines": pa.array(lines[:, 0]),
        "dup_line_chars": pa.array(lines[:, 2]),
        **{f"dup_chars_{size}": pa.array(n) for size, n in chars.items()},
    }


def base_failed() -> str:
    return f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"


def repetitive() -> str:
    """The method's verdict: too much of the text stood in it before."""
    lines = f"100 * dup_line_chars > {MOST_LINE_CHARS} * word_chars"
    return " OR ".join([lines, *[f"100 * dup_chars_{n} > {most} * word_chars" for n, most in WINDOWS.items()]])


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The measures of every text, ``base_failed`` and ``kept``, one row per input row."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = per_text(rows, _measures, ", ".join([BASE_COLUMNS, *MORE_COLUMNS]))
    return found.withColumn("base_failed", F.expr(base_failed())).withColumn("kept", F.expr(f"NOT (base_failed OR {repetitive()})"))


def _sql() -> str:
    runs = "".join(
        f",\n  row_number() OVER (PARTITION BY rid, " + ", ".join(f"w{i}" for i in range(n)) + f" ORDER BY pos) > 1 AND w{n - 1} IS NOT NULL AS seen_{n}"
        for n in WINDOWS
    )
    first = ", ".join(["w AS w0", *[f"lead(w, {i}) OVER (PARTITION BY rid ORDER BY pos) AS w{i}" for i in range(1, max(WINDOWS))]])
    covers = "".join(f",\n  bool_or(seen_{n}) OVER (PARTITION BY rid ORDER BY pos ROWS {n - 1} PRECEDING) AS in_{n}" for n in WINDOWS)
    sums = "".join(f", coalesce(sum(length(w0)) FILTER (in_{n}), 0)::BIGINT AS dup_chars_{n}" for n in WINDOWS)
    outer = "".join(f", coalesce(dup_chars_{n}, 0) AS dup_chars_{n}" for n in WINDOWS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, i, s[i] AS line FROM (SELECT rid, string_split(text, chr(10)) AS s, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM d)),
lr AS (SELECT rid, line, row_number() OVER (PARTITION BY rid, line ORDER BY i) > 1 AS seen FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ls AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (seen) AS n_dup_lines,
  coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) FILTER (seen), 0)::BIGINT AS dup_line_chars FROM lr GROUP BY rid),
a AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
t AS (SELECT rid, pos, ws[pos] AS w FROM (SELECT rid, ws, unnest(generate_series(1, len(ws))) AS pos FROM a)),
g AS (SELECT rid, pos, {first} FROM t),
r AS (SELECT rid, pos, w0, count(*) OVER (PARTITION BY rid, w0, w1, w2) > 1 AND w2 IS NOT NULL AS again{runs} FROM g),
c AS (SELECT rid, w0, bool_or(again) OVER (PARTITION BY rid ORDER BY pos ROWS {REPEAT - 1} PRECEDING) AS again{covers} FROM r),
ws AS (SELECT rid, count(*) AS n_words, sum(length(w0))::BIGINT AS word_chars, count(*) FILTER (again) AS n_repeat_words{sums} FROM c GROUP BY rid),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(dup_line_chars, 0) AS dup_line_chars{outer}
  FROM d LEFT JOIN ls USING (rid) LEFT JOIN ws USING (rid))
SELECT *, {base_failed()} AS base_failed, NOT ({base_failed()} OR {repetitive()}) AS kept FROM m"""


@query("op13_quality_rules", _sql())
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir))
