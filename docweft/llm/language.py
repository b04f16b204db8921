"""Language of texts and of spans in mixed texts.

Learning: character trigrams with word borders are counted per language over all
labelled texts, hashed into a table of fixed size, and the scripts that each
language uses are noted. Labelling: the script of a word leaves
only languages that use it; each remaining language scores the word by its
trigrams; a Viterbi pass over the words of a text, with a penalty for changing
language, gives every word a language. Neighbouring words of one language are a
span. The text's language is the one with most letters, its score their share.

Defined cases: a text that is null or without letters is ``und`` with score 0,
and so is every text if nothing could be learned. Words in a script that no
learned language uses count for all alike. Ties go to the first name. Repeated
rows and ids are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.common import cut, documents, per_text, query
from docweft.llm.letters import SCRIPTS, Words, words_of

BUCKETS = 1 << 16
#: Letters of a script below this share of a language's letters don't count as its own.
SCRIPT_SHARE = 0.01
PENALTY = 8.0
#: A task that counts trigrams sends them on when it holds more languages.
HELD_LANGS = 64
_BLOCKED = -1e4


class Model(NamedTuple):
    names: list[str]
    table: np.ndarray  # log probability per (bucket, language)
    scripts: np.ndarray  # allowed per (script, language)


def trigrams(words: Words) -> np.ndarray:
    """The bucket of the trigram around each letter; 0 stands beyond a word's border."""
    n = len(words.letters)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    c = words.letters.astype(np.uint64)
    before, after = np.roll(c, 1), np.roll(c, -1)
    before[words.word_at] = 0
    after[words.word_at + words.sizes - 1] = 0
    with np.errstate(over="ignore"):
        mixed = before * np.uint64(0x9E3779B97F4A7C15) + c * np.uint64(0xC2B2AE3D27D4EB4F) + after * np.uint64(0x165667B19E3779F9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(48)).astype(np.int64)


def _counts(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """The languages, and per language how often each trigram's bucket occurs and, behind these, the letters of each script."""
    names = sorted(set(langs))
    number = {name: i for i, name in enumerate(names)}
    size = BUCKETS + len(SCRIPTS) + 1
    words = words_of(texts)
    lang = np.array([number[x] for x in langs], dtype=np.int64)[words.text_of] * size
    counts = np.bincount(np.repeat(lang, words.sizes) + trigrams(words), minlength=size * len(names))
    counts += np.bincount(lang + BUCKETS + words.script, words.sizes, size * len(names)).astype(np.int64)
    return names, counts.reshape(len(names), size)


def _model(names: list[str], found: np.ndarray) -> Model:
    counts, seen = found.T[:BUCKETS].astype(np.float64), found.T[BUCKETS:]
    logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS)) if names else counts
    allowed = seen >= np.maximum(1, SCRIPT_SHARE * seen.sum(axis=0))
    return Model(names, logs.astype(np.float32), allowed)


def fitted(texts: list[str], langs: list[str]) -> Model:
    """A model from a list of texts."""
    return _model(*_counts(texts, langs))


def counted(rows: DataFrame) -> Model:
    """A model from all ``rows`` (``text, lang``) with a language, whose counts are added up in tasks."""

    def flushed(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, counts in total.items():
            # One script is always sent, as a language may come without letters.
            at = np.union1d(np.flatnonzero(counts), [BUCKETS])
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "at": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())})
        total.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in cut(batch, "text", 1 << 20):
                names, counts = _counts(part.column("text").to_pylist(), part.column("lang").to_pylist())
                for name, own in zip(names, counts, strict=True):
                    total[name] = total[name] + own if name in total else own
                if len(total) > HELD_LANGS:
                    yield from flushed(total)
        yield from flushed(total)

    known = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    found = known.mapInArrow(run, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(set(found["lang"]))
    counts = np.zeros((len(names), BUCKETS + len(SCRIPTS) + 1), dtype=np.int64)
    number = {name: i for i, name in enumerate(names)}
    counts[found["lang"].map(number).to_numpy(dtype=np.int64), found["at"].to_numpy()] = found["n"].to_numpy()
    return _model(names, counts)


def learned(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from all rows with a language that are not held out, whole texts and copies included."""
    own = (F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0) | F.col(key).isNull()
    return counted(docs.where(own).select(F.col(text).alias("text"), F.col(lang).alias("lang")))


def word_scores(words: Words, model: Model) -> np.ndarray:
    if len(words.word_at) == 0:
        return np.zeros((0, len(model.names)), dtype=np.float32)
    scores = np.add.reduceat(model.table[trigrams(words)], words.word_at, axis=0)
    allowed = model.scripts[words.script]
    known = allowed.any(axis=1)
    scores[known[:, None] & ~allowed] += _BLOCKED
    scores[~known] = 0
    return scores


def best_path(scores: np.ndarray, text_of: np.ndarray, n_texts: int, penalty: float = PENALTY) -> np.ndarray:
    """The language of each word; all texts are followed at once, word by word."""
    n_words = np.bincount(text_of, minlength=n_texts)
    order = np.argsort(-n_words, kind="stable")
    lengths = n_words[order]
    first = (np.cumsum(n_words) - n_words)[order]
    n_langs = scores.shape[1]
    value = np.zeros((n_texts, n_langs))
    came = np.zeros(scores.shape, dtype=np.int16)
    own = np.arange(n_langs, dtype=np.int16)
    longest = int(lengths[0]) if n_texts else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    for t in range(longest):
        k = active[t]
        at, now = first[:k] + t, value[:k]
        best = now.argmax(axis=1)
        switched = now.max(axis=1) - penalty
        came[at] = np.where(now >= switched[:, None], own, best[:, None])
        now = np.maximum(now, switched[:, None]) + scores[at]
        value[:k] = now - now.max(axis=1, keepdims=True)
    label = np.zeros(len(scores), dtype=np.int16)
    state = value.argmax(axis=1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        label[at] = state[:k]
        state[:k] = came[at, state[:k]]
    return label


def spans(texts: list[str], model: Model) -> list[list[tuple[int, int, str]]]:
    """Per text ``(start, end, language)``, from the first letter of a span to its last."""
    words = words_of(texts)
    label = best_path(word_scores(words, model), words.text_of, len(texts))
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    last = None
    for text, start, size, lang in zip(words.text_of.tolist(), words.starts.tolist(), words.sizes.tolist(), label.tolist(), strict=True):
        if last == (text, lang):
            out[text][-1] = (out[text][-1][0], start + size, model.names[lang])
        else:
            out[text].append((start, start + size, model.names[lang]))
        last = (text, lang)
    return out


def labelled(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", with_spans: bool = False) -> DataFrame:
    """``(doc_id, lang_pred, score[, spans])`` per row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(texts: list[str], batch: pa.RecordBatch) -> dict[str, pa.Array]:
        known = sent.value
        n_langs = len(known.names)
        names, share = ["und"] * len(texts), np.zeros(len(texts))
        if n_langs:
            words = words_of(texts)
            label = best_path(word_scores(words, known), words.text_of, len(texts))
            letters = np.bincount(words.text_of * n_langs + label, words.sizes, len(texts) * n_langs).reshape(-1, n_langs)
            total, best = letters.sum(axis=1), letters.argmax(axis=1)
            names = [known.names[b] if n else "und" for b, n in zip(best, total, strict=True)]
            share = letters.max(axis=1) / np.maximum(total, 1)
        out = {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(share)}
        if with_spans:
            found = spans(texts, known) if n_langs else [[] for _ in texts]
            out["spans"] = pa.array([[{"start": a, "end": b, "lang": x} for a, b, x in some] for some in found], span_type)
        return out

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {kind}, lang_pred string, score double" + ", spans array<struct<start:bigint,end:bigint,lang:string>>" * with_spans
    return per_text(rows, run, schema, step=8 << 20)


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = labelled(docs, learned(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "lang_pred", "score")
