"""Token counts with a whole-token shortcut.

Before the scan, every vocabulary string is merged once on its own. Those that
come out as one token are whole: a pre-token equal to one of them counts as one
without being merged. Only the rest is merged, by the library's merge model, with a bounded cache of counts.
The set of whole strings is bounded by the vocabulary and broadcast.

Defined cases: a null text is empty and has no token; ``doc_id`` is passed on as
it is, null or repeated; an empty table gives an empty result; texts and
pre-tokens may have any length.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.bytepair import WORDS, Vocabulary, byte_level, read_source, spaced, vocabulary
from docweft.llm.common import Cache, documents, per_text, query

LIMIT = 512
CACHED = 600_000


def whole_tokens(vocab: Vocabulary) -> frozenset[str]:
    """Vocabulary strings, as text, that merge into exactly one token."""
    found = set()
    for number, token in enumerate(vocab.tokens):
        if vocab.merged(token) == [number]:
            try:
                found.add(token.decode("utf-8"))
            except UnicodeDecodeError:
                continue
    return frozenset(found)


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, source: str, whole: frozenset[str]):
        from tokenizers import Tokenizer

        self.vocab, self.whole = vocabulary(source), whole
        merge = Tokenizer.from_str(source).model.tokenize
        self.words = Cache(lambda w: len(merge(byte_level(w))), CACHED)
        self.after_space = Cache(self._after_space, CACHED)

    def _after_space(self, chunk: str) -> int:
        word = " " + chunk
        return 1 if word in self.whole else self.plain(word)

    def plain(self, text: str) -> int:
        whole, words = self.whole, self.words
        return sum(1 if w in whole else words[w] for w in WORDS.findall(text))

    def count(self, text: str) -> int:
        total = 0
        for special, part in self.vocab.parts(text):
            chunks = None if special else spaced(part)
            if special:
                total += 1
            elif chunks is None:
                total += self.plain(part)
            else:
                total += self.plain(chunks[0]) + sum(map(self.after_space.__getitem__, chunks[1:]))
        return total


_counters: dict[int, Counter] = {}


def counted(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` per row, by the vocabulary file at ``path``."""
    source = read_source(path)
    sent = docs.sparkSession.sparkContext.broadcast((source, whole_tokens(vocabulary(source))))

    def run(texts: list[str], batch: pa.RecordBatch) -> dict[str, pa.Array]:
        source, whole = sent.value
        if hash(source) not in _counters:
            _counters[hash(source)] = Counter(source, whole)
        count = _counters[hash(source)].count
        return {
            "doc_id": batch.column("doc_id"),
            "n_bytes": batch.column("n_bytes"),
            "n_tokens": pa.array([count(t) for t in texts], pa.int64()),
        }

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.col(text).alias("text"),
    )
    return per_text(rows, run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > LIMIT)
