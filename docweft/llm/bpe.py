"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Every prefix of a pre-token has exactly one encoding that merging would give, so
one number per prefix is enough: its last token. An automaton over all tokens
lists, at each place, the tokens that end there. Such a token is the prefix's
last one if it stands at the start, or if it is compatible with the last token
of the prefix before it: two tokens are compatible if merging their joined bytes
never crosses the border between them. The encoding is read off backwards along
these pointers. The work is linear in a pre-token's matches, so a pre-token may
have any length.

Defined cases: a null text is empty and has no ids; ``doc_id`` is passed on as it
is, null or repeated; an empty table gives an empty result; special strings in a
text become their id, as the tokenizers library does by default.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.bytepair import WORDS, Vocabulary, read_source, spaced, vocabulary
from docweft.llm.common import Cache, documents, per_text, query

CACHED = 400_000
PAIRS = 2_000_000


class Encoder:
    """Ids of texts, as little-endian 32-bit bytes."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.ends = ahocorasick.Automaton()
        for number, token in enumerate(vocab.tokens):
            self.ends.add_word(token.decode("latin-1"), (number, len(token)))
        self.ends.make_automaton()
        self.ids = np.array(vocab.ids, dtype="<i4")
        self.special = {s: np.array([i], dtype="<i4").tobytes() for s, i in vocab.special.items()}
        self.tested: dict[int, bool] = {}
        self.words = Cache(self._word, CACHED)
        self.after_space = Cache(lambda chunk: self.plain(" " + chunk), CACHED)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives back just these two.

        The halves along the border are opened from the latest merge to the
        earliest; the border is crossed if a pair met on the way has a merge that
        would come before the one that closes either side.
        """
        pair = left << 32 | right
        if len(self.tested) >= PAIRS:
            self.tested.clear()
        pairs, halves = self.vocab.pairs, self.vocab.halves
        bound = 1 << 60
        while True:
            made = pairs.get((left, right))
            if made is not None and made < bound:
                answer = False
                break
            if left < 256 and right < 256:
                answer = True
                break
            # Open the side made later; on a tie of numbers the right side, whose merge at the border comes after the left's.
            if left > right:
                bound, left = left, halves[left][1]
            else:
                bound, right = right + 1, halves[right][0]
        self.tested[pair] = answer
        return answer

    def tokens(self, word: bytes) -> list[int]:
        """Tokens of one pre-token, numbered by merge order."""
        n = len(word)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        tested = self.tested
        for end, (number, length) in self.ends.iter(word.decode("latin-1")):
            at = end + 1
            if last[at] < 0:
                start = at - length
                if start:
                    fits = tested.get(last[start] << 32 | number)
                    if fits is None:
                        fits = self.compatible(last[start], number)
                    if not fits:
                        continue
                last[at], size[at] = number, length
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def _word(self, word: str) -> bytes:
        return self.ids[self.tokens(word.encode("utf-8"))].tobytes()

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, WORDS.findall(text)))

    def encode(self, text: str) -> bytes:
        out = []
        for special, part in self.vocab.parts(text):
            chunks = None if special else spaced(part)
            if special:
                out.append(self.special[part])
            elif chunks is None:
                out.append(self.plain(part))
            else:
                out.append(self.plain(chunks[0]))
                out.extend(map(self.after_space.__getitem__, chunks[1:]))
        return b"".join(out)


_encoders: dict[int, Encoder] = {}


def encoder(source: str) -> Encoder:
    if hash(source) not in _encoders:
        _encoders[hash(source)] = Encoder(vocabulary(source))
    return _encoders[hash(source)]


def id_lists(encoded: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(encoded) + 1, dtype=np.int32)
    np.cumsum([len(e) // 4 for e in encoded], out=offsets[1:])
    values = pa.array(np.frombuffer(b"".join(encoded), dtype="<i4"))
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def encoded(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)`` per row, by the vocabulary file at ``path``."""
    sent = docs.sparkSession.sparkContext.broadcast(read_source(path))

    def run(texts: list[str], batch: pa.RecordBatch) -> dict[str, pa.Array]:
        encode = encoder(sent.value).encode
        return {"doc_id": batch.column("doc_id"), "ids": id_lists([encode(t) for t in texts])}

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return per_text(rows, run, f"doc_id {kind}, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows``, which has ``ids``, with the text they stand for as ``decoded``."""
    sent = rows.sparkSession.sparkContext.broadcast(read_source(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(sent.value)
        by_id = dict(zip(vocab.ids, vocab.tokens, strict=True)) | {i: s.encode("utf-8") for s, i in vocab.special.items()}
        for batch in batches:
            ids = batch.column("ids")
            texts = []
            for at in range(batch.num_rows):
                one = ids[at].values
                joined = b"" if one is None else b"".join(map(by_id.__getitem__, one.to_numpy().tolist()))
                texts.append(joined.decode("utf-8", errors="replace"))
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, decoded string")


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decoded(encoded(documents(spark, sf_dir)))
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
