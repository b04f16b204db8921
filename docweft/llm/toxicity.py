"""Toxicity of texts by a small convolutional network over hashed words.

A word's embedding is the mean of hashed rows: one for the word, one for each
five-letter window in it, so that unseen forms of a known stem are known too.
Filters of several widths run over the words of the whole text, the largest
response of each filter is kept, and a linear layer gives the score. A filter is
a sum over its places, so each distinct word is multiplied by all of them once
and the convolution only adds looked-up rows.

Learning takes every labelled text, whole. Its rows are dealt to workers, one per
``STEPS`` mini-batches; in each of ``ROUNDS`` rounds a worker goes over its share
in mini-batches, starting from the common weights, and the mean of what the workers
changed is added to these. Workers grow with the rows and steps do not; fewer
rows than one worker takes are gone over several times. Both kinds of label weigh
the same. A fifth of the texts, drawn by hash, is held back to set a threshold for
each language from counts of all their scores. The language is recognised in the
text by trigrams, counted over all labelled texts; scores are shifted so that every
threshold lies at ``CUT``.

Defined cases: a null text is empty and scored like one; a text's label is toxic
if any of its label rows says so; null labels don't count; without labels of both
kinds every score is 0. Repeated rows are scored each; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm import language
from docweft.llm.common import cut, documents, per_text, query, staged
from docweft.llm.letters import Words, words_of
from docweft.llm.near_dedup import marked
from docweft.sources.tables import load

CUT = 0.7
BUCKETS = 1 << 16
DIM = 16
FILTERS = 8
WIDTHS = (1, 2, 3)
#: Mini-batches of BATCH texts, or fewer above so many characters; about so many of them for each worker.
STEPS = 500
BATCH = 50
RATE = 0.08
BATCH_CHARS = 1 << 20
#: The workers' changes are averaged so often, in blocks of hashed rows.
ROUNDS = 8
BLOCK = 1024
#: Thresholds are set between scores in steps of this size, up to so many steps from 0.
SCORE_STEP = 1 / 256
SCORE_STEPS = 1 << 16
HELD_BACK = 5
#: A clean text rejected weighs as much as so many toxic ones missed.
WRONG = 4
#: A language with fewer texts of either kind held back takes the common threshold.
CALIBRATED = 20
_U64 = np.uint64


class Network(NamedTuple):
    rows: np.ndarray  # hashed embeddings
    filters: np.ndarray  # DIM x places x FILTERS, places of all widths in turn
    bias: np.ndarray  # widths x FILTERS
    out: np.ndarray
    offset: float
    languages: language.Model
    shift: np.ndarray  # added to the raw score, per language


def _mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        return z ^ (z >> _U64(29))


def hashed(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word, and one per five-letter window (one starts before each letter)."""
    n = len(words.letters)
    if n == 0:
        return np.zeros(0, _U64), np.zeros(0, _U64)
    c = np.concatenate([words.letters.astype(_U64), np.zeros(4, _U64)])
    at = np.arange(n)
    first = np.repeat(words.word_at, words.sizes)
    left = np.repeat(words.word_at + words.sizes, words.sizes) - at
    with np.errstate(over="ignore"):
        window = np.where(at > first, np.roll(c[:n], 1), _U64(0)) + _U64(1)
        whole = _mix((c[:n] + _U64(7)) * _U64(0x9E3779B97F4A7C15) + (at - first).astype(_U64) * _U64(0xC2B2AE3D27D4EB4F))
        for k in range(4):
            window = _mix(window * _U64(0x9E3779B97F4A7C15) + np.where(left > k, c[k : k + n], _U64(0)) + _U64(3))
        return np.add.reduceat(whole, words.word_at), window


def _vocabulary(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words: each word's place among them; their hashed rows, and where each one's begin."""
    whole, window = hashed(words)
    _, picked, place = np.unique(whole, return_index=True, return_inverse=True)
    sizes = words.sizes[picked]
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    rows = np.zeros(int((sizes + 1).sum()), dtype=np.int64)
    rows[starts] = (whole[picked] >> _U64(48)).astype(np.int64)
    inner = np.ones(len(rows), dtype=bool)
    inner[starts] = False
    letter = np.repeat(words.word_at[picked] - starts - 1, sizes + 1) + np.arange(len(rows))
    rows[inner] = (window[letter[inner]] >> _U64(48)).astype(np.int64)
    return place, rows, starts


def _laid(words: Words, place: np.ndarray, n_texts: int, none: int) -> tuple[np.ndarray, np.ndarray]:
    """Word places of all texts with as many blanks behind each text as the widest filter needs; where texts begin."""
    pad = max(WIDTHS) - 1
    counts = np.bincount(words.text_of, minlength=n_texts)
    begin = np.cumsum(counts + pad) - (counts + pad)
    line = np.full(int((counts + pad).sum()) + pad, none, dtype=np.int64)
    line[np.arange(len(place)) + pad * words.text_of] = place
    return line, begin


def _responses(table: np.ndarray, line: np.ndarray) -> Iterator[np.ndarray]:
    """For each width the filters' responses at each place."""
    n, used = len(line) - max(WIDTHS) + 1, 0
    for width in WIDTHS:
        response = table[line[:n], used]
        for k in range(1, width):
            response += table[line[k : k + n], used + k]
        used += width
        yield response


def _pooled(responses: Iterator[np.ndarray], begin: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The largest response of each filter in each text."""
    return np.concatenate([np.maximum.reduceat(r, begin, axis=0) + b for r, b in zip(responses, bias, strict=True)], axis=1)


def _projected(rows: np.ndarray, filters: np.ndarray, index: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Words x places x FILTERS, with a blank word at the end."""
    sizes = np.diff(np.append(starts, len(index)))
    table = np.zeros((len(starts) + 1, sum(WIDTHS), FILTERS), dtype=np.float32)
    for start in range(0, len(starts), 65536):
        end = min(len(starts), start + 65536)
        part = index[starts[start] : starts[end] if end < len(starts) else len(index)]
        mean = np.add.reduceat(rows[part], starts[start:end] - starts[start], axis=0) / sizes[start:end, None]
        table[start:end] = np.tensordot(mean, filters, axes=1)
    return table


def raw_scores(network: Network, texts: list[str]) -> tuple[np.ndarray, Words]:
    words = words_of(texts)
    place, index, starts = _vocabulary(words)
    table = _projected(network.rows, network.filters, index, starts)
    line, begin = _laid(words, place, len(texts), len(starts))
    pooled = np.maximum(_pooled(_responses(table, line), begin, network.bias), 0)
    return pooled @ network.out + network.offset, words


def languages_of(words: Words, n_texts: int, model: language.Model) -> np.ndarray:
    """The likeliest language of each text as a whole; the first where there is none."""
    total = np.zeros((n_texts, max(1, len(model.names))))
    if model.names:
        np.add.at(total, words.text_of, language.word_scores(words, model))
    return total.argmax(axis=1)


def scores(network: Network, texts: list[str]) -> np.ndarray:
    raw, words = raw_scores(network, texts)
    shifted = raw + network.shift[languages_of(words, len(texts), network.languages)]
    return 1 / (1 + np.exp(-np.clip(shifted, -30, 30)))


def _begun(seed: int = 5) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """First weights (rows, filters, bias, out, offset) and for each the sums of squared gradients."""
    rng = np.random.default_rng(seed)
    weights = [
        rng.normal(0, 0.3, (BUCKETS, DIM)),
        rng.normal(0, 0.5, (DIM, sum(WIDTHS), FILTERS)),
        np.zeros((len(WIDTHS), FILTERS)),
        rng.normal(0, 0.3, len(WIDTHS) * FILTERS),
        np.zeros(1),
    ]
    return [w.astype(np.float32) for w in weights], [np.full(w.shape, 1e-6, dtype=np.float32) for w in weights]


def _stepped(weights: list[np.ndarray], sums: list[np.ndarray], texts: list[str], labels: np.ndarray, weigh: np.ndarray) -> None:
    """One mini-batch by Adagrad, in place; only the words that won a filter get a gradient."""
    rows, filters, bias, out, offset = weights
    words = words_of(texts)
    place, index, starts = _vocabulary(words)
    sizes = np.diff(np.append(starts, len(index))).astype(np.float32)
    mean = np.zeros((len(starts) + 1, DIM), dtype=np.float32)
    if len(starts):
        mean[:-1] = np.add.reduceat(rows[index], starts, axis=0) / sizes[:, None]
    table = np.tensordot(mean, filters, axes=1)
    line, begin = _laid(words, place, len(texts), len(starts))
    responses = list(_responses(table, line))
    pooled = _pooled(responses, begin, bias)
    active = np.maximum(pooled, 0)
    error = (1 / (1 + np.exp(-np.clip(active @ out + offset[0], -30, 30))) - labels) * weigh / len(texts)
    back = (error[:, None] * out) * (pooled > 0)
    g_filters, g_mean = np.zeros_like(filters), np.zeros_like(mean)
    used, ends = 0, np.append(begin[1:], len(line) - max(WIDTHS) + 1)
    for i, (width, response) in enumerate(zip(WIDTHS, responses, strict=True)):
        for text, (low, high) in enumerate(zip(begin, ends, strict=True)):
            won = low + response[low:high].argmax(axis=0)
            g = back[text, i * FILTERS : (i + 1) * FILTERS]
            for k in range(width):
                word = line[won + k]
                g_filters[:, used + k, :] += mean[word].T * g
                np.add.at(g_mean, word, filters[:, used + k, :].T * g[:, None])
        used += width
    touched = np.flatnonzero(np.abs(g_mean[:-1]).sum(axis=1) > 0)
    counts = sizes[touched].astype(np.int64)
    spread = np.repeat(g_mean[touched] / sizes[touched, None], counts, axis=0)
    own = np.concatenate([index[starts[w] : starts[w] + k] for w, k in zip(touched, counts, strict=True)]) if len(touched) else np.zeros(0, np.int64)
    rows_at, inverse = np.unique(own, return_inverse=True)
    g_rows = np.zeros((len(rows_at), DIM), dtype=np.float32)
    np.add.at(g_rows, inverse, spread)
    gradients = [g_rows, g_filters, back.sum(axis=0).reshape(bias.shape), active.T @ error, np.array([error.sum()])]
    for weight, held, gradient, at in zip(weights, sums, gradients, [rows_at, *[slice(None)] * 4], strict=True):
        held[at] += gradient * gradient
        weight[at] -= RATE * gradient / np.sqrt(held[at])


def trained(texts: list[str], labels: np.ndarray, seed: int = 5) -> list[np.ndarray]:
    """Weights after ``STEPS`` mini-batches over a list of texts."""
    rng = np.random.default_rng(seed)
    weights, sums = _begun(seed)
    order = np.zeros(0, dtype=np.int64)
    for _ in range(STEPS):
        if len(order) < min(BATCH, len(texts)):
            order = rng.permutation(len(texts))
        at, order = order[:BATCH], order[BATCH:]
        _stepped(weights, sums, [texts[i] for i in at], labels[at], np.ones(len(at)))
    return weights


def _mini_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
    texts, labels, size = [], [], 0
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            text = text.as_py()
            if texts and (len(texts) == BATCH or size + len(text) > BATCH_CHARS):
                yield texts, np.array(labels)
                texts, labels, size = [], [], 0
            texts.append(text)
            labels.append(label)
            size += len(text)
    if texts:
        yield texts, np.array(labels)


_CHANGES = "block int, worker int, at binary, weights binary, sums binary"


def _change(block: int, worker: int, at: np.ndarray, weights: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    values = [[block], [worker], [at.astype(np.int32).tobytes()], [weights.astype(np.float32).tobytes()], [sums.astype(np.float32).tobytes()]]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["block", "worker", "at", "weights", "sums"])


def _flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays[1:]])


def _round(rows: DataFrame, weights: list[np.ndarray], sums: list[np.ndarray], weigh: np.ndarray, workers: int) -> None:
    """Each worker's partition of ``(worker, at, toxic, text)`` once, in the order of ``at``; the mean of the changes goes
    into the weights. A hashed row takes the mean of those that changed it. Block -1 holds all that is not a hashed row."""
    sent = rows.sparkSession.sparkContext.broadcast((weights, sums))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held = sent.value
        weights, sums = [w.copy() for w in before], [h.copy() for h in held]
        number = -1

        def noted(batches):
            nonlocal number
            for batch in batches:
                if number < 0 and batch.num_rows:
                    number = batch.column("worker")[0].as_py()
                yield batch

        for texts, labels in _mini_batches(noted(batches)):
            _stepped(weights, sums, texts, labels, weigh[labels])
        if number < 0:
            return
        changed = np.flatnonzero((weights[0] != before[0]).any(axis=1) | (sums[0] != held[0]).any(axis=1))
        for block in np.unique(changed // BLOCK).tolist():
            at = changed[changed // BLOCK == block]
            yield _change(block, number, at, weights[0][at] - before[0][at], sums[0][at] - held[0][at])
        yield _change(-1, number, np.zeros(0), _flat(weights) - _flat(before), _flat(sums) - _flat(held))

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        flat = len(_flat(sent.value[0]))
        for batch in batches:
            for row in range(batch.num_rows):
                block, _, at, w, s = (column[row].as_py() for column in batch.columns)
                if block not in total:
                    shape = (BLOCK, DIM) if block >= 0 else (1, flat)
                    total[block] = np.zeros(shape[0], np.int64), np.zeros(shape), np.zeros(shape)
                count, w_sum, s_sum = total[block]
                own = np.frombuffer(at, np.int32) % BLOCK if block >= 0 else np.zeros(1, np.int64)
                count[own] += 1
                w_sum[own] += np.frombuffer(w, np.float32).reshape(len(own), -1)
                s_sum[own] += np.frombuffer(s, np.float32).reshape(len(own), -1)
        for block, (count, w_sum, s_sum) in total.items():
            own = np.flatnonzero(count)
            n = count[own, None]
            yield _change(block, 0, own + max(0, block) * BLOCK, w_sum[own] / n, s_sum[own] / n)

    dealt = rows.repartitionById(workers, F.col("worker")).sortWithinPartitions("at", "text")
    parts = min(workers, BUCKETS // BLOCK)
    changes = dealt.mapInArrow(work, _CHANGES).repartitionById(parts, F.pmod("block", F.lit(parts))).sortWithinPartitions("block", "worker")
    for block, at, w, s in changes.mapInArrow(mean, _CHANGES).select("block", "at", "weights", "sums").collect():
        for arrays, change in ((weights, np.frombuffer(w, np.float32)), (sums, np.frombuffer(s, np.float32))):
            if block >= 0:
                arrays[0][np.frombuffer(at, np.int32)] += change.reshape(-1, DIM)
            else:
                pieces = np.split(change, np.cumsum([a.size for a in arrays[1:-1]]))
                for array, piece in zip(arrays[1:], pieces, strict=True):
                    array += piece.reshape(array.shape)
    sent.destroy()


def _taken(rows: DataFrame, turn: int, passes: int) -> DataFrame:
    """The rows of one round: of ``ROUNDS`` slots so many that all rounds together take each ``passes`` times."""
    if passes < ROUNDS:
        return rows.where(F.col("slot").isin([(turn * passes + j) % ROUNDS for j in range(passes)])).withColumn("copy", F.lit(1))
    return rows.where(F.col("slot") < ROUNDS).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(passes // ROUNDS))))


def trained_on(rows: DataFrame, counts: np.ndarray) -> list[np.ndarray]:
    """Weights from all ``rows`` (``key, slot, toxic, text``) in slots below ``ROUNDS``, ``counts`` of them clean and toxic."""
    n = int(counts.sum())
    passes = max(1, round(STEPS * BATCH / n))
    workers = max(1, round(n * passes / (STEPS * BATCH)))
    weigh = n / 2 / counts
    weights, sums = _begun()
    for turn in range(ROUNDS):
        at = F.xxhash64("key", F.lit(turn), "copy")
        taken = _taken(rows, turn, passes).select(F.pmod(at, F.lit(workers)).cast("int").alias("worker"), at.alias("at"), "toxic", "text")
        _round(taken, weights, sums, weigh, workers)
    return weights


def threshold(raw: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The cut with most hits less ``WRONG`` times the false alarms, as shares, in the middle of the gap it falls into.

    ``toxic`` and ``clean`` are the numbers of texts with each score.
    """
    order = np.argsort(-raw, kind="stable")
    hits = np.cumsum(toxic[order]) / max(1, toxic.sum())
    wrong = np.cumsum(clean[order]) / max(1, clean.sum())
    best = int(np.argmax(hits - WRONG * wrong))
    low = raw[order[best + 1]] if best + 1 < len(raw) else raw[order[best]] - 2
    return float((raw[order[best]] + low) / 2)


def _binned(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(raw / SCORE_STEP), -SCORE_STEPS, SCORE_STEPS).astype(np.int64)


def _shifted(network: Network, lang: np.ndarray, score: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> Network:
    """The network with its thresholds, from the numbers of texts with each language and binned score."""

    def at(own: np.ndarray) -> float:
        bins, place = np.unique(score[own], return_inverse=True)
        return threshold(bins * SCORE_STEP, np.bincount(place, toxic[own]), np.bincount(place, clean[own]))

    cut = np.log(CUT / (1 - CUT))
    shift = np.full(len(network.shift), cut - at(np.ones(len(lang), dtype=bool)))
    for i in range(len(shift)):
        own = lang == i
        if min(toxic[own].sum(), clean[own].sum()) >= CALIBRATED:
            shift[i] = cut - at(own)
    return network._replace(shift=shift)


def _network(weights: list[np.ndarray], model: language.Model) -> Network:
    return Network(*weights[:4], float(weights[4][0]), model, np.zeros(max(1, len(model.names))))


def fitted(texts: list[str], labels: list[int], langs: list[str]) -> Network | None:
    """A calibrated network from a list of texts, or nothing where a kind of label is missing."""
    y = np.array(labels, dtype=np.float64)
    if len(set(labels)) < 2:
        return None
    back = np.arange(len(texts)) % HELD_BACK == 0
    if len(set(y[~back])) < 2 or len(set(y[back])) < 2:
        back[:] = False
    weights = trained([t for t, b in zip(texts, back, strict=True) if not b], y[~back])
    if not back.any():
        back[:] = True
    known = [(t, x) for t, x in zip(texts, langs, strict=True) if x is not None]
    network = _network(weights, language.fitted([t for t, _ in known], [x for _, x in known]))
    held = [t for t, b in zip(texts, back, strict=True) if b]
    raw, words = raw_scores(network, held)
    return _shifted(network, languages_of(words, len(held), network.languages), _binned(raw), y[back], 1 - y[back])


def calibrated(network: Network, rows: DataFrame) -> Network:
    """Thresholds from the scores of all ``rows`` (``toxic, text``), counted by language and step."""
    sent = rows.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "text", 1 << 20):
                raw, words = raw_scores(sent.value, part.column("text").to_pylist())
                lang = languages_of(words, part.num_rows, sent.value.languages)
                yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.int32()), "score": pa.array(_binned(raw)), "toxic": part.column("toxic")})

    found = rows.select("toxic", "text").mapInArrow(run, "lang int, score long, toxic int").groupBy("lang", "score")
    found = found.agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).toPandas()
    found = found.sort_values(["lang", "score"])
    return _shifted(network, *(found[name].to_numpy() for name in ("lang", "score", "toxic", "clean")))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """A network from all labelled rows that are not held out, or nothing where a kind of label is missing."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    texts = docs.where(F.col(key).isNotNull() & ~held_out(F.col(key)))
    texts = texts.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).cast("string").alias("lang"))
    # Most texts without a label go before anything is shuffled.
    texts = marked(texts, own, "cast(doc_id as string)", "_own", own.count()).where("_own").drop("_own")
    at = F.xxhash64("doc_id", "text")
    slot = F.when(F.pmod(F.xxhash64("text"), F.lit(HELD_BACK)) == 0, ROUNDS).otherwise(F.pmod(F.xxhash64(at, F.lit(-1)), F.lit(ROUNDS))).cast("int")
    rows = staged(texts.join(own, "doc_id").select(at.alias("key"), "toxic", "text", "lang", slot.alias("slot")), "toxicity", "slot")
    back = F.col("slot") == ROUNDS
    counts = np.zeros((2, 2), dtype=np.int64)
    for held, toxic, n in rows.groupBy(back, "toxic").count().collect():
        counts[int(held), toxic] = n
    if not counts.sum(axis=0).all():
        return None
    training, holding = rows.where(~back), rows.where(back)
    if not counts.all():
        # Too few texts to hold any back.
        training = holding = rows.withColumn("slot", F.pmod("slot", F.lit(ROUNDS)))
        counts[0] = counts.sum(axis=0)
    network = _network(trained_on(training, counts[0]), language.counted(rows))
    return calibrated(network, holding)


def scored(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity``, 0 to 1, for every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(network)
    names = docs.columns

    def run(texts: list[str], batch: pa.RecordBatch) -> dict[str, pa.Array]:
        known = sent.value
        found = np.zeros(len(texts)) if known is None else scores(known, texts)
        return {name: batch.column(name) for name in names} | {"toxicity": pa.array(found, pa.float64())}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return per_text(docs, run, f"{schema}, toxicity double", text, step=1 << 20)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` below the cut, with its columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    network = learned(docs, labels)
    rows = scored(docs.toDF(*names), network, names[docs.columns.index("text")])
    return rows.where(F.col("toxicity") < CUT).drop("toxicity").toDF(*docs.columns)


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    network = learned(docs, load(spark, sf_dir, "labels"))
    rows = scored(docs.select("doc_id", "text"), network).withColumnRenamed("toxicity", "score")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
