"""Personal data, and terms that give it away.

Base spans are found per kind, leftmost and non-overlapping. Then the corpus says
which other words disclose a found entity (one value of one kind): with ``n``
documents, the disclosure of entity ``e`` by term ``t`` is the pointwise mutual
information over the information of the entity,

    log(n * n(t, e) / (n(t) * n(e))) / log(n / n(e)),

where ``n(t, e)`` counts documents with the term within ``WINDOW`` words of the
entity. It is 1 if the term never occurs without the entity. Terms at or above
``GENERALISE`` whose pairs occur in ``SUPPORT`` different texts are spans too, of
kind ``term``, wherever they stand in any text, with or without their entity: in
sanitised text they are generalised to the kind of word they are and, from
``REMOVE`` on, removed. Words that never stand beside an entity are not touched.
Of an entity in fewer than ``SUPPORT`` different texts only its own spans are
replaced, as so few texts say nothing of the words beside it.

All counts cover all documents, and a second scan of all texts finds the terms. Pairs (entity, term) are aggregated per task
before they are shuffled; frequent pairs are joined by broadcast. Of the words of
the corpus only those go on whose bit is set in a table of ``BITS`` bits of the
terms in question; its size is fixed.

Defined cases: a null text is empty and has no spans; a null or repeated
``doc_id`` is a document of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.common import Cache, cut, documents, join_groups, per_text, query, staged, unused

KINDS = ("email", "ip", "card", "phone")
WINDOW = 5
SUPPORT = 3
GENERALISE = 0.8
REMOVE = 0.95
BITS = 1 << 23
_REACH = 160
_FLUSH = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A whole run of numbers and dots is taken at once and then dealt out in fours, which keeps long runs linear.
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")

FOUND = "array<struct<kind:string,start:bigint,end:bigint,entity:bigint>>"
TERMS = "array<struct<entity:bigint,term:string,start:bigint,end:bigint>>"
PLACES = "array<struct<term:string,start:bigint,end:bigint>>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _NUMBERS.finditer(text):
        parts = run[0].split(".")
        start = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in four)):
                yield start, end
            start = end + 1


def _luhn(digits: str) -> bool:
    twice = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 * (d > 9) for d in twice)) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for run in _CARD.finditer(text):
        digits = run[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            yield run.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for run in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in run[0]) <= 15:
            yield run.span()


_FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by kind, then start; end exclusive."""
    return [(kind, start, end) for kind, find in _FINDERS.items() for start, end in find(text)]


def entity_of(kind: str, value: str) -> int:
    plain = value.lower() if kind in ("email", "ip") else "".join(c for c in value if c.isdigit())
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little", signed=True)


def _beside(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Up to ``WINDOW`` words on either side; a word cut by the reach of the look is left out."""
    low, high = max(0, start - _REACH), min(len(text), end + _REACH)
    before = [m for m in _TERM.finditer(text, low, start) if m.start() > low or low == 0]
    after = [m for m in _TERM.finditer(text, end, high) if m.end() < high or high == len(text)]
    for m in before[-WINDOW:] + after[:WINDOW]:
        yield m[0].lower(), m.start(), m.end()


def _found(text: str) -> list[dict]:
    return [{"kind": k, "start": s, "end": e, "entity": entity_of(k, text[s:e])} for k, s, e in base_spans(text)]


def _free(found: list[dict]) -> Callable[[int, int], bool]:
    """Whether a stretch of the text overlaps no base span."""
    taken = sorted((f["start"], f["end"]) for f in found)
    edges = [s for s, _ in taken]
    reach = list(accumulate((e for _, e in taken), max))
    return lambda start, end: (at := bisect_left(edges, end)) == 0 or reach[at - 1] <= start


def _looked(text: str) -> tuple[list[dict], list[dict]]:
    found = _found(text)
    free = _free(found)
    terms = []
    for f in found:
        terms += [{"entity": f["entity"], "term": w, "start": s, "end": e} for w, s, e in _beside(text, f["start"], f["end"]) if free(s, e)]
    return found, terms


def _marked(text: str, asked_for: Cache) -> tuple[list[dict], list[dict]]:
    """Base spans, and the places of the words asked for outside them."""
    found = _found(text)
    free, terms = _free(found), []
    for m in _TERM.finditer(text):
        if asked_for[word := m[0].lower()] and free(*m.span()):
            terms.append({"term": word, "start": m.start(), "end": m.end()})
    return found, terms


def _bit(term: str) -> int:
    return zlib.crc32(term.encode("utf-8")) % BITS


def _bit_table(asked: DataFrame) -> bytes:
    """The bits of the asked terms."""
    words = asked.select(F.expr(f"crc32(encode(term, 'utf-8')) % {BITS}").alias("bit"))
    words = words.select(F.expr("bit div 64").alias("at"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("bits"))
    # At most BITS / 64 rows, whatever the corpus.
    rows = words.groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(BITS // 64, dtype=np.int64)
    table[rows["at"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return table.tobytes()


def _asked_for(table: bytes) -> Cache:
    """Whether a word is, but for few others, among the asked terms."""
    set_bits = np.frombuffer(table, dtype=np.uint64)
    return Cache(lambda word: bool(int(set_bits[(bit := _bit(word)) >> 6]) >> (bit & 63) & 1), 1_000_000)


def _term_counts(texts: DataFrame, text: str, asked: DataFrame) -> DataFrame:
    """``(term, n_term)``: documents that hold each asked term."""
    sent = texts.sparkSession.sparkContext.broadcast(_bit_table(asked))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_for = _asked_for(sent.value)
        seen: Counter = Counter()
        for batch in batches:
            for part in cut(batch, text, 4 << 20):
                for t in part.column(text).to_pylist():
                    seen.update(w for w in set(_TERM.findall(t.lower() if t else "")) if asked_for[w])
                    if len(seen) >= _FLUSH:
                        yield _counts(seen)
                        seen.clear()
        yield _counts(seen)

    parts = texts.select(text).mapInArrow(count, "term string, n_term bigint")
    return parts.groupBy("term").agg(F.sum("n_term").alias("n_term")).join(asked, "term", "left_semi")


def _counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"term": pa.array(seen.keys(), pa.string()), "n_term": pa.array(seen.values(), pa.int64())})


def disclosing(found: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """``(key, n, disclosure)``: pairs (entity, term) at or above the lower threshold, with their document count."""
    total = found.count()
    pair = F.explode(F.array_distinct(F.transform("terms", lambda t: F.struct(t["entity"].alias("entity"), t["term"].alias("term")))))
    pairs = found.select("digest", pair.alias("key")).groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= SUPPORT)
    pairs = staged(pairs, "pairs")
    entity = F.explode(F.array_distinct(F.transform("found", lambda s: s["entity"])))
    entities = found.select(entity.alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    terms = _term_counts(texts, text, pairs.select("key.term").distinct())
    known = pairs.withColumns({"entity": F.col("key.entity"), "term": F.col("key.term")}).join(entities, "entity").join(terms, "term")
    mutual = F.log(F.lit(float(total)) * F.col("n") / (F.col("n_term") * F.col("n_entity")))
    known = known.withColumn("disclosure", mutual / F.log(F.lit(float(total)) / F.col("n_entity")))
    return known.where((F.col("n_entity") < total) & (F.col("disclosure") >= GENERALISE)).select("key", "n", "disclosure")


def spans_of(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns of ``docs`` with ``found`` (base spans) and ``revealing`` (term spans) per row.

    Each term span has its ``disclosure``, the highest of the entities that the term discloses.
    """
    carry = [text] if carry is None else carry

    own = unused(docs, "looked_at")

    def look(texts: list[str], batch: pa.RecordBatch) -> dict[str, pa.Array]:
        looked = [_looked(t) for t in texts]
        return {"digest": batch.column("digest"), "found": pa.array([a for a, _ in looked], _FOUND), "terms": pa.array([b for _, b in looked], _TERMS)}

    beside = docs.select(F.xxhash64(F.col(text)).alias("digest"), F.col(text).alias(own))
    beside = staged(per_text(beside, look, f"digest bigint, found {FOUND}, terms {TERMS}", own), "beside")
    pairs = disclosing(beside, docs, text)
    accepted = staged(pairs.groupBy(F.col("key.term").alias("term")).agg(F.max("disclosure").alias("disclosure")), "disclosing")
    sent = docs.sparkSession.sparkContext.broadcast(_bit_table(accepted))
    held: list[Cache] = []

    def mark(texts: list[str], batch: pa.RecordBatch) -> dict[str, pa.Array]:
        if not held:
            held.append(_asked_for(sent.value))
        marks = [_marked(t, held[0]) for t in texts]
        out = {name: batch.column(name) for name in names}
        return out | {"found": pa.array([a for a, _ in marks], _FOUND), "terms": pa.array([b for _, b in marks], _PLACES)}

    kept = docs.select(*[F.col(c) for c in carry], F.col(text).alias(own))
    names = [c for c in kept.columns if c != own]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != own)
    rows = per_text(kept, mark, f"{schema}, found {FOUND}, terms {PLACES}", own)
    rows = staged(rows.withColumn("at", F.monotonically_increasing_id()), "found")
    places = rows.select("at", F.explode("terms").alias("t")).select("at", "t.term", "t.start", "t.end")
    uses = staged(places.groupBy("term").agg(F.count(F.lit(1)).alias("uses")).join(accepted, "term"), "uses")
    told = join_groups(places, uses, "term", "uses", places.count())
    told = told.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("start", "end", "disclosure"))).alias("revealing"))
    return rows.join(told, "at", "left").drop("at", "terms")


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("entity", pa.int64())]))
_TERMS = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_PLACES = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _shape(word: str) -> str:
    """The kind of word, which is all that a generalised term still says."""
    return "[NAME]" if word[:1].isupper() else "[WORD]"


def cleaned(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced; of overlapping spans the first, and then the longest, counts."""
    out, done = [], 0
    for start, end, put in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= done:
            out += [text[done:start], put]
            done = end
        elif end > done:
            done = end
    return "".join([*out, text[done:]])


def sanitised(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind, and disclosing terms generalised or removed.

    Rows without spans keep their text, null included.
    """
    frame = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    own = f"c{docs.columns.index(text)}"
    names = frame.columns
    rows = spans_of(frame, own, names)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(own).to_pylist()
            founds, told = batch.column("found").to_pylist(), batch.column("revealing").to_pylist()
            for at, (t, found, terms) in enumerate(zip(texts, founds, told, strict=True)):
                if t and (found or terms):
                    spans = [(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in found]
                    spans += [(s["start"], s["end"], "" if s["disclosure"] >= REMOVE else _shape(t[s["start"] : s["end"]])) for s in terms or []]
                    texts[at] = cleaned(t, spans)
            out = {c: pa.array(texts, pa.string()) if c == own else batch.column(c) for c in names}
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(clean, frame.schema).toDF(*docs.columns)


def _joined(spans: str | Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op1_pii")
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans_of(documents(spark, sf_dir), carry=["doc_id"])
    number = [F.expr(f"cast(size(filter(found, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in KINDS]
    terms = F.transform(F.coalesce("revealing", F.array().cast("array<struct<start:bigint,end:bigint,disclosure:double>>")), lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = rows.withColumns({"base": base, "terms": terms})
    return rows.select(
        "doc_id",
        *number,
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined(F.concat("base", "terms")).alias("spans"),
    )
