"""How far the sources of a language differ in their words.

Identical texts of a language are folded first: their digests are counted per
source, one of the texts stays and is tokenised once, and its terms count for every
source as often as that source holds the text. Tasks add up terms per source before
anything is shuffled.

Two sources are compared term by term only where one of them has the term. Elsewhere
both have the share of an unseen term, so the rest of the sum is one product. Terms
and sources are cut into blocks; a block of terms meets one pair of source blocks in
a task, which sends on one partial sum per pair of sources.

Shares are integers, ``1 + floor(10^9 * (count + 5) / (N + 5 * V))``, by long division
in three steps of three digits, exact up to 9 * 10^15 occurrences.

Defined cases: a null text, language or source is an empty string. A text without
terms still makes its group occur; a language without kept terms has distance 0
between all its sources and no ``term`` rows. A text of any length is cut whole; memory follows
the longest text. Ties go to the smaller item by its UTF-8 bytes. Repeated rows count
each time, ``doc_id`` and other columns are not looked at, an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft.llm.common import cut, documents, join_groups, query, staged
from docweft.operators.numbering import top_per_key

LEAST_DOCUMENTS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
ADDED = 5
SOURCE_BLOCK = 256
TERM_BLOCK = 4096
# Sources of one text that meet it in one row; a text in more sources is cut once per so many.
SOURCES_PER_ROW = 1024
# Terms a task holds before it sends them on.
HELD_TERMS = 400_000

# Bytes that are no part of a term become spaces, A to Z become lower case.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and of characters beyond ASCII, only A to Z in lower case."""
    return text.encode("utf-8").translate(_TERM_BYTES).split()


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(lang, text, sources)``: each different text of a language with its sources and how often each holds it; and all groups."""
    keyed = docs.select("lang", "source", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    copies = staged(keyed.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("n")), "copies")
    groups = staged(copies.select("lang", "source").distinct(), "groups")
    most = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    many = copies.groupBy("lang", "digest", F.pmod(F.xxhash64("source"), F.lit(-(-most // SOURCES_PER_ROW))).alias("slice")).agg(
        F.collect_list(F.struct("source", "n")).alias("sources")
    )
    texts = keyed.select("lang", "digest", "text").dropDuplicates(["lang", "digest"])
    return texts.join(many, ["lang", "digest"]).select("lang", "text", "sources"), groups


class _Counts:
    """Occurrences and documents of terms per language and source."""

    def __init__(self):
        self.uses: dict[tuple[str, str], Counter] = {}
        self.docs: dict[tuple[str, str], Counter] = {}

    def add(self, group: tuple[str, str], n: int, words: list[bytes], terms: set[bytes]) -> None:
        uses, docs = self.uses.setdefault(group, Counter()), self.docs.setdefault(group, Counter())
        if n == 1:
            uses.update(words)
            docs.update(terms)
            return
        for term, c in Counter(words).items():
            uses[term] += n * c
            docs[term] += n

    def size(self) -> int:
        return sum(map(len, self.docs.values()))

    def taken(self) -> Iterator[pa.RecordBatch]:
        for group, uses in self.uses.items():
            docs, terms = self.docs[group], list(uses)
            for at in range(0, len(terms), 1 << 16):
                part = terms[at : at + (1 << 16)]
                columns = {"lang": pa.array([group[0]] * len(part), pa.string()), "source": pa.array([group[1]] * len(part), pa.string())}
                columns["term"] = pa.array(part, pa.binary()).cast(pa.string())
                columns["n"] = pa.array([uses[t] for t in part], pa.int64())
                columns["docs"] = pa.array([docs[t] for t in part], pa.int64())
                yield pa.RecordBatch.from_pydict(columns)
        self.uses, self.docs = {}, {}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Counts()
    for batch in batches:
        for part in cut(batch, "text", 4 << 20):
            for lang, text, sources in zip(*(part.column(c).to_pylist() for c in ("lang", "text", "sources")), strict=True):
                words = terms_of(text)
                terms = set(words)
                for source in sources:
                    held.add((lang, source["source"]), source["n"], words, terms)
                if held.size() > HELD_TERMS:
                    yield from held.taken()
    yield from held.taken()


def kept_terms(texts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``(lang, source, term, n, lang_n, head)``: occurrences per source of the terms in at least ``least`` documents of their language.

    ``head`` is true in one row of each term of a language.
    """
    found = texts.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    # One shuffle by language and term serves both sums.
    added = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    both = added.withColumns({"lang_n": F.sum("n").over(same), "lang_docs": F.sum("docs").over(same), "head": F.col("source") == F.min("source").over(same)})
    return both.where(F.col("lang_docs") >= least).select("lang", "source", "term", "n", "lang_n", "head")


def share(n: str, total: str) -> Column:
    """``1 + floor(SCALE * (n + ADDED) / total)``, three digits at a time."""
    top = f"(({n} + {ADDED}) * 1000)"
    parts, unit = [], SCALE
    while unit > 1:
        unit //= 1000
        parts.append(f"({top} div {total}) * {unit}L")
        top = f"(({top} % {total}) * 1000)"
    return F.expr(" + ".join(["1L", *parts]))


def _sized(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """Each group with its language's terms and totals, the share of an unseen term, its own number of terms and its source block."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count(F.lit(1)).alias("own_terms"))
    langs = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / F.lit(SOURCE_BLOCK)).cast("int").alias("blocks"))
    used = kept.groupBy("lang").agg(F.sum("n").alias("all_n"), F.count_if("head").alias("terms"))
    both = groups.join(own, ["lang", "source"], "left").join(langs.join(used, "lang", "left"), "lang").na.fill(0)
    both = both.withColumns({"total": F.expr(f"own_n + {ADDED} * terms"), "lang_total": F.expr(f"all_n + {ADDED} * terms")})
    unseen = F.when(F.col("terms") > 0, share("0L", "total"))
    return both.withColumns({"unseen": unseen, "block": F.expr("pmod(xxhash64(source), blocks)").cast("int"), "group": F.struct("lang", "source")})


def _blocks_met(rows: DataFrame) -> DataFrame:
    """Rows once per pair ``(i, j)`` of source blocks that their own block is in."""
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")


PARTIAL = "lang string, a string, b string, value bigint, seen bigint"


def _differences(table: pa.Table) -> pa.Table:
    """Of each pair of sources of two blocks, the differences in the terms that one of them has, summed."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    source, term = (table[c].combine_chunks().dictionary_encode() for c in ("source", "term"))
    names = source.dictionary.to_pylist()
    row, column = (x.indices.to_numpy(zero_copy_only=False) for x in (source, term))
    extra = np.zeros((len(names), len(term.dictionary)), dtype=np.int64)
    has = np.zeros(extra.shape, dtype=bool)
    use = table["n"].to_numpy() > 0
    unseen, block = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    unseen[row], block[row] = table["unseen"].to_numpy(), table["block"].to_numpy()
    extra[row, column] = np.where(use, table["p"].to_numpy() - unseen[row], 0)
    has[row, column] = use
    out: list[tuple[str, str, int, int]] = []
    for a, name in enumerate(names):
        others = np.arange(a + 1, len(names)) if i == j else np.flatnonzero(block == j) if block[a] == i else np.zeros(0, np.int64)
        for at in range(0, len(others), 64):
            b = others[at : at + 64]
            either = has[a] | has[b]
            apart = np.abs((extra[a] + unseen[a]) - (extra[b] + unseen[b][:, None]))
            sums, seen = np.where(either, apart, 0).sum(axis=1), either.sum(axis=1)
            out.extend((name, names[k], int(v), int(n)) for k, v, n in zip(b, sums, seen, strict=True) if n)
    lang = table["lang"][0].as_py()
    a, b, value, seen = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table(
        {
            "lang": pa.array([lang] * len(out), pa.string()),
            "a": pa.array(a, pa.string()),
            "b": pa.array(b, pa.string()),
            "value": pa.array(value, pa.int64()),
            "seen": pa.array(seen, pa.int64()),
        }
    )


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for every two sources of a language."""
    slices = F.ceil(F.col("terms") / F.lit(TERM_BLOCK))
    columns = ["lang", "slice", "source", "term", "n", "p", "unseen", "block", "blocks"]
    rows = shares.withColumn("slice", F.pmod(F.xxhash64("term"), slices)).select(*columns)
    # A source is present in every slice, also where it has no term.
    present = groups.where("terms > 0").withColumns({"term": F.lit(""), "n": F.lit(0).cast("bigint"), "p": F.lit(0).cast("bigint")})
    present = present.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1))).select(*columns)
    rows = _blocks_met(rows.unionByName(present)).drop("blocks")
    partial = rows.groupBy("lang", "slice", "i", "j").applyInArrow(_differences, PARTIAL)
    sums = partial.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    ends = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    sums = sums.select("lang", F.explode(ends).alias("e"), "value", "seen").select("lang", "e.source", "e.item", "value", "seen")
    one = _blocks_met(groups).select("lang", "i", "j", "source", "terms", "unseen", "block")
    two = _blocks_met(groups).select("lang", "i", "j", F.col("source").alias("item"), F.col("unseen").alias("other"), F.col("block").alias("to"))
    met = one.join(two, ["lang", "i", "j"]).where("source <> item AND (i = j OR block <> to)")
    # Terms that neither has differ by the shares of unseen terms.
    value = F.expr("coalesce(value, 0L) + coalesce((terms - coalesce(seen, 0L)) * abs(unseen - other), 0L)")
    return met.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", value.alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far a source is from each other one, and its most excessive terms."""
    texts, found = _grouped(docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]))
    kept = staged(kept_terms(texts, least), "kept")
    groups = staged(_sized(found, kept), "sized")
    named = groups.select("group", "terms", "total", "lang_total", "unseen", "blocks", "block", "own_terms").where("own_terms > 0")
    shares = join_groups(kept.withColumn("group", F.struct("lang", "source")), named, "group", "own_terms", kept.count())
    shares = staged(shares.withColumns({"p": share("n", "total"), "q": share("lang_n", "lang_total")}).drop("group"), "shares")
    pairs = _pairs(shares, groups)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("p - q").alias("value"))
    terms = top_per_key(terms, ["lang", "source"], [F.col("value").desc(), F.col("item")], top, "rank")
    parts = [(pairs, "pair"), (terms, "term")]
    out = [df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for df, name in parts]
    return out[0].unionByName(out[1])


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*) AS terms, sum(lang_n) AS all_n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(n) AS own_n FROM x GROUP BY ALL),
p AS (SELECT x.lang, x.source, x.term, x.n, 1 + ({SCALE}::HUGEINT * (x.n + {ADDED})) // (own_n + {ADDED} * terms) AS p,
  1 + ({SCALE}::HUGEINT * (lang_n + {ADDED})) // (all_n + {ADDED} * terms) AS q FROM x JOIN s USING (lang, source) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(f.value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT * FROM (SELECT lang, source, 'term', term, p - q, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank
    FROM p WHERE n > 0 AND p > q) WHERE rank <= {TOP_TERMS})
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r"""


@query("op12_source_divergence", SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))
