"""Near duplicates by ProbMinHash, banding and exact verification.

A bag of word shingles gives a signature; a shingle seen ``c`` times weighs ``1 + ln c``.
Each shingle runs a Poisson process whose rate is its weight: its arrivals come
later and later, and each falls on a random register. A register keeps the
shingle that reached it first, so two signatures agree in a register with the
probability Jaccard similarity of the weighted bags. A shingle stops as soon as
its next arrival is later than every register's first one.

``BANDS`` bands of ``ROWS`` registers give buckets: a pair at similarity 0.8
shares at least one but for 3 in 10^6 cases. Only distinct texts take part; a
class holds the copies of its texts too. In a bucket a few representatives are
compared with all members, drawn in one order for all buckets, so that texts that
meet in many buckets make the same few pairs there. Pairs whose signatures agree in
far too few registers go first (six standard deviations). A remaining pair counts if
the same similarity, taken from both whole texts' weighted bags, reaches the threshold.
Links give components. Buckets that still hold several components and more members than
were all compared are cut into blocks, bounded in members and shingles, and every two blocks
of a bucket meet in one task, first with bands and sketches, then those in a pair that these leave
with their texts. It compares the pairs with different components, each in the first bucket that the pair shares, and sends on links of
components only, never pairs. A component with many members in a bucket has blocks of its own, which
don't meet each other. This loses no pair, so every pair of such a bucket is compared or ruled out.

Defined cases: a null text is empty; texts are compared in lower case, cut at
white space; a text shorter than a shingle is one shingle of all its words;
texts without words are copies of each other and near to nothing else. A text of any length is
compared whole; memory follows the longest texts of a pair. Of equal candidates the smallest ``doc_id`` names the
class and the first row stays. Other columns, of whatever name, are carried by the stage. A null or
repeated ``doc_id`` is a row of its own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft.llm.common import Cache, cut, documents, join_groups, per_text, query, staged

WORDS = 5
SIMILAR = 0.8
BANDS = 24
ROWS = 4
REPRESENTATIVES = 3
REGISTERS = BANDS * ROWS
#: Bits of a table that tells which ids are wanted: so many at least and at most, and in between eight an id.
BITS = 1 << 23
MOST_BITS = 1 << 26
SALTS = 16
OFTEN = 32
#: Most members and shingles of a block.
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
#: Bytes of text that a task turns into shingles at once.
STEP = 2 << 20
_SLACK = 1e-9
_U64 = np.uint64


def _mixed(values: np.ndarray, salt: int) -> np.ndarray:
    """64-bit finaliser of the splitmix generator."""
    with np.errstate(over="ignore"):
        z = values + _U64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ (z >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U64(27))) * _U64(0x94D049BB133111EB)
        return z ^ (z >> _U64(31))


def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8"), digest_size=8).digest(), "little")


_hashes = Cache(_word_hash, 200_000)


def shingle_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as hashes, and how often each occurs."""
    if not words:
        return np.zeros(0, _U64), np.zeros(0, np.int64)
    each = np.array(list(map(_hashes.__getitem__, words)), dtype=_U64)
    n = max(1, len(each) - WORDS + 1)
    with np.errstate(over="ignore"):
        made = np.zeros(n, _U64)
        for i in range(min(WORDS, len(each))):
            made = _mixed(made + each[i : i + n], i + 1)
    return np.unique(made, return_counts=True)


def weight(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(counts)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """One row per bag: the shingle that first reaches each register. Bags must not be empty."""
    element = np.concatenate([h for h, _ in bags])
    rate = weight(np.concatenate([c for _, c in bags]))
    bag = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    first = np.full(len(bags) * registers, np.inf)
    holder = np.zeros(len(bags) * registers, _U64)
    time = np.zeros(len(element))
    step = 0
    while len(element):
        drawn = _mixed(element, 1000 + step)
        time = time - np.log((drawn >> _U64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / rate
        at = bag * registers + (_mixed(drawn, 77) % _U64(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = time == first[at]
        holder[at[won]] = element[won]
        latest = first.reshape(len(bags), registers).max(axis=1)
        on = time < latest[bag]
        element, rate, bag, time = element[on], rate[on], bag[on], time[on]
        step += 1
    return holder.reshape(len(bags), registers)


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(len(signature), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U64), rows.shape[:2])
    for i in range(ROWS):
        keys = _mixed(keys ^ rows[:, :, i], i + 1)
    return keys.astype(np.int64)


def _sketch(texts: list[str], batch: pa.RecordBatch) -> dict[str, pa.Array]:
    digests, bags, places = [], [], []
    for at, text in enumerate(texts):
        words = text.lower().split()
        digests.append(hashlib.blake2b(" ".join(words).encode("utf-8"), digest_size=16).digest())
        if words:
            bags.append(shingle_hashes(words))
            places.append(at)
    bands: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    sketch = [b""] * len(texts)
    if bags:
        signature = signatures(bags)
        short = (_mixed(signature, 3) & _U64(255)).astype(np.uint8)
        for at, keys, low in zip(places, band_keys(signature), short, strict=True):
            bands[at], sketch[at] = keys, low.tobytes()
    return {
        **{name: batch.column(name) for name in batch.schema.names if name != "text"},
        "text": pa.array(texts, pa.string()),
        "digest": pa.array(digests, pa.binary()),
        "bands": pa.array(bands, pa.list_(pa.int64())),
        "sketch": pa.array(sketch, pa.binary()),
    }


class Bag(NamedTuple):
    shingles: np.ndarray  # hashes, ascending
    weights: np.ndarray
    total: float


def bag_of(text: str) -> Bag:
    hashes, counts = shingle_hashes(text.lower().split())
    weights = weight(counts)
    return Bag(hashes, weights, float(weights.sum()))


def similarity(one: Bag, two: Bag, least: float = 0.0) -> float:
    """Probability Jaccard similarity of two weighted bags; 0 where a bound already shows it to be under ``least``.

    A common shingle ``i`` is the first of both processes with probability ``1 / sum(max(x_j / x_i, y_j / y_i))``
    over all ``j``. Sorted by ``x / y``, the maxima up to ``i`` come from ``y`` and those after it from ``x``.
    """
    if not len(one.shingles) or not len(two.shingles):
        return 0.0
    at = np.minimum(np.searchsorted(two.shingles, one.shingles), len(two.shingles) - 1)
    common = two.shingles[at] == one.shingles
    x, y = one.weights[common], two.weights[at[common]]
    sum_x, sum_y = x.sum(), y.sum()
    if len(x) == 0 or min(sum_x / one.total, sum_y / two.total) + _SLACK < least:
        return 0.0
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    # Equal ratios count as not beyond.
    end = np.searchsorted(ratio, ratio, side="right")
    below, above = np.concatenate([[0.0], np.cumsum(y)])[end], sum_x - np.concatenate([[0.0], np.cumsum(x)])[end]
    return float((1.0 / ((one.total - sum_x + above) / x + (two.total - sum_y + below) / y)).sum())


def marked(rows: DataFrame, ids: DataFrame, column: str, name: str, n: int = 0) -> DataFrame:
    """Rows with ``name``, true where the id is among the some ``n`` ``ids`` and for few others; a bit table is broadcast, the rows stay where they are."""
    bits = min(MOST_BITS, max(BITS, 1 << (8 * n).bit_length()))
    bit = f"pmod(xxhash64({column}), {bits})"
    table = ids.select(F.expr(f"{bit} div 64").alias("bit_at"), F.expr(f"shiftleft(1L, cast({bit} % 64 as int))").alias("bits"))
    table = table.groupBy("bit_at").agg(F.bit_or("bits").alias("bits"))
    held = rows.withColumn("bit_at", F.expr(f"{bit} div 64")).join(F.broadcast(table), "bit_at", "left")
    return held.withColumn(name, F.expr(f"coalesce(bits & shiftleft(1L, cast({bit} % 64 as int)), 0L) <> 0")).drop("bit_at", "bits")


def among(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose id is, but for few others, among ``ids``, which are written."""
    return marked(rows, ids, column, "is_among", ids.count()).where("is_among").drop("is_among")


def _least_agreeing(least: float) -> int:
    """Registers that agree but for one pair in 10^9 at ``least``: six standard deviations below those expected."""
    return int(least * REGISTERS - 6 * (REGISTERS * least * (1 - least)) ** 0.5)


def agreeing(both: DataFrame, columns: list[str], least: float) -> DataFrame:
    """``columns`` of the rows whose sketches ``of_a`` and ``of_b`` don't rule out the similarity."""
    enough = _least_agreeing(least)
    out = both.select(*columns)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, REGISTERS) for c in ("of_a", "of_b")
            )
            yield batch.select(columns).filter(pa.array((one == two).sum(axis=1) >= enough))

    return both.select(*columns, "of_a", "of_b").mapInArrow(check, out.schema)


def _beside(pairs: DataFrame, base: DataFrame, nodes: DataFrame, side: str, other: str, n: int) -> DataFrame:
    """Pairs with the sketch or text of one side; ``base`` has the same pairs, ``n`` of them, and is written.

    A side in more than ``OFTEN`` pairs, which may hold most of them, is marked by ``_often`` and salted by the
    other; its value goes out once per salt. All meet in one join.
    """
    value, often = nodes.columns[1], f"often_{side}"
    own = marked(nodes, base.select(F.col(side).alias("node")), "node", "is_among", n).where("is_among")
    own = marked(own, base.where(often).select(F.col(side).alias("node")), "node", often)
    salts = F.explode(F.expr(f"if({often}, sequence(-1, {SALTS - 1}), array(-1))")).alias("salt")
    own = own.select(F.col("node").alias(side), salts, F.col(value).alias(f"of_{side}"))
    salted = pairs.withColumn("salt", F.when(F.col(often), F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(-1))
    return salted.join(own, [side, "salt"]).drop("salt")


def _often(pairs: DataFrame) -> DataFrame:
    out = pairs
    for side in ("a", "b"):
        many = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")).where(f"n > {OFTEN}")
        out = marked(out, many, side, f"often_{side}")
    return out


def verified(pairs: DataFrame, nodes: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The pairs ``(a, b)`` marked by ``_often`` that are similar enough, with their other columns; ``nodes`` has ``node`` and ``text``.

    Only texts of such nodes are shuffled. ``pairs`` are written.
    """
    named, n = nodes.select("node", "text"), pairs.count()
    columns = pairs.columns
    sides = _beside(_beside(pairs, pairs, named, "b", "a", n), pairs, named, "a", "b", n)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            a = batch.column("a").to_pylist()
            keep = np.zeros(batch.num_rows, bool)
            for at in range(batch.num_rows):
                if a[at] != last:
                    last, held = a[at], bag_of(batch.column("of_a")[at].as_py())
                keep[at] = similarity(held, bag_of(batch.column("of_b")[at].as_py()), least) >= least - _SLACK
            yield batch.select(columns).filter(pa.array(keep))

    return sides.select(*columns, "of_a", "of_b").mapInArrow(check, pairs.schema)


def components(links: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node of each node's component, over links ``(a, b)``; written already.

    Rounds of large and small stars: every node points its larger neighbours, then
    its smaller ones, to the smallest. Only minima are gathered per node, by partial
    sums; rows are pairs of numbers, and a node that most of them name is split by the adaptive join.
    """
    links = staged(links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct(), "links")
    while not _stars(links):
        both = links.unionByName(links.select(F.col("root").alias("node"), F.col("node").alias("root")))
        near = staged(_pointed(both, F.col("root") > F.col("node")), "stars")
        links = staged(_pointed(near, F.lit(True), keep=True), "links")
    return links


def _stars(links: DataFrame) -> bool:
    """Whether every node has one root, which has none itself."""
    up = F.struct(F.col("node").alias("end"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = F.struct(F.col("root").alias("end"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = links.select(F.inline(F.array(up, down))).groupBy("end").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up + down > 1").isEmpty()


def _pointed(links: DataFrame, which: Column, keep: bool = False) -> DataFrame:
    """Neighbours ``root`` of ``node``, where ``which`` holds, to the smallest neighbour or the node itself; ``links`` are written."""
    least = links.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("low"))
    told = links.where(which).join(least, "node")
    out = told.select(F.col("root").alias("node"), F.col("low").alias("root"))
    if keep:
        out = out.unionByName(told.select("node", F.col("low").alias("root")))
    return out.where("node <> root").select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")).distinct()


def _pairs(members: DataFrame, total: int, least: float = SIMILAR) -> DataFrame:
    """Each bucket's representatives with the other members: ``(a, b, of, to)``, the last two their labels.

    Members bring their sketches, so that pairs which these rule out go where they arise.
    """
    drawn = F.struct(F.xxhash64("node").alias("at"), "node", "label", "sketch")
    ranked = members.select("key", drawn.alias("m"))
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("m.at", "m.node"))).where(F.col("place") <= REPRESENTATIVES)
    chosen = ranked.groupBy("key").agg(F.collect_list("m").alias("chosen"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    groups = staged(chosen.join(sizes, "key"), "chosen")
    rows = join_groups(members, groups, "key", "n", total).withColumn("m", F.explode("chosen"))
    rows = rows.where("m.node <> node AND m.label <> label")
    ends = F.struct("node", "label", "sketch"), F.struct("m.node", "m.label", "m.sketch")
    rows = rows.select(F.least(*ends).alias("one"), F.greatest(*ends).alias("two"))
    rows = rows.selectExpr("one.node AS a", "two.node AS b", "one.label AS of", "two.label AS to", "one.sketch AS of_a", "two.sketch AS of_b")
    return agreeing(rows, ["a", "b", "of", "to"], least).distinct()


def measured(texts: DataFrame) -> DataFrame:
    """Rows ``(node, text, bands, sketch)`` with ``size``, the different shingles of a text."""

    def made(found: list[str], batch: pa.RecordBatch) -> dict[str, pa.Array]:
        sizes = [len(shingle_hashes(t.lower().split())[0]) for t in found]
        return {name: batch.column(name) for name in ("node", "text", "bands", "sketch")} | {"size": pa.array(sizes, pa.int64())}

    return per_text(texts, made, "node bigint, text string, bands array<bigint>, sketch binary, size bigint", step=STEP)


def _meetings(members: DataFrame, total: int) -> DataFrame:
    """``(meet, side, key, node, label)``: the members of every two blocks of a bucket that may hold links, or of one block, side 0 only.

    ``members`` has ``key``, ``node``, ``label`` and ``size`` and is written, with ``total`` rows.
    """
    spots = members.withColumn("spot", F.struct("key", "label"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("size") / F.lit(BLOCK_SHINGLES))).alias("blocks")
    totals = F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), blocks
    labels = staged(spots.groupBy("spot").agg(*totals).select("spot", "spot.key", "spot.label", "n", "size", "blocks"), "spots")
    few = labels.where("blocks = 1").groupBy("key").agg(
        F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK)), F.ceil(F.sum("size") / F.lit(BLOCK_SHINGLES))).alias("common")
    )
    # A label with many members is cut by node and has blocks of its own, the others are dealt whole; -1 is no node.
    placed = labels.join(few, "key", "left").selectExpr(
        "spot", "key", "n", "if(blocks > 1, label, -1L) AS own", "if(blocks > 1, blocks, common) AS parts"
    )
    placed = staged(placed, "placed")
    each = placed.groupBy("key", "own").agg(F.max("parts").alias("parts")).where("parts > 0")
    each = each.select("key", "own", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    one, two = each.selectExpr("key", "own AS own_0", "part AS part_0"), each.selectExpr("key", "own AS own_1", "part AS part_1")
    meets = one.join(two, "key").where("own_0 < own_1 OR (own_0 = -1 AND own_1 = -1 AND part_0 <= part_1)")
    meets = staged(meets.withColumn("meet", F.monotonically_increasing_id()), "meets")
    dealt = join_groups(spots.drop("key", "size"), placed, "spot", "n", total)
    dealt = dealt.withColumn("part", F.expr("pmod(xxhash64(if(own = -1, label, node)), parts)")).select("key", "own", "part", "node", "label")

    def side(number: int) -> DataFrame:
        at = meets if number == 0 else meets.where("own_0 <> own_1 OR part_0 <> part_1")
        at = at.select("meet", "key", F.col(f"own_{number}").alias("own"), F.col(f"part_{number}").alias("part"))
        return dealt.join(at, ["key", "own", "part"]).select("meet", F.lit(number).alias("side"), "key", "node", "label")

    return side(0).unionByName(side(1))


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Neighbouring rows with one value of ``column``, over batches too."""
    parts: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(column).to_numpy()
        edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for start, end in zip(edges, edges[1:], strict=False):
            if start == end:
                continue
            if parts and parts[-1].column(column)[0].as_py() != values[start]:
                yield pa.Table.from_batches(parts)
                parts = []
            parts.append(batch.slice(start, end - start))
    if parts:
        yield pa.Table.from_batches(parts)


def _possible(met: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ``first`` and ``second`` of the pairs of two blocks, or of one, that nothing rules out yet, and how many registers of each agree.

    ``met`` has ``key``, ``side``, ``label``, ``bands`` and ``sketch``.
    """
    label, side = met["label"].to_numpy(), met["side"].to_numpy()
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = len(two) == 0
    if within:
        two = one
    if len(one) == 0:
        return one, one, one
    bands = np.array(met["bands"].to_pylist(), dtype=np.int64)
    sketch = np.frombuffer(b"".join(met["sketch"].to_pylist()), dtype=np.uint8).reshape(-1, REGISTERS)
    possible = label[one][:, None] != label[two]
    if within:
        possible &= ~np.tri(len(one), dtype=bool)
    # Pairs that share an earlier bucket were compared there.
    for band in range(int(np.flatnonzero(bands[0] == met["key"][0].as_py())[0])):
        possible &= bands[one, band][:, None] != bands[two, band]
    agree = np.zeros(possible.shape, dtype=np.uint8)
    for register in range(REGISTERS):
        agree += sketch[one, register][:, None] == sketch[two, register]
    first, second = np.nonzero(possible & (agree >= _least_agreeing(least)))
    return one[first], two[second], agree[first, second].astype(np.int64)


def _links(met: pa.Table, least: float) -> list[tuple[int, int]]:
    """Labels linked by similar texts of two blocks, or of one."""
    met = met.combine_chunks()
    label = met["label"].to_numpy()
    first, second, agree = _possible(met, least)
    if len(first) == 0:
        return []
    order = np.argsort(-agree, kind="stable")
    texts = met["text"]
    made: dict[int, Bag] = {}

    def bag(at: int) -> Bag:
        if at not in made:
            made[at] = bag_of(texts[at].as_py())
        return made[at]

    root = {x: x for x in label.tolist()}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    found = []
    for a, b in zip(first[order].tolist(), second[order].tolist(), strict=True):
        x, y = top(int(label[a])), top(int(label[b]))
        if x != y and similarity(bag(a), bag(b), least) >= least - _SLACK:
            root[x] = y
            found.append((x, y))
    return found


def screened(meetings: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The rows of ``meetings`` in a pair that bands and sketches of ``nodes`` don't rule out; only these meet with their texts."""
    met = meetings.join(nodes, "node").repartition("meet").sortWithinPartitions("meet")
    columns = meetings.columns

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "meet"):
            first, second, _ = _possible(table.combine_chunks(), least)
            yield from table.select(columns).take(np.union1d(first, second)).to_batches()

    return met.mapInArrow(check, meetings.schema)


def settled(members: DataFrame, rows: DataFrame, least: float = SIMILAR, total: int | None = None) -> DataFrame:
    """``(a, b)``: labels of open buckets that similar texts link, every pair with different labels compared or ruled out.

    ``members`` has ``key``, ``node`` and ``label`` and is written, with ``total`` rows where known; ``rows`` has ``node``, ``text``, ``bands`` and ``sketch``.
    """
    held = staged(measured(rows.join(members.select("node").distinct(), "node", "left_semi")), "open_texts")
    sized = staged(members.join(held.select("node", "size"), "node"), "sized")
    meetings = staged(screened(_meetings(sized, members.count() if total is None else total), held.select("node", "bands", "sketch"), least), "meetings")
    met = meetings.join(held.drop("size"), "node").repartition("meet").sortWithinPartitions("meet")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "meet"):
            if links := _links(table, least):
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.mapInArrow(compare, "a bigint, b bigint")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """``(doc_id, class_id, class_size, kept)`` per row.

    ``class_id`` is the smallest ``doc_id`` of the class, nulls last; one row of a class is kept.
    """
    rows, total, merged, texts = _merged(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), least)
    whole = merged.groupBy("label").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("class_size"), F.min("first").alias("keeper"))
    merged = join_groups(merged.drop("first"), staged(whole, "whole"), "label", "texts", texts)
    out = join_groups(rows.select("doc_id", "at", "digest"), staged(merged.select("digest", "n", "class_size", "keeper"), "named"), "digest", "n", total)
    return out.select("doc_id", F.col("keeper.doc_id").alias("class_id"), "class_size", (F.col("at") == F.col("keeper.at")).alias("kept"), "digest")


def _merged(source: DataFrame, least: float = SIMILAR) -> tuple[DataFrame, int, DataFrame, int]:
    """The written rows, with all columns of ``source`` and their place ``at``, and how many; the written distinct texts,
    ``(digest, node, n, first, label)``, and how many. Texts of one ``label`` are a class; its least ``first`` names the row that stays."""
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "text")
    rows = per_text(source, _sketch, f"{kept}, text string, digest binary, bands array<bigint>, sketch binary", step=STEP)
    rows = staged(rows.withColumn("at", F.monotonically_increasing_id()), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("first")
    copies = staged(rows.groupBy("digest").agg(F.min("at").alias("node"), F.count(F.lit(1)).alias("n"), first), "copies")
    # Bands of texts without copies stay where they are.
    several = copies.where("n > 1")
    total, n_texts, n_several = copies.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("n") > 1)).first()
    held = marked(rows.select("at", "digest", "bands"), several.select("digest"), "digest", "is_copy", n_several)
    firsts = held.where("is_copy").join(copies.select(F.col("node").alias("at")), "at", "left_semi")
    nodes = held.where("NOT is_copy").unionByName(firsts).select(F.col("at").alias("node"), "bands")
    # Rows only stay or go here, so the adaptive join may split a hot bucket's.
    counted = nodes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    crowded = staged(counted.where("n > 1").select("key"), "crowded")
    # Most keys go by a bit table, before anything is shuffled; copies of a text go with the few that stay.
    members = among(rows.select(F.col("at").alias("node"), F.explode("bands").alias("key")), crowded, "key")
    members = members.join(crowded, "key", "left_semi").join(copies.select("node"), "node", "left_semi")
    members = staged(members.select("key", "node"), "members")
    size = members.count()
    sketches = marked(rows.select(F.col("at").alias("node"), "sketch"), members.select("node"), "node", "is_among", size).where("is_among")
    members = members.join(sketches.drop("is_among"), "node")
    members = staged(members.select("key", "node", "sketch", F.col("node").alias("label")), "buckets")
    texts = rows.select(F.col("at").alias("node"), "text")

    def linked(pairs: DataFrame) -> DataFrame:
        """Links of written pairs that their sketches don't rule out."""
        return staged(verified(staged(_often(pairs), "marked"), texts, least), "similar").select(F.col("of").alias("a"), F.col("to").alias("b"))

    labels = None
    if size > 0:
        pairs = staged(_pairs(members, size, least), "pairs")
        labels = components(linked(pairs))
        left = _open(staged(_labelled(members.drop("sketch", "label"), labels), "relabelled"), size)
        if (n_left := left.count()) > 0:
            sources = rows.select(F.col("at").alias("node"), "text", "bands", "sketch")
            labels = _combined(labels, components(staged(settled(left, sources, least, n_left), "settled")))
    merged = copies.withColumn("label", F.col("node")) if labels is None else _labelled(copies, labels)
    return rows, total, staged(merged, "classes"), n_texts


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with their node's root as ``label``, or the node itself; a node has ``BANDS`` rows at most."""
    return rows.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")


def _relabelled(rows: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """Rows, which are written, with ``column`` replaced by its root, where it has one."""
    used = rows.groupBy(F.col(column).alias("node")).agg(F.count(F.lit(1)).alias("uses"))
    known = used.join(roots, "node", "left").select(F.col("node").alias(column), "uses", F.coalesce("root", "node").alias("to"))
    return join_groups(rows, staged(known, "known"), column, "uses", rows.count()).drop(column, "uses").withColumnRenamed("to", column)


def _combined(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots of all nodes that have one, after the labels themselves were linked."""
    moved = _relabelled(labels.select("node", F.col("root")), roots, "root")
    new = roots.join(labels.select("node"), "node", "left_anti")
    return staged(moved.select("node", "root").unionByName(new.select("node", "root")), "labels")


def _open(members: DataFrame, total: int) -> DataFrame:
    """Members of buckets that hold several components and were not compared in full, of ``total`` written ones."""
    state = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    state = staged(state.where(f"n > {REPRESENTATIVES + 1} AND low < high").select("key", "n"), "open")
    return staged(join_groups(members, state, "key", "n", total).select("key", "node", "label"), "buckets")


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: one per class."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text]
    own = F.struct(F.col(text).isNull().alias("none"), *others).alias("own")
    rows, _, merged, _ = _merged(docs.select(F.col(key).alias("doc_id"), own, F.col(text).alias("text")))
    stay = merged.groupBy("label").agg(F.min("first").alias("keeper")).select(F.col("keeper.at").alias("at"))
    # Rows alone in their class stay where they are; only the others' texts are shuffled.
    roots = merged.where("label <> node").select(F.col("label").alias("node")).distinct()
    several = merged.where("n > 1 OR label <> node").select("digest")
    several = staged(several.unionByName(merged.join(roots, "node", "left_semi").select("digest")), "several")
    held = marked(rows, several, "digest", "in_class", several.count())
    one = held.where("NOT in_class").unionByName(held.where("in_class").join(stay, "at", "left_semi"))
    back = [F.expr("if(own.none, NULL, text)") if c == text else F.col(f"own.c{i}") for i, c in enumerate(docs.columns)]
    return one.select(*[c.alias(name) for c, name in zip(back, docs.columns, strict=True)])


@query("op4_near_dedup")
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).drop("digest")
