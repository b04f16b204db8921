"""The operators against libraries, brute force and round trips, and on awkward input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docweft.llm import bpe, bytepair, exact_dedup, language, near_dedup, neighbours, packing, pii, token_counts, toxicity, warc

LONG = "word " * 30_000
AWKWARD = [None, "", " ", "\n\t", "é" * 500, "a" * 5000, "<|endoftext|> x", "  two  spaces ", LONG, "same text here", "same text here"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, at string, kept string, label string, part string"


def awkward(spark, texts=AWKWARD):
    """Null and repeated ids, nulls in every column, extra columns whose names the operators use themselves."""
    ids = [None, *range(len(texts) - 2), len(texts) - 3]
    return spark.createDataFrame([(i, t, None, None, None, "x", None, "y", "z", "p") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def random_texts(alphabet, n, longest=60, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, longest))) for _ in range(n)]


# ---- tokens -----------------------------------------------------------------

MIXED = random_texts("ab  \n\t'sdléß日本🎉12.,!-\x1c 　re", 800) + random_texts("ab", 300, 200) + [t or "" for t in AWKWARD]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bytepair.default_path())


def test_encoding_equals_the_library(spark, library):
    rows = spark.createDataFrame(list(enumerate(MIXED)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in bpe.decoded(bpe.encoded(rows)).collect()}
    counts = {r["doc_id"]: r for r in token_counts.counted(rows).collect()}
    for i, text in enumerate(MIXED):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i]["ids"] == ids
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert (counts[i]["n_tokens"], counts[i]["n_bytes"]) == (len(ids), len(text.encode()))


def test_compatible_pairs_are_those_that_merging_gives_back():
    vocab = bytepair.vocabulary(bytepair.read_source(None))
    encoder, draw = bpe.Encoder(vocab), random.Random(2)
    common = [n for n, t in enumerate(vocab.tokens) if len(t) <= 3 and t.isalpha()]
    for _ in range(5000):
        a, b = draw.choice(common), draw.choice(common)
        alone = vocab.merged(vocab.tokens[a]) == [a] and vocab.merged(vocab.tokens[b]) == [b]
        if alone:
            assert encoder.compatible(a, b) == (vocab.merged(vocab.tokens[a] + vocab.tokens[b]) == [a, b])


def test_word_ids_equal_the_library():
    encoder = packing.WordEncoder(bytepair.read_source(packing.default_path()))
    for text in random_texts("abZÉ \n\t'sdléßΣς日本🎉12.,!-\x1c İé", 1500) + ["It's <|endoftext|>x<|startoftext|> I'LL"]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids


# ---- packing ----------------------------------------------------------------


@pytest.mark.parametrize("counts", [{}, {1: 3}, {10: 1000}, {3000: 7, 10: 5}, {4096: 2}, {2048: 3, 1024: 5, 4000: 9, 96: 20}])
def test_plan_uses_every_length_once(counts):
    used = Counter()
    for pattern, times in packing.plan(counts):
        assert times > 0 and sum(a * b for a, b in pattern) <= 4096
        for length, n in pattern:
            used[length] += n * times
    assert used == Counter(counts)


def test_plan_fills_exactly_where_complements_exist():
    patterns = packing.plan({4000: 10, 96: 4, 50: 6, 46: 6})
    assert sum(times for _, times in patterns) == 10


def test_packed_sequences_have_no_gap_or_overlap(spark):
    rows = packing.packed(packing.pieces(awkward(spark), with_ids=True)).collect()
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SIZE
    assert sum(r["piece"] == 0 for r in rows) == len(AWKWARD)


# ---- copies -----------------------------------------------------------------


def test_exact_copies_on_awkward_rows(spark):
    rows = exact_dedup.marked(awkward(spark)).collect()
    texts = {re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in AWKWARD}
    assert len(rows) == len(AWKWARD) and sum(r["kept"] for r in rows) == len(texts)
    stay = exact_dedup.without_copies(awkward(spark))
    assert stay.columns == awkward(spark).columns and stay.count() == len(texts)


def test_hot_digests_are_found_and_settled(spark):
    texts = ["copy"] * 3000 + [f"text {i % 2500}" for i in range(5000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.marked(rows).collect()}
    first, size = {}, Counter(texts)
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    assert got == {i: (first[t], size[t], first[t] == i) for i, t in enumerate(texts)}


def _similarity(a, b):
    """Probability Jaccard similarity of bags in which a shingle seen c times weighs 1 + ln c, by its definition."""
    bags = []
    for t in (a, b):
        w = t.lower().split()
        bags.append(Counter(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else Counter([tuple(w)]))
    every = list(bags[0].keys() | bags[1].keys())
    if max(*bags[0].values(), *bags[1].values()) == 1:
        return len(bags[0].keys() & bags[1].keys()) / len(every)
    x, y = (np.array([1 + np.log(bag[k]) if k in bag else 0.0 for k in every]) for bag in bags)
    return sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in np.flatnonzero((x > 0) & (y > 0)))


def test_similarity_and_its_bound_equal_the_definition():
    draw = random.Random(12)
    for _ in range(60):
        base = [f"w{draw.randint(0, 30)}" for _ in range(draw.randint(1, 60))]
        line = base[: draw.randint(1, 12)]
        a, b = (" ".join(base[draw.randint(0, 3) :] + line * draw.choice([0, 1, 5, 40])) or "w0" for _ in range(2))
        one, two = near_dedup.bag_of(a), near_dedup.bag_of(b)
        exact = _similarity(a, b)
        assert near_dedup.similarity(one, two) == pytest.approx(exact, abs=1e-9)
        assert (near_dedup.similarity(one, two, 0.8) >= 0.8 - 1e-9) == (exact >= 0.8 - 1e-9)


def test_near_copies_equal_brute_force(spark):
    draw = random.Random(4)
    texts = []
    for _ in range(12):
        base = [f"w{draw.randint(0, 400)}" for _ in range(draw.randint(4, 150))]
        for _ in range(draw.randint(1, 9)):
            copy = list(base)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if _similarity(texts[i], texts[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(rows).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_near_copies_in_crowded_buckets_equal_brute_force(spark, monkeypatch):
    """All texts resemble each other at 0.75 to 0.8, thirty pairs of them at 0.84; most buckets hold most texts."""
    monkeypatch.setattr(near_dedup, "REPRESENTATIVES", 1)
    draw = random.Random(7)
    places = draw.sample([(p, q) for p in range(5, 195, 5) for q in range(5, 195, 5) if p < q], 200)
    texts, twin = [], {}
    for n, (p, q) in enumerate(places):
        words = [f"t{i}" for i in range(200)]
        words[p] = f"own{n}a"
        words[q] = f"own{n}b"
        texts.append(" ".join(words + [f"end{n}x{i}" for i in range(8)]))
    for n in range(30):
        words = texts[n].split()[:200]
        p, q = places[n]
        words[q] = f"t{q}"
        r = next(r for r in range(5, 195, 5) if r not in (p, q) and tuple(sorted((p, r))) not in places)
        places.append(tuple(sorted((p, r))))
        words[r] = f"twin{n}"
        texts.append(" ".join(words + [f"twin{n}x{i}" for i in range(8)]))
        twin[200 + n] = n
    near = {(i, j) for i in range(len(texts)) for j in range(i) if _similarity(texts[i], texts[j]) >= 0.8}
    assert near == set(twin.items())
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(rows).collect()}
    assert got == {i: twin.get(i, i) for i in range(len(texts))}


@pytest.mark.parametrize(("block", "shingles", "split"), [(2, 1 << 20, 30), (512, 100, 30), (3, 1 << 20, 2), (512, 1 << 20, 30)])
def test_open_buckets_are_compared_whatever_the_blocks(spark, monkeypatch, block, shingles, split):
    """Links join the same labels as brute force over all pairs that share an open bucket; with two labels each has blocks of its own."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
    draw = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[: draw.randint(40, 60)] + [f"x{draw.randint(0, 3)}" for _ in range(draw.randint(0, 6))]) for _ in range(40)]
    texts += ["one", "one two", "one two three four five"]
    bags = [near_dedup.shingle_hashes(t.split()) for t in texts]
    signed = near_dedup.signatures(bags)
    bands = near_dedup.band_keys(signed)
    sketch = (near_dedup._mixed(signed, 3) & np.uint64(255)).astype(np.uint8)
    kept = [(i, t, bands[i].tolist(), bytearray(sketch[i].tobytes())) for i, t in enumerate(texts)]
    rows = spark.createDataFrame(kept, "node bigint, text string, bands array<bigint>, sketch binary")
    members = rows.select(F.explode("bands").alias("key"), "node", (F.col("node") % split).alias("label"))
    buckets = defaultdict(set)
    for i in range(len(texts)):
        for k in bands[i].tolist():
            buckets[k].add(i)
    root = list(range(split))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for held in buckets.values():
        for i in held:
            for j in held:
                if i < j and _similarity(texts[i], texts[j]) >= 0.8:
                    root[max(find(i % split), find(j % split))] = min(find(i % split), find(j % split))
    links = near_dedup.settled(members, rows).collect()
    assert all(find(r["a"]) == find(r["b"]) and r["a"] != r["b"] for r in links)
    got = list(range(split))

    def top(i):
        while got[i] != i:
            i = got[i]
        return i

    for r in links:
        got[max(top(r["a"]), top(r["b"]))] = min(top(r["a"]), top(r["b"]))
    assert [top(i) for i in range(split)] == [find(i) for i in range(split)]
    assert len({find(i) for i in range(split)}) < split


def test_near_copies_with_a_line_repeated_in_one_of_them(spark):
    draw = random.Random(9)
    texts = []
    for n in range(60):
        base = [f"w{n}x{i}" for i in range(170)]
        copy = list(base)
        copy[100] = f"changed{n}"
        line = base[20 : 20 + draw.choice([3, 6, 8, 20, 70])]
        texts += [" ".join(base), " ".join(copy[:90] + line * draw.choice([2, 30, 100, 1000]) + copy[90:])]
    near = [_similarity(a, b) >= 0.8 for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert 10 <= sum(near) <= 50
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(rows).collect()}
    assert got == {i: i - (i % 2 and near[i // 2]) for i in range(len(texts))}


def test_registers_agree_as_often_as_the_bags_are_similar():
    a, b = (np.arange(lo, lo + 100, dtype=np.uint64) for lo in (0, 20))
    ones = np.ones(100, dtype=np.int64)
    found = near_dedup.signatures([(a, ones), (b, ones), (a, ones)], 4096)
    assert (found[0] == found[2]).all()
    assert abs((found[0] == found[1]).mean() - 80 / 120) < 0.04


def test_registers_agree_as_often_as_weighted_bags_are_similar():
    a = " ".join(f"w{i}" for i in range(60))
    b = a + " " + " ".join([f"w{i}" for i in range(30, 50)] * 25)
    bags = [near_dedup.shingle_hashes(t.split()) for t in (a, b)]
    found = near_dedup.signatures(bags, 4096)
    assert max(bags[1][1]) == 26 and _similarity(a, b) < 0.75
    assert abs((found[0] == found[1]).mean() - _similarity(a, b)) < 0.04


def test_near_copies_on_awkward_rows(spark):
    rows = near_dedup.classes(awkward(spark)).collect()
    words = {" ".join((t or "").lower().split()) for t in AWKWARD}
    assert len(rows) == len(AWKWARD) and sum(r["kept"] for r in rows) == len(words)
    assert near_dedup.without_near_copies(awkward(spark)).columns == awkward(spark).columns


def test_one_row_of_each_class_stays_whatever_the_ids(spark):
    texts = [" ".join(f"w{n}x{i}" for i in range(80)) for n in range(6)]
    copies = [t.replace("x40", "changed") for t in texts]
    # Null ids with different texts; an id of two texts, the smaller one a copy of a text with a smaller id; null and empty texts.
    rows = [(None, texts[0]), (None, texts[1]), (None, copies[1]), (None, texts[2]), (1, texts[3]), (5, texts[4]), (5, copies[3]), (5, texts[4]), (7, texts[5]), (7, copies[5]), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, n, t) for n, (i, t) in enumerate(rows)], "doc_id bigint, at int, text string")
    stay = near_dedup.without_near_copies(docs)
    assert stay.schema.simpleString() == docs.schema.simpleString()
    kept = [tuple(r) for r in stay.collect()]
    assert set(kept) <= {(i, n, t) for n, (i, t) in enumerate(rows)}
    groups = [{0}, {1, 2}, {3}, {4, 6}, {5, 7}, {8, 9}, {10, 11}]
    assert len(kept) == len(groups) and all(len({n for _, n, _ in kept} & g) == 1 for g in groups)


# ---- personal data ----------------------------------------------------------

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _plain_spans(text):
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            luhn = sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
            fine = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and luhn,
                "phone": 9 <= len(digits) <= 15,
            }
            if fine[kind]:
                yield kind, *m.span()


@pytest.mark.parametrize("alphabet", ["a.@-1 b", "0123.45 6-", "+0123 ().-9", "1.2.3.4.5.255 ", "@.a1_é"])
def test_base_spans_equal_the_patterns(alphabet):
    for text in random_texts(alphabet, 4000, 40):
        assert pii.base_spans(text) == list(_plain_spans(text))


def test_terms_that_give_an_entity_away_are_found_and_cleaned(spark):
    told = [f"filler{chr(97 + i)} words about Zorblatt mail zed@example.com now" for i in range(6)]
    other = [f"nothing about mail now or here {chr(97 + i % 26) * 4}" for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(told + other + [None, ""])), "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in pii.sanitised(rows).collect()}
    assert len(got) == len(told) + len(other) + 2
    for i in range(6):
        assert "Zorblatt" not in got[i] and "zed@" not in got[i] and "[EMAIL]" in got[i] and "mail" in got[i]
    assert all(got[6 + i] == t for i, t in enumerate(other)) and got[66] is None and got[67] == ""


def test_terms_are_cleaned_far_from_their_entity_too(spark):
    told = [f"filler{chr(97 + i)} about Zorblatt mail zed@example.com now" for i in range(30)]
    far = "Zorblatt mail zed@example.com\n" + "plain " * 400 + "then ZORBLATT again"
    alone = "here Zorblatt goes without the address"
    other = [f"nothing about mail now or here then again plain goes without the address {chr(97 + i % 26) * 4}" for i in range(900)]
    rows = spark.createDataFrame(list(enumerate([*told, far, alone, *other])), "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in pii.sanitised(rows).collect()}
    assert not any("zorblatt" in t.lower() for t in got.values())
    assert got[30].endswith("again") and got[30].count("plain") == 400 and got[31].endswith("goes without the address")
    assert all(got[32 + i] == t for i, t in enumerate(other))


# ---- archives ---------------------------------------------------------------


def test_archives_round_trip(spark):
    big = "ü" * 300_000
    pages = [(1, "http://a/?q=1%20 x", big), (2, None, big), (3, "b", None), (4, "c", "short"), (5, "d", "short"), (None, "e", big), (1, "f", big)]
    rows = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    chunks = warc.chunk_table(warc.written(rows), chunk=65_536).collect()
    records = defaultdict(list)
    for c in chunks:
        records[c["record"]].append(c)
    assert len(records) == len(pages)
    kinds = Counter()
    for parts in records.values():
        parts.sort(key=lambda c: c["chunk_no"])
        body = b"".join(c["data"] for c in parts)
        last = parts[-1]
        kinds[last["record_type"], last["refers_to"]] += 1
        if last["record_type"] == "response":
            assert last["digest"] == hashlib.sha256(body).hexdigest() and len(body) == last["payload_bytes"]
            assert all(len(c["data"]) <= 65_536 for c in parts)
            assert [c["digest"] for c in parts] == [hashlib.sha256(body[: c["start"] + c["n_bytes"]]).hexdigest() for c in parts]
        else:
            assert last["payload_bytes"] == 600_000 and last["digest"] == hashlib.sha256(big.encode()).hexdigest()
    assert kinds == {("response", None): 4, ("revisit", 1): 3}
    assert warc.chunk_table(warc.written(rows.limit(0))).count() == 0


# ---- vectors ----------------------------------------------------------------


def test_neighbours_equal_brute_force_on_awkward_vectors(spark):
    draw = np.random.default_rng(3)
    vectors = draw.standard_normal((300, 8)).astype(np.float32)
    vectors[100:200] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [1.0] * 3), (480, [None] * 8), (None, [1.0] * 8), (500, [float("inf")] * 8)]
    table = spark.createDataFrame(rows + odd + rows[:5], "vec_id bigint, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 300, 20))
    exact = vectors.astype(np.float64)
    for q, found in got.items():
        scores = exact @ exact[q]
        best = [i for i in np.lexsort((np.arange(300), -np.round(scores, 9))) if i != q][:20]
        assert [i for i, _ in found] == best
        assert np.allclose([s for _, s in found], scores[best], atol=1e-12)


def test_recall_of_learned_parts(spark, sf_dir):
    draw = np.random.default_rng(5)
    vectors = draw.standard_normal((6000, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    got = defaultdict(set)
    for r in neighbours.nearest(rows, F.col("vec_id") % 100 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    exact = vectors.astype(np.float32).astype(np.float64)
    hits = sum(len(got[q] & set(np.argsort(-(exact @ exact[q]))[:21]) - {q}) for q in got)
    assert hits / (20 * len(got)) >= 0.9


def test_only_visited_parts_are_ranked_whatever_the_blocks(spark, monkeypatch):
    draw = np.random.default_rng(6)
    centres = 8 * draw.standard_normal((40, 16))
    vectors = (centres[draw.integers(0, 40, 6000)] + draw.standard_normal((6000, 16))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    monkeypatch.setattr(neighbours, "PART_ROWS", 400)
    learned, real = [], neighbours.learn
    monkeypatch.setattr(neighbours, "learn", lambda *a: learned.append(real(*a)) or learned[-1])

    def answers():
        return sorted(map(tuple, neighbours.nearest(rows, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id").collect()))

    whole = answers()
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "CHUNK_BYTES", 8 * 16 * 300)
    monkeypatch.setattr(neighbours, "HELD", 500)
    assert answers() == whole
    assert len(learned[0].b2) == 16
    assert learned[0].probes <= 8
    exact, hits = vectors.astype(np.float64), 0
    for q in range(0, 6000, 50):
        hits += len({v for i, _, v in whole if i == q} & set(np.argsort(-(exact @ exact[q]))[:21]))
    assert hits / len(whole) >= 0.9


def test_halves_are_balanced():
    vectors = np.random.default_rng(1).standard_normal((1024, 8))
    label = neighbours.balanced_parts(neighbours.neighbour_graph(vectors, 10), 8)
    assert np.bincount(label).tolist() == [128] * 8


# ---- language and toxicity --------------------------------------------------

EN = "the quick brown fox jumps over the lazy dog and then sleeps in the warm sun "
DE = "der schnelle braune fuchs springt über den faulen hund und schläft dann "
RU = "быстрая коричневая лиса прыгает через ленивую собаку "


def test_spans_of_mixed_text():
    model = language.fitted([EN * 3, DE * 3, RU * 3], ["en", "de", "ru"])
    found = language.spans([EN + DE + RU, "", "123 !"], model)
    assert [s[2] for s in found[0]] == ["en", "de", "ru"] and found[1:] == [[], []]
    text = EN + DE + RU
    assert text[found[0][1][0] : found[0][1][1]].startswith("der schnelle")


def test_best_path_equals_plain_viterbi():
    draw = np.random.default_rng(2)
    scores, penalty = draw.normal(size=(60, 3)), 1.5
    text_of = np.repeat([0, 1, 3], [30, 10, 20])
    label = language.best_path(scores, text_of, 4, penalty)
    for text in (0, 1, 3):
        own = scores[text_of == text]
        value = own[0].copy()
        for row in own[1:]:
            value = np.maximum(value, value.max() - penalty) + row
        path = label[text_of == text]
        assert np.isclose(own[np.arange(len(own)), path].sum() - penalty * (np.diff(path) != 0).sum(), value.max())


def test_languages_of_held_out_documents(spark, sf_dir):
    docs = language.documents(spark, sf_dir)
    rows = language.op7_language(spark, sf_dir).where("held_out").join(docs, "doc_id")
    right, total = rows.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.95 * total


def test_languages_of_long_texts_are_learned(spark):
    texts = [(i, RU * 500 if i % 2 else EN, "ru" if i % 2 else "en") for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    rows = language.labelled(docs.withColumn("text", F.substring("text", 1, 50)), language.learned(docs)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in rows} == {i: lang for i, _, lang in texts}


def test_toxic_words_are_learned_and_unseen_forms_known():
    draw = random.Random(3)
    filler = ["".join(draw.choice("aeioulmnrst") for _ in range(5)) for _ in range(300)]
    stems = ["grumwok", "blathex"]

    def text(toxic, n):
        words = [draw.choice(filler) for _ in range(n)]
        if toxic:
            words[draw.randrange(n)] = draw.choice(stems) + draw.choice(["", "ing", "ers", "ly"])
        return " ".join(words)

    labels = [i % 2 for i in range(1200)]
    network = toxicity.fitted([text(y, draw.randint(5, 60)) for y in labels], labels, [None] * 1200)
    unseen = [" ".join([*draw.choices(filler, k=20), draw.choice(stems) + "oid"]) for _ in range(50)]
    cleans = [text(0, 20) for _ in range(50)]
    seen = [text(1, 20) for _ in range(50)]
    found = toxicity.scores(network, [*unseen, *cleans, *seen, ""])
    assert (found[50:100] < 0.7).mean() >= 0.9 and (found[100:150] >= 0.7).mean() >= 0.9 and 0 <= found[150] <= 1
    assert (found[:50, None] > found[None, 50:100]).mean() >= 0.95


def labelled_texts(spark, n):
    texts = [(i, f"{EN * (1 + i % 3)} {i} " + ("word " * 1500 + "grumwok" if i % 4 == 0 else ""), ["en", "de", None][i % 3]) for i in range(n)]
    docs = spark.createDataFrame([*texts, (None, "no id", "en")], "doc_id bigint, text string, lang string")
    return docs, docs.where("doc_id < 800").select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))


def test_every_labelled_text_is_learned_from_whole(spark, monkeypatch):
    docs, labels = labelled_texts(spark, 900)
    rounds, held = [], []
    monkeypatch.setattr(toxicity, "STEPS", 4)
    monkeypatch.setattr(toxicity, "_round", lambda rows, weights, sums, weigh, workers: rounds.append(([tuple(r) for r in rows.collect()], workers)))
    monkeypatch.setattr(toxicity, "calibrated", lambda network, rows: held.extend(r["text"] for r in rows.collect()))
    monkeypatch.setattr(language, "counted", lambda rows: held.append(sorted(r["text"] for r in rows.collect())) or language.fitted([], []))
    toxicity.learned(docs, labels)
    everything = held.pop(0)
    want = [r["text"] for r in docs.where(~toxicity.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).join(labels, "doc_id").collect()]
    assert sorted([r[3] for rows, _ in rounds for r in rows] + held) == sorted(want) == everything
    assert len(rounds) == toxicity.ROUNDS and {w for _, w in rounds} == {2} and {r[0] for rows, _ in rounds for r in rows} == {0, 1}
    # Fewer rows are gone over more often, and evenly.
    rows = spark.range(100).select("id", F.pmod(F.xxhash64("id"), F.lit(toxicity.ROUNDS)).alias("slot"))
    for passes in (3, 16):
        seen = [r["id"] for turn in range(toxicity.ROUNDS) for r in toxicity._taken(rows, turn, passes).collect()]
        assert sorted(seen) == sorted(list(range(100)) * passes)


def test_long_labelled_texts_count(spark, monkeypatch):
    # All toxic texts are above 6000 characters.
    docs, labels = labelled_texts(spark, 900)
    monkeypatch.setattr(toxicity, "STEPS", 60)
    rows = toxicity.scored(docs.where("doc_id >= 800"), toxicity.learned(docs, labels))
    found = {r["doc_id"]: r["toxicity"] for r in rows.collect()}
    assert all((score >= toxicity.CUT) == (i % 4 == 0) for i, score in found.items())


def test_a_round_adds_the_mean_of_what_workers_change(spark):
    texts = [(i % 2, i, i % 3 % 2, " ".join(random_texts("abcde", 9, 6, seed=i))) for i in range(240)]
    rows = spark.createDataFrame(texts, "worker int, at bigint, toxic int, text string").repartition(5)
    weigh = np.array([0.75, 1.5])
    weights, sums = toxicity._begun()
    toxicity._round(rows, weights, sums, weigh, 2)
    first, ends = toxicity._begun(), [toxicity._begun() for _ in range(2)]
    for worker, end in enumerate(ends):
        own = [t for t in texts if t[0] == worker]
        for start in range(0, len(own), toxicity.BATCH):
            labels = np.array([t[2] for t in own[start : start + toxicity.BATCH]])
            toxicity._stepped(*end, [t[3] for t in own[start : start + toxicity.BATCH]], labels, weigh[labels])
    changed = [((end[0][0] != first[0][0]) | (end[1][0] != first[1][0])).any(axis=1) for end in ends]
    assert (changed[0] ^ changed[1]).any() and (changed[0] & changed[1]).any()
    for kind, got in enumerate((weights, sums)):
        for i, array in enumerate(got):
            by = np.maximum(1, changed[0] * 1 + changed[1])[:, None] if i == 0 else 2
            want = first[kind][i] + sum(end[kind][i] - first[kind][i] for end in ends) / by
            np.testing.assert_allclose(array, want, rtol=1e-4, atol=1e-5)


def test_counted_languages_equal_those_of_a_list(spark):
    texts = [(EN, "en"), (DE * 900, "de"), (RU, "ru"), ("123", "none"), (DE, None), (None, "en"), ("", "en")] * 5
    got = language.counted(spark.createDataFrame(texts, "text string, lang string").repartition(4))
    known = [t for t in texts if None not in t]
    want = language.fitted([t for t, _ in known], [x for _, x in known])
    assert got.names == want.names and np.array_equal(got.table, want.table) and np.array_equal(got.scripts, want.scripts)


# ---- all of them ------------------------------------------------------------

OPERATORS = {
    "counted": token_counts.counted,
    "encoded": lambda d: bpe.decoded(bpe.encoded(d)),
    "packed": lambda d: packing.packed(packing.pieces(d)),
    "marked": exact_dedup.marked,
    "without_copies": exact_dedup.without_copies,
    "near": near_dedup.without_near_copies,
    "sanitised": pii.sanitised,
    "language": lambda d: language.labelled(d, language.learned(d), with_spans=True),
    "toxicity": lambda d: toxicity.scored(d, None),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_awkward_and_empty_tables(spark, name):
    assert OPERATORS[name](empty(spark)).count() == 0
    assert OPERATORS[name](awkward(spark)).count() > 0


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = corpus_pipeline.documents(spark, sf_dir)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "personal_data", "packing"]
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()


def test_drawn_samples_are_the_smallest_hashes(spark):
    from docweft.llm.common import drawn
    from docweft.operators.numbering import top_per_key

    kind = F.when(F.col("id") % 400 == 0, None).when(F.col("id") % 400 < 100, "b").otherwise("a")
    rows = spark.range(20_000).select((F.col("id") % 16_000).alias("id"), kind.alias("kind"))
    order = [F.pmod(F.xxhash64("id"), F.lit(1 << 40)), F.col("id")]
    want = {(r.kind, r.id) for r in top_per_key(rows.distinct(), ["kind"], order, 300).collect()}
    got = list(map(tuple, drawn(rows, "kind", "id", 300).collect()))
    assert len(got) == len(set(got)) and set(got) == want
    assert drawn(rows.where("id < 0"), "kind", "id", 300).count() == 0


def test_keys_of_lone_texts_are_not_shuffled(spark, monkeypatch):
    """The bit table leaves members of crowded buckets and few others; copies and classes stay right."""
    lone = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(200)]
    near = [" ".join([f"same{j}" for j in range(60)] + [f"end{i}"]) for i in range(4)]
    docs = spark.createDataFrame(list(enumerate([*lone, *near, lone[0], near[0]])), "doc_id bigint, text string")
    seen, real = {}, near_dedup.among

    def among(rows, ids, column):
        out = real(rows, ids, column)
        seen.setdefault(column, []).append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(near_dedup, "among", among)
    rows = {r.doc_id: r for r in near_dedup.classes(docs).collect()}
    keys, left = seen["key"][0]
    assert keys == 206 * near_dedup.BANDS and left < keys / 10
    assert all(r.class_id == d and r.kept for d, r in rows.items() if 0 < d < 200)
    assert {rows[d].class_id for d in (200, 201, 202, 203, 205)} == {200} and rows[204].class_id == 0
    assert rows[0].class_size == 2 and rows[200].class_size == 5 and sum(r.kept for r in rows.values()) == 201


def test_bit_tables_grow_with_their_ids(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BITS", 1 << 10)
    ids, rows = spark.range(0, 20_000, 2).toDF("id"), spark.range(40_000).toDF("id")
    found = {r.id for r in near_dedup.among(rows, ids, "id").collect()}
    assert found >= set(range(0, 20_000, 2)) and len(found) < 15_000


def test_only_texts_that_sketches_leave_meet_in_open_buckets(spark, monkeypatch):
    """Texts that share a bucket but far too few registers go before any text is sent; a similar pair stays."""
    seen, real = [], near_dedup.screened

    def screened(meetings, nodes, least):
        out = real(meetings, nodes, least)
        seen.extend([meetings.count(), sorted(r.node for r in out.collect())])
        return out

    monkeypatch.setattr(near_dedup, "screened", screened)
    alone = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(30)]
    texts = [*alone, alone[3] + " end", alone[5] + " end"]
    signed = near_dedup.signatures([near_dedup.shingle_hashes(t.split()) for t in texts])
    bands, sketch = near_dedup.band_keys(signed), (near_dedup._mixed(signed, 3) & np.uint64(255)).astype(np.uint8)
    bands[:, 0] = 7
    kept = [(i, t, bands[i].tolist(), bytearray(sketch[i].tobytes())) for i, t in enumerate(texts)]
    rows = spark.createDataFrame(kept, "node bigint, text string, bands array<bigint>, sketch binary")
    members = rows.select(F.lit(7).cast("bigint").alias("key"), "node", F.col("node").alias("label"))
    links = {frozenset((r.a, r.b)) for r in near_dedup.settled(members, rows).collect()}
    assert links == {frozenset((3, 30)), frozenset((5, 31))} and seen == [32, [3, 5, 30, 31]]


def test_near_copies_take_few_jobs(spark):
    """Every job costs the driver memory: with open buckets the jobs stay few, and classes right."""
    draw = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base + [f"end{i}"]) for i in range(40)] + [" ".join(draw.choices(base, k=50)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spark.sparkContext.setJobGroup("few_jobs", "near copies")
    try:
        found = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few_jobs"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {found[i] for i in range(40)} == {0} and all(found[i] == i for i in range(40, 80))
    assert jobs <= 100


def test_texts_of_often_paired_nodes_meet_all_their_pairs(spark):
    """A node in more pairs than ``OFTEN``, on either side, gets all of its pairs compared, each once."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words)] + [" ".join([*words, f"end{i}"]) if i % 3 else " ".join(f"x{i}y{j}" for j in range(60)) for i in range(1, 90)]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    ends = [(0, i) for i in range(1, 90)] + [(i, 89) for i in range(1, 60)] + [(3, 4), (4, 5)]
    pairs = near_dedup.staged(near_dedup._often(spark.createDataFrame(ends, "a bigint, b bigint")), "pairs")
    got = sorted((r.a, r.b) for r in near_dedup.verified(pairs, nodes).collect())
    assert got == sorted((a, b) for a, b in ends if _similarity(texts[a], texts[b]) >= 0.8)
