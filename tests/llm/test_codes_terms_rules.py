"""Vector codes, source divergence and quality rules against brute force, and on awkward input."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweft.llm import divergence, quality, vector_codes

# ---- vector codes -----------------------------------------------------------


def plain_codes(rows, rounds=vector_codes.ROUNDS):
    """``(vec_id, code, error)`` and the codebooks, one comparison after the other."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v in kept), default=0) // 4)
    kept = sorted((i, v + [0] * (4 * width - len(v))) for i, v in kept)
    parts = [[v[p * width : (p + 1) * width] for _, v in kept] for p in range(4)]
    books = [[list(e) for e in part[:256]] for part in parts]

    def far(x, e):
        return sum((a - b) ** 2 for a, b in zip(x, e, strict=True))

    def nearest(p, x):
        return min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))

    for _ in range(rounds):
        for p in range(4):
            owners = [nearest(p, x) for x in parts[p]]
            for e in set(owners):
                mine = [x for x, o in zip(parts[p], owners, strict=True) if o == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for at, (i, _) in enumerate(kept):
        codes = [nearest(p, parts[p][at]) for p in range(4)]
        out.append((i, bytes(codes).hex(), sum(far(parts[p][at], books[p][codes[p]]) for p in range(4))))
    return out, books


def vectors(spark, rows, partitions=3):
    data = [(i, v, None, "x", "y", 1) for i, v in rows]
    return spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int, code string, error string, n int").repartition(partitions)


def test_codes_equal_plain_rounds(spark):
    draw = random.Random(3)
    rows = [(i, [draw.choice([-1, 0, 1]) / 8 + draw.randint(-3, 3) / 1024 for _ in range(8)]) for i in range(700)]
    rows += [(700 + i, rows[i % 5][1]) for i in range(100)]
    expected, books = plain_codes(rows)
    found, made = vector_codes.compressed(vectors(spark, rows))
    assert sorted((r.vec_id, r.code, r.error) for r in found.collect()) == expected
    assert made.tolist() == books


def test_codes_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [nan, 0.0]), (4, [0.0, -inf]), (5, []), (6, [0.5]), (7, [0.1] * 5), (7, [0.1] * 5), (8, [-0.3] * 8)]
    expected, books = plain_codes(rows)
    out = vector_codes.audited(vectors(spark, rows)).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in out) == expected
    assert {r.label_error for r in out} == {sum(e for _, _, e in expected)}
    assert {r.codebooks_sha256 for r in out} == {vector_codes.books_digest(np.array(books))}
    assert vector_codes.audited(vectors(spark, [(None, [1.0, 2.0, 3.0, 4.0])])).first().code == "00000000"
    for few in ([], [(1, None)], [(1, [])]):
        assert vector_codes.audited(vectors(spark, few)).count() == sum(v is not None for _, v in few)


def test_huge_components_are_held(spark):
    rows = [(i, [(-1) ** i * 10.0**i, 1.0, 2.0, 3.0]) for i in range(9)] + [(9, [3e38] * 4), (10, [-3e38] * 4)]
    found, _ = vector_codes.compressed(vectors(spark, rows))
    got = {r.vec_id: r for r in found.collect()}
    assert len(got) == 11 and all(r.error >= 0 for r in got.values())
    # The first components of the ninth and the tenth vector are held at the same integer.
    assert got[9].code == "08090909" and got[9].error == 0


@pytest.mark.parametrize("spread", [0, 2, 400])
def test_tree_gives_the_nearest_and_sums(spread):
    draw = np.random.default_rng(spread)
    centres = draw.integers(-4000, 4000, (12, 6))
    points = centres[draw.integers(0, 12, 900)] + draw.integers(-spread, spread + 1, (900, 6))
    tree = vector_codes.cover_tree(points)
    inside = points[tree.order]
    for at in range(len(tree.centre)):
        mine = inside[tree.low[at] : tree.high[at]]
        assert np.sqrt(((mine - inside[tree.centre[at]]) ** 2).sum(axis=1)).max() <= tree.radius[at]
    found = vector_codes.assigned(tree, inside, centres)
    apart = ((inside[:, None] - centres) ** 2).sum(axis=2)
    assert (found.code == apart.argmin(axis=1)).all()
    sums, counts = vector_codes.sums_of(found, inside, len(centres))
    for e in range(12):
        assert counts[e] == (found.code == e).sum() and (sums[e] == inside[found.code == e].sum(axis=0)).all()
    if spread < 400:
        # Tight clusters go as whole subtrees.
        assert len(found.single) == 0 and len(found.whole) <= 24


def test_ties_go_to_the_lower_entry():
    points = np.array([[0, 0], [2, 0], [1, 0], [1, 0]])
    tree = vector_codes.cover_tree(points, leaf=1)
    found = vector_codes.assigned(tree, points[tree.order], np.array([[2, 0], [0, 0], [2, 0]]))
    assert dict(zip(tree.order.tolist(), found.code.tolist(), strict=True)) == {0: 1, 1: 0, 2: 0, 3: 0}


# ---- source divergence ------------------------------------------------------


def plain_audit(docs, least, top):
    uses, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        lang, source, text = lang or "", source or "", text or ""
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        groups[lang].add(source)
        uses[lang, source].update(words)
        seen[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        every = Counter()
        for s in sources:
            every.update(uses[lang, s])

        def shares(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, p = shares(every), {s: shares(uses[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            for rank, (value, o) in enumerate(sorted(pairs, key=lambda x: (-x[0], x[1].encode())), 1):
                out.add((lang, s, "pair", o, value, rank))
            terms = [(p[s][t] - q[t], t) for t in kept if uses[lang, s][t] and p[s][t] > q[t]]
            for rank, (value, t) in enumerate(sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:top], 1):
                out.add((lang, s, "term", t, value, rank))
    return out


def audit_rows(spark, docs, least, top):
    schema = "lang string, source string, text string, term string, n bigint, slice int, block string, value string, item string"
    df = spark.createDataFrame([(*d, "t", 1, 2, "b", "v", "i") for d in docs], schema)
    return {tuple(r) for r in divergence.audit(df, least, top).collect()}


def some_documents(n, seed):
    draw = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "délta", "Élan", "日本", "ß", "x_y", "don't", "ΑΒΓ", "𝔸b", "é"]
    made = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 12))) for _ in range(n // 3)]
    langs, sources = ["en", "de", None, ""], ["a", "b", "c", "d", "é", "z", None, ""]
    docs = [(draw.choice(langs), draw.choice(sources), draw.choice([*made, None, "", "12 34"])) for _ in range(n)]
    return docs + [("en", "hot", "one Hot text")] * (n // 2) + [("fr", "only", "1 2 3"), ("fr", "other", None)]


@pytest.mark.parametrize(("least", "top"), [(1, 3), (4, 50), (10**6, 50)])
def test_divergence_equals_plain_sums(spark, least, top):
    docs = some_documents(240, least)
    assert audit_rows(spark, docs, least, top) == plain_audit(docs, least, top)


def test_divergence_in_small_blocks(spark, monkeypatch):
    for name, value in {"SOURCE_BLOCK": 2, "TERM_BLOCK": 3, "SOURCES_PER_ROW": 2}.items():
        monkeypatch.setattr(divergence, name, value)
    docs = some_documents(200, 9)
    assert audit_rows(spark, docs, 2, 4) == plain_audit(docs, 2, 4)


def test_divergence_of_nothing(spark):
    assert audit_rows(spark, [], 1, 5) == set()
    assert audit_rows(spark, [(None, None, None)], 1, 5) == set()


def test_shares_are_exact_far_beyond_long_products(spark):
    cases = [(0, 5), (3 * 10**15, 8 * 10**15), (8 * 10**15 - 6, 8 * 10**15), (7, 12), (10**10, 3 * 10**10 + 1)]
    df = spark.createDataFrame(cases, "n bigint, total bigint").select("n", "total", divergence.share("n", "total").alias("p"))
    assert all(r.p == 1 + 10**9 * (r.n + 5) // r.total for r in df.collect())


def test_each_text_is_cut_once(spark):
    docs = [("en", s, "same text") for s in "abcabc"] + [("de", "a", "same text")]
    df = spark.createDataFrame(docs, "lang string, source string, text string")
    texts, groups = divergence._grouped(df)
    got = sorted((r.lang, sorted((s.source, s.n) for s in r.sources)) for r in texts.collect())
    assert got == [("de", [("a", 1)]), ("en", [("a", 2), ("b", 2), ("c", 2)])]
    assert groups.count() == 4


# ---- quality rules ----------------------------------------------------------


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = [x for at, x in enumerate(lines) if x in lines[:at]]

    def marked(n, counts):
        runs = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        times, seen, at = Counter(runs), set(), set()
        for i, run in enumerate(runs):
            if times[run] > 1 if counts else run in seen:
                at.update(range(i, i + n))
            seen.add(run)
        return at

    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text))}
    out |= {"n_dup_lines": len(again), "n_repeat_words": len(marked(3, True)), "n_lines": len(lines)}
    out |= {"dup_line_chars": sum(len(w) for x in again for w in re.findall(r"[^\x20\x09-\x0D]+", x))}
    return out | {f"dup_chars_{n}": sum(len(words[i]) for i in marked(n, False)) for n in quality.WINDOWS}


def texts_to_judge():
    draw = random.Random(5)
    made = [None, "", " \n\t", "é" * 400, "a b\x85c\xa0d\x1ce", "x " * 20_000, "#*$%&|<> a", "line one\nline one\n\n \nline one", "\n\n\n"]
    for size in (8, 60, 300):
        vocabulary = [f"w{i}" if i % 3 else "é" * (i % 7 + 1) for i in range(size // 3)]
        made += [draw.choice(["\n", " ", "  "]).join(draw.choice(vocabulary) for _ in range(size)) for _ in range(30)]
    plain = [f"word{i}" for i in range(200)]
    made += [" ".join(plain), " ".join(plain + plain[:40]), "\n".join([" ".join(plain[i : i + 10]) for i in range(0, 200, 10)] + [" ".join(plain[:10])])]
    return made


def judged_rows(spark, texts):
    schema = "doc_id bigint, text string, n_words string, kept string, digest string"
    ids = [None, *[i // 2 for i in range(len(texts) - 1)]][: len(texts)]
    return quality.judged(spark.createDataFrame([(i, t, "a", "b", "c") for i, t in zip(ids, texts, strict=True)], schema).coalesce(1)).collect()


def test_measures_equal_plain_counts(spark):
    texts = texts_to_judge()
    rows = judged_rows(spark, texts)
    assert len(rows) == len(texts)
    for row, text in zip(rows, texts, strict=True):
        expected = plain_measures(text)
        assert {name: row[name] for name in expected} == expected
        n = expected["n_words"]
        assert row.base_failed == (n < 50 or 2 * expected["n_repeat_words"] > n)


def test_verdicts(spark):
    plain = [f"word{i:03d}" for i in range(200)]
    lines = [" ".join(plain[i : i + 4]) for i in range(0, 200, 4)]
    cases = {
        " ".join(plain): True,
        " ".join(plain + plain[:20]): True,  # a tenth repeated
        " ".join(plain + plain[:60]): False,  # windows of five words and more, under half of the words
        "\n".join(lines + lines[:5]): True,
        "\n".join([x for x in lines for _ in range(2)][:60]): False,  # repeated lines too short for a window
        " ".join(plain[:40]): False,
    }
    assert [r.kept for r in judged_rows(spark, list(cases))] == list(cases.values())


def test_windows_do_not_cross_texts(spark):
    half = " ".join(f"w{i}" for i in range(30))
    assert all(r.n_repeat_words == 0 and r.dup_chars_5 == 0 for r in judged_rows(spark, [half, half, half + " " + half[::-1]]))


def test_rules_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert quality.judged(empty).count() == 0
    assert quality.judged(empty).columns[:6] == [c.split()[0] for c in quality.BASE_COLUMNS.split(", ")]
