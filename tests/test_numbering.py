import pandas as pd
import pytest

from docweft.operators.numbering import newest, numbered, top_per_key, with_neighbours


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds half of all rows; order keys have gaps."""
    rows = [("hot", i * 3, f"h{i}") for i in range(500)]
    rows += [(f"g{g}", i * 7 + g, f"{g}-{i}") for g in range(50) for i in range(10)]
    return spark.createDataFrame(rows, "k string, o bigint, v string").repartition(7), pd.DataFrame(rows, columns=["k", "o", "v"])


@pytest.mark.parametrize("width", [1, 4, 100, 65536])
def test_numbered(skewed, width):
    df, local = skewed
    got = numbered(df, ["k"], "o", "n", "size", width).toPandas().sort_values(["k", "o"]).reset_index(drop=True)
    local = local.sort_values(["k", "o"]).reset_index(drop=True)
    groups = local.groupby("k")
    assert got["n"].tolist() == (groups.cumcount() + 1).tolist()
    assert got["size"].tolist() == groups["o"].transform("size").tolist()


@pytest.mark.parametrize("width", [1, 4, 100, 65536])
@pytest.mark.parametrize("after", [False, True])
def test_neighbours(skewed, width, after):
    df, local = skewed
    got = with_neighbours(df, ["k"], "o", ["v"], ["a", "b"], after, width).select("k", "o", "a.v", "b.v")
    got = got.toDF("k", "o", "a", "b").toPandas().sort_values(["k", "o"]).reset_index(drop=True)
    local = local.sort_values(["k", "o"]).reset_index(drop=True)
    sign = -1 if after else 1
    for name, step in (("a", 1), ("b", 2)):
        want = local.groupby("k")["v"].shift(sign * step)
        assert [None if pd.isna(x) else x for x in got[name]] == [None if pd.isna(x) else x for x in want]


def test_negative_order_keys(spark):
    df = spark.createDataFrame([("a", i) for i in range(-9, 9)], "k string, o bigint")
    got = sorted((r.o, r.n) for r in numbered(df, ["k"], "o", "n", width=4).collect())
    assert got == [(o, n + 1) for n, o in enumerate(range(-9, 9))]


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, i) for i in range(9)] + [("a", i) for i in range(3)], "k string, o bigint")
    for width in (2, 100):
        got = numbered(df, ["k"], "o", "n", "size", width).collect()
        assert sorted((str(r.k), r.o, r.n, r["size"]) for r in got) == sorted(
            [("None", i, i + 1, 9) for i in range(9)] + [("a", i, i + 1, 3) for i in range(3)]
        )
        before = with_neighbours(df, ["k"], "o", ["o"], ["p"], width=width).collect()
        assert all(r.p is None if r.o == 0 else r.p.o == r.o - 1 for r in before) and len(before) == 12


def test_newest_and_top(skewed):
    df, local = skewed
    last = {r.k: r.o for r in newest(df, ["k"], df.o.desc()).collect()}
    assert last == local.groupby("k")["o"].max().to_dict()
    top = top_per_key(df, ["k"], [df.o], 3).toPandas()
    assert top.groupby("k").size().eq(3).all() and sorted(top["rk"].unique()) == [1, 2, 3]
