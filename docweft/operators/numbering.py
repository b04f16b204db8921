"""Numbering and neighbours inside ordered groups of any size.

A plain window over a group puts the whole group into one task. Here each group
is first split into blocks of its order key. Windows run inside (group, block),
one small row per block carries the totals across, and a join on (group, block)
brings both together. With a unique integer order key a block holds at most
``BLOCK`` rows, whatever the size of its group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.operators.sizes import fits

BLOCK = 65536


def _blocked(df: DataFrame, keys: Sequence[str], order: str, width: int) -> DataFrame:
    """Add ``_group`` and ``_part``, a group's block. Structs, as those join on nulls too."""
    block = F.expr(f"`{order}` div {width}").alias("block")
    return df.withColumns({"_group": F.struct(*keys), "_part": F.struct(F.struct(*keys).alias("group"), block)})


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    number: str = "rn",
    total: str | None = None,
    width: int = BLOCK,
) -> DataFrame:
    """Add the 1-based position of each row in its group, and the group size if named."""
    rows = _blocked(df, keys, order, width)
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("_part.group")
    parts = parts.select(
        "_part",
        (F.sum("_n").over(group.orderBy("_part.block")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(group).alias("_size"),
    )
    out = local.join(parts, "_part").withColumn(number, F.col("_local") + F.col("_before"))
    if total:
        out = out.withColumn(total, F.col("_size"))
    return out.drop("_group", "_part", "_local", "_before", "_size")


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Sequence[str],
    names: Sequence[str],
    after: bool = False,
    width: int = BLOCK,
) -> DataFrame:
    """Add structs of ``columns`` from the rows before (or after) each row of a group.

    ``names[0]`` is the nearest row, ``names[1]`` the one beyond it, and so on;
    a struct is null where the group has no such row. Rows beyond a block's edge
    come from the edge rows of as many neighbouring blocks as there are names: a
    block that occurs is never empty.
    """
    reach = len(names)
    payload = F.struct(*columns)
    rows = _blocked(df, keys, order, width)
    inner = Window.partitionBy("_part").orderBy(F.col(order).desc() if after else F.col(order).asc())
    local = rows.withColumns(
        {"_at": F.row_number().over(inner)}
        | {f"_in{i}": F.lag(payload, i).over(inner) for i in range(1, reach + 1)}
    )
    spare = ["_group", "_part", "_at", "_beyond", *[f"_in{i}" for i in range(1, reach + 1)]]
    # Only groups that span blocks have edges; a look at the keys alone finds them.
    wide = rows.groupBy("_group").agg(F.min("_part.block").alias("_lo"), F.max("_part.block").alias("_hi"))
    wide = wide.where("_lo < _hi").select("_group")
    n_wide = fits(wide)
    if n_wide == 0:
        return local.withColumns({name: F.col(f"_in{i}") for i, name in enumerate(names, start=1)}).drop(*spare)
    source = rows.select("_group", "_part", F.col(order).alias("_order"), payload.alias("_value"))
    source = source.join(wide if n_wide is None else F.broadcast(wide), "_group", "left_semi")
    # Edge rows of each block, the nearest to the next block last.
    back = F.col("_order").asc() if after else F.col("_order").desc()
    edge_rows = top_per_key(source, ["_part"], [back], reach, "_e")
    last_first = F.sort_array(F.collect_list(F.struct((-F.col("_e")).alias("e"), F.col("_value").alias("v"))))
    edges = edge_rows.groupBy("_part").agg(F.transform(last_first, lambda r: r["v"]).alias("_edge"))
    block = F.col("_part.block")
    across = Window.partitionBy("_part.group").orderBy(block.desc() if after else block.asc())
    none = F.slice("_edge", 1, 0)
    beyond = F.concat(*[F.coalesce(F.lag("_edge", i).over(across), none) for i in range(reach, 0, -1)])
    edges = edges.select("_part", beyond.alias("_beyond"))
    filled = {
        name: F.when(F.col("_at") > i, F.col(f"_in{i}")).otherwise(
            F.try_element_at("_beyond", (F.col("_at") - (i + 1)).cast("int"))
        )
        for i, name in enumerate(names, start=1)
    }
    return local.join(edges, "_part", "left").withColumns(filled).drop(*spare)


def newest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row per key in the given order.

    Spark limits each group before the shuffle, so a key that holds most rows
    sends one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rk", F.row_number().over(window)).where("_rk = 1").drop("_rk")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rk") -> DataFrame:
    """First ``k`` rows per key, with their rank; limited per task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    # The cast comes after the filter, which Spark must see on the bare rank to limit early.
    kept = df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
    return kept.withColumn(rank, F.col(rank).cast("bigint"))
