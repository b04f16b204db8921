"""Citation edges found in texts, and what is reached from a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions.text import citations, same_paper
from docweft.operators.numbering import newest
from docweft.operators.sizes import sent
from docweft.session import staged

MAX_FRONTIER = 1_000_000


def found_citations(texts: DataFrame, src: str, text: str) -> DataFrame:
    """Every match as a row ``(src, dst)``; repeated matches stay."""
    return texts.select(F.col(src).alias("src"), F.explode(citations(F.col(text))).alias("dst"))


def bare_id(paper: Column) -> Column:
    """Id without its version suffix."""
    return F.regexp_replace(paper, "v[0-9]+$", "")


def citation_edges(texts: DataFrame, src: str, text: str) -> DataFrame:
    """Distinct edges between papers, without versions and without self-citations."""
    found = found_citations(texts, src, text).where(~same_paper(F.col("src"), F.col("dst")))
    return found.select("src", bare_id(F.col("dst")).alias("dst")).distinct()


def two_hops(edges: DataFrame, seeds: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Papers cited by the seeds (hop 1) and by those (hop 2): ``(paper, hop)``.

    Papers of the second hop are listed, not followed. ``seeds`` and ``stored``
    have one column ``paper``; stored papers are left out. Both joins are on
    the citing paper against distinct frontier rows, so they never multiply
    edges, and the frontier is sent to the edges while it is small: a paper with
    very many references is then read where it lies.
    """
    first = staged(seeds.select(F.col("paper").alias("src")).distinct(), "seeds")
    hop1 = edges.join(sent(first, MAX_FRONTIER), "src", "left_semi")
    hop1 = staged(hop1.select(F.col("dst").alias("paper")).distinct(), "hop")
    hop2 = edges.join(sent(hop1.select(F.col("paper").alias("src")), MAX_FRONTIER), "src", "left_semi")
    hop2 = hop2.select(F.col("dst").alias("paper")).distinct()
    reached = hop1.withColumn("hop", F.lit(1).cast("bigint")).unionByName(
        hop2.withColumn("hop", F.lit(2).cast("bigint"))
    )
    reached = newest(reached, ["paper"], F.col("hop"))
    return reached.join(stored.select("paper"), "paper", "left_anti") if stored is not None else reached
