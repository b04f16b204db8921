"""Versioned prompts, candidates and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions.text import words
from docweft.operators.numbering import numbered, with_neighbours
from docweft.operators.sizes import fits

MAX_CANDIDATES = 256
MAX_CANDIDATE_BYTES = 8 * 1024 * 1024
CANDIDATE_BLOCK = 64


def versions(rows: DataFrame, name: str, order: str, template: str) -> DataFrame:
    """``(name, version, template, seq)`` numbered per name by a unique integer order."""
    named = rows.select(F.col(name).alias("name"), F.col(order).alias("seq"), F.col(template).alias("template"))
    return numbered(named, ["name"], "seq", "version")


def latest(registry: DataFrame) -> DataFrame:
    """Highest version per name: ``(name, version, template)``."""
    return registry.groupBy("name").agg(
        F.max("version").alias("version"), F.max_by("template", "version").alias("template")
    )


def resolved(names: DataFrame, registry: DataFrame, default: str) -> DataFrame:
    """Prompt in force per name: a given candidate, else the latest version, else the default.

    ``names`` has ``name, candidate``. A name without versions counts as version 1.
    """
    joined = names.join(latest(registry), "name", "left")
    return joined.select(
        "name",
        F.coalesce("version", F.lit(1)).cast("bigint").alias("version"),
        F.coalesce("candidate", "template", F.lit(default)).alias("template"),
    )


def changes(registry: DataFrame) -> DataFrame:
    """Whether each version differs from the one before it (the first one does)."""
    before = with_neighbours(registry, ["name"], "version", ["template"], ["before"])
    return before.select(
        "name", "version", (~F.col("template").eqNullSafe(F.col("before.template"))).alias("changed")
    )


def with_new_version(registry: DataFrame, name: Column, template: DataFrame) -> DataFrame:
    """Append a template (one-row frame, column ``template``) under a name as its next version."""
    top = registry.where(F.col("name") == name).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
    new = template.select(name.alias("name"), top.scalar().cast("bigint").alias("version"), "template")
    return registry.select("name", "version", "template").unionByName(new)


def candidate_matrix(examples: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each example under each candidate prompt.

    ``candidates`` has ``name, template``. While they are few (checked) they
    travel inside the plan, one array per task; otherwise they are cut into
    blocks and joined on the block number.
    """
    if fits(candidates.select("name", "template"), MAX_CANDIDATES, MAX_CANDIDATE_BYTES) is not None:
        rows = candidates.select("name", "template").orderBy("name").collect()
        sent = F.array(
            *[F.struct(F.lit(r.name).alias("name"), F.lit(r.template).alias("template")) for r in rows]
        )
        if not rows:
            return examples.withColumns({"name": F.lit(""), "template": F.lit("")}).where(F.lit(False))
        return examples.select("*", F.explode(sent).alias("_c")).select(*examples.columns, "_c.name", "_c.template")
    n = candidates.count()
    blocks = -(-n // CANDIDATE_BLOCK)
    cut = candidates.select("name", "template", F.pmod(F.xxhash64("name"), F.lit(blocks)).alias("_block"))
    spread = examples.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    salt = F.pmod(F.xxhash64(*examples.columns), F.lit(32))
    salted = cut.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(31).cast("bigint"))))
    return spread.withColumn("_salt", salt).join(salted, ["_block", "_salt"]).drop("_block", "_salt")


def shared_words(left: Column, right: Column) -> Column:
    """How many different words two texts share: the stand-in for a judged score."""
    return F.size(F.array_intersect(words(left), words(right))).cast("bigint")


def mean_scores(scored: DataFrame) -> DataFrame:
    """``(name, n, mean_score)`` per candidate, from exact integer sums."""
    return scored.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("score") / F.count(F.lit(1)), 6).alias("mean_score")
    )


def best(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.col("mean_score").desc(), "name").limit(1)


def within_budget(matrix: DataFrame, order: list[str], budget: int) -> DataFrame:
    """The first ``budget`` evaluations of a fixed order."""
    return matrix.orderBy(*order).limit(budget)
