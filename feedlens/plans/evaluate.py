"""Evaluation jobs: normalise result tables, positional zips as keyed joins, system comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SOURCES = ("og", "icl", "ft", "retrieved")


def normalise(df: DataFrame, src: str, *, original: DataFrame | None = None, key: str = "row_id") -> DataFrame:
    """Put the feedback to evaluate in ``feedback`` whatever produced the table.

    og: as is; icl: ``generated_feedback``; ft: ``prediction``, whole (the generation
    prompt kept as ``gen_prompt``); retrieved: the original rows with ``pred`` joined by key.
    """
    if src == "og":
        return df.withColumn("gen_prompt", F.lit(None).cast("string"))
    if src == "icl":
        return df.withColumn("feedback", F.col("generated_feedback")).withColumn("gen_prompt", F.lit(None).cast("string"))
    if src == "ft":
        return df.withColumn("feedback", F.col("prediction")).withColumn("gen_prompt", F.col("prompt"))
    if src == "retrieved":
        if original is None:
            raise ValueError("retrieved results need the original rows")
        res = df.select(F.col(key).alias("_k"), F.col("pred").alias("_pred"), F.col("prompt").alias("gen_prompt"))
        return zip_join(original, res, key, "_k").withColumn("feedback", F.col("_pred")).drop("_pred", "_k")
    raise ValueError(f"unknown source {src}")


def zip_join(left: DataFrame, right: DataFrame, left_key: str = "row_id", right_key: str | None = None) -> DataFrame:
    """Row-aligned combination of two tables of equal length, as a keyed join.

    A row present on one side only is an error (raised inside the job, not on the driver).
    """
    right_key = right_key or left_key
    j = left.join(right, F.col(left_key) == F.col(right_key), "full_outer")
    bad = F.col(left_key).isNull() | F.col(right_key).isNull()
    return j.filter(F.when(bad, F.raise_error(F.lit("zip_join: tables differ in length"))).otherwise(F.lit(True)))


def system_scores(scored: DataFrame, item=("qid", "distractor"), system: str = "system", score: str = "score",
                  systems=()) -> DataFrame:
    """One row per item, one score column per system (a conditional-aggregate pivot)."""
    return scored.groupBy(*item).agg(*[F.max(F.when(F.col(system) == s, F.col(score))).alias(s) for s in systems])


def desirable(wide: DataFrame, best: str = "dpo", worse=("zs", "sft"), not_better=("dpo_abl",)) -> DataFrame:
    """Items where ``best`` beats every system in ``worse`` and is not beaten by ``not_better``."""
    cond = F.lit(True)
    for w in worse:
        cond = cond & (F.col(w) < F.col(best))
    for w in not_better:
        cond = cond & (F.col(w) <= F.col(best))
    return wide.filter(cond)
