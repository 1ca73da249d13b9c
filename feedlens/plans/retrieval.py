"""Retrieval-policy data tables: data/corpus partition by requested sizes, sample fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.functions.text import py_str
from feedlens.operators import index as ix


def corpus_partition(expanded: DataFrame, *, train_size: int = 0, corpus_size: int = 0, val_size: int = 0,
                     val_corpus_size: int = 0, eval_split: str = "val", seed=221) -> DataFrame:
    """``(mode, row_id, role)`` rows for training and evaluation.

    Training: shuffled train rows; the first ``train_size`` are data, the next ``corpus_size``
    the corpus (0 means "the rest"; both 0: everything is data, no corpus).
    Evaluation: the first ``val_size`` rows of ``eval_split`` (0 = all) are data and the train
    split is the corpus, optionally an exact seeded sample of ``val_corpus_size`` rows.
    """
    train = expanded.filter(F.col("split") == "train").select("row_id")
    if not train_size and not corpus_size:
        tr = train.select(F.lit("train").alias("mode"), "row_id", F.lit("data").alias("role"))
    else:
        o = ix.seeded_order(train, ["row_id"], seed=seed, salt="corpus", total_col="n")
        ts = F.lit(train_size) if train_size else F.col("n") - F.lit(corpus_size)
        cs = F.lit(corpus_size) if corpus_size else F.col("n") - ts
        role = F.when(F.col("idx") < ts, F.lit("data")).when(F.col("idx") < ts + cs, F.lit("corpus"))
        tr = o.select(F.lit("train").alias("mode"), "row_id", role.alias("role")).filter(F.col("role").isNotNull())
    ev = expanded.filter(F.col("split") == eval_split).select("row_id")
    if val_size:
        ev = ev.orderBy("row_id").limit(val_size)  # the evaluation prefix is the feature
    corpus = train if not val_corpus_size else ix.sample_exact(train, val_corpus_size, ["row_id"], seed=seed)
    dev = ev.select(F.lit("dev").alias("mode"), "row_id", F.lit("data").alias("role")).unionByName(
        corpus.select(F.lit("dev").alias("mode"), "row_id", F.lit("corpus").alias("role")))
    return tr.unionByName(dev)


def retrieval_sample(df: DataFrame) -> DataFrame:
    """Language-model and encoder context/label fields of one sample (plus the record itself)."""
    body = F.concat(F.lit("Problem: "), py_str("question"), F.lit("\nCorrect Answer: "), py_str("correct_answer"),
                    F.lit("\nSolution: "), py_str("explanation"), F.lit("\nIncorrect Answer: "), py_str("distractor"))
    return df.select(
        "row_id",
        F.concat(body, F.lit("\nFeedback:")).alias("lm_context"),
        F.concat(F.lit(" "), py_str("feedback")).alias("lm_label"),
        body.alias("encoder_context"),
        F.concat(F.lit("\nFeedback: "), py_str("feedback")).alias("encoder_label"),
        F.struct(*[F.col(c) for c in df.columns]).alias("meta_data"),
    )
