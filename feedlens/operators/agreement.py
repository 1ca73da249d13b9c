"""Annotator agreement: pairing two annotation tables, polarity flips, and agreement metrics.

All metrics are expressions over the contingency table of a long ``(method, label, a, b)`` table
(map-side partial counts); means "per method and overall" are a ROLLUP over (label, method).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions.hashing import key_digest, seeded_hash
from feedlens.operators.index import hash_positions
from feedlens.rubric import BINARY, SEED, Rubric

PAIR_KEYS = ("qid", "distractor", "feedback")
ITEM_COLS = ("row_id", "qid", "question", "correct_answer", "explanation", "distractor", "feedback", "method")


def labelled(df: DataFrame, label: str) -> DataFrame:
    """Keep rows whose ``label`` is present."""
    return df.filter(F.col(label).isNotNull())


def flip_labels(df: DataFrame, rubric: Rubric = BINARY) -> DataFrame:
    """``1 - x`` for the rubric's flipped labels; ``incorrect`` is renamed ``correct``."""
    out = df
    for l in rubric.flip:
        new = "correct" if l == "incorrect" else l
        out = out.withColumn(new, F.lit(1.0) - F.col(l))
        if new != l:
            out = out.drop(l)
    return out


def external_labels(df: DataFrame, labels) -> DataFrame:
    """Externally supplied labels are taken as integers (truncated) instead of being flipped."""
    for l in labels:
        df = df.withColumn(l, F.col(l).try_cast("int"))
    return df


def pair_annotations(a: DataFrame, b: DataFrame, labels, *, keys=PAIR_KEYS, require: str = "reveal",
                     item_cols=ITEM_COLS, seed=SEED) -> DataFrame:
    """Rows labelled by both annotators, matched on ``keys`` (NULL-safe).

    Duplicate keys are paired one-to-one by occurrence number (order: seeded hash of
    ``row_id``); leftovers are dropped. Labels come out as ``<label>_a`` / ``<label>_b``.
    The occurrence numbering splits a hot key over many tasks (see ``hash_positions``).
    Keys are compared through ``key_digest``, so the second table is shuffled without its
    text columns and no exchange hashes or sorts whole texts.
    """
    keys = list(keys)

    def number(df):
        df = (labelled(df, require).withColumn("_kh", key_digest(keys))
              .withColumn("_h", seeded_hash(seed, F.lit("occ"), "row_id")))
        return hash_positions(df, ["_kh"], "_h", ["row_id"], pos_col="_occ", size_col=None).drop("_h")

    na = number(a.select(*item_cols, *labels))
    nb = number(b.select("row_id", *keys, *labels))
    na = na.select(*item_cols, "_kh", "_occ", *[F.col(l).alias(f"{l}_a") for l in labels])
    nb = nb.select(F.col("row_id").alias("row_id_b"), F.col("_kh").alias("_b_kh"), F.col("_occ").alias("_b_occ"),
                   *[F.col(l).alias(f"{l}_b") for l in labels])
    out = na.join(nb, (F.col("_kh") == F.col("_b_kh")) & (F.col("_occ") == F.col("_b_occ")), "inner")
    return out.drop("_kh", "_occ", "_b_kh", "_b_occ")


def flip_pair(df: DataFrame, rubric: Rubric = BINARY) -> DataFrame:
    out = df
    for side in ("a", "b"):
        for l in rubric.flip:
            new = "correct" if l == "incorrect" else l
            out = out.withColumn(f"{new}_{side}", F.lit(1.0) - F.col(f"{l}_{side}"))
            if new != l:
                out = out.drop(f"{l}_{side}")
    return out


def long_labels(df: DataFrame, labels, keep=("row_id", "method")) -> DataFrame:
    """One row per (row, label) with both annotators' values ``a`` and ``b``."""
    entries = [F.struct(F.lit(l).alias("label"), F.col(f"{l}_a").cast("double").alias("a"),
                        F.col(f"{l}_b").cast("double").alias("b")) for l in labels]
    return df.select(*keep, F.inline(F.array(*entries)))


def method_rollup(df: DataFrame, groups, *aggs) -> DataFrame:
    """Aggregate per (groups, method) and per groups over all methods (method = 'all').

    One ROLLUP over ``(*groups, method)``; the grand total levels are dropped.
    """
    groups = [groups] if isinstance(groups, str) else list(groups)
    g = df.rollup(*groups, "method").agg(*aggs, F.grouping_id().alias("_gid"))
    g = g.filter(F.col("_gid") <= 1)
    return g.withColumn("method", F.when(F.col("_gid") == 1, F.lit("all")).otherwise(F.col("method"))).drop("_gid")


def pearson(x: Column, y: Column) -> Column:
    """Population Pearson correlation; NULL when either side is constant (no ANSI error)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def agreement_metrics(long: DataFrame) -> DataFrame:
    """Kappa, Pearson, accuracy and binary precision/recall/F1 (truth ``b``, prediction ``a``).

    Everything comes from the contingency table (label, method, a, b): one shuffle of partial
    counts, whatever values the labels take. Kappa's chance term sums over all of them.
    """
    cells = long.groupBy("label", "method", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    both = F.explode(F.array(F.col("method"), F.lit("all")))
    g = (cells.withColumn("method", both).groupBy("label", "method", "a", "b").agg(F.sum("n").alias("n"))
         .groupBy("label", "method").agg(F.collect_list(F.struct("a", "b", "n")).alias("cells"), F.sum("n").alias("n")))

    def total(value) -> Column:
        return F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + F.coalesce(value(c), F.lit(0.0)) * c["n"])

    n = F.col("n").cast("double")
    mean = lambda value: total(value) / n
    is_ = lambda c, a, b: ((c["a"] == a) & (c["b"] == b)).cast("double")
    chance = mean(lambda c: F.aggregate("cells", F.lit(0.0), lambda acc, d: acc + F.when(d["b"] == c["a"], d["n"]).otherwise(0)) / n)
    g = g.select("method", "label", "n", mean(lambda c: (c["a"] == c["b"]).cast("double")).alias("_po"), chance.alias("_pe"),
                 mean(lambda c: c["a"]).alias("_ma"), mean(lambda c: c["b"]).alias("_mb"), "cells",
                 total(lambda c: is_(c, 1, 1)).alias("tp"), total(lambda c: is_(c, 1, 0)).alias("fp"),
                 total(lambda c: is_(c, 0, 1)).alias("fn"))
    da, db = (lambda c: c["a"] - F.col("_ma")), (lambda c: c["b"] - F.col("_mb"))
    spread = F.sqrt(mean(lambda c: da(c) * da(c))) * F.sqrt(mean(lambda c: db(c) * db(c)))
    pearson = F.when(spread > 1e-12, mean(lambda c: da(c) * db(c)) / spread)
    precision = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    g = g.select("method", "label", "n", F.when(F.lit(1.0) - F.col("_pe") > 1e-12, (F.col("_po") - F.col("_pe")) / (F.lit(1.0) - F.col("_pe")))
                 .alias("kappa"), pearson.alias("pearson"), F.col("_po").alias("accuracy"), precision.alias("precision"), recall.alias("recall"))
    return g.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                      F.col("precision") + F.col("recall")), F.lit(0.0)))


METRICS = ("kappa", "pearson", "accuracy", "precision", "recall", "f1")


def macro_over_labels(metrics: DataFrame) -> DataFrame:
    """Unweighted mean of each metric over labels per method; NULL metrics are skipped."""
    return metrics.groupBy("method").agg(*[F.avg(m).alias(m) for m in METRICS],
                                         F.count("pearson").alias("n_labels"))


def gated_score(labels, suffix: str = "") -> Column:
    """``label0 * sum(labels) / n`` (labels already flipped)."""
    cols = [F.col(f"{l}{suffix}") for l in labels]
    return cols[0] * sum(cols[1:], cols[0]) / F.lit(float(len(cols)))


def gated_score_raw(correct: str, labels) -> Column:
    """Exploration variant: ``correct * sum(labels)``, not divided."""
    cols = [F.col(l) for l in labels]
    return F.col(correct) * sum(cols[1:], cols[0])
