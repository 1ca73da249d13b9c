"""Model-output metrics: ensemble averaging, probabilities, BCE loss, classifier report, ROC AUC.

Logits arrive as ``ARRAY<DOUBLE>`` per (model, row). Everything is a grouped aggregate; ROC AUC
is a Mann-Whitney sum over a score histogram whose running negative counts are computed
inside 1,024 quantile buckets per group (bucket offsets come from a small per-bucket table), so
a label with billions of distinct scores is spread over many tasks instead of one window
partition; a score finds its bucket by binary search over the bucket bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.sources.files import materialize
from feedlens.operators.agreement import pearson

N_LABELS = 5


def ensemble(logits: DataFrame, n: int = N_LABELS, keys=("row_id",), keep=("method", "truth")) -> DataFrame:
    """Mean logit per row and label over models (one aggregate with map-side partial step)."""
    return logits.groupBy(*keys).agg(
        F.array(*[F.avg(F.col("logits")[i]) for i in range(n)]).alias("logits"),
        *[F.max(c).alias(c) for c in keep])


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def probabilities(logits: Column, flip=(0, 1), n: int = N_LABELS) -> Column:
    """Sigmoid per label; labels in ``flip`` become ``1 - p`` (incorrect -> correct, reveal)."""
    return F.transform(logits, lambda x, i: F.when(i.isin(*flip), 1 - sigmoid(x)).otherwise(sigmoid(x)))


def gated(p: Column, n: int = N_LABELS) -> Column:
    """``p[0] * mean(p)``: the scalar reward."""
    return p[0] * F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x) / F.lit(float(n))


def bce_terms(x: Column, y: Column) -> Column:
    """Numerically stable binary cross-entropy with logits, per element."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def flip_for_report(df: DataFrame, literal: bool = False) -> DataFrame:
    """First label flipped on logits (``-x``; ``1 - x`` when ``literal``) and on truth (``1 - y``)."""
    fx = (lambda x: 1 - x) if literal else (lambda x: -x)
    return (df.withColumn("logits", F.transform("logits", lambda x, i: F.when(i == 0, fx(x)).otherwise(x)))
              .withColumn("truth", F.transform("truth", lambda y, i: F.when(i == 0, 1 - y).otherwise(y))))


def long_predictions(df: DataFrame, n: int = N_LABELS, group: str = "method") -> DataFrame:
    """One row per (row, label) with logit ``x``, truth ``y``, hard decision ``h``; each row is
    emitted for its own group and for ``all``."""
    items = F.transform("logits", lambda x, i: F.named_struct(F.lit("label"), i, F.lit("x"), x,
                                                             F.lit("y"), F.col("truth")[i]))
    out = df.select("row_id", F.explode(F.array(F.col(group), F.lit("all"))).alias("grp"), F.inline(items))
    return out.withColumn("h", F.when(F.col("x") >= 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def count_below(sorted_arr: Column, x: Column, max_len: int) -> Column:
    """Number of elements of a non-decreasing array (at most ``max_len`` long) strictly below ``x``,
    by binary search: ``log2(max_len)`` steps per row instead of a scan of the array."""
    steps = [1 << i for i in range(max(max_len, 1).bit_length() - 1, -1, -1)]
    n = F.size(sorted_arr)
    return F.aggregate(F.array(*[F.lit(st) for st in steps]), F.lit(0),
                       lambda acc, st: F.when((acc + st <= n) & (F.element_at(sorted_arr, acc + st) < x),
                                              acc + st).otherwise(acc))


def roc_auc(long: DataFrame, group_cols=("grp", "label"), score: str = "x", truth: str = "y",
            buckets: int = 1024) -> DataFrame:
    """ROC AUC per group; NULL unless both classes are present. Ties count one half.

    The running count of negatives below each score is a window inside ``buckets`` quantile
    buckets per group (about 1/buckets of the group's distinct scores each) plus bucket offsets.
    """
    g = list(group_cols)
    hist = long.groupBy(*g, score).agg(F.count_if(F.col(truth) == 1).alias("pos"),
                                       F.count_if(F.col(truth) == 0).alias("neg"))
    hist = materialize(hist, "roc-histogram")  # read by the bounds, the offsets and the running counts
    fracs = [i / buckets for i in range(1, buckets)]
    bounds = hist.groupBy(*g).agg(F.percentile_approx(score, fracs, 10000).alias("_b"))  # groups x buckets values
    hb = hist.join(bounds, g).withColumn("_bk", count_below(F.col("_b"), F.col(score), len(fracs))).drop("_b")
    tot = hb.groupBy(*g, "_bk").agg(F.sum("neg").alias("_bneg"))
    offs = tot.select(*g, "_bk", F.coalesce(F.sum("_bneg").over(
        Window.partitionBy(*g).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    run = Window.partitionBy(*g, "_bk").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    hb = hb.join(offs, [*g, "_bk"]).withColumn("below", F.col("_off") + F.coalesce(F.sum("neg").over(run), F.lit(0)))
    agg = hb.groupBy(*g).agg(F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg"))).alias("_u"),
                             F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return agg.select(*g, F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                                 F.col("_u") / (F.col("_p").cast("double") * F.col("_n"))).alias("auc"))


def classifier_report(df: DataFrame, labels, n: int = N_LABELS, literal: bool = False) -> DataFrame:
    """Long ``(method, metric, value)`` report: accuracy_all, auc_all, pearson_score and, per
    label, accuracy / auc / pearson of hard decisions; per method and for ``all``."""
    d = df.filter(~F.exists("truth", lambda y: y == 0.5))
    d = flip_for_report(d, literal)
    lp = long_predictions(d, n)
    per_label = lp.groupBy("grp", "label").agg(F.avg((F.col("h") == F.col("y")).cast("double")).alias("accuracy"),
                                               pearson(F.col("h"), F.col("y")).alias("pearson"))
    auc = roc_auc(lp)
    pl = per_label.join(auc, ["grp", "label"])
    name = F.element_at(F.array(*[F.lit(l) for l in labels]), F.col("label") + 1)
    per_label_long = pl.select("grp", F.inline(F.array(
        F.struct(F.concat(F.lit("accuracy_"), name).alias("metric"), F.col("accuracy").alias("value")),
        F.struct(F.concat(F.lit("auc_"), name).alias("metric"), F.col("auc").alias("value")),
        F.struct(F.concat(F.lit("pearson_"), name).alias("metric"), F.col("pearson").alias("value")))))
    overall_acc = lp.groupBy("grp").agg(F.avg((F.col("h") == F.col("y")).cast("double")).alias("value"))
    auc_all = auc.groupBy("grp").agg(F.when(F.count("auc") == n, F.avg("auc")).alias("value"))
    hard = F.transform("logits", lambda x: F.when(x >= 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    rows = d.select(F.explode(F.array(F.col("method"), F.lit("all"))).alias("grp"),
                    gated(hard, n).alias("sh"), gated(F.col("truth"), n).alias("st"))
    p_score = rows.groupBy("grp").agg(pearson(F.col("sh"), F.col("st")).alias("value"))
    out = (per_label_long
           .unionByName(overall_acc.select("grp", F.lit("accuracy_all").alias("metric"), "value"))
           .unionByName(auc_all.select("grp", F.lit("auc_all").alias("metric"), "value"))
           .unionByName(p_score.select("grp", F.lit("pearson_score").alias("metric"), "value")))
    return out.withColumnRenamed("grp", "method")
