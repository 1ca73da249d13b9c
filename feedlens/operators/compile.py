"""Compile generated feedback of several methods: union (single) and head-to-head matchups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.functions.hashing import seeded_hash
from feedlens.operators import index as ix
from feedlens.rubric import METHODS, SEED

ITEM = ("src_row_id", "qid", "question", "correct_answer", "explanation", "distractor")


def compile_single(generated: dict[str, DataFrame], gold_from: str | None = None, extra=()) -> DataFrame:
    """Union of every method's generated feedback plus the original feedback as method ``gold``.

    ``generated`` maps method -> table with ``ITEM`` columns, ``feedback`` (original) and
    ``generated_feedback``. The gold rows copy the first method's table, as the source does.
    ``extra``: further columns to keep (the split, say).
    """
    names = list(generated)
    parts = [generated[m].select(*ITEM, F.col("generated_feedback").alias("feedback"), F.lit(m).alias("method"), *extra)
             for m in names]
    gold = generated[gold_from or names[0]].select(*ITEM, "feedback", F.lit("gold").alias("method"), *extra)
    out = parts[0]
    for p in parts[1:] + [gold]:
        out = out.unionByName(p)
    return out


def compile_h2h(single: DataFrame, methods=tuple(METHODS), *, seed=SEED, last_only: bool = False) -> DataFrame:
    """All matchups of the methods that an item has, presentation order flipped by a seeded coin.

    A method's repeated rows of one item are numbered in the order of their feedback's hash, and
    the n-th row of a method meets the n-th rows of the others; no item and no row is left out
    but rows of other ``methods``. Item fields come from the row of the first method present.
    One row per (item, n) holds the methods present, in order, and is unfolded into its pairs, so
    the output is linear in the input. ``last_only`` keeps only an item's last matchup,
    reproducing the source's literal output.
    """
    place = F.create_map(*[F.lit(x) for i, m in enumerate(methods) for x in (m, i)])
    rows = single.withColumn("_i", place[F.col("method")]).filter("_i IS NOT NULL").withColumn("_h", F.coalesce(F.md5("feedback"), F.lit("")))
    rows = ix.hash_positions(rows, ["src_row_id", "_i"], "_h", ["feedback"], pos_col="_nth", size_col=None)
    held = F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), "method", "feedback")))
    items = rows.groupBy("src_row_id", "_nth").agg(
        F.min_by(F.struct(*[F.col(c) for c in ITEM[1:]]), "_i").alias("_item"), held.alias("_held"))
    pairs = F.flatten(F.transform("_held", lambda a, at: F.transform(
        F.slice("_held", at + 2, F.size("_held")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    if last_only:
        pairs = F.slice(pairs, F.greatest(F.size(pairs), F.lit(1)), 1)
    m = items.select("src_row_id", "_item.*", F.explode(pairs).alias("p"))
    swap = F.substring(seeded_hash(seed, F.lit("h2h"), "src_row_id", "p.a.i", "p.b.i"), 1, 1) < F.lit("8")
    first, second = F.when(swap, F.col("p.b")).otherwise(F.col("p.a")), F.when(swap, F.col("p.a")).otherwise(F.col("p.b"))
    return m.select(*ITEM, first["feedback"].alias("feedback_1"), second["feedback"].alias("feedback_2"),
                    first["method"].alias("method_1"), second["method"].alias("method_2"))


def win_rates(h2h: DataFrame, label_col: str = "label") -> DataFrame:
    """Per method: share of all matchups it won, and its win rate over its own matchups.

    ``label`` 0 means the first feedback won, 1 the second.
    """
    sides = F.array(
        F.struct(F.col("method_1").alias("method"), (F.col(label_col) == 0).alias("win")),
        F.struct(F.col("method_2").alias("method"), (F.col(label_col) == 1).alias("win")),
    )
    per = h2h.select(F.inline(sides)).groupBy("method").agg(
        F.count_if("win").alias("wins"), F.count(F.lit(1)).alias("n_matchups"))
    total = h2h.select(F.count(F.lit(1))).scalar()  # scalar subquery: one number
    return per.select("method", "n_matchups", (F.col("wins") / total).alias("win_share_all"),
                      (F.col("wins") / F.col("n_matchups")).alias("win_rate"))
