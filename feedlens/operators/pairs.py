"""Negative and preference pairs for reward-model and preference training tables.

* within-question mismatch: each row takes the feedback of its 1st / 2nd cyclic neighbour in
  its question group (positions by seeded hash, group split over many tasks);
* across-question mismatch: a keyed bijection of the rows' positions, computed row by row, says
  whose feedback a row gets, so all rounds together take one numbering and one equi-join;
* score pairs: rows of one (question, distractor) item paired when their scores differ, in a
  triangular grid of blocks per item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.functions.bijection import bijection
from feedlens.functions.hashing import key_digest, seeded_hash
from feedlens.operators.hot import join_counted
from feedlens.operators.index import hash_positions, ordered_index
from feedlens.rubric import SEED
from feedlens.sources.files import materialize


def large_groups(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(*keys): the groups of more than ``most`` rows, fewer than (rows / ``most``) of them."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(*keys)


def inner_neighbours(src: DataFrame, *, group: str = "qid", key: str = "row_id", offsets=(1, 2),
                     seed=SEED, window_rows: int = 4096) -> DataFrame:
    """Rows of ``src`` plus ``alt_feedback``: the feedback at position ``(pos + offset) % n``
    in the same group, for each offset below the group size (``shift`` column).

    Groups of at most ``window_rows`` rows are shuffled once and read their neighbours in a
    window; larger ones are numbered by hash buckets and joined, so that many tasks share them.
    """
    some = src.filter(F.col(group).isNotNull())
    large = materialize(large_groups(some, [group], window_rows), "large-groups")
    small = some.join(F.broadcast(large), group, "left_anti").select(*src.columns)
    small = small.withColumn("_h", seeded_hash(seed, F.lit("inner"), key))
    order = Window.partitionBy(group).orderBy("_h", key)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    small = small.withColumn("_pos", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(every))
    for i in range(max(offsets)):  # the first rows follow the last one
        small = small.withColumn(f"_f{i}", F.nth_value("feedback", i + 1).over(every))
    told = []
    for o in offsets:
        small = small.withColumn(f"_l{o}", F.lead("feedback", o).over(order))
        wrapped = F.get(F.array(*[F.col(f"_f{i}") for i in range(max(offsets))]), (F.col("_pos") + o - F.col("_n")).cast("int"))
        told.append(F.struct(F.lit(o).alias("shift"), F.when(F.col("_pos") + o < F.col("_n"), F.col(f"_l{o}")).otherwise(wrapped).alias("alt_feedback")))
    near = small.select("*", F.inline(F.array(*told))).filter(F.col("shift") < F.col("_n")).select(*src.columns, "shift", "alt_feedback")
    return near.unionByName(_joined_neighbours(some.join(F.broadcast(large), group, "left_semi").select(*src.columns), group, key, offsets, seed))


def _joined_neighbours(src: DataFrame, group: str, key: str, offsets, seed) -> DataFrame:
    h = src.withColumn("_h", seeded_hash(seed, F.lit("inner"), key))
    pos = hash_positions(h, [group], "_h", [key], pos_col="_pos", size_col="_n").drop("_h")
    partner = pos.select(F.col(group).alias("_g"), F.col("_pos").alias("_ppos"),
                         F.col("feedback").alias("alt_feedback"))
    offs = F.explode(F.array(*[F.lit(o) for o in offsets])).alias("shift")
    rows = pos.select("*", offs).filter(F.col("shift") < F.col("_n"))
    rows = rows.withColumn("_tpos", F.pmod(F.col("_pos") + F.col("shift"), F.col("_n")))
    out = rows.join(partner, (F.col(group) == F.col("_g")) & (F.col("_tpos") == F.col("_ppos")), "inner")
    return out.select(*src.columns, "shift", "alt_feedback")


def outer_permutation(src: DataFrame, *, key: str = "row_id", rounds: int = 1, seed=SEED,
                      exclude_equal: bool = False, numbers=None) -> DataFrame:
    """Rows of ``src`` plus ``alt_feedback`` from a seeded permutation, once per round (``round``).

    Position ``i`` in key order receives the feedback at the position to which the round's keyed
    bijection sends ``i``. Self-pairs can occur, as in the source; ``exclude_equal`` leaves out
    the rows that got their own text. The rows are written once in key order, numbers included;
    ``numbers`` names the columns (position in key order, number of rows) of rows that have been.
    """
    if numbers:
        rows = src.withColumnsRenamed(dict(zip(numbers, ("_i", "_n"))))
        src = src.drop(*numbers)
    else:
        rows = ordered_index(src, [key], index_col="_i", total_col="_n")
    texts = rows.select(F.col("_i").alias("_j"), F.col("feedback").alias("alt_feedback"))
    goes = [F.struct(F.lit(r).alias("round"), bijection(F.col("_i"), F.col("_n"), seed=seed, salt=f"outer:{r}").alias("_t")) for r in range(rounds)]
    sent = rows.select("*", F.inline(F.array(*goes)))
    out = sent.join(texts, F.col("_t") == F.col("_j")).select(*src.columns, "alt_feedback", "round")
    return out.filter(~F.col("feedback").eqNullSafe(F.col("alt_feedback"))) if exclude_equal else out


def score_pairs(df: DataFrame, score_col: str = "score", *, item=("question", "distractor"),
                key: str = "row_id", block_rows: int = 4096) -> DataFrame:
    """Pairs of rows of one item with different, non-NULL scores: ``(first, win, lose)`` columns.

    ``first`` is the row with the smaller key (its fields make the prompt). The output is every
    unordered non-tied pair of the item, as the source builds it, so its size is the sum of
    squared item sizes. An item's rows, in the order of their scores, are cut into blocks of about
    ``block_rows``; a pair of blocks i <= j is one join key, so a hot item is spread over as many
    tasks as its output asks for. Blocks that hold one and the same score never meet, and a row
    goes to each block of the other side once. Items of one block are shuffled once, by item.
    """
    item = list(item)
    d = df.filter(F.col(score_col).isNotNull())
    for c in item:
        d = d.filter(F.col(c).isNotNull())
    rows = d.select(F.struct(*d.columns).alias("r"), key_digest(item).alias("_item"), F.col(score_col).alias("_s"), F.col(key).alias("_k"))

    large = materialize(large_groups(rows, ["_item"], block_rows), "large-items")
    small = rows.join(F.broadcast(large), "_item", "left_anti").select("_item", "r", "_s", "_k")
    low = small.select("_item", F.col("r").alias("l"), F.col("_s").alias("_ls"), F.col("_k").alias("_lk"))
    high = small.select("_item", F.col("r").alias("h"), F.col("_s").alias("_hs"), F.col("_k").alias("_hk"))
    alone = low.join(high, "_item")
    rows = rows.join(F.broadcast(large), "_item", "left_semi")

    # per item: its scores with how many rows lie below, and the least and largest score of each block
    scores = rows.groupBy("_item", "_s").agg(F.count(F.lit(1)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("_item").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grid = scores.withColumn("o", below).groupBy("_item").agg(
        F.array_sort(F.collect_list(F.struct("o", F.col("_s").alias("s"), "n"))).alias("_g"), F.sum("n").alias("_n"))

    def score_at(place):
        return F.element_at(F.filter("_g", lambda x: x["o"] <= place), -1)["s"]

    blocks = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / block_rows) - 1)
    grid = grid.withColumn("_b", F.transform(blocks, lambda t: F.struct(
        t.alias("t"), score_at(t * block_rows).alias("low"), score_at(F.least(F.col("_n"), (t + 1) * block_rows) - 1).alias("high"))))
    grid = materialize(grid, "score-grid")

    rows = join_counted(rows, grid, ["_item"], "_n")
    own = F.element_at(F.filter("_g", lambda x: x["s"] == F.col("_s")), 1)
    spread = F.pmod(F.xxhash64("_k"), F.lit(1 << 52)).cast("double") / float(1 << 52)  # where a row lies among its equals
    rows = rows.withColumn("_o", own).withColumn("_t", F.floor((F.col("_o.o") + F.floor(spread * F.col("_o.n"))) / block_rows).cast("int"))
    mine = F.element_at("_b", F.col("_t") + 1)
    after = F.filter("_b", lambda b: (b["t"] == F.col("_t")) | (b["t"] > F.col("_t")) & (b["high"] > mine["low"]))
    before = F.filter("_b", lambda b: (b["t"] == F.col("_t")) | (b["t"] < F.col("_t")) & (b["low"] < mine["high"]))
    rows = materialize(rows.select("r", "_item", "_s", "_k", F.col("_t").cast("long").alias("_at"), F.transform(after, lambda b: b["t"]).alias("_after"),
                                   F.transform(before, lambda b: b["t"]).alias("_before")), "score-rows")  # read by both sides
    low = rows.select("_item", F.col("r").alias("l"), F.col("_s").alias("_ls"), F.col("_k").alias("_lk"), F.col("_at").alias("i"), F.explode("_after").alias("j"))
    high = rows.select("_item", F.col("r").alias("h"), F.col("_s").alias("_hs"), F.col("_k").alias("_hk"), F.col("_at").alias("j"), F.explode("_before").alias("i"))
    met = low.join(high, ["_item", "i", "j"]).select(*alone.columns).unionByName(alone).filter((F.col("_ls") < F.col("_hs")) & (F.col("_lk") != F.col("_hk")))
    turned = F.col("_lk") > F.col("_hk")
    out = met.select(F.when(turned, F.col("h")).otherwise(F.col("l")).alias("a"), F.when(turned, F.col("l")).otherwise(F.col("h")).alias("b"))
    return out.select("a.*", *[F.col("b").getField(c).alias(f"b_{c}") for c in d.columns])
