"""Mixing sources to target weights by subset-sum budget fitting.

Method: documents are counted by exact length per source. A source's target is filled with
whole passes over the source, then with a systematic sample of the rest: with all lengths in
order, the number of documents taken up to any length is the wanted share of those there are, to
within one document, from a seeded start. What the sample misses or oversteps, no more than the
longest document, is mended by one document and a bounded-knapsack dynamic program over the
lengths still free, in a seeded order. Only where the target can't be met to the word that way is
more of the sample given up. The answer is a number of documents per length; that many documents
of each length are selected by seeded hash order. Documents of any length take part.

Targets: source i weighs w_i and may give at most ``max_passes`` times its size. Sharing the
total by weight and resharing every excess until no source is above its bound is the water
level L with sum(min(bound_i, L * w_i)) = total; it is found by running sums over the sources in
order of bound_i / w_i (one row per source).

Scale. Texts are read once, for their lengths. What is shuffled is one slim row per document
and a histogram (source, length), which a hot source or a hot length does not enlarge. Selection
in a (source, length) class goes by hash buckets: counts by bucket tell which buckets are taken
whole, and one bucket a class is taken in part. In it rows of equal content are one group with a
count, so that any number of repeated rows is one row of the order; a group taken in part gives
its rows by buckets of their row numbers. Hot buckets and groups are never join keys. The targets
are ordered in one task, one row per source; a source's lengths are fitted in one task, one row
per distinct length.

Defined cases: a null or empty text has size 0 and nothing taken; a null source is a source of
its own, last in order; repeated rows are documents of their own; sources without words get
target 0. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedlens.operators.hot import join_counted
from feedlens.llm.words import sliced, text_buffers, word_spans
from feedlens.sources.files import materialize

BUCKETS = 256


def fit_budget(lengths: np.ndarray, free: np.ndarray, budget: int, table: int = 1 << 17, order: np.ndarray | None = None) -> np.ndarray:
    """How many documents of each length to take so that their sum comes closest to ``budget``
    (of two equally close sums the smaller): the longest first while more than ``table`` words
    are missing, then a bounded knapsack over every sum up to the missing words plus the longest
    length, beyond which no better sum can lie. A budget above ``table`` that is not met to the
    word that way is also fitted by the sums that documents make, and the closer answer stands.
    ``order``: in which the program offers the lengths (longest first if none is given)."""
    take = np.zeros(len(lengths), np.int64)
    falling = np.argsort(-lengths, kind="stable")
    rest = budget
    for reserve in (table // 2, 0):  # then without a reserve, where single documents exceed it
        for i in falling:
            if rest <= table:
                break
            n = min(int(free[i] - take[i]), (rest - reserve) // int(lengths[i]))
            if n > 0:
                take[i] += n
                rest -= n * int(lengths[i])
    if rest <= table:
        take += _fit_every_sum(lengths, free - take, rest, falling if order is None else order)
    else:  # every free document is longer than what is missing, so at most one of them can help
        open_ = [i for i in falling if free[i] > take[i]]
        if open_ and int(lengths[open_[-1]]) - rest < rest:
            take[open_[-1]] += 1
    if budget <= table or (take * lengths).sum() == budget:
        return take
    total = lambda t: int((t * lengths).sum())
    return min(take, _fit_sums(lengths, free, budget, 2 * table), key=lambda t: (abs(total(t) - budget), total(t)))


def _fit_every_sum(lengths: np.ndarray, free: np.ndarray, budget: int, order: np.ndarray) -> np.ndarray:
    """``fit_budget`` by a table of every sum."""
    take = np.zeros(len(lengths), np.int64)
    most = budget + min(budget, int(lengths.max(initial=0)))
    reach = np.zeros(most + 1, bool)
    reach[0] = True
    by = np.full(most + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    for i in order:
        length, left = int(lengths[i]), int(free[i])
        left = min(left, most // length)
        copies = 1
        while left > 0 and not reach[budget]:  # 1, 2, 4, ... copies make every count up to left
            n = min(copies, left)
            weight = n * length
            new = np.zeros(most + 1, bool)
            new[weight:] = reach[:most + 1 - weight]
            new &= ~reach
            by[new] = len(items)
            items.append((int(i), n))
            reach |= new
            left -= n
            copies *= 2
        if reach[budget]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, n = items[by[at]]
        take[i] += n
        at -= n * int(lengths[i])
    return take


def _fit_sums(lengths: np.ndarray, free: np.ndarray, budget: int, room: int) -> np.ndarray:
    """``fit_budget`` by the sums that documents make: exact up to ``room`` different sums; from
    then on a sum is added only if none lies in its ``room``-th part of twice the budget."""
    take = np.zeros(len(lengths), np.int64)
    most = 2 * budget  # a larger sum is further off than none at all
    width = -(-most // room)
    items: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        left, copies = min(int(free[i]), most // int(lengths[i])), 1
        while left > 0:
            items.append((int(i), min(copies, left)))
            left -= copies
            copies *= 2
    sums, by, full = np.zeros(1, np.int64), np.full(1, -1, np.int64), False
    for k, (i, n) in enumerate(items):
        new = np.setdiff1d(sums + n * int(lengths[i]), sums, assume_unique=True)
        new = new[new <= most]
        full |= len(sums) + len(new) > room
        if full:
            cells, first = np.unique(new // width, return_index=True)
            new = new[first[~np.isin(cells, sums // width)]]
        at = np.searchsorted(sums, new)
        sums, by = np.insert(sums, at, new), np.insert(by, at, k)
        best = int(np.abs(sums - budget).min())
        if not best or full and best <= width:
            break
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, n = items[by[np.searchsorted(sums, at)]]
        take[i] += n
        at -= n * int(lengths[i])
    return take


def _sample(counts: np.ndarray, want: int, total: int, start: int) -> np.ndarray:
    """Of each length's documents the ``want / total`` part, by rounding running sums."""
    out, seen, had = [], 0, start // total
    for c in counts.tolist():
        seen += c
        now = (seen * want + start) // total
        out.append(now - had)
        had = now
    return np.array(out, np.int64)


def plan_source(lengths: np.ndarray, counts: np.ndarray, target: float, table: int = 1 << 17, seed: int = 0):
    """(whole passes, documents of each length taken once more) for one source; lengths rise."""
    total, goal = int((lengths * counts).sum()), round(target)
    if not total or not goal:
        return 0, np.zeros(len(lengths), np.int64)
    passes, rest = divmod(goal, total)
    rng = np.random.default_rng(seed)
    start = int(rng.random() * total)
    # lengths in a seeded order, each as early as its number of documents makes likely
    order = np.argsort(rng.exponential(size=len(lengths)) / np.maximum(counts, 1e-9), kind="stable")
    longest, reserve, best, least = int(lengths[-1]), 0, None, None
    while least is None or least > 0 and reserve < 2 * rest:
        sample = _sample(counts, max(0, rest - reserve), total, start)
        for nearest in (True, False):  # with the one document that comes nearest, then without
            take = sample.copy()
            miss = rest - int((take * lengths).sum())
            while miss < 0:
                at = np.flatnonzero((take > 0) & (lengths >= -miss))
                i = int(at[0]) if len(at) else int(np.flatnonzero(take)[-1])
                take[i] -= 1
                miss += int(lengths[i])
            at = np.flatnonzero((take < counts) & (lengths <= miss))
            if nearest and len(at):
                take[at[-1]] += 1
                miss -= int(lengths[at[-1]])
            take += fit_budget(lengths, counts - take, miss, table, order)
            off = abs(int((take * lengths).sum()) - rest)
            if least is None or off < least:
                best, least = take, off
            if not least:
                break
        reserve = max(longest, 2 * reserve)
    return passes, best


def _sizes(text_col: str, slice_bytes: int):
    def run(batches):
        for b in sliced(batches, text_col, slice_bytes):
            at = b.schema.get_field_index(text_col)
            size = np.diff(word_spans(*text_buffers(b.column(at)))[2])
            keep = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(size)],
                                             [*[b.schema.names[i] for i in keep], "size"])

    return run


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, max_passes: float) -> DataFrame:
    """``sources`` (source, source_size) with each source's target in words."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sources.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(max_passes))).alias("cap"))
    # a source is full at every level from cap / w on; before it the level is (total - full caps) / open weights
    filled = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = (s.withColumn("goal", F.least(F.sum("source_size").over(everything) * F.lit(float(share)), F.sum("cap").over(everything)))
         .withColumn("caps", F.sum("cap").over(filled.rowsBetween(W.unboundedPreceding, -1)))
         .withColumn("open", F.sum("w").over(filled.rowsBetween(0, W.unboundedFollowing)))
         .withColumn("level", (F.col("goal") - F.coalesce("caps", F.lit(0.0))) / F.col("open")))
    # the first source that stays below its bound fixes the level; later ones would give a lower one
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(everything))
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), "cap")).alias("target"))


def mix_plan(slim: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_passes: float = 2,
             seed: int = 42, table: int = 1 << 17, content: Sequence[str] = ()) -> DataFrame:
    """``slim`` (source, size, a row number and any key columns; one row per document, written) with
    source_size, target and copies: how often the mix takes the document. Documents are drawn in
    the order of a seeded hash of the ``content`` columns (all keys if none are named); the row
    number only tells rows of equal content apart."""
    keys = [c for c in slim.columns if c not in ("source", "size", "row")]
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in content or keys], "size")
    group = ["no_source", "source", "size"]  # plain join keys: a null source is "" and marked
    slim = (slim.withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
            .withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit(""))))
    counts = materialize(slim.groupBy(*group, "bucket").agg(F.count("*").alias("n")), "mix-counts")
    named = F.when(~F.col("no_source"), F.col("source"))
    histogram = counts.groupBy(*group).agg(F.sum("n").alias("n"))
    sources = histogram.groupBy("no_source", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sources.select(named.alias("source"), "source_size"), weights, share, max_passes)
    targets = materialize(targets.select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"),
                                         "source_size", "target"), "mix-targets")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        some = (pdf["size"] > 0).to_numpy()
        start = zlib.crc32(f"{seed}:{pdf['no_source'].iloc[0]}:{pdf['source'].iloc[0]}".encode())
        passes, extra = plan_source(pdf["size"].to_numpy()[some], pdf["n"].to_numpy()[some], float(pdf["target"].iloc[0]), table, start)
        out = pdf[[*group, "source_size", "target"]].assign(passes=passes, extra=0)
        out.loc[some, "extra"] = extra
        return out

    # one task per source over its histogram: as many rows as the source has distinct lengths
    lengths = (histogram.join(targets, ["no_source", "source"]).groupBy("no_source", "source")
               .applyInPandas(fit, "no_source boolean, source string, size long, source_size long, target double, passes long, extra long"))
    lengths = materialize(lengths, "mix-lengths")

    def share_out(counted: DataFrame, within: list[str], order: str, n: str, whole: str, part: str) -> DataFrame:
        """Hands ``whole`` to rows of ``n`` documents in order, each as much as it has."""
        before = F.coalesce(F.sum(n).over(W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return counted.withColumn(part, F.least(F.greatest(F.lit(0), F.col(whole) - before), F.col(n))).drop(whole)

    quota = share_out(counts.join(lengths, group), group, "bucket", "n", "extra", "quota")
    rows = join_counted(slim, quota, [*group, "bucket"], "n")
    told = [*keys, named.alias("source"), "size", "source_size", "target"]
    copies = lambda more: F.when(F.col("size") > 0, F.col("passes") + more).otherwise(0).alias("copies")
    settled = rows.filter("quota IN (0, n)").select(*told, copies(F.when(F.col("quota") > 0, 1).otherwise(0)))

    # the bucket of each (source, size) that is taken in part: groups of equal content in hash order
    rows = materialize(rows.filter("quota NOT IN (0, n)").drop("n", "bucket"), "mix-parts")
    equal = rows.groupBy(*group, "h").agg(F.count("*").alias("n"), F.max("quota").alias("whole"))
    equal = materialize(share_out(equal, group, "h", "n", "whole", "part"), "mix-equal")
    rows = join_counted(rows.drop("quota"), equal, [*group, "h"], "n")
    sorted_ = rows.filter("part IN (0, n)").select(*told, copies(F.when(F.col("part") > 0, 1).otherwise(0)))

    # and its group that is taken in part: any of its equal rows, by buckets of their row numbers
    rows = rows.filter("part NOT IN (0, n)").withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(BUCKETS)).cast("int"))
    last = rows.groupBy(*group, "h", "bucket").agg(F.count("*").alias("m"), F.max("part").alias("whole"))
    last = share_out(last, [*group, "h"], "bucket", "m", "whole", "some")
    place = F.row_number().over(W.partitionBy(*group, "h", "bucket").orderBy("row"))
    rows = rows.join(last, [*group, "h", "bucket"]).withColumn("place", place)
    return settled.unionByName(sorted_).unionByName(rows.select(*told, copies(F.when(F.col("place") <= F.col("some"), 1).otherwise(0))))


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              slice_bytes: int = 4 << 20, **plan) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken (copies * size)."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("text_hash"),
                                   F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("_text"))
                       .mapInArrow(_sizes("_text", slice_bytes), f"doc_id {kind}, source string, text_hash long, row long, size long"), "mix-slim")
    return mix_plan(slim, **plan).select("doc_id", "source", "size", "source_size", "target", "copies",
                                         (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        slice_bytes: int = 4 << 20, **plan) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken (all columns kept).

    The documents are written once with a row number, so that the plan, made from the slim
    columns, finds its row again; only rows that are taken are read back into the join.
    """
    kept = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
                       .withColumn("row", F.monotonically_increasing_id()), "mix-docs", compression="zstd")
    doc = lambda c: F.col("doc").getField(c)
    slim = materialize(kept.select("row", F.col("row").alias("id"), doc(source_col).cast("string").alias("source"), F.xxhash64(doc(id_col), doc(text_col)).alias("text_hash"),
                                   doc(text_col).alias("_text"))
                       .mapInArrow(_sizes("_text", slice_bytes), "row long, id long, source string, text_hash long, size long"), "mix-slim")
    copies = mix_plan(slim, content=["text_hash"], **plan).filter("copies > 0").select(F.col("id").alias("row"), "copies")
    return (kept.join(copies, "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
            .select(*[doc(c).alias(c) for c in docs.columns]))
