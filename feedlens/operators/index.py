"""Positional operators without a single-partition exchange.

pandas code uses the implicit RangeIndex as identity (reset index, ``iloc`` splits, positional
zips). A global ``row_number() OVER (ORDER BY ...)`` in Spark moves every row into one task, so
positions are built from two pieces instead:

* ``ordered_index``: range-partition and sort by the key, number rows inside each partition,
  write that once, and add per-partition offsets. The offsets table has one row per partition,
  so its broadcast size is bounded by the partition count, not by the data.
* ``key_positions``: the same for wide rows, of which only the keys are put in order.
* ``hash_positions``: position inside a group when the order is a uniform hash. Rows are split
  into ``16**digits`` buckets by the leading hex digits of the hash, so a group holding a large
  share of all rows is numbered by many tasks; per-bucket counts give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.functions.hashing import seeded_hash
from feedlens.rubric import SEED


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


_DEFAULTS = {"string": "", "boolean": False, "binary": b""}


def _sort_struct(df: DataFrame, order_by) -> tuple[Column, list]:
    """A NULL-free struct whose natural order is the requested order (ascending, NULLs last
    unless the column is given as ``(name, "nulls_first")``)."""
    fields, names = [], []
    for spec in order_by:
        name, nulls_first = (spec, False) if isinstance(spec, str) else (spec[0], spec[1] == "nulls_first")
        dt = df.schema[name].dataType
        default = _DEFAULTS.get(dt.simpleString(), 0)
        flag = F.col(name).isNotNull() if nulls_first else F.col(name).isNull()
        fields += [flag.alias(f"_n{len(names)}"), F.coalesce(F.col(name), F.lit(default).cast(dt)).alias(f"_v{len(names)}")]
        names.append(name)
    return F.struct(*fields), names


def ordered_index(df: DataFrame, order_by, *, index_col: str = "idx", total_col: str | None = None,
                  partitions: int | None = None) -> DataFrame:
    """0-based position of each row in the order ``order_by`` (columns, ascending; make it unique).

    Equals ``row_number() OVER (ORDER BY order_by) - 1`` without a single-partition window: rows
    are range-partitioned and sorted by Spark, numbered inside their partition, and written once
    under the shared folder, so every later pass sees the same numbers. A row's position is its
    number plus the count of rows in earlier partitions, a table with one row per partition
    (broadcast, bounded). The plan is the same at every size. Hand in slim rows: what else a job
    needs is joined back on the key.
    """
    from feedlens.sources.files import materialize

    key, _ = _sort_struct(df, order_by)
    keyed = df.withColumn("_key", key)
    ranged = keyed.repartitionByRange(partitions, "_key") if partitions else keyed.repartitionByRange("_key")
    # the id is (partition number << 33) + row number inside the partition, here in sorted order
    numbered = ranged.sortWithinPartitions("_key").withColumn("_id", F.monotonically_increasing_id()).drop("_key")
    numbered = materialize(numbered, "ordered-index").withColumn("_part", F.shiftright("_id", 33))
    counts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(F.col("_part").alias("_op"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                            F.sum("_n").over(every).alias("_total"))
    out = numbered.join(F.broadcast(offsets), F.col("_part") == F.col("_op"))  # one row per partition: bounded
    out = out.withColumn(index_col, (F.col("_off") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).cast("long"))
    if total_col:
        out = out.withColumn(total_col, F.col("_total").cast("long"))
    return out.drop("_id", "_part", "_op", "_off", "_total")


def key_positions(df: DataFrame, key: str, *, index_col: str = "idx", total_col: str = "n") -> DataFrame:
    """Rows of ``df``, written once, with their position in the order of ``key`` (nulls last, equal
    keys in any order) and the number of rows.

    For wide rows: only the keys are put in order. The rows are dealt by the hash of their key, and
    not moved at all if a join on it has dealt them already; a row's position is the first one of
    its key plus its number among the rows of that key.
    """
    from feedlens.sources.files import materialize

    keys = ordered_index(df.select(key).filter(F.col(key).isNotNull()), [key], index_col="_at")
    starts = keys.groupBy(F.col(key).alias("_key")).agg(F.min("_at").alias("_start"))
    size = df.select(F.count(F.col(key)).alias("sound"), F.count(F.lit(1)).alias("all"))
    rows = df.join(starts, F.col(key) == F.col("_key"), "left")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(key)) - 1
    rows = rows.withColumn(index_col, F.coalesce("_start", size.select("sound").scalar()) + nth)
    return materialize(rows.withColumn(total_col, size.select("all").scalar()).drop("_key", "_start"), "key-positions")


def hash_positions(df: DataFrame, keys, hash_col: str, tie_cols, *, pos_col: str = "pos",
                   size_col: str | None = "group_size", digits: int = 4) -> DataFrame:
    """Position (0-based) of each row inside its ``keys`` group ordered by ``(hash_col, *tie_cols)``.

    Equals ``row_number() OVER (PARTITION BY keys ORDER BY hash_col, tie_cols) - 1``; with
    ``keys=[]`` it is a global index in hash order. ``hash_col`` must be a hex string.
    """
    keys = list(keys)
    tie = list(tie_cols)
    b = df.withColumn("_bucket", F.substring(F.col(hash_col), 1, digits))
    # NULL-safe group keys as plain columns (value with a default, NULL flag), so the window,
    # the count and the offset join all hash-partition on the same expressions: the big side is
    # shuffled once and the join reuses that partitioning.
    gk = []
    for k in keys:
        if df.schema[k].nullable:
            dt = df.schema[k].dataType
            default = F.lit(_DEFAULTS.get(dt.simpleString(), 0)).cast(dt)
            b = b.withColumn(f"_gv_{k}", F.coalesce(F.col(k), default)).withColumn(f"_gn_{k}", F.col(k).isNull())
            gk += [f"_gv_{k}", f"_gn_{k}"]
        else:
            gk.append(k)
    within = Window.partitionBy(*gk, "_bucket").orderBy(hash_col, *tie)
    b = b.withColumn("_rn", F.row_number().over(within) - 1)
    counts = b.groupBy(*gk, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    if gk:
        before = Window.partitionBy(*gk).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        every = Window.partitionBy(*gk)
    else:
        before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        every = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(
        *[F.col(g).alias(f"_o{g}") for g in gk], F.col("_bucket").alias("_o_bucket"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(every).alias("_size"),
    )
    if not gk:
        # at most 16**digits rows: a proven bound for the broadcast
        offsets = F.broadcast(offsets)
    cond = [F.col(g) == F.col(f"_o{g}") for g in gk] + [F.col("_bucket") == F.col("_o_bucket")]
    out = b.join(offsets, cond).drop(*[f"_o{g}" for g in gk], "_o_bucket")
    out = out.withColumn(pos_col, F.col("_off") + F.col("_rn"))
    if size_col:
        out = out.withColumn(size_col, F.col("_size"))
    return out.drop("_bucket", "_rn", "_off", "_size", *[g for g in gk if g not in keys])


def seeded_order(df: DataFrame, key_cols, *, seed=SEED, salt: str = "shuffle", index_col: str = "idx",
                 total_col: str | None = None) -> DataFrame:
    """Seeded shuffle: position of each row when ordered by ``md5(seed:salt:key)``, ties by key."""
    keys = list(key_cols)
    h = df.withColumn("_h", seeded_hash(seed, F.lit(salt), *keys))
    out = hash_positions(h, [], "_h", keys, pos_col=index_col, size_col=total_col)
    return out.drop("_h")


def split_by_share(df: DataFrame, key_cols, shares=(("train", 0.6), ("val", 0.8)), last: str = "test",
                   *, seed=SEED, split_col: str = "split") -> DataFrame:
    """Exact positional split after a seeded shuffle: ``idx < floor(n * share)`` (double arithmetic)."""
    ordered = seeded_order(df, key_cols, seed=seed, index_col="_idx", total_col="_n")
    expr = None
    for name, cut in shares:
        cond = F.col("_idx") < F.floor(F.col("_n").cast("double") * F.lit(float(cut)))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    expr = expr.otherwise(F.lit(last))
    return ordered.withColumn(split_col, expr).drop("_n").withColumnRenamed("_idx", "split_idx")


def sample_exact(df: DataFrame, n: int, key_cols, *, seed=SEED, digits: int = 5, strict: bool = False) -> DataFrame:
    """Exactly ``n`` rows without replacement: the ``n`` smallest seeded hashes.

    A table with fewer rows is returned whole, or fails the job with ``strict`` (an empty table
    gives no rows either way).

    A plain ``orderBy(hash).limit(n)`` sends the local top ``n`` of every input partition to one
    task (``partitions x n`` rows). Instead, rows are counted per hash prefix (``16**digits``
    prefixes, map-side partial counts); the smallest prefix whose running count reaches ``n`` is a
    scalar subquery, and only rows at or below it (about ``n + rows / 16**digits``) reach the final
    TakeOrderedAndProject. Every row of the exact answer is among them.
    """
    keys = list(key_cols)
    h = (df.withColumn("_h", seeded_hash(seed, F.lit("sample"), *keys))
         .withColumn("_sb", F.substring(F.col("_h"), 1, digits)))
    counts = h.groupBy("_sb").agg(F.count(F.lit(1)).alias("_c"))  # at most 16**digits rows
    running = counts.withColumn("_cum", F.sum("_c").over(
        Window.orderBy("_sb").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cut = running.filter(F.col("_cum") >= F.lit(n)).agg(F.min("_sb")).scalar()  # NULL: fewer than n rows
    if strict:
        short = F.raise_error(F.lit(f"sample_exact: fewer than {n} rows")).cast("boolean")
        keep = h.filter(F.when(cut.isNull(), short).otherwise(F.col("_sb") <= cut))
    else:
        keep = h.filter(cut.isNull() | (F.col("_sb") <= cut))
    return keep.orderBy("_h", *keys).limit(n).drop("_h", "_sb")


def stratified_sample(df: DataFrame, sizes: dict[str, int], split_col: str, key_cols, *, seed=SEED, digits: int = 5,
                      strict: bool = False) -> DataFrame:
    """Exactly ``sizes[s]`` rows of every split ``s`` without replacement: the smallest seeded hashes.

    One histogram over (split, hash prefix) gives one threshold per split, so at most one row per
    name in ``sizes``, which is broadcast. One pass keeps the rows at or below their split's
    threshold (about ``n + rows / 16**digits`` of a split), and their order decides the last ones.
    ``key_cols`` name a row; rows of other splits are left out. A split with fewer rows is
    returned whole, or fails the job with ``strict``.
    """
    keys = list(key_cols)
    wanted = F.create_map(*[F.lit(x) for s, n in sizes.items() for x in (s, n)])
    h = (df.filter(F.col(split_col).isin(*sizes)).withColumn("_h", seeded_hash(seed, F.lit("sample"), *keys))
         .withColumn("_sb", F.substring(F.col("_h"), 1, digits)))
    counts = h.groupBy(split_col, "_sb").agg(F.count(F.lit(1)).alias("_c"))  # at most 16**digits rows a split
    running = F.sum("_c").over(Window.partitionBy(split_col).orderBy("_sb").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cuts = (counts.withColumn("_cum", running).groupBy(F.col(split_col).alias("_s"))
            .agg(F.min(F.when(F.col("_cum") >= wanted[F.col(split_col)], F.col("_sb"))).alias("_cut"), F.max("_cum").alias("_n")))
    if strict:
        held = cuts.agg(F.map_from_entries(F.collect_list(F.struct("_s", "_n"))).alias("held"))
        lacks = [F.when(F.coalesce(F.col("held")[s], F.lit(0)) < n, F.raise_error(F.lit(f"stratified_sample: fewer than {n} rows of {s}")).cast("boolean"))
                 .otherwise(F.lit(True)) for s, n in sizes.items()]
        cuts = cuts.filter(held.select(F.array_min(F.array(*lacks))).scalar())
    kept = h.join(F.broadcast(cuts.drop("_n")), F.col(split_col) == F.col("_s")).filter("_cut IS NULL OR _sb <= _cut")
    rank = F.row_number().over(Window.partitionBy(split_col).orderBy("_h", *keys))
    return (kept.withColumn("_rank", rank).filter(F.col("_rank") <= max(sizes.values())).filter(F.col("_rank") <= wanted[F.col(split_col)])
            .drop("_h", "_sb", "_s", "_cut", "_rank"))


def batch_ids(df: DataFrame, batch_size: int, order_by, *, batch_col: str = "batch_id") -> DataFrame:
    """Fixed-size batches in ``order_by`` order: ``floor(idx / batch_size)``."""
    out = ordered_index(df, order_by, index_col="_idx")
    return out.withColumn(batch_col, F.floor(F.col("_idx") / F.lit(batch_size)).cast("bigint")).drop("_idx")
