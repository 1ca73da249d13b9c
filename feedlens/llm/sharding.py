"""Sharding by extendible hashing, with DataFrame operations only.

Method: a directory over the bits of a key hash starts with one bucket; every bucket above the
byte limit, and only that, splits on its next bit, until each shard fits. A shard's name is the
bit string that its rows' hashes begin with (empty: everything fits into one shard).

The directory is grown on histograms: one pass sums bytes and rows for every prefix of a run of
depths. As sums only shrink with depth, the leaves are the prefixes that fit and whose parent
doesn't; what is still too large at the deepest prefix of the run goes through the next run.

Scale. Texts are read once for their byte length; all else sees one slim row per document, sums
are combined per map task, and a hot source or text does not matter, as rows are placed by a
hash of their own key. Rows that share the key's 60 hash bits (rows that repeat the key) go on
splitting by bits of their row number's hash. A single row above the limit cannot be split; it
ends as a shard of its own.

Defined cases: null keys are hashed as such; a null or empty text has 0 bytes; repeated rows are
rows of their own; an empty table gives no rows. Other columns are ignored or passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.sources.files import materialize

KEY_BITS, ALL_BITS = 60, 124


def key_bits(*keys: str) -> Column:
    """Bit string: the first 60 bits of the md5 of the keys."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in keys])
    return F.lpad(F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 2), KEY_BITS, "0")


def grow_directory(sized: DataFrame, limit: int, run: int = 8) -> DataFrame:
    """Leaves (shard, shard_bytes, shard_docs) for ``sized`` (bits, bytes): every leaf holds at
    most ``limit`` bytes or a single row."""
    total = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    leaves, rows, first = None, sized, 0
    last = min(20, (total // limit).bit_length() + 4)  # a first run that ends most splits at once
    while True:
        finest = rows.groupBy(F.substring("bits", 1, last).alias("bits")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
        depths = F.explode(F.sequence(F.lit(first), F.lit(last)))
        sums = materialize(finest.select("bits", "bytes", "docs", depths.alias("depth"))
                           .groupBy("depth", F.substring("bits", F.lit(1), F.col("depth")).alias("shard"))
                           .agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs")), "shard-sums")
        fits = sums.filter((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("depth") == ALL_BITS))
        parents = fits.select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("parent"))
        found = (fits.withColumn("parent", F.substring("shard", F.lit(1), F.col("depth") - 1))
                 .join(parents, ["depth", "parent"], "left_anti").select("shard", "shard_bytes", "shard_docs"))
        leaves = found if leaves is None else leaves.unionByName(found)
        deepest = (F.col("depth") == last) & (F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)
        rest = sums.filter(deepest).select(F.col("shard").alias("open"))
        if last >= ALL_BITS or rest.isEmpty():
            return leaves
        rows = rows.join(rest, F.substring("bits", 1, last) == F.col("open"), "left_semi")
        first, last = last + 1, min(ALL_BITS, last + run)


def assign_shards(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text",
                  limit: int = 1 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: keys, ``carry`` columns, bytes, shard, shard_bytes, shard_docs."""
    columns = [*dict.fromkeys([*keys, *carry])]
    slim = materialize(docs.select(*columns, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"),
                                   key_bits(*keys).alias("_key"), F.monotonically_increasing_id().alias("_row")), "shard-rows")
    more = F.lpad(F.conv(F.hex(F.xxhash64("_row")), 16, 2), ALL_BITS - KEY_BITS, "0")
    rows = slim.withColumn("bits", F.concat("_key", more)).drop("_key", "_row")
    leaves = materialize(grow_directory(rows.select("bits", "bytes"), limit), "shard-directory")
    # the depths that occur: at most 125 numbers, whatever the data
    depths = [r[0] for r in leaves.select(F.length("shard")).distinct().collect()]
    named = rows.withColumn("shard", F.explode(F.array(*[F.substring("bits", 1, d) for d in depths]) if depths
                                               else F.array(F.lit(""))))
    return named.join(leaves, "shard").select(*columns, "bytes", "shard", "shard_bytes", "shard_docs")


def write_shards(docs: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text",
                 limit: int = 1 << 20) -> DataFrame:
    """Writes ``docs`` with one folder per shard (``shard=<bits>``) and returns the directory."""
    kept = materialize(docs.withColumn("_row_id", F.monotonically_increasing_id()), "shard-docs")
    shards = materialize(assign_shards(kept, keys, text_col, limit, carry=("_row_id",)), "shard-of-row")
    (kept.join(shards.select("_row_id", "shard"), "_row_id").drop("_row_id").repartition("shard")
     .write.mode("overwrite").partitionBy("shard").parquet(path))
    return shards.select("shard", "shard_bytes", "shard_docs").distinct()
