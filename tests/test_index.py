"""Positional operators equal a global row_number, independent of partitioning; exact splits."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from feedlens.functions.hashing import seeded_hash
from feedlens.operators import index as ix


@pytest.mark.parametrize("parts,partitions", [(1, None), (3, 300), (17, 7)])
def test_ordered_index_equals_row_number(spark, parts, partitions):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(parts)
    got = ix.ordered_index(df, ["k"], total_col="n", partitions=partitions)
    ref = df.select("k", (F.row_number().over(Window.orderBy("k")) - 1).alias("r"))
    j = got.join(ref, "k")
    assert j.filter("idx <> r").count() == 0 and j.count() == 5000
    assert got.agg(F.max("n")).first()[0] == 5000


def test_hash_positions_hot_group(spark):
    # one key holds a third of all rows
    df = spark.range(0, 3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("g"))
    df = df.withColumn("h", seeded_hash(1, "id"))
    got = ix.hash_positions(df, ["g"], "h", ["id"], digits=2)
    w = Window.partitionBy("g").orderBy("h", "id")
    ref = df.select("id", (F.row_number().over(w) - 1).alias("p"), F.count("*").over(Window.partitionBy("g")).alias("s"))
    assert got.join(ref, "id").filter("pos <> p OR group_size <> s").count() == 0


def test_seeded_order_is_permutation(spark):
    df = spark.range(0, 1000)
    o = ix.seeded_order(df, ["id"])
    idx = sorted(r.idx for r in o.collect())
    assert idx == list(range(1000))
    o2 = ix.seeded_order(df.repartition(7), ["id"])
    assert sorted((r.id, r.idx) for r in o.collect()) == sorted((r.id, r.idx) for r in o2.collect())


@pytest.mark.parametrize("n,train,val", [(0, 0, 0), (1, 0, 0), (5, 3, 4), (35, 21, 28)])
def test_split_small(spark, n, train, val):
    df = spark.range(0, n).withColumnRenamed("id", "q")
    s = ix.split_by_share(df, ["q"]).groupBy("split").count().collect()
    counts = {r.split: r["count"] for r in s}
    assert counts.get("train", 0) == train
    assert counts.get("val", 0) == val - train
    assert counts.get("test", 0) == n - val


def test_sample_exact(spark):
    df = spark.range(0, 500)
    a = ix.sample_exact(df, 37, ["id"]).collect()
    b = ix.sample_exact(df.repartition(5), 37, ["id"]).collect()
    assert len(a) == 37 and sorted(a) == sorted(b)


def test_ordered_index_composite_with_nulls(spark):
    rows = [(q, d, i) for i, (q, d) in enumerate([(1, "b"), (None, "a"), (1, None), (2, "a"), (1, "a"), (None, None)] * 50)]
    df = spark.createDataFrame(rows, "q LONG, d STRING, i LONG")
    got = ix.ordered_index(df, ["q", "d", "i"], partitions=20)
    w = Window.orderBy(F.col("q").asc_nulls_last(), F.col("d").asc_nulls_last(), "i")
    ref = df.select("i", (F.row_number().over(w) - 1).alias("r"))
    assert got.join(ref, "i").filter("idx <> r").count() == 0


def test_hash_positions_null_group_apart_from_default_value(spark):
    # NULL keys form one group, distinct from the key equal to the NULL stand-in (0 / '')
    rows = [(i, None if i % 3 == 0 else (0 if i % 3 == 1 else 5), None if i % 4 == 0 else ("" if i % 4 == 1 else "x"))
            for i in range(600)]
    df = spark.createDataFrame(rows, "id LONG, g LONG, s STRING").withColumn("h", seeded_hash(3, "id"))
    got = ix.hash_positions(df, ["g", "s"], "h", ["id"], digits=2)
    assert got.columns == df.columns + ["pos", "group_size"]
    w = Window.partitionBy("g", "s").orderBy("h", "id")
    ref = df.select("id", (F.row_number().over(w) - 1).alias("p"),
                    F.count("*").over(Window.partitionBy("g", "s")).alias("n"))
    j = got.join(ref, "id")
    assert j.count() == 600 and j.filter("pos <> p OR group_size <> n").count() == 0


def test_key_digest_separates_null_empty_and_shifted_parts(spark):
    from feedlens.functions.hashing import key_digest
    rows = [(None, "ab"), ("", "ab"), ("a", "b"), ("ab", ""), ("ab", None), ("null", "ab"), ("a", "b")]
    df = spark.createDataFrame(rows, "x STRING, y STRING")
    d = [r.d for r in df.select(key_digest(["x", "y"]).alias("d")).collect()]
    assert len(set(d[:6])) == 6 and d[2] == d[6]


@pytest.mark.parametrize("n,digits", [(1, 1), (37, 1), (37, 2), (500, 1), (600, 3), (0, 2)])
def test_sample_exact_equals_smallest_hashes(spark, n, digits):
    df = spark.range(0, 500).repartition(4)
    got = sorted(r.id for r in ix.sample_exact(df, n, ["id"], digits=digits).collect())
    hashes = df.select("id", seeded_hash(221, F.lit("sample"), "id").alias("h")).collect()
    want = sorted(r.id for r in sorted(hashes, key=lambda r: (r.h, r.id))[:n])
    assert got == want


@pytest.mark.parametrize("partitions", [1, None, 15])
def test_ordered_index_write_once_equals_row_number(spark, partitions):
    df = spark.range(0, 2000).select((F.col("id") * 7919 % 2003).alias("k"), F.lit("x").alias("t"))
    got = ix.ordered_index(df, ["k"], partitions=partitions)
    assert got.columns == ["k", "t", "idx"]
    ref = df.select("k", (F.row_number().over(Window.orderBy("k")) - 1).alias("r"))
    j = got.join(ref, "k")
    assert j.count() == 2000 and j.filter("idx <> r").count() == 0
