"""Arrow hand-off: round trips, files of failed attempts, reading without Spark."""

import os

import pytest
from pyspark.sql import functions as F

from feedlens.session import shared_dir
from feedlens.sources import arrow_files as af


def table(spark, n=500):
    return spark.range(n).select(
        "id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("t\n\"é"), "id")).alias("text"), (F.col("id") / 3).alias("x"),
        F.array("id", F.lit(None).cast("long")).alias("a"), F.struct(F.col("id").alias("i"), F.lit("s").alias("s")).alias("st"))


def test_round_trip_and_columns(spark):
    df, path = table(spark), shared_dir(spark, "arrow-test")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")  # a file is rolled between batches
    af.write_arrow(df.repartition(5), path, file_bytes="4000")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    back = af.read_arrow(spark, path, df.schema, partition_bytes="9000")
    assert back.schema == df.schema and back.exceptAll(df).isEmpty() and back.count() == 500
    assert back.rdd.getNumPartitions() > 2 and len(af.listed_files(path)) > 5
    slim = af.read_arrow(spark, path, df.select("x", "id").schema)
    assert slim.agg(F.sum("id"), F.count("x")).first()[0] == 500 * 499 // 2
    af.write_arrow(df.limit(3), path)  # appends
    assert af.read_arrow(spark, path, df.schema).count() == 503


def test_reading_without_spark(spark):
    df, path = table(spark, 50), shared_dir(spark, "arrow-plain")
    af.write_arrow(df, path)
    rows = [r for b in af.read_batches(path, ["id", "text"]) for r in b.to_pylist()]
    assert sorted(r["id"] for r in rows) == list(range(50)) and set(rows[0]) == {"id", "text"}


def test_lost_attempts_are_not_seen(spark):
    df, path = table(spark, 40), shared_dir(spark, "arrow-lost")
    af.write_arrow(df, path)

    @F.udf("boolean")
    def breaks(i):
        if i == 39:
            raise ValueError("lost")
        return True

    with pytest.raises(Exception, match="lost"):
        af.write_arrow(df.repartition(4).filter(breaks("id")), path)
    local = path.replace("file:", "")
    stray = next(f for f in os.listdir(local) if f.endswith(".arrows"))
    with open(f"{local}/{stray}", "rb") as f, open(f"{local}/stray.arrows", "wb") as g:
        g.write(f.read())
    assert af.read_arrow(spark, path, df.schema).count() == 40


def test_empty_tables(spark):
    df, path = table(spark, 5), shared_dir(spark, "arrow-empty")
    assert af.read_arrow(spark, path, df.schema).collect() == []
    af.write_arrow(df.filter("false"), path)
    assert af.listed_files(path) == [] and af.read_arrow(spark, path, df.schema).collect() == []
