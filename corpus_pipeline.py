"""Corpus pipeline: five stages over ``documents``, each one of the operators in ``feedlens.llm``.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a
DataFrame that is written and read again before the next. All but the last return the columns
of ``docs``. No stage is expressible in SQL (learned votes, XXH64 fingerprints, tokenizer), so
``ORACLE_SQL`` is None and the tests hold the rows against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm import mixing, packing, quality_knn, simhash, substring_cover
from feedlens.llm.queries import fit_quality, tokenizer_path
from feedlens.sources.files import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality_knn.classify(docs, fit_quality(spark, sf_dir))
    return scored.filter("predicted = 1").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest id.

    Rows that repeat this id keep one row; rows without an id are kept unless their component
    holds an id, and one of several such rows of a component is kept.
    """
    slim = materialize(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "dedup-docs", compression="zstd")
    rows = simhash.simhash_components(slim.select("row", F.col("doc.text").alias("text")), "row", "text")
    member = rows.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    first = (member.join(slim.select("row", F.col("doc.doc_id").alias("doc_id")), "row").groupBy("component")
             .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least")).select(F.col("least.row").alias("row")))
    return slim.join(first, "row", "left_semi").select("doc.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; texts that lose nothing stay as they are, those that
    lose every word stay as empty texts. The operator's chunks carry each text once."""
    marked = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("doc"), "text")
    cut = substring_cover.remove_repeats(marked)
    lost = F.col("n_removed") > 0
    changed = {"text": F.when(lost, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(lost, F.length("kept_text")).otherwise(F.col("doc.n_chars"))
    return cut.select(*[(changed[f.name] if f.name in changed else F.col("doc").getField(f.name)).cast(f.dataType).alias(f.name)
                        for f in docs.schema])


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("weighted_mix", weighted_mix), ("packed", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
