"""Hand-off between jobs: CSV and Parquet scans and sinks, run-parameter columns.

Stages of the source hand data over as CSV files whose names carry the run parameters.
Here a table is Parquet (or CSV on request) and run parameters are columns, usually
partition columns, so a run or split is selected by partition pruning at the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The strings pandas.read_csv treats as missing by default.
PANDAS_NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header row, RFC-4180 quoting (quote doubled inside a quoted cell), no index column,
    and no whitespace trimming on write (Spark trims by default)."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *, na_columns=(),
             na_values=PANDAS_NA_VALUES, range_bytes: int | None = 32 << 20) -> DataFrame:
    """Declared-schema scan that keeps quoted multi-line cells whole.

    A file is read by byte ranges of ``range_bytes`` (RFC 4180 files; see ``csv_ranges``). With
    None Spark's multi-line reader reads a file in one task, through any Hadoop file system and
    with quotes inside unquoted cells.

    ``na_columns`` are read as text, mapped to NULL when they hold one of ``na_values``, and
    then cast to their declared type (pandas' missing-value rule, applied to labels only).
    """
    from feedlens.sources.csv_ranges import csv_records

    na_columns = list(na_columns)
    scan_schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in na_columns else f.dataType, True)
                                for f in schema.fields])
    if range_bytes:
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scan_schema.fields)
        row = F.from_csv("record", ddl, {"quote": '"', "escape": '"'})
        df = csv_records(spark, path, range_bytes=range_bytes).select(row.alias("row")).select("row.*")
    else:
        df = (spark.read.schema(scan_schema).option("header", True).option("multiLine", True)
              .option("quote", '"').option("escape", '"').csv(path))
    for f in schema.fields:
        if f.name in na_columns:
            c = F.col(f.name)
            df = df.withColumn(f.name, F.when(c.isNull() | c.isin(*na_values), None).otherwise(c).try_cast(f.dataType))
    return df


def write_table(df: DataFrame, path: str, partition_by=(), mode: str = "overwrite", compression: str | None = None) -> None:
    w = df.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_run_columns(df: DataFrame, **params) -> DataFrame:
    """Run parameters (model, k, with/without solution, rubric, ...) as literal columns."""
    for k, v in params.items():
        df = df.withColumn(k, F.lit(v))
    return df


def select_partition(df: DataFrame, **eq) -> DataFrame:
    """Equality filters on partition columns (pruned at the scan)."""
    for k, v in eq.items():
        df = df.filter(F.col(k) == F.lit(v))
    return df


def records(df: DataFrame, cols, name: str = "meta_data") -> DataFrame:
    """Whole row as one nested record column (``to_dict('records')``)."""
    return df.withColumn(name, F.struct(*[F.col(c) for c in cols]))


def materialize(df: DataFrame, name: str, partition_by=(), compression: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and scan it back.

    Cuts the lineage of an intermediate that several branches of a job read (each branch then
    prunes columns and partitions at the scan instead of recomputing the whole chain), and
    survives executor loss: the data lives in the shared folder, not on executors.
    ``compression`` names a Parquet codec (for tables of whole texts, where disk counts).
    """
    from feedlens.session import shared_dir

    spark = df.sparkSession
    path = shared_dir(spark, name) + "/data"
    write_table(df, path, partition_by, compression=compression)
    return read_table(spark, path)
