"""Typed readers of CSV exports, and writers of datasets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import new_path

MANIFEST = "row_limit_per_table long, tables map<string, struct<rows: long, file: string, columns: array<string>, excluded_columns: array<string>>>"


def read_table(spark: SparkSession, folder: str, name: str, schema: StructType | str, partitions: int | None = None) -> DataFrame:
    """A (gzip) CSV table with a header under a declared schema, landed as Parquet in the shared folder.

    Gzip can't be split, so rows are dealt anew once; fields may be quoted and span lines; empty
    fields are null.
    """
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.read.schema(schema).csv(f"{folder}/{name}", header=True, multiLine=True, escape='"', timestampFormat="yyyy-MM-dd HH:mm:ss")
    path = new_path(spark, name.split(".")[0])
    rows.repartition(n).write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(table, rows, file, columns, excluded_columns, row_limit) of an export's manifest.json."""
    m = spark.read.schema(MANIFEST).json(path, multiLine=True)
    return m.select("row_limit_per_table", F.explode("tables").alias("table", "t")).select("table", "t.*", F.col("row_limit_per_table").alias("row_limit"))


def write_dataset(df: DataFrame, path: str, form: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """A dataset, a folder for each value of `by` (split, model); CSV is gzipped and has a header."""
    out = df.write.partitionBy(*by) if by else df.write
    if form == "csv":
        out.csv(path, header=True, compression="gzip", escape='"', timestampFormat="yyyy-MM-dd HH:mm:ss")
    else:
        out.parquet(path)


def report_rows(df: DataFrame, job: str, keys: tuple[str, ...] = (), low: str = "ci_low", high: str = "ci_high") -> DataFrame:
    """The long table (job, slice, metric, value, ci_lo, ci_hi) of a wide table of metrics, or of one with (stat, value, interval)."""
    cut = F.concat_ws(",", *[F.concat_ws("=", F.lit(k), F.col(k).cast("string")) for k in keys]) if keys else F.lit("all")
    if {"stat", "value", low, high} <= set(df.columns):
        return df.select(F.lit(job).alias("job"), cut.alias("slice"), F.col("stat").alias("metric"), F.col("value").cast("double"), F.col(low).alias("ci_lo"), F.col(high).alias("ci_hi"))
    values = [c for c in df.columns if c not in keys]
    each = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values])
    return df.select(F.lit(job).alias("job"), cut.alias("slice"), F.explode(each).alias("m")).select("job", "slice", "m.*", F.lit(None).cast("double").alias("ci_lo"), F.lit(None).cast("double").alias("ci_hi"))


def write_report(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Report rows as Parquet, or as JSON with a document for each job: its metrics by slice."""
    if form == "json":
        one = F.struct("metric", "value", "ci_lo", "ci_hi")
        rows.groupBy("job", "slice").agg(F.sort_array(F.collect_list(one)).alias("metrics")).write.json(path)  # as many as a slice has metrics
    else:
        rows.write.parquet(path)
