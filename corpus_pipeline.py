"""A corpus pipeline of five stages over `documents`; each works on all that the one before kept.

language ID -> SimHash near-dedup -> benchmark decontamination -> PII -> SentencePiece
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.language import identified
from gaugeworks.llm.pieces import piece_ids
from gaugeworks.llm.pii import redacted
from gaugeworks.llm.simhash import near_copies
from gaugeworks.llm.suffix_array import clean_documents
from gaugeworks.sources.scratch import new_path, written

#: Rows a batch handed to Python holds at most.
BATCH_ROWS = "1000"


def _batched(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of docs has."""
    taken = "_".join(["own", *docs.columns])
    return [f"{taken}_{name}" for name in names]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told. Rows equal in all columns are decided alike (128 bits name them)."""
    _batched(spark)
    key = _free(docs, "low", "high")
    keyed = docs.select("*", F.xxhash64(*docs.columns).alias(key[0]), F.xxhash64(F.lit("row"), *docs.columns).alias(key[1]))
    # written first: Spark then knows the size, and broadcasts it only if it is small
    rejected, _ = written(identified(keyed, key, host=F.col("source")).where("not kept").select(*key).distinct(), "rejected")
    return keyed.join(rejected, key, "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five words, 0.8): that with the smallest doc_id.

    Rows count, not doc_ids: of rows with one doc_id and like texts one stays, with different texts
    each stays unless it copies another; a null doc_id comes after all others.
    """
    _batched(spark)
    row, group = _free(docs, "row", "group")
    numbered, _ = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_copies(numbered.select(F.col(row).alias("doc_id"), "text"), shingle=5, similarity=0.8).select(F.col("doc_id").alias(row), F.col("component_id").alias(group))
    # the first of a group is an aggregate: no join has a group as its key
    ranked = found.join(numbered.select(row, F.struct(F.col("doc_id").isNull(), "doc_id", row).alias("rank")), row)
    first = ranked.groupBy(group).agg(F.min("rank")[row].alias(row))
    copies, _ = written(found.select(row).join(first.select(row), row, "left_anti"), "copies")
    return numbered.join(copies, row, "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    _batched(spark)
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that disclose it."""
    _batched(spark)
    return redacted(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding gives its text back."""
    import public_tokenizers

    _batched(spark)
    return piece_ids(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("private", private),
    ("tokenized", tokenized),
]

#: Stages that SQL can't express; tests/llm/test_pipeline.py tests them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
