"""The numbered operators applied to their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, its texts sent to Python in batches of bounded size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .huffman import huffman_roundtrip

    return huffman_roundtrip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op2_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import section_tokens

    return section_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), width=400, rule="majority")


def op3_simhash_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .simhash import near_copies

    found = near_copies(_table(spark, sf_dir, "documents"), shingle=3, similarity=None, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("prints")[0])), 16, "0").alias("fingerprint"), "component_id")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (their source stands for a host) and the main text of all pages (with page_id, and doc_id -1 - page_id)."""
    from pyspark.sql import functions as F

    from .html_text import extract_pages
    from .language import host_of, identified, markup_of

    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang", F.col("source").alias("host"))
    pages = extract_pages(_table(spark, sf_dir, "pages").withColumn("declared", markup_of(F.col("html"))), also=("declared",))
    rows = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", "host", markup_of(F.col("text")).alias("declared"))
    rows = rows.unionByName(pages.select((-1 - F.col("page_id")).alias("doc_id"), "page_id", "text", host_of(F.col("url")).alias("host"), "declared"))
    return identified(rows, ["doc_id", "page_id"], host=F.col("host"), markup=F.col("declared"), labelled=docs.select("doc_id", "text", "lang"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_suffix_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_array import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op5_fertility_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .quality import quality

    return quality(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import piece_ids

    return piece_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_lookup_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lookup_sketch import fingerprints

    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th row is an anchor; every seventh row's label is first moved on by one."""
    from pyspark.sql import functions as F

    from .hard_negatives import hard_negatives
    from .vectors import integer_vectors

    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = integer_vectors(table.where("vec_id is not null and label is not null")).withColumn("label", label)
    return hard_negatives(rows, rows.where("vec_id % 50 = 0"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_huffman_ids,
        op2_section_tokens,
        op3_simhash_near_copies,
        op4_html_main_text,
        op5_fertility_quality,
        op6_sentencepiece,
        op7_personal_data,
        op8_language_id,
        op9_toxicity,
        op10_suffix_contamination,
        op11_lookup_sketches,
        op12_jacobi_whitening,
        op13_hard_negatives,
    )
}
ORACLE_SQL: dict[str, str] = {}
