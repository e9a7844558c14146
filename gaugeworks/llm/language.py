"""Operator 8: language by Bayesian fusion of text and metadata evidence.

Text likelihoods are multinomial over hashed byte trigrams, fitted on at most about `MAX_ROWS`
labelled rows of each language; at most `TRUST` trigrams' worth of evidence counts, as neighbouring trigrams are
not independent. Declared mark-up language, address suffix and host come in as further evidence:

* P(declared | language) and P(suffix | language) are smoothed relative frequencies,
* P(language | host) is smoothed towards its domain, that towards the whole corpus,

all from one grouped aggregation each over the text's own best guesses on the whole corpus.
Documents are rejected ("und") whose text is less likely under the best language than under
trigrams drawn at random, or whose best language stays below `SURE`.

Values of evidence with over `HOT_ROWS` rows are joined by broadcast (there are at most rows /
HOT_ROWS of them), rows without one or with such a one don't take part in the join of the others.

Nulls: a null or blank text is rejected, as is one under three bytes whose other evidence does
not decide; null or empty hosts, addresses and declarations are no evidence.
Ties go to the language first in order. Repeated rows give a row each; very long texts are read
whole. Without labelled rows everything is rejected; no rows give none. Other columns are not
read, and keys may have any names that are not columns of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .arrow_text import starts_of, text_slices, texts_of, utf8_views

BUCKETS = 1 << 16
#: Labelled rows of one language that are learned from, about.
MAX_ROWS = 20_000
#: A language needs so many labelled rows.
LEAST = 10
TRUST = 100.0
#: Share of trigrams of any text that are no language's: numbers, keys, names.
STRAY = 0.1
SURE = 0.5
#: Pseudo-counts of smoothing: evidence of metadata, and each step from host to domain to corpus.
WEIGHT = 20.0
#: Rows of one host (suffix, declaration) from which its join is a broadcast.
HOT_ROWS = 1_000_000
SOURCES = ("host", "suffix", "markup")


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of lower-cased texts, and their number by text."""
    offsets, data = utf8_views(pc.utf8_lower(texts))
    low = int(offsets[0])
    data, offsets = data[low : int(offsets[-1])].astype(np.uint32), offsets - low
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    code = ((data[:-2] * np.uint32(0x9E3779B1) ^ data[1:-1] * np.uint32(0x85EBCA77) ^ data[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)).astype(np.int64)
    inside = np.ones(len(code), bool)
    for back in (1, 2):  # not over the end of a text
        at = offsets[1:] - back
        inside[at[(at >= 0) & (at < len(code))]] = False
    return code[inside], np.maximum(np.diff(offsets) - 2, 0)


def fitted(labelled: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log P(trigram | language) [BUCKETS, languages], and P(language).

    Counting is distributed; the driver gets at most a row per language and trigram bucket.
    """
    sizes = labelled.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).toPandas()
    languages = sorted(sizes["lang"])
    if not languages:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0)
    cuts = [x for lang, n in zip(sizes["lang"], sizes["n"]) for x in (F.lit(lang), F.lit(int(np.ceil(1_000_000 * min(1.0, max_rows / n)))))]
    cut = F.element_at(F.create_map(*cuts), F.col("lang").cast("string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for part in text_slices(batches):
            codes, n = trigrams(texts_of(part))
            which = np.array([languages.index(x) for x in part.column("lang").to_pylist()], np.int64)
            counts += np.bincount(np.repeat(which, n) * BUCKETS + codes, minlength=counts.size).reshape(counts.shape)
        which, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(bucket), pa.array(counts[which, bucket])], ["l", "b", "n"])

    some = labelled.where(F.col("lang").isin(languages)).where(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1_000_000)) < cut)
    found = some.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(count, "l long, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((BUCKETS, len(languages)), 0.1)
    counts[found["b"].to_numpy(np.int64), found["l"].to_numpy(np.int64)] += found["n"].to_numpy()
    share = sizes.set_index("lang")["n"].reindex(languages).to_numpy(float)
    return languages, np.log((1 - STRAY) * counts / counts.sum(axis=0) + STRAY / BUCKETS).astype(np.float32), share / share.sum()


def text_likelihoods(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """rows without text, with loglik array<double> of each language and n_trigrams."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    others = [c for c in rows.columns if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for part in text_slices(batches):
            codes, n = trigrams(texts_of(part))
            out = np.zeros((len(n), table.shape[1]))
            some = np.flatnonzero(n)
            if len(some):
                for k in range(table.shape[1]):
                    out[some, k] = np.add.reduceat(table[:, k][codes].astype(np.float64), starts_of(n)[some])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * table.shape[1]), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), lists, pa.array(n)], [*others, "loglik", "n_trigrams"])

    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in others) + ", loglik array<double>, n_trigrams long"
    return rows.select(*others, "text").mapInArrow(score, schema)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def markup_of(text: Column) -> Column:
    """Language that an html element in the text declares, or empty."""
    return F.lower(F.regexp_extract(text, r"<html[^>]*\slang=[\"']?([A-Za-z]{2,3})", 1))


def evidence(scored: DataFrame, column: str, languages: int) -> DataFrame:
    """log P(value | language) for the values of a column, one row each."""
    counts = scored.where(F.col(column) != "").groupBy(F.col(column).alias(f"{column}_value"), "guess").agg(F.count("*").alias("n"))
    wide = counts.groupBy(f"{column}_value").agg(*[F.sum(F.when(F.col("guess") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(languages)])
    totals = scored.where(F.col(column) != "").groupBy().agg(F.count("*").alias("all"), F.count_distinct(column).alias("values"), *[F.count_if(F.col("guess") == k).alias(f"t{k}") for k in range(languages)])
    # log of P(value | language) over P(value): smoothed towards no information
    spread = sum(F.col(f"n{k}") for k in range(languages)) / F.col("all")
    return wide.crossJoin(F.broadcast(totals)).select(F.col(f"{column}_value").alias("value"), F.array(*[F.log((F.col(f"n{k}") + WEIGHT * spread) / (F.col(f"t{k}") + WEIGHT)) - F.log(spread) for k in range(languages)]).alias("log"), sum(F.col(f"n{k}") for k in range(languages)).alias("n"))


def host_priors(scored: DataFrame, languages: int, share: np.ndarray) -> DataFrame:
    """log P(language | host) over P(language), smoothed from host to domain to corpus."""
    parts = F.split("host", r"\.")
    domain = F.when(F.size(parts) > 2, F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(F.col("host"))
    hosts = scored.where("host <> ''").groupBy("host").agg(*[F.count_if(F.col("guess") == k).alias(f"n{k}") for k in range(languages)]).withColumn("domain", domain)
    domains = hosts.groupBy("domain").agg(*[F.sum(f"n{k}").alias(f"d{k}") for k in range(languages)])
    n, d = sum(F.col(f"n{k}") for k in range(languages)), sum(F.col(f"d{k}") for k in range(languages))
    out = []
    for k in range(languages):
        whole = F.lit(float(share[k]))
        in_domain = (F.col(f"d{k}") + WEIGHT * whole) / (d + WEIGHT)
        out.append(F.log((F.col(f"n{k}") + WEIGHT * in_domain) / (n + WEIGHT)) - F.log(whole))
    return hosts.join(domains, "domain").select(F.col("host").alias("value"), F.array(*out).alias("log"), n.alias("n"))


def with_evidence(rows: DataFrame, known: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """rows with the log of (value, log, n) for their value of a column, as `{column}_log`; no value is a hot key."""
    known, _ = written(known, column)  # Spark then knows its size, and broadcasts it if it is small
    hot = known.where(F.col("n") > HOT_ROWS).select(F.col("value").alias("hot_value"), F.col("log").alias("hot_log"))
    cold = known.where(F.col("n") <= HOT_ROWS).select(F.col("value").alias("cold_value"), F.col("log").alias("cold_log"))
    rows = rows.join(F.broadcast(hot), F.col(column) == F.col("hot_value"), "left")
    apart = F.concat(F.lit("\0"), F.xxhash64(*keys, "loglik").cast("string"))  # no value
    rows = rows.withColumn("cold_key", F.when((F.col(column) == "") | F.col("hot_value").isNotNull(), apart).otherwise(F.col(column)))
    joined = rows.join(cold, F.col("cold_key") == F.col("cold_value"), "left")
    return joined.withColumn(f"{column}_log", F.coalesce("hot_log", "cold_log")).drop("hot_value", "hot_log", "cold_value", "cold_log", "cold_key")


def identified(docs: DataFrame, keys: list[str], text: str = "text", label: str = "lang", url: Column | None = None, markup: Column | None = None, host: Column | None = None, labelled: DataFrame | None = None, trained=None) -> DataFrame:
    """keys with language, confidence, text_language, kept and moved_by, a row for every row of docs.

    moved_by names the sources of evidence without which another language would be the best. labelled: (doc_id, text, lang) to fit on, docs itself if left out; trained: what `fitted` gave.
    """
    if labelled is None and trained is None:
        labelled = docs.select(F.col(keys[0]).alias("doc_id"), F.col(text).alias("text"), F.col(label).alias("lang"))
    languages, table, share = trained or fitted(labelled)
    none = F.lit("")
    host_col = F.coalesce(host if host is not None else host_of(url) if url is not None else none, none)
    suffix = F.when(host_col.contains("."), F.element_at(F.split(host_col, r"\."), -1)).otherwise(none)
    rows = docs.select(*keys, F.col(text).cast("string").alias("text"), host_col.alias("host"), suffix.alias("suffix"), F.coalesce(markup if markup is not None else markup_of(F.col(text)), none).alias("markup"), (F.length(F.trim(F.coalesce(F.col(text), none))) > 0).alias("written"))
    if not languages:
        return rows.select(*keys, F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_language"), F.lit(False).alias("kept"), F.lit("").alias("moved_by"))
    n = len(languages)
    scored, _ = written(text_likelihoods(rows, table), "likelihoods")
    tempered = F.transform("loglik", lambda x: x * F.least(F.lit(1.0), TRUST / F.greatest(F.col("n_trigrams"), F.lit(1))))
    prior = F.array(*[F.lit(float(np.log(x))) for x in share])
    sums = F.zip_with(tempered, prior, lambda a, b: a + b)
    scored = scored.withColumn("text_log", sums).withColumn("guess", F.array_position("text_log", F.array_max("text_log")).cast("int") - 1)
    fused = scored
    for column in SOURCES:
        fused = with_evidence(fused, host_priors(scored, n, share) if column == "host" else evidence(scored, column, n), column, keys)

    def fuse(sources: tuple[str, ...]) -> Column:
        out = F.col("text_log")
        for column in sources:
            out = F.zip_with(out, F.coalesce(f"{column}_log", F.array(*[F.lit(0.0)] * n)), lambda a, b: a + b)
        return out

    def first_best(log: Column) -> Column:
        return F.array_position(log, F.array_max(log)).cast("int")

    fused = fused.withColumn("log", fuse(SOURCES)).withColumn("top", F.array_max("log"))
    moved = F.concat_ws(",", *[F.when(F.col(f"{x}_log").isNotNull() & (first_best(fuse(tuple(y for y in SOURCES if y != x))) != first_best(F.col("log"))), x) for x in SOURCES])
    total = F.aggregate("log", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    best = first_best(F.col("log"))
    names = F.array(*[F.lit(x) for x in languages])
    likely = F.col("written") & ((F.col("n_trigrams") == 0) | (F.element_at("loglik", best) > F.col("n_trigrams") * float(-np.log(BUCKETS))))
    sure = 1 / total
    kept = likely & (sure >= SURE)
    return fused.select(*keys, F.when(kept, F.element_at(names, best)).otherwise("und").alias("language"), sure.alias("confidence"), F.element_at(names, F.col("guess") + 1).alias("text_language"), kept.alias("kept"), moved.alias("moved_by"))
