"""Operator 5: quality rules, and the tokeniser's fertility by language.

Base rules count words, symbols, repeated lines and repeated three-word windows. The method's
figures come from a public vocabulary: characters of words per token, share of byte-fallback
tokens, and entropy of the token distribution relative to its most for that many tokens. Bands
per language and size class (power of two of tokens) are grouped statistics of all documents that
pass the base rules: the median and `WIDTH` times the quartile distance on either side, each no
narrower than a floor, so a corpus without spread does not reject by rounding. A class of fewer
than `ENOUGH` documents takes its language's band, and a language of fewer has none. A document
outside a band is not kept.

Nulls: a null text has no words (base_failed); a null language is a language of its own.
Repeated rows give a row each; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .arrow_text import ascii_words, starts_of, text_slices, texts_of, utf8_views
from .pieces import piece_model

SYMBOL = np.zeros(256, np.int64)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
MIN_WORDS = 50
WIDTH = 3.0
ENOUGH = 100
#: Least half-width of a band: characters per token, byte share, relative entropy.
FLOORS = {"chars_per_token": 0.1, "byte_share": 0.02, "token_entropy": 0.05}


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = starts_of(values)
    return total[at[1:]] - total[at[:-1]]


def repeated_words(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text: words inside three-word windows that its words hold twice or more."""
    n, at = len(codes), starts_of(counts)
    covered = np.zeros(n, bool)
    if n >= 3:
        doc = np.repeat(np.arange(len(counts)), counts)
        place, most = np.flatnonzero(doc[2:] == doc[:-2]), int(codes.max()) + 1
        key = codes[:-2] * most + codes[1:-1]
        if most >= 1 << 21:  # three codes don't fit an integer
            _, key = np.unique(key, return_inverse=True)
        key = (key * most + codes[2:])[place]
        if most**3 * len(counts) < 1 << 63:  # the text fits into the key as well
            order = np.argsort(doc[place] * most**3 + key)
        else:
            order = np.argsort(key, kind="stable")  # equal windows stay in the order of their texts
        same = (key[order][1:] == key[order][:-1]) & (doc[place][order][1:] == doc[place][order][:-1])
        twice = np.zeros(len(place), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[place[twice] + k] = True
    return sums(covered, at)


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line."""
    split = pc.split_pattern(texts, "\n")
    lines, doc = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy(zero_copy_only=False).astype(np.int64)
    worded = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc, codes = doc[worded], codes[worded]
    distinct = np.unique(doc * (int(codes.max()) + 1) + codes) // (int(codes.max()) + 1) if len(codes) else doc
    return np.bincount(doc, minlength=len(texts)) - np.bincount(distinct, minlength=len(texts))


def token_entropy(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entropy in bits of each text's token distribution over the most for its number of tokens."""
    doc = np.repeat(np.arange(len(counts)), counts)
    key, n = np.unique(doc * 65536 + ids.astype(np.int64), return_counts=True)
    total = counts[key >> 16]
    bits = np.bincount(key >> 16, -(n / total) * np.log2(n / total), len(counts))
    return bits / np.log2(np.maximum(counts, 2))


def figures(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_tokens,
    chars_per_token, byte_share, token_entropy) of every whole text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_file)
        for part in text_slices(batches):
            texts = texts_of(part)
            words, n_words = ascii_words(texts)
            at = starts_of(n_words)
            chars = sums(pc.utf8_length(words).to_numpy(zero_copy_only=False), at)
            offsets, data = utf8_views(texts)
            symbols = sums(SYMBOL[data[int(offsets[0]) : int(offsets[-1])]], offsets - offsets[0])
            codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            ids, n_tokens = model.encode(texts)
            some = np.maximum(n_tokens, 1)
            bytes_ = sums(model.is_byte[ids] & (ids != model.byte[10]), starts_of(n_tokens))
            columns = {
                "doc_id": part.column("doc_id"),
                "lang": part.column("lang"),
                "n_words": n_words,
                "word_chars": chars,
                "n_symbols": symbols,
                "n_dup_lines": repeated_lines(texts),
                "n_repeat_words": repeated_words(codes, n_words),
                "n_tokens": n_tokens,
                "chars_per_token": chars / some,
                "byte_share": bytes_ / some,
                "token_entropy": token_entropy(ids, n_tokens),
            }
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))

    schema = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(measure, schema)


def bands(measured: DataFrame, by: list[str]) -> DataFrame:
    """Per group: low and high of each figure, over documents that pass the base rules."""
    stats = measured.where("not base_failed").groupBy(*by).agg(F.count("*").alias("n"), *[F.percentile_approx(c, [0.25, 0.5, 0.75], 10000).alias(c) for c in FLOORS]).where(F.col("n") >= ENOUGH)
    out = []
    for c, floor in FLOORS.items():
        half = F.greatest(F.lit(WIDTH) * (F.col(c)[2] - F.col(c)[0]), F.lit(floor))
        out.append(F.struct((F.col(c)[1] - half).alias("low"), (F.col(c)[1] + half).alias("high")).alias(c))
    return stats.select(*[F.col(k).alias(f"by_{k}") for k in by], F.struct(*out).alias(f"bands{len(by)}"))


def quality(docs: DataFrame, model_file: str) -> DataFrame:
    """Figures of every document, base_failed, and kept: inside all bands of its language.

    The bands have a row per language and size class; Spark broadcasts them if it finds them small.
    """
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured, _ = written(figures(docs, model_file).withColumn("base_failed", base).withColumn("size", F.floor(F.log2(F.greatest("n_tokens", F.lit(1))))), "figures")
    fine, coarse = bands(measured, ["lang", "size"]), bands(measured, ["lang"])
    joined = measured.join(fine, F.col("lang").eqNullSafe(F.col("by_lang")) & (F.col("size") == F.col("by_size")), "left").drop("by_lang", "by_size")
    joined = joined.join(coarse, F.col("lang").eqNullSafe(F.col("by_lang")), "left").withColumn("band", F.coalesce("bands2", "bands1"))
    inside = F.lit(True)
    for c in FLOORS:
        inside = inside & F.coalesce(F.col(c).between(F.col("band")[c]["low"], F.col("band")[c]["high"]), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *FLOORS)
