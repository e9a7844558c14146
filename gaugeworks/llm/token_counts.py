"""Operator 2: token counts of sections by offset-mapped attribution.

A document is encoded once, whole. Its tokens' character spans, in order, are interval-joined
with its sections, in order, by binary search. A token that crosses a boundary goes by `rule`:
"majority" (the section with most of its characters, the earlier on ties), "first", "last" or
"proportional" (each section its share of the characters).

Sections are non-overlapping, ascending (start, end) code points: a column of structs (others
raise), or passages: each line, cut every `width` code points. Characters outside all sections
belong to none, and tokens wholly outside count nowhere.

Nulls: a null text or a null list of sections gives no rows; an empty text gives one empty
passage. A section that is empty, or only white space, has 0 tokens and touches none. Very long
texts are encoded whole. Repeated rows give rows each; no rows give none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import ascii_words, ranges, starts_of, strings_of, text_slices, texts_of, utf8_views
from .word_tokens import WordEncoder, word_encoder

RULES = ("majority", "first", "last", "proportional")
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def token_spans(encoder: WordEncoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every token in code points of its text, and the tokens of each text."""
    words, per_text = ascii_words(texts)
    offsets, data = utf8_views(texts)
    data, offsets = data[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]
    blank = BLANK[data]
    head = ~blank
    head[1:] &= blank[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    head[edge] = ~blank[edge]
    points = starts_of((data & 0xC0) != 0x80)
    text_of = np.repeat(np.arange(len(per_text)), per_text)
    begin = points[np.flatnonzero(head)] - points[offsets[:-1]][text_of]
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    found = encoder._known(strings_of(coded.dictionary))
    flat = np.frombuffer(b"".join(x[1] for x in found), "<u4").astype(np.int64).reshape(-1, 2)
    size = np.fromiter((len(x[1]) for x in found), np.int64, len(found)) // 8
    lengths = size[codes]
    spans = flat[ranges(starts_of(size)[:-1][codes], lengths)]
    at = np.repeat(begin, lengths)
    tokens, words_at = starts_of(lengths), starts_of(per_text)
    return spans[:, 0] + at, spans[:, 1] + at, tokens[words_at[1:]] - tokens[words_at[:-1]]


def passages(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end in code points of each line's cuts of `width`, and their number by text."""
    lines = pc.split_pattern(texts, "\n")
    size = pc.utf8_length(pc.list_flatten(lines)).to_numpy(zero_copy_only=False).astype(np.int64)
    per_text = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    at = starts_of(per_text)
    begin = starts_of(size + 1)[:-1]
    begin = begin - np.repeat(begin[at[:-1]], per_text) if len(begin) else begin
    cuts = np.maximum(1, -(-size // width))
    k = ranges(np.zeros(len(cuts), np.int64), cuts)
    start = np.repeat(begin, cuts) + k * width
    end = np.minimum(start + width, np.repeat(begin + size, cuts))
    c = starts_of(cuts)
    return start, end, c[at[1:]] - c[at[:-1]]


def attributed(token_start: np.ndarray, token_end: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of the tokens it touches cross a boundary.

    All in one ascending coordinate; the join is two binary searches a token.
    """
    filled = np.flatnonzero(end > start)
    if len(filled) < len(start):  # what is empty takes nothing
        counts, crossing = np.zeros(len(start)), np.zeros(len(start), np.int64)
        if len(filled):
            counts[filled], crossing[filled] = attributed(token_start, token_end, start[filled], end[filled], rule)
        return counts, crossing
    first = np.searchsorted(end, token_start, side="right")  # the first section that ends after the token starts
    last = np.searchsorted(start, token_end, side="left") - 1  # the last that starts before it ends
    touched = last - first + 1
    single = touched == 1
    whole = single & (token_start >= start[np.minimum(first, len(start) - 1)]) & (token_end <= end[np.minimum(first, len(end) - 1)])
    counts = np.bincount(first[whole], minlength=len(start)).astype(float)
    crossing = np.zeros(len(start), np.int64)
    others = np.flatnonzero((touched > 0) & ~whole)
    n = touched[others]
    token, section = np.repeat(others, n), ranges(first[others], n)
    share = np.minimum(token_end[token], end[section]) - np.maximum(token_start[token], start[section])
    np.add.at(crossing, section, 1)
    if rule == "proportional":
        np.add.at(counts, section, share / (token_end - token_start)[token])
    elif len(token):
        rank = {"majority": -share, "first": section, "last": -section}[rule]
        order = np.lexsort((section, rank, token))
        chosen = order[np.concatenate(([True], token[order][1:] != token[order][:-1]))]
        np.add.at(counts, section[chosen], 1)
    return counts, crossing


def section_tokens(docs: DataFrame, tokenizer_file: str, width: int = 400, rule: str = "majority", sections: str | None = None) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing) of every section of every document.

    n_tokens is a long, or with the proportional rule a double.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_file, spans=True)
        for part in text_slices(batches):
            texts = texts_of(part)
            token_start, token_end, n_tokens = token_spans(encoder, texts)
            if sections is None:
                start, end, per_text = passages(texts, width)
            else:
                given = part.column("sections")
                flat = pc.list_flatten(given)
                start, end = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                per_text = pc.fill_null(pc.list_value_length(given), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                same = np.diff(np.repeat(np.arange(len(per_text)), per_text)) == 0
                if (end < start).any() or (start[1:] < end[:-1])[same].any():
                    raise ValueError("sections must be ascending and must not overlap")
            # one ascending coordinate over the slice: each text has its own stretch
            extent = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1, 1)
            if len(end):
                reach = np.zeros(len(extent), np.int64)
                np.maximum.at(reach, np.repeat(np.arange(len(per_text)), per_text), end)
                extent = np.maximum(extent, reach + 1)
            base = starts_of(extent)[:-1]
            of_token, of_section = np.repeat(base, n_tokens), np.repeat(base, per_text)
            counts, crossing = attributed(token_start + of_token, token_end + of_token, start + of_section, end + of_section, rule) if len(start) else (np.zeros(0), np.zeros(0, np.int64))
            doc = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(per_text)), per_text)))
            number = ranges(np.zeros(len(per_text), np.int64), per_text)
            yield pa.RecordBatch.from_arrays([doc, pa.array(number), pa.array(start), pa.array(end), pa.array(counts if rule == "proportional" else counts.astype(np.int64)), pa.array(crossing)], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    rows = docs.where("text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *([F.col(sections).cast("array<struct<start:long,end:long>>").alias("sections")] if sections else []))
    kind = "double" if rule == "proportional" else "long"
    return rows.mapInArrow(count, f"doc_id long, section long, start long, end long, n_tokens {kind}, n_crossing long")
