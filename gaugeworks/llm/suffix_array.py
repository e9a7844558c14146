"""Operator 10: benchmark decontamination by suffix arrays over the training text.

Words are numbered by the benchmark's vocabulary (other words and ends of texts are 0). A shard
is a slice of the documents; its suffix array holds the suffixes that can hold the shortest
window. Every test suffix is binary-searched in every shard: first by its window (ten consecutive
item words, or a whole shorter item), whose range gives the places of all verbatim windows, then
deeper, a few words at a time, to its place among them. Suffixes of the shard that no window meets
are ordered by ten words only, the others to the length of the longest item. The two test suffixes
beside a training suffix in that order share the most words with it, so its longest match and the
item are exact. Documents are hit where a window occurs.

The benchmark is a stated query set: blocks of `BLOCK_BYTES` of it are sent to the executors one
after another, and what one block found is written before the next, so what the driver, a
broadcast and a Python worker hold has a fixed bound however large it grows. Nulls: a null text
has no words; items without words or without an item_id have no window. Repeated items count
once by item_id; repeated documents are rows of their own. Very long texts are slices of their
own. Ties of longest matches go to the first place in the text. No rows of one table leave the other's rows as they are, unhit. `contamination` reads no
other columns; `clean_documents` keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop, written
from .arrow_text import ascii_words, ranges, starts_of, text_slices, texts_of, utf8_views

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: A-Z to a-z; 0-9, a-z and bytes of other characters stay; the rest of ASCII parts words.
FOLD = np.array([b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)], np.uint8)
FOLD[65:91] += 32


def folded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of texts with A-Z lower-cased, and their number by text."""
    offsets, data = utf8_views(texts)
    first = int(offsets[0])
    data = np.ascontiguousarray(FOLD[data[first : int(offsets[-1])]])
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets - first)), pa.py_buffer(data))
    return ascii_words(plain)


class Words:
    """Word numbers with a 0 after each text, read as suffixes that end at the next 0."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, bits: int):
        self.begin = starts_of(counts)[:-1] + np.arange(len(counts))
        self.codes = np.zeros(len(codes) + len(counts), np.int64)
        self.codes[ranges(self.begin, counts)] = codes
        zeros = np.flatnonzero(self.codes == 0)
        self.end = zeros[np.searchsorted(zeros, np.arange(len(self.codes)))] if len(zeros) else np.zeros(0, np.int64)
        self.bits, self.each = bits, 63 // bits

    def key(self, places: np.ndarray, depth: int, words: int) -> np.ndarray:
        """`words` words from `depth` on as one integer whose order is that of the words; 0 past the end."""
        out, end = np.zeros(len(places), np.int64), self.end[places]
        for at in range(depth, depth + words):
            place = places + at
            out = (out << self.bits) | np.where(place < end, self.codes[np.minimum(place, len(self.codes) - 1)], 0)
        return out

    def first_keys(self, places: np.ndarray) -> list[np.ndarray]:
        return [self.key(places, d, min(self.each, WINDOW - d)) for d in range(0, WINDOW, self.each)]

    def refined(self, places: np.ndarray, start: np.ndarray, depth: int, most: int) -> np.ndarray:
        """places, in order by `depth` words (start marks a first of equals), in order by `most` words."""
        places, start = places.copy(), start.copy()
        while depth < most:
            group = np.cumsum(start) - 1
            live = np.flatnonzero(np.bincount(group)[group] > 1)
            if not len(live):
                break
            key = self.key(places[live], depth, self.each)
            order = np.lexsort((key, group[live]))
            places[live], key = places[live][order], key[order]
            start[live[1:]] |= key[1:] != key[:-1]
            depth += self.each
        return places

    def shared(self, places: np.ndarray, other: Words, others: np.ndarray, length: int) -> np.ndarray:
        """Words that suffixes share with suffixes of another text, `length` of them being known."""
        out = np.full(len(places), length, np.int64)
        live = np.arange(len(places))
        while len(live):
            a, b = places[live] + out[live], others[live] + out[live]
            more = (a < self.end[places[live]]) & (b < other.end[others[live]])
            live, a, b = live[more], a[more], b[more]
            live = live[self.codes[a] == other.codes[b]]
            out[live] += 1
        return out


class Windows:
    """The distinct windows of a block of items, the items of each, and all test suffixes in order."""

    def __init__(self, item_ids: list[str], texts: list[str]):
        words, counts = folded_words(pa.array(texts, pa.string()))
        coded = words.cast(pa.string()).dictionary_encode()
        self.vocabulary = coded.dictionary
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.text = Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, counts, self.bits)
        self.names = np.array(item_ids, dtype=object)
        self.most = int(counts.max()) if len(counts) else 0
        size = np.minimum(counts, WINDOW)
        n = np.where(counts > 0, counts - size + 1, 0)
        item, place = np.repeat(np.arange(len(texts)), n), ranges(self.text.begin, n)
        keys = self.text.first_keys(place)
        order = np.lexsort((np.argsort(np.argsort(self.names))[item], *keys[::-1])) if len(item) else np.zeros(0, np.int64)
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        self.first_suffix = np.append(np.flatnonzero(new), len(order))  # by window
        window_of = np.cumsum(new) - 1
        heads = place[order][new]
        self.length = np.minimum(self.text.end[heads] - heads, WINDOW)
        self.low = [k[order][new] for k in keys]
        fill = [(1 << self.bits) - 1] * WINDOW  # above all that begin with a shorter window
        self.high = []
        for part, d in zip(self.low, range(0, WINDOW, self.text.each)):
            wide, top = min(self.text.each, WINDOW - d), np.zeros(len(heads), np.int64)
            for at in range(d, d + wide):
                top = (top << self.bits) | np.where(self.length > at, 0, fill[at])
            self.high.append(part | top)
        pairs = np.unique(np.stack((window_of, item[order]), axis=1), axis=0) if len(order) else np.zeros((0, 2), np.int64)
        self.items, self.first = self.names[pairs[:, 1]], np.searchsorted(pairs[:, 0], np.arange(len(heads) + 1))
        self.suffix = self.text.refined(place[order], new, WINDOW, self.most)
        self.suffix_item = np.searchsorted(self.text.begin, self.suffix, side="right") - 1


def suffix_array(text: Words, windows: Windows) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the suffixes that can hold the shortest window, in order of ten words, and their keys."""
    places = np.flatnonzero(text.end - np.arange(len(text.codes)) >= int(windows.length.min()))
    keys = text.first_keys(places)
    order = np.lexsort(keys[::-1])
    return places[order], [k[order] for k in keys]


def bounds(keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
    """Binary search of all wanted windows at once: the first place not before (or after) each."""
    low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(keys[0]), np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) // 2
        probe = np.minimum(mid, len(keys[0]) - 1)
        less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for key, want in zip(keys, wanted):
            have = key[probe]
            less |= same & (have < want)
            same &= have == want
        if after:
            less |= same
        low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)


def inserted(text: Words, places: np.ndarray, windows: Windows, suffix: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where each test suffix belongs among places[low:high], which share its window."""
    low, high, depth = low.copy(), high.copy(), WINDOW
    live = np.flatnonzero(low < high)
    while len(live) and depth < windows.most:
        want = windows.text.key(suffix[live], depth, text.each)
        edges = []
        for after in (False, True):
            a, b = low[live].copy(), high[live].copy()
            while (open_ := a < b).any():
                mid = np.minimum((a + b) // 2, len(places) - 1)
                have = text.key(places[mid], depth, text.each)
                less = have <= want if after else have < want
                a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
            edges.append(a)
        low[live], high[live] = edges
        live = live[(edges[0] < edges[1]) & (want > 0)]
        depth += text.each
    return low


class Matches:
    """All (place, window) of verbatim windows in a text, and the longest match of each place."""

    def __init__(self, text: Words, windows: Windows, longest: bool = True):
        none = np.zeros(0, np.int64)
        self.place, self.window, self.at, self.length, self.item = none, none, none, none, none
        if not len(windows.length) or not len(text.codes):
            return
        places, keys = suffix_array(text, windows)
        if not len(places):
            return
        low, high = bounds(keys, windows.low, after=False), bounds(keys, windows.high, after=True)
        n = np.maximum(high - low, 0)
        self.window = np.repeat(np.arange(len(n)), n)
        rank = ranges(low, n)
        if longest:
            full = np.flatnonzero((windows.length == WINDOW) & (n > 0))
            # whole order where a window meets the text
            mine = ranges(low[full], n[full])
            start = np.zeros(len(mine), bool)
            start[starts_of(n[full])[:-1]] = True
            places[mine] = text.refined(places[mine], start, WINDOW, windows.most)
            many = windows.first_suffix[full + 1] - windows.first_suffix[full]
            of = ranges(windows.first_suffix[full], many)
            where = inserted(text, places, windows, windows.suffix[of], np.repeat(low[full], many), np.repeat(high[full], many))
            first = np.repeat(starts_of(many)[:-1], n[full])
            last = np.repeat(starts_of(many)[1:], n[full])
            before = np.searchsorted(where, mine, side="right") - 1
            self.at, self.length, self.item = places[mine], np.zeros(len(mine), np.int64), np.zeros(len(mine), np.int64)
            for q in (before, before + 1):
                ok = np.flatnonzero((q >= first) & (q < last))
                suffix = of[q[ok]]
                length = text.shared(self.at[ok], windows.text, windows.suffix[suffix], WINDOW)
                better = length > self.length[ok]
                self.length[ok[better]], self.item[ok[better]] = length[better], windows.suffix_item[suffix[better]]
        self.place = places[rank]
        whole = windows.length[self.window] < WINDOW  # a whole short item is its own longest match
        if longest and whole.any():
            w = self.window[whole]
            self.at, self.length = np.concatenate((self.at, self.place[whole])), np.concatenate((self.length, windows.length[w]))
            self.item = np.concatenate((self.item, windows.suffix_item[windows.first_suffix[w]]))


def coded_text(part: pa.RecordBatch, windows: Windows) -> tuple[Words, np.ndarray]:
    """The words of a slice, numbered, and how many each text has."""
    words, counts = folded_words(texts_of(part))
    codes = pc.fill_null(pc.index_in(words, value_set=windows.vocabulary.cast(words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return Words(codes, counts, windows.bits), counts


def longest_of(found: Matches, text: Words, windows: Windows) -> dict[int, tuple[int, int, str]]:
    """By text: length, first word and item of its longest match."""
    doc = np.searchsorted(text.begin, found.at, side="right") - 1
    order = np.lexsort((found.at, -found.length, doc))
    doc = doc[order]
    head = order[np.concatenate(([True], doc[1:] != doc[:-1]))] if len(order) else order
    out = {}
    for k, d in zip(head.tolist(), np.searchsorted(text.begin, found.at[head], side="right") - 1):
        out[int(d)] = (int(found.length[k]), int(found.at[k] - text.begin[d]), windows.names[found.item[k]])
    return out


FOUND = "spans array<long>, items array<string>, longest_match long, longest_start long, longest_item string"


def block_pass(block: Broadcast, last: bool):
    """A pass of one block of the benchmark over the documents; the last one sums up."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(*block.value)
        for part in text_slices(batches):
            text, counts = coded_text(part, windows)
            found = Matches(text, windows)
            rows = part.num_rows
            held = part.column("spans").to_pylist()
            items = part.column("items").to_pylist()
            longest = list(zip(*(part.column(c).to_pylist() for c in ("longest_match", "longest_start", "longest_item"))))
            for d, new in longest_of(found, text, windows).items():
                if (-new[0], new[1]) < (-longest[d][0], longest[d][1] or 0):
                    longest[d] = new
            # words inside any window, of this block or one before
            edges = np.zeros(len(text.codes) + 1, np.int64)
            np.add.at(edges, found.place, 1)
            np.add.at(edges, found.place + windows.length[found.window], -1)
            for d in range(rows):
                if held[d]:
                    at = np.array(held[d], np.int64) + text.begin[d]
                    np.add.at(edges, at[::2], 1)
                    np.add.at(edges, at[1::2], -1)
            covered = np.cumsum(edges[:-1]) > 0
            doc = np.searchsorted(text.begin, found.place, side="right") - 1
            pairs = np.unique(doc * (len(windows.length) + 1) + found.window)
            doc, window = pairs // (len(windows.length) + 1), pairs % (len(windows.length) + 1)
            hit_docs, at = np.unique(doc, return_index=True)
            for d, w in zip(hit_docs.tolist(), np.split(window, at[1:])):
                items[d] = sorted({*items[d], *windows.items[ranges(windows.first[w], windows.first[w + 1] - windows.first[w])]})
            best = [pa.array([x[k] for x in longest], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
            if not last:
                change = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
                spans = [[] for _ in range(rows)]
                for a, b in zip(change[::2].tolist(), change[1::2].tolist()):
                    d = int(np.searchsorted(text.begin, a, side="right")) - 1
                    spans[d] += [a - int(text.begin[d]), b - int(text.begin[d])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), *best], ["doc_id", "text", "spans", "items", "longest_match", "longest_start", "longest_item"])
                continue
            total = starts_of(covered)
            hit = total[text.begin + counts] - total[text.begin]
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(hit), pa.array([len(x) for x in items], pa.int64()), pa.array(digest), pa.array(hit > 0), *best], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_start", "longest_item"])

    return search


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[Broadcast, bool]]:
    """The items as broadcast (ids, texts), one block of about block_bytes after another; and whether it is the last."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item_id")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    for k in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toPandas()
        yield spark.sparkContext.broadcast((some["item_id"].tolist(), some["text"].tolist())), k == blocks - 1


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, longest_start, longest_item.

    The last three are the longest verbatim match with any item: its words, its first word in the
    document (from 0; null without one), and an item that holds it.
    """
    nothing = [F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("longest_match"), F.lit(None).cast("long").alias("longest_start"), F.lit(None).cast("string").alias("longest_item")]
    df, path = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *nothing), None
    for block, last in benchmark_blocks(benchmark, block_bytes):
        df = df.mapInArrow(block_pass(block, last), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_start long, longest_item string" if last else f"doc_id long, text string, {FOUND}")
        if not last:
            df, new = written(df, "hits")
            block.unpersist()
            if path:
                drop(docs.sparkSession, path)
            path = new
    return df


def clean_documents(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with all their columns."""

    def dropping(block: Broadcast):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = Windows(*block.value)
            for part in text_slices(batches):
                text, counts = coded_text(part, windows)
                clean = np.ones(len(counts), bool)
                clean[np.searchsorted(text.begin, Matches(text, windows, longest=False).place, side="right") - 1] = False
                yield part.filter(pa.array(clean))

        return keep

    path = None
    for block, last in benchmark_blocks(benchmark, block_bytes):
        docs = docs.mapInArrow(dropping(block), docs.schema)
        if not last:
            docs, new = written(docs, "clean")
            block.unpersist()
            if path:
                drop(docs.sparkSession, path)
            path = new
    return docs
