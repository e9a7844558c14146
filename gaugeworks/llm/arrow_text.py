"""Small Arrow helpers that the text operators share inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time inside a task; one longer text makes a slice of its own.
SLICE_BYTES = 3 << 20


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that a slice holds about `most` bytes of `column` (or one text)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts, null as empty."""
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


def ascii_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of bytes other than \\x20 and \\x09-\\x0D, flat, and the words of each text."""
    split = pc.ascii_split_whitespace(texts)
    flat, parent = pc.list_flatten(split), pc.list_parent_indices(split)
    keep = pc.greater(pc.binary_length(flat), 0)
    flat = flat.filter(keep)
    parent = parent.filter(keep).to_numpy(zero_copy_only=False)
    return flat, np.bincount(parent, minlength=len(texts)).astype(np.int64)


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Exclusive prefix sums, with the total at the end."""
    return np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of every (start, length), one after another."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def utf8_views(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and the bytes of a string or binary array."""
    wide = array.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(wide) + 1, wide.offset * 8) if offsets else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def strings_of(array: pa.Array) -> list[str]:
    """The strings of an array as a list, without a scalar object for each."""
    return array.to_numpy(zero_copy_only=False).tolist()
