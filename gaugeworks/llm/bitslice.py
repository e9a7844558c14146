"""Hamming neighbours inside buckets, on bit planes stored vertically.

Row i of a plane is bit i of its packed words, so one exclusive-or of a plane with itself moved
by d compares every row with the row d places on, in all buckets together. Carry-save adders sum
the differing planes into vertical counters; once every counter is past the radius the rest of
the planes is left out. Buckets whose rows are all linked, or that hold no d-th neighbour, leave.
"""

from __future__ import annotations

import numpy as np

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Bit planes [64 * W, words] of fingerprints [n, W]."""
    n, w = prints.shape
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, 8 * w), axis=1, bitorder="little")
    pad = -n % 64
    packed = np.packbits(np.pad(bits, ((0, pad), (0, 0))).T, axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")


def packed(flags: np.ndarray) -> np.ndarray:
    return np.packbits(np.pad(flags, (0, -len(flags) % 64)), bitorder="little").view("<u8")


def moved(planes: np.ndarray, d: int) -> np.ndarray:
    """Planes whose row i is row i + d; rows past the end are zero."""
    w, b = d >> 6, np.uint64(d & 63)
    out = np.zeros_like(planes)
    keep = planes[:, w:]
    out[:, : keep.shape[1]] = keep >> b
    if b:
        out[:, : keep.shape[1] - 1] |= keep[:, 1:] << (np.uint64(64) - b)
    return out


def add(total: list[np.ndarray], bits: np.ndarray) -> list[np.ndarray]:
    """Adds bits [planes, words] to vertical counters by full adders, three planes to two."""
    out, column, k = [], bits, 0
    while len(column) or k < len(total):
        x = np.concatenate((total[k][None], column)) if k < len(total) else column
        carries = []
        while len(x) > 1:
            g = len(x) // 3
            if g:
                a, b, c = x[: 3 * g : 3], x[1 : 3 * g : 3], x[2 : 3 * g : 3]
                half = a ^ b
                carries.append((a & b) | (c & half))
                x = np.concatenate((half ^ c, x[3 * g :]))
            else:
                carries.append((x[0] & x[1])[None])
                x = (x[0] ^ x[1])[None]
        out.append(x[0])
        column = np.concatenate(carries) if carries else x[:0]
        k += 1
    return out


def above(total: list[np.ndarray], radius: int) -> np.ndarray:
    """Mask of counters over the radius."""
    if radius >> len(total):
        return np.zeros_like(total[0])
    more, same = np.zeros_like(total[0]), np.full_like(total[0], ALL)
    for k in reversed(range(len(total))):
        if radius >> k & 1:
            same &= total[k]
        else:
            more |= same & total[k]
            same &= ~total[k]
    return more


def within(planes: np.ndarray, d: int, live: np.ndarray, radius: int, step: int) -> np.ndarray:
    """Packed mask of live rows that differ from the d-th row on in at most `radius` planes."""
    total: list[np.ndarray] = []
    over = ~live
    for k in range(0, len(planes), step):
        part = planes[k : k + step]
        total = add(total, part ^ moved(part, d))
        over |= above(total, radius)
        if (over == ALL).all():
            break
    return ~over


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j; a label is the smallest row of its set, roots point to themselves."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label[:] = jump


def linked(bucket: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by bucket: the smallest row that links lead to inside the bucket."""
    n = len(bucket)
    label = np.arange(n)
    step = 16 if prints.shape[1] == 1 else 64
    rows = np.arange(n)
    d = 1
    planes = None
    while len(rows) > d:
        if planes is None or d & (d - 1) == 0:  # at powers of two: leave buckets that are through
            edge = np.flatnonzero(np.concatenate(([True], bucket[rows][1:] != bucket[rows][:-1])))
            size = np.diff(np.append(edge, len(rows)))
            one = np.minimum.reduceat(label[rows], edge) == np.maximum.reduceat(label[rows], edge)
            keep = np.repeat((size > d) & ~one, size)
            if not keep.all() or planes is None:
                rows = rows[keep]
                if len(rows) <= d:
                    break
                planes = planes_of(prints[rows])
        same = np.zeros(len(rows), bool)
        same[: len(rows) - d] = bucket[rows[d:]] == bucket[rows[:-d]]
        if same.any():
            near = np.unpackbits(within(planes, d, packed(same), radius, step).view(np.uint8), bitorder="little")[: len(rows)]
            at = np.flatnonzero(near)
            if len(at):
                merged(label, rows[at], rows[at + d])
        d += 1
    return label
