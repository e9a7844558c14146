"""Operator 9: toxicity by a bidirectional gated recurrent network with attention pooling.

Inputs are words and their characters: hashed word and byte-trigram embeddings, each with one
fixed coordinate, the log odds of the word or trigram in the training rows. The network reads
overlapping windows of `WINDOW` words, attention pools its states, and a text's score is that
of its worst window. Training (numpy, on the driver) takes about `MAX_ROWS` labelled rows of each
class by a hash of doc_id, whole texts of any length; a text's gradient comes from its worst window.
Only the ids of the sample are broadcast (2 * `MAX_ROWS` on average; more than twice that raises).

Scoring covers all windows of every whole text. Nulls: a null or empty text, or one without
words, has the score of an empty window. Labels that are null are not learned from, nor is a
doc_id with both labels; of rows with one doc_id the first text in order is learned from (so rows
of one doc_id, however many, stay within the bound) and each gets a score, equal texts equal
scores; without labelled rows of both classes all scores are 0. Extra columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop, written
from .arrow_text import ascii_words, ranges, starts_of, text_slices, texts_of, utf8_views

MAX_ROWS = 1500
WINDOW, STRIDE = 24, 12
HIDDEN, WIDTH = 8, 8
BUCKETS = 1 << 14
EPOCHS, BATCH, RATE = 12, 64, 0.02


# -- inputs -----------------------------------------------------------------


#: 1: ASCII letters and bytes of other characters; 2: ASCII digits; 0: marks, white space and control.
KIND = np.array([1 if b >= 128 or chr(b).isalpha() else 2 if chr(b).isdigit() else 0 for b in range(256)], np.uint8)


def plain(texts: pa.Array) -> pa.Array:
    """Lower-cased texts with spaces for marks, each text by itself.

    Marks between digits and apostrophes inside a word stay.
    """
    offsets, data = utf8_views(pc.utf8_lower(texts))
    low = int(offsets[0])
    data, offsets = data[low : int(offsets[-1])].copy(), offsets - low
    if not len(data):
        return texts
    kind = KIND[data]
    high = np.flatnonzero((data[:-1] == 0xE2) & (data[1:] == 0x80))
    high = high[(data[np.minimum(high + 2, len(data) - 1)] >= 0x90)]  # dashes, quotes, bullets, dots
    tick = np.isin(data[high + 2], (0x98, 0x99))
    latin = np.flatnonzero((data[:-1] == 0xC2) & np.isin(data[1:], (0xA1, 0xAB, 0xBB, 0xBF)))
    for k in range(3):
        kind[high + k] = 0
    kind[latin] = kind[latin + 1] = 0
    before, after = np.zeros(len(data) + 1, np.uint8), np.zeros(len(data) + 3, np.uint8)
    before[1:], after[: len(data)] = kind, kind
    edge = offsets[(offsets > 0) & (offsets < len(data))]

    def kinds(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Kinds of the bytes around, 0 beyond the text."""
        return np.where(np.isin(first, edge), 0, before[first]), np.where(np.isin(first + size, edge), 0, after[first + size])

    keep = kind > 0
    marks = np.flatnonzero((kind == 0) & (data > 32) & (data < 127))
    left, right = kinds(marks, 1)
    inside = np.where(data[marks] == 39, (left > 0) & (right > 0), (left == 2) & (right == 2))
    keep[marks[inside]] = True
    left, right = kinds(high[tick], 3)
    inner = high[tick][(left > 0) & (right > 0)]
    for k in range(3):
        keep[inner + k] = True
    data[~keep] = 32
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data))


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-cased words without their marks, dictionary-coded, and their number by text."""
    words, counts = ascii_words(plain(texts))
    return words.cast(pa.large_string()).dictionary_encode(), counts


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word; buckets of its byte trigrams (ends marked), and their number by word."""
    offsets, data = utf8_views(words)
    low = int(offsets[0])
    size = np.diff(offsets)
    at = starts_of(size + 2)
    framed = np.full(int(at[-1]), 1, np.uint64)
    framed[at[1:] - 1] = 2
    framed[ranges(at[:-1] + 1, size)] = data[low : low + int(size.sum())]
    place = np.arange(len(framed)) - np.repeat(at[:-1], size + 2)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(size.max()) + 2 if len(size) else 1, 0x9E3779B97F4A7C15, np.uint64))
        whole = np.add.reduceat(framed * powers[place], at[:-1]) if len(size) else np.zeros(0, np.uint64)
        word = (whole ^ (whole >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(50)
        tri = ((framed[:-2] << np.uint64(16)) | (framed[1:-1] << np.uint64(8)) | framed[2:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(50)
    grams = size.copy()  # a framed word of n + 2 bytes has n trigrams
    return word.astype(np.int64), tri[ranges(at[:-1], grams)].astype(np.int64), grams


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every overlapping window, and their number by text (one if it is short or empty)."""
    n = 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE))
    k = ranges(np.zeros(len(n), np.int64), n)
    text = np.repeat(np.arange(len(n)), n)
    start = starts_of(counts)[:-1][text] + k * STRIDE
    return start, np.minimum(WINDOW, counts[text] - k * STRIDE), n


# -- the network ------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fresh(rng: np.random.Generator, word_odds: np.ndarray, gram_odds: np.ndarray) -> dict[str, np.ndarray]:
    d, h = 2 * WIDTH, HIDDEN
    p = {"word": rng.normal(0, 0.1, (BUCKETS, WIDTH)), "gram": rng.normal(0, 0.1, (BUCKETS, WIDTH))}
    p["word"][:, 0], p["gram"][:, 0] = word_odds, gram_odds
    for side in "fb":
        p |= {f"W{side}": rng.normal(0, d**-0.5, (d, 3 * h)), f"U{side}": rng.normal(0, h**-0.5, (h, 3 * h)), f"c{side}": np.zeros(3 * h)}
    p |= {"A": rng.normal(0, (2 * h) ** -0.5, (2 * h, h)), "v": rng.normal(0, h**-0.5, h), "w": rng.normal(0, (2 * h) ** -0.5, 2 * h), "b": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def embedded(p: dict, word: np.ndarray, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Input vectors of distinct words: word embedding beside the mean of the trigrams'."""
    mean = np.zeros((len(word), WIDTH), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        mean[some] = np.add.reduceat(p["gram"][grams], starts_of(n)[some]) / n[some, None]
    return np.concatenate((p["word"][word], mean), axis=1)


def run(p: dict, side: str, inputs: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool):
    """States [T, B, H] of one direction. inputs: projected vectors of distinct words; index [T, B]."""
    steps, rows = index.shape
    h = np.zeros((rows, HIDDEN), np.float32)
    states, kept = np.empty((steps, rows, HIDDEN), np.float32), []
    order = range(steps) if side == "f" else range(steps - 1, -1, -1)
    u = p[f"U{side}"]
    for t in order:
        x, g = inputs[index[t]], h @ u
        zr = sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        m = mask[t][:, None]
        if keep:
            kept.append((t, h, z, r, n, g[:, 2 * HIDDEN :], m))
        h = new * m + h * (1 - m)
        states[t] = h
    return states, kept


def forward(p: dict, vectors: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows; index and mask are [T, B]."""
    f, kf = run(p, "f", vectors @ p["Wf"] + p["cf"], index, mask, keep)
    b, kb = run(p, "b", vectors @ p["Wb"] + p["cb"], index, mask, keep)
    s = np.concatenate((f, b), axis=2)
    hidden = np.tanh(s @ p["A"])
    e = hidden @ p["v"] + (mask - 1) * 1e4
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", a, s)
    return pooled @ p["w"] + p["b"][0], (s, hidden, a, pooled, kf, kb)


def gradients(p: dict, feats, index: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    word, grams, n = feats
    vectors = embedded(p, word, grams, n)
    logit, (s, hidden, a, pooled, kf, kb) = forward(p, vectors, index, mask, keep=True)
    d = ((sigmoid(logit) - target) * weight / weight.sum()).astype(np.float32)
    g = {"w": pooled.T @ d, "b": np.array([d.sum()], np.float32)}
    dpool = d[:, None] * p["w"]
    da = np.einsum("bh,tbh->tb", dpool, s)
    de = a * (da - (a * da).sum(axis=0))
    g["v"] = np.einsum("tb,tbh->h", de, hidden)
    dh = de[:, :, None] * p["v"] * (1 - hidden**2)
    g["A"] = np.einsum("tbi,tbj->ij", s, dh)
    ds = a[:, :, None] * dpool + dh @ p["A"].T
    dvec = np.zeros_like(vectors)
    for side, kept, part in (("f", kf, ds[:, :, :HIDDEN]), ("b", kb, ds[:, :, HIDDEN:])):
        u, dproj = p[f"U{side}"], np.zeros((len(vectors), 3 * HIDDEN), np.float32)
        du, back = np.zeros_like(u), np.zeros((index.shape[1], HIDDEN), np.float32)
        for t, h, z, r, nn, gn, m in reversed(kept):
            dnew = (part[t] + back) * m
            keep = (part[t] + back) * (1 - m)
            dn = dnew * (1 - z) * (1 - nn**2)
            dz = dnew * (h - nn) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dg = np.concatenate((dz, dr, dn * r), axis=1)
            du += h.T @ dg
            np.add.at(dproj, index[t], np.concatenate((dz, dr, dn), axis=1))
            back = keep + dnew * z + dg @ u.T
        g[f"U{side}"], g[f"W{side}"], g[f"c{side}"] = du, vectors.T @ dproj, dproj.sum(axis=0)
        dvec += dproj @ p[f"W{side}"].T
    g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
    np.add.at(g["word"], word, dvec[:, :WIDTH])
    np.add.at(g["gram"], grams, np.repeat(dvec[:, WIDTH:] / np.maximum(n, 1)[:, None], n, axis=0))
    g["word"][:, 0] = g["gram"][:, 0] = 0  # the log odds stay
    return g


def window_logits(p: dict, vectors: np.ndarray, codes: np.ndarray, start: np.ndarray, length: np.ndarray, block: int = 8192) -> np.ndarray:
    """Logits of all windows, a block at a time; the word after the last stands for nothing."""
    out = np.empty(len(start), np.float32)
    padded = np.concatenate((codes, np.zeros(WINDOW, np.int64)))
    step = np.arange(WINDOW)[:, None]
    for k in range(0, len(start), block):
        mask = (step < length[k : k + block]).astype(np.float32)
        out[k : k + block] = forward(p, vectors, padded[start[k : k + block] + step], mask)[0]
    return out


# -- training and scoring ---------------------------------------------------


def log_odds(buckets: np.ndarray, row: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Smoothed log odds of a bucket's presence in rows of label 1 and 0."""
    pairs = np.unique(row * BUCKETS + buckets)
    seen = [np.bincount(pairs[target[pairs // BUCKETS] == k] % BUCKETS, minlength=BUCKETS) for k in (0, 1)]
    total = [max(1, int((target == k).sum())) for k in (0, 1)]
    return np.log((seen[1] + 0.5) / (total[1] + 1)) - np.log((seen[0] + 0.5) / (total[0] + 1))


def train(texts: list[str], target: np.ndarray, prior: float, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    coded, counts = words_of(pa.array(texts, pa.string()))
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    feats = word_features(coded.dictionary)
    word, grams, n = feats
    row = np.repeat(np.arange(len(texts)), counts)
    gram_at = starts_of(n)[:-1]
    # odds ask for presence alone, so each word of a text counts once
    seen_row, seen = np.divmod(np.unique(row * max(1, len(word)) + codes), max(1, len(word)))
    p = fresh(rng, log_odds(word[seen], seen_row, target), log_odds(grams[ranges(gram_at[seen], n[seen])], np.repeat(seen_row, n[seen]), target))
    start, length, many = windows_of(counts)
    first = starts_of(many)
    padded = np.concatenate((codes, np.zeros(WINDOW, np.int64)))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    balance = np.where(target == 1, 1.0, (target == 1).sum() / max(1, (target == 0).sum())).astype(np.float32)
    odds = p["word"][word, 0][codes] if len(codes) else np.zeros(0)
    peak = np.array([odds[a : a + b].max() if b else -9 for a, b in zip(start, length)])
    tick = 0
    for epoch in range(EPOCHS):
        rank = peak if epoch < 2 else window_logits(p, embedded(p, *feats), codes, start, length)
        worst = np.array([a + int(np.argmax(rank[a:b])) for a, b in zip(first[:-1], first[1:])])
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            clean = rows[target[rows] == 0]  # clean texts also show a window at random
            chosen = np.concatenate((worst[rows], first[:-1][clean] + (rng.random(len(clean)) * many[clean]).astype(int)))
            label, weight = np.concatenate((target[rows], np.zeros(len(clean), int))), np.concatenate((balance[rows], 0.3 * balance[clean]))
            step = np.arange(WINDOW)[:, None]
            used, index = np.unique(padded[start[chosen] + step], return_inverse=True)
            mine = (word[used], grams[ranges(gram_at[used], n[used])], n[used])
            g = gradients(p, mine, index.reshape(WINDOW, -1), (step < length[chosen]).astype(np.float32), label, weight)
            norm = float(np.sqrt(sum((x**2).sum() for x in g.values())))
            tick += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**tick) / (1 - 0.9**tick)
            for key, x in g.items():
                x = x * min(1.0, 1.0 / (norm + 1e-9))
                m, v = moment[key]
                m += 0.1 * (x - m)
                v += 0.001 * (x * x - v)
                p[key] -= (rate * m / (np.sqrt(v) + 1e-6)).astype(np.float32)
    p["b"] += np.float32(np.log(prior / (1 - prior)) * 0.25)  # the batches were balanced; clean texts are the rule
    return p


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS):
    """About max_rows rows of each class with crc32(doc_id) mod 5 not 0, by a hash of doc_id; and the share of label 1."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("crc32(cast(doc_id as string)) % 5 <> 0")
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    cut = F.when(F.col("toxic") == 1, F.lit(max_rows / sizes[1])).otherwise(F.lit(max_rows / sizes[0]))
    some, path = written(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < cut * 1_000_000), "sample")
    if some.count() > 4 * max_rows:
        raise RuntimeError("the sample of labelled rows is over its bound")
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")).toPandas().sort_values("doc_id")
    drop(docs.sparkSession, path)
    if rows["toxic"].nunique() < 2:
        return None
    return rows["text"].tolist(), rows["toxic"].to_numpy(np.int64), sizes[1] / (sizes[0] + sizes[1])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_windows) of every document."""
    rows = training_rows(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast(train(*rows) if rows else None)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model.value
        for part in text_slices(batches):
            coded, counts = words_of(texts_of(part))
            start, length, many = windows_of(counts)
            if p is None:
                worst = np.full(len(counts), -np.inf)
            else:
                feats = word_features(coded.dictionary)
                vectors = embedded(p, *feats) if len(coded.dictionary) else np.zeros((1, 2 * WIDTH), np.float32)
                logits = window_logits(p, vectors, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), start, length)
                worst = np.maximum.reduceat(logits, starts_of(many)[:-1])
            value = np.where(np.isneginf(worst), 0.0, sigmoid(worst.astype(np.float64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(value), pa.array(many)], ["doc_id", "score", "n_windows"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, score double, n_windows long")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows")
