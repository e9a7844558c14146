"""Operator 1: token ids as canonical length-limited Huffman code.

Ids of all texts are counted once over the corpus; the counts give code lengths of at most
`MAX_BITS` (package-merge), and canonical codes follow from the lengths alone. A file row holds
a shard of consecutive documents in ascending doc_id order:

    "GWH1" | u32 documents | u64 ids | u32 ids a block | u32 blocks
    | u64 ids of each document | u64 bit offset of each block, and the end | bit stream

Blocks decode on their own from their bit offset, all blocks of a shard in step, by one look-up
in a table of 2^MAX_BITS entries an id.

Nulls and ties: a null text is empty (only the end id); a null doc_id comes first in the order;
rows of one doc_id are ordered by their ids. No rows give no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import drop, new_path, written
from .arrow_text import starts_of, text_slices, texts_of
from .word_tokens import word_encoder

MAX_BITS = 20
BLOCK = 512
#: Ids after which a shard is closed (at the end of a document).
SHARD = 1 << 20
HEAD = struct.Struct("<4sIQII")


# -- encoding texts ---------------------------------------------------------


def token_ids(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """(doc_id, ids binary of little-endian integers, n_tokens) of every whole text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_file)
        end = np.array([end_id], encoder.dtype).tobytes()
        for part in text_slices(batches):
            ids, counts = encoder.encode(texts_of(part))
            at = starts_of(counts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([ids[a:b].tobytes() + end for a, b in zip(at[:-1], at[1:])], pa.binary()), pa.array(counts + 1)], ["doc_id", "ids", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, ids binary, n_tokens long")


# -- codes ------------------------------------------------------------------


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `most` bits by package-merge; 0 for counts of 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 2:
        out[used] = 1
        return out
    if n > 1 << most:
        raise ValueError(f"{n} symbols don't fit codes of {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    packages, levels = np.zeros(0, np.int64), []
    for _ in range(most):
        both = np.concatenate((leaves, packages))
        at = np.argsort(both, kind="stable")
        levels.append(np.cumsum(at < n))
        both = both[at]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, length = 2 * n - 2, np.zeros(n, np.int64)
    for seen in reversed(levels):
        single = int(seen[take - 1]) if take else 0
        length[:single] += 1
        take = 2 * (take - single)
    out[order] = length
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id): each is the share of code space used before it, cut to its length."""
    codes, used = np.zeros(len(lengths), np.uint32), np.flatnonzero(lengths)
    if len(used):
        used = used[np.lexsort((used, lengths[used]))]
        most, size = int(lengths[used[-1]]), lengths[used].astype(np.int64)
        codes[used] = starts_of(1 << (most - size))[:-1] >> (most - size)
    return codes


def decode_table(lengths: np.ndarray, codes: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For every value of the next `bits` bits: the id, and the bits its code takes."""
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    span = 1 << (bits - lengths[used].astype(np.int64))
    ids, size = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.uint8)
    filled = int(span.sum())
    ids[:filled], size[:filled] = np.repeat(used, span), np.repeat(lengths[used], span)
    return ids, size


# -- shards -----------------------------------------------------------------


def pack_shard(ids: np.ndarray, doc_lengths: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    bit, total = ends - size, int(ends[-1]) if len(ends) else 0
    word = bit >> 5
    shifted = codes[ids].astype(np.uint64) << (64 - size - (bit & 31)).astype(np.uint64)
    n_words = (total + 31) // 32 + 1
    # the codes of one word share no bit, so a sum joins them; a sum of halves stays exact below 2^53
    stream = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), n_words) + np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n_words + 1)[:n_words]
    checkpoints = np.append(bit[::BLOCK], total).astype("<u8")
    return HEAD.pack(b"GWH1", len(doc_lengths), len(ids), BLOCK, len(checkpoints) - 1) + doc_lengths.astype("<u8").tobytes() + checkpoints.tobytes() + stream.astype(">u4").tobytes()[: (total + 7) // 8]


def unpack_shard(payload: bytes, table: tuple[np.ndarray, np.ndarray], bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a shard as u32, and the ids of each document."""
    magic, n_docs, n, block, n_blocks = HEAD.unpack_from(payload)
    if magic != b"GWH1":
        raise ValueError("not a shard of this format")
    doc_lengths = np.frombuffer(payload, "<u8", n_docs, HEAD.size).astype(np.int64)
    at = HEAD.size + 8 * n_docs
    checkpoints = np.frombuffer(payload, "<u8", n_blocks + 1, at).astype(np.int64)
    stream = np.concatenate((np.frombuffer(payload, np.uint8, offset=at + 8 * (n_blocks + 1)), np.zeros(8, np.uint8))).astype(np.uint32)
    ahead = (stream[:-3] << 24) | (stream[1:-2] << 16) | (stream[2:-1] << 8) | stream[3:]
    ids_of, bits_of = table
    out, bit, low = np.empty((block, n_blocks), np.uint32), checkpoints[:-1].copy(), np.uint32((1 << bits) - 1)
    last = n - block * (n_blocks - 1)
    for k in range(block):
        live = n_blocks if k < last else n_blocks - 1
        if not live:
            break
        b = bit[:live]
        peek = (ahead[b >> 3] >> (32 - bits - (b & 7)).astype(np.uint32)) & low
        out[k, :live] = ids_of[peek]
        bit[:live] += bits_of[peek]
    if not np.array_equal(bit, checkpoints[1:]):
        raise ValueError("a block does not end at the next checkpoint")
    return np.ascontiguousarray(out.T).reshape(-1)[:n], doc_lengths


# -- files ------------------------------------------------------------------


def count_ids(tokens: DataFrame, width: int) -> DataFrame:
    """(id, n) over all ids; each task sends a row per distinct id at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << (8 * width if width < 4 else 18), np.int64)
        for batch in batches:
            for x in batch.column("ids"):
                c = np.bincount(np.frombuffer(x.as_buffer(), f"<u{width}"))
                if len(c) > len(total):
                    total = np.concatenate((total, np.zeros(len(c) - len(total), np.int64)))
                total[: len(c)] += c
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(tokens: DataFrame, path: str, width: int, partitions: int | None = None) -> None:
    """Writes `path`/codebook and `path`/shards from (doc_id, ids); see the module for the format.

    The codebook has a row per distinct id: its size is bounded by the vocabulary, so it goes
    through the driver whatever the corpus holds.
    """
    spark = tokens.sparkSession
    book = count_ids(tokens, width).toPandas()
    counts = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.int64)
    counts[book["id"].to_numpy(np.int64)] = book["n"].to_numpy(np.int64)
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast(lengths)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, lengths = TaskContext.get().partitionId(), shared.value
        codes, start, seq, held, docs, n = canonical_codes(lengths), 0, 0, [], [], 0

        def shard() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in held], np.int64)
            payload = pack_shard(np.concatenate(held), sizes, lengths, codes)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([start]), pa.array([n]), pa.array([docs], pa.list_(pa.int64())), pa.array([payload], pa.binary())], ["part", "seq", "start", "n_ids", "doc_ids", "payload"])

        for batch in batches:
            for doc, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                held.append(np.frombuffer(x.as_buffer(), f"<u{width}"))
                docs.append(doc)
                n += len(held[-1])
                if n >= SHARD:
                    yield shard()
                    start, seq, held, docs, n = start + n, seq + 1, [], [], 0
        if held:
            yield shard()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), F.col("ids")]
    key = order[:2] if partitions is None else [partitions, *order[:2]]
    ordered = tokens.select("doc_id", "ids").repartitionByRange(*key).sortWithinPartitions(*order)
    ordered.mapInArrow(pack, "part long, seq long, start long, n_ids long, doc_ids array<long>, payload binary").write.option("compression", "none").parquet(f"{path}/shards")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from the files under `path`.

    `start` counts the ids of all documents before. Totals per written partition (as many as
    tasks wrote, not as rows) are summed up once; within a partition the shards carry theirs.
    """
    book = spark.read.parquet(f"{path}/codebook").toPandas()
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    lengths[book["id"].to_numpy(np.int64)] = book["bits"].to_numpy(np.uint8)
    shared = spark.sparkContext.broadcast(lengths)
    shards = spark.read.parquet(f"{path}/shards")
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").toPandas()
    before = spark.sparkContext.broadcast(dict(zip(totals["part"].tolist(), starts_of(totals["n"].to_numpy(np.int64)).tolist())))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(shared.value, canonical_codes(shared.value))
        for batch in batches:
            for part, start, docs, payload in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist(), batch.column("doc_ids"), batch.column("payload")):
                ids, sizes = unpack_shard(payload.as_buffer(), table)
                at = starts_of(sizes)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(at[:-1] + start + before.value[part]), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "start", "doc_ids", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def huffman_roundtrip(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """Encodes, counts, writes the files and returns what reading them back gives."""
    spark = docs.sparkSession
    tokens, staged = written(token_ids(docs, tokenizer_file, end_id), "token-ids")
    width = word_encoder(tokenizer_file).dtype.itemsize
    path = new_path(spark, "huffman")
    write_ids(tokens, path, width)
    drop(spark, staged)
    return read_ids(spark, path)
