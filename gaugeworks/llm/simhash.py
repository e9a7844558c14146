"""Operator 3: near copies by SimHash, compared on vertical bit planes.

Fingerprints are made inside tasks from XXH64 of word shingles. Equal fingerprints (for a similarity:
equal sets of shingles) collapse to their smallest doc_id first, so copies never make pairs. Two ways to bucket what is compared:

* small radius (`close_links`, exact): a fingerprint of 64 bits in radius + 2 chunks; two within
  the radius agree in two chunks at least, so each pair of chunks is a key. A key with more than
  HOT fingerprints is dealt anew by pairs of four chunks of its other bits; then at most 2^16
  fingerprints share a key.
* similarity (`similar_links`): 512 bits of the distinct shingles, radius from the angle of the
  similarity; the smallest shingle under each of `ANCHORS` orders is a key (two texts of Jaccard
  similarity s share one with probability 1 - (1 - s)^6). Rows of a key with more than HOT rows are
  keyed again by it and each of `FURTHER` other orders (a pair of 0.8 in it shares none with
  probability 0.2^10). These links only propose groups: `exact_links` compares the distinct
  shingle hashes inside each group and keeps the pairs whose Jaccard similarity is reached.

What is too large still, key or group, is `hot_links`' work and exact: rows meet in one block each
first; only rows outside the largest class so found are then dealt to the other blocks, so a
large group of copies costs as much as it has rows.

Nulls: a null text is empty; a text without words has fingerprint zero and links like any other
(for a similarity: equals other such texts). Rows of one doc_id count as one document, which links
as each of its texts does; a row whose doc_id is null takes the component of an equal fingerprint
that has one, else null. Ties and repeated rows collapse. Very long texts are whole; groups are
weighed by shingles, not rows. No rows give no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import acos, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import connected_components
from ..sources.scratch import temporary, written
from .arrow_text import ascii_words, ranges, starts_of, text_slices, texts_of
from .bitslice import linked, merged

HOT = 16384
#: Rows of 512 bits that one key holds at most before it is dealt anew.
HOT_WIDE = 2048
#: Weight of a group whose shingles are compared at once: rows, or thousands of shingles if that is more.
GROUP = 2048
ANCHORS, FURTHER = 6, 10
#: Bits of fingerprints that estimate a similarity: at 0.8 the estimate of a pair has a deviation of 1.6 % of them.
BITS = 512
SEED = 42
#: Deviations that the radius of proposals adds to the bits expected at the similarity.
SPREAD = 3.5
#: Lanes of one byte for each bit of a byte: sums of up to 255 of them don't overflow.
LANES = np.array([sum((b >> i & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash of each hash (a multiply-and-shift finaliser)."""
    x = h + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the k-word shingles of lower-cased texts, and the shingles of each text."""
    import xxhash

    words, counts = ascii_words(pc.ascii_lower(texts))
    at = starts_of(counts)
    n = len(words)
    # words one space apart: a shingle is then one run of bytes
    line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), words.cast(pa.string())), " ")[0].as_py().encode() if n else b""
    length = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = starts_of(length + 1)[:-1]
    first = np.arange(max(0, n - k + 1))
    whole = np.ones(len(first), bool)
    for i in range(1, k):  # not over the end of a text
        ends = at[1:] - i
        whole[ends[(ends >= 0) & (ends < len(whole))]] = False
    first = first[whole]
    joined = map(line.__getitem__, map(slice, begin[first].tolist(), (begin + length)[first + k - 1].tolist()))
    shingles = np.maximum(counts - k + 1, 0)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(map(digest, joined, repeat(SEED)), np.uint64, len(first))
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.array([digest(line[begin[at[d]] : begin[at[d + 1] - 1] + length[at[d + 1] - 1]], SEED) for d in short], np.uint64)
        hashes = np.insert(hashes, starts_of(shingles)[short], extra)
        shingles[short] = 1
    return hashes, shingles


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each text: bits set in over half of its hashes; zero without any."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    parts = -(-n // 255)
    first = starts_of(n)[:-1]
    within_part = np.arange(parts.sum()) - np.repeat(starts_of(parts)[:-1], parts)
    cuts = np.repeat(first, parts) + 255 * within_part
    bits = np.zeros((len(some), 64), np.int64)
    view = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        lanes = np.add.reduceat(LANES[view[:, byte]], cuts)
        bits[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), starts_of(parts)[:-1])
    out[some] = np.packbits(bits * 2 > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def distinct_hashes(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text in order, and their number by text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))  # owner is in order already
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(counts)).astype(np.int64)


def set_digests(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """128 bits [texts, 2] of each text's set of hashes."""
    import xxhash

    at = starts_of(counts)
    view = memoryview(np.ascontiguousarray(hashes).view(np.uint8))
    out = b"".join(xxhash.xxh3_128_digest(view[8 * a : 8 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist()))
    return np.frombuffer(out, np.uint64).reshape(-1, 2)


def fingerprints(docs: DataFrame, shingle: int = 3, lanes: int = 1, anchors: int = 0, sets: bool = False) -> DataFrame:
    """(doc_id, prints array<long>, anchors array<long>, same array<long>, size) of every whole text; size counts its shingles.

    With `sets`, a repeated shingle counts once and same tells sets of shingles apart; else it is empty.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, most=1 << 20):
            hashes, counts = shingle_hashes(texts_of(part), shingle)
            if sets:
                hashes, counts = distinct_hashes(hashes, counts)
            same = set_digests(hashes, counts) if sets else np.zeros((len(counts), 0), np.uint64)
            prints = np.stack([majority(mixed(hashes, i) if i else hashes, counts) for i in range(lanes)], axis=1)
            smallest = np.zeros((len(counts), anchors), np.uint64)
            some = np.flatnonzero(counts)
            if len(some):
                for j in range(anchors):
                    smallest[some, j] = np.minimum.reduceat(mixed(hashes, 100 + j), starts_of(counts)[some])
            rows = len(counts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1).view(np.int64))) for x in (prints, smallest, same)), pa.array(counts)], ["doc_id", "prints", "anchors", "same", "size"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(make, "doc_id long, prints array<long>, anchors array<long>, same array<long>, size long")


def bucket_links(keyed: DataFrame, radius: int) -> DataFrame:
    """(a, b) of a spanning set of links inside each bucket, from (key, node, prints)."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def flush(table: pa.Table) -> pa.RecordBatch:
            key, node = table["key"].to_numpy(), table["node"].to_numpy()
            prints = pc.list_flatten(table["prints"]).to_numpy().view(np.uint64).reshape(len(node), -1)
            change = np.concatenate(([True], key[1:] != key[:-1]))
            label = linked(np.cumsum(change), prints, radius)
            at = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[label[at]])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= 1 << 14:
                table = pa.concat_tables(held).combine_chunks()
                key = table["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
                if cut:
                    yield flush(table.slice(0, cut))
                held, rows = [table.slice(cut)], len(key) - cut
        if rows:
            yield flush(pa.concat_tables(held).combine_chunks())

    return dealt(keyed.select("key", "node", "prints")).mapInArrow(link, "a long, b long").distinct()


def dealt(keyed: DataFrame) -> DataFrame:
    """Rows by key and in order, in a fixed number of partitions: AQE doesn't merge small ones into a slow task."""
    spark = keyed.sparkSession
    return keyed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "node")


def split_hot(keyed: DataFrame, most: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Rows whose key has up to `most` rows (and more than one), and those with more, with n."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sized = keyed.join(sizes, "key")
    return sized.where(F.col("n") <= most), sized.where(F.col("n") > most)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chunk_masks(bits: list[int], chunks: int) -> list[int]:
    """Masks of each pair of chunks of the given bits."""
    at = [round(k * len(bits) / chunks) for k in range(chunks + 1)]
    each = [sum(1 << b for b in bits[x:y]) for x, y in zip(at, at[1:])]
    return [a | b for a, b in combinations(each, 2)]


def close_links(nodes: DataFrame, radius: int, hot: int = HOT) -> DataFrame:
    """(a, b): a spanning set of all links of (node, prints of 64 bits) within the radius; exact."""
    first = chunk_masks(list(range(64)), radius + 2)
    second = [[m | x for x in chunk_masks([b for b in range(64) if not m >> b & 1], radius + 2)] for m in first]
    bits = F.col("prints")[0]

    def key(index: int, mask: int) -> Column:
        return F.xxhash64(F.lit(index), bits.bitwiseAND(F.lit(signed(mask)))).alias("key")

    keyed = nodes.select("node", "prints", F.explode(F.array(*[F.struct(F.lit(i).alias("m"), key(i, m)) for i, m in enumerate(first)])).alias("k")).select("node", "prints", "k.m", "k.key")
    few, many = split_hot(keyed, hot)
    table = F.array(*[F.array(*[key(100 + 10 * i + j, m) for j, m in enumerate(row)]) for i, row in enumerate(second)])
    again = many.select("node", "prints", F.explode(F.element_at(table, F.col("m") + 1)).alias("key"))
    return bucket_links(few.select("key", "node", "prints").unionByName(again.select("key", "node", "prints")), radius)


def shared_keys(keyed: DataFrame) -> DataFrame:
    """(key, node, n) of keys that more than one row has; only numbers are shuffled."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return written(keyed.join(sizes, "key").select("key", "node", "n"), "keys")[0]


def similar_links(nodes: DataFrame, radius: int, hot: int = HOT_WIDE) -> DataFrame:
    """(a, b): links of (node, prints, anchors) within the radius among rows that share an anchor."""
    shared = shared_keys(nodes.select("node", F.posexplode(F.slice("anchors", 1, ANCHORS)).alias("j", "x")).select("node", F.xxhash64("j", "x").alias("key")))
    few, many = shared.where(F.col("n") <= hot), shared.where(F.col("n") > hot)
    prints = nodes.select("node", "prints")

    def linked_rows(rows: DataFrame) -> DataFrame:
        return bucket_links(rows.select("key", "node").join(prints, "node"), radius)

    if many.isEmpty():
        return linked_rows(few)
    further = F.transform(F.sequence(F.lit(ANCHORS), F.lit(ANCHORS + FURTHER - 1)), lambda k: F.xxhash64("key", k, F.get("anchors", k)))
    again = shared_keys(many.select("key", "node").join(nodes.select("node", "anchors"), "node").select("node", F.explode(further).alias("key")))
    links = linked_rows(few.unionByName(again.where(F.col("n") <= hot)))
    rest = again.where(F.col("n") > hot).join(prints, "node")
    return links.unionByName(hot_links(rest.select("key", "node", "prints", "n", F.lit(1.0).alias("w")), lambda rows: bucket_links(rows, radius), hot))


def hot_links(many: DataFrame, link, most: int) -> DataFrame:
    """(a, b): a spanning set of the links inside keys of more than `most`; exact.

    many: (key, node, w, n, ...), n being the sum of the key's weights w; `link` gives the links
    inside each key of such rows. Each row is linked in one block of its key first. Rows of one class
    need not meet again, so of a key's largest class only what meets the others is dealt anew.
    """
    many, _ = written(many, "hot")
    if many.isEmpty():
        return many.select(F.col("node").alias("a"), F.col("node").alias("b"))
    half = F.lit(most / 2)

    def blocks(weight: Column) -> Column:
        return F.ceil(weight / half).cast("long")

    def own(n: Column) -> Column:
        return F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1)))

    first, _ = written(link(many.withColumn("key", F.xxhash64("key", own(blocks(F.col("n")))))), "links")
    parts, _ = written(connected_components(first), "classes")
    known = many.select("key", "node", "w").join(parts, "node", "left").select("key", F.coalesce("component", "node").alias("class"), "w")
    largest = known.groupBy("key", "class").agg(F.sum("w").alias("w")).groupBy("key").agg(F.max_by("class", "w").alias("largest"), (F.sum("w") - F.max("w")).alias("others"), F.max("w").alias("inside"))
    largest, _ = written(largest.where("others > 0"), "largest")
    rows = many.join(largest, "key").join(parts, "node", "left").withColumn("in", F.coalesce("component", "node") == F.col("largest"))
    across, among = blocks(F.col("inside")), blocks(F.col("others"))

    def each(n: Column, key) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), key)

    meets_in = each(among, lambda k: F.xxhash64("key", F.lit(0), own(across), k))
    meets_out = F.concat(each(across, lambda k: F.xxhash64("key", F.lit(0), k, own(among))), each(among, lambda k: F.xxhash64("key", F.lit(1), F.least(k, own(among)), F.greatest(k, own(among)))))
    again = rows.withColumn("key", F.explode(F.when(F.col("in"), meets_in).otherwise(meets_out))).select(*many.columns)
    return first.unionByName(link(again))


def alike(flat: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """For texts of distinct hashes: the smallest row that pairs of this Jaccard similarity lead to.

    Each row is compared with all rows not joined to it yet; rows whose shingles are common in the
    group come first, as they join most.
    """
    label = np.arange(len(counts))
    some = np.flatnonzero(counts)
    if not len(some):
        return label
    values, codes, held = np.unique(flat, return_inverse=True, return_counts=True)
    at = starts_of(counts)
    common = np.zeros(len(counts))
    common[some] = np.add.reduceat(held[codes], at[some]) / counts[some]
    left = counts > 0
    mark = np.zeros(len(values), np.int64)
    for p in some[np.argsort(-common[some], kind="stable")]:
        left[p] = False
        n = counts[p]
        small, large = np.minimum(counts, n), np.maximum(counts, n)
        todo = np.flatnonzero(left & (label != label[p]) & (small >= similarity * large - 1e-9))
        if not len(todo):
            continue
        mine = codes[at[p] : at[p + 1]]
        mark[mine] = 1
        both = np.add.reduceat(mark[codes[ranges(at[todo], counts[todo])]], starts_of(counts[todo])[:-1])
        mark[mine] = 0
        near = todo[both >= similarity * (n + counts[todo] - both) - 1e-9]
        merged(label, np.full(len(near), p), near)
    return label


def exact_links(docs: DataFrame, groups: DataFrame, sizes: DataFrame, shingle: int, similarity: float, most: int | None = None) -> DataFrame:
    """(a, b): a spanning set of the pairs of this Jaccard similarity inside each group (node, component) of doc_ids.

    sizes: (node, size), the shingles of each.
    """
    most = most or GROUP

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, most=1 << 20):
            hashes, counts = distinct_hashes(*shingle_hashes(texts_of(part), shingle))
            at = pa.array(starts_of(counts).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("node"), pa.ListArray.from_arrays(at, pa.array(hashes.view(np.int64)))], ["key", "node", "hashes"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []  # one worker makes the sets and compares them

        def flush() -> pa.RecordBatch:
            table = pa.concat_tables(held).combine_chunks()
            node = table["node"].to_numpy()
            counts = pc.list_value_length(table["hashes"]).to_numpy().astype(np.int64)
            label = alike(pc.list_flatten(table["hashes"]).to_numpy(), counts, similarity)
            at = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[label[at]])], ["a", "b"])

        for batch in sets(batches):
            key = batch.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for x, y in zip(cuts, cuts[1:]):
                if held and key[x] != last:
                    yield flush()
                    held = []
                last = key[x]
                held.append(pa.Table.from_batches([batch.slice(x, y - x)]))
        if held:
            yield flush()

    def links(rows: DataFrame) -> DataFrame:
        return dealt(rows.select("key", "node", "text")).mapInArrow(link, "a long, b long").distinct()

    weighed = groups.join(sizes.groupBy("node").agg(F.greatest(F.lit(1.0), F.max("size") / 1000).alias("w")), "node")
    sized = weighed.join(weighed.groupBy("component").agg(F.sum("w").alias("n")), "component").select(F.col("component").alias("key"), "node", "w", "n")
    sized, _ = written(sized, "groups")  # small: Spark then knows its size
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    rows = texts.join(sized, "node")
    few = links(rows.where(F.col("n") <= most))
    return few if sized.where(F.col("n") > most).isEmpty() else few.unionByName(hot_links(rows.where(F.col("n") > most), links, most))


def radius_of(similarity: float, bits: int = BITS, spread: float = SPREAD) -> int:
    """Bits in which texts of this Jaccard similarity differ: the angle's share, plus `spread` deviations."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    return round(bits * p + spread * (bits * p * (1 - p)) ** 0.5)


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float | None = 0.8, radius: int = 2) -> DataFrame:
    """(doc_id, prints, component_id) of every row; component_id is the smallest doc_id reachable.

    With `similarity`, links are the pairs of this Jaccard similarity of distinct shingles that 512
    bits propose; without, they are all pairs of 64-bit fingerprints within `radius`.
    """
    with temporary(docs.sparkSession):
        made = fingerprints(docs, shingle).withColumn("same", F.col("prints")) if similarity is None else fingerprints(docs, shingle, BITS // 64, ANCHORS + FURTHER, sets=True)
        rows, _ = written(made, "prints")
        nodes, _ = written(rows.groupBy("same").agg(F.min("doc_id").alias("node"), F.min("prints").alias("prints"), F.min("anchors").alias("anchors"), F.max("size").alias("size")), "nodes")
        known = nodes.where("node is not null")
        if similarity is None:
            links = close_links(known, radius)
        else:
            proposed, _ = written(connected_components(similar_links(known, radius_of(similarity))), "proposed")
            links = exact_links(docs, proposed, known.select("node", "size"), shingle, similarity)
        # texts of one doc_id are one document
        split = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("same").alias("low"), F.max("same").alias("high")).where("low <> high").select("doc_id")
        owned = rows.select("doc_id", "same").join(split, "doc_id").join(nodes.select("same", "node"), "same").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
        parts = connected_components(links.unionByName(owned)).withColumnRenamed("node", "n")
        labelled = nodes.join(parts, nodes["node"] == parts["n"], "left").select("same", F.coalesce("component", "node").alias("component_id"))
        found = rows.select("doc_id", "prints", "same").join(labelled, "same")
        return written(found.select("doc_id", "prints", "component_id"), "near-copies", keep=True)[0]
