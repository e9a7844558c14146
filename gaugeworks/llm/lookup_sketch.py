"""Document fingerprints as invertible Bloom lookup sketches, in built-in Spark functions alone.

A text is the set of its paragraphs: its lines, longer ones cut at the first sentence end after 100
code points, and after 200 where none comes. Each is a 64-bit digest. A sketch deals every digest to
one cell in each of three tables; a cell holds how many digests it got, their exclusive or, and that
of their check values. Sketches of two versions subtract cell by cell: what both have vanishes. A
cell left with one digest (count 1 or -1, check value right) names it; taking it out of its other
cells frees more. Where peeling gets stuck the sketch was too small: those texts are sketched anew,
with 16 times the cells and another hash, until every difference is named.

Order and repeats of paragraphs don't count: a text is a set here. Cells are rows, keyed by text and
place; only cells that aren't zero exist, so a larger sketch costs no more. All rows of a text stay
in its bucket: whole texts are shuffled once, cells never.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import new_path, settings

#: Tables of a sketch, cells of each at first (three bits of a digest); code points of a piece of a line.
TABLES, SLOTS, LEAST, LONGEST = 3, 8, 100, 200
#: Passes over the tables in peeling (each adds operators to a stage, and so to what its tasks report); bits that a sketch grows by, and those that a table's place may have.
SWEEPS, GROWTH, MOST_BITS = 2, 4, 21
#: Retries at most: the last ones have new hashes only.
RETRIES = 12
#: Rows a block of neighbouring documents is meant to hold, and blocks at most (a bound is some 20 bytes).
BLOCK_ROWS, MOST_BLOCKS = 250, 1 << 16


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def digests(text: Column) -> Column:
    """The distinct digests of the paragraphs of a text (null: none)."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\n]{{1,{LEAST}}}[^\n.!?]{{0,{LONGEST - LEAST}}}[.!?]*"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != ""), lambda p: F.xxhash64(p)))


def check_value(digest: Column) -> Column:
    return F.xxhash64(digest).bitwiseAND(F.lit(0xFFFFFFFF))


def place(digest: Column, table: int, size: int = 0) -> Column:
    """The cell of a digest in a table of the size-th sketch: other bits for each table, another hash for each size."""
    bits = min(MOST_BITS, 3 + GROWTH * size)
    return F.shiftrightunsigned(F.xxhash64(digest, F.lit(size)) if size else digest, 64 - MOST_BITS * table - bits).bitwiseAND(F.lit((1 << bits) - 1))


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _table(keys: Column, k: int) -> Column:
    """The digests of each cell of a table. Turned so that their bits are on top, those of a cell lie together once sorted."""
    bits = MOST_BITS * k
    turned = F.transform(keys, lambda x: F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))) if k else keys
    back = lambda x: F.shiftrightunsigned(x, bits).bitwiseOR(F.shiftleft(x, 64 - bits)) if k else x
    edges = F.array(*[F.lit((s - SLOTS // 2) << 61).cast("long") for s in range(SLOTS)])  # signed: cells 4 to 7 come first

    def cells(order: Column) -> Column:
        starts = F.transform(edges, lambda e: F.array_position(order, e).cast("int"))
        ends = F.concat(F.transform(F.slice(edges, 2, SLOTS - 1), lambda e: F.array_position(order, e).cast("int")), F.array(F.size(order) + 1))
        found = F.zip_with(starts, ends, lambda i, j: F.transform(F.slice(order, i + 1, j - i - 1), back))
        return let(found, lambda x: F.concat(F.slice(x, SLOTS // 2 + 1, SLOTS // 2), F.slice(x, 1, SLOTS // 2)))

    return let(F.sort_array(F.concat(turned, edges)), cells)


def sketch(keys: Column) -> Column:
    """The cells (n, key, mark) of the first sketch of a set of digests, table after table."""
    return F.transform(F.concat(*[_table(keys, k) for k in range(TABLES)]), lambda hits: F.struct(F.size(hits).alias("n"), _xor(hits).alias("key"), F.aggregate(hits, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(check_value(x))).alias("mark")))


def printed(cells: Column) -> Column:
    """A sketch as text: count (16 bits), digest (64) and check value (32) of each cell, in base64."""
    part = lambda value, digits: F.lpad(F.hex(value), digits, "0")
    whole = F.transform(cells, lambda c: F.concat(part(c["n"].cast("long").bitwiseAND(F.lit(0xFFFF)), 4), part(c["key"], 16), part(c["mark"], 8)))
    return F.base64(F.unhex(F.array_join(whole, "")))


def subtracted(sets: DataFrame, id: list[str], size: int = 0) -> DataFrame:
    """The cells (id, table, cell, n, key, mark) of the sketch of a less that of b that aren't zero; sets: (id, a, b)."""
    signed = F.concat(F.transform("a", lambda k: F.struct(k.alias("key"), F.lit(1).cast("long").alias("n"))), F.transform("b", lambda k: F.struct(k.alias("key"), F.lit(-1).cast("long").alias("n"))))
    each = sets.select(*id, F.explode(signed).alias("d")).select(*id, "d.key", "d.n")
    cells = F.array(*[F.struct(F.lit(k).alias("table"), place(F.col("key"), k, size).alias("cell")) for k in range(TABLES)])
    return _summed(each.select(*id, F.explode(cells).alias("c"), "n", "key", check_value(F.col("key")).alias("mark")).select(*id, "c.table", "c.cell", "n", "key", "mark"), id)


def _summed(rows: DataFrame, id: list[str]) -> DataFrame:
    cells = rows.groupBy(*id, "table", "cell").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("mark").alias("mark"))
    return cells.where("n <> 0 or key <> 0 or mark <> 0")


def peeled(cells: DataFrame, id: list[str], size: int = 0, named: bool = False) -> DataFrame:
    """(id, gone, came, left): how many digests only a has, only b has, and cells that peeling could not empty.

    With `named`, gone and came are the digests. A step takes the digests that single cells of one
    table name, so none is taken twice. Texts without a difference give no row.
    """
    done = TABLES  # what is named goes to a table of its own
    for step in range(SWEEPS * TABLES):
        k = step % TABLES
        single = (F.col("table") == k) & (F.abs("n") == 1) & (check_value(F.col("key")) == F.col("mark"))
        row = lambda table, cell, n, key, mark: F.struct(F.lit(table).cast("int").alias("table"), cell.alias("cell"), n.alias("n"), key.alias("key"), mark.alias("mark"))
        own = F.struct("table", "cell", "n", "key", "mark")
        name = row(done, F.col("key") if named else F.col("n"), F.col("n"), F.col("key") if named else F.lit(0).cast("long"), F.lit(0).cast("long"))
        others = [row(t, place(F.col("key"), t, size), -F.col("n"), F.col("key"), F.col("mark")) for t in range(TABLES) if t != k]
        cells = _summed(cells.select(*id, F.explode(F.when(single, F.array(name, *others)).otherwise(F.array(own))).alias("c")).select(*id, "c.*"), id)
    found, of = F.col("table") == done, lambda sign: (F.col("table") == done) & (F.signum("n") == sign)
    if named:
        counts = [F.array_sort(F.collect_list(F.when(of(sign), F.col("key")))).alias(c) for sign, c in ((1, "gone"), (-1, "came"))]
    else:
        counts = [F.coalesce(F.sum(F.when(of(sign), F.abs("n"))), F.lit(0)).cast("long").alias(c) for sign, c in ((1, "gone"), (-1, "came"))]
    return cells.groupBy(*id).agg(*counts, F.count_if(~found).alias("left"))


def differences(sets: DataFrame, id: list[str], bucket: str, named: bool = False) -> DataFrame:
    """(id, gone, came) of every row of sets (id, a, b: arrays of digests) whose sets differ, written.

    sets should be bucketed by `bucket`, one of the id columns: then nothing here is shuffled. A
    sketch that can't be peeled is made anew, larger; after RETRIES of them this raises.
    """
    spark, parts = sets.sparkSession, []
    todo = sets
    # joins by one of the keys; and no map of fixed size beforehand for each of the many sums of a stage
    with settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.codegen.aggregate.map.twolevel.enabled": "false"}):
        for size in range(RETRIES):
            found = bucketed(peeled(subtracted(todo, id, size), id, size, named), bucket, f"peeled-{size}")
            parts.append(found.where("left = 0").drop("left"))
            stuck = found.where("left > 0").select(*id)
            if not stuck.limit(1).count():
                break
            todo = sets.join(stuck, id, "left_semi")
        else:
            raise RuntimeError(f"sketches of {RETRIES} sizes could not be peeled")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def bucketed(rows: DataFrame, by: str, name: str) -> DataFrame:
    """rows written as a table of buckets, as many as shuffles have partitions; read again, its buckets need no shuffle."""
    spark = rows.sparkSession
    table = f"{name}_{uuid4().hex}".replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(n, by).option("path", new_path(spark, name)).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def neighbours(docs: DataFrame) -> DataFrame:
    """(block, doc_id, text, next): each document with the text of the one after it (after the last: the first).

    Ascending doc_id, a null one last, then by a hash of the text. Bounds of blocks come from ids and
    hashes alone; then whole texts are shuffled once, by block, the first row of a block also to the
    block before.
    """
    spark = docs.sparkSession
    key = F.struct(F.col("doc_id").isNull().alias("void"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64(F.col("text")).alias("hash"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("*", key.alias("key"))
    step = max(BLOCK_ROWS, -(-rows.count() // MOST_BLOCKS))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = rows.select("key").repartitionByRange(n, "key").sortWithinPartitions("key")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lows = order.withColumn("place", place).where(F.col("place") % step == 0).select("key").collect()  # a row a block, about MOST_BLOCKS at most
    lows = sorted({(r["key"]["void"], r["key"]["id"], r["key"]["hash"]) for r in lows}) or [(False, 0, 0)]
    bounds = F.broadcast(spark.createDataFrame([(lows,)], "bounds array<struct<void boolean, id long, hash long>>"))
    jumps = F.array(*[F.lit(1 << k) for k in reversed(range(len(lows).bit_length()))])
    last = len(lows) - 1

    def reached(at: Column, jump: Column) -> Column:
        return F.when((at + jump <= last) & (F.get(F.col("bounds"), F.least(at + jump, F.lit(last))) <= F.col("key")), at + jump).otherwise(at)

    placed = rows.crossJoin(bounds).withColumn("block", F.aggregate(jumps, F.lit(0), reached))
    first = F.get(F.col("bounds"), F.col("block")) == F.col("key")
    before = F.when(F.col("block") == 0, F.lit(last)).otherwise(F.col("block") - 1)
    own, copy = F.struct(F.col("block"), F.lit(False).alias("copy")), F.struct(before.alias("block"), F.lit(True).alias("copy"))
    dealt = placed.select("doc_id", "text", "key", F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own))).alias("to"))
    order = Window.partitionBy(F.col("to.block")).orderBy(F.col("to.copy"), "key")
    return dealt.withColumn("next", F.lead("text").over(order)).where("not to.copy").select(F.col("to.block").alias("block"), "doc_id", "text", "next")


def likeness(size: Column, gone: Column, came: Column) -> Column:
    """Shared part of all digests (Jaccard) of a set of `size` and one that lacks `gone` of them and adds `came`; two empty sets are alike."""
    return F.when(size + came == 0, F.lit(1.0)).otherwise((size - gone) / (size + came))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs, n_gone, n_came.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of the
    next document. A fingerprint is the printed sketch of 24 cells; a likeness is the shared part of
    all paragraph digests of two texts (Jaccard), from the digests that peeling names. n_gone and
    n_came count the paragraphs that the edit took and brought.

    Null texts are empty; an empty text has no paragraph and is like another empty one (1). Very long
    texts only take longer (a sketch grows fourfold until it peels). Of equal doc_ids the order is by
    a hash of the text; repeated rows follow one another; a null doc_id comes last. A table of one row
    is its own next. Other columns, whatever their names, are not read; an empty table gives no rows.
    """
    n, k = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - k), F.substring("next", F.lit(1), k))
    rows = neighbours(docs).select("block", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next")
    sets = rows.select("block", F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("new"), digests(F.col("next")).alias("other"))
    sets = bucketed(sets, "block", "paragraphs")
    pairs = F.array(F.struct(F.lit(0).alias("pair"), F.col("own").alias("a"), F.col("new").alias("b")), F.struct(F.lit(1).alias("pair"), F.col("own").alias("a"), F.col("other").alias("b")))
    found = differences(sets.select("block", "row", F.explode(pairs).alias("p")).select("block", "row", "p.*"), ["block", "row", "pair"], "block")
    of = lambda side, pair: F.coalesce(F.sum(F.when(F.col("pair") == pair, F.col(side))), F.lit(0))
    changes = found.groupBy("row").agg(*[of(side, pair).alias(f"{name}_{side}") for pair, name in enumerate(("edit", "step")) for side in ("gone", "came")])
    size = F.size("own").cast("long")
    whole = sets.join(changes, "row", "left").fillna(0, [f"{name}_{side}" for name in ("edit", "step") for side in ("gone", "came")])
    return whole.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(sketch(F.col("own"))).alias("fingerprint"),
        printed(sketch(F.col("new"))).alias("edited_fingerprint"),
        likeness(size, F.col("edit_gone"), F.col("edit_came")).alias("near_edited"),
        likeness(size, F.col("step_gone"), F.col("step_came")).alias("near_next"),
        size.alias("n_paragraphs"),
        F.col("edit_gone").alias("n_gone"),
        F.col("edit_came").alias("n_came"),
    )
