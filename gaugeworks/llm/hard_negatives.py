"""Hard negatives by inner product, mined with vantage-point trees over norm-augmented vectors.

With a further coordinate that makes all rows as long as the longest one, and 0 for a query, the
squared distance of a query q to a row x is |q|^2 + M - 2 q.x: a higher score is a shorter
distance, and a window of scores an annulus around q. A tree splits rows by their distance from a
vantage point; a query enters a side only if its annulus can meet the distances kept there, the
nearer side first, and its outer radius shrinks as soon as it has k rows.

Rows are dealt to the leaves of a tree fitted on a bounded sample, a leaf to chunks of about 4096
rows, each with a tree of its own: the index, written once. Queries come in blocks of bounded size;
a task takes its chunks one after another and keeps the radii it has reached. Pruning allows for
rounding, and scores are exact integers, so results are exact whatever the sample was.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settings, temporary, written
from .vectors import matrix_blocks

#: Rows a chunk of the index is meant to hold and a leaf of its tree at most; rows of the sample; numbers of the vectors in it, or in a block of queries.
CHUNK, LEAF, SAMPLE, BLOCK_NUMBERS = 4096, 256, 4096, 1 << 18
SHAPE = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Node:
    """Rows [start, stop) of the tree's order; with children: their distances from the vantage point lie in inner and outer."""

    start: int
    stop: int
    point: np.ndarray | None = None
    inner: tuple[float, float] = (0.0, 0.0)
    outer: tuple[float, float] = (0.0, 0.0)
    near: Node | None = None
    far: Node | None = None


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    x = x.astype(float)
    return np.column_stack((x, np.sqrt(np.maximum(most - (x * x).sum(1), 0.0))))


def distances(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - point) ** 2).sum(1))


def grown(points: np.ndarray, leaf: int = LEAF) -> tuple[Node, np.ndarray]:
    """A vantage-point tree over points, and their order in it. The vantage point is the row farthest from the first."""
    order = np.arange(len(points))

    def grow(start: int, stop: int) -> Node:
        node = Node(start, stop)
        if stop - start <= leaf:
            return node
        own = points[order[start:stop]]
        point = own[int(distances(own, own[0]).argmax())]
        d = distances(own, point)
        inside = d <= np.median(d)
        if inside.all():  # copies of one row: nothing to split by
            return node
        order[start:stop] = np.concatenate((order[start:stop][inside], order[start:stop][~inside]))
        middle = start + int(inside.sum())
        node.point, node.inner, node.outer = point, (d[inside].min(), d[inside].max()), (d[~inside].min(), d[~inside].max())
        node.near, node.far = grow(start, middle), grow(middle, stop)
        return node

    return grow(0, len(points)), order


@dataclass
class Queries:
    """Queries of one kind: k best rows of the same (or another) label with a score in [low, high], best first, ties by id."""

    x: np.ndarray
    label: np.ndarray
    own: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int
    most: float
    floor: np.ndarray = field(init=False)
    score: np.ndarray = field(init=False)
    id: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.square = (self.x * self.x).sum(1) + self.most
        self.slack = 1e-6 * np.sqrt(2 * self.most + 1)
        self.floor = self.low.astype(float)
        self.score = np.full((len(self.x), self.k), -np.inf)
        self.id = np.full((len(self.x), self.k), np.iinfo(np.int64).max)

    def fits(self, at: np.ndarray, score: np.ndarray, label: np.ndarray, id: np.ndarray) -> np.ndarray:
        kind = (self.label[at][:, None] == label) == self.same
        return kind & (score >= self.floor[at][:, None]) & (score <= self.high[at][:, None]) & (self.own[at][:, None] != id)

    def bounded_by(self, x: np.ndarray, label: np.ndarray, id: np.ndarray) -> None:
        """The k-th best of some of the rows is a floor: nothing below it can be among the k best of all."""
        at = np.arange(len(self.x))
        score = self.x @ x.T
        score = np.where(self.fits(at, score, label, id), score, -np.inf)
        if score.shape[1] >= self.k:
            self.floor = np.maximum(self.floor, np.partition(score, -self.k, axis=1)[:, -self.k])

    def meet(self, at: np.ndarray, x: np.ndarray, label: np.ndarray, id: np.ndarray) -> None:
        score = self.x[at] @ x.T
        fit = self.fits(at, score, label, id)
        some = fit.any(1)
        if not some.any():
            return
        at, fit = at[some], fit[some]
        score = np.concatenate((self.score[at], np.where(fit, score[some], -np.inf)), axis=1)
        ids = np.concatenate((self.id[at], np.where(fit, id, np.iinfo(np.int64).max)), axis=1)
        best = np.lexsort((ids, -score), axis=1)[:, : self.k]
        self.score[at], self.id[at] = np.take_along_axis(score, best, 1), np.take_along_axis(ids, best, 1)
        self.floor[at] = np.maximum(self.floor[at], self.score[at, -1])

    def can_meet(self, at: np.ndarray, distance: np.ndarray, span: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
        """Whether the annulus of a query reaches rows in span around a point this far away; and how near they can be."""
        least = np.maximum(np.maximum(distance - span[1], span[0] - distance), 0.0)
        outer, inner = np.sqrt(np.maximum(self.square[at] - 2 * self.floor[at], 0.0)), np.sqrt(np.maximum(self.square[at] - 2 * self.high[at], 0.0))
        return (least <= outer + self.slack) & (distance + span[1] >= inner - self.slack), least

    def distance(self, at: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square[at] - 2 * (self.x[at] @ point[:-1]), 0.0))

    def search(self, node: Node, at: np.ndarray, x: np.ndarray, label: np.ndarray, id: np.ndarray) -> None:
        """All queries at once: those nearer to a side enter it first, then with the radius they have the other one."""
        if not len(at):
            return
        if node.point is None:
            rows = slice(node.start, node.stop)
            self.meet(at, x[rows], label[rows], id[rows])
            return
        d = self.distance(at, node.point)
        near, far = (node.near, node.inner), (node.far, node.outer)
        first = self.can_meet(at, d, node.inner)[1] <= self.can_meet(at, d, node.outer)[1]
        for chosen, (child, span) in ((first, near), (~first, far), (first, far), (~first, near)):
            mine = at[chosen]
            self.search(child, mine[self.can_meet(mine, d[chosen], span)[0]], x, label, id)


def mined_points(rows: DataFrame, copies: int) -> DataFrame:
    """The rows (vec_id, x, label) that can be among a best few: of rows alike in x and label the `copies` smallest ids."""
    first = Window.partitionBy("x", "label").orderBy("vec_id")
    return rows.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= copies).drop("_place")


def sampled(points: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, label and id of at most SAMPLE rows, those with the smallest hashes."""
    n = max(1, min(SAMPLE, 16 * BLOCK_NUMBERS // max(1, d)))
    some = points.orderBy(F.xxhash64("x", "label", "vec_id")).limit(n).toPandas()
    return vectors(some["x"], d), some["label"].to_numpy(np.int64), some["vec_id"].to_numpy(np.int64)


def vectors(x: pd.Series, d: int) -> np.ndarray:
    return np.array(x.tolist(), np.int64).reshape(len(x), d)


def indexed(points: DataFrame, sample: np.ndarray, most: float) -> DataFrame:
    """(tree, rows) of every chunk, written."""
    spark, n = points.sparkSession, points.count()
    leaves = max(1, min(-(-n // CHUNK), len(sample) // 16))
    top, _ = grown(augmented(sample, most), max(1, len(sample) // leaves))
    shared = spark.sparkContext.broadcast(top)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[Node] = []

        def gather(node: Node) -> None:
            if node.point is None:
                names.append(node)
            else:
                gather(node.near)
                gather(node.far)

        gather(shared.value)
        number = {id(node): k for k, node in enumerate(names)}

        def route(node: Node, at: np.ndarray, y: np.ndarray, out: np.ndarray) -> None:
            if node.point is None or not len(at):
                out[at] = number.get(id(node), 0)
                return
            inside = distances(y[at], node.point) <= node.inner[1]
            route(node.near, at[inside], y, out)
            route(node.far, at[~inside], y, out)

        for batch in batches:
            for part, x in matrix_blocks(batch):
                leaf = np.zeros(len(x), np.int64)
                route(shared.value, np.arange(len(x)), augmented(x, most), leaf)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("x"), part.column("label"), pa.array(leaf)], ["vec_id", "x", "label", "leaf"])

    placed, _ = written(points.mapInArrow(routed, "vec_id long, x array<long>, label long, leaf long"), "leaves")
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))  # a row a leaf, at most SAMPLE / 16
    dealt = placed.join(F.broadcast(sizes), "leaf").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks"))).drop("chunks")

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        x = vectors(rows["x"], len(rows["x"].iloc[0]))
        tree, order = grown(augmented(x, most))
        return pd.DataFrame({"tree": [pickle.dumps((tree, x[order], rows["label"].to_numpy(np.int64)[order], rows["vec_id"].to_numpy(np.int64)[order]))]})

    return written(dealt.groupBy("leaf", "chunk").applyInPandas(packed, "tree binary"), "trees")[0]


def best(index: DataFrame, queries: Broadcast, sample: Broadcast, same: bool, k: int, most: float) -> DataFrame:
    """(query, id, score, place): the k best rows of every query, from 1; queries: x, label, own id, lowest and highest score."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, label, own, low, high = queries.value
        q = Queries(x.astype(float), label, own, low, high, same, k, most)
        q.bounded_by(*sample.value)
        for batch in batches:
            for tree in batch.column("tree"):
                node, rows, labels, ids = pickle.loads(tree.as_py())
                q.search(node, np.arange(len(x)), rows.astype(float), labels, ids)
        at, place = np.nonzero(np.isfinite(q.score))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(q.id[at, place]), pa.array(q.score[at, place].astype(np.int64))], ["query", "id", "score"])

    found = index.mapInArrow(search, "query long, id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Per anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows and anchors: (vec_id, x, label), x whole numbers and of one length. An anchor's positives are the first rows
    of its label with another vec_id; their negatives the first rows of other labels whose score is
    from low to high percent of the positive's. Higher scores come first, ties by smaller vec_id.
    Repeated rows count once; rows of one vec_id that differ are rows of their own, and such anchors
    too. Rows with a null in any column take no part, nor do vectors whose squared length is 2^53 or
    more (scores would not be exact). No anchors, or no rows, give no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c)

    def sound(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long"), "x", F.col("label").cast("long")).dropna()
        return df.where(square < float(1 << 53)).distinct()

    parts = []
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "64"}), temporary(spark):
        points, _ = written(mined_points(sound(rows), max(positives + 1, negatives)), "points")
        figures = points.agg(F.max(square).alias("most"), F.max(F.size("x")).alias("d")).first()
        asked, _ = written(sound(anchors), "anchors")
        count = asked.count()
        if not count or not figures["d"]:
            return spark.createDataFrame([], SHAPE)
        most, d = max(figures["most"], asked.agg(F.max(square)).first()[0]), figures["d"]
        sample = sampled(points, d)
        index = indexed(points, sample[0], most)
        near = spark.sparkContext.broadcast((sample[0].astype(float), *sample[1:]))
        blocks = -(-count * d // BLOCK_NUMBERS)
        for block in range(blocks):
            some = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toPandas()
            x, label, own = vectors(some["x"], d), some["label"].to_numpy(np.int64), some["vec_id"].to_numpy(np.int64)
            wide = np.full(len(own), float(1 << 60))
            queries = spark.sparkContext.broadcast((x, label, own, -wide, wide))
            found = best(index, queries, near, True, positives, most).toPandas().sort_values(["query", "place"])  # a few rows an anchor of the block
            q, score = found["query"].to_numpy(), found["score"].to_numpy()
            lowest, highest = -((-low * score) // 100), high * score // 100
            open_ = lowest <= highest
            q, score, positive, lowest, highest = (v[open_] for v in (q, score, found["id"].to_numpy(), lowest, highest))
            windows = spark.sparkContext.broadcast((x[q], label[q], own[q], lowest.astype(float), highest.astype(float)))
            names = spark.createDataFrame(pd.DataFrame({"query": np.arange(len(q)), "anchor_id": own[q], "positive_id": positive, "positive_score": score}), "query long, anchor_id long, positive_id long, positive_score long")
            rows_ = best(index, windows, near, False, negatives, most).join(names, "query")
            parts.append(written(rows_.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives", keep=True)[1])
            for shared in (queries, windows):
                shared.unpersist()
    return spark.read.schema(SHAPE).parquet(*parts)
