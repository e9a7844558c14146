"""Embeddings as exact integer vectors, for the operators on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a block of rows that numpy works on at once, and states that are merged at once.
BLOCK_NUMBERS, FAN = 1 << 21, 16


def integer_vectors(rows: DataFrame, column: str = "embedding", scale: int = 256) -> DataFrame:
    """The other columns and x: floor(scale * c) of every entry; without rows whose vector is null or holds null or non-finite entries.

    Vectors of another length than most (of lengths as frequent, the longest) are left out as well.
    """
    sound = F.col(column).isNotNull() & ~F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    rows = rows.where(F.coalesce(sound, F.lit(False)))
    size = rows.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.size(column) == (size["size"] if size else 0))
    return rows.select(*[c for c in rows.columns if c != column], F.transform(column, lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def matrix_blocks(batch: pa.RecordBatch, column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch of bounded size, each with its vectors as a matrix of int64."""
    if not batch.num_rows:
        return
    d = max(1, len(batch.column(column)[0]))
    step = max(1, BLOCK_NUMBERS // d)
    for k in range(0, batch.num_rows, step):
        part = batch.slice(k, step)
        yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, -1)


def folded(rows: DataFrame, step: Callable[[np.ndarray | None, np.ndarray], np.ndarray], merge: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """A state of fixed size of all vectors x: each task folds its blocks, states are merged FAN at a time; None without rows."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for _, x in matrix_blocks(batch):
                state = step(state, x)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([state.ravel().tolist()], pa.list_(pa.float64()))], ["part", "state"])

    def merged(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        states = [np.array(s) for s in parts.sort_values("part")["state"]]
        return pd.DataFrame({"part": [key[0]], "state": [merge(states).ravel().tolist()]})

    shape = "part long, state array<double>"
    tasks = rows.select("x").rdd.getNumPartitions()
    states = rows.select("x").mapInArrow(fold, shape)
    while True:
        states = states.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInPandas(merged, shape)
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            break
    found = states.collect()  # one state
    return np.array(found[0]["state"]) if found else None
