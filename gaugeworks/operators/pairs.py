"""Moments of item pairs over the learners that answered both, by blocks of items.

A learner's items are cut into blocks of 128 places in the order of item ids. Each pair of blocks is
a row with its own key, so a learner with very many items is spread over tasks. A task takes its
rows in order of the pair of blocks and adds up matrices of moments over its learners, before
anything of the size of the pairs is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import indexed

BLOCK = 128
MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")
#: Learners whose rows are made a matrix at once.
LEARNERS = 2048


def pair_moments(rows: DataFrame, value: str | None = None, keys: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """(keys, i, j, n, sx, sy, sxx, syy, sxy) for i < j: rows (keys, user_id, question_id, value), one a learner and item.

    Sums of the values of i and of j over the n learners that have both; without `value` only n means anything.
    """
    rows = rows.select(*keys, "user_id", "question_id", (F.col(value).cast("double") if value else F.lit(0.0)).alias("_v"))
    places = indexed(rows.select("question_id").distinct(), ["question_id"], "_at")
    placed = rows.join(places, "question_id").withColumn("_b", F.floor(F.col("_at") / block))
    own = placed.groupBy(*keys, "user_id", "_b").agg(F.sort_array(F.collect_list(F.struct((F.col("_at") % block).cast("int").alias("p"), F.col("_v").alias("v")))).alias("_e"))
    seen = own.groupBy(*keys, "user_id").agg(F.collect_set("_b").alias("_all"))  # a number a block of a learner
    halves = own.join(seen, [*keys, "user_id"]).withColumn("_c", F.explode("_all"))
    halves = halves.select(*keys, "user_id", F.least("_b", "_c").alias("_lo"), F.greatest("_b", "_c").alias("_hi"), "_b", "_e")
    side = lambda c: F.first(F.when(F.col("_b") == F.col(c), F.col("_e")), ignorenulls=True)
    both = halves.groupBy(*keys, "user_id", "_lo", "_hi").agg(side("_lo").alias("x"), side("_hi").alias("y"))
    names = [*keys, "_lo", "_hi"]
    each = both.select(*names, F.col("x.p").alias("xp"), F.col("x.v").alias("xv"), F.col("y.p").alias("yp"), F.col("y.v").alias("yv")).sortWithinPartitions(*names)

    def dense(places: pd.Series, values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        seen, v = np.zeros((len(places), block)), np.zeros((len(places), block))
        at = np.repeat(np.arange(len(places)), [len(p) for p in places])
        where = np.concatenate(places.tolist()).astype(np.int64)
        seen[at, where] = 1
        v[at, where] = np.concatenate(values.tolist())
        return seen, v

    def flat(name: tuple, sums: np.ndarray) -> pd.DataFrame:
        lo, hi = int(name[-2]), int(name[-1])
        i, j = np.nonzero(sums[0])
        i, j = (i, j) if lo != hi else (i[i < j], j[i < j])
        out = {k: name[n] for n, k in enumerate(keys)} | {"_i": lo * block + i, "_j": hi * block + j}
        return pd.DataFrame(out | {m: sums[n][i, j] for n, m in enumerate(MOMENTS)})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sums = None, None
        for batch in batches:
            for name, part in batch.groupby(names, sort=False):
                if name != now:
                    if now is not None:
                        yield flat(now, sums)
                    now, sums = name, np.zeros((len(MOMENTS), block, block))
                for k in range(0, len(part), LEARNERS):
                    some = part.iloc[k : k + LEARNERS]
                    (a, x), (b, y) = dense(some["xp"], some["xv"]), dense(some["yp"], some["yv"])
                    for n, (left, right) in enumerate(((a, b), (x, b), (a, y), (x * x, b), (a, y * y), (x, y))):
                        sums[n] += left.T @ right
        if now is not None:
            yield flat(now, sums)

    kinds = dict(rows.dtypes)
    shape = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "_i long, _j long", *(f"{m} double" for m in MOMENTS)])
    summed = each.mapInPandas(add, shape).groupBy(*keys, "_i", "_j").agg(F.sum("n").cast("long").alias("n"), *[F.sum(m).alias(m) for m in MOMENTS[1:]])
    of = lambda c: places.select(F.col("_at").alias(f"_{c}"), F.col("question_id").alias(c))
    return summed.join(of("i"), "_i").join(of("j"), "_j").select(*keys, "i", "j", *MOMENTS)


def correlation(least: float = 1e-12):
    """The correlation of a row of moments; null where a side doesn't vary."""
    n = F.col("n")
    vx, vy = F.col("sxx") / n - (F.col("sx") / n) ** 2, F.col("syy") / n - (F.col("sy") / n) ** 2
    return F.when((vx > least) & (vy > least), (F.col("sxy") / n - F.col("sx") * F.col("sy") / (n * n)) / F.sqrt(vx * vy))
