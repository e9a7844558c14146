"""Global order and prefix sums that hold for hot keys: no window over a whole table or key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

BLOCK = 1 << 16


def indexed(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """df with the 0-based place of each row in the order.

    Rows are range-partitioned and sorted, written once (so both uses see one division), and get
    their place in the partition plus the counts of the partitions before: a row per partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in order]
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    placed, _ = written(placed.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + place).drop("_part", "_before", "_id")


def prefix_sums(df: DataFrame, key: list[str], seq: str, values: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """For each row: sums of `values` over the earlier rows (by seq) of its key, 0 without any.

    Two levels: a window inside blocks of seq, and one over block totals of a key.
    """
    rows = df.withColumn("_block", F.floor(F.col(seq) / block)).withColumns({f"_v_{n}": v for n, v in values.items()})
    inside = Window.partitionBy(*key, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*key, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    earlier = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*key, "_block", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in values])
    out = rows.withColumns({n: F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in values})
    out = out.join(offsets, [*key, "_block"]) if key else out.join(F.broadcast(offsets), "_block")
    return out.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in values}).select(*df.columns, *values)


def time_split(df: DataFrame, order: list[str], shares: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """seq and split by place: train while seq < the first share of n, then val to the sum of both, the rest test."""
    placed = indexed(df, order)
    a, b = cuts(placed.count(), shares)
    return placed.withColumn("split", F.when(F.col("seq") < a, "train").when(F.col("seq") < b, "val").otherwise("test"))


def cuts(n: int, shares: tuple[float, float] = (0.6, 0.2)) -> tuple[float, float]:
    """Places (not rounded) before which train and val rows are."""
    return shares[0] * n, round(shares[0] + shares[1], 12) * n
