"""Written tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_frames = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset in local mode (tests), a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/gaugeworks/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, keep: bool = False) -> tuple[DataFrame, str]:
    """Writes df as Parquet into the shared folder; returns it reread, and its path.

    Inside `temporary` the table goes at its end; with `keep` it outlives that block.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    frames = getattr(_frames, "open", [])
    if len(frames) > keep:
        frames[-1 - keep].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Drops, at its end, the tables that this thread wrote inside without `keep`."""
    _frames.open = [*getattr(_frames, "open", []), []]
    try:
        yield
    finally:
        *_frames.open, paths = _frames.open
        for path in paths:
            drop(spark, path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold inside the block; what is run later doesn't see them."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a written table, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
