"""The replay as a stream: each micro-batch is a chunk; ratings are a table that batches update."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.ratings import STATE, replay_chunk
from ..sources.scratch import new_path


def stream_ratings(games: DataFrame, model: str, configs: dict[str, dict], predictions: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes predictions made before each game under `predictions`/batch=N. games: a stream of seq, user_id, opponent_id, s.

    A batch that is run again overwrites its own output and starts from the state before it.
    """
    spark = games.sparkSession

    def path(batch: int) -> str:
        return f"{predictions}/_ratings/{batch}"

    def each(rows: DataFrame, batch: int) -> None:
        s: SparkSession = rows.sparkSession
        state = s.read.schema(STATE).parquet(path(batch - 1)) if batch else s.createDataFrame([], STATE)
        pred, state = replay_chunk(rows, state, model, configs)
        pred.write.mode("overwrite").parquet(f"{predictions}/batch={batch}")
        state.write.mode("overwrite").parquet(path(batch))

    writer = games.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint or new_path(spark, "stream"))
    return writer.trigger(**(trigger or {"availableNow": True})).start()
