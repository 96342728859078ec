"""History kept up by a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossa.operators.state import HISTORY, history


def latest_items(events: DataFrame) -> DataFrame:
    """The latest event of each user and item, as a streaming aggregation (update mode)."""
    return events.groupBy("user_id", "item_id").agg(F.max(F.struct("ts", "event_id")).alias("at")).select("user_id", "item_id", "at.ts", "at.event_id")


def run_history(events: DataFrame, target: str, checkpoint: str, limit: int = HISTORY) -> StreamingQuery:
    """Writes each micro-batch's latest items to target; history_table reads the views from there."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return latest_items(events).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history_table(spark, target: str, limit: int = HISTORY) -> DataFrame:  # noqa: ANN001
    """The history views over what the stream has written."""
    return history(spark.read.parquet(target), limit)
