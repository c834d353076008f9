"""Flow tables: dated parquet, in batch and from a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packetflow.session import scratch


def dated(flows: DataFrame) -> DataFrame:
    return flows.withColumn("flow_date", F.to_date("flow_end"))


def write_flows(flows: DataFrame, path: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Write records partitioned by day of flow end.

    Rows are rebalanced on the day first: few files per day, and a busy day is
    split over several tasks.
    """
    dated(flows).hint("rebalance", "flow_date").write.mode(mode).partitionBy("flow_date").format(fmt).save(path)


def stream_flows_to(
    stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, **trigger
) -> StreamingQuery:
    """Write a stream of flow records batch by batch.

    A batch is written to a folder of its own number, so a batch that is run again
    after a failure replaces its first try instead of adding to it.
    """
    def write(batch: DataFrame, number: int) -> None:
        # Tables that the transformation writes on its way go when the batch is stored.
        with scratch(batch.sparkSession):
            out = batch if transform is None else transform(batch)
            dated(out).hint("rebalance", "flow_date").write.mode("overwrite").partitionBy("flow_date").parquet(
                f"{path}/batch={number}"
            )

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()
