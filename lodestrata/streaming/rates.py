"""The streaming form of windowed rates, on Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.stats import window_rates


def rates(events: DataFrame, ts: str, width: str, seconds: int, late: str) -> DataFrame:
    """Windowed rates of a stream: state is kept for windows within `late` of the newest event; later events are dropped by
    the watermark, and a window is given once it is closed (append) or each time it changes (update, complete)."""
    return window_rates(events.withWatermark(ts, late), ts, width, seconds)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder that the session names; below the warehouse where it names none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(spark: SparkSession, stream: DataFrame, mode: str = "complete", folder: str | None = None) -> DataFrame:
    """Runs a stream over all there is and stops: its last result (complete), or all it gave (append), as a table.

    A batch that is run again writes the same folder again, so a restart from the checkpoint neither loses nor doubles rows.
    """
    folder = folder or shared_folder(spark)

    def save(batch: DataFrame, number: int) -> None:
        where = f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}"
        batch.write.mode("overwrite").parquet(where)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(save).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
