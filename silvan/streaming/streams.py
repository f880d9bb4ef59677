"""Rows that arrive over time: collected into a table to train on, and scored as they come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.model import GbtModel


def ingest(stream: DataFrame, path: str, checkpoint: str, finish: bool = True) -> StreamingQuery:
    """Appends a stream's rows to a Parquet table, exactly once by its checkpoint. finish: take what is there and stop."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(availableNow=True).start() if finish else writer.start()


def score(stream: DataFrame, model: GbtModel, kind: str = "normal") -> DataFrame:
    """The stream with predictions; stateless, so any sink and output mode will do."""
    return model.predict(stream, kind)


def monitor(scored: DataFrame, time: str, loss: Column, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean loss in windows of event time, with rows that come later than `late` left out."""
    return scored.withWatermark(time, late).groupBy(F.window(time, window).alias("window")).agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "loss", "n")
