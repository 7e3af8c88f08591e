"""Fitted models over streams. A model's prediction is a projection, so it needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_stream(stream: DataFrame, model, prediction: str = "prediction") -> DataFrame:
    """Adds model.predict() to a streaming (or static) table."""
    return stream.withColumn(prediction, model.predict())


def score_drift(scored: DataFrame, time: str, prediction: str = "prediction", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window start, prediction, n: predictions by event time; rows later than the watermark are left out."""
    return scored.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "prediction", "n")
