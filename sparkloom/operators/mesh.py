"""Models on a grid of points, for contours and decision borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def mesh(spark: SparkSession, x: tuple[float, float], y: tuple[float, float], steps: int = 51, names: tuple[str, str] = ("x", "y")) -> DataFrame:
    """i, j and the two coordinates of steps * steps points from the first to the last value of either range."""
    i, j = F.floor(F.col("id") / steps).cast("int"), (F.col("id") % steps).cast("int")
    at = lambda k, ends: F.lit(float(ends[0])) + k * ((ends[1] - ends[0]) / max(1, steps - 1))
    return spark.range(steps * steps).select(i.alias("i"), j.alias("j"), at(i, x).alias(names[0]), at(j, y).alias(names[1]))


def around(df: DataFrame, x: str, y: str, steps: int = 51, margin: float = 0.2) -> DataFrame:
    """The mesh over the ranges of two columns of df, with a margin on each side. Without rows there is no range: ValueError."""
    row = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if row[0] is None or row[2] is None:
        raise ValueError("no rows to lay a mesh around")
    return mesh(df.sparkSession, (row[0] - margin, row[1] + margin), (row[2] - margin, row[3] + margin), steps, (x, y))


def grid_predict(points: DataFrame, value: Column, name: str = "z") -> DataFrame:
    """The mesh with a model's value, such as model.predict() or a share of model.predict_proba()."""
    return points.withColumn(name, value)
