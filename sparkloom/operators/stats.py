"""Statistics and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def correlation(df: DataFrame, names: Sequence[str], target: str | None = None) -> DataFrame:
    """x, y, r: Pearson correlations of all pairs of columns, or of each with target, in one pass."""
    pairs = [(a, b) for a in names for b in ([target] if target else names)]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def r_squared(y: str, p: str) -> Column:
    """1 - SSE / SST of a group; below 0 if the mean predicts better, null if y is constant."""
    return 1 - F.try_divide(F.sum((F.col(y) - F.col(p)) ** 2), F.var_pop(y) * F.count(y))


def adjusted_r_squared(y: str, p: str, k: int) -> Column:
    """k: number of parameters; 0 where there are as many rows."""
    n = F.count(y)
    return F.when(n == k, 0.0).otherwise(1 - (1 - r_squared(y, p)) * F.try_divide(n - 1, n - k))


def accuracy(y: str, p: str) -> Column:
    return F.avg((F.col(y).cast("string") == F.col(p).cast("string")).cast("double"))


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """predicted, actual, share of all rows, for each pair of the classes that occur on either side."""
    seen = df.select(F.col(p).cast("string").alias("predicted"), F.col(y).cast("string").alias("actual"))
    counts = seen.groupBy("predicted", "actual").count()
    classes = counts.select(F.explode(F.array("predicted", "actual")).alias("c")).distinct()
    n = counts.agg(F.sum("count").alias("n"))
    grid = classes.withColumnRenamed("c", "predicted").join(classes.withColumnRenamed("c", "actual"))  # classes squared
    out = grid.join(counts, ["predicted", "actual"], "left").join(F.broadcast(n))
    return out.select("predicted", "actual", (F.coalesce("count", F.lit(0)) / F.col("n")).alias("share"))


def pair_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """both, only_y, only_p, neither: pairs of rows that are together in y and p. Contingency counts give them, no pairs are made."""
    choose = lambda c: F.sum(c * (c - 1) / 2)
    cells = df.groupBy(y, p).agg(F.count("*").cast("double").alias("n"))
    both = cells.agg(choose(F.col("n")).alias("both"), F.sum("n").alias("rows"))
    in_y = cells.groupBy(y).agg(F.sum("n").alias("n")).agg(choose(F.col("n")).alias("in_y"))
    in_p = cells.groupBy(p).agg(F.sum("n").alias("n")).agg(choose(F.col("n")).alias("in_p"))
    one = both.join(in_y).join(in_p)  # one row each
    rest = F.col("rows") * (F.col("rows") - 1) / 2 - F.col("in_y") - F.col("in_p") + F.col("both")
    return one.select("both", (F.col("in_y") - F.col("both")).alias("only_y"), (F.col("in_p") - F.col("both")).alias("only_p"), rest.alias("neither"))


def jaccard(df: DataFrame, y: str, p: str) -> DataFrame:
    return pair_counts(df, y, p).select(F.try_divide("both", F.col("both") + F.col("only_y") + F.col("only_p")).alias("jaccard"))
