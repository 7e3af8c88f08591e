"""Naive Bayes over categories: probabilities are counted, nothing is smoothed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class BayesModel:
    """priors (class, p, n), evidence (feature, value, p, n), conditionals (feature, value, class, p, n)."""

    priors: DataFrame
    evidence: DataFrame
    conditionals: DataFrame
    features: list[str]

    def predict_proba(self, df: DataFrame, key: str) -> DataFrame:
        """key, class, p for each row and class. Values that training lacks are skipped; a value that never went with a
        class rules the class out; if all are ruled out each gets an equal share."""
        long_ = df.select(key, *unpivoted(self.features)).select(key, "x.*")
        known = long_.join(F.broadcast(self.evidence.select("feature", "value", F.col("p").alias("px"))), ["feature", "value"])
        classes = self.priors.select("class", F.col("p").alias("prior"))
        grid = known.join(F.broadcast(classes))  # a row for each class: the classes are few
        full = grid.join(F.broadcast(self.conditionals.select("feature", "value", "class", F.col("p").alias("pxy"))), ["feature", "value", "class"], "left")
        logs = full.groupBy(key, "class").agg(F.first("prior").alias("prior"), F.sum(F.log(F.col("pxy") / F.col("px"))).alias("l"), F.max(F.col("pxy").isNull().cast("int")).alias("out"))
        everyone = df.select(key).join(F.broadcast(classes)).join(logs.drop("prior"), [key, "class"], "left")
        raw = everyone.select(key, "class", F.when(F.coalesce("out", F.lit(0)) == 1, 0.0).otherwise(F.exp(F.coalesce("l", F.lit(0.0)) + F.log("prior"))).alias("r"))
        by = Window.partitionBy(key)
        return raw.select(key, "class", F.coalesce(F.try_divide("r", F.sum("r").over(by)), 1 / F.count("*").over(by)).alias("p"))

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        """key, prediction: the likeliest class, the first in order of equal ones (to ten digits)."""
        p = self.predict_proba(df, key)
        return p.groupBy(key).agg(F.min(F.struct((-F.round("p", 10)).alias("p"), "class")).alias("m")).select(key, F.col("m.class").alias("prediction"))


def unpivoted(features: Sequence[str]) -> list:
    return [F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])).alias("x")]


class NaiveBayes:
    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> BayesModel:
        """All tables come from one count by feature, value and class."""
        counts = df.select(F.col(label).cast("string").alias("class"), *unpivoted(features)).groupBy("class", "x.feature", "x.value").agg(F.count("*").alias("n"))
        first = counts.filter(F.col("feature") == features[0]).groupBy("class").agg(F.sum("n").alias("n"))
        rows = first.agg(F.sum("n").alias("rows"))
        priors = first.join(F.broadcast(rows)).select("class", (F.col("n") / F.col("rows")).alias("p"), "n")
        evidence = counts.groupBy("feature", "value").agg(F.sum("n").alias("n")).join(F.broadcast(rows)).select("feature", "value", (F.col("n") / F.col("rows")).alias("p"), "n")
        conditionals = counts.join(F.broadcast(first.select("class", F.col("n").alias("of"))), "class").select("feature", "value", "class", (F.col("n") / F.col("of")).alias("p"), "n")
        return BayesModel(priors, evidence, conditionals, list(features))
