"""Forests and boosted trees over operators.tree."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.columns import argmax, total
from sparkloom.operators.keep import discard, written
from sparkloom.operators.tree import DecisionTree, Growth, TreeModel, grow
from sparkloom.operators.walk import Walker

#: Shares of a Poisson(1) count up to 0, 1, 2, ...: how often a bootstrap sample holds a row.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]


def bootstrap_weight(key: str, tree: Column, seed: int) -> Column:
    """How often the tree's sample holds the row: a Poisson(1) count from a hash of seed, tree and key."""
    u = F.pmod(F.xxhash64(F.lit(seed), tree, F.col(key)), F.lit(1 << 40)) / float(1 << 40)
    out = F.lit(len(POISSON))
    for k in reversed(range(len(POISSON))):
        out = F.when(u < POISSON[k], k).otherwise(out)
    return out.cast("double")


@dataclass
class ForestModel:
    trees: list[TreeModel]
    classes: list[str] | None
    key: str
    seed: int
    numbers: list[int]

    def subset(self, which: Sequence[int]) -> ForestModel:
        return ForestModel([self.trees[i] for i in which], self.classes, self.key, self.seed, [self.numbers[i] for i in which])

    def unit(self, i: int) -> Column:
        return self.trees[i].predict_proba() if self.classes else self.trees[i].predict()

    def _values(self) -> np.ndarray:
        """Of every node of all trees: the shares of the classes, or the value."""
        return np.array([t.proba(n.nid) if self.classes else [t.output(n.nid)] for t in self.trees for n in t.nodes], float)

    def predict_proba(self) -> Column:
        """Mean of the trees' shares, from one walk through all of them."""
        return F.transform(Walker(self.trees).summed(self._values()), lambda x: x / float(len(self.trees)))

    def predict(self) -> Column:
        """Class of the largest mean probability (the first of equal ones), or mean value."""
        if self.classes:
            return F.get(F.array(*[F.lit(c) for c in self.classes]), argmax(self.predict_proba()))
        return F.get(Walker(self.trees).summed(self._values()), F.lit(0)) / float(len(self.trees))

    def by_unit(self) -> Column:
        """Each tree's own prediction: an array of classes or of values."""
        if not self.classes:
            return Walker(self.trees).each(self._values()[:, 0])
        best = np.array([float(t.classes.index(t.output(n.nid))) for t in self.trees for n in t.nodes])
        names = F.array(*[F.lit(c) for c in self.classes])
        return F.transform(Walker(self.trees).each(best), lambda i: F.get(names, i.cast("int")))

    def paths(self) -> Column:
        """The numbers of the nodes that a row passes in each tree, from the root on: an array of arrays."""
        spark_paths = F.array(*[F.array(*[F.array(*[F.lit(i).cast("long") for i in t.path(n.nid)]) for n in t.nodes]) for t in self.trees])
        return F.zip_with(spark_paths, Walker(self.trees).nodes(), lambda paths, at: F.get(paths, at.cast("int")))

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        return df.withColumn(prediction, self.predict())

    def out_of_bag(self, df: DataFrame, label: str) -> DataFrame:
        """unit, n, score: each tree on the rows that its sample lacks (accuracy, or R squared), and unit -1 for all
        trees together, each row judged by the trees that lack it."""
        lacks = F.transform(F.array(*[F.lit(t) for t in self.numbers]), lambda t: bootstrap_weight(self.key, t, self.seed) == 0)
        y = F.col(label).cast("string" if self.classes else "double")
        rows = df.withColumns({"_lacks": lacks, "_y": y, "_each": self.by_unit()})
        rows = rows.withColumn("_sum", Walker(self.trees).summed(self._values(), mask=F.col("_lacks")))
        if self.classes:
            whole = F.get(F.array(*[F.lit(c) for c in self.classes]), argmax(F.col("_sum")))
        else:
            whole = F.get("_sum", F.lit(0)) / F.size(F.filter("_lacks", lambda x: x))
        per = F.zip_with("_lacks", "_each", lambda lack, p: F.when(lack, p))
        every = F.concat(F.array(F.when(F.exists("_lacks", lambda x: x), whole)), per)
        judged = rows.select("_y", F.posexplode(every).alias("unit", "p")).filter("p is not null").withColumn("unit", F.col("unit") - 1)
        if self.classes:
            return judged.groupBy("unit").agg(F.count("*").alias("n"), F.avg((F.col("p") == F.col("_y")).cast("double")).alias("score"))
        return judged.groupBy("unit").agg(F.count("*").alias("n"), (1 - F.try_divide(F.sum((F.col("_y") - F.col("p")) ** 2), F.var_pop("_y") * F.count("_y"))).alias("score"))


class RandomForest:
    """units trees, each on a bootstrap sample by key, all grown in the same jobs. features_use defaults to sqrt."""

    def __init__(self, units: int = 10, criterion: str = "gini", seed: int = 0, **how) -> None:
        self.units, self.seed = units, seed
        self.how = Growth(criterion, **({"features_use": "sqrt"} | how), seed=seed)

    def fit(self, df: DataFrame, features: Sequence[str], label: str, key: str) -> ForestModel:
        spread = df.select(*dict.fromkeys([*features, label, key]), F.explode(F.sequence(F.lit(0), F.lit(self.units - 1))).alias("_t"))
        weighted = spread.withColumn("_w", bootstrap_weight(key, F.col("_t"), self.seed)).filter("_w > 0")
        trees = grow(weighted, features, label, self.how, "_w", "_t", self.units)
        return ForestModel(trees, trees[0].classes, key, self.seed, list(range(self.units)))


def score(model, df: DataFrame, label: str) -> float:
    """Accuracy, or R squared."""
    p = model.transform(df, "_p")
    if model.classes:
        return p.agg(F.avg((F.col("_p") == F.col(label).cast("string")).cast("double"))).first()[0]
    return p.agg(1 - F.try_divide(F.sum((F.col("_p") - F.col(label)) ** 2), F.var_pop(label) * F.count(label))).first()[0]


def _subset_scores(model: ForestModel, test: DataFrame, label: str, subsets: Sequence[Sequence[int]]) -> list[float]:
    """Scores of sub-forests in one pass over the test set, from one walk through all trees."""
    which = [list(s) for s in subsets]
    classes = bool(model.classes)

    def fold(at, values):
        out = np.empty((len(at), len(which)))
        for i, trees in enumerate(which):
            mean = sum(values[at[:, t]] for t in trees) / float(len(trees))
            out[:, i] = mean.argmax(1) if classes else mean[:, 0]
        return out

    p = test.select(F.col(label).alias("y"), F.posexplode(Walker(model.trees).column(fold, model._values(), "double")).alias("i", "p"))
    if classes:
        hit = F.get(F.array(*[F.lit(c) for c in model.classes]), F.col("p").cast("int")) == F.col("y").cast("string")
        scores = p.groupBy("i").agg(F.avg(hit.cast("double")))
    else:
        scores = p.groupBy("i").agg(1 - F.try_divide(F.sum((F.col("y") - F.col("p")) ** 2), F.var_pop("y") * F.count("y")))
    found = {r[0]: r[1] for r in scores.collect()}  # one row for each subset
    return [found.get(i) for i in range(len(which))]


def select_by_oob(model: ForestModel, train: DataFrame, test: DataFrame, label: str) -> ForestModel:
    """The first n trees by out-of-bag score, best first, for the n that serves the test set best (the smallest of equal ones)."""
    oob = {r.unit: r.score for r in model.out_of_bag(train, label).collect()}
    order = sorted(range(len(model.trees)), key=lambda i: (-(oob.get(i) if oob.get(i) is not None else -math.inf), i))
    subsets = [order[: n + 1] for n in range(len(order))]
    scores = _subset_scores(model, test, label, subsets)
    return model.subset(subsets[max(range(len(scores)), key=lambda i: (scores[i] if scores[i] is not None else -math.inf, -i))])


def select_at_random(model: ForestModel, test: DataFrame, label: str, seed: int = 0) -> ForestModel:
    """For each n a random subset of n trees; the best on the test set."""
    import random

    draw = random.Random(seed)
    subsets = [sorted(draw.sample(range(len(model.trees)), n + 1)) for n in range(len(model.trees))]
    scores = _subset_scores(model, test, label, subsets)
    return model.subset(subsets[max(range(len(scores)), key=lambda i: (scores[i] if scores[i] is not None else -math.inf, -i))])


# AdaBoost

def unit_weight(error: float, rate: float, classes: int | None) -> float:
    """SAMME weight of a unit; for regression without the number of classes."""
    if error <= 0:
        return math.inf
    return rate * (math.log((1 - error) / error) + (math.log(classes - 1) if classes and classes > 1 else 0.0))


def row_error(y: Column, p: Column, largest: float | None = None) -> Column:
    """0 or 1; for regression the squared error's share of the largest."""
    return (y != p).cast("double") if largest is None else F.coalesce(F.try_divide((y - p) * (y - p), F.lit(float(largest))), F.lit(0.0))


def reweighted(w: Column, alpha: float, error: Column, regression: bool = False) -> Column:
    """Not yet normalised."""
    return w * F.exp(alpha * (error - 1.0 if regression else error))


@dataclass
class BoostModel:
    """A weighted sum of trees; for gradient boosting one list of trees for each class."""

    units: list[list[TreeModel]]
    weights: list[float]
    classes: list[str] | None
    start: float
    gradient: bool

    def scores(self) -> Column:
        """Weighted sums of the units, from one walk through all trees."""
        if self.gradient:
            width = len(self.weights[0]) if self.weights else len(self.classes) if self.classes else 1
            if not self.units:
                return F.array(*[F.lit(self.start)] * width)
            rows = [[w[k] * t.output(n.nid) if i == k else 0.0 for i in range(width)] for u, w in zip(self.units, self.weights, strict=True) for k, t in enumerate(u) for n in t.nodes]
            return Walker([t for u in self.units for t in u]).summed(np.array(rows, float), self.start)
        whole = sum(self.weights)
        rows = [[w / whole * x for x in (u[0].proba(n.nid) if self.classes else [u[0].output(n.nid)])] for u, w in zip(self.units, self.weights, strict=True) for n in u[0].nodes]
        return Walker([u[0] for u in self.units]).summed(np.array(rows, float))

    def predict(self) -> Column:
        return F.get(F.array(*[F.lit(c) for c in self.classes]), argmax(self.scores())) if self.classes else F.get(self.scores(), F.lit(0))

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        return df.withColumn(prediction, self.predict())


class AdaBoost:
    """SAMME over weak trees (depth 1 for classes, 3 for values). A unit no better than chance is left out; a perfect
    one is kept and ends the rounds."""

    def __init__(self, rounds: int = 10, criterion: str = "gini", rate: float = 1.0, depth_max: int | None = None, **how) -> None:
        self.rounds, self.rate, self.regression = rounds, rate, criterion == "variance"
        self.tree = DecisionTree(criterion, depth_max=depth_max or (3 if self.regression else 1), **how)

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> BoostModel:
        """Each round writes the rows with their new weights, so its plan is that of one unit."""
        classes = None if self.regression else sorted(r[0] for r in df.select(F.col(label).cast("string")).distinct().collect())
        y = F.col(label).cast("double" if self.regression else "string")
        rows = written(df.select(*dict.fromkeys([*features, label])).withColumn("_w", F.lit(1.0)))
        units, weights = [], []
        for _ in range(self.rounds):
            model = self.tree.fit(rows, features, label, "_w")
            p = model.predict()
            largest = rows.agg(F.max((y - p) * (y - p))).first()[0] if self.regression else None
            e = row_error(y, p, largest)
            row = rows.agg(F.sum(F.col("_w") * e), F.sum("_w"), F.count("*")).first()
            error = row[0] / row[1]
            alpha = unit_weight(error, self.rate, len(classes) if classes else None)
            if math.isinf(alpha):
                units, weights = [*units, [model]], [*weights, max([1.0, *weights])]
                break
            if alpha <= 0:
                break
            units.append([model])
            weights.append(alpha)
            rows = written(rows.withColumn("_w", reweighted(F.col("_w"), alpha, e, self.regression) * F.lit(row[2] / row[1])), rows)
        discard(rows)
        return BoostModel(units, weights, classes, 0.0, False) if units else BoostModel([[model]], [1.0], classes, 0.0, False)


class GradientBoosting:
    """Trees on residuals: F starts at 0, or at 1/k for classes; each round's trees are scaled by a line search. All
    classes' trees of a round are grown in the same jobs. Prediction is the value, or the class of the largest score."""

    def __init__(self, rounds: int = 10, regression: bool = False, rate: float = 1.0, depth_max: int = 3, **how) -> None:
        self.rounds, self.regression, self.rate = rounds, regression, rate
        self.how = Growth("variance", depth_max=depth_max, **how)

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> BoostModel:
        """Each round adds its trees to the scores and writes them, so its plan is that of one round."""
        classes = None if self.regression else sorted(r[0] for r in df.select(F.col(label).cast("string")).distinct().collect())
        targets = [F.col(label).cast("double")] if self.regression else [(F.col(label).cast("string") == c).cast("double") for c in classes]
        start = 0.0 if self.regression else 1 / len(classes)
        model = BoostModel([], [], classes, start, True)
        state = written(df.select(*dict.fromkeys([*features, label])).withColumn("_f", F.array(*[F.lit(start)] * len(targets))))
        for _ in range(self.rounds):
            left = [self.rate * (t - F.get("_f", F.lit(k))) for k, t in enumerate(targets)]
            rows = state.select(*features, F.posexplode(F.array(*left)).alias("_k", "_r"))
            trees = grow(rows, features, "_r", self.how, tree="_k", trees=len(targets))
            p = F.array(*[t.predict() for t in trees])
            each = state.select(F.posexplode(F.arrays_zip(F.array(*left).alias("r"), p.alias("p"))).alias("_k", "x")).select("_k", "x.r", "x.p")
            sums = {r["_k"]: r for r in each.groupBy("_k").agg(F.sum(F.col("r") * F.col("p")).alias("rp"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.max(F.abs("r")).alias("most")).collect()}
            if not sums or all(r.most == 0 for r in sums.values()):
                break
            model.units.append(trees)
            model.weights.append([line_search(sums[k].rp, sums[k].pp) for k in range(len(targets))])
            added = F.array(*[F.lit(float(w)) for w in model.weights[-1]])
            state = written(state.withColumn("_f", F.zip_with("_f", F.zip_with(added, p, lambda w, x: w * x), lambda f, x: f + x)), state)
        discard(state)
        return model


def line_search(rp: float, pp: float) -> float:
    """The step along p that takes residuals r nearest to 0: sum(r p) / sum(p p)."""
    return rp / pp if pp else 0.0
