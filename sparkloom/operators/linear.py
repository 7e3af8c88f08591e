"""Linear and logistic regression; gradients and moments are Spark aggregates, theta stays on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.columns import argmax, number, sigmoid, total
from sparkloom.operators.optimizers import Optimizer

PATIENCE = 10
#: Shares are clipped by this much before their logarithm is taken.
TINY = 1e-12


def moments(df: DataFrame, names: Sequence[str], label: str) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y, with a constant first, from one pass."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    y = F.col(label).cast("double")
    k = len(x)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*[F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i, j in pairs], *[F.sum(x[i] * y).alias(f"b{i}") for i in range(k)]).first()
    a = np.zeros((k, k))
    for (i, j), v in zip(pairs, row, strict=False):
        a[i, j] = a[j, i] = v
    return a, np.array(row[len(pairs) :], float)


def dot_product(theta: Sequence[float], names: Sequence[str]) -> Column:
    return total([number(t) * F.col(c).cast("double") for t, c in zip(theta[1:], names, strict=True)], float(theta[0]))


@dataclass
class LinearModel:
    names: list[str]
    theta: np.ndarray
    history: list[dict] = field(default_factory=list)

    def predict(self) -> Column:
        return dot_product(self.theta, self.names)

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        return df.withColumn(prediction, self.predict())

    def cost(self, df: DataFrame, label: str) -> float:
        """Half the mean squared error."""
        return df.agg(F.avg((self.predict() - F.col(label)) ** 2) / 2).first()[0]

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame([(n, float(t)) for n, t in zip(["x0", *self.names], self.theta, strict=True)], "feature string, theta double")


def batch(df: DataFrame, key: str | None, seed: int, step: int, share: float) -> DataFrame:
    """A step's share of the rows, by hash of key, seed and step; all rows without a key."""
    if key is None or share >= 1:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), F.lit(step), key), F.lit(1 << 20)) < int(share * (1 << 20)))


def descend(df: DataFrame, names: Sequence[str], wanted: Sequence[Column], link, cost, how: Optimizer, steps: int, l2: float, key: str | None, seed: int, share: float, penalise_constant: bool = True) -> tuple[np.ndarray, list[dict]]:
    """theta (target x feature) by gradient steps: all targets' gradients and costs of a step are one aggregate over the
    projected columns, which are kept between the steps. theta comes as one broadcast row, so every step has the same
    plan and compiled code.

    Ends after PATIENCE steps without a lower cost, or when the cost is not finite; the best theta is returned."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in names]]
    k, n = len(wanted), len(x)
    theta, history = np.zeros((k, n)), []
    best, least, since = theta, np.inf, 0
    targets = [F.col(f"_y{j}") for j in range(k)]
    df = df.select(*([F.col(key).alias("_key")] if key else []), *[c.alias(f"_x{i}") for i, c in enumerate(x) if i], *[y.cast("double").alias(f"_y{j}") for j, y in enumerate(wanted)]).persist()
    x = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(1, n)]]
    for i in range(steps + 1):
        at = how.point(theta)
        made = []
        row = df.sparkSession.createDataFrame([tuple(at.ravel().tolist())], ", ".join(f"_w{j}_{m} double" for j in range(k) for m in range(n)))
        for j, y in enumerate(targets):
            p = link(reduce(lambda s, m: s + F.col(f"_w{j}_{m}") * x[m], range(1, n), F.col(f"_w{j}_0")))
            made += [F.sum((p - y) * c).alias(f"g{j}_{m}") for m, c in enumerate(x)]
            made.append(F.sum(cost(p, y)).alias(f"c{j}"))
        row = batch(df, key and "_key", seed, i, share).crossJoin(F.broadcast(row)).agg(F.count("*").alias("n"), *made).first()
        if not row.n:
            continue
        parts = np.array([v if v is not None else np.nan for v in row[1:]], float).reshape(k, n + 1) / row.n
        value = float(parts[:, n].sum())
        history.append({"iteration": i, "cost": value})
        if not np.isfinite(value):
            break
        best, least, since = (theta, value, 0) if value < least else (best, least, since + 1)
        if since >= PATIENCE or i == steps:
            break
        ridge = at * l2 / row.n
        if not penalise_constant:
            ridge[:, 0] = 0
        theta = how.step(theta, parts[:, :n] + ridge)
    df.unpersist()
    return best, history


class LinearRegression:
    """solver: ne (normal equation) or sgd (gradient steps, full batch unless a key and a share are given)."""

    def __init__(self, solver: str = "ne", l2: float = 0.0, penalise_constant: bool = True, optimizer: Optimizer | None = None, steps: int = 100, key: str | None = None, share: float = 1.0, seed: int = 0) -> None:
        if solver not in ("ne", "sgd"):
            raise ValueError("solver is ne or sgd")
        self.solver, self.l2, self.penalise, self.how = solver, l2, penalise_constant, optimizer or Optimizer()
        self.steps, self.key, self.share, self.seed = steps, key, share, seed

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> LinearModel:
        names = list(features)
        if self.solver == "ne":
            a, b = moments(df, names, label)
            ridge = self.l2 * np.eye(len(b))
            if not self.penalise:
                ridge[0, 0] = 0
            return LinearModel(names, np.linalg.solve(a + ridge, b))
        theta, history = descend(df, names, [F.col(label).cast("double")], lambda z: z, lambda p, y: (p - y) * (p - y) / 2, self.how, self.steps, self.l2, self.key, self.seed, self.share, self.penalise)
        return LinearModel(names, theta[0], history)


def log_loss(p: Column, y: Column) -> Column:
    q = F.least(F.greatest(p, number(TINY)), number(1 - TINY))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


@dataclass
class LogisticModel:
    """theta (classifier x feature). ovr: a classifier for each class; ovo: one for each pair (first, second)."""

    names: list[str]
    classes: list[str]
    mode: str
    pairs: list[tuple[int, int]]
    theta: np.ndarray
    history: list[dict] = field(default_factory=list)

    def predict_proba(self) -> Column:
        """Shares of the classes; for pairs, each classifier gives p to its first class and 1 - p to its second."""
        p = [sigmoid(dot_product(t, self.names)) for t in self.theta]
        if len(self.classes) == 1:
            return F.array(F.lit(1.0))
        if self.mode == "ovr":
            votes = p if len(self.classes) > 2 else [1 - p[0], p[0]]
        else:
            votes = [total([p[i] if a == c else 1 - p[i] for i, (a, b) in enumerate(self.pairs) if c in (a, b)]) for c in range(len(self.classes))]
        whole = total(votes)
        return F.array(*[v / whole for v in votes])

    def predict(self) -> Column:
        """The class of the largest share, the first of equal ones."""
        return F.get(F.array(*[F.lit(c) for c in self.classes]), argmax(self.predict_proba()))

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        return df.withColumn(prediction, self.predict())


class LogisticRegression:
    """mode ovr or ovo. Pairwise classifiers see all rows; those of other classes have the soft target 0.5.

    Of two classes ovr has a classifier for the second. With one class, which is predicted always, either mode has one
    classifier for it. Rows without a label are left out; without labelled rows fit raises ValueError."""

    def __init__(self, mode: str = "ovo", l2: float = 0.0, optimizer: Optimizer | None = None, steps: int = 100, key: str | None = None, share: float = 1.0, seed: int = 0) -> None:
        self.mode, self.l2, self.how, self.steps, self.key, self.share, self.seed = mode, l2, optimizer or Optimizer(rate=0.1), steps, key, share, seed

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> LogisticModel:
        y = F.col(label).cast("string")
        df = df.filter(y.isNotNull())
        classes = sorted(r[0] for r in df.select(y).distinct().collect())
        k = len(classes)
        if not k:
            raise ValueError("no row has a label")
        pairs = [(i, j) for i in range(k) for j in range(i + 1, k)] if self.mode == "ovo" else []
        if pairs:
            targets = [F.when(y == classes[i], 1.0).when(y == classes[j], 0.0).otherwise(0.5) for i, j in pairs]
        else:
            targets = [(y == c).cast("double") for c in (classes[1:] if k == 2 else classes)]
        theta, history = descend(df, list(features), targets, sigmoid, log_loss, self.how, self.steps, self.l2, self.key, self.seed, self.share)
        return LogisticModel(list(features), classes, self.mode, pairs, theta, history)
