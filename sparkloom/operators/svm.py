"""Support vector machines, by sequential minimal optimisation over all rows. Up to `most` rows are solved in one task for
each classifier. Of more rows, a linear kernel is solved by interior points, whose steps are sums over all rows; for other
kernels each round solves the rows that violate the optimality conditions most, and Spark keeps every row's multiplier and
gradient."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.columns import argmax, dot, doubles, linear_kernel, number, polynomial_kernel, rbf_kernel, total
from sparkloom.operators.keep import discard, written


def gram(a: np.ndarray, b: np.ndarray, kernel: str, shift: float, degree: int, sigma: float) -> np.ndarray:
    inner = a @ b.T
    if kernel == "linear":
        return inner
    if kernel == "poly":
        return (inner + shift) ** degree
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * inner
    return np.exp(-np.maximum(d, 0) / (2 * sigma * sigma))


def solve(k: np.ndarray, y: np.ndarray, p: np.ndarray, c: float, tol: float, steps: int, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """alpha and b that minimise a'Qa / 2 + p'a with Q = y y' K, 0 <= a <= c and y'a = 0. With a start, p is the gradient
    there and y'a stays as it is.

    Each step moves the pair that violates the optimality conditions most, until no pair does by more than tol."""
    n = len(y)
    alpha, grad = np.zeros(n) if start is None else start.astype(float).copy(), p.astype(float).copy()
    for _ in range(steps):
        v = -y * grad
        up = ((y > 0) & (alpha < c)) | ((y < 0) & (alpha > 0))
        low = ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < c))
        if not up.any() or not low.any():
            break
        i = int(np.where(up, v, -np.inf).argmax())
        gap = v[i] - v
        if gap[low].max() <= tol:
            break
        curve = np.maximum(k[i, i] + k.diagonal() - 2 * k[i], 1e-12)
        j = int(np.where(low & (gap > 0), gap * gap / curve, -np.inf).argmax())
        step = gap[j] / curve[j]
        step = min(step, c - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else c - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        grad += y * step * (k[i] - k[j])
    v = -y * grad
    free = (alpha > 1e-9) & (alpha < c - 1e-9)
    if free.any():
        return alpha, float(v[free].mean())
    up = ((y > 0) & (alpha < c)) | ((y < 0) & (alpha > 0))
    low = ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < c))
    ends = [x for x in (v[up].max() if up.any() else None, v[low].min() if low.any() else None) if x is not None]
    return alpha, float(np.mean(ends)) if ends else 0.0


#: A linear kernel over so many features at most is solved by interior points, whose steps need sums of their squares. A step
#: goes to such a share of the way to the border.
WIDE, SHORT = 512, 0.995


def direction(s, p, u, du, mu: float, a, t, z, v, first=(0.0, 0.0, 0.0)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How a, z and v change where u = x w changes by du, so that z a and v t (t = c - a) become mu; first, the changes of
    the step without mu, corrects for their products."""
    low, high = mu - first[0] * first[1], mu + first[0] * first[2]
    da = (low / a - high / t - s * (u + du) - p) / (z / a + v / t)
    return da, (low - z * da) / a - z, (high + v * da) / t - v


def replay(x: np.ndarray, s: np.ndarray, p: np.ndarray, c: float, path: Sequence[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """a, c - a and their multipliers z, v of rows x (the last column is 1) after the steps of a path (w, dw without mu, dw,
    mu, length). They follow from the path and the row alone, so no step has to store them."""
    a, t, z, v = np.full(len(x), c / 2), np.full(len(x), c / 2), np.maximum(p, 0) + 1, np.maximum(-p, 0) + 1
    if path:
        u, first, du = (x @ np.stack([k[i] for k in path], 1) for i in range(3))
        for i, (*_, mu, far) in enumerate(path):
            begun = direction(s, p, u[:, i], first[:, i], 0.0, a, t, z, v)
            da, dz, dv = direction(s, p, u[:, i], du[:, i], mu, a, t, z, v, begun)
            a, t, z, v = a + far * da, t - far * da, z + far * dz, v + far * dv
    return a, t, z, v


def reach(a, t, z, v, da, dz, dv) -> float:
    """The length of a step that stays inside, 1 at most."""
    return SHORT / max(SHORT, *(float((-d / of).max(initial=0)) for d, of in ((da, a), (-da, t), (dz, z), (dv, v))))


def interior(what: str, x: np.ndarray, s: np.ndarray, p: np.ndarray, c: float, path: list, w: np.ndarray, *steps) -> np.ndarray:
    """One pass of a step at w over some rows; all but the last number are added over the rows, the last is their smallest.
    newton: x'x / D, both right sides (without mu, times mu), sum(s a x), the complementarity, twice the rows, the squares of
    the residuals. first: the correction of the right side and the complementarity as a polynomial of the step's length
    (steps: dw). last: only the length (steps: dw without mu, dw, mu)."""
    a, t, z, v = replay(x, s, p, c, path)
    weight, u = 1 / (z / a + v / t), x @ w
    if what == "newton":
        apart = s * u + p
        return np.concatenate([((x * weight[:, None]).T @ x).ravel(), x.T @ (-s * apart * weight), x.T @ (s * (1 / a - 1 / t) * weight), x.T @ (s * a), [z @ a + v @ t, 2.0 * len(x), float(((apart - z + v) ** 2).sum()), 1.0]])
    da, dz, dv = first = direction(s, p, u, x @ steps[0], 0.0, a, t, z, v)
    if what == "first":
        return np.concatenate([x.T @ (-s * (da * dz / a + da * dv / t) * weight), [z @ a + v @ t, dz @ a + z @ da + dv @ t - v @ da, dz @ da - dv @ da, reach(a, t, z, v, *first)]])
    return np.array([reach(a, t, z, v, *direction(s, p, u, x @ steps[1], steps[2], a, t, z, v, first))])


def right_sides(f: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float, float]:
    """From the sums of newton: the matrix, both right sides, the mean complementarity, residual and imbalance."""
    d = len(w)
    moved, (gap, n, apart, _) = f[d * d + 2 * d : -4], f[-4:]
    lag = moved - np.append(w[:-1], 0)
    return f[: d * d].reshape(d, d) + np.diag(np.append(np.ones(d - 1), 1e-12)), f[d * d : d * d + d] + lag, f[d * d + d : d * d + 2 * d], gap / n, float(np.sqrt(apart / n)), abs(lag[-1]) / n


#: So many support vectors become an expression. Beyond, their matrix is sent to the tasks up to so many bytes; larger sets stay
#: a table, whose blocks of rows meet the blocks of the rows to score.
EXPRESSION, SENT, BLOCK = 32, 64 << 20, 4096


@dataclass
class SVMModel:
    """vectors: for each classifier its support vectors, their signed weights alpha * y, and b. mode: binary, ovr,
    tree (classes halved again and again) or regression. table: the support vectors (g, weight, x) where they are too many
    for vectors, which then hold b alone; such a model scores with score(), or transform() with a key."""

    vectors: list[tuple[np.ndarray, np.ndarray, float]]
    classes: list[str] | None
    mode: str
    splits: list[tuple[list[int], list[int], int, int]]
    kernel: str
    shift: float
    degree: int
    sigma: float
    table: DataFrame | None = None

    def kernel_column(self, a: Column, b: Column) -> Column:
        return {"linear": lambda: linear_kernel(a, b), "poly": lambda: polynomial_kernel(a, b, self.shift, self.degree), "rbf": lambda: rbf_kernel(a, b, self.sigma)}[self.kernel]()

    def decision(self, point: Column, which: int = 0) -> Column:
        """sum(alpha y K(x, support vector)) + b; a linear kernel needs only the normal vector, many vectors are multiplied
        with Arrow batches of rows."""
        if self.table is not None:
            raise ValueError("the support vectors are a table: use score(), or transform() with a key")
        x, weight, b = self.vectors[which]
        if self.kernel == "linear":
            w = weight @ x if len(x) else np.zeros(0)
            return dot(point, doubles(w)) + b if len(w) else number(b)
        if len(x) > EXPRESSION:
            return self._product(point, x, weight, b)
        rows = F.array(*[F.struct(doubles(v).alias("v"), number(a).alias("a")) for v, a in zip(x, weight, strict=True)])
        return F.aggregate(rows, number(b), lambda s, r: s + r["a"] * self.kernel_column(point, r["v"])) if len(x) else number(b)

    def _product(self, point: Column, x: np.ndarray, weight: np.ndarray, b: float) -> Column:
        held, how = SparkSession.getActiveSession().sparkContext.broadcast((x, weight)), (self.kernel, self.shift, self.degree, self.sigma)

        @F.arrow_udf("double")
        def run(points):
            import pyarrow as pa

            x, weight = held.value
            rows = points.flatten().to_numpy(zero_copy_only=False).reshape(len(points), -1)
            return pa.array(np.concatenate([products(rows[i : i + 1024], x, weight, *how) for i in range(0, len(rows), 1024)] or [np.zeros(0)]) + b)

        return run(point.cast("array<double>"))

    def score(self, df: DataFrame, key: str, point: str) -> DataFrame:
        """key, u: the decision values of all classifiers, from products of blocks of rows with blocks of support vectors.
        key must be unique."""
        rows = df.select(F.col(key).alias("key"), F.col(point).cast("array<double>").alias("x"))
        if self.table is None:
            return rows.select(F.col("key").alias(key), F.array(*[self.decision(F.col("x"), i) for i in range(len(self.vectors))]).alias("u"))
        held = self.table
        n, m = (max(1, -(-t.count() // BLOCK)) for t in (rows, held))
        rows = rows.withColumn("i", F.pmod(F.xxhash64("key"), F.lit(n))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        held = held.withColumn("j", F.pmod(F.xxhash64("g", "x"), F.lit(m)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        met = rows.select("i", "j", "key", "x", F.lit(None).cast("int").alias("g"), F.lit(None).cast("double").alias("weight")).unionByName(held.select("i", "j", F.lit(None).cast(rows.schema["key"].dataType).alias("key"), "x", "g", "weight"))
        how, count = (self.kernel, self.shift, self.degree, self.sigma), len(self.vectors)

        def one(table):
            import pyarrow as pa
            import pyarrow.compute as pc

            ours = pc.is_null(table["g"])
            matrix = lambda t: t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
            mine, theirs = table.filter(ours), table.filter(pc.invert(ours))
            g, weight, u = theirs["g"].to_numpy(), theirs["weight"].to_numpy(), np.zeros((len(mine), count))
            if len(mine) and len(theirs):
                a, b = matrix(mine), matrix(theirs)
                for c in np.unique(g).tolist():
                    u[:, c] = products(a, b[g == c], weight[g == c], *how)
            return pa.table({"key": mine["key"], **{f"u{c}": pa.array(u[:, c]) for c in range(count)}})

        kind = rows.schema["key"].dataType.simpleString()
        parts = met.groupBy("i", "j").applyInArrow(one, ", ".join([f"key {kind}", *(f"u{c} double" for c in range(count))]))
        sums = parts.groupBy("key").agg(*[F.sum(f"u{c}").alias(f"u{c}") for c in range(count)])
        return sums.select(F.col("key").alias(key), F.array(*[F.col(f"u{c}") + float(v[2]) for c, v in enumerate(self.vectors)]).alias("u"))

    def scores(self, point: Column) -> Column:
        """For ovr and binary the decision values by class."""
        if self.mode == "binary":
            u = self.decision(point)
            return F.array(-u, u)
        return F.array(*[self.decision(point, i) for i in range(len(self.vectors))])

    def _label(self, u) -> Column:
        """From u(which), the decision values: the regression value; the class of the largest score (the first of equal ones),
        or the one that the tree ends in. A decision of 0 or more is the second class."""
        if self.mode == "regression":
            return u(0)
        if self.mode == "binary":
            return F.when(u(0) >= 0, self.classes[1]).otherwise(self.classes[0])
        if self.mode == "ovr":
            return F.get(F.array(*[F.lit(c) for c in self.classes]), argmax(F.array(*[u(i) for i in range(len(self.vectors))])))

        def walk(at: int) -> Column:
            left, right, go_left, go_right = self.splits[at]
            end = lambda side, go: F.lit(self.classes[side[0]]) if len(side) == 1 else walk(go)
            return F.when(u(at) >= 0, end(right, go_right)).otherwise(end(left, go_left))

        return walk(0)

    def predict(self, point: str) -> Column:
        return self._label(lambda which: self.decision(F.col(point), which))

    def transform(self, df: DataFrame, point: str, prediction: str = "prediction", key: str | None = None) -> DataFrame:
        if self.table is None:
            return df.withColumn(prediction, self.predict(point))
        if key is None:
            raise ValueError("the support vectors are a table: name a unique key")
        scored = self.score(df, key, point).select(F.col(key).alias("_key"), self._label(lambda which: F.get("u", F.lit(which))).alias(prediction))
        return df.join(scored, F.col(key) == F.col("_key"), "left").drop("_key")


def products(a: np.ndarray, b: np.ndarray, weight: np.ndarray, kernel: str, shift: float, degree: int, sigma: float) -> np.ndarray:
    """sum(weight K(a, b)) for each row of a."""
    return gram(a, b, kernel, shift, degree, sigma) @ weight if len(a) else np.zeros(0)


def split_classes(k: int) -> list[tuple[list[int], list[int], int, int]]:
    """Breadth first: (first half, second half, classifier for each half) of the sorted classes."""
    out: list = []
    queue = [list(range(k))]
    while queue:
        group = queue.pop(0)
        half = len(group) // 2
        parts = [group[:half], group[half:]]
        goes = []
        for part in parts:
            goes.append(len(out) + len(queue) + 1 if len(part) > 1 else -1)
            if len(part) > 1:
                queue.append(part)
        out.append((*parts, *goes))
    return out


class SVM:
    """mode: ovr, tree or regression (with eps). kernel: linear, poly or rbf."""

    def __init__(self, c: float = 1.0, kernel: str = "rbf", mode: str = "ovr", eps: float = 0.1, tol: float = 1e-2, steps: int = 10_000, shift: float = 1.0, degree: int = 3, sigma: float = 1.0, most: int = 2000, rounds: int = 200) -> None:
        self.c, self.kernel, self.mode, self.eps, self.tol, self.steps = c, kernel, mode, eps, tol, steps
        self.shift, self.degree, self.sigma, self.most, self.rounds = shift, degree, sigma, most, rounds

    def fit(self, df: DataFrame, key: str, point: str, label: str) -> SVMModel:
        """Learns from all rows; those beyond `most` make it work in rounds."""
        classes, splits = None, []
        x = df.select(F.col(key).alias("key"), F.col(point).cast("array<double>").alias("x"), F.col(label).alias("label"))
        if self.mode == "regression":
            mode, targets = "regression", [F.struct(F.lit(0).alias("g"), F.col("label").cast("double").alias("y"))]
        else:
            text = F.col("label").cast("string")
            classes = sorted(r[0] for r in x.select(text).distinct().collect())
            place = argmax_of(text, classes)
            if len(classes) == 2:
                mode, targets = "binary", [F.struct(F.lit(0).alias("g"), F.when(place == 1, 1.0).otherwise(-1.0).alias("y"))]
            elif self.mode == "ovr":
                mode, targets = "ovr", [F.struct(F.lit(i).alias("g"), F.when(place == i, 1.0).otherwise(-1.0).alias("y")) for i in range(len(classes))]
            else:
                mode, splits = "tree", split_classes(len(classes))
                targets = [F.struct(F.lit(i).alias("g"), F.when(place.isin(b), 1.0).when(place.isin(a), -1.0).alias("y")) for i, (a, b, *_) in enumerate(splits)]
        long_ = x.select("key", "x", F.explode(F.array(*targets)).alias("t")).select("key", "x", "t.g", "t.y").filter("y is not null")
        c, kernel, eps, tol, steps, how, regression = self.c, self.kernel, self.eps, self.tol, self.steps, (self.shift, self.degree, self.sigma), mode == "regression"

        def one(pdf):
            import pandas as pd

            pdf = pdf.sort_values("key")
            points, y = np.stack(pdf["x"].to_numpy()).astype(float), pdf["y"].to_numpy(float)
            k = gram(points, points, kernel, *how)
            if regression:
                n = len(y)
                alpha, b = solve(np.tile(k, (2, 2)), np.r_[np.ones(n), -np.ones(n)], np.r_[eps - y, eps + y], c, tol, steps)
                weight = alpha[:n] - alpha[n:]
            else:
                alpha, b = solve(k, y, -np.ones(len(y)), c, tol, steps)
                weight = alpha * y
            held = np.abs(weight) > 1e-9
            return pd.DataFrame({"g": [int(pdf["g"].iloc[0])], "x": [points[held].ravel().tolist()], "weight": [weight[held].tolist()], "b": [b]})

        if len(x.select("key").head(self.most + 1)) > self.most:
            width = len(x.select("x").first()[0])
            vectors, table = (self.in_steps(long_, regression, width), None) if kernel == "linear" and width <= WIDE else self.in_rounds(long_, regression)
            return SVMModel(vectors, classes, mode, splits, self.kernel, self.shift, self.degree, self.sigma, table)
        made = {r.g: r for r in long_.groupBy("g").applyInPandas(one, "g int, x array<double>, weight array<double>, b double").collect()}
        width = len(x.select("x").first()[0])
        vectors = [(np.array(made[g].x, float).reshape(-1, width), np.array(made[g].weight, float), made[g].b) for g in sorted(made)]
        return SVMModel(vectors, classes, mode, splits, self.kernel, self.shift, self.degree, self.sigma)

    def in_steps(self, long_: DataFrame, regression: bool, width: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """The normal vector and b of every classifier g over all rows (key, x, g, y), by interior points with Mehrotra's correction: each
        of some 25 steps takes three passes, which return sums; the rows are read only."""
        c, tol, eps, d = self.c, self.tol, self.eps, width + 1
        rows = written(long_.groupBy("key", "x").agg(F.collect_list(F.struct("g", "y")).alias("t")).select("x", "t"))
        context = rows.sparkSession.sparkContext
        rows = written(rows.repartition(max(context.defaultParallelism, -(-rows.count() // 50_000))), rows)
        groups = sorted(r[0] for r in rows.select(F.explode("t.g")).distinct().collect())

        def over(what: str, todo: dict) -> dict[int, np.ndarray]:
            def run(batches):
                import pyarrow as pa

                held = {}
                for batch in batches:
                    lists = batch.column("t")
                    at, flat = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten()
                    g_of, y_of = flat.field("g").to_numpy(), flat.field("y").to_numpy()
                    points = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    points = np.column_stack([points, np.ones(len(points))])
                    for g, more in todo.items():
                        mine = g_of == g
                        x, y = points[at[mine]], y_of[mine]
                        if not len(y):
                            continue
                        if regression:
                            side = np.repeat([1.0, -1.0], len(y))
                            found = interior(what, np.concatenate([x, x]), side, eps - side * np.r_[y, y], c, *more)
                        else:
                            found = interior(what, x, y, -np.ones(len(y)), c, *more)
                        held[g] = np.append(held[g][:-1] + found[:-1], min(held[g][-1], found[-1])) if g in held else found
                for g, found in held.items():
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([found.tolist()])], names=["g", "f"])

            told: dict[int, list] = {}
            for r in rows.mapInArrow(run, "g int, f array<double>").select("g", F.posexplode("f").alias("i", "f")).groupBy("g", "i").agg(F.sum("f").alias("all"), F.min("f").alias("least")).orderBy("g", "i").collect():
                told.setdefault(r.g, []).append(r)
            return {g: np.array([r["all"] for r in rs[:-1]] + [rs[-1]["least"]]) for g, rs in told.items()}

        w, paths, open_ = {g: np.zeros(d) for g in groups}, {g: [] for g in groups}, list(groups)
        for _ in range(self.rounds):
            sides = {g: right_sides(f, w[g]) for g, f in over("newton", {g: (paths[g], w[g]) for g in open_}).items()}
            open_ = [g for g in open_ if sides[g][3] > 1e-6 * tol * max(1.0, c) or sides[g][4] > 1e-3 * tol or sides[g][5] > 1e-6 * c]
            if not open_:
                break
            begun = {g: np.linalg.solve(sides[g][0], sides[g][1]) for g in open_}
            steps = {}
            for g, f in over("first", {g: (paths[g], w[g], begun[g]) for g in open_}).items():
                matrix, plain, scaled, mean, *_ = sides[g]
                left = (f[d] + f[-1] * (f[d + 1] + f[-1] * f[d + 2])) / f[d]
                mu = mean * max(left, 0.0) ** 3
                steps[g] = (begun[g], np.linalg.solve(matrix, plain + mu * scaled + f[:d]), mu)
            for g, f in over("last", {g: (paths[g], w[g], *steps[g]) for g in open_}).items():
                paths[g].append((w[g], *steps[g], float(f[-1])))
                w[g] = w[g] + f[-1] * steps[g][1]
        if open_:
            warnings.warn(f"not at the optimum after {self.rounds} rounds", stacklevel=3)
        discard(rows)
        return [(w[g][None, :-1], np.ones(1), float(w[g][-1])) for g in groups]

    def in_rounds(self, long_: DataFrame, regression: bool) -> tuple[list[tuple[np.ndarray, np.ndarray, float]], DataFrame | None]:
        """The vectors of every classifier g over all rows (key, x, g, y), as a table where they are over SENT bytes. A round takes the `most` multipliers whose
        pairs violate the conditions most, solves them in a task for each g and carries the others' gradients on."""
        c, kernel, tol, steps, how, most = self.c, self.kernel, self.tol, self.steps, (self.shift, self.degree, self.sigma), max(2, self.most)
        both = [F.struct(F.lit(1.0).alias("s"), (self.eps - F.col("y")).alias("p")), F.struct(F.lit(-1.0).alias("s"), (self.eps + F.col("y")).alias("p"))]
        terms = F.array(*both) if regression else F.array(F.struct(F.col("y").alias("s"), F.lit(-1.0).alias("p")))
        state = long_.withColumn("row", F.monotonically_increasing_id()).withColumn("t", F.explode(terms)).select("g", "row", "x", "t.s", F.lit(0.0).alias("alpha"), F.col("t.p").alias("grad"))
        context = state.sparkSession.sparkContext
        # a table of few files is dealt out, or one task would carry all gradients on; row stays as it is now
        first = written(state)
        state = written(first.repartition(max(context.defaultParallelism, -(-first.count() // 50_000)), "g", "row"), first)
        # a linear kernel carries one normal vector on instead of all the rows that moved
        carry = (lambda step, points: ((step @ points)[None], np.ones(1))) if kernel == "linear" else (lambda step, points: (points, step))
        v = -F.col("s") * F.col("grad")
        up = ((F.col("s") > 0) & (F.col("alpha") < c)) | ((F.col("s") < 0) & (F.col("alpha") > 0))
        low = ((F.col("s") > 0) & (F.col("alpha") > 0)) | ((F.col("s") < 0) & (F.col("alpha") < c))
        free = (F.col("alpha") > 1e-9) & (F.col("alpha") < c - 1e-9)

        def one(pdf):
            import pandas as pd

            pdf = pdf.sort_values(["row", "s"])
            points, s, alpha = np.stack(pdf["x"].to_numpy()).astype(float), pdf["s"].to_numpy(float), pdf["alpha"].to_numpy(float)
            new, _ = solve(gram(points, points, kernel, *how), s, pdf["grad"].to_numpy(float), c, tol, steps, alpha)
            moved = new != alpha
            return pd.DataFrame({"g": [int(pdf["g"].iloc[0])], "row": [pdf["row"].to_numpy()[moved].tolist()], "s": [s[moved].tolist()], "alpha": [new[moved].tolist()], "step": [(s * (new - alpha))[moved].tolist()], "x": [points[moved].ravel().tolist()]})

        for i in range(self.rounds + 1):
            ends = {r.g: r for r in state.groupBy("g").agg(F.max(F.when(up, v)).alias("high"), F.min(F.when(low, v)).alias("low"), F.avg(F.when(free, v)).alias("free")).collect()}
            apart = [g for g, r in ends.items() if r.high is not None and r.low is not None and r.high - r.low > tol]
            if not apart or i == self.rounds:
                break
            parts = [state.filter((F.col("g") == g) & side).orderBy(order, "row", "s").limit(most // 2) for g in apart for side, order in ((up, v.desc()), (low, v.asc()))]
            chosen = parts[0]
            for part in parts[1:]:
                chosen = chosen.union(part)
            moves = {r.g: (dict(zip(zip(r.row, r.s, strict=True), r.alpha, strict=True)), np.array(r.step), np.array(r.x, float).reshape(len(r.step), -1)) for r in chosen.dropDuplicates(["g", "row", "s"]).groupBy("g").applyInPandas(one, "g int, row array<long>, s array<double>, alpha array<double>, step array<double>, x array<double>").collect() if r.step}

            sent = context.broadcast({g: (np.array([k for k, _ in new]), np.array([k for _, k in new]), np.array(list(new.values())), *carry(step, points)) for g, (new, step, points) in moves.items()})

            def carried(batches, sent=sent):
                import pyarrow as pa

                for batch in batches:
                    column = lambda name, at=batch: at.column(name).to_numpy(zero_copy_only=False)
                    alpha, grad, s, g_of, row = column("alpha").copy(), column("grad").copy(), column("s"), column("g"), column("row")
                    points = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    for g, (rows, sides, new, against, step) in sent.value.items():
                        at = np.flatnonzero(g_of == g)
                        for some in np.array_split(at, -(-len(at) // 1024)) if len(at) else ():
                            grad[some] += s[some] * (gram(points[some], against, kernel, *how) @ step)
                        for side in (-1.0, 1.0):
                            known, values = rows[sides == side], new[sides == side]
                            if len(known) and len(at):
                                order = np.argsort(known)
                                known, values = known[order], values[order]
                                mine = at[s[at] == side]
                                place = np.minimum(np.searchsorted(known, row[mine]), len(known) - 1)
                                hit = known[place] == row[mine]
                                alpha[mine[hit]] = values[place[hit]]
                    yield pa.RecordBatch.from_arrays([{"alpha": pa.array(alpha), "grad": pa.array(grad)}.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)

            state = written(state.mapInArrow(carried, state.schema), state)
            sent.unpersist()
        if apart:
            warnings.warn(f"not at the optimum after {self.rounds} rounds", stacklevel=3)
        table = None
        weights = state.groupBy("g", "row").agg(F.first("x").alias("x"), F.sum(F.col("s") * F.col("alpha")).alias("weight")).filter("abs(weight) > 1e-9")
        if kernel == "linear":
            sums = weights.select("g", "weight", F.posexplode("x").alias("i", "x")).groupBy("g", "i").agg(F.sum(F.col("weight") * F.col("x")).alias("w")).collect()
            held = {g: [(1.0, [r.w for r in sorted((r for r in sums if r.g == g), key=lambda r: r.i)])] for g in {r.g for r in sums}}
        else:
            held, weights = {}, written(weights)
            size = weights.agg(F.coalesce(F.sum(8 * F.size("x") + 16), F.lit(0))).first()[0]
            if size > SENT:
                table = weights.select("g", "weight", "x")
            else:
                for r in weights.orderBy("g", "row").collect():
                    held.setdefault(r.g, []).append((r.weight, r.x))
                discard(weights)
        discard(state)
        out = []
        for g, r in sorted(ends.items()):
            found = [e for e in (r.high, r.low) if e is not None]
            b = r.free if r.free is not None else float(np.mean(found)) if found else 0.0
            rows = held.get(g, [])
            out.append((np.array([x for _, x in rows], float).reshape(len(rows), -1) if rows else np.zeros((0, 1)), np.array([a for a, _ in rows], float), b))
        return out, table


def argmax_of(text: Column, classes: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in classes]), text).cast("int") - 1


def hinge_cost(df: DataFrame, y: str, u: Column, w: Sequence[float], c: float) -> DataFrame:
    """cost: c * sum(max(0, 1 - y u)) + w'w / 2."""
    return df.agg((c * F.sum(F.greatest(number(0), 1 - F.col(y) * u)) + 0.5 * total([number(v * v) for v in w])).alias("cost"))
