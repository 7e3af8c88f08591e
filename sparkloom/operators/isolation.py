"""Isolation forest: each tree is grown on a small sample in one task, and scoring is an expression."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.columns import total


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class IsolationModel:
    """trees: nested (column, split, left, right) or the number of rows of a leaf."""

    trees: list
    features: list[str]
    sample: int

    @property
    def limit(self) -> int:
        return math.ceil(math.log2(self.sample)) if self.sample > 1 else 1

    def depth(self, tree, at: int = 0, corrected: bool = False) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(at) + (average_path(tree) if corrected else 0.0))
        column, split, left, right = tree
        return F.when(F.col(self.features[column]) < split, self.depth(left, at + 1, corrected)).otherwise(self.depth(right, at + 1, corrected))

    def score(self, classic: bool = False) -> Column:
        """1 - mean depth / height limit; classic: 2 ** (-mean corrected depth / average path)."""
        mean = total([self.depth(t, 0, classic) for t in self.trees]) / float(len(self.trees))
        return F.pow(F.lit(2.0), -mean / max(average_path(self.sample), 1e-12)) if classic else 1 - mean / float(self.limit)

    def to_text(self) -> str:
        def lines(tree, depth: int) -> list[str]:
            if not isinstance(tree, tuple):
                return ["  " * depth + f"{tree} rows"]
            c, split, left, right = tree
            return ["  " * depth + f"{self.features[c]} < {split:.6g}", *lines(left, depth + 1), *lines(right, depth + 1)]

        return "\n".join(x for i, t in enumerate(self.trees) for x in [f"tree {i}", *lines(t, 0)])


class IsolationForest:
    def __init__(self, trees: int = 20, sample: int = 256, seed: int = 0) -> None:
        self.trees, self.sample, self.seed = trees, sample, seed

    def fit(self, df: DataFrame, features: Sequence[str], key: str) -> IsolationModel:
        """Each tree's sample is its `sample` smallest hashes of seed, tree and key. Each task first keeps its own
        smallest, so a tree's group is small."""
        names, size, seed = list(features), self.sample, self.seed
        drawn = df.select(F.col(key).alias("_k"), *[F.col(c).cast("double").alias(c) for c in names]).select("*", F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1))).alias("_t"))
        drawn = drawn.withColumn("_h", F.xxhash64(F.lit(seed), "_t", "_k"))
        rows = df.count()
        share = min(1.0, 4 * size / max(rows, 1))  # so many are enough but for a chance of about e ** -size
        drawn = drawn.filter(F.pmod("_h", F.lit(1 << 30)) <= int(share * (1 << 30)))
        first = drawn.withColumn("_n", F.row_number().over(Window.partitionBy("_t").orderBy(F.pmod("_h", F.lit(1 << 30)), "_h", "_k"))).filter(F.col("_n") <= size)
        limit = math.ceil(math.log2(size)) if size > 1 else 1

        def plant(pdf):
            import json

            import numpy as np
            import pandas as pd

            t = int(pdf["_t"].iloc[0])
            draw = np.random.default_rng([seed & 0x7FFFFFFF, t])
            data = pdf.sort_values(["_h", "_k"])[names].to_numpy(float)

            def split(x, depth):
                open_ = [i for i in range(x.shape[1]) if len(x) and x[:, i].min() < x[:, i].max()]
                if depth >= limit or len(x) < 2 or not open_:
                    return len(x)
                c = open_[draw.integers(len(open_))]
                at = draw.uniform(x[:, c].min(), x[:, c].max())
                left = x[:, c] < at
                return [c, at, split(x[left], depth + 1), split(x[~left], depth + 1)]

            return pd.DataFrame({"t": [t], "tree": [json.dumps(split(data, 0))]})

        import json

        nested = lambda x: tuple(nested(v) if isinstance(v, list) else v for v in x) if isinstance(x, list) else x
        made = first.groupBy("_t").applyInPandas(plant, "t int, tree string").orderBy("t").collect()
        return IsolationModel([nested(json.loads(r.tree)) for r in made], names, min(size, max(rows, 1)))
