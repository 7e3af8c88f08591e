"""Many trees at once: their nodes as flat arrays that Arrow batches of rows walk level by level.

The plan holds one function call, however many trees and nodes there are."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def routes(model: dict, numbers: list[tuple[np.ndarray, np.ndarray]], labels: list[np.ndarray], rows: int) -> np.ndarray:
    """rows x trees: the node, counted over all trees, that each row ends in. numbers are (values, nulls) of each feature,
    labels are category codes, -1 for null."""
    feature, width, keys = model["feature"], model["width"], model["keys"]
    out = np.empty((rows, len(model["roots"])), np.int64)
    for t, root in enumerate(model["roots"]):
        at, moving = np.full(rows, root), np.arange(rows)
        while len(moving):
            here = at[moving]
            f, to = feature[here], np.full(len(here), -1, np.int64)
            for i, (x, null) in enumerate(numbers):
                mine = np.flatnonzero(f == i)
                if len(mine):
                    v, n = x[moving[mine]], here[mine]
                    low = v <= model["threshold"][n]  # NaN is larger than any number, as in Spark
                    to[mine] = np.where(null[moving[mine]], -1, np.where(low, model["low"][n], model["high"][n]))
            for i, codes in enumerate(labels, len(numbers)):
                mine = np.flatnonzero(f == i)
                if len(mine):
                    c, n = codes[moving[mine]], here[mine]
                    place = np.minimum(np.searchsorted(keys, n * width + c), len(keys) - 1)
                    to[mine] = np.where(c < 0, -1, np.where(keys[place] == n * width + c, model["childs"][place], model["other"][n]))
            gone = to >= 0
            moving = moving[gone]
            at[moving] = to[gone]
        out[:, t] = at
    return out


class Walker:
    """trees: TreeModels over any features. A row goes down as in TreeModel.route(): to the child whose condition it meets,
    and it stays where it meets none (null or an unknown category)."""

    def __init__(self, trees: Sequence) -> None:
        roots = np.cumsum([0, *(len(t.nodes) for t in trees)])[:-1]
        nodes = [(int(root), n) for root, t in zip(roots, trees, strict=True) for n in t.nodes]
        self.numbers = sorted({n.feature for _, n in nodes if n.op in ("<=", ">")})
        self.labels = sorted({n.feature for _, n in nodes if n.op in ("in", "not in")})
        features = {f: i for i, f in enumerate([*self.numbers, *self.labels])}
        feature, threshold = np.full(len(nodes), -1, np.int32), np.full(len(nodes), np.nan)
        low, high, other = (np.full(len(nodes), -1, np.int64) for _ in range(3))
        words: dict[str, int] = {}
        listed: dict[tuple[int, int], int] = {}
        for root, n in nodes:
            at, here = root + n.nid, root + n.parent
            if n.feature is None:
                continue
            feature[here] = features[n.feature]
            if n.op in ("<=", ">"):
                threshold[here] = float(n.value)
                (low if n.op == "<=" else high)[here] = at
            elif n.op == "in":
                listed |= {(here, words.setdefault(str(v), len(words))): at for v in n.value}
            else:
                other[here] = at
                for v in n.value:
                    listed.setdefault((here, words.setdefault(str(v), len(words))), -1)
        width = len(words) + 1  # the last code is that of unknown words
        pairs = sorted((h * width + c, at) for (h, c), at in listed.items()) or [(-1, -1)]
        self.model = {"roots": roots, "feature": feature, "threshold": threshold, "low": low, "high": high, "other": other, "words": words, "width": width, "keys": np.array([k for k, _ in pairs], np.int64), "childs": np.array([at for _, at in pairs], np.int64)}

    def column(self, fold: Callable, values, kind: str, extra: Column | None = None) -> Column:
        """fold(routes, values) of each batch of rows, a matrix with a line for each row, as an array column. extra: an array
        column with an element for each tree, which fold gets as a matrix too."""
        held, n, masked = SparkSession.getActiveSession().sparkContext.broadcast((self.model, values)), len(self.numbers), extra is not None

        @F.arrow_udf(f"array<{kind}>")
        def run(*columns):
            import pyarrow as pa

            (model, values), rows = held.value, len(columns[-1])
            more = () if not masked else (columns[-1].flatten().to_numpy(zero_copy_only=False).reshape(rows, len(model["roots"])),)
            numbers = [(c.fill_null(0.0).to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False)) for c in columns[:n]]
            labels = []
            for c in columns[n:-1]:
                seen = c.dictionary_encode()
                codes = np.array([*(model["words"].get(w, model["width"] - 1) for w in seen.dictionary.to_pylist()), -1], np.int64)
                labels.append(codes[seen.indices.fill_null(-1).to_numpy(zero_copy_only=False)])
            found = fold(routes(model, numbers, labels, rows), values, *more)
            return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))

        columns = [F.col(f"`{f}`").cast("double") for f in self.numbers] + [F.col(f"`{f}`").cast("string") for f in self.labels]
        return run(*columns, extra if masked else F.lit(0))  # the last one also says how many rows there are

    def nodes(self) -> Column:
        """array<bigint>: for each tree the number of its node that the row ends in."""
        return self.column(lambda at, roots: at - roots, self.model["roots"], "bigint")

    def each(self, values: np.ndarray) -> Column:
        """array<double>: for each tree the value of the node (values: one for each node of all trees)."""
        return self.column(lambda at, values: values[at], values, "double")

    def summed(self, values: np.ndarray, start: float = 0.0, mask: Column | None = None) -> Column:
        """array<double>: start and the values (nodes x width) of all trees, added in their order. mask, an array of
        booleans, says which trees count for the row."""

        def fold(at, values, mask=None):
            out = np.full((len(at), values.shape[1]), start)
            for t in range(at.shape[1]):
                part = values[at[:, t]]
                out += part if mask is None else np.where(mask[:, t, None], part, 0.0)
            return out

        return self.column(fold, values, "double", mask)
