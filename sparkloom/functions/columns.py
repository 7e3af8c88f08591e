"""Expressions over numeric columns and arrays."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x) -> Column:
    return F.lit(float(x))


def total(columns: Sequence[Column], start: float = 0.0) -> Column:
    out = number(start)
    for c in columns:
        out = out + c
    return out


def doubles(values: Sequence[float]) -> Column:
    return F.array(*[number(v) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), number(0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), number(0), lambda s, x: s + x)


def linear_kernel(a: Column, b: Column) -> Column:
    return dot(a, b)


def polynomial_kernel(a: Column, b: Column, shift: float = 1.0, degree: int = 3) -> Column:
    return F.pow(dot(a, b) + shift, number(degree))


def rbf_kernel(a: Column, b: Column, sigma: float = 1.0) -> Column:
    return F.exp(-squared_distance(a, b) / (2 * sigma * sigma))


def logsumexp(x: Column) -> Column:
    """log(sum(exp(x))) of an array, without overflow."""
    top = F.array_max(x)
    return top + F.log(F.aggregate(x, number(0), lambda s, v: s + F.exp(v - top)))


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    whole = F.aggregate(x, number(0), lambda s, v: s + F.exp(v - top))
    return F.transform(x, lambda v: F.exp(v - top) / whole)


def sigmoid(z: Column) -> Column:
    """1 / (1 + exp(-z)), without overflow on either side."""
    return F.when(z >= 0, 1 / (1 + F.exp(-F.abs(z)))).otherwise(F.exp(-F.abs(z)) / (1 + F.exp(-F.abs(z))))


def one_hot(column: str, values: Sequence) -> list[Column]:
    """A 0/1 column named after each value."""
    return [(F.col(column) == F.lit(v)).cast("int").alias(str(v)) for v in values]


def min_max(column: str, low: float, high: float) -> Column:
    """From 0 at low to 1 at high; null where they are equal."""
    return F.try_divide(F.col(column) - number(low), number(high) - number(low))


def standard(column: str, mean: float, std: float) -> Column:
    return F.try_divide(F.col(column) - number(mean), number(std))


def edge_text(edge: float) -> str:
    """An interval bound: three decimals, or three significant digits below 0.1; no trailing zeros."""
    edge = float(edge)
    if edge and abs(edge) < 0.1:
        return f"{float(f'{edge:.3g}')}"
    return f"{round(edge, 3)}"


def interval_labels(edges: Sequence[float]) -> list[str]:
    return [f"({edge_text(a)}, {edge_text(b)}]" for a, b in zip(edges[:-1], edges[1:], strict=True)]


def bin_index(column: str, edges: Sequence[float], open_bounds: bool = True) -> Column:
    """Number, from 0, of the interval (a, b] that holds the value. The first edge belongs to the first interval;
    values outside go to the outer intervals, or to none (null) unless open_bounds."""
    x, last = F.col(column).cast("double"), len(edges) - 2
    out = F.when(x <= number(edges[1]), 0) if open_bounds else F.when(x < number(edges[0]), None).when(x <= number(edges[1]), 0)
    for i, edge in enumerate(edges[2:], 1):
        out = out.when(x <= number(edge) if i < last or not open_bounds else F.lit(True), i)
    return F.when(x.isNotNull(), out)


def bin_label(column: str, edges: Sequence[float], open_bounds: bool = True) -> Column:
    """The interval's text, or 'nan' for a value in none."""
    labels = F.array(*[F.lit(x) for x in interval_labels(edges)])
    return F.coalesce(F.get(labels, bin_index(column, edges, open_bounds)), F.lit("nan"))


def polynomials(features: Sequence[str], degree: int, cross: bool = False) -> list[Column]:
    """x^2..x^degree as name^k; with cross also x1^a * x2^b for a + b up to degree, as x1^a_x2^b."""
    out = [F.pow(F.col(c), number(k)).alias(f"{c}^{k}") for c in features for k in range(2, degree + 1)]
    if cross:
        for i, x in enumerate(features):
            for y in features[i + 1 :]:
                out += [(F.pow(F.col(x), number(a)) * F.pow(F.col(y), number(k - a))).alias(f"{x}^{a}_{y}^{k - a}") for k in range(2, degree + 1) for a in range(1, k)]
    return out


def entropy(shares: Sequence[Column]) -> Column:
    """-sum(p log2 p); shares of 0 add nothing."""
    return total([F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in shares])


def gini(shares: Sequence[Column]) -> Column:
    return 1 - total([p * p for p in shares])


def gray(pixel: Column) -> Column:
    """Brightness of an [r, g, b] pixel: (11 r + 16 g + 5 b) / 32."""
    return (11 * F.get(pixel, F.lit(0)) + 16 * F.get(pixel, F.lit(1)) + 5 * F.get(pixel, F.lit(2))) / 32


def argmax(x: Column) -> Column:
    """Place, from 0, of the first largest element."""
    return F.array_position(x, F.array_max(x)).cast("int") - 1


def finite(x: float) -> bool:
    return math.isfinite(x)


def round_even(x: Column, digits: int = 0) -> Column:
    """Rounded to so many digits; halves go to the even neighbour."""
    return F.bround(x, digits)
