"""Checks of parameters and of tables before an operator runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTINUOUS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
DISCRETE = ("boolean", "string")


def of_type(value, *types: type) -> None:
    """Exactly one of these types: an int doesn't pass for a float, nor a bool for an int."""
    if type(value) not in types:
        raise TypeError(f"{value!r} is a {type(value).__name__}, not {' or '.join(t.__name__ for t in types)}")


def within(value, low=None, high=None, open_low: bool = False) -> None:
    if low is not None and (value < low or open_low and value == low) or high is not None and value > high:
        raise ValueError(f"{value!r} is not between {low} and {high}")


def columns(df: DataFrame, wanted: list[str], how: str = "right") -> None:
    """how: len (as many), left (df has no others), right (df has them all), equal (the same)."""
    have, want = set(df.columns), set(wanted)
    good = {"len": len(have) == len(want), "left": have <= want, "right": want <= have, "equal": have == want}[how]
    if not good:
        raise ValueError(f"columns {sorted(have)} don't match {sorted(want)} ({how})")


def continuity(df: DataFrame, names: list[str]) -> dict[str, bool]:
    """Whether each column is continuous; types that are neither continuous nor discrete raise."""
    found = {}
    for name, kind in df.select(*names).dtypes:
        base = kind.split("(")[0]
        if base not in CONTINUOUS + DISCRETE:
            raise TypeError(f"{name} has type {kind}; features are numbers, booleans or strings")
        found[name] = base in CONTINUOUS
    return found


def no_nulls(df: DataFrame, names: list[str]) -> None:
    first = df.filter(" or ".join(f"`{n}` is null" for n in names)).limit(1).collect()
    if first:
        raise ValueError(f"nulls in one of {names}")


def unique_key(df: DataFrame, key: str) -> None:
    if df.groupBy(key).count().filter("count > 1").limit(1).collect():
        raise ValueError(f"{key} repeats")
