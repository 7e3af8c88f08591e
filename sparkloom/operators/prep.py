"""Data preparation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.columns import number
from sparkloom.validate import continuity, within

BUCKETS = 1 << 16


def split_train_test(df: DataFrame, key: str, frac: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test): exactly round(frac * n) rows go to train, chosen by a hash of key and seed.

    Rows are counted by hash bucket; only the rows of the bucket where the count is reached are ranked, so there is no
    global sort. Rows with equal keys and no other difference fall on either side."""
    within(frac, 0, 1)
    hashed = df.withColumn("_hash", F.xxhash64(F.lit(seed), key)).withColumn("_bucket", F.pmod("_hash", F.lit(BUCKETS)))
    counts = sorted((r["_bucket"], r["count"]) for r in hashed.groupBy("_bucket").count().collect())  # BUCKETS rows at most
    want = round(frac * sum(n for _, n in counts))
    cut, left = BUCKETS, 0
    for bucket, n in counts:
        if want < n:
            cut, left = bucket, want
            break
        want -= n
    edge = hashed.filter(F.col("_bucket") == cut).withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", key)))
    names = df.columns
    train = hashed.filter(F.col("_bucket") < cut).select(names).unionByName(edge.filter(F.col("_rank") <= left).select(names))
    test = hashed.filter(F.col("_bucket") > cut).select(names).unionByName(edge.filter(F.col("_rank") > left).select(names))
    return train, test


def distinct_values(df: DataFrame, column: str) -> list:
    """A discrete column's values in order. They name columns, so there must be few."""
    return [r[0] for r in df.select(column).distinct().orderBy(column).collect()]


def one_hot(df: DataFrame, column: str, values: Sequence | None = None) -> DataFrame:
    from sparkloom.functions import columns

    return df.select("*", *columns.one_hot(column, values if values is not None else distinct_values(df, column)))


def with_constant(df: DataFrame) -> DataFrame:
    """Puts x0 = 1.0 first; a table that has an x0 stays as it is."""
    return df if "x0" in df.columns else df.select(F.lit(1.0).alias("x0"), "*")


def label_mapping(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """column, label, label_index: each column's distinct values in their own order (numbers by size), from 0."""
    parts = []
    for name in names:
        distinct = df.select(F.col(name).alias("v")).filter("v is not null").distinct()
        parts.append(distinct.select(F.lit(name).alias("column"), F.col("v").cast("string").alias("label"), (F.row_number().over(Window.partitionBy(F.lit(name)).orderBy("v")) - 1).alias("label_index")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def label_to_index(df: DataFrame, name: str, mapping: DataFrame) -> DataFrame:
    """df with the column replaced by its label's number; null for labels that mapping lacks."""
    pairs = mapping.filter(F.col("column") == name).select(F.col("label").alias("_label"), F.col("label_index").alias("_index"))
    return df.join(pairs, F.col(name).cast("string") == F.col("_label"), "left").withColumn(name, F.col("_index")).drop("_label", "_index")


def index_to_label(df: DataFrame, name: str, mapping: DataFrame | None) -> DataFrame:
    """The inverse; numbers that mapping lacks stay, as text. Without a mapping df stays as it is."""
    if mapping is None:
        return df
    pairs = mapping.filter(F.col("column") == name).select(F.col("label").alias("_label"), F.col("label_index").alias("_index"))
    return df.join(pairs, F.col(name) == F.col("_index"), "left").withColumn(name, F.coalesce("_label", F.col(name).cast("string"))).drop("_label", "_index")


def equal_width_edges(df: DataFrame, names: Sequence[str], bins: int = 10) -> dict[str, list[float]]:
    """bins + 1 edges from each column's smallest to its largest value."""
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(names) for n, f in (("a", F.min), ("b", F.max))]).first()
    return {c: [row[f"a_{i}"] + (row[f"b_{i}"] - row[f"a_{i}"]) * k / bins for k in range(bins)] + [row[f"b_{i}"]] for i, c in enumerate(names)}


def scaler_reference(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """feature, min, max, mean, std (of a sample) in one pass."""
    row = df.agg(*[F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in names])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`.min").alias("min"), F.col(f"`{c}`.max").alias("max"), F.col(f"`{c}`.mean").alias("mean"), F.col(f"`{c}`.std").alias("std")) for c in names])).alias("x")).select("x.*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def weight_sums(df: DataFrame, column: str, weight: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.sum(F.col(weight).cast("double")).alias("weight"))


def subsets(values: DataFrame, column: str, smallest: int = 1, largest: int | None = None, split_mode: bool = False) -> DataFrame:
    """subset (number), value, chosen (0/1): all subsets of the distinct values but the empty and the full one.

    Bit i of the number says whether value i, in order, is chosen. split_mode keeps one of each pair of complements:
    those without the last value. Meant for few values: there are 2**k - 2 subsets."""
    listed = values.select(F.col(column).alias("value")).distinct()
    ranked = listed.select(F.row_number().over(Window.orderBy("value")).alias("i"), "value")
    k = ranked.count()
    masks = values.sparkSession.range(1, (1 << (k - 1 if split_mode else k)) - (0 if split_mode else 1)).withColumnRenamed("id", "subset")
    out = masks.select("subset", F.bit_count("subset").alias("_n"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("i"))
    out = out.filter(F.col("_n").between(smallest, largest if largest else k))
    return out.join(F.broadcast(ranked), "i").select("subset", "value", F.expr("cast(shiftright(subset, i - 1) & 1 as int)").alias("chosen"))


def pairs(values: DataFrame, column: str, ordered: bool = False) -> DataFrame:
    """positive, negative: pairs of different distinct values, in both orders if ordered."""
    v = values.select(F.col(column).alias("positive")).distinct()
    w = v.withColumnRenamed("positive", "negative")
    return v.join(w, v["positive"] != w["negative"] if ordered else v["positive"] < w["negative"])


def describe(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """feature, n, mean, std, min, q1, median, q3, max."""
    stats = lambda c: F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), *[F.percentile(c, number(q)).alias(n) for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))], F.max(c).cast("double").alias("max"))
    row = df.agg(*[stats(c).alias(f"s{i}") for i, c in enumerate(names)])
    return row.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(names))])).alias("x")).select("x.*")


def to_matrix(df: DataFrame, row: str, column: str, value: str, values: Sequence) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).agg(F.first(value)).na.fill(0)


def continuity_table(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(continuity(df, list(names)).items()), "feature string, continuous boolean")
