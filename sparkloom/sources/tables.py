"""Delimited text, literals, generators and databases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, path: str, schema: str, separator: str = ",", header: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("sep", separator).option("header", header).csv(path)


def read_whitespace(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns separated by runs of spaces or tabs; blank lines are skipped."""
    return split_whitespace(spark.read.text(path), schema)


def split_whitespace(lines: DataFrame, schema: str) -> DataFrame:
    """As read_whitespace, from a table of lines (value)."""
    fields = T.StructType.fromDDL(schema).fields
    cells = lines.filter(F.trim("value") != "").select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("c"))
    return cells.select(*[F.get("c", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def literal(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def blobs(spark: SparkSession, n: int, centers: Sequence[Sequence[float]], spread: float = 1.0, seed: int = 0) -> DataFrame:
    """id, point, label: normal clouds about the centers."""
    rows = spark.range(n).withColumn("label", (F.col("id") % len(centers)).cast("int"))
    middle = F.get(F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centers]), F.col("label"))
    noise = F.array(*[F.randn(seed + i) * spread for i in range(len(centers[0]))])
    return rows.select("id", F.zip_with(middle, noise, lambda a, b: a + b).alias("point"), "label")


def circles(spark: SparkSession, n: int, factor: float = 0.5, noise: float = 0.08, seed: int = 0) -> DataFrame:
    """id, point, label: an outer ring (0) of radius 1 and an inner one (1) of radius factor."""
    label = (F.col("id") % 2).cast("int")
    turn, radius = F.rand(seed) * 6.283185307179586, F.when(label == 1, factor).otherwise(1.0)
    return spark.range(n).withColumns({"_t": turn, "label": label, "_r": radius}).select("id", F.array(F.col("_r") * F.cos("_t") + F.randn(seed + 1) * noise, F.col("_r") * F.sin("_t") + F.randn(seed + 2) * noise).alias("point"), "label")


def moons(spark: SparkSession, n: int, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """id, point, label: two half rings that reach into each other."""
    rows = spark.range(n).withColumns({"_t": F.rand(seed) * 3.141592653589793, "label": (F.col("id") % 2).cast("int")})
    x = F.when(F.col("label") == 0, F.cos("_t")).otherwise(1 - F.cos("_t"))
    y = F.when(F.col("label") == 0, F.sin("_t")).otherwise(0.5 - F.sin("_t"))
    return rows.select("id", F.array(x + F.randn(seed + 1) * noise, y + F.randn(seed + 2) * noise).alias("point"), "label")


def read_sql(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query that a database runs; its JDBC driver must be on the class path."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def write_sql(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


def databases(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW DATABASES")


def tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "name string, kind string, temporary boolean")


def columns(spark: SparkSession, table: str) -> DataFrame:
    rows = [(c.name, c.dataType, c.nullable) for c in spark.catalog.listColumns(table)]
    return spark.createDataFrame(rows, "name string, type string, nullable boolean")
