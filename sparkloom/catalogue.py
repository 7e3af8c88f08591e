"""The registered queries of the analytics operators, and DuckDB SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.operators.tree import DecisionTree
from sparkloom.plans import cluster_queries, model_queries, prep_queries, tree_queries  # noqa: F401
from sparkloom.plans.registry import QUERIES, SQL  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classification tree of depth 3 over lineitem, as its table of nodes."""
    return DecisionTree("gini", depth_max=3).fit(tree_queries.lines(spark, sf_dir), tree_queries.FEATURES, "kind").to_df(spark)
