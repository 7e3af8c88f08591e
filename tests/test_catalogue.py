"""Every registered analytics query against its DuckDB SQL, on the smallest tables."""

import duckdb
import pytest

from sparkloom.catalogue import QUERIES, SQL, flagship

DIR = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def rows(table):
    names = sorted(table.columns)
    key = lambda v: "null" if v is None or v != v else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(key(v) for v in r) for r in table[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(SQL)))
def test_query_agrees_with_sql(spark, name):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    found, wanted = QUERIES[name](spark, DIR).toPandas(), connection.execute(SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_flagship(spark):
    assert flagship(spark, DIR).count() >= 3


def fresh_entry():
    import importlib
    import sys

    sys.modules.pop("__spark_entry__", None)
    return importlib.import_module("__spark_entry__")


def test_entry_without_the_corpus_operators(monkeypatch):
    import sys

    for name in ("sparkloom.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    entry = fresh_entry()
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)
    monkeypatch.undo()
    fresh_entry()


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace

    from sparkloom.operators.keep import shared_folder

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))
    assert shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "hdfs:///shared"), sparkContext=context)) == "hdfs:///shared"
