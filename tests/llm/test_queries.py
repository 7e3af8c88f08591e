"""The registered corpus queries against DuckDB, and the pipeline's contract."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import queries
from tests.llm.test_operators import awkward, prose, removed, shingles

DIR = "/root/testdata/sf0.001"


def rows(table):
    names = sorted(table.columns)
    key = lambda v: "null" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(key(v) for v in r) for r in table[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    assert rows(queries.QUERIES[name](spark, DIR).toPandas()) == rows(connection.execute(queries.SQL[name]).df())


def test_pipeline_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert packed.select("doc_id").distinct().count() == before


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Awkward rows with columns whose names the operators use themselves, one of them with a dot."""
    rows = [(d, t, "en", "s", len(t) if t is not None else None, 1, "x", 0.5) for d, t in [*awkward(), (1, awkward()[0][1]), (None, None), (70, prose(70, 60) + " moron scum"), (71, prose(71, 30))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, `key.h` string, score double").repartition(3)


def brute_roots(rows, k=5):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, []).append(shingles(t, k))
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


def texts_of(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "") for r in df.collect())


def test_pipeline_stages_agree_with_brute_force(spark, odd_docs, tmp_path):
    train = [(1000 + i, prose(3000 + i, 40) + (" scum moron" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    extra = spark.createDataFrame([(d, t) for d, t, _ in train], "doc_id long, text string").select("doc_id", "text", *[F.lit(None).cast(f.dataType).alias(f.name) for f in odd_docs.schema[2:]])
    docs = odd_docs.union(extra)
    spark.createDataFrame([(d, t, 0) for d, _, t in train], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    leak = prose(71, 30)
    spark.createDataFrame([(1, leak), (2, None), (3, "short")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)

    out = stages["toxicity"](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert texts_of(out) == [x for x in texts_of(docs) if "scum" not in x[1]]

    out = stages["minhash_near_dedup"](spark, odd_docs, str(tmp_path))
    rows = texts_of(odd_docs)
    root = brute_roots([(None if d == -1 else d, t) for d, t in rows])
    assert out.columns == odd_docs.columns
    assert texts_of(out) == sorted([x for x in rows if x[0] == -1] + list({x for x in rows if x[0] != -1 and root[x[0]] == x[0]}))

    out = stages["suffix_array_dedup"](spark, odd_docs, str(tmp_path))
    assert out.columns == odd_docs.columns
    rest = sorted((d, np.frombuffer(t.encode(), np.uint8)[~g].tobytes().decode("utf-8", "ignore")) for (d, t), g in zip(rows, removed([t.encode() for _, t in rows]), strict=True))
    assert texts_of(out) == rest
    assert out.filter("n_chars <> char_length(text)").count() == 0

    out = stages["benchmark_decontamination"](spark, odd_docs, str(tmp_path))
    assert out.columns == odd_docs.columns and {r.doc_id for r in odd_docs.select("doc_id").collect()} - {r.doc_id for r in out.select("doc_id").collect()} == {71}

    out = stages["best_fit_packing"](spark, odd_docs, str(tmp_path))
    assert out.filter("piece = 0").count() == odd_docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs.limit(0), str(tmp_path)).count() == 0


def test_a_module_that_is_missing_inside_is_an_error(monkeypatch):
    import importlib
    import sys

    import sparkloom.llm

    for name in ("__spark_entry__", "sparkloom.llm.queries"):
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.delattr(sparkloom.llm, "queries", raising=False)
    monkeypatch.setitem(sys.modules, "sparkloom.llm.warc", None)
    with pytest.raises(ModuleNotFoundError):
        importlib.import_module("__spark_entry__")
