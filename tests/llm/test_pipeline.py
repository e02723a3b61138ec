"""The pipeline's stages against plain versions, and the registered queries with SQL."""

import collections
import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark import cloudpickle

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from keyloft.llm import queries  # noqa: E402

cloudpickle.register_pickle_by_value(corpus_pipeline)
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        if name != "pack":
            assert docs.columns == columns
        if name == "language_id":
            assert {r["doc_id"] for r in rows} == set(before)  # all are in known languages
        if name == "near_dedup":
            texts = collections.Counter(r["text"].lower() for r in rows)
            assert max(texts.values()) == 1 and len(rows) > 0.8 * len(before)
            assert {r["text"].lower() for r in before.values()} >= set(texts)
        if name == "secrets":
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
            assert not any("token =" in r["text"] for r in rows)
        if name == "mix":
            assert max(collections.Counter(r["doc_id"] for r in rows).values()) <= 2
            expected = sum(len(r["text"].split()) for r in rows)
            kept = spark.read.parquet(str(tmp_path / "secrets")).collect()
            assert abs(expected - 1.5 * sum(len(r["text"].split()) for r in kept)) < 0.15 * expected
            mixed = collections.Counter(r["doc_id"] for r in rows)
    assert collections.Counter(r["doc_id"] for r in rows if r["start"] == 0) == mixed


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(rounded(r[i]) for i in at) for r in want.fetchall()), key=repr)
