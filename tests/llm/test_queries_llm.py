"""The registered queries and the pipeline on the smallest data."""

from __future__ import annotations

import os
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check_oracles import TABLES, table_of
from tracegrove.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert table_of(df.columns, df.collect()) == table_of(names, res.fetchall())


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q.split("_")[0] in ("op2", "op3", "op5", "op6", "op7", "op9", "op10")])
def test_one_row_per_document(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = entry.queries()[name](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    if "held_out" in got[0]:
        folds, left = (5, 0) if name.startswith("op3") else (4, 2)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == left) for r in got)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
        assert docs.columns == columns, name
        assert 0.5 * before < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}
    # Pieces depend on the partitions; the tokens packed do not.
    whole = entry.queries()["pipeline"](spark, FOLDER).collect()
    assert {p.doc_id for p in whole} == {p.doc_id for p in pieces}
    assert sum(p.length for p in whole) == sum(p.length for p in pieces)


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), stage(spark, docs, FOLDER).schema)
        assert docs.count() == 0
