"""Registered queries whose work SQL can express, and the pipeline, on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from tripline.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.queries()[name](spark, DATA)
    found = con.execute(queries.oracle_sql()[name])
    assert [c[0] for c in found.description] == got.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, found.fetchall()))


def test_pipeline_keeps_what_is_clean(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = corpus_pipeline.run(spark, DATA).orderBy("start").collect()
    assert len({r.doc_id for r in rows}) == len(rows) < docs.count()
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
