"""Every query of the package that has SQL gives its rows on sf0.001, and every other gives one row a document at least."""

import pytest

from docsieve.llm import queries
from tests.llm.test_scan_mix_url import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    same(queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE[name]))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE) - {"op4_chroma"}))
def test_queries_return_every_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.QUERIES[name](spark, SF)
    assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
