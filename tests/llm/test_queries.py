"""Corpus queries: SQL where there is some; the rest give one row for each row of their table."""

import pytest

from annulus.llm import queries
from tests.compare import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    check(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", ["op1_toxicity", "op2_token_counts", "op3_secrets", "op4_simhash", "op8_quality", "op10_fingerprints"])
def test_one_row_each(spark, name):
    df = queries.queries()[name](spark, SF)
    ids = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    assert sorted(r.doc_id for r in df.select("doc_id").collect()) == sorted(r.doc_id for r in ids.collect())


@pytest.mark.parametrize("name", ["op5_packing", "op9_licenses"])
def test_some_rows(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0
