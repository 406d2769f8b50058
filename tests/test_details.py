"""Detail pages of all described occupations with a wage."""

import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("DETAIL_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not here")


def test_details_hold_every_document_with_a_wage(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    paid = read("orders").selectExpr("o_orderkey as doc_id")
    want = read("documents").join(paid, "doc_id").count()
    got = entry.queries()["entity_detail_with_pay"](spark, SF)
    assert got.count() == want > read("embeddings").count()
