"""Callers that read some columns only, or none."""

import pytest

from hemline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,column", [("op5_impact_search", "query_id"), ("op5_impact_search", "vec_id"), ("op6_context_tree", "score"), ("op11_substring_dedup", "doc_id"), ("op12_vector_codes", "label_error")])
def test_single_columns_and_counts(spark, name, column):
    df = QUERIES[name](spark, FOLDER)
    assert df.count() == len(df.select(column).collect()) == len(df.where(f"{column} IS NOT NULL").select(column).collect())
