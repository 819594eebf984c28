"""Results that no cap cuts."""

from __future__ import annotations

from lodestone.operators import search
from lodestone.plans import registry


def test_term_search_without_a_limit_finds_all(spark):
    assert search.term_search(spark.range(300).withColumnRenamed("id", "doc_id"), None).count() == 300


def test_merged_terms_have_no_cap(spark):
    plan = registry.queries()["collection_merged_terms"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan
