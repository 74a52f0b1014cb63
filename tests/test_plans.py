"""What the physical plans must look like."""

import os

import pytest
from test_entry import DATA

from corpusloom.plans import catalogue as C

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(spark, name):
    return C.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, columns", [("page_text", "fetch_id:bigint,html:string"), ("url_parts", "fetch_id:bigint,url:string"), ("word_count", "doc_id:bigint,text:string"), ("content_hash", "doc_id:bigint,text:string"), ("truncate_for_model", "doc_id:bigint,text:string")])
def test_narrow_scans_without_shuffle(spark, name, columns):
    p = plan(spark, name)
    assert f"ReadSchema: struct<{columns}>" in p and "Exchange" not in p and "Python" not in p


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(text)]" in plan(spark, "content_hash")
    assert "EqualTo(batch,0)" in plan(spark, "memory_get")


def test_top_k_is_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(spark, "largest_docs")


def test_counts_are_combined_before_the_shuffle(spark):
    p = plan(spark, "word_frequency")
    assert p.count("HashAggregate") >= 2 and p.index("partial_count") > 0
