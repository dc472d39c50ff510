"""The registered queries: contract, and a sample against SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry_module
from checks import compare

SAMPLE = [
    "text_basic_stats", "text_keywords", "text_topics", "dup_exact", "response_pct", "rolling_60", "trend", "batch_running", "heatmap",
    "latest_state", "url_normalize", "url_resolve", "page_paragraphs", "page_links", "bfs_levels", "outcomes", "topic_rollup",
    "export_rows", "submissions", "stream_recent",
]


def test_names():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    assert all(callable(q) for q in queries.values())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["topic", "pages", "total_confidence"] and df.count() > 0


@pytest.fixture(scope="module")
def con(tiny):
    return compare.connect(tiny)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, tiny, con, name):
    columns, got = compare.spark_rows(entry_module.queries()[name](spark, tiny))
    want_columns, want = compare.sql_rows(con, entry_module.oracle_sql()[name])
    assert columns == want_columns and got == want
