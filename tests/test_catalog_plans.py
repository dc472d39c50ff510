"""What is made of narrow rows may be far wider than Spark's estimate of it."""

from checks import insight_queries as iq


def test_product_pages_are_not_broadcast(spark, tiny):
    plan = iq.catalog_records(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
