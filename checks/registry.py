"""Collects the registered queries and SQL answers of all areas."""

from __future__ import annotations

from functools import wraps

from checks import insight_queries, io_queries, metric_queries, page_queries, text_queries

AREAS = [text_queries, metric_queries, page_queries, insight_queries, io_queries]


def _in_utc(query):
    """The tables hold UTC times without a zone, so queries are built in UTC."""

    @wraps(query)
    def run(spark, folder):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, folder)

    return run


def queries():
    return {name: _in_utc(query) for area in AREAS for name, query in area.QUERIES.items()}


def oracles():
    return {name: sql for area in AREAS for name, sql in area.ORACLES.items()}
