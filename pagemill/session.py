"""SparkSession defaults the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# An HTML page is a wide row, so Arrow batches are kept short; the rest are
# semantics (UTC) or let AQE re-plan joins and skew at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    # Wide nested expressions: skip recording a Python call site per expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build(master: str | None = None, app: str = "pagemill", **conf: str) -> SparkSession:
    """A session with the defaults above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            cores = os.environ.get("BENCH_CPUS", "8")
            builder = builder.config("spark.sql.shuffle.partitions", cores).config("spark.ui.enabled", "false")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
