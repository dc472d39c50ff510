import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pagemill.session import build

    folder = str(tmp_path_factory.mktemp("shared"))
    session = build("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=folder)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"


@pytest.fixture
def one(spark):
    """Evaluate expressions of column ``v`` over plain values: one result list per call."""

    def evaluate(values, build, kind="string"):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, v {kind}")
        return [r[1] for r in sorted(df.select("i", build("v")).collect())]

    return evaluate
