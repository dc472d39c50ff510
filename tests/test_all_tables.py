"""Statistics of all tables, against the files and rows themselves."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from checks import compare
from pagemill.operators import lifecycle as life


def size(value):
    if isinstance(value, str):
        return len(value.encode())
    return sum(map(size, value)) if isinstance(value, list) else 0 if value is None else None


def test_all_tables(spark, tiny):
    queries, con = entry_module.queries(), compare.connect(tiny)
    got = {r.table_name: r for r in queries["table_stats_all"](spark, tiny).collect()}
    assert {t: r.rows for t, r in got.items()} == {t: pq.read_metadata(f"{tiny}/{t}.parquet").num_rows for t in compare.TABLES}
    widths = {"int32": 4, "int64": 8, "float": 4, "double": 8}
    for t in compare.TABLES:
        table, want = pq.read_table(f"{tiny}/{t}.parquet"), 0
        for column in table.columns:
            kind = str(column.type).removeprefix("list<element: ").rstrip(">")
            values = [v for v in column.to_pylist() if v is not None]
            if kind.startswith("string") or kind.startswith("large_string"):
                want += sum(map(size, values))
            else:
                want += widths.get(kind, 8) * (sum(map(len, values)) if str(column.type).startswith("list") else len(values))
        assert got[t].bytes == want, t
    totals = queries["store_totals_all"](spark, tiny).first()
    assert totals.collections == 14 and totals.total_documents == sum(r.rows for r in got.values())
    assert totals.total_size_bytes == sum(r.bytes for r in got.values())
    for name in ("table_stats_all", "store_totals_all"):
        assert compare.spark_rows(queries[name](spark, tiny)) == compare.sql_rows(con, entry_module.oracle_sql()[name])


def test_bytes_of_nested_values(spark):
    rows = [(1, "é", [1, None], {"a": 1}, (True, None), None, [["x", "yz"], None]), (None,) * 7]
    df = spark.createDataFrame(rows, "a long, b string, c array<int>, d map<string, short>, e struct<x: boolean, y: date>, f binary, g array<array<string>>")
    assert [r[0] for r in df.select(life.row_bytes(df)).collect()] == [8 + 2 + 4 + 3 + 1 + 0 + 3, 0]
    assert life.table_statistics({"t": df}, life.row_bytes).first().bytes == 21 and F
