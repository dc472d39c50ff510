import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry_module

ROOT = Path(__file__).resolve().parents[2]


def test_every_operator_has_one_query():
    names = entry_module.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_the_rest_works_without_the_subpackage(tmp_path):
    """A copy of the repository without llm, its tests and the pipeline still imports and lists its queries."""
    for name in ("pagemill", "checks"):
        for file in (ROOT / name).rglob("*.py"):
            if "llm" not in file.relative_to(ROOT).parts:
                target = tmp_path / file.relative_to(ROOT)
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_text(file.read_text())
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_workers_are_sent_the_package(tmp_path):
    """From another folder, with nothing on the workers' path: queries with Python tasks run."""
    code = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", {str(ROOT / "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("op1_simhash_groups", "op6_bestfit_matrices", "op13_token_links"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
"""
    kept = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=kept, timeout=300)
