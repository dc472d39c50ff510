"""Intermediates that outlive lost executors.

Data used twice, or per iteration of a loop, is written once as Parquet to the
shared folder the cluster names in ``spark.checkpoint.dir``; lineage ends there.
"""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local master may go without one, and gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="pagemill-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/pagemill/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path nobody else uses, in the shared folder."""
    return f"{_session_folder(spark)}/{label}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system; one that is not there is fine."""
    target, system = file_system(spark, path)
    system.delete(target, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder; none where there is no folder."""
    target, system = file_system(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []


def exists(spark: SparkSession, path: str) -> bool:
    target, system = file_system(spark, path)
    return system.exists(target)


def release(spark: SparkSession) -> None:
    """Delete all intermediates of this session; DataFrames built on them end here."""
    delete_folder(spark, _session_folder(spark))


def materialize(df: DataFrame, label: str = "part") -> DataFrame:
    """Write ``df`` once and read it back; columns stay prunable and lineage is cut."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, which need not have it installed: once per application, through the shared folder."""
    context = spark.sparkContext
    if getattr(context, "_pagemill_shipped", False):
        return
    package, packed = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    path = f"{fresh_path(spark, 'package')}/{package.name}.zip"
    target, system = file_system(spark, path)
    out = system.create(target, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    context.addPyFile(path)
    context._pagemill_shipped = True
