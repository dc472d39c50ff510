"""Many small files: one file per name, one row per file.

Spark's own writer makes a folder per value and moves each in the driver, its readers hold every file in the driver and open a task for a
few. Here tasks list folders, read and write, so the driver holds neither names nor sizes, whatever the number of files.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
from collections.abc import Callable
from functools import reduce
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.plans.stored import file_system, materialize

FOLDER_FILES = 10_000  # files that one folder gets when written, and about as many that a task reads
BATCH_BYTES = 8_000_000  # of files that a task holds at a time, unless one is larger
TASK_BYTES = 64_000_000  # of files that a task reads
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|passthrough)$"  # by their names, Spark unpacks these
LISTING = "folder string, path string, size long"
URL_SAFE = "/_-!.~'()*,;:$&+=@"  # what a Hadoop path keeps besides letters and digits

# Ship the functions with the task, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def location(path: str) -> str:
    """A path as Spark names its files: quoted as in a URL, other letters than ASCII as they are."""
    return re.sub(r"[\x00-\x7f]+", lambda part: quote(part[0], safe=URL_SAFE), path)


def _lister(base: str):
    """Rows (folder, path, size) of what is in the folders named in ``path``, all below ``base``: sub-folders have a ``folder``, files a ``size``."""

    def read(batches):
        store, root = fs.FileSystem.from_uri(base)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = store.get_file_info(fs.FileSelector(root + unquote(path[len(base) :]), allow_not_found=True))
                for start in range(0, len(found), FOLDER_FILES):
                    part = [f for f in found[start : start + FOLDER_FILES] if not hidden(f.base_name)]
                    paths = [f"{path}/{location(f.base_name)}" for f in part]
                    folders = [at if f.type == fs.FileType.Directory else None for at, f in zip(paths, part)]
                    sizes = [f.size if f.type == fs.FileType.File else None for f in part]
                    arrays = [pa.array(folders, pa.string()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["folder", "path", "size"])

    return read


def utf8_json(content: bytes) -> bytes:
    """JSON in UTF-8 without a mark, from the encoding that its first bytes tell; broken JSON where its bytes do not fit it."""
    encoding = json.detect_encoding(content)
    try:
        text = content.decode(encoding)
    except UnicodeDecodeError:
        return b"{"
    return content if encoding == "utf-8" else text.encode("utf-8", "replace")


def _reader(base: str, change: Callable[[bytes], bytes] | None):
    """(url, content) of the files named in ``path``, all below ``base``."""

    def rows(urls, contents):
        return pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(contents, pa.binary())], names=["url", "content"])

    def read(batches):
        store, root = fs.FileSystem.from_uri(base)
        for batch in batches:
            urls, contents, held = [], [], 0
            for url in batch.column("path").to_pylist():
                with store.open_input_stream(root + unquote(url[len(base) :]), compression=None) as source:
                    content = source.read()
                if urls and held + len(content) > BATCH_BYTES:
                    yield rows(urls, contents)
                    urls, contents, held = [], [], 0
                urls.append(url)
                contents.append(change(content) if change else content)
                held += len(content)
            if urls:
                yield rows(urls, contents)

    return read


def _writer(base: str):
    """Files of (file, value) rows that come sorted by file; the number of files."""

    def write(batches):
        store, root = fs.FileSystem.from_uri(base)
        part, files, folder, name, beside, out = TaskContext.get().partitionId(), 0, None, None, None, None

        def close():
            if out:
                out.close()
                store.move(beside, f"{folder}/{name}")  # whole or not there, also when a task is run again

        for batch in batches:
            values = batch.column("value").cast(pa.binary())
            for place, file in enumerate(batch.column("file").to_pylist()):
                if file != name:
                    close()
                    if files % FOLDER_FILES == 0:
                        folder = f"{root}/{part}-{files // FOLDER_FILES}"
                        store.create_dir(folder, recursive=True)
                    name, beside, files = file, f"{folder}/_{uuid.uuid4().hex}", files + 1
                    out = store.open_output_stream(beside, compression=None)
                out.write((values[place].as_py() or b"") + b"\n")
        close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    return write


def write_files(rows: DataFrame, path: str) -> int:
    """Write (file, value) rows below ``path``: the texts of one file name are its lines, a null one is an empty line. Returns the number of files.

    Names are plain: not null, without a slash. Tasks put up to ``FOLDER_FILES`` files into a folder of their own.
    """
    sorted_ = rows.select("file", "value").repartition("file").sortWithinPartitions("file")
    root = qualified(rows.sparkSession, path)
    return sorted_.mapInArrow(_writer(root), "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its store, as Spark names its files."""
    target, system = file_system(spark, path)
    return re.sub("^file:/+", "file:///", system.makeQualified(target).toUri().toString()).rstrip("/")


def _reachable(spark: SparkSession, path: str) -> bool:
    """Whether it is a folder, not a pattern, of a store that tasks can open by themselves."""
    target, system = file_system(spark, path)
    if re.search(r"[{}\[\]*?\\]", path) or not system.exists(target) or not system.getFileStatus(target).isDirectory():
        return False
    try:
        fs.FileSystem.from_uri(qualified(spark, path))
    except (OSError, pa.ArrowException, NotImplementedError):
        return False
    return True


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of the files in a folder and its folders that are not empty, listed by tasks level by level; stored."""
    base, files = qualified(spark, path), []
    level = spark.createDataFrame([(base,)], "path string")
    while True:
        found = materialize(level.mapInArrow(_lister(base), LISTING), "files")
        files.append(found.filter("size > 0").select("path", "size"))
        level = found.filter("folder IS NOT NULL").select(F.col("folder").alias("path"))
        folders = level.count()
        if not folders:
            return reduce(DataFrame.unionByName, files)
        level = level.repartition(min(folders, 4 * spark.sparkContext.defaultParallelism))


def whole_files(spark: SparkSession, path: str, change: Callable[[bytes], bytes] | None = None) -> tuple[DataFrame, list[str]] | None:
    """((url, content) of the files in a folder and its folders, paths of packed files, which are left to Spark's codecs).

    ``change`` is done to every content. None where tasks cannot list the path by themselves: a single file, a pattern, or a store that only Spark knows.
    """
    if not _reachable(spark, path):
        return None
    files = list_files(spark, path)
    packed = F.col("path").rlike(PACKED)
    total = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    tasks = max(spark.sparkContext.defaultParallelism, total["files"] // FOLDER_FILES, total["size"] // TASK_BYTES)
    content = files.filter(~packed).select("path").repartition(tasks).mapInArrow(_reader(qualified(spark, path), change), "url string, content binary")
    escaped = lambda name: re.sub(r"([{}\[\]*?\\])", r"\\\1", unquote(name))
    return content, [escaped(r.path) for r in files.filter(packed).select("path").collect()]
