"""Files as rows: listed and read in tasks, wherever they lie.

Folders are listed level by level: a frontier of folders is dealt out, tasks list them, and the folders found are the next
frontier. Only whether a level has folders comes to the driver, no path does. Tasks open a local path or a URI through Arrow's
file systems (file, hdfs, s3, gs, abfs). URIs of other schemes, which only Spark's JVM can open (viewfs and the like), go
through Spark's own reader of binary files, which passes over names that start with an underscore and lists on the driver.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.paths import SUPPORTED, clean_path, extension_of
from corpusloom.operators.tables import partitions, written

# Folders that are never entered.
SKIPPED = ("__pycache__", "node_modules")
#: Rows of a listing that a task hands on at once.
LISTED = 10_000


@lru_cache(maxsize=64)
def _system(start: str) -> arrow_fs.FileSystem:
    return arrow_fs.FileSystem.from_uri(start)[0] if start else arrow_fs.LocalFileSystem()


def _located(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    scheme, mark, rest = path.partition("://")
    if not mark:
        return _system(""), path.removeprefix("file:")
    if scheme == "file":
        return _system(""), "/" + rest.partition("/")[2]
    host, _, inside = rest.partition("/")
    system = _system(f"{scheme}://{host}/")
    return system, f"/{inside}" if system.type_name == "hdfs" else f"{host}/{inside}"


def opens(path: str) -> bool:
    """Whether Python tasks can open the path's file system."""
    try:
        _located(path)
    except (pa.ArrowException, OSError, ImportError):
        return False
    return True


def open_stream(path: str):
    system, inside = _located(path)
    return system.open_input_stream(inside, compression=None)


def _real(path: str) -> str:
    """What a folder is known by: links lead to one and the same."""
    system, inside = _located(path)
    return os.path.realpath(inside) if isinstance(system, arrow_fs.LocalFileSystem) else path


def _children(folder: str) -> Iterator[tuple[str, int, bool]]:
    """(path, size, is a folder) of what lies in a folder, but for hidden names and skipped folders."""
    system, inside = _located(folder)
    if isinstance(system, arrow_fs.LocalFileSystem):
        try:
            found = os.scandir(inside)
        except OSError:
            return
        with found:
            for x in found:
                try:
                    row = (x.name, x.stat().st_size, x.is_dir(), x.is_dir() or x.is_file())
                except OSError:  # a link that leads nowhere
                    continue
                if row[3] and not x.name.startswith(".") and x.name not in SKIPPED:
                    yield f"{folder.rstrip('/')}/{x.name}", *row[1:3]
        return
    for x in system.get_file_info(arrow_fs.FileSelector(inside)):
        if not x.base_name.startswith(".") and x.base_name not in SKIPPED:
            yield f"{folder.rstrip('/')}/{x.base_name}", x.size or 0, x.type == arrow_fs.FileType.Directory


_LISTING = "path string, size long, folder boolean, real string"


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "size", "folder", "real"]
    for batch in batches:
        rows = []
        for folder in batch["path"]:
            for path, size, inner in _children(folder):
                rows.append((path, size, inner, _real(path) if inner else None))
                if len(rows) >= LISTED:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        yield pd.DataFrame(rows, columns=names)


def _is_supported(path) -> F.Column:
    return extension_of(path).isin(*SUPPORTED)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of the supported files under a path or URI: itself if it is such a file, else those below it.

    In folders, names that start with a dot and the skipped ones are passed over. Links are followed, each folder once: by the
    way with the fewest steps, then by the smallest path. Raises FileNotFoundError for a path that isn't there.
    """
    path = clean_path(path)
    if not opens(path):
        return _by_spark(spark, path).select("path", F.col("length").alias("size"))
    if "://" not in path:
        path = os.path.abspath(path)
    system, inside = _located(path)
    kind = system.get_file_info(inside)
    if kind.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if kind.type == arrow_fs.FileType.File:
        return spark.createDataFrame([(path, kind.size)], "path string, size long").filter(_is_supported(F.col("path")))
    frontier = seen = spark.createDataFrame([(path, _real(path))], "path string, real string")
    levels = []
    while True:
        dealt = frontier.select("path").repartition(partitions(spark), "path") if levels else frontier.select("path")
        level = written(dealt.mapInPandas(_list, _LISTING), "listing")
        levels.append(level.filter("NOT folder").select("path", "size"))
        found = level.filter("folder").groupBy("real").agg(F.min("path").alias("path")).select("path", "real")
        frontier = written(found.join(seen, "real", "left_anti").select("path", "real"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    files = levels[0]
    for more in levels[1:]:
        files = files.unionByName(more)
    return files.filter(_is_supported(F.col("path")))


def _by_spark(spark: SparkSession, path: str) -> DataFrame:
    """Spark's own rows (path, length, content, ...) of the supported files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    under = F.expr(f"substring(path, {len(path.rstrip('/')) + 1})")
    return files.filter(_is_supported(F.col("path")) & ~under.rlike(r"/\.|/(?:" + "|".join(SKIPPED) + ")/"))


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files of a URI that only Spark's JVM can open."""
    return _by_spark(spark, clean_path(path)).select("path", "content")
