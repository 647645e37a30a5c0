"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, unless PYTHONPATH already leads to it."""
    package = Path(__file__).resolve().parent.parent
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context = spark.sparkContext
    if getattr(context, "_shipped_package", None) is None:
        at = tempfile.mkdtemp(prefix="package-")
        shutil.copytree(package, f"{at}/top/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{at}/{package.name}", "zip", f"{at}/top"))
        context._shipped_package = at


def python_tasks(spark: SparkSession) -> None:
    """Prepare for Python in tasks: the package is there, and the rows of one Arrow batch are bounded, so that long
    texts do not add up in a worker. All operators ask for the same bound, as the setting is the session's."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a folder of our own, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: The paths that are written inside a block of cleared(), innermost last.
_written: list[list[str]] = []


def fresh_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    return path


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside the block go when it ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Delete what operators wrote for themselves inside the block, and what their queries shuffled. Their results must
    have been written by then, under a path that was taken outside the block."""
    _written.append([])
    try:
        with brief_shuffles(spark):
            yield
    finally:
        for path in _written.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Cut lineage: write the rows to the path and read them again."""
    with brief_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write the rows to the shared folder and read them again."""
    return stored(df, fresh_path(df.sparkSession, what))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
