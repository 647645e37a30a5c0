"""Exports of tables: whole or only what has changed, and their restoration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The form that this module writes; an export of another is refused.
VERSION = 1
_MANIFEST = "version int, subtree string, path string, size bigint, content_hash string"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """subtree, path, size, content_hash of every entry of an export and the exports that it builds on."""
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")


def write_export(entries: DataFrame, root: str, parent: DataFrame | None = None) -> DataFrame:
    """Write entries (subtree, path, content) under root and return the export's manifest.

    With a parent's manifest only entries are written whose path, size and content hash it does not have; the manifest
    lists all entries either way. root must be empty or absent.
    """
    spark = entries.sparkSession
    known = entries.select(F.lit(VERSION).alias("version"), "subtree", "path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("content_hash"), "content")
    shipped = known if parent is None else known.join(parent.select("path", "size", "content_hash"), ["path", "size", "content_hash"], "left_anti")
    shipped.select("subtree", "path", "content").write.mode("errorifexists").parquet(f"{root}/entries")
    known.drop("content").write.mode("errorifexists").parquet(f"{root}/manifest")
    return manifest(spark, root)


def restore(spark: SparkSession, roots: list[str], target: str, force: bool = False) -> DataFrame:
    """Put the entries of the last of these exports back under target, from it and those before it that it builds on.

    Refused: an export of another version, one with entries that none of the exports holds, and a target that is
    there already (unless by force).
    """
    wanted = manifest(spark, roots[-1])
    other = [r.version for r in wanted.select("version").distinct().collect() if r.version != VERSION]
    if other:
        raise ValueError(f"{roots[-1]} has version {other[0]}; this is version {VERSION}")
    held = [spark.read.parquet(f"{r}/entries").select("path", "content") for r in roots]
    every = held[0]
    for h in held[1:]:
        every = every.unionByName(h)
    every = every.withColumn("content_hash", F.sha2("content", 256)).dropDuplicates(["path", "content_hash"])
    found = wanted.select("subtree", "path", "content_hash").join(every, ["path", "content_hash"], "left")
    lost = found.where("content is null").select("path").limit(1).collect()
    if lost:
        raise ValueError(f"no export of {len(roots)} holds {lost[0].path}")
    found.select("subtree", "path", "content").write.mode("overwrite" if force else "errorifexists").parquet(target)
    return spark.read.parquet(target)
