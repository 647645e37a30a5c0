"""Scans, listings, totals and updates of the catalog's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.access import partition_allowed
from .ordered import one_row, top

#: The columns a listing can be sorted by; anything else sorts by the first.
SORTABLE = ("create_time", "file_name", "file_size")


def newest_first(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("create_time"), "file_id")


def lookup(table: DataFrame, column: str, value) -> DataFrame:
    """One row by its key: an equality filter that Parquet's statistics prune."""
    return table.where(F.col(column) == F.lit(value)).limit(1)


def matches(query: str) -> Column:
    """Substring of the name in any case, or of the id. Only the query is lower-cased for the id."""
    q = query.lower()
    return F.lower("file_name").contains(q) | F.col("file_id").contains(q)


def listing(files: DataFrame, query: str | None = None, allowed: list[str] | None = None, sort: str = "create_time", order: str = "desc", offset: int = 0, limit: int = 200) -> DataFrame:
    """A page of files with place (from 0). Ties follow the base order (newest first, then id), reversed for "desc"."""
    if query:
        files = files.where(matches(query))
    if allowed is not None:
        files = files.where(partition_allowed(F.array(*map(F.lit, allowed)).cast("array<string>"), F.col("partition_id")))
    sort = sort if sort in SORTABLE else SORTABLE[0]
    down = order == "desc"
    keys = [F.desc(sort) if down else F.asc(sort)]
    if sort != "create_time":
        keys.append(F.asc("create_time") if down else F.desc("create_time"))
    keys.append(F.desc("file_id") if down else F.asc("file_id"))
    return top(files, keys, offset + limit).where(F.col("place") >= offset)


def totals(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: files, blocks, logical and stored bytes, and their ratio (at least 1; 1 for an empty store)."""
    f = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("logical_bytes"))
    b = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("size"), F.lit(0)).alias("disk_bytes"))
    ratio = F.when(F.col("disk_bytes") == 0, F.lit(1.0)).otherwise(F.greatest(F.col("logical_bytes") / F.col("disk_bytes"), F.lit(1.0)))
    return one_row(f, b).withColumn("dedup_ratio", ratio)


def by_partition(files: DataFrame) -> DataFrame:
    return files.groupBy("partition_id").agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"))


def subtree_totals(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("subtree").agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes"))


def changed_entries(current: DataFrame, parent: DataFrame) -> DataFrame:
    """What an incremental export ships: entries whose path, size and content the parent does not have."""
    return current.join(parent, ["path", "size", "content_hash"], "left_anti")


def put(arrivals: DataFrame, existing: DataFrame, policy: str, order: str = "arrival") -> DataFrame:
    """file_id, order, outcome of every arrival: Created, AlreadyExists, Skipped or Overwritten.

    The first arrival of an unknown id is created. After that the policy decides.
    """
    first = arrivals.groupBy("file_id").agg(F.min(order).alias("_first"))
    known = existing.select("file_id").distinct().withColumn("_known", F.lit(True))
    joined = arrivals.join(first, "file_id").join(known, "file_id", "left")
    fresh = F.col("_known").isNull() & (F.col(order) == F.col("_first"))
    after = {"error": "AlreadyExists", "skip": "Skipped", "overwrite": "Overwritten"}[policy]
    return joined.withColumn("outcome", F.when(fresh, "Created").otherwise(after)).drop("_first", "_known")


def survivors(arrivals: DataFrame, policy: str, order: str = "arrival") -> DataFrame:
    """The arrival whose content an id ends up with: the last one if it may overwrite, else the first."""
    end = (F.max if policy == "overwrite" else F.min)(order).alias(order)
    return arrivals.join(arrivals.groupBy("file_id").agg(end), ["file_id", order], "left_semi")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Insert or replace by key."""
    return table.join(rows, key, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def delete_partition(files: DataFrame, partition_id: int) -> tuple[DataFrame, DataFrame]:
    """The files that stay, and those of the partition, which go."""
    of = F.col("partition_id") == partition_id
    return files.where(~F.coalesce(of, F.lit(False))), files.where(of)


def live_set(*tables: DataFrame, column: str) -> DataFrame:
    """The values of a column that any of the tables has, each once."""
    out = tables[0].select(column)
    for t in tables[1:]:
        out = out.unionByName(t.select(column))
    return out.distinct()


def listing_after(files: DataFrame, last: tuple | None = None, limit: int = 200) -> DataFrame:
    """The next page, newest first, after the last row (create_time, file_id) of the page before.

    A filter on the key takes the place of an offset, so a deep page costs no more than the first.
    """
    if last is not None:
        at, file_id = last
        files = files.where((F.col("create_time") < at) | (F.col("create_time") == at) & (F.col("file_id") < file_id))
    return top(files, [F.desc("create_time"), F.desc("file_id")], limit)


def reference_deltas(added: DataFrame, removed: DataFrame) -> DataFrame:
    """block_id, delta: references gained less those lost; blocks without a change are left out."""
    plus = added.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    minus = removed.groupBy("block_id").agg((-F.count(F.lit(1))).alias("n"))
    return plus.unionByName(minus).groupBy("block_id").agg(F.sum("n").alias("delta")).where("delta != 0")


def apply_deltas(blocks: DataFrame, deltas: DataFrame) -> DataFrame:
    """Blocks with new reference counts, never below zero."""
    count = F.greatest(F.col("ref_count") + F.coalesce("delta", F.lit(0)), F.lit(0).cast("long"))
    return blocks.join(deltas, "block_id", "left").withColumn("ref_count", count).drop("delta")


def unknown_blocks(deltas: DataFrame, blocks: DataFrame) -> DataFrame:
    """Changes of blocks that are not there: errors."""
    return deltas.join(blocks, "block_id", "left_anti")


def purge_dedup(dedup: DataFrame, dead_blocks: DataFrame) -> DataFrame:
    return dedup.join(dead_blocks.select("block_id"), "block_id", "left_anti")


def block_detail(file_chunks: DataFrame, files: DataFrame, block_id) -> DataFrame:
    """The files that refer to one block, and how often."""
    used = file_chunks.where(F.col("block_id") == F.lit(block_id)).groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"))
    return used.join(files, "file_id")
