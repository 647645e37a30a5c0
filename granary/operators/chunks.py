"""Cut objects into fixed-size chunks, resolve duplicates, and lay unique chunks out in blocks."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.content import chunk_count, content_hash
from .ordered import fold

#: Bytes before a block's first chunk.
BLOCK_HEADER = 72
#: Blocks that a file's pool can number in 16 bits.
MOST_BLOCKS = 65_535


def chunks(objects: DataFrame, chunk_size: int, key: str = "file_id", data: str = "content", algorithm: str = "sha256") -> DataFrame:
    """key, idx, size, hash, crc, bytes: one row for each chunk. Empty content has one empty chunk; null has none."""
    content = F.col(data).cast("binary")
    at = F.sequence(F.lit(0).cast("long"), chunk_count(F.octet_length(content), chunk_size) - 1)
    cut = objects.where(F.col(data).isNotNull()).select(key, content.alias("_content"), F.explode(at).alias("idx"))
    cut = cut.select(key, "idx", F.substring("_content", (F.col("idx") * chunk_size + 1).cast("int"), F.lit(chunk_size)).alias("bytes"))
    return cut.select(key, "idx", F.octet_length("bytes").cast("long").alias("size"), content_hash(F.col("bytes"), algorithm).alias("hash"), F.crc32("bytes").alias("crc"), "bytes")


def identified(cut: DataFrame, key: str = "file_id") -> DataFrame:
    """cut with an own hash for each chunk that has none (algorithm "none"), so that no two of those are taken as one."""
    own = F.concat(F.lit("="), F.col(key).cast("string"), F.lit("#"), F.col("idx").cast("string"))
    return cut.withColumn("hash", F.when(F.col("hash") == "", own).otherwise(F.col("hash")))


def dedup_stats(cut: DataFrame) -> DataFrame:
    """One row: chunks, distinct chunks, raw and unique bytes. Hashes are reduced before anything meets in one task."""
    each = cut.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size"))
    return each.agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("unique_chunks"), F.sum(F.col("n") * F.col("size")).alias("raw_bytes"), F.sum("size").alias("unique_bytes"))


def resolve(cut: DataFrame, dedup: DataFrame, order: list[Column]) -> DataFrame:
    """Each chunk with how it is stored: "index" (its hash is known), "batch" (an earlier chunk of this batch has it)
    or "new". The winner of a batch is found by a grouped minimum, which partial aggregation bounds for hot hashes.
    """
    place = F.struct(*order)
    winners = cut.groupBy("hash").agg(F.min(place).alias("_winner"))
    known = dedup.select("hash", "block_id", "offset")
    joined = cut.join(winners, "hash").join(known, "hash", "left")
    source = F.when(F.col("block_id").isNotNull(), "index").when(place == F.col("_winner"), "new").otherwise("batch")
    return joined.withColumn("stored", source).drop("_winner")


def fill_blocks(winners: DataFrame, lane: str, order: list[str], block_size: int, raw: str = "size", stored: str = "stored_size") -> DataFrame:
    """block_no and offset of every chunk to store, next to its other columns.

    Chunks are laid one after another; a block is closed when the next chunk's raw size would reach its end, and
    offsets advance by stored sizes. As that depends on all chunks before, each lane fills its own blocks: lanes
    are tasks of their own, read in order and never held in memory. More lanes, more parallel writers.
    """

    def step(state: tuple[int, int] | None, row: dict) -> tuple[tuple[int, int], tuple]:
        block, offset = state or (0, BLOCK_HEADER)
        if offset > BLOCK_HEADER and offset + row[raw] >= block_size:
            block, offset = block + 1, BLOCK_HEADER
        return (block, offset + row[stored]), (block, offset)

    return fold(winners, lane, order, step, {"block_no": "long", "offset": "long"}, [raw, stored])


def reference_counts(file_chunks: DataFrame) -> DataFrame:
    """Chunk references of each block; a chunk that is used three times counts three times."""
    return file_chunks.groupBy("block_id").agg(F.count(F.lit(1)).alias("ref_count"))


def block_pool(file_chunks: DataFrame) -> DataFrame:
    """Each file's blocks in the order of first use, and how many there are."""
    first = file_chunks.groupBy("file_id", "block_id").agg(F.min("idx").alias("idx"))
    w = Window.partitionBy("file_id").orderBy("idx", "block_id")
    return first.select("file_id", "block_id", (F.row_number().over(w) - 1).cast("long").alias("pool_index"))


def oversized_pools(file_chunks: DataFrame, most: int = MOST_BLOCKS) -> DataFrame:
    """Files of more blocks than a pool can number: errors."""
    return file_chunks.select("file_id", "block_id").distinct().groupBy("file_id").agg(F.count(F.lit(1)).alias("blocks")).where(F.col("blocks") > most)
