"""Plans that keep a collection healthy. Each takes relations and returns the rows to act on; none changes anything."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.content import clamped, content_hash
from ..operators.ordered import fold, one_row, places, top, written


@dataclass(frozen=True)
class CompactionOptions:
    threshold: float = 0.5
    block_size: int = 1 << 30
    undersize_ratio: float = 0.0
    min_blocks_saved: int = 2
    min_age: int = 0
    force: bool = False


def live_bytes(file_chunks: DataFrame) -> DataFrame:
    """block_id, live_bytes, live_chunks: sizes over the distinct hashes that are still referred to.

    References are reduced by block and hash first, so a hot hash costs one row for each task.
    """
    each = file_chunks.where(F.col("hash").isNotNull()).groupBy("block_id", "hash").agg(F.min("compressed_size").alias("size"))
    return each.groupBy("block_id").agg(F.sum("size").alias("live_bytes"), F.count(F.lit(1)).alias("live_chunks"))


def utilisation(blocks: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """blocks with live_bytes (0 without references) and utilisation: 0 to 1, null for a block of size 0. live None:
    blocks have the live bytes already."""
    joined = blocks if live is None else blocks.join(live, "block_id", "left").fillna(0, ["live_bytes", "live_chunks"])
    return joined.withColumn("utilisation", F.when(F.col("size") > 0, clamped(F.col("live_bytes") / F.col("size"), 0.0, 1.0)))


def block_totals(used: DataFrame) -> DataFrame:
    return used.agg(
        F.count(F.lit(1)).alias("blocks"),
        F.sum("size").alias("size"),
        F.sum("live_bytes").alias("live_bytes"),
        F.count_if(~F.col("sealed")).alias("unsealed"),
        F.count_if(F.col("ref_count") == 0).alias("orphans"),
        F.count_if(F.col("sealed") & (F.col("utilisation") < 0.5)).alias("low"),
    )


SORTED_BY = ("block_id", "size", "live_bytes", "utilisation", "ref_count", "create_time")


def block_places(used: DataFrame, columns: tuple[str, ...] = SORTED_BY) -> DataFrame:
    """block_id, sorted_by, direction, place: every block in the order of each column either way; blocks without a value
    come first, equal ones go by block_id. Values are compared as doubles. used is worked out once and written."""
    used = written(used.select("block_id", *(c for c in columns if c != "block_id")), "used")
    orders = [(c, n, sign * F.col(c).cast("double")) for c in columns for n, sign in (("up", 1), ("down", -1))]
    each = F.inline(F.array(*(F.struct(F.lit(f"{c} {n}").alias("_order"), v.alias("_value")) for c, n, v in orders)))
    placed = places(used.select("block_id", each), "_order", "_value", "block_id")
    return placed.select("block_id", F.split_part("_order", F.lit(" "), F.lit(1)).alias("sorted_by"), F.split_part("_order", F.lit(" "), F.lit(2)).alias("direction"), "place")


def result_rows(grouped: DataFrame, committed: DataFrame) -> DataFrame:
    """For each source block of the committed groups what a merge does with it, and a last row (block_id null) for all:
    old and new bytes, what is saved (negative where a block grows), live chunks. grouped: with live_chunks."""
    kept = grouped.join(committed.select("lane", "group_no"), ["lane", "group_no"], "left_semi")
    sums = [F.sum("size").alias("old_bytes"), F.sum("live_bytes").alias("new_bytes"), F.sum(F.col("size") - F.col("live_bytes")).alias("bytes_saved"), F.sum("live_chunks").alias("live_chunks")]
    return kept.rollup("block_id").agg(*sums)


def merge_actions(moved: DataFrame, codec: str) -> DataFrame:
    """moved (with each chunk's codec) and action: a chunk of the target's codec is copied as it lies, others are
    compressed anew."""
    return moved.withColumn("action", F.when(F.col("codec") == codec, "copy").otherwise("recompress"))


def sealed_if_dead(blocks: DataFrame) -> DataFrame:
    """Blocks after a pass that seals those that nothing refers to, which makes them free to go."""
    return blocks.withColumn("sealed", F.col("sealed") | (F.col("ref_count") == 0))


def candidates(used: DataFrame, pinned: DataFrame, options: CompactionOptions, now: int) -> DataFrame:
    """Sealed blocks worth rewriting, with the reason: low_util, undersized or both. Pinned and young blocks stay."""
    low = F.col("utilisation") < options.threshold
    small = F.col("size") < options.block_size * options.undersize_ratio if options.undersize_ratio > 0 else F.lit(False)
    reason = F.when(low & small, "both").when(low, "low_util").when(small, "undersized")
    old = F.greatest(F.lit(now) - F.col("create_time"), F.lit(0)) >= options.min_age
    kept = used.where(F.col("sealed") & (F.col("size") > 0) & old).join(pinned.select("block_id"), "block_id", "left_anti")
    return kept.withColumn("reason", reason).where(F.col("reason").isNotNull())


def groups(found: DataFrame, options: CompactionOptions, lane: Column) -> DataFrame:
    """group_no of each candidate: within a lane, ascending by live bytes, as many as one block holds; never reopened."""

    def step(state: tuple[int, int] | None, row: dict) -> tuple[tuple[int, int], tuple]:
        number, held = state or (0, 0)
        if state and held + row["live_bytes"] > options.block_size:
            number, held = number + 1, 0
        return (number, held + row["live_bytes"]), (number,)

    return fold(found.withColumn("lane", lane), "lane", ["live_bytes", "block_id"], step, {"group_no": "long"}, ["live_bytes"])


def commits(grouped: DataFrame, options: CompactionOptions) -> DataFrame:
    """Groups worth rewriting: any member of low utilisation, enough blocks saved, or by force."""
    low = F.bool_or(F.col("reason").isin("low_util", "both"))
    small = F.bool_or(F.col("reason").isin("undersized", "both"))
    g = grouped.groupBy("lane", "group_no").agg(F.count(F.lit(1)).alias("members"), F.sum("live_bytes").alias("live_bytes"), F.sum("size").alias("size"), low.alias("has_low"), small.alias("has_small"))
    out = F.ceil(F.col("live_bytes") / options.block_size)
    g = g.withColumn("saved", F.greatest(F.col("members") - out, F.lit(0)).cast("long"))
    strategy = F.when(F.col("has_low") & F.col("has_small"), "mixed").when(F.col("has_low"), "low_util").otherwise("undersized")
    enough = F.lit(options.min_blocks_saved > 0) & (F.col("saved") >= options.min_blocks_saved)
    return g.where(F.lit(options.force) | F.col("has_low") | enough).withColumn("strategy", strategy).drop("has_low", "has_small")


def within_budget(groups_: DataFrame, budget: int, headroom: int) -> DataFrame:
    """Groups that fit the free space, in order within a lane; one that does not fit is passed over. budget: of a lane."""

    def step(free: int | None, row: dict) -> tuple[int, tuple]:
        free = budget if free is None else free
        fits = free >= row["live_bytes"] + headroom
        return free - row["live_bytes"] * fits, (fits,)

    return fold(groups_, "lane", ["group_no"], step, {"fits": "boolean"}, ["live_bytes"]).where("fits").drop("fits")


def remap(file_chunks: DataFrame, moved: DataFrame) -> DataFrame:
    """file_chunks after a compaction. moved: block_id, hash, new_block_id, new_offset, new_size.

    A chunk that several sources of a group hold is copied once; all its references follow it.
    """
    m = moved.groupBy("block_id", "hash").agg(F.min(F.struct("new_block_id", "new_offset", "new_size")).alias("m"))
    joined = file_chunks.join(m, ["block_id", "hash"], "left")
    pick = lambda new, old: F.coalesce(F.col(f"m.{new}"), F.col(old)).alias(old)
    rest = [c for c in file_chunks.columns if c not in ("block_id", "offset", "compressed_size")]
    return joined.select(*rest, pick("new_block_id", "block_id"), pick("new_offset", "offset"), pick("new_size", "compressed_size"))


def unmatched(file_chunks: DataFrame, moved: DataFrame) -> DataFrame:
    """References into a compacted block that no moved chunk serves: errors."""
    return file_chunks.join(moved.select("block_id").distinct(), "block_id", "left_semi").join(moved, ["block_id", "hash"], "left_anti")


def laid_out(live: DataFrame, header: int = 72) -> DataFrame:
    """new_offset of each live chunk of a new block: the sizes before it, in the order of source and offset."""
    w = Window.partitionBy("new_block_id").orderBy("block_id", "offset").rowsBetween(Window.unboundedPreceding, -1)
    return live.withColumn("new_offset", F.lit(header) + F.coalesce(F.sum("compressed_size").over(w), F.lit(0)))


def reclaimable(blocks: DataFrame, pinned: DataFrame) -> DataFrame:
    """Unreferenced blocks that nothing pins; a sealed block needs no pin."""
    return blocks.where("ref_count = 0").join(pinned.select("block_id"), "block_id", "left_anti")


def pass_counters(blocks: DataFrame, pinned: DataFrame, files: DataFrame, events: DataFrame, partitions_before: int, events_before: int) -> DataFrame:
    """What one collection pass removes beside dedup rows: blocks and their bytes, files of expired time partitions and
    how many such partitions there are, and audit events that are too old."""
    b = reclaimable(blocks, pinned).agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    old = files.where(F.col("partition_id") < partitions_before)
    f = old.groupBy("partition_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("partitions"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"))
    a = events.agg(F.count_if(F.col("ts") < events_before).alias("audit_rows"))
    return one_row(b, f, a)


def collection_summary(blocks: DataFrame, pinned: DataFrame, dedup: DataFrame, files: DataFrame, hours: int = 24) -> DataFrame:
    """What a collection pass removes: blocks, bytes, dedup rows; and the time partitions that hold no file."""
    gone = reclaimable(blocks, pinned)
    b = gone.agg(F.count(F.lit(1)).alias("blocks_deleted"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_freed"))
    d = dedup.join(gone.select("block_id"), "block_id", "left_semi").agg(F.count(F.lit(1)).alias("dedup_deleted"))
    p = empty_partitions(blocks, files, hours).agg(F.count(F.lit(1)).alias("empty_partitions"))
    return one_row(b, d, p)


def empty_partitions(blocks: DataFrame, files: DataFrame, hours: int = 24) -> DataFrame:
    seen = blocks.select(F.floor(F.col("create_time") / (hours * 3600)).cast("long").alias("partition_id")).distinct()
    return seen.join(files.select("partition_id").distinct(), "partition_id", "left_anti")


def scrub(payload: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Every stored chunk with its fault (crc or hash), recomputed from its bytes; null if it is sound."""
    stored = F.rpad("hash", 64, "0")
    fault = F.when(F.crc32("bytes") != F.col("crc"), "crc").when((F.col("hash") != "") & (content_hash(F.col("bytes"), algorithm, padded=True) != stored), "hash")
    return payload.withColumn("fault", fault)


def scrub_report(scrubbed: DataFrame) -> DataFrame:
    each = scrubbed.groupBy("block_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("fault").alias("faults"), F.sum(F.octet_length("bytes")).alias("bytes"))
    return each.agg(F.count(F.lit(1)).alias("blocks_checked"), F.count_if(F.col("faults") > 0).alias("blocks_damaged"), F.sum("chunks").alias("chunks_checked"), F.sum("faults").alias("faults"), F.sum("bytes").alias("bytes_checked"))


#: Faults that a report lists; it counts all.
REPORTED = 100


def scrub_errors(scrubbed: DataFrame, order: list[str], limit: int = REPORTED) -> DataFrame:
    """The first faults in an order, with place; the limit is the report's."""
    return top(scrubbed.where("fault is not null"), [F.asc(c) for c in order], limit)


def located(file_chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """file_chunks with the path of each chunk's container, or an error where its block is not known.

    blocks: block_id, path.
    """
    joined = file_chunks.join(blocks.select("block_id", "path"), "block_id", "left")
    return joined.withColumn("error", F.when(F.col("path").isNull(), F.concat(F.lit("no block "), F.col("block_id").cast("string"))))


def repair(files: DataFrame, file_chunks: DataFrame, blocks: DataFrame, dedup: DataFrame, present: DataFrame) -> dict[str, DataFrame]:
    """What to remove where containers are missing: their blocks, the files that use them, and their dedup rows."""
    missing = blocks.select("block_id").join(present.select("block_id"), "block_id", "left_anti")
    hurt = file_chunks.select("file_id", "block_id").join(missing, "block_id", "left_semi").select("file_id").distinct()
    return {"blocks": missing, "files": files.join(hurt, "file_id", "left_semi"), "dedup": dedup.join(missing, "block_id", "left_semi")}


def startup_actions(containers: DataFrame, blocks: DataFrame) -> DataFrame:
    """keep, quarantine (incomplete but referred to) or delete for each container found."""
    known = blocks.select("block_id", F.lit(True).alias("known"))
    action = F.when(F.col("complete"), "keep").when(F.col("known"), "quarantine").otherwise("delete")
    return containers.join(known, "block_id", "left").select("block_id", action.alias("action"))


#: References for each task, where blocks are dealt out to be sorted.
DEALT = 1_000_000


def by_block(file_chunks: DataFrame, rows: int) -> DataFrame:
    """file_chunks dealt by block to more tasks the more rows there are, so that what a task sorts does not grow."""
    width = max(int(file_chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // DEALT))
    return file_chunks.repartition(width, "block_id")


def reseal(file_chunks: DataFrame, header: int = 72) -> DataFrame:
    """For each block the end of its last known chunk and whether its chunks cover it without a gap or an overlap."""
    unique = file_chunks.groupBy("block_id", "hash").agg(F.min("offset").alias("offset"), F.min("compressed_size").alias("size"))
    ends = F.col("offset") + F.col("size")
    w = Window.partitionBy("block_id").orderBy("offset")
    placed = unique.withColumn("before", F.coalesce(F.lag(ends).over(w), F.lit(header)))
    return placed.groupBy("block_id").agg(F.max(ends).alias("end"), F.count(F.lit(1)).alias("chunks"), F.bool_and(F.col("offset") == F.col("before")).alias("covered"))
