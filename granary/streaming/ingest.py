"""Take in objects as they arrive, batch by batch, and count arrivals by time partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import partition_id
from ..operators.chunks import chunks

CHUNKS = "file_id string, idx bigint, size bigint, hash string, crc bigint, bytes binary"


def arriving(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """Parquet files of objects as a stream; a batch reads so many files at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def ingest(stream: DataFrame, root: str, checkpoint: str, chunk_size: int, available_now: bool = True):
    """Write chunk references and unique chunks of each batch under root; a query that ends when all is read.

    A batch keeps the chunks whose hash is not stored yet, by a join with the table of stored hashes: dedup state is a
    table and needs no watermark. Each batch writes its own folder, so a batch that runs again replaces what it wrote.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.schema("hash string, first bigint, batch bigint").option("basePath", f"{root}/stored").option("ignoreMissingFiles", True)
        cut = chunks(batch, chunk_size).persist()
        try:
            cut.select("file_id", "idx", "size", "hash").write.mode("overwrite").parquet(f"{root}/references/batch={number}")
            known = stored.parquet(f"{root}/stored").where(F.col("batch") != number).select("hash") if number else spark.createDataFrame([], "hash string")
            fresh = cut.join(known, "hash", "left_anti").groupBy("hash").agg(F.min_by("bytes", F.struct("file_id", "idx")).alias("bytes"), F.min("size").alias("size"))
            fresh.write.mode("overwrite").parquet(f"{root}/stored/batch={number}")
        finally:
            cut.unpersist()

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def arrivals_by_partition(stream: DataFrame, hours: int = 24, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Arrivals and bytes of each tumbling window; windows close as the watermark passes them."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, late).groupBy(F.window(ts, f"{hours} hours")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).select(partition_id(F.unix_timestamp("window.start"), hours).alias("partition_id"), "files", "bytes")
