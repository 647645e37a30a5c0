"""Whole objects and byte ranges, put together from chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def placed(file_chunks: DataFrame) -> DataFrame:
    """file_chunks with the bytes of the file that each chunk covers: start (inclusive) and end (exclusive)."""
    w = Window.partitionBy("file_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long")
    return file_chunks.withColumn("start", start).withColumn("end", F.col("start") + F.col("size"))


def _together(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of each key in their order as one value; each byte is copied once."""
    return parts.groupBy(*keys).agg(F.expr("listagg(bytes) within group (order by idx)").alias("content"))


def whole(file_chunks: DataFrame) -> DataFrame:
    """file_id, content. A file is one value, so its chunks meet in one row."""
    return _together(file_chunks, ["file_id"])


def byte_ranges(file_chunks: DataFrame, requests: DataFrame, files: DataFrame) -> DataFrame:
    """request_id, status, content for each request (request_id, file_id, first, last; last is inclusive).

    status: ok, missing (no such file) or unsatisfiable. Only chunks that overlap a request are read on: the join is
    on the file, and the overlap is part of its condition.
    """
    sized = requests.join(files.select("file_id", "file_size"), "file_id", "left")
    bad = (F.col("file_size") == 0) | (F.col("first") >= F.col("file_size")) | (F.col("first") > F.col("last"))
    judged = sized.withColumn("status", F.when(F.col("file_size").isNull(), "missing").when(bad, "unsatisfiable").otherwise("ok"))
    judged = judged.withColumn("last", F.least("last", F.col("file_size") - 1))
    c, r = placed(file_chunks).alias("c"), judged.where("status = 'ok'").alias("r")
    overlap = (F.col("c.file_id") == F.col("r.file_id")) & (F.col("c.end") > F.col("r.first")) & (F.col("c.start") <= F.col("r.last"))
    low = F.greatest(F.col("r.first") - F.col("c.start"), F.lit(0))
    high = F.least(F.col("r.last") + 1, F.col("c.end")) - F.col("c.start")
    parts = r.join(c, overlap).select("r.request_id", "c.idx", F.substring("c.bytes", (low + 1).cast("int"), (high - low).cast("int")).alias("bytes"))
    return judged.select("request_id", "status").join(_together(parts, ["request_id"]), "request_id", "left")
