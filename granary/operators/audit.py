"""The audit log: pages, retention, outcomes, and the numbers of operation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import nearest_ranks, top

#: The most events that one page returns.
PAGE_LIMIT = 1000


def page(events: DataFrame, since: int | None = None, until: int | None = None, actor: str | None = None, action_prefix: str | None = None, limit: int = 200) -> DataFrame:
    """The newest events, numbered from 0. Bounds are inclusive; all filters reach the scan."""
    if since is not None:
        events = events.where(F.col("ts") >= since)
    if until is not None:
        events = events.where(F.col("ts") <= until)
    if actor is not None:
        events = events.where(F.col("actor_key_id") == actor)
    if action_prefix is not None:
        events = events.where(F.col("action").startswith(action_prefix))
    return top(events, [F.desc("ts"), F.desc("seq")], min(limit, PAGE_LIMIT))


def retained(events: DataFrame, cutoff: int) -> DataFrame:
    return events.where(F.col("ts") >= cutoff)


def purged(events: DataFrame, cutoff: int) -> DataFrame:
    return events.agg(F.count_if(F.col("ts") < cutoff).alias("deleted"), F.count_if(F.col("ts") >= cutoff).alias("kept"))


def numbered(events: DataFrame) -> DataFrame:
    """seq: the place of an event among those of its second."""
    w = Window.partitionBy("ts").orderBy("event_id")
    return events.withColumn("seq", (F.row_number().over(w) - 1).cast("long"))


def throughput(log: DataFrame) -> DataFrame:
    """For each operation: how many, how many succeeded (2xx), bytes, and operations a second of elapsed time."""
    n = F.count(F.lit(1))
    return log.groupBy("op").agg(
        n.alias("ops"), F.count_if((F.col("status") >= 200) & (F.col("status") < 300)).alias("ok"), F.sum("bytes").alias("bytes"), (n / (F.max("at") - F.min("at"))).alias("ops_per_s")
    )


def status_histogram(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def latency_percentiles(log: DataFrame, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    return nearest_ranks(log, "op", "elapsed", list(percents))


def counters(log: DataFrame, by: dict[str, Column], amount: str) -> DataFrame:
    """metric, label, n, total: how many rows, and how much of an amount, for each value of several labels at once."""
    each = F.explode(F.array(*(F.struct(F.lit(metric).alias("metric"), label.alias("label")) for metric, label in by.items())))
    rows = log.select(each.alias("by"), F.col(amount).alias("_amount"))
    return rows.groupBy("by.metric", "by.label").agg(F.count(F.lit(1)).alias("n"), F.sum("_amount").alias("total"))


def latency_means(log: DataFrame) -> DataFrame:
    """op, n, total, mean of elapsed; sums are decimal, so they do not depend on the order of rows."""
    total = F.sum(F.col("elapsed").cast("decimal(18,4)"))
    return log.groupBy("op").agg(F.count(F.lit(1)).alias("n"), total.alias("total")).withColumn("mean", F.col("total").cast("double") / F.col("n"))
