"""Walk a table in ascending order of its key, each row with the row after it, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width


#: What a null key counts as where keys are compared.
NO_KEY = -(1 << 63)


def comparable(key: F.Column) -> F.Column:
    return F.coalesce(key.cast("long"), F.lit(NO_KEY))


def range_bounds(docs: DataFrame, key: str, count: int) -> list[int]:
    """count - 1 bounds, ascending, that cut the rows into ranges of about equal size; read from the key column alone.

    A key that fills several ranges is a bound several times.
    """
    if count < 2:
        return []
    found = docs.agg(F.percentile_approx(comparable(F.col(f"`{key}`")), [k / count for k in range(1, count)], 100 * count).alias("b")).first()["b"]
    return sorted(found or [])


def _below(value: F.Column, bounds: F.Column, count: int, equal: bool) -> F.Column:
    """How many of the ascending bounds are below the value (or equal to it), found in steps of halved size."""

    def step(found: F.Column, size: F.Column) -> F.Column:
        bound = F.get(bounds, found + size - 1)  # null behind the last one
        return F.when(bound <= value if equal else bound < value, found + size).otherwise(found)

    sizes = [1 << k for k in reversed(range(count.bit_length()))]
    return F.aggregate(F.array(*map(F.lit, sizes)), F.lit(0), step)


def range_of(key: F.Column, tie: F.Column, bounds: list[int]) -> F.Column:
    """The number of the range that a row lies in, by a search of the bounds in as many steps as their logarithm.

    Rows in order of (key, tie) have ascending numbers. tie: a hash; a key that is a bound several times is dealt to
    all of its ranges by it.
    """
    if not bounds:
        return F.lit(0)
    own, known = comparable(key), F.array(*(F.lit(b).cast("long") for b in bounds))
    share = (F.shiftright(tie, 33) + (1 << 30)).cast("double") / (1 << 31)
    low, times = _below(own, known, len(bounds), False), _below(own, known, len(bounds), True) - _below(own, known, len(bounds), False)
    return (low + F.when(times > 1, F.floor(share * (times + 1))).otherwise(0)).cast("int")


def with_next(docs: DataFrame, key: str, text: str, work: Callable[[list[tuple], str], list[tuple]], schema: str, arrow: pa.Schema, size: int = 300_000) -> DataFrame:
    """work([(key, text), ...], text of the row after the last) gives the rows of the result, for runs of rows.

    Order: nulls first, then ascending keys, ties by a hash of the text; the row after the last is the first. Null
    texts are empty. Each range of rows is a partition; its last row needs the first row of the next range, which is
    sent along. Those first rows are found by an aggregation, one for each range.
    """
    count = shuffle_width(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    rows = rows.withColumn("r", range_of(F.col("k"), F.col("h"), range_bounds(docs, key, count)))
    first = {x.r: x.first for x in rows.groupBy("r").agg(F.min(F.struct(comparable(F.col("k")).alias("k"), "h")).alias("first")).collect()}
    order = sorted(first)
    before = dict(zip([*order[1:], *order[:1]], order, strict=True))
    dealt = rows.select("r", F.lit(0).alias("head"), "k", "h", "t")
    if first:
        # the first row of a range goes to the range before it too
        known = docs.sparkSession.createDataFrame([(r, before[r], x.k, x.h) for r, x in first.items()], "r int, before int, first_k long, first_h long")
        heads = rows.where(comparable(F.col("k")).isin(list({x.k for x in first.values()}))).join(F.broadcast(known), "r")
        heads = heads.where((comparable(F.col("k")) == F.col("first_k")) & (F.col("h") == F.col("first_h"))).groupBy("before").agg(F.min("k").alias("k"), F.min("h").alias("h"), F.min("t").alias("t"))
        dealt = dealt.unionByName(heads.select(F.col("before").alias("r"), F.lit(1).alias("head"), "k", "h", "t"))
    dealt = dealt.repartitionById(count, F.col("r")).sortWithinPartitions("r", "head", F.asc_nulls_first("k"), "h", "t").select("r", "head", "k", "t")

    def runs(batches) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        size_held, at = 0, None
        for batch in batches:
            for r, head, k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != at:
                    held, size_held, at = [], 0, r
                if head:
                    if held:
                        yield work(held, t)
                    held, size_held = [], 0
                    continue
                if size_held >= size:
                    yield work(held, t)
                    held, size_held = [], 0
                held.append((k, t))
                size_held += len(t)

    def walk(batches):
        for rows in runs(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return dealt.mapInArrow(walk, schema)
