"""Work that follows an order: folds over lanes, running sums over whole tables, exact ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def fold(df: DataFrame, lane: str, order: list[str], step: Callable, out: dict[str, str], reads: list[str]) -> DataFrame:
    """df with the columns that step(state, row) -> (state, values) yields for each row of a lane, in order.

    reads: the columns that step looks at; all others stay in Arrow as they are. A lane's rows stream through one task in Arrow batches; the state is None at a lane's start. Lanes are dealt to
    tasks by hash and sorted there, so memory does not grow with a lane.
    """
    names = df.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{n}` {t}" for n, t in out.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at = None, object()
        for batch in batches:
            rows = []
            lanes, seen = batch.column(names.index(lane)).to_pylist(), batch.select(reads).to_pylist()
            for own, row in zip(lanes, seen, strict=True):
                if own != at:
                    state, at = None, own
                state, values = step(state, row)
                rows.append(values)
            columns = list(zip(*rows, strict=True)) or [()] * len(out)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, _ARROW[t]) for c, t in zip(columns, out.values(), strict=True))], names=[*names, *out])

    return df.repartition(F.col(lane)).sortWithinPartitions(lane, *order).mapInArrow(run, schema)


def ranges(df: DataFrame, by: Column, count: int) -> list:
    """Bounds that cut the values into ranges of about equal size; count - 1 values come to the driver."""
    found = df.agg(F.percentile_approx(by, [k / count for k in range(1, count)], 50 * count).alias("b")).first()["b"] if count > 1 else None
    return sorted(set(found or []))


def in_range(by: Column, bounds: list) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < by)) if bounds else F.lit(0)


def nearest_ranks(df: DataFrame, group: str, value: str, percents: list[int], count: int = 64) -> DataFrame:
    """group, percent, value: the element at index round-half-even(p / 100 * (n - 1)) of each group in ascending order.

    Equal values are counted first, so ties cost one row; running counts are kept for each group and range of values,
    and the ranges' totals carry them over, so no group needs to fit a task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("_range", in_range(F.col(value), ranges(df, F.col(value), count)))
    totals = counts.groupBy(group, "_range").agg(F.sum("n").alias("_in"))
    w = Window.partitionBy(group).orderBy("_range")
    totals = totals.select(group, "_range", F.coalesce(F.sum("_in").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_in").over(Window.partitionBy(group)).alias("_all"))
    inside = Window.partitionBy(group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ends = counts.withColumn("_end", F.sum("n").over(inside)).join(totals, [group, "_range"]).withColumn("_end", F.col("_end") + F.col("_before"))
    wanted = F.explode(F.array(*map(F.lit, percents)))
    asked = ends.withColumn("percent", wanted).withColumn("_k", F.bround(F.col("percent") / 100 * (F.col("_all") - 1)).cast("long"))
    return asked.where((F.col("_k") < F.col("_end")) & (F.col("_k") >= F.col("_end") - F.col("n"))).select(group, "percent", value)


def latest(df: DataFrame, keys: list[str], order: Column, n: int) -> DataFrame:
    """The last n rows of each key, the newest numbered 1; the limit goes below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def one_row(*parts: DataFrame) -> DataFrame:
    """The columns of several tables of one row each as one row, without a join."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.agg(*(F.max(c).alias(c) for p in parts for c in p.columns))


def top(df: DataFrame, keys: list[Column], n: int) -> DataFrame:
    """The first n rows in an order, with place (from 0). Only those n meet in one task."""
    return df.orderBy(*keys).limit(n).withColumn("place", (F.row_number().over(Window.orderBy(*keys)) - 1).cast("long"))


def written(df: DataFrame, what: str) -> DataFrame:
    """Write the rows to the folder that driver and executors share and read them again, for what is used more than once."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{root or tempfile.mkdtemp(prefix='shared-')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def places(df: DataFrame, group: str, value: str, tie: str, count: int = 64) -> DataFrame:
    """df with place (from 0) of every row of a group: by value (a double, nulls first), then by tie (a number).

    Rows are dealt to ranges of values, and those of a null or of a value that is a bound, as frequent ones are, to
    ranges of ties; places inside a range go up by the rows of the ranges before it. Bounds come to the driver once.
    """
    shares = [k / count for k in range(1, count)]
    bounds = df.groupBy(group).agg(F.percentile_approx(value, shares, 50 * count).alias("_values"), F.percentile_approx(F.col(tie).cast("double"), shares, 50 * count).alias("_ties")).collect()
    schema = f"`{group}` {df.schema[group].dataType.simpleString()}, _values array<double>, _ties array<double>"
    fixed = df.sparkSession.createDataFrame([(b[group], sorted(set(b["_values"] or [])), sorted(set(b["_ties"] or []))) for b in bounds], schema)
    below = F.size(F.filter("_values", lambda b: b < F.col(value)))
    equal = F.array_contains("_values", F.col(value))
    dealt = df.join(F.broadcast(fixed), group)
    dealt = dealt.withColumn("_range", F.when(F.col(value).isNull(), -1).otherwise(2 * below + equal.cast("int")))
    dealt = dealt.withColumn("_part", F.when(F.col(value).isNull() | equal, F.size(F.filter("_ties", lambda b: b < F.col(tie)))).otherwise(0)).drop("_values", "_ties")
    at = [group, "_range", "_part"]
    earlier = Window.partitionBy(group).orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).select(*at, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*at).orderBy(F.asc_nulls_first(value), tie)) - 1
    return dealt.withColumn("_in", inside).join(before, at).withColumn("place", F.col("_in") + F.col("_before")).drop("_range", "_part", "_in", "_before")
