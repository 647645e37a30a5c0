"""Files around a collection, read by Spark's own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def containers(spark: SparkSession, root: str) -> DataFrame:
    """block_id, path, size of all *.blk files under a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.blk").option("recursiveFileLookup", True).load(root)
    return found.select(F.regexp_extract("path", r"([^/]+)\.blk$", 1).alias("block_id"), "path", F.col("length").alias("size"))


def archive_index(spark: SparkSession, root: str) -> DataFrame:
    """path (below root) and size of every file of an export."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select(F.regexp_replace("path", f"^.*?{root.rstrip('/')}/", "").alias("path"), F.col("length").alias("size"))


def objects(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """file_id (the path below root), content of files to take in."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return found.select(F.regexp_replace("path", f"^.*?{root.rstrip('/')}/", "").alias("file_id"), "content")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema="subtree string, path string, size bigint, content_hash string")


#: Fixed values of the text exposition format: the characters of a name, and what follows a backslash in a label.
_NAME = "[a-zA-Z_:][a-zA-Z0-9_:]*"
_ESCAPED = {"\\\\": "\\", '\\"': '"', "\\n": "\n"}


def _unescaped(text: Column) -> Column:
    for written, meant in _ESCAPED.items():
        text = F.replace(text, F.lit(written), F.lit(meant))
    return text


def samples(lines: DataFrame, column: str = "value") -> DataFrame:
    """name, labels (a map), value, at (milliseconds, or null) of each sample of a page in the text exposition format.

    A line is a name, labels in braces if there are any, a value (NaN and infinities too), and a time if one is given.
    Comments, empty lines and lines of any other form give no row.
    """
    line = F.btrim(F.col(column))
    name = F.regexp_substr(line, F.lit(f"^{_NAME}"))
    rest = F.btrim(F.substr(line, F.char_length(name) + 1))
    # the braces end where a label's last quote has been followed by one
    braces = F.when(rest.startswith("{"), F.regexp_substr(rest, F.lit(r'^\{(?:[^"}]|"(?:[^"\\]|\\.)*")*\}'))).otherwise(F.lit(""))
    numbers = F.split(F.btrim(F.substr(rest, F.char_length(braces) + 1)), r"\s+")
    pairs = F.regexp_extract_all(braces, F.lit(r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'), F.lit(1)), F.regexp_extract_all(braces, F.lit(r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'), F.lit(2))
    labels = F.map_from_arrays(F.array_distinct(pairs[0]), F.transform(pairs[1], _unescaped))
    number = F.get(numbers, F.lit(0))
    value = F.when(F.lower(number).isin("+inf", "inf"), F.lit(float("inf"))).when(F.lower(number) == "-inf", F.lit(float("-inf"))).otherwise(number.try_cast("double"))
    found = lines.where(~line.startswith("#")).select(name.alias("name"), labels.alias("labels"), value.alias("value"), F.get(numbers, F.lit(1)).try_cast("long").alias("at"), F.size(numbers).alias("_n"))
    return found.where("name is not null and labels is not null and value is not null and (_n = 1 or _n = 2 and at is not null)").drop("_n")


def declared(lines: DataFrame, column: str = "value") -> DataFrame:
    """name, kind: what the page's TYPE comments say (counter, gauge, histogram, summary, untyped)."""
    words = F.split(F.btrim(F.col(column)), r"\s+")
    return lines.select(words.alias("w")).where((F.get("w", F.lit(0)) == "#") & (F.get("w", F.lit(1)) == "TYPE") & (F.size("w") == 4)).select(F.col("w")[2].alias("name"), F.col("w")[3].alias("kind")).distinct()


def metrics(lines: DataFrame, column: str = "value") -> DataFrame:
    """name, labels, kind, value, count, sum, mean, quantiles of each series of a page.

    Samples of a summary or a histogram (by its TYPE; without one, where a name has both a sum and a count) become one
    row for each set of labels: its count, sum, their mean, and its quantiles as a map. All others are rows with a
    value. Labels are kept, so counters by policy or reason stay apart.
    """
    kinds = declared(lines, column)
    each = samples(lines, column).withColumn("end", F.when(F.col("name").endswith("_sum"), "sum").when(F.col("name").endswith("_count"), "count"))
    each = each.withColumn("base", F.when(F.col("end").isNotNull(), F.left("name", F.char_length("name") - F.char_length("end") - 1)).otherwise(F.col("name")))
    whole = each.where("end is not null").groupBy("base").agg(F.count_distinct("end").alias("n")).where("n = 2").select("base", F.lit(True).alias("both"))
    each = each.join(whole, "base", "left").join(kinds.withColumnRenamed("name", "base"), "base", "left")
    together = F.coalesce(F.col("kind").isin("summary", "histogram"), F.col("both"), F.lit(False))
    each = each.withColumn("base", F.when(together, F.col("base")).otherwise(F.col("name"))).withColumn("end", F.when(together, F.col("end")))
    quantile = F.when(together, F.col("labels")["quantile"])
    own = F.map_filter("labels", lambda k, _: ~(together & k.isin("quantile", "le")))
    rows = each.select("base", F.array_sort(F.map_entries(own)).alias("labels"), F.when(together, F.coalesce("kind", F.lit("summary"))).otherwise(F.coalesce("kind", F.lit("untyped"))).alias("kind"), "end", quantile.alias("quantile"), together.alias("together"), "value")
    at = lambda end: F.max(F.when(F.col("end") == end, F.col("value")))
    quantiles = F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("quantile").isNotNull(), F.struct("quantile", "value")))))
    value = F.max(F.when(~F.col("together"), F.col("value")))
    g = rows.groupBy("base", "labels", "kind").agg(value.alias("value"), at("count").alias("count"), at("sum").alias("sum"), quantiles.alias("quantiles"))
    return g.select(F.col("base").alias("name"), F.map_from_entries("labels").alias("labels"), "kind", "value", "count", "sum", F.when(F.col("count") > 0, F.col("sum") / F.col("count")).alias("mean"), "quantiles")
