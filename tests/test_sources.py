"""Readers, options, exports and streams."""

import pytest
from pyspark.sql import functions as F

from granary.sources import exports, files, options
from granary.streaming import ingest


def test_containers_and_objects(spark, tmp_path):
    (tmp_path / "aa" / "bb").mkdir(parents=True)
    (tmp_path / "aa" / "bb" / "aabb01.blk").write_bytes(b"12345")
    (tmp_path / "aa" / "note.txt").write_bytes(b"hi")
    assert [(r.block_id, r.size) for r in files.containers(spark, str(tmp_path)).collect()] == [("aabb01", 5)]
    assert sorted(r.file_id for r in files.objects(spark, str(tmp_path)).collect()) == ["aa/bb/aabb01.blk", "aa/note.txt"]
    assert sorted(tuple(r) for r in files.archive_index(spark, str(tmp_path)).collect()) == [("aa/bb/aabb01.blk", 5), ("aa/note.txt", 2)]


def test_metrics(spark):
    text = [
        "# HELP x", "# TYPE put_seconds summary", "# TYPE gets_total counter", "", "puts_total 12", 'gets_total{kind="a",why="it \\"is\\", {so}"} 3 1700000000000', 'gets_total{kind="b"} 4', "put_seconds_count 4",
        "put_seconds_sum 2", 'put_seconds{quantile="0.5"} 0.25', 'put_seconds{quantile="0.9"} 1e-1', "depth -Inf", "odd NaN", "nonsense line here", "broken{a=1} x", "9bad 1", "orphan_sum 7", "late 1 2 3",
    ]
    got = {(r.name, tuple(sorted((r.labels or {}).items()))): r for r in files.metrics(spark.createDataFrame([(x,) for x in text], "value string")).collect()}
    assert set(got) == {("puts_total", ()), ("gets_total", (("kind", "a"), ("why", 'it "is", {so}'))), ("gets_total", (("kind", "b"),)), ("put_seconds", ()), ("depth", ()), ("odd", ()), ("orphan_sum", ())}
    assert got["puts_total", ()].value == 12 and got["gets_total", (("kind", "b"),)].kind == "counter" and got["orphan_sum", ()].value == 7
    whole = got["put_seconds", ()]
    assert (whole.kind, whole["count"], whole["sum"], whole.mean, whole.quantiles) == ("summary", 4, 2, 0.5, {"0.5": 0.25, "0.9": 0.1})
    assert [r.at for r in files.samples(spark.createDataFrame([(text[5],)], "value string")).collect()] == [1700000000000]


def test_options():
    assert options.from_toml("[storage]\nchunk_size = 1024\nblock_size = 4096").chunk_size == 1024
    for bad in ("chunk_size = 1", "codec = 'gzip'", "nothing = 1", "compaction_threshold = 2.0", "block_size = 600\nchunk_size = 700"):
        with pytest.raises(ValueError):
            options.from_toml(bad)
    for retired in options.RETIRED:
        with pytest.raises(ValueError, match="no longer"):
            options.from_toml(f"[storage]\n{retired} = 1")
    assert all(t.checked() for t in options.TEMPLATES.values())


def test_exports(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([("s", p, c.encode()) for p, c in r], "subtree string, path string, content binary")
    one, two, target = (str(tmp_path / n) for n in ("one", "two", "target"))
    whole = exports.write_export(rows(("a", "1"), ("b", "2")), one)
    exports.write_export(rows(("a", "1"), ("b", "3"), ("c", "")), two, whole)
    assert sorted(r.path for r in spark.read.parquet(f"{two}/entries").collect()) == ["b", "c"]
    back = exports.restore(spark, [one, two], target)
    assert sorted((r.path, bytes(r.content)) for r in back.collect()) == [("a", b"1"), ("b", b"3"), ("c", b"")]
    with pytest.raises(Exception, match="(?i)exist"):
        exports.restore(spark, [one], target)
    assert exports.restore(spark, [one], target, force=True).count() == 2
    with pytest.raises(ValueError, match="holds a"):
        exports.restore(spark, [two], str(tmp_path / "other"))
    with pytest.raises(Exception, match="(?i)exist"):
        exports.write_export(rows(("a", "1")), one)
    exports.manifest(spark, one).withColumn("version", F.lit(9)).write.parquet(f"{tmp_path}/later/manifest")
    with pytest.raises(ValueError, match="version 9"):
        exports.restore(spark, [str(tmp_path / "later")], str(tmp_path / "other"))


def test_manifest_lines(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"subtree": "s", "path": "a/b", "size": 3, "content_hash": "00"}\n')
    assert [tuple(r) for r in files.manifest(spark, str(tmp_path / "m.json")).collect()] == [("s", "a/b", 3, "00")]


def test_stream_ingest(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.lit("d"), "doc_id").alias("file_id"), F.col("text").cast("binary").alias("content"))
    source = str(tmp_path / "in")
    docs.repartition(3).write.parquet(source)
    query = ingest.ingest(ingest.arriving(spark, source, "file_id string, content binary", 1), str(tmp_path / "out"), str(tmp_path / "cp"), 1024)
    query.awaitTermination(120)
    references, stored = spark.read.parquet(str(tmp_path / "out" / "references")), spark.read.parquet(str(tmp_path / "out" / "stored"))
    assert references.select("file_id").distinct().count() == docs.count()
    assert stored.count() == stored.select("hash").distinct().count() == references.select("hash").distinct().count()


def test_windowed_arrivals(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", F.lit(2).cast("long").alias("size"))
    source = str(tmp_path / "in")
    events.coalesce(1).write.parquet(source)
    counted = ingest.arrivals_by_partition(spark.readStream.schema(events.schema).parquet(source))
    q = counted.writeStream.format("memory").queryName("arrivals").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("arrivals").groupBy("partition_id").agg(F.max("files").alias("n"))
    assert rows.agg(F.sum("n")).first()[0] == events.count()
