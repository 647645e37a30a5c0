"""Operators on small fixtures: edges, ties, errors, and the order-dependent ones against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from granary.functions import access, content, names
from granary.operators import audit, catalog, chunks, ordered, users
from granary.plans import maintenance, reads


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("size", "want"), [(8192, [4096, 4096]), (5120, [4096, 1024]), (100, [100]), (0, [0])])
def test_chunk_sizes(spark, size, want):
    df = spark.createDataFrame([("f", bytes(size))], "file_id string, content binary")
    assert [r[1] for r in rows(chunks.chunks(df, 4096), "idx", "size")] == want


def test_null_content_has_no_chunks(spark):
    df = spark.createDataFrame([("f", None)], "file_id string, content binary")
    assert chunks.chunks(df, 512).count() == 0


@pytest.mark.parametrize("k", [512, 700, 8192])
def test_reassembly(spark, k):
    r = random.Random(k)
    data = [(f"f{i}", bytes(r.randrange(256) for _ in range(r.randrange(0, 5000)))) for i in range(12)]
    df = spark.createDataFrame(data, "file_id string, content binary")
    assert {x.file_id: bytes(x.content) for x in reads.whole(chunks.chunks(df, k)).collect()} == dict(data)


def test_byte_ranges(spark):
    data = bytes(i * 31 % 251 for i in range(100 << 10))
    df = spark.createDataFrame([("f", data), ("e", b"")], "file_id string, content binary")
    files = df.select("file_id", F.octet_length("content").alias("file_size"))
    asked = [(0, "f", 0, 1023), (1, "f", len(data) - 500, len(data) - 1), (2, "f", 4059, 20499), (3, "f", 100, 10**9), (4, "f", len(data), len(data)), (5, "f", 100, 50), (6, "e", 0, 0), (7, "x", 0, 0)]
    requests = spark.createDataFrame(asked, "request_id long, file_id string, first long, last long")
    got = {r.request_id: (r.status, r.content and bytes(r.content)) for r in reads.byte_ranges(chunks.chunks(df, 4096), requests, files).collect()}
    assert [got[k] for k in range(4)] == [("ok", data[a : b + 1]) for _, _, a, b in asked[:4]]
    assert [got[k] for k in range(4, 8)] == [("unsatisfiable", None)] * 3 + [("missing", None)]


def test_hashes(spark):
    h = F.lit("hello").cast("binary")
    r = spark.range(1).select(*(content.content_hash(h, a).alias(a) for a in content.ALGORITHMS)).first()
    assert r.sha256.startswith("2cf24dba") and r.md5.startswith("5d41402a") and r.sha1.startswith("aaf4c61d") and r.none == ""
    with pytest.raises(ValueError):
        content.content_hash(h, "crc")


@pytest.mark.parametrize("codec", ["none", "lz4", "zstd"])
def test_codecs_round_trip(spark, codec):
    data = [b"", b"abc" * 1000, bytes(range(256)) * 40, None]
    df = spark.createDataFrame([(d, len(d or b"")) for d in data], "d binary, n long")
    back = df.withColumn("c", content.compress(F.col("d"), codec, 0)).select("d", content.decompress(F.col("c"), F.col("n"), codec).alias("b")).collect()
    assert all(r.d == r.b for r in back)


def test_format_bytes(spark):
    n = [0, 1023, 1024, 1 << 20, 1 << 30]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in n], "n long").select(content.format_bytes(F.col("n"))).collect()]
    assert got == ["0 B", "1023 B", "1.00 KB", "1.00 MB", "1.00 GB"]


def test_format_bytes_units_and_ties(spark):
    n = [None, 1024 + 128, 1024 + 384, (1 << 20) - 1, 1 << 40, 1005 << 30]
    df = spark.createDataFrame([(x,) for x in n], "n long").select(content.format_bytes(F.col("n")).alias("tb"), content.format_bytes(F.col("n"), "GB").alias("gb"))
    got = [tuple(r) for r in df.collect()]
    assert got == [(None, None), ("1.12 KB", "1.12 KB"), ("1.38 KB", "1.38 KB"), ("1024.00 KB", "1024.00 KB"), ("1.00 TB", "1024.00 GB"), ("1005.00 GB", "1005.00 GB")]


def test_file_ids(spark):
    ids = ["ok/id", "é", "é", "", "a\tb", "a/../b", "/a", "a//b", "x" * 1024, "x" * 1025]
    df = spark.createDataFrame([(x,) for x in ids], "i string").select(names.normalised_id(F.col("i")).alias("i"))
    got = [r[1] for r in df.select("i", names.id_problem(F.col("i"))).collect()]
    assert got == [None, None, None, "empty", "control character", "dot segment", "slash at an end", "empty segment", None, "too long"]
    assert df.collect()[1].i == df.collect()[2].i


def test_range_headers(spark):
    cases = [("bytes=0-99", 1000), ("bytes=500-", 1000), ("bytes=-100", 1000), ("bytes=0-9999", 1000), ("bytes=0-1,2-3", 1000), ("bytes=2000-", 1000), ("items=1-2", 1000), ("bytes=5-3", 1000), ("bytes=-0", 9), ("bytes=0-0", 0), ("bytes=-", 9), (None, 9)]
    df = spark.createDataFrame(cases, "h string, n long").select(names.byte_range(F.col("h"), F.col("n")).alias("r"))
    got = [tuple(r.r) for r in df.collect()]
    assert got[:4] == [("ok", 0, 99), ("ok", 500, 999), ("ok", 900, 999), ("ok", 0, 999)]
    assert [g[0] for g in got[4:]] == ["multi", "unsatisfiable", "malformed", "unsatisfiable", "unsatisfiable", "unsatisfiable", "malformed", "malformed"]


def test_partition_lists(spark):
    df = spark.createDataFrame([(None, 5), (["5"], 5), (["6"], 5), ([], 5)], "a array<string>, p long")
    assert [r[0] for r in df.select(access.partition_allowed(F.col("a"), F.col("p"))).collect()] == [True, True, False, False]


def test_resolution_and_counts(spark):
    cut = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, "c")], "f long, idx long, hash string")
    index = spark.createDataFrame([("c", "blk", 72)], "hash string, block_id string, offset long")
    assert rows(chunks.resolve(cut, index, [F.col("f"), F.col("idx")]), "f", "idx", "stored") == [(1, 0, "new"), (1, 1, "new"), (2, 0, "batch"), (2, 1, "index")]


def test_block_fill_is_a_plain_loop(spark):
    r = random.Random(5)
    data = [(lane, k, r.randrange(0, 900)) for lane in range(3) for k in range(200)]
    df = spark.createDataFrame(data, "lane long, k long, size long").withColumn("stored_size", F.col("size") / 2).withColumn("stored_size", F.col("stored_size").cast("long"))
    want = []
    for lane in range(3):
        block, at = 0, 72
        for _, k, n in [d for d in data if d[0] == lane]:
            if at > 72 and at + n >= 4096:
                block, at = block + 1, 72
            want.append((lane, k, block, at))
            at += n // 2
    assert rows(chunks.fill_blocks(df, "lane", ["k"], 4096), "lane", "k", "block_no", "offset") == sorted(want, key=repr)


def test_nearest_ranks(spark):
    r = random.Random(1)
    data = [(g, float(r.randrange(40))) for g in "ab" for _ in range(r.randrange(50, 200))] + [("one", 3.0)]
    got = {(x.op, x.percent): x.elapsed for x in ordered.nearest_ranks(spark.createDataFrame(data, "op string, elapsed double"), "op", "elapsed", [0, 50, 95, 100]).collect()}
    for op in ("a", "b", "one"):
        v = sorted(x for g, x in data if g == op)
        assert [got[op, p] for p in (0, 50, 95, 100)] == [v[round(p / 100 * (len(v) - 1))] for p in (0, 50, 95, 100)]


def test_policies(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "file_id string, arrival long")
    known = spark.createDataFrame([("y",)], "file_id string")
    assert rows(catalog.put(a, known, "skip"), "file_id", "arrival", "outcome") == [("x", 1, "Created"), ("x", 2, "Skipped"), ("y", 3, "Skipped")]
    assert rows(catalog.survivors(a, "overwrite"), "file_id", "arrival") == [("x", 2), ("y", 3)]


def test_deltas_never_below_zero(spark):
    blocks = spark.createDataFrame([("b", 2), ("c", 1)], "block_id string, ref_count long")
    deltas = spark.createDataFrame([("b", -10), ("z", 1)], "block_id string, delta long")
    assert rows(catalog.apply_deltas(blocks, deltas), "block_id", "ref_count") == [("b", 0), ("c", 1)]
    assert rows(catalog.unknown_blocks(deltas, blocks), "block_id") == [("z",)]


def test_audit_bounds(spark):
    e = spark.createDataFrame([(100, 1, "k1", "auth.login"), (200, 2, "k1", "auth.logout"), (150, 3, "k2", "key.create")], "ts long, seq long, actor_key_id string, action string")
    assert [r.ts for r in audit.page(e).orderBy("place").collect()] == [200, 150, 100]
    assert audit.page(e, actor="k1").count() == 2 and audit.page(e, action_prefix="auth.").count() == 2 and audit.page(e, 120, 180).count() == 1
    assert tuple(audit.purged(e, 150).first()) == (1, 2)


def test_compaction_trims(spark):
    blocks = spark.createDataFrame([(1, 100, True, 0), (2, 100, True, 0), (3, 100, False, 0), (4, 0, True, 0)], "block_id long, size long, sealed boolean, create_time long").withColumn("ref_count", F.lit(1))
    live = spark.createDataFrame([(1, 10, 1), (2, 90, 1)], "block_id long, live_bytes long, live_chunks long")
    options = maintenance.CompactionOptions(threshold=0.5, block_size=1000)
    found = maintenance.candidates(maintenance.utilisation(blocks, live), spark.createDataFrame([], "block_id long"), options, now=10)
    assert rows(found, "block_id", "reason") == [(1, "low_util")]
    assert rows(maintenance.commits(maintenance.groups(found, options, F.lit(0)), options), "members", "strategy") == [(1, "low_util")]
    old = maintenance.CompactionOptions(threshold=0.5, block_size=1000, min_age=3600)
    assert maintenance.candidates(maintenance.utilisation(blocks, live), spark.createDataFrame([], "block_id long"), old, now=10).count() == 0


def test_remap_follows_one_copy(spark):
    refs = spark.createDataFrame([("f", 0, "b1", "h", 72, 5), ("g", 0, "b2", "h", 90, 5), ("g", 1, "b3", "i", 72, 7)], "file_id string, idx long, block_id string, hash string, offset long, compressed_size long")
    moved = spark.createDataFrame([("b1", "h", "n", 72, 4), ("b1", "h", "n", 99, 4), ("b2", "h", "n", 72, 4)], "block_id string, hash string, new_block_id string, new_offset long, new_size long")
    assert rows(maintenance.remap(refs, moved), "file_id", "idx", "block_id", "offset", "compressed_size") == [("f", 0, "n", 72, 4), ("g", 0, "n", 72, 4), ("g", 1, "b3", 72, 7)]
    assert maintenance.unmatched(refs, moved).count() == 0


def test_scrub_finds_damage(spark):
    cut = chunks.chunks(spark.createDataFrame([("f", b"a" * 1000)], "file_id string, content binary"), 300).withColumn("block_id", F.lit("b"))
    assert maintenance.scrub_report(maintenance.scrub(cut)).first().faults == 0
    broken = cut.withColumn("bytes", F.when(F.col("idx") == 1, F.lit(b"x" * 300)).otherwise(F.col("bytes")))
    assert tuple(maintenance.scrub_report(maintenance.scrub(broken)).first()) == (1, 1, 4, 1, 1000)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "file_id string, content binary")
    cut = chunks.chunks(none, 512)
    assert chunks.dedup_stats(cut).first().chunks is None and reads.whole(cut).count() == 0
    assert catalog.totals(spark.createDataFrame([], "file_size long"), spark.createDataFrame([], "size long")).first().dedup_ratio == 1.0
    assert ordered.nearest_ranks(spark.createDataFrame([], "op string, elapsed double"), "op", "elapsed", [50]).count() == 0


def test_chunks_without_hashes_keep_apart(spark):
    """Two files of different content: both come back whole, and nothing of them is taken as the other's."""
    files = spark.createDataFrame([("a", b"x" * 10), ("b", b"y" * 10)], "file_id string, content binary")
    cut = chunks.identified(chunks.chunks(files, 4, algorithm="none"))
    assert chunks.dedup_stats(cut).first().unique_chunks == 6
    index = spark.createDataFrame([], "hash string, block_id long, offset long")
    assert {r.stored for r in chunks.resolve(cut, index, [F.col("file_id"), F.col("idx")]).collect()} == {"new"}
    assert sorted((r.file_id, bytes(r.content)) for r in reads.whole(cut.drop("hash").join(cut.select("file_id", "idx", "hash"), ["file_id", "idx"])).collect()) == [("a", b"x" * 10), ("b", b"y" * 10)]


def test_long_files_come_back_in_order(spark):
    data = bytes(range(256)) * 40
    files = spark.createDataFrame([("a", data), ("b", b""), ("c", data[:7])], "file_id string, content binary")
    assert {r.file_id: bytes(r.content) for r in reads.whole(chunks.chunks(files, 3).repartition(7)).collect()} == {"a": data, "b": b"", "c": data[:7]}


def test_pages_by_key_are_pages_by_offset(spark):
    files = spark.createDataFrame([(f"f{k}", k // 3) for k in range(25)], "file_id string, create_time long")
    pages, last = [], None
    while page := sorted(catalog.listing_after(files, last, 7).collect(), key=lambda r: r.place):
        pages += page
        last = page[-1].create_time, page[-1].file_id
    assert [r.file_id for r in pages] == [r.file_id for r in files.orderBy(F.desc("create_time"), F.desc("file_id")).collect()]


def test_fold_leaves_other_columns_alone(spark):
    df = spark.createDataFrame([(k % 2, k, k + 1, bytes([k]), [k], {"k": k}) for k in range(20)], "lane int, k int, n int, raw binary, many array<int>, map map<string,int>")
    got = ordered.fold(df, "lane", ["k"], lambda s, r: ((s or 0) + r["n"], ((s or 0) + r["n"],)), {"total": "long"}, ["n"]).collect()
    for r in got:
        assert r.total == sum(k + 1 for k in range(r.lane, r.k + 1, 2)) and bytes(r.raw) == bytes([r.k]) and r.many == [r.k] and r.map == {"k": r.k}


def test_keys_and_users(spark):
    keys = spark.createDataFrame([(1, "h1", 5), (2, "h2", None)], "key_id int, key_hash string, last_used long")
    turned = users.rotate(keys, spark.createDataFrame([(1, "n1")], "key_id int, new_hash string"))
    assert rows(turned.orderBy("key_id"), "key_id", "key_hash") == [(1, "n1"), (2, "h2")]
    used = users.touch(turned, spark.createDataFrame([(1, 3), (2, 7), (2, 6), (9, 1)], "key_id int, at long"))
    assert rows(used.orderBy("key_id"), "key_id", "last_used") == [(1, 5), (2, 7)]
    people = spark.createDataFrame([("root", True, True), ("ann", True, False)], "username string, enabled boolean, is_root boolean")
    saved = users.save_users(people, spark.createDataFrame([("root", False, False), ("ann", False, False), ("bo", True, False)], people.schema))
    assert sorted(tuple(r) for r in saved.collect()) == [("ann", False, False), ("bo", True, False), ("root", True, True)]
    found = users.key_owner(spark.createDataFrame([("n1",), ("zz",)], "key_hash string"), turned.withColumn("parent_user", F.lit("ann")))
    assert rows(found, "key_id", "parent_user") == [(1, "ann")]


def test_small_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    assert get(names.download_header(F.lit("a b\u00e9.txt"))) == "attachment; filename=\"a b__.txt\"; filename*=UTF-8''a%20b%C3%A9.txt"
    assert [get(content.from_hex(F.lit(x))) for x in ("00ff", "0", "zz", "")] == [bytearray(b"\0\xff"), None, None, bytearray()]
    assert [get(names.retryable(F.lit(x))) for x in ("Io", "NotFound")] == [True, False] and get(names.retryable(F.lit(None).cast("string"))) is False
    assert [get(access.scopes_valid(F.array(*map(F.lit, s)))) for s in (("read",), ("read", "root"))] == [True, False]
    assert [get(names.duration_text(F.lit(s))) for s in (45, 185, 7260, 356_520)] == ["45s", "3m 5s", "2h 1m", "4d 3h 2m"]
    events = spark.createDataFrame([(1,), (5,)], "ts long")
    assert audit.retained(events, 5).count() == 1
    files = spark.createDataFrame([("a", 1), ("b", 2)], "file_id string, create_time long")
    assert [r.file_id for r in catalog.newest_first(files).collect()] == ["b", "a"]


def test_codec_sizes_are_those_of_the_library(spark):
    import pyarrow as pa

    raw = [b"abc" * 100, b"", bytes(range(256))]
    df = spark.createDataFrame([(x,) for x in raw], "raw binary")
    for codec, level in (("zstd", 1), ("zstd", 9), ("lz4", 0)):
        c = pa.Codec("zstd", level) if codec == "zstd" else pa.Codec("lz4")
        got = df.select(F.octet_length(content.compress(F.col("raw"), codec, level)).alias("n")).collect()
        assert sorted(r.n for r in got) == sorted(len(c.compress(x)) for x in raw)


def test_blocks_are_dealt_by_their_rows(spark):
    df = spark.range(100).selectExpr("id % 7 AS block_id", "id AS hash", "1L AS compressed_size", "72 + id AS offset")
    few, many = maintenance.by_block(df, 100), maintenance.by_block(df, 20 * maintenance.DEALT + 1)
    assert many.rdd.getNumPartitions() == 21 and few.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, maintenance.reseal(many).collect())) == sorted(map(tuple, maintenance.reseal(df).collect()))
