"""More registered queries: lookups, errors, exports, results of maintenance, keys and users, counters."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import relations as R
from .functions import access, content, names
from .operators import audit, catalog, chunks, users
from .plans import maintenance
from .queries import _CANDIDATES, _MOVED, _OPTIONS, _candidates, _moved, _used
from .registry import query
from .sources import exports

# lookups and errors


@query(f"""WITH {R.FILES} SELECT w.file_id AS asked, f.file_id, f.file_size
  FROM (VALUES ('doc-1'), ('doc-17'), ('doc-none')) w(file_id) LEFT JOIN files f USING (file_id)""")
def file_lookup(spark, sf_dir):
    """SRC-2, SRC-3: one file by its key, and a key that no file has."""
    files = R.files(spark, sf_dir)
    one = lambda key: spark.createDataFrame([(key,)], "asked string").join(catalog.lookup(files, "file_id", key), F.col("asked") == F.col("file_id"), "left").select("asked", "file_id", "file_size")
    return one("doc-1").unionByName(one("doc-17")).unionByName(one("doc-none"))


@query(f"WITH {R.STORE} SELECT block_id, region, size, ref_count FROM blocks WHERE block_id = 5")
def block_lookup(spark, sf_dir):
    """SRC-6: one block by its key."""
    return catalog.lookup(R.blocks(spark, sf_dir), "block_id", 5).select("block_id", "region", "size", "ref_count")


@query(f"""WITH {R.FILES} SELECT file_id, create_time, row_number() OVER (ORDER BY create_time DESC, file_id DESC) - 1 AS place
  FROM files WHERE create_time < 360000 QUALIFY place < 50""")
def file_listing_after(spark, sf_dir):
    """SRT-1: the page after a known row; the limit is the page's."""
    return catalog.listing_after(R.files(spark, sf_dir), (360_000, ""), 50).select("file_id", "create_time", "place")


@query(f"""WITH {R.STORE}, b AS (SELECT block_id, md5(CAST(block_id AS VARCHAR)) AS name FROM blocks WHERE region <> 3)
  SELECT file_id, idx, r.block_id, substr(name, 1, 2) || '/' || substr(name, 3, 2) || '/' || name || '.blk' AS path, CASE WHEN name IS NULL THEN 'no block ' || r.block_id END AS error FROM refs r LEFT JOIN b ON r.block_id = b.block_id""")
def chunk_locations(spark, sf_dir):
    """JOIN-2: the container of every chunk; a block that is not known (region 3 is lost) is an error."""
    known = R.regions(spark, sf_dir).where("region != 3").select("block_id", names.container_path(F.md5(F.col("block_id").cast("string"))).alias("path"))
    return maintenance.located(R.references(spark, sf_dir), known).select("file_id", "idx", "block_id", "path", "error")


@query(f"WITH {R.STORE} SELECT file_id, count(DISTINCT block_id) AS blocks FROM refs GROUP BY 1 HAVING count(DISTINCT block_id) > 5")
def oversized_pools(spark, sf_dir):
    """CHK-7: files of too many blocks; five may be numbered here."""
    return chunks.oversized_pools(R.references(spark, sf_dir), most=5)


@query(f"""WITH {R.chunked_sql(512)} SELECT row_number() OVER (ORDER BY block_id, doc_id, idx) - 1 AS place, block_id, doc_id, idx, 'crc' AS fault
  FROM (SELECT substr(hash, 1, 2) AS block_id, doc_id, idx FROM chunks WHERE contains(digits, '2020')) QUALIFY place < 100""")
def scrub_errors(spark, sf_dir):
    """AGG-7, SRT-7: the first 100 faults, which is the report's limit; scrub_report counts all."""
    cut = R.chunked(spark, sf_dir, 512).withColumn("block_id", F.substring("hash", 1, 2))
    damaged = F.hex("bytes").contains("2020")
    stored = cut.withColumn("bytes", F.when(damaged, F.unhex(F.reverse(F.hex("bytes")))).otherwise(F.col("bytes")))
    return maintenance.scrub_errors(maintenance.scrub(stored), ["block_id", "doc_id", "idx"]).select("place", "block_id", "doc_id", "idx", "fault")


@query(f"""WITH {R.chunked_sql(1024)} SELECT doc_id, idx, size, sha256(from_hex(digits)) AS content FROM chunks
  WHERE hash IN (SELECT hash FROM chunks WHERE doc_id = 3 AND idx = 0)""")
def chunk_read(spark, sf_dir):
    """SRC-11: the stored chunks of one hash, read and checked."""
    stored = R.chunked(spark, sf_dir, 1024)
    asked = stored.where("doc_id = 3 and idx = 0").select("hash").distinct()
    found = stored.join(asked, "hash", "left_semi").where(content.checksum_holds(F.col("bytes"), F.col("crc")))
    return found.select("doc_id", "idx", "size", F.sha2("bytes", 256).alias("content"))


# chunks without hashes, sets, partitions


@query(f"""WITH {R.chunked_sql(1024)}, c AS (SELECT size, CASE WHEN lang = 'fr' THEN '=' || doc_id || '#' || idx ELSE hash END AS hash
  FROM chunks JOIN documents USING (doc_id))
  SELECT CAST(count(*) AS BIGINT) AS chunks, count(DISTINCT hash) AS unique_chunks, CAST(sum(size) AS BIGINT) AS raw_bytes, (SELECT CAST(sum(s) AS BIGINT) FROM (SELECT min(size) AS s FROM c GROUP BY hash)) AS unique_bytes FROM c""")
def hashless_dedup(spark, sf_dir):
    """CHK-3, FN-1: French documents are stored without hashes, so each of their chunks is its own."""
    french = R.table(spark, sf_dir, "documents").select("doc_id", (F.col("lang") == "fr").alias("plain"))
    cut = R.chunked(spark, sf_dir, 1024).join(french, "doc_id").withColumn("hash", F.when(F.col("plain"), "").otherwise(F.col("hash")))
    return chunks.dedup_stats(chunks.identified(cut, "doc_id"))


@query(f"WITH {R.STORE} SELECT hash FROM live_refs UNION SELECT hash FROM dedup WHERE block_id < 5")
def live_hashes(spark, sf_dir):
    """SET-1: hashes that references or the index hold."""
    return catalog.live_set(R.references(spark, sf_dir, live=True), R.dedup(spark, sf_dir).where("block_id < 5"), column="hash")


@query(f"WITH {R.FILES} SELECT file_id, partition_id = 2 AS removed FROM files")
def partition_deletion(spark, sf_dir):
    """SNK-7: the files that go with a partition, and those that stay."""
    kept, gone = catalog.delete_partition(R.files(spark, sf_dir), 2)
    return kept.select("file_id", F.lit(False).alias("removed")).unionByName(gone.select("file_id", F.lit(True).alias("removed")))


@query(f"""WITH {R.STORE}, n AS (SELECT block_id, 1 AS size, TRUE AS sealed FROM blocks WHERE region = 1
  UNION ALL SELECT -1, 1, TRUE) SELECT block_id, size, sealed FROM n UNION ALL SELECT block_id, size, sealed FROM blocks
  WHERE block_id NOT IN (SELECT block_id FROM n)""")
def block_upserts(spark, sf_dir):
    """SNK-8: blocks with those of region 1 replaced and one inserted."""
    blocks = R.blocks(spark, sf_dir)
    rows = blocks.where("region = 1").select("block_id").unionByName(spark.createDataFrame([(-1,)], "block_id long").select(F.col("block_id").cast(blocks.schema["block_id"].dataType)))
    return catalog.upsert(blocks.select("block_id", "size", "sealed"), rows.select("block_id", F.lit(1).cast("long").alias("size"), F.lit(True).alias("sealed")), "block_id")


@query("""SELECT r_name AS subtree, CAST(n_nationkey AS VARCHAR) AS path, sha256(n_name || CASE WHEN n_regionkey = 1 THEN '!' ELSE '' END) AS content_hash
  FROM nation JOIN region ON n_regionkey = r_regionkey""")
def export_restore(spark, sf_dir):
    """SNK-16, SNK-17, SRC-15: a whole export, one of what has changed since (region 1), and both restored."""
    named = R.table(spark, sf_dir, "nation").join(R.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entries = lambda end: named.select(F.col("r_name").alias("subtree"), F.col("n_nationkey").cast("string").alias("path"), F.concat("n_name", end).cast("binary").alias("content"))
    root = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='exports-')}/export-{uuid.uuid4().hex}"
    whole = exports.write_export(entries(F.lit("")), f"{root}/1")
    exports.write_export(entries(F.when(F.col("n_regionkey") == 1, "!").otherwise("")), f"{root}/2", whole)
    return exports.restore(spark, [f"{root}/1", f"{root}/2"], f"{root}/restored").select("subtree", "path", F.sha2("content", 256).alias("content_hash"))


# maintenance


def _grouped(spark, sf_dir) -> DataFrame:
    return maintenance.groups(_candidates(spark, sf_dir), _OPTIONS, F.col("region"))


@query(f"""WITH RECURSIVE {_CANDIDATES} SELECT p.block_id, CAST(sum(p.size) AS BIGINT) AS old_bytes, CAST(sum(p.live_bytes) AS BIGINT) AS new_bytes, CAST(sum(p.size - p.live_bytes) AS BIGINT) AS bytes_saved, CAST(sum(u.live_chunks) AS BIGINT) AS live_chunks
  FROM packed p JOIN committed c ON c.lane = p.region AND c.group_no = p.group_no JOIN used u ON u.block_id = p.block_id GROUP BY ROLLUP (p.block_id)""")
def compaction_results(spark, sf_dir):
    """AGG-6: what a compaction does with each source block, and in all."""
    grouped = _grouped(spark, sf_dir)
    return maintenance.result_rows(grouped, maintenance.commits(grouped, _OPTIONS))


_ALL = _CANDIDATES.replace("PARTITION BY region ORDER BY live_bytes, block_id", "ORDER BY live_bytes, block_id").replace("x.region = p.region AND x.n = p.n + 1", "x.n = p.n + 1").replace("SELECT region AS lane, group_no", "SELECT 0 AS lane, group_no")


@query(f"WITH RECURSIVE {_ALL} SELECT block_id, group_no FROM packed")
def compaction_groups_in_one_order(spark, sf_dir):
    """WIN-4: groups over all candidates in one order. A block holds a gigabyte or so, so 100 TB are some 100,000 rows,
    which one task streams; lanes (compaction_groups) are for more."""
    return maintenance.groups(_candidates(spark, sf_dir), _OPTIONS, F.lit(0)).select("block_id", "group_no")


@query(f"""WITH RECURSIVE {_ALL}, o AS (SELECT *, row_number() OVER (ORDER BY group_no) AS n FROM committed),
  b AS (SELECT n, group_no, 9000 >= live_bytes + 500 AS fits, 9000 - CASE WHEN 9000 >= live_bytes + 500 THEN live_bytes ELSE 0 END AS free FROM o WHERE n = 1
    UNION ALL SELECT o.n, o.group_no, b.free >= o.live_bytes + 500, b.free - CASE WHEN b.free >= o.live_bytes + 500 THEN o.live_bytes ELSE 0 END FROM b JOIN o ON o.n = b.n + 1)
  SELECT group_no FROM b WHERE fits""")
def compaction_one_budget(spark, sf_dir):
    """FLT-7: one budget for all groups, in their order."""
    committed = maintenance.commits(maintenance.groups(_candidates(spark, sf_dir), _OPTIONS, F.lit(0)), _OPTIONS)
    return maintenance.within_budget(committed, budget=9000, headroom=500).select("group_no")


@query(f"""WITH RECURSIVE {_CANDIDATES}{_MOVED} SELECT new_block_id, count(*) FILTER (block_id % 3 = 0) AS copied, count(*) FILTER (block_id % 3 <> 0) AS recompressed, CAST(coalesce(sum(new_size) FILTER (block_id % 3 = 0), 0) AS BIGINT) AS copied_bytes
  FROM moved GROUP BY 1""")
def merge_codecs(spark, sf_dir):
    """MNT-3: chunks that a merge copies as they lie (their codec is the target's), and those it compresses anew."""
    codec = F.when(F.col("block_id") % 3 == 0, "zstd").when(F.col("block_id") % 3 == 1, "lz4").otherwise("none")
    moved = maintenance.merge_actions(_moved(spark, sf_dir).withColumn("codec", codec), "zstd")
    copied = F.col("action") == "copy"
    return moved.groupBy("new_block_id").agg(F.count_if(copied).alias("copied"), F.count_if(~copied).alias("recompressed"), F.coalesce(F.sum(F.when(copied, F.col("new_size"))), F.lit(0)).alias("copied_bytes"))


@query(f"WITH {R.STORE} SELECT block_id, sealed OR ref_count = 0 AS sealed FROM blocks")
def sealed_if_dead(spark, sf_dir):
    """CHK-10: blocks after those that nothing refers to have been sealed."""
    return maintenance.sealed_if_dead(R.blocks(spark, sf_dir)).select("block_id", "sealed")


@query(f"""WITH {R.STORE}, u AS (SELECT block_id, hash, min(compressed_size) AS compressed_size FROM refs GROUP BY 1, 2)
  SELECT block_id, hash, CAST(72 + coalesce(sum(compressed_size) OVER (PARTITION BY block_id ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM u""")
def block_offsets(spark, sf_dir):
    """WIN-3, CHK-6: each chunk's place in its block."""
    unique = R.references(spark, sf_dir).groupBy("block_id", "hash").agg(F.min("compressed_size").alias("compressed_size"))
    placed = maintenance.laid_out(unique.withColumn("new_block_id", F.col("block_id")).withColumn("offset", F.col("hash")))
    return placed.select("block_id", "hash", F.col("new_offset").alias("offset"))


@query(f"""WITH {R.FILES}, {R.STORE}, {R.AUDIT}, gone AS (SELECT * FROM blocks WHERE ref_count = 0 AND block_id NOT IN (SELECT block_id FROM pinned)), old AS (SELECT * FROM files WHERE partition_id < 3)
  SELECT (SELECT count(*) FROM gone) AS blocks, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM gone) AS bytes, (SELECT count(DISTINCT partition_id) FROM old) AS partitions, (SELECT count(*) FROM old) AS files, (SELECT count(*) FROM audit WHERE ts < 1704844800) AS audit_rows""")
def gc_counters(spark, sf_dir):
    """AGG-8, AGG-11: all that one collection pass removes."""
    return maintenance.pass_counters(R.blocks(spark, sf_dir), R.pinned(spark, sf_dir), R.files(spark, sf_dir), R.audit(spark, sf_dir), 3, 1704844800)


@query(f"""WITH {R.STORE} SELECT block_id, CASE WHEN utilisation IS NULL THEN 'none' WHEN utilisation < 0.5 THEN 'low' WHEN utilisation < 0.8 THEN 'fair' ELSE 'good' END AS level,
  CASE WHEN create_time IN (0, 5000) THEN 'never' WHEN 9000 - create_time < 60 THEN 'just now' WHEN 9000 - create_time < 3600 THEN (9000 - create_time) // 60 || ' minutes ago' ELSE (9000 - create_time) // 3600 || ' hours ago' END AS age FROM used""")
def block_labels(spark, sf_dir):
    """FN-19: levels of use, and how long ago a block was made."""
    made = F.when(F.col("create_time") != 5000, F.col("create_time"))
    return _used(spark, sf_dir).select("block_id", names.use_level(F.col("utilisation")).alias("level"), names.time_ago(made, F.lit(9000)).alias("age"))


# keys and users


@query(f"""WITH {R.PEOPLE}, asked AS (SELECT c_name AS key FROM customer UNION ALL SELECT s_name FROM supplier), o AS (SELECT key, sha256(key) AS key_hash, substr(key, 1, 10) || '...' AS prefix FROM asked)
  SELECT o.key, o.prefix, a.key_id, a.parent_user FROM o LEFT JOIN accounts a USING (key_hash)""")
def key_lookup(spark, sf_dir):
    """JOIN-9, FN-13: keys as presented, by their hash, to their accounts; unknown ones too."""
    asked = R.table(spark, sf_dir, "customer").select(F.col("c_name").alias("key")).unionByName(R.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("key")))
    asked = asked.withColumn("key_hash", access.key_hash(F.col("key")))
    found = users.key_owner(asked.select("key_hash"), R.accounts(spark, sf_dir)).distinct()
    return asked.join(found, "key_hash", "left").select("key", access.key_prefix(F.col("key")).alias("prefix"), "key_id", "parent_user")


@query("""SELECT c_custkey AS key_id, CASE WHEN c_mktsegment = 'BUILDING' THEN sha256(c_name || '2') ELSE sha256(c_name) END AS key_hash, greatest(100, coalesce(u.at, 100)) AS last_used
  FROM customer LEFT JOIN (SELECT user_id, CAST(max(value) AS BIGINT) AS at FROM (SELECT user_id, floor(value) AS value FROM events) GROUP BY 1) u ON u.user_id = c_custkey WHERE c_mktsegment <> 'FURNITURE'""")
def key_changes(spark, sf_dir):
    """API-6: keys after rotation (BUILDING), use (events) and deletion (FURNITURE)."""
    c = R.table(spark, sf_dir, "customer")
    segment = lambda name: c.where(F.col("c_mktsegment") == name)
    keys = R.accounts(spark, sf_dir).select("key_id", "key_hash", F.lit(100).cast("long").alias("last_used"))
    keys = users.rotate(keys, segment("BUILDING").select(F.col("c_custkey").alias("key_id"), access.key_hash(F.concat("c_name", F.lit("2"))).alias("new_hash")))
    keys = users.touch(keys, R.table(spark, sf_dir, "events").select(F.col("user_id").alias("key_id"), F.floor("value").cast("long").alias("at")))
    return catalog.delete(keys, segment("FURNITURE").select(F.col("c_custkey").alias("key_id")), "key_id").select("key_id", "key_hash", "last_used")


@query(f"""WITH {R.PEOPLE} SELECT username, CASE WHEN username = 'u0' OR (enabled AND username NOT IN ('u1', 'u2')) THEN TRUE ELSE FALSE END AS enabled, is_root
  FROM users UNION ALL SELECT 'new', TRUE, FALSE""")
def user_updates(spark, sf_dir):
    """API-7: users created and updated; the root user cannot be disabled."""
    known = R.users(spark, sf_dir).select("username", "enabled", "is_root")
    rows = spark.createDataFrame([("u0", False, False), ("u1", False, False), ("u2", False, False), ("new", True, False)], "username string, enabled boolean, is_root boolean")
    return users.save_users(known, rows)


@query(f"""WITH {R.PEOPLE} SELECT parent_user, count(*) AS accounts, count(*) FILTER (len(scopes) > 0 AND list_has_all(['admin', 'read', 'write', 'operator', 'viewer'], scopes)) AS valid
  FROM accounts WHERE parent_user = 'u3' GROUP BY 1""")
def accounts_of_user(spark, sf_dir):
    """API-7, FN-14: a user's accounts, and whether their scopes are known ones."""
    a = users.accounts_of(R.accounts(spark, sf_dir), "u3")
    return a.groupBy("parent_user").agg(F.count(F.lit(1)).alias("accounts"), F.count_if(access.scopes_valid(F.col("scopes"))).alias("valid"))


# functions and counters


@query("""SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN md5(text) END AS digest, CASE WHEN doc_id % 4 < 2 THEN 16 END AS bytes FROM documents""")
def hex_guards(spark, sf_dir):
    """FN-4: hex digits to bytes and back; null for an odd count of digits and for other characters."""
    digest = F.md5("text")
    k = F.col("doc_id") % 4
    digits = F.when(k == 0, digest).when(k == 1, F.upper(digest)).when(k == 2, F.substring(digest, 1, 31)).otherwise(F.concat(F.lit("zz"), digest))
    raw = content.from_hex(digits)
    return R.table(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(raw)).alias("digest"), F.octet_length(raw).alias("bytes"))


@query("""SELECT p_partkey, 'attachment; filename="' || n || '"; filename*=UTF-8''''' || replace(replace(n, ' ', '%20'), '/', '%2F') AS header
  FROM (SELECT p_partkey, p_name || '/' || p_partkey || '.txt' AS n FROM part)""")
def download_headers(spark, sf_dir):
    """FN-10; tests hold names beyond ASCII to explicit cases."""
    return R.table(spark, sf_dir, "part").select("p_partkey", names.download_header(F.concat("p_name", F.lit("/"), F.col("p_partkey"), F.lit(".txt"))).alias("header"))


@query("""SELECT event_id, kind, kind IN ('Io', 'Timeout', 'ConcurrentModification') AS again, CASE WHEN kind IN ('Io', 'Timeout', 'ConcurrentModification') THEN least(100.0 * pow(2.0, user_id % 6), 2000.0) END AS delay
  FROM (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'Io' WHEN 'view' THEN 'Timeout' WHEN 'error' THEN 'ConcurrentModification' ELSE 'NotFound' END AS kind FROM events)""")
def retry_plan(spark, sf_dir):
    """FN-18: which errors are worth another try, and after how long."""
    kind = F.when(F.col("event_type") == "click", "Io").when(F.col("event_type") == "view", "Timeout").when(F.col("event_type") == "error", "ConcurrentModification").otherwise("NotFound")
    e = R.table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), (F.col("user_id") % 6).cast("double").alias("attempt"))
    again = names.retryable(F.col("kind"))
    return e.select("event_id", "kind", again.alias("again"), F.when(again, names.backoff(F.col("attempt"), 100.0, 2.0, 2000.0)).alias("delay"))


@query(f"""WITH {R.OPERATIONS} SELECT 'operations' AS metric, op AS label, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS total
  FROM operations GROUP BY op
  UNION ALL SELECT 'statuses', CAST(status AS VARCHAR), count(*), CAST(sum(bytes) AS BIGINT) FROM operations GROUP BY status""")
def labelled_counters(spark, sf_dir):
    """AGG-18: counters by label, for each of two labels, in one pass."""
    return audit.counters(R.operations(spark, sf_dir), {"operations": F.col("op"), "statuses": F.col("status").cast("string")}, "bytes")


@query(f"""WITH {R.OPERATIONS} SELECT op, count(*) AS n, sum(CAST(elapsed AS DECIMAL(18, 4))) AS total, CAST(round(CAST(sum(CAST(elapsed AS DECIMAL(18, 4))) AS DOUBLE) / count(*), 6) AS DOUBLE) AS mean
  FROM operations GROUP BY op""")
def latency_means(spark, sf_dir):
    """AGG-15: count, sum and mean of each operation's time."""
    return audit.latency_means(R.operations(spark, sf_dir)).withColumn("mean", F.round("mean", 6))
