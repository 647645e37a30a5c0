"""Operator 4: packing by power-of-two decomposition.

A document's ids (with its end id) are cut into pieces whose lengths are powers of two: as many of the longest as
fit, then the binary digits of the rest, long ones first. Pieces of one length form a bucket, and each piece is a
sequence of its own, so no sequence crosses documents and none needs padding.

A sequence's number is made where the piece is cut, of its bucket, the task and its rank among the task's pieces of
that bucket, so packing is one pass without a shuffle, a window or a second read, and nothing is sent around. Numbers
are unique; they are dense within a task's bucket only. They hold 2^23 tasks of 2^36 pieces a bucket: 100 TB of text
are some 25 * 10^12 ids, so 10^11 pieces or so in 10^6 tasks of 128 MB, 10^5 pieces each.

Null or empty text: one piece that holds the end id. Null keys and repeated rows are packed like any other row.
Very long texts give many pieces. An empty table gives no rows. Only key and text are read, so extra columns of any
name do no harm.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.taskcontext import TaskContext

from . import pretokens

LONGEST = 2048
#: Pieces that a task holds before it passes them on.
ROWS = 4096


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two, at most longest each, that add up to n; the longest first."""
    return [longest] * (n // longest) + [1 << b for b in reversed(range(longest.bit_length() - 1)) if n % longest >> b & 1]


def sequence_number(bucket: int, task: int, rank: int) -> int:
    """One number for a bucket (under 16; the longest first), a task under 2^23 and a rank under 2^36."""
    if bucket >> 4 or task >> 23 or rank >> 36:
        raise OverflowError(f"bucket {bucket}, task {task} and rank {rank} do not fit in one number")
    return bucket << 59 | task << 36 | rank


def pack(docs: DataFrame, file: str, end_id: int, longest: int = LONGEST, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for) of every piece."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def batch(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 7
        arrays = [keys.take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:6]), pa.array(np.zeros(len(rows), np.int64))]
        if with_ids:
            arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[6]], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def cut(parts):
        task, ranks = TaskContext.get().partitionId(), {}
        end = np.array([end_id], "<u4").tobytes()
        for part in parts:
            keys, rows = part.column(0), []
            for k, ids in enumerate(pretokens.encode(part.column(1).to_pylist(), file)):
                ids += end
                n, start = len(ids) // 4, 0
                for length in piece_lengths(n, longest):
                    own = ids[4 * start : 4 * (start + length)]
                    rank = ranks[length] = ranks.get(length, -1) + 1
                    rows.append((k, start, length, zlib.crc32(own), n, sequence_number(16 - length.bit_length(), task, rank), own if with_ids else None))
                    start += length
                    if len(rows) >= ROWS:
                        yield batch(keys, rows)
                        rows = []
            yield batch(keys, rows)

    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(key, text).mapInArrow(cut, schema)


def write_buckets(docs: DataFrame, path: str, file: str, end_id: int, longest: int = LONGEST) -> None:
    """Training files: the sequences' ids, a folder for each length."""
    pack(docs, file, end_id, longest, with_ids=True).write.partitionBy("length").parquet(path)
