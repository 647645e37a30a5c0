"""Operator 1: token ids in files of independent zstandard frames with a trailing seek table.

File layout (the public zstandard seekable format, so that any zstandard reader reads the whole file):

* one frame for each document, holding its ids as little-endian unsigned 32-bit integers;
* a skippable frame with the directory: for each document its key (64-bit, with a null flag) and its first token's
  place in the file;
* a skippable frame with the seek table: for each frame its compressed size, its size and a 32-bit checksum of what
  it holds (the low half of XXH64), then the count of frames, the flag for checksums and the format's magic number.

A reader takes the two tables from the file's end and then only the frames of the documents asked for; a frame whose
checksum differs raises an error. Files are cut by ranges of the key, ordered inside, and named by range, so a task
that runs again writes the same file again (under a temporary name first).

Null or empty text: no ids but the end id. Keys are whole numbers; null keys come first. Rows that repeat a key are
kept, in the order of a hash of their frames, and a key that many rows have fills several files. A very long text is
one frame. An empty table gives no file. Only key and text are read, so extra columns do no harm.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pretokens
from .common import shuffle_width
from .ordering import range_bounds, range_of

#: Fixed values of the zstandard frame and seekable formats.
_SKIPPABLE_DIRECTORY, _SKIPPABLE_SEEK, _SEEKABLE, _HAS_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY, _FOOTER, _KEY = struct.Struct("<III"), struct.Struct("<IBI"), np.dtype([("key", "<i8"), ("null", "u1"), ("start", "<i8")])


def _checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def _skippable(magic: int, data: bytes) -> bytes:
    return struct.pack("<II", magic, len(data)) + data


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A store and the path in it, from a URI or a plain path, on the driver or in a task."""
    return pyarrow.fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes one file; what it holds in memory is the two tables only."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.hidden = f"{posixpath.dirname(self.path)}/.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.hidden, compression=None)
        self.entries, self.keys, self.tokens = bytearray(), [], 0

    def add(self, key: int | None, frame: bytes, n_tokens: int, checksum: int) -> None:
        self.out.write(frame)
        self.entries += _ENTRY.pack(len(frame), 4 * n_tokens, checksum)
        self.keys.append((key or 0, key is None, self.tokens))
        self.tokens += n_tokens

    def close(self) -> None:
        directory = zstandard.compress(np.array(self.keys, _KEY).tobytes())
        self.out.write(_skippable(_SKIPPABLE_DIRECTORY, directory))
        # the directory has an entry too, so that the sizes add up to the file
        table = bytes(self.entries) + _ENTRY.pack(len(directory) + 8, 0, _checksum(b""))
        self.out.write(_skippable(_SKIPPABLE_SEEK, table + _FOOTER.pack(len(self.keys) + 1, _HAS_CHECKSUMS, _SEEKABLE)))
        self.out.close()
        self.fs.move(self.hidden, self.path)


class FrameReader:
    """Reads the documents asked for from one file."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file, self.uri = fs.open_input_file(path), uri
        size = self.file.size()
        frames, flags, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != _SEEKABLE or not flags & _HAS_CHECKSUMS:
            raise ValueError(f"{uri} has no seek table with checksums")
        table = self._at(size - _FOOTER.size - frames * _ENTRY.size, frames * _ENTRY.size)
        self.table = np.frombuffer(table, "<u4").reshape(frames, 3).astype(np.int64)
        self.offsets = np.cumsum(np.r_[0, self.table[:, 0]])
        directory = self._at(int(self.offsets[-2]) + 8, int(self.table[-1, 0]) - 8)
        self.keys = np.frombuffer(zstandard.decompress(directory), _KEY)

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def __len__(self) -> int:
        return len(self.keys)

    def key(self, k: int) -> int | None:
        return None if self.keys["null"][k] else int(self.keys["key"][k])

    def start(self, k: int) -> int:
        return int(self.keys["start"][k])

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document: only its frame is read and decompressed."""
        return self._ids(k, self._at(int(self.offsets[k]), int(self.table[k, 0])))

    def _ids(self, k: int, frame: bytes) -> np.ndarray:
        size, checksum = map(int, self.table[k, 1:])
        data = zstandard.ZstdDecompressor().decompress(frame, max_output_size=size) if size else b""
        if len(data) != size or _checksum(data) != checksum:
            raise ValueError(f"frame {k} of {self.uri} is damaged")
        return np.frombuffer(data, "<u4")

    def runs(self, low: int, high: int, size: int = 8 << 20) -> Iterator[list[tuple[int, np.ndarray]]]:
        """(k, ids) of the documents from low to high, in runs of about size bytes that are each read at once."""
        while low < high:
            end = min(high, max(low + 1, int(np.searchsorted(self.offsets, self.offsets[low] + size, "right")) - 1))
            data = self._at(int(self.offsets[low]), int(self.offsets[end] - self.offsets[low]))
            yield [(k, self._ids(k, data[self.offsets[k] - self.offsets[low] : self.offsets[k + 1] - self.offsets[low]])) for k in range(low, end)]
            low = end

    def find(self, wanted: set[int | None]) -> Iterator[int]:
        return (k for k in range(len(self)) if self.key(k) in wanted)


def frames(docs: DataFrame, file: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, frame, checksum: each document encoded and compressed where it lies."""

    def pack(parts):
        packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
        end = np.array([end_id], "<u4").tobytes()
        for part in parts:
            data = [ids + end for ids in pretokens.encode(part.column(1).to_pylist(), file)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) // 4 for x in data], pa.int64()), pa.array([packer.compress(x) for x in data], pa.binary()), pa.array(map(_checksum, data), pa.int64())],
                names=["doc_id", "n_tokens", "frame", "checksum"],
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pack, "doc_id long, n_tokens long, frame binary, checksum long")


def write_token_files(docs: DataFrame, uri: str, file: str, end_id: int, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> dict:
    """Write all documents to files under uri and return the manifest, which also lies there as manifest.json.

    The manifest has a row for each file (at most ranges of them): its name, documents, tokens, and how many tokens
    lie before it. It is all that comes to the driver.
    """
    spark = docs.sparkSession
    ranges = ranges or shuffle_width(spark)
    bounds = range_bounds(docs, key, ranges)
    fs, at = filesystem(uri)
    fs.create_dir(at, recursive=True)

    def write(parts):
        writer, shard, rows = None, None, []
        for part in parts:
            for row in part.to_pylist():
                if row["shard"] != shard:
                    if writer:
                        writer.close()
                        rows.append((shard, len(writer.keys), writer.tokens))
                    shard = row["shard"]
                    writer = FrameWriter(f"{uri}/{shard:06d}.zst")
                writer.add(row["doc_id"], row["frame"], row["n_tokens"], row["checksum"])
        if writer:
            writer.close()
            rows.append((shard, len(writer.keys), writer.tokens))
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "documents", "tokens"), r, strict=True)) for r in rows], schema=pa.schema([("shard", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    dealt = frames(docs, file, end_id, key, text).withColumn("h", F.xxhash64("frame"))
    dealt = dealt.withColumn("shard", range_of(F.col("doc_id"), F.col("h"), bounds)).repartitionById(ranges, F.col("shard"))
    found = dealt.sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "h", "frame").drop("h").mapInArrow(write, "shard int, documents long, tokens long").collect()
    manifest, before = {"end_id": end_id, "files": []}, 0
    for r in sorted(found):
        manifest["files"].append({"name": f"{r.shard:06d}.zst", "documents": r.documents, "tokens": r.tokens, "start": before})
        before += r.tokens
    with fs.open_output_stream(f"{at}/manifest.json", compression=None) as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def _read(spark: SparkSession, uri: str, schema: str, to_batch, wanted: set | None) -> DataFrame:
    fs, at = filesystem(uri)
    with fs.open_input_stream(f"{at}/manifest.json", compression=None) as f:
        files = json.loads(f.read())["files"]
    if not files:
        return spark.createDataFrame([], schema)
    # a third of a file to each task, by the count of its documents
    work = [(f["name"], f["start"], k * f["documents"] // 3, (k + 1) * f["documents"] // 3) for f in files for k in range(3)]
    work = [w for w in work if w[2] < w[3]]

    def read(parts):
        for part in parts:
            for name, start, low, high in zip(*(c.to_pylist() for c in part.columns), strict=True):
                reader = FrameReader(f"{uri}/{name}")
                runs = reader.runs(low, high) if wanted is None else ([(k, reader.ids(k))] for k in reader.find(wanted) if low <= k < high)
                for run in runs:
                    yield to_batch([(reader.key(k), start + reader.start(k), ids) for k, ids in run])

    rows = spark.createDataFrame(work, "name string, start long, low long, high long")
    return rows.repartition(max(1, min(len(work), shuffle_width(spark) * 3))).mapInArrow(read, schema)


def read_token_files(spark: SparkSession, uri: str, wanted: set[int | None] | None = None) -> DataFrame:
    """doc_id, start (tokens of all documents before), ids; of all documents or of those wanted (a small set)."""

    def to_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].astype(np.int64) for r in rows], pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return _read(spark, uri, "doc_id long, start long, ids array<long>", to_batch, wanted)


def token_file_digests(spark: SparkSession, uri: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def to_batch(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([zlib.crc32(r[2].tobytes()) for r in rows], pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )

    return _read(spark, uri, "doc_id long, start long, n_tokens long, ids_crc32 long", to_batch, None)
