"""Hashes, codecs and sizes of binary content."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The digests that a chunk can be addressed by, and the width of the padded form in hex digits.
ALGORITHMS, PADDED = ("sha256", "sha1", "md5", "none"), 64


def content_hash(data: Column, algorithm: str = "sha256", padded: bool = False) -> Column:
    """Lower-case hex digest at its own length; the empty string for "none". padded: left aligned to 64 digits."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown hash algorithm {algorithm!r}; known: {', '.join(ALGORITHMS)}")
    digest = {"sha256": lambda: F.sha2(data, 256), "sha1": lambda: F.sha1(data), "md5": lambda: F.md5(data), "none": lambda: F.when(data.isNotNull(), F.lit(""))}[algorithm]()
    return F.rpad(digest, PADDED, "0") if padded else digest


def checksum_holds(data: Column, crc: Column) -> Column:
    return F.crc32(data) == crc


def from_hex(digits: Column) -> Column:
    """Bytes of a hex string of even length; null for anything else."""
    return F.when(digits.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(digits))


def chunk_count(size: Column, chunk_size: int) -> Column:
    """Chunks of an object: an empty one has a single empty chunk."""
    return F.greatest(F.ceil(size / F.lit(chunk_size)), F.lit(1)).cast("long")


def effective_size(original_size: Column, chunk_size: Column) -> Column:
    """A chunk's size where it is stored only if it differs from the file's chunk size."""
    return F.coalesce(original_size, chunk_size)


def stored_size(size: Column, chunk_size: Column) -> Column:
    return F.nullif(size, chunk_size)


#: Rows of an Arrow batch where whole texts meet Python, so that they do not add up in a worker; the session's setting.
BATCH = "512"
#: Units above bytes, each 1024 times the one before.
UNITS = ("KB", "MB", "GB", "TB")


def _two_decimals(v: Column) -> Column:
    """A double of 1 or more with two decimals. Its exact value is rounded, a tie to the even digit, as C does."""
    whole, one = F.floor(v), 1 << 52
    part = ((v - whole) * float(one)).cast("long") * 100
    hundredths, rest = F.shiftright(part, 52), part.bitwiseAND(F.lit(one - 1))
    up = (rest > one // 2) | ((rest == one // 2) & (hundredths % 2 == 1))
    hundredths = hundredths + up.cast("long")
    return F.format_string("%d.%02d", whole + F.when(hundredths == 100, 1).otherwise(0), hundredths % 100)


def format_bytes(n: Column, largest: str = "TB") -> Column:
    """1023 B, 1.00 KB, ... up to the largest unit, with two decimals above bytes; null for null."""
    out = F.when(n.isNotNull(), F.format_string("%d B", n.cast("long")))
    for power, unit in enumerate(UNITS[: UNITS.index(largest) + 1], 1):
        out = F.when(n >= 1 << 10 * power, F.concat(_two_decimals(n.cast("double") / float(1 << 10 * power)), F.lit(f" {unit}"))).otherwise(out)
    return out


def clamped(value: Column, low: Column | float, high: Column | float) -> Column:
    return F.least(F.greatest(value, low if isinstance(low, Column) else F.lit(low)), high if isinstance(high, Column) else F.lit(high))


def added_at_zero(value: Column, delta: Column) -> Column:
    """A count after a change; it never falls below zero."""
    return F.greatest(value + delta, F.lit(0).cast("long"))


def _codec(name: str, level: int) -> pa.Codec | None:
    if name == "none":
        return None
    return pa.Codec("lz4" if name == "lz4" else "zstd", None if name == "lz4" else level or 1)


def compress(data: Column, codec: str = "zstd", level: int = 1) -> Column:
    """none, lz4 or zstd (level 0 means 1). Spark has no built-in codec function, so this is a pandas UDF on Arrow."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        c = _codec(codec, level)
        return values.map(lambda v: v if v is None or c is None else c.compress(v, asbytes=True))

    return run(data)


def decompress(data: Column, size: Column, codec: str = "zstd") -> Column:
    @F.pandas_udf("binary")
    def run(values: pd.Series, sizes: pd.Series) -> pd.Series:
        c = _codec(codec, 1)
        return pd.Series([v if v is None or c is None else c.decompress(v, decompressed_size=int(n), asbytes=True) for v, n in zip(values, sizes, strict=True)], dtype=object)

    return run(data, size)


def ratio(original: Column, compressed: Column) -> Column:
    """Compressed over original size; 1 for an empty original."""
    return F.when(original == 0, F.lit(1.0)).otherwise(compressed / original)
