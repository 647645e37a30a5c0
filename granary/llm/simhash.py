"""Operator 2: near-duplicate documents by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits. Two fingerprints within three bits differ by one bit at most in one of their two halves,
so each half is a table: every fingerprint enumerates the 33 values within one bit of its own half, fetches the
fingerprints whose half has that value, and the complete distance decides. Only distinct fingerprints take part, and
the join emits none but links that hold, each once. Components of the links come from rounds of star contraction.

Null text counts as empty. A text without words has fingerprint zero and is linked like any other; fewer words than
a shingle has make one shingle. Repeated rows share a fingerprint. A row with a null key belongs to its
fingerprint's component and never names it. A very long text is read whole, in one row. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, written
from .components import components

BITS, SHINGLE, SEED = 64, 3, 42


def shingle_hashes(text: str | None, words: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The XXH64 of each run of so many words, repeats included; of the whole sequence if it has fewer; big-endian."""
    found = (text or "").encode().lower().split()  # on bytes: A-Z only, and white space of ASCII only
    joined = b" ".join(found)
    if len(found) <= words:
        parts = [joined] if found else []
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        parts = [joined[a:b] for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, parts, repeat(seed))), ">u8")


def majority(hashes: np.ndarray) -> bytes:
    """Eight bytes, the highest bit first: a bit is set if over half of the hashes have it."""
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes)).tobytes()


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = SEED) -> bytes:
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns to keep, and fp (the fingerprint as a signed long) of every row, in one pass."""
    names = [key, *keep]

    def of(parts):
        for part in parts:
            data = b"".join(fingerprint(x, words) for x in part.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(np.frombuffer(data, ">i8").astype(np.int64))], names=[*names, "fp"])

    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.select(*names, text).mapInArrow(of, f"{schema}, fp long")


def _segments(fp: F.Column, count: int) -> list[tuple[F.Column, int]]:
    width = BITS // count
    mask = (1 << width) - 1
    return [(F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit(mask)), width) for k in range(count)]


def links(distinct: DataFrame, most: int = 3, count: int = 2) -> DataFrame:
    """(a, b), a < b: every pair of distinct fingerprints (column fp) within most bits, once.

    With count segments, one of them differs by most // count bits at most; Hamming balls of that radius (0 or 1) are
    enumerated. A pair that several segments find is emitted by the first of them.
    """
    radius = most // count
    if radius > 1:
        raise ValueError("more segments are needed: a ball of radius 1 is the largest that is enumerated")
    segments = _segments(F.col("fp"), count)
    entry = F.explode(F.array(*(F.struct(F.lit(k).alias("segment"), s.alias("value")) for k, (s, _) in enumerate(segments))))
    near = [s.bitwiseXOR(F.lit(flip)).alias("value") for s, w in segments for flip in [0, *((1 << b for b in range(w)) if radius else ())]]
    which = [k for k, (_, w) in enumerate(segments) for _ in range(1 + w * radius)]
    ball = F.explode(F.array(*(F.struct(F.lit(k).alias("segment"), v) for k, v in zip(which, near, strict=True))))
    table = distinct.select(F.col("fp").alias("b"), entry.alias("e")).select("b", "e.segment", "e.value")
    probes = distinct.select(F.col("fp").alias("a"), ball.alias("e")).select("a", F.col("e.segment").alias("s"), F.col("e.value").alias("v"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    parts = [F.bit_count(s) for s, _ in _segments(differ, count)]
    first = F.lit(True)
    for k in range(1, count):
        earlier = [p <= radius for p in parts[:k]]
        seen = earlier[0]
        for e in earlier[1:]:
            seen = seen | e
        first = first & ((F.col("segment") != k) | ~seen)
    on = (F.col("s") == F.col("segment")) & (F.col("v") == F.col("value")) & (F.col("a") < F.col("b")) & (F.bit_count(differ) <= most) & first
    return probes.join(table, on).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE, most: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns to keep, fp, root (the fingerprint that stands for the component) and component (the smallest
    key reachable over links, the row's own included) of every row."""
    rows = written(fingerprints(docs, key, text, words, keep), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min(key).alias("least"))
    # dealt out before each fingerprint becomes many probes, to as many tasks as there are
    label = components(links(classes.select("fp").repartition(shuffle_width(docs.sparkSession), "fp"), most))
    # the fingerprint that stands for a component need not be that of its smallest key
    named = classes.join(label, classes.fp == label.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    of = named.join(least, "root").select("fp", "root", "component")
    return rows.join(of, "fp")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest key (nulls first; ties by a hash of the text)."""
    place = F.struct(F.coalesce(F.col(f"x.{key}").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.coalesce(F.col(f"x.{text}"), F.lit(""))).alias("t")).alias("place")
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("x")).select("x", place)
    found = near_duplicates(held.select("place", F.col("x")[key].alias("key"), F.col("x")[text].alias("text")), "key", "text", keep=("place",))
    first = found.groupBy("root").agg(F.min("place").alias("place")).select("place").distinct()
    return held.join(first, "place", "left_semi").dropDuplicates(["place"]).select("x.*")


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hexadecimal digits), component_id."""
    found = near_duplicates(docs, key, text)
    return found.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
