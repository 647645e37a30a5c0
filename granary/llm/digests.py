"""Operator 10: document fingerprints from improbable features.

A window of 16 bytes begins at every byte of a text (zero bytes stand behind its end) and has an entropy. How often
each level of entropy occurs is counted over all documents, and a window is the better a feature the rarer its level.
In every neighbourhood of windows the rarest one (the leftmost of equals) gets a point, and the windows with enough
points are chosen. They are chosen twice, by one rule for texts of every length: neighbourhoods of 32 windows choose
features of 16 bytes, and neighbourhoods that grow with the text, so that it has some 30 to 60 of them, choose features
of 5 bytes. In a text of a few words the latter are all its runs of 5 bytes, in a long one they are few beside the
others. Features go into a chain of Bloom filters of 2048 bits, at most 160 to each, in the order of the text. Two
chains are alike as far as their filters' common bits go beyond chance: each filter of the shorter chain takes its
best partner, and the mean, by the filters' set bits, is the likeness.

Entropies are sums of integers, so a window's level does not depend on the text around it or on the machine. Null
text counts as empty; an empty text has the empty fingerprint, which is like another empty one (1) and unlike any
other (0). Equal texts have equal fingerprints, and equal fingerprints have likeness 1. Null keys come first, and rows
of one key by a hash of their texts, so very many of them lie in several tasks. Keys are whole numbers. A very long
text is read whole, in one row; an empty table gives no rows. Only key and text are read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import with_next

#: Bytes of a window, windows of a neighbourhood, and the share of a neighbourhood's size that is enough points.
WINDOW, NEIGHBOURS, ENOUGH = 16, 32, 4
#: Bytes of a small feature, and the neighbourhoods that a text has for them at least.
SMALL, SMALL_COUNT = 5, 16
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
LEVELS = 1000
_SCALE = 1 << 16
#: c log2 c for the count c of a byte in a window, in units of 2^-16; and what one more of that byte adds.
_TERM = np.array([0, *(round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 1))], np.int64)
_ADDS = np.diff(_TERM)


def levels(data: np.ndarray) -> np.ndarray:
    """The level (0: all bytes differ, LEVELS: all equal) of the window that starts at each place of the bytes.

    How often a byte occurs in the places around it follows from comparing the text with itself, shifted
    by each distance; the sum of a window follows from its neighbour's by the byte that leaves and the one that comes.
    """
    n = len(data)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    first = int(_TERM[np.bincount(data[:WINDOW], minlength=256)].sum())
    change = _ADDS[before[WINDOW:]] - _ADDS[after[: n - WINDOW]]
    return np.cumsum(np.r_[first, change]) * LEVELS // int(_TERM[WINDOW])


def _joined(texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """The texts one after another with zero bytes behind each, and where each begins."""
    data = np.frombuffer(b"".join(x for t in texts for x in (t, bytes(WINDOW - 1))), np.uint8)
    return data, np.cumsum([0, *(len(t) + WINDOW - 1 for t in texts)]).tolist()


def histogram(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each level."""
    out = np.zeros(LEVELS + 1, np.int64)
    data, at = _joined(texts)
    if any(texts):
        found = levels(data)
        for t, a in zip(texts, at, strict=False):
            if t:
                out += np.bincount(found[a : a + len(t)], minlength=LEVELS + 1)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Level to rank: the rarest level first, lower levels first among equals. Windows of one byte come last."""
    order = np.argsort(counts[:LEVELS], kind="stable")
    out = np.full(LEVELS + 1, LEVELS, np.int64)
    out[order] = np.arange(LEVELS)
    return out


def _chosen(rank: np.ndarray, width: int) -> np.ndarray:
    """Places of the windows that are the rarest of enough neighbourhoods of so many windows."""
    n, width = len(rank), min(width, len(rank))
    low = rank << 32 | np.arange(n)
    reach = 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if rest := width - reach:
        low = np.minimum(low[:-rest], low[rest:])
    points = np.bincount(low & 0xFFFFFFFF, minlength=n)
    # a text has n - width + 1 neighbourhoods; no window can have more points than there are
    found = np.flatnonzero(points >= max(1, min(width // ENOUGH, n - width + 1)))
    return found if len(found) else np.array([int(points.argmax())])


def features(text: bytes, rank: np.ndarray) -> list[bytes]:
    """The features of a text that is not empty, each once, in its order; rank: of the windows at its bytes."""
    padded = text + bytes(WINDOW - 1)
    small = max(1, len(text) - SMALL + 1)
    places = [(k, WINDOW) for k in _chosen(rank, NEIGHBOURS).tolist()] + [(k, SMALL) for k in _chosen(rank[:small], max(1, small // SMALL_COUNT)).tolist()]
    return list(dict.fromkeys(padded[k : k + size] for k, size in sorted(places)))


def chain(text: bytes, rank: np.ndarray) -> list[bytes]:
    """The text's Bloom filters; rank: of the windows at its bytes."""
    if not text:
        return []
    found = features(text, rank)
    # five places of eleven bits each from a feature's hash
    hashes = np.array([xxhash.xxh3_64_intdigest(f) for f in found], np.uint64)
    places = (hashes[:, None] >> (11 * np.arange(HASHES, dtype=np.uint64))) & np.uint64(FILTER_BITS - 1)
    out = []
    for k in range(0, len(found), FILTER_FEATURES):
        bits = np.zeros(FILTER_BITS, np.uint8)
        bits[places[k : k + FILTER_FEATURES].ravel().astype(np.int64)] = 1
        out.append(np.packbits(bits).tobytes())
    return out


def chains(texts: list[bytes], table: np.ndarray) -> list[list[bytes]]:
    data, at = _joined(texts)
    rank = table[levels(data)] if any(texts) else data
    return [chain(t, rank[a : a + len(t)]) for t, a in zip(texts, at, strict=False)]


def likeness(a: list[bytes], b: list[bytes]) -> float:
    """0 to 1: the mean, by set bits, over the shorter chain's filters, of the best normalised overlap with one of the other's."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    x, y = (np.frombuffer(b"".join(c), np.uint64).reshape(len(c), -1) for c in (a, b))
    nx, ny = (np.bitwise_count(v).sum(1, dtype=np.int64) for v in (x, y))
    total = 0.0
    for own, n in zip(x, nx.tolist(), strict=True):
        common = np.bitwise_count(own & y).sum(1, dtype=np.int64)
        chance, most = n * ny / FILTER_BITS, np.minimum(n, ny)
        total += n * float(np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return total / int(nx.sum())


def written_as(filters: list[bytes]) -> str:
    return f"{len(filters)}:" + base64.b64encode(b"".join(filters)).decode()


def read_from(fingerprint: str) -> list[bytes]:
    data = base64.b64decode(fingerprint.partition(":")[2])
    return [data[k : k + FILTER_BITS // 8] for k in range(0, len(data), FILTER_BITS // 8)]


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Level to rank, from the windows of all documents. Each task sends one row for each level that it has seen."""

    def count(batches):
        out = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            run, size = [], 0
            for t in batch.column(0).to_pylist():
                run.append((t or "").encode())
                size += len(run[-1])
                if size >= 300_000:
                    out += histogram(run)
                    run, size = [], 0
            out += histogram(run)
        seen = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(out[seen], pa.int64())], names=["level", "n"])

    counts = np.zeros(LEVELS + 1, np.int64)
    for r in docs.select(text).mapInArrow(count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[r.level] = r.n
    return ranks(counts)


def fingerprints(docs: DataFrame, table: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint of every row, in one pass."""

    def of(batches):
        for batch in batches:
            out = [written_as(c) for t in batch.column(1).to_pylist() for c in chains([(t or "").encode()], table)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "fingerprint"])

    return docs.select(key, text).mapInArrow(of, f"`{key}` {docs.schema[key].dataType.simpleString()}, fingerprint string")


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text (the last quarter of its code points replaced by the start
    of the next document), and how like it is to the edited text and to the next document."""
    table = rarity(docs, text)

    def work(rows: list[tuple], following: str) -> list[tuple]:
        texts = [t for _, t in rows] + [following]
        edited = [t[: len(t) - len(t) // 4] + texts[k + 1][: len(t) // 4] for k, (_, t) in enumerate(rows)]
        own, changed = chains([t.encode() for t in texts], table), chains([t.encode() for t in edited], table)
        return [
            (k, len(t), hashlib.sha256(e.encode()).hexdigest(), written_as(a), written_as(b), likeness(a, b), likeness(a, c))
            for (k, t), e, a, b, c in zip(rows, edited, own, changed, own[1:], strict=False)
        ]

    kinds = [("doc_id", "long"), ("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]
    arrow = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[k]) for n, k in kinds])
    return with_next(docs, key, text, work, ", ".join(f"{n} {k}" for n, k in kinds), arrow).withColumnRenamed("doc_id", key)
