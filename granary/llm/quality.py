"""Operator 7: a quality classifier that compresses with two dictionaries.

One zstandard dictionary is built from texts labelled good, one from texts labelled bad. A text is cut into pieces of
equal size (all of it, so that long texts are judged by all they hold), and each piece is compressed with either
dictionary. The normalised difference of the compressed sizes says which kind the text resembles; how far the text
shrinks at all, and its worst piece, stand beside it. A logistic calibration, fitted on labelled rows that built no
dictionary, turns these sizes into a probability of label 1.

Only the text is an input of a score. Labels are read for fitting alone, from rows whose crc32(key as text) mod 5 is
not 0: remainders 1 and 2 build the dictionaries, 3 and 4 calibrate.

The fit reads a bounded sample: of each class and part at most FIT_ROWS labelled keys, those of the smallest hash, and
of their texts, in that order, each that still fits in FIT_BYTES; one that does not fit is passed over, so a text of
more than FIT_BYTES never takes part in the fit. First the keys and the sizes of their texts come to the driver, then
the chosen texts: 4 * FIT_BYTES at most. Which rows are chosen does not depend on their order in the table: a key with
labels of both classes is not used, and of several texts of one key the shortest is (of equal lengths the first).

Scores cover all rows and whole texts; very long ones are compressed piece by piece. Null text counts as empty, and
the empty text has a score like any other. Equal texts get equal scores, and repeated rows are scored like any others.
Null labels are not used. Where a class has no labelled row, every score is the share of label 1 (0.5 without any
labels). An empty table gives no rows. Extra columns are not read, and score and predicted replace columns of those
names.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE, DICTIONARY, LEVEL = 2048, 32768, 3
#: The bounds of the sample that the fit reads: rows of each class and part, and bytes of each class and part.
FIT_ROWS, FIT_BYTES = 2000, 8_000_000


@dataclass
class Compressors:
    """The two dictionaries as bytes, and how their sizes become features."""

    good: bytes
    bad: bytes

    def __post_init__(self):
        self._pair = None

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "_pair": None}

    def features(self, text: str | None) -> list[float]:
        if self._pair is None:
            self._pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (self.good, self.bad)]
        data = (text or "").encode()
        parts = [data[k : k + PIECE] for k in range(0, len(data), PIECE)] or [b""]
        good, bad = ([len(c.compress(p)) for p in parts] for c in self._pair)
        g, b, n = sum(good), sum(bad), len(data)
        difference, shrunk, short = (b - g) / (b + g), np.log((b + g) / (2 * n + 16)), 1 / np.sqrt(n + 1)
        worst = min((y - x) / (x + y) for x, y in zip(good, bad, strict=True))
        return [1.0, difference, shrunk, difference * difference, shrunk * shrunk, difference * shrunk, short, difference * short, shrunk * short, worst]


def _dictionary(texts: list[str]) -> bytes:
    parts = [d[k : k + PIECE] for d in (t.encode() for t in texts) for k in range(0, len(d), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their plain content serves as the dictionary
        return b"".join(parts)[-DICTIONARY:] or b" " * 8


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, spreads and weights of a logistic regression with a small ridge, by Newton's steps that never climb."""
    mean, spread = x.mean(0), x.std(0)
    mean[0], spread[spread == 0] = 0, 1
    a, w = (x - mean) / spread, np.zeros(x.shape[1])
    ridge = np.full(len(w), 0.05)
    ridge[0] = 1e-6

    def loss(v: np.ndarray) -> float:
        z = a @ v
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(ridge * v * v))

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(ridge), a.T @ (y - p) - ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        if size <= 1e-6 or now - loss(w + size * step) < 1e-9:
            break
        w = w + size * step
        now = loss(w)
    return mean, spread, w


@dataclass
class QualityModel:
    compressors: Compressors | None
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.compressors is None or not texts:
            return np.full(len(texts), float(self.mean[0]))
        x = np.array([self.compressors.features(t) for t in texts])
        z = ((x - self.mean) / self.spread * self.weights).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def remainder(key: str) -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int, size: int) -> dict[tuple[int, int], list[str]]:
    """The texts of the fit by (class, part)."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z")
    known = known.select(key, F.col("y").cast("int").alias("y"), F.when(remainder(key) <= 2, 0).otherwise(1).alias("part"), F.xxhash64(key).alias("h")).where(remainder(key) != 0)
    tops = [known.where((F.col("y") == y) & (F.col("part") == part)).orderBy("h", key).limit(rows) for y in (0, 1) for part in (0, 1)]
    chosen = functools.reduce(DataFrame.unionByName, tops).collect()
    if not chosen:
        return {}

    def of(found: list) -> DataFrame:
        ids = spark.createDataFrame([(r[key],) for r in found], known.select(key).schema)
        return docs.select(key, F.col(text).alias("text")).join(F.broadcast(ids), key).where("text is not null").groupBy(key)

    sizes = {r[key]: r.n for r in of(chosen).agg(F.min(F.octet_length("text")).alias("n")).collect()}
    held, taken = {}, []
    for r in sorted(chosen, key=lambda r: (r.h, r[key])):
        k = r.y, r.part
        if r[key] in sizes and held.get(k, 0) + sizes[r[key]] <= size:
            held[k] = held.get(k, 0) + sizes[r[key]]
            taken.append(r)
    texts = {r[key]: r.text for r in of(taken).agg(F.min(F.struct(F.octet_length("text"), "text"))["text"].alias("text")).collect()} if taken else {}
    out: dict[tuple[int, int], list[str]] = {}
    for r in taken:
        out.setdefault((r.y, r.part), []).append(texts[r[key]])
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS, size: int = FIT_BYTES) -> QualityModel:
    """Fit on at most rows labelled keys of each class and part (those of the smallest hash), and size bytes of each."""
    texts = _sample(docs, labels, key, text, label, rows, size)
    if not texts:
        return QualityModel(None, np.array([0.5]), np.ones(1), np.ones(1))
    if not all(texts.get((y, part)) for y in (0, 1) for part in (0, 1)):
        n = [sum(len(texts.get((y, part), ())) for part in (0, 1)) for y in (0, 1)]
        return QualityModel(None, np.array([n[1] / sum(n)]), np.ones(1), np.ones(1))
    compressors = Compressors(*(_dictionary(texts[y, 0]) for y in (1, 0)))
    x = np.array([compressors.features(t) for y in (0, 1) for t in texts[y, 1]])
    return QualityModel(compressors, *_calibrated(x, np.repeat([0.0, 1.0], [len(texts[0, 1]), len(texts[1, 1])])))


def score(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score and predicted (or what names says), which replace columns of those names; one pass, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of 32 KB and ten numbers

    @F.pandas_udf("double")
    def of(texts):
        import pandas as pd

        return pd.Series(held.value.scores(texts.tolist()))

    return docs.withColumn(names[0], of(F.col(text))).withColumn(names[1], (F.col(names[0]) >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted of every row."""
    scored = score(docs.select(key, text), fit(docs, labels, key, text), text)
    return scored.select(key, F.coalesce(remainder(key) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
