"""Operator 9: approximate nearest neighbours by largest inner product, with score-aware quantisation.

Vectors are cut into subspaces of two dimensions with 16 centres each, so a vector is a code of four bits for each.
Codebooks and codes minimise an anisotropic loss: the part of the residual along the vector counts more than the part
across it, as it is the former that changes large inner products. A scan adds up table entries by code (two codes to
a table of 256), in cells of a block of queries and a block of candidates; a cell sorts its best candidates again by a
byte for each component, and passes on a few more than are asked for. The best of all cells meet their vectors by a
join and are ranked by the exact inner product in double precision.

So a cell gets codes and bytes only, some 100 bytes a candidate where a vector of 64 doubles has 512; vectors move
once for each neighbour that is reranked, whatever the count of blocks. Queries meet all candidates: a coarse
partition was measured and left out, as it would have to be searched by half for nine tenths of the neighbours (see
the README).

The codebooks are fitted on at most SAMPLE vectors (those of the smallest hash), which come to the driver; every
vector is encoded. Null vectors, zero vectors and vectors with null or non-finite components take no part, nor do rows
without a key, nor vectors whose length is not the sample's commonest (an inner product needs equal lengths). A query
is no candidate of its own. Ties go to the smaller key. Of exactly equal vectors the k + 1 smallest keys can be in a
result at most, so only those are candidates; that loses nothing and keeps large groups of copies out of the cells.
Rows that repeat a key count once. Keys are whole numbers. Blocks are dealt by a hash of the key and bounded in size,
whatever the table's. An empty table gives no rows, and so does one without a vector that takes part. Only key and
vector are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, written

SAMPLE, CENTRES, WIDTH = 20_000, 16, 2
#: Rows of a block: of queries at most, of candidates at most, and of candidates at least where more blocks would only give more tasks.
QUERY_BLOCK, CANDIDATE_BLOCK, LEAST_BLOCK = 4096, 32_768, 4096
#: Neighbours beyond those asked for that are passed on to the exact reranking.
MARGIN = 12


@dataclass
class Codebook:
    centres: np.ndarray  # subspaces x 16 x 2
    dims: int
    extra: float  # what the parallel part of a residual counts beyond the rest

    def split(self, x: np.ndarray) -> np.ndarray:
        """Vectors as (rows, subspaces, 2), padded with zeros."""
        out = np.zeros((len(x), len(self.centres) * WIDTH))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), -1, WIDTH)

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, subspaces) by coordinate descent on the anisotropic loss."""
        parts = self.split(x)
        unit = parts / np.maximum(np.linalg.norm(parts, axis=(1, 2), keepdims=True), 1e-300)
        gaps = ((parts[:, :, None] - self.centres) ** 2).sum(-1)
        code = gaps.argmin(-1)
        subspaces = np.arange(len(self.centres))
        along = ((parts - self.centres[subspaces, code]) * unit).sum(-1)  # parallel residual of each subspace
        total = along.sum(1)
        for _ in range(sweeps):
            for m in subspaces:
                rest = total - along[:, m]
                each = ((parts[:, m, None] - self.centres[m]) * unit[:, m, None]).sum(-1)
                code[:, m] = (gaps[:, m] + self.extra * (rest[:, None] + each) ** 2).argmin(1)
                along[:, m] = each[np.arange(len(x)), code[:, m]]
                total = rest + along[:, m]
        return code.astype(np.uint8)

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Codes of two subspaces to a byte."""
        code = self.codes(x)
        return code[:, ::2] | code[:, 1::2] << 4

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and byte of a code, the inner product with what the byte stands for."""
        single = np.einsum("qmd,mcd->qmc", self.split(queries), self.centres)
        low, high = single[:, ::2], single[:, 1::2]
        return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(queries), low.shape[1], 256).astype(np.float32)


def fit_codebook(sample: np.ndarray, threshold: float = 0.2, rounds: int = 8, seed: int = 7) -> Codebook:
    """Codebooks by alternating codes and centres. threshold: the cosine from which inner products matter."""
    n, dims = sample.shape
    subspaces = -(-dims // (2 * WIDTH)) * 2
    extra = max((dims - 1) * threshold**2 / (1 - threshold**2) - 1, 0.0)
    book = Codebook(np.zeros((subspaces, CENTRES, WIDTH)), dims, extra)
    parts = book.split(sample)
    start = np.random.default_rng(seed).choice(n, CENTRES, replace=n < CENTRES)
    book.centres = parts[start].transpose(1, 0, 2).copy()
    unit = parts / np.linalg.norm(parts, axis=(1, 2), keepdims=True)
    for _ in range(rounds):
        code = book.codes(sample, sweeps=1)
        along = ((parts - book.centres[np.arange(subspaces), code]) * unit).sum(-1)
        for m in range(subspaces):
            u, x, rest = unit[:, m], parts[:, m], along.sum(1) - along[:, m]
            weight = np.eye(WIDTH) + extra * u[:, :, None] * u[:, None, :]
            right = (weight @ x[:, :, None])[:, :, 0] + extra * rest[:, None] * u
            sums, rights = np.zeros((CENTRES, WIDTH, WIDTH)), np.zeros((CENTRES, WIDTH))
            np.add.at(sums, code[:, m], weight)
            np.add.at(rights, code[:, m], right)
            held = np.bincount(code[:, m], minlength=CENTRES) > 0
            book.centres[m, held] = np.linalg.solve(sums[held], rights[held][:, :, None])[:, :, 0]
            along[:, m] = ((x - book.centres[m, code[:, m]]) * u).sum(-1)
    return book


def byte_form(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as a whole number of one byte for each component, and what one unit is worth."""
    unit = np.abs(x).max(1) / 127
    return np.rint(x / unit[:, None]).astype(np.int8), unit


def scan(book: Codebook, queries: np.ndarray, query_ids: np.ndarray, codes: np.ndarray, small: np.ndarray, unit: np.ndarray, ids: np.ndarray, keep: int, depth: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, candidates' ids, scores by their bytes), best first, for a block of queries and one of candidates.

    depth: how many a query's scan of the codes leaves; keep: how many of those it returns.
    """
    order = np.argsort(ids, kind="stable")
    codes, small, unit, ids = codes[order], small[order], unit[order], ids[order]
    columns = np.ascontiguousarray(codes.T)
    out = []
    for at in range(0, len(queries), 64):
        own = queries[at : at + 64]
        tables = book.tables(own)
        rough = np.zeros((len(own), len(ids)), np.float32)
        for b, column in enumerate(columns):
            rough += tables[:, b].take(column, axis=1)
        for q, row, query_id in zip(own, rough, query_ids[at : at + 64].tolist(), strict=True):
            if len(ids) > depth:
                least = np.partition(row, len(row) - depth)[len(row) - depth]
                above = np.flatnonzero(row > least)
                found = np.r_[above, np.flatnonzero(row == least)[: depth - len(above)]]  # ties: smaller ids
            else:
                found = np.arange(len(ids))
            found = found[ids[found] != query_id]
            score = (small[found] @ q) * unit[found]
            best = np.lexsort((ids[found], -score))[:keep]
            out.append((query_id, ids[found][best], score[best]))
    return out


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector)
    good = F.col(key).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(good).select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def nearest(rows: DataFrame, is_query: F.Column, k: int = 20, depth: int = 400, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which is_query (over the column id) holds.

    depth: how many candidates the scan leaves for each query, over all cells; each cell takes its even share and four
    standard deviations more. k + MARGIN of them are reranked exactly.
    """
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    kept = usable(rows, key, vector)
    taken = [(r.id, r.v) for r in kept.orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    if not taken:
        return spark.createDataFrame([], schema)
    lengths, n = np.unique([len(v) for _, v in taken], return_counts=True)
    dims = int(lengths[n.argmax()])
    kept = kept.where(F.size("v") == dims).groupBy("id").agg(F.min("v").alias("v"))
    book = spark.sparkContext.broadcast(fit_codebook(np.array([v for _, v in taken if len(v) == dims])))

    def encode(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, dims) + 0.0  # no negative zeros, so equal vectors have equal bytes
            small, unit = byte_form(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([v.tobytes() for v in m], pa.binary()) for m in (book.value.packed(x), small)), pa.array(unit), pa.array([xxhash.xxh3_128_digest(v.tobytes()) for v in x], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())],
                names=["id", "code", "small", "unit", "same", "v"],
            )

    index = written(kept.mapInArrow(encode, "id long, code binary, small binary, unit double, same binary, v binary"), "vectors")
    sizes = index.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    query_blocks = max(1, -(-sizes[1] // QUERY_BLOCK))
    blocks = max(1, -(-sizes[0] // CANDIDATE_BLOCK), min(-(-shuffle_width(spark) // query_blocks), -(-sizes[0] // LEAST_BLOCK)))
    share, keep = depth / blocks, k + MARGIN
    cell_depth = int(share + 4 * share**0.5) + keep

    copies = Window.partitionBy("same").orderBy("id")
    candidates = index.select("id", "code", "small", "unit", F.row_number().over(copies).alias("n")).where(F.col("n") <= k + 1)
    candidates = candidates.select("id", "code", "small", "unit", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"))
    queries = index.where(is_query).select("id", "v")
    asked = queries.select("id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c"))
    cell = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("rough", pa.float64())])

    def matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return cell.empty_table()
        found = scan(book.value, matrix(right["v"], "<f8"), right["id"].to_numpy(), matrix(left["code"], np.uint8), matrix(left["small"], np.int8), left["unit"].to_numpy(), left["id"].to_numpy(), keep, cell_depth)
        return pa.table([np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]), np.concatenate([i for _, i, _ in found]), np.concatenate([x for _, _, x in found])], schema=cell)

    def exact(batches):
        for batch in batches:
            score = (matrix(batch.column(2), "<f8") * matrix(batch.column(3), "<f8")).sum(1) if len(batch) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    hits = candidates.groupBy("q", "c").cogroup(asked.groupBy("q", "c")).applyInArrow(work, "query_id long, vec_id long, rough double")
    first = Window.partitionBy("query_id").orderBy(F.desc("rough"), "vec_id")
    hits = hits.withColumn("place", F.row_number().over(first)).where(F.col("place") <= keep).select("query_id", "vec_id")
    hits = hits.join(index.select(F.col("id").alias("vec_id"), F.col("v").alias("x")), "vec_id").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("y")), "query_id")
    scored = hits.select("query_id", "vec_id", "x", "y").mapInArrow(exact, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
