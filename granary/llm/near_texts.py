"""One document of each component of near duplicates: texts whose sets of five-word shingles have Jaccard 0.8 or more.

SimHash comes first (granary.llm.simhash, with five words): fingerprints within three bits are found by multi-index
hashing, and the texts of a pair are compared. That settles copies and texts that differ in a few places. It cannot
find all pairs, as texts of similarity 0.8 differ by some ten of 64 bits, and no table of 64 bits is selective at that
distance; an exact join of shingles finds the others.

No pair is lost: the shingles of all texts have one order, and two sets that are similar enough share one of their
first n - ceil(least * n) + 1 shingles. The order puts shingles that are common in a sample of texts last, so that
passages of many documents bring no pairs together; it decides the cost alone, and any sample gives the same result.
Every pair that meets is verified on its texts.

Only links that join components are needed. In a first round each text that shares shingles with others is compared
with one of them: of the texts that stand for its shingles, each the one that shares most with others, the one that
it shares most with. That settles groups of near copies in as many pairs as they have texts. In a second round texts
that still are in different components are compared, where they share enough of their first shingles: up to four, as
similar sets of many shingles must. Pairs of long texts that have one in common by chance grow with the square of the
table; few of them have more.

Words are cut and lowered as in granary.llm.simhash: null counts as empty, fewer words than a shingle has make one
shingle, and texts with the same set (the empty one too) are duplicates. Shingles and sets are told apart by 64-bit
hashes. Repeated rows are duplicates; keys are whole numbers, and a null key is the smallest. Very long texts are read
whole. An empty table gives no rows. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import cleared, fresh_path, shuffle_width, stored, written
from .components import components
from .simhash import SEED, shingle_hashes

WORDS, LEAST = 5, (4, 5)
#: The texts of the sample, the count that makes a shingle common there, and the ids that are sent to every task at most.
SAMPLE, COMMON, SENT = 20_000, 4, 1_000_000
#: So many shingles beyond the first are asked of a pair of the second round at most.
MORE = 3


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The XXH64 values of the text's shingles, ascending, each once."""
    return np.unique(shingle_hashes(text, words).astype(np.uint64))


def outline(found: np.ndarray) -> np.ndarray:
    """A bit for each class of hashes, by their lowest bits: whether a set has an odd number of shingles in it.

    Two sets differ in at least as many shingles as their outlines do in bits. There are 512 classes, or the power of
    two from the number of shingles on, as fewer would be filled evenly. The halves of an outline, one xor the other,
    are the outline of half as many classes.
    """
    classes = max(512, 1 << (len(found) - 1).bit_length())
    return np.packbits((np.bincount((found & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1).astype(np.uint8)).view(np.int64)


def _differ(a: Column, b: Column) -> Column:
    """The bits in which two outlines differ; 0 if they are of very different length."""
    k = F.least(F.size(a), F.size(b))
    a, b = (F.when(F.size(x) == 2 * k, F.zip_with(F.slice(x, 1, k), F.slice(x, k + 1, k), lambda v, w: v.bitwiseXOR(w))).otherwise(x) for x in (a, b))
    bits = F.aggregate(F.zip_with(a, b, lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda total, n: total + n)
    return F.when(F.size(a) == F.size(b), bits).otherwise(0)


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of the sample have, ascending, and how many have them."""
    share = max(1, -(-texts.count() // SAMPLE))
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).groupBy(F.xxhash64("text")).agg(F.min("text").alias("text")).select("text")

    def of(parts):
        for part in parts:
            for text in part.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, words).view(np.int64))], names=["key"])

    found = sample.mapInArrow(of, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).toArrow()
    keys, counts = found["key"].to_numpy().astype(np.int64).view(np.uint64), found["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def _prefixes(held: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """place, id (a hash of the set of shingles), n, prefix (the first of them in the order), fp and outline of every row."""
    keys, counts = _common(held.select("text"), words)
    up, down = least

    def ordered(found: np.ndarray) -> np.ndarray:
        if not len(keys) or not len(found):
            return found
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        return found[np.argsort(np.where(keys[at] == found, counts[at], 0), kind="stable")]

    def of(parts):
        for part in parts:
            hashes = [shingle_hashes(x, words) for x in part.column(1).to_pylist()]
            prints = np.frombuffer(b"".join(map(simhash.majority, hashes)), ">i8").astype(np.int64)
            sets = [np.unique(h.astype(np.uint64)) for h in hashes]
            ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            firsts = [ordered(s)[: len(s) + up * len(s) // -down + 1].view(np.int64) if len(s) else s.view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *firsts])))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids), pa.array([len(s) for s in sets], pa.int32()), prefix, pa.array(prints), pa.array([outline(s) for s in sets], pa.list_(pa.int64()))], names=["place", "id", "n", "prefix", "fp", "outline"])

    return held.select("place", "text").mapInArrow(of, f"place {held.schema['place'].dataType.simpleString()}, id long, n int, prefix array<long>, fp long, outline array<long>")


def _can(least: tuple[int, int], n: Column, pos: Column, m: Column, at: Column) -> Column:
    """Whether sets of n and m shingles can be similar enough if pos and at are the places of the first one they share."""
    up, down = least
    shared = F.least(n - pos, m - at).cast("long")
    return (up + down) * shared >= up * (n.cast("long") + m)


def _least_shared(least: tuple[int, int], n: Column, m: Column) -> tuple[Column, Column]:
    """k, and the place before which (counted from the end of either set) similar enough sets of n and m share k shingles.

    If they share need at least, need - k come after the k-th, in both. That it is so within both prefixes, and that it
    is not much farther than the first one can be, bounds k.
    """
    up, down = least
    need = F.ceil(up * (n.cast("long") + m) / (up + down))
    k = 1 + F.least(F.lit(MORE), F.floor((F.least(n, m) - need) / 8), need - F.ceil(up * F.greatest(n, m).cast("long") / down))
    return k, k - need


def _shared(docs: DataFrame, least: tuple[int, int]) -> DataFrame:
    """id, n, pos, key, held of each shingle of a prefix (docs: id, n, prefix) that a text of similar size has there too; held: the texts that have it."""
    up, down = least
    of_key = Window.partitionBy("key")
    near = of_key.orderBy("n")
    entries = docs.select("id", "n", F.posexplode("prefix").alias("pos", "key"))
    sized = entries.withColumns({"below": F.lag("n").over(near), "above": F.lead("n").over(near), "held": F.count(F.lit(1)).over(of_key)})
    similar = (down * F.col("below").cast("long") >= up * F.col("n").cast("long")) | (down * F.col("n").cast("long") >= up * F.col("above").cast("long"))
    return sized.where(similar).drop("below", "above")


def _verified(pairs: DataFrame, firsts: DataFrame, held: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough.

    Sets that are so similar differ in few shingles, so pairs whose outlines differ in more bits need no texts.
    """
    spark, (up, down) = held.sparkSession, least
    path = fresh_path(spark, "verified")

    def of(parts):
        for part in parts:
            keep = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                x, y = shingles(x, words), shingles(y, words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(down * both >= up * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with cleared(spark):  # pairs and texts are of no use once the links are written
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        x, y = (firsts.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("outline").alias(f"outline_{c}")) for c in "ab")
        differ = _differ(F.col("outline_a"), F.col("outline_b"))
        pairs = pairs.join(x, "a").join(y, "b").where((up + down) * differ <= (down - up) * (F.col("n_a").cast("long") + F.col("n_b")))
        pairs = written(pairs.select("a", "b"), "pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = written(firsts.join(ids, "id", "left_semi").select("place", "id"), "wanted")
        if wanted.count() <= SENT:
            wanted = F.broadcast(wanted)  # else the join is Spark's to choose, and texts are shuffled for it
        texts = written(held.join(wanted, "place").dropDuplicates(["id"]).select("id", "text"), "texts")
        x = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
        y = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
        pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(of, "a long, b long").write.parquet(path)
    return spark.read.schema("a long, b long").parquet(path)


def _by_fingerprint(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids whose fingerprints are equal or within three bits: one id stands for a fingerprint."""
    prints = written(rows.groupBy("fp").agg(F.min("id").alias("one")), "prints")
    near = simhash.links(prints.select("fp").repartition(shuffle_width(rows.sparkSession), "fp"))
    x, y = (prints.select(F.col("fp").alias(c), F.col("one").alias(f"one_{c}")) for c in "ab")
    apart = near.join(x, "a").join(y, "b").select(F.col("one_a").alias("a"), F.col("one_b").alias("b"))
    equal = rows.select("id", "fp").distinct().join(prints, "fp").select(F.col("id").alias("a"), F.col("one").alias("b"))
    return apart.unionByName(equal).where("a != b")


def _deal(held: DataFrame, words: int, least: tuple[int, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """place, id and fp of every row; place, n and outline of each id; the shingles that ids share."""
    spark = held.sparkSession
    paths = [fresh_path(spark, x) for x in ("rows", "sets", "entries")]
    with cleared(spark):  # prefixes are most of what this writes
        docs = fresh_path(spark, "docs")
        with cleared(spark):
            found = written(_prefixes(held, words, least), "prefixes")
            rows = stored(found.select("place", "id", "fp"), paths[0])
            firsts = stored(found.groupBy("id").agg(F.min("place").alias("place"), F.min("n").alias("n"), F.any_value("outline").alias("outline")), paths[1])
            # copies are reduced to one row, so each set deals out its prefix once
            docs = stored(found.select("id", "n", "prefix").dropDuplicates(["id"]), docs)
        return rows, firsts, stored(_shared(docs, least), paths[2])


def labels(held: DataFrame, words: int = WORDS, least: tuple[int, int] = LEAST) -> tuple[DataFrame, DataFrame]:
    """id and place of every row of held (place, text), and node and root of every id that has a link."""
    spark = held.sparkSession
    rows, firsts, entries = _deal(held, words, least)
    close = _verified(_by_fingerprint(rows), firsts, held, words, least)

    # the text whose shingles most others have stands for each of its shingles; each text meets one of those only
    degree = entries.groupBy("id").agg(F.sum("held").alias("degree"))
    ranked = entries.join(degree, "id")
    heads = ranked.groupBy("key").agg(F.max(F.struct("degree", "id", "n", "pos")).alias("one"))
    star = ranked.join(heads, "key").where((F.col("id") != F.col("one.id")) & _can(least, F.col("n"), F.col("pos"), F.col("one.n"), F.col("one.pos")))
    met = star.groupBy("id", F.col("one.id").alias("one")).agg(F.count(F.lit(1)).alias("times"), F.max("one.degree").alias("degree"))
    best = met.groupBy("id").agg(F.max(F.struct("times", "degree", "one"))["one"].alias("one"))
    best = best.select(F.least("id", "one").alias("a"), F.greatest("id", "one").alias("b")).join(close, ["a", "b"], "left_anti")
    links = close.unionByName(_verified(best, firsts, held, words, least))

    known = components(links).select(F.col("node").alias("id"), "root")
    path = fresh_path(spark, "met")
    with cleared(spark):
        placed = entries.drop("held").join(known, "id", "left").withColumn("root", F.coalesce("root", "id"))
        sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
        most = sizes.groupBy("key").agg(F.max(F.struct("size", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("key", F.col("most.root").alias("largest"))
        placed = written(placed.join(most, "key"), "placed")
        # each pair has an end outside the largest component of its shingle; members of that one never meet each other
        a, b = placed.where("root != largest").alias("a"), placed.alias("b")
        meets = (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & ((F.col("b.root") == F.col("b.largest")) | (F.col("a.id") < F.col("b.id")))
        meets = meets & (F.greatest(F.col("a.pos") - F.col("a.n"), F.col("b.pos") - F.col("b.n")) < _least_shared(least, F.col("a.n"), F.col("b.n"))[1])
        shares = a.join(b, meets).groupBy(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))
        shares = shares.agg(F.count(F.lit(1)).alias("both"), F.max(F.least("a.n", "b.n")).alias("n"), F.max(F.greatest("a.n", "b.n")).alias("m"))
        more = stored(shares.where(F.col("both") >= _least_shared(least, F.col("n"), F.col("m"))[0]).select("a", "b"), path)
    more = _verified(more, firsts, held, words, least)
    return rows.select("id", "place"), components(links.unionByName(more))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """docs with one row of each component: that of the smallest key (nulls first; ties by a hash of the text). least: a fraction."""
    place = F.struct(F.coalesce(F.col(f"x.{key}").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.coalesce(F.col(f"x.{text}"), F.lit(""))).alias("t")).alias("place")
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("x")).select("x", place)
    path = fresh_path(docs.sparkSession, "first")
    with cleared(docs.sparkSession):
        rows, label = labels(held.select("place", F.coalesce(F.col("x")[text], F.lit("")).alias("text")), words, least)
        named = rows.groupBy("id").agg(F.min("place").alias("place")).join(label, F.col("id") == F.col("node"), "left")
        first = stored(named.groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("place").alias("place")).select("place.*").distinct(), path)
    # texts are dealt out once: by plain columns, and not by left_semi, which would be moved to before there are any
    return held.select("x", "place.*").join(first, ["d", "t"]).dropDuplicates(["d", "t"]).select("x.*")
