"""Operator 6: line deduplication by a segment-partition edit join, in DataFrame functions only.

A line goes if an earlier line (by document key, then place) is equal to it or close to it: within one edit for every
EVERY characters of the shorter of the two, and THRESHOLD edits at most. Lines are compared without the white space of
ASCII around them (blanks, tabs, form feeds, carriage returns); lines of white space alone are always kept.

Exact copies are found by two 64-bit hashes; the first place of each class of equal lines stands for it. A line is cut
into threshold + 1 segments of nearly equal length. Lines within the threshold share a segment, so each line probes,
for every length that a partner may have, the substrings that can match that partner's segments (a few start places
each, as edits before and after a segment are bounded together). Probe and index meet on a hash of threshold, length,
segment number and substring; both are made where the documents lie, from hashes alone, so no text is moved for them.
For the few lines that meet another, the text is fetched. Letter counts come first: those of LETTERS modulo four stand
in one number as Gray codes, so an insertion or deletion changes one bit at most and a substitution two. What is left
is verified by a banded bit-parallel edit distance: a column of the band is two bit vectors, and each character of the
second line moves the band by one.

Pairs are bounded: a line's fate needs one earlier line that is close, not all of them. So a key of the index is
represented by (nearly) its earliest line, and each probe meets that one only; a group of m variants of one line gives
m pairs. Then those of a group that are not settled meet the group's other lines, where their letter counts allow it.
Both rounds together meet every pair of which the later line is not yet known to go. Texts are joined to pairs by
line, which Spark can split where a line has very many.

Every join is on a hash, a number or a document key and can be split where it is skewed; nothing is capped.

Null text counts as empty and comes back as the empty text. Keys are whole numbers; null keys come first in the order.
Rows that repeat key and text are one document and come back as often as they came; rows that repeat only the key are
ordered by a hash of their texts. An empty table gives no rows. Very long texts are one row each, split and joined
inside it. Other columns are kept as they are, whatever their names, but for those that the counts are asked to take.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

THRESHOLD, EVERY = 2, 12
#: The letters whose counts are compared before texts are; any choice gives the same result.
LETTERS = "enisrtaduolhcmg "
#: Documents that are sent to every task, as those to fetch lines from, at most; more are found by a shuffle.
SENT = 1_000_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def within(a: Column, b: Column, most: int) -> Column:
    """Whether two strings are within most edits, by a bit-parallel band of 2 * most + 1 diagonals.

    Bit t of column j stands for row j - most + t. The distance is followed along the band's lowest diagonal down to
    the last row, and then along that row.
    """
    width = 2 * most + 1
    every = F.lit((1 << width) - 1).cast("long")
    start = F.struct(F.lit(((1 << (most + 1)) - 1) << most).cast("long").alias("up"), F.lit(0).cast("long").alias("down"), F.lit(most).alias("edits"))

    def step(pair: Column, state: Column, j: Column) -> Column:
        rows, columns, m = pair["rows"], pair["columns"], pair["m"]
        up, down = state["up"], state["down"]
        c = F.get(columns, j - 1)
        match = F.lit(0).cast("long")
        for t in range(width):
            match = match + F.when(F.get(rows, j - most + t - 1) == c, F.lit(1 << t)).otherwise(0)

        def diagonal(x: Column) -> Column:
            return (((x.bitwiseAND(up) + up).bitwiseXOR(up)).bitwiseOR(x).bitwiseOR(down)).bitwiseAND(every)

        def finish(d: Column, h: Column) -> Column:
            more, less = h["more"], h["less"]
            # the bit of the last row, once the band has reached it
            at = F.pow(F.lit(2.0), (m - j + most).cast("double")).cast("long")
            last = F.when(j <= m - most, F.when(F.shiftright(d, width - 1) == 0, 1).otherwise(0)).otherwise(F.when(more.bitwiseAND(at) != 0, 1).when(less.bitwiseAND(at) != 0, -1).otherwise(0))
            half = F.shiftright(d, 1)
            return F.struct(less.bitwiseOR(F.bitwise_not(half.bitwiseOR(more)).bitwiseAND(every)).alias("up"), half.bitwiseAND(more).alias("down"), (state["edits"] + last).alias("edits"))

        def horizontal(d: Column) -> Column:
            return F.struct(down.bitwiseOR(F.bitwise_not(d.bitwiseOR(up)).bitwiseAND(every)).alias("more"), d.bitwiseAND(up).alias("less"))

        return _let(match, lambda x: _let(diagonal(x), lambda d: _let(horizontal(d), lambda h: finish(d, h))))

    def edits(pair: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), pair["n"]), start, lambda state, j: step(pair, state, j), lambda state: state["edits"])

    m, n = F.char_length(a), F.char_length(b)
    pair = F.struct(F.split(a, "").alias("rows"), F.split(b, "").alias("columns"), m.alias("m"), n.alias("n"))
    close = F.abs(m - n) <= most
    return F.when(close & (m >= most) & (n >= 1), _let(pair, edits) <= most).otherwise(close & (F.levenshtein(a, b) <= most))


def _specs(most: int) -> list[tuple[int, int, int, int]]:
    """(t, shorter, k, shift): for t allowed edits and a partner that is shorter by so many characters, how far the
    substrings of a line that can be the partner's k-th segment start from the segment's own place.

    Before the k-th segment there are at most k edits (an edit more, and an earlier segment is whole), behind it at
    most t - k; both bound how far the substring's start can be from the segment's.
    """
    cases = [(t, shorter, k) for t in range(1, most + 1) for shorter in range(t + 1) for k in range(t + 1)]
    return [(t, shorter, k, shift) for t, shorter, k in cases for shift in range(max(-k, shorter - (t - k)), min(k, shorter + (t - k)) + 1)]


def keyed(lines: DataFrame, most: int, every: int, own: bool = False) -> DataFrame:
    """lines (line, length, others) with key and own, a row for every substring that can be a segment of a partner that
    is shorter or of equal length; own: for the line's own segments only, which are what others look for.

    The partner's length says how many edits are allowed. Its t + 1 segments are of nearly equal size; the longer ones
    come last. Cases are rows and not columns, so that the code Spark makes for them stays small.
    """
    specs = [x for x in _specs(most) if not own or (x[1], x[3]) == (0, 0)]
    cases = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(("t", "shorter", "k", "shift"), x, strict=True))) for x in specs))
    names = [c for c in lines.columns if c != "length"]
    each = lines.select(*lines.columns, F.explode(cases).alias("_x")).withColumn("_n", F.col("length") - F.col("_x.shorter"))
    n, t, k = F.col("_n"), F.col("_x.t"), F.col("_x.k")
    each = each.where((n >= t * every) & ((t == most) | (n < (t + 1) * every)))
    size, longer = F.floor(n / (t + 1)).cast("int"), k - (t + 1) + n % (t + 1)
    start = 1 + size * k + F.greatest(longer, F.lit(0)) + F.col("_x.shift")
    key = F.xxhash64(n.cast("int"), t * 16 + k, F.substring("line", start, size + F.when(longer >= 0, 1).otherwise(0)))
    itself = (F.col("_x.shorter") == 0) & (F.col("_x.shift") == 0)
    return each.select(*names, key.alias("key"), itself.cast("long").alias("own"))


def sketch(line: Column) -> Column:
    """The counts of LETTERS modulo four, each as a Gray code of two bits."""
    bits = F.lit(0).cast("long")
    for k, c in enumerate(LETTERS):
        n = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(F.lit(3))
        bits = bits.bitwiseOR(F.shiftleft(n.bitwiseXOR(F.shiftright(n, 1)).cast("long"), 2 * k))
    return bits


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\v\f\r"))


def _id(h: Column) -> Column:
    """A line's number in probes and index: its hash, with the lowest bit free for a mark."""
    return h.bitwiseAND(F.lit(~1))


def _fetched(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """id, h, g, place, line and sketch of the first line of each class (h, g, first) whose id is among ids.

    What is asked of documents is counted first: it is sent to them if it is little, and else meets them in a shuffle.
    """
    wanted = classes.select("h", "g", "first", _id(F.col("h")).alias("id")).join(ids, "id", "left_semi").select("first.d", "first.t", F.struct("first.pos", "h", "g").alias("x"))
    asked = written(wanted.groupBy("d", "t").agg(F.collect_list("x").alias("asked")), "asked")
    if asked.count() <= SENT:
        asked = F.broadcast(asked)
    parted = docs.join(asked, ["d", "t"]).withColumn("lines", _lines(F.col("text")))
    found = parted.select("d", "t", F.inline(F.transform("asked", lambda x: F.struct(x["pos"].alias("pos"), x["h"].alias("h"), x["g"].alias("g"), _trimmed(F.get("lines", x["pos"])).alias("line")))))
    return found.select(_id(F.col("h")).alias("id"), "h", "g", F.struct("d", "t", "pos").alias("place"), "line", sketch(F.col("line")).alias("sketch"))


def _pairs(a: Column, b: Column, rows: DataFrame) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _fits(x: Column, y: Column, most: int) -> Column:
    """Whether two sketches can be those of lines within so many edits."""
    return F.bit_count(x.bitwiseXOR(y)) <= 2 * most


def _later(texts: DataFrame, pairs: DataFrame, most: int, every: int) -> DataFrame:
    """h, g of the lines that are close to an earlier line, of the pairs (a, b) of ids."""
    x, y = (texts.select(F.col("id").alias(c), F.struct("h", "g", "place", "line", "sketch").alias(f"of_{c}")) for c in "ab")
    x, y, both = F.col("of_a"), F.col("of_b"), pairs.join(x, "a").join(y, "b")
    both = both.where(_fits(x["sketch"], y["sketch"], most))
    shorter = F.least(F.char_length(x["line"]), F.char_length(y["line"]))
    close = F.lit(False)
    for t in range(1, most + 1):
        close = F.when(shorter >= t * every, within(x["line"], y["line"], t)).otherwise(close)
    later = F.when(x["place"] > y["place"], x).otherwise(y)
    return both.where(close).select(later["h"].alias("h"), later["g"].alias("g")).distinct()


def removals(docs: DataFrame, most: int = THRESHOLD, every: int = EVERY) -> DataFrame:
    """d, t, gone: for each document (by key and text hash) that loses lines, their places from 0.

    docs: d (key, never null), t (what tells rows of one key apart), text; no two rows with the same d and t.
    """
    places = docs.select("d", "t", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).withColumn("line", _trimmed(F.col("line"))).where("line != ''")
    occurrences = places.select("d", "t", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))
    classes = written(occurrences.groupBy("h", "g").agg(F.min(F.struct("d", "t", "pos")).alias("first"), F.count(F.lit(1)).alias("n")), "classes")

    near = places.select("d", "line", _id(F.xxhash64("line")).alias("id"), F.char_length("line").alias("length")).where(F.col("length") >= every)
    # each key's earliest line stands for the key's lines; copies are combined before they are shuffled
    index = keyed(near, most, every, own=True).select("d", "id", "key")
    heads = index.groupBy("key").agg(F.min_by("id", "d").alias("head"), F.min("id").alias("low"), F.max("id").alias("high"))
    heads = written(heads.select("key", "head", (F.col("low") != F.col("high")).alias("others")), "heads")
    probes = keyed(near, most, every).select("key", F.col("id").bitwiseOR(F.col("own")).alias("probe"))
    met = probes.join(heads, "key").where(_id(F.col("probe")) != F.col("head"))
    met = written(met.select("key", _id(F.col("probe")).alias("id"), (F.col("probe") != _id(F.col("probe"))).alias("own"), "head", "others").distinct(), "met")

    ids = met.select(F.explode(F.array("id", "head")).alias("id")).distinct()
    texts = written(_fetched(docs, classes, ids), "texts")
    settled = written(_later(texts, _pairs(F.col("id"), F.col("head"), met), most, every).withColumn("linked", F.lit(True)), "settled")

    # lines that are not settled meet the other lines of their keys
    open_ids = texts.join(settled, ["h", "g"], "left").select("id", "sketch", F.col("linked").isNull().alias("open"))
    crowd = written(met.where("others").join(open_ids, "id").select("key", "id", "own", "sketch", "open"), "crowd")
    a, b = crowd.alias("a"), crowd.where("own").alias("b")
    meets = (F.col("a.key") == F.col("b.key")) & (F.col("a.id") != F.col("b.id")) & (F.col("a.open") | F.col("b.open")) & _fits(F.col("a.sketch"), F.col("b.sketch"), most)
    more = written(_pairs(F.col("a.id"), F.col("b.id"), a.join(b, meets)), "pairs")
    last = _later(texts, more, most, every).withColumn("linked", F.lit(True))

    linked = settled.unionByName(last).distinct()
    # a table of its own, so that Spark can split the places of a line that very many documents have
    repeated = written(classes.join(linked, ["h", "g"], "left").where("n > 1 or linked").select("h", "g", "first", "linked"), "repeated")
    goes = F.coalesce("linked", F.lit(False)) | (F.struct("d", "t", "pos") != F.col("first"))
    return occurrences.join(repeated, ["h", "g"]).where(goes).groupBy("d", "t").agg(F.collect_set("pos").alias("gone"))


_NO_KEY = -(1 << 63)


def _repeats(rows: DataFrame, *keys: str) -> bool:
    return bool(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect())


def _left(text: Column, gone: Column) -> Column:
    """The text without the lines at those places."""
    lines = _lines(text)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.when(gone.isNull(), text).otherwise(_let(lines, lambda ls: F.array_join(F.transform(stay, lambda k: F.get(ls, k)), "\n")))


def _counts(text: Column, gone: Column) -> tuple[Column, Column]:
    return F.size(_lines(text)).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed")


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = THRESHOLD, every: int = EVERY, counts: tuple[str, str] | None = ("n_lines", "n_removed")) -> DataFrame:
    """docs with the remaining lines in the text column, and how many lines there were and how many went, in columns
    of these names (which replace columns of docs); counts None: docs' own columns only.

    The places that go grow with the documents, so they meet them in a shuffle.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    number = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_NO_KEY))
    once = docs.select(number.alias("d"), whole.alias("text"))
    # found from the keys alone: where they are unique, as usual, rows need no hash of their text beside them
    tied = _repeats(once, "d")
    tie = F.xxhash64(whole) if tied else F.lit(0).cast("long")
    once = docs.select(number.alias("d"), tie.alias("t"), whole.alias("text"))
    if tied and _repeats(once, "d", "t"):
        once = once.dropDuplicates(["d", "t"])
    gone = removals(once, most, every).hint("merge")
    held = docs.select(number.alias("d"), tie.alias("t"), whole.alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text), F.lit(0).alias("_")).alias("x"))
    found = held.join(gone, ["d", "t"], "left")
    taken = {c.lower() for c in counts or ()}
    columns = [_left(F.col("text"), F.col("gone")).alias(c) if c == text else F.col(f"x.`{c}`").alias(c) for c in docs.columns if c.lower() not in taken]
    return found.select(*columns, *(c.alias(n) for c, n in zip(_counts(F.col("text"), F.col("gone")), counts or (), strict=False)))


def line_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_lines, n_removed, n_chars and text_sha256 of what is left, for every document."""
    left = without_repeated_lines(docs.select(key, text), key, text)
    return left.select(key, "n_lines", "n_removed", F.char_length(text).cast("long").alias("n_chars"), F.sha2(F.col(text), 256).alias("text_sha256"))
