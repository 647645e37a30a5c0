"""Operators 2 and 6 against brute force."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from granary.llm import line_dedup, simhash
from granary.llm.components import components


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, linked):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_simhash_queries_are_brute_force(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    base = [[r.choice(words) for _ in range(80)] for _ in range(12)]
    texts = [None, "", " \n", "One", "one", "two words", "Ünï x\xa0y Z"]
    for _ in range(120):
        w = list(r.choice(base))
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w) + r.choice(["", " ", "\n"]))
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, fp long")
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.simhash_components(docs).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [got[k][0] for k in range(len(texts))] == [format(f, "016x") for f in fps]
    linked = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = plain_components(range(len(fps)), linked)
    assert {k: v[1] for k, v in got.items()} == want
    assert simhash.one_of_each(docs).count() == len(set(want.values()))


def test_links_by_flipped_bits(spark):
    r = random.Random(9)
    fps = {r.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for n in (1, 2, 3, 4):
            fps.add(f ^ sum(1 << b for b in r.sample(range(64), n)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for count in (2, 4):
        got = [tuple(x) for x in simhash.links(df, 3, count).collect()]
        assert set(got) == want and len(got) == len(want)


def test_null_and_repeated_keys(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (5, "q w e r t y"), (None, "z")], "doc_id long, text string")
    got = sorted(((x.doc_id, x.component_id) for x in simhash.simhash_components(docs).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (5, 5), (None, None)], key=str)
    assert simhash.one_of_each(docs).count() == 3
    assert simhash.simhash_components(docs.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    pairs = [(k, k + 1) for k in range(60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)]
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    pairs = [p for p in pairs if p[0] != p[1]]
    assert got == plain_components({k for p in pairs for k in p}, pairs)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(r, text, most, alphabet="abcé?_"):
    out = list(text)
    for _ in range(r.randrange(most + 1)):
        at, kind = r.randrange(len(out) + 1), r.randrange(3)
        if kind == 0 or not out:
            out.insert(at, r.choice(alphabet))
        elif kind == 1:
            out.pop(min(at, len(out) - 1))
        else:
            out[min(at, len(out) - 1)] = r.choice(alphabet)
    return "".join(out)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_distance(spark, most):
    r = random.Random(most)
    pairs = [(t, changed(r, t, 4)) for t in ("".join(r.choice("abcé") for _ in range(r.randrange(40))) for _ in range(500))]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.within(F.col("a"), F.col("b"), most).alias("w")).collect()
    assert all(x.w == (edits(x.a, x.b) <= most) for x in got)


@pytest.mark.parametrize("most", [1, 2])
def test_line_dedup_is_brute_force(spark, most):
    r = random.Random(10 + most)
    words = "alpha beta gamma delta epsilon zeta".split()
    base = [" ".join(r.choice(words) for _ in range(r.randrange(1, 9))) for _ in range(30)]
    base += [" ".join(r.choice(words) for _ in range(9))[: r.randrange(10, 28)].strip() for _ in range(10)]  # about the lengths where another edit is allowed
    rows = [(k, "\n".join(r.choice([changed(r, r.choice(base), 3), r.choice(base), "", "  " + r.choice(base), "\t" + r.choice(base) + "\r"]) for _ in range(r.randrange(9))), "x", k) for k in range(60)]
    rows += [(200, None, "x", 1), (201, "", "x", 1), (None, base[0] + "\na line of its own that is long enough", "x", 1), (5, "same key", None, None), (9, "twice\ntwice", "y", 2), (9, "twice\ntwice", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d string, t long").withColumn("N_lines", F.lit("own"))
    got = line_dedup.without_repeated_lines(docs, most=most).collect()
    hashes = {(x.doc_id, x.text): x.h for x in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    seen, want, done = [], [], {}
    for key, text, *_ in sorted(rows, key=lambda x: (-1 if x[0] is None else x[0], hashes[x[0], x[1]])):
        if (key, text) not in done:
            kept = []
            for line in (text or "").split("\n"):
                own = line.strip(" \t\v\f\r")
                if own and any(own == s or edits(own, s) <= min(most, min(len(own), len(s)) // line_dedup.EVERY) for s in seen):
                    seen.append(own)
                    continue
                seen += [own] if own else []
                kept.append(line)
            done[key, text] = "\n".join(kept)
        want.append((key, done[key, text]))
    assert sorted(((x.doc_id, x.text) for x in got), key=str) == sorted(want, key=str)
    assert list(got[0].asDict()) == ["doc_id", "text", "d", "t", "n_lines", "n_removed"] and all(isinstance(x.n_lines, int) for x in got)
    none = line_dedup.without_repeated_lines(docs.where(F.lit(False)), counts=None)
    assert none.columns == docs.columns and none.count() == 0


@pytest.mark.parametrize("most", [1, 2, 3])
def test_probes_are_rows_of_a_plain_loop(spark, most):
    """Every substring that can be a partner's segment, in the places of a plain loop; the operator makes no arrays of keys."""
    every, r = 12, random.Random(most)
    lines = ["".join(r.choice("abcdé ") for _ in range(n)) for n in (*range(12, 60), 200)]
    df = spark.createDataFrame([(x, len(x)) for x in lines], "line string, length int")

    def plain(x, own):
        for shorter in range(1 if own else most + 1):
            n = len(x) - shorter
            t = min(most, n // every)
            if t >= max(shorter, 1):
                sizes = [n // (t + 1) + (k >= t + 1 - n % (t + 1)) for k in range(t + 1)]
                for k in range(t + 1):
                    for shift in range(max(-k, shorter - (t - k)), min(k, shorter + (t - k)) + 1):
                        if not own or not shift:
                            at = sum(sizes[:k]) + shift
                            yield x, n, 16 * t + k, x[at : at + sizes[k]], int(not shorter and not shift)

    for own in (False, True):
        got = line_dedup.keyed(df, most, every, own)
        assert "xxhash64" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "inline" not in plan
        want = spark.createDataFrame([p for x in lines for p in plain(x, own)], "line string, n int, at int, part string, own long")
        want = want.select("line", F.xxhash64("n", "at", "part").alias("key"), "own")
        assert sorted(map(tuple, got.select("line", "key", "own").collect())) == sorted(map(tuple, want.collect()))


def test_variants_of_one_line_make_few_pairs(spark, monkeypatch):
    """Variants are paired with one of them, in whatever order they come; those too far from it meet each other."""
    r = random.Random(4)
    line = "".join(r.choice("abcdefgh ") for _ in range(60))
    lines = [line[:k] + c + line[k + 1 :] for k in range(60) for c in "xyzuvw01234"]
    r.shuffle(lines)
    counted = []
    monkeypatch.setattr(line_dedup, "_pairs", lambda a, b, rows, own=line_dedup._pairs: counted.append(own(a, b, rows)) or counted[-1])
    docs = spark.createDataFrame([(k, "\n".join(lines[10 * k : 10 * k + 10])) for k in range(len(lines) // 10)], "doc_id long, text string")
    got = line_dedup.without_repeated_lines(docs)
    assert got.agg(F.sum("n_removed")).first()[0] == len(lines) - 1
    assert sum(p.count() for p in counted) < 20 * len(lines)


def test_line_dedup_stays_in_the_jvm(spark, sf):
    plan = line_dedup.line_digests(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|BroadcastNestedLoop", plan)
