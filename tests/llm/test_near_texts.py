"""The pipeline's near duplicates against brute force."""

import glob
import os
import random
import time

import numpy as np
import pytest

import corpus_pipeline
from granary.llm import near_texts


def plain_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_firsts(texts):
    sets = [plain_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(k) for k in range(len(texts))}


@pytest.mark.parametrize("seed", range(2))
def test_stage_is_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(near_texts, "COMMON", 2 + 2 * seed)
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[r.choice(words) for _ in range(r.choice([3, 5, 6, 40, 120, 300]))] for _ in range(25)]
    passage = [r.choice(words) for _ in range(30)]
    texts = [None, "", " \n", "one", "One", "two words"]
    for _ in range(150):
        w = list(r.choice(base))
        for _ in range(r.randrange(1 + len(w) // 25)):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w + r.choice([[], [], passage])))
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, place long")
    assert {x.doc_id for x in near_texts.one_of_each(docs).collect()} == plain_firsts(texts)


def test_stage_drops_edited_copies(spark):
    """Some edits more than three bits of a fingerprint: a copy of 300 words with 6 of them changed, Jaccard over 0.8."""
    r = random.Random(1)
    rows = []
    for k in range(0, 40, 2):
        w = [f"w{r.randrange(5000)}" for _ in range(300)]
        edited = list(w)
        for at in range(10, 290, 50):
            edited[at] = "changed"
        rows += [(k, " ".join(w)), (k + 1, " ".join(edited))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(x.doc_id for x in got.collect()) == list(range(0, 40, 2))
    assert near_texts.one_of_each(docs.where("false")).count() == 0


def random_words(r, n):
    return [f"w{r.randrange(20_000)}" for _ in range(n)]


def test_unlike_long_texts_are_not_compared(spark, monkeypatch):
    """Two of 40 long texts share a passage each; texts were fetched for all such pairs, whose number grows with the square of the table."""
    r = random.Random(3)
    texts = [random_words(r, 1500) for _ in range(40)]
    for i in range(40):
        for j in range(i):
            texts[i][j * 7 : j * 7 + 6] = texts[j][i * 7 : i * 7 + 6] = random_words(r, 6)
    texts += [[*texts[0][:700], *random_words(r, 20), *texts[0][720:]], texts[1][:1250]]
    found = []

    def counted(df, what, of=near_texts.written):
        done = of(df, what)
        if what in ("pairs", "texts"):
            found.append((what, done.count()))
        return done

    monkeypatch.setattr(near_texts, "written", counted)
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    firsts = plain_firsts(texts)
    assert firsts == set(range(40)) and {x.doc_id for x in near_texts.one_of_each(docs).collect()} == firsts
    assert sum(n for what, n in found if what == "pairs") <= 4 and sum(n for what, n in found if what == "texts") <= 8


@pytest.mark.parametrize("least", [(4, 5), (1, 3)])
def test_outlines_of_all_lengths(spark, least):
    """Sets of either side of 512 and 1024 shingles, cut and edited to about the least similarity, by brute force."""
    r = random.Random(4)
    texts = []
    for n in (500, 540, 1000, 1100, 2300):
        w = random_words(r, n)
        for part in (1.0, 0.95, 0.84, 0.8, 0.79, 0.5, 0.35, 0.3):
            for edits in (0, 2, n // 90, n // 45):
                x = w[: int(n * part)]
                for at in r.sample(range(len(x)), min(edits, len(x))):
                    x[at] = "changed"
                texts.append(" ".join(x))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [plain_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        return k if root[k] == k else find(root[k])

    for i, x in enumerate(sets):
        for j in range(i):
            if least[1] * len(x & sets[j]) >= least[0] * len(x | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {x.doc_id for x in near_texts.one_of_each(docs, least=least).collect()} == {find(k) for k in range(len(texts))}


def test_outline_bounds_the_difference():
    r = np.random.default_rng(5)
    for n in (1, 511, 512, 513, 1500, 5000):
        x = np.unique(r.integers(0, 1 << 64, n, np.uint64))
        y = np.unique(np.r_[x[: len(x) * 9 // 10], r.integers(0, 1 << 64, n // 20 + 1, np.uint64)])
        a, b = (near_texts.outline(z) for z in (x, y))
        assert len(a) * 64 >= max(512, len(x))
        k = min(len(a), len(b))
        a, b = (z[:k] ^ z[k:] if len(z) == 2 * k else z for z in (a, b))
        assert sum(int(v).bit_count() for v in (a ^ b).view(np.uint64)) <= len(np.setxor1d(x, y))


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in glob.glob(f"{d.getPath()}/*/shuffle_*.data")}


def test_stage_leaves_nothing_on_disk(spark, tmp_path):
    """Shuffle files stayed until the driver happened to collect its garbage, and tables until the stage was written."""
    r = random.Random(6)
    docs = spark.createDataFrame([(k, " ".join(random_words(r, 60))) for k in range(200)], "doc_id long, text string")
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before, tables = shuffle_files(spark), set(os.listdir(shared)) if os.path.isdir(shared) else set()
    kept = near_texts.one_of_each(docs)
    for _ in range(50):  # Spark deletes them in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - tables} == {"first"}
    assert kept.count() == 200
