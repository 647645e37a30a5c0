"""Operators 5, 7, 9 and 10, and the pipeline."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import ann, digests, html_text, quality

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a>One</a></li><li><a>Two</a></li></ul></nav><div class="cookie-notice">We use cookies to improve the experience of all visitors.</div>
<article><h1>A title</h1><p>First   paragraph with <b>bold</b>face &amp; an entity, long enough to look like text.<br>More.
<p>Short.</p><div class="ad">Buy the best things in the world, only today, for you and your family!</div><p>Last one, unclosed and rather long so that it counts.
<ul><li>An item</li></ul></article><aside>Related reading that nobody asked for, at some length.</aside>
<section id="comments"><article class="comment"><p>I strongly disagree with every word of this, friend.</p></article></section>
<form><label>Mail</label><input><p>Sign up to our newsletter today.</p><button>Go</button></form><footer>&copy; 2024 Site</footer>"""


def test_main_text():
    want = "A title First paragraph with boldface & an entity, long enough to look like text. More. Short. Last one, unclosed and rather long so that it counts. An item"
    assert html_text.main_text(PAGE) == want
    assert [html_text.main_text(x) for x in (None, "", "<p>", "<script>x", "</div></b>")] == [""] * 5
    assert html_text.main_text("<div id=menu><a>Home</a></div><div><p>" + "A div soup page of plain text. " * 5 + "</p><p>It goes on.</p></div>").endswith("It goes on.")


def test_minimum_cut_is_minimal():
    r = random.Random(2)
    for _ in range(150):
        n = r.randrange(1, 9)
        odds = [r.choice([r.uniform(-2, 2), 0.0, 1.0, -1.0]) for _ in range(n)]
        edges = {(i, j): r.uniform(0, 1.5) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5}

        def cost(side):
            return sum(abs(o) for s, o in zip(side, odds, strict=True) if s != (o > 0)) + sum(w for (i, j), w in edges.items() if side[i] != side[j])

        assert cost(html_text.minimum_cut(odds, edges)) == pytest.approx(min(map(cost, itertools.product((True, False), repeat=n))))


def test_page_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, "y"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = html_text.page_texts(pages).collect()
    assert len(got) == 3 and {r.n_chars for r in got} == {0, len(html_text.main_text(PAGE))}
    assert html_text.page_texts(pages.where(F.lit(False))).count() == 0


def test_quality_on_held_out_rows(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels)
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.9
    assert sum(r.predicted for r in held if r.quality) / sum(r.quality for r in held) > 0.95


def test_quality_fit_does_not_depend_on_order(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    again = docs.select("doc_id", F.concat("text", F.lit(" and more"))).toDF("doc_id", "text").limit(50)
    odd = labels.limit(5).withColumn("quality", 1 - F.col("quality"))
    docs, labels = docs.select("doc_id", "text").unionByName(again), labels.unionByName(odd)
    one, two = quality.fit(docs, labels), quality.fit(docs.orderBy(F.rand(1)), labels.orderBy(F.rand(2)))
    assert one.compressors == two.compressors and one.weights.tolist() == two.weights.tolist()
    sample = quality._sample(docs, labels, "doc_id", "text", "quality", 50, 20_000)
    assert all(len(t) <= 50 and sum(len(x.encode()) for x in t) <= 20_000 for t in sample.values()) and len(sample) == 4


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (3, "text", 5.0), (None, "text", 5.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1), (2, None)], "doc_id long, quality int")
    assert quality.quality_scores(docs, one).count() == 4
    assert quality.quality_scores(docs.where(F.lit(False)), one).count() == 0


def test_nearest(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 24))
    x[100:160] = x[7]  # a group of copies
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [None] * 24), (9005, [1.0]), (None, [1.0] * 24), (5, x[5].tolist())]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()
    by = {}
    for g in got:
        by.setdefault(g.query_id, []).append(g)
    assert set(by) == set(range(0, 3000, 20))
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda g: g.rank)
        assert [g.rank for g in found] == list(range(1, 21))
        score = (x * x[q]).sum(1)
        order = [k for k in np.lexsort((np.arange(3000), -score)) if k != q][:20]
        hits += len(set(order) & {g.vec_id for g in found})
        assert all(g.score == pytest.approx(score[g.vec_id], abs=1e-12) for g in found)
        assert [(-g.score, g.vec_id) for g in found] == sorted((-g.score, g.vec_id) for g in found)
    assert hits / (20 * len(by)) >= 0.95
    assert [g.vec_id for g in sorted(by[100], key=lambda g: g.rank)][:5] == [7, 101, 102, 103, 104]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert ann.nearest(few, F.col("id") == 0).count() == 2
    assert ann.nearest(few.where(F.lit(False)), F.col("id") == 0).count() == 0


def test_recall_with_a_small_share_reranked(spark):
    """8,000 candidates without any structure, of which a query's scan leaves 400 and 32 are reranked exactly."""
    r = np.random.default_rng(5)
    x = r.normal(size=(8000, 64))
    got = ann.nearest(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()
    by = {}
    for g in got:
        by.setdefault(g.query_id, set()).add(g.vec_id)
    hits = 0
    for q, found in by.items():
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(found & set(np.argsort(-score)[:20].tolist()))
    assert len(by) == 400 and hits / (20 * 400) >= 0.95


def test_levels_are_entropies():
    data = np.random.default_rng(0).integers(97, 103, 300).astype(np.uint8)
    w = digests.WINDOW
    want = [int(digests._TERM[np.bincount(data[k : k + w], minlength=256)].sum()) * digests.LEVELS // int(digests._TERM[w]) for k in range(300 - w + 1)]
    assert digests.levels(data).tolist() == want


def test_digests(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(500)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(80, 900))) for _ in range(40)] + [None, "", "short", "é" * 30]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[0], "x"), (3, texts[3], "x")], "doc_id long, text string, near_next string")
    got = digests.edited_likeness(docs).collect()
    assert len(got) == len(texts) + 2
    order = [(None, texts[0])] + sorted([(k, t or "") for k, t in enumerate(texts)] + [(3, texts[3])])
    import hashlib

    want = {}
    for k, (key, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        want.setdefault(key, []).append((len(t), hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest()))
    found = {}
    for g in got:
        found.setdefault(g.doc_id, []).append((g.n_chars, g.edited_sha256))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert len({g.fingerprint for g in got if g.doc_id in (None, 0)}) == 1
    long = [g for g in got if g.n_chars > 300 and g.doc_id not in (None, 3)]
    assert all(0.5 < g.near_edited <= 1 and 0 <= g.near_next < 0.3 for g in long)
    assert digests.edited_likeness(docs.where(F.lit(False))).count() == 0 and digests.edited_likeness(docs.where("doc_id = 1")).count() == 1


def brute_fingerprint(text, rank_of):
    """The filters as sets of bits, straight from the definition."""
    import xxhash

    data = text.encode()
    if not data:
        return []
    padded = data + bytes(15)
    rank = [rank_of[level(padded[k : k + 16])] for k in range(len(data))]

    def chosen(ranks, width):
        n, width = len(ranks), min(width, len(ranks))
        points = [0] * n
        for k in range(n - width + 1):
            points[min(range(k, k + width), key=lambda i: (ranks[i], i))] += 1
        enough = max(1, min(width // 4, n - width + 1))
        return [k for k in range(n) if points[k] >= enough] or [points.index(max(points))]

    small = max(1, len(data) - 4)
    places = sorted([(k, 16) for k in chosen(rank, 32)] + [(k, 5) for k in chosen(rank[:small], max(1, small // 16))])
    found = list(dict.fromkeys(padded[k : k + size] for k, size in places))
    hashes = [xxhash.xxh3_64_intdigest(f) for f in found]
    bits = [{h >> (11 * j) & 2047 for j in range(5)} for h in hashes]
    return [set().union(*bits[k : k + 160]) for k in range(0, len(bits), 160)]


def level(window):
    scaled = [round(c * np.log2(c) * 65536) if c else 0 for c in (window.count(b) for b in range(256))]
    return sum(scaled) * 1000 // round(16 * 4 * 65536)


def brute_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    total = 0.0
    for x in a:
        scores = [(len(x & y) - len(x) * len(y) / 2048) / max(min(len(x), len(y)) - len(x) * len(y) / 2048, 1e-9) for y in b]
        total += len(x) * max(0, min(1, max(scores)))
    return total / sum(map(len, a))


def test_digests_are_brute_force(spark):
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randrange(2, 9))) for _ in range(200)]
    texts = ["", "a", "abcd", "abcde", "abcdef"] + [" ".join(r.choice(words) for _ in range(n)) for n in (1, 2, 3, 5, 8, 9, 10, 11, 12, 13, 20, 60, 300)] + ["a" * 70, "short text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = np.zeros(1001, np.int64)
    for t in texts:
        padded = t.encode() + bytes(15)
        for k in range(len(t.encode())):
            counts[level(padded[k : k + 16])] += 1
    rank_of = {lv: place for place, lv in enumerate(sorted(range(1000), key=lambda lv: (counts[lv], lv)))} | {1000: 1000}
    prints = {k: brute_fingerprint(t, rank_of) for k, t in enumerate(texts)}

    def bits(fingerprint):
        return [set(np.flatnonzero(np.unpackbits(np.frombuffer(f, np.uint8))).tolist()) for f in digests.read_from(fingerprint)]

    for g in digests.edited_likeness(docs).collect():
        text, following = texts[g.doc_id], texts[(g.doc_id + 1) % len(texts)]
        edited = brute_fingerprint(text[: len(text) - len(text) // 4] + following[: len(text) // 4], rank_of)
        assert bits(g.fingerprint) == prints[g.doc_id] and bits(g.edited_fingerprint) == edited
        assert g.near_edited == pytest.approx(brute_likeness(prints[g.doc_id], edited))
        assert g.near_next == pytest.approx(brute_likeness(prints[g.doc_id], prints[(g.doc_id + 1) % len(texts)]))


def test_digests_have_no_cliff(spark):
    """Texts about 64 bytes long and everywhere else are like their copies with a byte more or less."""
    r = random.Random(5)
    letters = "".join(r.choice("abcdefghijklmnop ") for _ in range(400))
    docs = spark.createDataFrame([(k, letters[:k]) for k in range(400)], "doc_id long, text string")
    got = {g.doc_id: g.near_next for g in digests.edited_likeness(docs).collect()}
    assert min(got[k] for k in range(24, 399)) > 0.6


def test_pipeline(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "packing"]
    docs, counts = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, sf)
        assert left.columns == docs.columns
        counts.append(left.count())
        docs = left
    assert counts[0] == counts[1] > counts[2] > 0
    rows = corpus_pipeline.run(spark, sf).collect()
    assert len({r.doc_id for r in rows}) == counts[2]


def test_pipeline_edges(spark, sf, tmp_path):
    """Clashing columns keep their values; null and repeated keys, empty and very long texts, and an empty table pass."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "n_chars")
    good = docs.orderBy("doc_id").limit(1).first().text
    odd = spark.createDataFrame([(None, good, 7), (None, None, 0), (3, "", 0), (3, "", 0), (4, good + "\n" + "a very long line of prose " * 40_000, 1)], "doc_id long, text string, n_chars long")
    docs = docs.unionByName(odd).withColumns({"score": F.lit(-5.0), "Predicted": F.lit("p"), "n_lines": F.lit(-1), "n_removed": F.lit("r"), "x": F.lit(1), "d": F.lit(2), "id": F.lit(3)})
    for at, rows in (("all", docs), ("none", docs.where(F.lit(False)))):
        rows.write.parquet(f"{tmp_path}/{at}/documents.parquet")
        spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/{at}/labels.parquet")
    left = spark.read.parquet(f"{tmp_path}/all/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, f"{tmp_path}/all")
        assert left.columns == docs.columns
        assert [tuple(r) for r in left.select("score", "Predicted", "n_lines", "n_removed", "x", "d", "id").distinct().collect()] == [(-5.0, "p", -1, "r", 1, 2, 3)]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
