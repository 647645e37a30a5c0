"""Every registered query of the training-data operators on whole small tables, against libraries or plain loops."""

import hashlib
import html
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import __spark_entry__
from granary.llm import digests, html_text, line_dedup, pretokens
from granary.llm.packing import piece_lengths

WORD, BYTE = (pretokens.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def run(spark, sf, name):
    return __spark_entry__.queries()[name](spark, sf).collect()


@pytest.fixture(scope="module")
def texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in sorted(rows)}


def ids_of(text, file):
    return pretokens.tokenizer(file).encode(text, add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_op1(spark, sf, texts):
    want, start = [], 0
    for k, t in texts.items():
        ids = ids_of(t, WORD) + [2]
        want.append((k, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in run(spark, sf, "op1_token_files")) == want


def test_op2(spark, sf, texts):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {k: fingerprint(t) for k, t in texts.items()}
    component = {k: k for k in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if component[b] < component[a] and (prints[a] ^ prints[b]).bit_count() <= 3:
                    component[a], changed = component[b], True
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, sf, "op2_simhash")} == {k: (f"{prints[k]:016x}", component[k]) for k in texts}


def test_op3(spark, sf, texts):
    def want(text):
        ids = ids_of(text, WORD)
        decoded = pretokens.tokenizer(WORD).decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, sf, "op3_bpe_codec")} == {k: want(t) for k, t in texts.items()}


def packed_as_wanted(rows, texts):
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} <= {0}
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(texts)
    for k, own in by.items():
        ids = ids_of(texts[k], BYTE) + [1]
        own.sort(key=lambda r: r.start)
        starts = np.cumsum([0, *piece_lengths(len(ids))]).tolist()
        assert [(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in own] == [(a, b - a, zlib.crc32(packed(ids[a:b])), len(ids)) for a, b in zip(starts, starts[1:], strict=False)]


def test_op4(spark, sf, texts):
    packed_as_wanted(run(spark, sf, "op4_packing"), texts)


def test_op5(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in run(spark, sf, "op5_main_text"):
        inside = re.search("<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inside))).split())
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want)) and r.text == html_text.main_text(pages[r.page_id].html)


def close(a, b):
    most = min(line_dedup.THRESHOLD, min(len(a), len(b)) // line_dedup.EVERY)
    if a == b or abs(len(a) - len(b)) > most:
        return a == b
    x, y = Counter(a), Counter(b)
    if max(sum((x - y).values()), sum((y - x).values())) > most:
        return False
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1] <= most


def without_repeats(texts):
    """{key: (left, lines, removed)}, in the order of texts."""
    by_length, exact, out = {}, set(), {}
    for k, text in texts.items():
        lines, kept = text.split("\n"), []
        for line in lines:
            own = line.strip(" \t\v\f\r")
            if not own or own not in exact and not any(close(own, s) for n in range(len(own) - 2, len(own) + 3) for s in by_length.get(n, ())):
                kept.append(line)
            if own and own not in exact:
                exact.add(own)
                by_length.setdefault(len(own), []).append(own)
        out[k] = "\n".join(kept), len(lines), len(lines) - len(kept)
    return out


def test_op6(spark, sf, texts):
    want = {k: (n, gone, len(left), hashlib.sha256(left.encode()).hexdigest()) for k, (left, n, gone) in without_repeats(texts).items()}
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_chars, r.text_sha256) for r in run(spark, sf, "op6_line_dedup")} == want


def test_op7(spark, sf, texts):
    rows = run(spark, sf, "op7_quality")
    assert {r.doc_id for r in rows} == set(texts) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(texts[r.doc_id], r.score) == r.score
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, quality[r.doc_id]) for r in rows if r.held_out and r.doc_id in quality]
    assert sum(p == q for p, q in held) >= 0.8 * len(held)


def test_op8(spark, sf, texts):
    want = {k: (len(t.encode()), len(ids_of(t, BYTE)), len(ids_of(t, BYTE)) > 512) for k, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, sf, "op8_token_counts")} == want


def test_op9(spark, sf):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    keys = np.array(sorted(vectors))
    x = np.array([vectors[k] for k in keys])
    by = {}
    for r in run(spark, sf, "op9_nearest"):
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {k for k in vectors if k % 20 == 0}
    hits = total = 0
    for q, rows in by.items():
        scores = (x * vectors[q]).sum(1)
        best = [k for _, k in sorted((-s, k) for s, k in zip(scores, keys.tolist(), strict=True) if k != q)][:20]
        rows.sort(key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, len(best) + 1)) and all(abs(r.score - float(vectors[q] @ vectors[r.vec_id])) < 1e-12 for r in rows)
        hits += len(set(best) & {r.vec_id for r in rows})
        total += len(best)
    assert hits >= 0.95 * total


def test_op10(spark, sf, texts):
    keys = list(texts)
    table = digests.rarity(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = {r.doc_id: r for r in run(spark, sf, "op10_digests")}
    assert set(rows) == set(keys)
    prints = {k: digests.chains([t.encode()], table)[0] for k, t in texts.items()}
    for k, following in zip(keys, [*keys[1:], keys[0]], strict=True):
        t, r = texts[k], rows[k]
        edited = t[: len(t) - len(t) // 4] + texts[following][: len(t) // 4]
        changed = digests.chains([edited.encode()], table)[0]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), digests.written_as(prints[k]), digests.written_as(changed))
        assert r.near_edited == digests.likeness(prints[k], changed) and r.near_next == digests.likeness(prints[k], prints[following])


def test_pipeline(spark, sf, texts):
    """The stages after the classifier, by plain loops from what it kept."""
    kept = {r.doc_id for r in run(spark, sf, "op7_quality") if r.predicted}
    left = {k: t for k, (t, _, _) in without_repeats({k: t for k, t in texts.items() if k in kept}).items()}

    def shingles(text):
        w = text.encode().lower().split()
        return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {k: shingles(t) for k, t in left.items()}
    root = {k: k for k in left}
    changed = True
    while changed:
        changed = False
        for a in left:
            for b in left:
                if root[b] < root[a] and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                    root[a], changed = root[b], True
    packed_as_wanted(run(spark, sf, "pipeline"), {k: t for k, t in left.items() if root[k] == k})
