"""Operators 1, 3, 4 and 8 against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.llm import bpe, packing, pretokens, token_counts, token_files
from granary.llm.common import fresh_path

WORD, BYTE = (pretokens.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
EDGES = [None, "", " ", "  ", "\n", "a", "A" * 5000, "x y" * 4000, "tabs\tand\r\nlines \n x", "<|endoftext|>", "a<|startoftext|>b", "it's they'll 'S", "日本語 text", "é é İı Ως", "\0 \x1c\x85\xa0z", "aaaa aaa aa", "1234 ½ ² x9"]


def ids_of(texts, file):
    return [e.ids for e in pretokens.tokenizer(file).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def mixed(n, seed):
    r = random.Random(seed)
    alphabet = [chr(c) for c in range(0x180)] + ["'s", "  ", "\n\n", "the ", "€", "<|endoftext|>"]
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(50))) for _ in range(n)]


@pytest.mark.parametrize("file", [WORD, BYTE])
def test_pieces_and_prefixes_and_counts_are_the_librarys(file):
    texts = EDGES + mixed(600, 1)
    want = ids_of(texts, file)
    assert list(pretokens.encode(texts, file)) == [packed(w) for w in want]
    assert token_counts.count_texts(texts, file) == [len(w) for w in want]
    found = list(bpe.encode_and_decode(texts, file))
    assert [f[0] for f in found] == [packed(w) for w in want]
    if file == WORD:
        t = pretokens.tokenizer(file)
        assert [f[1] for f in found] == [t.decode(w, skip_special_tokens=False) for w in want]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    for file in (WORD, BYTE):
        want = ids_of([text], file)[0]
        assert next(pretokens.encode([text], file)) == packed(want)
        assert next(bpe.encode_and_decode([text], file))[0] == packed(want)
        assert token_counts.count_texts([text], file) == [len(want)]


def test_a_forgetful_worker_gives_the_same(monkeypatch):
    texts = mixed(200, 3)
    small = pretokens.Remembered(WORD, lambda chunks: [tuple(p) for p in chunks], limit=10)
    large = pretokens.Remembered(WORD, lambda chunks: [tuple(p) for p in chunks])
    assert list(small.over(texts, lambda t: t)) == list(large.over(texts, lambda t: t))


@pytest.mark.parametrize("file", [BYTE, WORD])
def test_words_are_encoded_once(file):
    marks = ["", ",", ".", "!\n", "'s", "\n\n", "\t"]
    texts = [" ".join(f"{w}{m}" for w in ("zebrafish", "Örtchen", "x1y2")) for m in marks] + mixed(200, 5) + [" ", "", "\n", "a\n", "a\n \nb", "'", "' s"]
    small, large = pretokens.RememberedIds(file, limit=2000), pretokens.RememberedIds(file)
    calls, tokens = [], large.tokens
    large.tokens = lambda p: calls.append(p) or tokens(p)
    want = [packed(i) for i in ids_of(texts, file)]
    for r in (small, large):
        got = [x for k in range(0, len(texts), 20) for x in r.over(texts[k : k + 20], lambda x: packed(ids_of([x], file)[0]), b"".join)]
        assert got == want
    assert len(calls) == len(set(calls))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, k) for k, t in enumerate(EDGES)] + [(None, "no key", 0), (3, "same key", 1), (3, "same key", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")


def test_token_files(spark, docs):
    uri = fresh_path(spark, "t")
    token_files.write_token_files(docs, uri, WORD, 2, ranges=3)
    got = token_files.token_file_digests(spark, uri).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert starts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False))
    want = sorted((-1 if r.doc_id is None else r.doc_id, zlib.crc32(packed(i + [2]))) for r, i in zip(rows, ids_of([r.text for r in rows], WORD), strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in got) == want
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    chosen = token_files.read_token_files(spark, uri, {0, 5}).collect()
    assert sorted(r.doc_id for r in chosen) == [0, 5] and [r.ids for r in chosen if r.doc_id == 0] == [[2]]


def test_damage_and_plain_readers(spark, tmp_path):
    import zstandard

    uri = str(tmp_path / "f")
    texts = ["one two three", "four five six " * 50]
    token_files.write_token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), uri, WORD, 2, ranges=1)
    path = tmp_path / "f" / "000000.zst"
    data = path.read_bytes()
    out = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert out == b"".join(packed(i + [2]) for i in ids_of(texts, WORD))
    reader = token_files.FrameReader(str(path))
    broken = bytearray(data)
    broken[int(reader.offsets[1]) - 2] ^= 0xFF
    path.write_bytes(bytes(broken))
    reader = token_files.FrameReader(str(path))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        reader.ids(0)
    assert len(reader.ids(1)) > 1


def test_packing(spark, docs):
    rows = packing.pack(docs, BYTE, 1, longest=64, with_ids=True).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(0 <= r.sequence_id < 1 << 63 for r in rows)
    plan = packing.pack(docs, BYTE, 1)._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "Window" not in plan and "Exchange" not in plan
    assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0 and zlib.crc32(packed(r.ids)) == r.ids_crc32 for r in rows)
    by_length = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in by_length] == sorted((r.length for r in rows), reverse=True)
    for k, ids in enumerate(ids_of(EDGES, BYTE)):
        if k != 3:
            own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
            assert [i for r in own for i in r.ids] == ids + [1] and all(r.doc_tokens == len(ids) + 1 for r in own)


def test_sequence_numbers_do_not_meet():
    assert packing.sequence_number(15, (1 << 23) - 1, (1 << 36) - 1) == (1 << 63) - 1
    with pytest.raises(OverflowError):
        packing.sequence_number(0, 1 << 23, 0)


def test_long_pieces_and_what_is_remembered():
    import time

    r = random.Random(3)
    began = time.time()
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "ab", "a", "0123456789+/ABCDEF", "é世a"):
        texts = ["".join(r.choice(alphabet) for _ in range(n)) for n in (63, 64, 65, 500, 20_000)]
        assert token_counts.count_texts(texts, BYTE) == [len(i) for i in ids_of(texts, BYTE)]
    long = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    assert token_counts.count_texts([long], BYTE) == [len(i) for i in ids_of([long], BYTE)]
    assert time.time() - began < 60
    small = pretokens.Remembered(BYTE, lambda chunks: [len(c) for c in chunks], limit=1_000_000)
    for k in range(60):  # texts without spaces are one chunk each
        list(small.over([f"{k}" + "x" * 20_000], len))
        assert small.held <= 1_000_000 and sum(map(len, small.known)) * 6 <= 1_000_000


def test_ranges_split_a_hot_key(spark):
    from granary.llm.ordering import range_bounds, range_of

    rows = [(7 if k % 3 else None if k % 2 else k, k) for k in range(6000)]
    df = spark.createDataFrame(rows, "k long, v long")
    bounds = range_bounds(df, "k", 12)
    got = df.select("k", F.xxhash64("v").alias("h"), range_of(F.col("k"), F.xxhash64("v"), bounds).alias("r")).collect()
    assert len(bounds) == 11 and {x.r for x in got} <= set(range(12))
    ordered = sorted(got, key=lambda x: (x.k is not None, x.k or 0, x.h))
    assert [x.r for x in ordered] == sorted(x.r for x in got)
    assert max(sum(x.r == r for x in got) for r in range(12)) < 1000


@pytest.mark.parametrize("file", [WORD, BYTE])
def test_bpe_ids_decode_as_the_library_does(spark, docs, file):
    rows = bpe.bpe_ids(docs, file).collect()
    assert len(rows) == docs.count()
    known = pretokens.tokenizer(file)
    for r in rows:
        assert r.decoded == known.decode(r.ids, skip_special_tokens=False)
    assert all(list(i) == r for i, r in zip((np.frombuffer(b, "<u4") for b, _ in bpe.encode_and_decode(EDGES + mixed(200, 9), file)), ids_of(EDGES + mixed(200, 9), file), strict=True))


def test_piece_lengths():
    assert packing.piece_lengths(0) == [] and packing.piece_lengths(5000) == [2048, 2048, 512, 256, 128, 8]
    assert all(sum(packing.piece_lengths(n)) == n for n in range(5000))


def test_queries_on_edges_and_empty_tables(spark, docs):
    for df in (bpe.bpe_digests(docs, WORD), token_counts.token_counts(docs, BYTE)):
        assert df.count() == docs.count()
    none = docs.where(F.lit(False))
    assert bpe.bpe_digests(none, WORD).count() == 0 and token_counts.token_counts(none, BYTE).count() == 0 and packing.pack(none, BYTE, 1).count() == 0
    uri = fresh_path(spark, "t")
    assert token_files.write_token_files(none, uri, WORD, 2)["files"] == [] and token_files.token_file_digests(spark, uri).count() == 0
