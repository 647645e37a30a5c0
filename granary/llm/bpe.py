"""Operator 3: exact BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece there is one token that ends its encoding. An automaton over the vocabulary gives all
tokens that end at a position; of these the right one is the token whose neighbour before it (the last token of the
prefix that it leaves) stays unmerged beside it. Following those last tokens back from the end gives the ids.

Null and empty texts have no ids and decode to the empty text. Special strings inside a text become their ids, as
the library's default has it. Each row is encoded by itself: ties and repeated rows do not matter, and only the
key and the text are read, so extra columns of any name do no harm. A very long text is encoded whole, in time in
proportion to its length; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pretokens

#: Stands for the end-of-word mark, so that a mark is one character of the automaton's alphabet.
_END = "\ue000"
_BYTE_OF = {c: b for b, c in pretokens.BYTE_ALPHABET.items()}
#: Pairs whose test one worker remembers.
_PAIRS = 600_000


class PrefixCoder:
    def __init__(self, file: str):
        found = pretokens.vocabulary(file)
        model = found["model"]
        decoder = (found.get("decoder") or {}).get("type")
        if decoder not in (None, "ByteLevel"):
            raise ValueError(f"{file} has a decoder that is not supported: {decoder}")
        self.between = "" if decoder else " "
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        cut = len(self.suffix)
        self.spelled = {i: (t[:-cut] + _END if cut and t.endswith(self.suffix) else t) for t, i in vocab.items()}
        self.text = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in found["added_tokens"]}
        ids = {t: i for i, t in self.spelled.items()}
        self.ids = ids
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = (self._inner(x) for x in (m if isinstance(m, list) else m.split(" ")))
            self.merges[ids[a], ids[b]] = rank, ids[a + b]
        self.pairs: dict[int, bool] = {}
        self.tokens = ahocorasick.Automaton()
        for i, t in self.spelled.items():
            self.tokens.add_word(t, (i, len(t)))
        self.tokens.make_automaton()

    def _inner(self, token: str) -> str:
        return token[: -len(self.suffix)] + _END if self.suffix and token.endswith(self.suffix) else token

    def _symbols(self, token: int) -> list[int]:
        t = self.spelled[token]
        return [self.ids[c] for c in t] if t[-1] != _END else [*(self.ids[c] for c in t[:-2]), self.ids[t[-2:]]]

    def _merged(self, symbols: list[int]) -> list[int]:
        """Plain BPE of a few symbols: the lowest rank first, from the left."""
        while len(symbols) > 1:
            rank, new, at = min((*self.merges.get(p, (1 << 60, -1)), k) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if new < 0:
                break
            symbols = [*symbols[:at], new, *symbols[at + 2 :]]
        return symbols

    def stays(self, left: int, right: int) -> bool:
        """Whether two tokens side by side (left -1: the piece's start) are the encoding of what they spell."""
        key = left << 32 | right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            alone = [right] if left < 0 else [left, right]
            known = self.pairs[key] = self._merged([s for t in alone for s in self._symbols(t)]) == alone
        return known

    def encode(self, piece: str) -> list[int]:
        """The ids of one byte-level piece."""
        if self.suffix:
            piece += _END
        last: list[int] = [-1] * (len(piece) + 1)
        came: list[int] = [-1] * (len(piece) + 1)
        came[0] = 0
        pairs, stays = self.pairs, self.stays
        for end, (token, length) in self.tokens.iter(piece):
            end += 1
            start = end - length
            if last[end] < 0 and came[start] >= 0:
                left = last[start]
                ok = pairs.get(left << 32 | token)
                if stays(left, token) if ok is None else ok:
                    last[end], came[end] = token, start
        out, at = [], len(piece)
        while at > 0:
            out.append(last[at])
            at = came[at]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes: the tokens' own strings with a space between, or the bytes that they stand for."""
        spelled = self.between.join([self.text[i] for i in ids])
        return spelled if self.between else bytes(map(_BYTE_OF.__getitem__, spelled)).decode("utf-8", "replace")


@functools.cache
def coder(file: str) -> PrefixCoder:
    return PrefixCoder(file)


@functools.cache
def _remembered(file: str) -> pretokens.Remembered:
    c = coder(file)

    def value(pieces: list[str]) -> tuple[bytes, str]:
        ids = [i for p in pieces for i in c.encode(p)]
        return np.array(ids, "<u4").tobytes(), c.decode(ids)

    return pretokens.Remembered(file, lambda chunks: [value(pieces) for pieces in chunks])


def encode_and_decode(texts: list[str | None], file: str):
    """(ids as little-endian unsigned 32-bit integers, decoded text) of each whole text."""
    c = coder(file)

    def whole(text: str) -> list[tuple[bytes, str]]:
        ids = [i for p in pretokens.slow_pieces(text, file) for i in ([p] if isinstance(p, int) else c.encode(p))]
        return [(np.array(ids, "<u4").tobytes(), c.decode(ids))]

    for found in _remembered(file).over(texts, whole):
        yield b"".join([x[0] for x in found]), c.between.join([x[1] for x in found if x[1]])


def bpe_digests(docs: DataFrame, file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 for every row, in one pass without a shuffle."""

    def digest(parts):
        for part in parts:
            n, ids_hash, text_hash = [], [], []
            for ids, decoded in encode_and_decode(part.column(1).to_pylist(), file):
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(digest, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_ids(docs: DataFrame, file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int), decoded for every row: the operator's full output."""

    def full(parts):
        for part in parts:
            pairs = list(encode_and_decode(part.column(1).to_pylist(), file))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in pairs], pa.list_(pa.int32())), pa.array([d for _, d in pairs], pa.string())], names=[key, "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(full, f"`{key}` {kind}, ids array<int>, decoded string")
