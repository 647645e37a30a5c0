"""Split whole texts into chunks whose encodings do not depend on what stands around them, and remember those.

A BPE tokenizer merges inside the pieces of its pre-tokenizer only, and no piece crosses the places where a text is
cut here (before a single space, or at white space that is dropped). Chunks repeat, so a worker keeps what it has
encoded in a dictionary of bounded size. The fast split holds for Latin texts without runs of spaces and without a
special token's opening; every other text goes through the tokenizer's own pre-tokenizer, with the same result.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Callable, Collection, Iterator

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

#: Unicode's letters, numbers and white space among the code points up to U+017F.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾", "\\t-\\r \u0085\u00a0"
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
#: Stands between chunks that are split together; beyond the code points that the fast split covers.
_BETWEEN = "\ue000"
#: The pre-tokenizers' patterns over those code points, and the mark between chunks, where a chunk ends.
_BYTE_LEVEL = re.compile(f"{_BETWEEN}|{_SUFFIXES}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}{_BETWEEN}]+|[{SPACES}]+(?![^{SPACES}{_BETWEEN}])|[{SPACES}]+")
_WORDS = re.compile(f"{_BETWEEN}|{_SUFFIXES}|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}{_BETWEEN}]+")
#: What the fast split does not cover. U+0130 is left out because its lower case is two code points.
_BEYOND_BYTES = re.compile("[^\u0001-įı-ſ]|  |<\\|")
_BEYOND_WORDS = re.compile("[^\u0000-\u001b -įı-ſ]|<\\|")
#: Bytes, by estimate, that one worker remembers for one file; beyond it the dictionary starts anew from the last batch.
REMEMBERED = 120_000_000
#: Characters of the longest piece of the last batch that outlasts a new start.
KEPT = 100


def path(name: str) -> str:
    return public_tokenizers.path(name)


@functools.cache
def tokenizer(file: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    t = Tokenizer.from_file(file)
    t.no_truncation()
    t.no_padding()
    return t


@functools.cache
def vocabulary(file: str) -> dict:
    """The tokenizer file as written."""
    with open(file, encoding="utf-8") as f:
        return json.load(f)


def _byte_alphabet() -> dict[int, str]:
    """Byte to the printable character that stands for it in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_ALPHABET = _byte_alphabet()


def byte_level(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(BYTE_ALPHABET)


def byte_levels(pieces: list[str]) -> list[str]:
    """byte_level of many pieces at once, as far as none holds the character that stands between them."""
    found = byte_level("\0".join(pieces)).split(BYTE_ALPHABET[0])
    return found if len(found) == len(pieces) else list(map(byte_level, pieces))


def _byte_chunks(text: str) -> list[str] | None:
    if ("  " in text or "<|" in text or "\0" in text) if text.isascii() else _BEYOND_BYTES.search(text):
        return None
    return text.replace(" ", "\0 ").split("\0")


def _word_chunks(text: str) -> list[str] | None:
    return None if _BEYOND_WORDS.search(text) else text.lower().split()


#: For each known file: text to chunks (None where the fast split does not hold), and chunk to pieces.
FAST = {"byte_bpe_50k.json": (_byte_chunks, _BYTE_LEVEL.findall), "word_bpe_49k.json": (_word_chunks, _WORDS.findall)}


def slow_pieces(text: str, file: str) -> list[str | int]:
    """The byte-level pieces of a whole text by the tokenizer's own normalizer and pre-tokenizer; ids of special strings."""
    t = tokenizer(file)
    special = {x["content"]: x["id"] for x in vocabulary(file)["added_tokens"]}
    out: list[str | int] = []
    for part in re.split("(" + "|".join(map(re.escape, special)) + ")", text):
        if part in special:
            out.append(special[part])
        elif part:
            part = t.normalizer.normalize_str(part) if t.normalizer else part
            out += [p for p, _ in t.pre_tokenizer.pre_tokenize_str(part) if p] if part else []
    return out


class Remembered:
    """Chunk to value, with one call of values_of for all the unknown chunks of a batch of texts.

    values_of takes one list of byte-level pieces for each chunk and returns one value for each.
    """

    def __init__(self, file: str, values_of: Callable[[list[list[str]]], list], limit: int = REMEMBERED):
        self.chunks, self.pieces = FAST.get(os.path.basename(file), (lambda _: None, None))
        self.values_of, self.limit, self.known, self.held = values_of, limit, {}, 0

    def values(self, chunks: list[str]) -> list:
        return self.values_of([[byte_level(p) for p in self.pieces(c)] for c in chunks])

    def learn(self, batch: list[list[str]]) -> dict:
        """What is known, with all chunks of the batch. A chunk counts for its text, its value and their objects."""
        seen = set().union(*batch)
        unknown = list(seen.difference(self.known))
        size = sum(map(len, unknown)) * 6 + 200 * len(unknown)
        if self.held + size > self.limit:
            self.known = {c: self.known[c] for c in seen.intersection(self.known)}
            self.held = sum(map(len, self.known)) * 6 + 200 * len(self.known)
        self.held += size
        self.known.update(zip(unknown, self.values(unknown) if unknown else [], strict=True))
        return self.known

    def over(self, texts: list[str | None], whole: Callable[[str], object], gathered: Callable[[Iterator], object] = list) -> Iterator:
        """For each text its chunks' values, gathered, or whole(text) where the fast split does not hold. Null: empty."""
        for batch in batches(texts):
            parts = [self.chunks(x) for x in batch]
            value = self.learn([p for p in parts if p is not None]).__getitem__
            for text, part in zip(batch, parts, strict=True):
                yield whole(text) if part is None else gathered(map(value, part))
            if self.held > self.limit:
                self.known, self.held = {}, 0


def batches(texts: list[str | None], chars: int = 2_000_000) -> Iterator[list[str]]:
    """Runs of whole texts of about so many characters, so that the chunks of a batch stay few."""
    batch, held = [], 0
    for text in texts:
        batch.append(text or "")
        held += len(batch[-1])
        if held >= chars:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


class RememberedIds(Remembered):
    """Chunk to its ids as bytes. Unknown chunks are split together and their pieces are encoded once, so that chunks
    that differ in punctuation share the word; pieces are remembered within the same bound as chunks. Ids stay in flat
    arrays, as objects for each chunk cost more than encoding it."""

    def __init__(self, file: str, limit: int = REMEMBERED):
        super().__init__(file, None, limit)
        self.tokens, self.words, self.words_held = tokenizer(file).model.tokenize, {}, 0

    @staticmethod
    def _size(words: Collection[str]) -> int:
        return sum(map(len, words)) * 6 + 200 * len(words)

    def values(self, chunks: list[str]) -> list[bytes]:
        flat = self.pieces(_BETWEEN.join(chunks))
        seen = set(flat)
        self.words[_BETWEEN] = _NO_ID.tobytes()
        new = list(seen.difference(self.words))
        ids, counts = array("I"), array("q")
        for form in byte_levels(new):
            found = [t.id for t in self.tokens(form)]
            ids.extend(found)
            counts.append(len(found))
        self.words.update(zip(new, _cut(ids.tobytes(), 4 * np.cumsum(counts), 0), strict=True))
        self.words_held += self._size(new)
        data = b"".join(map(self.words.__getitem__, flat)) + _NO_ID.tobytes()
        if self.words_held > self.limit:
            self.words = {p: self.words[p] for p in seen if len(p) <= KEPT}
            self.words_held = self._size(self.words)
        return _cut(data, 4 * np.flatnonzero(np.frombuffer(data, "<u4") == _NO_ID), 4)


#: Stands between the ids of chunks; no vocabulary is so large.
_NO_ID = np.array(0xFFFFFFFF, "<u4")


def _cut(data: bytes, ends: np.ndarray, between: int) -> list[bytes]:
    """The parts of data that end there, with so many bytes between them."""
    out, start = [], 0
    for end in ends.tolist():
        out.append(data[start:end])
        start = end + between
    return out


@functools.cache
def _library(file: str) -> Remembered:
    return RememberedIds(file)


def encode(texts: list[str | None], file: str) -> Iterator[bytes]:
    """Each whole text's ids by the tokenizers library, as little-endian unsigned 32-bit integers; null counts as empty."""
    return _library(file).over(texts, lambda x: np.array(tokenizer(file).encode(x, add_special_tokens=False).ids, "<u4").tobytes(), b"".join)
