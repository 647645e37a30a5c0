"""Operator 8: token counts by rank-synchronous merging of ragged arrays.

All pieces of a batch lie one after another in one array of symbol ids. In each round every piece finds the lowest
rank among its neighbouring pairs, and all of them merge all places of that pair at once; a piece without a known
pair is done. The symbols that survive are the tokens, so no list of tokens is ever built.

Pieces of more than LONG symbols would take as many rounds over the whole array as they have different pairs. Theirs
are linked arrays, with the places of every rank held beside them: a round takes the places of the lowest rank that is
left in any of them, merges all at once, and ranks only the pairs beside the merged places anew. Pieces do not touch
each other, so the lowest rank of all is the lowest of every piece that has it, and the result is the same.

Null and empty texts count zero tokens; an empty table gives no rows. A very long text is counted whole, in time about
in proportion to its length. Special strings inside a text count as one token each, as the library's
default has it. Repeated rows and ties do not matter, as each row is counted by itself; extra columns are not read.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pretokens

_NONE = np.iinfo(np.int64).max
#: Symbols from which on a piece is merged in linked arrays.
LONG = 64


class RankMerger:
    """The merges of one byte-level BPE file as sorted arrays."""

    def __init__(self, file: str):
        model = pretokens.vocabulary(file)["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[(a[: -len(suffix)] if suffix and a.endswith(suffix) else a) + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        self.first = np.zeros(512, np.int64)
        self.last = np.zeros(512, np.int64)
        for c in pretokens.BYTE_ALPHABET.values():
            self.first[ord(c)], self.last[ord(c)] = vocab[c], vocab[c + suffix]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def counts(self, pieces: list[str]) -> np.ndarray:
        """Surviving symbols of each non-empty byte-level piece."""
        length = np.array([len(p) for p in pieces], np.int64)
        out = np.zeros(len(pieces), np.int64)
        for chosen, count in ((length <= LONG, self._short), (length > LONG, self._long)):
            if chosen.any():
                out[chosen] = count([pieces[k] for k in np.flatnonzero(chosen).tolist()])
        return out

    def _symbols(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all pieces one after another, and where each piece ends."""
        codes = np.frombuffer("".join(pieces).encode("utf-16-le"), "<u2").astype(np.int64)
        ends = np.cumsum([len(p) for p in pieces])
        symbols = self.first[codes]
        symbols[ends - 1] = self.last[codes[ends - 1]]
        return symbols, ends

    def _long(self, pieces: list[str]) -> np.ndarray:
        symbols, ends = self._symbols(pieces)
        n = len(symbols)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[ends - 1] = -1
        before[np.r_[0, ends[:-1]]] = -1
        rank = np.full(n, _NONE)
        held: dict[int, list[np.ndarray]] = {}
        lowest: list[int] = []

        def place(at: np.ndarray) -> None:
            """Rank the pairs that begin at these symbols and put them beside others of their rank."""
            at = at[following[at] >= 0]
            found = rank[at] = self.ranks(symbols[at], symbols[following[at]])
            at, found = at[found != _NONE], found[found != _NONE]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else []
            for r, group in zip(found[starts].tolist(), np.split(at, starts[1:]), strict=True) if len(found) else ():
                if r not in held:
                    held[r] = []
                    heapq.heappush(lowest, r)
                held[r].append(group)

        place(np.arange(n))
        gone = np.zeros(n, bool)
        while lowest:
            r = heapq.heappop(lowest)
            groups = held.pop(r)
            at = np.unique(np.concatenate(groups)) if len(groups) > 1 else np.sort(groups[0])
            at = at[(rank[at] == r) & ~gone[at]]
            if not len(at):
                continue
            if symbols[at[0]] == symbols[following[at[0]]]:
                # of a run of overlapping places (a a a), every second one from the left merges
                run = np.flatnonzero(np.r_[True, following[at[:-1]] != at[1:]])
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            right = following[at]
            after = following[right]
            gone[right] = True
            symbols[at] = self.made[r]
            following[at] = after
            rank[at] = _NONE
            inner = after >= 0
            before[after[inner]] = at[inner]
            left = before[at]
            place(np.unique(np.concatenate([at, left[left >= 0]])))
        return np.add.reduceat(~gone, np.r_[0, ends[:-1]], dtype=np.int64)

    def _short(self, pieces: list[str]) -> np.ndarray:
        out = np.zeros(len(pieces), np.int64)
        length = np.array([len(p) for p in pieces], np.int64)
        symbols, _ = self._symbols(pieces)
        owner = np.repeat(np.arange(len(pieces)), length)
        while len(symbols):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rank = np.full(len(symbols), _NONE)
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inside] = self.ranks(symbols[inside], symbols[inside + 1])
            lowest = np.minimum.reduceat(rank, start)
            size = np.diff(np.r_[start, len(symbols)])
            done = lowest == _NONE
            out[owner[start[done]]] = size[done]
            every = np.repeat(lowest, size)
            hit = (rank == every) & (rank != _NONE)
            # of a run of overlapping places (a a a), every second one from the left merges
            at = np.flatnonzero(hit)
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1]) if len(at) else at
            in_run = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)])) if len(at) else at
            overlaps = symbols[at] == symbols[np.minimum(at + 1, len(symbols) - 1)]
            at = at[~overlaps | (in_run % 2 == 0)]
            symbols[at] = self.made[rank[at]]
            stays = np.repeat(~done, size)
            stays[at + 1] = False
            symbols, owner = symbols[stays], owner[stays]
        return out


@functools.cache
def _merger(file: str) -> RankMerger:
    return RankMerger(file)


@functools.cache
def _remembered(file: str) -> pretokens.Remembered:
    def values_of(chunks: list[list[str]]) -> list[int]:
        counts = _merger(file).counts([p for pieces in chunks for p in pieces])
        ends = np.cumsum([0, *map(len, chunks)])
        sums = np.r_[0, np.cumsum(counts)]
        return (sums[ends[1:]] - sums[ends[:-1]]).tolist()

    return pretokens.Remembered(file, values_of)


def count_texts(texts: list[str | None], file: str) -> list[int]:
    """Tokens of each whole text; null counts as empty."""

    def whole(text: str) -> list[int]:
        pieces = pretokens.slow_pieces(text, file)
        words = [p for p in pieces if isinstance(p, str)]
        return [len(pieces) - len(words), *_merger(file).counts(words).tolist()]

    return [sum(x) for x in _remembered(file).over(texts, whole)]


def token_counts(docs: DataFrame, file: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for every row; no shuffle, one pass over key and text."""

    def count(parts):
        for part in parts:
            texts = part.column(1).to_pylist()
            n = count_texts(texts, file)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len((x or "").encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
