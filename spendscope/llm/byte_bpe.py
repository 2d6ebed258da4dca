"""Byte-level BPE, encoding and decoding.

A word is a match of the splitting pattern, found by Spark. Its bytes are folded: each step joins
the leftmost pair of pieces whose joined bytes have the lowest rank, and looks up the two pairs
that this changes. Tasks fold in Arrow batches, each distinct word of a slice of texts once, and
put the ids back in the places of the words; nothing is collected or shuffled.

A task remembers the first HOT_WORDS words of up to HOT_BYTES bytes, so results don't depend on
that number. A fold takes time by the square of a word's length; words of more than LONG_BYTES
are encoded by a heap of pairs, which gives the same ids.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_WORDS = 1 << 17
# Longer words are folded wherever they occur.
HOT_BYTES = 64
LONG_BYTES = 64
_NO_RANK = 2**31 - 1
# Words of texts that are folded together, about.
_SLICE_WORDS = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file, which are also the ids; each single byte must have one."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte has no rank")
    return ranks


def folded(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word's bytes, in time by the square of its length."""
    rank = ranks.get
    pieces = [word[k : k + 1] for k in range(len(word))]
    pairs = [rank(word[k : k + 2], _NO_RANK) for k in range(len(word) - 1)]
    while pairs:
        lowest = min(pairs)
        if lowest == _NO_RANK:
            break
        at = pairs.index(lowest)
        joined = pieces[at] + pieces[at + 1]
        pieces[at : at + 2] = [joined]
        del pairs[at]
        if at:
            pairs[at - 1] = rank(pieces[at - 1] + joined, _NO_RANK)
        if at < len(pairs):
            pairs[at] = rank(joined + pieces[at + 1], _NO_RANK)
    return [ranks[piece] for piece in pieces]


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word's bytes, in time by its length: the pair of lowest rank, leftmost first, joins next."""
    end = len(word)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))  # where pieces begin, as a list in both directions
    heap = [(ranks[word[k : k + 2]], k, k + 2) for k in range(end - 1) if word[k : k + 2] in ranks]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * end

    def offer(start: int) -> None:
        middle = after[start]
        if middle < end and (rank := ranks.get(word[start : after[middle]])) is not None:
            heapq.heappush(heap, (rank, start, after[middle]))

    while heap:
        _, start, stop = heapq.heappop(heap)
        middle = after[start]
        # Entries of pieces that have grown or gone since are passed over.
        if not alive[start] or middle >= end or after[middle] != stop:
            continue
        alive[middle] = 0
        after[start] = stop
        if stop < end:
            before[stop] = start
        offer(start)
        if before[start] >= 0:
            offer(before[start])
    ids, at = [], 0
    while at < end:
        ids.append(ranks[word[at : after[at]]])
        at = after[at]
    return ids


def words_of(text: Column, pattern: str) -> Column:
    """The matches of the pattern, with the character classes of Unicode."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))


class _Encoder:
    """Ids of lists of words; the first words are remembered."""

    def __init__(self, ranks: dict[bytes, int], hot_words: int):
        self.ranks, self.hot_words = ranks, hot_words
        self.hot: dict[bytes, list[int]] = {}

    def _ids(self, word: bytes) -> list[int]:
        ids = self.hot.get(word)
        if ids is None:
            ids = folded(word, self.ranks) if len(word) <= LONG_BYTES else merged(word, self.ranks)
            if len(word) <= HOT_BYTES and len(self.hot) < self.hot_words:
                self.hot[word] = ids
        return ids

    def encode(self, words: pa.ListArray) -> pa.ListArray:
        distinct = words.flatten().cast(pa.large_binary()).dictionary_encode()
        known = [self._ids(word) for word in distinct.dictionary.to_pylist()]
        sizes = np.array([len(ids) for ids in known], np.int64)
        values = np.array([i for ids in known for i in ids], np.int32)
        word = distinct.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes[word])])
        # Ids of the distinct words, in the places of the words.
        shift = (np.cumsum(sizes) - sizes)[word] - ends[:-1]
        ids = values[np.arange(ends[-1]) + np.repeat(shift, sizes[word])]
        bounds = words.offsets.to_numpy().astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(ends[bounds - bounds[0]].astype(np.int32)), pa.array(ids, pa.int32()))


def _slices(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """Consecutive lists of about _SLICE_WORDS values each."""
    bounds = lists.offsets.to_numpy()
    first = 0
    while first < len(lists):
        last = int(np.searchsorted(bounds, bounds[first] + _SLICE_WORDS, "right")) - 1
        last = min(max(last, first + 1), len(lists))
        yield lists.slice(first, last - first)
        first = last


def encoded(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    text_col: str = "text",
    hot_words: int = HOT_WORDS,
) -> DataFrame:
    """``docs`` with ``ids`` (array of int): the ids of each text, each match of the pattern by itself.

    A null or empty text has no ids. All columns stay, a column ids is replaced; rows may repeat.
    The pattern's character classes are those of the Java version that Spark runs on.
    """

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _Encoder(ranks, hot_words)
        for words in batches:
            yield pa.concat_arrays([encoder.encode(some) for some in _slices(words)] or [pa.array([], pa.list_(pa.int32()))])

    return docs.withColumn("ids", ids_of(words_of(F.col(text_col), pattern)))


def decoded(rows: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded`` (binary): the bytes of the ids, joined. Null ids give null, unknown ids fail."""
    pieces: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece

    @F.arrow_udf("binary")
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = pa.array(pieces, pa.binary())
        for lists in batches:
            yield pa.concat_arrays([_joined(some, known) for some in _slices(lists)] or [pa.array([], pa.binary())])

    return rows.withColumn("decoded", joined(F.col(ids_col)))


def _joined(lists: pa.ListArray, known: pa.Array) -> pa.Array:
    """The pieces of each list of ids, joined; null for a null list or one with a null."""
    bounds = lists.offsets.to_numpy()
    taken = known.take(lists.values.slice(bounds[0], bounds[-1] - bounds[0]))
    bounds = bounds - bounds[0]
    nulls = np.concatenate([[0], np.cumsum(pc.is_null(taken).to_numpy(zero_copy_only=False))])
    none = (nulls[bounds[1:]] > nulls[bounds[:-1]]) | pc.is_null(lists).to_numpy(zero_copy_only=False)
    _, where, data = pc.fill_null(taken, b"").buffers()
    # The pieces lie one after the other, so a text is what lies between its first and last one.
    ends = np.frombuffer(where, np.int32)[: len(taken) + 1][bounds] if len(taken) else np.zeros(len(bounds), np.int32)
    texts = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), data])
    return pc.if_else(pa.array(none), pa.scalar(None, pa.binary()), texts)
