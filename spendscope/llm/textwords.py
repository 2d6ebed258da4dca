"""Words of texts as arrays of 64-bit hashes, for operators that compare word sequences.

A word is a longest run of bytes other than 0x20 and 0x09 to 0x0D. Texts are worked on in
slices of about a megabyte, whatever the size of the Arrow batches they come in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 20
# Bytes that belong to words.
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
# Longer words are hashed one by one.
LONG_WORD = 256
# Windows are polynomials modulo this prime; modulo 2**64 some sequences clash whatever the base.
PRIME = (1 << 61) - 1
_BASE = 0x1E3779B97F4A7C15
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
# Keeps as many of the first bytes of eight as its number says.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Slice(NamedTuple):
    """Some consecutive texts: their row ids, bytes and the first byte of each (and the end)."""

    ids: np.ndarray
    buffer: np.ndarray
    offsets: np.ndarray


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    z = values ^ (values >> np.uint64(30))
    z = z * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _residue(x: np.ndarray) -> np.ndarray:
    """Any 64-bit values modulo PRIME."""
    prime = np.uint64(PRIME)
    x = (x & prime) + (x >> np.uint64(61))
    return np.where(x >= prime, x - prime, x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of residues modulo PRIME, by halves of 30 and 31 bits; 2**61 counts as 1."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    high = (a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30))
    return _residue(high + ((middle & _LOW30) << np.uint64(31)) + a0 * b0)


class _Powers:
    """Powers of a base modulo PRIME, extended when a longer range asks for them."""

    def __init__(self, base: int):
        self.base = base
        self.values = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            step = np.uint64(pow(self.base, len(self.values), PRIME))
            self.values = np.concatenate([self.values, _product(self.values, step)])
        return self.values[:n]


_FORWARD, _BACKWARD = _Powers(_BASE), _Powers(pow(_BASE, -1, PRIME))


def text_slices(batches: Iterable[pa.RecordBatch], most: int = 1 << 20) -> Iterator[Slice]:
    """Batches of (id, text) as slices of ``most`` texts at most; a null text is an empty one. Ids must not be null."""
    for batch in batches:
        text = pc.fill_null(batch.column(1), "").cast(pa.large_string())
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        _, where, data = text.buffers()
        offsets = np.frombuffer(where, np.int64)[text.offset : text.offset + len(text) + 1]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        first = 0
        while first < len(text):
            last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
            last = min(max(last, first + 1), first + most, len(text))
            here = offsets[first : last + 1]
            yield Slice(ids[first:last], whole[here[0] : here[-1]], here - here[0])
            first = last


def word_spans(part: Slice, word_bytes: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the number of the first word of each text (and the end)."""
    n = len(part.buffer)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(part.offsets), np.int64)
    word = word_bytes[part.buffer]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    closes = word.copy()
    closes[:-1] &= ~word[1:]
    # A text's first byte opens a word and its last one closes it, whatever the neighbours hold.
    firsts = part.offsets[:-1][part.offsets[:-1] < n]
    opens[firsts] = word[firsts]
    lasts = part.offsets[1:][part.offsets[1:] > 0] - 1
    closes[lasts] = word[lasts]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, part.offsets)


def word_hashes(part: Slice, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes; lower: A to Z count as a to z.

    Eight bytes after the other are mixed in, starting from the length.
    """
    n = len(part.buffer)
    data = np.zeros(n + 8, np.uint8)
    data[:n] = _LOWER[part.buffer] if lower else part.buffer
    eights = np.ndarray((n + 1,), "<u8", data, strides=(1,))
    left = ends - starts
    out = mixed(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    long = np.flatnonzero(left > LONG_WORD)
    which, at = np.arange(len(starts)), starts
    if len(long):
        which = np.flatnonzero(left <= LONG_WORD)
        at, left = at[which], left[which]
    while len(which):
        out[which] = mixed(out[which] ^ (eights[at] & _HEAD[np.minimum(left, 8)]))
        more = left > 8
        which, at, left = which[more], at[more] + 8, left[more] - 8
    for k in long.tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest()
        out[k] = int.from_bytes(digest, "little")
    return out


def rolling_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Rabin-Karp hash of every ``length`` consecutive word hashes, in order.

    The polynomial of a window is a difference of prefix sums, moved to position 0 by the
    inverse of the base: the rolling update of all positions at once. The sums are kept in
    two halves, so that none overflows.
    """
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    terms = _product(_residue(words), _FORWARD.upto(len(words)))
    high, low = np.zeros((2, len(words) + 1), np.uint64)
    np.cumsum(terms >> np.uint64(31), out=high[1:])
    np.cumsum(terms & _LOW31, out=low[1:])
    high, low = high[length:] - high[:n], low[length:] - low[:n]
    sums = _residue((high >> np.uint64(30)) + ((high & _LOW30) << np.uint64(31)) + low)
    return mixed(_product(sums, _BACKWARD.upto(n)) + np.uint64(length * 0x9E3779B97F4A7C15 % (1 << 64)))


def window_owners(bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows that lie within one text: their first words, and the text of each."""
    counts = np.maximum(np.diff(bounds) - length + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[:-1][owner]
    return first, owner


def small_index(values: np.ndarray, size: int) -> bytes:
    """Numbers below ``size`` in as few bytes as it allows."""
    return values.astype(_index_type(size)).tobytes()


def from_small_index(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, _index_type(size))


def _index_type(size: int) -> type:
    return np.uint8 if size <= 1 << 8 else np.uint16 if size <= 1 << 16 else np.uint32


def planes(values: np.ndarray) -> bytes:
    """64-bit values byte by byte: all lowest bytes, ..., all highest ones. Sorted values shrink so."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view(np.uint64).ravel()


def by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions in the order of their hashes) for each bucket with hashes."""
    order = np.argsort(hashes, kind="stable")
    bucket = (hashes[order] % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    inner = np.argsort(bucket, kind="stable")
    order, bucket = order[inner], bucket[inner]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for part in np.split(np.arange(len(order)), cuts) if len(order) else []:
        yield int(bucket[part[0]]), order[part]


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: int = 1) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal first ``keys`` columns, across batches."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(keys)]
        start = 0
        for row in range(batch.num_rows + 1):
            here = tuple(c[row] for c in columns) if row < batch.num_rows else None
            if row < batch.num_rows and here == key:
                continue
            if row > start:
                held.append(batch.slice(start, row - start))
            if row < batch.num_rows:
                if held:
                    yield key, pa.Table.from_batches(held)
                held, key, start = [], here, row
    if held:
        yield key, pa.Table.from_batches(held)


def task_count(spark: SparkSession, size: int, each: int) -> int:
    """How many tasks to deal ``size`` bytes to, at about ``each`` at most."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))
