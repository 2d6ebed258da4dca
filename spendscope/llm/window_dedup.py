"""Substring dedup: removal of long word sequences that an earlier document has too.

Every window of ``length`` words gets a Rabin-Karp hash. The hashes meet in Spark, which finds
the smallest document of each; a window that a smaller document starts is removed. Windows of
one document that overlap or touch merge into maximal intervals of words.

Tasks hand on the smallest document per hash they met and say at once that their other
documents repeat it, so a passage that a third of all documents share costs one row per task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.llm.textwords import (
    Slice,
    by_bucket,
    from_small_index,
    planes,
    rolling_hashes,
    small_index,
    sorted_groups,
    task_count,
    text_slices,
    unplanes,
    window_owners,
    word_hashes,
    word_spans,
)

WINDOW_WORDS = 50
# Texts and windows that a task compares before it hands them on.
FLUSH_TEXTS = 256
FLUSH_ROWS = 1 << 18
# Bytes of text whose windows are compared at once, and those that a task compares one after the other.
BUCKET_BYTES = 4 << 20
TASK_BYTES = 16 << 20
# Rows that are cut at once.
CUT_ROWS = 512

# Buckets below the number of buckets hold (document, hash) that are still to be compared,
# the ones from there on hold found repeats, by document.
_SHARD = "bucket int, docs binary, owner binary, hashes binary"
_FIELDS = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("owner", pa.binary()), ("hashes", pa.binary())])


def _packed(docs: np.ndarray, hashes: np.ndarray, keys: np.ndarray, buckets: int, first: int) -> list[dict]:
    """Rows of a bucket each; where the hashes are the keys, the bucket is their remainder and is left out of them."""
    rows = []
    for bucket, at in by_bucket(keys, buckets):
        at = at[np.argsort(hashes[at], kind="stable")]
        own, local = np.unique(docs[at], return_inverse=True)
        kept = hashes[at] if first else hashes[at] // np.uint64(buckets)
        rows.append(
            {
                "bucket": first + bucket,
                "docs": own.tobytes(),
                "owner": small_index(local, len(own)),
                "hashes": planes(kept),
            }
        )
    return rows


def _unpacked(rows: list[dict], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    docs, hashes = [], []
    for row in rows:
        own, values = np.frombuffer(row["docs"], np.int64), unplanes(row["hashes"])
        docs.append(own[from_small_index(row["owner"], len(own))])
        hashes.append(values if row["bucket"] >= buckets else values * np.uint64(buckets) + np.uint64(row["bucket"]))
    return np.concatenate(docs), np.concatenate(hashes)


def _least_first(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, document) in order; whether each is the smallest document of its hash."""
    order = np.lexsort((docs, hashes))
    docs, hashes = docs[order], hashes[order]
    if not len(docs):
        return docs, hashes, np.zeros(0, bool)
    least = np.r_[True, hashes[1:] != hashes[:-1]]
    new = least | np.r_[True, docs[1:] != docs[:-1]]
    return docs[new], hashes[new], least[new]


def _doc_keys(docs: np.ndarray) -> np.ndarray:
    return docs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)


def _shards(batches: Iterable[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    texts = rows = 0

    def flushed() -> pa.RecordBatch:
        docs, hashes, least = _least_first(*(np.concatenate(x) for x in zip(*held)))
        out = _packed(docs[least], hashes[least], hashes[least], buckets, 0)
        repeat = docs[~least], hashes[~least]
        out += _packed(*repeat, _doc_keys(repeat[0]), buckets, buckets)
        return pa.RecordBatch.from_pylist(out, _FIELDS)

    for part in text_slices(batches, FLUSH_TEXTS):
        if held and texts + len(part.ids) > FLUSH_TEXTS:
            yield flushed()
            held, texts, rows = [], 0, 0
        starts, ends, bounds = word_spans(part)
        windows = rolling_hashes(word_hashes(part, starts, ends, lower=False), length)
        first, owner = window_owners(bounds, length)
        if len(first):
            held.append((part.ids[owner], windows[first]))
            texts, rows = texts + len(part.ids), rows + len(first)
        if rows >= FLUSH_ROWS:
            yield flushed()
            held, texts, rows = [], 0, 0
    if held:
        yield flushed()


def _repeats(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each hash, the documents but the smallest one; found repeats pass."""
    for (bucket,), table in sorted_groups(batches):
        if bucket >= buckets:
            yield from table.to_batches()
            continue
        docs, hashes, least = _least_first(*_unpacked(table.to_pylist(), buckets))
        docs, hashes = docs[~least], hashes[~least]
        if len(docs):
            yield pa.RecordBatch.from_pylist(_packed(docs, hashes, _doc_keys(docs), buckets, buckets), _FIELDS)


def _by_document(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for _, table in sorted_groups(batches):
        docs, hashes, _ = _least_first(*_unpacked(table.to_pylist(), buckets))
        order = np.argsort(docs, kind="stable")
        docs, hashes = docs[order], hashes[order]
        cuts = np.r_[np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]), len(docs)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(docs[cuts[:-1]], pa.int64()),
                pa.array([hashes[lo:hi].tobytes() for lo, hi in zip(cuts[:-1], cuts[1:])], pa.binary()),
            ],
            ["row", "hashes"],
        )


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, length: int = WINDOW_WORDS) -> DataFrame:
    """(row, hashes): per document, the sorted hashes of its windows that a smaller document has."""
    texts = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    texts = texts.where("row is not null and text is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = docs.sparkSession
    tasks, buckets = task_count(spark, size, TASK_BYTES), task_count(spark, size, BUCKET_BYTES)
    shards = texts.mapInArrow(partial(_shards, length=length, buckets=buckets), _SHARD)
    found = (
        shards.repartition(tasks, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(partial(_repeats, buckets=buckets), _SHARD)
    )
    dealt = found.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(partial(_by_document, buckets=buckets), "row long, hashes binary")


def removed_words(words: list[bytes], hashes: np.ndarray, length: int) -> np.ndarray:
    """Which words lie in a window whose hash is one of the sorted ``hashes``."""
    covered = np.zeros(len(words) + 1, np.int64)
    data = b" ".join(words)
    part = Slice(np.zeros(1, np.int64), np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    starts, ends, _ = word_spans(part)
    windows = rolling_hashes(word_hashes(part, starts, ends, lower=False), length)
    at = np.minimum(np.searchsorted(hashes, windows), len(hashes) - 1)
    first = np.flatnonzero(hashes[at] == windows)
    covered[first] += 1
    np.subtract.at(covered, first + length, 1)
    return np.cumsum(covered)[:-1] > 0


def _cut(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Adds the results to the rows; the first two columns are the text and its hashes."""
    for batch in (b.slice(at, CUT_ROWS) for b in batches for at in range(0, b.num_rows, CUT_ROWS)):
        n_words, n_removed, spans, kept = [], [], [], []
        for text, data in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
            words = (text or b"").split()
            n_words.append(len(words))
            if data is None:
                n_removed.append(0)
                spans.append([])
                kept.append(None if text is None else b" ".join(words))
                continue
            gone = removed_words(words, np.frombuffer(data, np.uint64), length)
            edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            n_removed.append(int(gone.sum()))
            spans.append([{"first": int(a), "last": int(b) - 1} for a, b in edges.reshape(-1, 2)])
            kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g))
        span = pa.struct([("first", pa.int64()), ("last", pa.int64())])
        added = [
            pa.array(n_words, pa.int64()),
            pa.array(n_removed, pa.int64()),
            pa.array(spans, pa.list_(span)),
            pa.array(kept, pa.binary()).cast(pa.string()),
        ]
        names = [*batch.schema.names[2:], "n_words", "n_removed", "removed_spans", "kept_text"]
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], *added], names)


def _spread(id_col: str) -> Column:
    """A join key in place of the id: rows without one are spread, as all nulls would meet in one task."""
    return F.coalesce(F.col(id_col).cast("long"), F.monotonically_increasing_id())


def _same(id_col: str, key: str, found: str) -> Column:
    return (F.col(key) == F.col(found)) & F.col(id_col).isNotNull()


def cut_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = WINDOW_WORDS
) -> DataFrame:
    """(id, n_words, n_removed, removed_spans, kept_text) for each row.

    Words are runs of bytes that are not ASCII white space, unchanged. A word goes if a window
    over it also starts in a row with a smaller id; this is judged on the input. removed_spans
    are maximal intervals of word numbers, both ends included; kept_text holds the other words
    joined by one space (null for a null text). Rows that repeat an id don't count as smaller
    ones, so they keep each other's windows. Rows without an id neither lose words nor make
    others lose any. Other columns don't matter. Windows are told apart by 64-bit hashes.
    """
    found = repeated_windows(docs, id_col, text_col, length)
    texts = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    found = found.withColumnRenamed("row", "_found")
    joined = texts.withColumn("_key", _spread("row")).join(found, _same("row", "_key", "_found"), "left")
    joined = joined.select("text", "hashes", "row")
    ddl = "row long, n_words long, n_removed long, removed_spans array<struct<first:long,last:long>>, kept_text string"
    return joined.mapInArrow(partial(_cut, length=length), ddl).withColumnRenamed("row", id_col)


def with_cut_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeats cut out of the texts; texts without any stay as they are, and so do all other columns."""
    names = docs.columns
    at = names.index(text_col)
    own = "_" * (1 + max(map(len, names)))  # longer than any name, so another one
    found = repeated_windows(docs, id_col, text_col).select(
        F.col("row").alias(f"{own}row"), F.col("hashes").alias(f"{own}hashes")
    )
    keyed = docs.withColumn(f"{own}key", _spread(id_col))
    joined = keyed.join(found, _same(id_col, f"{own}key", f"{own}row"), "left")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _cut(batches, WINDOW_WORDS):  # the columns of docs, then the four results
            columns = list(out.columns)
            removed, kept = columns[-3], columns[-1]
            columns[at] = pc.if_else(pc.greater(removed, 0), kept, columns[at])
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names)

    rows = joined.select(F.col(text_col).alias(f"{own}text"), f"{own}hashes", *names)
    return rows.mapInArrow(cut, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
