"""Ranked lexical search: K2-treaps over grids of terms and documents, descended best-first.

A shard is the grid of some thousand documents and the terms they hold; a point is a posting,
its value the term's impact in the document. A K2-treap is the quadtree over the grid in which
each cell that is not empty keeps the largest impact in it. A cell is stored as four bits, which
quadrants have points; its children follow one another, so the place of a child is that of the
first plus the number of bits before its own.

An item's terms are rows of the grid. A state of the search is a range of documents with the cell
that each term's row has there; its bound is the sum of the weights times the cells' maxima.
States with the highest bounds are halved first, all rows together, until no bound beats the k-th
best document found. A task carries its best documents from shard to shard; tasks are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendscope.llm.textwords import (
    Slice,
    from_small_index,
    small_index,
    text_slices,
    word_hashes,
    word_spans,
)
from spendscope.session import cut_lineage

TOP = 10
SHARD_DOCS = 1 << 13
SHARD_POSTINGS = 1 << 21
# Distinct terms of the items that are searched at once; the driver and each task hold these.
BLOCK_TERMS = 1 << 20
# States that are halved at once.
STATES = 64
# Letters, digits and all that is not ASCII.
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[[*b"0123456789", *b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", *b"abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
# Of a cell's bits: how many children come before a quadrant's, or -1 if it is empty.
_BEFORE = np.array([[(m & ((1 << q) - 1)).bit_count() if m >> q & 1 else -1 for q in range(4)] for m in range(16)])


def term_counts(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, term), their occurrences, and the number of terms of each document."""
    starts, ends, bounds = word_spans(part, TERM_BYTES)
    terms = word_hashes(part, starts, ends, lower=True)
    owner = np.repeat(np.arange(len(part.ids)), np.diff(bounds))
    order = np.lexsort((terms, owner))
    terms, owner = terms[order], owner[order]
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], terms[at], np.diff(np.r_[at, len(terms)]), np.diff(bounds)


_SHARD_FIELDS = pa.schema(
    [(c, pa.int64()) for c in ("shard", "n_docs", "n_terms", "most")]
    + [(c, pa.binary()) for c in ("docs", "lengths", "terms", "firsts", "postings", "counts")]
)
_SHARD = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in _SHARD_FIELDS)


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of some thousand documents, by term; documents without terms are left out."""
    number = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    docs = postings = 0

    def closed() -> pa.RecordBatch:
        ids, lengths = np.concatenate([h[0] for h in held]), np.concatenate([h[4] for h in held])
        firsts = np.cumsum([0, *(len(h[0]) for h in held)])[:-1]
        owner = np.concatenate([h[1] + f for h, f in zip(held, firsts)])
        terms, counts = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
        order = np.argsort(ids, kind="stable")
        order = order[lengths[order] > 0]
        column = np.zeros(len(ids), np.int64)
        column[order] = np.arange(len(order))
        owner = column[owner]
        by_term = np.lexsort((owner, terms))
        terms, owner, counts = terms[by_term], owner[by_term], counts[by_term]
        at = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
        most = int(counts.max(initial=0))
        row = {
            "shard": number,
            "n_docs": len(order),
            "n_terms": int(lengths.sum()),
            "most": most,
            "docs": ids[order].astype(np.int64).tobytes(),
            "lengths": lengths[order].astype(np.int64).tobytes(),
            "terms": terms[at].tobytes(),
            "firsts": np.r_[at, len(terms)].astype(np.int64).tobytes(),
            "postings": small_index(owner, len(order)),
            "counts": small_index(counts, most + 1),
        }
        return pa.RecordBatch.from_pylist([row], _SHARD_FIELDS)

    for part in text_slices(batches):
        held.append((part.ids, *term_counts(part)))
        docs, postings = docs + len(part.ids), postings + len(held[-1][1])
        if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
            yield closed()
            number, held, docs, postings = number + 1, [], 0, 0
    if held:
        yield closed()


def _item_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        owner, terms, _, _ = term_counts(part)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.ids[owner], pa.int64()), pa.array(terms.view(np.int64))], ["item", "term"]
        )


class Asked(NamedTuple):
    """Some items: their ids, their sorted distinct terms, and where each item's terms are among these."""

    items: list[int]
    terms: np.ndarray
    of_item: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple[int, list[int]]]) -> Asked:
        own = [np.array(terms, np.int64).view(np.uint64) for _, terms in rows]
        terms = np.unique(np.concatenate(own))
        return Asked([item for item, _ in rows], terms, [np.searchsorted(terms, t) for t in own])


def _blocks(items: DataFrame) -> Iterator[Asked]:
    """Items in blocks of bounded size, one after the other."""
    held, size = [], 0
    for row in items.toLocalIterator():
        held.append((row.item, row.terms))
        size += len(row.terms)
        if size >= BLOCK_TERMS:
            yield Asked.of(held)
            held, size = [], 0
    if held:
        yield Asked.of(held)


def _matching(row: dict, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sorted ``terms`` a shard has, and where in the shard."""
    own = np.frombuffer(row["terms"], np.uint64)
    if not len(own):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
    found = np.flatnonzero(own[at] == terms)
    return found, at[found]


def _document_counts(batches: Iterable[pa.RecordBatch], asked) -> Iterator[pa.RecordBatch]:
    terms = asked.value.terms
    for batch in batches:
        for row in batch.to_pylist():
            found, here = _matching(row, terms)
            sizes = np.diff(np.frombuffer(row["firsts"], np.int64))[here]
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sizes)], ["term", "docs"])


def _spread_bits(x: np.ndarray) -> np.ndarray:
    """Each bit moved to twice its place; numbers below 2**32."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in the ranges, and the range of each."""
    sizes = last - first
    owner = np.repeat(np.arange(len(first)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[owner], owner


class Treap:
    """Quadtree over the points (row, column) of a grid, with the largest value in each cell."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray):
        self.height = max(int(rows.max(initial=1)).bit_length(), int(columns.max(initial=1)).bit_length())
        codes = _spread_bits(rows) << np.uint64(1) | _spread_bits(columns)
        order = np.argsort(codes)
        codes, best = codes[order], values[order]
        levels = [(np.zeros(len(codes), np.int64), np.zeros(len(codes), np.uint8), best)]
        for _ in range(self.height):
            above = codes >> np.uint64(2)
            first = np.flatnonzero(np.r_[True, above[1:] != above[:-1]])
            bits = np.bitwise_or.reduceat(np.uint8(1) << (codes & np.uint64(3)).astype(np.uint8), first)
            best = np.maximum.reduceat(best, first)
            codes = above[first]
            levels.append((first, bits, best))
        levels.reverse()
        ends = np.cumsum([len(best) for _, _, best in levels])
        self.first_child = np.concatenate([first + end for (first, _, _), end in zip(levels, ends)])
        self.bits = np.concatenate([bits for _, bits, _ in levels])
        self.best = np.concatenate([best for _, _, best in levels])

    def children(self, cells: np.ndarray, quadrants: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children in the quadrants, and which cells have one."""
        before = _BEFORE[self.bits[cells], quadrants]
        there = np.flatnonzero(before >= 0)
        return self.first_child[cells[there]] + before[there], there


class Best(NamedTuple):
    """The best documents so far, best first: scores and ids."""

    scores: np.ndarray
    ids: np.ndarray

    def limit(self, top: int) -> tuple[int, int | None]:
        """Documents at or below this score (and from this id on, if equal) are not among the best."""
        return (int(self.scores[-1]), int(self.ids[-1])) if len(self.ids) == top else (0, None)

    def with_more(self, scores: np.ndarray, ids: np.ndarray, top: int) -> Best:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[:top]
        return Best(scores[order], ids[order])


NOTHING = Best(np.zeros(0, np.int64), np.zeros(0, np.int64))


def descend(treap: Treap, docs: np.ndarray, rows: np.ndarray, weights: np.ndarray, best: Best, top: int) -> Best:
    """The best documents of a shard and those before, for the rows of an item's terms.

    ``docs`` are the ids of the columns, in ascending order.
    """
    bounds = np.array([int((weights * int(treap.best[0])).sum())])
    depth, column, first, last = (np.array([x]) for x in (0, 0, 0, len(rows)))
    cells, terms = np.zeros(len(rows), np.int64), np.arange(len(rows))
    while True:
        score, least = best.limit(top)
        alive = bounds > score
        if least is not None:
            alive |= (bounds == score) & (docs[column] < least)
        if not alive.any():
            return best
        live = np.flatnonzero(alive)
        chosen = live
        if len(live) > STATES:
            chosen = live[np.argpartition(-bounds[live], STATES)[:STATES]]
            alive[chosen] = False
            rest = np.flatnonzero(alive)
        else:
            rest = live[:0]
        pairs, state = _ranges(first[chosen], last[chosen])
        cell, term = cells[pairs], terms[pairs]
        shift = treap.height - 1 - depth[chosen]
        quadrant = (rows[term] >> shift[state] & 1) << 1
        left, in_left = treap.children(cell, quadrant)
        right, in_right = treap.children(cell, quadrant + 1)
        cell, owner = np.concatenate([left, right]), np.concatenate([2 * state[in_left], 2 * state[in_right] + 1])
        term = np.concatenate([term[in_left], term[in_right]])
        order = np.argsort(owner, kind="stable")
        cell, owner, term = cell[order], owner[order], term[order]
        # Sums of whole numbers far below 2**53 are exact.
        sums = np.bincount(owner, weights[term] * treap.best[cell], 2 * len(chosen)).astype(np.int64)
        sizes = np.bincount(owner, minlength=2 * len(chosen))
        ends = np.cumsum(sizes)
        half = np.arange(2 * len(chosen))
        start = column[chosen][half >> 1] + ((half & 1) << shift[half >> 1])
        leaf = shift[half >> 1] == 0
        done = np.flatnonzero(leaf & (sums > 0) & (sums >= score))
        if len(done):
            best = best.with_more(sums[done], docs[start[done]], top)
        more = np.flatnonzero(~leaf & (sums > 0) & (sums >= score))
        kept, _ = _ranges(ends[more] - sizes[more], ends[more])
        pending, _ = _ranges(first[rest], last[rest])
        cells, terms = np.concatenate([cells[pending], cell[kept]]), np.concatenate([terms[pending], term[kept]])
        bounds = np.concatenate([bounds[rest], sums[more]])
        depth = np.concatenate([depth[rest], depth[chosen][more >> 1] + 1])
        column = np.concatenate([column[rest], start[more]])
        last = np.cumsum(np.concatenate([last[rest] - first[rest], sizes[more]]))
        first = np.r_[0, last[:-1]]


class Statistics(NamedTuple):
    """Of all documents with terms: their number, their terms, and weights of the asked ones."""

    docs: int
    terms: int
    weights: np.ndarray


def impacts(counts: np.ndarray, lengths: np.ndarray, of: Statistics) -> np.ndarray:
    """What a term's occurrences add to a document's score, before the term's weight."""
    return 1_000_000_000 * counts // (1000 * counts + 8 * (10 + 90 * lengths * of.docs // of.terms))


def term_weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


_HIT = "item long, doc_id long, score long"


def _search(batches: Iterable[pa.RecordBatch], asked, of: Statistics, top: int) -> Iterator[pa.RecordBatch]:
    """The best documents of all shards of a task for each item."""
    block: Asked = asked.value
    best = [NOTHING] * len(block.items)
    for row in (row for batch in batches for row in batch.to_pylist()):
        found, here = _matching(row, block.terms)
        if not len(found):
            continue
        firsts = np.frombuffer(row["firsts"], np.int64)
        # Rows in the order of their number of postings, so that cells hold terms of a kind.
        by_size = np.argsort(np.diff(firsts)[here], kind="stable")
        found, here = found[by_size], here[by_size]
        docs = np.frombuffer(row["docs"], np.int64)
        at, line = _ranges(firsts[here], firsts[here + 1])
        columns = from_small_index(row["postings"], len(docs))[at].astype(np.int64)
        counts = from_small_index(row["counts"], row["most"] + 1)[at].astype(np.int64)
        treap = Treap(line, columns, impacts(counts, np.frombuffer(row["lengths"], np.int64)[columns], of))
        line_of = np.full(len(block.terms), -1)
        line_of[found] = np.arange(len(found))
        for k, terms in enumerate(block.of_item):
            rows = line_of[terms]
            held = rows >= 0
            if held.any():
                best[k] = descend(treap, docs, rows[held], of.weights[terms[held]], best[k], top)
    sizes = [len(b.ids) for b in best]
    columns = [np.repeat(np.array(block.items, np.int64), sizes)]
    columns += [np.concatenate([b.ids for b in best]), np.concatenate([b.scores for b in best])]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings of all terms of all documents, in shards; written to the shared folder."""
    texts = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
    return cut_lineage(texts.where("row is not null").mapInArrow(_shards, _SHARD))


def ranked(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``top`` best documents, exactly.

    Terms are longest runs of letters, digits and non-ASCII characters, with A-Z lower-cased. With N
    documents that have terms, L terms in all, n in one document, df documents that hold a term
    and tf occurrences, a document's score is the sum over the item's distinct terms of
    w * (10**9 * tf // (1000 * tf + 8 * m)), w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 10 +
    90 * n * N // L. Documents with a score of 0 are no results; equal scores rank by ascending
    id. Null and empty texts have no terms; items without any, and items without an id, have no
    results. Rows that repeat an item's id are one item of all their terms; documents that
    repeat an id are documents of their own, and those without one are left out. Other columns
    don't matter. Terms are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    shards = index(docs, id_col, text_col)
    n, length = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    asked_rows = items.select(F.col(item_col).cast("long").alias("row"), F.col(item_text_col).cast("string").alias("text"))
    terms = asked_rows.where("row is not null").mapInArrow(_item_terms, "item long, term long")
    found = []
    for block in _blocks(terms.groupBy("item").agg(F.collect_set("term").alias("terms"))) if n else ():
        asked = spark.sparkContext.broadcast(block)
        counted = shards.select("terms", "firsts").mapInArrow(partial(_document_counts, asked=asked), "term long, docs long")
        weights = np.zeros(len(block.terms), np.int64)
        for row in counted.groupBy("term").agg(F.sum("docs").alias("docs")).toLocalIterator():
            weights[row.term] = term_weight(n, row.docs)
        of = Statistics(n, length, weights)
        found.append(cut_lineage(shards.mapInArrow(partial(_search, asked=asked, of=of, top=top), _HIT)))
    if not found:
        return spark.createDataFrame([], f"{item_col} long, rank int, doc_id long, score long")
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionAll(more)
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    placed = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return placed.select(F.col("item").alias(item_col), "rank", "doc_id", "score")
