"""Exact top-k search by BM25: an inverted index in shards, block-max pruning, an exact merge.

A shard is the index of some thousand consecutive documents. Statistics are those of all
documents, so scores of different shards compare. Per shard and query:

1. The lists of terms that a large part of the shard holds are kept by document; their sum is
   one matrix product for many queries. Lists of rare terms are shorter than their block maxima
   would be; their postings are added for the same queries in one pass.
2. Terms in between have postings and, for each block of documents, the largest score in it. The
   bound of a block is its largest sum from step 1 and the largest scores of these terms, by
   another matrix product.
3. Blocks whose bound is below the k-th best score so far are left out; none of their documents
   can be among the best k. For the others the postings of the terms in between are added.
4. All this is in single precision. Documents whose sum, with what it may be off, can be among the
   best k are scored again from their counts, in double precision; these scores are the result.

A task has a block of queries and reads the shards one after the other from reliable storage.
It keeps the best of each query, whose last score is where the next shard's pruning begins, and
hands on the best of all shards. So neither what is shuffled nor the rows grow with the shards.
The work still grows with documents times queries.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendscope.llm.textwords import (
    Slice,
    from_small_index,
    small_index,
    sorted_groups,
    text_slices,
    word_hashes,
    word_spans,
)
from spendscope.session import cut_lineage, few_at_once

K1, B = 1.2, 0.75
TOP = 10
# Scores are equal when they are at this many digits; the smaller id is then the better one.
DIGITS = 6
SHARD_DOCS = 1 << 13
SHARD_POSTINGS = 1 << 20
BLOCK = 8
# Terms that at least this part of a shard's documents hold are kept by document.
FREQUENT = 1 / 16
# Others that at least this part of them hold have the largest score of each block.
MIDDLE = 1 / 32
# Terms with fewer postings are rare in any shard.
LEAST_POSTINGS = 32
# Numbers by document, and by block, at most; then fewer terms are frequent, or middle.
DOC_CELLS, BLOCK_CELLS = 1 << 23, 1 << 22
# Below this part of the blocks, their postings are looked up one by one.
FEW_BLOCKS = 1 / 16
NUMBERS_AT_ONCE = 1 << 15
QUERIES_AT_ONCE = 256
# Queries of a task; fewer if cores would be idle, but each task reads the whole index.
TASK_QUERIES = 1 << 13
LEAST_QUERIES = 1 << 8
# Shards that a task gets at a time; one at least.
PAIR_BYTES = 1 << 23
_MARGIN = 2 * 10.0**-DIGITS
# Which 32-bit half of a 64-bit number is the low one.
_LOW = int(sys.byteorder == "big")


def _term_counts(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, term), their counts, and the number of words of each document."""
    starts, ends, bounds = word_spans(part)
    terms = word_hashes(part, starts, ends, lower=True)
    owner = np.repeat(np.arange(len(part.ids)), np.diff(bounds))
    # By terms, then by documents, whose numbers are sorted faster in 16 bits.
    order = np.argsort(terms)
    order = order[np.argsort(owner[order].astype(np.uint16 if len(part.ids) <= 1 << 16 else np.int64), kind="stable")]
    terms, owner = terms[order], owner[order]
    new = np.r_[True, (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])] if len(terms) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return owner[at], terms[at], np.diff(np.r_[at, len(terms)]), np.diff(bounds)


_SHARD_COLUMNS = (
    [("shard", "long"), ("most", "long")]
    + [(c, "binary") for c in ("docs", "lengths", "terms", "firsts", "postings", "counts")]
)
_SHARD = ", ".join(f"{c} {kind}" for c, kind in _SHARD_COLUMNS)
_SHARD_FIELDS = pa.schema([(c, pa.binary() if kind == "binary" else pa.int64()) for c, kind in _SHARD_COLUMNS])


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    docs = postings = 0

    def closed() -> pa.RecordBatch:
        ids, owner, terms, counts, lengths = (np.concatenate(column) for column in zip(*held))
        held.clear()  # in memory once
        order = np.argsort(terms, kind="stable")  # documents are in order already
        terms, owner, counts = terms[order], owner[order], counts[order]
        at = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
        row = {
            "shard": number,
            "docs": ids.astype(np.int64).tobytes(),
            "lengths": lengths.astype(np.int64).tobytes(),
            "terms": terms[at].tobytes(),
            "firsts": np.r_[at, len(terms)].astype(np.int64).tobytes(),
            "postings": small_index(owner, len(ids)),
            "most": int(counts.max(initial=0)),
            "counts": small_index(counts, int(counts.max(initial=0)) + 1),
        }
        return pa.RecordBatch.from_pylist([row], _SHARD_FIELDS)

    for part in text_slices(batches):
        owner, terms, counts, lengths = _term_counts(part)
        held.append((part.ids, (owner + docs).astype(np.int32), terms, counts.astype(np.int32), lengths))
        docs, postings = docs + len(part.ids), postings + len(terms)
        if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
            yield closed()
            number, held, docs, postings = number + 1, [], 0, 0
    if held:
        yield closed()


def _shard_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            terms = np.frombuffer(row["terms"], np.int64)
            found = np.diff(np.frombuffer(row["firsts"], np.int64))
            for at in range(0, len(terms), 1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms[at : at + (1 << 16)]), pa.array(found[at : at + (1 << 16)])], ["term", "docs"]
                )


def _query_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        owner, terms, _, _ = _term_counts(part)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.ids[owner], pa.int64()), pa.array(terms.view(np.int64))], ["query", "term"]
        )


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in the ranges, and the range of each."""
    sizes = last - first
    owner = np.repeat(np.arange(len(first)), sizes)
    return np.arange(len(owner)) + (first - np.cumsum(sizes) + sizes)[owner], owner


def _cuts(ends: np.ndarray) -> list[tuple[int, int]]:
    """Ranges with these ends, one behind the other, in groups of about NUMBERS_AT_ONCE numbers."""
    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, NUMBERS_AT_ONCE)))
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(ends)]))


def _parts_of_ranges(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All numbers in the ranges, and the range of each, in parts of whole ranges."""
    for a, b in _cuts(np.cumsum(last - first)):
        at, owner = _ranges(first[a:b], last[a:b])
        yield at, owner + a


class Shard:
    """The index of one shard, with scores in place of counts (but for the terms' weights).

    ``row_of``: the rows of frequent terms in ``by_doc``, of middle ones in ``block_best`` (after
    the frequent ones), -1 of others. Documents are at places of their own, so that those of one
    block are ``blocks`` apart; at some places there is none. ``packed`` has the place of each
    posting above 32 bits of its score, so that both are read at once.
    """

    def __init__(self, row: dict, mean_length: float):
        docs = np.frombuffer(row["docs"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.firsts = np.frombuffer(row["firsts"], np.int64)
        self.counts = from_small_index(row["counts"], row["most"] + 1)
        n = len(docs)
        self.blocks = -(-n // BLOCK)
        self.width = self.blocks * BLOCK
        place = np.arange(self.width).reshape(BLOCK, self.blocks).T.ravel()[:n]
        self.docs, self.norm = np.full(self.width, -1), np.ones(self.width)
        self.docs[place] = docs
        self.norm[place] = K1 * (1 - B + B * np.frombuffer(row["lengths"], np.int64) / mean_length)
        held = from_small_index(row["postings"], n)
        places = place[held]
        scores = self.counts.astype(np.float32)
        norm = self.norm.astype(np.float32)[places]
        norm += scores
        scores *= K1 + 1
        scores /= norm
        self.packed = places << 32
        self.packed |= scores.view(np.uint32)
        sizes = np.diff(self.firsts)
        often = np.flatnonzero(sizes >= max(MIDDLE * n, LEAST_POSTINGS))
        often = often[np.argsort(-sizes[often], kind="stable")]
        frequent = min(int((sizes[often] >= FREQUENT * n).sum()), DOC_CELLS // max(self.width, 1))
        middle = often[frequent : frequent + BLOCK_CELLS // max(self.blocks, 1)]
        often = often[: frequent + len(middle)]
        self.frequent = frequent
        self.row_of = np.full(len(self.terms), -1)
        self.row_of[often] = np.arange(len(often))
        self.by_doc = np.zeros((frequent, self.width), np.float32)
        self.count_by_doc = np.zeros((frequent, self.width), self.counts.dtype)
        for k, t in enumerate(often[:frequent].tolist()):
            at = slice(self.firsts[t], self.firsts[t + 1])
            self.by_doc[k, places[at]] = scores[at]
            self.count_by_doc[k, places[at]] = self.counts[at]
        # For each middle term and block, where its postings begin, and the largest score.
        at, owner = _ranges(self.firsts[middle], self.firsts[middle + 1])
        cell = owner * self.blocks + held[at] // BLOCK
        found = np.bincount(cell, minlength=len(middle) * self.blocks).reshape(len(middle), self.blocks)
        self.block_first = np.zeros((len(middle), self.blocks + 1), np.int32)
        np.cumsum(found, axis=1, out=self.block_first[:, 1:])
        self.block_first += self.firsts[middle, None].astype(np.int32)
        self.block_best = np.zeros((len(middle), self.blocks), np.float32)
        if len(cell):
            new = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            self.block_best.ravel()[cell[new]] = np.maximum.reduceat(scores[at], new)
        self._found: tuple[np.ndarray, np.ndarray] | None = None

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Where the shard has the terms, -1 for those it has not; looked for once if they are the same array again."""
        if self._found is None or self._found[0] is not terms:
            at = np.searchsorted(self.terms, terms)
            at[at == len(self.terms)] = 0
            if len(self.terms):
                at[self.terms[at] != terms] = -1
            else:
                at[:] = -1
            self._found = terms, at
        return self._found[1]

    def add(self, sums: np.ndarray, query: np.ndarray, first: np.ndarray, last: np.ndarray, weight: np.ndarray) -> None:
        """Add postings from ``first`` to ``last`` to the sums of their queries and documents."""
        start, weight, sizes = query * self.width, weight.astype(np.float32), last - first
        ends = np.cumsum(sizes)
        shift = first - ends + sizes
        for a, b in _cuts(ends):
            some = sizes[a:b]
            at = np.repeat(shift[a:b], some)
            at += np.arange(ends[a] - sizes[a], ends[b - 1])
            cells = self.packed.take(at)
            scores = cells.view(np.float32)[_LOW::2] * np.repeat(weight[a:b], some)
            cells >>= 32
            cells += np.repeat(start[a:b], some)
            np.add.at(sums.ravel(), cells, scores)

    def exact(self, seen: np.ndarray, here: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The scores of the documents at some places, in order, for the terms ``here``, in double precision."""
        row = self.row_of[here]
        often = (row >= 0) & (row < self.frequent)
        counts = self.count_by_doc[row[often, None], seen].astype(float)
        scores = weight[often] @ (counts * (K1 + 1) / (counts + self.norm[seen]))
        here, weight = here[~often], weight[~often]
        first, last = self.firsts[here], self.firsts[here + 1]
        ends = np.cumsum(last - first)
        at = np.repeat(first - ends + last - first, last - first)
        at += np.arange(len(at))
        asked = np.zeros(self.width, bool)
        asked[seen] = True
        place = self.packed.take(at)
        place >>= 32
        held = np.flatnonzero(asked.take(place))
        number, counts = np.searchsorted(seen, place[held]), self.counts[at[held]].astype(float)
        parts = weight[np.searchsorted(ends, held, side="right")] * (counts * (K1 + 1) / (counts + self.norm[seen][number]))
        return scores + np.bincount(number, parts, minlength=len(seen))


def best_of(ids: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Positions of the best scores that are not zero, best first."""
    scores = np.round(scores, DIGITS)
    order = np.lexsort((ids, -scores))[:top]
    return order[scores[order] > 0]


class Asked:
    """Some queries (terms, weights) as one list of their terms, in the order of unsigned numbers.

    ``terms``: distinct terms in the order of unsigned numbers, with those of the queries among
    them; the same array for all queries of a task.
    """

    def __init__(self, queries: list[tuple[np.ndarray, np.ndarray]], terms: np.ndarray | None = None):
        self.queries = len(queries)
        self.terms = distinct_terms(queries) if terms is None else terms
        sizes = [len(terms) for terms, _ in queries]
        self.most = max(sizes, default=0)
        term = np.searchsorted(self.terms, np.concatenate([terms for terms, _ in queries]).view(np.uint64)).astype(np.int32)
        order = np.argsort(term, kind="stable")
        self.term = term[order]
        self.query = np.repeat(np.arange(len(queries), dtype=np.int32), sizes)[order]
        self.weights = np.concatenate([weights for _, weights in queries])[order]
        # The pairs of query k end at ends[k] in by_query.
        self.ends = np.cumsum(sizes)
        self.by_query = np.argsort(self.query, kind="stable").astype(np.int32)


def distinct_terms(queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.unique(np.concatenate([terms for terms, _ in queries] or [np.zeros(0, np.int64)]).view(np.uint64))


def _off(asked: Asked) -> float:
    """By what part of itself a sum in single precision may be off, of a query's terms, none of them below zero."""
    return (asked.most + 16) * 2.0**-23


def sums_of(shard: Shard, asked: Asked, limits: np.ndarray) -> np.ndarray:
    """The score of each document for each query, about; too low a number for some that are below the query's limit."""
    here = shard.find(asked.terms)[asked.term]
    found = np.flatnonzero(here >= 0)
    here = here[found]
    query, weight, row = asked.query[found].astype(np.int64), asked.weights[found], shard.row_of[here]
    first, last = shard.firsts[here], shard.firsts[here + 1]
    frequent, middle, rare = (np.flatnonzero(x) for x in ((row >= 0) & (row < shard.frequent), row >= shard.frequent, row < 0))
    weights = np.zeros((asked.queries, shard.frequent), np.float32)
    weights[query[frequent], row[frequent]] = weight[frequent]
    sums = weights @ shard.by_doc
    shard.add(sums, query[rare], first[rare], last[rare], weight[rare])
    weights = np.zeros((asked.queries, len(shard.block_best)), np.float32)
    row = row - shard.frequent
    weights[query[middle], row[middle]] = weight[middle]
    bound = weights @ shard.block_best
    bound += sums.reshape(asked.queries, BLOCK, shard.blocks).max(axis=1)
    left = bound >= ((limits - _MARGIN) * (1 - 2 * _off(asked)))[:, None]
    # Of queries with few blocks left, the postings of these blocks; of others, the lists.
    few = left.mean(axis=1) < FEW_BLOCKS
    whole, some = middle[~few[query[middle]]], middle[few[query[middle]]]
    shard.add(sums, query[whole], first[whole], last[whole], weight[whole])
    _, blocks = np.nonzero(left & few[:, None])
    ends = np.cumsum(np.where(few, left.sum(axis=1), 0))
    begins = np.r_[0, ends[:-1]]
    for at, owner in _parts_of_ranges(begins[query[some]], ends[query[some]]):
        term, block = row[some][owner], blocks[at]
        first, last = shard.block_first[term, block], shard.block_first[term, block + 1]
        held = np.flatnonzero(last > first)
        pair = some[owner[held]]
        shard.add(sums, query[pair], first[held].astype(np.int64), last[held].astype(np.int64), weight[pair])
    return sums


def search(shard: Shard, asked: Asked, top: int, limits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the best documents of a shard for each query that has some.

    ``limits``: documents whose scores are below these may be left out.
    """
    sums = sums_of(shard, asked, limits)
    less = 1 - 2 * _off(asked)
    least = np.maximum(limits - _MARGIN, 10.0**-DIGITS / 4) * less
    here = shard.find(asked.terms)
    for k in np.flatnonzero(sums.max(axis=1, initial=0) >= least).tolist():
        seen = np.flatnonzero(sums[k] >= least[k])
        if len(seen) > top:
            about = sums[k, seen].astype(float)
            seen = seen[about >= (np.partition(about, len(seen) - top)[len(seen) - top] * less - _MARGIN) * less]
        pairs = asked.by_query[asked.ends[k - 1] if k else 0 : asked.ends[k]]
        terms, weights = here[asked.term[pairs]], asked.weights[pairs]
        scores = shard.exact(seen, terms[terms >= 0], weights[terms >= 0])
        best = best_of(shard.docs[seen], scores, top)
        if len(best):
            yield k, shard.docs[seen[best]], np.round(scores[best], DIGITS)


class _Best:
    """The best documents of some queries (terms, weights) in the shards so far."""

    def __init__(self, names: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray]], top: int):
        self.names, self.top = names, top
        terms = distinct_terms(queries)
        self.asked = [Asked(queries[at : at + QUERIES_AT_ONCE], terms) for at in range(0, len(queries), QUERIES_AT_ONCE)]
        self.hits = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        self.limits = np.zeros(len(queries))

    def add(self, shard: Shard) -> None:
        for at, asked in enumerate(self.asked):
            at *= QUERIES_AT_ONCE
            for k, ids, scores in search(shard, asked, self.top, self.limits[at : at + asked.queries]):
                k += at
                ids, scores = (np.concatenate(both) for both in zip(self.hits[k], (ids, scores)))
                best = best_of(ids, scores, self.top)
                self.hits[k] = ids[best], scores[best]
                if len(best) == self.top:
                    self.limits[k] = scores[best[-1]]

    def rows(self) -> pa.RecordBatch:
        ids, scores = (np.concatenate(column) for column in zip(*self.hits))
        names = np.repeat(self.names, [len(ids) for ids, _ in self.hits])
        columns = [pa.array(names, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score"])


_HIT = "query long, doc_id long, score double"


def _search(batches: Iterable[pa.RecordBatch], mean_length: float, top: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a shard and a block of queries, shard after shard; the first of a block has its queries."""
    best: dict[int, _Best] = {}
    number = shard = None
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: v[k].as_buffer() if pa.types.is_binary(v.type) else v[k].as_py() for c, v in zip(batch.schema.names, batch.columns)}
            if row["block"] not in best:
                best[row["block"]] = _Best(*_unpacked(row), top)
            if shard is None or row["shard"] != number:
                shard = None  # one at a time in memory
                number, shard = row["shard"], Shard(row, mean_length)
            best[row["block"]].add(shard)
    yield from (b.rows() for b in best.values())


_BLOCK = "block long, queries binary, asked binary, query_terms binary, weights binary"
_BLOCK_FIELDS = pa.schema([("block", pa.int64())] + [(c, pa.binary()) for c in ("queries", "asked", "query_terms", "weights")])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The queries of each block as one row."""
    for (block,), table in sorted_groups(batches):
        table = table.combine_chunks()
        sizes = np.array([len(terms) for terms in table["query_terms"]], np.int64)
        terms, weights = (table[c].combine_chunks().flatten().to_numpy() for c in ("query_terms", "weights"))
        columns = (table["query"].to_numpy(), sizes, terms.astype(np.int64), weights.astype(float))
        yield pa.RecordBatch.from_pylist([dict(zip(_BLOCK_FIELDS.names, (block, *(c.tobytes() for c in columns))))], _BLOCK_FIELDS)


def _unpacked(row: dict) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    sizes = np.frombuffer(row["asked"], np.int64)
    terms, weights = np.frombuffer(row["query_terms"], np.int64), np.frombuffer(row["weights"], float)
    ends = np.cumsum(sizes).tolist()
    terms, weights = terms.copy(), weights.copy()  # not the whole batch, which has a shard
    return np.frombuffer(row["queries"], np.int64).copy(), [(terms[a:b], weights[a:b]) for a, b in zip([0, *ends], ends)]


def _dealt(weighted: DataFrame, tasks: int) -> DataFrame:
    """Blocks of queries, each in a partition of its own."""
    block = F.expr(f"int(pmod(xxhash64(query), {tasks}))")
    dealt = weighted.select(block.alias("block"), "*").repartitionById(tasks, "block")
    return dealt.sortWithinPartitions("block", "query").mapInArrow(_blocks, _BLOCK)


def _pairs(shards: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every pair of a shard and a block, all shards in the task of each block; queries are in its first pair only."""
    numbered = shards.coalesce(1).withColumn("nth", F.monotonically_increasing_id())
    pairs = numbered.hint("shuffle_replicate_nl").crossJoin(blocks)
    once = [F.when(F.col("nth") == 0, F.col(c)).alias(c) for c in _BLOCK_FIELDS.names if c != "block"]
    return pairs.select(*_SHARD_FIELDS.names, "block", *once)


def top_documents(
    docs: DataFrame,
    queries: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_col: str = "query_id",
    query_text_col: str = "text",
    top: int = TOP,
) -> DataFrame:
    """(query_id, rank, doc_id, score): for each query the ``top`` best documents, exactly.

    Terms are words (runs of bytes that are not ASCII white space) with A-Z lower-cased. A score
    is the sum over the query's distinct terms of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf *
    (K1 + 1) / (tf + K1 * (1 - B + B * length / mean length)), at DIGITS digits; equal scores
    are ranked by id. Documents without a common term are no results. Null and empty texts are
    documents without words; a query without words, or an empty table, has no results. Rows
    without an id are left out; documents that repeat an id are documents of their own, queries
    that repeat one are one query of all their words. Other columns don't matter. Terms are told
    apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text")).where("row is not null")
    asked = queries.select(F.col(query_col).cast("long").alias("row"), F.col(query_text_col).alias("text"))
    shards = cut_lineage(texts.mapInArrow(_shards, _SHARD))
    sizes = shards.select("lengths").mapInArrow(_lengths, "docs long, words long")
    n, words = sizes.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    mean_length = max(words / max(n, 1), 1e-9)
    held = shards.select("terms", "firsts").mapInArrow(_shard_terms, "term long, docs long")
    terms = asked.where("row is not null").mapInArrow(_query_terms, "query long, term long").distinct()
    known = held.groupBy("term").agg(F.sum("docs").alias("df"))
    weight = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = (
        terms.join(known, "term")
        .select("query", F.struct("term", weight.alias("weight")).alias("t"))
        .groupBy("query")
        .agg(F.sort_array(F.collect_list("t")).alias("t"))
        .select("query", F.col("t.term").alias("query_terms"), F.col("t.weight").alias("weights"))
    )
    weighted = cut_lineage(weighted)
    if not n:
        return spark.createDataFrame([], "query_id long, rank long, doc_id long, score double")
    asked_for = weighted.count()
    cores = spark.sparkContext.defaultParallelism
    tasks = -(-asked_for // TASK_QUERIES)
    tasks = max(min(-(-tasks // cores) * cores, -(-asked_for // LEAST_QUERIES)), 1)  # as many for each core
    blocks = cut_lineage(_dealt(weighted, tasks))
    with few_at_once(spark, PAIR_BYTES):
        hits = cut_lineage(_pairs(shards, blocks).mapInArrow(partial(_search, mean_length=mean_length, top=top), _HIT))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    ranked = hits.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return ranked.select(F.col("query").alias(query_col), "rank", "doc_id", "score")


def _lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = [np.frombuffer(data, np.int64) for data in batch.column(0).to_pylist()]
        counted = [pa.array([len(x) for x in lengths], pa.int64()), pa.array([int(x.sum()) for x in lengths], pa.int64())]
        yield pa.RecordBatch.from_arrays(counted, ["docs", "words"])
