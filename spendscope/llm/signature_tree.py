"""N-gram Jaccard join: which texts share at least a given part of their word shingles.

1. Each text becomes a class key, a hash of its set of shingles; equal sets are one class.
2. Shingles meet by hash; only those of two or more classes can be in an intersection. What meets
   is one entry for each part of a task that has the shingle, with the number of classes there, so
   one that a third of all texts hold fills no task; the answers, how many classes have it in
   all, go back to the parts. A class with fewer shared shingles than the threshold needs links
   with nothing and leaves here.
3. The rest is split into blocks by its rarest shared shingles: linked classes have one of
   them in common (prefix filter), so they meet in the block that this shingle leads to.
4. In each block a signature tree finds the linked pairs. Its nodes hold the OR of their
   sets' bitmaps and the range of their sizes; two trees are walked together, and pairs of
   nodes whose largest possible overlap is too small are left, as are nodes of one component.
   What is left is counted exactly.
5. Links become components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm.components import components
from spendscope.llm.textwords import (
    by_bucket,
    from_small_index,
    mixed,
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
from spendscope.session import cut_lineage

SHINGLE_WORDS = 5
# Links need NUMERATOR * union <= DENOMINATOR * intersection.
NUMERATOR, DENOMINATOR = 3, 4
# Shingles that one task gathers before it hands them on.
FLUSH_ROWS = 1 << 19
# Sizes are those of sets of 64-bit hashes. Members of two sets are compared by 48 of these bits:
# enough between two texts, and what goes through the shuffle is a third smaller.
DROPPED_BITS = 16
# Bytes of text whose shingles are compared at once, and those that a task compares one after the other.
BUCKET_BYTES = 8 << 20
TASK_BYTES = 16 << 20
# Classes whose sets are compared in one task; larger blocks are cut into pairs of such parts.
BLOCK_CLASSES = 4096
FANOUT = 8
FRONTIER = 1 << 14


def _sets(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Ids of some texts and their sorted distinct shingle hashes."""
    for part in text_slices(batches):
        starts, ends, bounds = word_spans(part)
        hashes = word_hashes(part, starts, ends, lower=True)
        windows = rolling_hashes(hashes, words)
        first, owner = window_owners(bounds, words)
        cuts = np.searchsorted(owner, np.arange(len(part.ids) + 1))
        found = []
        for k in range(len(part.ids)):
            if bounds[k + 1] - bounds[k] >= words:
                found.append(np.unique(windows[first[cuts[k] : cuts[k + 1]]]))
            else:  # the whole sequence is the one shingle; no words, no shingle
                short = hashes[bounds[k] : bounds[k + 1]]
                found.append(rolling_hashes(short, len(short)) if len(short) else short)
        yield part.ids, found


def _class_key(shingles: np.ndarray) -> int:
    total = np.add.reduce(mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)))
    return int(mixed(np.array([total + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def _classes(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for ids, sets in _sets(batches, words):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_class_key(s) if len(s) else None for s in sets], pa.int64()),
            ],
            ["row", "n_shingles", "class_key"],
        )


# A flush is what one task gathers between two hand-overs; its classes have local numbers. Rows are
# of three kinds: shingles of a flush for a bucket (what a shingle's local class is, or the number
# of classes for "several", with their count), answers to a flush (counts of all flushes in place
# of its own), and what a flush keeps for itself: its class table, and the classes of the shingles that
# several of them hold. The latter pass the first shuffle in buckets behind the others.
_SHARD = "bucket int, flush long, n_classes long, keys binary, sizes binary, owner binary, shingles binary, counts binary"


def _distinct(shingles: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, owner) in order, and where each shingle begins (and the end)."""
    order = np.lexsort((owner, shingles))
    shingles, owner = shingles[order], owner[order]
    change = np.r_[True, shingles[1:] != shingles[:-1]]
    new = change | np.r_[True, owner[1:] != owner[:-1]]
    shingles, owner = shingles[new], owner[new]
    return shingles, owner, np.r_[np.flatnonzero(change[new]), len(shingles)]


def _shards(batches: Iterable[pa.RecordBatch], words: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Shingles by bucket, packed: one entry for each flush that has a shingle, however many classes there."""
    number = TaskContext.get().partitionId() << 32

    def packed() -> pa.RecordBatch:
        n = len(sets)
        owner = np.repeat(np.arange(n), [len(s) for s in sets])
        shingles, owner, first = _distinct(np.concatenate(sets) >> np.uint64(DROPPED_BITS), owner)
        counts = np.diff(first)
        several = counts > 1
        local = np.where(several, n, owner[first[:-1]])
        shingles_once = shingles[first[:-1]]
        base = {"flush": number, "n_classes": n}
        rows = []
        for bucket, at in by_bucket(shingles_once, buckets):
            marked = counts[at][several[at]]
            rows.append(
                base
                | {
                    "bucket": bucket,
                    "owner": small_index(local[at], n + 1),
                    "shingles": planes(shingles_once[at] // np.uint64(buckets)),  # the bucket is the remainder
                    "counts": marked.astype(np.uint32).tobytes(),
                }
            )
        rows.append(
            base
            | {
                "bucket": buckets + int(mixed(np.array([number], np.uint64))[0] % np.uint64(buckets)),
                "keys": np.array(list(held), np.int64).tobytes(),
                "sizes": np.array([len(s) for s in sets], np.int32).tobytes(),
                "owner": small_index(owner[np.repeat(several, counts)], n),
                "shingles": planes(shingles_once[several]),
                "counts": counts[several].astype(np.uint32).tobytes(),
            }
        )
        return pa.RecordBatch.from_pylist(rows, _schema(_SHARD))

    held: dict[int, None] = {}
    sets: list[np.ndarray] = []
    rows = 0
    for _, found in _sets(batches, words):
        for shingles in found:
            if len(shingles) and (key := _class_key(shingles)) not in held:
                held[key] = None
                sets.append(shingles)
                rows += len(shingles)
        if rows >= FLUSH_ROWS:
            yield packed()
            number, held, sets, rows = number + 1, {}, [], 0
    if sets:
        yield packed()


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _shared(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each bucket the shingles that several classes have, as answers to the flushes."""
    for (bucket,), table in sorted_groups(batches):
        if bucket >= buckets:
            yield from table.to_batches()
            continue
        rows = table.to_pylist()
        locals_, values, counts = [], [], []
        for row in rows:
            local = from_small_index(row["owner"], row["n_classes"] + 1).astype(np.uint32)
            count = np.ones(len(local), np.uint32)
            count[local == row["n_classes"]] = np.frombuffer(row["counts"], np.uint32)
            locals_.append(local)
            counts.append(count)
            values.append(unplanes(row["shingles"]) * np.uint64(buckets) + np.uint64(bucket))
        source = np.repeat(np.arange(len(rows), dtype=np.uint32), [len(v) for v in values])
        local, value, count = map(np.concatenate, (locals_, values, counts))
        order = np.argsort(value, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(value[order]) != 0])
        total = np.add.reduceat(count[order].astype(np.int64), first)
        spread = np.empty(len(order), np.int64)
        spread[order] = np.repeat(total, np.diff(np.r_[first, len(order)]))
        keep = spread > 1
        local, value, source, spread = local[keep], value[keep], source[keep], spread[keep]
        cuts = np.searchsorted(source, np.arange(len(rows) + 1))
        answers = [
            {
                "bucket": bucket,
                "flush": row["flush"],
                "n_classes": row["n_classes"],
                "owner": small_index(local[lo:hi], row["n_classes"] + 1),
                "shingles": planes(value[lo:hi]),
                # Only the order matters, and that all flushes see the same number.
                "counts": np.minimum(spread[lo:hi], np.iinfo(np.uint16).max).astype(np.uint16).tobytes(),
            }
            for row, lo, hi in zip(rows, cuts[:-1], cuts[1:])
            if hi > lo
        ]
        yield pa.RecordBatch.from_pylist(answers, _schema(_SHARD))


_CANDIDATE = "class_key long, n_shingles long, shingles binary, prefix array<long>"


def _candidates(batches: Iterable[pa.RecordBatch], numerator: int, denominator: int) -> Iterator[pa.RecordBatch]:
    """Classes of a flush with enough shared shingles: these, sorted, and the rarest of them.

    A linked class shares at least ``need`` of ``n`` shingles, so at least one of any n - need + 1.
    The rarest are taken; the shingles of no other class come first and need no row.
    """
    for _, table in sorted_groups(batches):
        rows = table.to_pylist()
        own = next(row for row in rows if row["keys"] is not None)
        keys, sizes, n = np.frombuffer(own["keys"], np.int64), np.frombuffer(own["sizes"], np.int32), own["n_classes"]
        local, value, spread = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]
        for row in rows:
            if row["keys"] is None:
                local.append(from_small_index(row["owner"], n + 1).astype(np.int64))
                value.append(unplanes(row["shingles"]))
                spread.append(np.frombuffer(row["counts"], np.uint16))
        local, value, spread = map(np.concatenate, (local, value, spread))
        # Where several classes of the flush have the shingle, the flush kept which.
        several = local == n
        kept, counts = unplanes(own["shingles"]), np.frombuffer(own["counts"], np.uint32).astype(np.int64)
        at = np.searchsorted(kept, value[several])
        ends = np.cumsum(counts)
        inside, group = _ranges(ends[at] - counts[at], ends[at])
        owner = from_small_index(own["owner"], n).astype(np.int64)
        local = np.concatenate([local[~several], owner[inside]])
        value = np.concatenate([value[~several], value[several][group]])
        spread = np.concatenate([spread[~several], spread[several][group]])
        order = np.lexsort((value, spread, local))
        local, value = local[order], value[order]
        found = []
        cuts = np.searchsorted(local, np.arange(n + 1))
        for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            size, shared = int(sizes[k]), hi - lo
            need = -(-numerator * size // denominator)
            if shared >= need:
                found.append(
                    {
                        "class_key": int(keys[k]),
                        "n_shingles": size,
                        "shingles": np.sort(value[lo:hi]).tobytes(),
                        "prefix": value[lo : lo + shared - need + 1].view(np.int64).tolist(),
                    }
                )
        for at in range(0, len(found), 256):
            yield pa.RecordBatch.from_pylist(found[at : at + 256], _schema(_CANDIDATE))


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in the ranges, and the range of each."""
    sizes = last - first
    owner = np.repeat(np.arange(len(first)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[owner], owner


class SignatureTree:
    """Sets in leaves, in the order of their smallest members, so that like sets are neighbours."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], bits: int):
        # Hashes are spread evenly, so the smallest member is a min-hash.
        order = sorted(range(len(sets)), key=lambda k: (int(sets[k][0]), int(sizes[k]), int(keys[k])))
        self.keys, self.sizes = keys[order], sizes[order]
        self.sets = [sets[k] for k in order]
        shift = np.uint64(64 - DROPPED_BITS - bits.bit_length() + 1)
        marks = np.zeros((len(sets), bits), bool)
        for row, one in zip(marks, self.sets):
            row[one >> shift] = True
        bitmaps = np.packbits(marks, axis=1).view(np.uint64)
        shared = np.array([len(s) for s in self.sets])
        # Two members of one set on one bit hide one possible shared member.
        hidden = shared - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
        self.levels = [(bitmaps, self.sizes, self.sizes, hidden, shared)]
        while len(self.levels[-1][0]) > FANOUT:
            at = np.arange(0, len(self.levels[-1][0]), FANOUT)
            maps, low, high, hid, most = self.levels[-1]
            self.levels.append(
                (
                    np.bitwise_or.reduceat(maps, at, axis=0),
                    np.minimum.reduceat(low, at),
                    np.maximum.reduceat(high, at),
                    np.maximum.reduceat(hid, at),
                    np.maximum.reduceat(most, at),
                )
            )

    def children(self, level: int, node: int) -> range:
        return range(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][0])))


class _Forest:
    """Components of the classes of one block."""

    def __init__(self, keys: Iterable[int]):
        self.parent = {k: k for k in keys}

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _intersection(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def spanning_links(
    left: SignatureTree, right: SignatureTree, numerator: int = NUMERATOR, denominator: int = DENOMINATOR
) -> list[tuple[int, int]]:
    """Linked pairs between two trees (or within one), as far as they join components anew.

    Walks both trees from the top, depth first, with at most FRONTIER pairs of nodes at once.
    """
    forest = _Forest([*left.keys.tolist(), *right.keys.tolist()])
    links: list[tuple[int, int]] = []
    same = left is right
    roots: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    joins = -1

    def component_ranges() -> None:
        """For each level of a tree: the smallest and largest component of each node."""
        for side, tree in ((0, left), (1, right)):
            of = np.array([forest.find(k) for k in tree.keys.tolist()])
            roots[side] = [(of, of)]
            for _ in tree.levels[1:]:
                low, high = roots[side][-1]
                at = np.arange(0, len(low), FANOUT)
                roots[side].append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def worth(la: int, a: np.ndarray, lb: int, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs may hold a link between components, and their largest overlap."""
        maps_a, low_a, high_a, hid_a, most_a = (x[a] for x in left.levels[la])
        maps_b, low_b, high_b, hid_b, most_b = (x[b] for x in right.levels[lb])
        overlap = np.bitwise_count(maps_a & maps_b).sum(axis=1, dtype=np.int64) + np.minimum(hid_a, hid_b)
        overlap = np.minimum(overlap, np.minimum(most_a, most_b))
        (ra, sa), (rb, sb) = roots[0][la], roots[1][lb]
        one = (ra[a] == sa[a]) & (rb[b] == sb[b]) & (ra[a] == rb[b])
        fits = (denominator * high_a >= numerator * low_b) & (denominator * high_b >= numerator * low_a)
        enough = (numerator + denominator) * overlap >= numerator * (low_a + low_b)
        return fits & enough & ~one, overlap

    top_a, top_b = len(left.levels) - 1, len(right.levels) - 1
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(left.levels[-1][0])), np.arange(len(right.levels[-1][0]))))
    if same:
        a, b = a[a <= b], b[a <= b]
    stack = [(top_a, top_b, a, b)]
    while stack:
        la, lb, a, b = stack.pop()
        if len(a) > FRONTIER:
            stack += [(la, lb, a[FRONTIER:], b[FRONTIER:])]
            a, b = a[:FRONTIER], b[:FRONTIER]
        if joins != len(links):
            component_ranges()
            joins = len(links)
        keep, overlap = worth(la, a, lb, b)
        a, b, overlap = a[keep], b[keep], overlap[keep]
        if not len(a):
            continue
        if la or lb:
            down_a, down_b = la >= lb, lb >= la  # the higher tree first, both when level
            new_a, new_b = [], []
            for x, y in zip(a.tolist(), b.tolist()):
                xs = np.array(left.children(la, x) if down_a and la else [x])
                ys = np.array(right.children(lb, y) if down_b and lb else [y])
                new_a.append(np.repeat(xs, len(ys)))
                new_b.append(np.tile(ys, len(xs)))
            a, b = np.concatenate(new_a), np.concatenate(new_b)
            if same:
                a, b = a[a <= b], b[a <= b]
            stack.append((la - (down_a and la > 0), lb - (down_b and lb > 0), a, b))
            continue
        for k in np.argsort(-overlap, kind="stable").tolist():
            x, y = int(a[k]), int(b[k])
            if same and x == y:
                continue
            p, q = int(left.keys[x]), int(right.keys[y])
            if p == q or forest.find(p) == forest.find(q):
                continue
            common = _intersection(left.sets[x], right.sets[y])
            if denominator * common >= numerator * (int(left.sizes[x]) + int(right.sizes[y]) - common):
                forest.join(p, q)
                links.append((p, q))
    return links


def _tree(rows: list[dict], bits: int) -> SignatureTree:
    rows = sorted(rows, key=lambda r: r["class_key"])
    return SignatureTree(
        np.array([r["class_key"] for r in rows], np.int64),
        np.array([r["n_shingles"] for r in rows], np.int64),
        [np.frombuffer(r["shingles"], np.uint64) for r in rows],
        bits,
    )


def _block_links(batches: Iterable[pa.RecordBatch], numerator: int, denominator: int) -> Iterator[pa.RecordBatch]:
    for (_, i, j), table in sorted_groups(batches, keys=3):
        rows = table.select(["part", "class_key", "n_shingles", "shingles"]).to_pylist()
        longest = max(len(r["shingles"]) // 8 for r in rows)
        bits = 1 << min(max((4 * longest).bit_length(), 10), 16)
        left = _tree([r for r in rows if r["part"] == i], bits)
        right = left if i == j else _tree([r for r in rows if r["part"] == j], bits)
        found = spanning_links(left, right, numerator, denominator)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"]
        )


def _blocks(candidates: DataFrame) -> DataFrame:
    """Which classes to compare where: (leader, i, j, part, class_key), narrow.

    The classes with a shingle in their prefixes go to the smallest of them, the leader. A
    leader with many is cut into parts of about BLOCK_CLASSES; each pair of parts is a block.
    """
    entries = candidates.select(F.explode("prefix").alias("shingle"), "class_key")
    leaders = entries.groupBy("shingle").agg(F.min("class_key").alias("leader"), F.count("*").alias("classes"))
    member = entries.join(leaders.where("classes > 1"), "shingle").select("leader", "class_key").distinct()
    parts = member.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK_CLASSES).cast("int").alias("parts"))
    member = member.join(parts, "leader").withColumn("part", F.pmod(F.xxhash64("class_key"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    return member.select("leader", "class_key", "part", other).select(
        "leader", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "class_key"
    )


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    numerator: int = NUMERATOR,
    denominator: int = DENOMINATOR,
) -> DataFrame:
    """(id, n_shingles, component_id) for each row; component_id is the smallest linked id.

    A-Z are lower-cased; words are runs of bytes that are not ASCII white space; a set holds the
    distinct runs of ``words`` words, or the whole sequence of a shorter text. Two rows link when
    denominator * intersection >= numerator * union. A null or wordless text has an empty set and
    links with nothing. Rows that repeat an id are rows of their own. A row without an id keeps
    its n_shingles, has a null component and is linked with nothing. Other columns don't matter.
    Shingles of one text
    are told apart by 64-bit hashes, those of two texts by 48 of their bits.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    known = texts.where("row is not null")
    rows = cut_lineage(
        known.mapInArrow(partial(_classes, words=words), "row long, n_shingles long, class_key long")
    )
    tasks, buckets = task_count(spark, size, TASK_BYTES), task_count(spark, size, BUCKET_BYTES)
    shards = known.mapInArrow(partial(_shards, words=words, buckets=buckets), _SHARD)
    shared = (
        shards.repartition(tasks, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(partial(_shared, buckets=buckets), _SHARD)
        .select("flush", "n_classes", "keys", "sizes", "owner", "shingles", "counts")
    )
    # A class that several flushes met is found by each, with the same shingles.
    candidates = cut_lineage(
        shared.repartition(tasks, "flush")
        .sortWithinPartitions("flush")
        .mapInArrow(partial(_candidates, numerator=numerator, denominator=denominator), _CANDIDATE)
        .dropDuplicates(["class_key"])
    )
    where = ["leader", "i", "j"]
    links = (
        _blocks(candidates)
        .join(candidates.select("class_key", "n_shingles", "shingles"), "class_key")
        .select(*where, "part", "class_key", "n_shingles", "shingles")
        .repartition(tasks, *where)
        .sortWithinPartitions(*where)
        .mapInArrow(partial(_block_links, numerator=numerator, denominator=denominator), "a long, b long")
    )
    found = cut_lineage(components(links))
    first = rows.where("class_key is not null").groupBy("class_key").agg(F.min("row").alias("first"))
    rooted = first.join(found, first["class_key"] == found["node"], "left").select(
        "class_key", "first", F.coalesce("root", "class_key").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("class_key", "component_id")
    # Texts without words have no class: as join keys, their nulls would all meet in one task.
    alone = rows.where("class_key is null").withColumn("component_id", F.col("row"))
    result = (
        rows.join(named, "class_key")
        .unionByName(alone)
        .select(F.col("row").alias(id_col), "n_shingles", "component_id")
    )
    unknown = texts.where("row is null").select(F.lit(0).cast("long").alias("row"), "text")
    counted = unknown.mapInArrow(partial(_classes, words=words), "row long, n_shingles long, class_key long")
    none = F.lit(None).cast("long")
    return result.unionAll(counted.select(none.alias(id_col), "n_shingles", none.alias("component_id")))


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component; rows without an id stay."""
    found = jaccard_components(docs, id_col, text_col)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
