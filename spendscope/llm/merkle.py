"""Merkle manifest of a dataset: one tree per group, a tree over their roots, a proof for each row.

1. Each row is a leaf, the hash of its fields. Leaves are dealt by ranges of (group, id), so a
   task holds consecutive leaves, a leaf partition, and packs them into one row.
2. Of each leaf partition the driver sees the number of leaves in its first and last group, and
   thereby where every partition lies in the trees.
3. A partition hashes the nodes that lie in it whole and hands on the topmost of these only. A
   few are left; they are hashed level by level where a node spans partitions.
4. Octopus multiproof: each partition lists the coordinates of the nodes that its leaves need and
   that it cannot compute, fetches each once, derives all interior nodes from them and from its
   leaves, and cuts the proofs of its leaves out of these.

Digests are lower-case hex; a node is the hash of its children's digests, one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 8
# Leaves in a leaf partition, about; the driver holds one row for each.
LEAVES = 1 << 18
OUTPUT_ROWS = 4096
# The tree over the roots of the groups; group trees are numbered in the order of their groups.
TOP = -1
HEX = 64


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(values: Iterable[Column]) -> Column:
    """The digest of a row, in bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


class Run(NamedTuple):
    """Consecutive nodes of one level: digests of the positions from ``start`` to ``stop``, in hex, of ``size``."""

    start: int
    stop: int
    size: int
    digests: bytes

    def part(self, start: int, stop: int) -> bytes:
        return self.digests[(start - self.start) * HEX : (stop - self.start) * HEX]

    def parents(self, start: int, stop: int) -> Run:
        """The nodes above, from ``start`` to ``stop``; all their children must be here."""
        found = (self.part(k * FANOUT, min((k + 1) * FANOUT, self.size)) for k in range(start, stop))
        return Run(start, stop, -(-self.size // FANOUT), b"".join(map(_digest, found)))


def siblings(start: int, stop: int, size: int) -> tuple[range, range]:
    """The positions before and after a run that belong to the groups its ends lie in."""
    return range(start - start % FANOUT, start), range(stop, min(-(-stop // FANOUT) * FANOUT, size))


def missing(start: int, stop: int, size: int) -> Iterator[tuple[int, int]]:
    """Coordinates (level, position) that a run of leaves needs up to the root and cannot compute."""
    level = 0
    while size > 1:
        for side in siblings(start, stop, size):
            yield from ((level, k) for k in side)
        start, stop, size, level = start // FANOUT, -(-stop // FANOUT), -(-size // FANOUT), level + 1


def topmost(leaves: Run) -> Iterator[tuple[int, int, bytes]]:
    """(level, position, digest) of the nodes that lie within a run of leaves while their parents do not."""
    run, level = leaves, 0
    while True:
        first = -(-run.start // FANOUT)
        last = -(-run.stop // FANOUT) if run.stop == run.size else run.stop // FANOUT
        whole = run.size > 1 and last > first
        inside = range(first * FANOUT, last * FANOUT) if whole else range(0)
        for k in range(run.start, run.stop):
            if k not in inside:
                yield level, k, run.part(k, k + 1)
        if not whole:
            return
        run, level = run.parents(first, last), level + 1


def full_levels(leaves: Run, fetched: dict[tuple[int, int], bytes]) -> list[Run]:
    """All levels above a run of leaves, each with the siblings that its nodes need; the last is the root."""
    levels, run = [], leaves
    while run.size > 1:
        before, after = siblings(run.start, run.stop, run.size)
        more = [b"".join(fetched[len(levels), k] for k in side) for side in (before, after)]
        run = Run(run.start - len(before), run.stop + len(after), run.size, more[0] + run.digests + more[1])
        levels.append(run)
        run = run.parents(run.start // FANOUT, -(-run.stop // FANOUT))
    return [*levels, run]


class Path:
    """Proofs from the levels of a tree, for positions in ascending order."""

    def __init__(self, levels: list[Run]):
        self.levels = levels[:-1]
        self.root = levels[-1].digests
        self.known: dict[int, tuple[int, list[tuple[bytes, bytes]]]] = {}

    def steps(self, position: int, level: int = 0) -> list[tuple[bytes, bytes]]:
        """The digests before and after a node in its group, level by level."""
        if level == len(self.levels):
            return []
        if level and self.known.get(level, (None,))[0] == position:
            return self.known[level][1]
        run, group = self.levels[level], position // FANOUT * FANOUT
        here = run.part(group, position), run.part(position + 1, min(group + FANOUT, run.size))
        found = [here, *self.steps(position // FANOUT, level + 1)]
        self.known[level] = position, found
        return found


def folded(leaf: bytes, steps: Iterable[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and the digests beside its path lead to."""
    for before, after in steps:
        leaf = _digest(before + leaf + after)
    return leaf


_PACKED = "part int, groups array<string>, sizes array<long>, ids array<long>, leaves binary, other binary"
_PACKED_FIELDS = pa.schema(
    [
        ("part", pa.int32()),
        ("groups", pa.list_(pa.string())),
        ("sizes", pa.list_(pa.int64())),
        ("ids", pa.list_(pa.int64())),
        ("leaves", pa.binary()),
        ("other", pa.binary()),
    ]
)


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition of sorted (group, id, leaf, other)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    runs = table.column("group").combine_chunks().dictionary_encode(null_encoding="encode")
    codes = runs.indices.to_numpy(zero_copy_only=False)
    cuts = np.r_[0, np.flatnonzero(codes[1:] != codes[:-1]) + 1, len(codes)]
    names = runs.dictionary.to_pylist()
    row = {
        "part": TaskContext.get().partitionId(),
        "groups": [names[k] for k in codes[cuts[:-1]].tolist()],
        "sizes": np.diff(cuts).tolist(),
        "ids": table.column("id").to_pylist(),
        "leaves": b"".join(table.column("leaf").to_pylist()),
        "other": b"".join(table.column("other").to_pylist()),
    }
    yield pa.RecordBatch.from_pylist([row], _PACKED_FIELDS)


class Place(NamedTuple):
    """Where a leaf partition lies: the tree of its first run, the leaves of it before, the sizes of its outer trees."""

    tree: int
    before: int
    first_size: int
    last_size: int


def _places(ends: Sequence) -> tuple[dict[int, Place], int]:
    """Places of the partitions, given their outer runs in order, and the number of trees."""
    found: list[list[int]] = []
    tree, before, group = -1, 0, None
    for p in ends:
        same = bool(found) and p.first == group
        tree = tree if same else tree + 1
        found.append([tree, before if same else 0])
        before = p.last_leaves + (found[-1][1] if p.runs == 1 else 0)
        tree, group = tree + p.runs - 1, p.last
    places, follow, after = {}, None, 0
    for p, (first_tree, start) in zip(reversed(ends), reversed(found)):
        after = (follow.first_leaves + (after if follow.runs == 1 else 0)) if follow and follow.first == p.last else 0
        first = start + p.first_leaves + (after if p.runs == 1 else 0)
        last = first if p.runs == 1 else p.last_leaves + after
        places[p.part] = Place(first_tree, start, first, last)
        follow = p
    return places, tree + 1


def _spans(sizes: list[int], place: Place) -> Iterator[tuple[int, int, int, int]]:
    """(tree, start, stop, size) of the runs of a leaf partition."""
    for k, n in enumerate(sizes):
        start = 0 if k else place.before
        size = place.first_size if not k else place.last_size if k == len(sizes) - 1 else n
        yield place.tree + k, start, start + n, size


def _leaf_runs(row: dict, place: Place, column: str = "leaves") -> Iterator[tuple[int, Run]]:
    data, at = row[column], 0
    for tree, start, stop, size in _spans(row["sizes"], place):
        end = at + (stop - start) * HEX // 2
        yield tree, Run(start, stop, size, data[at:end].hex().encode())
        at = end


_NODE = "tree long, size long, level int, position long, digest string"
_NODE_FIELDS = pa.schema(
    [("tree", pa.int64()), ("size", pa.int64()), ("level", pa.int32()), ("position", pa.int64()), ("digest", pa.string())]
)


def _topmost(batches: Iterable[pa.RecordBatch], places: dict[int, Place]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            found = [
                {"tree": tree, "size": run.size, "level": level, "position": k, "digest": digest.decode()}
                for tree, run in _leaf_runs(row, places[row["part"]])
                for level, k, digest in topmost(run)
            ]
            for at in range(0, len(found), OUTPUT_ROWS):
                yield pa.RecordBatch.from_pylist(found[at : at + OUTPUT_ROWS], _NODE_FIELDS)


_WANTED = "part int, tree long, level int, position long"


def _wanted(batches: Iterable[pa.RecordBatch], places: dict[int, Place], trees: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            place = places[part]
            spans = [*_spans(sizes, place), (TOP, place.tree, place.tree + len(sizes), trees)]
            found = [(tree, level, k) for tree, *run in spans for level, k in missing(*run)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(found), pa.int32()),
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array([x[1] for x in found], pa.int32()),
                    pa.array([x[2] for x in found], pa.int64()),
                ],
                ["part", "tree", "level", "position"],
            )


_PROOF = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_PROOF_FIELDS = pa.schema(
    [("id", pa.int64())]
    + [(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    + [("verified", pa.bool_())]
)


def _proofs(batches: Iterable[pa.RecordBatch], places: dict[int, Place], trees: int) -> Iterator[pa.RecordBatch]:
    for row in (row for batch in batches for row in batch.to_pylist()):
        place = places[row["part"]]
        fetched: dict[int, dict[tuple[int, int], bytes]] = {}
        for node in row["fetched"] or ():
            fetched.setdefault(node["tree"], {})[node["level"], node["position"]] = node["digest"].encode()
        paths, runs = [], list(_leaf_runs(row, place))
        for tree, run in runs:
            paths.append(Path(full_levels(run, fetched.get(tree, {}))))
        roots = Run(place.tree, place.tree + len(runs), trees, b"".join(p.root for p in paths))
        top = Path(full_levels(roots, fetched.get(TOP, {})))
        root = top.root.decode()
        ids, rows = iter(row["ids"]), []
        for path, (tree, run), (_, other) in zip(paths, runs, _leaf_runs(row, place, "other")):
            above = top.steps(tree)
            for k in range(run.start, run.stop):
                steps = [*path.steps(k), *above]
                proof = hashlib.sha256(b"".join(part for step in steps for part in step)).hexdigest()
                found = folded(other.part(k, k + 1), steps).decode()
                rows.append((next(ids), run.part(k, k + 1).decode(), path.root.decode(), root, proof, found, found == root))
                if len(rows) == OUTPUT_ROWS:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows))), schema=_PROOF_FIELDS)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), _PROOF_FIELDS)], schema=_PROOF_FIELDS
            )


def _level_size(level: int) -> Column:
    return F.ceil(F.col("size") / F.lit(FANOUT**level)).cast("long")


def _grown(nodes: DataFrame, highest: int) -> DataFrame:
    """``nodes`` and all nodes above them; every group is here whole, or its parent is."""
    known = cut_lineage(nodes)
    found, above = [known], None
    for level in range(highest):
        here = known.where(F.col("level") == level)
        here = here if above is None else here.unionAll(above)
        groups = here.where(_level_size(level) > 1).groupBy(
            "tree", "size", F.floor(F.col("position") / FANOUT).cast("long").alias("parent")
        )
        children = F.sort_array(F.collect_list(F.struct("position", "digest")))["digest"]
        above = cut_lineage(
            groups.agg(F.sha2(F.array_join(children, "").cast("binary"), 256).alias("digest")).select(
                "tree", "size", F.lit(level + 1).alias("level"), F.col("parent").alias("position"), "digest"
            )
        )
        found.append(above)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def _height(size: int) -> int:
    levels = 0
    while size > 1:
        size, levels = -(-size // FANOUT), levels + 1
    return levels


class Manifest(NamedTuple):
    """The leaf partitions, their places, and the nodes that they have to fetch."""

    packed: DataFrame
    places: dict[int, Place]
    trees: int
    nodes: DataFrame


def manifest(leaves: DataFrame) -> Manifest:
    """Trees over rows (group string, id long, leaf binary, other binary).

    ``nodes`` has (tree, size, level, position, digest) of all nodes that more than one leaf
    partition needs: those that span partitions and their children. Rows that are equal in all
    columns have one leaf each; so has a row without an id or group (nulls come first).
    """
    spark = leaves.sparkSession
    kept = cut_lineage(leaves.select("group", "id", "leaf", "other"))
    n = kept.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAVES))
    # Rows that are equal otherwise may be parted by their number: a range has no hot key.
    order = ["group", "id", "leaf", "other", "_number"]
    sorted_rows = (
        kept.withColumn("_number", F.monotonically_increasing_id())
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
    )
    packed = cut_lineage(sorted_rows.select("group", "id", "leaf", "other").mapInArrow(_pack, _PACKED))
    ends = packed.select(
        "part",
        F.size("sizes").alias("runs"),
        F.col("groups")[0].alias("first"),
        F.element_at("groups", -1).alias("last"),
        F.col("sizes")[0].alias("first_leaves"),
        F.element_at("sizes", -1).alias("last_leaves"),
    )
    places, trees = _places(sorted(ends.collect(), key=lambda p: p.part))
    spanning = max((max(p.first_size, p.last_size) for p in places.values()), default=0)
    lower = _grown(packed.mapInArrow(partial(_topmost, places=places), _NODE), _height(spanning))
    roots = lower.where(F.expr(f"level = CASE WHEN size = 1 THEN 0 ELSE {_height_sql()} END")).select(
        F.lit(TOP).cast("long").alias("tree"),
        F.lit(trees).cast("long").alias("size"),
        F.lit(0).alias("level"),
        F.col("tree").alias("position"),
        "digest",
    )
    return Manifest(packed, places, trees, lower.unionAll(_grown(roots, _height(trees))))


def _height_sql() -> str:
    """Levels above the leaves of a tree of ``size`` leaves; a long has at most 21 steps of eight."""
    steps = " ".join(f"WHEN size <= {FANOUT**k} THEN {k}" for k in range(1, 21))
    return f"CASE {steps} ELSE 21 END"


def row_proofs(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fields: Sequence[str] = FIELDS,
    changed: dict[str, Column] | None = None,
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row.

    A leaf hashes ``fields``: ``-`` for null, else the number of bytes, a colon and the value.
    Leaves of a group ascend by id, nulls first; rows with equal ids by their digests. Every
    eight nodes (the last of a level: fewer) have a parent, up to the group's subroot; subroots,
    in the order of their groups (null first), likewise lead to the root. ``proof_sha256`` hashes
    the digests beside the row's path from leaf to root; ``folded_root`` is what these give with
    the row as it is after ``changed`` (field to new value), and ``verified`` tells whether it is
    the root. A single row is its own root. No rows, no result. Ids are whole numbers; other
    columns don't matter, whatever their names.
    """
    changed = changed or {}
    now = [F.col(c) for c in fields]
    later = [changed.get(c, F.col(c)) for c in fields]
    leaves = docs.select(
        F.col(group_col).cast("string").alias("group"),
        F.col(id_col).cast("long").alias("id"),
        row_digest(now).alias("leaf"),
        row_digest(later).alias("other"),
    )
    return proofs(manifest(leaves)).withColumnRenamed("id", id_col)


def proofs(of: Manifest) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for each leaf of a manifest."""
    at = ["tree", "level", "position"]
    wanted = of.packed.select("part", "sizes").mapInArrow(
        partial(_wanted, places=of.places, trees=of.trees), _WANTED
    )
    fetched = (
        wanted.join(of.nodes.drop("size"), at)
        .groupBy("part")
        .agg(F.collect_list(F.struct(*at, "digest")).alias("fetched"))
    )
    whole = of.packed.drop("groups").join(fetched, "part", "left")
    return whole.mapInArrow(partial(_proofs, places=of.places, trees=of.trees), _PROOF)


def tampered(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """What row_proofs takes as changed: every third row, by the CRC of its id, has its A-Z lower-cased."""
    chosen = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {text_col: F.when(chosen, lower).otherwise(F.col(text_col))}
