"""Near-duplicate vectors by product quantisation.

A coarse quantiser deals unit vectors to inverted lists; what is left of a vector after its
list's centre is coded by the nearest codeword of each subspace. Lists are kept in parts. A vector
is compared with those members of another list whose distances from the border between both
lists, with its own, add up to a possible link, if one of both is within reach of that border.
There, distances to the codes of the members come from the codewords that the codes stand for, by
one matrix product for many vectors (the visitor is not quantised). A pair whose coded distance,
less the coding error of its member, is too large can't be linked; the others are compared
exactly, by cosine in double precision. Linked vectors of two lists are on either side of the
border, no further apart than sqrt(2 - 2 * threshold), so one of them is within half of that of
it: with this reach, the default, no pair is missed.

Equal vectors are one class with a number of copies. A task holds a group of parts and reads all
parts one after the other from reliable storage, so vectors are neither copied to the lists that
they visit nor held for all of these at once. Each pair of parts is compared in one of both
groups. Tasks hand on counts and a spanning set of links, never all pairs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from spendscope.llm.components import components
from spendscope.llm.textwords import mixed, sorted_groups
from spendscope.session import cut_lineage, few_at_once

THRESHOLD = 0.9
# Vectors that the quantisers are fitted to at most, chosen by a hash.
SAMPLE = 16_384
MOST_LISTS = 1024
# Shorter lists have more borders that a pair may be too far from, but make smaller products.
LIST_LENGTH = 1024
LEAST_LISTS = 16
SUBSPACES = 8
CODEWORDS = 256
ROUNDS = 8
# Members of a part at most (about), and bytes of them in double precision.
PART, PART_BYTES = 4096, 4 << 20
# Bytes of the group of parts that a task holds, in double precision; fewer if cores would be idle.
GROUP_BYTES = 32 << 20
# Parts that a task gets at a time; one at least.
PAIR_BYTES = 1 << 22
_VISITORS = 256
# For rounding in coded distances, and in distances from borders.
_MARGIN = 1e-3
_BORDER_MARGIN = 1e-6
# Lists whose centres are nearer than this (squared) visit each other whatever their border.
_SAME_CENTRE = 1e-6


@dataclass(frozen=True)
class Quantiser:
    centres: np.ndarray
    subspaces: list[np.ndarray]
    codebooks: list[np.ndarray]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


def _centres(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means; a centre without vectors keeps its place."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        n = np.bincount(home, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return centres


def fit(sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codewords: int = CODEWORDS) -> Quantiser:
    """Quantisers for unit vectors (rows), the same for the same sample."""
    rng = np.random.default_rng(7)
    centres = _centres(sample, lists, ROUNDS, rng)
    rest = sample - centres[_nearest(sample, centres)]
    spaces = [s for s in np.array_split(np.arange(sample.shape[1]), subspaces) if len(s)]
    return Quantiser(centres, spaces, [_centres(rest[:, s], codewords, ROUNDS, rng) for s in spaces])


def _units(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(float)
    # Scaled first, so that squares neither overflow nor vanish.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(vectors: list[bytes], dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype).reshape(len(vectors), -1)


def _border(x: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How far each vector is from the plane between its list's centre and another one."""
    apart = other - own
    square = apart @ apart
    if square < _SAME_CENTRE:
        return np.zeros(len(x))
    return (other @ other - own @ own - 2 * x @ apart) / (2 * math.sqrt(square))


_ASSIGNED = "key long, size int, copies long, list int, vector binary, codes binary, error double"


def _assign(batches: Iterable[pa.RecordBatch], quantiser: Quantiser, width: int, dtype: str) -> Iterator[pa.RecordBatch]:
    """Rows (key, copies, embedding) with the list, code and coding error of each."""
    centres = quantiser.centres
    norms = (centres**2).sum(1)
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            vectors = part.column("embedding")
            sizes = np.diff(vectors.offsets.to_numpy())
            raw = np.zeros((part.num_rows, width), dtype)
            raw[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
            x = _units(raw)
            home = np.maximum(1 + norms - 2 * x @ centres.T, 0).argmin(1)
            rest = x - centres[home]
            codes = np.stack(
                [_nearest(rest[:, s], book) for s, book in zip(quantiser.subspaces, quantiser.codebooks)], axis=1
            ).astype(np.uint8)
            error = np.linalg.norm(rest - _decoded(quantiser, codes), axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"),
                    pa.array(sizes, pa.int32()),
                    part.column("copies"),
                    pa.array(home, pa.int32()),
                    pa.array([v.tobytes() for v in raw], pa.binary()),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(error, pa.float64()),
                ],
                [field.split()[0] for field in _ASSIGNED.split(", ")],
            )


def _decoded(quantiser: Quantiser, codes: np.ndarray) -> np.ndarray:
    """What the codes stand for, less the centre of the list."""
    found = np.empty((len(codes), quantiser.centres.shape[1]))
    for k, (s, book) in enumerate(zip(quantiser.subspaces, quantiser.codebooks)):
        found[:, s] = book[codes[:, k]]
    return found


_PART_COLUMNS = {"list": "long", "keys": "binary", "sizes": "binary", "copies": "binary", "vectors": "binary", "codes": "binary", "errors": "binary"}
_PART = ", ".join(f"{c} {kind}" for c, kind in _PART_COLUMNS.items())
_PART_FIELDS = pa.schema([(c, pa.binary() if kind == "binary" else pa.int64()) for c, kind in _PART_COLUMNS.items()])


def _parts(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The members of each (list, part) as one row, or as several of ``most`` members."""
    for (at_list, _), table in sorted_groups(batches, keys=2):
        for at in range(0, table.num_rows, most):
            part = table.slice(at, most)
            of = lambda c: part[c].to_numpy()
            row = {
                "list": at_list,
                "keys": of("key").astype(np.int64).tobytes(),
                "sizes": of("size").astype(np.int32).tobytes(),
                "copies": of("copies").astype(np.int64).tobytes(),
                "vectors": b"".join(part["vector"].to_pylist()),
                "codes": b"".join(part["codes"].to_pylist()),
                "errors": of("error").astype(float).tobytes(),
            }
            yield pa.RecordBatch.from_pylist([row], _PART_FIELDS)


# What a group needs of its parts; those that visit are not coded.
_HELD = ["number", "list", "keys", "sizes", "copies", "vectors"]
_GROUP = "group long, visitors array<struct<number long, list long, keys binary, sizes binary, copies binary, vectors binary>>"


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of each group as one row."""
    for (group,), table in sorted_groups(batches):
        held = pa.StructArray.from_arrays([table[c].combine_chunks() for c in _HELD], _HELD)
        visitors = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), visitors], ["group", "visitors"])


class _Members:
    """Vectors of one part of a list."""

    def __init__(self, row: dict, dtype: str):
        self.number, self.list = row["number"], row["list"]
        self.keys, self.copies = (np.frombuffer(row[c], np.int64) for c in ("keys", "copies"))
        self.sizes = np.frombuffer(row["sizes"], np.int32)
        self.unit = _units(np.frombuffer(row["vectors"], dtype).reshape(len(self.keys), -1))


def _lead(one: int, other: int) -> bool:
    """Whether a pair of parts is compared in the group of the first one; if not, in that of the other."""
    low, high = sorted((one, other))
    return bool(int(mixed(mixed(np.array([low], np.uint64)) ^ np.uint64(high))[0]) & 1) == (one == low)


def _component_links(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links from each key to the smallest key of its component, for a matrix of links."""
    largest = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        from_a = np.where(linked, a[:, None], largest).min(axis=0, initial=largest)
        new_b = np.minimum(b, from_a)
        new_a = np.minimum(a, np.where(linked, new_b[None], largest).min(axis=1, initial=largest))
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    for key, root in (*zip(left.tolist(), a.tolist()), *zip(right.tolist(), b.tolist())):
        if key != root:
            yield key, root


_FOUND = "kind int, a long, b long"
_FOUND_NAMES = ["kind", "a", "b"]


def _rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], _FOUND_NAMES)


def _compare(
    batches: Iterable[pa.RecordBatch], quantiser: Quantiser, dtype: str, threshold: float, reach: float
) -> Iterator[pa.RecordBatch]:
    """Pairs of a part and a group of parts: (0, key, number of linked vectors) and (1, key, linked key).

    The first part of a group comes with the group.
    """
    groups: dict[int, list[tuple[_Members, np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k] for c in batch.schema.names}
            if (group := row["group"].as_py()) not in groups:
                groups[group] = [_held(_Members(r, dtype)) for r in row["visitors"].as_py()]
            row = {c: v.as_buffer() if pa.types.is_binary(v.type) else v.as_py() for c, v in row.items() if c != "visitors"}
            visitors = [v for v in groups[group] if v[0].number == row["number"] or _lead(v[0].number, row["number"])]
            if visitors:
                yield from _visited(row, visitors, quantiser, dtype, threshold, reach)
    for group in groups.values():
        for members, _, counts in group:
            linked = np.flatnonzero(counts)
            yield _rows(0, members.keys[linked], counts[linked])


def _held(members: _Members) -> tuple[_Members, np.ndarray, np.ndarray]:
    """A part that visits others, its vectors in single precision with a one behind, and their counts."""
    ones = np.ones((len(members.unit), members.unit.shape[1] + 1), np.float32)
    ones[:, :-1] = members.unit
    return members, ones, np.zeros(len(members.unit), np.int64)


def _products(x: np.ndarray, y: np.ndarray, space: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of ``x`` and ``y`` have a product of at least 0; ``space`` is written over."""
    n = len(x) * len(y)
    product, good = space
    np.matmul(x, y.T, out=product[:n].reshape(len(x), len(y)))
    good[n : n + 8] = False
    np.greater_equal(product[:n], 0, out=good[:n])
    # Few are; eight at a time are looked at.
    eights = good[: n + -n % 8].reshape(-1, 8)
    held = np.flatnonzero(eights.view(np.uint64))
    at, rest = np.nonzero(eights[held])
    return np.divmod(held[at] * 8 + rest, len(y))


def _visited(
    row: dict, visitors: list[tuple[_Members, np.ndarray, np.ndarray]], quantiser: Quantiser, dtype: str, threshold: float, reach: float
) -> Iterator[pa.RecordBatch]:
    """What parts find in one part of a list; counts of the visitors are added to theirs."""
    limit = math.sqrt(max(0.0, 2 - 2 * threshold))
    there = _Members(row, dtype)
    centre = quantiser.centres[there.list]
    codes = np.frombuffer(row["codes"], np.uint8).reshape(len(there.keys), -1)
    coded = centre + _decoded(quantiser, codes)
    furthest = limit + np.frombuffer(row["errors"], float) + _MARGIN
    square = (coded**2).sum(1)
    # A visitor is a unit vector x: |x - coded|^2 <= furthest^2 is x @ coded - (1 + |coded|^2 - furthest^2) / 2 >= 0.
    # The last summand is what single precision may be off.
    off = (furthest**2 - square - 1) / 2 + (coded.shape[1] + 16) * 2.0**-22 * (1 + square)
    coded = np.concatenate([coded, off[:, None]], axis=1).astype(np.float32)
    counts = np.zeros(len(there.keys), np.int64)
    space = np.empty(_VISITORS * len(there.keys) + 8, np.float32), np.empty(_VISITORS * len(there.keys) + 8, bool)
    for here, x, own_counts in visitors:
        own = quantiser.centres[here.list]
        border, theirs = _border(here.unit, own, centre), _border(there.unit, centre, own)
        # Two vectors on either side of a border are at least as far apart as both are from it; the nearest first.
        order, members = np.argsort(border), np.argsort(theirs)
        most = limit + _BORDER_MARGIN
        if here.list == there.list:
            sizes = np.full(len(order), len(members))
        else:
            sizes = np.searchsorted(theirs[members], most - border[order], side="right")
        near = coded[members[: sizes[0]]]
        for at in range(0, np.count_nonzero(sizes), _VISITORS):
            some, size = order[at : at + _VISITORS], int(sizes[at])
            u, v = _products(x[some], near[:size], space)
            u, v = some[u], members[v]
            meant = here.sizes[u] == there.sizes[v]
            if here.number == there.number:
                meant &= here.keys[u] < there.keys[v]
            elif here.list != there.list:
                meant &= np.minimum(border[u], theirs[v]) <= reach
            u, v = u[meant], v[meant]
            cosine = np.zeros(len(u))
            step = max(1, (1 << 22) // here.unit.shape[1])
            for lo in range(0, len(u), step):
                part = slice(lo, lo + step)
                cosine[part] = np.einsum("ij,ij->i", here.unit[u[part]], there.unit[v[part]])
            u, v = u[cosine >= threshold], v[cosine >= threshold]
            if not len(u):
                continue
            # Only rows and columns with links matter from here on.
            rows_in, u = np.unique(u, return_inverse=True)
            columns_in, v = np.unique(v, return_inverse=True)
            linked = np.zeros((len(rows_in), len(columns_in)), bool)
            linked[u, v] = True
            # Each pair is compared once, so both learn of the link here.
            counts[columns_in] += here.copies[rows_in] @ linked
            own_counts[rows_in] += linked @ there.copies[columns_in]
            links = np.array([*_component_links(linked, here.keys[rows_in], there.keys[columns_in])], np.int64)
            yield _rows(1, links[:, 0], links[:, 1])
    found = np.flatnonzero(counts)
    if len(found):
        yield _rows(0, there.keys[found], counts[found])


def exact_reach(threshold: float) -> float:
    """How far a list's border may be from a vector that visits it, in units of the sphere's radius."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) / 2 + _BORDER_MARGIN


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    reach: float | None = None,
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row.

    Vectors of one length with a cosine of at least ``threshold`` are linked, all of them unless
    ``reach`` is less than ``exact_reach``, its default. Vectors that are
    null, empty, all zero or hold null or non-finite components, and rows without an id, link
    with nothing; a row without an id has a null component and is not kept. Equal vectors, and
    rows that repeat an id, are vectors of their own that link with each other. Other columns
    don't matter.
    """
    spark = vectors.sparkSession
    dtype = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"))
    huge = F.lit(float("inf"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == huge))
    usable = F.col("id").isNotNull() & ~bad & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    usable_rows = rows.where("usable").select("id", "embedding")
    grouped = usable_rows.groupBy("embedding").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    # Numbers of checkpointed rows don't change.
    classes = cut_lineage(grouped).withColumn("key", F.monotonically_increasing_id())
    n, width = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if n:
        found = _found(classes, n, width, dtype, threshold, exact_reach(threshold) if reach is None else reach)
        counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("others"))
        roots = components(found.where("kind = 1"))
        named = (
            classes.join(counts.withColumnRenamed("a", "key"), "key", "left")
            .join(roots.withColumnRenamed("node", "key"), "key", "left")
            .select("embedding", "first", "copies", "others", F.coalesce("root", "key").alias("root"))
        )
        least = named.groupBy("root").agg(F.min("first").alias("component_id"))
        named = named.join(least, "root").select(
            "embedding", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"
        )
        linked = usable_rows.join(named, "embedding").select("id", "n_links", "component_id")
    else:
        linked = spark.createDataFrame([], "id long, n_links long, component_id long")
    alone = rows.where("not usable").select("id", F.lit(0).cast("long"), "id")
    return linked.unionAll(alone).select(
        F.col("id").alias(id_col),
        "n_links",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def _found(classes: DataFrame, n: int, width: int, dtype: str, threshold: float, reach: float) -> DataFrame:
    sample = classes.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("embedding").collect()
    fitted = np.zeros((len(sample), width), dtype)
    for one, row in zip(fitted, sample):
        one[: len(row[0])] = row[0]
    lists = min(max(1, math.isqrt(n)), max(LEAST_LISTS, n // LIST_LENGTH), MOST_LISTS)
    quantiser = fit(_units(fitted), lists)
    assign = partial(_assign, quantiser=quantiser, width=width, dtype=dtype)
    assigned = cut_lineage(classes.select("key", "copies", "embedding").mapInArrow(assign, _ASSIGNED))
    most = max(1, min(PART, PART_BYTES // (8 * width)))
    # A row per list, MOST_LISTS at most.
    parts = F.broadcast(assigned.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")))
    dealt = assigned.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    dealt = dealt.select("list", "part", "key", "size", "copies", "vector", "codes", "error")
    dealt = dealt.repartition("list", "part").sortWithinPartitions("list", "part")
    # Numbers of checkpointed rows don't change.
    packed = cut_lineage(dealt.mapInArrow(partial(_parts, most=most), _PART)).withColumn("number", F.monotonically_increasing_id())
    groups = cut_lineage(_groups(packed, width))
    compare = partial(_compare, quantiser=quantiser, dtype=dtype, threshold=threshold, reach=reach)
    with few_at_once(classes.sparkSession, PAIR_BYTES):
        return cut_lineage(_pairs(packed, groups).mapInArrow(compare, _FOUND))


def _groups(packed: DataFrame, width: int) -> DataFrame:
    """(group, visitors): the parts dealt to groups of like size, each in a partition of its own."""
    spark = packed.sparkSession
    # A row for each part of a list.
    parts = packed.select("number", (F.octet_length("keys") / 8).cast("long").alias("members")).collect()
    cores = spark.sparkContext.defaultParallelism
    tasks = -(-sum(r.members for r in parts) * 8 * width // GROUP_BYTES)
    tasks = min(-(-tasks // cores) * cores, len(parts))  # as many for each core
    order = sorted(parts, key=lambda r: (-r.members, r.number))
    held = [(0, g) for g in range(tasks)]
    named = []
    for r in order:  # the largest first, each to the smallest group
        members, group = heapq.heappop(held)
        heapq.heappush(held, (members + r.members, group))
        named.append((r.number, group))
    dealt = packed.select(_HELD).join(F.broadcast(spark.createDataFrame(named, "number long, group int")), "number")
    dealt = dealt.select("group", *_HELD).repartitionById(tasks, "group")
    return dealt.sortWithinPartitions("group", "number").mapInArrow(_grouped, _GROUP)


def _pairs(packed: DataFrame, groups: DataFrame) -> DataFrame:
    """Every pair of a part and a group, all parts in the task of each group; visitors are in its first pair only."""
    numbered = packed.coalesce(1).withColumn("nth", F.monotonically_increasing_id())
    pairs = numbered.hint("shuffle_replicate_nl").crossJoin(groups)
    once = F.when(F.col("nth") == 0, F.col("visitors")).alias("visitors")
    return pairs.select("number", *_PART_COLUMNS, "group", once)
