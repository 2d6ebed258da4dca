"""The manifest against a brute-force one."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest

from spendscope.llm import merkle

UPPER = {ord("A") + k: ord("a") + k for k in range(26)}


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values) -> str:
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def brute(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    key = lambda x: (x is not None, x if x is not None else 0)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == g), key=lambda r: (key(r[0]), leaf(r))) for g in langs]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    top = tree([t[-1][0] for t in trees])
    for at, (group, own) in enumerate(zip(groups, trees)):
        for k, r in enumerate(group):
            proof, now = [], leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                now = leaf((*r[:4], r[4].translate(UPPER)))
            for levels, place in ((own, k), (top, at)):
                for nodes in levels[:-1]:
                    first = place // 8 * 8
                    proof += [*nodes[first:place], *nodes[place + 1 : first + 8]]
                    now = digest(*nodes[first:place], now, *nodes[place + 1 : first + 8])
                    place //= 8
            yield r[0], leaf(r), own[-1][0], top[-1][0], digest(*proof), now, now == top[-1][0]


DDL = "doc_id long, source string, lang string, n_chars long, text string, leaf string, part int, `group` string"


@pytest.mark.parametrize("langs, n", [(1, 1), (1, 2), (1, 9), (2, 700), (11, 90), (40, 40), (3, 0)])
@pytest.mark.parametrize("parts", ["2", "7"])
def test_manifest(spark, langs, n, parts):
    names = [None, "", "é", "zz", *(f"g{k}" for k in range(36))]
    rows = [(k * 7 % 701, None if k % 5 == 0 else "web", names[k % langs], k if k % 3 else None, f"Text Ü {k}" if k % 4 else None) for k in range(n)]
    rows += rows[: n // 4] + [(None, "web", names[0], 1, "A")] * (2 if n > 100 else 0)
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DDL).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = merkle.row_proofs(table, changed=merkle.tampered()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert Counter(map(tuple, found)) == Counter(brute(rows))


def test_a_group_with_most_rows_and_repeated_rows_spreads_over_partitions(spark):
    rows = [(5, "web", "en", 1, "Same")] * 600 + [(k, "web", "de", 1, "A") for k in range(30)]
    table = spark.createDataFrame(rows, ", ".join(DDL.split(", ")[:5])).repartition(4)
    leaves = table.selectExpr("lang AS group", "doc_id AS id", "unhex(sha2(text, 256)) AS leaf", "unhex(sha2(text, 256)) AS other")
    packed = merkle.manifest(leaves).packed.selectExpr("size(ids) AS n").collect()
    assert len(packed) > 2 and max(r.n for r in packed) < 400
    found = merkle.row_proofs(table, changed=merkle.tampered()).collect()
    assert Counter(map(tuple, found)) == Counter(brute(rows))


@pytest.mark.parametrize("start, stop, size", [(0, 1, 1), (0, 9, 9), (5, 6, 100), (3, 77, 700), (64, 128, 513), (690, 700, 700)])
def test_multiproof_is_least_and_enough(start, stop, size):
    levels = tree([digest(str(k)) for k in range(size)])
    run = merkle.Run(start, stop, size, "".join(levels[0][start:stop]).encode())
    wanted = list(merkle.missing(start, stop, size))
    fetched = {(level, k): levels[level][k].encode() for level, k in wanted}
    assert merkle.full_levels(run, fetched)[-1].digests.decode() == levels[-1][0]
    # None can be computed: it has no leaf in the run, and none is asked for twice.
    assert len(set(wanted)) == len(wanted)
    assert all(8**level * (k + 1) <= start or 8**level * k >= stop for level, k in wanted)
    for level, k, found in merkle.topmost(run):
        assert found.decode() == levels[level][k]
