"""Ranked search against sums over all documents."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spendscope.llm import k2_search

from .test_hashes import thue_morse

UPPER = {ord("A") + k: ord("a") + k for k in range(26)}


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, top=10):
    rows = [(i, Counter(terms_of(t))) for i, t in docs if i is not None and terms_of(t)]
    n, length = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i].update(terms_of(t))
    for item, terms in asked.items():
        scores = []
        for i, c in rows:
            m = 10 + 90 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, i))
        yield from ((item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top]))


@pytest.fixture(scope="module")
def items(texts):
    a, b = thue_morse(1024)
    rows = [(k, t) for k, (_, t) in enumerate(texts) if k % 3 == 0] + [(500, None), (501, "!?"), (None, "w1"), (502, "w1 W2"), (502, "w3"), (503, "nowhere")]
    return rows + [(504, "É é x-é_é"), (505, a), (506, b)]


@pytest.mark.parametrize("shard_docs, states, block", [(1 << 13, 64, 1 << 20), (5, 2, 30), (1, 1, 1)])
def test_ranked(spark, docs, texts, items, monkeypatch, shard_docs, states, block):
    for name, value in (("SHARD_DOCS", shard_docs), ("STATES", states), ("BLOCK_TERMS", block)):
        monkeypatch.setattr(k2_search, name, value)
    a, b = thue_morse(1024)
    extra = [(600, a), (601, b), (602, "é É é"), (603, "W1")]
    more = spark.createDataFrame([(*r, 1, "a", "b", 2.0) for r in extra], docs.schema)
    table = spark.createDataFrame([(*r, "x", 5) for r in items], "item_id long, text string, term string, item int")
    found = k2_search.ranked(docs.unionByName(more), table)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    # Small shards are cut by slices of texts in the workers, which see the patched sizes or not.
    assert Counter(map(tuple, found.collect())) == Counter(brute(texts + extra, items))
    assert k2_search.ranked(docs.limit(0), table).count() == 0 and k2_search.ranked(docs, table.limit(0)).count() == 0


@pytest.mark.parametrize("states", [1, 3, 64])
def test_descent_finds_the_best_and_leaves_the_rest(monkeypatch, states):
    monkeypatch.setattr(k2_search, "STATES", states)
    rng = np.random.default_rng(1)
    n_rows, n_docs = 300, 1000
    grid = (rng.random((n_rows, n_docs)) < rng.random((n_rows, 1)) ** 4) * rng.integers(1, 9, (n_rows, n_docs))
    rows, columns = np.nonzero(grid)
    treap = k2_search.Treap(rows, columns, grid[rows, columns])
    docs = np.sort(rng.choice(5000, n_docs, replace=False))
    for _ in range(30):
        some = rng.choice(n_rows, rng.integers(1, 20), replace=False)
        weights = rng.integers(0, 9, len(some))
        scores = (weights[:, None] * grid[some]).sum(axis=0)
        order = [k for k in np.lexsort((docs, -scores))[:10] if scores[k] > 0]
        found = k2_search.descend(treap, docs, some, weights, k2_search.NOTHING, 10)
        assert found.ids.tolist() == docs[order].tolist() and found.scores.tolist() == scores[order].tolist()
        # A second shard with the same documents under later ids changes nothing.
        again = k2_search.descend(treap, docs + 5000, some, weights, found, 10)
        best = sorted((-s, i) for s, i in [*zip(scores, docs), *zip(scores, docs + 5000)] if s > 0)[:10]
        assert list(zip((-again.scores).tolist(), again.ids.tolist())) == best
