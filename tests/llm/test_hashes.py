"""Hashes of words and windows, with sequences that clash under polynomials modulo 2**64."""

from __future__ import annotations

import random

import numpy as np
import pytest

from spendscope.llm import bm25_search, signature_tree, textwords, window_dedup


def thue_morse(n: int) -> tuple[str, str]:
    word = "".join("ab"[k.bit_count() & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def hashes(text: str, lower: bool = False) -> np.ndarray:
    data = text.encode()
    part = textwords.Slice(np.zeros(1, np.int64), np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    starts, ends, _ = textwords.word_spans(part)
    return textwords.word_hashes(part, starts, ends, lower)


@pytest.mark.parametrize("n", [1, 8, 16, 255, 256, 257, 1024, 2048, 4096])
def test_complementary_words_differ(n):
    a, b = thue_morse(n)
    found = hashes(f"{a} {b} x{a} {a} {a.upper()}", lower=True)
    assert found[0] == found[3] == found[4] and len(set(found.tolist())) == 3
    assert hashes(a.upper()) != hashes(a)


def test_words_differ_by_every_byte_and_length():
    words = ["\0" * k + "x" + "\0" * j for k in range(12) for j in range(12)] + ["é" * k for k in range(1, 200)]
    assert len(set(hashes(" ".join(words)).tolist())) == len(words)


def test_products_modulo_the_prime():
    rng = random.Random(4)
    a, b = ([rng.randrange(textwords.PRIME) for _ in range(500)] + [0, 1, textwords.PRIME - 1] for _ in "ab")
    found = textwords._product(np.array(a, np.uint64), np.array(b, np.uint64))
    assert found.tolist() == [x * y % textwords.PRIME for x, y in zip(a, b)]


@pytest.mark.parametrize("length", [1, 5, 50, 1024])
def test_windows_are_equal_if_their_words_are(length):
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 64, 3 * length + 40, np.uint64)
    words[2 * length : 3 * length] = words[:length]
    found = textwords.rolling_hashes(words, length)
    assert found[2 * length] == found[0] and len(found) == 2 * length + 41
    seen = {tuple(words[k : k + length].tolist()): h for k, h in enumerate(found.tolist())}
    assert len(set(found.tolist())) == len(seen)
    assert len(textwords.rolling_hashes(words[: length - 1], length)) == 0


def test_complementary_windows_differ():
    a, b = hashes("a b")
    for n in (1024, 2048):
        rows = [np.where([k.bit_count() & 1 for k in range(n)], *pair) for pair in ((a, b), (b, a))]
        assert textwords.rolling_hashes(rows[0], n) != textwords.rolling_hashes(rows[1], n)


@pytest.mark.parametrize("n", [1024, 2048])
def test_operators_tell_complementary_words_apart(spark, n):
    a, b = thue_morse(n)
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in signature_tree.jaccard_components(docs).collect()} == {1: 1, 2: 2, 3: 1}
    asked = docs.withColumnRenamed("doc_id", "query_id")
    hits = {(r.query_id, r.doc_id) for r in bm25_search.top_documents(docs, asked).collect()}
    assert hits == {(1, 1), (1, 3), (2, 2), (3, 1), (3, 3)}
    texts = spark.createDataFrame([(1, " ".join([a] * 50)), (2, " ".join([b] * 50)), (3, " ".join([a] * 60))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in window_dedup.cut_repeats(texts).collect()} == {1: 0, 2: 0, 3: 60}
    words = [" ".join(x) for x in (a, b, a)]
    long = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in window_dedup.cut_repeats(long, length=n).collect()} == {0: 0, 1: 0, 2: n}
