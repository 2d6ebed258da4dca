"""The pipeline and the queries without SQL, from the tables to their columns, against brute force over planted cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer, models, pre_tokenizers

import corpus_pipeline
from spendscope.llm import byte_bpe
from spendscope.llm.queries import QUERIES

from .test_texts import RANKS, WORDS, brute_cut, groups, shingles


def prose(rng: random.Random, n: int) -> str:
    found = ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 8))) for _ in range(n)]
    return " ".join(w + "." if k % 9 == 8 else w for k, w in enumerate(found)).capitalize()


@pytest.fixture(scope="module")
def planted() -> dict[int, tuple[str, bool]]:
    """Texts by id, and whether they are good: every fourth is junk; then copies, near copies and shared passages."""
    rng = random.Random(11)
    found = {}
    for k in range(240):
        good = k % 4 != 0
        text = prose(rng, rng.randrange(60, 120))
        found[k] = (text if good else text.upper().replace(" ", "!! "), good)
    for k in range(1, 12, 2):
        words = found[k][0].split()
        found[1000 + k] = (" \n".join(words), True)
        found[1100 + k] = (" ".join([*words[:-1], "other"]), True)
        found[1200 + k] = (" ".join(words[: len(words) // 2] + prose(rng, 60).split()), True)
    passage = prose(rng, 70)
    for k in range(5):
        found[2000 + k] = (f"{prose(rng, 30 + k)} {passage}  {prose(rng, 20)}", True)
    found[2010] = (passage, True)
    return found


@pytest.fixture(scope="module")
def tables(spark, planted, tmp_path_factory) -> str:
    folder = str(tmp_path_factory.mktemp("planted"))
    rows = [(k, t, "en", "web", len(t)) for k, (t, _) in planted.items()]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(good), 0) for k, (_, good) in planted.items() if k % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def assert_packed(rows, texts: dict[int, str]) -> None:
    """The pieces are all ids of exactly these texts, side by side in the sequences."""
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.offset + r.length))
    assert pieces.keys() == texts.keys()
    for k, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            at += r.length
            assert zlib.crc32(ids[r.start : at].tobytes()) == r.ids_crc32
        assert at == len(ids)
    for found in places.values():
        found.sort()
        assert found[0][0] == 0 and all(a[1] == b[0] for a, b in zip(found, found[1:])) and found[-1][1] <= 4096


def test_pipeline_against_brute_force(spark, planted, tables):
    good = {k: t for k, (t, is_good) in planted.items() if is_good}
    ids = sorted(good)
    root = groups([shingles(good[k]) for k in ids])
    least = {r: min(k for k, q in zip(ids, root) if q == r) for r in root}
    single = {k: good[k] for k, r in zip(ids, root) if least[r] == k}
    cut = {k: kept if n else single[k] for k, _, n, kept in brute_cut(list(single.items()))}
    # Each stage has something to do.
    assert len(planted) > len(good) > len(single) and sum(cut[k] != single[k] for k in cut) >= 5
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for (name, stage), expected in zip(corpus_pipeline.STAGES, (good, single, cut)):
        docs = stage(spark, docs, tables)
        rows = docs.collect()
        assert sorted((r.doc_id, r.text, r.n_chars) for r in rows) == sorted((k, t, len(t)) for k, t in expected.items()), name
    assert_packed(corpus_pipeline.run(spark, tables).collect(), cut)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_query_op1_against_tiktoken(spark, planted, tables):
    ranks = byte_bpe.read_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for k, (text, _) in planted.items():
        ids = own.encode_ordinary(text)
        expected.append((k, len(ids), _sha(" ".join(map(str, ids)).encode()), _sha(text.encode())))
    assert sorted(map(tuple, QUERIES["op1_byte_bpe"](spark, tables).collect())) == sorted(expected)


def test_query_op3_against_what_was_planted(spark, planted, tables):
    rows = QUERIES["op3_quality_classifier"](spark, tables).collect()
    expected = sorted((k, zlib.crc32(str(k).encode()) % 5 == 0, int(good)) for k, (_, good) in planted.items())
    assert sorted((r.doc_id, r.held_out, r.predicted) for r in rows) == expected
    assert all(0 <= r.score <= 1 and (r.score >= 0.3) == r.predicted for r in rows)


def test_query_op7_against_a_unigram_tokenizer(spark, planted, tables):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda k: model.is_control(k) or model.is_unknown(k) or model.is_byte(k)
    vocabulary = [(model.id_to_piece(k), -1e9 if special(k) else model.get_score(k)) for k in range(model.get_piece_size())]
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    expected = [(k, len(tokenizer.encode(t, add_special_tokens=False).ids)) for k, (t, _) in planted.items()]
    assert sorted(map(tuple, QUERIES["op7_token_counts"](spark, tables).collect())) == sorted(expected)


def test_query_op9_against_the_tokenizer(spark, planted, tables):
    assert_packed(QUERIES["op9_packing"](spark, tables).collect(), {k: t for k, (t, _) in planted.items()})


def test_stages_keep_other_columns_and_odd_rows(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    odd = spark.createDataFrame([(9000, None, None, None, None), (9001, "", "en", "web", 0), (None, "a b", "en", "web", 3)], docs.schema)
    wide = docs.unionByName(odd).selectExpr("*", "doc_id AS score", "lang AS row", "1 AS hashes", "'x' AS component_id", "2 AS n_words")
    for docs_in in (wide, wide.limit(0)):
        kept = docs_in
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, tables)
            assert kept.schema.names == wide.schema.names, name
        rows = kept.collect()
        assert all(r.score == r.doc_id and r.row == r.lang and r.hashes == 1 and r.component_id == "x" for r in rows)
        pieces = corpus_pipeline.STAGES[-1][1](spark, kept, tables).collect()
        assert {r.doc_id for r in pieces} == {r.doc_id for r in rows}
