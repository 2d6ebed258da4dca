"""Operators on texts against brute force, over the cases in conftest."""

from __future__ import annotations

import math
import random
import time
import zlib
from collections import Counter
from functools import partial

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from spendscope.llm import (
    bm25_search,
    byte_bpe,
    packing,
    quality_gam,
    signature_tree,
    textwords,
    unigram_count,
    window_dedup,
)

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = "É'é <|endoftext|> a  b \n\n c 　x 123 don't I'll ''s x́ 😀😀 'tis. x' \x00 日本語"


def shingles(text):
    found = (text or "").encode().lower().split()
    return {tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set()


def groups(sets):
    """Components of rows by index, of equal or similar sets."""
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    return [find(k) for k in range(len(sets))]


def test_jaccard_components(docs, texts):
    known = [(i, t) for i, t in texts if i is not None]
    root = groups([shingles(t) for _, t in known])
    least = {r: min(known[k][0] for k in range(len(known)) if root[k] == r) for r in root}
    expected = Counter((i, len(shingles(t)), least[r]) for (i, t), r in zip(known, root))
    expected.update((None, len(shingles(t)), None) for i, t in texts if i is None)
    found = signature_tree.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, found)) == expected


def test_large_blocks_are_cut_and_lose_no_link(docs, texts, monkeypatch):
    before = Counter(map(tuple, signature_tree.jaccard_components(docs).collect()))
    monkeypatch.setattr(signature_tree, "BLOCK_CLASSES", 2)
    assert Counter(map(tuple, signature_tree.jaccard_components(docs).collect())) == before


def test_tree_finds_what_all_pairs_find():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 48, 60, dtype=np.uint64)
    sets = []
    for _ in range(120):
        own = rng.integers(0, 1 << 48, 60, dtype=np.uint64)
        take = rng.random(60) < rng.choice([0.0, 0.8, 0.9, 0.97])
        sets.append(np.unique(np.where(take, base, own)))
    keys, sizes = np.arange(120), np.array([len(s) for s in sets])
    tree = signature_tree.SignatureTree(keys, sizes, sets, 1024)
    root = groups([set(s.tolist()) for s in sets])
    parent = {k: k for k in range(120)}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in signature_tree.spanning_links(tree, tree):
        parent[find(a)] = find(b)
    mine = [find(k) for k in range(120)]
    assert [[a == b for b in mine] for a in mine] == [[a == b for b in root] for a in root]


def test_one_per_component(docs, texts):
    kept = signature_tree.one_per_component(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[10] == 1 and ids[11] == 0 and ids[30] == 2 and ids[31] == 0 and ids[None] == 1 and ids[2] == 1


def brute_cut(rows, length=50):
    first = {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None and t), key=lambda r: r[0]):
        w = t.encode().split()
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k : k + length]), i)
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - length + 1) if i is not None else ():
            if first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        yield i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()


def test_cut_repeats(docs, texts):
    found = window_dedup.cut_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text or "") for r in found) == Counter(brute_cut(texts))
    for r in found:
        assert sum(s["last"] - s["first"] + 1 for s in r.removed_spans) == r.n_removed
        assert all(a["last"] + 1 < b["first"] for a, b in zip(r.removed_spans, r.removed_spans[1:]))


def test_cut_text_keeps_other_columns(docs, texts):
    cut = window_dedup.with_cut_text(docs)
    assert cut.schema == docs.schema
    changed = {(i, k) for i, _, n, k in brute_cut(texts) if n}
    expected = Counter((i, next((k for j, k in changed if j == i), t) if i in {j for j, _ in changed} else t) for i, t in texts)
    assert Counter((r.doc_id, r.text) for r in cut.collect()) == expected


def test_packing(docs, texts):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    rows = packing.packed(docs, WORDS, length=64, open_sequences=3).collect()
    documents = Counter()
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        documents[i, len(ids)] += len(ids)
        assert any(r.doc_id == i and r.doc_tokens == len(ids) for r in rows)
        for r in rows:
            if (r.doc_id, r.doc_tokens) == (i, len(ids)) and sum(j == i for j, _ in texts) == 1:
                assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    covered = Counter()
    for r in rows:
        covered[r.doc_id, r.doc_tokens] += r.length
    assert covered == documents
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert sequences.get(r.sequence_id, 0) == r.offset
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) == 64
    assert sum(n <= 64 - packing.SMALLEST_CUT for n in sequences.values()) <= 1


def test_word_ids_are_those_of_the_tokenizer(texts):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    samples = [ODD, "É'é Œuvre a.'b c'S. ẖ H̱. 'don't' 12.5% ²³ ａＢ ...' '. é. ١٢. ́a á. a b.　c a\x1cb Σς İstanbul Éé ŉ ſt", *(t or "" for _, t in texts)]
    found = packing.WordIds(WORDS).ids([s.encode() for s in samples])
    assert [f.tolist() for f in found] == [e.ids for e in tokenizer.encode_batch(samples, add_special_tokens=False)]


def test_a_worker_remembers_a_bounded_number_of_short_words():
    ids = packing.WordIds(WORDS)
    few, long = [f"w{k:x}" for k in range(1000)], [f"{k}{'x' * 100_000}" for k in range(10)]
    texts = [*(" ".join(f"w{k:x}" for k in range(at, at + 1000)).encode() for at in range(0, 600_000, 1000)), " ".join(long).encode()]
    for found in ids.ids(texts):
        pass
    assert len(ids.words) + len(ids.parts) < 900_000
    again = packing.WordIds(WORDS)
    list(again.ids([" ".join([*long, *few]).encode()]))
    for known in (again.words, again.parts):
        assert len(known) >= 1000 and sum(map(len, known)) < 1 << 20
    samples = [" ".join([*few, *long[:2], *few[::-1]])]
    expected = Tokenizer.from_file(WORDS).encode(samples[0], add_special_tokens=False).ids
    assert next(iter(ids.ids([samples[0].encode()]))).tolist() == next(iter(again.ids([samples[0].encode()]))).tolist() == expected


def test_packer_fills_and_merges():
    packer = packing.Packer(length=10, open_sequences=2, smallest_cut=3)
    for k, n in enumerate([25, 6, 5, 9, 4, 1, 10]):
        packer.add(packing.Piece(k, 0, n, np.arange(n, dtype=np.uint32)))
    rest = packer.leftover()
    assert sum(len(p.ids) for s in [*packer.emitted, rest] for p in s) == 60
    assert all(sum(len(p.ids) for p in s) >= 8 for s in packer.emitted) and sum(len(p.ids) for p in rest) < 10


def test_byte_bpe_is_that_of_tiktoken(spark, docs, texts):
    ranks = byte_bpe.read_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t) for i, t in texts if t is None or len(t) < 3000] + [(-1, ODD), (-2, "x" * 300 + "abcd" * 80), (-3, " ")]
    rng = random.Random(5)
    blob = "".join(rng.choice("ABCDEFabcdefghij") for _ in range(100_000))
    rows += [(-4, "x" * 100_000), (-5, f"a {blob} b {blob}"), (-6, "é" * 300 + "abc" * 200 + " " + "xy" * 256), (41, "x" * 5000)]
    some = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    for hot_words in (0, 50):
        found = byte_bpe.decoded(byte_bpe.encoded(some, ranks, public_tokenizers.PATTERN, hot_words=hot_words), ranks)
        expected = Counter((i, tuple(own.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
        assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in found.collect()) == expected


def test_rare_words_are_encoded_in_time(spark):
    """Words that no other document has take some microseconds each, not hundreds."""
    ranks = byte_bpe.read_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    rows = [(k, " ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(2500))) for k in range(200)]
    rare = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    rare.count()
    began = time.monotonic()
    found = byte_bpe.decoded(byte_bpe.encoded(rare, ranks, public_tokenizers.PATTERN), ranks).collect()
    assert time.monotonic() - began < 20
    assert {r.doc_id: (r.ids, r.decoded) for r in found} == {k: (own.encode_ordinary(t), t.encode()) for k, t in rows}


def test_decoding_keeps_nulls(spark):
    ranks = byte_bpe.read_ranks(RANKS)
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0, 1]), (4, [0, None])], "k long, ids array<int>").coalesce(1)
    by_rank = {rank: piece for piece, rank in ranks.items()}
    found = {r.k: r.decoded for r in byte_bpe.decoded(rows, ranks).collect()}
    assert found == {1: None, 2: b"", 3: by_rank[0] + by_rank[1], 4: None}
    with pytest.raises(Exception, match="(?i)index"):
        byte_bpe.decoded(spark.createDataFrame([(1, [10**6])], "k long, ids array<int>"), ranks).collect()


def test_token_counts_are_those_of_a_unigram_tokenizer(spark, docs, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda k: model.is_control(k) or model.is_unknown(k) or model.is_byte(k)
    size = model.get_piece_size()
    vocabulary = [(model.id_to_piece(k), -1e9 if special(k) else model.get_score(k)) for k in range(size)]
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rows = [*texts, (-1, ODD), (-2, "▁a ▁▁b"), (-3, "  a ")]
    found = unigram_count.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    expected = Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter(map(tuple, found)) == expected


def test_unigram_ties_go_to_the_piece_that_begins_first():
    counter = unigram_count.PieceCounter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)])
    assert counter.count("ab") == 2  # ▁ + ab and ▁a + b score alike as ▁ + a + b
    with pytest.raises(ValueError):
        unigram_count.PieceCounter([("ab", -1.0), ("a", -1.0)])


@pytest.mark.parametrize("shard_docs", [4, 1 << 13])
def test_search_is_exact(spark, docs, texts, monkeypatch, shard_docs):
    known = [(i, t) for i, t in texts if i is not None]
    asked = spark.createDataFrame([(10, known[0][1]), (12, "w1 W1 w0"), (13, None), (14, "nowhere"), (None, "w1")] + [(i, t) for i, t in known if i in (22, 40)], "query_id long, text string")
    monkeypatch.setattr(bm25_search, "BLOCK", 2)
    found = bm25_search.top_documents(docs, asked, top=5).collect()
    counts = [Counter((t or "").encode().lower().split()) for _, t in known]
    mean = sum(map(sum, (c.values() for c in counts))) / len(counts)
    df = Counter(w for c in counts for w in c)
    expected = []
    for q, text in asked.collect():
        scores = []
        for (i, _), c in zip(known, counts):
            norm = bm25_search.K1 * (1 - bm25_search.B + bm25_search.B * sum(c.values()) / mean)
            terms = set((text or "").encode().lower().split())
            parts = [math.log1p((len(known) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + norm) for w in terms if c[w]]
            scores.append((-round(sum(parts), 6), i))
        best = sorted(s for s in scores if s[0])[:5] if q is not None else []
        expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    key = lambda r: tuple(r[:2])
    assert [(a[:3], pytest.approx(a[3], abs=2e-6)) for a in sorted(map(tuple, found), key=key)] == [(e[:3], e[3]) for e in sorted(expected, key=key)]


def test_search_hands_on_the_best_of_all_shards_only(spark, docs, monkeypatch):
    asked = docs.where("doc_id is not null").select(F.col("doc_id").alias("query_id"), "text")
    found, handed = {}, []
    cut = bm25_search.cut_lineage
    monkeypatch.setattr(bm25_search, "cut_lineage", lambda df: handed.append(cut(df)) or handed[-1])
    for parts in (1, 9):
        ranked = bm25_search.top_documents(docs.repartition(parts), asked)
        found[parts] = sorted((*r[:3], round(r[3], 5)) for r in ranked.collect())
        assert handed[-1].columns == ["query", "doc_id", "score"]
        assert handed[-1].count() == len(found[parts])
    assert found[1] == found[9] and found[1]


def test_each_search_task_has_one_block_of_queries_and_gets_it_once(spark):
    weighted = spark.range(0, 20_000, 50).selectExpr("id AS query", "array(id, id + 1) AS query_terms", "array(1.0D, 2.0D) AS weights")
    blocks = bm25_search._dealt(weighted, 16).localCheckpoint()
    found = blocks.select("block", F.spark_partition_id().alias("part"), F.octet_length("queries").alias("bytes")).collect()
    assert len(found) == 16 == len({r.part for r in found}) and sum(r.bytes for r in found) == 8 * 400
    shards = spark.range(5, numPartitions=3).selectExpr("id AS shard", "0L AS most", *(f"X'00' AS {c}" for c in ("docs", "lengths", "terms", "firsts", "postings", "counts")))
    pairs = bm25_search._pairs(shards, blocks).select("shard", "block", "queries", "weights", F.spark_partition_id().alias("part")).collect()
    assert {(r.shard, r.block) for r in pairs} == {(s, b) for s in range(5) for b in range(16)} and len(pairs) == 80
    assert len({(r.block, r.part) for r in pairs}) == 16
    handed = [r.block for r in pairs if r.queries is not None]
    assert sorted(handed) == list(range(16)) and handed == [r.block for r in pairs if r.weights is not None]


@pytest.mark.parametrize("few", [0, 1 / 16, 2])
def test_a_shard_is_searched_exactly_whatever_the_class_of_its_terms(monkeypatch, few):
    rng = np.random.default_rng(7)
    n, mean = 700, 60.0
    sets = [np.unique(np.minimum(rng.zipf(1.25, 60), 3000)) for _ in range(n)]
    owner, terms = np.repeat(np.arange(n), [len(x) for x in sets]), np.concatenate(sets)
    order = np.lexsort((owner, terms))
    owner, terms, counts = owner[order], terms[order], rng.integers(1, 9, len(terms))
    at = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
    ids = rng.permutation(n) + 1000
    row = {
        "docs": ids.astype(np.int64).tobytes(),
        "lengths": np.bincount(owner, counts).astype(np.int64).tobytes(),
        "terms": terms[at].astype(np.uint64).tobytes(),
        "firsts": np.r_[at, len(terms)].astype(np.int64).tobytes(),
        "postings": textwords.small_index(owner, n),
        "most": int(counts.max()),
        "counts": textwords.small_index(counts, int(counts.max()) + 1),
    }
    monkeypatch.setattr(bm25_search, "FEW_BLOCKS", few)
    monkeypatch.setattr(bm25_search, "NUMBERS_AT_ONCE", 100)
    monkeypatch.setattr(bm25_search, "LEAST_POSTINGS", 8)
    shard = bm25_search.Shard(row, mean)
    assert shard.frequent and len(shard.block_best) and (shard.row_of < 0).any()
    queries = [(sets[k], rng.random(len(sets[k])) * 5) for k in range(0, n, 10)] + [(np.array([5000]), np.ones(1))]
    norm = bm25_search.K1 * (1 - bm25_search.B + bm25_search.B * np.bincount(owner, counts) / mean)
    scores = np.zeros((len(queries), n))
    for k, (asked, weights) in enumerate(queries):
        for t, w in zip(asked, weights):
            of = terms == t
            scores[k, owner[of]] += w * counts[of] * 2.2 / (counts[of] + norm[owner[of]])
    best = np.sort(scores)[:, ::-1]
    monkeypatch.setattr(bm25_search.Shard, "add", counted := Counted(bm25_search.Shard.add))
    postings = []
    for limits in (np.zeros(len(queries)), best[:, 9], best[:, 0], best[:, 0] + 1):
        counted.postings = 0
        found = {k: (ids, s) for k, ids, s in bm25_search.search(shard, bm25_search.Asked([(t.astype(np.int64), w) for t, w in queries]), 10, limits)}
        postings.append(counted.postings)
        for k, limit in enumerate(limits):
            expected = sorted((-round(s, 6), i) for s, i in zip(scores[k], ids.tolist()) if s and s >= limit)[:10]
            got = [(i, s) for i, s in zip(*found.get(k, ((), ()))) if s >= limit - 1e-6]
            assert [i for i, _ in got] == [i for _, i in expected]
            assert [s for _, s in got] == pytest.approx([-s for s, _ in expected], abs=2e-6)
    # The higher the limit, the fewer blocks are looked at.
    assert postings == sorted(postings, reverse=True) and (postings[-1] < postings[0]) == bool(few)


def test_only_documents_that_may_be_among_the_best_are_scored_exactly(monkeypatch):
    rng = np.random.default_rng(5)
    n, vocabulary = 900, 4000
    held = [np.unique(np.minimum(rng.zipf(1.3, 80), vocabulary)) for _ in range(n)]
    held[7] = held[3]  # equal scores: the smaller id is the better one
    owner, terms = np.repeat(np.arange(n), [len(x) for x in held]), np.concatenate(held)
    order = np.lexsort((owner, terms))
    owner, terms = owner[order], terms[order]
    at = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
    row = {
        "docs": np.arange(n, dtype=np.int64).tobytes(),
        "lengths": np.array([len(x) for x in held], np.int64).tobytes(),
        "terms": terms[at].astype(np.uint64).tobytes(),
        "firsts": np.r_[at, len(terms)].astype(np.int64).tobytes(),
        "postings": textwords.small_index(owner, n),
        "most": 1,
        "counts": textwords.small_index(np.ones(len(terms), int), 2),
    }
    shard = bm25_search.Shard(row, 30.0)
    queries = [(held[k].astype(np.int64), rng.random(len(held[k])) + 1e-3) for k in range(300)]
    norm = bm25_search.K1 * (1 - bm25_search.B + bm25_search.B * np.array([len(x) for x in held]) / 30.0)
    scores = np.array([[w[np.isin(t, x)].sum() for x in held] for t, w in queries]) * 2.2 / (1 + norm)
    scored = []
    exact = bm25_search.Shard.exact
    monkeypatch.setattr(bm25_search.Shard, "exact", lambda s, seen, *a: scored.append(len(seen)) or exact(s, seen, *a))
    limits = np.sort(scores)[:, -3]
    for some in (np.zeros(len(queries)), limits):
        scored.clear()
        found = {k: (i.tolist(), s) for k, i, s in bm25_search.search(shard, bm25_search.Asked(queries), 10, some)}
        for k, limit in enumerate(some):
            expected = sorted((-round(s, 6), i) for i, s in enumerate(scores[k]) if round(s, 6) >= max(round(limit, 6), 1e-6))[:10]
            ids, got = found[k]
            assert ids[: len(expected)] == [i for _, i in expected]
            assert got[: len(expected)] == pytest.approx([-s for s, _ in expected], abs=1e-9)
    assert len(scored) == len(queries) and np.mean(scored) < 5


class Counted:
    """A method that notes how many postings it is given."""

    def __init__(self, method):
        self.method, self.postings = method, 0

    def __get__(self, shard, kind):
        def call(sums, query, first, last, weight):
            self.postings += int((last - first).sum())
            return self.method(shard, sums, query, first, last, weight)

        return call


def test_quality_learns_and_scores_every_row(spark, docs, texts):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for k in range(400):
        good = bool(k % 4)
        body = " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40))
        rows.append((k, body.capitalize() + "." if good else body.upper().replace(" ", "!! ")))
        labels.append((k, int(good)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int")
    model = quality_gam.train(table, marked)
    found = {r.doc_id: r for r in quality_gam.scored(table, model, keep=["doc_id"]).withColumn("held", quality_gam.held_out("doc_id")).collect()}
    held = [k for k, r in found.items() if r.held]
    assert held and all(zlib.crc32(str(k).encode()) % 5 == 0 for k in held)
    assert np.mean([(found[k].score >= 0.3) == bool(k % 4) for k in held]) > 0.95
    every = quality_gam.scored(docs, model).collect()
    assert quality_gam.scored(docs, model, score_col="text").columns == [c for c in docs.columns if c != "text"] + ["text"]
    assert len(every) == len(texts) and all(0 <= r.score <= 1 for r in every)


def test_quality_learns_from_no_more_rows_than_the_sample(spark, monkeypatch):
    learnt = []
    monkeypatch.setattr(quality_gam, "fit", lambda x, y, settings: learnt.append((x, y)))
    labels = [(k, k % 2) for k in range(60)] + [(3, 1), (3, 0)]
    marked = spark.createDataFrame(labels, "doc_id long, quality int")
    once = [(k, f"text of {k} " * (k + 1)) for k in range(60)]
    again = [(k, t) for k, t in once if k < 5 for _ in range(300)] + [(3, "text of 3 " * 99)]
    for rows in (once, once + again):
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        quality_gam.train(table, marked)
    quality_gam.train(table, marked, sample=10)
    (x, y), (x_again, y_again), (x_few, _) = learnt
    assert len(x) == sum(zlib.crc32(str(k).encode()) % quality_gam.FOLDS != 0 for k, _ in labels)
    assert (y == y_again).all() and (x == x_again).all() and len(x_few) == 10


def test_quality_without_labels(spark, docs, no_docs):
    model = quality_gam.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality_gam.scored(docs, model, keep=["doc_id"]).collect()} == {0.5}


def test_empty_tables(spark, no_docs):
    ranks = byte_bpe.read_ranks(RANKS)
    asked = spark.createDataFrame([], "query_id long, text string")
    model = quality_gam.fit(np.zeros((0, len(quality_gam.FEATURES))), np.zeros(0))
    for found in (
        signature_tree.jaccard_components(no_docs),
        signature_tree.one_per_component(no_docs),
        window_dedup.cut_repeats(no_docs),
        window_dedup.with_cut_text(no_docs),
        packing.packed(no_docs, WORDS),
        byte_bpe.decoded(byte_bpe.encoded(no_docs, ranks, public_tokenizers.PATTERN), ranks),
        unigram_count.token_counts(no_docs, public_tokenizers.path("piece_bpe_32k.model")),
        bm25_search.top_documents(no_docs, asked),
        quality_gam.scored(no_docs, model),
    ):
        assert found.count() == 0



def test_a_passage_in_a_third_of_the_texts_fills_no_bucket(spark, monkeypatch):
    """Each part of a task has one entry for a shingle, and all links are found."""
    rng = random.Random(11)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"{passage} " * (k % 3 == 0) + " ".join(f"w{rng.randrange(10**6)}" for _ in range(25))) for k in range(900)]
    rows += [(1000 + k, passage + f" x{k}") for k in range(5)] + [(2000 + k, t) for k, t in rows[:100]]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    texts = table.selectExpr("doc_id AS row", "text")
    shards = texts.mapInArrow(partial(signature_tree._shards, words=5, buckets=3), signature_tree._SHARD).collect()
    flushes = {r.flush for r in shards}
    entries = [textwords.unplanes(r.shingles) * np.uint64(3) + np.uint64(r.bucket) for r in shards if r.keys is None]
    most = max(Counter(np.concatenate(entries).tolist()).values())
    assert len(flushes) == 7 and most == 7
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        found = {r.doc_id: r.component_id for r in signature_tree.jaccard_components(table).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    root = groups([shingles(t) for _, t in rows])
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(i, least.get(r, i))
    assert found == {i: least[r] for (i, _), r in zip(rows, root)}
