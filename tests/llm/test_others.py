"""Archives, vectors, chats, the pipeline, and all queries against DuckDB."""

from __future__ import annotations

import gzip

import numpy as np
import pytest

from spendscope.llm import archives, chat_format, pq_neighbours
from spendscope.llm.chat_format import Turn, render_incrementally
from spendscope.llm.queries import ORACLE_SQL, QUERIES
from spendscope_checks.compare import differences, duck

from .conftest import SF_DIR


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_are_cut_by_their_lengths(version):
    blocks = [b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nbody\nhttp://x 0.0.0.0 1 text/html 3\n", b"", b"\n\nplain", "é\r\n\r\nWARC/1.1".encode()]
    data = archives.arc_opening("a.arc", version)
    for k, block in enumerate(blocks):
        data += archives.arc_line(f"http://x/{k} y", "2001", "text/html", len(block), version).encode() + b"\n" + block + b"\n"
    found = list(archives.parse_arc(data))
    assert [r.block for r in found] == blocks and {r.version for r in found} == {version}
    assert found[0].header["url"] == "http://x/0%20y" and archives.warc_date(found[0].header["date"]) == "2001-01-01T00:00:00Z"
    assert archives.payload_of(found[0]).startswith(b"body\n")
    with pytest.raises(ValueError):
        list(archives.parse_arc(data[:-3]))
    with pytest.raises(ValueError):
        list(archives.parse_arc(data.replace(b"\n" + str(version).encode() + b" 0 -", b"\n7 0 -")))


def test_warc_records_are_cut_by_their_lengths():
    record = archives.ArcRecord(1, 0, {"url": "u", "date": "20010203040506", "type": "text/plain"}, b"HTTP/1.0 200 OK\r\n\r\na\r\n\r\nWARC/1.1\r\n")
    response = archives.warc_record(record, "1", None) + b"\r\n\r\n"
    revisit = archives.warc_record(record, "2", ("1", "u", "d")) + b"\r\n\r\n"
    (a, block), (b, rest) = archives.parse_warc(response + revisit)
    assert block == record.block and rest == b"HTTP/1.0 200 OK\r\n\r\n"
    assert a["warc-date"] == "2001-02-03T04:05:06Z" and b["warc-refers-to"] == "<urn:uuid:1>"
    assert a["warc-payload-digest"] == b["warc-payload-digest"] == "sha1:" + archives.sha1_base32(b"a\r\n\r\nWARC/1.1\r\n")
    assert archives._plain(gzip.compress(b"a") + gzip.compress(b"b")) == b"ab"


def test_archived_pages(spark, tmp_path):
    long = "x" * 300_000
    rows = [(1, "u 1", None), (2, None, ""), (3, "u3", "é\r\n\r\nb"), (4, "u4", long), (5, "u5", long), (5, "u5", "é\r\n\r\nb"), (None, "u", "n")]
    pages = spark.createDataFrame([(*r[:2], "2001", r[2], "x") for r in rows], "number long, url string, date string, payload string, digest string").repartition(3)
    found = archives.archived(pages, str(tmp_path / "a"), version=2).collect()
    got = sorted((r.number or 0, r.payload_bytes, r.record_type, r.refers_to) for r in found)
    assert got == sorted([(1, 0, "revisit", 2), (2, 0, "response", None), (3, 7, "revisit", 5), (4, 300_000, "revisit", 5), (5, 300_000, "response", None), (5, 7, "response", None), (0, 1, "response", None)])
    assert all(r.payload_digest == archives.sha1_base32("é\r\n\r\nb".encode()) for r in found if r.payload_bytes == 7)
    unequal = archives.archived(pages, str(tmp_path / "b"), least_bytes=1)
    assert {r.record_type for r in unequal.collect() if r.payload_bytes == 0} == {"response"}
    assert archives.archived(pages.limit(0), str(tmp_path / "c")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    close = base[:10] + 0.15 * rng.normal(size=(10, 16))
    group = base[0] + 0.1 * rng.normal(size=(40, 16))
    vectors = [v.tolist() for v in [*base, *close, *group, base[1], base[1], -base[2], 1e30 * base[3], 1e-30 * base[3]]]
    vectors += [None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    rows = [(100 - k, v, "x") for k, v in enumerate(vectors)] + [(None, vectors[0], "x"), (100, vectors[0], "y")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string").repartition(3)
    good = [(i, np.array(v)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]

    def linked(x, y):
        return len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9

    links = [[a != b and linked(x, y) for b, (_, y) in enumerate(good)] for a, (_, x) in enumerate(good)]
    label = [i for i, _ in good]
    for _ in good:
        label = [min([label[a], *(label[b] for b in range(len(good)) if links[a][b])]) for a in range(len(good))]
    expected = [(i, sum(n), c, i == c) for (i, _), n, c in zip(good, links, label)]
    bad = [i for i, v, _ in rows if i is None or not v or None in v or not np.isfinite(v).all() or not np.any(v)]
    expected += [(i, 0, i, i is not None) for i in bad]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    found = pq_neighbours.near_duplicates(table, reach=0.5)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)
    assert pq_neighbours.near_duplicates(table.limit(0)).count() == 0


def test_vector_recall_at_the_default_reach(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(600, 64))
    near = base + 0.45 * rng.normal(size=base.shape)  # cosines around the threshold
    x = np.concatenate([base, near])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    exact = int((np.triu(unit @ unit.T, 1) >= 0.9).sum())
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = pq_neighbours.near_duplicates(table).agg({"n_links": "sum"}).first()[0] / 2
    assert exact > 300 and 0.97 * exact <= found <= exact


@pytest.mark.parametrize("width, threshold", [(3, 0.9), (5, 0.8)])
def test_no_link_is_lost_at_the_borders_of_lists(spark, width, threshold):
    x = np.random.default_rng(8).normal(size=(1500, width))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    expected = (unit @ unit.T >= threshold).sum(axis=1) - 1
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.n_links for r in pq_neighbours.near_duplicates(table, threshold=threshold).collect()}
    assert [found[k] for k in range(len(x))] == expected.tolist()


def test_vectors_in_many_parts_and_groups_link_as_in_one(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(400, 6)), rng.normal(size=6) + 0.05 * rng.normal(size=(150, 6))])
    x = np.concatenate([x, x[:20], x[-5:]])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    expected = (unit @ unit.T >= 0.9 - 1e-12).sum(axis=1) - 1
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(pq_neighbours, "PART", 16)
    monkeypatch.setattr(pq_neighbours, "GROUP_BYTES", 64 * 6 * 8)
    held, dealt = [], pq_neighbours._groups
    monkeypatch.setattr(pq_neighbours, "_groups", lambda *a: held.append(dealt(*a)) or held[-1])
    found = {r.vec_id: (r.n_links, r.component_id) for r in pq_neighbours.near_duplicates(table).collect()}
    assert [found[k][0] for k in range(len(x))] == expected.tolist()
    assert len({found[k][1] for k in range(400, 550)}) == 1
    # A task holds its group and one part, however many lists its vectors visit.
    groups = [[len(v.keys) // 8 for v in r.visitors] for r in held[0].collect()]
    assert len(groups) >= 9 and max(map(sum, groups)) <= 64 + 16 and max(map(max, groups)) <= 16
    assert sum(map(sum, groups)) == 550


def test_each_pair_of_parts_is_compared_once_and_half_of_them_in_each_group():
    led = [[pq_neighbours._lead(a, b) for b in range(200)] for a in range(200)]
    assert all(led[a][b] != led[b][a] for a in range(200) for b in range(a))
    assert all(70 < sum(row) < 130 for row in led)


def test_products_of_at_least_zero():
    rng = np.random.default_rng(3)
    space = np.ones(600, np.float32), np.ones(600, bool)
    for n, m in ((7, 11), (8, 8), (1, 1), (9, 64)):
        x, y = (rng.normal(size=(k, 3)).astype(np.float32) for k in (n, m))
        expected = np.nonzero(x @ y.T >= 0)
        assert [a.tolist() for a in pq_neighbours._products(x, y, space)] == [a.tolist() for a in expected]


def test_incremental_rendering():
    turns = [Turn("user", "a<|im_end|>b"), Turn("assistant", "<\\|x"), Turn("us\ner", ""), Turn("assistant", "ok")]
    found = render_incrementally(chat_format.marked_turns, turns)
    assert not found.rewrites_history and found.spans[0].start == 0 and found.spans[-1].end == len(found.text)
    assert all(a.end == b.start for a, b in zip(found.spans, found.spans[1:]))
    segment = {"formatted": found.text, "spans": [s._asdict() | {"in_loss": True} for s in found.spans]}
    assert [(r, t) for r, t, _ in chat_format.read_back(segment)] == turns


def test_templates_that_rewrite_history():
    def last_thought(turns):
        return "".join(f"{t.role}:{t.text if t is turns[-1] else t.text.split('#')[-1]};" for t in turns)

    turns = [Turn("a", "think#say"), Turn("b", "hm")]
    found = render_incrementally(last_thought, turns)
    assert found.rewrites_history and found.text == "a:say;b:hm;"
    assert found.text[found.spans[1].text_start : found.spans[1].text_end] == "hm"
    assert not render_incrementally(last_thought, [Turn("a", "say"), Turn("b", "hm")]).rewrites_history
    hidden = render_incrementally(lambda turns: "x" * len(turns), turns)
    assert all(s.text_start == s.text_end for s in hidden.spans)


def test_chat_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "b"), (1, None, None, "s"), (None, 0, "user", "n"), (2, 0, "assistant", "x" * 50_000)]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    for segment_turns in (1, 2, 256):
        found = {r.conv_id: r for r in chat_format.digests(chat_format.formatted(table, segment_turns=segment_turns)).collect()}
        assert (found[1].n_turns, found[1].loss_chars, found[2].loss_chars, found[None].n_turns) == (4, 2, 50_000, 1)
    parts = chat_format.formatted(table, segment_turns=2).where("conv_id = 1").collect()
    assert [p.segment for p in parts] == [0, 1] and parts[0].formatted.startswith("<|im_start|>\ns<|im_end|>")
    assert chat_format.digests(chat_format.formatted(table.limit(0))).count() == 0


def _with_prefix(turns):
    return "<s>" + "".join(f"{t.role}:{t.text};" for t in turns)


def _thoughts_since_user(turns):
    last = max((k for k, t in enumerate(turns) if t.role == "user"), default=-1)
    return "".join(f"{t.role}:{t.text if k >= last else t.text.split('#')[-1]};" for k, t in enumerate(turns))


@pytest.mark.parametrize("template", [_with_prefix, _thoughts_since_user, chat_format.marked_turns])
def test_long_conversations_are_rendered_whole(spark, template):
    # The turns around number 256 are the assistant's: what rewrites them is the user's, after it.
    turns = [Turn("user" if k % 8 == 2 else "assistant", f"think{k}#say{k}") for k in range(261)]
    table = spark.createDataFrame([(c, k, *t) for c in (1, 2) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    outputs = [template(turns[:k]) for k in range(len(turns) + 1)]
    rewrites = any(not b.startswith(a) for a, b in zip(outputs, outputs[1:]))
    for segment_turns in (2, 256):
        found = chat_format.formatted(table, template, segment_turns=segment_turns).collect()
        for conv in (1, 2):
            parts = sorted((r for r in found if r.conv_id == conv), key=lambda r: r.segment)
            assert len(parts) == 1 or not rewrites
            assert "".join(p.formatted for p in parts) == outputs[-1] and any(p.rewrites_history for p in parts) == rewrites
            ends = [p.offset + s.end for p in parts for s in p.spans]
            assert ends == [len(x) for x in outputs[1:]]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), duck(SF_DIR), ORACLE_SQL[name]) == []


def test_conversations_with_all_private_characters():
    every = "".join(map(chr, range(0xE000, 0xF900)))
    turns = [Turn("user", every), Turn("assistant", "\ue000" * 5), Turn("user", "\ue000"), Turn("assistant", "x")]
    for template in (chat_format.marked_turns, lambda some: "".join(t.text for t in some)):
        found = render_incrementally(template, turns)
        shown = [found.text[s.text_start : s.text_end] for s in found.spans]
        assert shown == [t.text for t in turns] and not found.rewrites_history
