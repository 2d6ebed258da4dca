"""Secret scans against plain scans of whole texts, and checksums against known ones."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from spendscope.llm import secret_scan

BECH32 = secret_scan.BECH32


def age_key(rng, wrong=False):
    data = [rng.randrange(32) for _ in range(52)]
    rest = secret_scan.bech32_remainder("age-secret-key-", [*data, 0, 0, 0, 0, 0, 0]) ^ 1
    data += [rest >> 5 * (5 - k) & 31 for k in range(6)]
    data[7] ^= wrong
    return "AGE-SECRET-KEY-1" + "".join(BECH32[d] for d in data).upper()


def token(rng, prefix, wrong=False):
    body = "".join(rng.choice(secret_scan.BASE62) for _ in range(30))
    check = secret_scan.crc_base62(body)
    return prefix + body + (check[:-1] + ("1" if check[-1] == "0" else "0") if wrong else check)


def brute(text):
    """All kinds by a scan of the whole text."""
    text = text or ""
    found = []
    for k, (kind, least, pattern) in enumerate(
        [
            ("assign", 6, r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
            ("access", 20, r"(AKIA[A-Z0-9]+)"),
            ("hex", 24, r"([0-9a-f]+)"),
            ("github", 40, r"(gh[pousr]_[0-9A-Za-z]+)"),
            ("npm", 40, r"(npm_[0-9A-Za-z]+)"),
            ("age", 74, r"(AGE-SECRET-KEY-1[0-9A-Z]+)"),
        ]
    ):
        for m in re.finditer(pattern, text):
            good = len(m[1]) >= least
            if kind in ("github", "npm"):
                good = len(m[1]) == least and secret_scan.crc_base62(m[1][4:34]) == m[1][34:]
            if kind == "age":
                digits = [BECH32.find(c) for c in m[1][16:].lower()]
                good = len(m[1]) == least and min(digits) >= 0 and secret_scan.bech32_remainder("age-secret-key-", digits) == 1
            if good:
                found.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def test_known_checksums():
    # A published example of a revoked token, and the test vector of Bech32's specification.
    assert secret_scan.crc_base62("zQWBuTSOoRi4A9spHcVY5ncnsDkxkJ") == "0mLq17"
    assert secret_scan.bech32_remainder("a", [BECH32.index(c) for c in "2uel5l"]) == 1
    assert secret_scan.bech32_remainder("a", [BECH32.index(c) for c in "2uel5q"]) != 1


@pytest.fixture(scope="module")
def secret_texts():
    rng = random.Random(9)
    pieces = ["password", "passwd", "Secret", "TOKEN", "api_key", "apikey", "api", "_key", '"', "'", " ", "  ", ":", "=", "abc", "x1-/+", "é", "ſecret", "toKen", "😀"]
    pieces += ["AKIA", "AKIA" + "Q7" * 8, "AKIAAKIA", "0123456789abcdef", "abcdefabcdef", "deadbeef" * 4, "A", "f", "\n", "g", "Z" * 7, "akia"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    texts += ["0" * k + "g" + "é" * (k % 5) + "a" * (k + 3) for k in range(18, 40)]
    for wrong in (False, True):
        for prefix in ("ghp_", "gho_", "ghs_", "npm_"):
            texts += [f"é {token(rng, prefix, wrong)}.", f"x{token(rng, prefix, wrong)}", f"token={token(rng, prefix, wrong)}"]
        texts += [f"é{age_key(rng, wrong)} {age_key(rng, wrong)}", age_key(rng, wrong) + "A", age_key(rng, wrong).lower()]
    texts += [None, "", "a" * 3_000_000, "token" + " " * 100_000 + "=" + "k" * 100_000, "token " * 50_000]
    return texts


def test_spans_are_those_of_whole_scans(spark, secret_texts):
    rows = [(k, t, "x", 1, "y") for k, t in enumerate(secret_texts)] + [(None, "password=secret1", "x", 1, "y")] * 2
    table = spark.createDataFrame(rows, "doc_id long, text string, spans string, row int, kind string").repartition(3)
    found = secret_scan.secrets(table).collect()
    assert sorted(r.doc_id for r in found if r.doc_id is not None) == list(range(len(secret_texts)))
    assert [[tuple(s) for s in r.spans] for r in found if r.doc_id is None] == [[("assign", 0, 16)]] * 2
    for r in found:
        if r.doc_id is not None:
            assert [tuple(s) for s in r.spans] == brute(secret_texts[r.doc_id]), secret_texts[r.doc_id][:200]
    kinds = {s.kind for r in found for s in r.spans}
    assert kinds == {k.name for k in secret_scan.KINDS}
    assert secret_scan.secrets(table.limit(0)).count() == 0


def test_digests(spark):
    rng = random.Random(2)
    text = f"é token = 'abcdef' {token(rng, 'ghp_')} AKIA{'A' * 16} " + "0f" * 12
    expected = brute(text)
    row = secret_scan.digests(secret_scan.secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    base = [s for s in expected if s[0] in secret_scan.BASE]
    assert (row.n_assign, row.n_access, row.n_hex) == (1, 1, 1) and len(expected) == 4
    assert row.base_sha256 == hashlib.sha256(join(base).encode()).hexdigest() and row.spans == join(expected)


def test_the_statement_finds_what_the_scan_finds(spark, secret_texts, tmp_path):
    from spendscope.llm.sql import SECRETS
    from spendscope_checks.compare import differences, duck

    # DuckDB folds more letters than ASCII's; here both cases are listed.
    rows = [(k, t) for k, t in enumerate(secret_texts) if len(t or "") < 10_000]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    table.toPandas().to_parquet(tmp_path / "documents.parquet")
    found = secret_scan.digests(secret_scan.secrets(table))
    assert differences(found, duck(str(tmp_path)), SECRETS) == []
