"""Secret scans: keywords first, anchored expressions near them, then the checksums that some secrets carry.

1. One Aho-Corasick automaton finds the keywords of all kinds in the text with A-Z lower-cased.
   A run of hexadecimal digits has no keyword: probes at every sixth byte take its place, four
   of which in a row must be such digits in any run of 24.
2. A kind's expression is matched at its hits only, from left to right; a hit within the
   previous match of its kind is passed over, so matches are those of a scan of the whole text.
3. Tokens with a checksum of their own are kept only if it is right: GitHub and npm tokens end in
   the CRC-32 of their 30 characters in base 62, age keys are Bech32 strings.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that are scanned before their spans are handed on.
SLICE_ROWS = 512
# The digits of base 62, those of Bech32 and the generator of its checksum.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def crc_base62(body: str) -> str:
    """The CRC-32 of a token's characters in six digits of base 62."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def bech32_remainder(prefix: str, digits: Iterable[int]) -> int:
    """The remainder of a Bech32 string without its separator; 1 if its checksum is right."""
    spread = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]
    value = 1
    for digit in [*spread, *digits]:
        top = value >> 25
        value = (value & 0x1FFFFFF) << 5 ^ digit
        for k, generator in enumerate(BECH32_GENERATOR):
            value ^= generator if top >> k & 1 else 0
    return value


def _is_token(found: re.Match) -> bool:
    body = found[0].partition("_")[2]
    return len(body) == 36 and crc_base62(body[:30]) == body[30:]


def _is_age_key(found: re.Match) -> bool:
    prefix, _, data = found[0].lower().rpartition("1")
    digits = [BECH32.find(c) for c in data]
    return len(digits) == 58 and min(digits) >= 0 and bech32_remainder(prefix, digits) == 1


class Kind(NamedTuple):
    """An expression that begins with one of the lower-case keywords, and what its matches must fulfil."""

    name: str
    keywords: tuple[str, ...]
    expression: re.Pattern
    valid: Callable[[re.Match], bool]


_ASSIGNED = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    Kind(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(_ASSIGNED, re.IGNORECASE | re.ASCII),
        lambda found: len(found[2]) >= 6,
    ),
    Kind("access", ("akia",), re.compile("AKIA[A-Z0-9]+"), lambda found: len(found[0]) >= 20),
    Kind("hex", (), re.compile("[0-9a-f]+"), lambda found: len(found[0]) >= 24),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile("gh[pousr]_[0-9A-Za-z]+"), _is_token),
    Kind("npm", ("npm_",), re.compile("npm_[0-9A-Za-z]+"), _is_token),
    Kind("age", ("age-secret-key-1",), re.compile("AGE-SECRET-KEY-1[0-9A-Z]+"), _is_age_key),
)
BASE = ("assign", "access", "hex")

_HEX_DIGIT = np.zeros(256, bool)
_HEX_DIGIT[[ord(c) for c in "0123456789abcdef"]] = True
_HEX_RUN = re.compile(rb"[0-9a-f]+")
_PROBE, _PROBES, _HEX_LENGTH = 6, 4, 24


def hex_runs(data: bytes) -> Iterator[tuple[int, int]]:
    """First byte and end of the longest runs of 24 or more hexadecimal digits."""
    probes = _HEX_DIGIT[np.frombuffer(data, np.uint8)[::_PROBE]]
    if len(probes) < _PROBES:
        return
    near = probes[: len(probes) - _PROBES + 1].copy()
    for k in range(1, _PROBES):
        near &= probes[k : len(probes) - _PROBES + 1 + k]
    end = 0
    for at in (np.flatnonzero(near) * _PROBE).tolist():
        if at < end:
            continue
        start = at
        while start > end and _HEX_DIGIT[data[start - 1]]:
            start -= 1
        end = _HEX_RUN.match(data, start).end()
        if end - start >= _HEX_LENGTH:
            yield start, end


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for number, kind in enumerate(KINDS):
        for keyword in kind.keywords:
            found.add_word(keyword, (number, len(keyword)))
    found.make_automaton()
    return found


def _code_points(data: bytes, places: list[int]) -> list[int]:
    """Numbers of the characters that begin at these bytes, in ascending order."""
    if data.isascii():
        return places
    begins = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    edges = np.r_[0, np.array(places, np.int64)]
    return np.cumsum([int(np.count_nonzero(begins[a:b])) for a, b in zip(edges[:-1], edges[1:])]).tolist()


def spans(text: str, keywords: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of a text's secrets, in order; places are code points, ends exclusive."""
    data = text.encode()
    folded = data.lower()  # of bytes: A to Z only, so places stay
    hits: list[list[int]] = [[] for _ in KINDS]
    for end, (number, length) in keywords.iter(folded.decode()):
        hits[number].append(end - length + 1)
    found = []
    for number, (kind, starts) in enumerate(zip(KINDS, hits)):
        last = 0
        for start in sorted(starts):
            if start >= last and (match := kind.expression.match(text, start)):
                last = match.end()
                if kind.valid(match):
                    found.append((start, number, last))
    runs = list(hex_runs(data))
    places = iter(_code_points(data, [place for run in runs for place in run]))
    number = BASE.index("hex")
    found += [(start, number, end) for start, end in zip(places, places)]
    return sorted(found)


_SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keywords = _automaton()
    for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
        found = [
            [{"kind": KINDS[k].name, "start": a, "end": b} for a, k, b in spans(text, keywords)] if text else []
            for text in (value.as_py() for value in batch.column(1))
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPAN_TYPE)], ["row", "spans"])


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for each row; spans are (kind, start, end) by start, then in the order of KINDS.

    Kinds ``assign``, ``access`` and ``hex`` are the longest matches of their expressions, from
    left to right, without overlaps within a kind; ``github``, ``npm`` and ``age`` are tokens
    whose checksum is right. Spans of different kinds may overlap. Places count code points. Null and
    empty texts have no spans. Rows that repeat an id, and rows without one, are rows of their own.
    Other columns don't matter. Letters in either case are those of ASCII.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan, f"row long, spans {_SPANS}").withColumnRenamed("row", id_col)


def listed(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans and the list of all spans, in place of the spans."""

    def of(kinds: Iterable[str]) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of([kind])).cast("long").alias(f"n_{kind}") for kind in BASE]
    others = [c for c in found.columns if c != "spans"]
    digest = F.sha2(listed(of(BASE)).cast("binary"), 256).alias("base_sha256")
    return found.select(*others, *counts, digest, listed(F.col("spans")).alias("spans"))
