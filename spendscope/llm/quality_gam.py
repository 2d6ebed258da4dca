"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its bins, each of a few pairs of features one
over pairs of bins. The tables are learnt by cyclic boosting: in turn, each feature gets a
shallow tree on the gradient of the log loss, added to its table at a small rate; the pairs
follow on what the features leave. A score is the sum of the looked-up values, so scoring is
one gather and one addition per table over a batch of texts.

Features are computed where the texts are. Training sees the features of a bounded sample of
labelled rows only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labelled rows that training reads at most, chosen by a hash of their ids.
TRAINING_ROWS = 20_000
# Rows whose crc32(id as text) modulo FOLDS is 0 are held out.
FOLDS = 5
THRESHOLD = 0.3

FEATURES = (
    "words",
    "mean_word",
    "long_words",
    "one_letter_words",
    "distinct_words",
    "top_word",
    "same_as_last",
    "repeated_pairs",
    "upper_words",
    "upper_letters",
    "digits",
    "marks_in_words",
    "punctuation",
    "end_marks",
    "bars",
    "other_symbols",
    "high_bytes",
    "white_space",
    "lines",
    "mean_line",
    "repeated_lines",
    "control_bytes",
)
_UPPER = np.arange(ord("A"), ord("Z") + 1)
_DIGITS = np.arange(ord("0"), ord("9") + 1)
_SPACES = np.array([0x20, *range(0x09, 0x0E)])
_PUNCTUATION = np.frombuffer(b",;:.!?'\"()-", np.uint8)
_END_MARKS = np.frombuffer(b"!?", np.uint8)
_LETTERS = np.r_[_UPPER, _UPPER + 32]
_PRINTED = np.arange(0x21, 0x7F)
_SYMBOLS = np.setdiff1d(_PRINTED, np.r_[_LETTERS, _DIGITS, _PUNCTUATION, ord("|")])


def text_features(text: bytes) -> list[float]:
    """The FEATURES of a whole text in UTF-8; all are shares or means but for logs of counts."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(1, len(text))
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    often = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [line for line in text.split(b"\n") if line.strip()]
    line_counts = Counter(lines)
    letters = max(1, int(counts[_LETTERS].sum()))
    joined = b" ".join(words)
    return [
        float(np.log1p(len(words))),
        float(lengths.mean()) if len(words) else 0.0,
        float((lengths > 12).sum()) / n,
        float((lengths == 1).sum()) / n,
        len(often) / n**0.8,
        max(often.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        sum(c for c in pairs.values() if c > 1) / n,
        sum(w.isupper() for w in words) / n,
        float(counts[_UPPER].sum()) / letters,
        float(counts[_DIGITS].sum()) / size,
        len([w for w in words if not w.isalpha()]) / n,
        float(counts[_PUNCTUATION].sum()) / size,
        float(counts[_END_MARKS].sum()) / size,
        float(counts[ord("|")]) / size,
        float(counts[_SYMBOLS].sum()) / size,
        float(counts[128:].sum()) / size,
        float(counts[_SPACES].sum() - max(0, len(words) - 1)) / size,
        float(np.log1p(len(lines))),
        float(len(joined)) / max(1, len(lines)) if lines else 0.0,
        sum(c - 1 for c in line_counts.values()) / max(1, len(lines)),
        float(counts[:9].sum() + counts[14:32].sum() + counts[127]) / size,
    ]


@dataclass(frozen=True)
class Settings:
    bins: int = 32
    rounds: int = 120
    pair_rounds: int = 40
    pairs: int = 8
    rate: float = 0.1
    leaves: int = 4
    # Second derivatives that a leaf needs at least, and the weight of a leaf value of 0.
    least_weight: float = 1.0
    shrink: float = 1.0


@dataclass(frozen=True)
class Model:
    """Bin edges and table of each feature; (i, j, table) of each pair."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, features: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, features[:, k], "right") for k, e in enumerate(self.edges)]

    def margins(self, features: np.ndarray) -> np.ndarray:
        bins = self.bins(features)
        total = np.full(len(features), self.base)
        for b, table in zip(bins, self.tables):
            total += table[b]
        for i, j, table in self.pairs:
            total += table[bins[i], bins[j]]
        return total

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margins(features)))


def _gain(g: np.ndarray, h: np.ndarray, shrink: float) -> np.ndarray:
    return g * g / (h + shrink)


def _tree(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    """Values of a tree with few leaves over the bins of a feature, best split first."""
    sums_g, sums_h = np.r_[0.0, np.cumsum(g)], np.r_[0.0, np.cumsum(h)]
    parts = [(0, len(g))]
    while len(parts) < s.leaves:
        best = (1e-12, None, None)
        for k, (lo, hi) in enumerate(parts):
            if hi - lo < 2:
                continue
            at = np.arange(lo + 1, hi)
            gl, hl = sums_g[at] - sums_g[lo], sums_h[at] - sums_h[lo]
            gr, hr = sums_g[hi] - sums_g[at], sums_h[hi] - sums_h[at]
            gain = _gain(gl, hl, s.shrink) + _gain(gr, hr, s.shrink) - _gain(gl + gr, hl + hr, s.shrink)
            gain[(hl < s.least_weight) | (hr < s.least_weight)] = -1.0
            top = int(np.argmax(gain))
            if gain[top] > best[0]:
                best = (float(gain[top]), k, int(at[top]))
        if best[1] is None:
            break
        lo, hi = parts.pop(best[1])
        parts += [(lo, best[2]), (best[2], hi)]
    values = np.zeros(len(g))
    for lo, hi in parts:
        values[lo:hi] = (sums_g[hi] - sums_g[lo]) / (sums_h[hi] - sums_h[lo] + s.shrink)
    return values


def _quadrants(g: np.ndarray, h: np.ndarray, s: Settings) -> tuple[float, np.ndarray]:
    """The best cut of a pair of features into four quadrants: its gain and its values."""
    cg, ch = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))

    def quadrants(c: np.ndarray) -> list[np.ndarray]:
        a = c[1:-1, 1:-1]
        left, top, all_ = c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return [a, left - a, top - a, all_ - left - top + a]

    if g.shape[0] < 2 or g.shape[1] < 2:
        return 0.0, np.zeros(g.shape)
    gs, hs = quadrants(cg), quadrants(ch)
    gain = sum(_gain(x, np.maximum(y, 0), s.shrink) for x, y in zip(gs, hs))
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    value = [x[i, j] / (max(y[i, j], 0) + s.shrink) for x, y in zip(gs, hs)]
    table = np.empty(g.shape)
    table[: i + 1, : j + 1], table[: i + 1, j + 1 :] = value[0], value[1]
    table[i + 1 :, : j + 1], table[i + 1 :, j + 1 :] = value[2], value[3]
    return float(gain[i, j]), table


def fit(features: np.ndarray, labels: np.ndarray, settings: Settings = Settings()) -> Model:
    """Learn the tables. Without rows of both labels, all scores are the share of label 1 (0.5 without rows)."""
    s = settings
    n = len(labels)
    share = (labels.sum() + 1.0) / (n + 2.0)
    edges = [
        np.unique(np.quantile(features[:, k], np.linspace(0, 1, s.bins + 1)[1:-1])) if n else np.zeros(0)
        for k in range(len(FEATURES))
    ]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Model(float(np.log(share / (1 - share))), edges, tables, [])
    if not n or labels.min() == labels.max():
        return model
    bins = model.bins(features)
    margin = np.full(n, model.base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-margin))
        return labels - p, np.maximum(p * (1 - p), 1e-9)

    for _ in range(s.rounds):
        for b, table in zip(bins, tables):
            g, h = gradients()
            step = s.rate * _tree(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)), s)
            table += step
            margin += step[b]
    g, h = gradients()

    def histogram(i: int, j: int, weights: np.ndarray) -> np.ndarray:
        shape = len(tables[i]), len(tables[j])
        return np.bincount(bins[i] * shape[1] + bins[j], weights, shape[0] * shape[1]).reshape(shape)

    gains = [
        (_quadrants(histogram(i, j, g), histogram(i, j, h), s)[0], i, j)
        for i in range(len(tables))
        for j in range(i + 1, len(tables))
    ]
    for _, i, j in sorted(gains, reverse=True)[: s.pairs]:
        model.pairs.append((i, j, np.zeros((len(tables[i]), len(tables[j])))))
    for _ in range(s.pair_rounds):
        for i, j, table in model.pairs:
            g, h = gradients()
            step = s.rate * _quadrants(histogram(i, j, g), histogram(i, j, h), s)[1]
            table += step
            margin += step[bins[i], bins[j]]
    return model


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _texts(batch: pa.RecordBatch) -> np.ndarray:
    texts = (x.as_py() or b"" for x in batch.column(0).cast(pa.binary()))
    return np.array([text_features(t) for t in texts], float).reshape(batch.num_rows, len(FEATURES))


def _training_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (text, others) as (others, features)."""
    for batch in batches:
        features = pa.array(list(_texts(batch)), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], features], [*batch.schema.names[1:], "features"])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = TRAINING_ROWS,
    settings: Settings = Settings(),
) -> Model:
    """A model of ``label_col`` from at most ``sample`` labelled rows that are not held out.

    Rows without a label or an id are not learnt from; labels that repeat an id count as often.
    Documents that repeat an id count as one of them, that with the smallest features.
    """
    chosen = (
        labels.select(F.col(id_col).alias("row"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("row").isNotNull() & F.col("label").isin(0, 1) & ~held_out("row"))
        .orderBy(F.xxhash64("row"), "row", "label")
        .limit(sample)
    )
    texts = docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text"))
    # The chosen rows are at most ``sample`` pairs of numbers, whatever the tables hold.
    chosen = chosen.groupBy("row", "label").agg(F.count("*").alias("times"))
    joined = texts.join(F.broadcast(chosen), "row").select("text", "row", "label", "times")
    ddl = f"row {joined.schema['row'].dataType.simpleString()}, label int, times long, features array<double>"
    learnt = joined.mapInArrow(_training_rows, ddl).groupBy("row", "label", "times").agg(F.min("features").alias("features"))
    rows = [r for r in learnt.select("label", "times", "features").collect() for _ in range(r["times"])]
    rows.sort(key=lambda r: (r["label"], r["features"]))  # sums don't depend on the order of arrival
    x = np.array([r["features"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["label"] for r in rows], float), settings)


def _scored(batches: Iterable[pa.RecordBatch], model: Model, name: str) -> Iterator[pa.RecordBatch]:
    """Rows of (text, others) as (others, score)."""
    for batch in batches:
        score = pa.array(model.scores(_texts(batch)), pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], score], [*batch.schema.names[1:], name])


def scored(
    docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, score_col: str = "score"
) -> DataFrame:
    """The columns ``keep`` (default: all) of each row, and the estimate that its label is 1.

    The score depends on the whole text only; a null text is an empty one. It takes the place of
    a column of ``docs`` that is called ``score_col``.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != score_col]
    text = "_" * (1 + max(map(len, docs.columns)))  # longer than any name, so another one
    kept = docs.select(F.col(text_col).alias(text), *(docs[c] for c in keep))
    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    added = f"`{score_col}` double"
    return kept.mapInArrow(partial(_scored, model=model, name=score_col), f"{ddl}, {added}" if ddl else added)
