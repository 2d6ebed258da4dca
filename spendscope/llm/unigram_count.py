"""Token counts of a unigram tokenizer, without tokens: Viterbi that carries a score and a count.

A text is a sequence of words that each begin with the word mark; no piece of the vocabulary
reaches over one, nor over a character that no piece holds. So the counts of the parts between
these add up, and each different part is worked out once per Python worker, while it remembers
it. An Aho-Corasick automaton lists the pieces that end at each character, the longest first.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
# Parts whose counts a Python worker remembers.
CACHED_PARTS = 1 << 20


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece file; no unknown, control or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(k), model.get_score(k))
        for k in range(model.get_piece_size())
        if not (model.is_unknown(k) or model.is_control(k) or model.is_byte(k) or model.is_unused(k))
    ]


class PieceCounter:
    """Counts of pieces in texts by a vocabulary of scored pieces, with one token for each byte of other characters.

    Of segmentations with equal scores, at each end the piece that begins first wins, as in the
    public tokenizers library. Scores are added in double precision from a part's beginning.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        # A word holds its mark at the beginning only.
        inside = [(piece, score) for piece, score in vocabulary if piece and MARK not in piece[1:]]
        alone = {piece for piece, _ in inside if len(piece) == 1}
        lost = {c for piece, _ in inside for c in piece} - alone
        if lost:
            raise ValueError(f"characters in pieces but not pieces themselves: {sorted(lost)[:5]}")
        self.automaton = ahocorasick.Automaton()
        for piece, score in inside:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        known = "".join(map(re.escape, sorted(alone - {MARK})))
        mark = MARK if MARK in alone else ""
        self.parts = re.compile(f"{mark}?[{known}]+|{mark}" if mark else f"[{known}]+")
        self.remembered: dict[str, int] = {}

    def count_part(self, part: str) -> int:
        """Pieces of the best segmentation; all characters are pieces."""
        best = [0.0] + [-float("inf")] * len(part)
        count = [0] * (len(part) + 1)
        for last, (length, score) in self.automaton.iter(part):
            start = last + 1 - length
            total = best[start] + score
            # Longer pieces come first, so an equal score does not replace one.
            if total > best[last + 1]:
                best[last + 1] = total
                count[last + 1] = count[start] + 1
        return count[-1]

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        if not marked.startswith(MARK):
            marked = MARK + marked
        parts = self.parts.findall(marked)
        known = self.remembered
        try:
            total = sum(map(known.__getitem__, parts))
        except KeyError:
            new = {p: self.count_part(p) for p in set(parts).difference(known)}
            total = sum(new[p] if p in new else known[p] for p in parts)
            if len(known) < CACHED_PARTS:
                known.update(new)
        return total + len(marked.encode()) - len("".join(parts).encode())


@lru_cache(maxsize=2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(unigram_vocabulary(path))


def _counted(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counter = _counter(path)
        counts = [counter.count(text.as_py() or "") for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["row", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) for each row, by the pieces and scores of the file ``tokenizer``, taken as a unigram model.

    Spaces are word marks, and a text without one at its beginning gets one. A null or empty
    text has no tokens. Ids may be null or repeat; other columns don't matter.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    counted = texts.mapInArrow(partial(_counted, path=tokenizer), "row long, n_tokens long")
    return counted.withColumnRenamed("row", id_col)
