"""Packing of tokenized documents into sequences of a fixed length.

Each partition packs what it reads online, with a bounded number of open sequences: a piece
goes to the open sequence it fits best; when none fits and no more may be opened, the fullest
one is filled up with the head of the piece and emitted. At its end a partition joins its open
sequences and hands on less than one sequence. These leftovers are packed in the same way, in
rounds of up to MERGED partitions per task, until one task is left; it pads the last one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm.textwords import sorted_groups
from spendscope.session import cut_lineage

LENGTH = 4096
OPEN_SEQUENCES = 64
# A gap of fewer tokens is padded rather than filled with the head of a document.
SMALLEST_CUT = 16
END_ID = 2
MERGED = 256
# Words, and parts of words, whose ids a Python worker remembers, about; longer ones it doesn't.
# Some 120 bytes each, in every worker of an executor.
CACHED_WORDS = 1 << 18
CACHED_PARTS = 1 << 18
CACHED_BYTES = 64
# Rows that are tokenized at once.
ROWS = 512


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    doc_tokens: int
    ids: np.ndarray


class Packer:
    """Best fit into a bounded number of open sequences; ``emitted`` are the closed ones."""

    def __init__(self, length: int = LENGTH, open_sequences: int = OPEN_SEQUENCES, smallest_cut: int = SMALLEST_CUT):
        self.length, self.limit, self.smallest = length, open_sequences, smallest_cut
        self.open: list[list[Piece]] = []
        self.free: list[int] = []
        self.emitted: list[list[Piece]] = []

    def _split(self, piece: Piece, at: int) -> tuple[Piece, Piece]:
        return piece._replace(ids=piece.ids[:at]), piece._replace(start=piece.start + at, ids=piece.ids[at:])

    def add(self, piece: Piece) -> None:
        while len(piece.ids) >= self.length:
            head, piece = self._split(piece, self.length)
            self.emitted.append([head])
        while len(piece.ids):
            size = len(piece.ids)
            best = min((k for k, f in enumerate(self.free) if f >= size), key=self.free.__getitem__, default=None)
            if best is None and len(self.open) < self.limit:
                self.open.append([])
                self.free.append(self.length)
                best = len(self.open) - 1
            if best is not None:
                self.open[best].append(piece)
                self.free[best] -= size
                if not self.free[best]:
                    self._emit(best)
                return
            fullest = min(range(len(self.open)), key=self.free.__getitem__)
            if self.free[fullest] >= self.smallest:
                head, piece = self._split(piece, self.free[fullest])
                self.open[fullest].append(head)
            self._emit(fullest)

    def _emit(self, k: int) -> None:
        self.emitted.append(self.open.pop(k))
        self.free.pop(k)

    def leftover(self) -> list[Piece]:
        """Join the open sequences: the fullest ones are filled from the emptiest; less than one remains."""
        rest = [s for _, s in sorted(zip(self.free, self.open), key=lambda x: x[0])]
        self.open, self.free = [], []
        current: list[Piece] = []
        room = self.length
        while rest:
            # Whole sequences first; a started one is filled with the smallest that are left.
            for piece in rest.pop(0 if room == self.length else -1):
                while len(piece.ids) >= room:
                    head, piece = self._split(piece, room)
                    self.emitted.append([*current, head])
                    current, room = [], self.length
                if len(piece.ids):
                    current.append(piece)
                    room -= len(piece.ids)
        return current


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


@lru_cache(maxsize=4)
def _letter_tokenizer(path: str):
    """The same merges for texts of normalised letters and blanks, where white space alone splits."""
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.normalizer = None
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return tokenizer


# Marks that end a word's last piece, whatever follows them; an apostrophe may open a piece.
_MARKS = bytes(sorted(set(range(0x21, 0x7F)) - {ord("'")} - set(b"0123456789") - {*range(65, 91), *range(97, 123)}))
_JOINED = 1024
# Up to here all letters are those of every Unicode version in use.
_LAST_LATIN = "\u024f"


def _short(found: dict[bytes, bytes]) -> Iterable[tuple[bytes, bytes]]:
    return ((part, ids) for part, ids in found.items() if len(part) <= CACHED_BYTES)


class WordIds:
    """Ids of words by a tokenizer that drops white space between words and marks their ends.

    Its normalisation and its splitting never reach over ASCII white space, nor from a letter to
    the marks behind it, so the ids of a text are those of such parts, one after the other. Each
    is encoded once in a slice of texts; the first short ones are remembered.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.of_letters = _letter_tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    @staticmethod
    def _split(word: bytes) -> tuple[bytes, bytes]:
        if word.isalnum():  # of ASCII only
            return word.lower(), b""
        core = word.rstrip(_MARKS)
        if core.isalnum():
            return core.lower(), word[len(core) :]
        if core and core.decode()[-1].isalpha():
            return core, word[len(core) :]
        return word, b""

    def _alone(self, part: bytes) -> bytes:
        encoded = self.tokenizer.encode_batch_fast([part.decode()], add_special_tokens=False)
        return np.array(encoded[0].ids, np.uint32).tobytes()

    def _encoded(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """Parts of Latin letters are one piece each; many are encoded in one go and cut at their ends."""
        plain, accented, found = [], [], {}
        for part in parts:
            if part.isalpha():
                plain.append(part)
            elif (text := part.decode()).isalpha() and max(text) <= _LAST_LATIN:
                accented.append(part)
            else:
                found[part] = self._alone(part)
        for letters in (plain, accented):
            for k in range(0, len(letters), _JOINED):
                found.update(self._of_letters(letters[k : k + _JOINED], normal=letters is plain))
        return found

    def _of_letters(self, some: list[bytes], normal: bool) -> Iterable[tuple[bytes, bytes]]:
        """Ids of parts of letters; normal: they are lower case ASCII, which the normaliser leaves alone."""
        text = b" ".join(some).decode()
        if not normal and self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
            if not text.replace(" ", "").isalpha():  # a letter has become a letter and a mark
                return [(part, self._alone(part)) for part in some]
        ids = np.array(self.of_letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist()
        if len(ends) != len(some):
            return [(part, self._alone(part)) for part in some]
        data = ids.tobytes()
        return ((p, data[a:b]) for p, a, b in zip(some, [0, *ends], ends))

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        split = [self._split(word) for word in words]
        parts = dict.fromkeys(part for pair in split for part in pair if part and part not in self.parts)
        found = self._encoded(list(parts))
        if len(self.parts) < CACHED_PARTS:
            self.parts.update(_short(found))
        known = self.parts
        return {
            word: b"".join([found[p] if p in found else known[p] for p in pair if p]) for word, pair in zip(words, split)
        }

    def ids(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text; about a megabyte of texts is looked up at a time."""
        at = 0
        while at < len(texts):
            words, ends, size = [], [], 0
            while at < len(texts) and size < 1 << 20:
                words.extend(texts[at].split())
                ends.append(len(words))
                size += len(texts[at])
                at += 1
            found = list(map(self.words.get, words))
            gaps = [k for k, ids in enumerate(found) if ids is None]
            if gaps:
                new = self._new(list({words[k] for k in gaps}))
                if len(self.words) < CACHED_WORDS:
                    self.words.update(_short(new))
                for k in gaps:
                    found[k] = new[words[k]]
            for first, end in zip([0, *ends], ends):
                yield np.frombuffer(b"".join(found[first:end]), np.uint32)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for each Python worker."""
    return WordIds(path)


_ROWS = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "task long, ids binary"
)
_FIELDS = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task")]
    + [("ids", pa.binary())]
)


def _rows(sequences: list[list[Piece]], first_id: int, task: int, leftover: bool) -> pa.RecordBatch:
    """One row per piece; those of a leftover keep their ids and have no sequence yet."""
    rows = []
    for number, pieces in enumerate(sequences):
        offset = 0
        for p in pieces:
            data = p.ids.astype("<u4").tobytes()
            size = len(p.ids)
            sequence = None if leftover else first_id + number
            rows.append(
                (p.doc_id, p.start, size, zlib.crc32(data), p.doc_tokens, sequence, offset, task, data if leftover else None)
            )
            offset += size
    columns = zip(*rows) if rows else [[] for _ in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS)], schema=_FIELDS)


def _first_id(round_: int, task: int) -> int:
    """Sequences are numbered by round, task and order in the task."""
    return (round_ << 58) + (task << 32)


def _pack_texts(batches: Iterable[pa.RecordBatch], path: str, end_id: int, length: int, windows: int):
    task = TaskContext.get().partitionId()
    packer, done = Packer(length, windows), 0
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        for doc_id, ids in zip(batch.column(0).to_pylist(), word_ids(path).ids(texts)):
            ids = np.append(ids, np.uint32(end_id))
            packer.add(Piece(doc_id, 0, len(ids), ids))
        yield _rows(packer.emitted, _first_id(0, task) + done, task, False)
        done += len(packer.emitted)
        packer.emitted = []
    rest = packer.leftover()
    yield _rows(packer.emitted, _first_id(0, task) + done, task, False)
    yield _rows([rest], 0, task, True)


def _pack_leftovers(batches: Iterable[pa.RecordBatch], round_: int, length: int, windows: int, last: bool):
    for (task,), table in sorted_groups(batches):
        packer = Packer(length, windows)
        for row in table.to_pylist():
            packer.add(Piece(row["doc_id"], row["start"], row["doc_tokens"], np.frombuffer(row["ids"], np.uint32)))
        rest = packer.leftover()
        if last and rest:
            packer.emitted.append(rest)
            rest = []
        yield _rows(packer.emitted, _first_id(round_, task), task, False)
        yield _rows([rest], 0, task, True)


def packed(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    length: int = LENGTH,
    open_sequences: int = OPEN_SEQUENCES,
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text (null: none) and ``end_id``; each id lies in one piece.
    All sequences but the last hold ``length`` ids or fewer by less than SMALLEST_CUT. Rows that
    repeat an id are documents of their own, a null id stays null, other columns don't matter;
    an empty table has no pieces. ``tokenizer`` is the path of a tokenizer file whose words end
    at white space; executors read it from there.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pack = partial(_pack_texts, path=tokenizer, end_id=end_id, length=length, windows=open_sequences)
    found = cut_lineage(texts.mapInArrow(pack, _ROWS))
    full, round_ = [], 0
    while True:
        full.append(found.where("sequence_id is not null"))
        left = found.where("sequence_id is null")
        largest = left.agg(F.max("task")).first()[0]
        if largest is None:
            break
        round_ += 1
        tasks = largest // MERGED + 1
        merge = partial(_pack_leftovers, round_=round_, length=length, windows=open_sequences, last=tasks == 1)
        dealt = left.withColumn("_from", F.col("task")).withColumn("task", F.floor(F.col("task") / MERGED))
        order = ["task", "_from", "offset"]
        columns = ["task", "doc_id", "start", "doc_tokens", "ids"]
        merged = dealt.repartitionByRange(tasks, "task").sortWithinPartitions(*order).select(*columns)
        found = cut_lineage(merged.mapInArrow(merge, _ROWS))
    result = full[0]
    for more in full[1:]:
        result = result.unionAll(more)
    return result.drop("task", "ids")
