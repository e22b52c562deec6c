"""Sum-of-squares online packing of documents into fixed token windows.

A document is cut into full windows and a remainder; the remainder goes into
the fill level for which the sum of squared counts of partially filled windows
becomes smallest (a new window included among the choices).  The state is an
array with a count for every fill level and, per level, the windows that stand
there.  Every partition packs its own rows as they come, so there is no shuffle
and no driver work; when a partition ends, its remaining partial windows are
merged: pieces of the emptiest fill up the fullest, cut where needed, and what
is left is laid out in sequences whose lengths are powers of two, which need no
padding.
"""

from __future__ import annotations

import json
import os
import string
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import bounded_batches

WINDOW = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
CACHE = 250_000         # words whose ids a worker remembers (some 60 MB)
EMIT_ROWS = 2_000

SCHEMA = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, token_ids binary")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes every byte as a letter: printable bytes as
    themselves, the others as the letters from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


class WordEncoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    A tokenizer that drops white space and splits letters from other
    characters gives a blank-separated word the same ids wherever it stands, and
    a run of letters the same ids whatever ASCII signs follow it.  Both are
    remembered (the memory is emptied when it holds ``CACHE`` entries), and a
    run of letters goes straight to the tokenizer's BPE model.  Texts of any
    other tokenizer are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        steps = described.get("pre_tokenizer") or {}
        steps = [x.get("type") for x in steps.get("pretokenizers", [steps])]
        normal = [x.get("type") for x in (described.get("normalizer") or {}).get("normalizers", [])]
        # the one kind of tokenizer whose words and letter runs are known to be independent
        self.by_word = (steps == ["Split", "ByteLevel"] and normal == ["NFC", "Replace", "Lowercase"]
                        and described["model"].get("end_of_word_suffix") == "</w>")
        # texts with a special token in them, which may reach over words, are encoded whole
        self.special = [x["content"].lower() for x in described.get("added_tokens", [])]
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if not self.by_word or self.special and ("<" in text and any(map(text.lower().__contains__, self.special))):
            return self._whole(text)
        found = text.replace("\n", " ").split(" ")
        ids = list(map(self.known.get, found))
        if None in ids:
            if len(self.known) > CACHE:
                self.known.clear()
            ids = [self._word(w) if x is None else x for w, x in zip(found, ids)]
        return b"".join(ids)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        known = self.known
        if (ids := known.get(word)) is not None:
            return ids
        run = word.rstrip(string.punctuation)
        if not run.isalpha():
            ids = self._whole(word)
        elif len(run) < len(word):
            signs = word[len(run):]
            if (tail := known.get(signs)) is None:
                tail = known[signs] = self._whole(signs)
            ids = self._word(run) + tail
        else:
            ids = self._letters(run)
        known[word] = ids
        return ids

    def _letters(self, run: str) -> bytes:
        """Letters only: normalised as the tokenizer does it, character by
        character, and split by its BPE model."""
        lower = run.lower() if run.isascii() else "".join(map(str.lower, run))
        if lower != run and (ids := self.known.get(lower)) is not None:
            return ids
        if run.isascii():
            written = lower
        elif lower.isalpha() and unicodedata.is_normalized("NFC", run):
            written = "".join(map(self.letters.__getitem__, lower.encode("utf-8")))
        else:
            return self._whole(run)
        ids = array("I", [t.id for t in self.tokenizer.model.tokenize(written)]).tobytes()
        self.known[lower] = ids
        return ids


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Packer:
    """Sum-of-squares placement.  ``place`` takes a piece (any object) and its
    length and returns the windows that it completed."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)       # partially filled windows at each level
        self.at: list[list[list]] = [[] for _ in range(window)]

    def place(self, piece, size: int) -> list[list]:
        if size == self.window:
            return [[(piece, size)]]
        n = self.counts
        levels = np.flatnonzero(n[:self.window - size + 1])
        best, change = 0, 2 * n[size] + 1                   # a new window
        if len(levels):
            full = levels == self.window - size
            delta = np.where(full, 1 - 2 * n[levels], 2 * (n[levels + size] - n[levels]) + 2)
            i = len(delta) - 1 - int(np.argmin(delta[::-1]))  # ties: the fullest level
            if delta[i] <= change:
                best = int(levels[i])
        held = [] if best == 0 else self.at[best].pop()
        if best:
            n[best] -= 1
        held.append((piece, size))
        if best + size == self.window:
            return [held]
        n[best + size] += 1
        self.at[best + size].append(held)
        return []

    def rest(self) -> list[list]:
        """The partially filled windows, the fullest first."""
        return [w for level in reversed(self.at) for w in level]


def _cut(piece, size: int, at: int):
    """A piece is (document, start): its head of ``at`` ids and its tail."""
    document, start = piece
    return ((document, start), at), ((document, start + at), size - at)


def merged(open_windows: list[list], window: int = WINDOW) -> list[list]:
    """Partial windows (the fullest first) to full ones, and what remains to
    sequences whose lengths are powers of two."""
    done, windows = [], [list(w) for w in open_windows]
    i, j = 0, len(windows) - 1
    fill = [sum(s for _, s in w) for w in windows]
    while i < j:
        piece, size = windows[j].pop()
        room = window - fill[i]
        if size > room:
            (head, a), tail = _cut(piece, size, room)
            windows[j].append(tail)
            piece, size = head, a
        windows[i].append((piece, size))
        fill[i] += size
        fill[j] -= size
        if fill[i] == window:
            done.append(windows[i])
            i += 1
        if fill[j] == 0:
            j -= 1
    if i == j and fill[i]:
        left, total = windows[i][::-1], fill[i]
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            out = []
            while room:
                piece, size = left.pop()
                if size > room:
                    head, tail = _cut(piece, size, room)
                    left.append(tail)
                    piece, size = head
                out.append((piece, size))
                room -= size
            done.append(out)
    return done


def _pack_partition(path: str, window: int, end_id: int):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        packer = Packer(window)
        pid, made, rows = TaskContext.get().partitionId(), 0, []

        def emit(sequence):
            nonlocal made
            offset, number = 0, (pid << 33) | made
            made += 1
            for ((doc_id, ids, total), start), size in sequence:
                at = start - ids[1]
                rows.append((doc_id, start, size, total, number, offset, ids[0][4 * at:4 * (at + size)]))
                offset += size

        def out():
            columns = list(zip(*rows)) or [[]] * 7
            rows.clear()
            types = [pa.int64()] * 6 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                              names=["doc_id", "start", "length", "doc_tokens", "sequence_id",
                                                     "offset", "token_ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    size = min(window, total - start)
                    # a piece keeps its own ids only, not those of its whole document
                    own = (ids[4 * start:4 * (start + size)], start)
                    for sequence in packer.place(((doc_id, own, total), start), size):
                        emit(sequence)
                if len(rows) >= EMIT_ROWS:
                    yield out()
        for sequence in merged(packer.rest(), window):
            emit(sequence)
        yield out()

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it),
    length, doc_tokens, sequence_id, offset (in its sequence) and token_ids
    (little-endian unsigned 32-bit).

    Every document is its token ids followed by ``end_id``; null and empty
    texts are the end id alone.  Ids and repeated rows pass through as they are
    (null ids too).  A sequence number is the task's number and a counter, so
    it does not depend on other tasks; a task that is run again reads the same
    rows and packs them alike.  An empty table gives no rows; other columns are
    not read.
    """
    bounded_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(_pack_partition(path, window, end_id), SCHEMA))
