"""Cost-balanced packing of documents into token sequences.

A piece of n tokens costs linear * n + quadratic * n * n (attention stays inside a
piece). Documents wait in a window of many sequences' tokens; the window's documents, in
descending cost, go to the lowest-cost sequence that has room for them, and are cut only
where none has. What a window can't fill is carried to the next one. Windows are filled
inside Spark's partitions, so nothing is shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cohortaudit.llm.common import map_rows, project
from cohortaudit.llm.tokens import encoder, vocabulary

LENGTH = 4096
#: Tokens in a window, as a number of sequences.
WINDOW = 256
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n, linear: float = 1.0, quadratic: float = 1.0 / 1024):
    """Estimated training cost of a piece of n tokens."""
    return linear * n + quadratic * n * n


def assign(lengths: list[int], rooms: list[int]) -> list[tuple[int, int, int, int]]:
    """Lay pieces of the lengths in sequences with the rooms; -> (piece, start in it, length, sequence).

    Pieces go in descending cost (ties: as given) to the lowest-cost sequence with room
    for the whole piece (ties: the first), else they fill the lowest-cost one that has
    any room. Room must not be more than the tokens there are; tokens beyond the room
    are left out of the answer, from the pieces last laid.
    """
    room, load = np.array(rooms, np.int64), np.zeros(len(rooms))
    laid = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at, rest = 0, lengths[i]
        while rest:
            fits = room >= rest
            if not fits.any():
                fits = room > 0
                if not fits.any():
                    return laid
            s = int(np.where(fits, load, np.inf).argmin())
            n = min(rest, int(room[s]))
            laid.append((i, at, n, s))
            room[s] -= n
            load[s] += cost(n)
            at, rest = at + n, rest - n
    return laid


def powers(n: int) -> list[int]:
    """n as a sum of powers of two, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Packs one partition's documents. A document is [doc_id, start, ids, doc_tokens]."""

    def __init__(self, first_sequence: int, length: int, window: int):
        self.sequence, self.length, self.window = first_sequence, length, window
        self.waiting: list[tuple] = []
        self.tokens = 0

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        """Whole sequences are cut off a long document at once; the rest waits."""
        done = []
        cut = len(ids) // self.length * self.length
        for at in range(0, cut, self.length):
            done += self._rows([(doc_id, at, ids[at : at + self.length], len(ids))], [(0, 0, self.length, 0)], 1)
        if cut < len(ids):
            self.waiting.append((doc_id, cut, ids[cut:], len(ids)))
            self.tokens += len(ids) - cut
        return done + (self.flush() if self.tokens >= self.window * self.length else [])

    def flush(self, last: bool = False) -> list[tuple]:
        """Fill as many sequences as there are tokens for; at the last, also those of powers of two."""
        rooms = [self.length] * (self.tokens // self.length) + (powers(self.tokens % self.length) if last else [])
        laid = assign([len(x[2]) for x in self.waiting], rooms)
        done = self._rows(self.waiting, laid, len(rooms))
        ends = np.zeros(len(self.waiting), np.int64)
        for i, at, n, _ in laid:
            ends[i] = at + n
        self.waiting = [(d, start + int(e), ids[e:], total) for (d, start, ids, total), e in zip(self.waiting, ends) if e < len(ids)]
        self.tokens = sum(len(x[2]) for x in self.waiting)
        return done

    def _rows(self, docs, laid, n_sequences: int) -> list[tuple]:
        used = [0] * n_sequences
        out = []
        for i, at, n, s in laid:
            doc_id, start, ids, total = docs[i]
            out.append((doc_id, start + at, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes()), total, self.sequence + s, used[s]))
            used[s] += n
        self.sequence += n_sequences
        return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every sequence is `length` tokens long, or, at a partition's end, a power of two, so
    none needs padding. A null or empty text is the end id alone. Repeated rows are
    packed once each; a null doc_id stays null; no rows give none; other columns are not
    read. sequence_id is the partition's number and a count in it.
    """
    path = tokenizer or vocabulary()

    def rows(batches):
        encode = encoder(path).encode
        packer = Packer(TaskContext.get().partitionId() << 32, length, window)
        end = np.array([end_id], np.uint32)
        for ids, texts in batches:
            done = [row for d, t in zip(ids, texts) for row in packer.add(d, np.concatenate((encode(t), end)))]
            if done:
                yield [list(c) for c in zip(*done)]
        if done := packer.flush(last=True):
            yield [list(c) for c in zip(*done)]

    return map_rows(project(docs, id_col, text_col), rows, COLUMNS)
