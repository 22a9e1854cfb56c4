"""Packing token ids into windows by minimum bin slack.

Every document becomes ids plus an end id. Whole windows are cut off its front; what remains goes into the
pool of its task. A window takes the longest remainder and then the multiset of remaining lengths that comes
closest to its capacity: a subset-sum over a bitset of reachable fills, length by length, and the counts are
traced back. Where no multiset fills the window, the next remainder is cut, so only the last window of a
task is padded. Tasks pack what their own split of the input holds: nothing is shuffled, and a task that is
run again gives the same sequences. The pool is emptied to half when it holds `POOL` remainders.

Null texts count as empty and give the end id alone. Repeated rows are packed each for itself.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gridloom.llm.bpe import ALONE, codec, forget
from gridloom.llm.common import small_batches

WINDOW = 2048
END_ID = 1
POOL = 4096
SEQUENCES_PER_TASK = 1 << 36
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def fill_counts(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Lengths and how many of each, with the largest sum of at most ``capacity``."""
    return _fill(sorted(counts), counts.__getitem__, capacity)


def _fill(lengths: list[int], count: Callable[[int], int], capacity: int) -> dict[int, int]:
    """The same for lengths in rising order; only those that are tried are counted."""
    full, mask = 1 << capacity, (1 << capacity + 1) - 1
    reach, trail = 1, []
    for at in range(bisect_right(lengths, capacity) - 1, -1, -1):
        length = lengths[at]
        left, step = min(count(length), capacity // length), 1
        while left and not reach & full:
            step = min(step, left)
            trail.append((reach, length, step))
            reach |= reach << length * step & mask
            left, step = left - step, step * 2
        if reach & full:
            break
    at, chosen = reach.bit_length() - 1, defaultdict(int)
    for before, length, step in reversed(trail):
        if not before >> at & 1:
            chosen[length] += step
            at -= length * step
    return dict(chosen)


class Packer:
    """Rows of pieces; ``pool`` has the remainders by length, ``lengths`` these lengths in rising order."""

    def __init__(self, base: int, window: int):
        self.sequence, self.window = base, window
        self.pool: dict[int, deque] = {}
        self.lengths: list[int] = []
        self.size = 0
        self.rows: list[tuple] = []

    def _place(self, piece: tuple, offset: int) -> int:
        doc, start, ids, total = piece
        self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset))
        return offset + len(ids)

    def add(self, doc: int, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            self._place((doc, start, ids[start : start + self.window], total), 0)
            self.sequence += 1
        if whole < total:
            self._keep((doc, whole, ids[whole:], total))
        if self.size >= POOL:
            self.drain(POOL // 2)

    def _keep(self, piece: tuple) -> None:
        length = len(piece[2])
        if length not in self.pool:
            self.pool[length] = deque()
            insort(self.lengths, length)
        self.pool[length].append(piece)
        self.size += 1

    def _take(self, length: int) -> tuple:
        queue = self.pool[length]
        piece = queue.popleft()
        if not queue:
            del self.pool[length]
            del self.lengths[bisect_left(self.lengths, length)]
        self.size -= 1
        return piece

    def drain(self, until: int) -> None:
        while self.size > until:
            offset = self._place(self._take(self.lengths[-1]), 0)
            chosen = _fill(self.lengths, lambda n: len(self.pool[n]), self.window - offset)
            for length, count in chosen.items():
                for _ in range(count):
                    offset = self._place(self._take(length), offset)
            if offset < self.window and self.pool:
                doc, start, ids, total = self._take(self.lengths[-1])
                room = self.window - offset
                self._place((doc, start, ids[:room], total), offset)
                self._keep((doc, start + room, ids[room:], total))
            self.sequence += 1


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, keep: bool = True) -> DataFrame:
    """One row per piece: where it starts in its document, how long it is, its sequence and place there.

    ``keep`` tells whether a worker keeps the vocabulary for its next task. It does not where other stages use the
    same workers and need their memory; it then also remembers less of the words it has met.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, end = codec(path, ALONE if keep else 1), np.array([end_id], "<u4")
        packer = Packer(TaskContext.get().partitionId() * SEQUENCES_PER_TASK, window)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for doc, ids in zip(batch["doc_id"].astype(object), code.encode_many(batch["text"])):
                packer.add(None if pd.isna(doc) else int(doc), np.concatenate([ids, end]))
            yield pd.DataFrame(packer.rows, columns=names).astype({"doc_id": "Int64"})
            packer.rows = []
        packer.drain(0)
        yield pd.DataFrame(packer.rows, columns=names).astype({"doc_id": "Int64"})
        if not keep:
            del code, packer
            forget()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)
