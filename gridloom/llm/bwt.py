"""Burrows-Wheeler transforms of shards of strings and their merge by interleave refinement."""

from __future__ import annotations

import numpy as np

SHARD_BYTES = 1 << 18


class Shard:
    """Sorted rotations of a few strings: where each row starts, and the two symbols before it.

    Every string ends in a symbol below all bytes. Rotations are sorted by doubling the compared length.
    """

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) + 1 for s in strings], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        symbols = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        symbols[starts + sizes - 1] = 0
        n = len(symbols)
        first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        inner = np.arange(n) - first

        def later(step: int) -> np.ndarray:
            return first + (inner + step) % size

        key = symbols
        for step in (1, 2, 4):
            key = key << np.uint64(8 * step) | key[later(step)]
        step, longest = 8, int(sizes.max())
        while True:
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            rank = np.empty(n, dtype=np.uint64)
            rank[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]]).astype(np.uint64)
            if step >= longest:
                break
            key = rank * np.uint64(n) + rank[later(step)]
            step *= 2
        before = later(-1)
        self.string = np.repeat(np.arange(len(strings)), sizes)[order]
        self.offset = inner[order]
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        self.front = place[before[before]][order]  # the row that begins with the two symbols before this one
        self.pairs = (symbols[before[before]] << np.uint64(8) | symbols[before])[order].astype(np.uint16)


def merged(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all shards that share their first ``depth`` symbols with another row, and each row's class.

    The interleave starts as one shard after the other, sorted by no symbol. Each step reads the two symbols in
    front of the rows, in interleaved order, sorts them stably and moves to the rows that begin with them: that
    is the interleave by two symbols more. A border between neighbours stays where they differ in these symbols
    or came from different classes, so neighbours of one class have a common prefix of that length. A row alone
    in its class leaves, for whatever stands in front of it is alone too. No suffix is compared again.
    """
    starts = np.cumsum([0] + [len(s.pairs) for s in shards])
    place = np.int32 if starts[-1] < 1 << 31 else np.int64
    pairs = np.concatenate([s.pairs for s in shards])
    front = np.concatenate([s.front + start for s, start in zip(shards, starts)]).astype(place)
    rows, group = np.arange(len(pairs), dtype=place), np.zeros(len(pairs), dtype=place)
    for _ in range(depth // 2):
        symbols = pairs[rows]
        order = np.argsort(symbols, kind="stable")
        symbols, group, rows = symbols[order], group[order], front[rows[order]]
        border = np.ones(len(rows) + 1, dtype=bool)
        np.not_equal(symbols[1:], symbols[:-1], out=border[1:-1])
        border[1:-1] |= group[1:] != group[:-1]
        shared = ~(border[:-1] & border[1:])
        rows, group = rows[shared], np.cumsum(border[:-1], dtype=place)[shared]
    return rows, group


def shards_of(strings: list[bytes]) -> list[list[int]]:
    """Numbers of the strings of each shard."""
    out, size = [[]], 0
    for i, s in enumerate(strings):
        if size >= SHARD_BYTES:
            out.append([])
            size = 0
        out[-1].append(i)
        size += len(s) + 1
    return out


def repeated(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, string, offset) of every place whose ``depth`` bytes stand elsewhere too, sorted by class."""
    parts = shards_of(strings)
    shards = [Shard([strings[i] for i in part]) for part in parts]
    rows, group = merged(shards, depth)
    string = np.concatenate([np.array(part)[s.string] for part, s in zip(parts, shards)])[rows]
    offset = np.concatenate([s.offset for s in shards])[rows]
    whole = offset + depth <= np.array([len(s) for s in strings])[string]
    return group[whole], string[whole], offset[whole]
