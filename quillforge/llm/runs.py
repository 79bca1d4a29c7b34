"""Sorted runs of integers as zstd-compressed blocks, and the merge of their blocks (used inside Arrow tasks)."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import zstandard

U64 = np.uint64
#: Integers of one column in a block.
BLOCK = 1 << 15


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all integers, then the second ones, and so on: high bytes are mostly equal and compress to nothing."""
    return np.ascontiguousarray(values.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8).T.tobytes()


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """A block of ascending keys, stored as differences, with other columns of integers beside them."""
    return zstandard.compress(b"".join([_planes(np.diff(keys.astype(U64, copy=False), prepend=U64(0))), *map(_planes, columns)]), 1)


def unpack(block: bytes, columns: int = 0) -> list[np.ndarray]:
    """The keys and the given number of other columns."""
    data = np.frombuffer(zstandard.decompress(block), np.uint8)
    parts = data.reshape(1 + columns, 8, -1)
    values = [np.ascontiguousarray(p.T).view("<u8").reshape(-1) for p in parts]
    return [np.cumsum(values[0], dtype=U64), *values[1:]]


def cuts(n: int, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    return ((i, min(n, i + size)) for i in range(0, n, size))


def summed(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Each key once, ascending, with the sums of its other columns."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return [keys[first], *(np.add.reduceat(c[order], first) if len(keys) else c for c in columns)]


def merged(blocks: Iterable[list[np.ndarray]], least: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """k-way merge of blocks (ascending keys, columns to be added up) that come in order of their first keys.

    The heap holds the open blocks by their last key. Keys below the first key of the next block can't come again: blocks
    that end there are taken off the heap, the others are cut there. Memory: the blocks that overlap, one or two a run."""
    heap: list[tuple[int, int, list[np.ndarray]]] = []
    held, limit = 0, least

    def below(fence: int | None) -> list[list[np.ndarray]]:
        nonlocal heap, held
        done = []
        while heap and (fence is None or heap[0][0] < fence):
            done.append(heapq.heappop(heap)[2])
        rest = []
        for last, serial, block in heap:
            at = int(np.searchsorted(block[0], U64(fence)))
            if at:
                done.append([c[:at] for c in block])
                block = [c[at:] for c in block]
            rest.append((last, serial, block))
        heap = rest
        heapq.heapify(heap)
        held = sum(len(b[2][0]) for b in heap)
        return done

    for serial, block in enumerate(blocks):
        if held >= limit:
            if done := below(int(block[0][0])):
                yield summed(*map(np.concatenate, zip(*done, strict=True)))
            limit = max(least, 2 * held)
        if len(block[0]):
            heapq.heappush(heap, (int(block[0][-1]), serial, block))
            held += len(block[0])
    if done := below(None):
        yield summed(*map(np.concatenate, zip(*done, strict=True)))


def store(values: np.ndarray) -> bytes:
    """Integers in any order."""
    return zstandard.compress(_planes(values), 1)


def load(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def in_groups(batches: Iterable, names: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """The rows of Arrow batches, which begin with the named columns and come in their order, group by group."""
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
    return itertools.groupby(rows, lambda r: r[: len(names)])
