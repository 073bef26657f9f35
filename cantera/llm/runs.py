"""Texts of an Arrow batch as runs of bytes, so that every distinct run is handled once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are worked on at a time; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20
# Memory for the distinct runs that a task remembers; beyond it the task starts anew.
REMEMBERED_BYTES = 64 << 20
# What a remembered run takes beside its bytes and ids, and the runs that are encoded at a time.
ENTRY_BYTES = 190
ENCODED_AT_ONCE = 20_000


def buffers(texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """(buffer, its bytes, offsets) of a string array; null is empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2] or pa.py_buffer(b"")
    return data, np.frombuffer(data, np.uint8), offsets


def blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about `limit` bytes; a text is never cut."""
    for batch in batches:
        offsets = buffers(batch.column(text))[2]
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


class Runs:
    """The runs of a string array: `cut` says before which bytes a run begins.

    `words` holds the distinct runs (binary), `codes` the word of each run, `text_of` the
    row of each run, `first` the run at which each row begins (one more entry at the end).
    """

    def __init__(self, texts: pa.Array, cut: Callable[[np.ndarray], np.ndarray], keep: np.ndarray | None = None, longest: int = 0):
        buffer, data, offsets = buffers(texts)
        low, high = int(offsets[0]), int(offsets[-1])
        begins = np.zeros(high - low + 1, bool)
        if high > low:
            begins[:-1] = cut(data[low:high])
        begins[offsets - low] = True
        begins[-1] = True
        at = np.flatnonzero(begins)
        if longest:
            long = np.flatnonzero(np.diff(at) > longest)
            extra = [np.arange(at[i] + longest, at[i + 1], longest) for i in long]
            at = np.sort(np.concatenate([at, *extra])) if extra else at
        at += low
        starts, ends = at[:-1], at[1:]
        edge = pa.py_buffer(at.astype(np.int32))
        every = pa.Array.from_buffers(pa.binary(), len(starts), [None, edge, buffer])
        self.first = np.searchsorted(starts, offsets)
        if keep is not None:
            chosen = keep[data[starts]] if len(starts) else np.zeros(0, bool)
            every = every.filter(pa.array(chosen))
            self.first = np.concatenate([[0], np.cumsum(chosen)])[self.first]
            starts, ends = starts[chosen], ends[chosen]
        coded = every.dictionary_encode()
        self.words: pa.Array = coded.dictionary
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lengths = ends - starts
        self.text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))


def flattened(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as (all ids in order, length of each list)."""
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts


class Remembered:
    """Ids of runs; every distinct run is encoded once, and remembered up to an amount of memory.

    `encode` gives the ids of a list of runs in order, and how many each of them has.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = REMEMBERED_BYTES, at_once: int = ENCODED_AT_ONCE):
        self.encode, self.most, self.at_once = encode, most, at_once
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.used = self.held = 0

    def _learn(self, words: list[bytes]) -> None:
        flat, counts = self.encode(words)
        ends = self.used + np.cumsum(counts)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        n = len(self.known)
        while n + len(words) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.starts[n + 1 : n + 1 + len(words)] = ends
        self.known.update((w, n + i) for i, w in enumerate(words))
        self.used += len(flat)
        self.held += sum(map(len, words)) + ENTRY_BYTES * len(words) + flat.nbytes

    def __call__(self, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all runs in order, number of ids of each run)."""
        words = runs.words.to_pylist()
        if self.held > self.most:
            self._forget()
        new = [w for w in words if w not in self.known]
        for i in range(0, len(new), self.at_once):
            self._learn(new[i : i + self.at_once])
        at = np.fromiter((self.known[w] for w in words), np.int64, len(words))[runs.codes]
        counts = self.starts[at + 1] - self.starts[at]
        begin = np.cumsum(counts) - counts
        return self.pool[np.arange(counts.sum()) + np.repeat(self.starts[at] - begin, counts)], counts


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in the ranges, both ends included."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


def changes(table: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A cut wherever the class of bytes changes."""

    def cut(data: np.ndarray) -> np.ndarray:
        inside = table[data]
        begins = np.ones(len(data), bool)
        begins[1:] = inside[1:] != inside[:-1]
        return begins

    return cut


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of `values` (any trailing shape) over the runs of each row."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[first[1:]] - total[first[:-1]]
