"""Periodic runs of words: Lyndon arrays by Baier's grouping, Lyndon roots extended to runs.

The first phase of Baier's suffix sorter groups the suffixes of a sequence by the longest
Lyndon word that each begins with, highest group first, and needs no sorted suffixes for it. The
lengths of those words are the Lyndon array. Every maximal repetition has, under one order of
the symbols or its inverse, a Lyndon root at which that array holds its period; common extensions
to both sides of a root give the whole run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantera.llm.runs import Runs, blocks, byte_class, changes

WORD_BYTE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
LEAST_LENGTH, LEAST_REPEATS = 6, 4
BLOCK = 6 << 20
# Rounds of cutting at words that are too rare; fewer rounds leave more to the grouping.
CUTS = 8

RUN = "array<struct<start: long, length: long, period: long>>"


def lyndon_array(ranks: list[int]) -> list[int]:
    """The length of the longest Lyndon word that begins at each place, by Baier's first phase.

    Groups of suffixes lie in rising order, at first one for each symbol. From the highest
    down, every suffix of a group finds the nearest place before it that is in a lower group.
    That place's Lyndon word grows by the words of the group that follow it, and the places
    that grew leave their group for new ones right above it, those that grew more times higher.
    """
    n = len(ranks)
    sizes, before, done = [1] * n, [-1] * n, bytearray(n)
    number = {rank: i for i, rank in enumerate(sorted(set(ranks)))}
    group = [number[rank] for rank in ranks]
    members: list[list[int]] = [[] for _ in number]
    for i, g in enumerate(group):
        members[g].append(i)
    below, above = list(range(-1, len(number) - 1)), list(range(1, len(number) + 1))
    top = len(number)
    # One place past the highest group, so that every group has one above it.
    above[-1:] = [top] if number else []
    below.append(top - 1)
    above.append(-1)
    members.append([])
    g = below[top]
    while g >= 0:
        here = [i for i in members[g] if group[i] == g]
        grown: dict[int, int] = {}
        for i in here:
            p = i - 1
            while p >= 0 and done[p]:
                p = before[p]
            # Places of this group come in rising order: an equal one before knows its own.
            if p >= 0 and group[p] == g:
                p = before[p]
            before[i] = p
            if p >= 0:
                grown[p] = grown.get(p, 0) + 1
        for i in here:
            done[i] = 1
        if grown:
            size = sizes[here[0]]
            moved: dict[tuple[int, int], list[int]] = {}
            for p, times in grown.items():
                sizes[p] += times * size
                moved.setdefault((times, group[p]), []).append(p)
            # The most times first: each new group goes right above the one it leaves.
            for key in sorted(moved, reverse=True):
                old, new = key[1], len(members)
                places = moved[key]
                members.append(places)
                below.append(old)
                above.append(above[old])
                below[above[old]] = new
                above[old] = new
                for p in places:
                    group[p] = new
        g = below[g]
    return sizes


def common(data: bytes, i: int, j: int, n: int) -> int:
    """How many of the 4-byte symbols from `i` and from `j` > `i` on are equal."""
    total, step = 0, 8
    while True:
        size = min(step, n - j - total)
        if size <= 0:
            return total
        a, b = 4 * (i + total), 4 * (j + total)
        if data[a : a + 4 * size] != data[b : b + 4 * size]:
            break
        total, step = total + size, 2 * step
    # They differ within the next `size` symbols.
    while size > 1:
        half = size // 2
        a, b = 4 * (i + total), 4 * (j + total)
        if data[a : a + 4 * half] == data[b : b + 4 * half]:
            total, size = total + half, size - half
        else:
            size = half
    return total


def runs_of(symbols: np.ndarray, least_length: int = LEAST_LENGTH, repeats: int = LEAST_REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of at least `repeats` periods and `least_length` symbols.

    Ordered by start, then period. `repeats` is at least 2. Every run has a root in its first
    period, so that its other periods follow; a stretch is extended once for each period.
    """
    n = len(symbols)
    ranks = np.unique(symbols, return_inverse=True)[1].astype(np.int32)
    ahead, back = ranks.tobytes(), ranks[::-1].tobytes()
    found = set()
    for order in (ranks, ranks.max(initial=0) - ranks):
        period = np.array(lyndon_array(order.tolist()), np.int64)
        root = np.flatnonzero(np.arange(n) + (repeats - 1) * period < n)
        period = period[root]
        alike = ranks[root] == ranks[root + period]
        reach: dict[int, int] = {}
        for i, p in zip(root[alike].tolist(), period[alike].tolist()):
            if i + p <= reach.get(p, 0):
                continue
            start = i - common(back, n - i - p, n - i, n)
            reach[p] = end = i + p + common(ahead, i, i + p, n)
            if end - start >= max(least_length, repeats * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda run: (run[0], run[2]))


def stretches(codes: np.ndarray, text_of: np.ndarray, least_length: int, repeats: int) -> Iterator[tuple[int, int]]:
    """Places [begin, end) of words outside which no run can lie, each within one text.

    A run holds every word of its own at least `repeats` times, so no run crosses a word that
    its stretch holds fewer times. Cutting there loses nothing, however often it is done.
    """
    at, part = np.arange(len(codes)), text_of
    width = int(codes.max(initial=0)) + 1
    for _ in range(CUTS):
        _, inverse, counts = np.unique(part * width + codes[at], return_inverse=True, return_counts=True)
        often = counts[inverse] >= repeats
        left, own = at[often], part[often]
        begins = np.ones(len(left), bool)
        begins[1:] = (np.diff(left) > 1) | (np.diff(own) != 0)
        number = np.cumsum(begins) - 1
        long = np.bincount(number, minlength=1)[number] >= least_length if len(left) else np.zeros(0, bool)
        settled = len(left) == len(at) and long.all()
        at, part = left[long], number[long]
        if settled:
            break
    edges = np.flatnonzero(np.concatenate([[True], np.diff(part) != 0, [True]])) if len(at) else []
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(at[a]), int(at[b - 1]) + 1


def periodic_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, repeats: int = LEAST_REPEATS
) -> DataFrame:
    """One row per row of `docs`: `key`, `n_words`, `runs` and `collapsed`.

    Words are what ASCII white space separates, numbered from 0. A run is a stretch of words
    with smallest period q, of at least `repeats` periods and `least_length` words, that no
    neighbouring word extends; `runs` (array of start, length, period) is in order of start,
    then period. `collapsed` is the text's words without those that some run contains after its
    first period, joined by single spaces. Null, empty and blank texts have no word, no run and
    an empty `collapsed`; a null key stays; repeated rows are rows of their own. Other columns
    of `docs`, whatever their names, are left out. An empty table gives an empty one. A text is
    worked on as a whole, in time about linear in its length.
    """
    if repeats < 2:
        raise ValueError("a run has at least two periods")
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T._parse_datatype_string(RUN)),
            T.StructField("collapsed", T.StringType()),
        ]
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK):
            words = Runs(block.column("text"), changes(WORD_BYTE), keep=WORD_BYTE)
            kept = np.ones(len(words.codes), bool)
            found: list[tuple[int, int, int]] = []
            owner: list[int] = []
            for begin, end in stretches(words.codes, words.text_of, least_length, repeats):
                row = int(words.text_of[begin])
                for start, length, period in runs_of(words.codes[begin:end], least_length, repeats):
                    kept[begin + start + period : begin + start + length] = False
                    found.append((begin + start - int(words.first[row]), length, period))
                    owner.append(row)
            # Stretches ascend, and so do the runs of a text.
            columns = np.array(found, np.int64).reshape(-1, 3).T
            edges = np.searchsorted(np.array(owner, np.int64), np.arange(block.num_rows + 1))
            lists = pa.ListArray.from_arrays(
                pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns], ["start", "length", "period"])
            )
            places = np.concatenate([[0], np.cumsum(kept)])[words.first]
            left = pa.ListArray.from_arrays(pa.array(places, pa.int32()), words.words.take(pa.array(words.codes[kept])))
            collapsed = pc.binary_join(left, pa.scalar(b" ", pa.binary())).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [block.column("key"), pa.array(np.diff(words.first), pa.int64()), lists, collapsed], names=schema.names
            )

    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(find, schema)
