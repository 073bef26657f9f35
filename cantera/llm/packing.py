"""Documents to token sequences of one length: first-fit decreasing in randomised groups.

A document's ids are cut into pieces of the sequence length; what is left over is one shorter
piece. Pieces are dealt at random into groups of a few thousand, and each group is packed by
itself: pieces in falling order of length go to the first bin with room, found in a tournament
tree over what the bins have left.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantera.llm.runs import Remembered, Runs, blocks, byte_class, flattened

LENGTH = 2048
END_ID = 1
GROUP_PIECES = 4096
BLOCK = 4 << 20
# Runs that are encoded as one text.
RUNS_IN_A_TEXT = 200
WHITE = b"\t\n\x0b\x0c\r "

ASCII_SPACE = byte_class((9, 13), (32, 32))


def before_space(data: np.ndarray) -> np.ndarray:
    """Cuts between a byte that is no white space and ASCII white space.

    The pre-tokenizer never joins the two, so the ids of a text are those of its runs in
    order. A cut is left out after any character that might be white space itself: those
    take two bytes that begin with C2, or three that begin with E1, E2 or E3.
    """
    space = ASCII_SPACE[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = space[1:] & ~space[:-1]
    doubtful = np.zeros(len(data), bool)
    doubtful[2:] |= data[:-2] == 0xC2
    doubtful[3:] |= (data[:-3] >= 0xE1) & (data[:-3] <= 0xE3)
    return begins & ~doubtful


def encoder(path: str) -> Remembered:
    """Ids of runs by a tokenizer file.

    Runs that begin with ASCII white space and end with another ASCII character are encoded
    many in one text, since the pre-tokenizer cuts between them anyway; how many bytes an id
    stands for tells which run it belongs to.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    # Every character of a byte-level token is a byte.
    sizes = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
    for token, number in tokenizer.get_vocab(with_added_tokens=True).items():
        sizes[number] = len(token)

    def ids_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return flattened([e.ids for e in tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)])

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joins = np.fromiter((w[0] in WHITE and w[-1] < 0x80 and w[-1] not in WHITE for w in words), bool, len(words))
        together, alone = np.flatnonzero(joins), np.flatnonzero(~joins)
        texts = [b"".join([words[i] for i in part]) for part in np.array_split(together, -(-len(together) // RUNS_IN_A_TEXT)) if len(part)] if len(together) else []
        flat, _ = ids_of(texts)
        ends = np.searchsorted(np.cumsum(sizes[flat]), np.cumsum([len(words[i]) for i in together]), "right")
        rest, own = ids_of([words[i] for i in alone])
        counts = np.zeros(len(words), np.int64)
        counts[together] = np.diff(ends, prepend=0)
        counts[alone] = own
        # Both kinds of runs in their places.
        first = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        for place, ids in ((together, flat), (alone, rest)):
            many = counts[place]
            begin = np.cumsum(many) - many
            out[np.arange(len(ids)) + np.repeat(first[place] - begin, many)] = ids
        return out, counts

    return Remembered(encode)


def pieces(docs: DataFrame, tokenizer: str, key: str, text: str, length: int, end_id: int, ids: bool) -> DataFrame:
    """One row per piece: `key`, `start`, `length`, `ids_crc32`, `doc_tokens`, `piece`, and `ids` if wanted."""
    schema = T.StructType(
        [
            docs.schema[key],
            *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "piece")],
            *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for block in blocks(batches, "text", BLOCK):
            runs = Runs(block.column("text"), before_space)
            flat, counts = encode(runs)
            ends = np.concatenate([[0], np.cumsum(counts)])[runs.first]
            n = len(ends) - 1
            own = np.diff(ends)
            # Each document's ids, then the end id.
            stream = np.full(len(flat) + n, end_id, "<u4")
            place = np.arange(len(flat)) + np.repeat(np.arange(n), own)
            stream[place] = flat
            totals = own + 1
            begins = np.cumsum(totals) - totals
            shares = -(-totals // length)
            doc = np.repeat(np.arange(n), shares)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(shares) - shares, shares)) * length
            size = np.minimum(length, totals[doc] - start)
            low = begins[doc] + start
            crc = [zlib.crc32(stream[a : a + s]) for a, s in zip(low.tolist(), size.tolist())]
            columns = [
                block.column("key").take(pa.array(doc)),
                *(pa.array(x, pa.int64()) for x in (start, size, crc, totals[doc], number + np.arange(len(doc)))),
            ]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(low, len(stream)), pa.int32()), pa.array(stream.view("<i4"))))
            number += len(doc)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(cut, schema)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; the tree holds the largest room below each of its nodes."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    whole = int((lengths >= capacity).sum())
    bins[order[:whole]] = np.arange(whole)
    rest = order[whole:].tolist()
    leaves = 1 << max(0, (len(rest) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    for i in rest:
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = whole + node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    group_pieces: int = GROUP_PIECES,
    seed: int = 42,
    ids: bool = False,
) -> DataFrame:
    """One row per piece: its document, place in it, ids checksum, `sequence_id` and `offset`.

    A document is its ids and then `end_id`; null and empty texts are `end_id` alone. Every id
    is in exactly one piece, and a sequence holds at most `length` ids, gapless from offset 0.
    With `ids` the ids come along. Repeated rows are documents of their own. Pieces are dealt
    by a number of their own, so that no key makes a group large. Other columns of `docs` are
    left out. An empty table gives an empty one. Pieces are tokenized once and checkpointed.
    """
    cut = pieces(docs, tokenizer, key, text, length, end_id, ids).checkpoint()
    groups = max(1, -(-cut.count() // group_pieces))
    kept = [c for c in cut.columns if c != "piece"]
    # `group` stays out of the way of the key's own name.
    schema = T.StructType([*[cut.schema[c] for c in kept], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), length)
        group = table.column("group_of_pieces").to_numpy().astype(np.int64)
        out = table.select(kept)
        out = out.append_column("sequence_id", pa.array((group << 32) + bins))
        return out.append_column("offset", pa.array(offsets))

    dealt = cut.withColumn("group_of_pieces", F.pmod(F.xxhash64(F.lit(seed), "piece"), F.lit(groups)))
    return dealt.groupBy("group_of_pieces").applyInArrow(place, schema)
