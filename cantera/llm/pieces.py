"""SentencePiece encoding and decoding with a Viterbi pass shared between words.

Texts are marked (spaces become the word mark, one more goes in front) and cut where no piece
of the vocabulary could cross. The distinct words of a block are sorted, which lists the
leaves of their trie depth first: each word keeps the forward states of the prefix it shares
with the one before and adds only what is new. A state is the last piece of the best path to
it. The model's merges allow a piece after another only if merging the two texts would end
in just these pieces, so exactly one path is left and it is the one the library gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantera.llm.runs import Remembered, Runs, blocks, flattened

MARK = "▁"
BLOCK = 8 << 20
# Pairs of pieces a worker remembers; beyond that it starts anew.
FITS = 500_000


class Vocabulary:
    """Pieces of a SentencePiece merge model, from its public file."""

    def __init__(self, model: str):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = processor.get_piece_size()
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.bytes_of = [b""] * self.size
        self.byte_ids = [0] * 256
        for i in range(self.size):
            piece = processor.id_to_piece(i)
            if processor.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif not processor.is_control(i) and not processor.is_unknown(i):
                self.ids[piece], self.rank[piece] = i, processor.get_score(i)
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        self.longest = max(map(len, self.ids))
        # All endings of pieces: nothing longer needs to be tried where one is missing.
        self.endings = {p[i:] for p in self.ids for i in range(len(p))}
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self._fits: dict[tuple[str, str], bool] = {}

    def cuts(self) -> np.ndarray:
        """True for two bytes that no piece holds next to each other, where both are ASCII.

        A space after a non-ASCII character is a cut as well, unless its last byte might be
        the mark's own.
        """
        table = np.zeros((256, 256), bool)
        letter = [MARK if c == 32 else chr(c) for c in range(128)]
        for a in range(128):
            for b in range(128):
                table[a, b] = letter[a] + letter[b] not in self.pairs
        table[128:, 32] = True
        table[MARK.encode()[-1], 32] = False
        return table

    def merged(self, text: str) -> list[str]:
        """The model's own merges: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether merging the two texts together ends in just these two pieces."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= FITS:
                self._fits.clear()
            known = self._fits[left, right] = self.merged(left + right) == [left, right]
        return known


class SharedPrefixViterbi:
    """Paths of many words at once; `encode` takes distinct words and keeps their order."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def paths(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, its pieces) in sorted order."""
        vocabulary = self.vocabulary
        ids, endings, fits = vocabulary.ids, vocabulary.endings, vocabulary.fits
        last: list[str] = [""]  # last[i]: the piece that ends the path to i
        before = ""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                chosen = ""
                for begin in range(end - 1, -1, -1):
                    piece = word[begin:end]
                    if begin < end - 1 and piece not in endings:
                        break
                    if (piece in ids or begin == end - 1) and (not begin or (last[begin] and fits(last[begin], piece))):
                        chosen = piece
                        break
                last.append(chosen)
            before = word
            pieces, end = [], len(word)
            while end and last[end]:
                pieces.append(last[end])
                end -= len(last[end])
            # A vocabulary whose merges leave no path of fitting pieces is merged plainly.
            yield word, pieces[::-1] if not end else vocabulary.merged(word)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        ids, byte_ids = self.vocabulary.ids, self.vocabulary.byte_ids
        texts = [w.decode("utf-8", "replace").replace(" ", MARK) for w in words]
        found = {}
        for text, pieces in self.paths(list(set(texts))):
            out: list[int] = []
            for piece in pieces:
                number = ids.get(piece)
                # A character without a piece is its bytes.
                out.extend([number] if number is not None else [byte_ids[b] for b in piece.encode()])
            found[text] = out
        return [found[t] for t in texts]


def encoder(model: str) -> tuple[np.ndarray, Remembered]:
    """(cuts, ids of runs) of a model."""
    vocabulary = Vocabulary(model)
    viterbi = SharedPrefixViterbi(vocabulary)
    return vocabulary.cuts(), Remembered(lambda words: flattened(viterbi.encode(words)), at_once=50_000)


def encode_pieces(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """`docs` with `ids` (array of int): the ids of every whole text, as the library gives them.

    Null and empty texts have no ids. A column named `ids` is replaced. Words already seen by
    a task are looked up. Repeated rows have equal ids.
    """
    own = [c for c in docs.columns if c.lower() != "ids"]
    place = own.index(text)
    schema = docs.select(*[F.col(f"`{c}`") for c in own]).schema.add("ids", T.ArrayType(T.IntegerType()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ids_of = encoder(model)

        def cut(data: np.ndarray) -> np.ndarray:
            begins = np.zeros(len(data), bool)
            begins[1:] = table[data[:-1], data[1:]]
            return begins

        for batch in batches:
            named = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for block in blocks([named], f"c{place}", BLOCK):
                texts = pc.fill_null(block.column(place).cast(pa.string()), "")
                marked = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
                runs = Runs(marked, cut)
                flat, counts = ids_of(runs)
                ends = np.concatenate([[0], np.cumsum(counts)])[runs.first]
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays([*block.columns, ids], names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in own]).mapInArrow(encode, schema)


def decode_pieces(coded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """`coded` with `decoded`: the text of its ids, without the mark in front.

    Ids outside the vocabulary and control ids give nothing; null is empty. A column named
    `decoded` is replaced. A text comes back exactly unless it holds the mark itself, which
    the vocabulary can't tell from a space.
    """
    own = [c for c in coded.columns if c.lower() != "decoded"]
    place = own.index(ids)
    schema = coded.select(*[F.col(f"`{c}`") for c in own]).schema.add("decoded", "string")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model)
        pool = np.frombuffer(b"".join(vocabulary.bytes_of), np.uint8)
        sizes = np.array([*map(len, vocabulary.bytes_of), 0])
        starts = np.cumsum(sizes) - sizes
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                block = batch.slice(first, 256)
                lists = pc.fill_null(block.column(place), [])
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = lists.value_lengths().to_numpy(zero_copy_only=False)
                flat = np.where((flat >= 0) & (flat < vocabulary.size), flat, vocabulary.size)
                n = sizes[flat]
                begin = np.cumsum(n) - n
                data = pool[np.arange(n.sum()) + np.repeat(starts[flat] - begin, n)].tobytes()
                edges = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
                texts = [data[a + data.startswith(b" ", a, b) : b].decode("utf-8", "replace") for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(texts, pa.string())], names=schema.names)

    return coded.select(*[F.col(f"`{c}`") for c in own]).mapInArrow(decode, schema)
