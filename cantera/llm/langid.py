"""Language of a text by unigram pieces, summed over all segmentations.

Every language has its own probabilities for the pieces of one fixed public vocabulary. A word
is as likely as all its segmentations together, which a forward pass over its bytes sums; a
text is as likely as its words. Probabilities are learned by expectation-maximisation on word
counts of a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantera.llm.runs import Runs, blocks, byte_class, changes, sums

# Rows of each language that the probabilities are learned from, about (drawn by hash).
SAMPLE_ROWS = 1500
# Languages that are learned and scored together; more are done block after block.
LANGUAGES_AT_ONCE = 8
LANGUAGES_IN_MEMORY = 64
# Every task holds a number for each piece and language: some 400 MB. More languages are refused.
MOST_LANGUAGES = 2000
ROUNDS = 3
SMOOTHING = 0.02
# Sums over the segmentations of a longer word would leave a double: they are scaled on the way.
LONGEST = 48
SCALED_EVERY = 16
# The score is that of a text with at most this many words, so that it says something.
SCORE_WORDS = 30
UNDETERMINED = "und"

LETTER_BYTE = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
MARK = "▁"
WORDS_AT_ONCE, LETTERS_AT_ONCE = 20_000, 1 << 20
# A block needs some thirty times its text in numbers.
BLOCK = 6 << 20


def words(texts: pa.Array) -> Runs:
    """Runs of letters in lower case (every non-ASCII byte counts as one)."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    return Runs(lower, changes(LETTER_BYTE), keep=LETTER_BYTE)


def public_pieces(model: str) -> list[str]:
    """Letter pieces of a SentencePiece model in lower case, with or without the word mark."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = (processor.id_to_piece(i).lower() for i in range(processor.get_piece_size()))
    return sorted({p for p in pieces if p.removeprefix(MARK).isalpha()})


class Trie:
    """Pieces as byte paths in one table: state and byte to state; any byte alone is a piece too."""

    def __init__(self, pieces: list[str], used: np.ndarray):
        # Byte 0 stands for the mark, which no word holds.
        coded = [p.replace(MARK, "\0").encode() for p in pieces]
        kept = [p for p in coded if used[list(p)].all()]
        singles = [bytes([b]) for b in np.flatnonzero(used)]
        self.pieces = sorted(set(kept) | set(singles))
        self.column = np.full(256, -1, np.int64)
        alphabet = np.flatnonzero(used)
        self.column[alphabet] = np.arange(len(alphabet))
        rows: list[list[int]] = [[-1] * len(alphabet)]
        piece = [-1]
        for number, path in enumerate(self.pieces):
            state = 0
            for byte in path:
                place = self.column[byte]
                if rows[state][place] < 0:
                    rows[state][place] = len(rows)
                    rows.append([-1] * len(alphabet))
                    piece.append(-1)
                state = rows[state][place]
            piece[state] = number
        self.deepest = max((len(path) for path in self.pieces), default=1)
        self.table = np.array(rows, np.int32)
        self.piece = np.array(piece, np.int32)

    def edges(self, letters: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, rows, pieces): the words (rows of `letters`) with a piece from begin to end.

        Begins ascend, and so do ends for one begin. Bytes outside the alphabet are -1.
        """
        width = letters.shape[1]
        for begin in range(width):
            rows = np.arange(len(letters))
            state = np.zeros(len(letters), np.int64)
            for end in range(begin, width):
                byte = letters[rows, end]
                state = np.where(byte >= 0, self.table[state, byte], -1)
                alive = state >= 0
                if not alive.all():
                    rows, state = rows[alive], state[alive]
                if not len(rows):
                    break
                piece = self.piece[state]
                complete = piece >= 0
                if complete.all():
                    yield begin, end + 1, rows, piece
                elif complete.any():
                    yield begin, end + 1, rows[complete], piece[complete]

    def matrices(self, found: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers, letters) of distinct words, those of one length together, mark first."""
        offsets = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1]
        data = np.frombuffer(found.buffers()[2] or b"", np.uint8)
        lengths = np.diff(offsets)
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order])) + 1
        for same in np.split(order, edges) if len(order) else []:
            size = int(lengths[same[0]])
            step = max(1, min(WORDS_AT_ONCE, LETTERS_AT_ONCE // (size + 1)))
            for i in range(0, len(same), step):
                rows = same[i : i + step]
                letters = np.zeros((len(rows), size + 1), np.uint8)
                letters[:, 1:] = data[offsets[rows][:, None].astype(np.int64) + np.arange(size)]
                yield rows, self.column[letters]

    def steps(self, letters: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each place of one word, the (end, piece) of its pieces that begin there."""
        table, piece, out = self.table, self.piece, []
        codes = letters.tolist()
        for begin in range(len(codes)):
            state, found = 0, []
            for end in range(begin, len(codes)):
                state = int(table[state, codes[end]]) if codes[end] >= 0 else -1
                if state < 0:
                    break
                if piece[state] >= 0:
                    found.append((end + 1, int(piece[state])))
            out.append(found)
        return out


def forward(trie: Trie, letters: np.ndarray, probability: np.ndarray, unknown: float) -> np.ndarray:
    """Sums over the segmentations of each prefix: words × (length + 1) × languages."""
    total = np.zeros((len(letters), letters.shape[1] + 1, probability.shape[1]))
    total[:, 0] = 1.0
    strange = letters < 0
    done = 0
    for begin, end, rows, piece in trie.edges(letters):
        # A byte outside the alphabet is a piece of its own with one small probability.
        while done < begin:
            done += 1
            total[:, done] += np.where(strange[:, done - 1, None], total[:, done - 1] * unknown, 0)
        total[rows, end] += total[rows, begin] * probability[piece]
    while done < letters.shape[1]:
        done += 1
        total[:, done] += np.where(strange[:, done - 1, None], total[:, done - 1] * unknown, 0)
    return total


def scaled(steps: list[list[tuple[int, int]]], codes: list[int], probability: np.ndarray, unknown: float, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, logs): what `forward` sums for one word is sums * exp(logs), places × languages.

    `deepest` is the length of the longest piece: only so many sums ahead are under way.
    """
    n, width = len(codes), probability.shape[1]
    total, logs = np.zeros((n + 1, width)), np.zeros((n + 1, width))
    total[0], level = 1.0, np.zeros(width)
    for begin, found in enumerate(steps):
        if begin % SCALED_EVERY == 0:
            ahead = total[begin : begin + deepest + 1]
            most = np.maximum(ahead.max(axis=0), 1e-300)
            ahead /= most
            level = level + np.log(most)
        logs[begin] = level
        here = total[begin]
        for end, piece in found:
            total[end] += here * probability[piece]
        # A byte outside the alphabet is a piece of its own with one small probability.
        if codes[begin] < 0:
            total[begin + 1] += here * unknown
    logs[n] = level
    return total, logs


def log_likelihood(trie: Trie, letters: np.ndarray, probability: np.ndarray, unknown: float) -> np.ndarray:
    """The logarithm of the sum over all segmentations of each word: words × languages."""
    if letters.shape[1] <= LONGEST + 1:
        return np.log(np.maximum(forward(trie, letters, probability, unknown)[:, -1], 1e-300))
    out = np.zeros((len(letters), probability.shape[1]))
    for row, word in enumerate(letters):
        total, logs = scaled(trie.steps(word), word.tolist(), probability, unknown, trie.deepest)
        out[row] = np.log(np.maximum(total[-1], 1e-300)) + logs[-1]
    return out


def expected(trie: Trie, letters: np.ndarray, weight: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece, words weighted by their counts."""
    if letters.shape[1] > LONGEST + 1:
        return sum(expected_long(trie, word, w, probability) for word, w in zip(letters, weight))
    p = probability[:, None]
    ahead = forward(trie, letters, p, 1e-12)[:, :, 0]
    edges = list(trie.edges(letters))
    behind = np.zeros_like(ahead)
    behind[:, -1] = 1.0
    for begin, end, rows, piece in reversed(edges):
        behind[rows, begin] += probability[piece] * behind[rows, end]
    scale = np.where(ahead[:, -1] > 0, weight / np.maximum(ahead[:, -1], 1e-300), 0)
    uses = np.zeros(len(trie.pieces))
    for begin, end, rows, piece in edges:
        uses += np.bincount(piece, ahead[rows, begin] * probability[piece] * behind[rows, end] * scale[rows], len(uses))
    return uses


def expected_long(trie: Trie, word: np.ndarray, weight: float, probability: np.ndarray) -> np.ndarray:
    """The same for one long word: forward and backward sums are scaled on their way."""
    steps, codes = trie.steps(word), word.tolist()
    ahead, up = scaled(steps, codes, probability[:, None], 1e-12, trie.deepest)
    # Backward is forward through the same pieces from the other end.
    n = len(codes)
    mirrored: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for begin, found in enumerate(steps):
        for end, piece in found:
            mirrored[n - end].append((n - begin, piece))
    behind, down = scaled(mirrored, codes[::-1], probability[:, None], 1e-12, trie.deepest)
    uses, whole = np.zeros(len(trie.pieces)), np.log(np.maximum(ahead[n, 0], 1e-300)) + up[n, 0]
    for begin, found in enumerate(steps):
        for end, piece in found:
            level = up[begin, 0] + down[n - end, 0] - whole
            uses[piece] += weight * ahead[begin, 0] * probability[piece] * behind[n - end, 0] * np.exp(min(level, 700.0))
    return uses


@dataclass
class Model:
    languages: list[str]
    trie: Trie | None
    probability: np.ndarray
    prior: np.ndarray


def is_held_out(key: str = "doc_id") -> Column:
    """crc32 of the key as text leaves 0 when divided by 5; a null key is held out too."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(
    labelled: DataFrame, model: str, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS
) -> Model:
    """Piece probabilities of every language from about `sample_rows` rows of each, whole texts.

    Rows without a language teach nothing, a language with few rows is learned from all of
    them, repeated rows count as often as they are there, and a table without a labelled row
    (or without any) gives a model without languages. All languages start equally likely. The driver holds
    one number for each piece and language; words and counts stay with the executors.
    """
    spark = labelled.sparkSession
    known = labelled.where(F.col(f"`{lang}`").isNotNull())
    counts = known.groupBy(F.col(f"`{lang}`").alias("lang")).count().limit(MOST_LANGUAGES + 1).collect()
    languages = sorted(r["lang"] for r in counts)
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    if not languages:
        return Model([], None, np.zeros((1, 0)), np.zeros(0))
    shares = spark.createDataFrame([(r["lang"], min(1.0, sample_rows / r["count"])) for r in counts], "of string, share double")
    drawn = F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(1_000_000)) < F.col("share") * 1_000_000

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK):
            runs = words(block.column("text"))
            number = pc.index_in(block.column("lang"), pa.array(languages)).to_numpy(zero_copy_only=False).astype(np.int64)
            width = max(1, len(runs.words))
            pair, times = np.unique(number[runs.text_of] * width + runs.codes, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair // width, pa.int32()), runs.words.take(pa.array(pair % width)), pa.array(times, pa.int64())],
                names=["lang", "word", "n"],
            )

    labelled = known.select(F.col(f"`{key}`").alias("key"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    sample = labelled.join(F.broadcast(shares), F.col("lang") == F.col("of")).where(drawn).select("lang", "text")
    tally = sample.mapInArrow(count, "lang int, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).checkpoint()

    def alphabet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.zeros(256, bool)
        for batch in batches:
            used[list(set(b"".join(batch.column("word").to_pylist())))] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(used), pa.int32())], names=["byte"])

    used = np.zeros(256, bool)
    used[[0, *[r["byte"] for r in tally.mapInArrow(alphabet, "byte int").distinct().collect()]]] = True
    trie = Trie(public_pieces(model), used)
    probability = np.tile([1.0 / 8 ** len(p) for p in trie.pieces], (len(languages), 1))
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((trie, probability))

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie, probability = shared.value
            uses: dict[int, np.ndarray] = {}

            def told() -> pa.RecordBatch:
                parts = [(one, np.flatnonzero(row), row) for one, row in uses.items()]
                columns = [
                    pa.array(np.concatenate([np.full(len(at), one) for one, at, _ in parts]), pa.int32()),
                    pa.array(np.concatenate([at for _, at, _ in parts]), pa.int32()),
                    pa.array(np.concatenate([row[at] for _, at, row in parts])),
                ]
                uses.clear()
                return pa.RecordBatch.from_arrays(columns, names=["lang", "piece", "uses"])

            for batch in batches:
                number, weight = batch.column("lang").to_numpy(), batch.column("n").to_numpy().astype(float)
                for one in np.unique(number).tolist():
                    mine = np.flatnonzero(number == one)
                    row = uses.setdefault(one, np.zeros(probability.shape[1]))
                    for rows, letters in trie.matrices(batch.column("word").take(pa.array(mine))):
                        row += expected(trie, letters, weight[mine][rows], probability[one])
                    if len(uses) >= LANGUAGES_IN_MEMORY:
                        yield told()
            if uses:
                yield told()

        total = tally.mapInArrow(gather, "lang int, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
        table = total.toArrow()
        uses = np.zeros_like(probability)
        uses[table.column("lang").to_numpy(), table.column("piece").to_numpy()] = table.column("uses").to_numpy()
        # Sums of doubles depend on their order in the last places only.
        uses = np.round(uses, 6) + SMOOTHING
        probability = uses / uses.sum(axis=1, keepdims=True)
        shared.unpersist()
    return Model(languages, trie, np.ascontiguousarray(probability.T), np.zeros(len(languages)))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score` (columns of these names are replaced).

    `und` with score 0 where the text is null or has no letter, or nothing was learned. The
    score is the probability of the language among those learned, at the text's mean word.
    Ties go to the language that sorts first. Words of any length are whole. Repeated rows get
    the same answer; an empty table gives an empty one.
    """
    own = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    schema = docs.select(*[F.col(f"`{c}`") for c in own]).schema.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place, marked = own.index(text), len(own)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            renamed = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for block in blocks([renamed], f"c{place}", BLOCK):
                runs = words(block.column(place))
                total = np.zeros((block.num_rows, len(model.languages)))
                for low in range(0, len(model.languages), LANGUAGES_AT_ONCE):
                    some = slice(low, low + LANGUAGES_AT_ONCE)
                    probability = np.ascontiguousarray(model.probability[:, some])
                    each = np.zeros((len(runs.words), probability.shape[1]))
                    for rows, letters in model.trie.matrices(runs.words):
                        each[rows] = log_likelihood(model.trie, letters, probability, 1e-7)
                    total[:, some] = sums(each[runs.codes], runs.first) + model.prior[some]
                n = np.maximum(1, np.diff(runs.first))[:, None]
                told = block.column(marked).to_numpy(zero_copy_only=False).astype(bool) & (len(model.languages) > 0)
                if len(model.languages):
                    best = total.argmax(axis=1)
                    level = (total - total.max(axis=1, keepdims=True)) / n * np.minimum(n, SCORE_WORDS)
                    share = 1.0 / np.exp(level).sum(axis=1)
                    names = np.array(model.languages, object)[best]
                else:
                    share, names = np.zeros(len(told)), np.full(len(told), UNDETERMINED, object)
                names[~told] = UNDETERMINED
                columns = [*block.columns[:marked], pa.array(names, pa.string()), pa.array(np.where(told, share, 0.0))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    letter = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    return docs.select(*[F.col(f"`{c}`") for c in own], letter.alias("_has_letter")).mapInArrow(score, schema)
