"""SimHash near-duplicates with pigeonring filtering.

Two fingerprints that differ in few bits are found by their segments, seen as a ring: some
chain of consecutive segments has differences that stay, at every length, within that length's
share of all the bits allowed. Segments of such a chain that cannot differ make the key of a
bucket; pairs of a bucket must keep the chain's budgets before their bits are counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantera.llm.components import connected
from cantera.llm.runs import Runs, blocks, byte_class, changes
from cantera.operators.relational import reshuffled

BITS = 64
SEGMENTS = 5
# Buckets up to this many fingerprints are compared pair by pair, larger ones by neighbours.
PAIRWISE = 12
WORD_BYTE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
HASHES_AT_ONCE = 1 << 17
TEXT_AT_ONCE = 4 << 20


class Shingles:
    """Hashes of the word shingles of a string array: A-Z lower-cased, words joined by one space.

    A text of fewer words than a shingle has its whole sequence as the only one; a text
    without words has none. `first` says where each text's hashes begin.
    """

    def __init__(self, texts: pa.Array, words: int, seed: int = 42):
        from xxhash import xxh64_intdigest

        lower = pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))
        runs = Runs(lower, changes(WORD_BYTE), keep=WORD_BYTE)
        # Every word moves so that one space follows it.
        n = len(runs.codes)
        joined = np.full(int(runs.lengths.sum()) + n, 0x20, np.uint8)
        raw = np.frombuffer(lower.buffers()[2] or b"", np.uint8)
        offsets = np.frombuffer(lower.buffers()[1], np.int32)[lower.offset : lower.offset + len(lower) + 1]
        raw = raw[offsets[0] : offsets[-1]]
        kept = raw[WORD_BYTE[raw]]
        joined[np.arange(len(kept)) + np.repeat(np.arange(n), runs.lengths)] = kept
        ends = np.cumsum(runs.lengths + 1) - 1
        starts = ends - runs.lengths
        sizes = np.diff(runs.first)
        counts = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
        self.first = np.concatenate([[0], np.cumsum(counts)])
        begin = np.arange(self.first[-1]) - np.repeat(self.first[:-1], counts) + np.repeat(runs.first[:-1], counts)
        final = np.minimum(begin + words - 1, np.repeat(runs.first[1:], counts) - 1)
        text = joined.tobytes()
        pairs = zip(starts[begin].tolist(), ends[final].tolist())
        self.hashes = np.fromiter((xxh64_intdigest(text[a:b], seed) for a, b in pairs), np.uint64, len(begin))

    def bit_counts(self) -> np.ndarray:
        """How many hashes of each text have each bit: texts × 64."""
        counts = np.zeros((len(self.first) - 1, BITS), np.int64)
        owner = np.repeat(np.arange(len(counts)), np.diff(self.first))
        for i in range(0, len(self.hashes), HASHES_AT_ONCE):
            part = self.hashes[i : i + HASHES_AT_ONCE].astype("<u8")
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            mine = owner[i : i + HASHES_AT_ONCE]
            begins = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            counts[mine[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
        return counts


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 64 booleans, lowest bit first, as signed longs."""
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64).view(np.int64).ravel()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(`key`, `print`) of every row: bit i is set if over half the shingle hashes have it.

    Null, empty and wordless texts have print 0.
    """
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("print", T.LongType())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", TEXT_AT_ONCE):
            shingles = Shingles(block.column("text"), words, seed)
            over = 2 * shingles.bit_counts() > np.diff(shingles.first)[:, None]
            yield pa.RecordBatch.from_arrays([block.column("key"), pa.array(packed(over))], names=["key", "print"])

    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(make, schema)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def segment_masks(segments: int = SEGMENTS) -> list[int]:
    """Masks of the segments, as equal in width as can be, the lowest bits first."""
    edges = [round(BITS * i / segments) for i in range(segments + 1)]
    return [sum(1 << b for b in range(low, high)) for low, high in zip(edges, edges[1:])]


def chain_budgets(distance: int, segments: int) -> list[int]:
    """Differences a chain of 1, 2, ... segments may have."""
    return [length * distance // segments for length in range(1, segments + 1)]


def chain_masks(start: int, segments: int) -> list[int]:
    """Masks of the chains of 1, 2, ... consecutive segments from `start` on, around the ring."""
    masks, total, out = segment_masks(segments), 0, []
    for i in range(segments):
        total |= masks[(start + i) % segments]
        out.append(total)
    return out


def bucket_plans(distance: int, segments: int) -> list[tuple[int, int]]:
    """(start, mask of the segments that are equal) so that every close pair shares one of them.

    Within a chain of all segments but the last, as many may differ as its budget says, at
    places where no shorter chain goes over its own; the others are equal.
    """
    budgets, masks, plans = chain_budgets(distance, segments), segment_masks(segments), []
    for start in range(segments):
        for differing in combinations(range(segments - 1), budgets[segments - 2]):
            if all(sum(d < length for d in differing) <= budgets[length - 1] for length in range(1, segments)):
                equal = [masks[(start + i) % segments] for i in range(segments - 1) if i not in differing]
                plans.append((start, sum(equal)))
    return plans


def within_chain(difference: Column, start: int, distance: int, segments: int) -> Column:
    """No chain from `start` has more differing bits than its budget; the last one is the full check."""
    holds = F.lit(True)
    for mask, budget in zip(chain_masks(start, segments), chain_budgets(distance, segments)):
        holds = holds & (F.bit_count(difference.bitwiseAND(F.lit(signed(mask)))) <= budget)
    return holds


def close_pairs(prints: DataFrame, distance: int = 2, segments: int = SEGMENTS, pairwise: int = PAIRWISE) -> DataFrame:
    """Links (`a`, `b`) that connect all of the distinct `print`s within `distance` bits (at most 2).

    Buckets of up to `pairwise` prints give their close pairs. In a larger bucket every print
    is written once for itself and once for each bit that may differ there; two of them within
    2 bits meet in such a neighbour, and each is linked with the smallest that it meets there.
    So the work of a bucket grows with its size, not with its pairs, and no link is lost.
    """
    if not 0 <= distance <= 2 < segments:
        raise ValueError("at most 2 differing bits and more than 2 segments")
    plans = bucket_plans(distance, segments)
    keyed = prints.select(
        "print",
        F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(signed(mask))) for _, mask in plans])).alias("plan", "key"),
    )
    bucket = "(PARTITION BY plan, key ORDER BY print"
    placed = keyed.withColumn("n", F.expr("count(1) OVER (PARTITION BY plan, key)")).where("n > 1")
    before = F.expr(f"collect_list(print) OVER {bucket} ROWS BETWEEN {pairwise - 1} PRECEDING AND 1 PRECEDING)")
    near = F.lit(False)
    for number, (start, _) in enumerate(plans):
        near = F.when(
            F.col("plan") == number, within_chain(F.col("a").bitwiseXOR(F.col("b")), start, distance, segments)
        ).otherwise(near)
    pairs = (
        placed.where(F.col("n") <= pairwise)
        .select(F.col("print").alias("a"), "plan", before.alias("before"))
        .select("a", "plan", F.explode("before").alias("b"))
        .where(near)
        .select("a", "b")
    )
    free = [
        F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << b)) for b in range(BITS) if not mask >> b & 1]) for _, mask in plans
    ]
    neighbour = (
        placed.where(F.col("n") > pairwise)
        .select("print", "plan", "key", F.explode(F.get(F.array(*free), F.col("plan"))).alias("bit"))
        .withColumn("spot", F.col("print").bitwiseXOR(F.col("bit")))
    )
    met = F.expr("min(print) OVER (PARTITION BY plan, key, spot)")
    stars = neighbour.select(F.col("print").alias("a"), met.alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """One row per row of `docs`: `key`, `fingerprint` (16 hex digits) and `component_id`.

    Rows whose prints differ in at most `distance` bits are linked, wordless ones (print 0)
    like any other; `component_id` is the smallest key reachable, null only if all keys there
    are null. Equal prints are one before anything is compared, so a text with very many
    copies costs no more than one. Other columns of `docs` are left out. An empty table gives
    an empty one.
    """
    prints = fingerprints(docs, key, text, words, seed).checkpoint()
    classes = prints.groupBy("print").agg(F.min("key").alias("low")).checkpoint()
    grouped = connected(close_pairs(classes.select("print"), distance))
    members = classes.join(grouped, F.col("print") == F.col("node")).select("print", "component", "low")
    least = members.groupBy("component").agg(F.min("low").alias("least"))
    named = members.join(reshuffled(least, ["component"]), "component").select(F.col("print").alias("named"), "least")
    final = classes.join(named, F.col("print") == F.col("named"), "left").select(
        F.col("print").alias("class"), F.when(F.col("named").isNotNull(), F.col("least")).otherwise(F.col("low")).alias("component_id")
    )
    # A print with very many rows is split at run time, for which both sides have to be shuffled.
    return prints.join(reshuffled(final, ["class"]), F.col("print") == F.col("class")).select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def without_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2, seed: int = 42
) -> DataFrame:
    """`docs` with one row of each group of `simhash_groups`: the one with the smallest key, null last.

    Of rows with that key and different texts the one with the smaller text hash stays, and of
    rows that repeat it one. All columns stay as they are, whatever their names. Null, empty and
    wordless texts are a group. An empty table gives an empty one. What goes is joined to the
    rows, so that a text is shuffled at most once.
    """
    own = docs.columns
    identity = F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("hash"))
    grouped = simhash_groups(docs.select(identity.alias("row"), F.col(f"`{text}`").alias("text")), "row", "text", words, distance, seed).checkpoint()
    least = F.col("row").eqNullSafe(F.col("component_id"))
    names = ["key", "hash"]
    gone = grouped.where(~least).select(*[F.col(f"row.{c}").alias(f"gone_{c}") for c in names]).distinct()
    again = grouped.where(least).groupBy(*[F.col(f"row.{c}").alias(f"again_{c}") for c in names]).count().where("count > 1").drop("count").checkpoint()

    def same(tag: str) -> Column:
        return F.col("identity.key").eqNullSafe(F.col(f"{tag}_key")) & (F.col("identity.hash") == F.col(f"{tag}_hash"))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("whole"), identity.alias("identity")).join(gone, same("gone"), "left_anti")
    if not again.isEmpty():
        # Rows that repeat a kept one: one of each, chosen before anything is shuffled.
        repeated = rows.join(again, same("again"), "left_semi").groupBy("identity").agg(F.first("whole").alias("whole"))
        rows = rows.join(again, same("again"), "left_anti").select("whole").unionByName(repeated.select("whole"))
    return rows.select(*[F.col(f"whole.`{c}`") for c in own])
