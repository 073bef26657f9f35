r"""Conversations of typed content parts to training text, and back.

A message is a list of parts: text, images, audio, documents. A visitor turns each part into
items in reading order, a document into those of its pages; every item that is not text becomes
a numbered placeholder, with its reference and the number of tokens it stands for recorded
beside. Marks of the template cannot occur in a text: control strings in texts and roles are
broken up by backslashes, which reading takes out again.

A formatted conversation is the rows of its turns, one after another, so that no conversation
has to fit into memory. A turn is

    ### <role>:
    <body>
    </turn>
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The template: fixed strings around role and body.
HEAD, COLON, END = "### ", ":\n", "\n</turn>\n"
# What texts must not hold, and how it is written there; the backslash comes first.
ESCAPES = [("\\", "\\\\"), ("#", "\\#"), ("</turn>", "<\\/turn>"), ("<|", "<\\|")]
PLACEHOLDER = re.compile(r"<\|[a-z]+ [0-9]+\|>")
LEARNED_ROLE = "assistant"

IMAGE = "struct<reference: string, width: int, height: int>"
PAGE = f"struct<text: string, images: array<{IMAGE}>>"
PART = f"struct<kind: string, text: string, reference: string, width: int, height: int, seconds: double, pages: array<{PAGE}>>"


def text_parts(text: Column) -> Column:
    """A message of one text part."""
    null = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            text.cast("string").alias("text"),
            null.cast("string").alias("reference"),
            null.cast("int").alias("width"),
            null.cast("int").alias("height"),
            null.cast("double").alias("seconds"),
            null.cast(f"array<{PAGE}>").alias("pages"),
        )
    )


def escaped(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL) if "\\" in text else text


def _item(kind: str, text: Column | None = None, reference: Column | None = None, tokens: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        F.coalesce(text, F.lit("")).alias("text") if text is not None else F.lit("").alias("text"),
        (reference if reference is not None else F.lit(None).cast("string")).alias("reference"),
        F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens") if tokens is not None else F.lit(0).cast("long").alias("tokens"),
    )


@dataclass(frozen=True)
class Visitor:
    """Flattens parts into items (`kind`, `text`, `reference`, `tokens`), one method for each kind of part.

    An image stands for one token for each patch of `patch` × `patch` pixels, audio for
    `per_second` tokens a second, a document for `per_page` tokens a page beside its pages' texts
    and images. Unknown sizes count nothing. A part of another kind stays, as `other`.
    """

    patch: int = 28
    per_second: float = 25.0
    per_page: int = 4

    def text(self, part: Column) -> Column:
        return F.array(_item("text", text=part.text))

    def image(self, part: Column) -> Column:
        return F.array(self._picture(part))

    def audio(self, part: Column) -> Column:
        length = F.ceil(F.greatest(part.seconds, F.lit(0.0)) * self.per_second)
        return F.array(_item("audio", reference=part.reference, tokens=length))

    def document(self, part: Column) -> Column:
        pages = F.coalesce(part.pages, F.array().cast(f"array<{PAGE}>"))
        itself = _item("document", reference=part.reference, tokens=F.size(pages) * self.per_page)
        return F.concat(F.array(itself), F.flatten(F.transform(pages, self._page)))

    def other(self, part: Column) -> Column:
        return F.array(_item("other", reference=part.reference))

    def _page(self, page: Column) -> Column:
        images = F.coalesce(page.images, F.array().cast(f"array<{IMAGE}>"))
        return F.concat(F.array(_item("text", text=page.text)), F.transform(images, self._picture))

    def _picture(self, part: Column) -> Column:
        across = F.ceil(F.greatest(part.width, F.lit(0)) / self.patch)
        return _item("image", reference=part.reference, tokens=across * F.ceil(F.greatest(part.height, F.lit(0)) / self.patch))

    def visit(self, parts: Column) -> Column:
        """The items of a message, in reading order."""
        one = lambda part: (
            F.when(part.kind == "text", self.text(part))
            .when(part.kind == "image", self.image(part))
            .when(part.kind == "audio", self.audio(part))
            .when(part.kind == "document", self.document(part))
            .otherwise(self.other(part))
        )
        return F.flatten(F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), one))


def format_turns(
    messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", visitor: Visitor = Visitor()
) -> DataFrame:
    """One row per message: `key`, `turn`, `formatted`, the loss mask, its attachments and their tokens.

    `loss_start` and `loss_end` are code points of `formatted`: the body of an assistant turn,
    and for other roles nothing (both 0). `attachments` lists, in order, the number of each
    placeholder, its kind, reference and tokens; `expanded_tokens` is their sum. Nothing is
    shuffled. A null role, message or text is empty, a null key or turn stays; repeated rows are
    turns of their own; other columns are left out, whatever their names. An empty table gives
    an empty one.
    """
    name = F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n"))
    written = F.transform(
        "items", lambda x, i: F.when(x.kind == "text", escaped(x.text)).otherwise(F.concat(F.lit("<|"), x.kind, F.lit(" "), i.cast("string"), F.lit("|>")))
    )
    numbered = F.transform("items", lambda x, i: F.struct(i.alias("number"), x.kind.alias("kind"), x.reference.alias("reference"), x.tokens.alias("tokens")))
    learned = F.col("role") == LEARNED_ROLE
    start = F.char_length("head")
    mask = lambda place: F.when(learned, place).otherwise(0).cast("long")
    return (
        messages.select(
            F.col(f"`{key}`").alias("key"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), visitor.visit(F.col(f"`{parts}`")).alias("items")
        )
        .select("key", "turn", "role", "items", F.concat(F.lit(HEAD), name, F.lit(COLON)).alias("head"), F.array_join(written, "").alias("body"))
        .select(
            F.col("key").alias(key),
            F.col("turn").alias(turn),
            F.concat("head", "body", F.lit(END)).alias("formatted"),
            mask(start).alias("loss_start"),
            mask(start + F.char_length("body")).alias("loss_end"),
            F.filter(numbered, lambda x: x.kind != "text").alias("attachments"),
            F.aggregate("items", F.lit(0).cast("long"), lambda total, x: total + x.tokens).alias("expanded_tokens"),
        )
    )


def plain(body: str) -> str:
    """The text of a formatted body: without placeholders, escapes undone."""
    return unescaped(PLACEHOLDER.sub("", body) if "<|" in body else body)


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn; ValueError if it is not exactly one."""
    colon = formatted.find(COLON)
    if not formatted.startswith(HEAD) or colon < 0 or not formatted.endswith(END):
        raise ValueError("not a turn")
    body = formatted[colon + len(COLON) : -len(END)]
    if END in body or HEAD in body:
        raise ValueError("more than one turn")
    return unescaped(formatted[len(HEAD) : colon]), plain(body)


def read_back(formatted: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row per conversation, from what `format_turns` gave: digests of its turns and of what is learned.

    `n_turns`; `turns_sha256` over role, line feed, text, line feed of every turn; `loss_chars`
    and `loss_sha256` of the texts under the loss mask, joined without anything between;
    `formatted_chars`. Turns count in order of `turn` (null first), ties in order of what is
    formatted. A digest takes its bytes in order, so the turns of a conversation are sorted
    into one partition, on disk if there are many, and read as a stream: what a task holds does
    not grow with them. Null keys are one conversation. An empty table gives an empty one.
    """
    schema = T.StructType(
        [
            T.StructField(key, formatted.schema[key].dataType),
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )
    kind = pa.RecordBatch

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        done: list[tuple] = []
        types = None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [[]] * 6
            done.clear()
            return kind.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=schema.names)

        def close() -> None:
            owner, turns, whole, chars, loss, size = state
            done.append((owner, turns, whole.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            types = [batch.schema.field("key").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "formatted", "loss_start", "loss_end")))
            for owner, written, low, high in rows:
                if state is None or owner != state[0]:
                    if state is not None:
                        close()
                    state = [owner, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_turn(written)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                learned = plain(written[low:high])
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += len(written)
            if len(done) > 10_000:
                yield flush()
        if state is not None:
            close()
            yield flush()

    rows = formatted.select(F.col(f"`{key}`").alias("key"), F.col(f"`{turn}`").alias("turn"), "formatted", "loss_start", "loss_end")
    together = rows.repartition("key").sortWithinPartitions("key", "turn", "formatted")
    return together.select("key", "formatted", "loss_start", "loss_end").mapInArrow(digest, schema)
