"""Arrow columns in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text, and texts, that are worked on at once: what a task holds follows these and not the size of Spark's batches.
BYTES_AT_ONCE, TEXTS_AT_ONCE = 1 << 20, 512


def slices(texts: pa.Array, most_bytes: int = BYTES_AT_ONCE, most_texts: int = TEXTS_AT_ONCE) -> Iterator[pa.Array]:
    """Parts of about `most_bytes` and at most `most_texts`, in order; a text is never cut."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    first = 0
    while first < len(texts):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + most_bytes, "right")))
        last = min(last, first + most_texts)
        yield texts.slice(first, last - first)
        first = last
