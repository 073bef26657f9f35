"""Lyric text out of saved web pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantera.functions import text as X

# Elements without an end tag, and those whose text is not shown.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(("script", "style", "template"))


class _Containers(HTMLParser):
    """Text nodes of every element that has the wanted tag and attribute."""

    def __init__(self, tag: str, attribute: tuple[str, str] | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.attribute = tag, attribute
        self.found: list[list[str]] = []
        self.open: list[tuple[str, list[str] | None]] = []
        self.pending: list[str] = []

    def _flush(self):
        # Text handed over in pieces is one node until a tag or comment ends it.
        if self.pending:
            node = "".join(self.pending)
            self.pending = []
            if not self.open or self.open[-1][0] not in SILENT:
                for _, nodes in self.open:
                    if nodes is not None:
                        nodes.append(node)

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in VOID:
            return
        wanted = tag == self.tag and (self.attribute is None or dict(attrs).get(self.attribute[0]) == self.attribute[1])
        nodes: list[str] | None = [] if wanted else None
        if nodes is not None:
            self.found.append(nodes)
        self.open.append((tag, nodes))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                break

    def handle_comment(self, data):
        self._flush()

    def handle_data(self, data):
        self.pending.append(data)

    def close(self):
        super().close()
        self._flush()


def _texts(page: str, tag: str, attribute: tuple[str, str] | None) -> str | None:
    parser = _Containers(tag, attribute)
    parser.feed(page)
    parser.close()
    return "\n".join("\n".join(nodes) for nodes in parser.found) if parser.found else None


def container_text(
    pages: DataFrame, html: str, tag: str, attribute: tuple[str, str] | None = None, into: str = "text"
) -> DataFrame:
    """Add the text nodes of all matching containers, one per line; null when there is none.

    Pages that do not even contain the container's name are not parsed.
    """

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda page: None if page is None else _texts(page, tag, attribute))

    needle = attribute[0] if attribute else f"<{tag}"
    candidate = F.when(F.lower(html).contains(needle), F.col(html))
    return pages.withColumn(into, extract(candidate))


def lyrics_from_html(
    pages: DataFrame, html: str, tag: str, attribute: tuple[str, str] | None = None
) -> DataFrame:
    """Add `letra` and `status`: container text less annotations and empty lines.

    A page without a container has a null lyric and the status `no lyric`.
    """
    found = container_text(pages, html, tag, attribute, "_text")
    lyric = X.drop_empty_lines(X.strip_annotations(F.col("_text")))
    status = F.when(F.col("_text").isNull(), "no lyric").otherwise("found")
    return found.withColumns({"letra": lyric, "status": status}).drop("_text")
