"""Text blocks of a page with the zone each of them stands in."""

from __future__ import annotations

import re
from html import unescape

OPEN, ARTICLE, FRAME = 0, 1, 2

# Possessive, so that an open quote costs one pass.
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*+)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>|(?P<text>[^<]++|<)",
    re.S,
)
RAW_END = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")}
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that never are the article's text.
FRAMES = frozenset("nav footer aside form menu dialog select button head svg object audio video canvas datalist fieldset".split())
ARTICLES = frozenset(("article", "main"))
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
# What an open paragraph ends at.
ENDS_P = BLOCKS - {"body", "html", "caption", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
# Words in classes, ids and roles that name a frame or the article.
FRAME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification "
    "pager pagination popup promo promotion related replies respond share sharing sidebar signup skip social sponsor sponsored "
    "subscribe toolbar topbar widget complementary contentinfo search alert dialog".split()
)
ARTICLE_WORDS = frozenset(("article", "articlebody", "main", "entry", "post", "story"))
WORDS = re.compile(r"[A-Za-z]+")
SPACE = re.compile(r"\s+")


def zone_of(name: str, rest: str, within: int) -> int:
    """The zone of an element from its name and attributes; a frame stays one inside."""
    if within == FRAME or name in FRAMES:
        return FRAME
    if name == "header" and within != ARTICLE:
        return FRAME
    if name in ("html", "body"):
        return within
    words: set[str] = set()
    if rest and ("class" in rest or "id" in rest or "role" in rest or "hidden" in rest):
        for attribute, *values in ATTRIBUTE.findall(rest):
            value = "".join(values)
            if attribute.lower() == "hidden" or attribute.lower() == "aria-hidden" and value == "true":
                return FRAME
            words.update(w.lower() for w in WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value)))
    if words & FRAME_WORDS:
        return FRAME
    if name in ARTICLES or name in ("div", "section", "td") and words & ARTICLE_WORDS:
        return ARTICLE
    return within


def blocks_of(html: str) -> list[tuple[int, str]]:
    """(zone, text) of every block in page order: references decoded, white space one space, trimmed.

    Blocks end at block elements; inline elements and line breaks don't end one. Scripts,
    styles, comments and what a browser would not show give nothing.
    """
    found: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    zone, parts, at = OPEN, [], 0

    def end_block() -> None:
        if parts:
            text = SPACE.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if text:
                found.append((zone, text))

    while token := TOKEN.match(html, at):
        at = token.end()
        if text := token.group("text"):
            parts.append(text)
            continue
        if not (name := token.group("name")):
            continue
        name = name.lower()
        if token.group("close"):
            if name in BLOCKS or name in FRAMES:
                end_block()
            if any(open_ == name for open_, _ in stack):
                while stack[-1][0] != name:
                    stack.pop()
                zone = stack.pop()[1]
            continue
        if raw := RAW_END.get(name):
            if not token.group("rest").endswith("/"):
                final = raw.search(html, at)
                at = final.start() if final else len(html)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS or name in FRAMES:
            end_block()
        if name in VOID:
            continue
        if name in ENDS_P:
            # A paragraph has no end tag where another block begins.
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    zone = stack[depth][1]
                    del stack[depth:]
                    break
                if stack[depth][0] in BLOCKS:
                    break
        if name == "li":
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "li":
                    zone = stack[depth][1]
                    del stack[depth:]
                    break
                if stack[depth][0] in ("ul", "ol", "menu"):
                    break
        inner = zone_of(name, token.group("rest"), zone)
        if not token.group("rest").endswith("/") or name in BLOCKS:
            stack.append((name, zone))
            zone = inner
    end_block()
    return found
