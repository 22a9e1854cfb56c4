"""Main text of web pages by tag-path ratios.

A page is cut into blocks at block-level tags; each block has the path of open elements from the root to
its text. Over all blocks of one path the text length, the punctuation and the text inside links are added
up. The ratio of a path is its text per block, smoothed with the paths next to it in page order, fused with
its punctuation and the share of text outside links. Paths above a share of the best ratio hold content;
paths that lie in the same article as the best path are fused with it, so short headings and short
paragraphs of the article stay. Paths through menus, headers, footers, sidebars, notices, adverts, forms,
reader comments and elements without visible text never hold content.

White space inside a block, line-break tags included, becomes one space; character references are decoded;
blocks are joined in page order by one newline. Null and empty pages give an empty text. Unclosed, broken
and cut-off markup is read as far as it goes. Pages are independent of each other: no shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import small_batches

# Names of HTML elements. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea template iframe title svg math object select canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br img".split()
)
OUTSIDE = frozenset("nav header footer aside form menu dialog head button fieldset".split())
#: A new element of the key closes an open one of these.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"},
}
#: What a search for an element to close does not go beyond.
FENCES = frozenset("table ul ol dl article section main div body html td th blockquote".split())
_OUTSIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side|aside|header|"
    r"masthead|footer|foot|cookies?|consent|notice|notification|alert|popup|modal|newsletter|subscribe|signup|login|"
    r"comments?|respond|replies|disqus|discussion|share|sharing|social|related|recommended|widget|toolbar|pagination|"
    r"pager|copyright|disclaimer|gdpr|hidden|skip)(?:$|[\s_-])", re.IGNORECASE,
)
_INSIDE_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text)(?:$|[\s_-])", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")
_WHITE = re.compile(r"\s+")
LEAST_SHARE = 0.25


class Block:
    __slots__ = ("path", "text", "linked", "outside", "holder")

    def __init__(self, path, text, linked, outside, holder):
        self.path, self.text, self.linked, self.outside, self.holder = path, text, linked, outside, holder


def _outside(name: str, attributes: str) -> bool:
    if name in OUTSIDE:
        return True
    if not attributes.strip():
        return False
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")):
        return True
    if found.get("role", "") in {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "dialog", "alert"}:
        return True
    if name in {"article", "main", "body", "html"}:
        return bool(re.search(r"comment|advert|promo|related", found.get("class", "") + " " + found.get("id", ""), re.IGNORECASE))
    return any(_OUTSIDE_NAMES.search(found.get(k, "")) and not _INSIDE_NAMES.fullmatch(found.get(k, "")) for k in ("class", "id"))


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order with their paths."""
    blocks: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # name, outside, number of its article or main
    pieces: list[str] = []
    linked, serial, at, n = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal pieces, linked
        text = _WHITE.sub(" ", html.unescape("".join(pieces))).strip() if pieces else ""
        if text:
            path = tuple(e[0] for e in stack if e[0] not in INLINE)
            outside = any(e[1] for e in stack)
            blocks.append(Block(path, text, linked, outside, next((e[2] for e in reversed(stack) if e[2]), 0)))
        pieces, linked = [], 0

    def text_until(end: int) -> None:
        nonlocal linked
        if end > at:
            pieces.append(page[at:end])
            if any(e[0] == "a" for e in stack):
                linked += end - at

    while at < n:
        tag = _TAG.search(page, at)
        if tag is None:
            text_until(n)
            break
        text_until(tag.start())
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing, attributes = tag[1] or tag[4], tag[3] or tag[6] or ""
        block = name not in INLINE
        if name == "br":
            pieces.append(" ")
            continue
        if block and name not in RAW:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if not block and stack[i][0] not in INLINE:
                    break
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else n
            continue
        if name in VOID:
            continue
        if block:
            ends = ENDS.get(name, set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends or stack[i][0] == "p" and name != "p" or stack[i][0] == name == "p":
                    del stack[i:]
                    if name not in ENDS or name == "li":
                        break
                elif stack[i][0] in FENCES:
                    break
        if not attributes.rstrip().endswith("/"):
            serial += 1
            stack.append((name, _outside(name, attributes), serial if name in {"article", "main"} else 0))
    flush()
    return blocks


def main_text(page: str | None) -> str:
    """The article of a page, or an empty text."""
    blocks = blocks_of(page) if page else []
    inside = [b for b in blocks if not b.outside]
    if not inside:
        return ""
    sums: dict[tuple, list[float]] = {}
    for b in inside:
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        for i, x in enumerate((len(b.text), len(_PUNCTUATION.findall(b.text)), min(b.linked, len(b.text)), 1)):
            s[i] += x
    density = {p: s[0] / s[3] for p, s in sums.items()}
    near: dict[tuple, list[float]] = {p: [] for p in sums}
    for i, b in enumerate(inside):
        around = inside[max(0, i - 1) : i + 2]
        near[b.path].append(sum(density[x.path] for x in around) / len(around))
    ratio = {
        p: (density[p] + sum(near[p]) / len(near[p])) / 2 * math.log1p(s[0]) * (0.2 + min(1.0, 20 * s[1] / s[0])) * (1 - s[2] / s[0]) ** 2
        for p, s in sums.items()
    }
    best = max(ratio, key=lambda p: ratio[p] * math.sqrt(sums[p][0]))
    least = LEAST_SHARE * ratio[best]
    content = {p for p in ratio if ratio[p] > 0 and (ratio[p] >= least or p[:-1] == best[:-1] and sums[p][2] < 0.5 * sums[p][0])}
    content.add(best)
    holders = {b.holder for b in inside if b.path in content and b.holder}
    if holders:
        kept = [b for b in inside if b.holder in holders]
    else:
        kept = [b for b in inside if b.path in content]
    return "\n".join(b.text for b in kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p) for p in batch], dtype=object)

    # Spark counts code points
    return pages.select("page_id", "url", run("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
