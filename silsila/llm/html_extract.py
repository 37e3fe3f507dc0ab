"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. The first pass decides a block by itself, from its length, its link
density and its share of stop words; structure that names itself (menus, footers, forms, adverts, comments and the
like) is decided as boilerplate before that. Short and middling blocks stay undecided, and the second pass gives them
the label of the nearest decided blocks.
"""

from __future__ import annotations

import collections
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_arrow

#: Common function words of English, German, French and Spanish: a choice of our own.
STOP_WORDS = frozenset(
    """the of and to in is was for that it on with as be by at are this from or an have not but they his he had which you were
    der die das und ist nicht ein eine zu den dem von mit auf für im des sich auch es an als bei aus nach wird sind war
    le la les de des et un une est que qui dans en du pour pas sur au avec ce il par plus son se sont ne aux ou
    el los las y una por con no su para al lo como más o pero sus del se""".split()
)

LONG_LINKS, LOW_LINKS = 0.5, 0.2
SHORT, LONG = 70, 200
LOW_STOPS, HIGH_STOPS = 0.12, 0.25

_RAW = frozenset("script style noscript template svg math iframe object canvas textarea title xmp".split())
_OPENS = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
#: The rest of a tag: quoted values may hold anything. Nothing is tried twice, so a failure costs one look at the rest.
_REST = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
#: After so many tags of a page whose quotes never close, quotes are taken for ordinary characters in the rest of it.
STRAY_QUOTES = 8
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CONTAINERS = frozenset("body head nav header footer aside form div section article main ul ol dl table figure details dialog menu fieldset select button blockquote center".split())
_BAD_TAGS = frozenset("head nav footer aside form dialog menu select button fieldset".split())
_BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer\w*|masthead|topbar|toolbar|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|search\w*|share\w*|sharing|social\w*|related\w*|recommend\w*|widget\w*|copyright|legal|disclaimer|pagination|pager|skip\w*)(?:$|[\s_-])", re.I
)
_COMMENT_NAME = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus\w*|replies|respond|reader-?comments?|discussion)(?:$|[\s_-])", re.I)
_BAD_ROLE = re.compile(r"navigation|banner|contentinfo|complementary|search|dialog|alert|menu", re.I)
_NAMES = re.compile(r"\b(class|id|role|aria-label|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    region: int
    article: bool
    decided: bool | None
    heading: bool = False


def _kind(tag: str, attributes: str, in_article: bool) -> str:
    """'', 'bad' or 'comment' for an element that opens."""
    if tag in _BAD_TAGS or tag == "header" and not in_article:
        return "bad"
    if "=" in attributes or "hidden" in attributes.lower():
        for m in _NAMES.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "aria-label") and _COMMENT_NAME.search(value):
                return "comment"
            if name in ("class", "id") and tag not in ("body", "main") and _BAD_NAME.search(value) or name == "role" and _BAD_ROLE.search(value):
                return "bad"
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
                return "bad"
    return ""


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str, str]]:
    """(start, end, literal text, closing, tag, attributes) of all markup in order; comments and the like have no tag.

    Elements whose content is no text, such as scripts, are one piece of markup up to their end. Time follows the
    page's length, however malformed it is.
    """
    at, stray, last = 0, 0, page.rfind(">")
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, "", ""
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            yield at, len(page) if end < 0 else end + 3, page[at + 9 : end if end >= 0 else None], False, "", ""
            end = len(page) if end < 0 else end + 3
        elif at > last:
            return
        elif page[at + 1] in "!?":
            end = page.find(">", at) + 1
            yield at, end, "", False, "", ""
        elif m := _OPENS.match(page, at):
            rest = _REST.match(page, m.end()) if stray < STRAY_QUOTES else None
            stray += rest is None
            end = rest.end() if rest else page.find(">", m.end()) + 1
            tag, attributes = m[2].lower(), page[m.end() : end - 1]
            if tag in _RAW and not m[1]:
                if not attributes.endswith("/"):
                    close = re.compile(rf"</{tag}\s*+>", re.I).search(page, end)
                    end = close.end() if close else len(page)
                tag = ""
            yield at, end, "", bool(m[1]), tag if tag not in _RAW else "", attributes
        else:
            end = at + 1
        at = end


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, with what structure alone decides."""
    out: list[Block] = []
    stack: list[tuple[str, str, int, bool]] = []  # tag, kind, region, whether in the article
    places: dict[str, list[int]] = collections.defaultdict(list)  # of each open tag on the stack
    pieces: list[str] = []
    linked, in_link, heading, breaks, regions = 0, 0, False, 0, 0
    at = 0

    def flush():
        nonlocal linked, breaks
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            _, kind, region, article = stack[-1] if stack else ("", "", 0, False)
            out.append(Block(text, linked, region, article, False if kind else None, heading))
        pieces.clear()
        linked = breaks = 0

    def say(raw: str):
        nonlocal linked, breaks
        if raw:
            pieces.append(raw)
            if in_link:
                linked += len(raw)
            if not raw.isspace():
                breaks = 0

    for start, end, literal, closing, tag, attributes in tags(page):
        say(page[at:start])
        at = end
        if literal:
            say(html.escape(literal, False))
        if not tag:
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        if tag == "br":
            breaks += 1
            say(" ")
            if breaks > 1:
                flush()
            continue
        flush()
        if re.fullmatch("h[1-6]", tag):
            heading = not closing
        elif tag not in ("hr", "wbr"):
            heading = False
        if tag in _CONTAINERS:
            in_link = 0
            if closing:
                own = places[tag]
                wall = max((places[t][-1] for t in ("article", "main") if places[t]), default=-1)
                if own and (own[-1] > wall or tag in ("body", "main", "article")):
                    for gone in stack[own[-1] :][::-1]:
                        places[gone[0]].pop()
                        stack.pop()
            else:
                _, outer, region, article = stack[-1] if stack else ("", "", 0, False)
                kind = _kind(tag, attributes, article)
                if tag == "body":
                    outer = ""
                if tag in ("article", "main"):
                    regions += 1
                    region, article = regions, kind == "" and outer != "comment"
                    # An article is none of an unclosed menu's business.
                    outer = outer if outer == "comment" else ""
                places[tag].append(len(stack))
                stack.append((tag, outer if outer == "comment" else kind or outer, region, article))
    say(page[at:] if "<" not in page[at:] else re.sub(r"<[a-zA-Z/!?][^<]*\Z", "", page[at:]))
    flush()
    return out


def decide(b: Block) -> bool | None:
    """The first pass: True main text, False boilerplate, None undecided."""
    if b.decided is not None:
        return b.decided
    n = len(b.text)
    links = min(b.linked / n, 1.0)
    if links > LONG_LINKS or n < LONG and "©" in b.text[:20]:
        return False
    if n < SHORT or b.heading:
        return False if links > LOW_LINKS else None
    words = _WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    if stops >= HIGH_STOPS:
        return True if n >= LONG or b.article else None
    if stops >= LOW_STOPS:
        return True if b.article else None
    return None if b.article else False


def label(page_blocks: list[Block]) -> list[bool]:
    """Both passes. An undecided block takes the label of the nearest decided block of its own article, else of any.

    Where the blocks before and behind are equally near and differ, a heading follows what comes behind it and other
    blocks follow the main text. Undecided blocks of an article without any decided block are main text.
    """
    first = [decide(b) for b in page_blocks]
    n = len(first)
    # One walk either way finds the nearest decided blocks of all.
    out = []
    left = _walk(page_blocks, first, range(n))
    right = _walk(page_blocks, first, range(n - 1, -1, -1))
    for k, b in enumerate(page_blocks):
        if first[k] is not None:
            out.append(first[k])
            continue
        own = _choose(k, b, left[k][0], right[k][0])
        if own is None and b.article:
            own = True
        if own is None:
            own = _choose(k, b, left[k][1], right[k][1])
        out.append(bool(own))
    return out


def _walk(page_blocks: list[Block], first: list[bool | None], order: range) -> list:
    """For each block the (place, label) of the last decided one passed: in its own region by the rules, and anywhere."""
    out: list = [None] * len(first)
    own: dict[int, tuple[int, bool]] = {}
    anywhere = None
    for k in order:
        b = page_blocks[k]
        out[k] = (own.get(b.region), anywhere)
        if first[k] is not None:
            anywhere = (k, first[k])
            if b.decided is None:
                own[b.region] = anywhere
    return out


def _choose(k: int, b: Block, before, behind) -> bool | None:
    if before is None or behind is None:
        found = before or behind
        return found[1] if found else None
    if k - before[0] != behind[0] - k:
        return before[1] if k - before[0] < behind[0] - k else behind[1]
    if before[1] != behind[1]:
        return behind[1] if b.heading else True
    return before[1]


def main_text(page: str) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, good in zip(found, label(found), strict=True) if good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    A null or empty page, and one without main text, gives an empty text. Pages are read whole; nothing is capped.
    Repeated rows are extracted each; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "raw"):
                texts = [main_text(raw.decode("utf-8", "replace")) if raw else "" for raw in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("raw"))
    return rows.transform(map_arrow, run, "page_id long, url string, text string, n_chars long")
