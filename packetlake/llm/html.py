"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped in one pass: each block element ends a line, white space in
a line becomes one blank. Lines inside elements that never hold main text
(scripts, navigation, forms, page furniture, reader comments) are stripped with
the markup. Each line that is left weighs its text outside links; a line of the
article that a page declares weighs a surge more. The weights are summed over
sliding windows of lines, within the article and outside it. A sum that reaches
the threshold on a line with text is a surge point; the stretch around it ends
where what lies ahead falls to nothing or to link text, and begins after such a
line, so short lines at either end belong to it. All stretches are kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lines of a window, and the characters that make a surge.
WINDOW_LINES = 3
SURGE_CHARS = 90

# Element names by role.
RAW_TEXT = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "object")
# Of these, the ones that XML's short form closes.
FOREIGN = ("svg",)
DROPPED = frozenset((
    *RAW_TEXT, "head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "canvas",
    "audio", "video", "label", "fieldset", "annotation", "annotation-xml",
))
VOID = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
))
INLINE = frozenset((
    "a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "img", "ins", "kbd", "mark", "q", "ruby", "rb", "rt", "rp", "s", "samp", "small", "span", "strike",
    "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "acronym", "picture", "source", "area", "map",
    "math", "menclose", "merror", "mfenced", "mfrac", "mi", "mn", "mo", "mover", "mpadded", "mphantom", "mroot",
    "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr",
    "munder", "munderover", "semantics", "annotation", "annotation-xml",
))
# Elements that the next one of their name, or their parent's end, closes.
OPEN_ENDED = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option"))
FURNITURE_WORDS = frozenset((
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor",
    "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead",
    "comment", "comments", "respond", "disqus", "replies", "share", "sharing", "social", "related",
    "recommended", "newsletter", "subscribe", "signup", "popup", "modal", "overlay", "widget", "toolbar",
    "pagination", "pager", "login", "search", "skip",
))
# What a compound class of furniture ends in, such as ad-slot.
BOX_WORDS = frozenset((
    "area", "bar", "block", "body", "box", "button", "buttons", "card", "container", "icons", "inner", "item",
    "items", "links", "list", "outer", "panel", "post", "posts", "slot", "thread", "unit", "wrap", "wrapper",
))
PAGE_HEADERS = frozenset(("header", "topbar"))
FURNITURE_ROLES = frozenset((
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar",
))
NEUTRAL_STARTS = frozenset(("has", "no", "with", "without", "is"))
NEVER_FURNITURE = frozenset(("html", "body", "main", "article"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:" + "|".join(FOREIGN) + r")\b(?:[^>\"'/]++|/(?!>)|\"[^\"]*+\"|'[^']*+')*+/>"
    r"|<(?P<raw>" + "|".join(RAW_TEXT) + r")\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?][^>]*+>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(
    r"(?<![^\s\"'/])(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.IGNORECASE
)
_NUMBERED = re.compile(r"(?:comment|reply|ad)[-_]?\d+")
_SPACE = re.compile(r"\s+")


@dataclass
class Line:
    text: str
    linked: int
    inside: bool


def _names_furniture(token: str) -> bool:
    """A furniture word, or such words with names of boxes only."""
    words = frozenset(re.split(r"[-_:]+", token)) - {""}
    return bool(words & FURNITURE_WORDS) and words <= FURNITURE_WORDS | BOX_WORDS


def _is_furniture(name: str, attributes: str, inside: bool) -> bool:
    if name in DROPPED:
        return True
    if name == "header":
        return not inside
    if name in NEVER_FURNITURE or not attributes.strip():
        return False
    for found in _ATTRIBUTE.finditer(attributes):
        key = found[1].lower()
        value = html.unescape(found[2] or found[3] or found[4] or "").lower()
        if key == "hidden":
            return True
        if key == "role":
            if value.strip() in FURNITURE_ROLES:
                return True
            continue
        if inside:
            # An article's own headings and sections have such words in slugs.
            if key == "class" and any(map(_names_furniture, value.split())):
                return True
            if key == "id" and _NUMBERED.fullmatch(value.strip()):
                return True
            continue
        for token in value.split():
            words = re.split(r"[-_:]+", token)
            if words[0] in NEUTRAL_STARTS:
                continue
            if FURNITURE_WORDS.intersection(words):
                return True
            if PAGE_HEADERS.intersection(words):
                return True
    return False


class _Stripper:
    """Lines of a page in order, without markup and furniture."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self._parts: list[str] = []
        self._linked = 0
        self._inside = 0  # open article or main elements
        self._links = 0
        self._dropped = ""  # element whose end brings text back
        self._depth = 0

    def feed(self, page: str) -> list[Line]:
        at = 0
        for token in _TOKEN.finditer(page):
            self._text(page[at:token.start()])
            at = token.end()
            if token["name"]:
                self._tag(token["name"].lower(), bool(token["end"]), token["attrs"])
            elif token["raw"] and not self._dropped:
                self._parts.append(" ")
        self._text(page[at:])
        self._break()
        return self.lines

    def _text(self, raw: str) -> None:
        if raw and not self._dropped:
            text = html.unescape(raw)
            self._parts.append(text)
            if self._links:
                self._linked += len(text.strip())

    def _break(self) -> None:
        text = _SPACE.sub(" ", "".join(self._parts)).strip()
        if text:
            self.lines.append(Line(text, self._linked, self._inside > 0))
        self._parts, self._linked = [], 0

    def _tag(self, name: str, end: bool, attributes: str) -> None:
        if self._dropped:
            self._skip(name, end)
            if self._dropped or end:
                return
        if name not in INLINE:
            self._break()
            self._links = 0
        elif name == "br":
            self._parts.append(" ")
        if name == "a":
            self._links = 0 if end else 1
        if name in ("article", "main"):
            if not end and not _comment_like(attributes):
                self._inside += 1
            elif end:
                self._inside = max(0, self._inside - 1)
            elif not end:
                self._dropped, self._depth = name, 1
                return
        if not end and name not in VOID and _is_furniture(name, attributes, self._inside > 0):
            if not attributes.rstrip().endswith("/") or name not in RAW_TEXT:
                self._dropped, self._depth = name, 1

    def _skip(self, name: str, end: bool) -> None:
        """Follow the nesting of the dropped element."""
        if name == self._dropped:
            if name in OPEN_ENDED:
                self._dropped = ""
            else:
                self._depth += -1 if end else 1
                if not self._depth:
                    self._dropped = ""
        elif name in NEVER_FURNITURE and (end or name == "body"):
            # An end of the page's own containers ends whatever was left open.
            self._dropped = ""
            if end and name in ("article", "main"):
                self._inside = max(0, self._inside - 1)
        elif self._dropped == "head" and name == "article":
            self._dropped = ""
        elif self._dropped == "p" and name not in INLINE:
            self._dropped = ""
        elif self._dropped in OPEN_ENDED and end and name not in INLINE and name not in OPEN_ENDED:
            self._dropped = ""


def _comment_like(attributes: str) -> bool:
    """An article element can hold a reader's comment or a teaser."""
    return _is_furniture("div", attributes, True)


def strip_markup(page: str) -> list[Line]:
    return _Stripper().feed(page)


def line_weights(lines: list[Line]) -> list[int]:
    """Characters outside links; a line of the declared article weighs a surge
    more, links included."""
    return [
        len(line.text) + SURGE_CHARS if line.inside else max(0, len(line.text) - line.linked)
        for line in lines
    ]


def link_weights(lines: list[Line]) -> list[int]:
    """Characters in links, where they count against the text."""
    return [0 if line.inside else min(line.linked, len(line.text)) for line in lines]


def text_spans(weights: list[int], linked: list[int] | None = None) -> list[tuple[int, int]]:
    """(surge, dive) line numbers, dive exclusive, of each stretch of text.

    A stretch grows from a line whose window reaches the threshold, back and
    forth over lines with more text than links. A line of links ends it, unless
    the rest of the window behind it has more text than links: then the line is
    part of the text."""
    linked = linked or [0] * len(weights)
    own = [weight > links for weight, links in zip(weights, linked, strict=True)]
    spans, i, free = [], 0, 0
    while i < len(weights):
        if not own[i] or sum(weights[i:i + WINDOW_LINES]) < SURGE_CHARS:
            i += 1
            continue
        start = i
        while start > free and own[start - 1]:
            start -= 1
        while i < len(weights):
            ahead = slice(i + 1, i + WINDOW_LINES)
            if not own[i] and sum(weights[ahead]) <= sum(linked[ahead]):
                break
            i += 1
        spans.append((start, i))
        free = i
    return spans


def main_text(page: str) -> str:
    lines = strip_markup(page)
    kept = []
    # The borders of the declared article end a stretch, too.
    for _, part in groupby(lines, key=lambda line: line.inside):
        run = list(part)
        for start, end in text_spans(line_weights(run), link_weights(run)):
            kept.extend(line.text for line in run[start:end])
    return "\n\n".join(kept)


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``; a null or empty
    page, or one without main text, has an empty text. Pages of any length are
    read whole. Null ids and addresses and repeated rows stay; other columns are
    not looked at; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "") for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(
        F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")
    ).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
