"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass scores every block by its stop-word density,
its length, its link density and its region (article, menu, footer, comments, none ...): high scores are
good, low ones bad, short and in-between blocks stay open. The second pass gives an open block the label of
its nearest decided neighbours, first those in the smallest element around it that holds one.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from explainkit.llm.common import map_rows

#: Element names by their part in a page. The content of RAW elements is text without tags; PHRASE
#: elements hold no block; HOLDERS may hold blocks; none of them is part of a page's text.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
PHRASE = {"button", "select", "datalist", "svg", "math"}
HOLDERS = {"noscript", "template", "object", "canvas", "video", "audio", "head"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption"}
SHUT_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "figcaption", "summary", "legend"}
BAD_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
BAD_HINTS = {
    "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "header", "masthead", "topbar", "footer", "sidebar", "aside", "rail", "widget", "widgets",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "banner", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "paywall",
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promos", "promotion", "comment", "comments", "reply", "replies", "disqus", "respond",
    "related", "recommended", "share", "sharing", "social", "login", "search", "pagination", "pager", "toolbar", "disclaimer", "copyright", "skip",
}
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all their there been if more when will would who so no what its we can has about "
    "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man "
    "le la les de des du un une et à en que qui dans est pour par sur au aux ce il elle on ne pas se plus avec son sa ses ou mais nous vous leur comme "
    "el los las del y que en un una por con no se su para es al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos".split()
)

#: Scores of a block's region: inside an article, beside the articles of a page that has some, inside boilerplate.
INSIDE, BESIDE, BOILERPLATE = 5.5, -4.0, -14.0
#: A block is good from the first score up, bad from the second one down.
GOOD, BAD = 1.5, -2.5
#: Elements around a block that count; what is nested deeper counts as part of the last of them.
NESTED = 256

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))
    | <(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)
      (?P<attrs>[\s/]*+(?:[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+[\s/]*+)*+)(?:>|\Z)
    | <[!?/][^>]*(?:>|\Z)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})(?=[\s/>])", re.I)


@dataclass
class Block:
    """A run of text between block-level tags; ``path`` names the elements around it, outermost first."""

    boilerplate: bool
    article: int
    heading: bool
    path: tuple[int, ...] = ()
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


@dataclass
class _Open:
    name: str
    bad: bool
    article: int
    article_header: bool
    number: int = 0


def _hinted(name: str, attrs: str) -> bool:
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role":
            if value.strip().lower() in BAD_ROLES:
                return True
        elif key in {"class", "id"} and name not in {"html", "body"} and any(w.lower() in BAD_HINTS for w in _WORDS.findall(value)):
            return True
    return False


class _Ahead:
    """The next closing or block-level tag from a place on; a tag found once serves all places before it."""

    def __init__(self, page: str) -> None:
        self.page, self.found = page, {}

    def _next(self, key: str, pattern: re.Pattern, at: int) -> re.Match | None:
        if key not in self.found or (self.found[key] and self.found[key].start() < at):
            self.found[key] = pattern.search(self.page, at)
        return self.found[key]

    def closing(self, name: str, at: int) -> re.Match | None:
        return self._next(name, re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I), at)

    def skipped(self, name: str, at: int) -> int:
        """Where the text goes on behind an element that is left out.

        Raw elements end at their closing tag. Without one, scripts and styles run to the end of the head or of
        the page as in a browser; other elements, and phrases that a block interrupts, end at the next
        block-level tag.
        """
        end, block = self.closing(name, at), self._next("", _BLOCK_TAG, at)
        if end and (name in RAW or not block or end.start() <= block.start()):
            return end.end()
        if not end and name in {"script", "style"}:
            body = re.compile(r"</head\b|<body\b", re.I).search(self.page, at)
            return body.start() if body else len(self.page)
        return block.start() if block else len(self.page)


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, each with its region."""
    stack = [_Open("", False, 0, False)]
    out: list[Block] = []
    ahead, names = _Ahead(page), Counter()
    block, link, heading, articles, opened, at = None, 0, 0, 0, 0, 0
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and (block is not None or text.strip()):
            if block is None:
                top = stack[-1]
                block = Block(top.bad or top.article_header and not heading, top.article, bool(heading), tuple(o.number for o in stack[:NESTED]))
                out.append(block)
            block.parts.append(text)
            if link:
                block.linked += len(text.strip())
        if not m:
            return out
        at = m.end()
        name, closing = (m["name"] or "").lower(), bool(m["end"])
        if not name:
            continue
        if name in RAW or name in PHRASE:
            if not closing and (name in RAW or not m["attrs"].endswith("/")):
                at = ahead.skipped(name, at)
            continue
        if name == "a":
            link = 0 if closing else 1
            continue
        if name == "br":
            if block is not None:
                block.parts.append(" ")
            continue
        if name in HOLDERS:
            if not closing and not ahead.closing(name, at):
                at = ahead.skipped(name, at) if name != "head" else at
                continue
        elif name not in BLOCK:
            continue
        block = None
        if name == "body":  # what a head left open ends here
            while stack[-1].name == "head":
                names[stack.pop().name] -= 1
        if name[0] == "h" and name[1:].isdigit():
            heading = 0 if closing else 1
            continue
        if name in {"hr", "p"}:
            heading = 0
            if name == "p" and not closing and _hinted(name, m["attrs"]):
                opened += 1
                stack.append(_Open("p", True, stack[-1].article, False, opened))
            elif stack[-1].name == "p":
                stack.pop()
            continue
        if stack[-1].name == "p" and name in SHUT_P:
            stack.pop()
        if closing:
            while names[name]:
                names[last := stack.pop().name] -= 1
                if last == name:
                    heading = link = 0
                    break
        else:
            top, hinted = stack[-1], _hinted(name, m["attrs"])
            opened += 1
            new = _Open(name, top.bad or hinted or name in BAD_TAGS or name in HOLDERS, top.article, top.article_header, opened)
            if name in {"article", "main"} and not hinted and not any(o.name in BAD_TAGS or o.name in HOLDERS for o in stack):
                articles += 1
                new.bad, new.article = False, top.article or articles
            elif name == "header":
                new.bad, new.article_header = top.bad or hinted or not top.article, bool(top.article)
            stack.append(new)
            names[name] += 1


def block_score(text: str, linked: int, heading: bool, region: float) -> float:
    """Evidence that a block is part of the main text.

    Length counts from -1.5 (14 characters and less) over 0 (40) to 2 (160 and more), stop words from -0.5 (none)
    to 1.5 (15 % of the words and more), links from 0 (a quarter of the characters) to -6 (three quarters), a
    heading 1.
    """
    words = text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    length = min(2.0, max(-1.5, math.log2(len(text) / 40)))
    links = min(1.0, max(0.0, (linked / len(text) - 0.25) / 0.5))
    return length + 2 * min(1.0, stops / 0.15) - 0.5 - 6 * links + heading + region


def first_pass(found: list[tuple[Block, str]]) -> list[float]:
    """The score of every block; its region counts beside its text."""
    articles = any(b.article for b, _ in found)
    region = lambda b: BOILERPLATE if b.boilerplate else INSIDE if b.article else BESIDE if articles else 0.0
    return [block_score(t, b.linked, b.heading, region(b)) for b, t in found]


def second_pass(found: list[tuple[Block, str]], scores: list[float]) -> list[bool]:
    """Whether each block is good, the open ones by their neighbours.

    The nearest decided blocks before and behind are sought in the innermost element around the block, then in
    the next one outwards. The nearer one's label holds; at equal distance a heading goes with what follows it,
    any other block with its own score. Boilerplate inside an article says nothing about the article: an article
    block without another decided block in its article is good. A page without any decided block is all good.
    """
    n, decided = len(scores), [s >= GOOD or s <= BAD for s in scores]
    around: list[list[list[int]]] = [[], []]
    for side, order in enumerate((range(n), range(n - 1, -1, -1))):
        last: dict[tuple[int, int], int] = {}
        seen: list[list[int]] = [[] for _ in range(n)]
        for i in order:
            block = found[i][0]
            if not decided[i]:
                seen[i] = [last.get((e, block.article), -1) for e in block.path]
                continue
            for e in block.path:
                if not block.boilerplate:
                    last[e, block.article] = i
                last[e, 0] = i
        around[side] = seen
    out = []
    for i, (block, _) in enumerate(found):
        if decided[i]:
            out.append(scores[i] >= GOOD)
            continue
        label = bool(block.article) or not any(decided)
        for p, q in zip(reversed(around[0][i]), reversed(around[1][i]), strict=True):
            if p < 0 and q < 0:
                continue
            near = [j for j in (p, q) if j >= 0]
            labels = {scores[j] >= GOOD for j in near if abs(i - j) == min(abs(i - k) for k in near)}
            label = labels.pop() if len(labels) == 1 else scores[q] >= GOOD if block.heading else scores[i] >= 0
            break
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by an empty line; null or empty pages give empty text."""
    found = [(b, t) for b in blocks(page or "") if (t := b.text())]
    return "\n\n".join(t for (_, t), good in zip(found, second_pass(found, first_pass(found)), strict=True) if good)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of each page.

    Null or empty html gives empty text; truncated pages give what they hold; very long pages are read whole;
    neighbours at equal distance are decided as :func:`second_pass` says; repeated rows and null ids are each
    answered; extra columns don't matter; an empty table gives no rows. No shuffle.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def work(cols: list[list]) -> list[list]:
        texts = [main_text(h) for h in cols[2]]
        return [cols[0], cols[1], texts, [len(t) for t in texts]]

    return map_rows(rows, ["page_id", "url", "html"], work, "page_id long, url string, text string, n_chars long")
