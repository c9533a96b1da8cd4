"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block of text; whole elements that never hold article text
go with it. A line's weight is its length without link text, nothing if most of it is link text,
multiplied in a container the page marks (article, main, a named division). Weights are summed
over sliding windows of the lines of one container: where the sum surges above a threshold the
article starts, where it dives to nothing it ends, and the text between is kept. If surges lie in
containers of several ranks, those of the rank with the heaviest surge are kept. In an article or
main element that has a surge, lines behind a dive stay, too, unless they are link lines. A page
without a surge keeps the lines of its highest rank.

Only an ``a`` with ``href`` is a link; it ends with its own end, with the next ``a``, or with the
block it began in. Pages are read in one pass forward: how long reading takes grows with the page,
whatever its markup.

Defined cases: a null or empty page, and one without text, give an empty text. Repeated rows
each get a result, null page_id and url are carried. Markup that is never closed is read as far
as it goes. Other columns, whatever their names, are ignored; a table without rows gives none.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WINDOW = 3
# Weight a window holds at a surge.
SURGE = 80
# What a character weighs by the rank of its container: none, named division, main, article.
FACTORS = (1, 2, 2, 4)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPECIAL = re.compile("[>\"']")
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "xmp", "noembed", "noframes")}
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b")
_NUMBERED = re.compile(r"(ad|advert|banner|comment|sidebar|widget|article|entry|post|story)-?[0-9]+")

# Opening one of these ends an open one of the same name.
IMPLIED = set("p li dt dd option tr td th".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul caption".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Elements without article text, and names in class, id and role that mark such: whole names, "_" read as "-".
DROPPED = set("nav header footer aside form button select menu dialog object audio video canvas map search datalist fieldset label option output progress meter".split())
DROPPED_MARKS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related respond reply replies search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
# Names of more than one word count if they are listed.
DROPPED_MARKS |= set(
    "ad-banner ad-block ad-box ad-container ad-slot ad-unit ad-wrapper breadcrumb-nav breadcrumb-trail comment-form comment-list comment-section comments-area comments-list comments-section consent-banner cookie-banner cookie-bar cookie-consent cookie-notice cookie-popup gdpr-banner left-sidebar login-form main-menu main-nav main-navigation modal-dialog nav-bar nav-links nav-menu newsletter-box newsletter-form newsletter-signup page-footer page-navigation post-comments post-navigation post-tags promo-box related-articles related-content related-links related-posts related-stories right-sidebar search-box search-form share-bar share-buttons share-links side-bar sidebar-left sidebar-right sign-up site-footer site-header site-nav site-navigation skip-link skip-links skip-to-content social-buttons social-icons social-links social-media social-share sponsored-content subscribe-box subscribe-form tag-cloud tag-list top-nav".split()
)
MARKED = set("article article-body article-content articlebody content entry entry-content main-content page-content post post-body post-content post-entry story story-body story-content".split())


def attributes(rest: str) -> dict[str, str]:
    """The attributes of a tag by name; of repeated ones the first counts."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(rest):
        if value[:1] in ('"', "'"):
            value = value[1:-1]
        found.setdefault(name.lower(), html.unescape(value).lower())
    return found


def is_hidden(found: dict[str, str]) -> bool:
    hidden = "hidden" in found and found["hidden"].strip() not in ("false", "until-found")
    return hidden or found.get("aria-hidden", "").strip() == "true" or bool(_NO_DISPLAY.search(found.get("style", "")))


def marks_of(found: dict[str, str]) -> set[str]:
    names = " ".join(found.get(name, "") for name in ("class", "id", "role")).replace("_", "-").split()
    return {numbered[1] if (numbered := _NUMBERED.fullmatch(name)) else name for name in names}


class _Reader:
    """Turns one page into lines: (text, link characters, rank of the marked container, which of
    that rank)."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int, int, int]] = []
        self.text: list[str] = []
        self.links = 0
        self.in_link = False
        self.link_depth = 0
        self.blocks: list[str] = []  # open ones, the last one opened at the end
        self.open_blocks: dict[str, int] = {}
        self.inside = {"article": 0, "main": 0, "marked": 0}
        self.begun = {"article": 0, "main": 0, "marked": 0}
        self.marked_tag: str | None = None
        self.skipped: str | None = None
        self.depth = 0
        self.in_header = False

    def flush(self) -> None:
        line = " ".join("".join(self.text).split())
        if line:
            rank, of = next(((rank, self.begun[kind]) for rank, kind in ((3, "article"), (2, "main"), (1, "marked")) if self.inside[kind]), (0, 0))
            self.lines.append((line, self.links, rank, of))
        self.text, self.links = [], 0

    def words(self, raw: str) -> None:
        if self.skipped is None:
            said = html.unescape(raw)
            self.text.append(said)
            if self.in_link:
                self.links += len("".join(said.split()))

    def block(self, name: str) -> None:
        if name in IMPLIED and self.blocks and self.blocks[-1] == name:
            self.unblock(name)
        self.blocks.append(name)
        self.open_blocks[name] = self.open_blocks.get(name, 0) + 1

    def unblock(self, name: str) -> None:
        """A block ends, and with it what is open inside of it; a link that began there, too."""
        while self.open_blocks.get(name):
            last = self.blocks.pop()
            self.open_blocks[last] -= 1
            if last == name:
                break
        if len(self.blocks) < self.link_depth:
            self.in_link = False

    def enter(self, kind: str) -> None:
        self.begun[kind] += not self.inside[kind]
        self.inside[kind] += 1

    def opened(self, name: str, rest: str) -> None:
        if self.skipped is not None:
            if name == self.skipped and name not in ("p", "li"):
                self.depth += 1
            elif name in ("article", "main") or (self.skipped in ("p", "li") and name in BLOCKS):
                self.skipped = None  # a dropped element that was never closed ends here
            if self.skipped is not None:
                return
        if name in BLOCKS:
            self.flush()
            if name not in VOID:
                self.block(name)
        found = attributes(rest) if rest and not rest.isspace() else {}
        marks = marks_of(found)
        if name not in VOID and name not in ("html", "body", "main") and (name in DROPPED or marks & DROPPED_MARKS or is_hidden(found)):
            if not (name == "article" and not {mark.split("-")[0] for mark in marks & DROPPED_MARKS} & {"comment", "comments", "reply", "ad", "ads", "advert", "promo", "related", "sponsored"}):
                if name in DROPPED:
                    self.flush()
                if name in BLOCKS:
                    self.unblock(name)  # read past as a whole
                self.skipped, self.depth = name, 1
                return
        if name == "br":
            self.text.append(" ")
        elif name == "a":
            self.in_link, self.link_depth = "href" in found, len(self.blocks)
        elif name in ("article", "main"):
            self.enter(name)
        if name in ("div", "section"):
            if self.marked_tag is None and (marks & MARKED or "main" in found.get("role", "").split()):
                self.marked_tag = name
                self.enter("marked")
            elif name == self.marked_tag:
                self.enter("marked")

    def closed(self, name: str) -> None:
        if self.skipped is not None:
            if name == self.skipped:
                self.depth -= 1
                if self.depth <= 0:
                    self.skipped = None
                return
            if name not in ("article", "main", "body", "html"):
                return
            self.skipped = None
        if name in BLOCKS:
            self.flush()
            self.unblock(name)
        if name == "a":
            self.in_link = False
        elif name in ("article", "main"):
            self.inside[name] = max(0, self.inside[name] - 1)
        if name == self.marked_tag:
            self.inside["marked"] -= 1
            if self.inside["marked"] <= 0:
                self.marked_tag = None

    def read(self, page: str) -> list[tuple[str, int, int, int]]:
        at, size, tags = 0, len(page), _TagEnds(page)
        while at < size:
            start = page.find("<", at)
            if start != at:
                start = size if start < 0 else start
                self.words(page[at:start])
                at = start
                continue
            sign = page[at + 1 : at + 2]
            if sign == "!" and page.startswith(("<!--", "<![CDATA["), at):
                close = "-->" if page.startswith("<!--", at) else "]]>"
                end = page.find(close, at + 4)
                at = size if end < 0 else end + 3
                continue
            if at < tags.last and sign in ("!", "?"):
                at = page.find(">", at) + 1
                continue
            closing = sign == "/"
            named = _NAME.match(page, at + 1 + closing) if at < tags.last else None
            if not named:
                self.words("<")
                at += 1
                continue
            end = tags.of(named.end())
            name, rest, at = named[0].lower(), page[named.end() : end], end + 1
            if closing:
                self.closed(name)
            elif name in _RAW:
                if name in BLOCKS:
                    self.flush()
                if not rest.rstrip().endswith("/"):
                    close = _RAW[name].search(page, at)
                    at = close.end() if close else size
            else:
                self.opened(name, rest)
        self.flush()
        return self.lines


class _TagEnds:
    """Where tags end: at the first ``>`` outside of quotes, or at the first one at all if a quote
    is never closed.

    Quotes from which no end was found are remembered, and so is the next sign that matters, so
    that no part of a page is searched again from every tag.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.hopeless: set[int] = set()
        self.known = (0, -1)  # from the first place on, the next special sign is at the second

    def _special(self, at: int) -> int:
        if not self.known[0] <= at <= self.known[1]:
            found = _SPECIAL.search(self.page, at)
            self.known = (at, found.start() if found else len(self.page))
        return self.known[1]

    def of(self, at: int) -> int:
        """The end of a tag whose name ends at ``at``; there must be a ``>`` behind it."""
        page, here, tried = self.page, at, []
        while (here := self._special(here)) < len(page):
            sign = page[here]
            if sign == ">":
                return here
            if here in self.hopeless:
                break
            tried.append(here)
            close = page.find(sign, here + 1)
            if close < 0:
                break
            here = close + 1
        self.hopeless.update(tried)
        return page.find(">", at)


def surges(weights: np.ndarray, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Ranges of lines from a surge (a window's sum reaches ``threshold``) to the dive after it
    (a window without weight)."""
    sums = np.convolve(weights, np.ones(window), "full")[window - 1 :]  # of the window that starts at a line
    found, start = [], None
    for k, total in enumerate(sums):
        if start is None and total >= threshold and total > 0:
            start = k
        elif start is not None and total == 0:
            found.append((start, k))
            start = None
    return [*found, (start, len(weights))] if start is not None else found


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line breaks."""
    lines = _Reader().read(page or "")
    if not lines:
        return ""
    weights = [0 if links * 2 > len(text) else (len(text) - links) * FACTORS[rank] for text, links, rank, _ in lines]
    containers: dict[tuple[int, int], list[int]] = {}
    for k, (_, _, rank, of) in enumerate(lines):
        own = containers.setdefault((rank, of), [])
        if own:
            own.extend([-1] * min(k - own[-1] - 1, WINDOW))  # lines of others in between weigh nothing
        own.append(k)
    heaviest: dict[int, float] = {}
    kept: dict[int, list[int]] = {}
    for (rank, _), own in containers.items():
        found = np.array([weights[k] if k >= 0 else 0 for k in own], float)
        before, mine = 0, []
        for start, stop in surges(found, SURGE):
            if rank:  # short lines before a surge, such as a title, belong to it
                while start > before and found[max(before, start - WINDOW) : start].any():
                    start -= 1
            held = np.flatnonzero(found[start:stop]) + start
            mine.extend(k for k in own[held[0] : held[-1] + 1] if k >= 0)
            heaviest[rank] = max(heaviest.get(rank, 0), found[start:stop].sum())
            before = stop
        if rank >= 2 and mine:  # what follows a dive in an article or main
            taken = set(mine)
            mine.extend(k for k in own if k > mine[0] and weights[k] and k not in taken)
        kept.setdefault(rank, []).extend(mine)
    if heaviest:
        chosen = sorted(kept[max(heaviest, key=lambda rank: (heaviest[rank], rank))])
    else:
        top = max(rank for _, _, rank, _ in lines)
        chosen = [k for k, (_, _, rank, _) in enumerate(lines) if rank == top and (top or weights[k])]
    return "\n".join(lines[k][0] for k in chosen)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    of = pages.schema
    out = T.StructType([T.StructField("page_id", of["page_id"].dataType), T.StructField("url", of["url"].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=out.names)

    return pages.select("page_id", "url", "html").mapInArrow(run, out)
