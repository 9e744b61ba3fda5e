"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block. A line's weight is the length of its text outside links; tags only set
weights: what lies in menus, footers, adverts, forms, comments and the like weighs nothing and counts as empty lines (one of
them inside an article), and so does what lies outside a page's article, where an article or main element is really open and
holds enough of the text.
The weights of BLOCK lines from each line on are summed. On every page alike, text starts where the sums surge and ends where
they dive to nothing, and the lines between surge and dive are kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 3  # lines in a sliding window
SURGE = 86  # characters in a window that begin a text
SHARE = 0.2  # of the page's largest sum, likewise; also the least part of a page's text that its main text is

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg|textarea|title|iframe|select|object)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
# Words of class, id and role names that mark what isn't the article. Fixed values.
_ASIDE = frozenset("ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright discussion footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted recommended related replies search share sharing sidebar signup site-header skip social sponsor sponsored subscribe tags toolbar widget widgets".split())
_DROPPED = frozenset("nav footer aside form button dialog menu".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_PIECES = re.compile(r"[^a-z0-9]+")
# Pieces of names that tell how a page is laid out ("no-sidebar", "comments-open"), not what an element is.
# Pieces that only say where or what kind of box something is: "cookie-bar" is a notice, "menu-reform" isn't a menu.
_PARTS = frozenset("area article articles bar block body bottom box btn button card cell col column container content desktop div entry form global group head header inline inner item items left line link links list main mini mobile module outer page panel post posts primary right row secondary section site slot small story sub text title top unit view wrap wrapper".split())
_STATE = frozenset("no not with without has have is open opened closed enabled disabled on off active inactive layout".split())


def _off(name: str, attributes: str, article: bool) -> str:
    """Why an element with this start tag isn't part of the article: "sure", "likely" (a piece of a name says so), or ""."""
    if name in _DROPPED or name == "header" and not article:
        return "sure"
    if not attributes or name in ("html", "body", "article", "main"):
        return ""
    if _HIDDEN.search(attributes):
        return "sure"
    likely = ""
    for m in _NAMED.finditer(attributes):
        for y in (m[1] or m[2] or m[3] or "").lower().split():
            if y in _ASIDE:
                return "sure"
            pieces = _PIECES.split(y)
            if not _ASIDE.isdisjoint(pieces) and _STATE.isdisjoint(pieces) and all(x in _ASIDE or x in _PARTS or not x.isalpha() for x in pieces):
                likely = "likely"
    return likely


def lines_of(page: str, kept: frozenset[int] = frozenset()) -> tuple[list[tuple[str, int, bool]], dict[int, int]]:
    """The page's lines as (text, weight, whether in an article or main), an empty one for what is left out; and the weight
    of each element left out as likely, by its place. Those at the places `kept` stay. An inline element that is left out
    doesn't split its line."""
    lines: list[tuple[str, int, bool]] = []
    cut: dict[int, int] = {}
    text: list[str] = []
    linked = 0
    skip, depth, place = "", 0, -1  # the element being left out, how many of its name are open, its place if likely
    in_link, inside = False, 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not skip:
            text.append(raw)
            linked += len(raw) if in_link else 0
        elif raw and place >= 0:
            cut[place] += len(" ".join(raw.split()))

    def close(gap: bool = False) -> None:
        nonlocal linked
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            lines.append((whole, max(len(whole) - linked, 0), inside > 0))
        if gap:  # a dive outside an article; inside, where text goes on after an advert, one empty line
            lines.extend([("", 0, inside > 0)] * (1 if inside else BLOCK))
        text.clear()
        linked = 0

    at = 0
    for m in _TAG.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        closing = bool(m[2])
        if skip:
            if name == skip:
                depth += -1 if closing else 0 if m[4].endswith("/") else 1
                if not depth:
                    skip = ""
                    if name in _BLOCKS:
                        close(gap=True)
            elif skip == "p" and name in _BLOCKS:  # a paragraph ends where another block begins
                skip = ""
                close(gap=True)
            else:
                continue
            if closing or skip:
                continue
        if name == "br":
            text.append(" ")
            continue
        off = "" if closing or name in _VOID else _off(name, m[4], inside > 0)
        if off == "sure" or off and m.start() not in kept:
            if name in _BLOCKS:
                close(gap=True)
            if not m[4].endswith("/"):
                skip, depth, place = name, 1, m.start() if off == "likely" else -1
                if off == "likely":
                    cut[place] = 0
            continue
        if name == "a":
            in_link = not closing
        elif name in ("article", "main"):
            close()
            inside = max(inside + (-1 if closing else 1), 0)
        elif name in _BLOCKS:
            close()
            in_link = False
    add(page[at:])
    close()
    return lines, cut


def between(lines: list[tuple[str, int]]) -> list[str]:
    """The lines between surge and dive. lines: text and weight, empty ones for what is left out."""
    weights = [w for _, w in lines]
    sums = [sum(weights[k : k + BLOCK]) for k in range(len(weights))]
    surge = min(SURGE, SHARE * max(sums, default=0))
    kept: list[str] = []
    run: list[str] = []
    links: list[str] = []  # lines without weight stand only between lines with some
    peak = 0
    for (line, weight), total in zip(lines, sums, strict=True):
        if not total:  # a dive: what came since the last one stands if it surged
            kept += run if peak >= surge else []
            run, links, peak = [], [], 0
            continue
        peak = max(peak, total)
        if weight:
            run += [*links, line]
            links = []
        elif line and run:
            links.append(line)
    return kept + (run if peak >= surge else [])


def main_text(page: str) -> str:
    """The main text of one page, blocks joined by a line break."""
    lines, cut = lines_of(page)
    opened: frozenset[int] = frozenset()
    while cut:  # an element that holds nearly all of the text isn't an aside, whatever its name
        place = max(cut, key=cut.get)
        held = sum(w for _, w, _ in lines)
        if cut[place] < SURGE or held >= SHARE * (held + cut[place]):
            break
        opened |= {place}
        lines, cut = lines_of(page, opened)
    held, marked = sum(w for _, w, _ in lines), sum(w for _, w, inside in lines if inside)
    weighed: list[tuple[str, int]] = []
    article = any(x and inside for x, _, inside in lines) and marked >= SHARE * held
    for line, weight, inside in lines:
        if article:  # in an article links are text too, and the rest weighs nothing
            line, weight = (line, len(line)) if inside else ("", 0)
        if line or not article or not weighed or weighed[-1][0]:
            weighed.append((line, weight))
    return "\n".join(between(weighed))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages. Null, empty and textless pages have an empty text; long ones are
    read whole; cut-off markup counts as closed at the end. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                texts = [main_text(x) if x else "" for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html_col).mapInArrow(run, "page_id long, url string, text string, n_chars long")
