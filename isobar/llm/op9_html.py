"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page.  A line weighs as
much as its text is long (in code points) without its link text, nothing where
most of it is links; lines in an ``article`` weigh ``MARKED`` times that, lines
in ``main`` ``MARKED // 2`` times, and never less than that for one code point.
Lines of menus, forms, adverts, comments and the like, by their element, role or
class, are blanked.  Between neighbouring lines of containers of which neither
holds the other stand ``WINDOW`` blank lines, unless both are in one article; a
container of a single line is a line of the container around it, and the page
itself holds nothing together.

Weights are summed over sliding windows of ``WINDOW`` lines.  Where the sum
leaves zero is a surge, where it falls back to zero a dive.  Stretches between
the two whose largest sum reaches ``SHARE`` of the page's largest sum are text;
from the first surge of these to the last dive every line stays, light ones and
light stretches between them too.  Tags and names shape lines and weights; the
sums alone decide, on every page by the same rule.

Class words are believed only as whole names: every part of the name must be a
known word and one of them a hint, so ``no-sidebar``, ``ad-free`` and
``share-price`` mean nothing; nor do names on the page, the body or the article
itself.  Words that also name parts of an article (``WEAK``) blank a block only
if it has no heading and is short or mostly links.  Where nothing else is left
of a page, and ``LEAST`` code points would be without them, names are not
believed.

Results: null and empty pages give an empty text; unclosed and stray tags are
taken as browsers do (a new paragraph ends an open one, a stray end tag means
nothing, an unended tag at the end of a page is dropped); very long pages are
read in one piece, in time that grows with their length; repeated rows are
extracted each for itself; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as T

#: Lines in a window; share of the page's largest sum that makes a surge; weight of a code point in an article.
WINDOW, SHARE, MARKED = 3, 1 / 3, 4
#: Code points of a block with a weak name, and of a page's lines with names alone, from which they are believed to be text.
SHORT, LEAST = 200, 80

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select|head|object|canvas)\b[^>]*>.*?(?:</(?P=raw)\b[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_HEAD_END = re.compile(r"<body\b", re.I)
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("nav header footer aside form menu dialog button label fieldset search".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_PAGES = frozenset("html body main".split())
_WHOLE = frozenset("html body article main".split())
_ROLE = re.compile(r"""\brole\s*=\s*["']?(?:navigation|banner|contentinfo|complementary|search|dialog|alert|form|menu|menubar|toolbar)\b""", re.I)
_NAMED = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
#: Words that name what is no article text, and words that may stand beside them in a name.
_HINT = frozenset(
    "notice notices alert alerts outbrain taboola discussion responses respond talkback feedback disclaimer ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored promo promotion menu menus nav navbar navigation topbar breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup share sharing social related recommended pagination pager toolbar comment comments commentlist disqus login".split()
)
_BESIDE = frozenset("site page main top bottom left right primary secondary global box block bar area wrap wrapper container inner outer list item items links link buttons button form section widget slot unit group panel column col message header head content text title row inline mobile desktop thread reply replies post posts article articles stories news user reader the and".split())
#: Hints that also name parts of an article.
_WEAK = frozenset("banner banners related recommended share sharing social promo promotion topbar notice notices alert alerts discussion responses respond feedback disclaimer".split())
_SPLIT = re.compile(r"[^a-zA-Z]+")


def _hinted(attrs: str) -> int:
    """Whether a class or id names something that is no article text: 2 surely, 1 perhaps, 0 not."""
    most = 0
    for m in _NAMED.finditer(attrs):
        for word in (m[1] or m[2] or m[3] or "").split():
            parts = [p.lower() for p in _SPLIT.split(word) if p]
            if any(p in _HINT for p in parts) and all(p in _HINT or p in _BESIDE for p in parts):
                most = max(most, 2 if any(p in _HINT and p not in _WEAK for p in parts) else 1)
    return most


class Line(NamedTuple):
    text: str
    #: Code points of link text; weight of a code point; the article that holds it (0: none); its container.
    links: int
    factor: int
    article: int
    container: int
    #: Of a block that is no article text; the outermost block with a weak name around it (0: none); a heading.
    masked: bool
    weak: int
    heading: bool


class _Open(NamedTuple):
    """An open block: what its lines inherit."""

    name: str
    masked: bool
    weak: int
    factor: int
    article: int
    number: int


_PAGE = _Open("", False, 0, 1, 0, 0)


def lines(html: str, classes: bool = True) -> tuple[list[Line], list[int]]:
    """Texts of the page's blocks, and the container around each container (0, the page, is in itself)."""
    out: list[Line] = []
    stack: list[_Open] = []
    opened: dict[str, int] = {}  # open blocks by name, so that a stray end tag searches nothing
    around, whole = [0], [True]  # by number: the block around; whether it stands for the page
    blocks = [0]  # by number: blocks directly inside
    buf: list[str] = []
    links = link = 0

    def flush() -> None:
        nonlocal links
        if buf:
            if text := " ".join(unescape("".join(buf)).split()):
                at = stack[-1] if stack else _PAGE
                heading = any(b.name in _HEADING for b in stack[-2:])
                out.append(Line(text, links, at.factor, at.article, at.number, at.masked, at.weak, heading))
            buf.clear()
        links = 0

    def close(k: int) -> None:
        for b in stack[k:]:
            opened[b.name] -= 1
        del stack[k:]

    at = 0
    if (body := _HEAD_END.search(html)) and re.search(r"<head\b", html[: body.start()], re.I):
        at = body.start()
    for m in _TOKEN.finditer(html, at):
        if m.start() > at:
            buf.append(html[at : m.start()])
            if link:
                links += m.start() - at
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        closing = (m["end"] or m["end2"]) == "/"
        if name == "br":
            buf.append(" ")
            continue
        if name == "a":
            link = 0 if closing else 1
        if name not in _BLOCK and name not in _SKIP:
            continue
        if closing:
            if opened.get(name):
                flush()
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name))
            continue
        flush()
        if stack and stack[-1].name == "p" or name == "li" and stack and stack[-1].name == "li":
            close(len(stack) - 1)
        if name in _VOID:
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        up = stack[-1] if stack else _PAGE
        # A name says nothing on the page, the body or an article, but for articles in articles, as comments may be.
        named = _hinted(attrs) if classes and attrs and (name not in _WHOLE or name == "article" and up.article) else 0
        # An article's own header holds its title.
        skip = name in _SKIP and not (name == "header" and up.article)
        masked = up.masked or skip or named == 2 or bool(attrs) and bool(_ROLE.search(attrs) or _HIDDEN.search(attrs))
        number = len(around)
        around.append(up.number)
        whole.append(name in _PAGES)
        blocks.append(0)
        blocks[up.number] += 1
        article = up.article or (number if name == "article" and not masked else 0)
        factor = MARKED if article else MARKED // 2 if name == "main" and not masked else up.factor
        stack.append(_Open(name, masked, up.weak or (number if named == 1 else 0), factor, article, number))
        opened[name] = opened.get(name, 0) + 1
    if at < len(html) and not html.startswith("<", at):
        buf.append(html[at:])
    flush()
    # A block with one line and nothing else is a line of the block around it; what stands for the page is the page.
    holds = [0] * len(around)
    for x in out:
        holds[x.container] += 1
    home = [0] * len(around)
    for k in range(1, len(around)):
        home[k] = 0 if whole[k] else home[around[k]] if not blocks[k] and holds[k] <= 1 else k
    out = [x._replace(container=home[x.container]) for x in out]
    return out, [home[a] if not whole[k] else 0 for k, a in enumerate(around)]


def _believed(found: list[Line]) -> list[Line]:
    """Lines that are not blanked; a weakly named block is where it has no heading and is short or mostly links."""
    size: dict[int, int] = {}
    linked: dict[int, int] = {}
    headed = set()
    for x in found:
        if x.weak:
            size[x.weak] = size.get(x.weak, 0) + len(x.text)
            linked[x.weak] = linked.get(x.weak, 0) + x.links
            if x.heading:
                headed.add(x.weak)
    blank = {w for w, n in size.items() if 2 * linked[w] > n or w not in headed and n < SHORT}
    return [x for x in found if not x.masked and x.weak not in blank]


def weights(kept: list[Line], around: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of lines and blank lines in page order, and where among them the lines stand."""
    weight: list[int] = []
    place = []
    for k, x in enumerate(kept):
        if k and not _together(kept[k - 1], x, around):
            weight += [0] * WINDOW
        place.append(len(weight))
        length = len(x.text)
        plain = 0 if 2 * x.links > length else length - x.links
        weight.append(x.factor * max(plain, 1 if x.article else 0))
    return np.array(weight, dtype=np.int64), np.array(place, dtype=np.int64)


def _together(a: Line, b: Line, around: list[int]) -> bool:
    """Whether no blank lines part two neighbours: one article, or a container within the other's."""
    if a.article and a.article == b.article or a.container == b.container:
        return True
    if a.article != b.article:
        return False
    for inner, outer in ((a.container, b.container), (b.container, a.container)):
        while outer and inner > outer:  # a container is opened after those around it
            inner = around[inner]
        if outer and inner == outer:
            return True
    return False


def span(weight: np.ndarray, share: float = SHARE, window: int = WINDOW) -> tuple[int, int]:
    """``[first surge, last dive)`` of the stretches whose largest sum reaches ``share`` of the largest of all; ``(0, 0)`` where nothing weighs."""
    if not weight.any():
        return 0, 0
    total = np.convolve(weight, np.ones(window, dtype=np.int64))  # total[i] sums the lines i - window + 1 .. i
    live = np.r_[False, total > 0, False]
    surge, dive = np.flatnonzero(~live[:-1] & live[1:]), np.flatnonzero(live[:-1] & ~live[1:])
    top = np.maximum.reduceat(total, surge)  # what lies between a dive and the next surge is zero
    text = np.flatnonzero(top >= share * top.max())
    return int(surge[text[0]]), int(min(dive[text[-1]] - window + 1, len(weight)))


def extract(html: str | None) -> str:
    """The main text of one page, blocks joined by line feeds."""
    if not html:
        return ""
    found, around = lines(html)
    kept = _believed(found)
    if not kept and found:
        plain, other = lines(html, classes=False)
        rest = _believed(plain)
        if sum(len(x.text) for x in rest) >= LEAST:
            kept, around = rest, other
    weight, place = weights(kept, around)
    first, last = np.searchsorted(place, span(weight))
    return "\n".join(x.text for x in kept[first:last])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in T.slices(batches, "html"):
            texts = [extract(h) for h in rb.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
