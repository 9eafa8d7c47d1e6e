"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page. A line weighs as many characters as it shows outside links (links
in headings count as text). Lines of menus, page headers and footers, sidebars, notices, adverts, forms and reader comments
are taken out beforehand, by element, role or name. On what is left a window of WINDOW lines slides; text surges where the
window's sum reaches the page's threshold and dives where it falls to nothing, and all lines between are the main text.

A marked article is one feature more. Where the densest window of the page does not speak against the mark (TEASER times denser
outside the mark than within), only its lines are walked, and a character in them is worth SURGE others: the shortest
paragraph surges, one or two lines of links stay with the text around them, and WINDOW or more such lines in a row, a menu
without a name, are a dive. Elsewhere short lines before the first surge and after the last dive go.

Pages are worked on one by one (vectorised transfer, no shuffle); whole pages always, with a cost linear in their length.
Null or empty html gives an empty text; cut-off tags and references are tolerated; repeated rows give the same text each.
"""

from __future__ import annotations

import html as _html
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WINDOW = 3
SURGE = 60
TEASER = 10
#: Elements whose content is never text: those that hold no markup are passed over at once, the others left out in the tag walk.
_RAW = frozenset("script style noscript iframe textarea".split())
_ENDLESS = frozenset(("script", "style"))
_NEVER = frozenset("template svg object canvas select annotation annotation-xml".split())
_SELF = re.compile(r"(?:^|[\s\"'])/$")
_OPEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of an article.
_OUT = frozenset("head title nav header footer aside form menu button dialog".split())
_OUT_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_NAMED = r"(?:^|[\s_-])(?:%s)(?:$|[\s_-])"
_OUT_NAME = re.compile(
    _NAMED
    % "ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|sidebar|side|widget|cookies?|consent|gdpr|notice|alert|popup|modal|"
    "overlay|newsletter|subscribe|signup|login|comments?|commentlist|disqus|replies|respond|reader-comments|nav|navbar|navigation|menu|breadcrumbs?|"
    "pagination|pager|header|masthead|topbar|footer|copyright|search",
    re.I,
)
#: Names that say less: they count on containers only, since a paragraph of that name may be the article's own.
_OUT_BOX = re.compile(_NAMED % "share|sharing|social|related|recommended|recommendations|toolbar|skip", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TEXT = _HEADINGS | frozenset("p li dd dt blockquote pre td th figcaption caption summary a b i em strong span mark q small sub sup code".split())
_ATTR = re.compile(r"(?<![A-Za-z-])([A-Za-z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


class Tag(NamedTuple):
    """A tag's place, or that of a comment or declaration (no name) or of a raw element (the name is a space)."""

    start: int
    end: int
    name: str = ""
    closing: bool = False
    attrs: str = ""


class Line(NamedTuple):
    """A block's text, whether it is left out, whether an article holds it, and how many characters are plain links."""

    text: str
    out: bool
    inside: bool
    linked: int


def _quoted_end(page: str, at: int) -> int:
    """The position after the next '>' that is in no quoted value; -1 if there is none."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.end()
        at = m.end()
        if page[max(0, m.start() - 64) : m.start()].rstrip()[-1:] == "=":
            close = page.find(m[0], at)
            at = close + 1 if close >= 0 else at
    return -1


def scan(page: str) -> list[Tag]:
    """All tags in page order, in one pass: every character is looked at a bounded number of times."""
    found: list[Tag] = []
    at, size, quotes, ends = 0, len(page), True, {}

    def after(name: str, start: int) -> int:
        """Where text goes on behind a raw element's start tag; each name's next closing tag is looked for once. One that is
        never closed is its tag alone; script and style run on."""
        if name not in ends or 0 <= ends[name][0] < start:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, start)
            ends[name] = (close.start(), close.end()) if close else (-1, -1)
        first, last = ends[name]
        if name in _ENDLESS:
            return last if last >= 0 else size
        if first < 0 or re.compile(rf"<{name}(?=[\s/>])", re.I).search(page, start, first):
            return start
        return last

    while (lt := page.find("<", at)) >= 0:
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else size
            found.append(Tag(lt, at))
            continue
        m = _OPEN.match(page, lt)
        if m:
            end = _quoted_end(page, m.end()) if quotes else -1
            if end < 0:  # a quote that runs to the end of the page isn't one, here and further on
                quotes = False
                end = page.find(">", m.end()) + 1
        elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
            end = page.find(">", lt + 2) + 1
        else:
            at = lt + 1
            continue
        at = end or size  # a tag that the page's end cuts off
        if not m or not end:
            found.append(Tag(lt, at))
            continue
        name, closing, attrs = m[2].lower(), bool(m[1]), page[m.end() : end - 1]
        if name in _RAW and not closing:
            if name in _ENDLESS or not _SELF.search(attrs):
                at = after(name, end)
            name, attrs = " ", ""
        found.append(Tag(lt, at, name, closing, attrs))
    return found


def _never_text(tags: list[Tag]) -> dict[int, int]:
    """The closing tag of each element that is never text; a self-closed or unclosed one has none."""
    pairs: dict[int, int] = {}
    waiting: dict[str, list[int]] = {}
    for k, t in enumerate(tags):
        if t.name not in _NEVER:
            continue
        if not t.closing:
            if not _SELF.search(t.attrs):
                waiting.setdefault(t.name, []).append(k)
        elif waiting.get(t.name):
            pairs[waiting[t.name].pop()] = k
    return pairs


def _is_out(name: str, attrs: str) -> bool:
    if name in _OUT:
        return True
    if name in _VOID or name in ("html", "body", "article", "main") or not attrs or "=" not in attrs:
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and (_OUT_NAME.search(value) or name not in _TEXT and _OUT_BOX.search(value)):
            return True
        if key == "role" and value.lower() in _OUT_ROLE:
            return True
        if key == "aria-hidden" and value.lower() == "true" or key == "hidden":
            return True
    return False


def _plain(pieces: list[str]) -> str:
    return " ".join(_html.unescape("".join(pieces)).split())


def lines(page: str) -> list[Line]:
    """The blocks of the page that show text."""
    found: list[Line] = []
    piece: list[str] = []
    links: list[str] = []
    skip, depth, article, at, heading, link = "", 0, 0, 0, False, False

    def flush() -> None:
        text = _plain(piece)
        if text:
            found.append(Line(text, bool(skip), article > 0, len(_plain(links)) if links else 0))
        piece.clear()
        links.clear()

    def add(text: str) -> None:
        piece.append(text)
        if link and not heading:
            links.append(text)

    tags = scan(page)
    pairs = _never_text(tags)
    until = -1
    for k, t in enumerate(tags):
        if k <= until:
            continue
        if t.start > at:
            add(page[at : t.start])
        at = t.end
        if k in pairs:
            piece.append(" ")
            until = pairs[k]
            at = tags[until].end
            continue
        name, closing = t.name, t.closing
        if name in ("", " "):
            piece.append(name)
            continue
        if name in _BLOCK:
            flush()
            link = False  # a link ends with its block at the latest
            if name in _HEADINGS:
                heading = not closing
        elif name == "a":
            link = not closing and "href" in t.attrs.lower()
        if skip:
            if name == skip:
                depth += -1 if closing else 0 if t.attrs.endswith("/") else 1
                if depth == 0:
                    flush()
                    skip = ""
            elif name == "body" and skip in ("head", "title") or closing and name in ("article", "main") and article and skip not in _OUT:
                flush()
                skip = ""
            if skip or not (closing and name in ("article", "main")):
                continue
        if not closing and name not in _VOID and not t.attrs.endswith("/") and _is_out(name, t.attrs):
            flush()
            skip, depth = name, 1
        elif name in ("article", "main"):
            article = max(0, article + (-1 if closing else 1))
    add(page[at:])
    flush()
    return found


def window_sums(weights: list[int]) -> list[int]:
    """The sum of the window that begins at each line."""
    return [sum(weights[i : i + WINDOW]) for i in range(len(weights))]


def surges(weights: list[int], threshold: int) -> list[tuple[int, int]]:
    """[surge, dive) for each stretch in which the sum of WINDOW lines reaches the threshold before it falls to nothing."""
    sums = window_sums(weights)
    found, i = [], 0
    while i < len(sums):
        if weights[i] and sums[i] >= threshold:
            j = i
            while j < len(sums) and sums[j] > 0:
                j += 1
            found.append((i, j))
            i = j
        else:
            i += 1
    return found


def _weight(row: Line) -> int:
    return max(0, len(row.text) - row.linked)


def _marked(rows: list[Line]) -> list[Line]:
    """The rows of a marked article, or none where nothing is marked or the page's densest window lies elsewhere."""
    inside, outside = [x for x in rows if x.inside], [x for x in rows if not x.inside]
    most = lambda part: max(window_sums([_weight(x) for x in part]), default=0)
    return inside if inside and most(outside) < TEASER * max(SURGE, most(inside)) else []


def main_text(page: str | None) -> str:
    rows = [x for x in lines(page or "") if not x.out]
    if not rows:
        return ""
    marked = _marked(rows)
    rows = marked or rows
    weights = [_weight(x) for x in rows]
    if not any(weights):
        weights = [len(x.text) for x in rows]  # nothing but links
    if marked:
        runs = [list(g) for _, g in itertools.groupby(weights, bool)]
        weights = [SURGE * (w or len(g) < WINDOW) for g in runs for w in g]
    return " ".join(x.text for a, b in surges(weights, min(SURGE, max(weights))) for x in rows[a:b])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x.as_py()) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each page: its id (of whatever type), url, main text and number of code points."""
    rows = pages.select(pages[f"`{key}`"].alias("id"), pages[f"`{url}`"].alias("url"), pages[f"`{html}`"].cast("string").alias("html"))
    schema = T.StructType([rows.schema["id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    got = rows.mapInArrow(_extract, schema)
    return got.withColumnsRenamed({"id": key, "url": url})
