"""Main text of web pages by line-block distribution.

Markup is stripped to text lines, one for each block element.  A line's size is
its text less the text of its links.  Sizes are summed over a sliding window of
lines.  Two lines in a row of size zero part the page into stretches; in each
that reaches the threshold, the text between the surge (the first line from
which a window reaches it) and the dive (the last line up to which one does) is
kept, and before and after these headings and whole sentences alone.

Markup gives hints that can only set lines to zero: elements that declare
themselves menus, notices, adverts, forms or comments, and, where the article or
main elements hold most of a page's text, all lines outside them.  The edges of
such an article are its surge and dive then, however short its lines.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|textarea|title|math)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE = frozenset("nav footer aside form menu dialog button select fieldset datalist head".split())
_OPEN_ENDED = frozenset("p li dt dd option tr td th".split())
_PLAIN = frozenset("html body main article".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead "
    "topbar comment comments disqus respond replies share sharing social related recommended newsletter subscribe subscription signup login search popup modal overlay widget toolbar pagination pager copyright disclaimer".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())


def _set_aside(name: str, attrs: str, in_article: bool) -> bool:
    """Whether an element declares that it isn't the main text."""
    if name in _ASIDE or name == "header" and not in_article:
        return True
    if name in _PLAIN or not attrs:
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id") and not _MARKS.isdisjoint(re.split(r"[\s_:-]+", value)):
            return not (in_article and re.search(r"(?:^|[\s_-])header", value) and _MARKS.intersection(re.split(r"[\s_:-]+", value)) == {"header"})
        if key == "role" and value in _ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def without_markup(page: str) -> str:
    """All text of a page, scripts and styles left out, character references decoded."""
    return html.unescape(_TOKEN.sub(" ", page))


class Line(NamedTuple):
    """text; whether it is set aside, in an article, a heading; the size (without links)."""

    text: str
    aside: bool
    inside: bool
    heading: bool
    size: int


#: A notice of rights in a line of its own.
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved).{0,120}", re.I)
_SENTENCE = re.compile(r"[.!?…。！？]['\"”’»)\]]*$")


def text_lines(page: str) -> list[Line]:
    """The lines of a page; a set-aside stretch leaves an empty line."""
    lines: list[Line] = []
    run: list[str] = []
    unlinked: list[str] = []
    stack: list[tuple[str, bool, bool]] = []
    aside = article = 0
    at = 0
    in_link = linked = heading = False

    def flush() -> None:
        nonlocal in_link, linked
        in_link = False
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text or aside:
                size = len(text)
                if linked:
                    # Signs between links are no text.
                    free = " ".join("".join(unlinked).split())
                    size = len(free) if any(map(str.isalnum, free)) else 0
                lines.append(Line(text, aside > 0, article > 0, heading, 0 if aside else size))
            unlinked.clear()
            linked = False

    def add(text: str) -> None:
        nonlocal linked
        text = html.unescape(text)
        run.append(text)
        if in_link:
            linked = True
        else:
            unlinked.append(text)

    def pop(to: int) -> None:
        nonlocal aside, article
        while len(stack) > to:
            _, a, b = stack.pop()
            aside -= a
            article -= b

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m["raw"] and m["raw"].lower() in ("title", "textarea"):
                flush()
            continue
        if name == "a":
            in_link = not m["end"] and "href" in m["attrs"].lower()
        if name in _INLINE and not m["attrs"] and not aside:
            continue
        if m["end"]:
            if name not in _INLINE:
                flush()
                heading = heading and name not in _HEADINGS
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None:
                if any(x[1] for x in stack[k:]):
                    flush()
                pop(k)
            continue
        own = _set_aside(name, m["attrs"], article > 0)
        if name not in _INLINE or own:
            link = in_link
            flush()
            in_link = link and own
            heading = name in _HEADINGS
        if name in _OPEN_ENDED and stack and stack[-1][0] == name:
            pop(len(stack) - 1)
        if name not in _VOID and not m["attrs"].rstrip().endswith("/") and (name not in _INLINE or own or aside):
            kind = name in ("article", "main")
            stack.append((name, own, kind))
            aside += own
            article += kind
    if at < len(page):
        add(page[at:])
    flush()
    return lines


def hinted(lines: list[Line]) -> tuple[list[Line], bool]:
    """The lines with those outside a dominant article and notices of rights set aside, and whether an article dominates."""
    inside = sum(len(x.text) for x in lines if x.inside and not x.aside)
    whole = inside > 0 and 2 * inside >= sum(len(x.text) if x.inside else x.size for x in lines if not x.aside)

    def one(x: Line) -> Line:
        if x.aside:
            return x._replace(size=0)
        if whole:
            return x._replace(aside=not x.inside, size=len(x.text) if x.inside else 0)
        return x._replace(aside=True, size=0) if not x.inside and _RIGHTS.fullmatch(x.text) else x

    return [one(x) for x in lines], whole


def main_text(page: str, window: int = 3, threshold: int = 86) -> str:
    """The main text of one page; empty if it has none.

    A page whose windows all stay below the threshold is measured by its fullest one.
    """
    lines, whole = hinted(text_lines(page))
    size = [x.size for x in lines]
    upto = [0, *accumulate(size)]
    block = [upto[min(k + window, len(size))] - upto[k] for k in range(len(size))]
    least = max(1, min(threshold, max(block, default=0)))
    kept: list[str] = []
    k = 0
    while k < len(size):
        if not size[k]:
            k += 1
            continue
        end = k
        while any(size[end : end + 2]):
            end += 1
        if max(block[k:end]) >= least:
            surge, dive = k, end
            if not whole:
                weak = lambda x: 3 * x.size < least and not x.heading and not _SENTENCE.search(x.text)
                surge = next(j for j in range(k, end) if block[j] >= least)
                dive = next((j for j in range(end, surge, -1) if upto[j] - upto[max(surge, j - window)] >= least), surge + 1)
                while surge < dive - 1 and weak(lines[surge]):
                    surge += 1
                while dive > surge + 1 and weak(lines[dive - 1]):
                    dive -= 1
            kept += [x.text for j, x in enumerate(lines[k:end], k) if not x.aside and (surge <= j < dive or x.inside or x.size and (x.heading or _SENTENCE.search(x.text)))]
        k = end
    return " ".join(x for x in kept if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = 3, threshold: int = 86) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; n_chars counts code points.

    Null and empty pages have empty text.  Truncated markup is read as far as it
    goes.  Each row stands for itself, so ids may be null or repeated.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(h or "", window, threshold) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
