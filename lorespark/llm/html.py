"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one for each block of the page, in order. The length of a line is its text's, or 0 where the page
itself says that it is no article: in menus, headers, footers, sidebars, notices, adverts, forms and comments by their elements
or class names, outside of the marked article where there is one, and in lists of links. Lengths are summed over sliding windows
of WINDOW lines. Text begins where the sums surge to SURGE characters (or to the page's greatest sum, if that is less), with the
lines before that belong together, and ends where they dive to nothing. Every line between that has a length is kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

WINDOW, SURGE = 3, 80
#: A line is a link if so much of its text is within anchors; so many links in a row are a list of links.
LINKED, LISTED = 0.8, 2

# Fixed values of HTML: elements whose content is no text, elements that begin and end blocks, elements without content.
RAW = "script style title textarea iframe noscript template svg select button object audio video canvas noembed noframes"
BLOCKS = (
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul"
)
EMPTY = "area base br col embed hr img input link meta param source track wbr"
# Elements, roles and words of class names and ids that mark what is no article.
ASIDE_TAGS = "nav aside footer menu form dialog head label legend fieldset search"
ASIDE_ROLES = "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar"
ASIDE_WORDS = (
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup "
    "modal overlay newsletter subscribe subscription signup login menu nav navbar navigation breadcrumb breadcrumbs toolbar sidebar aside widget masthead header "
    "footer copyright legal share sharing social related recommended comment comments commentlist discussion disqus reply replies respond pagination pager form"
)
#: These are no place for an article: what is marked as one in them is a comment or teaser. Class names of a page's own header.
LASTING_WORDS = "comment comments commentlist discussion disqus reply replies respond related recommended sidebar aside widget"
CONTENT_WORDS = "article post entry story content"
_RAW, _BLOCKS, _EMPTY, _TAGS, _ROLES, _WORDS, _LASTING, _CONTENT = (frozenset(x.split()) for x in (RAW, BLOCKS, EMPTY, ASIDE_TAGS, ASIDE_ROLES, ASIDE_WORDS, LASTING_WORDS, CONTENT_WORDS))

# a quoted value ends at the next tag at the latest, so an open quote does not make the search begin anew for every tag
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>=\s*\"[^\"<]*\"|=\s*'[^'<]*'|[^>])*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


@dataclass
class Line:
    text: str
    linked: int
    aside: bool
    marked: int  # which marked article or main part it lies in, 0 for none
    title: bool


def _kind(name: str, rest: str, within: bool) -> str:
    """What an element is: aside, lasting (an aside in which no article begins), marked (article or main part), or nothing."""
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if rest else {}
    if name in ("html", "body", "h1"):
        return ""
    names = f"{given.get('class', '')} {given.get('id', '')}"
    words = set(names.lower().split()) if name in ("article", "main") else {w.lower() for w in _NAME.findall(names)}
    role = given.get("role", "").lower()
    if words & _LASTING or name == "aside":
        return "lasting"
    if name in ("article", "main") or role in ("article", "main"):
        return "marked"
    if "header" in words and (within or words & _CONTENT):
        words.discard("header")
    hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true"
    return "aside" if name in _TAGS or (name == "header" and not within) or role in _ROLES or words & _WORDS or hidden else ""


class Open:
    """The open blocks and asides, each with what holds inside of it: (name, kind, aside, lasting, number of the marked part, title)."""

    def __init__(self):
        self.stack, self.names, self.marks = [("", "", False, False, 0, False)], Counter(), 0

    def inside(self) -> tuple[bool, bool, int, bool]:
        return self.stack[-1][2:]

    def push(self, name: str, kind: str) -> None:
        if kind == "marked" and not self.inside()[1]:
            # no article lies in a menu or advert: one that is open was never closed
            self.forget(lambda x: x[1] == "aside")
            self.marks += 1
            self._add(name, kind, self.marks)
        elif kind or name in _BLOCKS:
            self._add(name, kind, self.inside()[2])

    def _add(self, name: str, kind: str, mark: int) -> None:
        aside, lasting, _, title = self.inside()
        self.names[name] += 1
        self.stack.append((name, kind, aside or kind in ("aside", "lasting"), lasting or kind == "lasting", mark, title or name == "h1"))

    def forget(self, which) -> None:
        """Without the elements that which() finds; those inside of them stay."""
        if any(map(which, self.stack)):
            held, self.stack, self.names = self.stack[1:], self.stack[:1], Counter()
            for x in held:
                if not which(x):
                    self._add(x[0], x[1], x[4])

    def close(self, name: str) -> None:
        while self.names[name]:
            last = self.stack.pop()[0]
            self.names[last] -= 1
            if last == name:
                return


def lines(page: str) -> list[Line]:
    """The page's blocks that have text, white space in each turned into one space."""
    out: list[Line] = []
    parts: list[tuple[str, bool, bool]] = []  # text, in an anchor, aside
    opened, anchored, at = Open(), False, 0

    def add(text: str) -> None:
        parts.append((html.unescape(text), anchored, opened.inside()[0]))

    def end() -> None:
        own = [x for x in parts if not x[2] and not x[0].isspace()]
        whole = " ".join("".join(p for p, _, aside in parts if not own or not aside).split())
        if whole:
            linked = len("".join("".join(p for p, a, _ in own or parts if a).split()))
            out.append(Line(whole, linked, not own, *opened.inside()[2:]))
        parts.clear()

    while at < len(page):
        token = _TOKEN.search(page, at)
        if (begin := token.start() if token else len(page)) > at:
            add(page[at:begin])
        if token is None:
            break
        at = token.end()
        if not token["name"]:
            continue
        name = token["name"].lower()
        if name in ("br", "td", "th"):
            add(" ")
        if name in _BLOCKS:
            end()
        if token["close"]:
            anchored &= name != "a" and name not in _BLOCKS
            opened.close(name)
        elif name in _RAW:
            closing = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = closing.end() if closing else len(page)
            add(" ")
        elif name not in _EMPTY:
            anchored = name == "a" or (anchored and name not in _BLOCKS)
            if name in _BLOCKS and opened.stack[-1][0] == "p":  # a paragraph ends where another block begins
                opened.close("p")
            if name == "h1" and opened.names["form"]:
                opened.forget(lambda x: x[0] == "form")  # a form around the whole page
            opened.push(name, _kind(name, token["rest"], opened.inside()[2] > 0))
    end()
    return out


def _links(rows: list[Line]) -> list[bool]:
    """Whether each line is one of a list of links."""
    linked = [r.linked >= LINKED * len("".join(r.text.split())) for r in rows]
    out, begun = [False] * len(rows), 0
    for i in range(len(rows) + 1):
        if i == len(rows) or not linked[i]:
            if i - begun >= LISTED:
                out[begun:i] = [True] * (i - begun)
            begun = i + 1
    return out


def kept(rows: list[Line], marks: bool = True) -> list[int]:
    """The numbers of the lines of the main text. Without ``marks`` article and main elements say nothing."""
    lengths = [0 if r.aside else len(r.text) for r in rows]
    parts: dict[int, int] = {}
    for r, n in zip(rows, lengths):
        if r.marked and n:
            parts[r.marked] = parts.get(r.marked, 0) + n
    if marks and parts:
        most = max(parts.values())  # teasers are articles too, and a main part may hold more than its article
        lengths = [n if r.marked and (r.title or 4 * parts.get(r.marked, 0) >= most) else 0 for r, n in zip(rows, lengths)]
        rest = [i for i, r in enumerate(rows) if r.marked and not r.aside]  # what interrupts an article is no end of it
    else:
        lengths = [0 if link else n for n, link in zip(lengths, _links(rows))]
        rest = list(range(len(rows)))
    sizes = [lengths[i] for i in rest]
    sums = [sum(sizes[i : i + WINDOW]) for i in range(len(sizes))]
    surge = min(SURGE, max(sums, default=0))
    out, i = [], 0
    while i < len(sums):
        if not sums[i]:
            i += 1
            continue
        dive = next((j for j in range(i, len(sums)) if not sums[j]), len(sums))
        if max(sums[i:dive]) >= surge:
            out += [rest[j] for j in range(i, dive) if sizes[j]]
        i = dive
    return out


def main_text(page: str | None) -> str:
    rows = lines(page or "")
    return "\n\n".join(rows[i].text for i in kept(rows))


def extract(pages: DataFrame) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars (code points).

    A null or empty page, and one without text, has an empty text; a null url stays null; repeated rows are extracted alike, very
    long pages whole and in a time that grows with their length; an empty table has no rows. Only the three columns are read.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = batch.pop("html").map(main_text)
            yield batch.assign(text=text.astype(object), n_chars=text.map(len).astype("int64"))

    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return rows.mapInPandas(work, "page_id long, url string, text string, n_chars long")
