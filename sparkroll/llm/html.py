"""Main text of web pages by the distribution of text over line blocks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sparkroll.llm.common import table

#: Lines in a window, and the text a window needs for a surge.
WINDOW, DENSE = 3, 120
#: Elements that hold running text; a short line in another element weighs nothing where these hold most of the text.
RUNNING = frozenset("p li blockquote pre dd dt figcaption h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is never text of the page.
RAW = ("script", "style", "noscript", "template", "title", "textarea", "svg", "iframe", "head")
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul".split()
)
#: Elements without content of their own.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLES = frozenset(("article", "main"))
#: Elements that are never left out, and those that no class word marks.
WHOLE, HEADINGS = frozenset(("html", "body")), frozenset("h1 h2 h3 h4 h5 h6".split())
FORM, WORDED, SURE = 1, 2, 3
#: Elements around an article, wherever they stand; a header inside an article holds its title.
AROUND = frozenset("nav footer aside form button select menu dialog".split())
ROLES = re.compile(r"""\brole\s*=\s*["']?(navigation|banner|contentinfo|complementary|search|form|dialog|alert)\b""", re.I)
MARKED = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: Words in a class or id that mark something beside the article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "sidebar menu navbar nav navigation breadcrumb breadcrumbs toolbar comment comments reply replies disqus respond share sharing social "
    "related recommended newsletter subscribe signup login popup modal overlay footer masthead topbar pagination pager skip widget".split()
)
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
#: A comment, a declaration, or a tag with its attributes; possessive, so that no page makes it slow.
TAG = re.compile(r"""<!--|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
#: White space of HTML and of decoded references.
SPACES = re.compile(r"\s+")


def beside(name: str, attributes: str, article: bool = False) -> int:
    """Does this element hold something else than the article? 0: no; FORM or WORDED: perhaps, see `Lines.left`; SURE: yes."""
    if name in WHOLE:
        return 0
    if name in AROUND:
        return FORM if name == "form" else SURE
    if not attributes:
        return 0
    role = ROLES.search(attributes)
    if HIDDEN.search(attributes) or role and role.group(1).lower() != "form":
        return SURE
    if role:
        return FORM
    if name in HEADINGS:
        return 0
    for m in MARKED.finditer(attributes):
        words = [w.lower() in BESIDE for w in WORD.findall(m.group(1) or m.group(2) or m.group(3) or "")]
        # the id of a section in an article names what it is about
        if words and (all(words) if article and name == "section" and m.group(0)[:2].lower() == "id" else any(words)):
            return WORDED
    return 0


class Line(NamedTuple):
    """A block without markup: its text, how much of it is link text, the element it stands in, and whether in an article."""

    text: str
    linked: int
    element: str
    inside: bool


class Lines:
    """The blocks of a page in order, each as pieces of text with the elements beside the article that they stand in."""

    def __init__(self) -> None:
        #: (pieces (text, is link, elements), innermost element, stands in an article)
        self.blocks: list[tuple[list[tuple[str, int, tuple[int, ...]]], str, bool]] = []
        self.parts: list[tuple[str, int, tuple[int, ...]]] = []
        self.element = "body"
        #: of each element that may be beside the article: its kind
        self.kinds: list[int] = []

    def end(self, inside: bool, element: str = "body") -> None:
        if self.parts:
            self.blocks.append((self.parts, self.element, inside))
            self.parts = []
        self.element = element

    def left(self) -> set[int]:
        """Elements that are no part of the text.

        What a class word or an open end marks is left out if it holds the smaller part of the page or is mostly links; a form
        stays also if it holds running text.
        """
        if all(k == SURE for k in self.kinds):
            return set(range(len(self.kinds)))
        size, linked, running = ([0] * len(self.kinds) for _ in range(3))
        total = 0
        for parts, _, _ in self.blocks:
            plain: dict[int, int] = {}
            for text, link, elements in parts:
                n = len(text.strip())
                total += n
                for e in elements:
                    size[e] += n
                    linked[e] += n * link
                    plain[e] = plain.get(e, 0) + n * (not link)
            for e, n in plain.items():
                running[e] = max(running[e], n)
        stays = lambda e: 2 * linked[e] < size[e] and (2 * size[e] > total or self.kinds[e] == FORM and running[e] >= DENSE)
        return {e for e, k in enumerate(self.kinds) if k == SURE or not stays(e)}

    def done(self, left: set[int]) -> list[Line]:
        """The blocks that hold text without the elements in `left`."""
        out = []
        for parts, element, inside in self.blocks:
            mine = [(t, link) for t, link, elements in parts if left.isdisjoint(elements)]
            text = SPACES.sub(" ", html.unescape("".join(t for t, _ in mine))).strip()
            if text:
                out.append(Line(text, min(sum(len(t) for t, link in mine if link), len(text)), element, inside))
        return out


def strip_markup(page: str) -> Lines:
    """Blocks of text without markup, and what may stand beside the article."""
    lines, at = Lines(), 0
    # open elements that may be left out, or are an article: (name, depth of the same name inside, number or -1 for an article)
    around: list[list] = []
    article, beside_of, link = 0, (), 0
    for tag in iter(lambda: TAG.search(page, at), None):
        if tag.start() > at:
            lines.parts.append((page[at : tag.start()], link, beside_of))
        at = tag.end()
        if tag.group(0) == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        if tag.group(2) is None:
            continue
        closing, name, attributes = tag.group(1), tag.group(2).lower(), tag.group(3)
        if not closing and name in ENDS:
            end = None if name == "svg" and attributes.endswith("/") else ENDS[name].search(page, at)
            if end is None and name == "svg":
                continue
            body = re.compile(r"<body\b", re.I).search(page, at) if end is None and name in ("head", "title") else None
            at = end.end() if end else body.start() if body else len(page)
            continue
        if name in BLOCKS:
            lines.end(article > 0, "body" if closing else name)
        elif name in ("br", "td", "th"):
            lines.parts.append((" ", link, beside_of))
        if name == "a":
            link = 0 if closing else 1
        if name in EMPTY or attributes.endswith("/"):
            continue
        if closing:
            for k in range(len(around) - 1, -1, -1):
                if around[k][0] == name:
                    if around[k][1]:
                        around[k][1] -= 1
                    else:
                        article -= sum(x[2] < 0 for x in around[k:])
                        del around[k:]
                        beside_of = tuple(x[2] for x in around if x[2] >= 0)
                    break
            continue
        off = SURE if name == "header" and not article else beside(name, attributes, article > 0)
        if name in ARTICLES and (not off or off == WORDED and not beside_of):
            if beside_of and not article:
                # what may be left out was never closed, or holds the article: the article begins all the same
                around, beside_of = [x for x in around if x[2] < 0], ()
            around.append([name, 0, -1])
            article += 1
        elif off:
            around.append([name, 0, len(lines.kinds)])
            beside_of += (len(lines.kinds),)
            lines.kinds.append(off)
        elif around and around[-1][0] == name:
            around[-1][1] += 1
    if at < len(page):
        lines.parts.append((page[at:], link, beside_of))
    lines.end(article > 0)
    # an element that is never closed may hold the rest of the page
    for e in beside_of:
        lines.kinds[e] = min(lines.kinds[e], WORDED)
    return lines


def dense_lines(weights: np.ndarray, least: int = DENSE, titles: np.ndarray | None = None) -> np.ndarray:
    """Which lines lie between a surge and a dive of the text in WINDOW consecutive lines.

    A window surges when its sum reaches `least`. Its block begins where the windows before it last rose from nothing,
    or at the first title (`titles`) behind that, if less than `least` stands before the title. It ends where the sum falls to nothing
    (the dive). Lines from the first to the last one with weight are kept, lines without weight between them too.
    """
    n = len(weights)
    keep = np.zeros(n, bool)
    total = np.concatenate([[0], np.cumsum(weights)])
    sums = total[np.minimum(np.arange(n) + WINDOW, n)] - total[:n]
    # runs of windows that hold text
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (sums > 0).astype(np.int8), [0]])))
    for rise, dive in zip(edges[::2], edges[1::2], strict=True):
        if sums[rise:dive].max() < least:
            continue
        heavy = rise + np.flatnonzero(weights[rise:dive] > 0)
        first, last = heavy[0], heavy[-1]
        if titles is not None and titles[first:last].any():
            title = first + int(np.argmax(titles[first:last]))
            first = title if total[title] - total[first] < least else first
        keep[first : last + 1] = True
    return keep


def main_text(page: str | None) -> str:
    """The text between surge and dive points, blocks joined by an empty line.

    Empty for a null or empty page, and for one without text outside its menus and the like; if those hold running
    text, as an element does that is never closed, that text is the page's.
    """
    if not page:
        return ""
    blocks = strip_markup(page)
    lines = blocks.done(blocks.left())
    return "\n\n".join(kept_lines(lines) if lines else kept_lines(blocks.done(set()), False))


def kept_lines(lines: list[Line], short: bool = True) -> list[str]:
    """Lines between surge and dive; with `short`, on a page without any surge, those that are not mostly links."""
    if not lines:
        return []
    size = np.array([len(x.text) for x in lines])
    plain = size - np.array([x.linked for x in lines])
    inside = np.array([x.inside for x in lines])
    titles = np.array([x.element == "h1" for x in lines])
    bare = np.array([x.element not in RUNNING for x in lines])
    texts = 2 * plain >= size
    if inside.any():
        # the page marks its article: the mark gives weight to lines in it, and takes it from all others
        keep = dense_lines(np.where(inside, size + DENSE, 0)) & inside
    else:
        weights = np.where(texts, plain, 0)
        # where running elements hold most of the text, a short line outside them does not begin or end it
        light = bare & (plain < DENSE) & (2 * weights[bare].sum() <= weights.sum())
        keep = dense_lines(np.where(light, 0, weights), titles=titles)
        if not keep.any():
            keep = dense_lines(weights, titles=titles)
        if not keep.any() and short:
            running = texts & ~bare
            keep = running if running.any() else texts
        # a line of links is a menu
        keep &= texts
    return [x.text for x, k in zip(lines, keep, strict=True) if k]


def extract(page: str | Column) -> Column:
    """Main text of a whole page, as a column. Malformed markup never fails: what is not a tag is text."""

    def run(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in pages:
            yield pa.array([main_text(p.as_py()) for p in batch], pa.string())

    return arrow_udf(run, "string").asNondeterministic()(page)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars, one row for each row of `pages`, repeated and null ones too."""
    return pages.select("page_id", "url", extract("html").alias("text")).select("*", F.char_length("text").cast("bigint").alias("n_chars"))


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
