"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stimframe.llm.common import without

#: Elements without content, elements that are part of a line, elements whose content isn't text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
UNREAD = frozenset("title button select option textarea iframe object svg canvas noscript template datalist script style".split())
#: Elements, roles and words of a class or id that speak against an element, weakly or (two lines on) strongly; see weighed().
ASIDE = {"form": 1, "footer": 2, "aside": 2, "dialog": 2, "nav": 3}
MENUS = frozenset("navigation menu menubar".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?<!has-)(?<!with-)(?<!no-)(?:ads?|advert\w*|sponsor\w*|promo\w*|notices?|banner|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|header|masthead"
    r"|share|sharing|social|related|recommended|newsletter|subscribe|subscription|popup|modal|overlay|login|signin|signup|widget|pagination|pager|disclaimer|toolbar|tags"
    r"|werbung|anzeige|publicidad|publicité|publicite|seitenleiste)(?:$|[\s_-])"
)
#: The same for what stays aside even where it is longer than the article; words about cookies only if the whole name is about such a notice.
STRONG = re.compile(
    r"(?:^|[\s_-])(?:comments?|comment-?list|disqus|repl(?:y|ies)|responses?|kommentare?|comentarios?|commentaires?|footer|copyright)(?:$|[\s_-])"
    r"|^(?=.*(?:cookies?|consent|gdpr))(?:(?:cookies?|consent|gdpr|law|policy|notice|notification|banner|bar|box|popup|modal|overlay|dialog|message|info|wrapper|container)(?:[\s_-]+|$))+$"
)
#: Text outside an element with a strong word that is shorter than this, and than a fifth of the element's, is no article beside it.
SHORT = 100
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+(?:>|\Z)", re.S | re.I
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HREF = re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)
_HIDDEN = re.compile(r"(?:^|[\s\"'])hidden(?:$|[\s=/])|display\s*:\s*none", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？、؟¿¡]")
#: A path is content from this share of the mean fused score on; what speaks against a block divides its score by AGAINST.
THRESHOLD, AGAINST = 0.4, 8.0
#: Ratios are smoothed over two blocks on either side.
KERNEL = np.exp(-np.arange(-2.0, 3.0) ** 2 / 2)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: So many blocks of links alone at the edge of the article's element are a menu.
MENU = 3
#: Elements of running text, which are part of an article where they stand beside its content.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table thead tbody tr th td".split())
ADDED = ("text", "n_chars")


@dataclass
class Page:
    """Elements in page order (0 is the page itself) and the blocks of text in them. against: 0 nothing, 1 something, 2 something strong, 3 it is a menu."""

    names: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    against: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, characters that aren't in links
    apart: list[bool] = field(default_factory=list)  # of each block: whether all of it is in inline elements that something speaks against


def _against(name: str, attributes: str, article: bool) -> int:
    found = ASIDE.get(name, int(name == "header" and not article))
    for m in _ATTR.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            found = max(found, 3 if value in MENUS else 1)
        if key in ("class", "id") and name not in ("html", "body", "article", "main"):
            found = max(found, 2 if STRONG.search(value) else int(NAMES.search(value) is not None))
    return found


def parse(page: str) -> Page:
    """The elements and text blocks of a page, in time that grows with its length alone, however deep it nests."""
    out = Page()
    stack: list[tuple[str, int, bool, bool, bool]] = []  # open elements: name, number of the block element it is or is in, whether its text is unread, whether it is a link, whether it is inline and something speaks against it
    opened: dict[str, list[int]] = {}  # where in the stack elements of a name are open
    levels: list[int] = []  # where in the stack block elements are open
    parts: list[str] = []
    unread = plain = articles = links = named = own = at = 0  # own: characters outside inline elements that something speaks against

    def end() -> None:
        nonlocal parts, plain, own
        if parts and (text := " ".join(html.unescape("".join(parts)).split())):
            out.blocks.append((stack[levels[-1]][1] if levels else 0, text, plain))
            out.apart.append(own == 0)
        parts, plain, own = [], 0, 0

    def read(text: str) -> None:
        nonlocal plain, own
        parts.append(text)
        size = len(text) - text.count(" ") if not text.isspace() else 0
        plain += size if not links else 0
        own += size if not named else 0

    def pop(to: int) -> None:
        nonlocal unread, articles, links, named
        while len(stack) > to:
            name, _, away, link, aside = stack.pop()
            opened[name].pop()
            unread -= away
            links -= link
            named -= aside
            articles -= name in ("article", "main")
            if levels and levels[-1] == len(stack):
                levels.pop()

    for m in _TOKEN.finditer(page):
        if m.start() > at and not unread:
            read(page[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        name = m[3].lower()
        if name in VOID:
            if name in ("br", "hr"):
                end()
            continue
        line = name in INLINE
        if not line:
            end()
        if m[2]:
            k = opened[name][-1] if opened.get(name) else -1
            if k >= 0 and not (line and levels and levels[-1] > k):
                pop(k)
            continue
        if not line:  # a paragraph, item or cell that is still open ends here, and so do its inline elements
            if levels:
                pop(levels[-1] + 1)
            else:
                pop(0)
            if stack and (stack[-1][0] == "p" or stack[-1][0] == name and name in ("li", "td", "th", "tr", "dt", "dd", "option")):
                pop(len(stack) - 1)
        elif name == "a" and opened.get("a") and not (levels and levels[-1] > opened["a"][-1]):  # links don't nest
            pop(opened["a"][-1])
        away, link, aside = name in UNREAD, name == "a" and _HREF.search(m[4]) is not None, False
        if not line:
            out.names.append(name)
            out.parents.append(stack[levels[-1]][1] if levels else 0)
            out.against.append(_against(name, m[4], articles > 0))
            levels.append(len(stack))
        elif m[4]:  # an inline element is part of its sentence, however it is named, unless it isn't shown
            away = away or _HIDDEN.search(m[4]) is not None
            aside = _against(name, m[4], articles > 0) > 0
        opened.setdefault(name, []).append(len(stack))
        stack.append((name, len(out.names) - 1, away, link, aside))
        unread += away
        links += link
        named += aside
        articles += name in ("article", "main")
    if at < len(page) and not unread:
        read(page[at:])
    end()
    return out


def _sums(own: np.ndarray, parents: list[int]) -> list[int]:
    """Of each element: the sum over it and all in it."""
    out = own.tolist()
    for k in range(len(out) - 1, 0, -1):
        out[parents[k]] += out[k]
    return out


def weighed(page: Page) -> list[int]:
    """Of each element: how much speaks against it, or against one that it is in.

    What wraps the page or its article does not count, however it is named: an element with all of the text; one with more than half of the text
    that isn't in links (of the page, or of the article that it is in) and with every article of it; with a strong word (comments,
    footers, notices) only where no more than a scrap of text (see SHORT) is outside it. A menu counts unless it holds the whole page, paragraphs or an article among it.
    """
    n = len(page.names)
    plain, every = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, text, size in page.blocks:
        plain[k] += size
        every[k] += len(text)
    size, total = _sums(plain, page.parents), _sums(every, page.parents)
    held = _sums(np.array([int(x in ("article", "main")) for x in page.names]), page.parents)
    runs = _sums(np.array([int(x == "p" or x in ("article", "main")) for x in page.names]), page.parents)
    scope, out = [0] * n, [0] * n
    for k in range(1, n):
        up = page.parents[k]
        scope[k] = up if page.names[up] in ("article", "main") else scope[up]
        top, against = scope[k], page.against[k]
        alone = held[k] - (page.names[k] in ("article", "main")) == held[top] - (page.names[top] in ("article", "main"))  # with all articles of the scope
        rest = total[top] - total[k]
        if total[k] == total[0]:
            wraps = against < 3 or runs[k] > 0
        elif against < 2:
            wraps = alone and 2 * size[k] > size[top]
        else:
            wraps = against == 2 and alone and rest < SHORT and 5 * rest < total[k]
        out[k] = max(out[up], 0 if wraps else against)
    return out


def ratios(page: Page, paths: list[int]) -> np.ndarray:
    """Fused ratio of each block: length and punctuation of its tag path's text that isn't in links, for each node of the path, smoothed over neighbours, times the share of the path's text that isn't in links."""
    at = np.array(paths)
    nodes = np.bincount(at)
    length = np.bincount(at, [b[2] for b in page.blocks]) / nodes
    points = np.bincount(at, [len(_PUNCTUATION.findall(b[1])) if b[2] else 0 for b in page.blocks]) / nodes
    near = np.convolve(np.ones(len(at)), KERNEL)[2:-2]
    a, b = (np.convolve(x[at], KERNEL)[2:-2] / near for x in (length, points))
    return a * (1 + b) * (np.bincount(at, [b[2] for b in page.blocks]) / np.bincount(at, [len(b[1]) for b in page.blocks]))[at]


def main_text(page: str | None) -> str:
    """The article of a page.

    For each path of tags from the root, the length and the punctuation of its text are summed and divided by its nodes;
    text in links counts as none (unless nothing else is on the page), and a path's score is in proportion to what isn't. Both ratios are smoothed over neighbouring blocks in page order and fused as a product,
    which is divided by AGAINST where an element or its name speaks against a block. Paths whose mean score reaches a share
    of the page's are chosen, those that something speaks against only where no other path is. The article is the smallest element with every block of a chosen path, or the article element that holds most
    of them, with what runs on around it (see _root); all of it but for what something speaks against, and menus at its edges if it is no article element. If that is the whole body:
    all from the first to the last chosen block, and the running text that adjoins them.
    """
    whole = parse(page or "")
    against = weighed(whole)
    own = [b[0] for b in whole.blocks]
    away = np.array([against[k] > 0 or apart for k, apart in zip(own, whole.apart)], bool)
    linked = [not b[2] for b in whole.blocks]
    if not any(b[2] and not x for b, x in zip(whole.blocks, away)):  # but for what is aside, there are only links: they are the text
        whole.blocks = [b if x else (b[0], b[1], len(b[1]) - b[1].count(" ")) for b, x in zip(whole.blocks, away)]
        linked = [not b[2] for b in whole.blocks]
    known, numbers = {}, [0] * len(whole.names)
    for k in range(1, len(whole.names)):  # a path: that of the element around it, its name, whether something speaks against it
        numbers[k] = known.setdefault((numbers[whole.parents[k]], whole.names[k], against[k] > 0), len(known) + 1)
    if not own or all(against[k] == 3 for k in own):
        return ""
    paths = np.unique([numbers[k] for k in own], return_inverse=True)[1]
    fused = ratios(whole, paths.tolist()) / np.where(away, AGAINST, 1.0)
    sizes = np.array([len(b[1]) for b in whole.blocks])
    chosen = (np.bincount(paths, fused) / np.bincount(paths))[paths] >= THRESHOLD * (fused * sizes).sum() / sizes.sum()
    chosen &= (fused > 0) & np.array([against[k] < 3 for k in own])
    if not chosen.any():
        return ""
    if (plain := chosen & ~away).any():
        chosen = plain
    root = _root(whole, own, chosen, sizes, away, linked)
    first, last = np.flatnonzero(chosen)[[0, -1]].tolist()
    if root and whole.names[root] not in ("html", "body"):
        inside = [False] * len(whole.names)
        inside[root] = True
        for k in range(root + 1, len(inside)):
            inside[k] = inside[whole.parents[k]] and (against[root] > 0 or not against[k])
        kept = [inside[k] and (against[root] > 0 or not x) for k, x in zip(own, away)]
        if whole.names[root] not in ("article", "main"):
            _without_menus(whole, own, kept, linked, first, last)
            k = own.index(next(k for k in own if inside[k])) - 1
            while k >= 0 and whole.names[own[k]] in HEADINGS and whole.names[whole.parents[own[k]]] in ("", "html", "body") and not away[k] and not linked[k]:
                kept[k], k = True, k - 1
        return " ".join(b[1] for b, x in zip(whole.blocks, kept) if x)
    running = [k == root for k in range(len(whole.names))]
    for k in range(root + 1, len(running)):
        running[k] = running[whole.parents[k]] and whole.names[k] in RUNNING and not against[k]
    joins = lambda i: running[own[i]] and not away[i] and (not linked[i] or whole.names[own[i]] in HEADINGS)
    while first and joins(first - 1):
        first -= 1
    while last + 1 < len(own) and joins(last + 1):
        last += 1
    return " ".join(whole.blocks[i][1] for i in range(first, last + 1) if chosen[i] or not away[i])


def _root(page: Page, own: list[int], chosen: np.ndarray, sizes: np.ndarray, away: np.ndarray, linked: list[bool]) -> int:
    """The article's element: the last article element with most of the chosen text, or the smallest element with all of it, or one around that which adds no more than headings and running text."""
    counts = np.zeros(len(page.names), np.int64)
    np.add.at(counts, np.array(own)[chosen], sizes[chosen])
    held, total = _sums(counts, page.parents), int(sizes[chosen].sum())
    blocks = _sums(np.bincount(own, minlength=len(page.names)), page.parents)
    articles = [k for k, x in enumerate(page.names) if x == "article" and 2 * held[k] > total]
    if articles:
        return articles[-1]
    root = max(k for k, x in enumerate(held) if x == total)
    # An element of one block alone isn't the article, nor is one of running text.
    while root and page.names[root] not in ("main", "html", "body") and (page.names[root] in RUNNING or blocks[root] == 1):
        root = page.parents[root]
    name = [page.names[k] for k in own]
    extra = [not x and n not in HEADINGS and (n not in RUNNING or n in ("li", "td") or y) for n, x, y in zip(name, away, linked)]
    others = _sums(np.bincount(np.array(own)[np.array(extra, bool)], minlength=len(page.names)), page.parents)
    while root and page.names[root] != "main" and page.names[page.parents[root]] not in ("", "html", "body") and others[page.parents[root]] == others[root]:
        root = page.parents[root]
    return root


def _without_menus(page: Page, own: list[int], kept: list[bool], linked: list[bool], first: int, last: int) -> None:
    """Takes out of kept the runs of MENU blocks or more before the first and after the last chosen one that are links alone, headings apart."""
    for outer in (range(first - 1, -1, -1), range(last + 1, len(own))):
        run: list[int] = []
        for i in [*outer, None]:
            if i is not None and linked[i] and page.names[own[i]] not in HEADINGS:
                run.append(i)
                continue
            if len(run) >= MENU:
                for k in run:
                    kept[k] = False
            run = []


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text (empty if there is none, as for a null page) and n_chars, its code points.

    Each page is read whole and by itself; repeated rows get equal results; columns named text or n_chars are replaced. No shuffle.
    """

    @F.pandas_udf("string")
    def run(whole: pd.Series) -> pd.Series:
        return whole.map(main_text, na_action=None)

    return without(pages, ADDED).withColumn("text", run(F.col(html_col))).withColumn("n_chars", F.length("text").cast("long"))
