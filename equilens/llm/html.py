"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at its block-level tags.  Each block is described by its number of words and its link
density, by those of the blocks before and after it, by whether its tag is one of prose (a paragraph, heading, quotation),
and by where it stands: inside an article, inside something that its tag, class, id or role calls a menu, header,
footer, sidebar, notice, advert, form or comment, or in neither.  A decision tree trained on the small labelled table
below tells main text from the rest: what is set apart never is, elsewhere words, densities and tags decide.  The main
and the article with the most words, and whatever holds them, are never set apart, whatever their names say.

Defined results: a null, empty or text-free page has no blocks and an empty text; broken markup is read as far as
it goes (an unclosed element ends with the one around it, an unclosed comment, script or style with the page);
repeated rows give the same text; existing columns with the outputs' names are replaced, all others pass through.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without

NEITHER, ARTICLE, ASIDE = 0, 1, 2

#: Examples of what the letters of the labelled table stand for: words of a block (short, medium, long, very long), its link
#: density (poor, half, dense), and (words, link density) of a neighbour (none, links, or a short, medium or long text).
WORDS_OF = {"s": (1, 4, 9), "m": (10, 24, 59), "l": (60, 89), "x": (90, 300, 2500)}
DENSITY_OF = {"p": (0.0, 0.1, 0.3), "h": (0.31, 0.5), "d": (0.61, 1.0)}
BESIDE_OF = {"0": ((0, 0.0),), "d": ((1, 1.0), (12, 0.5), (60, 0.8)), "s": ((1, 0.0), (9, 0.3)), "m": ((10, 0.0), (59, 0.3)), "l": ((60, 0.0), (2500, 0.3))}
ANY, TEXT = "0dsml", "0sml"
#: Whether the tag of a block is one of prose (yes, no).
PROSE_OF = {"y": (1,), "n": (0,)}
#: The labelled table, by hand: place, words, link density, the blocks before and after, prose, main text. The first row that fits counts.
LABELLED = [
    # In an article, a label among links is none; text is main, links only within prose.
    (ARTICLE, "s", "p", "d", "d", "yn", 0), (ARTICLE, "smlx", "p", ANY, ANY, "yn", 1), (ARTICLE, "sm", "h", "ml", "ml", "yn", 1), (ARTICLE, "lx", "h", ANY, ANY, "yn", 1),
    (ARTICLE, "s", "d", "ml", "ml", "yn", 1), (ARTICLE, "smlx", "hd", ANY, ANY, "yn", 0),
    # What is set apart never is: a long comment, footer or advert reads like an article.
    (ASIDE, "smlx", "phd", ANY, ANY, "yn", 0),
    # In neither, a short block is main as a heading between texts or before a long one, or as prose away from links, a medium one unless among links.
    (NEITHER, "s", "p", "ml", "ml", "yn", 1), (NEITHER, "s", "p", ANY, "l", "yn", 1), (NEITHER, "s", "p", TEXT, TEXT, "y", 1), (NEITHER, "s", "p", "d", "sm", "y", 1),
    (NEITHER, "m", "p", "d", "d", "n", 0), (NEITHER, "mlx", "p", ANY, ANY, "yn", 1), (NEITHER, "lx", "h", "ml", "ml", "yn", 1), (NEITHER, "smlx", "phd", ANY, ANY, "yn", 0),
]

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object select option button canvas".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are never main text; words in class, id or role that say so, and words that may stand beside them in one name.
ASIDE_TAGS = frozenset("nav header footer aside form head dialog menu fieldset".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion menu nav navbar navigation breadcrumb breadcrumbs header masthead footer "
    "sidebar aside widget cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login form search comment "
    "comments disqus reply replies respond discussion share sharing social related recommended recommendations pagination pager toolbar contentinfo complementary skip".split()
)
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|["']""")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
#: Tags of blocks of prose, a formula with its notes, and names of class that say what holds an article.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd".split())
MATH, NOTE, ANY_TAG = re.compile(r"</math\b[^>]*(?:>|\Z)", re.I), re.compile(r"<annotation\b.*?(?:</annotation[^>]*>|\Z)", re.I | re.S), re.compile(r"<[^>]*(?:>|\Z)")
HOLDING = frozenset("content article post entry story main".split())
BESIDE = frozenset("area bar block bottom box col column container content global inner item left list main outer page panel primary right section secondary site top wrap wrapper".split())
WORDS = re.compile(r"[a-z]+")


def set_apart(tag: str, attributes: str) -> bool:
    """Whether an element's attributes say so."""
    if not attributes or tag in ("html", "body"):
        return False
    given = {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in reversed(list(ATTRIBUTE.finditer(attributes))) if m[1]}
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or NO_DISPLAY.search(given.get("style", "")):
        return True
    # A class that is the name of what holds an article outweighs the id.
    asked = ("class", "role") if not HOLDING.isdisjoint(given.get("class", "").lower().split()) else ("class", "id", "role")
    for attribute in asked:
        # Whole names count: "ad-banner" and "site-footer" are set apart, "share-enabled" and "no-sidebar" are not.
        for name in given.get(attribute, "").split():
            words = set(WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
            if not ASIDE_WORDS.isdisjoint(words) and words <= ASIDE_WORDS | BESIDE:
                return True
    return False


def places(elements: list[tuple[int, str, bool]], blocks: list[tuple[str, int, float, int, int]]) -> list[int]:
    """The place inside each element and, as the last, outside of all."""
    words, home = [0] * len(elements), [-1] * len(elements)
    for _, n, _, of, _ in blocks:
        if of >= 0:
            words[of] += n
    for i in range(len(elements) - 1, -1, -1):
        if elements[i][0] >= 0:
            words[elements[i][0]] += words[i]
    # The main with the most words, and the article with the most, within that main where there is one.
    most = lambda found: max(found, key=lambda i: (words[i], -i), default=-1)
    main = most(i for i, e in enumerate(elements) if e[1] == "main")
    for i, (around, _, _) in enumerate(elements):
        home[i] = main if i == main else home[around] if around >= 0 else -1
    article = most(i for i, e in enumerate(elements) if e[1] == "article" and home[i] == main)
    never = set()
    for i in (main, article):
        while i >= 0 and i not in never:
            never.add(i)
            i = elements[i][0]
    out: list[int] = []
    for i, (around, tag, apart) in enumerate(elements):
        place = out[around] if around >= 0 else NEITHER
        if i not in never and (place == ASIDE or apart or (tag in ASIDE_TAGS and not (tag == "header" and place == ARTICLE))):
            out.append(ASIDE)
        else:
            out.append(ARTICLE if tag in ("article", "main") else place)
    return [*out, NEITHER]


def blocks_of(page: str) -> list[tuple[str, int, float, int, int]]:
    """(text, words, link density, place, prose) of the blocks in page order."""
    out: list[tuple[str, int, float, int, int]] = []  # with the element at first
    elements: list[tuple[int, str, bool]] = []  # the one around it, tag, whether its attributes set it apart
    stack: list[tuple[str, int]] = []  # open elements
    unclosed: Counter[str] = Counter()  # their tags
    parts: list[tuple[str, bool]] = []
    inside, links, at = -1, 0, 0
    linked_at = 0  # open elements around the link

    def opened(tag: str, apart: bool) -> int:
        stack.append((tag, len(elements)))
        unclosed[tag] += 1
        elements.append((inside, tag, apart))
        return len(elements) - 1

    def leave() -> None:
        unclosed[stack.pop()[0]] -= 1

    def text(upto: int) -> None:
        if upto > at and (piece := page[at:upto]):
            parts.append((entities.unescape(piece), links > 0))

    def close(of: int) -> None:
        if parts:
            words = " ".join("".join(p for p, _ in parts).split())
            if words:
                n, linked = words.count(" ") + 1, sum(len(p.split()) for p, link in parts if link)
                out.append((words, n, min(1.0, linked / n), of, int(any(t in PROSE for t, _ in stack[-4:]))))
            parts.clear()

    while m := TAG.search(page, at):
        text(m.start())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        end, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag in RAW and not end:
            if not attributes.endswith("/"):
                found = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = found.end() if found else len(page)
            continue
        if tag == "a":
            links, linked_at = 0 if end else 1, len(stack)
        if tag == "math" and not end:
            found = MATH.search(page, at)
            parts.append((entities.unescape(ANY_TAG.sub("", NOTE.sub("", page[at : found.start() if found else len(page)]))), links > 0))
            at = found.end() if found else len(page)
            continue
        if tag == "br":
            parts.append((" ", False))
        if tag in VOID:
            if tag == "hr":
                close(inside)
            continue
        if tag in INLINE:
            if end:
                if stack and stack[-1][0] == tag:
                    close(inside)
                    leave()
                    inside = stack[-1][1] if stack else -1
            elif attributes and tag != "a" and set_apart(tag, attributes):
                close(inside)  # an inline element that is set apart is a block of its own
                inside = opened(tag, True)
            continue
        close(inside)
        if end:
            if unclosed[tag]:
                while stack[-1][0] != tag:
                    leave()
                leave()
        elif not attributes.endswith("/"):
            while stack and (stack[-1][0] == "p" or stack[-1][0] in INLINE or stack[-1][0] == tag in ("li", "td", "th", "tr", "dt", "dd")):
                leave()
            inside = stack[-1][1] if stack else -1
            if links and len(stack) < linked_at:
                links = 0
            opened(tag, set_apart(tag, attributes))
        if links and len(stack) < linked_at:
            links = 0  # a link ends with what it stands in
        inside = stack[-1][1] if stack else -1
    text(len(page))
    close(inside)
    where = places(elements, out)
    return [(words, n, density, where[of], prose) for words, n, density, of, prose in out]


def features(blocks: list[tuple[str, int, float, int, int]]) -> np.ndarray:
    own = np.array([(p, n, d) for _, n, d, p, _ in blocks], float).reshape(-1, 3)
    around = np.vstack([np.zeros((1, 2)), own[:, 1:], np.zeros((1, 2))])
    return np.hstack([own, around[:-2], around[2:], np.array([[b[4]] for b in blocks], float).reshape(-1, 1)])


class Tree:
    """A decision tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 16):
        self.value, self.cut = y.mean() >= 0.5, None
        if depth == 0 or y.min() == y.max():
            return
        gini = lambda part: len(part) * part.mean() * (1 - part.mean()) if len(part) else 0.0
        best = gini(y) - 1e-9
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for c in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= c
                if (cost := gini(y[left]) + gini(y[~left])) < best:
                    best, self.cut = cost, (f, c)
        if self.cut:
            left = x[:, self.cut[0]] <= self.cut[1]
            self.low, self.high = Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.cut or not len(x):
            return np.full(len(x), self.value)
        left = x[:, self.cut[0]] <= self.cut[1]
        out = np.empty(len(x), bool)
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out


def train(labelled: list[tuple] = LABELLED) -> Tree:
    """The tree of all examples of the labelled rows."""
    rows: dict[tuple, int] = {}
    for place, words, density, before, after, prose, main in labelled:
        for w, d, b, a, p in itertools.product(*[[x for k in kinds for x in of[k]] for of, kinds in ((WORDS_OF, words), (DENSITY_OF, density), (BESIDE_OF, before), (BESIDE_OF, after), (PROSE_OF, prose))]):
            rows.setdefault((place, w, d, *b, *a, p), main)
    table = np.array([(*x, main) for x, main in rows.items()], float)
    return Tree(table[:, :-1], table[:, -1])


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", blocks_col: str = "blocks", labelled: list[tuple] = LABELLED) -> DataFrame:
    """``pages`` with all blocks (text, words, link_density, place, main) and the main ones joined by an empty line."""
    tree = train(labelled)

    @F.pandas_udf("array<struct<text:string,words:int,link_density:double,place:int,main:boolean>>")
    def classified(htmls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in htmls:
            out = []
            for page in batch:
                blocks = blocks_of(page)
                main = tree.predict(features(blocks)) if blocks else ()
                out.append([dict(text=t, words=n, link_density=d, place=p, main=bool(m)) for (t, n, d, p), m in zip([b[:4] for b in blocks], main, strict=True)])
            yield pd.Series(out, dtype=object)

    out = without(pages, text_col, blocks_col).withColumn(blocks_col, classified(F.coalesce(pages[html_col], F.lit(""))))
    return out.withColumn(text_col, F.array_join(F.transform(F.filter(blocks_col, lambda b: b["main"]), lambda b: b["text"]), "\n\n"))
