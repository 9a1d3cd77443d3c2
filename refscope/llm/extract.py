"""Main text of web pages: blocks are labelled content or boilerplate by a minimum cut."""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refscope.llm.common import bounded_batches

#: Pages, about, whose marked blocks the classifier is fitted on, and what their counts weigh against the prior.
FIT_PAGES = 2000
FIT_WEIGHT = 50.0

# Elements of HTML and words of class names and ids.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SILENT = frozenset("audio button canvas datalist object select svg template video noscript".split())
_RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
# An element ends where one of its like begins, unless the list or table between them is another.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
_MAIN_TAGS = frozenset("article main".split())
_OTHER_TAGS = frozenset("aside dialog footer form header menu nav".split())
_MAIN_ROLES = frozenset("article main".split())
_OTHER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
_MAIN_WORDS = frozenset("article content entry main post story".split())
_OTHER_WORDS = frozenset(
    "ad ads adsbygoogle alert aside banner consent copyright disqus form gdpr header login masthead menu modal notice notices overlay "
    "pager pagination paywall popup recommended replies reply respond search signup toast toolbar widget".split()
)
_OTHER_STARTS = re.compile("advert|breadcrumb|comment|cookie|footer|nav|newsletter|promo|related|share|sharing|sidebar|social|sponsor|subscri")
_REPLIES = re.compile("comment|disqus|repl|respond")
_MARKS = re.compile(r"©|\(c\) ?[12]\d{3}|all rights reserved|privacy policy|terms of (?:use|service)|cookies", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(eq=False)
class Element:
    """A block element of the tree; inline elements are not kept."""

    tag: str
    above: Element | None
    depth: int
    unseen: bool  # it or one around it is hidden
    in_main: bool  # one around it is an article or main element
    kind: str  # what tag, role or names say: "main", "like main", "other" or nothing
    layout: bool  # only names, or a form, say that it is something else than main
    holds: str = ""  # "main" if it holds a main element, "title" if it holds a heading or what is like main
    size: int = 0  # characters inside
    says: str = ""  # what it and all around it say


@dataclass
class Block:
    """Text between two borders of block elements."""

    text: str
    linked: int  # characters inside links
    place: Element
    features: tuple[int, ...] = ()


_ROOT = Element("", None, 0, False, False, "", False)


def _names(attributes: dict[str, str]) -> set[str]:
    """Words of the class and the id, whole between hyphens and by capital letters."""
    said = attributes.get("class", "") + " " + attributes.get("id", "")
    return {w.lower() for w in _NAME.findall(said)} | set(re.split(r"[\W_]+", said.lower()))


def _kind(tag: str, attributes: dict[str, str], in_main: bool) -> tuple[str, bool]:
    """What an element says it is, and whether that is only a matter of layout names."""
    role = attributes.get("role", "").lower()
    if role in _OTHER_ROLES - {"form"}:
        return "other", False
    names = _names(attributes) if "class" in attributes or "id" in attributes else set()
    other = {w for w in names if w in _OTHER_WORDS or _OTHER_STARTS.match(w)}
    if in_main and (tag == "header" or "header" in other) and other <= {"header"}:
        # The heading of an article is its own.
        return "", False
    if tag in _OTHER_TAGS - {"form"}:
        return "other", False
    if tag == "form" or role == "form" or (other and tag not in ("body", "html", *_HEADINGS)):
        return "other", not any(map(_REPLIES.match, other))
    if tag in _MAIN_TAGS or role in _MAIN_ROLES:
        return "main", False
    return ("like main" if names & _MAIN_WORDS else ""), False


def _element(tag: str, raw: str, above: Element) -> Element:
    attributes: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw) if raw.strip(" /") else ():
        attributes.setdefault(name.lower(), unescape("".join(values)))
    unseen = "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(_UNSEEN.search(attributes.get("style", "")))
    in_main = above.in_main or above.kind == "main"
    return Element(tag, above, above.depth + 1, unseen or above.unseen, in_main, *_kind(tag, attributes, in_main))


def _settle(elements: list[Element], blocks: list[Block]) -> None:
    """Sizes from the leaves up, then what each element says from the root down.

    A name says nothing on an element that holds the main element, or over half of the
    page's text with a heading or something like a main part: the name is of the whole layout.
    """
    for block in blocks:
        block.place.size += len(block.text)
    for x in reversed(elements):
        up = x.above
        up.size += x.size
        own = "main" if x.tag == "main" else "title" if x.tag in ("article", "h1") or x.kind == "like main" else ""
        up.holds = max(up.holds, x.holds, own, key=("", "title", "main").index)
    whole = sum(len(b.text) for b in blocks)
    for x in elements:
        kind = x.kind
        if x.layout and (x.holds == "main" or (x.holds == "title" and 2 * x.size > whole)):
            kind = ""
        around = x.above.says
        x.says = max(around, kind, key=("", "like main", "main", "other").index)


def blocks_of(html: str) -> list[Block]:
    """Blocks of a page in page order; scripts, styles, markup, controls and hidden parts give none."""
    found: list[Block] = []
    elements: list[Element] = []
    here = root = replace(_ROOT)
    opened: Counter[str] = Counter()
    parts: list[str] = []
    at = links = linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split()) if parts else ""
        if text and not here.unseen:
            found.append(Block(text, linked, here))
        parts.clear()
        linked = 0

    def close(tags: set[str] | frozenset[str], borders: set[str] | frozenset[str]) -> None:
        """Leave the nearest open element of ``tags``, and all inside it."""
        nonlocal here
        if not any(opened[t] for t in tags):
            return
        place = here
        while place.tag not in tags:
            if place.tag in borders:
                return
            place = place.above
        while here is not place.above:
            opened[here.tag] -= 1
            here = here.above

    token = _TOKEN.search(html)
    while True:
        raw = html[at : token.start() if token else len(html)]
        if raw:
            text = unescape(raw)
            parts.append(text)
            if links:
                linked += len(text) - text.count(" ")
        if not token:
            break
        at = token.end()
        name = token[2].lower() if token[2] else ""
        if name in _RAW or name in _SILENT:
            if not token[1] and not (name in _SILENT and token[3].endswith("/")):
                at = _end_of(name).search(html, at).end()
        elif name == "a":
            links = 0 if token[1] else 1
        elif name == "br":
            parts.append(" ")
        elif name in _BLOCKS:
            flush()
            if token[1]:
                borders = {"table"} if name not in ("table", "body", "html") else set()
                close(_HEADINGS if name in _HEADINGS else {name}, borders)
            elif name != "hr":
                # No block stands inside a paragraph, and no heading inside a heading.
                if here.tag == "p" or (here.tag in _HEADINGS and name in _HEADINGS):
                    close({here.tag}, set())
                if name in _ENDS:
                    close(*_ENDS[name])
                if not (name in ("html", "body") and here is not root and opened[name]):
                    here = _element(name, token[3], here)
                    opened[name] += 1
                    elements.append(here)
        token = _TOKEN.search(html, at)
    flush()
    _settle(elements, found)
    for block in found:
        block.features = _features(block)
    return found


@lru_cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)|\Z", re.I)


#: Features of a block, all of few values, and the classifier's weights before it is fitted.
PRIOR = np.array([-0.3, 0.35, -4.0, 0.9, 0.6, -0.6, -2.5])


def _features(block: Block) -> tuple[int, ...]:
    """One; power of two of the words, up to 128; tenths of the characters in links; ends as a sentence; heading; list item; legal marks."""
    words = len(block.text.split())
    letters = len(block.text) - block.text.count(" ")
    return (
        1,
        min(words.bit_length(), 8),
        min(10, 10 * block.linked // max(letters, 1)),
        int(block.text.rstrip("\"'”’»)")[-1:] in {*".!?:…。！？"}),
        int(block.place.tag in _HEADINGS),
        int(block.place.tag in ("li", "dd", "dt")),
        int(bool(_MARKS.search(block.text))),
    )


def _values(features: np.ndarray) -> np.ndarray:
    out = np.array(features, float).reshape(-1, len(PRIOR))
    out[:, 2] /= 10
    return out


#: Log odds that the elements around a block add: "other" if any says so, else "main", "like main" or nothing.
_MARKED = {"other": -7.0, "main": 5.0, "like main": 2.5, "": 0.0}


def fit(kinds: list[tuple[int, int, list[int]]], weight: float = FIT_WEIGHT) -> np.ndarray:
    """Weights of a logistic classifier: ``kinds`` are count, label and features; all counts weigh ``weight`` blocks.

    The prior is normal around ``PRIOR``; either label weighs half; no weight but the first
    changes its sign. Nothing to learn from leaves ``PRIOR``.
    """
    if {label for _, label, _ in kinds} != {0, 1}:
        return PRIOR.copy()
    n, y = np.array([k[0] for k in kinds], float), np.array([k[1] for k in kinds], float)
    x = _values(np.array([k[2] for k in kinds]))
    n = np.where(y == 1, n / n[y == 1].sum(), n / n[y == 0].sum()) * weight / 2
    theta = PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ theta)))
        slope = x.T @ (n * (y - p)) - (theta - PRIOR)
        theta = theta + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(theta)), slope)
    return np.where((theta * PRIOR < 0) & (np.arange(len(theta)) > 0), 0.0, theta)


def minimum_cut(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes a minimum cut leaves on the side of the source.

    ``costs``: capacity from the source, or to the sink if negative. ``edges``: two
    nodes and the capacity either way. Flow is pushed along shortest paths, level by
    level, until the sink cannot be reached. Of several minimum cuts: the fewest nodes.
    """
    n = len(costs)
    supply, demand = [max(c, 0) for c in costs], [max(-c, 0) for c in costs]
    ends: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[int] = []
    for a, b, capacity in edges:
        ends[a].append(len(to))
        ends[b].append(len(to) + 1)
        to += [b, a]
        room += [capacity, capacity]
    while True:
        level = [0 if s > 0 else -1 for s in supply]
        queue = deque(i for i in range(n) if supply[i] > 0)
        reached = False
        while queue:
            i = queue.popleft()
            reached |= demand[i] > 0
            for e in ends[i]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        tried = [0] * n
        for start in range(n):
            path: list[int] = []
            i = start
            while supply[start] > 0:
                if demand[i] > 0:
                    push = min(supply[start], demand[i], *(room[e] for e in path))
                    supply[start] -= push
                    demand[i] -= push
                    for e in path:
                        room[e] -= push
                        room[e ^ 1] += push
                    path, i = [], start
                    continue
                while tried[i] < len(ends[i]):
                    e = ends[i][tried[i]]
                    if room[e] > 0 and level[to[e]] == level[i] + 1:
                        break
                    tried[i] += 1
                else:
                    if not path:
                        break
                    i = to[path.pop() ^ 1]
                    tried[i] += 1
                    continue
                path.append(e)
                i = to[e]


def _apart(one: Element, two: Element) -> int:
    """Steps between two elements of the tree."""
    steps = 0
    while one is not two:
        if one.depth >= two.depth:
            one = one.above
        else:
            two = two.above
        steps += 1
    return steps


#: Costs are whole thousandths. A neighbour in page order, and the one before under the same parent, pull so much at no distance.
_UNIT = 1000
_NEXT, _BESIDE = 3.0, 1.5


def content(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks are content: the cheapest labelling of the page.

    A label that the classifier and the elements around the block speak against
    costs their log odds; two neighbours with different labels cost the more the
    nearer they are in the tree.
    """
    if not blocks:
        return []
    odds = _values(np.array([b.features for b in blocks])) @ weights
    odds = odds + np.array([_MARKED[b.place.says] for b in blocks])
    costs = np.rint(odds * _UNIT).astype(int).tolist()
    edges = [(i, i + 1, round(_UNIT * _NEXT / (1 + _apart(a.place, b.place)))) for i, (a, b) in enumerate(zip(blocks, blocks[1:]))]
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        parent = id(block.place.above)
        before = last.get(parent, i)
        if before < i - 1:
            edges.append((before, i, round(_UNIT * _BESIDE / (1 + _apart(blocks[before].place, block.place)))))
        last[parent] = i
    return minimum_cut(costs, edges)


def main_text(html: str, weights: np.ndarray) -> tuple[str, int, int]:
    """Main text of a page, its number of blocks and how many of them are content."""
    blocks = blocks_of(html)
    keep = content(blocks, weights)
    return "\n\n".join(b.text for b, good in zip(blocks, keep) if good), len(blocks), sum(keep)


def fitted(pages: DataFrame, html: Column, most: int = FIT_PAGES) -> np.ndarray:
    """The classifier's weights, fitted on blocks whose elements say what they are.

    Of all pages about ``most`` are looked at, chosen by a hash of the page. Their blocks are
    counted by kind, of which there are at most some ten thousand; only these counts
    reach the driver. Pages without such elements leave the prior.
    """

    def run(some: pd.Series) -> pd.Series:
        out = []
        for page in some:
            says = [(b.place.says, b.features) for b in blocks_of(page)]
            out.append([[int(m == "main"), *f] for m, f in says if m in ("main", "other")])
        return pd.Series(out, dtype=object)

    bounded_batches(pages.sparkSession)
    run.__annotations__ = {"some": pd.Series, "return": pd.Series}
    texts = pages.select(html.alias("html")).where("html IS NOT NULL")
    total = texts.count()
    chosen = texts.where(F.pmod(F.xxhash64("html"), F.lit(max(total, 1))) < most)
    kinds = chosen.select(F.explode(F.pandas_udf(run, "array<array<int>>")("html")).alias("kind"))
    counts = kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()
    return fit(sorted((r.n, r.kind[0], list(r.kind[1:])) for r in counts))


def extracted(pages: DataFrame, html: Column, weights: np.ndarray) -> DataFrame:
    """Every row as struct ``row``, with the main text of its page: ``text``, ``n_blocks``, ``n_content``.

    A block is the text between two borders of block elements: character references
    decoded, white space made one space, a line break a space. Blocks that are content
    come in page order with an empty line between; a page without any, a null and an empty page have
    the empty text. Equal pages have equal texts; other columns play no part. A page is worked on
    whole in the task that reads it, in memory that grows with the longest page.
    """
    bounded_batches(pages.sparkSession)

    def run(some: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in some:
            found = [main_text(page or "", weights) for page in batch]
            yield pd.DataFrame(found, columns=["text", "n_blocks", "n_content"])

    run.__annotations__ = {"some": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    found = F.pandas_udf(run, "text string, n_blocks int, n_content int").asNondeterministic()(html)
    return pages.select(F.struct("*").alias("row"), found.alias("f")).select("row", "f.*")
