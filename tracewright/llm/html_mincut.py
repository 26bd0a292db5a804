"""Main-text extraction from HTML by minimum cut.

A page becomes a row of blocks with simple properties: of their text, of their place, and
the marks of tags and names around them.  A linear classifier turns them into the cost of
calling a block content or boilerplate; these costs are the capacities to the terminals.
Neighbouring blocks are joined by smoothness edges, the stronger the nearer their common
ancestor, and so are blocks that follow one another in one container.  A maximum flow
separates content from boilerplate at least cost.

What text and place weigh is learned with the marks hidden: pages that bear marks tell what
is content, and the classifier has to find it without them.  How strong an edge is comes
from how often such neighbours are of one kind.  A mark weighs much and decides nothing by
itself, and one on an element that holds most of an article is none.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_sample, in_a_task

#: Tags by the HTML standard.  Text inside these is never shown as text.
HIDDEN = frozenset("script style noscript template head iframe object svg math select option button textarea dialog canvas audio video".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILER = frozenset("nav footer aside header menu form".split())
ARTICLE = frozenset("article main".split())
#: Tags that an opening tag of the key closes, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table body article main section div nav aside footer header blockquote td th".split())
#: Names in class, id and role that tell boilerplate, as whole names or as their parts
#: before or after a hyphen or underscore (ad-slot, site_footer, main-nav).
BAD = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices popup modal overlay "
    "menu menus nav navbar navigation subnav topnav breadcrumb breadcrumbs sidebar widget widgets footer contentinfo complementary masthead topbar toolbar "
    "newsletter comment comments commentlist disqus replies pagination pager copyright disclaimer".split()
)
#: These tell boilerplate only as whole names; they are common words inside others.
BAD_ALONE = frozenset("share sharing social related recommended recommendations subscribe signup login respond skip skip-link follow follow-us read-more more-links search-form searchbox legal side foot".split())
#: Names of a site's header, outside articles.
HEADER = frozenset("header site-header page-header top-header main-header global-header web-header".split())
GOOD = frozenset("article articles article-body article-content content main main-content entry entry-content post post-content post-body story prose".split())
_PARTS = re.compile(r"[-_]")


def _bad(name: str) -> int:
    """2 for a name of boilerplate, 1 for one that has such a part or is a common word, else 0."""
    if name in BAD:
        return 2
    return int(name in BAD_ALONE or any(x in BAD for x in _PARTS.split(name)) and not name.endswith(("-content", "-body", "-text")))


#: A tag's attributes: quotes hold only after an equals sign.  Possessive, so it is read once.
_ATTRIBUTES = re.compile(r"(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+|=)*+>")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_SPACE = re.compile(r"\s+")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _attributes(given: str) -> dict[str, str]:
    """Names, in lower case, and values; of equal names the first counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(given):
        out.setdefault(name.lower(), a or b or c)
    return out


def _is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(_NO_DISPLAY.search(attributes.get("style", "")))


@dataclass
class Block:
    text: str
    holder: _Node  # the innermost container
    inside: _Node  # the innermost element
    linked: int  # characters inside links
    heading: bool
    article: bool  # below a tag or name that marks content
    by_tag: bool = False  # below a tag that marks boilerplate
    by_name: bool = False  # below a name that does


class _Node:
    __slots__ = ("tag", "up", "parent", "depth", "article", "hidden", "heading", "tag_mark", "name_mark", "by_tag", "by_name", "chars", "in_article", "holds")

    def __init__(self, tag: str, parent: _Node | None, article: bool = False, hidden: bool = False, heading: bool = False, tag_mark: bool = False, name_mark: int = 0):
        self.tag, self.parent = tag, parent
        self.up = None if parent is None else parent if parent.tag in BLOCK or parent.up is None else parent.up  # the next container outside
        self.depth = self.up.depth + 1 if self.up else 0
        self.article, self.hidden, self.heading, self.tag_mark, self.name_mark = article, hidden, heading, tag_mark, name_mark
        self.by_tag = self.by_name = self.holds = False
        self.chars = self.in_article = 0  # characters of the blocks inside, and of those that are marked as content


class _Open:
    """The open elements, with where each tag, and the last that bounds a search, stands."""

    def __init__(self):
        self.stack, self.where, self.scopes, self.links = [_Node("", None)], {}, [-1], 0
        self.every = list(self.stack)

    def push(self, node: _Node) -> None:
        self.where.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.links += node.tag == "a"
        self.stack.append(node)
        self.every.append(node)

    def pop_to(self, at: int) -> None:
        while len(self.stack) > at:
            node = self.stack.pop()
            self.where[node.tag].pop()
            if self.scopes[-1] == len(self.stack):
                self.scopes.pop()
            self.links -= node.tag == "a"
            above = self.stack[-1]
            above.chars += node.chars
            above.in_article += node.in_article
            above.holds = above.holds or node.holds or node.tag in ARTICLE

    def last(self, tags: Iterable[str]) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of visible text, in order, in one pass over the page.

    A block ends where a block-level element begins or ends; ``br`` is white space
    inside it.  Unclosed elements end with the element that holds them; an unclosed
    comment or tag reaches to the end."""
    open_, found, text, linked, at = _Open(), [], [], 0, 0

    def close() -> None:
        nonlocal linked
        joined = _SPACE.sub(" ", "".join(text)).strip()
        if joined:
            top = open_.stack[-1]
            found.append(Block(joined, top if top.tag in BLOCK or top.up is None else top.up, top, linked, top.heading, top.article))
            top.chars += len(joined)
            top.in_article += len(joined) * top.article
        text.clear()
        linked = 0

    def shown(raw: str) -> None:
        nonlocal linked
        if raw and not open_.stack[-1].hidden:
            decoded = html.unescape(raw) if "&" in raw else raw
            text.append(decoded)
            if open_.links:
                linked += len(decoded.strip())

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            shown(page[at:])
            break
        shown(page[at:start])
        name = _NAME.match(page, start + 1)
        if name is None:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(page)
            elif page.startswith(("<!", "<?"), start):
                end = page.find(">", start)
                at = end + 1 if end >= 0 else len(page)
            else:
                shown("<")
                at = start + 1
            continue
        rest = _ATTRIBUTES.match(page, name.end())
        if rest is None:  # a quote or the tag itself isn't closed
            end = page.find(">", name.end())
            if end < 0:
                break
            given, at = page[name.end() : end], end + 1
        else:
            given, at = page[name.end() : rest.end() - 1], rest.end()
        tag = name[2].lower()
        if name[1]:
            if open_.where.get(tag):
                if tag in BLOCK:
                    close()
                open_.pop_to(open_.where[tag][-1])
            elif tag == "p":
                close()
            continue
        if tag in BLOCK:
            close()
            if tag not in ("html", "body") and open_.last(("p",)) > open_.scopes[-1]:  # a block ends an open paragraph
                open_.pop_to(open_.last(("p",)))
            if (ends := CLOSES.get(tag)) and (last := open_.last(ends)) >= max(0, open_.scopes[-1]):
                open_.pop_to(last)
        elif tag == "br":
            text.append(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            end = _ENDS[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        top, attributes = open_.stack[-1], _attributes(given) if given else {}
        names = " ".join(attributes.get(a, "") for a in ("class", "id", "role")).lower().split() if attributes else ()
        outer = tag in ("html", "body")
        within = top.article or tag in ARTICLE or any(x in GOOD for x in names)
        # a header inside an article holds its title; elsewhere it is the site's
        tag_mark = tag in BOILER and not (tag == "header" and top.article)
        name_mark = 0
        if names and not outer and tag not in ARTICLE:
            name_mark = max(max(_bad(x), int(not top.article and x in HEADER)) for x in names)
        hidden = top.hidden or tag in HIDDEN or bool(attributes and not outer and _is_hidden(attributes))
        open_.push(_Node(tag, top, within, hidden, top.heading or tag in _HEADINGS, tag_mark, name_mark))
    close()
    open_.pop_to(1)
    _mark(open_.every, found)
    return found


def _mark(nodes: list[_Node], blocks: list[Block]) -> None:
    """Hand marks down to blocks, those of wrappers left out.

    An element is a wrapper if it has an article in it and half of what is marked as content
    (or of all text where nothing is), or, with a name that is only like one of
    boilerplate, four fifths."""
    whole = nodes[0]
    for node in nodes[1:]:
        above = node.parent
        node.by_tag, node.by_name = above.by_tag, above.by_name
        if node.tag_mark or node.name_mark:
            part = node.in_article / whole.in_article if whole.in_article else node.chars / max(1, whole.chars)
            most = node.holds and part >= 0.5
            node.by_tag = node.by_tag or (node.tag_mark and not most)
            node.by_name = node.by_name or bool(node.name_mark and not most and (node.name_mark == 2 or part < 0.8))
    for block in blocks:
        block.by_tag, block.by_name = block.inside.by_tag, block.inside.by_name


#: What the features of a block weigh before any page is seen: positive speaks for content.
FEATURES = {"bias": -1.2, "words": 0.9, "stops": 0.5, "linked": -3.0, "heading": 0.6, "share": 2.5, "by_tag": -8.0, "by_name": -8.0, "article": 3.0, "rest": -4.0}
MARKED = ("by_tag", "by_name", "article", "rest")  # those that come from tags and names; they aren't learned
PRIOR = np.array(list(FEATURES.values()))
FAR = 16  # levels that are climbed in search of a common container
NEAR = 4  # levels between neighbours that are told apart
STRONGEST = 1.5  # an edge; three of them outweigh no mark


@dataclass(frozen=True)
class Model:
    """Weights of the features, and of edges: between neighbours by the levels between them, and
    between blocks that follow one another in a container."""

    weights: np.ndarray
    next: tuple[float, ...] = tuple(0.6 / (1 + 0.5 * k) for k in range(NEAR + 1))
    same: float = 0.5


DEFAULT = Model(PRIOR)


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block, in the order of FEATURES."""
    has_article = any(b.article and not (b.by_tag or b.by_name) for b in blocks)
    total = max(1, sum(len(b.text) for b in blocks))
    held: dict[int, int] = {}
    for b in blocks:
        around = id(b.holder.up or b.holder)
        held[around] = held.get(around, 0) + len(b.text)
    return np.array(
        [
            (
                1.0, min(b.text.count(" ") + 1, 40) / 10, b.text[-1] in ".!?:;。…\"'”»)", min(1.0, b.linked / max(1, len(b.text))), b.heading,
                held[id(b.holder.up or b.holder)] / total, b.by_tag, b.by_name, b.article, has_article and not b.article,
            )
            for b in blocks
        ],
        np.float64,
    ).reshape(-1, len(FEATURES))


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Pairs of blocks that are joined: neighbours with the levels between them (at most NEAR), and
    with -1 those that follow one another in one container."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            x, y, steps = b.holder, blocks[i - 1].holder, 0
            while x is not y and steps < FAR:
                if x.depth >= y.depth and x.up is not None:
                    x = x.up
                elif y.up is not None:
                    y = y.up
                else:
                    break
                steps += 1
            edges.append((i - 1, i, min(steps, NEAR)))
        around = id(b.holder.up or b.holder)
        if around in last and last[around] != i - 1:
            edges.append((last[around], i, -1))
        last[around] = i
    return edges


def smoothness(blocks: list[Block], model: Model = DEFAULT) -> list[tuple[int, int, float]]:
    return [(a, b, model.same if k < 0 else model.next[k]) for a, b, k in edges_of(blocks)]


def fit(pages: DataFrame, max_pages: int = 500, id_col: str = "page_id", html_col: str = "html", trust: float = 20.0, rounds: int = 20) -> Model:
    """Weights of text and place by logistic regression around PRIOR, and strengths of edges.

    Pages teach by their own marks: where a page has an article, its blocks are content and
    those outside it, or marked in it, are boilerplate.  The regression sees the blocks
    without these marks.  An edge gets half the log odds that its two blocks are of one
    kind, at most STRONGEST.  One task learns from at most ``max_pages`` pages, drawn by a
    hash of id and page; ``trust`` is how many blocks the prior is worth.  DEFAULT for no
    such page."""
    marked = np.array([name in MARKED for name in FEATURES])

    def learned(sample: pa.Table) -> Model:
        parts, labels = [np.zeros((0, len(FEATURES)))], [np.zeros(0)]
        before = 1 / (1 + np.exp(-2 * np.array([*DEFAULT.next, DEFAULT.same])))
        alike = trust * np.stack([1 - before, before], 1)  # unlike and like, for each kind of edge
        for page in sample.column("html").to_pylist():
            blocks = blocks_of(page or "")
            y = np.array([b.article and not (b.by_tag or b.by_name) for b in blocks], float)
            if not y.any():
                continue
            parts.append(np.where(marked, 0, features(blocks)))
            labels.append(y)
            for a, b, k in edges_of(blocks):
                alike[k, int(y[a] == y[b])] += 1
        x, y, w = np.concatenate(parts), np.concatenate(labels), PRIOR.copy()
        free = ~marked
        for _ in range(rounds if len(x) else 0):
            p = 1 / (1 + np.exp(-np.clip(x[:, free] @ w[free], -30, 30)))
            slope = x[:, free].T @ (p - y) + trust * (w - PRIOR)[free]
            step = np.linalg.solve((x[:, free] * (p * (1 - p))[:, None]).T @ x[:, free] + trust * np.eye(int(free.sum())), slope)
            w[free] -= np.clip(step, -2, 2)
        if not len(x):
            return DEFAULT
        odds = np.clip(np.log(alike[:, 1] / alike[:, 0]) / 2, 0, STRONGEST)
        return Model(w, tuple(float(o) for o in odds[: NEAR + 1]), float(odds[-1]))

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).where("html is not null")
    found = in_a_task(bounded_sample(rows, rows.count(), max_pages, "page_id", "html"), learned)
    return DEFAULT if found is None else found


def minimum_cut(n: int, source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which of ``n`` nodes stay with the source in a minimum cut (Dinic's algorithm).

    Terminal capacities are reduced first, so a node gets an edge to one of them only."""
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    left: list[float] = []

    def join(u: int, v: int, there: float, back: float) -> None:
        graph[u].append(len(to))
        to.append(v)
        left.append(there)
        graph[v].append(len(to))
        to.append(u)
        left.append(back)

    for i in range(n):
        if (gain := source[i] - sink[i]) > 0:
            join(s, i, gain, 0.0)
        elif gain < 0:
            join(i, t, -gain, 0.0)
    for u, v, c in edges:
        join(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if left[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        following = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                push = min(left[e] for e in path)
                for e in path:
                    left[e] -= push
                    left[e ^ 1] += push
                cut_at = next(i for i, e in enumerate(path) if left[e] <= 1e-9)
                u = to[path[cut_at] ^ 1]
                del path[cut_at:]
                continue
            while following[u] < len(graph[u]):
                e = graph[u][following[u]]
                if left[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                following[u] += 1
            if following[u] < len(graph[u]):
                path.append(graph[u][following[u]])
                u = to[path[-1]]
            elif not path:
                break
            else:
                e = path.pop()
                u = to[e ^ 1]
                following[u] += 1


def kept(blocks: list[Block], model: Model = DEFAULT) -> list[bool]:
    """Which blocks are on the content side of the cut."""
    scores = (features(blocks) @ model.weights).tolist()
    return minimum_cut(len(blocks), [max(x, 0.0) for x in scores], [max(-x, 0.0) for x in scores], smoothness(blocks, model))


def main_text(page: str, model: Model = DEFAULT) -> str:
    """The blocks on the content side of the cut, joined by two line feeds."""
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, k in zip(blocks, kept(blocks, model), strict=True) if k) if blocks else ""


def extract(pages: DataFrame, model: Model = DEFAULT, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row; null and empty pages give empty text.

    One page is one task's work at a time; repeated rows are extracted each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.decode("utf-8", "replace"), model) for x in as_bytes(batch.column("html"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
