"""Main text of web pages by minimum-cut labelling.

A page's text blocks are the nodes of a graph. A classifier gives each block a cost of being content and one of
being boilerplate; they are its edges to sink and source. It adds up a logistic regression over what can be
measured of the block (length, share of link text, punctuation, legal words, kind of element, place in the page),
bounded to 3 either way, and the evidence of the elements around it: their tags, roles and, where a class or id is
nothing but words for boilerplate, their names. Content is claimed by the strongest element alone and boilerplate by
all together, so an advert or a sidebar goes wherever in an article it stands. The regression is fitted on the blocks
of a bounded sample of the pages (SAMPLE_PAGES by hash, of up to PAGE_BLOCKS blocks each), labelled by the elements
that HTML has for the purpose (article and main against nav, aside, footer and form); the elements themselves are no
features of it, so it carries over to pages without them. Neighbours in page order and blocks that share their parent
are joined by smoothness edges, the stronger the more of their ancestors they share and the less the evidence around
them differs. Their scale is fitted too: on a half of the sample that the costs were not fitted on, read as if all its
elements were div, the scale with the fewest wrong labels is taken. The maximum flow separates content (source side)
from boilerplate: a doubtful block goes with those around it.

Scripts, styles and other markup never become blocks. Character references are decoded, white space in a
block becomes one blank, blocks are joined by one line break.

Nulls and edge cases: a null, empty or wordless page has an empty text; broken and cut-off markup is read
as far as it goes; a page without any block on the source side has an empty text; pages are judged one by
one, so repeated rows and ids change nothing; an empty table gives an empty result. Nothing is cut: a page is read in
one pass and may be as long and as deep as memory allows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their whole content is markup.
RAW = frozenset("script style noscript template textarea iframe noembed noframes xmp svg math object canvas audio video select button head datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Opening one of these ends an open p.
ENDS_P = BLOCKS - frozenset("body html head option optgroup caption legend summary".split())
#: Opening the first ends the open second, up to the container.
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr",)), "th": ("th", ("tr",)), "option": ("option", ("select",))}

# Evidence of the elements around a block: positive for content. What a block measures adds 3 at most.
TAG_WEIGHT = {"article": 3.5, "main": 2.5, "nav": -9.0, "footer": -9.0, "aside": -9.0, "header": -4.0, "form": -9.0, "menu": -9.0, "dialog": -9.0, "title": -9.0, "search": -9.0, "fieldset": -6.0}
ROLE_WEIGHT = {"main": 2.5, "article": 3.5, "navigation": -9.0, "banner": -6.0, "contentinfo": -9.0, "complementary": -9.0, "search": -9.0, "form": -9.0, "dialog": -9.0, "alert": -9.0, "alertdialog": -9.0, "menu": -9.0, "menubar": -9.0, "note": -1.0}
#: Words for boilerplate, and words that say nothing beside them. A name counts if it is made of these alone, so
#: neither has-sidebar nor article-form nor no-comments does; words for content beside them only say whose part it
#: is (comment-body, article-share), but an article's own header or banner holds its title.
BOILERPLATE = frozenset(
    "ad ads promo promos advert adverts advertisement advertisements advertising sponsor sponsors banner banners nav navbar navigation menu menus menubar breadcrumb breadcrumbs sidebar aside footer header masthead topbar comment comments disqus replies respond cookie cookies consent gdpr notice notices alert alerts popup popups modal modals overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations trending widget widgets toolbar pagination pager search copyright disclaimer paywall subnav topnav".split()
)
BESIDE = frozenset("site page main primary secondary left right top bottom upper lower global mobile desktop user reader readers area box block bar container wrapper wrap section list item items inner outer group panel slot unit content text links link buttons icons form thread message policy posts articles stories".split())
CONTENT = frozenset("article content post entry story body".split())
_NAME_BAD, _NAME_GOOD = -9.0, 0.5
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PART = re.compile(r"[^a-z]+")
#: Elements that label the blocks in them for the regression.
LABELS = {"article": 1, "main": 1, "nav": 0, "aside": 0, "footer": 0, "form": 0, "menu": 0}
SAMPLE_PAGES, PAGE_BLOCKS = 1000, 500
FEATURES = ("one", "length", "linked", "ends", "marks", "paragraph", "heading", "item", "place", "digits", "legal")
#: The regression where no page of the sample labels both kinds.
PLAIN = (-0.5, 1.0, -4.0, 1.0, 0.5, 1.0, 1.0, -0.5, 0.0, 0.0, -3.0)
#: Edges of neighbours in one element or in two of one parent, of other neighbours, and of a block and the one
#: before it under the same parent: what they are where nothing was fitted, and what is tried.
EDGES = (2.0, 0.4, 0.2)
TRIED = ((0.0, 0.25, 0.5, 1.0, 2.0, 4.0), (0.0, 0.1, 0.4, 1.0), (0.0, 0.2, 0.5))
#: How fast edges fade with a difference of evidence.
CONTRAST = 2.0

#: A quoted value begins after =; one that nothing ends goes to the end of the page, as browsers read it. Every
#: beginning of a tag is the beginning of a match, so a page is read once.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|[^>])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_ENDS = re.compile(r"[.!?;:…。！？]")
#: How notices of rights speak.
_LEGAL = re.compile(r"©|\(c\) ?[0-9]{4}|\bcopyright\b|\ball rights reserved\b|\balle rechte vorbehalten\b|\btous droits réservés\b|\btodos los derechos reservados\b|\bprivacy policy\b|\bterms of (?:use|service)\b", re.I)


class Node:
    """An open element: its tag, depth, and the evidence of itself and its ancestors: the best of what speaks for content, all that speaks against."""

    __slots__ = ("tag", "up", "depth", "good", "bad", "hidden", "link", "block", "label", "article")

    def __init__(self, tag: str, up: "Node | None", own: float = 0.0, hidden: bool = False):
        self.tag, self.up = tag, up
        self.depth = up.depth + 1 if up else 0
        self.good = max(up.good if up else 0.0, own)
        self.bad = (up.bad if up else 0.0) + min(own, 0.0)
        self.hidden = hidden or bool(up and up.hidden)
        self.link = tag == "a" or bool(up and up.link)
        self.block = self if tag in BLOCKS or not up else up.block
        self.label = LABELS.get(tag, up.label if up else None)
        self.article = tag == "article" or bool(up and up.article)

    @property
    def evidence(self) -> float:
        return self.good + self.bad


class Block:
    """near: the depth of what it shares with the block before it."""

    __slots__ = ("parent", "text", "linked", "near")

    def __init__(self, parent: Node, text: str, linked: int, near: int):
        self.parent, self.text, self.linked, self.near = parent, text, linked, near


def name_evidence(value: str) -> float:
    """What a class or id says: its names are told apart by white space, and their words by anything else."""
    best = 0.0
    for name in value.split():
        words = [w for w in _PART.split(_CAMEL.sub("-", name).lower()) if w]
        own = any(w in CONTENT for w in words)
        said = [w for w in words if w in BOILERPLATE and not (own and w in ("header", "masthead", "banner"))]
        if said and all(w in BOILERPLATE or w in BESIDE or w in CONTENT for w in words):
            return _NAME_BAD
        if own:
            best = _NAME_GOOD
    return best


def own_evidence(tag: str, attrs: str) -> tuple[float, bool]:
    """What an element says of its content; whether it is hidden."""
    w, hidden = TAG_WEIGHT.get(tag, 0.0), False
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                if tag not in ("html", "body"):
                    w += name_evidence(value)
            elif name == "role":
                w += ROLE_WEIGHT.get(value.lower(), 0.0)
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = True
    return w, hidden


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in page order."""
    root = Node("", None)
    here = root
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    at, end = 0, len(page)
    low = 0  # the least depth since the last block
    opened: Counter[str] = Counter()

    def leave(node: Node) -> None:
        """node and what is in it are closed."""
        nonlocal here, low
        while here is not node.up:
            opened[here.tag] -= 1
            here = here.up
        low = min(low, here.depth)

    def flush() -> None:
        nonlocal linked, low
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text and not here.hidden:
                out.append(Block(here.block, text, linked, min(low, here.block.depth)))
                low = here.block.depth
            parts.clear()
        linked = 0

    def close(tag: str, stops: frozenset | tuple = ()) -> bool:
        if not opened[tag]:
            return False
        node = here
        while node.tag != tag:
            if node.tag in stops:
                return False
            node = node.up
        flush()
        leave(node)
        return True

    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            said = page[at:stop]
            parts.append(said)
            if here.link:
                linked += len(said.strip())
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS:
                if tag != "p" or not close("p", ("article", "div", "section", "td", "li")):
                    if tag != "p":
                        close(tag)
            elif tag not in VOID:
                # inline: only the element itself is closed, its text goes on
                node = here
                while node.up and node.tag != tag and node.tag not in BLOCKS:
                    node = node.up
                if node.tag == tag and node.up:
                    leave(node)
            continue
        if tag in RAW:
            # up to its end tag, or to the end of a page that was cut off
            ends = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            if tag == "head":
                body = re.compile(r"<body(?=[\s/>])", re.I).search(page, at)
                at = min(ends.end() if ends else end, body.start() if body else end)
                if not ends and not body:
                    at = end
            else:
                at = ends.end() if ends else end
            continue
        if tag in ("br", "hr"):
            parts.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS:
            flush()
            if tag in ENDS_P:
                close("p", ("article", "section", "div", "td", "li", "blockquote"))
            if tag in SIBLINGS:
                same, limits = SIBLINGS[tag]
                close(same, limits) or (same != tag and close(tag, limits))
        w, hidden = own_evidence(tag, m[3])
        if tag == "header" and here.article:
            w = 0.0  # an article's own head holds its title
        here = Node(tag, here, w, hidden)
        opened[tag] += 1
    flush()
    return out


def features(b: Block, place: float) -> list[float]:
    """What the regression reads of a block, in the order of FEATURES; place is 0 to 1."""
    n, tag = len(b.text), b.parent.tag
    return [
        1.0, math.log1p(n) / 5, min(1.0, b.linked / max(n, 1)), float(b.text[-1] in ".!?:;…。！？"), min(1.0, len(_ENDS.findall(b.text)) / 5),
        float(tag in ("p", "pre", "blockquote")), float(tag in HEADINGS), float(tag in ("li", "td", "dd", "dt", "th")), place, sum(map(str.isdigit, b.text)) / max(n, 1),
        float(n < 400 and _LEGAL.search(b.text) is not None),
    ]


def costs(rows: np.ndarray, weights: tuple) -> np.ndarray:
    """The regression of rows of FEATURES, bounded."""
    return np.clip(rows @ np.array(weights), -3.0, 3.0)


def measured(blocks: list[Block]) -> np.ndarray:
    last = max(len(blocks) - 1, 1)
    return np.array([features(b, i / last) for i, b in enumerate(blocks)])


def evidence(blocks: list[Block], weights: tuple = PLAIN) -> list[float]:
    """The classifier: log-odds that each block is content."""
    return [c + b.parent.evidence - 0.05 for c, b in zip(costs(measured(blocks), weights).tolist(), blocks)]


def blinded(rows: np.ndarray) -> np.ndarray:
    """Rows of FEATURES as if all elements were div."""
    out = rows.copy()
    out[:, [FEATURES.index(f) for f in ("paragraph", "heading", "item")]] = 0
    return out


def fitted(y: np.ndarray, x: np.ndarray) -> tuple:
    """The regression of labels over rows of FEATURES, by Newton steps with a ridge. Each row is also read as if
    the page were of div elements only, so that the kind of element doesn't hide what the rest tells."""
    y, x = np.concatenate([y, y]), np.concatenate([x, blinded(x)])
    if not 0 < y.mean() < 1:
        return PLAIN
    # both kinds weigh the same
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (weight * (p - y)) + 1e-3 * w
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), grad)
    return tuple(w.tolist())


def links(blocks: list[Block]) -> list[tuple[int, int, int, float]]:
    """(block, block, which of EDGES, share of it): neighbours in page order, and a block and the one before it under the same container."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        fades = lambda a: math.exp(-abs(a.parent.evidence - b.parent.evidence) / CONTRAST)  # noqa: B023, E731
        if i:
            a = blocks[i - 1]
            if a.parent is b.parent or a.parent.up is b.parent.up:
                out.append((i - 1, i, 0, fades(a)))
            else:
                out.append((i - 1, i, 1, fades(a) * b.near / max(a.parent.depth, b.parent.depth, 1)))
        box = b.parent.up or b.parent
        j = last.get(id(box))
        if j is not None and j != i - 1:
            out.append((j, i, 2, fades(blocks[j])))
        last[id(box)] = i
    return out


def smooth_edges(blocks: list[Block], scale: tuple = EDGES) -> list[tuple[int, int, float]]:
    return [(a, b, scale[k] * share) for a, b, k, share in links(blocks)]


def fitted_edges(pages: list[tuple[np.ndarray, np.ndarray, list]], weights: tuple) -> tuple:
    """The scale of EDGES with the fewest wrong labels on pages of (labels, features, links), read as pages of div: one
    kind of edge after the other, twice. EDGES stay where nothing is better; without edges the cut would be the
    classifier, so it is never worse than that here."""
    read = [(y, (costs(blinded(x), weights) - 0.05).tolist(), edges) for y, x, edges in pages]

    def wrong(scale: tuple) -> int:
        n = 0
        for y, cost, edges in read:
            side = min_cut(cost, [(int(a), int(b), scale[int(k)] * share) for a, b, k, share in edges if scale[int(k)] > 0])
            n += int((np.array(side)[y >= 0] != (y[y >= 0] == 1)).sum())
        return n

    best, least = EDGES, wrong(EDGES)
    if (alone := wrong((0.0, 0.0, 0.0))) < least:
        best, least = (0.0, 0.0, 0.0), alone
    for _ in range(2):
        for k, values in enumerate(TRIED):
            for v in values:
                scale = (*best[:k], v, *best[k + 1 :])
                if scale != best and (n := wrong(scale)) < least:
                    best, least = scale, n
    return best


def min_cut(weight: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of a minimum cut: a node with weight w > 0 costs w on the sink side, else -w on the source side.

    Augmenting paths by breadth-first levels (Dinic); only nodes that an edge could turn take part.
    """
    n = len(weight)
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b, c in edges:
        out[a].append(len(to)), to.append(b), cap.append(c)
        out[b].append(len(to)), to.append(a), cap.append(c)
    left = [max(w, 0.0) for w in weight]  # what the source can still send
    room = [max(-w, 0.0) for w in weight]  # what the sink can still take
    eps = 1e-9
    while True:
        level = [-1] * n
        queue = deque()
        for i in range(n):
            if left[i] > eps:
                level[i] = 0
                queue.append(i)
        found = False
        while queue:
            u = queue.popleft()
            if room[u] > eps:
                found = True
            for e in out[u]:
                v = to[e]
                if cap[e] > eps and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        if not found:
            return [x >= 0 for x in level]
        nxt = [0] * n
        for s in range(n):
            while left[s] > eps and level[s] == 0:
                # a path from s to a node with room, along rising levels
                path, u = [], s
                while room[u] <= eps:
                    k, row = nxt[u], out[u]
                    while k < len(row) and not (cap[row[k]] > eps and level[to[row[k]]] == level[u] + 1):
                        k += 1
                    nxt[u] = k
                    if k < len(row):
                        path.append(row[k])
                        u = to[row[k]]
                    elif path:
                        e = path.pop()
                        u = to[e ^ 1]
                        nxt[u] += 1
                    else:
                        u = -1
                        break
                if u < 0:
                    break
                push = min([left[s], room[u], *[cap[e] for e in path]])
                left[s] -= push
                room[u] -= push
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push


def extract(page: str | None, weights: tuple = PLAIN, scale: tuple = EDGES) -> str:
    """The main text of one page."""
    if not page:
        return ""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    content = min_cut(evidence(blocks, weights), smooth_edges(blocks, scale))
    return "\n".join(b.text for b, keep in zip(blocks, content) if keep)


def learn(pages: DataFrame, source: str = "html") -> tuple[tuple, tuple]:
    """The regression's weights and the edges' scale, fitted on a bounded sample of the pages."""
    page = pages.select(F.col(source).alias("t"), F.xxhash64(source).alias("h")).where(F.col(source).isNotNull())
    most = page.select("h").orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h")).first()[0]
    if most is None:
        return PLAIN, EDGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, x in zip(batch.column(1).to_pylist(), batch.column(0)):
                blocks = blocks_of(x.as_py())
                labels = [-1.0 if b.parent.label is None else float(b.parent.label) for b in blocks]
                if not 1 < len(blocks) <= PAGE_BLOCKS or max(labels) < 0:
                    continue
                for b in blocks:  # links as of a page of div elements: nothing around a block says what it is
                    b.parent.good = b.parent.bad = 0.0
                edges = [[float(v) for v in e] for e in links(blocks)]
                yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([labels]), pa.array([measured(blocks).ravel().tolist()]), pa.array([[v for e in edges for v in e]], pa.list_(pa.float64()))], names=["h", "y", "x", "e"])

    # the sample is the least by hash, so the same in every run, whatever the copies of a page
    rows = page.where(F.col("h") <= most).select("t", "h").mapInArrow(run, "h long, y array<double>, x array<double>, e array<double>").orderBy("h").limit(SAMPLE_PAGES).collect()
    if not rows:
        return PLAIN, EDGES
    read = [(np.array(r.y), np.array(r.x).reshape(len(r.y), -1), np.array(r.e).reshape(-1, 4).tolist()) for r in rows]

    def regression(part: list) -> tuple:
        y, x = np.concatenate([y for y, _, _ in part]), np.concatenate([x for _, x, _ in part])
        return fitted(y[y >= 0], x[y >= 0])

    return regression(read), fitted_edges(read[1::2][:200], regression(read[::2])) if len(read) > 1 else EDGES


def extracted(pages: DataFrame, keep: Iterable[str] = ("page_id", "url"), source: str = "html", model: tuple | None = None) -> DataFrame:
    """The kept columns, text and n_chars (kept columns of these names fail). Map-only, after the model (see learn) is fitted."""
    keep = list(keep)
    if {"text", "n_chars"} & set(keep):
        raise ValueError("text and n_chars are what the extraction adds; keep such columns under other names")
    weights, scale = model or learn(pages, source)
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            for at in range(0, len(column), 500):
                texts = [extract(x.as_py(), weights, scale) for x in column.slice(at, 500)]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(at, 500) for i in range(len(keep))] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(source).alias("__html")).mapInArrow(run, schema)


def op10(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.shared import table

    return extracted(table(spark, sf_dir, "pages"))
