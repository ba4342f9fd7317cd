"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every block element of a page is a node with a hidden label: article or not. The model has a
potential for each node, from its tag, the words of its class, id and role, its own text
and links, and one for each parent and child, by the kind of the child. Sum-product messages go
from the leaves to the root and back, which gives each node's exact marginal in two passes;
the text of nodes with a marginal of 0.5 is the result. Weights maximise the likelihood of labelled
pages (html_pages), with the same messages giving the expectations.

A block is the text between two borders of block elements; it belongs to the innermost block
element around it. Scripts, styles and comments in the markup are no text; character
references are decoded; white space inside a block becomes one space. Blocks are joined in page order by an empty
line. Nothing else is dropped or shortened.

The work is a map over rows with one page in memory, in time linear in the page; the model is a few hundred numbers.

Cases: a null or empty page, and one without an article, has empty text. Unclosed, stray and
misnested tags follow the usual rules for paragraphs, list items and table cells. A tag with a quote that isn't
closed ends at its next '>'. Repeated rows
are treated each for itself; other columns pass through where the caller keeps them.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.html_pages import labelled_pages

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",  # a quote that isn't closed
    re.S,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")

# Fixed values of HTML: elements without content, those whose content is no text, block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object canvas textarea select".split())
BLOCK = frozenset(
    "html head title body main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
    "blockquote pre table thead tbody tfoot tr td th caption form fieldset label button figure figcaption address "
    "details summary dialog hr center option".split()
)
CLOSES_P = BLOCK - {"label", "button", "html", "head", "body", "title", "option", "td", "th", "tr", "caption"}
#: A paragraph outside the innermost of these stays open.
P_BORDERS = ("td", "th", "li", "div", "article", "section", "table")
#: An opening tag ends an open element of these, looked for up to the given borders.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head", "title"}, {"html"}),
}

#: Words in class, id and role, by what they tell.
HINTS = {
    "advert": "ad ads advert adverts advertisement sponsored sponsor promo promotion banner".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topnav subnav pagination pager toc".split(),
    "comment": "comment comments disqus responses replies reply discussion respond".split(),
    "side": "sidebar side aside related widget recommended trending popular more right rail complementary".split(),
    "foot": "footer bottom copyright contentinfo colophon".split(),
    "head": "header masthead top logo banner".split(),
    "notice": "cookie cookies notice alert consent gdpr popup modal newsletter subscribe subscription paywall overlay".split(),
    "share": "share sharing social tags tag buttons follow meta byline".split(),
    "form": "search login signup contact form signin".split(),
    "article": "article content post entry story text body main blog page".split(),
    "frame": "wrap wrapper container row col column layout grid".split(),
}
_HINT_OF: dict[str, list[str]] = {}
for _hint, _list in HINTS.items():
    for _word in _list:
        _HINT_OF.setdefault(_word, []).append(_hint)

_KIND = (
    {t: "main" for t in ("article", "main")} | {t: "area" for t in ("section", "div")}
    | {t: "aside" for t in ("nav", "header", "footer", "aside", "form")} | {"body": "root", "html": "root"}
)


class Page:
    """Nodes in page order (parents first) and blocks as (node, text)."""

    def __init__(self, source: str):
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.hints: list[tuple[str, ...]] = []
        self.label: list[int] = []
        self.linked: list[int] = []
        self.blocks: list[tuple[int, str]] = []
        self.length: list[int] = []
        self._parse(source)

    def _add(self, tag: str, attrs: str, parent: int) -> int:
        hints, label = [], -1
        if "=" in attrs:
            for name, a, b, c in _ATTR.findall(attrs):
                value = a or b or c
                if name.lower() == "data-y":
                    label = int(value)
                else:
                    for word in _NAME.findall(value.lower()):
                        hints += _HINT_OF.get(word, ())
        self.parent.append(parent)
        self.tag.append(tag)
        self.hints.append(tuple(sorted(set(hints))))
        self.label.append(label)
        self.linked.append(0)
        self.length.append(0)
        return len(self.tag) - 1

    def _parse(self, source: str) -> None:
        root = self._add("html", "", -1)
        stack: list[tuple[str, int]] = [("html", root)]  # every open element with its block node
        where: dict[str, list[int]] = {}  # places of open elements by tag, so nothing searches the stack
        blocks: list[int] = []
        texts: list[str] = []
        node = root
        anchors = where.setdefault("a", [])
        lower = None

        def last(tags) -> int:
            return max((where[t][-1] for t in tags if where.get(t)), default=0)

        def cut(k: int) -> None:
            while len(stack) > k:
                where[stack[-1][0]].pop()
                if stack.pop()[0] in BLOCK:
                    blocks.pop()

        def flush() -> None:
            if texts:
                text = " ".join(html.unescape("".join(texts)).split())
                texts.clear()
                if text:
                    self.blocks.append((node, text))
                    self.length[node] += len(text)

        at = 0
        for m in _MARKUP.finditer(source):
            a = m.start()
            if a < at:
                continue
            if a > at:
                texts.append(source[at:a])
                if anchors:
                    self.linked[node] += a - at
            at = m.end()
            closes, tag, attrs = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
            if not tag:
                continue
            tag = tag.lower()
            if closes:
                k = last((tag,))
                if k and (tag in BLOCK or not blocks or blocks[-1] < k):  # an inline end tag closes nothing outside its block
                    if blocks and blocks[-1] >= k:
                        flush()
                    cut(k)
                    node = stack[-1][1]
                continue
            if tag in RAW:
                if not attrs.endswith("/"):
                    if lower is None:
                        lower = source.lower()
                    end = lower.find("</" + tag, at)
                    at = len(source) if end < 0 else end
                texts.append(" ")
                continue
            if tag in VOID:
                texts.append(" ")
                if tag == "hr":
                    flush()
                continue
            if tag == "html":
                continue
            if tag in BLOCK:
                flush()
                if tag in CLOSES_P and (k := last(("p",))) > last(P_BORDERS if tag != "p" else ()):
                    cut(k)
                if tag in ENDS and (k := last(ENDS[tag][0])) > last(ENDS[tag][1]):
                    cut(k)
                node = self._add(tag, attrs, stack[-1][1])
                blocks.append(len(stack))
            where.setdefault(tag, []).append(len(stack))
            stack.append((tag, node))
        if at < len(source):
            texts.append(source[at:])
        flush()

    def features(self) -> list[list[str]]:
        children = [0] * len(self.tag)
        for p in self.parent[1:]:
            children[p] += 1
        out = []
        for tag, hints, n, linked, kids, up in zip(self.tag, self.hints, self.length, self.linked, children, self.parent):
            f = ["bias", "t:" + tag, f"u:{self.tag[up] if up >= 0 else ''}>{tag}"]
            f += ["h:" + h for h in hints]
            if not hints:
                f.append("h:-" + tag)
            if n:
                f.append(f"n:{min(4, int(math.log(n + 1, 4)))}")
                f.append(f"l:{min(3, 4 * linked // n)}")
            else:
                f.append("n:-" if kids else "n:0")
            out.append(f)
        return out

    def kinds(self) -> list[str]:
        """The kind of each node as a child."""
        return [_KIND.get(t, "text") + ("+" if h else "") for t, h in zip(self.tag, self.hints)]


def messages(parent: list[int], node: list[float], edge: list[tuple[float, float, float, float]]) -> tuple[list[float], list[float], list[float]]:
    """Sum-product on a tree with two labels, parents before children.

    node: log-odds of label 1 from the node's own potential; edge: log-potentials
    (00, 01, 10, 11) of (parent, child). Returns the log-odds of the marginals, each node's upward
    belief (own and from below) and each node's message to its parent.
    """
    n = len(parent)
    up = list(node)
    sent = [0.0] * n
    for k in range(n - 1, 0, -1):
        r = up[k]
        s00, s01, s10, s11 = edge[k]
        sent[k] = _lse(s10, r + s11) - _lse(s00, r + s01)
        up[parent[k]] += sent[k]
    odds = list(up)
    for k in range(1, n):
        r = odds[parent[k]] - sent[k]
        s00, s01, s10, s11 = edge[k]
        odds[k] = up[k] + _lse(s01, r + s11) - _lse(s00, r + s10)
    return odds, up, sent


def _lse(a: float, b: float) -> float:
    if a > b:
        return a + math.log1p(math.exp(b - a))
    return b + math.log1p(math.exp(a - b))


class Model:
    def __init__(self, weights: dict[str, float], edges: dict[str, tuple[float, float, float, float]]):
        self.weights, self.edges = weights, edges

    def odds(self, page: Page) -> list[float]:
        get = self.weights.get
        node = [sum(get(f, 0.0) for f in fs) for fs in page.features()]
        none = (0.0, 0.0, 0.0, 0.0)
        return messages(page.parent, node, [self.edges.get(k, none) for k in page.kinds()])[0]

    def extract(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        odds = self.odds(page)
        return "\n\n".join(text for node, text in page.blocks if odds[node] >= 0)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def fit(sources: list[str], rounds: int = 60) -> Model:
    """Maximum likelihood on pages whose elements carry data-y, by adaptive gradient steps.

    The root has label 0. Elements without a label have their parent's.
    """
    data = []
    for source in sources:
        page = Page(source)
        labels = list(page.label)
        labels[0] = 0
        for k in range(1, len(labels)):
            if labels[k] < 0:
                labels[k] = labels[page.parent[k]]
        data.append((page.parent, labels, page.features(), page.kinds()))
    weights: dict[str, float] = {}
    edges: dict[str, list[float]] = {}
    for _, _, features, kinds in data:
        for fs, kind in zip(features, kinds):
            for f in fs:
                weights.setdefault(f, 0.0)
            edges.setdefault(kind, [0.0] * 4)
    seen_w = {f: 1e-6 for f in weights}
    seen_e = {k: [1e-6] * 4 for k in edges}
    for _ in range(rounds):
        grad_w = {f: -0.02 * w for f, w in weights.items()}
        grad_e = {k: [-0.02 * w for w in e] for k, e in edges.items()}
        for parent, labels, features, kinds in data:
            node = [sum(weights[f] for f in fs) for fs in features]
            edge = [tuple(edges[k]) for k in kinds]
            odds, up, sent = messages(parent, node, edge)
            for k, fs in enumerate(features):
                miss = labels[k] - _sigmoid(odds[k])
                if abs(miss) > 1e-4:
                    for f in fs:
                        grad_w[f] += miss
                if k:
                    r = odds[parent[k]] - sent[k]
                    logs = [x + y for x, y in zip(edge[k], (0.0, up[k], r, r + up[k]))]
                    most = max(logs)
                    e = [math.exp(x - most) for x in logs]
                    total = sum(e)
                    g = grad_e[kinds[k]]
                    for j in range(4):
                        g[j] -= e[j] / total
                    g[2 * labels[parent[k]] + labels[k]] += 1
        for f, g in grad_w.items():
            seen_w[f] += g * g
            weights[f] += 0.5 * g / math.sqrt(seen_w[f])
        for kind, gs in grad_e.items():
            for j, g in enumerate(gs):
                seen_e[kind][j] += g * g
                edges[kind][j] += 0.5 * g / math.sqrt(seen_e[kind][j])
    return Model(weights, {k: tuple(e) for k, e in edges.items()})


@functools.lru_cache(maxsize=4)
def default_model(pages: int = 400, seed: int = 1) -> Model:
    """The model of `pages` seeded labelled pages."""
    return fit(labelled_pages(pages, seed))


def _extracted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            texts = [model.extract(t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages`."""
    model = model or default_model()
    return pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")
    ).mapInArrow(lambda it: _extracted(it, model), "page_id long, url string, text string, n_chars long")
