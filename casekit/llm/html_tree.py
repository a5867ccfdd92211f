"""Main text of web pages by a tree-structured graphical model over DOM nodes."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from . import html_pages as pages
from ._common import bound_batches, drop_worker_caches, free_name

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/)?(?P<tag>[A-Za-z][^\s/>]*)(?P<attr>(?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|=|["'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role|data-y|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe"}
_CLOSING = {tag: re.compile(rf"</{tag}(?:[\s/][^>]*)?(?:>|\Z)", re.I) for tag in _RAW}
#: Those that run to the page's end where they are not closed; of the others only the tag goes.
_TO_THE_END = {"script", "style"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "dfn", "em", "font", "i", "kbd", "mark", "meter", "nobr", "output", "progress", "q", "rp", "rt", "ruby", "s", "samp", "slot", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "picture"}
#: Embedded content, formulas and drawings, whose text is part of the block around them.
_INLINE |= {"audio", "canvas", "math", "object", "svg", "video"}
_INLINE |= {"annotation", "annotation-xml", "maction", "menclose", "merror", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "none", "semantics"}
_INLINE |= {"animate", "circle", "clippath", "defs", "desc", "ellipse", "filter", "foreignobject", "g", "image", "line", "lineargradient", "marker", "mask", "metadata", "path", "pattern", "polygon", "polyline", "radialgradient", "rect", "stop", "symbol", "text", "textpath", "tspan", "use"}
#: Elements that bound blocks, and those of them that may stand in a paragraph. Any other name (``ins``, ``del``,
#: names of a page's own) is a block or not by where it stands.
_BLOCK = set("address article aside blockquote body button caption center colgroup datalist dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html label legend li listing main menu nav noframes ol optgroup option p plaintext pre search section select summary table tbody td tfoot th thead tr ul xmp".split())
_CONTROLS = {"button", "datalist", "label", "optgroup", "option", "select"}
_HOLDS_TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "pre", "caption", "figcaption", "summary", "legend", "label", "button", "option"}
_BOUND = re.compile(rf"(?:\s+|<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z))*+(?:\Z|</?(?:{'|'.join(sorted(_BLOCK))})[\s/>])", re.I | re.S)
_ANY_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)[^>]*>?")
#: Start tags that end an open element of the first set, within the second.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_SKIP = {"head"}
_SPACE_TAGS = {"br", "hr"}


@dataclass
class Node:
    tag: str
    attr: str
    parent: int
    kids: list[int] = field(default_factory=list)
    chars: int = 0
    linked: int = 0


class _Ahead:
    """Whether an element that is neither known as a block nor as inline holds blocks, or
    stands between bounds of blocks. One pass over a page, made when it is first asked."""

    def __init__(self, source: str):
        self.source = source
        self.ends: dict[str, list[tuple[int, int]]] | None = None
        self.blocks: list[int] = []

    def block(self, tag: str, at: int) -> bool:
        if self.ends is None:
            self.ends = {}
            for m in _ANY_TAG.finditer(self.source):
                name = m[2].lower()
                if m[1]:
                    self.ends.setdefault(name, []).append((m.start(), m.end()))
                elif name in _BLOCK:
                    self.blocks.append(m.start())
        ends = self.ends.get(tag, [])
        k = bisect_left(ends, (at, 0))
        if k == len(ends):
            return False
        inner = bisect_left(self.blocks, at)
        return inner < len(self.blocks) and self.blocks[inner] < ends[k][0] or _BOUND.match(self.source, ends[k][1]) is not None


def parse(source: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes of a page (the first is the root; parents precede children), and its
    blocks (node, text) in page order: text between the bounds of block elements.

    Comments, declarations, scripts, styles and the other elements of ``_RAW`` are left
    out; inline elements, formulas and embedded content are part of their block. Elements
    of other names, ``ins`` and ``del`` are inline beside text and in what holds text; they
    are nodes where they hold blocks or stand alone between blocks. Character references
    are decoded, white space becomes one space, and empty blocks are dropped. Unclosed and
    stray tags are taken as browsers do in the common cases; any input is parsed.
    """
    nodes = [Node("#root", "", -1)]
    blocks: list[tuple[int, str]] = []
    stack, bits = [0], []
    links = text_links = 0
    at, end = 0, len(source)
    search = _TOKEN.search
    ahead = _Ahead(source)
    #: For each open element of another name, whether it is a node.
    other: dict[str, list[bool]] = {}

    def close_block() -> None:
        nonlocal bits, text_links
        if bits:
            text = " ".join(html.unescape("".join(bits)).split())
            if text:
                node = nodes[stack[-1]]
                node.chars += len(text)
                node.linked += min(text_links, len(text))
                blocks.append((stack[-1], text))
            bits = []
        text_links = 0

    while at < end:
        m = search(source, at)
        begin = m.start() if m else end
        if begin > at:
            piece = source[at:begin]
            bits.append(piece)
            if links:
                text_links += len(piece)
        if m is None:
            break
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "a":
                links = 0 if m["end"] else 1
            continue
        if tag in _VOID:
            if tag in _SPACE_TAGS:
                bits.append(" ")
            if tag == "hr":
                close_block()
            continue
        if tag in _RAW or tag in _SKIP:
            if not m["end"] and not m["attr"].endswith("/"):
                if tag in _SKIP:
                    body = re.compile(r"</head|<body", re.I).search(source, _after_raw(source, at))
                    to = body.start() if body else at
                    at = to
                    continue
                closing = _CLOSING[tag].search(source, at)
                if closing:
                    at = closing.end()
                elif tag in _TO_THE_END:
                    at = end
            continue
        if tag not in _BLOCK:
            opened = other.setdefault(tag, [])
            if m["end"]:
                if not opened or not opened.pop():
                    continue
            elif m["attr"].endswith("/"):
                continue
            else:
                opened.append(nodes[stack[-1]].tag not in _HOLDS_TEXT and not any(b.strip() for b in bits) and ahead.block(tag, at))
                if not opened[-1]:
                    continue
        close_block()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    del stack[k:]
                    links = 0
                    break
            continue
        if nodes[stack[-1]].tag == "p" and tag not in _CONTROLS:
            stack.pop()
        if rule := _ENDS.get(tag):
            for k in range(len(stack) - 1, 0, -1):
                name = nodes[stack[k]].tag
                if name in rule[0]:
                    del stack[k:]
                    break
                if name in rule[1]:
                    break
        links = 0
        if tag == "html":
            continue
        nodes[stack[-1]].kids.append(len(nodes))
        nodes.append(Node(tag, m["attr"], stack[-1]))
        stack.append(len(nodes) - 1)
    close_block()
    return nodes, blocks


def _after_raw(source: str, at: int) -> int:
    """Where scripts, styles and titles of a head that begins at ``at`` have ended: a tag
    inside them does not end the head."""
    last = at
    for m in re.compile(r"<(script|style|title|noscript|template)\b[^>]*>|(</head|<body)", re.I).finditer(source, at):
        if m.start() < last:
            continue
        if m[2]:
            return m.start()
        to = re.compile(rf"</{m[1]}\s*>", re.I).search(source, m.end())
        if to is None:
            return m.end()
        last = to.end()
    return last


GROUPS = {"ad": pages.AD, "menu": pages.MENU, "side": pages.SIDE, "notice": pages.NOTICE, "comment": pages.COMMENT, "foot": pages.FOOT, "head": pages.HEAD, "body": pages.BODY}
_HINTS = {
    "ad": r"\bads?\b|\bads?[_-]|[_-]ads?\b|advert|sponsor|promo|adsbox|adsense|\bdfp\b",
    "menu": r"menu|nav|breadcrumb|paginat|\btoc\b|\btabs?\b",
    "side": r"sidebar|widget|related|share|social|\baside\b|\btags?\b|recommend|trending|author-box|popular",
    "notice": r"notice|cookie|consent|gdpr|popup|modal|newsletter|subscri|alert|paywall|disclaimer|overlay|dialog",
    "comment": r"comment|repl(?:y|ies)|disqus|respon[sd]|discussion|forum-thread",
    "foot": r"foot|copyright|legal|colophon|\bbottom\b",
    "head": r"\bheader\b|site-header|masthead|logo|topbar|branding|top-bar",
    "body": r"content|article|\bpost\b|post-body|entry|story|\bmain\b|\btext\b|markdown|body",
    "role": r"\b(?:navigation|banner|contentinfo|complementary|search|dialog|alert|menu)\b",
}
_HINT = {k: re.compile(v, re.I) for k, v in _HINTS.items()}
_TAGS = ("article", "main", "section", "div", "body", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "button", "label", "select", "option", "fieldset", "table", "tr", "td", "th", "figure", "figcaption", "blockquote", "pre", "dl", "dt", "dd", "ins", "address", "dialog", "menu", "#root")
#: Elements that open a part of a page; edges into them have potentials of their own.
_LANDMARKS = {"article", "main", "section", "div", "body", "nav", "header", "footer", "aside", "form", "ins", "dialog", "table", "figure"}
_LENGTHS = (0, 1, 25, 100, 400)
N_FEATURES = len(_TAGS) + 1 + len(_HINTS) + len(_LENGTHS) * 3
N_EDGES = 3


@lru_cache(100_000)
def _static(tag: str, attr: str) -> tuple[int, ...]:
    """Features of an element by its tag, and by its class, id and role; names of a page's
    own count as ``ins``, and say what a class would."""
    own = _own_name(tag)
    out = [_TAGS.index("ins") if own else _TAGS.index(tag) if tag in _TAGS else len(_TAGS)]
    named = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attr)}
    name = " ".join([*(v for k in ("class", "id") if (v := named.get(k))), *([tag] if own else [])])
    if name:
        out += [len(_TAGS) + 1 + i for i, k in enumerate(_HINTS) if k != "role" and _HINT[k].search(name)]
    if (role := named.get("role")) and _HINT["role"].search(role):
        out.append(len(_TAGS) + len(_HINTS))
    return tuple(out)


def _dynamic(node: Node) -> int:
    """The feature of its own text's length and share of links."""
    size = sum(node.chars >= x for x in _LENGTHS[1:])
    share = node.linked / node.chars if node.chars else 0.0
    return len(_TAGS) + 1 + len(_HINTS) + size * 3 + (share > 0.05) + (share > 0.6)


def _own_name(tag: str) -> bool:
    return tag not in _BLOCK and tag != "#root"


def _edge_kind(parent: Node, node: Node) -> int:
    landmark = node.tag in _LANDMARKS or _own_name(node.tag)
    return 0 if landmark and parent.tag in ("#root", "body", "div", "section") else 1 if landmark else 2


def marginals(nodes: list[Node], unary: list[float], edge: np.ndarray) -> tuple[list[float], list[tuple[float, float, float, float]], float]:
    """Sum-product over the tree: P(content) of each node, the joint of each node (but the
    root) with its parent as (00, 01, 10, 11), and the log partition function.

    ``unary`` is the log potential of content (that of the other label is 0) and
    ``edge[kind][parent label][label]`` the log potential of an edge. Messages pass upward
    from the leaves, then downward from the root, each node once.
    """
    n = len(nodes)
    table = [[[math.exp(x) for x in row] for row in kind] for kind in edge.tolist()]
    kinds = [0] * n
    belief0, belief1 = [1.0] * n, [math.exp(min(30.0, max(-30.0, u))) for u in unary]
    up0, up1, log = [1.0] * n, [1.0] * n, 0.0
    for v in range(n - 1, 0, -1):
        p = nodes[v].parent
        k = kinds[v] = _edge_kind(nodes[p], nodes[v])
        t = table[k]
        a = t[0][0] * belief0[v] + t[0][1] * belief1[v]
        b = t[1][0] * belief0[v] + t[1][1] * belief1[v]
        scale = a + b
        log += math.log(scale)
        up0[v], up1[v] = a / scale, b / scale
        x, y = belief0[p] * up0[v], belief1[p] * up1[v]
        s = x + y
        log += math.log(s)
        belief0[p], belief1[p] = x / s, y / s
    log += math.log(belief0[0] + belief1[0])
    total = belief0[0] + belief1[0]
    out = [belief1[0] / total] + [0.0] * (n - 1)
    joint = [(0.0, 0.0, 0.0, 0.0)] * n
    for v in range(1, n):
        p = nodes[v].parent
        t = table[kinds[v]]
        q = out[p]
        # The parent's belief without this child's message.
        c0, c1 = (1 - q) / up0[v], q / up1[v]
        j = (c0 * t[0][0] * belief0[v], c0 * t[0][1] * belief1[v], c1 * t[1][0] * belief0[v], c1 * t[1][1] * belief1[v])
        s = sum(j) or 1.0
        j = tuple(x / s for x in j)
        joint[v] = j
        out[v] = j[1] + j[3]
    return out, joint, log


@dataclass
class TreeModel:
    weights: np.ndarray
    edge: np.ndarray

    def unary(self, nodes: list[Node]) -> list[float]:
        w = self.weights.tolist()
        return [sum([w[i] for i in _static(n.tag, n.attr)]) + w[_dynamic(n)] for n in nodes]

    def content(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node."""
        return marginals(nodes, self.unary(nodes), self.edge)[0]


def train(n_pages: int = 900, epochs: int = 12, rate: float = 0.15, decay: float = 1e-4, seed: int = 5) -> TreeModel:
    """Maximum likelihood on labelled pages, by AdaGrad: observed minus expected features."""
    rows = []
    for source in pages.labelled_pages(n_pages, seed):
        nodes, _ = parse(source)
        gold = [int(m[1]) if (m := re.search(r'data-y="(\d)"', n.attr)) else 0 for n in nodes]
        clean = [re.sub(r'\s*data-y="\d"', "", n.attr) for n in nodes]
        for node, attr in zip(nodes, clean, strict=True):
            node.attr = attr
        rows.append((nodes, gold, [(*_static(n.tag, n.attr), _dynamic(n)) for n in nodes]))
    model = TreeModel(np.zeros(N_FEATURES), np.zeros((N_EDGES, 2, 2)))
    seen_w, seen_e = np.full(N_FEATURES, 1e-3), np.full((N_EDGES, 2, 2), 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            nodes, gold, feats = rows[i]
            w = model.weights.tolist()
            p, joint, _ = marginals(nodes, [sum([w[k] for k in f]) for f in feats], model.edge)
            gw, ge = -decay * model.weights, -decay * model.edge
            for v, f in enumerate(feats):
                d = gold[v] - p[v]
                for k in f:
                    gw[k] += d
                if v:
                    e = ge[_edge_kind(nodes[nodes[v].parent], nodes[v])]
                    for k in range(4):
                        e[k >> 1, k & 1] -= joint[v][k]
                    e[gold[nodes[v].parent], gold[v]] += 1
            seen_w += gw**2
            seen_e += ge**2
            model.weights += rate * gw / np.sqrt(seen_w)
            model.edge += rate * ge / np.sqrt(seen_e)
    return model


def main_text(source: str | None, model: TreeModel) -> str:
    """The blocks of nodes that are more likely content than not, one a line."""
    if not source:
        return ""
    nodes, blocks = parse(source)
    p = model.content(nodes)
    return "\n".join(text for node, text in blocks if p[node] >= 0.5)


def text_column(source: Column | str, model: TreeModel) -> Column:
    """``main_text`` of a column of pages; a null page gives an empty text."""

    @pandas_udf("string")
    def extract(rows: pd.Series) -> pd.Series:
        drop_worker_caches()
        return pd.Series([main_text(x, model) for x in rows], dtype="object")

    return extract(source)


def extract_text(docs: DataFrame, model: TreeModel, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``docs`` with the main text of each whole page in ``out_col``, which gets underscores
    at its end where ``docs`` has such a column; rows and columns stay as they are. Null and
    empty pages, and pages without content, give an empty text."""
    bound_batches(docs.sparkSession)
    (name,) = free_name(docs, out_col)
    return docs.withColumn(name, text_column(F.col(html_col), model))
