"""Main text of web pages by wrapper induction.

Templates belong to hosts, whatever the number of tasks. A first pass gives each page's shape, the labels of its DOM tree; the shape
of most distinct pages of a host is its reference. A second pass aligns the pages' trees with their host's reference by
simple tree matching: two nodes match if their labels (tag and class) do, and their children are matched in order so
that the number of matched nodes is largest. Per host and node of the reference, distinct pages with each text are counted. A
text that nearly all distinct pages have there is constant and belongs to the template. A page loses a block only if it has that very
text, which a third pass sees to; all else is content, if it lies in the page's article (``article`` or ``main``, else the body) and not
in an element that by its tag, role, class or id is no part of an article: menus, headers and footers of the page, sidebars,
notices, adverts, forms, comments, scripts.

Exact copies of a page count once, so that copies make no template: fewer than ``FEWEST`` distinct pages have no constant text.
Pages that differ anywhere are distinct, however little.

Nulls and odd rows: null or empty html gives an empty text; a null URL is a host of its own; broken markup is read as browsers
do, as far as it matters for text; repeated rows come back each; pages are whole, however long. Every row comes back once.
"""

from __future__ import annotations

import functools
import hashlib
import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import stored

FEWEST, CONSTANT = 5, 0.8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td
tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "body", "html", "legend"}
#: A start tag that ends an open element of these, up to the container named.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"})}
NOT_TEXT = frozenset("""head script style noscript template iframe object embed svg math canvas audio video map nav aside footer form
button select textarea input label dialog menu""".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
NOT_CLASS = re.compile(r"""(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side-bar|
footer|foot|masthead|site-header|page-header|cookies?\w*|consent|notices?|newsletter|subscribe|signup|popup|modal|overlay|comments?|
comment-?\w*|disqus|respond|replies|related|recommend\w*|share|sharing|social\w*|widget\w*|pagination|pager|toolbar|skip-?link\w*|
copyright|legal)(?:$|[\s_-])""".replace("\n", ""), re.I)
MAIN = frozenset(("article", "main"))
#: Elements of running text and of the page as a whole: their names say nothing.
PLAIN = frozenset("html body p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th em strong b i q code".split())
LAYOUT = re.compile(r"(?:has|no|with|without|is|not)[-_]", re.I)
COMMENT = re.compile(r"(?:comments?|reply|replies|response)(?:$|[-_])", re.I)
TOPIC = re.compile(r"(?:related|legal|market|social|copyright)[-_](?!posts?$|articles?$|stor(?:y|ies)$|links?$|content$|items?$|news$|share|sharing|buttons?$|media$|icons?$|bar$)", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    """An element; ``items`` are its texts and children in order."""

    __slots__ = ("tag", "label", "items", "children", "off", "slot", "shape", "inside", "named")

    def __init__(self, tag: str, label: str, off: bool, inside: bool = False, named: bool = False):
        self.tag, self.label, self.off, self.inside, self.named = tag, label, off, inside, named
        self.items: list = []
        self.children: list[Node] = []
        self.slot = self.shape = None


def _element(tag: str, rest: str, inside: bool) -> Node:
    off, label = tag in NOT_TEXT or (tag == "header" and not inside), tag
    if rest and "=" in rest:
        at = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}
        name = f"{at.get('class', '')} {at.get('id', '')}".strip()
        label = f"{tag}.{at.get('class', '')}"
        off = off or at.get("role", "").lower() in NOT_ROLES or "hidden" in at or at.get("aria-hidden") == "true" \
            or bool(HIDDEN.search(at.get("style", "")))
        named = not off and any(_told_off(tag, word, inside) for word in name.split())
        return Node(tag, label, off or named, inside or tag in MAIN, named)
    return Node(tag, label, off or rest.strip() == "hidden", inside or tag in MAIN)


def _told_off(tag: str, word: str, inside: bool) -> bool:
    """Whether a class or id speaks against an element. Names of layouts and of running text don't."""
    if tag in PLAIN or LAYOUT.match(word):
        return False
    if tag in MAIN:  # an article among the comments of another
        return inside and bool(COMMENT.match(word))
    return bool(NOT_CLASS.search(word)) and not (inside and TOPIC.match(word))


def parse(text: str) -> Node:
    """The tree of a page, lenient as browsers are."""
    root = Node("#", "#", False)
    stack, pos, n, found = [root], 0, len(text), False
    while pos < n:
        m = _TOKEN.search(text, pos)
        if not m:
            stack[-1].items.append(text[pos:])
            break
        if m.start() > pos:
            stack[-1].items.append(text[pos:m.start()])
        pos = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in ENDS:
            same, limit = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in limit:
                    break
                if stack[k].tag in same:
                    del stack[k:]
                    break
        node = _element(tag, m[3] or "", stack[-1].inside)
        if tag in MAIN and not node.off and not found:  # what holds the article isn't switched off by a name
            found = True
            for x in stack:
                x.off = x.off and not x.named
        stack[-1].items.append(node)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(text, pos)
            node.off = True
            if end:
                pos = text.find(">", end.start()) + 1 or n
            else:
                pos = n
        elif tag not in VOID and not (m[3] or "").endswith("/"):
            stack.append(node)
        elif tag not in VOID and tag not in BLOCK:
            continue
    return root


def stable(text: str) -> int:
    """A 64-bit hash that is alike in all processes."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@functools.lru_cache(1 << 14)
def _of_label(label: str) -> int:
    return stable(label)


def skeleton(root: Node) -> bytes:
    """The labels of a tree, packed."""
    out, todo = [], [(root, 0)]
    while todo:
        x, depth = todo.pop()
        out.append((depth, x.label))
        todo += [(c, depth + 1) for c in reversed(x.children)]
    return zlib.compress(json.dumps(out).encode(), 1)


def tree_of(packed: bytes) -> Node:
    """A tree of labels only, with shapes, whose nodes' ``slot`` is their number in document order."""
    above: list[Node] = []
    for k, (depth, label) in enumerate(json.loads(zlib.decompress(packed))):
        node = Node("", label, False)
        node.slot = k
        del above[depth:]
        if above:
            above[-1].children.append(node)
        above.append(node)
    shaped(above[0])
    return above[0]


def shaped(node: Node) -> int:
    """Gives every node a hash of its subtree's labels."""
    todo, order = [node], []
    while todo:
        x = todo.pop()
        order.append(x)
        todo += x.children
    for x in reversed(order):
        x.shape = hash((_of_label(x.label), *(c.shape for c in x.children)))  # of numbers: alike in all processes
    return node.shape


def block_text(node: Node) -> str | None:
    """The text of a block without blocks in it; None for other nodes."""
    if node.tag not in BLOCK or node.off:
        return None
    out, todo = [], list(reversed(node.items))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag in BLOCK and x.tag != "br":
            return None
        elif not x.off:
            todo += reversed(x.items)
    return " ".join("".join(out).split())


def size(node: Node, memo: dict[int, int]) -> int:
    """Nodes of a subtree, known by its shape."""
    todo = [node]
    while todo:
        x = todo[-1]
        below = [c for c in x.children if c.shape not in memo] if x.shape not in memo else []
        if below:
            todo += below
        else:
            memo.setdefault(x.shape, 1 + sum(memo[c.shape] for c in x.children))
            todo.pop()
    return memo[node.shape]


def in_order(n: int, m: int, row, cells: int = 1 << 22) -> list[tuple[int, int]]:
    """Pairs (i, j), both growing, with the largest sum of row(i)[j]; of several such sets the one that pairs, else leaves out an i,
    from the front. Rows are halved, which keeps one row of sums each time, until a table of a part is small."""
    out, j = [], 0

    def above(below: np.ndarray, got: np.ndarray) -> np.ndarray:
        best = below.copy()
        best[:-1] = np.maximum(best[:-1], below[1:] + got)
        return np.maximum.accumulate(best[::-1])[::-1]

    todo = [(0, n, np.zeros(m + 1, np.int64))]
    while todo:
        a, b, below = todo.pop()
        if j == m:
            break
        split = b - a > 1 and (b - a) * (m + 1 - j) > cells
        stop, start, sums = (a + b) // 2 if split else a, j, [below[j:]]
        for i in range(b - 1, stop - 1, -1):
            best = above(sums[-1], row(i)[start:])
            if split:
                sums[-1] = best
            else:
                sums.append(best)
        if split:
            whole = np.zeros(m + 1, np.int64)
            whole[start:] = sums[-1]
            todo += [(stop, b, below), (a, stop, whole)]
            continue
        sums.reverse()
        for i in range(a, b):
            top, under, got = sums[i - a], sums[i - a + 1], row(i)
            while j < m:
                k = j - start
                if got[j] and top[k] == under[k + 1] + got[j]:
                    out.append((i, j))
                    j += 1
                    break
                if top[k] == under[k]:
                    break
                j += 1
    return out


class Group:
    """Nodes of different shapes that others are matched with; ``parts`` are those of a label, with their children numbered."""

    #: Scores kept, and children in the table of a part.
    KEPT, CHILDREN = 1 << 22, 1 << 18

    def __init__(self, nodes: list[Node]):
        self.nodes, self.rows, self.labels, self.made = nodes, {}, {}, {}
        for n, x in enumerate(nodes):
            self.labels.setdefault(x.label, []).append(n)

    def parts(self, label: str) -> tuple[Group | None, list[tuple[np.ndarray, np.ndarray]]]:
        """The children of the label's nodes, and nodes with about as many: their numbers, and those of their children (-1: none)."""
        if label not in self.made:
            own = sorted(self.labels.get(label, ()), key=lambda n: len(self.nodes[n].children))
            shapes = {c.shape: c for n in own for c in self.nodes[n].children}
            number, cut = {shape: k for k, shape in enumerate(shapes)}, []
            for n in own:
                width = len(self.nodes[n].children)
                if not cut or width > 2 * cut[-1][0] + 8 or (len(cut[-1][1]) + 1) * width > self.CHILDREN:
                    cut.append((width, []))
                cut[-1][1].append(n)
            parts = []
            for _, found in cut:
                at = np.full((len(found), len(self.nodes[found[-1]].children)), -1, np.int32)
                for k, n in enumerate(found):
                    at[k, :len(self.nodes[n].children)] = [number[c.shape] for c in self.nodes[n].children]
                parts.append((np.array(found), at))
            self.made[label] = Group(list(shapes.values())), parts
        return self.made[label]


def middle(x: list[Node], y: list[Node]) -> tuple[list[Node], list[Node], int, int]:
    """Both lists without the equal shapes they begin and end with, and how many those are."""
    head = tail = 0
    while head < min(len(x), len(y)) and x[head].shape == y[head].shape:
        head += 1
    while tail < min(len(x), len(y)) - head and x[-1 - tail].shape == y[-1 - tail].shape:
        tail += 1
    return x[head:len(x) - tail], y[head:len(y) - tail], head, tail


class Matcher:
    """Simple tree matching of pages with a reference; equal shapes match node by node."""

    #: Children lists whose product is larger are matched row by row in numpy. Neither number changes a result.
    CELLS = 40_000
    #: With more pairs of different shapes than this, those of a node are settled together when they are needed, and not all kept.
    SHAPES = 1 << 16
    #: Groups of fewer nodes are settled one by one; so are nodes further down, and lists in that many others, which may be any number.
    FEW, DEEP = 16, 20

    def __init__(self):
        self.memo: dict[tuple[int, int], int] = {}
        self.sizes: dict[int, int] = {}
        self.level = 0

    def known(self, a: Node, b: Node) -> int | None:
        """Matched nodes of two subtrees, if that is known without looking at their children."""
        if a.shape == b.shape:
            return size(a, self.sizes)
        return 0 if a.label != b.label else self.memo.get((a.shape, b.shape))

    def score(self, a: Node, b: Node) -> int:
        """Matched nodes of two subtrees. Pairs below them are settled first, with a stack of their own: pages may be deep."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self.known(x, y) is None:
                below = self.unknown(x, y)
                if below:
                    todo += below
                    continue
                self.memo[x.shape, y.shape] = 1 + sum(self.score(p, q) for p, q in self.pairs(x, y))
            todo.pop()
        return self.known(a, b)

    def unknown(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """Pairs of children whose score ``pairs`` needs and that isn't known; one for each pair of shapes."""
        p, q, _, _ = middle(a.children, b.children)
        first, second = {c.shape: c for c in p}, {c.shape: c for c in q}
        if self.together(len(p) * len(q), first, second):
            return []
        return [(x, y) for x in first.values() for y in second.values() if self.known(x, y) is None]

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """Children of a and b matched in order, so that the number of nodes below them is largest."""
        x, y = a.children, b.children
        p, q, head, tail = middle(x, y)
        out = list(zip(x[:head], y[:head], strict=True))
        if len(p) * len(q) > self.CELLS:
            out += self.long_pairs(p, q)
        elif p and q:
            best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
            score = [[self.score(i, j) for j in q] for i in p]
            for i in range(len(p) - 1, -1, -1):
                for j in range(len(q) - 1, -1, -1):
                    best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + score[i][j])
            i = j = 0
            while i < len(p) and j < len(q):
                if score[i][j] and best[i][j] == best[i + 1][j + 1] + score[i][j]:
                    out.append((p[i], q[j]))
                    i, j = i + 1, j + 1
                elif best[i][j] == best[i + 1][j]:
                    i += 1
                else:
                    j += 1
        return out + (list(zip(x[-tail:], y[-tail:], strict=True)) if tail else [])

    def together(self, cells: int, first: dict[int, Node], second: dict[int, Node]) -> bool:
        return cells > self.CELLS and len(first) * len(second) > self.SHAPES and self.level < self.DEEP

    def long_pairs(self, p: list[Node], q: list[Node]) -> list[tuple[Node, Node]]:
        """As pairs, for long lists: the same pairs, with a table of sums a part at a time."""
        first, second = {c.shape: c for c in p}, {c.shape: c for c in q}
        group, number = Group(list(second.values())), {shape: k for k, shape in enumerate(second)}
        y, outer, together = np.array([number[c.shape] for c in q]), self.memo, self.together(len(p) * len(q), first, second)
        if together:
            self.memo = {}
        self.level += 1
        found = in_order(len(p), len(q), lambda i: self.against(p[i], group, 0 if together else self.DEEP)[y])
        self.level -= 1
        self.memo = outer
        return [(p[i], q[j]) for i, j in found]

    def against(self, x: Node, group: Group, depth: int) -> np.ndarray:
        """Matched nodes of x and each of the group, as ``score`` has them."""
        got = group.rows.pop(x.shape, None)
        if got is None:
            got = np.zeros(len(group.nodes), np.int64)
            if depth >= self.DEEP or len(group.labels.get(x.label, ())) < self.FEW:
                for n in group.labels.get(x.label, ()):
                    got[n] = self.score(x, group.nodes[n])
                if depth < self.DEEP and len(self.memo) > _Hosts.SCORES:
                    self.memo.clear()
            else:
                inner, parts = group.parts(x.label)
                for own, at in parts:
                    best = np.zeros((at.shape[0], at.shape[1] + 1), np.int64)
                    for c in x.children:
                        best[:, 1:] = np.maximum(best[:, 1:], best[:, :-1] + np.append(self.against(c, inner, depth + 1), 0)[at])
                        np.maximum.accumulate(best, axis=1, out=best)
                    got[own] = 1 + best[:, -1]
        group.rows[x.shape] = got
        if len(group.rows) * len(group.nodes) > group.KEPT and len(group.rows) > 1:
            del group.rows[next(iter(group.rows))]
        return got

    def align(self, page: Node, reference: Node) -> Iterator[Node]:
        """Sets ``slot`` of the page's matched nodes to the reference's; yields them."""
        todo = [(page, reference)]
        while todo:
            a, b = todo.pop()
            a.slot = b.slot
            yield a
            todo += self.pairs(a, b)


def _pieces(node: Node, out: list[str], constant: frozenset[tuple[int, int]]) -> None:
    todo = [iter((node,))]
    ends = [""]
    while todo:
        x = next(todo[-1], None)
        if x is None:
            todo.pop()
            out.append(ends.pop())
            continue
        if isinstance(x, str):
            out.append(x)
        elif not x.off:
            gap = " " if x.tag in BLOCK else ""
            out.append(gap)
            if not constant or _block(x) not in constant:
                todo.append(iter(x.items))
                ends.append(gap)


def _block(node: Node) -> tuple[int, int] | None:
    """(slot, hash of the text) of a block of an aligned page; None for other nodes and for blocks without text."""
    text = block_text(node)
    return (node.slot, stable(text)) if text else None


def _articles(root: Node) -> list[Node]:
    """Outermost article or main elements that aren't switched off, else the whole page."""
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.off:
            continue
        if x.tag in ("article", "main"):
            found.append(x)
        else:
            todo += reversed(x.children)
    return found or [root]


def text_of(root: Node, constant: frozenset[tuple[int, int]] = frozenset()) -> str:
    out: list[str] = []
    for x in _articles(root):
        _pieces(x, out, constant)
        out.append(" ")
    joined = "".join(out)
    return " ".join((html.unescape(joined) if "&" in joined else joined).split())


def aligned_blocks(root: Node, reference: Node, matcher: Matcher) -> set[tuple[int, int]]:
    """Aligns a page with the reference; (slot, hash of the text) of the blocks in its article.

    A node that the reference lacks has the labels on the way to it as its slot.
    """
    shaped(root)
    matched = {id(x) for x in matcher.align(root, reference)}
    articles = {id(x) for x in _articles(root)}
    out, todo = set(), [(root, 0, False)]
    while todo:
        x, way, inside = todo.pop()
        way = hash((way, _of_label(x.label)))
        if id(x) not in matched:
            x.slot = way | -1 << 62
        if x.off:
            continue
        inside = inside or id(x) in articles
        got = _block(x) if inside else None
        if got:
            out.add(got)
        todo += [(c, way, inside) for c in x.children]
    return out


def least(pages: int) -> float:
    """How many distinct pages of so many have to hold a block for it to be template."""
    return max(FEWEST, CONSTANT * pages)


def extract(pages: list[str]) -> list[str]:
    """Main texts of some pages of one host."""
    trees = [parse(p) for p in pages]
    distinct = dict(zip(pages, trees, strict=True))
    if len(distinct) < FEWEST:
        return [text_of(t) for t in trees]
    shapes = Counter(shaped(t) for t in distinct.values())
    reference = tree_of(skeleton(max(distinct.values(), key=lambda t: (shapes[t.shape], t.shape))))
    matcher = Matcher()
    blocks = {p: aligned_blocks(t, reference, matcher) for p, t in zip(pages, trees, strict=True)}
    met = Counter(b for found in blocks.values() for b in found)
    constant = frozenset(b for b, n in met.items() if n >= least(len(blocks)))
    return [text_of(t, constant) for t in trees]


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, shape, page, labels) of pages (host, page, html)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part, shapes, labels = batch.slice(lo, 256), [], []
            for text in part.column(2):
                root = parse(text.as_py())
                shapes.append(shaped(root))
                labels.append(skeleton(root))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shapes, pa.int64()), part.column(1), pa.array(labels, pa.binary())],
                                             ["host", "shape", "page", "labels"])


class _Hosts:
    """Aligns pages with the reference of their host; the hosts of late stay unpacked."""

    #: Hosts and scores kept at most.
    HOSTS, SCORES = 64, 1_000_000

    def __init__(self):
        self.known: dict[str, list] = {}

    def of(self, host: str, labels: pa.Scalar, constant: pa.Scalar | None = None) -> list:
        got = self.known.pop(host, None)
        if got is None:
            found = () if constant is None else constant.as_py()
            got = [tree_of(labels.as_py()), Matcher(), frozenset((c["slot"], c["words"]) for c in found)]
        if len(got[1].memo) > self.SCORES // (1 + len(self.known)):
            got[1] = Matcher()
        self.known[host] = got
        if len(self.known) > self.HOSTS:
            del self.known[next(iter(self.known))]
        return got


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, slot, words, page) of the article's blocks of pages (host, page, page_id, url, html, labels)."""
    hosts = _Hosts()
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part, own, slots, words = batch.slice(lo, 256), [], [], []
            for k, (host, text, labels) in enumerate(zip(*(part.column(c) for c in ("host", "html", "labels")), strict=True)):
                if labels.is_valid:
                    reference, matcher, _ = hosts.of(host.as_py(), labels)
                    for slot, word in aligned_blocks(parse(text.as_py()), reference, matcher):
                        own.append(k)
                        slots.append(slot)
                        words.append(word)
            at = pa.array(own, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("host").take(at), pa.array(slots, pa.int64()), pa.array(words, pa.int64()),
                                              part.column("page").take(at)], ["host", "slot", "words", "page"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, text) of pages (host, page, page_id, url, html, labels, constant)."""
    hosts = _Hosts()
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part, out = batch.slice(lo, 256), []
            for host, text, labels, found in zip(*(part.column(c) for c in ("host", "html", "labels", "constant")), strict=True):
                root, constant = parse(text.as_py()), frozenset()
                if found.is_valid:
                    reference, matcher, constant = hosts.of(host.as_py(), labels, found)
                    aligned_blocks(root, reference, matcher)
                out.append(text_of(root, constant))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string())],
                                             ["page_id", "url", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: page_id, url, text."""
    host = F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    source = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.lower(host).alias("host"), F.xxhash64(source).alias("page"), F.col(id_col).cast("long").alias("page_id"),
                        F.col(url_col).cast("string").alias("url"), source.alias("html"))

    shapes = rows.select("host", "page", "html").mapInArrow(_shapes, "host string, shape long, page long, labels binary") \
        .groupBy("host", "shape").agg(F.count_distinct("page").alias("n"), F.min("labels").alias("labels"))
    hosts = shapes.groupBy("host").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "shape", "labels"))["labels"].alias("labels")) \
        .filter(F.col("pages") >= FEWEST)
    hosts = stored(hosts, "hosts")
    blocks = rows.join(hosts.select("host", "labels"), "host") \
        .mapInArrow(_met, "host string, slot long, words long, page long")
    enough = F.greatest(F.lit(FEWEST), F.lit(CONSTANT) * F.col("pages"))
    constant = blocks.groupBy("host", "slot", "words").agg(F.count_distinct("page").alias("n")).filter(F.col("n") >= FEWEST) \
        .join(hosts.select("host", "pages"), "host").filter(F.col("n") >= enough) \
        .groupBy("host").agg(F.collect_list(F.struct("slot", "words")).alias("constant"))
    template = stored(hosts.select("host", "labels").join(constant, "host"), "template")
    return rows.join(template, "host", "left").mapInArrow(_texts, "page_id long, url string, text string")
