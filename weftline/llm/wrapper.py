"""Main text of web pages by wrapper induction.

Every page is parsed into a tree and aligned, whole, by simple tree matching with one reference
page of its host and layout (the label of the element that holds the article), the one with the
fewest blocks. Nodes of the reference that are aligned with the same text on every page are the
template, all others are slots. A page's text is what stands in slots inside its article. Only then
do marks decide on the rest: slots whose tag, role or class tells of menus, headers, footers,
adverts, forms, notices or comments are no content, for these vary from page to page too.
"""

from __future__ import annotations

import html
import re
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.tables import written
from .shared import broadcast_if, small_batches

#: Different articles that a layout needs to have a template.
LEAST_PAGES = 3
#: Characters of templates broadcast at most.
BROADCAST_TEMPLATES = 32_000_000
#: Characters of reference pages broadcast at most.
BROADCAST_CHARS = 32_000_000

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html caption td th tr tbody thead tfoot".split())
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
LIMITS = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}
#: Elements that hold no article text.
OUTSIDE = frozenset("nav header footer aside form button select option dialog svg canvas video audio object menu head".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_MARKS = (
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent notice "
    "notices newsletter subscribe subscription popup modal overlay comment comments disqus share sharing social related recommended widget pagination pager masthead topbar gdpr login signup"
).split()
_BEFORE = "site page main top bottom global primary secondary left right post article entry header footer google cookie".split()
_AFTER = "area bar block body box button buttons container content form icons inner item items links list menu nav notice panel posts section slot thread toolbar unit widget wrap wrapper".split()


def _compounds(marks: list[str]) -> frozenset[str]:
    """Whole class tokens: the words themselves and their usual compounds; ``has-``, ``no-`` and ``-true`` are none."""
    joined = [f"{m}{j}{x}" for m in marks for x in _AFTER for j in "-_"] + [f"{x}{j}{m}" for m in marks for x in _BEFORE for j in "-_"]
    return frozenset([*marks, *joined])


NAMES = _compounds(_MARKS)
COMMENTS = _compounds(["comment", "comments", "disqus"])
HEADERS = frozenset("header site-header page-header siteheader pageheader top-header".split())
#: Elements that name rules never drop: a class of theirs tells about the page, not about a part of it.
WHOLE = frozenset("html body main".split())
ARTICLES = frozenset("article post entry story content main".split())
ARTICLES |= {f"{a}{j}{b}" for a in ARTICLES | {"page", "site", "blog"} for b in "content body text article post entry story main".split() for j in "-_"}


class Node:
    __slots__ = ("tag", "names", "role", "children", "parent", "label", "holds")

    def __init__(self, tag: str, attributes: str, parent: "Node | None"):
        self.tag, self.parent, self.children = tag, parent, []
        self.names, self.role, self.holds = "", "", False
        if attributes:
            for m in ATTRIBUTE.finditer(attributes):
                value = (m[2] or m[3] or m[4] or "").lower()
                if m[1].lower() == "role":
                    self.role = value
                else:
                    self.names += " " + value
        self.label = tag + self.names

    def outside(self) -> bool:
        """Marked as something else than article text; ``holds`` exempts from the rules on names."""
        if self.tag in OUTSIDE or self.role in ROLES:
            return True
        if not self.names or self.holds or self.tag in WHOLE:
            return False
        if self.tag == "article":
            return self.comments()  # no other name drops an article
        own = self.names.split()
        return not HEADERS.isdisjoint(own) or not NAMES.isdisjoint(own)

    def comments(self) -> bool:
        return self.tag not in WHOLE and not COMMENTS.isdisjoint(self.names.split())


def parse(page: str) -> Node:
    """The page's tree; children are nodes and strings. Raw elements' contents are left out."""
    root = top = Node("#", "", None)
    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            top.children.append(page[at:])
            break
        if m.start() > at:
            top.children.append(page[at : m.start()])
        at = m.end()
        close, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if close:
            node = top
            while node is not None and node.tag != name:
                node = node.parent
            if node is not None:
                top = node.parent
            continue
        if name in CLOSES_P:
            node = top
            while node.parent is not None and node.tag not in BLOCK:
                node = node.parent
            if node.tag == "p":
                top = node.parent
        if name in SIBLINGS:
            node, stop, same = top, LIMITS[name].split(), SIBLINGS[name].split()
            while node.parent is not None and node.tag not in stop:
                if node.tag in same:
                    top = node.parent
                    if name != "tr":
                        break
                node = node.parent
        child = Node(name, attributes, top)
        top.children.append(child)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
        elif name not in VOID and not attributes.endswith("/"):
            top = child
    return root


def _articles(root: Node) -> list[Node]:
    """The page's outermost article elements in page order; else main; else what is named so; else all.

    Where articles stand only below elements whose names mark them as no text, those elements are kept.
    """
    found: dict[str, list[Node]] = {"article": [], "main": [], "named": []}
    stack = [(root, frozenset())]
    while stack:
        node, above = stack.pop()
        for c in reversed(node.children):
            if isinstance(c, Node) and not c.outside():
                kinds = set(above)
                if c.tag == "article":
                    kinds.add("article")
                if c.tag == "main" or c.role == "main":
                    kinds.add("main")
                if c.names and c.tag not in ("body", "html") and not ARTICLES.isdisjoint(c.names.split()):
                    kinds.add("named")
                for kind in kinds - above:
                    found[kind].append(c)
                stack.append((c, frozenset(kinds)))
    for kind in ("article", "main", "named"):
        own = [x for x in found[kind] if any(t.strip() for _, t in blocks(x))]
        if own:
            order = {id(x): i for i, x in enumerate(_in_order(root))}
            return sorted(own, key=lambda x: order[id(x)])
    for node in _in_order(root):
        if node.tag in ("article", "main") or node.role == "main":
            above = []
            while node is not None and not (node.tag in OUTSIDE or node.role in ROLES or node.comments()):
                above.append(node)
                node = node.parent
            if node is None:
                for x in above:
                    x.holds = True
    return [root]


def _in_order(root: Node):
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]


def _path(node: Node | None) -> str:
    """Labels of the block elements from the page's root down to the node."""
    above = []
    while node is not None:
        if node.tag in BLOCK or node.parent is None:
            above.append(node.label)
        node = node.parent
    return ">".join(reversed(above))


def blocks(root: Node, whole: bool = False) -> list[tuple[str, str]]:
    """(path of labels, text) of each block of the subtree in page order, decoded and trimmed.

    ``whole``: with the block elements that hold no article text; raw elements and marked parts of lines are never text.
    """
    out: list[tuple[str, str]] = []
    text: list[str] = []
    place = [""]

    def flush() -> None:
        if text:
            t = SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if t:
                out.append((place[0], t))

    # entries: a string, or (node, path, headings only) to open, or None to close a block
    stack: list = [(root, _path(root), False)]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, tuple):
            node, path, headings = x
            block = node.tag in BLOCK or node is root
            if block:
                flush()
                stack.append(None)
            for c in reversed(node.children):
                if isinstance(c, str):
                    if not headings:
                        stack.append(_Text(c, path))
                elif c.tag == "br":
                    stack.append(_Text(" ", path))
                elif whole and c.tag in BLOCK and c.tag not in RAW:
                    stack.append((c, f"{path}>{c.label}", False))
                elif c.tag == "header" and HEADERS.isdisjoint(c.names.split()) and node.tag in ("article", "section", "main"):
                    stack.append((c, f"{path}>{c.label}", True))  # an article's own header keeps its headings
                elif headings and re.fullmatch(r"h[1-6]|hgroup", c.tag):
                    stack.append((c, f"{path}>{c.label}", False))
                elif not c.outside():
                    stack.append((c, f"{path}>{c.label}" if c.tag in BLOCK else path, headings))
        else:
            if not text:
                place[0] = x.path
            text.append(x.text)
    flush()
    return out


class _Text:
    __slots__ = ("text", "path")

    def __init__(self, text: str, path: str):
        self.text, self.path = text, path


class Tree:
    """A page's blocks as a tree of labels for matching; leaves carry a block's text."""

    __slots__ = ("label", "text", "children")

    def __init__(self, label: str, text: str = ""):
        self.label, self.text, self.children = label, text, []


def layout(page: str) -> tuple[str, list[tuple[str, str]]]:
    """The label of the element that holds the article, and all blocks of the page: (path, digest of the text)."""
    root = parse(page)
    label = _articles(root)[0].label
    return label, [(path, _digest(text)) for path, text in blocks(root, whole=True)]


def _digest(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def slots(own: list[tuple[str, str]]) -> tuple[Tree, list[Tree]]:
    """The tree that the blocks' paths span, and its leaves in the blocks' order."""
    root, leaves = Tree("#"), []
    last: list[tuple[str, Tree]] = []
    for path, text in own:
        steps = path.split(">")
        keep = 0
        while keep < min(len(last), len(steps) - 1) and last[keep][0] == steps[keep]:
            keep += 1
        del last[keep:]
        for s in steps[keep:]:
            node = Tree(s)
            (last[-1][1] if last else root).children.append(node)
            last.append((s, node))
        last[-1][1].text = text
        leaves.append(last[-1][1])
    return root, leaves


#: Pairs of inner nodes under one pair of parents that are weighed one by one; more are weighed by what they have in common, with the same weights.
FEW_PAIRS = 10_000
#: Children that hold a text from which on it is frequent among them; the weights do not depend on it.
OFTEN = 32


def _nodes(root: Tree):
    """A tree's nodes, parents first."""
    stack = [root]
    while stack:
        x = stack.pop()
        yield x
        stack += x.children


class Matching:
    """Simple tree matching of two trees: the heaviest alignment that keeps order and level.

    Equal texts weigh more, so that what repeats is aligned with itself. Weights are computed row by row, and only
    the steps of the alignment in hand are kept, two bits for each pair of children.

    The weight of two nodes depends on their labels, on which texts are empty and on the texts they share. Under parents with very many inner
    children each such combination is computed once, however many pairs have it.
    """

    def __init__(self) -> None:
        self.known: dict[tuple[int, int], float] = {}
        self.alike: dict[tuple[int, int], float] = {}
        self.kinds: dict[tuple, int] = {}
        self.masked: dict[tuple[int, frozenset[str]], int] = {}
        self.held: dict[int, frozenset[str]] = {}

    def _texts(self, x: Tree) -> frozenset[str]:
        if id(x) not in self.held:
            self.held[id(x)] = frozenset(n.text for n in _nodes(x) if n.text)
        return self.held[id(x)]

    def _kind(self, x: Tree, shared: frozenset[str]) -> int:
        """A number for what the node is to one with which it shares these texts alone."""
        key = (id(x), shared)
        if key not in self.masked:
            own: dict[int, int] = {}
            for n in reversed(list(_nodes(x))):
                text = n.text if n.text in shared else not n.text
                own[id(n)] = self.kinds.setdefault((n.label, text, *(own[id(c)] for c in n.children)), len(self.kinds))
            self.masked[key] = own[id(x)]
        return self.masked[key]

    def _combined(self, x: Tree, y: Tree) -> float:
        """The weight of two nodes, computed once for all that are alike to each other as these are."""
        shared = self._texts(x) & self._texts(y)
        key = (self._kind(x, shared), self._kind(y, shared))
        if key not in self.alike:
            self.alike[key] = self.weight(x, y)
        return self.alike[key]

    def _by_kind(self, b: Tree):
        """A function that puts the weights of an inner node with the inner children of b into its row."""
        inner = [j for j, y in enumerate(b.children) if y.children]
        holders: dict[str, list[int]] = {}
        for j in inner:
            for t in self._texts(b.children[j]):
                holders.setdefault(t, []).append(j)
        often = frozenset(t for t, own in holders.items() if len(own) > OFTEN)
        # children of one group hold the same frequent texts in the same places; those that share a rare one with x are few and met one by one
        grouped: dict[tuple, list[int]] = {}
        for j in inner:
            frequent = self._texts(b.children[j]) & often
            grouped.setdefault((b.children[j].label, frequent, self._kind(b.children[j], frequent)), []).append(j)
        groups = [(label, places, np.array(places)) for (label, _, _), places in grouped.items()]

        def put(x: Tree, w: np.ndarray) -> None:
            sharing = {j for t in self._texts(x) - often for j in holders.get(t, ()) if b.children[j].label == x.label}
            for label, places, at in groups:
                if label == x.label:
                    j = next((j for j in places if j not in sharing), None)
                    if j is not None:
                        w[at] = self._combined(x, b.children[j])
            for j in sharing:
                w[j] = self._combined(x, b.children[j])

        return put

    def weight(self, a: Tree, b: Tree) -> float:
        if a.label != b.label:
            return 0.0
        own = 1 + 0.5 * (a.text == b.text)
        if not a.children or not b.children:
            return own
        key = (id(a), id(b))
        if key not in self.known:
            above = np.zeros(len(b.children) + 1)
            for w in self._rows(a, b):
                above[1:] = np.maximum.accumulate(np.maximum(above[1:], above[:-1] + w))
            self.known[key] = own + float(above[-1])
        return self.known[key]

    def _rows(self, a: Tree, b: Tree):
        """For each child of a the weights with all children of b."""
        labels: dict[str, list[int]] = {}
        for j, y in enumerate(b.children):
            labels.setdefault(y.label, []).append(j)
        at = {k: np.array(v) for k, v in labels.items()}
        texts = np.array([hash(y.text) for y in b.children])
        inner = sum(1 for x in a.children if x.children) * sum(1 for y in b.children if y.children)
        put = self._by_kind(b) if inner > FEW_PAIRS else None
        for x in a.children:
            w = np.zeros(len(b.children))
            same = at.get(x.label)
            if same is not None:
                w[same] = 1 + 0.5 * (texts[same] == hash(x.text))
                if x.children and put:
                    put(x, w)
                elif x.children:
                    for j in same.tolist():
                        if b.children[j].children:
                            w[j] = self.weight(x, b.children[j])
            yield w

    def pairs(self, a: Tree, b: Tree) -> list[tuple[Tree, Tree]]:
        """The aligned nodes; none if the roots differ."""
        out, stack = [], [(a, b)] if a.label == b.label else []
        while stack:
            a, b = stack.pop()
            out.append((a, b))
            if not a.children or not b.children:
                continue
            above, taken, up, n = np.zeros(len(b.children) + 1), [], [], len(b.children)
            for w in self._rows(a, b):
                diagonal = above[:-1] + w
                row = np.maximum.accumulate(np.maximum(above[1:], diagonal))
                taken.append(np.packbits((row == diagonal) & (w > 0)))
                up.append(np.packbits(row == above[1:]))
                above[1:] = row
            i, j = len(taken) - 1, n - 1
            while i >= 0 and j >= 0:
                if taken[i][j >> 3] >> (7 - (j & 7)) & 1:
                    stack.append((a.children[i], b.children[j]))
                    i, j = i - 1, j - 1
                elif up[i][j >> 3] >> (7 - (j & 7)) & 1:
                    i -= 1
                else:
                    j -= 1
        return out


def repeated(reference: list[tuple[str, str]], own: list[tuple[str, str]]) -> list[int]:
    """Positions of the reference's blocks that are aligned with the same text of the page."""
    if set(reference).isdisjoint(own):
        return []
    a, leaves = slots(reference)
    same = {id(x) for x, y in Matching().pairs(a, slots(own)[0]) if x.text and x.text == y.text}
    return [i for i, x in enumerate(leaves) if id(x) in same]


def main_text(page: str | None, constants: list[str] | None) -> str:
    """The article's blocks that are not the template of the page's layout, joined by empty lines; all of them where nothing else is left."""
    if not page:
        return ""
    known, articles = set(constants or ()), _articles(parse(page))
    own = [b for a in articles for b in blocks(a)]
    kept = [t for p, t in own if not known or f"{articles[0].label}\n{p}\n{_digest(t)}" not in known]
    return "\n\n".join(kept or [t for _, t in own])


def induced(pages: DataFrame) -> DataFrame:
    """(host, constants) for the hosts that have a template; a constant is ``layout\\npath\\ndigest``.

    All pages count. Copies need no removal: what all pages say, all their copies say. Pages without blocks say
    nothing about the template. A layout needs ``LEAST_PAGES`` different pages.
    """
    block = pa.struct([("path", pa.string()), ("text", pa.string())])
    blocks_type = "array<struct<path:string,text:string>>"
    tuples = lambda x: [(y["path"], y["text"]) for y in x]

    def parsed(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            label, own = layout(page)
            if own:
                rows.append((host, label, _digest("".join(x[1] for x in own)), len(own), [{"path": p, "text": t} for p, t in own]))
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(block)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "label", "page", "n", "blocks"])

    def aligned(b: pa.RecordBatch) -> pa.RecordBatch:
        sys.setrecursionlimit(1_000_000)  # trees may be deep
        found = [repeated(tuples(r), tuples(x)) for r, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["host", "label", "found"])

    unit = ["host", "label"]
    p = pages.filter("host != '' and html is not null").select("host", "html")
    rows = written(p.mapInArrow(small_batches(parsed, 256), f"host string, label string, page string, n int, blocks {blocks_type}"), "page-blocks")
    enough = rows.select(*unit, "page").distinct().groupBy(*unit).agg(F.count("*").alias("different")).filter(F.col("different") >= LEAST_PAGES)
    first = rows.groupBy(*unit).agg(F.count("*").alias("pages"), F.min_by("blocks", F.struct("n", "page", "blocks")).alias("reference"))
    references = written(first.join(enough, unit).select(*unit, "pages", "reference"), "page-references")
    chars = references.agg(F.sum(F.aggregate("reference", F.lit(0).cast("long"), lambda a, x: a + F.length(x["path"]) + 40))).first()[0] or 0
    pairs = rows.join(broadcast_if(references.drop("pages"), chars <= BROADCAST_CHARS), unit).select(*unit, "reference", "blocks")
    at = pairs.mapInArrow(small_batches(aligned, 64), "host string, label string, found array<int>").select(*unit, F.explode("found").alias("at"))
    on = at.groupBy(*unit, "at").agg(F.count("*").alias("n"))
    constant = on.join(references, unit).filter("n = pages").select("host", "label", F.get("reference", F.col("at")).alias("x"))
    return constant.groupBy("host").agg(F.array_sort(F.collect_set(F.concat("label", F.lit("\n"), "x.path", F.lit("\n"), "x.text"))).alias("constants"))


def extracted(pages: DataFrame) -> DataFrame:
    """One row per page row: page_id, url, text (empty if none).

    A null or empty html has an empty text; a null url or one without a host has no template. A page whose whole article is template keeps it. Of pages
    that tie as their layout's reference the smallest digest is it.
    Repeated rows are extracted alike; other columns are ignored. Long pages are taken whole: memory grows with the
    pairs of a page's and its reference's children, two bits each. No pages, no rows.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    p = pages.select("page_id", "url", "html", host.alias("host"))
    templates = written(induced(p), "page-templates")
    chars = templates.agg(F.sum(F.length(F.array_join("constants", "")))).first()[0] or 0
    joined = p.join(broadcast_if(templates, chars <= BROADCAST_TEMPLATES), "host", "left").select("page_id", "url", "html", "constants")

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h, c) for h, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(small_batches(batch, 256), f"page_id {kind}, url string, text string")
