"""Main text of web pages by wrapper induction over the pages of a host.

1. A host's reference tree unites the different trees of all its pages, aligned by simple tree matching.
2. Every page is aligned with its host's reference. Counts over all pages tell which nodes are on
   most pages with the same text (template) and where the text that varies lies (slots).
3. The region is the part of the reference that holds the varying text; a page's article is what
   is aligned with it, without the template nodes.

A host with under LEAST_PAGES different pages has no template, nor has one whose pages don't vary;
there the elements and roles of HTML tell the article. Names of classes only break ties (`hinted`).
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_schema, batches_of, small_enough, written
from tessera.llm.urls import host_of

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = frozenset("ul ol dl table select".split())
#: Parts that are never the article, by element and role.
NOT_TEXT = frozenset("head nav footer aside form script style noscript template iframe svg button select textarea input dialog object canvas math audio video menu title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MAIN = ("article", "main")
#: Flow content: an element of these tags stands beside others as a part of one text.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Whole class names or ids that hint at adverts and reader comments, and at other parts outside of the article.
BESIDE = frozenset("ad ads advert adverts advertisement sponsored comment comments comment-list post-comments respond disqus_thread".split())
OUTSIDE = BESIDE | frozenset(
    "banner cookie cookies cookie-notice cookie-banner cookie-consent gdpr notice notices popup modal overlay newsletter subscribe sidebar widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs "
    "masthead footer header copyright share social related related-posts pagination pager login search toolbar skip alert".split()
)
TOKEN = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|(\Z)))", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Different pages that a host needs for a template, parts by hash in which its trees are united
#: before these meet, and the part of the varying text that a node must hold for its siblings to be left out.
LEAST_PAGES, REFERENCE, SHARE = 3, 16, 0.75
#: Counted nodes or different trees that a task holds before it passes them on.
HELD = 100_000


class Node:
    __slots__ = ("children", "hint", "label", "main", "parent", "parts", "skip", "tag")

    def __init__(self, tag: str, label: str, skip: bool, hint: int, parent: Node | None):
        self.tag, self.label, self.skip, self.hint, self.parent = tag, label, skip, hint, parent
        self.main = tag in MAIN or label.startswith("main") or (parent is not None and parent.main)  # in an article
        self.children: list[Node] = []
        self.parts: list = []  # texts and child nodes in page order


@lru_cache(50_000)
def described(tag: str, attributes: str) -> tuple[str, bool, int]:
    """The label by which nodes are matched, whether the element is never text of the article, and
    what its names hint at: 2 adverts and reader comments, 1 other parts beside an article."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    names = sorted(found.get("class", "").lower().split())
    label = ".".join([tag, " ".join(names)]) if names else tag
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
    if role == "main":
        return f"main.{label}", bool(hidden), 0
    own = {*names, found.get("id", "").lower()}
    hint = 0 if tag in MAIN or tag in ("html", "body") else 2 if own & BESIDE else 1 if own & OUTSIDE else 0
    return label, bool(tag in NOT_TEXT or role in ROLES or hidden), hint


def parsed(page: str) -> Node:
    """A tree of block elements; inline elements only give their text (or skip it)."""
    root = here = Node("#root", "#root", False, 0, None)
    at, n = 0, len(page)
    hushed: list[str] = []  # open inline elements from the first skipped one on

    def text(x: str) -> None:
        if x and not hushed:
            here.parts.append(x)

    while at < n:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        m = TOKEN.match(page, start)
        if m is None:  # a plain <
            text(page[at : start + 1])
            at = start + 1
            continue
        if start > at:
            text(page[at:start])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None or m[7] is not None:  # a comment, a declaration, or a tag cut off by the end
            continue
        tag, attributes = tag.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            if tag in INLINE:
                if hushed and tag in hushed:
                    del hushed[len(hushed) - 1 - hushed[::-1].index(tag) :]
                continue
            node = here
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                here, hushed = node.parent, []
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            at = end.start() if end else n
            continue
        if tag in INLINE:
            if tag in ("br", "wbr"):
                text(" " if tag == "br" else "")
            elif tag != "img" and (hushed or described(tag, attributes)[1] or described(tag, attributes)[2] == 2):
                hushed.append(tag)
            continue
        hushed = []
        if tag in CLOSES_P:
            if here.tag == "p":
                here = here.parent
        elif tag in CLOSES_SAME:
            node = here
            while node is not None and node.tag not in SCOPE:
                if node.tag in CLOSES_SAME[tag]:
                    here = node.parent
                node = node.parent
        elif tag == "body":
            node = here
            while node is not None and node.tag != "head":
                node = node.parent
            here = node.parent if node is not None else here
        label, skip, hint = described(tag, attributes)
        node = Node(tag, label, skip or (tag == "header" and not here.main), hint, here)
        here.children.append(node)
        here.parts.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            here = node
    return root


def clean(x: str) -> str:
    return " ".join((entities.unescape(x) if "&" in x else x).split())


def blocks(node: Node) -> list[str]:
    """Texts directly in a node, one for each stretch between child blocks."""
    out, run = [], []
    for part in [*node.parts, None]:
        if isinstance(part, str):
            run.append(part)
        elif run:
            if x := clean("".join(run)):
                out.append(x)
            run = []
    return out


def deep() -> None:
    """Trees may be as deep as pages are long; frames of Python functions lie on the heap."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


class Tree:
    """A node of a page or reference, or a run of like siblings: label, children, the page's nodes."""

    __slots__ = ("children", "label", "nodes", "number")

    def __init__(self, label: str, children: list[Tree], nodes: list[Node] | None = None):
        self.label, self.children, self.nodes, self.number = label, children, nodes or [], -1


class Matching:
    """Simple tree matching. Equal trees have one number, so each pair of shapes is compared once."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.trees: list[Tree] = []
        self.sizes: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def number(self, tree: Tree) -> int:
        if tree.number < 0:
            own = []
            for child in tree.children:
                own.append(self.number(child))
            key = (tree.label, *own)
            tree.number = self.numbers.get(key, -1)
            if tree.number < 0:
                tree.number = self.numbers[key] = len(self.trees)
                size = 1
                for k in own:
                    size += self.sizes[k]
                self.trees.append(tree)
                self.sizes.append(size)
        return tree.number

    def matches(self, a: int, b: int) -> int:
        """Nodes that the best match of two trees pairs; 0 if their roots differ."""
        if a == b:
            return self.sizes[a]
        x, y = self.trees[a], self.trees[b]
        if x.label != y.label:
            return 0
        if (a, b) not in self.known:
            total = 1
            for i, j in self.aligned(x.children, y.children):
                total += self.matches(x.children[i].number, y.children[j].number)
            self.known[a, b] = total
        return self.known[a, b]

    def aligned(self, a: list[Tree], b: list[Tree]) -> list[tuple[int, int]]:
        """Pairs of children, in order and with equal labels, of the largest total match. Equal trees
        at either end belong to a best match, so only the middle is searched."""
        p, q = [], []
        for tree in a:
            p.append(self.number(tree))
        for tree in b:
            q.append(self.number(tree))
        low, high = 0, 0
        while low < min(len(p), len(q)) and p[low] == q[low]:
            low += 1
        while high < min(len(p), len(q)) - low and p[-1 - high] == q[-1 - high]:
            high += 1
        out = [(i, i) for i in range(low)]
        n, m = len(p) - high - low, len(q) - high - low
        if n and m:
            kinds, place = np.unique(np.array(q[low : low + m]), return_inverse=True)
            rows: dict[int, np.ndarray] = {}
            best, pairs, downs = np.zeros(m + 1, np.int64), [], []
            for i in range(n - 1, -1, -1):  # best match of the children from i and j on; a row at a time
                own = p[low + i]
                if own not in rows:
                    gain = np.zeros(len(kinds), np.int64)
                    for k, kind in enumerate(kinds.tolist()):
                        gain[k] = self.matches(own, kind)
                    rows[own] = gain[place]
                paired = np.where(rows[own] > 0, rows[own] + best[1:], -1)
                row = np.append(np.maximum(paired, best[:-1]), 0)
                row = np.maximum.accumulate(row[::-1])[::-1]
                pairs.append(np.packbits(paired == row[:-1]))
                downs.append(np.packbits(best == row))
                best = row
            i = j = 0
            while i < n and j < m:
                k = n - 1 - i
                if pairs[k][j >> 3] >> (7 - (j & 7)) & 1:
                    out.append((low + i, low + j))
                    i, j = i + 1, j + 1
                elif downs[k][j >> 3] >> (7 - (j & 7)) & 1:
                    i += 1
                else:
                    j += 1
        return out + [(len(p) - high + k, len(q) - high + k) for k in range(high)]

    def united(self, a: Tree, b: Tree) -> Tree:
        """The tree of two with equal roots: paired children are united, the others stand in order."""
        children, i, j = [], 0, 0
        for x, y in [*self.aligned(a.children, b.children), (len(a.children), len(b.children))]:
            children += a.children[i:x] + b.children[j:y]
            if x < len(a.children):
                children.append(self.united(a.children[x], b.children[y]))
            i, j = x + 1, y + 1
        return Tree(a.label, children, a.nodes + b.nodes)


def skeleton(node: Node, m: Matching) -> Tree:
    """A page's tree, also of its parts that are no text; runs of like siblings are one node."""
    children: list[Tree] = []
    for child in node.children:
        own = skeleton(child, m)
        if children and children[-1].label == own.label:
            children[-1] = m.united(children[-1], own)
        else:
            children.append(own)
    return Tree(("!" if node.skip else "") + node.label, children, [node])


def written_tree(tree: Tree) -> str:
    """The tree as JSON: for each node, in page order, its depth and label."""
    out, todo = [], [(tree, 0)]
    while todo:
        node, depth = todo.pop()
        out.append((depth, node.label))
        todo += [(child, depth + 1) for child in reversed(node.children)]
    return json.dumps(out)


def read_tree(data: str) -> list[Tree]:
    """The nodes of a written tree, in page order."""
    out: list[Tree] = []
    path: list[Tree] = []
    for depth, label in json.loads(data):
        own = Tree(label, [])
        del path[depth:]
        if path:
            path[-1].children.append(own)
        path.append(own)
        out.append(own)
    return out


def reference(pages: list[str]) -> Tree:
    """One tree for pages of a host, one after another."""
    held: Tree | None = None
    for page in pages:
        held = with_tree(held, shape(page))
    return held


def shape(page: str) -> Tree:
    deep()
    return skeleton(parsed(page), Matching())


def with_tree(held: Tree | None, own: Tree) -> Tree:
    """The union of the trees before, and one more."""
    deep()
    return fresh(own) if held is None else fresh(Matching().united(fresh(held), fresh(own)))


def fresh(tree: Tree) -> Tree:
    """A copy without page nodes and numbers."""
    return read_tree(written_tree(tree))[0]


def placed(root: Node, nodes: list[Tree]) -> dict[int, list[Node]]:
    """The page's nodes that are aligned with each node of a reference, by its place."""
    m = Matching()
    number = {id(x): k for k, x in enumerate(nodes)}
    for x in nodes:
        x.number = -1
    out: dict[int, list[Node]] = {}
    todo = [(skeleton(root, m), nodes[0])]
    while todo:
        own, known = todo.pop()
        out[number[id(known)]] = own.nodes
        todo += [(own.children[i], known.children[j]) for i, j in m.aligned(own.children, known.children)]
    return out


def own_text(nodes: list[Node]) -> str:
    """The blocks directly in the nodes."""
    return "\n".join(x for node in nodes for x in blocks(node))


def digest(x: str) -> int:
    h = xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def template(nodes: list[Tree], counts: dict[int, tuple[int, int, int, int]], pages: int) -> dict | None:
    """The region's place and the template nodes (place: digest of the text) of a reference, from
    counts by place: pages, least and greatest digest, code points of text. None if nothing varies."""
    texts = {k: c[1] for k, c in counts.items() if c[3] and c[1] == c[2] and c[0] >= LEAST_PAGES and 2 * c[0] >= pages}
    place = {id(x): k for k, x in enumerate(nodes)}
    mass, main = [0] * len(nodes), [False] * len(nodes)
    parent = {place[id(c)]: k for k, x in enumerate(nodes) for c in x.children}
    hidden = [False] * len(nodes)
    for k, x in enumerate(nodes):
        hidden[k] = x.label[0] == "!" or (k in parent and hidden[parent[k]])
        if k in counts and k not in texts and not hidden[k]:
            mass[k] = counts[k][3]
    own = list(mass)
    for k in range(len(nodes) - 1, 0, -1):  # children come after their parents
        mass[parent[k]] += mass[k]
        main[k] = main[k] or (is_main(nodes[k]) and mass[k] > 0 and 2 * counts[k][0] >= pages)
        main[parent[k]] = main[parent[k]] or main[k]
    if not mass[0]:
        return None
    at = 0
    while not is_main(nodes[at]):
        below = [place[id(c)] for c in nodes[at].children if mass[place[id(c)]]]
        better = [k for k in below if main[k]]
        if len(better) == 1:
            at = better[0]
            continue
        large = [k for k in below if mass[k] >= SHARE * mass[at]]
        rest = [k for k in below if k not in large]
        if not large or own[at] or tag_of(nodes[large[0]]) in FLOW or any(holds_heading(nodes, k, place, mass) or tag_of(nodes[k]) in FLOW for k in rest):
            break
        at = large[0]
    return {"region": at, "texts": {str(k): v for k, v in texts.items()}}


def tag_of(tree: Tree) -> str:
    return tree.label.partition(".")[0]


def is_main(tree: Tree) -> bool:
    return tag_of(tree) in MAIN


def holds_heading(nodes: list[Tree], k: int, place: dict[int, int], mass: list[int]) -> bool:
    todo = [nodes[k]]
    while todo:
        x = todo.pop()
        if mass[place[id(x)]]:
            if tag_of(x) in HEADINGS:
                return True
            todo += x.children
    return False


def extracted(page: str | None, known: tuple[list[Tree], dict] | None = None) -> str:
    """The article of a page: of the parts aligned with the region of `known`, its host's reference and
    template, all blocks but those of template nodes. Without `known`, or on a page that has nothing
    there, the blocks in the article or main element, else all that elements and roles don't rule out."""
    deep()
    root = parsed(page or "")
    if known is not None:
        nodes, told = known
        found = placed(root, nodes)
        regions = [x for x in found.get(told["region"], []) if not x.skip]
        gone = {id(x) for k, h in told["texts"].items() for x in found.get(int(k), []) if digest(own_text(found[int(k)])) == h}
        texts = tidy(regions, gone, 2 if told["region"] else 1)
        if texts:
            return "\n\n".join(texts)
    regions = mains(root)
    return "\n\n".join(tidy(regions or [root], set(), 2 if regions else 1))


def mains(root: Node) -> list[Node]:
    """The outermost article and main elements; an only article in a main stands for it."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.skip:
            continue
        if is_main_node(node):
            inner = [x for x in below(node) if x.tag == "article"] if node.tag == "main" else []
            out.append(inner[0] if len(inner) == 1 else node)
        else:
            todo += reversed(node.children)
    return out


def is_main_node(node: Node) -> bool:
    return node.tag in MAIN or node.label.startswith("main")


def below(node: Node) -> Iterator[Node]:
    todo = list(reversed(node.children))
    while todo:
        x = todo.pop()
        if not x.skip:
            yield x
            todo += reversed(x.children)


def tidy(regions: list[Node], gone: set[int], hint: int) -> list[str]:
    """The blocks of the regions in page order, without those directly in `gone` nodes. An element
    whose name hints (at `hint` or more) goes if it holds under half of the text."""
    out: list[tuple[str, int]] = []
    for region in regions:
        run: list[str] = []
        todo: list = [(region, iter(region.parts), 0)]

        def end(node: Node, mark: int, run=run) -> None:
            if run:
                x = clean("".join(run))
                run.clear()
                if x and id(node) not in gone:
                    out.append((x, mark))

        while todo:
            node, parts, mark = todo[-1]
            part = next(parts, None)
            if isinstance(part, str):
                run.append(part)
                continue
            end(node, mark)
            if part is None:
                todo.pop()
            elif not part.skip:
                todo.append((part, iter(part.parts), mark or (id(part) if part.hint >= hint else 0)))
    total = sum(len(x) for x, _ in out)
    held: dict[int, int] = {}
    for x, mark in out:
        held[mark] = held.get(mark, 0) + len(x)
    return [x for x, mark in out if not mark or 2 * held[mark] >= total]


@lru_cache(2048)
def _known(tree: str | None, told: str | None) -> tuple[list[Tree], dict] | None:
    return (read_tree(tree), json.loads(told)) if tree and told else None


@lru_cache(2048)
def _nodes(tree: str) -> list[Tree]:
    return read_tree(tree)


def with_side(pages: DataFrame, side: DataFrame, width: int) -> DataFrame:
    """`pages` with the columns of `side`, a row a host; broadcast if measured to be small."""
    size = sum((F.coalesce(F.length(c), F.lit(0)) for c in side.columns if c != "__of"), F.lit(width))
    return pages.join(F.broadcast(side) if small_enough(side, size) else side, F.col("__host") == F.col("__of"), "left")


def references(pages: DataFrame) -> DataFrame:
    """(__of, tree, pages): the reference of each host (pages has __host and html), and the number of its
    different pages. Trees of all pages count, equal ones once; they are united in REFERENCE parts by
    their hash, and these one after another, so the order of rows doesn't matter."""
    schema = "host string, tree string"
    target = arrow_schema(pages.sparkSession, schema)

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[str, int]] = set()
        for batch in batches:
            out = []
            for host, page in zip(*batch.columns, strict=True):
                own = (host.as_py(), written_tree(shape(page.as_py())))
                mark = (own[0], digest(own[1]))
                if mark not in met:
                    met.add(mark)
                    out.append(own)
            if len(met) > HELD:
                met.clear()  # equal trees meet again behind the shuffle
            yield from batches_of(out, target)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for host, part, tree in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (host, part) != last:
                    if held:
                        yield from batches_of([(last[0], written_tree(held))], target)
                    last, held = (host, part), None
                held = with_tree(held, read_tree(tree)[0])
        if held:
            yield from batches_of([(last[0], written_tree(held))], target)

    def united(rows: DataFrame, part: Column) -> DataFrame:
        rows = rows.select("host", part.alias("part"), "tree").repartition("host", "part")
        return rows.sortWithinPartitions("host", "part", F.xxhash64("tree"), "tree").select("host", "part", "tree").mapInArrow(unite, schema)

    own = written(pages.select("__host", "html").mapInArrow(shapes, schema).distinct(), "trees")
    trees = united(united(own, F.pmod(F.xxhash64("tree"), F.lit(REFERENCE)).cast("int")), F.lit(0)).withColumnRenamed("host", "__of")
    each = pages.select("__host", F.xxhash64("html").alias("__mark")).distinct()
    several = each.groupBy("__host").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    return trees.join(several, F.col("__of") == F.col("__host")).select("__of", "tree", "pages")


def induced(pages: DataFrame) -> DataFrame:
    """(__of, tree, told): reference and template of each host that has one. `pages` has __host and
    html. Counts come from all pages: each task adds up its own, and the sums meet by host and node."""
    pages = pages.where("html is not null")
    trees = written(references(pages), "references")
    rows = with_side(pages, trees.select("__of", "tree"), 32).where("tree is not null").select("__host", "tree", "html")
    schema = "host string, node int, n long, low long, high long, chars long"
    target = arrow_schema(pages.sparkSession, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep()
        held: dict[tuple[str, int], tuple] = {}
        for batch in batches:
            for host, tree, page in zip(*batch.columns, strict=True):
                host = host.as_py()
                for k, nodes in placed(parsed(page.as_py()), _nodes(tree.as_py())).items():
                    text = own_text(nodes)
                    h = digest(text)
                    n, low, high, chars = held.get((host, k), (0, h, h, 0))
                    held[host, k] = n + 1, min(low, h), max(high, h), chars + len(text)
                if len(held) > HELD:
                    yield from batches_of([(*k, *v) for k, v in held.items()], target)
                    held.clear()
        yield from batches_of([(*k, *v) for k, v in held.items()], target)

    sums = rows.mapInArrow(count, schema).groupBy("host", "node").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("chars").alias("chars"))
    every = sums.groupBy("host").agg(F.collect_list(F.struct("node", "n", "low", "high", "chars")).alias("counts"))  # the nodes of one reference
    joined = trees.join(every, F.col("__of") == F.col("host")).select("__of", "tree", "pages", "counts")
    out = "__of string, tree string, told string"
    final = arrow_schema(pages.sparkSession, out)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep()
        for batch in batches:
            for host, tree, _, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by = {c["node"]: (c["n"], c["low"], c["high"], c["chars"]) for c in counts}
                if told := template(read_tree(tree), by, by[0][0]):
                    yield from batches_of([(host, tree, json.dumps(told))], final)

    return joined.mapInArrow(tell, out)


def articles(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages` (page_id, url, html); other columns are ignored.

    Null and empty pages have an empty text; pages without a host form a group of their own;
    repeated rows give equal results; an empty table gives no rows. Character references are decoded, white space in a block
    becomes one space, blocks are joined by an empty line.
    """
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("__host"))
    side = written(induced(rows), "templates")
    schema = "page_id long, url string, text string, n_chars long"
    target = arrow_schema(pages.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extracted(p.as_py(), _known(tree.as_py(), told.as_py())) for p, tree, told in zip(*(batch.column(c) for c in ("html", "tree", "told")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=target)

    return with_side(rows, side, 32).select("page_id", "url", "html", "tree", "told").mapInArrow(run, schema)


def op6_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page. Null and empty html give an empty text, very long pages are read
    whole, repeated rows give equal results, an empty table gives none, other columns are ignored."""
    return articles(spark.read.parquet(f"{sf_dir}/pages.parquet"))
