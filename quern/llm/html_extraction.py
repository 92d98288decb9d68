"""Main text of web pages by wrapper induction.

For each host a bounded sample of different pages is parsed into trees of block elements, and pages of one kind (most
label paths shared) are aligned with a reference page by simple tree matching. What is found is the host's wrapper: a
node whose text is the same on different pages is template, a node that is mostly links on most pages is navigation, and
the node that holds nearly all of the varying text is the place of the content. Wrappers are written as a table and
then applied to every page of the host, so neither the position of a row nor the number of pages matters.

On a page, slots at the place of the content are content unless they are template, navigation, or marked as something
else (navigation, adverts, forms, comments, ...), for which few names count inside an article or the place of the content. Where a host has too few different pages for a wrapper, or a page is
not of a kind that was learnt, the marks alone decide; where a page marks its article, content is sought inside it.

Matching is without recursion, scores are kept for pairs of tree shapes, and siblings are paired at most `BAND` places off
the diagonal once equal shapes at both ends are paired, so deep pages and long lists take linear time.

Defined results: null or empty html has an empty text; a null address belongs to a host of its own; rows that repeat get the
same result; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship_package, written

#: Different pages of a host that its wrapper is learnt from, at most: one page of each title first, by hash
#: (of hosts with many different pages, of about 8 times as many by hash).
SAMPLE = 48
#: Characters of these that are parsed for it at once; at least `TEMPLATE_PAGES` pages are.
SAMPLE_CHARS = 16_000_000
#: Hosts with more than a part of this many of all pages are dealt out; hence fewer hosts than this are broadcast.
HEAVY = 10_000
#: Wrappers and sample keys up to this many bytes (by their counted size) are broadcast; beyond it pages are shuffled to them.
BROADCAST_BYTES = 32 << 20
#: Pages with different titles on which a node must have the same text to be template, and the share of them.
TEMPLATE_PAGES, TEMPLATE_SHARE = 4, 0.9
LINK_SHARE = 0.6
#: The share of the varying text that the place of the content has of that of the node above it.
MAIN_SHARE = 0.7
#: Pages are of one kind where they share this much of their label paths.
KIND_SHARE = 0.5
#: Pages of one title count as different where so much of their text is not shared.
DIFFERENT = 0.2
#: How far off the diagonal siblings are paired.
BAND = 32

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>?))""", re.S
)
NUMBERS = re.compile("[0-9]+")
NAME = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Element names by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head".split()
)
DROPPED = frozenset("nav footer aside form script style textarea title noscript iframe xmp noembed head button select option template svg math dialog menu object canvas label input audio video map".split())
SCOPES = frozenset("td th table li div article section".split())
ARTICLES = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words in class, id or role that mark what is not the article; those that do so inside an article too; and words that say nothing beside them.
MARKS = frozenset(
    "teaser teasers ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation navi menu menubar breadcrumb breadcrumbs sidebar sidenav rail widget widgets footer foot masthead topbar header cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments commentlist reply replies disqus respond toolbar pagination pager search login complementary contentinfo toc".split()
)
INSIDE = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar cookie cookies consent gdpr newsletter subscribe signup sharing social related recommended recommendations comment comments commentlist reply replies disqus respond pagination login".split()
)
NEUTRAL = frozenset("list box block section container wrapper wrap area item items link links button buttons form bar inner outer top bottom left right main content site page post posts article module group panel region inline header title body text row col slot unit thread by user reader".split())


class Node:
    __slots__ = ("tag", "label", "marks", "parts", "parent", "order", "shape")

    def __init__(self, tag: str, marks: str, parent: Node | None) -> None:
        self.tag, self.marks, self.parent = tag, marks, parent
        self.label = f"{tag}.{NUMBERS.sub('#', marks)}" if marks else tag
        #: text pieces as (text, inside a link) and block children, in page order
        self.parts: list[tuple[str, bool] | Node] = []
        self.order = self.shape = 0

    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]

    def text(self) -> tuple[str, ...]:
        """Its own text, split where block children stand."""
        out, run = [], []
        for p in [*self.parts, None]:
            if isinstance(p, tuple):
                run.append(p[0])
            elif run:
                if t := " ".join("".join(run).split()):
                    out.append(t)
                run = []
        return tuple(out)

    def link_share(self) -> float:
        n = [0, 0]
        for p in self.parts:
            if isinstance(p, tuple):
                n[p[1]] += len(p[0].strip())
        return n[1] / sum(n) if sum(n) else 0.0


class Open:
    """The open elements, with the places of those that decide what a start tag closes."""

    def __init__(self) -> None:
        #: (tag, node that it is or stands in, dropped); inline elements have no node of their own
        self.rows: list[tuple[str, Node, bool]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.scopes: list[int] = []

    def push(self, tag: str, node: Node, dropped: bool) -> None:
        self.places[tag].append(len(self.rows))
        if tag in SCOPES:
            self.scopes.append(len(self.rows))
        self.rows.append((tag, node, dropped))

    def pop(self) -> tuple[str, Node, bool]:
        row = self.rows.pop()
        self.places[row[0]].pop()
        if row[0] in SCOPES:
            self.scopes.pop()
        return row

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element with one of these tags; -1 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)


def parsed(source: str) -> tuple[Node, str]:
    """The tree of block elements, and the title. Never fails: what is not closed ends with its parent."""
    root = node = Node("#root", "", None)
    stack = Open()
    at, title, links, hidden = 0, "", 0, 0

    def pop_to(i: int) -> None:
        nonlocal node, links, hidden
        while len(stack.rows) > i:
            tag, n, dropped = stack.pop()
            links -= tag == "a"
            hidden -= dropped
            node = n.parent if tag in BLOCK else n

    def text(t: str) -> None:
        if t and not hidden:
            node.parts.append((entities.unescape(t), links > 0))

    while m := TOKEN.search(source, at):
        text(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            i = stack.last((tag,))
            if i >= 0:
                pop_to(i)
            elif tag == "p":
                text(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                node.parts.append(Node("hr", "", node))
            elif tag == "br" or tag == "wbr":
                text(" " if tag == "br" else "")
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I | re.A).search(source, at)
            inside = source[at : end.start() if end else len(source)]
            if tag == "title" and not title:
                title = " ".join(entities.unescape(inside).split())
            at = end.start() if end else len(source)
            if end:
                close = source.find(">", at)
                at = close + 1 if close >= 0 else len(source)
            continue
        if tag in BLOCK and tag not in ("html", "body"):
            i = stack.last(("p",))
            if i >= 0 and tag not in ("td", "th", "tr", "li", "dt", "dd") and not (stack.scopes and stack.scopes[-1] > i):
                pop_to(i)
            if tag in CLOSES:
                i = stack.last(CLOSES[tag])
                if i > stack.last(("ul", "ol", "dl", "table")):
                    pop_to(i)
        marks = " ".join(filter(None, (x[1] or x[2] or x[3] for x in NAME.findall(m[3])))) if m[3] and "=" in m[3] else ""
        inline_drop = tag not in BLOCK and tag in DROPPED
        if tag in BLOCK:
            child = Node(tag, marks, node)
            node.parts.append(child)
            node = child
        stack.push(tag, node, inline_drop)
        links += tag == "a"
        hidden += inline_drop
    text(source[at:])
    return root, title


def in_order(root: Node) -> list[Node]:
    """All nodes in page order, numbered."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        n.order = len(out)
        out.append(n)
        todo += reversed(n.children())
    return out


class Shapes:
    """Numbers for trees of labels: equal trees have one number. Scores of simple tree matching are kept by pairs of numbers."""

    def __init__(self) -> None:
        self.number: dict[tuple, int] = {}
        self.label: list[str] = []
        self.parts: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.scores: dict[tuple[int, int], int] = {}

    def give(self, nodes: list[Node]) -> list[Node]:
        """Numbers the shapes of all nodes of a tree, which come in page order."""
        for n in reversed(nodes):
            key = n.label, tuple(c.shape for c in n.children())
            n.shape = self.number.setdefault(key, len(self.label))
            if n.shape == len(self.label):
                self.label.append(key[0])
                self.parts.append(key[1])
                self.size.append(1 + sum(self.size[x] for x in key[1]))
        return nodes

    def score(self, a: int, b: int) -> int:
        """The most nodes that can be paired keeping labels, ancestry and order (siblings within the band)."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.scores:
                todo.pop()
            elif x == y or self.label[x] != self.label[y]:
                self.scores[x, y] = self.size[x] if x == y else 0
            else:
                lo, hi = ends(self.parts[x], self.parts[y])
                xs, ys = middle(self.parts[x], lo, hi), middle(self.parts[y], lo, hi)
                missing = [p for p in {(xs[i], ys[j]) for i, js in enumerate(windows(len(xs), len(ys))) for j in js} if p not in self.scores]
                if missing:
                    todo += missing
                else:
                    equal = sum(self.size[z] for k, z in enumerate(self.parts[x]) if k < lo or k >= lo + len(xs))
                    self.scores[x, y] = 1 + equal + Table(self, xs, ys).best(len(xs), len(ys))
        return self.scores[a, b]


def ends(xs: Sequence[int], ys: Sequence[int]) -> tuple[int, int]:
    """How many equal shapes both sequences begin and end with; pairing these never costs a pair."""
    n, lo, hi = min(len(xs), len(ys)), 0, 0
    while lo < n and xs[lo] == ys[lo]:
        lo += 1
    while hi < n - lo and xs[-1 - hi] == ys[-1 - hi]:
        hi += 1
    return lo, hi


def middle(xs: Sequence, lo: int, hi: int) -> Sequence:
    return xs[lo : len(xs) - hi]


def windows(n: int, m: int) -> list[range]:
    """For each of n siblings the places among m others that it may be paired with."""
    return [range(max(0, i * m // n - BAND), min(m, i * m // n + BAND + 1)) for i in range(n)]


class Table:
    """Best scores of the first i and the first j of two sequences of shapes; only cells in the windows are stored."""

    def __init__(self, shapes: Shapes, xs: Sequence[int], ys: Sequence[int]) -> None:
        self.windows, self.rows, self.left = windows(len(xs), len(ys)), [], []
        for i, js in enumerate(self.windows):
            left = last = self.best(i, js.start)  # nothing left of the window can be paired with sibling i
            row = []
            for j in js:
                last = max(last, self.best(i, j + 1), self.best(i, j) + shapes.scores[xs[i], ys[j]])
                row.append(last)
            self.rows.append(row)
            self.left.append(left)

    def best(self, i: int, j: int) -> int:
        if not i or not j:
            return 0
        k = j - 1 - self.windows[i - 1].start
        return self.left[i - 1] if k < 0 else self.rows[i - 1][min(k, len(self.rows[i - 1]) - 1)]

    def pairs(self) -> Iterator[tuple[int, int]]:
        i, j = len(self.rows), self.windows[-1].stop if self.rows else 0
        while i and j:
            if j <= self.windows[i - 1].start or self.best(i - 1, j) == self.best(i, j):
                i -= 1
            elif self.best(i, j - 1) == self.best(i, j):
                j -= 1
            else:
                i, j = i - 1, j - 1
                yield i, j


def match(a: Node, b: Node, shapes: Shapes) -> dict[int, Node]:
    """Simple tree matching: a pairing (number in a -> node of b) of the most nodes that keeps labels, ancestry and order."""
    pairs: dict[int, Node] = {}
    todo = [(a, b)] if a.label == b.label else []
    while todo:
        x, y = todo.pop()
        pairs[x.order] = y
        xs, ys = x.children(), y.children()
        if x.shape == y.shape:
            todo += zip(xs, ys, strict=True)
            continue
        shapes.score(x.shape, y.shape)
        lo, hi = ends([c.shape for c in xs], [c.shape for c in ys])
        todo += [*zip(xs[:lo], ys[:lo], strict=True), *zip(xs[len(xs) - hi :], ys[len(ys) - hi :], strict=True)]
        xs, ys = middle(xs, lo, hi), middle(ys, lo, hi)
        todo += [(xs[i], ys[j]) for i, j in Table(shapes, [c.shape for c in xs], [c.shape for c in ys]).pairs()]
    return pairs


def marked(n: Node, words: frozenset[str] = MARKS) -> bool:
    """Whether one of its names says that it isn't the article: a word of the list, alone or with words that say nothing ("comment-list", but not "header-image")."""
    if not n.marks:
        return False
    for name in n.marks.split():
        parts = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
        if any(w in words for w in parts) and all(w in words or w in NEUTRAL for w in parts):
            return True
    return False


def kept_nodes(root: Node, main: Node | None = None) -> list[Node]:
    """Nodes that may hold content, by their place. Inside an article, or in the place of the content that a wrapper names (`main`), fewer names rule a node out."""
    article: list[Node] = []

    def visit(n: Node, inside: bool, out: list[Node]) -> None:
        todo = [(n, inside)]
        while todo:
            x, art = todo.pop()
            art = art or x is main
            if x.tag in DROPPED or (x.tag == "header" and not art) or (x.tag not in ("body", "html") and x is not main and marked(x, INSIDE if art and x.tag != "article" else MARKS)):
                continue
            if not art and (x.tag in ("article", "main") or "main" in x.marks.lower().split()):
                art = True
                article.append(x)
            out.append(x)
            todo += [(c, art) for c in reversed(x.children())]

    every: list[Node] = []
    visit(root, False, every)
    tops = [a for a in article if a.tag == "article"] or article
    if not tops:
        return every
    inner: list[Node] = []
    for t in tops:
        visit(t, True, inner)
    return inner


def different_pages(trees: list[tuple[Node, str]], pages: list[str]) -> set[int]:
    """Pages about different things: with different titles, or with the same title (as of the site) and much different text."""
    chosen: dict[str, list[Counter]] = {}
    out = set()
    for k, (root, title) in enumerate(trees):
        same = chosen.setdefault(title or pages[k], [])
        if same and not title:
            continue
        pieces = Counter(t for n in in_order(root) for t in n.text())
        if all(differ(pieces, other) for other in same):
            same.append(pieces)
            out.add(k)
    return out


def differ(a: Counter, b: Counter) -> bool:
    size = lambda pieces: sum(len(t) * n for t, n in pieces.items())
    return max(size(a - b), size(b - a)) >= DIFFERENT * max(size(a), size(b), 1)


@dataclass
class Wrapper:
    """What was learnt of pages of one kind of a host. Lists go by the number of a node of the reference page.

    template: hashes of texts that are the same on nearly all pages. linked: nodes that are mostly links. main: the place of the content.
    constant: hashes of label path and text of what stands on nearly all pages, wherever it stands among its siblings; matching pairs the most
    nodes, which may leave such a node out.
    """

    labels: list[str]
    parents: list[int]
    paths: list[int]
    template: dict[int, int]
    linked: set[int]
    main: int
    constant: set[int]

    def tree(self) -> list[Node]:
        """The reference page without its texts."""
        nodes: list[Node] = []
        for label, parent in zip(self.labels, self.parents, strict=True):
            n = Node(label.partition(".")[0], "", nodes[parent] if nodes else None)
            n.label, n.order = label, len(nodes)
            if nodes:
                nodes[parent].parts.append(n)
            nodes.append(n)
        return nodes

    def said(self) -> dict:
        return {"labels": self.labels, "parents": self.parents, "paths": self.paths, "template": sorted(self.template.items()), "linked": sorted(self.linked), "main": self.main, "constant": sorted(self.constant)}

    @staticmethod
    def read(said: dict) -> Wrapper:
        return Wrapper(said["labels"], said["parents"], said["paths"], {int(k): v for k, v in said["template"]}, set(said["linked"]), said["main"], set(said["constant"]))


def hashed(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"))


def paths_of(nodes: list[Node]) -> list[int]:
    """Hashes of the labels from the top to each node, by its number."""
    path = [0] * len(nodes)
    for n in nodes[1:]:
        path[n.order] = hashed(f"{path[n.parent.order]}/{n.label}")
    return path


def label_paths(nodes: list[Node]) -> set[int]:
    return set(paths_of(nodes)[1:])


def placed_texts(nodes: list[Node]) -> dict[int, int]:
    """Hash of label path and text by the number of each node that has text."""
    path = paths_of(nodes)
    return {n.order: hashed(f"{path[n.order]}:" + "\n".join(t)) for n in nodes if (t := n.text())}


def shared(a: set[int], b: set[int]) -> float:
    return len(a & b) / max(1, len(a | b))


def kinds(trees: list[list[Node]]) -> list[list[int]]:
    """Pages with much the same label paths; each goes to the first kind whose first page is alike."""
    firsts: list[tuple[set[int], list[int]]] = []
    for k, nodes in enumerate(trees):
        paths = label_paths(nodes)
        for other, members in firsts:
            if shared(paths, other) >= KIND_SHARE:
                members.append(k)
                break
        else:
            firsts.append((paths, [k]))
    return [members for _, members in firsts]


def learnt(pages: list[str]) -> list[Wrapper]:
    """Wrappers from different pages of one host; pages that are no different from others teach nothing."""
    trees = [parsed(p) for p in pages]
    distinct = sorted(different_pages(trees, pages))
    nodes = [in_order(trees[k][0]) for k in distinct]
    out = []
    for members in kinds(nodes):
        if len(members) >= TEMPLATE_PAGES:
            out.append(induced([nodes[k] for k in members]))
    return out


def induced(pages: list[list[Node]]) -> Wrapper:
    """The wrapper of pages of one kind."""
    shapes = Shapes()
    for nodes in pages:
        shapes.give(nodes)
    reference = sorted(pages, key=lambda nodes: (len(nodes), [n.label for n in nodes]))[len(pages) // 2]
    paired = [match(reference[0], nodes[0], shapes) for nodes in pages]
    texts: dict[int, Counter] = defaultdict(Counter)
    shares: dict[int, list[float]] = defaultdict(list)
    for pairs in paired:
        for r, n in pairs.items():
            if t := n.text():
                texts[r][t] += 1
                shares[r].append(n.link_share())
    template = {}
    for r, seen in texts.items():
        t, n = max(seen.items(), key=lambda x: (x[1], x[0]))
        if n >= TEMPLATE_PAGES and n >= TEMPLATE_SHARE * seen.total():
            template[r] = hashed("\n".join(t))
    linked = {r for r, x in shares.items() if len(x) >= TEMPLATE_PAGES and sum(x) > LINK_SHARE * len(x)}
    on = Counter(h for nodes in pages for h in set(placed_texts(nodes).values()))
    constant = {h for h, n in on.items() if n >= TEMPLATE_PAGES and n >= TEMPLATE_SHARE * len(pages)}
    # the share of the varying text that stands at or below each node, on average
    mass = np.zeros(len(reference))
    for nodes, pairs in zip(pages, paired, strict=True):
        places = {n.order: r for r, n in pairs.items()}
        own, said = np.zeros(len(nodes)), placed_texts(nodes)
        for n in reversed(nodes):
            r = places.get(n.order)
            if (t := n.text()) and r not in linked and n.link_share() <= LINK_SHARE and said[n.order] not in constant and template.get(r) != hashed("\n".join(t)):
                own[n.order] += sum(map(len, t))
            if n.parent is not None:
                own[n.parent.order] += own[n.order]
        if own[0]:
            for r, n in pairs.items():
                mass[r] += own[n.order] / own[0]
    wide = Counter(r for pairs in paired for r, n in pairs.items() if n.children())
    main = reference[0]
    while main.tag not in ARTICLES:
        inner = [c for c in main.children() if 2 * wide[c.order] >= len(pages)]
        best = max(inner, key=lambda c: mass[c.order], default=None)
        if best is None or mass[best.order] < MAIN_SHARE * mass[main.order]:
            break
        main = best
    return Wrapper([n.label for n in reference], [n.parent.order if n.parent else 0 for n in reference], sorted(label_paths(reference)), template, linked, main.order, constant)


class Host:
    """The wrappers of a host, ready to be applied."""

    def __init__(self, wrappers: Iterable[Wrapper] = ()) -> None:
        self.wrappers = [(w, set(w.paths), w.tree()) for w in wrappers]

    @staticmethod
    def read(said: str | None) -> Host:
        return Host(map(Wrapper.read, json.loads(said)) if said else ())

    def extracted(self, source: str, by_marks: bool = True) -> str:
        """The main text of a page. by_marks: whether element names, classes and roles count beside the wrapper."""
        root, _ = parsed(source)
        nodes = in_order(root)
        paths = label_paths(nodes) if self.wrappers else set()
        best = max(self.wrappers, key=lambda w: shared(paths, w[1]), default=None)
        if best is None or shared(paths, best[1]) < KIND_SHARE:
            return page_text(root, {id(n) for n in (kept_nodes(root) if by_marks else nodes)})
        wrapper, _, reference = best
        shapes = Shapes()
        shapes.give(reference)
        shapes.give(nodes)
        pairs = match(reference[0], root, shapes)
        places = {n.order: r for r, n in pairs.items()}
        main, said = pairs.get(wrapper.main, root), placed_texts(nodes)
        inside = {id(n) for n in in_subtree(main)} | {id(n) for n in headings(main)}
        keep = set()
        for n in kept_nodes(root, main) if by_marks else nodes:
            r = places.get(n.order)
            same = said.get(n.order) in wrapper.constant or r in wrapper.template and wrapper.template[r] == hashed("\n".join(n.text()))
            if id(n) in inside and not same and r not in wrapper.linked:
                keep.add(id(n))
        return page_text(root, keep)


def in_subtree(top: Node) -> Iterator[Node]:
    todo = [top]
    while todo:
        n = todo.pop()
        yield n
        todo += n.children()


def headings(main: Node) -> list[Node]:
    """Headings that stand before a node or before one that holds it; the title of an article may."""
    out, n = [], main
    while n.parent is not None:
        for c in n.parent.children():
            if c is n:
                break
            if c.tag in HEADINGS:
                out.append(c)
        n = n.parent
    return out


def extracted(pages: list[str], by_marks: bool = True) -> list[str]:
    """Main texts of pages of one host, its wrappers learnt from all of them."""
    host = Host(learnt(pages))
    return [host.extracted(p, by_marks) for p in pages]


def page_text(root: Node, keep: set[int]) -> str:
    """The texts of the nodes to keep, in page order, a line for each block."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if t := " ".join("".join(run).split()):
            out.append(t)
        run.clear()

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, tuple):
            if x[1]:
                run.append(x[0])
        else:
            flush()
            todo.append(None)
            todo += [p if isinstance(p, Node) else (p[0], id(x) in keep) for p in reversed(x.parts)]
    flush()
    return "\n".join(out)


def host_of(url: str = "url") -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def heavy_hosts(rows: DataFrame) -> DataFrame:
    """(host, count, different, most) of hosts that have more than `most` pages, a fixed part of all: fewer than HEAVY, hence broadcast."""
    most = max(64, -(-rows.count() // HEAVY))
    counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("count"), F.approx_count_distinct(F.xxhash64("html")).alias("different"))
    return F.broadcast(counts.where(F.col("count") > most).withColumn("most", F.lit(most)))


def sampled(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(host, html) of at most `sample` pages of each host, none twice. rows: (host, html).

    They are picked on narrow rows; only the html of picked pages moves on.
    """
    title = F.regexp_extract("html", r"(?i)<title[^>]*+>([^<]*+)", 1)
    spot = F.xxhash64("html")
    heavy = heavy_hosts(rows).select("host", (F.lit(8.0 * sample) / F.col("different")).alias("share"))
    keys = rows.where("html <> ''").select("host", F.xxhash64(title).alias("title"), spot.alias("spot")).join(heavy, "host", "left")
    # of hosts with many pages a share by hash is enough, so that no task gets most of the pages of one
    keys = keys.where(F.pmod(F.xxhash64("spot"), F.lit(1 << 40)) < F.coalesce("share", F.lit(1.0)) * (1 << 40)).drop("share").distinct()
    of_title = W.partitionBy("host", "title").orderBy("spot")
    turn = keys.withColumn("turn", F.row_number().over(of_title)).where(F.col("turn") <= sample)
    of_host = W.partitionBy("host").orderBy("turn", "title", "spot")
    picked = written(turn.withColumn("n", F.row_number().over(of_host)).where(F.col("n") <= sample).select("host", "spot"), "picked")
    if picked.count() * 64 <= BROADCAST_BYTES:
        picked = F.broadcast(picked)
    pages = rows.withColumn("spot", spot).join(picked, ["host", "spot"], "left_semi")
    return pages.groupBy("host", "spot").agg(F.first("html").alias("html"))


def wrappers(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Written table (host, said): the wrappers of each host that has any. rows: (host, html)."""

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pages, size = [], 0
        for _, source in sorted(zip(pdf["spot"], pdf["html"], strict=True)):
            if len(pages) < TEMPLATE_PAGES or size + len(source) <= SAMPLE_CHARS:
                pages.append(source)
                size += len(source)
        found = learnt(pages)
        return pd.DataFrame({"host": pdf["host"].tolist()[: bool(found)], "said": [json.dumps([w.said() for w in found])] * bool(found)}, dtype="object")

    return written(sampled(rows, sample).groupBy("host").applyInPandas(learn, "host string, said string"), "wrappers")


#: Ids go to workers as text and get their own type back: a column of numbers with nulls would come back rounded.
RESULT = "page_id string, url string, text string, n_chars long"


def result(rows: list[tuple], texts: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"page_id": pd.Series([r[0] for r in rows], dtype="object"), "url": pd.Series([r[1] for r in rows], dtype="object"), "text": pd.Series(texts, dtype="object"), "n_chars": [len(t) for t in texts]})


def apply_known(frames: Iterable[pd.DataFrame], known: dict[str, str], by_marks: bool = True) -> Iterator[pd.DataFrame]:
    """Pages with the wrappers of all hosts at hand."""
    hosts: dict[str, Host] = {}
    for pdf in frames:
        rows = list(zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["host"], strict=True))
        for h in {r[3] for r in rows} - hosts.keys():
            hosts[h] = Host.read(known.get(h))
        yield result(rows, [hosts[r[3]].extracted(r[2], by_marks) for r in rows])


def apply_sorted(frames: Iterable[pd.DataFrame], by_marks: bool = True) -> Iterator[pd.DataFrame]:
    """Pages in order of host and deal, the row with the wrappers of a deal before its pages."""
    key, host = None, Host()
    for pdf in frames:
        rows, texts = [], []
        for i, url, source, name, deal, said in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["host"], pdf["deal"], pdf["said"], strict=True):
            if (name, deal) != key:
                key, host = (name, deal), Host.read(said)
            if source is not None:
                rows.append((i, url))
                texts.append(host.extracted(source, by_marks))
        yield result(rows, texts)


def dealt(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Pages and wrappers (`html` null) by host; hosts with many pages go to many tasks, each with the host's wrappers."""
    heavy = heavy_hosts(rows).select("host", F.ceil(F.col("count") / F.col("most")).alias("deals"))
    deals = F.coalesce("deals", F.lit(1))
    spot = F.pmod(F.xxhash64("page_id", "url", "html"), deals)
    pages = rows.join(heavy, "host", "left").select("host", spot.alias("deal"), F.lit(None).cast("string").alias("said"), "page_id", "url", "html")
    each = F.explode(F.sequence(F.lit(0).cast("long"), deals - 1))
    heads = found.join(heavy, "host", "left").select("host", each.alias("deal"), "said", F.lit(None).cast("string").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    return pages.unionByName(heads).repartition("host", "deal").sortWithinPartitions("host", "deal", F.col("said").desc_nulls_last())


def extract_pages(pages: DataFrame, sample: int = SAMPLE, broadcast_bytes: int = BROADCAST_BYTES, by_marks: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    ship_package(pages.sparkSession)
    kind = pages.schema["page_id"].dataType
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host_of().alias("host"))
    found = wrappers(rows.select("host", "html"), sample)
    size = found.agg(F.coalesce(F.sum(F.octet_length("said") + F.octet_length("host") + 64), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        out = dealt(rows, found).mapInPandas(lambda it: apply_sorted(it, by_marks), RESULT)
    else:
        known = pages.sparkSession.sparkContext.broadcast({r["host"]: r["said"] for r in found.collect()})
        out = rows.mapInPandas(lambda it: apply_known(it, known.value, by_marks), RESULT)
    return out.withColumn("page_id", F.col("page_id").cast(kind))
