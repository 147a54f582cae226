"""Main text of web pages by wrapper induction.

Pages of one host come out of one template. A few pages of each host (REFERENCES least hashes) are parsed and their
DOM trees aligned with the first by simple tree matching: nodes of equal label in equal order under matched parents.
Nodes whose text is the same in all references belong to the template; where it varies there is a slot. The slot that
holds the article is found by going down from the body towards the varying text for as long as one child has most of
it. The wrapper of a host is that path, with the lines that stand in the slot on every reference. A page is parsed,
its tree is matched with the wrapper's path, and the text below the matched slot is its content, without the parts
that are never the article by their element or name and without the constant lines.

A host with a single page, or a page that its host's wrapper doesn't match, is read by the path that the page itself
gives. Names of class, id or role leave a node out, unless the references show that it holds the article: where the
page's article or main elements stand only below such nodes, or most of the varying text does, it is a layout
container that is named after what else it holds or doesn't hold. Constant lines need CERTAIN references that otherwise have little in common: copies of one article on a host
don't make it a template.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import beside

REFERENCES = 8
CERTAIN = 5
CELLS = 1 << 22
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+")
# Elements by how a browser treats them.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span "
                    "strike strong sub sup time tt u var wbr".split())
_LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th figcaption".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
                    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_NOT_TEXT = frozenset("head script style noscript template title meta link iframe object embed svg math canvas video audio map nav footer "
                      "aside form button select option input textarea fieldset menu dialog".split())
# Names, as whole words of class, id or role, of what is not the article.
_NOT_NAMES = frozenset(
    "ad ads advert advertisement advertisements adverts adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside footer comment comments respond disqus cookie cookies consent gdpr notice notification alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended pagination pager toolbar widget masthead "
    "skip complementary contentinfo search".split())
_SECTIONS = frozenset(("article", "main"))
# Of the names, those of what readers write: it varies as the article does, and may be longer.
_READERS = frozenset("comment comments respond disqus".split())


class Node:
    """`named`: the class, id and role words of a node that is out by them alone, in one text; else empty."""
    __slots__ = ("tag", "label", "out", "named", "children", "size", "print")

    def __init__(self, tag: str, label: str, out: bool, named: str = ""):
        self.tag, self.label, self.out, self.named, self.children, self.size, self.print = tag, label, out, named, [], 0, 0


def _names(attributes: str) -> tuple[list[str], bool]:
    named, hidden = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        if key in ("class", "id", "role"):
            named += _NAME.findall(html.unescape(m[2] or m[3] or m[4] or "").lower())
        hidden |= key == "hidden"
    return named, hidden


def parse(text: str | None) -> Node:
    """The page's tree; unclosed and misplaced tags are mended the usual way, a cut-off tag at the end is dropped."""
    root = Node("html", "html", False)
    stack, at, text = [root], 0, text or ""
    # How many elements of a tag are open: an end tag of none is passed over without a search.
    opened: Counter = Counter()
    while True:
        m = _TOKEN.search(text, at)
        words = text[at:m.start() if m else len(text)]
        if words:
            stack[-1].children.append(html.unescape(words) if "&" in words else words)
        if not m:
            return measured(root)
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    _leave(stack, i, opened)
                    break
                # An inline end tag doesn't reach out of its block.
                if tag in _INLINE and stack[i].tag not in _INLINE:
                    break
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if tag in _ENDS_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            _close(stack, tag, opened)
        if tag == "html":
            continue
        named, hidden = _names(m[3]) if m[3].strip(" /") else ([], False)
        node_named = ""
        out = tag in _NOT_TEXT or hidden
        if tag == "header" and not any(n.tag in _SECTIONS for n in stack):
            out = True
        if tag in _SECTIONS or tag in ("body", "html"):
            out = hidden or "comment" in named or "comments" in named
        elif not out and not _NOT_NAMES.isdisjoint(named):
            node_named, out = f"{tag} {' '.join(named)}", True
        node = Node(tag, f"{tag}.{named[0] if named else ''}", out, node_named)
        if tag == "body" and (head := next((i for i, n in enumerate(stack) if n.tag == "head"), 0)):
            _leave(stack, head, opened)
        stack[-1].children.append(node)
        if tag not in _VOID and not m[0].endswith("/>"):
            stack.append(node)
            opened[tag] += 1


def _leave(stack: list[Node], i: int, opened: Counter) -> None:
    for node in stack[i:]:
        opened[node.tag] -= 1
    del stack[i:]


def measured(root: Node) -> Node:
    """The tree with each node's visible characters and a print of its text, from one pass over it."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if not isinstance(c, str) and not c.out]
    for node in reversed(order):
        parts = []
        for c in node.children:
            if isinstance(c, str):
                words = " ".join(c.split())
                node.size += len(words)
                parts.append(words)
            elif not c.out:
                node.size += c.size
                parts.append(c.print)
        node.print = hash(tuple(p for p in parts if p))
    return root


def held(roots: list[Node]) -> set[str]:
    """The names of nodes that are out by them but hold the article, from pages of one host.

    Pages with an article or main element in sight need none. Of the others, the nodes that hold most of the text (own
    text, without that of deeper such nodes) come back, else those above the largest article or main element. Text of
    readers counts only where hardly any stands above it. Of two or more pages only text counts that not all have.
    """
    pages = []
    for root in roots:
        # Texts and sections with the names of the nodes above them that are out by name.
        texts, sections, todo = [], [], [(root, ())]
        while todo:
            node, above = todo.pop()
            for c in node.children:
                if isinstance(c, str):
                    if words := " ".join(c.split()):
                        texts.append((words, above))
                elif c.named or not c.out:
                    todo.append((c, (*above, c.named) if c.named and c.named not in above else above))
                    if c.tag in _SECTIONS:
                        sections.append((c, todo[-1][1]))
        pages.append((texts, sections))
    common = set.intersection(*({words for words, _ in texts} for texts, _ in pages)) if len(pages) > 1 else set()
    found: set[str] = set()
    mass: Counter = Counter()
    hidden = [(texts, sections) for texts, sections in pages if all(above for _, above in sections)]
    for texts, _ in hidden:
        for words, above in texts:
            if words not in common:
                mass[above] += len(words)
    total = sum(mass.values())
    for above, n in list(mass.items()):
        readers = any(not _READERS.isdisjoint(names.split()) for names in above)
        if above and 2 * n > total and (not readers or 10 * sum(mass[above[:i]] for i in range(len(above))) < total):
            found.update(above)
            return found
    for _, sections in hidden:
        if sections:
            found.update(max(sections, key=lambda s: _whole(s[0]))[1])
    return found


def _whole(node: Node) -> int:
    """Characters below a node."""
    n, todo = 0, [node]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, str):
                n += len(c)
            else:
                todo.append(c)
    return n


def released(root: Node, names: set[str]) -> Node:
    """The tree with the nodes of these names in it, measured again."""
    todo = [root]
    while todo:
        node = todo.pop()
        node.out &= node.named not in names
        node.size = 0
        todo += [c for c in node.children if not isinstance(c, str)]
    return measured(root)


_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIERS = frozenset("ul ol dl table select article section div main aside nav".split())


def _close(stack: list[Node], tag: str, opened: Counter) -> None:
    """A start tag that ends an open paragraph, or an open item of its own list or row."""
    ends = _SIBLINGS.get(tag, {"p"})
    if not any(opened[t] for t in ends):
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in ends:
            _leave(stack, i, opened)
            return
        if stack[i].tag in _BARRIERS:
            return


def lines(node: Node) -> list[str]:
    """The blocks of text below a node, in page order, white space evened out; left-out parts are not entered."""
    found: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            line = " ".join("".join(run).split())
            if line:
                found.append(line)
            run.clear()

    # (node, where it is at) pairs: pages nest deeper than calls can.
    todo: list = [(node, 0)]
    while todo:
        n, i = todo.pop()
        if i == 0 and n.tag not in _INLINE:
            flush()
        if i == len(n.children):
            if n.tag not in _INLINE:
                flush()
            continue
        todo.append((n, i + 1))
        child = n.children[i]
        if isinstance(child, str):
            run.append(child)
        elif child.tag == "br":
            run.append(" ")
        elif not child.out:
            todo.append((child, 0))
    flush()
    return found


def _kids(node: Node) -> list[Node]:
    return [c for c in node.children if not isinstance(c, str) and not c.out and c.tag not in _INLINE and c.tag not in _VOID]


def _row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common runs of x and each front part of y."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        row[1:] = np.maximum(row[1:], np.where(y == v, row[:-1] + 1, 0))
        row = np.maximum.accumulate(row)
    return row


def _common(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common run, in order. Where the table has more than CELLS cells, x is halved and y cut where
    both halves together do best, so memory grows with the sum of the lengths."""
    n, m = len(x), len(y)
    if n > 1 and (n + 1) * (m + 1) > CELLS:
        half = n // 2
        at = int((_row(x[:half], y) + _row(x[half:][::-1], y[::-1])[::-1]).argmax())
        return _common(x[:half], y[:at]) + [(half + i, at + j) for i, j in _common(x[half:], y[at:])]
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        row = np.maximum(best[i + 1, :m], np.where(y == x[i], best[i + 1, 1:] + 1, 0))
        best[i, :m] = np.maximum.accumulate(row[::-1])[::-1]
    found, i, j = [], 0, 0
    while i < n and j < m:
        if x[i] == y[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return found


def match(a: list[str], b: list[Node]) -> list[int | None]:
    """Simple tree matching of one level: the longest common run of labels in order; for each of a its place in b.

    Matching goes down only between matched parents, so levels are aligned one at a time. Equal labels at both ends
    of a level are matched without a table."""
    other = [x.label for x in b]
    out: list[int | None] = [None] * len(a)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == other[lo]:
        out[lo] = lo
        lo += 1
    end_a, end_b = len(a), len(b)
    while end_a > lo and end_b > lo and a[end_a - 1] == other[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
        out[end_a] = end_b
    n, m = end_a - lo, end_b - lo
    if not n or not m:
        return out
    number: dict[str, int] = {}
    x = np.array([number.setdefault(k, len(number)) for k in a[lo:end_a]])
    y = np.array([number.setdefault(k, len(number)) for k in other[lo:end_b]])
    for i, j in _common(x, y):
        out[lo + i] = lo + j
    return out


def _entered(labels: list[str], go: int, kids: list[Node]) -> int | None:
    """The place of a level's branch among a page's nodes, aligned from the front and from the back; where a page has
    more or fewer nodes of the branch's label these differ, and the one with more text is taken."""
    front, back = match(labels, kids)[go], match(labels[::-1], kids[::-1])[len(labels) - 1 - go]
    places = [p for p in (front, None if back is None else len(kids) - 1 - back) if p is not None]
    return max(places, key=lambda p: kids[p].size, default=None)


def _stops(node: Node, kids: list[Node]) -> bool:
    return node.tag in _SECTIONS or not kids


def _body(root: Node) -> Node:
    return next((c for c in root.children if not isinstance(c, str) and c.tag == "body"), root)


def induce(pages: list[str]) -> dict:
    """The wrapper of a host from some of its pages: path (labels of each level, and which to enter), constant lines, and
    the names that leave nothing out."""
    trees = [parse(p) for p in dict.fromkeys(pages)]
    names = held(trees)
    at, path = [_body(released(t, names) if names else t) for t in trees], []
    while True:
        first, kids = at[0], [_kids(n) for n in at]
        own = kids[0]
        if _stops(first, own):
            break
        # How much text varies below each child of the first page's node: what some aligned node has else.
        places = [match([k.label for k in own], other) for other in kids[1:]]
        mass = []
        for i, child in enumerate(own):
            others = [kids[p + 1][place[i]] for p, place in enumerate(places) if place[i] is not None]
            varies = not others or any(o.print != child.print for o in others)
            mass.append(child.size + sum(o.size for o in others) if varies else 0)
        go = max(range(len(own)), key=lambda i: (own[i].tag in _SECTIONS, mass[i]))
        if own[go].tag not in _SECTIONS and (own[go].tag in _LINES or 10 * mass[go] < 8 * sum(n.size for n in at)):
            break
        path.append([[k.label for k in own], go])
        at = [own[go]] + [kids[p + 1][place[go]] for p, place in enumerate(places) if place[go] is not None]
    sets = [set(lines(n)) for n in at]
    apart = []
    for s in sets:
        if s and all(2 * len(s & t) < min(len(s), len(t)) or len(s & t) <= 2 and min(len(s), len(t)) > 2 for t in apart):
            apart.append(s)
    constant = sorted(set.intersection(*apart)) if len(apart) >= CERTAIN else []
    return {"path": path, "constant": constant, "held": sorted(names)}


def slot(root: Node, wrapper: dict | None) -> Node:
    """The node that holds the article: down the wrapper's path for as long as it matches, then by the page itself."""
    node, entered = _body(root), 0
    for labels, go in (wrapper or {}).get("path", ()):
        kids = _kids(node)
        place = _entered(labels, go, kids)
        if place is None:
            break
        node, entered = kids[place], entered + 1
    if wrapper and entered == len(wrapper["path"]) and (entered or not any(k.tag in _SECTIONS for k in _kids(node))):
        return node
    while True:
        kids = _kids(node)
        inner = [k for k in kids if k.tag in _SECTIONS]
        if node.tag == "article" or not kids or len(inner) > 1:
            return node
        if not inner and 10 * max(k.size for k in kids) < 8 * node.size:
            return node
        go = inner[0] if inner else max(kids, key=lambda k: k.size)
        if go.tag in _LINES:
            return node
        node = go


def main_text(page: str | None, wrapper: dict | None = None) -> str:
    root = parse(page)
    names = set(wrapper["held"]) if wrapper else held([root])
    node = slot(released(root, names) if names else root, wrapper)
    constant = set(wrapper["constant"]) if wrapper else ()
    return " ".join(x for x in lines(node) if x not in constant)


def _induce(part: pa.Table) -> pa.Table:
    order = sorted(zip(part["drawn"].to_pylist(), part["html"].to_pylist()), key=lambda r: (r[0], r[1]))
    pages = [h for _, h in order if h]
    if not pages:
        return pa.table({"host": pa.array([], pa.string()), "wrapper": pa.array([], pa.string())})
    return pa.table({"host": part["host"].slice(0, 1), "wrapper": pa.array([json.dumps(induce(pages))])})


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, dict] = {}
    for batch in batches:
        texts = []
        for page, wrapper in zip(batch.column(2), batch.column(3).to_pylist()):
            if wrapper is not None and wrapper not in known:
                if len(known) > 5_000:
                    known.clear()
                known[wrapper] = json.loads(wrapper)
            texts.append(main_text(page.as_py(), known.get(wrapper)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages; text is empty where a page has no main text.

    Null and empty pages give an empty text; pages without a host are read on their own. Repeated rows give repeated
    results. Other columns are not read. The references of a host are found from its urls and ids alone; only they
    are read twice. Where the wrappers of all hosts are within a measured size, pages stay where they are and the
    wrappers are sent to them; beyond it a page travels with its host's wrapper, never with other pages.
    """
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.col(html_col).cast("string").alias("html"),
                        F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)).alias("host"))
    base = base.withColumn("drawn", F.xxhash64("page_id", "url"))
    turn = F.pmod("drawn", F.lit(REFERENCES))
    named = base.where("host <> ''")
    least = named.groupBy("host", turn.alias("turn")).agg(F.min("drawn").alias("drawn")).select("host", "drawn")
    least = beside(least, F.length("host") + 32)
    chosen = named.join(least, ["host", "drawn"]).select("host", "drawn", "html").dropDuplicates(["host", "drawn"])
    wrappers = chosen.groupBy("host").applyInArrow(_induce, "host string, wrapper string")
    wrappers = beside(wrappers, F.length("host") + F.length("wrapper") + 32)
    return base.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
