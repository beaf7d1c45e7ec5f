"""Main text of web pages by wrapper induction.

Pages of one host are built from a few templates.  Each page becomes a tree of shapes (tag and class; runs of like
siblings are one node).  The frequent and unlike shapes of a host are its main exemplars; shapes unlike all of those are
gone through in order of frequency until each is like an exemplar, however many that takes.  Every page is aligned with
the most similar main exemplar and with the most similar of all by simple tree matching, so its blocks of text fall into
slots of both.  Over all pages of
the host a text is counted at its slot: what stands in nearly all pages that fill the slot is constant, so template;
slots that vary are content.  Within the content, elements that say they are something else (menus, footers, forms,
adverts, comments ...) are left out, and the article is the marked one or else the part with the most running text.
The template counts inside a marked article too.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm import kernels as K

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
MARK = re.compile(r"[>\"']")
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object"}
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: What a start tag ends, if that is open (up to the nearest of the barriers).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
BARRIER = {"ul", "ol", "dl", "table", "select", "body", "html", "article", "section", "div", "blockquote"}
DROP_TAGS = {"head", "nav", "footer", "aside", "form", "button", "select", "input", "dialog", "menu"} | RAW - {"title"}
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "alertdialog", "form"}
#: Running text: a class word there must be plain about it.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dd", "dt", "pre", "blockquote", "figure", "figcaption"}
_SURE = r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|newsletter|subscri\w+|paywall|sidebar|menu\w*|nav\w*|breadcrumbs?|footer|masthead|comments?|commentlist|replies|respond|disqus|pagination|pager|login|signup|copyright"
_LIKELY = r"banner|notice|notification|alert|popup|modal|overlay|topbar|toolbar|share|sharing|social|related|recommend\w*|widget\w*|search|skip|hidden"
DROP_WORDS, DROP_WORDS_PROSE = (re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I) for words in (f"{_SURE}|{_LIKELY}", _SURE))
#: Ways in which a tag may fail to end before quotes stop counting on a page.
BAD_TAGS = 64


class Node:
    __slots__ = ("attrs", "children", "index", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None, index: int):
        self.tag, self.attrs, self.parent, self.index, self.children = tag, attrs, parent, index, []


class _Tags:
    """Ends of tags, in time linear in the page however broken it is."""

    def __init__(self, page: str):
        self.page, self.last, self.bad = page, {c: page.rfind(c) for c in ">\"'"}, 0

    def end(self, at: int) -> int:
        """Place after the tag that is open at `at`; quoted marks don't end it.  -1: it never ends."""
        if at > self.last[">"]:
            return -1
        pos = at
        while self.bad < BAD_TAGS:
            m = MARK.search(self.page, pos)
            if m is None:
                self.bad += 1
                break
            c, pos = m[0], m.end()
            if c == ">":
                return pos
            if m.start() < self.last[c]:
                pos = self.page.index(c, pos) + 1
        return self.page.index(">", at) + 1


def parse(page: str) -> list[Node]:
    """The nodes of a page in page order, the root first; children are nodes and strings.  Never fails: what can't be read as a tag is text."""
    root = Node("root", {}, None, 0)
    nodes, stack, depths = [root], [root], {}
    tags = _Tags(page)
    barriers: list[int] = []
    text = 0  # where text that isn't taken yet begins
    at = page.find("<")

    def add(end: int) -> None:
        if end > text:
            piece = page[text:end]
            stack[-1].children.append(html.unescape(piece) if "&" in piece else piece)

    def close(depth: int) -> None:
        while len(stack) > depth:
            n = stack.pop()
            depths[n.tag].pop()
            if n.tag in BARRIER:
                barriers.pop()

    while at >= 0:
        after = page[at + 1 : at + 2]
        end = -1
        if after == "!" or after == "?":
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end = len(page) if end < 0 else end + 3
            elif page.startswith("<![CDATA[", at):
                end = page.find("]]>", at)
                end = len(page) if end < 0 else end + 3
            elif at < tags.last[">"]:
                end = page.index(">", at) + 1
            if end > 0:
                add(at)
                text = end
        elif m := NAME.match(page, at + 1 + (after == "/")):
            end = tags.end(m.end())
            if end > 0:
                add(at)
                text = end
                tag = m[0].lower()
                if after == "/":
                    if depths.get(tag):
                        close(depths[tag][-1])
                else:
                    inside = page[m.end() : end - 1]
                    _open(tag, inside, nodes, stack, depths, barriers, close)
                    if tag in RAW and not inside.rstrip().endswith("/"):
                        over = RAW_END[tag].search(page, end)
                        text = end = over.end() if over else len(page)
        at = page.find("<", end if end > 0 else at + 1)
    add(len(page))
    return nodes


def _open(tag: str, inside: str, nodes: list[Node], stack: list[Node], depths: dict[str, list[int]], barriers: list[int], close: Callable[[int], None]) -> None:
    """A start tag: closes what it ends, then opens its node unless that can hold nothing."""
    barrier = barriers[-1] if barriers else 0
    if tag not in INLINE and tag not in VOID and tag not in RAW and depths.get("p") and depths["p"][-1] > barrier:
        close(depths["p"][-1])
    if ends := ENDS.get(tag):
        barrier = barriers[-1] if barriers else 0
        depth = max((depths[t][-1] for t in ends if depths.get(t)), default=0)
        if depth > barrier:
            close(depth)
            while stack[-1].tag in ends:
                close(len(stack) - 1)
    attrs = {}
    if inside.strip():
        for k, a, b, c in ATTR.findall(inside):
            attrs.setdefault(k.lower(), html.unescape(a or b or c))
    n = Node(tag, attrs, stack[-1], len(nodes))
    nodes.append(n)
    stack[-1].children.append(n)
    if tag in VOID or tag in RAW or inside.rstrip().endswith("/"):
        return
    depths.setdefault(tag, []).append(len(stack))
    if tag in BARRIER:
        barriers.append(len(stack))
    stack.append(n)


def boilerplate(n: Node, in_article: bool) -> bool:
    """Says of itself that it isn't the article."""
    if n.tag == "header":
        return not in_article
    if n.tag in DROP_TAGS:
        return True
    if not n.attrs:
        return False
    if n.attrs.get("role", "").lower() in DROP_ROLES or "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true":
        return n.tag != "figure"
    own = n.attrs.get("class", ""), n.attrs.get("id", "")
    if n.tag in ("html", "body", "article", "main", "h1"):
        return bool(n.tag == "article" and re.search(r"comment|related|promo", " ".join(own), re.I))
    words = DROP_WORDS_PROSE if n.tag in PROSE else DROP_WORDS
    return any(words.search(x) for x in own)


class Block:
    __slots__ = ("link", "node", "text")

    def __init__(self, node: Node):
        self.node, self.text, self.link = node, [], 0


def blocks(root: Node) -> list[Block]:
    """Texts between block boundaries that aren't boilerplate, in page order."""
    out: list[Block] = []
    stack: list[tuple] = [("in", root, False, False)]
    cur = Block(root)

    def close(node):
        nonlocal cur
        if cur.text and (t := " ".join("".join(cur.text).split())):
            cur.text = t
            out.append(cur)
        cur = Block(node)

    while stack:
        what, x, link, article = stack.pop()
        if what == "text":
            cur.text.append(x)
            cur.link += len(x) if link else 0
        elif what == "out":
            close(x.parent or x)
        elif x.tag == "br":
            cur.text.append(" ")
        elif x is root or not (x.tag == "title" or boilerplate(x, article)):
            if x.tag not in INLINE:
                close(x)
                stack.append(("out", x, link, article))
            link = link or x.tag == "a"
            article = article or x.tag in ("article", "main")
            stack += [("text" if isinstance(c, str) else "in", c, link, article) for c in reversed(x.children)]
    close(root)
    return out


def digest(*parts) -> int:
    """A signed 64-bit hash of texts and numbers, alike in every process."""
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


#: Nodes with more runs of children are lists: children of one kind are one.
LISTED = 32


class Shape:
    """The tree of a page's block elements: keys (tag and class) and children by node, in page order, the root first."""

    def __init__(self, keys: list[str], kids: list[list[int]]):
        self.keys, self.kids = keys, kids

    def written(self) -> str:
        depth = [0] * len(self.keys)
        for i, own in enumerate(self.kids):
            for k in own:
                depth[k] = depth[i] + 1
        return "\n".join(f"{d} {k}" for d, k in zip(depth, self.keys, strict=True))

    @classmethod
    def read(cls, text: str) -> Shape:
        keys, kids, path = [], [], []
        for i, line in enumerate(text.split("\n")):
            d, _, key = line.partition(" ")
            del path[int(d) :]
            if path:
                kids[path[-1]].append(i)
            path.append(i)
            keys.append(key)
            kids.append([])
        return cls(keys, kids)


def _key(n: Node) -> str:
    css = n.attrs.get("class", "")
    return f"{n.tag}.{' '.join(re.sub('[0-9]+', '', css).split())}" if css else n.tag


def shape(nodes: list[Node]) -> tuple[Shape, list[int]]:
    """The shape of a page, and the shape's node of each node.

    Inline elements belong to the block around them; like siblings in a row are one node, and so are all like
    children of a repeated node or of a long list."""
    keys: list[str] = []
    kids: list[list[int]] = []
    of = [0] * len(nodes)
    todo: list[tuple[str, list[Node], int]] = [("root", [nodes[0]], -1)]
    while todo:
        key, own, up = todo.pop()
        at = len(keys)
        keys.append(key)
        kids.append([])
        if up >= 0:
            kids[up].append(at)
        runs: list[tuple[str, list[Node]]] = []
        for n in own:
            of[n.index] = at
            stack = list(reversed(n.children))
            while stack:
                c = stack.pop()
                if isinstance(c, str) or c.tag in RAW or c.tag in VOID:
                    continue
                if c.tag in INLINE:
                    of[c.index] = at
                    stack += reversed(c.children)
                elif runs and runs[-1][0] == (k := _key(c)):
                    runs[-1][1].append(c)
                else:
                    runs.append((_key(c), [c]))
        if len(own) > 1 or len(runs) > LISTED:
            by: dict[str, list[Node]] = {}
            for k, some in runs:
                by.setdefault(k, []).extend(some)
            runs = list(by.items())
        todo += [(k, some, at) for k, some in reversed(runs)]
    return Shape(keys, kids), of


def _match_children(a: Shape, b: Shape, i: int, j: int, score: dict[tuple[int, int], int]) -> list[list[int]]:
    """Best sums of an ordered matching of the first x children of i with the first y of j."""
    xs, ys = a.kids[i], b.kids[j]
    table = [[0] * (len(ys) + 1)]
    for p in xs:
        last, row = table[-1], [0]
        for y, q in enumerate(ys):
            best = max(last[y + 1], row[y])
            if (p, q) in score and last[y] + score[p, q] > best:
                best = last[y] + score[p, q]
            row.append(best)
        table.append(row)
    return table


def align(a: Shape, b: Shape) -> tuple[int, dict[int, int]]:
    """Simple tree matching: the size of the largest ordered top-down matching, and which node of b each node of a is."""
    score: dict[tuple[int, int], int] = {}
    todo = [(0, 0, False)] if a.keys[0] == b.keys[0] else []
    while todo:
        i, j, done = todo.pop()
        if done:
            score[i, j] = 1 + _match_children(a, b, i, j, score)[-1][-1]
        else:
            todo.append((i, j, True))
            by: dict[str, list[int]] = {}
            for q in b.kids[j]:
                by.setdefault(b.keys[q], []).append(q)
            todo += [(p, q, False) for p in a.kids[i] for q in by.get(a.keys[p], ())]
    found: dict[int, int] = {}
    pairs = [(0, 0)] if score else []
    while pairs:
        i, j = pairs.pop()
        found[i] = j
        table = _match_children(a, b, i, j, score)
        x, y = len(a.kids[i]), len(b.kids[j])
        while x and y:
            p, q = a.kids[i][x - 1], b.kids[j][y - 1]
            if table[x][y] == table[x - 1][y]:
                x -= 1
            elif table[x][y] == table[x][y - 1]:
                y -= 1
            else:
                pairs.append((p, q))
                x, y = x - 1, y - 1
    return score.get((0, 0), 0), found


#: A page is aligned with an exemplar if at least ALIGNED of their nodes match; exemplars of a host are less than ALIKE.
#: Main exemplars are EXEMPLARS at most, of CANDIDATES shapes; further rounds take all that is unlike them.
ALIGNED, ALIKE, EXEMPLARS, CANDIDATES = 0.3, 0.7, 8, 32


def nearest(own: Shape, exemplars: list[Shape]) -> tuple[int, dict[int, int]]:
    """The most similar exemplar (-1: none is similar enough) and the slots of own's nodes."""
    best, at, slots = ALIGNED, -1, {}
    for k, e in enumerate(exemplars):
        n, found = align(own, e)
        alike = 2 * n / (len(own.keys) + len(e.keys))
        if alike >= best and (at < 0 or alike > best):
            best, at, slots = alike, k, found
    return at, slots


def like(a: Shape, b: Shape) -> bool:
    """Whether ALIKE of the nodes match; sizes and keys are bounds that spare the matching."""
    need = ALIKE * (len(a.keys) + len(b.keys))
    return 2 * min(len(a.keys), len(b.keys)) >= need and 2 * (Counter(a.keys) & Counter(b.keys)).total() >= need and 2 * align(a, b)[0] >= need


def choose(shapes: list[Shape], most: int | None = None) -> list[Shape]:
    """Exemplars from shapes in order of frequency: each that is unlike those before; `most` of them if that is set."""
    out: list[Shape] = []
    for s in shapes:
        if (most is None or len(out) < most) and not any(like(s, e) for e in out):
            out.append(s)
    return out


def placed(own: Shape, exemplars: list[Shape], main: int) -> list[tuple[int, dict[int, int]]]:
    """The most similar main exemplar (the first ones) and, if it is another, the most similar of all, with own's slots there."""
    out = [nearest(own, exemplars[:main])]
    if main < len(exemplars):
        k, slots = nearest(own, exemplars[main:])
        best = 2 * len(slots) / (len(own.keys) + len(exemplars[main + k].keys)) if k >= 0 else 0.0
        first = 2 * len(out[0][1]) / (len(own.keys) + len(exemplars[out[0][0]].keys)) if out[0][0] >= 0 else 0.0
        if best > first:
            out.append((main + k, slots))
    return [x for x in out if x[0] >= 0]


class Template:
    """What is known of a host: exemplars, how many of them are main ones, and the constant texts of their slots as (exemplar, slot, text hash)."""

    def __init__(self, exemplars: list[Shape], constant: set[tuple[int, int, int]], main: int | None = None):
        self.exemplars, self.constant, self.main = exemplars, constant, len(exemplars) if main is None else main
        self._slots: dict[int, list[tuple[int, dict[int, int]]]] = {}

    def slots(self, own: Shape) -> list[tuple[int, dict[int, int]]]:
        key = digest(own.written())
        if key not in self._slots:
            if len(self._slots) > 2000:
                self._slots.clear()
            self._slots[key] = placed(own, self.exemplars, self.main)
        return self._slots[key]


def constants(nodes: list[Node], own: list[Block], known: Template) -> list[bool]:
    """Which blocks are template; none if that would be over MOST of the text, as among near copies of one page."""
    tree, of = shape(nodes)
    at = known.slots(tree)
    gone = [any((k, slots.get(of[b.node.index], -1), digest(b.text)) in known.constant for k, slots in at) for b in own]
    return gone if sum(len(b.text) for b, g in zip(own, gone, strict=True) if g) <= MOST * sum(len(b.text) for b in own) else [False] * len(own)


def _article(nodes: list[Node], own: list[Block]) -> Node:
    """The element that holds the article: the marked one with the most text, or else the one with the most running text."""
    run, chars = [0] * len(nodes), [0] * len(nodes)
    for b in own:
        chars[b.node.index] += len(b.text)
        if b.link * 2 < len(b.text) and (len(b.text) > 40 or b.node.tag in ("p", "h1", "h2", "h3")):
            run[b.node.index] += len(b.text)
    for n in reversed(nodes[1:]):
        run[n.parent.index] += run[n.index]
        chars[n.parent.index] += chars[n.index]
    marked = [n for n in nodes if chars[n.index] and (n.tag in ("article", "main") or n.attrs.get("role") in ("main", "article") or n.attrs.get("itemprop") == "articleBody")]
    if marked:
        arts = [n for n in marked if n.tag == "article" or n.attrs.get("role") == "article"]
        return max(arts or marked, key=lambda n: chars[n.index])
    at = next((n for n in nodes if n.tag == "body" and chars[n.index]), nodes[0])
    while True:  # down while one child holds nearly all running text
        inside = [c for c in at.children if not isinstance(c, str) and run[c.index] >= 0.85 * max(1, run[at.index]) and c.tag not in ("p", "h1", "li", "td")]
        if not inside:
            return at
        at = inside[0]


def main_text(page: str | None, known: Template | None = None) -> str:
    """The text of a page; known: the template of its host."""
    nodes = parse(page or "")
    own = blocks(nodes[0])
    if not own:
        return ""
    if known is not None and known.constant:
        own = [b for b, g in zip(own, constants(nodes, own, known), strict=True) if not g]
    art = _article(nodes, own).index
    inside = [False] * len(nodes)
    for n in nodes:
        inside[n.index] = n.index == art or (n.parent is not None and inside[n.parent.index])
    return " ".join(b.text for b in own if inside[b.node.index])


_COUNT = "host_ long, shape_ long, node_ int, word_ long, same_ long, tree_ string"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A page's texts at its shape's nodes, its nodes (word null), itself (node -1) and its shape (node -2); same is the hash of all its texts."""
    names, types = [x.split()[0] for x in _COUNT.split(", ")], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            rows: list[tuple] = []
            for host, page in zip(batch.column(0)[a : a + 256].to_pylist(), batch.column(1)[a : a + 256].to_pylist(), strict=True):
                nodes = parse(page)
                own = blocks(nodes[0])
                if not own:
                    continue
                tree, of = shape(nodes)
                text = tree.written()
                key = digest(text)
                at = {(of[b.node.index], digest(b.text)) for b in own}
                same = digest(*(digest(b.text) for b in own))
                rows += [(host, key, n, w, same, None) for n, w in at]
                rows += [(host, key, n, None, same, None) for n in {n for n, _ in at} | {-1}]
                if (host, key) not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add((host, key))
                    rows.append((host, key, -2, None, 0, text))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _choose(most: int | None):
    """The exemplars of a host from its rows; `most` of them if that is set."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("pages", "descending"), ("shape_", "ascending")])
        out = [s.written() for s in choose([Shape.read(t) for t in table.column("tree_").to_pylist()], most)]
        return pa.table({"host_": pa.array([key[0].as_py()], pa.int64()), "exemplars": pa.array([out], pa.list_(pa.string()))})

    return run


def _unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shapes (last column: exemplars of the host) that are like none of the exemplars."""
    held: dict[tuple, list[Shape]] = {}
    for batch in batches:
        keep = []
        for tree, exemplars in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
            texts = tuple(exemplars)
            if texts not in held:
                if len(held) > 64:
                    held.clear()
                held[texts] = [Shape.read(t) for t in texts]
            own = Shape.read(tree)
            keep.append(not any(like(own, e) for e in held[texts]))
        yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1, 2, 3])


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots of the nodes of each shape of a host: host_, shape_, node_, exemplar, slot."""
    held: dict[tuple, list[Shape]] = {}
    for batch in batches:
        for host, key, tree, exemplars, main in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            texts = tuple(exemplars)
            if texts not in held:
                if len(held) > 64:
                    held.clear()
                held[texts] = [Shape.read(t) for t in texts]
            for k, found in placed(Shape.read(tree), held[texts], main):
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([host] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(list(found), pa.int32()), pa.array([k] * n, pa.int32()), pa.array(list(found.values()), pa.int32())], ["host_", "shape_", "node_", "exemplar", "slot"])


def _made(exemplars: list[str], main: int, constant: list[dict]) -> Template:
    return Template([Shape.read(t) for t in exemplars], {(x["exemplar"], x["slot"], x["word_"]) for x in constant}, main)


def _texts(pages: list, known: list[Template | None]) -> list[pa.Array]:
    texts = [main_text(p, k) for p, k in zip(pages, known, strict=True)]
    return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]


def _extract(templates):
    """Rows of page, host and the columns to keep; templates: broadcast, by host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Template] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                known = []
                for host in part.column(1).to_pylist():
                    if host in templates.value and host not in made:
                        if len(made) > 64:
                            made.clear()
                        made[host] = _made(*templates.value[host])
                    known.append(made.get(host))
                yield pa.RecordBatch.from_arrays([*part.columns[2:], *_texts(part.column(0).to_pylist(), known)], [*part.schema.names[2:], "text", "n_chars"])

    return run


def _extract_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of page, host, is_page, exemplars, main, constant and the columns to keep, each host's template right before its pages."""
    made: tuple[int, Template] | None = None
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            known = []
            for host, is_page, exemplars, main, constant in zip(*(part.column(c).to_pylist() for c in (1, 2, 3, 4, 5)), strict=True):
                if not is_page:
                    made = host, _made(exemplars, main, constant)
                else:
                    known.append(made[1] if made and made[0] == host else None)
            own = part.filter(part.column(2))
            yield pa.RecordBatch.from_arrays([*own.columns[6:], *_texts(own.column(0).to_pylist(), known)], [*own.schema.names[6:], "text", "n_chars"])


#: A text is template in SUPPORT of the different pages that fill its slot, two at least.
SUPPORT, MOST = 0.8, 0.6
BROADCAST_BYTES, SALTS = 32 << 20, 16


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame, page: str = "page_", host: str = "host_") -> DataFrame:
    """host_, exemplars, main_ (how many of them are main ones), constant (exemplar, slot, word_) of each host with constant texts, learned from all its pages."""
    seen = pages.where(f"{page} is not null").select(host, page).mapInArrow(_count, _COUNT)
    key = ["host_", "shape_", "node_", "word_"]
    # Both counts are summed by task before they are dealt, so a host of any size is no large group.
    counts = K.stored(seen.distinct().groupBy(*key, "tree_").agg(F.count("*").cast("int").alias("n")), "html-counts")
    shapes = counts.where("node_ = -2").select("host_", "shape_", "tree_").join(counts.where("node_ = -1").select("host_", "shape_", F.col("n").alias("pages")), ["host_", "shape_"])
    common = Window.partitionBy("host_").orderBy(F.desc("pages"), "shape_")
    frequent = lambda df, n: df.withColumn("rank_", F.row_number().over(common)).where(f"rank_ <= {n}").drop("rank_")
    chosen = lambda df, n, most: K.stored(frequent(df, n).groupBy("host_").applyInArrow(_choose(most), "host_ long, exemplars array<string>"), "html-exemplars")
    new = chosen(shapes, CANDIDATES, EXEMPLARS)
    rounds, rest, n = new.withColumn("round_", F.lit(0)), shapes, CANDIDATES
    while True:  # until every shape is like an exemplar; rounds of twice as many candidates each
        rest = K.stored(rest.select("host_", "shape_", "tree_", "pages").join(new, "host_").select("host_", "shape_", "tree_", "pages", "exemplars").mapInArrow(_unlike, "host_ long, shape_ long, tree_ string, pages int"), "html-rest")
        if not rest.limit(1).count():
            break
        n *= 2
        new = chosen(rest, n, None)
        rounds = rounds.unionByName(new.withColumn("round_", F.lit(n)))
    by_round = F.sort_array(F.collect_list(F.struct("round_", "exemplars")))
    exemplars = K.stored(rounds.groupBy("host_").agg(by_round.alias("r")).select("host_", F.flatten("r.exemplars").alias("exemplars"), F.size(F.col("r")[0].exemplars).alias("main_")), "html-exemplars")
    slots = shapes.select("host_", "shape_", "tree_").join(exemplars, "host_").mapInArrow(_slots, "host_ long, shape_ long, node_ int, exemplar int, slot int")
    placed = counts.where("node_ >= 0").drop("tree_").join(slots, ["host_", "shape_", "node_"])
    placed = K.stored(placed.groupBy("host_", "exemplar", "slot", "word_").agg(F.sum("n").alias("n")).where("n > 1"), "html-slots")
    filled = placed.where("word_ is null").select("host_", "exemplar", "slot", F.col("n").alias("pages"))
    constant = placed.where("word_ is not null").join(filled, ["host_", "exemplar", "slot"]).where(F.col("n") >= F.lit(SUPPORT) * F.col("pages"))
    constant = constant.groupBy("host_").agg(F.collect_list(F.struct("exemplar", "slot", "word_")).alias("constant"))
    return exemplars.join(constant, "host_").select("host_", "exemplars", "main_", "constant")


def extract(pages: DataFrame, page: str = "html", url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all but the page) with text (empty if none) and n_chars (code points) of each row.

    A host's template is learned from all its pages; pages with the same texts count as one, and a text must be in two
    different pages at least, so a host with one page has no template.  Pages without url share one host.  Null, empty
    and tagless pages work, as do pages of any depth and tags that never end; columns named text or n_chars are replaced.
    Repeated rows give a row each.
    """
    spark = pages.sparkSession
    keep = [c for c in ([c for c in pages.columns if c != page] if keep is None else keep) if c not in ("text", "n_chars")]
    own = pages.select(F.col(page).alias("page_"), F.xxhash64(host_of(url)).alias("host_"), *[F.col(f"`{c}`") for c in keep])
    known = K.stored(templates(own), "html-templates")
    size = known.agg(F.coalesce(F.sum(F.size("constant") * 60 + F.length(F.array_join("exemplars", ""))), F.lit(0))).first()[0]
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[2:]]
    schema = ", ".join([*kept, "text string", "n_chars long"])
    if size <= BROADCAST_BYTES:
        held = {r.host_: (r.exemplars, r.main_, [x.asDict() for x in r.constant]) for r in known.collect()}
        return own.mapInArrow(_extract(spark.sparkContext.broadcast(held)), schema)
    # A host may have a third of all pages: its template goes before each of its parts.
    salt = F.pmod(F.xxhash64("page_"), F.lit(SALTS)).cast("int")
    rows = own.select("page_", "host_", F.lit(True).alias("is_page_"), salt.alias("salt_"), *[F.col(f"`{c}`") for c in keep])
    heads = known.select("host_", F.lit(False).alias("is_page_"), "exemplars", "main_", "constant", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_"))
    both = rows.unionByName(heads, allowMissingColumns=True).repartition(K.parts(spark) * 4, "host_", "salt_").sortWithinPartitions("host_", "salt_", "is_page_")
    return both.select("page_", "host_", "is_page_", "exemplars", "main_", "constant", *[F.col(f"`{c}`") for c in keep]).mapInArrow(_extract_sorted, schema)
