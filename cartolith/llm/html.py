"""Main text of web pages by wrapper induction over the pages of a host.

1. Pages are parsed by a tolerant parser. For induction a page becomes a folded tree: a node's label is its tag and
   classes, siblings with one label are folded into one list node, and each node carries a hash of its text.
2. Of each host up to ``sample`` different pages are taken (the smallest by a hash of their html; tasks keep that many,
   then a ranked window does). Their trees are aligned by simple tree matching (Yang, 1991): the order-preserving
   matching of children with the most nodes. The merged tree is the host's wrapper.
3. The tree of every page is matched with its host's wrapper, which gives its nodes their places; nodes that match none
   have their path of labels as place. Texts are counted by place over all different pages of the host. A place is
   template if most pages show texts there that return on other pages, be it one text or a few by turns; all other
   places are slots. Such returning texts are dropped from template places; a text of its own there, like a correction,
   is content.
4. What is left are the slots, and they are the text. Only among them do names decide: a part whose tag, class, id or
   role says menu, header, footer, sidebar, notice, advert, form or comments is dropped, unless an article, main element
   or first heading is in it, or there is next to nothing outside of such parts and it holds most of what is left. In an
   article's header headings stay. If article or main elements hold most of what is left, the text is theirs.

Copies of one article on a host return as a template does. A node with over half of a page's text, and over
``ARTICLE_CHARS`` characters of it, is therefore never template, and an article or main element stays whole if template would take over half of it.

Wrappers are fitted on a bounded sample, templates on all pages, and every page is extracted whole. Either is broadcast
if all hosts' are under ``broadcast_bytes``; else joined by host, which adaptive execution splits for a large host. Hosts
of under three different pages have no template; for them names and landmarks are all there is.

A null or empty html, or one without text, gives an empty text. A null url, or one without a host, belongs to the
host "". Repeated rows give repeated results; page_id may be null; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from hashlib import blake2b
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Fixed values of HTML: elements without content, with raw text, and that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br-block caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "br-block"}
#: What an opening tag closes, up to the nearest of the boundaries.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Page parts that are no article: by tag, and by words in class, id or role.
PART_TAGS = frozenset("head nav header footer aside form script style noscript template iframe svg math canvas button select textarea object embed audio video menu dialog title".split())
PART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments contentinfo cookie cookies consent copyright disqus footer header masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion "
    "related recommended replies reply search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split()
)
#: Words that may stand beside those in a name that still tells a part; and elements that carry text, which no name drops.
BESIDE_WORDS = frozenset("area bar block bottom box btn button container content feed fixed form group holder home inner item items left link links list main panel post right section site sticky text title top wrap wrapper form".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 td th pre blockquote b i em strong u mark code".split())
WHOLE = frozenset(("html", "body", "article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Of names that tell comments, which may be longer than what they are about.
COMMENT_WORDS = frozenset("comment comments disqus replies reply".split())
LANDMARKS = frozenset(("article", "main"))
#: Elements that hold no text of a page, whatever else they hold.
UNSEEN = frozenset("head script style noscript template iframe svg math canvas object embed audio video select textarea title".split())
#: Class names that tell a state of the page, not a part of it.
STATES = ("has-", "no-", "with-", "without-", "is-")

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "names", "part", "children")

    def __init__(self, tag: str, names: tuple[str, ...] = (), part: str = ""):
        self.tag, self.names, self.part, self.children = tag, names, part, []

    @property
    def label(self) -> str:
        return ".".join((self.tag, *self.names))


def part_of(values: list[list[str]]) -> str:
    """"comments" or "part" if one of the names, each a list of words, tells a page part by all of its words; else ""."""
    told = [v for v in values if not PART_WORDS.isdisjoint(v) and all(w in PART_WORDS or w in BESIDE_WORDS for w in v)]
    return "comments" if any(not COMMENT_WORDS.isdisjoint(v) for v in told) else "part" if told else ""


def parse(html: str) -> Node:
    """The tree of a page; children are nodes and strings."""
    root = Node("#root")
    stack, at = [root], 0
    while m := TOKEN.search(html, at):
        if m.start() > at:
            stack[-1].children.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in CLOSES:
            same, stop = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in same:
                    del stack[k:]
                    break
                if stack[k].tag in stop:
                    break
        names, part = (), "part" if tag in PART_TAGS else ""
        if m[3] and not m[3].isspace():
            values = [WORDS.findall(v) for a in NAMED.finditer(m[3]) for v in (a[2] or a[3] or a[4] or "").lower().split() if not v.startswith(STATES)]
            names = tuple(sorted({w for v in values for w in v}))
            if tag not in TEXT_TAGS and tag not in WHOLE:
                part = part_of(values) or part
        node = Node(tag, names, part)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            node.children.append(html[at : end.start() if end else len(html)])
            at = end.end() if end else len(html)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    if at < len(html):
        stack[-1].children.append(unescape(html[at:]))
    return root


# A folded tree is [label, hash of the text, [children]].


def _hash(parts: list[str]) -> str:
    return blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), digest_size=6).hexdigest()


def fold(nodes: list[Node], depth: int = 64) -> list:
    """The folded tree of siblings with one label; what lies deeper than ``depth`` levels is text of the node there."""
    groups: dict[str, list[Node]] = {}
    texts = []
    for n in nodes:
        stack = list(reversed(n.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                if not c.isspace():
                    texts.append(" ".join(c.split()))
            elif depth:
                groups.setdefault(c.label, []).append(c)
            else:
                stack += reversed(c.children)
    return [nodes[0].label, _hash(texts) if texts else "", [fold(g, depth - 1) for g in groups.values()]]


def match(a: list, b: list, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the size of the largest matching of two trees, and the pairs of their children in it."""
    if a[0] != b[0]:
        return 0, []
    key = id(a), id(b)
    if key not in memo:
        x, y = a[2], b[2]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + match(x[i], y[j], memo)[0])
        pairs, i, j = [], len(x), len(y)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        memo[key] = best[len(x)][len(y)] + 1, pairs[::-1]
    return memo[key]


def _counted(tree: list) -> list:
    """A folded tree as a wrapper's: [label, {text hash: pages}, [children]]."""
    return [tree[0], {tree[1]: 1}, [_counted(c) for c in tree[2]]]


def _merge(wrapper: list, tree: list, memo: dict) -> None:
    wrapper[1][tree[1]] = wrapper[1].get(tree[1], 0) + 1
    pairs = match(wrapper, tree, memo)[1]
    for i, j in pairs:
        _merge(wrapper[2][i], tree[2][j], memo)
    matched = {j: i for i, j in pairs}
    new, last = [], 0
    for j, child in enumerate(tree[2]):  # unmatched nodes go where they stand, after the last matched one
        if j in matched:
            last = matched[j] + 1
        else:
            new.append((last, child))
    for last, child in reversed(new):
        wrapper[2].insert(last, _counted(child))


def aligned(trees: list[list]) -> list:
    """The wrapper of a host: its trees merged along their alignments, as [label, {text hash: pages}, [children]]."""
    wrapper = _counted(trees[0])
    for tree in trees[1:]:
        _merge(wrapper, tree, {})
    return wrapper


def induce(trees: list[list], share: float = 0.8, least: int = 3) -> dict[str, bool]:
    """For each path of labels in the trees' wrapper whether the node is template (else a slot), by these trees alone."""
    wrapper = aligned(trees)
    out: dict[str, bool] = {}

    def walk(node: list, path: str) -> bool:
        inner = [walk(c, f"{path}/{c[0]}") for c in node[2]]
        pages, same = sum(node[1].values()), max(node[1].values())
        constant = len(trees) >= least and pages >= share * len(trees) and same == pages and all(inner)
        out[path] = constant and out.get(path, True)
        return constant

    walk(wrapper, wrapper[0])
    return out


def _long(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def placed(tree: list, wrapper: list | None) -> list[tuple[str, int, int]]:
    """(path of labels, place, hash) of each node with text of a page's folded tree, nearest the root last.

    A place is a node of the wrapper that simple tree matching gives; where it gives none, a path of labels. The hash is
    that of all labels and texts under the node.
    """
    out: list[tuple[str, int, int]] = []
    memo: dict = {}

    def walk(node: list, path: str, twin: list | None, at: str) -> str:
        pairs = {j: i for i, j in match(twin, node, memo)[1]} if twin else {}
        parts = [node[0], node[1]]
        empty = not node[1]
        for j, c in enumerate(node[2]):
            i = pairs.get(j)
            inner = walk(c, f"{path}/{c[0]}", twin[2][i] if i is not None else None, f"{at}/{c[0]}" if i is None else f"{at}/{i}")
            parts.append(inner)
            empty &= not inner
        if empty:
            return ""
        text = _hash(parts)
        out.append((path, _long(at), int(text, 16)))
        return text

    walk(tree, tree[0], wrapper, "")
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


#: Characters, white space apart, from which on a node may be an article.
ARTICLE_CHARS = 150


class Page:
    """A parsed page, and of each of its nodes how many characters of text it holds."""

    def __init__(self, root: Node, template: frozenset[str] | set[str] = frozenset()):
        """``template`` has the paths of labels whose text is template."""
        self.root, self.template = root, template
        self.every = self._sizes(frozenset())
        self.gone = frozenset()
        if template:
            groups: dict[str, int] = {}
            for node, path in self._nodes():
                groups[path] = groups.get(path, 0) + self.every[id(node)]
            most = self.every[id(root)]
            large = {path for path in template if groups.get(path, 0) > max(most / 2, ARTICLE_CHARS)}  # an article, though other pages have it too
            inside = tuple(f"{path}/" for path in large if not any(x.startswith(f"{path}/") for x in large))  # the inmost ones
            self.gone = frozenset(path for path in template if path not in large and not path.startswith(inside))
        self.rest = self._sizes(self.gone) if self.gone else self.every
        whole = [(node, path) for node, path in self._nodes() if node.tag in LANDMARKS and 2 * self.rest[id(node)] < self.every[id(node)]]
        if self.gone and whole:  # template would take most of an article
            inside = tuple(f"{path}/" for _, path in whole)
            above = [path for _, path in whole]
            self.gone = frozenset(path for path in self.gone if not path.startswith(inside) and not any(x == path or x.startswith(f"{path}/") for x in above))
            self.rest = self._sizes(self.gone)

    def _nodes(self):
        stack = [(self.root, "#root")]
        while stack:
            node, path = stack.pop()
            yield node, path
            stack += [(c, f"{path}/{c.label}") for c in node.children if isinstance(c, Node)]

    def _sizes(self, gone: frozenset[str]) -> dict[int, int]:
        """Characters of text under each node without what is gone, white space apart."""
        size: dict[int, int] = {}
        stack: list = [(self.root, "#root", False)]
        while stack:
            node, path, done = stack.pop()
            if done:
                size[id(node)] = sum(size[id(c)] if isinstance(c, Node) else len(c) - c.count(" ") - c.count("\n") for c in node.children)
            elif node.tag in UNSEEN or path in gone:
                inner = [node]
                while inner:
                    x = inner.pop()
                    size[id(x)] = 0
                    inner += [c for c in x.children if isinstance(c, Node)]
            else:
                stack.append((node, path, True))
                stack += [(c, f"{path}/{c.label}" if gone else "", False) for c in node.children if isinstance(c, Node)]
        return size

    def holds_core(self, top: Node) -> bool:
        """Whether an article or main element, or a page's heading, is inside a node."""
        stack = [c for c in top.children if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            if node.tag in LANDMARKS or node.tag == "h1" and top.tag not in PART_TAGS - {"form"}:
                return True
            stack += [c for c in node.children if isinstance(c, Node)]
        return False

    def drops(self, node: Node, path: str) -> bool:
        """Whether a node is no content: unseen, template, or by its name a part, unless it holds what the page is about."""
        if node.tag in UNSEEN or path in self.gone:
            return True
        if not node.part:
            return False
        key = id(node)
        if key not in self.parts:
            most = not self.plain and self.rest[key] > (0.9 if node.part == "comments" else 0.5) * self.rest[id(self.root)]
            self.parts[key] = not most and not self.holds_core(node)
        return self.parts[key]

    def text(self) -> str:
        self.parts: dict[int, bool] = {}
        self.plain = True  # whether there is text enough outside of all parts
        marks, shown = self.marks()
        if not any(self.rest[id(m)] for m, _ in marks) and 10 * shown < self.rest[id(self.root)]:
            self.plain = False
            self.parts.clear()
            marks, shown = self.marks()
        if not marks or 2 * sum(self.rest[id(m)] for m, _ in marks) <= shown:
            marks = [(self.root, "#root")]
        return "\n".join(x for m in marks for x in self.blocks(*m))

    def marks(self) -> tuple[list[tuple[Node, str]], int]:
        """The outermost landmarks that are not dropped, in order, and the characters of text that are not."""
        marks, shown, stack = [], 0, [(self.root, "#root", False)]
        while stack:
            node, path, inside = stack.pop()
            if node.tag in LANDMARKS and not inside:
                marks.append((node, path))
                inside = True
            for c in reversed(node.children):
                if isinstance(c, str):
                    shown += len(c) - c.count(" ") - c.count("\n")
                elif not self.drops(c, f"{path}/{c.label}"):
                    stack.append((c, f"{path}/{c.label}", inside))
        return marks, shown

    def blocks(self, top: Node, path: str) -> list[str]:
        """The texts of the blocks under a node without what is dropped."""
        out: list[str] = []
        run: list[str] = []

        def flush() -> None:
            if text := " ".join("".join(run).split()):
                out.append(text)
            run.clear()

        article = top.tag in LANDMARKS
        stack: list = [(top, path)]  # a depth-first walk without recursion; None ends a block
        while stack:
            item = stack.pop()
            if item is None:
                flush()
                continue
            node, path = item
            if isinstance(node, str):
                run.append(node)
                continue
            if node.tag == "br":
                run.append(" ")
                continue
            headings = False
            if node is not top and self.drops(node, path) and not (article and path in self.gone and node.tag not in BLOCK):
                headings = article and node.tag == "header" and path not in self.gone
                if not headings:
                    if node.tag in BLOCK:
                        flush()
                    continue
            if node.tag in BLOCK:
                flush()
                stack.append(None)
            inner = self.headings(node, path) if headings else [(c, f"{path}/{c.label}" if isinstance(c, Node) else path) for c in node.children]
            stack += reversed(inner)
        flush()
        return out

    @staticmethod
    def headings(top: Node, path: str) -> list[tuple[Node, str]]:
        """The headings under a node, in order."""
        out, stack = [], [(top, path)]
        while stack:
            node, path = stack.pop()
            if node.tag in HEADINGS:
                out.append((node, path))
            else:
                stack += [(c, f"{path}/{c.label}") for c in reversed(node.children) if isinstance(c, Node)]
        return out


def extract(html: str | None, template: set[str] | frozenset[str] = frozenset(), root: Node | None = None) -> str:
    """The main text of a page: blocks in page order, one \\n between them.

    ``template`` has the paths of labels whose text is template; ``root`` is the page's tree, if it is parsed already.
    """
    return Page(root or parse(html), template).text() if html else ""


def induce_wrappers(pages: DataFrame, sample: int = 12) -> DataFrame:
    """(host, wrapper JSON): a stored table with a row for each host that has a page with html."""

    def trees(batches):
        kept: dict[str, list] = {}  # by host a heap of (-hash, html), without equal pages
        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rank = _rank(html)
                heap = kept.setdefault(host, [])
                if len(heap) == sample and -heap[0][0] <= rank or any(-r == rank for r, _ in heap):
                    continue
                (heapq.heapreplace if len(heap) == sample else heapq.heappush)(heap, (-rank, html))
        for host, heap in kept.items():
            yield pa.RecordBatch.from_pydict({"host": [host] * len(heap), "rank": [-r for r, _ in heap], "tree": [json.dumps(fold([parse(h)])) for _, h in heap]})

    def bare(node: list) -> list:
        return [node[0], "", [bare(c) for c in node[2]]]

    def wrapper(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank").drop_duplicates("rank")
        return pd.DataFrame({"host": frame["host"].iloc[:1], "wrapper": [json.dumps(bare(aligned([json.loads(t) for t in frame["tree"]])))]})

    some = pages.where("html is not null").select(host_of(F.col("url")).alias("host"), "html").mapInArrow(trees, "host string, rank long, tree string")
    some = some.dropDuplicates(["host", "rank"]).withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy("rank"))).where(F.col("n") <= sample)
    return stored(some.groupBy("host").applyInPandas(wrapper, "host string, wrapper string"), "wrappers")


def _rank(html: str) -> int:
    return int.from_bytes(blake2b(html.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")


class ByHost:
    """A table (host, value string) for the tasks over a table with a host: broadcast if small, else joined."""

    def __init__(self, table: DataFrame, value: str, broadcast_bytes: int):
        self.table, self.value, self.shared = table, value, None
        size = table.agg(F.coalesce(F.sum(F.length("host") + F.length(value) + 64), F.lit(0))).first()[0]
        if size <= broadcast_bytes:
            self.shared = table.sparkSession.sparkContext.broadcast({r["host"]: r[value] for r in table.collect()})

    def joined(self, rows: DataFrame) -> DataFrame:
        return rows if self.shared else rows.join(self.table, "host", "left")

    def reader(self, load, none):
        """What a task calls with a batch: for each of its rows the loaded value of its host."""
        shared, value, known = self.shared, self.value, {}

        def read(batch: pa.RecordBatch) -> list:
            hosts = batch.column("host").to_pylist()
            told = [shared.value.get(h) for h in hosts] if shared else batch.column(value).to_pylist()
            out = []
            for host, x in zip(hosts, told):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = load(x) if x else none
                out.append(known[host])
            return out

        return read


def find_templates(pages: DataFrame, wrappers: ByHost, share: float = 0.8, least: int = 2, pages_at_least: int = 3, rare: float = 0.01) -> DataFrame:
    """(host, template JSON): a stored table of the pairs of place and hash that are template on a host.

    Counted are all different pages of a host. A text returns if ``least`` of the pages with its place, and ``rare`` of
    them, have it there, so a place has at most 1 / ``rare`` such texts; a place is template if ``share`` of its pages
    have one, and it has ``pages_at_least``. A rarer layout has places, and so a template, of its own.
    """
    load = wrappers.reader(json.loads, None)

    def nodes(batches):
        for batch in batches:
            ranks, places, hashes = [], [], []
            for html, wrapper in zip(batch.column("html").to_pylist(), load(batch)):
                found = placed(fold([parse(html)]), wrapper)
                ranks.append(_rank(html))
                places.append([p for _, p, _ in found])
                hashes.append([h for _, _, h in found])
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(ranks, pa.int64()), pa.array(places, pa.list_(pa.int64())), pa.array(hashes, pa.list_(pa.int64()))], names=["host", "rank", "places", "hashes"])

    rows = wrappers.joined(pages.where("html is not null").select(host_of(F.col("url")).alias("host"), "html"))
    each = rows.mapInArrow(nodes, "host string, rank long, places array<long>, hashes array<long>")
    each = each.groupBy("host", "rank").agg(F.first(F.arrays_zip("places", "hashes")).alias("nodes"))
    counts = each.select("host", F.explode("nodes").alias("n")).groupBy("host", F.col("n.places").alias("place"), F.col("n.hashes").alias("hash")).agg(F.count("*").alias("pages"))
    whole = counts.groupBy("host", "place").agg(F.sum("pages").alias("all"))
    again = counts.join(whole, ["host", "place"]).where((F.col("pages") >= least) & (F.col("pages") >= rare * F.col("all")) & (F.col("all") >= pages_at_least))
    found = again.groupBy("host", "place").agg(F.sum("pages").alias("n"), F.first("all").alias("all"), F.collect_list("hash").alias("hashes")).where(F.col("n") >= share * F.col("all"))
    return stored(found.groupBy("host").agg(F.to_json(F.collect_list(F.struct("place", "hashes"))).alias("template")), "templates")


def extract_text(pages: DataFrame, sample: int = 12, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    wrappers = ByHost(induce_wrappers(pages, sample), "wrapper", broadcast_bytes)
    templates = ByHost(find_templates(pages, wrappers), "template", broadcast_bytes)
    rows = templates.joined(wrappers.joined(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")))
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([pages.schema["page_id"], pages.schema["url"], StructField("text", StringType()), StructField("n_chars", LongType())])
    wrapper_of = wrappers.reader(json.loads, None)
    template_of = templates.reader(lambda x: frozenset((t["place"], h) for t in json.loads(x) for h in t["hashes"]), frozenset())

    def run(batches):
        for batch in batches:
            texts = []
            for html, wrapper, template in zip(batch.column("html").to_pylist(), wrapper_of(batch), template_of(batch)):
                root = parse(html) if html else None
                drop = {path for path, *node in placed(fold([root]), wrapper) if tuple(node) in template} if root and template else frozenset()
                texts.append(extract(html, drop, root))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, schema)
