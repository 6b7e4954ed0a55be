"""HTML extraction by wrapper induction.

The pages of a host are told apart by layout (the body's class words, and whether there is a main and one or more articles);
of each layout one page (that of least content hash) is the reference. Every page's DOM is aligned with its
reference by simple tree matching, runs of alike childless siblings counting as one repeated
node. Pages of one main text (their longest) count once. Over the pages of a layout, a node whose text is the same on ``CONSTANT`` of at least ``PAGES``
pages is template, one whose text stands in links is a menu, and a varying one is a content slot. The content's root is found from the
slots alone: from the top down, the block that holds ``HEAVY`` of the varying text, as long as no varying heading stands beside it.
A page's text is what lies in its node aligned with that root, without template and menu nodes.

Tags, roles and class words only leave out what they name (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
comments), and choose the root where there is none: on layouts of under ``PAGES`` distinct pages, where text is spread
over the body, and on pages that do not align. There the outermost ``article`` elements are taken, or else those of ``main``,
or the block with content words in its class that has most text, or the body. In an article a class must consist of such words and neutral ones to be left out.

Character references are decoded, white space in a block becomes one space, blocks are joined by a
line feed in page order; ``br`` is white space. Null or empty html gives an empty text. Pages
without a host have no wrapper. Repeated rows each give a row; an empty table gives an empty one; other
columns are not read. Alignment and texts go to any depth and length.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

CONSTANT, PAGES, HEAVY, LINKED = 0.9, 4, 0.8, 0.9
#: A table of two lists of children is held up to so many cells; beyond, the same matching is found by halves.
CELLS = 40_000
#: Wrappers are broadcast up to so many bytes of html, joined by host beyond.
BROADCAST = 32 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open element of these tags.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}}
SCOPE = frozenset("table ul ol dl div section article body select".split())
DROPPED = RAW | frozenset("head nav footer header aside form svg canvas object audio video button select input menu dialog math".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense adslot sponsor sponsored sponsors promo promotion promotions promoted cookie cookies consent gdpr notice notices notification notifications "
    "popup modal overlay newsletter subscribe subscription signup login sidebar sidebars aside widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer "
    "comment comments commentlist respond replies discussion disqus related recommended recommendations share sharing social pagination pager toolbar".split()
)
#: Words that beside those do not make a class another thing.
NEUTRAL = frozenset(
    "area articles bar bars block blocks body bottom box boxes button buttons col column container content desktop email fb fixed footer global group header holder icon icons inner item items "
    "latest layout left link links list main media mobile module more news outer page panel popular post posts primary reader readers right row secondary section site slot social sticky story stories "
    "text title top trending unit user users wrap wrapper zone article entry inline js id".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset("article post entry story main content maincontent articlebody body".split())
TAG = re.compile(r"""<(?:!--(?:.*?-->|.*)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("attributes", "items", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.items = tag, []
        self.attributes = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes[:-1])} if len(attributes) > 1 else {}

    def names(self) -> list[str]:
        both = f"{self.attributes.get('class', '')} {self.attributes.get('id', '')}"
        return [x.lower() for x in re.split(r"[^A-Za-z]+", CAMEL.sub(" ", both)) if x] if both != " " else []


def parse(page: str) -> Node:
    root = Node("#root")
    open_nodes, at, n = [root], 0, len(page)
    count: Counter = Counter()  # of open elements by tag, so that no search is made for one that isn't open

    def close_from(i: int) -> None:
        for x in open_nodes[i:]:
            count[x.tag] -= 1
        del open_nodes[i:]

    while at < n:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            open_nodes[-1].items.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if count[tag]:
                for i in range(len(open_nodes) - 1, 0, -1):
                    if open_nodes[i].tag == tag:
                        close_from(i)
                        break
                    if open_nodes[i].tag in ("td", "th", "table") and tag not in ("tr", "tbody", "table", "thead", "tfoot", "body", "html"):
                        break
            continue
        if tag in BLOCK and tag not in ("html", "body"):
            close = {"p"} | ENDS.get(tag, set())
            i = len(open_nodes) - 1
            while i > 0 and any(count[x] for x in close):
                if open_nodes[i].tag in close:
                    close_from(i)
                elif open_nodes[i].tag in SCOPE:
                    break
                i -= 1
        node = Node(tag, m[3])
        open_nodes[-1].items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/>"):
            open_nodes.append(node)
            count[tag] += 1
    return root


def walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(y for y in reversed(x.items) if isinstance(y, Node))


def blocks(node: Node, without: set[int] = frozenset()) -> list[str]:
    """The node's blocks of text, less the subtrees whose id() is in ``without``."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif id(x) not in without:
            if x.tag in BLOCK:
                end()
                stack.append(None)
            elif x.tag == "br":
                line.append(" ")
            stack.extend(reversed(x.items))
    end()
    return out


def unwanted(node: Node, inside: bool) -> bool:
    """Whether tag, role, class or id name no part of an article; inside: it stands in the article."""
    if node.tag in DROPPED and not (inside and node.tag == "header"):
        return True
    if not node.attributes:
        return False
    a = node.attributes
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or "display:none" in a.get("style", "").replace(" ", ""):
        return True
    if node.tag in ("html", "body", "main"):
        return False
    names = node.names()
    if not any(x in HINTS for x in names):
        return False
    if not inside:
        return True
    for token in f"{a.get('class', '')} {a.get('id', '')}".split():
        words = [x.lower() for x in re.split(r"[^A-Za-z]+", CAMEL.sub(" ", token)) if x]
        if any(x in HINTS - {"header"} for x in words) and all(x in HINTS or x in NEUTRAL for x in words):
            return True
    return False


# -- alignment ------------------------------------------------------------------------------------


class Entry:
    """A node, or a run of alike childless siblings, for the alignment."""

    __slots__ = ("kids", "label", "nodes", "number")

    def __init__(self, label: str, node: Node):
        self.label, self.nodes, self.kids, self.number = label, [node], [], -1


def compact(root: Node) -> Entry:
    top = Entry("#root", root)
    stack = [top]
    while stack:
        entry = stack.pop()
        for x in entry.nodes[0].items:
            if not isinstance(x, Node) or (x.tag not in BLOCK and x.tag not in ("body", "html")):
                continue
            label = x.tag + "".join(f".{c}" for c in sorted(set(x.names())))
            bare = not any(isinstance(y, Node) and y.tag in BLOCK for y in x.items)
            last = entry.kids[-1] if entry.kids else None
            if bare and last and last.label == label and not last.kids and last.number == -2:
                last.nodes.append(x)
                continue
            kid = Entry(label, x)
            kid.number = -2 if bare else -1
            entry.kids.append(kid)
            if not bare:
                stack.append(kid)
    return top


def numbered(top: Entry) -> Entry:
    stack, n = [top], 0
    while stack:
        x = stack.pop()
        x.number, n = n, n + 1
        stack.extend(reversed(x.kids))
    return top


def matching(a: Entry, b: Entry, memo: dict) -> int:
    """Simple tree matching: the most pairs of alike nodes that keep order and ancestry. Without recursion, as pages can be deep."""
    if a.label != b.label:
        return 0
    stack = [(a, b, False)]
    while stack:
        x, y, ready = stack.pop()
        key = (id(x), id(y))
        if key in memo:
            continue
        if ready or not x.kids or not y.kids:
            memo[key] = 1 + last_row(x.kids, y.kids, memo)[-1]
            continue
        stack.append((x, y, True))
        stack.extend((u, v, False) for u in x.kids for v in y.kids if u.label == v.label and (id(u), id(v)) not in memo)
    return memo[(id(a), id(b))]


def last_row(some: list[Entry], others: list[Entry], memo: dict) -> list[int]:
    """The last row of the table of two lists of children whose pairs are matched."""
    row = [0] * (len(others) + 1)
    for x in some:
        above, row = row, [0]
        for j, y in enumerate(others):
            w = memo[(id(x), id(y))] if x.label == y.label else 0
            row.append(max(above[j + 1], row[j], above[j] + w))
    return row


def pairs_of(a: list[Entry], b: list[Entry], memo: dict) -> list[tuple[Entry, Entry]]:
    """A best matching of two long lists of children in linear memory, by halves."""
    for x in a:
        for y in b:
            matching(x, y, memo)
    out, stack = [], [(a, b)]
    while stack:
        a, b = stack.pop()
        if not a or not b:
            continue
        if len(a) == 1:
            y = max(b, key=lambda y: memo[(id(a[0]), id(y))] if y.label == a[0].label else 0)
            if y.label == a[0].label:
                out.append((a[0], y))
            continue
        m = len(a) // 2
        up, down = last_row(a[:m], b, memo), last_row(a[m:][::-1], b[::-1], memo)
        j = max(range(len(b) + 1), key=lambda j: up[j] + down[len(b) - j])
        stack += [(a[:m], b[:j]), (a[m:], b[j:])]
    return out


def table_of(a: Entry, b: Entry, memo: dict) -> list[list[int]]:
    rows = [[0] * (len(b.kids) + 1)]
    for x in a.kids:
        above, row = rows[-1], [0]
        for j, y in enumerate(b.kids):
            w = matching(x, y, memo) if x.label == y.label else 0
            row.append(max(above[j + 1], row[j], above[j] + w))
        rows.append(row)
    return rows


def align(page: Entry, reference: Entry) -> list[tuple[Entry, int]]:
    """Matched nodes of the page with the reference's numbers."""
    out, memo, stack = [], {}, [(page, reference)]
    while stack:
        a, b = stack.pop()
        out.append((a, b.number))
        if not a.kids or not b.kids:
            continue
        if len(a.kids) * len(b.kids) > CELLS:  # no room for the table
            stack.extend(pairs_of(a.kids, b.kids, memo))
            continue
        rows = table_of(a, b, memo)
        i, j = len(a.kids), len(b.kids)
        while i and j:
            x, y = a.kids[i - 1], b.kids[j - 1]
            w = matching(x, y, memo)
            if w and rows[i][j] == rows[i - 1][j - 1] + w:
                stack.append((x, y))
                i, j = i - 1, j - 1
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return out


@lru_cache(maxsize=512)
def reference_of(page: str) -> Entry:
    return numbered(compact(parse(page)))


def own_text(entry: Entry) -> str:
    """The text of the entry's nodes that isn't in a block of its own below."""
    parts = []
    for node in entry.nodes:
        inner = {id(x) for x in node.items if isinstance(x, Node) and (x.tag in BLOCK or x.tag in DROPPED)}
        parts.extend(blocks(node, inner))
    return "\n".join(parts)


def characters(entry: Entry) -> tuple[int, int]:
    """Of the entry's own text: all characters that aren't white space, and those in links."""
    every = links = 0
    stack = [(x, node.tag == "a") for node in entry.nodes for x in node.items]
    while stack:
        x, linked = stack.pop()
        if isinstance(x, str):
            n = len("".join(x.split()))
            every += n
            links += n if linked else 0
        elif x.tag not in BLOCK and x.tag not in DROPPED:
            stack.extend((y, linked or x.tag == "a") for y in x.items)
    return every, links


def induce(reference: str, stats: list[tuple[int, int, int, float, float]]) -> tuple[int, list[int]]:
    """The number of the content's root (-1 without one) and those of template and menu nodes, from (number, pages of
    the commonest text, pages, characters, characters in links) of the reference's nodes."""
    top, by = reference_of(reference), {x[0]: x for x in stats}
    every = max((x[2] for x in stats), default=0)
    if every < PAGES:
        return -1, []
    leave = {n for n, most, pages, size, links in stats if pages >= PAGES and (most >= CONSTANT * pages or links >= LINKED * size)}
    order, stack = [], [top]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(x.kids)
    mass: dict[int, float] = {}
    headed: dict[int, bool] = {}
    for x in reversed(order):
        seen = by.get(x.number) if x.number not in leave else None
        mass[x.number] = sum(mass[k.number] for k in x.kids) + (max(0.0, seen[3] - seen[4]) * seen[2] / every if seen else 0.0)
        headed[x.number] = any(headed[k.number] for k in x.kids) or bool(seen) and x.nodes[0].tag in HEADINGS
    x = top
    while x.kids and x.nodes[0].tag != "article":
        heavy = max(x.kids, key=lambda k: mass[k.number])
        if not heavy.kids or mass[heavy.number] < HEAVY * mass[x.number] or any(headed[k.number] for k in x.kids if k is not heavy):
            break
        x = heavy
    return (x.number if x.nodes[0].tag not in ("#root", "html", "body") else -1), sorted(leave)


# -- extraction -----------------------------------------------------------------------------------


def is_article(node: Node) -> bool:
    return node.tag == "article" and not set(node.names()) & HINTS - {"header", "sponsored", "promoted"} or node.attributes.get("itemprop") == "articleBody"


def candidates(top: Node, inside: bool, out: set[int]) -> list[tuple[Node, int]]:
    """Article-like elements in page order, outermost of a rank only; adds what is left out to ``out``."""
    found: list[tuple[Node, int]] = []
    stack: list[tuple[Node, bool, tuple[int, ...]]] = [(top, inside, ())]
    while stack:
        x, inside, within = stack.pop()
        rank = None
        if x is not top and is_article(x):
            rank = 0
        elif x is not top and (x.tag == "main" or x.attributes.get("role") == "main"):
            rank = 1
        elif x is not top and unwanted(x, inside):
            out.add(id(x))
            continue
        elif x.tag in ("div", "section", "td") and x.attributes and set(x.names()) & CONTENT:
            rank = 2
        if rank is not None:
            if rank not in within:
                found.append((x, rank))
            inside, within = True, (*within, rank)
        stack.extend((y, inside, within) for y in reversed(x.items) if isinstance(y, Node))
    return found


def left_out(tree: Node) -> set[int]:
    """The id() of every node in what tags, roles and classes leave out."""
    out: set[int] = set()
    candidates(tree, False, out)
    every: set[int] = set()
    stack = [(tree, False)]
    while stack:
        x, gone = stack.pop()
        gone = gone or id(x) in out
        if gone:
            every.add(id(x))
        stack.extend((y, gone) for y in x.items if isinstance(y, Node))
    return every


def joined(nodes: list[Node], out: set[int]) -> str:
    return "\n".join(t for node in nodes for t in blocks(node, out))


def extract(page: str, reference: str | None = None, root: int = -1, leave: list[int] | None = None) -> str:
    tree = parse(page)
    template: set[int] = set()
    region = None
    if reference and (root >= 0 or leave):
        flags = set(leave or ())
        for entry, number in align(compact(tree), reference_of(reference)):
            if number == root:
                region = entry.nodes[0]
            if number in flags and not entry.kids:
                template.update(map(id, entry.nodes))
    if region is not None:
        out = set(template)
        inner = [x for x, rank in candidates(region, True, out) if rank == 0 and not is_article(region)]
        if text := joined(inner or [region], out):
            return text
    out = set(template)
    found = candidates(tree, False, out)
    for rank in (0, 1):
        if text := joined([x for x, r in found if r == rank], out):
            return text
    return max((joined([x], out) for x, r in found if r == 2), key=len, default="") or joined([tree], out)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def layout_of(html):
    """A number of the page's layout: the body's class words, and whether it has a main and none, one or more articles."""
    body = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_extract(html, r"(?i)<body\b[^>]*?\bclass\s*=\s*[\"']?([^\"'>]*)", 1)), F.lit(r"[a-z]+"), F.lit(0))))
    return F.xxhash64(body, html.rlike(r"(?i)<main\b"), F.least(F.regexp_count(html, F.lit(r"(?i)<article\b")), F.lit(2)))


SEEN = "host string, layout long, number int, digest long, identity long, size int, links int"


def wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """host, layout, reference html, the number of the content's root and those of the nodes to leave out."""
    some = pages.filter("host <> '' and html <> ''")
    refs = scratch.save(some.groupBy("host", "layout").agg(F.min_by("html", F.xxhash64("html")).alias("reference")), "references")

    def digest(text: str) -> int:
        return int.from_bytes(hashlib.blake2b(text.encode(errors="replace"), digest_size=8).digest(), "big", signed=True)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("number", pa.int32()), ("digest", pa.int64()), ("identity", pa.int64()), ("size", pa.int32()), ("links", pa.int32())])
        for batch in batches:
            rows: list[tuple] = []
            for host, layout, page, ref in zip(*(batch[c].to_pylist() for c in ("host", "layout", "html", "reference")), strict=True):
                here = []
                tree = parse(page)
                named = left_out(tree)
                for entry, number in align(compact(tree), reference_of(ref)):
                    if id(entry.nodes[0]) not in named and (text := own_text(entry)):
                        here.append((number, text, *characters(entry)))
                if here:
                    identity = digest(max((x[1] for x in here), key=len))
                    rows.extend((host, layout, number, digest(text), identity, size, links) for number, text, size, links in here)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], schema=kinds)

    # copies of one main text, on any pages of the host, count once
    seen = with_wrapper(some.select("host", "layout", "html"), refs).mapInArrow(look, SEEN)
    texts = seen.groupBy("host", "layout", "number", "digest", "identity").agg(F.max("size").alias("size"), F.max("links").alias("links"))
    texts = texts.groupBy("host", "layout", "number", "digest").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("links").alias("links"))
    nodes = texts.groupBy("host", "layout", "number").agg(F.max("n").alias("most"), F.sum("n").alias("pages"), (F.sum("size") / F.sum("n")).alias("size"), (F.sum("links") / F.sum("n")).alias("links"))
    stats = nodes.groupBy("host", "layout").agg(F.collect_list(F.struct("number", "most", "pages", "size", "links")).alias("stats"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [induce(ref, [tuple(x.values()) for x in stats or ()]) for ref, stats in zip(batch["reference"].to_pylist(), batch["stats"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["host"], batch["layout"], batch["reference"], pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.list_(pa.int32()))], names=["host", "layout", "reference", "root", "leave"])

    induced = refs.join(stats, ["host", "layout"], "left").mapInArrow(make, "host string, layout long, reference string, root int, leave array<int>")
    return scratch.save(induced, "wrappers")


def with_wrapper(pages: DataFrame, small: DataFrame) -> DataFrame:
    """Joins the references or wrappers, by broadcast only if they are within its bound."""
    size = small.agg(F.sum(F.length("reference"))).first()[0] or 0
    return pages.join(F.broadcast(small) if size <= BROADCAST else small, ["host", "layout"], "left")


def extract_pages(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url and main text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                texts = [extract(page or "", ref, -1 if root is None else root, leave) for page, ref, root, leave in zip(*(part[c].to_pylist() for c in ("html", "reference", "root", "leave")), strict=True)]
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    pages = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], pages["html"], host_of(pages["url"]).alias("host"), layout_of(F.coalesce(pages["html"], F.lit(""))).alias("layout"))
    return with_wrapper(pages, wrappers(pages, scratch)).select("page_id", "url", "html", "reference", "root", "leave").mapInArrow(run, "page_id long, url string, text string")


def op9_html_extract(spark, sf_dir: str) -> DataFrame:
    out = extract_pages(table(spark, sf_dir, "pages"), Scratch(spark, "op9"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
