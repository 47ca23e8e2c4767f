"""Main text of web pages: site templates are found by subtrees that recur across a host.

A page is parsed into a tree with the usual repairs (implied end tags, void and raw
elements, markup that breaks off). One pass from the leaves up gives every subtree two
hashes: of its content (tags, classes and words) and of its shape (tags and classes, like
neighbours once, without words). Spark counts on how many different pages of its host each
occurs. Subtrees whose content recurs are template. So are those whose shape recurs, if
half of their words are links or their element, role or class names something else than
main text: menus, adverts and footers differ in words from page to page, not in shape.

Where a host has pages enough to count, recurrence decides. What is left of a page without
template subtrees is fresh; its content is the smallest subtree that holds nearly all fresh
text, widened to the article (or main element) around it, as tags break ties. All other text of
the page goes. Within the content recurring subtrees go too, but no block of running text: a
paragraph, list, quotation or table that many articles repeat stays, whatever its attributes,
unless half of its words are links, it is named as something else or has controls of a form.
Containers go, unless those with paragraphs or headings hold most of the content's text:
then the article itself is syndicated, and only those without go. Subtrees whose shape alone
recurs go within the content where they are named as something else. Headings, list items and
cells of their own, and inline elements, are no subtrees to remove. Identical pages count once,
so copies of a page do not make it a template.

What no recurrence shows, on hosts of fewer than ``FEW_PAGES`` different pages, names decide:
the content is in articles, else main elements, else the body, without elements and roles that
are never main text, and clear class names like navbar or cookie. Names that a section of
an article may have as well (discussion, legal, related) count only where links prevail, and
outside of articles.

Null and empty html have an empty text. Null page_ids and urls are rows like others;
pages whose url has no host share the empty host; repeated rows give repeated rows. All
steps are linear in the size of a page, however deep it is nested.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conefix.llm.arrow import slices, small_batches, values
from conefix.session import Scratch

#: A subtree is template if it occurs on so many different pages of its host, whatever the host's size.
MIN_PAGES = 8
#: On fewer pages it is template if it occurs on so many, and on so large a share of its host's different pages.
FEW_PAGES = 3
FEW_SHARE = 0.6
#: The content of a page holds so large a share of its fresh text.
MOST = 0.95
#: Template subtrees up to which their numbers (8 bytes each) may be broadcast.
BROADCAST_ROWS = 1_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont bgsound frame keygen".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption option optgroup html body legend".split())
#: Start tags that end an open element of the given kinds, and the elements beyond which they do not look.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
#: Elements that never hold main text.
DROPPED = frozenset("head script style noscript template nav footer aside form button select option input textarea iframe svg canvas object dialog menu title audio video map datalist math noembed noframes".split())
CONTAINERS = frozenset("div section ul ol dl table nav header footer aside form p blockquote pre center figure details".split())
HOLDS_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre article main".split())
#: Class names that are never main text, and those that a part of an article may have too.
_SURE = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|crumbs|sidebar|side-?bar|footer|masthead|site-?header|page-?header|top-?bar|ad|ads|adv|advert|adverts|advertisement|"
    r"advertising|adsbygoogle|promo|promotion|sponsor|sponsored|cookie|cookies|consent|gdpr|popup|pop-?up|modal|overlay|newsletter|subscribe|"
    r"subscription|comments|comment|comment-?list|disqus|pagination|pager|skip-?link|hidden|visually-hidden|sr-only|print-only|noprint)(?:$|[\s_-])"
)
_MAYBE = re.compile(
    r"(?:^|[\s_-])(?:rail|toolbar|banner|notice|notices|alert|signup|login|search|share|sharing|social|related|recommended|recommendations|teaser|trending|discussion|responses|"
    r"replies|respond|reply|widget|copyright|legal|disclaimer)(?:$|[\s_-])"
)
#: Elements that are shown as something else than text, or not at all.
_NO_TEXT = RAW | frozenset("head button select option input svg canvas object audio video map datalist math".split())
_CONTROLS = frozenset("form button input select textarea".split())
_RUNNING = frozenset("p blockquote pre ul ol dl table figure".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_INLINE = frozenset("b i em strong span u s small sub sup mark font code abbr cite q label time br wbr img".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "depth", "exact", "shape", "words", "linked", "holds", "controls", "fresh")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent
        self.depth = 0 if parent is None else parent.depth + 1

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(self.attrs)} if self.attrs.strip(" /") else {}


class Open:
    """The open elements of a page, by tag, so that no repair has to walk up the tree."""

    def __init__(self, root: Node):
        self.here = root
        self.by_tag: dict[str, list[Node]] = defaultdict(list)

    def enter(self, node: Node) -> None:
        self.by_tag[node.tag].append(node)
        self.here = node

    def deepest(self, tags) -> Node | None:
        return max((self.by_tag[t][-1] for t in tags if self.by_tag.get(t)), key=lambda n: n.depth, default=None)

    def close(self, node: Node | None) -> None:
        """Ends an open element and all within it."""
        if node is not None:
            while self.here is not node.parent:
                self.by_tag[self.here.tag].pop()
                self.here = self.here.parent

    def topmost(self, tags, below: int) -> Node | None:
        """The outermost open element of these tags that is deeper than a depth."""
        found = []
        for tag in tags:
            held = self.by_tag.get(tag) or ()
            i = bisect_right(held, below, key=lambda n: n.depth)
            found += held[i : i + 1]
        return min(found, key=lambda n: n.depth, default=None)


def parse(text: str) -> Node:
    """The tree of a page; texts among its children are strings, undecoded."""
    root = Node("#root", "", None)
    open_, at, n, lower = Open(root), 0, len(text), None
    while at < n:
        tag = text.find("<", at)
        if tag < 0:
            tag = n
        if tag > at:
            open_.here.children.append(text[at:tag])
        if tag == n:
            break
        found = _TAG.match(text, tag) or _LOOSE.match(text, tag)
        if not found:
            follows = text[tag + 1 : tag + 2]
            if text.startswith("<!--", tag):
                end = text.find("-->", tag + 4)
                at = n if end < 0 else end + 3
            elif follows and follows in "!?/":
                end = text.find(">", tag)
                at = n if end < 0 else end + 1
            elif follows.isalpha() and follows.isascii():
                break  # a tag that the end of the page cuts off
            else:
                open_.here.children.append("<")
                at = tag + 1
            continue
        at = found.end()
        name = found[2].lower()
        if found[1]:
            open_.close(open_.deepest((name,)))
            continue
        if name in ENDS_P:
            nearest = open_.deepest(("p", "button", "table", "td", "th"))
            if nearest is not None and nearest.tag == "p":
                open_.close(nearest)
        if name in IMPLIED:
            ends, stops = IMPLIED[name]
            stop = open_.deepest(stops)
            open_.close(open_.topmost(ends, stop.depth if stop is not None else -1))
        node = Node(name, found[3], open_.here)
        open_.here.children.append(node)
        if name in RAW:
            if lower is None:
                lower = text.lower()
                if len(lower) != n:  # a few letters change their length
                    lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
            end = lower.find(f"</{name}", at)
            node.children.append(text[at : n if end < 0 else end])
            if end < 0:
                break
            close = text.find(">", end)
            at = n if close < 0 else close + 1
        elif name not in VOID and not (found[3].endswith("/") and name in ("path", "circle", "rect", "use", "line", "g")):
            open_.enter(node)
    return root


def named(node: Node, in_article: bool) -> str | None:
    """Whether an element is named as something other than main text: "sure", "maybe" or None."""
    tag = node.tag
    if tag in DROPPED or tag == "header" and not in_article:
        return "sure"
    if not node.attrs.strip(" /") or tag in ("html", "body", "#root", "main"):
        return None
    a = node.attributes()
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in _ROLES or re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
        return "sure"
    if in_article and tag in _HEADINGS:
        return None
    words = f"{a.get('class', '')} {a.get('id', '')}".lower()
    return "sure" if _SURE.search(words) else "maybe" if _MAYBE.search(words) else None


def _number(parts: list[bytes]) -> int:
    return int.from_bytes(xxhash.xxh64_digest(b"\x1f".join(parts)), "big", signed=True)


def measure(tree: Node) -> None:
    """Gives every element, from the leaves up, its two hashes, its words, those of them in links, and whether it holds paragraphs or headings."""
    order, stack = [], [tree]
    while stack:
        top = stack.pop()
        order.append(top)
        stack += [c for c in top.children if isinstance(c, Node)]
    for top in reversed(order):
        name = f"{top.tag}|{top.attributes().get('class', '') if top.attrs else ''}".encode()
        content, shape = [name], [name]
        top.words = top.linked = 0
        top.holds, top.controls = top.tag in HOLDS_TEXT, top.tag in _CONTROLS
        for child in top.children:
            if isinstance(child, Node):
                content.append(child.exact)
                top.words += child.words
                top.linked += child.linked
                top.holds, top.controls = top.holds or child.holds, top.controls or child.controls
                mark = child.shape
            else:
                split = child.split()
                content.append(" ".join(split).encode("utf-8", "replace"))
                top.words += len(split)
                mark = b"#" if split else b""
            if mark and shape[-1] != mark:
                shape.append(mark)
        top.exact = xxhash.xxh64_digest(b"\x1f".join(content))
        top.shape = (b"#" if top.words else b"") if top.tag in _INLINE else xxhash.xxh64_digest(b"\x1f".join(shape))
        if top.tag in RAW:
            top.words = 0
        elif top.tag == "a":
            top.linked = top.words


def linky(node: Node) -> bool:
    """Whether half of an element's words are links."""
    return 0 < node.words <= 2 * node.linked


def content_key(node: Node) -> int:
    return _number([b"content", node.exact])


def shape_key(node: Node) -> int | None:
    """The number under which a subtree's shape is counted; None where a recurring shape says nothing."""
    why = named(node, False) or ("links" if linky(node) else None)
    return None if why is None else _number([b"shape", why.encode(), node.shape])


def recurs(node: Node, template: frozenset[int] | set[int]) -> bool:
    """Whether a subtree is template, by its content or by its shape."""
    if node.tag not in CONTAINERS:
        return False
    return content_key(node) in template or shape_key(node) in template


def _weigh(tree: Node, skipped) -> None:
    """Gives every element the letters of its text, without those of subtrees that are skipped."""
    order, stack = [], [tree]
    while stack:
        top = stack.pop()
        top.fresh = 0
        if top.tag in _NO_TEXT or skipped(top):
            continue
        order.append(top)
        stack += [c for c in top.children if isinstance(c, Node)]
    for top in reversed(order):
        top.fresh = sum(c.fresh if isinstance(c, Node) else sum(map(len, c.split())) for c in top.children)


def _outermost(tree: Node, kind: str) -> list[Node]:
    """The outermost elements of a kind below a node that have fresh text, in page order."""
    found, stack = [], list(reversed(tree.children))
    while stack:
        node = stack.pop()
        if isinstance(node, Node) and node.fresh:
            if kind in (node.tag, node.attributes().get("role") if node.attrs else None):
                found.append(node)
            else:
                stack += reversed(node.children)
    return found


def content(tree: Node, template: frozenset[int] | set[int]) -> list[Node]:
    """The smallest subtree that holds most of the text outside of template subtrees; articles, or else main elements, around it or with half of its text break ties.

    Where running text that recurs is more than what does not, as in syndicated articles, it counts too.
    """
    _weigh(tree, lambda n: n.tag in CONTAINERS and (linky(n) or n.controls or not n.holds or named(n, True) is not None) and recurs(n, template))
    possible = tree.fresh
    _weigh(tree, lambda n: recurs(n, template))
    if 2 * tree.fresh < possible:
        _weigh(tree, lambda n: n.tag in CONTAINERS and (linky(n) or n.controls or not n.holds or named(n, True) is not None) and recurs(n, template))
    node = tree
    while held := [c for c in node.children if isinstance(c, Node) and c.fresh and c.fresh >= MOST * tree.fresh and (c.tag in CONTAINERS - {"p", "blockquote", "pre"} or c.tag in ("html", "body", "main", "article", "td", "tr", "tbody", "li"))]:
        node = held[0]
    for kind in ("article", "main"):
        up = node
        while up is not None and kind not in (up.tag, up.attributes().get("role") if up.attrs else None):
            up = up.parent
        if up is not None:
            return [up]
        below = _outermost(node, kind)
        if below and 2 * sum(c.fresh for c in below) >= node.fresh:
            return below
    return [node]


def removed(root: Node, template: frozenset[int] | set[int], inside: bool) -> set[int]:
    """Ids of the nodes below a root that are template; see above for those of an article."""
    found, held = set(), set()
    total = recurring = 0
    stack: list[tuple[Node | str, bool]] = [(c, False) for c in root.children]
    while stack:
        node, counted = stack.pop()
        if isinstance(node, str):
            size = len("".join(node.split()))
            total += size
            recurring += size * counted
            continue
        if node.tag in _NO_TEXT:
            continue
        if node.tag in CONTAINERS:
            why = named(node, inside)
            if (why is not None or linky(node) and not inside) and shape_key(node) in template:
                found.add(id(node))
                continue
            stays = inside and node.tag in _RUNNING and why is None and not linky(node) and not node.controls
            if not stays and content_key(node) in template:
                if not inside or not node.holds:
                    found.add(id(node))
                    continue
                held.add(id(node))
                counted = True
        stack += [(c, counted) for c in node.children]
    return found | held if 2 * recurring <= total else found


def roots(tree: Node) -> list[Node]:
    """The elements whose content is main text: articles, else main elements, else the body or the whole page."""
    articles, mains, bodies = [], [], []
    stack = [(tree, False)]
    while stack:
        node, within = stack.pop()
        if node is not tree and named(node, False) == "sure" and node.tag != "header":
            continue
        role = node.attributes().get("role") if node.attrs else None
        if node.tag == "article" or role == "article":
            articles.append(node)
            continue
        if node.tag == "main" or role == "main":
            if not within:
                mains.append(node)
            within = True
        elif node.tag == "body":
            bodies.append(node)
        stack += [(c, within) for c in reversed(node.children) if isinstance(c, Node)]
    return articles or mains or bodies or [tree]


def subtrees(tree: Node) -> set[int]:
    """Numbers of all subtrees of a page that may be template, by content and by shape."""
    measure(tree)
    found, stack = set(), [tree]
    while stack:
        node = stack.pop()
        if node.tag in RAW or node.tag == "head":
            continue
        if node.tag in CONTAINERS:
            found.add(content_key(node))
            key = shape_key(node)
            if key is not None:
                found.add(key)
        stack += [c for c in node.children if isinstance(c, Node)]
    return found


def extract(text: str, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of a page: a line for each block, white space within it made single.

    ``template`` holds the numbers of the host's template subtrees, and 0 where the host has pages enough to count.
    """
    tree = parse(text)
    measure(tree)
    lines: list[str] = []
    inline: list[str] = []

    def flush() -> None:
        if inline:
            line = " ".join(entities.unescape("".join(inline)).split())
            if line:
                lines.append(line)
            inline.clear()

    known = 0 in template
    for root in content(tree, template) if known else roots(tree):
        inside = root.tag not in ("html", "body", "#root")
        gone = removed(root, template, inside) if known else ()

        def out(node: Node) -> bool:
            if known:
                return node.tag in _NO_TEXT or id(node) in gone
            why = named(node, inside)
            return why == "sure" or why == "maybe" and (linky(node) or not inside)

        stack: list[Node | str | None] = [root]
        while stack:
            node = stack.pop()
            if node is None:
                flush()
            elif isinstance(node, str):
                inline.append(node)
            elif node is not root and out(node):
                if node.tag in BLOCKS:
                    flush()
            elif node.tag in ("br", "hr", "wbr", "img"):
                if node.tag == "hr":
                    flush()
                elif node.tag == "br":
                    inline.append(" ")
            else:
                if node.tag in BLOCKS:
                    flush()
                    stack.append(None)
                stack += reversed(node.children)
        flush()
    return "\n".join(lines)


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _subtree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html"):
            hashes = [sorted(subtrees(parse(raw.decode("utf-8", "replace"))) | {0}) for raw in values(batch, "html")]  # 0 counts the pages
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array(hashes, pa.list_(pa.int64()))], ["host", "page", "hashes"])


class HostTemplates:
    """The template subtrees of a host, looked up in the sorted numbers of all hosts."""

    def __init__(self, table: np.ndarray, host: str):
        self.table, self.own = table, np.uint64(xxhash.xxh64_intdigest(host.encode(), 42)).astype(np.int64)

    def __bool__(self) -> bool:
        return len(self.table) > 0

    def __contains__(self, number: int | None) -> bool:
        if number is None:
            return False
        key = np.int64(number) ^ self.own
        i = int(np.searchsorted(self.table, key))
        return i < len(self.table) and self.table[i] == key


def counted(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``rows(host, page, html)`` -> the subtrees of each different page, ``(host, page, hashes)``, and those that are template, ``(host, hash)``; page is a hash of the whole html."""
    seen = scratch.save(rows.mapInArrow(_subtree_rows, "host string, page long, hashes array<bigint>").dropDuplicates(["host", "page"]), "subtrees")
    counts = seen.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n"))
    pages = seen.groupBy("host").agg(F.count("*").alias("pages"))
    # The number 0 is among them where a host has pages enough to count.
    many = counts.where(F.col("n") >= FEW_PAGES).join(pages, "host").where((F.col("n") >= MIN_PAGES) | (F.col("n") >= FEW_SHARE * F.col("pages")))
    return seen, scratch.save(many.select("host", "hash"), "templates")


def by_page(seen: DataFrame, found: DataFrame) -> DataFrame:
    """``(host, page, hashes)``: for pages with template subtrees, which; a page's own subtrees bound the list."""
    return seen.select("host", "page", F.explode("hashes").alias("hash")).join(found, ["host", "hash"]).groupBy("host", "page").agg(F.collect_list("hash").alias("hashes"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page.

    Pages meet the templates in place while these are at most ``BROADCAST_ROWS``; beyond,
    pages are shuffled to the lists of their own template subtrees.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("html"))
    rows, scratch = rows.withColumn("page", F.xxhash64("html")), Scratch(pages.sparkSession, "html")
    seen, found = counted(rows.select("host", "page", "html"), scratch)
    if found.count() <= BROADCAST_ROWS:
        table = np.sort(found.select(F.col("hash").bitwiseXOR(F.xxhash64("host")).alias("k")).toArrow().column("k").to_numpy())
        marked = rows.withColumn("hashes", F.lit(None).cast("array<bigint>"))
    else:
        table, marked = None, rows.join(scratch.save(by_page(seen, found), "found"), ["host", "page"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                raw = [x.decode("utf-8", "replace") for x in values(batch, "html")]
                own = [set(h or ()) for h in batch.column("hashes").to_pylist()] if table is None else [HostTemplates(table, h) for h in batch.column("host").to_pylist()]
                texts = [extract(x, t) for x, t in zip(raw, own, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return marked.select("page_id", "url", "host", "html", "hashes").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
