r"""HTML extraction: site style trees.

All pages of a host are merged into one tree.  A node of it is a place in
the markup (the chain of block elements with their class and id, digits
alike); it carries its styles (the sequences of child elements that pages
show there) or, where text stands, its features (the text itself, link and
image targets), each with the number of pages.  With m pages at a node,

* a presentation node matters as the entropy of its styles to base m,
* a content node as 1 minus the mean of its features' entropies to base m
  (a text that all pages repeat has entropy 1, one of a single page 0),
* a branch as (1 - GAMMA^l) of its own importance and GAMMA^l of the mean of
  its children's, weighted by their pages; l is its number of styles.

Branches that lie below ``LEAST`` importance with all that is in them are
removed from every page of the host, where at least ``MIN_PAGES`` pages show
them.  Spark counts (host, node, style or feature), then adds the logarithms
up per node; both sums start in the scan's tasks, so a host with a third of
all pages is no hot key.  Only the merged tree of a host, one row a distinct
node, meets in one task.

Beside the tree, HTML's own roles decide (small hosts have no statistics):
navigation, footers, asides, forms, scripts, hidden parts, page headers, and
elements whose class, id or role names them as such (``ROLE_WORDS``) go,
unless they hold the article or main element; where a page has such an
element, its text is the main text.  The tree never removes an article or
main element or paragraphs of it (only ``PARTS`` inside it), nor a branch that
holds more than half of a page's text.

The trees are written into the shared folder as one row a host that has
low branches; Spark's own size check then broadcasts that table or joins by
host (AQE splits a hot host's pages).

Defined results: null html is empty and gives ''; a page whose url has no
``://`` or an empty host has no site and is judged by roles alone; unclosed
elements end where HTML lets them; what is cut off inside a tag is dropped;
repeated rows give a row each (each counts as a page); an empty table gives
an empty result; columns other than id, url and html are not read.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscope.llm.rows import written

GAMMA = 0.9
LEAST = 0.5
MIN_PAGES = 6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup up to their own end tag.
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: An element's start ends an open one of these, up to the enclosing element named last.
ENDS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot", "table"), "thead": ("tbody thead tfoot", "table"), "tfoot": ("tbody thead tfoot", "table"), "option": ("option", "select"),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}

#: Never shown as text.
UNSEEN = frozenset("head audio video canvas svg object map select datalist".split()) | RAW
ROLE_TAGS = frozenset("nav footer aside form button input label fieldset dialog menu".split())
ROLE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside nav navbar navigation menu breadcrumb"
    " breadcrumbs masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login"
    " share sharing social related recommended widget widgets comment comments disqus reply replies pagination pager toolbar search form"
    " contentinfo complementary dialog".split())
HEADER_WORDS = frozenset(["header"])  # outside of the article only, where a header holds its title
MAIN = frozenset(["article", "main"])
#: What the tree may remove inside of an article or main element; paragraphs and headings there stay.
PARTS = frozenset("div section ul ol dl table details figure center".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^>"'])*)>|<[/!?][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@lru_cache(1 << 16)
def _hashed(*parts) -> int:
    return int.from_bytes(blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Node:
    """An element: ``path`` is its place in the site's tree, ``holds`` tells of an article or main element in it."""

    __slots__ = ("tag", "parent", "children", "mark", "path", "depth", "words", "holds", "unseen")

    def __init__(self, tag: str, parent: Node | None, attrs: dict[str, str]):
        self.tag, self.parent, self.children = tag, parent, []
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
        self.words = {w.lower() for n in (*names, attrs.get("role", "")) for w in _WORD.findall(n)} if names or "role" in attrs else frozenset()
        self.mark = tag + "".join(f".{_DIGITS.sub('0', n)}" for n in sorted(names))
        self.path = _hashed(parent.path if parent else 0, self.mark)
        self.depth = parent.depth + 1 if parent else 0
        self.holds = False
        self.unseen = tag in UNSEEN or "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style", "")))

    def chain(self) -> Iterator[Node]:
        node = self
        while node is not None:
            yield node
            node = node.parent


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): (v[1:-1] if v[:1] in "\"'" else v) if v else "" for k, v in _ATTR.findall(text)} if text.strip("/ \t\r\n") else {}


def parse(page: str) -> Node:
    """The page's elements.  Inline elements stay in their block as text, link and image targets."""
    root = Node("", None, {})
    stack = [root]  # open elements, block and inline ones

    def end(tags: frozenset, stop: frozenset) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    def block() -> Node:
        return next(n for n in reversed(stack) if n.tag in BLOCK or n is root or n.unseen or n.tag in ROLE_TAGS)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at:m.start() if m else n]
        if text:
            stack[-1].children.append(_html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag in ("html", "body"):
                continue
            end(frozenset([tag]), frozenset() if tag in BLOCK else BLOCK)
            continue
        attrs = _attributes(m["attrs"])
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        if tag in BLOCK:
            if tag != "head":
                end(frozenset(["head"]), frozenset())
            end(frozenset(["p"]), BLOCK - {"p"})
            if tag in ENDS:
                end(*ENDS[tag])
            holder = block()
        else:
            holder = stack[-1]
        node = Node(tag, holder, attrs)
        if tag == "a" and attrs.get("href") or tag == "img" and attrs.get("src"):
            node.children.append(("target", attrs.get("href") or attrs["src"]))
        if tag in MAIN:
            for x in holder.chain():
                if x.holds:
                    break
                x.holds = True
        holder.children.append(node)
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            at = close.start() if close else n
            stack.append(node)
        elif tag not in VOID and not m["attrs"].endswith("/"):
            stack.append(node)
        elif tag in ("br", "hr"):
            node.children.append(" ")
    return root


def by_role(node: Node) -> bool:
    """Whether HTML's own roles make the element no part of the main text."""
    if node.holds or node.tag in MAIN and not node.words & {"comment", "comments", "reply", "related"} or node.tag in ("html", "body", ""):
        return False
    if node.tag in ROLE_TAGS or node.words & ROLE_WORDS:
        return True
    return (node.tag == "header" or bool(node.words & HEADER_WORDS)) and not any(x.tag in MAIN for x in node.chain())


class Block:
    """A run of text: the block element that holds it, targets in it, the outermost element that a role removes."""

    __slots__ = ("node", "text", "targets", "role")

    def __init__(self, node: Node, text: str, targets: list[str], role: Node | None):
        self.node, self.text, self.targets, self.role = node, text, targets, role


def blocks(root: Node) -> list[Block]:
    """The page's seen blocks with text, in page order."""
    out, run, targets = [], [], []

    def close(node: Node, role: Node | None) -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(Block(node, text, list(targets), role))
        run.clear()
        targets.clear()

    todo: list = [("in", root, root, None)]
    while todo:
        what, item, node, role = todo.pop()
        if what == "out":
            close(node, role)
        elif isinstance(item, str):
            run.append(item)
        elif isinstance(item, tuple):
            targets.append(item[1])
        elif not item.unseen:
            mine = role or (item if by_role(item) else None)
            parts = reversed(item.children)
            if item.tag in BLOCK or item is root or (mine is item):
                close(node, role)
                todo.append(("out", None, item, mine))
                todo += [("in", x, item, mine) for x in parts]
            else:
                todo += [("in", x, node, mine) for x in parts]
    return out


def page_nodes(page: str) -> set[tuple[int, int, int, int, int]]:
    """(path, parent's path, depth, kind, value) of the page's tree: kind 0 a style, 1 a feature, 2 the node itself."""
    rows, shown = set(), {}
    for b in blocks(parse(page)):
        leaf = _hashed(b.node.path, "#text")
        rows.add((leaf, b.node.path, b.node.depth + 1, 2, 0))
        rows.add((leaf, b.node.path, b.node.depth + 1, 1, _hashed("text", b.text)))
        rows |= {(leaf, b.node.path, b.node.depth + 1, 1, _hashed("target", t)) for t in b.targets}
        child = "#text"
        for node in b.node.chain():
            _, marks = shown.setdefault(id(node), (node, []))
            if not marks or marks[-1] != child:
                marks.append(child)
            child = node.mark
    for node, marks in shown.values():
        parent = node.parent.path if node.parent else 0
        rows.add((node.path, parent, node.depth, 0, _hashed("style", *marks)))
        rows.add((node.path, parent, node.depth, 2, 0))
    return rows


TREE_ROWS = "_host string, _path bigint, _parent bigint, _depth int, _kind int, _value bigint"


def tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task: (_host, _html) -> the nodes of every page."""
    names = [c.split()[0] for c in TREE_ROWS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    for batch in batches:
        held: list[tuple] = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            held += [(host, *row) for row in page_nodes(page.as_py())]
            if len(held) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def importance(nodes: list[tuple]) -> dict[int, tuple[int, float, float]]:
    """path -> (pages, importance of the branch, the greatest one in it) of one host's merged tree.

    ``nodes``: (path, parent, depth, pages, features, sum of ln pages over
    features, styles, pages over styles, sum of pages ln pages over styles)."""
    done: dict[int, tuple[int, float, float]] = {}
    below: dict[int, list[float]] = {}
    for path, parent, _, m, features, logs, styles, shown, weighted in sorted(nodes, key=lambda x: (-x[2], x[0])):
        if features:
            value = 1 - logs / (features * math.log(m)) if m > 1 else 1.0
            greatest = value
        else:
            own = min(1.0, max(0.0, (math.log(shown) - weighted / shown) / math.log(m))) if m > 1 else 1.0
            part, total, greatest = below.get(path, (0.0, 0, 0.0))
            value = (1 - GAMMA**styles) * own + GAMMA**styles * (part / total if total else 0.0)
            greatest = max(value, greatest)
        done[path] = m, value, greatest
        add = below.setdefault(parent, [0.0, 0, 0.0])
        add[:] = add[0] + m * value, add[1] + m, max(add[2], greatest)
    return done


NODE = ["_path", "_parent", "_depth", "_pages", "_features", "_logs", "_styles", "_shown", "_weighted"]


def _host_tree(key, table):
    """The merged tree of one host, as an Arrow table."""
    found = importance(list(zip(*(table[c].to_pylist() for c in NODE))))
    return pa.table({"_host": pa.array([key[0].as_py()] * len(found), pa.string()), "_path": pa.array(list(found), pa.int64()),
                     "_pages": pa.array([x[0] for x in found.values()], pa.int64()), "_importance": pa.array([x[1] for x in found.values()], pa.float64()),
                     "_greatest": pa.array([x[2] for x in found.values()], pa.float64())})


def host_of(url: Column) -> Column:
    """The host, A-Z lower-cased; null without one."""
    host = F.regexp_extract(url, r"^.*?://([^/?#]*)", 1)
    return F.nullif(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def site_trees(pages: DataFrame, *, url_col="url", html_col="html", min_pages=MIN_PAGES) -> DataFrame:
    """``_host, _path, _pages, _importance, _greatest`` of every node of every site of ``min_pages`` pages or more."""
    rows = pages.select(host_of(F.col(url_col)).alias("_host"), F.col(html_col).alias("_html")).filter("_host is not null and _html <> ''")
    counts = rows.mapInArrow(tree_rows, TREE_ROWS).groupBy("_host", "_path", "_parent", "_depth", "_kind", "_value").agg(F.count(F.lit(1)).alias("_k"))

    def of(kind: int, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_kind") == kind, value)), F.lit(0))

    k, log = F.col("_k"), F.ln(F.col("_k"))
    nodes = counts.groupBy("_host", "_path", "_parent", "_depth").agg(
        of(2, k).alias("_pages"), of(1, F.lit(1)).alias("_features"), of(1, log).alias("_logs"),
        of(0, F.lit(1)).alias("_styles"), of(0, k).alias("_shown"), of(0, k * log).alias("_weighted"))
    nodes = written(nodes)
    large = nodes.filter((F.col("_depth") == 0) & (F.col("_pages") >= min_pages)).select("_host")
    return nodes.join(large, "_host", "left_semi").groupBy("_host").applyInArrow(_host_tree, "_host string, _path bigint, _pages bigint, _importance double, _greatest double")


def main_text(page: str, low: frozenset[int], roles: bool = True) -> tuple[str, int, int]:
    """(text, blocks that a role removes, further blocks that the tree removes)."""
    root = parse(page)
    every = blocks(root)
    kept = [b for b in every if not (roles and b.role)]
    if roles:
        inside = [b for b in kept if any(x.tag == "main" for x in b.node.chain())] or [b for b in kept if any(x.tag == "article" for x in b.node.chain())]
        kept = inside or kept
    by_roles = len(every) - len(kept)
    if low:
        branches = []  # the low branches around each block
        sizes: dict[int, int] = {}
        for b in kept:
            around = list(b.node.chain())
            inside = next((i for i, x in enumerate(around) if x.tag in MAIN), None)
            if inside is None:
                paths = {_hashed(b.node.path, "#text"), *(x.path for x in around)}
            else:
                paths = {x.path for x in around[:inside] if x.tag in PARTS}
            branches.append(paths & low)
            for p in branches[-1]:
                sizes[p] = sizes.get(p, 0) + len(b.text)
        total = sum(len(b.text) for b in kept)
        kept = [b for b, paths in zip(kept, branches) if all(2 * sizes[p] > total for p in paths)]
    return "\n".join(b.text for b in kept), by_roles, len(every) - by_roles - len(kept)


RESULT = "page_id bigint, url string, text string, n_chars bigint, role_blocks bigint, tree_blocks bigint"


def extractor(roles: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [frozenset(x or ()) for x in batch.column(3).to_pylist()]
            found = [main_text(page.as_py(), paths, roles) for page, paths in zip(batch.column(2), low)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([t for t, _, _ in found], pa.string()), pa.array([len(t) for t, _, _ in found], pa.int64()),
                 pa.array([n for _, n, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int64())],
                names=[c.split()[0] for c in RESULT.split(", ")])

    return run


def extract(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html", least=LEAST, min_pages=MIN_PAGES, roles=True) -> DataFrame:
    """``page_id, url, text, n_chars`` and the numbers of blocks removed, one row a row of ``pages``."""
    trees = site_trees(pages, url_col=url_col, html_col=html_col, min_pages=min_pages)
    low = trees.filter((F.col("_greatest") < least) & (F.col("_pages") >= min_pages))
    low = written(low.groupBy("_host").agg(F.collect_list("_path").alias("_low")))
    rows = pages.select(F.col(id_col).cast("bigint").alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"),
                        host_of(F.col(url_col)).alias("_host"))
    joined = rows.join(low, "_host", "left").select("_id", "_url", "_html", "_low")
    return joined.mapInArrow(extractor(roles), RESULT)


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
