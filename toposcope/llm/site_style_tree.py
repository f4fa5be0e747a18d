"""Main text of web pages by a site style tree.

The DOMs of one host's pages are merged: element nodes with the same path of tags, classes
and ids are one presentation node of the tree, and what it holds on a page is a content
node below it.  All nodes are merged, whatever their names.  Over the m pages that have a
presentation node,

- a content that n of them share has importance 1 - log_m(n);
- the layout's importance is the entropy (base m) of the node's child sequence and size;
- the node's own importance is (1 - links) * (WEIGHT * share + (1 - WEIGHT) * layout):
  links is the share of its text inside links, share that of the host's information that
  it holds (characters times the importance of their content).

A branch whose content and layout together are below LOW is noise that the site repeats.
The story of a host's pages is in its content nodes: presentation nodes that occur once a
page, have importance KEPT or more, and no child with over half of their information.
Branches outside them are of low importance and go: menus, adverts and footers, also those
that differ on each page.  Pages of equal whole content count once, so copies of an
article do not make it look like a menu.

Names are a prior for what entropy cannot tell: inside content nodes, a part that names
its role (nav, footer, class "ad", comments, ...) goes, unless it holds most of the page.
On hosts with fewer than `least_pages` pages, and on pages without a content node, names
and the elements article and main decide alone.  Then character references are decoded,
white space inside a block becomes one space, and blocks are joined by two newlines.

Statistics are counts by (host, node, content), summed before each shuffle, so a host
with a third of all pages costs no task more than its share.  A low branch is on at least
m ** 0.7 pages, so a host's list grows with m ** 0.3 at most.  Lists are broadcast, in
parts of about `broadcast_rows` rows for some of the hosts each; pages are read once for
each part and extracted once, and never shuffled.

Defined results: null or empty html has the empty text; a null url is a host of its own
name ''; repeated rows are treated alike; unclosed and misnested tags are repaired as the
usual implied ends; other columns pass through unless they have the name of a result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from collections.abc import Set as AbstractSet

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toposcope.llm._shared import scratch, small_batches, stash, table

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|noscript|template|svg|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"  # a quote that is never closed: the tag ends at the next sign
    r"|<[!?][^>]*>"
    r"|[^<]+|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOKEN = re.compile(r"[a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: an opening tag ends these open elements, up to the nearest of the second set
IMPLIED = {
    **{t: (frozenset({"p"}), frozenset({"td", "th", "li", "div", "article", "section", "body"})) for t in BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}},
    "li": (frozenset({"li"}), frozenset({"ul", "ol"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
NOISE_TAGS = frozenset("head nav footer aside form button select dialog object canvas menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_NAMES = frozenset(
    "nav navbar navigation menu footer sidebar aside ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus replies reply "
    "share sharing social related recommended breadcrumb breadcrumbs pagination pager toolbar widget widgets search skip copyright masthead topbar".split()
)

WEIGHT = 0.9
LOW = 0.25
KEPT = 0.15


class Node:
    __slots__ = ("chars", "content", "key", "links", "named", "noise", "parts", "region", "style", "tag")

    def __init__(self, tag: str, key: int, noise: bool, region: bool, named: bool = False):
        self.tag, self.key, self.noise, self.region, self.named = tag, key, noise, region, named
        self.parts: list = []
        self.content = self.style = self.chars = self.links = 0


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw.isspace():
        return {}
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}


def _node(tag: str, raw: str, parent: Node | None, in_region: bool) -> Node:
    a = _attributes(raw)
    names = f"{a.get('class', '')} {a.get('id', '')}".lower() if a else ""
    role = a.get("role", "").lower()
    key = xxhash.xxh64_intdigest(f"{parent.key if parent else 0} {tag} {names} {role}")
    noise = tag in NOISE_TAGS or role in NOISE_ROLES or "hidden" in a or "display:none" in a.get("style", "").replace(" ", "").lower()
    # the page's header is noise, an article's own header holds its headline
    noise = noise or (not in_region and tag == "header")
    tokens = _TOKEN.findall(names)
    named = not noise and (not NOISE_NAMES.isdisjoint(tokens) or (not in_region and "header" in tokens))
    return Node(tag, key, noise or named, tag in ("article", "main") or role in ("main", "article"), named and not in_region)


def _spare(root: Node) -> None:
    """A name does not make noise of html, body, main, what holds main, or most of a page's text."""
    order = _in_order(root)
    if not any(n.named for n in order):
        return
    size, holds = {}, {}
    for n in reversed(order):
        parts = [p for p in n.parts if not isinstance(p, str)]
        drop = n.noise and not n.named
        size[id(n)] = 0 if drop else sum(len(p.strip()) for p in n.parts if isinstance(p, str)) + sum(size[id(p)] for p in parts)
        holds[id(n)] = not drop and (n.tag in ("html", "body", "main") or any(holds[id(p)] for p in parts))
    for n in order:
        if n.named and (holds[id(n)] or 2 * size[id(n)] > size[id(root)]):
            n.noise = False


class _Open:
    """The open elements, with the places of each tag: whatever a page holds, a tag costs a few steps."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.regions = 0

    def last(self, tags) -> int:
        """Place of the innermost of these elements; 0 if none is open."""
        best = 0
        for tag in tags:
            own = self.places.get(tag)
            if own and own[-1] > best:
                best = own[-1]
        return best

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)
        self.regions += node.region

    def close(self, place: int) -> None:
        """End the element at a place and all inside it."""
        while place and len(self.stack) > place:
            node = self.stack.pop()
            self.places[node.tag].pop()
            self.regions -= node.region


def parse(page: str) -> Node:
    """The element tree of a page, in time that grows with its length."""
    root = Node("#root", 0, False, False)
    opened = _Open(root)
    end = page.rfind(">")
    for m in _PIECE.finditer(page):
        if m.start() > end:  # no tag ends from here on
            opened.stack[-1].parts.append(page[m.start() :].split("<!--", 1)[0])
            break
        tag = m[3] or m[6]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                opened.stack[-1].parts.append(text)
            continue
        tag, raw = tag.lower(), m[4] if m[3] else m[7]
        if m[2] or m[5]:
            if own := opened.places.get(tag):
                opened.close(own[-1])
            continue
        if tag in IMPLIED:
            ends, until = IMPLIED[tag]
            place = opened.last(ends)
            if place and place > opened.last(until):
                opened.close(place)
        node = _node(tag, raw, opened.stack[-1], opened.regions > 0)
        opened.stack[-1].parts.append(node)
        if tag not in VOID and not raw.endswith("/"):
            opened.push(node)
    _spare(root)
    return root


def _in_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(p for p in node.parts if not isinstance(p, str))
    return out


def measure(root: Node) -> None:
    """Sets each node's content, style and size, from its parts upwards."""
    for node in reversed(_in_order(root)):
        content, style, last = xxhash.xxh64(), xxhash.xxh64(), None
        for p in node.parts:
            if isinstance(p, str):
                text = " ".join(p.split())
                content.update(text.encode("utf-8", "surrogatepass"))
                node.chars += len(text)
            else:
                content.update(p.content.to_bytes(8, "little"))
                node.chars += p.chars
                node.links += p.links
                if p.tag != last:
                    style.update(p.key.to_bytes(8, "little"))
                last = p.tag
        if node.tag == "a":
            node.links = node.chars
        style.update(node.chars.bit_length().to_bytes(8, "little"))
        node.content, node.style = content.intdigest(), style.intdigest()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def branch(node: Node) -> int:
    """What a page's branch is known by in the list of low branches."""
    return _signed(xxhash.xxh64_intdigest(node.key.to_bytes(8, "little") + node.content.to_bytes(8, "little")))


def blocks(root: Node, low: AbstractSet[int] = frozenset(), kept: AbstractSet[int] = frozenset(), names: bool = True) -> list[str]:
    """Block texts in page order, without low branches.

    kept: keys of the host's content nodes, whose texts alone are taken if the page has one
    of them; else those of article regions, if they hold most of what names leave over.
    """
    stories, regions, nodes = [], [], [root]
    while nodes:  # topmost content nodes, and topmost regions outside noise
        node = nodes.pop()
        if _signed(node.key) in kept:
            stories.append(node)
        else:
            nodes.extend(p for p in reversed(node.parts) if not isinstance(p, str))
    if stories:
        for node in stories:
            node.noise = False
        return _texts(stories, low, names)
    nodes = [root]
    while nodes:
        node = nodes.pop()
        if names and node.noise:
            continue
        if names and node.region:
            regions.append(node)
        else:
            nodes.extend(p for p in reversed(node.parts) if not isinstance(p, str))
    whole = _texts([root], low, names)
    own = _texts(regions, low, names) if regions else whole
    return own if 2 * sum(map(len, own)) >= sum(map(len, whole)) else whole


def _texts(starts: list[Node], low: AbstractSet[int], names: bool) -> list[str]:
    """Block texts of the nodes."""
    out, words = [], []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(words)).split())
        words.clear()
        if text:
            out.append(text)

    for start in starts:
        todo: list = [start]
        while todo:
            part = todo.pop()
            if part is None:
                flush()
            elif isinstance(part, str):
                words.append(part)
            elif part.tag == "br":
                words.append("\n")
            elif not (part.noise and (names or part.tag == "head")) and not (low and part.key and not (names and part.region) and branch(part) in low):
                if part.tag in BLOCK or part.tag == "#root":
                    flush()
                    todo.append(None)
                todo.extend(reversed(part.parts))
            elif part.tag in BLOCK:
                flush()
    return out


def main_text(page: str | None, low: AbstractSet[int] = frozenset(), kept: AbstractSet[int] = frozenset(), names: bool = True) -> str:
    if not page:
        return ""
    root = parse(page)
    if low:
        measure(root)
    return "\n\n".join(blocks(root, low, kept, names))


def host_of(url):
    """Lower-case host of a url column; '' for null."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


TREE = "host string, page long, parent long, node long, branch long, style long, times int, chars long, links long"


def _tree_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to rows of TREE, one for each distinct content of a presentation node on a page."""
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            out = []
            for host, page in zip(batch.column(0), batch.column(1), strict=True):
                root = parse(page.as_py())
                measure(root)
                own, up = _signed(root.content), {id(root): 0}
                seen, times = {}, Counter()
                for node in _in_order(root):
                    for p in node.parts:
                        if not isinstance(p, str):
                            up[id(p)] = node.key
                    if node.parts:
                        times[node.key] += 1
                        seen[branch(node)] = node
                out += [(host.as_py(), own, _signed(up[id(n)]), _signed(n.key), b, _signed(n.style), times[n.key], n.chars, n.links) for b, n in seen.items()]
            cols = list(zip(*out, strict=True)) or [[]] * 9
            kinds = [pa.string(), *[pa.int64()] * 5, pa.int32(), pa.int64(), pa.int64()]
            names = [f.split()[0] for f in TREE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def tree(pages: DataFrame) -> DataFrame:
    """The merged trees: a row for each (host, node, content, layout), with its pages; pages have host and html."""
    rows = pages.where(F.col("html").isNotNull()).select("host", "html").mapInArrow(_tree_task, TREE).distinct()
    return rows.groupBy("host", "parent", "node", "branch", "style").agg(F.count("*").alias("n"), F.max("times").alias("times"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))


def importance(merged: DataFrame, least_pages: int) -> tuple[DataFrame, DataFrame]:
    """Presentation nodes (host, parent, node, times, info, layout, importance), and contents (host, node, branch, content) of theirs."""
    key = ["host", "node"]
    total = merged.groupBy(*key).agg(F.sum("n").alias("m"), F.max("times").alias("times"), F.max("parent").alias("parent"), F.sum("chars").alias("all"), F.sum("links").alias("links")).where(F.col("m") >= least_pages)
    contents = merged.groupBy(*key, "branch").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).join(total.select(*key, "m"), key)
    contents = contents.withColumn("content", 1 - F.log("n") / F.log("m"))
    layouts = merged.groupBy(*key, "style").agg(F.sum("n").alias("s")).join(total.select(*key, "m"), key)
    layouts = layouts.groupBy(*key).agg(F.sum(-F.col("s") / F.col("m") * F.log(F.col("s") / F.col("m")) / F.log("m")).alias("layout"))
    nodes = contents.groupBy(*key).agg(F.sum(F.col("chars") * F.col("content")).alias("info")).join(total, key).join(layouts, key)
    roots = nodes.where("node = 0").select("host", F.col("info").alias("whole"))
    share = F.when(F.col("whole") > 0, F.col("info") / F.col("whole")).otherwise(0.0)
    linked = F.when(F.col("all") > 0, F.col("links") / F.col("all")).otherwise(0.0)
    nodes = nodes.join(roots, "host").withColumn("importance", (1 - linked) * (WEIGHT * share + (1 - WEIGHT) * F.col("layout")))
    return nodes.select("host", "parent", "node", "times", "info", "layout", "importance"), contents.select("host", "node", "branch", "n", "chars", "content")


def found_out(pages: DataFrame, least_pages: int = 12, low: float = LOW, kept: float = KEPT, path: str | None = None) -> DataFrame:
    """(host, key, story): content nodes to keep (story) and low branches, from all pages; pages have host and html."""
    spark = pages.sparkSession
    path = path or scratch(spark)
    merged = stash(tree(pages), f"{path}/tree")
    nodes, contents = importance(merged, least_pages)
    nodes = stash(nodes, f"{path}/nodes")
    # at least this many pages must share a content before it can be low
    shared = contents.where("n > 2 and chars > 0").join(nodes.where("node <> 0").select("host", "node", "layout"), ["host", "node"])
    gone = shared.where((1 - WEIGHT) * F.col("layout") + WEIGHT * F.col("content") < low).select("host", F.col("branch").alias("key"), F.lit(False).alias("story"))
    below = nodes.where("times = 1 and node <> 0").groupBy("host", F.col("parent").alias("node")).agg(F.max("info").alias("most"))
    stories = nodes.where((F.col("times") == 1) & (F.col("node") != 0) & (F.col("importance") >= kept)).join(below, ["host", "node"], "left")
    stories = stories.where(F.coalesce("most", F.lit(0.0)) <= F.col("info") / 2).select("host", F.col("node").alias("key"), F.lit(True).alias("story"))
    return stash(gone.unionByName(stories).distinct(), f"{path}/found")


def extract(pages: DataFrame, broadcast_rows: int = 500_000, names: bool = True, **options) -> DataFrame:
    """pages without html, plus text and n_chars; pages have url and html; names: see blocks()."""
    spark = pages.sparkSession
    small_batches(spark)
    host = host_of(F.col("url")).alias("host")
    found = found_out(pages.select(host, "html"), **options)
    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    named = pages.select(*[F.col(f"`{c}`") for c in kept], F.struct(host, "html").alias("__page"))
    schema = T.StructType([pages.schema[c] for c in kept]).add("text", "string").add("n_chars", "long")
    parts = max(1, -(-found.count() // broadcast_rows))
    part = lambda c: F.pmod(F.xxhash64(c, F.lit(7)), F.lit(parts))

    def run_with(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, none = shared.value, (frozenset(), frozenset())
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    batch = whole.slice(at, 500)
                    hosts, pages = batch.column(len(kept)).flatten()
                    texts = [main_text(page.as_py(), *known.get(host.as_py(), none), names) for host, page in zip(hosts, pages, strict=True)]
                    cols = [batch.column(i) for i in range(len(kept))]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

        return run

    out = None
    for k in range(parts):
        by_host: dict[str, tuple[set[int], set[int]]] = {}
        for r in found.where(part("host") == k).toLocalIterator():
            by_host.setdefault(r["host"], (set(), set()))[r["story"]].add(r["key"])
        shared = spark.sparkContext.broadcast(by_host)
        done = named.where(part("__page.host") == k).mapInArrow(run_with(shared), schema)
        out = done if out is None else out.unionByName(done)
    return out


def op7_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
