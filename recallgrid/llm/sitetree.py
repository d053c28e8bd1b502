"""Main text by site style trees: the pages of a host are merged into one tree, whose dull branches are removed.

Every page's DOM is reduced to its block elements; an element's row of tags, classes and ids from the root down
(digits made alike) is its node in the host's tree, known by a hash of its parent's and its own label. A node
gathers, over the host's pages, the styles in which it occurs (its row of child elements) and the texts that it
holds. The entropy of the styles is its presentation importance; texts that return on many pages lower its content
importance. A branch's importance joins its own with that of the nodes below it. Branches and texts of low
importance (menus, notices and the like that a host repeats) are dropped from every page.

What HTML itself says is a prior. Elements that by their tag, role or class are navigation, adverts, forms, comments
and so on have none and go by these rules alone (a host's adverts and comments differ from page to page, so that
entropy can't tell them). Elsewhere the tree decides, inside an article as well as outside: the more pages a host
has, the more its counts move what the place of a text suggests, so that small hosts need no rule of their
own. Copies of a page count once for the tree, and an article of which less than half would be left is
a near copy of others, and stays.

The tree is a table of counts by host and node, never a group of pages: a host that has a third of all pages is
counted by partial sums. Pages look up the keys of dull nodes and texts, one 64-bit number each.
"""

from __future__ import annotations

import html as entities
import re
import struct
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import freeing, write_shared

#: Elements whose content is no text of the page.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "select", "head"}
#: Elements that are never the article's.
NOISE_TAGS = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "input", "label"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"}
#: Words in a class or id that mark an element as something other than the article.
NOISE_WORDS = {
    "ad", "ads", "adv", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav",
    "navbar", "navigation", "newsletter", "notice", "notification", "pagination", "popup", "promo", "related", "replies", "reply", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
MAIN_TAGS = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "ruby", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: A start tag ends these open elements.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond which an implied end does not reach.
SCOPES = {"table", "ul", "ol", "dl", "article", "section", "div", "body", "main", "td", "th", "blockquote"}
#: Levels of a tree. What stands deeper belongs to the node at this depth, as browsers' parsers have it; its text stays.
MOST_DEPTH = 256

LOW = 0.7
GAMMA = 0.9
#: A text's prior by its place (in an article, on a page without one, outside of the page's article; noise has 0), and
#: how far the counts of very many pages can move it.
PRIOR_MAIN, PRIOR, PRIOR_OUTSIDE = 1.0, 0.8, 0.5
WEIGHT_MAIN, WEIGHT = 0.33, 1.0
#: Pages' worth of evidence that the prior stands for.
NEUTRAL = 1
#: Keys of 8 bytes that are sent to all workers; with more of them pages meet their keys by a join.
MOST_KEYS = 4_000_000
#: Hosts (a name and a number each) that are broadcast.
MOST_HOSTS = 200_000

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[a-zA-Z/][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[a-z]+")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
ROOT = 0


def number(text: str, above: int = ROOT) -> int:
    """A 64-bit number of text below the node `above`."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), above & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


class Page:
    """A page's block elements, in order, and the texts that they hold."""

    def __init__(self, html: str):
        #: (node, whether noise by its own nature, whether within an article, text, its number) of each block of text
        self.blocks: list[tuple[int, bool, bool, str, int]] = []
        #: each node's parent; parents stand before their children
        self.parent: dict[int, int] = {ROOT: ROOT}
        self.depth: dict[int, int] = {ROOT: 0}
        self.children: dict[int, list[str]] = {ROOT: []}
        self.has_main = False
        # the open elements: tag, node, noise, main; inline elements have their block's node
        self.open: list[tuple[str, int, bool, bool]] = [("", ROOT, False, False)]
        self.count: Counter[str] = Counter()
        self.text: list[str] = []
        self._read(html)

    def _flush(self) -> None:
        if self.text:
            words = entities.unescape("".join(self.text)).split()
            self.text = []
            if words:
                _, node, noise, main = self.open[-1]
                text = " ".join(words)
                self.blocks.append((node, noise, main, text, number(text, node)))

    def _node(self, above: int, label: str) -> int:
        if self.depth[above] >= MOST_DEPTH:
            return above
        node = number(label, above)
        if node not in self.parent:
            self.parent[node], self.depth[node] = above, self.depth[above] + 1
        return node

    def _push(self, tag: str, node: int, noise: bool, main: bool) -> None:
        self.open.append((tag, node, noise, main))
        self.count[tag] += 1

    def _cut(self, i: int) -> None:
        for tag, *_ in self.open[i:]:
            self.count[tag] -= 1
        del self.open[i:]

    def _start(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            noise = bool(attributes) and self._marks(attributes)[1]
            _, node, above, main = self.open[-1]
            if noise and not above:  # an advert in a span is a block of its own
                self._flush()
                self._push("span!", self._node(node, f"{tag}!"), True, main)
            else:
                self._push(tag, node, above, main)
            return
        self._flush()
        if tag == "br":
            return
        ends = CLOSES.get(tag, ())
        if self.count["p"] or any(self.count[e] for e in ends):
            for i in range(len(self.open) - 1, 0, -1):
                name = self.open[i][0]
                if name == "p" or name in ends:
                    self._cut(i)
                    if name == "p":
                        continue
                    break
                if name in SCOPES:
                    break
        _, above, noisy, inside = self.open[-1]
        marks, noise = self._marks(attributes) if attributes else ("", False)
        noise = noise or tag in NOISE_TAGS or (tag == "header" and not inside)
        main = inside or (tag in MAIN_TAGS and not noise and not noisy)
        self.has_main = self.has_main or main
        self.children.setdefault(above, []).append(tag + marks)
        if tag not in VOID:
            self._push(tag, self._node(above, tag + marks), noisy or noise, main)

    @staticmethod
    def _marks(attributes: str) -> tuple[str, bool]:
        """The element's classes, id and role as part of its label, and whether they name something else than an article."""
        found, noise = [], False
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            found.append(f"{name.lower()[0]}={_DIGITS.sub('0', value)}")
            noise = noise or (value in NOISE_ROLES if name.lower() == "role" else not NOISE_WORDS.isdisjoint(_WORD.findall(value)))
        return ("[" + " ".join(sorted(found)) + "]" if found else ""), noise

    def _end(self, tag: str) -> None:
        inline = tag in INLINE
        if not self.count[tag] and not (inline and self.count["span!"]):
            return
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i][0]
            if name == tag or (inline and name == "span!"):
                if not inline or name == "span!":
                    self._flush()
                self._cut(i)
                return
            if inline and name not in INLINE:
                return

    def _read(self, html: str) -> None:
        at = 0
        while m := _TAG.search(html, at):
            if m.start() > at:
                self.text.append(html[at : m.start()])
            at = m.end()
            tag, attributes = (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
            if not tag or tag == "head":
                continue
            if m[1] or m[4]:
                self._end(tag)
            elif tag in RAW:
                self._flush()
                if not attributes.rstrip().endswith("/"):  # what stands inside is no markup: go to the end tag itself
                    end = re.compile(f"</{re.escape(tag)}", re.I).search(html, at)
                    at = end.start() if end else len(html)
            else:
                self._start(tag, attributes)
        self.text.append(html[at:])
        self._flush()

    def items(self) -> list[int]:
        """The numbers of all nodes and texts that can be dull: noise goes anyhow."""
        return [*self.parent, *(b[4] for b in self.blocks if not b[1])]

    def wanted(self, dull: set[int]) -> list[str]:
        """The texts of the blocks that are neither noise nor dull nor below a dull node.

        An article that is mostly dull stays, and so does all of a page without one of which nothing would be left.
        """
        below: dict[int, bool] = {}
        for node, parent in self.parent.items():
            below[node] = node in dull or (node != ROOT and below[parent])
        kept = [(main, below[node] or item in dull, text) for node, noise, main, text, item in self.blocks if not noise]
        copy = 2 * sum(len(t) for main, bad, t in kept if main and bad) > sum(len(t) for main, _, t in kept if main)
        empty = not self.has_main and all(bad for _, bad, _ in kept)
        return [t for main, bad, t in kept if not bad or (main and copy) or empty]

    def above(self, node: int) -> list[int]:
        """The node and all above it but the root."""
        found = []
        while node != ROOT:
            found.append(node)
            node = self.parent[node]
        return found

    def digest(self) -> int:
        return number("\n".join(b[3] for b in self.blocks if not b[1]))

    def features(self) -> list[tuple[int, int, int, float, list[int] | None]]:
        """The page's nodes with their styles (kind 0) and texts (kind 1): node, kind, value, prior, the nodes above a text."""
        found: dict[tuple[int, int, int], tuple] = {}
        for node, below in self.children.items():
            style = number(" ".join(x for i, x in enumerate(below) if not i or below[i - 1] != x))
            found[node, 0, style] = (node, 0, style, 0.0, None)
        for node, noise, main, _, item in self.blocks:
            if (node, 1, item) not in found:
                prior = 0.0 if noise else PRIOR_MAIN if main else PRIOR_OUTSIDE if self.has_main else PRIOR
                found[node, 1, item] = (node, 1, item, prior, self.above(node))
        return list(found.values())


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _lists(rows: list[list], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([x for row in rows for x in row], kind))


def page_nodes(pages: DataFrame) -> DataFrame:
    """host, digest, nodes of each page."""
    node = "node: bigint, kind: int, value: bigint, prior: double, above: array<bigint>"
    arrow = pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("value", pa.int64()), ("prior", pa.float64()), ("above", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [Page(h or "") for h in batch.column(1).to_pylist()]
            nodes = _lists([[dict(zip(("node", "kind", "value", "prior", "above"), v, strict=True)) for v in p.features()] for p in found], arrow)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.digest() for p in found], pa.int64()), nodes], ["host", "digest", "nodes"])

    return pages.select(host(), "html").mapInArrow(freeing(run), f"host string, digest long, nodes array<struct<{node}>>")


def host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), _HOST, 1)).alias("host")


def style_tree(pages: DataFrame) -> DataFrame:
    """host, item (a node's number, or a text's) and importance of every node and text of every host.

    For n distinct pages of a host: a style that c of a node's pages have adds -(c/m) log_n(c/m) to its presentation
    importance (m: pages with the node). A text that c pages have is worth 1 - log_n(c); its importance moves from the
    prior of its place towards that, by its place's weight and n / (n + NEUTRAL). A node's own content importance is
    the mean over its distinct texts; l styles weigh its presentation by 1 - GAMMA**l against that, where it is more. A
    branch has the importance of the most important node in it: only what is dull throughout is dropped. Noise isn't
    listed and counts for no other node.
    """
    once = page_nodes(pages).groupBy("host", "digest").agg(F.first("nodes").alias("nodes"))
    each = once.select("host", F.explode("nodes").alias("v")).select("host", "v.*")
    counts = write_shared(each.groupBy("host", "node", "above", "kind", "value").agg(F.count("*").alias("c"), F.max("prior").alias("prior")), "counts")
    # The root has one style for each page, so its styles' counts are the host's pages.
    sizes = write_shared(counts.where((F.col("node") == ROOT) & (F.col("kind") == 0)).groupBy("host").agg(F.sum("c").cast("double").alias("n")), "hosts")
    few = sizes.limit(MOST_HOSTS + 1).count() <= MOST_HOSTS
    known = counts.join(F.broadcast(sizes) if few else sizes, "host")
    log_n = F.log(F.greatest("n", F.lit(2.0)))
    weight = F.when(F.col("prior") == PRIOR_MAIN, WEIGHT_MAIN).otherwise(WEIGHT)
    worth = F.col("prior") + weight * F.when(F.col("n") > 1, F.col("n") / (F.col("n") + NEUTRAL) * (1 - F.log("c") / log_n - F.col("prior"))).otherwise(0)
    texts = known.where("kind = 1 AND prior > 0").select("host", "node", "above", "value", worth.alias("worth"))
    content = texts.groupBy("host", "node", "above").agg(F.avg("worth").alias("content"))
    styles = known.where("kind = 0").groupBy("host", "node", "n").agg(F.sum("c").alias("m"), F.count("*").alias("l"), F.sum(F.col("c") * F.log("c")).alias("c_logs"))
    shown = styles.select("host", "node", "l", ((F.log(F.col("m").cast("double")) - F.col("c_logs") / F.col("m")) / log_n).alias("style"))
    own = F.pow(F.lit(GAMMA), F.coalesce(F.col("l"), F.lit(0)))
    joint = F.greatest((1 - own) * F.coalesce(F.col("style"), F.lit(0)) + own * F.col("content"), "content")
    # A node counts for itself and for all above it.
    nodes = content.join(shown, ["host", "node"], "left").select("host", F.explode("above").alias("item"), joint.alias("importance"))
    return nodes.groupBy("host", "item").agg(F.max("importance").alias("importance")).union(texts.select("host", F.col("value").alias("item"), "worth"))


def _seed(name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), 42)


def key_of(seed: int, item: int) -> int:
    """F.xxhash64(host, item), seed being _seed(host)."""
    found = xxhash.xxh64_intdigest(struct.pack("<q", item), seed)
    return found - (1 << 64) if found >> 63 else found


def extract(pages: DataFrame, low: float = LOW, most_keys: int = MOST_KEYS) -> DataFrame:
    """For each row of pages (page_id, url, html): page_id, url, text and n_chars.

    text: the blocks that stay, in order, joined by a space; character references are decoded, and white space
    within a block is one space. Null html is empty; a page without text has ''. Pages without a host (or with a
    null url) form one host of no name. Repeated rows and ids give a row each; other columns aren't carried over;
    an empty table gives none. Elements may nest to any depth; see MOST_DEPTH.

    Up to most_keys dull keys are sent to all workers; beyond, a page's keys meet the dull ones by a join, and
    the page gets those that it has. Both ways give the same rows.
    """
    dull = style_tree(pages).where(F.col("importance") < low).select(F.xxhash64("host", "item").alias("key")).distinct()
    dull = write_shared(dull, "dull")
    kind = pages.schema["page_id"].dataType.simpleString()
    named = pages.select("page_id", "url", host(), "html")
    schema = f"page_id {kind}, url string, text string, n_chars long"

    def rows_of(batch: pa.RecordBatch, wanted: Callable[[int, Page, int], list[str]]) -> pa.RecordBatch:
        texts = [" ".join(wanted(i, Page(h or ""), _seed(name))) for i, (name, h) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    if dull.limit(most_keys + 1).count() <= most_keys:
        sent = pages.sparkSession.sparkContext.broadcast(np.sort(dull.toArrow().column(0).to_numpy()))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value

            def wanted(_: int, page: Page, seed: int) -> list[str]:
                items = page.items()
                keys = np.fromiter((key_of(seed, x) for x in items), np.int64, len(items))
                at = np.searchsorted(known, keys)
                hit = known[np.minimum(at, len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)
                return page.wanted({items[i] for i in np.flatnonzero(hit).tolist()})

            for batch in _slices(batches):
                yield rows_of(batch, wanted)

        return named.mapInArrow(freeing(look_up), schema)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [[key_of(_seed(name), x) for x in Page(h or "").items()] for name, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(found, pa.int64())], ["a", "b", "keys"])

    def own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            lists = batch.column(4).to_pylist()

            def wanted(i: int, page: Page, seed: int, lists: list = lists) -> list[str]:
                own = set(lists[i] or ())
                return page.wanted({x for x in page.items() if key_of(seed, x) in own})

            yield rows_of(batch, wanted)

    # A row is known by two hashes of its content: equal rows get equal lists.
    marked = named.select("*", F.xxhash64("page_id", "url", "html").alias("a"), F.xxhash64("html", "url", "page_id", F.lit(1)).alias("b"))
    each = marked.select("a", "b", "host", "html").mapInArrow(freeing(keys), "a long, b long, keys array<long>").select("a", "b", F.explode("keys").alias("key"))
    own = each.join(dull, "key", "left_semi").groupBy("a", "b").agg(F.collect_set("key").alias("keys"))
    return marked.join(own, ["a", "b"], "left").select("page_id", "url", "host", "html", "keys").mapInArrow(freeing(own_keys), schema)
