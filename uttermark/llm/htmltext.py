"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged: elements with the same chain of tags and classes
are one style node. For each node with m pages, a block of text that c of them show has
the normalized entropy log(c) / log(m); the node's content importance is one less the mean
over its distinct blocks. The importance of its presentation is the entropy of its
sequences of children. Both make the composite importance, presentation weighing more the
more children a node has. Few pages tell little, so a node's importance is drawn towards
that of the same chain on all hosts, and this towards 1, by a weight of ``PRIOR`` pages.
A branch without any important node is removed from each page.

What an element says of itself holds for every page: navigation, forms, scripts and the
like are removed by tag, role or class. A class such as ``sidebar`` may also stand on a
wrapper of the article, so an article or main element inside such a branch is kept where
it holds more text than all that is outside of it and no other article is there. Inside an
article statistics remove the smaller part at most: where they would take more than half
of its characters the host repeats the whole article, and it stays; so does its h1.

Trees are sums over (host, node, text): equal rows combine before they move, so neither a
host of a third of all pages nor a frequent block meets in one task as rows. Nodes know
their parent only, so the cost of a page grows with its size at any depth. Pages get the
unimportant nodes of their own by joins on ids; their html moves once at most.

Defined cases: a null or empty html has an empty text; so has a page without a block of
text. Broken markup is closed where the next block starts; a tag that the end cuts off
goes, a cut character reference stays text. A null url is a host of its own. Pages of any
length and depth are read whole. Repeated rows give equal texts, each a page of its host. An empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import table, written
from .registry import query

IMPORTANT = 0.5
#: So many pages weigh what is known of a node beforehand.
PRIOR = 3.0
DECAY = 0.9

# Word lists of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
#: Elements that end an open one of the kinds named, up to the nearest of the bounds.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
NEVER_TEXT = frozenset(
    "head script style noscript template iframe object svg canvas math audio video select "
    "datalist button textarea input".split()
)
NOISE_TAGS = frozenset("nav footer aside form dialog menu search".split())
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar "
    "toolbar form".split()
)
NOISE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead banner ad ads "
    "advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices newsletter subscribe subscription signup login share sharing "
    "social related recommended comment comments respond reply replies disqus discussion popup "
    "modal overlay widget toolbar pagination pager skip copyright legal".split()
)
#: Of these, words that no wrapper of an article has.
FINAL_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie "
    "cookies consent gdpr comment comments respond reply replies disqus discussion popup modal".split()
)
#: Names of classes that tell what a layout has rather than what an element is.
LAYOUT = re.compile(r"(?<![\w-])(?:has|with|no|without)-[\w-]+")
OWN_TEXT = frozenset(["article", "main"])
PAGE = frozenset(["html", "body"])
WORD = re.compile(r"[a-z]+")
#: A tag that the end of the page cuts off.
CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _id(parent: int, label: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{parent}/{label}") - 2**63


# How text is taken: as it is, if the page's article stands in a wrapper, or not at all.
CLEAR, ARTICLE, WRAPPER, DROPPED = range(4)
#: Inside the headline of an article, which is no node of the tree.
HEADLINE = 2


class Page(HTMLParser):
    """Blocks of text of a page, without branches of which all nodes are in ``low``.

    ``blocks`` has (style node, whether in an article, text), ``children`` the labels below
    each node and ``parent`` the node above each.
    """

    def __init__(self, html: str, low: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int, int]] = []  # tag, node, how, in an article
        self.count: Counter[str] = Counter()
        self.found: list[tuple[int, int, bool, str]] = []
        self.children: dict[int, list[str]] = {}
        self.parent: dict[int, int] = {}
        self.parts: list[str] = []
        self.place = (0, CLEAR, False)
        self.feed(CUT_TAG.sub("", html))
        self.close()
        self._flush()
        size = Counter()
        for how, _, _, text in self.found:
            size[how] += len(text)
        other = any(own for how, _, own, _ in self.found if how == CLEAR)
        last = ARTICLE if size[ARTICLE] > size[CLEAR] and not other else CLEAR
        self.blocks = [(node, own, text) for how, node, own, text in self.found if how <= last]
        if low:
            self._prune(low)

    def _prune(self, low: frozenset[int]) -> None:
        live: set[int] = set()
        for node, _, _ in self.blocks:
            if node not in low:
                while node and node not in live:
                    live.add(node)
                    node = self.parent[node]
        inside = sum(len(text) for _, own, text in self.blocks if own)
        gone = sum(len(text) for node, own, text in self.blocks if own and node not in live)
        whole = 2 * gone > inside
        self.blocks = [b for b in self.blocks if not b[0] or b[0] in live or b[1] and whole]

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            node, how, own = self.place
            self.found.append((how, node, own, text))

    def _close_to(self, at: int) -> None:
        if any(tag in BLOCKS for tag, *_ in self.open[at:]):
            self._flush()
        self.count.subtract(tag for tag, *_ in self.open[at:])
        del self.open[at:]

    def _noise(self, tag: str, attrs: dict, own: bool) -> int:
        """CLEAR, WRAPPER for what only a class or role says, or DROPPED."""
        if tag in NEVER_TEXT or tag in NOISE_TAGS or tag == "header" and not own:
            return DROPPED
        if tag in PAGE or tag in OWN_TEXT:
            return CLEAR
        if "hidden" in attrs or HIDDEN.search(attrs.get("style") or ""):
            return DROPPED
        told = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()
        names = WORD.findall(LAYOUT.sub(" ", told))
        if not FINAL_WORDS.isdisjoint(names):
            return DROPPED
        if not NOISE_WORDS.isdisjoint(names) or "header" in names and not own:
            return WRAPPER
        return WRAPPER if (attrs.get("role") or "").lower() in NOISE_ROLES else CLEAR

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag in ("br", "hr"):
                self.parts.append(" ")
            if tag == "hr":
                self._flush()
            return
        if tag in ENDS:
            kinds, bounds = ENDS[tag]
            if any(self.count[kind] for kind in kinds):
                for at in range(len(self.open) - 1, -1, -1):
                    if self.open[at][0] in kinds:
                        self._close_to(at)
                        break
                    if self.open[at][0] in bounds:
                        break
        elif tag in BLOCKS and self.count["p"]:  # a block ends an open paragraph
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] == "p":
                    self._close_to(at)
                    break
                if self.open[at][0] in BLOCKS:
                    break
        if tag in BLOCKS:
            self._flush()
        attrs = dict(attrs)
        _, parent, how, own = self.open[-1] if self.open else ("", 0, CLEAR, 0)
        names = sorted(set(WORD.findall(f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower())))
        label = ".".join([tag, *names])
        node = _id(parent, label)
        if how != DROPPED:
            self.children.setdefault(parent, []).append(label)
            self.parent[node] = parent
            how = max(how, self._noise(tag, attrs, own))
            if how == WRAPPER and tag in OWN_TEXT:
                how = ARTICLE
        self.count[tag] += 1
        if own and tag == "h1":
            own = HEADLINE
        self.open.append((tag, node, how, own or int(tag in OWN_TEXT)))

    def handle_endtag(self, tag):
        if tag == "br":
            self.parts.append(" ")
        if not self.count[tag]:
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._close_to(at)
                return

    def handle_data(self, data):
        _, node, how, own = self.open[-1] if self.open else ("", 0, CLEAR, 0)
        if how <= ARTICLE:
            self.parts.append(data)
            if data.strip():
                self.place = (0 if own == HEADLINE else node, how, bool(own))

    def text(self) -> str:
        return "\n".join(text for *_, text in self.blocks)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, host, html) -> what each style node of a page shows, once a page."""
    names = ["k1", "k2", "host", "node", "kind", "shown", "size", "first"]
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            rows = []
            for k1, k2, host, html in zip(*(c.to_pylist() for c in whole.slice(at, 256).columns)):
                page, seen = Page(html or ""), set()
                shown = [(node, 0, _id(0, text), 1) for node, _, text in page.blocks if node]
                rated = {node for node, *_ in shown}
                shown += [
                    (node, 1, _id(1, "/".join(labels)), len(labels))
                    for node, labels in page.children.items()
                    if node in rated
                ]
                for node, kind, what, size in dict.fromkeys(shown):
                    first = (node, kind) not in seen
                    seen.add((node, kind))
                    rows.append((k1, k2, host, node, kind, what, size, int(first)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32()]
            types += [pa.int64(), pa.int64(), pa.int64()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names
                )


def _texts(at: int, low_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                texts = [
                    Page(h.as_py() or "", frozenset(r.as_py() or ())).text()
                    for h, r in zip(batch.column(at), batch.column(low_at))
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                    names=["page_id", "url", "text"],
                )

    return run


def importance(nodes: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(host, node, pages, own, important) of all style nodes with text, from rows (host,
    node, kind, shown, size, first): their composite importance by the host's pages alone,
    and drawn towards that of all hosts."""
    counts = nodes.groupBy("host", "node", "kind", "shown").agg(
        F.count(F.lit(1)).alias("c"),
        F.sum("first").alias("first"),
        F.max("size").alias("size"),
    )
    content, style = F.col("kind") == 0, F.col("kind") == 1
    per_node = counts.groupBy("host", "node").agg(
        F.sum(F.when(content, F.col("first"))).alias("pages"),
        F.avg(F.when(content, F.log("c"))).alias("mean_log"),
        F.sum(F.when(style, F.col("first"))).alias("styled"),
        F.sum(F.when(style, F.col("c") * F.log("c"))).alias("sum_log"),
        F.sum(F.when(style, F.col("c") * F.col("size"))).alias("children"),
    )
    one = F.lit(1.0)
    by_content = F.when(F.col("pages") > 1, 1 - F.col("mean_log") / F.log("pages")).otherwise(one)
    spread = (F.log("styled") - F.col("sum_log") / F.col("styled")) / F.log("styled")
    by_style = F.when(F.col("styled") > 1, spread).when(F.col("styled") == 1, one)
    keep = F.pow(F.lit(DECAY), F.col("children") / F.col("styled"))
    # A page alone is compared with nothing; each further one is evidence.
    own = per_node.filter("pages > 0").select(
        "host",
        "node",
        "pages",
        (F.col("pages") - 1).alias("told"),
        F.coalesce((1 - keep) * by_style + keep * by_content, by_content).alias("own"),
    )
    everywhere = own.groupBy(F.col("node").alias("_node")).agg(
        ((F.sum(F.col("told") * F.col("own")) + prior) / (F.sum("told") + prior)).alias("elsewhere")
    )
    drawn = (F.col("told") * F.col("own") + prior * F.col("elsewhere")) / (F.col("told") + prior)
    return own.join(everywhere, F.col("node") == F.col("_node")).select(
        "host", "node", "pages", "own", drawn.alias("important")
    )


def main_text(pages: DataFrame, important: float = IMPORTANT, prior: float = PRIOR) -> DataFrame:
    """The main text of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    keyed = pages.select(
        "page_id",
        "url",
        "html",
        F.xxhash64(F.lit(1), "page_id", "url", "html").alias("k1"),
        F.xxhash64(F.lit(2), "html", "url", "page_id").alias("k2"),
        F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit("")).alias("host"),
    )
    nodes = written(
        keyed.select("k1", "k2", "host", "html").mapInArrow(
            _nodes,
            "k1 bigint, k2 bigint, host string, node bigint, kind int, shown bigint, "
            "size bigint, first bigint",
        ),
        "nodes",
    )
    low = written(
        importance(nodes, prior).filter(F.col("important") < important).select("host", "node"),
        "low",
    )
    per_page = (
        nodes.filter("kind = 0 AND first = 1")
        .select("k1", "k2", "host", "node")
        .join(low, ["host", "node"])
        .groupBy("k1", "k2")
        .agg(F.collect_set("node").alias("low"))
    )
    found = (
        keyed.join(written(per_page, "per_page"), ["k1", "k2"], "left")
        .select("page_id", "url", "html", "low")
        .mapInArrow(_texts(2, 3), "page_id bigint, url string, text string")
    )
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))


@query("op5_html_main_text")
def op5(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
