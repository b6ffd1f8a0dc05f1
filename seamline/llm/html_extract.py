"""Main text of web pages by site style trees.

All distinct pages of a host are merged into one tree, whose nodes are element paths with their
tags, classes and ids. Over the pages that have a node, three entropies in [0, 1] say how it
varies: content (the texts in its branch), presentation (the layouts of its branch) and form (the
sequence of its own children). Few pages say little, so an entropy is drawn towards 1 as if
PRIOR_PAGES further pages had each differed. From these a branch has low importance

- if its content is the same on nearly all pages, or
- if it fills a place of a template, whose form does not change, always with the same layout,
  while another place of it varies from page to page or holds an article: menus, adverts, notices
  and footers, though their texts may change. Headings and paragraphs have no layout that could
  vary and are judged by content alone.

Low branches go from every page of the host. What an element calls itself is a feature beside
these: a tag, role or class that names a menu, header, footer, sidebar, notice, advert, form,
script, style or comment makes its branch unimportant on any host, however few pages it has, and
an article or main element is never low for its presentation.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Set

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import BROADCAST_KEYS, cut

#: A node under LOW is low; one from HIGH on shows that pages differ there.
LOW, HIGH, PRIOR_PAGES = 0.3, 0.6, 2.0

TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup or no text.
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes svg".split())
#: Elements that stand on lines of their own; all others run within a line.
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary
    table tbody td tfoot th thead title tr ul""".split()
)
#: Elements of running text, whose layout says nothing about them.
PLAIN = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre article main".split())
#: Elements that never hold main text.
NOISE_TAGS = frozenset("head nav footer aside form button select option label input menu dialog object canvas audio video fieldset search".split()) | RAW
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that name such a branch: anywhere in a compound of ordinary words, or (WEAK) with layout words only.
NOISE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promotion
    nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toolbar topbar masthead sidebar
    cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup signin login
    comment comments commentlist replies respond disqus share sharing social recommended recommendations copyright disclaimer""".split()
)
WEAK_WORDS = frozenset("banner header footer foot aside rail notice notices alert reply related widget widgets form search skip promoted".split())
LAYOUT_WORDS = frozenset(
    """box boxes bar container wrapper wrap block area list item items inner outer unit slot top bottom left right center main site page
    global primary secondary fixed sticky link links button buttons icon icons text title heading body content section group row
    column col panel card desktop mobile small large first last js the and to""".split()
)
TEXT_WORDS = frozenset("post article entry story blog news reader readers user users media thread tree".split())
#: Elements that an opening tag of the same set closes, up to a container of theirs.
CLOSED_BY = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"})}
BLOCK_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SPLIT_NAME = re.compile(r"[^a-z0-9]+")
DIGITS = re.compile(r"[0-9]+")


def names_of(attributes: str) -> tuple[str, str]:
    """(class and id, role) in lower case."""
    named, role = [], ""
    for m in NAMED.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").strip().lower()
        if m[1].lower() == "role":
            role = value
        elif value:
            named.append(value)
    return " ".join(named), role


def names_noise(named: str) -> bool:
    """Whether a class or id says that its element is no main text: a noise word, alone or in a compound
    with words of layout (`cookie-bar`) or of texts (`post-comments`), but not any word (`ad-hoc`)."""
    for name in named.split():
        words = {DIGITS.sub("", w) for w in SPLIT_NAME.split(name)} - {""}
        noise, rest = words & NOISE_WORDS, words - NOISE_WORDS - WEAK_WORDS - LAYOUT_WORDS
        if noise and not rest - TEXT_WORDS or words & WEAK_WORDS and not rest:
            return True
    return False


class Page:
    """A page as a tree. Element 0 is the page itself; of each further element, in page order, its parent,
    tag, path (a hash of the host and the labels above and of it), whether it says that it is noise or
    main text, and whether an end tag closes it. `blocks` holds lists of (element, text as written);
    `within` holds, for each block element, its child elements and block numbers (as -1 - number).

    Unclosed and stray tags are repaired as browsers would: an end tag without its start is dropped,
    and one of an element within a line closes no element that stands on its own lines.
    """

    def __init__(self, page: str, host: str = "") -> None:
        root = xxhash.xxh64_intdigest(host.encode("utf-8", "replace"))
        self.parent, self.tag, self.path, self.noise, self.main, self.closed = [-1], [""], [root], [False], [False], [True]
        self.holder = [0]  # of each element, the block element that it is or stands in
        self.blocks: list[list[tuple[int, str]]] = []
        self.within: dict[int, list[int]] = {0: []}
        self._pieces: list[tuple[int, str]] = []
        self._stack, self._open, self._mains = [0], Counter(), 0
        self._parse(page)
        self._flush()

    def _flush(self) -> None:
        if any(not text.isspace() for _, text in self._pieces):
            self.within[self.holder[self._stack[-1]]].append(-1 - len(self.blocks))
            self.blocks.append(self._pieces)
            self._pieces = []
        else:
            self._pieces.clear()

    def _pop(self, depth: int) -> None:
        for i in self._stack[depth:]:
            self._open[self.tag[i]] -= 1
            self._mains -= self.main[i]
        del self._stack[depth:]

    def _add(self, tag: str, attributes: str) -> None:
        named, role = names_of(attributes) if attributes and not attributes.isspace() else ("", "")
        above, here = self._stack[-1], len(self.tag)
        noise = tag in NOISE_TAGS or role in NOISE_ROLES or tag == "header" and not self._mains or bool(named) and tag not in ("html", "body") and names_noise(named)
        self.parent.append(above)
        self.tag.append(tag)
        self.noise.append(noise)
        self.main.append(not noise and (tag in ("article", "main") or role in ("main", "article")))
        self.closed.append(False)
        if tag in BLOCK:
            # numbers in names differ from page to page
            label = f"{tag}.{DIGITS.sub('0', named)}" if named else tag
            self.path.append(xxhash.xxh64_intdigest(label.encode("utf-8", "replace"), self.path[above]))
            self.within[self.holder[above]].append(here)
            self.within[here] = []
            self.holder.append(here)
        else:
            self.path.append(self.path[above])
            self.holder.append(self.holder[above])
        self._stack.append(here)
        self._open[tag] += 1
        self._mains += self.main[here]

    def _end(self, tag: str) -> None:
        if not self._open[tag]:
            if tag in ("br", "p"):
                self._flush()
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            i = self._stack[depth]
            if self.tag[i] == tag:
                if tag in BLOCK:
                    self._flush()
                self.closed[i] = True
                self._pop(depth)
                return
            if tag not in BLOCK and i in self.within:
                return

    def _close_before(self, tag: str) -> None:
        """Ends what a start tag implies the end of."""
        if tag in BLOCK_CLOSES_P and self._open["p"]:
            for depth in range(len(self._stack) - 1, 0, -1):
                above = self.tag[self._stack[depth]]
                if above == "p":
                    self._pop(depth)
                    break
                if above in BLOCK_CLOSES_P:
                    break
        if tag in CLOSED_BY:
            closes, within = CLOSED_BY[tag][0].split(), CLOSED_BY[tag][1]
            lowest = None
            if any(self._open[t] for t in closes):
                for depth in range(len(self._stack) - 1, 0, -1):
                    above = self.tag[self._stack[depth]]
                    if above in within:
                        break
                    if above in closes:
                        lowest = depth
                        if tag == "li":
                            break
            if lowest is not None:
                self._pop(lowest)

    def _parse(self, page: str) -> None:
        at, last = 0, page.rfind(">") + 1
        while m := TOKEN.search(page, at, last):
            if m.start() > at:
                self._pieces.append((self._stack[-1], page[at : m.start()]))
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    self._pieces.append((self._stack[-1], html.escape(m[0][9:-3])))
                elif m[0].startswith("<!--") and not m[0].endswith("-->"):
                    return
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            if tag in BLOCK or tag == "br":
                self._flush()
            self._close_before(tag)
            if tag in VOID or m[3].endswith("/") and tag not in RAW and tag in BLOCK:
                continue
            self._add(tag, m[3])
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else len(page)
                self._pop(len(self._stack) - 1)
                if not close:
                    return
        self._pieces.append((self._stack[-1], page[at:]))

    def text(self, low: Set[int], by_name: bool = True) -> str:
        """The blocks outside low and noise branches. An article or main element ends a noise element
        around it that no end tag closes."""
        gone = [-1] * len(self.tag)  # the outermost element with which each one goes
        for i in range(1, len(self.tag)):
            gone[i] = above = gone[self.parent[i]]
            if above >= 0 and self.main[i] and not self.closed[above] and self.path[above] not in low:
                gone[i] = above = -1
            if above < 0 and (by_name and self.noise[i] or not by_name and self.tag[i] in RAW or self.path[i] in low and self.tag[i] in BLOCK):
                gone[i] = i
        said = (" ".join(html.unescape("".join(text for i, text in block if gone[i] < 0)).split()) for block in self.blocks)
        return " ".join(s for s in said if s)

    def features(self) -> dict[int, tuple[int, int, int, int, bool, bool]]:
        """Of each path below the page's own: parent path, hashes of the texts, layouts and forms of its
        branches, whether it is plain and whether it is main text."""
        said = [hash(tuple(xxhash.xxh64_intdigest(s.encode("utf-8", "replace")) >> 1 for s in " ".join(text for _, text in b).split())) for b in self.blocks]
        texts, layouts, found = {}, {}, {}
        for i in reversed(self.within):  # children come after their parents
            inside = self.within[i]
            texts[i] = hash(tuple(texts[c] if c >= 0 else said[-1 - c] for c in inside))
            layouts[i] = hash((self.path[i] >> 1, *(layouts[c] if c >= 0 else 1 for c in inside)))
            form = hash(tuple(self.path[c] >> 1 if c >= 0 else 1 for c in inside))
            if i:
                found.setdefault(self.path[i], []).append((i, texts[i], layouts[i], form))
        out = {}
        for path, same in found.items():
            first = same[0][0]
            columns = list(zip(*same, strict=True))
            out[path] = (self.path[self.parent[first]], *(hash(c) for c in columns[1:]), self.tag[first] in PLAIN, any(self.main[i] for i in columns[0]))
        return out


def host_of(url: str | None) -> str:
    """Lower-case host of a URL; '' where there is none."""
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def main_text(page: str | None, host: str = "", low: Set[int] = frozenset(), by_name: bool = True) -> str:
    """Main text of a page, without branches whose path is in `low` or, if by_name, that say they are noise."""
    return Page(page or "", host).text(low, by_name)


def signed(path: int) -> int:
    return path - (1 << 63)


def style_nodes(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """host, page_key and nodes of each page: the features of its paths."""
    names = ["path", "parent", "text", "layout", "form", "plain", "main"]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, keys, rows, ends = [], [], [], [0]
            for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hosts.append(host_of(u))
                found = Page(h or "", hosts[-1]).features()
                rows += [(signed(p), signed(f[0]), *f[1:]) for p, f in found.items()]
                keys.append(hash(tuple(x for p, f in found.items() for x in (p >> 1, *f[1:4]))))
                ends.append(len(rows))
            columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]
            nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), nodes], ["host", "page_key", "nodes"])

    struct = ", ".join(f"{n}: {'boolean' if n in ('plain', 'main') else 'long'}" for n in names)
    return pages.select(F.col(url).alias("url"), F.col(page).alias("html")).mapInArrow(run, f"host string, page_key long, nodes array<struct<{struct}>>")


def style_tree(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """host, path, parent, pages, content, presentation, form, plain, main of the site style trees' nodes;
    copies of a page count once."""
    distinct = style_nodes(pages, url, page).groupBy("host", "page_key").agg(F.first("nodes").alias("nodes"))
    nodes = distinct.select("host", F.explode("nodes").alias("n")).select("host", "n.*")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in enumerate(("text", "layout", "form"))))
    each = nodes.select("host", "path", "parent", "plain", "main", F.explode(kinds).alias("x")).select("host", "path", "parent", "plain", "main", "x.*")
    same = each.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"), F.min("parent").alias("parent"), F.max("plain").alias("plain"), F.max("main").alias("main"))

    def entropy(kind: int) -> F.Column:
        n, nlogn = F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.sum(F.when(F.col("kind") == kind, F.col("n") * F.log("n")))
        plain = F.when(n > 1, (F.log(n) - nlogn / n) / F.log(n)).otherwise(1.0)
        return (plain * n + PRIOR_PAGES) / (n + PRIOR_PAGES)

    return same.groupBy("host", "path").agg(
        F.min("parent").alias("parent"),
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"),
        *(entropy(k).alias(c) for k, c in enumerate(("content", "presentation", "form"))),
        F.max("plain").alias("plain"),
        F.max("main").alias("main"),
    )


def low_importance(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """host, path of the nodes of low importance."""
    tree = cut(style_tree(pages, url, page))
    around = tree.groupBy("host", "parent").agg(F.max("presentation").alias("varies"), F.max("main").alias("has_main"))
    above = tree.select("host", F.col("path").alias("parent"), F.col("form").alias("template"))
    placed = tree.join(around, ["host", "parent"]).join(above, ["host", "parent"])
    filler = (F.col("template") < LOW) & (F.col("presentation") < LOW) & ~F.col("plain") & ~F.col("main") & ((F.col("varies") >= HIGH) | F.col("has_main"))
    return tree.where(F.col("content") < LOW).select("host", "path").unionByName(placed.where(filler).select("host", "path")).distinct()


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", by_name: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every row; without by_name, by the style tree alone.

    Character references are decoded; white space inside a block becomes one space; blocks join in
    page order by one space. Null html is empty and gives an empty text; a null or unreadable url
    has host ''. Pages of any length and depth are read whole, in time that grows with their
    length. Rows that repeat an id are pages of their own. An empty table gives no rows. Other
    columns are not read.
    """
    low = cut(low_importance(pages, url, page))
    kind = pages.schema[page_id].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long"
    chosen = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))

    def rows(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if low.count() <= BROADCAST_KEYS:
        shared = pages.sparkSession.sparkContext.broadcast(np.sort(np.array([r.path for r in low.select("path").collect()], np.int64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = {p + (1 << 63) for p in shared.value.tolist()}
            for batch in batches:
                yield rows(batch, [main_text(h, host_of(u), known, by_name) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)])

        return chosen.mapInArrow(run, schema)

    # too many nodes to hold at once: each page gets those of its host
    of_host = low.groupBy("host").agg(F.collect_list("path").alias("low"))
    named = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in (1, 2, 3))
            yield rows(batch, [main_text(h, host_of(u), {p + (1 << 63) for p in n or ()}, by_name) for u, h, n in zip(*columns, strict=True)])

    return chosen.withColumn("host", named).join(of_host, "host", "left").select("page_id", "url", "html", "low").mapInArrow(joined, schema)
