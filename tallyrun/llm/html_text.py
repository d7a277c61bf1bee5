"""Main text of HTML pages with site template removal.

Pages are parsed once, without regard to well-formedness, into blocks of text and hashed element subtrees. Elements that
are boilerplate by what they are (menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles,
comments) lose their text at once. Of what is left the article or main element is the text, where there is one. Then, in
every page and inside articles too, subtrees that recur on many pages of the same host are deleted: all pages' subtrees
are counted per host in Spark, once for each distinct text of a page, so that copies of a page are no template, and a
page's blocks inside a recurring subtree go. Inside an article, cells, rows, items, headings and paragraphs, lists
and tables without attributes are no template by themselves, since articles of a site repeat passages, only with what is
around them. Only where much template is found are pages shuffled, by row, never by host.

Elements are listed by their tag, their role, or a class or id of which every word is listed or usual beside a listed one;
an article or main element that stands in no other is never listed by its class.

Defined cases: null or empty html gives an empty text; unclosed and stray tags are tolerated, at any number and depth; a tag
that never ends is text; equal pages are each
answered and counted once; a null or unreadable address has no host and no template; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import column, slices

#: A subtree is template if it is on at least so many distinct pages of its host, and on at least this part of them
#: (percent). Hosts of few pages need half of them, and no fewer than FEW_PAGES; above MANY_PAGES the number that is needed
#: grows with the root of the host's pages only, so that the template of a section is found.
MIN_PAGES, MIN_PERCENT, FEW_PAGES, MANY_PAGES = 8, 10, 3, 2000

# Fixed lists: names of elements and of classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
DROPPED = frozenset("head nav footer aside form script style noscript template iframe svg button select textarea title dialog object canvas audio video map xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section div main body td th blockquote".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner promo promotion sponsor sponsored menu nav navbar navigation breadcrumb breadcrumbs sidebar cookie cookies consent gdpr notice notification alert popup modal "
    "newsletter subscribe comments comment disqus respond replies share sharing social related masthead pagination".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
OUTSIDE = frozenset("header footer".split())
MAIN = frozenset("article main".split())
PARTS = frozenset("li dt dd tr td th thead tbody tfoot caption h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p blockquote pre ul ol dl table figure".split())

#: Words that may stand beside a listed one in a class or id, as in top-ad, site-nav or comments-area. A name with any other
#: word (share-price, no-sidebar) is not listed.
BESIDE = frozenset(
    "top bottom left right center first last main inner outer area wrapper wrap container holder box block section list item items bar slot unit widget panel row form link links button buttons icon icons "
    "site page post entry article user reader global primary secondary mobile desktop js header footer".split())

START = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*+))")
QUOTED = re.compile(r"""((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TOKEN = re.compile(r"[a-z]+")
#: Tags of a page that may leave a quote open before quotes are no longer looked at: each costs a scan of the page.
OPEN_QUOTES = 16
HOST = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


@dataclass
class Element:
    tag: str
    attributes: str
    dropped: bool
    main: bool
    counted: bool
    start: int
    block: Element | None
    parts: list[str] = field(default_factory=list)


class Page:
    """Blocks (text, whether in the main part) and subtrees (digest, first block, block after the last).

    Time and memory are linear in the source: a tag is read once, depths of open elements are kept by name, and a subtree
    knows its blocks by their numbers.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool]] = []
        self.subtrees: list[tuple[int, int, int]] = []
        self.stack: list[Element] = []
        self.depths: dict[str, list[int]] = {}
        self.solid: list[int] = []  # depths of elements that are not inline
        self.pending: list[str] = []
        self.has_main = False
        at, last, quotes = 0, source.rfind(">"), OPEN_QUOTES
        while at < len(source):
            found = START.search(source, at)
            tag = found and found[4]
            if not found or (tag and found.start() > last):  # no further tag, or one that never ends
                self._text(source[at:])
                break
            if found.start() > at:
                self._text(source[at : found.start()])
            if not tag:
                end = source.find("-->", found.start() + 2) if found[1] else source.find(">", found.end())
                at = len(source) if end < 0 else end + (3 if found[1] else 1)
                continue
            whole = QUOTED.match(source, found.end()) if quotes else None
            quotes -= whole is None and quotes > 0
            at = whole.end() if whole else source.index(">", found.end()) + 1
            tag, attributes = tag.lower(), source[found.end() : at - 1]
            if found[3]:
                self._close(tag)
                continue
            self._open(tag, attributes)
            if tag in RAW and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
                self._pop()
        self._flush()
        while self.stack:
            self._pop()

    def kept(self) -> tuple[list[str], list[tuple[int, int, int]]]:
        """The blocks of the main part, or all where there is none, and the subtrees that hold any of them."""
        place, texts = [0], []
        for text, main in self.blocks:
            if main or not self.has_main:
                texts.append(text)
            place.append(len(texts))
        return texts, [(digest, place[i], place[j]) for digest, i, j in self.subtrees if place[i] < place[j]]

    def _text(self, text: str) -> None:
        if not (self.stack and self.stack[-1].dropped):
            self.pending.append(text)
        elif self.stack[-1].block:
            self.stack[-1].block.parts.append(text)

    def _flush(self) -> None:
        if not self.pending:
            return
        text = " ".join(html.unescape("".join(self.pending)).split())
        self.pending = []
        if text:
            self.blocks.append((text, bool(self.stack) and self.stack[-1].main))
            if self.stack and self.stack[-1].block:
                self.stack[-1].block.parts.append(text)

    def _open(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self._flush()
        if tag in VOID:
            if tag == "br":
                self._text(" ")
            return
        if tag in ENDS_P:
            self._implied({"p"}, SCOPES)
        if tag in CLOSES:
            self._implied(CLOSES[tag], SCOPES - {"td", "th"} if tag == "tr" else SCOPES)
        above = self.stack[-1] if self.stack else None
        inside = bool(above and above.main)
        dropped = bool(above and above.dropped) or self._boilerplate(tag, attributes, inside)
        main = inside or (tag in MAIN and not dropped)
        self.has_main |= main
        counted = not dropped and tag not in INLINE and tag not in MAIN and tag not in ("html", "body") and not (main and (tag in PARTS or (tag in PROSE and not attributes.strip())))
        self.depths.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.solid.append(len(self.stack))
        self.stack.append(Element(tag, attributes, dropped, main, counted, len(self.blocks), above.block if above else None))
        if tag not in INLINE:
            self.stack[-1].block = self.stack[-1]

    @staticmethod
    def _boilerplate(tag: str, attributes: str, inside: bool) -> bool:
        if tag in DROPPED or (tag == "header" and not inside):
            return True
        if not attributes or tag in ("html", "body") or (tag in MAIN and not inside):
            return False
        listed = WORDS if inside else WORDS | OUTSIDE
        for name, *values in ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name == "role" and not ROLES.isdisjoint("".join(values).lower().split()):
                return True
            if name in ("class", "id"):
                for token in "".join(values).lower().split():
                    words = set(TOKEN.findall(token))
                    if not words.isdisjoint(listed) and words <= listed | BESIDE:
                        return True
        return False

    def _deepest(self, tags: Iterable[str]) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=-1)

    def _pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self._pop()

    def _implied(self, tags: set[str], scopes: frozenset[str]) -> None:
        depth = self._deepest(tags)
        if depth >= 0 and depth >= self._deepest(scopes):
            self._pop_to(depth)

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        depth = self._deepest([tag])
        if depth >= 0 and (tag not in INLINE or not self.solid or self.solid[-1] < depth):
            self._pop_to(depth)

    def _pop(self) -> None:
        if self.stack[-1].tag not in INLINE:
            self._flush()
        e = self.stack.pop()
        self.depths[e.tag].pop()
        if e.tag in INLINE:
            return
        self.solid.pop()
        above = self.stack[-1].block if self.stack else None
        e.block = None
        digest = xxhash.xxh3_64_intdigest("\0".join([e.tag, e.attributes.strip(), *e.parts]).encode("utf-8", "surrogatepass")) - 2**63
        if e.counted and e.start < len(self.blocks):
            self.subtrees.append((digest, e.start, len(self.blocks)))
        if above:
            above.parts.append(f"\1{digest}")


def parsed(pages: DataFrame, key: str, url: str, source: str) -> DataFrame:
    """(row, key, url, host, content, subtrees, blocks): a digest of the page's text, its subtrees as digest and range of
    blocks, and the texts of its blocks."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.col(f"`{source}`").alias("source"))
    subtree = pa.struct([("subtree", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "source"):
            contents, subtrees, blocks, hosts = [], [], [], []
            for address, s in zip(column(batch, "url").to_pylist(), column(batch, "source").to_pylist()):
                (texts, found), host = Page(s or "").kept(), HOST.match(address or "")
                hosts.append(host[1].lower() if host else "")
                subtrees.append([{"subtree": d, "start": i, "end": j} for d, i, j in found] if host else [])
                contents.append(xxhash.xxh3_64_intdigest("\n".join(texts).encode("utf-8", "surrogatepass")) - 2**63)
                blocks.append(texts)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "row"), column(batch, "key"), column(batch, "url"), pa.array(hosts), pa.array(contents, pa.int64()), pa.array(subtrees, pa.list_(subtree)), pa.array(blocks, pa.list_(pa.string()))],
                ["row", "key", "url", "host", "content", "subtrees", "blocks"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("key", "url")}
    return stored(rows.mapInArrow(run, f"row long, key {kinds['key']}, url {kinds['url']}, host string, content long, subtrees array<struct<subtree:long,start:int,end:int>>, blocks array<string>"))


def _least(pages: Column, min_pages: int, min_percent: int) -> Column:
    """On how many of a host's distinct pages a subtree must be to be template."""
    half = F.greatest(F.lit(min(FEW_PAGES, min_pages)), F.ceil(pages / 2))
    part = F.least(pages, F.sqrt(pages * MANY_PAGES)) * min_percent / 100
    return F.greatest(F.least(F.lit(min_pages), half), part)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", min_pages: int = MIN_PAGES, min_percent: int = MIN_PERCENT) -> DataFrame:
    """(key, url, text) of every page."""
    read = parsed(pages, key, url, source)
    hosted = read.where("host <> ''")
    on_host = hosted.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    counts = hosted.select("host", "content", F.explode("subtrees.subtree").alias("subtree")).distinct().groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min(FEW_PAGES, min_pages))
    template = stored(counts.join(on_host, "host").where(F.col("n") >= _least(F.col("pages"), min_pages, min_percent)).select("host", "subtree"))
    # Template and the rows that have some are written, so that their sizes are known and small ones need no shuffle of pages.
    found = hosted.select("row", "host", F.inline("subtrees")).join(template, ["host", "subtree"])
    # Subtrees nest, so those that start before the end of an earlier one lie inside it: the outermost hold all blocks, once.
    order = Window.partitionBy("row").orderBy("start", F.desc("end"))
    outer = found.withColumn("before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).where("before IS NULL OR start >= before")
    own = stored(outer.groupBy("row").agg(F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("end") - 1))).alias("gone")))
    left = read.join(own, "row", "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("blocks") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.array_join("blocks", "\n")).otherwise(F.array_join(F.transform(places, lambda i: F.col("blocks")[i]), "\n"))
    return left.select(F.col("key").alias(key), F.col("url").alias(url), text.alias("text"))
