"""Main text of web pages by a style tree per host.

Every page is parsed once into blocks of text, each with the path of its block elements (tags and
classes). The pages of one host are merged by path into a style tree. A node's importance comes from
entropies over the host's pages: its texts are important if each appears on few pages; its presentation
if the sequences of its children vary. An inner node mixes its own presentation with the importance of
the text below it, the more so the nearer the text. Branches of low importance go from every page of the
host, and so do branches whose element says what they are (menus, footers, adverts, forms, ...), inline ones included.
If a page has an article, only text within it is kept, unless ``TEASER`` times as much is left beside it; there, low importance removes only elements other than
bare prose (a headline may well recur on near copies).

Copies of a page say nothing about what is template, so equal pages of a host count once.

The tree is built from counts: one row per host, path and text hash, then one per host and path, so a
host that holds most of the pages is no hot key. Pages meet the low paths of their host through a
broadcast if there are few, else by a join whose large side adaptive execution can split.

Defined cases: a NULL or empty html has no text; hosts with fewer than ``LEAST_PAGES`` pages are cleaned
by their elements only; a NULL or odd url has the empty host; repeated rows are extracted each; broken
markup is read as browsers do, as far as blocks go (a head that is not closed ends with its first text, ``<svg/>`` is
closed, a muted inline element ends with its block); other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ridgework.session import checked_broadcast, stage

LOW = 0.2
LEAST_PAGES = 8
# Weight that a node's own presentation leaves to the text below, per level.
DAMPING = 0.9
# An article is all of a page's main text unless as much as this many times its length stands beside it.
TEASER = 4

# Fixed lists: HTML's elements by what they mean here.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
HIDDEN = frozenset("script style noscript template title svg math iframe object embed canvas audio video map textarea select button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NOISE_TAGS = frozenset("nav footer aside form dialog menu search".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice "
    "notices banner sidebar comments comment respond disqus share sharing social related recommended newsletter subscribe popup "
    "modal breadcrumb breadcrumbs menu menus nav navbar navigation footer pagination pager widget".split()
)
# What may stand beside such a word in one name without changing what the element is.
PLACE_WORDS = frozenset(
    "area bar block bottom box btn button buttons col column container content end fixed footer group header inner item items left link links "
    "list main outer overlay page panel post primary right row secondary section site slot small start sticky text title top unit wrap "
    "wrapper".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
FOREIGN = frozenset(("svg", "math"))
MAIN_TAGS = frozenset(("article", "main"))
CLOSES_P = BLOCKS - frozenset("html body caption dd dt legend li summary tbody td tfoot th thead tr".split()) | {"p"}
# An article, or text elements without class all the way down from one.
INSIDE = r"/(article|main)(\.[^/]*)?(/|$)"
PROSE = r"/(article|main)(\.[^/]*)?(/(p|h[1-6]|hgroup|header|section|blockquote|pre|ul|ol|li|dl|dt|dd|figure|figcaption|table|caption|thead|tbody|tfoot|tr|td|th))*$"
# What an opening element ends if it is still open, and what it may not look past.
ENDED_BY = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dd": (frozenset(("dd", "dt")), frozenset(("dl",))), "dt": (frozenset(("dd", "dt")), frozenset(("dl",))),
    "td": (frozenset(("td", "th")), frozenset(("table",))), "th": (frozenset(("td", "th")), frozenset(("table",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
}
_DIGITS = re.compile(r"[0-9]+")
_SPACE = re.compile(r"\s+")


def names_noise(name: str) -> bool:
    """Whether a class or id says that its element is no content: ``ad-slot`` does, ``press-notice`` does not."""
    words = set(_DIGITS.sub("", name.lower()).replace("_", "-").split("-")) - {""}
    return bool(words & NOISE_WORDS) and words <= NOISE_WORDS | PLACE_WORDS


class Node:
    __slots__ = ("tag", "path", "noise", "main", "children")

    def __init__(self, tag: str, path: str, noise: bool, main: bool):
        self.tag, self.path, self.noise, self.main, self.children = tag, path, noise, main, []


class PageParser(HTMLParser):
    """Collects ``(path, noise, main, text)`` blocks and ``(path, children)`` of inner elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [Node("", "", False, False)]
        self.blocks: list[tuple[str, bool, bool, str]] = []
        self.inner: list[tuple[str, str]] = []
        self.words: list[str] = []
        self.hidden: list[str] = []
        # Open inline elements that are no content, with the depth of the block they are in, which ends them at last.
        self.muted: list[tuple[str, int]] = []

    def _end_block(self) -> None:
        if self.words:
            text = _SPACE.sub(" ", "".join(self.words)).strip()
            self.words = []
            if text:
                node = self.stack[-1]
                self.blocks.append((node.path, node.noise, node.main, text))

    def _pop_to(self, index: int) -> None:
        self._end_block()
        for node in self.stack[index:]:
            if node.children:
                self.inner.append((node.path, ",".join(node.children)))
        del self.stack[index:]
        self.muted = [(tag, depth) for tag, depth in self.muted if depth <= index]

    def _open_index(self, tags: frozenset, limits: frozenset = frozenset()) -> int | None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                return i
            if self.stack[i].tag in limits:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.append(tag)
            return
        if tag == "br":
            self.words.append(" ")
        if tag == "body" or tag == "html":
            self._pop_to(max(1, self._open_index(frozenset((tag,))) or 1) if tag == "html" else (self._open_index(frozenset(("html",))) or 0) + 1)
        if tag in HIDDEN and tag not in VOID:
            self.hidden.append(tag)
            return
        named = {name: (value or "").lower() for name, value in attrs if name in ("class", "id", "role")}
        called = any(names_noise(name) for key in ("class", "id") for name in named.get(key, "").split())
        if tag not in BLOCKS:
            if tag not in VOID and (called or self.muted and tag == self.muted[-1][0]):
                self.muted.append((tag, len(self.stack)))
            return
        self._end_block()
        if tag in CLOSES_P and (at := self._open_index(frozenset(("p",)), frozenset(("table", "td", "th")))) is not None:
            self._pop_to(at)
        if tag in ENDED_BY and (at := self._open_index(*ENDED_BY[tag])) is not None:
            self._pop_to(at)
        if tag in VOID:
            return
        parent = self.stack[-1]
        label = tag + "".join(f".{_DIGITS.sub('0', c)}" for c in sorted(set(named.get("class", "").split())))
        noise = parent.noise or tag in NOISE_TAGS or tag == "header" and not parent.main or named.get("role") in NOISE_ROLES
        if tag not in MAIN_TAGS and tag not in ("html", "body"):
            noise = noise or called
        parent.children.append(label)
        self.stack.append(Node(tag, f"{parent.path}/{label}", noise, (parent.main or tag in MAIN_TAGS) and not noise))

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            return
        if tag == "br":
            self.words.append(" ")
        if self.muted and tag == self.muted[-1][0]:
            self.muted.pop()
        if tag in BLOCKS and tag not in ("html", "body"):
            at = self._open_index(frozenset((tag,)))
            if at is not None:
                self._pop_to(at)
            else:
                self._end_block()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        # In HTML a slash at the end of a start tag means nothing, but for elements of other vocabularies.
        if tag not in FOREIGN:
            self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if not self.hidden and not self.muted:
            self.words.append(data)

    def finish(self) -> None:
        self.close()
        self._pop_to(1)


def parse(html: str | None) -> PageParser:
    parser = PageParser()
    parser.feed(html or "")
    parser.finish()
    return parser


PARSED = (
    "page_id bigint, url string, host string, blocks array<struct<path: string, noise: boolean, main: boolean, text: string>>, "
    "inner array<struct<path: string, children: string>>"
)


def parsed_pages(pages: DataFrame) -> DataFrame:
    block = pa.struct([("path", pa.string()), ("noise", pa.bool_()), ("main", pa.bool_()), ("text", pa.string())])
    inner = pa.struct([("path", pa.string()), ("children", pa.string())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [parse(html.as_py()) for html in part.column(3)]
                blocks = pa.array([[dict(zip(("path", "noise", "main", "text"), b)) for b in p.blocks] for p in found], pa.list_(block))
                inners = pa.array([[dict(zip(("path", "children"), b)) for b in p.inner] for p in found], pa.list_(inner))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), blocks, inners], names=["page_id", "url", "host", "blocks", "inner"]
                )

    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), "^[a-zA-Z]+://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", host.alias("host"), "html")
    return rows.mapInArrow(read, PARSED)


def _entropy_share(rows: DataFrame, value: str) -> DataFrame:
    """Per host and path: on how many pages, and how spread out the values are over the pages."""
    each = rows.groupBy("host", "path", value).agg(F.count("*").alias("n"))
    return each.groupBy("host", "path").agg(
        F.sum("n").alias("pages"), (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("entropy"),
    )


def low_paths(parsed: DataFrame, low: float = LOW, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``host, path, importance`` of the style tree's branches that go."""
    # A page counts once for a path and text, however often it repeats it.
    # NULL stands for any text: its count is the number of pages that have the path.
    hashed = parsed.select(
        "host", F.xxhash64("blocks", "inner").alias("page"),
        F.array_distinct(F.concat(
            F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), F.xxhash64(b["text"]).alias("value"))),
            F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), F.lit(None).cast("bigint").alias("value"))),
        )).alias("texts"),
        F.array_distinct(F.transform("inner", lambda e: F.struct(e["path"].alias("path"), F.xxhash64(e["children"]).alias("value")))).alias("looks"),
    ).dropDuplicates(["host", "page"])
    texts, looks = (hashed.select("host", F.inline(name)) for name in ("texts", "looks"))
    # A text on n of the m pages that have its path says 1 - log(n) / log(m), however many texts a page has
    # there; a node's text importance is the mean over its texts.
    is_text = F.col("value").isNotNull()
    seen = texts.groupBy("host", "path", "value").agg(F.count("*").alias("n")).groupBy("host", "path").agg(
        F.max(F.when(~is_text, F.col("n"))).alias("pages"), F.sum(F.when(is_text, F.col("n"))).alias("weight"),
        F.avg(F.when(is_text, F.log("n"))).alias("mean_log"),
    )
    content = seen.select("host", "path", "pages", "weight", F.when(
        F.col("pages") > 1, 1 - F.col("mean_log") / F.log("pages")
    ).otherwise(1.0).alias("importance"))
    shape = _entropy_share(looks, "value").select("host", "path", F.when(
        F.col("pages") > 1, F.col("entropy") / F.log("pages")
    ).otherwise(1.0).alias("presentation"))
    # Every text node speaks for the branches it is in, by the pages it is on.
    steps = F.split(F.substring("path", 2, 1 << 20), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(
        F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, n), "/")).alias("branch"), (F.size(steps) - n).alias("levels")
    ))
    named = content.where("path <> ''").select("host", "pages", "weight", "importance", F.inline(above))
    weighted = named.groupBy("host", F.col("branch").alias("path")).agg(
        (F.sum(F.col("weight") * F.col("importance")) / F.sum("weight")).alias("below"),
        F.max("pages").alias("pages"), F.avg("levels").alias("levels"),
    )
    share = F.pow(F.lit(DAMPING), F.col("levels"))
    mixed = weighted.join(shape, ["host", "path"], "left").withColumn(
        "importance", (1 - share) * F.coalesce("presentation", F.lit(1.0)) + share * F.col("below")
    )
    low_ = (F.col("pages") >= least_pages) & (F.col("importance") < low) & ~F.col("path").rlike(PROSE)
    return mixed.where(low_).select("host", "path", "importance")


def main_text(pages: DataFrame, low: float = LOW, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``page_id, url, text`` of every page; blocks joined by line ends."""
    parsed = stage(parsed_pages(pages), "pages")
    lists = [F.collect_list("path").alias("gone"), F.collect_list(F.when(F.col("path").rlike(INSIDE), F.col("path"))).alias("inside")]
    gone = stage(low_paths(parsed, low, least_pages).groupBy("host").agg(*lists), "low-paths")
    joined = parsed.drop("inner").join(checked_broadcast(gone, 8192), "host", "left")
    nothing = F.array().cast("array<string>")
    within = lambda b, branches: F.exists(
        branches, lambda path: (b["path"] == path) | F.startswith(b["path"], F.concat(path, F.lit("/")))
    )
    # What holds an article stays, however little the rest of it says.
    gone_, inside = F.coalesce("gone", nothing), F.coalesce("inside", nothing)
    told = F.filter("blocks", lambda b: b["main"] & ~within(b, inside))
    beside = F.filter("blocks", lambda b: ~b["noise"] & ~b["main"] & ~within(b, gone_))
    letters = lambda blocks: F.aggregate(blocks, F.lit(0).cast("bigint"), lambda n, b: n + F.length(b["text"]))
    article = (F.size(told) > 0) & (letters(beside) < TEASER * letters(told))
    # A short article next to a much longer story is a teaser: both stay, in page order.
    kept = F.filter("blocks", lambda b: F.when(b["main"], ~within(b, inside)).otherwise(~article & ~b["noise"] & ~within(b, gone_)))
    return joined.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text"))
