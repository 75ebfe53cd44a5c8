"""HTML extraction with a site style tree.

The pages of a host are merged into one tree of presentation styles: a node of it is a path of tags with
their class and id.  Two things are measured for each node over the host's distinct pages:

* content importance: one minus the mean, over what is found there (block texts), of the entropy of its
  spread over the m pages, to the base m.  A notice that stands on every page has entropy 1, so
  importance 0; texts of their own have importance 1.
* presentation importance: the entropy of the ways its children are laid out, to the base m.

A node's composite importance is (1 - g) * presentation + g * content, g = ``DAMPING`` to the number of
its layouts, its content being that of all blocks below it.  A node on fewer than ``MIN_PAGES`` distinct
pages says nothing about its host; its composite is ``UNMEASURED``.  A copied page counts once.

A block's text is a content node of its own, below the node it stands in: its importance is one minus the entropy
of its spread over the pages that have this node, if these are ``LEAF_PAGES`` or more.  So an unmarked line that all
pages of a host repeat goes, though it shares its path with their paragraphs; but not where article or main, without a
class between, vouch for it: such lines are taken for the article's own.

What markup says of a node is a prior, added to the log odds of the composite: ``PRIOR`` for the article
(within article or main, where no class says otherwise) and against what a class or id calls an advert, a
menu and so on, and reader comments above all.  So a template goes without any hint; an
advert with a text of its own on each page goes by its hint; and a hinted node with as rich a structure as
an article's stays, unless it is called comments.  Branches and blocks below ``LOW`` are removed from each page.

Before that, what HTML elements and ARIA roles declare to be no article is left out: nav, header outside
the article, footer, aside, script and so on.  A form is, unless it holds the page's article or most of its
text.  Hints and forms that do hold it are overruled.  A class or id hints if the whole name does
(``share-bar``, but not ``content-sidebar-wrap``), and comments wherever a short name speaks of them
(``comments-area``, but not ``comments-open``); ids of headings, and of sections within the article, are
made from titles and say nothing.

Blocks: text within a block element; white space in it becomes one space, and blocks are joined by a line
feed.  Null, empty and markup-free pages are defined: the text of a page without markup is one block.
Pages of any length are parsed whole, in memory linear in their length: the tree has ``DEPTH`` levels, and
what is nested deeper counts to its ancestor on the last one.  Extra columns of pages are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm import arrow_text
from docquarry.llm.common import bounded_batches, written

LOW, MIN_PAGES, LEAF_PAGES, DAMPING, UNMEASURED, DEPTH = 0.25, 4, 8, 0.9, 0.9, 64
#: Added to the log odds of importance: of the article, of what a class or id calls something else.
PRIOR = {"main": 4.0, "hinted": -4.0, "comments": -8.0, "plain": 0.0}
#: Added to that of a block's text, outside what the article's markup vouches for: nearly all pages must have it.
LEAF_PRIOR = 3.0
#: Composite importance is kept this far from 0 and 1 before a prior is added.
EDGE = 0.01

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
LEFT_OUT = frozenset("nav footer aside script style noscript template iframe object svg canvas audio video button select option textarea input label menu dialog head title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What may stand in a head; anything else ends one that is still open.
METADATA = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
#: What an opening tag ends, where it is still open and no element that can hold it stands between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol menu dl table article main section div body html td th blockquote".split())
#: Words of a class or id that mark what isn't the article.
HINTS = frozenset(
    "ad ads adv advert advertisement advertising adverts banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr notice notification alert popup modal overlay comment comments reply replies respond disqus share sharing social subscribe subscription newsletter signup login search related recommended pagination pager toolbar skip".split()
)
#: Words that may stand beside these in a name without changing what it says.
BESIDE = frozenset("site main primary secondary top bottom bar slot box block list links buttons".split())
#: Of the hints, what may stand on an article element that isn't the page's article.
ASIDE_HINTS = frozenset("ad ads adv advert advertisement comment comments promo reply replies related recommended sponsored teaser widget".split())
COMMENTS = frozenset(["comment", "comments"])
#: Words beside these that tell of comments elsewhere, or of none; and how long a name of comments is at most.
OF_COMMENTS, MOST_WORDS = frozenset("open closed on off enabled disabled allowed status count number".split()), 3
#: Beginnings of class names that tell what else a page has, or what it lacks.
ABOUT_OTHERS = ("has-", "with-", "no-", "without-", "is-")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
_WORD = re.compile(r"[a-z0-9]+")
#: White space of any kind, for Python and Java alike.
GAP = r"[ \t\n\x0B\f\r\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
_GAP = re.compile(GAP)


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
    return h - (1 << 64) if h >= 1 << 63 else h


@lru_cache(1 << 14)
def _hints(name: str) -> frozenset[str]:
    """The hints of a class or id, if nothing else is said in it."""
    words = _WORD.findall(name)
    if len(words) <= MOST_WORDS and not name.startswith(ABOUT_OTHERS) and not OF_COMMENTS.intersection(words) and (found := COMMENTS.intersection(words)):
        return found
    if name.startswith(ABOUT_OTHERS) or not all(w in HINTS or w in BESIDE or w.isdigit() for w in words):
        return frozenset()
    return HINTS.intersection(words)


class _Node:
    """An open or closed element.  mark: the hinted element or form it is or lies in (the innermost); holder: the
    innermost block element."""

    __slots__ = ("tag", "name", "parent", "depth", "out", "main", "inside", "mark", "holder", "shape", "path", "style", "used")

    def __init__(self, tag: str, name: str, parent: "_Node | None", out: bool, main: bool, inside: bool, mark: "_Mark | None"):
        self.tag, self.name, self.parent, self.out, self.main, self.inside, self.mark = tag, name, parent, out, main, inside, mark
        self.depth = parent.depth + 1 if parent else 0
        self.holder = self if tag in BLOCK or parent is None else parent.holder
        self.shape, self.used = [], False


class _Mark:
    """A hinted element or a form.  aside: whether articles in it needn't be the page's."""

    __slots__ = ("up", "aside", "form", "comments", "size", "overruled")

    def __init__(self, up: "_Mark | None", aside: bool, form: bool, comments: bool):
        self.up, self.aside, self.form, self.comments, self.size, self.overruled = up, aside, form, comments, 0, False

    def around(self):
        m = self
        while m:
            yield m
            m = m.up


class _Page(HTMLParser):
    """Blocks and nodes of one page; broken markup is taken as browsers take it, in the main."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = _Node("", "", None, False, False, False, None)
        self.stack, self.open, self.all = [self.top], Counter(), [self.top]
        self.found: list[list[tuple[_Node, str]]] = []  # blocks: pieces and the elements they stand in
        self.marks: list[_Mark] = []
        self.articles: list[tuple[str, _Mark | None]] = []
        self.text: list[tuple[_Node, str]] = []

    def _flush(self) -> None:
        if self.text:
            self.found.append(self.text)
            self.text = []

    def _pop(self) -> None:
        n = self.stack.pop()
        self.open[n.tag] -= 1
        if n.tag in BLOCK:
            self._flush()

    def _close_to(self, tags: set[str], walls: frozenset[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k].tag in walls:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in METADATA:
            self._close_to({"head"}, frozenset({"template"}) if tag == "body" else HOLDS | {"template", "noscript", "title"})
        if tag in BLOCK:
            self._flush()
            self._close_to({"p"}, HOLDS)
        if tag in ENDS:
            self._close_to(ENDS[tag], HOLDS - {"td", "th"} if tag in ("td", "th", "tr") else HOLDS)
        up = self.stack[-1]
        if tag == "br" and not up.out:
            self.text.append((up, " "))
        style = {k: v.lower() for k, v in attrs if v and k in ("class", "id", "role")}
        own = " ".join(x for x in (style.get("class"), style.get("id")) if x)
        if not up.shape or up.shape[-1] != tag:  # a layout: kinds of children, in order
            up.shape.append(tag)
        if tag in VOID:
            return
        titled = tag in HEADINGS or (tag == "section" and up.inside)
        says = (style.get("class", "") if titled else own).split()
        hints = frozenset().union(*map(_hints, says))
        if tag in ("html", "body", "main"):
            hints = frozenset()
        elif tag == "article":
            hints &= ASIDE_HINTS
        elif up.inside:
            hints -= {"header"}  # of the article: its title
        # a header within the article holds its title
        out = up.out or tag in LEFT_OUT or style.get("role") in ROLES or (tag == "header" and not up.main)
        mark, form = up.mark, tag == "form" or style.get("role") == "form"
        if (hints or form) and not out:
            mark = _Mark(up.mark, not form and hints <= ASIDE_HINTS, form, bool(hints & COMMENTS))
            self.marks.append(mark)
        elif tag in ("article", "main") and not out and not ("teaser" in says and tag == "article"):
            self.articles.append((tag, mark))
        inside = (up.inside or tag in ("article", "main")) and not out
        plain = inside and (tag in ("article", "main") or (up.main and not own))
        node = _Node(tag, tag + ("." + re.sub(r"\d+", "0", own) if own else ""), up, out, plain, inside, mark)
        self.stack.append(node)
        self.open[tag] += 1
        self.all.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "a", "span"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                while len(self.stack) > k:
                    self._pop()
                return
            if tag not in BLOCK and self.stack[k].tag in BLOCK:
                return  # an inline end tag doesn't close blocks
            if tag == "p" and self.stack[k].tag in HOLDS:
                return

    def handle_data(self, data: str) -> None:
        if self.stack[-1].tag == "head" and data.strip():
            self._pop()
        if not self.stack[-1].out:  # what is left out may stand within a block of text, at its beginning too
            self.text.append((self.stack[-1], data))

    def _overrule(self) -> None:
        """Hints on elements that hold the page's article or, where there is none, most of its text."""
        own = [m for tag, m in self.articles if tag == "main" or not m or not any(x.aside for x in m.around())] or [m for _, m in self.articles]
        if own:
            for m in own:
                for x in m.around() if m else ():
                    x.overruled = True
            return
        total = 0
        for pieces in self.found:
            for node, text in pieces:
                n = sum(map(len, text.split()))
                total += n
                if node.mark:
                    node.mark.size += n
        for m in reversed(self.marks):  # the inner ones come after those around them
            m.overruled = 2 * m.size > total
            if m.up:
                m.up.size += m.size

    def finish(self) -> tuple[list[list[tuple[int, str]]], dict[int, tuple[int, tuple[int, ...], str, int]]]:
        """Blocks, as lists of (path, piece of text), and path -> (parent's path, all paths above and itself, kind,
        layout) of the nodes with text."""
        self.close()
        self._flush()
        if self.marks:
            self._overrule()
        root: tuple[int, ...] = ()
        for n in self.all:  # parents come first
            if n.parent is None:
                n.path, n.style = 0, root
                continue
            mine = n.mark if n.mark is not n.parent.mark else None
            hinted = mine is not None and not mine.overruled
            if hinted and mine.form:
                n.out = True
            n.out = n.out or n.parent.out
            if n.depth > DEPTH:
                n.path, n.style = n.parent.path, n.parent.style
                continue
            kind = ("comments" if mine.comments else "hinted") if hinted else "main" if n.main else "plain"
            n.path = _hash(f"{n.parent.path}/{n.name}/{kind}")
            n.style = (*n.parent.style, n.path)
            n.name = kind
        blocks, nodes = [], {}
        for pieces in self.found:
            block: list[tuple[int, str]] = []
            for node, text in pieces:
                if node.out:
                    continue
                at = node
                while at is not at.holder and not (at.mark and at.mark is not at.parent.mark):
                    at = at.parent  # inline elements without a hint are part of their block
                if block and block[-1][0] == at.path:
                    block[-1] = (at.path, block[-1][1] + text)
                else:
                    block.append((at.path, text))
                while at is not None and not at.used and at.path:
                    at.used = True
                    if at.depth <= DEPTH:
                        nodes.setdefault(at.path, (at.parent.path, at.style, at.name, _hash(">".join(at.shape))))
                    at = at.parent
            if any(t.strip() for _, t in block):
                blocks.append(block)
        self.all = self.found = []
        return blocks, nodes


def parse(html: str):
    page = _Page()
    page.feed(html)
    return page.finish()


def _squeeze(text: str) -> str:
    return _GAP.sub(" ", text).strip(" ")


def _leaf(path: int, text: str) -> int:
    """The content node of a text below a path."""
    return _hash(f"{path} {_squeeze(text)}")


PARSED = "page_id long, url string, host string, digest long, blocks array<array<struct<path: long, leaf: long, text: string>>>, nodes array<struct<path: long, kind: string, shape: long, above: array<long>, features: array<long>>>"
_BLOCKS = pa.list_(pa.list_(pa.struct([("path", pa.int64()), ("leaf", pa.int64()), ("text", pa.string())])))
_NODES = pa.list_(pa.struct([("path", pa.int64()), ("kind", pa.string()), ("shape", pa.int64()), ("above", pa.list_(pa.int64())), ("features", pa.list_(pa.int64()))]))


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            blocks, nodes, digests = [], [], []
            for raw in arrow_text.each(part["html"]):
                found, tree = parse(raw.decode("utf-8", "replace"))
                digests.append(xxhash.xxh64_intdigest(raw) - (1 << 63))
                features: dict[int, set[int]] = {}
                for block in found:
                    for path, text in block:
                        features.setdefault(path, set()).add(_leaf(path, text))
                blocks.append([[{"path": p, "leaf": _leaf(p, t), "text": t if len(b) > 1 else _squeeze(t)} for p, t in b] for b in found])
                nodes.append([{"path": p, "kind": kind, "shape": shape, "above": up, "features": sorted(features.get(p, ()))} for p, (_, up, kind, shape) in tree.items()])
            yield pa.RecordBatch.from_arrays(
                [part["page_id"], part["url"], part["host"], pa.array(digests, pa.int64()), pa.array(blocks, _BLOCKS), pa.array(nodes, _NODES)],
                ["page_id", "url", "host", "digest", "blocks", "nodes"],
            )


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _importance(composite: Column, prior: Column) -> Column:
    p = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), composite))
    return 1 / (1 + F.exp(-(F.log(p / (1 - p)) + prior)))


def _spread(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, path, kind, pages, layouts, presentation) of nodes, and (host, path, above, feature, c) of content nodes: on
    how many distinct pages each is."""
    every = parsed.select("host", "digest", F.explode("nodes").alias("n")).select("host", "digest", "n.*")
    # counts by host alone would meet in one task for a large host; these don't
    shapes = every.select("host", "digest", "path", "kind", "shape").distinct().groupBy("host", "path", "kind", "shape").agg(F.count("*").alias("c"))
    look = shapes.groupBy("host", "path", "kind").agg(F.sum("c").alias("pages"), F.count("*").alias("layouts"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    look = look.withColumn("presentation", F.when(F.col("pages") > 1, (F.log("pages") - F.col("clogc") / F.col("pages")) / _base(F.col("pages"))).otherwise(1.0))
    texts = every.select("host", "digest", "path", "above", F.explode("features").alias("feature")).distinct()
    return look, texts.groupBy("host", "path", "above", "feature").agg(F.count("*").alias("c"))


def _base(m: Column) -> Column:
    return F.log(F.greatest(m, F.lit(2)).cast("double"))


def style_tree(look: DataFrame, spread: DataFrame) -> DataFrame:
    """(host, path, kind, pages, composite, importance) of the nodes of each host's tree, over its distinct
    pages."""
    own = spread.groupBy("host", "path", "above").agg(F.sum(F.log("c")).alias("logs"), F.count("*").alias("n"))
    own = own.join(look.select("host", "path", "pages"), ["host", "path"]).withColumn("sum", F.col("n") - F.col("logs") / _base(F.col("pages")))
    below = own.select("host", F.explode("above").alias("path"), "sum", "n").groupBy("host", "path").agg((F.sum("sum") / F.sum("n")).alias("content"))
    g = F.pow(F.lit(DAMPING), F.col("layouts"))
    composite = F.when(F.col("pages") < MIN_PAGES, UNMEASURED).otherwise((1 - g) * F.col("presentation") + g * F.col("content"))
    out = look.join(below, ["host", "path"]).withColumn("composite", composite)
    prior = F.element_at(F.create_map(*(F.lit(x) for kv in PRIOR.items() for x in kv)), F.col("kind"))
    return out.select("host", "path", "kind", "pages", "composite", _importance(F.col("composite"), prior).alias("importance"))


def removed(parsed: DataFrame) -> DataFrame:
    """(_host, gone): what is removed from each host's pages: paths that lie in a branch of low importance, and content
    nodes of low importance.  These are on nearly all pages that have their node, so a host has few."""
    look, spread = _spread(parsed)
    look, spread = written(look, "pages-look"), written(spread, "pages-spread")
    low = style_tree(look, spread).where(F.col("importance") < LOW).groupBy(F.col("host").alias("_host")).agg(F.collect_set("path").alias("low"))
    paths = spread.select("host", "path", "above").distinct().join(low, F.col("host") == F.col("_host")).where(F.arrays_overlap("above", "low")).select("host", F.col("path").alias("id"))
    common = spread.where(F.col("c") >= MIN_PAGES).join(look.where((F.col("kind") == "plain") & (F.col("pages") >= LEAF_PAGES)), ["host", "path"])
    leaves = common.where(_importance(1 - F.log("c") / _base(F.col("pages")), F.lit(LEAF_PRIOR)) < LOW).select("host", F.col("feature").alias("id"))
    return paths.unionByName(leaves).groupBy(F.col("host").alias("_host")).agg(F.collect_set("id").alias("gone"))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, blocks, n_removed) of pages (page_id, url, html): a row for each row, repeated or
    not.  n_removed: how many blocks the tree took out, whole or in part."""
    bounded_batches()
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    parsed = written(given.mapInArrow(_parse_batches, PARSED), "pages-parsed")
    gone = written(removed(parsed), "pages-low")
    joined = parsed.select("page_id", "url", "host", "blocks").join(gone, F.col("host") == F.col("_host"), "left")
    stays = lambda x: F.col("gone").isNull() | ~(F.array_contains("gone", x["path"]) | F.array_contains("gone", x["leaf"]))
    whole = lambda b: F.array_join(F.transform(F.filter(b, stays), lambda x: x["text"]), "")
    # a block of one piece is squeezed already
    texts = F.transform("blocks", lambda b: F.when(F.size(b) == 1, whole(b)).otherwise(F.btrim(F.regexp_replace(whole(b), GAP, " "))))
    n_removed = F.size(F.filter("blocks", lambda b: ~F.forall(b, stays))).cast("long")
    out = joined.select("page_id", "url", n_removed.alias("n_removed"), F.filter(texts, lambda t: t != "").alias("blocks"))
    return out.select("page_id", "url", F.array_join("blocks", "\n").alias("text"), "blocks", "n_removed")
