"""HTML main text by a site style tree.

Pages of one host are merged into one tree. A presentation node is a path of
block elements with their tag, class and id; the pieces of text (sentences of
short blocks, else whole blocks) that stand in it are its content nodes. Two
entropies weigh a presentation node. Content: a piece found on many of the
node's pages says little about any of them, one found once says all; the mean
over the node's characters counts. Presentation: a node laid out one way on
every page is a template, one with many layouts is written by hand. The same
paths merged over all hosts give a second importance, for hosts that show a node
on few pages and for texts that a publisher puts on many hosts; the smaller of
the two counts. A node of fewer than LEAST_PAGES pages has importance 1.

A block is cut where its node's importance, less a prior, is LOW or less. The
prior speaks for an article or main element, against what stands outside the
page's article, and more so against elements that name themselves as furniture
(nav, footer, class "ad" ...): their texts can differ from page to page, as
adverts and reader comments do, and no entropy shows that. A block whose pieces
all stand in the same node on over half of the host's pages is cut too, in an
article as well.

Pages are counted by their body (all text but named furniture and what is outside
the article), so copies of one page under many addresses do not make its article
look like a template. The count of different bodies is an estimate from 64 bits.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from airrline.llm.common import map_arrow, sliced, store

LOW = 0.75  # importance, less the prior, up to which a node is cut
INSIDE, OUTSIDE, NAMED = -0.4, 0.3, 0.45  # priors: in an article, beside the page's article, furniture by name
MOST = 0.5  # share of a host's pages with the same piece in the same node, beyond which it is cut there
LEAST_PAGES = 4  # of a node, before its entropies mean anything
CONTENT_WEIGHT = 0.9
SHORT = 300  # characters of a block up to which its sentences are its pieces
DEEPEST = 512  # open elements; deeper ones count as part of the last
BROADCAST_CUTS = 1_000_000  # nodes and pieces to cut, up to which they are broadcast
_FLUSH = 200_000  # counts held in a task before they are handed on
_PIECE, _LAYOUT, _SEEN = 0, 1, 2

# Element and class names with a meaning in HTML or by wide custom.
_BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
_UNSEEN = frozenset("audio canvas head iframe noscript object script style svg template textarea title video".split())  # not shown as text of the page
_FURNITURE = frozenset("aside button dialog footer form menu nav search select".split())
_FURNITURE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_FURNITURE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus "
    "feedback gdpr login menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo related replies reply respond search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
_OUTSIDE_WORDS = frozenset("footer header masthead".split())  # furniture of the page, but not of an article
_RAW_TAGS = frozenset("script style textarea title noscript template iframe".split())
_RAW = re.compile(r"</(script|style|textarea|title|noscript|template|iframe)\s*>", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = _BLOCK - {"body", "html", "head", "title", "option", "button", "legend", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
_P_STOPS = ("article", "div", "section", "td", "th", "li", "blockquote", "body", "main", "aside", "form")
_CROSSES_CELLS = frozenset("table tr td th tbody thead tfoot html body article main".split())

_MARK = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|(!--)|[!?])")
_REST = re.compile(r"""((?:[^"'>]|"[^"]*+"|'[^']*+')*+)>""")  # of a tag; a quoted > does not end it
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_WORDS = re.compile(r"[a-z0-9]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\s+[·|•–—-]\s+")


@dataclass(slots=True)
class Block:
    node: int
    text: str
    furniture: bool  # by name
    article: bool  # within an article or main element


@dataclass(slots=True)
class _Open:
    tag: str
    node: int
    unseen: bool
    furniture: bool
    article: bool
    children: list[str]


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def child_node(parent: int, label: str) -> int:
    """Id of a path: that of the path before and the next element's presentation."""
    return xxhash.xxh64_intdigest(label, seed=parent) >> 1


def _presentation(tag: str, attrs: str) -> tuple[str, set[str], bool, bool]:
    """Label of an element, its class and id words, whether its role makes it furniture, and whether it is hidden."""
    label, words, furniture, hidden = tag, set(), False, False
    for m in _ATTR.finditer(attrs) if attrs else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            label += ("." if name == "class" else "#") + ".".join(value.split())
            words |= set(_WORDS.findall(value))
        elif name == "role":
            label += "@" + value
            furniture |= value in _FURNITURE_ROLES
        elif name == "hidden" or value == "true":
            hidden = True
    return label, words, furniture, hidden


def _markup(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, tag, attributes) of every tag, comment (tag "") and raw text's end, in one pass.

    A tag whose quotes do not pair up ends at the next ">"; where there is none, at the page's end.
    """
    at, paired = 0, True
    while m := _MARK.search(page, at):
        if m[2] is None:
            end = page.find("-->" if m[3] else ">", m.end())
            at = len(page) if end < 0 else end + (3 if m[3] else 1)
            yield m.start(), at, "", "", ""
            continue
        rest = _REST.match(page, m.end()) if paired else None
        if rest is not None:
            attrs, at = rest[1], rest.end()
        else:
            paired = False  # what was read to the page's end in vain is not read again for each tag
            end = page.find(">", m.end())
            attrs, at = (page[m.end() : end], end + 1) if end >= 0 else ("", len(page))
        tag = m[2].lower()
        yield m.start(), at, m[1], tag, attrs
        if tag in _RAW_TAGS and not m[1] and not attrs.endswith("/"):
            raw = _RAW.search(page, at)
            while raw and raw[1].lower() != tag:
                raw = _RAW.search(page, raw.end())
            start, at = (raw.start(), raw.end()) if raw else (len(page), len(page))
            yield start, at, "/", tag, ""


def parse(page: str | None) -> tuple[list[Block], list[tuple[int, str]]]:
    """Blocks of text in page order, and (node, child layout) of every element with children."""
    page = page or ""
    blocks: list[Block] = []
    layouts: list[tuple[int, str]] = []
    stack = [_Open("", 0, False, False, False, [])]
    parts: list[str] = []
    over = 0  # elements open below DEEPEST

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            top = stack[-1]
            if text and not top.unseen:
                blocks.append(Block(top.node, text, top.furniture, top.article))

    def say(text: str) -> None:
        if text:
            parts.append(html.unescape(text) if "&" in text else text)

    def close(n: int) -> None:
        while len(stack) > n:
            gone = stack.pop()
            if gone.children:
                runs = [t for i, t in enumerate(gone.children) if not i or t != gone.children[i - 1]]
                layouts.append((gone.node, " ".join(runs)))

    def last(tags: tuple[str, ...], stops: tuple[str, ...] = ()) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in stops:
                break
        return 0

    at = 0
    for start, end, slash, tag, attrs in _markup(page):
        say(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        block = tag in _BLOCK
        if slash:
            if over and block:
                flush()
                over -= 1
            elif i := last((tag,), () if tag in _CROSSES_CELLS else ("td", "th", "table")):
                flush()
                close(i)
            elif block:
                flush()
            continue
        named = tag in _FURNITURE or tag in _UNSEEN
        if not block and not named and (tag in _VOID or not attrs):
            continue
        if block:
            flush()
            if tag in _ENDS_P and (i := last(("p",), _P_STOPS)):
                close(i)
            if tag in _SIBLINGS and (i := last(_SAME.get(tag, (tag,)), _SIBLINGS[tag])):
                close(i)
        label, words, furniture, hidden = _presentation(tag, attrs)
        if not block and not named and not furniture and not hidden and not words & _FURNITURE_WORDS:
            continue  # an inline element
        if tag in _VOID or attrs.endswith("/"):
            continue
        if not block:
            flush()
        if len(stack) > DEEPEST:
            over += block
            continue
        top = stack[-1]
        landmark = tag in ("article", "main") or "@main" in label
        furniture |= tag in _FURNITURE or bool(words & _FURNITURE_WORDS)
        if not top.article:
            furniture |= tag == "header" or bool(words & _OUTSIDE_WORDS)
        if tag in ("html", "body") or landmark:
            furniture = False
        top.children.append(label)
        stack.append(_Open(tag, child_node(top.node, label), top.unseen or hidden or tag in _UNSEEN, top.furniture or furniture, top.article or landmark, []))
    say(page[at:])
    flush()
    close(1)
    return blocks, layouts


def pieces(text: str) -> list[str]:
    """The content nodes of a block."""
    return _SENTENCE.split(text) if len(text) <= SHORT else [text]


def _key(text: str, node: int = 0) -> int:
    return xxhash.xxh64_intdigest(text, seed=node) >> 1


def _body(blocks: list[Block], names: bool) -> int:
    """Which of 64 buckets a page's body falls into, as a bit of a signed long."""
    marked = names and any(b.article and not b.furniture for b in blocks)
    own = xxhash.xxh64()
    for b in blocks:
        if not names or not b.furniture and (b.article or not marked):
            own.update(b.text)
            own.update("\n")
    bit = own.intdigest() & 63
    return 1 << bit if bit < 63 else -1 << 63


def _prior(block: Block, marked: bool, names: bool) -> float:
    if not names:
        return 0.0
    if block.furniture:
        return NAMED
    return INSIDE if block.article else OUTSIDE if marked else 0.0


def main_text(page: str | None, importance: dict[int, float] | None = None, repeated: frozenset[int] = frozenset(), low: float = LOW, names: bool = True) -> str:
    """Text of a page without the blocks that the importances of its nodes, the priors and the repeated pieces cut."""
    blocks, _ = parse(page)
    marked = any(b.article and not b.furniture for b in blocks)
    importance = importance or {}
    out = []
    for b in blocks:
        if importance.get(b.node, 1.0) - _prior(b, marked, names) <= low + 1e-9:
            continue
        if repeated and all(_key(x, b.node) in repeated for x in pieces(b.text)):
            continue
        out.append(b.text)
    return "\n".join(out)


def tree_counts(pages: DataFrame, url_col: str = "url", html_col: str = "html", names: bool = True) -> DataFrame:
    """The merged trees as counts: ``host, node, kind, value, n, bodies, chars``.

    Kind 0 is a piece of text, 1 a layout, 2 the node itself (node 0: the page).
    A page counts once in ``n`` for each value; ``bodies`` has the bits of the
    pages' bodies. Counts are summed in each task before they are shuffled, so a
    host with most of the pages is no hot key.
    """
    fields = [("host", pa.string()), ("node", pa.int64()), ("kind", pa.int32()), ("value", pa.int64()), ("n", pa.int64()), ("bodies", pa.int64()), ("chars", pa.int64())]
    schema = pa.schema(fields)

    def table(counts: dict[tuple, list[int]]) -> pa.RecordBatch:
        keys = list(zip(*counts, strict=True)) if counts else [()] * 4
        sums = list(zip(*counts.values(), strict=True)) if counts else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip([*keys, *sums], fields, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, list[int]] = {}
        for batch in sliced(batches, 1):
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host = host_of(url)
                blocks, layouts = parse(page)
                bit = _body(blocks, names)
                seen = {(b.node, _PIECE, _key(x, b.node)): len(x) + 1 for b in blocks for x in pieces(b.text)}
                seen |= {(node, _LAYOUT, _key(x)): 0 for node, x in layouts}
                seen |= {(b.node, _SEEN, 0): 0 for b in blocks}
                seen[0, _SEEN, 0] = 0
                for key, chars in seen.items():
                    if (known := counts.get((host, *key))) is None:
                        counts[host, *key] = [1, bit, chars]
                    else:
                        known[0] += 1
                        known[1] |= bit
            if len(counts) > _FLUSH:
                yield table(counts)
                counts.clear()
        yield table(counts)

    counts = pages.select(url_col, html_col).transform(map_arrow, run, "host string, node long, kind int, value long, n long, bodies long, chars long")
    return _summed(counts, "host", "node", "kind", "value")


def _summed(counts: DataFrame, *by: str) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum("n").alias("n"), F.bit_or("bodies").alias("bodies"), F.max("chars").alias("chars"))


def different(n: Column, bodies: Column) -> Column:
    """Different bodies among ``n`` pages: linear counting over 64 buckets, and one for chance; ``n`` once most buckets are taken."""
    taken = F.bit_count(bodies).cast("double")
    return F.when(taken < 48, F.least(n.cast("double"), 1 - 64 * F.log(1 - taken / 64))).otherwise(n.cast("double"))


def importance(counts: DataFrame, *by: str) -> DataFrame:
    """``by, node, pages, importance`` of nodes with text, from the counts of merged trees.

    Content: one minus the mean, over a node's characters, of log(pages with the
    piece) / log(pages), the entropy of a piece over pages. Presentation: the
    entropy of layouts in units of log(pages), for nodes with elements in them.
    Pages are different bodies.
    """
    d = different(F.col("n"), F.col("bodies"))
    rows = counts.select(*by, "node", "kind", "chars", d.alias("d"))
    piece, layout = F.col("kind") == _PIECE, F.col("kind") == _LAYOUT
    told = F.col("chars") * F.col("d")
    node = rows.groupBy(*by, "node").agg(
        F.max(F.when(F.col("kind") == _SEEN, F.col("d"))).alias("pages"), F.sum(F.when(piece, told)).alias("told"), F.sum(F.when(piece, told * F.log("d"))).alias("again"),
        F.sum(F.when(layout, F.col("d"))).alias("laid"), F.sum(F.when(layout, F.col("d") * F.log("d"))).alias("same"),
    ).filter("told > 0")
    unit = F.log(F.greatest(F.col("pages"), F.lit(2.0)))
    inside = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    content = inside(1 - F.col("again") / F.col("told") / unit)
    made = inside((F.log("laid") - F.col("same") / F.col("laid")) / unit)
    weighed = F.when(F.col("laid").isNull(), content).otherwise(CONTENT_WEIGHT * content + (1 - CONTENT_WEIGHT) * made)
    return node.select(*by, "node", "pages", weighed.alias("importance"))


def _bounded(df: DataFrame, most: int = BROADCAST_CUTS) -> DataFrame:
    """Marked for broadcast if it is small: ``most`` rows or fewer."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", low: float = LOW, names: bool = True) -> DataFrame:
    """Main text of every page: ``id_col, url_col, text``.

    NULL html is empty, and empty pages have empty text; a NULL or odd URL is
    the host "". Whole pages are parsed; broken markup is read as browsers do,
    roughly, in time in proportion to its length; elements nested deeper than
    DEEPEST count as part of the one there. Repeated pages each come back, and
    are one page of the tree. An empty table gives an empty result; other columns
    are not read. ``names=False`` leaves all to the entropies; a negative ``low``
    keeps all. What is cut goes to the pages by a broadcast while it is small,
    else by a join on the host, whose hot hosts Spark's adaptive join splits.
    """
    counts = store(tree_counts(pages, url_col, html_col, names))
    # importances that can matter: up to the largest limit that does not cut its blocks anyway
    limit = max([x for x in (low + p for p in ((INSIDE, 0.0, OUTSIDE, NAMED) if names else (0.0,))) if x < 1], default=-1.0)
    known = (F.col("importance") <= limit + 1e-9) & (F.col("pages") >= LEAST_PAGES)
    own = importance(counts, "host").filter(known).select("host", "node", "importance")
    everywhere = _summed(counts, "node", "kind", "value")
    on_hosts = counts.filter(F.col("kind") == _SEEN).groupBy("node").agg(F.min("host").alias("lo"), F.max("host").alias("hi")).filter("lo < hi").select("node")
    shared = store(importance(everywhere).filter(known).join(on_hosts, "node", "left_semi").select("node", "importance"))
    weak = own.unionByName(counts.filter(F.col("kind") == _SEEN).select("host", "node").join(_bounded(shared), "node").select("host", "node", "importance"))
    weak = weak.groupBy("host", "node").agg(F.min("importance").alias("importance"))

    d = different(F.col("n"), F.col("bodies"))
    whole = counts.filter((F.col("kind") == _SEEN) & (F.col("node") == 0)).select("host", d.alias("whole"))
    said = counts.filter((F.col("kind") == _PIECE) & (d >= LEAST_PAGES)).join(whole, "host").filter((d > MOST * F.col("whole")) & F.lit(low >= 0))
    none = F.lit(None)
    cuts = weak.select("host", "node", "importance", none.cast("long").alias("value")).unionByName(said.select("host", none.cast("long").alias("node"), none.cast("double").alias("importance"), "value"))
    cuts = store(cuts)
    small = cuts.limit(BROADCAST_CUTS + 1).count() <= BROADCAST_CUTS
    cut = cuts.groupBy("host").agg(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("node", "importance"))).alias("weak"), F.collect_list("value").alias("said"))
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    cut = cut.withColumnRenamed("host", "__host")
    rows = rows.withColumn("__host", host).join(F.broadcast(cut) if small else cut, "__host", "left").select(id_col, url_col, html_col, "weak", "said")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            texts = []
            for page, nodes, said in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                texts.append(main_text(page, {x["node"]: x["importance"] for x in nodes or ()}, frozenset(said or ()), low, names))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    kinds = [rows.schema[i].dataType.simpleString() for i in (0, 1)]
    return rows.transform(map_arrow, run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string")
