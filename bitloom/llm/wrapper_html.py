"""Main text of HTML pages by wrapper induction.

Pages are parsed into DOM trees (void elements, optional end tags, raw text of scripts and styles,
comments, character references). Pages of a host with one layout (the same structural elements with
the same classes) are aligned, by simple tree matching, with two reference pages of that layout,
those of the least and of the greatest hash. The matching is order-preserving and weighs equal
texts double, so a constant node finds its like behind any number of varying siblings. Over all
pages of the layout, a node of a reference page that nearly all pages aligned with it share is
template; slots whose text varies are content. Pages with the same whole text count once where it
is asked whether enough different pages share a node. Sibling lists are matched row by row in
numpy, and by halves where the table of two very long lists would not fit in memory; nothing is
cut. The wrapper of a host is the set of its template nodes, each a hash of its path and text.

A layout with fewer than three pages teaches nothing, and a host without such a layout has an empty
wrapper. There, and for what varies but is no content, boilerplate regions are dropped: regions
named by their element (nav, header, footer, aside, form, ...) or by a word of their class, id or
role (menu, sidebar, ad, notice, comments, ...). Such words say nothing of html, body, main and
article, nor of an element around main or the marked article or around over half of the text of the
article or, if none is marked, of the page. If a page marks its article (article, main), only that
region counts; headings in a header of the article belong to it.

Defined results: a null or empty html gives ""; text outside any element is a block; a page without
a parsable host belongs to host ""; repeated rows are each extracted; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored

# AGREE of the pages aligned with a template node have its text; they are LEAST different pages, and LAYOUT of the layout's, at least.
LEAST, AGREE, LAYOUT = 3, 0.9, 0.05
CELLS = 4 << 20  # of a table of two sibling lists; larger ones are matched by halves
FLUSH = 100_000  # counts that a task holds
# Fixed values of HTML: elements without content, elements that start a block, what ends an open element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody", "thead"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "body": {"head"}}
SCOPE = frozenset("ul ol dl table td th div article section main aside nav header footer form body html blockquote button".split())
SKIP = frozenset("nav header footer aside form script style noscript template iframe textarea title head button select option input svg canvas object embed audio video menu dialog search fieldset".split())
WHOLE = frozenset("html body main article".split())  # are no regions whatever their class says
#: Words of a class, id or role that name a boilerplate region.
REGION = frozenset("ad ads adv advert adverts advertisement advertising adsense adbox banner promo promoted promotion sponsor sponsored sponsors nav navbar navigation navlinks menu menubar breadcrumb breadcrumbs header masthead topbar footer footnav bottombar copyright legal sidebar aside complementary rail widget widgets notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations teaser teasers trending comment comments commentlist reply replies respond disqus discussion pagination pager skip toolbar contentinfo search form".split())
TOKEN = re.compile(r"<!--(.*?)(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS, BLANK = re.compile(r"[A-Za-z]+"), re.compile(r"[ \t\n\r\f\v  -   　   \x1c-\x1f\x85]+")


class Node:
    __slots__ = ("tag", "name", "region", "children", "parent", "chars")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
        self.name = tag + "".join("." + x for x in sorted(found.get("class", "").lower().split()))
        own = " ".join(found.values())
        words = {w.lower() for w in WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", own))} if own else ()
        self.region = tag in SKIP or tag not in WHOLE and any(w in REGION for w in words)


def parse(text: str) -> Node:
    """The DOM: children are Nodes and strings of decoded text."""
    root = here = Node("", "", None)
    at, n, low = 0, len(text), None
    while at < n:
        m = TOKEN.search(text, at)
        if m is None:
            here.children.append(entities.unescape(text[at:]))
            break
        if m.start() > at:
            here.children.append(entities.unescape(text[at : m.start()]))
        at = max(m.end(), at + 1)
        if m[2] is not None:
            here.children.append(m[2])
        elif m[3] is not None:
            tag, up = m[3].lower(), here
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                here = up.parent
            elif tag == "p":  # an end tag alone is an empty paragraph
                here.children.append(Node("p", "", here))
        elif m[4] is not None:
            tag = m[4].lower()
            if tag in BLOCK:  # a block ends an open paragraph and what is inline within it
                up = here
                while up is not root and up.tag not in SCOPE and up.tag != "p":
                    up = up.parent
                if up.tag == "p":
                    here = up.parent
            ends = CLOSES.get(tag)
            if ends:
                up = here
                while up is not root and up.tag not in ends and (up.tag not in SCOPE or up.tag in ends):
                    up = up.parent
                if up.tag in ends:
                    here = up.parent
            node = Node(tag, m[5], here)
            here.children.append(node)
            if tag in RAW:
                low = text.lower() if low is None else low
                end = low.find("</" + tag, at)
                node.children.append(text[at : end if end >= 0 else n])
                at = n if end < 0 else (text.find(">", end) + 1 or n)
            elif tag not in VOID and not (m[5] or "").endswith("/"):
                here = node
    _settle(root)
    return root


def _settle(root: Node) -> None:
    """Words of a class name no region where they would take the article with them: around main,
    around the marked article, and around over half of the text if no article is marked outside."""
    nodes, named = [root], False
    for node in nodes:
        if node.tag not in SKIP:
            named |= node.region
            nodes += [c for c in node.children if isinstance(c, Node)]
    if not named:
        return
    for node in reversed(nodes):
        node.chars = 0 if node.tag in SKIP else sum(c.chars if isinstance(c, Node) else len(c.strip()) for c in node.children)

    def around(node: Node) -> list[Node]:
        out = []
        while node.parent is not None:
            node = node.parent
            if node.region:
                out.append(node)
        return out

    for node in nodes:
        if node.tag == "main":
            for up in around(node):
                up.region = False
    articles = [(n, around(n)) for n in nodes if n.tag == "article"]
    least = min((len(ups) for _, ups in articles), default=0)
    own = [(n, ups) for n, ups in articles if len(ups) == least]
    outside = root.chars - sum(n.chars for n in nodes if n.region and n.tag not in SKIP and not around(n))
    if least and (len(own) == 1 or sum(n.chars for n, _ in own) >= outside):
        for up in [up for _, ups in own for up in ups]:
            up.region = False
    marked = set(_article(root))
    total = sum(n.chars for n in marked)
    for node in nodes:  # outer ones first
        if node.region and node.tag not in SKIP and 2 * node.chars > total:
            up = node
            while up is not None and up not in marked:
                up = up.parent
            if up is not None:
                node.region = False


def _article(root: Node) -> list[Node]:
    """The marked article regions outside boilerplate, or the root."""
    for wanted in (lambda x: x.tag == "article", lambda x: x.tag == "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.region:
                continue
            if wanted(node):
                found.append(node)
            else:
                todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        if found:
            return found
    return [root]


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


def _headings(node: Node) -> list[Node]:
    """The headings of an article's header, outside other regions."""
    out, todo = [], list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, Node) and not c.region:
            if c.tag in HEADINGS:
                out.append(c)
            else:
                todo += reversed(c.children)
    return out


def _titles(node: Node) -> bool:
    return node.tag == "header" or node.tag not in SKIP and "header" in WORDS.findall(node.name)


def text_blocks(root: Node) -> list[tuple[str, str]]:
    """(path, text) of the content blocks, in page order."""
    return [(p, t) for p, t, _ in owned_blocks(root)]


def owned_blocks(root: Node) -> list[tuple[str, str, Node]]:
    """The same with the element that each block's text is directly in."""
    out: list[tuple[str, str, Node]] = []
    for top in _article(root):
        path, up = [], top
        while up is not None and up.tag:
            path.append(up.name)
            up = up.parent
        run: list[str] = []
        where = "/".join(reversed(path))

        marked = top.tag in ("article", "main")

        def flush(at: str, owner: Node) -> None:
            text = BLANK.sub(" ", "".join(run)).strip(" ")
            run.clear()
            if text:
                out.append((at, text, owner))

        todo: list[tuple] = [("in", top, where, top)]
        while todo:
            step, node, at, owner = todo.pop()
            if step == "flush":
                flush(at, owner)
            elif isinstance(node, str):
                run.append(node)
            elif node.tag == "br":
                run.append(" ")
            elif node is top or not node.region:
                below = f"{at}/{node.name}".lstrip("/") if node is not top else at
                block = node.tag in BLOCK or node is top
                if block:
                    flush(at, owner)
                    todo.append(("flush", None, below, node))
                todo += [("in", c, below if block else at, node if block else owner) for c in reversed(node.children)]
            elif marked and _titles(node):
                todo += [("in", c, at, owner) for c in reversed(_headings(node))]
    return out


def extract(html: str | None, template: frozenset = frozenset()) -> str:
    if not html:
        return ""
    return "\n".join(t for p, t in text_blocks(parse(html)) if not template or key(p, t) not in template)


def hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def key(path: str, text: str) -> int:
    return hashed(path + "\n" + text)


class Outline:
    """A page's blocks as a tree: elements with the elements and texts below them in page order."""

    __slots__ = ("name", "children", "text", "leaf", "single")

    def __init__(self, name: str, text: int | None = None, leaf: int = -1):
        self.name, self.text, self.leaf, self.children, self.single = name, text, leaf, [], None


def outline(root: Node) -> tuple[Outline, list[int]]:
    """The tree and, of each of its texts, the hash of path and text."""
    top, keys = Outline(""), []
    open_: list[tuple[Node, Outline]] = []
    for path, text, owner in owned_blocks(root):
        chain, up = [], owner
        while up is not None and up.tag:
            chain.append(up)
            up = up.parent
        chain.reverse()
        k = 0
        while k < len(open_) and k < len(chain) and open_[k][0] is chain[k]:
            k += 1
        del open_[k:]
        for node in chain[k:]:
            own = Outline(node.name)
            (open_[-1][1] if open_ else top).children.append(own)
            open_.append((node, own))
        (open_[-1][1] if open_ else top).children.append(Outline("#", hashed(text), len(keys)))
        keys.append(key(path, text))
    for node in (todo := [top]):
        todo += node.children
        only = node.children[0] if len(node.children) == 1 else None
        node.single = only.text if only is not None else None  # an element with one text and nothing else
    return top, keys


def _weights(x: list[Outline], y: list[Outline], inner: dict) -> np.ndarray:
    """What matching each of x with each of y is worth: a point for each pair of elements or texts
    in the best alignment below them, and another for equal texts."""
    names = {n: k for k, n in enumerate({c.name for c in (*x, *y)})}
    a, b = (np.array([names[c.name] for c in z], np.int64) for z in (x, y))
    own = lambda c: c.text if c.text is not None else c.single
    plain = [np.array([own(c) is not None for c in z]) for z in (x, y)]
    texts = [np.array([own(c) or 0 for c in z], np.int64) for z in (x, y)]
    same = a[:, None] == b[None, :]
    both = plain[0][:, None] & plain[1][None, :]
    leaf = np.array([c.text is None for c in x], np.int64)[:, None]  # an element around its text counts too
    out = np.where(same & both, 1 + leaf + (texts[0][:, None] == texts[1][None, :]), 0)
    for i, j in zip(*np.nonzero(same & ~both)):
        out[i, j] = 1 + align(x[i].children, y[j].children, inner, (x[i], y[j]))
    return out


def _rows(w: np.ndarray) -> np.ndarray:
    """The table of best alignments of the first i with the first j."""
    best = np.zeros((w.shape[0] + 1, w.shape[1] + 1), np.int64)
    for i in range(w.shape[0]):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + w[i]))
    return best


def _best(x: list[Outline], y: list[Outline], inner: dict) -> tuple[int, list[tuple[int, int]]]:
    if not x or not y:
        return 0, []
    if len(x) * len(y) > CELLS and len(x) > 1:
        half = len(x) // 2

        def last(xs: list[Outline], ys: list[Outline]) -> np.ndarray:
            row = np.zeros(len(ys) + 1, np.int64)
            step = max(1, CELLS // len(ys))
            for k in range(0, len(xs), step):
                for w in _weights(xs[k : k + step], ys, inner):
                    row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w))
            return row

        cut = int(np.argmax(last(x[:half], y) + last(x[half:][::-1], y[::-1])[::-1]))
        a, b = _best(x[:half], y[:cut], inner), _best(x[half:], y[cut:], inner)
        return a[0] + b[0], a[1] + [(i + half, j + cut) for i, j in b[1]]
    w = _weights(x, y, inner)
    best = _rows(w)
    i, j, pairs = len(x), len(y), []
    while i and j:
        if w[i - 1, j - 1] and best[i, j] == best[i - 1, j - 1] + w[i - 1, j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i, j] == best[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return int(best[-1, -1]), pairs


def align(x: list[Outline], y: list[Outline], inner: dict, of: tuple | None = None) -> int:
    """The worth of the best alignment of two sibling lists, its pairs noted in `inner`."""
    at = (id(of[0]), id(of[1])) if of else None
    if at not in inner:
        inner[at] = _best(x, y, inner)
    return inner[at][0]


def matched(a: Outline, b: Outline) -> list[tuple[int, int, bool]]:
    """Simple tree matching of two outlines: the aligned texts (a's, b's, whether they are equal)."""
    inner: dict = {}
    align(a.children, b.children, inner)
    out, todo = [], [(a, b, None)]
    while todo:
        x, y, at = todo.pop()
        if at not in inner:  # two elements with a text each
            inner[at] = _best(x.children, y.children, inner)
        for i, j in inner[at][1]:
            c, d = x.children[i], y.children[j]
            if c.text is not None:
                out.append((c.leaf, d.leaf, c.text == d.text))
            elif c.single is not None and d.single is not None:
                out.append((c.children[0].leaf, d.children[0].leaf, c.single == d.single))
            else:
                todo.append((c, d, (id(c), id(d))))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over host, layout, html and the reference pages: for each text of a reference, how many
    pages are aligned with it, how many have it, and some of these by the hash of their text."""
    names = ["host", "layout", "reference", "leaf", "key", "aligned", "same", "kinds"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    counts: dict[tuple, list] = {}
    parsed = functools.lru_cache(maxsize=64)(lambda html: outline(parse(html)))

    def rows() -> pa.RecordBatch:
        flat = [(*k, x[0], x[1], x[2], sorted(x[3])) for k, x in counts.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate(types)], names)

    for batch in batches:
        for host, layout, html, references in zip(*(batch.column(k).to_pylist() for k in range(4))):
            tree, keys = outline(parse(html))
            content = hashed(" ".join(map(str, keys)))
            for k, reference in enumerate(references):
                other, own = parsed(reference)
                for a, _, equal in matched(other, tree):
                    x = counts.setdefault((host, layout, k, a), [own[a], 0, 0, set()])
                    x[1] += 1
                    x[2] += equal
                    if equal and len(x[3]) < LEAST:
                        x[3].add(content)
        if len(counts) > FLUSH:
            yield rows()
    yield rows()


STRUCTURE = r"(?i)<((?:body|main|header|footer|nav|aside|section|article|div)\b[^>]*)>"


def layout(html: Column) -> Column:
    """A hash of the structural elements that a page has, with their classes."""
    one = lambda x: F.lower(F.concat(F.regexp_extract(x, r"^\w+", 0), F.lit(" "), F.regexp_extract(x, r"(?i)\bclass\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)))
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(STRUCTURE), F.lit(1)), one))), "\n"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, template (keys of template nodes) from all pages: host, html."""
    rows = pages.where("html <> ''").select("host", "html", layout(F.col("html")).alias("layout"), F.xxhash64("html").alias("content"))
    layouts = stored(rows.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high")).where((F.col("n") >= LEAST) & (F.col("low") < F.col("high"))), "layouts")
    marks = layouts.select("host", "layout", F.explode(F.array("low", "high")).alias("content"))
    picked = rows.join(small(marks), ["host", "layout", "content"], "left_semi").groupBy("host", "layout", "content").agg(F.min("html").alias("html"))
    references = stored(picked.groupBy("host", "layout").agg(F.transform(F.sort_array(F.collect_list(F.struct("content", "html"))), lambda x: x["html"]).alias("references")), "reference-pages")
    counted = rows.join(small(references), ["host", "layout"]).select("host", "layout", "html", "references").mapInArrow(_counted, "host string, layout long, reference long, leaf int, key long, aligned long, same long, kinds array<bigint>")
    sums = counted.groupBy("host", "layout", "reference", "leaf").agg(F.min("key").alias("key"), F.sum("aligned").alias("aligned"), F.sum("same").alias("same"), F.collect_set("kinds").alias("kinds"))
    nodes = sums.where((F.col("same") >= AGREE * F.col("aligned")) & (F.size(F.array_distinct(F.flatten("kinds"))) >= LEAST)).join(small(layouts), ["host", "layout"]).where(F.col("aligned") >= LAYOUT * F.col("n"))
    return nodes.groupBy("host").agg(F.sort_array(F.collect_set("key")).alias("template"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host.alias("host"))
    learned = stored(wrappers(src.select("host", "html")).withColumn("template", F.to_json("template")), "wrappers")
    known: dict[str, frozenset] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for h, t in zip(batch.column(2), batch.column(3)):
                t = t.as_py() or "[]"
                if t not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[t] = frozenset(json.loads(t))
                texts.append(extract(h.as_py(), known[t]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return src.join(small(learned), "host", "left").select("page_id", "url", "html", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long")
