"""HTML main text by equivalence classes of tokens over the pages of a host.

A page is parsed once, into blocks of text and elements. Its tokens are the paths of its block elements (names, classes and
ids from the root down) and its texts with their paths. Tokens of one host that occur on the same distinct pages equally often
form an equivalence class; occurrence vectors are named by sums of page hashes, so classes are found by grouped sums and no task
holds a host. Classes of two or more tokens on at least half of the host's pages (three or more) make the template. On a page a
class's texts count as far as they stand in the class's order, and an element counts as far as all elements around it are template
too, so that the template nests.

Template elements that occur once a page cut the slots. From the root down, the slot that holds most of the text of the host's
pages is entered, unless a heading would be left behind; an article is never cut further. Of the blocks in the last slot, template texts go
(they do not vary), and so do blocks in elements named as menus, notices, adverts or comments: outright where the name is plain,
else where the element is template. Where no slot is left to enter, `<article>` and `<main>` break the tie. A host of under three distinct
pages has no vectors to compare; there the slots are the page's own elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LEAST_PAGES = 3
#: Template tokens of all hosts up to which they are broadcast (about 100 bytes each); beyond, pages join their host's.
BROADCAST_TOKENS = 200_000
LEAST_TOKENS = 2
#: Share of a slot's text that an inner slot must hold to be entered, and of the pages' headings that must go along.
ENTER, HEADINGS = 0.6, 0.9

# Element names of HTML by what they mean here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template textarea title iframe select button".split())
LEFT_OUT = set("nav footer aside form menu dialog head".split())
INLINE = set("a abbr acronym audio b bdi bdo big button canvas cite code data del dfn em font i img ins kbd label map mark math meter noscript object output picture progress q rp rt ruby s samp select slot small span strike strong sub sup svg textarea time tt u var video wbr".split())
ENDS_PARAGRAPH = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SLOTS = set("html body div section article main center table tbody tr td".split())
PLAIN = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|masthead|menu|nav|navbar|navigation|newsletter|notices?|promo|sidebar|sponsor(?:ed)?|subscribe)(?=$|[\s_-])")
HINTS = re.compile(r"(?:^|[\s_-])(?:banner|modal|pager|pagination|popup|replies|related-(?:articles|content|links|posts|stories)|respond|share|sharing|social|toolbar|widget)(?=$|[\s_-])")
ROLES = set("navigation banner contentinfo complementary search dialog alert".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(>|$)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, attributes) with kind open or close, or ("text", text, ""); raw elements come without their content."""
    at, low = 0, None
    while at < len(html):
        m = _TOKEN.search(html, at)
        if m is None:
            yield "text", html[at:], ""
            return
        if m.start() > at:
            yield "text", html[at : m.start()], ""
        at = m.end()
        if not m[2] or not m[4]:  # a comment or declaration, or a tag that the page's end cuts
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3]
        if name in RAW and not m[3].rstrip().endswith("/"):
            low = low if low is not None else html.lower() if len(html.lower()) == len(html) else html
            end = low.find(f"</{name}", at)
            at = len(html) if end < 0 else end
        elif name in VOID:
            yield "close", name, ""


def _names(attributes: str) -> tuple[str, str]:
    """Class, id and role as one lower-case string, and the role."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(attributes)}
    return " ".join(found.get(k, "") for k in ("class", "id")).strip(), found.get("role", "")


def _hash(text: str) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(text))))


_KNOWN: dict[tuple[int, str, str], tuple[int, int]] = {}


def _element(parent: int, name: str, attributes: str) -> tuple[int, int]:
    """Path of an element, and what its names say: 0 nothing, 1 a hint, 2 plainly no content."""
    key = (parent, name, attributes)
    if key not in _KNOWN:
        if len(_KNOWN) > 100_000:
            _KNOWN.clear()
        names, role = _names(attributes) if attributes else ("", "")
        said = 0
        if name not in ("html", "body", "main", "p") and (names or role):
            said = 2 if role in ROLES or PLAIN.search(names) else 1 if HINTS.search(names) else 0
        _KNOWN[key] = _hash(f"{parent} {name} {names}"), said
    return _KNOWN[key]


class Page:
    """Blocks (text, token, marked: 0 to 2 as `_element`, by: the marked element's path, in an article) and the first element of each path
    with how often the path occurs, its place and parent, its blocks [a, b), its characters outside links and marks, whether it
    holds a heading, and its kind (2 article or main, 1 another that can be a slot)."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, int, int, bool]] = []
        self.elements: dict[int, list] = {}
        self._links: list[int] = []
        self._heads: list[int] = []
        self._read(html)
        size = np.cumsum([0, *(0 if x[2] else max(len(x[0]) - n, 0) for x, n in zip(self.blocks, self._links))])
        if not size[-1]:
            size = np.cumsum([0, *(max(len(x[0]) - n, 0) for x, n in zip(self.blocks, self._links))])
        heads = np.array(self._heads, np.int64)
        for e in self.elements.values():
            e[4] = len(self.blocks) if e[4] is None else e[4]
            e[5] = int(size[e[4]] - size[e[3]])
            e[6] = bool(((heads >= e[3]) & (heads < e[4])).any())

    def _read(self, html: str) -> None:
        # name, path, left out, marked, by, in an article, first of its path, link
        stack: list[tuple[str, int, bool, int, int, bool, bool, bool]] = []
        top = ("", 0, False, 0, 0, False, False, False)
        parts: list[str] = []
        links, open_p = 0, 0
        owner, begun = top, False

        def flush() -> None:
            nonlocal links, begun
            if parts:
                text = _SPACE.sub(" ", "".join(parts)).strip()
                if text:
                    self.blocks.append((text, _hash(f"{owner[1]}#{text}"), owner[3], owner[4], owner[5]))
                    self._links.append(links)
                parts.clear()
            links, begun = 0, False

        def shut(i: int) -> None:
            nonlocal open_p
            for x in stack[i:]:
                open_p -= x[0] == "p"
                if x[6] and self.elements[x[1]][4] is None:
                    self.elements[x[1]][4] = len(self.blocks)
            del stack[i:]

        for kind, value, attributes in tokens(html):
            now = stack[-1] if stack else top
            if kind == "text":
                if not now[2]:
                    text = unescape(value)
                    if not begun and text.strip():
                        owner, begun = now, True
                    parts.append(text)
                    links += len(text.strip()) if now[7] else 0
                continue
            if kind == "open":
                if value == "br" or (value in VOID and value != "hr"):
                    parts.append(" " if value == "br" else "")
                    continue
                if value in ENDS_PARAGRAPH and open_p:
                    flush()
                    shut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"))
                elif value == "li" and now[0] == "li":
                    flush()
                    shut(len(stack) - 1)
                elif value == "body" and any(x[0] == "head" for x in stack):
                    shut(next(i for i, x in enumerate(stack) if x[0] == "head"))
                now = stack[-1] if stack else top
                if value in INLINE or value in RAW:  # neither ends a block
                    stack.append((value, now[1], now[2] or value in RAW, now[3], now[4], now[5], False, now[7] or value == "a"))
                    continue
                flush()
                path, said = _element(now[1], value, attributes)
                article = value in ("article", "main") and said < 2
                out = now[2] or value in LEFT_OUT or (value == "header" and not now[5] and all(x[0] != "section" for x in stack))
                marked, by = (now[3], now[4]) if now[3] >= said else (said, path)
                if article and not now[5] and (now[2] or now[3]) and all(x[0] not in LEFT_OUT - {"form", "head"} for x in stack):
                    out, marked, by = False, 0, 0  # in an advert, a notice or a form that was never closed or that holds the whole page
                first = path not in self.elements
                if not now[2] or not out:
                    if first:
                        sort = 2 if article else 1 if value in SLOTS else 0
                        self.elements[path] = [1, len(self.elements), now[1], len(self.blocks), None, 0, False, sort]
                    else:
                        self.elements[path][0] += 1
                else:
                    first = False
                if value in ("h1", "h2", "h3") and not out and not marked:
                    self._heads.append(len(self.blocks))
                if value == "hr":
                    if first:
                        self.elements[path][4] = len(self.blocks)
                else:
                    open_p += value == "p"
                    stack.append((value, path, out, marked, by, now[5] or article, first, now[7]))
            elif value not in VOID:
                deep = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == value), None)
                if deep is None:
                    continue
                if any(x[0] not in INLINE and x[0] not in RAW for x in stack[deep:]):
                    flush()
                shut(deep)
        flush()
        shut(0)


def slots(elements: dict[int, tuple], share: float = ENTER) -> list[int]:
    """The paths that are entered from the root down; elements: path -> (parent, characters, headings, kind) of those that occur
    once a page and can be slots."""
    inner: dict[int, list[int]] = {}
    for path, e in elements.items():
        inner.setdefault(e[0], []).append(path)
    way: list[int] = []
    here, size, heads = 0, sum(elements[p][1] for p in inner.get(0, ())), sum(elements[p][2] for p in inner.get(0, ()))
    while inner.get(here):
        best = max(inner[here], key=lambda p: (elements[p][1], elements[p][3], -p))
        _, n, h, kind = elements[best]
        if n < share * size or h < HEADINGS * heads or not n:
            break
        way.append(best)
        here, size, heads = best, n, h
        if kind == 2:
            break
    return way


class Template:
    """Of one host: token -> (class, place), and the slots entered."""

    def __init__(self, rows: list[tuple]):
        self.tokens = {r[0]: (r[1], r[2]) for r in rows}
        held = {r[0]: r for r in rows if r[3] is not None and r[6]}
        self.way = slots({t: (r[3], r[4], r[5], r[6]) for t, r in held.items() if r[3] == 0 or r[3] in self.tokens})


def main_text(html: str, template: dict[int, tuple[int, float]]) -> str:
    """The main text of one page; template: text token -> (class, place in its class). The slots are the page's own."""
    return _main_text(Page(html), template, None)


def _main_text(page: Page, found: dict[int, tuple[int, float]], way: list[int] | None) -> str:
    """The text of the page's main slot without template and marked blocks.

    What covers all the text of a slot, or of its articles, is not taken as template there."""
    if not page.blocks:
        return ""
    if way is None:
        way = slots({p: (e[2], e[5], int(e[6]), e[7]) for p, e in page.elements.items() if e[0] == 1 and e[7]})
    a, b, around = 0, len(page.blocks), set()
    for path in way:
        e = page.elements.get(path)
        if e is None or e[0] != 1 or not any(x[0] for x in page.blocks[e[3] : e[4]]):
            break
        a, b = e[3], e[4]
        around.add(path)
    place: dict[int, float] = {}
    articles = any(x[4] and x[2] < 2 for x in page.blocks[a:b])
    kept, own = [], []
    for text, token, marked, by, article in page.blocks[a:b]:
        if articles and not article:
            continue
        if marked and by not in around and (marked == 2 or by in found or not found):
            continue
        own.append(text)
        at = found.get(token)
        if at and at[1] >= place.get(at[0], -1.0):  # in its class's order: template, not content
            place[at[0]] = at[1]
            continue
        kept.append(text)
    return "\n".join(kept or own)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))


_BLOCKS = "array<struct<text:string,token:long,marked:byte,by:long,article:boolean>>"
_ELEMENTS = "array<struct<path:long,n:int,place:int,parent:long,a:int,b:int,chars:long,head:boolean,kind:byte>>"
_BLOCK_TYPE = pa.list_(pa.struct([("text", pa.string()), ("token", pa.int64()), ("marked", pa.int8()), ("by", pa.int64()), ("article", pa.bool_())]))
_ELEMENT_TYPE = pa.list_(pa.struct([("path", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("parent", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("chars", pa.int64()), ("head", pa.bool_()), ("kind", pa.int8())]))


def parse(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(k, u, host, page, blocks, elements): each page as `Page` has it; page is a hash of the html. The one pass over the html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                blocks, elements = [], []
                for h in part.column(4):
                    page = Page(h.as_py() or "")
                    blocks.append([dict(zip(("text", "token", "marked", "by", "article"), x)) for x in page.blocks])
                    elements.append([dict(zip(("path", "n", "place", "parent", "a", "b", "chars", "head", "kind"), (p, *e))) for p, e in page.elements.items()])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(blocks, _BLOCK_TYPE), pa.array(elements, _ELEMENT_TYPE)], names=["k", "u", "host", "page", "blocks", "elements"])

    src = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), _host(F.col(url)).alias("host"), F.xxhash64(html).alias("page"), F.col(html).cast("string").alias("h"))
    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, u string, host string, page long, blocks {_BLOCKS}, elements {_ELEMENTS}")


def templates(parsed: DataFrame) -> DataFrame:
    """(host, token, class, place, parent, chars, heads, kind): the tokens of each host's template; parent is null for texts,
    kind 0 for elements that are no slots."""
    element = lambda e: F.struct(e["path"].alias("token"), e["n"].alias("n"), e["place"].cast("double").alias("place"), e["parent"].alias("parent"), e["chars"].alias("chars"), e["head"].cast("long").alias("head"), e["kind"].alias("kind"))
    none = F.lit(None).cast("long")
    text = lambda t, i: F.struct(t.alias("token"), F.lit(1).alias("n"), (i + 1000).cast("double").alias("place"), none.alias("parent"), F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("head"), F.lit(0).cast("byte").alias("kind"))
    all_ = F.concat(F.transform("elements", element), F.transform(F.array_distinct(F.col("blocks.token")), text))
    seen = parsed.select("host", "page", F.explode_outer(all_).alias("t")).where("t.token IS NOT NULL")
    # copies of a page have one vote
    once = seen.groupBy("host", "page", "t.token").agg(*(F.first(f"t.{c}").alias(c) for c in ("n", "place", "parent", "chars", "head", "kind")))
    mark = F.xxhash64("page", "n")
    vectors = once.groupBy("host", "token").agg(
        F.sum(F.shiftright(mark, 32)).alias("hi"), F.sum(mark.bitwiseAND(0xFFFFFFFF)).alias("lo"), F.count("*").alias("support"), F.avg("place").alias("place"),
        F.max("parent").alias("parent"), F.sum("chars").alias("chars"), F.sum("head").alias("heads"), F.max("kind").alias("kind"), F.max("n").alias("most"),
    )
    hosts = parsed.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    often = vectors.where(F.col("support") >= LEAST_PAGES).join(hosts, "host").where(2 * F.col("support") >= F.col("pages"))
    # a table, as the vectors are used twice
    often = Scratch(parsed.sparkSession, "html").save(often.withColumn("class", F.xxhash64("hi", "lo", "support")), "often")
    valid = often.groupBy("host", "class").agg(F.count("*").alias("size")).where(F.col("size") >= LEAST_TOKENS).select("host", "class")
    kind = F.when(F.col("most") == 1, F.col("kind")).otherwise(F.lit(0)).cast("int")
    return often.join(valid, ["host", "class"], "left_semi").select("host", "token", "class", "place", "parent", "chars", "heads", kind.alias("kind"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars long): the main text of every page, a row for each input row.

    Null and empty pages give an empty text; a null url is a host of its own. Character references are decoded, white
    space inside a block (line breaks included) becomes one space, blocks are joined by line ends in page order. Repeated pages
    give repeated rows and count once in the template; equal places go by class order; pages of any length are parsed whole; an empty
    table gives an empty one. Other columns are dropped.
    """
    scratch = Scratch(pages.sparkSession, "html")
    parsed = scratch.save(parse(pages, key, url, html), "parsed")
    found = scratch.save(templates(parsed), "templates")
    schema = f"k {parsed.schema['k'].dataType.simpleString()}, u string, text string, n_chars long"
    fields = ("token", "class", "place", "parent", "chars", "heads", "kind")

    def read(blocks: list[dict], elements: list[dict], template: Template | None) -> str:
        page = Page.__new__(Page)
        page.blocks = [tuple(x.values()) for x in blocks]
        page.elements = {x["path"]: [x["n"], x["place"], x["parent"], x["a"], x["b"], x["chars"], x["head"], x["kind"]] for x in elements}
        return _main_text(page, template.tokens, template.way) if template else _main_text(page, {}, None)

    def rows(b: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["k", "u", "text", "n_chars"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                yield b.slice(at, 256)

    if found.count() <= BROADCAST_TOKENS:
        by_host: dict[str, list[tuple]] = {}
        for r in found.toArrow().to_pylist():
            by_host.setdefault(r["host"], []).append(tuple(r[c] for c in fields))
        shared = pages.sparkSession.sparkContext.broadcast(by_host)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = {host: Template(x) for host, x in shared.value.items()}
            for b in parts(batches):
                yield rows(b, [read(x.as_py(), e.as_py(), own.get(h.as_py())) for x, e, h in zip(b.column(2), b.column(3), b.column(4))])

        out = parsed.select("k", "u", "blocks", "elements", "host").mapInArrow(run, schema)
    else:
        # a template holds at most twice the tokens of its host's average page
        packed = found.groupBy("host").agg(F.collect_list(F.struct(*fields)).alias("template"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts(batches):
                own = [Template([tuple(r.values()) for r in x.as_py()]) if x.is_valid else None for x in b.column(4)]
                yield rows(b, [read(x.as_py(), e.as_py(), t) for x, e, t in zip(b.column(2), b.column(3), own)])

        out = parsed.join(packed, "host", "left").select("k", "u", "blocks", "elements", "template").mapInArrow(run, schema)
    return out.withColumnsRenamed({"k": key, "u": url})
