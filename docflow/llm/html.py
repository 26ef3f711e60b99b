"""Main text of web pages: element subtrees that recur on many pages of a host are its template and go, as do elements that are chrome by kind."""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, raw, slices, table

SHARE = 0.2  # of a host's different pages that a template subtree is on, at least
PAGES = 3  # and at least so many
SMALL = 20_000  # hosts whose templates may be broadcast (at most a few hundred hashes each)

#: Kinds of elements of HTML, and words of class, id and role that mark chrome.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav footer aside form button select option fieldset dialog menu head svg canvas object audio video map label datalist legend optgroup".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
PROSE = INLINE | frozenset("h1 h2 h3 h4 h5 h6 dd dt figcaption tbody thead tfoot tr td th caption hr article main".split())
#: A name of class, id or role marks chrome if it is one of these words, or is made of them and of NEUTRAL ones.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead topbar toolbar comment comments reply replies respond disqus share sharing social related recommended newsletter subscribe subscription popup modal overlay login signup search pagination pager widget skip complementary contentinfo".split()
)
NEUTRAL = frozenset("site box list block wrap wrapper container area bar inner top bottom left right primary secondary global item items thread form link links button buttons text main".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SIMPLE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*+>?|<()()()(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)  # after an unbalanced quote
_PARTS = re.compile(r"[^a-z]+")
_SPACES = re.compile(r"[ \t\n\r\f\v ]+")
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LIMIT = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


class Element:
    __slots__ = ("tag", "parts", "marked", "hidden", "children", "hash", "size", "mains")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, self.hash, self.hidden, self.size, self.mains = tag, [], 0, False, 0, 0
        self.parts: frozenset[str] = frozenset()
        self.marked = False  # whether a name marks it as chrome
        if attributes and ("=" in attributes or "hidden" in attributes):
            own = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            names = [[w for w in _PARTS.split(name) if w] for k in ("class", "id", "role") if k in own for name in own[k].lower().split()]
            self.parts = frozenset(w for n in names for w in n)
            self.marked = any(WORDS.intersection(n) and WORDS.union(NEUTRAL).issuperset(n) for n in names)
            self.hidden = "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()


class _Open:
    """The open elements, with the places of each tag and of the blocks among them, so that no search walks over the elements that stay."""

    def __init__(self, root: Element):
        self.stack, self.places, self.blocks = [root], {"#root": [0]}, [0]

    def push(self, e: Element) -> None:
        self.places.setdefault(e.tag, []).append(len(self.stack))
        if e.tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(e)

    def cut(self, k: int) -> None:
        """Close the elements from place k on."""
        for e in self.stack[k:]:
            self.places[e.tag].pop()
        while self.blocks[-1] >= k:
            self.blocks.pop()
        del self.stack[k:]

    def last(self, tags: tuple[str, ...]) -> int:
        """The place of the innermost element of one of the tags, 0 without one."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def first(self, tags: tuple[str, ...], beyond: int) -> int:
        """The place of the outermost element of one of the tags inside the element at place beyond, 0 without one."""
        found = (p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_right(p, beyond)) < len(p))
        return min(found, default=0)


def parse(page: str) -> Element:
    """Tree of elements and texts, forgiving as browsers are about missing end tags; in time proportional to the page."""
    root = Element("#root")
    opened, at, tags = _Open(root), 0, _TAG
    ends: dict[str, re.Pattern] = {}
    final = max(page.rfind(">"), page.rfind("<!"))  # nothing after it is a tag or a comment
    while at <= final and (m := tags.search(page, at)):
        if m.start() > at:
            opened.stack[-1].children.append(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        if not m[2]:
            tags = _SIMPLE  # a quote without its end: from here on a tag ends at its first >
        tag = tag.lower()
        if closing:
            k = opened.last((tag,))
            if k and (tag not in INLINE or k > opened.blocks[-1]):  # the end of an inline element closes none outside its block
                opened.cut(k)
            continue
        if tag in RAW:
            if tag not in ends:
                ends[tag] = re.compile(rf"</{re.escape(tag)}\s*>", re.I)
            end = ends[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _CLOSES_P and opened.stack[opened.blocks[-1]].tag == "p":
            opened.cut(opened.blocks[-1])
        if tag in _SAME and (k := opened.first(_SAME[tag], opened.last(_LIMIT[tag]))):
            opened.cut(k)
        element = Element(tag, attributes)
        opened.stack[-1].children.append(element)
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            opened.push(element)
    if at < len(page):
        opened.stack[-1].children.append(page[at:])
    _measure(root)
    return root


def _measure(root: Element) -> None:
    """Sizes of texts and numbers of main parts of all elements. A name doesn't mark what holds all main parts or more than half of the page's text, nor a main element, nor every article."""
    order = [root]
    for e in order:
        order += [c for c in e.children if not isinstance(c, str)]
    for e in reversed(order):
        e.size = sum(len(c.strip()) if isinstance(c, str) else c.size for c in e.children)
        e.mains = (e.tag in ("article", "main")) + sum(c.mains for c in e.children if not isinstance(c, str))
    articles = [e for e in order if e.tag == "article"]
    every = all(e.marked for e in articles)
    for e in order:
        if e.marked and (e.tag in ("body", "html", "main") or e.size * 2 > root.size or e.mains == root.mains > 0 or (e.tag == "article" and every)):
            e.marked = False


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def digest(root: Element) -> None:
    """Hash every element by its tag, texts and children; without recursion, for deep pages."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo += [c for c in e.children if not isinstance(c, str)]
    for e in reversed(order):
        e.hash = _hash(e.tag, *[_SPACES.sub(" ", c).strip() if isinstance(c, str) else c.hash for c in e.children])


def main_roots(root: Element) -> list[Element]:
    """The outermost articles that aren't chrome; without any, main; without that, the whole page."""

    def outermost(wanted) -> list[Element]:
        found, todo = [], [root]
        while todo:
            e = todo.pop()
            if wanted(e):
                found.append(e)
            else:
                todo += [c for c in reversed(e.children) if not isinstance(c, str) and not is_chrome(c, False)]
        return found

    return outermost(lambda e: e.tag == "article" and not is_chrome(e, False)) or outermost(lambda e: e.tag == "main" or "main" in e.parts and e.tag == "div") or [root]


def is_chrome(e: Element, inside: bool) -> bool:
    """By kind alone. A header inside the main part may hold the heading and stays."""
    return e.hidden or e.tag in CHROME or (e.tag == "header" and not inside) or e.marked


def candidates(root: Element) -> list[int]:
    """Hashes of the subtrees that may be template: all outside the main part; inside it blocks of text too, but not headings, parts of tables and inline elements."""
    roots = main_roots(root)
    inside_of = {id(r) for r in roots if r is not root}
    found, todo = set(), [(root, False)]
    while todo:
        e, inside = todo.pop()
        inside = inside or id(e) in inside_of
        if e.children and e.tag not in ("#root", "html", "body") and not (inside and e.tag in PROSE):
            found.add(e.hash)
        todo += [(c, inside) for c in e.children if not isinstance(c, str)]
    return sorted(found)


def extract(root: Element, template: frozenset[int] | set[int]) -> str:
    """Texts of the blocks of the main part in order, without chrome and template subtrees."""
    blocks: list[list[str]] = [[]]
    whole = main_roots(root)
    kept_whole, tops = whole == [root], {id(r) for r in whole}
    todo: list[tuple[object, bool]] = [(r, True) for r in reversed(whole)]
    while todo:
        e, opening = todo.pop()
        if isinstance(e, str):
            blocks[-1].append(e)
            continue
        if e.tag == "br":
            blocks[-1].append(" ")
            continue
        block = e.tag not in INLINE
        if opening and id(e) not in tops:
            if is_chrome(e, not kept_whole) or (e.hash in template and not (not kept_whole and e.tag in PROSE)):
                if block:
                    blocks.append([])
                continue
        if block:
            blocks.append([])
        if opening:
            todo.append((e, False))
            todo += [(c, True) for c in reversed(e.children)]
    texts = (_SPACES.sub(" ", html.unescape("".join(b))).strip() for b in blocks if b)
    return "\n".join(t for t in (re.sub(r"\s+", " ", x).strip() for x in texts) if t)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in slices(batches, "_html"):
        data, offsets = raw(batch.column("_html"))
        body = data.tobytes()
        yield batch, [body[offsets[i] : offsets[i + 1]].decode("utf-8", "replace") for i in range(batch.num_rows)]


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): hashes of the subtrees on SHARE of the host's different pages. Pages with the same main part are one page, so copies don't make a template.

    A page adds as many hashes as it has elements, so a host keeps at most elements per page / SHARE of them, however many pages it has.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _pages(batches):
            seen: set[tuple[str, int, int]] = set()
            for host, text in zip(batch.column("_host").to_pylist(), texts, strict=True):
                root = parse(text)
                digest(root)
                page = _hash(*[r.hash for r in main_roots(root)])
                seen.add((host, 0, page))
                seen.update((host, h, page) for h in candidates(root))
            cols = list(zip(*seen, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["host", "hash", "page"])

    rows = pages.select("_host", "_html").mapInArrow(look, "host string, hash bigint, page bigint").distinct()
    counts = rows.groupBy("host", "hash").count()
    counts = checkpoint(counts.where(f"count >= {PAGES} or hash = 0"))
    sizes = counts.where("hash = 0").select("host", F.col("count").alias("pages"))
    kept = counts.where("hash <> 0").join(sizes, "host").where(F.col("count") >= SHARE * F.col("pages"))
    return kept.groupBy("host").agg(F.collect_list("hash").alias("template"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page. A null html is empty and has the empty text; pages without a host share one of their own; rows that repeat are kept, as are null ids. Other columns are left out, also those named text or n_chars; an empty table gives no rows."""
    pages = pages.select("page_id", "url", F.col("html").cast("binary").alias("_html"), host_of(F.col("url")).alias("_host"))
    found = checkpoint(templates(pages))
    rows = pages.join(broadcast_if_small(found, SMALL), F.col("_host") == F.col("host"), "left").select("page_id", "url", "_html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _pages(batches):
            out = []
            for text, template in zip(texts, batch.column("template"), strict=True):
                root = parse(text)
                digest(root)
                out.append(extract(root, set(template.as_py() or ())))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op5_html(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))

