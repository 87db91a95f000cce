"""Main text of web pages by removal of site templates.

Pages are parsed to trees and every element subtree is hashed. Spark counts, per host,
on how many different pages each block-level or named subtree occurs, wherever it stands
in the page, and subtrees that recur on ``least_pages`` pages of their host are deleted
before the text is read. The limit is a count, so a section's block goes however large its
host is. What no count can tell (adverts, notices and comments differ from page to page)
is left to tags and to words of class, id and role that name page furniture; ``by_words``
turns those words off. If a page has an article (else a main element), its text is what
the page's text is; in there, plain prose without attributes stays even when it recurs,
because authors do repeat paragraphs.

Pages of one host with the same text after removal of named furniture are one page, so
copies of an article don't turn it into a template, whatever stands around them.

Text is cut into blocks at block elements; white space in a block becomes one blank,
blocks are trimmed, and non-empty ones are joined by a blank line.

Defined cases: null and empty html give an empty text; a page without markup is one
block; unclosed, stray and cut tags are tolerated; a null url is a host of its own;
repeated rows get the same text; a subtree on exactly ``least_pages`` pages goes; an empty
table gives an empty table; other columns are kept. A page, however long, is parsed in
memory on its own; nothing is dropped or capped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.llm.text import free_name, whole
from pitpanel.session import settle

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set("""address article aside blockquote body caption center dd details dialog div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav
    ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
#: An open element of the key is closed by a start tag of the values.
CLOSED_BY = {
    "p": BLOCK - {"body", "html", "option", "td", "th", "tr", "caption", "tbody", "thead"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "head": {"body"},
}
#: Start tags look for what they close no further up than these.
SCOPE = set("table ul ol dl div section article main body html td th blockquote".split())
FURNITURE = set("""nav header footer aside form script style noscript template iframe button
    select textarea title svg canvas object dialog menu head""".split())
#: Words of class, id and role that name page furniture.
FURNITURE_WORDS = set("""ad ads advert adverts advertisement advertising banner breadcrumb
    breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus dialog
    footer header login masthead menu modal nav navbar navigation newsletter notice notices
    pager pagination popup promo promoted related respond search share sharing sidebar signup
    social sponsor sponsored subscribe toolbar widget""".split())
PROSE = set("""p h1 h2 h3 h4 h5 h6 b i em strong u s a span small sub sup code pre blockquote q
    ul ol li dl dt dd table tbody thead tr td th caption figure figcaption br hr img""".split())


@dataclass
class Page:
    """A parsed page: parallel lists of its elements, and its text in order."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    names: list[set[str]] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    hashes: list[int] = field(default_factory=list)
    #: (element, text), text None where a block begins or ends.
    pieces: list[tuple[int, str | None]] = field(default_factory=list)


def parse(source: str) -> Page:
    page = Page()
    stack: list[int] = []
    parts: list[list[str]] = []

    def open_element(tag: str, attributes: str) -> int:
        names, hidden, bare = set(), False, True
        if attributes.strip(" /\n\t\r\f"):
            bare = False
            for name, *values in _ATTRIBUTE.findall(attributes):
                name = name.lower()
                if name in ("class", "id", "role"):
                    names.update(_WORD.findall("".join(values).lower()))
                elif name == "hidden" or name == "aria-hidden" and "true" in values:
                    hidden = True
        at = len(page.tags)
        page.tags.append(tag)
        page.parents.append(stack[-1] if stack else -1)
        page.names.append(names if not bare else set())
        page.hidden.append(hidden)
        page.hashes.append(0)
        parts.append([tag, *sorted(names), "" if bare else "*"])
        if tag in BLOCK:
            page.pieces.append((at, None))
        return at

    def close_element(at: int) -> None:
        digest = xxhash.xxh64_intdigest("\x00".join(parts[at]).encode("utf-8", "surrogatepass"))
        page.hashes[at] = _signed(digest)
        up = page.parents[at]
        if up >= 0:
            parts[up].append(format(digest, "x"))
        parts[at] = []
        if page.tags[at] in BLOCK:
            page.pieces.append((at, None))

    def add_text(text: str) -> None:
        if text:
            at = stack[-1] if stack else -1
            text = html.unescape(text)
            page.pieces.append((at, text))
            if at >= 0:
                words = " ".join(text.split())
                if words:
                    parts[at].append(words)

    position, size = 0, len(source)
    lowered: str | None = None
    while position < size:
        found = _TOKEN.search(source, position)
        if found is None:
            add_text(source[position:])
            break
        add_text(source[position:found.start()])
        position = found.end()
        closing, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if any(page.tags[i] == tag for i in reversed(stack)):
                while stack:
                    at = stack.pop()
                    close_element(at)
                    if page.tags[at] == tag:
                        break
            continue
        for depth in range(len(stack) - 1, -1, -1):
            above = page.tags[stack[depth]]
            if tag in CLOSED_BY.get(above, ()):
                while len(stack) > depth:
                    close_element(stack.pop())
                continue
            if above in SCOPE:
                break
        at = open_element(tag, attributes)
        if tag in VOID:
            if tag == "br":
                page.pieces.append((at, " "))
            close_element(at)
        elif tag in RAW:
            lowered = source.lower() if lowered is None or len(lowered) != size else lowered
            end = lowered.find(f"</{tag}", position)
            stop = size if end < 0 else end
            parts[at].append(source[position:stop])
            after = source.find(">", stop)
            position = size if end < 0 or after < 0 else after + 1
            close_element(at)
        else:
            stack.append(at)
    while stack:
        close_element(stack.pop())
    return page


def _down(page: Page, own: list[bool]) -> list[bool]:
    """True for the elements that have it or are inside of one that has."""
    out = list(own)
    for at, up in enumerate(page.parents):
        if up >= 0 and out[up]:
            out[at] = True
    return out


def _holders(page: Page, own: list[bool]) -> list[bool]:
    """True for the elements around one that has it."""
    out = [False] * len(own)
    for at in range(len(own) - 1, -1, -1):
        up = page.parents[at]
        if up >= 0 and (own[at] or out[at]):
            out[up] = True
    return out


def _judged(page: Page, by_words: bool = True) -> tuple[list[bool], list[bool], list[bool], bool]:
    """For every element: is furniture, is inside of the main part, may be a template.

    Subtrees around the main part can't be template, nor can plain prose in it. Last, whether the page has a main part; else all of it is.
    """
    tags = page.tags
    mains = [t == "article" for t in tags]
    if not any(mains):
        mains = [t == "main" or "main" in n and t != "body" for t, n in zip(tags, page.names)]
    around = _holders(page, mains)
    furniture = [
        (tag in FURNITURE or page.hidden[at] or by_words
         and bool(page.names[at] & FURNITURE_WORDS))
        and not around[at] and tag not in ("html", "body")
        and not (mains[at] and not page.names[at] & {"comment", "comments", "related", "ad"})
        for at, tag in enumerate(tags)]
    gone = _down(page, furniture)
    live = [m and not g for m, g in zip(mains, gone)]
    inside = _down(page, live) if any(live) else [True] * len(tags)
    scoped = any(live)
    template = [
        not (around[at] or mains[at] or tag in ("html", "body", "head") or tag in VOID)
        and (tag in BLOCK or tag in FURNITURE or bool(page.names[at]))
        and not (scoped and inside[at] and tag in PROSE and not page.names[at])
        for at, tag in enumerate(tags)]
    return gone, inside, template, scoped


def subtree_hashes(source: str | None, by_words: bool = True) -> tuple[int, list[int]]:
    """(what tells the page from others, hashes of the subtrees that can be template)."""
    page = parse(source or "")
    gone, inside, template, scoped = _judged(page, by_words)
    text = _text_of(page, gone, inside, scoped)
    which = _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))) \
        if text else hash_of_page(page)
    return which, list({page.hashes[at] for at in range(len(page.tags)) if template[at]})


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def hash_of_page(page: Page) -> int:
    text = "\x00".join(format(page.hashes[at], "x") for at in range(len(page.tags))
                       if page.parents[at] < 0 or page.tags[page.parents[at]] == "body")
    return _signed(xxhash.xxh64_intdigest(text))


def main_text(source: str | None, templates: set[int] = frozenset(),
              by_words: bool = True) -> str:
    return without_templates(source, templates, by_words)[0]


def without_templates(source: str | None, templates: set[int],
                      by_words: bool = True) -> tuple[str, int]:
    """(main text, how many outermost subtrees went as templates)."""
    page = parse(source or "")
    gone, inside, template, scoped = _judged(page, by_words)
    own = [template[at] and page.hashes[at] in templates for at in range(len(page.tags))]
    cut = _down(page, own)
    outermost = sum(o and not (up >= 0 and cut[up]) for o, up in zip(own, page.parents))
    return _text_of(page, [a or b for a, b in zip(gone, cut)], inside, scoped), outermost


def _text_of(page: Page, gone: list[bool], inside: list[bool], scoped: bool) -> str:
    blocks, held = [], []
    for at, text in [*page.pieces, (-1, None)]:
        if text is None:
            block = " ".join("".join(held).split())
            if block:
                blocks.append(block)
            held = []
        elif (at < 0 and not scoped) or (at >= 0 and inside[at] and not gone[at]):
            held.append(text)
    return "\n\n".join(blocks)


def host(url: Column) -> Column:
    """The lower-case host of an absolute url, empty where there is none."""
    found = F.regexp_extract(
        url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def subtrees(pages: DataFrame, url: str = "url", source: str = "html",
             by_words: bool = True) -> DataFrame:
    """(host, key, page, hashes): key is the html's hash, page tells pages apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [subtree_hashes(x.as_py(), by_words) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([w for w, _ in found], pa.int64()),
                 pa.array([h for _, h in found], pa.list_(pa.int64()))],
                names=["host", "key", "page", "hashes"])

    body = whole(F.col(source))
    return pages.select(host(F.col(url)).alias("host"), F.xxhash64(body).alias("key"),
                        body.alias("html")) \
        .mapInArrow(run, "host string, key bigint, page bigint, hashes array<bigint>")


def templates(found: DataFrame, least_pages: int = 5) -> DataFrame:
    """(host, hash, pages): subtrees on at least so many different pages of a host.

    Pages that are one are collapsed before anything is counted, and what is dealt by
    subtree are counts: a subtree on every page of a hot host is one row a task.
    """
    return found.select("host", "page", F.explode("hashes").alias("hash")) \
        .groupBy("host", "hash", "page").agg(F.lit(1).alias("one")) \
        .groupBy("host", "hash").agg(F.count(F.lit(1)).alias("pages")) \
        .filter(F.col("pages") >= least_pages)


def extract(pages: DataFrame, url: str = "url", source: str = "html", text: str = "text",
            removed: str | None = None, by_words: bool = True, least_pages: int = 5) -> DataFrame:
    """The pages with their main text in ``text``, in the place of their html.

    ``removed`` names a column for the number of subtrees that went as templates.
    """
    found = settle(subtrees(pages, url, source, by_words))
    known = settle(templates(found, least_pages))
    cut = found.select("host", "key", F.explode("hashes").alias("hash")) \
        .join(known, ["host", "hash"]) \
        .groupBy("host", "key").agg(F.collect_set("hash").alias("hashes"))
    rest = [c for c in pages.columns if c != source]
    at_host, at_key, hashes = free_name(pages, "_page_host", "_page_key", "_page_hashes")
    cut = cut.select(F.col("host").alias(at_host), F.col("key").alias(at_key),
                     F.col("hashes").alias(hashes))
    joined = pages.join(cut, (host(F.col(url)) == F.col(at_host))
                        & (F.xxhash64(whole(F.col(source))) == F.col(at_key)), "left") \
        .select(*rest, hashes, source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [without_templates(h.as_py(), set(t.as_py() or ()), by_words) for t, h in
                   zip(batch.column(len(rest)), batch.column(len(rest) + 1))]
            columns = [pa.array([t for t, _ in out], pa.string()),
                       pa.array([n for _, n in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(rest)], *columns[:len(fields) - len(rest)]], names=names)

    fields = [pages.schema[c] for c in rest] + [T.StructField(text, T.StringType())]
    if removed:
        fields.append(T.StructField(removed, T.LongType()))
    names = [f"c{i}" for i in range(len(fields))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields)])
    return joined.mapInArrow(run, schema).toDF(*[f.name for f in fields])
