"""Main text of web pages by equivalence classes of tokens (after Arasu and Garcia-Molina's template deduction).

A page is read as tokens: structural elements, told apart by the path of elements (with class and id) around them, and
text blocks, told apart by path and wording. Each token of a host has an occurrence vector over the host's pages; a
64-bit fingerprint of the vector (an exclusive or over pages of a hash of page and count) is summed map-side, so no
vector and no host is held by one task. Tokens with equal vectors form a class; a class seen on MIN_PAGES pages or more is
valid. Pages of a host with equal html count as one. Classes nest by their elements' paths. A text block in the class of the
element around it occurs exactly as that element does: it belongs to the template and not to the slot, if the element is on
MIN_PAGES pages or more with content of their own (more than half of their main text on no other page of the host), so that
an article's copies and near copies do not make a template. The remaining blocks are the slots' contents.

The main text is what the slots under article or main elements (or such class, id or role names) hold; a page without
one gives all its slots. Elements whose name, class, id or role tells of menus, headers, footers, sidebars, notices,
adverts, forms or reader comments hold no main text. If every block of a page's main slots were template, they are kept.

Blocks end at block elements and line breaks; character references are decoded, white space becomes one space, blocks are
joined by a line feed. Defined cases: a null or empty page gives ''; unclosed elements end with the element around them;
a page of a small host is read by element names alone; repeated rows each keep their row; a null url is a host of its own; extra columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common, words

MIN_PAGES = 5
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<([!?])[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
RAW = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
STRUCTURE = frozenset("html head body article main section div nav header footer aside ul ol dl table form figure blockquote details dialog fieldset menu svg select button".split())
BLOCKS = STRUCTURE | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption figcaption pre address hr br option thead tbody tfoot summary legend label".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
OUTSIDE = frozenset("head nav footer aside form menu dialog svg select button fieldset".split())
ROLE_OUT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|notices?|alert|popup|modal|sidebar|menu|nav|navbar|navigation|"
    r"breadcrumbs?|header|masthead|footer|comments?|replies|respond|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|pagination|pager|toolbar|contentinfo|complementary)(?:$|[\s_-])", re.I)
ROLE_MAIN = re.compile(r"(?:^|[\s_-])(?:article|main|article-body|entry-content|post-content|post-body|story-body|content-body)(?:$|\s)", re.I)
SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    element: int
    text: str
    out: bool
    main: bool


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts))) - (1 << 63)


def read_page(page: str) -> tuple[list[int], list[Block]]:
    """Structural elements by path, in page order, and text blocks."""
    elements: list[int] = []
    blocks: list[Block] = []
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                blocks.append(Block(stack[-1][1], text, stack[-1][2], stack[-1][3]))

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if name is None:
            continue
        name, closing, attributes = name.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
        if name in BLOCKS:
            flush()
        if name in RAW and not closing:
            stop = RAW[name].search(page, at)
            at = stop.end() if stop else end
            continue
        if name not in STRUCTURE:
            continue
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
            continue
        labels = " ".join(v.strip("\"'") for _, v in ATTRIBUTE.findall(attributes))
        _, parent, out, main = stack[-1]
        inner = name in ("article", "main") or bool(labels and ROLE_MAIN.search(labels))
        out = out or name in OUTSIDE or (name == "header" and not main) or bool(labels and not inner and ROLE_OUT.search(labels))
        token = _hash(parent, name, re.sub(r"\d+", "0", labels))
        elements.append(token)
        if not attributes.rstrip().endswith("/"):
            stack.append((name, token, out, main or inner))
    flush()
    return elements, blocks


def _text_token(b: Block) -> int:
    return _hash(b.element, "text", b.text)


def _main_blocks(blocks: list[Block]) -> list[Block]:
    inside = [b for b in blocks if not b.out]
    return [b for b in inside if b.main] or inside


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """size: twice the characters of a text in the page's main slots; a row of the page itself takes all of them off."""
    for batch in batches:
        for first, last, pages in words.row_slices(batch, "html"):
            rows = []
            for host, page_hash, page in zip(batch.column(0).slice(first, last - first).to_pylist(), batch.column(1).slice(first, last - first).to_pylist(), pages.to_pylist(), strict=True):
                elements, blocks = read_page(page)
                main = Counter()
                for b in _main_blocks(blocks):
                    main[_text_token(b), b.element] += len(b.text)
                rows += [(host, page_hash, t, None, n, 0) for t, n in Counter(elements).items()]
                rows += [(host, page_hash, t, e, n, 2 * main[t, e]) for (t, e), n in Counter((_text_token(b), b.element) for b in blocks).items()]
                rows.append((host, page_hash, _hash("page", page_hash), None, 1, -main.total()))
            if rows:
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["host", "page", "token", "element", "n", "size"])


def _page_tokens(pages: DataFrame) -> DataFrame:
    """Tokens of the distinct pages of each host. Only pages that have copies are dealt out to leave one of them."""
    rows = pages.select(_host(), F.xxhash64("html").alias("page"), "html")
    copies = common.stored(rows.groupBy("host", "page").count().filter("count > 1").select("host", "page"))
    if copies.take(1):
        table = common.checked_broadcast(copies)
        one = rows.join(table, ["host", "page"], "left_semi").dropDuplicates(["host", "page"])
        rows = rows.join(table, ["host", "page"], "left_anti").unionByName(one)
    return rows.select("host", "page", "html").mapInArrow(_tokens, "host string, page long, token long, element long, n long, size long")


def token_classes(tokens: DataFrame) -> DataFrame:
    """tokens -> host, token, element (of a text token), pages, vector, page (of a token on one page) and size: tokens with equal
    vector and pages of a host are one class."""
    return tokens.groupBy("host", "token", "element").agg(F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.max("page").alias("page"), F.sum("size").alias("size"))


def template_texts(tokens: DataFrame, classes: DataFrame) -> DataFrame:
    """host, texts: the text tokens in the class of the element around them. As many as one page's at most."""
    valid = classes.filter(F.col("pages") >= MIN_PAGES)
    elements = valid.filter("element is null").select("host", F.col("token").alias("element"), "pages", "vector")
    own = common.stored(valid.filter("element is not null").select("host", "token", "element", "pages", "vector").join(elements, ["host", "element", "pages", "vector"]).select("host", "element", "token"))
    content = common.stored(classes.filter("pages = 1").groupBy("host", "page").agg(F.sum("size").alias("size")).filter("size > 0").select("host", "page"))
    asked = common.stored(own.select("host", F.col("element").alias("token")).distinct())
    if asked.take(1):
        found = tokens.filter("element is null").select("host", "page", "token").join(common.checked_broadcast(asked), ["host", "token"])
        found = found.join(common.checked_broadcast(content), ["host", "page"], "left_semi")
        shown = found.groupBy("host", F.col("token").alias("element")).count().filter(F.col("count") >= MIN_PAGES)
        own = own.join(shown.select("host", "element"), ["host", "element"])
    return own.groupBy("host").agg(F.collect_set("token").alias("texts"))


def _host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit("")).alias("host")


def main_text(page: str, template: frozenset[int]) -> str:
    _, blocks = read_page(page)
    main = _main_blocks(blocks)
    kept = [b for b in main if _text_token(b) not in template] if template else main
    return "\n".join(b.text for b in kept or main)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last_texts: tuple[list, frozenset] = ([], frozenset())
    for batch in batches:
        for first, last, pages in words.row_slices(batch, "html"):
            part = batch.slice(first, last - first)
            out = []
            for texts, page in zip(part.column(3).to_pylist(), pages.to_pylist(), strict=True):
                if texts != last_texts[0]:
                    last_texts = (texts, frozenset(texts or ()))
                out.append(main_text(page, last_texts[1]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) -> page_id, url, text, n_chars, one row a row of pages."""
    pages = pages.select("page_id", "url", "html")
    tokens = _page_tokens(pages)
    texts = common.stored(template_texts(tokens, common.stored(token_classes(tokens))))
    rows = pages.select("page_id", "url", "html", _host())
    # html stays where it is while the templates are few; else hosts with many pages are spread
    if texts.count() <= common.BROADCAST_ROWS // 20:
        rows = rows.join(F.broadcast(texts), "host", "left")
    else:
        every = common.stored(rows.select("host").distinct()).join(texts, "host", "left")
        rows = common.fetch(rows, "host", every, ["page_id"], salts=common.SALTS)
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "html", "texts").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
