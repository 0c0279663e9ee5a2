"""Main text of web pages by site template removal.

Every page is read once into blocks of text, each with the hashes of the
container elements around it. A hash covers the element's tag and the tags and
texts below it. Spark counts each hash per host over pages of different
content (copies of one page count once); a subtree found on at least
``least_pages`` such pages, however large the host, is a site template and its
blocks go. Beside that, elements that are never main text by their tag,
role, class or id go at once. If a page marks its article (``article``,
``main``, role main), only what is inside counts, and there only containers
(not paragraphs or headings themselves) can be templates, so a sentence that
several articles share stays.

Edge cases: null and empty html give an empty text; unclosed and stray tags
follow the usual implied ends; pages without a host share the host ''; repeated
pages are extracted alike.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, field_ddl, slices, small_batches

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
UNQUOTED = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
# Fixed values of HTML: elements without end, with raw text, inside a line, and those never holding main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby s samp small span strike strong sub sup time tt u var wbr img math object canvas".split())
NEVER = frozenset("nav header footer aside form button select dialog menu head".split())
IMPLIED = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th tr html body article main figcaption caption".split())
# Class and id names of boilerplate anywhere, and those that are so only outside the page's main part.
MARKED = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|sponsor(?:ed)?|sidebars?|side-bar|nav(?:bar|igation)?|menus?|breadcrumbs?|footer|cookies?|consent|gdpr|notices?|alerts?|popup|modal|newsletter|subscribe|signup|login|comments?|replies|disqus)(?:$|[\s_-])"
)
OUTSIDE = re.compile(r"(?i)(?:^|[\s_-])(?:banners?|promo(?:tion)?s?|header|masthead|respond|share|sharing|social|related|recommended|pagination|pager|toolbar|widgets?|skip-link|copyright|legal)(?:$|[\s_-])")
ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())


def _tags(page: str) -> Iterator[re.Match]:
    """All comments and tags in turn. After a tag whose quotes never end, quotes mean nothing, so every part is read once."""
    pattern, at, last = TAG, page.find("<"), page.rfind(">")
    while at >= 0 and (at < last or page.startswith("<!--", at)):
        m = pattern.match(page, at)
        if m is None and pattern is TAG and re.match("/?[a-zA-Z]", page[at + 1 : at + 3]):
            pattern = UNQUOTED
            m = pattern.match(page, at)
        if m is None:
            at = page.find("<", at + 1)
            continue
        yield m
        at = page.find("<", m.end())


def _marks(attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether the element is boilerplate by its attributes (``inside`` the main part or not), and whether it is the page's main part."""
    drop = main = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            drop = drop or bool(MARKED.search(value)) or not inside and bool(OUTSIDE.search(value))
        elif name == "role":
            drop, main = drop or value.lower() in ROLES, main or value.lower() == "main"
        elif name == "hidden":
            drop = True
        elif name == "aria-hidden":
            drop = drop or value.lower() == "true"
        else:
            drop = drop or bool(re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value))
    return drop, main


def blocks_of(page: str) -> tuple[list[tuple[str, list[int]]], list[int], int]:
    """Blocks (text, hashes of the containers around it), all container hashes, and the content's hash."""
    stack: list[list] = []  # [tag, drop, main, inherited drop, inherited main, parts, first block]
    blocks: list[list] = []  # [text, in main, containers (indices into hashes)]
    hashes: list[int] = []
    piece: list[str] = []
    any_main = False

    def flush() -> None:
        if piece:
            raw = "".join(piece)
            piece.clear()
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                top = stack[-1] if stack else None
                if top:
                    top[5].append(text)
                if not (top and top[3]):
                    blocks.append([text, bool(top and top[4]), []])

    def close() -> None:
        tag, _, _, dropped, _, parts, first = stack.pop()
        value = hash_of(tag, parts)
        if stack:
            stack[-1][5].append(value)
        if tag not in TEXTUAL and parts:
            hashes.append(value)
            if not dropped:
                for b in blocks[first:]:
                    b[2].append(value)

    at = 0
    for m in _tags(page):
        if m.start() < at:
            continue
        if m.start() > at:
            piece.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in RAW and not m[1]:
            end = re.compile(rf"(?i)</{re.escape(tag)}\s*>").search(page, at)
            at = end.end() if end else len(page)
            if tag not in INLINE:
                flush()
            continue
        if tag in INLINE:
            continue
        if tag == "br":
            piece.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                while len(stack) > depth:
                    close()
            continue
        ends = IMPLIED.get(tag)
        if ends is None and stack and stack[-1][0] == "p":
            ends = ("p",)
        while ends and stack and stack[-1][0] in ends:
            close()
        up_drop, up_main = (stack[-1][3], stack[-1][4]) if stack else (False, False)
        drop, main = _marks(m[3], up_main) if m[3] else (False, False)
        drop = (drop and tag not in ("html", "body", "article", "main")) or tag in NEVER and not (tag == "header" and up_main)
        main = main or tag in ("article", "main")
        any_main = any_main or (main and not up_drop)
        stack.append([tag, drop, main, up_drop or drop, up_main or main, [], len(blocks)])
    if at < len(page):
        piece.append(page[at:])
    flush()
    while stack:
        close()
    kept = [(text, path) for text, inside, path in blocks if inside or not any_main]
    return kept, sorted(set(hashes)), hash_of("", [t for t, _ in kept])


def hash_of(tag: str, parts: list) -> int:
    """A 64-bit hash of a tag and the texts and child hashes below it."""
    import xxhash

    return xxhash.xxh64_intdigest("\x00".join([tag, *map(str, parts)]), 7) - (1 << 63)


def _parse(keep: tuple[str, ...]):
    block = pa.struct([("text", pa.string()), ("path", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            blocks, hashes, prints = [], [], []
            for page in batch.column("html").to_pylist():
                b, h, p = blocks_of(page or "")
                blocks.append([{"text": t, "path": path} for t, path in b]), hashes.append(h), prints.append(p)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*keep, "host", "uid")), pa.array(blocks, pa.list_(block)), pa.array(hashes, pa.list_(pa.int64())), pa.array(np.array(prints, np.int64))], [*keep, "host", "uid", "blocks", "hashes", "content"])

    return run


def extract(pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ("page_id", "url"), least_pages: int = 5) -> DataFrame:
    """``keep`` columns plus ``text`` (blocks joined by newlines) and ``n_chars`` of every page."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = small_batches(pages).select(*keep, F.col(html).alias("html"), host.alias("host"), F.xxhash64(F.col(html), F.col(url), *keep).alias("uid"))
    ddl = f"{field_ddl(pages, *keep)}, host string, uid bigint, blocks array<struct<text:string,path:array<bigint>>>, hashes array<bigint>, content bigint"
    parsed = cut(rows.mapInArrow(_parse(keep), ddl), "pages")
    distinct = parsed.groupBy("host", "content").agg(F.first("hashes").alias("hashes"))
    seen = distinct.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n"))
    templates = seen.where(F.col("n") >= least_pages).select("host", "hash")
    own = parsed.select("host", "uid", F.explode(F.array_distinct(F.flatten("blocks.path"))).alias("hash")).distinct()
    gone = own.join(templates, ["host", "hash"]).groupBy("uid").agg(F.collect_set("hash").alias("gone"))  # a page's own subtrees at most
    # Pages without a removable container keep all blocks; their texts stay out of the join's shuffle.
    bare = F.size(F.flatten("blocks.path")) == 0
    columns = [*keep, "uid", "blocks"]
    joined = parsed.where(~bare).select(*columns).join(gone, "uid", "left").select(*columns, "gone")
    out = joined.unionByName(parsed.where(bare).select(*columns, F.lit(None).cast("array<bigint>").alias("gone")))
    left = F.filter("blocks", lambda b: F.col("gone").isNull() | ~F.coalesce(F.arrays_overlap(b["path"], F.col("gone")), F.lit(False)))
    text = F.array_join(F.transform(left, lambda b: b["text"]), "\n")
    return out.select(*keep, text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
