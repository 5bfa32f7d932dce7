"""Main text of web pages: templates deduced from tokens that occur alike across the pages of a host."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import written

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
SPECIAL = re.compile("[>\"']")
ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that hold a place in the page; all others (b, a, span, ...) are part of the text around them.
PLACES = {"html", "head", "body", "header", "footer", "nav", "aside", "main", "article", "section", "div", "ul", "ol", "dl", "menu", "table", "tbody",
          "thead", "tfoot", "tr", "form", "fieldset", "figure", "details", "dialog", "select", "button", "svg", "object", "template", "canvas", "video", "audio"}
BREAKS = PLACES | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "td", "th", "caption", "figcaption", "summary", "address",
                   "br", "hr", "center", "option", "legend", "label"}
#: Elements of running text whose class can tell that they are an advert, a comment or the like; the place stays that around them.
TEXTS = {"p", "li", "dt", "dd", "blockquote", "pre"}
#: An element that opens ends the one beside it that was left open; any but PHRASING ends a paragraph.
BESIDE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
PHRASING = {"br", "label", "option", "select", "button", "svg", "object", "template", "canvas", "video", "audio"}
CHROME_TAGS = {"head", "nav", "footer", "header", "aside", "menu", "form", "fieldset", "dialog", "select", "button", "svg", "object", "template", "canvas", "video", "audio"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
CHROME_NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "sponsors", "promo", "promotion",
                "nav", "navbar", "navigation", "menu", "topbar", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "foot", "sidebar", "side", "aside",
                "widget", "widgets", "related", "recommended", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay",
                "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "comment", "comments", "commentlist", "respond", "reply",
                "replies", "disqus", "pagination", "pager", "copyright", "legal", "toolbar", "search", "form", "skip"}
#: Class names with these words tell of the layout around ("content-with-sidebar"); what they name beside is not the element itself.
LAYOUT = {"has", "with", "no", "without", "wrapper", "wrap", "container", "layout", "page", "grid", "row", "col"}
CONTENT_TAGS = {"article", "main"}
CONTENT_NAMES = {"article", "content", "main", "post", "entry", "story", "body", "text"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A text that is the same in this share of a host's pages (and in so many pages at least) belongs to the template.
COMMON, PAGES = 0.5, 5
OPEN, CONTENT, CHROME = 0, 1, 2


def names(attrs: str) -> tuple[set[str], bool, str]:
    """Words of class, id and role; whether the element is hidden; the attributes that name its place."""
    out, hidden, mark = set(), False, []
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id", "role"):
            mark.append(f"{key}={value}")
            if key == "role":
                out.add(f"role:{value.lower()}")
            for one in value.split() if key != "role" else ():
                words = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", one).lower()))
                out |= words - CHROME_NAMES if words & LAYOUT else words
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            hidden = True
    return out, hidden, " ".join(mark)


def kind_of(tag: str, words: set[str], hidden: bool) -> int:
    if tag in ("html", "body"):
        return OPEN
    if hidden or words & CHROME_NAMES or any(w[5:] in CHROME_ROLES for w in words if w.startswith("role:")) or tag in CHROME_TAGS:
        return CHROME
    if tag in CONTENT_TAGS or "role:main" in words or "role:article" in words or words & CONTENT_NAMES:
        return CONTENT
    return OPEN


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closes, name, attributes) of the tags of a page in order; comments and declarations have an empty name.

    A tag ends at the first > outside quotes, or at the first > at all if its quotes never close. Quotes are
    walked once: a place outside quotes from which no tag end follows is remembered, so that pages of open
    quotes or open tags take linear time.
    """
    marks, dead, at = [m.start() for m in SPECIAL.finditer(page)], set(), 0
    last = page.rfind(">")

    def end_of(i: int) -> int:
        walked = []
        while True:
            k = bisect_left(marks, i)
            if k == len(marks) or marks[k] in dead:
                break
            walked.append(marks[k])
            if page[marks[k]] == ">":
                return marks[k] + 1
            i = page.find(page[marks[k]], marks[k] + 1) + 1
            if not i:
                break
        dead.update(walked)
        return page.find(">", start) + 1

    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4) + 3
            at = end if end > 2 else len(page)
            yield start, at, False, "", ""
            continue
        if start > last:  # no tag ends here
            at = page.find("<!--", start)
            if at < 0:
                return
            continue
        m = NAME.match(page, start)
        if m:
            at = end_of(m.end())
            yield start, at, bool(m[1]), m[2].lower(), page[m.end():at - 1]
        elif page[start + 1:start + 2] in ("!", "?"):
            at = page.find(">", start) + 1
            yield start, at, False, "", ""
        else:
            at = start + 1


def raw_end(page: str, tag: str, at: int) -> int:
    """Where the raw text of an element ends, its closing tag included."""
    m = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
    return page.find(">", m.end()) + 1 or len(page) if m else len(page)


@dataclass
class Block:
    """A run of text between breaks, the place it stands in, and how much of it is link text."""

    text: str
    place: int
    kind: int
    heading: bool
    linked: int
    slot: int  # kind of the place; that of the block is another inside a marked paragraph
    inside: bool  # in one of the given places
    title: bool  # in the header of an article


@dataclass
class Open:
    """An open element: its place (a hash of the path), the kind that holds inside, that of the place, and what holds around."""

    tag: str
    place: int
    kind: int
    slot: int
    inside: bool
    article: bool
    title: bool


def blocks_of(page: str, given: set[int] = frozenset()) -> tuple[list[Block], list[int]]:
    """Text blocks of a page in order, and the place (hash of the path of elements) of each element that opens."""
    out, places = [], []
    stack, top, held = [], Open("", number(""), OPEN, OPEN, False, False, False), Counter()
    buf, linked, heading, in_link, at, skip = [], 0, False, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(buf)).split())
        if text:
            o = stack[-1] if stack else top
            out.append(Block(text, o.place, o.kind, heading, linked, o.slot, o.inside, o.title))
        buf.clear()
        linked = 0

    def pop() -> str:
        tag = stack.pop().tag
        held[tag] -= 1
        return tag

    def push(o: Open) -> None:
        stack.append(o)
        held[o.tag] += 1

    for start, end, close, tag, attrs in tags(page):
        if start < skip:
            continue
        data = page[at:start]
        buf.append(data)
        linked += len(data) if in_link else 0
        at = end
        if not tag:
            continue
        if tag in RAW:
            if not close and not attrs.endswith("/"):
                at = skip = raw_end(page, tag, at)
            continue
        if tag == "a":
            in_link = 0 if close else 1
        if tag in BREAKS:
            flush()
            in_link = 0 if tag in PLACES else in_link
            heading = tag in HEADINGS and not close
            if not close and tag not in PHRASING:
                if stack and stack[-1].tag == "p":
                    pop()
                if stack and stack[-1].tag in BESIDE.get(tag, ()):
                    pop()
        above = stack[-1] if stack else top
        if tag in TEXTS:
            if close:
                if held[tag]:
                    k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag or stack[k].tag in PLACES), -1)
                    for _ in range(len(stack) - k if k >= 0 and stack[k].tag == tag else 0):
                        pop()
            elif not attrs.endswith("/"):
                kind = CHROME if attrs.strip() and kind_of(tag, *names(attrs)[:2]) == CHROME else above.kind
                push(Open(tag, above.place, kind, above.slot, above.inside, above.article, above.title))
        if tag not in PLACES:
            continue
        if close:
            if held[tag]:
                while pop() != tag:
                    pass
        elif tag not in VOID and not attrs.endswith("/"):
            words, hidden, mark = names(attrs)
            kind, place = kind_of(tag, words, hidden), number(f"{above.place}/{tag}{'[' + mark + ']' if mark else ''}")
            if above.kind == CHROME or (tag == "header" and above.kind == CONTENT):
                kind = CHROME
            kind = kind if kind != OPEN else above.kind
            push(Open(tag, place, kind, kind, above.inside or place in given, above.article or tag == "article", tag == "header" and above.article))
            places.append(place)
    data = page[at:]
    buf.append(data)
    linked += len(data) if in_link else 0
    flush()
    return out, places


def number(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def block_token(b: Block) -> int:
    return number(f"{b.place}\n{b.text}")


def tokens(host: str, page: str) -> list[tuple]:
    """(token, is text, times, chars, linked, kind) of one page: places of elements and whole text blocks."""
    blocks, places = blocks_of(page)
    seen: dict[tuple[int, bool], list] = {}
    for p in places:
        seen.setdefault((p, False), [0, 0, 0, OPEN])[0] += 1
    for b in blocks:
        if (b.place, False) in seen and b.kind == b.slot:
            s = seen[(b.place, False)]
            s[1:] = s[1] + len(b.text), s[2] + b.linked, b.kind
        seen.setdefault((block_token(b), True), [0, 0, 0, b.kind])[0] += 1
    return [(t, text, *s) for (t, text), s in seen.items()]


def templates(pages: DataFrame, host: str, html: str, key: str) -> DataFrame:
    """(host, common_texts, main_places): what the template of each host holds.

    Tokens of a host's pages (element places, whole text blocks) are grouped by their occurrence vector: a hash
    combined over (page, number of times), so a vector of any length is one number and combines before the
    shuffle. Tokens with one vector are an equivalence class. A class is valid if it occurs in COMMON of the
    host's pages. Its places nest by their paths and make the template; its texts are fixed text, inside marked content too. Of the slots
    that remain (places of the template, with what varies in them), those of menus and the like are chrome;
    main_places are the slots marked as content, and all unmarked ones with less than half of their text in links
    where these hold more text over the host's pages than the marked ones do.
    """
    schema = "host string, page long, token long, is_text boolean, times int, chars long, linked long, kind int"
    rows = pages.select(F.col(host).alias("host"), F.col(key).alias("page"), F.col(html).alias("html"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_ = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        for b in batches:
            for s in range(0, b.num_rows, 64):
                part = b.slice(s, 64).to_pylist()
                got = [(r["host"], r["page"], *t) for r in part for t in tokens(r["host"], r["html"] or "")]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds, strict=True)], names_)

    seen = rows.mapInArrow(cut, schema).groupBy("host", "token", "is_text").agg(
        F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page", "times")).alias("vector"), F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"), F.max("kind").alias("kind"))
    seen = written(seen.where((F.col("pages") > 1) | ~F.col("is_text")))
    total = rows.groupBy("host").agg(F.count("*").alias("all"))
    classes = seen.groupBy("host", "pages", "vector").agg(F.count("*").alias("size"))
    valid = classes.join(total, "host").where((F.col("pages") >= COMMON * F.col("all")) & ((F.col("size") > 1) | (F.col("pages") == F.col("all")) | (F.col("pages") >= PAGES)))
    held = seen.join(valid, ["host", "pages", "vector"])
    fixed = F.collect_set(F.when(F.col("is_text") & (F.col("pages") >= PAGES), F.col("token"))).alias("common_texts")
    slots = F.collect_list(F.when(~F.col("is_text"), F.struct("token", "chars", "linked", "kind"))).alias("slots")
    made = held.groupBy("host").agg(fixed, slots)
    content = F.filter("slots", lambda s: s["kind"] == CONTENT)
    plain = F.filter("slots", lambda s: (s["kind"] == OPEN) & (s["chars"] > 0) & (2 * s["linked"] < s["chars"]))
    chars = lambda slots: F.aggregate(slots, F.lit(0).cast("long"), lambda a, s: a + s["chars"])
    main = F.when(chars(content) >= chars(plain), content).otherwise(F.concat(content, plain))
    return made.select("host", "common_texts", F.transform(main, lambda s: s["token"]).alias("main_places"))


def main_text(page: str | None, common: set[int], main: set[int]) -> str:
    """The blocks of the main slots without fixed text, one a line: marked content, and unmarked blocks in slots
    that the template names as main. Without any, all that isn't chrome. A page with nothing but fixed text is a
    copy of others and keeps it."""
    blocks, _ = blocks_of(page or "", main)
    marked = any(b.kind == CONTENT for b in blocks)
    slots = [b for b in blocks if b.kind == CONTENT or (b.kind == OPEN and b.inside) or (marked and b.kind == CHROME and b.heading and b.title)]
    rest = [b for b in blocks if b.kind == OPEN]
    for part in (slots, slots if marked else [], rest):
        kept = [b for b in part if block_token(b) not in common]
        if kept:
            return "\n".join(b.text for b in kept)
        if marked and part:
            return "\n".join(b.text for b in part)
    return "\n".join(b.text for b in rest)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page: its main text by the template of its host.

    Null html is an empty page with empty text; a null or malformed URL belongs to the host "". Pages are parsed
    whole whatever their length; unclosed and misnested tags end with the element around them. Repeated rows
    come out alike, an empty table gives no rows, other columns are not read. A host's pages are never gathered:
    occurrence vectors are hashes, and the template is joined to the pages.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), F.col(html_col).cast("string").alias("html"))
    after = F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1)
    rows = rows.withColumn("host", F.lower(after)).withColumn("page", F.xxhash64("id", "url", "html"))
    found = written(templates(rows, "host", "html", "page")).withColumnRenamed("host", "h")
    both = rows.join(found, rows["host"] == found["h"], "left").select("id", "url", "html", "common_texts", "main_places")
    schema = T.StructType([*both.schema.fields[:2], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                b = batch.slice(s, 64)
                texts = [main_text(r["html"], set(r["common_texts"] or ()), set(r["main_places"] or ())) for r in b.to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    return both.mapInArrow(run, schema)
