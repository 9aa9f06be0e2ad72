"""Typed text segments, links and resources from static HTML.

A streaming parser keeps the open elements; text goes to the nearest element that is not inline, once
for visible and once for hidden text. Visibility is what attributes decide (hidden, inline
display/visibility/opacity, aria-hidden is not one); there is no layout, so boxes are null and nothing
from style sheets is known.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.web import FILE_KINDS

# Tags, attributes and caps of the extraction model.
SKIPPED = frozenset(("script", "style", "noscript", "template", "iframe", "object", "embed"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "map", "mark", "output", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tspan", "tt", "u", "var", "wbr"))
TEXT_ATTRIBUTES = ("alt", "title", "aria-label", "aria-description", "placeholder")
META_SKIPPED = re.compile("viewport|charset|robots|verification|theme-color|format-detection|csrf")
MOST_SEGMENTS, MOST_CHARS = 20_000, 5_000
SOURCES = (("svg_text", "svg"), ("heading", "h1 h2 h3 h4 h5 h6"), ("button", "button"), ("link", "a"), ("form_label", "label legend"), ("form_option", "option select"))

_kinds = [(k, re.compile(p, re.I)) for k, p in FILE_KINDS.items()]
_hiding = re.compile(r"display\s*:\s*none|visibility\s*:\s*(hidden|collapse)|opacity\s*:\s*0(\.0*)?\s*(;|$)", re.I)
_bare_url = re.compile(r"https?://")
_optional_end = {"li": {"li"}, "p": {"p"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


def clean(text: str) -> str:
    return " ".join(text.split())[:MOST_CHARS]


def kind_of(url: str) -> str | None:
    p = urlsplit(url).path
    return next((k for k, pattern in _kinds if pattern.search(p)), None)


#: How a rendered text's case differs from the markup's, where an inline style says so.
_transform = re.compile(r"text-transform\s*:\s*(uppercase|lowercase|capitalize|none)\b", re.I)


@dataclass
class Element:
    tag: str
    attrs: dict
    place: str
    hidden: bool
    counts: dict = field(default_factory=dict)
    text: dict = field(default_factory=dict)
    gap: bool = False
    order: int = -1
    source: str = "text"
    transform: str | None = None


@dataclass
class Page:
    title: str | None = None
    language: str | None = None
    segments: list = field(default_factory=list)
    links: dict = field(default_factory=dict)
    resources: dict = field(default_factory=dict)


class Extractor(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.base, self.page = url, url, Page()
        self.open = [Element("", {}, "", False)]
        self.blocks: list[Element] = []
        self.later: list[tuple] = []  # attributes and form values come after the running text
        self.skip: list[str] = []  # open skipped elements
        self.raw: list[str] = []
        self.heading: list[str] | None = None  # the title's text
        self.anchors: list[tuple[str, list[str]]] = []
        self.scripts: list[str] = []

    # --- structure

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if self.skip:
            if self.skip[-1] in ("iframe", "object") and tag == self.skip[-1]:
                self.skip.append(tag)
            return
        while len(self.open) > 1 and self.open[-1].tag in _optional_end.get(tag, ()):
            self.shut(self.open[-1])
        up = self.open[-1]
        n = up.counts[tag] = up.counts.get(tag, 0) + 1
        place = f"#{a['id']}" if a.get("id") else tag if tag in ("html", "body") else f"{up.place} > {tag}:nth-of-type({n})".lstrip(" >")
        hidden = up.hidden or "hidden" in a or bool(_hiding.search(a.get("style", "")))
        e = Element(tag, a, place, hidden, transform=up.transform)
        if said := _transform.search(a.get("style", "")):
            e.transform = None if said[1].lower() == "none" else said[1].lower()
        if tag == "html":
            self.page.language = a.get("lang") or None
        elif tag == "base" and a.get("href"):
            self.base = urljoin(self.url, a["href"])
        if tag in ("br", "hr") or tag not in INLINE:
            self.block().gap = True
        self.values(e)
        if tag in SKIPPED:
            if tag not in VOID:
                self.skip, self.raw = [tag], []
                self.skipped = e
            return
        if tag == "title" and not self.within("svg"):
            self.heading = []
        if tag in ("a", "area") and a.get("href"):
            self.anchor(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
                if not self.skip:
                    self.skipped_end(tag, "".join(self.raw))
            return
        for e in reversed(self.open[1:]):
            if e.tag == tag:
                while self.open[-1] is not e:
                    self.shut(self.open[-1])
                self.shut(e)
                return

    def shut(self, e: Element) -> None:
        self.open.pop()
        if e.tag == "title" and self.heading is not None:
            text = clean("".join(self.heading))
            self.page.title = self.page.title or text or None
            self.heading = None
        elif e.tag == "a" and self.anchors and e.attrs.get("href"):
            url, parts = self.anchors.pop()
            if url and not self.page.links.get(url):
                self.page.links[url] = clean("".join(parts))

    def handle_data(self, data):
        if self.skip:
            self.raw.append(data)
            return
        for _, parts in self.anchors:
            parts.append(data)
        if self.heading is not None:
            self.heading.append(data)
            return
        if self.within("head") and not self.within("body"):
            return
        block = self.block()
        where = block.text.setdefault("hidden" if self.open[-1].hidden else "visible", [])
        if data.strip():
            if block.order < 0:
                block.order, block.source = len(self.blocks), self.source()
                self.blocks.append(block)
            if block.gap and where:
                where.append(" ")
            block.gap = False
            where.append(data)
        elif where:
            where.append(" ")

    def within(self, *tags) -> bool:
        return any(e.tag in tags for e in self.open)

    def block(self) -> Element:
        return next((e for e in reversed(self.open) if e.tag not in INLINE), self.open[0])

    # --- what elements say besides running text

    def say(self, text, source, visibility, place, **more):
        if text := clean(text):
            self.later.append((text, source, visibility, place, more))

    def values(self, e: Element) -> None:
        a, tag = e.attrs, e.tag
        if tag not in ("script", "style", "template"):
            for name in TEXT_ATTRIBUTES:
                self.say(a.get(name, ""), f"attr:{name}", "metadata", e.place, attribute=name)
        if tag == "input":
            kind = a.get("type", "text").lower()
            if kind == "hidden":
                self.say(a.get("value", ""), "hidden_input", "hidden", e.place)
            elif kind in ("submit", "button", "reset"):
                self.say(a.get("value", ""), "button", "hidden" if e.hidden else "visible", e.place)
            elif kind == "image":
                self.resource(a.get("src"), "image", e)
        elif tag == "meta":
            key = (a.get("name") or a.get("property") or a.get("itemprop") or "").lower()
            value = a.get("content", "").strip()
            if key and not META_SKIPPED.search(key) and not _bare_url.match(value):
                self.say(value, f"meta:{key}", "metadata", f'meta[{next(n for n in ("name", "property", "itemprop") if a.get(n))}="{key}"]')
        elif tag == "img":
            self.resource(a.get("src"), "image", e)
        elif tag == "source":
            up = self.open[-1].tag
            self.resource(a.get("src") or (a.get("srcset", "").split() or [""])[0], up if up in ("video", "audio") else "image", e)
        elif tag in ("video", "audio"):
            self.resource(a.get("src"), tag, e)
        elif tag == "track":
            self.resource(a.get("src"), "subtitle", e)
        elif tag == "iframe":
            self.resource(a.get("src"), "frame", e)
        elif tag in ("embed", "object"):
            self.resource(a.get("src") or a.get("data"), None, e)
        for m in re.finditer(r"""url\(["']?([^"')]+)["']?\)""", a.get("style", "")):
            if not m[1].startswith("data:"):
                self.resource(m[1], "image", e, "css-background")

    def absolute(self, value: str | None) -> str | None:
        try:
            url = urljoin(self.base, (value or "").strip()) if value else None
            return url if url and urlsplit(url).scheme in ("http", "https") else None
        except ValueError:
            return None

    def resource(self, value, kind, e: Element, tag=None) -> None:
        url = self.absolute(value)
        if url:
            self.page.resources.setdefault(url, (kind or kind_of(url) or "other", tag or e.tag, not e.hidden and e.tag != "track"))

    def anchor(self, e: Element) -> None:
        url = self.absolute(e.attrs["href"])
        if url and kind_of(url):
            self.resource(url, kind_of(url), e)
            url = None
        url = url.split("#")[0] if url else None
        if url:
            self.page.links.setdefault(url, "")
        if e.tag == "a":
            self.anchors.append((url, []))

    def skipped_end(self, tag: str, raw: str) -> None:
        if tag == "script" and self.skipped.attrs.get("type") == "application/ld+json":
            self.scripts.append(raw)
        elif tag == "noscript":
            self.say(re.sub(r"<[^>]*>", " ", raw), "noscript", "hidden", self.skipped.place)

    # --- result

    def source(self) -> str:
        """What the innermost open block is part of."""
        chain = self.open[: max(i for i, e in enumerate(self.open) if e.tag not in INLINE) + 1]
        tags = {e.tag for e in chain} | {"button" for e in chain if e.attrs.get("role") == "button"}
        return next((name for name, some in SOURCES if tags & set(some.split())), "text")

    def finish(self, most: int | None) -> Page:
        while len(self.open) > 1:
            self.shut(self.open[-1])
        p = self.page
        for b in self.blocks:
            for visibility in ("visible", "hidden"):
                if text := clean("".join(b.text.get(visibility, ()))):
                    p.segments.append((text, b.source, visibility, b.place, {"transform": b.transform}))
        p.segments += self.later
        if p.title:
            p.segments.append((p.title[:MOST_CHARS], "title", "metadata", "head > title", {}))
        for i, raw in enumerate(self.scripts, 1):
            try:
                for path, text in json_strings(json.loads(raw)):
                    p.segments.append((clean(text), "json_ld", "metadata", f'script[type="application/ld+json"]:nth-of-type({i})', {"path": path}))
            except ValueError:
                continue
        p.segments = p.segments[:most]
        return p


def json_strings(value, path: str = ""):
    """(path, text) of the strings of a JSON-LD value, without types, ids, contexts and bare URLs."""
    if isinstance(value, str):
        if value.strip() and not _bare_url.match(value.strip()):
            yield path, value
    elif isinstance(value, list):
        for i, item in enumerate(value):
            yield from json_strings(item, f"{path}[{i}]")
    elif isinstance(value, dict):
        for key, item in value.items():
            if key not in ("@context", "@type", "@id"):
                yield from json_strings(item, f"{path}.{key}" if path else key)


def extract(html: str, url: str = "", most: int | None = MOST_SEGMENTS) -> Page:
    x = Extractor(url)
    x.feed(html)
    HTMLParser.close(x)
    return x.finish(most)


SEGMENTS = "text string, text_source string, visibility string, selector string, attribute string, path string, transform string"


def page_segments(pages: DataFrame, html: str = "html", url: str = "url", most: int | None = MOST_SEGMENTS) -> DataFrame:
    """One row per segment: the page's other columns, its place in the page, and the segment. most: segments of a page; None: all."""
    kept = [c for c in pages.columns if c != html]

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, (markup, address) in enumerate(zip(batch.column(html).to_pylist(), batch.column(url).to_pylist())):
                for k, (text, source, visibility, place, more) in enumerate(extract(markup or "", address or "", most).segments):
                    at.append(i)
                    rows.append((k, text, source, visibility, place, more.get("attribute"), more.get("path"), more.get("transform")))
            if at:
                columns = [batch.column(c).take(pa.array(at, pa.int32())) for c in kept]
                kinds = (pa.int32(), *(pa.string(),) * 7)
                yield pa.RecordBatch.from_arrays(columns + [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*kept, "pos", *(x.split()[0] for x in SEGMENTS.split(", "))])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != html)
    return pages.select(*[F.col(c) for c in [*kept, html]]).mapInArrow(run, f"{fields}, pos int, {SEGMENTS}")
