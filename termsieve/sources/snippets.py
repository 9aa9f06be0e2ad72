"""The markup of the element that a segment came from, by the places that extraction gives."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from .html import VOID, _optional_end

MOST_CHARS = 1500
_STEP = re.compile(r'(?:#(?P<id>.+))|(?P<tag>[a-z][a-z0-9-]*)(?:\[(?P<name>[a-z-]+)="(?P<value>[^"]*)"\])?(?::nth-of-type\((?P<n>\d+)\))?')


class _Finder(HTMLParser):
    """Places of elements: what opens and closes where, with parents and numbers among their like."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=False)
        self.html, self.lines = html, [0]
        for m in re.finditer("\n", html):
            self.lines.append(m.end())
        self.all: list[dict] = []
        self.open: list[dict] = [{"counts": {}, "tag": "", "parent": None}]
        self.feed(html)
        self.close()
        for e in self.open[1:]:
            e["end"] = len(html)

    def here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        while len(self.open) > 1 and self.open[-1]["tag"] in _optional_end.get(tag, ()):
            self.open.pop()["end"] = self.here()
        up = self.open[-1]
        n = up["counts"][tag] = up["counts"].get(tag, 0) + 1
        start = self.here()
        e = {"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "n": n, "parent": up, "counts": {}, "start": start, "inner": start + len(self.get_starttag_text()), "end": start + len(self.get_starttag_text())}
        self.all.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for e in reversed(self.open[1:]):
            if e["tag"] == tag:
                at = self.here()
                while self.open[-1] is not e:
                    self.open.pop()["end"] = at
                self.open.pop()
                e["end"] = self.html.find(">", at) + 1 or len(self.html)
                return


def _fits(e: dict, step: str) -> bool:
    m = _STEP.fullmatch(step)
    if not m:
        return False
    if m["id"]:
        return e["attrs"].get("id") == m["id"]
    return e["tag"] == m["tag"] and (not m["name"] or e["attrs"].get(m["name"], "").lower() == m["value"].lower()) and (not m["n"] or e["n"] == int(m["n"]))


JSON_LD = 'script[type="application/ld+json"]'


def _indented(raw: str) -> str:
    """JSON in lines; what is not JSON as it is."""
    try:
        return json.dumps(json.loads(raw), ensure_ascii=False, indent=2)
    except ValueError:
        return raw


def _element(found: _Finder, selector: str) -> dict | None:
    """The first element that a chain of steps leads to, parent by parent."""
    steps = selector.split(" > ")
    for e in found.all:
        at, left = e, len(steps)
        while left and at is not None and at["tag"] and _fits(at, steps[left - 1]):
            at, left = at["parent"], left - 1
        if not left:
            return e
    return None


def snippet(html: str, selector: str | None, source: str = "text", most: int = MOST_CHARS) -> str | None:
    """The element's markup as written, at most so many characters; null where there is none.

    Linked data is counted among its own kind on the page, and its content is given in lines.
    """
    if not selector or not html:
        return None
    found = _Finder(html)
    if source != "json_ld":
        e = _element(found, selector)
        return None if e is None else html[e["start"] : e["end"]][:most]
    step = _STEP.fullmatch(selector.rpartition(" > ")[2])
    nth = int(step["n"]) if step and step["n"] else 1
    e = next(islice((e for e in found.all if _fits(e, JSON_LD)), nth - 1, nth), None)
    if e is None:
        return None
    content = html[e["inner"] : e["end"]]
    return _indented(content[: content.rfind("</")])[:most]


def with_snippets(rows: DataFrame, html: str = "html", selector: str = "selector", source: str = "text_source") -> DataFrame:
    """Rows with `snippet` in place of the page's markup."""
    kept = [c for c in rows.columns if c != html]

    def run(batches):
        for b in batches:
            got = [snippet(h or "", s, k or "text") for h, s, k in zip(b.column(html).to_pylist(), b.column(selector).to_pylist(), b.column(source).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(got, pa.string())], [*kept, "snippet"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name != html)
    return rows.mapInArrow(run, fields + "snippet string")
