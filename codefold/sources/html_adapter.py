"""HTML: inline scripts as script text on their own lines, and calls in event attributes."""

from __future__ import annotations

import re

from codefold.sources import lexical_adapter

_SCRIPT = re.compile(r"<script\b(?P<attrs>[^>]*)>(?P<code>.*?)</script\s*>", re.S | re.I)
_HANDLER = re.compile(r"""\bon[a-z]+\s*=\s*(?:"([^"]*)"|'([^']*)')""", re.I)
_TYPE = re.compile(r"""\btype\s*=\s*["']?([^"'\s>]+)""", re.I)
_SRC = re.compile(r"""\bsrc\s*=\s*["']?([^"'\s>]+)""", re.I)
HREF = re.compile(r"""<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']""", re.I)


def script_text(html: str) -> str:
    """The page with all but its inline scripts blank; lines and columns stay."""
    out, last = [], 0
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    for m in _SCRIPT.finditer(html):
        kind = _TYPE.search(m["attrs"])
        if kind and not re.search("javascript|module|babel|jsx", kind[1], re.I):
            continue
        out += [blank(html[last : m.start("code")]), m["code"]]
        last = m.end("code")
    return "".join([*out, blank(html[last:])])


def extract(html: str) -> dict:
    facts = lexical_adapter.extract(script_text(html), "javascript")
    for m in _HANDLER.finditer(html):
        own = lexical_adapter.extract(m[1] or m[2] or "", "javascript")
        line = html.count("\n", 0, m.start()) + 1
        facts["calls"] += [c | {"line": line, "seq": 100_000 + m.start()} for c in own["calls"]]
    for m in _SCRIPT.finditer(html):
        if source := _SRC.search(m["attrs"]):
            facts["imports"].append({"module": source[1], "names": [], "aliases": [], "type": "script", "line": html.count("\n", 0, m.start()) + 1, "dynamic": False})
    return facts
