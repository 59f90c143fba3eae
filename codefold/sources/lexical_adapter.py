"""Facts of brace languages: no grammar, but tokens, matching brackets and scopes.

Declarations, calls and variables come from a reader for each family of
languages; modules from patterns over text whose comments, or comments and
strings, are blank.
"""

from __future__ import annotations

import re

from codefold.sources.braces import KEYWORDS
from codefold.sources.declarations import READERS
from codefold.sources.lexer import GROUP

_ID = r"[A-Za-z_$][\w$]*"


def _line(starts: list[int], at: int) -> int:
    from bisect import bisect_right

    return bisect_right(starts, at)


def split_top(text: str) -> list[str]:
    """Parts between commas outside brackets."""
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth <= 0:
            out.append(part)
            part = ""
        else:
            part += c
    return [p.strip() for p in [*out, part] if p.strip()]


def extract(text: str, language: str) -> dict:
    """Facts of one file."""
    group = GROUP.get(language, language)
    reader = READERS[group](text, language)
    found = reader.facts()
    code, plain, starts = reader.t.blanked(strings=True), reader.t.blanked(strings=False), reader.t.lines
    imports, exports = _modules(plain, code, starts, group, language)
    named = {e["name"] for e in exports if e["source"] is None} | {e["alias"] for e in exports if e["source"] is None and e["alias"]}
    for s in found["symbols"]:
        if group == "javascript" and s["owner"] is None and s["name"] in named:
            s["is_exported"] = True
    alias = {a: n for i in imports for n, a in zip(i["names"], i["aliases"]) if a}
    for c in found["calls"]:
        if not c["is_method"] and c["name"] in alias and not c["local_shadow"]:
            c["resolved_names"] = [alias[c["name"]]]
    usages = found["usages"] + [{"line": i["line"], "col": 0, "name": n, "usage_type": "import", "receiver": None} for i in imports for n in i["names"]]
    taken = {(u["line"], u["name"]) for u in usages}
    for kind, name, start, line in zip(reader.kind, reader.text, reader.t.start, reader.line):
        if kind == "id" and (line, name) not in taken and name not in KEYWORDS[group]:
            taken.add((line, name))
            usages.append({"line": line, "col": start - starts[line - 1], "name": name, "usage_type": "reference", "receiver": None})
    return {"symbols": found["symbols"], "calls": found["calls"], "usages": usages, "imports": imports, "exports": exports}


def _modules(plain: str, code: str, starts: list[int], group: str, language: str) -> tuple[list, list]:
    imports, exports = [], []

    def add(module, names, kind, at, aliases=None, dynamic=False):
        imports.append({"module": module, "names": names, "aliases": aliases or [""] * len(names), "type": kind, "line": _line(starts, at), "dynamic": dynamic})

    def listed(text):
        pairs = [re.split(r"\s+as\s+|\s*:\s*", p) for p in split_top(text.replace("type ", ""))]
        return [p[0] for p in pairs], [p[1] if len(p) > 1 else "" for p in pairs]

    if group == "javascript":
        for m in re.finditer(r"import\s+(?:type\s+)?(?:(?P<d>[\w$]+)\s*,?\s*)?(?:\{(?P<n>[^}]*)\}|\*\s+as\s+(?P<s>[\w$]+))?\s*(?:from\s*)?[\"'](?P<m>[^\"'\n]+)[\"']", plain):
            names, aliases = listed(m["n"] or "")
            add(m["m"], names + [x for x in (m["d"], m["s"]) if x], "import", m.start(), aliases + [""] * sum(bool(x) for x in (m["d"], m["s"])))
        for m in re.finditer(r"(?:(?:const|let|var)\s+(?:\{(?P<n>[^}]*)\}|(?P<d>[\w$]+))\s*=\s*)?(?P<f>require|import)\s*\(\s*(?:[\"'](?P<m>[^\"'\n]+)[\"'])?", plain):
            names, aliases = listed(m["n"] or "")
            add(m["m"] or "", names + [x for x in (m["d"],) if x], m["f"], m.start(), aliases + [""] * bool(m["d"]), m["m"] is None)
        for m in re.finditer(r"export\s+(?P<star>\*)?(?:\s+as\s+(?P<as>[\w$]+))?(?:\{(?P<n>[^}]*)\})?\s*(?:from\s*[\"'](?P<m>[^\"'\n]+)[\"'])?", plain):
            if m["star"] or m["n"] is not None:
                names, aliases = listed(m["n"] or "")
                for name, alias in zip(names or ["*"], aliases or [m["as"] or ""]):
                    exports.append({"name": alias or name, "type": "re-export-all" if m["star"] else "named", "line": _line(starts, m.start()), "source": m["m"], "alias": name if alias else None})
                if m["m"]:
                    add(m["m"], names, "re-export", m.start(), aliases)
        for m in re.finditer(r"export\s+(?P<def>default\s+)?(?:async\s+|abstract\s+|declare\s+)*(?:class|function\s*\*?|const|let|var|interface|type|enum)\s+(?P<n>[\w$]+)", code):
            exports.append({"name": m["n"], "type": "default" if m["def"] else "named", "line": _line(starts, m.start()), "source": None, "alias": None})
        for m in re.finditer(r"module\.exports\s*=\s*(?:\{(?P<n>[^}]*)\}|(?P<d>[\w$]+))|(?:module\.)?exports\.(?P<o>[\w$]+)\s*=", code):
            for name in listed(m["n"] or "")[0] + [x for x in (m["d"], m["o"]) if x]:
                exports.append({"name": name.lstrip("."), "type": "module.exports", "line": _line(starts, m.start()), "source": None, "alias": None})
    elif group == "go":
        for m in re.finditer(r"import\s*\((?P<b>[^)]*)\)|import\s+(?:(?P<a>[\w.]+)\s+)?\"(?P<m>[^\"]+)\"", plain):
            if m["m"]:
                add(m["m"], [m["a"] or m["m"].rpartition("/")[2]], "import", m.start())
            else:
                for x in re.finditer(r"(?:(?P<a>[\w.]+)\s+)?\"(?P<m>[^\"]+)\"", m["b"]):
                    add(x["m"], [x["a"] or x["m"].rpartition("/")[2]], "import", m.start("b") + x.start())
    elif group == "rust":
        for m in re.finditer(r"\b(?:use\s+(?P<u>[^;]+);|mod\s+(?P<m>\w+)\s*;)", code):
            path = m["m"] or m["u"].strip()
            names = split_top(path[path.find("{") + 1 : path.rfind("}")]) if "{" in path else [path.rpartition("::")[2]]
            add(path.split("{")[0].rstrip(":") if m["u"] else f"self::{path}", names, "use" if m["u"] else "mod", m.start())
    elif language == "java":
        for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", code, re.M):
            add(m[1], [m[1].rpartition(".")[2]], "import", m.start(1))
    elif language == "csharp":
        for m in re.finditer(r"^\s*(global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;", code, re.M):
            add(m[2], [m[2].rpartition(".")[2]], "using", m.start(2))
    else:
        for m in re.finditer(r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]", plain, re.M):
            add(m[1], [], "include", m.start(1))
    return imports, exports
