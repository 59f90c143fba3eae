"""Tokens of brace languages: names, strings with their embedded code, comments, operators, and matching brackets."""

from __future__ import annotations

import re
from bisect import bisect_right

GROUP = {"typescript": "javascript", "tsx": "javascript", "html": "javascript"}
_NAME = r"[^\W\d][\w$]*|[$#][^\W\d][\w$]*|\$"
_OPS = r"=>|->|::|\?\.(?!\d)|\.\.\.|\.\.=?|:=|<-|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|[+\-*/%&|^]=|[^\s]"
_TEXT = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_STRINGS = {
    "javascript": _TEXT,
    "go": r"`[^`]*`|" + _TEXT,
    "rust": r"b?r(?P<h>#*)\".*?\"(?P=h)|[bc]?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x..|.))'",
    "java": r"\"\"\".*?\"\"\"|" + _TEXT,
    "csharp": r"\"\"\".*?\"\"\"|(?:@\$?|\$@)\"(?:[^\"]|\"\")*\"|\$?\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'",
    "c": r"(?:u8|[uUL])?R\"(?P<d>[^\s()\\]{0,16})\(.*?\)(?P=d)\"|(?:u8|[uUL])?\"(?:[^\"\\\n]|\\.)*\"|(?:u8|[uUL])?'(?:[^'\\\n]|\\.)*'",
}
_STRINGS["cpp"] = _STRINGS["c"]
_DIRECTIVE = r"(?m:^[ \t]*\#(?:[^\n\\]|\\.|\\\n)*)"


def _scanner(group: str) -> re.Pattern:
    directive = rf"(?P<pp>{_DIRECTIVE})|" if group in ("c", "cpp", "csharp") else ""
    life = r"(?P<life>'[A-Za-z_]\w*)|" if group == "rust" else ""
    return re.compile(rf"(?P<ws>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|{directive}(?P<str>{_STRINGS[group]})|{life}(?P<num>\.?\d(?:[\w.]|(?<=[eE])[+-])*)|(?P<id>{_NAME})|(?P<op>{_OPS})", re.S)


_SCANNERS = {g: _scanner(g) for g in _STRINGS}
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do yield await instanceof".split())
_CHUNK = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_HOLE = re.compile(r"(?<!\{)\{([^{}\"]+)\}")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class Tokens:
    """Kinds ``id num str op life pp`` in ``kind``, with ``text``, ``start``, ``end`` and ``line``; comments apart. ``pair`` leads from a bracket to its partner."""

    def __init__(self, text: str, language: str):
        self.source, self.language = text, language
        self.group = GROUP.get(language, language)
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.kind, self.text, self.start, self.end, self.comments = [], [], [], [], []
        self._scan(0, len(text))
        self.line = [bisect_right(self.lines, s) for s in self.start]
        self._pairs()

    def _add(self, kind: str, start: int, end: int) -> None:
        self.kind.append(kind)
        self.text.append(self.source[start:end])
        self.start.append(start)
        self.end.append(end)

    def _scan(self, at: int, stop: int, hole: bool = False) -> int:
        """Tokens of a part; of a template's hole, up to the brace that closes it. Returns where it ends."""
        match, text, depth = _SCANNERS[self.group].match, self.source, 0
        while at < stop:
            if self.group == "javascript" and text[at] in "`/" and not text.startswith(("//", "/*"), at):
                if text[at] == "`":
                    at = self._template(at)
                    continue
                if self._regex_here() and (m := _REGEX.match(text, at)):
                    self._add("str", at, m.end())
                    at = m.end()
                    continue
            m = match(text, at, stop)
            if m is None:
                at += 1
                continue
            kind, end = m.lastgroup, m.end()
            if kind == "comment":
                end = self._comment_end(at, end)
                self.comments.append((at, end))
            elif kind in ("str", "h", "d") and self.group == "csharp" and "$" in text[at : at + 2]:
                self._interpolated(at, end)
            elif kind != "ws":
                depth += (kind == "op") * ((text[at] == "{") - (text[at] == "}"))
                if hole and depth < 0:
                    return at
                self._add("str" if kind in ("h", "d") else kind, at, end)
            at = end
        return at

    def _template(self, at: int) -> int:
        """A template's pieces as strings, and the code of its holes between braces."""
        low = at
        at += 1
        while at < len(self.source):
            at = _CHUNK.match(self.source, at).end()
            if not self.source.startswith("${", at):
                break
            self._add("str", low, at)
            self._add("op", at + 1, at + 2)
            at = self._scan(at + 2, len(self.source), hole=True)
            low = at = min(at + 1, len(self.source))
            self._add("op", at - 1, at)
        at = min(at + 1, len(self.source))
        self._add("str", low, at)
        return at

    def _regex_here(self) -> bool:
        if not self.kind:
            return True
        kind, last = self.kind[-1], self.text[-1]
        return last in _BEFORE_REGEX if kind == "id" else kind == "op" and last not in (")", "]", "}", "++", "--")

    def _comment_end(self, at: int, end: int) -> int:
        """Rust's block comments nest."""
        if self.group != "rust" or not self.source.startswith("/*", at):
            return end
        level = 0
        for m in re.compile(r"/\*|\*/").finditer(self.source, at):
            level += 1 if m[0] == "/*" else -1
            if not level:
                return m.end()
        return len(self.source)

    def _interpolated(self, at: int, end: int) -> None:
        low = at
        for m in _HOLE.finditer(self.source, at, end):
            self._add("str", low, m.start())
            self._add("op", m.start(), m.start() + 1)
            self._scan(*m.span(1))
            self._add("op", m.end() - 1, m.end())
            low = m.end()
        self._add("str", low, end)

    def _pairs(self) -> None:
        self.pair, stack = [-1] * len(self.kind), []
        for i, t in enumerate(self.text):
            if self.kind[i] != "op":
                continue
            if t in _OPEN:
                stack.append(i)
            elif t in _CLOSE:
                # an unclosed bracket inside does not swallow what follows
                k = next((k for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1) if _OPEN[self.text[stack[k]]] == t), None)
                if k is not None:
                    self.pair[stack[k]], self.pair[i] = i, stack[k]
                    del stack[k:]
        for i in stack:
            self.pair[i] = len(self.kind) - 1

    def blanked(self, strings: bool) -> str:
        """The source with comments, and strings too, as blanks of the same length; newlines and embedded code stay."""
        spans = sorted([*self.comments, *((s, e) for k, s, e in zip(self.kind, self.start, self.end) if strings and k == "str")])
        out, low = [], 0
        for s, e in spans:
            if s >= low:
                out += [self.source[low:s], re.sub(r"[^\n]", " ", self.source[s:e])]
                low = e
        return "".join([*out, self.source[low:]])
