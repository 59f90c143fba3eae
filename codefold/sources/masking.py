"""Comments and strings blanked, positions kept."""

from __future__ import annotations

import re

_STRINGS = r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?"
_PYTHON = re.compile(r"#[^\n]*|(?P<f>[rbuf]{0,2})(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|" + _STRINGS + ")", re.S | re.I)
_HOLE = re.compile(r"(?<!\{)\{([^{}]+)\}")


def masked(text: str, language: str, keep_strings: bool = False) -> str:
    """The text with comments (and strings, unless kept) as blanks of the same length; newlines and code within strings stay."""
    from codefold.sources.declarations import READERS
    from codefold.sources.lexer import GROUP, Tokens

    if GROUP.get(language, language) in READERS:
        return Tokens(text, language).blanked(strings=not keep_strings)
    if language != "python":
        return text

    def blank(m):
        own = m[0]
        if keep_strings and not own.startswith("#"):
            return own
        out = re.sub(r"[^\n]", " ", own)
        if "f" in (m["f"] or "").lower():
            for hole in _HOLE.finditer(own):
                a, b = hole.span(1)
                out = out[:a] + own[a:b] + out[b:]
        return out

    return _PYTHON.sub(blank, text)
