"""Text predicates and scores as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD, IDENT = "A-Za-z0-9_", "A-Za-z0-9_$"
_NESTED = re.compile(r"\((?:[^()\\]|\\.)*[+*}](?:[^()\\]|\\.)*\)[+*{]")


def quoted(text: str) -> str:
    """The text as a Java regular expression that matches itself."""
    return re.sub(r"([\\.*+?^${}()|\[\]])", r"\\\1", text)


def word_pattern(name: str) -> str:
    """``name`` between ASCII word boundaries; Java's own ``\\b`` is not ASCII."""
    edge = lambda c, yes, no: yes if re.fullmatch(f"[{WORD}]", c) else no
    if not name:
        return "(?!)"
    return edge(name[0], f"(?<![{WORD}])", f"(?<=[{WORD}])") + quoted(name) + edge(name[-1], f"(?![{WORD}])", f"(?=[{WORD}])")


def identifier_pattern(name: str) -> str:
    """``name`` not inside a longer identifier, where ``$`` is a letter too."""
    return f"(?<![{IDENT}]){quoted(name)}(?![{IDENT}])"


def has_word(text: Column, name: str) -> Column:
    """A cheap containment test before the regular expression."""
    return text.contains(name) & text.rlike(word_pattern(name))


def has_identifier(text: Column, name: str) -> Column:
    return text.contains(name) & text.rlike(identifier_pattern(name))


def checked_regex(pattern: str) -> str:
    """The pattern, unless it may take exponential time or doesn't compile."""
    if _NESTED.search(pattern):
        raise ValueError(f"nested repeats are refused: {pattern}")
    try:
        re.compile(pattern)
    except re.error as wrong:
        raise ValueError(f"invalid pattern: {wrong}") from wrong
    return pattern


def glob_pattern(glob: str) -> str:
    """A symbol-name glob (``*``, ``?``) as an anchored regular expression."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else quoted(c) for c in glob) + "$"


def path_glob_pattern(glob: str) -> str:
    """A path glob with ``{a,b}``, ``**``, ``*`` and ``?``."""
    out, k, depth = "", 0, 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 2
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += quoted(c)
        k += 1
    return f"^{out}$"


def matches_filters(path: Column, exclude: list[str] | None = None, within: str | None = None) -> Column:
    """Path filters: ``exclude`` patterns bounded by path punctuation with an optional plural, ``within`` a directory or file suffix."""
    keep = F.lit(True)
    for pattern in exclude or ():
        keep = keep & ~F.lower(path).rlike(rf"(^|[/._\-]){quoted(pattern.lower())}s?([/._\-]|$)")
    if within and within.rstrip("/") not in ("", "."):
        place = within.rstrip("/")
        if re.search(r"\.\w+$", place):
            keep = keep & ((path == place) | path.endswith("/" + place))
        else:
            keep = keep & (path.startswith(place + "/") | path.contains("/" + place + "/"))
    return keep


#: What a list of names excludes when tests are to be left out.
TEST_EXCLUDES = ["test", "spec", "__tests__", "__mocks__", "fixture", "mock"]


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)(tests?|__tests__|spec|__mocks__|fixtures?)/|[._-](test|spec)s?\.[a-z]+$|(^|/)test_[^/]*\.py$|_test\.(go|py|c|cc|cpp|rs)$|tests?\.(java|cs)$")


def fuzzy_score(query: str, target: Column) -> Column:
    """1000 equal, 900 but for case, 800+ prefix, 600 capital initials, 400+ inside, 300 a word's prefix, 0 otherwise."""
    low = query.lower()
    ratio = F.lit(len(query) * 100.0) / F.length(target)
    parts = F.split(F.lower(F.regexp_replace(target, "([a-z])([A-Z])", "$1 $2")), " ")
    # one part for each character in order: the parts' initials hold the query as a subsequence
    initials = F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 1)), "")
    camel = initials.rlike(".*".join(quoted(c) for c in low)) if len(query) >= 2 else F.lit(False)
    words = F.split(target, "(?=[A-Z])|_|-")
    return (
        F.when(target == query, 1000.0)
        .when(F.lower(target) == low, 900.0)
        .when(F.lower(target).startswith(low), 800.0 + ratio)
        .when(camel, 600.0)
        .when(F.lower(target).contains(low), 400.0 + ratio)
        .when(F.exists(words, lambda w: F.lower(w).startswith(low)), 300.0)
        .otherwise(0.0)
    )


def normal_route(path: Column) -> Column:
    """A route without query, fragment and trailing slash, its parameters as ``*``."""
    bare = F.regexp_replace(path, r"[?#].*$", "")
    bare = F.when((F.length(bare) > 1) & bare.endswith("/"), F.regexp_replace(bare, "/$", "")).otherwise(bare)
    for form in ("<[^>]+>", r"\{[^}]+\}", ":[A-Za-z_][A-Za-z0-9_]*"):
        bare = F.regexp_replace(bare, form, "*")
    return F.coalesce(bare, F.lit(""))


def joined_route(prefix: Column, path: Column) -> Column:
    """Class or mount prefix and path with one slash between."""
    p, s = F.regexp_replace(F.coalesce(prefix, F.lit("")), "/+$", ""), F.regexp_replace(F.coalesce(path, F.lit("")), "^/+", "")
    return F.when((p == "") & (s == ""), F.lit("/")).when(s == "", p).when(p == "", F.concat(F.lit("/"), s)).otherwise(F.concat(p, F.lit("/"), s))


def canonical_order(path: str = "rel") -> list[Column]:
    """Paths by folded case, then by code unit."""
    return [F.lower(F.col(path)), F.col(path)]
