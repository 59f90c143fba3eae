"""Facts of brace languages from their tokens: declarations by a reader for each family, then calls, references and types in their scopes."""

from __future__ import annotations

import re
from bisect import bisect_right

from codefold.sources.lexer import Tokens

KEYWORDS = {
    "javascript": "if for while switch catch return function new typeof await yield else do try throw in of delete void case instanceof with async class extends import export default const let var from as static get set break continue finally",
    "go": "if for switch return func else case select go defer range chan map struct interface type var const package import fallthrough goto default make new len cap append panic recover copy delete close",
    "rust": "if for while match return fn else loop unsafe move in as let mut ref impl trait struct enum mod use pub where async await dyn crate const static type break continue extern",
    "java": "if for while switch catch return new else do try throw throws synchronized assert instanceof case default class interface enum record extends implements import package static final public private protected abstract native yield",
    "csharp": "if for foreach while switch catch return new else do try throw lock using typeof nameof sizeof default checked unchecked when where is as in out ref case await yield class struct interface enum record namespace static public private protected internal base",
    "c": "void int char long short float double unsigned signed if for while switch return sizeof else do case default struct union enum typedef goto _Alignof alignof static extern inline const volatile",
    "cpp": "void int char long short float double unsigned signed bool if for while switch catch return sizeof else do try throw case default new delete typeid alignof decltype static_assert noexcept operator template typename class struct union enum namespace using static extern inline const constexpr requires co_await co_return co_yield static_cast dynamic_cast const_cast reinterpret_cast",
}
KEYWORDS = {g: frozenset(words.split()) for g, words in KEYWORDS.items()}
SELF = ("this", "self", "super", "base", "Self")
MEMBER = (".", "?.", "->", "::")
LOOPS, DECISIONS = frozenset("for while loop do foreach".split()), frozenset("if for while case catch foreach match loop && || ?? ?".split())
_TYPE_PART = frozenset(", . < > :: ? & * [ ] ' -> ( ) + = |".split()) | {"extends", "super", "dyn", "const", "mut", "in", "out", "keyof", "typeof", "readonly"}


def last_name(words: list[str]) -> str | None:
    """The type a list of type tokens names, without path, pointers and arguments."""
    depth, found = 0, None
    for w in words:
        depth += (w == "<") - (w == ">") + (w == "[") * (found is not None) - (w == "]") * (found is not None)
        if depth <= 0 and re.match(r"[A-Za-z_$]", w) and w not in ("const", "mut", "dyn", "impl", "ref", "out", "in", "readonly", "final", "struct", "unsigned", "signed", "volatile"):
            found = w
    return found


class Reader:
    """What all families share. A reader's ``declarations`` fills ``symbols`` (with token spans), ``types`` and ``skip``."""

    def __init__(self, text: str, language: str):
        self.t = Tokens(text, language)
        self.language, self.group = language, self.t.group
        self.kind, self.text, self.pair, self.line = self.t.kind, self.t.text, self.t.pair, self.t.line
        self.n, self.keywords = len(self.kind), KEYWORDS[self.t.group]
        self.symbols: list[dict] = []
        self.spans: list[tuple[int, int]] = []
        #: Token positions of names that are no calls: definitions, declared variables, enum members.
        self.skip: set[int] = set()
        #: (first token, last token, name, type or None, is a value) of variables, by scope.
        self.variables: list[tuple[int, int, str, str | None, bool]] = []
        self.fields: dict[tuple[str, str], str] = {}

    # reading tokens

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < self.n else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < self.n and self.kind[i] == "id" and self.text[i] not in self.keywords

    def jump(self, i: int) -> int:
        """The position after a bracket group or a token."""
        return self.pair[i] + 1 if self.at(i) in ("(", "[", "{") and self.kind[i] == "op" and self.pair[i] > i else i + 1

    def generic_end(self, i: int) -> int | None:
        """Where type arguments that open at ``i`` with ``<`` end, if they read like types."""
        depth, j = 0, i
        while j < self.n and j < i + 200:
            w = self.text[j]
            depth += (w == "<") - (w == ">") * 1
            if not depth:
                return j
            if self.kind[j] in ("str", "num", "pp") and self.group not in ("javascript", "rust", "cpp") or w in (";", "{", "}", "&&", "||", "==", "=>") and not (w == "=>" and self.group == "javascript"):
                return None
            if self.kind[j] == "op" and w not in _TYPE_PART and w not in ("=>", "...", ":"):
                return None
            j += 1
        return None

    def raw(self, a: int, b: int) -> str:
        """Source from token ``a`` to before token ``b``."""
        return self.t.source[self.t.start[a] : self.t.end[b - 1]] if a < b else ""

    def words(self, a: int, b: int) -> list[str]:
        return self.text[a:b]

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        """Token ranges between commas of ``a`` to before ``b`` outside brackets and type arguments."""
        out, low, j = [], a, a
        while j < b:
            w = self.text[j]
            if w == "," and self.kind[j] == "op":
                out.append((low, j))
                low = j = j + 1
                continue
            if w == "<" and self.kind[j] == "op" and j and self.kind[j - 1] == "id" and (end := self.generic_end(j)) and end < b:
                j = end + 1
                continue
            j = self.jump(j)
        out.append((low, b))
        return [(x, y) for x, y in out if x < y]

    def body(self, i: int) -> tuple[int, int] | None:
        return (i, self.pair[i]) if self.at(i) == "{" and self.pair[i] > i else None

    # recording

    def symbol(self, name_at: int, kind: str, first: int, last: int, owner: str | None = None, name: str | None = None, params: tuple[int, int] | None = None, ret: str | None = None, modifiers: list[str] = (), decorators: list[str] = (), bases: list[str] = (), exported: bool = False, receiver: str | None = None) -> dict:
        name = name or self.text[name_at]
        self.skip.add(name_at)
        family = "callable" if kind in ("function", "method", "constructor", "macro") else "type"
        structured = None if params is None else [self.parameter(a, b) for a, b in self.split(*params)]
        structured = structured and [p for group in structured for p in (group if isinstance(group, list) else [group]) if p]
        found = {
            "name": name, "kind": kind, "family": family, "start_line": self.line[first], "end_line": max(self.line[last], self.line[name_at]), "name_line": self.line[name_at], "owner": owner, "receiver": receiver,
            "params": None if params is None else self.raw(*params), "params_structured": structured, "return_type": (ret or "").strip() or None, "modifiers": list(modifiers), "decorators": list(decorators), "bases": [b for b in bases if b],
            "is_async": "async" in modifiers, "is_exported": exported, "entry_kind": None,
        }
        self.symbols.append(found)
        self.spans.append((first, last))
        for p in structured or ():
            self.variables.append((first, last, p["name"], last_name(re.findall(r"[\w$]+|[^\w\s]", p["type"])) if p["type"] else None, True))
        return found

    def parameter(self, a: int, b: int):
        raise NotImplementedError

    def param(self, name: str, kind: str | None = None, default: str | None = None, rest: bool = False, optional: bool = False) -> dict:
        return {"name": name, "type": kind or None, "optional": bool(optional or default or rest), "default": default or None, "rest": rest, "keyword_only": False, "positional_only": False}

    def declarations(self) -> None:
        raise NotImplementedError

    # scopes

    def _blocks(self) -> None:
        """Controlling keyword of each open brace, and of each token whether a loop or a try is around it."""
        self.in_loop, self.in_try, stack = [False] * self.n, [False] * self.n, []
        for i in range(self.n):
            while stack and i > stack[-1][0]:
                stack.pop()
            if self.at(i) == "{" and self.kind[i] == "op" and self.pair[i] > i:
                j = i - 1
                while j >= 0 and self.text[j] not in (";", "{", "}") and i - j < 60:
                    j = self.pair[j] - 1 if self.text[j] in (")", "]") and 0 <= self.pair[j] < j else j - 1
                head = self.text[j + 1 : i]
                callable_start = any(w in ("function", "=>", "func", "fn") for w in head)
                loop, caught = (stack[-1][1], stack[-1][2]) if stack and not callable_start else (False, False)
                stack.append((self.pair[i], loop or bool(LOOPS & set(head)), caught or "try" in head))
            self.in_loop[i], self.in_try[i] = (stack[-1][1], stack[-1][2]) if stack else (False, False)

    def _inner(self) -> list[int]:
        """For each token the innermost callable around it, -1 outside."""
        out = [-1] * self.n
        order = sorted((k for k, s in enumerate(self.symbols) if s["family"] == "callable"), key=lambda k: self.spans[k][0] - self.spans[k][1])
        for k in order:
            a, b = self.spans[k]
            out[a : b + 1] = [k] * (b + 1 - a)
        return out

    def _variable(self, i: int, name: str) -> tuple | None:
        """The innermost variable of that name whose scope holds token ``i``."""
        best = None
        for v in self.by_name.get(name, ()):
            if v[0] <= i <= v[1] and (best is None or v[1] - v[0] <= best[1] - best[0]):
                best = v
        return best

    def type_of(self, i: int, words: list[str], own: str | None) -> str | None:
        """The type of a receiver, by declared and constructed types in its scopes and fields of its owner."""
        if not words or words[0] in SELF and len(words) == 1:
            return None
        if words[0] in SELF:
            found = own
        else:
            v = self._variable(i, words[0])
            found = v[3] if v else self.fields.get((own, words[0])) if self.group in ("java", "csharp", "cpp") else None
        for w in words[1:]:
            found = self.fields.get((found, w)) if found else None
        return found

    def constructed(self, i: int) -> str | None:
        """The type that an expression at ``i`` makes, where its first tokens say so."""
        j = i + 1 if self.at(i) in ("await", "&", "*") else i
        if self.at(j) == "new":
            k = j + 1
            while self.at(k + 1) in (".", "::"):
                k += 2
            return self.text[k] if self.is_name(k) else None
        if self.group == "go" and self.is_name(j):
            k = j + 2 if self.at(j + 1) == "." else j
            if self.at(k + 1) == "{" and self.text[k][:1].isupper() or self.at(k + 1) == "{" and self.at(j - 1) == "&":
                return self.text[k]
        if self.group == "rust" and self.is_name(j) and self.text[j][:1].isupper():
            if self.at(j + 1) == "::" and self.at(j + 2) in ("new", "default", "from", "with_capacity", "open", "connect", "create", "build"):
                return self.text[j]
            if self.at(j + 1) in ("{", "("):
                return self.text[j]
        if self.group == "cpp" and self.is_name(j) and self.at(j + 1) in ("(", "{") and any(s["name"] == self.text[j] and s["family"] == "type" for s in self.symbols):
            return self.text[j]
        if self.is_name(j) and self.at(j + 1) == "(":
            return f"{self.text[j]}()"
        return None

    # facts

    def facts(self) -> dict:
        self.declarations()
        self._blocks()
        inner = self._inner()
        returns = {}
        for s in self.symbols:
            if s["family"] == "callable" and s["owner"] is None:
                returns[s["name"]] = last_name(re.findall(r"[\w$]+|[^\w\s]", (s["return_type"] or "").split(",")[0].strip("() "))) if s["return_type"] else None
        # a variable made by a call of the file's own function has its declared result
        self.variables = [(a, b, n, returns.get(t[:-2]) if t and t.endswith("()") else t, v) for a, b, n, t, v in self.variables]
        self.by_name: dict[str, list] = {}
        for v in self.variables:
            self.by_name.setdefault(v[2], []).append(v)
        calls = self._calls(inner)
        for s, (a, b) in zip(self.symbols, self.spans):
            if s["family"] == "callable":
                inside = self.text[a : b + 1]
                s["complexity"] = 1 + sum(w in DECISIONS for w in inside)
                s["nesting"] = self._nesting(a, b)
            if s["entry_kind"] is None:
                s["entry_kind"] = self.entry_kind(s)
        usages = [{"line": s["name_line"], "col": 0, "name": s["name"], "usage_type": "definition", "receiver": None} for s in self.symbols]
        usages += [{"line": c["line"], "col": c["col"], "name": c["name"], "usage_type": "call" if not c["is_function_ref"] else "reference", "receiver": c["receiver"]} for c in calls]
        return {"symbols": self.symbols, "calls": calls, "usages": usages}

    def _nesting(self, a: int, b: int) -> int:
        depth = most = 0
        for i in range(a, b + 1):
            if self.kind[i] == "op":
                depth += (self.text[i] == "{") - (self.text[i] == "}")
                most = max(most, depth)
        return max(0, most - 1)

    def entry_kind(self, s: dict) -> str | None:
        if s["family"] != "callable":
            return None
        tags = {d.split("(")[0] for d in s["decorators"]}
        if tags & {"Test", "ParameterizedTest", "RepeatedTest", "test", "tokio::test", "actix_web::test", "Fact", "Theory", "TestMethod", "TestCase"} or s["name"].startswith("test_") and self.group in ("c", "cpp") or self.group == "go" and re.match(r"(Test|Benchmark|Example|Fuzz)([A-Z_]|$)", s["name"]):
            return "test"
        free = s["owner"] is None
        if s["name"] == "main" and (free and self.group in ("go", "rust", "c", "cpp") or self.group == "java" and "static" in s["modifiers"]) or s["name"] == "Main" and self.group == "csharp" and "static" in s["modifiers"] or s["name"] == "init" and free and self.group == "go":
            return "main"
        return None

    def _chain(self, i: int) -> tuple[int, list[str] | None, str | None]:
        """Of a member name at ``i``: where its receiver starts, the receiver's names (None if it is no plain path), and the type if it is ``new X()``."""
        j, words, plain, made = i, [], True, None
        if self.group == "java" and self.at(j - 1) == ">":
            k = next((k for k in range(j - 2, max(-1, j - 40), -1) if self.at(k) == "<" and self.generic_end(k) == j - 1), j)
            j = k if self.at(k - 1) in MEMBER else j
        while j > 0 and self.at(j - 1) in MEMBER and self.kind[j - 1] == "op":
            k = j - 2
            if self.at(k) == "?" or self.at(k) == "!":
                k -= 1
            if self.at(k) == ">" and self.group in ("rust", "java", "cpp", "csharp"):
                depth = 0
                while k >= 0 and k > j - 60:
                    depth += (self.text[k] == ">") - (self.text[k] == "<")
                    k -= 1
                    if not depth:
                        break
                if self.at(k) == "::":
                    k -= 1
            if self.at(k) in (")", "]", "}") and 0 <= self.pair[k] < k:
                while self.at(k) in (")", "]") and 0 <= self.pair[k] < k:
                    k = self.pair[k] - 1
                plain = False
                if self.is_name(k) or self.at(k) in SELF:
                    j = k
                    if self.at(k - 1) == "new":
                        made, j = self.text[k], k - 1
                        break
                    continue
                j = k + 1
                break
            if k >= 0 and (self.kind[k] == "id" or self.kind[k] == "str"):
                if self.kind[k] == "str":
                    plain = False
                words.insert(0, self.text[k])
                j = k
                continue
            plain, j = False, max(0, j - 1)
            break
        return j, (words if plain else None), made

    def _callee_end(self, i: int) -> int | None:
        """The opening parenthesis of a call of the name at ``i``."""
        j = i + 1
        if self.at(j) == "(":
            return j
        if self.group == "javascript" and self.at(j) == "?." and self.at(j + 1) == "(":
            return j + 1
        if self.group == "rust":
            if self.at(j) == "::" and self.at(j + 1) == "<" and (end := self.generic_end(j + 1)) and self.at(end + 1) == "(":
                return end + 1
            if self.at(j) == "!" and self.at(j + 1) in ("(", "[", "{") and self.text[i] != "macro_rules":
                return j + 1
            return None
        if self.at(j) == "<" and self.group in ("javascript", "java", "csharp", "cpp") and self.language != "html" and (end := self.generic_end(j)) and self.at(end + 1) == "(" and end > j + 1:
            return end + 1
        return None

    def _calls(self, inner: list[int]) -> list[dict]:
        calls: list[dict] = []
        seq = 0
        for i in range(self.n):
            if self.kind[i] != "id" or i in self.skip:
                continue
            name = self.text[i]
            if self.group in ("java", "cpp") and self.at(i - 1) == "::" and self.group == "java":
                seq += 1
                calls.append(self._reference(i, i, inner, seq))
                continue
            if name in self.keywords and not (name in ("super", "this", "base") and self.at(i + 1) == "("):
                if not (self.group in ("go", "csharp") and self.at(i - 1) == "." or self.group == "javascript" and self.at(i - 1) in (".", "?.")):
                    continue
            opened = self._callee_end(i)
            if opened is None:
                if self.group == "javascript" and self.at(i - 1) == "new" and self.is_name(i):
                    seq += 1
                    calls.append(self._site(i, i - 1, None, inner, seq, None, False, None))
                continue
            if self.is_declared_call(i):
                continue
            start, words, made = self._chain(i)
            method, receiver, kind = start < i and self.at(i - 1) != "new", None, None
            own = self.symbols[inner[i]]["owner"] if inner[i] >= 0 else None
            prefix = self.at(start - 1)
            if prefix == "new" or (method and self.at(start - 1) == "new"):
                method, start = False, start - 1
            elif method:
                receiver = (".".join(words) if self.group != "rust" and self.group != "cpp" else self._path(start, i)) if words else None
                kind = made or (self.type_of(i, words, own) if words else None)
            if name in ("super", "this", "base") and not method:
                if self.group == "javascript" and name == "this":
                    continue
                target = own if name == "this" else self.parent_of(own)
                if target is None:
                    continue
                name = target
            if name == "Self" and own:
                name = own
            seq += 1
            calls.append(self._site(i, start, opened, inner, seq, receiver, method, kind, name))
            calls.extend(self._arguments(i, opened, inner, calls[-1], seq))
            if self.group == "javascript" and name in ("bind", "call", "apply") and words and method:
                # the function that is called through its own method
                holder = words[:-1]
                calls.append({**calls[-1], "name": words[-1], "is_method": bool(holder), "receiver": ".".join(holder) or None, "receiver_type": self.type_of(i, holder, own) if holder else None, "arg_count": None, "is_function_ref": False, "shape": "bound", "local_shadow": False})
        calls.extend(self.given(inner))
        for n, c in enumerate(calls, 1):
            c["seq"] = n
        return calls

    def given(self, inner: list[int]) -> list[dict]:
        """Functions named as fields of Go's composite literals; their shape says which: ``pkg.Type{Field}``."""
        out = []
        for i in range(self.n if self.group == "go" else 0):
            if self.at(i) != "{" or self.pair[i] <= i or not self.is_name(i - 1) or self.at(i - 2) in ("struct", "interface", "func", ")", "]"):
                continue
            kind = f"{self.text[i - 3]}.{self.text[i - 1]}" if self.at(i - 2) == "." else self.text[i - 1]
            for a, b in self.split(i + 1, self.pair[i]):
                if self.kind[a] == "id" and self.at(a + 1) == ":" and self.kind[b - 1] == "id" and (b - a == 3 or b - a == 5 and self.at(b - 2) == ".") and self.is_name(b - 1):
                    out.append(self._reference(b - 1, b - 1, inner, 0) | {"shape": f"{kind}{{{self.text[a]}}}"})
        return out

    def _path(self, start: int, i: int) -> str:
        words, depth = [], 0
        for w in self.text[start : i - 1]:
            depth += (w == "<") - (w == ">")
            if not depth and w != ">":
                words.append(w)
        return re.sub(r"(::)+", "::", "".join(words)).removesuffix("::")

    def parent_of(self, owner: str | None) -> str | None:
        return next((s["bases"][0] for s in self.symbols if s["family"] == "type" and s["name"] == owner and s["bases"]), None)

    def is_declared_call(self, i: int) -> bool:
        return False

    def _site(self, i: int, start: int, opened: int | None, inner: list[int], seq: int, receiver: str | None, method: bool, kind: str | None, name: str | None = None) -> dict:
        name, close = name or self.text[i], self.pair[opened] if opened is not None else i
        args = self.split(opened + 1, close) if opened is not None else []
        before = start - 1
        awaited = self.at(before) == "await" or self.group == "rust" and self.at(close + 1) == "." and self.at(close + 2) == "await" or self.group == "javascript" and False
        if self.at(before) in ("await", "go", "defer", "&", "*", "!"):
            before -= 1
        assigned = None
        if self.at(before) in ("=", ":="):
            j = before - 1
            while j >= 0 and self.at(j) not in (";", "{", "}", "(") and before - j < 40:
                if self.is_name(j) and self.at(j - 1) in ("const", "let", "var", "mut", ";", "{", "}", "auto", ",", "") or self.is_name(j) and j == before - 1:
                    assigned = self.text[j]
                    if self.at(j - 1) != ":":
                        break
                j -= 1
        enclosing = self.symbols[inner[i]] if inner[i] >= 0 else None
        literal, interp = self._literal(opened + 1) if opened is not None else (None, False)
        option = re.search(r"method\s*:\s*[\"'`](\w+)", self.raw(opened, close + 1)) if opened is not None and self.group == "javascript" else None
        shadow = False
        if not method and receiver is None and self.group != "java" and self.at(i - 1) != "new":
            v = self._variable(i, name)
            shadow = bool(v and v[4])
        # the results of a call may be all the arguments in Go
        spread = any(self.at(a) == "..." or self.at(b - 1) == "..." for a, b in args) or self.group == "go" and len(args) == 1 and self.at(args[0][1] - 1) == ")" and args[0][1] - args[0][0] > 2
        return {
            "line": self.line[i], "col": self.t.start[i] - self.t.lines[self.line[i] - 1], "seq": seq, "name": name, "resolved_names": [], "is_method": method, "receiver": receiver, "receiver_type": kind, "arg_count": len(args), "arg_spread": spread, "keywords": [],
            "first_string_arg": literal, "first_string_interp": interp, "options_method": option[1].upper() if option else None, "is_function_ref": False, "local_shadow": shadow,
            "awaited": awaited, "handled": self.at(before) in ("return", "yield", "void", "=>") or self.at(close + 1) in (".", "?."), "assigned_to": assigned, "in_loop": self.in_loop[i], "in_try": self.in_try[i],
            "enclosing_name": enclosing["name"] if enclosing else None, "enclosing_start": enclosing["start_line"] if enclosing else None, "shape": ",".join(self.shape(a, b) for a, b in args),
        }

    def shape(self, a: int, b: int) -> str:
        """What an argument is by its tokens: a literal's kind, a name, or an expression."""
        if b - a > 1 and not (b - a == 2 and self.at(a) == "-"):
            return "expr"
        kind = self.kind[b - 1]
        return "bool" if self.text[a] in ("true", "false") else "char" if kind == "str" and self.group in ("java", "csharp", "c", "cpp") and self.text[b - 1].startswith("'") else kind if kind in ("id", "str", "num") else "expr"

    def _literal(self, i: int) -> tuple[str | None, bool]:
        """The string that starts at token ``i``, its holes as stars."""
        if not (0 <= i < self.n and self.kind[i] == "str"):
            return None, False
        text, interp = self.text[i], False
        quote = next((q for q in ("`", '"', "'") if q in text[:4]), None)
        if quote is None:
            return None, False
        text = text[text.index(quote) + 1 :]
        while not text.endswith(quote) and self.at(i + 1) == "{" and self.pair[i + 1] > i:
            interp, i = True, self.pair[i + 1] + 1
            if i >= self.n or self.kind[i] != "str":
                break
            text += "*" + self.text[i]
        return text.removesuffix("#").removesuffix(quote), interp

    def _reference(self, i: int, start: int, inner: list[int], seq: int) -> dict:
        start, words, _ = self._chain(i)
        own = self.symbols[inner[i]]["owner"] if inner[i] >= 0 else None
        plain = words is not None and len(words) == 1
        kind = self.type_of(i, words, own) if words else None
        found = self._site(i, start, None, inner, seq, words[0] if plain else None, plain, kind)
        return found | {"is_function_ref": True, "arg_count": None, "shape": "ref", "assigned_to": None}

    def _arguments(self, i: int, opened: int, inner: list[int], call: dict, seq: int) -> list[dict]:
        """Arguments that are names or short paths: functions passed on, perhaps."""
        out = []
        for a, b in self.split(opened + 1, self.pair[opened]):
            if self.at(a) == "&" and self.group in ("cpp", "c"):
                a += 1
            size = b - a
            if size not in (1, 3) or size == 3 and self.at(a + 1) not in (".", "::") or not (self.kind[b - 1] == "id" and (self.kind[a] == "id")):
                continue
            name = self.text[b - 1]
            if name in self.keywords or name in ("true", "false", "null", "nil", "undefined", "None", "this", "self", "super", "nullptr") or self.group == "java" and size == 1 or self.group == "java" and self.at(a + 1) == "::":
                continue
            receiver = self.text[a] if size == 3 else None
            v = self._variable(a, self.text[a])
            own = self.symbols[inner[i]]["owner"] if inner[i] >= 0 else None
            out.append({**call, "name": name, "line": self.line[b - 1], "is_method": size == 3, "receiver": receiver, "receiver_type": self.type_of(a, [receiver], own) if receiver else None, "is_function_ref": True, "local_shadow": bool(size == 1 and v and v[4]), "arg_count": None, "first_string_arg": None, "first_string_interp": False, "options_method": None, "awaited": False, "assigned_to": None, "shape": "ref"})
        return out
