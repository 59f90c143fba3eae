"""What each family of brace languages declares: symbols with their spans, variables with their types, fields of types."""

from __future__ import annotations

import re

from codefold.sources.braces import SELF, Reader, last_name

_JS_MODS = frozenset("public private protected static async readonly override abstract declare get set accessor export default const".split())
_C_MODS = frozenset("public private protected internal static final virtual override async abstract inline extern const constexpr synchronized native default sealed partial volatile transient strictfp unsafe readonly new required explicit friend".split())
_TYPE_WORDS = frozenset("class struct interface enum record union".split())


class JsReader(Reader):
    """JavaScript, TypeScript and TSX."""

    def declarations(self) -> None:
        self.scope(0, self.n, None, None)

    def parameter(self, a, b):
        while self.at(a) in ("public", "private", "protected", "readonly", "override") and self.is_name(a + 1):
            a += 1
        rest = self.at(a) == "..."
        a += rest
        eq = next((j for j in self._steps(a, b) if self.at(j) == "="), b)
        colon = next((j for j in self._steps(a, eq) if self.at(j) == ":"), eq)
        optional = self.at(colon - 1) == "?"
        name = self.raw(a, colon - optional)
        return self.param(name, self.raw(colon + 1, eq), self.raw(eq + 1, b), rest, optional) if name else None

    def _steps(self, a, b):
        while a < b:
            yield a
            a = self.jump(a)

    def scope(self, lo, hi, owner, holder):
        """Declarations among statements and expressions. ``owner`` is the class whose body holds this code, ``holder`` the variable of the object literal read now."""
        i = lo
        while i < hi:
            i = self.step(i, lo, hi, owner, holder)

    def step(self, i, lo, hi, owner, holder):
        w, prev = self.text[i], self.at(i - 1) if i > lo else ""
        if self.kind[i] != "id":
            if w == "=" and self.kind[i] == "op" and self.is_name(i - 1):
                return self.assigned(i, hi, owner)
            return i + 1
        if prev in (".", "?."):
            return i + 1
        if w == "class" and (self.is_name(i + 1) or self.at(i + 1) in ("{", "extends")):
            return self.klass(i, self.text[i + 1] if self.is_name(i + 1) else None)
        if w in ("interface", "enum", "namespace", "module") and self.is_name(i + 1) and prev not in (":", "=", "("):
            return self.typed(i, w)
        if w == "type" and self.is_name(i + 1) and self.at(i + 2) in ("=", "<"):
            end = self.statement_end(i + 2, hi)
            self.symbol(i + 1, "type", self.first(i), end - 1, exported="export" in self.mods(i))
            return end
        if w == "function":
            return self.function(i, owner, holder)
        if w in ("const", "let", "var") and self.is_name(i + 1):
            return self.variable(i, hi, owner)
        if w in ("const", "let", "var") and self.at(i + 1) in ("{", "["):
            for j in range(i + 2, self.pair[i + 1]):
                if self.is_name(j) and self.at(j + 1) in (",", "}", "]", "="):
                    # the result of a call that loads a module is that module's own name
                    loads = self.at(self.pair[i + 1] + 2) in ("require", "await")
                    self.variables.append((*self.around(i), self.text[j], None, not loads))
            return self.pair[i + 1] + 1
        if prev in ("{", ",") or prev in ("async", "get", "set", "*") and self.at(i - 2) in ("{", ",", "async", "static"):
            if self.at(i + 1) == "(" and w not in self.keywords | {"function"} or self.at(i + 1) == "(" and w in ("get", "set", "delete", "default", "from", "of", "as"):
                close = self.pair[i + 1]
                if self.at(close + 1) == "{":
                    return self.method(i, i, close + 1, holder, [m for m in (prev, self.at(i - 2)) if m in ("async", "get", "set")], [])
            if self.at(i + 1) == ":" and prev in ("{", ","):
                made = self.callable_at(i + 2)
                if made:
                    return self.bound(i, i, made, holder, "method")
        return i + 1

    def around(self, i):
        """The span of the innermost callable read so far that holds ``i``."""
        best = (0, self.n - 1)
        for s, (a, b) in zip(self.symbols, self.spans):
            if s["family"] == "callable" and a <= i <= b and b - a <= best[1] - best[0]:
                best = (a, b)
        return best

    def mods(self, i):
        """Modifiers right before ``i``."""
        out, j = [], i - 1
        while j >= 0 and self.text[j] in _JS_MODS and self.kind[j] == "id":
            out.insert(0, self.text[j])
            j -= 1
        return out

    def first(self, i):
        """Where the declaration at ``i`` begins: its modifiers and decorators."""
        j = i - len(self.mods(i))
        while True:
            k = self.pair[j - 1] if self.at(j - 1) == ")" and 0 <= self.pair[j - 1] < j else j
            while k - 2 >= 0 and self.at(k - 2) == "." and self.kind[k - 1] == "id":
                k -= 2
            if k - 2 >= 0 and self.kind[k - 1] == "id" and self.at(k - 2) == "@":
                j = k - 2
                continue
            return j

    def tags(self, a, b):
        """Decorators among the tokens from ``a`` to ``b``."""
        out, j = [], a
        while j < b and self.at(j) == "@":
            k = j + 2
            while self.at(k) == "." and k + 1 < b:
                k += 2
            if self.at(k) == "(":
                k = self.pair[k] + 1
            out.append(self.raw(j + 1, k))
            j = k
        return out

    def klass(self, i, name, name_at=None):
        j, bases, group = i + 1, [], []
        while j < self.n and self.text[j] != "{":
            if self.text[j] == "<" and (end := self.generic_end(j)):
                j = end + 1
                continue
            if self.text[j] in ("extends", "implements", ","):
                bases.append(last_name(group))
                group = []
            elif j > i + 1 or self.text[i + 1] != name:
                group.append(self.text[j])
            j = self.jump(j)
        bases.append(last_name(group))
        if j >= self.n:
            return i + 1
        end, first = self.pair[j], self.first(i)
        if name:
            mods = self.mods(i)
            self.symbol(name_at if name_at is not None else i + 1, "class", first, end, name=name, modifiers=mods, decorators=self.tags(first, i), bases=bases, exported="export" in mods)
        self.members(j + 1, end, name)
        return end + 1

    def typed(self, i, word):
        j, bases = i + 2, []
        while j < self.n and self.text[j] not in ("{", ";"):
            if self.text[j] == "<" and (end := self.generic_end(j)):
                j = end + 1
                continue
            if self.is_name(j) and self.text[j - 1] in ("extends", ","):
                bases.append(self.text[j])
            j += 1
        if self.at(j) != "{":
            return i + 1
        mods, kind = self.mods(i), {"module": "namespace"}.get(word, word)
        self.symbol(i + 1, kind, self.first(i), self.pair[j], modifiers=mods, bases=bases, exported="export" in mods)
        if kind == "namespace":
            self.scope(j + 1, self.pair[j], None, None)
        else:
            self.skip.update(k for k in range(j + 1, self.pair[j]) if self.kind[k] == "id" and self.at(k + 1) in ("(", "<", "?"))
            if word == "interface":
                self.field_types(j + 1, self.pair[j], self.text[i + 1])
        return self.pair[j] + 1

    def field_types(self, a, b, owner):
        for j in self._steps(a, b):
            if self.kind[j] == "id" and (self.at(j + 1) == ":" or self.at(j + 1) == "?" and self.at(j + 2) == ":"):
                k = j + 2 + (self.at(j + 1) == "?")
                if found := last_name(self.text[k : k + 1]):
                    self.fields[owner, self.text[j]] = found

    def members(self, lo, hi, owner):
        i = lo
        while i < hi:
            begin = i
            tags = self.tags(i, hi)
            while self.at(i) == "@":
                i += 2
                while self.at(i) == ".":
                    i += 2
                if self.at(i) == "(":
                    i = self.pair[i] + 1
            mods = []
            while (self.text[i] if i < hi else "") in _JS_MODS | {"*"} and self.at(i + 1) not in ("(", "=", ";", ":", "?", "!"):
                mods.append(self.text[i])
                i += 1
            if i >= hi:
                break
            if self.text[i] == "{":  # a static block
                self.scope(i + 1, self.pair[i], owner, None)
                i = self.pair[i] + 1
                continue
            name_at, j = i, self.jump(i)
            if self.at(j) in ("?", "!"):
                j += 1
            if self.at(j) == "<" and (end := self.generic_end(j)):
                j = end + 1
            if self.at(j) == "(" and self.kind[i] in ("id", "str", "num"):
                close, ret = self.pair[j], None
                k = close + 1
                if self.at(k) == ":":
                    low = k + 1
                    k = self.type_end(low, hi, "{")
                    ret = self.raw(low, k)
                name = self.text[i].strip("\"'")
                if self.at(k) == "{":
                    i = self.method(name_at, begin, k, owner, mods, tags, (j + 1, close), ret, name)
                    continue
                if self.language != "javascript":
                    self.skip.add(name_at)
                    if "abstract" in mods:
                        self.symbol(name_at, "method", begin, k - 1, owner, params=(j + 1, close), ret=ret, modifiers=mods, decorators=tags)
                i = k + 1
                continue
            end = self.statement_end(j, hi)
            if self.at(j) == ":":
                k = self.type_end(j + 1, end, "=")
                if found := last_name(self.text[j + 1 : k]):
                    self.fields[owner, self.text[i]] = found
                j = k
            if self.at(j) == "=" and j < end:
                made = self.callable_at(j + 1)
                if made:
                    i = max(i + 1, self.bound(name_at, begin, made, owner, "method", mods, tags))
                    continue
                if (kind := self.constructed(j + 1)) and not kind.endswith("()"):
                    self.fields.setdefault((owner, self.text[i]), kind)
                self.scope(j + 1, end, owner, None)
            i = max(end, i + 1)
            while i < hi and self.text[i] in (";", ","):
                i += 1

    def type_end(self, j, hi, stop):
        """Where a type annotation that starts at ``j`` ends: before ``stop`` outside brackets."""
        low = j
        while j < hi:
            if self.text[j] == stop and (stop != "{" or j > low and self.at(j - 1) not in ("|", "&", ":", "=>", "<", ",")):
                return j
            if self.text[j] in (";",) or self.text[j] in (")", "}", "]"):
                return j
            j = self.jump(j)
        return hi

    def method(self, name_at, begin, brace, owner, mods, tags, params=None, ret=None, name=None):
        if params is None:
            params = (name_at + 2, self.pair[name_at + 1])
        end, name = self.pair[brace], name or self.text[name_at]
        self.symbol(name_at, "constructor" if name == "constructor" else "method", begin, end, owner, name=name, params=params, ret=ret, modifiers=[m for m in mods if m != "*"], decorators=tags, exported=False)
        # parameters with an access modifier are fields
        for a, b in self.split(*params):
            if self.at(a) in ("public", "private", "protected", "readonly"):
                p = self.parameter(a, b)
                if p and p["type"]:
                    self.fields[owner, p["name"]] = last_name(re.findall(r"[\w$]+|[^\w\s]", p["type"]))
        self.scope(params[0], params[1], owner, None)
        self.scope(brace + 1, end, owner, None)
        return end + 1

    def callable_at(self, i):
        """``(params, ret, body start, body end, is block, modifiers)`` of a function expression or arrow at ``i``."""
        mods = []
        if self.at(i) == "async" and self.line[i] == self.line[min(i + 1, self.n - 1)]:
            mods, i = ["async"], i + 1
        if self.at(i) == "function":
            j = i + 1 + (self.at(i + 1) == "*")
            j += self.is_name(j)
            if self.at(j) == "<" and (end := self.generic_end(j)):
                j = end + 1
            if self.at(j) != "(":
                return None
            k, ret = self.pair[j] + 1, None
            if self.at(k) == ":":
                low, k = k + 1, self.type_end(k + 1, self.n, "{")
                ret = self.raw(low, k)
            return ((j + 1, self.pair[j]), ret, k, self.pair[k], True, mods) if self.at(k) == "{" else None
        if self.at(i) == "<" and (end := self.generic_end(i)):
            i = end + 1
        if self.is_name(i) and self.at(i + 1) == "=>":
            params, k, ret = (i, i + 1), i + 1, None
        elif self.at(i) == "(" and self.pair[i] > i:
            params, k, ret = (i + 1, self.pair[i]), self.pair[i] + 1, None
            if self.at(k) == ":":
                low = k + 1
                while k < self.n and self.text[k] not in ("=>", ";", ",", ")", "}") and k < low + 60:
                    k = self.jump(k)
                ret = self.raw(low, k)
        else:
            return None
        if self.at(k) != "=>":
            return None
        if self.at(k + 1) == "{":
            return params, ret, k + 1, self.pair[k + 1], True, mods
        return params, ret, k + 1, self.statement_end(k + 1, self.n) - 1, False, mods

    def statement_end(self, j, hi):
        """The position after an expression: at a comma, semicolon or closing bracket, or where a line ends it."""
        while j < hi:
            w = self.text[j]
            if w in (",", ";", ")", "]", "}") and self.kind[j] == "op":
                return j
            k = self.jump(j)
            if k < hi and self.line[k] > self.line[k - 1] and (self.kind[k - 1] != "op" or self.text[k - 1] in (")", "]", "}")) and (self.kind[k] in ("id", "str", "num") and self.text[k] not in ("in", "of", "instanceof", "as", "extends") or self.text[k] in ("@", "#", "{", "*")):
                return k
            j = k
        return hi

    def bound(self, name_at, begin, made, owner, kind, mods=(), tags=(), exported=False):
        params, ret, low, high, block, own = made
        self.symbol(name_at, kind, begin, max(high, low), owner, params=params, ret=ret, modifiers=[*mods, *own], decorators=list(tags), exported=exported)
        self.scope(*params, None, None)
        self.scope(low + block, high + (not block), owner, None)
        return high + 1

    def function(self, i, owner, holder):
        j = i + 1 + (self.at(i + 1) == "*")
        made = self.callable_at(i)
        if not made:
            return i + 1
        mods = self.mods(i)
        if self.is_name(j):
            return self.bound(j, i - len(mods), (*made[:5], []), None, "function", mods, exported="export" in mods)
        self.scope(*made[0], None, None)
        if "default" in mods:
            self.symbol(i, "function", i - len(mods), made[3], name="default", params=made[0], ret=made[1], modifiers=mods, exported=True)
        self.anonymous(made, owner)
        return made[3] + 1

    def anonymous(self, made, owner):
        for p in filter(None, (self.parameter(a, b) for a, b in self.split(*made[0]))):
            self.variables.append((made[0][0], made[3], p["name"], last_name(re.findall(r"[\w$]+|[^\w\s]", p["type"])) if p["type"] else None, True))
        self.scope(made[2] + 1, made[3], owner, None)

    def variable(self, i, hi, owner):
        name_at, j, kind = i + 1, i + 2, None
        if self.at(j) == "!":
            j += 1
        if self.at(j) == ":":
            k = self.type_end(j + 1, hi, "=")
            kind, j = last_name(self.text[j + 1 : k]), k
        mods, loaded = self.mods(i), False
        if self.at(j) == "=":
            if self.at(j + 1) == "class":
                return self.klass(j + 1, self.text[name_at], name_at)
            made = self.callable_at(j + 1)
            if made:
                return self.bound(name_at, i - len(mods), made, None, "function", mods, exported="export" in mods)
            loaded = self.at(j + 1) in ("require", "import") or self.at(j + 1) == "await" and self.at(j + 2) == "import"
            kind = kind or self.constructed(j + 1)
            if self.at(j + 1) == "{":
                self.variables.append((*self.around(i), self.text[name_at], self.text[name_at], True))
                self.scope(j + 1, self.pair[j + 1], owner, self.text[name_at])
                return self.pair[j + 1] + 1
        self.variables.append((*self.around(i), self.text[name_at], kind, not loaded))
        return j

    def assigned(self, i, hi, owner):
        """``a.b = function``: a function named by what it is assigned to."""
        made = self.callable_at(i + 1)
        path, k = [self.text[i - 1]], i - 2
        while self.at(k) == "." and (self.kind[k - 1] == "id"):
            path.insert(0, self.text[k - 1])
            k -= 2
        if made is None:
            if len(path) == 2 and path[0] == "this" and (kind := self.constructed(i + 1)) and not kind.endswith("()"):
                self.fields.setdefault((owner, path[1]), kind)
            if path[-2:] == ["module", "exports"] and self.at(i + 1) == "{":
                self.scope(i + 1, self.pair[i + 1], owner, None)
                return self.pair[i + 1] + 1
            return i + 1
        if len(path) == 1 or path == ["module", "exports"]:
            if self.at(i + 1) == "function" and self.is_name(i + 2):
                return i + 1
            if path == ["module", "exports"]:
                self.anonymous(made, owner) if made[4] else None
                return made[3] + 1 if made[4] else i + 1
            return self.bound(i - 1, k + 1, made, None, "function")
        holder = path[-3] if len(path) > 2 and path[-2] == "prototype" else owner if path[0] == "this" else None if path[0] in ("exports", "module") else path[-2]
        return self.bound(i - 1, k + 1, made, holder, "method" if holder else "function", exported=path[0] in ("exports", "module"))


class CReader(Reader):
    """Java, C#, C and C++."""

    def declarations(self) -> None:
        for i in range(self.n):
            if self.kind[i] == "pp" and (m := re.match(r"[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)\(([^)]*)\)", self.text[i])):
                s = self.symbol(i, "macro", i, i, name=m[1])
                names = [x.strip() for x in m[2].split(",") if x.strip()]
                s["params"], s["params_structured"] = m[2], [self.param(x.removesuffix("...") or x, rest="..." in x) for x in names]
                s["end_line"] = s["start_line"] + self.text[i].count("\n")
        self.scope(0, self.n, None, "file")

    def parameter(self, a, b):
        while self.at(a) in ("@", "[") or self.at(a) in ("final", "this", "ref", "out", "in", "params", "const"):
            if self.at(a) == "@":
                a += 2
                a = self.pair[a] + 1 if self.at(a) == "(" else a
            elif self.at(a) == "[":
                a = self.pair[a] + 1
            elif self.at(a) == "params":
                return self.parameter(a + 1, b) | {"rest": True, "optional": True} if a + 1 < b else None
            else:
                a += 1
        eq = next((j for j in range(a, b) if self.text[j] == "="), b)
        if b - a == 1 and self.text[a] == "void":
            return None
        if b - a == 1 and self.text[a] == "...":
            return self.param("...", rest=True)
        pointer = next((j for j in range(a, eq - 2) if self.text[j] == "(" and self.text[j + 1] in ("*", "&", "^") and self.kind[j + 2] == "id"), None)
        if pointer is not None:
            return self.param(self.text[pointer + 2], self.raw(a, pointer), self.raw(eq + 1, b))
        names = [j for j in range(a, eq) if self.kind[j] == "id"]
        if not names:
            return None
        at = names[-1] if len(names) > 1 or self.group in ("java", "csharp") else None
        if at is not None and self.text[at] in ("int", "char", "long", "short", "float", "double", "unsigned", "const", "bool"):
            at = None
        kind = self.raw(a, at if at is not None else eq)
        return self.param(self.text[at] if at is not None else "", kind, self.raw(eq + 1, b), "..." in self.text[a:eq])

    def prefix(self, lo, i):
        """Decorators, modifiers, type tokens of a declaration whose name is at ``i`` and whose statement begins at ``lo``."""
        tags, mods, rest, j = [], [], [], lo
        while j < i:
            w = self.text[j]
            if w == "@" and self.at(j + 1) != "interface":
                k = j + 2
                while self.at(k) == "." and k + 1 < i:
                    k += 2
                if self.at(k) == "(" and self.pair[k] < i:
                    k = self.pair[k] + 1
                tags.append(self.raw(j + 1, k).replace(" ", "") if self.at(k - 1) != ")" else self.raw(j + 1, k))
                j = k
            elif w == "[" and not rest and self.group == "csharp" and self.pair[j] < i:
                tags += [self.raw(a, b) for a, b in self.split(j + 1, self.pair[j])]
                j = self.pair[j] + 1
            elif w in _C_MODS and self.kind[j] == "id":
                mods.append(w)
                j += 1
            elif w == "template" and self.at(j + 1) == "<":
                j = (self.generic_end(j + 1) or j + 1) + 1
            elif w == "<" and not rest and (end := self.generic_end(j)) and end < i:
                j = end + 1
            else:
                if self.kind[j] != "pp":
                    rest.append(j)
                j += 1
        return tags, mods, rest

    def scope(self, lo, hi, owner, where, enum=False):
        """Declarations of a file, a type's body (``where`` its kind) or a callable's body (``where`` is ``body``)."""
        i = begin = lo
        constants = enum
        while i < hi:
            w = self.text[i]
            if self.kind[i] == "pp":
                i = begin = i + 1
                continue
            if constants and self.is_name(i) and self.at(i - 1) in ("{", ",", ")", "]") or constants and self.is_name(i) and i == lo:
                self.skip.add(i)
            if w in (";", "}", "{") and self.kind[i] == "op":
                constants = constants and w != ";"
                if w == "{" and where != "body" and self.pair[i] > i and begin < i:
                    # a property's accessors, an initializer, an enum constant's body, or a block that isn't read as a declaration
                    i = self.pair[i]
                i = begin = i + 1
                continue
            if w == ":" and self.at(i - 1) in ("public", "private", "protected") and self.group == "cpp":
                i = begin = i + 1
                continue
            if w in _TYPE_WORDS and self.kind[i] == "id" and (end := self.type_at(i, begin, hi)):
                i = begin = end
                continue
            if w == "namespace" and self.is_name(i + 1):
                i = begin = self.namespace(i)
                continue
            if w == "new" and self.is_name(i + 1):
                i = self.made(i)
                continue
            if w == "extern" and self.at(i + 1) in ('"C"', '"C++"') and self.at(i + 2) == "{":
                self.scope(i + 3, self.pair[i + 2], owner, where)
                i = begin = self.pair[i + 2] + 1
                continue
            if self.kind[i] == "id" and self.at(i + 1) == "(" and (w not in self.keywords or w == "operator"):
                end = self.callable_at(i, begin, hi, owner, where)
                if end:
                    i = begin = end
                    continue
            if self.is_name(i) and self.at(i + 1) in ("=", ";", ":", ",", ")", "(", "{", "["):
                self.variable(i, begin, owner, where, hi)
            if where != "body" and w == "=" and self.kind[i] == "op":
                j = i
                while j < hi and self.text[j] not in (";", ","):
                    if self.text[j] == "new" and self.is_name(j + 1):
                        j = self.made(j)
                        continue
                    j = self.jump(j)
                i = j
                continue
            if w in ("(", "[") and where == "body" and self.pair[i] > i:
                begin_in = i + 1
                self.scope(begin_in, self.pair[i], owner, "body")
                i = self.pair[i] + 1
                continue
            if w in ("(", "[") and where != "body":
                i = self.jump(i)
                continue
            i += 1

    def namespace(self, i):
        j = i + 1
        while self.at(j) not in ("{", ";", "") and j < i + 20:
            j += 1
        if self.at(j) == "{":
            self.symbol(i + 1, "namespace", i, self.pair[j], name=self.raw(i + 1, j))
            self.scope(j + 1, self.pair[j], None, "file")
            return self.pair[j] + 1
        return j + 1

    def made(self, i):
        """``new X(...) { ... }``: members of an anonymous class."""
        j = i + 2
        while self.at(j) in (".", "::"):
            j += 2
        name = self.text[j - 1]
        if self.at(j) == "<" and (end := self.generic_end(j)):
            j = end + 1
        if self.at(j) != "(":
            return i + 1
        close = self.pair[j]
        self.scope(j + 1, close, None, "body")
        if self.at(close + 1) == "{" and self.group == "java":
            self.scope(close + 2, self.pair[close + 1], name, "class")
            return self.pair[close + 1] + 1
        return close + 1

    def type_at(self, i, begin, hi):
        kind, name_at = self.text[i], i + 1
        if kind == "enum" and self.at(name_at) in ("class", "struct"):
            name_at += 1
        if kind == "record" and self.at(name_at) in ("class", "struct"):
            name_at += 1
        if not self.is_name(name_at) or self.at(i - 1) in (".", "<", ",") and self.group in ("java", "cpp"):
            return None
        j, group, bases, params = name_at + 1, [], [], None
        if self.at(j) not in ("{", ":", "extends", "implements", "permits", "<", "final", "(", "where", ";") or self.at(j) == "(" and kind != "record" or self.at(j) == ";" and kind != "record":
            return None
        listing = None
        while j < hi and self.text[j] not in ("{", ";"):
            w = self.text[j]
            if w == "<" and (end := self.generic_end(j)):
                j = end + 1
                continue
            if w == "(":
                if listing is None:
                    params = (j + 1, self.pair[j])
                j = self.pair[j] + 1
                continue
            if w in ("extends", "implements", "permits", ":", "where"):
                if listing not in (None, "permits", "where"):
                    bases.append(last_name(group))
                listing, group = w, []
            elif w == ",":
                if listing not in ("permits", "where"):
                    bases.append(last_name(group))
                group = []
            elif w not in ("public", "private", "protected", "virtual"):
                group.append(w)
            j += 1
        if listing not in (None, "permits", "where"):
            bases.append(last_name(group))
        tags, mods, _ = self.prefix(begin, i)
        end = self.pair[j] if self.at(j) == "{" else j
        if j >= hi or end < 0:
            return None
        kinds = [t.split("(")[0].lower() for t in tags] if self.group == "java" else []
        s = self.symbol(name_at, {"union": "struct"}.get(kind, kind), begin, end, params=params, modifiers=mods + kinds, decorators=tags, bases=bases, exported="public" in mods)
        for p in s["params_structured"] or ():
            if p["type"]:
                self.fields[s["name"], p["name"]] = last_name(re.findall(r"\w+|[^\w\s]", p["type"]))
        if self.at(j) == "{":
            self.scope(j + 1, end, s["name"], kind, kind == "enum" and self.group in ("java",))
        return end + 1

    def callable_at(self, i, begin, hi, owner, where):
        """Read a definition whose name is at ``i``; where it ends, or None if it is no definition."""
        close = self.pair[i + 1]
        if close < 0 or close >= hi:
            return None
        tags, mods, rest = self.prefix(begin, i)
        words = [self.text[k] for k in rest]
        name, holder, exact = self.text[i], owner, owner is not None and self.text[i] == owner
        if self.at(i - 1) == "~":
            name, rest, words, exact = "~" + name, rest[:-1], words[:-1], True
        if self.group == "cpp" and len(words) >= 2 and words[-1] == "::":
            holder = words[-2] if words[-2] != ">" else None
            if holder is None:
                k = rest[-2]
                depth = 0
                while k > begin:
                    depth += (self.text[k] == ">") - (self.text[k] == "<")
                    k -= 1
                    if not depth:
                        break
                holder = self.text[k]
            words = words[: words.index(holder)] if holder in words else words[:-2]
            exact = exact or name.lstrip("~") == holder
        if not words and not exact or "=" in words or words[:1] and words[0] in ("return", "new", "throw", "else", "delete", "case", "goto", "await", "yield", "using", "typedef") or self.at(i - 1) in (".", "->") and self.group != "csharp":
            return None
        if words and not (words[-1] in (">", "*", "&", "]", "&&", "?") or re.match(r"[A-Za-z_]", words[-1])) or any(w in ("(", "+", "-", "==", "<<", ",") and "<" not in words for w in words):
            return None
        if where == "body" and self.group != "csharp":
            return None
        j, arrow = close + 1, None
        while j < hi and self.text[j] not in ("{", ";"):
            w = self.text[j]
            if w == "=>":
                arrow = j
                break
            if w == ":" and self.group in ("cpp", "csharp"):
                j = self.initializers(j + 1)
                continue
            if w == "=" and self.at(j + 1) in ("0", "default", "delete"):
                j += 2
                continue
            if w in ("const", "noexcept", "override", "final", "volatile", "throws", "throw", "->", "where", "&", "&&", ",", ".", "::", ":", "<", ">", "default", "__attribute__", "[", "mutable", "try") or self.kind[j] == "id" and self.text[close + 1] in ("throws", "where", "->", "const", "noexcept", "override", "final", "__attribute__", "default", "&", "&&") or w == "(" or self.kind[j] in ("num", "str") and self.group == "java":
                j = self.jump(j)
                continue
            return None
        if j >= hi:
            return None
        kinds = [t.split("(")[0].lower() for t in tags] if self.group == "java" else []
        ret = None if exact else self.raw(rest[0], i) if rest and self.group != "cpp" else " ".join(words)
        kind = "function" if holder is None else "constructor" if exact and not name.startswith("~") else "method"
        if self.at(j) == ";" and arrow is None:
            declared = self.group in ("java", "csharp") and where not in ("file", "body")
            if not declared:
                # a prototype, or a variable made by a constructor
                if where != "body":
                    self.skip.add(i)
                return j + 1 if where != "body" else None
            self.symbol(i, kind, begin, j, holder, name=name, params=(i + 2, close), ret=ret, modifiers=mods + kinds + (["abstract"] if where == "interface" else []), decorators=tags, exported="public" in mods or where == "interface")
            return j + 1
        if arrow is not None:
            end = arrow
            while end < hi and self.text[end] != ";":
                end = self.jump(end)
            low, high = arrow + 1, end
        else:
            low, high = j + 1, self.pair[j]
        if high < 0:
            return None
        exported = "public" in mods or (self.group in ("c", "cpp") and "static" not in mods and where == "file") or (where == "interface" and self.group == "java")
        self.symbol(i, kind, begin, high, holder, name=name, params=(i + 2, close), ret=ret, modifiers=mods + kinds, decorators=tags, exported=exported)
        self.scope(low, high, holder, "body")
        return high + 1

    def initializers(self, j):
        """After the member initializers that start at ``j``."""
        while j < self.n:
            while self.at(j) not in ("(", "{", ";", "") and self.text[j] != "=>":
                j = (self.generic_end(j) or j) + 1 if self.text[j] == "<" else j + 1
            if self.at(j) == "{" and self.kind[j - 1] != "id" and self.at(j - 1) != ">" or self.at(j) not in ("(", "{"):
                return j
            j = self.pair[j] + 1 if self.pair[j] > j else j + 1
            if self.at(j) != ",":
                return j
            j += 1
        return j

    def variable(self, i, begin, owner, where, hi):
        """A declared field or local with the type before its name."""
        if self.at(i - 1) == "(" and begin < i:
            begin = i
        _, mods, rest = self.prefix(begin, i)
        words = [self.text[k] for k in rest]
        if words and words[0] in ("for", "foreach", "using", "try", "if", "while", "catch", "case", "return", "throw", "else", "new", "await", "goto", "package", "import", "operator"):
            return
        if not words or not (words[-1] in (">", "*", "&", "]", "?") or re.match(r"[A-Za-z_]", words[-1])) or words[-1] in (".", "::") or any(w in ("=", "(", "+", "==", "return", "?") and w != words[-1] for w in words):
            return
        kind = last_name(words)
        if kind in ("var", "auto", "const") or kind is None:
            kind = self.constructed(i + 2) if self.at(i + 1) in ("=", ":") else None
        if self.at(i + 1) == "(":
            if self.group != "cpp" or where == "file":
                return
            self.skip.add(i)
        if where in ("file", "body"):
            span = self.body_span(i) if where == "body" else (0, self.n - 1)
            self.variables.append((*span, self.text[i], kind, self.group in ("c", "cpp") or where == "body"))
        elif kind and not kind.endswith("()"):
            self.fields[owner, self.text[i]] = kind

    def body_span(self, i):
        best = (0, self.n - 1)
        for s, (a, b) in zip(self.symbols, self.spans):
            if s["family"] == "callable" and a <= i <= b and b - a <= best[1] - best[0]:
                best = (a, b)
        return best

    def is_declared_call(self, i):
        """``Type name(``: a declaration, not a call."""
        prev = self.at(i - 1)
        return self.kind[i - 1] == "id" and prev not in self.keywords and prev not in SELF if i else False


class GoReader(Reader):
    def declarations(self) -> None:
        i = 0
        while i < self.n:
            w = self.text[i]
            if self.kind[i] == "id" and w == "func":
                i = self.function(i)
            elif self.kind[i] == "id" and w == "type" and self.at(i - 1) != ".":
                i = self.types(i)
            elif w == "var" and self.is_name(i + 1) and self.at(i - 1) != ".":
                self.variables.append((0, self.n - 1, self.text[i + 1], None if self.at(i + 2) == "=" else last_name(self.text[i + 2 : i + 5][: 1 + (self.at(i + 2) == "*") + 2 * (self.at(i + 3) == ".")]), False))
                i += 2
            else:
                i = self.jump(i) if w in ("{", "(") else i + 1

    def parameter(self, a, b):
        if b - a == 1 or self.at(a + 1) == "." and b - a == 3:
            return self.param(self.text[a])
        return self.param(self.text[a], self.raw(a + 1, b).removeprefix("..."), rest=self.at(a + 1) == "...")

    def _params(self, a, b):
        """Names of one type share it."""
        parts = self.split(a, b)
        named = any(y - x > 1 and self.kind[x] == "id" and self.at(x + 1) != "." for x, y in parts)
        out, kind, rest = [], None, False
        for x, y in reversed(parts):
            if named and y - x == 1:
                out.append(self.param(self.text[x], kind, rest=rest))
            elif named:
                p = self.parameter(x, y)
                kind, rest = p["type"], False
                out.append(p)
            else:
                out.append(self.param("", self.raw(x, y).removeprefix("..."), rest=self.at(x) == "..."))
        return out[::-1]

    def types(self, i):
        if self.at(i + 1) == "(":
            j = i + 2
            while j < self.pair[i + 1]:
                j = self.one_type(j, j) if self.is_name(j) and self.line[j] > self.line[j - 1] else self.jump(j)
            return self.pair[i + 1] + 1
        return self.one_type(i + 1, i) if self.is_name(i + 1) else i + 1

    def one_type(self, name_at, first):
        name, j = self.text[name_at], name_at + 1
        if self.at(j) == "[" and self.is_name(j + 1) and self.at(self.pair[j] + 1) in ("struct", "interface"):
            j = self.pair[j] + 1
        kind = self.at(j) if self.at(j) in ("struct", "interface") else "type"
        if kind == "type":
            end = j
            while end + 1 < self.n and self.line[end + 1] == self.line[name_at]:
                end = min(self.jump(end), self.n - 1) if self.jump(end) > end + 1 else end + 1
            self.symbol(name_at, "type", first, end, bases=[], exported=name[:1].isupper())
            return end + 1
        brace, bases = j + 1, []
        end = self.pair[brace] if self.at(brace) == "{" else brace
        k = brace + 1
        while k < end:
            stop = k
            while stop + 1 < end and self.line[stop + 1] == self.line[k]:
                stop = max(stop + 1, min(self.jump(stop + 1) - 1, end - 1))
            parts = [x for x in range(k, stop + 1) if self.kind[x] != "str" and self.text[x] != ";"]
            words = [self.text[x] for x in parts]
            if words and (re.fullmatch(r"\*?(\w+\.)?\w+", "".join(words)) and len([w for w in words if re.match(r"\w", w)]) <= 1 + ("." in words)):
                bases.append(last_name(words))
                self.fields[name, bases[-1]] = bases[-1]
            elif kind == "struct" and len(words) > 1:
                first_type = next((x for x in range(len(words)) if x and words[x] != "," and words[x - 1] != ","), 1)
                found = last_name(words[first_type:]) if words[first_type] not in ("[", "map", "func", "chan") else None
                for w in words[:first_type]:
                    if found and w != ",":
                        self.fields[name, w] = found
            elif kind == "interface" and len(parts) > 1 and self.at(parts[0] + 1) == "(":
                self.skip.add(parts[0])
            k = stop + 1
        self.symbol(name_at, kind, first, end, bases=bases, exported=name[:1].isupper())
        return end + 1

    def function(self, i):
        j, owner, receiver = i + 1, None, None
        if self.at(j) == "(" and self.is_name(self.pair[j] + 1) and self.at(self.pair[j] + 2) in ("(", "["):
            own = [k for k in range(j + 1, self.pair[j]) if self.is_name(k)]
            star = "*" in self.text[j + 1 : self.pair[j]]
            bracket = next((k for k in range(j + 1, self.pair[j]) if self.text[k] == "["), self.pair[j])
            own = [k for k in own if k < bracket]
            if own:
                owner, receiver = self.text[own[-1]], self.text[own[0]] if len(own) > 1 else None
            j, method = self.pair[j] + 1, ("*" if star else "") + (owner or "")
        else:
            method = None
        if not self.is_name(j):
            return i + 1
        name_at, j = j, j + 1
        if self.at(j) == "[":
            j = self.pair[j] + 1
        if self.at(j) != "(":
            return i + 1
        params, close = (j + 1, self.pair[j]), self.pair[j]
        k, low = close + 1, close + 1
        while k < self.n and self.text[k] != "{" and self.line[k] == self.line[max(low - 1, k - 1)]:
            if self.text[k] in ("interface", "struct") and self.at(k + 1) == "{":
                k = self.pair[k + 1] + 1
                continue
            k = self.jump(k)
        body = self.at(k) == "{" and self.line[k] == self.line[k - 1]
        end = self.pair[k] if body else close
        name = self.text[name_at]
        s = self.symbol(name_at, "method" if owner else "function", i, end, owner, ret=self.raw(low, k) if k > low else None, exported=name[:1].isupper(), receiver=method)
        s["params"], s["params_structured"] = self.raw(*params), self._params(*params)
        for p in s["params_structured"]:
            self.variables.append((i, end, p["name"], last_name(re.findall(r"\w+|[^\w\s]", p["type"])) if p["type"] and p["type"][0] not in "[mf" or p["type"] and re.match(r"[mf]\w*$", p["type"]) else None, True))
        if receiver:
            self.variables.append((i, end, receiver, owner, True))
        if body:
            self.locals(k + 1, end, i)
        return end + 1

    def locals(self, lo, hi, first):
        for j in range(lo, hi):
            if self.text[j] == ":=":
                k = j - 1
                names = []
                while k >= lo and (self.is_name(k) or self.text[k] == ","):
                    if self.is_name(k):
                        names.insert(0, self.text[k])
                    k -= 1
                kind = self.constructed(j + 1)
                for n, name in enumerate(names):
                    self.variables.append((first, hi, name, kind if not n else None, True))
            elif self.text[j] == "var" and self.is_name(j + 1):
                k = j + 2 + (self.at(j + 2) == "*")
                found = self.constructed(k + 1) if self.at(k) == "=" else self.text[k + 2] if self.at(k + 1) == "." and self.is_name(k + 2) else self.text[k] if self.is_name(k) else None
                self.variables.append((first, hi, self.text[j + 1], found, True))


class RustReader(Reader):
    def declarations(self) -> None:
        self.scope(0, self.n, None, False)

    def parameter(self, a, b):
        words = self.text[a:b]
        if "self" in words and ":" not in words[: words.index("self") + 1]:
            return self.param("self")
        while self.at(a) == "#":
            a = self.pair[a + 1] + 1
        a += self.at(a) == "mut"
        colon = next((j for j in range(a, b) if self.text[j] == ":"), b)
        return self.param(self.raw(a, colon), self.raw(colon + 1, b))

    def scope(self, lo, hi, owner, trait):
        i, tags, begin = lo, [], lo
        while i < hi:
            w = self.text[i]
            if w == "#" and self.at(i + 1) == "[":
                begin = begin if tags else i
                tags.append(self.raw(i + 2, self.pair[i + 1]))
                i = self.pair[i + 1] + 1
                continue
            if w == "#" and self.at(i + 1) == "!":
                i = self.pair[i + 2] + 1 if self.at(i + 2) == "[" else i + 2
                continue
            start = begin if tags else i
            if self.kind[i] == "id" and w in ("pub", "async", "unsafe", "const", "extern", "default"):
                mods, j = [], i
                while self.at(j) in ("pub", "async", "unsafe", "const", "extern", "default") or self.kind[j] == "str":
                    mods.append("pub" if self.text[j] == "pub" else self.text[j])
                    j += 1
                    if mods[-1] == "pub" and self.at(j) == "(":
                        j = self.pair[j] + 1
                end = self.item(j, start, hi, mods, tags, owner, trait)
            else:
                end = self.item(i, start, hi, [], tags, owner, trait)
            if end:
                i, tags = end, []
                begin = i
                continue
            if self.kind[i] == "id" and w == "let":
                self.let(i, hi)
            if w not in ("pub", "async", "unsafe", "const", "extern"):
                tags = []
            i += 1

    def let(self, i, hi):
        j = i + 1 + (self.at(i + 1) == "mut")
        if not self.is_name(j):
            return
        kind, k = None, j + 1
        if self.at(k) == ":":
            low = k + 1
            while k < hi and self.text[k] not in ("=", ";"):
                k += 1
            kind = self.own_type(self.text[low:k])
        if self.at(k) == "=" and kind is None:
            kind = self.constructed(k + 1)
        best = (0, self.n - 1)
        for s, (a, b) in zip(self.symbols, self.spans):
            if s["family"] == "callable" and a <= i <= b and b - a <= best[1] - best[0]:
                best = (a, b)
        self.variables.append((*best, self.text[j], kind, True))

    @staticmethod
    def own_type(words):
        """The type within smart pointers and references."""
        words = [w for w in words if not w.startswith("'")]
        while len(words) > 3 and words[0] in ("Box", "Rc", "Arc", "RefCell", "Mutex") and words[1] == "<":
            words = words[2:-1]
        return last_name(words)

    def item(self, i, start, hi, mods, tags, owner, trait):
        w, kinds = self.at(i), [t.split("(")[0] if not t.startswith("cfg") else t for t in tags]
        public = "pub" in mods
        if w == "fn" and self.is_name(i + 1):
            j = i + 2
            if self.at(j) == "<" and (end := self.generic_end(j)):
                j = end + 1
            if self.at(j) != "(":
                return None
            params, k = (j + 1, self.pair[j]), self.pair[j] + 1
            low = k + 1 if self.at(k) == "->" else k
            while k < hi and self.text[k] not in ("{", ";", "where"):
                k = self.jump(k)
            ret = self.raw(low, k) if k > low else None
            while k < hi and self.text[k] not in ("{", ";"):
                k = self.jump(k)
            end = self.pair[k] if self.at(k) == "{" else k
            s = self.symbol(i + 1, "method" if owner else "function", start, min(end, self.n - 1), owner, params=params, ret=ret, modifiers=mods + kinds, decorators=tags, exported=public or bool(trait))
            for p in s["params_structured"]:
                if p["type"]:
                    self.variables.append((start, end, p["name"], self.own_type(re.findall(r"\w+|[^\w\s]", p["type"])), True))
            if self.at(k) == "{":
                self.scope(k + 1, end, None, False)
                for x in range(len(self.symbols) - 1, -1, -1):
                    if self.symbols[x] is s:
                        break
            return end + 1
        if w in ("struct", "enum", "trait", "union") and self.is_name(i + 1):
            j, bases, listing = i + 2, [], False
            name = self.text[i + 1]
            while j < hi and self.text[j] not in ("{", ";", "("):
                if self.text[j] == "<" and (end := self.generic_end(j)):
                    j = end + 1
                    continue
                if self.text[j] == "where":
                    listing = False
                if listing and self.is_name(j) and self.at(j + 1) != "::":
                    bases.append(self.text[j])
                listing = listing or self.text[j] == ":" and w == "trait"
                j += 1
            end = self.pair[j] if self.at(j) in ("{", "(") else j
            self.symbol(i + 1, {"union": "struct"}.get(w, w), start, min(end, self.n - 1), modifiers=mods + kinds, decorators=tags, bases=bases, exported=public)
            if w == "trait" and self.at(j) == "{":
                self.scope(j + 1, end, name, True)
            elif self.at(j) == "{":
                for a, b in self.split(j + 1, end):
                    while self.at(a) == "#":
                        a = self.pair[a + 1] + 1
                    a += self.at(a) == "pub"
                    if self.at(a) == "(":
                        a = self.pair[a] + 1
                    if w == "struct" and self.at(a + 1) == ":" and (found := self.own_type(self.text[a + 2 : b])):
                        self.fields[name, self.text[a]] = found
                    if w == "enum":
                        self.skip.add(a)
            return end + 1
        if w == "impl":
            j, groups, current = i + 1, [], []
            if self.at(j) == "<" and (end := self.generic_end(j)):
                j = end + 1
            while j < hi and self.text[j] not in ("{", "where", ";"):
                if self.text[j] == "<" and (end := self.generic_end(j)):
                    j = end + 1
                    continue
                if self.text[j] == "for":
                    groups.append(current)
                    current = []
                else:
                    current.append(j)
                j += 1
            while j < hi and self.text[j] != "{":
                j = self.jump(j)
            names = [k for k in current if self.is_name(k)]
            if not names or self.at(j) != "{":
                return None
            name, end = self.text[names[-1]], self.pair[j]
            self.symbol(names[-1], "impl", start, end, decorators=tags, modifiers=kinds, bases=[last_name([self.text[k] for k in groups[0]])] if groups else [])
            self.scope(j + 1, end, name, bool(groups))
            return end + 1
        if w == "mod" and self.is_name(i + 1) and self.at(i + 2) == "{":
            self.symbol(i + 1, "namespace", start, self.pair[i + 2], modifiers=mods + kinds, decorators=tags, exported=public)
            self.scope(i + 3, self.pair[i + 2], None, False)
            return self.pair[i + 2] + 1
        if w == "macro_rules" and self.at(i + 1) == "!" and self.is_name(i + 2):
            end = self.pair[i + 3] if self.at(i + 3) in ("{", "(") else i + 3
            self.symbol(i + 2, "macro", start, end, decorators=tags)
            self.skip.update(range(i + 3, end))
            return end + 1
        return None


READERS = {"javascript": JsReader, "java": CReader, "csharp": CReader, "c": CReader, "cpp": CReader, "go": GoReader, "rust": RustReader}
