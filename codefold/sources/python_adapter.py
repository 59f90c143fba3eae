"""Facts of Python sources from the standard parser."""

from __future__ import annotations

import ast

_LOOPS = (ast.For, ast.AsyncFor, ast.While, ast.comprehension, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.BoolOp, ast.Match, ast.comprehension)


def _dotted(node) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _dotted(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    if isinstance(node, ast.Call):
        base = _dotted(node.func)
        return f"{base}()" if base else None
    return None


def _text(node) -> str | None:
    return ast.unparse(node) if node is not None else None


def _params(a: ast.arguments) -> list[dict]:
    plain = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)

    def one(arg, default=None, rest=False, keyword=False, positional=False):
        return {"name": arg.arg, "type": _text(arg.annotation), "optional": default is not None or rest, "default": _text(default), "rest": rest, "keyword_only": keyword, "positional_only": positional}

    out = [one(x, d, positional=x in a.posonlyargs) for x, d in zip(plain, defaults)]
    if a.vararg:
        out.append(one(a.vararg, rest=True))
    out += [one(x, d, keyword=True) for x, d in zip(a.kwonlyargs, a.kw_defaults)]
    if a.kwarg:
        out.append(one(a.kwarg, rest=True, keyword=True))
    return out


def _complexity(node) -> tuple[int, int]:
    count, deepest = 0, 0

    def walk(n, depth):
        nonlocal count, deepest
        for child in ast.iter_child_nodes(n):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                continue
            step = isinstance(child, _BRANCHES)
            count += step
            deepest = max(deepest, depth + step)
            walk(child, depth + step)

    walk(node, 0)
    return count, deepest


def entry_kind(name: str, owner: str | None, decorators: list[str]) -> str | None:
    if name.startswith("test_") or name in ("setUp", "tearDown", "setUpClass", "tearDownClass") or any(d.startswith("pytest.") for d in decorators):
        return "test"
    if owner and name.startswith("__") and name.endswith("__"):
        return "framework"
    return None


class _Visitor(ast.NodeVisitor):
    def __init__(self):
        self.symbols, self.calls, self.usages, self.imports, self.exports = [], [], [], [], []
        self.owners, self.functions, self.locals, self.loops, self.tries = [], [], [], 0, 0
        self.aliases, self.types, self.seq, self.held = {}, [{}], 0, {}

    def _define(self, node, kind, **more):
        decorators = [_text(d) for d in node.decorator_list]
        owner = self.owners[-1] if self.owners and not (self.functions and self.functions[-1][2] >= len(self.owners)) else None
        complexity, nesting = _complexity(node)
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        self.symbols.append({
            "name": node.name, "kind": kind, "family": "type" if kind == "class" else "callable", "start_line": start, "end_line": node.end_lineno, "name_line": node.lineno, "owner": owner, "receiver": None, "decorators": decorators,
            "modifiers": ["async"] if isinstance(node, ast.AsyncFunctionDef) else [], "is_async": isinstance(node, ast.AsyncFunctionDef), "docstring": (ast.get_docstring(node) or "").split("\n")[0] or None, "complexity": complexity, "nesting": nesting,
            "entry_kind": entry_kind(node.name, owner, decorators) if kind != "class" else None, "is_exported": not node.name.startswith("_"), **more,
        })
        self.usages.append((node.lineno, node.col_offset, node.name, "definition", None))

    def visit_ClassDef(self, node):
        self._define(node, "class", params=None, params_structured=None, return_type=None, bases=[b for b in map(_dotted, node.bases) if b])
        for d in [*node.decorator_list, *node.bases, *node.keywords]:
            self.visit(d)
        self.owners.append(node.name)
        for child in node.body:
            self.visit(child)
        self.owners.pop()

    def _function(self, node):
        method = bool(self.owners) and not (self.functions and self.functions[-1][2] >= len(self.owners))
        self._define(node, "method" if method else "function", params=_text(node.args), params_structured=_params(node.args), return_type=_text(node.returns), bases=[])
        for d in [*node.decorator_list, *node.args.defaults, *(x for x in node.args.kw_defaults if x)]:
            self.visit(d)
        own = {a.arg for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]} | {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
        typed = {a.arg: _dotted(a.annotation) for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs] if a.annotation is not None}
        self.functions.append((node.name, min([node.lineno, *(d.lineno for d in node.decorator_list)]), len(self.owners), isinstance(node, ast.AsyncFunctionDef)))
        self.locals.append(own)
        self.types.append(typed)
        held, self.loops, self.tries = (self.loops, self.tries), 0, 0
        for child in node.body:
            self.visit(child)
        self.loops, self.tries = held
        self.functions.pop()
        self.locals.pop()
        self.types.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def _loop(self, node):
        self.loops += 1
        self.generic_visit(node)
        self.loops -= 1

    visit_For = visit_AsyncFor = visit_While = _loop

    def visit_Try(self, node):
        self.tries += 1
        self.generic_visit(node)
        self.tries -= 1

    def visit_Await(self, node):
        self.held[id(node.value)] = "awaited"
        if isinstance(node.value, ast.Call):
            for a in ast.walk(node.value):
                if isinstance(a, ast.Call) and a is not node.value:
                    self.held.setdefault(id(a), "handled")
        self.generic_visit(node)

    def _handled(self, node):
        if node.value is not None:
            self.held.setdefault(id(node.value), "handled")
        self.generic_visit(node)

    visit_Return = visit_Yield = visit_YieldFrom = _handled

    def visit_Assign(self, node):
        name = _dotted(node.targets[0])
        self.held.setdefault(id(node.value), f"={name or '_'}")
        if isinstance(node.value, ast.Call) and isinstance(node.targets[0], ast.Name) and (made := _dotted(node.value.func)) and made.rpartition(".")[2][:1].isupper():
            self.types[-1][name] = made.rpartition(".")[2]
        if not self.functions and not self.owners:
            for target in node.targets:
                if isinstance(target, ast.Name):
                    if target.id == "__all__" and isinstance(node.value, (ast.List, ast.Tuple)):
                        self.exports += [(e.value, "__all__", node.lineno, None, None) for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
                    self.symbols.append({"name": target.id, "kind": "constant" if target.id.isupper() else "variable", "family": "state", "start_line": node.lineno, "end_line": node.end_lineno, "name_line": node.lineno, "is_exported": not target.id.startswith("_")})
        self.generic_visit(node)

    def visit_Import(self, node):
        for a in node.names:
            self.imports.append((a.name, [a.asname or a.name.split(".")[0]], [a.asname or ""], "import", node.lineno, False))
            self.usages.append((node.lineno, node.col_offset, (a.asname or a.name).split(".")[-1], "import", None))

    def visit_ImportFrom(self, node):
        self.imports.append(("." * node.level + (node.module or ""), [a.name for a in node.names], [a.asname or "" for a in node.names], "from", node.lineno, False))
        for a in node.names:
            if a.asname and a.asname != a.name:
                self.aliases[a.asname] = a.name
            self.usages.append((node.lineno, node.col_offset, a.name, "import", None))

    def _site(self, node, name, receiver, **more):
        self.seq += 1
        f = self.functions[-1] if self.functions else (None, None, 0, False)
        kind = self.types[-1].get(receiver) or self.types[0].get(receiver)
        self.calls.append({
            "line": node.lineno, "seq": self.seq, "name": name, "resolved_names": [self.aliases[name]] if receiver is None and name in self.aliases else [], "is_method": receiver is not None, "receiver": receiver, "receiver_type": kind,
            "local_shadow": receiver is None and any(name in own for own in self.locals), "in_loop": self.loops > 0, "in_try": self.tries > 0, "enclosing_name": f[0], "enclosing_start": f[1], **more,
        })

    def visit_Call(self, node):
        func = node.func
        receiver = _dotted(func.value) if isinstance(func, ast.Attribute) else None
        name = func.attr if isinstance(func, ast.Attribute) else func.id if isinstance(func, ast.Name) else None
        if name:
            if isinstance(func, ast.Attribute) and receiver is None:
                receiver = "<expr>"
            held = self.held.get(id(node), "")
            first = node.args[0] if node.args else None
            literal = first.value if isinstance(first, ast.Constant) and isinstance(first.value, str) else None
            interp = isinstance(first, ast.JoinedStr)
            if interp:
                literal = "".join(v.value if isinstance(v, ast.Constant) else "*" for v in first.values)
            plain = [a for a in node.args if not isinstance(a, ast.Starred)]
            spread = len(plain) < len(node.args) or any(k.arg is None for k in node.keywords)
            option = next((k.value.value for k in node.keywords if k.arg == "method" and isinstance(k.value, ast.Constant)), None)
            shape = ",".join([type(a).__name__ for a in node.args] + [f"{k.arg or '**'}=" for k in node.keywords])
            at = func.end_lineno or node.lineno
            self.usages.append((at, func.end_col_offset - len(name), name, "call", receiver))
            self._site(func, name, receiver, arg_count=len(plain), arg_spread=spread, keywords=[k.arg for k in node.keywords if k.arg], first_string_arg=literal, first_string_interp=interp, options_method=option, is_function_ref=False, awaited=held == "awaited", handled=held == "handled", assigned_to=held[1:] if held.startswith("=") else None, shape=shape)
            self.calls[-1]["line"] = at
            if receiver in ("asyncio", "loop") and name in ("gather", "create_task", "ensure_future", "wait", "run", "wait_for"):
                for a in ast.walk(node):
                    if isinstance(a, ast.Call) and a is not node:
                        self.held.setdefault(id(a), "handled")
        for a in [*node.args, *(k.value for k in node.keywords)]:
            if isinstance(a, ast.Name) and not any(a.id in own for own in self.locals):
                self._site(a, a.id, None, arg_count=None, arg_spread=False, keywords=[], first_string_arg=None, first_string_interp=False, options_method=None, is_function_ref=True, awaited=False, handled=False, assigned_to=None, shape="ref")
        self.generic_visit(node)

    def visit_Name(self, node):
        self.usages.append((node.lineno, node.col_offset, node.id, "reference", None))

    def visit_Attribute(self, node):
        self.usages.append((node.end_lineno, node.end_col_offset - len(node.attr), node.attr, "reference", _dotted(node.value)))
        self.generic_visit(node)


def extract(text: str) -> dict:
    """Facts of one file; raises SyntaxError where it can't be parsed."""
    v = _Visitor()
    v.visit(ast.parse(text))
    best = {}
    rank = {"call": 0, "import": 1, "definition": 2, "reference": 3}
    for line, col, name, kind, receiver in v.usages:
        key = line, col, name
        if key not in best or rank[kind] < rank[best[key][0]]:
            best[key] = kind, receiver
    return {
        "symbols": v.symbols,
        "calls": v.calls,
        "usages": [{"line": k[0], "col": k[1], "name": k[2], "usage_type": x[0], "receiver": x[1]} for k, x in best.items()],
        "imports": [dict(zip(("module", "names", "aliases", "type", "line", "dynamic"), r)) for r in v.imports],
        "exports": [dict(zip(("name", "type", "line", "source", "alias"), r)) for r in v.exports],
    }
