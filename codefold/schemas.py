"""The fact relations: what sources produce and operators read."""

from __future__ import annotations

FILES = "file string, rel string, dir string, language string, lines int, hash string, size long, is_test boolean, is_bundled boolean, is_generated boolean"
LINES = "file string, line int, text string"
PARAMS = "array<struct<name:string,type:string,optional:boolean,`default`:string,rest:boolean,keyword_only:boolean,positional_only:boolean>>"
SYMBOLS = f"symbol_id string, name string, kind string, family string, file string, rel string, language string, start_line int, end_line int, name_line int, owner string, receiver string, params string, params_structured {PARAMS}, return_type string, modifiers array<string>, decorators array<string>, bases array<string>, is_async boolean, is_exported boolean, entry_kind string, docstring string, complexity int, nesting int"
CALLS = "file string, line int, seq int, name string, resolved_names array<string>, is_method boolean, receiver string, receiver_type string, arg_count int, arg_spread boolean, keywords array<string>, first_string_arg string, first_string_interp boolean, options_method string, is_function_ref boolean, local_shadow boolean, awaited boolean, handled boolean, assigned_to string, in_loop boolean, in_try boolean, enclosing_name string, enclosing_start int, shape string"
USAGES = "file string, line int, col int, name string, usage_type string, receiver string"
IMPORTS = "file string, module string, names array<string>, aliases array<string>, type string, line int, dynamic boolean"
EXPORTS = "file string, name string, type string, line int, source string, alias string"
ISSUES = "rel string, kind string, reason string, language string"

RELATIONS = {"files": FILES, "lines": LINES, "symbols": SYMBOLS, "calls": CALLS, "usages": USAGES, "imports": IMPORTS, "exports": EXPORTS, "file_issues": ISSUES}

#: Kinds by family.
TYPE_KINDS = ("class", "struct", "interface", "type", "impl", "enum", "record", "trait", "namespace")
CALLABLE_KINDS = ("function", "method", "constructor", "macro")
