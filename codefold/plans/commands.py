"""The public commands: each a function of a catalog and its parameters, giving lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefold.functions.text import matches_filters
from codefold.operators import account as A
from codefold.operators import audits, edges, graph, imports, reporting, search, stacktrace, symbols, web
from codefold.sources import repo


class Catalog:
    """The fact relations of one index, and what is derived from them, each once."""

    def __init__(self, relations: dict[str, DataFrame], roots: dict[str, str] | None = None):
        self.r, self.roots = relations, roots or {}
        self.spark: SparkSession = relations["files"].sparkSession

    @classmethod
    def of_tree(cls, spark: SparkSession, root: str, index_path: str, roots: dict[str, str] | None = None, **limits) -> Catalog:
        """Index a source tree into ``index_path`` and open it."""
        files, issues = repo.source_files(spark, root, **limits)
        repo.save(repo.facts(files), index_path)
        gaps = graph.cut(repo.gap_lines(spark, root, issues), f"{index_path}/_gaps")
        return cls(repo.relations(repo.load(spark, index_path), issues) | {"gap_lines": gaps}, roots)

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("files", "lines", "symbols", "calls", "usages", "imports", "exports", "file_issues"):
            return self.r[name]
        if name == "gap_lines":
            return self.r.get(name, self.r["lines"].select("file", "line", "text").limit(0))
        raise AttributeError(name)

    @cached_property
    def import_edges(self) -> DataFrame:
        return imports.import_edges(self.imports, self.files, self.roots)

    @cached_property
    def inherit(self) -> DataFrame:
        return imports.inheritance(self.symbols)

    @cached_property
    def edges(self) -> DataFrame:
        """Resolved calls, written once to the shared folder: every command reads them."""
        found = edges.resolve_calls(self.calls, self.symbols, self.import_edges.filter("dst IS NOT NULL"), edges.ancestors(self.inherit), self.files, bound=imports.bound_names(self.imports, self.import_edges, self.symbols))
        return graph.cut(found, graph.scratch(self.spark))

    def call_graph(self, tier: str) -> DataFrame:
        return self.edges.filter((F.col("tier") == tier) & F.col("enclosing_id").isNotNull()).select(F.col("enclosing_id").alias("src"), F.col("to_id").alias("dst")).distinct()

    @cached_property
    def entries(self) -> DataFrame:
        return audits.entry_points(self.symbols, self.calls, self.files, self.imports, audits.rules_table(self.spark), self.lines)

    @cached_property
    def reachable(self) -> DataFrame:
        """``symbol_id`` of what entry points, framework hooks and top-level calls reach over edges of either tier."""
        seeds = self.entries.filter("symbol_id IS NOT NULL").select(F.col("symbol_id").alias("node")).unionByName(self.symbols.filter("entry_kind IS NOT NULL").select(F.col("symbol_id").alias("node"))).unionByName(self.edges.filter("enclosing_id IS NULL AND tier <> 'excluded'").select(F.col("to_id").alias("node")))
        found = graph.reachable(self.call_graph("confirmed").unionByName(self.call_graph("unverified")), seeds.distinct())
        return found.select(F.col("node").alias("symbol_id"))

    def symbol(self, name: str, file: str | None = None, class_name: str | None = None, line: int | None = None) -> DataFrame:
        """The definition meant: pinned by handle, file, class or line, else the best one."""
        parts = name.split(":")
        if len(parts) == 3 and parts[1].isdigit():
            file, line, name = parts[0], int(parts[1]), parts[2]
        own = self.symbols.filter(F.col("name") == name)
        if class_name:
            own = own.filter(F.col("owner") == class_name)
        if file:
            own = own.filter((F.col("rel") == file) | F.col("rel").endswith("/" + file))
        if line is not None:
            own = own.filter((F.col("start_line") == line) | (F.col("name_line") == line))
        best = symbols.resolve_symbol(own, self.import_edges)
        return own.join(best.select("symbol_id"), "symbol_id", "left_semi")


def _limited(df: DataFrame, limit: int | None, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(limit) if limit is not None else df


def _scoped(df: DataFrame, column: str, exclude=None, within=None) -> DataFrame:
    return df.filter(matches_filters(F.col(column), exclude, within))


def _file(c: Catalog, name: str) -> DataFrame:
    """The file meant by a path: the whole relative path, else the one file it ends. Several are an error that names them."""
    exact = c.files.filter(F.col("rel") == name)
    if not exact.isEmpty():
        return exact
    ends = c.files.filter(F.col("rel").endswith("/" + name))
    found = [r.rel for r in ends.select("rel").orderBy("rel").limit(11).collect()]
    if len(found) > 1:
        raise ValueError(f"{name} may be {', '.join(found[:10])}{' and more' if len(found) > 10 else ''}")
    return ends


def show(c: Catalog, name: str, file=None, class_name=None, line=None, sections=("summary",), top: int = 10) -> dict[str, DataFrame]:
    own = c.symbol(name, file, class_name, line)
    ids = own.select(F.col("symbol_id").alias("to_id"))
    made = {
        "summary": lambda: own.select("name", "kind", "rel", "start_line", "end_line", "owner", "params", "return_type", "docstring", "complexity", "nesting"),
        "callers": lambda: edges.callers(c.edges, ids).select("file", "line", "enclosing", "tier", "resolution", "score", "reason"),
        "callees": lambda: edges.callees(c.edges).join(own.select(F.col("symbol_id").alias("enclosing_id")), "enclosing_id", "left_semi").orderBy(F.desc("calls"), "to_file", "to_name"),
        "source": lambda: search.source_of(own, c.lines),
        "dependencies": lambda: search.source_of(c.symbols.join(edges.callees(c.edges).join(own.select(F.col("symbol_id").alias("enclosing_id")), "enclosing_id", "left_semi").select(F.col("to_id").alias("symbol_id")), "symbol_id", "left_semi"), c.lines),
        "tests": lambda: reporting.direct_tests(own, c.files, c.edges, c.import_edges, c.symbols),
        "types": lambda: c.symbols.filter("family = 'type'").join(own.select(F.col("owner").alias("name")), "name", "left_semi"),
        "example": lambda: edges.diverse_examples(c.calls.filter(F.col("name") == name)),
        "related": lambda: symbols.related(c.symbols, name, top),
        "account": lambda: A.callee_account(c.calls, c.edges, ids, c.symbols),
        "effects": lambda: audits.side_effects(own, c.imports, search.source_of(own, c.lines)),
    }
    return {s: made[s]() for s in sections}


def find(c: Catalog, name: str, exact=False, kind=None, exclude=None, within=None, limit=None, include_tests=True) -> DataFrame:
    own = _scoped(c.symbols, "rel", exclude, within)
    if not include_tests:
        own = own.join(c.files.filter("is_test").select("file"), "file", "left_anti")
    return symbols.find(own, name, exact, kind, limit)


def usages(c: Catalog, name: str, code_only=False, exclude=None, within=None, context: int = 0, limit=None) -> DataFrame:
    found = _scoped(search.usages(c.usages, c.symbols, c.lines, name, code_only), "file", exclude, within).join(c.lines.select("file", "line", "text"), ["file", "line"], "left")
    found = _limited(found, limit, ["file", "line", "usage_type"])
    return search.with_context(found, c.lines, context) if context else found


def search_text(c: Catalog, term: str | None = None, regex=False, case_sensitive=False, code_only=False, context: int = 0, exclude=None, within=None, top=None, **structural) -> DataFrame:
    if structural or term is None:
        unused = c.calls if structural.pop("unused", False) else None
        return symbols.structural_search(_scoped(c.symbols, "rel", exclude, within), name=term, unused_against=unused, **structural)
    found = search.search(c.lines, term, regex, case_sensitive, code_only, exclude, within, top)
    return search.with_context(found, c.lines, context) if context else found


def source(c: Catalog, name: str | None = None, file=None, class_name=None, line=None, range: str | None = None, max_lines=None) -> DataFrame:  # noqa: A002
    if range:
        first, _, last = range.partition("-")
        return search.source_range(c.lines, file, int(first), int(last or first))
    return search.source_of(c.symbol(name, file, class_name, line), c.lines, max_lines)


def trace(c: Catalog, name: str, direction="callees", to=None, depth: int | None = None, file=None, class_name=None, line=None, all=False) -> DataFrame:  # noqa: A002
    root = c.symbol(name, file, class_name, line).select(F.col("symbol_id").alias("node"))
    sure, maybe = c.call_graph("confirmed"), c.call_graph("unverified")
    if to == "entrypoints":
        return graph.reverse_to_roots(sure, root, depth or 5, maybe)
    if direction == "callers":
        return graph.blast(sure, maybe, root, depth or 3)
    return graph.tree(sure, root, depth or 3, cap=None if all else 10)


def impact(c: Catalog, name: str | None = None, file=None, class_name=None, line=None, diff: DataFrame | None = None, before: DataFrame | None = None, unreachable_only=False) -> DataFrame:
    if name is None:
        changed = audits.changed_symbols(audits.diff_lines(diff), before if before is not None else c.symbols, c.symbols)
        return audits.diff_impact(changed, c.symbols, c.edges)
    own = c.edges
    if unreachable_only:
        own = own.join(c.reachable.select(F.col("symbol_id").alias("enclosing_id")), "enclosing_id", "left_anti")
    return edges.impact(own, c.symbol(name, file, class_name, line).select(F.col("symbol_id").alias("to_id")))


def account(c: Catalog, name: str) -> DataFrame:
    """The conservation account of a name: every line that holds it, in one bucket."""
    claims = c.edges.filter((F.col("name") == name) | (F.col("to_name") == name)).select("file", "line", F.col("tier").alias("bucket"), F.coalesce("reason", "resolution").alias("reason"))
    parsed = c.usages.filter(F.col("name") == name).select("file", "line", "usage_type").unionByName(c.symbols.filter(F.col("name") == name).select("file", F.coalesce("name_line", "start_line").alias("line"), F.lit("definition").alias("usage_type")))
    issues = c.file_issues.filter("kind IN ('unparsed', 'unsupported')").select(F.col("rel").alias("file"), "kind")
    ground = search.ground_set(c.lines.select("file", "line", "text").unionByName(c.gap_lines), name)
    return A.account(ground, claims, parsed, issues, c.file_issues.filter(F.col("kind").isin(*audits.UNREAD)))


def tests(c: Catalog, name: str, depth: int = 0, file=None, class_name=None, line=None) -> DataFrame:
    own = c.symbol(name, file, class_name, line)
    if not depth:
        return reporting.direct_tests(own, c.files, c.edges, c.import_edges, c.symbols)
    nodes = c.symbols.join(c.files.filter("is_test").select("file"), "file", "left_semi").select(F.col("symbol_id").alias("node"))
    return graph.affected_tests(c.call_graph("confirmed"), c.call_graph("unverified"), own.select(F.col("symbol_id").alias("node")), nodes, depth)


def check(c: Catalog, name: str | None = None, file=None, class_name=None, line=None, diff: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    sites = c.edges.filter("tier <> 'excluded' AND arg_count IS NOT NULL").join(c.calls.select("file", "line", "seq", "keywords", "arg_spread"), ["file", "line", "seq"]).withColumnRenamed("to_params", "params_structured")
    if name is not None:
        ids = c.symbol(name, file, class_name, line).select(F.col("symbol_id").alias("to_id"))
        return edges.verify(sites.join(ids, "to_id", "left_semi"))
    changed = audits.changed_symbols(audits.diff_lines(diff), before if before is not None else c.symbols, c.symbols)
    touched = changed.join(c.symbols.select(F.col("symbol_id").alias("to_id"), "rel", F.coalesce("owner", F.lit("")).alias("owner"), "name"), ["rel", "owner", "name"]).select("to_id", "change")
    verified = edges.verify(sites.join(touched, "to_id")).select("name", "tier", "verdict", "change")
    return audits.check(changed, verified)


def plan(c: Catalog, name: str, rename_to=None, add_param=None, remove_param=None, default_value=None, file=None, class_name=None, line=None) -> DataFrame:
    if sum(x is not None for x in (rename_to, add_param, remove_param)) != 1:
        raise ValueError("one operation at a time")
    own = c.symbol(name, file, class_name, line)
    if rename_to:
        return audits.plan_rename(own, c.edges, c.imports, c.lines.select("file", "line", "text"), name, rename_to)
    return audits.plan_parameter(own, c.edges, add_param, remove_param, default_value)


def repo_report(c: Catalog, sections=("summary",), top: int = 10) -> dict[str, DataFrame]:
    made = {
        "summary": lambda: reporting.orient(c.files, c.symbols, c.entries), "files": lambda: symbols.toc(c.files, c.symbols), "stats": lambda: symbols.stats(c.files, c.symbols), "kinds": lambda: symbols.kinds(c.symbols), "extensions": lambda: symbols.extensions(c.files), "usage": lambda: symbols.usage_counts(c.symbols, c.calls.filter("NOT is_function_ref"), c.imports), "health": lambda: reporting.blind_spots(c.calls, c.imports, c.file_issues),
        "trust": lambda: reporting.trust(c.edges, c.file_issues), "hot": lambda: reporting.hot(c.edges, c.symbols, top), "folders": lambda: reporting.dense_folders(c.files, c.symbols),
        "sample": lambda: symbols.stratified_sample(c.symbols.select("symbol_id", "language", "kind", "rel", "start_line"), ["language", "kind"], 200, ["rel", "start_line"]),
    }
    return {s: made[s]() for s in sections}


def deps(c: Catalog, file: str | None = None, depth: int = 5, direction="imports", cycles=False) -> DataFrame:
    own = c.import_edges.filter("dst IS NOT NULL").select("src", "dst").distinct()
    if cycles:
        return graph.components(own)
    start = _file(c, file).select(F.col("file").alias("node"))
    return graph.closure(own, start, depth, up=direction in ("importers", "exporters", "up"))


def api(c: Catalog, file=None, within=None, limit=None) -> DataFrame:
    found = _scoped(symbols.exported_symbols(c.symbols), "rel", None, within or file)
    return _limited(found, limit, ["rel", "start_line", "name"])


def deadcode(c: Catalog, include_exported=False, include_decorated=False, include_tests=False, exclude=None, within=None, limit=None) -> DataFrame:
    tokens = audits.token_table(c.lines, "masked")
    gaps = audits.token_table(c.gap_lines, "text").select("token").distinct()
    found = audits.deadcode(c.symbols, c.edges, tokens, c.entries, c.file_issues, include_exported, include_decorated, include_tests, gaps, audits.dispatch_holders(c.lines))
    return _limited(_scoped(found.filter("verdict = 'candidate'"), "rel", exclude, within), limit, ["rel", "start_line"])


def entrypoints(c: Catalog, type=None, framework=None, exclude=None, limit=None) -> DataFrame:  # noqa: A002
    found = _scoped(c.entries, "file", exclude)
    for column, value in (("type", type), ("framework", framework)):
        if value:
            found = found.filter(F.col(column) == value)
    return _limited(found, limit, ["file", "line", "name"])


def endpoints(c: Catalog, view="bridge", method=None, prefix=None, framework=None, hide_uncertain=False) -> DataFrame:
    """``view``: routes, requests, bridge, unmatched-routes or unmatched-requests."""
    patterns = web.patterns_table(c.spark)
    called = web.mounted(web.call_routes(c.calls, c.files, patterns).withColumn("router", F.col("file")), web.file_mounts(c.calls, c.imports, c.import_edges)).drop("router")
    routes = called.unionByName(web.decorator_routes(c.symbols)).unionByName(web.file_routes(c.files, c.exports))
    asked = web.requests(c.calls, c.files, patterns)
    if method:
        routes, asked = (x.filter(F.col("method").isin(method.upper(), "ALL")) for x in (routes, asked))
    if prefix:
        routes, asked = (x.filter(F.col("path").startswith(prefix)) for x in (routes, asked))
    if framework:
        routes = routes.filter(F.col("framework") == framework)
    if view in ("routes", "requests"):
        return routes if view == "routes" else asked
    bridges = web.bridge(routes, asked)
    if hide_uncertain:
        bridges = bridges.filter("match <> 'uncertain'")
    return {"bridge": lambda: bridges, "unmatched-routes": lambda: web.unmatched_routes(routes, bridges), "unmatched-requests": lambda: web.unmatched_requests(asked, bridges)}[view]()


def stack(c: Catalog, stack: str) -> DataFrame:
    frames = stacktrace.parse(c.spark.createDataFrame([(0, stack)], "trace_id long, stack string"))
    return stacktrace.enriched(stacktrace.resolve(frames, c.files), c.lines, c.symbols)


def audit_async(c: Catalog, exclude=None, limit=None) -> DataFrame:
    known = c.files.filter(F.col("language").isin("javascript", "typescript", "tsx", "python", "html", "csharp")).select("file")
    found = audits.missing_awaits(c.calls.join(known, "file", "left_semi"), c.symbols)
    return _limited(_scoped(found, "file", exclude), limit, ["file", "line"])


COMMANDS: dict[str, Callable] = {
    "show": show, "find": find, "usages": usages, "search": search_text, "source": source, "trace": trace, "impact": impact, "tests": tests, "check": check, "plan": plan, "repo": repo_report, "deps": deps, "api": api, "entrypoints": entrypoints, "endpoints": endpoints, "deadcode": deadcode, "auditAsync": audit_async, "stacktrace": stack,
    "account": account,
}


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def snake(name: str) -> str:
    return "".join("_" + x.lower() if x.isupper() else x for x in name)


def execute(catalog: Catalog, command: str, **params) -> dict:
    """``{"ok": True, "result": ...}`` or ``{"ok": False, "error": ...}``; parameters in either spelling, unknown ones are refused."""
    import inspect

    name = next((k for k in COMMANDS if snake(k) == snake(command)), None)
    if name is None:
        near = min(COMMANDS, key=lambda k: _distance(k.lower(), command.lower()))
        hint = f"; did you mean {near}?" if _distance(near.lower(), command.lower()) <= 3 else ""
        return {"ok": False, "error": f"unknown command {command}{hint}"}
    accepted = inspect.signature(COMMANDS[name]).parameters
    own = {{"in": "within", "all": "all"}.get(k, snake(k)): v for k, v in params.items()}
    wild = any(p.kind is p.VAR_KEYWORD for p in accepted.values())
    wrong = [k for k in own if k not in accepted and not (wild and k in ("kind", "param", "returns", "decorator", "exported", "receiver", "unused"))]
    if wrong:
        return {"ok": False, "error": f"{name} does not take {', '.join(sorted(wrong))}"}
    missing = [k for k, p in list(accepted.items())[1:] if p.default is p.empty and p.kind is p.POSITIONAL_OR_KEYWORD and k not in own]
    if missing:
        return {"ok": False, "error": f"{name} needs {', '.join(missing)}"}
    try:
        return {"ok": True, "result": COMMANDS[name](catalog, **own)}
    except ValueError as refused:
        return {"ok": False, "error": str(refused)}
