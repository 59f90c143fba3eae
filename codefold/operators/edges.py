"""Call resolution: evidence, tiers, and what is read off the resolved edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The evidence ladder, first match wins: evidence column, resolution, ordinal weight, tier. Fixed values.
LADDER = (
    ("type_mismatch", "uncertain", 0.25, "unverified"),
    ("possible_dispatch", "possible-dispatch", 0.50, "unverified"),
    ("method_ambiguous", "method-ambiguous", 0.35, "unverified"),
    ("has_binding", "exact-binding", 0.98, "confirmed"),
    ("same_class", "same-class", 0.92, "confirmed"),
    ("receiver_hint", "receiver-hint", 0.80, "confirmed"),
    ("reference_in_scope", "scope-match", 0.65, "confirmed"),
    ("reference_only", "name-only", 0.40, "unverified"),
    ("in_scope", "scope-match", 0.65, "confirmed"),
    ("is_uncertain", "uncertain", 0.25, "unverified"),
)
LAST = ("name-only", 0.40, "unverified")
EVIDENCE = tuple(x[0] for x in LADDER)


def _rung(k: int, last) -> Column:
    out = F.lit(last)
    for rung in reversed(LADDER):
        out = F.when(F.col(rung[0]), F.lit(rung[k])).otherwise(out)
    return out


def with_tier(edges: DataFrame) -> DataFrame:
    """Adds ``resolution, score, tier`` from the evidence columns; null evidence is none."""
    known = edges.select(*(c for c in edges.columns if c not in EVIDENCE), *((F.coalesce(F.col(e), F.lit(False)) if e in edges.columns else F.lit(False)).alias(e) for e in EVIDENCE))
    return known.withColumns({"resolution": _rung(1, LAST[0]), "score": _rung(2, LAST[1]), "tier": _rung(3, LAST[2])})


def min_confidence(edges: DataFrame, least: float) -> DataFrame:
    return edges.filter(F.col("score") >= least)


#: Lines in a bucket of a range join.
BUCKET = 128


def within_ranges(sites: DataFrame, ranges: DataFrame) -> DataFrame:
    """``sites`` (``file, line``) joined with the ``ranges`` (``file, s, e``) around them, by an equi-join on file and line bucket."""
    bucketed = ranges.withColumn("__bucket", F.explode(F.sequence((F.col("s") / BUCKET).cast("int"), (F.greatest("s", "e") / BUCKET).cast("int"))))
    return sites.withColumn("__bucket", (F.col("line") / BUCKET).cast("int")).join(bucketed, ["file", "__bucket"]).filter(F.col("line").between(F.col("s"), F.col("e"))).drop("__bucket")


def innermost(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each (file, line) the smallest callable around it, the first in canonical order on ties."""
    spans = symbols.filter("family = 'callable'").select("file", F.col("symbol_id").alias("enclosing_id"), F.col("name").alias("enclosing"), F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    inside = within_ranges(sites.select("file", "line").distinct(), spans)
    best = F.min(F.struct((F.col("e") - F.col("s")).alias("span"), "s", "enclosing", "enclosing_id"))
    return inside.groupBy("file", "line").agg(best.alias("b")).select("file", "line", F.col("b.enclosing_id").alias("enclosing_id"), F.col("b.enclosing").alias("enclosing"))


#: Receivers that stand for the class around a call.
OWN = ("this", "self", "cls", "super", "super()", "base", "Self")
#: Languages whose functions can't be called through a value's member, and those that choose among overloads by argument types.
STATIC, OVERLOADS = ("go", "rust", "java", "c", "cpp", "csharp"), ("java", "cpp", "csharp")
_NUMBER = ("int", "long", "short", "byte", "float", "double", "Integer", "Long", "Double", "bool", "boolean", "Boolean", "size_t", "decimal")
_STRING = ("String", "string", "std::string", "const std::string&", "char*", "const char*", "CharSequence", "bool", "boolean")


def ancestors(inherit_edges: DataFrame, doublings: int = 2) -> DataFrame:
    """``child, parent`` of parents and theirs, up to two to the power of ``doublings`` levels."""
    pairs = inherit_edges.select("child", "parent").distinct()
    for _ in range(doublings):
        far = pairs.join(pairs.select(F.col("child").alias("parent"), F.col("parent").alias("far")), "parent").select("child", F.col("far").alias("parent"))
        pairs = pairs.unionByName(far).distinct()
    return pairs.filter("child <> parent")


def _family(c: str) -> Column:
    return F.when(F.col(c).isin("typescript", "tsx", "html"), "javascript").when(F.col(c) == "cpp", "c").otherwise(F.col(c))


def call_sites(calls: DataFrame, symbols: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """Calls with what is known of a site alone, a row for each call and name it may mean.

    Adds ``call_id, target, aliased, enclosing_id, enclosing, own_class,
    module_receiver, external, class_receiver, std_receiver, path_receiver,
    literals`` (positions of literal arguments, twice, odd for numbers) and
    ``literal``, whether there are any.
    """
    names = F.when(F.size("resolved_names") > 0, F.col("resolved_names")).otherwise(F.array("name"))
    kinds = F.split(F.coalesce("shape", F.lit("")), ",") if "shape" in calls.columns else F.array(F.lit(""))
    literals = F.array_compact(F.transform(kinds, lambda k, i: F.when(k == "str", 2 * i).when(k == "num", 2 * i + 1)))
    sites = calls.withColumn("call_id", F.concat_ws(":", "file", "line", F.col("seq").cast("string"), "name")).withColumn("literals", literals)
    sites = sites.withColumns({"literal": F.size("literals") > 0, "std_receiver": F.col("receiver").rlike("^(std|core|alloc)(::|$)"), "path_receiver": F.col("receiver").rlike("(^|::)[A-Z][^:]*$")})
    sites = sites.withColumn("target", F.explode(names)).withColumn("aliased", F.col("target") != F.col("name"))
    around = innermost(calls, symbols).join(symbols.select(F.col("symbol_id").alias("enclosing_id"), F.col("owner").alias("own_class")), "enclosing_id")
    sites = sites.join(around, ["file", "line"], "left")
    if bound is not None:
        sites = sites.join(bound.groupBy("file", F.col("name").alias("receiver")).agg(F.max("external").alias("external"), F.lit(True).alias("module_receiver")), ["file", "receiver"], "left")
    else:
        sites = sites.withColumns({"external": F.lit(None).cast("boolean"), "module_receiver": F.lit(None).cast("boolean")})
    owners = symbols.filter("owner IS NOT NULL").select(F.element_at(F.split("owner", "::"), -1).alias("receiver_name")).distinct().withColumn("class_receiver", F.lit(True))
    return sites.withColumn("receiver_name", F.element_at(F.split(F.coalesce("receiver", F.lit("")), "::|\\."), -1)).join(owners, "receiver_name", "left")


def definitions(symbols: DataFrame) -> DataFrame:
    """Callables and types as targets, with how many owners and definitions share the name, and overloads of one owner the number of parameters.

    What a call is checked against is read off the parameter list here, once for
    each definition: ``low, high, rest`` and ``clashes``, the ``literals`` that a
    parameter's type does not take.
    """
    own = symbols.filter("family in ('callable', 'type')").select(
        F.col("name").alias("target"), F.col("symbol_id").alias("to_id"), F.col("file").alias("to_file"), F.col("owner").alias("to_owner"), F.col("kind").alias("to_kind"), F.col("family").alias("to_family"), F.col("params_structured").alias("to_params"), F.col("language").alias("to_language"),
    )
    own = own.withColumn("to_size", F.coalesce(F.size("to_params"), F.lit(-1)))
    callable_ = own.filter("to_family = 'callable'")
    names = callable_.groupBy("target").agg(F.countDistinct(F.coalesce("to_owner", F.lit(""))).alias("owners"), F.count("*").alias("definitions"))
    overloads = callable_.filter(F.col("to_language").isin(*OVERLOADS)).groupBy("target", "to_file", F.coalesce("to_owner", F.lit("")).alias("__owner"), "to_size").agg(F.count("*").alias("overloads")).filter("overloads > 1")
    own = own.withColumn("__owner", F.coalesce("to_owner", F.lit(""))).join(names, "target", "left").join(overloads, ["target", "to_file", "__owner", "to_size"], "left")
    low, high, rest = arity("to_params")
    clashes = F.array_compact(F.flatten(F.transform("to_params", lambda p, i: F.array(F.when(p["type"].isin(*_NUMBER), 2 * i), F.when(p["type"].isin(*_STRING), 2 * i + 1)))))
    read = {"low": low, "high": high, "rest": rest, "clashes": clashes}
    read = {k: F.when(F.col("to_params").isNotNull(), v) for k, v in read.items()}
    return own.withColumns(read | {"owner_name": F.element_at(F.split(F.coalesce("to_owner", F.lit("")), "::"), -1)}).drop("__owner", "to_size")


#: What the evidence reads of a definition beside its file: definitions that agree in these are one class.
CLASS = ("to_owner", "owner_name", "standalone", "built", "callable", "to_language", "static", "rust", "low", "high", "rest", "clashes", "one_owner", "several", "one_definition", "overloaded")


def _classes(found: DataFrame, *keys: str) -> DataFrame:
    n = F.sum("n") if "n" in found.columns else F.count("*")
    return found.groupBy(*keys, *CLASS).agg(n.alias("n"))


def candidates(sites: DataFrame, symbols: DataFrame, import_edges: DataFrame, files: DataFrame | None, explain: bool, classes: bool) -> DataFrame:
    """The definitions that a name (``target``) may mean in a file, a row for each pair of ``file`` and ``target`` that ``sites`` have and definition.

    Adds ``same_file, imported, local_def, import_def`` and, unless ``explain``,
    ``near``: whether the row is for calls that their file or an import may bind.
    With ``classes`` a row stands for the ``n`` definitions that agree in all
    that evidence reads.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    defs = definitions(symbols).withColumns({"one_owner": F.col("owners") == 1, "one_definition": F.col("definitions") == 1, "overloaded": F.coalesce("overloads", F.lit(1)) > 1})
    kind, language = F.col("to_kind"), F.col("to_language")
    flags = {"one_owner": yes(F.col("one_owner")), "several": yes(F.col("owners") > 1), "one_definition": yes(F.col("one_definition")), "standalone": F.col("to_owner").isNull(), "callable": yes(F.col("to_family") == "callable"), "built": yes(kind.isin("class", "constructor")), "static": yes(language.isin(*STATIC)), "rust": yes(language == "rust")}
    defs = defs.withColumns(flags)
    defs = _classes(defs, "target", "to_file") if classes else defs.select("target", "to_file", "to_id", "to_params", *CLASS)
    free = symbols.filter("family in ('callable', 'type') AND owner IS NULL").select("file", F.col("name").alias("target")).distinct()
    imports = import_edges.select(F.col("src").alias("file"), F.col("dst").alias("to_file")).distinct().withColumn("imported", F.lit(True))
    reached = imports.select(F.col("file").alias("src"), F.col("to_file").alias("file")).join(free, "file").select(F.col("src").alias("file"), "target").distinct()
    keys = sites.select("file", "target").distinct()
    keys = keys.join(free.withColumn("local_def", F.lit(True)), ["file", "target"], "left").join(reached.withColumn("import_def", F.lit(True)), ["file", "target"], "left")
    if files is not None:
        found = keys.join(files.select("file", _family("language").alias("own_family")), "file").join(defs, "target").filter(F.col("own_family") == _family("to_language"))
    else:
        found = keys.join(defs, "target")
    found = found.join(imports, ["file", "to_file"], "left").withColumns({"same_file": F.col("file") == F.col("to_file"), "imported": yes(F.col("imported")), "local_def": yes(F.col("local_def")), "import_def": yes(F.col("import_def"))})
    facts = ["same_file", "imported", "local_def", "import_def"]
    found = _classes(found, "file", "target", *facts) if classes else found.select("file", "target", "to_file", "to_id", "to_params", *facts, *CLASS)
    if explain:
        return found
    bound = (F.col("local_def") & ~F.col("same_file")) | (~F.col("local_def") & F.col("import_def") & ~F.col("same_file") & ~F.col("imported"))
    return found.withColumn("near", F.explode(F.when(bound, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))


def _site_flags(sites: DataFrame, builtins: tuple[str, ...]) -> DataFrame:
    """What the rules ask of a site alone, none of it null; ``ruled`` is the reason that excludes all its edges."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    method, own = yes(F.col("is_method")), yes(F.col("receiver").isin(*OWN))
    builtin = yes(F.col("receiver").isin(*builtins))
    return sites.withColumns({
        "method": method, "own": own, "builtin": builtin, "module": yes(F.col("module_receiver")), "by_class": method & yes(F.col("class_receiver")) & ~own, "reference": yes(F.col("is_function_ref")),
        "any_count": yes(F.col("arg_spread")) | F.col("arg_count").isNull(), "path_receiver": yes(F.col("path_receiver")), "literal": yes(F.col("literal")),
        "ruled": F.when(yes(F.col("local_shadow")), "local-shadow").when(method & (builtin | yes(F.col("external")) | yes(F.col("std_receiver"))), "external-package"),
    })


def _judged(pairs: DataFrame) -> DataFrame:
    """Pairs of a site and a definition (or class of them) with ``rung``, the place in the evidence ladder, and ``reason``.

    Written in two steps of short expressions over flags that the sides bring:
    one long method per pair is beyond what the JVM compiles.
    """
    c, yes = F.col, lambda x: F.coalesce(x, F.lit(False))
    pairs = pairs.withColumns({
        "typed": yes(c("receiver_type") == c("to_owner")) | yes(c("receiver") == c("to_owner")) | (c("by_class") & ~c("standalone") & (c("receiver_name") == c("owner_name"))),
        "inherits": yes(F.array_contains("own_parents", c("to_owner"))), "inherited": yes(F.array_contains("type_parents", c("to_owner"))), "overrides": yes(F.array_contains("owner_parents", c("receiver_type"))),
        "same_owner": yes(c("to_owner") == c("own_class")),
        "misfit": c("callable") & c("low").isNotNull() & ~c("any_count") & yes((c("arg_count") < c("low")) | (~c("rest") & (c("arg_count") > c("high")))),
        "clash": c("overloaded") & yes(F.arrays_overlap("literals", "clashes")),
    })
    method, standalone, same, imported, typed, own = (c(x) for x in ("method", "standalone", "same_file", "imported", "typed", "own"))
    related = typed | c("inherited") | c("overrides")
    reason = (
        F.when(c("ruled").isNotNull(), c("ruled"))
        .when(~method & ~same & c("local_def") & ~c("aliased"), "other-definition")
        .when(~method & ~same & ~imported & c("import_def"), "other-definition-import")
        .when(~standalone & ((~method & ~c("built") & ~c("same_owner") & ~c("inherits")) | (method & c("module") & ~typed)), "kind-mismatch")
        .when(method & standalone & c("static") & c("callable") & ~c("module") & c("receiver").isNotNull(), "kind-mismatch")
        .when(method & own & ~standalone & ~c("same_owner") & ~c("inherits") & c("own_class").isNotNull(), "other-class")
        .when(c("by_class") & ~standalone & c("rust") & c("path_receiver") & ~related, "path-type-mismatch")
        .when(c("misfit"), "arity-mismatch")
        .when(c("clash"), "overload-mismatch")
    )
    evidence = {
        "type_mismatch": method & ~standalone & ~related & ~c("inherits") & c("receiver_type").isNotNull(),
        "possible_dispatch": method & ~typed & ((own & c("inherits") & c("several")) | c("overrides")),
        "method_ambiguous": (method & ~own & ~typed & ~c("inherited") & ~standalone & c("several") & c("receiver_type").isNull()) | (c("overloaded") & ~c("literal")),
        "has_binding": ~method & standalone & (same | (imported & c("one_definition"))) & ~c("reference"),
        "same_class": c("same_owner") & ((method & own) | (~method & ~c("reference") & c("static"))),
        "receiver_hint": method & (typed | c("inherited")),
        "reference_in_scope": c("reference") & (same | imported),
        "reference_only": c("reference"),
        "in_scope": imported | same | (method & ~c("builtin") & ~standalone & c("one_owner")),
        "is_uncertain": method & c("receiver").isNull(),
    }
    rung = F.lit(len(LADDER))
    for k in reversed(range(len(LADDER))):
        rung = F.when(evidence[LADDER[k][0]], F.lit(k)).otherwise(rung)
    return pairs.withColumns({"rung": rung, "reason": reason})


def _placed(judged: DataFrame) -> DataFrame:
    """Adds ``resolution, score, tier`` of the rung; a reason excludes."""
    of = lambda k: F.get(F.array(*(F.lit(x) for x in (*(r[k] for r in LADDER), LAST[k - 1]))), F.col("rung"))
    return judged.withColumns({"resolution": of(1), "score": of(2), "tier": F.when(F.col("reason").isNotNull(), "excluded").otherwise(of(3))})


BUILTINS = ("console", "Math", "JSON", "Object", "Array", "Promise", "os", "sys", "json", "math")


def _edges(calls, symbols, import_edges, inherit_edges, files, builtins, bound, explain, classes) -> DataFrame:
    sites = call_sites(calls, symbols, bound)
    found = candidates(sites, symbols, import_edges, files, explain, classes)
    if inherit_edges is not None:
        related = inherit_edges.groupBy("child").agg(F.collect_set("parent").alias("parents"))
        of = lambda child, parents: related.select(F.col("child").alias(child), F.col("parents").alias(parents))
        sites = sites.join(of("own_class", "own_parents"), "own_class", "left").join(of("receiver_type", "type_parents"), "receiver_type", "left")
        found = found.join(of("to_owner", "owner_parents"), "to_owner", "left")
    else:
        none = F.lit(None).cast("array<string>")
        sites, found = sites.withColumns({"own_parents": none, "type_parents": none}), found.withColumn("owner_parents", none)
    on = ["file", "target"]
    if not explain:
        sites, on = sites.withColumn("near", ~F.coalesce("is_method", F.lit(False)) & ~F.col("aliased")), [*on, "near"]
    return _judged(_site_flags(sites, builtins).join(found, on))


def resolve_calls(calls: DataFrame, symbols: DataFrame, import_edges: DataFrame, inherit_edges: DataFrame | None = None, files: DataFrame | None = None, builtins: tuple[str, ...] = BUILTINS, bound: DataFrame | None = None, explain: bool = True) -> DataFrame:
    """Candidate edges from each call to the definitions of its name (or an alias's target), with evidence, tier and reason.

    What is known of a site alone (its class, what its receiver names) is joined
    to the calls, and what is known of a file and a definition (imports, the
    file's own definitions of the name) to the pairs of file and name
    (``candidates``); calls meet these last, and nothing is joined to an edge.
    Unknown never confirms. Excluded edges carry the reason. With ``files``, only
    definitions in languages that can call each other are candidates. ``bound``:
    ``file, name, external``, the names that imports bind to modules, and whether
    outside the project. ``inherit_edges`` should hold ancestors of all levels
    that count (``ancestors``).

    With ``explain`` false, calls that their own file or an import binds meet
    only definitions there: the edges that ``other-definition`` would exclude
    aren't made, so a common name of local helpers costs what its calls do.
    """
    out = _placed(_edges(calls, symbols, import_edges, inherit_edges, files, builtins, bound, explain, False))
    return out.select("call_id", "file", "line", "seq", "name", "receiver", "enclosing_id", "enclosing", "to_id", F.col("target").alias("to_name"), "to_file", "to_owner", "tier", "resolution", "score", "reason", "aliased", "arg_count", "to_params")


def call_outcomes(calls: DataFrame, symbols: DataFrame, import_edges: DataFrame, inherit_edges: DataFrame | None = None, files: DataFrame | None = None, builtins: tuple[str, ...] = BUILTINS, bound: DataFrame | None = None) -> DataFrame:
    """The edges of ``resolve_calls`` counted: ``call_id, file, line, tier, resolution, score, reason, edges``.

    A row for each call, name it may mean, rung of the ladder and reason. Evidence is read once for
    each class of definitions that it can't tell apart, so a name with very many
    definitions costs its classes, and every edge counts.
    """
    out = _edges(calls, symbols, import_edges, inherit_edges, files, builtins, bound, True, True)
    out = _placed(out.groupBy("file", "target", "line", "seq", "name", "rung", "reason").agg(F.sum("n").alias("edges")))
    return out.select(F.concat_ws(":", "file", "line", F.col("seq").cast("string"), "name").alias("call_id"), "file", "line", "tier", "resolution", "score", "reason", "edges")


def arity(params: str) -> tuple[Column, Column, Column]:
    """Least and most positional arguments of a structured parameter list, and whether a rest parameter lifts the most."""
    own = F.filter(params, lambda p: ~F.coalesce(p["name"].isin("self", "cls", "this"), F.lit(False)) & ~F.coalesce(p["keyword_only"], F.lit(False)))
    plain = F.filter(own, lambda p: ~F.coalesce(p["rest"], F.lit(False)))
    needed = F.filter(plain, lambda p: ~F.coalesce(p["optional"], F.lit(False)) & p["default"].isNull())
    return F.size(needed), F.size(plain), F.exists(params, lambda p: F.coalesce(p["rest"], F.lit(False)) & ~F.coalesce(p["keyword_only"], F.lit(False)))


def signature(params: str = "params_structured") -> Column:
    """What a call is checked against, read off a parameter list once for each definition: a struct, null without a list."""
    of = lambda keep: F.transform(F.filter(params, keep), lambda p: p["name"])
    yes = lambda p, c: F.coalesce(p[c], F.lit(False))
    own = lambda p: ~F.coalesce(p["name"].isin("self", "cls", "this"), F.lit(False)) & ~yes(p, "rest")
    _, most, rest = arity(params)
    made = F.struct(
        of(lambda p: ~yes(p, "rest") & ~yes(p, "positional_only")).alias("named"),
        of(lambda p: own(p) & ~yes(p, "keyword_only")).alias("positional"),
        of(lambda p: own(p) & ~yes(p, "optional") & p["default"].isNull()).alias("needed"),
        F.exists(params, lambda p: yes(p, "rest") & yes(p, "keyword_only")).alias("swallow"), most.alias("most"), rest.alias("rest"),
    )
    return F.when(F.col(params).isNotNull(), made)


def verify(sites: DataFrame) -> DataFrame:
    """Each site against its target's parameters: ``valid``, ``mismatch`` or ``uncertain`` (a spread). Keywords bind by name first.

    ``sites``: ``arg_count`` (positional), ``arg_spread``, ``keywords``, and
    ``signature`` or ``params_structured``.
    """
    given = "signature" in sites.columns
    rows = sites if given else sites.withColumn("signature", signature())
    own, words = F.col("signature"), F.coalesce("keywords", F.array().cast("array<string>"))
    unknown = F.size(F.array_except(words, own["named"])) > 0
    bound = F.slice(own["positional"], 1, F.greatest(F.lit(0), F.least(F.col("arg_count"), F.size(own["positional"]))))
    twice = F.size(F.array_intersect(bound, words)) > 0
    missing = F.size(F.array_except(own["needed"], F.concat(bound, words))) > 0
    wrong = (~own["rest"] & (F.col("arg_count") > own["most"])) | (unknown & ~own["swallow"]) | twice | missing
    verdict = F.when(F.coalesce("arg_spread", F.lit(False)), "uncertain").when(own.isNull() | F.col("arg_count").isNull(), "uncertain").when(wrong, "mismatch").otherwise("valid")
    out = rows.withColumn("verdict", verdict)
    return out if given else out.drop("signature")


def histogram(edges: DataFrame, by: list[str]) -> DataFrame:
    """Edges by confidence class: high over 0.8, medium from 0.5, low."""
    return edges.groupBy(*by).agg(F.count_if(F.col("score") > 0.8).alias("high"), F.count_if(F.col("score").between(0.5, 0.8)).alias("medium"), F.count_if(F.col("score") < 0.5).alias("low"))


def weight(calls: Column) -> Column:
    """How much a function is used: core, regular, utility or normal."""
    return F.when(calls >= 10, "core").when(calls >= 3, "regular").when(calls == 1, "utility").otherwise("normal")


def callers(edges: DataFrame, symbol_ids: DataFrame) -> DataFrame:
    """Sites that reach the given symbols (``to_id``), every tier."""
    return edges.join(symbol_ids.select("to_id").distinct(), "to_id", "left_semi")


def callees(edges: DataFrame, tier: str = "confirmed") -> DataFrame:
    """What each callable calls, by number of calls."""
    return edges.filter(F.col("tier") == tier).groupBy("enclosing_id", "to_id", "to_name", "to_file").agg(F.count("*").alias("calls")).withColumn("weight", weight(F.col("calls")))


def impact(edges: DataFrame, symbol_ids: DataFrame) -> DataFrame:
    """Direct sites of the given symbols by file and tier."""
    return callers(edges, symbol_ids).groupBy("to_id", "file", "tier").agg(F.countDistinct("call_id").alias("sites"))


def call_patterns(calls: DataFrame, by: list[str]) -> DataFrame:
    """How a callable is called: counts of nine site patterns."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return calls.groupBy(*by).agg(
        F.count("*").alias("sites"), F.count_if(yes("awaited")).alias("awaited"), F.count_if(yes("in_loop")).alias("in_loop"), F.count_if(yes("in_try")).alias("in_try"), F.count_if(yes("is_method")).alias("method"),
        F.count_if(yes("arg_spread")).alias("spread"), F.count_if(F.col("assigned_to").isNotNull()).alias("assigned"), F.count_if(F.col("arg_count") == 0).alias("no_arguments"), F.count_if(yes("is_function_ref")).alias("passed_on"),
    )


def diverse_examples(calls: DataFrame, clusters: int = 3) -> DataFrame:
    """For each name the best site of its largest argument shapes."""
    score = F.when(F.col("assigned_to").isNotNull(), 15).otherwise(0) + F.when(F.coalesce("awaited", F.lit(False)), 10).otherwise(0) - F.when(F.coalesce("in_try", F.lit(False)), 5).otherwise(0)
    best = F.min(F.struct((-score).alias("worse"), "file", "line", "seq"))
    shapes = calls.groupBy("name", "shape").agg(F.count("*").alias("sites"), best.alias("b"))
    ranked = shapes.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("sites"), "shape")))
    return ranked.filter(F.col("rank") <= clusters).select("name", "shape", "sites", "rank", F.col("b.file").alias("file"), F.col("b.line").alias("line"), (-F.col("b.worse")).alias("score"))
