"""Operators over ``symbols``: find, resolve, structural search, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefold.functions.text import fuzzy_score, glob_pattern, is_test_path
from codefold.schemas import TYPE_KINDS


def find(symbols: DataFrame, name: str, exact: bool = False, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Symbols by name: a glob if it has ``*`` or ``?``, else equal names, else (unless ``exact``) by score, best first."""
    own = symbols if kind is None else symbols.filter(F.col("kind") == kind)
    if "*" in name or "?" in name:
        found = own.filter(F.col("name").rlike("(?i)" + glob_pattern(name))).withColumn("score", F.lit(1000.0))
    else:
        score = fuzzy_score(name, F.col("name"))
        found = own.withColumn("score", score).filter(F.col("score") == 1000.0 if exact else F.col("score") > 0)
    if limit is not None:
        found = found.orderBy(F.desc("score"), "rel", "start_line", "name").limit(limit)
    return found


def definition_score(symbols: DataFrame) -> Column:
    """How likely a definition is the one meant: types first, tests, examples and generated files last, shallow paths preferred."""
    rel, has = F.coalesce("rel", F.lit("")), set(symbols.columns)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in has else F.lit(False)
    span = F.least(F.col("end_line") - F.col("start_line"), F.lit(100))
    depth = F.size(F.split(rel, "/")) - 1
    return (
        F.when(F.col("kind").isin(*TYPE_KINDS[:7]), 1000).otherwise(0)
        - F.when(is_test_path(rel) | flag("is_test"), 500).otherwise(0)
        - F.when(rel.rlike("(?i)^(examples?|docs?|vendor|third[_-]?party|benchmarks?|samples?)/"), 300).otherwise(0)
        - F.when(flag("is_generated"), 100).otherwise(0)
        + F.when(rel.rlike("(?i)^(lib|src|core|internal|pkg|crates)/"), 200).otherwise(0)
        - F.when(flag("is_signature"), 200).otherwise(0)
        + F.when(F.col("kind") == "function", F.coalesce(span, F.lit(0))).otherwise(0)
        + F.greatest(F.lit(0), 50 - depth * 10)
    )


def resolve_symbol(symbols: DataFrame, import_edges: DataFrame | None = None) -> DataFrame:
    """The best definition of each name with the number of others: by score, importers of its file, then canonical order.

    A name's definitions are reduced by a partial maximum, so a name that is
    defined everywhere gathers nowhere.
    """
    scored = symbols.withColumn("score", definition_score(symbols))
    if import_edges is not None:
        importers = import_edges.groupBy(F.col("dst").alias("file")).agg(F.countDistinct("src").alias("importers"))
        scored = scored.join(importers, "file", "left")
    else:
        scored = scored.withColumn("importers", F.lit(0).cast("long"))
    best = F.min(F.struct((-F.col("score")).alias("worse"), (-F.coalesce("importers", F.lit(0))).alias("fewer"), F.lower("rel").alias("folded"), "rel", "start_line", "kind", "symbol_id"))
    return scored.groupBy("name").agg(best.alias("b"), F.count("*").alias("definitions")).select("name", F.col("b.symbol_id").alias("symbol_id"), F.col("b.rel").alias("rel"), F.col("b.start_line").alias("start_line"), F.col("b.kind").alias("kind"), (-F.col("b.worse")).alias("score"), "definitions")


def typedef(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.filter((F.col("name") == name) & F.col("kind").isin(*TYPE_KINDS))


def structural_search(symbols: DataFrame, kind: str | None = None, name: str | None = None, param: str | None = None, returns: str | None = None, decorator: str | None = None, exported: bool | None = None, receiver: str | None = None, unused_against: DataFrame | None = None) -> DataFrame:
    """Symbols by their parts: kind, name glob, parameter name or type, return type, decorator, export, receiver, or without a call."""
    found = symbols
    if kind:
        found = found.filter(F.col("kind").isin(*TYPE_KINDS) if kind == "type" else F.col("kind") == kind)
    if name:
        found = found.filter(F.col("name").rlike("(?i)" + glob_pattern(name)))
    if param:
        low = param.lower()
        found = found.filter(F.exists("params_structured", lambda p: F.lower(F.coalesce(p["name"], F.lit(""))).contains(low) | F.lower(F.coalesce(p["type"], F.lit(""))).contains(low)) | F.lower(F.coalesce("params", F.lit(""))).contains(low))
    if returns:
        found = found.filter(F.lower("return_type").contains(returns.lower()))
    if decorator:
        found = found.filter(F.exists("decorators", lambda d: F.lower(d).contains(decorator.lower())))
    if exported is not None:
        found = found.filter(F.col("is_exported") == exported)
    if receiver:
        found = found.filter(F.coalesce("owner", "receiver") == receiver)
    if unused_against is not None:
        found = found.join(unused_against.select("name").distinct(), "name", "left_anti")
    return found


def stats(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files, lines and symbols by language."""
    by_file = files.groupBy("language").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))
    by_symbol = symbols.groupBy("language").agg(F.count("*").alias("symbols"))
    return by_file.join(by_symbol, "language", "left").select("language", "files", "lines", F.coalesce("symbols", F.lit(0)).alias("symbols"))


def kinds(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count("*").alias("symbols"))


def toc(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each file's counts and, by a rollup, the total (null ``rel``)."""
    counted = symbols.groupBy("file").agg(F.count_if(F.col("family") == "callable").alias("functions"), F.count_if(F.col("family") == "type").alias("types"), F.count_if(F.col("family") == "state").alias("state"))
    joined = files.select("file", "rel", "lines").join(counted, "file", "left")
    return joined.rollup("rel").agg(F.sum("lines").alias("lines"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("functions", "types", "state")))


def related(symbols: DataFrame, name: str, top: int = 10) -> DataFrame:
    """Symbols near a name: in its file by distance, then by shared name parts of over three letters, at least half of them."""
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2")), "[_\\W]+"), lambda p: F.length(p) > 3))
    target = symbols.filter(F.col("name") == name).orderBy("rel", "start_line").limit(1).select(F.col("file").alias("t_file"), F.col("start_line").alias("t_line"), split(F.col("name")).alias("t_parts"), F.col("symbol_id").alias("t_id"))
    near = symbols.join(F.broadcast(target), F.col("symbol_id") != F.col("t_id"))
    shared = F.size(F.array_intersect(split(F.col("name")), F.col("t_parts")))
    near = near.withColumn("distance", F.when(F.col("file") == F.col("t_file"), F.abs(F.col("start_line") - F.col("t_line")))).withColumn("shared", shared)
    near = near.filter(F.col("distance").isNotNull() | ((F.col("shared") > 0) & (F.col("shared") * 2 >= F.size("t_parts"))))
    return near.orderBy(F.col("distance").asc_nulls_last(), F.desc("shared"), "rel", "start_line").limit(top).select("name", "rel", "start_line", "distance", "shared")


def exported_symbols(symbols: DataFrame) -> DataFrame:
    """The public interface by each language's rule."""
    name, mods, lang = F.col("name"), F.coalesce("modifiers", F.array().cast("array<string>")), F.col("language")
    public = F.exists(mods, lambda m: m.isin("export", "public", "pub", "default"))
    rule = F.when(lang == "python", ~name.startswith("_")).when(lang == "go", name.rlike("^[A-Z]")).otherwise(public)
    return symbols.filter(F.coalesce("is_exported", F.lit(False)) | rule)


def stratified_sample(rows: DataFrame, strata: list[str], n: int, order: list[str]) -> DataFrame:
    """``n`` rows dealt round-robin over the strata: the first of each, then the second, in stratum order."""
    by_round = rows.withColumn("round", F.row_number().over(Window.partitionBy(*strata).orderBy(*order)))
    return by_round.orderBy("round", *strata).limit(n)


def members(symbols: DataFrame, owner: str) -> DataFrame:
    """Callables of a type, by owner or receiver."""
    return symbols.filter((F.col("family") == "callable") & ((F.col("owner") == owner) | (F.col("receiver") == owner)))


def dispatch_names(inherit: DataFrame, symbols: DataFrame, owner: str, method: str, cap: int | None = None, depth: int = 8) -> DataFrame:
    """``name``: the class and the descendants, up to ``depth`` levels below, that take the method from it, down to those that override it; all, or the first ``cap`` by name."""
    overriding = symbols.filter((F.col("name") == method) & F.col("owner").isNotNull()).select(F.col("owner").alias("child")).distinct()
    links = inherit.select("child", "parent").distinct().join(overriding, "child", "left_anti")
    found = level = symbols.sparkSession.createDataFrame([(owner,)], "name string")
    for _ in range(depth):
        level = level.join(links, F.col("name") == F.col("parent")).select(F.col("child").alias("name")).distinct()
        found = found.unionByName(level)
    found = found.distinct().orderBy("name")
    return found if cap is None else found.limit(cap)


def usage_counts(symbols: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """For each name its definitions, calls and imports: counts by name before they are joined."""
    d = symbols.groupBy("name").agg(F.count("*").alias("definitions"))
    c = calls.groupBy("name").agg(F.count("*").alias("calls"))
    i = imports.select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("imports"))
    zero = lambda k: F.coalesce(k, F.lit(0)).alias(k)
    return d.join(c, "name", "left").join(i, "name", "left").select("name", "definitions", zero("calls"), zero("imports"), (F.col("definitions") + F.coalesce("calls", F.lit(0)) + F.coalesce("imports", F.lit(0))).alias("total"))


def extensions(files: DataFrame) -> DataFrame:
    """Files and bytes by extension."""
    return files.groupBy(F.lower(F.regexp_extract("rel", r"(\.[^./]+)$", 1)).alias("extension")).agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))
