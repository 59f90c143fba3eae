"""Reports over a whole index: orientation, health, tests of a symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot(edges: DataFrame, symbols: DataFrame, top: int = 10) -> DataFrame:
    """The most called symbols."""
    n = edges.filter("tier <> 'excluded'").groupBy(F.col("to_id").alias("symbol_id")).agg(F.countDistinct("call_id").alias("calls"))
    return n.join(symbols.select("symbol_id", "name", "rel", "start_line", "kind"), "symbol_id").orderBy(F.desc("calls"), "rel", "start_line").limit(top)


def dense_folders(files: DataFrame, symbols: DataFrame, top: int = 8) -> DataFrame:
    n = symbols.groupBy("file").agg(F.count("*").alias("n"))
    return files.join(n, "file", "left").groupBy("dir").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"), F.count("*").alias("files"), F.sum("lines").alias("lines")).orderBy(F.desc("symbols"), "dir").limit(top)


def orient(files: DataFrame, symbols: DataFrame, entries: DataFrame) -> DataFrame:
    """One row of totals."""
    f = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.countDistinct("language").alias("languages"), F.count_if("is_test").alias("test_files"))
    s = symbols.agg(F.count("*").alias("symbols"), F.count_if(F.col("family") == "callable").alias("callables"), F.count_if(F.col("family") == "type").alias("types"))
    e = entries.agg(F.count("*").alias("entry_points"))
    return f.crossJoin(F.broadcast(s)).crossJoin(F.broadcast(e))


def blind_spots(calls: DataFrame, imports: DataFrame, issues: DataFrame) -> DataFrame:
    """What an index can't see: ``spot, occurrences, files``."""
    dynamic = imports.filter("dynamic").select(F.lit("dynamic-import").alias("spot"), F.col("file").alias("of"))
    reflect = calls.filter(F.col("name").isin("eval", "exec", "getattr", "setattr", "__import__", "Function", "invoke", "forName", "dlsym", "apply")).select(F.lit("reflection").alias("spot"), F.col("file").alias("of"))
    chained = calls.filter("is_method AND receiver = '<expr>'").select(F.lit("computed-receiver").alias("spot"), F.col("file").alias("of"))
    other = issues.select(F.col("kind").alias("spot"), F.col("rel").alias("of"))
    return dynamic.unionByName(reflect).unionByName(chained).unionByName(other).groupBy("spot").agg(F.count("*").alias("occurrences"), F.countDistinct("of").alias("files"))


def trust(edges: DataFrame, issues: DataFrame) -> DataFrame:
    """How much of the index to trust: the share of confirmed edges and what was not read, as a level."""
    n = edges.filter("tier <> 'excluded'").agg(F.count("*").alias("edges"), F.count_if(F.col("tier") == "confirmed").alias("confirmed"))
    gaps = issues.agg(F.count("*").alias("gaps"))
    share = F.when(F.col("edges") > 0, F.col("confirmed") / F.col("edges")).otherwise(F.lit(1.0))
    return n.crossJoin(F.broadcast(gaps)).withColumn("share", F.round(share, 4)).withColumn("level", F.when(F.col("gaps") > 0, "partial").when(F.col("share") >= 0.9, "high").when(F.col("share") >= 0.6, "medium").otherwise("low"))


def direct_tests(symbol: DataFrame, files: DataFrame, edges: DataFrame, import_edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Links from test files to a symbol: ``file, line, link`` (import, call, test-case, reference, unverified-call)."""
    tests = files.filter("is_test").select("file")
    ids = symbol.select(F.col("symbol_id").alias("to_id"))
    sites = edges.join(ids, "to_id", "left_semi").join(tests, "file", "left_semi").filter("tier <> 'excluded'")
    cases = symbols.filter("entry_kind = 'test'").select(F.col("symbol_id").alias("enclosing_id")).withColumn("case", F.lit(True))
    link = F.when(F.col("tier") == "unverified", "unverified-call").when(F.col("case"), "test-case").otherwise("call")
    called = sites.join(cases, "enclosing_id", "left").select("file", "line", link.alias("link"))
    imported = import_edges.join(symbol.select(F.col("file").alias("dst")), "dst", "left_semi").join(tests.withColumnRenamed("file", "src"), "src").select(F.col("src").alias("file"), F.lit(None).cast("int").alias("line"), F.lit("import").alias("link"))
    return called.unionByName(imported).distinct()


def export_closure(exports: DataFrame, import_edges: DataFrame, depth: int = 8) -> DataFrame:
    """What each file exports, re-exports followed: ``file, name, line, origin``; a star's names list the barrel's line."""
    own = exports.filter("source IS NULL").select("file", "name", "line", F.col("file").alias("origin"))
    edges = exports.filter("source IS NOT NULL").join(import_edges.filter("dst IS NOT NULL").select(F.col("src").alias("file"), F.col("module").alias("source"), "dst"), ["file", "source"])
    out = own
    for _ in range(depth):
        step = edges.join(out.select(F.col("file").alias("dst"), F.col("name").alias("inner"), "origin"), "dst")
        wanted = F.coalesce("alias", "name")
        found = step.filter((F.col("type") == "re-export-all") | (wanted == F.col("inner"))).select("file", F.when(F.col("type") == "re-export-all", F.col("inner")).otherwise(F.col("name")).alias("name"), "line", "origin")
        grown = own.unionByName(found).distinct()
        if depth > 1 and grown.count() == out.count():
            return grown
        out = grown
    return out


def self_sum(account: DataFrame) -> DataFrame:
    """Whether an account adds up."""
    return account.select((F.expr("confirmed + unverified + excluded + non_call + unparsed + unsupported + unaccounted") == F.col("total")).alias("balanced"))
