"""Imports to files: candidate paths for each module, an equi-join with the files, and the first that exists."""

from __future__ import annotations

import posixpath
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefold.session import ship

_JS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".d.ts", ".json")


def candidates(rel: str, language: str, module: str, roots: dict[str, str]) -> list[str]:
    """Paths a module may name, best first. ``roots``: ``go`` module path, ``alias:<prefix>`` folders."""
    folder = posixpath.dirname(rel)
    at = lambda *p: posixpath.normpath(posixpath.join(*p)).lstrip("/")
    if not module:
        return []
    if language in ("javascript", "typescript", "tsx", "html"):
        base = None
        if module.startswith((".", "/")):
            base = [at(folder, module)]
        else:
            base = [at(target, module[len(prefix) :].lstrip("/")) for prefix, target in ((k[6:], v) for k, v in sorted(roots.items()) if k.startswith("alias:")) if module.startswith(prefix)]
        out = []
        for b in base:
            stem = re.sub(r"\.(js|jsx|mjs)$", "", b)
            out += [b, *(stem + e for e in (".ts", ".tsx") if stem != b), *(b + e for e in _JS), *(f"{b}/index{e}" for e in _JS)]
        return out
    if language == "python":
        dots = len(module) - len(module.lstrip("."))
        path = module.lstrip(".").replace(".", "/")
        starts = [at(folder, *[".."] * (dots - 1))] if dots else ["", "src", folder]
        out = []
        for s in starts:
            b = at(s, path) if path else (s or ".")
            out += [f"{b}.py", f"{b}/__init__.py"] if path else [f"{b}/__init__.py"]
        return out
    if language == "go":
        own = roots.get("go", "")
        return [at(module[len(own) :].lstrip("/") or ".") + "/"] if own and module.startswith(own) else []
    if language == "rust":
        parts = [p for p in module.split("::") if p]
        if not parts:
            return []
        src = rel.split("src/")[0] + "src" if "src/" in rel else "src"
        here = folder if posixpath.basename(rel) in ("mod.rs", "lib.rs", "main.rs") else rel[:-3]
        base, rest = (src, parts[1:]) if parts[0] == "crate" else (posixpath.dirname(here), parts[1:]) if parts[0] == "super" else (here, parts[1:]) if parts[0] == "self" else (None, [])
        if base is None:
            return []
        out = []
        for n in range(len(rest), 0, -1):
            b = at(base, *rest[:n])
            out += [f"{b}.rs", f"{b}/mod.rs"]
        return out
    if language == "java":
        path = module.replace(".", "/")
        return [f"**/{path[:-2]}/"] if path.endswith("/*") else [f"**/{path}.java", f"**/{posixpath.dirname(path)}.java"]
    if language in ("c", "cpp"):
        return [at(folder, module), module, f"include/{module}", f"src/{module}", *(f"{v}/{module}" for k, v in sorted(roots.items()) if k.startswith("include:"))]
    return []


def import_edges(imports: DataFrame, files: DataFrame, roots: dict[str, str] | None = None, namespaces: DataFrame | None = None) -> DataFrame:
    """``src, dst, module`` (``dst`` null for what lies outside).

    Candidates are generated per import in Arrow batches, then joined with the
    files three ways: by path, by folder (packages) and by path suffix. A package
    fans out to its folder's files but tests. ``namespaces`` (``module, file``)
    resolves C#.
    """
    ship(imports.sparkSession)
    known = dict(roots or {})

    @F.pandas_udf("array<string>")
    def paths(rel: pd.Series, language: pd.Series, module: pd.Series) -> pd.Series:
        return pd.Series([candidates(r, lang, m or "", known) for r, lang, m in zip(rel, language, module)])

    own = imports.join(files.select("file", "language"), "file").select("file", "module", "language").distinct()
    tried = own.select("file", "module", F.posexplode_outer(paths("file", "language", "module")).alias("rank", "path"))
    exact = tried.join(files.select(F.col("rel").alias("path"), F.col("file").alias("dst")), "path").select("file", "module", "rank", "dst")
    folders = files.filter("NOT is_test").select(F.concat(F.when(F.col("dir") == "", ".").otherwise(F.col("dir")), F.lit("/")).alias("path"), F.col("file").alias("dst"))
    package = tried.join(folders, "path").select("file", "module", "rank", "dst")
    # suffixes of every path, so that "**/a/B.java" is an equi-join too
    parts = F.split("rel", "/")
    suffixes = files.filter("language = 'java'").select(F.col("file").alias("dst"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("**/"), F.array_join(F.slice(F.split("rel", "/"), i, F.lit(1000)), "/")))).alias("path"))
    deep = tried.join(suffixes, "path").select("file", "module", "rank", "dst")
    wide = tried.filter("path LIKE '**/%/'").join(suffixes.select("dst", F.concat(F.regexp_replace("path", "/[^/]*$", ""), F.lit("/")).alias("path")), "path").select("file", "module", "rank", "dst")
    found = exact.unionByName(package).unionByName(deep).unionByName(wide)
    if namespaces is not None:
        found = found.unionByName(own.join(namespaces.select("module", F.col("file").alias("dst")), "module").select("file", "module", F.lit(0).alias("rank"), "dst"))
    best = found.groupBy("file", "module").agg(F.min("rank").alias("rank"))
    chosen = found.join(best, ["file", "module", "rank"]).filter(F.col("dst") != F.col("file")).select("file", "module", "dst").distinct()
    return own.join(chosen, ["file", "module"], "left").select(F.col("file").alias("src"), "dst", "module")


def inheritance(symbols: DataFrame) -> DataFrame:
    """``child, child_file, parent``: base names without generics and qualifiers."""
    bare = F.regexp_extract(F.regexp_replace(F.trim("base"), "<.*$", ""), r"([A-Za-z_$][\w$]*)$", 1)
    return symbols.filter("family = 'type'").select(F.col("name").alias("child"), F.col("file").alias("child_file"), F.explode("bases").alias("base")).select("child", "child_file", bare.alias("parent")).filter("parent <> ''").distinct()


def parents(inherit: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Each base's definition: of the same file, else of an imported one, else the first."""
    types = symbols.filter("family = 'type'").select(F.col("name").alias("parent"), F.col("file").alias("parent_file"), "symbol_id")
    near = edges.filter("dst IS NOT NULL").select(F.col("src").alias("child_file"), F.col("dst").alias("parent_file")).distinct().withColumn("imported", F.lit(1))
    both = inherit.join(types, "parent").join(near, ["child_file", "parent_file"], "left")
    rank = F.when(F.col("child_file") == F.col("parent_file"), 0).when(F.col("imported") == 1, 1).otherwise(2)
    return both.groupBy("child", "child_file", "parent").agg(F.min(F.struct(rank.alias("rank"), "parent_file", "symbol_id")).alias("b")).select("child", "child_file", "parent", F.col("b.parent_file").alias("parent_file"), F.col("b.symbol_id").alias("parent_id"))


def importers(edges: DataFrame, target: str) -> DataFrame:
    return edges.filter(F.col("dst") == target).select("src", "module").distinct()


def include_roots(commands: DataFrame) -> dict[str, str]:
    """Include folders of a compile database (``spark.read.json(path, multiLine=True)``: ``command`` or ``arguments``), relative to the root, as ``roots``."""
    text = F.coalesce(F.col("command") if "command" in commands.columns else F.lit(None).cast("string"), F.array_join("arguments", " ") if "arguments" in commands.columns else F.lit(""))
    found = commands.select(F.explode(F.regexp_extract_all(text, F.lit(r"-(?:I|isystem)\s*(\S+)"), F.lit(1))).alias("folder")).distinct()
    return {f"include:{i}": r.folder.removeprefix("./").rstrip("/") for i, r in enumerate(found.orderBy("folder").collect())}


def bound_names(imports: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``file, name, external``: names that imports bind, where these stand for modules.

    A name of a module outside the project is external; relative modules never
    are. Of the project's own only packages count, and names that are a module's
    last part and no definition's.
    """
    named = imports.filter("NOT dynamic").select("file", "module", F.explode(F.arrays_zip("names", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))).alias("x"))
    named = named.select("file", "module", F.when(F.coalesce("x.aliases", F.lit("")) != "", F.col("x.aliases")).otherwise(F.col("x.names")).alias("name"))
    inside = edges.groupBy(F.col("src").alias("file"), "module").agg(F.max(F.col("dst").isNotNull()).alias("inside"))
    found = named.join(inside, ["file", "module"]).withColumn("external", ~F.col("inside") & ~F.col("module").rlike("^(\\.|/|crate|self|super)"))
    tail = F.element_at(F.split("module", "[./:]+"), -1) == F.col("name")
    own = found.filter(~F.col("external") & tail).join(symbols.select("name").distinct(), "name", "left_anti")
    return found.filter("external").select("file", "name", "external").unionByName(own.select("file", "name", "external")).distinct()


def test_importers(edges: DataFrame, exports: DataFrame, files: DataFrame, target: str, name: str, depth: int = 8) -> DataFrame:
    """Test files that import a file, directly or through files that export the name again."""
    own = edges.filter("dst IS NOT NULL").select("src", "dst").distinct()
    carriers = exports.filter((F.col("name").isin(name, "*")) & F.col("source").isNotNull()).select(F.col("file").alias("src")).distinct()
    level = found = edges.sparkSession.createDataFrame([(target,)], "dst string")
    for _ in range(depth):
        level = own.join(level, "dst").select("src").distinct().join(carriers, "src", "left_semi").select(F.col("src").alias("dst"))
        found = found.unionByName(level)
    return own.join(found.distinct(), "dst").select(F.col("src").alias("file")).distinct().join(files.filter("is_test").select("file"), "file", "left_semi")
