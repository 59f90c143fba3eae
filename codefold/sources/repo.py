"""Source trees as fact tables: discovery on the driver, parsing in Arrow batches on the executors."""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
import subprocess
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from codefold.functions.text import path_glob_pattern
from codefold.schemas import CALLS, EXPORTS, FILES, IMPORTS, ISSUES, SYMBOLS, USAGES
from codefold.session import ship
from codefold.sources.languages import IGNORED, MARKERS, UNSUPPORTED, language_of

MAX_FILES, MAX_DEPTH, MAX_BYTES = 50_000, 1000, 8 << 20
_GENERATED = re.compile(r"(?i)@generated|code generated .* do not edit|auto-?generated|do not edit")
_TEST = re.compile(r"(^|/)(tests?|__tests__|spec|__mocks__|fixtures?)/|[._-](test|spec)s?\.[a-z]+$|(^|/)test_[^/]*\.py$|_test\.(go|py|c|cc|cpp|rs)$|Tests?\.(java|cs)$", re.I)


#: Reason of a file whose content no reader gave.
NO_CONTENT = "no content"


def project_root(start: str) -> str:
    """The nearest folder upwards with a marker file, else ``start``."""
    at = Path(start).resolve()
    return str(next((p for p in (at, *at.parents) if any((p / m).exists() for m in MARKERS)), at))


def gitignore_rules(root: str) -> list[tuple[bool, re.Pattern]]:
    """``(keep, pattern)`` of the root's ``.gitignore``, in order; the last match wins."""
    try:
        lines = Path(root, ".gitignore").read_text(encoding="utf-8", errors="replace").splitlines()
    except OSError:
        return []
    out = []
    for line in (x.strip() for x in lines):
        if line and not line.startswith("#"):
            keep, line = line.startswith("!"), line.lstrip("!")
            anchored, line = "/" in line.strip("/") or line.startswith("/"), line.strip("/")
            body = path_glob_pattern(line)[1:-1]
            out.append((keep, re.compile(f"^{'' if anchored else '(?:.*/)?'}{body}(?:/.*)?$")))
    return out


def tracked(root: str) -> set[str]:
    """What git tracks; ignore rules don't hide it."""
    try:
        found = subprocess.run(["git", "-C", root, "ls-files", "-z"], capture_output=True, timeout=60)
    except (OSError, subprocess.SubprocessError):
        return set()
    return set(filter(None, found.stdout.decode("utf-8", "replace").split("\0"))) if not found.returncode else set()


def discover(root: str, include: str | None = None, exclude: list[str] = (), max_files: int = MAX_FILES, max_depth: int = MAX_DEPTH, max_bytes: int = MAX_BYTES) -> tuple[list[tuple], list[tuple]]:
    """``(path, rel, language, size)`` in canonical order and issues ``(rel, kind, reason, language)``.

    Directories are followed through links once (by real path). What a limit
    leaves out is an issue, never silent.
    """
    rules, known, seen, files, issues = gitignore_rules(root), tracked(root), set(), [], []
    wanted = re.compile(path_glob_pattern(include)) if include else None

    def walk(folder: str, depth: int) -> None:
        real = os.path.realpath(folder)
        if real in seen:
            return
        seen.add(real)
        rel_of = os.path.relpath(folder, root)
        if depth > max_depth:
            issues.append((rel_of, "skipped", "max-depth", None))
            return
        try:
            entries = sorted(os.scandir(folder), key=lambda e: (e.name.lower(), e.name))
        except OSError:
            issues.append((rel_of, "skipped", "unreadable-directory", None))
            return
        for entry in entries:
            rel = os.path.relpath(entry.path, root).replace(os.sep, "/")
            hidden = entry.name in IGNORED or any(fnmatch.fnmatch(rel, p) or fnmatch.fnmatch(entry.name, p) for p in exclude)
            for keep, pattern in rules:
                if pattern.match(rel):
                    hidden = not keep
            if hidden and not (rel in known or any(k.startswith(rel + "/") for k in known)):
                continue
            if entry.is_dir():
                walk(entry.path, depth + 1)
            elif entry.is_file():
                language, ext = language_of(rel), os.path.splitext(rel)[1].lower()
                if wanted and not wanted.match(rel):
                    continue
                if language is None:
                    if ext in UNSUPPORTED:
                        issues.append((rel, "unsupported", ext, UNSUPPORTED[ext]))
                elif entry.stat().st_size > max_bytes:
                    issues.append((rel, "skipped", "max-file-size", language))
                else:
                    files.append((entry.path, rel, language, entry.stat().st_size))

    walk(root, 0)
    files.sort(key=lambda f: (f[1].lower(), f[1]))
    issues += [(rel, "skipped", "max-files", language) for _, rel, language, _ in files[max_files:]]
    return files[:max_files], issues


def _contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, content`` of these files by Spark's binary reader."""
    if not paths:
        return spark.createDataFrame([], "path string, content binary")
    read = spark.read.format("binaryFile").load([f"file://{quote(p)}" for p in paths])
    return read.select(F.url_decode(F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), r"\+", "%2B")).alias("path"), "content")


def source_files(spark: SparkSession, root: str, **limits) -> tuple[DataFrame, DataFrame]:
    """``path, rel, language, content`` of the files that count, and the issues. Content is null where the reader gave none."""
    files, issues = discover(root, **limits)
    listed = spark.createDataFrame(files, "path string, rel string, language string, size long")
    # Spark leaves empty files out
    whole = listed.join(_contents(spark, [f[0] for f in files if f[3]]), "path", "left").withColumn("content", F.when(F.col("size") == 0, F.lit(bytearray())).otherwise(F.col("content")))
    return whole.drop("size"), spark.createDataFrame(issues, ISSUES)


def gap_lines(spark: SparkSession, root: str, issues: DataFrame) -> DataFrame:
    """``file, line, text`` of readable files in languages without an adapter: their text counts, though nothing in it is resolved."""
    rels = [r.rel for r in issues.filter("kind = 'unsupported'").select("rel").collect()]
    listed = spark.createDataFrame([(os.path.join(root, r), r) for r in rels], "path string, file string")
    text = listed.join(_contents(spark, [os.path.join(root, r) for r in rels]), "path").select("file", F.decode("content", "UTF-8").alias("text"))
    return text.select("file", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).select("file", (F.col("pos") + 1).alias("line"), "text")


def document_files(table: DataFrame, id_col: str, text_col: str, language: str, suffix: str) -> DataFrame:
    """Rows of any table as files of one language."""
    rel = F.concat(F.col(id_col).cast("string"), F.lit(suffix))
    return table.select(rel.alias("path"), rel.alias("rel"), F.lit(language).alias("language"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("content"))


def extract(text: str, language: str) -> dict:
    if language == "python":
        from codefold.sources.python_adapter import extract as own

        return own(text)
    if language == "html":
        from codefold.sources.html_adapter import extract as own

        return own(text)
    from codefold.sources.lexical_adapter import extract as own

    return own(text, language)


#: More adapters: language -> function of the text, for callers that register their own.
ADAPTERS: dict[str, object] = {}
_PARTS = {"symbols": SYMBOLS, "calls": CALLS, "usages": USAGES, "imports": IMPORTS, "exports": EXPORTS}
_FACTS = f"{FILES}, " + ", ".join(f"{name} array<struct<{ddl}>>" for name, ddl in _PARTS.items()) + f", masked array<string>, texts array<string>, issue struct<{ISSUES}>"


def facts(files: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each file with all its facts nested; explode with ``relations``. A file that can't be parsed has an issue instead.

    ``wanted``: the relations that will be read (``lines`` among them); the others
    stay empty, so their rows are neither built nor moved.
    """
    spark = files.sparkSession
    ship(spark)
    schema = T.StructType.fromDDL(_FACTS)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    names = {part: [f.name for f in schema[part].dataType.elementType] for part in _PARTS}
    adapters, whole = dict(ADAPTERS), wanted is None or "lines" in wanted
    parts = [p for p in _PARTS if wanted is None or p in wanted]

    def parse(batches):
        from codefold.sources.masking import masked

        for batch in batches:
            rows = []
            for path, rel, language, content in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if content is None:
                    rows.append(dict.fromkeys(arrow.names) | dict.fromkeys(_PARTS, []) | {"file": rel, "rel": rel, "dir": rel.rpartition("/")[0], "language": language, "lines": 0, "size": 0, "is_test": bool(_TEST.search(rel)), "is_bundled": False, "is_generated": False, "texts": [], "masked": [], "issue": {"rel": rel, "kind": "unreadable", "reason": NO_CONTENT, "language": language}})
                    continue
                text = content.decode("utf-8", "replace")
                lines = text.split("\n")
                count = len(lines) - (lines[-1] == "")
                row = {
                    "file": rel, "rel": rel, "dir": rel.rpartition("/")[0], "language": language, "lines": count, "hash": hashlib.md5(content).hexdigest(), "size": len(content), "is_test": bool(_TEST.search(rel)),
                    "is_bundled": len(content) >= 100 << 10 and len(content) / max(1, count) > 500, "is_generated": bool(_GENERATED.search(text[:500])), "texts": lines if whole else [], "masked": [] if not whole else masked(text, language).split("\n") if language != "html" else lines,
                }
                try:
                    found = adapters[language](text) if language in adapters else extract(text, language)
                    if any(s["end_line"] < s["start_line"] for s in found["symbols"]):
                        raise ValueError("a symbol ends before it starts")
                except (SyntaxError, ValueError, RecursionError) as wrong:
                    row |= dict.fromkeys(_PARTS, []) | {"issue": {"rel": rel, "kind": "unparsed", "reason": str(wrong)[:200], "language": language}}
                    rows.append(row)
                    continue
                row |= dict.fromkeys(_PARTS, [])
                for part in parts:
                    row[part] = [{n: x.get(n) for n in names[part]} | {"file": rel} for x in found[part]]
                for s in row["symbols"]:
                    s |= {"rel": rel, "language": language, "symbol_id": f"{rel}:{s['start_line']}:{s['owner'] or ''}:{s['name']}:{s['kind']}"}
                rows.append(row | {"issue": None})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "rel", "language", "content").mapInArrow(parse, schema)


def relations(nested: DataFrame, issues: DataFrame | None = None) -> dict[str, DataFrame]:
    """The relations of §1 from nested facts. Write ``nested`` once before: each relation reads only its column."""
    out = {name: nested.select(F.explode(name).alias("x")).select("x.*") for name in _PARTS}
    out["files"] = nested.select(*(x.strip().split(" ")[0] for x in FILES.split(",")))
    both = F.arrays_zip(F.col("texts").alias("text"), F.col("masked").alias("masked"))
    out["lines"] = nested.select("file", F.posexplode(both).alias("pos", "x")).select("file", (F.col("pos") + 1).alias("line"), F.col("x.text").alias("text"), F.coalesce("x.masked", F.lit("")).alias("masked"))
    unparsed = nested.filter("issue IS NOT NULL").select("issue.*")
    out["file_issues"] = unparsed if issues is None else unparsed.unionByName(issues)
    return out


def save(nested: DataFrame, path: str) -> None:
    """The index on disk, by language, so that a query of one language prunes the others."""
    nested.write.mode("overwrite").partitionBy("language").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stale(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """``rel, change`` (added, changed, deleted) between listings with ``rel, hash``."""
    old = indexed.select("rel", F.col("hash").alias("old"))
    both = current.select("rel", F.col("hash").alias("new")).join(old, "rel", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return both.select("rel", change.alias("change")).filter("change IS NOT NULL")


def merged(indexed: DataFrame, files: DataFrame) -> DataFrame:
    """The index after an update: unchanged files' facts as they are, the others parsed anew; deleted ones go. Equal to a fresh build."""
    now = files.withColumn("hash", F.md5("content"))
    same = indexed.join(now.select("rel", "hash"), ["rel", "hash"], "left_semi")
    fresh = now.join(indexed.select("rel", "hash"), ["rel", "hash"], "left_anti").drop("hash")
    return same.unionByName(facts(fresh))
