"""Git as a source: diffs and histories by subprocess on the driver, as DataFrames."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REF = re.compile(r"(?!-)[A-Za-z0-9_][A-Za-z0-9_./@{}~^-]{0,199}\Z")


class GitError(ValueError):
    """``kind`` tells a folder without a repository from a failed command."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def checked_ref(ref: str) -> str:
    """The ref, unless it could be read as an option or a range."""
    if not _REF.match(ref) or ".." in ref:
        raise GitError("bad-ref", f"not a ref: {ref}")
    return ref


def _git(root: str, *args: str) -> str:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=120)
    except (OSError, subprocess.SubprocessError) as wrong:
        raise GitError("diff-failed", str(wrong)) from wrong
    if done.returncode:
        message = done.stderr.decode("utf-8", "replace")
        raise GitError("not-a-repo" if "not a git repository" in message.lower() else "diff-failed", message.strip())
    return done.stdout.decode("utf-8", "replace")


def diff(spark: SparkSession, root: str, base: str = "HEAD", staged: bool = False) -> DataFrame:
    """``file, diff``: each changed file's patch without context; empty when clean."""
    text = _git(root, "diff", "--unified=0", "--no-color", "--no-ext-diff", *(["--cached"] if staged else []), checked_ref(base))
    parts = re.split(r"(?m)^diff --git ", text)[1:]
    rows = []
    for part in parts:
        to = re.search(r"(?m)^\+\+\+ (?:b/)?(.+)$", part)
        was = re.search(r"(?m)^--- (?:a/)?(.+)$", part)
        name = next((m[1] for m in (to, was) if m and m[1] != "/dev/null"), None)
        if name:
            rows.append((name, part))
    return spark.createDataFrame(rows, "file string, diff string")


def show(root: str, rel: str, ref: str = "HEAD") -> str:
    """A file's text at a ref."""
    if rel.startswith(("/", "-")) or ".." in rel.split("/"):
        raise GitError("bad-path", rel)
    return _git(root, "show", f"{checked_ref(ref)}:{rel}")


def history(spark: SparkSession, root: str, limit: int = 10_000) -> DataFrame:
    """``file, commits, authors, last_commit, last_change``: one row for each file of the last ``limit`` commits."""
    text = _git(root, "log", f"--max-count={int(limit)}", "--name-only", "--format=%x01%H%x02%an%x02%aI")
    rows = []
    for block in text.split("\x01")[1:]:
        head, *names = block.split("\n")
        commit, author, when = head.split("\x02")
        rows += [(n, commit, author, when) for n in names if n]
    log = spark.createDataFrame(rows, "file string, commit string, author string, at string").withColumn("at", F.to_timestamp("at"))
    return log.groupBy("file").agg(F.count("*").alias("commits"), F.countDistinct("author").alias("authors"), F.max_by("commit", "at").alias("last_commit"), F.max("at").alias("last_change"))
