"""Operators over ``lines``: text search, usages, ground set, source ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefold.functions.text import checked_regex, has_identifier, has_word, matches_filters
from codefold.operators.edges import within_ranges


def lines_of(files: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """``file, line, text``: one row for each line; lines count from 1 and a final newline opens an empty one."""
    return files.select(F.col(key).alias("file"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "text")).select("file", (F.col("pos") + 1).alias("line"), "text")


def line_match(text: Column, term: str, regex: bool = False, case_sensitive: bool = False) -> Column:
    """Literal and without regard to case unless told otherwise."""
    if regex:
        return text.rlike(("" if case_sensitive else "(?i)") + checked_regex(term))
    return text.contains(term) if case_sensitive else F.lower(text).contains(term.lower())


def search(lines: DataFrame, term: str, regex: bool = False, case_sensitive: bool = False, code_only: bool = False, exclude: list[str] | None = None, within: str | None = None, top: int | None = None) -> DataFrame:
    """Matching lines in canonical order; ``top`` keeps the first so many. ``code_only`` reads the ``masked`` column, where comments and strings are blank."""
    text = F.col("masked") if code_only else F.col("text")
    found = lines.filter(line_match(text, term, regex, case_sensitive) & matches_filters(F.col("file"), exclude, within)).select("file", "line", "text")
    if top is not None:
        found = found.orderBy(F.lower("file"), "file", "line").limit(top)
    return found


def with_context(matches: DataFrame, lines: DataFrame, n: int) -> DataFrame:
    """Each match with the ``n`` lines before and after as arrays: an equi-join by (file, line), so a long file is spread over tasks."""
    near = matches.select("file", "line", "text", F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("step")).withColumn("at", F.col("line") + F.col("step"))
    own = lines.select(F.col("file").alias("of"), F.col("line").alias("at_line"), F.col("text").alias("near"))
    found = near.join(own, (F.col("file") == F.col("of")) & (F.col("at") == F.col("at_line"))).groupBy("file", "line", "text").agg(F.sort_array(F.collect_list(F.struct("step", "near"))).alias("all"))
    side = lambda keep: F.transform(F.filter("all", keep), lambda x: x["near"])
    return found.select("file", "line", "text", side(lambda x: x["step"] < 0).alias("before"), side(lambda x: x["step"] > 0).alias("after"))


def ground_set(lines: DataFrame, name: str) -> DataFrame:
    """Every (file, line) whose text has the name as a word, once."""
    return lines.filter(has_word(F.col("text"), name)).select("file", "line").distinct()


def textual_usages(lines: DataFrame, name: str) -> DataFrame:
    """Lines that hold the name as an identifier, ``$`` included."""
    return lines.filter(has_identifier(F.col("text"), name)).select("file", "line", "text")


USAGE_RANK = {"call": 0, "import": 1, "definition": 2, "reference": 3, "unclassified": 4}


def usages(parsed: DataFrame, symbols: DataFrame, lines: DataFrame, name: str, code_only: bool = False) -> DataFrame:
    """All usages of a name: parsed ones, definitions, and textual lines that neither claims; one row for each (file, line, type)."""
    own = parsed.filter(F.col("name") == name).select("file", "line", F.col("usage_type"))
    defined = symbols.filter(F.col("name") == name).select("file", F.coalesce("name_line", "start_line").alias("line"), F.lit("definition").alias("usage_type"))
    known = own.unionByName(defined).distinct()
    if code_only:
        return known
    rest = textual_usages(lines, name).select("file", "line").join(known.select("file", "line").distinct(), ["file", "line"], "left_anti")
    return known.unionByName(rest.withColumn("usage_type", F.lit("unclassified")))


def source_range(lines: DataFrame, file: str, first: int, last: int) -> DataFrame:
    """Lines of one file between two numbers, in either order."""
    low, high = sorted((first, last))
    return lines.filter((F.col("file") == file) & F.col("line").between(max(1, low), high)).select("file", "line", "text")


def source_of(symbols: DataFrame, lines: DataFrame, max_lines: int | None = None) -> DataFrame:
    """The code of each symbol as one string."""
    end = F.col("end_line") if max_lines is None else F.least("end_line", F.col("start_line") + max_lines - 1)
    own = symbols.select("symbol_id", "file", F.col("start_line").alias("s"), end.alias("e"))
    inside = within_ranges(lines.select("file", "line", "text"), own)
    return inside.groupBy("symbol_id", "file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("code"))


def file_lengths(lines: DataFrame) -> DataFrame:
    """Lines in each file where a newline ends a line, so an empty file has none."""
    last = F.max(F.struct("line", "text"))
    return lines.groupBy("file").agg(last.alias("last")).select("file", (F.col("last.line") - (F.col("last.text") == "").cast("int")).alias("lines"))
