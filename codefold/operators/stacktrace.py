"""Stack traces: frames from text, and the files, code and functions they point to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefold.operators.edges import innermost

#: Frame patterns in priority order: runtime, pattern, groups of function, file, line, column (0: none). Fixed values.
FRAMES = [
    ("python", r'^\s*File "([^"]+)", line (\d+)(?:, in (.+))?', 3, 1, 2, 0),
    ("rust", r"^\s+at (\.?/?[^\s:]+\.rs):(\d+)(?::(\d+))?", 0, 1, 2, 3),
    ("node", r"^\s*at (?:async )?(.+?) \((?:file://)?([^()]+?):(\d+):(\d+)\)", 1, 2, 3, 4),
    ("node", r"^\s*at (?:async )?(?:file://)?([^\s()]+?):(\d+):(\d+)\s*$", 0, 1, 2, 3),
    ("csharp", r"^\s*at (.+?)\(.*?\) in (.+?):line (\d+)", 1, 2, 3, 0),
    ("java", r"^\s*at ([\w.$<>]+)\(([\w$]+\.(?:java|kt|scala|groovy)):(\d+)\)", 1, 2, 3, 0),
    ("firefox", r"^\s*([^@\s]*)@(?:file://|https?://[^/]+/)?(.+?):(\d+):(\d+)\s*$", 1, 2, 3, 4),
    ("go", r"^\s+(/?[^\s:]+\.go):(\d+)(?: \+0x[0-9a-f]+)?", 0, 1, 2, 0),
    ("rust", r"panicked at (?:'.*?', )?([^\s:]+\.rs):(\d+):(\d+)", 0, 1, 2, 3),
    ("gdb", r"^\s*#\d+\s+(?:0x[0-9a-f]+ in )?([\w:~<>]+)\s*\(.*?\) at ([^\s:]+):(\d+)", 1, 2, 3, 0),
    ("asan", r"^\s*#\d+ 0x[0-9a-f]+ in (.+?) ([^\s:]+):(\d+)(?::(\d+))?", 1, 2, 3, 4),
    ("ruby", r"^\s*(?:from )?([^\s:]+\.rb):(\d+):in [`'](.+?)'", 3, 1, 2, 0),
    ("php", r"^\s*#\d+ ([^\s(]+\.php)\((\d+)\): (.+?)\(", 3, 1, 2, 0),
    ("compiler", r"^\s*([^\s:()]+\.\w+):(\d+):(\d+)", 0, 1, 2, 3),
    ("plain", r"^\s*(?:at )?([^\s:()]+\.\w+):(\d+)\s*$", 0, 1, 2, 0),
]


def parse(traces: DataFrame, text: str = "stack") -> DataFrame:
    """``trace_id, pos, function, path, line, col, runtime``: lines split at newlines, real or written out; the first pattern that fits wins."""
    rows = traces.select("trace_id", F.posexplode(F.split(F.col(text), r"\n|\\n", -1)).alias("pos", "raw"))

    which = F.lit(None).cast("int")
    for k, (_, pattern, *_groups) in reversed(list(enumerate(FRAMES))):
        which = F.when(F.col("raw").rlike(pattern), k).otherwise(which)
    # the pattern is chosen once, and each part then takes one expression
    rows = rows.withColumn("which", which).filter("which IS NOT NULL")

    def part(g: int) -> Column:
        out = F.lit(None).cast("string")
        for k, (_, pattern, *groups) in enumerate(FRAMES):
            if groups[g]:
                out = F.when(F.col("which") == k, F.nullif(F.regexp_extract("raw", pattern, groups[g]), F.lit(""))).otherwise(out)
        return out

    runtimes = F.array(*(F.lit(f[0]) for f in FRAMES))
    found = rows.select("trace_id", "pos", "raw", part(0).alias("function"), part(1).alias("path"), part(2).cast("int").alias("line"), part(3).cast("int").alias("col"), F.get(runtimes, F.col("which")).alias("runtime"))
    return found.filter("path IS NOT NULL")


def resolve(frames: DataFrame, files: DataFrame, root: str | None = None) -> DataFrame:
    """The project file of each frame: file names must be equal, then the most trailing folders in common; ties are ambiguous.

    Paths that leave the root (``..``) or are absolute outside it are refused.
    An equi-join on the file name; similarity is a count over two short arrays.
    """
    path = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^\./", "")
    outside = path.rlike(r"(^|/)\.\.(/|$)")
    if root:
        path = F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(path)
    frames = frames.withColumn("norm", path).withColumn("refused", outside).withColumn("base", F.regexp_extract("norm", r"([^/]+)$", 1)).withColumn("frame_id", F.concat_ws("/", F.col("trace_id").cast("string"), F.col("pos").cast("string")))
    own = files.select("file", "rel", F.regexp_extract("rel", r"([^/]+)$", 1).alias("base"))
    pairs = frames.filter("NOT refused").select("frame_id", "norm", "base").join(own, "base")
    a, b = F.reverse(F.split("norm", "/")), F.reverse(F.split("rel", "/"))
    same = F.aggregate(F.arrays_zip(a.alias("x"), b.alias("y")), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, z: F.struct(F.when(s["on"] & (z["x"] == z["y"]), s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & F.coalesce(z["x"] == z["y"], F.lit(False))).alias("on")), lambda s: s["n"])
    scored = pairs.withColumn("same", same).withColumn("whole", F.col("norm") == F.col("rel"))
    best = scored.groupBy("frame_id").agg(F.max(F.struct("whole", "same")).alias("b"))
    top = scored.join(best, "frame_id").filter("whole = b.whole AND same = b.same").groupBy("frame_id").agg(F.min("file").alias("file"), F.count("*").alias("ties"), F.first("same").alias("same"), F.first("whole").alias("whole"), F.first(F.size(F.split("norm", "/"))).alias("depth"))
    out = frames.join(top, "frame_id", "left")
    confidence = F.when(F.col("refused"), 0.0).when(F.col("file").isNull(), 0.0).when(F.col("whole"), 1.0).when(F.col("ties") > 1, 0.5).when(F.col("same") >= F.col("depth"), 0.9).when(F.col("same") >= 3, 0.8).when(F.col("same") == 2, 0.7).otherwise(0.6)
    state = F.when(F.col("refused"), "refused").when(F.col("file").isNull(), "unresolved").otherwise("resolved")
    return out.select("trace_id", "pos", "function", "path", "file", "line", "col", "runtime", confidence.alias("confidence"), state.alias("state"))


def enriched(resolved: DataFrame, lines: DataFrame, symbols: DataFrame, context: int = 2) -> DataFrame:
    """Resolved frames with the line's code, the lines around it, and the enclosing function."""
    sites = resolved.filter("state = 'resolved'")
    near = sites.select("trace_id", "pos", "file", "line", F.explode(F.sequence(F.lit(-context), F.lit(context))).alias("step")).withColumn("at", F.col("line") + F.col("step"))
    text = near.join(lines.select("file", F.col("line").alias("at"), "text"), ["file", "at"]).groupBy("trace_id", "pos").agg(F.max(F.when(F.col("step") == 0, F.col("text"))).alias("code"), F.transform(F.sort_array(F.collect_list(F.struct("step", "text"))), lambda x: x["text"]).alias("around"))
    return resolved.join(text, ["trace_id", "pos"], "left").join(innermost(sites, symbols), ["file", "line"], "left")


def nth_on_line(calls: DataFrame) -> DataFrame:
    """Which of the same calls on one line each is, from 0."""
    return calls.withColumn("nth", F.row_number().over(Window.partitionBy("file", "line", "name").orderBy("seq")) - 1)
