"""Graph operators over edge tables: bounded closures, trees, reachability, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefold.operators.pairs import dealt

#: Folders made for applications without ``spark.checkpoint.dir``, by application.
_OWN_DIRS: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``. Only a local master may do without that setting."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or _OWN_DIRS.get(context.applicationId)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN_DIRS[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="codefold-")
    return f"{base.rstrip('/')}/codefold/graph-{uuid.uuid4().hex}"


#: Depth up to which a closure is one plan; deeper ones are written level by level.
ONE_PLAN = 3


def cut(df: DataFrame, path: str) -> DataFrame:
    """Written to the shared folder and read back, so that plans of long loops stay short."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: 64-bit words of the bit table that goes to all tasks: 8,388,608 bits, whatever the input.
WORDS = 1 << 17


def near_nodes(edges: DataFrame, column: str, nodes: DataFrame) -> DataFrame:
    """The edges whose ``column`` is one of ``nodes`` (``node``), and a few others: what a bit table of fixed size lets through before anything is shuffled. The exact join must follow."""
    spot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(64 * WORDS))
    words = nodes.select(spot("node").alias("_spot")).groupBy(F.expr("shiftright(_spot, 6)").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_spot & 63 AS int)))").alias("_bits"))
    found = edges.withColumn("_spot", spot(column)).withColumn("_word", F.expr("shiftright(_spot, 6)")).join(F.broadcast(words), "_word")
    return found.filter("getbit(_bits, cast(_spot & 63 AS int)) = 1").select(*edges.columns)


def closure(edges: DataFrame, roots: DataFrame, depth: int | None = None, up: bool = False, sparse: bool = False) -> DataFrame:
    """``root, node, depth``: each node that the roots reach, at its least depth (roots at 0).

    ``edges``: ``src, dst``; ``roots``: ``node``, and ``root`` where a root has
    another name or several nodes at 0. Semi-naive: a round joins only
    the last frontier and removes what is known; the rounds end with the depth or
    an empty frontier, so cycles end too. A depth of ``ONE_PLAN`` or less is one
    plan, nothing written: a node met again deeper is dropped at the end.
    ``sparse``: few edges are met, so such a plan drops the others before it shuffles.
    """
    every = edges.select(F.col("dst" if up else "src").alias("at"), F.col("src" if up else "dst").alias("next")).filter("at IS NOT NULL AND next IS NOT NULL")
    steps = every.distinct()
    roots = roots.select(F.col("root" if "root" in roots.columns else "node").alias("root"), F.col("node")).distinct().withColumn("depth", F.lit(0))
    if depth is not None and depth <= ONE_PLAN:
        level = out = roots
        for k in range(1, depth + 1):
            met = near_nodes(every, "at", level) if sparse else steps
            level = level.join(met, F.col("node") == F.col("at")).select("root", F.col("next").alias("node")).distinct().withColumn("depth", F.lit(k))
            out = out.unionByName(level)
        return out.groupBy("root", "node").agg(F.min("depth").alias("depth"))
    spark, base = edges.sparkSession, scratch(edges.sparkSession)
    steps = cut(steps, f"{base}/edges")
    frontier, parts, k = cut(roots, f"{base}/level=0"), [], 0
    while True:
        parts.append(f"{base}/level={k}")
        if (depth is not None and k >= depth) or frontier.isEmpty():
            break
        k += 1
        known = spark.read.schema(frontier.schema).parquet(*parts).select("root", "node")
        fresh = frontier.join(steps, F.col("node") == F.col("at")).select("root", F.col("next").alias("node")).distinct().join(known, ["root", "node"], "left_anti")
        frontier = cut(fresh.withColumn("depth", F.lit(k)), f"{base}/level={k}")
    return spark.read.schema(frontier.schema).parquet(*parts)


def within(edges: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """``node``, each once: the targets and all that reach them in ``depth`` steps, whatever the target; a step holds each node once."""
    steps = edges.select(F.col("dst").alias("at"), F.col("src").alias("next")).filter("at IS NOT NULL AND next IS NOT NULL").distinct()
    level = out = targets.select("node").distinct()
    for _ in range(depth):
        level = level.join(steps, F.col("node") == F.col("at"), "inner").select(F.col("next").alias("node")).distinct()
        out = out.unionByName(level)
    return out.distinct()


def tree(edges: DataFrame, roots: DataFrame, depth: int = 3, up: bool = False, cap: int | None = 10) -> DataFrame:
    """The rows of a trace: ``root, parent, node, depth, ord, shown_before, children``.

    A node is expanded where it is first met, by least depth; every further edge
    to it is a leaf with ``shown_before``. Children go in canonical order; over
    ``cap`` are left out and counted in ``children``.
    """
    from pyspark.sql import Window

    met = closure(edges, roots, depth, up)
    steps = edges.select(F.col("dst" if up else "src").alias("parent"), F.col("src" if up else "dst").alias("node")).distinct()
    found = met.filter(F.col("depth") < depth).select("root", F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth")).join(steps, "parent")
    sizes = found.groupBy("root", "parent").agg(F.count("*").alias("children"))
    found = found.withColumn("ord", F.row_number().over(Window.partitionBy("root", "parent").orderBy("node")))
    if cap is not None:  # directly above the window, so that Spark keeps no more in each task
        found = found.filter(F.col("ord") <= cap)
    found = found.join(sizes, ["root", "parent"])
    least = met.select("root", "node", F.col("depth").alias("least"))
    first = Window.partitionBy("root", "node").orderBy("depth", "parent")
    found = found.join(least, ["root", "node"], "left").withColumn("nth", F.row_number().over(first))
    return found.select("root", "parent", "node", "depth", "ord", ((F.col("depth") > F.col("least")) | (F.col("nth") > 1)).alias("shown_before"), "children")


def reverse_to_roots(edges: DataFrame, targets: DataFrame, depth: int = 5, possible: DataFrame | None = None) -> DataFrame:
    """Upwards to the entry points: nodes reached that have no caller of either tier. ``possible``: unverified edges."""
    met = closure(edges, targets, depth, up=True)
    called = edges.select(F.col("dst").alias("node"))
    if possible is not None:
        called = called.union(possible.select(F.col("dst").alias("node")))
    return met.join(called.distinct(), "node", "left_anti")


def blast(confirmed: DataFrame, unverified: DataFrame, targets: DataFrame, depth: int = 3) -> DataFrame:
    """Callers of the targets: the confirmed closure, and one step of unverified callers around it (``tier``). Self-calls are left out.

    Targets with the same direct callers have all others in common too: these are
    found once for each such group (two 64-bit sums over its callers), and rows
    for each target are made last. Edges that no target or caller meets are
    dropped before a shuffle; targets' groups and their callers are written once.
    """
    loops = F.col("src") != F.col("dst")
    confirmed, unverified = confirmed.filter(loops), unverified.filter(loops)
    roots = targets.select(F.col("node").alias("root")).distinct()
    own = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit("confirmed").alias("tier"))
    if depth < 1:
        return own
    base = scratch(roots.sparkSession)
    direct = lambda edges, sure: near_nodes(edges, "dst", targets).join(roots, F.col("dst") == F.col("root")).select("root", F.col("src").alias("node"), F.lit(sure).alias("sure"))
    near = cut(direct(confirmed, True).unionByName(direct(unverified, False)).distinct(), f"{base}/near")
    total = lambda k: F.sum(F.xxhash64(F.lit(k), "node", "sure").cast("decimal(38,0)")).cast("string")
    groups = cut(near.groupBy("root").agg(F.concat_ws(":", F.count("*").cast("string"), total(1), total(2)).alias("group")), f"{base}/groups")
    first = cut(near.join(groups, "root").select(F.col("group").alias("root"), "node", "sure").distinct(), f"{base}/first")
    trunk = closure(confirmed, first.filter("sure").select("root", "node"), depth - 1, up=True, sparse=True).withColumn("depth", F.col("depth") + 1)
    inner = trunk.filter(F.col("depth") < depth)
    rim = inner.join(near_nodes(unverified, "dst", inner), F.col("node") == F.col("dst")).select("root", F.col("src").alias("node"), (F.col("depth") + 1).alias("depth"))
    rim = rim.unionByName(first.filter("NOT sure").select("root", "node", F.lit(1).alias("depth")))
    rim = rim.groupBy("root", "node").agg(F.min("depth").alias("depth")).join(trunk.select("root", "node"), ["root", "node"], "left_anti")
    around = trunk.withColumn("tier", F.lit("confirmed")).unionByName(rim.withColumn("tier", F.lit("unverified"))).withColumnRenamed("root", "group")
    around = cut(around, f"{base}/around")
    return own.unionByName(dealt(groups, around, ["group"]).filter("root <> node").select("root", "node", "depth", "tier"))


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node``: everything the seeds reach, whatever the seed; one frontier for all."""
    one = edges.sparkSession.createDataFrame([("*",)], "node string")
    joined = edges.select("src", "dst").unionByName(seeds.select(F.lit("*").alias("src"), F.col("node").alias("dst")))
    return closure(joined, one).filter("depth > 0").select("node")


#: Steps of a component search in one plan, before what is known is written: more were slower when measured (41, 45 and 83 s for 1, 2 and 3).
STEPS = 1


def _spread(edges: DataFrame, colour: DataFrame, steps: int = STEPS) -> DataFrame:
    """``node, colour`` after some steps in which each node takes the least colour of itself and of the nodes that lead to it."""
    for _ in range(steps):
        came = edges.join(colour, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "colour")
        colour = colour.unionByName(came).groupBy("node").agg(F.min("colour").alias("colour"))
    return colour


def components(edges: DataFrame) -> DataFrame:
    """Strongly connected components of two nodes or more: ``node, component`` (its least node). Self-edges are skipped.

    First trims nodes that no cycle can hold (without an edge in or out), again
    and again; then, each round, colours every node by the least node that
    reaches it, and takes off, for each colour, the nodes that reach its least
    node inside the colour. All steps are joins over the remaining edges;
    ``STEPS`` of them are one plan, and a count or sum says whether more are due.
    """
    spark, base, k = edges.sparkSession, scratch(edges.sparkSession), 0
    left = cut(edges.select("src", "dst").filter("src <> dst").distinct(), f"{base}/0")
    done: list[str] = []
    schema = None
    while not left.isEmpty():
        size = left.count()
        while True:  # trim
            k, kept = k + 1, left
            for _ in range(STEPS):
                kept = kept.join(kept.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
                kept = kept.join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            left = cut(kept, f"{base}/{k}")
            before, size = size, left.count()
            if size == before:
                break
        if not size:
            break
        colour, state = left.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")), None
        while True:  # the least node that reaches each
            k += 1
            colour = cut(_spread(left, colour), f"{base}/{k}")
            seen = colour.agg(F.sum(F.xxhash64("node", "colour").cast("decimal(38,0)"))).first()[0]
            if seen == state:
                break
            state = seen
        inside = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst").filter("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        k += 1
        inside = cut(inside, f"{base}/{k}")
        # backwards from each colour's least node: those that lead to it are its component
        back, reached = colour.filter("node = colour"), 0
        while True:
            k += 1
            back = cut(_spread(inside, back), f"{base}/{k}")
            before, reached = reached, back.count()
            if reached == before:
                break
        k += 1
        found = cut(back.select("node", F.col("colour").alias("component")), f"{base}/{k}")
        done.append(f"{base}/{k}")
        schema = found.schema
        k += 1
        left = cut(left.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), f"{base}/{k}")
    if not done:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    found = spark.read.schema(schema).parquet(*done)
    return found.join(found.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1"), "component").select("node", "component")


def short_cycles(edges: DataFrame, longest: int = 4) -> DataFrame:
    """Elementary cycles of up to ``longest`` nodes inside the components, each once, from its least node: ``cycle`` (array), ``length``."""
    loops = edges.select("src", "dst").filter("src <> dst").distinct()
    members = components(loops)
    inner = loops.join(members.select(F.col("node").alias("src"), "component"), "src").join(members.select(F.col("node").alias("dst"), F.col("component").alias("c")), "dst").filter("component = c").select("src", "dst")
    paths, out = inner.filter("src < dst").select(F.array("src", "dst").alias("path")), None
    for n in range(2, longest + 1):
        ends = inner.select(F.col("src").alias("tail"), F.col("dst").alias("head"))
        closed = paths.join(ends, (F.element_at("path", -1) == F.col("tail")) & (F.col("path")[0] == F.col("head"))).select(F.col("path").alias("cycle"), F.lit(n).alias("length"))
        out = closed if out is None else out.unionByName(closed)
        if n < longest:
            paths = paths.join(ends, F.element_at("path", -1) == F.col("tail")).filter((F.col("head") > F.col("path")[0]) & ~F.array_contains("path", F.col("head"))).select(F.concat("path", F.array("head")).alias("path"))
    return out


def affected_tests(confirmed: DataFrame, possible: DataFrame, targets: DataFrame, test_nodes: DataFrame, depth: int = 3) -> DataFrame:
    """Tests that call into the targets' callers: ``test, confirmed, possible`` (functions linked by each tier), most linked first."""
    every = confirmed.select("src", "dst").unionByName(possible.select("src", "dst"))
    sure = within(confirmed, targets, depth).withColumn("sure", F.lit(1))
    both = within(every, targets, depth).join(sure, "node", "left")
    tests = test_nodes.select(F.col("node").alias("test"))
    links = every.join(tests.distinct(), F.col("src") == F.col("test"), "left_semi").distinct().select(F.col("src").alias("test"), "dst")
    found = links.join(both, F.col("dst") == F.col("node"))
    return found.groupBy("test").agg(F.countDistinct(F.when(F.col("sure") == 1, F.col("node"))).alias("confirmed"), F.countDistinct(F.when(F.col("sure").isNull(), F.col("node"))).alias("possible"))
