"""The conservation account: each line that holds a name is in one bucket, and the buckets add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order in which claims win a line, and the buckets of unclaimed lines by usage.
BUCKETS = ("confirmed", "unverified", "excluded")


def _rank():
    return F.when(F.col("bucket") == "confirmed", 0).when(F.col("bucket") == "unverified", 1).when(F.col("bucket") == "excluded", 2).otherwise(3)


def _order():
    return F.when(F.col("usage_type") == "call", 0).when(F.col("usage_type") == "import", 1).when(F.col("usage_type") == "definition", 2).when(F.col("usage_type") == "reference", 3).otherwise(4)


def _bucket(rank):
    """The bucket of a line with these ``issue``, rank of its best claim, and ``usage``."""
    claim = F.when(rank == 0, "confirmed").when(rank == 1, "unverified").when(rank == 2, "excluded").when(rank == 3, "unaccounted")
    rest = F.when(F.col("usage") == 0, "unverified").when(F.col("usage") == 1, "import").when(F.col("usage") == 2, "definition").when(F.col("usage") == 3, "reference").otherwise("unclassified")
    return F.coalesce("issue", claim, rest)


def assigned(ground: DataFrame, claims: DataFrame, usages: DataFrame | None = None, issues: DataFrame | None = None) -> DataFrame:
    """``file, line, bucket, reason`` for each ground line.

    ``claims``: ``file, line, bucket, reason`` with buckets as in ``BUCKETS``,
    any number for a line; the strongest wins, by a partial minimum before the
    join, so a line that very many claims name costs no more than one. Lines
    without a claim fall to their usage: a call is unverified
    (``call-not-resolved``), the others are not calls. ``issues``: ``file, kind``
    (unparsed or unsupported) puts all of a file's lines in that bucket. A claim
    of no known bucket accounts for nothing: its line is ``unaccounted``.
    """
    best = claims.groupBy("file", "line").agg(F.min(F.struct(_rank().alias("rank"), F.coalesce("reason", F.lit("")).alias("reason"))).alias("b"))
    out = ground.join(best, ["file", "line"], "left")
    if usages is not None:
        out = out.join(usages.groupBy("file", "line").agg(F.min(_order()).alias("usage")), ["file", "line"], "left")
    else:
        out = out.withColumn("usage", F.lit(None).cast("int"))
    if issues is not None:
        out = out.join(issues.groupBy("file").agg(F.min("kind").alias("issue")), "file", "left")
    else:
        out = out.withColumn("issue", F.lit(None).cast("string"))
    reason = F.when(F.col("b").isNotNull(), F.col("b.reason")).when(F.col("usage") == 0, "call-not-resolved").otherwise("")
    return out.select("file", "line", _bucket(F.col("b.rank")).alias("bucket"), F.when(F.col("issue").isNull(), reason).otherwise("").alias("reason"))


def _lines(ground: DataFrame, claims: DataFrame, usages: DataFrame | None, issues: DataFrame | None) -> DataFrame:
    """``held`` (ground rows), ``rank`` (best claim) and ``bucket`` of each line of the ground or of a claim. Claims are read once."""
    none, unknown = F.lit(None).cast("int"), F.col("file").isNull() | F.col("line").isNull()
    # lines without a file or number are equal to none, as in a join
    part = lambda df, mark, held, rank, usage: df.select("file", "line", F.when(unknown, F.lit(mark)).alias("odd"), F.lit(held).cast("long").alias("held"), rank.alias("rank"), usage.alias("usage"))
    rows = part(ground, "ground", 1, none, none).unionByName(part(claims, "claim", 0, _rank(), none))
    if usages is not None:
        rows = rows.unionByName(part(usages, "usage", 0, none, _order()))
    rows = rows.groupBy("file", "line", "odd").agg(F.sum("held").alias("held"), F.min("rank").alias("rank"), F.min("usage").alias("usage"))
    rows = rows.join(issues.groupBy("file").agg(F.min("kind").alias("issue")), "file", "left") if issues is not None else rows.withColumn("issue", F.lit(None).cast("string"))
    return rows.select("held", "rank", _bucket(F.col("rank")).alias("bucket"))


def account(ground: DataFrame, claims: DataFrame, usages: DataFrame | None = None, issues: DataFrame | None = None, unread: DataFrame | None = None) -> DataFrame:
    """One row: the buckets, their total, what is unaccounted for, and claims beyond the text.

    ``total`` counts the ground lines apart from the buckets; what these don't
    cover is ``unaccounted``. ``text_complete`` also needs no unparsed and no
    unsupported line, and no file in ``unread`` (issues of files whose text
    nobody saw). Nothing here says that a zero is safe to delete.
    """
    rows = _lines(ground, claims, usages, issues)
    n = lambda *b: F.coalesce(F.sum(F.when(F.col("bucket").isin(*b), F.col("held"))), F.lit(0).cast("long"))
    non_call = ("import", "definition", "reference", "unclassified")
    sums = rows.agg(n("confirmed").alias("confirmed"), n("unverified").alias("unverified"), n("excluded").alias("excluded"), n(*non_call).alias("non_call"), n("unparsed").alias("unparsed"), n("unsupported").alias("unsupported"), F.count_if((F.col("held") == 0) & (F.col("rank") < 2)).alias("beyond_text"))
    total = ground.agg(F.count("*").alias("total"))
    hidden = unread.agg(F.count("*").alias("unread")) if unread is not None else ground.agg(F.lit(0).cast("long").alias("unread"))
    out = total.crossJoin(F.broadcast(sums)).withColumn("unaccounted", F.expr("total - confirmed - unverified - excluded - non_call - unparsed - unsupported"))
    out = out.crossJoin(F.broadcast(hidden)).withColumn("text_complete", F.expr("unaccounted = 0 AND unparsed = 0 AND unsupported = 0 AND unread = 0"))
    names = ("total", *BUCKETS, "non_call", "unparsed", "unsupported", "unaccounted", "beyond_text", *(("unread",) if unread is not None else ()), "text_complete")
    return out.select(*names)


def callee_account(calls: DataFrame, edges: DataFrame, symbol_ids: DataFrame, symbols: DataFrame) -> DataFrame:
    """Where the calls inside each symbol (``enclosing_id``) lead: ``total = confirmed + unverified + external + excluded``.

    A site counts once, by its strongest edge; a site that no definition of the
    index answers is external.
    """
    from codefold.operators.edges import innermost

    sites = calls.filter(~F.coalesce("is_function_ref", F.lit(False))).withColumn("call_id", F.concat_ws(":", "file", "line", F.col("seq").cast("string"), "name"))
    inside = sites.join(innermost(sites, symbols), ["file", "line"]).join(symbol_ids.select(F.col("to_id").alias("enclosing_id")).distinct(), "enclosing_id", "left_semi").select("enclosing_id", "call_id")
    rank = F.min(F.when(F.col("tier") == "confirmed", 0).when(F.col("tier") == "unverified", 1).otherwise(2)).alias("rank")
    own = inside.join(edges.groupBy("call_id").agg(rank), "call_id", "left")
    n = lambda k: F.count_if(F.col("rank") == k)
    return own.groupBy("enclosing_id").agg(F.count("*").alias("total"), n(0).alias("confirmed"), n(1).alias("unverified"), F.count_if(F.col("rank").isNull()).alias("external"), n(2).alias("excluded"))
