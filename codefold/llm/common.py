"""Shared storage and Arrow helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codefold.session import ship

#: Rows and bytes in an Arrow batch: texts can be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


#: Folders made for applications without ``spark.checkpoint.dir``, by application.
_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master may do without: there it is a new folder."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or _OWN_DIRS.get(context.applicationId)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN_DIRS[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="codefold-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder of its own below the shared one."""
    return f"{shared_dir(spark)}/codefold/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """The same rows, written as Parquet and read back: later stages don't recompute them and a lost executor costs nothing."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ready(spark: SparkSession) -> None:
    """Ship this package to the Python workers and bound the Arrow batches they get, unless the session has tighter bounds."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, null text as empty; other columns can't clash with computed ones."""
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))


def collapsed(text: Column) -> Column:
    """Every run of ASCII white space as one space."""
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


#: Keys that a broadcast of hot keys holds at most, and rows below which a key is never hot.
HOT_KEYS, HOT_ROWS = 10_000, 1_000


def join_hot(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join with ``facts``, which has one row for each ``key`` and says in ``size`` how many of the ``total`` rows have it.

    Keys with over a ten-thousandth of the rows, of which there are fewer than
    ``HOT_KEYS``, are broadcast, so their rows stay where they are; the others
    meet by a sort-merge join, in which no key has more than that share.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(facts.filter(F.col(size) > most))
    cold = facts.filter(F.col(size) <= most).hint("merge")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def join_salted(rows: DataFrame, facts: DataFrame, key: str, by: str, parts: int | None = None, outer: bool = False) -> DataFrame:
    """Join (``outer``: left) with ``facts``, which has one row for each ``key``, on the key and a salt from ``by``.

    A key's rows are dealt over ``parts`` (by default a sixteenth of the shuffle's
    partitions, 4 at least), and as both sides are shuffled for the join itself,
    Spark can split a large partition further.
    """
    parts = parts or max(4, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    salted = rows.withColumn("__cf_salt", F.pmod(F.xxhash64(by), F.lit(parts)))
    return salted.join(facts.withColumn("__cf_salt", salt), [key, "__cf_salt"], "left" if outer else "inner").drop("__cf_salt")


def keep_rows(docs: DataFrame, rows: DataFrame, group: str, digest: Callable[[Column], Column]) -> DataFrame:
    """The rows of ``docs``, all columns, one for each ``group``: of the smallest ``doc_id`` (nulls last), then the smallest digest.

    ``rows``: ``doc_id, digest, group`` for each row of ``docs``; ``digest`` says
    how a text's is made. What goes is named by (id, digest), so rows that share
    an id but not the text are told apart, and meets the documents in a
    sort-merge anti-join at any size. Of rows that agree in both, one stays.
    """
    spark = docs.sparkSession
    rows = stored(rows.groupBy(group, "doc_id", "digest").agg(F.count("*").alias("copies")), work_dir(spark, "members"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("digest").alias("of"))).alias("first")
    named = stored(rows.groupBy(group).agg(first, F.count("*").alias("size")), work_dir(spark, "groups"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.of"))
    placed = join_hot(rows, named.filter("size > 1"), group, "size", rows.count()).withColumn("stays", stays).filter(~F.col("stays") | (F.col("copies") > 1))
    alone = rows.filter("copies > 1").join(named.filter("size = 1").select(group), group, "left_semi").withColumn("stays", F.lit(True))
    columns = [F.col("doc_id").alias("id"), F.col("digest").alias("of"), "stays"]
    return without(docs, stored(placed.select(*columns).unionByName(alone.select(*columns)), work_dir(spark, "dropped")), digest)


def without(docs: DataFrame, odd: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """``docs`` less the rows that ``odd`` (``id, of, stays``; a written table) names by id and digest; of those that stay one is left."""
    key, own, row = "__cf_id", "__cf_digest", "__cf_row"
    whole = docs.select(F.struct("*").alias(row), F.col("doc_id").cast("long").alias(key), digest(F.coalesce(F.col("text"), F.lit(""))).alias(own))
    same = F.col(own).eqNullSafe(F.col("of")) & F.col(key).eqNullSafe(F.col("id"))
    once = whole.join(odd.hint("merge"), same, "left_anti").select(f"{row}.*")
    repeated = odd.filter("stays")
    if repeated.isEmpty():
        return once
    return once.unionByName(whole.join(repeated.hint("merge"), same, "left_semi").dropDuplicates([key, own]).select(f"{row}.*"))


#: Smallest long: an id's first cut takes all its rows.
_LEAST = -(1 << 63)


class Cuts:
    """Borders between parts of about equally many rows in ascending order of (id, tie); null ids come first.

    An id that holds more rows than a part has several borders, at equal steps
    of the tie (a hash), so no id is bound to one part.
    """

    def __init__(self, null_ties: list[int], ids: list[int], ties: list[int]):
        self.null_ties, self.ids, self.ties = (np.array(x, np.int64) for x in (null_ties, ids, ties))
        self.parts = len(null_ties) + len(ids) + 1

    def of(self, ids: pa.Array, ties: pa.Array) -> np.ndarray:
        """The part of each row."""
        tie, null = ties.to_numpy(zero_copy_only=False), np.asarray(ids.is_null())
        own = ids.fill_null(_LEAST).to_numpy()
        low, high = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        for i in np.flatnonzero((high > low) & ~null):
            low[i] += np.searchsorted(self.ties[low[i] : high[i]], tie[i], "right")
        return np.where(null, np.searchsorted(self.null_ties, tie, "right"), len(self.null_ties) + low).astype(np.int32)


def _steps(n: int) -> list[int]:
    """``n`` borders at equal steps of a hash, the first below all hashes."""
    return [_LEAST + (k << 64) // n for k in range(n)]


def ordered_cuts(docs: DataFrame, id_col: str, parts: int) -> Cuts:
    """Borders of ``parts`` parts from quantiles of the ids of all rows: one pass over that column, and ``parts`` numbers for the driver."""
    own = docs.select(F.col(id_col).cast("long").alias("id"))
    marks = [k / parts for k in range(1, parts)] or [0.5]
    row = own.agg(F.count("*").alias("n"), F.count("id").alias("known"), F.percentile_approx("id", marks, max(10_000, 20 * parts)).alias("cuts")).first()
    if not row.n or parts < 2:
        return Cuts([], [], [])
    nulls = round((parts - 1) * (row.n - row.known) / row.n)
    cuts = sorted(row.cuts or [])
    cuts = [cuts[round((k + 0.5) * len(cuts) / (parts - 1 - nulls) - 0.5)] for k in range(parts - 1 - nulls)] if cuts else []
    return Cuts(_steps(nulls + 1)[1:], cuts, [t for n in Counter(cuts).values() for t in _steps(n)])


def commit_files(draft: DataFrame, names: dict[str, str], path: str) -> DataFrame:
    """Give whole files their names; returns the manifest, written below ``path``.

    ``draft`` lists, a row for each file or few, temporary URIs in the columns
    ``names``, whose values say which column holds the name to be. It is a
    written table, so it names the files of those attempts whose output Spark
    took; what lost or doubled attempts left keeps its temporary name and never
    replaces anything. A retried move finds its source gone and its target there.
    """

    def move(batches):
        from pyarrow import fs

        for batch in batches:
            for old, new in names.items():
                for source, target in zip(batch.column(old).to_pylist(), batch.column(new).to_pylist()):
                    store, source = fs.FileSystem.from_uri(source)
                    target = store.normalize_path(fs.FileSystem.from_uri(target)[1])
                    if store.get_file_info(source).type == fs.FileType.NotFound:
                        if store.get_file_info(target).type == fs.FileType.NotFound:
                            raise FileNotFoundError(source)
                    else:
                        store.move(source, target)
            keep = [c for c in batch.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep], names=keep)

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in draft.schema if f.name not in names)
    return stored(draft.repartition(max(1, min(draft.count(), 2000))).mapInArrow(move, kept), path)


def remove_dir(uri: str) -> None:
    """Delete a folder and all below it, if it is there."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir(path)
