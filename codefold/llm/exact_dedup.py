"""Exact deduplication against a persistent digest index. DataFrame operations only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codefold.llm.common import collapsed, id_text, join_hot, shared_dir, stored, without, work_dir

#: Least number of buckets; a new index has as many as a shuffle has partitions, so that joins move only the other side.
BUCKETS = 64
#: Parts in which a batch enters the index.
INCREMENTS = 2


def digest_of(text: Column) -> Column:
    """SHA-256 of the text with each run of white space as one space."""
    return F.sha2(collapsed(text), 256)


class DigestIndex:
    """Digests seen so far with the document that stays, bucketed and sorted by digest.

    The table lies below the shared folder (or at ``path``), so that another
    session can open it again by name, path and buckets. ``buckets`` should grow
    with the digests expected: some millions in a bucket are fine.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets or max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.name = name or f"digests_{uuid.uuid4().hex}"
        self.path = path or f"{shared_dir(spark)}/codefold/{self.name}"
        if not spark.catalog.tableExists(self.name):
            spark.sql(f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT, batch BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, digests: DataFrame, batch: int = 0) -> None:
        """Add the digests that are not there yet; ``digests``: ``digest, keep_id``, one row for each digest."""
        fresh = digests.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        fresh.select("digest", "keep_id", F.lit(batch).cast("long").alias("batch")).write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)


def _increments(rows: DataFrame, parts: int) -> list[DataFrame]:
    """``rows`` in parts of ascending ``doc_id`` (nulls last), cut at quantiles."""
    if parts < 2:
        return [rows]
    cuts = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    place = sum((F.coalesce(F.col("doc_id") >= F.lit(c), F.lit(True)).cast("int") for c in cuts), F.lit(0))
    return [rows.filter(place == k) for k in range(len(cuts) + 1)]


def _decided(docs: DataFrame, index: DigestIndex | None, batch: int, increments: int) -> DataFrame:
    """For each (digest, id) of the batch: ``digest, doc_id, copies, keep_id, group_size, stays``."""
    spark = docs.sparkSession
    index = index or DigestIndex(spark)
    rows = stored(id_text(docs).select("doc_id", digest_of(F.col("text")).alias("digest")), work_dir(spark, "digests"))
    groups = stored(rows.groupBy("digest").agg(F.count("*").alias("group_size")), work_dir(spark, "groups"))
    for part in _increments(rows, increments):
        index.append(part.groupBy("digest").agg(F.min("doc_id").alias("keep_id")), batch)
    facts = groups.join(index.table().hint("merge"), "digest")
    counted = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("copies"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == batch)
    return join_hot(counted, facts, "digest", "group_size", rows.count()).withColumn("stays", stays).drop("batch")


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, batch: int = 0, increments: int = INCREMENTS) -> DataFrame:
    """One row for each input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are after each run of white space becomes one
    space; null counts as empty. In a batch the smallest ``doc_id`` stays; a text
    that the index already holds stays with the document it names, and all rows
    of the batch with that text go. ``group_size`` counts the batch's rows. Of
    repeated rows with one ``doc_id`` and text, one is kept; a null ``doc_id``
    comes after every other. An empty table gives an empty result. Columns
    other than ``doc_id`` and ``text`` are not read. Each batch of an index
    needs a number of its own.

    The batch goes into the index in ``increments`` of ascending ids, so what an
    increment repeats of those before is found by the anti-join against the
    index, as it is for later batches. The result doesn't depend on their number.

    Rows are counted by (digest, id) before anything is moved by digest. The
    facts of digests with a large share of the rows are broadcast (a bounded
    number of them), so one text may hold any share.
    """
    numbered = _decided(docs, index, batch, increments).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return numbered.select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, batch: int = 0, increments: int = INCREMENTS) -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_duplicates`` keeps: one for each text.

    The ids and digests of rows that go meet the documents in a sort-merge
    anti-join by (digest, id), at any size: the texts move once, and copies of
    one text are spread by their ids. Of repeated rows that agree in id and text
    any one stays, with its other columns.
    """
    spark = docs.sparkSession
    odd = _decided(docs, index, batch, increments).filter(~F.col("stays") | (F.col("copies") > 1))
    odd = stored(odd.select(F.col("doc_id").alias("id"), F.col("digest").alias("of"), "stays"), work_dir(spark, "dropped"))
    return without(docs, odd, digest_of)
