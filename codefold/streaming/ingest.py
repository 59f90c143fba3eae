"""Incremental indexing as a stream: new or changed files' facts are merged by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codefold.sources.repo import NO_CONTENT, facts, load


def index_stream(spark: SparkSession, files: DataFrame, index_path: str, checkpoint: str) -> StreamingQuery:
    """``files``: a stream of ``path, rel, language, content``; each micro-batch appends a version of its files to the index.

    A null ``content`` says that the file is gone. A file's latest version counts (``latest``); a batch that is run again after
    a failure replaces its own folder, so each file is indexed once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        found = facts(batch.dropDuplicates(["rel", "content"])).withColumn("deleted", F.coalesce(F.col("issue.reason") == NO_CONTENT, F.lit(False)))
        found.withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{index_path}/batch={number}")

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, index_path: str) -> DataFrame:
    """The newest version of each file's facts, without files that are gone."""
    every = load(spark, index_path).drop("batch")
    newest = every.groupBy("rel").agg(F.max("version").alias("version"))
    return every.join(newest, ["rel", "version"], "left_semi").filter("NOT deleted").drop("version", "deleted")
