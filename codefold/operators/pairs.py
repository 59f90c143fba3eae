"""Joins whose pairs are the result, dealt evenly over the tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of either side in a cell, about. What is copied is two rows for each so many pairs.
CELL = 1024


def dealt(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The inner join on columns of the same names. A key with many rows on both sides is cut into a grid of cells, each a key of its own, so no task makes all pairs of a key; pairs are made last and move nowhere. Cells go to a set number of tasks: by the size of what they read, which says little of the pairs, adaptive execution would merge them into a few."""
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    grid = left.groupBy(*on).agg(F.ceil(F.count("*") / CELL).cast("int").alias("_down")).join(right.groupBy(*on).agg(F.ceil(F.count("*") / CELL).cast("int").alias("_across")), on)
    place = lambda rows, n: F.pmod(F.xxhash64(*rows.columns), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(grid, on).select(*left.columns, place(left, "_down").alias("_i"), copies("_across").alias("_j"))
    b = right.join(grid, on).select(*right.columns, copies("_down").alias("_i"), place(right, "_across").alias("_j"))
    cell = [*on, "_i", "_j"]
    return a.repartition(tasks, *cell).join(b.repartition(tasks, *cell).hint("merge"), cell).drop("_i", "_j")
