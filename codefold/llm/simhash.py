"""SimHash near-duplicates by tiled exact comparison."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefold.llm.common import join_hot, join_salted, keep_rows, ready, stored, work_dir
from codefold.llm.components import Forest, connected_components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints in a block, and cells of one comparison matrix.
BLOCK, CELLS = 8192, 1 << 21


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bit is 1 where over half of the hashes have it."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        part = np.ascontiguousarray(hashes[k : k + 8192], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the whole text's word shingles, repeats included; 0 without a word."""
    words = text.encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return majority(np.array([hashed(b" ".join(words), seed)], dtype=np.uint64))
    grams = zip(*(words[k:] for k in range(shingle)))
    return majority(np.fromiter((hashed(g, seed) for g in map(b" ".join, grams)), dtype=np.uint64, count=len(words) - shingle + 1))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, digest, fp`` for each row: the text's hash and its fingerprint as a signed long."""
    ready(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))

    def make(batches):
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "digest", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text")).mapInArrow(make, "doc_id long, digest long, fp long")


def linked(a: np.ndarray, b: np.ndarray, radius: int = RADIUS, cells: int = CELLS) -> list[tuple[int, int]]:
    """A forest with the same components as all links within the radius between and inside ... ``a`` and ``b``.

    Pairs of positions in ``a`` followed by ``b``; at most one pair for each
    position, however many links there are.
    """
    forest, n, step = Forest(len(a) + len(b)), len(a), max(1, cells // max(1, len(b)))
    for low in range(0, n, step):
        near = np.bitwise_count(a[low : low + step, None] ^ b[None, :]) <= radius
        hits = int(np.count_nonzero(near))
        if not hits:
            continue
        if hits <= 20_000:
            for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
                forest.join(low + i, n + j)
            continue
        # many links: spread the smallest label through the matrix until it rests
        rows = np.array([forest.root(low + i) for i in range(near.shape[0])])
        columns, most = np.array([forest.root(n + j) for j in range(len(b))]), n + len(b)
        first = rows.copy(), columns.copy()
        while True:
            was = rows, columns
            rows = np.minimum(rows, np.where(near, columns[None, :], most).min(axis=1))
            columns = np.minimum(columns, np.where(near, rows[:, None], most).min(axis=0))
            if np.array_equal(rows, was[0]) and np.array_equal(columns, was[1]):
                break
        for old, new in zip(first, (rows, columns)):
            for i, j in zip(old.tolist(), new.tolist()):
                forest.join(i, j)
    return [(i, r) for i in range(len(forest.up)) if (r := forest.root(i)) != i]


def _segments(distinct: int) -> int:
    """Finer tiles for more fingerprints; the links found are the same.

    Two random fingerprints lie in the same or neighbouring tiles with a
    probability of 1/8, 1/70, 1/4,000 and 1/3,000,000 for 2, 4, 8 and 16 segments,
    so about ``distinct**2 / 2`` times that are compared: 10**11 for 10**9.
    """
    return 2 if distinct < 1 << 14 else 4 if distinct < 1 << 20 else 8 if distinct < 1 << 25 else 16


def _digit(segments: int) -> int:
    """Bits for a segment in a tile's key: room for its count and the steps to neighbours."""
    return min(7, 64 // segments)


def tile_of(fp: Column, segments: int) -> Column:
    """The population counts of the fingerprint's equal segments in one number."""
    width, total = 64 // segments, F.lit(0).cast("long")
    for k in range(segments):
        part = F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        total = total + F.bit_count(part).cast("long") * F.lit(1 << (_digit(segments) * k)).cast("long")
    return total


def neighbour_steps(segments: int, radius: int) -> list[int]:
    """Differences between the keys of tiles whose counts differ by the radius in all at most; one of each pair of opposites, and 0."""
    steps, layer = {(0,) * segments}, {(0,) * segments}
    for _ in range(radius):
        layer = {d[:k] + (d[k] + s,) + d[k + 1 :] for d in layer for k in range(segments) for s in (-1, 1)}
        steps |= layer
    return sorted({sum(x << (_digit(segments) * k) for k, x in enumerate(d)) for d in steps if next((x for x in d if x), 1) > 0})


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK, segments: int | None = None) -> DataFrame:
    """``nodes``: distinct ``fp``. Links ``u, v`` whose components are those of all pairs within the radius.

    Tiles hold the fingerprints with the same population counts in each segment;
    two fingerprints within the radius lie in tiles whose counts differ by no
    more in all, so other tile pairs are skipped. A large tile is cut into
    blocks of about ``block``; each pair of blocks is one comparison, so no task
    holds a whole tile.
    """
    spark = nodes.sparkSession
    ready(spark)
    segments = segments or _segments(nodes.count())
    tiled = nodes.select("fp", tile_of(F.col("fp"), segments).alias("tile"))
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count("*") / block).alias("blocks"))
    cut = tiled.join(sizes, "tile").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks"))
    blocks = stored(cut.groupBy("tile", "block").agg(F.collect_list("fp").alias("fps")), work_dir(spark, "tiles"))
    keys = blocks.select("tile", "block")
    near = keys.withColumn("step", F.explode(F.array(*(F.lit(s).cast("long") for s in neighbour_steps(segments, radius)))))
    pairs = near.withColumn("to", F.col("tile") + F.col("step")).join(keys.select(F.col("tile").alias("to"), F.col("block").alias("to_block")), "to")
    pairs = pairs.filter("step <> 0 OR block <= to_block").drop("step")
    left = pairs.join(blocks.withColumnRenamed("fps", "a"), ["tile", "block"])
    both = left.join(blocks.select(F.col("tile").alias("to"), F.col("block").alias("to_block"), F.col("fps").alias("b")), ["to", "to_block"])

    def compare(batches):
        for batch in batches:
            u, v = [], []
            left, right = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                a, b = (x[k].values.to_numpy().view(np.uint64) for x in (left, right))
                joined = np.concatenate([a, b]).view(np.int64)
                for i, j in linked(a, b, radius):
                    if joined[i] != joined[j]:
                        u.append(int(joined[i]))
                        v.append(int(joined[j]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return both.select("a", "b").mapInArrow(compare, "u long, v long")


def _grouped(docs: DataFrame, radius: int, shingle: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows with their fingerprints; a row for each fingerprint with its group's root and smallest id, and how many rows have it; the number of rows."""
    spark = docs.sparkSession
    rows = stored(fingerprints(docs, shingle), work_dir(spark, "fingerprints"))
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")), work_dir(spark, "nodes"))
    roots = connected_components(fingerprint_links(nodes.select("fp"), radius))
    placed = stored(nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", "size", F.coalesce("root", "fp").alias("root")), work_dir(spark, "placed"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, stored(join_salted(placed, named, "root", "fp").select("fp", "size", "root", "component_id"), work_dir(spark, "named")), rows.count()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row for each input row: ``doc_id, fingerprint, component_id``.

    ``docs``: ``doc_id, text``; other columns are not read. Null text counts as
    empty; texts without a word have fingerprint 0, linked like any other. Texts
    are hashed whole. Fingerprints that differ in ``radius`` bits or fewer are
    linked; ``component_id`` is the smallest ``doc_id`` reachable (null where all
    ids reachable are null). Rows that share a ``doc_id`` keep a row each. An
    empty table gives an empty result.

    Equal fingerprints become one node before any comparison, so copies cost
    nothing, and comparisons yield forests instead of all pairs. Fingerprints
    with a large share of the rows meet their facts in a broadcast of bounded size.
    """
    rows, found, total = _grouped(docs, radius, shingle)
    return join_hot(rows, found, "fp", "size", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, one for each group of linked fingerprints: that of the smallest ``doc_id`` (nulls last).

    Rows go by id and text, so rows that share an id are told apart and no group
    loses its last row. For similarities beyond a few bits see ``similar``.
    """
    rows, found, total = _grouped(docs, radius, shingle)
    return keep_rows(docs, join_hot(rows, found, "fp", "size", total).select("doc_id", "digest", "root"), "root", F.xxhash64)
