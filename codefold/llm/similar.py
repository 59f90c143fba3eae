"""Near-duplicates of a given shingle similarity by SimHash: tiled comparison of fingerprints, then exact Jaccard similarity.

This is ``simhash``'s comparison for similarities that a radius of a few bits
doesn't reach. Fingerprints are longer (256 bits), tiles are formed by min-hash
keys of the shingle sets instead of by population counts alone, and what the
fingerprints link is verified on whole sets, so no false link stays.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefold.llm.common import join_hot, join_salted, keep_rows, ready, stored, work_dir
from codefold.llm.components import connected_components
from codefold.llm.hashing import PARTS, mixed, seeds, shingles, wide_fingerprint

SHINGLE, SIMILARITY = 5, 0.8
#: Bits in which linked fingerprints differ at most: five deviations above the mean of sets with a similarity of 0.8, which one pair in ten million exceeds.
RADIUS = 80
#: Keys of a set and min-hashes in a key: sets of a similarity of 0.8 share none with a probability of (1 - 0.8**3)**24, under one in ten million.
KEYS, ROWS = 24, 3
#: Nodes in a block of a tile, cells of one comparison matrix, and rows that a broadcast holds at most.
BLOCK, CELLS, KNOWN = 512, 1 << 20, 1 << 20
#: Parts of the hash space whose hashes a sketch counts.
SKETCH = 256
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, ascending. Fewer words are one shingle; no word is a shingle of its own."""
    words = _WORD.findall(text.encode().lower().decode())  # only A-Z and ASCII white space, as fingerprints have it
    return np.unique(shingles(words, min(shingle, len(words)))) if words else np.zeros(1, np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


_KEY_SEEDS = seeds(KEYS * ROWS, 2000)


def tile_keys(hashes: np.ndarray) -> np.ndarray:
    """``KEYS`` signed numbers, each of ``ROWS`` min-hashes: two sets share one with the probability of their similarity to the power of ``ROWS``."""
    low = np.full(len(_KEY_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 2048):
        low = np.minimum(low, mixed(hashes[k : k + 2048], _KEY_SEEDS).min(axis=1))
    key = np.arange(KEYS, dtype=np.uint64)
    for part in low.reshape(KEYS, ROWS).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """Hashes by part of the hash space, 255 at most. Two sketches differ by no more in all than the sets do, so they rule out only pairs that can't reach the similarity."""
    return np.minimum(np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes())


def _signed(nodes: list[int]) -> pa.Array:
    return pa.array(np.array(nodes, np.uint64).view(np.int64))


def _rows(texts: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, digest, node, n, fp, sketch, keys`` for each row: digests of the text and of its set, the set's size, fingerprint, sketch and tiles. The one pass over all texts."""

    def make(batches):
        for batch in batches:
            found = [shingle_set(t, shingle) for t in batch.column(2).to_pylist()]
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * KEYS), pa.array(np.concatenate([tile_keys(h) for h in found]) if found else np.empty(0, np.int64)))
            prints, sketches = (pa.array([f(h) for h in found], pa.binary()) for f in (wide_fingerprint, sketch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _signed([_node(h) for h in found]), pa.array([len(h) for h in found], pa.int32()), prints, sketches, keys], ["doc_id", "digest", "node", "n", "fp", "sketch", "keys"])

    return texts.mapInArrow(make, "doc_id long, digest long, node long, n int, fp binary, sketch binary, keys array<long>")


def _hashes(texts: DataFrame, digests: DataFrame, shingle: int) -> DataFrame:
    """``node, hashes``: the sets of the texts with these digests, as bytes. A bounded number of digests is broadcast; more meet the texts in a join."""
    spark, few = texts.sparkSession, digests.limit(KNOWN + 1).count() <= KNOWN
    known = spark.sparkContext.broadcast(np.sort(np.array([r.digest for r in digests.collect()], np.int64)) if few else None)

    def make(batches):
        for batch in batches:
            if known.value is not None:
                batch = batch.filter(pa.array(np.isin(batch.column(0).to_numpy(), known.value)))
            found = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([_signed([_node(h) for h in found]), pa.array([h.tobytes() for h in found], pa.binary())], ["node", "hashes"])

    own = texts.select("digest", "text")
    own = own if few else own.join(digests.hint("merge"), "digest", "left_semi")
    return own.mapInArrow(make, "node long, hashes binary")


def _verified(pairs: DataFrame, rows: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The ``pairs`` (``u, v``, each once) whose sets reach the similarity: links ``u, v``."""
    spark = pairs.sparkSession
    pairs = stored(pairs, work_dir(spark, "similar-pairs"))

    def compare(batches):
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (2, 3))
            good = pa.array([jaccard(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) >= similarity - 1e-12 for x, y in zip(a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(good)

    needed = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    digests = stored(rows.select("node", "digest").join(needed, "node", "left_semi").groupBy("node").agg(F.min("digest").alias("digest")).select("digest").distinct(), work_dir(spark, "similar-digests"))
    sets = stored(_hashes(texts, digests, shingle).dropDuplicates(["node"]), work_dir(spark, "similar-sets"))
    for end, other, mark in (("u", "v", "a"), ("v", "u", "b")):
        pairs = join_salted(pairs, sets.select(F.col("node").alias(end), F.col("hashes").alias(mark)), end, other)
    return stored(pairs.select("u", "v", "a", "b").mapInArrow(compare, "u long, v long"), work_dir(spark, "similar-links"))


def may_link(a: dict, b: dict, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs (positions in either table) lie within the radius and have sketches that allow the similarity; the second test loses none."""
    far = np.zeros(len(i), np.int64)
    for part in range(PARTS):
        far += np.bitwise_count(a["fp"][i, part] ^ b["fp"][j, part])
    good = np.flatnonzero(far <= RADIUS)
    for low in range(0, len(good), 4096):
        k = good[low : low + 4096]
        differ = np.abs(a["sketch"][i[k]].astype(np.int16) - b["sketch"][j[k]]).sum(axis=1, dtype=np.int64)
        good[low : low + 4096] = np.where(differ <= (1 - similarity) / (1 + similarity) * (a["n"][i[k]] + b["n"][j[k]]) + 1e-6, k, -1)
    return good[good >= 0]


def near_pairs(a: dict, b: dict, same: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions in two blocks of nodes that may link (``may_link``), whose sizes allow the similarity and whose roots differ.

    Exclusive-or and bit counts over a matrix of the blocks, a part at a time;
    blocks whose population counts differ by more than the radius throughout, or
    whose sizes lie too far apart, are left out at once.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    counts = [np.bitwise_count(x["fp"]).sum(axis=1, dtype=np.int64) for x in (a, b)]
    if counts[0].min() - counts[1].max() > RADIUS or counts[1].min() - counts[0].max() > RADIUS:
        return none
    if a["n"].max() < similarity * b["n"].min() - 1e-6 or b["n"].max() < similarity * a["n"].min() - 1e-6:
        return none
    us, vs, step = [], [], max(1, CELLS // len(b["n"]))
    for low in range(0, len(a["n"]), step):
        rows = slice(low, low + step)
        n, m = a["n"][rows, None], b["n"][None, :]
        near = (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6) & (a["root"][rows, None] != b["root"][None, :])
        if same:
            near &= np.arange(low, low + near.shape[0])[:, None] < np.arange(near.shape[1])[None, :]
        i, j = np.nonzero(near)
        good = may_link(a, b, i + low, j, similarity)
        us.append(i[good] + low)
        vs.append(j[good])
    return (np.concatenate(us), np.concatenate(vs)) if us else none


def _columns(n, fp, sketches) -> dict:
    prints, counts = (b"".join(x.to_pylist()) for x in (fp, sketches))
    return {"n": n.to_numpy().astype(np.int64), "fp": np.frombuffer(prints, "<u8").reshape(-1, PARTS), "sketch": np.frombuffer(counts, np.uint8).reshape(-1, SKETCH)}


def _block(members: pa.Array) -> dict:
    """A block's columns."""
    n, fp, sketches, keys, node, root = (members.field(k) for k in ("n", "fp", "sketch", "keys", "node", "root"))
    return _columns(n, fp, sketches) | {"node": node.to_numpy(), "root": root.to_numpy(), "keys": keys.flatten().to_numpy().reshape(-1, KEYS)}


def first_shared(a: np.ndarray, b: np.ndarray, key: int) -> np.ndarray:
    """Whether ``key`` is the first of the keys that two nodes share, for each pair of rows: so a pair counts in one tile only."""
    at = (a == b).argmax(axis=1)
    return a[np.arange(len(a)), at] == key


def tile_pairs(tiles: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """``u, v``, each once: pairs of nodes that share a tile, as ``near_pairs`` has them. ``tiles``: ``key, node, n, fp, sketch, keys, root``.

    Tiles are cut into blocks by size class and hash; a task compares two blocks,
    so no task holds a whole tile, and classes too far apart never meet.
    """
    spark, width = tiles.sparkSession, math.log(1 / similarity)
    cut = tiles.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int"))
    large = stored(cut.groupBy("key", "class").agg(F.ceil(F.count("*") / block).alias("blocks")).filter("blocks > 1"), work_dir(spark, "similar-large"))
    large = F.broadcast(large) if large.count() <= KNOWN // 16 else large.hint("merge")
    cut = cut.join(large, ["key", "class"], "left").withColumn("block", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))))
    blocks = stored(cut.groupBy("key", "class", "block").agg(F.collect_list(F.struct("node", "n", "fp", "sketch", "keys", "root")).alias("members")), work_dir(spark, "similar-blocks"))
    ends = blocks.select("key", F.col("class").alias("to_class"), F.col("block").alias("to_block"))
    pairs = blocks.select("key", "class", "block").withColumn("to_class", F.explode(F.array(F.col("class"), F.col("class") + 1, F.col("class") + 2))).join(ends, ["key", "to_class"])
    pairs = pairs.filter("to_class > class OR block <= to_block")
    both = pairs.join(blocks.withColumnRenamed("members", "a"), ["key", "class", "block"]).join(blocks.select("key", F.col("class").alias("to_class"), F.col("block").alias("to_block"), F.col("members").alias("b")), ["key", "to_class", "to_block"])

    def compare(batches):
        for batch in batches:
            keys, same, left, right = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)
            for k in range(batch.num_rows):
                a, b = _block(left[k].values), _block(right[k].values)
                i, j = near_pairs(a, b, same[k], similarity)
                own = first_shared(a["keys"][i], b["keys"][j], keys[k])
                u, v = a["node"][i[own]], b["node"][j[own]]
                for low in range(0, len(u), 1 << 16):
                    x, y = u[low : low + (1 << 16)], v[low : low + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["u", "v"])

    return both.select("key", F.expr("class = to_class AND block = to_block").alias("same"), "a", "b").mapInArrow(compare, "u long, v long").distinct()


def similar_links(rows: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """``u, root``: the components of all pairs that share a tile, lie within the radius and have the similarity; nodes alone are left out.

    ``rows`` and ``texts`` as made here. First each node of a tile meets the
    tile's smallest and largest node, which joins groups of many copies in as
    many comparisons as there are members. Then all pairs of a tile that are
    still in different groups are compared, so none is missed.
    """
    spark = rows.sparkSession
    entries = rows.select("node", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size")).filter("low <> high")
    shared = stored(shared, work_dir(spark, "similar-keys"))
    total = shared.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    met = stored(join_hot(entries, shared, "key", "size", total).select("key", "node", "low", "high").distinct(), work_dir(spark, "similar-met"))
    facts = stored(rows.join(met.select("node").distinct(), "node", "left_semi").select("node", "n", "fp", "sketch", "keys").dropDuplicates(["node"]), work_dir(spark, "similar-facts"))
    ends = met.select("node", F.explode(F.array("low", "high")).alias("end")).filter("node <> end")
    first = ends.select(F.least("node", "end").alias("u"), F.greatest("node", "end").alias("v")).distinct()
    links = _verified(_close(first, facts, similarity), rows, texts, similarity, shingle)
    roots = stored(connected_components(links, "similar-components"), work_dir(spark, "similar-roots"))
    known = facts.join(roots.withColumnRenamed("u", "node"), "node", "left").select("node", "n", "fp", "sketch", "keys", F.coalesce("root", "node").alias("root"))
    known = stored(known, work_dir(spark, "similar-known"))
    placed = met.select("key", "node").join(known.select("node", "root"), "node")
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).filter("low <> high").select("key", "size")
    mixed = stored(mixed, work_dir(spark, "similar-mixed"))
    left = join_hot(met.select("key", "node"), mixed, "key", "size", total).select("key", "node").join(known, "node")
    more = _verified(tile_pairs(left, similarity), rows, texts, similarity, shingle)
    if more.isEmpty():
        return roots
    # the later links join groups: components of the links between roots, then each node's
    of = lambda end: roots.select(F.col("u").alias(end), F.col("root").alias(f"{end}_root"))
    between = more.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
    tops = stored(connected_components(between, "similar-components"), work_dir(spark, "similar-tops"))
    moved = join_salted(roots, tops.select(F.col("u").alias("root"), F.col("root").alias("top")), "root", "u", outer=True).select("u", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(tops.join(roots.select("u"), "u", "left_anti")).distinct()


def _close(pairs: DataFrame, facts: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` that may link and whose sizes allow the similarity; a node of many pairs is dealt over several tasks."""

    def sift(batches):
        for batch in batches:
            a, b = (_columns(*(batch.column(k) for k in at)) for at in ((2, 4, 6), (3, 5, 7)))
            every = np.arange(batch.num_rows)
            good = np.isin(every, may_link(a, b, every, every, similarity)) & (np.minimum(a["n"], b["n"]) >= similarity * np.maximum(a["n"], b["n"]) - 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good))

    for end, other, mark in (("u", "v", "a_"), ("v", "u", "b_")):
        pairs = join_salted(pairs, facts.select(F.col("node").alias(end), *(F.col(c).alias(mark + c) for c in ("n", "fp", "sketch"))), end, other)
    return pairs.select("u", "v", "a_n", "b_n", "a_fp", "b_fp", "a_sketch", "b_sketch").mapInArrow(sift, "u long, v long")


def _grouped(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``doc_id, digest, root`` for each row."""
    spark = docs.sparkSession
    ready(spark)
    texts = _texts(docs)
    rows = stored(_rows(texts, shingle), work_dir(spark, "similar-rows"))
    roots = stored(similar_links(rows, texts, similarity, shingle), work_dir(spark, "similar-groups"))
    # rows of one node may be any share of all; most nodes have no link and need no join
    own = rows.select("doc_id", "digest", "node")
    return join_salted(own, roots.withColumnRenamed("u", "node"), "node", "doc_id", outer=True).select("doc_id", "digest", F.coalesce("root", "node").alias("root"))


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One row for each input row: ``doc_id, digest, component_id``; ``digest`` is ``xxhash64`` of the text.

    ``docs``: ``doc_id, text``; other columns are not read. Documents whose sets
    of word shingles have a Jaccard similarity of at least ``similarity`` are
    linked; ``component_id`` is the smallest ``doc_id`` reachable (null where all
    ids reachable are null). Null text counts as empty; texts without a word are
    alike. An empty table gives an empty result. The constants above hold for a
    similarity of 0.8 or more; a pair is missed with a probability under one in a
    million, and no pair is linked that hasn't the similarity.
    """
    spark = docs.sparkSession
    rows = stored(_grouped(docs, similarity, shingle), work_dir(spark, "similar-placed"))
    named = stored(rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")), work_dir(spark, "similar-named"))
    return join_hot(rows, named, "root", "size", rows.count()).select("doc_id", "digest", "component_id")


def drop_similar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, less those that come after another of their group: one row of each group stays.

    It is the one with the smallest ``doc_id`` (nulls last), of several texts
    with that id the one with the smallest digest; so no group loses its last
    row, whatever ids repeat.
    """
    return keep_rows(docs, _grouped(docs, similarity, shingle), "root", lambda text: F.xxhash64(text))
