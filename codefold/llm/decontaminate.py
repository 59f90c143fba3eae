"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefold.llm.common import id_text, ready
from codefold.llm.hashing import PARTS, shingles, wide_fingerprints

SHINGLE, SIMILARITY = 5, 0.8
#: Windows with a similarity of 0.8 differ from their item in some 40 of 256 bits, with a deviation of 6; one in a hundred million differs in over 80. Of fingerprints within the radius one of four 64-bit blocks differs in 20 bits or fewer; of random ones 0.7 % have such a block.
RADIUS, BLOCKS = 80, PARTS
#: Words of benchmark text that one pass over the documents holds in a worker, and windows and items in a comparison.
PASS_WORDS, WINDOWS, ITEMS = 2_000_000, 4096, 256
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return _WORD.findall(text.lower())


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: shingles count as often as they occur."""
    shared = sum(min(n, b[h]) for h, n in a.items() if h in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared) if shared else 0.0


def _stretches(starts: np.ndarray, most: int = WINDOWS) -> list[np.ndarray]:
    """Ascending starts in parts that lie in one stretch of ``most`` words each, so that a long text's bits are never all in memory."""
    return np.split(starts, np.flatnonzero(np.diff(starts // most)) + 1) if len(starts) else []


class Matcher:
    """All items of a pass. Items are grouped by their number of words; each group has its own windows and index."""

    def __init__(self, items: list[tuple[int | None, str]], least: float = SIMILARITY, radius: int = RADIUS):
        self.least, self.radius = least, radius
        groups: dict[int, list] = {}
        for item_id, text in items:
            if words := words_of(text):
                groups.setdefault(len(words), []).append((item_id, shingles(words, min(SHINGLE, len(words)))))
        self.groups, known = [], {}
        for size, members in sorted(groups.items()):
            k = min(SHINGLE, size)
            prints = np.vstack([wide_fingerprints(h, np.array([0]), len(h)) for _, h in members])
            self.groups.append((size, k, size - k + 1, [m[0] for m in members], [Counter(m[1].tolist()) for m in members], prints))
            known.setdefault(k, []).extend(m[1] for m in members)
        self.known = {k: np.unique(np.concatenate(v)) for k, v in known.items()}
        self.filters = {}
        for k, v in self.known.items():
            self.filters[k] = np.zeros(1 << 18, bool)
            self.filters[k][(v & np.uint64(0x3FFFF)).astype(np.int64)] = True

    def _hits(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Positions whose shingle some item has."""
        maybe = np.flatnonzero(self.filters[k][(hashes & np.uint64(0x3FFFF)).astype(np.int64)])
        if len(maybe):
            at = np.searchsorted(self.known[k], hashes[maybe])
            maybe = maybe[self.known[k][np.minimum(at, len(self.known[k]) - 1)] == hashes[maybe]]
        return maybe

    def _near(self, found: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Which of the windows' and items' fingerprints lie within the radius: first those with a block that differs little, then all their bits."""
        far = np.bitwise_count(found[:, None, :] ^ prints[None, :, :])
        windows, items = np.nonzero((far <= self.radius // BLOCKS).any(axis=2))
        good = far[windows, items].sum(axis=1, dtype=np.int64) <= self.radius
        return np.stack([windows[good], items[good]], axis=1)

    def matches(self, text: str) -> list[tuple[int | None, float, int]]:
        """``(item_id, similarity, first word)`` of the best window of each item that reaches the similarity."""
        words = words_of(text)
        cache: dict[int, tuple] = {}
        best: dict[int, tuple] = {}
        for g, (size, k, n, ids, counters, prints) in enumerate(self.groups):
            if k not in cache:
                hashes = shingles(words, k)
                cache[k] = hashes, self._hits(hashes, k)
            hashes, hits = cache[k]
            # a window shares at least this many shingles with an item it is similar to, or it is not similar
            span = min(n, len(hashes))
            need = int(np.ceil(self.least / (1 + self.least) * (span + n) - 1e-9))
            if len(hits) < max(1, need):
                continue
            marks = np.zeros(len(hashes) + 1, np.int32)
            marks[hits + 1] = 1
            marks = np.cumsum(marks)
            starts = np.flatnonzero(marks[span:] - marks[: len(marks) - span] >= max(1, need))
            for part in _stretches(starts):
                first = int(part[0])
                found = wide_fingerprints(hashes[first : int(part[-1]) + span], part - first, span)
                pairs = [self._near(found, prints[low : low + ITEMS]) + (0, low) for low in range(0, len(ids), ITEMS)]
                for i, j in np.concatenate(pairs).tolist():
                    start = int(part[i])
                    alike = similarity(Counter(hashes[start : start + span].tolist()), counters[j])
                    if alike >= self.least and alike > best.get((g, j), (0,))[0]:
                        best[g, j] = alike, start, ids[j]
        return sorted(((item, alike, start) for alike, start, item in best.values()), key=lambda x: (x[0] is None, x[0] or 0, x[2]))


def _passes(docs: DataFrame, benchmark: DataFrame, pass_words: int):
    """The benchmark's items in parts of about ``pass_words`` words, each broadcast as a matcher."""
    spark = docs.sparkSession
    ready(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.size(F.split("text", "\\s+")))).first()[0] or 0
    parts = 1 + total // pass_words
    for k in range(parts if total else 0):
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == k) if parts > 1 else items
        yield spark.sparkContext.broadcast(Matcher([(r.item_id, r.text) for r in own.orderBy("item_id", "text").collect()]))


_SCHEMA = "doc_id long, item_id long, similarity double, start_word long"


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, pass_words: int = PASS_WORDS) -> DataFrame:
    """Pairs of documents and benchmark items that they hold: ``doc_id, item_id, similarity, start_word``.

    ``docs``: ``doc_id, text``; ``benchmark``: ``item_id, text``; other columns are
    not read. Words are compared in lower case without punctuation. A document
    holds an item if a window of as many words (the whole text if it has fewer)
    reaches a weighted Jaccard similarity of 0.8 over shingles of five words; an
    item of fewer words is one shingle. The best window's similarity and first
    word are returned, one row for each pair and input row. Null texts count as
    empty and match nothing; null ids are kept; repeated items count once; an
    empty table on either side gives an empty result.

    Whole texts are searched at every word. Windows that share too few shingles
    with any item to be that similar are left out by a count, which loses none.
    A benchmark of over ``pass_words`` words takes several passes, so what is
    broadcast is bounded. There is no shuffle of documents.
    """
    rows, found = id_text(docs), None
    for matcher in _passes(docs, benchmark, pass_words):
        part = rows.mapInArrow(_search(matcher), _SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], _SCHEMA)


def _search(matcher):
    def search(batches):
        own = matcher.value
        for batch in batches:
            out = [[], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for item, alike, start in own.matches(text):
                    for column, x in zip(out, (doc_id, item, alike, start)):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], [x.split()[0] for x in _SCHEMA.split(", ")])

    return search


def drop_leaks(docs: DataFrame, benchmark: DataFrame, pass_words: int = PASS_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item: a filter, without a join or shuffle."""
    for matcher in _passes(docs, benchmark, pass_words):
        docs = docs.filter(_clean(matcher)(F.coalesce(F.col("text"), F.lit(""))))
    return docs


def _clean(matcher):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        own = matcher.value
        return pd.Series([not own.matches(t) for t in texts], dtype=bool)

    return clean
