"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefold.llm.common import ready

#: Buckets of the hash (a power of two), and the labelled documents that training looks at.
BUCKETS, SAMPLE = 1 << 20, 8_000
THRESHOLD, HELD_OUT = 0.3, 5
#: Of the updates: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-4, 1e-3, 3
SCALE = 16.0
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
CACHE_WORDS = 100_000


def shape(word: str) -> int:
    """A class of 0..31: case, digits, what it ends with, length."""
    core = word.rstrip(".,;:!?\"')")
    case = 0 if not core else 3 if core.isupper() and len(core) > 1 else 2 if core[0].isupper() else 1
    tail = 0 if len(core) == len(word) else 2 if word.endswith(("!!", "??", "...")) else 1
    return case * 8 + tail * 2 + (not core.isalpha())


class _Words(dict):
    """Word -> its hash above 8 bits of shape."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = code = zlib.crc32(word.lower().encode("utf-8", "replace")) << 8 | shape(word)
        return code


_WORDS = _Words()


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the whole text's n-grams, repeats included: words (1 and 2), and shapes marked where a word repeats the last (1, 2 and 3)."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64)
    code = np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words)).view(np.uint64)
    word = code >> np.uint64(8)
    same = np.zeros(len(words), np.uint64)
    same[1:] = word[1:] == word[:-1]
    form = (code & np.uint64(0xFF)) * np.uint64(2) + same + np.uint64(1)
    a, b, c = (np.uint64(x) for x in _MIX)
    grams = [word * a, word[1:] * a + word[:-1] * b + np.uint64(1), form * b + np.uint64(2), (form[1:] + form[:-1] * np.uint64(64)) * c + np.uint64(3)]
    grams.append((form[2:] + form[1:-1] * np.uint64(64) + form[:-2] * np.uint64(4096)) * a + np.uint64(4))
    mixed = np.concatenate(grams)
    mixed ^= mixed >> np.uint64(29)
    mixed *= b
    return (mixed >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)


def score(text: str, weights: np.ndarray) -> float:
    """Sparse dot product of the text's n-gram frequencies with the weights (the last is the bias), as a probability."""
    at = features(text, len(weights) - 1)
    z = float(weights[-1]) + (SCALE * float(weights[at].mean()) if len(at) else 0.0)
    return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss."""

    def __init__(self, buckets: int):
        self.z, self.n = np.zeros(buckets + 1), np.zeros(buckets + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text (null: empty) is divisible by ``HELD_OUT``."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, bias last, from the labelled documents that are not held out.

    At most ``sample`` ids are used: those whose hashes come first among all
    labelled ids, so they are spread over the table. Their texts, whole, go to
    one task, which updates in the order of the hashes. Of several labels of an
    id the mean counts, rounded; null ids and null labels are left out. Without
    any labelled row all weights are 0.
    """
    spark = docs.sparkSession
    ready(spark)
    hashed = F.xxhash64(F.col("__cf_id"))
    chosen = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("__cf_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("__cf_label"))
    chosen = chosen.orderBy(hashed, "__cf_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("__cf_id"), F.coalesce("text", F.lit("")).alias("__cf_text"))
    rows = texts.join(F.broadcast(chosen), "__cf_id").repartition(1).sortWithinPartitions(hashed, F.xxhash64("__cf_text")).select("__cf_text", "__cf_label")

    def learn(batches):
        seen = []
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, n = np.unique(features(text, buckets), return_counts=True)
                seen.append((np.append(found, buckets).astype(np.int32), np.append(n * (SCALE / max(1, n.sum())), 1.0).astype(np.float32), label))
        model = Ftrl(buckets)
        for _ in range(epochs if seen else 0):
            for at, x, label in seen:
                model.update(at, x.astype(float), label)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f4").tobytes()], pa.binary())], ["weights"])

    found = rows.mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(found[0].weights, "<f4") if found else np.zeros(buckets + 1, "<f4")


def scorer(docs: DataFrame, weights: np.ndarray):
    """A column function: text (null: empty) -> score. The weights' size is fixed by ``buckets``."""
    ready(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        own = table.value
        return pd.Series([score(t, own) for t in texts], dtype="float64")

    return lambda text: scores(F.coalesce(text, F.lit("")))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row for each input row: ``doc_id, held_out, score, predicted``.

    ``docs``: ``doc_id, text`` (nothing else is read, and ``doc_id`` is no input
    of a score); ``labels``: ``doc_id, quality``. Null text counts as empty and is
    scored by the bias; whole texts are scored; repeated rows get equal scores; an
    empty table gives an empty result.
    """
    by = scorer(docs, train(docs, labels, sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), by(F.col("text")).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, that score the threshold or more: one pass, no shuffle."""
    by = scorer(docs, train(docs, labels, sample))
    return docs.filter(by(F.col("text")) >= threshold)
