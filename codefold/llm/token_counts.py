"""Token counts by a two-tier lookup on the map side."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefold.llm.common import id_text, ready
from codefold.llm.tokens import LONG_WORD, encoder

#: Words in the broadcast table, words that a task's summary names, and distinct words it counts before it drops the rarer half.
TABLE_WORDS, TASK_WORDS, COUNTED = 32_768, 8_192, 131_072
#: Tasks that merge the summaries; each hands the driver one of ``TABLE_WORDS`` words at most.
MERGERS = 16


def _summary(counts: Counter, most: int) -> pa.RecordBatch:
    found = counts.most_common(most)
    return pa.RecordBatch.from_arrays([pa.array([[w for w, _ in found]]), pa.array([[n for _, n in found]], pa.list_(pa.int64()))], ["words", "counts"])


def _pruned(counts: Counter, most: int) -> Counter:
    return counts if len(counts) <= most else Counter(dict(counts.most_common(most // 2)))


def frequent_lengths(docs: DataFrame, tokenizer: str, words: int = TABLE_WORDS) -> dict[str, int]:
    """Token counts of words that are frequent over all documents: at most ``words`` entries.

    Each task counts the words of all its texts in a bounded table and hands on
    the most frequent; some tasks merge these tables, and the driver the last
    few. What moves is a table for each task, no words of texts. The result only
    fills a cache: which words it names changes no count.
    """

    def top(batches):
        own, seen = encoder(tokenizer), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(w for w in own.split(text) or () if len(w) <= LONG_WORD)
            seen = _pruned(seen, COUNTED)
        yield _summary(seen, TASK_WORDS)

    def merge(batches):
        seen = Counter()
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update(dict(zip(w, n)))
                seen = _pruned(seen, COUNTED)
        yield _summary(seen, words)

    schema, seen = "words array<string>, counts array<long>", Counter()
    for r in docs.select("text").mapInArrow(top, schema).repartition(MERGERS).mapInArrow(merge, schema).toLocalIterator():
        seen.update(dict(zip(r.words, r.counts)))
    own = encoder(tokenizer)
    return {w: own.lengths[w] for w, _ in seen.most_common(words)} if own.words else {}


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """Tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``docs``: ``doc_id, text``; other columns are not read. A null text counts as
    empty (0 tokens); a null or repeated ``doc_id`` keeps its row. An empty table
    gives an empty result. Long texts are split into words whole.

    The first tier is a broadcast table of frequent words' token counts (at most
    ``TABLE_WORDS`` words), the second a cache in each Python worker, which is
    bounded in bytes and lasts from task to task. No word is shuffled; one scan
    finds the frequent words, and one counts.
    """
    spark = docs.sparkSession
    ready(spark)
    rows = id_text(docs)
    table = spark.sparkContext.broadcast(frequent_lengths(rows, tokenizer))

    def count(batches):
        own, known = encoder(tokenizer), table.value.get
        rare = own.lengths.__getitem__ if own.words else None
        for batch in batches:
            ids, n_bytes, n_tokens = batch.column(0), [], []
            for text in batch.column(1).to_pylist():
                n_bytes.append(len(text.encode()))
                if (words := own.split(text)) is None:
                    n_tokens.append(len(own.whole(text)))
                else:
                    found = list(map(known, words))
                    n_tokens.append(sum(filter(None, found)) + sum(rare(w) for w, n in zip(words, found) if n is None))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
