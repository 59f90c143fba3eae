"""Token ids in Arrow files of fixed-size-list batches: equal-length sequences with masks, read without copying."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefold.llm.common import commit_files, id_text, ordered_cuts, ready, remove_dir, stored
from codefold.llm.tokens import encoder

LENGTH, ROWS, END = 2048, 256, 0
#: Documents in a batch of a shard's index.
INDEX_ROWS = 4096
_MANIFEST = "shard int, path string, index string, documents long, n_tokens long, sequences long"
_DRAFT = f"path_now string, index_now string, {_MANIFEST}"


def schema_of(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(pa.field("item", kind, False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))])


class _Shard:
    """One shard's sequences and its index of documents, under temporary names of this attempt's own."""

    def __init__(self, folder: str, work: str, shard: int, length: int, rows: int, kind: pa.DataType):
        from pyarrow import fs

        self.store, self.folder = fs.FileSystem.from_uri(work)
        self.uri, self.work, self.shard, self.length, self.kind = folder, work, shard, length, kind
        self.store.create_dir(self.folder, recursive=True)
        self.buffer, self.filled, self.n, self.sequences, self.documents = np.zeros(length * rows, kind.to_pandas_dtype()), 0, 0, 0, 0
        self.tokens = self._open(schema_of(length, kind))
        self.index = self._open(pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
        self.held = ([], [], [])

    def _open(self, schema: pa.Schema):
        name = f"{uuid.uuid4().hex}.tmp"
        stream = self.store.open_output_stream(f"{self.folder}/{name}", compression=None)
        return f"{self.work}/{name}", stream, pa.ipc.new_file(stream, schema)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for column, x in zip(self.held, (doc_id, self.n, len(ids))):
            column.append(x)
        self.n, self.documents = self.n + len(ids), self.documents + 1
        while len(ids):
            part = ids[: len(self.buffer) - self.filled]
            self.buffer[self.filled : self.filled + len(part)] = part
            self.filled, ids = self.filled + len(part), ids[len(part) :]
            if self.filled == len(self.buffer):
                self._flush()
        if len(self.held[0]) == INDEX_ROWS:
            self._list()

    def _list(self) -> None:
        if self.held[0]:
            self.index[2].write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in self.held], ["doc_id", "start", "n_tokens"]))
            self.held = ([], [], [])

    def _flush(self) -> None:
        rows = -(-self.filled // self.length)
        if rows:
            self.buffer[self.filled :] = 0
            size = rows * self.length
            mask = np.arange(size) < self.filled
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=t) for x, t in zip((self.buffer[:size], mask), schema_of(self.length, self.kind).types)]
            self.tokens[2].write_batch(pa.RecordBatch.from_arrays(lists, schema=schema_of(self.length, self.kind)))
            self.sequences, self.filled = self.sequences + rows, 0

    def close(self) -> tuple:
        """A row of the draft manifest."""
        self._flush()
        self._list()
        for _, stream, writer in (self.tokens, self.index):
            writer.close()
            stream.close()
        name = f"{self.uri}/shard-{self.shard:06d}"
        return self.tokens[0], self.index[0], self.shard, f"{name}.arrow", f"{name}.docs.arrow", self.documents, self.n, self.sequences


def _encoded(docs: DataFrame, tokenizer: str, end: int, wide: bool) -> DataFrame:
    """``shard, doc_id, tie, ids``: each text's ids with ``end``, as little-endian bytes of 16 or 32 bits, and the shard its place in the order gives it."""
    spark = docs.sparkSession
    cuts = spark.sparkContext.broadcast(ordered_cuts(docs, "doc_id", max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    kind = "<u4" if wide else "<u2"
    tail = np.array([end], dtype=kind).tobytes()

    def encode(batches):
        own = encoder(tokenizer)
        for batch in batches:
            out = [own.encode(text, kind) + tail for text in batch.column(2).to_pylist()]
            ids, ties = batch.column(0), batch.column(1)
            yield pa.RecordBatch.from_arrays([pa.array(cuts.value.of(ids, ties)), ids, ties, pa.array(out, pa.binary())], ["shard", "doc_id", "tie", "ids"])

    rows = id_text(docs).select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(encode, "shard int, doc_id long, tie long, ids binary").repartitionById(cuts.value.parts, "shard")


def write_token_shards(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", length: int = LENGTH, end: int = END, rows: int = ROWS, wide: bool = False) -> DataFrame:
    """Write the ids of all texts in ascending ``doc_id`` below ``folder`` (a URI); returns the manifest, a row for each shard.

    Each document's ids are followed by ``end``. A shard holds the ids of one
    range of ``doc_id`` as rows of ``length`` ids (16 bits, or 32 if ``wide``)
    with a mask; only its last row is padded, by masked zeros. Beside it lies an
    index of its documents. Null text counts as empty (its ``end`` alone); null
    ids come first; rows with one id go in the order of their texts' hashes and
    may take several shards; other columns are not read; an empty table gives an
    empty manifest.

    Texts are encoded where they are read; what moves, once, is their ids, by
    ranges that were taken from the ids of all documents. A writer appends and
    holds one batch. Files get their names once the table of them is written.
    """
    ready(docs.sparkSession)
    ordered = _encoded(docs, tokenizer, end, wide).sortWithinPartitions("shard", "doc_id", "tie")
    kind, work = pa.uint32() if wide else pa.uint16(), f"{folder}/_work"

    def write(batches):
        shard, found = None, []
        for batch in batches:
            for number, doc_id, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if shard is None or shard.shard != number:
                    found += [shard.close()] if shard else []
                    shard = _Shard(folder, work, number, length, rows, kind)
                shard.add(doc_id, np.frombuffer(ids, "<u4" if wide else "<u2"))
        found += [shard.close()] if shard else []
        kinds = (*[pa.string()] * 2, pa.int32(), *[pa.string()] * 2, *[pa.int64()] * 3)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [[]] * 8, kinds)], [x.split()[0] for x in _DRAFT.split(", ")])

    draft = stored(ordered.mapInArrow(write, _DRAFT), f"{work}/draft")
    manifest = commit_files(draft, {"path_now": "path", "index_now": "index"}, f"{folder}/manifest")
    remove_dir(work)
    return manifest


def open_shard(path: str) -> pa.ipc.RecordBatchFileReader:
    """A shard for random access; local files are mapped, so a batch's arrays point into the file."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    return pa.ipc.open_file(pa.memory_map(place) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(place))


def sequence(reader: pa.ipc.RecordBatchFileReader, k: int, rows: int = ROWS) -> tuple[np.ndarray, pa.Array]:
    """The shard's ``k``-th sequence and mask without reading what lies before."""
    batch = reader.get_batch(k // rows)
    tokens, mask = (batch.column(c)[k % rows].values for c in (0, 1))
    return tokens.to_numpy(), mask


def document_ids(path: str, index: str):
    """Batches of ``(doc_ids, starts, sizes, crcs)`` of a shard's documents in order; holds one batch of the shard at a time."""
    tokens, documents = open_shard(path), open_shard(index)
    at, held, low = -1, np.empty(0, np.uint16), 0
    for k in range(documents.num_record_batches):
        part, crcs = documents.get_batch(k), []
        for start, n in zip(*(part.column(c).to_pylist() for c in (1, 2))):
            crc = 0
            while n:
                while start >= low + len(held):
                    low, at = low + len(held), at + 1
                    batch = tokens.get_batch(at)
                    held = batch.column(0).values.to_numpy()[: batch.column(1).values.true_count]
                piece = held[start - low : start - low + n]
                crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                start, n = start + len(piece), n - len(piece)
            crcs.append(crc)
        yield part.column(0), part.column(1), part.column(2), pa.array(crcs, pa.int64())


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """From the files: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32``.

    Shards are read apart. Where each begins is a running sum over shards of two
    numbers each, made on the driver; their number is that of the writer's tasks.
    """
    import pyarrow.compute as pc

    ready(spark)
    sizes = sorted(tuple(r) for r in manifest.select("shard", "n_tokens").collect())
    before = dict(zip((s for s, _ in sizes), np.cumsum([0, *(n for _, n in sizes)]).tolist()))
    bases = spark.sparkContext.broadcast(before)

    def read(batches):
        for batch in batches:
            for shard, path, index in zip(*(batch.column(c).to_pylist() for c in range(3))):
                for ids, starts, sizes, crcs in document_ids(path, index):
                    yield pa.RecordBatch.from_arrays([ids, pc.add(starts, bases.value[shard]), sizes, crcs], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("shard", "path", "index").repartition(max(1, min(len(sizes), 20_000)))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
