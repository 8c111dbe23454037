"""Operator 2: token ids in Arrow files of fixed-size lists, with zero-copy random access.

A shard is two Arrow IPC files. ``*.arrow`` holds the ids of its documents, one after the other,
as rows of ``length`` ids (16 bits where the vocabulary allows) and a mask of equal shape that is
false on the padding of the last row; all batches but the last have ``BATCH_ROWS`` rows, so the
place of any sequence or token follows by division. ``*.index.arrow`` holds id, first token and
number of tokens of each document.

Documents are dealt to shards by ranges of ids, so the shards in turn hold them in ascending
order. A task writes files of its own, named by its attempt; only the manifest row it returns
makes them part of the result, so a repeated task does no harm. The files go to the folder that
executors share, through Arrow's file systems (local paths, hdfs, s3 and others by URI).

Edge cases: a null or empty text has the end id alone; null ids come last; rows that repeat an
id follow each other, by how their texts begin; an empty table gives no shards and no rows; a text longer than a
batch just spans several; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import new_path, partitions, small_batches, staged
from .tokens import encoder, vocabulary_file
from .words import slices

#: Sequences, and documents of the index, to a batch of a file.
BATCH_ROWS, INDEX_ROWS = 256, 1 << 16
CHUNK_BYTES = 4 << 20


_INDEX = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class ShardWriter:
    """Appends ids to one shard; holds less than a batch of them, and of its index, at a time."""

    def __init__(self, base: str, length: int, kind: pa.DataType):
        self.system, self.path = fs.FileSystem.from_uri(base)
        self.length, self.kind = length, kind
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = self.system.open_output_stream(f"{self.path}.arrow")
        self.writer = ipc.new_file(self.out, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.tokens = self.docs = 0
        self.index: list[tuple[int | None, int, int]] = []
        self.index_out = self.system.open_output_stream(f"{self.path}.index.arrow")
        self.index_writer = ipc.new_file(self.index_out, _INDEX)

    def add(self, name: int | None, ids: np.ndarray) -> None:
        self.index.append((name, self.tokens, len(ids)))
        self.docs += 1
        if len(self.index) == INDEX_ROWS:
            self._flush_index()
        self.tokens += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.length * BATCH_ROWS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        size = self.length * BATCH_ROWS
        for at in range(0, len(ids) if last else len(ids) - size + 1, size):
            part = ids[at : at + size].astype(self.kind.to_pandas_dtype())
            pad = -len(part) % self.length
            values, mask = pa.array(np.pad(part, (0, pad)), self.kind), pa.array(np.arange(len(part) + pad) < len(part))
            self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(x, self.length) for x in (values, mask)], schema=self.schema))
        rest = np.zeros(0, np.uint32) if last else ids[len(ids) - len(ids) % size :]
        self.held, self.n_held = [rest], len(rest)

    def _flush_index(self) -> None:
        self.index_writer.write_batch(pa.record_batch([pa.array([r[i] for r in self.index], pa.int64()) for i in range(3)], schema=_INDEX))
        self.index = []

    def close(self) -> None:
        self._flush(True)
        self._flush_index()
        for x in (self.writer, self.out, self.index_writer, self.index_out):
            x.close()


class ShardReader:
    """Random access to one shard; local files are mapped, not read."""

    def __init__(self, base: str):
        self.system, self.path = fs.FileSystem.from_uri(base)
        self.reader = ipc.open_file(self._open(f"{self.path}.arrow"))
        self.length = self.reader.schema.field("ids").type.list_size
        self.at, self.batch = -1, None

    def _open(self, path: str):
        return pa.memory_map(path) if isinstance(self.system, fs.LocalFileSystem) else self.system.open_input_file(path)

    def index(self) -> Iterator[pa.RecordBatch]:
        """Batches of (id, start, n_tokens), in order."""
        reader = ipc.open_file(self._open(f"{self.path}.index.arrow"))
        for k in range(reader.num_record_batches):
            yield reader.get_batch(k)

    def _batch(self, k: int) -> pa.RecordBatch:
        if k != self.at:
            self.at, self.batch = k, self.reader.get_batch(k)
        return self.batch

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of row i, a view of the file, and its mask."""
        row = self._batch(i // BATCH_ROWS)
        at = i % BATCH_ROWS * self.length
        ids, mask = (row.column(k).flatten().slice(at, self.length) for k in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of the ids from start on, one for each batch they lie in."""
        size = self.length * BATCH_ROWS
        while n > 0:
            own = self._batch(start // size).column(0).flatten().to_numpy(zero_copy_only=True)[start % size :][:n]
            yield own
            start, n = start + len(own), n - len(own)


_MANIFEST = "shard int, base string, n_docs long, n_tokens long"


def _write(folder: str, path: str, length: int, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        base = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        writer = None
        for batch in slices(batches, "text", most):
            if writer is None:
                fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1])
                writer = ShardWriter(base, length, pa.uint16() if encoder(path).small else pa.uint32())
            for name, own in zip(batch.column("id").to_pylist(), encoder(path).encode(batch.column("text")), strict=True):
                writer.add(name, np.append(own, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            yield pa.record_batch([pa.array([x], t) for x, t in ((task.partitionId(), pa.int32()), (base, pa.string()), (writer.docs, pa.int64()), (writer.tokens, pa.int64()))], names=["shard", "base", "n_docs", "n_tokens"])

    return run


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 0, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Write the shards; returns their manifest: (shard, base, n_docs, n_tokens, start).

    ``start`` counts the ids in all shards before. The manifest is itself a staged table, so
    reading it never writes again.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # an id with many rows is split by how its texts begin, then by their hashes, then anyhow: those are equal rows
    order = [F.col("id").asc_nulls_last(), F.substring("text", 1, 64), F.xxhash64("text"), F.monotonically_increasing_id()]
    ranged = rows.select("*", *[c.alias(f"order_{i}") for i, c in enumerate(order[1:])])
    order = [order[0], "order_0", "order_1", "order_2"]
    ranged = ranged.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("id", "text")
    target = folder or new_path(spark, "token-files")
    manifest = staged(ranged.mapInArrow(_write(target, tokenizer or vocabulary_file(), length, end_id, CHUNK_BYTES), _MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard, not for each document
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


_READ = "id long, start long, n_tokens long, ids_crc32 long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, first in zip(batch.column("base").to_pylist(), batch.column("start").to_pylist(), strict=True):
            shard = ShardReader(base)
            for index in shard.index():
                sums = []
                for start, n in zip(index.column("start").to_pylist(), index.column("n_tokens").to_pylist(), strict=True):
                    crc = 0
                    for view in shard.tokens(start, n):
                        crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                    sums.append(crc)
                yield pa.record_batch([index.column("id"), pa.array(index.column("start").to_numpy() + first), index.column("n_tokens"), pa.array(sums, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])


def read_digests(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: (id_col, start, n_tokens, ids_crc32)."""
    spread = manifest.repartition(partitions(manifest.sparkSession))
    return spread.mapInArrow(_read, _READ).withColumnRenamed("id", id_col)


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    return read_digests(write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet")))
