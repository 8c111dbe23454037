"""How an export changes a folder: files are written beside it, judged, published, and then told in the manifest.

A run's files go to ``.run-<id>`` under the output folder, each named by the task attempt that wrote it;
only the rows that committed tasks return make them part of the run. What is due is then copied to its
place by way of a file beside it and a rename, so every file is whole, the old or the new one, and an
attempt may be repeated. Files that are no longer made go next, and last a new manifest takes the old
one's place: a table of its own, to which ``.manifest`` points from an overwriting rename on. A run that
breaks off anywhere leaves the old manifest in force, and the next run finds the rest to do: what was
published differs from it, what was deleted is missing.

Tasks reach files by Arrow's file systems, the driver by Hadoop's. Names are taken as they are: a
namespace with ``=``, ``%`` or ``#`` has a file of that name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog import schema
from stratalog.functions.names import utf16
from stratalog.operators import delta
from stratalog.sources.files import file_system, located

#: Bytes that are read or written at once.
AT_ONCE = 1 << 20
#: What identifies a shard besides its path.
ABOUT = ("format", "kind", "target", "namespace", "part")
_TEXT = dict.fromkeys(("path", *ABOUT, "file"), pa.string())
_NUMBERS = dict.fromkeys(("piece", "records", "bytes", "n", "x", "s"), pa.int64())
_WRITTEN = ", ".join([f"{c} string" for c in _TEXT] + [f"{c} long" for c in _NUMBERS])


def _told(rows: list[dict[str, Any]], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], names=list(kinds))


def _write(folder: str, run: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, base = file_system(folder)
        system.create_dir(f"{base}/{run}")
        out, row, done, count = None, None, [], 0
        for batch in batches:
            path = batch.column("path").to_pylist()
            hashes, places = (np.asarray(batch.column(c)) for c in ("hash", "place"))
            line = batch.column("line").to_pylist()
            starts = [i for i in range(len(path)) if i == 0 or path[i] != path[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(path)], strict=True):
                if row is None or row["path"] != path[a]:
                    if row is not None:
                        out.close()
                        done.append(row)
                    file, count = f"{run}/{context.partitionId():06d}-{context.taskAttemptId()}-{count}", count + 1
                    out = system.open_output_stream(f"{base}/{file}")
                    row = {"path": path[a], **{c: batch.column(c)[a].as_py() for c in ABOUT}, "file": file, "piece": context.partitionId(), **dict.fromkeys(("records", "bytes", "n", "x", "s"), 0)}
                data = "".join(f"{x}\n" for x in line[a:b]).encode()
                out.write(data)
                row["bytes"] += len(data)
                row["n"] += b - a
                row["records"] += int(np.isin(places[a:b], (1, 2)).sum())
                row["x"] ^= int(np.bitwise_xor.reduce(hashes[a:b]))
                row["s"] = int(np.int64(row["s"]) + hashes[a:b].sum())
            yield _told(done, _TEXT | _NUMBERS)
            done = []
        if row is not None:
            out.close()
            yield _told([row], _TEXT | _NUMBERS)

    return task


def write_beside(lines: DataFrame, folder: str, run: str) -> DataFrame:
    """Write lines (path, format, kind, target, namespace, part, place, _order, line) to the run's own folder: a row for each piece of a shard.

    Ranges of (path, place, order) spread a large shard over several tasks; its pieces follow each
    other by number. The plan writes whenever it is run, so it is run once.
    """
    whole = F.struct("place", "_order", "line")
    order = [F.col("path"), F.col("place"), utf16(F.col("_order")), F.col("line")]
    width = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.withColumn("hash", F.xxhash64(whole)).repartitionByRange(width, *order).sortWithinPartitions(*order)
    return rows.select("path", *ABOUT, "place", "line", "hash").mapInArrow(_write(folder, run), _WRITTEN)


def shards(pieces: DataFrame) -> DataFrame:
    """(path, …, records, bytes, fingerprint, pieces) of each shard; the fingerprint adds up its lines' hashes, so how they were cut does not show."""
    total = {c: F.sum(c).alias(c) for c in ("records", "bytes", "n")}
    wrapped = F.pmod(F.sum(F.col("s").cast("decimal(38,0)")), F.lit("18446744073709551616").cast("decimal(38,0)"))
    agg = pieces.groupBy("path", *ABOUT).agg(*total.values(), F.bit_xor("x").alias("x"), wrapped.alias("s"), F.array_sort(F.collect_list(F.struct("piece", "file"))).alias("pieces"))
    return agg.select("path", *ABOUT, "records", "bytes", delta.fingerprint(F.concat_ws(":", "n", "x", "s"), twice=True).alias("fingerprint"), F.col("pieces.file").alias("pieces"))


def _each(folder: str, work: Callable[[fs.FileSystem, str, dict[str, Any]], dict[str, Any]], kinds: dict[str, pa.DataType]):
    """A task that does ``work`` for each row; a failure is told in its row and stops nothing."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                try:
                    if ".." in row["path"].split("/"):
                        raise OSError("it would leave the folder")
                    rows.append({**dict.fromkeys(kinds), "path": row["path"], **work(system, base, row)})
                except (OSError, pa.ArrowException) as e:
                    rows.append({**dict.fromkeys(kinds), "path": row["path"], "error": f"{type(e).__name__}: {e}"})
            yield _told(rows, kinds)

    return task


def _spread(rows: DataFrame) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def _whole(system: fs.FileSystem, base: str, path: str, sources: list[tuple[fs.FileSystem, str]]) -> None:
    """Put the sources, one after the other, in a file beside ``path``, which it then replaces."""
    to = f"{base}/{path}"
    system.create_dir(to.rsplit("/", 1)[0])
    beside = f"{to}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(beside) as w:
            for a, at in sources:
                with a.open_input_stream(at) as r:
                    while chunk := r.read(AT_ONCE):
                        w.write(chunk)
        system.move(beside, to)
    except BaseException:
        if system.get_file_info(beside).type == fs.FileType.File:
            system.delete_file(beside)
        raise


def publish(due: DataFrame, folder: str) -> DataFrame:
    """Put the shards (path, pieces) in their places; (path, error), of which error is null where it was done."""

    def work(system, base, row):
        _whole(system, base, row["path"], [(system, f"{base}/{p}") for p in row["pieces"]])
        return {}

    return _spread(due.select("path", "pieces")).mapInArrow(_each(folder, work, {"path": pa.string(), "error": pa.string()}), "path string, error string")


def publish_assets(due: DataFrame, folder: str) -> DataFrame:
    """Copy the files (path, source) to their places; (path, error)."""

    def work(system, base, row):
        _whole(system, base, row["path"], [located(row["source"])])
        return {}

    return _spread(due.select("path", "source")).mapInArrow(_each(folder, work, {"path": pa.string(), "error": pa.string()}), "path string, error string")


def asset_fingerprints(assets: DataFrame, folder: str) -> DataFrame:
    """(path, namespace, source, fingerprint, bytes, error) of files (namespace, path, source): each is read once, nothing is written."""

    def work(system, base, row):
        a, at = located(row["source"])
        digest, n = hashlib.sha256(), 0
        with a.open_input_stream(at) as r:
            while chunk := r.read(AT_ONCE):
                digest.update(chunk)
                n += len(chunk)
        return {"namespace": row["namespace"], "source": row["source"], "fingerprint": digest.hexdigest(), "bytes": n}

    kinds = dict.fromkeys(("path", "namespace", "source", "fingerprint", "error"), pa.string()) | {"bytes": pa.int64()}
    rows = assets.select(F.concat(F.lit("assets/"), "namespace", F.lit("/"), F.regexp_replace("path", "^/", "")).alias("path"), "namespace", "source").filter("path is not null").dropDuplicates(["path"])
    return _spread(rows).mapInArrow(_each(folder, work, kinds), ", ".join(f"{c} {'long' if c == 'bytes' else 'string'}" for c in kinds))


def there(paths: DataFrame, folder: str) -> DataFrame:
    """Those of the paths at which there is a file."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        for batch in batches:
            names = batch.column("path").to_pylist()
            found = system.get_file_info([f"{base}/{p}" for p in names])
            yield batch.filter(pa.array([i.type == fs.FileType.File for i in found], pa.bool_()))

    return _spread(paths.select("path")).mapInArrow(task, "path string")


def remove(paths: DataFrame, folder: str) -> DataFrame:
    """Delete files; (path, error). A file that is gone already is no error."""

    def work(system, base, row):
        if system.get_file_info(f"{base}/{row['path']}").type == fs.FileType.File:
            system.delete_file(f"{base}/{row['path']}")
        return {}

    return _spread(paths.select("path")).mapInArrow(_each(folder, work, {"path": pa.string(), "error": pa.string()}), "path string, error string")


MANIFEST, MANIFESTS = ".manifest", ".manifests"


class Folder:
    """The driver's side of an output folder, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str) -> Any:
        base = self.hadoop.fs.Path(self.root)
        return self.hadoop.fs.Path(base, name) if name else base

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a small file beside ``name`` and rename it over the old one in one step."""
        beside = self.path(f"{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        option = getattr(self.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        context = self.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        context.rename(beside, self.path(name), options)


def previous(folder: Folder) -> tuple[DataFrame, DataFrame]:
    """The snapshot of the run before, empty at the first, and what is wrong with it as failures."""
    spark, name = folder.spark, folder.read(MANIFEST)
    if name is None:
        return spark.createDataFrame([], schema.SNAPSHOT), spark.createDataFrame([], schema.FAILURES)
    lines = spark.read.text(f"{folder.root}/{MANIFESTS}/{name.strip()}").withColumn("n", F.monotonically_increasing_id())
    lines = lines.withColumn("n", F.when(F.col("value") == delta.HEADER, 0).otherwise(F.col("n") + 1))
    return delta.read_snapshot(lines), delta.complaints(lines).select(F.lit("manifest").alias("kind"), F.lit(MANIFEST).alias("id"), F.col("complaint").alias("error"))


def write_manifest(folder: Folder, current: DataFrame) -> None:
    """Header, then paths in order, as a table of its own; then the pointer moves to it, and the old table goes."""
    before, name = folder.read(MANIFEST), uuid.uuid4().hex
    head = folder.spark.createDataFrame([(0, "", delta.HEADER)], "n int, path string, value string")
    lines = head.union(current.select(F.lit(1), "path", F.concat_ws("\t", "fingerprint", "path")))
    lines.orderBy("n", "path").select("value").write.text(f"{folder.root}/{MANIFESTS}/{name}")
    folder.replace(MANIFEST, name)
    if before is not None:
        folder.delete(f"{MANIFESTS}/{before.strip()}")
