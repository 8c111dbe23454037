"""Operator 1: substring dedup by Rabin-Karp hashes of every fixed-length word window.

Plan
----
1. Each task hashes every window of its texts with rolling polynomials and keeps, of windows
   that repeat within a few megabytes of text, the first; the others are known to repeat.
   Windows leave the task grouped by hash bucket: 10 bytes of hash, and document and start as
   compressed differences, so the shuffle moves about 12 bytes a window. Of a hot window each few
   megabytes of text send one hash to its bucket; its other places need no count and are dealt
   by document, so a passage that every text holds is spread over all buckets.
2. Spark shuffles the buckets; each counts its hashes and finds the earliest place of each.
   All later places are marked, and those that were known.
3. Marks and texts meet by document bucket; overlapping windows merge into maximal intervals.

Two windows count as equal if 80 bits agree, 64 of one rolling hash and 16 of another, and the
bucket, which takes other bits of the second. With n windows and b buckets n * n / (b * 2**81) pairs
of different windows are expected to agree: 0.002 for the 2.5e13 windows of 100 TB in 2**17
buckets. A word stands as 64 bits from a table of random numbers by byte and place; two different
words that agree would only matter between windows that are equal otherwise.

The number of buckets follows the size of the input (``BUCKET_BYTES`` of text for each), up to
``MOST_BUCKETS``; from there on they grow, and with them what a task holds of one (2 to 3 GB at
100 TB). Where there are many buckets, chunks grow too, so that each still has some 20 windows of one.

Edge cases: a null or empty text has no words; a document under ``width`` words has no window
and is kept whole; null ids order after all others; rows that share an id count as documents of
their own, in an order of their contents; an empty table gives an empty result; columns other than the two
named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import fresh, small_batches, with_key
from .words import slices, split_words, windows

#: Bytes of text that a task hashes at once, and to a bucket; the most buckets.
CHUNK_BYTES, BUCKET_BYTES, MOST_BUCKETS = 2 << 20, 16 << 20, 1 << 17
#: Buckets that the usual chunk fills, and bytes of a larger chunk for each.
FILLED, FILL_BYTES = 1 << 14, 80


def _pack(values: np.ndarray) -> bytes:
    """Integers as compressed differences."""
    return zstandard.compress(np.diff(values, prepend=values[:0].dtype.type(0)).tobytes(), 1)


def _unpack(packed: list[bytes], kind: type) -> np.ndarray:
    parts = [np.cumsum(np.frombuffer(zstandard.decompress(x), dtype=kind), dtype=kind) for x in packed]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each key of a sorted array and where it stands."""
    if len(keys):
        cut = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip(np.r_[0, cut], np.r_[cut, len(keys)], strict=True):
            yield int(keys[a]), slice(a, b)


_HASHED = "bucket int, hashes binary, docs binary, starts binary"
_MARKED = "part int, docs binary, starts binary"


def _hash_batches(width: int, buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", most):
            batch = batch.sort_by("key")
            key = np.asarray(batch.column("key"), dtype=np.int64)
            words = split_words(batch.column("text"))
            at, (h, other) = windows(words, width, two=True)
            if not len(at):
                continue
            order = np.argsort(h, kind="stable")  # equal hashes stay in order of document and start
            same = np.zeros(len(at), bool)
            same[1:] = (h[order][1:] == h[order][:-1]) & (other[order][1:] == other[order][:-1])
            again = np.zeros(len(at), bool)
            again[order] = same
            doc, start = key[words.doc[at]], (at - words.first[words.doc[at]]).astype(np.int32)
            bucket = np.where(again, doc % buckets, (other % np.uint64(buckets)).astype(np.int64)).astype(np.int32)
            more = (other >> np.uint64(48)).astype(np.uint16)
            out: dict[str, list] = {"bucket": [], "hashes": [], "docs": [], "starts": []}
            for which, hashed in ((~again, True), (again, False)):
                idx = np.flatnonzero(which)
                idx = idx[np.argsort(bucket[idx], kind="stable")]
                for b, run_ in _runs(bucket[idx]):
                    own = idx[run_]
                    out["bucket"].append(b)
                    out["hashes"].append(h[own].tobytes() + more[own].tobytes() if hashed else None)
                    out["docs"].append(_pack(doc[own]))
                    out["starts"].append(_pack(start[own]))
            yield pa.record_batch([pa.array(out["bucket"], pa.int32()), *(pa.array(out[k], pa.binary()) for k in ("hashes", "docs", "starts"))], names=list(out))

    return run


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as the shuffle moves them: as many bytes again as they have travel with the hashes."""
    squeeze = zstandard.ZstdCompressor(3)
    for batch in batches:
        packed = [squeeze.compress(t.as_buffer()) if t.is_valid else None for t in batch.column("text")]
        yield pa.record_batch([batch.column("key"), batch.column("id"), pa.array(packed, pa.binary())], names=["key", "id", "packed"])


def _count_bucket(parts: int):
    def run(group: pa.Table) -> pa.Table:
        packed = group.to_pydict()
        rows = range(group.num_rows)
        own, known = [i for i in rows if packed["hashes"][i] is not None], [i for i in rows if packed["hashes"][i] is None]
        held = [packed["hashes"][i] for i in own]
        h = np.concatenate([np.frombuffer(x, np.uint64, len(x) // 10) for x in held]) if own else np.zeros(0, np.uint64)
        more = np.concatenate([np.frombuffer(x, np.uint16, len(x) // 10, len(x) // 10 * 8) for x in held]) if own else np.zeros(0, np.uint16)
        doc, start = (_unpack([packed[c][i] for i in own], k) for c, k in (("docs", np.int64), ("starts", np.int32)))
        order = np.argsort(h, kind="stable")
        equal = h[order][1:] == h[order][:-1]
        several = np.zeros(len(h), bool)
        several[1:] |= equal
        several[:-1] |= equal
        own = order[several]
        own = own[np.lexsort((start[own], doc[own], more[own], h[own]))]
        later = np.zeros(len(own), bool)
        later[1:] = (h[own][1:] == h[own][:-1]) & (more[own][1:] == more[own][:-1])
        own = own[later]
        doc = np.r_[doc[own], _unpack([packed["docs"][i] for i in known], np.int64)]
        start = np.r_[start[own], _unpack([packed["starts"][i] for i in known], np.int32)]
        part = doc % parts
        order = np.lexsort((start, doc, part))
        doc, start, part = doc[order], start[order], part[order]
        runs = list(_runs(part))
        return pa.table([pa.array([p for p, _ in runs], pa.int32()), pa.array([_pack(doc[s]) for _, s in runs], pa.binary()), pa.array([_pack(start[s]) for _, s in runs], pa.binary())], names=["part", "docs", "starts"])

    return run


def _intervals(start: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals of words, and the mask of the n words, that windows at the starts cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + width, -1)
    mask = np.cumsum(step[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0])).reshape(-1, 2)
    return edge, mask


_RESULT = "id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string"
_RESULT_TYPE = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept_text", pa.string())])


def _cut(width: int):
    def run(texts: pa.Table, marks: pa.Table) -> pa.Table:
        packed = marks.to_pydict()
        doc, start = _unpack(packed["docs"], np.int64), _unpack(packed["starts"], np.int32)
        order = np.argsort(doc, kind="stable")
        doc, start = doc[order], start[order]
        out: dict[str, list] = {k: [] for k in _RESULT_TYPE.names}
        for key, id_, text in zip(texts.column("key").to_pylist(), texts.column("id").to_pylist(), texts.column("packed"), strict=True):
            words = zstandard.decompress(text.as_buffer()).split() if text.is_valid else []
            a, b = np.searchsorted(doc, key), np.searchsorted(doc, key, side="right")
            edge, gone = [], 0
            if b > a:
                spans, mask = _intervals(start[a:b], width, len(words))
                gone = int(mask.sum())
                words_left = compress(words, (~mask).tolist())
                edge = [{"start": int(x), "end": int(y)} for x, y in spans]
            else:
                words_left = words
            for k, v in zip(out, (id_, len(words), gone, edge, b" ".join(words_left)), strict=True):
                out[k].append(v)
        out["kept_text"] = pa.array(out["kept_text"], pa.binary()).cast(pa.string())
        return pa.table([pa.array(out[f.name], f.type) if f.name != "kept_text" else out["kept_text"] for f in _RESULT_TYPE], schema=_RESULT_TYPE)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Remove each word covered by a window of ``width`` words that also starts earlier.

    Returns (id_col, n_words, n_removed, removed, kept_text): the maximal removed word intervals
    and the words left, joined by one space. Earlier means a smaller id, or the same document
    and a smaller start; windows are judged on the input.
    """
    small_batches(docs.sparkSession)
    key = fresh(docs, "_key")
    rows = with_key(docs, id_col, key).select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(128, min(MOST_BUCKETS, size // BUCKET_BYTES))
    parts = max(64, size // BUCKET_BYTES) | 1
    chunk_bytes = chunk_bytes if buckets <= FILLED else max(chunk_bytes, buckets * FILL_BYTES)
    hashed = rows.select("key", "text").mapInArrow(_hash_batches(width, buckets, chunk_bytes), _HASHED)
    marks = hashed.groupBy("bucket").applyInArrow(_count_bucket(parts), _MARKED)
    texts = rows.mapInArrow(_compressed, "key long, id long, packed binary").withColumn("part", F.pmod("key", F.lit(parts)).cast("int"))
    done = texts.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(_cut(width), _RESULT)
    return done.withColumnRenamed("id", id_col)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
