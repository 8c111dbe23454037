"""Operator 12: codes of vectors by product quantisation, fitted by Heap Lloyd in whole numbers.

Components become floor(256 * x), vectors are cut into ``PARTS`` parts, and each part position has a
codebook of at most ``ENTRIES`` entries that starts as the parts of the smallest ids. A round assigns
each part to its nearest entry and replaces each entry by its parts' mean, rounded down.

Only the first assignment compares every part with every entry. It leaves, in each chunk of vectors,
a heap for each entry with its parts, keyed by slack: lower bound (distance to the second nearest
entry) minus upper bound (distance to the own one). When entries move, the drift of an entry and the
farthest drift of any other add up; a part whose key the sum has not reached cannot have changed its
entry. Parts beyond it are popped, compared with all entries exactly, and pushed with a new key. Keys
count from the sum at their push and are rounded down, so rounding never hides a change.

Chunks with their heaps are tables in the shared folder, one for each round; a round's folder goes
when the next is written. Sums of parts are added up in the task, then by Spark for each component;
the driver holds codebooks only, ``ENTRIES`` rows of a vector's length.

Edge cases: vectors that are null or hold null or non-finite components are dropped; each vector
length has codebooks of its own; a length that ``PARTS`` does not divide is cut at floor(i * length /
PARTS), so that some parts may be empty; rows that repeat an id count each, by their vectors' order; null ids come
last; numbers beyond a long are held at its ends, and an error beyond it is null; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import new_path, removed, small_batches, staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of a chunk of vectors.
CHUNK = 1 << 18
#: Sums of this many whole numbers are exact in double precision and in a long.
_DOUBLE, _LONG = 1 << 53, 1 << 62

Heap = list[tuple[float, int]]


def cuts(dim: int) -> list[slice]:
    return [slice(i * dim // PARTS, (i + 1) * dim // PARTS) for i in range(PARTS)]


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact: in doubles, longs or Python's numbers, as their size demands."""
    most = max([abs(int(e)) for a in (x, book) if a.size for e in (a.min(), a.max())], default=0)
    bound = 4 * most * most * max(1, x.shape[1])
    if bound < _DOUBLE:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T).astype(np.int64)
    a, b = (m.astype(np.int64 if bound < _LONG else object) for m in (x, book))
    return np.stack([((a - e) ** 2).sum(axis=1) for e in b], axis=1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row, ties to the lower index, and the slack up to the second nearest."""
    d = distances(x, book)
    best = d.argmin(axis=1)
    if d.shape[1] == 1:
        return best, np.full(len(x), np.inf)
    two = np.sqrt(np.sort(d, axis=1)[:, :2].astype(np.float64))
    return best, two[:, 1] - two[:, 0] - 1e-9 * two.sum(axis=1)


@dataclass
class Codebooks:
    """Of one vector length: entries by part, and the drift that each has summed up."""

    entries: list[np.ndarray]
    drift: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.drift = self.drift or [np.zeros(len(e)) for e in self.entries]

    def moved(self, sums: list[np.ndarray], counts: list[np.ndarray]) -> Codebooks:
        """Entries as the means of their parts, rounded down; those without parts stay."""
        entries, drift = [], []
        for book, total, n, before in zip(self.entries, sums, counts, self.drift, strict=True):
            new = np.array([[int(s) // int(k) for s in row] if k else list(old) for old, row, k in zip(book, total, n, strict=True)], dtype=np.int64).reshape(book.shape)
            far = np.sqrt(((new.astype(object) - book.astype(object)) ** 2).sum(axis=1).astype(np.float64)) * (1 + 1e-9) if book.size else np.zeros(len(book))
            others = np.array([np.delete(far, e).max(initial=0) for e in range(len(far))])
            entries.append(new)
            drift.append(before + far + others)
        return Codebooks(entries, drift)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(c)) for book in self.entries for c in book.reshape(-1)).encode()).hexdigest()


class Chunk:
    """Vectors of one length, and for each part and entry the heap of (key, row) of its parts."""

    def __init__(self, x: np.ndarray, heaps: list[list[Heap]]):
        self.x, self.heaps, self.scanned = x, heaps, 0

    @classmethod
    def first(cls, x: np.ndarray, books: Codebooks) -> Chunk:
        """Every part compared with every entry."""
        own = cls(x, [])
        for cut, book in zip(cuts(x.shape[1]), books.entries, strict=True):
            best, slack = nearest(x[:, cut], book)
            key = _down(slack).tolist()
            heaps: list[Heap] = [[] for _ in book]
            for row, (e, k) in enumerate(zip(best.tolist(), key, strict=True)):
                heaps[e].append((k, row))
            for h in heaps:
                heapify(h)
            own.heaps.append(heaps)
        own.scanned = len(x) * PARTS
        return own

    def follow(self, books: Codebooks) -> None:
        """Pop the parts whose key the drift has reached, and rescan them."""
        for cut, book, drift, heaps in zip(cuts(self.x.shape[1]), books.entries, books.drift, self.heaps, strict=True):
            rows = []
            for heap, far in zip(heaps, drift.tolist(), strict=True):
                while heap and heap[0][0] <= far:
                    rows.append(heappop(heap)[1])
            if rows:
                best, slack = nearest(self.x[rows, cut], book)
                for row, e, key in zip(rows, best.tolist(), _down(slack + drift[best]).tolist(), strict=True):
                    heappush(heaps[e], (key, row))
            self.scanned += len(rows)

    def codes(self) -> np.ndarray:
        """Entry of each part of each vector."""
        out = np.zeros((len(self.x), PARTS), np.int64)
        for p, heaps in enumerate(self.heaps):
            for e, heap in enumerate(heaps):
                out[[row for _, row in heap], p] = e
        return out

    def sums(self, entries: int) -> np.ndarray:
        """Of each part and entry the sum of its parts, end to end, then their counts, then the number of parts scanned."""
        code, wide = self.codes(), self.x.size and max(abs(int(self.x.min())), abs(int(self.x.max()))) > 1 << 40
        x = self.x.astype(object) if wide else self.x
        out = []
        for p, cut in enumerate(cuts(x.shape[1])):
            total = np.zeros((entries, cut.stop - cut.start), x.dtype)
            np.add.at(total, code[:, p], x[:, cut])
            out.append(total.reshape(-1))
        counts = [np.bincount(code[:, p], minlength=entries) for p in range(PARTS)]
        return np.concatenate([*out, *counts, [self.scanned]])

    def errors(self, books: Codebooks) -> list[int | None]:
        """Squared distances to the own entries, summed over parts."""
        code, out = self.codes(), np.zeros(len(self.x), object)
        most = max((abs(int(e)) for a in (self.x, *books.entries) if a.size for e in (a.min(), a.max())), default=0)
        kind = np.int64 if 4 * most * most * max(1, self.x.shape[1]) < _LONG else object
        for p, (cut, book) in enumerate(zip(cuts(self.x.shape[1]), books.entries, strict=True)):
            out = out + ((self.x[:, cut].astype(kind) - book[code[:, p]].astype(kind)) ** 2).sum(axis=1)
        return [int(e) if e < 1 << 63 else None for e in out]


def _down(key: np.ndarray) -> np.ndarray:
    """The key as a float of 32 bits that is not above it."""
    with np.errstate(over="ignore"):
        return np.nextafter(key.astype(np.float32), np.float32(-np.inf))


def _packed(chunk: Chunk) -> tuple[bytes, str, bytes, bytes, bytes]:
    """Vectors in the least width that holds them, and the heaps, each in its own order."""
    low, high = (int(chunk.x.min()), int(chunk.x.max())) if chunk.x.size else (0, 0)
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    held = [h for heaps in chunk.heaps for h in heaps]
    size = np.array([len(h) for h in held], "<u4")
    keys, rows = (np.fromiter((x[i] for h in held for x in h), t, size.sum()) for i, t in ((0, "<f4"), (1, "<u4")))
    return chunk.x.astype(kind).tobytes(), kind, keys.tobytes(), rows.tobytes(), size.tobytes()


def _unpacked(dim: int, n: int, x: bytes, kind: str, keys: bytes, rows: bytes, size: bytes) -> Chunk:
    sizes = np.frombuffer(size, "<u4")
    flat, heaps, at = list(zip(np.frombuffer(keys, "<f4").tolist(), np.frombuffer(rows, "<u4").tolist(), strict=True)), [], 0
    for n_entries in sizes.tolist():
        heaps.append(flat[at : at + n_entries])
        at += n_entries
    k = len(heaps) // PARTS
    return Chunk(np.frombuffer(x, kind).astype(np.int64).reshape(n, dim), [heaps[p * k : (p + 1) * k] for p in range(PARTS)])


_STATE = "dim int, ids array<long>, labels array<{label}>, x binary, kind string, keys binary, places binary, sizes binary, sums array<decimal(38,0)>"
_NAMES = ["dim", "ids", "labels", "x", "kind", "keys", "places", "sizes", "sums"]
_NUMBERS = pa.list_(pa.decimal128(38, 0))


def _row(dim: int, ids: pa.Array, labels: pa.Array, chunk: Chunk) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (ids, labels)]
    x, kind, keys, rows, size = _packed(chunk)
    return pa.record_batch([pa.array([dim], pa.int32()), *lists, pa.array([x]), pa.array([kind]), pa.array([keys]), pa.array([rows]), pa.array([size]), pa.array([None], _NUMBERS)], names=_NAMES)


def _totals(sums: dict[int, np.ndarray], label: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A row for each vector length that the task has met."""
    for dim, own in sums.items():
        none = [pa.nulls(1, t) for t in (pa.list_(pa.int64()), pa.list_(label), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.binary())]
        yield pa.record_batch([pa.array([dim], pa.int32()), *none, pa.array([[int(s) for s in own]], _NUMBERS)], names=_NAMES)


def _first(books: dict[int, Codebooks]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        label = None
        for batch in batches:
            label, size = batch.column("label").type, np.asarray(batch.column("v").value_lengths())
            for dim in np.unique(size).tolist():
                own = batch.filter(pa.array(size == dim))
                step = max(1, CHUNK // max(1, dim))
                for at in range(0, own.num_rows, step):
                    part = own.slice(at, step)
                    x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, dim)
                    chunk = Chunk.first(x, books[dim])
                    sums[dim] = sums.get(dim, 0) + chunk.sums(len(books[dim].entries[0])).astype(object)
                    yield _row(dim, part.column("id"), part.column("label"), chunk)
        yield from _totals(sums, label)

    return run


def _chunks(batches: Iterator[pa.RecordBatch], books: dict[int, Codebooks]) -> Iterator[tuple[int, pa.Array, pa.Array, Chunk]]:
    """Chunks of a round's table, with what the moved entries change."""
    for batch in batches:
        for i in range(batch.num_rows):
            dim, x, kind, keys, places, sizes = (batch.column(c)[i].as_py() for c in ("dim", "x", "kind", "keys", "places", "sizes"))
            ids, labels = (batch.column(c)[i].values for c in ("ids", "labels"))
            chunk = _unpacked(dim, len(ids), x, kind, keys, places, sizes)
            chunk.follow(books[dim])
            yield dim, ids, labels, chunk


def _next(books: dict[int, Codebooks]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        label = None
        for dim, ids, labels, chunk in _chunks(batches, books):
            label = labels.type
            sums[dim] = sums.get(dim, 0) + chunk.sums(len(books[dim].entries[0])).astype(object)
            yield _row(dim, ids, labels, chunk)
        yield from _totals(sums, label)

    return run


def _last(books: dict[int, Codebooks]):
    digest = {d: b.digest() for d, b in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, ids, labels, chunk in _chunks(batches, books):
            raw, n = chunk.codes().astype(np.uint8).tobytes(), len(ids)
            codes = [raw[i : i + PARTS].hex() for i in range(0, n * PARTS, PARTS)]
            yield pa.record_batch([ids, labels, pa.array(codes, pa.string()), pa.array(chunk.errors(books[dim]), pa.int64()), pa.array([digest[dim]] * n)], names=["id", "label", "code", "error", "codebooks_sha256"])

    return run


def _begin(rows: DataFrame, dim: int) -> Codebooks:
    """Codebooks of the parts of the smallest ids; only ids are ordered at first, then the few rows up to the last of them."""
    own = rows.filter(F.size("v") == dim)
    last = own.select("id").orderBy(F.col("id").asc_nulls_last()).limit(ENTRIES).agg(F.max("id").alias("id"), F.count("*").alias("n"), F.count("id").alias("known")).first()
    few = own if last.known < last.n else own.filter(F.col("id") <= last.id)  # fewer ids than entries: nulls are needed too
    smallest = few.groupBy("id", "v").count().orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    vectors = [r.v for r in smallest for _ in range(min(r["count"], ENTRIES))][:ENTRIES]
    return Codebooks([np.array([v[cut] for v in vectors], dtype=np.int64).reshape(len(vectors), cut.stop - cut.start) for cut in cuts(dim)])


def _moved(state: DataFrame, books: dict[int, Codebooks]) -> tuple[dict[int, Codebooks], int]:
    """The codebooks after a round, and how many parts it has compared with all entries."""
    told = state.filter("sums is not null").select("dim", F.posexplode("sums").alias("at", "s")).groupBy("dim", "at").agg(F.sum("s").alias("s"))
    sums: dict[int, dict[int, int]] = {}
    for r in told.collect():  # a row for each component of the codebooks
        sums.setdefault(r.dim, {})[r["at"]] = int(r.s)
    out, scanned = {}, 0
    for dim, book in books.items():
        flat = np.array([sums[dim][i] for i in range(len(sums[dim]))], dtype=object)
        k, at = len(book.entries[0]), 0
        totals = []
        for cut in cuts(dim):
            width = cut.stop - cut.start
            totals.append(flat[at : at + k * width].reshape(k, width))
            at += k * width
        out[dim] = book.moved(totals, list(flat[at : at + PARTS * k].reshape(PARTS, k)))
        scanned += int(flat[-1])
    return out, scanned


def encode_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", told: list[int] | None = None) -> DataFrame:
    """Per kept row (id_col, label, code, error, codebooks_sha256), as a table; ``told`` takes the parts scanned by each round but the last."""
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col(f"`{vector_col}`")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), v.alias("v")).filter(F.col("v").isNotNull() & whole)
    # beyond a long the numbers stay at its ends
    number = lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(9.2e18)), F.lit(-9.2e18))).cast("long")
    rows = rows.withColumn("v", F.transform("v", number))
    lengths = [r.dim for r in rows.select(F.size("v").alias("dim")).distinct().collect()]  # lengths, not vectors
    books = {dim: _begin(rows, dim) for dim in lengths}
    schema = _STATE.format(label=vectors.schema[label_col].dataType.simpleString())

    def written(df: DataFrame, label: str) -> tuple[str, DataFrame]:
        path = new_path(spark, label)
        df.write.parquet(path)
        return path, spark.read.schema(df.schema).parquet(path)

    path, state = written(rows.select("id", "label", "v").mapInArrow(_first(books), schema), "codes-0")
    for n in range(ROUNDS):
        books, scanned = _moved(state, books)
        if told is not None:
            told.append(scanned)
        chunks = state.filter("sums is null")
        if n < ROUNDS - 1:
            before, (path, state) = path, written(chunks.mapInArrow(_next(books), schema), f"codes-{n + 1}")
            removed(spark, before)
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", vectors.schema[label_col].dataType), *(T.StructField(c, t) for c, t in (("code", T.StringType()), ("error", T.LongType()), ("codebooks_sha256", T.StringType())))])
    done = staged(chunks.mapInArrow(_last(books), kind), "codes")
    removed(spark, path)
    return done.withColumnRenamed("id", id_col)


def op12_codes(spark, sf_dir: str) -> DataFrame:
    coded = encode_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    labels = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _assigned(n: int) -> str:
    return f"""a{n} AS (SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT vec_id, v.p, e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts v JOIN b{n} b USING (p)) GROUP BY 1, 2)"""


def _averaged(n: int) -> str:
    return f"""s{n} AS (SELECT p, e, i, sum(x) AS s, count(*) AS c FROM (SELECT p, e, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM parts JOIN a{n} USING (vec_id, p)) GROUP BY 1, 2, 3),
m{n} AS (SELECT p, e, list(CAST((s - (((s % c) + c) % c)) // c AS BIGINT) ORDER BY i) AS x FROM s{n} GROUP BY 1, 2),
b{n + 1} AS (SELECT p, e, coalesce(m{n}.x, b{n}.x) AS x FROM b{n} LEFT JOIN m{n} USING (p, e))"""


#: The same by plain SQL, for vectors of one length with ids of their own: every part against every entry.
ORACLE = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, q[p * (len(q) // {PARTS}) + 1 : (p + 1) * (len(q) // {PARTS})] AS x FROM v, range({PARTS}) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES})),
{", ".join(f"{_assigned(n)}, {_averaged(n)}" for n in range(ROUNDS))}, {_assigned(ROUNDS)},
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY 1),
digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM b{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN v USING (vec_id), digest
"""
