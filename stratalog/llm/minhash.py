"""Operator 6: MinHash near-dedup by a multi-index Hamming join.

Each text gets its set of word shingles (64-bit Rabin-Karp hashes), a 128-bit digest of the set,
and a signature of symbols, the low 16 bits of one MinHash each. Two sets with similarity J differ
in a symbol with probability 1 - J. The least similarity sets the number of symbols and how many
may differ (``signature_size``): at 0.85, over 14 of 32 differ for 2 pairs in 100,000; at 0.80,
over 19 of 40 do.

Equal sets are collapsed first: the rest works on classes. Signatures are cut into chunks of 4
symbols. If less than half of the symbols differ, one chunk has at most one error, so two such
signatures share one of the keys that leave out one symbol of one chunk: no pair under the
threshold is lost. Keys with several classes become cells of at most two blocks of ``BLOCK``
classes; a cell compares signatures in numpy and returns a spanning forest of the pairs under
the threshold, never the pairs. The components of that graph hold every link; within each,
full sets meet in cells of the same kind, which return forests of confirmed links.

So a group of g near copies costs comparisons, and no pair is a row. Each cell holds two blocks,
whatever the group's size, so large groups are spread over many cells; but a class goes to a cell for
each block of its group, so a group's rows are g times g / ``BLOCK`` for each key that it shares.

Edge cases: texts without words or null have an empty set and link with nothing; texts with
fewer words than a shingle have the whole sequence as their only one; rows that repeat an id
count as documents of their own; a null id is never the smallest; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .staging import fresh, partitions, small_batches, staged, with_key
from .words import _sums, mix, slices, split_words, word_hashes

SYMBOLS, CHUNK, MOST_ERRORS = 32, 4, 14  # of signatures for 85 percent and more
#: Longest signature, and the share of pairs at the least similarity that a signature may lose.
MOST_SYMBOLS, LOSS = 128, 2.5e-5
#: Similarity from which on the pipeline's stage drops copies; op6's contract is 85.
STAGE_PERCENT = 80
BLOCK = 256
CHUNK_BYTES = 2 << 20
_SALT = np.random.Generator(np.random.PCG64(606)).integers(0, 2**64, 2 * MOST_SYMBOLS + 2, dtype=np.uint64)


@lru_cache(maxsize=None)
def signature_size(percent: int) -> tuple[int, int]:
    """Symbols of a signature and how many may differ, so that few pairs of that similarity differ in more."""
    p = 1 - percent / 100
    for n in range(SYMBOLS, MOST_SYMBOLS + 1, CHUNK):
        more = 0.0  # the probability that over e symbols differ
        for e in range(n - 1, -1, -1):
            more += comb(n, e + 1) * p ** (e + 1) * (1 - p) ** (n - e - 1)
            if more > LOSS:
                break
        else:
            e = -1
        if e + 1 < n // 2:  # two errors in each chunk are n // 2
            return n, max(e + 1, MOST_ERRORS)
    raise ValueError(f"no signature of {MOST_SYMBOLS} symbols tells pairs of {percent} percent")


def shingle_sets(texts: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after the other, and where each begins."""
    words = split_words(texts, fold=True)
    codes = word_hashes(words)
    total, inverse = _sums(codes, 1)
    count = np.diff(words.first)
    each = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = np.repeat(words.first[:-1] - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum())
    size = np.repeat(np.minimum(count, width), each)
    with np.errstate(over="ignore"):
        h = mix((total[at + size] - total[at]) * inverse[at]) if len(at) else np.zeros(0, np.uint64)
    cut = np.r_[0, np.cumsum(each)]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[cut[:-1][each > 0]] = True
    return h[new], np.r_[0, np.cumsum(new)][cut]


def signatures(h: np.ndarray, cut: np.ndarray, n: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """Of nonempty sets: 128-bit digests, and n 16-bit symbols each."""
    first = cut[:-1]
    digest = np.empty((len(first), 2), np.uint64)
    symbols = np.empty((len(first), n), np.uint16)
    with np.errstate(over="ignore"):
        for k in range(2):
            digest[:, k] = np.add.reduceat(mix(h ^ _SALT[2 * MOST_SYMBOLS + k]), first)
        for k in range(n):
            x = (h ^ _SALT[k]) * (_SALT[MOST_SYMBOLS + k] | np.uint64(1))
            x ^= x >> np.uint64(32)
            symbols[:, k] = mix(np.minimum.reduceat(x, first)) & np.uint64(0xFFFF)
    return digest, symbols


def _sign(width: int, most: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", most):
            h, cut = shingle_sets(batch.column("text"), width)
            size = np.diff(cut)
            full = size > 0
            digest, symbols = signatures(h, np.r_[cut[:-1][full], cut[-1]], n)
            where = np.cumsum(full) - 1
            signs, digests = ([x[i].tobytes() if f else None for i, f in zip(where, full, strict=True)] for x in (symbols, digest))
            yield pa.record_batch([batch.column("key"), batch.column("id"), pa.array(size, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())], names=["key", "id", "n_shingles", "digest", "signature"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cls) for every chunk and every symbol of it left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            part = batch.slice(at, 20_000)
            s = _symbols(part.column("signature")).astype(np.uint64)
            n = s.shape[1]
            keys = np.empty((len(s), n), np.uint64)
            for k in range(n):
                own = [j for j in range(k - k % CHUNK, k - k % CHUNK + CHUNK) if j != k]
                x = np.full(len(s), k, np.uint64)
                for j in own:
                    x = x << np.uint64(16) | s[:, j]  # the key's number and three symbols: 64 bits at most
                keys[:, k] = x
            yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(np.asarray(part.column("cls")), n))], names=["key", "cls"])


def _symbols(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    found = column.to_pylist()
    return np.frombuffer(b"".join(found), dtype=np.uint16).reshape(len(found), -1)


class Forest:
    """Union-find whose roots are the least members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))], dtype=np.int64)


def cells(members: DataFrame, group: str, count: str, block: int) -> DataFrame:
    """Each row once for every cell (group, i, j) of two of the group's blocks, i <= j, that it is in.

    A group of up to ``block`` rows is one cell. ``own`` tells in which of the two blocks the row is.
    """
    blocks = F.ceil(F.col(count) / block).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    rows = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")
    return rows.repartition(partitions(members.sparkSession), group, "i", "j").sortWithinPartitions(group, "i", "j", "cls")


def grouped(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows that agree on the named columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(n)) for n in names]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *cut.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _forest_batch(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _edges(cls: np.ndarray, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    root = forest.roots()
    child = np.flatnonzero(root != np.arange(len(root)))
    return cls[child], cls[root[child]]


def _near_cells(most_errors: int):
    """Forests of the pairs whose signatures differ in at most so many symbols.

    A pair that shares several keys counts in the first of them only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = [], 0
        for cell in grouped(batches, ("key", "i", "j")):
            s, cls, own = _symbols(cell.column("signature")), cell.column("cls").to_numpy(), cell.column("own").to_numpy()
            same_block = cell.column("i")[0].as_py() == cell.column("j")[0].as_py()
            number = (cell.column("key")[0].as_py() >> 48) & 0xFFFF
            chunk = number // CHUNK
            forest = Forest(len(cls))
            for x in range(len(cls) - 1):
                equal = np.count_nonzero((s[x + 1 :] == s[x]).reshape(-1, s.shape[1] // CHUNK, CHUNK), axis=2)
                fit = equal.sum(axis=1) >= s.shape[1] - most_errors
                fit &= (equal[:, :chunk] < CHUNK - 1).all(axis=1) & ((equal[:, chunk] == CHUNK - 1) | (number % CHUNK == 0))
                if not same_block:
                    fit &= own[x + 1 :] != own[x]
                for k in (x + 1 + np.flatnonzero(fit)).tolist():
                    forest.join(x, k)
            out.append(_edges(cls, forest))
            rows += len(out[-1][0])
            if rows > 50_000:
                yield _forest_batch(out)
                out, rows = [], 0
        yield _forest_batch(out)

    return run


def _set_rows(width: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", most):
            h, cut = shingle_sets(batch.column("text"), width)
            sets = [h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch([batch.column("cls"), batch.column("group"), batch.column("count"), batch.column("signature"), pa.array(sets, pa.binary())], names=["cls", "group", "count", "signature", "shingles"])

    return run


class Overlaps:
    """Intersection sizes of one set with many: bit sets over the cell's shingles, or merges if those are large."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.bits = sets, None
        ids, at = np.unique(np.concatenate(sets), return_inverse=True)
        words = -(-len(ids) // 64)
        if words * 8 * len(sets) <= 24 << 20:
            bits = np.zeros((len(sets), words), np.uint64)
            doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            np.bitwise_or.at(bits, (doc, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
            self.bits = bits

    def of(self, x: int, ys: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return np.bitwise_count(self.bits[ys] & self.bits[x]).sum(axis=1, dtype=np.int64)
        return np.array([len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True)) for y in ys], dtype=np.int64)


def _confirm_cells(percent: int, most_errors: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for cell in grouped(batches, ("group", "i", "j")):
            cls, own = cell.column("cls").to_numpy(), cell.column("own").to_numpy()
            same_block = cell.column("i")[0].as_py() == cell.column("j")[0].as_py()
            s = _symbols(cell.column("signature"))
            sets = [np.frombuffer(x, dtype=np.uint64) for x in cell.column("shingles").to_pylist()]
            size = np.array([len(x) for x in sets], dtype=np.int64)
            overlaps, forest = Overlaps(sets), Forest(len(cls))
            for x in range(len(cls) - 1):
                y = np.arange(x + 1, len(cls))
                fit = 100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x])
                fit &= np.count_nonzero(s[y] != s[x], axis=1) <= most_errors
                if not same_block:
                    fit &= own[y] != own[x]
                y = y[fit]
                for at in range(0, len(y), 32):  # links found so far spare the comparisons they imply
                    root = forest.root(x)
                    part = np.array([k for k in y[at : at + 32].tolist() if forest.root(k) != root], dtype=np.int64)
                    if len(part):
                        common = overlaps.of(x, part)
                        for k in part[100 * common >= percent * (size[part] + size[x] - common)].tolist():
                            forest.join(x, k)
            out.append(_edges(cls, forest))
        yield _forest_batch(out)

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, key_col: str | None = None) -> DataFrame:
    """Per row (id_col, n_shingles, component_id, kept); with ``key_col``, that column of docs as well,
    and ``root``, which tells components apart where ids are null or repeat.

    Links join rows whose shingle sets have 100 * intersection >= percent * union; component_id is
    the least id reachable. Signatures grow as ``percent`` falls; below what MOST_SYMBOLS serve
    (about 70) it is refused.
    """
    n, most_errors = signature_size(percent)
    small_batches(docs.sparkSession)
    key = key_col or fresh(docs, "_key")
    keyed = docs if key_col else with_key(docs, id_col, key)
    rows = keyed.select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = staged(rows.mapInArrow(_sign(width, CHUNK_BYTES, n), "key long, id long, n_shingles long, digest binary, signature binary"), "signed")
    classes = staged(signed.filter("n_shingles > 0").groupBy("n_shingles", "digest").agg(F.min("key").alias("cls"), F.min_by("id", "key").alias("least"), F.first("signature").alias("signature")), "classes")

    keys = staged(classes.select("cls", "signature").mapInArrow(_keys, "key long, cls long"), "keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("count")).filter("count > 1")
    members = keys.join(shared, "key").join(classes.select("cls", "signature"), "cls")
    near = cells(members, "key", "count", BLOCK).select("key", "i", "j", "own", "cls", "signature").mapInArrow(_near_cells(most_errors), "a long, b long")
    groups = staged(components(near, "near"), "groups")

    counts = groups.groupBy("root").agg(F.count("*").alias("count"))
    members = groups.join(counts, "root").select(F.col("node").alias("cls"), F.col("root").alias("group"), "count").join(classes.select("cls", "signature"), "cls")
    texts = rows.select(F.col("key").alias("cls"), "text").join(members, "cls")
    sets = texts.select("cls", "group", "count", "signature", "text").mapInArrow(_set_rows(width, CHUNK_BYTES), "cls long, group long, count long, signature binary, shingles binary")
    linked = cells(sets, "group", "count", BLOCK // 2).select("group", "i", "j", "own", "cls", "signature", "shingles").mapInArrow(_confirm_cells(percent, most_errors), "a long, b long")
    roots = components(linked, "links")

    placed = classes.join(roots, classes["cls"] == roots["node"], "left").select("n_shingles", "digest", F.coalesce("root", "cls").alias("root"))
    # keys ascend with ids, so a component's least class holds its least id
    named = staged(placed.join(classes.select(F.col("cls").alias("root"), F.col("least").alias("component_id")), "root"), "named")
    done = signed.join(named, ["n_shingles", "digest"], "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")))
    result = done.select(F.col("id").alias(id_col), *([F.col("key").alias(key_col), "root"] if key_col else []), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    return result


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the least id's, of several such the least row."""
    key = fresh(docs, "_key")
    keyed = with_key(docs, id_col, key)
    found = near_duplicates(keyed, id_col, text_col, key_col=key, **options)
    # a component's root is its row of the least key, so of the least id
    stays = found.filter((F.col(key) == F.col("root")) | (F.col("n_shingles") == 0)).select(key)
    return keyed.join(stays, key, "left_semi").select(*docs.columns)


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with one row of each component from similarity ``STAGE_PERCENT``: the least id's.

    Rows with null or empty text link with nothing and stay; rows that share an id, or have none,
    are rows of their own, of which equal ones link; other columns stay as they are, whatever
    their names; an empty table stays empty.
    """
    return drop_near_duplicates(docs, percent=STAGE_PERCENT)
