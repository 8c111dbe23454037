"""Operator 5: exact top-k search by integer inner product over a bit-sliced index.

Vectors become integers floor(scale * x). The index cuts the rows into blocks; a block stores each
attribute as bit slices, one bitmap over its rows for each binary digit, and is written once in that
form. A query's product is a sum of slices shifted by the digits of its weights (complemented
slices where a weight is negative), added up with bitmap arithmetic (carry-save adders, 64 rows a
word). The k best rows are then read off from the most significant slice downward; rows that tie
at the boundary are resolved by id. Each block returns its k best for each query, Spark ranks
those.

Scale: blocks of the index meet runs of at most ``RUN`` query blocks, one after the other. So the
index travels once for each run and the queries once for each index block, all cells are of one
size, and a task holds one index block and one query block. Rows of the result are at most k for each query
and index block. Vectors with components of 24 bits and more get blocks of their own, which need
more slices.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part;
finite ones do, whatever their size: slices follow the largest, sums are exact. A score that a long
cannot hold is null, but ranked where it belongs. Vectors meet only vectors of their length; rows
that share an id are rows of their own, as queries and as candidates; a row with null id is a
candidate, after all ids of its score, and no query; fewer than k candidates give fewer rows; ties
go to the smaller id; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import fresh, partitions, staged, with_key

ROW_BLOCK, QUERY_BLOCK, RUN = 4096, 512, 8
WIDE = 2.0**24


def integers(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), as Python's integers where 64 bits could not hold them or their differences."""
    with np.errstate(over="ignore"):
        f = np.floor(x * scale)
    if not f.size or np.abs(f).max() < 2.0**62:
        return f.astype(np.int64)
    exact = [int(n) if np.isfinite(n) else int(Fraction(v) * Fraction(scale) // 1) for n, v in zip(f.ravel().tolist(), x.ravel().tolist(), strict=True)]
    return np.array(exact, dtype=object).reshape(x.shape)


class BitSlices:
    """Rows of integers, attribute by attribute, as one bitmap for each binary digit above the attribute's least value."""

    def __init__(self, n: int, least: list[int], bits: list[int], flat: np.ndarray):
        self.least, self.bits = least, bits
        self.at = np.r_[0, np.cumsum(bits)].tolist()
        self.slices = np.concatenate([flat, ~flat])  # a slice's complement stands as many slices further on as there are
        self.valid = np.packbits(np.arange(flat.shape[1] * 64) < n, bitorder="little").view(np.uint64)

    @staticmethod
    def cut(rows: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
        """Least value and digits of each attribute, and their bitmaps."""
        least = [int(x) for x in rows.min(axis=0)]
        bits = [(int(x) - low).bit_length() for x, low in zip(rows.max(axis=0), least, strict=True)]
        words = -(-len(rows) // 64)
        flat = np.zeros((sum(bits), words * 8), np.uint8)
        at = 0
        for d, n in enumerate(bits):
            shifted = rows[:, d] - least[d]
            for j in range(n):
                packed = np.packbits((shifted >> j & 1).astype(np.uint8), bitorder="little")
                flat[at + j, : len(packed)] = packed
            at += n
        return least, bits, flat.view(np.uint64)

    def products(self, query: list[int]) -> tuple[list[np.ndarray], int]:
        """Slices of a nonnegative number for each row, and what to add to it for the inner product."""
        add, by_weight, all_ = 0, {}, self.at[-1]
        for q, low, n, base in zip(query, self.least, self.bits, self.at, strict=False):
            add += low * q
            if q < 0:
                add += q * ((1 << n) - 1)
                q, base = -q, base + all_
            for i in range(q.bit_length()):
                if q >> i & 1:
                    for j in range(n):
                        by_weight.setdefault(i + j, []).append(base + j)
        out, carried, weight, most = [], [], 0, max(by_weight, default=-1)
        while carried or weight <= most:
            stack = self.slices[by_weight.get(weight, [])]
            if carried:
                stack = np.concatenate([stack, *carried])
            carried = []
            while len(stack) >= 3:
                third = len(stack) // 3
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                half = a ^ b
                carried.append((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[3 * third :]])
            if len(stack) == 2:
                carried.append((stack[:1] & stack[1:]))
                stack = stack[:1] ^ stack[1:]
            out.append(stack[0] if len(stack) else np.zeros_like(self.valid))
            weight += 1
        return out, add

    def best(self, slices: list[np.ndarray], k: int, allowed: np.ndarray) -> np.ndarray:
        """Rows of the k largest numbers; of rows that tie at the boundary the first."""
        sure, tied = np.zeros_like(allowed), allowed
        for s in reversed(slices):
            high = tied & s
            found = int(np.bitwise_count(sure | high).sum())
            if found > k:
                tied = high
                continue
            sure, tied = sure | high, tied & ~s
            if found == k:
                return _members(sure)
        rest = _members(tied)[: k - int(np.bitwise_count(sure).sum())]
        return np.sort(np.r_[_members(sure), rest])


def _members(bitmap: np.ndarray) -> np.ndarray:
    word = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return word[row] * 64 + bit


def search_block(index: BitSlices, keys: np.ndarray, query_keys: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """Of each query its key, and places and scores of its k best rows, its own row aside; keys of the block ascend."""
    for name, query in zip(query_keys.tolist(), queries.tolist(), strict=True):
        slices, add = index.products(query)
        allowed = index.valid
        at = int(np.searchsorted(keys, name))
        if at < len(keys) and keys[at] == name:
            allowed = allowed.copy()
            allowed[at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
        best = index.best(slices, k, allowed)
        small = len(slices) < 62 and abs(add) < 1 << 61
        total = np.full(len(best), add, np.int64 if small else object)
        for w, s in enumerate(slices):
            bit = (s[best >> 6] >> (best & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            total += (bit if small else bit.astype(object)) << w
        yield name, best, total.tolist()


_BLOCK = "dim int, block int, n int, named int, keys binary, ids binary, least array<string>, bits array<int>, slices binary, vectors binary"


def _matrix(group: pa.Table, dim: int) -> np.ndarray:
    return group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _pack(scale: float, sliced: bool):
    """One block in order of keys: its slices, or the vectors as they are."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        dim, block = (group.column(c)[0].as_py() for c in ("dim", "block"))
        x = _matrix(group, dim)
        keys, ids = (np.asarray(group.column(c).fill_null(0)).astype("<i8").tobytes() for c in ("key", "id"))
        least, bits, flat = BitSlices.cut(integers(x, scale)) if sliced else ([], [], np.zeros(0, np.uint64))
        named = len(x) - group.column("id").null_count  # rows without id come last
        values = (dim, block, len(x), named, keys, ids, [str(n) for n in least], bits, flat.tobytes(), b"" if sliced else x.tobytes())
        types = (*[pa.int32()] * 4, pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        return pa.table([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["dim", "block", "n", "named", "keys", "ids", "least", "bits", "slices", "vectors"])

    return run


_FOUND = "query long, query_id long, key long, vec_id long, over int, score long, exact binary"
_TOP = 1 << 2400  # above any sum of products of doubles


def _search(k: int, scale: float):
    """Cells of rows that start with an index block and go on with query blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("dim", "n", "slices", "vectors")}
                own_keys, own_ids = (np.frombuffer(batch.column(c)[i].as_buffer(), "<i8") for c in ("keys", "ids"))
                if batch.column("role")[i].as_py() == 0:
                    bits = batch.column("bits")[i].as_py()
                    flat = np.frombuffer(row["slices"].as_buffer(), np.uint64).reshape(sum(bits), -(-row["n"].as_py() // 64))
                    index = BitSlices(row["n"].as_py(), [int(x) for x in batch.column("least")[i].as_py()], bits, flat)
                    keys, ids, named = own_keys, own_ids, batch.column("named")[i].as_py()
                    continue
                queries = integers(np.frombuffer(row["vectors"].as_buffer(), "<f8").reshape(-1, row["dim"].as_py()), scale)
                out: list[tuple] = []
                name = dict(zip(own_keys.tolist(), own_ids.tolist(), strict=True))
                for q, best, scores in search_block(index, keys, own_keys, queries, k):
                    for at, score in zip(best.tolist(), scores, strict=True):
                        over = (score >= 1 << 63) - (score < -(1 << 63))
                        out.append((q, name[q], int(keys[at]), int(ids[at]) if at < named else None, over, None if over else score, (score + _TOP).to_bytes(304, "big") if over else None))
                types = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names=["query", "query_id", "key", "vec_id", "over", "score", "exact"])

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(key, id, v, dim, wide) of the vectors that take part."""
    key = fresh(vectors, "_key")
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = with_key(vectors, id_col, key).filter(v.isNotNull() & (F.size(v) > 0) & finite)
    rows = rows.select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    return rows.withColumn("dim", F.size("v")).withColumn("wide", F.exists("v", lambda x: F.abs(x * scale) >= WIDE).cast("int"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k largest inner products: (query_id, rank, vec_id, score). ``is_query`` reads the column ``id``."""
    width = partitions(vectors.sparkSession)
    rows = staged(usable(vectors, id_col, vector_col, scale).withColumn("asks", F.coalesce(is_query, F.lit(False))), "vectors")
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    sizes = rows.groupBy("dim").agg(blocks(F.sum(1 - F.col("wide")), ROW_BLOCK).alias("narrow_blocks"), blocks(F.sum("wide"), ROW_BLOCK).alias("wide_blocks"), blocks(F.count_if("asks"), QUERY_BLOCK).alias("query_blocks"))
    sizes = staged(sizes.filter("query_blocks > 0"), "sizes")  # a row for each length
    placed = rows.join(sizes, "dim")
    lot = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    own = F.when(F.col("wide") == 1, F.col("narrow_blocks") + lot(F.col("wide_blocks"))).otherwise(lot(F.col("narrow_blocks")))
    index = placed.select("dim", own.alias("block"), "key", "id", "v").groupBy("dim", "block").applyInArrow(_pack(scale, True), _BLOCK)
    index = staged(index, "index")
    queries = placed.filter("asks").select("dim", lot(F.col("query_blocks")).alias("block"), "key", "id", "v").groupBy("dim", "block").applyInArrow(_pack(scale, False), _BLOCK)
    queries = staged(queries, "queries")

    run = F.floor(F.col("block") / RUN).cast("int")
    a = index.join(sizes, "dim").withColumn("role", F.lit(0)).withColumn("part", F.lit(0)).withColumn("run", F.explode(F.sequence(F.lit(0), blocks(F.col("query_blocks"), RUN) - 1)))
    b = queries.join(sizes, "dim").withColumn("role", F.lit(1)).withColumn("part", F.col("block")).withColumn("run", run)
    b = b.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("narrow_blocks") + F.col("wide_blocks") - 1)))
    cells = a.unionByName(b).repartition(width, "dim", "block", "run").sortWithinPartitions("dim", "block", "run", "role", "part")
    found = cells.mapInArrow(_search(k, scale), _FOUND)
    order = Window.partitionBy("query").orderBy(F.col("over").desc(), F.col("score").desc(), F.col("exact").desc(), "key")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def op5_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)


#: The same ranking by plain SQL.
ORACLE = """
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS k, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.k AS query, b.k AS k, a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.k <> b.k AND len(a.q) = len(b.q))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, k) AS INT) AS rank, vec_id, TRY_CAST(score AS BIGINT) AS score FROM s
QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, k) <= 20
"""
