"""Operator 10: embedding near-dedup over an inverted multi-index.

Unit vectors are cut in halves, each half has its codebook (k-means on about ``SAMPLE_ROWS``
distinct vectors of a length, chosen by hash), and the product of both codebooks is a grid of
cells. The codebooks grow with the vectors (``cells_for``), so a cell's share does not. Every vector
is indexed in its nearest cell, within its label. A vector searches its label's cells by
multi-sequence traversal: both halves' distances sorted, cells visited in order of their sum up to
a margin beyond the nearest. The margin is where ``recall`` of partners are found: partners that
noise has moved to exactly the threshold from sampled vectors held out of the codebooks, and the
links among those vectors themselves. Most links are closer, so the measured recall is higher.
Links are then verified by cosine in double precision.

Lengths with few distinct vectors (under ``EXACT``) have a single cell, so all their pairs of a
label are compared.

Equal vectors of a label are one class, which links count by its size. Of two classes the lesser
searches and the greater is found, so each link counts once. Classes meet in tasks of one cell
and at most two blocks of ``BLOCK`` classes; a task returns counts of links and a spanning forest,
never the pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
with null label, link with nothing; lengths that differ never link; labels of any type are
compared as they are; rows that repeat an id count as rows of their own; a null id is never the
smallest; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .minhash import grouped
from .staging import fresh, partitions, staged, with_key

#: Distinct vectors of a length that codebooks are fitted on, about; below EXACT there is one cell.
SAMPLE_ROWS, EXACT = 4096, 2048
#: Vectors to a cell of the grid, and the most centroids of a half.
PER_CELL, MOST_CENTROIDS = 64, 256
BLOCK = 1024


def cells_for(n: int) -> int:
    """Centroids of each half for n distinct vectors: never over an eighth of the sample."""
    return 1 if n < EXACT else max(2, min(MOST_CENTROIDS, isqrt(n // PER_CELL)))


def _unit(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2 * x @ centroids.T, 0)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    if not x.shape[1]:  # the right half of a single component
        return np.zeros((1, 0))
    x = np.unique(x, axis=0)
    centroids = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = _distances(x, centroids).argmin(axis=1)
        count = np.bincount(near, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
    return centroids


Codebooks = tuple[np.ndarray, np.ndarray, float]  # of one vector length: centroids of both halves, margin of the traversal


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = -(-x.shape[1] // 2)
    return x[:, :half], x[:, half:]


def _beyond(x: np.ndarray, partner: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How much farther than its nearest cell each vector has its partner's."""
    out = np.zeros(len(x))
    for a, b, book in zip(_halves(x), _halves(partner), books, strict=True):
        own, cell = _distances(a, book), _distances(b, book).argmin(axis=1)
        out += own[np.arange(len(x)), cell] - own.min(axis=1)
    return out


def fit_codebooks(x: np.ndarray, centroids: int, threshold: float, recall: float, seed: int = 10) -> Codebooks:
    """Codebooks of unit vectors, and the margin at which ``recall`` of held-out vectors' partners are found."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, rest = x[order[: len(x) // 4]], x[order[len(x) // 4 :]]
    books = tuple(kmeans(h, min(centroids, max(1, len(h) // 8)), 8, rng) for h in _halves(rest))
    if not len(held):
        return (*books, float("inf"))
    noise = rng.standard_normal((8, *held.shape))
    noise -= (noise * held).sum(axis=2, keepdims=True) * held
    norm = np.linalg.norm(noise, axis=2, keepdims=True)
    partner = threshold * held + np.sqrt(1 - threshold**2) * np.divide(noise, norm, out=np.zeros_like(noise), where=norm > 0)
    margins = [np.quantile(_beyond(np.tile(held, (8, 1)), partner.reshape(-1, x.shape[1]), books), recall)]
    close = np.argwhere(np.triu(held @ held.T >= threshold, 1))
    if len(close):
        margins.append(np.quantile(_beyond(held[close[:, 0]], held[close[:, 1]], books), recall))
    return (*books, float(max(margins)) + 1e-9)


def traverse(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest cell of each vector, and (vector, cell) of all cells within the margin.

    In sorted order of both halves, the cells within the margin of a vector are a staircase: for
    each left centroid a run of the right ones, which gets shorter as the left one gets farther.
    """
    left, right, margin = books
    (a, ia), (b, ib) = ((np.sort(d, axis=1), np.argsort(d, axis=1, kind="stable")) for d in map(_distances, _halves(x), (left, right)))
    limit = a[:, 0] + b[:, 0] + margin
    who, cells = [], []
    for i in range(a.shape[1]):
        alive = np.flatnonzero(a[:, i] + b[:, 0] <= limit)
        if not len(alive):
            break
        run = (a[alive, i, None] + b[alive] <= limit[alive, None]).sum(axis=1)
        row = np.repeat(alive, run)
        step = np.arange(len(row)) - np.repeat(np.cumsum(run) - run, run)
        who.append(row)
        cells.append(ia[row, i] * b.shape[1] + ib[row, step])
    return ia[:, 0] * b.shape[1] + ib[:, 0], np.concatenate(who), np.concatenate(cells)


def _rows(column: pa.Array | pa.ChunkedArray, dim: int, kind: str) -> np.ndarray:
    """Vectors of one length, held as bytes, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _packed(kind: str):
    """Vectors as bytes of their own width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
            at = np.r_[0, np.cumsum(np.asarray(batch.column("dim"), dtype=np.int64))] * int(kind[-1])
            vectors = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in ("cls", "label", "dim", "least", "mult")), pa.array(vectors, pa.binary())], names=["cls", "label", "dim", "least", "mult", "v"])

    return run


def _fit(kind: str, threshold: float, recall: float):
    """Codebooks of the sample of one length, as one row."""

    def run(rows: pa.Table) -> pa.Table:
        dim, centroids = (rows.column(c)[0].as_py() for c in ("dim", "centroids"))
        left, right, margin = fit_codebooks(_unit(_rows(rows.sort_by("cls").column("v"), dim, kind)), centroids, threshold, recall)
        return pa.table([pa.array([dim], pa.int32()), pa.array([left.astype("<f8").tobytes()]), pa.array([right.astype("<f8").tobytes()]), pa.array([margin], pa.float64())], names=["dim", "left", "right", "margin"])

    return run


def _visits(books: dict[int, Codebooks], kind: str):
    """For each class its own cell and all that it visits; without codebooks there is only cell 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                dim = np.asarray(part.column("dim"))
                for d in np.unique(dim).tolist():
                    own = part.filter(pa.array(dim == d))
                    if d in books:
                        home, who, cell = traverse(_unit(_rows(own.column("v"), d, kind)), books[d])
                        order = np.argsort(who, kind="stable")
                        offsets, cell = np.searchsorted(who[order], np.arange(own.num_rows + 1)), cell[order]
                    else:
                        home, cell, offsets = (np.zeros(own.num_rows, np.int64),) * 2 + (np.arange(own.num_rows + 1),)
                    visited = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(cell, pa.int32()))
                    yield pa.record_batch([*own.columns, pa.array(home, pa.int32()), visited], names=[*own.schema.names, "home", "cells"])

    return run


def _forest(linked: list[np.ndarray], n: int) -> np.ndarray:
    """Root of each of n nodes: the first of those that it is linked with, ``linked`` by node."""
    root = np.full(n, -1)
    for x in range(n):
        if root[x] >= 0:
            continue
        root[x], open_ = x, [x]
        while open_:
            near = linked[open_.pop()]
            near = near[root[near] < 0]
            root[near] = x
            open_ += near.tolist()
    return root


def _verify(threshold: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in grouped(batches, ("label", "dim", "cell", "i", "j")):
            cls, mult, role = (cell.column(c).to_numpy() for c in ("cls", "mult", "role"))
            member, query = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
            if not len(member) or not len(query):
                continue
            x = _unit(_rows(cell.column("v"), cell.column("dim")[0].as_py(), kind))
            hit = (x[query] @ x[member].T >= threshold) & (cls[query][:, None] < cls[member])
            if not hit.any():
                continue
            counts = np.zeros(len(cls), np.int64)
            np.add.at(counts, query, hit @ mult[member])
            np.add.at(counts, member, mult[query] @ hit)
            linked = [np.zeros(0, np.int64)] * len(cls)
            for k in np.flatnonzero(hit.any(axis=1)).tolist():
                linked[query[k]] = member[hit[k]]
            for k in np.flatnonzero(hit.any(axis=0)).tolist():
                linked[member[k]] = np.r_[linked[member[k]], query[hit[:, k]]]
            root = _forest(linked, len(cls))
            some, child = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(cls)))
            n = [len(some), len(child)]
            yield pa.record_batch([pa.array(np.r_[cls[some], cls[child]], pa.int64()), pa.array(np.r_[np.zeros(n[0], np.int64), cls[root[child]]], pa.int64(), mask=np.arange(sum(n)) < n[0]), pa.array(np.r_[counts[some], np.zeros(n[1], np.int64)], pa.int64())], names=["cls", "to", "n"])

    return run


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = 0.98) -> DataFrame:
    """Per row (id_col, n_links, component_id, kept)."""
    spark = vectors.sparkSession
    width = partitions(spark)
    key = fresh(vectors, "_key")
    v, label = F.col(f"`{vector_col}`"), F.col(f"`{label_col}`")
    narrow = isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    kind = "<f4" if narrow else "<f8"
    if isinstance(vectors.schema[label_col].dataType, (T.FloatType, T.DoubleType)):
        label = label + F.lit(0.0)  # -0.0 equals 0.0
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = v.isNotNull() & (F.size(v) > 0) & finite & label.isNotNull()
    number = F.transform(v, lambda x: x.cast("float" if narrow else "double") + F.lit(0.0).cast("float" if narrow else "double"))
    rows = with_key(vectors, id_col, key).select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("id"), F.when(usable, label.cast("string")).alias("label"), F.when(usable, number).alias("v"))
    rows = staged(rows.withColumn("digest", F.xxhash64("v")), "vectors")
    classes = rows.filter("v is not null").groupBy("label", "digest", "v").agg(F.min("key").alias("cls"), F.min_by("id", "key").alias("least"), F.count("*").alias("mult"))
    columns = "cls long, label string, dim int, least long, mult long, v binary"
    classes = staged(classes.withColumn("dim", F.size("v")).select("cls", "label", "dim", "least", "mult", "v").mapInArrow(_packed(kind), columns), "classes")

    sized = [(r["dim"], r["count"]) for r in classes.groupBy("dim").count().filter(F.col("count") >= EXACT).collect()]  # vector lengths, not vectors
    books: dict[int, Codebooks] = {}
    if sized:
        lengths = spark.createDataFrame([(d, cells_for(n), min(1.0, SAMPLE_ROWS / n)) for d, n in sized], "dim int, centroids int, part double")
        lot = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < F.col("part") * (1 << 30)
        fitted = classes.join(F.broadcast(lengths), "dim").filter(lot).select("cls", "dim", "centroids", "v").groupBy("dim").applyInArrow(_fit(kind, threshold, recall), "dim int, left binary, right binary, margin double")
        for r in fitted.collect():  # codebooks: two matrices of MOST_CENTROIDS rows at most for each length
            half = -(-r["dim"] // 2)
            books[r["dim"]] = (np.frombuffer(r["left"], "<f8").reshape(-1, half), np.frombuffer(r["right"], "<f8").reshape(-1, r["dim"] - half) if r["dim"] > half else np.zeros((1, 0)), r["margin"])

    visits = staged(classes.mapInArrow(_visits(books, kind), f"{columns}, home int, cells array<int>"), "visits")
    flat = visits.select("label", "dim", "home", F.explode("cells").alias("cell"))
    sizes = flat.groupBy("label", "dim", "cell").agg(F.count("*").alias("queries"), F.sum((F.col("cell") == F.col("home")).cast("int")).alias("members")).filter("members > 0 and queries > 1")
    met = visits.select("cls", "label", "dim", "mult", "v", "home", F.explode("cells").alias("cell")).join(sizes, ["label", "dim", "cell"])
    own_query, own_member = (F.pmod(F.xxhash64("cls"), F.ceil(F.col(c) / BLOCK).cast("int")).cast("int") for c in ("queries", "members"))
    at_home = F.col("cell") == F.col("home")
    # a class is in the row of cells of its query block and, at home, in the column of its member block
    runs = F.concat(
        F.transform(F.sequence(F.lit(0), F.ceil(F.col("members") / BLOCK).cast("int") - 1), lambda j: F.struct(own_query.alias("i"), j.alias("j"), F.when(at_home & (j == own_member), 2).otherwise(1).alias("role"))),
        F.when(at_home, F.transform(F.filter(F.sequence(F.lit(0), F.ceil(F.col("queries") / BLOCK).cast("int") - 1), lambda i: i != own_query), lambda i: F.struct(i.alias("i"), own_member.alias("j"), F.lit(0).alias("role")))).otherwise(F.array()),
    )
    cells = met.withColumn("at", F.explode(runs)).select("label", "dim", "cell", "at.i", "at.j", "at.role", "cls", "mult", "v")
    cells = cells.repartition(width, "label", "dim", "cell", "i", "j").sortWithinPartitions("label", "dim", "cell", "i", "j", "cls")
    found = staged(cells.mapInArrow(_verify(threshold, kind), "cls long, to long, n long"), "found")

    counts = found.filter("to is null").groupBy("cls").agg(F.sum("n").alias("n"))
    roots = components(found.filter("to is not null").select(F.col("cls").alias("a"), F.col("to").alias("b")), "links")
    placed = classes.select("cls", "mult").join(counts, "cls", "left").join(roots, F.col("cls") == F.col("node"), "left")
    placed = placed.select("cls", F.coalesce("root", "cls").alias("root"), (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    # keys ascend with ids, so a component's least class holds its least id
    named = placed.join(classes.select(F.col("cls").alias("root"), F.col("least").alias("component_id")), "root").drop("root")
    twins = rows.filter("v is not null").groupBy("label", "digest", "v").agg(F.min("key").alias("cls"))
    named = staged(twins.join(named, "cls").drop("cls"), "named")
    done = rows.join(named, ["label", "digest", "v"], "left")
    component = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return done.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
