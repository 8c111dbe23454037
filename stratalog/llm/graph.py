"""Connected components of a graph of any size, as rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged

#: Nodes with more edges than both DEGREE and the HOT-th part of twice all edges meet by broadcast: at most HOT nodes do.
DEGREE, HOT = 500, 10_000


def _least(sides: DataFrame, edges: int) -> tuple[DataFrame, DataFrame]:
    """(u, m) of all sides (u, v): the least v of each u, for most nodes, and for those with very many edges."""
    least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    most = max(DEGREE, 2 * edges // HOT)
    return least.filter(F.col("n") <= most).drop("n"), least.filter(F.col("n") > most).drop("n")


def _meet(sides: DataFrame, few: DataFrame, many: DataFrame) -> DataFrame:
    """Sides (u, v) with the least v of their u as m; sides of a hub stay where they are."""
    hub = F.broadcast(many)  # at most HOT rows, by their share of the edges
    return sides.join(hub.select("u"), "u", "left_anti").join(few, "u").unionByName(sides.join(hub, "u"))


def _stars(edges: DataFrame, n: int) -> DataFrame:
    """One large-star and one small-star step: every node moves towards its least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    large = _meet(both, *_least(both, n)).filter("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
    down = staged(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), "large")
    few, many = _least(down, n)
    moved = _meet(down, few, many).select(F.col("v").alias("a"), F.col("m").alias("b")).union(few.union(many).select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node that has an edge (a, b); the root is the least node it reaches.

    The edges of a round are staged, so a lost executor never sets the work back by more than
    one round. A path halves with each round; nothing is gathered but a count and a checksum.
    """
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = None
    while True:
        check = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (check.n, check.x) == seen or not check.n:
            break
        seen = (check.n, check.x)
        now = staged(_stars(now, check.n), label)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
