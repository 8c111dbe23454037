"""Run-length, difference and dictionary encodings of ordered columns, and the choice among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, run, value, length, first): gaps and islands within each group."""
    w = Window.partitionBy(group).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = rows.select(group, order, value, new.alias("_new"))
    marked = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(group, "run", value).agg(F.count("*").alias("length"), F.min(order).alias("first"))


def differences(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Each value less the one before it; a group's first stands for itself."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.select(group, order, (F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0))).alias("difference"))


def dictionary(rows: DataFrame, order: str, value: str) -> DataFrame:
    """(value, code): codes from 0 in order of first occurrence; the window runs over distinct values."""
    first = rows.groupBy(value).agg(F.min(order).alias("_first"))
    return first.select(value, (F.row_number().over(Window.orderBy("_first")) - 1).alias("code"))


def choice(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, encoding): RLE if all of several values are equal, DELTA if they never fall, else PLAIN."""
    w = Window.partitionBy(group).orderBy(order)
    step = rows.select(group, value, (F.col(value) - F.lag(value).over(w)).alias("_step"))
    agg = step.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(value).alias("_values"), F.min("_step").alias("_least"))
    chosen = F.when((F.col("n") > 1) & (F.col("_values") == 1), "RLE").when((F.col("n") > 1) & (F.col("_least") >= 0), "DELTA").otherwise("PLAIN")
    return agg.select(group, "n", chosen.alias("encoding"))


def graph_faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fault, id): node ids that repeat, and edge ends that are no node. Loops and parallel edges are fine."""
    twice = nodes.groupBy("id").count().filter("count > 1").select(F.lit("duplicate_node").alias("fault"), "id")
    ends = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    return twice.union(ends.join(nodes, "id", "left_anti").select(F.lit("dangling_edge").alias("fault"), "id"))


def contiguous_spans(rows: DataFrame, group: str, number: str) -> DataFrame:
    """(group, first, last, n, contiguous) of registration numbers; rows without group or number drop."""
    span = rows.filter(F.col(group).isNotNull() & F.col(number).isNotNull()).groupBy(group).agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n"))
    return span.withColumn("contiguous", F.col("n") == F.col("last") - F.col("first") + 1)
