"""Positional merge policies: stacks with resets, single winners, layered settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stacked(versions: DataFrame, key: str, priority: str, replace: str) -> DataFrame:
    """Of each key's versions those that count: from the last one that replaces on, in order of priority."""
    whole = Window.partitionBy(key)
    reset = F.max(F.when(F.col(replace), F.col(priority))).over(whole)
    return versions.withColumn("_reset", reset).filter(F.col("_reset").isNull() | (F.col(priority) >= F.col("_reset"))).drop("_reset")


def stack_values(versions: DataFrame, key: str, priority: str, replace: str, values: str) -> DataFrame:
    """(key, values): distinct values of the counting versions, first occurrences in order.

    A key whose versions hold nothing is kept only if one of them replaces.
    """
    rows = stacked(versions, key, priority, replace)
    flat = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(priority, values))), lambda x: x[values])))
    return rows.groupBy(key).agg(flat.alias(values), F.bool_or(replace).alias("_replaced")).filter(F.col("_replaced") | (F.size(values) > 0)).drop("_replaced")


def winner(versions: DataFrame, key: str, *order: str) -> DataFrame:
    """The version of each key that comes last by ``order``; an aggregation, so hot keys combine early."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_w")).select(key, "_w.*")


def layered(settings: DataFrame) -> DataFrame:
    """(layer, key, value, accumulates): the last layer's value, or all layers' values of keys that accumulate."""
    some = settings.filter("value is not null")
    all_values = F.array_join(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("layer", "value"))), lambda x: F.split(x["value"], ",")))), ",")
    return some.groupBy("key").agg(F.when(F.bool_or("accumulates"), all_values).otherwise(F.max_by("value", "layer")).alias("value"))
