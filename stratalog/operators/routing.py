"""Routing of records, what it counts, and additive targets."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.schema import GLOBAL

from .predicates import Selector, namespace_allowed, tags_allowed


@dataclass(frozen=True)
class Filters:
    namespaces: Collection[str] = ()
    excluded_namespaces: Collection[str] = ()
    tags: Collection[str] = ()
    excluded_tags: Collection[str] = ()
    excluded_mods: Collection[str] = field(default=())

    def accept(self, ns: Column, tags: Column) -> Column:
        """Global records pass the namespace test; all must pass the tag test."""
        named = F.coalesce(ns == GLOBAL, F.lit(False)) | namespace_allowed(ns, self.namespaces, self.excluded_namespaces)
        return named & tags_allowed(tags, self.tags, self.excluded_tags)


def route(records: DataFrame, filters: Filters, namespace: str = "namespace", tags: str = "tags") -> DataFrame:
    """Records with the flag ``accepted``; rejected rows stay, for the counts."""
    return records.withColumn("accepted", filters.accept(F.col(namespace), F.col(tags)))


def written(routed: DataFrame, filters: Filters, kind: str = "kind", name: str = "id") -> DataFrame:
    """What goes to the output: excluded mods lose their own records only."""
    rows = routed.filter("accepted")
    if filters.excluded_mods:
        rows = rows.filter(~((F.col(kind) == "mod") & F.coalesce(F.col(name).isin(*filters.excluded_mods), F.lit(False))))
    return rows


def counts(routed: DataFrame) -> DataFrame:
    """Accepted and filtered records for each (kind, namespace)."""
    return routed.groupBy("kind", "namespace").agg(F.count_if(F.col("accepted")).alias("counted"), F.count_if(~F.col("accepted")).alias("filtered"))


def totals(routed: DataFrame) -> DataFrame:
    kept = lambda c: F.count_distinct(F.when(F.col("accepted"), F.col(c)))
    return routed.agg(F.count_if(F.col("accepted")).alias("counted"), F.count_if(~F.col("accepted")).alias("filtered"), kept("namespace").alias("namespaces"), kept("kind").alias("kinds"))


def coverage(counted: DataFrame) -> DataFrame:
    """For each kind with records, counted or filtered: totals, namespaces with counted ones, their names, and ``ns=n, ns=n`` in order."""
    held = F.array_sort(F.collect_list(F.when(F.col("counted") > 0, F.struct("namespace", "counted"))))
    agg = counted.groupBy("kind").agg(F.sum("counted").alias("total"), F.sum("filtered").alias("filtered"), held.alias("held")).filter("total > 0 or filtered > 0")
    text = F.array_join(F.transform("held", lambda p: F.concat(p["namespace"], F.lit("="), p["counted"].cast("string"))), ", ")
    return agg.select("kind", "total", "filtered", F.size("held").cast("long").alias("namespaces"), F.transform("held", lambda p: p["namespace"]).alias("names"), text.alias("by_namespace"))


def to_targets(accepted: DataFrame, targets: dict[str, Selector], name: str = "id", namespace: str = "namespace", tags: str = "tags") -> DataFrame:
    """A copy of each record for every target whose selector it meets; one pass, no join."""
    hits = [F.when(s.matches(F.col(name), F.col(namespace), F.col(tags)), F.lit(t)) for t, s in sorted(targets.items())]
    return accepted.withColumn("target", F.explode(F.array_compact(F.array(*hits))))
