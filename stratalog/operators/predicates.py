"""Namespace, tag and selector predicates, and field masks. None of them is ever null."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.names import path_of


def namespace_allowed(ns: Column, include: Collection[str] = (), exclude: Collection[str] = ()) -> Column:
    """A null namespace fails; exclusion beats inclusion; an empty inclusion takes all."""
    allowed = ns.isNotNull()
    if exclude:
        allowed &= ~ns.isin(*exclude)
    if include:
        allowed &= ns.isin(*include)
    return F.coalesce(allowed, F.lit(False))


def tags_allowed(tags: Column, include: Collection[str] = (), exclude: Collection[str] = ()) -> Column:
    """An excluded tag rejects; with an inclusion, at least one of its tags must be there."""
    own = F.coalesce(tags, F.array().cast("array<string>"))
    allowed = F.lit(True)
    if exclude:
        allowed &= ~F.arrays_overlap(own, F.array(*[F.lit(x) for x in sorted(exclude)]))
    if include:
        allowed &= F.arrays_overlap(own, F.array(*[F.lit(x) for x in sorted(include)]))
    return F.coalesce(allowed, F.lit(False))


@dataclass(frozen=True)
class Selector:
    """All set fields must hold; blank ones are not set. Prefix, suffix and contains test the path."""

    namespace: str | None = None
    id: str | None = None
    tag: str | None = None
    prefix: str | None = None
    suffix: str | None = None
    contains: str | None = None

    def _set(self) -> dict[str, str]:
        return {k: v for k, v in vars(self).items() if v is not None and v.strip()}

    @property
    def specificity(self) -> int:
        return len(self._set())

    def describe(self) -> str:
        return " ".join(f"{k}={v}" for k, v in self._set().items()) or "everything"

    def matches(self, name: Column, namespace: Column, tags: Column) -> Column:
        path = path_of(name)
        test = {
            "namespace": lambda v: namespace == v,
            "id": lambda v: name == v,
            "tag": lambda v: F.array_contains(tags, v),
            "prefix": path.startswith,
            "suffix": path.endswith,
            "contains": path.contains,
        }
        held = F.lit(True)
        for k, v in self._set().items():
            held &= F.coalesce(test[k](v), F.lit(False))
        return held


#: Columns that a mask never takes away, in our spelling and in that of written fields.
IDENTITY = ("registryName", "englishName", "id", "registry_name", "namespace", "kind", "key", "type", "name", "english_name")


def masked(df: DataFrame, include: Collection[str] = (), exclude: Collection[str] = (), identity: Collection[str] = IDENTITY) -> DataFrame:
    """Keep identity columns, and of the others those included (all, if none are) and not excluded."""
    keep = [c for c in df.columns if c in identity or (c not in exclude and (not include or c in include))]
    return df.select(*keep)
