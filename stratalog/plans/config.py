"""Names of kinds and formats, and settings in layers."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, fields, replace
from typing import Any

from stratalog.schema import ANALYSIS_KINDS, DATA_KINDS, plural

from .sinks import FORMATS

#: The kinds that a run takes when none are named.
COMMON_KINDS = "mod item block entity recipe tag loot_table advancement effect fluid enchantment creative_tab".split()
GROUPS = {"all": [*DATA_KINDS, *ANALYSIS_KINDS], "data": DATA_KINDS, "analysis": ANALYSIS_KINDS, "common": COMMON_KINDS}


def kinds(text: str) -> list[str] | None:
    """Kinds of a list of tokens and groups, in the order of the vocabulary; None if any token is unknown."""
    wanted: set[str] = set()
    for token in filter(None, re.split(r"[,\s]+", text.strip().lower())):
        known = GROUPS.get(token) or [k for k in GROUPS["all"] if token in (k, plural(k))]
        if not known:
            return None
        wanted.update(known)
    return [k for k in GROUPS["all"] if k in wanted]


def formats(text: str) -> list[str] | None:
    wanted = [t for t in re.split(r"[,\s]+", text.strip().lower()) if t]
    return sorted(set(wanted)) if all(t in FORMATS for t in wanted) else None


def analyses_wanted(chosen: Iterable[str]) -> list[str]:
    """Analysis kinds named, or all of them if none is."""
    named = [k for k in ANALYSIS_KINDS if k in set(chosen)]
    return named or list(ANALYSIS_KINDS)


@dataclass(frozen=True)
class Settings:
    """None and empty mean unset; tuples marked so accumulate over layers."""

    formats: tuple[str, ...] = ("json",)
    kinds: tuple[str, ...] = tuple(COMMON_KINDS)
    analyze: bool = True
    analysis_separate: bool = True
    fields: tuple[str, ...] = ()
    excluded_fields: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    strategies: tuple[str, ...] = ()
    checks: tuple[str, ...] = ()
    delta: bool = False
    part_bytes: int = 0
    package_per_kind: bool = True
    shard_by_namespace: bool = True
    wiki_blocks: bool = False
    namespaces: tuple[str, ...] = field(default=(), metadata={"accumulates": True})
    excluded_namespaces: tuple[str, ...] = field(default=(), metadata={"accumulates": True})
    tags: tuple[str, ...] = field(default=(), metadata={"accumulates": True})
    excluded_tags: tuple[str, ...] = field(default=(), metadata={"accumulates": True})
    excluded_mods: tuple[str, ...] = field(default=(), metadata={"accumulates": True})


def resolve(layers: Iterable[tuple[str, dict[str, Any]]], base: Settings | None = None) -> tuple[Settings, list[str], list[str]]:
    """(settings, warnings, errors): later layers win, accumulating fields add up, a bad layer is skipped whole."""
    out, warnings, errors = base or Settings(), [], []
    known = {f.name: f for f in fields(Settings)}
    for name, layer in layers:
        warnings += [f"{name}: unknown key {k}" for k in layer if k not in known]
        values = {k: v for k, v in layer.items() if k in known and v is not None}
        try:
            for k, read in (("kinds", kinds), ("formats", formats)):
                if isinstance(values.get(k), str):
                    found = read(values[k])
                    if found is None:
                        raise ValueError(f"unknown name in {k}: {values[k]}")
                    values[k] = tuple(found)
        except ValueError as e:
            errors.append(f"{name}: {e}")
            continue
        for k, v in values.items():
            if known[k].metadata.get("accumulates"):
                values[k] = tuple(dict.fromkeys([*getattr(out, k), *v]))
        out = replace(out, **values)
    return out, warnings, errors
