"""The check engine: checks by name and stage, each isolated from the failures of the others.

A check is a function of the facts that returns findings, and records or None. ``CHECKS`` holds the
standard ones in their order; a caller may add its own (``Check``) to a run. A run at a stage takes
the checks of that stage and of earlier ones. Each check's results are written to the folder that
driver and executors share as soon as they are made, so that one that breaks, when planned or when run,
becomes a finding and takes nothing else with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog import schema

from . import checks, graphs, routing, rules

PRE, POST = 0, 1


@dataclass(frozen=True)
class Facts:
    """What checks read; frames that are None are empty. ``counts`` is of ``routing.counts`` and ``totals`` of
    ``routing.totals``; without them nothing was collected."""

    mods: DataFrame
    containers: DataFrame | None = None
    mixins: DataFrame | None = None
    rules: DataFrame | None = None
    counts: DataFrame | None = None
    totals: DataFrame | None = None
    loader: str | None = None
    game_version: str | None = None

    @property
    def spark(self) -> SparkSession:
        return self.mods.sparkSession

    def frame(self, name: str) -> DataFrame:
        held = getattr(self, name)
        return self.spark.createDataFrame([], getattr(schema, name.upper())) if held is None else held

    @property
    def stage(self) -> int:
        """POST where anything was counted or filtered."""
        return POST if self.counts is not None and self.counts.filter("counted > 0 or filtered > 0").take(1) else PRE


class Results(NamedTuple):
    findings: DataFrame
    records: DataFrame


class Check(NamedTuple):
    name: str
    stage: int
    about: str
    run: Callable[[Facts], tuple[DataFrame, DataFrame | None]]


CHECKS: dict[str, Check] = {}


def check(name: str, stage: int, about: str):
    """Adds a check to the standard ones."""

    def take(f):
        CHECKS[name] = Check(name, stage, about, f)
        return f

    return take


@check("containers", PRE, "containers that can't be read, are large, or lack what they declare; mods without one")
def _containers(facts: Facts):
    return checks.container_checks(facts.frame("containers"), facts.mods), None


@check("dependency-graph", PRE, "requirements that are missing, rejections, contradictions, ids declared twice")
def _dependencies(facts: Facts):
    return checks.dependency_graph(facts.mods), checks.dependency_records(facts.mods, facts.frame("containers"))


@check("compatibility", PRE, "versions out of range, cycles of requirements, mods built for something else")
def _compatibility(facts: Facts):
    return checks.compatibility(facts.mods, facts.loader, facts.game_version), None


@check("mixins", PRE, "classes that several mods patch")
def _mixins(facts: Facts):
    return checks.mixin_checks(facts.frame("mixins")), checks.mixin_records(facts.frame("mixins"), facts.mods)


@check("namespace-claims", PRE, "namespaces that several mods claim")
def _namespaces(facts: Facts):
    return checks.namespace_claims(facts.mods), checks.namespace_records(facts.mods)


@check("orphan-namespaces", POST, "namespaces with records that no mod claims")
def _orphans(facts: Facts):
    return checks.orphan_namespaces(facts.counts.filter("counted > 0"), facts.mods), None


@check("coverage", POST, "what was collected and what filters took away")
def _coverage(facts: Facts):
    return checks.coverage_findings(facts.totals), checks.coverage_records(routing.coverage(facts.counts))


def rule_checks() -> list[Check]:
    """The declared rules, as a check before and one after collection."""
    pre = lambda facts: (rules.apply_pre(facts.frame("rules"), facts.mods, checks.mixin_entries(facts.frame("mixins"))), None)
    post = lambda facts: (rules.apply_post(facts.frame("rules"), facts.counts.select("kind", "namespace", F.col("counted").alias("n"))), None)
    return [Check("datapack-rules", PRE, "declared rules on mods and mixins", pre), Check("datapack-rules-post", POST, "declared rules on what was collected", post)]


def named(names: Iterable[str] = ()) -> list[Check]:
    """The standard checks of these names, in their order; all if none is named. Unknown names are ignored."""
    wanted = set(names)
    return [c for c in CHECKS.values() if not wanted or c.name in wanted]


def run(facts: Facts, chosen: Iterable[Check] | None = None, stage: int | None = None, with_records: bool = True) -> Results:
    """Findings and records of the chosen checks (the standard ones, and rules where there are any) up to a stage; without ``with_records``, findings alone."""
    chosen = list(chosen) if chosen is not None else named() + (rule_checks() if facts.rules is not None else [])
    upto = facts.stage if stage is None else stage
    found, records = [facts.spark.createDataFrame([], schema.FINDINGS)], [facts.spark.createDataFrame([], schema.RECORDS)]
    for c in chosen:
        if c.stage > upto:
            continue
        try:
            own, more = c.run(facts)
            held = [graphs.cut_lineage(own), graphs.cut_lineage(more) if with_records and more is not None else None]
        except Exception as e:  # whatever it is, it becomes a finding
            error = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
            found.append(facts.spark.createDataFrame([("analysis_failed", "WARN", c.name, f"{c.name} broke off: {error}", [])], schema.FINDINGS))
            continue
        found.append(held[0])
        if held[1] is not None:
            records.append(held[1])
    return Results(checks.union(*found), checks.union(*records))

