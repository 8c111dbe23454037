"""Declarative rules over what is present: eight kinds, all evaluated in one pass each.

Rules are a frame (``schema.RULES``); facts are frames too. A rule fires as a finding of kind
``rule:<kind>`` that names its strategy. A count rule whose target is no record kind can't be
evaluated: it gives a ``rule_failed`` finding, and the others still run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.schema import ANALYSIS_KINDS, DATA_KINDS, plural

from .checks import finding, say, union

#: Rule kinds; the last three need a finished collection.
PRE = ("REQUIRE_MOD", "FORBID_MOD", "REQUIRE_TOGETHER", "MUTUALLY_EXCLUSIVE", "FORBID_MIXIN_TARGET")
POST = ("REQUIRE_NAMESPACE", "MIN_COUNT", "MAX_COUNT")


def _default_message() -> Column:
    mods = F.array_join("mods", ", ")
    told = {
        "REQUIRE_MOD": say(F.col("mod"), "is required and not loaded"),
        "FORBID_MOD": say(F.col("mod"), "is forbidden and loaded"),
        "REQUIRE_TOGETHER": say("these go together:", mods),
        "MUTUALLY_EXCLUSIVE": say("these exclude each other:", mods),
        "FORBID_MIXIN_TARGET": say(F.col("target"), "must not be patched"),
        "REQUIRE_NAMESPACE": say(F.col("namespace"), "has no records"),
        "MIN_COUNT": say(F.col("target"), "has fewer than", F.col("value"), "records"),
        "MAX_COUNT": say(F.col("target"), "has more than", F.col("value"), "records"),
    }
    return F.coalesce(*[F.when(F.col("rule") == k, m) for k, m in told.items()])


def _fired(rows: DataFrame, rule: str, subject: Column) -> DataFrame:
    message = F.coalesce(F.nullif("message", F.lit("")), _default_message())
    return finding(rows, f"rule:{rule.lower()}", F.coalesce("severity", F.lit("WARN")), subject, message, strategy=F.col("strategy"), datapack=F.col("datapack"), rule=F.col("rule"))


def _of(rules: DataFrame, kind: str) -> DataFrame:
    return rules.withColumn("rule", F.upper(F.translate(F.trim("kind"), "-", "_"))).filter(F.col("rule") == kind)


def present_mods(rules: DataFrame, mods: DataFrame) -> DataFrame:
    """Rules on groups with ``n`` members and ``here``: the present ones in the rule's order."""
    keyed = rules.withColumn("_row", F.struct(*rules.columns))
    listed = keyed.select("_row", F.size("mods").alias("n"), F.posexplode("mods").alias("at", "id"))
    there = listed.join(mods.select("id").distinct(), "id", "left_semi")
    kept = there.groupBy("_row", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("here"))
    return kept.select("_row.*", "n", "here")


def apply_pre(rules: DataFrame, mods: DataFrame, entries: DataFrame) -> DataFrame:
    """``entries``: (target, owner, explicit) of mixins."""
    ids = mods.select(F.col("id").alias("mod")).distinct()
    together, exclusive = (present_mods(_of(rules, k), mods) for k in ("REQUIRE_TOGETHER", "MUTUALLY_EXCLUSIVE"))
    patched = entries.filter("explicit").groupBy("target").agg(F.array_join(F.sort_array(F.collect_set("owner")), ",").alias("owners"))
    here = F.array_join("here", ",")
    return union(
        _fired(_of(rules, "REQUIRE_MOD").join(ids, "mod", "left_anti"), "REQUIRE_MOD", F.col("mod")),
        _fired(_of(rules, "FORBID_MOD").join(ids, "mod", "left_semi"), "FORBID_MOD", F.col("mod")),
        _fired(together.filter(F.size("here") < F.col("n")), "REQUIRE_TOGETHER", here),
        _fired(exclusive.filter(F.size("here") > 1), "MUTUALLY_EXCLUSIVE", here),
        _fired(_of(rules, "FORBID_MIXIN_TARGET").join(patched, "target"), "FORBID_MIXIN_TARGET", F.col("owners")),
    )


def apply_post(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """``counts``: (kind, namespace, n) of accepted records; a kind without any counts as 0."""
    seen = counts.filter("n > 0").select("namespace").distinct()
    names = {n: k for k in (*DATA_KINDS, *ANALYSIS_KINDS) for n in (k, plural(k))}
    kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.lower(F.trim("target")))
    have = counts.groupBy(F.col("kind").alias("_kind")).agg(F.sum("n").alias("have"))
    asked = {k: _of(rules, k).withColumn("_kind", kind) for k in ("MIN_COUNT", "MAX_COUNT")}
    low, high = (r.filter("_kind is not null").join(have, "_kind", "left").withColumn("have", F.coalesce("have", F.lit(0))) for r in asked.values())
    told = F.concat_ws("=", F.col("target"), F.col("have").cast("string"))
    failed = [finding(r.filter("_kind is null"), "rule_failed", "WARN", F.col("strategy"), say("no kind of records is called", F.col("target")), strategy=F.col("strategy"), rule=F.col("rule")) for r in asked.values()]
    return union(
        _fired(_of(rules, "REQUIRE_NAMESPACE").join(seen, "namespace", "left_anti"), "REQUIRE_NAMESPACE", F.col("namespace")),
        _fired(low.filter("have < value"), "MIN_COUNT", told),
        _fired(high.filter("have > value"), "MAX_COUNT", told),
        *failed,
    )
