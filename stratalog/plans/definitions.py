"""Definitions that packs bring: flows (settings), targets (selectors) and strategies (rules), as frames.

A definition is a JSON file ``data/<namespace>/<root>/flows|targets|analyses/<name>.json`` of a pack.
Files are parsed as Variant columns; whatever a definition lacks makes it a finding, never a failure
of the run. Of definitions that share an id the pack of the highest rank wins, of equal ranks the
first. The older text syntax (``.td``) is only recognised: where both exist the JSON file is used.
"""

from __future__ import annotations

import json
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.names import path_of
from stratalog.operators import checks
from stratalog.operators.predicates import Selector
from stratalog.operators.rules import POST, PRE
from stratalog.schema import ANALYSIS_KINDS, DATA_KINDS, RULES, plural
from stratalog.sources.documents import _at, _is, _items, _text, parsed

#: Where packs come from, by rank; folders of definitions.
ORIGINS = {"mod": 0, "world": 1, "global": 2}
FOLDERS = {"flows": "flow", "targets": "target", "analyses": "strategy"}
SELECTOR = ("namespace", "id", "tag", "prefix", "suffix", "contains")


class Definitions(NamedTuple):
    """flows (id, namespace, description, targets, strategies, settings as JSON), targets (id, namespace, kind, description and
    the fields of a selector), rules (``schema.RULES``), problems (findings)."""

    flows: DataFrame
    targets: DataFrame
    rules: DataFrame
    problems: DataFrame


def _strings(v: Column, path: str) -> Column:
    """A list of strings; a lone string counts as a list of one."""
    one = _text(v, path)
    listed = F.transform(F.coalesce(_items(_at(v, path)), F.array().cast("array<variant>")), lambda x: F.when(_is(x, "STRING"), F.try_variant_get(x, "$", "string")))
    return F.when(one.isNotNull(), F.array(one)).otherwise(F.array_compact(listed))


def _kind(token: Column) -> Column:
    names = {n: k for k in (*DATA_KINDS, *ANALYSIS_KINDS) for n in (k, plural(k))}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.lower(F.trim(token)))


def _rule(x: Column) -> Column:
    """A rule of a strategy as a struct whose ``error`` tells what it lacks."""
    token = F.coalesce(_text(x, "$.kind"), _text(x, "$.rule"))
    kind = F.upper(F.translate(F.trim(token), "-", "_"))
    severity = F.upper(F.trim(_text(x, "$.severity")))
    mod, listed, target, space = _text(x, "$.mod"), _strings(x, "$.mods"), _text(x, "$.target"), _text(x, "$.namespace")
    mods = F.when(mod.isNotNull() & (F.size(listed) == 0), F.array(mod)).otherwise(listed)
    value = F.try_variant_get(x, "$.value", "long")
    lacks = (
        F.when(~F.coalesce(kind.isin(*PRE, *POST), F.lit(False)), F.concat_ws(" ", F.lit("no such rule:"), token))
        .when(kind.isin("REQUIRE_MOD", "FORBID_MOD") & (F.size(mods) == 0), "it needs a mod")
        .when(kind.isin("REQUIRE_TOGETHER", "MUTUALLY_EXCLUSIVE") & (F.size(mods) < 2), "it needs two mods")
        .when((kind == "FORBID_MIXIN_TARGET") & target.isNull(), "it needs a target")
        .when((kind == "REQUIRE_NAMESPACE") & space.isNull(), "it needs a namespace")
        .when(kind.isin("MIN_COUNT", "MAX_COUNT") & (target.isNull() | value.isNull()), "it needs a target and a value")
    )
    fields = {"kind": kind, "severity": F.when(severity.isin("ERROR", "INFO"), severity).otherwise("WARN"), "mod": F.coalesce(mod, F.get(mods, F.lit(0))), "mods": mods, "target": target, "namespace": space, "value": value, "message": _text(x, "$.message"), "error": lacks}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def load(files: DataFrame, root: str = "definitions") -> Definitions:
    """From the files of packs: (source, origin, path, text), paths as they are within a pack."""
    where = rf"^/?data/([^/]+)/{root}/(flows|targets|analyses)/([^/]+)\.(json|td)$"
    part = lambda n: F.regexp_extract("path", where, n)
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ORIGINS.items() for x in p]), F.lower(F.trim("origin"))), F.lit(0))
    rows = files.filter(F.col("path").rlike(where)).select("source", rank.alias("rank"), part(1).alias("ns"), part(2).alias("folder"), part(3).alias("name"), part(4).alias("syntax"), "text")
    key = ["source", "ns", "folder", "name"]
    both = rows.groupBy(*key).agg(F.count_distinct("syntax").alias("n"), F.bool_or(F.col("syntax") == "json").alias("has_json"))
    doubled = checks.finding(both.filter("n > 1"), "datapack_duplicate_syntax", "WARN", F.col("source"), checks.say(F.col("name"), "of", F.col("source"), "has two syntaxes, JSON is used"), datapack=F.col("source"), name=F.col("name"))
    unread = checks.finding(both.filter("not has_json"), "datapack_read_failed", "WARN", F.col("source"), checks.say(F.col("name"), "of", F.col("source"), "is not JSON"), datapack=F.col("source"), file=F.col("name"))

    v = parsed(F.col("text"))
    docs = rows.filter("syntax = 'json'").withColumn("v", v).withColumn("id", F.coalesce(F.nullif(_text(F.col("v"), "$.id"), F.lit("")), F.col("name")))
    category, own_rules = _text(F.col("v"), "$.category"), F.transform(F.filter(F.coalesce(_items(_at(F.col("v"), "$.rules")), F.array().cast("array<variant>")), lambda x: _is(x, "OBJECT")), _rule)
    docs = docs.withColumn("kind", F.when(F.col("folder") == "targets", _kind(category))).withColumn("rules", F.when(F.col("folder") == "analyses", own_rules))
    wrong = F.array_compact(F.transform("rules", lambda r: r["error"]))
    error = F.when(~_is(F.col("v"), "OBJECT"), "no JSON object").when((F.col("folder") == "targets") & F.col("kind").isNull(), F.concat_ws(" ", F.lit("no such kind:"), category)).when(F.size(wrong) > 0, wrong[0])
    docs = docs.withColumn("error", error)
    what = F.element_at(F.create_map(*[F.lit(x) for p in FOLDERS.items() for x in p]), F.col("folder"))
    bad = docs.filter("error is not null")
    invalid = [checks.finding(bad.filter(F.col("folder") == f), f"datapack_{k}_invalid", "WARN", F.col("ns"), checks.say(k, F.col("name"), "of", F.col("source"), "is invalid:", F.col("error")), datapack=F.col("source"), file=F.col("name")) for f, k in FOLDERS.items()]

    good = docs.filter("error is null").withColumn("at", F.concat_ws("\u0001", "source", "ns", "name")).withColumn("what", what)
    # one id of one folder: the higher rank, of equal ranks the first
    lost = checks.shadowed(good.select(F.concat_ws("\u0001", "folder", "id").alias("id"), "rank", F.col("at").alias("source")))
    told = lambda c: F.substring_index(c, "\u0001", 1)
    named = lost.select(F.element_at(F.create_map(*[F.lit(x) for p in FOLDERS.items() for x in p]), told("id")).alias("what"), F.substring_index("id", "\u0001", -1).alias("id"), told("source").alias("loser"), told("winner").alias("used"), "severity")
    about = {"id": F.col("id"), "kind": F.col("what"), "used": F.col("used"), "shadowed": F.col("loser")}
    message = checks.say(F.col("what"), F.col("id"), "of", F.col("used"), "is used, that of", F.col("loser"), "is not")
    over = [checks.finding(named.filter(F.col("severity") == s), k, s, F.col("id"), message, **about) for k, s in (("datapack_override", "INFO"), ("datapack_shadowed", "WARN"))]
    stands = good.join(lost.select(F.col("id").alias("_key"), F.col("source").alias("_at")).distinct(), (F.concat_ws("\u0001", "folder", "id") == F.col("_key")) & (F.col("at") == F.col("_at")), "left_anti")

    w = F.col("v")
    flows = stands.filter("folder = 'flows'").select("id", F.col("ns").alias("namespace"), _text(w, "$.description").alias("description"), _strings(w, "$.targets").alias("targets"), _strings(w, "$.strategies").alias("strategies"), F.to_json(F.map_filter(F.try_variant_get(w, "$", "map<string,variant>"), lambda k, _: ~k.isin("id", "description", "targets", "strategies"))).alias("settings"))
    targets = stands.filter("folder = 'targets'").select("id", F.col("ns").alias("namespace"), "kind", _text(w, "$.description").alias("description"), *[F.nullif(F.trim(_text(w, f"$.selector.{f}")), F.lit("")).alias(f"by_{f}") for f in SELECTOR])
    strategies = stands.filter("folder = 'analyses'").select(F.col("id").alias("strategy"), F.col("ns").alias("datapack"), F.explode("rules").alias("r"))
    rules = strategies.select("strategy", "datapack", *[F.col(f"r.{f.name}").cast(f.dataType).alias(f.name) for f in RULES if f.name not in ("strategy", "datapack")])
    return Definitions(flows, targets, rules, checks.union(doubled, unread, *invalid, *over))


def selectors(targets: DataFrame) -> dict[str, tuple[str, Selector]]:
    """Kind and selector of each target by ``namespace:id``; definitions are few and small."""
    return {f"{r['namespace']}:{r['id']}": (r["kind"], Selector(**{f: r[f"by_{f}"] for f in SELECTOR})) for r in targets.collect()}


def flow_layer(definitions: Definitions, name: str) -> tuple[str, dict[str, Any]] | None:
    """A flow as a layer of settings, by its id or, asked for with a namespace, by what follows that."""
    wanted = definitions.flows.filter(F.col("id").isin(name, name.split(":", 1)[-1]))
    rows = sorted(wanted.collect(), key=lambda r: r["id"] != name)
    if not rows:
        return None
    r = rows[0]
    layer = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(r["settings"] or "{}").items()}
    return f"flow {r['namespace']}:{r['id']}", layer | {k: tuple(r[k]) for k in ("targets", "strategies") if r[k]}


def function_flows(functions: DataFrame, flows: DataFrame, root: str = "flows") -> tuple[DataFrame, DataFrame]:
    """Functions (id, pack) below ``root``/ as flows (id, function), and findings: a flow of the same id goes first, then the first function."""
    rows = functions.filter(path_of(F.col("id")).startswith(f"{root}/")).select(F.substring(path_of(F.col("id")), len(root) + 2, 1 << 20).alias("flow"), F.col("id").alias("function"))
    first = rows.groupBy("flow").agg(F.min("function").alias("function"), F.count("*").alias("n"))
    taken = first.join(flows.select(F.col("id").alias("flow")).distinct(), "flow", "left_semi")
    left = first.join(flows.select(F.col("id").alias("flow")).distinct(), "flow", "left_anti")
    problems = checks.union(
        checks.finding(taken, "datapack_flow_kind_collision", "WARN", F.col("flow"), checks.say("the flow", F.col("flow"), "is used, the function", F.col("function"), "is not"), id=F.col("flow"), function=F.col("function")),
        checks.finding(left.filter("n > 1"), "datapack_shadowed", "WARN", F.col("flow"), checks.say("of several functions of the flow", F.col("flow"), F.col("function"), "is used"), id=F.col("flow"), kind=F.lit("flow function")),
    )
    return left.select(F.col("flow").alias("id"), "function"), problems
