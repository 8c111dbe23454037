"""Integrity checks: each takes frames of facts and returns findings, some also records.

A finding is (kind, severity, subject, message, detail), a record (kind, namespace, key, values,
extra). Checks are joins and aggregations; orders that matter are explicit columns, never the
order of arrival.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import versions
from stratalog.functions.names import utf16
from stratalog.schema import ANALYSIS_KINDS, GLOBAL, SEVERITIES

from . import graphs

LARGE_CONTAINER = 64 << 20
_PAIRS = "array<struct<k:string,v:string>>"


def _pairs(values: dict[str, Column], blanks: bool = True) -> Column:
    """Names and values in order; without ``blanks``, those that are null or empty drop."""
    if not values:
        return F.array().cast(_PAIRS)
    listed = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(v.cast("string"), F.lit("")).alias("v")) for k, v in values.items()])
    return listed if blanks else F.filter(listed, lambda p: p["v"] != "")


def finding(rows: DataFrame, kind: str, severity: str | Column, subject: Column, message: Column, /, **detail: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), subject.cast("string").alias("subject"), message.alias("message"), _pairs(detail).alias("detail"))


def record(rows: DataFrame, kind: str | Column, namespace: Column, key: Column, values: Column, extra: Column, name: Column | None = None) -> DataFrame:
    name = F.lit(None).cast("string") if name is None else name
    return rows.select((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), namespace.alias("namespace"), key.alias("key"), name.alias("name"), values.alias("values"), extra.alias("extra"))


def finding_records(findings: DataFrame) -> DataFrame:
    """Findings as records of the kind ``conflict``, named by their message."""
    detail = F.array_join(F.flatten(F.transform("detail", lambda d: F.array(d["k"], F.coalesce(d["v"], F.lit(""))))), ",")
    subject = F.coalesce("subject", F.lit(""))
    extra = _pairs({"findingKind": F.col("kind"), "severity": F.lower("severity"), "subject": subject, "detail": detail})
    key = F.concat(F.lit("finding:"), F.concat_ws(":", "kind", subject, "message"))
    return record(findings, "conflict", F.lit(GLOBAL), key, F.array().cast("array<string>"), extra, F.col("message"))


def say(*parts: str | Column) -> Column:
    """Words and columns with a blank between; nulls are left out."""
    return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def union(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def ordered(findings: DataFrame) -> DataFrame:
    """By severity, then kind, then subject, text by UTF-16 code units."""
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair]), F.coalesce("severity", F.lit("INFO")))
    return findings.orderBy(rank, *[utf16(F.col(c)) for c in ("kind", "subject", "message")])


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes first: later duplicates give way."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def edges(mods: DataFrame) -> DataFrame:
    """(src, dst, range, kind, ord, pos) of declared dependencies, in the order of their declaration."""
    return mods.select(F.col("id").alias("src"), "ord", F.posexplode("dependencies").alias("pos", "d")).select("src", F.col("d.id").alias("dst"), "d.range", "d.kind", "ord", "pos")


def _listed(edge: DataFrame, kind: str) -> Column:
    """Of a group of edges: those of a kind as ``id@range`` or ``id``, in order."""
    token = F.when(F.col("range").isNotNull(), F.concat("dst", F.lit("@"), "range")).otherwise(F.col("dst"))
    held = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", token.alias("t")))))
    return F.transform(held, lambda x: x["t"])


# dependency graph


def missing_required(edge: DataFrame, present: DataFrame) -> DataFrame:
    """Required edges to ids that are not there (left anti)."""
    return edge.filter(F.col("kind") == "REQUIRED").join(present.select(F.col("id").alias("dst")), "dst", "left_anti")


def _back(edge: DataFrame, kind: str) -> DataFrame:
    return edge.filter(F.col("kind") == kind).select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()


def incompatible(edge: DataFrame, present: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Incompatible edges whose target is there, with ``mutual`` where ``answers`` (the edges themselves) declare the reverse."""
    own = edge.filter(F.col("kind") == "INCOMPATIBLE").select("src", "dst")
    back = _back(edge if answers is None else answers, "INCOMPATIBLE").withColumn("mutual", F.lit(True))
    here = own.join(present.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    return here.join(back, ["src", "dst"], "left").select("src", "dst", F.coalesce("mutual", F.lit(False)).alias("mutual"))


def contradictory(edge: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """src declares dst incompatible while dst requires src."""
    own = edge.filter(F.col("kind") == "INCOMPATIBLE").select("src", "dst")
    return own.join(_back(edge if answers is None else answers, "REQUIRED"), ["src", "dst"], "left_semi")


def required_by(edge: DataFrame) -> DataFrame:
    """Sorted requirers of each id, one for each edge."""
    return edge.filter(F.col("kind") == "REQUIRED").groupBy("dst").agg(F.sort_array(F.collect_list("src")).alias("required_by"))


def duplicates(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def dependency_graph(mods: DataFrame) -> DataFrame:
    edge, present = edges(mods), mods.select("id").distinct()
    answers = edges(first_by(mods.select("id", "dependencies", "ord"), "id", "ord"))  # the first of an id speaks for it
    return union(
        finding(missing_required(edge, present), "missing_dependency", "ERROR", F.col("src"), say(F.col("src"), "requires", F.col("dst")), target=F.col("dst"), range=F.col("range")),
        finding(incompatible(edge, present, answers), "declared_incompatibility", "ERROR", F.col("src"), say(F.col("src"), "is incompatible with", F.col("dst")), target=F.col("dst"), mutual=F.col("mutual")),
        finding(contradictory(edge, answers), "contradictory_declaration", "ERROR", F.col("src"), say(F.col("dst"), "requires", F.col("src"), "which rejects it"), target=F.col("dst")),
        finding(duplicates(mods), "duplicate_mod_id", "ERROR", F.col("id"), say(F.col("id"), "is declared", F.col("n"), "times"), count=F.col("n")),
    )


def container_facts(containers: DataFrame) -> DataFrame:
    """(mod_id, facts): a container's facts as pairs, its manifest's attributes in order of their names."""
    attributes = F.transform(F.array_sort(F.map_entries(F.coalesce("manifest", F.create_map().cast("map<string,string>")))), lambda e: F.struct(F.concat(F.lit("manifest."), e["key"]).alias("k"), e["value"].alias("v")))
    own = _pairs({"container": F.col("file_name"), "containerKind": F.when(F.col("is_dir"), "directory").otherwise("jar"), "containerBytes": F.col("bytes"), "containerEntries": F.col("entries")}, blanks=False)
    return containers.select("mod_id", F.concat(own, F.filter(attributes, lambda p: F.coalesce(p["v"], F.lit("")) != "")).alias("facts"))


def dependency_records(mods: DataFrame, containers: DataFrame | None = None) -> DataFrame:
    """A record for each mod: what it requires, wants and rejects, what requires it, what is missing, and its container."""
    edge, present = edges(mods), mods.select("id").distinct()
    lists = edge.groupBy("ord").agg(*[_listed(edge, k).alias(n) for k, n in (("REQUIRED", "depends"), ("OPTIONAL", "optional"), ("INCOMPATIBLE", "rejects"))])
    lacking = missing_required(edge, present).groupBy("ord").agg(F.count("*").alias("missing"))
    rows = mods.join(lists, "ord", "left").join(lacking, "ord", "left").join(required_by(edge).withColumnRenamed("dst", "id"), "id", "left")
    if containers is None:
        rows = rows.withColumn("facts", F.array().cast(_PAIRS))
    else:
        rows = rows.join(container_facts(containers), rows["id"] == F.col("mod_id"), "left")
    listed = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    extra = _pairs(
        {
            "loader": F.col("loader"),
            "version": F.col("version"),
            "namespace": F.col("namespace"),
            "minecraftVersion": F.col("minecraft_version"),
            "license": F.col("license"),
            "dependencyCount": F.coalesce(F.array_size("dependencies"), F.lit(0)),
            "dependentsCount": F.coalesce(F.array_size("required_by"), F.lit(0)),
            "missingRequired": F.coalesce("missing", F.lit(0)),
            "dependsOn": listed("depends"),
            "optionalOn": listed("optional"),
            "declaresIncompatible": listed("rejects"),
            "requiredBy": listed("required_by"),
        },
        blanks=False,
    )
    extra = F.concat(extra, F.coalesce("facts", F.array().cast(_PAIRS)))
    return record(rows, "dependency", F.col("namespace"), F.concat(F.lit("dep:"), "id"), F.coalesce("depends", F.array().cast("array<string>")), extra)


# versions and loaders

#: Fixed pairs: which loader can load what was built for another.
CAN_LOAD = (("quilt", "fabric"),)


def cannot_load(mods: DataFrame, running: str | None) -> DataFrame:
    """Mods built for a loader that ``running`` can't load; an unnamed loader, on either side, is no evidence."""
    if running is None:
        return mods.limit(0)
    own = running.lower()
    able = [b for a, b in CAN_LOAD if a == own] + [own]
    return mods.filter(F.col("loader").isNotNull() & (F.trim("loader") != "") & ~F.lower("loader").isin(*able))


def version_checks(mods: DataFrame) -> DataFrame:
    """Each declared range of a present dependency with its verdict; rejections are no question of versions."""
    edge = edges(mods).filter((F.col("kind") != "INCOMPATIBLE") & (F.trim("range") != ""))
    target = first_by(mods.select("id", "version", "ord"), "id", "ord").select(F.col("id").alias("dst"), F.col("version").alias("found"))
    return versions.judged(edge.join(target, "dst"), "found", "range")


def requiring_cycles(mods: DataFrame) -> DataFrame:
    """(loop, subject, length) of each cycle of present requirements that a walk in order of mods closes."""
    at = mods.groupBy("id").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    own = mods.join(at.select("id", F.col("last").alias("ord")), ["id", "ord"], "left_semi")  # of one id the last declares its edges
    present = at.select(F.col("id").alias("dst"))
    edge = edges(own).filter((F.col("kind") == "REQUIRED") & (F.col("src") != F.col("dst"))).join(present, "dst", "left_semi")
    paths = graphs.cycle_paths(edge.select(F.col("src").alias("a"), F.col("dst").alias("b"), "pos"), at.select(F.col("id").alias("node"), F.col("first").alias("ord"))).distinct()
    nodes = F.split("path", " -> ")
    return paths.select(F.col("path").alias("loop"), nodes[0].alias("subject"), (F.size(nodes) - 1).alias("length"))


def built_for(mods: DataFrame, running: str | None) -> tuple[DataFrame, DataFrame]:
    """Mods whose declared range of game versions excludes the running one; and (declared, members, n) of those that name another."""
    told = mods.filter((F.trim("minecraft_version") != "") & F.lit(running is not None)).withColumn("declared", F.trim("minecraft_version"))
    ranged = F.col("declared").contains("[") | F.col("declared").contains("(")
    off = versions.judged(told.filter(ranged).withColumn("_running", F.lit(running)), "_running", "declared").filter(F.col("verdict") == versions.VIOLATED)
    return off, grouped_by(told.filter(~ranged & (F.col("declared") != running)), "declared", "id")


def compatibility(mods: DataFrame, loader: str | None, game_version: str | None) -> DataFrame:
    checked = graphs.cut_lineage(version_checks(mods))
    off, others = built_for(mods, game_version)
    about = {"required_by": F.col("src"), "dependency_kind": F.lower("kind"), "declared_range": F.col("range"), "present_version": F.col("found")}
    return union(
        finding(checked.filter(F.col("verdict") == versions.VIOLATED), "version_out_of_range", "WARN", F.col("dst"), say(F.col("src"), "wants", F.col("dst"), F.col("range"), "but finds", F.col("found")), **about),
        finding(checked.filter(F.col("verdict") == versions.UNKNOWN), "version_range_unreadable", "INFO", F.col("dst"), say(F.col("src"), "wants", F.col("dst"), F.col("range"), "which tells nothing of", F.col("found")), **{k: v for k, v in about.items() if k != "dependency_kind"}),
        finding(requiring_cycles(mods), "requiring_cycle", "WARN", F.col("subject"), say("no order loads", F.col("loop")), loop=F.col("loop"), length=F.col("length")),
        finding(cannot_load(mods, loader), "built_for_another_loader", "WARN", F.col("id"), say(F.col("id"), "is built for", F.col("loader")), built_for=F.col("loader"), running=F.lit(loader), container=F.col("source_file")),
        finding(off, "built_for_another_game_version", "WARN", F.col("id"), say(F.col("id"), "is built for", F.col("declared")), declared=F.col("declared"), running=F.lit(game_version), container=F.col("source_file")),
        finding(others, "built_for_another_game_version", "INFO", F.col("declared"), say(F.col("n"), "mods are built for", F.col("declared")), declared=F.col("declared"), running=F.lit(game_version), count=F.col("n"), mods=F.col("members")),
    )


def grouped_by(rows: DataFrame, key: str, member: str) -> DataFrame:
    """(key, members sorted and joined, n)."""
    return rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(member)), ", ").alias("members"), F.count("*").alias("n"))


# namespaces


def owners(claims: DataFrame) -> DataFrame:
    """(namespace, owner) claims as one row a namespace: sorted owners and their number."""
    return claims.groupBy("namespace").agg(F.sort_array(F.collect_set("owner")).alias("owners")).withColumn("n", F.size("owners"))


def claimed(mods: DataFrame) -> DataFrame:
    """(id, namespaces): a mod claims its own namespace (its id by default) and those it provides."""
    own = F.array_distinct(F.concat(F.array(F.coalesce("namespace", "id")), F.coalesce("providers", F.array().cast("array<string>"))))
    return mods.select("id", F.array_compact(own).alias("namespaces"))


def claims(mods: DataFrame) -> DataFrame:
    return claimed(mods).select(F.col("id").alias("owner"), F.explode("namespaces").alias("namespace"))


def namespace_claims(mods: DataFrame) -> DataFrame:
    taken, who = owners(claims(mods)).filter("n > 1"), F.array_join("owners", ", ")
    none = claimed(mods).filter(F.size("namespaces") == 0)
    return union(
        finding(taken, "namespace_conflict", "ERROR", F.col("namespace"), say(F.col("namespace"), "is claimed by", who), owners=who, count=F.col("n")),
        finding(none, "mod_claims_no_namespace", "INFO", F.col("id"), say(F.col("id"), "claims no namespace")),
    )


def namespace_records(mods: DataFrame) -> DataFrame:
    extra = _pairs({"owners": F.array_join("owners", ", "), "ownerCount": F.col("n"), "conflict": F.col("n") > 1})
    return record(owners(claims(mods)), "namespace", F.col("namespace"), F.concat(F.lit("ns:"), "namespace"), F.col("owners"), extra)


def orphans(observed: DataFrame, claimed: DataFrame, key: str = "namespace") -> DataFrame:
    """Observed namespaces that nobody claims (left anti)."""
    return observed.select(key).distinct().join(claimed.select(key), key, "left_anti")


def orphan_namespaces(observed: DataFrame, mods: DataFrame) -> DataFrame:
    lone = orphans(observed.filter(F.col("namespace") != GLOBAL), claims(mods))
    return finding(lone, "orphan_namespace", "INFO", F.col("namespace"), say("no mod claims", F.col("namespace")))


# containers and mixins


def container_checks(containers: DataFrame, mods: DataFrame) -> DataFrame:
    readable = containers.filter("read_error is null")
    declared = F.try_element_at("manifest", F.lit("MixinConfigs"))
    lost = readable.filter((F.coalesce(F.array_size("mixin_paths"), F.lit(0)) == 0) & declared.isNotNull())
    any_container = containers.agg(F.count("*").alias("known"))  # one row
    bare = mods.select("id").join(containers.select(F.col("mod_id").alias("id")), "id", "left_anti").crossJoin(F.broadcast(any_container)).filter("known > 0")
    return union(
        finding(containers.filter("read_error is not null"), "unreadable_container", "WARN", F.col("mod_id"), say(F.col("file_name"), "can't be read:", F.col("read_error")), container=F.col("file_name"), error=F.col("read_error")),
        finding(readable.filter(F.col("bytes") >= LARGE_CONTAINER), "large_container", "INFO", F.col("mod_id"), say(F.col("file_name"), "has", F.col("bytes"), "bytes"), container=F.col("file_name"), bytes=F.col("bytes"), entries=F.col("entries")),
        finding(lost, "dangling_mixin_declaration", "WARN", F.col("mod_id"), say(F.col("mod_id"), "declares mixin configurations and has none"), declared=declared),
        finding(bare, "no_container", "INFO", F.col("id"), say(F.col("id"), "has no container")),
    )


def shared_targets(entries: DataFrame) -> DataFrame:
    """(target, owner) entries as targets of several owners."""
    return entries.groupBy("target").agg(F.sort_array(F.collect_set("owner")).alias("owners")).filter(F.size("owners") > 1)


def mixin_entries(mixins: DataFrame) -> DataFrame:
    """(target, owner, explicit): an entry without explicit target stands for its own class, a configuration without mod for itself."""
    rows = mixins.select(F.coalesce("mod_id", "source").alias("owner"), F.explode("entries").alias("e"))
    return rows.select(F.coalesce("e.explicit_target", "e.cls").alias("target"), "owner", F.col("e.explicit_target").isNotNull().alias("explicit"))


def mixin_checks(mixins: DataFrame) -> DataFrame:
    entries = mixin_entries(mixins)
    some = lambda f: F.count_if(f(F.col("e.explicit_target")))
    vague = mixins.select("source", F.explode_outer("entries").alias("e")).agg(some(lambda t: t.isNull() & F.col("e").isNotNull()).alias("n"), F.count_distinct("source").alias("configs")).filter("n > 0")
    who = F.array_join("owners", ", ")
    return union(
        finding(shared_targets(entries.filter("explicit")), "shared_mixin_target", "WARN", F.col("target"), say(F.col("target"), "is patched by", who), owners=who, count=F.size("owners")),
        finding(vague, "mixin_targets_uncorrelated", "INFO", F.lit(GLOBAL), say(F.col("n"), "entries name no target"), entries=F.col("n"), totalConfigs=F.col("configs")),
    )


def mixin_records(mixins: DataFrame, mods: DataFrame) -> DataFrame:
    """A record for each configuration, under its mod's namespace."""
    named = first_by(mods.select("id", "namespace", "ord"), "id", "ord").select(F.col("id").alias("mod_id"), "namespace")
    own = F.coalesce("entries", F.array().cast(mixins.schema["entries"].dataType))
    rows = mixins.join(named, "mod_id", "left").withColumn("targets", F.array_distinct(F.transform(own, lambda e: F.coalesce(e["explicit_target"], e["cls"]))))
    extra = _pairs(
        {
            "modId": F.col("mod_id"),
            "config": F.col("source"),
            "package": F.col("package"),
            "compatibilityLevel": F.col("level"),
            "refmap": F.col("refmap"),
            "required": F.coalesce("required", F.lit(False)),
            "mixinClasses": F.size(own),
            "explicitTargets": F.size("targets"),
            "targets": F.array_join("targets", ", "),
        }
    )
    return record(rows, "mixin", F.coalesce("namespace", F.lit(GLOBAL)), F.concat(F.lit("mixin:"), "source"), F.col("targets"), extra)


# coverage


def coverage_records(covered: DataFrame) -> DataFrame:
    """From rows (kind, total, filtered, namespaces, names, by_namespace) of ``routing.coverage``."""
    source = F.when(F.col("kind").isin(*ANALYSIS_KINDS), "analysis").otherwise("registry")
    told = _pairs({"counted": F.col("total"), "filtered": F.col("filtered"), "namespaces": F.col("namespaces"), "source": source})
    extra = F.when(F.col("by_namespace") == "", told).otherwise(F.concat(told, _pairs({"byNamespace": F.col("by_namespace")})))
    return record(covered, F.col("kind"), F.lit(GLOBAL), F.concat(F.lit("coverage:"), "kind"), F.col("names"), extra)


def coverage_findings(totals: DataFrame) -> DataFrame:
    """From one row (counted, filtered, namespaces, kinds)."""
    return union(
        finding(totals.filter("filtered > 0"), "filter_discarded_elements", "INFO", F.lit(GLOBAL), say(F.col("filtered"), "records were filtered"), discarded=F.col("filtered"), kept=F.col("counted")),
        finding(totals, "collection_summary", "INFO", F.lit(GLOBAL), say(F.col("counted"), "records in", F.col("namespaces"), "namespaces"), total=F.col("counted"), namespaces=F.col("namespaces"), categories=F.col("kinds")),
    )


def summary(findings: DataFrame) -> DataFrame:
    """Number of findings of each severity."""
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def shadowed(definitions: DataFrame) -> DataFrame:
    """(id, rank, source, winner, severity): the definitions of each id that give way, and to which.

    Of one rank the smallest source stands and shadows the others (WARN); it is overridden by what
    stands at the next higher rank (INFO). The window runs over an id's ranks, not its definitions.
    """
    heads = definitions.groupBy("id", "rank").agg(F.min("source").alias("head"))
    heads = heads.withColumn("next", F.lead("head").over(Window.partitionBy("id").orderBy("rank")))
    later = F.col("source") != F.col("head")
    rows = definitions.join(heads, ["id", "rank"]).filter(later | F.col("next").isNotNull())
    return rows.select(*definitions.columns, F.when(later, F.col("head")).otherwise(F.col("next")).alias("winner"), F.when(later, "WARN").otherwise("INFO").alias("severity"))
