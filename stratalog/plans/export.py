"""The engine's three entry points: export a catalogue, diagnose it without collecting, report on it.

An export routes the records of every kind, counts them, runs the checks, renders what was accepted
in each format, and writes the shards that differ from the run before. A shard is the records of
one kind, namespace and target in one format, and a file. Everything is a plan over frames, and files
are written, copied and deleted by tasks: what reaches the driver is the settings and one row of totals.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog import schema
from stratalog.functions.names import path_segment
from stratalog.operators import checks, delta, engine, graphs, predicates, routing
from stratalog.schema import GLOBAL

from . import commit, sinks
from .config import Settings, analyses_wanted


@dataclass(frozen=True)
class Catalogue:
    """What an installation has: frames by kind (with an id, a namespace and perhaps tags or values), facts and assets."""

    mods: DataFrame
    kinds: dict[str, DataFrame] = field(default_factory=dict)
    containers: DataFrame | None = None
    mixins: DataFrame | None = None
    assets: DataFrame | None = None  # (namespace, path, source): files to copy
    failures: DataFrame | None = None
    loader: str | None = None
    loader_version: str | None = None
    game_version: str | None = None


@dataclass(frozen=True)
class Report:
    """What a run did: ``artifacts`` (path, format, kind, namespace, target, records, bytes, verdict), findings, failures, counts."""

    artifacts: DataFrame
    findings: DataFrame
    failures: DataFrame
    counts: DataFrame
    removed: DataFrame  # (path) of files that were deleted

    def totals(self) -> DataFrame:
        """One row over all artifacts."""
        return self.artifacts.agg(F.count("*").alias("artifacts"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def _name(df: DataFrame) -> str:
    return next(c for c in ("registry_name", "id", "key") if c in df.columns)


def _tags(df: DataFrame) -> str | None:
    """Tags; a generic record's values stand for them."""
    return next((c for c in ("tags", "values") if c in df.columns), None)


def split_failures(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Records with a name, and those without as failures: one bad record never stops a run."""
    name = F.col(_name(rows))
    bad = name.isNull() | (F.trim(name) == "")
    failed = rows.filter(bad).select(F.lit(kind).alias("kind"), F.coalesce(name, F.lit("")).alias("id"), F.lit("it has no name").alias("error"))
    return rows.filter(~bad), failed


def routed_kinds(catalogue: Catalogue, settings: Settings) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each wanted kind's records with ``accepted``, and the failures."""
    filters = routing.Filters(settings.namespaces, settings.excluded_namespaces, settings.tags, settings.excluded_tags, settings.excluded_mods)
    failures = [catalogue.mods.sparkSession.createDataFrame([], schema.FAILURES)]
    if catalogue.failures is not None:
        failures.append(catalogue.failures)
    mods = catalogue.mods.filter(~F.col("id").isin(*settings.excluded_mods)) if settings.excluded_mods else catalogue.mods
    out = {}
    for kind, rows in {"mod": mods.withColumn("namespace", F.lit(GLOBAL)), **catalogue.kinds}.items():
        if kind not in settings.kinds:
            continue
        good, failed = split_failures(rows, kind)
        failures.append(failed)
        held = _tags(good)
        tags = F.col(held) if held else F.lit(None).cast("array<string>")
        out[kind] = good.withColumn("accepted", filters.accept(F.col("namespace"), tags))
    return out, checks.union(*failures)


def _facts(catalogue: Catalogue, rules: DataFrame | None, counts: DataFrame | None = None, totals: DataFrame | None = None) -> engine.Facts:
    return engine.Facts(catalogue.mods, catalogue.containers, catalogue.mixins, rules, counts, totals, catalogue.loader, catalogue.game_version)


def diagnose(catalogue: Catalogue, names: Iterable[str] = (), rules: DataFrame | None = None) -> DataFrame:
    """Findings of the named checks (all if none is named) on what is known without collecting, in their order."""
    chosen = engine.named(names) + (engine.rule_checks() if rules is not None and not list(names) else [])
    return checks.ordered(engine.run(_facts(catalogue, rules), chosen, engine.PRE, with_records=False).findings)


def counted(routed: dict[str, DataFrame], spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Counts by kind and namespace, and their totals, of all routed records."""
    rows = [r.select(F.lit(k).alias("kind"), "namespace", "accepted") for k, r in routed.items()]
    every = checks.union(*rows) if rows else spark.createDataFrame([], "kind string, namespace string, accepted boolean")
    counts = graphs.cut_lineage(routing.counts(every))
    kept = lambda c: F.count_distinct(F.when(F.col("counted") > 0, F.col(c)))
    none = F.lit(0).cast("long")
    totals = counts.agg(F.coalesce(F.sum("counted"), none).alias("counted"), F.coalesce(F.sum("filtered"), none).alias("filtered"), kept("namespace").alias("namespaces"), kept("kind").alias("kinds"))
    return counts, totals


def _lines(rows: DataFrame, kind: str, form: str, settings: Settings, target: str = "") -> DataFrame:
    """Rendered lines of a kind's accepted records: (kind, target, namespace, part, place, _order, line)."""
    rows = rows.withColumn("_shard", path_segment(F.col("namespace"))).withColumn("_name", F.col(_name(rows)))
    fields = lambda df: [c for c in df.columns if c not in _KEYS]
    if settings.part_bytes:
        keyed = _masked(rows, kind, form, settings)
        text = sinks.FORMATS[form].record(keyed.select(*fields(keyed)), kind)
        parts = graphs.roll_over(keyed.select("_shard", "_name", F.octet_length(text).alias("_size")), "_shard", "_name", "_size", settings.part_bytes).groupBy("_shard", "_name").agg(F.min("part").alias("part"))
        rows = rows.join(parts, ["_shard", "_name"])
    else:
        rows = rows.withColumn("part", F.lit(0))
    keyed = _masked(rows.withColumn("_shard", F.concat_ws("\u0001", "_shard", "part")), kind, form, settings)
    rendered = sinks.rendered(keyed, kind, form, "_shard", "_name", fields(keyed))
    at = F.split("_shard", "\u0001")
    space, part = at[0], at[1].cast("int")
    path = sinks.shard_path(form, kind, space, part, target, settings.package_per_kind, settings.shard_by_namespace)
    return rendered.select(path.alias("path"), F.lit(form).alias("format"), F.lit(sinks.plural(kind)).alias("kind"), F.lit(target).alias("target"), space.alias("namespace"), at[1].alias("part"), "place", "_order", "line")


#: Where a record goes: its shard and its place there.
_KEYS = ("_shard", "_name")


def _masked(rows: DataFrame, kind: str, form: str, settings: Settings) -> DataFrame:
    """The fields of a format: a wiki projection picks its own, the others take the kind's fields that the mask leaves.

    Pairs become an object in JSON, and in the text formats, as all nested values do, one text each.
    """
    own = rows.drop("accepted", "part")
    if form.startswith("wiki"):
        return own
    own = predicates.masked(sinks.projected(own, kind, _KEYS), settings.fields, settings.excluded_fields, (*predicates.IDENTITY, *_KEYS))
    for f in own.schema:
        if f.dataType == schema.PAIRS:
            pairs = F.map_from_entries(f.name) if "json" in form else F.transform(f.name, lambda p: F.concat_ws("=", p["k"], p["v"]))
            own = own.withColumn(f.name, pairs)
        elif "json" not in form and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            own = own.withColumn(f.name, F.transform(f.name, lambda x: F.to_json(x)))
    return own


def _planned(lines: DataFrame) -> DataFrame:
    """(path, …, records, bytes) of the shards that the lines would make."""
    return lines.groupBy("path", *commit.ABOUT).agg(F.count_if(F.col("place").isin(1, 2)).alias("records"), F.sum(F.octet_length("line") + 1).alias("bytes"))


def _commit(lines: DataFrame, assets: DataFrame | None, folder: str, only_changed: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bring a folder to the state that lines and assets describe: (artifacts with verdicts, removed paths, failures).

    The lines are rendered once, into the run's own folder, and counted by the tasks that write them.
    Without ``only_changed`` everything is published and nothing removed; what was there stays in the
    manifest, for a later run to judge.
    """
    spark, run = lines.sparkSession, f".run-{uuid.uuid4().hex}"
    out = commit.Folder(spark, folder)
    try:
        before, complaints = (graphs.cut_lineage(x) for x in commit.previous(out))
        made = graphs.cut_lineage(commit.shards(graphs.cut_lineage(commit.write_beside(graphs.cut_lineage(lines), folder, run))))
        current, failed = made, [complaints]
        if assets is not None:
            told = graphs.cut_lineage(commit.asset_fingerprints(assets, folder))
            failed.append(told.filter("error is not null").select(F.lit("asset").alias("kind"), F.col("path").alias("id"), "error"))
            files = told.filter("error is null").select("path", F.lit("asset").alias("format"), F.lit("asset").alias("kind"), F.lit("").alias("target"), "namespace", F.lit("0").alias("part"), F.lit(0).cast("long").alias("records"), "bytes", "fingerprint")
            current = made.drop("pieces").unionByName(files)
        judged = graphs.cut_lineage(delta.verdicts(before, current.select("path", "fingerprint")))
        due = judged.filter(F.col("verdict") != delta.REMOVED).select("path")
        if only_changed:
            unchanged = judged.filter(F.col("verdict") == delta.UNCHANGED)
            due = delta.to_write(judged, commit.there(unchanged, folder)).select("path")
        due = graphs.cut_lineage(due)
        done = graphs.cut_lineage(commit.publish(made.join(due, "path", "left_semi"), folder))
        if assets is not None:
            done = done.unionByName(graphs.cut_lineage(commit.publish_assets(told.filter("error is null").join(due, "path", "left_semi"), folder)))
        gone = judged.filter(F.col("verdict") == delta.REMOVED).select("path")
        removed = graphs.cut_lineage(commit.remove(gone if only_changed else gone.limit(0), folder))
        broken = done.filter("error is not null").unionByName(removed.filter("error is not null"))
        # a file that could not be replaced or deleted keeps its entry
        kept = before.join(broken, "path", "left_semi") if only_changed else before.join(broken, "path", "left_semi").union(before.join(gone, "path", "left_semi")).distinct()
        commit.write_manifest(out, current.select("path", "fingerprint").join(broken, "path", "left_anti").unionByName(kept))
        failed.append(broken.select(F.lit("artifact").alias("kind"), F.col("path").alias("id"), "error"))
        artifacts = current.drop("fingerprint", "pieces").join(judged.filter(F.col("verdict") != delta.REMOVED), "path")
        return artifacts, removed.filter("error is null").select("path"), checks.union(*failed)
    finally:
        out.delete(run)


def export(catalogue: Catalogue, folder: str, settings: Settings | None = None, targets: dict[str, tuple[str, predicates.Selector]] | None = None, rules: DataFrame | None = None, dry_run: bool = False) -> Report:
    """Write the catalogue below ``folder`` (analyses in the sibling folder ``analysis``), or with ``dry_run`` only say what would be written.

    With ``settings.delta`` only shards and assets that are new, changed or lost are written, and those
    that no longer exist are deleted; then the manifest takes the place of the one before.
    """
    spark, settings = catalogue.mods.sparkSession, settings or Settings()
    routed, failures = routed_kinds(catalogue, settings)
    counts, totals = counted(routed, spark)
    found = spark.createDataFrame([], schema.FINDINGS)
    rendered: dict[tuple[str, str], list[DataFrame]] = {}
    accepted = {k: r.filter("accepted") for k, r in routed.items()}
    for form in settings.formats:
        for kind, rows in accepted.items():
            if not sinks.supports(form, kind, settings.wiki_blocks):
                continue
            rendered.setdefault((form, folder), []).append(_lines(rows, kind, form, settings))
            for name, (of, selector) in (targets or {}).items():
                if of == kind:
                    held = _tags(rows)
                    hit = selector.matches(F.col(_name(rows)), F.col("namespace"), F.col(held) if held else F.lit(None).cast("array<string>"))
                    rendered[form, folder].append(_lines(rows.filter(hit), kind, form, settings, name.translate(str.maketrans(":/\\", "___"))))
    if settings.analyze:
        found, records = engine.run(_facts(catalogue, rules, counts, totals))
        every = records.unionByName(checks.finding_records(found))
        beside = f"{folder.rstrip('/').rsplit('/', 1)[0]}/analysis" if settings.analysis_separate else folder
        for form in settings.formats:
            for kind in analyses_wanted(settings.kinds):
                if sinks.supports(form, kind):
                    rendered.setdefault((form, beside), []).append(_lines(every.filter(F.col("kind") == kind).drop("kind"), kind, form, settings))
    by_folder: dict[str, list[DataFrame]] = {folder: []} if catalogue.assets is not None else {}
    for (_, at), lines in rendered.items():
        by_folder.setdefault(at, []).extend(lines)
    if dry_run:
        parts = [_planned(checks.union(*lines)).withColumn("verdict", F.lit("DRY")) for lines in by_folder.values() if lines]
        return Report(checks.union(*parts), found, failures, counts, spark.createDataFrame([], "path string"))
    done = []
    for at, lines in by_folder.items():
        every = checks.union(*lines) if lines else spark.createDataFrame([], _LINES)
        done.append(_commit(every, catalogue.assets if at == folder else None, at, settings.delta))
    artifacts, removed, failed = (checks.union(*x) for x in zip(*done, strict=True))
    return Report(artifacts, found, failures.unionByName(failed), counts, removed)


_LINES = "path string, format string, kind string, target string, namespace string, part string, place int, _order string, line string"


def report(catalogue: Catalogue, findings: DataFrame, names: Collection[str] = ()) -> DataFrame:
    """(n, line) of the text report, in order."""
    header = {"loader": f"{catalogue.loader or ''} {catalogue.loader_version or ''}".strip(), "game": catalogue.game_version or "", "mods": catalogue.mods.count(), "checks": ", ".join(names) or "all"}
    return sinks.report_text(findings, header)
