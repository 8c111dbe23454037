"""Incremental runs: fingerprints, verdicts, and what a run changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEW, CHANGED, UNCHANGED, REMOVED = "NEW", "CHANGED", "UNCHANGED", "REMOVED"


def fingerprint(content: Column, twice: bool = False) -> Column:
    """SHA-256 in hex; of an artifact of several parts, that of the digest."""
    once = F.sha2(content, 256)
    return F.sha2(once, 256) if twice else once


def well_formed(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def verdicts(previous: DataFrame, current: DataFrame, path: str = "path", mark: str = "fingerprint") -> DataFrame:
    """(path, verdict) over both snapshots: one full outer join."""
    a = previous.select(path, F.col(mark).alias("_before"))
    b = current.select(path, F.col(mark).alias("_after"))
    verdict = F.when(F.col("_after").isNull(), REMOVED).when(F.col("_before").isNull(), NEW).when(F.col("_before") == F.col("_after"), UNCHANGED).otherwise(CHANGED)
    return a.join(b, path, "full_outer").select(path, verdict.alias("verdict"))


def to_write(judged: DataFrame, existing: DataFrame, path: str = "path") -> DataFrame:
    """All new and changed paths, and unchanged ones whose file is gone."""
    there = existing.select(path).distinct().withColumn("_there", F.lit(True))
    lost = (F.col("verdict") == UNCHANGED) & F.col("_there").isNull()
    return judged.join(there, path, "left").filter(F.col("verdict").isin(NEW, CHANGED) | lost).select(path, "verdict")


def change_summary(judged: DataFrame) -> DataFrame:
    """Counts by verdict, and a consumer's workload: all that is not as before."""
    n = {v: F.count_if(F.col("verdict") == v) for v in (NEW, CHANGED, UNCHANGED, REMOVED)}
    return judged.agg(*[c.alias(v.lower()) for v, c in n.items()], (n[NEW] + n[CHANGED] + n[REMOVED]).alias("workload"))


#: First line of a manifest.
HEADER = "snapshot 1"


def read_snapshot(lines: DataFrame, header: str = HEADER) -> DataFrame:
    """(value, line number) rows of a manifest as (path, fingerprint, ord).

    Without the header there is no snapshot. Comments and lines that are not ``sha<TAB>path`` are
    skipped; of a path given twice the later line counts.
    """
    known = lines.filter((F.col("n") == 0) & (F.col("value") == header)).limit(1)
    parts = F.split("value", "\t", 2)
    rows = lines.filter(F.col("n") > 0).filter(~F.col("value").startswith("//")).select("n", F.get(parts, F.lit(0)).alias("fingerprint"), F.get(parts, F.lit(1)).alias("path"))
    rows = rows.filter(well_formed(F.col("fingerprint")) & (F.coalesce(F.col("path"), F.lit("")) != ""))
    return rows.join(F.broadcast(known.select(F.lit(1).alias("_known"))), F.lit(True), "left_semi").groupBy("path").agg(F.max_by("fingerprint", "n").alias("fingerprint"))


def complaints(lines: DataFrame, header: str = HEADER) -> DataFrame:
    """(complaint): what in a manifest's (value, n) rows is no header, no entry or no fingerprint, or repeats a path."""
    parts = F.split("value", "\t", 2)
    mark, path = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    entries = lines.filter((F.col("n") > 0) & (F.trim("value") != "") & ~F.trim("value").startswith("//"))
    kind = F.when((path == "") | (mark == ""), "is not an entry, and was skipped").when(~well_formed(mark), "has a fingerprint that is not one, and was skipped")
    bad = entries.withColumn("why", kind).filter("why is not null").select(F.concat_ws(" ", F.lit("the line"), F.concat(F.lit("'"), F.substring("value", 1, 80), F.lit("'")), "why").alias("complaint"))
    twice = entries.filter(kind.isNull()).groupBy(path.alias("path")).count().filter("count > 1").select(F.concat(F.lit("the path "), "path", F.lit(" is repeated, and the later entry wins")).alias("complaint"))
    known = lines.filter((F.col("n") == 0) & (F.col("value") == header)).agg(F.count("*").alias("n")).filter("n = 0")
    return bad.union(twice).union(known.select(F.lit("the manifest has no header of this format, so this run is treated as the first")))


def manifest_lines(current: DataFrame) -> DataFrame:
    """Lines of a manifest, in order of paths."""
    return current.orderBy("path").select(F.concat_ws("\t", "fingerprint", "path").alias("value"))
