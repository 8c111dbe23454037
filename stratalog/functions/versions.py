"""Version ranges in three-valued logic, as column expressions.

A comparison that cannot be ordered is incomparable; a range check answers SATISFIED, VIOLATED or
UNKNOWN. Everything stays in the JVM: versions are split into arrays, compared part by part with
``zip_with`` and folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SATISFIED, VIOLATED, UNKNOWN = "SATISFIED", "VIOLATED", "UNKNOWN"
INCOMPARABLE = 9
_SEPARATOR = "\u0001"


def _parts(version: Column) -> Column:
    """Lower case, without a leading v and what a plus begins, cut at dots and dashes; empty ends drop."""
    text = F.regexp_replace(F.lower(version), "^v", "")
    text = F.substring_index(text, "+", 1)
    kept = F.regexp_replace(text, r"[.\-]+$", "")
    return F.when((kept == "") & (text != ""), F.array().cast("array<string>")).otherwise(F.split(kept, r"[.\-]"))


def _numeric(part: Column) -> Column:
    return part.rlike(r"^[0-9]{1,18}$")


def _order(x: Column, y: Column) -> Column:
    """-1, 0 or 1 of two parts, or INCOMPARABLE; a missing part counts as zero beside a number."""
    sign = lambda a, b: F.when(a < b, -1).when(a > b, 1).otherwise(0)
    numbers = sign(F.try_to_number(x, F.lit("999999999999999999")), F.try_to_number(y, F.lit("999999999999999999")))
    return F.when(_numeric(x) & _numeric(y), numbers).when(~_numeric(x) & ~_numeric(y), sign(x, y)).otherwise(INCOMPARABLE)


def compare(a: Column, b: Column) -> Column:
    """-1, 0, 1, or INCOMPARABLE; the first part that differs decides."""
    filled = F.zip_with(_parts(a), _parts(b), lambda x, y: _order(F.when(x.isNull() & _numeric(y), "0").otherwise(x), F.when(y.isNull() & _numeric(x), "0").otherwise(y)))
    return F.aggregate(filled, F.lit(0), lambda s, c: F.when(s == 0, F.coalesce(c, F.lit(INCOMPARABLE))).otherwise(s))


def _wildcard(spec: Column) -> Column:
    return spec.rlike(r"\.[xX*+]$")


def _prefix(version: Column, spec: Column) -> Column:
    return F.when(version.startswith(F.concat(F.expr("''"), F.substring(spec, F.lit(1), F.length(spec) - 2), F.lit("."))), SATISFIED).otherwise(VIOLATED)


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` reads it."""
    return F.transform(F.array(value), f)[0]


def _bound(version: Column, spec: Column, order: Column, wrong: int, open_: Column) -> Column:
    """Null where the bound holds, else the verdict that it settles; ``order`` is that of the version and the bound."""
    plain = F.when(order == INCOMPARABLE, UNKNOWN).when((order == wrong) | ((order == 0) & open_), VIOLATED)
    return F.when(spec == "", F.lit(None).cast("string")).when(_wildcard(spec), _prefix(version, spec)).otherwise(plain)


def check_interval(version: Column, interval: Column) -> Column:
    first, last = F.substring(interval, 1, 1), F.substring(interval, -1, 1)
    bracketed = first.isin("[", "(")
    body = F.when(bracketed, F.substring(interval, F.lit(2), F.length(interval) - 2)).otherwise(interval)

    def cut(t: Column) -> Column:
        comma = F.instr(t, ",")
        low, high = F.trim(F.substring(t, F.lit(1), F.greatest(comma - 1, F.lit(0)))), F.trim(F.substring(t, comma + 1, F.length(t)))
        return F.struct(comma.alias("comma"), low.alias("low"), high.alias("high"))  # without a comma, high is the whole

    def verdict(p: Column) -> Column:
        orders = F.struct(F.when(p["comma"] > 0, compare(version, p["low"])).alias("low"), compare(version, p["high"]).alias("high"))
        return _let(F.struct(p["comma"].alias("comma"), p["low"].alias("low"), p["high"].alias("high"), orders.alias("order")), settled)

    def settled(p: Column) -> Column:
        single = p["high"]
        exact = F.when(single == "", UNKNOWN).when(_wildcard(single), _prefix(version, single)).when(p["order"]["high"] == 0, SATISFIED).otherwise(VIOLATED)
        ranged = F.coalesce(_bound(version, p["low"], p["order"]["low"], -1, first == "("), _bound(version, p["high"], p["order"]["high"], 1, last == ")"), F.lit(SATISFIED))
        return F.when(p["comma"] == 0, exact).otherwise(ranged)

    broken = (interval == "") | (bracketed & ~last.isin("]", ")")) | (~bracketed & interval.contains(","))
    return F.when(broken, UNKNOWN).otherwise(_let(_let(body, cut), verdict))


def intervals(wanted: Column) -> Column:
    """Cut at commas outside brackets; without a bracket there is one interval."""
    step = lambda s, c: F.struct(
        F.when(c.isin("[", "("), s["depth"] + 1).when(c.isin("]", ")"), s["depth"] - 1).otherwise(s["depth"]).alias("depth"),
        F.concat(s["out"], F.when((c == ",") & (s["depth"] <= 0), _SEPARATOR).otherwise(c)).alias("out"),
    )
    cut = F.aggregate(F.split(wanted, ""), F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")), step, lambda s: s["out"])
    return F.when(wanted.rlike(r"[\[(]"), F.transform(F.split(cut, _SEPARATOR), lambda x: F.trim(x))).otherwise(F.array(wanted))


def check(version: Column, wanted: Column) -> Column:
    """Any satisfied interval wins; else VIOLATED if one was violated; else UNKNOWN."""
    version, wanted = F.trim(version), F.trim(wanted)
    verdicts = F.transform(intervals(wanted), lambda i: check_interval(version, i))
    found = _let(verdicts, lambda v: F.when(F.array_contains(v, SATISFIED), SATISFIED).when(F.array_contains(v, VIOLATED), VIOLATED).otherwise(UNKNOWN))
    return F.when(F.coalesce(wanted, F.lit("")) == "", UNKNOWN).when(F.coalesce(version, F.lit("")) == "", UNKNOWN).when((wanted == "*") | (F.lower(wanted) == "any"), SATISFIED).otherwise(found)


def judged(rows: DataFrame, version: str, wanted: str) -> DataFrame:
    """``rows`` with the column ``verdict``: each distinct pair of version and range is judged once and joined back."""
    pairs = rows.select(F.col(version).alias("_version"), F.col(wanted).alias("_wanted")).distinct()
    pairs = pairs.withColumn("verdict", check(F.col("_version"), F.col("_wanted")))
    met = rows.join(pairs, F.col(version).eqNullSafe(F.col("_version")) & F.col(wanted).eqNullSafe(F.col("_wanted")), "left")
    return met.drop("_version", "_wanted")
