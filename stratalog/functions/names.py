"""Identifiers, resource paths and file names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_NAMESPACE = "minecraft"
#: Words that other loaders use for a dependency's kind.
DEPENDENCY_KINDS = {
    "required": "REQUIRED", "require": "REQUIRED", "depends": "REQUIRED", "mandatory": "REQUIRED",
    "optional": "OPTIONAL", "recommends": "OPTIONAL", "recommend": "OPTIONAL", "suggests": "OPTIONAL", "suggest": "OPTIONAL", "breaks_but_ok": "OPTIONAL",
    "incompatible": "INCOMPATIBLE", "breaks": "INCOMPATIBLE", "conflicts": "INCOMPATIBLE", "conflict": "INCOMPATIBLE",
    "embedded": "EMBEDDED", "include": "EMBEDDED", "included": "EMBEDDED", "bundled": "EMBEDDED",
}


def namespace_of(name: Column) -> Column:
    """What precedes the first colon, or the default namespace."""
    at = F.instr(name, ":")
    return F.when(at > 1, F.substring(name, F.lit(1), at - 1)).otherwise(F.when(name.isNotNull(), F.lit(DEFAULT_NAMESPACE)))


def path_of(name: Column) -> Column:
    """What follows the first colon, or the whole name."""
    at = F.instr(name, ":")
    return F.when(at > 0, F.substring(name, at + 1, F.length(name))).otherwise(name)


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def path_segment(text: Column) -> Column:
    """Safe as one segment of a path."""
    return F.translate(text, ":/\\", "___")


def part_name(name: Column, part: Column) -> Column:
    """File name of a shard's part: the first keeps its name, then -p2, -p3 and so on before the extension."""
    return F.when(part == 0, name).otherwise(F.regexp_replace(name, F.lit(r"^(.*?)(\.[^.]*)?$"), F.concat(F.lit("$1-p"), (part + 1).cast("string"), F.lit("$2"))))


def dependency(text: Column) -> Column:
    """``id@range`` as a struct; without an at sign there is no range."""
    parts = F.split(text, "@", 2)
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("id"), blank_to_null(F.trim(F.get(parts, F.lit(1)))).alias("range"))


def dependency_kind(word: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in DEPENDENCY_KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(word))), F.lit("UNKNOWN"))


def _within(path: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))


def tag_type(path: Column) -> Column:
    return _within(path, r"^/?tags/([^/]+)/")


def tag_path(path: Column) -> Column:
    return _within(path, r"^/?tags/[^/]*/(.+?)(?:\.json)?$")


def loot_path(path: Column) -> Column:
    return _within(path, r"^/?loot_table/(.+?)(?:\.json)?$")


def advancement_path(path: Column) -> Column:
    return _within(path, r"^/?advancement/(.+?)(?:\.json)?$")


def function_path(path: Column) -> Column:
    return _within(path, r"^/?function/(.+)\.mcfunction$")


def locale(path: Column) -> Column:
    return _within(path, r"^/?lang/([^/]+)\.json$")


def worldgen_kind(path: Column) -> Column:
    return _within(path, r"^/?worldgen/([^/]+)/")


def worldgen_path(path: Column) -> Column:
    return _within(path, r"^/?worldgen/[^/]*/(.+?)(?:\.json)?$")


def utf16(text: Column) -> Column:
    """A sort key by UTF-16 code units: Spark orders text by UTF-8, where what lies beyond U+FFFF comes after U+E000 to U+FFFF."""
    return F.encode(text, "UTF-16BE")


#: Ranges of characters that take two columns of text.
WIDE = "\u1100-\u115f\u2e80-\ua4cf\uac00-\ud7a3\uf900-\ufaff\ufe30-\ufe6f\uff00-\uff60"


def display_width(text: Column) -> Column:
    """Columns that a text takes: two for a full-width character, one for any other, none for null; beyond U+FFFF there are two units of one."""
    count = lambda chars: F.length(text) - F.length(F.regexp_replace(text, chars, ""))
    return F.coalesce(F.length(text) + count(f"[{WIDE}]") + count(r"[\x{10000}-\x{10FFFF}]"), F.lit(0))


FALLBACK_LOCALE = "en_us"


def locale_chain(locale: str | None) -> list[str]:
    """Locales in which a text is looked for, in turn: the one wanted, its language alone, the fallback."""
    wanted = (locale or "").strip().lower()
    language = wanted.split("_")[0] if wanted.find("_") > 0 else ""
    return list(dict.fromkeys(x for x in (wanted, language, FALLBACK_LOCALE) if x))


def json_number(value: Column) -> Column:
    """A double as JSON text: without a fraction where it is whole and below 1e15."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
