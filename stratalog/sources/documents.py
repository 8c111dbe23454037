"""Pack documents (tags, loot tables, advancements, world generation, functions, languages) as columns.

JSON goes through Variant; only the recursive loot walk and the line folding of functions use
Python, as small Arrow-batched helpers. A document that is not what its kind needs gives null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.functions.names import dependency_kind

#: Fields of world generation documents that refer to others, and that are counted.
REFERENCES = ("feature", "fallback", "start_pool", "preset")
COUNTED = ("elements", "processors")
WORLDGEN_KINDS = (
    "biome configured_carver configured_feature density_function flat_level_generator_preset multi_noise_biome_source_parameter_list noise "
    "noise_settings placed_feature processor_list structure structure_set template_pool world_preset feature"
).split()


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def _at(root: Column, path: str) -> Column:
    return F.try_variant_get(root, path, "variant")


def _text(root: Column, path: str) -> Column:
    """A string at the path, nothing else."""
    return F.when(_type(_at(root, path)) == "STRING", F.try_variant_get(root, path, "string"))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(_type(v).startswith(kind), F.lit(False))


def _items(v: Column) -> Column:
    return F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def parsed(content: Column) -> Column:
    return F.try_parse_json(content)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once a row: by itself an expression is computed anew in each branch and field that names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tag(content: Column) -> Column:
    """(replace, entries of (id, nested, required)); a lone value counts as a list of one."""
    return once(parsed(content), _tag)


def _tag(root: Column) -> Column:
    values = _at(root, "$.values")

    def entry(x: Column) -> Column:
        raw = F.trim(F.coalesce(F.when(_is(x, "STRING"), F.try_variant_get(x, "$", "string")), _text(x, "$.id")))
        nested = raw.startswith("#")
        name = F.when(nested, F.trim(F.substring(raw, F.lit(2), F.length(raw)))).otherwise(raw)
        required = F.coalesce(F.when(_type(_at(x, "$.required")) == "BOOLEAN", F.try_variant_get(x, "$.required", "boolean")), F.lit(True))
        return F.when(F.coalesce(name, F.lit("")) != "", F.struct(name.alias("id"), nested.alias("nested"), required.alias("required")))

    listed = F.coalesce(_items(values), F.when(values.isNotNull() & ~_is(values, "VOID"), F.array(values)), F.array().cast("array<variant>"))
    replace = F.coalesce(F.when(_type(_at(root, "$.replace")) == "BOOLEAN", F.try_variant_get(root, "$.replace", "boolean")), F.lit(False))
    return F.when(_is(root, "OBJECT"), F.struct(replace.alias("replace"), F.array_compact(F.transform(listed, entry)).alias("entries")))


def language(content: Column) -> Column:
    """Scalar entries as (key, value), sorted by key; empty keys drop."""
    entries = F.map_entries(F.from_json(content, "map<string,variant>"))
    plain = F.filter(entries, lambda e: (e["key"] != "") & e["value"].isNotNull() & ~_is(e["value"], "OBJECT") & ~_is(e["value"], "ARRAY") & ~_is(e["value"], "VOID"))
    return F.when(_is(parsed(content), "OBJECT"), F.array_sort(F.transform(plain, lambda e: F.struct(e["key"].alias("key"), F.try_variant_get(e["value"], "$", "string").alias("value")))))


def advancement(content: Column) -> Column:
    """Display texts, icon, frame, distinct triggers in order, and counts of criteria and rewards."""
    return once(content, lambda c: once(parsed(c), lambda root: F.when(_is(root, "OBJECT"), once(F.map_values(F.from_json(c, "criteria map<string,variant>")["criteria"]), lambda criteria: _advancement(root, criteria)))))


def _advancement(root: Column, criteria: Column) -> Column:
    triggers = F.array_distinct(F.filter(F.transform(criteria, lambda c: _text(c, "$.trigger")), lambda t: F.coalesce(t, F.lit("")) != ""))
    text = lambda p: F.coalesce(_text(root, f"$.display.{p}.text"), _text(root, f"$.display.{p}.translate"))
    display = _at(root, "$.display")
    return F.struct(
        F.coalesce(_is(display, "OBJECT") & (_type(display) != "OBJECT<>"), F.lit(False)).alias("has_display"),
        F.nullif(_text(root, "$.parent"), F.lit("")).alias("parent"),
        text("title").alias("title"),
        text("description").alias("description"),
        F.coalesce(_text(root, "$.display.icon.id"), _text(root, "$.display.icon.item")).alias("icon"),
        F.coalesce(_text(root, "$.display.frame"), F.lit("")).alias("frame"),
        F.coalesce(F.try_variant_get(root, "$.display.hidden", "boolean"), F.lit(False)).alias("hidden"),
        F.coalesce(triggers, F.array().cast("array<string>")).alias("triggers"),
        F.coalesce(F.size(criteria), F.lit(0)).alias("criteria"),
        F.coalesce(F.size(_items(_at(root, "$.rewards.recipes"))), F.lit(0)).alias("reward_recipes"),
        F.coalesce(F.try_variant_get(root, "$.rewards.experience", "int"), F.lit(0)).alias("experience"),
    )


def worldgen(kind: Column, content: Column) -> Column:
    """Type, references, counts of lists, a scalar document as ``constant``, and whether the kind is known."""
    return once(parsed(content), lambda root: _worldgen(kind, root))


def _worldgen(kind: Column, root: Column) -> Column:
    whole = _is(root, "OBJECT")
    structures = F.transform(F.coalesce(_items(_at(root, "$.structures")), F.array().cast("array<variant>")), lambda x: F.coalesce(F.when(_is(x, "STRING"), F.try_variant_get(x, "$", "string")), _text(x, "$.structure")))
    refs = F.concat(F.array(*[_text(root, f"$.{f}") for f in REFERENCES]), structures)
    count = lambda f: F.struct(F.lit(f).alias("k"), F.size(_items(_at(root, f"$.{f}"))).alias("n"))
    scalar = root.isNotNull() & ~whole & ~_is(root, "ARRAY") & ~_is(root, "VOID")
    return F.when(
        whole | scalar,
        F.struct(
            F.coalesce(_text(root, "$.type"), F.lit("")).alias("type"),
            F.array_distinct(F.filter(refs, lambda r: F.coalesce(r, F.lit("")) != "")).alias("references"),
            F.filter(F.array(*[count(f) for f in COUNTED]), lambda c: F.coalesce(c["n"], F.lit(-1)) >= 0).alias("counts"),
            F.when(scalar, F.try_variant_get(root, "$", "string")).otherwise("").alias("constant"),
            kind.isin(*WORLDGEN_KINDS).alias("recognised"),
        ),
    )


# the recursive and the stateful parsers

DEEPEST = 32
_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()
_LIST = T.ArrayType(_S)
LOOT = T.StructType([T.StructField(n, t) for n, t in (("type", _S), ("items", _LIST), ("tags", _LIST), ("tables", _LIST), ("pools", _I), ("entries", _I), ("conditional", _B))])


def _loot(content: str | None) -> dict | None:
    try:
        root = json.loads(content or "")
    except ValueError:
        return None
    if not isinstance(root, dict):
        return None
    out: dict = {k: {} for k in ("items", "tags", "tables")}
    listed = lambda x: x if isinstance(x, list) else []
    pools = listed(root.get("pools"))
    own = [p for p in pools if isinstance(p, dict)]
    conditional, n = any("conditions" in p for p in own), 0
    open_ = [(0, e) for p in reversed(own) for e in reversed(listed(p.get("entries")))]
    while open_:  # depth first, in order
        depth, e = open_.pop()
        if depth >= DEEPEST or not isinstance(e, dict):
            continue
        n += 1
        conditional |= "conditions" in e
        name, kind, value = e.get("name"), e.get("type"), e.get("value")
        if isinstance(name, str) and name and kind != "minecraft:dynamic":
            out["tags" if kind == "minecraft:tag" else "items"]["#" + name if kind == "minecraft:tag" else name] = True
        if isinstance(value, str) and value:
            out["tables"][value] = True
        inner = [c for p in listed(value.get("pools")) if isinstance(p, dict) for c in listed(p.get("entries"))] if isinstance(value, dict) else []
        open_ += [(depth + 1, c) for c in reversed(inner + listed(e.get("children")))]
    kind = root.get("type")
    return {k: list(v) for k, v in out.items()} | {"type": kind if isinstance(kind, str) else "", "pools": len(pools), "entries": n, "conditional": conditional}


@F.pandas_udf(LOOT)
def loot(contents: pd.Series) -> pd.DataFrame:
    """What a loot table drops: a walk over nested entries, children and inline tables."""
    return pd.DataFrame([_loot(c) or dict.fromkeys(LOOT.names) for c in contents], columns=LOOT.names)


FUNCTION = T.StructType([T.StructField(n, t) for n, t in (("commands", _I), ("comments", _I), ("macros", _I), ("functions", _LIST), ("tags", _LIST), ("dynamic", _LIST), ("lines", _I), ("unterminated", _B))])
_ID = re.compile(r"[a-z0-9_.\-/][a-z0-9_.\-:/]*:[a-z0-9_.\-:/]+|[a-z0-9_.\-/]+:[a-z0-9_.\-:/]+")
_BEFORE_CALL = ("run", "schedule")


def _tokens(command: str) -> list[str]:
    """Cut at blanks outside quotes; the quotes themselves go."""
    pieces = command.split('"')
    marked = "".join(p if i % 2 else re.sub(r"[ \t]", "\0", p) for i, p in enumerate(pieces))
    return [t for t in marked.split("\0") if t]


def _function(text: str | None) -> dict | None:
    if text is None:
        return None
    raw = text.replace("\r", "").split("\n")
    lines = raw[:-1] if raw and raw[-1] == "" else raw
    out = {"commands": 0, "comments": 0, "macros": 0, "lines": len(lines), "unterminated": False}
    calls: dict = {k: {} for k in ("functions", "tags", "dynamic")}
    held, open_ = "", False
    for n, line in enumerate(map(str.strip, lines)):
        if line.endswith("\\"):
            held, open_ = held + line[:-1], True
            if n < len(lines) - 1:
                continue
            out["unterminated"] = True
            line = held
        else:
            line = held + line
        held, line, open_ = "", line.strip(), False
        if not line or line[0] == "/":
            continue
        if line[0] == "#":
            out["comments"] += 1
            continue
        out["macros" if line[0] == "$" else "commands"] += 1
        tokens = _tokens(line[1:].strip() if line[0] == "$" else line)
        for i, (word, name) in enumerate(zip(tokens, tokens[1:], strict=False)):
            if word != "function" or (i and tokens[i - 1] not in _BEFORE_CALL):
                continue
            if name.startswith("#"):
                if name[1:]:
                    calls["tags"][name[1:]] = True
            elif _ID.fullmatch(name):
                calls["functions"][name] = True
            elif "$(" in name:
                calls["dynamic"][name] = True
    return out | {k: list(v) for k, v in calls.items()}


@F.pandas_udf(FUNCTION)
def function(texts: pd.Series) -> pd.DataFrame:
    """Counts of commands, comments and macros of a function, and what it calls; backslashes join lines."""
    return pd.DataFrame([_function(t) or dict.fromkeys(FUNCTION.names) for t in texts], columns=FUNCTION.names)


def _as(kind: str):
    return lambda e: F.struct(e["key"].alias("id"), e["value"].alias("range"), F.lit(kind).alias("kind"))


_ENTRIES = "array<struct<key:string,value:string>>"


def _strings(root: Column, path: str) -> Column:
    listed = F.transform(F.coalesce(_items(_at(root, path)), F.array().cast("array<variant>")), lambda x: F.when(_is(x, "STRING"), F.try_variant_get(x, "$", "string")))
    return F.array_compact(listed)


def descriptors(files: DataFrame) -> DataFrame:
    """(path, content) of mod descriptors as facts: (path, id, name, version, dependencies, providers, mixins).

    One loader keeps maps of ids and ranges, or lists of ids, under several names; the other nests
    all under ``quilt_loader`` and lists what it requires and provides. Documents without id are left out.
    """
    files = files.select("path", parsed(F.col("content")).alias("root"))  # many columns use it, so Spark leaves it one
    root = F.col("root")
    nested = _at(root, "$.quilt_loader")
    is_nested = _is(nested, "OBJECT")
    kinds = {"depends": "REQUIRED", "recommends": "OPTIONAL", "suggests": "OPTIONAL", "conflicts": "INCOMPATIBLE", "breaks": "INCOMPATIBLE"}
    parts = []
    for field, kind in kinds.items():
        pairs = F.filter(F.map_entries(F.try_variant_get(root, f"$.{field}", "map<string,variant>")), lambda e: e["key"] != "")
        text = lambda v: F.coalesce(F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string")), F.to_json(v))
        mapped = F.transform(pairs, lambda e: F.struct(e["key"].alias("key"), F.when(~_is(e["value"], "VOID"), text(e["value"])).alias("value")))
        listed = F.transform(F.filter(_strings(root, f"$.{field}"), lambda x: x != ""), lambda x: F.struct(x.alias("key"), F.lit(None).cast("string").alias("value")))
        entries = F.coalesce(F.when(_is(_at(root, f"$.{field}"), "OBJECT"), mapped), listed).cast(_ENTRIES)
        parts.append(F.transform(entries, _as(kind)))
    needs = F.transform(F.coalesce(_items(_at(nested, "$.depends")), F.array().cast("array<variant>")), lambda x: F.struct(_text(x, "$.id").alias("key"), F.try_variant_get(x, "$.versions", "string").alias("value")))
    needs = F.transform(F.filter(needs, lambda e: e["key"].isNotNull()).cast(_ENTRIES), _as("REQUIRED"))
    gives = F.array_compact(F.transform(F.coalesce(_items(_at(nested, "$.provides")), F.array().cast("array<variant>")), lambda x: F.coalesce(_text(x, "$.id"), F.when(_is(x, "STRING"), F.try_variant_get(x, "$", "string")))))
    pick = lambda a, b: F.when(is_nested, a).otherwise(b)
    rows = files.filter(_is(root, "OBJECT")).select(
        "path",
        pick(_text(nested, "$.id"), _text(root, "$.id")).alias("id"),
        pick(_text(nested, "$.metadata.name"), _text(root, "$.name")).alias("name"),
        pick(_text(nested, "$.version"), _text(root, "$.version")).alias("version"),
        pick(needs, F.concat(*parts)).alias("dependencies"),
        pick(gives, F.array().cast("array<string>")).alias("providers"),
        pick(_strings(nested, "$.metadata.mixins"), _strings(root, "$.mixins")).alias("mixins"),
    )
    return rows.filter(F.coalesce("id", F.lit("")) != "")


def loader_dependencies(rows: DataFrame, loader: str) -> DataFrame:
    """(id, range, type, mandatory) entries with ``kind``: what each loader says of how much it needs another mod.

    NeoForge names requirements and incompatibilities, all else is optional; Forge only knows whether
    an entry is mandatory; the descriptors of Fabric and Quilt have said it already (``descriptors``).
    """
    if loader == "forge":
        return rows.withColumn("kind", F.when(F.coalesce("mandatory", F.lit(False)), "REQUIRED").otherwise("OPTIONAL"))
    if loader == "neoforge":
        word = F.upper(F.trim("type"))
        return rows.withColumn("kind", F.when(word.isin("REQUIRED", "INCOMPATIBLE"), word).otherwise("OPTIONAL"))
    return rows.withColumn("kind", dependency_kind(F.col("type")))


def winners(files: DataFrame) -> DataFrame:
    """(path, pack, priority, content): of each path the version of the pack that comes last."""
    from stratalog.operators.merge import winner

    return winner(files, "path", "priority", "pack")


#: Folders of assets that are always swept, and files at a namespace's root.
ASSET_FOLDERS = ("models", "textures", "blockstates", "shaders", "particles", "atlases", "font", "texts", "lang")
ROOT_FILES = ("sounds.json",)
_PLAIN = re.compile(r"[a-z0-9_-][a-z0-9_.-]*")


def _with_declared(known: tuple[str, ...], declared: tuple[str, ...]) -> list[str]:
    """The known names, then the declared ones that can be swept, in order."""
    return [*known, *sorted({d for d in declared if d and _PLAIN.fullmatch(d)} - set(known))]


def sweep(files: DataFrame, declared: tuple[str, ...] = (), root_files: tuple[str, ...] = ()) -> DataFrame:
    """Files below the built-in and declared folders, and named ones at the root; hidden and empty segments are rejected."""
    path = F.regexp_replace("path", "^/", "")
    under = F.substring_index(path, "/", 1).isin(*_with_declared(ASSET_FOLDERS, declared)) & path.contains("/")
    at_root = path.isin(*_with_declared(ROOT_FILES, root_files))
    return files.filter((under | at_root) & ~path.rlike(r"(^|/)(\.|/|$)") & (path != ""))
