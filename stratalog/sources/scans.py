"""Scans of a catalogue's sources: archives, mixin configurations, recipes, names and definitions."""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Collection, Sequence
from typing import BinaryIO, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.functions.names import locale_chain, namespace_of, path_of
from stratalog.operators.predicates import namespace_allowed
from stratalog.schema import FINDINGS

from .documents import _at, _is, _items, _text, parsed
from .files import located

ARCHIVE = T.StructType([T.StructField("entries", T.IntegerType()), T.StructField("mixin_paths", T.ArrayType(T.StringType())), T.StructField("manifest", T.MapType(T.StringType(), T.StringType())), T.StructField("read_error", T.StringType())])
MIXIN_SUFFIX = ".mixins.json"
#: Attributes of a manifest that are facts of the container.
ATTRIBUTES = ("MixinConfigs", "Implementation-Title")


def _manifest(text: str) -> dict[str, str]:
    """Attributes of the main section; a line that starts with a blank continues the one before."""
    found: dict[str, str] = {}
    name = None
    for line in text.replace("\r\n", "\n").split("\n"):
        if not line:
            break
        if line[0] == " " and name:
            found[name] += line[1:]
        elif ":" in line:
            name, value = line.split(":", 1)
            found[name] = value[1:] if value.startswith(" ") else value
    return {k: v for k, v in found.items() if k in ATTRIBUTES}


#: Bytes of a manifest that are read at most; its main section is far shorter.
MOST_MANIFEST = 1 << 20
_DAMAGE = (zipfile.BadZipFile, zlib.error, OSError, EOFError, KeyError, ValueError, RuntimeError, NotImplementedError, pa.ArrowException)


def _inspect(source: BinaryIO) -> tuple[int | None, list[str], dict[str, str], str | None]:
    """Of a file that can be sought in: the directory at its end and the manifest are read, nothing else."""
    try:
        with zipfile.ZipFile(source) as z:
            names, manifest = z.namelist(), {}
            if "META-INF/MANIFEST.MF" in names:
                with z.open("META-INF/MANIFEST.MF") as m:
                    manifest = _manifest(m.read(MOST_MANIFEST).decode("utf-8", "replace"))
    except _DAMAGE as e:
        return None, [], {}, f"{type(e).__name__}: {e}"
    declared = [x.strip() for x in manifest.get("MixinConfigs", "").split(",")]
    return len(names), list(dict.fromkeys(x for x in declared + [n for n in names if n.endswith(MIXIN_SUFFIX)] if x)), manifest, None


@F.pandas_udf(ARCHIVE)
def archive(contents: pd.Series) -> pd.DataFrame:
    """Entries, manifest attributes and mixin configurations of a zip held in memory; a damaged one gives its error."""
    return pd.DataFrame([_inspect(io.BytesIO(c)) for c in contents], columns=ARCHIVE.names)


@F.pandas_udf(ARCHIVE)
def archive_at(paths: pd.Series) -> pd.DataFrame:
    """The same of the files at these paths, each by a few ranged reads."""

    def inspect(path: str):
        try:
            system, at = located(path)
            with system.open_input_file(at) as f:
                return _inspect(f)
        except _DAMAGE as e:
            return None, [], {}, f"{type(e).__name__}: {e}"

    return pd.DataFrame([inspect(p) for p in paths], columns=ARCHIVE.names)


def archives(spark: SparkSession, folder: str, pattern: str = "*.jar") -> DataFrame:
    """The archives below a folder as container facts. Spark lists them, without their content, and deals them to tasks by size;
    a task seeks each one's directory, so its memory does not grow with the archives."""
    return containers(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "length"))


def container_failures(found: DataFrame) -> DataFrame:
    """Archives that could not be read, as failures."""
    return found.filter("read_error is not null").select(F.lit("container").alias("kind"), F.col("path").alias("id"), F.col("read_error").alias("error"))


def containers(files: DataFrame) -> DataFrame:
    """Rows of archives as container facts: by their ``path``, or by their ``content`` where that was read."""
    facts = archive("content") if "content" in files.columns else archive_at("path")
    return files.withColumn("a", facts).select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.lit(False).alias("is_dir"), F.col("length").alias("bytes"), "a.entries", "a.mixin_paths", "a.manifest", "a.read_error")


def directories(files: DataFrame, root: str) -> DataFrame:
    """(path, length) rows of files below ``root`` as facts of the directories right under it: a directory is a container too."""
    below = F.regexp_extract("path", rf"{re.escape(root.rstrip('/'))}/([^/]+)/(.+)$", 1)
    inner = F.regexp_extract("path", rf"{re.escape(root.rstrip('/'))}/([^/]+)/(.+)$", 2)
    rows = files.select(below.alias("file_name"), inner.alias("inner"), "length").filter("file_name <> ''")
    paths = F.array_sort(F.collect_list(F.when(F.col("inner").endswith(MIXIN_SUFFIX), F.col("inner"))))
    agg = rows.groupBy("file_name").agg(F.sum("length").alias("bytes"), F.count("*").cast("int").alias("entries"), paths.alias("mixin_paths"))
    none = F.create_map().cast("map<string,string>")
    return agg.select(F.concat(F.lit(f"{root.rstrip('/')}/"), "file_name").alias("path"), "file_name", F.lit(True).alias("is_dir"), "bytes", "entries", "mixin_paths", none.alias("manifest"), F.lit(None).cast("string").alias("read_error"))


#: Lists of a mixin configuration, and where their entries apply.
ENVIRONMENTS = {"mixins": "common", "client": "client", "server": "server"}
MOST_CONFIG = 1 << 20


def mixin_configs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, mod_id, content) of mixin configurations as facts, and those that can't be read as failures.

    The package is required and a file over MOST_CONFIG is not read; both are failures, as is what
    is no JSON object. An entry is a class name, or an object of a target and several classes.
    """
    root = parsed(F.col("content"))
    package = _text(root, "$.package")
    error = F.when(F.octet_length("content") > MOST_CONFIG, "too long").when(~_is(root, "OBJECT"), "no JSON object").when(F.coalesce(package, F.lit("")) == "", "no package")
    rows = files.withColumn("error", error)
    struct = lambda name, env, target: F.struct(F.concat_ws(".", package, name).alias("cls"), F.lit(env).alias("env"), target.alias("explicit_target"))
    none = F.lit(None).cast("string")
    strings = lambda v: F.filter(F.transform(F.coalesce(_items(v), F.array().cast("array<variant>")), lambda x: F.when(_is(x, "STRING"), F.try_variant_get(x, "$", "string"))), lambda x: x.isNotNull())

    def entry(env: str):
        return lambda x: F.when(_is(x, "STRING"), F.array(struct(F.try_variant_get(x, "$", "string"), env, none))).otherwise(F.transform(strings(_at(x, "$.mixins")), lambda n: struct(n, env, _text(x, "$.target"))))

    lists = [F.flatten(F.transform(F.coalesce(_items(_at(root, f"$.{k}")), F.array().cast("array<variant>")), entry(env))) for k, env in ENVIRONMENTS.items()]
    required = F.coalesce(F.when(_is(_at(root, "$.required"), "BOOLEAN"), F.try_variant_get(root, "$.required", "boolean")), F.lit(False))
    good = rows.filter("error is null").select(F.col("path").alias("source"), "mod_id", package.alias("package"), required.alias("required"), _text(root, "$.compatibilityLevel").alias("level"), _text(root, "$.refmap").alias("refmap"), F.concat(*lists).alias("entries"))
    return good, rows.filter("error is not null").select(F.lit("mixin").alias("kind"), F.col("path").alias("id"), "error")


def mixin_entries(files: DataFrame) -> DataFrame:
    """(path, content) of mixin configurations as (path, at, cls, env, explicit_target)."""
    good, _ = mixin_configs(files.withColumn("mod_id", F.lit(None).cast("string")))
    return good.select(F.col("source").alias("path"), F.posexplode("entries").alias("at", "e")).select("path", "at", "e.*")


def recipe_inputs(recipes: DataFrame) -> DataFrame:
    """(id, ord, type, width, ingredients) as (id, slot, ingredient): the first of each id; blanks keep their place.

    A shaped recipe's slot is x + 3 * y + 1 on the grid, any other's its place from 1 on. Recipes
    that only have a result have no ingredients.
    """
    first = recipes.groupBy("id").agg(F.min_by(F.struct("type", "width", "ingredients"), "ord").alias("r")).select("id", "r.*")
    rows = first.select("id", "type", "width", F.posexplode("ingredients").alias("at", "ingredient"))
    slot = F.when(F.col("type") == "shaped", F.col("at") % F.col("width") + 3 * F.floor(F.col("at") / F.col("width")) + 1).otherwise(F.col("at") + 1)
    return rows.select("id", slot.cast("int").alias("slot"), "ingredient").filter("ingredient is not null and ingredient <> ''")


#: Types of recipes whose ingredients are read; the cooking ones have experience and a time.
SHAPES, COOKING = ("shaped", "shapeless"), ("smelting", "blasting", "smoking", "campfire_cooking")


def recipe_records(recipes: DataFrame) -> DataFrame:
    """(id, ord, type, width, ingredients, result, count, experience, cook_time) as recipe records in order of ids.

    The first of an id stands. Shaped and shapeless recipes and cooking ones have inputs by slot;
    of other types only the result is known, and a recipe without one is left out.
    """
    first = recipes.groupBy("id").agg(F.min_by(F.struct(*[c for c in recipes.columns if c != "id"]), "ord").alias("r")).select("id", "r.*")
    known = F.col("type").isin(*SHAPES, *COOKING)
    slots = recipe_inputs(recipes.filter(known)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("slot"), "ingredient"))).alias("in"))
    tag = lambda i: i["ingredient"].startswith("#")
    inputs = F.transform(F.coalesce("in", F.array().cast("array<struct<slot:int,ingredient:string>>")), lambda i: F.struct(i["slot"].cast("string").alias("slot"), F.when(tag(i), "tag").otherwise("item").alias("kind"), F.array(F.when(tag(i), F.substring(i["ingredient"], F.lit(2), F.length(i["ingredient"]))).otherwise(i["ingredient"])).alias("values"), F.lit(1).alias("count")))
    made = F.array(F.struct(F.lit("1").alias("slot"), F.col("result").alias("item"), F.coalesce("count", F.lit(1)).alias("count"), F.lit(None).cast("string").alias("nbt")))
    cooked = F.col("type").isin(*COOKING)
    rows = first.join(slots, "id", "left").filter(known | (F.coalesce("result", F.lit("")) != ""))
    return rows.select("id", "type", namespace_of(F.col("id")).alias("namespace"), inputs.alias("inputs"), made.alias("outputs"), F.when(cooked, F.col("experience")).alias("experience"), F.when(cooked, F.col("cook_time")).alias("cook_time")).orderBy("id")


class Registry(NamedTuple):
    """Where a kind's entries come from: its table, whether only a running server has it, and how entries are named."""

    kind: str
    table: str
    dynamic: bool
    names: str
    prefix: str | None = None


#: Kinds that are walked in a registry.
REGISTRIES = [
    Registry("effect", "mob_effect", False, "LANG_KEY", "effect"),
    Registry("fluid", "fluid", False, "NONE"),
    Registry("enchantment", "enchantment", True, "LANG_KEY", "enchantment"),
    Registry("attribute", "attribute", False, "FROM_ENTRY"),
    Registry("creative_tab", "creative_mode_tab", False, "FROM_ENTRY"),
    Registry("sound", "sound_event", False, "NONE"),
    Registry("particle", "particle_type", False, "NONE"),
    Registry("block_entity_type", "block_entity_type", False, "NONE"),
    Registry("potion", "potion", False, "NONE"),
    Registry("recipe_type", "recipe_type", False, "NONE"),
    Registry("menu", "menu", False, "NONE"),
    Registry("biome", "worldgen/biome", True, "LANG_KEY", "biome"),
    Registry("damage_type", "damage_type", True, "NONE"),
    Registry("structure", "worldgen/structure", True, "NONE"),
    Registry("dimension", "dimension_type", True, "NONE"),
    Registry("feature", "worldgen/feature", True, "NONE"),
]


def registry_scan(tables: dict[str, DataFrame], translations: DataFrame, namespaces: Collection[str] = (), dynamic: bool = True) -> DataFrame:
    """(kind, namespace, key, translation_key, name_zh, name_en) of all registries at hand, in order of kind and key.

    ``tables`` maps a registry to its entries (key, name_key); registries that are missing, and
    dynamic ones where there is no server, are skipped. A language key is ``prefix.namespace.path``.
    """
    found = None
    for r in REGISTRIES:
        if r.table not in tables or (r.dynamic and not dynamic):
            continue
        rows = tables[r.table].select(F.lit(r.kind).alias("kind"), namespace_of(F.col("key")).alias("namespace"), "key", "name_key")
        named = {"LANG_KEY": F.concat_ws(".", F.lit(r.prefix), "namespace", F.translate(path_of(F.col("key")), "/", ".")), "FROM_ENTRY": F.col("name_key")}.get(r.names, F.lit(None).cast("string"))
        rows = rows.filter(namespace_allowed(F.col("namespace"), namespaces)).withColumn("translation_key", named).drop("name_key")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = translations.sparkSession.createDataFrame([], "kind string, namespace string, key string, translation_key string")
    return with_names(found, translations).select("kind", "namespace", "key", "translation_key", "name_zh", "name_en").orderBy("kind", "key")


def versions_of(files: DataFrame) -> DataFrame:
    """(path, pack, priority, content) with ``pos``: all versions of each path, from the lowest pack up."""
    order = Window.partitionBy("path").orderBy("priority", "pack")
    return files.withColumn("pos", F.row_number().over(order) - 1)


def with_names(records: DataFrame, translations: DataFrame, key: str = "translation_key") -> DataFrame:
    """Adds name_zh and name_en from (key, locale, text); one shuffle of the texts, one left join."""
    wide = translations.groupBy(F.col("key").alias(key)).agg(*[F.max(F.when(F.col("locale") == loc, F.col("text"))).alias(n) for n, loc in (("name_zh", "zh_cn"), ("name_en", "en_us"))])
    return records.join(wide, key, "left")


def texts_for(translations: DataFrame, chain: Sequence[str]) -> DataFrame:
    """(key, locale, text) as (key, text, locale): of each key the text of the first locale of the chain that has one.

    One aggregate over the chain's locales, whatever its length; combined in the tasks, so a key with many
    texts shuffles one for each of them.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in chain]), F.lower(F.trim("locale")))
    known = translations.filter(F.col("text").isNotNull()).withColumn("_rank", rank).filter("_rank > 0")
    first = known.groupBy("key").agg(F.min_by(F.struct("text", F.lower(F.trim("locale")).alias("locale")), F.struct("_rank", "text")).alias("_f"))
    return first.select("key", "_f.text", "_f.locale")


def with_text(records: DataFrame, translations: DataFrame, locale: str | None, key: str = "translation_key", name: str = "text") -> DataFrame:
    """Adds the text of each record's key in a locale, its language or the fallback; the key itself where there is none."""
    found = texts_for(translations, locale_chain(locale)).select(F.col("key").alias(key), F.col("text").alias(name))
    return records.join(found, key, "left").withColumn(name, F.coalesce(name, key))


def lookup(wanted: DataFrame, definitions: DataFrame, wanted_id: str = "id") -> DataFrame:
    """Definitions by the id asked for, else by what follows its first colon."""
    found = definitions.select(F.col("id").alias("_id"), F.col("source").alias("_source"))
    asked = wanted.withColumn("_short", F.when(F.col(wanted_id).contains(":"), path_of(F.col(wanted_id))))
    exact = asked.join(found.withColumnRenamed("_source", "_exact"), F.col(wanted_id) == F.col("_id"), "left").drop("_id")
    loose = exact.join(found.withColumnRenamed("_source", "_loose"), F.col("_short") == F.col("_id"), "left").drop("_id")
    return loose.select(wanted_id, F.coalesce("_exact", "_loose").alias("source"))


#: Mods that already provide global packs, and the folders that they read.
PROVIDERS = {
    "openloader": "config/openloader/data config/openloader/resources",
    "paxi": "config/paxi/datapacks config/paxi/datapacks-default config/paxi/data",
    "global_packs": "config/global_packs/data global_packs/required_data global_packs/optional_data",
    "globalpack": "config/globalpack globalpack",
}


def discovered(files: DataFrame, folder: str) -> DataFrame:
    """(path, length) rows below ``folder`` as its packs: (name, is_dir, bytes), the directories and zips right under it."""
    inner = F.regexp_extract("path", rf"{re.escape(folder.rstrip('/'))}/(.+)$", 1)
    top = F.substring_index("inner", "/", 1)
    rows = files.select(inner.alias("inner"), "length").filter("inner <> ''").select(top.alias("name"), F.col("inner").contains("/").alias("is_dir"), "length")
    return rows.filter(F.col("is_dir") | F.lower("name").endswith(".zip")).groupBy("name", "is_dir").agg(F.sum("length").alias("bytes"))


def provider_of(mods: DataFrame) -> str | None:
    """The first mod, in their order, that provides global packs."""
    first = mods.filter(F.col("id").isin(*PROVIDERS)).orderBy("ord").select("id").head()
    return first.id if first else None


def global_packs(packs: DataFrame, mods: DataFrame, policy: str = "AUTO") -> DataFrame:
    """Packs to load: all if ON, none if OFF; AUTO leaves them to a provider where one is present."""
    if policy == "OFF" or (policy == "AUTO" and provider_of(mods) is not None):
        return packs.limit(0)
    return packs


def global_pack_findings(packs: DataFrame, mods: DataFrame, policy: str, folder: str | None) -> DataFrame:
    """What the policy decided about the packs of our own folder."""
    spark, n, provider = mods.sparkSession, packs.count(), provider_of(mods)
    out: list[tuple] = []
    add = lambda kind, severity, subject, message, **d: out.append((kind, severity, subject, message, [(k, str(v)) for k, v in d.items()]))
    if policy == "AUTO" and provider:
        add("global_pack_deferred", "INFO", provider, f"{provider} provides global packs, so ours stand back", provider=provider, directories=", ".join(PROVIDERS[provider].split()))
        if n:
            add("global_pack_ignored", "WARN", provider, f"{n} packs in {folder} are not loaded, since {provider} provides them", directory=folder, packs=n)
    if policy == "OFF" and n:
        add("global_pack_disabled", "INFO", "packs", f"{n} packs in {folder} are not loaded, since they are switched off", directory=folder, packs=n)
    if policy == "ON" and provider:
        add("global_pack_both_active", "INFO", "packs", f"{provider} provides global packs beside ours", provider=provider)
    if (policy == "ON" or (policy == "AUTO" and not provider)) and not n and folder is not None:
        add("global_pack_empty", "INFO", "packs", f"there are no packs in {folder}", directory=folder)
    return spark.createDataFrame(out, FINDINGS)


def pending(candidates: DataFrame, sizes: list[int], done: DataFrame, budget: int, key: str = "id") -> DataFrame:
    """The next ``budget`` (key, size) that are not done, in order: failures come again in the next run."""
    wanted = candidates.select(key, F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size"))
    return wanted.join(done, [key, "size"], "left_anti").orderBy(key, "size").limit(budget)


_LEAVES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))


def _leaves(text: str | None) -> list[tuple[str, str | None]] | None:
    try:
        root = json.loads(text or "")
    except (ValueError, RecursionError):
        return None
    out, open_ = [], [("$", root)]
    while open_:  # an explicit stack: documents may be as deep as the parser takes
        path, v = open_.pop()
        if isinstance(v, dict):
            open_ += [(f"{path}.{k}", x) for k, x in v.items()]
        elif isinstance(v, list):
            open_ += [(f"{path}[{i}]", x) for i, x in enumerate(v)]
        else:
            out.append((path, v if isinstance(v, str) else None if v is None else json.dumps(v)))
    return sorted(out, key=lambda leaf: leaf[0])


@F.pandas_udf(_LEAVES)
def flatten_tree(documents: pd.Series) -> pd.Series:
    """Leaves of JSON documents as (path, value) in order of paths, at any depth; null for what is no JSON."""
    return documents.map(_leaves)


_ROW = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("children", T.IntegerType()), T.StructField("list", T.BooleanType())])


def _preorder(text: str | None) -> list[tuple] | None:
    try:
        root = json.loads(text or "")
    except (ValueError, RecursionError):
        return None
    out, open_ = [], [("", root)]
    while open_:
        key, v = open_.pop()
        inner = list(v.items()) if isinstance(v, dict) else [("", x) for x in v] if isinstance(v, list) else None
        out.append((key, json.dumps(v) if inner is None else None, len(inner) if inner is not None else None, isinstance(v, list)))
        open_ += reversed(inner or [])
    return out


@F.pandas_udf(T.ArrayType(_ROW))
def tree_rows(documents: pd.Series) -> pd.Series:
    """Nodes of JSON documents in pre-order: key, value of a scalar as JSON, number of children of others."""
    return documents.map(_preorder)


def _rebuilt(rows) -> str | None:
    if rows is None or not len(rows):
        return None
    built: list = []
    for r in reversed(list(rows)):  # from the end, so that children are there before their parent
        key, value, children, listed = r.values() if isinstance(r, dict) else r
        own = [built.pop() for _ in range(children or 0)]
        built.append((key, json.loads(value) if children is None else [x for _, x in own] if listed else dict(own)))
    return json.dumps(built[-1][1])


@F.pandas_udf(T.StringType())
def tree_document(rows: pd.Series) -> pd.Series:
    """The JSON document that ``tree_rows`` tells."""
    return rows.map(_rebuilt)
