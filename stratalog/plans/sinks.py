"""Text sinks: records of a shard rendered line by line, written by partition.

A rendering is a column of text for each record, with what opens and closes a shard. Shards are
directories (namespace, kind, target); a task sorts its shards' lines, so no shard is collected.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.functions.names import json_number, part_name
from stratalog.schema import SEVERITIES, plural


def quoted(text: Column) -> Column:
    """A JSON string, control characters escaped; what YAML, TOML and td take as well."""
    held = F.replace(F.to_json(F.struct(text.cast("string").alias("v"))), F.lit("\x7f"), F.lit("\\u007f"))  # {"v":"..."}
    return F.when(text.isNotNull(), F.substring(held, F.lit(6), F.length(held) - 6))


def _xml(text: Column) -> Column:
    """Markup escaped; control characters that XML forbids become U+FFFD."""
    text = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "\uFFFD")
    for raw, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(mark))
    return text


def _scalar(col: Column, kind: T.DataType, text: Callable[[Column], Column]) -> Column:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return json_number(col.cast("double"))
    if isinstance(kind, (T.BooleanType, T.IntegralType)):
        return col.cast("string")
    return text(col.cast("string"))


def _list(col: Column, text: Callable[[Column], Column], between: str) -> Column:
    return F.array_join(F.transform(col, lambda x: text(x.cast("string"))), between)


class Format(NamedTuple):
    extension: str
    record: Callable[[DataFrame, str], Column]
    opens: Callable[[str], str]
    closes: Callable[[str], str]
    between: str = ""


def _fields(df: DataFrame, scalar, listed) -> list[Column]:
    """A column of text for each field, null where the field is omitted."""
    return [listed(f.name, F.col(f.name)) if isinstance(f.dataType, T.ArrayType) else scalar(f.name, F.col(f.name), f.dataType) for f in df.schema]


def _yaml(df: DataFrame, kind: str) -> Column:
    first, *rest = df.columns
    scalar = lambda n, c, t: F.concat(F.lit(f"    {n}: "), _scalar(c, t, quoted))
    listed = lambda n, c: F.when(F.size(c) > 0, F.concat(F.lit(f"    {n}:\n      - "), _list(c, quoted, "\n      - "))).when(c.isNotNull(), F.lit(f"    {n}: []"))
    head = F.concat(F.lit(f"  - {first}: "), _scalar(F.col(first), df.schema[first].dataType, quoted))
    return F.concat_ws("\n", head, *_fields(df.select(*rest), scalar, listed))


def _toml(df: DataFrame, kind: str) -> Column:
    scalar = lambda n, c, t: F.concat(F.lit(f"{n} = "), _scalar(c, t, quoted))
    listed = lambda n, c: F.concat(F.lit(f"{n} = ["), _list(c, quoted, ", "), F.lit("]"))
    return F.concat_ws("\n", F.lit(f"[[{plural(kind)}]]"), *_fields(df, scalar, listed), F.lit(""))


def _xml_record(df: DataFrame, kind: str) -> Column:
    scalar = lambda n, c, t: F.concat(F.lit(f"    <{n}>"), _scalar(c, t, _xml), F.lit(f"</{n}>"))
    listed = lambda n, c: F.concat(F.lit(f"    <{n}>"), F.when(F.size(c) > 0, F.concat(F.lit("<v>"), _list(c, _xml, "</v><v>"), F.lit("</v>"))).otherwise(""), F.lit(f"</{n}>"))
    return F.concat_ws("\n", F.lit(f"  <{kind}>"), *_fields(df, scalar, listed), F.lit(f"  </{kind}>"))


def _td(df: DataFrame, kind: str) -> Column:
    scalar = lambda n, c, t: F.concat(F.lit(f"{n} = "), _scalar(c, t, quoted))
    listed = lambda n, c: F.concat(F.lit(f"{n} = ["), _list(c, quoted, ", "), F.lit("]"))
    return F.concat(F.lit("  {"), F.concat_ws(", ", *_fields(df, scalar, listed)), F.lit("}"))


def _json(df: DataFrame, kind: str) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in df.columns]))


FORMATS = {
    "ndjson": Format("ndjson", _json, lambda k: "", lambda k: ""),
    "json": Format("json", _json, lambda k: f'{{"{plural(k)}":[', lambda k: "]}", ","),
    "yaml": Format("yaml", _yaml, lambda k: f"{plural(k)}:", lambda k: ""),
    "toml": Format("toml", _toml, lambda k: "", lambda k: ""),
    "xml": Format("xml", _xml_record, lambda k: f'<?xml version="1.0" encoding="UTF-8"?>\n<catalogue kind="{plural(k)}">', lambda k: "</catalogue>"),
    "td": Format("td", _td, lambda k: f"{plural(k)} = [", lambda k: "]"),
}


def supports(form: str, kind: str, wiki_blocks: bool = False) -> bool:
    """Whether a format takes records of a kind: the wiki projections take a few, the others all."""
    return not form.startswith("wiki") or kind in WIKI_KINDS or (wiki_blocks and kind == "block")


def rendered(records: DataFrame, kind: str, form: str, shard: str = "namespace", order: str = "registry_name", shown: list[str] | None = None) -> DataFrame:
    """(shard, place, _order, line): opening line, records in order, closing line of each shard.

    Records that share a name, or have none, order by their text. Where records need a separator
    between them, a shard's first is told by an aggregate, equal lines are counted and numbered;
    nothing runs over a whole shard. ``shown`` names the fields that are written, all if none.
    """
    f = FORMATS[form]
    between = "," if form.startswith("wiki") and kind == "recipe" else f.between
    fields = records.select(*shown) if shown else records
    lines = records.select(F.col(shard), F.col(order).cast("string").alias("_order"), f.record(fields, kind).alias("_text"))
    if between:
        place = F.struct("_order", "_text")
        first = lines.groupBy(shard).agg(F.min(place).alias("_first"))
        equal = lines.groupBy(shard, "_order", "_text").agg(F.count("*").alias("_n"))
        each = equal.join(first, equal[shard].eqNullSafe(first[shard])).drop(first[shard]).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
        leads = place.eqNullSafe(F.col("_first")) & (F.col("_i") == 1)
        lines = each.select(shard, "_order", F.concat(F.when(leads, "").otherwise(between), "_text").alias("_text"), F.when(leads, 1).otherwise(2).alias("place"))
    else:
        lines = lines.withColumn("place", F.lit(2))
    body = lines.select(shard, "place", "_order", F.col("_text").alias("line"))
    shards = records.select(shard).distinct()
    for place, text in ((0, f.opens(kind)), (3, f.closes(kind))):
        if text:
            body = body.union(shards.select(shard, F.lit(place).alias("place"), F.lit(None).cast("string").alias("_order"), F.lit(text).alias("line")))
    return body


def write_lines(lines: DataFrame, path: str, *shard: str) -> None:
    """One directory for each shard; its files, in order of their names, hold its lines in order. Only the shards of ``lines`` are touched.

    Ranges of (shard, place, order) spread a large shard over several tasks and files.
    """
    from stratalog.functions.names import path_segment

    width = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) for c in (*shard, "place", "_order", "line")]
    for c in shard:
        lines = lines.withColumn(c, path_segment(F.col(c)))
    ranged = lines.repartitionByRange(width, *order).sortWithinPartitions(*order).select(*shard, "line")
    ranged.write.partitionBy(*shard).mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path)


def write(records: DataFrame, kind: str, form: str, path: str, shard: str = "namespace", order: str = "registry_name") -> None:
    """One directory for each shard, its lines in order."""
    write_lines(rendered(records, kind, form, shard, order), path, shard)


#: Our columns by the names that written records use, for each kind.
FIELDS = {
    "item": "registry_name=registryName namespace translation_key=translationKey name_zh=name name_en=englishName max_stack=maxStackSize max_durability=maxDurability tags creative_tabs=creativeTabs block_item=blockItem",
    "entity": "registry_name=registryName namespace translation_key=translationKey name_zh=name name_en=englishName category",
    "block": "registry_name=registryName namespace name_zh=name name_en=englishName hardness blast_resistance=blastResistance light=lightEmission has_block_item=hasBlockItem material tags",
    "recipe": "id type namespace input_slots=inputSlots output_slots=outputSlots output_items=outputItems experience cook_time=cookTime",
    "mod": "id name version namespace loader minecraft_version=minecraftVersion authors license description dependencies providers source_file=sourceFile",
}


def projected(records: DataFrame, kind: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A record's written fields in their order and by their names, after the columns to keep; of kinds without a list of their own, all columns."""
    if kind not in FIELDS:
        return records
    pairs = [p.split("=") for p in FIELDS[kind].split()]
    if kind == "recipe" and "inputs" in records.columns:
        records = records.select("*", F.col("inputs.slot").alias("input_slots"), F.col("outputs.slot").alias("output_slots"), F.col("outputs.item").alias("output_items"))
    return records.select(*keep, *[F.col(p[0]).alias(p[-1]) for p in pairs if p[0] in records.columns])


#: Kinds that the wiki projection takes; blocks only if asked for.
WIKI_KINDS = ("item", "entity", "recipe")
#: File names of the wiki projections.
WIKI_FILES = {
    "v2": {"item": "Json/%mod%/%mod%-%kind%.%ext%", "entity": "Json/%mod%/%mod%-%kind%.%ext%", "recipe": "Json/%mod%/%mod%-%kind%.%ext%"},
    "v1": {"item": "%mod%.%ext%", "entity": "%mod%_entity.%ext%", "recipe": "dump_recipes_%mod%.%ext%"},
}


def _template(form: str, kind: str) -> str:
    """Name of a shard's file in a format, with what is known of it filled in."""
    known = WIKI_FILES.get({"wiki": "v2", "wiki_v1": "v1"}.get(form, ""))
    template = known.get(kind, known["item"]) if known else "%mod%-%kind%.%ext%"
    return template.replace("%kind%", plural(kind)).replace("%ext%", FORMATS[form].extension)


def shard_path(form: str, kind: str, namespace: Column, part: Column, target: str = "", per_kind: bool = True, by_namespace: bool = True) -> Column:
    """Path of a shard's file below the output folder: a target's own root, a folder for the kind, one for the namespace, the file.

    ``namespace`` is a path segment already, but for ``.`` and ``..``, which name no folder of their own.
    """
    held = F.when(namespace.isin(".", "..", ""), "_").otherwise(namespace)
    folders = [F.lit(x) for x in ([f"targets/{target}"] if target else []) + ([plural(kind)] if per_kind else [])] + ([held] if by_namespace else [])
    head, *rest = _template(form, kind).split("%mod%")
    name = F.concat(F.lit(head), *[x for r in rest for x in (held, F.lit(r))])
    return F.concat_ws("/", *folders, part_name(name, part))


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _wiki_item(df: DataFrame, version: str) -> list[Column]:
    """Of an item: the newer contract has numbers as text, the older one a bracketed text of tags."""
    none = F.array().cast("array<string>")
    tags, tabs = (F.coalesce(_column(df, c, "array<string>"), none) for c in ("tags", "creative_tabs"))
    zh, en, name = (_column(df, c) for c in ("name_zh", "name_en", "registry_name"))
    stack, durability = (F.coalesce(_column(df, c, "int"), F.lit(0)) for c in ("max_stack", "max_durability"))
    if version == "v1":
        kind = F.when(_column(df, "block_item", "boolean"), "Block").otherwise("Item")
        return [F.coalesce(zh, en).alias("name"), F.coalesce(en, zh).alias("englishName"), name.alias("registerName"), F.coalesce(F.get(tabs, F.lit(0)), F.lit("")).alias("CreativeTabName"), kind.alias("type"), F.concat(F.lit("["), F.array_join(tags, ", "), F.lit("]")).alias("OredictList"), stack.alias("maxStacksSize"), durability.alias("maxDurability")]
    return [name.alias("registerName"), F.lit("Item").alias("type"), stack.cast("string").alias("maxStackSize"), durability.cast("string").alias("maxDurability"), tags.alias("TagList"), zh.alias("name"), en.alias("englishName"), F.when(F.size(tabs) > 0, F.array_join(tabs, ",")).alias("CreativeTabName")]


def _wiki_entity(df: DataFrame, version: str) -> list[Column]:
    zh, en, name = (_column(df, c) for c in ("name_zh", "name_en", "registry_name"))
    if version == "v1":
        return [F.coalesce(zh, en).alias("name"), F.coalesce(en, zh).alias("englishName"), name.alias("registerName"), F.col("namespace").alias("mod"), F.lit("Entity").alias("type")]
    return [name.alias("registerName"), zh.alias("name"), en.alias("englishName")]


def _wiki_recipe(df: DataFrame, version: str) -> list[Column]:
    """Of a recipe, slots as keys; an ingredient is a tag, a list of items or one item, an empty one is left out."""
    some = F.filter("inputs", lambda i: F.coalesce(F.array_size(i["values"]), F.lit(0)) > 0)
    one = lambda i: F.struct(F.when(i["kind"] == "tag", i["values"][0]).alias("tag"), F.when(i["kind"] == "items", i["values"]).alias("items"), F.when(~i["kind"].isin("tag", "items"), i["values"][0]).alias("item"))
    given = F.map_from_entries(F.transform(some, lambda i: F.struct(i["slot"].alias("k"), one(i).alias("v"))))
    made = F.map_from_entries(F.transform("outputs", lambda o: F.struct(o["slot"].alias("k"), F.struct(o["item"].alias("item"), o["count"].alias("count"), F.nullif(o["nbt"], F.lit("")).alias("nbt")).alias("v"))))
    return [F.col("type"), F.col("id").alias("name"), given.alias("input"), made.alias("output"), _column(df, "experience", "double").alias("experience"), _column(df, "cook_time", "int").alias("cookTime")]


def wiki_columns(df: DataFrame, kind: str, version: str = "v2") -> list[Column]:
    """The wiki contract's fields of a kind; fields that are null are left out of the JSON."""
    return {"recipe": _wiki_recipe, "entity": _wiki_entity}.get(kind, _wiki_item)(df, version)


def _wiki(version: str) -> Format:
    recipe = lambda k, text: text if k == "recipe" else ""
    return Format("json", lambda df, k: F.to_json(F.struct(*wiki_columns(df, k, version))), lambda k: recipe(k, '{"recipes":['), lambda k: recipe(k, '],"error":[]}'))


FORMATS |= {"wiki": _wiki("v2"), "wiki_v1": _wiki("v1")}


def report_text(findings: DataFrame, header: dict[str, object]) -> DataFrame:
    """(n, line): a header, the findings in their order with their details, and a block of one tab-separated line each."""
    from stratalog.operators.checks import ordered

    spark = findings.sparkSession
    counted = findings.agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "ERROR").alias("e")).first()
    head = [f"{k + ':':<12}{v}" for k, v in {**header, "findings": counted.n, "errors": counted.e}.items()] + [""]
    token = F.lower(F.coalesce("severity", F.lit("INFO")))
    flat = lambda c: F.translate(F.coalesce(F.col(c), F.lit("")), "\t", " ")
    told = F.array_join(F.concat(F.array(F.concat_ws("  ", token, "kind", "subject"), F.concat(F.lit("    "), "message")), F.transform("detail", lambda d: F.concat(F.lit("    "), d["k"], F.lit(" = "), F.coalesce(d["v"], F.lit(""))))), "\n")
    row = F.concat_ws("\t", "kind", token, flat("subject"), flat("message"))
    rank = F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair])
    keys = ["rank", "kind", "subject", "message"]
    rows = ordered(findings).select(F.element_at(rank, F.coalesce("severity", F.lit("INFO"))).alias("rank"), "kind", "subject", "message", told.alias("told"), row.alias("row"))
    block = lambda n, c: rows.select(F.lit(n).alias("n"), *keys, F.col(c).alias("line"))
    fixed = spark.createDataFrame([(0, i, t) for i, t in enumerate(head)] + [(2, 0, ""), (2, 1, "# kind\tseverity\tsubject\tmessage")], "n int, rank int, line string").select("n", "rank", *[F.lit(None).cast("string").alias(k) for k in keys[1:]], "line")
    return fixed.unionByName(block(1, "told")).unionByName(block(3, "row")).orderBy("n", *keys).select("n", "line")


def report_lines(findings: DataFrame, most: int = 20) -> DataFrame:
    """The first findings as text, in their order."""
    from stratalog.operators.checks import ordered

    return ordered(findings).limit(most).select(F.concat_ws("\t", "severity", "kind", "subject", "message").alias("line"))
