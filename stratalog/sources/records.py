"""Records of a kind from raw documents: every field typed or the record told as a failure, from one scan.

A malformed element never stops a run: what can't be read becomes a failure with the kind, the id and
the field, and all others stay records. Fields come from a JSON document by path, or from a column;
each is taken by a cast that gives null where the value is not of its type.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.names import namespace_of
from stratalog.operators.graphs import cut_lineage

from .documents import _at, _is, once, parsed
from .scans import with_names


class Field(NamedTuple):
    """A field of a record: where it is in the document, its type, the value where it is absent, and whether it must be there."""

    name: str
    path: str
    type: str
    default: object = None
    required: bool = False


class Scan(NamedTuple):
    """Both sides of a scan: records and failures (kind, id, error)."""

    records: DataFrame
    failures: DataFrame


#: Fields of each kind by the names of our columns, where a document has them, their types and defaults.
KINDS: dict[str, tuple[Field, ...]] = {
    "item": (
        Field("translation_key", "$.descriptionId", "string", required=True),
        Field("max_stack", "$.maxStackSize", "int", 64),
        Field("max_durability", "$.maxDamage", "int", 0),
        Field("tags", "$.tags", "array<string>"),
        Field("block_item", "$.blockItem", "boolean", False),
    ),
    "block": (
        Field("translation_key", "$.descriptionId", "string", required=True),
        Field("hardness", "$.destroyTime", "double", 0.0),
        Field("blast_resistance", "$.explosionResistance", "double", 0.0),
        Field("light", "$.lightEmission", "int", 0),
        Field("has_block_item", "$.hasItem", "boolean", False),
        Field("material", "$.soundType", "string"),
    ),
    "entity": (Field("translation_key", "$.descriptionId", "string", required=True), Field("category", "$.category", "string")),
}
#: Numbers may be written as numbers only, text as text only: a cast of Spark's would take one for the other.
_SHAPES = {"string": ("STRING",), "boolean": ("BOOLEAN",), "double": ("DOUBLE", "DECIMAL", "BIGINT", "FLOAT"), "int": ("BIGINT",), "bigint": ("BIGINT",)}


def _typed(root: Column, field: Field) -> Column:
    """(value, complaint) of a field; a JSON null counts as absent."""

    def read(held: Column, value: Column, fits: Column) -> Column:
        absent = held.isNull() | F.is_variant_null(held)
        default = F.lit(field.default).cast(field.type) if field.default is not None else F.lit(None).cast(field.type)
        lacking = F.when(absent, F.lit(f"{field.name} is missing") if field.required else F.lit(None).cast("string"))
        wrong = F.when(~absent & ~F.coalesce(fits, F.lit(False)), F.concat(F.lit(f"{field.name} is no {field.type}: "), F.substring(F.to_json(held), 1, 80)))
        return F.struct(F.when(absent, default).otherwise(value).alias("value"), F.coalesce(lacking, wrong).alias("complaint"))

    if field.type.startswith("array<"):
        inner = field.type[6:-1]
        listed = F.try_variant_get(root, field.path, "array<variant>")
        taken = lambda items: F.transform(items, lambda x: F.try_variant_get(x, "$", inner))
        fits = lambda items: items.isNotNull() & F.forall(items, lambda x: _fits(x, inner))
        return once(_at(root, field.path), lambda held: once(listed, lambda items: read(held, taken(items), fits(items))))
    scalar = F.try_variant_get(root, field.path, field.type)
    return once(_at(root, field.path), lambda held: once(scalar, lambda value: read(held, value, value.isNotNull() & _fits(held, field.type))))


def _fits(value: Column, kind: str) -> Column:
    shapes = _SHAPES[kind]
    fits = _is(value, shapes[0])
    for s in shapes[1:]:
        fits = fits | _is(value, s)
    return fits


def typed(rows: DataFrame, kind: str, fields: tuple[Field, ...] | None = None, id_col: str = "id", document_col: str = "document") -> Scan:
    """Rows (id, document) as records (id_col, fields …) and failures: a document that can't be parsed, a field that is missing or of another type.

    Null documents are ids that are no longer held: neither record nor failure. The scan is written once;
    both sides read that.
    """
    fields = KINDS[kind] if fields is None else fields
    own = lambda n: f"_{id_col}_{n}"  # noqa: E731  no name of a caller's
    # a column that several others use stays one in Spark's plan: a document is parsed once, and a field read once
    read = rows.filter(F.col(document_col).isNotNull()).select(F.col(id_col), parsed(F.col(document_col)).alias(own("root")))
    read = read.select(id_col, _is(F.col(own("root")), "OBJECT").alias(own("whole")), *[_typed(F.col(own("root")), f).alias(own(str(n))) for n, f in enumerate(fields)])
    problem = F.concat_ws("; ", *[F.col(own(str(n)))["complaint"] for n in range(len(fields))])
    name = F.col(id_col).cast("string")
    error = F.when(name.isNull() | (F.trim(name) == ""), "it has no name").when(~F.coalesce(F.col(own("whole")), F.lit(False)), "it is no JSON object").otherwise(F.nullif(problem, F.lit("")))
    values = F.struct(*[F.col(own(str(n)))["value"].alias(f.name) for n, f in enumerate(fields)])
    held = cut_lineage(read.select(id_col, error.alias("error"), values.alias("record")).withColumn("record", F.when(F.col("error").isNull(), F.col("record"))))
    failures = held.filter("error is not null").select(F.lit(kind).alias("kind"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), "error")
    return Scan(held.filter("error is null").select(id_col, "record.*"), failures)


def registry_records(rows: DataFrame, kind: str, translations: DataFrame) -> Scan:
    """Rows (id, document) of a registry's entries as records of a kind, named in both languages: what an export takes."""
    scan = typed(rows, kind)
    named = with_names(scan.records.withColumnRenamed("id", "registry_name").withColumn("namespace", namespace_of(F.col("registry_name"))), translations)
    return Scan(named, scan.failures)
