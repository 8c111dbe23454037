"""Record kinds and Spark schemas of catalogue facts."""

from __future__ import annotations

from pyspark.sql import types as T

#: Category tokens, data first, then what analyses produce; and plurals that take no s.
DATA_KINDS = (
    "item entity block recipe tag loot_table lang effect fluid enchantment damage_type biome dimension structure sound particle attribute "
    "creative_tab block_entity_type potion feature recipe_type menu advancement worldgen function mod debug"
).split()
ANALYSIS_KINDS = "namespace dependency conflict mixin".split()
PLURALS = {"entity": "entities", "dependency": "dependencies", "worldgen": "worldgen", "debug": "debug"}
GLOBAL = "_global"
SEVERITIES = {"ERROR": 0, "WARN": 1, "INFO": 2}


def plural(kind: str) -> str:
    return PLURALS.get(kind, f"{kind}s")


_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


DEPENDENCY = _struct(id=_S, range=_S, kind=_S)
MODS = _struct(id=_S, name=_S, version=_S, namespace=_S, loader=_S, minecraft_version=_S, license=_S, dependencies=T.ArrayType(DEPENDENCY), providers=T.ArrayType(_S), source_file=_S, ord=_I)
CONTAINERS = _struct(mod_id=_S, file_name=_S, is_dir=_B, bytes=_L, entries=_I, mixin_paths=T.ArrayType(_S), manifest=T.MapType(_S, _S), read_error=_S)
MIXINS = _struct(source=_S, mod_id=_S, package=_S, required=_B, level=_S, refmap=_S, entries=T.ArrayType(_struct(cls=_S, env=_S, explicit_target=_S)))
COUNTS = _struct(kind=_S, namespace=_S, n=_L)
PAIRS = T.ArrayType(_struct(k=_S, v=_S))
FINDINGS = _struct(kind=_S, severity=_S, subject=_S, message=_S, detail=PAIRS)
#: What analyses and registries without a kind of their own emit.
RECORDS = _struct(kind=_S, namespace=_S, key=_S, name=_S, values=T.ArrayType(_S), extra=PAIRS)
FAILURES = _struct(kind=_S, id=_S, error=_S)
RESOURCES = _struct(path=_S, pack=_S, priority=_I, content=_S)
RULES = _struct(strategy=_S, datapack=_S, kind=_S, severity=_S, mod=_S, mods=T.ArrayType(_S), target=_S, namespace=_S, value=_L, message=_S)
SNAPSHOT = _struct(path=_S, fingerprint=_S)
