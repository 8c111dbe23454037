"""Queries over the test tables for parsers, names and records of facts; each with the SQL it must agree with."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from stratalog.functions import names
from stratalog.operators import checks, delta, routing
from stratalog.sources import documents, scans

from . import export, sinks
from .catalogue import _catalogue, query
from .config import Settings
from .sinks import quoted


@query("""
WITH p AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '/tags/' || p_size || '/a/' || p_partkey || '.json' WHEN 1 THEN 'loot_table/x/' || p_partkey WHEN 2 THEN 'advancement/' || p_partkey || '.json' WHEN 3 THEN '/function/f/' || p_partkey || '.mcfunction'
  WHEN 4 THEN 'lang/de_' || p_size || '.json' WHEN 5 THEN 'worldgen/biome/b/' || p_partkey || '.json' WHEN 6 THEN 'function/' || p_partkey ELSE 'other/tags/x/' || p_partkey END AS path FROM part)
SELECT p_partkey, nullif(regexp_extract(path, '^/?tags/([^/]+)/', 1), '') AS tag_type, nullif(regexp_extract(path, '^/?tags/[^/]*/(.+?)(?:\\.json)?$', 1), '') AS tag, nullif(regexp_extract(path, '^/?loot_table/(.+?)(?:\\.json)?$', 1), '') AS loot, nullif(regexp_extract(path, '^/?advancement/(.+?)(?:\\.json)?$', 1), '') AS advancement,
  CASE WHEN p_partkey % 8 = 3 THEN 'f/' || p_partkey END AS func, CASE WHEN p_partkey % 8 = 4 THEN path[6:length(path) - 5] END AS locale, CASE WHEN p_partkey % 8 = 5 THEN 'biome' END AS worldgen_kind, CASE WHEN p_partkey % 8 = 5 THEN 'b/' || p_partkey END AS worldgen FROM p
""")
def resource_paths(table, spark):
    """What parts' paths name, by the folder each lies in."""
    key, size, own = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.col("p_partkey") % 8
    text = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    cases = [text("/tags/", size, "/a/", key, ".json"), text("loot_table/x/", key), text("advancement/", key, ".json"), text("/function/f/", key, ".mcfunction"), text("lang/de_", size, ".json"), text("worldgen/biome/b/", key, ".json"), text("function/", key), text("other/tags/x/", key)]
    path = F.element_at(F.array(*cases), (own + 1).cast("int"))
    read = {"tag_type": names.tag_type, "tag": names.tag_path, "loot": names.loot_path, "advancement": names.advancement_path, "func": names.function_path, "locale": names.locale, "worldgen_kind": names.worldgen_kind, "worldgen": names.worldgen_path}
    return table("part").select("p_partkey", *[f(path).alias(n) for n, f in read.items()])


@query("""
WITH d AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || '@[1,' || p_size || ')' WHEN 2 THEN ' ' || p_brand || ' @ a@b' ELSE p_brand || '@ ' END AS t, [' Required', 'SUGGESTS', 'breaks', 'embedded', 'what', NULL][p_size % 6 + 1] AS word FROM part)
SELECT p_partkey, trim(split_part(t, '@', 1)) AS id, CASE WHEN contains(t, '@') THEN nullif(trim(t[strpos(t, '@') + 1:]), '') END AS "range", CASE lower(trim(word)) WHEN 'required' THEN 'REQUIRED' WHEN 'suggests' THEN 'OPTIONAL' WHEN 'breaks' THEN 'INCOMPATIBLE' WHEN 'embedded' THEN 'EMBEDDED' ELSE 'UNKNOWN' END AS kind FROM d
""")
def dependency_text(table, spark):
    """Declared dependencies as text, with and without a range, and the words for their kinds."""
    size, brand = F.col("p_size"), F.col("p_brand")
    text = F.when(size % 4 == 0, brand).when(size % 4 == 1, F.concat(brand, F.lit("@[1,"), size.cast("string"), F.lit(")"))).when(size % 4 == 2, F.concat(F.lit(" "), brand, F.lit(" @ a@b"))).otherwise(F.concat(brand, F.lit("@ ")))
    word = F.get(F.array(*[F.lit(w) for w in (" Required", "SUGGESTS", "breaks", "embedded", "what", None)]), (size % 6).cast("int"))
    return table("part").select("p_partkey", names.dependency(text).alias("d"), names.dependency_kind(word).alias("kind")).select("p_partkey", "d.id", "d.range", "kind")


@query("""
SELECT p_partkey, replace(p_brand || ':' || p_name || '/' || chr(92), ':', '_').replace('/', '_').replace(chr(92), '_') AS segment,
  CASE p_size % 3 WHEN 0 THEN p_brand || '-items.json' WHEN 1 THEN p_brand || '-items-p2.json' ELSE p_brand || '-items-p3.json' END AS file,
  CAST(to_json('"' || p_name || chr(10) || chr(92) || chr(9) || chr(1)) AS VARCHAR) AS quoted,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE CAST(p_size + 0.25 AS VARCHAR) END AS number FROM part
""")
def safe_names(table, spark):
    """Names as path segments, files of parts, text and numbers as JSON."""
    size = F.col("p_size")
    number = F.when(F.col("p_partkey") % 2 == 0, size.cast("double")).otherwise(size + F.lit(0.25).cast("double"))
    text = F.concat(F.lit('"'), F.col("p_name"), F.lit("\n\\\t\x01"))
    return table("part").select(
        "p_partkey",
        names.path_segment(F.concat("p_brand", F.lit(":"), "p_name", F.lit("/\\"))).alias("segment"),
        names.part_name(F.concat("p_brand", F.lit("-items.json")), size % 3).alias("file"),
        quoted(text).alias("quoted"),
        names.json_number(number).alias("number"),
    )


MOD = "'mod_' || lpad(CAST({} AS VARCHAR), 8, '0')"


@query(f"""
SELECT {MOD.format('s_suppkey')} AS mod_id, 'container=' || {MOD.format('s_suppkey')} || '.jar;containerKind=jar;containerBytes=' || CASE WHEN s_suppkey % 13 = 0 THEN 67108864 + s_suppkey ELSE s_suppkey * 1000 END
  || CASE WHEN s_suppkey % 17 <> 0 THEN ';containerEntries=3' ELSE '' END || CASE WHEN s_suppkey % 6 = 0 THEN ';manifest.MixinConfigs=a.mixins.json' ELSE '' END AS facts FROM supplier WHERE s_suppkey % 11 <> 0
""")
def container_facts(table, spark):
    """Containers' facts as pairs, as the records of mods carry them."""
    facts = checks.container_facts(_catalogue(table).containers)
    return facts.select("mod_id", F.array_join(F.transform("facts", lambda p: F.concat_ws("=", p["k"], p["v"])), ";").alias("facts"))


@query(f"""
SELECT 'mixin:' || {MOD.format('s_suppkey')} || '.mixins.json' AS key, 'nation_' || s_nationkey AS namespace, CASE WHEN s_suppkey % 3 = 0 THEN 'net.T' || (s_suppkey % 7) ELSE 'm.C' || (s_suppkey % 10) END AS targets, 'true' AS required, '1' AS classes FROM supplier
""")
def mixin_records(table, spark):
    """A record for each mixin configuration, under its mod's namespace."""
    held = _catalogue(table)
    rows = checks.mixin_records(held.mixins, held.mods).withColumn("x", F.map_from_entries("extra"))
    return rows.select("key", "namespace", F.array_join("values", ",").alias("targets"), F.col("x")["required"].alias("required"), F.col("x")["mixinClasses"].alias("classes"))


@query(f"""
SELECT 'ns:nation_' || s_nationkey AS key, string_agg({MOD.format('s_suppkey')}, ', ' ORDER BY s_suppkey) AS owners, CAST(count(*) AS VARCHAR) AS owner_count, CASE WHEN count(*) > 1 THEN 'true' ELSE 'false' END AS conflict FROM supplier GROUP BY s_nationkey
""")
def namespace_records(table, spark):
    """A record for each claimed namespace, with its owners."""
    rows = checks.namespace_records(_catalogue(table).mods).withColumn("x", F.map_from_entries("extra"))
    return rows.select("key", F.col("x")["owners"].alias("owners"), F.col("x")["ownerCount"].alias("owner_count"), F.col("x")["conflict"].alias("conflict"))


@query(f"""
WITH n AS (SELECT max(s_suppkey) AS n FROM supplier),
l0 AS (SELECT DISTINCT l_suppkey AS s, l_partkey % (n + 2) + 1 AS d, CASE WHEN l_linenumber = 7 THEN 'INCOMPATIBLE' WHEN l_linenumber % 2 = 0 THEN 'OPTIONAL' ELSE 'EMBEDDED' END AS kind FROM lineitem, n),
l AS (SELECT * FROM l0 UNION ALL SELECT s, arg_min(d, ((d * 7919 + s * 31) % 1009, d)), 'REQUIRED' FROM l0 GROUP BY s),
o AS (SELECT s, count(*) AS own, string_agg({MOD.format('d')}, ', ' ORDER BY d) FILTER (WHERE kind = 'REQUIRED') AS needs, string_agg({MOD.format('d')}, ', ' ORDER BY d) FILTER (WHERE kind = 'INCOMPATIBLE') AS rejects, count(*) FILTER (WHERE kind = 'REQUIRED' AND d NOT IN (SELECT s_suppkey FROM supplier)) AS lacks FROM l GROUP BY s),
b AS (SELECT d, count(*) AS n, string_agg({MOD.format('s')}, ', ' ORDER BY s) AS users FROM l WHERE kind = 'REQUIRED' AND s IN (SELECT s_suppkey FROM supplier) GROUP BY d)
SELECT 'dep:' || {MOD.format('s_suppkey')} AS key, coalesce(own, 0) AS own, coalesce(b.n, 0) AS dependents, coalesce(lacks, 0) AS missing, needs AS depends_on, rejects, users AS required_by FROM supplier LEFT JOIN o ON s = s_suppkey LEFT JOIN b ON b.d = s_suppkey
""")
def dependency_records(table, spark):
    """A record for each mod: how much it declares, what it requires and rejects, what requires it, what is missing."""
    held = _catalogue(table)
    rows = checks.dependency_records(held.mods, held.containers).withColumn("x", F.map_from_entries("extra"))
    number = lambda k: F.col("x")[k].cast("long")
    return rows.select("key", number("dependencyCount").alias("own"), number("dependentsCount").alias("dependents"), number("missingRequired").alias("missing"), F.col("x")["dependsOn"].alias("depends_on"), F.col("x")["declaresIncompatible"].alias("rejects"), F.col("x")["requiredBy"].alias("required_by"))


@query("""
SELECT l_orderkey AS id, CAST(CASE WHEN l_orderkey % 2 = 0 THEN (l_linenumber - 1) % 2 + 3 * ((l_linenumber - 1) // 2) + 1 ELSE l_linenumber END AS INT) AS slot, CASE WHEN l_suppkey % 4 = 0 THEN '#t:' ELSE 'i:' END || l_suppkey AS ingredient
FROM (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS l_linenumber FROM lineitem) WHERE l_suppkey % 9 <> 0
""")
def recipe_slots(table, spark):
    """Orders as recipes, shaped on a grid of two columns or without a shape; some lines have no ingredient and keep their place."""
    part = F.when(F.col("l_suppkey") % 9 == 0, "").otherwise(F.concat(F.when(F.col("l_suppkey") % 4 == 0, "#t:").otherwise("i:"), F.col("l_suppkey").cast("string")))
    lines = table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", part.alias("i")))), lambda x: x["i"]).alias("ingredients"))
    recipes = lines.select("id", F.lit(0).alias("ord"), F.when(F.col("id") % 2 == 0, "shaped").otherwise("shapeless").alias("type"), F.lit(2).alias("width"), "ingredients")
    return scans.recipe_inputs(recipes.union(recipes.withColumn("ord", F.lit(1)).withColumn("ingredients", F.array(F.lit("late")))))


@query("""
WITH c AS (SELECT s_suppkey AS k, 'p' || (s_suppkey % 5) AS p FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0)
SELECT 'f' || k AS path, p || '.A' || k AS cls, 'common' AS env, NULL AS explicit_target FROM c UNION ALL SELECT 'f' || k, p || '.B', 'common', 'T' || (k % 3) FROM c UNION ALL SELECT 'f' || k, p || '.C', 'common', 'T' || (k % 3) FROM c UNION ALL SELECT 'f' || k, p || '.D', 'client', NULL FROM c
""")
def mixin_configs(table, spark):
    """Entries of suppliers' mixin configurations; some lack the package, some are torn."""
    k = F.col("s_suppkey")
    text = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in x])
    good = text('{"package":"p', k % 5, '","mixins":["A', k, '",{"target":"T', k % 3, '","mixins":["B","C"]}],"client":["D"]}')
    content = F.when(k % 7 == 0, '{"mixins":["A"]}').when(k % 11 == 0, '{"package":').otherwise(good)
    return scans.mixin_entries(table("supplier").select(text("f", k).alias("path"), content.alias("content"))).drop("at")


SWEPT = "['textures/a', '/lang/a', 'own/a', 'other/a', 'sounds.json', 'textures/.hidden', 'models//a', 'textures']"


@query(f"SELECT doc_id, {SWEPT}[doc_id % 8 + 1] AS path FROM documents WHERE doc_id % 8 IN (0, 1, 2, 4)")
def asset_sweep(table, spark):
    """Paths of assets, some below a declared folder, some hidden or at the root."""
    known = [x.strip().strip("'") for x in SWEPT.strip("[]").split(",")]
    files = table("documents").select("doc_id", F.get(F.array(*[F.lit(x) for x in known]), (F.col("doc_id") % 8).cast("int")).alias("path"))
    return documents.sweep(files, ("own", "Bad/one"))


@query("""
SELECT 'items/' || (o_custkey % 500) AS path, sha256(CAST(max(o_orderkey) AS VARCHAR)) AS fingerprint FROM orders WHERE o_orderkey % 7 > 1 GROUP BY 1
""")
def snapshot_lines(table, spark):
    """Orders as lines of a manifest: of a path given twice the later line counts; some lines are remarks or torn."""
    key = F.col("o_orderkey")
    good = F.concat_ws("\t", delta.fingerprint(key.cast("string")), F.concat(F.lit("items/"), (F.col("o_custkey") % 500).cast("string")))
    value = F.when(key % 7 == 0, F.concat(F.lit("// "), good)).when(key % 7 == 1, F.substring(good, 3, 1000)).otherwise(good)
    lines = table("orders").select(value.alias("value"), (key + 1).alias("n"))
    return delta.read_snapshot(lines.union(spark.createDataFrame([(delta.HEADER, 0)], "value string, n long"))).select("path", "fingerprint")


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_type END AS title, CASE WHEN p_size % 2 = 0 THEN 'i:' || p_partkey END AS icon, 'task' AS frame, p_size % 2 = 0 AS hidden, CASE WHEN p_size % 5 = 0 THEN 'tick' ELSE 'tick,' || p_size END AS triggers, 3 AS criteria, CAST(p_size % 4 AS INT) AS reward_recipes, CAST(p_size AS INT) AS experience FROM part WHERE p_partkey % 10 <> 0
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 10 = 0
""")
def advancements(table, spark):
    """Parts as advancements: literal titles beat keys, triggers are distinct and in order; one in ten is torn."""
    size, none = F.col("p_size"), F.lit(None).cast("string")
    title = F.struct(F.when(size % 3 == 0, F.col("p_name")).alias("text"), F.col("p_type").alias("translate"))
    icon = F.struct(F.when(size % 2 == 0, F.concat(F.lit("i:"), F.col("p_partkey").cast("string"))).alias("id"), none.alias("item"))
    one = lambda t: F.struct(t.alias("trigger"))
    criteria = F.struct(one(F.lit("tick")).alias("a"), one(F.when(size % 5 == 0, "").otherwise(size.cast("string"))).alias("b"), one(F.lit("tick")).alias("c"))
    rewards = F.struct(F.slice(F.array(*[F.lit("r")] * 3), F.lit(1), (size % 4).cast("int")).alias("recipes"), size.alias("experience"))
    content = F.to_json(F.struct(F.struct(title.alias("title"), icon.alias("icon"), F.lit("task").alias("frame"), (size % 2 == 0).alias("hidden")).alias("display"), criteria.alias("criteria"), rewards.alias("rewards")))
    torn = F.when(F.col("p_partkey") % 10 == 0, F.substring(content, 1, 20)).otherwise(content)
    # a part is few bytes and much work: Spark deals work by bytes
    return table("part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).select("p_partkey", documents.advancement(torn).alias("a")).select("p_partkey", "a.title", "a.icon", "a.frame", "a.hidden", F.array_join("a.triggers", ",").alias("triggers"), "a.criteria", "a.reward_recipes", "a.experience")


@query("""
SELECT p_partkey, loader, CASE loader WHEN 'forge' THEN CASE WHEN p_size % 2 = 0 THEN 'REQUIRED' ELSE 'OPTIONAL' END
  WHEN 'neoforge' THEN CASE p_size % 4 WHEN 0 THEN 'REQUIRED' WHEN 1 THEN 'INCOMPATIBLE' ELSE 'OPTIONAL' END
  ELSE CASE p_size % 4 WHEN 0 THEN 'REQUIRED' WHEN 1 THEN 'INCOMPATIBLE' WHEN 2 THEN 'OPTIONAL' ELSE 'UNKNOWN' END END AS kind FROM part, (VALUES ('forge'), ('neoforge'), ('fabric')) l(loader)
""")
def loader_kinds(table, spark):
    """What each loader makes of one and the same declaration."""
    word = F.get(F.array(*[F.lit(w) for w in ("required", " Incompatible", "optional", "odd")]), (F.col("p_size") % 4).cast("int"))
    rows = table("part").select("p_partkey", word.alias("type"), (F.col("p_size") % 2 == 0).alias("mandatory"))
    return checks.union(*[documents.loader_dependencies(rows, loader).select("p_partkey", F.lit(loader).alias("loader"), "kind") for loader in ("forge", "neoforge", "fabric")])


@query("""
SELECT p_partkey, CAST(3 + p_size % 2 AS INT) AS commands, 'm:f' || p_size || CASE WHEN p_size % 2 = 1 THEN ',m:late' ELSE '' END AS functions, 'm:t' AS tags, '$(x):y' AS dynamic FROM part
""")
def function_calls(table, spark):
    """What parts' functions call: at the start, behind run and schedule, never inside quotes."""
    size = F.col("p_size")
    lines = F.concat(F.lit("function m:f"), size.cast("string"), F.lit('\nsay "function m:no"\n$execute run function $(x):y\nexecute as @a run function #m:t\n'), F.when(size % 2 == 1, "schedule function m:late 1t\n").otherwise("# function m:remark\n"))
    return table("part").select("p_partkey", documents.function(lines).alias("f")).select("p_partkey", "f.commands", F.array_join("f.functions", ",").alias("functions"), F.array_join("f.tags", ",").alias("tags"), F.array_join("f.dynamic", ",").alias("dynamic"))


def _items(table):
    """Parts as items: names, sizes and tags."""
    space = F.lower(F.translate("p_brand", "#", "_"))
    return table("part").select(F.concat(space, F.lit(":"), F.col("p_partkey").cast("string")).alias("registry_name"), space.alias("namespace"), F.col("p_size").cast("int").alias("max_stack"), F.split("p_name", " ").alias("tags"))


ITEMS = """p AS (SELECT lower(replace(p_brand, '#', '_')) AS ns, lower(replace(p_brand, '#', '_')) || ':' || p_partkey AS id, CAST(p_size AS INT) AS n, string_split(p_name, ' ') AS tags FROM part)"""


@query(f"""
WITH {ITEMS}, t AS (SELECT *, '"' || array_to_string(tags, '","') || '"' AS listed, '"' || array_to_string(tags, '", "') || '"' AS spaced FROM p)
SELECT id, 'ndjson' AS format, '{{"registryName":"' || id || '","namespace":"' || ns || '","maxStackSize":' || n || ',"tags":[' || listed || ']}}' AS record FROM t
UNION ALL SELECT id, 'json', '{{"registryName":"' || id || '","namespace":"' || ns || '","maxStackSize":' || n || ',"tags":[' || listed || ']}}' FROM t
UNION ALL SELECT id, 'yaml', '  - registryName: "' || id || '"' || chr(10) || '    namespace: "' || ns || '"' || chr(10) || '    maxStackSize: ' || n || chr(10) || '    tags:' || chr(10) || '      - "' || array_to_string(tags, '"' || chr(10) || '      - "') || '"' FROM t
UNION ALL SELECT id, 'toml', '[[items]]' || chr(10) || 'registryName = "' || id || '"' || chr(10) || 'namespace = "' || ns || '"' || chr(10) || 'maxStackSize = ' || n || chr(10) || 'tags = [' || spaced || ']' || chr(10) FROM t
UNION ALL SELECT id, 'xml', '  <item>' || chr(10) || '    <registryName>' || id || '</registryName>' || chr(10) || '    <namespace>' || ns || '</namespace>' || chr(10) || '    <maxStackSize>' || n || '</maxStackSize>' || chr(10) || '    <tags><v>' || array_to_string(tags, '</v><v>') || '</v></tags>' || chr(10) || '  </item>' FROM t
UNION ALL SELECT id, 'td', '  {{registryName = "' || id || '", namespace = "' || ns || '", maxStackSize = ' || n || ', tags = [' || spaced || ']}}' FROM t
UNION ALL SELECT id, 'wiki', '{{"registerName":"' || id || '","type":"Item","maxStackSize":"' || n || '","maxDurability":"0","TagList":[' || listed || ']}}' FROM t
UNION ALL SELECT id, 'wiki_v1', '{{"registerName":"' || id || '","CreativeTabName":"","type":"Item","OredictList":"[' || array_to_string(tags, ', ') || ']","maxStacksSize":' || n || ',"maxDurability":0}}' FROM t
""")
def rendered_records(table, spark):
    """Each item in each format."""
    rows = _items(table)
    shown = sinks.projected(rows.withColumn("id", F.col("registry_name")), "item", ("id",))
    parts = []
    for form, f in sinks.FORMATS.items():
        own = rows.withColumn("id", F.col("registry_name")) if form.startswith("wiki") else shown
        fields = rows if form.startswith("wiki") else shown.drop("id")
        parts.append(own.select("id", F.lit(form).alias("format"), f.record(fields, "item").alias("record")))
    return checks.union(*parts)


@query(f"""
WITH {ITEMS} SELECT ns AS namespace, f AS format, count(*) AS records, CASE f WHEN 'json' THEN '{{"items":[' WHEN 'yaml' THEN 'items:' WHEN 'td' THEN 'items = [' WHEN 'xml' THEN '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<catalogue kind="items">' END AS opens,
  CASE f WHEN 'json' THEN ']}}' WHEN 'td' THEN ']' WHEN 'xml' THEN '</catalogue>' END AS closes, CASE WHEN f = 'json' THEN count(*) - 1 ELSE 0 END AS commas, min(id) AS first FROM p, (VALUES ('json'), ('ndjson'), ('yaml'), ('toml'), ('xml'), ('td')) v(f) GROUP BY ns, f
""")
def rendered_shards(table, spark):
    """What opens and closes each shard in each format, its records and what stands between them."""
    parts = []
    for form in ("json", "ndjson", "yaml", "toml", "xml", "td"):
        lines = sinks.rendered(_items(table), "item", form)
        at = F.col("place")
        one = lambda n: F.max(F.when(at == n, F.col("line")))
        inner = at.isin(1, 2)
        parts.append(lines.groupBy("namespace").agg(F.lit(form).alias("format"), F.count_if(inner).alias("records"), one(0).alias("opens"), one(3).alias("closes"), F.count_if(inner & F.col("line").startswith(",")).alias("commas"), F.min(F.when(inner, F.col("_order"))).alias("first")))
    return checks.union(*parts)


@query("""
SELECT s_suppkey AS k, 'm' || s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'a@>=1:REQUIRED,b@*:REQUIRED,c:INCOMPATIBLE' ELSE 'a@^2:REQUIRED' END AS deps, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'p,q' END AS providers FROM supplier WHERE s_suppkey % 5 <> 0
""")
def mod_descriptors(table, spark):
    """Suppliers' descriptors of two loaders; one in five has no id or is torn."""
    k, key = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    text = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    flat = text('{"id":"m', key, '","name":"', F.col("s_name"), '","depends":{"a":">=1","b":"*"},"breaks":["c"]}')
    nested = text('{"quilt_loader":{"id":"m', key, '","metadata":{"name":"', F.col("s_name"), '"},"depends":[{"id":"a","versions":"^2"},{"x":1}],"provides":["p",{"id":"q"}]}}')
    content = F.when(k % 10 == 0, '{"name":"x"}').when(k % 5 == 0, '{"id":').when(k % 2 == 0, flat).otherwise(nested)
    rows = documents.descriptors(table("supplier").select(key.alias("path"), content.alias("content")))
    deps = F.array_join(F.transform("dependencies", lambda d: F.concat(F.concat_ws("@", d["id"], d["range"]), F.lit(":"), d["kind"])), ",")
    return rows.select(F.col("path").cast("long").alias("k"), "id", "name", deps.alias("deps"), F.array_join("providers", ",").alias("providers"))


@query("""
WITH f AS (SELECT p_brand AS b, p_size AS s FROM part)
SELECT CASE WHEN s % 3 = 0 THEN 'pack' || (s % 10) ELSE 'zip' || (s % 10) || '.ZIP' END AS name, s % 3 = 0 AS is_dir, CAST(sum(s) AS BIGINT) AS bytes FROM f WHERE s % 3 <> 2 GROUP BY 1, 2
""")
def discovered_packs(table, spark):
    """Packs right under a folder: directories by what lies in them, archives by their ending."""
    s = F.col("p_size")
    n = (s % 10).cast("string")
    path = F.when(s % 3 == 0, F.concat(F.lit("/packs/pack"), n, F.lit("/data/"), "p_brand")).when(s % 3 == 1, F.concat(F.lit("/packs/zip"), n, F.lit(".ZIP"))).otherwise(F.concat(F.lit("/packs/loose"), n, F.lit(".txt")))
    return scans.discovered(table("part").select(path.alias("path"), s.cast("long").alias("length")), "/packs")


@query("""
SELECT kind, id FROM (SELECT 'mod' AS kind, 's' || s_suppkey AS id FROM supplier WHERE s_suppkey NOT IN (2, 3) UNION ALL SELECT 'item', 's' || s_suppkey FROM supplier)
""")
def mod_exclusion(table, spark):
    """Excluded mods lose their own records; items of the same id stay."""
    own = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    rows = table("supplier").select(F.explode(F.array(F.lit("mod"), F.lit("item"))).alias("kind"), own.alias("id"), F.lit("ns").alias("namespace"), F.array().cast("array<string>").alias("tags"))
    filters = routing.Filters(excluded_mods=("s2", "s3"))
    return routing.written(routing.route(rows, filters), filters).select("kind", "id")


@query("""
SELECT 'sounds/' || ns || '/' || ns || '-sounds.ndjson' AS path, count(*) AS records FROM (SELECT replace(lower(o_orderpriority), '/', '_') AS ns, o_orderstatus FROM orders) WHERE o_orderstatus <> 'F' GROUP BY ns
""")
def values_as_tags(table, spark):
    """Generic records are filtered by their values, which stand for tags; the files that they would go to."""
    settings = Settings(formats=("ndjson",), kinds=("sound",), analyze=False, excluded_tags=("F",))
    held = _catalogue(table)
    return export.export(replace(held, kinds={"sound": held.kinds["sound"]}), "unused", settings, dry_run=True).artifacts.select("path", "records")


@query("""
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN '' ELSE 't:' || p_size END AS type, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN '' ELSE 's:1,s:2' END AS "references", CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN '' ELSE 'elements=3' END AS counts,
  CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN CAST(p_size AS VARCHAR) ELSE '' END AS constant, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_partkey % 2 = 0 END AS recognised FROM part
""")
def worldgen_files(table, spark):
    """Parts as files of world generation: objects with references and lists, a scalar, or torn; of a known kind or not."""
    size = F.col("p_size").cast("string")
    whole = F.concat(F.lit('{"type":"t:'), size, F.lit('","structures":["s:1",{"structure":"s:2"},"s:1",3],"elements":[1,2,3]}'))
    content = F.when(F.col("p_size") % 7 == 0, F.lit("{")).when(F.col("p_size") % 7 == 1, size).otherwise(whole)
    kind = F.when(F.col("p_partkey") % 2 == 0, sorted(documents.WORLDGEN_KINDS)[0]).otherwise("odd")
    counts = F.array_join(F.transform("w.counts", lambda c: F.concat_ws("=", c["k"], c["n"].cast("string"))), ",")
    return table("part").select("p_partkey", documents.worldgen(kind, content).alias("w")).select("p_partkey", "w.type", F.array_join("w.references", ",").alias("references"), counts.alias("counts"), "w.constant", "w.recognised")
