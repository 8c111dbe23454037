"""Queries over the test tables, one for each operator, each with the SQL it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog import schema
from stratalog.functions import versions
from stratalog.functions.names import display_width, utf16
from stratalog.operators import checks, delta, encodings, graphs, merge, predicates, routing, rules
from stratalog.sources import documents, records, scans

from . import export
from .config import Settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (table reader, session) under its own name."""

    def take(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return take


def _parts(table) -> DataFrame:
    """Parts as catalogue records: namespace from the brand, id from brand and name, the name's words as tags."""
    ns = F.lower(F.translate("p_brand", "#", "_"))
    return table("part").select(F.lit("item").alias("kind"), "p_partkey", ns.alias("namespace"), F.concat(ns, F.lit(":"), F.translate("p_name", " ", "_")).alias("id"), F.split("p_name", " ").alias("tags"), "p_size", "p_type", "p_brand")


PARTS = "(SELECT 'item' AS kind, p_partkey, lower(replace(p_brand, '#', '_')) AS namespace, lower(replace(p_brand, '#', '_')) || ':' || replace(p_name, ' ', '_') AS id, string_split(p_name, ' ') AS tags, p_size, p_type, p_brand FROM part)"


@query(f"""
WITH r AS (SELECT p_partkey, namespace FROM {PARTS} UNION ALL SELECT -1, NULL)
SELECT p_partkey, coalesce(namespace NOT IN ('brand_11', 'brand_12') AND namespace IN ('brand_12', 'brand_13', 'brand_21', 'brand_31'), false) AS allowed FROM r
""")
def ns_filter(table, spark):
    rows = _parts(table).select("p_partkey", "namespace").union(spark.sql("SELECT -1L, CAST(NULL AS STRING)"))
    return rows.select("p_partkey", predicates.namespace_allowed(F.col("namespace"), ["brand_12", "brand_13", "brand_21", "brand_31"], ["brand_11", "brand_12"]).alias("allowed"))


@query(f"""
SELECT p_partkey, NOT list_has_any(tags, ['red', 'lime']) AND list_has_any(tags, ['widget', 'gear', 'small', 'blue', 'metal', 'part']) AS allowed FROM {PARTS}
""")
def tag_filter(table, spark):
    return _parts(table).select("p_partkey", predicates.tags_allowed(F.col("tags"), ["widget", "gear", "small", "blue", "metal", "part"], ["red", "lime"]).alias("allowed"))


@query(f"""
SELECT p_partkey, starts_with(path, 'part') AND contains(path, '1') AND NOT ends_with(path, 'zz') AS hit,
       ends_with(path, '7') AND namespace = 'brand_13' AS seventh
FROM (SELECT *, substr(id, instr(id, ':') + 1) AS path FROM {PARTS})
""")
def selector(table, spark):
    args = (F.col("id"), F.col("namespace"), F.col("tags"))
    hit = predicates.Selector(prefix="part", contains="1").matches(*args) & ~predicates.Selector(suffix="zz").matches(*args)
    return _parts(table).select("p_partkey", hit.alias("hit"), predicates.Selector(namespace="brand_13", suffix="7", id=" ").matches(*args).alias("seventh"))


_FILTERS = routing.Filters(excluded_namespaces=["brand_11", "nation_3"], excluded_tags=["Part#3"])


def _routed(table) -> DataFrame:
    none = F.array().cast("array<string>")
    others = [table(t).select(F.lit(k).alias("kind"), F.concat(F.lit("nation_"), F.col(c).cast("string")).alias("namespace"), none.alias("tags")) for t, k, c in (("supplier", "mod", "s_nationkey"), ("customer", "entity", "c_nationkey"))]
    alone = table("region").select(F.lit("biome").alias("kind"), F.lit("nation_3").alias("namespace"), none.alias("tags"))
    return routing.route(_parts(table).select("kind", "namespace", "tags").union(others[0]).union(others[1]).union(alone), _FILTERS)


ROUTED = f"""(SELECT kind, namespace, namespace NOT IN ('brand_11', 'nation_3') AND NOT list_contains(tags, 'Part#3') AS accepted FROM (
  SELECT kind, namespace, tags FROM {PARTS} UNION ALL SELECT 'mod', 'nation_' || s_nationkey, [] FROM supplier UNION ALL SELECT 'entity', 'nation_' || c_nationkey, [] FROM customer UNION ALL SELECT 'biome', 'nation_3', [] FROM region))"""


@query(f"SELECT kind, namespace, count(*) FILTER (accepted) AS counted, count(*) FILTER (NOT accepted) AS filtered FROM {ROUTED} GROUP BY 1, 2")
def route_counts(table, spark):
    return routing.counts(_routed(table))


@query(f"SELECT count(*) FILTER (accepted) AS counted, count(*) FILTER (NOT accepted) AS filtered, count(DISTINCT namespace) FILTER (accepted) AS namespaces, count(DISTINCT kind) FILTER (accepted) AS kinds FROM {ROUTED}")
def route_totals(table, spark):
    return routing.totals(_routed(table))


@query(f"""
SELECT kind, CAST(sum(n) AS BIGINT) AS total, CAST(sum(f) AS BIGINT) AS filtered, count(*) FILTER (n > 0) AS namespaces, coalesce(string_agg(namespace || '=' || n, ', ' ORDER BY namespace) FILTER (n > 0), '') AS by_namespace
FROM (SELECT kind, namespace, count(*) FILTER (accepted) AS n, count(*) FILTER (NOT accepted) AS f FROM {ROUTED} GROUP BY 1, 2) GROUP BY kind
""")
def coverage(table, spark):
    """The kind biome has filtered records only."""
    return routing.coverage(routing.counts(_routed(table))).drop("names")


@query(f"""
SELECT p_partkey, target FROM (SELECT *, substr(id, instr(id, ':') + 1) AS path FROM {PARTS}) p
JOIN (VALUES ('ones', '1', NULL), ('brand', NULL, 'brand_13'), ('both', '2', 'brand_21')) t(target, suffix, ns)
ON (suffix IS NULL OR ends_with(path, suffix)) AND (ns IS NULL OR ns = namespace)
""")
def targets(table, spark):
    s = predicates.Selector
    return routing.to_targets(_parts(table), {"ones": s(suffix="1"), "brand": s(namespace="brand_13"), "both": s(namespace="brand_21", suffix="2")}).select("p_partkey", "target")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def field_mask(table, spark):
    return predicates.masked(table("orders"), include=["o_orderstatus", "o_orderpriority", "o_totalprice"], exclude=["o_totalprice"], identity=["o_orderkey"])


# dependency edges


@query("SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS n FROM lineitem ANTI JOIN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) ON l_partkey = p_partkey GROUP BY 1, 2")
def missing_dep(table, spark):
    edge = table("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("REQUIRED").alias("kind"))
    present = table("part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"))
    return checks.missing_required(edge, present).groupBy("src", "dst").agg(F.count("*").alias("n"))


def _edges(table) -> DataFrame:
    """Distinct edges among suppliers: a line's supplier and the one whose key is nearest its part's, so nodes grow with the table."""
    kind = F.when(F.col("l_linenumber") % 2 == 0, "INCOMPATIBLE").otherwise("REQUIRED")
    nodes = table("supplier").agg(F.max("s_suppkey").alias("n"))  # one row
    return table("lineitem").join(F.broadcast(nodes)).select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % F.col("n") + 1).alias("dst"), kind.alias("kind")).distinct()


EDGES = "(SELECT DISTINCT l_suppkey AS src, l_partkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS dst, CASE WHEN l_linenumber % 2 = 0 THEN 'INCOMPATIBLE' ELSE 'REQUIRED' END AS kind FROM lineitem)"


@query("SELECT dst, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS required_by FROM (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem) GROUP BY dst")
def required_by(table, spark):
    edge = table("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return checks.required_by(edge.withColumn("kind", F.lit("REQUIRED"))).select("dst", F.array_join("required_by", ",").alias("required_by"))


@query(f"""
SELECT a.src, a.dst, b.src IS NOT NULL AS mutual FROM {EDGES} a LEFT JOIN {EDGES} b ON b.kind = 'INCOMPATIBLE' AND b.src = a.dst AND b.dst = a.src
WHERE a.kind = 'INCOMPATIBLE' AND a.dst IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0)
""")
def incompat_mutual(table, spark):
    return checks.incompatible(_edges(table), table("supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("id")))


@query(f"SELECT a.src, a.dst FROM {EDGES} a JOIN {EDGES} b ON a.kind = 'INCOMPATIBLE' AND b.kind = 'REQUIRED' AND b.src = a.dst AND b.dst = a.src")
def contradictory(table, spark):
    return checks.contradictory(_edges(table))


@query("SELECT md5(text) AS id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(table, spark):
    return checks.duplicates(table("documents").filter("text is not null").select(F.md5("text").alias("id")))


def _claims(table) -> DataFrame:
    return table("supplier").select(F.col("s_nationkey").alias("namespace"), F.col("s_suppkey").alias("owner"))


@query("SELECT s_nationkey AS namespace, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS owners, count(*) AS n FROM supplier GROUP BY 1")
def ns_claims(table, spark):
    return checks.owners(_claims(table)).select("namespace", F.array_join("owners", ",").alias("owners"), F.col("n").cast("long").alias("n"))


@query("SELECT s_nationkey AS namespace, count(DISTINCT s_suppkey) AS n FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey) > 1")
def ns_conflict(table, spark):
    return checks.owners(_claims(table)).filter("n > 1").select("namespace", F.col("n").cast("long").alias("n"))


@query("SELECT DISTINCT d.doc_id FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def orphan_ns(table, spark):
    return checks.orphans(table("documents"), table("labels"), "doc_id")


@query("SELECT p_name AS target, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS owners FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def mixin_shared(table, spark):
    return checks.shared_targets(table("part").select(F.col("p_name").alias("target"), F.col("p_brand").alias("owner"))).select("target", F.array_join("owners", ",").alias("owners"))


@query("SELECT event_type, string_agg(CAST(user_id AS VARCHAR), ', ' ORDER BY user_id) AS members, count(*) AS n FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY 1")
def built_for(table, spark):
    return checks.grouped_by(table("events").select("event_type", "user_id").distinct(), "event_type", "user_id")


SPANS = "(SELECT p_partkey // 10 AS ns, min(p_partkey) AS first, max(p_partkey) AS last, count(*) AS n, count(*) = max(p_partkey) - min(p_partkey) + 1 AS contiguous FROM part WHERE p_size < 45 GROUP BY 1)"


def _spans(table) -> DataFrame:
    return encodings.contiguous_spans(table("part").filter("p_size < 45").withColumn("ns", F.floor(F.col("p_partkey") / 10)), "ns", "p_partkey")


@query(f"SELECT * FROM {SPANS}")
def reg_spans(table, spark):
    return _spans(table)


@query(f"SELECT ns, n FROM {SPANS} WHERE NOT contiguous")
def interleaved(table, spark):
    return _spans(table).filter("NOT contiguous").select("ns", "n")


@query("""
SELECT p_partkey, range, CASE
  WHEN range = '[1.10,1.30)' THEN CASE WHEN p_size >= 10 AND p_size < 30 THEN 'SATISFIED' ELSE 'VIOLATED' END
  WHEN range = '(,1.20]' THEN CASE WHEN p_size < 20 OR (p_size = 20 AND p_partkey % 3 = 0) THEN 'SATISFIED' ELSE 'VIOLATED' END
  WHEN range = 'v1.7.x' THEN CASE WHEN p_size = 7 THEN 'SATISFIED' ELSE 'VIOLATED' END
  WHEN range = '[1.5.1],[1.40,)' THEN CASE WHEN (p_size = 5 AND p_partkey % 3 = 1) OR p_size >= 40 THEN 'SATISFIED' ELSE 'VIOLATED' END
  WHEN range = '>=1.0' THEN 'VIOLATED'
  ELSE 'UNKNOWN' END AS verdict
FROM part, (VALUES ('[1.10,1.30)'), ('(,1.20]'), ('v1.7.x'), ('[1.5.1],[1.40,)'), ('[1.beta,2)'), ('1.0,2.0'), ('>=1.0')) r(range)
""")
def version_check(table, spark):
    text = F.concat(F.lit("v1."), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 3).cast("string"))
    ranges = ["[1.10,1.30)", "(,1.20]", "v1.7.x", "[1.5.1],[1.40,)", "[1.beta,2)", "1.0,2.0", ">=1.0"]
    rows = table("part").select("p_partkey", F.explode(F.array(*[F.lit(r) for r in ranges])).alias("range"), text.alias("v"))
    return versions.judged(rows, "v", "range").select("p_partkey", "range", "verdict")


@query("SELECT DISTINCT n_name AS id, loader FROM (SELECT n_name, ['fabric', 'quilt', 'forge', 'neoforge'][n_nationkey % 4 + 1] AS loader FROM nation) WHERE loader NOT IN ('quilt', 'fabric')")
def loader_table(table, spark):
    loaders = F.array(*[F.lit(x) for x in ("fabric", "quilt", "forge", "neoforge")])
    mods = table("nation").select(F.col("n_name").alias("id"), F.element_at(loaders, F.col("n_nationkey") % 4 + 1).alias("loader"))
    return checks.cannot_load(mods, "Quilt")


# declarative rules over part types (mods), event types and counts

RULES = [
    ("has", "p", "REQUIRE_MOD", "ERROR", "ECONOMY", None, None, None, None, None),
    ("lacks", "p", "require-mod", None, "NO SUCH TYPE", None, None, None, None, None),
    ("none", "p", "FORBID_MOD", None, "PROMO", None, None, None, None, "no promotions"),
    ("some", "p", "REQUIRE_TOGETHER", None, None, ["ECONOMY", "ABSENT", "PROMO"], None, None, None, None),
    ("one", "p", "MUTUALLY_EXCLUSIVE", "INFO", None, ["PROMO", "ABSENT", "ECONOMY", "STANDARD"], None, None, None, None),
    ("patch", "p", "FORBID_MIXIN_TARGET", None, None, None, "click", None, None, None),
    ("seen", "p", "REQUIRE_NAMESPACE", None, None, None, None, "click", None, None),
    ("unseen", "p", "REQUIRE_NAMESPACE", None, None, None, None, "nowhere", None, None),
    ("many", "p", "MIN_COUNT", None, None, None, "items", None, 10**9, None),
    ("gone", "p", "MIN_COUNT", None, None, None, "biome", None, 1, None),
    ("few", "p", "MAX_COUNT", None, None, None, "sound", None, 3, None),
    ("what", "p", "MAX_COUNT", None, None, None, "event", None, 3, None),
]
PRESENT = "(SELECT DISTINCT split_part(p_type, ' ', 1) AS id FROM part)"


def _rules(spark) -> DataFrame:
    from stratalog.schema import RULES as schema

    return spark.createDataFrame(RULES, schema)


def _strategy() -> Column:
    return F.element_at(F.map_from_entries("detail"), "strategy").alias("strategy")


@query(f"""
WITH p AS {PRESENT}
SELECT 'rule:require_mod' AS kind, 'ERROR' AS severity, 'ECONOMY' AS subject, 'has' AS strategy, NULL AS message WHERE 'ECONOMY' NOT IN (SELECT id FROM p)
UNION ALL SELECT 'rule:require_mod', 'WARN', 'NO SUCH TYPE', 'lacks', 'NO SUCH TYPE is required and not loaded' WHERE 'NO SUCH TYPE' NOT IN (SELECT id FROM p)
UNION ALL SELECT 'rule:forbid_mod', 'WARN', 'PROMO', 'none', 'no promotions' WHERE 'PROMO' IN (SELECT id FROM p)
UNION ALL SELECT 'rule:require_together', 'WARN', string_agg(id, ',' ORDER BY pos), 'some', 'these go together: ECONOMY, ABSENT, PROMO' FROM (VALUES (1, 'ECONOMY'), (2, 'ABSENT'), (3, 'PROMO')) g(pos, id) JOIN p USING (id) HAVING count(*) BETWEEN 1 AND 2
UNION ALL SELECT 'rule:mutually_exclusive', 'INFO', string_agg(id, ',' ORDER BY pos), 'one', 'these exclude each other: PROMO, ABSENT, ECONOMY, STANDARD' FROM (VALUES (1, 'PROMO'), (2, 'ABSENT'), (3, 'ECONOMY'), (4, 'STANDARD')) g(pos, id) JOIN p USING (id) HAVING count(*) > 1
UNION ALL SELECT 'rule:forbid_mixin_target', 'WARN', string_agg(DISTINCT CAST(user_id % 7 AS VARCHAR), ',' ORDER BY CAST(user_id % 7 AS VARCHAR)), 'patch', 'click must not be patched' FROM events WHERE event_type = 'click' AND value > 1 HAVING count(*) > 0
""")
def rules_pre(table, spark):
    mods = table("part").select(F.split("p_type", " ")[0].alias("id"))
    entries = table("events").select(F.col("event_type").alias("target"), (F.col("user_id") % 7).cast("string").alias("owner"), (F.col("value") > 1).alias("explicit"))
    return rules.apply_pre(_rules(spark), mods, entries).select("kind", "severity", "subject", _strategy(), "message")


@query("""
WITH c AS (SELECT 'item' AS kind, count(*) AS n FROM part UNION ALL SELECT 'sound', count(*) FROM events)
SELECT 'rule:require_namespace' AS kind, 'WARN' AS severity, 'click' AS subject, 'seen' AS strategy WHERE 'click' NOT IN (SELECT event_type FROM events)
UNION ALL SELECT 'rule:require_namespace', 'WARN', 'nowhere', 'unseen' WHERE 'nowhere' NOT IN (SELECT event_type FROM events)
UNION ALL SELECT 'rule:min_count', 'WARN', 'items=' || n, 'many' FROM c WHERE kind = 'item' AND n < 1000000000
UNION ALL SELECT 'rule:min_count', 'WARN', 'biome=0', 'gone'
UNION ALL SELECT 'rule:max_count', 'WARN', 'sound=' || n, 'few' FROM c WHERE kind = 'sound' AND n > 3
UNION ALL SELECT 'rule_failed', 'WARN', 'what', 'what'
""")
def rules_post(table, spark):
    items = table("part").groupBy(F.lit("item").alias("kind"), F.col("p_brand").alias("namespace")).agg(F.count("*").alias("n"))
    events = table("events").groupBy(F.lit("sound").alias("kind"), F.col("event_type").alias("namespace")).agg(F.count("*").alias("n"))
    return rules.apply_post(_rules(spark), items.union(events)).select("kind", "severity", "subject", _strategy())


# positional merges


@query("""
SELECT event_id, user_id FROM (SELECT *, max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id) AS reset FROM events) WHERE reset IS NULL OR ts >= reset
""")
def stack_merge(table, spark):
    rows = table("events").withColumn("replace", F.col("event_type") == "error")
    return merge.stacked(rows, "user_id", "ts", "replace").select("event_id", "user_id")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def single_winner(table, spark):
    return merge.winner(table("events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""
WITH d AS (SELECT lang AS id, CAST(substr(source, 4) AS INT) % 5 AS rank, doc_id FROM documents),
h AS (SELECT id, rank, head, lead(head) OVER (PARTITION BY id ORDER BY rank) AS next FROM (SELECT id, rank, min(doc_id) AS head FROM d GROUP BY 1, 2))
SELECT d.id, d.rank, doc_id AS source, CASE WHEN doc_id <> head THEN head ELSE next END AS winner, CASE WHEN doc_id <> head THEN 'WARN' ELSE 'INFO' END AS severity
FROM d JOIN h ON d.id = h.id AND d.rank = h.rank WHERE doc_id <> head OR next IS NOT NULL
""")
def shadowing(table, spark):
    rows = table("documents").select(F.col("lang").alias("id"), (F.expr("CAST(substr(source, 4) AS INT)") % 5).alias("rank"), F.col("doc_id").alias("source"))
    return checks.shadowed(rows)


LAYERS = [(0, "format", "json", False), (1, "format", "yaml", False), (2, "format", None, False), (0, "tags", "a,b", True), (2, "tags", "b,c", True), (1, "threads", "4", False)]


@query("SELECT * FROM (VALUES ('format', 'yaml'), ('tags', 'a,b,c'), ('threads', '4')) t(key, value)")
def config_layers(table, spark):
    return merge.layered(spark.createDataFrame(LAYERS, "layer int, key string, value string, accumulates boolean"))


# incremental runs


def _snapshots(table) -> tuple[DataFrame, DataFrame]:
    docs = table("documents")
    path = F.col("doc_id").alias("path")
    altered = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    before = docs.filter("doc_id % 3 <> 0").select(path, delta.fingerprint(altered).alias("fingerprint"))
    return before, docs.filter("doc_id % 5 <> 0").select(path, delta.fingerprint(F.col("text")).alias("fingerprint"))


DELTA = """(SELECT coalesce(a.doc_id, b.doc_id) AS path, CASE WHEN b.f IS NULL THEN 'REMOVED' WHEN a.f IS NULL THEN 'NEW' WHEN a.f = b.f THEN 'UNCHANGED' ELSE 'CHANGED' END AS verdict
FROM (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS f FROM documents WHERE doc_id % 3 <> 0) a
FULL JOIN (SELECT doc_id, sha256(text) AS f FROM documents WHERE doc_id % 5 <> 0) b ON a.doc_id = b.doc_id)"""


@query(f"SELECT * FROM {DELTA}")
def delta_verdict(table, spark):
    return delta.verdicts(*_snapshots(table))


@query(f"SELECT path, verdict FROM {DELTA} WHERE verdict IN ('NEW', 'CHANGED') OR (verdict = 'UNCHANGED' AND path NOT IN (SELECT doc_id FROM labels))")
def delta_write(table, spark):
    return delta.to_write(delta.verdicts(*_snapshots(table)), table("labels").select(F.col("doc_id").alias("path")))


@query(f"""
SELECT count(*) FILTER (verdict = 'NEW') AS "new", count(*) FILTER (verdict = 'CHANGED') AS changed, count(*) FILTER (verdict = 'UNCHANGED') AS unchanged, count(*) FILTER (verdict = 'REMOVED') AS removed,
       count(*) FILTER (verdict <> 'UNCHANGED') AS workload FROM {DELTA}
""")
def delta_summary(table, spark):
    return delta.change_summary(delta.verdicts(*_snapshots(table)))


# parsing


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_parse(table, spark):
    return table("events").select("event_id", F.try_variant_get(documents.parsed(F.col("props")), "$.k", "bigint").alias("k"))


@query("""
SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)
""")
def lang_parse(table, spark):
    return table("events").select("event_id", F.explode(documents.language(F.col("props"))).alias("e")).select("event_id", "e.key", "e.value")


@query()
def line_fold(table, spark):
    """Every document as a text function: what it holds, and what it calls. Held against a plain fold in the tests."""
    return table("documents").select("doc_id", documents.function(F.col("text")).alias("f")).select("doc_id", "f.commands", "f.comments", "f.macros", "f.lines", "f.unterminated", F.array_join("f.functions", ",").alias("functions"))


@query("SELECT p_partkey, 'p:' || p_partkey || ',p:' || (p_partkey + 1) || CASE WHEN p_size > 25 THEN ',p:' || (p_partkey + 2) ELSE '' END AS items, 1 AS pools, CASE WHEN p_size > 25 THEN 5 ELSE 3 END AS entries FROM part")
def loot_walk(table, spark):
    """Tables nested from parts: each part drops itself, its neighbour in an inline table and, of large ones, another among alternatives."""
    inner = F.format_string('{"pools":[{"entries":[{"type":"minecraft:item","name":"p:%d"}]}]}', F.col("p_partkey") + 1)
    more = F.when(F.col("p_size") > 25, F.format_string(',{"type":"alternatives","children":[{"name":"p:%d"}]}', F.col("p_partkey") + 2)).otherwise("")
    text = F.concat(F.format_string('{"type":"t","pools":[{"entries":[{"type":"minecraft:item","name":"p:%d"},{"type":"x","value":', "p_partkey"), inner, F.lit("}"), more, F.lit("]}]}"))
    return table("part").select("p_partkey", documents.loot(text).alias("l")).select("p_partkey", F.array_join("l.items", ",").alias("items"), "l.pools", "l.entries")


@query("SELECT p_partkey, replace(p_brand, '#', '_') || ',#' || p_type AS entries, p_size % 2 = 0 AS replace FROM part")
def tag_parse(table, spark):
    text = F.to_json(F.struct((F.col("p_size") % 2 == 0).alias("replace"), F.array("p_brand", F.concat(F.lit("#"), "p_type")).alias("values")))
    entries = F.transform("t.entries", lambda e: F.concat(F.when(e["nested"], "#").otherwise(""), e["id"]))
    return table("part").withColumn("p_brand", F.translate("p_brand", "#", "_")).select("p_partkey", documents.tag(text).alias("t")).select("p_partkey", F.array_join(entries, ",").alias("entries"), "t.replace")


# encodings and graphs


@query("""
SELECT o_custkey, run, value, count(*) AS length, min(o_orderkey) AS first FROM (
  SELECT o_custkey, o_orderkey, o_orderstatus AS value, CAST(sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS run
  FROM (SELECT *, CASE WHEN o_orderstatus = lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) THEN 0 ELSE 1 END AS new FROM orders)) GROUP BY 1, 2, 3
""")
def rle(table, spark):
    return encodings.runs(table("orders"), "o_custkey", "o_orderkey", "o_orderstatus").withColumnRenamed("o_orderstatus", "value")


@query("SELECT o_custkey, o_orderkey, o_orderkey - coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS difference FROM orders")
def delta_enc(table, spark):
    rows = table("orders").withColumn("v", F.col("o_orderkey"))
    return encodings.differences(rows, "o_custkey", "o_orderkey", "v")


@query("SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS INT) AS code FROM orders GROUP BY 1")
def dict_enc(table, spark):
    return encodings.dictionary(table("orders"), "o_orderkey", "o_orderpriority")


@query("""
SELECT o_custkey, count(*) AS n, CASE WHEN count(*) > 1 AND count(DISTINCT d) = 1 THEN 'RLE' WHEN count(*) > 1 AND min(step) >= 0 THEN 'DELTA' ELSE 'PLAIN' END AS encoding
FROM (SELECT o_custkey, d, d - lag(d) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM (SELECT o_custkey, o_orderkey, CAST(o_totalprice AS BIGINT) // 100000 AS d FROM orders)) GROUP BY 1
""")
def encoding_choice(table, spark):
    rows = table("orders").withColumn("d", F.floor(F.rint("o_totalprice").cast("long") / 100000))
    return encodings.choice(rows, "o_custkey", "o_orderkey", "d")


@query("""
SELECT 'duplicate_node' AS fault, p_size AS id FROM part GROUP BY p_size HAVING count(*) > 1
UNION ALL SELECT 'dangling_edge', id FROM (SELECT DISTINCT l_linenumber * 9 AS id FROM lineitem UNION SELECT DISTINCT CAST(l_quantity AS INT) FROM lineitem) ANTI JOIN (SELECT DISTINCT p_size FROM part) ON id = p_size
""")
def graph_validate(table, spark):
    edge = table("lineitem").select((F.col("l_linenumber") * 9).alias("a"), F.col("l_quantity").cast("int").alias("b"))
    return encodings.graph_faults(table("part").select(F.col("p_size").alias("id")), edge)


def _leads(table) -> DataFrame:
    """Each supplier leads to another, so cycles and tails grow with the table."""
    n = table("supplier").agg(F.max("s_suppkey").alias("n"))  # one row
    s = F.col("s_suppkey")
    return table("supplier").join(F.broadcast(n)).select(s.alias("a"), ((s * s + 1) % F.col("n") + 1).alias("b"))


LEADS = "(SELECT s_suppkey AS a, (s_suppkey * s_suppkey + 1) % (SELECT max(s_suppkey) FROM supplier) + 1 AS b FROM supplier)"
#: Each node's path along LEADS, which has one way on from each.
WALK = f"""e AS (SELECT * FROM {LEADS} WHERE a <> b), r AS (SELECT a, b, [a] AS path FROM e UNION ALL SELECT r.a, e.b, list_append(r.path, e.a) FROM r JOIN e ON r.b = e.a WHERE NOT list_contains(r.path, r.b))"""


@query(f"WITH RECURSIVE {WALK} SELECT DISTINCT a AS node FROM r WHERE b = a")
def cycles(table, spark):
    return graphs.on_cycle(_leads(table))


@query(f"""
WITH RECURSIVE {WALK}, c AS (SELECT list_sort(path) AS members, path FROM r WHERE b = a),
f AS (SELECT r.path, r.b, min(r.a) OVER (PARTITION BY list_sort(list_slice(r.path, list_position(r.path, r.b), len(r.path)))) AS first, r.a FROM r WHERE list_contains(r.path, r.b))
SELECT list_aggregate(list_append(list_slice(path, list_position(path, b), len(path)), b), 'string_agg', ' -> ') AS path FROM f WHERE a = first
""")
def cycle_text(table, spark):
    """The cycles that a walk in order of suppliers closes: each is entered where the least supplier that leads to it enters it."""
    order = table("supplier").select(F.col("s_suppkey").alias("node"), F.col("s_suppkey").alias("ord"))
    return graphs.cycle_paths(_leads(table).withColumn("pos", F.lit(0)), order)


@query("""
WITH RECURSIVE c AS (SELECT s_suppkey AS node, s_suppkey AS up, CAST(0 AS BIGINT) AS levels FROM supplier UNION ALL SELECT node, up // 2, levels + 1 FROM c WHERE up > 1)
SELECT node, up AS top, levels FROM c WHERE up <= 1
""")
def chain_depth(table, spark):
    parents = table("supplier").select(F.col("s_suppkey").alias("node"), F.when(F.col("s_suppkey") > 1, F.floor(F.col("s_suppkey") / 2)).alias("parent"))
    return graphs.chain_levels(parents)


CHAIN = """WITH RECURSIVE p AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 64 = 5 AND 2 * c_custkey <= n THEN 2 * c_custkey WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent FROM customer, (SELECT max(c_custkey) AS n FROM customer)),
starts AS (SELECT o_orderpriority || ' ' || o_orderstatus AS label, min(o_custkey) AS node FROM orders GROUP BY 1 UNION ALL SELECT 'region ' || n_regionkey, min(c_custkey) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT 'nation ' || c_nationkey, max(c_custkey) FROM customer GROUP BY 1),
w AS (SELECT node, CAST(0 AS BIGINT) AS depth FROM starts UNION SELECT parent, depth + 1 FROM w JOIN p USING (node) WHERE parent IS NOT NULL AND depth < 80),
levels AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1),
named AS (SELECT node, depth, coalesce(labels, '') AS labels, coalesce(n, 0) > 1 AS shared, false AS terminal FROM levels LEFT JOIN (SELECT node, string_agg(label, ',' ORDER BY label) AS labels, count(*) AS n FROM starts GROUP BY 1) USING (node)
  UNION ALL SELECT NULL, max(depth) + 1, '', false, true FROM levels HAVING count(*) FILTER (WHERE node IN (SELECT node FROM p WHERE parent IS NULL)) > 0)"""


def _chain(table) -> DataFrame:
    """Customers in chains of halves, some of which turn back; starts by order priority, region and nation, many of them shared."""
    key, n = F.col("c_custkey"), table("customer").agg(F.max("c_custkey").alias("n"))  # one row
    parents = table("customer").join(F.broadcast(n)).select(key.alias("node"), F.when((key % 64 == 5) & (2 * key <= F.col("n")), 2 * key).when(key > 1, F.floor(key / 2)).alias("parent"))
    by = lambda rows, label, node: rows.groupBy(label.alias("label")).agg(node.alias("node"))
    orders = by(table("orders"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus"), F.min("o_custkey"))
    customers = table("customer").join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    starts = orders.union(by(customers, F.concat(F.lit("region "), F.col("n_regionkey").cast("string")), F.min("c_custkey"))).union(by(table("customer"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")), F.max("c_custkey")))
    return graphs.chain_search(starts.withColumn("ord", F.col("label")), parents)


@query(f"{CHAIN} SELECT * FROM named")
def loader_chain(table, spark):
    return _chain(table).withColumn("labels", F.array_join("labels", ","))


@query(f"{CHAIN} SELECT (SELECT count(*) FROM starts) AS starting_points, (SELECT count(DISTINCT node) FROM starts) AS distinct_starts, (SELECT count(*) FROM starts WHERE node IN (SELECT node FROM starts GROUP BY 1 HAVING count(*) > 1)) AS shared_starts")
def loader_chain_summary(table, spark):
    return graphs.chain_summary(_chain(table))


@query("""
WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
r AS (SELECT source, doc_id, k, CAST(0 AS BIGINT) AS part, n_chars AS held FROM d WHERE k = 1
  UNION ALL SELECT d.source, d.doc_id, d.k, r.part + (CASE WHEN r.held >= 20000 THEN 1 ELSE 0 END), CASE WHEN r.held >= 20000 THEN d.n_chars ELSE r.held + d.n_chars END FROM r JOIN d ON d.source = r.source AND d.k = r.k + 1)
SELECT source, doc_id, part FROM r
""")
def roll_over(table, spark):
    return graphs.roll_over(table("documents"), "source", "doc_id", "n_chars", 20000).select("source", "doc_id", "part")


# findings and pending work


def _findings(table) -> DataFrame:
    dup = checks.duplicates(table("part").select(F.col("p_name").alias("id")))
    conflict = checks.owners(_claims(table)).filter("n > 1")
    orphan = checks.orphans(table("documents"), table("labels"), "doc_id")
    return checks.union(
        checks.finding(dup, "duplicate_mod_id", "ERROR", F.col("id"), F.lit("is declared more than once"), count=F.col("n")),
        checks.finding(conflict, "namespace_conflict", "ERROR", F.lpad(F.col("namespace").cast("string"), 3, "0"), F.lit("has several owners"), owners=F.col("n")),
        checks.finding(orphan, "orphan_namespace", "INFO", F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit("is claimed by no mod")),
    )


FINDINGS = """(SELECT 'duplicate_mod_id' AS kind, 'ERROR' AS severity, p_name AS subject FROM part GROUP BY p_name HAVING count(*) > 1
UNION ALL SELECT 'namespace_conflict', 'ERROR', lpad(CAST(s_nationkey AS VARCHAR), 3, '0') FROM supplier GROUP BY s_nationkey HAVING count(DISTINCT s_suppkey) > 1
UNION ALL SELECT 'orphan_namespace', 'INFO', lpad(CAST(doc_id AS VARCHAR), 12, '0') FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"""


@query(f"SELECT * FROM {FINDINGS} ORDER BY CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END, kind, subject LIMIT 20")
def findings_order(table, spark):
    return checks.ordered(_findings(table)).limit(20).select("kind", "severity", "subject")


@query(f"SELECT severity, count(*) AS n FROM {FINDINGS} GROUP BY 1")
def findings_summary(table, spark):
    return checks.summary(_findings(table))


@query("SELECT p_partkey, size FROM part, (VALUES (16), (32), (64)) s(size) ANTI JOIN (SELECT DISTINCT l_partkey, 32 AS done FROM lineitem WHERE l_linenumber = 1) d ON p_partkey = l_partkey AND size = done ORDER BY 1, 2 LIMIT 500")
def pending_icons(table, spark):
    """The next 500 of the parts' sizes that are not done: the budget of a batch is the feature."""
    done = table("lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey"), F.lit(32).alias("size")).distinct()
    return scans.pending(table("part").select("p_partkey"), [16, 32, 64], done, 500, "p_partkey")


@query("SELECT c_custkey, n_name AS name_en, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) END AS name_zh FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey")
def translate_lookup(table, spark):
    """Customers' names by the key of their nation; half of the nations have a name in one language only."""
    some = table("nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("key"), F.explode(F.array(F.struct(F.lit("en_us").alias("locale"), F.col("n_name").alias("text")), F.struct(F.lit("zh_cn").alias("locale"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).alias("text")))).alias("t")).select("key", "t.*")
    return scans.with_names(table("customer").select("c_custkey", F.col("c_nationkey").alias("translation_key")), some).select("c_custkey", "name_en", "name_zh")


@query("""
SELECT event_id, CASE WHEN event_id % 10 > 3 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k,
  CASE event_id % 10 WHEN 0 THEN 'it is no JSON object' WHEN 1 THEN 'k is no int: "a"' WHEN 2 THEN 'k is missing' WHEN 3 THEN 'it is no JSON object' END AS error
FROM events
""")
def typed_events(table, spark):
    """Events' properties as typed records or failures; of ten, one is torn, one a text, one lacks the field, one is a list."""
    own = F.col("event_id") % 10
    raw = F.when(own == 0, F.expr("substring(props, 1, length(props) - 1)")).when(own == 1, '{"k": "a"}').when(own == 2, '{"j": 1}').when(own == 3, "[1]").otherwise(F.col("props"))
    scan = records.typed(table("events").select("event_id", raw.alias("document")), "event", (records.Field("k", "$.k", "int", required=True),), "event_id")
    none = F.lit(None)
    return scan.records.select("event_id", "k", none.cast("string").alias("error")).unionByName(scan.failures.select(F.col("id").cast("long").alias("event_id"), none.cast("int").alias("k"), "error"))


@query("""
WITH d AS (SELECT *, p_partkey % 20 AS own, lower(replace(p_brand, '#', '_')) || ':' || p_partkey AS id FROM part)
SELECT 'item' AS kind, id, CASE own WHEN 0 THEN 'it is no JSON object' WHEN 1 THEN 'max_stack is no int: "many"' WHEN 2 THEN 'translation_key is missing' WHEN 3 THEN 'tags is no array<string>: [1]; block_item is no boolean: 0' WHEN 5 THEN 'max_stack is no int: 5000000000' END AS error,
  CAST(NULL AS INT) AS max_stack, NULL AS tags, NULL AS name_en FROM d WHERE own IN (0, 1, 2, 3, 5)
UNION ALL SELECT 'item', id, NULL, CASE WHEN own = 6 THEN 64 ELSE CAST(p_size AS INT) END, replace(p_name, ' ', ','), CASE WHEN p_type IN (SELECT p_type FROM part WHERE p_size > 25) THEN lower(p_type) END FROM d WHERE own > 5
""")
def typed_items(table, spark):
    """Parts as documents of items, some of them malformed: records with their names, and the failures."""
    own, size = F.col("p_partkey") % 20, F.col("p_size")
    good = F.to_json(F.struct(F.col("p_type").alias("descriptionId"), F.when(own != 6, size).alias("maxStackSize"), F.split("p_name", " ").alias("tags")))
    raw = F.when(own == 0, F.lit('{"descriptionId":')).when(own == 1, '{"descriptionId":"a","maxStackSize":"many"}').when(own == 2, "{}").when(own == 3, '{"descriptionId":"a","tags":[1],"blockItem":0}').when(own == 5, '{"descriptionId":"a","maxStackSize":5000000000}').when(own != 4, good)
    parts = table("part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a part is few bytes and much work: Spark deals work by bytes
    rows = parts.select(F.concat(F.lower(F.translate("p_brand", "#", "_")), F.lit(":"), F.col("p_partkey").cast("string")).alias("id"), raw.alias("document"))
    texts = table("part").filter("p_size > 25").select(F.col("p_type").alias("key"), F.lit("en_us").alias("locale"), F.lower("p_type").alias("text"))
    scan = records.registry_records(rows, "item", texts)
    good = scan.records.select(F.lit("item").alias("kind"), F.col("registry_name").alias("id"), F.lit(None).cast("string").alias("error"), "max_stack", F.array_join("tags", ",").alias("tags"), "name_en")
    none = F.lit(None)
    return good.unionByName(scan.failures.select("kind", "id", "error", none.cast("int").alias("max_stack"), none.cast("string").alias("tags"), none.cast("string").alias("name_en")))


@query("""
SELECT p_partkey AS key, coalesce(CASE WHEN p_size % 3 = 0 THEN p_name END, CASE WHEN p_size % 2 = 0 THEN p_type END, CASE WHEN p_size % 5 <> 0 THEN p_brand END, CAST(p_partkey AS VARCHAR)) AS text FROM part
""")
def locale_fallback(table, spark):
    """Parts' texts in de_AT: some have one of their own, some of the language, some only the fallback's, some none."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    texts = F.array(*[F.struct(F.lit(loc).alias("locale"), F.when(held, F.col(c)).alias("text")) for loc, held, c in (("en_us", size % 5 != 0, "p_brand"), ("de", size % 2 == 0, "p_type"), ("de_at", size % 3 == 0, "p_name"), ("fr", size > 0, "p_name"))])
    some = table("part").select(key.alias("key"), F.explode(texts).alias("t")).select("key", "t.*")
    wanted = table("part").select("p_partkey", key.alias("translation_key"))
    return scans.with_text(wanted, some, "de_AT").select(F.col("p_partkey").alias("key"), "text")


@query("""
WITH n AS (SELECT c_nationkey, CASE c_custkey % 4 WHEN 0 THEN chr(57344) WHEN 1 THEN chr(128512) WHEN 2 THEN chr(65533) ELSE '' END || c_name AS name, CASE c_custkey % 4 WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 3 END AS rank, c_name FROM customer)
SELECT c_nationkey, arg_min(name, (rank, c_name)) AS first_name, arg_max(name, (rank, c_name)) AS last_name FROM n GROUP BY 1
""")
def utf16_order(table, spark):
    """Each nation's first and last name by UTF-16 code units, where a character beyond U+FFFF precedes U+E000."""
    k = F.col("c_custkey") % 4
    name = F.concat(F.when(k == 0, "\ue000").when(k == 1, "\U0001f600").when(k == 2, "\ufffd").otherwise(""), F.col("c_name"))
    return table("customer").withColumn("name", name).groupBy("c_nationkey").agg(F.min_by("name", utf16(F.col("name"))).alias("first_name"), F.max_by("name", utf16(F.col("name"))).alias("last_name"))


@query("SELECT o_orderkey, CAST(length(t) + length(regexp_replace(t, '[^\u4e00-\u9fff\uff00-\uff60]', '', 'g')) + length(regexp_replace(t, '[^\\x{1F600}]', '', 'g')) AS BIGINT) AS width FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '\u77f3\uff01' WHEN 1 THEN chr(128512) ELSE '' END || o_orderpriority AS t FROM orders)")
def text_width(table, spark):
    """Columns that orders' priorities take, some behind full-width characters."""
    k = F.col("o_orderkey") % 3
    shown = F.concat(F.when(k == 0, "\u77f3\uff01").when(k == 1, "\U0001f600").otherwise(""), F.col("o_orderpriority"))
    return table("orders").select("o_orderkey", display_width(shown).cast("long").alias("width"))


@query("""
WITH w AS (SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'x:' || (l_partkey % 997) ELSE CAST(l_partkey % 1500 AS VARCHAR) END AS id FROM lineitem),
d AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'x:' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS id, p_name AS source FROM part)
SELECT w.id, coalesce(a.source, b.source) AS source FROM w LEFT JOIN d a ON a.id = w.id LEFT JOIN d b ON contains(w.id, ':') AND b.id = split_part(w.id, ':', 2)
""")
def definition_lookup(table, spark):
    """Ids asked for with and without a namespace, against definitions of both kinds."""
    part = F.col("l_partkey")
    wanted = table("lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("x:"), (part % 997).cast("string"))).otherwise((part % 1500).cast("string")).alias("id")).distinct()
    known = table("part").select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x:"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("source"))
    return scans.lookup(wanted, known)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def first_wins(table, spark):
    rows = table("orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("ord", F.col("o_orderkey"))
    return checks.first_by(rows, "o_custkey", "ord").select("o_orderkey", "o_custkey", "o_totalprice")


# the entry points


def _mod(key: Column) -> Column:
    return F.concat(F.lit("mod_"), F.lpad(key.cast("string"), 8, "0"))


def _catalogue(table) -> export.Catalogue:
    """Suppliers as mods that need, want and reject others by all their lines; of each one line is the one that it requires. Parts,
    customers and orders as records, suppliers' balances as containers, nations' and suppliers' keys as what mixins patch."""
    own = table("supplier").agg(F.max("s_suppkey").alias("n"))  # one row
    mod = _mod
    line = table("lineitem").join(F.broadcast(own)).select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % (F.col("n") + 2) + 1).alias("d"), F.when(F.col("l_linenumber") == 7, "INCOMPATIBLE").when(F.col("l_linenumber") % 2 == 0, "OPTIONAL").otherwise("EMBEDDED").alias("kind")).distinct()
    lot = F.struct((F.col("d") * 7919 + F.col("s") * 31) % 1009, "d")
    token = lambda bounds, kind: F.struct(mod(F.col("d")).alias("id"), bounds.cast("string").alias("range"), kind.alias("kind"))
    # one grouping for the lists and for the line that is required: the lines are made distinct once
    deps = line.groupBy("s").agg(F.collect_list(token(F.when(F.col("kind") == "OPTIONAL", "[1.3,1.7)"), F.col("kind"))).alias("listed"), F.min_by("d", lot).alias("d"))
    deps = deps.select("s", F.array_sort(F.concat("listed", F.array(token(F.lit(None), F.lit("REQUIRED"))))).alias("dependencies"))
    key, nation = F.col("s_suppkey"), F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string"))
    none = lambda t="string": F.lit(None).cast(t)
    mods = table("supplier").join(deps, F.col("s") == key, "left").select(mod(key).alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("1."), (key % 10).cast("string")).alias("version"), nation.alias("namespace"), F.when(key % 5 == 0, "forge").otherwise("fabric").alias("loader"), F.when(key % 7 == 0, "1.20").otherwise("1.21").alias("minecraft_version"), none().alias("license"), "dependencies", none("array<string>").alias("providers"), none().alias("source_file"), key.cast("int").alias("ord"))
    items = _parts(table).select(F.concat("id", F.lit("_"), "p_partkey").alias("registry_name"), "namespace", "tags")
    entities = table("customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("registry_name"), F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("namespace"))
    sounds = table("orders").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("key"), F.lower("o_orderpriority").alias("namespace"), F.array("o_orderstatus").alias("values"))
    text = lambda x: F.lit(x).cast("string")
    torn, empty = key % 17 == 0, F.create_map().cast("map<string,string>")
    containers = table("supplier").filter("s_suppkey % 11 <> 0").select(mod(key).alias("mod_id"), F.concat(mod(key), F.lit(".jar")).alias("file_name"), F.lit(False).alias("is_dir"), F.when(key % 13 == 0, F.lit(64 << 20) + key).otherwise(key * 1000).cast("long").alias("bytes"), F.when(~torn, F.lit(3)).alias("entries"), F.when(key % 12 == 0, F.array(F.lit("a.mixins.json"))).otherwise(F.array().cast("array<string>")).alias("mixin_paths"), F.when(key % 6 == 0, F.create_map(F.lit("MixinConfigs"), F.lit("a.mixins.json"))).otherwise(empty).alias("manifest"), F.when(torn, "torn").alias("read_error"))
    patched = F.struct(F.concat(F.lit("m.C"), (key % 10).cast("string")).alias("cls"), text("common").alias("env"), F.when(key % 3 == 0, F.concat(F.lit("net.T"), (key % 7).cast("string"))).alias("explicit_target"))
    mixins = table("supplier").select(F.concat(mod(key), F.lit(".mixins.json")).alias("source"), mod(key).alias("mod_id"), text("m").alias("package"), F.lit(True).alias("required"), none().alias("level"), none().alias("refmap"), F.array(patched).alias("entries"))
    return export.Catalogue(mods, {"item": items, "entity": entities, "sound": sounds}, containers, mixins, loader="quilt", game_version="1.21")


def _declared(table) -> DataFrame:
    """Rules of five kinds, one a nation in turn, on mods and targets by the nations' keys."""
    n, none = F.col("n_nationkey"), F.lit(None).cast("string")
    kinds = ("REQUIRE_MOD", "forbid-mod", "MUTUALLY_EXCLUSIVE", "require_together", "FORBID_MIXIN_TARGET")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (n % 5 + 1).cast("int"))
    return table("nation").select(F.lit("s").alias("strategy"), F.col("n_name").alias("datapack"), kind.alias("kind"), F.when(n % 2 == 0, "ERROR").alias("severity"), _mod(n * 7 + 1).alias("mod"), F.array(_mod(n + 1), _mod(n * 11 + 1)).alias("mods"), F.concat(F.lit("net.T"), n.cast("string")).alias("target"), none.alias("namespace"), F.lit(None).cast("long").alias("value"), none.alias("message"))


@query("""
WITH RECURSIVE n AS (SELECT max(s_suppkey) AS n FROM supplier),
m AS (SELECT s_suppkey AS k, 'mod_' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS id FROM supplier),
l0 AS (SELECT DISTINCT l_suppkey AS s, l_partkey % (n + 2) + 1 AS d, CASE WHEN l_linenumber = 7 THEN 'INCOMPATIBLE' WHEN l_linenumber % 2 = 0 THEN 'OPTIONAL' ELSE 'EMBEDDED' END AS kind FROM lineitem, n),
l AS (SELECT * FROM l0 UNION ALL SELECT s, arg_min(d, ((d * 7919 + s * 31) % 1009, d)), 'REQUIRED' FROM l0 GROUP BY s),
e AS (SELECT *, 'mod_' || lpad(CAST(s AS VARCHAR), 8, '0') AS src, 'mod_' || lpad(CAST(d AS VARCHAR), 8, '0') AS dst, d IN (SELECT s_suppkey FROM supplier) AS here FROM l WHERE s IN (SELECT s_suppkey FROM supplier)),
q AS (SELECT s AS a, d AS b FROM e WHERE kind = 'REQUIRED' AND here AND s <> d),
r AS (SELECT a, b, [a] AS path FROM q UNION ALL SELECT r.a, q.b, list_append(r.path, q.a) FROM r JOIN q ON r.b = q.a WHERE NOT list_contains(r.path, r.b)),
c AS (SELECT r.b AS entered, r.a, min(r.a) OVER (PARTITION BY list_sort(list_slice(r.path, list_position(r.path, r.b), len(r.path)))) AS first FROM r WHERE list_contains(r.path, r.b)),
x AS (SELECT k, id, 'net.T' || (k % 7) AS target FROM m WHERE k % 3 = 0),
u AS (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 2 = 0 THEN 'ERROR' ELSE 'WARN' END AS severity, n_nationkey * 7 + 1 AS one, [n_nationkey + 1, n_nationkey * 11 + 1] AS pair FROM nation),
h AS (SELECT n, any_value(severity) AS severity, string_agg(id, ',' ORDER BY place) AS here, count(*) AS present FROM (SELECT n, severity, unnest(pair) AS k, generate_subscripts(pair, 1) AS place FROM u) JOIN m USING (k) GROUP BY n)
SELECT kind, severity, subject, count(*) AS n FROM (
  SELECT 'missing_dependency' AS kind, 'ERROR' AS severity, src AS subject FROM e WHERE kind = 'REQUIRED' AND NOT here
  UNION ALL SELECT 'declared_incompatibility', 'ERROR', src FROM e WHERE kind = 'INCOMPATIBLE' AND here
  UNION ALL SELECT 'contradictory_declaration', 'ERROR', a.src FROM e a JOIN e b ON a.kind = 'INCOMPATIBLE' AND b.kind = 'REQUIRED' AND b.s = a.d AND b.d = a.s
  UNION ALL SELECT 'version_out_of_range', 'WARN', dst FROM e WHERE kind = 'OPTIONAL' AND here AND d % 10 NOT BETWEEN 3 AND 6
  UNION ALL SELECT 'requiring_cycle', 'WARN', 'mod_' || lpad(CAST(entered AS VARCHAR), 8, '0') FROM c WHERE a = first
  UNION ALL SELECT 'built_for_another_loader', 'WARN', id FROM m WHERE k % 5 = 0
  UNION ALL SELECT DISTINCT 'built_for_another_game_version', 'INFO', '1.20' FROM m WHERE k % 7 = 0
  UNION ALL SELECT 'namespace_conflict', 'ERROR', 'nation_' || s_nationkey FROM supplier GROUP BY s_nationkey HAVING count(*) > 1
  UNION ALL SELECT 'unreadable_container', 'WARN', id FROM m WHERE k % 11 <> 0 AND k % 17 = 0
  UNION ALL SELECT 'large_container', 'INFO', id FROM m WHERE k % 11 <> 0 AND k % 17 <> 0 AND k % 13 = 0
  UNION ALL SELECT 'dangling_mixin_declaration', 'WARN', id FROM m WHERE k % 11 <> 0 AND k % 17 <> 0 AND k % 6 = 0 AND k % 12 <> 0
  UNION ALL SELECT 'no_container', 'INFO', id FROM m WHERE k % 11 = 0
  UNION ALL SELECT 'shared_mixin_target', 'WARN', target FROM x GROUP BY target HAVING count(*) > 1
  UNION ALL SELECT DISTINCT 'mixin_targets_uncorrelated', 'INFO', '_global' FROM m WHERE k % 3 <> 0
  UNION ALL SELECT 'rule:require_mod', severity, 'mod_' || lpad(CAST(one AS VARCHAR), 8, '0') FROM u WHERE n % 5 = 0 AND one NOT IN (SELECT k FROM m)
  UNION ALL SELECT 'rule:forbid_mod', severity, 'mod_' || lpad(CAST(one AS VARCHAR), 8, '0') FROM u WHERE n % 5 = 1 AND one IN (SELECT k FROM m)
  UNION ALL SELECT 'rule:mutually_exclusive', severity, here FROM h WHERE n % 5 = 2 AND present > 1
  UNION ALL SELECT 'rule:require_together', severity, here FROM h WHERE n % 5 = 3 AND present < 2
  UNION ALL SELECT 'rule:forbid_mixin_target', severity, (SELECT string_agg(id, ',' ORDER BY id) FROM x WHERE target = 'net.T' || n) FROM u WHERE n % 5 = 4 AND 'net.T' || n IN (SELECT target FROM x))
GROUP BY 1, 2, 3
""")
def diagnose(table, spark):
    """All checks that need no collection, and declared rules, over suppliers as mods with all their lines."""
    catalogue = _catalogue(table)
    held = replace(catalogue, mods=graphs.cut_lineage(catalogue.mods))
    return export.diagnose(held, rules=_declared(table)).groupBy("kind", "severity", "subject").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT 'item' AS kind, lower(replace(p_brand, '#', '_')) AS ns, NOT list_contains(string_split(p_name, ' '), 'red') AS ok FROM part
  UNION ALL SELECT 'entity', 'nation_' || c_nationkey, true FROM customer UNION ALL SELECT 'mod', '_global', true FROM supplier)
SELECT format, plural AS kind, target, ns AS namespace, records FROM (
  SELECT kind || 's' AS plural, '' AS target, ns, count(*) AS records FROM r WHERE kind <> 'entity' AND ok AND ns <> 'brand_11' GROUP BY 1, 3
  UNION ALL SELECT 'entities', '', ns, count(*) FROM r WHERE kind = 'entity' AND ok GROUP BY 3
  UNION ALL SELECT 'items', 'x_ones', 'brand_13', count(*) FROM part WHERE p_brand = 'Brand#13' AND NOT list_contains(string_split(p_name, ' '), 'red') HAVING count(*) > 0),
  (VALUES ('ndjson'), ('yaml')) f(format)
""")
def export_counts(table, spark):
    """What an export would write, by shard: kinds routed, targets added, two formats."""
    settings = Settings(formats=("ndjson", "yaml"), kinds=("mod", "item", "entity"), analyze=False, excluded_namespaces=("brand_11",), excluded_tags=("red",))
    report = export.export(_catalogue(table), "unused", settings, targets={"x:ones": ("item", predicates.Selector(namespace="brand_13"))}, dry_run=True)
    return report.artifacts.select("format", "kind", "target", "namespace", "records")


@query("""
WITH p AS (SELECT p_brand || '=' || p_size AS ns, p_size % 10 AS own FROM part)
SELECT DISTINCT 'items/' || ns || '/' || ns || '-items.ndjson' AS path, CASE own WHEN 2 THEN 'NEW' WHEN 3 THEN 'REMOVED' WHEN 4 THEN 'CHANGED' ELSE 'UNCHANGED' END AS verdict FROM p
""")
def export_delta(table, spark):
    """A second export over a first: of ten sizes of parts one is new, one gone, one changed; the rest is not written again."""
    own = F.col("p_size") % 10
    mods = table("supplier").limit(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.MODS])
    items = table("part").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("registry_name"), F.concat_ws("=", "p_brand", F.col("p_size").cast("string")).alias("namespace"), F.col("p_partkey").cast("int").alias("max_stack"), own.alias("own"))
    folder = f"{graphs.shared_dir(spark)}/stratalog/export-{uuid.uuid4().hex}/data"
    run = lambda rows: export.export(export.Catalogue(mods, {"item": rows.drop("own")}), folder, Settings(formats=("ndjson",), kinds=("item",), analyze=False, delta=True))
    run(items.filter("own <> 2"))
    after = run(items.filter("own <> 3").withColumn("max_stack", F.when(F.col("own") == 4, -1).otherwise(F.col("max_stack"))))
    return after.artifacts.select("path", "verdict").unionByName(after.removed.withColumn("verdict", F.lit(delta.REMOVED)))


@query("""
SELECT 'sound' AS kind, 'o:' || o_orderkey AS key, lower(o_orderpriority) AS namespace, NULL AS name_en FROM orders WHERE false
UNION ALL SELECT 'biome', 'b:' || p_partkey, 'b', CASE WHEN p_size > 20 THEN p_type END FROM part
UNION ALL SELECT 'effect', 'e' || s_suppkey, 'minecraft', CASE WHEN s_suppkey % 2 = 0 THEN s_name END FROM supplier
""")
def registry_scan(table, spark):
    """Parts and suppliers as two registries whose entries are named by language keys."""
    no = F.lit(None).cast("string").alias("name_key")
    tables = {"worldgen/biome": table("part").select(F.concat(F.lit("b:"), "p_partkey").alias("key"), no), "mob_effect": table("supplier").select(F.concat(F.lit("e"), "s_suppkey").alias("key"), no)}
    texts = table("part").filter("p_size > 20").select(F.concat(F.lit("biome.b."), "p_partkey").alias("key"), F.lit("en_us").alias("locale"), F.col("p_type").alias("text"))
    texts = texts.union(table("supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("effect.minecraft.e"), "s_suppkey"), F.lit("en_us"), F.col("s_name")))
    return scans.registry_scan(tables, texts).select("kind", "key", "namespace", "name_en")


@query("SELECT event_id, '$.' || key AS path, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def tree_flatten(table, spark):
    return table("events").select("event_id", F.explode(scans.flatten_tree(F.col("props"))).alias("leaf")).select("event_id", "leaf.path", "leaf.value")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of routed records, and findings, in one long table."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    counted = routing.counts(_routed(table)).select(F.lit("count").alias("what"), "kind", F.col("namespace").alias("subject"), F.col("counted").alias("n"))
    found = _findings(table).groupBy("kind", "severity").agg(F.count("*").alias("n")).select(F.lit("finding").alias("what"), "kind", F.col("severity").alias("subject"), "n")
    return counted.unionByName(found)
