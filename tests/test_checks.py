import hashlib
from pyspark.sql import functions as F

from stratalog import schema
from stratalog.operators import checks, delta, merge, predicates, routing, rules
from stratalog.plans import config
from stratalog.streaming import incremental


def mods(spark, *rows):
    """(id, version, namespace, loader, game, dependencies, providers)"""
    full = [(i, i, v, ns, ld, mc, None, deps, prov, None, n) for n, (i, v, ns, ld, mc, deps, prov) in enumerate(rows)]
    return spark.createDataFrame(full, schema.MODS)


def found(df):
    return sorted((r.kind, r.subject) for r in df.collect())


def test_dependency_graph(spark):
    m = mods(
        spark,
        ("a", "1.0", None, "fabric", "1.21.1", [("b", "[1,2)", "REQUIRED"), ("gone", None, "REQUIRED"), ("c", None, "INCOMPATIBLE"), ("x", None, "OPTIONAL")], ["shared"]),
        ("b", "2.5", "b", "forge", "[1.20,1.21)", [("a", "oops,", "OPTIONAL")], ["shared"]),
        ("c", None, None, None, None, [("a", None, "REQUIRED"), ("a", None, "INCOMPATIBLE")], []),
        ("b", "9", None, "quilt", "1.20", None, None),
    )
    assert found(checks.dependency_graph(m)) == [("contradictory_declaration", "a"), ("declared_incompatibility", "a"), ("declared_incompatibility", "c"), ("duplicate_mod_id", "b"), ("missing_dependency", "a")]
    mutual = {(r.src, r.dst): r.mutual for r in checks.incompatible(checks.edges(m), m.select("id")).collect()}
    assert mutual == {("a", "c"): True, ("c", "a"): True}
    records = {(r.key, dict(r.extra).get("version")): (r["values"], dict(r.extra)) for r in checks.dependency_records(m).collect()}
    assert {k: v for k, (v, _) in records.items()} == {("dep:a", "1.0"): ["b@[1,2)", "gone"], ("dep:b", "2.5"): [], ("dep:c", None): ["a"], ("dep:b", "9"): []}
    own = records["dep:a", "1.0"][1]
    assert (own["missingRequired"], own["dependencyCount"], own["optionalOn"], own["declaresIncompatible"], own["requiredBy"], own["dependentsCount"]) == ("1", "4", "x", "c", "c", "1")
    got = found(checks.compatibility(m, "Quilt", "1.21.1"))
    assert got == [("built_for_another_game_version", "1.20"), ("built_for_another_game_version", "b"), ("built_for_another_loader", "b"), ("version_out_of_range", "b"), ("version_range_unreadable", "a")]
    assert found(checks.compatibility(m, None, None)) == [("version_out_of_range", "b"), ("version_range_unreadable", "a")]
    assert found(checks.namespace_claims(m)) == [("namespace_conflict", "shared")]
    spaces = {r.namespace: dict(r.extra) for r in checks.namespace_records(m).collect()}
    assert spaces["shared"] == {"owners": "a, b", "ownerCount": "2", "conflict": "true"} and spaces["c"]["conflict"] == "false"
    observed = spark.createDataFrame([("a",), ("lost",), ("_global",)], "namespace string")
    assert found(checks.orphan_namespaces(observed, m)) == [("orphan_namespace", "lost")]


def test_requirements_in_a_ring(spark):
    """A ring of four closes one cycle; optional, absent and own edges close none; two ways to one mod are no cycle."""
    need = lambda *ids: [(i, None, "REQUIRED") for i in ids]
    ring = mods(spark, *[(i, "1", None, None, None, need(j), []) for i, j in ("wx", "xy", "yz", "zw")], ("o", "1", None, None, None, [("w", None, "OPTIONAL"), *need("o", "none", "w")], []))
    (r,) = [x for x in checks.compatibility(ring, None, None).collect() if x.kind == "requiring_cycle"]
    assert r.subject == "w" and r.severity == "WARN" and {k: v for k, v in r.detail} == {"loop": "w -> x -> y -> z -> w", "length": "4"}
    both = mods(spark, ("a", "1", None, None, None, need("b", "c"), []), ("b", "1", None, None, None, need("d"), []), ("c", "1", None, None, None, need("d"), []), ("d", "1", None, None, None, [("a", None, "OPTIONAL")], []))
    assert found(checks.compatibility(both, None, None)) == []


def test_kinds_of_dependencies_and_ranges(spark):
    """Every kind but a rejection has its range judged; the finding is the present mod's."""
    deps = [("p", "[5,6]", k) for k in ("REQUIRED", "OPTIONAL", "EMBEDDED", "UNKNOWN", "INCOMPATIBLE")] + [("p", " ", "REQUIRED"), ("absent", "[1]", "REQUIRED")]
    m = mods(spark, ("q", "1", None, None, "[1.21,", deps, []), ("p", "7", None, "FABRIC", "1.21", [], []))
    rows = checks.compatibility(m, "fabric", "1.21").collect()
    assert [(r.kind, r.subject) for r in rows] == [("version_out_of_range", "p")] * 4
    assert sorted(dict(r.detail)["dependency_kind"] for r in rows) == ["embedded", "optional", "required", "unknown"] and {dict(r.detail)["required_by"] for r in rows} == {"q"}


def test_containers_and_mixins(spark):
    m = mods(spark, ("a", "1", "ns", None, None, [], []), ("b", "1", None, None, None, [], []))
    rows = [("a", "a.jar", False, 64 << 20, 3, ["x.json"], {"MixinConfigs": "x.json"}, None), ("c", "c.jar", False, 5, 1, [], {"MixinConfigs": " , "}, None), ("d", "d.jar", False, 5, 1, [], {}, None), ("q", "q.jar", False, 1, 0, [], {"MixinConfigs": ","}, "bad zip")]
    c = spark.createDataFrame(rows, schema.CONTAINERS)
    x = spark.createDataFrame([("x.json", "a", "p", True, "J", None, [("C1", "client", "T"), ("C2", "server", None)]), ("z.json", "b", "p", None, None, "r", [("C3", "both", "T")]), ("y.json", None, "p", None, None, None, [("C4", "common", "U"), ("C4", "client", "U")])], schema.MIXINS)
    got = found(checks.container_checks(c, m))
    assert got == [("dangling_mixin_declaration", "c"), ("large_container", "a"), ("no_container", "b"), ("unreadable_container", "q")]
    assert found(checks.container_checks(c.limit(0), m)) == []
    assert found(checks.mixin_checks(x)) == [("mixin_targets_uncorrelated", "_global"), ("shared_mixin_target", "T")]
    alone = x.filter("mod_id is null").union(x.filter("mod_id is null").withColumn("source", F.lit("w.json")))
    assert found(checks.mixin_checks(alone)) == [("shared_mixin_target", "U")]  # a configuration without mod counts under its source
    records = {r.key: (r.namespace, r["values"], dict(r.extra)["mixinClasses"]) for r in checks.mixin_records(x, m).collect()}
    assert records == {"mixin:x.json": ("ns", ["T", "C2"], "2"), "mixin:z.json": ("_global", ["T"], "1"), "mixin:y.json": ("_global", ["U"], "2")} or records["mixin:z.json"][0] is None
    facts = {r.mod_id: dict(r.facts) for r in checks.container_facts(c).collect()}
    assert facts["a"] == {"container": "a.jar", "containerKind": "jar", "containerBytes": str(64 << 20), "containerEntries": "3", "manifest.MixinConfigs": "x.json"}
    order = [(r.severity, r.kind) for r in checks.ordered(checks.container_checks(c, m)).collect()]
    assert order == sorted(order, key=lambda o: (schema.SEVERITIES[o[0]], o[1]))


def test_rules_and_shadowing(spark):
    m = mods(spark, ("a", "1", None, None, None, [], []), ("c", "1", None, None, None, [], []))
    rule = lambda name, kind, **k: (name, "ns", kind, k.get("severity"), k.get("mod"), k.get("mods"), k.get("target"), None, None, k.get("message"))
    r = spark.createDataFrame([rule("s", "require-mod", mod="zz", message="own words"), rule("t", "REQUIRE_TOGETHER", severity="ERROR", mods=["b", "c", "a"]), rule("u", "MUTUALLY_EXCLUSIVE", mods=["a", "b"]), rule("v", "FORBID_MIXIN_TARGET", target="T")], schema.RULES)
    entries = spark.createDataFrame([("T", "m2", True), ("T", "m1", True), ("T", "m0", False)], "target string, owner string, explicit boolean")
    got = sorted((x.kind, x.severity, x.subject, dict(x.detail)["strategy"]) for x in rules.apply_pre(r, m, entries).collect())
    assert got == [("rule:forbid_mixin_target", "WARN", "m1,m2", "v"), ("rule:require_mod", "WARN", "zz", "s"), ("rule:require_together", "ERROR", "c,a", "t")]
    rows = spark.createDataFrame([("f", 1, "p"), ("f", 1, "o"), ("f", 2, "q"), ("f", 2, "r"), ("g", 0, "p")], "id string, rank int, source string")
    assert sorted((x.source, x.winner, x.severity) for x in checks.shadowed(rows).collect()) == [("o", "q", "INFO"), ("p", "o", "WARN"), ("r", "q", "WARN")]


def test_coverage(spark):
    """Two kinds counted, one of them filtered too, a third only filtered."""
    counts = spark.createDataFrame([("item", "n2", 3, 1), ("item", "n1", 2, 0), ("sound", "n1", 1, 0), ("fluid", "n3", 0, 4)], "kind string, namespace string, counted long, filtered long")
    got = {r.kind: (r.total, r.filtered, r.namespaces, r.by_namespace) for r in routing.coverage(counts).collect()}
    assert got == {"item": (5, 1, 2, "n1=2, n2=3"), "sound": (1, 0, 1, "n1=1"), "fluid": (0, 4, 0, "")}
    records = {r.key: dict(r.extra) for r in checks.coverage_records(routing.coverage(counts)).collect()}
    assert records["coverage:item"] == {"counted": "5", "filtered": "1", "namespaces": "2", "source": "registry", "byNamespace": "n1=2, n2=3"} and "byNamespace" not in records["coverage:fluid"]
    totals = spark.createDataFrame([(6, 5, 2, 2)], "counted long, filtered long, namespaces long, kinds long")
    assert {r.kind: dict(r.detail) for r in checks.coverage_findings(totals).collect()} == {"filter_discarded_elements": {"discarded": "5", "kept": "6"}, "collection_summary": {"total": "6", "namespaces": "2", "categories": "2"}}


def test_routing(spark):
    rows = spark.createDataFrame([("item", "a", "a:x", ["t"]), ("item", "b", "b:y", None), ("item", None, "z", ["t"]), ("finding", "_global", "f", ["t", "u"]), ("mod", "a", "a", ["t"])], "kind string, namespace string, id string, tags array<string>")
    f = routing.Filters(namespaces=["a"], tags=["t"], excluded_tags=["u"], excluded_mods=["a"])
    routed = routing.route(rows, f)
    assert [r.accepted for r in routed.collect()] == [True, False, False, False, True]
    assert [r.id for r in routing.written(routed, f).collect()] == ["a:x"]
    s = predicates.Selector(prefix="x", tag="t", namespace=" ")
    assert s.specificity == 2 and s.describe() == "tag=t prefix=x"
    assert [r.hit for r in rows.select(s.matches(F.col("id"), F.col("namespace"), F.col("tags")).alias("hit")).collect()] == [True, False, False, False, False]


def test_stack_values(spark):
    v = spark.createDataFrame([("p", 0, False, ["a"]), ("p", 1, True, ["b", "c"]), ("p", 2, False, ["c", "d"]), ("q", 0, False, []), ("r", 0, True, [])], "path string, priority int, replace boolean, values array<string>")
    assert {r.path: r["values"] for r in merge.stack_values(v, "path", "priority", "replace", "values").collect()} == {"p": ["b", "c", "d"], "r": []}


def test_snapshot_and_second_run(spark):
    sha = "ab" * 32
    lines = spark.createDataFrame(list(enumerate(["snapshot 1", "// note", f"{sha}\tx", "bad\ty", f"{'cd' * 32}\tx", f"{sha}\tz"])), "n int, value string")
    snap = delta.read_snapshot(lines)
    assert {r.path: r.fingerprint[:2] for r in snap.collect()} == {"x": "cd", "z": "ab"}
    assert delta.read_snapshot(lines.filter("n > 0")).count() == 0
    new = spark.createDataFrame([("x", "ee" * 32), ("w", sha), ("v", sha)], "path string, fingerprint string")
    summary = delta.change_summary(delta.verdicts(snap, new)).first()
    assert (summary.new, summary.changed, summary.unchanged, summary.removed, summary.workload) == (2, 1, 0, 1, 4)
    judged = delta.verdicts(snap, snap)
    assert {r.verdict for r in judged.collect()} == {"UNCHANGED"} and delta.to_write(judged, snap).count() == 0
    assert [r.value[-1] for r in delta.manifest_lines(snap).collect()] == ["x", "z"]


def test_settings():
    assert config.kinds("items, tag") == ["item", "tag"] and config.kinds("item,what") is None and set(config.kinds("data analysis")) == set(config.GROUPS["all"])
    assert config.formats("xml json json") == ["json", "xml"] and config.analyses_wanted(["item"]) == schema.ANALYSIS_KINDS and config.analyses_wanted(["mixin"]) == ["mixin"]
    s, warnings, errors = config.resolve([("file", {"kinds": "item", "tags": ("a",), "odd": 1}), ("bad", {"kinds": "nope", "tags": ("z",)}), ("run", {"kinds": "block", "tags": ("b", "a"), "delta": True})])
    assert (s.kinds, s.tags, s.delta) == (("block",), ("a", "b"), True) and len(warnings) == len(errors) == 1


def test_streaming_delta(spark, tmp_path):
    """Each call starts the query anew from its checkpoint; state is kept by path, a batch tells of its own paths only."""
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema_ = "path string, content string, seq int"
    seen = []
    for batch in ([("a", "1", 0), ("b", "1", 1)], [("a", "2", 2), ("b", "1", 3), ("c", "1", 4), ("c", "2", 5)], [("a", "1", 1), ("c", "3", 6)], []):
        if batch:
            spark.createDataFrame(batch, schema_).coalesce(1).write.mode("append").json(src)
        incremental.judge_batches(spark.readStream.schema(schema_).json(src), out, cp).awaitTermination()
        rows = sorted((r.path, r.verdict, r.seq) for r in spark.read.parquet(f"{out}/verdicts").collect())
        seen.append(sorted(set(rows) - {x for s in seen for x in s}))
    assert seen == [[("a", "NEW", 0), ("b", "NEW", 1)], [("a", "CHANGED", 2), ("b", "UNCHANGED", 3), ("c", "NEW", 5)], [("c", "CHANGED", 6)], []]
    told = {r.path: r.fingerprint for r in incremental.snapshot(spark, cp).collect()}
    assert told == {p: hashlib.sha256(c.encode()).hexdigest() for p, c in (("a", "2"), ("b", "1"), ("c", "3"))}
