import json

import pytest
from pyspark.sql import functions as F

from stratalog import schema
from stratalog.operators import checks, engine
from stratalog.operators.predicates import Selector
from stratalog.plans import definitions, export, sinks
from stratalog.plans.config import Settings, resolve


@pytest.fixture(scope="module")
def catalogue(spark):
    """Two mods that need each other, items of three namespaces (one nameless), an entity, a recipe, effects."""
    mods = spark.createDataFrame(
        [("alpha", "Alpha", "1.4", "alpha", "fabric", "1.21", "MIT", [("beta", "[2,3)", "REQUIRED"), ("ghost", None, "REQUIRED")], ["shared"], "alpha.jar", 0), ("beta", "Beta", "1.0", "beta", "fabric", "1.21", None, [("alpha", None, "REQUIRED")], ["shared"], "beta.jar", 1)],
        schema.MODS,
    )
    items = spark.createDataFrame(
        [("alpha:stone", "alpha", "k.stone", "石", "Stone", 64, 0, ["rock", "base"], ["blocks"], True), ("alpha:axe", "alpha", None, None, 'Ax"e', 1, 250, [], [], False), ("beta:gem", "beta", None, None, "Gem", 16, 0, ["rock"], [], False), ("zeta:lost", "zeta", None, None, None, 1, 0, None, None, False), ("", "alpha", None, None, None, 1, 0, None, None, False)],
        "registry_name string, namespace string, translation_key string, name_zh string, name_en string, max_stack int, max_durability int, tags array<string>, creative_tabs array<string>, block_item boolean",
    )
    entities = spark.createDataFrame([("beta:bat", "beta", "k.bat", None, "Bat", "ambient")], "registry_name string, namespace string, translation_key string, name_zh string, name_en string, category string")
    recipes = spark.createDataFrame(
        [("alpha:r", "smelting", "alpha", [("1", "tag", ["ores"], 1), ("2", "item", ["alpha:stone"], 1), ("3", "items", ["a:b", "c:d"], 1), ("4", "item", [], 1)], [("1", "beta:gem", 2, None)], 0.35, 200)],
        "id string, type string, namespace string, inputs array<struct<slot:string,kind:string,values:array<string>,count:int>>, outputs array<struct<slot:string,item:string,count:int,nbt:string>>, experience double, cook_time int",
    )
    effects = spark.createDataFrame([("alpha:glow", "alpha", None, ["rock"], [("colour", "7")])], "key string, namespace string, name string, values array<string>, extra array<struct<k:string,v:string>>")
    return export.Catalogue(mods, {"item": items, "entity": entities, "recipe": recipes, "effect": effects}, loader="fabric", loader_version="0.16", game_version="1.21")


def test_export_routes_counts_checks_and_writes(spark, catalogue, tmp_path):
    out = tmp_path / "out"
    settings = Settings(formats=("json", "xml"), kinds=("mod", "item", "entity", "recipe", "effect"), excluded_namespaces=("zeta",), excluded_mods=("beta",))
    report = export.export(catalogue, str(out), settings, targets={"p:rocks": ("item", Selector(tag="rock"))})
    counts = {(r.kind, r.namespace): (r.counted, r.filtered) for r in report.counts.collect()}
    assert counts == {("mod", "_global"): (1, 0), ("item", "alpha"): (2, 0), ("item", "beta"): (1, 0), ("item", "zeta"): (0, 1), ("entity", "beta"): (1, 0), ("recipe", "alpha"): (1, 0), ("effect", "alpha"): (1, 0)}
    assert [(r.kind, r.error) for r in report.failures.collect()] == [("item", "it has no name")]
    found = sorted((r.kind, r.subject) for r in report.findings.collect())
    assert found == [("collection_summary", "_global"), ("filter_discarded_elements", "_global"), ("missing_dependency", "alpha"), ("namespace_conflict", "shared"), ("requiring_cycle", "alpha"), ("version_out_of_range", "beta")]

    items = json.loads((out / "items/alpha/alpha-items.json").read_text())["items"]
    assert [x["registryName"] for x in items] == ["alpha:axe", "alpha:stone"] and items[0]["englishName"] == 'Ax"e' and items[1]["maxStackSize"] == 64 and items[1]["tags"] == ["rock", "base"]
    rocks = json.loads((out / "targets/p_rocks/items/beta/beta-items.json").read_text())["items"]
    assert [x["registryName"] for x in rocks] == ["beta:gem"]
    effect = json.loads((out / "effects/alpha/alpha-effects.json").read_text())["effects"]
    assert effect[0]["extra"] == {"colour": "7"} and effect[0]["values"] == ["rock"]
    conflicts = json.loads((tmp_path / "analysis/conflicts/_global/_global-conflicts.json").read_text())["conflicts"]
    assert {c["extra"]["findingKind"] for c in conflicts} == {k for k, _ in found}
    deps = json.loads((tmp_path / "analysis/dependencies/alpha/alpha-dependencies.json").read_text())["dependencies"]
    assert deps[0]["extra"]["dependsOn"] == "beta@[2,3), ghost" and deps[0]["extra"]["missingRequired"] == "1" and deps[0]["extra"]["requiredBy"] == "beta"
    totals = report.totals().first()
    assert totals.records == report.artifacts.agg(F.sum("records")).first()[0] > 10 and totals.bytes > 0
    dry = export.export(catalogue, str(tmp_path / "none"), settings, targets={"p:rocks": ("item", Selector(tag="rock"))}, dry_run=True)
    assert not (tmp_path / "none").exists() and tuple(dry.totals().first()) == tuple(totals)


def files(folder):
    """The export's own files, and when each was written."""
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*") if p.is_file() and not str(p.relative_to(folder)).startswith(".")}


def verdicts(report):
    return sorted((x.path, x.verdict) for x in report.artifacts.collect())


def removed(report):
    return sorted(x.path for x in report.removed.collect())


ODD = ["a=b", "a%b", "brand#1", "a%3Db", "q?x*[y]{z}^'\"", "sp ace", "ünï"]


def test_second_run_writes_nothing_and_removed_shards_go(spark, catalogue, tmp_path):
    out = tmp_path / "out"
    settings = Settings(formats=("ndjson",), kinds=("item",), analyze=False, delta=True)
    rows = lambda names: spark.createDataFrame([(f"{n}:x", n, 1) for n in names], "registry_name string, namespace string, max_stack int")
    run = lambda names, stack=1: export.export(export.Catalogue(catalogue.mods, {"item": rows(names).withColumn("max_stack", F.when(F.col("namespace") == "zeta", stack).otherwise(1))}), str(out), settings)
    path = lambda n: f"items/{n}/{n}-items.ndjson"
    every = ["alpha", "zeta", *ODD]
    assert verdicts(run(every)) == sorted((path(n), "NEW") for n in every)
    held = files(out)
    assert sorted(held) == sorted(map(path, every))
    again = run(every)
    assert verdicts(again) == sorted((path(n), "UNCHANGED") for n in every) and files(out) == held and removed(again) == []
    (out / path("alpha")).unlink()
    assert verdicts(run(every)) == sorted((path(n), "UNCHANGED") for n in every)  # what is lost is written again
    held = files(out)
    assert sorted(held) == sorted(map(path, every))
    changed = run(["alpha", "zeta"], 3)
    assert verdicts(changed) == [(path("alpha"), "UNCHANGED"), (path("zeta"), "CHANGED")] and removed(changed) == sorted(map(path, ODD))
    assert sorted(files(out)) == [path("alpha"), path("zeta")] and files(out)[path("alpha")] == held[path("alpha")]
    assert not list(out.glob(".run-*")) and len(list((out / ".manifests").iterdir())) == 1
    assert changed.failures.count() == 0
    back = run(["alpha", "zeta", "a=b"], 3)
    assert dict(verdicts(back))[path("a=b")] == "NEW"


@pytest.mark.parametrize("step", ["publish", "remove", "write_manifest", "replace"])
def test_a_run_that_breaks_off_leaves_the_old_manifest(spark, catalogue, tmp_path, monkeypatch, step):
    from stratalog.plans import commit

    out = tmp_path / "out"
    settings = Settings(formats=("ndjson",), kinds=("item",), analyze=False, delta=True)
    items = catalogue.kinds["item"].filter("registry_name <> ''")
    run = lambda rows: export.export(export.Catalogue(catalogue.mods, {"item": rows}), str(out), settings)
    run(items)
    later = items.filter("namespace <> 'zeta'").withColumn("max_stack", F.lit(7))
    name = (out / ".manifest").read_text()

    def breaks(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(*((commit.Folder, "replace") if step == "replace" else (commit, step)), breaks)
        with pytest.raises(KeyboardInterrupt):
            run(later)
    assert (out / ".manifest").read_text() == name and not list(out.glob(".run-*"))
    told = {x.path: x.fingerprint for x in commit.previous(commit.Folder(spark, str(out)))[0].collect()}
    assert sorted(told) == [f"items/{n}/{n}-items.ndjson" for n in ("alpha", "beta", "zeta")]
    after = run(later)
    assert verdicts(after) == [(f"items/{n}/{n}-items.ndjson", "CHANGED") for n in ("alpha", "beta")]
    assert sorted(files(out)) == [f"items/{n}/{n}-items.ndjson" for n in ("alpha", "beta")]
    assert {json.loads(x)["maxStackSize"] for n in ("alpha", "beta") for x in (out / f"items/{n}/{n}-items.ndjson").read_text().splitlines()} == {7}


def test_a_file_that_cannot_be_replaced_keeps_its_entry(spark, catalogue, tmp_path):
    out = tmp_path / "out"
    settings = Settings(formats=("ndjson",), kinds=("item",), analyze=False, delta=True)
    items = spark.createDataFrame([("a:x", "alpha", 1), ("b:x", "beta", 1)], "registry_name string, namespace string, max_stack int")
    run = lambda rows: export.export(export.Catalogue(catalogue.mods, {"item": rows}), str(out), settings)
    run(items)
    (out / "items/alpha/alpha-items.ndjson").unlink()
    (out / "items/alpha/alpha-items.ndjson/in the way").mkdir(parents=True)
    report = run(items.withColumn("max_stack", F.lit(2)))
    assert [(r.kind, r.id) for r in report.failures.collect()] == [("artifact", "items/alpha/alpha-items.ndjson")]
    assert json.loads((out / "items/beta/beta-items.ndjson").read_text())["maxStackSize"] == 2
    (out / "items/alpha/alpha-items.ndjson/in the way").rmdir()
    (out / "items/alpha/alpha-items.ndjson").rmdir()
    assert verdicts(run(items.withColumn("max_stack", F.lit(2)))) == [("items/alpha/alpha-items.ndjson", "CHANGED"), ("items/beta/beta-items.ndjson", "UNCHANGED")]
    assert json.loads((out / "items/alpha/alpha-items.ndjson").read_text())["maxStackSize"] == 2


def test_a_plain_run_forgets_nothing(spark, catalogue, tmp_path):
    """What a run without a delta leaves behind is still known to a later one with a delta."""
    out = tmp_path / "out"
    items = catalogue.kinds["item"].filter("registry_name <> ''")
    run = lambda rows, delta: export.export(export.Catalogue(catalogue.mods, {"item": rows}), str(out), Settings(formats=("ndjson",), kinds=("item",), analyze=False, delta=delta))
    run(items, False)
    few = items.filter("namespace = 'alpha'")
    assert removed(run(few, False)) == [] and len(files(out)) == 3
    assert removed(run(few, True)) == [f"items/{n}/{n}-items.ndjson" for n in ("beta", "zeta")] and len(files(out)) == 1


def test_a_damaged_manifest_is_told(spark, catalogue, tmp_path):
    out = tmp_path / "out"
    settings = Settings(formats=("ndjson",), kinds=("item",), analyze=False, delta=True)
    one = export.Catalogue(catalogue.mods, {"item": catalogue.kinds["item"].filter("namespace = 'zeta'")})
    export.export(one, str(out), settings)
    table = next((out / ".manifests").iterdir())
    part = next(p for p in sorted(table.glob("part-*")) if "zeta" in p.read_text())
    part.write_text(part.read_text() + "no entry\nzz\tsome/path\n// a remark\n")
    for crc in table.glob(".*.crc"):
        crc.unlink()
    report = export.export(one, str(out), settings)
    assert sorted(r.error.rsplit("'", 1)[1] for r in report.failures.collect()) == [" has a fingerprint that is not one, and was skipped", " is not an entry, and was skipped"]
    assert verdicts(report) == [("items/zeta/zeta-items.ndjson", "UNCHANGED")]


def test_layout_templates_and_targets(spark, catalogue, tmp_path):
    kinds = ("item", "entity", "recipe", "block")
    some = export.Catalogue(catalogue.mods, {**catalogue.kinds, "block": catalogue.kinds["item"].filter("namespace = 'alpha' and registry_name <> ''")})
    run = lambda folder, **more: sorted(x.path for x in export.export(some, str(tmp_path / folder), Settings(kinds=kinds, analyze=False, excluded_namespaces=("zeta",), **more), targets={"p:rocks/x": ("item", Selector(tag="rock"))}).artifacts.collect() if "targets" in x.path or "zeta" not in x.path)
    new = run("v2", formats=("wiki",), package_per_kind=False, shard_by_namespace=False)
    assert new == [*(f"Json/{n}/{n}-{k}.json" for n, k in [("alpha", "items"), ("alpha", "recipes"), ("beta", "entities"), ("beta", "items")]), *(f"targets/p_rocks_x/Json/{n}/{n}-items.json" for n in ("alpha", "beta"))]
    old = run("v1", formats=("wiki_v1",), package_per_kind=False, shard_by_namespace=False)
    assert old == ["alpha.json", "beta.json", "beta_entity.json", "dump_recipes_alpha.json", "targets/p_rocks_x/alpha.json", "targets/p_rocks_x/beta.json"]
    deep = run("deep", formats=("wiki", "td"), package_per_kind=True, shard_by_namespace=False, wiki_blocks=True)
    assert {"items/Json/alpha/alpha-items.json", "blocks/Json/alpha/alpha-blocks.json", "items/alpha-items.td", "targets/p_rocks_x/items/beta-items.td"} <= set(deep)
    assert run("flat", formats=("xml",), package_per_kind=False) == ["alpha/alpha-blocks.xml", "alpha/alpha-items.xml", "alpha/alpha-recipes.xml", "beta/beta-entities.xml", "beta/beta-items.xml", "targets/p_rocks_x/alpha/alpha-items.xml", "targets/p_rocks_x/beta/beta-items.xml"]
    assert sorted(files(tmp_path / "v1")) == old and json.loads((tmp_path / "v2/Json/beta/beta-items.json").read_text().splitlines()[0])["registerName"] == "beta:gem"


def test_names_that_lead_out_of_the_folder_stay_in(spark, catalogue, tmp_path):
    items = spark.createDataFrame([("x", "..", 1), ("y", "../../up", 1)], "registry_name string, namespace string, max_stack int")
    assets = spark.createDataFrame([("a", "../../../x.png", str(tmp_path / "x.png"))], "namespace string, path string, source string")
    (tmp_path / "x.png").write_bytes(b"x")
    report = export.export(export.Catalogue(catalogue.mods, {"item": items}, assets=assets), str(tmp_path / "a/b/out"), Settings(formats=("ndjson",), kinds=("item",), analyze=False, delta=True))
    assert sorted(files(tmp_path / "a/b/out")) == ["items/.._.._up/.._.._up-items.ndjson", "items/_/_-items.ndjson"]
    assert [r.kind for r in report.failures.collect()] == ["asset"] and sorted(p.name for p in (tmp_path / "a").iterdir()) == ["b"]


def test_parts_roll_over(spark, catalogue, tmp_path):
    settings = Settings(formats=("ndjson",), kinds=("item",), analyze=False, part_bytes=10)
    report = export.export(catalogue, str(tmp_path / "out"), settings)
    assert sorted((r.namespace, r.part) for r in report.artifacts.collect()) == [("alpha", "0"), ("alpha", "1"), ("beta", "0"), ("zeta", "0")]
    assert sorted(files(tmp_path / "out")) == ["items/alpha/alpha-items-p2.ndjson", "items/alpha/alpha-items.ndjson", "items/beta/beta-items.ndjson", "items/zeta/zeta-items.ndjson"]


def test_a_large_shard_is_written_in_pieces_and_put_together(spark, catalogue, tmp_path):
    """The result does not depend on how many tasks write: same bytes, same fingerprint."""
    items = spark.range(3000).selectExpr("concat('m:', lpad(id, 5, '0')) as registry_name", "'m' as namespace", "cast(id % 64 as int) as max_stack")
    settings = Settings(formats=("json",), kinds=("item",), analyze=False, delta=True)
    one = export.Catalogue(catalogue.mods, {"item": items})
    export.export(one, str(tmp_path / "out"), settings)
    names = [x["registryName"] for x in json.loads((tmp_path / "out/items/m/m-items.json").read_text())["items"]]
    assert names == [f"m:{i:05d}" for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert verdicts(export.export(one, str(tmp_path / "out"), settings)) == [("items/m/m-items.json", "UNCHANGED")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_assets_take_part_in_the_delta(spark, catalogue, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.png").write_bytes(b"x" * 5000)
    (source / "b#1.json").write_bytes(b"{}")
    settings = Settings(formats=("ndjson",), kinds=("item",), analyze=False, delta=True)
    rows = [("alpha", "textures/a.png", "a.png"), ("be=ta", "lang/b#1%.json", "b#1.json"), ("beta", "lang/no.json", "no.json")]

    def run(rows):
        assets = spark.createDataFrame([(n, p, str(source / f)) for n, p, f in rows], "namespace string, path string, source string")
        return export.export(export.Catalogue(catalogue.mods, {"item": catalogue.kinds["item"].filter("namespace = 'zeta'")}, assets=assets), str(out), settings)

    report = run(rows)
    assert verdicts(report) == [("assets/alpha/textures/a.png", "NEW"), ("assets/be=ta/lang/b#1%.json", "NEW"), ("items/zeta/zeta-items.ndjson", "NEW")]
    assert [(r.kind, r.id) for r in report.failures.collect()] == [("asset", "assets/beta/lang/no.json")]
    assert (out / "assets/alpha/textures/a.png").read_bytes() == b"x" * 5000 and not list(out.rglob("*.part"))
    held = files(out)
    assert {v for _, v in verdicts(run(rows))} == {"UNCHANGED"} and files(out) == held  # nothing is copied again
    (source / "a.png").write_bytes(b"y" * 10)
    later = run([rows[0]])
    assert verdicts(later) == [("assets/alpha/textures/a.png", "CHANGED"), ("items/zeta/zeta-items.ndjson", "UNCHANGED")] and removed(later) == ["assets/be=ta/lang/b#1%.json"]
    assert sorted(files(out)) == ["assets/alpha/textures/a.png", "items/zeta/zeta-items.ndjson"] and (out / "assets/alpha/textures/a.png").read_bytes() == b"y" * 10
    assert later.artifacts.filter("kind = 'asset'").first().bytes == 10


def test_diagnose_and_report(spark, catalogue):
    found = export.diagnose(catalogue)
    kinds = [r.kind for r in found.collect()]
    assert kinds == ["missing_dependency", "namespace_conflict", "requiring_cycle", "version_out_of_range"]
    assert [r.kind for r in export.diagnose(catalogue, ["compatibility", "no such check"]).collect()] == ["requiring_cycle", "version_out_of_range"]
    lines = "\n".join(r.line for r in export.report(catalogue, found).orderBy("n").collect()).split("\n")
    assert lines[0] == "loader:     fabric 0.16" and "findings:   4" in lines and "errors:     2" in lines
    assert "error  missing_dependency  alpha" in lines and "    target = ghost" in lines
    assert sum(line.count("\t") == 3 for line in lines) == 5


def test_a_check_that_breaks_takes_nothing_with_it(spark, catalogue):
    def planned(facts):
        return facts.mods.select("no_such_column"), None

    def run(facts):
        return checks.finding(facts.mods.filter(F.raise_error(F.lit("boom")).isNull()), "k", "INFO", F.col("id"), F.lit("m")), None

    def key(facts):
        raise KeyError("ghost")

    own = [engine.Check("first", engine.PRE, "", planned), engine.Check("zeroth", engine.PRE, "", key), engine.Check("second", engine.PRE, "", run), *engine.named(["namespace-claims"]), engine.Check("later", engine.POST, "", planned)]
    found = engine.run(export._facts(catalogue, None), own).findings.collect()
    assert sorted((r.kind, r.subject) for r in found) == [("analysis_failed", "first"), ("analysis_failed", "second"), ("analysis_failed", "zeroth"), ("namespace_conflict", "shared")]
    assert [c.name for c in engine.named()] == ["containers", "dependency-graph", "compatibility", "mixins", "namespace-claims", "orphan-namespaces", "coverage"] and all(c.about for c in engine.CHECKS.values())


def test_wiki_projections(spark, catalogue):
    def lines(kind, form):
        return [r.line for r in sinks.rendered(catalogue.kinds[kind].filter("namespace <> 'zeta' and namespace <> ''"), kind, form, order=export._name(catalogue.kinds[kind])).orderBy("namespace", "place", "_order").collect()]

    item = next(json.loads(x) for x in lines("item", "wiki") if "stone" in x)
    assert item == {"registerName": "alpha:stone", "type": "Item", "maxStackSize": "64", "maxDurability": "0", "TagList": ["rock", "base"], "name": "石", "englishName": "Stone", "CreativeTabName": "blocks"}
    old = next(json.loads(x) for x in lines("item", "wiki_v1") if "stone" in x)
    assert old == {"name": "石", "englishName": "Stone", "registerName": "alpha:stone", "CreativeTabName": "blocks", "type": "Block", "OredictList": "[rock, base]", "maxStacksSize": 64, "maxDurability": 0}
    assert json.loads(lines("entity", "wiki_v1")[0]) == {"name": "Bat", "englishName": "Bat", "registerName": "beta:bat", "mod": "beta", "type": "Entity"}
    recipe = json.loads("".join(lines("recipe", "wiki")))["recipes"][0]
    assert recipe["input"] == {"1": {"tag": "ores"}, "2": {"item": "alpha:stone"}, "3": {"items": ["a:b", "c:d"]}} and recipe["output"] == {"1": {"item": "beta:gem", "count": 2}} and recipe["cookTime"] == 200
    assert not sinks.supports("wiki", "effect") and sinks.supports("wiki", "block", True) and sinks.supports("json", "effect")


def pack(source, origin, **files):
    return [(source, origin, f"data/ns/definitions/{n.replace('__', '/', 1).replace('_td', '.td') if n.endswith('_td') else n.replace('__', '/', 1) + '.json'}", t) for n, t in files.items()]


def test_definitions(spark):
    rows = [
        *pack("a", "mod", flows__daily='{"id":"d","formats":["json"],"kinds":"item","targets":["rocks"]}', targets__rocks='{"category":"items","selector":{"tag":"rock"}}', targets__rocks_td="x", targets__bad='{"category":"nothing"}', analyses__s='{"rules":[{"kind":"require-mod","mod":"m","severity":"error"},{"rule":"MIN_COUNT","target":"item","value":3}]}', analyses__broken='{"rules":[{"kind":"MUTUALLY_EXCLUSIVE","mods":["one"]}]}', flows__torn="{"),
        *pack("b", "global", targets__rocks='{"category":"block","selector":{"prefix":" "}}'),
        *pack("c", "mod", targets__rocks='{"category":"entity"}'),
        ("d", "mod", "data/ns/other/x.json", "{}"),
        *pack("e", "mod", flows__old_td="flow"),
    ]
    found = definitions.load(spark.createDataFrame(rows, "source string, origin string, path string, text string"))
    problems = sorted((r.kind, r.subject) for r in found.problems.collect())
    assert problems == [("datapack_duplicate_syntax", "a"), ("datapack_flow_invalid", "ns"), ("datapack_override", "rocks"), ("datapack_read_failed", "e"), ("datapack_shadowed", "rocks"), ("datapack_strategy_invalid", "ns"), ("datapack_target_invalid", "ns")]
    assert definitions.selectors(found.targets) == {"ns:rocks": ("block", Selector())}
    assert sorted((r.strategy, r.kind, r.severity, r.mod, r.target, r.value) for r in found.rules.collect()) == [("s", "MIN_COUNT", "WARN", None, "item", 3), ("s", "REQUIRE_MOD", "ERROR", "m", None, None)]
    name, layer = definitions.flow_layer(found, "ns:d")
    settings, warnings, errors = resolve([(name, layer), ("run", {"formats": "xml"})])
    assert name == "flow ns:d" and settings.kinds == ("item",) and settings.formats == ("xml",) and settings.targets == ("rocks",) and not warnings and not errors
    assert definitions.flow_layer(found, "none") is None
    functions = spark.createDataFrame([("ns:flows/d", "a"), ("ns:flows/other", "a"), ("zz:flows/other", "b"), ("ns:plain", "a")], "id string, pack string")
    flows, collisions = definitions.function_flows(functions, found.flows)
    assert [tuple(r) for r in flows.collect()] == [("other", "ns:flows/other")] and sorted(r.kind for r in collisions.collect()) == ["datapack_flow_kind_collision", "datapack_shadowed"]
