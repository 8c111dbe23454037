import io
import json
import zipfile

from pyspark.sql import functions as F

from stratalog.sources import scans


def test_archives(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("META-INF/MANIFEST.MF", "A: b\r\nMixinConfigs: x.json, y.\r\n json\r\n\r\nMixinConfigs: no\r\n")
        z.writestr("q.mixins.json", "{}")
    (tmp_path / "a.jar").write_bytes(b.getvalue())
    (tmp_path / "b.jar").write_bytes(b"no zip")
    got = {r.file_name: r for r in scans.containers(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert (got["a.jar"].entries, got["a.jar"].mixin_paths, got["a.jar"].read_error) == (2, ["x.json", "y.json", "q.mixins.json"], None)
    assert got["a.jar"].manifest == {"MixinConfigs": "x.json, y.json"} and not got["a.jar"].is_dir
    assert got["b.jar"].entries is None and got["b.jar"].read_error and got["b.jar"].bytes == 6


def test_archives_by_range(spark, tmp_path):
    """A file of three gigabytes (sparse) of which the directory alone is read; damaged and missing ones are told."""
    names = ["huge.jar", "a b#1%20.jar", "torn.jar", "deep/er.jar"]
    (tmp_path / "deep").mkdir()
    for n in names:
        with (tmp_path / n).open("wb") as f:
            if n == "huge.jar":
                f.seek(3 << 30)
                f.write(b"\0")
            with zipfile.ZipFile(f, "a") as z:
                z.writestr("META-INF/MANIFEST.MF", f"Implementation-Title: {n}\r\n\r\n")
                z.writestr("x/q.mixins.json", "{}")
    torn = (tmp_path / "torn.jar").read_bytes()
    (tmp_path / "torn.jar").write_bytes(torn[:10] + b"\xff" * 30 + torn[40:])
    (tmp_path / "no.txt").write_bytes(b"x")
    found = scans.archives(spark, str(tmp_path))
    got = {r.file_name: r for r in found.collect()}
    assert sorted(got) == ["a b#1%20.jar", "er.jar", "huge.jar", "torn.jar"] and got["huge.jar"].bytes > 3 << 30
    assert all(r.entries == 2 and r.manifest["Implementation-Title"].endswith(n) and r.mixin_paths == ["x/q.mixins.json"] for n, r in got.items() if n != "torn.jar")
    assert [(r.kind, r.id.rsplit("/", 1)[1]) for r in scans.container_failures(found).collect()] == [("container", "torn.jar")] and got["torn.jar"].entries is None


def test_directories_are_containers(spark):
    files = spark.createDataFrame([("file:/m/one/a/x.mixins.json", 5), ("file:/m/one/b.class", 7), ("file:/m/two/c", 1), ("file:/m/loose.jar", 9)], "path string, length long")
    got = {r.file_name: (r.is_dir, r.bytes, r.entries, r.mixin_paths) for r in scans.directories(files, "file:/m").collect()}
    assert got == {"one": (True, 12, 2, ["a/x.mixins.json"]), "two": (True, 1, 1, [])}


def test_mixin_configs(spark):
    rows = [("a", "m", '{"package":"p","required":true,"refmap":"r","compatibilityLevel":"J17","mixins":["A",{"target":"T","mixins":["B","C"]}],"client":["D",3]}'), ("b", "m", '{"mixins":["A"]}'), ("c", None, "no"), ("d", None, "x" * (1 << 20) + "y")]
    good, failed = scans.mixin_configs(spark.createDataFrame(rows, "path string, mod_id string, content string"))
    (r,) = good.collect()
    assert (r.source, r.mod_id, r.package, r.required, r.level, r.refmap) == ("a", "m", "p", True, "J17", "r")
    assert [tuple(e) for e in r.entries] == [("p.A", "common", None), ("p.B", "common", "T"), ("p.C", "common", "T"), ("p.D", "client", None)]
    assert sorted((x.id, x.error) for x in failed.collect()) == [("b", "no package"), ("c", "no JSON object"), ("d", "too long")]


def test_recipe_records(spark):
    rows = [("r:b", 1, "smelting", 0, ["#ores"], "i", 1, 0.35, 200), ("r:a", 1, "shaped", 2, ["x", "", "y"], "j", 3, 0.1, 5), ("r:a", 2, "shaped", 1, ["z"], "k", 1, None, None), ("r:c", 1, "special", 0, ["q"], "l", None, None, None), ("r:d", 1, "special", 0, [], None, None, None, None)]
    got = scans.recipe_records(spark.createDataFrame(rows, "id string, ord int, type string, width int, ingredients array<string>, result string, count int, experience double, cook_time int")).collect()
    assert [(r.id, [(i.slot, i.kind, i["values"]) for i in r.inputs], [(o.item, o["count"]) for o in r.outputs], r.experience, r.cook_time) for r in got] == [("r:a", [("1", "item", ["x"]), ("4", "item", ["y"])], [("j", 3)], None, None), ("r:b", [("1", "tag", ["ores"])], [("i", 1)], 0.35, 200), ("r:c", [], [("l", 1)], None, None)]


def test_registries(spark):
    key = lambda *ks: spark.createDataFrame([(k, f"name.{k}") for k in ks], "key string, name_key string")
    t = spark.createDataFrame([("effect.a.x.y", "en_us", "X"), ("name.b:q", "zh_cn", "Q")], "key string, locale string, text string")
    tables = {"mob_effect": key("b:z", "a:x/y"), "attribute": key("b:q"), "damage_type": key("a:d"), "unknown": key("a:u")}
    got = [tuple(r) for r in scans.registry_scan(tables, t).collect()]
    assert got == [("attribute", "b", "b:q", "name.b:q", "Q", None), ("damage_type", "a", "a:d", None, None, None), ("effect", "a", "a:x/y", "effect.a.x.y", None, "X"), ("effect", "b", "b:z", "effect.b.z", None, None)]
    assert [r.key for r in scans.registry_scan(tables, t, ["b"], dynamic=False).collect()] == ["b:q", "b:z"]
    assert scans.registry_scan({}, t).count() == 0
    files = spark.createDataFrame([("p", "b", 2, "2"), ("p", "a", 1, "1"), ("q", "a", 1, "3")], "path string, pack string, priority int, content string")
    assert sorted((r.path, r.pos, r.content) for r in scans.versions_of(files).collect()) == [("p", 0, "1"), ("p", 1, "2"), ("q", 0, "3")]


def test_recipes(spark):
    rows = [("r", 1, "shaped", 2, ["a", "", "b", "c"]), ("r", 2, "shaped", 2, ["z"]), ("s", 0, "shapeless", 0, ["p", "q"])]
    got = sorted(tuple(r) for r in scans.recipe_inputs(spark.createDataFrame(rows, "id string, ord int, type string, width int, ingredients array<string>")).collect())
    assert got == [("r", 1, "a"), ("r", 4, "b"), ("r", 5, "c"), ("s", 1, "p"), ("s", 2, "q")]


def test_names_lookup_packs_pending(spark):
    t = spark.createDataFrame([("k", "en_us", "E"), ("k", "zh_cn", "Z"), ("j", "en_us", "J")], "key string, locale string, text string")
    r = spark.createDataFrame([("k",), ("j",), ("i",)], "translation_key string")
    assert {x.translation_key: (x.name_zh, x.name_en) for x in scans.with_names(r, t).collect()} == {"k": ("Z", "E"), "j": (None, "J"), "i": (None, None)}
    d = spark.createDataFrame([("a:x", "one"), ("b:y", "two"), ("y", "three")], "id string, source string")
    w = spark.createDataFrame([("a:x",), ("x",), ("z:y",), ("no",)], "id string")
    assert {x.id: x.source for x in scans.lookup(w, d).collect()} == {"a:x": "one", "x": None, "z:y": "three", "no": None}
    m = spark.createDataFrame([("paxi", 1), ("openloader", 0)], "id string, ord int")
    told = lambda packs, mods, policy: [r.kind for r in scans.global_pack_findings(packs, mods, policy, "packs").collect()]
    assert told(w, m, "AUTO") == ["global_pack_deferred", "global_pack_ignored"] and told(w.limit(0), m, "AUTO") == ["global_pack_deferred"] and told(w, m, "OFF") == ["global_pack_disabled"] and told(w, m, "ON") == ["global_pack_both_active"]
    assert told(w.limit(0), m.limit(0), "AUTO") == ["global_pack_empty"] and told(w, m.limit(0), "AUTO") == [] and scans.provider_of(m) == "openloader"
    files = spark.createDataFrame([("file:/g/packs/one/data/x", 3), ("file:/g/packs/one/y", 4), ("file:/g/packs/two.ZIP", 5), ("file:/g/packs/readme.txt", 1)], "path string, length long")
    assert sorted(tuple(r) for r in scans.discovered(files, "file:/g/packs").collect()) == [("one", True, 7), ("two.ZIP", False, 5)]
    assert [scans.global_packs(w, m, p).count() for p in ("AUTO", "ON", "OFF")] == [0, 4, 0] and scans.global_packs(w, m.limit(0)).count() == 4
    done = spark.createDataFrame([("no", 16)], "id string, size int")
    assert [tuple(x) for x in scans.pending(w, [16, 32], done, 3).collect()] == [("a:x", 16), ("a:x", 32), ("no", 32)]


def test_tree(spark):
    deep = "".join('{"k":' for _ in range(30)) + "1" + "}" * 30
    docs = ['{"a":[1,{"b":"x"}],"c":true,"n":null,"e":[],"o":{}}', deep, "no", "[2.5]"]
    df = spark.createDataFrame([(d,) for d in docs], "d string").select("d", scans.flatten_tree(F.col("d")).alias("t"), scans.tree_rows(F.col("d")).alias("r"))
    rows = {r.d: r for r in df.withColumn("again", scans.tree_document(F.col("r"))).collect()}
    assert [tuple(x) for x in rows[docs[0]].t] == [("$.a[0]", "1"), ("$.a[1].b", "x"), ("$.c", "true"), ("$.n", None)]
    assert rows[deep].t[0].path == "$" + ".k" * 30 and rows["no"].t is None and rows["no"].again is None
    assert [(x.key, x.value, x.children) for x in rows[docs[0]].r][:3] == [("", None, 5), ("a", None, 2), ("", "1", None)]
    assert all(json.loads(rows[d].again) == json.loads(d) for d in docs if d != "no")
