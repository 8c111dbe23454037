import json
import re

import pytest
from pyspark.sql import functions as F

from stratalog.operators import graphs
from stratalog.plans import sinks
from stratalog.sources import documents as d


def one(spark, f, *texts):
    return [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(f(F.col("t")).alias("x")).collect()]


def test_tags(spark):
    a, b, c, e, g = one(spark, d.tag, '{"values":["a:b"," #c:d ",{"id":"e:f","required":false},{"id":3},"",7]}', '{"replace":true,"values":"x:y"}', "[1]", '{"values":[', "{}")
    assert [tuple(x) for x in a.entries] == [("a:b", False, True), ("c:d", True, True), ("e:f", False, False)] and not a.replace
    assert b.replace and [x.id for x in b.entries] == ["x:y"] and c is None and e is None and g.entries == []


def test_language(spark):
    (a, b) = one(spark, d.language, '{"b":"2","a":1,"c":{"x":1},"d":[1],"":"no","e":null,"f":true}', "[]")
    assert [tuple(x) for x in a] == [("a", "1"), ("b", "2"), ("f", "true")] and b is None


def test_advancement(spark):
    doc = {"parent": "", "display": {"title": {"translate": "t.k", "text": "T"}, "description": {"translate": "d"}, "icon": {"item": "i"}, "frame": "goal", "hidden": True}, "criteria": {"z": {"trigger": "b"}, "a": {"trigger": "a"}, "m": {"trigger": "b"}, "n": {}}, "rewards": {"recipes": ["r", "s"], "experience": 5}}
    (a, b) = one(spark, d.advancement, json.dumps(doc), '{"criteria":{}}')
    assert (a.parent, a.title, a.description, a.icon, a.frame, a.hidden) == (None, "T", "d", "i", "goal", True)
    assert (a.triggers, a.criteria, a.reward_recipes, a.experience, a.has_display) == (["b", "a"], 4, 2, 5, True)
    assert not b.has_display and b.criteria == 0 and b.triggers == []


def test_worldgen(spark):
    f = lambda t: d.worldgen(F.lit("structure_set"), t)
    a, b, c = one(spark, f, '{"type":"t","feature":"f","structures":[{"structure":"s","weight":1},"u"],"elements":[1,2]}', "0.5", "[]")
    assert (a.type, a.references, [tuple(x) for x in a.counts], a.recognised) == ("t", ["f", "s", "u"], [("elements", 2)], True)
    assert b.constant == "0.5" and c is None


def test_loot(spark):
    doc = {"type": "minecraft:block", "pools": [{"conditions": [], "entries": [{"type": "minecraft:alternatives", "children": [{"type": "minecraft:item", "name": "b"}, {"type": "minecraft:tag", "name": "t"}]}, {"type": "minecraft:loot_table", "value": "other"}, {"type": "minecraft:loot_table", "value": {"pools": [{"entries": [{"type": "minecraft:item", "name": "a"}]}]}}, {"type": "minecraft:dynamic", "name": "no"}]}, 3]}
    a, b = one(spark, d.loot, json.dumps(doc), "nope")
    assert (a.type, a.items, a.tags, a.tables, a.pools, a.entries, a.conditional) == ("minecraft:block", ["b", "a"], ["#t"], ["other"], 2, 7, True)
    assert b is None or b.pools is None


def test_function(spark):
    text = '# note\r\nsay hi\n\n/bad\n$say $(x)\nexecute as @a \\\n  run function a:b/c\nfunction #tag:x\nschedule function a:b 1t\ntell function z:z\nfunction "a b:c"\n$function $(n):m\nsay \\'
    (a,) = one(spark, d.function, text)
    assert (a.commands, a.comments, a.macros, a.lines, a.unterminated) == (7, 1, 2, 13, True)
    assert (a.functions, a.tags, a.dynamic) == (["a:b/c", "a:b"], ["tag:x"], ["$(n):m"])


def test_descriptors_and_sweep(spark):
    files = spark.createDataFrame(
        [
            ("x", '{"id":"m","name":"M","version":"1","depends":{"a":">=1","":"no","l":["1","2"]},"breaks":{"b":"*"},"mixins":["m.json",3]}'),
            ("y", '{"quilt_loader":{"id":"q","version":"2","depends":[{"id":"c","versions":"[1,2)"},{"x":1},"e"],"provides":["p",{"id":"r"}],"metadata":{"name":"Q"}}}'),
            ("w", '{"id":"w","depends":["c","e"]}'),
            ("z", "no"),
            ("v", '{"name":"no id"}'),
        ],
        "path string, content string",
    )
    got = {r.id: r for r in d.descriptors(files).collect()}
    deps = {i: [tuple(x) for x in r.dependencies] for i, r in got.items()}
    assert deps == {"m": [("a", ">=1", "REQUIRED"), ("l", '["1","2"]', "REQUIRED"), ("b", "*", "INCOMPATIBLE")], "q": [("c", "[1,2)", "REQUIRED")], "w": [("c", None, "REQUIRED"), ("e", None, "REQUIRED")]}
    assert got["q"].providers == ["p", "r"] and got["q"].name == "Q" and got["m"].mixins == ["m.json"] and got["m"].providers == []
    rows = spark.createDataFrame([("a", None, "required", True), ("b", None, "DISCOURAGED", False), ("c", None, "incompatible", None)], "id string, range string, type string, mandatory boolean")
    kinds = lambda loader: [r.kind for r in d.loader_dependencies(rows, loader).collect()]
    assert kinds("neoforge") == ["REQUIRED", "OPTIONAL", "INCOMPATIBLE"] and kinds("forge") == ["REQUIRED", "OPTIONAL", "OPTIONAL"] and kinds("fabric") == ["REQUIRED", "UNKNOWN", "INCOMPATIBLE"]
    names = ("textures/a.png", "textures/.hidden/a", "other/x", "extra/y", "sounds.json", "a/b/c", ".x/y", "/lang/en.json", "textures//a", "textures/", "splash.txt", "other.txt", "Bad/x")
    paths = spark.createDataFrame([(p,) for p in names], "path string")
    assert sorted(r.path for r in d.sweep(paths, ("extra", "a/b", ".x", "Bad"), ("splash.txt",)).collect()) == ["/lang/en.json", "extra/y", "sounds.json", "splash.txt", "textures/a.png"]


def plain_fold(text):
    """(commands, comments, macros, lines, unterminated), line by line."""
    lines = text.replace("\r", "").split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    out, held = [0, 0, 0, len(lines), False], None
    for i, line in enumerate(lines):
        line = line.strip()
        joined = (held or "") + (line[:-1] if line.endswith("\\") else line)
        held = joined if line.endswith("\\") else None
        if held is not None and i < len(lines) - 1:
            continue
        out[4] |= held is not None
        joined = joined.strip()
        if joined and joined[0] != "/":
            out["#$".find(joined[0]) + 1 if joined[0] in "#$" else 0] += 1
    return tuple(out)


def test_fold_of_all_documents(spark):
    """Every document as it is, and again with lines that end in backslashes, comments and macros."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    marked = [re.sub("[.,] ", "\\\\\n# $", t) for t in docs] + [t.replace("e ", "\\ \r\n$") for t in docs]
    marked += [t.replace("\n", "\n$") for t in docs]
    rows = spark.createDataFrame([(t,) for t in docs + marked], "text string").select("text", d.function(F.col("text")).alias("f")).collect()
    assert all((r.f.commands, r.f.comments, r.f.macros, r.f.lines, r.f.unterminated) == plain_fold(r.text) for r in rows) and any(r.f.macros for r in rows)


def test_cycles(spark):
    edges = [("a", "b", 0), ("b", "c", 0), ("c", "a", 0), ("c", "d", 1), ("d", "e", 0), ("x", "y", 0), ("x", "z", 1), ("y", "w", 0), ("z", "w", 0), ("q", "q", 0), ("m", "n", 0), ("n", "m", 0)]
    order = [(n, i) for i, n in enumerate("mnabcdexyzwq")]
    e = spark.createDataFrame(edges, "a string, b string, pos int")
    paths = {r.path for r in graphs.cycle_paths(e, spark.createDataFrame(order, "node string, ord int")).collect()}
    assert paths == {"a -> b -> c -> a", "m -> n -> m"}
    assert {r.node for r in graphs.on_cycle(e).collect()} == set("abcmn")


def closure(edges, nodes):
    reach = {a: {y for x, y in edges if x == a and y != a} for a in nodes}
    while True:
        more = {a: near.union(*(reach[b] for b in near)) for a, near in reach.items()}
        if more == reach:
            return {a for a in reach if a in reach[a]}
        reach = more


@pytest.mark.parametrize("small", [100_000, 12, 0])
def test_cycle_nodes_against_closure(spark, monkeypatch, small):
    monkeypatch.setattr(graphs, "SMALL", small)
    import random

    rng = random.Random(5)
    cases = [[(rng.randrange(n), rng.randrange(n)) for _ in range(m)] for n, m in ((30, 33), (12, 30))]
    ring = lambda at, n: [(at + i, at + (i + 1) % n) for i in range(n)]
    # rings of their own, long ways between branching nodes, a tail into a ring and out of it, two rings with a bridge
    cases.append([*ring(100, 20), (0, 100), (110, 1), (1, 2), *ring(200, 5), *ring(300, 15), (204, 305), *ring(400, 9), (405, 450), (450, 451), (451, 452), (452, 402)])
    for edges in cases if small != 12 else cases[2:]:
        nodes = {x for e in edges for x in e}
        assert {r.node for r in graphs.on_cycle(spark.createDataFrame(edges, "a int, b int")).collect()} == closure(edges, nodes)


def test_a_long_ring_takes_few_rounds(spark, monkeypatch):
    """Above SMALL the rounds grow with the logarithm of a ring's length, below it there are none."""
    ring = lambda n: spark.range(n).selectExpr("id as a", f"(id + 1) % {n} as b")
    assert graphs.on_cycle(ring(10_000)).count() == 10_000
    n, cut = [0], graphs.cut_lineage

    def counted(df):
        n[0] += 1
        return cut(df)

    monkeypatch.setattr(graphs, "cut_lineage", counted)
    monkeypatch.setattr(graphs, "SMALL", 50)
    rounds = []
    for size in (60, 960):
        n[0] = 0
        assert graphs.on_cycle(ring(size)).count() == size
        rounds.append(n[0])
    assert rounds[1] - rounds[0] <= 4 * 6  # four more doublings in each of a few loops
    n[0] = 0
    assert sorted(r.part for r in graphs.components(ring(960)).select("part").distinct().collect()) == [0] and n[0] <= 26


def test_a_walk_enters_where_what_leads_there_enters(spark):
    e = spark.createDataFrame([("t", "c", 0), ("a", "b", 0), ("b", "c", 0), ("c", "a", 0), ("c", "z", 1)], "a string, b string, pos int")
    order = spark.createDataFrame([(n, i) for i, n in enumerate("tabcz")], "node string, ord int")
    for small in (100, 0):
        before, graphs.SMALL = graphs.SMALL, small
        try:
            assert [r.path for r in graphs.cycle_paths(e, order).collect()] == ["c -> a -> b -> c"]
            assert graphs.cycle_paths(e.filter("a <> 'c'"), order).count() == 0
        finally:
            graphs.SMALL = before


def test_chains(spark):
    parents = [(i, i // 2 if i > 1 else None) for i in range(1, 40)] + [(100, 101), (101, 100), (102, 100), (200, 999)]
    got = {r.node: (r.top, r.levels) for r in graphs.chain_levels(spark.createDataFrame(parents, "node long, parent long")).collect()}
    assert got == {**{i: (1, i.bit_length() - 1) for i in range(1, 40)}, 200: (999, 1)}


def test_roll_over(spark):
    rows = [("a", i, 40) for i in range(7)] + [("b", 0, 500), ("b", 1, 1)]
    got = sorted((r.s, r.o, r.part) for r in graphs.roll_over(spark.createDataFrame(rows, "s string, o int, n long"), "s", "o", "n", 100).collect())
    assert [p for *_, p in got] == [0, 0, 0, 1, 1, 1, 2, 0, 1]


def test_sinks(spark, tmp_path):
    items = spark.createDataFrame([("m:b", "m", 64, 0.5, ["t", 'q"'], None), ("m:a", "m", 1, 2.0, [], "x<y"), ("n:c", "n", 2, 1.0, None, "z")], "registry_name string, namespace string, max_stack int, hardness double, tags array<string>, name string")
    text = {}
    for form in sinks.FORMATS:
        sinks.write(items, "item", form, str(tmp_path / form))
        text[form] = {p.name: "\n".join(f.read_text().rstrip("\n") for f in sorted(p.glob("part-*"))) for p in (tmp_path / form).glob("namespace=*")}
        assert text[form].keys() == {"namespace=m", "namespace=n"}
    body = json.loads(text["json"]["namespace=m"])["items"]
    assert [x["registry_name"] for x in body] == ["m:a", "m:b"] and body[1]["tags"] == ["t", 'q"']
    assert [json.loads(x)["registry_name"] for x in text["ndjson"]["namespace=m"].splitlines()] == ["m:a", "m:b"]
    import tomllib
    import xml.etree.ElementTree as ET

    toml = tomllib.loads(text["toml"]["namespace=m"])["items"]
    assert toml[1]["tags"] == ["t", 'q"'] and toml[0]["name"] == "x<y" and toml[0]["hardness"] == 2
    root = ET.fromstring(text["xml"]["namespace=m"])
    assert [v.text for v in root[1].find("tags")] == ["t", 'q"'] and root[0].find("name").text == "x<y"
    assert "  - registry_name: \"m:a\"" in text["yaml"]["namespace=m"] and "    tags: []" in text["yaml"]["namespace=m"]


def test_sinks_keep_odd_text_and_equal_names(spark, tmp_path):
    """Control characters, and records that share a name or have none, give documents that parse."""
    import tomllib
    import xml.etree.ElementTree as ET

    odd = 'a\bb\u0001c\td\\e"f\ng\u007f<é'
    rows = [("m:a", "m", odd), ("m:a", "m", odd), ("m:a", "m", "z"), (None, "m", "y"), (None, "m", "y")]
    items = spark.createDataFrame(rows, "registry_name string, namespace string, name string")
    text = {}
    for form in ("json", "toml", "xml", "ndjson"):
        sinks.write(items, "item", form, str(tmp_path / form))
        text[form] = "\n".join(f.read_text().rstrip("\n") for f in sorted((tmp_path / form / "namespace=m").glob("part-*")))
    want = sorted([odd, odd, "z", "y", "y"])
    assert sorted(x["name"] for x in json.loads(text["json"])["items"]) == want == sorted(json.loads(x)["name"] for x in text["ndjson"].splitlines())
    assert sorted(x["name"] for x in tomllib.loads(text["toml"])["items"]) == want
    assert sorted(x.find("name").text for x in ET.fromstring(text["xml"])) == sorted(t.replace("\b", "\ufffd").replace("\u0001", "\ufffd") for t in want)


def test_an_advancement_is_parsed_once(spark):
    """However many fields of it are taken."""
    rows = spark.createDataFrame([('{"display":{"title":"t","frame":"f"}}',)], "content string").select(d.advancement(F.upper("content")).alias("a"))
    plan = rows.select("a.title", "a.icon", "a.frame", "a.triggers", "a.criteria")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_a_walk_sorts_once(monkeypatch):
    """Not once for each node: edges are put in order together, and each node's keep that order."""
    import pandas as pd

    n, calls, sort = 300, [], pd.DataFrame.sort_values
    monkeypatch.setattr(pd.DataFrame, "sort_values", lambda self, *a, **k: calls.append(1) or sort(self, *a, **k))
    rows = pd.DataFrame({"a": [*range(n), 0], "b": [*[(i + 1) % n for i in range(n)], 5], "pos": [*[1] * n, 0], "ord": [*range(n), 0]}).astype({"a": str, "b": str})
    found = graphs._walk(rows)["path"].tolist()
    assert len(calls) <= 2
    assert found == [" -> ".join(map(str, [0, *range(5, n), 0]))]
