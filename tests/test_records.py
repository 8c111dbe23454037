import json

from pyspark.sql import functions as F

from stratalog.functions.names import display_width, locale_chain, utf16
from stratalog.operators import graphs
from stratalog.sources import records, scans


def test_one_malformed_record_ends_nothing(spark):
    rows = [
        ("m:stone", json.dumps({"descriptionId": "k.stone", "destroyTime": 1.5, "explosionResistance": 6, "lightEmission": 0, "hasItem": True, "soundType": "S"})),
        ("m:plain", json.dumps({"descriptionId": "k.plain"})),
        ("m:torn", '{"descriptionId"'),
        ("m:list", "[]"),
        ("m:text", json.dumps({"descriptionId": "k", "destroyTime": "hard", "lightEmission": 1.5})),
        ("m:wide", json.dumps({"descriptionId": "k", "lightEmission": 1 << 40})),
        ("m:none", json.dumps({"descriptionId": None})),
        ("m:gone", None),
        (" ", json.dumps({"descriptionId": "k"})),
    ]
    texts = spark.createDataFrame([("k.stone", "zh_cn", "石"), ("k.stone", "en_us", "Stone"), ("k.plain", "fr", "x")], "key string, locale string, text string")
    scan = records.registry_records(spark.createDataFrame(rows, "id string, document string"), "block", texts)
    got = {r.registry_name: (r.namespace, r.hardness, r.blast_resistance, r.light, r.has_block_item, r.material, r.name_zh, r.name_en) for r in scan.records.collect()}
    assert got == {"m:stone": ("m", 1.5, 6.0, 0, True, "S", "石", "Stone"), "m:plain": ("m", 0.0, 0.0, 0, False, None, None, None)}
    failed = {r.id: (r.kind, r.error) for r in scan.failures.collect()}
    assert failed == {
        "m:torn": ("block", "it is no JSON object"),
        "m:list": ("block", "it is no JSON object"),
        "m:text": ("block", 'hardness is no double: "hard"; light is no int: 1.5'),
        "m:wide": ("block", f"light is no int: {1 << 40}"),
        "m:none": ("block", "translation_key is missing"),
        " ": ("block", "it has no name"),
    }
    item = records.typed(spark.createDataFrame([("a:b", '{"descriptionId":"k","tags":["x","y"]}'), ("a:c", '{"descriptionId":"k","tags":["x",null]}')], "id string, document string"), "item")
    assert [(r.id, r.max_stack, r.max_durability, r.tags, r.block_item) for r in item.records.collect()] == [("a:b", 64, 0, ["x", "y"], False)]
    assert [r.id for r in item.failures.collect()] == ["a:c"]
    none = records.typed(spark.createDataFrame([], "id string, document string"), "entity")
    assert none.records.count() == none.failures.count() == 0 and none.records.columns == ["id", "translation_key", "category"]


def test_locales(spark):
    assert [locale_chain(x) for x in ("de_AT", " DE ", "en_us", "", None, "_x", "a_b_c")] == [["de_at", "de", "en_us"], ["de", "en_us"], ["en_us", "en"], ["en_us"], ["en_us"], ["_x", "en_us"], ["a_b_c", "a", "en_us"]]
    texts = spark.createDataFrame([("k", "en_us", "E"), ("k", "de", "D"), ("k", "de_at", None), ("l", "EN_us", "L"), ("m", "fr", "F"), ("n", "x9", "deep")], "key string, locale string, text string")
    wanted = spark.createDataFrame([("k",), ("l",), ("m",), ("zz",), (None,)], "translation_key string")
    got = {r.translation_key: r.text for r in scans.with_text(wanted, texts, "de_AT").collect()}
    assert got == {"k": "D", "l": "L", "m": "m", "zz": "zz", None: None}
    chain = [f"x{i}" for i in range(40)]
    assert [tuple(r) for r in scans.texts_for(texts, chain).collect()] == [("n", "deep", "x9")]


def test_widths_and_order(spark):
    words = ["", "ab", "石!", "ｆｕｌｌ", "한글", "😀", "é", None, "。", "\u303f\u115f\u1160"]
    frame = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")

    def width(text):
        units = text.encode("utf-16-be")
        held = [int.from_bytes(units[i : i + 2]) for i in range(0, len(units), 2)]
        return sum(1 + any(a <= c <= b for a, b in ((0x1100, 0x115F), (0x2E80, 0xA4CF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE6F), (0xFF00, 0xFF60))) for c in held)

    assert [r.n for r in frame.orderBy("i").select(display_width(F.col("w")).alias("n")).collect()] == [width(w or "") for w in words]
    odd = ["\ue000", "\U0001f600", "\uffff", "a", "\ud7ff", "\U00010000x"]
    got = [r.w for r in spark.createDataFrame([(w,) for w in odd], "w string").orderBy(utf16(F.col("w"))).collect()]
    assert got == sorted(odd, key=lambda w: w.encode("utf-16-be"))


def walk(starts, parent):
    """Levels by walking up from every start, one step at a time."""
    depth = {}
    for _, start in starts:
        at, d, seen = start, 0, set()
        while at is not None and at not in seen:
            seen.add(at)
            depth[at] = min(d, depth.get(at, d))
            at, d = parent.get(at), d + 1
    labels = {}
    for label, node in starts:
        labels.setdefault(node, []).append(label)
    out = {(n, d, tuple(labels.get(n, ())), len(labels.get(n, ())) > 1, False) for n, d in depth.items()}
    if any(parent.get(n) is None for n in depth):
        out.add((None, max(depth.values()) + 1, (), False, True))
    return out


def test_chains(spark):
    import random

    cases = [
        ([("this", 1)], {1: 2, 2: 3, 3: None}),
        ([("a", 1), ("b", 1)], {1: None}),
        ([("b", 1), ("a", 4), ("c", 1)], {1: 2, 2: 3, 3: None, 4: 3}),
        ([("a", 1)], {1: 2, 2: 1}),
        ([("deep", 0), ("short", 98)], {i: i + 1 for i in range(100)} | {100: None}),
        ([("x", 7)], {}),
    ]
    rng = random.Random(5)
    for _ in range(2):
        parent = {i: rng.choice([None, *range(60)]) for i in range(60)}
        cases.append(([(f"s{k}", rng.randrange(60)) for k in range(6)], parent))
    for starts, parent in cases:
        s = spark.createDataFrame([(label, node, i) for i, (label, node) in enumerate(starts)], "label string, node int, ord int")
        levels = graphs.chain_search(s, spark.createDataFrame(list(parent.items()), "node int, parent int"))
        got = [(r.node, r.depth, tuple(r.labels), r.shared, r.terminal) for r in levels.collect()]
        assert set(got) == walk(starts, parent) and len(got) == len(set(got))
    r = graphs.chain_summary(graphs.chain_search(*(spark.createDataFrame(d, c) for d, c in (([("a", 1, 0), ("b", 1, 1), ("c", 2, 2)], "label string, node int, ord int"), ([(1, 2)], "node int, parent int"))))).first()
    assert tuple(r) == (3, 2, 2)
    assert graphs.chain_search(*(spark.createDataFrame([], c) for c in ("label string, node int, ord int", "node int, parent int"))).count() == 0


def test_a_document_is_parsed_once(spark, monkeypatch):
    """However many fields it has, and whatever of them complains."""
    held = []
    monkeypatch.setattr(records, "cut_lineage", lambda df: held.append(df) or df)
    rows = spark.createDataFrame([("a:b", '{"descriptionId":"x"}')], "id string, document string").withColumn("document", F.lower("document"))
    records.typed(rows, "item")
    assert held[0]._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
