import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalog.llm import graph, minhash
from stratalog.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Components over all pairs, by size-sorted comparison."""
    sets = [(d, shingles(t)) for d, t in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted((i for i in range(len(sets)) if sets[i][1]), key=lambda i: len(sets[i][1]))
    for n, i in enumerate(order):
        a = sets[i][1]
        for j in order[n + 1 :]:
            b = sets[j][1]
            if 85 * len(b) > 100 * len(a):
                break
            if root(i) != root(j) and 100 * len(a & b) >= 85 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = root(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, len(s), least[root(i)], d == least[root(i)]) for i, (d, s) in enumerate(sets)), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    assert result(minhash.op6_minhash(spark, sf)) == want
    assert sum(not k for *_, k in want) > 10


def test_groups_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = np.random.default_rng(5)
    base = [[f"w{b}_{i}" for i in range(150)] for b in range(3)]
    rows = []
    for i in range(150):
        w = list(base[i % 3])
        for j in rng.choice(150, rng.integers(0, 4), replace=False):
            w[j] = f"x{rng.integers(9)}"
        rows.append((1000 - i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = result(minhash.near_duplicates(df))
    assert got == brute(rows) and len({c for _, _, c, _ in got}) < 60


def test_edges(spark):
    rows = [(1, "a b"), (2, "A  b"), (3, "a b c d e"), (4, None), (5, ""), (6, "a"), (6, "a"), (None, "a"), (None, "q r s"), (7, "É x y z w v"), (8, "é x y z w v"), (9, "x " * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit("c")).withColumn("key", F.lit(1))
    assert result(minhash.near_duplicates(df)) == brute(rows)
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, None, 7, 8, 9]))
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_index_finds_all_under_threshold():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**16, (300, minhash.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(minhash.SYMBOLS, rng.integers(0, minhash.MOST_ERRORS + 1), replace=False)
        row[at] ^= 1
    s = np.concatenate([a, b])
    batch = pa.record_batch([pa.array(np.arange(600)), pa.array([x.tobytes() for x in s], pa.binary())], names=["cls", "signature"])
    (out,) = minhash._keys(iter([batch]))
    keys = out.column("key").to_numpy().reshape(600, -1)
    assert all(set(keys[i]) & set(keys[i + 300]) for i in range(300))


def test_thue_morse_words_differ(spark):
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, f"{word} x y z w"), (2, f"{other} x y z w"), (3, word), (4, other)], "doc_id long, text string")
    assert all(r.kept for r in minhash.near_duplicates(df).collect())


def test_components(spark):
    edges = [(i, i + 1) for i in range(60) if i % 20] + [(100, 103), (103, 101), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    want = {}
    for a, b in edges:
        for x in (a, b):
            want[x] = 100 if x >= 100 else max(0, (x - 1) // 20) * 20 + 1
    want[5] = 1
    assert got == want


def test_components_with_hubs(spark, monkeypatch):
    """Nodes over the degree meet their neighbours by broadcast; the components are the same."""
    monkeypatch.setattr(graph, "DEGREE", 3)
    rng = np.random.default_rng(9)
    edges = [(500, int(i)) for i in rng.choice(400, 60, replace=False)] + [(0, i) for i in range(401, 440)] + [(i, i + 1) for i in range(600, 640)] + [(600, 601)] * 5
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {x: root(x) for x in up}


def test_signature_size_follows_percent():
    assert minhash.signature_size(85) == (minhash.SYMBOLS, minhash.MOST_ERRORS) == minhash.signature_size(95)
    assert minhash.signature_size(80) == (40, 19)
    for percent in range(71, 100):
        n, most = minhash.signature_size(percent)
        assert most < n // 2 and n % minhash.CHUNK == 0
    with pytest.raises(ValueError):
        minhash.signature_size(60)


def test_stage_drops_pairs_from_80_percent(spark):
    rows = []
    for i in range(60):
        w = [f"w{i}_{j}" for j in range(84)]  # 80 shingles; m words fewer leave 80 - m of them
        rows += [(4 * i + k, " ".join(w[: len(w) - m])) for k, m in ((0, 0), (1, 14))]  # 66 / 80 = 0.825
        far = [f"v{i}_{j}" for j in range(84)]
        rows += [(4 * i + k, " ".join(far[: len(far) - m])) for k, m in ((2, 0), (3, 17))]  # 63 / 80
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in minhash.dedup_stage(spark, df, "").collect()}
    assert got == {d for d, _ in rows if d % 4 != 1}
    assert minhash.drop_near_duplicates(df).count() == len(rows)


def test_unrelated_texts_under_null_or_repeated_ids_stay(spark):
    rows = [(None, "a b c d e f"), (None, "g h i j k l"), (None, "g h i j k l"), (7, "m n o p q r"), (7, "s t u v w x"), (7, "s t u v w x"), (8, "s t u v w x"), (None, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(minhash.near_duplicates(df)) == brute(rows)
    kept = minhash.drop_near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted({r for r in rows if r[0] != 8}, key=str)
