import math
import random
from fractions import Fraction

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.llm import topk


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 200), st.integers(1, 5), st.sampled_from([1, 2, 60, 2**24, 2**40, 2**90]), st.integers(1, 8))
def test_block_equals_brute_force(seed, n, dim, most, k):
    rng = random.Random(seed)
    rows, queries = ([[rng.randint(-most, most) for _ in range(dim)] for _ in range(m)] for m in (n, 4))
    keys = sorted(rng.sample(range(1000), n))
    names = [*keys[:2], 2000, 2001][:4]
    queries = queries[: len(names)]
    kind = np.int64 if most < 2**60 else object
    index = topk.BitSlices(n, *topk.BitSlices.cut(np.array(rows, dtype=kind).reshape(n, dim)))
    got = {q: list(zip([keys[i] for i in best], scores, strict=True)) for q, best, scores in topk.search_block(index, np.array(keys), np.array(names), np.array(queries, dtype=kind), k)}
    for q, v in zip(names, queries, strict=True):
        scored = sorted((-sum(a * b for a, b in zip(v, r, strict=True)), i) for i, r in zip(keys, rows, strict=True) if i != q)[:k]
        assert sorted(got[q]) == sorted((i, -s) for s, i in scored)


def brute(rows, k=20):
    """By exact fractions; rows in order of id, nulls last."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    ok = [(i, [math.floor(64 * Fraction(float(x))) for x in v]) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(ok):
        if q is not None and q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), n, i) for n, (i, w) in enumerate(ok) if n != at and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s if abs(s) < 1 << 63 else None) for n, (s, _, i) in enumerate(scored)]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert result(topk.op5_topk(spark, "/root/testdata/sf0.001")) == brute(rows)


ODD = [(100, None), (120, [1.0, None, 2.0]), (140, [1.0, float("nan"), 0.0]), (160, [float("inf"), 0.0, 0.0]), (180, [1.0, 2.0]), (181, [1.0, 2.0]), (200, []), (None, [1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]


def test_edges(spark, monkeypatch):
    for name, value in (("ROW_BLOCK", 7), ("QUERY_BLOCK", 2), ("RUN", 2)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3) / 10]) for i in range(-40, 60)] + ODD
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("id", "block", "_key", "key", "dim"):
        df = df.withColumn(c, F.lit("x"))
    assert result(topk.top_k(df, F.col("id") % 20 == 0)) == brute(rows)
    assert topk.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_large_components_and_repeated_rows_take_part(spark):
    rows = [(i, [float(i), -2.0 * i]) for i in range(1, 30)] + [(20, [3.0, 1.0]), (20, [3.0, 1.0]), (20, [-300000.0, 7.0]), (41, [300000.0, 0.5]), (42, [1e30, -1e30]), (60, [-1e30, 2.5e200]), (61, [1.7e308, 0.25]), (62, [-1.7e308, 1.7e308])] + ODD
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = result(topk.top_k(df, F.col("id") % 20 == 0))
    assert got == brute(rows) and any(r[3] is None for r in got) and sum(r[0] == 20 and r[1] == 1 for r in got) == 4


def test_sql_agrees(spark, tmp_path):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    rows += [(40, rows[3][1]), (40, rows[3][1]), (7, rows[5][1]), (9000, [300000.0] * 64), (9001, [-1e7] * 64), *ODD]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = topk.op5_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score")
    assert result(got) == sorted(con.execute(topk.ORACLE).fetchall(), key=str)
