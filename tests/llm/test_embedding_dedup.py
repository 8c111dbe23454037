import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import embedding_dedup as ed


def brute(rows, threshold=0.93):
    n = len(rows)
    up, links = list(range(n)), [0] * n

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ok = [lab is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    unit = [np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    for i in range(n):
        for j in range(i + 1, n):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and (unit[i] @ unit[j] >= threshold or rows[i][1] == rows[j][1]):
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least = {}
    for i in range(n):
        r = root(i)
        least[r] = min((x for x in (least.get(r), rows[i][0]) if x is not None), default=None)
    return sorted(((rows[i][0], links[i], least[root(i)], rows[i][0] == least[root(i)]) for i in range(n)), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def clustered(n, seed, spread):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 6, 16))
    return [(i, (base[i % len(base)] + spread * rng.standard_normal(16)).astype(np.float32).tolist(), int(i % 3)) for i in range(n)]


def frame(spark, rows, label="int"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {label}")


@pytest.mark.parametrize("n", [2, 5, 20, 50, 200])
def test_few_vectors_are_compared_exactly(spark, n):
    rng = np.random.default_rng(n)
    base = rng.standard_normal((max(1, n // 3), 16))
    rows = [(i, (base[i % len(base)] + 0.08 * rng.standard_normal(16)).astype(np.float32).tolist(), 0) for i in range(n)]
    assert result(ed.near_duplicate_vectors(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("spread", [0.1, 0.25])
def test_index_recall_and_precision_against_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(ed, "EXACT", 100)
    monkeypatch.setattr(ed, "PER_CELL", 8)
    rows = clustered(900, 1, spread)  # with the wider spread most partners lie close to the threshold
    want = {r[0]: r[1] for r in brute(rows)}
    got = {r.vec_id: r.n_links for r in ed.near_duplicate_vectors(frame(spark, rows)).collect()}
    assert ed.cells_for(900) > 8 and all(got[i] <= want[i] for i in want)
    print("recall", sum(got.values()) / sum(want.values()))
    assert sum(got.values()) >= 0.93 * sum(want.values()) > 0


def test_whole_table(spark):
    """The table has few near copies, so some are added: every link of the sum is held against all pairs."""
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    rng = np.random.default_rng(6)
    rows += [(10**6 + i, (np.array(v) + 0.2 * np.abs(v).mean() * rng.standard_normal(len(v))).astype(np.float32).tolist(), lab) for i, v, lab in rows[::4]]
    want = {r[0]: r[1] for r in brute(rows)}
    got = {r.vec_id: r.n_links for r in ed.near_duplicate_vectors(frame(spark, rows)).collect()}
    assert len(rows) >= ed.EXACT and got.keys() == want.keys() and all(got[i] <= want[i] for i in want)
    print("recall", sum(got.values()) / sum(want.values()))
    assert sum(got.values()) >= 0.95 * sum(want.values()) > 500


def test_whole_margin_is_exact_over_many_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 4), ("EXACT", 10), ("PER_CELL", 8)):
        monkeypatch.setattr(ed, name, value)
    rows = clustered(200, 2, 0.2)
    rows = [(i, v, 0) for i, v, _ in rows] + [(i + 500, v, 0) for i, v, _ in rows[:50]]
    df = frame(spark, rows).repartition(3)
    monkeypatch.setattr(ed, "fit_codebooks", lambda *a: (*REAL(*a)[:2], 1e9))
    assert result(ed.near_duplicate_vectors(df)) == brute(rows)


REAL = ed.fit_codebooks


def test_edges(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.1], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [-0.0, 3.0], 1), (11, [0.0, 3.0], 1), (11, [0.0, 3.0], 1), (None, [0.0, 9.0], 1), (13, [], 1), (14, [float("inf"), 1.0], 1), (15, [2.0], 1), (16, [5.0], 1), (17, [-5.0], 1)]
    df = frame(spark, rows)
    for c in ("cls", "cell", "key", "_key", "id", "v", "dim", "digest"):
        df = df.withColumn(c, F.lit("x"))
    assert result(ed.near_duplicate_vectors(df)) == brute(rows)
    assert ed.near_duplicate_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize(("kind", "labels"), [("string", "ab"), ("double", (1.2, 1.7)), ("double", (0.0, -0.0)), ("boolean", (True, False))])
def test_labels_of_any_type(spark, kind, labels):
    rows = [(i, [1.0, 0.01 * i], labels[i % 2]) for i in range(6)]
    assert result(ed.near_duplicate_vectors(frame(spark, rows, kind))) == brute(rows)


def test_doubles_keep_their_precision(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.93, float(np.sqrt(1 - 0.93**2)) * (1 + 1e-9)], 1), (2, [0.93 * (1 + 1e-9), float(np.sqrt(1 - 0.93**2))], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: r.n_links for r in ed.near_duplicate_vectors(df).collect()} == {0: 1, 1: 1, 2: 2}


def test_traversal_is_the_set_within_the_margin():
    rng = np.random.default_rng(4)
    x = ed._unit(rng.standard_normal((80, 8)))
    books = ed.fit_codebooks(x, 6, 0.93, 0.9)
    home, who, cell = ed.traverse(x, books)
    for i in range(50):
        d = ed._distances(x[i : i + 1, :4], books[0]).T + ed._distances(x[i : i + 1, 4:], books[1])
        want = set(np.flatnonzero(d.ravel() <= d.min() + books[2]))
        assert set(cell[who == i]) == want and home[i] in want
