import hashlib
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm import vector_codes
from stratalog.llm.vector_codes import Chunk, Codebooks, cuts, distances, encode_vectors, op12_codes

SF = "/root/testdata/sf0.01"


def cut_in_parts(v):
    return [v[i * len(v) // 16 : (i + 1) * len(v) // 16] for i in range(16)]


def brute(rows):
    """rows (id, vector) of one length, kept ones: codes and errors by whole numbers, every part with every entry."""
    rows = sorted(((i is None, i or 0, [math.floor(256 * float(x)) for x in v]) for i, v in rows))
    books = [[list(p) for p in own] for own in zip(*(cut_in_parts(v) for *_, v in rows[:64]), strict=True)]

    def far(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min(range(len(b)), key=lambda e: (far(p, b[e]), e)) for p, b in zip(cut_in_parts(v), books, strict=True)] for *_, v in rows]

    for _ in range(2):
        codes = assign()
        for p in range(16):
            for e in range(len(books[p])):
                own = [cut_in_parts(v)[p] for (*_, v), c in zip(rows, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(None if null else i, "".join(f"{x:02x}" for x in c), sum(far(p, b[x]) for p, b, x in zip(cut_in_parts(v), books, c, strict=True)), digest) for (null, i, v), c in zip(rows, assign(), strict=True)]


def fast(rows):
    """The same by numpy, for whole tables."""
    x = np.floor(256 * np.array([v for _, v in rows], dtype=np.float64)).astype(np.int64)
    x = x[np.argsort([i for i, _ in rows], kind="stable")]
    books = [x[:64, c].copy() for c in cuts(x.shape[1])]
    near = lambda: [((x[:, None, c] - b) ** 2).sum(axis=2).argmin(axis=1) for c, b in zip(cuts(x.shape[1]), books, strict=True)]
    for _ in range(2):
        for c, b, code in zip(cuts(x.shape[1]), books, near(), strict=True):
            for e in set(code.tolist()):
                own = x[code == e, c]
                b[e] = own.sum(axis=0) // len(own)
    codes = near()
    error = sum(((x[:, c] - b[k]) ** 2).sum(axis=1) for c, b, k in zip(cuts(x.shape[1]), books, codes, strict=True))
    digest = hashlib.sha256(",".join(str(int(v)) for b in books for v in b.reshape(-1)).encode()).hexdigest()
    return [(i, "".join(f"{int(k[n]):02x}" for k in codes), int(error[n]), digest) for n, i in enumerate(sorted(i for i, _ in rows))]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 60), st.sampled_from([16, 32, 20]), st.integers(1, 9), st.sampled_from([2, 300, 1 << 36]))
def test_heaps_against_all_entries(seed, n, dim, k, wide):
    """Rounds of moving entries: heaps always tell the nearest, ties included."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-wide, wide, (n, dim))
    books = Codebooks([x[:k, c].copy() for c in cuts(dim)])
    chunk = Chunk.first(x, books)
    for _ in range(4):
        chunk = vector_codes._unpacked(dim, n, *vector_codes._packed(chunk))
        want = np.stack([distances(x[:, c].astype(object), b.astype(object)).argmin(axis=1) for c, b in zip(cuts(dim), books.entries, strict=True)], axis=1)
        assert (chunk.codes() == want).all()
        flat, entries = chunk.sums(len(books.entries[0])), len(books.entries[0])
        at, totals = 0, []
        for c in cuts(dim):
            totals.append(flat[at : at + entries * (c.stop - c.start)].reshape(entries, -1))
            at += entries * (c.stop - c.start)
        books = books.moved(totals, list(flat[at : at + 16 * entries].reshape(16, entries)))
        chunk.follow(books)


def test_few_parts_are_scanned_again(spark):
    told = []
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    encode_vectors(table, told=told).count()
    assert told[0] == 16 * table.count() and told[1] - told[0] < 16 * table.count()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op12(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    kept = [r for r in rows if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    got = sorted((r.vec_id, r.code, r.error, r.codebooks_sha256, r.label_error) for r in op12_codes(spark, f"/root/testdata/{sf}").collect())
    want = fast([(r.vec_id, r.embedding) for r in kept])
    if sf == "sf0.001":
        sql = duckdb.sql(vector_codes.ORACLE.replace("FROM embeddings", f"FROM '/root/testdata/{sf}/embeddings.parquet'"))
        assert sorted(sql.select("vec_id, code, error, codebooks_sha256").fetchall()) == want
        assert want == brute([(r.vec_id, r.embedding) for r in kept])
    labels = {r.vec_id: r.label for r in kept}
    total = {}
    for i, _, e, _ in want:
        total[labels[i]] = total.get(labels[i], 0) + e
    assert got == sorted((*w, total[labels[w[0]]]) for w in want)


def test_edges(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(150, 16)).tolist()
    rows = [(i if i % 7 else None, x, "a" if i % 3 else None) for i, x in enumerate(v)]
    rows += [(5, v[5], "b"), (5, v[6], "b"), (5, v[5], "b")]
    odd = [(1000, None, "a"), (1001, [None] * 16, "a"), (1002, [float("nan")] * 16, "a"), (1003, [float("inf")] * 16, None)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label string").selectExpr("*", "1 as id", "'x' as code", "2 as dim")
    got = sorted(((r.vec_id, r.code, r.error, r.codebooks_sha256) for r in encode_vectors(frame).collect()), key=str)
    assert got == sorted(brute([(i, x) for i, x, _ in rows]), key=str)
    mixed = spark.createDataFrame([(1, [0.5] * 3, "a"), (2, [0.25, -0.001, 1.0], "a"), (3, [], "a"), (4, [1.0] * 20, "b")], "vec_id long, embedding array<float>, label string")
    got = {(r.vec_id, r.code, r.error, r.codebooks_sha256) for r in encode_vectors(mixed).collect()}
    assert got == {*brute([(1, [0.5] * 3), (2, [0.25, -0.001, 1.0])]), *brute([(3, [])]), *brute([(4, [1.0] * 20)])}
    assert encode_vectors(frame.limit(0)).count() == 0
    huge = spark.createDataFrame([(i, [1e300 if i == 70 else float(i)] * 16, "a") for i in range(71)], "vec_id long, embedding array<double>, label string")
    assert encode_vectors(huge).count() == 71


def test_null_labels_are_one_group(spark):
    path = spark.conf.get("spark.checkpoint.dir") + "/vectors"
    rows = [(i, np.random.default_rng(i).normal(size=32).tolist(), None if i % 2 else 1.5) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double").write.parquet(f"{path}/embeddings.parquet")
    want = brute([(i, v) for i, v, _ in rows])
    total = [sum(e for i, _, e, _ in want if i % 2 == odd) for odd in (0, 1)]
    assert sorted((r.vec_id, r.error, r.label_error) for r in op12_codes(spark, path).collect()) == sorted((i, e, total[i % 2]) for i, _, e, _ in want)
