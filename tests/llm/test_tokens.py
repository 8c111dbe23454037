import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.llm import packing, token_files, tokens
from stratalog.llm.packing import OpenWindows, op4_packing, pack, pack_documents
from stratalog.llm.tokens import encoder, vocabulary_file

ODD = [None, "", " ", "  a", "a  b", "a\n b", "a \nb", "x \n\n  y ", "don't  stop <|endoftext|> now", "ééé " * 3000, "w" * 5000, "  b", "a\t b"]


def reference(text):
    return encoder(vocabulary_file()).tokenizer.encode(text or "", add_special_tokens=False).ids


def equal(texts):
    own = encoder(vocabulary_file())
    return [x.tolist() for x in own.encode(texts)] == [x.tolist() for x in own.whole(texts)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abé1' \n\t.é  ", max_size=20)))
def test_units_equal_whole(texts):
    assert equal(texts)


def test_documents_equal_whole(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert equal(texts)


def test_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    for n in range(6):
        assert equal([f"one two three{n} four, five. six{n}\u2003x \u00a0y", "one two"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=40))
def test_pack_holds_each_token_once_without_padding(sizes):
    windows = pack(sizes, 16)
    held = sorted((d, s + i) for w in windows for d, s, n in w for i in range(n))
    assert held == [(d, i) for d, n in enumerate(sizes) for i in range(n)]
    fills = [sum(n for _, _, n in w) for w in windows]
    assert all(0 < f <= 16 and (f & (f - 1)) == 0 for f in fills) and sum(f < 16 for f in fills) <= 4


def test_thue_morse_units_and_equal_hashes(monkeypatch):
    """Two units whose polynomials agree modulo 2**64 for any odd base; then hashes that agree on purpose."""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    assert equal([f"x {word}", "x " + word.translate(str.maketrans("ab", "ba"))])
    monkeypatch.setattr(tokens, "span_hashes", lambda data, begin, end: np.asarray(data[begin] % 3, dtype=np.uint64))
    own = tokens.Encoder(vocabulary_file())
    texts = ["one two three", "four five", None, "one two three", "six seven"]
    assert [x.tolist() for x in own.encode(texts)] == [x.tolist() for x in own.whole([t or "" for t in texts])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 70), max_size=12), max_size=6), st.integers(0, 3), st.integers(2, 40))
def test_windows_stay_open_from_chunk_to_chunk(chunks, slack, most):
    packer, windows, sizes = packing.Packer(16, slack), [], []
    before, packing.MOST_OPEN = packing.MOST_OPEN, most
    try:
        for own in chunks:
            windows += packer.add(list(enumerate(own, len(sizes))))
            sizes += own
            assert len(packer.open) <= most + 1
        windows += packer.finish()
    finally:
        packing.MOST_OPEN = before
    held = sorted((d, s + i) for w in windows for d, s, n in w for i in range(n))
    assert held == [(d, i) for d, n in enumerate(sizes) for i in range(n)]
    fills = [sum(n for _, _, n in w) for w in windows]
    assert all(f >= 16 - slack or f & (f - 1) == 0 for f in fills) and max(fills, default=0) <= 16


def test_best_fit_carries_the_result():
    """Few documents are cut, and next to nothing is padded; filling gaps alone would cut one a window."""
    sizes = np.minimum(2047, np.exp(np.random.default_rng(8).normal(5.5, 1, 6000)).astype(int) + 1).tolist()
    packer, windows = packing.Packer(2048, 16), []
    for at in range(0, 6000, 1000):
        windows += packer.add(list(enumerate(sizes[at : at + 1000], at)))
    windows += packer.finish()
    fills = [sum(p[2] for p in w) for w in windows]
    assert sum(map(len, windows)) - len(sizes) < 0.05 * len(windows)
    assert sum(2048 - f for f in fills if f & (f - 1)) < 0.002 * sum(sizes)


@settings(max_examples=100)
@given(st.lists(st.integers(1, 16), max_size=30))
def test_tightest_is_best_fit(needs):
    tree, rooms = OpenWindows(16), {}
    for k, need in enumerate(needs):
        fit = [r for r in rooms.values() if r >= need]
        found = tree.tightest(need)
        assert (found[1] if found else None) == (min(fit) if fit else None)
        w, room = found or (k + 100, 16)
        rooms.pop(w, None)
        if room > need:
            rooms[w] = room - need
            tree.put(room - need, w)


def check_pieces(rows, want):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(want)
    for d, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want[d]) and r.ids_crc32 == crc(want[d][at : at + r.length])
            at += r.length
        assert at == len(want[d])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and (at >= 2032 or at & (at - 1) == 0)


def test_op4(spark):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: [*reference(r.text), 1] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_pieces(op4_packing(spark, sf).collect(), want)


def test_op4_edges(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("start", F.lit("x"))
    for chunk in (10, 1 << 20):
        rows = pack_documents(df, chunk_bytes=chunk).withColumn("ids_crc32", F.crc32("ids")).collect()
        check_pieces(rows, {i: [*reference(t), 1] for i, t in enumerate(ODD)})
    assert pack_documents(df.limit(0)).count() == 0


def test_op4_repeated_ids_and_arrow_batches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    docs = docs.union(docs.limit(5)).union(spark.createDataFrame([(None, "x y", None, None, None)], docs.schema)).coalesce(1)
    before, seen = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    try:
        for n in ("3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            seen.append(sorted(map(tuple, pack_documents(docs, chunk_bytes=50_000).drop("ids").collect()), key=str))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert seen[0] == seen[1]
    r = packing.report(pack_documents(docs)).first()
    assert r.padding <= 0.004 * r.tokens and r.tokens == sum(len(x) + 1 for x in encoder(vocabulary_file()).encode([d.text for d in docs.collect()]))


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_op2(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect())
    got = sorted((tuple(r) for r in token_files.op2_token_files(spark, f"/root/testdata/{sf}").collect()))
    at, want = 0, []
    for d, t in rows:
        ids = [*reference(t), 0]
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want


def test_op2_edges_and_random_access(spark):
    df = spark.createDataFrame([*enumerate(ODD), (None, "last"), (3, "again")], "doc_id long, text string")
    for c in ("id", "start", "n_tokens", "base", "shard"):
        df = df.withColumn(c, F.lit("x"))
    manifest = token_files.write_token_files(df, length=8)
    got = sorted(token_files.read_digests(manifest).collect(), key=lambda r: r.start)
    order = sorted([*enumerate(ODD), (None, "last"), (3, "again")], key=lambda r: (r[0] is None, r[0], r[1] or ""))
    ids = [[*reference(t), 0] for _, t in order]
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(d, len(i), crc(i)) for (d, _), i in zip(order, ids, strict=True)]
    assert [r.start for r in got] == [0, *np.cumsum([len(i) for i in ids])[:-1]]
    flat = [x for i in ids for x in i]
    for m in manifest.collect():
        shard = token_files.ShardReader(m.base)
        rows = [shard.sequence(i) for i in range(-(-m.n_tokens // 8))]
        assert [int(x) for a, mask in rows for x in a[mask]] == flat[m.start : m.start + m.n_tokens]
        assert shard.sequence(0)[0].base is not None  # a view, no copy
    assert token_files.read_digests(token_files.write_token_files(df.limit(0))).count() == 0


def test_rows_of_one_id_spread_over_shards(spark):
    texts = [None] * 500 + ["same"] * 500 + [f"{i} words" for i in range(1000)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(3)
    manifest = token_files.write_token_files(docs, length=8)
    assert manifest.count() == 4 and max(r.n_docs for r in manifest.collect()) < 900
    rows = token_files.read_digests(manifest).collect()
    assert sorted((r.n_tokens, r.ids_crc32) for r in rows) == sorted((len(i) + 1, crc([*i, 0])) for i in map(reference, texts)) and {r.doc_id for r in rows} == {None}
    assert sorted(r.start for r in rows) == [0, *np.cumsum([r.n_tokens for r in sorted(rows, key=lambda r: r.start)])[:-1]]


def test_report_counts_rows_that_repeat_an_id(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "c " * 5000)], "doc_id long, text string")
    r = packing.report(pack_documents(docs)).first()
    assert (r.documents, r.cut) == (3, 0)


def test_index_in_batches(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "INDEX_ROWS", 3)
    writer = token_files.ShardWriter(str(tmp_path / "s"), 4, pa.uint16())
    for i in range(7):
        writer.add(i if i < 6 else None, np.arange(i, dtype=np.uint32))
    writer.close()
    batches = list(token_files.ShardReader(str(tmp_path / "s")).index())
    rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    assert len(batches) == 3 and rows == [(i if i < 6 else None, i * (i - 1) // 2, i) for i in range(7)]
