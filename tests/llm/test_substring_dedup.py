import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalog.llm import substring_dedup as dedup
from stratalog.llm.substring_dedup import _intervals, op1_substring_dedup, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    first, out = {}, {}
    for d, w in sorted(docs, key=lambda x: x[0]):
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), (d, i))
    for d, w in docs:
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (d, i):
                gone.update(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), " ".join(kept))
    return out


def result(df, width, **kw):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(df, width=width, **kw).collect()}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {d: (n, g, hashlib.sha256(k.encode()).hexdigest()) for d, (n, g, k) in brute(rows, 20).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op1_substring_dedup(spark, sf).collect()}
    assert got == want and any(g for _, g, _ in want.values())


def test_whole_table_in_small_chunks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 20)
    for size in (1, 20_000):
        assert result(docs.repartition(3), 20, chunk_bytes=size) == want


def test_edges_and_small_chunks(spark):
    rows = [(4, "a b c d e"), (2, "x a b c\ty é z"), (7, None), (8, ""), (-1, "c d e"), (9, "a a a a a"), (10, "b c d " * 50), (11, " \n\v ")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, bucket string").repartition(3)
    for size in (1, 40, 1 << 20):
        assert result(df, 3, chunk_bytes=size) == brute(rows, 3)


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_words, r.n_removed) for r in remove_repeats(df, width=3).collect())
    assert got == [(False, 4, 0), (False, 4, 4), (True, 0, 0), (True, 4, 4)]


def test_thue_morse_words_differ(spark):
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{word} x y"), (2, f"{other} x y"), (3, f"x y {other} x y")]
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), 3) == brute(rows, 3)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=50)
@given(st.lists(st.integers(0, 25)))
def test_intervals(starts):
    import numpy as np

    edge, mask = _intervals(np.array(starts, dtype=np.int64), 4, 30)
    want = {j for i in starts for j in range(i, i + 4)}
    assert set(np.flatnonzero(mask)) == want == {j for a, b in edge for j in range(a, b)}


def test_a_passage_in_every_text_is_spread_over_buckets():
    """Its window counts once a chunk; the other places go by document, and no bucket holds more than a small share."""
    import pyarrow as pa

    words = [f"p{i}" for i in range(20)]
    texts = [" ".join([*(f"w{k}x{i}" for i in range(5)), *words]) for k in range(3000)]
    batch = pa.record_batch([pa.array(range(3000), pa.int64()), pa.array(texts)], names=["key", "text"])
    out = next(iter(dedup._hash_batches(20, 128, 8 << 20)(iter([batch])))).to_pydict()
    places = {}
    for b, hashes, docs in zip(out["bucket"], out["hashes"], out["docs"], strict=True):
        if hashes is None:
            places[b] = places.get(b, 0) + len(dedup._unpack([docs], np.int64))
    assert sum(places.values()) == 2999 and max(places.values()) <= 24
