import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import language


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = language.op7_language(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95


def test_counts_and_scores_match_plain_python():
    texts = ["Ab a", "", "é"]
    bucket, doc = language.ngrams(texts)
    assert len(bucket) == sum(max(0, len(t) + 2 - n + 1) for t in texts for n in language.ORDERS)
    one = language.ngrams(["Ab a"])[0]
    assert sorted(bucket[doc == 0]) == sorted(one) == sorted(language.ngrams(["ab A"])[0])
    rng = np.random.default_rng(1)
    matrix = np.log(rng.random((3, language.BUCKETS + 1))).astype(np.float32)
    names, top, divide, mass = language.score_texts(texts, ["x", "y", "z"], matrix, 0.5)
    for i in range(3):
        total = matrix[:, -1].astype(float) + matrix[:, bucket[doc == i]].sum(axis=1)
        assert names[i] == "xyz"[total.argmax()] and top[i] == pytest.approx(total.max(), rel=1e-5) and 1 <= mass[i] <= 3
        assert divide[i] == (doc == i).sum() ** 0.5


@pytest.mark.parametrize(("text", "has"), [("²³", False), ("½ Ⅷ", False), ("12_3", False), ("٣", False), ("x2", True), ("é", True), ("字", True), ("ª", True), ("", False)])
def test_letters(text, has):
    assert language.lettered(text) == has


def test_trained_counts_match_a_plain_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = {}
    for r in docs.collect():
        own = counts.setdefault(r.lang, [0, collections.Counter()])
        own[0] += 1
        padded = f" {r.text.lower()} "
        own[1].update(padded[i : i + n] for n in language.ORDERS for i in range(len(padded) - n + 1))
    names, matrix = language.train(docs, "text", "lang")
    assert names == sorted(counts)
    for k, name in enumerate(names):
        buckets = np.full(language.BUCKETS, 0.5)
        for gram, n in counts[name][1].items():
            point = 0
            for ch in gram:
                point = point << 21 | ord(ch)
            x = np.array([point], dtype=np.uint64) ^ language._SALT[len(gram)]
            buckets[int(language.mix(x)[0]) % language.BUCKETS] += n
        assert np.allclose(matrix[k, :-1], np.log(buckets / buckets.sum()), atol=1e-5)
        assert matrix[k, -1] == pytest.approx(np.log(counts[name][0] / sum(c for c, _ in counts.values())), abs=1e-5)


def test_pages_of_languages_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    result = lambda: {r.doc_id: (r.lang_pred, round(r.score, 4)) for r in language.op7_language(spark, "/root/testdata/sf0.001").collect()}
    whole = result()
    for n in (1, 3):
        monkeypatch.setattr(language, "LANGUAGES", n)
        assert result() == whole and len(whole) == docs.count()


def test_edges(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de"), (None, "le chat", None), (4, None, "en"), (5, "12 34!", "de"), (6, "the " * 50000, None), (7, "", "fr")], "doc_id long, text string, lang string").withColumn("cell", F.lit(1))
    model = language.train(df, "text", "lang")
    assert model[0] == ["de", "en", "fr"]
    got = {r.doc_id: r.lang_pred for r in language.predict(df, model).collect()}
    assert got[1] == got[6] == "en" and got[2] == "de" and got[4] == got[5] == got[7] == "und"
    assert language.predict(df, language.train(df.limit(0), "text", "lang")).filter("lang_pred <> 'und'").count() == 0
