import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.llm import bpe
from stratalog.llm.bpe import Merges, WordEncoder, bpe_round_trip, op11_bpe, word_encoder
from stratalog.llm.tokens import vocabulary_file

PATH = vocabulary_file("word_bpe_49k.json")
ODD = [None, "", " \n\t", "a  b", "It's 12 o'clock", "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|>", "<|endoftext|><|endoftext|>", "ÀΣΑΣ é é́ ́", "a b\u0085c  d ", "\x1c\x00 \x1f", "w" * 5000, "日本語 한국 İI ǅ", "😀👍🏽", "aaaa aaaaa", "<| <|endoftext |>", "12345 ٣٤ Ⅷ½"]


def library(texts):
    found = word_encoder(PATH).tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [e.ids for e in found]


def check(texts, encoder=None):
    encoder = encoder or word_encoder(PATH)
    ids = encoder.encode(texts)
    want = library(texts)
    assert [x.tolist() for x in ids] == want
    assert encoder.decode(ids).to_pylist() == [encoder.tokenizer.decode(x, skip_special_tokens=False) for x in want]


def test_odd_texts():
    check(ODD)
    check(ODD[::-1] + ODD)
    check([])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30)))
def test_any_text(texts):
    check(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abtheÉé'<|>  \n0", max_size=30)))
def test_close_texts(texts):
    check([*texts, *(t + "<|endoftext|>" + t for t in texts[:2])])


def test_documents(spark):
    check([r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()])


def plain_bpe(word, triples):
    """The lowest rank, of it the leftmost pair, one merge at a time."""
    ranks = {}
    for r, (a, b, _) in enumerate(triples):
        ranks.setdefault((a, b), r)
    word = list(word)
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(word, word[1:], strict=False)) if p in ranks]
        if not found:
            return word
        r, i = min(found)
        word[i : i + 2] = [triples[r][2]]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 5)] * 3), max_size=12), st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=14), max_size=5))
def test_merges_in_any_order_of_ranks(triples, words):
    """Ranks that no training would give, so that a merge makes pairs of lower rank."""
    triples = [(a, b, 6 + n) if c < 3 else (a, b + 5, 6 + n) for n, (a, b, c) in enumerate(triples)]
    flat, size = Merges(triples).apply(np.array([x for w in words for x in w], np.int64), np.array([len(w) for w in words], np.int64))
    assert [x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])][: len(words)] == [plain_bpe(w, triples) for w in words]


def test_forgetting_and_equal_hashes(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    own = WordEncoder(PATH)
    for n in range(6):
        check([f"one two three{n} four, five. six{n} x", "one two"], own)
    monkeypatch.setattr(bpe, "span_hashes", lambda data, begin, end: np.asarray(data[begin] % 3, dtype=np.uint64))
    check(["one two three", None, "four five six", "one two three"], WordEncoder(PATH))


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_op11(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    want = []
    for (d, _), ids in zip(rows, library([t for _, t in rows]), strict=True):
        text = word_encoder(PATH).tokenizer.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, op11_bpe(spark, f"/root/testdata/{sf}").collect())) == sorted(want)


def test_op11_edges(spark):
    docs = spark.createDataFrame([*enumerate(ODD), (None, "last"), (3, "again"), (3, "again")], "doc_id long, text string")
    for c in ("id", "ids", "decoded"):
        docs = docs.withColumn(c, F.lit("x"))
    got = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in bpe_round_trip(docs).collect()), key=str)
    texts = [r.text for r in docs.collect()]
    ids = library(texts)
    assert got == sorted(((r.doc_id, i, word_encoder(PATH).tokenizer.decode(i, skip_special_tokens=False)) for r, i in zip(docs.collect(), ids, strict=True)), key=str)
    assert bpe_round_trip(docs.limit(0)).count() == 0
