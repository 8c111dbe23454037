import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratalog.llm import alignment
from stratalog.llm.alignment import align, align_chunk, merged, op13_alignment, sides
from stratalog.llm.tokens import vocabulary_file

A, B = vocabulary_file("byte_bpe_50k.json"), vocabulary_file("piece_bpe_32k.model")
BYTES = Tokenizer.from_file(A)
BYTES.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=B)
ODD = [None, "", " ", "  a", "a  b ", "a\n b", "x \n\n  y ", "don't <|endoftext|> <s> </s> <0x0A>", "a▁b", "▁", "éé 日本 😀", "w" * 3000, "\x00 \x01", "12,345.67"]


def byte_names():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in shown}
    return names | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


NAMES = byte_names()


def plain(text):
    """Tokens of both sides as (id, bytes), or none."""
    if not text:
        return [], []
    e = BYTES.encode(f" {text}", add_special_tokens=False)
    a = [(i, bytes(NAMES[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
    b = []
    for i in PIECES.encode(text):
        p = PIECES.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if PIECES.is_byte(i) else p.replace("▁", " ").encode()))
    want = f" {text}".encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def spans(tokens):
    at, out = 0, []
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(texts):
    """Rows of (n_a, n_b, n_groups, n_links, n_best, count_sum, groups), by all pairs of tokens of a text."""
    docs, count = [], Counter()
    for t in texts:
        a, b = map(spans, plain(t))
        links = [(x, y) for x, s, e in a for y, u, v in b if s < v and u < e]
        common = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for high in common:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in (a, b)))
            low = high
        count.update(links)
        docs.append((len(a), len(b), groups, links))
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(na, nb, len(g), len(ls), sum(count[p] == most[p[1]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for na, nb, g, ls in docs]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é▁\n<s>0日", max_size=20), max_size=6))
def test_chunk_against_all_pairs(texts):
    texts = [*texts, None]
    got = align_chunk(pa.array(texts, pa.string()), *sides(A, B))
    want = brute(texts)
    assert [tuple(int(got[c][i]) for c in ("n_a", "n_b", "n_groups", "n_links")) for i in range(len(texts))] == [w[:4] for w in want]
    assert [hashlib.sha256(g.encode()).hexdigest() if n else "" for g, n in zip(got["groups"], got["n_a"], strict=True)] == [w[6] for w in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=20), st.lists(st.integers(1, 3), max_size=20))
def test_two_pointers(a, b):
    a, b = np.cumsum(a).tolist(), np.cumsum(b).tolist()
    end = max([*a, *b, 0])
    a, b = ([*(x for x in own if x < end), end] if end else [] for own in (a, b))
    i = j = 0
    links, closed = [], []
    while i < len(a):
        links.append((i, j))
        x, y = a[i], b[j]
        if x == y:
            closed.append((i, j))
        i, j = i + (x <= y), j + (y <= x)
    got = merged(np.array(a, np.int64), np.array(b, np.int64))
    assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == links
    assert list(zip(got[2].tolist(), got[3].tolist(), strict=True)) == closed


def digests(done):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in done.collect())


@pytest.mark.parametrize("sf", ["sf0.001"])
@pytest.mark.parametrize("chunk", [20_000, 2 << 20])
def test_op13(spark, sf, chunk, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    rows = [r for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 6000]
    want = brute([r.text for r in rows])
    path = spark.conf.get("spark.checkpoint.dir") + f"/few-{chunk}"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    assert digests(op13_alignment(spark, path)) == sorted((str(r.doc_id), *w) for r, w in zip(rows, want, strict=True))


def test_op13_edges(spark):
    rows = [*enumerate(ODD), (None, "last"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "chunk", "a", "b", "n", "place", "links", "groups"):
        docs = docs.withColumn(c, F.lit("x"))
    path = spark.conf.get("spark.checkpoint.dir") + "/odd"
    docs.write.parquet(f"{path}/documents.parquet")
    assert digests(op13_alignment(spark, path)) == sorted((str(d), *w) for (d, _), w in zip(rows, brute([t for _, t in rows]), strict=True))
    docs.limit(0).write.parquet(f"{path}/none/documents.parquet")
    assert op13_alignment(spark, f"{path}/none").count() == 0
    assert {r.groups for r in align(docs).filter("id = '13'").collect()} != {""}


def test_pieces_with_inner_spaces_are_read_whole():
    side = sides(A, B)[1].encoder
    before, side.apart = side.apart, False
    try:
        assert [x.tolist() for x in side.encode([" a b", None, "  c"])] == [PIECES.encode("a b"), [], PIECES.encode(" c")]
    finally:
        side.apart = before
