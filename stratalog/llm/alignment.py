"""Operator 13: how two tokenizers' tokens of one text lie to each other.

Both tokenizers encode a space and the text, A byte-level, B by pieces (whose model adds the space).
Where both tokens' bytes, joined, are that text, the cumulative ends of A's and B's tokens are two
ascending lists of byte offsets; merging them with two pointers gives a link at each step (the A and
the B token that the pointers stand at overlap in those bytes) and closes a group wherever both lists
have the same offset. A task merges the lists of a chunk of documents in one go.

A chunk's links name their pair by its place in the chunk's list of distinct pairs, so only these
lists, with counts, are grouped and counted by Spark. The counts and the highest count of each side's
ids are joined back to the lists, and each chunk's links read their statistics from its own list. Rows
are in proportion to the distinct pairs of chunks, and no key has more of them than there are chunks.

Edge cases: texts that are null or empty, or whose bytes a tokenizer does not give back (U+2581 for
B), have no tokens, and zeros; special tokens' strings in a text are plain text; a text longer than a
chunk is a chunk by itself; rows that repeat, or repeat an id, count each; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import small_batches, staged
from .tokens import _BYTE_NAMES, Encoder, Store, vocabulary_file
from .words import slices, utf8

#: Bytes of text whose pairs share a list, and that are merged at once.
CHUNK_BYTES, BLOCK_BYTES = 2 << 20, 1 << 19


class ByteEncoder(Encoder):
    """A byte-level tokenizer that reads special tokens' strings as plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        byte = {c: b for b, c in enumerate(_BYTE_NAMES)}
        known = json.loads(Path(path).read_text(encoding="utf-8"))
        shown = {i: bytes(byte[c] for c in t) for t, i in known["model"]["vocab"].items() if all(c in byte for c in t)}
        self.bytes = [shown.get(i, b"") for i in range(max(shown) + 1)]


class PieceEncoder(Encoder):
    """A piece tokenizer on texts that begin with a space, which its model would add.

    No piece has a space behind other characters, so units that begin at single spaces never merge;
    a vocabulary that has such a piece is read whole text by whole text.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        piece = [self.model.id_to_piece(i) for i in range(size)]
        self.apart = not any("▁" in p.lstrip("▁") for p in piece)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(piece)]
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.hashes, self.used, self.round = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0
        self.ids, self.raw = Store(self.kind), Store(np.uint8)

    def _learn(self, units: list[str]) -> list[list[int]]:
        lone = [self.model.piece_to_id("▁")]  # the model adds no space to nothing
        return [ids or lone for ids in self.model.encode([u[1:] for u in units], num_threads=1)]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype=np.uint32) for ids in self._learn(texts)]

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        if self.apart:
            return super()._encode(texts)
        return [np.array(self._learn([t])[0] if t else [], dtype=np.uint32) for t in texts.to_pylist()]


class Side:
    """A tokenizer, and of each id the bytes and the decimal digits with what may follow them."""

    AFTER = (",", "|", ";")

    def __init__(self, encoder: ByteEncoder | PieceEncoder):
        self.encoder = encoder
        self.bytes, self.digits = Store(np.uint8), Store(np.uint8)
        digits = [f"{i}{c}".encode() for i in range(len(encoder.bytes)) for c in self.AFTER]
        for store, own in ((self.bytes, encoder.bytes), (self.digits, digits)):
            store.insert(np.zeros(len(own), np.int64), np.frombuffer(b"".join(own), np.uint8), np.array([len(x) for x in own]))


@lru_cache(maxsize=2)
def sides(a: str, b: str) -> tuple[Side, Side]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Side(ByteEncoder(a)), Side(PieceEncoder(b))


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two pointers over two ascending lists that end alike: of each step its A and B index, and of each common end both.

    A stable sort of two ascending runs is one merge of them; the pointers are counts of what came before.
    """
    if not len(ends_a):
        return (np.zeros(0, np.int64),) * 4
    order = np.argsort(np.concatenate([ends_a, ends_b]), kind="stable")
    from_a = order < len(ends_a)
    end = np.where(from_a, ends_a[np.minimum(order, len(ends_a) - 1)], ends_b[np.maximum(order - len(ends_a), 0)])
    step = np.flatnonzero(np.r_[end[1:] != end[:-1], True])
    upto = np.cumsum(from_a)[step], np.cumsum(~from_a)[step]  # ends of each side up to and with this step's
    moves = [np.diff(np.r_[0, x]) for x in upto]  # which pointers move on: 1 or 0
    a, b = (x - m for x, m in zip(upto, moves, strict=True))
    common = (moves[0] & moves[1]).astype(bool)
    return a, b, a[common], b[common]


def group_texts(a: Side, b: Side, ids: tuple[np.ndarray, np.ndarray], closes: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``a1,a2|b1;`` for each group in turn, and where each group's end; ``closes`` are the last tokens of the groups."""
    n = [np.diff(np.r_[-1, c]) for c in closes]  # tokens of each group
    group = [np.repeat(np.arange(len(c)), k) for c, k in zip(closes, n, strict=True)]
    ahead = [np.r_[0, np.cumsum(k)] for k in n]
    place = np.arange(len(ids[0])) + ahead[1][group[0]], np.arange(len(ids[1])) + ahead[0][group[1] + 1]
    after = [np.zeros(len(x), np.int64) for x in ids]
    after[0][closes[0]], after[1][closes[1]] = 1, 2
    size = np.zeros(len(ids[0]) + len(ids[1]), np.int64)
    parts = []
    for side, own, at, sign in zip((a, b), ids, place, after, strict=True):
        which = own.astype(np.int64) * len(Side.AFTER) + sign
        parts.append((at, which, side.digits))
        size[at] = side.digits.size[which]
    upto = np.cumsum(size)
    out = np.zeros(upto[-1] if len(upto) else 0, np.uint8)
    for at, which, digits in parts:
        flat, end = digits.take(which)
        out[np.arange(len(flat)) + np.repeat(upto[at] - end, digits.size[which])] = flat
    return out, upto[ahead[0][1:] + ahead[1][1:] - 1]


def align_block(texts: pa.Array, a: Side, b: Side) -> dict[str, list | np.ndarray]:
    """Per text counts of tokens, groups and links and the groups' text, and of all links in turn the pair as one number."""
    spaced = pc.if_else(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False), pc.binary_join_element_wise("", texts, " "), pa.scalar(None, pa.string()))
    data, at = utf8(spaced)
    length = np.diff(at)
    good = length > 0
    tokens = [s.encoder.encode(spaced) for s in (a, b)]
    n = [np.fromiter(map(len, t), np.int64, len(t)) for t in tokens]
    flat = [np.concatenate(t) if t else np.zeros(0, np.uint32) for t in tokens]
    for s, own, count in zip((a, b), flat, n, strict=True):
        ends = np.r_[0, np.cumsum(s.bytes.size[own])]
        good &= np.diff(ends[np.r_[0, np.cumsum(count)]]) == length
    for s, own, count in zip((a, b), flat, n, strict=True):
        shown = s.bytes.take(own[np.repeat(good, count)])[0]
        rows = np.flatnonzero(np.repeat(good, length))
        wrong = rows[shown != data[rows]]
        good[np.searchsorted(at, wrong, side="right") - 1] = False
    flat = [own[np.repeat(good, count)] for own, count in zip(flat, n, strict=True)]
    n = [count * good for count in n]
    ends = [np.cumsum(s.bytes.size[own]) for s, own in zip((a, b), flat, strict=True)]
    link_a, link_b, close_a, close_b = merged(*ends)
    doc = np.repeat(np.arange(len(good)), n[0])
    n_links, n_groups = (np.bincount(doc[x], minlength=len(good)) for x in (link_a, close_a))
    shown, upto = group_texts(a, b, (flat[0], flat[1]), (close_a, close_b))
    raw, cut = shown.tobytes(), np.r_[0, upto][np.r_[0, np.cumsum(n_groups)]]
    groups = [raw[x : max(x, y - 1)].decode() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    pairs = flat[0][link_a].astype(np.int64) << 32 | flat[1][link_b].astype(np.int64)
    return {"n_a": n[0], "n_b": n[1], "n_groups": n_groups, "n_links": n_links, "groups": groups, "pairs": pairs}


def align_chunk(texts: pa.Array, a: Side, b: Side) -> dict[str, list | np.ndarray]:
    """What ``align_block`` finds in each part of the texts, and the links' places among the distinct pairs ``pair_a``, ``pair_b``, ``pair_n``."""
    blocks = [align_block(part.column("text"), a, b) for part in slices([pa.record_batch([texts], names=["text"])], "text", BLOCK_BYTES)]
    found = {c: np.concatenate([x[c] for x in blocks]) for c in ("n_a", "n_b", "n_groups", "n_links")}
    pair, place, count = np.unique(np.concatenate([x.pop("pairs") for x in blocks]), return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")  # frequent pairs have small places, which pack well
    where = np.empty(len(order), np.uint16 if len(order) <= 1 << 16 else np.uint32)
    where[order] = np.arange(len(order))
    raw, cut = where[place].tobytes(), np.r_[0, np.cumsum(found["n_links"])] * where.itemsize
    links = [raw[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    return {**found, "groups": [g for x in blocks for g in x["groups"]], "links": links, "pair_a": (pair >> 32)[order].astype(np.int32), "pair_b": (pair & 0xFFFFFFFF)[order].astype(np.int32), "pair_n": count[order]}


_LISTS = ("pair_a", "pair_b", "pair_n")
_ALIGNED = "chunk long, id string, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, pair_a array<int>, pair_b array<int>, pair_n array<long>"


def _align(path_a: str, path_b: str, most: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = TaskContext.get().partitionId() << 32
        for frame in frames:
            batch = pa.record_batch([pa.array(frame["id"], pa.string()), pa.array(frame["text"], pa.string())], names=["id", "text"])
            for part in slices([batch], "text", most):
                found = align_chunk(part.column("text"), *sides(path_a, path_b))
                lists = {c: [found.pop(c)] + [None] * (part.num_rows - 1) for c in _LISTS}  # in the chunk's first row
                yield pd.DataFrame({"chunk": chunk, "id": part.column("id").to_pylist(), **found, **lists})
                chunk += 1

    return run


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """Per row (chunk, id, n_a, n_b, n_groups, n_links, groups, links, and the chunk's pairs in one row of it).

    ``groups`` is ``a1,a2|b1;a3|b2``: ids of A and B, group after group; null ids and texts are allowed. A plan, not yet run.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    run = _align(a or vocabulary_file("byte_bpe_50k.json"), b or vocabulary_file("piece_bpe_32k.model"), CHUNK_BYTES)
    return rows.mapInPandas(run, _ALIGNED)


def chunk_pairs(aligned: DataFrame) -> DataFrame:
    """(chunk, place, a, b, n): the distinct pairs of each chunk, and how many of its links each has."""
    lists = aligned.filter("pair_n is not null").select("chunk", F.posexplode(F.arrays_zip(*_LISTS)).alias("place", "p"))
    return lists.select("chunk", "place", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("n"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, n, best_a, best_b): links of each pair of ids in all, and whether no pair of that A (B) id has more."""
    counts = staged(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    most = {c: counts.groupBy(c).agg(F.max("n").alias(f"most_{c}")) for c in ("a", "b")}
    joined = counts.join(most["a"], "a").join(most["b"], "b")
    return joined.select("a", "b", "n", (F.col("n") == F.col("most_a")).alias("best_a"), (F.col("n") == F.col("most_b")).alias("best_b"))


_STATISTICS = "id string, n_best long, n_best_a long, count_sum long"


def _read_links(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Sums over each document's links of one chunk."""
    size = docs["n_links"].to_numpy()
    raw = b"".join(docs["links"])
    place = np.frombuffer(raw, np.uint16 if len(raw) == 2 * size.sum() else np.uint32)
    cut = np.r_[0, np.cumsum(size)]
    out = {"id": docs["id"]}
    for name, column in (("n_best", "best_b"), ("n_best_a", "best_a"), ("count_sum", "count")):
        by_place = np.zeros(len(pairs), np.int64)
        by_place[pairs["place"].to_numpy()] = pairs[column].to_numpy()
        out[name] = np.diff(np.r_[0, np.cumsum(by_place[place])][cut])
    return pd.DataFrame({**out, **{c: docs[c] for c in docs.columns if c not in ("chunk", "id", "links")}})


def link_statistics(aligned: DataFrame, pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Per row of ``aligned`` (staged): its columns but for links and pairs, and n_best, n_best_a, count_sum over its links."""
    told = pairs.select("chunk", "place", "a", "b").join(counts.withColumnRenamed("n", "count"), ["a", "b"]).select(F.col("chunk").alias("of"), "place", "count", "best_a", "best_b")
    docs = aligned.drop(*_LISTS)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("chunk", "id", "links"))
    return docs.groupBy("chunk").cogroup(told.groupBy("of")).applyInPandas(_read_links, f"{_STATISTICS}, {kinds}")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    aligned = align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    aligned = staged(aligned.withColumn("groups", digest).withColumnRenamed("groups", "groups_sha256"), "aligned")
    pairs = chunk_pairs(aligned)
    done = link_statistics(aligned, pairs, pair_counts(pairs))
    return done.select(F.col("id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_a")
