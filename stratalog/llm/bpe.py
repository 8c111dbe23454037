"""Operator 11: BPE encoding and decoding by an index of pair occurrences.

A vocabulary with word ends (lower case, white space dropped) never joins what white space parts, so
a text is cut into words and each distinct word is encoded once by a worker. The new words of a
batch are merged together: an index maps each pair of neighbouring symbols, by the rank of its
merge, to all its positions in those words. The active ranks stand in a heap; the lowest is applied
to its whole list, and each merge puts the two pairs it makes into the lists of theirs. The rules of
letters (normal form, lower case, what is a letter) are those of the tokenizer file, as its library
reads them; its merges are applied here.

Decoding joins the vocabulary's strings of the ids by spaces, as the library does for a file without
a decoder. Ids and decoded text are columns of the result; no row is shuffled.

Edge cases: a null or empty text, or one of white space alone, has no ids and decodes to an empty
text; special tokens in a text are read as such (``<|endoftext|>``); a word of any length is merged
in one pass, by lists in proportion to it; rows that repeat stand as they are; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import small_batches
from .tokens import _BYTE_NAMES, MOST_BYTES, MOST_IDS, REMEMBERED, Encoder, Store, vocabulary_file
from .words import slices, span_hashes, split_words, spread

CHUNK_BYTES = 4 << 20


class Merges:
    """Merges (left, right, made) of symbols by rank; of a pair given twice the first rank counts."""

    def __init__(self, triples: list[tuple[int, int, int]]):
        self.triples = triples
        left, right, made = np.array(triples, dtype=np.int64).reshape(-1, 3).T
        self.keys, self.ranks = np.unique(left << 32 | right, return_index=True)
        least = dict(zip(right[::-1].tolist(), range(len(left) - 1, -1, -1), strict=True))  # the first rank that each symbol is part of
        for a, r in zip(left[::-1].tolist(), range(len(left) - 1, -1, -1), strict=True):
            least[a] = min(r, least.get(a, r))
        #: Ranks whose merge may make a pair of a rank that is not higher; merges that were learned in turn have none.
        self.early = {r for r, m in enumerate(made.tolist()) if least.get(m, r + 1) <= r}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        if not len(self.keys):
            return np.full(len(left), -1)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def apply(self, symbol: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols, and how many, of each word after all merges: in each the lowest rank first, of a rank the leftmost pair first.

        The words lie end to end in ``symbol``; ``places`` holds, for each rank whose pair occurs, all positions of the pair.
        """
        n, upto = len(symbol), np.cumsum(size)
        symbol = symbol.astype(np.int64)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[upto[size > 0] - 1] = -1
        before[(upto - size)[size > 0]] = -1
        left = np.flatnonzero(after >= 0)
        rank = self.rank(symbol[left], symbol[left + 1])
        left, rank = left[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        left, (active, first) = left[order], np.unique(rank[order], return_index=True)
        places = {r: own.tolist() for r, own in zip(active.tolist(), np.split(left, first[1:]), strict=False)}
        active = active.tolist()  # ascending, and so a heap
        while active:
            now = heappop(active)
            a, b, made = self.triples[now]
            at = np.array(places.pop(now), np.int64)
            at = at[symbol[at] == a]
            j = after[at]
            at = at[(j >= 0) & (symbol[j] == b)]
            if a == b or now in self.early:
                at = np.unique(at)
                if now in self.early:  # one merge a word, since what it makes may go before the next
                    _, alone = np.unique(np.searchsorted(upto, at, side="right"), return_index=True)
                    if len(rest := np.delete(at, alone)):
                        places[now] = rest.tolist()
                        heappush(active, now)
                    at = at[alone]
                else:  # of a run of overlapping pairs every other one
                    start = np.r_[True, after[at[:-1]] != at[1:]]
                    run = np.flatnonzero(start)
                    at = at[(np.arange(len(at)) - run[np.cumsum(start) - 1]) % 2 == 0] if len(at) else at
            if not len(at):
                continue
            j = after[at]
            k = after[j]
            symbol[at], symbol[j], after[at], after[j] = made, -1, k, -1
            inner = k >= 0
            before[k[inner]] = at[inner]
            h = before[at]
            outer = h >= 0
            near = np.concatenate([at[inner], h[outer]])
            ranks = self.rank(symbol[near], symbol[after[near]])
            hit = ranks >= 0
            for i, r in zip(near[hit].tolist(), ranks[hit].tolist(), strict=True):
                if r in places:
                    places[r].append(i)
                else:
                    places[r] = [i]
                    heappush(active, r)
        alive = symbol >= 0
        return symbol[alive], np.diff(np.r_[0, np.cumsum(alive)][np.r_[0, upto]])


class WordEncoder(Encoder):
    """Ids equal to the tokenizer's on the whole text, for files whose pre-tokenizer drops white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        known = json.loads(Path(path).read_text(encoding="utf-8"))
        model, added = known["model"], known["added_tokens"]
        if not model["end_of_word_suffix"] or known["decoder"] is not None or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("a vocabulary with word ends, plain special tokens and no decoder is needed")
        self.end, self.vocabulary = model["end_of_word_suffix"], model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges([(self.vocabulary[a], self.vocabulary[b], self.vocabulary[a + b]) for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in added}
        self.parts = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.special, key=len, reverse=True)) or "(?!)")
        #: Symbols of the characters that stand for bytes, within a piece and at its end.
        self.inner, self.last = np.zeros(512, np.int64), np.zeros(512, np.int64)
        for c in _BYTE_NAMES:
            self.inner[ord(c)], self.last[ord(c)] = self.vocabulary[c], self.vocabulary[c + self.end]
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.hashes, self.used, self.round = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0
        self.ids, self.raw = Store(self.kind), Store(np.uint8)
        self.strings = Store(np.uint8)
        names = {i: t for t, i in self.vocabulary.items()} | {i: t for t, i in self.special.items()}
        shown = [f"{names.get(i, '')} ".encode() for i in range(max(names) + 1)]
        self.strings.insert(np.zeros(len(shown), np.int64), np.frombuffer(b"".join(shown), np.uint8), np.array([len(s) for s in shown]))

    def _pieces(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """What the pre-tokenizer makes of the words, in characters that stand for bytes: the distinct pieces, and in
        order the place there and the word of each; a special token is in place of its number from the end."""
        part, owner, odd = [], [], []
        for n, w in enumerate(words):
            for p in self.parts.split(w):
                if p in self.special:
                    odd.append((len(part), -1 - list(self.special).index(p)))
                    p = ""
                part.append(p.lower() if p is not None and p.isascii() else self.tokenizer.normalizer.normalize_str(p) if p else "")
                owner.append(n)
        start = np.cumsum([0] + [len(p) + 1 for p in part])
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ".join(part))
        index: dict[str, int] = {}
        which = [index.setdefault(p, len(index)) for p, _ in found]
        place = np.searchsorted(start, np.fromiter((at for _, (at, _) in found), np.int64, len(found)), side="right") - 1
        place, which = np.r_[place, np.array([k for k, _ in odd], np.int64)], np.r_[np.array(which, np.int64), np.array([x for _, x in odd], np.int64)]
        order = np.argsort(place, kind="stable")
        return list(index), which[order], np.array(owner, np.int64)[place[order]]

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, end to end, and how many each has: their distinct pieces are merged together."""
        distinct, which, owner = self._pieces(words)
        size = np.fromiter(map(len, distinct), np.int64, len(distinct))
        code = np.frombuffer("".join(distinct).encode("utf-32-le"), "<u4")
        symbol, last = self.inner[code], np.cumsum(size) - 1
        symbol[last] = self.last[code[last]]
        ids = Store(np.int64)
        flat, size = self.merges.apply(symbol, size)
        special = list(self.special.values())[::-1]  # from the end
        ids.insert(np.zeros(len(size) + len(special), np.int64), np.r_[flat, np.array(special, np.int64)], np.r_[size, np.ones(len(special), np.int64)])
        which = np.where(which < 0, which + len(ids.size), which)
        return ids.take(which)[0], np.bincount(owner, ids.size[which], len(words)).astype(np.int64)

    def encode(self, texts: pa.Array | pa.ChunkedArray | list) -> list[np.ndarray]:
        """Ids of each text; a null text has none. The longer the lists of places are, the less a merge costs."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        rows = pa.record_batch([texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts], names=["text"])
        return [ids for part in slices([rows], "text", CHUNK_BYTES) for ids in self._encode(part.column("text"))]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Without memory: all words of the texts are merged together."""
        flat, size = self._learn(texts)
        return np.split(flat.astype(np.uint32), np.cumsum(size)[:-1]) if texts else []

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        words = split_words(texts)
        data, begin, end = words.data, words.start, words.end
        if len(self.hashes) > REMEMBERED or len(self.ids.flat) > MOST_IDS or len(self.raw.flat) > MOST_BYTES:
            self._forget()
        self.round += 1
        distinct, first, unit = np.unique(span_hashes(data, begin, end), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == distinct[inside]
        fresh = np.flatnonzero(~known)
        raw = data.tobytes()
        left, right = begin[first[fresh]], end[first[fresh]]
        self.used[place[known]] = self.round
        self.ids.insert(place[fresh], *self._learn([raw[a:b].decode() for a, b in zip(left.tolist(), right.tolist(), strict=True)]))
        self.raw.insert(place[fresh], data[spread(left, right)[0]], right - left)
        self.hashes, self.used = np.insert(self.hashes, place[fresh], distinct[fresh]), np.insert(self.used, place[fresh], np.int32(self.round))

        place = np.searchsorted(self.hashes, distinct)[unit]
        if not self._holds(place, data, begin, end):  # different words with one hash
            return self.whole([t or "" for t in texts.to_pylist()])
        flat, upto = self.ids.take(place)
        cut = np.r_[0, upto][words.first]
        flat = flat.astype(np.uint32)
        return [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def decode(self, ids: list[np.ndarray]) -> pa.Array:
        """The text of each list of ids."""
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat, upto = self.strings.take(np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64))
        cut = np.r_[0, upto][np.r_[0, np.cumsum(size)]]
        raw = flat.tobytes()
        return pa.array([raw[a : max(a, b - 1)].decode() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.string())


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _round_trip(path: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", most):
            ids = word_encoder(path).encode(batch.column("text"))
            packed = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
            yield pa.record_batch([batch.column("id"), packed, word_encoder(path).decode(ids)], names=["id", "ids", "decoded"])

    return run


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Per row (id_col, ids, decoded): the ids as little-endian unsigned 32-bit integers, and the text they decode to."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    path = tokenizer or vocabulary_file("word_bpe_49k.json")
    return rows.mapInArrow(_round_trip(path, CHUNK_BYTES), "id long, ids binary, decoded string").withColumnRenamed("id", id_col)


def op11_bpe(spark, sf_dir: str) -> DataFrame:
    done = bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
