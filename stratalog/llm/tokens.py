"""Token ids of whole texts, by a public tokenizer file."""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from .words import blocks, slices, span_hashes, spread, utf8

#: Distinct units that a worker remembers, their ids and their bytes in all; beyond that the longest unused half goes.
REMEMBERED, MOST_IDS, MOST_BYTES = 1_500_000, 16_000_000, 64_000_000
#: Bytes of text that are encoded at once.
AT_ONCE = 1 << 20
#: Letters below this point are letters to every version of Unicode.
_LATIN_END = "ɐ"


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_names() -> list[str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


_BYTE_NAMES = _byte_names()
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True


def blank_follows(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the character after the byte at ``at`` (before ``end``) is white space, Unicode's included."""
    padded = np.r_[data, np.zeros(3, np.uint8)]
    a, b, c = (padded[at + k] for k in (1, 2, 3))
    wide = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    wide |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    return (at + 1 < end) & (_BLANK[a] | wide)


class Store:
    """Arrays of different sizes, end to end."""

    def __init__(self, kind: type):
        self.flat = np.zeros(0, kind)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def insert(self, at: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """Add arrays, held end to end in ``flat``, before the places ``at``."""
        start = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])
        self.start, self.size = np.insert(self.start, at, start), np.insert(self.size, at, size)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays asked for, end to end, and where each ends."""
        size = self.size[which]
        upto = np.cumsum(size)
        return self.flat[np.repeat(self.start[which] - (upto - size), size) + np.arange(size.sum())], upto

    def only(self, keep: np.ndarray) -> Store:
        out, which = Store(self.flat.dtype), np.flatnonzero(keep)
        out.insert(np.zeros(len(which), np.int64), self.take(which)[0], self.size[which])
        return out


class Encoder:
    """Ids equal to the tokenizer's on the whole text.

    The byte-level pre-tokenizer never joins a word with what precedes its leading space, so a
    text is cut into units (a space and what follows, up to the next space) and each distinct
    unit is encoded once. Where white space follows a space that does not hold; such texts are
    encoded whole. Units are looked up by 64-bit hashes and compared byte by byte; a text with a
    unit whose hash is another's is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.kind = np.uint16 if self.small else np.uint32
        #: Whether a token starts with a space, by id: in the ids of joined units, each unit's first.
        self.spaced = np.zeros(1 << 18, dtype=bool)
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True
        self.stops = {s: self.whole([s])[0].tolist() for s in ".,"}
        self.hashes = np.zeros(0, np.uint64)  # ascending
        self.used = np.zeros(0, np.int32)
        self.ids, self.raw = Store(self.kind), Store(np.uint8)
        self.round = 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> list[list[int] | np.ndarray]:
        """Ids of distinct units: letters after a space are one pre-token, which the model takes as it is."""
        out: list[list[int] | np.ndarray] = [[]] * len(units)
        merge = self.tokenizer.model.tokenize
        joined, single = [], []
        for n, u in enumerate(units):
            stop = self.stops.get(u[-1], []) if len(u) > 2 else []
            word = u[1:-1] if stop else u[1:]
            if u[0] == " " and word.isalpha() and (word.isascii() or max(word) < _LATIN_END):
                inner = word if word.isascii() else "".join(map(_BYTE_NAMES.__getitem__, word.encode()))
                out[n] = [t.id for t in merge("Ġ" + inner)] + stop
            else:
                (joined if u[0] == " " else single).append(n)
        if joined:
            ids = self.whole(["".join([units[n] for n in joined])])[0]
            cut = np.flatnonzero(self.spaced[ids])
            if len(cut) == len(joined):
                ids = ids.tolist()
                for n, a, b in zip(joined, cut.tolist(), [*cut[1:].tolist(), len(ids)], strict=True):
                    out[n] = ids[a:b]
            else:  # a token that spans units, as some vocabulary may have
                single += joined
        # what starts a text, and the like
        for n, own in zip(single, self.whole([units[n] for n in single]), strict=True):
            out[n] = own
        return out

    def _forget(self) -> None:
        keep = self.used > np.median(self.used)
        self.ids, self.raw = self.ids.only(keep), self.raw.only(keep)
        self.hashes, self.used = self.hashes[keep], self.used[keep]

    def _holds(self, place: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bool:
        """Whether the units remembered at the places are, byte by byte, those of the text."""
        if (self.raw.size[place] != end - begin).any():
            return False
        return all(np.array_equal(self.raw.take(place[own])[0], data[spread(begin[own], end[own])[0]]) for own in blocks(begin, end))

    def encode(self, texts: pa.Array | pa.ChunkedArray | list) -> list[np.ndarray]:
        """Ids of each text; a null text has none. Arrays of a few times ``AT_ONCE`` bytes are needed, or of the longest text."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        rows = pa.record_batch([texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts], names=["text"])
        return [ids for part in slices([rows], "text", AT_ONCE) for ids in self._encode(part.column("text"))]

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        data, at = utf8(texts)
        if len(self.hashes) > REMEMBERED or len(self.ids.flat) > MOST_IDS or len(self.raw.flat) > MOST_BYTES:
            self._forget()
        self.round += 1
        space = np.flatnonzero(data == 32)
        doc = np.searchsorted(at, space, side="right") - 1
        odd = np.zeros(len(at) - 1, bool)
        odd[doc[blank_follows(data, space, at[doc + 1])]] = True

        starts = np.zeros(len(data), bool)
        starts[space] = True
        starts[at[:-1][at[:-1] < at[1:]]] = True
        begin = np.flatnonzero(starts)
        owner = np.searchsorted(at, begin, side="right") - 1
        end = np.minimum(np.r_[begin[1:], [len(data)] * (len(begin) > 0)], at[owner + 1]).astype(np.int64)
        plain = ~odd[owner]
        begin, end, owner = begin[plain], end[plain], owner[plain]
        h = span_hashes(data, begin, end)
        distinct, first, unit = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == distinct[inside]
        fresh = np.flatnonzero(~known)
        raw = data.tobytes()
        left, right = begin[first[fresh]], end[first[fresh]]
        units = [raw[a:b].decode() for a, b in zip(left.tolist(), right.tolist(), strict=True)]
        self.used[place[known]] = self.round
        ids = self._learn(units)
        self.ids.insert(place[fresh], np.fromiter(chain.from_iterable(ids), self.kind), np.fromiter(map(len, ids), np.int64, len(ids)))
        self.raw.insert(place[fresh], data[spread(left, right)[0]], right - left)
        self.hashes, self.used = np.insert(self.hashes, place[fresh], distinct[fresh]), np.insert(self.used, place[fresh], np.int32(self.round))

        place = np.searchsorted(self.hashes, distinct)[unit]
        if not self._holds(place, data, begin, end):  # different units with one hash
            odd[owner] = True
        flat, upto = self.ids.take(place)
        flat = flat.astype(np.uint32)
        cut = np.r_[0, upto][np.searchsorted(owner, np.arange(len(at)))]
        out = [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        if odd.any():
            which = np.flatnonzero(odd).tolist()
            for d, ids in zip(which, self.whole([raw[at[d] : at[d + 1]].decode() for d in which]), strict=True):
                out[d] = ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
