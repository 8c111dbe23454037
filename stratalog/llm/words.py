"""Words and rolling hashes of whole Arrow columns, as numpy arrays.

A word is a maximal run without ASCII white space (0x20, 0x09 to 0x0D). All functions take the
UTF-8 bytes of many texts at once; no Python loop runs over words or characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = b" \t\n\x0b\x0c\r"
_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[list(SEPARATORS)] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z only

_RNG = np.random.Generator(np.random.PCG64(20240607))
#: A random number for each byte at each of the first places of a word; further places get theirs from ``mix``.
_PLACES = 64
_CODES = _RNG.integers(0, 2**64, _PLACES << 8, dtype=np.uint64)
_FAR = _RNG.integers(0, 2**64, 1, dtype=np.uint64)[0]
#: Odd multipliers of two polynomials over the words of a window.
_BASES = [0] + [int(x) & ~7 | 3 for x in _RNG.integers(0, 2**64, 2, dtype=np.uint64)]


class Words(NamedTuple):
    """Words of several texts: byte span of each, and the index of its text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # of each text and one more: index of its first word


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_KEPT: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_MOST_KEPT = 6 << 20


def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below size, or further; long tables are not kept."""
    if which in _KEPT and len(_KEPT[which][0]) >= size:
        return _KEPT[which]
    size = max(1, -(-size // (1 << 18))) * (1 << 18)
    base = _BASES[which]
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(size, b, dtype=np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p, out=p))
    if size <= _MOST_KEPT:
        _KEPT[which] = (out[0], out[1])
    return out[0], out[1]


def _sums(codes: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of codes[i] * base**i, and the inverse powers that shift a difference to 0."""
    power, inverse = _powers(which, len(codes))
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(codes * power[: len(codes)], out=total[1:])
    return total, inverse


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each; a null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def split_words(texts: pa.Array | pa.ChunkedArray, fold: bool = False) -> Words:
    """All words of the texts in order; ``fold`` lower-cases A-Z and nothing else."""
    data, at = utf8(texts)
    if fold:
        data = _FOLD[data]
    inside = _WORD_BYTE[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = at[:-1] < at[1:]
    before[at[:-1][filled]] = False
    after[at[1:][filled] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(at, start, side="right") - 1
    return Words(data, start, end, doc, np.searchsorted(start, at))


#: Bytes of spans that are handled at once.
_AT_ONCE = 1 << 20


def spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all bytes of nonempty spans their index and their place in the span; and how many come before each span."""
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    return place + np.repeat(start, size), place, first


def blocks(start: np.ndarray, end: np.ndarray) -> Iterator[slice]:
    """Runs of spans of about ``_AT_ONCE`` bytes; a longer span comes alone."""
    total, at = np.cumsum(end - start), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _AT_ONCE, side="right")))
        yield slice(at, to)
        at = to


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each nonempty span: a sum of random numbers for byte and place, so no pattern of bytes cancels out."""
    out = np.zeros(len(start), np.uint64)
    for own in blocks(start, end):
        where, place, first = spread(start[own], end[own])
        byte = data[where]
        code = _CODES[np.minimum(place, _PLACES - 1) << 8 | byte]
        far = np.flatnonzero(place >= _PLACES)
        if len(far):
            code[far] = mix((place[far].astype(np.uint64) << np.uint64(8) | byte[far]) ^ _FAR)
        out[own] = mix(np.add.reduceat(code, first))
    return out


def word_hashes(words: Words) -> np.ndarray:
    """64 bits for each word."""
    return span_hashes(words.data, words.start, words.end)


def window_hashes(codes: np.ndarray, width: int, which: int = 1) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive codes, by position of the first.

    The modulus is 2**64, so windows of many hundred words in which two words alternate by a
    Thue-Morse pattern would collide; ``width`` is a few words.
    """
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, inverse = _sums(codes, which)
    with np.errstate(over="ignore"):
        return mix((total[width:] - total[:n]) * inverse[:n])


def windows(words: Words, width: int, two: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """Index of the first word of every window inside one text, and one or two independent hashes of each."""
    n = len(words.start) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), [np.zeros(0, np.uint64)] * (1 + two)
    codes = word_hashes(words)
    at = np.flatnonzero(words.doc[:n] == words.doc[width - 1 :])
    return at, [window_hashes(codes, width, k)[at] for k in range(1, 2 + two)]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of about ``most`` bytes of ``column``; a longer text comes alone."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        total = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
        del batch
        pa.default_memory_pool().release_unused()
