"""Vectorised word scanning of Arrow text columns.

A word is a run of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text.  Words
and word n-grams get 64-bit polynomial hashes; a whole batch is hashed by a
handful of numpy passes instead of a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: For matching past edits: words are runs of letters, digits and non-ASCII bytes.
PUNCTUATION = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD1342543DE82EF95 | 1
_byte_values = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_lower_values = _byte_values.copy()
_lower_values[0x41:0x5B] = _byte_values[0x61:0x7B]
#: Bytes that are hashed at once.
PIECE = 4 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=_U)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        have = _powers[base] = (both[0], both[1])
    return have


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * _power_table(base, len(values))[0][: len(values)], out=out[1:])
    return out


@dataclass
class Words:
    """Words of a batch of texts: byte bounds, hashes, and each text's range."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i] to bounds[i + 1]

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word numbers) and hashes of all n-grams inside one text."""
        h = self.hashes
        if len(h) < n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U)
        last = np.repeat(self.bounds[1:], np.diff(self.bounds))
        at = np.flatnonzero(np.arange(len(h)) + n <= last)
        g, done = np.zeros(len(h), dtype=_U), 0
        power, width = h, 1  # hashes of the `width` words from each word on
        for bit in range(n.bit_length()):
            if n >> bit & 1:  # the n words are runs of lengths that are powers of two, one after the other
                g[: len(h) - n + 1] = g[: len(h) - n + 1] * _U(pow(_STEP, width, 1 << 64)) + power[done : done + len(h) - n + 1]
                done += width
            if n >> bit > 1:
                power = power[:-width] * _U(pow(_STEP, width, 1 << 64)) + power[width:]
                width *= 2
        g = g[at]
        return at, mix(g)

    def text(self, first: int, stop: int) -> bytes:
        """Words first to stop - 1, as they stand, joined by one space."""
        return b" ".join(
            self.data[s:e].tobytes()
            for s, e in zip(self.starts[first:stop], self.ends[first:stop], strict=True)
        )


def _scan(data: np.ndarray, offsets: np.ndarray, lower: bool, space: np.ndarray) -> Words:
    n = len(data)
    inside = ~space[data]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = inside[edges]
    finishes[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(finishes) + 1
    table = _lower_values if lower else _byte_values
    hashes = np.empty(len(starts), dtype=_U)
    first = 0
    while first < len(starts):  # pieces of whole words, so that tables of powers stay small however long the text
        begin = int(starts[first])
        stop = max(first + 1, int(np.searchsorted(ends, begin + PIECE, side="right")))
        end = int(ends[stop - 1])
        if end - begin <= PIECE:
            p = _prefix(table[data[begin:end]], _BASE)
            hashes[first:stop] = (p[ends[first:stop] - begin] - p[starts[first:stop] - begin]) * _power_table(_BASE, end - begin)[1][starts[first:stop] - begin]
        else:  # one word of more than a piece
            total = 0
            for k in range(begin, end, PIECE):
                total += int(_prefix(table[data[k : min(k + PIECE, end)]], _BASE)[-1]) * pow(_BASE, k - begin, 1 << 64)
            hashes[first] = total & (2**64 - 1)
        first = stop
    hashes = mix(hashes)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets))


def scan(texts: pa.Array, lower: bool = False, limit: int = 4 << 20, space: np.ndarray = SPACE) -> Iterator[tuple[int, Words]]:
    """Scan a text column in runs of about ``limit`` bytes (one text at least).

    Yields (number of the run's first text, Words).  Null counts as empty.
    ``lower`` hashes A-Z as a-z; ``space`` says which bytes part words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, values = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        stop = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        stop = min(max(stop, first + 1), len(texts))
        yield first, _scan(
            data[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first], lower, space
        )
        first = stop
