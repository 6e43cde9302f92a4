"""Vectorised word and n-gram fingerprints over batches of texts (numpy, used inside tasks).

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased
text. Fingerprints are 64-bit and the same in every process, so they may cross shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_GRAM = np.random.default_rng(77).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}
WORD_BYTES = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))
SPACE_BYTES = bytes(32 if b in (9, 10, 11, 12, 13, 32) else b for b in range(256))
#: Letters to a or A, digits to 9; white space and punctuation stay.
SHAPE_BYTES = bytes(
    32 if b in (9, 10, 11, 12, 13, 32) else ord("A") if 65 <= b <= 90 else ord("9") if 48 <= b <= 57 else ord("a") if 97 <= b <= 122 or b >= 128 else b
    for b in range(256)
)


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        row = np.full(max(n, 1 << 19), base, np.uint64)
        row[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(row)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordStream:
    """hashes: one per word; offsets[i]:offsets[i+1]: the words of text i; starts, ends: byte places
    of the words in text i's encoded form, counted from that text's first byte."""

    def __init__(self, encoded: Sequence[bytes], table: bytes = WORD_BYTES, squeeze: bool = False, prefix: int = 0):
        buf = b" ".join(encoded).translate(table) + b" "
        arr = np.frombuffer(buf, np.uint8)
        lens = np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1
        first = np.concatenate(([0], np.cumsum(lens)))
        if squeeze:  # runs of one byte count once
            keep = np.empty(len(arr), bool)
            keep[:1] = True
            np.not_equal(arr[1:], arr[:-1], out=keep[1:])
            keep[first[1:-1]] = True
            place = np.concatenate(([0], np.cumsum(keep)))
            arr, first = arr[keep], place[np.minimum(first, len(arr))]
        inside = arr != 32
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if prefix:
            ends = np.minimum(ends, starts + prefix)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[arr] * _powers(_BASE, len(arr)), dtype=np.uint64)))
        self.hashes = mix((total[ends] - total[starts]) * _powers(_INVERSE, len(arr) + 1)[starts] + (ends - starts).astype(np.uint64))
        self.offsets = np.searchsorted(starts, first)
        self.starts, self.ends, self._first = starts, ends, first

    def spans(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.offsets[i], self.offsets[i + 1]
        return self.starts[a:b] - self._first[i], self.ends[a:b] - self._first[i]


def grams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the word n-grams of each text, in order, and their offsets. A text of 1 to n-1
    words has one gram, of all its words; a text without words has none."""
    counts = np.diff(offsets)
    out = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    to = np.concatenate(([0], np.cumsum(out)))
    at = np.repeat(offsets[:-1] - to[:-1], out) + np.arange(to[-1])
    end = np.repeat(offsets[1:], out)
    padded = np.concatenate((hashes, np.zeros(n, np.uint64)))
    acc = np.zeros(len(at), np.uint64)
    for k in range(n):
        word = padded[at + k]
        acc += np.where(at + k < end, word, np.uint64(0)) * _GRAM[k]
    return mix(acc), to


def encode(text: str | None) -> bytes:
    """Lower-cased UTF-8; null counts as empty, lone surrogates as '?'."""
    return (text or "").lower().encode("utf-8", "replace")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so a task never holds many texts as Python strings;
    what Arrow has set aside is given back at the end, because workers live on."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()


def chunks(texts: Sequence[str | None], size: int = 1 << 18) -> Iterator[tuple[int, list[str | None]]]:
    """(index of the first text, texts) with about ``size`` characters each; a longer text stands alone."""
    at, held, chars = 0, [], 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and chars + n > size:
            yield at, held
            at, held, chars = i, [], 0
        held.append(t)
        chars += n
    if held:
        yield at, held
