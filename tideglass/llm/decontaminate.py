"""Benchmark decontamination by pigeonhole edit matching.

A test item of m words may differ from a passage by e = floor(rate x m) word edits. It is split into
e + 1 pieces: a passage within the budget holds at least one piece unchanged. Pieces are found by
their fingerprints in all places of a text; around each find the item is verified with Myers'
bit-parallel distance over words, so each reported distance is exact.

The items are held by every task. Where they exceed ``limit`` characters they are taken in parts of
about that size, one pass over the documents each, so what is broadcast stays bounded.

Defined cases: null and empty texts hold nothing; an item without words is found nowhere; an item too
short for an edit must occur exactly; of several occurrences of an item in a text the one of least
distance, then the first, is reported; repeated rows are reported each; items that repeat are reported
by each id; items and documents with a null id are matched like others and reported with that null; other columns of
the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WordStream, _powers, chunks, encode, mix, slices

RATE = 0.15
LIMIT = 32_000_000
_STEP, _BACK = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 2**64)
_FILTER_BITS = 20
_OUT = "doc_id long, item_id long, distance int, item_words int, start_word int, end_word int"


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of all runs of ``length`` words, in constant time each."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_STEP, len(hashes)), dtype=np.uint64)))
    return mix((total[length : length + n] - total[:n]) * _powers(_BACK, n) + np.uint64(length))


def pieces(words: int, edits: int) -> list[tuple[int, int]]:
    """edits + 1 runs (start, length) of near equal length that make up ``words`` words."""
    cuts = [words * i // (edits + 1) for i in range(edits + 2)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def myers(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """(least edit distance of the pattern to any run of the text, the first place where such a run ends)."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass
class ItemIndex:
    ids: list[int | None]
    words: list[list[int]]
    edits: list[int]
    lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def build(items: list[tuple[int | None, str | None]], rate: float) -> ItemIndex:
        stream = WordStream([encode(t) for _, t in items]) if items else None
        ids, words, edits = [], [], []
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i, (item, _) in enumerate(items):
            h = stream.hashes[stream.offsets[i] : stream.offsets[i + 1]]
            if not len(h):
                continue
            e = int(rate * len(h))
            for start, length in pieces(len(h), e):
                found.setdefault(length, []).append((int(windows(h[start : start + length], length)[0]), len(ids), start))
            ids.append(item)
            words.append(h.tolist())
            edits.append(e)
        lengths = {}
        for length, rows in found.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[keys >> np.uint64(64 - _FILTER_BITS)] = True
            lengths[length] = (keys, np.array([r[1:] for r in rows], np.int64), seen)
        return ItemIndex(ids, words, edits, lengths)

    def search(self, hashes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, start word, end word) of the items that occur in each text."""
        hits: dict[tuple[int, int], list[int]] = {}
        for length, (keys, rows, seen) in self.lengths.items():
            h = windows(hashes, length)
            at = np.flatnonzero(seen[h >> np.uint64(64 - _FILTER_BITS)])
            lo, hi = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
            for p, a, b in zip(at[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                doc = int(np.searchsorted(offsets, p, "right")) - 1
                if p + length <= offsets[doc + 1]:
                    for item, start in rows[a:b]:
                        hits.setdefault((doc, int(item)), []).append(int(p - start))
        out = []
        for (doc, item), starts in sorted(hits.items()):
            m, e, first, last = len(self.words[item]), self.edits[item], int(offsets[doc]), int(offsets[doc + 1])
            best, lo, hi = (e + 1, 0, 0), None, None
            for s in [*sorted(starts), None]:
                if lo is not None and (s is None or s - e > hi):  # a run of overlapping windows is complete
                    distance, end = myers(self.words[item], hashes[lo:hi].tolist())
                    if (distance, lo + end) < best[:2] or distance < best[0]:
                        best = (distance, lo + end, lo)
                    lo = None
                if s is not None:
                    if lo is None:
                        lo = max(first, s - e)
                    hi = min(last, s + m + e)
            if best[0] <= e:
                distance, end, lo = best
                back = myers(self.words[item][::-1], hashes[max(lo, end - m - e) : end][::-1].tolist())
                out.append((doc, item, distance, end - (back[1] if back[0] == distance else m) - first, end - first))
        return out


def _passes(items: DataFrame, limit: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in order, as many at a time as ``limit`` characters hold; a longer one comes alone."""
    part, chars = [], 0
    for r in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"] or "")
        if part and chars + n > limit:
            yield part
            part, chars = [], 0
        part.append((r["item_id"], r["text"]))
        chars += n
    yield part


def matches(docs: DataFrame, items: DataFrame, *, rate: float = RATE, limit: int = LIMIT) -> DataFrame:
    """doc_id, item_id, distance, item_words, start_word, end_word: the items that documents hold."""
    spark = docs.sparkSession
    out = None
    for part in _passes(items, limit):
        shared = spark.sparkContext.broadcast(ItemIndex.build(part, rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in slices(batches):
                ids, rows = b.column("doc_id"), []
                for at, held in chunks(b.column("text").to_pylist()):
                    s = WordStream([encode(t) for t in held])
                    rows += [(ids[at + d].as_py(), index.ids[i], dist, len(index.words[i]), a, z) for d, i, dist, a, z in index.search(s.hashes, s.offsets)]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.int32()) for k, c in enumerate(cols)], [x.split()[0] for x in _OUT.split(", ")])

        found = docs.select("doc_id", "text").mapInArrow(run, _OUT)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, *, rate: float = RATE, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns kept."""
    spark = docs.sparkSession
    for part in _passes(items, limit):
        shared = spark.sparkContext.broadcast(ItemIndex.build(part, rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                keep = np.ones(b.num_rows, bool)
                for at, held in chunks(b.column("text").to_pylist()):
                    s = WordStream([encode(t) for t in held])
                    keep[[at + hit[0] for hit in shared.value.search(s.hashes, s.offsets)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
