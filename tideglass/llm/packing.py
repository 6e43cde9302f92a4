"""Packing of documents into token sequences by Karmarkar-Karp multiway differencing.

A document's ids, its end id included, are cut into full windows and a remainder
in a few uneven pieces. Pieces of less than a 256th of a window are put together, in order, to at least that.
The pieces of a group of documents are then dealt to windows: each starts as a partial partition that
holds one piece; the two partitions of largest imbalance are merged so that the heavy windows of one
meet the light windows of the other, until one partition is left. If its heaviest window exceeds the
capacity the window count rises by one and the differencing runs again.

A group is what one task reads in a row up to about ``group`` ids or ``GROUP_DOCS`` documents, so no shuffle is
needed, a task holds one group at a time, and a retried task makes the same sequences. A group has at most
256 pieces a window, and a partition's sums are kept only from its first merge on. Each group pads at most
about a window.

Defined cases: null and empty texts have the end id alone; rows with a null id are packed; repeated rows
are packed each; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import slices

if TYPE_CHECKING:
    from tokenizers import Tokenizer

WINDOW = 2048
#: A remainder is cut so that small parts level what large ones leave uneven.
SHARES = (0.9, 0.07, 0.03)
GROUP = 1_000_000
GROUP_DOCS = 250_000
END_ID = 1
_CACHE = 600_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size, by multiway differencing; windows are near equal.

    A partial partition has a number: its place by size if it holds one piece, then counting on. Its sums go
    from heaviest to lightest, less the lightest, so that the first is its imbalance.
    """
    order = np.argsort(-sizes, kind="stable")
    kind, small = np.int32 if sizes.sum() < 2**31 else np.int64, np.uint16 if windows <= 2**16 else np.uint32
    heap = [(-int(s), i) for i, s in enumerate(sizes[order])]
    merged: dict[int, np.ndarray] = {}
    tree: list[tuple[int, int, np.ndarray]] = []

    def sums_of(number: int) -> np.ndarray:
        if number >= len(order):
            return merged.pop(number)
        one = np.zeros(windows, kind)
        one[0] = sizes[order[number]]
        return one

    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        sums = sums_of(a) + sums_of(b)[::-1]
        rank = np.argsort(-sums, kind="stable")
        number = len(order) + len(tree)
        tree.append((a, b, rank.astype(small)))
        sums = sums[rank]
        merged[number] = sums - sums[-1]
        heapq.heappush(heap, (-int(merged[number][0]), number))
    out = np.zeros(len(order), np.int64)
    todo = [(heap[0][1], np.arange(windows))]
    while todo:
        number, label = todo.pop()
        if number < len(order):
            out[order[number]] = label[0]
            continue
        a, b, rank = tree[number - len(order)]
        place = np.empty(windows, np.int64)
        place[rank] = label
        todo += [(a, place), (b, place[::-1])]
    return out


def fill(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(window of each size, number of windows); the count rises until no window exceeds the capacity."""
    if not len(sizes):
        return np.zeros(0, np.int64), 0
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        where = differencing(sizes, windows) if windows > 1 else np.zeros(len(sizes), np.int64)
        if np.bincount(where, weights=sizes, minlength=windows).max() <= capacity:
            return where, windows
        windows += 1


#: str.split also cuts at these four; the tokenizer does not.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")
#: Where a letter may join a mark, or a special token may stand, capitals are left to the tokenizer.
_AS_WRITTEN = re.compile("[\u0300-\u036f]|<\\|")
_MARKS = ".,;:!?*&%$#|()"


#: Words of ASCII and other letters, some long, by which the two ways of a tokenizer are compared.
_PROBE = "the a ing question abcdefghijklmnopqrstuvwxyz élève ßtraße ñandú день 中文 zzzzzzzzzzzzzzzzzzzz"


def _ends_in_letter(core: str) -> bool:
    """Whether the tokenizer's form of ``core`` does. A few letters become a letter and a combining mark, which joins signs behind it."""
    return core.isascii() or unicodedata.normalize("NFC", core).lower()[-1].isalpha()


class Encoder:
    """Ids of a lower-casing tokenizers file whose pre-tokenizer takes runs of letters, and of other signs, apart
    and drops white space. Parts between white space are looked up where they were seen before; new runs of
    letters are encoded many at a time and told apart by the ids that end words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence as Normalizers
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit
        from tokenizers.pre_tokenizers import Sequence as PreTokenizers

        self._tokenizer, self._seen = Tokenizer.from_file(path), {}
        #: the same for words of letters that are as the normaliser would have them, which it need not go through
        self._plain = Tokenizer.from_file(path)
        self._plain.normalizer, self._plain.pre_tokenizer = Normalizers([]), PreTokenizers([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        if self._ids(self._plain, _PROBE) != self._ids(self._tokenizer, _PROBE):
            self._plain = self._tokenizer
        vocab = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocab.values()) + 1, bool)
        self._ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True

    @staticmethod
    def _ids(tokenizer: Tokenizer, text: str) -> list[int]:
        return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    @staticmethod
    def _parts(text: str | None) -> list[str]:
        if not text:
            return []
        if text.isascii():
            text = text if "<|" in text else text.lower()
        elif not _AS_WRITTEN.search(text):
            text = text.encode("utf-8", "replace").lower().decode()
        if any(c in text for c in _ODD_SPACE):
            return _SPACE.split(text.strip(" \t\n\r\x0b\x0c"))
        return text.split()

    def _learn(self, new: set[str]) -> None:
        seen = self._seen
        rest = [w for w in new if not w.isalpha()]
        letters, others, joined = new.difference(rest), set(), []
        for w, core in zip(rest, [w.rstrip(_MARKS) for w in rest], strict=True):
            if core.isalpha() and len(core) < len(w) and _ends_in_letter(core):
                joined.append((w, core, w[len(core) :]))
            else:
                others.add(w)
        letters.update([core for _, core, _ in joined])
        others.update([mark for _, _, mark in joined])
        todo = [w for w in letters if w not in seen]
        if self._plain is not self._tokenizer:
            kept = [w for w in todo if w == w.lower() and (w.isascii() or unicodedata.is_normalized("NFC", w))]
            others.update(set(todo).difference(kept) if len(kept) < len(todo) else ())
            todo = kept
        for at in range(0, len(todo), 4096):
            part = todo[at : at + 4096]
            ids = np.array(self._ids(self._plain, " ".join(part)), "<u4")
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) == len(part):
                raw, at_byte = ids.tobytes(), (ends * 4).tolist()
                seen.update(zip(part, map(raw.__getitem__, map(slice, [0, *at_byte[:-1]], at_byte)), strict=True))
            else:
                others.update(part)
        rest = [w for w in others if w not in seen]
        for w, e in zip(rest, self._tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            seen[w] = np.array(e.ids, "<u4").tobytes()
        for w, core, mark in joined:
            seen[w] = seen[core] + seen[mark]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self._parts(t) for t in texts]
        flat = list(chain.from_iterable(split))
        found = list(map(self._seen.get, flat))
        new = [i for i, ids in enumerate(found) if ids is None]
        words = set(map(flat.__getitem__, new))
        if len(self._seen) + len(words) > _CACHE:
            self._seen, new, words = {}, range(len(flat)), set(flat)
        if words:
            self._learn(words)
            for i in new:
                found[i] = self._seen[flat[i]]
        ends, end = [0, *accumulate(map(len, split))], np.array([END_ID], "<u4").tobytes()
        return [np.frombuffer(b"".join(found[a:b]) + end, "<u4") for a, b in pairwise(ends)]


def pieces(lengths: np.ndarray, window: int, shares: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length): the full windows of all documents, then their remainders' parts in the given shares."""
    n = lengths // window
    doc = np.repeat(np.arange(len(lengths)), n)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * window
    rest = (lengths - n * window)[:, None]
    edges = (n * window)[:, None] + np.hstack(((rest * np.concatenate(([0.0], np.cumsum(shares[:-1])))).astype(np.int64), rest))
    part = np.diff(edges, axis=1)
    d, k = np.nonzero(part)
    return np.concatenate((doc, d)), np.concatenate((start, edges[d, k])), np.concatenate((np.full(len(doc), window), part[d, k]))


def _dealt(sizes: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """The window of each piece that is shorter than one; pieces of under a 256th of it go together."""
    least = max(1, window // 256)
    short = sizes < least
    item = np.empty(len(sizes), np.int64)
    item[~short] = np.arange((~short).sum())
    run = (np.cumsum(sizes[short]) - sizes[short]) // least
    item[short] = np.unique(run, return_inverse=True)[1] + (~short).sum()
    where, windows = fill(np.bincount(item, weights=sizes).astype(np.int64), window)
    return where[item], windows


def _packed(docs: list[int | None], held: list[np.ndarray], first: int, window: int, shares: tuple[float, ...]) -> tuple[pa.RecordBatch, int]:
    lengths = np.fromiter(map(len, held), np.int64, len(held))
    doc, start, size = pieces(lengths, window, shares)
    full = size == window
    where = np.empty(len(size), np.int64)
    where[full] = np.arange(full.sum())
    where[~full] = _dealt(size[~full], window)[0] + full.sum()
    order = np.argsort(where, kind="stable")
    doc, start, size, where = doc[order], start[order], size[order], where[order]
    before = np.cumsum(size) - size
    head = np.concatenate(([True], np.diff(where) > 0))
    offset = before - np.maximum.accumulate(np.where(head, before, 0))
    sequence = np.cumsum(head) - 1
    from_ = (np.cumsum(lengths) - lengths)[doc] + start
    ids = np.concatenate(held)[np.repeat(from_ - before, size) + np.arange(int(lengths.sum()))].astype("<u4")
    ends = np.concatenate((before, [lengths.sum()])) * 4
    binary = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
    arrays = [pa.array(docs, pa.int64()).take(pa.array(doc)), *(pa.array(x.astype(np.int64)) for x in (start, size)), binary, *(pa.array(x.astype(np.int64)) for x in (lengths[doc], sequence + first, offset))]
    return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SCHEMA.split(", ")]), first + int(sequence[-1]) + 1


def pack(docs: DataFrame, tokenizer: str, *, window: int = WINDOW, shares: tuple[float, ...] = SHARES, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id and offset in it. ``tokenizer`` is a file of the tokenizers library whose ids do not
    depend on white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, first, owners, held, tokens = Encoder(tokenizer), TaskContext.get().partitionId() << 40, [], [], 0
        for b in slices(batches):
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            for at in range(0, len(ids), 256):
                for doc, row in zip(ids[at : at + 256], encoder.encode(texts.slice(at, 256).to_pylist()), strict=True):
                    owners.append(doc)
                    held.append(row)
                    tokens += len(row)
                    if tokens >= group or len(held) >= GROUP_DOCS:
                        out, first = _packed(owners, held, first, window, shares)
                        yield out
                        owners, held, tokens = [], [], 0
        if held:
            yield _packed(owners, held, first, window, shares)[0]

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
