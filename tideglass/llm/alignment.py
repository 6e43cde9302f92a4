"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often in the corpus.

Tokenizer A is a byte-level file of the tokenizers library and gets a blank before the text, B is a sentencepiece
model that adds one itself. The byte ends of both token rows are running sums; ends that both have (``intersect1d``)
cut the text into groups, ``searchsorted`` gives each token its group and each A token the first and last B token
that its bytes overlap, and the ranges are expanded to links by ``repeat``.

A blank that stands between characters which are not white space parts both tokenizers' work: no token of A spans it, and
none of B if no piece has a blank behind another character, which is checked when the model is read; without that a text is
taken whole. Parts between such blanks are therefore encoded and aligned once per task and put together per document.
A task keeps at most ``_KEPT_CHARS`` characters of parts.

A pair's count, the number of documents that hold it linked, is summed in two stages: per pair and salt, where the salt is a number
of the task, then per pair. Documents get the counts of their pairs by a join: the ``HOT`` most frequent pairs are broadcast,
the others, if there are any, are joined by a shuffle, and of these none can hold more than one in ``HOT`` of all links.

Defined cases: texts that are null or empty, or whose joined tokens differ from the blank and the text in A or B, have no tokens:
zeros and no groups; repeated rows, also of one id, are documents each; a null id is kept; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise
from .words import chunks, slices

SALTS = 16
HOT = 1 << 20
_KEPT_CHARS = 8_000_000
_PART_CHARS = 1 << 16
_SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_BESIDE = re.compile(r"[\s\u180e]{2}")
_APART = re.compile(r"(?<=[^\s\u180e])(?= [\s\u180e]*[^\s\u180e])")


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of byte-level entries: printable bytes stand for themselves, the others, in order, for U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def align(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two rows of token lengths with one sum: (common ends, group of each A token, group of each B token, and of each
    link the A token and the B token)."""
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    first, last = np.searchsorted(end_b, end_a - len_a, "right"), np.searchsorted(end_b - len_b, end_a, "left")
    n = last - first
    a = np.repeat(np.arange(len(len_a)), n)
    b = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return cuts, np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b), a, b


class Aligner:
    """Both tokenizers, and what was seen of parts: counts, groups as text, linked pairs."""

    def __init__(self, a_file: str, b_file: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self._a, self._b = Tokenizer.from_file(a_file), SentencePieceProcessor(model_file=b_file)
        self._a.encode_special_tokens = True
        alphabet, vocab = byte_alphabet(), self._a.get_vocab()
        self._bytes_a = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self._bytes_a[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        pieces = [self._b.id_to_piece(i) for i in range(self._b.vocab_size())]
        self._bytes_b = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self._parted = not any(re.search("[^▁]▁", p) for p in pieces)
        self._len_a, self._len_b = (np.array(list(map(len, x)), np.int64) for x in (self._bytes_a, self._bytes_b))
        self.span = len(pieces)
        self._forget()

    def _forget(self) -> None:
        self._seen: dict[str, int] = {}
        self._chars = 0
        self._groups: list[str] = []
        self._counts, self._ends, self._links = np.zeros((0, 4), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def parts(self, text: str) -> list[str]:
        """The text cut at blanks that part tokens, each part without the blank before it."""
        if not self._parted:
            return [text]
        if _BESIDE.search(text) or text[0].isspace() or text[-1].isspace():
            return [p[1:] for p in _APART.split(" " + text)]
        return text.split(" ")

    def _encoded(self, part: str) -> tuple[list[int], list[int]] | None:
        """Ids of A and B; None unless both join to the blank and the part."""
        want = b" " + part.encode("utf-8", "replace")
        a, b = self._a.encode_batch_fast([" " + part], add_special_tokens=False)[0].ids, self._b.encode(part)
        same = b"".join(map(self._bytes_a.__getitem__, a)) == want and b"".join(map(self._bytes_b.__getitem__, b)) == want
        return (a, b) if same else None

    def _stream(self, parts: list[str], ids: tuple[list[int], list[int]]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(counts, groups as text) of each part and the linked pairs of all in order, from the ids of the parts in a row."""
        a, b = (np.array(x, np.int64) for x in ids)
        len_a, len_b = self._len_a[a], self._len_b[b]
        cuts, group_a, group_b, link_a, link_b = align(len_a, len_b)
        ends = np.cumsum([len(p.encode("utf-8", "replace")) + 1 for p in parts])
        stop_a, stop_b, stop_g = (np.searchsorted(x, ends, "right") for x in (np.cumsum(len_a), np.cumsum(len_b), cuts))
        stop_l = np.searchsorted(link_a, stop_a)
        counts = np.diff(np.stack((stop_a, stop_b, stop_g, stop_l), 1), axis=0, prepend=0)
        n_a, n_b = (np.bincount(g, minlength=len(cuts)) for g in (group_a, group_b))
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        said = [f"{x}|{y}" for x, y in zip(a[first_a].tolist(), b[first_b].tolist(), strict=True)]  # right where a group has one of each
        for g in np.flatnonzero((n_a > 1) | (n_b > 1)).tolist():
            i, k = first_a[g], first_b[g]
            said[g] = f"{','.join(map(str, ids[0][i : i + n_a[g]]))}|{','.join(map(str, ids[1][k : k + n_b[g]]))}"
        stops = [0, *stop_g.tolist()]
        return counts, [said[i] if j == i + 1 else ";".join(said[i:j]) for i, j in zip(stops[:-1], stops[1:], strict=True)], a[link_a] * self.span + b[link_b]

    def _learn(self, new: list[str]) -> None:
        runs: list[list[str]] = [[]]
        alone, chars = [], 0
        for p in new:
            if not p or p[-1].isspace() or p[-1] == "\u180e" or not self._parted:
                alone.append(p)
                continue
            runs[-1].append(p)
            chars += len(p) + 1
            if chars > _PART_CHARS:
                runs.append([])
                chars = 0
        done = []
        for run in filter(None, runs):
            ids = self._encoded(" ".join(run))
            if ids is None:  # some part differs: each is told by itself
                alone += run
            else:
                done.append((run, *self._stream(run, ids)))
        for p in alone:
            ids = self._encoded(p)
            done.append(([p], *self._stream([p], ids)) if ids else ([p], np.full((1, 4), -1), [""], np.zeros(0, np.int64)))
        for run, _, said, _ in done:
            self._seen.update(zip(run, range(len(self._groups), len(self._groups) + len(run)), strict=True))
            self._groups += said
            self._chars += sum(map(len, run)) + sum(map(len, said))
        counts = [c for _, c, _, _ in done]
        self._counts = np.concatenate((self._counts, *counts))
        self._links = np.concatenate((self._links, *(x for *_, x in done)))
        self._ends = np.concatenate(([0], np.cumsum(np.maximum(self._counts[:, 3], 0))))

    def documents(self, texts: Sequence[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(counts, groups as text) of each text; and of each text's distinct linked pairs the text, the pair as a * span + b
        and how often, by text and pair."""
        cut = [self.parts(t) if t else [] for t in texts]
        if self._chars > _KEPT_CHARS:
            self._forget()
        flat = list(chain.from_iterable(cut))
        numbers = list(map(self._seen.get, flat))
        new = [i for i, x in enumerate(numbers) if x is None]
        if new:
            self._learn(list(dict.fromkeys(map(flat.__getitem__, new))))
            for i in new:
                numbers[i] = self._seen[flat[i]]
        ends = np.cumsum([0, *map(len, cut)])
        at, doc = np.array(numbers, np.int64), np.repeat(np.arange(len(cut)), np.diff(ends))
        bad = np.zeros(len(cut), bool)
        bad[doc[self._counts[at, 0] < 0]] = True
        said, bounds = list(map(self._groups.__getitem__, numbers)), ends.tolist()
        groups = ["" if wrong else ";".join(said[i:j]) for i, j, wrong in zip(bounds[:-1], bounds[1:], bad.tolist(), strict=True)]
        at, doc = at[~bad[doc]], doc[~bad[doc]]
        counts = np.diff(np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(self._counts[at], axis=0)))[np.searchsorted(doc, np.arange(len(cut) + 1))], axis=0)
        n = self._counts[at, 3]
        pair = self._links[np.repeat(self._ends[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        keys = [np.repeat(doc, n) * (len(self._bytes_a) * self.span) + pair]
        for i in np.flatnonzero(bad).tolist():  # a part that differs may still be made good by its neighbours
            ids = self._encoded(texts[i])
            if ids:
                own, [groups[i]], pair = self._stream([texts[i]], ids)
                counts[i] = own[0]
                keys.append(i * (len(self._bytes_a) * self.span) + pair)
        key, times = np.unique(np.concatenate(keys), return_counts=True)
        return counts, groups, key // (len(self._bytes_a) * self.span), key % (len(self._bytes_a) * self.span), times


def alignments(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Per row of ``docs``: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2``, empty without tokens),
    pairs (the distinct linked ids, A's in the high 32 bits) and times (links of each pair)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, row = Aligner(a_file, b_file), TaskContext.get().partitionId() << 40
        for b in slices(batches):
            ids = b.column("doc_id")
            for at, held in chunks(b.column("text").to_pylist()):
                counts, groups, doc, pair, times = aligner.documents(held)
                ends = pa.array(np.searchsorted(doc, np.arange(len(held) + 1)).astype(np.int32))
                pairs = pa.ListArray.from_arrays(ends, pa.array(pair // aligner.span << 32 | pair % aligner.span))
                often = pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))
                numbers = pa.array(np.arange(row, row + len(held)))
                row += len(held)
                yield pa.RecordBatch.from_arrays([numbers, ids.slice(at, len(held)), *(pa.array(np.ascontiguousarray(c)) for c in counts.T), pa.array(groups, pa.string()), pairs, often], [x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n_docs, is_best: the documents that hold each pair linked, and whether that is the most of its A id."""
    each = aligned.select(F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"), F.explode("pairs").alias("pair"))
    summed = each.groupBy("pair", "salt").agg(F.count(F.lit(1)).alias("n")).groupBy("pair").agg(F.sum("n").alias("n_docs"))
    most = F.max("n_docs").over(Window.partitionBy(F.shiftright("pair", 32)))  # at most as many rows as B has ids
    return summed.withColumn("is_best", F.col("n_docs") == most)


def _hottest(counts: DataFrame, most: int) -> int:
    """The least count above which at most ``most`` pairs lie; 0 if all pairs do."""
    lengths = counts.groupBy("n_docs").agg(F.count(F.lit(1)).alias("n"))
    running = lengths.select("n_docs", F.sum("n").over(Window.orderBy(F.desc("n_docs"))).alias("up_to"))
    above = running.filter(F.col("up_to") > most).agg(F.max("n_docs").alias("at")).first()["at"]
    return int(above or 0)


def with_counts(aligned: DataFrame, *, hot: int = HOT) -> DataFrame:
    """The columns of ``aligned`` but pairs and times, with n_best (links whose pair is the most frequent of its A id) and count_sum
    (the counts of all links). ``aligned`` should be a written table, as it is read two or three times."""
    counts = materialise(pair_counts(aligned), "pair-counts")
    least = _hottest(counts, hot)
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    links = aligned.select(*kept, F.explode_outer(F.arrays_zip("pairs", "times")).alias("_link")).select(*kept, F.col("_link.pairs").alias("pair"), F.col("_link.times").alias("times"))
    known = links.join(F.broadcast(counts.filter(F.col("n_docs") > least)), "pair", "left")
    if least:
        found = known.filter("pair IS NULL OR n_docs IS NOT NULL")
        rare = links.join(F.broadcast(counts.filter(F.col("n_docs") > least).select("pair")), "pair", "left_anti").filter("pair IS NOT NULL")
        known = found.unionByName(rare.join(counts.filter(F.col("n_docs") <= least).hint("shuffle_merge"), "pair"))
    best = F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0))
    told = known.groupBy(*kept).agg(best.alias("n_best"), F.coalesce(F.sum(F.col("times") * F.col("n_docs")), F.lit(0)).alias("count_sum"))
    return told.select(*kept, F.col("n_best").cast("long"), F.col("count_sum").cast("long"))
