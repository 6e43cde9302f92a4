"""Subword lattice likelihood of texts under a unigram model over an existing vocabulary.

The pieces are those of a public sentencepiece file. Their scores there are merge ranks; rank r gives
the prior weight 1 / (r + 10). Expectation-maximisation over the training documents' words turns it
into piece probabilities: each word, written with its leading mark, is a lattice of all segmentations,
and a forward and a backward recursion in log space give each piece's expected count. Every character
can also be spelled by byte pieces, so no text is impossible. The probability of a text is the product
of its words' marginal probabilities, each the forward recursion's last value, and of the end event.

Pieces never cross a word's leading mark, so a word's likelihood is the same in all texts: words are
counted once over the corpus, the lattice runs once per distinct word, and texts are scored by adding
up. The most frequent words, ``head`` at most, are broadcast; all other words are joined.

Tokens are runs of bytes other than white space of the text with A-Z lower-cased, then one end.

Defined cases: null and empty texts have the end token alone; ids that are null hash as the empty
text; repeated rows are scored each; without training documents the prior stands; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .training import remainder
from .words import _powers, mix, slices

MARK = "▁"
HEAD = 200_000
EM_ROUNDS = 2
PRIOR_MASS = 2000.0
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_FILTER_BITS = 20
_FEW = 8


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


class Lattice:
    """Piece lookups for many words at once; ``logp`` has one entry per piece."""

    def __init__(self, pieces: list[str], byte_ids: np.ndarray, logp: np.ndarray):
        self.byte_ids, self.logp = byte_ids, logp
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[tuple[int, str]]] = {}
        for i, p in enumerate(pieces):
            if p:
                by_length.setdefault(len(p), []).append((i, p))
        for length, rows in by_length.items():
            h = self._hash(np.frombuffer("".join(p for _, p in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), length), length)[:, 0]
            order = np.argsort(h)
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[h >> np.uint64(64 - _FILTER_BITS)] = True
            self.tables[length] = (h[order], np.array([i for i, _ in rows])[order], seen)

    @staticmethod
    def _hash(points: np.ndarray, length: int) -> np.ndarray:
        rows, n = points.shape
        value = mix(points.astype(np.uint64) + np.uint64(0x51ED2701)) * _powers(_STEP, n)
        total = np.concatenate((np.zeros((rows, 1), np.uint64), np.cumsum(value, axis=1, dtype=np.uint64)), axis=1)
        return mix((total[:, length:] - total[:, : n - length + 1]) * _powers(_BACK, n - length + 1))

    def _edges(self, points: np.ndarray) -> dict[int, np.ndarray]:
        """By length, the piece that starts at each place of each word, or -1."""
        out = {}
        for length, (keys, ids, seen) in self.tables.items():
            if length <= points.shape[1]:
                h = self._hash(points, length)
                found = np.full(h.shape, -1, np.int32)
                maybe = seen[h >> np.uint64(64 - _FILTER_BITS)]
                asked = h[maybe]
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                found[maybe] = np.where(keys[at] == asked, ids[at], -1)
                if (found >= 0).any():
                    out[length] = found
        return out

    def _spelled(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Log probability of each character by its bytes; the distinct characters' numbers and byte pieces."""
        distinct, number = np.unique(points, return_inverse=True)
        spelled = [self.byte_ids[list(chr(c).encode("utf-8", "replace"))] for c in distinct]
        return np.array([self.logp[s].sum() for s in spelled])[number].reshape(points.shape), number.reshape(points.shape), spelled

    def run(self, words: list[str], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """(log likelihood of each word, expected piece counts if ``weights`` are given)."""
        out = np.zeros(len(words))
        expected = np.zeros(len(self.logp)) if weights is not None else None
        lens = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lens):
            group = np.flatnonzero(lens == n)
            for at in range(0, len(group), max(1, 200_000 // (int(n) + 1))):
                part = group[at : at + max(1, 200_000 // (int(n) + 1))]
                points = np.frombuffer("".join(MARK + words[i] for i in part).encode("utf-32-le", "replace"), np.uint32).reshape(len(part), n + 1)
                out[part] = self._group(points, None if weights is None else weights[part], expected)
        return out, expected

    def _group(self, points: np.ndarray, weights: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
        rows, n = points.shape
        spelled, number, byte_pieces = self._spelled(points)
        edges = self._edges(points)
        logs = {length: np.where(found >= 0, self.logp[found], -np.inf) for length, found in edges.items()}
        scalar = rows < _FEW  # long words come one by one: numbers are then faster than short arrays
        alpha = np.zeros((n + 1, rows))
        for r in range(rows if scalar else 0):
            alpha[:, r] = _forward(spelled[r], {length: lp[r] for length, lp in logs.items()})
        for j in range(1, 1 if scalar else n + 1):
            ways = [alpha[j - 1] + spelled[:, j - 1]] + [alpha[j - length] + lp[:, j - length] for length, lp in logs.items() if length <= j]
            alpha[j] = _sum_logs(ways)
        if weights is not None:
            beta = np.zeros((n + 1, rows))
            for r in range(rows if scalar else 0):
                beta[:, r] = _forward(spelled[r, ::-1], {length: lp[r, ::-1] for length, lp in logs.items()})[::-1]
            for i in range(-1 if scalar else n - 1, -1, -1):
                ways = [beta[i + 1] + spelled[:, i]] + [beta[i + length] + lp[:, i] for length, lp in logs.items() if i + length <= n]
                beta[i] = _sum_logs(ways)
            whole = alpha[n][:, None]
            for length, found in edges.items():
                at = np.exp(alpha[: n - length + 1].T + logs[length] + beta[length:].T - whole) * weights[:, None]
                hit = found >= 0
                expected += np.bincount(found[hit], at[hit], len(expected))
            at = np.exp(alpha[:n].T + spelled + beta[1:].T - whole) * weights[:, None]
            by_char = np.bincount(number.ravel(), at.ravel(), len(byte_pieces))
            for c, ids in zip(by_char, byte_pieces, strict=True):
                np.add.at(expected, ids, c)
        return alpha[n]


def _forward(spelled: np.ndarray, logs: dict[int, np.ndarray]) -> np.ndarray:
    """The forward recursion over one word: log probability of all segmentations of each beginning."""
    n = len(spelled)
    ends, lengths, values = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 3, *((np.flatnonzero(lp > -np.inf) + length, np.full(int((lp > -np.inf).sum()), length), lp[lp > -np.inf]) for length, lp in logs.items()), strict=True))
    order = np.argsort(ends, kind="stable")
    first = np.searchsorted(ends[order], np.arange(n + 2)).tolist()
    lengths, values, single = lengths[order].astype(int).tolist(), values[order].tolist(), spelled.tolist()
    alpha, exp, log = [0.0] * (n + 1), math.exp, math.log
    for j in range(1, n + 1):
        ways = [alpha[j - 1] + single[j - 1]]
        for e in range(first[j], first[j + 1]):
            ways.append(alpha[j - lengths[e]] + values[e])
        top = max(ways)
        alpha[j] = top + log(sum([exp(w - top) for w in ways])) if len(ways) > 1 else top
    return np.array(alpha)


def _sum_logs(ways: list[np.ndarray]) -> np.ndarray:
    if len(ways) == 1:
        return ways[0]
    stack = np.stack(ways)
    top = stack.max(0)
    return top + np.log(np.exp(stack - top).sum(0))


def vocabulary(path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(pieces, '' for those that take no part; the byte pieces' ids; prior probabilities)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, weight = [""] * sp.get_piece_size(), np.zeros(256, np.int64), np.zeros(sp.get_piece_size())
    for i in range(len(pieces)):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            weight[i] = 1 / (len(pieces) + 10)
        elif not (sp.is_control(i) or sp.is_unknown(i) or MARK in p[1:]):
            pieces[i] = p
            weight[i] = 1 / (10 - sp.get_score(i))
    return pieces, byte_ids, weight / weight.sum()


def _count_words(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    train: Counter[bytes] = Counter()
    rest: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        words = list(train.keys() | rest.keys())
        c = np.array([train[w] for w in words], np.int64)
        n = c + np.array([rest[w] for w in words], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c), pa.array(n)], ["word", "c", "n"])

    for b in slices(batches):
        for text, learn in zip(b.column("text").to_pylist(), b.column("learn").to_pylist(), strict=True):
            (train if learn else rest).update(tokens(text))
            if len(train) + len(rest) > most:
                yield flush()
                train.clear()
                rest.clear()
    yield flush()


def _decoded(batches: Iterator[pa.RecordBatch], rows: int = 40_000) -> Iterator[tuple[pa.Table, list[str]]]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            table = pa.Table.from_batches(held)
            yield table, [w.decode("utf-8") for w in table.column("word").to_pylist()]
            held = []
    if held:
        table = pa.Table.from_batches(held)
        yield table, [w.decode("utf-8") for w in table.column("word").to_pylist()]


def _frequency_class() -> Column:
    """Sixteen classes for each doubling of a word's count."""
    return F.floor(F.log2("n") * 16)


def _head_class(types: DataFrame, head: int) -> int:
    """The least frequency class from which on there are at most ``head`` words; one row per class is collected."""
    at, room = 2**31, head
    for r in types.groupBy(_frequency_class().alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("k")).collect():
        room -= r["n"]
        if room < 0:
            break
        at = r["k"]
    return at


def score(docs: DataFrame, vocabulary_file: str, *, folds: int = 7, held_out: int = 2, head: int = HEAD, rounds: int = EM_ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), one row per row of ``docs``."""
    spark = docs.sparkSession
    base = docs.select("doc_id", "text", (remainder("doc_id", folds) != held_out).alias("learn"))
    counted = base.select("text", "learn").mapInArrow(_count_words, "word binary, c long, n long")
    types = materialise(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "words")
    sums = types.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = base.filter("learn").count()
    train_tokens, distinct = int(sums["c"]) + ends, int(sums["v"]) + (ends > 0)

    pieces, byte_ids, prior = vocabulary(vocabulary_file)
    usable = prior > 0
    p, end = prior, (ends + 1) / (train_tokens + 2)
    shared = spark.sparkContext.broadcast((pieces, byte_ids))

    def logs(p: np.ndarray, end: float) -> np.ndarray:
        return np.log(np.where(usable, p * (1 - end), 1.0))

    for _ in range(rounds if sums["c"] else 0):
        logp = spark.sparkContext.broadcast(logs(p, end))

        def expect(batches: Iterator[pa.RecordBatch], logp=logp) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(*shared.value, logp.value), np.zeros(len(logp.value))
            for table, words in _decoded(batches):
                total += lattice.run(words, table.column("c").to_numpy().astype(float))[1]
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "count"])

        got = types.filter("c > 0").select("word", "c").mapInArrow(expect, "piece long, count double").groupBy("piece").agg(F.sum("count").alias("count")).toArrow()
        counts = np.zeros(len(prior))
        counts[got.column("piece").to_numpy()] = got.column("count").to_numpy()
        p = (counts + PRIOR_MASS * prior) / (counts.sum() + PRIOR_MASS)
        end = (ends + 1) / (counts.sum() + ends + 2)

    final = spark.sparkContext.broadcast(logs(p, end))

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value, final.value)
        for table, words in _decoded(batches):
            values = pa.array(lattice.run(words)[0])
            yield from table.append_column("ll", values).to_batches()

    known = materialise(types.mapInArrow(likelihoods, "word binary, c long, n long, ll double"), "scored-words")
    top = known.filter(_frequency_class() >= _head_class(known, head)).select("word", "c", "ll").toArrow()
    common = spark.sparkContext.broadcast((top.column("word").to_pylist(), top.column("c").to_numpy(), top.column("ll").to_numpy()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, c, ll = common.value
        place, logc = dict(zip(words, range(len(words)), strict=True)).get, np.log10(c + 1.0)
        for b in slices(batches):
            rows, tail_words, tail_counts, sizes = [], [], [], [0]
            for text in b.column("text").to_pylist():
                have = tokens(text)
                at = np.fromiter(map(place, have, repeat(-1)), np.int64, len(have))
                inside = at[at >= 0]
                rest = Counter([have[i] for i in np.flatnonzero(at < 0)])
                rows.append((len(have) + 1, int((c[inside] > 0).sum()), float(logc[inside].sum()), float(ll[inside].sum())))
                tail_words += rest.keys()
                tail_counts += rest.values()
                sizes.append(len(tail_words))
            tail = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(tail_words, pa.binary()), pa.array(tail_counts, pa.int32())], ["word", "k"]))
            cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("learn"), *cols, tail], ["doc_id", "learn", "n_tokens", "known", "logc", "ll", "tail"])

    parts = base.mapInArrow(split, "doc_id long, learn boolean, n_tokens long, known long, logc double, ll double, tail array<struct<word: binary, k: int>>")
    parts = materialise(parts.withColumn("_row", F.monotonically_increasing_id()), "scored-texts")
    rare = parts.select("_row", F.explode("tail").alias("t")).select("_row", F.col("t.word").alias("word"), F.col("t.k").alias("k")).join(known.select("word", "c", F.col("ll").alias("_ll")), "word")
    rare = rare.groupBy("_row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("_logc"), F.sum(F.col("k") * F.col("_ll")).alias("_ll"))
    whole = parts.drop("tail").join(rare, "_row", "left")
    none = F.lit(0.0)
    unit = math.log10(train_tokens + distinct + 1)
    return whole.select(
        "doc_id",
        (~F.col("learn")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("logc") + F.coalesce("_logc", none) + F.lit(math.log10(ends + 1)) - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        ((F.col("ll") + F.coalesce("_ll", none) + F.lit(math.log(end))) / F.lit(math.log(10))).alias("score"),
    )
