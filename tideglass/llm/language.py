"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, its letters stay, every run of other characters counts as one blank, and a blank stands
before and behind it. Its n-grams of 1 to 4 such characters are hashed into ``2 ** BITS`` slots. Training counts
slots per language over all rows given to it: each task adds up its rows, Spark adds up the tasks, and the driver
gets one count per language and slot, of at most ``MOST_LANGUAGES`` languages, which is checked. The logarithms
of the smoothed shares, a matrix of at most 64 MB, are broadcast; a batch of texts is a sparse matrix of slot
counts that is multiplied with it in numpy.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and nothing is learned from it or from
a null language; without anything learned every text is ``und``; the empty string is a language like others; equal
scores go to the language that sorts first; repeated rows count and are scored each; a null id is hashed as the empty
text; an empty table gives an empty result; other columns of the input are ignored by ``train`` and kept by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialise
from .training import remainder
from .words import chunks, mix, slices

BITS, LONGEST = 16, 4
SMOOTHING = 0.1
FOLDS, HELD_OUT = 4, 2
MOST_LANGUAGES = 256
UNDETERMINED = "und"
_BLOCK = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Of each code point whether it is a letter; made once per process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def slot_counts(texts: Sequence[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, count) of the n-grams, by text, and per text whether it has a letter. A slot may come twice in a long text."""
    held = [f" {(t or '').lower()} " for t in texts]
    code = np.frombuffer("".join(held).encode("utf-32-le", "replace"), "<u4")
    ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)))
    keep = _letters()[code]
    code = np.where(keep, code, 32).astype(np.uint64)
    lettered = np.add.reduceat(keep, np.concatenate(([0], ends[:-1]))) > 0 if len(ends) else np.zeros(0, bool)
    keep[1:] |= keep[:-1]
    keep[np.concatenate(([0], ends[:-1]))[: len(ends)]] = True
    code, ends = code[keep], np.cumsum(keep)[ends - 1] if len(ends) else ends
    doc_of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    out = [(np.zeros(0, np.int64),) * 3]
    for at in range(0, len(code), _BLOCK):
        doc = doc_of[at : at + _BLOCK]
        room = ends[doc] - np.arange(at, at + len(doc))
        part = np.concatenate((code[at : at + _BLOCK + LONGEST - 1], np.zeros(LONGEST, np.uint64)))
        h, keys = np.zeros(len(doc), np.uint64), []
        for n in range(1, LONGEST + 1):
            h = (h + part[n - 1 : n - 1 + len(doc)] + np.uint64(n)) * _STEP
            fits = np.flatnonzero((room >= n) & lettered[doc])
            keys.append(doc[fits] << bits | (mix(h[fits]) >> np.uint64(64 - bits)).astype(np.int64))
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        out.append((key >> bits, key & ((1 << bits) - 1), count))
    return *map(np.concatenate, zip(*out, strict=True)), lettered


@dataclass(frozen=True)
class LanguageModel:
    """languages, ascending; log_prior of each; log_share[slot, language]."""

    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_share: np.ndarray
    bits: int = BITS

    def predict(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language or -1, its posterior probability) of each text."""
        best, p = np.full(len(texts), -1), np.zeros(len(texts))
        if not self.languages:
            return best, p
        for at, held in chunks(texts):
            text, slot, count, lettered = slot_counts(held, self.bits)
            which = np.flatnonzero(lettered)
            if not len(which):
                continue
            total = np.repeat(self.log_prior[None, :], len(which), axis=0)
            first = np.searchsorted(text, which)
            for lo in range(0, len(text), _BLOCK):  # sparse counts times the dense matrix, by rows
                hi = min(len(text), lo + _BLOCK)
                a, b = np.searchsorted(first, lo, "right") - 1, np.searchsorted(first, hi, "left")
                weighed = self.log_share[slot[lo:hi]].astype(np.float64) * count[lo:hi, None]
                total[a:b] += np.add.reduceat(weighed, np.maximum(first[a:b] - lo, 0), axis=0)
            top = total.max(1)
            best[at + which] = total.argmax(1)
            p[at + which] = 1 / np.exp(total - top[:, None]).sum(1)
        return best, p


def train(docs: DataFrame, *, bits: int = BITS, smoothing: float = SMOOTHING) -> LanguageModel:
    """A model of column ``lang`` from all rows of ``docs`` that have one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        sums, rows = np.zeros((0, 1 << bits), np.int64), np.zeros(0, np.int64)
        for b in slices(batches):
            langs = np.array([number.setdefault(x, len(number)) for x in b.column("lang").to_pylist()], np.int64)
            if len(number) > MOST_LANGUAGES:
                raise ValueError(f"more than {MOST_LANGUAGES} languages")
            if len(number) > len(rows):
                sums = np.concatenate((sums, np.zeros((len(number) - len(rows), 1 << bits), np.int64)))
                rows = np.concatenate((rows, np.zeros(len(number) - len(rows), np.int64)))
            for at, held in chunks(b.column("text").to_pylist()):
                text, slot, n, lettered = slot_counts(held, bits)
                of = langs[at : at + len(held)]
                np.add.at(sums, (of[text], slot), n)
                np.add.at(rows, of[lettered], 1)
        for name, i in number.items():
            slot = np.flatnonzero(sums[i])
            n = np.concatenate((rows[i : i + 1], sums[i][slot]))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(np.concatenate(([-1], slot)).astype(np.int32)), pa.array(n)], ["lang", "slot", "n"])

    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    sums = materialise(rows.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")), "language-counts")
    seen = sums.filter("slot = -1 AND n > 0").select("lang", F.col("n").alias("_rows"))
    if seen.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    priors = dict(sorted((r["lang"], r["_rows"]) for r in seen.collect()))
    names = tuple(priors)
    got = sums.filter("slot >= 0").toArrow()
    table = np.zeros((1 << bits, len(names)))
    if names:
        encoded = got.column("lang").combine_chunks().dictionary_encode()
        place = {x: i for i, x in enumerate(names)}
        of = np.array([place[x] for x in encoded.dictionary.to_pylist()], np.int64)[encoded.indices.to_numpy()]
        table[got.column("slot").to_numpy(), of] = got.column("n").to_numpy()
    table += smoothing
    rows_of = np.array(list(priors.values()), float)
    return LanguageModel(names, np.log(rows_of / rows_of.sum()) if names else rows_of, np.log(table / table.sum(0)).astype(np.float32), bits)


def score(docs: DataFrame, model: LanguageModel, *, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs``, the language and its probability; names that ``docs`` has already are an error."""
    clash = {c.lower() for c in out} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"docs has columns {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*shared.value.languages, UNDETERMINED], pa.string())
        for b in slices(batches):
            best, p = shared.value.predict(b.column("text").to_pylist())
            said = names.take(pa.array(np.where(best < 0, len(names) - 1, best)))
            yield pa.RecordBatch.from_arrays([*b.columns, said, pa.array(p)], [*b.schema.names, *out])

    schema = T.StructType([*docs.schema.fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, *, held_out: Column | None = None) -> DataFrame:
    """doc_id, text, held_out, lang_pred, score; the model learns from the rows that are not held out."""
    aside = remainder("doc_id", FOLDS) == HELD_OUT if held_out is None else held_out
    model = train(docs.filter(~aside))
    return score(docs.select("doc_id", "text", aside.alias("held_out")), model)
