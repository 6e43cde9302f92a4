"""Toxicity by a classifier chain of linear models.

The categories are predicted in order. Each is a logistic regression over hashed words
and word beginnings; from the second on, the earlier categories' probabilities are further inputs. While
fitting, those inputs are out-of-fold predictions: each row's come from a model that did not see it,
so later models learn how far earlier ones can be trusted on new texts. The fits of one category, on all rows and on
those outside each fold, do not need each other and run as tasks of their own.

Defined cases: null and empty texts get the probability of the biases alone; without usable labels all
probabilities are 0.5; repeated rows are scored each; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialise
from .linear import FeatureSpec, FtrlModel, features, fit_ftrl
from .training import fit_each, hashed, labelled_sample
from .words import slices

SPEC = FeatureSpec((("word", 1), ("root", 1)))
#: steps and sparsity suited to few telling words among very many
FTRL = {"alpha": 1.0, "l1": 2.0}
SAMPLE = 12_000
FOLDS = 3


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: tuple[FtrlModel, ...]

    def predict(self, idx: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One column of probabilities per category."""
        done = np.zeros((len(offsets) - 1, 0))
        for m in self.models:
            done = np.column_stack((done, m.predict(idx, offsets, _inputs(done))))
        return done


def _inputs(probabilities: np.ndarray) -> np.ndarray | None:
    """Earlier probabilities as centred inputs."""
    return probabilities - 0.5 if probabilities.shape[1] else None


def fold_of(count: int, folds: int = FOLDS) -> np.ndarray:
    """The fold of each of ``count`` rows, near equal and in a fixed random order."""
    return np.random.default_rng(5).permutation(count) % folds


def _fit(number: int, rows: list[np.ndarray], y: np.ndarray, earlier: np.ndarray, bits: int, folds: int) -> tuple[FtrlModel, np.ndarray]:
    """Fit ``number`` of a category: on all rows (0), or on those outside fold number - 1 with predictions for those in it."""
    dense, fold = _inputs(earlier), fold_of(len(rows), folds)
    seen = np.flatnonzero(fold != number - 1)
    model = fit_ftrl([rows[i] for i in seen], y[seen], bits, extra=None if dense is None else dense[seen], **FTRL)
    out = np.flatnonzero(fold == number - 1)
    idx = np.concatenate([np.zeros(0, np.int64), *(rows[i] for i in out)]).astype(np.int64)
    sizes = np.concatenate(([0], np.cumsum([len(rows[i]) for i in out], dtype=np.int64)))
    return model, model.predict(idx, sizes, None if dense is None else dense[out]) if len(out) else np.zeros(0)


def fit_chain(rows: DataFrame, categories: Sequence[str], bits: int, folds: int = FOLDS) -> Chain | None:
    """``rows``: doc_id, the categories and _f, a bounded sample; the out-of-fold predictions, a number per row and
    category, pass the driver."""
    earlier, models = None, []
    for c in categories:
        known = earlier

        def fit(number: int, x: list[np.ndarray], y: pd.DataFrame, c: str = c, known: np.ndarray | None = known) -> tuple[FtrlModel, np.ndarray]:
            return _fit(number, x, y[c].to_numpy(float), np.zeros((len(x), 0)) if known is None else known, bits, folds)

        fitted = fit_each(rows, 1 if c == categories[-1] else 1 + folds, fit)
        if not fitted:
            return None
        models.append(fitted[0][0])
        if c != categories[-1]:
            held = np.concatenate([f[1] for f in fitted[1:]])
            order = np.argsort(fold_of(len(held), folds), kind="stable")  # rows by fold, as the parts come
            column = np.empty(len(held))
            column[order] = held
            earlier = column[:, None] if earlier is None else np.column_stack((earlier, column))
    return Chain(tuple(categories), tuple(models))


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], *, sample: int = SAMPLE, spec: FeatureSpec = SPEC) -> Chain | None:
    """A chain over the 0/1 columns ``categories`` of ``labels``, from at most ``sample`` labelled rows."""
    rows = labelled_sample(docs, labels, list(categories), F.lit(True), sample)
    return fit_chain(materialise(hashed(rows, list(categories), spec), "features"), categories, spec.bits)


def score(docs: DataFrame, chain: Chain | None, categories: Sequence[str], *, spec: FeatureSpec = SPEC) -> DataFrame:
    """doc_id, text and p_<category> for each category."""
    names = [f"p_{c}" for c in categories]
    base = docs.select("doc_id", "text")
    if chain is None:
        return base.select("*", *(F.lit(0.5).alias(n) for n in names))
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = shared.value.predict(*features(b.column("text").to_pylist(), spec))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, j]) for j in range(len(names)))], [*b.schema.names, *names])

    schema = T.StructType([*base.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    return base.mapInArrow(run, schema)


def detect(docs: DataFrame, labels: DataFrame, *, categories: Sequence[str] = ("low_quality", "toxic"), threshold: float = 0.25, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, p_<category>, is_toxic: the last category of the chain at ``threshold``."""
    chain = train(docs, labels, categories, sample=sample)
    scored = score(docs, chain, categories)
    return scored.withColumn("is_toxic", (F.col(f"p_{categories[-1]}") >= threshold).cast("int"))
