"""Quality classifier: hashed word n-gram logistic regression trained by FTRL.

Texts become sets of hashed word 1- and 2-grams, as written and as folded shapes, plus a mark for
words that repeat; nothing but the text is an input. The model is fitted on at most ``sample`` labelled
rows whose id does not fall in the held-out fold and scored as one sparse dot product per text.

Defined cases: null and empty texts get the score of the bias alone; ids that are null are hashed as
the empty text; without usable labels every score is 0.5; repeated rows are scored each; other columns
of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linear import FeatureSpec, FtrlModel, features, fit_ftrl
from .training import fit_each, hashed, labelled_sample, remainder
from .words import slices

SPEC = FeatureSpec((("surface", 1), ("surface", 2), ("shape", 1), ("shape", 2), ("repeat", 2)))
SAMPLE = 12_000
FOLDS = 5
THRESHOLD = 0.3


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = FOLDS, sample: int = SAMPLE, spec: FeatureSpec = SPEC) -> FtrlModel | None:
    """A model of ``label`` from at most ``sample`` labelled rows outside fold 0."""
    rows = labelled_sample(docs, labels, [label], remainder("doc_id", folds) != 0, sample)
    fitted = fit_each(hashed(rows, [label], spec), 1, lambda _, x, y: fit_ftrl(x, y[label].to_numpy(float), spec.bits))
    return fitted[0] if fitted else None


def score(docs: DataFrame, model: FtrlModel | None, *, spec: FeatureSpec = SPEC, out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the model's probability in column ``out``; a name that ``docs`` has already is an error."""
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {out}")
    if model is None:
        return docs.withColumn(out, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = shared.value.predict(*features(b.column("text").to_pylist(), spec))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p.astype(np.float64))], [*b.schema.names, out])

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = FOLDS, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, held_out, score, predicted."""
    model = train(docs, labels, folds=folds, sample=sample)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", "text", (remainder("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
