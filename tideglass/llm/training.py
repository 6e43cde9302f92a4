"""Bounded samples of labelled documents, as features, and models fitted on them, a task each."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .linear import FeatureSpec, features
from .words import slices

_RANGE = 1 << 40


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: Sequence[str], eligible: Column, bound: int) -> DataFrame:
    """doc_id, text and the label columns of at most ``bound`` labelled documents, those of smallest id hash.

    Labels that are null make a row unusable; of several label rows of one id, and of several texts,
    the least counts. Ids without a document do not count. At most ``bound`` ids are broadcast.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & eligible)
    for c in columns:
        usable = usable.filter(F.col(c).isNotNull())
    ids = usable.groupBy("doc_id").agg(*(F.min(c).cast("int").alias(c) for c in columns)).join(docs.select("doc_id"), "doc_id", "left_semi")
    ids = materialise(ids.withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(_RANGE))), "labelled-ids")
    share = (2 * bound + 100) / max(1, ids.count())  # so that about 2 x bound rows are sorted, however many there are
    chosen = ids.filter(F.col("_h") < int(min(1.0, share) * _RANGE)).orderBy("_h", "doc_id").limit(bound).drop("_h")
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *columns).agg(F.min("text").alias("text"))


def hashed(sample: DataFrame, columns: Sequence[str], spec: FeatureSpec) -> DataFrame:
    """doc_id, the label columns and _f, the feature numbers of each row of the bounded ``sample``."""

    def as_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            idx, offsets = features(b.column("text").to_pylist(), spec)
            rows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(idx, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(c) for c in columns), rows], ["doc_id", *columns, "_f"])

    return sample.select("doc_id", *columns, "text").mapInArrow(as_features, "doc_id long, " + "".join(f"{c} int, " for c in columns) + "_f array<int>")


def fit_each(rows: DataFrame, fits: int, fit: Callable[[int, list[np.ndarray], pd.DataFrame], object]) -> list[object]:
    """``fit(number, feature rows, the other columns)`` for each number below ``fits``, each over all of the bounded
    ``rows`` and in a group, hence a task, of its own; nothing if there are no rows."""

    keys: dict[int, int] = {}  # a key for each of ``fits`` partitions, so that no two fits meet in one
    k = F.col("id").cast("int")
    for r in rows.sparkSession.range(64 * fits).select(k.alias("k"), F.pmod(F.hash(k), F.lit(fits)).alias("p")).collect():
        keys.setdefault(r["p"], r["k"])
    number_of = {key: number for number, key in enumerate(keys.values())}

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        number = number_of[int(pdf["_fit"].iloc[0])]
        pdf = pdf.sort_values("doc_id").reset_index(drop=True)
        return pd.DataFrame({"number": [number], "model": [pickle.dumps(fit(number, list(pdf.pop("_f")), pdf))]})

    dealt = rows.withColumn("_fit", F.explode(F.array(*map(F.lit, number_of)))).repartition(fits, "_fit")
    got = dealt.groupBy("_fit").applyInPandas(train, "number int, model binary").collect()
    return [pickle.loads(r["model"]) for r in sorted(got, key=lambda r: r["number"])]
