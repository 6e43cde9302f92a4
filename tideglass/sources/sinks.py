"""Sinks: appends without duplicates, result sets that appear whole, and receipts named by their content.

One writer at a time appends to a table. A step that is tried again writes what it wrote before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.relational import append_new


def existing(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The Parquet table at ``path``, empty if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def append_once(incoming: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Appends the rows of ``incoming`` whose keys the Parquet table at ``path`` does not hold yet."""
    append_new(incoming, existing(incoming.sparkSession, path, incoming.schema), keys).write.mode("append").parquet(path)


def publish_run(results: DataFrame, run: DataFrame, path: str) -> None:
    """A run's rows first, its row in the run table last: readers that join on runs never see half a run. The runs' own
    partitions are overwritten, so a retry leaves one copy."""
    for part, rows in (("results", results), ("runs", run)):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{part}")


def receipts(rows: DataFrame, snapshot: Sequence[str]) -> DataFrame:
    """Adds ``receipt_id``: the SHA-256 of the snapshot columns as JSON, whose field order is part of it."""
    return rows.withColumn("receipt_id", F.sha2(F.to_json(F.struct(*snapshot)), 256))


def receipt_state(rows: DataFrame, stored: DataFrame, snapshot: Sequence[str], expected: str) -> DataFrame:
    """Receipts to write: ``rows`` with ``state`` NEW, STORED, UNEXPECTED (the id is not that of column ``expected``) or CONFLICT (``stored``
    has the id with other bytes). Only NEW ones are to be appended."""
    own = receipts(rows, snapshot).withColumn("_bytes", F.to_json(F.struct(*snapshot)))
    have = stored.groupBy("receipt_id").agg(F.min("payload").alias("_payload"))
    state = F.when(~F.col("receipt_id").eqNullSafe(F.col(expected)), "UNEXPECTED").when(F.col("_payload").isNull(), "NEW").when(F.col("_payload") == F.col("_bytes"), "STORED").otherwise("CONFLICT")
    return own.join(have, "receipt_id", "left").withColumn("state", state).withColumn("payload", F.col("_bytes")).drop("_bytes", "_payload")


def current_revision(revisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of append-only revisions the last of each key."""
    return revisions.groupBy(*keys).agg(F.max(F.struct("revision", *[c for c in revisions.columns if c not in (*keys, "revision")])).alias("_r")).select(*keys, "_r.*")


def replace_positions(snapshots: DataFrame, keys: Sequence[str] = ("wallet",)) -> DataFrame:
    """The rows of the newest snapshot of each wallet: older ones are ignored, absent coins are gone."""
    newest = snapshots.groupBy(*keys).agg(F.max("ts").alias("_at"))
    return snapshots.join(newest, list(keys)).filter(F.col("ts") == F.col("_at")).drop("_at")


def ignored_snapshots(incoming: DataFrame, current: DataFrame, keys: Sequence[str] = ("wallet",)) -> DataFrame:
    """An OLDER_SNAPSHOT_IGNORED row (keys, ts, current_at) per snapshot of ``incoming`` that is older than what ``current`` holds."""
    newest = current.groupBy(*keys).agg(F.max("ts").alias("current_at"))
    old = incoming.select(*keys, "ts").distinct().join(newest, list(keys)).filter(F.col("ts") < F.col("current_at"))
    return old.withColumn("issue", F.lit("OLDER_SNAPSHOT_IGNORED"))


def bucket_state(current: DataFrame, asked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of ``asked`` buckets (keys, fingerprint) those whose current revision was made from other inputs are STALE, those without
    one MISSING, the rest CURRENT."""
    rows = asked.join(current.select(*keys, "revision", F.col("fingerprint").alias("_have")), list(keys), "left")
    return rows.withColumn("state", F.when(F.col("_have").isNull(), "MISSING").when(F.col("_have") != F.col("fingerprint"), "STALE").otherwise("CURRENT")).drop("_have")


def expired(rows: DataFrame, rules: Sequence[tuple[str, int]], state: str = "state", ts: str = "ts", now: str = "now") -> DataFrame:
    """Rows that retention would delete: state and age in days by rule."""
    old = F.lit(False)
    for name, days in rules:
        old = old | ((F.col(state) == name) & (F.datediff(F.col(now), F.col(ts)) > days))
    return rows.filter(old)
