"""Generic keyed operators: de-duplication, paging, top rows, as-of joins, gaps and reconciliations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order; one row per key leaves each map task."""
    return top_per_key(df, keys, order, 1)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key. Spark limits each task's groups to k rows before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def conflicts(df: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Per key: rows, distinct payloads, and whether equal keys disagree."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.struct(*payload)).alias("n_payloads")).withColumn("is_conflict", F.col("n_payloads") > 1)


def keyset_page(df: DataFrame, keys: Sequence[str], after: Sequence[object] | None, limit: int) -> DataFrame:
    """The next ``limit`` + 1 rows in key order after the cursor; the extra row tells that more follow."""
    if after is not None:
        steps = [reduce(lambda a, b: a & b, [F.col(k) == v for k, v in zip(keys[:i], after[:i], strict=True)], F.col(keys[i]) > after[i]) for i in range(len(keys))]
        df = df.filter(reduce(lambda a, b: a | b, steps))
    return df.orderBy(*keys).limit(limit + 1)


def append_new(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` to append: one per key, none that ``existing`` holds."""
    return incoming.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def by_day(rows: DataFrame, keys: Sequence[str], time: str, day: str, facts: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """``rows`` with a column ``day`` of ``time`` and the columns ``carried``, windows over one row per key and day that holds ``facts``, aggregates
    of the day. So what a day needs of others is known without all rows of a key in one task; null keys are a key, null times a first day."""
    rows = rows.withColumn(day, F.coalesce(F.col(time).cast("date"), F.to_date(F.lit("0001-01-01"))))
    days = rows.groupBy(*keys, day).agg(*(v.alias(n) for n, v in facts.items()))
    days = days.select(*(F.col(k).alias(f"_own_{k}") for k in (*keys, day)), *(v.alias(n) for n, v in carried.items()))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_own_{k}")) for k in (*keys, day)))
    return rows.join(days, same).drop(*(f"_own_{k}" for k in (*keys, day)))


def _days_of(keys: Sequence[str], day: str) -> WindowSpec:
    """The order of a key's days inside ``by_day``, before its own columns have been renamed."""
    return Window.partitionBy(*keys).orderBy(day)


def last_before(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, tie: str, values: Sequence[str]) -> DataFrame:
    """Backward as-of join, strict: each left row with the values of the last right row of its keys before it.

    Both sides are put into one stream per key and day, and the last seen right row is carried along, from day to day too, so nothing
    is multiplied and no key needs all its rows in one task.
    """
    picked = F.struct(F.lit(1).alias("_hit"), *(F.col(v).alias(v) for v in values))
    l = left.withColumns({"_t": F.col(left_time), "_side": F.lit(0), "_tie": F.lit(None).cast(right.schema[tie].dataType)})
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"), picked.alias("_match"))
    both = l.unionByName(r, allowMissingColumns=True)
    earlier = _days_of(keys, "_day").rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(F.col("_side") == 1, F.struct("_t", "_tie"))
    both = by_day(both, keys, "_t", "_day", {"_m": F.max_by("_match", at)}, {"_carried": F.last("_m", ignorenulls=True).over(earlier)})
    order = Window.partitionBy(*keys, "_day").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_seen", F.coalesce(F.last("_match", ignorenulls=True).over(order), F.col("_carried"))).filter("_side = 0")
    return seen.select(*left.columns, *(F.col(f"_seen.{v}").alias(f"asof_{v}") for v in values))


def first_after(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, tie: str, values: Sequence[str]) -> DataFrame:
    """Forward as-of join, strict: each left row with the values of the first right row of its keys after it; by days as ``last_before``."""
    picked = F.struct(F.lit(1).alias("_hit"), *(F.col(v).alias(v) for v in values))
    l = left.withColumns({"_t": F.col(left_time), "_side": F.lit(1), "_tie": F.lit(None).cast(right.schema[tie].dataType)})
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), picked.alias("_match"))
    both = l.unionByName(r, allowMissingColumns=True)
    later = _days_of(keys, "_day").rowsBetween(1, Window.unboundedFollowing)
    at = F.when(F.col("_side") == 0, F.struct("_t", "_tie"))
    both = by_day(both, keys, "_t", "_day", {"_m": F.min_by("_match", at)}, {"_carried": F.first("_m", ignorenulls=True).over(later)})
    order = Window.partitionBy(*keys, "_day").orderBy("_t", "_side", "_tie").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    seen = both.withColumn("_seen", F.coalesce(F.first("_match", ignorenulls=True).over(order), F.col("_carried"))).filter("_side = 1")
    return seen.select(*left.columns, *(F.col(f"_seen.{v}").alias(f"asof_{v}") for v in values))


def day_gaps(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Per key: distinct days, places where the next day is missing, and whether there is none."""
    days = df.select(*keys, F.col(day).cast("date").alias("_day")).distinct()
    gap = F.datediff("_day", F.lag("_day").over(Window.partitionBy(*keys).orderBy("_day"))) > 1
    return days.withColumn("_gap", gap).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_days"), F.count_if("_gap").alias("n_gaps")).withColumn("is_continuous", F.col("n_gaps") == 0)


def islands(df: DataFrame, keys: Sequence[str], at: str, step_seconds: int) -> DataFrame:
    """Runs of rows that follow each other by exactly ``step_seconds``: keys, start, end, length."""
    order = Window.partitionBy(*keys).orderBy(at)
    seconds = F.unix_timestamp(F.col(at).cast("timestamp"))
    broke = F.coalesce((seconds - F.lag(seconds).over(order) != step_seconds).cast("int"), F.lit(1))
    runs = df.withColumn("_broke", broke).withColumn("_run", F.sum("_broke").over(order))
    return runs.groupBy(*keys, "_run").agg(F.min(at).alias("run_start"), F.max(at).alias("run_end"), F.count(F.lit(1)).alias("run_length")).drop("_run")


def missing(required: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return required.join(present.select(*keys), list(keys), "left_anti")


def reconcile(manifest: DataFrame, current: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Per id of either side: EXACT, MISMATCH, DUPLICATE, MISSING (only in the manifest) or UNLISTED."""
    m = manifest.select(F.col(key), F.struct(*fields).alias("_m"))
    c = current.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*fields)).alias("_c"))
    state = (
        F.when(F.col("_n").isNull(), "MISSING").when(F.col("_m").isNull(), "UNLISTED").when(F.col("_n") > 1, "DUPLICATE")
        .when(F.col("_m") == F.col("_c"), "EXACT").otherwise("MISMATCH")
    )
    return m.join(c, key, "full_outer").select(key, state.alias("state"))


def table_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and an order-free checksum: the sum of 60 bits of each row's MD5, so tasks add up."""
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))
    part = F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(part).cast("string").alias("checksum"))


def bounded(df: DataFrame, limit: int) -> DataFrame:
    """``df``, or an error if it has more than ``limit`` rows; reads no more than it must to tell."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows")
    return df
