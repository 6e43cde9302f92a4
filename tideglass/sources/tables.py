"""Readers, and the engine's logical inputs bound to star-schema tables.

``fills`` sees each row of ``events`` as an execution: wallet = user, coin = event type, size and side from
the ``k`` of its JSON properties, price = value, and a start position that is the running sum before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalar import signed_delta

FILL_LINE = T.StructType(
    [
        T.StructField("time", T.LongType()),
        T.StructField("user", T.StringType()),
        T.StructField("coin", T.StringType()),
        T.StructField("side", T.StringType()),
        T.StructField("px", T.StringType()),
        T.StructField("sz", T.StringType()),
        T.StructField("startPosition", T.StringType()),
        T.StructField("closedPnl", T.StringType()),
        T.StructField("fee", T.StringType()),
        T.StructField("tid", T.LongType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fills(spark: SparkSession, sf_dir: str, *, offset: bool = False) -> DataFrame:
    """wallet, coin, id, ts, side, size, price, delta, start_position, closed_pnl, fee. ``offset`` makes some
    histories begin with an open position."""
    k = F.get_json_object("props", "$.k").cast("long")
    base = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("wallet"), F.col("event_type").alias("coin"), F.col("event_id").alias("id"), "ts",
        F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"), (1 + k % 3).alias("size"), F.col("value").alias("price"), (k % 7 - 3).alias("closed_pnl"),
    )
    base = base.withColumn("delta", signed_delta(F.col("side"), F.col("size"))).withColumn("fee", F.col("size") * F.lit(0.01))
    before = Window.partitionBy("wallet", "coin").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("delta").over(before), F.lit(0)) + (F.col("wallet") % 3 if offset else F.lit(0))
    return base.withColumn("start_position", start)


def archive_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of an execution archive's JSON lines, one object or an array per line, with their place in the
    line; lines that do not parse are kept in ``corrupt``."""
    one = F.from_json(column, FILL_LINE)
    many = F.from_json(column, T.ArrayType(FILL_LINE))
    rows = F.when(F.ltrim(F.col(column)).startswith("["), many).otherwise(F.array(one))
    out = lines.select(F.col(column).alias("_line"), F.posexplode_outer(rows).alias("ordinal", "row"))
    bad = F.col("row").isNull() | F.col("row.time").isNull()
    return out.select("ordinal", "row.*", F.when(bad, F.col("_line")).alias("corrupt"))


def map_fill(raw: DataFrame) -> DataFrame:
    """Archive rows as fills: side B and A as BUY and SELL, decimals from text, ids that name the wallet too."""
    return raw.select(
        F.lower("user").alias("wallet"), "coin", F.concat_ws(":", F.lower("user"), "time", "coin", F.col("tid").cast("string")).alias("id"), F.timestamp_millis("time").alias("ts"),
        F.when(F.col("side") == "B", "BUY").when(F.col("side") == "A", "SELL").alias("side"),
        *(F.col(c).try_cast("decimal(38,18)").alias(n) for c, n in (("sz", "size"), ("px", "price"), ("startPosition", "start_position"), ("closedPnl", "closed_pnl"), ("fee", "fee"))),
    )


def landing_plan(inventory: DataFrame, required: DataFrame) -> DataFrame:
    """Per required hour: missing, ambiguous (several objects) or selected, and its bytes."""
    have = inventory.groupBy("hour").agg(F.count(F.lit(1)).alias("n_objects"), F.sum("bytes").alias("bytes"))
    n = F.coalesce("n_objects", F.lit(0))
    state = F.when(n == 0, "MISSING").when(n > 1, "AMBIGUOUS").otherwise("SELECTED")
    return required.join(have, "hour", "left").select("hour", state.alias("state"), n.alias("n_objects"), F.when(n == 1, F.col("bytes")).alias("bytes"))


def transfer_cost(plan: DataFrame, per_request: float, per_gib: float) -> DataFrame:
    """Requests, GiB and cost of the selected objects of a landing plan."""
    return plan.filter("state = 'SELECTED'").agg(F.count(F.lit(1)).alias("requests"), (F.coalesce(F.sum("bytes"), F.lit(0)) / 1024.0**3).alias("gib")).withColumn("cost", F.col("requests") * per_request + F.col("gib") * per_gib)
