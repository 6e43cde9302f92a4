"""Structured Streaming forms of the trading operators. Event times are instants; sessions run in UTC."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.scalar import bucket_start, fingerprint, signed_delta
from ..scratch import materialise, scratch_path
from ..sources.sinks import existing

DELAY = "10 minutes"


def event_stream(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a landing folder as a stream, with ``ts`` as an instant."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def as_fills(events: DataFrame) -> DataFrame:
    """wallet, coin, id, ts, side, size, price, delta of the events table's rows; no start position in a stream."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = events.select(F.col("user_id").alias("wallet"), F.col("event_type").alias("coin"), F.col("event_id").alias("id"), "ts", F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"), (1 + k % 3).alias("size"), F.col("value").alias("price"))
    return rows.withColumn("delta", signed_delta(F.col("side"), F.col("size")))


def deduplicated(stream: DataFrame, keys: Sequence[str], delay: str = DELAY) -> DataFrame:
    """One row per key; keys are forgotten once the watermark passes them."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def bucket_stream(fills: DataFrame, *, delay: str = DELAY, width: str = "15 minutes", watermarked: bool = False) -> DataFrame:
    """Per coin and final tumbling bucket: events and notional; a bucket appears once the watermark passes its end."""
    rows = fills if watermarked else fills.withWatermark("ts", delay)
    out = rows.groupBy("coin", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.col("price") * F.col("size")).alias("notional"))
    return out.select("coin", F.col("w.start").alias("bucket"), "n_events", "notional")


def session_stream(fills: DataFrame, *, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """Per wallet: sessions of executions with no pause longer than ``gap``."""
    out = fills.withWatermark("ts", delay).groupBy("wallet", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return out.select("wallet", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


#: Fixed value: groups that the keys of ``position_stream`` are dealt to, each a call into Python and a state a batch.
POSITION_BLOCKS = 1024


def position_stream(fills: DataFrame) -> DataFrame:
    """Each execution with its start position from keyed state (position, last time and id), or marked late.

    State per (wallet, coin) is three values; keys are dealt to ``POSITION_BLOCKS`` blocks, whose keys' values lie side by side in one
    state, so calls into Python do not grow with the keys. Rows of a micro-batch are taken in (ts, id) order; a row before
    what its key has seen is marked late and leaves the state as it was: ``late_positions`` recomputes the
    keys of late rows in batch, since appended output cannot be taken back.
    """
    key = ["wallet", "coin"]

    def step(_: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame(dict(zip((*key, "position", "last", "last_id"), state.get if state.exists else ([], [], [], [], []), strict=True)))
        kept = kept.astype({"wallet": "int64", "coin": "object", "position": "int64", "last": "int64", "last_id": "int64"})
        rows = pd.concat(list(frames)).sort_values(["ts", "id"], ignore_index=True)
        was = rows[key].merge(kept, "left", key)
        at, new = rows["ts"].astype("int64") // 1000, was["position"].isna()
        first, first_id, base = (was[c].astype("Int64").fillna(0).astype("int64") for c in ("last", "last_id", "position"))
        late = ~new & ((at < first) | ((at == first) & (rows["id"] < first_id)))
        delta = rows["delta"].where(~late, 0).astype("int64")
        after = base + delta.groupby([rows["wallet"], rows["coin"]]).cumsum()
        told = pd.DataFrame({"wallet": rows["wallet"], "coin": rows["coin"], "position": after, "last": at, "last_id": rows["id"]})[~late]
        kept = pd.concat([kept, told]).drop_duplicates(key, keep="last")
        state.update(tuple(kept[c].tolist() for c in (*key, "position", "last", "last_id")))
        yield pd.DataFrame({"wallet": rows["wallet"], "coin": rows["coin"], "id": rows["id"], "ts": rows["ts"], "start_position": after - delta, "delta": rows["delta"], "is_late": late})

    rows = fills.select(*key, "id", "ts", "delta").withColumn("_block", F.pmod(F.xxhash64(*key), F.lit(POSITION_BLOCKS)))
    return rows.groupBy("_block").applyInPandasWithState(
        step, "wallet long, coin string, id long, ts timestamp, start_position long, delta long, is_late boolean",
        "wallets array<long>, coins array<string>, positions array<long>, lasts array<long>, last_ids array<long>", "append", GroupStateTimeout.NoTimeout)


def _closed(rows: DataFrame, end: Column, fills: DataFrame, delay: str) -> DataFrame:
    last = fills.agg(F.max("ts").alias("_max"))
    return rows.crossJoin(F.broadcast(last)).filter(end <= F.col("_max") - F.expr(f"interval {delay}")).drop("_max")


def log_late(stream: DataFrame, path: str, columns: Sequence[str], *, delay: str = DELAY) -> DataFrame:
    """``columns`` and ts of the rows that came after the watermark had passed them, or might have, from a stream over all input that is there now.

    Each micro-batch writes its newest time, and its rows that are older than the newest time of the batches before it less ``delay``, into a folder
    of its own, which a repeated batch replaces. What ``bucket_stream`` and ``session_stream`` drop is among these rows.
    """
    spark, schema = stream.sparkSession, stream.select(*columns, "ts").schema
    news = StructType().add("newest", "timestamp").add("batch", "long")

    def log(batch: DataFrame, number: int) -> None:
        seen = existing(spark, f"{path}/newest", news).filter(F.col("batch") < number).agg(F.max("newest")).first()[0]
        batch.agg(F.max("ts").alias("newest")).write.mode("overwrite").parquet(f"{path}/newest/batch={number}")
        late = batch.filter(F.lit(False) if seen is None else F.col("ts") <= F.lit(seen) - F.expr(f"interval {delay}"))
        late.select(*columns, "ts").write.mode("overwrite").parquet(f"{path}/late/batch={number}")

    _finished(stream.writeStream.foreachBatch(log), path)
    return existing(spark, f"{path}/late", schema).select(*columns, "ts")


def late_buckets(streamed: DataFrame, fills: DataFrame, late: DataFrame, *, delay: str = DELAY, minutes: int = 15) -> DataFrame:
    """Batch job after ``bucket_stream``: the buckets of ``late`` rows (coin, ts) are computed anew from ``fills``, of which only rows of their
    coins and times are used; all other buckets stay."""
    width = f"{minutes} minutes"
    hit = late.select("coin", bucket_start(F.col("ts"), minutes).alias("bucket")).distinct()
    own = fills.withColumn("bucket", bucket_start(F.col("ts"), minutes)).join(hit, ["coin", "bucket"], "left_semi").drop("bucket")
    exact = _closed(bucket_stream(own, width=width, watermarked=True), F.col("bucket") + F.expr(f"interval {width}"), fills, delay)
    return streamed.join(hit, ["coin", "bucket"], "left_anti").unionByName(exact)


def late_sessions(streamed: DataFrame, fills: DataFrame, late: DataFrame, *, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """Batch job after ``session_stream``: the wallets of ``late`` rows get their sessions anew from their own rows of ``fills``."""
    hit = late.select("wallet").distinct()
    exact = _closed(session_stream(fills.join(hit, "wallet", "left_semi"), gap=gap, delay=delay), F.col("session_end"), fills, delay)
    return streamed.join(hit, "wallet", "left_anti").unionByName(exact)


def late_positions(streamed: DataFrame, fills: DataFrame) -> DataFrame:
    """Batch job after ``position_stream``: keys with a row marked late get all their positions anew, none late."""
    late = streamed.filter("is_late").select("wallet", "coin").distinct()
    before = Window.partitionBy("wallet", "coin").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    own = fills.select("wallet", "coin", "id", "ts", "delta").join(late, ["wallet", "coin"], "left_semi")
    exact = own.withColumns({"start_position": F.coalesce(F.sum("delta").over(before), F.lit(0)), "is_late": F.lit(False)})
    return streamed.join(late, ["wallet", "coin"], "left_anti").unionByName(exact)


def run_available(stream: DataFrame, label: str, *, folder: str | None = None) -> DataFrame:
    """All input that is there now, through a Parquet sink with a checkpoint; exactly once per checkpoint."""
    spark = stream.sparkSession
    root = folder or scratch_path(spark, label)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/rows")
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def _finished(writer: DataStreamWriter, path: str) -> None:
    """Runs over all input that is there now; what was done is not done again. An error of the stream is raised."""
    query = writer.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _removed(spark: SparkSession, path: str, keep: Callable[[int], bool], prefix: str) -> None:
    """Removes the folders ``prefix``N of ``path`` whose number is not kept."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(folder):
        for status in files.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith(prefix) and not keep(int(name.removeprefix(prefix))):
                files.delete(status.getPath(), True)


# --- candidates --------------------------------------------------------------------------------------------

#: Batches after which a candidate table's folders become one, and days for which ids are remembered.
COMPACTED, REMEMBERED = 16, 40
_SUMS = {"n_trades": F.sum, "sum_notional": F.sum, "max_notional": F.max, "first_seen": F.min, "last_seen": F.max, "n_duplicates": F.sum}
_SKETCHES = ("coins", "hours")


def _candidate_sums(parts: DataFrame) -> DataFrame:
    """Partial candidates added up per wallet: sums, sketches of coins and hours, and the set of days."""
    return parts.groupBy("wallet").agg(*(f(c).alias(c) for c, f in _SUMS.items()), *(F.hll_union_agg(c).alias(c) for c in _SKETCHES), F.array_distinct(F.flatten(F.collect_list("days"))).alias("days"))


def _newest_whole(spark: SparkSession, path: str) -> int:
    """The last batch that the newest complete compaction covers, -1 if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in files.listStatus(folder)] if files.exists(folder) else []
    done = [int(p.getName().removeprefix("upto=")) for p in names if p.getName().startswith("upto=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=-1)


def candidate_table(fills: DataFrame, path: str, *, compacted: int = COMPACTED, remembered: int = REMEMBERED) -> DataFrame:
    """Per wallet n_trades, sum_notional, max_notional, first_seen, last_seen, n_duplicates, n_coins, n_hours and n_days, kept up to date by a stream
    over all input that is there now.

    A trade (wallet, id) that comes again, in the same batch or a later one, is counted in n_duplicates only. Ids are remembered by their day in folders
    of the batch that brought them, and a batch reads those of its own days alone; ids older than ``remembered`` days
    before the newest are forgotten. Coins and hours are HyperLogLog sketches that add up (their numbers are estimates, within 3 %), days a set.
    Each micro-batch writes folders of its own, so that a batch that is tried again replaces what it wrote; every ``compacted`` batches
    they become one and the old ones are removed.
    """
    spark = fills.sparkSession
    ids = StructType().add("wallet", fills.schema["wallet"].dataType).add("id", fills.schema["id"].dataType).add("batch", "long").add("day", "date")

    def known(number: int) -> DataFrame:
        last = _newest_whole(spark, f"{path}/ids_whole")
        own = existing(spark, f"{path}/ids", ids).filter((F.col("batch") < number) & (F.col("batch") > last)).select("wallet", "id", F.col("day").cast("date").alias("day"))
        return own if last < 0 else own.unionByName(spark.read.parquet(f"{path}/ids_whole/upto={last}").select(*own.columns))

    def compact(number: int) -> None:
        """Batches before ``number``, which are final, in one folder each; what they are made of is removed only then."""
        if _newest_whole(spark, f"{path}/whole") < number - 1:
            whole(number - 1).write.mode("overwrite").parquet(f"{path}/whole/upto={number - 1}")
        if _newest_whole(spark, f"{path}/ids_whole") < number - 1:
            held = known(number)
            oldest = F.date_sub(held.agg(F.max("day")).scalar(), remembered)
            held.filter(F.col("day") >= oldest).repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/ids_whole/upto={number - 1}")
        for name, prefix in (("rows", "batch="), ("ids", "batch="), ("whole", "upto="), ("ids_whole", "upto=")):
            _removed(spark, f"{path}/{name}", lambda n, last=number - (prefix == "upto="): n >= last, prefix)

    def upsert(batch: DataFrame, number: int) -> None:
        if number and number % compacted == 0:
            compact(number)
        batch = batch.withColumns({"_notional": F.col("price") * F.col("size"), "day": F.col("ts").cast("date")})
        once = batch.groupBy("wallet", "id", "day").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("ts", "_notional", "coin")).alias("_t"))
        days = [r["day"] for r in once.select("day").distinct().collect()]
        seen = known(number).filter(F.col("day").isin(days)).withColumn("_seen", F.lit(True))
        marked = materialise(once.join(seen, ["wallet", "id", "day"], "left").select("wallet", "id", "day", "_n", F.col("_seen").isNull().alias("_new"), "_t.*"), "candidates")
        new = F.col("_new")
        sums = marked.groupBy("wallet").agg(
            F.count_if(new).alias("n_trades"), F.sum(F.when(new, F.col("_notional"))).alias("sum_notional"), F.max(F.when(new, F.col("_notional"))).alias("max_notional"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
            F.sum(F.col("_n") - new.cast("int")).alias("n_duplicates"), F.hll_sketch_agg("coin").alias("coins"), F.hll_sketch_agg(F.date_trunc("hour", "ts").cast("long")).alias("hours"), F.collect_set("day").alias("days"),
        )
        sums.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        marked.filter(new).select("wallet", "id", "day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/ids/batch={number}")

    def whole(upto: int | None = None) -> DataFrame:
        last = _newest_whole(spark, f"{path}/whole")
        rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows") if _any(spark, f"{path}/rows") else None
        parts = None if rows is None else rows.filter((F.col("batch") > last) & (F.lit(upto is None) | (F.col("batch") <= (upto or 0)))).drop("batch")
        if last >= 0:
            old = spark.read.parquet(f"{path}/whole/upto={last}")
            parts = old if parts is None else old.unionByName(parts)
        if parts is None:  # nothing has come yet
            kinds = "n_trades long, sum_notional double, max_notional double, first_seen timestamp, last_seen timestamp, n_duplicates long, coins binary, hours binary, days array<date>"
            parts = spark.createDataFrame([], f"wallet {fills.schema['wallet'].dataType.simpleString()}, {kinds}")
        return _candidate_sums(parts)

    _finished(fills.writeStream.foreachBatch(upsert), path)
    told = whole()
    return told.select("wallet", *_SUMS, *(F.hll_sketch_estimate(c).alias(f"n_{c}") for c in _SKETCHES), F.size("days").alias("n_days"))


def _any(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(folder) and len(files.listStatus(folder)) > 0


# --- revisions ---------------------------------------------------------------------------------------------


def revision_table(fills: DataFrame, path: str, *, minutes: int = 15, kept: str = "30 days") -> DataFrame:
    """coin, bucket, revision, fingerprint, n_events, notional: the append-only revisions of buckets, kept up to date by a stream over all input that is
    there now.

    The stream tells every bucket that a batch changed; a revision is written only if its content differs from the newest one, so a late
    row makes the next revision of its bucket and the old ones stay. Buckets take late rows for ``kept``. A batch that is tried again writes the
    same revisions into the same folder. Prices must be decimals or whole numbers for sums that do not depend on order.
    """
    spark = fills.sparkSession
    columns = ["coin", "bucket", "n_events", "notional", "fingerprint"]
    rows = fills.withWatermark("ts", kept).groupBy("coin", F.window("ts", f"{minutes} minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum((F.col("price") * F.col("size")).cast("decimal(38,6)")).alias("notional"), F.bit_xor(F.xxhash64("wallet", "id", "side", "size", "price", "ts")).alias("_x"),
    )
    rows = rows.withColumn("bucket", F.col("w.start")).withColumn("fingerprint", fingerprint(F.col("n_events"), F.col("notional"), F.col("_x"))).select(*columns)
    schema = StructType([*rows.schema.fields]).add("revision", "long").add("batch", "long")

    def append(batch: DataFrame, number: int) -> None:
        have = existing(spark, f"{path}/revisions", schema).filter(F.col("batch") < number)
        newest = have.groupBy("coin", "bucket").agg(F.max(F.struct("revision", "fingerprint")).alias("_r"))
        changed = batch.join(newest, ["coin", "bucket"], "left").filter(F.col("_r").isNull() | (F.col("_r.fingerprint") != F.col("fingerprint")))
        changed.select(*columns, (F.coalesce("_r.revision", F.lit(0)) + 1).cast("long").alias("revision")).write.mode("overwrite").parquet(f"{path}/revisions/batch={number}")

    _finished(rows.writeStream.outputMode("update").foreachBatch(append), path)
    return existing(spark, f"{path}/revisions", schema).select(*columns, "revision")


# --- rewind ------------------------------------------------------------------------------------------------

BLOCKS = 64
_PLACED = ("wallet", "coin", "id", "ts", "delta", "start_position")


def _blocked(rows: DataFrame, blocks: int) -> DataFrame:
    return rows.withColumns({"block": F.pmod(F.xxhash64("wallet", "coin"), F.lit(blocks)).cast("int"), "day": F.col("ts").cast("date")})


def write_positions(placed: DataFrame, path: str, *, blocks: int = BLOCKS) -> None:
    """Executions with their start positions as a table in partitions of a block of keys and a day, and beside it where each key ended each day."""
    rows = _blocked(placed.select(*_PLACED), blocks)
    rows.repartition("block", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block", "day").parquet(f"{path}/rows")
    ends = rows.groupBy("block", "day", "wallet", "coin").agg(F.max_by(F.col("start_position") + F.col("delta"), F.struct("ts", "id")).alias("end"))
    ends.repartition("block").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block", "day").parquet(f"{path}/ends")


def rewind_positions(path: str, fills: DataFrame, late: DataFrame, *, blocks: int = BLOCKS) -> DataFrame:
    """Takes ``late`` rows (wallet, coin, ts) into the table of ``write_positions`` and returns block, day, n_rows: what was rewritten.

    Each key of a late row goes back to the day of its first one: the position at that day's beginning is where the key ended before, and its
    executions of ``fills`` (all input, the late rows among it) from that day on are placed anew. Only partitions of these keys' blocks from
    these days on are read and written; rows of other keys in them stay as they are. Other partitions are not touched.
    """
    spark = fills.sparkSession
    since = materialise(_blocked(late.select("wallet", "coin", "ts"), blocks).groupBy("block", "wallet", "coin").agg(F.min("day").alias("since")), "rewind")
    spans = {r["block"]: r["day"] for r in since.groupBy("block").agg(F.min("since").alias("day")).collect()}  # at most ``blocks``
    if not spans:
        return spark.createDataFrame([], "block int, day date, n_rows long")
    touched = reduce(lambda a, b: a | b, ((F.col("block") == b) & (F.col("day") >= F.lit(d)) for b, d in sorted(spans.items())))
    own_blocks = F.col("block").isin(sorted(spans))
    ends = spark.read.parquet(f"{path}/ends").filter(own_blocks).join(since, ["block", "wallet", "coin"]).filter("day < since")
    base = ends.groupBy("wallet", "coin").agg(F.max_by("end", "day").alias("_base"))
    again = _blocked(fills.select(*(c for c in _PLACED if c != "start_position")), blocks).filter(touched).join(since.drop("block"), ["wallet", "coin"]).filter("day >= since").join(base, ["wallet", "coin"], "left")
    before = Window.partitionBy("wallet", "coin").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    anew = again.withColumn("start_position", F.coalesce("_base", F.lit(0)) + F.coalesce(F.sum("delta").over(before), F.lit(0)))
    old = spark.read.parquet(f"{path}/rows").filter(touched).join(since.drop("block"), ["wallet", "coin"], "left").filter("since IS NULL OR day < since")
    columns = [*_PLACED, "block", "day"]
    rows = materialise(old.select(*columns).unionByName(anew.select(*columns)), "rewound")
    write_positions(rows, path, blocks=blocks)
    return rows.groupBy("block", "day").agg(F.count(F.lit(1)).alias("n_rows"))
