"""Fingerprints of what results were made from: digests of ordered rows, bucket snapshots, signals, changes, and the check of that chain.

A digest is that of the rows in the order of their fingerprints, whatever tasks they were in: rows are sorted within chunks of equal
leading digits of the fingerprint, chunks within groups of chunks, these within the whole, and each level is hashed as its members' hashes in
order. A chunk holds one in 65,536 of a key's rows, so no list is longer than that or 256, and equal chunks stay equal
when others change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..envelope import reasons
from ..functions.scalar import bucket_start, fingerprint, semantic
from .cohort import change_label

#: Leading hexadecimal digits of a row's fingerprint that name its chunk, and of a chunk's that name its group.
CHUNK, GROUP = 4, 2
BEHAVIOR, AGGREGATION, SIGNAL, WEIGHT = "behavior-v1", "behavior-aggregation-v1", "signal-v1", "wallet-weight-v1"
MINUTES = 15
#: Fixed value: the amounts an event may have, plain, not negative, below 10^20, of at most 18 places.
EVENT_AMOUNT = r"^(0|[1-9][0-9]{0,19})(\.[0-9]{1,18})?$"
HASH = r"^[0-9a-f]{64}$"


def ordered_digest(rows: DataFrame, keys: Sequence[str], order: str, content: Column, *, hashed: bool = False) -> DataFrame:
    """``keys``, n_rows, digest: of each key's rows in the order of the hexadecimal fingerprint in column ``order``, equal rows counted each. ``hashed``
    says that ``content`` is the SHA-256 of what is meant."""
    keys = list(keys)
    told = content if hashed else F.sha2(content, 256)

    def level(df: DataFrame, by: list[str], line: Column) -> DataFrame:
        return df.groupBy(*by).agg(F.sum("_n").alias("_n"), F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(line))), 256).alias("_d"))

    lines = rows.select(*keys, F.substring(order, 1, CHUNK).alias("_chunk"), F.concat_ws(":", F.coalesce(F.col(order), F.lit("")), told).alias("_line"), F.lit(1).cast("long").alias("_n"))
    chunks = level(lines, [*keys, "_chunk"], F.col("_line")).withColumn("_group", F.substring("_chunk", 1, GROUP))
    groups = level(chunks, [*keys, "_group"], F.concat_ws(":", F.coalesce("_chunk", F.lit("")), "_d"))
    whole = level(groups, keys, F.concat_ws(":", F.coalesce("_group", F.lit("")), "_d"))
    return whole.select(*keys, F.col("_n").alias("n_rows"), F.sha2(F.concat_ws("\n", F.col("_n").cast("string"), "_d"), 256).alias("digest"))


def table_manifest(rows: DataFrame, columns: Sequence[str], wallet: str = "wallet") -> DataFrame:
    """One row: n_rows, n_wallets and the digest of all rows in one order. Rows in another order have the same digest, any other change another."""
    line = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    named = rows.select(F.col(wallet).alias("_w"), line.alias("_row")).withColumn("_key", F.sha2("_row", 256))
    return ordered_digest(named, [], "_key", F.col("_row")).join(named.agg(F.count_distinct("_w").alias("n_wallets")))


def gap_recovery_manifest(gaps: DataFrame) -> DataFrame:
    """One row over ``evidence.gap_manifest``: n_rows, n_wallets, sha256, and ``error_code`` where one gap is not sound: then the whole manifest is
    refused and has no hash. The least code counts."""
    sound = F.col("error_code").isNull()
    rows = gaps.select("wallet", "error_code", "row_hash")
    told = rows.agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("wallet").alias("_w"), F.min("error_code").alias("error_code"))
    digest = ordered_digest(rows.filter(sound), [], "row_hash", F.col("row_hash")).select("digest")
    ok = F.col("error_code").isNull()
    both = told.select("_n", "_w", "error_code").join(digest, how="left")
    return both.select(F.when(ok, F.col("_n")).alias("n_rows"), F.when(ok, F.col("_w")).alias("n_wallets"), F.when(ok, F.coalesce("digest", F.sha2(F.lit(""), 256))).alias("sha256"), "error_code")


# --- buckets -----------------------------------------------------------------------------------------------

#: The columns of an event that a snapshot holds, in their order.
EVENT = ("id", "fingerprint", "version", "wallet", "coin", "ts", "event_type", "direction", "notional", "source_id", "ordinal", "run_id", "selection_id", "performance_id")


def event_identity() -> Column:
    """The fingerprint that an event must have: of what it was made from."""
    return fingerprint(F.lit(BEHAVIOR), F.col("source_id"), F.col("ordinal"))


def _content() -> Column:
    return F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in EVENT)), {"ignoreNullFields": "false"})


def event_issues(events: DataFrame, members: DataFrame) -> DataFrame:
    """cohort, coin, bucket, issue, subject: what is wrong with events (``EVENT`` and the ``cohort`` and ``bucket`` they are filed under), a row each:
    INVALID_DECIMAL, INVALID_TIMESTAMP, INCONSISTENT_PROVENANCE, INVALID_IDENTITY and INVALID_SEMANTIC of an event id, CONFLICTING_DUPLICATE of a fingerprint
    that two different events of a bucket have. ``members``: cohort, wallet.
    """
    def no(ok: Column) -> Column:
        return ~F.coalesce(ok, F.lit(False))

    runs = F.col("selection_id").isNotNull() & F.col("performance_id").isNotNull() & F.col("run_id").isNotNull()
    sound = ~no((F.col("version") == BEHAVIOR) & runs)
    codes = reasons(
        (no(F.col("notional").rlike(EVENT_AMOUNT)), "INVALID_DECIMAL"), (no(bucket_start(F.col("ts"), MINUTES) == F.col("bucket")), "INVALID_TIMESTAMP"),
        (~sound, "INCONSISTENT_PROVENANCE"), (no(F.col("ordinal").isin(0, 1) & (F.col("fingerprint") == event_identity())), "INVALID_IDENTITY"),
        (no(semantic(F.col("direction"), F.col("event_type")).isNotNull() & F.col("event_type").startswith("POSITION_")), "INVALID_SEMANTIC"),
    )
    place = ["cohort", "coin", "bucket"]
    told = events.select(*place, F.col("id").cast("string").alias("subject"), codes.alias("_codes"))
    # of other wallets' events only the place and the id are sought
    listed = members.select("cohort", "wallet").distinct()
    foreign = events.filter(sound).select(*place, "wallet", F.col("id").cast("string").alias("subject")).join(listed, ["cohort", "wallet"], "left_anti")
    own = told.select(*place, F.explode("_codes").alias("issue"), "subject").unionByName(foreign.select(*place, F.lit("INCONSISTENT_PROVENANCE").alias("issue"), "subject"))
    twice = events.groupBy(*place, "fingerprint").agg((F.min(F.sha2(_content(), 256)) != F.max(F.sha2(_content(), 256))).alias("_differ")).filter("_differ")
    return own.unionByName(twice.select(*place, F.lit("CONFLICTING_DUPLICATE").alias("issue"), F.col("fingerprint").alias("subject")))


def snapshots(events: DataFrame, members: DataFrame) -> DataFrame:
    """cohort, coin, bucket, n_events, status (VALID, or BLOCKED by an issue), issues (the codes), bucket_id, input_fingerprint and revision_id.

    The input fingerprint covers the members, every distinct event in order, and every issue, so it changes if and only if one of
    these does; the bucket id names the bucket of a cohort of these members.
    """
    place = ["cohort", "coin", "bucket"]
    scope = members.select("cohort", "wallet").distinct()
    scope = ordered_digest(scope.withColumn("_w", F.sha2(F.col("wallet").cast("string"), 256)), ["cohort"], "_w", F.col("wallet").cast("string")).select("cohort", F.col("digest").alias("_scope"))
    # hashes, not contents, are shuffled
    distinct = events.select(*place, "fingerprint", F.sha2(_content(), 256).alias("_c")).distinct()
    held = ordered_digest(distinct, place, "fingerprint", F.col("_c"), hashed=True)
    found = event_issues(events, members).distinct().withColumn("_line", F.concat_ws(":", "issue", "subject")).withColumn("_k", F.sha2("_line", 256))
    wrong = ordered_digest(found, place, "_k", F.col("_line")).select(*place, F.col("digest").alias("_wrong")).join(found.groupBy(*place).agg(F.array_join(F.sort_array(F.collect_set("issue")), ",").alias("issues")), place)
    rows = held.join(wrong, place, "left").join(scope, "cohort", "left")
    at = F.date_format("bucket", "yyyy-MM-dd'T'HH:mm:ss")
    rows = rows.withColumns({"bucket_id": fingerprint(F.lit(AGGREGATION), F.lit(BEHAVIOR), F.col("cohort"), F.col("_scope"), F.col("coin"), at), "input_fingerprint": fingerprint(F.lit(AGGREGATION), F.lit(BEHAVIOR), F.col("coin"), at, F.col("_scope"), F.col("digest"), F.col("_wrong"))})
    return rows.select(*place, F.col("n_rows").alias("n_events"), F.when(F.col("issues").isNull(), "VALID").otherwise("BLOCKED").alias("status"), F.coalesce("issues", F.lit("")).alias("issues"), "bucket_id", "input_fingerprint", fingerprint(F.col("bucket_id"), F.col("input_fingerprint")).alias("revision_id"))


def chain(snapshots: DataFrame, weights: DataFrame) -> DataFrame:
    """``snapshots`` with signal_id, of the bucket's revision and the cohort's ``weights`` (cohort, weight_fingerprint), and change_id, of the signal
    and that of the bucket right before it; null where there is none or a bucket is not valid."""
    valid = F.col("status") == "VALID"
    rows = snapshots.join(weights, "cohort", "left").withColumn("signal_id", F.when(valid & F.col("weight_fingerprint").isNotNull(), fingerprint(F.lit(SIGNAL), F.col("revision_id"), F.lit(WEIGHT), F.col("weight_fingerprint"), F.col("input_fingerprint"))))
    order = Window.partitionBy("cohort", "coin").orderBy("bucket")
    next_to = F.lag("bucket").over(order) + F.make_dt_interval(mins=F.lit(MINUTES)) == F.col("bucket")
    before = F.when(next_to, F.lag("signal_id").over(order))
    return rows.withColumn("_before", before).withColumn("change_id", F.when(F.col("_before").isNotNull() & F.col("signal_id").isNotNull(), fingerprint(F.col("_before"), F.col("signal_id")))).drop("_before")


def stale(stored: DataFrame, now: DataFrame) -> DataFrame:
    """cohort, coin, bucket, and bucket_state, signal_state, change_state of two ``chain`` results: CURRENT, STALE (the id differs), MISSING (stored lacks
    it), GONE (only stored has it), or null where neither has one."""
    place = ["cohort", "coin", "bucket"]
    ids = {"bucket_state": "input_fingerprint", "signal_state": "signal_id", "change_state": "change_id"}
    both = stored.select(*place, *(F.col(c).alias(f"_was_{c}") for c in ids.values())).join(now.select(*place, *ids.values()), place, "full")

    def state(c: str) -> Column:
        was, is_ = F.col(f"_was_{c}"), F.col(c)
        return F.when(was.isNull() & is_.isNull(), None).when(was.isNull(), "MISSING").when(is_.isNull(), "GONE").when(was == is_, "CURRENT").otherwise("STALE")

    return both.select(*place, *(state(c).alias(name) for name, c in ids.items()))


# --- changes between two given signals ---------------------------------------------------------------------

#: What two signals must share, in the order in which it is compared.
SHARED = ("coin", "signal_version", "selection_id", "cohort_fingerprint", "weight_id", "weight_fingerprint", "weight_version", "aggregation_version", "behavior_version")
_HASHES = ("signal_id", "input_fingerprint", "cohort_fingerprint", "weight_id", "weight_fingerprint", "revision_id", "aggregation_fingerprint")


def _plain(value: Column, signed: bool = False, places: int = 36) -> Column:
    """A canonical plain decimal between 0 (or -1) and 1 of at most so many places."""
    shape = r"^(0|1|0\.[0-9]*[1-9])$" if not signed else r"^(0|-?1|-?0\.[0-9]*[1-9])$"
    return value.rlike(shape) & (F.length(F.substring_index(value, ".", -1)) <= F.when(value.contains("."), places).otherwise(2))


def signal_error(s: str = "") -> Column:
    """The first thing wrong with a signal whose columns begin with ``s``: SIGNAL_NOT_VALID, UNSUPPORTED_VERSION, INVALID_PROVENANCE, INVALID_BUCKET,
    INVALID_DECIMAL or INCONSISTENT_SIGNAL; null if it is sound."""

    def c(name: str) -> Column:
        return F.col(s + name)

    def no(ok: Column) -> Column:
        return ~F.coalesce(ok, F.lit(False))

    versions = (c("signal_version") == SIGNAL) & (c("weight_version") == WEIGHT) & (c("aggregation_version") == AGGREGATION) & (c("behavior_version") == BEHAVIOR)
    named = (c("signal_id") == c("input_fingerprint")) & (c("weight_id") == c("weight_fingerprint")) & c("selection_id").isNotNull() & F.length(c("coin")).between(1, 100)
    for h in _HASHES:
        named = named & c(h).rlike(HASH)
    bucket = (bucket_start(c("bucket"), MINUTES) == c("bucket")) & (c("bucket") + F.make_dt_interval(mins=F.lit(MINUTES)) == c("bucket_end"))
    decimals = _plain(c("buy_strength")) & _plain(c("sell_strength")) & _plain(c("net_signal"), True) & _plain(c("mass")) & _plain(c("confidence"), places=18)
    buy, sell, net, mass = (c(n).try_cast("decimal(38,36)") for n in ("buy_strength", "sell_strength", "net_signal", "mass"))
    sums = (buy - sell == net) & (buy + sell == mass) & (mass != 0) & c("n_wallets").between(1, 200)
    return (
        F.when(no(c("status") == "VALID"), "SIGNAL_NOT_VALID").when(no(versions), "UNSUPPORTED_VERSION").when(no(named), "INVALID_PROVENANCE")
        .when(no(bucket), "INVALID_BUCKET").when(no(decimals), "INVALID_DECIMAL").when(no(sums), "INCONSISTENT_SIGNAL")
    )


def checked_changes(pairs: DataFrame) -> DataFrame:
    """``pairs`` of signals, columns ``previous_`` and ``current_`` and the names ``signal_error`` uses, with error_code, event_type, reason, delta (text) and change_id.

    The previous signal's error counts before the current one's, then INCOMPATIBLE_ and the first of ``SHARED`` in which they differ, then
    NON_ADJACENT_BUCKETS; a pair in error has nothing else.
    """
    error = F.coalesce(signal_error("previous_"), signal_error("current_"), *(F.when(~F.col(f"previous_{k}").eqNullSafe(F.col(f"current_{k}")), f"INCOMPATIBLE_{k}") for k in SHARED),
        F.when((F.col("previous_bucket_end") != F.col("current_bucket")) | (F.col("previous_signal_id") == F.col("current_signal_id")), "NON_ADJACENT_BUCKETS"))
    before, now = (F.col(f"{s}_net_signal").try_cast("decimal(38,36)") for s in ("previous", "current"))
    rows = pairs.withColumn("error_code", error).withColumns({"_a": before, "_b": now, "_label": change_label(before, now)})
    ok, emerged = F.col("error_code").isNull(), (F.col("_a") == 0) & (F.col("_b") != 0)
    reason = F.when(F.col("_label") != "NONE", "EXACT_NET_TRANSITION").when(emerged & (F.col("_b") > 0), "DIRECTION_EMERGED_BUY").when(emerged, "DIRECTION_EMERGED_SELL").otherwise("UNCHANGED_NET")
    text = F.regexp_replace((F.col("_b") - F.col("_a")).cast("decimal(38,36)").cast("string"), r"\.?0+$", "")
    told = {"event_type": F.col("_label"), "reason": reason, "delta": F.when(text.isin("", "-0"), "0").otherwise(text), "change_id": fingerprint(F.col("previous_signal_id"), F.col("current_signal_id"))}
    return rows.withColumns({name: F.when(ok, v) for name, v in told.items()}).drop("_a", "_b", "_label")
