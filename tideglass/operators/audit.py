"""Trust, completeness and readiness of histories, and reconciliations between layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cohort import bounded_members
from .relational import day_gaps


def run_trust(transitions: DataFrame) -> DataFrame:
    """The state of each run after its log of trust changes.

    ``transitions``: run_id, at, operation_key, to_state. An operation key counts once, a change into the state a
    run already has counts not at all; runs begin TRUSTED at revision 0.
    """
    order = Window.partitionBy("run_id").orderBy("at", "operation_key")
    once = transitions.withColumn("_n", F.row_number().over(Window.partitionBy("run_id", "operation_key").orderBy("at"))).filter("_n = 1")
    moved = once.withColumn("_before", F.coalesce(F.lag("to_state").over(order), F.lit("TRUSTED"))).filter("to_state <> _before")
    return moved.groupBy("run_id").agg(F.count(F.lit(1)).alias("revision"), F.max_by("to_state", F.struct("at", "operation_key")).alias("state"))


def trusted_runs(runs: DataFrame, trust: DataFrame) -> DataFrame:
    """Runs whose recorded state and revision agree with the log; a run the log does not know is trusted at 0."""
    rows = runs.join(trust.withColumnsRenamed({"revision": "_revision", "state": "_state"}), "run_id", "left")
    same = (F.coalesce("_revision", F.lit(0)) == F.col("trust_revision")) & (F.coalesce("_state", F.lit("TRUSTED")) == F.col("trust_state"))
    return rows.withColumn("error_code", F.when(~same, "TRUST_INCONSISTENT").when(F.col("trust_state") != "TRUSTED", "RUN_QUARANTINED")).drop("_revision", "_state")


def newest_version(runs: DataFrame, keys: Sequence[str], versions: Sequence[str]) -> DataFrame:
    """Per key the latest run of the first version, in the order given, that has one."""
    place = F.array_position(F.array(*map(F.lit, versions)), F.col("version"))
    order = Window.partitionBy(*keys).orderBy(F.when(place > 0, place).asc_nulls_last(), F.desc("at"), F.desc("run_id"))
    return runs.filter(F.col("version").isin(*versions)).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def evaluable(metrics: DataFrame, required: Sequence[str], version: str) -> DataFrame:
    """Per run: all required metrics AVAILABLE, of one version, over one window, with closed cycles."""
    own = metrics.filter(F.col("metric").isin(*required))
    ok = (F.col("status") == "AVAILABLE") & (F.col("version") == version)
    sums = own.groupBy("run_id").agg(F.count_distinct(F.when(ok, F.col("metric"))).alias("_ok"), F.count_distinct(F.struct("period_from", "period_to")).alias("_windows"), F.min(F.col("period_to") >= F.col("period_from")).alias("_ordered"), F.max("n_cycles").alias("_cycles"))
    return sums.select("run_id", ((F.col("_ok") == len(required)) & (F.col("_windows") == 1) & F.col("_ordered") & (F.coalesce("_cycles", F.lit(0)) > 0)).alias("is_evaluable"))


def completeness(wallets: DataFrame, fills: DataFrame, days: DataFrame, cursors: DataFrame, issues: DataFrame) -> DataFrame:
    """One of five states per wallet, by rules in order: explicit gaps, truncation, too little history, missing
    days, failed or partial sources, open first positions, values that do not span the asked range.

    ``wallets``: wallet, range_from, range_to; ``days``: wallet, day; ``cursors``: wallet, status;
    ``issues``: wallet, issue (open ones).
    """
    first = fills.groupBy("wallet", "coin").agg(F.min_by("start_position", F.struct("ts", "id")).alias("_sp")).groupBy("wallet").agg(F.max((F.col("_sp") != 0)).alias("_open_start"))
    order = Window.partitionBy("wallet").orderBy("day")
    own = days.select("wallet", "day").distinct().withColumn("_gap", F.coalesce(F.datediff("day", F.lag("day").over(order)) > 1, F.lit(False)))
    own = own.groupBy("wallet").agg(F.count(F.lit(1)).alias("_days"), F.max("_gap").alias("_gap"), F.min("day").alias("_first"), F.max("day").alias("_last"))
    cur = cursors.groupBy("wallet").agg(F.max(F.col("status") == "GAP_DETECTED").alias("_cursor_gap"), F.max(F.col("status") == "FAILED").alias("_failed"))
    i = F.col("issue")
    iss = issues.groupBy("wallet").agg(F.max(i.contains("GAP")).alias("_issue_gap"), F.max(i.contains("HISTORY_LIMIT") | i.contains("PAGINATION_LIMIT") | i.contains("TRUNCAT")).alias("_cut"), F.max(i.contains("INCOMPLETE") | i.contains("PARTIAL")).alias("_partial"))
    rows = wallets
    for part in (first, own, cur, iss):
        rows = rows.join(part, "wallet", "left")

    def yes(name: str):
        return F.coalesce(F.col(name), F.lit(False))

    state = (
        F.when(yes("_cursor_gap") | yes("_issue_gap"), "GAP_DETECTED").when(yes("_cut"), "TRUNCATED")
        .when(F.col("_open_start").isNull() | (F.coalesce("_days", F.lit(0)) < 2), "INSUFFICIENT_HISTORY").when(yes("_gap"), "GAP_DETECTED")
        .when(yes("_failed") | yes("_partial") | yes("_open_start") | (F.col("_first") > F.col("range_from")) | (F.col("_last") < F.col("range_to")), "PARTIAL").otherwise("COMPLETE")
    )
    return rows.select("wallet", state.alias("completeness"))


def leg_issues(fills: DataFrame, events: DataFrame) -> DataFrame:
    """Executions whose behaviour events do not tie: one leg, or two for a flip, numbered from 0, their
    quantities adding to the size, from the start position to the end position."""
    legs = events.groupBy("id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("ordinal").alias("_last"), F.count_distinct("ordinal").alias("_distinct"), F.sum("quantity").alias("_q"),
        F.min_by("position_before", "ordinal").alias("_from"), F.max_by("position_after", "ordinal").alias("_to"),
    )
    after = F.col("start_position") + F.col("delta")
    need = F.when(F.signum("start_position") * F.signum(after) < 0, 2).otherwise(1)
    rows = fills.join(legs, "id", "left")
    tied = (F.col("_n") == need) & (F.col("_distinct") == need) & (F.col("_last") == need - 1) & (F.col("_q") == F.col("size")) & (F.col("_from") == F.col("start_position")) & (F.col("_to") == after) & (F.col("size") > 0)
    return rows.filter(~F.coalesce(tied, F.lit(False))).select("id", F.lit("SOURCE_LEGS_INCOMPLETE").alias("issue"))


def readiness(members: DataFrame, buckets: DataFrame, progress: DataFrame, latest: DataFrame, *, now: Column | None = None, issues: DataFrame | None = None) -> DataFrame:
    """Issues per coin, bucket and member that keep a bucket from being computed.

    ``buckets``: coin, bucket_end; ``progress``: wallet, coin, done_to, observed_to, has_gap; ``latest``: wallet,
    coin, last_at, the newest event; ``issues``: open ones, wallet, coin (null: of all coins), since. A bucket that ends after
    ``now`` is BUCKET_NOT_ENDED. A ``cohort`` column of ``members`` is kept; oversized cohorts (``cohort.oversized``) are left out.

    A member's issues with a coin each begin at some instant, so an issue becomes the buckets that end after it, from the
    coin's list of bucket ends, which is broadcast (8 bytes a coin and bucket); nothing of the size of the result is shuffled.
    """
    members = bounded_members(members)
    ends = buckets.groupBy("coin").agg(F.sort_array(F.collect_set("bucket_end")).alias("_ends"))
    rows = members.withColumn("coin", F.explode(ends.agg(F.collect_list("coin")).scalar())).join(progress, ["wallet", "coin"], "left").join(latest, ["wallet", "coin"], "left")
    cohort, since = [c for c in members.columns if c == "cohort"], F.lit(None).cast("timestamp_ntz")
    if issues is not None:
        by_coin = issues.filter("coin is not null").groupBy("wallet", "coin").agg(F.min("since").alias("_coin_since"))
        any_coin = issues.filter("coin is null").groupBy("wallet").agg(F.min("since").alias("_any_since"))
        rows = rows.join(by_coin, ["wallet", "coin"], "left").join(any_coin, "wallet", "left")
        since = F.least("_coin_since", "_any_since")
    first = F.lit("0001-01-01").cast("timestamp_ntz")
    now = F.lit(None).cast("timestamp_ntz") if now is None else now
    lag = F.when(F.col("done_to").isNull(), "MISSING_BOUNDARY").when(F.col("last_at") > F.col("done_to"), "NORMALIZATION_LAG")

    def issue(code: Column, after: Column) -> Column:
        return F.when(code.isNotNull() & after.isNotNull(), F.struct(code.alias("issue"), after.alias("after")))

    found = F.array_compact(F.array(
        issue(F.lit("BUCKET_NOT_ENDED"), now), issue(F.lit("OPEN_ISSUE"), since), issue(F.when(F.coalesce("has_gap", F.lit(False)), "SOURCE_GAP"), first),
        issue(F.lit("SOURCE_NOT_OBSERVED"), F.coalesce("observed_to", first)), issue(lag, first),
    ))
    # by number, since each of these few rows becomes as many as its coin has buckets: they are not put together for being small
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(*cohort, "coin", "wallet", F.explode(found).alias("_i")).repartition(tasks, "wallet", "coin")
    rows = rows.join(F.broadcast(ends), "coin").select(*cohort, "coin", F.explode("_ends").alias("bucket_end"), "wallet", F.col("_i.issue").alias("issue"), F.col("_i.after").alias("_after"))
    return rows.filter(F.col("bucket_end") > F.col("_after")).drop("_after")


def history_report(rejected: DataFrame, days: DataFrame, flows: DataFrame, keys: Sequence[str] = ("wallet",)) -> DataFrame:
    """Per key that any table has: n_rejected (rows of ``rejected``), n_gaps (places where the next of ``days``' days is missing), n_unknown_flows (of
    normalised ``flows``, those that cannot be classed), and is_clean: none of them."""
    gaps = day_gaps(days, keys, "day").select(*keys, F.lit(0).alias("_r"), F.col("n_gaps").alias("_g"), F.lit(0).alias("_u"))
    lost = rejected.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r")).select(*keys, "_r", F.lit(0).alias("_g"), F.lit(0).alias("_u"))
    odd = flows.groupBy(*keys).agg(F.count_if(F.col("is_external").isNull()).alias("_u")).select(*keys, F.lit(0).alias("_r"), F.lit(0).alias("_g"), "_u")
    out = gaps.unionByName(lost).unionByName(odd).groupBy(*keys).agg(F.sum("_r").alias("n_rejected"), F.sum("_g").alias("n_gaps"), F.sum("_u").alias("n_unknown_flows"))
    return out.withColumn("is_clean", F.col("n_rejected") + F.col("n_gaps") + F.col("n_unknown_flows") == 0)


def calculation_range(facts: Sequence[DataFrame], fallback: DataFrame) -> DataFrame:
    """Per wallet the first and last time over several fact tables (wallet, ts), else ``fallback`` (wallet, since)."""
    spans = [f.groupBy("wallet").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")) for f in facts]
    all_ = spans[0]
    for s in spans[1:]:
        all_ = all_.unionByName(s)
    span = all_.groupBy("wallet").agg(F.min("lo").alias("range_from"), F.max("hi").alias("range_to"))
    return fallback.join(span, "wallet", "left").select("wallet", F.coalesce("range_from", "since").alias("range_from"), F.coalesce("range_to", "since").alias("range_to"))


def issue_state(log: DataFrame) -> DataFrame:
    """Per issue fingerprint: OPEN or RESOLVED by its last report, when it first opened and how often."""
    return log.groupBy("fingerprint").agg(F.max_by("state", F.struct("at", "state")).alias("state"), F.min("at").alias("first_at"), F.count_if(F.col("state") == "OPEN").alias("n_opened"))


def snapshot_in_window(snapshots: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """All rows of each key's last instant in the window, or else of its last instant before it."""
    at = F.col("ts")
    best = snapshots.groupBy(*keys).agg(F.max(F.when(at.between(F.lit(start), F.lit(end)), at)).alias("_in"), F.max(F.when(at < F.lit(start), at)).alias("_before"))
    pick = best.select(*keys, F.coalesce("_in", "_before").alias("_at")).filter("_at is not null")
    return snapshots.join(pick, list(keys)).filter(F.col("ts") == F.col("_at")).drop("_at")


def dated_references(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows whose job is missing, belongs to another wallet, or does not span the row's time."""
    j = jobs.select("job_id", F.col("wallet").alias("_wallet"), "started_at", "finished_at")
    found = rows.join(j, "job_id", "left")
    issue = F.when(F.col("_wallet").isNull(), "MISSING_JOB").when(F.col("_wallet") != F.col("wallet"), "WALLET_MISMATCH").when(~F.col("ts").between(F.col("started_at"), F.col("finished_at")), "OUTSIDE_JOB")
    return found.withColumn("issue", issue).filter("issue is not null").drop("_wallet", "started_at", "finished_at")


def position_relations(fills: DataFrame, direction: str) -> DataFrame:
    """Per wallet the executions whose direction text speaks of long and of short."""
    low = F.lower(direction)
    return fills.groupBy("wallet").agg(F.count_if(low.contains("long")).alias("n_long"), F.count_if(low.contains("short")).alias("n_short"))
