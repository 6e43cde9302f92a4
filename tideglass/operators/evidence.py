"""What the sources prove about a history, and what the layers above it say of each other: page coverage, gaps, manifests,
identity of events, searches and summaries. Keys are columns of the input, so all wallets are taken at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..envelope import reasons
from .relational import day_gaps, table_fingerprint

# --- sources -----------------------------------------------------------------------------------------------


def page_coverage(pages: DataFrame, keys: Sequence[str], *, page_rows: int, most_rows: int) -> DataFrame:
    """What a source's pages (page_no, n_rows, last_at, requested_from) prove per key.

    Each page asks on from the last one's ``last_at``, never a step later. A key's pages end with the first that is
    empty or not full (the range is exhausted), or that reaches ``most_rows`` in all, goes back, or does not go on
    (the history is cut). Later pages do not count. ``evidence`` is UNPROVEN unless the range is exhausted and uncut.
    """
    order = Window.partitionBy(*keys).orderBy("page_no")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = pages.withColumns({"_cursor": F.coalesce(F.lag("last_at").over(order), F.col("requested_from")), "_all": F.sum("n_rows").over(upto)})
    last = F.col("last_at")
    ends = (
        F.when(F.col("n_rows") == 0, "EXHAUSTED").when(F.col("_all") >= most_rows, "LIMIT").when(last < F.col("_cursor"), "LIMIT")
        .when(F.col("n_rows") < page_rows, "EXHAUSTED").when(last == F.col("_cursor"), "LIMIT")
    )
    rows = rows.withColumn("_ends", ends)
    first = F.min_by("_ends", F.when(F.col("_ends").isNotNull(), F.col("page_no")))
    stop = F.min(F.when(F.col("_ends").isNotNull(), F.col("page_no")))
    done = rows.groupBy(*keys).agg(first.alias("_how"), stop.alias("_stop"))
    read = rows.join(done, list(keys)).filter(F.col("_stop").isNull() | (F.col("page_no") <= F.col("_stop")))
    out = read.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n_rows").alias("n_items"), F.max("_how").alias("_how"))
    proven = F.coalesce((F.col("_how") == "EXHAUSTED") & (F.col("n_items") < most_rows), F.lit(False))
    label = F.when(~proven, "UNPROVEN").when(F.col("n_items") == 0, "BOUNDED_EMPTY_EXHAUSTIVE_RESPONSE").otherwise("BOUNDED_NON_EMPTY_EXHAUSTIVE_RESPONSE")
    return out.select(*keys, "n_pages", "n_items", label.alias("evidence"), proven.alias("proven"))


def in_time_range(df: DataFrame, start: Column, end: Column, *, ts: str = "ts", tie: str = "id", after: tuple[Column, Column] | None = None) -> DataFrame:
    """Rows of an inclusive range of times after the cursor (time, id); the range reaches the scan as a filter."""
    rows = df.filter(F.col(ts).between(start, end))
    if after is not None:
        rows = rows.filter((F.col(ts) > after[0]) | ((F.col(ts) == after[0]) & (F.col(tie) > after[1])))
    return rows


def whole_instants(rows: DataFrame, keys: Sequence[str], *, page_rows: int, most_rows: int, ts: str = "ts") -> DataFrame:
    """Per key and instant: rows, the page it falls on (instants are never split) and its ``state``. An instant of more than
    ``most_rows`` rows is INCOMPLETE, and what follows it in its key is BLOCKED."""
    sizes = rows.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("n_rows"))
    before = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    large = F.col("n_rows") > most_rows
    out = sizes.withColumns({"page": F.floor(F.coalesce(F.sum("n_rows").over(before), F.lit(0)) / page_rows), "_blocked": F.coalesce(F.max(large).over(before), F.lit(False))})
    return out.select(*keys, ts, "n_rows", "page", F.when(F.col("_blocked"), "BLOCKED").when(large, "INCOMPLETE").otherwise("COMPLETE").alias("state"))


def admissible_quotes(rows: DataFrame, contracts: DataFrame, *, coin: str = "coin") -> DataFrame:
    """``quote`` and ``error_code``: a coin without a colon is quoted in USDC; one with a colon only if ``contracts`` (coin,
    quote) lists that very contract; quotes other than USD and USDC are UNSUPPORTED_QUOTE."""
    listed = contracts.groupBy(F.col("coin").alias(coin)).agg(F.max("quote").alias("_quote"))
    quote = F.coalesce("_quote", F.when(~F.col(coin).contains(":"), "USDC").otherwise("UNKNOWN"))
    out = rows.join(listed, coin, "left").withColumn("quote", quote).drop("_quote")
    return out.withColumn("error_code", F.when(~F.upper("quote").isin("USD", "USDC"), "UNSUPPORTED_QUOTE"))


def reuse_runs(asked: DataFrame, runs: DataFrame, keys: Sequence[str] = ("wallet", "version", "fingerprint")) -> DataFrame:
    """Each asked calculation with the latest succeeded run (run_id, at, status) of the same keys, or none: COMPUTE."""
    done = runs.filter("status = 'SUCCEEDED'").groupBy(*keys).agg(F.max_by("run_id", F.struct("at", "run_id")).alias("run_id"))
    out = asked.join(done, list(keys), "left")
    return out.withColumn("action", F.when(F.col("run_id").isNull(), "COMPUTE").otherwise("REUSE"))


# --- searches ----------------------------------------------------------------------------------------------


def search(df: DataFrame, *, equal: Mapping[str, object] | None = None, text: str | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Rows whose columns equal the given values, where one of ``within`` holds ``text`` in any case; a null value or empty
    text asks for nothing."""
    out = df
    for name, value in (equal or {}).items():
        if value is not None:
            out = out.filter(F.col(name) == value)
    if text:
        out = out.filter(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False)) for c in within]))
    return out


def filter_cycles(cycles: DataFrame, *, coin: str | None = None, side: str | None = None, state: str | None = None, pnl: str | None = None, of: str = "net_pnl") -> DataFrame:
    """Cycles by coin, side, state and the sign of their profit (PROFIT, LOSS or EVEN); a null profit has none."""
    out = search(cycles, equal={"coin": coin, "side": side, "state": state})
    signs = {"PROFIT": F.col(of) > 0, "LOSS": F.col(of) < 0, "EVEN": F.col(of) == 0}
    return out if pnl is None else out.filter(signs[pnl])


def merge_pages(current: DataFrame, incoming: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows of both, one per key: those of ``current`` first, then the first in ``order``."""
    both = current.withColumn("_page", F.lit(0)).unionByName(incoming.withColumn("_page", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_page", *order))).filter("_n = 1").drop("_page", "_n")


def with_reasons(current: Column, evaluated: Column, *, without: str | None = None) -> Column:
    """The reasons of both, each once, in the order given, less ``without``."""
    both = F.array_union(F.coalesce(current, F.array().cast("array<string>")), F.coalesce(evaluated, F.array().cast("array<string>")))
    return both if without is None else F.array_remove(both, without)


def distinct_warnings(warnings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key its warnings, each (code, message, details) once, as ``n_warnings``, and the sorted distinct ``codes``."""
    return warnings.groupBy(*keys).agg(F.count_distinct(F.struct("code", "message", "details")).alias("n_warnings"), F.array_sort(F.collect_set("code")).alias("codes"))


# --- identity of events ------------------------------------------------------------------------------------


def identity_issues(events: DataFrame, fills: DataFrame) -> DataFrame:
    """SOURCE_IDENTITY for events (event_id, source_id, wallet, ts, price, size, quantity, notional) whose execution is absent
    or differs in wallet, time, price or size, or whose notional is not quantity times price. Money is compared exactly, so it is to be
    decimals; of doubles the product in doubles must be met."""
    own = fills.select(F.col("id").alias("source_id"), *(F.col(c).alias(f"_{c}") for c in ("wallet", "ts", "price", "size")))
    rows = events.join(own, "source_id", "left")
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in ("wallet", "ts", "price", "size")])
    same = same & (F.abs(F.col("quantity")) * F.col("price") == F.col("notional"))
    return rows.filter(~F.coalesce(same, F.lit(False))).select("event_id", F.lit("SOURCE_IDENTITY").alias("issue"))


def provenance_issues(events: DataFrame, runs: DataFrame, scopes: DataFrame, performance: DataFrame, *, version: str, most_scopes: int = 200) -> DataFrame:
    """GENERATION_PROVENANCE for events (event_id, run_id, wallet, coin) whose normalisation run (run_id, wallet, coin) or that
    run's first selection scope of the wallet (run_id, wallet, scope_id, performance_id) does not lead to a trusted,
    succeeded performance run (performance_id, wallet, status, version, trust_state) of the wallet. Events of a run with more
    than ``most_scopes`` scopes are TOO_MANY_SCOPES. Runs are judged before events meet them, and sorted: Spark takes lists made
    of a narrow table for small, and would send all runs to every executor."""
    large = scopes.groupBy("run_id").agg(F.count(F.lit(1)).alias("_scopes")).filter(F.col("_scopes") > most_scopes)
    first = scopes.filter("performance_id is not null").groupBy("run_id", "wallet").agg(F.min_by("performance_id", "scope_id").alias("performance_id"))
    trusted = (F.col("status") == "SUCCEEDED") & (F.col("version") == version) & (F.col("trust_state") == "TRUSTED")
    p = performance.select("performance_id", F.col("wallet").alias("_of"), trusted.alias("_trusted"))
    led = first.join(p.hint("merge"), "performance_id").select("run_id", "wallet", ((F.col("_of") == F.col("wallet")) & F.col("_trusted")).alias("_led"))
    r = runs.join(led.hint("merge"), ["run_id", "wallet"], "left").select("run_id", F.col("wallet").alias("_run_wallet"), F.col("coin").alias("_run_coin"), "_led")
    rows = events.join(r.hint("merge"), "run_id", "left").join(large, "run_id", "left")
    ok = (F.col("_run_wallet") == F.col("wallet")) & (F.col("_run_coin") == F.col("coin")) & F.col("_led")
    issue = F.when(F.col("_scopes").isNotNull(), "TOO_MANY_SCOPES").when(~F.coalesce(ok, F.lit(False)), "GENERATION_PROVENANCE")
    return rows.withColumn("issue", issue).filter("issue IS NOT NULL").select("event_id", "issue")


def located_issues(issues: DataFrame, wallets: DataFrame, sources: DataFrame) -> DataFrame:
    """Issues (wallet) with their wallet's address and source (source_id) and the source's key."""
    return issues.join(wallets.select("wallet", "address", "source_id"), "wallet").join(sources.select("source_id", "source_key"), "source_id")


# --- summaries ---------------------------------------------------------------------------------------------


def nav_summary(days: DataFrame, keys: Sequence[str], *, day: str = "day", nav: str = "nav") -> DataFrame:
    """Per key: days, least and largest value, and the first and last day with their values."""
    at = F.struct(day, nav)
    return days.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_days"), F.min(nav).alias("least_nav"), F.max(nav).alias("largest_nav"), F.min(day).alias("first_day"), F.min_by(nav, at).alias("first_nav"), F.max(day).alias("last_day"), F.max_by(nav, at).alias("last_nav"))


def cycle_summary(cycles: DataFrame, keys: Sequence[str], *, pnl: str = "net_pnl") -> DataFrame:
    """Per key: cycles in all, open, closed, and closed with profit and with loss."""
    closed = F.col("state") == "CLOSED"
    return cycles.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cycles"), F.count_if(F.col("state") == "OPEN").alias("n_open"), F.count_if(closed).alias("n_closed"), F.count_if(closed & (F.col(pnl) > 0)).alias("n_profitable"), F.count_if(closed & (F.col(pnl) < 0)).alias("n_losing"))


def wallet_audit(wallets: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per wallet the rows of each table, as n_<name>; each table is counted before it is joined."""
    out = wallets
    for name, rows in tables.items():
        out = out.join(rows.groupBy("wallet").agg(F.count(F.lit(1)).alias(f"n_{name}")), "wallet", "left")
    return out.fillna(0, [f"n_{name}" for name in tables])


def discovery_stats(candidates: DataFrame, trades: DataFrame, issues: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Per source: candidates waiting, passed and excluded, trades received, those received again, the last event, open issues.

    ``candidates``: enrichment_status, filter_status; ``trades``: trade_id, ts; ``issues``: status."""
    enrichment, passed = F.col("enrichment_status"), F.col("filter_status")
    c = candidates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if(enrichment.isin("QUEUED", "RUNNING")).alias("n_waiting"), F.count_if(enrichment == "SUCCEEDED").alias("n_enriched"), F.count_if(enrichment == "FAILED").alias("n_failed"),
        F.count_if(passed.isin("ELIGIBLE", "PROMOTED")).alias("n_passed"), F.count_if(passed == "EXCLUDED").alias("n_excluded"),
    )
    own = trades.groupBy(*keys, "trade_id").agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_ts"))
    t = own.groupBy(*keys).agg(F.sum("_n").alias("n_received"), F.sum(F.col("_n") - 1).alias("n_duplicates"), F.max("_ts").alias("last_event_at"))
    i = issues.filter("status = 'OPEN'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_open_issues"))
    return c.join(t, list(keys), "full").join(i, list(keys), "full").fillna(0, ["n_candidates", "n_waiting", "n_enriched", "n_failed", "n_passed", "n_excluded", "n_received", "n_duplicates", "n_open_issues"])


def metric_period(rows: DataFrame, keys: Sequence[str], *, start: str = "from_text", end: str = "to_text") -> DataFrame:
    """Per key the earliest start and the latest end among texts that are times; neither unless there are both."""
    out = rows.groupBy(*keys).agg(F.min(F.col(start).try_cast("timestamp_ntz")).alias("_from"), F.max(F.col(end).try_cast("timestamp_ntz")).alias("_to"))
    both = F.col("_from").isNotNull() & F.col("_to").isNotNull()
    return out.select(*keys, F.when(both, F.col("_from")).alias("period_from"), F.when(both, F.col("_to")).alias("period_to"))


def ranked(rows: DataFrame, *, rank: str = "rank", address: str = "address") -> DataFrame:
    """Rows with a rank, with their ``place`` by it and then by address; selected rows only, so few."""
    return rows.filter(F.col(rank).isNotNull()).withColumn("place", F.row_number().over(Window.orderBy(rank, address)))


def lane_availability(metrics: DataFrame, keys: Sequence[str], *, ok: Column, start: str, end: str, reason: str) -> DataFrame:
    """Per lane: AVAILABLE, PARTIAL or UNAVAILABLE, first start, last end, values and sorted reasons."""
    state = F.when(F.bool_and(ok), "AVAILABLE").when(F.bool_or(ok), "PARTIAL").otherwise("UNAVAILABLE")
    return metrics.groupBy(*keys).agg(state.alias("status"), F.min(start).alias("first_from"), F.max(end).alias("last_to"), F.count(F.lit(1)).alias("n"), F.concat_ws(",", F.array_sort(F.collect_set(reason))).alias("reasons"))


def merged_warnings(shown: DataFrame, newer: DataFrame, meanings: DataFrame, keys: Sequence[str], *, most: int = 3) -> DataFrame:
    """The ``most`` weightiest warnings of each key: ``shown`` (code, scope) less the meanings that ``newer`` (code) shows, codes read
    by ``meanings`` (code, meaning, priority; few rows), scopes joined; ``n_more`` is what is left out."""
    def read(df: DataFrame) -> DataFrame:
        return df.join(meanings, "code")

    own = read(shown).groupBy(*keys, "meaning").agg(F.min("priority").alias("priority"), F.concat_ws(",", F.array_sort(F.collect_set("scope"))).alias("scopes"))
    left = own.join(read(newer).select(*keys, "meaning").distinct(), [*keys, "meaning"], "left_anti")
    key = Window.partitionBy(*keys)
    left = left.withColumns({"place": F.row_number().over(key.orderBy("priority", "meaning")), "_all": F.count(F.lit(1)).over(key)}).filter(F.col("place") <= most)
    return left.select(*keys, "place", "meaning", "scopes", F.greatest(F.col("_all") - most, F.lit(0)).alias("n_more"))


def signal_report(signals: DataFrame, keys: Sequence[str] = ("coin",)) -> DataFrame:
    """Per coin: signals dominated by buying, by selling, balanced, mixed and without any, and the latest net signal."""
    buy, sell = F.col("buy_strength"), F.col("sell_strength")
    some = F.col("mass") > 0
    return signals.groupBy(*keys).agg(
        F.count_if(some & (buy > sell)).alias("n_buy"), F.count_if(some & (sell > buy)).alias("n_sell"), F.count_if(some & (buy == sell)).alias("n_balanced"), F.count_if(F.col("n_mixed") > 0).alias("n_mixed"),
        F.count_if(~some).alias("n_none"), F.max("bucket").alias("latest_bucket"), F.max_by("net_signal", "bucket").alias("latest_net"),
    )


def continuity_report(buckets: DataFrame, changes: DataFrame, keys: Sequence[str] = ("coin",), *, minutes: int = 15) -> DataFrame:
    """Per coin: buckets (bucket), gaps, missing slots, the longest run, and the newest change (bucket, event_type) other than NONE."""
    order = Window.partitionBy(*keys).orderBy("bucket")
    seconds = F.unix_timestamp(F.col("bucket").cast("timestamp"))
    slots = (seconds - F.lag(seconds).over(order)) / (60 * minutes) - 1
    rows = buckets.select(*keys, "bucket").distinct().withColumn("_missing", F.coalesce(slots, F.lit(0.0))).withColumn("_run", F.sum((F.col("_missing") > 0).cast("int")).over(order))
    runs = rows.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_n"), F.sum("_missing").alias("_missing"), F.min("bucket").alias("_from"))
    sums = runs.groupBy(*keys).agg(F.sum("_n").alias("n_buckets"), (F.count(F.lit(1)) - 1).alias("n_gaps"), F.sum("_missing").cast("long").alias("n_missing"), F.max(F.struct("_n", F.col("_from").alias("_f"))).alias("_longest"))
    newest = changes.filter("event_type <> 'NONE'").groupBy(*keys).agg(F.max_by("event_type", F.struct("bucket", "event_type")).alias("newest_event"), F.max("bucket").alias("newest_at"))
    return sums.join(newest, list(keys), "left").select(*keys, "n_buckets", "n_gaps", "n_missing", F.col("_longest._n").alias("longest_run"), F.col("_longest._f").alias("longest_from"), "newest_event", "newest_at")


def unchanged(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows of both tables, and whether their order-free checksums are equal."""
    b, a = (table_fingerprint(t, columns).select(F.lit(1).alias("_k"), F.col("n_rows").alias(f"n_{side}"), F.col("checksum").alias(f"_{side}")) for t, side in ((before, "before"), (after, "after")))
    return b.join(a, "_k").select("n_before", "n_after", (F.col("n_before").eqNullSafe(F.col("n_after")) & F.col("_before").eqNullSafe(F.col("_after"))).alias("is_unchanged"))


# --- manifests ---------------------------------------------------------------------------------------------


def gap_manifest(gaps: DataFrame) -> DataFrame:
    """Gaps (issue_id, fingerprint, wallet, start_at, boundary_id, end_at) with ``error_code``, and the ``place`` by (wallet, start,
    fingerprint) within the wallet and ``row_hash`` of those that are sound."""
    def twice(c: str):
        return F.count(F.lit(1)).over(Window.partitionBy(c)) > 1

    error = F.when(F.col("boundary_id").isNull() | F.col("end_at").isNull(), "NO_END_BOUNDARY").when(F.col("end_at") <= F.col("start_at"), "INVALID_TIME_RANGE").when(twice("issue_id") | twice("fingerprint"), "DUPLICATE_IDENTITY")
    rows = gaps.withColumn("error_code", error)
    place = F.row_number().over(Window.partitionBy("wallet", F.col("error_code").isNull()).orderBy("start_at", "fingerprint"))
    line = F.concat_ws("|", *(F.col(c).cast("string") for c in ("wallet", "issue_id", "fingerprint", "boundary_id")), *(F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start_at", "end_at")))
    sound = F.col("error_code").isNull()
    return rows.withColumns({"place": F.when(sound, place), "row_hash": F.when(sound, F.sha2(line, 256))})


def candidate_manifest(candidates: DataFrame, fills: DataFrame, coverage: DataFrame, days: DataFrame, sources: DataFrame, issues: DataFrame, *, limit: int, most_fills: int, least_days: int) -> DataFrame:
    """The first ``limit`` candidates (wallet, score, available_from, available_to) whose free data suffice, as wallet, ``reason`` (null
    for those), and ``place``; the others have the first reason against them.

    ``coverage``: wallet, lane, proven; ``days``: wallet, day; ``sources``: wallet, ts, the funding and ledger times;
    ``issues``: wallet (open ones). Of each coin the executions of its first instant must be one that starts flat.
    """
    first = fills.groupBy("wallet", "coin", "ts").agg(F.count(F.lit(1)).alias("_n"), F.min("start_position").alias("_sp")).groupBy("wallet", "coin").agg(F.min_by(F.struct("_n", "_sp"), "ts").alias("_b"), F.min("ts").alias("_at"), F.sum("_n").alias("_fills"))
    bad = (F.col("_b._n") != 1) | (F.col("_b._sp") != 0)
    trades = first.groupBy("wallet").agg(F.max(bad).alias("_bad"), F.sum("_fills").alias("_fills"), F.min("_at").alias("_first_fill"))
    lanes = coverage.groupBy("wallet").agg(F.min(F.when(F.col("lane") == "fills", F.col("proven"))).alias("_fills_proven"), F.min(F.when(F.col("lane") != "fills", F.col("proven"))).alias("_lanes_proven"))
    other = sources.groupBy("wallet").agg(F.min("ts").alias("_first_other"))
    nav = day_gaps(days, ["wallet"], "day").join(days.groupBy("wallet").agg(F.min("day").alias("_first_day")), "wallet")
    rows = candidates.join(issues.select("wallet").distinct().withColumn("_issue", F.lit(True)), "wallet", "left")
    for part in (trades, lanes, other, nav):
        rows = rows.join(part, "wallet", "left")
    earliest = F.least("_first_fill", "_first_other").cast("date")
    reason = (
        F.when((F.col("score") != 100) | F.col("available_from").isNull() | F.col("available_to").isNull() | F.coalesce("_issue", F.lit(False)), "NOT_A_CANDIDATE")
        .when(F.coalesce(F.col("_bad"), F.lit(True)) | ~F.coalesce("_fills_proven", F.lit(False)) | (F.col("_fills") > most_fills), "UNTRUSTED_INITIAL_POSITION_BOUNDARY")
        .when(~F.coalesce("_lanes_proven", F.lit(False)), "UNTRUSTED_SOURCE_LANE_BOUNDARY").when(F.coalesce(F.col("_first_day") > earliest, F.lit(True)), "UNTRUSTED_NAV_BOUNDARY")
        .when((F.col("n_gaps") > 0) | (F.col("n_days") < least_days), "UNTRUSTED_NAV_CONTINUITY")
    )
    rows = rows.select("wallet", reason.alias("reason"))
    best = rows.filter("reason is null").orderBy("wallet").limit(limit)
    placed = best.withColumn("place", F.row_number().over(Window.orderBy("wallet")))  # ``limit`` rows
    return placed.unionByName(rows.filter("reason is not null").withColumn("place", F.lit(None).cast("int")))


def weight_inputs(members: DataFrame, latest: DataFrame, runs: DataFrame, metrics: DataFrame, required: Sequence[str]) -> DataFrame:
    """Cohort members (cohort, wallet, run_id) with their required metrics as columns, and ``error_code``, which is that of the
    whole cohort: if one member fails no member has inputs.

    ``latest``: wallet, run_id, the current trusted run; ``runs``: run_id, wallet, status, trust_state, n_closed;
    ``metrics``: run_id, metric, value.
    """
    wide = metrics.filter(F.col("metric").isin(*required)).groupBy("run_id").pivot("metric", list(required)).agg(F.max("value"))
    own = members.join(latest.select("wallet", F.col("run_id").alias("_latest")), "wallet", "left").join(runs.withColumnRenamed("wallet", "_of"), "run_id", "left").join(wide, "run_id", "left")
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required])
    sound = (F.col("trust_state") == "TRUSTED") & (F.col("status") == "SUCCEEDED") & (F.col("_of") == F.col("wallet")) & (F.col("n_closed") > 0) & whole
    error = F.when(F.col("run_id").isNull(), "MISSING_PERFORMANCE_PROVENANCE").when(~F.coalesce(F.col("_latest") == F.col("run_id"), F.lit(False)), "STALE_SELECTION_EVIDENCE").when(~F.coalesce(sound, F.lit(False)), "INVALID_PERFORMANCE_EVIDENCE")
    rows = own.withColumn("_error", error)
    key = Window.partitionBy("cohort")
    rows = rows.withColumn("error_code", F.when(F.count(F.lit(1)).over(key) > 200, "COHORT_BOUND_EXCEEDED").otherwise(F.min("_error").over(key)))
    return rows.select("cohort", "wallet", "run_id", *(F.when(F.col("error_code").isNull(), F.col(c)).alias(c) for c in required), "error_code")


# --- streams' bookkeeping ----------------------------------------------------------------------------------


def progress(events: DataFrame, keys: Sequence[str], *, known: DataFrame | None = None) -> DataFrame:
    """Per scope the high-water mark (last_at, last_id) and ``status`` after ``events`` (ts, id, status), on top of ``known`` marks of the
    same columns. The mark never goes back; GAP_DETECTED, once seen, stays."""
    new = events.groupBy(*keys).agg(F.max(F.struct("ts", "id")).alias("_m"), F.max(F.col("status") == "GAP_DETECTED").alias("_gap"))
    if known is not None:
        old = known.select(*keys, F.struct(F.col("last_at").alias("ts"), F.col("last_id").alias("id")).alias("_m"), (F.col("status") == "GAP_DETECTED").alias("_gap"))
        new = new.unionByName(old).groupBy(*keys).agg(F.max("_m").alias("_m"), F.max("_gap").alias("_gap"))
    return new.select(*keys, F.col("_m.ts").alias("last_at"), F.col("_m.id").alias("last_id"), F.when(F.col("_gap"), "GAP_DETECTED").otherwise("SUCCEEDED").alias("status"))


def connection_gaps(control: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gaps of a stream from its control events (ts, id, kind: CONNECTED, DISCONNECTED or EVENT): from each disconnect, or from
    the last event before a start without one, to the next connection (null while it lasts), and its fingerprint."""
    order = Window.partitionBy(*keys).orderBy("ts", "id")
    marks = control.withColumns({"_kind": F.lag("kind").over(order), "_at": F.lag("ts").over(order), "_next": F.lead("ts").over(order)})
    down = (F.col("kind") == "DISCONNECTED") & F.coalesce(F.col("_kind") != "DISCONNECTED", F.lit(True))
    back = F.first(F.when(F.col("kind") == "CONNECTED", F.col("ts")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    marks = marks.withColumn("_back", back)
    start = (F.col("kind") == "CONNECTED") & (F.col("_kind") == "EVENT") & (F.col("_at") < F.col("ts"))
    rows = marks.filter(down | start).select(*keys, F.when(start, F.col("_at")).otherwise(F.col("ts")).alias("gap_from"), F.when(start, F.col("ts")).otherwise(F.col("_back")).alias("gap_to"), F.when(start, "STARTUP").otherwise("DISCONNECT").alias("origin"))
    return rows.withColumn("fingerprint", F.sha2(F.concat_ws(":", F.lit("GAP"), *(F.col(k).cast("string") for k in keys), F.date_format("gap_from", "yyyy-MM-dd HH:mm:ss.SSSSSS")), 256))


def metric_errors(stats: DataFrame) -> DataFrame:
    """Trade statistics one by one: wallet, metric, value, error_code. Unlike the row of all, a rate without cycles, an average
    without such cycles and a factor without losses fail by name."""
    none, zero = F.col("n_cycles") == 0, F.lit("ZERO_DENOMINATOR")
    rules = {
        "win_rate": F.when(none, "INSUFFICIENT_HISTORY"), "average_win": F.when(F.col("n_wins") == 0, zero), "average_loss": F.when(F.col("n_losses") == 0, zero),
        "profit_factor": F.when(F.col("n_losses") == 0, zero), "top_trade_share": F.when(F.col("n_wins") == 0, zero), "max_losing_streak": F.when(none, "INSUFFICIENT_HISTORY"),
    }
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.when(e.isNull(), F.col(m).cast("double")).alias("value"), e.alias("error_code")) for m, e in rules.items()))
    return stats.select("wallet", F.explode(cells).alias("c")).select("wallet", "c.*")


def manifest_gate(rows: DataFrame) -> DataFrame:
    """``reasons`` against manifest rows (wallet, score, n_discovered, n_fills, n_days, n_boundaries, n_flat, nav_from, source_from)."""
    why = reasons(
        (F.count(F.lit(1)).over(Window.partitionBy("wallet")) > 1, "DUPLICATE_IDENTITY"), (F.col("score") != 100, "QUALITY_SCORE"),
        ((F.col("n_discovered") <= 0) | (F.col("n_fills") <= 0) | (F.col("n_days") <= 0), "EMPTY_COUNT"), ((F.col("n_boundaries") == 0) | (F.col("n_flat") != F.col("n_boundaries")), "BOUNDARY_NOT_FLAT"),
        (F.coalesce(F.col("nav_from").cast("date") > F.col("source_from").cast("date"), F.lit(True)), "NAV_BOUNDARY"),
    )
    return rows.withColumn("reasons", F.concat_ws(",", why))
