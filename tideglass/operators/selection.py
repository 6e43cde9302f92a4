"""Wallet selection and candidate discovery policies; each verdict carries its reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..envelope import reasons
from ..functions.scalar import ADDRESS


def _fraction(value: float, name: str) -> None:
    if not 0 <= value <= 1:
        raise ValueError(f"{name} must be from 0 to 1")


@dataclass(frozen=True)
class ReturnPolicy:
    """Selection by return: limits of the first policy version."""

    most: int = 100
    least_days: int = 90
    least_cycles: int = 20
    least_return: float = 0.0
    most_drawdown: float = 0.5
    most_top_share: float = 0.75
    most_age_hours: int = 24

    def __post_init__(self) -> None:
        _fraction(self.most_drawdown, "most_drawdown")
        _fraction(self.most_top_share, "most_top_share")
        if min(self.most, self.least_days, self.least_cycles, self.most_age_hours) < 0:
            raise ValueError("counts must not be negative")


@dataclass(frozen=True)
class TradePolicy:
    """Selection by trade history: limits of the second policy version."""

    most: int = 100
    least_cycles: int = 30
    least_win_rate: float = 0.55
    least_profit_factor: float = 1.0
    most_top_share: float = 0.5
    most_age_hours: int = 24

    def __post_init__(self) -> None:
        _fraction(self.least_win_rate, "least_win_rate")
        _fraction(self.most_top_share, "most_top_share")
        if min(self.most, self.least_cycles, self.most_age_hours) < 0:
            raise ValueError("counts must not be negative")


def _ranked(df: DataFrame, review: Column, excluded: Column, order: list[Column], most: int) -> DataFrame:
    """REVIEW before EXCLUDED before QUALIFIED; the first ``most`` qualified are SELECTED and have a rank.

    Only the ``most`` selected rows meet in one task, to be numbered.
    """
    rows = df.withColumns({"_review": review, "_excluded": excluded})
    state = F.when(F.size("_review") > 0, "REVIEW").when(F.size("_excluded") > 0, "EXCLUDED").otherwise("QUALIFIED")
    why = F.when(F.size("_review") > 0, F.col("_review")).otherwise(F.col("_excluded"))
    rows = rows.withColumn("state", state).withColumn("reasons", F.concat_ws(",", why)).drop("_review", "_excluded")
    good = rows.filter("state = 'QUALIFIED'")
    top = good.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("state", F.lit("SELECTED"))
    rest = rows.join(top.select("wallet"), "wallet", "left_anti").withColumn("rank", F.lit(None).cast("int"))
    return top.unionByName(rest)


def select_by_return(runs: DataFrame, policy: ReturnPolicy) -> DataFrame:
    """``runs``: wallet, has_run, completeness, annual_return, n_days, max_drawdown, top_share, n_cycles, age_hours.

    A wallet's missing return skips the test of its period; ages below 0 (synced later) are fresh.
    """
    ready = F.col("has_run")
    missing = F.col("annual_return").isNull() | F.col("max_drawdown").isNull() | F.col("top_share").isNull()
    review = F.when(~ready, F.array(F.lit("NO_PERFORMANCE_RUN"))).otherwise(reasons(
        (F.col("completeness") != "COMPLETE", "HISTORY_INCOMPLETE"), (F.col("annual_return").isNotNull() & (F.col("n_days") < policy.least_days), "EVALUATION_PERIOD_TOO_SHORT"),
        (F.col("n_cycles") < policy.least_cycles, "TOO_FEW_COMPLETED_TRADES"), (missing, "REQUIRED_METRIC_MISSING"), (F.coalesce(F.col("age_hours") > policy.most_age_hours, F.lit(True)), "DATA_STALE"),
    ))
    excluded = reasons((F.col("annual_return") < policy.least_return, "RETURN_BELOW_MINIMUM"), (F.abs("max_drawdown") > policy.most_drawdown, "DRAWDOWN_TOO_HIGH"), (F.col("top_share") > policy.most_top_share, "PROFIT_TOO_CONCENTRATED"))
    return _ranked(runs, review, excluded, [F.desc("annual_return"), F.abs("max_drawdown"), F.desc("n_cycles"), F.col("wallet")], policy.most)


def select_by_trades(runs: DataFrame, policy: TradePolicy) -> DataFrame:
    """``runs``: wallet, has_run, evaluable, n_cycles, win_rate, profit_factor, top_share, average_win,
    average_loss, losing_streak, age_hours; ages below 0 are stale here."""
    needed = ["win_rate", "profit_factor", "top_share", "average_win", "average_loss", "losing_streak"]
    missing = F.array_contains(F.array(*(F.col(c).isNull() for c in needed)), True)
    valid = (F.col("average_loss") < 0) & (F.col("average_win") > 0) & (F.col("losing_streak") >= 0) & (F.col("profit_factor") >= 0) & F.col("top_share").between(0, 1) & F.col("win_rate").between(0, 1)
    stale = ~F.coalesce(F.col("age_hours").between(0, policy.most_age_hours), F.lit(False))
    review = F.when(~F.col("has_run"), F.array(F.lit("NO_PERFORMANCE_RUN"))).otherwise(reasons(
        (~F.col("evaluable"), "TRADE_HISTORY_NOT_EVALUABLE"), (F.col("n_cycles") < policy.least_cycles, "TOO_FEW_COMPLETED_TRADES"),
        (missing, "REQUIRED_METRIC_MISSING"), (~missing & ~valid, "REQUIRED_METRIC_INVALID"), (stale, "DATA_STALE"),
    ))
    excluded = reasons((F.col("win_rate") < policy.least_win_rate, "WIN_RATE_BELOW_MINIMUM"), (F.col("profit_factor") < policy.least_profit_factor, "PROFIT_FACTOR_BELOW_MINIMUM"), (F.col("top_share") > policy.most_top_share, "PROFIT_TOO_CONCENTRATED"))
    # ratios are equal if they differ by the order of their sums alone, which is in proportion to them: so their logarithms are rounded
    factor, share = (F.round(F.ln(c), 12) for c in ("profit_factor", "top_share"))
    return _ranked(runs, review, excluded, [F.desc("win_rate"), F.desc("n_cycles"), F.desc(factor), share, F.col("wallet")], policy.most)


def with_overrides(selected: DataFrame, overrides: DataFrame, *, include: bool = True) -> DataFrame:
    """``effective``: an EXCLUDE override removes a wallet; INCLUDE adds one if ``include`` (else overrides only deny)."""
    rows = selected.join(overrides.select("wallet", "decision"), "wallet", "left")
    forced = F.when(F.col("decision") == "EXCLUDE", False)
    forced = forced.when(F.col("decision") == "INCLUDE", True) if include else forced
    return rows.withColumn("effective", forced.otherwise(F.col("state") == "SELECTED"))


def candidate_rollup(trades: DataFrame, keys: tuple[str, ...] = ("wallet",)) -> DataFrame:
    """Counts, notional sums and extremes, times, sides and distinct coins, days and hours per candidate."""
    n = F.col("notional")
    return trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trades"), F.sum(n).alias("sum_notional"), F.max(n).alias("max_notional"), F.avg(n).alias("avg_notional"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count_if(F.col("side") == "BUY").alias("n_buys"), F.count_if(F.col("side") == "SELL").alias("n_sells"))


def activity(trades: DataFrame, keys: tuple[str, ...] = ("wallet",)) -> DataFrame:
    return trades.groupBy(*keys).agg(F.count_distinct("coin").alias("n_coins"), F.count_distinct(F.date_trunc("day", "ts")).alias("n_days"), F.count_distinct(F.date_trunc("hour", "ts")).alias("n_hours"))


def light_filter(candidates: DataFrame, *, now: Column, least_trades: int, least_notional: float, recent_hours: int, system: Column, watched: Column) -> DataFrame:
    """``eligible`` and ``reasons`` of cheap tests on a candidate's rollup."""
    why = reasons(
        (~F.col("address").rlike(ADDRESS), "INVALID_ADDRESS"), (system, "KNOWN_SYSTEM_ADDRESS"), (watched, "ALREADY_WATCHED_ADDRESS"),
        (F.col("n_trades") < least_trades, "OBSERVED_TRADE_COUNT_BELOW_MINIMUM"), (F.col("sum_notional") < least_notional, "OBSERVED_NOTIONAL_BELOW_MINIMUM"),
        (F.col("last_seen") < now - F.make_dt_interval(hours=F.lit(recent_hours)), "LAST_ACTIVITY_OUTSIDE_LIGHT_WINDOW"),
    )
    return candidates.withColumn("reasons", F.concat_ws(",", why)).withColumn("eligible", F.col("reasons") == "")


def quality_score(truncated: Column, active_days: Column, n_fills: Column, failures: Column) -> Column:
    score = F.lit(100) - F.when(truncated, 30).otherwise(0) - F.when(active_days < 180, 30).otherwise(0) - F.when(n_fills == 0, 30).otherwise(0) - F.least(F.lit(30), failures * 5)
    return F.greatest(F.lit(0), score)


def full_filter(fills: DataFrame, *, now: Column, truncated: Column, least_days: int, least_months: int, least_trades: int, least_notional: float, recent_days: int) -> DataFrame:
    """Per wallet: reasons against its history come first, then those against its volume and recency."""
    notional = F.abs(F.col("price") * F.col("size"))
    per = fills.groupBy("wallet").agg(
        F.count(F.lit(1)).alias("n_fills"), F.sum(notional).alias("sum_notional"), (F.floor((F.unix_millis(F.max("ts").cast("timestamp")) - F.unix_millis(F.min("ts").cast("timestamp"))) / 86_400_000) + 1).alias("active_days"),
        F.count_distinct(F.date_format("ts", "yyyy-MM")).alias("active_months"), F.min_by("start_position", F.struct("ts", "id")).alias("_start"), F.max("ts").alias("last_seen"),
    )
    per = per.withColumn("_truncated", truncated)
    unproven = F.col("_start") != 0
    history = reasons((F.col("_truncated"), "API_HISTORY_LIMIT_REACHED"), (unproven, "NON_FLAT_INITIAL_POSITION_BOUNDARY"), (F.col("active_days") < least_days, "AVAILABLE_ACTIVITY_PERIOD_BELOW_MINIMUM"), (F.col("active_months") < least_months, "AVAILABLE_ACTIVE_MONTHS_BELOW_MINIMUM"))
    volume = reasons((F.col("n_fills") < least_trades, "FULL_TRADE_COUNT_BELOW_MINIMUM"), (F.col("sum_notional") < least_notional, "FULL_NOTIONAL_BELOW_MINIMUM"), (F.col("last_seen") < now - F.make_dt_interval(days=F.lit(recent_days)), "LAST_ACTIVITY_OUTSIDE_FULL_WINDOW"))
    per = per.withColumns({"_history": history, "_volume": volume})
    failed = F.size("_history") > 0
    incomplete = F.col("_truncated") | unproven
    return per.select(
        "wallet", "n_fills", "sum_notional", "active_days", "active_months", F.when(failed, "INSUFFICIENT_HISTORY").when(F.size("_volume") > 0, "EXCLUDED").otherwise("ELIGIBLE").alias("state"),
        F.concat_ws(",", F.when(failed, F.col("_history")).otherwise(F.col("_volume"))).alias("reasons"), F.when(failed, F.when(incomplete, "PARTIAL").otherwise("INSUFFICIENT")).otherwise("COMPLETE").alias("completeness"),
        quality_score(F.when(failed, incomplete).otherwise(F.col("_truncated")), F.col("active_days"), F.col("n_fills"), F.lit(0)).alias("quality_score"),
    )


def actors(trades: DataFrame, buyer: str, seller: str, taker_is_buyer: Column) -> DataFrame:
    """One row per participant of a trade; a self-trade has one row, SELF and TAKER."""
    b = F.struct(F.col(buyer).alias("actor"), F.lit("BUYER").alias("role"), F.when(taker_is_buyer, "TAKER").otherwise("MAKER").alias("liquidity"))
    s = F.struct(F.col(seller).alias("actor"), F.lit("SELLER").alias("role"), F.when(taker_is_buyer, "MAKER").otherwise("TAKER").alias("liquidity"))
    own = F.struct(F.col(buyer).alias("actor"), F.lit("SELF").alias("role"), F.lit("TAKER").alias("liquidity"))
    return trades.withColumn("_a", F.explode(F.when(F.col(buyer) == F.col(seller), F.array(own)).otherwise(F.array(b, s)))).select(*trades.columns, "_a.*")
