"""The performance plan: trade, return and exposure lanes of all wallets, each failing on its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..envelope import coverage_error, coverage_warnings, guarded, reasons
from ..operators import cycles, returns, stats
from ..scratch import materialise

TRADE = ("win_rate", "profit_factor", "average_win", "average_loss", "top_trade_share", "max_losing_streak")
RETURN = ("total_return", "annualised_return", "volatility", "sharpe", "sortino", "max_drawdown")
EXPOSURE = ("largest_share", "hhi")


def long_form(lane: str, rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """wallet, lane, metric, value, error_code: one row per metric, METRIC_UNAVAILABLE where it is null."""
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    own = F.col("error_code") if "error_code" in rows.columns else F.lit(None).cast("string")
    out = rows.select("wallet", own.alias("_error"), F.explode(cells).alias("c"))
    return out.select("wallet", F.lit(lane).alias("lane"), "c.metric", "c.value", F.when(F.col("c.value").isNull(), F.coalesce("_error", F.lit("METRIC_UNAVAILABLE"))).alias("error_code"))


def _failed(lane: str, errors: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The lane's metrics of wallets in error."""
    return errors.select("wallet", F.lit(lane).alias("lane"), F.explode(F.array(*map(F.lit, metrics))).alias("metric"), F.lit(None).cast("double").alias("value"), "error_code")


def trade_lane(fills: DataFrame, *, free: bool = False) -> DataFrame:
    """``free`` as in ``cycles.input_errors``. Wallets whose executions cannot be used have their error in every metric; they leave those of others as they are."""
    errors = materialise(cycles.input_errors(fills, free=free), "fill-errors")
    closed = cycles.profit(cycles.cycles(fills.join(errors, "wallet", "left_anti"))).filter("state = 'CLOSED'")
    return long_form("trade", stats.trade_stats(closed, ["wallet"]), TRADE).unionByName(_failed("trade", errors, TRADE))


def return_lane(points: DataFrame) -> DataFrame:
    days = returns.return_window(returns.daily_nav(points, ["wallet"]), ["wallet"])
    periods = returns.period_returns(days, ["wallet"])
    annual = returns.annualised(returns.compounded(periods, ["wallet"]))
    risks = returns.risk(periods, ["wallet"]).withColumnRenamed("error_code", "_risk_error")
    worst = returns.max_drawdown(returns.drawdown_series(days, ["wallet"]), ["wallet"])
    rows = worst.select("wallet", "max_drawdown").join(annual, "wallet", "left").join(risks, "wallet", "left")
    return long_form("return", rows.withColumn("error_code", F.coalesce("error_code", "_risk_error", F.lit("INSUFFICIENT_HISTORY"))), RETURN)


def flow_return_facts(points: DataFrame, flows: DataFrame, values: DataFrame) -> DataFrame:
    """The return metrics of each wallet where money moves, with ``error_code`` and ``flow_mismatch``: periods are split at external flows
    (wallet, flow_id, ts, kind, amount, boundary), whose values before and after are in ``values`` (wallet, flow_id, role, ts, nav), and
    drawdown is that of the wealth index. A flow that cannot be classed, or whose values are absent, out of order or
    not positive, fails all of its wallet's metrics, and no other wallet's."""
    key = ["wallet"]
    days = materialise(returns.return_window(returns.daily_nav(points, key), key), "nav-days")
    moved = materialise(returns.with_flow_values(returns.normalise_flows(flows, key), values, key), "flows")
    facts = returns.period_facts(returns.flow_periods(days, moved, key), key).withColumnRenamed("error_code", "_own")
    spans = days.groupBy("wallet").agg(F.min("day").alias("first_from"), F.max("day").alias("last_to"))
    rows = returns.annualised(spans.join(facts, "wallet", "left").withColumn("error_code", F.col("_own")))
    return rows.withColumn("error_code", F.coalesce("_own", "error_code", F.lit("INSUFFICIENT_HISTORY")))


def flow_return_lane(points: DataFrame, flows: DataFrame, values: DataFrame) -> DataFrame:
    """``flow_return_facts`` with a row per metric."""
    return long_form("return", flow_return_facts(points, flows, values), RETURN)


def exposure_lane(fills: DataFrame) -> DataFrame:
    return long_form("exposure", stats.concentration(fills.withColumn("notional", F.col("price") * F.col("size")), ["wallet"], "coin"), EXPOSURE)


def flowless_performance(fills: DataFrame, points: DataFrame, *, free: bool = False) -> DataFrame:
    """All metrics of wallets that money neither enters nor leaves: a deposit would count as profit here, ``covered_performance`` is
    for those. A wallet without a metric is simply absent from that lane."""
    return trade_lane(fills, free=free).unionByName(return_lane(points)).unionByName(exposure_lane(fills))


def covered_performance(fills: DataFrame, points: DataFrame, flows: DataFrame, values: DataFrame, coverage: DataFrame, *, free: bool = False) -> DataFrame:
    """The same with cash flows, and held against ``coverage`` (wallet, completeness, initial_state_known, explicit_gap).

    A gap that only missing days of value cause counts as PARTIAL outside the return lane, whose own window ends at
    it. Metrics of histories that do not suffice are null with the reason; those of partial ones carry a
    PARTIAL_HISTORY warning, returns of wallets a flow of which does not equal the change of value it made a
    CASH_FLOW_NAV_MISMATCH one. A wallet that ``coverage`` does not know is INSUFFICIENT_HISTORY.
    """
    facts = materialise(flow_return_facts(points, flows, values), "return-facts")
    metrics = trade_lane(fills, free=free).unionByName(long_form("return", facts, RETURN)).unionByName(exposure_lane(fills))
    rows = metrics.withColumnRenamed("error_code", "_own").join(coverage, "wallet", "left").join(facts.filter("flow_mismatch").select("wallet", "flow_mismatch"), "wallet", "left")
    state = F.coalesce("completeness", F.lit("INSUFFICIENT_HISTORY"))
    soft = F.when(F.col("lane") == "return", F.when(state == "COMPLETE", state).otherwise("PARTIAL")).when((state == "GAP_DETECTED") & ~F.coalesce("explicit_gap", F.lit(False)), "PARTIAL").otherwise(state)
    mismatch = (F.col("lane") == "return") & F.coalesce("flow_mismatch", F.lit(False)) & F.col("value").isNotNull()
    rows = rows.withColumn("_state", soft).withColumn("warnings", F.concat_ws(",", F.concat(coverage_warnings(F.col("_state")), reasons((mismatch, "CASH_FLOW_NAV_MISMATCH")))))
    known = (F.col("lane") == "return") | F.col("initial_state_known")
    return guarded(rows, F.coalesce(coverage_error(F.col("_state"), known), F.col("_own")), "value").select("wallet", "lane", "metric", "value", "error_code", "warnings")


def overview(metrics: DataFrame) -> DataFrame:
    """Per wallet: metrics and failures by lane, and INSUFFICIENT_DATA if nothing could be computed."""
    out = metrics.groupBy("wallet").agg(*(F.count_if((F.col("lane") == lane) & F.col("value").isNotNull()).alias(f"n_{lane}") for lane in ("trade", "return", "exposure")), F.count_if(F.col("error_code").isNotNull()).alias("n_failed"))
    return out.withColumn("status", F.when(F.col("n_trade") + F.col("n_return") + F.col("n_exposure") == 0, "INSUFFICIENT_DATA").otherwise("SUCCEEDED"))
