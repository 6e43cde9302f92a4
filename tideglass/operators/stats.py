"""Trade statistics of closed cycles, leverage and concentration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _runs(closed: DataFrame, keys: Sequence[str], order: Sequence[str], pnl: str) -> DataFrame:
    """Adds ``_run``: rows between two non-losses have equal running counts of non-losses."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return closed.withColumn("_run", F.sum((F.col(pnl) >= 0).cast("int")).over(upto))


def losing_streak(closed: DataFrame, keys: Sequence[str], *, order: Sequence[str] = ("closed_at", "cycle_id"), pnl: str = "net_pnl") -> DataFrame:
    """Per key the longest run of losses."""
    runs = _runs(closed, keys, order, pnl).groupBy(*keys, "_run").agg(F.count_if(F.col(pnl) < 0).alias("_n"))
    return runs.groupBy(*keys).agg(F.max("_n").alias("max_losing_streak"))


def trade_stats(closed: DataFrame, keys: Sequence[str], *, order: Sequence[str] = ("closed_at", "cycle_id"), pnl: str = "net_pnl") -> DataFrame:
    """Wins, losses, rates, averages, profit factor (null without losses), the largest win's share of wins and the longest
    losing streak, in one pass: sums per run of losses, then per key."""
    p = F.col(pnl)
    runs = _runs(closed, keys, order, pnl).groupBy(*keys, "_run").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(p > 0).alias("_won"), F.count_if(p < 0).alias("_lost"), F.sum(F.when(p > 0, p)).alias("_gain"), F.sum(F.when(p < 0, p)).alias("_loss"), F.max(F.when(p > 0, p)).alias("_most"), F.sum(p).alias("_all"),
    )
    won, lost, n, gain, loss = (F.sum(c) for c in ("_won", "_lost", "_n", "_gain", "_loss"))
    return runs.groupBy(*keys).agg(
        n.alias("n_cycles"), won.alias("n_wins"), lost.alias("n_losses"), (n - won - lost).alias("n_even"), (won / n).alias("win_rate"), F.when(won > 0, F.try_divide(gain, won)).alias("average_win"), F.when(lost > 0, F.try_divide(loss, lost)).alias("average_loss"),
        F.when(lost > 0, F.try_divide(F.coalesce(gain, F.lit(0.0)), -loss)).alias("profit_factor"), F.when(won > 0, F.try_divide(F.max("_most"), gain)).alias("top_trade_share"), F.sum("_all").alias("total_pnl"), F.max("_lost").alias("max_losing_streak"),
    )


def leverage(snapshots: DataFrame, keys: Sequence[str], *, notional: str = "notional", equity: str = "equity") -> DataFrame:
    """Effective leverage |notional| / equity: mean, median, 95th percentile (linear), maximum; equity must be positive."""
    x = F.when(F.col(equity) > 0, F.try_divide(F.abs(notional), F.col(equity)))
    return snapshots.withColumn("_x", x).groupBy(*keys).agg(F.count("_x").alias("n"), F.count_if(F.col("_x").isNull()).alias("n_invalid"), F.avg("_x").alias("mean_leverage"), F.percentile("_x", F.lit(0.5)).alias("p50_leverage"), F.percentile("_x", F.lit(0.95)).alias("p95_leverage"), F.max("_x").alias("max_leverage"))


def concentration(exposures: DataFrame, keys: Sequence[str], coin: str, *, notional: str = "notional") -> DataFrame:
    """Largest share and Herfindahl index of |notional| over coins; a key whose exposure is zero is ZERO_DENOMINATOR."""
    by_coin = exposures.groupBy(*keys, coin).agg(F.sum(F.abs(notional)).alias("_n"))
    share = by_coin.withColumn("_share", F.try_divide("_n", F.sum("_n").over(Window.partitionBy(*keys))))
    out = share.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_coins"), F.max("_share").alias("largest_share"), F.sum(F.col("_share") * F.col("_share")).alias("hhi"), F.max_by(coin, F.struct("_share", coin)).alias("largest_coin"))
    return out.withColumn("error_code", F.when(F.col("largest_share").isNull(), "ZERO_DENOMINATOR"))
