"""Net asset values, returns, wealth, drawdown and risk ratios per key. Times order by (ts, id)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import cash_flow_category, cash_flow_external

ANNUAL = 365.0


def daily_nav(points: DataFrame, keys: Sequence[str], *, ts: str = "ts", tie: str = "id", nav: str = "nav", scope: str | None = None) -> DataFrame:
    """Per key and UTC day the last positive value and its time ``at``; days without one carry NON_POSITIVE_NAV. With a column ``scope``, of what the
    values are of, all days of a key that has several are MIXED_SCOPE and have no value."""
    last = F.when(F.col(nav) > 0, F.struct(ts, tie))
    facts = {"nav": F.max_by(F.when(F.col(nav) > 0, F.col(nav)), last), "at": F.max(F.when(F.col(nav) > 0, F.col(ts))), "n_points": F.count(F.lit(1))}
    if scope is not None:
        facts |= {"_least": F.min(scope), "_most": F.max(scope)}
    days = points.groupBy(*keys, F.col(ts).cast("date").alias("day")).agg(*(v.alias(c) for c, v in facts.items()))
    code = F.when(F.col("nav").isNull(), "NON_POSITIVE_NAV")
    if scope is None:
        return days.withColumn("error_code", code)
    whole = Window.partitionBy(*keys)
    mixed = F.min("_least").over(whole) != F.max("_most").over(whole)
    days = days.withColumn("error_code", F.when(mixed, "MIXED_SCOPE").otherwise(code)).drop("_least", "_most")
    return days.withColumns({c: F.when(F.coalesce(F.col("error_code") != "MIXED_SCOPE", F.lit(True)), F.col(c)) for c in ("nav", "at")})


def return_window(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Days from the first positive value up to the first missing date."""
    good = days.filter(F.col("nav") > 0)
    order = Window.partitionBy(*keys).orderBy("day")
    gap = F.coalesce((F.datediff("day", F.lag("day").over(order)) > 1).cast("int"), F.lit(0))
    return good.withColumn("_gap", gap).withColumn("_gaps", F.sum("_gap").over(order)).filter("_gaps = 0").drop("_gap", "_gaps")


def period_returns(days: DataFrame, keys: Sequence[str], at: str = "day") -> DataFrame:
    """Adjacent pairs: period_from, period_to, value = nav / previous - 1, seq from 1."""
    order = Window.partitionBy(*keys).orderBy(at)
    rows = days.select(*keys, F.lag(at).over(order).alias("period_from"), F.col(at).alias("period_to"), F.lag("nav").over(order).alias("_before"), F.col("nav").alias("_after"))
    rows = rows.filter(F.col("_before").isNotNull()).withColumn("value", F.try_divide("_after", "_before") - 1)
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy("period_to"))).drop("_before", "_after")


def split_at_flows(points: DataFrame, flows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return periods around external flows, whose values before and after are known.

    ``points``: ts, nav, regular values. ``flows``: flow_id, ts, before_nav, after_nav, amount, and, if the values have times
    of their own, before_at and after_at. The base of the first period is the last regular value before the first flow;
    every flow closes a period at its value before, and its value after is the next base; the last period ends at the last regular
    value after the last flow. Of regular values of one instant the largest counts, of flows of one instant the smaller id comes first.

    A period in error has no value: NON_POSITIVE_NAV if one of its values is not positive, MISSING_CASH_FLOW_BOUNDARY_NAV, or
    DATA_ORDER_AMBIGUOUS if a flow's value before is older than the base, or its value after older than that.
    """
    for side in ("before_at", "after_at"):
        flows = flows if side in flows.columns else flows.withColumn(side, F.col("ts"))
    at = F.struct("ts", "nav")
    edge = flows.groupBy(*keys).agg(F.min("ts").alias("_first"), F.max_by("after_at", F.struct("ts", "flow_id")).alias("_last"))
    around = points.join(edge, list(keys))
    early, late = F.col("ts") < F.col("_first"), F.col("ts") > F.col("_last")
    ends = around.groupBy(*keys).agg(F.max_by(F.when(early, F.col("nav")), F.when(early, at)).alias("_base"), F.max(F.when(early, F.col("ts"))).alias("_base_at"), F.max_by(F.when(late, F.col("nav")), F.when(late, at)).alias("_end"), F.max(F.when(late, F.col("ts"))).alias("_end_at"))
    order = Window.partitionBy(*keys).orderBy("ts", "flow_id")
    rows = flows.join(ends, list(keys), "left").withColumn("seq", F.row_number().over(order))
    first = F.col("seq") == 1
    rows = rows.withColumns({"period_from": F.when(first, F.col("_base_at")).otherwise(F.lag("after_at").over(order)), "_from_nav": F.when(first, F.col("_base")).otherwise(F.lag("after_nav").over(order))})
    missing = F.col("_from_nav").isNull() | F.col("before_nav").isNull() | F.col("after_nav").isNull() | F.col("amount").isNull()
    bad = F.least("_from_nav", "before_nav", "after_nav") <= 0
    swapped = (F.col("before_at") < F.col("period_from")) | (F.col("after_at") < F.col("before_at"))
    code = F.when(bad, "NON_POSITIVE_NAV").when(missing, "MISSING_CASH_FLOW_BOUNDARY_NAV").when(swapped, "DATA_ORDER_AMBIGUOUS")
    closed = rows.withColumn("error_code", code).select(*keys, "seq", "period_from", F.col("before_at").alias("period_to"), F.when(F.col("error_code").isNull(), F.try_divide("before_nav", "_from_nav") - 1).alias("value"), (F.col("after_nav") - F.col("before_nav") != F.col("amount")).alias("flow_mismatch"), "error_code")
    last = flows.groupBy(*keys).agg((F.count(F.lit(1)) + 1).cast("int").alias("seq"), F.max_by("after_nav", F.struct("ts", "flow_id")).alias("_nav"), F.max_by("after_at", F.struct("ts", "flow_id")).alias("_at")).join(ends, list(keys), "left")
    code = F.when((F.col("_nav") <= 0) | (F.col("_end") <= 0), "NON_POSITIVE_NAV").when(F.col("_end").isNull(), "MISSING_CASH_FLOW_BOUNDARY_NAV")
    tail = last.withColumn("error_code", code).select(*keys, "seq", F.col("_at").alias("period_from"), F.col("_end_at").alias("period_to"), F.when(F.col("error_code").isNull(), F.try_divide("_end", "_nav") - 1).alias("value"), F.lit(False).alias("flow_mismatch"), "error_code")
    return closed.unionByName(tail)


def normalise_flows(flows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``flows`` (flow_id, ts, kind, amount, boundary) with ``category``, ``is_external`` and ``error_code``: an id that a key has
    twice is DUPLICATE_EVENT, a flow that cannot be classed UNKNOWN_CASH_FLOW."""
    rows = flows.withColumn("category", cash_flow_category(F.col("kind")))
    rows = rows.withColumn("is_external", cash_flow_external(F.col("category"), F.col("amount"), F.col("boundary")))
    twice = F.count(F.lit(1)).over(Window.partitionBy(*keys, "flow_id")) > 1
    return rows.withColumn("error_code", F.when(twice, "DUPLICATE_EVENT").when(F.col("is_external").isNull(), "UNKNOWN_CASH_FLOW"))


def with_flow_values(flows: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``flows`` with ``before_nav``, ``before_at``, ``after_nav`` and ``after_at``: the first of ``values`` (flow_id, role, ts, nav)
    in the role FLOW_BEFORE and FLOW_AFTER, and its time; null where there is none."""

    def first(role: str):
        return F.min(F.when(F.col("role") == role, F.struct("ts", "nav")))

    sides = values.groupBy(*keys, "flow_id").agg(first("FLOW_BEFORE").alias("_before"), first("FLOW_AFTER").alias("_after"))
    sides = sides.select(*keys, "flow_id", F.col("_before.nav").alias("before_nav"), F.col("_before.ts").alias("before_at"), F.col("_after.nav").alias("after_nav"), F.col("_after.ts").alias("after_at"))
    return flows.join(sides, [*keys, "flow_id"], "left")


def flow_periods(days: DataFrame, flows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return periods of the daily values ``days`` (at, nav), split at the external ones of ``flows`` (normalised, with values).

    Flows outside a key's first and last day do not count. A key with a flow in error has that error in a period of
    its own, number 0; keys without external flows have periods from day to day.
    """
    keys = list(keys)
    ends = days.groupBy(*keys).agg(F.min("at").alias("_first"), F.max("at").alias("_last"))
    own = flows.join(ends, keys).filter(F.col("ts").between(F.col("_first"), F.col("_last"))).drop("_first", "_last")
    external = own.filter("is_external")
    split = split_at_flows(days.select(*keys, F.col("at").alias("ts"), "nav"), external, keys)
    plain = period_returns(days.join(external.select(*keys).distinct(), keys, "left_anti"), keys, "at").withColumn("error_code", F.lit(None).cast("string"))
    wrong = own.filter("error_code is not null").groupBy(*keys).agg(F.min("error_code").alias("error_code")).withColumns({"seq": F.lit(0), "value": F.lit(None).cast("double")})
    columns = [*keys, "seq", "period_from", "period_to", "value", "flow_mismatch", "error_code"]
    plain = plain.withColumn("flow_mismatch", F.lit(False))
    return split.select(*columns).unionByName(plain.select(*columns)).unionByName(wrong, allowMissingColumns=True)


def period_facts(periods: DataFrame, keys: Sequence[str], *, risk_free: float = 0.0, target: float = 0.0, least: int = 30) -> DataFrame:
    """What the periods of ``flow_periods`` say of each key, from one sort and one pass: error_code, total_return, n, volatility, sharpe,
    sortino, max_drawdown (of the wealth index, which begins at 1) and flow_mismatch.

    The error of a key is that of its number 0, else NON_POSITIVE_NAV if any period has it or loses all, else that of its
    first period in error; then nothing else is told but the count.
    """
    order = Window.partitionBy(*keys).orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lost = F.coalesce(1 + F.col("value") <= 0, F.lit(False))
    code = F.coalesce("error_code", F.when(lost, "NON_POSITIVE_NAV"))
    rows = periods.withColumn("_code", code).withColumn("_wealth", F.product(F.greatest(1 + F.col("value"), F.lit(0.0))).over(upto))
    rows = rows.withColumn("_peak", F.greatest(F.lit(1.0), F.max("_wealth").over(upto)))
    rank = F.when(F.col("seq") == 0, 0).when(F.col("_code") == "NON_POSITIVE_NAV", 1).otherwise(2)
    daily_free, year = (1 + risk_free) ** (1 / ANNUAL) - 1, ANNUAL**0.5
    below = F.least(F.col("value") - target, F.lit(0.0))
    out = rows.groupBy(*keys).agg(
        F.min(F.when(F.col("_code").isNotNull(), F.struct(rank.alias("r"), "seq", "_code")))["_code"].alias("error_code"), F.count("value").alias("n"), (F.product(1 + F.col("value")) - 1).alias("_total"),
        F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_sd"), F.sqrt(F.sum(below * below) / F.count(F.lit(1))).alias("_down"), F.least(F.min(F.col("_wealth") / F.col("_peak") - 1), F.lit(0.0)).alias("_worst"), F.max("flow_mismatch").alias("_mismatch"),
    )
    good = F.col("error_code").isNull()
    long = good & (F.col("n") >= least)
    return out.select(
        *keys, "error_code", "n", F.when(good, F.col("_total")).alias("total_return"), F.when(long, F.col("_sd") * year).alias("volatility"),
        F.when(long & (F.col("_sd") > 0), F.try_divide(F.col("_mean") - daily_free, F.col("_sd")) * year).alias("sharpe"), F.when(long & (F.col("_down") > 0), F.try_divide(F.col("_mean") - target, F.col("_down")) * year).alias("sortino"),
        F.when(good, F.col("_worst")).alias("max_drawdown"), (good & F.coalesce("_mismatch", F.lit(False))).alias("flow_mismatch"),
    )


def compounded(periods: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: the product of 1 + value, less 1; NON_POSITIVE_NAV if a factor is not positive."""
    out = periods.groupBy(*keys).agg((F.product(1 + F.col("value")) - 1).alias("total_return"), F.min(1 + F.col("value")).alias("_least"), F.count(F.lit(1)).alias("n_periods"), F.min("period_from").alias("first_from"), F.max("period_to").alias("last_to"))
    bad = F.col("_least") <= 0
    return out.withColumn("error_code", F.when(bad, "NON_POSITIVE_NAV")).withColumn("total_return", F.when(~bad, F.col("total_return"))).drop("_least")


def annualised(totals: DataFrame) -> DataFrame:
    """(1 + r)^(365 / days) - 1; under 30 days an error, under 180 for reference only."""
    days = F.datediff("last_to", "first_from").cast("double")
    error = F.coalesce("error_code", F.when(days < 30, "INSUFFICIENT_HISTORY"))
    out = totals.withColumn("n_days", days).withColumn("error_code", error)
    value = F.when(F.col("error_code").isNull(), F.pow(1 + F.col("total_return"), F.try_divide(F.lit(ANNUAL), F.col("n_days"))) - 1)
    return out.withColumns({"annualised_return": value, "grade": F.when(F.col("error_code").isNull(), F.when(F.col("n_days") < 180, "REFERENCE_ONLY").otherwise("STANDARD"))})


def wealth_index(periods: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The running product of 1 + value from 1, by sequence number; overlapping periods are marked. A key with a factor that is not
    positive is NON_POSITIVE_NAV, one with an overlap DATA_ORDER_AMBIGUOUS, in column ``wealth_error``; its wealth is null."""
    order, whole = Window.partitionBy(*keys).orderBy("seq"), Window.partitionBy(*keys)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = periods.withColumns({"wealth": F.product(1 + F.col("value")).over(upto), "is_overlap": F.coalesce(F.col("period_from") < F.lag("period_to").over(order), F.lit(False))})
    code = F.when(F.max("is_overlap").over(whole), "DATA_ORDER_AMBIGUOUS").when(F.min(1 + F.col("value")).over(whole) <= 0, "NON_POSITIVE_NAV")
    return rows.withColumn("wealth_error", code).withColumn("wealth", F.when(F.col("wealth_error").isNull(), F.col("wealth")))


def drawdown_series(levels: DataFrame, keys: Sequence[str], *, at: str = "day", level: str = "nav") -> DataFrame:
    """Running peak, the first time it was reached, and level / peak - 1."""
    upto = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = levels.withColumn("peak", F.max(level).over(upto))
    fresh = F.coalesce(F.col("peak") > F.lag("peak").over(Window.partitionBy(*keys).orderBy(at)), F.lit(True))
    return rows.withColumn("peak_at", F.last(F.when(fresh, F.col(at)), ignorenulls=True).over(upto)).withColumn("drawdown", F.try_divide(level, "peak") - 1)


def max_drawdown(series: DataFrame, keys: Sequence[str], *, at: str = "day", level: str = "nav") -> DataFrame:
    """The first deepest drawdown of each key, and the first later time at which its peak was reached again."""
    worst = series.groupBy(*keys).agg(F.min(F.struct(F.col("drawdown"), F.col(at).alias("trough_at"), F.col("peak"), F.col("peak_at"))).alias("_w"))
    worst = worst.select(*keys, F.col("_w.drawdown").alias("max_drawdown"), F.col("_w.peak_at").alias("peak_at"), F.col("_w.trough_at").alias("trough_at"), F.col("_w.peak").alias("_peak"))
    rows = series.select(*keys, F.col(at).alias("_at"), F.col(level).alias("_level")).join(worst.select(*keys, "trough_at", "_peak"), list(keys))
    back = rows.filter((F.col("_at") > F.col("trough_at")) & (F.col("_level") >= F.col("_peak"))).groupBy(*keys).agg(F.min("_at").alias("recovered_at"))
    return worst.drop("_peak").join(back, list(keys), "left").withColumns({"days_to_trough": F.datediff("trough_at", "peak_at"), "days_to_recover": F.datediff("recovered_at", "trough_at")})


def risk(periods: DataFrame, keys: Sequence[str], *, risk_free: float = 0.0, target: float = 0.0, least: int = 30) -> DataFrame:
    """Volatility, Sharpe and Sortino of daily values: sample deviation, downside over all observations."""
    daily_free = (1 + risk_free) ** (1 / ANNUAL) - 1
    below = F.least(F.col("value") - target, F.lit(0.0))
    out = periods.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_sd"), F.sqrt(F.sum(below * below) / F.count(F.lit(1))).alias("_down"))
    error = F.when(F.col("n") < least, "INSUFFICIENT_HISTORY")
    year = ANNUAL**0.5
    return out.select(
        *keys, "n", error.alias("error_code"), F.when(error.isNull(), F.col("_sd") * year).alias("volatility"),
        F.when(error.isNull() & (F.col("_sd") > 0), F.try_divide(F.col("_mean") - daily_free, F.col("_sd")) * year).alias("sharpe"),
        F.when(error.isNull() & (F.col("_down") > 0), F.try_divide(F.col("_mean") - target, F.col("_down")) * year).alias("sortino"),
    )


def calmar(annual: DataFrame, drawdowns: DataFrame, keys: Sequence[str], *, least_days: int = 180) -> DataFrame:
    """Annualised return over the depth of the worst drawdown, from ``least_days`` of history on."""
    rows = annual.join(drawdowns.select(*keys, "max_drawdown"), list(keys))
    error = F.coalesce("error_code", F.when(F.col("n_days") < least_days, "INSUFFICIENT_HISTORY"), F.when(F.col("max_drawdown") == 0, "ZERO_DENOMINATOR"))
    return rows.select(*keys, error.alias("error_code"), F.when(error.isNull(), F.try_divide("annualised_return", F.abs("max_drawdown"))).alias("calmar"))
