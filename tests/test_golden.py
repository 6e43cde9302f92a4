"""Hand-computed cases of the trading operators."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tideglass import envelope
from tideglass.functions import scalar as S
from tideglass.operators import cohort, cycles, relational, returns, selection, stats
from tideglass.sources import sinks, tables

T0 = datetime(2024, 1, 1)
FILL = "wallet long, coin string, id string, ts timestamp_ntz, side string, size double, price double, start_position double, closed_pnl double, fee double"


def fills(spark, rows):
    """(side, size, price[, official profit, fee]) with positions that follow each other."""
    at, out = 0.0, []
    for i, (side, size, price, *rest) in enumerate(rows):
        pnl, fee = (rest + [0.0, 0.0])[:2]
        out.append((1, "BTC", f"{i:03d}", T0 + timedelta(minutes=i), side, float(size), float(price), at, float(pnl), float(fee)))
        at += size if side == "BUY" else -size
    return as_fills(spark, out)


def as_fills(spark, rows):
    return spark.createDataFrame(rows, FILL).withColumn("delta", S.signed_delta(F.col("side"), F.col("size")))


def profit(spark, rows):
    return cycles.profit(cycles.cycles(fills(spark, rows))).orderBy("cycle").collect()


def test_long_win_short_loss_and_fees(spark):
    [won] = profit(spark, [("BUY", 1, 100, 0, 1), ("SELL", 1, 120, 20, 1)])
    assert (won.side, won.state, won.net_pnl, won.recomputed_pnl, won.closed_pnl_mismatch) == ("LONG", "CLOSED", 18.0, 20.0, False)
    [lost] = profit(spark, [("SELL", 1, 100), ("BUY", 1, 120, -20)])
    assert (lost.side, lost.net_pnl, lost.recomputed_pnl) == ("SHORT", -20.0, -20.0)


def test_partial_closes_and_mismatch(spark):
    [c] = profit(spark, [("BUY", 2, 100), ("SELL", 1, 110, 10), ("SELL", 1, 120, 19)])
    assert (c.official_pnl, c.recomputed_pnl, c.closed_pnl_mismatch, c.exit_price) == (29.0, 30.0, True, 115.0)


def test_average_entry_ignores_reductions(spark):
    [c] = profit(spark, [("BUY", 1, 100), ("BUY", 1, 110), ("SELL", 1, 120), ("BUY", 1, 130)])
    assert (c.entry_price, c.state) == (117.5, "OPEN")


def test_reversal_splits_fee_and_profit(spark):
    a, b = profit(spark, [("BUY", 1, 100), ("SELL", 2, 90, -10, 4), ("BUY", 1, 80, 10)])
    assert (a.official_pnl, a.fee, a.side) == (-10.0, 2.0, "LONG")
    assert (b.official_pnl, b.fee, b.side, b.entry_price, b.recomputed_pnl) == (10.0, 2.0, "SHORT", 90.0, 10.0)


def test_same_time_order_is_by_id(spark):
    rows = [(1, "BTC", "b-close", T0, "SELL", 1.0, 110.0, 1.0, 10.0, 0.0), (1, "BTC", "a-open", T0, "BUY", 1.0, 100.0, 0.0, 0.0, 0.0)]
    [c] = cycles.cycles(as_fills(spark, rows)).collect()
    assert (c.state, c.cycle_id) == ("CLOSED", "BTC:1:a-open")


def test_prefix_is_skipped_until_flat(spark):
    rows = [(1, "BTC", f"{i}", T0 + timedelta(minutes=i), s, 1.0, 100.0, p, 0.0, 0.0) for i, (s, p) in enumerate([("SELL", 2.0), ("SELL", 1.0), ("BUY", 0.0), ("SELL", 1.0)])]
    [report] = cycles.prefix_report(as_fills(spark, rows)).collect()
    assert (report.n_skipped, report.trusted_from) == (2, T0 + timedelta(minutes=2))
    assert [c.state for c in cycles.cycles(as_fills(spark, rows)).collect()] == ["CLOSED"]


def test_jump_keeps_closed_cycles_only(spark):
    plan = [("BUY", 0.0), ("SELL", 1.0), ("BUY", 0.0), ("BUY", 5.0), ("SELL", 6.0)]
    rows = [(1, "BTC", f"{i}", T0 + timedelta(minutes=i), s, 1.0, 100.0, p, 0.0, 0.0) for i, (s, p) in enumerate(plan)]
    [c] = cycles.cycles(as_fills(spark, rows)).collect()
    assert (c.cycle, c.state) == (1, "CLOSED")


def test_funding_at_a_boundary_is_ambiguous(spark):
    own = cycles.cycles(fills(spark, [("BUY", 1, 100), ("SELL", 1, 110)]))
    paid = spark.createDataFrame([(1, "BTC", i, T0 + timedelta(seconds=s), 1.0) for i, s in enumerate([-60, 0, 30, 60, 90])], "wallet long, coin string, funding_id long, ts timestamp_ntz, amount double")
    got = {r.funding_id: r.allocation for r in cycles.allocate_funding(paid, own).collect()}
    assert got == {0: "NO_TRUSTED_CYCLE", 1: "CYCLE_BOUNDARY_AMBIGUOUS", 2: "ALLOCATED", 3: "CYCLE_BOUNDARY_AMBIGUOUS", 4: "NO_TRUSTED_CYCLE"}


@pytest.mark.parametrize(("start", "delta", "kinds"), [(0, 1, ["OPEN"]), (1, 1, ["INCREASE"]), (2, -1, ["REDUCE"]), (1, -1, ["CLOSE"]), (1, -2, ["CLOSE", "OPEN"]), (0, -1, ["OPEN"]), (-1, -1, ["INCREASE"]), (-1, 2, ["CLOSE", "OPEN"])])
def test_transition_table(spark, start, delta, kinds):
    side = "BUY" if delta > 0 else "SELL"
    rows = as_fills(spark, [(1, "BTC", "x", T0, side, float(abs(delta)), 100.0, float(start), 0.0, 0.0)])
    assert [r.event_type.removeprefix("POSITION_") for r in cycles.transitions(rows).orderBy("ordinal").collect()] == kinds


def _nav(spark, values, start=date(2024, 1, 1)):
    return spark.createDataFrame([(1, start + timedelta(days=i), float(v)) for i, v in enumerate(values)], "wallet long, day date, nav double")


def test_drawdown(spark):
    series = returns.drawdown_series(_nav(spark, [100, 120, 90, 108, 120]), ["wallet"])
    assert [round(r.drawdown, 9) for r in series.orderBy("day").collect()] == [0, 0, -0.25, -0.1, 0]
    [m] = returns.max_drawdown(series, ["wallet"]).collect()
    assert (m.max_drawdown, m.peak_at, m.trough_at, m.recovered_at) == (-0.25, date(2024, 1, 2), date(2024, 1, 3), date(2024, 1, 5))


@pytest.mark.parametrize(("flow", "before", "end"), [(100, 110, 231), (-50, 110, 66)])
def test_time_weighted_return_with_a_flow(spark, flow, before, end):
    points = spark.createDataFrame([(1, T0, 100.0), (1, T0 + timedelta(days=2), float(end))], "wallet long, ts timestamp_ntz, nav double")
    flows = spark.createDataFrame([(1, 1, T0 + timedelta(days=1), float(before), float(before + flow), float(flow))], "wallet long, flow_id long, ts timestamp_ntz, before_nav double, after_nav double, amount double")
    periods = returns.split_at_flows(points, flows, ["wallet"])
    assert not periods.filter("flow_mismatch").count()
    assert returns.compounded(periods, ["wallet"]).first().total_return == pytest.approx(0.21)


@pytest.mark.parametrize(("days", "grade", "error"), [(29, None, "INSUFFICIENT_HISTORY"), (30, "REFERENCE_ONLY", None), (180, "STANDARD", None)])
def test_annualisation_gates(spark, days, grade, error):
    total = spark.createDataFrame([(1, 0.1, T0.date(), T0.date() + timedelta(days=days), None)], "wallet long, total_return double, first_from date, last_to date, error_code string")
    [r] = returns.annualised(total).collect()
    assert (r.grade, r.error_code) == (grade, error)


def test_leverage_and_concentration(spark):
    snaps = spark.createDataFrame([(1, float(x), 1.0) for x in (1, 2, 3, 4)] + [(1, 5.0, 0.0)], "wallet long, notional double, equity double")
    [r] = stats.leverage(snaps, ["wallet"]).collect()
    assert (r.mean_leverage, r.p50_leverage, round(r.p95_leverage, 9), r.max_leverage, r.n_invalid) == (2.5, 2.5, 3.85, 4.0, 1)
    [c] = stats.concentration(spark.createDataFrame([(1, "A", 60.0), (1, "B", -40.0)], "wallet long, coin string, notional double"), ["wallet"], "coin").collect()
    assert (c.largest_share, round(c.hhi, 9), c.largest_coin) == (0.6, 0.52, "A")


def test_weights(spark):
    w = cohort.raw_weight(F.lit(0.6), F.lit(1.0), F.lit(30.0), F.lit(0.2))
    assert spark.range(1).select(F.round(w, 9)).first()[0] == 0.22
    three = spark.createDataFrame([("1", 1.0), ("2", 1.0), ("3", 1.0)], "wallet string, raw double")
    assert [r.weight_units for r in cohort.normalised_weights(three).orderBy("wallet").collect()] == [333333334, 333333333, 333333333]
    exact = spark.createDataFrame([("c", str(i), "0.6", "1", "0.2", 30) for i in (1, 2, 3)], "cohort string, wallet string, win_rate string, profit_factor string, top_trade_share string, n_cycles long")
    rows = cohort.exact_weights(exact).orderBy("wallet").collect()
    assert [r.weight for r in rows] == ["0.333333333333333334", "0.333333333333333333", "0.333333333333333333"]
    assert rows[0].raw_weight == "0.22" and sum(Decimal(r.weight) for r in rows) == 1


def _events(spark, rows):
    return spark.createDataFrame([(w, "BTC", T0 + timedelta(minutes=m), d, f"POSITION_{e}", 10.0) for w, m, d, e in rows], "wallet long, coin string, ts timestamp_ntz, direction string, event_type string, notional double")


def test_one_wallet_one_vote(spark):
    one = spark.createDataFrame([(1, 1.0)], "wallet long, weight double")
    [s] = cohort.signals(cohort.contributions(one, _events(spark, [(1, 1, "LONG", "OPEN"), (1, 2, "LONG", "INCREASE")]))).collect()
    assert (s.buy_strength, s.confidence, s.state) == (1.0, 0.333333333, "VALID")
    [m] = cohort.signals(cohort.contributions(one, _events(spark, [(1, 1, "LONG", "OPEN"), (1, 2, "LONG", "CLOSE")]))).collect()
    assert (m.buy_strength, m.sell_strength, m.confidence, m.n_mixed) == (0.5, 0.5, 0.166666667, 1)
    two = spark.createDataFrame([(1, 0.8), (2, 0.2)], "wallet long, weight double")
    [u] = cohort.signals(cohort.contributions(two, _events(spark, [(1, 1, "LONG", "OPEN"), (2, 2, "SHORT", "OPEN")]))).collect()
    assert (round(u.net_signal, 9), u.confidence) == (0.6, 0.4)


def test_bucket_bounds_and_missing_neighbours(spark):
    t = spark.createDataFrame([(datetime(2024, 1, 1, 12, 14, 59, 999000),), (datetime(2024, 1, 1, 12, 15),)], "ts timestamp_ntz")
    assert [r[0] for r in t.select(S.bucket_start(F.col("ts"))).collect()] == [datetime(2024, 1, 1, 12), datetime(2024, 1, 1, 12, 15)]
    s = spark.createDataFrame([("BTC", T0 + timedelta(minutes=m), n) for m, n in ((0, 0.1), (15, 0.3), (45, -0.2))], "coin string, bucket timestamp_ntz, net_signal double")
    [c] = cohort.direction_changes(s).collect()
    assert (c.event_type, round(c.delta, 9)) == ("BUY_ACCELERATING", 0.2)


@pytest.mark.parametrize(("before", "now", "label"), [(-1, 1, "BULLISH_REVERSAL"), (1, -1, "BEARISH_REVERSAL"), (1, 2, "BUY_ACCELERATING"), (2, 1, "BUY_WEAKENING"), (-1, -2, "SELL_ACCELERATING"), (-2, -1, "SELL_WEAKENING"), (0, 1, "NONE"), (1, 1, "NONE"), (1, 0, "BUY_WEAKENING"), (-1, 0, "SELL_WEAKENING")])
def test_direction_labels(spark, before, now, label):
    assert spark.range(1).select(cohort.change_label(F.lit(before), F.lit(now))).first()[0] == label


def test_causal_order(spark):
    def run(rows):
        df = spark.createDataFrame([(1, "BTC", i, T0, s, d) for i, (s, d) in enumerate(rows)], "wallet long, coin string, id long, ts timestamp_ntz, start_position long, delta long")
        return {r.id: (r.place, r.issue) for r in cohort.causal_order(df).collect()}

    assert run([(1, -1), (0, 1)]) == {0: (1, None), 1: (0, None)}
    assert run([(0, 1), (3, 1)])[0] == (None, "IMPOSSIBLE_TRANSITION")
    assert run([(0, 1), (1, -1), (0, 2), (2, -2)])[0][1] == "ORDERING_AMBIGUOUS"


def test_selection_edges(spark):
    cols = "wallet long, has_run boolean, evaluable boolean, n_cycles long, win_rate double, profit_factor double, top_share double, average_win double, average_loss double, losing_streak long, age_hours long"
    exact = (1, True, True, 30, 0.55, 1.0, 0.5, 1.0, -1.0, 2, 24)
    rows = [exact, (2, *exact[1:4], 0.54, *exact[5:]), (3, *exact[1:3], 29, *exact[4:]), (4, False, *exact[2:]), (5, *exact[1:10], -1), (6, *exact[1:5], None, *exact[6:])]
    got = {r.wallet: (r.state, r.reasons, r.rank) for r in selection.select_by_trades(spark.createDataFrame(rows, cols), selection.TradePolicy()).collect()}
    assert got == {
        1: ("SELECTED", "", 1), 2: ("EXCLUDED", "WIN_RATE_BELOW_MINIMUM", None), 3: ("REVIEW", "TOO_FEW_COMPLETED_TRADES", None),
        4: ("REVIEW", "NO_PERFORMANCE_RUN", None), 5: ("REVIEW", "DATA_STALE", None), 6: ("REVIEW", "REQUIRED_METRIC_MISSING", None),
    }
    with pytest.raises(ValueError):
        selection.TradePolicy(least_win_rate=2)


def test_coverage_and_reasons(spark):
    rows = [("COMPLETE", None), ("PARTIAL", True), ("PARTIAL", None), ("GAP_DETECTED", True)]
    df = spark.createDataFrame(rows, "state string, known boolean")
    assert [r[0] for r in df.select(envelope.coverage_error(F.col("state"), F.col("known"))).collect()] == [None, None, "MISSING_INITIAL_STATE", "GAP_DETECTED"]
    assert df.agg(envelope.worst_completeness(F.col("state"))).first()[0] == "GAP_DETECTED"


def test_decimal_text(spark):
    df = spark.createDataFrame([("1.50",), ("-0.0",), ("1e3",), ("007",), (None,)], "x string")
    got = [r[0] for r in df.select(S.canonical_decimal(S.strict_decimal(F.col("x")))).collect()]
    assert got == ["1.5", "0", None, None, None]
    assert df.select(S.lenient_decimal(F.col("x"))).collect()[2][0] == 1000


def test_archive_lines_and_fills(spark):
    good = '{"time": 1704067200000, "user": "0xAB", "coin": "BTC", "side": "B", "px": "1.5", "sz": "2", "startPosition": "0", "closedPnl": "0", "fee": "0.1", "tid": 7}'
    rows = tables.archive_lines(spark.createDataFrame([(good,), (f"[{good},{good}]",), ("broken",)], "value string"))
    assert sorted(r.ordinal for r in rows.filter("corrupt is null").collect()) == [0, 0, 1]
    assert rows.filter("corrupt is not null").count() == 1
    fill = tables.map_fill(rows.filter("corrupt is null")).first()
    assert (fill.side, fill.wallet, str(fill.price)) == ("BUY", "0xab", "1.500000000000000000")


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    sinks.append_once(rows, path, ["k"])
    sinks.append_once(rows.unionByName(spark.createDataFrame([(3, "c")], rows.schema)), path, ["k"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    revisions = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "k long, revision long, v string")
    assert sinks.current_revision(revisions, ["k"]).first().v == "y"


def test_shuffled_and_foreign_rows_change_nothing(spark):
    own = fills(spark, [("BUY", 1, 100), ("SELL", 2, 90, -10), ("BUY", 1, 80, 10)])
    alien = own.withColumn("wallet", F.lit(2).cast("long"))
    once = sorted(map(str, cycles.cycles(own).collect()))
    mixed = cycles.cycles(own.unionByName(alien).orderBy(F.rand(3))).filter("wallet = 1")
    assert sorted(map(str, mixed.collect())) == once


def test_paging_and_bounds(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert [r.k for r in relational.keyset_page(df, ["k"], [3], 2).collect()] == [4, 5, 6]
    with pytest.raises(ValueError):
        relational.bounded(df, 9)


def test_a_free_execution_counts_where_it_is_allowed(spark):
    rows = [("BUY", 1, 0), ("SELL", 1, 120, 20)]
    assert [r.error_code for r in cycles.input_errors(fills(spark, rows)).collect()] == ["INVALID_INPUT"]
    assert cycles.input_errors(fills(spark, rows), free=True).count() == 0
    assert cycles.input_errors(fills(spark, [("BUY", 1, -1)]), free=True).count() == 1


def test_equal_strengths_in_another_order_are_no_change(spark):
    rows = [("BTC", T0, w, 1, 0, x, 0.0) for w, x in enumerate((0.1, 0.2))] + [("BTC", T0 + timedelta(minutes=15), 7, 1, 0, 0.3, 0.0)]
    parts = spark.createDataFrame(rows, "coin string, bucket timestamp_ntz, wallet long, n_buy long, n_sell long, buy double, sell double")
    [change] = cohort.direction_changes(cohort.signals(parts)).collect()
    assert (change.event_type, change.reason, change.delta) == ("NONE", "UNCHANGED_NET", 0.0)


def test_equal_ratios_are_ranked_by_wallet(spark):
    factor = {2: 0.1 + 0.2 + 0.6, 1: 0.9 - 1e-16}
    runs = spark.createDataFrame([(w, True, True, 9, 0.5, f + 1, 0.5, 1.0, -1.0, 1, 1) for w, f in factor.items()], "wallet long, has_run boolean, evaluable boolean, n_cycles long, win_rate double, profit_factor double, top_share double, average_win double, average_loss double, losing_streak long, age_hours long")
    told = selection.select_by_trades(runs, selection.TradePolicy(most=20, least_cycles=6, least_win_rate=0.4, least_profit_factor=0.5, most_top_share=0.8))
    assert {r.wallet: r.rank for r in told.collect()} == {1: 1, 2: 2}


def test_large_equal_ratios_are_ranked_by_wallet(spark):
    most = {1: (603.77 + 369.08 + 319.84) / 0.3, 2: (319.84 + 369.08 + 603.77) / 0.3}
    factor = {**most, 3: 8.0, 4: 8.0 + 1e-9, 5: 0.0}
    assert most[1] < most[2]
    runs = spark.createDataFrame([(w, True, True, 9, 0.5, f, 0.5, 1.0, -1.0, 1, 1) for w, f in factor.items()], "wallet long, has_run boolean, evaluable boolean, n_cycles long, win_rate double, profit_factor double, top_share double, average_win double, average_loss double, losing_streak long, age_hours long")
    told = selection.select_by_trades(runs, selection.TradePolicy(most=20, least_cycles=6, least_win_rate=0.4, least_profit_factor=0.0, most_top_share=0.8))
    assert {r.wallet: r.rank for r in told.collect()} == {1: 1, 2: 2, 4: 3, 3: 4, 5: 5}
