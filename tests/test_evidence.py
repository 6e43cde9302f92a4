"""Hand-computed cases of the evidence operators, flows, coverage, sinks and long keys."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tideglass.functions import scalar as S
from tideglass.operators import audit, cohort, cycles, evidence, returns
from tideglass.plans import evidence_queries
from tideglass.plans.performance import covered_performance
from tideglass.sources import sinks
from tideglass.streaming import streams

T0 = datetime(2024, 1, 1)
FILL = "wallet long, coin string, id string, ts timestamp_ntz, side string, size double, price double, start_position double, closed_pnl double, fee double"


def as_fills(spark, rows):
    return spark.createDataFrame(rows, FILL).withColumn("delta", S.signed_delta(F.col("side"), F.col("size")))


def walk(moves, hours=5):
    """Executions (side, size, price) that follow each other, a few a day."""
    at, out = 0.0, []
    for i, (side, size, price) in enumerate(moves):
        out.append((1, "BTC", f"{i:05d}", T0 + timedelta(hours=hours * i), side, float(size), float(price), at, 0.0, 0.0))
        at += size if side == "BUY" else -size
    return out


def by_hand(rows):
    """Average entry price and recomputed profit of each cycle, one execution after the other."""
    size = entry = gain = 0.0
    out = []
    for _, _, _, _, side, quantity, price, *_ in rows:
        sign = 1 if side == "BUY" else -1
        if size * sign >= 0:
            entry, size = (abs(size) * entry + quantity * price) / (abs(size) + quantity), size + sign * quantity
            continue
        shut = min(quantity, abs(size))
        gain += (price - entry) * shut * (1 if size > 0 else -1)
        size += sign * quantity
        if size == 0 or size * sign > 0:
            out.append((entry, gain))
            gain, entry = 0.0, price if size else 0.0
    return [*out, (entry, gain)] if size else out


@pytest.mark.parametrize("folded", [7, 4096])
def test_cycles_over_many_days_match_one_after_the_other(spark, monkeypatch, folded):
    monkeypatch.setattr(cycles, "FOLDED", folded)
    rng = random.Random(3)
    rows = walk([(rng.choice(["BUY", "BUY", "SELL"]) if i % 40 < 20 else rng.choice(["SELL", "SELL", "BUY"]), rng.randint(1, 4), rng.randint(50, 150)) for i in range(400)])
    got = cycles.cycles(as_fills(spark, rows)).orderBy("cycle").collect()
    expected = by_hand(rows)
    assert len(got) == len(expected) > 5 and max((r.closed_at - r.opened_at).days for r in got if r.closed_at) > 3
    assert [r.entry_price for r in got] == pytest.approx([e for e, _ in expected])
    assert [r.recomputed_pnl for r in got] == pytest.approx([g for _, g in expected])


def test_a_jump_on_a_later_day_ends_the_key(spark):
    rows = walk([("BUY", 1, 100), ("SELL", 1, 110)] * 10 + [("BUY", 1, 100)] * 3)
    jumped = [r if i < 15 else (*r[:7], r[7] + 5, *r[8:]) for i, r in enumerate(rows)]
    got = cycles.cycles(as_fills(spark, jumped)).collect()
    assert len(got) == 7 and all(r.state == "CLOSED" for r in got)
    late = [(*r[:7], r[7] + 1, *r[8:]) for r in rows[:6]] + walk([("BUY", 1, 100)] * 8)[6:8]
    fixed = [(*r[:7], 0.0 if i == 6 else 1.0 if i == 7 else r[7], *r[8:]) for i, r in enumerate(late)]
    [report] = cycles.prefix_report(as_fills(spark, fixed)).collect()
    assert (report.n_skipped, report.n_trusted, report.trusted_from) == (6, 2, T0 + timedelta(hours=30))


def test_executions_without_a_time_come_first(spark):
    rows = walk([("BUY", 1, 100), ("BUY", 1, 110), ("SELL", 2, 120)])
    rows = [(*r[:3], None, *r[4:]) if i < 2 else r for i, r in enumerate(rows)]
    [c] = cycles.cycles(as_fills(spark, [*rows, (None, *rows[2][1:])])).collect()
    assert (c.wallet, c.n_fills, c.entry_price, c.state) == (1, 3, 105.0, "CLOSED")


def test_overlapping_cycles_are_several_candidates(spark):
    def at(h):
        return T0 + timedelta(hours=h)

    own = spark.createDataFrame([(1, "BTC", 1, at(0), at(10)), (1, "BTC", 2, at(4), at(6)), (1, "BTC", 3, at(20), None)], "wallet long, coin string, cycle long, opened_at timestamp_ntz, closed_at timestamp_ntz")
    paid = spark.createDataFrame([(1, "BTC", h, at(h), 1.0) for h in (-1, 0, 2, 5, 8, 10, 12, 25)], "wallet long, coin string, funding_id long, ts timestamp_ntz, amount double")
    got = {r.funding_id: (r.allocation, r.cycle) for r in cycles.allocate_funding(paid, own).collect()}
    none, edge = ("NO_TRUSTED_CYCLE", None), ("CYCLE_BOUNDARY_AMBIGUOUS", None)
    assert got == {-1: none, 0: edge, 2: ("ALLOCATED", 1), 5: ("MULTIPLE_CYCLE_CANDIDATES", None), 8: ("ALLOCATED", 1), 10: edge, 12: none, 25: ("ALLOCATED", 3)}


def test_a_first_execution_that_is_not_flat_has_no_boundary(spark):
    def order(rows):
        df = spark.createDataFrame([(1, "BTC", i, T0 + timedelta(hours=h), s, d) for i, (h, s, d) in enumerate(rows)], "wallet long, coin string, id long, ts timestamp_ntz, start_position long, delta long")
        return {r.id: (r.place, r.issue) for r in cohort.causal_order(df).collect()}

    assert order([(0, 5, 1), (1, 6, -6)]) == {0: (None, "MISSING_BOUNDARY"), 1: (None, "MISSING_BOUNDARY")}
    assert order([(0, 5, 1), (0, 6, 1)]) == {0: (None, "MISSING_BOUNDARY"), 1: (None, "MISSING_BOUNDARY")}
    assert order([(0, 0, 1), (0, 1, -1), (0, 0, 1), (0, 1, -1)])[0] == (None, "ORDERING_AMBIGUOUS")


#: wallet: kind of flow, amount, value before it, last value, total return, its error
FLOWS = {1: ("deposit", 100.0, 110.0, 231.0, 0.21, None), 2: ("withdraw", -50.0, 110.0, 66.0, 0.21, None), 3: ("vault", 100.0, 110.0, 231.0, None, "UNKNOWN_CASH_FLOW"), 4: ("reward", 100.0, 110.0, 231.0, 1.31, None), 5: ("deposit", 100.0, 110.0, 231.0, None, "MISSING_CASH_FLOW_BOUNDARY_NAV")}
#: wallet: completeness, is the first state known, is the gap explicit, the trade lane's error
COVERAGE = {11: ("COMPLETE", None, None, None), 12: ("PARTIAL", True, False, None), 13: ("PARTIAL", False, False, "MISSING_INITIAL_STATE"), 14: ("GAP_DETECTED", True, False, None), 15: ("GAP_DETECTED", True, True, "GAP_DETECTED"), 16: ("TRUNCATED", True, True, "TRUNCATED")}


def test_flows_and_coverage_through_the_whole_plan(spark):
    at = T0 + timedelta(hours=6)
    points = [(w, T0, 0, 100.0) for w in (*FLOWS, *COVERAGE)] + [(w, T0 + timedelta(days=1), 1, f[3]) for w, f in FLOWS.items()] + [(w, T0 + timedelta(days=1), 1, 121.0) for w in COVERAGE]
    flows = [(w, 7, at, f[0], f[1], None) for w, f in FLOWS.items()]
    values = [(w, 7, "FLOW_BEFORE", at, f[2]) for w, f in FLOWS.items()] + [(w, 7, "FLOW_AFTER", at, f[2] + f[1]) for w, f in FLOWS.items() if w != 5]
    coverage = [(w, "COMPLETE", True, False) for w in FLOWS] + [(w, *c[:3]) for w, c in COVERAGE.items()]
    fills = [(w, *r[1:2], f"{w}:{r[2]}", *r[3:]) for w in (*FLOWS, *COVERAGE) for r in walk([("BUY", 1, 100), ("SELL", 1, 120)])]
    rows = covered_performance(
        as_fills(spark, fills),
        spark.createDataFrame(points, "wallet long, ts timestamp_ntz, id long, nav double"),
        spark.createDataFrame(flows, "wallet long, flow_id long, ts timestamp_ntz, kind string, amount double, boundary string"),
        spark.createDataFrame(values, "wallet long, flow_id long, role string, ts timestamp_ntz, nav double"),
        spark.createDataFrame(coverage, "wallet long, completeness string, initial_state_known boolean, explicit_gap boolean"),
    ).collect()
    got = {(r.wallet, r.metric): r for r in rows}
    for w, (*_, total, error) in FLOWS.items():
        r = got[w, "total_return"]
        assert (r.value, r.error_code) == (None if total is None else pytest.approx(total), error) and got[w, "win_rate"].value == 0.0
    for w, (state, _, _, error) in COVERAGE.items():
        trade, result = got[w, "win_rate"], got[w, "total_return"]
        assert trade.error_code == error and (trade.value is None) == (error is not None)
        assert result.error_code is None and result.value == pytest.approx(0.21) and ("PARTIAL_HISTORY" in result.warnings) == (state != "COMPLETE")


def _plan(spark, points, flows, values, fills):
    wallets = sorted({p[0] for p in points} | {f[0] for f in fills})
    return {
        (r.wallet, r.metric): r
        for r in covered_performance(
            as_fills(spark, fills), spark.createDataFrame(points, "wallet long, ts timestamp_ntz, id long, nav double"),
            spark.createDataFrame(flows, "wallet long, flow_id long, ts timestamp_ntz, kind string, amount double, boundary string"),
            spark.createDataFrame(values, "wallet long, flow_id long, role string, ts timestamp_ntz, nav double"),
            spark.createDataFrame([(w, "COMPLETE", True, False) for w in wallets], "wallet long, completeness string, initial_state_known boolean, explicit_gap boolean"),
        ).collect()
    }


def test_one_bad_wallet_leaves_the_others_as_they_are(spark):
    """Everything withdrawn, sizes of zero, repeated ids, no exposure: each is its wallet's error beside a good wallet."""
    good = walk([("BUY", 1, 100), ("SELL", 1, 120)])
    fills = [(w, *r[1:2], f"{w}:{r[2]}", *r[3:]) for w in (1, 2, 3, 4) for r in good]
    columns = {"id": 2, "size": 5, "price": 6}
    zero, twice = list(fills[2]), list(fills[4])
    zero[columns["size"]] = 0.0
    twice[columns["id"]] = fills[5][columns["id"]]
    fills[2], fills[4] = tuple(zero), tuple(twice)
    fills[6:] = [tuple(0.0 if i == columns["price"] else v for i, v in enumerate(f)) for f in fills[6:]]
    points = [(w, T0 + timedelta(days=d), d, v) for w in (1, 5, 6, 7, 8) for d, v in ((0, 100.0), (1, 231.0))]
    at = T0 + timedelta(hours=6)
    flows, values = [], []
    for w, before, after, before_at, after_at, amount in (
        (1, 110.0, 210.0, at, at, 100.0), (5, 110.0, 0.0, at, at, -110.0), (6, 110.0, 210.0, at + timedelta(days=10), at, 100.0), (7, 110.0, 210.0, at, at, 99.0), (8, 110.0, 210.0, at, at - timedelta(hours=9), 100.0),
    ):
        flows.append((w, 7, at, "withdraw" if amount < 0 else "deposit", amount, None))
        values += [(w, 7, "FLOW_BEFORE", before_at, before), (w, 7, "FLOW_AFTER", after_at, after)]
    flows.append((5, 8, at, "deposit", 50.0, None))
    values += [(5, 8, "FLOW_BEFORE", at, 0.0), (5, 8, "FLOW_AFTER", at, 50.0)]
    got = _plan(spark, points, flows, values, fills)
    assert (got[1, "total_return"].value, got[1, "total_return"].warnings, got[1, "win_rate"].value) == (pytest.approx(0.21), "", 0.0)
    assert {w: got[w, "win_rate"].error_code for w in (2, 3, 4)} == {2: "INVALID_INPUT", 3: "DUPLICATE_EVENT", 4: "INVALID_INPUT"}
    assert got[4, "hhi"].error_code == got[4, "largest_share"].error_code == "ZERO_DENOMINATOR" and got[1, "hhi"].value == 1
    assert {w: got[w, "total_return"].error_code for w in (5, 6, 7, 8)} == {5: "NON_POSITIVE_NAV", 6: "DATA_ORDER_AMBIGUOUS", 7: None, 8: "DATA_ORDER_AMBIGUOUS"}
    assert got[7, "total_return"].warnings == "CASH_FLOW_NAV_MISMATCH" and got[7, "total_return"].value == pytest.approx(0.21)


def test_operators_do_not_divide_by_zero(spark):
    rows = as_fills(spark, [tuple(0.0 if i in (5, 7) else v for i, v in enumerate(r)) for r in walk([("BUY", 1, 100), ("SELL", 1, 120)])])
    assert cycles.cycles(rows).count() >= 0 and cycles.legs(rows).collect() is not None
    periods = spark.createDataFrame([(1, 1, T0, T0, -1.0), (1, 2, T0, T0 + timedelta(days=1), 0.5), (2, 1, T0, T0 + timedelta(days=2), 0.1), (2, 2, T0 + timedelta(days=1), T0 + timedelta(days=3), 0.1), (3, 1, T0, T0, 0.1)], "key long, seq int, period_from timestamp_ntz, period_to timestamp_ntz, value double")
    wealth = {(r.key, r.seq): (r.wealth, r.wealth_error) for r in returns.wealth_index(periods, ["key"]).collect()}
    assert wealth == {(1, 1): (None, "NON_POSITIVE_NAV"), (1, 2): (None, "NON_POSITIVE_NAV"), (2, 1): (None, "DATA_ORDER_AMBIGUOUS"), (2, 2): (None, "DATA_ORDER_AMBIGUOUS"), (3, 1): (pytest.approx(1.1), None)}
    totals = returns.annualised(returns.compounded(periods, ["key"])).collect()
    assert {r.key: r.error_code for r in totals} == {1: "NON_POSITIVE_NAV", 2: "INSUFFICIENT_HISTORY", 3: "INSUFFICIENT_HISTORY"}


def test_repeated_flows_are_an_error(spark):
    flows = spark.createDataFrame([(1, 7, T0, "deposit", 1.0, None)] * 2, "wallet long, flow_id long, ts timestamp_ntz, kind string, amount double, boundary string")
    assert {r.error_code for r in returns.normalise_flows(flows, ["wallet"]).collect()} == {"DUPLICATE_EVENT"}


def test_oversized_cohorts_are_told_and_leave_the_others(spark):
    events = spark.createDataFrame([(1, "BTC", T0, "LONG", "POSITION_OPEN", 1.0)], "wallet long, coin string, ts timestamp_ntz, direction string, event_type string, notional double")
    large = spark.range(201).select(F.col("id").alias("wallet"), F.lit(0.1).alias("weight"))
    assert cohort.contributions(large, events).count() == 0
    assert [tuple(r) for r in cohort.oversized(large).collect()] == [(201, "TOO_MANY_MEMBERS")]
    two = spark.range(400).select((F.col("id") % 2).alias("cohort"), F.col("id").alias("wallet"), F.lit(0.1).alias("weight"))
    three = two.unionByName(large.withColumn("cohort", F.lit(7).cast("long")))
    assert cohort.contributions(two, events).count() == 400 == cohort.contributions(three, events).count()
    assert [{tuple(r) for r in rows.collect()} for rows in (lambda p, f: (p.select("cohort", "wallet"), f.select("cohort", "coin")))(*cohort.participations(three, events))] == [{(1, 1)}, {(0, "BTC"), (1, "BTC")}]
    assert [tuple(r) for r in cohort.oversized(three).collect()] == [(7, 201, "TOO_MANY_MEMBERS")]
    texts = three.select("cohort", F.col("wallet").cast("string").alias("wallet"), *(F.lit("0.5").alias(c) for c in ("win_rate", "profit_factor", "top_trade_share")), F.lit(5).alias("n_cycles"))
    exact = cohort.exact_weights(texts).collect()
    assert len(exact) == 401 and [(r.cohort, r.error_code) for r in exact if r.error_code] == [(7, "TOO_MANY_MEMBERS")]
    assert sum(Decimal(r.weight) for r in exact if r.cohort == 1) == 1


def test_signals_of_participations_equal_those_of_contributions(spark):
    rng = random.Random(3)
    events = spark.createDataFrame([(rng.randrange(12), rng.choice(["BTC", "ETH"]), T0 + timedelta(minutes=7 * rng.randrange(40)), rng.choice(["LONG", "SHORT"]), rng.choice(["POSITION_OPEN", "POSITION_CLOSE"]), 1.0) for _ in range(150)], "wallet long, coin string, ts timestamp_ntz, direction string, event_type string, notional double")
    weights = spark.range(10).select((F.col("id") % 3).alias("cohort"), F.col("id").alias("wallet"), (F.col("id") / 10).alias("weight"))
    basis = ("cohort", "coin")
    whole, few = cohort.signals(cohort.contributions(weights, events), basis=basis), cohort.signals(*cohort.participations(weights, events), basis=basis)
    columns = sorted(whole.columns)
    rows = [sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in s.select(*columns).collect()) for s in (whole, few)]
    assert rows[0] == rows[1]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_buckets_that_have_not_ended_or_have_open_issues(spark):
    members = spark.createDataFrame([(1,), (2,)], "wallet long")
    ends = spark.createDataFrame([("BTC", T0 + timedelta(minutes=m)) for m in (15, 30)], "coin string, bucket_end timestamp_ntz")
    done = spark.createDataFrame([(w, "BTC", T0 + timedelta(hours=1), T0 + timedelta(hours=1), False) for w in (1, 2)], "wallet long, coin string, done_to timestamp_ntz, observed_to timestamp_ntz, has_gap boolean")
    last = spark.createDataFrame([(w, "BTC", T0) for w in (1, 2)], "wallet long, coin string, last_at timestamp_ntz")
    issues = spark.createDataFrame([(1, "BTC", T0 + timedelta(minutes=20)), (2, None, T0)], "wallet long, coin string, since timestamp_ntz")
    got = audit.readiness(members, ends, done, last, now=F.lit("2024-01-01 00:20:00").cast("timestamp_ntz"), issues=issues)
    assert sorted((r.bucket_end.minute, r.wallet, r.issue) for r in got.collect()) == [(15, 2, "OPEN_ISSUE"), (30, 1, "BUCKET_NOT_ENDED"), (30, 1, "OPEN_ISSUE"), (30, 2, "BUCKET_NOT_ENDED"), (30, 2, "OPEN_ISSUE")]


def test_pages_prove_a_range_or_do_not(spark):
    def label(pages):
        rows = [("k", i, n, T0 + timedelta(hours=h), T0) for i, (n, h) in enumerate(pages)]
        return evidence.page_coverage(spark.createDataFrame(rows, "key string, page_no int, n_rows long, last_at timestamp_ntz, requested_from timestamp_ntz"), ["key"], page_rows=5, most_rows=20).first()

    assert (label([(5, 1), (2, 2)]).proven, label([(0, 0)]).evidence) == (True, "BOUNDED_EMPTY_EXHAUSTIVE_RESPONSE")
    assert [label(p).proven for p in ([(5, 1), (5, 1)], [(5, 1), (5, 2), (5, 3), (5, 4)], [(5, 2), (5, 1)], [(5, 1), (5, 2)])] == [False] * 4
    assert label([(5, 1), (0, 1), (9, 9)]).n_items == 5


def test_a_page_never_splits_an_instant(spark):
    rows = spark.createDataFrame([("k", T0 + timedelta(hours=h)) for h, n in ((0, 3), (1, 4), (2, 9), (3, 1)) for _ in range(n)], "key string, ts timestamp_ntz")
    got = evidence.whole_instants(rows, ["key"], page_rows=5, most_rows=8).orderBy("ts").collect()
    assert [(r.n_rows, r.page, r.state) for r in got] == [(3, 0, "COMPLETE"), (4, 0, "COMPLETE"), (9, 1, "INCOMPLETE"), (1, 3, "BLOCKED")]


def test_publishing_again_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "run_id long, v string")
    for run in (1, 2, 1):
        sinks.publish_run(rows.filter(F.col("run_id") == run), spark.createDataFrame([(run, "SUCCEEDED")], "run_id long, status string"), path)
    assert spark.read.parquet(f"{path}/results").count() == 3 and spark.read.parquet(f"{path}/runs").count() == 2
    assert sinks.existing(spark, f"{path}/absent", rows.schema).count() == 0


def test_values_of_one_instant_have_a_fixed_order(spark):
    points = spark.createDataFrame([(1, T0, 90.0), (1, T0, 100.0), (1, T0 + timedelta(days=2), 220.0), (1, T0 + timedelta(days=2), 210.0)], "wallet long, ts timestamp_ntz, nav double")
    flows = spark.createDataFrame([(1, 1, T0 + timedelta(days=1), 110.0, 200.0, 90.0)], "wallet long, flow_id long, ts timestamp_ntz, before_nav double, after_nav double, amount double")
    got = returns.split_at_flows(points.orderBy(F.rand(2)), flows, ["wallet"]).orderBy("seq").collect()
    assert [r.value for r in got] == pytest.approx([0.1, 0.1])


def _arrive(spark, rows, folder, n):
    spark.createDataFrame(rows, "wallet long, id long, ts timestamp, price double, size long, coin string, side string").coalesce(1).write.parquet(f"{folder}/batch-{n}")


def _landing(spark, folder, per_batch=1):
    schema = "wallet long, id long, ts timestamp, price double, size long, coin string, side string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(f"{folder}/batch-*")


def test_repeated_trades_count_once_in_any_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i % 5, i, T0 + timedelta(hours=7 * i), float(1 + i % 9), 3, f"c{i % 40}", "BUY") for i in range(400)]
    for n in range(8):
        own = rows[n * 50 : n * 50 + 50]
        again = rng.sample(rows[: n * 50], min(n * 50, 20)) + own[:3]
        _arrive(spark, own + again, tmp_path / "in", n)
    repeats = sum(min(n * 50, 20) + 3 for n in range(8))
    out = f"file://{tmp_path}/out"
    for _ in range(2):  # a second run finds nothing new
        got = {r.wallet: r for r in streams.candidate_table(_landing(spark, tmp_path / "in"), out, compacted=3, remembered=400).collect()}
        assert sum(r.n_trades for r in got.values()) == 400 and sum(r.n_duplicates for r in got.values()) == repeats
    for w, r in got.items():
        own = [x for x in rows if x[0] == w]
        assert (r.n_trades, r.sum_notional, r.max_notional) == (80, sum(x[3] * 3 for x in own), max(x[3] * 3 for x in own))
        assert (r.first_seen, r.last_seen, r.n_days, r.n_coins) == (own[0][2], own[-1][2], len({x[2].date() for x in own}), len({x[5] for x in own}))
        assert abs(r.n_hours / len({x[2] for x in own}) - 1) < 0.03
    kept = {p.name for p in (tmp_path / "out" / "rows").iterdir()} | {p.name for p in (tmp_path / "out" / "whole").iterdir()}
    assert kept == {"batch=6", "batch=7", "upto=5"}  # six batches are one folder, two follow it


def test_sketches_of_batches_estimate_large_counts(spark, tmp_path):
    for n in range(4):
        _arrive(spark, [(1, n * 3000 + i, T0 + timedelta(seconds=i), 1.0, 1, f"coin{(n * 2000 + i) % 9000}", "BUY") for i in range(3000)], tmp_path / "in", n)
    [r] = streams.candidate_table(_landing(spark, tmp_path / "in"), f"file://{tmp_path}/out", compacted=2).collect()
    assert r.n_trades == 12000 and abs(r.n_coins / 9000 - 1) < 0.03


def test_a_late_row_makes_a_second_revision(spark, tmp_path):
    rows = [(1, i, T0 + timedelta(minutes=4 * i), 2.0, 1, "BTC", "BUY") for i in range(40)]
    path = f"file://{tmp_path}/table"

    def told():
        return {(r.bucket, r.revision): (r.n_events, r.fingerprint) for r in streams.revision_table(_landing(spark, tmp_path / "in"), path).collect()}

    _arrive(spark, rows, tmp_path / "in", 0)
    first = told()
    assert {k[1] for k in first} == {1} and told() == first
    _arrive(spark, [(1, 99, T0 + timedelta(minutes=5), 7.0, 1, "BTC", "BUY")], tmp_path / "in", 1)
    second = told()
    assert {k: v for k, v in second.items() if k in first} == first
    [(at, number)] = set(second) - set(first)
    assert (at, number) == (T0, 2) and second[at, 2][0] == first[at, 1][0] + 1
    revisions = spark.read.parquet(f"{path}/revisions").select("coin", "bucket", "revision", "fingerprint")
    asked = spark.createDataFrame([("BTC", b, v[1]) for (b, _), v in first.items()], "coin string, bucket timestamp, fingerprint string")
    states = {r.bucket: r.state for r in sinks.bucket_state(sinks.current_revision(revisions, ["coin", "bucket"]), asked, ["coin", "bucket"]).collect()}
    assert {b for b, state in states.items() if state == "STALE"} == {T0} and set(states.values()) == {"STALE", "CURRENT"}


def test_rewind_touches_the_late_keys_blocks_and_days_only(spark, tmp_path):
    rng = random.Random(5)
    rows = [(w, c, i, T0 + timedelta(hours=5 * i, minutes=w), rng.choice([-2, -1, 1, 3])) for w in range(12) for c in ("BTC", "ETH") for i in range(30)]
    late = [(3, "ETH", 900, T0 + timedelta(days=3, hours=1), 50), (3, "ETH", 901, T0 + timedelta(days=4), -7), (5, "BTC", 902, T0 - timedelta(days=1), 9)]

    def placed(r):
        at, out = {}, []
        for w, c, i, ts, d in sorted(r, key=lambda x: (x[3], x[2])):
            out.append((w, c, i, ts, d, at.get((w, c), 0)))
            at[w, c] = at.get((w, c), 0) + d
        return out

    path = f"file://{tmp_path}/t"
    fill = "wallet long, coin string, id long, ts timestamp_ntz, delta long"
    streams.write_positions(spark.createDataFrame(placed(rows), fill + ", start_position long"), path, blocks=8)
    was = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "rows").glob("block=*/day=*")}
    all_ = spark.createDataFrame(rows + late, fill)
    done = streams.rewind_positions(path, all_, spark.createDataFrame(late, fill), blocks=8).collect()
    got = spark.read.parquet(f"{path}/rows").select("wallet", "coin", "id", "ts", "delta", "start_position").collect()
    assert sorted(map(tuple, got)) == sorted(placed(rows + late))
    touched = {(r.block, r.day) for r in done}
    blocks = {r.block: r.since for r in streams._blocked(spark.createDataFrame(late, fill), 8).groupBy("block").agg(F.min("day").alias("since")).collect()}
    assert {b for b, _ in touched} == set(blocks) and all(d >= blocks[b] for b, d in touched) and len(blocks) == 2
    now = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "rows").glob("block=*/day=*")}
    assert {p for p in was if now[p] == was[p]} and all((int(p.parent.name[6:]), datetime.fromisoformat(p.name[4:]).date()) in touched for p in was if now[p] != was[p])
    assert streams.rewind_positions(path, all_, spark.createDataFrame([], fill), blocks=8).count() == 0


def test_decimal_texts_compare_without_floats(spark):
    df = spark.createDataFrame([("0.1", "0.10"), ("-1", "1"), ("2.000000000000000001", "2"), ("1e3", "1"), (None, "1"), ("-0", "0")], "a string, b string")
    assert [r[0] for r in df.select(S.compare_decimals(F.col("a"), F.col("b"))).collect()] == [0, -1, 1, None, None, 0]
    assert df.limit(1).select(S.redact(F.lit("x postgres://u:p@h/db token=abc")), S.days_between(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-02 12:00:00").cast("timestamp"))).first()[:] == ("x postgres://***@h/db token=***", 1.5)


def test_duplicate_ids_are_told(spark):
    rows = walk([("BUY", 1, 100), ("SELL", 1, 110)])
    assert [(r.id, r.n) for r in cycles.duplicate_ids(as_fills(spark, [*rows, rows[1]])).collect()] == [("00001", 2)]


def test_provenance_needs_the_whole_chain_of_the_wallet(spark):
    runs = [(1, 7, "BTC"), (2, 7, "BTC"), (3, 8, "ETH"), (4, 9, "BTC"), (5, 7, "BTC"), (6, 7, "BTC"), (7, 7, "BTC")]
    scopes = [(1, 7, 2, 40), (1, 7, 1, 50), (1, 7, 0, None), (2, 8, 1, 50), (3, 8, 1, 60), (4, 9, 1, 50), (5, 7, 1, 99), (6, 7, 1, None), *((7, 7, i, 50) for i in range(3)), *((8, 7, i, 50) for i in range(4))]
    done = [(50, 7, "SUCCEEDED", "v3", "TRUSTED"), (40, 7, "FAILED", "v3", "TRUSTED"), (60, 8, "SUCCEEDED", "v2", "TRUSTED")]
    cases = {  # (run, wallet, coin): issue; the first scope of run 1 with a performance run is number 1
        (1, 7, "BTC"): None, (1, 7, "ETH"): "G", (1, 8, "BTC"): "G", (1, None, "BTC"): "G", (1, 7, None): "G", (None, 7, "BTC"): "G", (2, 7, "BTC"): "G", (3, 8, "ETH"): "G",
        (4, 9, "BTC"): "G", (5, 7, "BTC"): "G", (6, 7, "BTC"): "G", (7, 7, "BTC"): None, (8, 7, "BTC"): "T", (9, 7, "BTC"): "G",
    }
    frames = (
        spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "event_id long, run_id long, wallet long, coin string"), spark.createDataFrame(runs, "run_id long, wallet long, coin string"),
        spark.createDataFrame(scopes, "run_id long, wallet long, scope_id long, performance_id long"), spark.createDataFrame(done, "performance_id long, wallet long, status string, version string, trust_state string"),
    )
    got = {r.event_id: r.issue[0] for r in evidence.provenance_issues(*frames, version="v3", most_scopes=3).collect()}
    assert got == {i: v for i, v in enumerate(cases.values()) if v}


def test_provenance_sends_no_list_of_runs_to_every_executor(spark, sf):
    """Only runs with too many scopes, of which there are few, may be broadcast."""
    plan = evidence_queries.REGISTRY.queries["event_provenance"](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    sent = [plan[i + 1] for i, line in enumerate(plan) if "BroadcastExchange" in line]
    assert all("_scopes" in line and "> 200" in line for line in sent)
    assert sum("SortMergeJoin" in line for line in plan) + len(sent) == sum("Join" in line for line in plan) == 4
