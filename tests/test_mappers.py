"""Source mappers and sinks' helpers on small records."""

import json

from pyspark.sql import functions as F

from tideglass.operators import audit
from tideglass.sources import mappers, sinks, tables

A, B = "0x" + "a" * 40, "0x" + "b" * 40


def test_both_funding_shapes_get_one_id(spark):
    rows = spark.createDataFrame([(A.upper().replace("0X", "0x"), 1704067200000, "BTC", "1.50", "-2.0", "0.0001"), (A, 1704067200000, "BTC", "1.5", "-2", "1e-4")], "wallet string, time long, coin string, usdc string, szi string, rate string")
    got = mappers.funding_payments(rows).collect()
    assert got[0].funding_id == got[1].funding_id == f"funding:{A}:1704067200000:BTC:1.5:-2:0.0001"


def test_ledger_fields_and_borders(spark):
    deltas = [
        {"type": "deposit", "usdc": "5"}, {"type": "withdraw", "amount": "x", "usdc": "7", "fee": "1"}, {"type": "send", "user": A, "destination": B, "amount": "3", "token": ""},
        {"type": "send", "user": B, "destination": A, "amount": "3"}, {"type": "send", "user": A, "destination": A, "amount": "3"}, {"type": "accountClassTransfer", "usdc": "2", "toPerp": True}, {"type": "vaultMove"},
    ]
    rows = spark.createDataFrame([(A, "h", i, json.dumps(d)) for i, d in enumerate(deltas)], "wallet string, hash string, time long, delta string")
    got = mappers.stored_flow_boundary(mappers.ledger_updates(rows)).orderBy("ts").collect()
    assert [(r.boundary, None if r.signed_amount is None else int(r.signed_amount)) for r in got] == [("EXTERNAL", 5), ("EXTERNAL", -7), ("EXTERNAL", -3), ("EXTERNAL", 3), ("INTERNAL", 3), ("INTERNAL", 2), ("UNKNOWN", None)]
    assert got[1].fee == 1 and got[2].asset is None and got[2].counterparty == B


def test_positions_balances_and_orders(spark):
    p = spark.createDataFrame([(A, "BTC", "0.0"), (A, "ETH", "-2"), (A, "SOL", "1")], "wallet string, coin string, szi string")
    assert [(r.coin, r.side) for r in mappers.positions(p).orderBy("coin").collect()] == [("ETH", "SHORT"), ("SOL", "LONG")]
    b = spark.createDataFrame([("A", None, "0", "0.0", "0"), ("B", None, "1", "0", "0"), ("C", 3, "0", "0", "0")], "coin string, token int, total string, hold string, entry_notional string")
    assert [(r.coin, r.error_code) for r in mappers.spot_balances(b).orderBy("coin").collect()] == [("B", "MISSING_TOKEN"), ("C", None)]
    o = spark.createDataFrame([(1, "BTC", "B", "2", None, None, 0), (2, "BTC", "A", "2", "5", "filled", 0)], "oid long, coin string, side string, sz string, orig_sz string, status string, status_time long")
    assert [(r.side, r.status, int(r.original_size)) for r in mappers.orders(o).orderBy("order_id").collect()] == [("BUY", "open", 2), ("SELL", "filled", 5)]


def test_market_trades_and_value_history(spark):
    t = spark.createDataFrame([(5, "BTC", 7, "0xH", [A.upper().replace("0X", "0x"), B], "2.50", "4", "B"), (5, "BTC", 7, "0xh", [A, B], "2.5", "4.0", "B")], "time long, coin string, tid long, hash string, users array<string>, px string, sz string, side string")
    got = mappers.market_trades(t).collect()
    assert got[0].fingerprint == got[1].fingerprint and got[0].notional == 10 and got[0].buyer == A
    h = spark.createDataFrame([(A, [("day", [(1, 1.0), (2, 2.0)]), ("week", [(2, 3.0), (3, 4.0)]), ("other", [(9, 9.0)])])], "wallet string, history array<struct<period: string, points: array<struct<time: long, value: double>>>>")
    assert [(r.nav, r.error_code) for r in mappers.value_history(h, ["day", "week"]).orderBy("ts").collect()] == [(1.0, None), (None, "CONFLICTING_VALUE"), (4.0, None)]


def test_landing_cost_receipts_and_retention(spark):
    plan = spark.createDataFrame([("SELECTED", 1024**3), ("MISSING", None)], "state string, bytes long")
    assert tables.transfer_cost(plan, 0.5, 2.0).first().cost == 2.5
    r = sinks.receipts(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "x long, y string"), ["x", "y"]).collect()
    assert r[0].receipt_id == r[1].receipt_id != r[2].receipt_id
    rows = spark.createDataFrame([("DONE", "2024-01-01"), ("DONE", "2024-02-01"), ("OPEN", "2023-01-01")], "state string, ts string").withColumn("now", F.lit("2024-02-10"))
    assert [x.ts for x in sinks.expired(rows, [("DONE", 30)]).collect()] == ["2024-01-01"]
    s = spark.createDataFrame([(1, "BTC", 1, 5), (1, "ETH", 2, 6), (2, "BTC", 1, 7)], "wallet long, coin string, ts long, size long")
    assert sorted((x.wallet, x.coin) for x in sinks.replace_positions(s).collect()) == [(1, "ETH"), (2, "BTC")]
    log = spark.createDataFrame([("f", 1, "OPEN"), ("f", 2, "RESOLVED"), ("f", 3, "OPEN")], "fingerprint string, at long, state string")
    assert audit.issue_state(log).first().n_opened == 2


def test_records_ids_times_and_members(spark):
    import json

    from tideglass.sources import records

    fill = {"closedPnl": "0", "coin": "BTC", "crossed": True, "dir": "Open", "fee": "0.1", "feeToken": "USDC", "hash": "h", "oid": 5, "px": "1.5", "side": "B", "startPosition": "0", "sz": "2", "tid": 7, "time": 1_704_067_200_000}
    cases = [
        ("fill", fill, None), ("fill", fill | {"oid": "1.5"}, "BAD_ID:oid"), ("fill", fill | {"tid": "-1"}, "BAD_ID:tid"), ("fill", fill | {"tid": "99999999999999999999"}, "BAD_ID:tid"), ("fill", fill | {"time": -1}, "BAD_TIME:time"),
        ("fill", fill | {"time": 8_640_000_000_000_001}, "BAD_TIME:time"), ("stream_fills", {"fills": [fill, fill], "user": "0x1"}, None), ("stream_fills", {"fills": [], "user": "0x1"}, None), ("stream_fills", {"fills": [fill, fill | {"px": "x"}], "user": "0x1"}, "BAD_MEMBER:fills"),
        ("stream_fills", {"fills": [fill, None], "user": "0x1"}, "BAD_MEMBER:fills"), ("stream_fills", {"fills": [{k: v for k, v in fill.items() if k != "hash"}], "user": "0x1"}, "BAD_MEMBER:fills"), ("spot_state", {"balances": [{"coin": "X", "entryNtl": "0", "hold": "0", "total": "1e3"}]}, None),
        ("spot_state", {"balances": [{"coin": "X", "entryNtl": "0", "hold": "", "total": "1"}]}, "BAD_MEMBER:balances"),
        ("clearinghouse_state", {"assetPositions": [{"type": "oneWay", "position": {"coin": "X"}}], "crossMaintenanceMarginUsed": "0", "crossMarginSummary": {"accountValue": "1"}, "marginSummary": {"accountValue": "1"}, "withdrawable": "0"}, "BAD_MEMBER:assetPositions"),
    ]
    for kind, row, want in cases:
        [got] = records.parse(spark.createDataFrame([(json.dumps(row),)], "value string"), kind).collect()
        assert got.error_code == want, (kind, row)


def test_days_of_several_scopes_and_ages(spark):
    from datetime import datetime

    from pyspark.sql import functions as F

    from tideglass.functions import scalar as S
    from tideglass.operators import returns

    at = [datetime(2024, 1, d, 12) for d in (1, 2, 3)]
    rows = [(1, at[0], 0, 5.0, "a"), (1, at[1], 1, 6.0, "a"), (2, at[0], 2, 5.0, "a"), (2, at[1], 3, 6.0, "b"), (3, at[0], 4, 0.0, "a")]
    days = returns.daily_nav(spark.createDataFrame(rows, "k long, ts timestamp_ntz, id long, nav double, scope string"), ["k"], scope="scope").orderBy("k", "day").collect()
    assert [(r.k, r.nav, r.error_code) for r in days] == [(1, 5.0, None), (1, 6.0, None), (2, None, "MIXED_SCOPE"), (2, None, "MIXED_SCOPE"), (3, None, "NON_POSITIVE_NAV")]
    ages = spark.createDataFrame([(at[0], at[1]), (at[2], at[1]), (None, at[0])], "a timestamp_ntz, b timestamp_ntz").select(S.age_hours(F.col("a"), F.col("b")).alias("h")).collect()
    assert [r.h for r in ages] == [24.0, -24.0, None]


def test_every_kind_of_record_has_a_schema_that_reads(spark):
    from tideglass.sources import records

    for kind in records.SCHEMAS:
        [r] = records.parse(spark.createDataFrame([("{",)], "value string"), kind).collect()
        assert r.error_code == "CORRUPT", kind
