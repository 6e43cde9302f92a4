"""Exact mode against walks in fractions and decimals of 80 digits."""

import random
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import ROUND_HALF_EVEN, Context, Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tideglass.operators import cycles, exact

T0 = datetime(2024, 1, 1)
FILL = "wallet long, coin string, id long, ts timestamp_ntz, side string, size decimal(38,18), price decimal(38,18), delta decimal(38,18), start_position decimal(38,18), closed_pnl decimal(38,18), fee decimal(38,18)"
EIGHTY = Context(prec=80, rounding=ROUND_HALF_EVEN)


def rounded(x):
    """A fraction to 80 digits, half to even, as plain text."""
    if x == 0:
        return "0"
    exponent = 0
    a = abs(x)
    while a >= 10**80:
        a, exponent = a / 10, exponent + 1
    while a < 10**79:
        a, exponent = a * 10, exponent - 1
    return exact.text(Decimal(round(a) if x > 0 else -round(a)).scaleb(exponent, EIGHTY))


def moves(rng, n, wallet=1, coin="BTC", wide=True):
    at, out = Decimal(0), []
    for i in range(n):
        size = Decimal(rng.randint(1, 9999)).scaleb(-rng.randint(0, 6 if wide else 1))
        side = "BUY" if (at <= 0) == (rng.random() < 0.55) else "SELL"
        if rng.random() < 0.1 and at:
            side, size = ("SELL" if at > 0 else "BUY"), abs(at)
        delta = size if side == "BUY" else -size
        price = Decimal(rng.randint(1, 10**7)).scaleb(-3)
        out.append((wallet, coin, i, T0 + timedelta(minutes=7 * (i // 2)), side, size, price, delta, at, Decimal(rng.randint(-99, 99)).scaleb(-1), Decimal(rng.randint(0, 99)).scaleb(-2)))
        at += delta
    return out


def walk(rows, number=Fraction):
    """One key's cycles, one execution after the other."""
    out, cycle = [], None
    entry = number(0)
    for _, _, id_, ts, side, size, price, delta, start, pnl, fee in rows:
        size, price, delta, start, pnl, fee = (number(x) for x in (size, price, delta, start, pnl, fee))
        after = start + delta
        closed = number(0)
        if start == 0:
            cycle = None
        if start != 0 and (start > 0) != (delta > 0):
            closed = min(abs(start), size)
            share = fee * closed / size if start * after < 0 else fee
            cycle["gain"] += (price - entry) * (closed if side == "SELL" else -closed)
            cycle["sold"] += closed
            cycle["paid"] += closed * price
            cycle["fee"] += share
            cycle["pnl"] += pnl
            if after == 0 or start * after < 0:
                cycle["closed_at"] = ts
                cycle["entry"] = entry
            if start * after >= 0:
                continue
            fee, size = fee - share, size - closed
            cycle = None
        if cycle is None:
            entry = number(0)
            cycle = {"side": "LONG" if side == "BUY" else "SHORT", "id": str(id_), "opened_at": ts, "closed_at": None, **{k: number(0) for k in ("gain", "sold", "paid", "fee", "pnl", "bought")}}
            out.append(cycle)
            held = number(0)
        else:
            held = abs(start)
        entry = (held * entry + size * price) / (held + size)
        cycle["entry"] = entry
        cycle["bought"] += size
        cycle["fee"] += fee
    return out


@pytest.mark.parametrize("stretch", [7, 4096])
def test_cycles_equal_a_walk_in_fractions(spark, monkeypatch, stretch):
    monkeypatch.setattr(cycles, "FOLDED", stretch)
    rng = random.Random(stretch)
    rows = moves(rng, 300) + moves(rng, 120, wallet=2, coin="ETH") + moves(rng, 3, wallet=3)
    got = {(r.wallet, r.cycle): r for r in exact.exact_cycles(spark.createDataFrame(rows, FILL)).collect()}
    n = 0
    for wallet in (1, 2, 3):
        for number, c in enumerate(walk([r for r in rows if r[0] == wallet]), 1):
            r = got[wallet, number]
            assert (r.side, r.opening_id, r.opened_at, r.closed_at) == (c["side"], c["id"], c["opened_at"], c["closed_at"])
            assert (r.entry_quantity, r.exit_quantity, r.entry_price, r.fee, r.official_pnl, r.recomputed_pnl, r.net_pnl) == tuple(map(rounded, (c["bought"], c["sold"], c["entry"], c["fee"], c["pnl"], c["gain"], c["pnl"] - c["fee"])))
            assert r.exit_price == (rounded(c["paid"] / c["sold"]) if c["sold"] else None)
            n += 1
    assert n == len(got) > 20 and any(len(r.entry_price) > 70 for r in got.values())


def test_a_key_of_a_hundred_thousand_executions(spark):
    """One cycle that never closes, against a walk in decimals of 80 digits, whose own rounding leaves some 70 of them."""
    rng = random.Random(1)
    at, rows = Decimal(0), []
    for i in range(100_000):
        size = Decimal(rng.randint(1, 99))
        side = "SELL" if at > 5000 or (at > 200 and rng.random() < 0.48) else "BUY"
        delta = size if side == "BUY" else -size
        rows.append((1, "BTC", i, T0 + timedelta(seconds=20 * i), side, size, Decimal(rng.randint(1, 10**6)).scaleb(-2), delta, at, Decimal(0), Decimal("0.01")))
        at += delta
    entry = gain = Decimal(0)
    for _, _, _, _, side, size, price, delta, start, _, _ in rows:
        if delta > 0:
            entry = EIGHTY.divide(EIGHTY.add(EIGHTY.multiply(start, entry), EIGHTY.multiply(size, price)), start + size)
        else:
            gain = EIGHTY.add(gain, EIGHTY.multiply(EIGHTY.subtract(price, entry), size))
    [r] = exact.exact_cycles(spark.createDataFrame(rows, FILL).repartition(8)).collect()
    for got, want in ((r.entry_price, entry), (r.recomputed_pnl, gain)):
        assert abs(Decimal(got) / want - 1) < Decimal(10) ** -68
    assert r.fee == "1000" and r.closed_at is None


def test_wealth_of_five_thousand_periods(spark, monkeypatch):
    monkeypatch.setattr(exact, "STRETCH", 613)
    rng = random.Random(2)
    navs = defaultdict(list)
    for key, n in ((1, 5001), (2, 3), (3, 40)):
        navs[key] = [Decimal(rng.randint(10**6, 10**7)).scaleb(-4) for _ in range(n)]
    navs[3][7] = Decimal(0)
    rows = [(k, i, v[i - 1], v[i]) for k, v in navs.items() for i in range(1, len(v))]
    periods = spark.createDataFrame(rows, "key long, seq long, from_nav decimal(30,10), to_nav decimal(30,10)").repartition(5)
    got = exact.exact_wealth(periods, ["key"]).collect()
    assert [(r.key, r.error_code) for r in got if r.error_code] == [(3, "NON_POSITIVE_NAV")] and len(got) == 5000 + 2 + 1
    for key in (1, 2):
        loop, told = Decimal(1), {r.seq: r for r in got if r.key == key}
        for i, (a, b) in enumerate(zip(navs[key], navs[key][1:], strict=False), 1):
            loop = EIGHTY.multiply(loop, EIGHTY.divide(b, a))
            assert told[i].wealth == rounded(Fraction(b) / Fraction(navs[key][0]))
            assert abs(Decimal(told[i].wealth) / loop - 1) < Decimal(10) ** -74
        assert told[len(navs[key]) - 1].total_return == rounded(Fraction(navs[key][-1]) / Fraction(navs[key][0]) - 1)
    last = {r.key: r for r in exact.exact_return(periods, ["key"]).collect()}
    assert (last[1].n_periods, last[3].n_periods, last[3].total_return) == (5000, 0, None)


def test_sums_beyond_38_digits(spark):
    rng = random.Random(3)
    amounts = ["0", "0.000000000000000001", "99999999999999999999999999999999.999999999999999999", "1", "10", "0.5"] + [str(Decimal(rng.randrange(10**50)).scaleb(-18, Context(prec=60))) for _ in range(500)]
    amounts = [format(Decimal(a), "f") for a in amounts]
    df = spark.createDataFrame([(i % 7, a) for i, a in enumerate(amounts)], "k long, a string").repartition(4)
    got = {r.k: r.s for r in df.groupBy("k").agg(exact.wide_sum(exact.limbs(F.col("a"))).alias("s")).collect()}
    for k in range(7):
        total = sum((Fraction(a) for a in amounts[k::7]), Fraction(0))
        assert Fraction(got[k]) == total and (got[k] == "0" or not got[k].startswith("00"))
    bad = [None, "", "-1", "1e5", "01", ".5", "1.", "1.0000000000000000001", "1" + "0" * 32]
    assert spark.createDataFrame([(b,) for b in bad], "a string").filter(exact.limbs(F.col("a")).isNotNull()).count() == 0
    assert spark.createDataFrame([("0",), ("0.0",)], "a string").agg(exact.wide_sum(exact.limbs(F.col("a")))).first()[0] == "0"


def test_cells_list_their_wallets(spark):
    at = datetime(2024, 1, 1, 10, 3)
    rows = [(2, "BTC", at, "LONG", "POSITION_OPEN", "100000000000000000000000.000000000000000001"), (1, "BTC", at, "LONG", "POSITION_OPEN", "0.000000000000000001"), (1, "BTC", at, "SHORT", "POSITION_CLOSE", "7"), (9, "BTC", at, "LONG", "POSITION_OPEN", "5"), (1, "ETH", at, "LONG", "POSITION_OPEN", "1e3")]
    events = spark.createDataFrame(rows, "wallet long, coin string, ts timestamp_ntz, direction string, event_type string, notional string")
    members = spark.createDataFrame([(0, 1), (0, 2), (5, 9)], "cohort long, wallet long")
    got = {(r.cohort, r.coin, r.cell): (r.n_events, r.wallets, r.notional, r.n_invalid) for r in exact.exact_cells(events, members).collect()}
    assert got[0, "BTC", "TOTAL"] == (3, [1, 2], "100000000000000000000007.000000000000000002", 0)
    assert got[0, "BTC", "LONG_OPEN"] == (2, [1, 2], "100000000000000000000000.000000000000000002", 0) and got[5, "BTC", "TOTAL"] == (1, [9], "5", 0)
    assert got[0, "ETH", "TOTAL"] == (1, [1], None, 1)
