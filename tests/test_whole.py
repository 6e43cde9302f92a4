"""Queries that must cover their whole table, on small tables made for it."""

import itertools
import json
import os
import random
from datetime import datetime, timedelta

from tideglass.operators import cohort
from tideglass.plans import audit_queries, exact_queries, relational_queries, trading_queries
from tideglass.streaming import streams

T0 = datetime(2024, 1, 1)
EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, folder, rows, files=1):
    """A table of events from (wallet, coin, k) in time order, as a folder of Parquet files."""
    data = [(i, T0 + timedelta(minutes=7 * i), w, c, 50.0 + i % 40, json.dumps({"k": k})) for i, (w, c, k) in enumerate(rows)]
    spark.createDataFrame(data, EVENT).repartitionByRange(files, "ts").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_long_history_is_followed_to_its_end(spark, tmp_path):
    d = events(spark, tmp_path, [(3, "view", i % 6) for i in range(400)])
    q = trading_queries.REGISTRY.queries
    assert q["whole_cycle_legs"](spark, d).select("id").distinct().count() == 400
    [plain] = q["trade_stats"](spark, d).collect()
    [whole] = q["whole_trade_stats"](spark, d).collect()
    assert whole == plain and whole.n_cycles > 60
    [exact] = trading_queries.exact_weights(spark, d).collect()
    assert float(exact.raw_weight) > 0 and exact.weight == "1"
    n = whole.n_cycles
    quality = (whole.win_rate + whole.profit_factor / (whole.profit_factor + 1)) / 2
    assert abs(float(exact.raw_weight) - quality * n / (n + 30) * (1 - whole.top_trade_share)) < 1e-5


def test_every_wallet_is_in_a_cohort(spark, tmp_path):
    d = events(spark, tmp_path, [(3 * (i % 9 + 1), "view", (i // 9) * 5 % 6) for i in range(360)])
    q = trading_queries.REGISTRY.queries
    weights = q["whole_wallet_weight_lr"](spark, d).collect()
    assert {r.wallet for r in weights} == {3 * i for i in range(1, 10)}
    for c in {r.cohort for r in weights}:
        assert sum(r.weight_units for r in weights if r.cohort == c) == 1_000_000_000
    rows = q["whole_wallet_contribution"](spark, d).collect()
    assert {r.wallet for r in rows if r.n_buy + r.n_sell} == {r.wallet for r in weights}
    assert {r.cohort for r in q["whole_signal_strength"](spark, d).collect()} == {0, 1, 2}


def test_members_without_events_have_zeros_in_every_bucket(spark, tmp_path):
    d = events(spark, tmp_path, [(3 * (i % 9 + 1), "view", (i // 9) * 5 % 6) for i in range(360)])
    with_all = trading_queries.REGISTRY.queries["wallet_contribution"](spark, d)
    rows = with_all.collect()
    buckets = {(r.coin, r.bucket) for r in rows}
    assert len(rows) == len(buckets) * len({r.wallet for r in rows}) == len({(r.coin, r.bucket, r.wallet) for r in rows})
    none = [r for r in rows if r.n_buy + r.n_sell == 0]
    assert none and {(r.n_buy, r.n_sell, r.buy, r.sell) for r in none} == {(0, 0, 0.0, 0.0)}


def test_frames_list_what_is_missing(spark):
    """The rows without events are made from lists of buckets, not by a join over all of them."""
    lists = spark.createDataFrame([("a", [T0, T0 + timedelta(minutes=15)]), ("b", [T0])], "coin string, _buckets array<timestamp_ntz>")
    frames = cohort.Frames(spark.createDataFrame([(w, c) for w in (1, 2) for c in "ab"], "wallet long, coin string"), lists)
    held = spark.createDataFrame([(1, "a", T0), (2, "b", T0)], "wallet long, coin string, bucket timestamp_ntz")
    got = {(r.wallet, r.coin, (r.bucket - T0).seconds // 60) for r in frames.missing(held, ["wallet", "coin"]).collect()}
    assert got == {(1, "a", 15), (1, "b", 0), (2, "a", 0), (2, "a", 15)}
    assert len(frames.select("bucket").collect()) == 6


def test_required_hours_and_buckets_come_from_the_table(spark, tmp_path):
    d = events(spark, tmp_path, [(i % 30, ("view", "error")[i % 2], i) for i in range(60)])
    hours = relational_queries.REGISTRY.queries["whole_landing_plan"](spark, d).collect()
    assert len(hours) == 7 and sum(r.n_objects for r in hours) == 60
    assert relational_queries.REGISTRY.queries["whole_missing_hours_anti"](spark, d).count() == 0
    assert relational_queries.REGISTRY.queries["whole_union_buckets"](spark, d).count() == len({(i % 2, 7 * i // 15) for i in range(60)})
    closed = trading_queries.REGISTRY.queries["whole_bucket_fail_closed"](spark, d).collect()
    assert (min(r.bucket for r in closed), max(r.bucket for r in closed)) == (T0, T0 + timedelta(minutes=405))
    assert {r.wallet for r in audit_queries.REGISTRY.queries["whole_bucket_readiness"](spark, d).collect()} == set(range(30))


def chain_by_force(begin, start, after):
    found = []
    for order in itertools.permutations(range(len(start))):
        at = begin
        for i in order:
            if start[i] != at:
                break
            at = after[i]
        else:
            found.append(list(order))
    return (found[0], None) if len(found) == 1 else (None, "ORDERING_AMBIGUOUS" if found else "IMPOSSIBLE_TRANSITION")


def test_only_chain_against_all_orders():
    rng = random.Random(7)
    seen = set()
    for _ in range(3000):
        at, start, after = rng.randint(-1, 1), [], []
        begin = at
        for _ in range(rng.randint(1, 6)):
            to = at + rng.choice([-2, -1, 1, 2, 3])
            start.append(at), after.append(to)
            at = to if rng.random() < 0.95 else to + 1
        both = list(zip(start, after, strict=True))
        rng.shuffle(both)
        start, after = [b[0] for b in both], [b[1] for b in both]
        got = cohort.only_chain(begin, start, after)
        assert got == chain_by_force(begin, start, after)
        seen.add(got[1])
    assert seen == {None, "ORDERING_AMBIGUOUS", "IMPOSSIBLE_TRANSITION"}


def order_of(spark, rows):
    df = spark.createDataFrame([(1, "BTC", i, T0 + timedelta(hours=h), s, d) for i, (h, s, d) in enumerate(rows)], "wallet long, coin string, id long, ts timestamp_ntz, start_position long, delta long")
    return {r.id: (r.place, r.issue) for r in cohort.causal_order(df).collect()}


def test_causal_order_of_large_and_equal_groups(spark):
    assert order_of(spark, [(0, i, 1) for i in reversed(range(1500))]) == {1499 - i: (i, None) for i in range(1500)}
    equal = [(0, 0, 1), (0, 1, -1), (0, 0, 1)]
    assert {v for v in order_of(spark, equal).values()} == {(None, "ORDERING_AMBIGUOUS")}
    # a group that ends where it began, one that goes on from it, a gap, and what follows the gap
    got = order_of(spark, [(0, 1, -1), (0, 0, 1), (1, 0, 2), (2, 3, 1), (3, 4, 1)])
    assert got == {0: (1, None), 1: (0, None), 2: (0, None), 3: (None, "IMPOSSIBLE_TRANSITION"), 4: (None, "IMPOSSIBLE_TRANSITION")}


NAMES = ("stream_buckets", "stream_positions", "stream_sessions")


def test_streams_read_a_folder_and_recompute_late_rows(spark, tmp_path, monkeypatch):
    rows = [(i // 5 % 3, "view", i) for i in range(90)]
    folder = events(spark, tmp_path / "many", rows, files=5)
    q = trading_queries.REGISTRY.queries
    want = {n: sorted(map(tuple, q[n](spark, folder).collect())) for n in NAMES}
    assert all(want.values()) and len(want["stream_positions"]) == 90
    # the newest file arrives first, and each file is a batch of its own
    late = tmp_path / "late"
    for n, path in enumerate(sorted((tmp_path / "many/events.parquet").glob("part-*"), reverse=True)):
        to = late / "events.parquet" / f"part-{n}.parquet"
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_bytes(path.read_bytes())
        os.utime(to, (1_700_000_000 + n, 1_700_000_000 + n))
    one = streams.event_stream
    monkeypatch.setattr(streams, "event_stream", lambda *a: one(*a, files_per_batch=1))
    stream = streams.event_stream(spark, f"{late}/events.parquet", spark.read.parquet(f"{late}/events.parquet").schema)
    assert streams.run_available(streams.position_stream(streams.as_fills(stream)), "late").filter("is_late").count() > 0
    for n in NAMES:
        assert sorted(map(tuple, q[n](spark, str(late)).collect())) == want[n]


def test_amounts_of_zero_are_amended_to_an_amount(spark, tmp_path):
    """The amended amount of an execution without a price is not the same, and is an amount still, as the SQL has it."""
    data = [(i, T0 + timedelta(minutes=7 * i), 1, "view", 0.0 if i == 134 else 50.0, json.dumps({"k": i})) for i in range(130, 140)]
    spark.createDataFrame(data, EVENT).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    rows = exact_queries.REGISTRY.queries["event_issues"](spark, str(tmp_path))
    assert [r.issue for r in rows.collect() if r.subject == "134"] == []
    assert rows.filter("issue = 'CONFLICTING_DUPLICATE'").count() > 0


def test_positions_do_not_call_python_for_each_key(spark, tmp_path, monkeypatch):
    """Ninety keys in two blocks, over several batches."""
    monkeypatch.setattr(streams, "POSITION_BLOCKS", 2)
    d = events(spark, tmp_path, [(i * 7 % 45, ("view", "error")[i % 2], i) for i in range(270)], files=3)
    one = streams.event_stream
    monkeypatch.setattr(streams, "event_stream", lambda *a: one(*a, files_per_batch=1))
    got = {r.id: r.start_position for r in trading_queries.REGISTRY.queries["stream_positions"](spark, d).collect()}
    assert got == {r.id: r.start_position for r in trading_queries.REGISTRY.queries["running_position"](spark, d).collect()}
