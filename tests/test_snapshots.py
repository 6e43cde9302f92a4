"""Digests, bucket snapshots, the chain of fingerprints and checked changes."""

import hashlib
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tideglass.operators import snapshots
from tideglass.operators.evidence import gap_manifest

T0 = datetime(2024, 1, 1)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_digest(rows):
    """(fingerprint, content) rows sorted once and hashed level by level."""
    lines = sorted(f"{fp}:{sha(content)}" for fp, content in rows)

    def level(named):
        out = {}
        for name, line in named:
            out.setdefault(name, []).append(line)
        return {name: sha("\n".join(x)) for name, x in sorted(out.items())}

    chunks = level((line[: snapshots.CHUNK], line) for line in lines)
    groups = level((c[: snapshots.GROUP], f"{c}:{d}") for c, d in chunks.items())
    return sha(f"{len(rows)}\n{level(('', f'{g}:{d}') for g, d in groups.items())['']}")


def test_digests_depend_on_rows_alone(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), str(rng.randrange(400))) for _ in range(900)]
    df = spark.createDataFrame(rows, "k long, content string").withColumn("fp", F.sha2("content", 256))
    told = {r.k: (r.n_rows, r.digest) for r in snapshots.ordered_digest(df, ["k"], "fp", F.col("content")).collect()}
    again = {r.k: (r.n_rows, r.digest) for r in snapshots.ordered_digest(df.repartition(7, "content"), ["k"], "fp", F.col("content")).collect()}
    assert told == again == {k: (len(own), plain_digest([(sha(c), c) for c in own])) for k in range(3) for own in [[c for q, c in rows if q == k]]}


def test_table_manifest_sees_any_change_but_that_of_order(spark):
    rows = [(i % 5, i, None if i % 7 == 0 else f"x{i}") for i in range(200)] + [(1, 1, "x1")]

    def told(r, parts=3):
        return snapshots.table_manifest(spark.createDataFrame(r, "wallet long, n long, s string").repartition(parts), ["wallet", "n", "s"]).first()

    base = told(rows)
    assert (base.n_rows, base.n_wallets) == (201, 5) and told(rows[::-1], 8) == base
    for changed in (rows[:-1], [*rows, rows[0]], [(0, 0, "")] + rows[1:], [(4, 0, None)] + rows[1:]):
        assert told(changed).digest != base.digest


def test_a_gap_that_is_not_sound_refuses_the_manifest(spark):
    schema = "issue_id long, fingerprint string, wallet long, start_at timestamp_ntz, boundary_id long, end_at timestamp_ntz"
    good = [(i, f"f{i}", i % 3, T0, i, T0 + timedelta(hours=1)) for i in range(9)]

    def told(rows):
        return snapshots.gap_recovery_manifest(gap_manifest(spark.createDataFrame(rows, schema))).first()

    whole = told(good)
    assert (whole.n_rows, whole.n_wallets, whole.error_code) == (9, 3, None) and whole.sha256 == told(good[::-1]).sha256 != told(good[:-1]).sha256
    for bad, code in (((20, "f20", 1, T0, None, T0), "NO_END_BOUNDARY"), ((20, "f20", 1, T0, 1, T0), "INVALID_TIME_RANGE"), ((3, "f20", 1, T0, 1, T0 + timedelta(hours=1)), "DUPLICATE_IDENTITY")):
        r = told([*good, bad])
        assert (r.n_rows, r.sha256, r.error_code) == (None, None, code)
    assert told([]).n_rows == 0


EVENT = "cohort long, coin string, bucket timestamp_ntz, id long, version string, wallet long, ts timestamp_ntz, event_type string, direction string, notional string, source_id long, ordinal int, run_id long, selection_id long, performance_id long"


def filed(spark, rows):
    return spark.createDataFrame(rows, EVENT).withColumn("fingerprint", snapshots.event_identity())


def event(i, bucket=0, wallet=1, coin="BTC", **change):
    at = T0 + timedelta(minutes=15 * bucket)
    row = {"cohort": 0, "coin": coin, "bucket": at, "id": i, "version": "behavior-v1", "wallet": wallet, "ts": at + timedelta(minutes=3), "event_type": "POSITION_OPEN", "direction": "LONG", "notional": "0.1", "source_id": i, "ordinal": 0, "run_id": 1, "selection_id": 1, "performance_id": 1}
    return tuple((row | change).values())


def test_issues_block_a_bucket(spark):
    members = spark.createDataFrame([(0, 1), (0, 2)], "cohort long, wallet long")
    rows = [
        event(1), event(2, 1, notional="1e5"), event(3, 2, notional="-1"), event(4, 3, ts=T0), event(5, 4, wallet=9), event(6, 5, selection_id=None), event(7, 6, ordinal=2), event(8, 7, direction="UP"),
        event(9, 8), event(9, 8, notional="7"), event(10, 9), event(10, 9), event(11, 10, notional="1" + "0" * 20), event(12, 11, notional=None), event(13, 12, version="behavior-v2"),
    ]
    events = filed(spark, rows)
    got = {r.bucket: (r.status, r.issues, r.n_events) for r in snapshots.snapshots(events, members).collect()}
    want = ["", "INVALID_DECIMAL", "INVALID_DECIMAL", "INVALID_TIMESTAMP", "INCONSISTENT_PROVENANCE", "INCONSISTENT_PROVENANCE", "INVALID_IDENTITY", "INVALID_SEMANTIC", "CONFLICTING_DUPLICATE", "", "INVALID_DECIMAL", "INVALID_DECIMAL", "INCONSISTENT_PROVENANCE"]
    assert got == {T0 + timedelta(minutes=15 * b): ("BLOCKED" if i else "VALID", i, 2 if b == 8 else 1) for b, i in enumerate(want)}
    forged = events.withColumn("fingerprint", F.when(F.col("id") == 1, F.sha2(F.lit("x"), 256)).otherwise(F.col("fingerprint")))
    assert snapshots.event_issues(forged, members).filter("issue = 'INVALID_IDENTITY' AND subject = '1'").count() == 1


def test_a_changed_event_marks_its_bucket_signal_and_changes(spark):
    members = spark.createDataFrame([(0, 1), (0, 2)], "cohort long, wallet long")
    weights = spark.createDataFrame([(0, "w" * 64)], "cohort long, weight_fingerprint string")
    rows = [event(10 * b + k, b, wallet=1 + k % 2, coin=c) for c in ("BTC", "ETH") for b in (0, 1, 2, 3, 5) for k in range(4 if c == "BTC" else 2)]
    rows = [(*r[:3], n, *r[4:10], n, *r[11:]) for n, r in enumerate(rows)]

    def chained(r):
        return snapshots.chain(snapshots.snapshots(filed(spark, r).repartition(3), members), weights)

    at = next(i for i, r in enumerate(rows) if r[1] == "BTC" and r[2] == T0 + timedelta(minutes=15))
    changed = [*rows[:at], (*rows[at][:9], "0.2", *rows[at][10:]), *rows[at + 1 :]]
    states = {(r.coin, (r.bucket - T0) // timedelta(minutes=15)): (r.bucket_state, r.signal_state, r.change_state) for r in snapshots.stale(chained(rows), chained(changed)).collect()}
    assert {k: v for k, v in states.items() if "STALE" in v} == {("BTC", 1): ("STALE", "STALE", "STALE"), ("BTC", 2): ("CURRENT", "CURRENT", "STALE")}
    assert states["BTC", 5] == ("CURRENT", "CURRENT", None) and states["ETH", 1] == ("CURRENT",) * 3
    gone = {(r.coin, r.bucket_state) for r in snapshots.stale(chained(rows), chained([r for r in rows if r[1] == "BTC"])).collect()}
    assert gone == {("BTC", "CURRENT"), ("ETH", "GONE")}
    assert all(r.bucket_state == "CURRENT" for r in snapshots.stale(chained(rows), chained(rows[::-1])).collect())


def signal(n, number=0, /, **change):
    h = sha(str(n))
    at = T0 + timedelta(minutes=15 * number)
    base = {
        "signal_id": h, "input_fingerprint": h, "coin": "BTC", "bucket": at, "bucket_end": at + timedelta(minutes=15), "signal_version": "signal-v1", "status": "VALID", "selection_id": 1, "cohort_fingerprint": sha("c"), "weight_id": sha("w"), "weight_fingerprint": sha("w"),
        "weight_version": "wallet-weight-v1", "revision_id": sha("r"), "aggregation_fingerprint": sha("a"), "aggregation_version": "behavior-aggregation-v1", "behavior_version": "behavior-v1", "buy_strength": "0.5", "sell_strength": "0.2", "net_signal": "0.3", "confidence": "0.1", "n_wallets": 3, "mass": "0.7",
    }
    return base | change


def test_both_signals_of_a_change_are_checked(spark):
    down = {"buy_strength": "0.2", "sell_strength": "0.5", "net_signal": "-0.3"}
    cases = [
        ({}, {}, (None, "NONE", "UNCHANGED_NET", "0")), (down, {}, (None, "BULLISH_REVERSAL", "EXACT_NET_TRANSITION", "0.6")), ({}, down, (None, "BEARISH_REVERSAL", "EXACT_NET_TRANSITION", "-0.6")),
        ({"buy_strength": "0.35", "sell_strength": "0.35", "net_signal": "0"}, {}, (None, "NONE", "DIRECTION_EMERGED_BUY", "0.3")),
        ({"status": "NO_SIGNAL"}, {"signal_version": "x"}, "SIGNAL_NOT_VALID"), ({}, {"signal_version": "signal-v2"}, "UNSUPPORTED_VERSION"), ({}, {"revision_id": "abc"}, "INVALID_PROVENANCE"), ({"signal_id": sha("z")}, {}, "INVALID_PROVENANCE"),
        ({}, {"selection_id": None}, "INVALID_PROVENANCE"), ({}, {"coin": "x" * 101}, "INVALID_PROVENANCE"), ({}, {"bucket": T0 + timedelta(minutes=16)}, "INVALID_BUCKET"), ({}, {"bucket_end": T0}, "INVALID_BUCKET"),
        ({}, {"buy_strength": "0.50"}, "INVALID_DECIMAL"), ({}, {"confidence": "0.1234567890123456789"}, "INVALID_DECIMAL"), ({}, {"net_signal": "1.3"}, "INVALID_DECIMAL"), ({}, {"mass": "0.6"}, "INCONSISTENT_SIGNAL"),
        ({}, {"n_wallets": 201}, "INCONSISTENT_SIGNAL"), ({}, {"buy_strength": "0", "sell_strength": "0", "net_signal": "0", "mass": "0"}, "INCONSISTENT_SIGNAL"),
        ({}, {"coin": "ETH"}, "INCOMPATIBLE_coin"), ({}, {"selection_id": 2}, "INCOMPATIBLE_selection_id"), ({}, {"cohort_fingerprint": sha("d")}, "INCOMPATIBLE_cohort_fingerprint"), ({"weight_id": sha("v"), "weight_fingerprint": sha("v")}, {}, "INCOMPATIBLE_weight_id"),
        ({}, {"bucket": T0 + timedelta(minutes=30), "bucket_end": T0 + timedelta(minutes=45)}, "NON_ADJACENT_BUCKETS"), ({}, {"signal_id": sha("1"), "input_fingerprint": sha("1")}, "NON_ADJACENT_BUCKETS"),
    ]
    rows = [{"case": n} | {f"previous_{k}": v for k, v in signal(1, **a).items()} | {f"current_{k}": v for k, v in signal(2, 1, **b).items()} for n, (a, b, _) in enumerate(cases)]
    kinds = {"bucket": "timestamp_ntz", "bucket_end": "timestamp_ntz", "selection_id": "long", "n_wallets": "long"}
    schema = "case long, " + ", ".join(f"{s}_{k} {kinds.get(k, 'string')}" for s in ("previous", "current") for k in signal(1))
    got = {r.case: r for r in snapshots.checked_changes(spark.createDataFrame(rows, schema)).collect()}
    for n, (_, _, want) in enumerate(cases):
        r = got[n]
        told = (r.error_code, r.event_type, r.reason, r.delta)
        assert told == (want if isinstance(want, tuple) else (want, None, None, None)), (n, want, told)
    assert got[0].change_id == sha(f"{sha('1')}\x00{sha('2')}")
