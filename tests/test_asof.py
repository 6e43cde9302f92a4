"""As-of joins and funding by days against plain searches."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tideglass.operators import cycles, relational

T0 = datetime(2024, 1, 1)


def test_asof_joins_equal_plain_searches(spark):
    rng = random.Random(7)

    def at():
        return None if rng.random() < 0.05 else T0 + timedelta(hours=rng.randrange(24 * 9))

    def key():
        return rng.choice(["a", "a", "a", "b", None])

    left = [(i, key(), at()) for i in range(120)]
    right = [(i, key(), at(), None if i % 9 == 0 else i * 10) for i in range(90)]
    l, r = spark.createDataFrame(left, "id long, k string, ts timestamp_ntz").repartition(3), spark.createDataFrame(right, "tie long, k string, at timestamp_ntz, v long").repartition(3)
    for join, best in ((relational.last_before, max), (relational.first_after, min)):
        got = {x.id: (x.asof_tie, x.asof_v) for x in join(l, r, ["k"], "ts", "at", "tie", ["tie", "v"]).collect()}
        assert len(got) == len(left)
        for i, k, ts in left:
            if ts is None:
                continue
            own = [x for x in right if x[1] == k and x[2] is not None and (x[2] < ts if best is max else x[2] > ts)]
            want = best(own, key=lambda x: (x[2], x[0]), default=None)
            if want is None and best is max and any(x[1] == k and x[2] is None for x in right):
                continue  # rows without a time come first
            assert got[i] == ((want[0], want[3]) if want else (None, None)), (i, k, ts)


def test_funding_over_many_days_equals_a_plain_search(spark):
    rng = random.Random(3)
    spans, at = [], 0
    for n in range(1, 40):
        at += rng.randint(1, 40)
        end = None if n == 39 else at + rng.randint(1, 60)
        spans.append((1, "BTC", n, T0 + timedelta(hours=at), None if end is None else T0 + timedelta(hours=end)))
        at = end or at
    paid = [(1, "BTC" if i % 11 else None, i, T0 + timedelta(hours=rng.randrange(at + 50)), 1.0) for i in range(400)] + [(2, "BTC", 900, T0, 1.0)]
    got = {r.funding_id: (r.allocation, r.cycle) for r in cycles.allocate_funding(
        spark.createDataFrame(paid, "wallet long, coin string, funding_id long, ts timestamp_ntz, amount double").repartition(4),
        spark.createDataFrame(spans, "wallet long, coin string, cycle long, opened_at timestamp_ntz, closed_at timestamp_ntz"),
    ).select("funding_id", "allocation", F.col("cycle")).collect()}
    assert len(got) == len(paid)
    for w, c, i, ts, _ in paid:
        own = [s for s in spans if (s[0], s[1]) == (w, c)]
        inside = [s[2] for s in own if s[3] < ts and (s[4] is None or ts < s[4])]
        edge = any(ts in (s[3], s[4]) for s in own)
        assert got[i] == (("CYCLE_BOUNDARY_AMBIGUOUS", None) if edge else ("ALLOCATED", inside[0]) if inside else ("NO_TRUSTED_CYCLE", None))
