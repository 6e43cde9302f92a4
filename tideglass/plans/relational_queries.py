"""Queries of the relational operators over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import relational as R
from ..operators import selection as P
from ..operators.evidence import lane_availability as lanes
from ..sources.tables import fills, table
from .registry import Registry

REGISTRY = Registry()
add = REGISTRY.add

FILLS = """
    f0 AS (SELECT user_id AS wallet, event_type AS coin, event_id AS id, ts, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
    f1 AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, 1 + k % 3 AS size, k % 7 - 3 AS closed_pnl,
        CASE WHEN k % 2 = 0 THEN 1 + k % 3 ELSE -(1 + k % 3) END AS delta, (1 + k % 3) * CAST(0.01 AS DOUBLE) AS fee FROM f0),
    f AS (SELECT *, CAST(coalesce(sum(delta) OVER (PARTITION BY wallet, coin ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_position FROM f1)"""


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fills(spark, sf_dir).withColumn("notional", F.col("price") * F.col("size"))


@add("l_orderkey:l l_linenumber:l l_partkey:l net:r", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity < 24""")
def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").filter("l_shipdate >= timestamp_ntz'1995-01-01' and l_shipdate < timestamp_ntz'1996-01-01' and l_quantity < 24")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


_ROLLUP = "count(*) AS n_trades, sum(price * size) AS sum_notional, max(price * size) AS max_notional, avg(price * size) AS avg_notional, min(ts) AS first_seen, max(ts) AS last_seen, count(*) FILTER (side = 'BUY') AS n_buys, count(*) FILTER (side = 'SELL') AS n_sells"


@add("wallet:l n_trades:l sum_notional:r max_notional:r avg_notional:r first_seen:t last_seen:t n_buys:l n_sells:l", f"WITH {FILLS} SELECT wallet, {_ROLLUP} FROM f GROUP BY wallet")
def candidate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.candidate_rollup(_trades(spark, sf_dir))


@add("wallet:l coin:s n_trades:l sum_notional:r first_seen:t last_seen:t", f"WITH {FILLS} SELECT wallet, coin, {_ROLLUP} FROM f GROUP BY wallet, coin")
def candidate_coin_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.candidate_rollup(_trades(spark, sf_dir), ("wallet", "coin"))


@add("wallet:l n_coins:l n_days:l n_hours:l", f"WITH {FILLS} SELECT wallet, count(DISTINCT coin) AS n_coins, count(DISTINCT date_trunc('day', ts)) AS n_days, count(DISTINCT date_trunc('hour', ts)) AS n_hours FROM f GROUP BY wallet")
def activity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.activity(_trades(spark, sf_dir))


@add("wallet:l eligible:b reasons:s", f"""
    WITH {FILLS}, r AS (SELECT wallet, {_ROLLUP} FROM f GROUP BY wallet),
    c AS (SELECT *, CASE WHEN wallet % 9 = 0 THEN 'none' ELSE '0x' || lpad(CAST(wallet AS VARCHAR), 40, '0') END AS address FROM r),
    w AS (SELECT *, concat_ws(',', CASE WHEN NOT regexp_matches(address, '^0x[0-9a-f]{{40}}$') THEN 'INVALID_ADDRESS' END, CASE WHEN wallet % 11 = 0 THEN 'KNOWN_SYSTEM_ADDRESS' END,
        CASE WHEN wallet % 7 = 0 THEN 'ALREADY_WATCHED_ADDRESS' END, CASE WHEN n_trades < 60 THEN 'OBSERVED_TRADE_COUNT_BELOW_MINIMUM' END,
        CASE WHEN sum_notional < 12000 THEN 'OBSERVED_NOTIONAL_BELOW_MINIMUM' END, CASE WHEN last_seen < TIMESTAMP '2024-01-30' - INTERVAL 12 HOUR THEN 'LAST_ACTIVITY_OUTSIDE_LIGHT_WINDOW' END) AS reasons FROM c)
    SELECT wallet, reasons = '' AS eligible, reasons FROM w""")
def light_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("wallet")
    rolled = P.candidate_rollup(_trades(spark, sf_dir)).withColumn("address", F.when(w % 9 == 0, "none").otherwise(F.concat(F.lit("0x"), F.lpad(w.cast("string"), 40, "0"))))
    return P.light_filter(rolled, now=F.expr("timestamp_ntz'2024-01-30'"), least_trades=60, least_notional=12000, recent_hours=12, system=w % 11 == 0, watched=w % 7 == 0)


@add("wallet:l n_fills:l sum_notional:r active_days:l active_months:l state:s reasons:s completeness:s quality_score:l", f"""
    WITH {FILLS}, o AS (SELECT *, start_position + wallet % 3 AS sp FROM f),
    p AS (SELECT wallet, count(*) AS n_fills, sum(abs(price * size)) AS sum_notional, floor((epoch_ms(max(ts)) - epoch_ms(min(ts))) / 86400000) + 1 AS active_days,
        count(DISTINCT strftime(ts, '%Y-%m')) AS active_months, arg_min(sp, struct_pack(a := ts, b := id)) AS st, max(ts) AS last_seen, wallet % 5 = 0 AS truncated FROM o GROUP BY wallet),
    h AS (SELECT *, concat_ws(',', CASE WHEN truncated THEN 'API_HISTORY_LIMIT_REACHED' END, CASE WHEN st <> 0 THEN 'NON_FLAT_INITIAL_POSITION_BOUNDARY' END, CASE WHEN active_days < 28 THEN 'AVAILABLE_ACTIVITY_PERIOD_BELOW_MINIMUM' END,
            CASE WHEN active_months < 1 THEN 'AVAILABLE_ACTIVE_MONTHS_BELOW_MINIMUM' END) AS hr,
        concat_ws(',', CASE WHEN n_fills < 60 THEN 'FULL_TRADE_COUNT_BELOW_MINIMUM' END, CASE WHEN sum_notional < 12000 THEN 'FULL_NOTIONAL_BELOW_MINIMUM' END,
            CASE WHEN last_seen < TIMESTAMP '2024-01-30' - INTERVAL 1 DAY THEN 'LAST_ACTIVITY_OUTSIDE_FULL_WINDOW' END) AS vr FROM p)
    SELECT wallet, n_fills, sum_notional, active_days, active_months, CASE WHEN hr <> '' THEN 'INSUFFICIENT_HISTORY' WHEN vr <> '' THEN 'EXCLUDED' ELSE 'ELIGIBLE' END AS state, CASE WHEN hr <> '' THEN hr ELSE vr END AS reasons,
        CASE WHEN hr = '' THEN 'COMPLETE' WHEN truncated OR st <> 0 THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS completeness,
        greatest(0, 100 - CASE WHEN CASE WHEN hr <> '' THEN truncated OR st <> 0 ELSE truncated END THEN 30 ELSE 0 END - CASE WHEN active_days < 180 THEN 30 ELSE 0 END) AS quality_score FROM h""")
def full_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.full_filter(fills(spark, sf_dir, offset=True), now=F.expr("timestamp_ntz'2024-01-30'"), truncated=F.col("wallet") % 5 == 0, least_days=28, least_months=1, least_trades=60, least_notional=12000, recent_days=1)


@add("c_custkey:l score:l", """
    SELECT c_custkey, greatest(0, 100 - CASE WHEN c_acctbal < 0 THEN 30 ELSE 0 END - CASE WHEN n < 180 THEN 30 ELSE 0 END - CASE WHEN n = 0 THEN 30 ELSE 0 END - least(30, c_nationkey % 8 * 5)) AS score
    FROM (SELECT c_custkey, c_acctbal, c_nationkey, count(o_orderkey) * 20 AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count("o_orderkey") * 20).alias("n"))
    c = table(spark, sf_dir, "customer").join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return c.select("c_custkey", P.quality_score(F.col("c_acctbal") < 0, F.col("n"), F.col("n"), F.col("c_nationkey") % 8).alias("score"))


@add("l_orderkey:l l_linenumber:l actor:l role:s liquidity:s", """
    WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey % 40 AS b, l_suppkey % 40 AS s, l_returnflag = 'N' AS tb FROM lineitem)
    SELECT l_orderkey, l_linenumber, b AS actor, 'BUYER' AS role, CASE WHEN tb THEN 'TAKER' ELSE 'MAKER' END AS liquidity FROM t WHERE b <> s
    UNION ALL SELECT l_orderkey, l_linenumber, s, 'SELLER', CASE WHEN tb THEN 'MAKER' ELSE 'TAKER' END FROM t WHERE b <> s
    UNION ALL SELECT l_orderkey, l_linenumber, b, 'SELF', 'TAKER' FROM t WHERE b = s""")
def actor_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 40).alias("b"), (F.col("l_suppkey") % 40).alias("s"), (F.col("l_returnflag") == "N").alias("tb"))
    return P.actors(t, "b", "s", F.col("tb"))


_LINE = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


@add("l_orderkey:l l_linenumber:l l_partkey:l l_suppkey:l l_extendedprice:d", f"SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE}) = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], _LINE.split(", "))


@add("l_orderkey:l l_linenumber:l n_rows:l n_payloads:l is_conflict:b", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows, count(DISTINCT (l_partkey, l_suppkey, l_quantity)) AS n_payloads, count(DISTINCT (l_partkey, l_suppkey, l_quantity)) > 1 AS is_conflict FROM lineitem GROUP BY ALL")
def conflict_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.conflicts(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])


@add("o_orderdate:t o_orderkey:l o_totalprice:d", """
    SELECT o_orderdate, o_orderkey, o_totalprice FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-01' OR (o_orderdate = TIMESTAMP '1996-06-01' AND o_orderkey > 100) ORDER BY o_orderdate, o_orderkey LIMIT 51""")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestamp_ntz'1996-06-01'")
    return R.keyset_page(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], [at, 100], 50)


@add("o_custkey:l o_orderkey:l o_orderdate:t", "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def distinct_on_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")])


@add("c_nationkey:l rank:l c_custkey:l c_acctbal:d", "SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 5")
def topk_per_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_per_key(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 5, "rank")


@add("wallet:l run_id:l state:s error_code:s", """
    WITH runs AS (SELECT o_custkey AS wallet, o_orderkey AS run_id, o_orderdate AS run_at, o_orderstatus AS state FROM orders WHERE o_orderstatus <> 'P'),
    last AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY run_at DESC, run_id DESC) = 1),
    good AS (SELECT * FROM runs WHERE state = 'F' QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY run_at DESC, run_id DESC) = 1)
    SELECT l.wallet, g.run_id, g.state, CASE WHEN g.run_id IS NULL THEN 'NO_TRUSTED_RUN' END AS error_code FROM last l LEFT JOIN good g USING (wallet)""")
def latest_trusted_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("wallet"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("state"))
    best = runs.groupBy("wallet").agg(F.max(F.when(F.col("state") == "F", F.struct("at", "run_id", "state"))).alias("b"))
    return best.select("wallet", "b.run_id", "b.state", F.when(F.col("b").isNull(), "NO_TRUSTED_RUN").alias("error_code"))


_HOURS = "need AS (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS hour FROM events)"


def _hours(e: DataFrame) -> DataFrame:
    ends = e.agg(*(F.date_trunc("hour", f("ts")).cast("timestamp_ntz").alias(n) for n, f in (("lo", F.min), ("hi", F.max))))
    return ends.select(F.explode(F.expr("sequence(lo, hi, interval 1 hour)")).alias("hour"))


@add("coin:s bucket:t", "SELECT event_type AS coin, time_bucket(INTERVAL 15 MINUTE, ts) AS bucket FROM events WHERE event_type IN ('purchase', 'signup') UNION SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) FROM events WHERE event_type NOT IN ('purchase', 'signup')")
def union_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buckets of deals and those of all other events."""
    e = table(spark, sf_dir, "events").withColumn("bucket", S.bucket_start(F.col("ts"))).withColumnRenamed("event_type", "coin")
    deals = F.col("coin").isin("purchase", "signup")
    return e.filter(deals).select("coin", "bucket").union(e.filter(~deals).select("coin", "bucket")).distinct()


@add("hour:t state:s n_objects:l", f"""
    WITH {_HOURS}, have AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1)
    SELECT hour, CASE WHEN n IS NULL THEN 'MISSING' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'SELECTED' END AS state, coalesce(n, 0) AS n_objects FROM need LEFT JOIN have USING (hour)""")
def landing_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import landing_plan as plan

    e = table(spark, sf_dir, "events")
    return plan(e.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.lit(1).alias("bytes")), _hours(e))


@add("hour:t", f"WITH {_HOURS} SELECT hour FROM need WHERE hour NOT IN (SELECT date_trunc('hour', ts) FROM events WHERE event_type = 'error')")
def missing_hours_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    have = e.filter("event_type = 'error'").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).distinct()
    return R.missing(_hours(e), have, ["hour"])


@add("c_custkey:l c_name:s", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@add("o_orderkey:l o_custkey:l", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def excluded_rows_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(gone, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@add("event_id:l user_id:l ts:t asof_value:d", """
    SELECT e.event_id, e.user_id, e.ts, (SELECT v.value FROM events v WHERE v.event_type = 'purchase' AND v.user_id = e.user_id AND v.ts < e.ts ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS asof_value
    FROM events e WHERE e.event_type = 'error'""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return R.last_before(e.filter("event_type = 'error'").select("event_id", "user_id", "ts"), e.filter("event_type = 'purchase'"), ["user_id"], "ts", "ts", "event_id", ["value"])


@add("event_id:l user_id:l ts:t asof_event_id:l asof_ts:t", """
    SELECT e.event_id, e.user_id, e.ts, n.event_id AS asof_event_id, n.ts AS asof_ts FROM events e
    LEFT JOIN LATERAL (SELECT v.event_id, v.ts FROM events v WHERE v.event_type = 'click' AND v.user_id = e.user_id AND v.ts > e.ts ORDER BY v.ts, v.event_id LIMIT 1) n ON TRUE WHERE e.event_type = 'error'""")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return R.first_after(e.filter("event_type = 'error'").select("event_id", "user_id", "ts"), e.filter("event_type = 'click'"), ["user_id"], "ts", "ts", "event_id", ["event_id", "ts"])


@add("user_id:l event_type:s n:l k_sum:l k_max:l", "SELECT user_id, event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_sum, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_max FROM events GROUP BY ALL")
def json_extract_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


@add("event_id:l fingerprint:s", "SELECT event_id, sha256('v1' || chr(0) || CAST(event_id AS VARCHAR) || chr(0) || event_type) AS fingerprint FROM events")
def event_fingerprint_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.fingerprint(F.lit("v1"), F.col("event_id"), F.col("event_type")).alias("fingerprint"))


@add("n_rows:l checksum:s", """
    SELECT count(*) AS n_rows, CAST(sum(CAST(('0x' || md5(concat_ws('|', CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment))[1:15]) AS BIGINT)) AS VARCHAR) AS checksum FROM customer""")
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table_fingerprint(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


@add("user_id:l n_days:l n_gaps:l is_continuous:b", """
    WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), g AS (SELECT *, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) > 1 AS gap FROM d)
    SELECT user_id, count(*) AS n_days, count(*) FILTER (gap) AS n_gaps, count(*) FILTER (gap) = 0 AS is_continuous FROM g GROUP BY user_id""")
def date_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.day_gaps(table(spark, sf_dir, "events"), ["user_id"], "ts")


@add("coin:s run_start:t run_end:t run_length:l", """
    WITH b AS (SELECT DISTINCT event_type AS coin, time_bucket(INTERVAL 15 MINUTE, ts) AS bucket FROM events),
    g AS (SELECT *, bucket - INTERVAL 15 MINUTE * row_number() OVER (PARTITION BY coin ORDER BY bucket) AS grp FROM b)
    SELECT coin, min(bucket) AS run_start, max(bucket) AS run_end, count(*) AS run_length FROM g GROUP BY coin, grp""")
def bucket_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "events").select(F.col("event_type").alias("coin"), S.bucket_start(F.col("ts")).alias("bucket")).distinct()
    return R.islands(b, ["coin"], "bucket", 900)


@add("event_id:l user_id:l event_type:s", """
    SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20' OR event_type = 'error'
    OR event_id IN (SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)""")
def retention_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    newest = e.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("_n")).select(F.col("_n.event_id").alias("event_id"), F.lit(True).alias("_newest"))
    return e.join(newest, "event_id", "left").filter("ts >= timestamp_ntz'2024-01-20' or event_type = 'error' or _newest")


@add("key:l state:s", """
    WITH m AS (SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation FROM customer WHERE c_custkey % 10 <> 0),
    c AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 17 = 0 THEN 'x' ELSE c_name END AS name, c_nationkey AS nation FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 31 = 0),
    g AS (SELECT key, count(*) AS n, min((name, nation)) AS v FROM c GROUP BY key)
    SELECT coalesce(m.key, g.key) AS key, CASE WHEN n IS NULL THEN 'MISSING' WHEN m.key IS NULL THEN 'UNLISTED' WHEN n > 1 THEN 'DUPLICATE' WHEN (m.name, m.nation) = v THEN 'EXACT' ELSE 'MISMATCH' END AS state FROM m FULL JOIN g ON m.key = g.key""")
def manifest_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    now = t.filter("key % 7 <> 0").withColumn("name", F.when(F.col("key") % 17 == 0, "x").otherwise(F.col("name"))).unionByName(t.filter("key % 31 = 0"))
    return R.reconcile(t.filter("key % 10 <> 0"), now, "key", ["name", "nation"])


@add("l_suppkey:l rank:l code:s n:l scopes:s", """
    WITH w AS (SELECT l_suppkey, CASE l_returnflag WHEN 'R' THEN 'RETURNED' WHEN 'A' THEN 'ACCEPTED' ELSE 'OPEN' END || '_' || l_linestatus AS code, l_shipdate >= TIMESTAMP '1997-01-01' AS fresh FROM lineitem),
    a AS (SELECT l_suppkey, code, count(*) AS n, array_to_string(list_sort(list(DISTINCT CASE WHEN fresh THEN 'NEW' ELSE 'OLD' END)), ',') AS scopes FROM w GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, code) AS rank FROM a QUALIFY rank <= 3""")
def warning_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    meaning = F.when(F.col("l_returnflag") == "R", "RETURNED").when(F.col("l_returnflag") == "A", "ACCEPTED").otherwise("OPEN")
    fresh = F.when(F.col("l_shipdate") >= F.expr("timestamp_ntz'1997-01-01'"), "NEW").otherwise("OLD")
    w = table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat_ws("_", meaning, "l_linestatus").alias("code"), fresh.alias("scope"))
    a = w.groupBy("l_suppkey", "code").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("scope"))).alias("scopes"))
    return R.top_per_key(a, ["l_suppkey"], [F.desc("n"), F.col("code")], 3, "rank")


@add("wallet:l coin:s is_flat:b n_first:l", f"""
    WITH {FILLS}, o AS (SELECT *, start_position + wallet % 3 AS sp, rank() OVER (PARTITION BY wallet, coin ORDER BY ts) AS r FROM f)
    SELECT wallet, coin, count(*) = 1 AND min(sp) = 0 AS is_flat, count(*) AS n_first FROM o WHERE r = 1 GROUP BY ALL""")
def first_boundary_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fills(spark, sf_dir, offset=True)
    first = f.groupBy("wallet", "coin", "ts").agg(F.count(F.lit(1)).alias("n"), F.min("start_position").alias("sp")).groupBy("wallet", "coin").agg(F.min(F.struct("ts", "n", "sp")).alias("a"))
    return first.select("wallet", "coin", ((F.col("a.n") == 1) & (F.col("a.sp") == 0)).alias("is_flat"), F.col("a.n").alias("n_first"))


@add("lane:s status:s first_from:t last_to:t n:l reasons:s", """
    WITH r AS (SELECT CASE o_orderpriority[1] WHEN '1' THEN 'trade' WHEN '2' THEN 'return' ELSE 'exposure' END AS lane, o_orderstatus, o_orderdate FROM orders)
    SELECT lane, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'AVAILABLE' WHEN bool_or(o_orderstatus = 'F') THEN 'PARTIAL' ELSE 'UNAVAILABLE' END AS status, min(o_orderdate) AS first_from, max(o_orderdate) AS last_to, count(*) AS n,
        array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS reasons FROM r GROUP BY lane""")
def lane_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    rows = table(spark, sf_dir, "orders").withColumn("lane", F.when(first == "1", "trade").when(first == "2", "return").otherwise("exposure"))
    return lanes(rows, ["lane"], ok=F.col("o_orderstatus") == "F", start="o_orderdate", end="o_orderdate", reason="o_orderstatus")


@add("o_custkey:l n_f:l n_o:l n_p:l", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return p.select("o_custkey", *(F.coalesce(F.col(c), F.lit(0)).alias(f"n_{c.lower()}") for c in "FOP"))


@add("o_orderkey:l category:s is_external:b", """
    WITH o AS (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN ' Deposit' WHEN 1 THEN 'with-draw' WHEN 2 THEN 'bridge' WHEN 3 THEN 'account_Class_Transfer' WHEN 4 THEN 'Referral Reward' WHEN 5 THEN 'liquidation' WHEN 6 THEN 'send' ELSE 'vault' END AS kind,
        o_totalprice * (CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 5 = 1 THEN -1 ELSE 1 END) AS amount, CASE o_orderstatus WHEN 'F' THEN 'INTERNAL' WHEN 'O' THEN 'EXTERNAL' END AS boundary FROM orders),
    c AS (SELECT *, CASE regexp_replace(lower(trim(kind)), '[\\s_-]', '', 'g') WHEN 'deposit' THEN 'deposit' WHEN 'withdraw' THEN 'withdrawal' WHEN 'bridge' THEN 'bridge' WHEN 'accountclasstransfer' THEN 'transfer' WHEN 'send' THEN 'transfer' WHEN 'referralreward' THEN 'reward' WHEN 'liquidation' THEN 'liquidation' ELSE 'unknown' END AS category FROM o)
    SELECT o_orderkey, category, CASE WHEN category = 'deposit' AND amount > 0 THEN TRUE WHEN category = 'withdrawal' AND amount <> 0 THEN TRUE WHEN category IN ('bridge', 'transfer') AND boundary = 'INTERNAL' THEN FALSE
        WHEN category IN ('bridge', 'transfer') AND boundary = 'EXTERNAL' AND amount <> 0 THEN TRUE WHEN category IN ('reward', 'liquidation') THEN FALSE END AS is_external FROM c""")
def cashflow_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, names = F.col("o_orderkey"), [" Deposit", "with-draw", "bridge", "account_Class_Transfer", "Referral Reward", "liquidation", "send", "vault"]
    sign = F.when(k % 5 == 0, 0).when(k % 5 == 1, -1).otherwise(1)
    boundary = F.when(F.col("o_orderstatus") == "F", "INTERNAL").when(F.col("o_orderstatus") == "O", "EXTERNAL")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, names)), (k % 8 + 1).cast("int")).alias("kind"), (F.col("o_totalprice") * sign).alias("amount"), boundary.alias("boundary"))
    rows = rows.withColumn("category", S.cash_flow_category(F.col("kind")))
    return rows.withColumn("is_external", S.cash_flow_external(F.col("category"), F.col("amount"), F.col("boundary")))


for _name in ("union_buckets", "landing_plan", "missing_hours_anti"):
    REGISTRY.alias(f"whole_{_name}", _name)
