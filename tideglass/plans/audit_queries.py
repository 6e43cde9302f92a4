"""Queries of the trust, completeness and reconciliation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import bucket_start
from ..operators import audit, cycles
from ..sources.tables import fills, table
from .registry import Registry
from .relational_queries import FILLS

REGISTRY = Registry()
add = REGISTRY.add

_LOG = "lg AS (SELECT o_custkey AS run_id, o_orderdate AS ts, o_orderkey % 4000 AS operation_key, CASE WHEN o_orderstatus = 'F' THEN 'QUARANTINED' ELSE 'TRUSTED' END AS to_state FROM orders)"
_TRUST = f"""{_LOG},
    oc AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY run_id, operation_key ORDER BY ts) = 1),
    mv AS (SELECT * FROM (SELECT *, coalesce(lag(to_state) OVER (PARTITION BY run_id ORDER BY ts, operation_key), 'TRUSTED') AS before_state FROM oc) WHERE to_state <> before_state),
    tr AS (SELECT run_id, count(*) AS revision, arg_max(to_state, (ts, operation_key)) AS state FROM mv GROUP BY run_id)"""


def _trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return audit.run_trust(o.select(F.col("o_custkey").alias("run_id"), F.col("o_orderdate").alias("at"), (F.col("o_orderkey") % 4000).alias("operation_key"), F.when(F.col("o_orderstatus") == "F", "QUARANTINED").otherwise("TRUSTED").alias("to_state")))


@add("run_id:l revision:l state:s", f"WITH {_TRUST} SELECT * FROM tr")
def run_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trust(spark, sf_dir)


@add("run_id:l error_code:s", f"""WITH {_TRUST}, rn AS (SELECT c_custkey AS run_id, c_custkey % 3 AS trust_revision, CASE WHEN c_custkey % 2 = 0 THEN 'TRUSTED' ELSE 'QUARANTINED' END AS trust_state FROM customer)
    SELECT rn.run_id, CASE WHEN coalesce(revision, 0) <> trust_revision OR coalesce(state, 'TRUSTED') <> trust_state THEN 'TRUST_INCONSISTENT' WHEN trust_state <> 'TRUSTED' THEN 'RUN_QUARANTINED' END AS error_code FROM rn LEFT JOIN tr ON tr.run_id = rn.run_id""")
def trusted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    runs = table(spark, sf_dir, "customer").select(k.alias("run_id"), (k % 3).alias("trust_revision"), F.when(k % 2 == 0, "TRUSTED").otherwise("QUARANTINED").alias("trust_state"))
    return audit.trusted_runs(runs, _trust(spark, sf_dir))


@add("wallet:l run_id:l version:s", """
    SELECT o_custkey AS wallet, o_orderkey AS run_id, 'v' || o_orderpriority[1] AS version FROM orders WHERE o_orderpriority[1] IN ('3', '2')
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority[1] WHEN '3' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey DESC) = 1""")
def version_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("wallet"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("at"), F.concat(F.lit("v"), F.substring("o_orderpriority", 1, 1)).alias("version"))
    return audit.newest_version(runs, ["wallet"], ["v3", "v2"])


@add("run_id:l is_evaluable:b", """
    WITH m AS (SELECT l_orderkey AS run_id, CASE l_linenumber % 3 WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END AS metric, l_returnflag <> 'R' AS ok, l_suppkey % 2 AS w FROM lineitem)
    SELECT run_id, count(DISTINCT metric) FILTER (ok) = 3 AND count(DISTINCT w) = 1 AS is_evaluable FROM m GROUP BY run_id""")
def evaluable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is a value of one of three metrics."""
    n, day = F.col("l_linenumber") % 3, F.to_date(F.lit("2024-01-01"))
    m = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.when(n == 1, "a").when(n == 2, "b").otherwise("c").alias("metric"), F.when(F.col("l_returnflag") != "R", "AVAILABLE").otherwise("FAILED").alias("status"), F.lit("v3").alias("version"),
        day.alias("period_from"), F.date_add(day, (F.col("l_suppkey") % 2).cast("int")).alias("period_to"), F.lit(1).alias("n_cycles"))
    return audit.evaluable(m, ["a", "b", "c"], "v3")


@add("wallet:l completeness:s", f"""
    WITH {FILLS}, o AS (SELECT *, start_position + wallet % 3 AS sp FROM f WHERE wallet % 31 <> 0),
    w AS (SELECT DISTINCT user_id AS wallet FROM events),
    fs AS (SELECT wallet, bool_or(sp <> 0) AS open_start FROM (SELECT wallet, coin, arg_min(sp, (ts, id)) AS sp FROM o GROUP BY ALL) GROUP BY wallet),
    dy AS (SELECT DISTINCT wallet, CAST(ts AS DATE) AS day FROM f WHERE wallet % 4 <> 0 UNION SELECT wallet, unnest(generate_series(DATE '2024-01-02', DATE '2024-01-28', INTERVAL 1 DAY))::DATE FROM w WHERE wallet % 4 = 0),
    dg AS (SELECT wallet, count(*) AS n, bool_or(coalesce(gap, FALSE)) AS gap, min(day) AS lo, max(day) AS hi FROM (SELECT *, day - lag(day) OVER (PARTITION BY wallet ORDER BY day) > 1 AS gap FROM dy) GROUP BY wallet),
    cu AS (SELECT wallet, wallet % 17 = 0 AS cgap, wallet % 19 = 0 AS failed FROM w),
    isu AS (SELECT wallet, wallet % 23 = 0 AS igap, wallet % 29 = 0 AS cut FROM w WHERE wallet % 23 = 0 OR wallet % 29 = 0)
    SELECT w.wallet, CASE WHEN coalesce(cgap, FALSE) OR coalesce(igap, FALSE) THEN 'GAP_DETECTED' WHEN coalesce(cut, FALSE) THEN 'TRUNCATED' WHEN open_start IS NULL OR coalesce(n, 0) < 2 THEN 'INSUFFICIENT_HISTORY' WHEN gap THEN 'GAP_DETECTED'
        WHEN coalesce(failed, FALSE) OR open_start OR lo > DATE '2024-01-02' OR hi < DATE '2024-01-28' THEN 'PARTIAL' ELSE 'COMPLETE' END AS completeness
    FROM w LEFT JOIN fs ON fs.wallet = w.wallet LEFT JOIN dg ON dg.wallet = w.wallet LEFT JOIN cu ON cu.wallet = w.wallet LEFT JOIN isu ON isu.wallet = w.wallet""")
def completeness_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fills(spark, sf_dir, offset=True)
    wallets = f.select("wallet").distinct()
    w = F.col("wallet")
    full = wallets.filter(w % 4 == 0).select("wallet", F.explode(F.expr("sequence(date'2024-01-02', date'2024-01-28', interval 1 day)")).alias("day"))
    days = f.filter(w % 4 != 0).select("wallet", F.col("ts").cast("date").alias("day")).union(full)
    cursors = wallets.select("wallet", F.when(w % 17 == 0, "GAP_DETECTED").otherwise("SUCCEEDED").alias("status")).union(wallets.filter(w % 19 == 0).select("wallet", F.lit("FAILED")))
    issues = wallets.filter(w % 23 == 0).select("wallet", F.lit("STREAM_GAP").alias("issue")).union(wallets.filter(w % 29 == 0).select("wallet", F.lit("HISTORY_LIMIT_REACHED")))
    asked = wallets.withColumns({"range_from": F.lit("2024-01-02").cast("date"), "range_to": F.lit("2024-01-28").cast("date")})
    return audit.completeness(asked, f.filter(w % 31 != 0), days, cursors, issues)


@add("id:l issue:s", f"""WITH {FILLS}, a AS (SELECT *, start_position AS s, start_position + delta AS e, sign(start_position) * sign(start_position + delta) < 0 AS flips FROM f),
    tr AS (SELECT id, 0 AS ordinal, CASE WHEN flips THEN abs(s) ELSE abs(e - s) END AS q, s AS pb, CASE WHEN flips THEN 0 ELSE e END AS pa FROM a UNION ALL SELECT id, 1, abs(e), 0, e FROM a WHERE flips),
    g AS (SELECT id, count(*) AS n, count(DISTINCT ordinal) AS nd, max(ordinal) AS mo, sum(q) AS q, arg_min(pb, ordinal) AS pb, arg_max(pa, ordinal) AS pa FROM tr WHERE id % 37 <> 0 AND NOT (id % 41 = 0 AND ordinal = 1) GROUP BY id)
    SELECT a.id, 'SOURCE_LEGS_INCOMPLETE' AS issue FROM a LEFT JOIN g ON g.id = a.id WHERE NOT coalesce(n = CASE WHEN flips THEN 2 ELSE 1 END AND nd = n AND mo = n - 1 AND q = size AND pb = s AND pa = e AND size > 0, FALSE)""")
def leg_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fills(spark, sf_dir)
    events = cycles.transitions(f).filter("id % 37 <> 0 and not (id % 41 = 0 and ordinal = 1)")
    return audit.leg_issues(f, events)


def _readiness(f: DataFrame, members: DataFrame, required: DataFrame) -> DataFrame:
    w = F.col("wallet")
    last = f.groupBy("wallet", "coin").agg(F.max("ts").alias("last_at"))
    done = F.when(w % 4 == 0, None).when(w % 3 == 0, F.col("last_at") - F.expr("interval 1 hour")).otherwise(F.col("last_at"))
    progress = last.filter("wallet <> 7").select("wallet", "coin", done.alias("done_to"), F.col("last_at").alias("observed_to"), (w % 5 == 0).alias("has_gap"))
    ends = required.select("coin", (bucket_start(F.col("ts")) + F.expr("interval 15 minutes")).alias("bucket_end")).distinct()
    return audit.readiness(members, ends, progress, last)


@add("cohort:l coin:s bucket_end:t wallet:l issue:s", f"""
    WITH {FILLS}, mb AS (SELECT DISTINCT wallet // 10 AS cohort, wallet FROM f), be AS (SELECT DISTINCT coin, time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS bucket_end FROM f),
    la AS (SELECT wallet, coin, max(ts) AS last_at FROM f GROUP BY ALL),
    pg AS (SELECT wallet, coin, CASE WHEN wallet % 4 = 0 THEN NULL WHEN wallet % 3 = 0 THEN last_at - INTERVAL 1 HOUR ELSE last_at END AS done_to, last_at AS observed_to, wallet % 5 = 0 AS has_gap FROM la WHERE wallet <> 7),
    jn AS (SELECT mb.cohort, be.coin, be.bucket_end, mb.wallet, has_gap, observed_to, done_to, last_at FROM be CROSS JOIN mb LEFT JOIN pg ON pg.wallet = mb.wallet AND pg.coin = be.coin LEFT JOIN la ON la.wallet = mb.wallet AND la.coin = be.coin)
    SELECT cohort, coin, bucket_end, wallet, 'SOURCE_GAP' AS issue FROM jn WHERE has_gap UNION ALL SELECT cohort, coin, bucket_end, wallet, 'SOURCE_NOT_OBSERVED' FROM jn WHERE coalesce(observed_to < bucket_end, TRUE)
    UNION ALL SELECT cohort, coin, bucket_end, wallet, CASE WHEN done_to IS NULL THEN 'MISSING_BOUNDARY' ELSE 'NORMALIZATION_LAG' END FROM jn WHERE done_to IS NULL OR last_at > done_to""")
def bucket_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every wallet, in cohorts of ten, against every bucket."""
    f = fills(spark, sf_dir)
    return _readiness(f, f.select(F.floor(F.col("wallet") / 10).alias("cohort"), "wallet").distinct(), f)


@add("wallet:l range_from:t range_to:t", """
    WITH s AS (SELECT o_custkey AS wallet, o_orderdate AS ts FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, l_shipdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R')
    SELECT c_custkey AS wallet, coalesce(min(ts), TIMESTAMP '2020-01-01') AS range_from, coalesce(max(ts), TIMESTAMP '2020-01-01') AS range_to FROM customer LEFT JOIN s ON s.wallet = c_custkey GROUP BY c_custkey""")
def calculation_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    shipped = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    facts = [o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("wallet"), F.col("o_orderdate").alias("ts")), shipped.select(F.col("o_custkey").alias("wallet"), F.col("l_shipdate").alias("ts"))]
    return audit.calculation_range(facts, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("wallet"), F.expr("timestamp_ntz'2020-01-01'").alias("since")))


@add("fingerprint:l state:s first_at:t n_opened:l", """
    WITH l AS (SELECT o_custkey AS fingerprint, o_orderdate AS ts, CASE WHEN o_orderstatus = 'F' THEN 'RESOLVED' ELSE 'OPEN' END AS st FROM orders)
    SELECT fingerprint, arg_max(st, (ts, st)) AS state, min(ts) AS first_at, count(*) FILTER (st = 'OPEN') AS n_opened FROM l GROUP BY fingerprint""")
def issue_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.issue_state(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("fingerprint"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderstatus") == "F", "RESOLVED").otherwise("OPEN").alias("state")))


@add("wallet:l coin:s ts:t id:l", """
    WITH p AS (SELECT user_id AS wallet, max(ts) FILTER (ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-10 12:00:00') AS i, max(ts) FILTER (ts < TIMESTAMP '2024-01-10') AS b FROM events GROUP BY 1)
    SELECT user_id AS wallet, event_type AS coin, ts, event_id AS id FROM events JOIN p ON p.wallet = user_id AND ts = coalesce(i, b)""")
def snapshot_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("wallet"), F.col("event_type").alias("coin"), "ts", F.col("event_id").alias("id"))
    return audit.snapshot_in_window(e, ["wallet"], "2024-01-10 00:00:00", "2024-01-10 12:00:00")


@add("row_id:l issue:s", """
    SELECT event_id AS row_id, CASE WHEN c_custkey IS NULL THEN 'MISSING_JOB' WHEN c_custkey <> user_id THEN 'WALLET_MISMATCH' WHEN ts NOT BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' THEN 'OUTSIDE_JOB' END AS issue
    FROM (SELECT *, CASE WHEN event_id % 50 = 0 THEN -1 WHEN event_id % 51 = 0 THEN user_id + 1 ELSE user_id END AS job FROM events) LEFT JOIN customer ON c_custkey = job
    WHERE c_custkey IS NULL OR c_custkey <> user_id OR ts NOT BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20'""")
def dated_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = F.when(F.col("event_id") % 50 == 0, -1).when(F.col("event_id") % 51 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.col("user_id").alias("wallet"), "ts", job.alias("job_id"))
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_custkey").alias("wallet"), F.expr("timestamp_ntz'2024-01-03'").alias("started_at"), F.expr("timestamp_ntz'2024-01-20'").alias("finished_at"))
    return audit.dated_references(rows, jobs)


@add("wallet:l n_long:l n_short:l", f"""
    WITH {FILLS} SELECT wallet, count(*) FILTER (start_position >= 0) AS n_long, count(*) FILTER (start_position < 0) AS n_short FROM f GROUP BY wallet""")
def position_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fills(spark, sf_dir).withColumn("dir", F.when(F.col("start_position") >= 0, "Open LONG").otherwise("Close Short"))
    return audit.position_relations(f, "dir")


for _name in ("evaluable_runs", "bucket_readiness"):
    REGISTRY.alias(f"whole_{_name}", _name)
