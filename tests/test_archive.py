"""The archive as a data source: hours selected before objects are opened, streams by hour, lines that do not parse."""

import gzip
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tideglass.sources import archive
from tideglass.sources.tables import map_fill

ROW = {"time": 1704067200000, "user": "0xAB", "coin": "BTC", "side": "B", "px": "1.5", "sz": "2", "startPosition": "0", "closedPnl": "0", "fee": "0.1", "tid": 7}


def write(root, day, hour, lines, zipped=False):
    folder = root / day
    folder.mkdir(parents=True, exist_ok=True)
    data = "\n".join(lines).encode()
    (folder / f"{hour}.jsonl{'.gz' if zipped else ''}").write_bytes(gzip.compress(data) if zipped else data)


@pytest.fixture
def landed(spark, tmp_path):
    root = tmp_path / "archive"
    for day in ("20240101", "20240102"):
        for hour in range(0, 24, 6):
            write(root, day, hour, [json.dumps(ROW | {"tid": hour}), json.dumps([ROW, ROW | {"coin": "ETH"}])], zipped=hour == 6)
    return root


def load(spark, root):
    return archive.executions(spark, f"file://{root}")


def test_rows_and_fills(spark, landed):
    rows = load(spark, landed)
    assert rows.count() == 8 * 3 and rows.filter("corrupt is not null").count() == 0
    got = rows.filter("hour = timestamp_ntz'2024-01-01 06:00:00'").orderBy("line", "ordinal").select("line", "ordinal", "coin", "tid").collect()
    assert [tuple(r) for r in got] == [(0, 0, "BTC", 6), (1, 0, "BTC", 7), (1, 1, "ETH", 7)]
    one = map_fill(rows).first()
    assert (one.wallet, one.side, one.ts) == ("0xab", "BUY", datetime(2024, 1, 1))


@pytest.mark.parametrize(("condition", "hours"), [("hour >= timestamp_ntz'2024-01-02 12:00:00'", 2), ("hour = timestamp_ntz'2024-01-01 00:00:00'", 1), ("hour > timestamp_ntz'2024-01-01 06:00:00' AND hour < timestamp_ntz'2024-01-02 00:00:00'", 2), ("hour IN (timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-02 18:00:00')", 2), ("hour > timestamp_ntz'2025-01-01 00:00:00'", 0)])
def test_only_selected_hours_are_opened(spark, landed, condition, hours):
    """Objects outside the hours are spoilt: opening one would fail."""
    wanted = {r.hour for r in load(spark, landed).filter(condition).select("hour").distinct().collect()}
    assert len(wanted) == hours
    for o in archive.inventory(str(landed)):
        if o.hour not in wanted:
            with open(o.path, "wb") as f:
                f.write(b"\x1f\x8b spoilt")
            if not o.path.endswith(".gz"):
                (landed / o.path).rename(f"{o.path}.gz")
    assert load(spark, landed).filter(condition).count() == 3 * hours


def test_lines_that_do_not_parse_and_ambiguous_hours(spark, landed):
    write(landed, "20240103", 1, ["{", "", json.dumps(ROW | {"px": 5}), json.dumps([1, ROW]), json.dumps({"user": "x"}), "null"])
    rows = load(spark, landed).filter("hour = timestamp_ntz'2024-01-03 01:00:00'").orderBy("line", "ordinal").collect()
    assert [(r.line, r.ordinal, r.corrupt is None) for r in rows] == [(0, 0, False), (2, 0, False), (3, 0, False), (3, 1, True), (4, 0, False), (5, 0, False)]
    write(landed, "20240103", 1, ["{}"], zipped=True)
    with pytest.raises(Exception, match="several objects"):
        load(spark, landed).count()


def test_an_hour_counts_once_in_a_stream(spark, landed, tmp_path):
    archive.register(spark)

    def taken():
        query = spark.readStream.format("execution_archive").option("hoursPerBatch", 3).load(f"file://{landed}").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="0 seconds").start(f"{tmp_path}/rows")
        query.processAllAvailable()
        query.stop()
        return spark.read.parquet(f"{tmp_path}/rows").groupBy("hour").count().collect()

    assert {r["count"] for r in taken()} == {3} and len(taken()) == 8
    write(landed, "20240104", 5, [json.dumps(ROW)])
    told = {r["hour"]: r["count"] for r in taken()}
    assert len(told) == 9 and told[datetime(2024, 1, 4, 5)] == 1 and sum(told.values()) == 25


def test_an_empty_archive(spark, tmp_path):
    assert load(spark, tmp_path / "none").count() == 0
    assert load(spark, tmp_path / "none").select(F.col("hour")).count() == 0
