"""An archive of executions as a Spark data source: objects of one hour each, ``{path}/{YYYYMMDD}/{H}.jsonl`` or ``.jsonl.gz``.

    executions(spark, path).filter("hour >= timestamp_ntz'2024-01-02 00:00:00'")
    spark.readStream.format("execution_archive").option("hoursPerBatch", 24).load(path)

The inventory is listed once, on the driver, and each object is one task's. Comparisons of ``hour`` with constants select objects before any is
opened, for which Spark wants ``spark.sql.python.filterPushdown.enabled``; what cannot be selected by is left to Spark. A stream's offset is the last hour
taken, so an hour counts once, when its object is there; an object that appears for an earlier hour is not seen by it (``landing_plan`` tells of such).
Lines that do not parse are rows with ``corrupt``; an hour with several objects is an error, as it is ambiguous.
"""

from __future__ import annotations

import gzip
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

_OBJECT = re.compile(r"(?:^|/)(\d{8})/(\d{1,2})\.jsonl(\.gz)?$")
SCHEMA = "hour timestamp_ntz, line int, ordinal int, time long, user string, coin string, side string, px string, sz string, startPosition string, closedPnl string, fee string, tid long, corrupt string"
_FIELDS = ("time", "user", "coin", "side", "px", "sz", "startPosition", "closedPnl", "fee", "tid")
_ROWS = 8192
_COMPARED = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


@dataclass
class ArchiveObject(InputPartition):
    """One hour's object."""

    root: str
    path: str
    hour: datetime

    def __init__(self, root: str, path: str, hour: datetime) -> None:
        super().__init__(hour.isoformat())
        self.root, self.path, self.hour = root, path, hour


def inventory(root: str) -> list[ArchiveObject]:
    """The objects under ``root`` by hour."""
    files, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    out = []
    for info in files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
        found = _OBJECT.search(info.path) if info.is_file else None
        if found and int(found[2]) < 24:
            out.append(ArchiveObject(root, info.path, datetime.strptime(found[1], "%Y%m%d") + timedelta(hours=int(found[2]))))
    out.sort(key=lambda o: (o.hour, o.path))
    for a, b in zip(out, out[1:], strict=False):
        if a.hour == b.hour:
            raise ValueError(f"several objects for {a.hour}: {a.path}, {b.path}")
    return out


def _row(hour: datetime, line: int, ordinal: int, value: Any, text: str) -> dict[str, Any]:
    whole = isinstance(value, dict) and isinstance(value.get("time"), int) and all(value.get(f) is None or isinstance(value[f], int if f in ("time", "tid") else str) for f in _FIELDS)
    return {"hour": hour, "line": line, "ordinal": ordinal, **({f: value.get(f) for f in _FIELDS} if whole else dict.fromkeys(_FIELDS)), "corrupt": None if whole else text}


def _parsed(hour: datetime, lines: Iterator[str]) -> Iterator[dict[str, Any]]:
    for number, line in enumerate(lines):
        text = line.rstrip("\r\n")
        if not text.strip():
            continue
        try:
            value = json.loads(text)
        except ValueError:
            value = None
        for ordinal, one in enumerate(value if isinstance(value, list) else [value]):
            yield _row(hour, number, ordinal, one, text)


def read_object(part: ArchiveObject, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of one object, in batches."""
    files, _ = fs.FileSystem.from_uri(part.root) if "://" in part.root or part.root.startswith("file:") else (fs.LocalFileSystem(), part.root)
    with files.open_input_stream(part.path, compression=None) as raw:
        binary = gzip.GzipFile(fileobj=raw) if part.path.endswith(".gz") else raw
        held: list[dict[str, Any]] = []
        for row in _parsed(part.hour, io.TextIOWrapper(binary, "utf-8", errors="replace")):
            held.append(row)
            if len(held) == _ROWS:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class ArchiveReader(DataSourceReader):
    def __init__(self, root: str, schema: StructType) -> None:
        self.root, self.schema = root, _arrow(schema)
        self.tests: list[tuple[type[Filter], Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _COMPARED and f.attribute == ("hour",):
                self.tests.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[ArchiveObject]:
        return [o for o in inventory(self.root) if all(_COMPARED[kind](o.hour, value) for kind, value in self.tests)] or [ArchiveObject(self.root, "", datetime.min)]

    def read(self, partition: ArchiveObject) -> Iterator[pa.RecordBatch]:
        return read_object(partition, self.schema) if partition.path else iter(())


class ArchiveStreamReader(DataSourceStreamReader):
    def __init__(self, root: str, schema: StructType, hours: int) -> None:
        self.root, self.schema, self.hours = root, _arrow(schema), hours
        self.at: str | None = None

    def initialOffset(self) -> dict[str, str]:
        return {"hour": ""}

    def latestOffset(self) -> dict[str, str]:
        """The last of the next ``hours`` objects after what was told before."""
        new = [o for o in inventory(self.root) if o.hour.isoformat() > (self.at or "")]
        self.at = new[min(len(new), self.hours) - 1].hour.isoformat() if new else self.at or ""
        return {"hour": self.at}

    def partitions(self, start: dict[str, str], end: dict[str, str]) -> list[ArchiveObject]:
        self.at = max(self.at or "", end["hour"])
        return [o for o in inventory(self.root) if start["hour"] < o.hour.isoformat() <= end["hour"]]

    def read(self, partition: ArchiveObject) -> Iterator[pa.RecordBatch]:
        return read_object(partition, self.schema)

    def commit(self, end: dict[str, str]) -> None:
        pass


class ArchiveDataSource(DataSource):
    """Options: path, and for streams hoursPerBatch (all that is there, if absent)."""

    @classmethod
    def name(cls) -> str:
        return "execution_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> ArchiveStreamReader:
        return ArchiveStreamReader(self.options["path"], schema, int(self.options.get("hoursPerBatch", 1 << 30)))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets Spark hand it filters."""
    spark.dataSource.register(ArchiveDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def executions(spark: SparkSession, path: str) -> DataFrame:
    """The archive at ``path``, columns as in ``SCHEMA``."""
    register(spark)
    return spark.read.format("execution_archive").load(path)


def write_hours(lines: DataFrame, root: str) -> None:
    """``lines`` (day as YYYYMMDD, hour, value) as an archive: the lines of each hour in one object. An hour's lines are one task's."""

    def write(rows: Any) -> None:
        files, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        at, out = None, None
        for r in rows:
            if at != (r["day"], r["hour"]):
                if out is not None:
                    out.close()
                at = (r["day"], r["hour"])
                files.create_dir(f"{base}/{r['day']}", recursive=True)
                out = files.open_output_stream(f"{base}/{r['day']}/{r['hour']}.jsonl", compression=None)
            out.write((r["value"] + "\n").encode("utf-8", "replace"))
        if out is not None:
            out.close()

    lines.repartition("day", "hour").sortWithinPartitions("day", "hour").foreachPartition(write)
