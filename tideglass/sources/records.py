"""The sources' records: one schema per kind, and a reader that keeps lines which do not fit, with what is wrong."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import LENIENT_DECIMAL

# The fields of each kind of record. Amounts are text, as they are exact; times are milliseconds.
_FILL = "closedPnl STRING, coin STRING, crossed BOOLEAN, dir STRING, fee STRING, feeToken STRING, hash STRING, oid STRING, px STRING, side STRING, startPosition STRING, sz STRING, tid STRING, time BIGINT, builderFee STRING, liquidation STRUCT<liquidatedUser: STRING, markPx: STRING, method: STRING>"
_MARGIN = "STRUCT<accountValue: STRING, totalMarginUsed: STRING, totalNtlPos: STRING, totalRawUsd: STRING>"
_POSITION = "coin STRING, entryPx STRING, leverage STRUCT<type: STRING, value: STRING, rawUsd: STRING>, liquidationPx STRING, marginUsed STRING, maxLeverage STRING, positionValue STRING, returnOnEquity STRING, szi STRING, unrealizedPnl STRING"
_ORDER = "cloid STRING, coin STRING, limitPx STRING, oid STRING, orderType STRING, origSz STRING, reduceOnly BOOLEAN, side STRING, sz STRING, timestamp BIGINT"
_BALANCE = "coin STRING, entryNtl STRING, hold STRING, token STRING, total STRING"
_LEDGER = "delta STRUCT<type: STRING, token: STRING, coin: STRING, amount: STRING, usdc: STRING, usdcValue: STRING, netWithdrawnUsd: STRING, accountValue: STRING, fee: STRING, commission: STRING, destination: STRING, user: STRING, vault: STRING, toPerp: STRING>, hash STRING, time BIGINT"
_FUNDING = "coin STRING, fundingRate STRING, szi STRING, time BIGINT, usdc STRING"


def _struct(fields: str) -> str:
    """The fields as those of a struct, whose names have colons; structs among them have theirs already."""
    return f"STRUCT<{re.sub(r'(\w+) (?=STRING|BIGINT|BOOLEAN|STRUCT|ARRAY)', r'\1: ', fields)}>"


SCHEMAS: dict[str, str] = {
    "fill": _FILL,
    "margin_summary": "accountValue STRING, totalMarginUsed STRING, totalNtlPos STRING, totalRawUsd STRING",
    "position": _POSITION,
    "clearinghouse_state": f"assetPositions ARRAY<STRUCT<position: {_struct(_POSITION)}, type: STRING>>, crossMaintenanceMarginUsed STRING, crossMarginSummary {_MARGIN}, marginSummary {_MARGIN}, time BIGINT, withdrawable STRING",
    "spot_balance": _BALANCE,
    "spot_state": f"balances ARRAY<{_struct(_BALANCE)}>",
    "portfolio_period": "period STRING, accountValueHistory ARRAY<ARRAY<STRING>>, pnlHistory ARRAY<ARRAY<STRING>>, vlm STRING",
    "funding_payment": "delta STRUCT<coin: STRING, fundingRate: STRING, szi: STRING, type: STRING, usdc: STRING>, hash STRING, time BIGINT",
    "stream_funding": _FUNDING,
    "ledger_update": _LEDGER,
    "order": _ORDER,
    "historical_order": f"order {_struct(_ORDER)}, status STRING, statusTimestamp BIGINT",
    "rate_limit": "cumVlm STRING, nRequestsCap STRING, nRequestsSurplus STRING, nRequestsUsed STRING",
    "market_meta": "universe ARRAY<STRUCT<isDelisted: BOOLEAN, maxLeverage: STRING, name: STRING, onlyIsolated: BOOLEAN, szDecimals: STRING>>",
    "market_trade": "coin STRING, hash STRING, px STRING, side STRING, sz STRING, tid STRING, time BIGINT, users ARRAY<STRING>",
    "envelope": "channel STRING, data STRING",
    "stream_fills": f"fills ARRAY<{_struct(_FILL)}>, isSnapshot BOOLEAN, user STRING",
    "stream_fundings": f"fundings ARRAY<{_struct(_FUNDING)}>, isSnapshot BOOLEAN, user STRING",
    "stream_ledger": f"isSnapshot BOOLEAN, nonFundingLedgerUpdates ARRAY<{_struct(_LEDGER)}>, user STRING",
    "stream_orders": f"orders ARRAY<{_struct(_ORDER)}>, user STRING",
}
# Fields that must be there, those that must be decimals, and those with few values.
REQUIRED: dict[str, tuple[str, ...]] = {
    "fill": ("closedPnl", "coin", "crossed", "dir", "fee", "feeToken", "hash", "oid", "px", "side", "startPosition", "sz", "tid", "time"),
    "margin_summary": ("accountValue", "totalMarginUsed", "totalNtlPos", "totalRawUsd"),
    "position": ("coin", "leverage.type", "leverage.value", "marginUsed", "maxLeverage", "positionValue", "returnOnEquity", "szi", "unrealizedPnl"),
    "clearinghouse_state": ("assetPositions", "crossMaintenanceMarginUsed", "crossMarginSummary", "marginSummary", "withdrawable"),
    "spot_balance": ("coin", "entryNtl", "hold", "total"),
    "spot_state": ("balances",),
    "portfolio_period": ("period", "accountValueHistory", "pnlHistory", "vlm"),
    "funding_payment": ("delta.coin", "delta.fundingRate", "delta.szi", "delta.type", "delta.usdc", "hash", "time"),
    "stream_funding": ("coin", "fundingRate", "szi", "time", "usdc"),
    "ledger_update": ("delta.type", "hash", "time"),
    "order": ("coin", "limitPx", "oid", "side", "sz", "timestamp"),
    "historical_order": ("order.coin", "order.oid", "status", "statusTimestamp"),
    "rate_limit": ("cumVlm", "nRequestsCap", "nRequestsSurplus", "nRequestsUsed"),
    "market_meta": ("universe",),
    "market_trade": ("coin", "hash", "px", "side", "sz", "tid", "time", "users"),
    "envelope": ("channel",),
    "stream_fills": ("fills", "user"),
    "stream_fundings": ("fundings", "user"),
    "stream_ledger": ("nonFundingLedgerUpdates", "user"),
    "stream_orders": ("orders",),
}
DECIMALS: dict[str, tuple[str, ...]] = {
    "fill": ("closedPnl", "fee", "px", "startPosition", "sz", "builderFee"),
    "margin_summary": REQUIRED["margin_summary"],
    "position": ("entryPx", "liquidationPx", "leverage.value", "marginUsed", "maxLeverage", "positionValue", "returnOnEquity", "szi", "unrealizedPnl"),
    "clearinghouse_state": ("crossMaintenanceMarginUsed", "withdrawable"),
    "spot_balance": ("entryNtl", "hold", "total"),
    "portfolio_period": ("vlm",),
    "funding_payment": ("delta.fundingRate", "delta.szi", "delta.usdc"),
    "stream_funding": ("fundingRate", "szi", "usdc"),
    "order": ("limitPx", "sz", "origSz"),
    "rate_limit": ("cumVlm",),
    "market_trade": ("px", "sz"),
}
ALLOWED: dict[str, dict[str, tuple[str, ...]]] = {"fill": {"side": ("A", "B")}, "order": {"side": ("A", "B")}, "market_trade": {"side": ("A", "B")}, "funding_payment": {"delta.type": ("funding",)}}
# Fields that are whole numbers from 0 to 2^63 - 1, and times in milliseconds within what a date can be.
IDS: dict[str, tuple[str, ...]] = {"fill": ("oid", "tid"), "order": ("oid",), "historical_order": ("order.oid",), "market_trade": ("tid",), "rate_limit": ("nRequestsCap", "nRequestsUsed")}
TIMES: dict[str, tuple[str, ...]] = {"fill": ("time",), "clearinghouse_state": ("time",), "funding_payment": ("time",), "stream_funding": ("time",), "ledger_update": ("time",), "order": ("timestamp",), "historical_order": ("statusTimestamp", "order.timestamp"), "market_trade": ("time",)}
LATEST_MS = 8_640_000_000_000_000
# Lists of a record whose members are records: the list, the members' kind, and where in a member that record is.
MEMBERS: dict[str, tuple[tuple[str, str, str | None], ...]] = {
    "clearinghouse_state": (("assetPositions", "position", "position"),), "spot_state": (("balances", "spot_balance", None),), "stream_fills": (("fills", "fill", None),),
    "stream_fundings": (("fundings", "stream_funding", None),), "stream_ledger": (("nonFundingLedgerUpdates", "ledger_update", None),), "stream_orders": (("orders", "order", None),),
}


def _field(row: Column, path: str) -> Column:
    return reduce(lambda at, name: at.getField(name), path.split("."), row)


def _rules(row: Column, kind: str) -> list[tuple[Column, str]]:
    """What can be wrong with the fields of a record of a kind, in order."""
    whole = r"^(0|[1-9][0-9]*)$"
    rules = [(_field(row, f).isNull() | (_field(row, f).cast("string") == ""), f"MISSING:{f}") for f in REQUIRED[kind]]
    rules += [(~_field(row, f).rlike(LENIENT_DECIMAL), f"BAD_DECIMAL:{f}") for f in DECIMALS.get(kind, ())]
    rules += [(~_field(row, f).rlike(whole) | _field(row, f).try_cast("long").isNull() & _field(row, f).isNotNull(), f"BAD_ID:{f}") for f in IDS.get(kind, ())]
    rules += [(~_field(row, f).between(0, LATEST_MS), f"BAD_TIME:{f}") for f in TIMES.get(kind, ())]
    return rules + [(~_field(row, f).isin(*values), f"BAD_VALUE:{f}") for f, values in ALLOWED.get(kind, {}).items()]


def _first(*rules: tuple[Column, str]) -> Column:
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for bad, code in rules))


def _unsound(kind: str, inside: str | None) -> Callable[[Column], Column]:
    """Whether a member of a list is no sound record of the kind."""
    return lambda m: m.isNull() | _first(*_rules(m.getField(inside) if inside else m, kind)).isNotNull()


def parse(lines: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """All columns of ``lines``, ``row`` of the record's fields, and ``error_code``: null, CORRUPT, MISSING:field, BAD_DECIMAL:field, BAD_ID:field,
    BAD_TIME:field, BAD_VALUE:field or BAD_MEMBER:list (a member lacks a field or has a bad one), the first that holds. Fields that the
    schema does not know are let pass."""
    fields = SCHEMAS[kind]
    top = [f.split(" ", 1)[0] for f in _top(fields)]
    out = lines.withColumn("row", F.from_json(column, f"{fields}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"}))
    row = F.col("row")
    rules = [(row.isNull() | F.col("row._corrupt").isNotNull() | reduce(lambda a, b: a & b, [F.col(f"row.{f}").isNull() for f in top]), "CORRUPT"), *_rules(row, kind)]
    for name, member, inside in MEMBERS.get(kind, ()):
        rules.append((F.exists(row.getField(name), _unsound(member, inside)), f"BAD_MEMBER:{name}"))
    return out.withColumn("error_code", _first(*rules)).withColumn("row", F.struct(*(F.col(f"row.{f}").alias(f) for f in top)))


def _top(fields: str) -> list[str]:
    """The fields at the outermost level."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(fields):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(fields[start:i].strip())
            start = i + 1
    return [*out, fields[start:].strip()]
