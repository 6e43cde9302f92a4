"""Source records as engine rows: funding, ledger, positions, balances, orders, market trades, value history.

Inputs are parsed records (structs or JSON text); amounts stay text until they pass a decimal test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import address, canonical_decimal, fingerprint, lenient_decimal


def _number(text: Column) -> Column:
    return lenient_decimal(text)


def funding_payments(rows: DataFrame) -> DataFrame:
    """``rows``: wallet, time, coin, usdc, szi, rate. The id joins seven canonical parts, so both shapes of the
    same payment get one id."""
    parts = [canonical_decimal(_number(F.col(c))) for c in ("usdc", "szi", "rate")]
    key = F.concat_ws(":", F.lit("funding"), F.lower("wallet"), F.col("time").cast("string"), "coin", *parts)
    return rows.select(F.lower("wallet").alias("wallet"), "coin", key.alias("funding_id"), _number(F.col("usdc")).alias("amount"), _number(F.col("szi")).alias("position_size"), _number(F.col("rate")).alias("rate"), F.timestamp_millis("time").alias("ts"))


def _first_text(payload: Column, names: Sequence[str]) -> Column:
    return F.coalesce(*(F.nullif(F.get_json_object(payload, f"$.{n}"), F.lit("")) for n in names))


def _first_number(payload: Column, names: Sequence[str]) -> Column:
    return F.coalesce(*(_number(F.get_json_object(payload, f"$.{n}")) for n in names))


def ledger_updates(rows: DataFrame) -> DataFrame:
    """``rows``: wallet, hash, time, delta (JSON). Each field is the first of its names that holds a fit value."""
    d = F.col("delta")
    kind = F.get_json_object(d, "$.type")
    return rows.select(
        "wallet", F.concat_ws(":", "hash", F.col("time").cast("string"), kind).alias("flow_id"), kind.alias("kind"), _first_text(d, ["token", "coin"]).alias("asset"),
        _first_number(d, ["amount", "usdc"]).alias("amount"), _first_number(d, ["usdcValue", "netWithdrawnUsd", "accountValue"]).alias("usd_value"), _first_number(d, ["fee", "commission"]).alias("fee"),
        _first_text(d, ["destination", "user", "vault"]).alias("counterparty"), F.timestamp_millis("time").alias("ts"), d.alias("payload"),
    )


def stored_flow_boundary(rows: DataFrame) -> DataFrame:
    """Adds ``boundary`` and ``signed_amount`` to ledger rows: who sent to whom decides direction and border."""
    kind = F.regexp_replace(F.lower("kind"), r"[\s_-]", "")
    user, to, own = (F.lower(F.get_json_object("payload", "$.user")), F.lower(F.get_json_object("payload", "$.destination")), F.lower("wallet"))
    moves = kind.isin("send", "transfer", "bridge")
    out, into, inside = moves & (user == own) & (to != own), moves & (to == own) & (user != own), moves & (user == own) & (to == own)
    moved = kind.isin("withdraw", "withdrawal") | F.coalesce(out, F.lit(False))
    boundary = F.when(kind.isin("deposit", "withdraw", "withdrawal") | out | into, "EXTERNAL").when(inside | ((kind == "accountclasstransfer") & F.get_json_object("payload", "$.toPerp").isin("true", "false")), "INTERNAL").otherwise("UNKNOWN")
    return rows.withColumns({"boundary": boundary, "signed_amount": F.when(moved, -F.abs("amount")).otherwise(F.col("amount"))})


def positions(rows: DataFrame) -> DataFrame:
    """``rows``: wallet, coin, szi, … . Flat positions are left out; the sign gives the side."""
    size = _number(F.col("szi"))
    return rows.withColumn("size", size).filter("size <> 0").withColumn("side", F.when(F.col("size") < 0, "SHORT").otherwise("LONG"))


def spot_balances(rows: DataFrame) -> DataFrame:
    """``rows``: coin, token, total, hold, entry_notional. All-zero rows without a token are left out; others
    without one carry MISSING_TOKEN."""
    zero = (_number(F.col("total")) == 0) & (_number(F.col("hold")) == 0) & (_number(F.col("entry_notional")) == 0)
    return rows.filter(F.col("token").isNotNull() | ~F.coalesce(zero, F.lit(False))).withColumn("error_code", F.when(F.col("token").isNull(), "MISSING_TOKEN"))


def orders(rows: DataFrame) -> DataFrame:
    """``rows``: oid, coin, side B or A, sz, orig_sz, status, status_time; open orders come without a status."""
    return rows.select(F.col("oid").cast("string").alias("order_id"), "coin", F.when(F.col("side") == "B", "BUY").otherwise("SELL").alias("side"), F.coalesce("status", F.lit("open")).alias("status"), _number(F.col("sz")).alias("size"), _number(F.coalesce("orig_sz", "sz")).alias("original_size"), F.timestamp_millis("status_time").alias("ts"))


def market_trades(rows: DataFrame) -> DataFrame:
    """``rows``: time, coin, tid, hash, users (buyer, seller), px, sz, side. The fingerprint is over canonical parts."""
    buyer, seller, px, sz = address(F.col("users")[0]), address(F.col("users")[1]), _number(F.col("px")), _number(F.col("sz"))
    key = F.concat_ws(":", F.col("time").cast("string"), "coin", F.col("tid").cast("string"))
    mark = F.sha2(F.concat_ws("|", key, F.lower("hash"), buyer, seller, canonical_decimal(px), canonical_decimal(sz), "side"), 256)
    return rows.select(key.alias("trade_id"), mark.alias("fingerprint"), "coin", buyer.alias("buyer"), seller.alias("seller"), px.alias("price"), sz.alias("size"), F.abs(px.cast("decimal(20,8)") * sz.cast("decimal(18,6)")).alias("notional"), F.when(F.col("side") == "B", "BUY").otherwise("SELL").alias("side"), F.timestamp_millis("time").alias("ts"))


def value_history(rows: DataFrame, periods: Sequence[str]) -> DataFrame:
    """``rows``: wallet, history, an array of (period, points of (time, value)). The union of the named periods'
    points; several values at one time are CONFLICTING_VALUE."""
    picked = F.explode(F.flatten(F.transform(F.filter("history", lambda h: h["period"].isin(*periods)), lambda h: h["points"])))
    points = rows.select("wallet", picked.alias("p")).groupBy("wallet", F.col("p.time").alias("time")).agg(F.count_distinct("p.value").alias("_n"), F.min("p.value").alias("value"))
    return points.select("wallet", F.timestamp_millis("time").alias("ts"), F.when(F.col("_n") == 1, F.col("value")).alias("nav"), F.when(F.col("_n") > 1, "CONFLICTING_VALUE").alias("error_code"))


def event_fingerprint(kind: str, wallet: Column, identity: Column) -> Column:
    return fingerprint(F.lit(kind), F.lower(wallet), identity)
