"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
ADDRESS = r"^0x[0-9a-f]{40}$"
STRICT_DECIMAL = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"
LENIENT_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def address(raw: Column) -> Column:
    """Lower-cased and trimmed; null if it is no 20-byte hexadecimal address."""
    low = F.lower(F.trim(raw))
    return F.when(low.rlike(ADDRESS), low)


def strict_decimal(text: Column, precision: int = 38, scale: int = 18) -> Column:
    """A plain decimal string as a number; null for exponents, leading zeros and other text."""
    return F.when(text.rlike(STRICT_DECIMAL), text.try_cast(f"decimal({precision},{scale})"))


def lenient_decimal(text: Column, precision: int = 38, scale: int = 18) -> Column:
    """Signs, exponents and bare points allowed."""
    return F.when(text.rlike(LENIENT_DECIMAL), text.try_cast(f"decimal({precision},{scale})"))


def canonical_decimal(value: Column) -> Column:
    """Decimal text without trailing zeros or a negative zero."""
    text = value.cast("string")
    cut = F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
    return F.when(cut == "-0", "0").otherwise(cut)


def signed_delta(side: Column, size: Column) -> Column:
    return F.when(side == "BUY", size).otherwise(-size)


def utc(ts: Column) -> Column:
    """An instant; zone-less input is read as session time, which is UTC."""
    return ts.cast("timestamp")


def days_between(start: Column, end: Column) -> Column:
    return (F.unix_millis(utc(end)) - F.unix_millis(utc(start))) / F.lit(float(DAY_MS))


def age_hours(at: Column, now: Column) -> Column:
    """Hours from ``at`` to ``now``, negative if it is still to come; null if either is."""
    return (F.unix_millis(utc(now)) - F.unix_millis(utc(at))) / F.lit(3_600_000.0)


def bucket_start(ts: Column, minutes: int = 15) -> Column:
    """The start of the half-open UTC bucket that holds ``ts``, in ts's type. 24 hours are a whole number of buckets."""
    second = F.hour(ts) * 3600 + F.minute(ts) * 60
    return F.date_trunc("day", ts) + F.make_dt_interval(mins=F.floor(second / (60 * minutes)).cast("int") * minutes)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL; a null part counts as empty."""
    return F.sha2(F.concat_ws("\x00", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def semantic(direction: Column, event: Column) -> Column:
    """LONG_OPEN and the like, from a direction and a POSITION_ event; null for other events."""
    kind = F.regexp_replace(event, "^POSITION_", "")
    return F.when(direction.isin("LONG", "SHORT") & kind.isin("OPEN", "INCREASE", "REDUCE", "CLOSE"), F.concat_ws("_", direction, kind))


def cash_flow_category(kind: Column) -> Column:
    k = F.regexp_replace(F.lower(F.trim(kind)), r"[\s_-]", "")
    return (
        F.when(k == "deposit", "deposit").when(k.isin("withdraw", "withdrawal"), "withdrawal").when(k == "bridge", "bridge")
        .when(k.isin("transfer", "send", "accountclasstransfer"), "transfer").when(k.isin("reward", "referralreward"), "reward")
        .when(k == "liquidation", "liquidation").otherwise("unknown")
    )


def cash_flow_external(category: Column, amount: Column, boundary: Column) -> Column:
    """True, false, or null where it cannot be told whether a flow crosses the account's border."""
    nonzero = F.coalesce(amount != 0, F.lit(False))
    return (
        F.when((category == "deposit") & F.coalesce(amount > 0, F.lit(False)), True).when((category == "withdrawal") & nonzero, True)
        .when(category.isin("bridge", "transfer") & (boundary == "INTERNAL"), False).when(category.isin("bridge", "transfer") & (boundary == "EXTERNAL") & nonzero, True)
        .when(category.isin("reward", "liquidation"), False)
    )


def redact(message: Column) -> Column:
    """Credentials in URLs and key=value pairs masked."""
    return F.regexp_replace(F.regexp_replace(message, r"(\w+://)[^/@\s]+@", "$1***@"), r"(?i)(password|token|secret)=\S+", "$1=***")


def compare_decimals(left: Column, right: Column) -> Column:
    """-1, 0 or 1 for two plain decimal texts, without floats; null if either is malformed or null."""
    a, b = (F.when(x.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), x.try_cast("decimal(38,18)")) for x in (left, right))
    return F.when(a.isNull() | b.isNull(), None).when(a < b, -1).when(a > b, 1).otherwise(0)
