"""Exact mode: cycles and returns in decimals of 80 digits, and sums beyond 38 digits.

Cycles and products are folded over stretches of a key's rows, as in ``cycles``, but with ``GUARD`` digits, and composed per key; only the
result is rounded, half to even, to ``PRECISION`` digits. So it is the true value's rounding wherever stretches are cut, and a key's
rows may be in many tasks. Each task reads sorted rows one by one and holds one stretch's sums.

Amounts beyond 38 digits, numeric(50, 18), are summed as two limbs of 25 digits with Spark's own decimals, so partial sums combine before the shuffle.
Results are texts without exponents or trailing zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from decimal import ROUND_HALF_EVEN, Context, Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bucket_start, semantic
from .cycles import KEYS, with_continuity

PRECISION, GUARD = 80, 160
STRETCH = 4096
_ROUND, _WIDE = Context(prec=PRECISION, rounding=ROUND_HALF_EVEN), Context(prec=GUARD, rounding=ROUND_HALF_EVEN)
_ZERO, _ONE = Decimal(0), Decimal(1)


def text(value: Decimal) -> str:
    """``value`` rounded to ``PRECISION`` digits, in plain notation."""
    said = format(_ROUND.plus(value), "f")
    said = said.rstrip("0").rstrip(".") if "." in said else said
    return "0" if said in ("-0", "") else said


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, ...]]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _decimal(value: Any) -> Decimal:
    return value if isinstance(value, Decimal) else Decimal(value)


def _batches(rows: Iterator[tuple[Any, ...]], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple[Any, ...]] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)


def _mapped(df: DataFrame, step: Callable[[Iterator[tuple[Any, ...]]], Iterator[tuple[Any, ...]]], schema: str) -> DataFrame:
    """``df`` with ``step`` over the rows of each partition."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return df.mapInArrow(lambda batches: _batches(step(_rows(batches)), arrow), schema)


# --- cycles ------------------------------------------------------------------------------------------------


@dataclass
class _Leg:
    """What a stretch's legs of one cycle make of the entry price e: ``by`` x e + ``entry``, profit ``gain`` - ``per`` x e; and their sums."""

    side: str
    first_id: Any
    opened_at: Any
    lost: bool
    closed_at: Any = None
    by: Decimal = _ONE
    entry: Decimal = _ZERO
    sums: dict[str, Decimal] = field(default_factory=lambda: dict.fromkeys(("gain", "per", "fee", "pnl", "bought", "sold", "paid"), _ZERO))

    def add(self, name: str, value: Decimal) -> None:
        self.sums[name] = _WIDE.add(self.sums[name], value)

    def open(self, held: Decimal, size: Decimal, price: Decimal) -> None:
        grown = held + size
        self.by = _WIDE.divide(_WIDE.multiply(held, self.by), grown)
        self.entry = _WIDE.divide(_WIDE.add(_WIDE.multiply(held, self.entry), _WIDE.multiply(size, price)), grown)
        self.add("bought", size)

    def close(self, side: str, size: Decimal, price: Decimal) -> None:
        signed = size if side == "SELL" else -size
        self.add("gain", _WIDE.multiply(_WIDE.subtract(price, self.entry), signed))
        self.add("per", _WIDE.multiply(self.by, signed))
        self.add("sold", size)
        self.add("paid", _WIDE.multiply(size, price))


_SUMS = ("by", "entry", "gain", "per", "fee", "pnl", "bought", "sold", "paid")


def _stretches(rows: Iterator[tuple[Any, ...]]) -> Iterator[tuple[Any, ...]]:
    at, legs = None, {}

    def done() -> Iterator[tuple[Any, ...]]:
        for cycle, leg in legs.items():
            yield (*at, cycle, leg.side, leg.first_id, leg.opened_at, leg.closed_at, leg.lost, *(str(x) for x in (leg.by, leg.entry, *leg.sums.values())))

    for wallet, coin, stretch, opened, ts, id_, side, lost, start, delta, size, price, fee, pnl in rows:
        if at != (wallet, coin, stretch):
            yield from done()
            at, legs = (wallet, coin, stretch), {}
        start, delta, size, price, fee, pnl = map(_decimal, (start, delta, size, price, fee, pnl))
        after = start + delta
        flips, closes = start * after < 0, start != 0 and (start > 0) != (delta > 0)
        closed = min(abs(start), size)
        share = _WIDE.divide(_WIDE.multiply(fee, closed), size) if flips else fee
        if closes:
            leg = legs.setdefault(opened - flips, _Leg(side, id_, ts, lost))
            leg.close(side, closed, price)
            leg.add("fee", share)
            leg.add("pnl", pnl)
            if flips or after == 0:
                leg.closed_at = ts
        if flips or not closes:
            leg = legs.setdefault(opened, _Leg(side, id_, ts, lost))
            leg.open(_ZERO if flips else abs(start), size - closed if flips else size, price)
            leg.add("fee", _WIDE.subtract(fee, share) if flips else fee)
    yield from done()


def _composed(rows: Iterator[tuple[Any, ...]]) -> Iterator[tuple[Any, ...]]:
    at, state = None, None

    def done() -> Iterator[tuple[Any, ...]]:
        if state is None:
            return
        first, closed_at, lost, entry, gain, sums = state
        if closed_at is None and lost:
            return  # the open cycle of a key whose position jumped
        exit_ = text(_WIDE.divide(sums["paid"], sums["sold"])) if sums["sold"] else None
        side, id_, opened_at = first
        yield (*at, "LONG" if side == "BUY" else "SHORT", str(id_), opened_at, closed_at, *map(text, (sums["bought"], sums["sold"], entry)), exit_, *map(text, (sums["fee"], sums["pnl"], gain, _WIDE.subtract(sums["pnl"], sums["fee"]))))

    for wallet, coin, cycle, _, side, id_, opened_at, closed_at, lost, *numbers in rows:
        part = dict(zip(_SUMS, map(Decimal, numbers), strict=True))
        if at != (wallet, coin, cycle):
            yield from done()
            at, state = (wallet, coin, cycle), [(side, id_, opened_at), None, False, _ZERO, _ZERO, dict.fromkeys(_SUMS[4:], _ZERO)]
        state[4] = _WIDE.add(state[4], _WIDE.subtract(part["gain"], _WIDE.multiply(part["per"], state[3])))
        state[3] = _WIDE.add(_WIDE.multiply(part["by"], state[3]), part["entry"])
        state[1], state[2] = closed_at or state[1], lost
        for name in _SUMS[4:]:
            state[5][name] = _WIDE.add(state[5][name], part[name])
    yield from done()


def exact_cycles(fills: DataFrame) -> DataFrame:
    """The cycles of ``cycles.cycles`` in exact mode: wallet, coin, cycle, side, opening_id, opened_at, closed_at, and as texts entry_quantity,
    exit_quantity, entry_price, exit_price (null without an exit), fee, official_pnl, recomputed_pnl and net_pnl (official less fee).
    Sizes, prices, positions and money of ``fills`` are decimals or integers; wallets with ``cycles.input_errors`` must be taken out before.
    """
    kinds = {c: t for c, t in fills.dtypes}
    rows = with_continuity(fills).filter("kept").select(*KEYS, "_stretch", "_opened", "ts", "id", "side", "_discontinued", "start_position", "delta", "size", "price", "fee", "closed_pnl")
    rows = rows.repartition(*KEYS, "_stretch").sortWithinPartitions(*KEYS, "_stretch", "ts", "id")
    key, at = f"wallet {kinds['wallet']}, coin {kinds['coin']}", kinds["ts"]
    parts = _mapped(rows, _stretches, f"{key}, _stretch long, cycle long, side string, id {kinds['id']}, opened_at {at}, closed_at {at}, lost boolean, " + ", ".join(f"{c} string" for c in _SUMS))
    parts = parts.select(*KEYS, "cycle", "_stretch", "side", "id", "opened_at", "closed_at", "lost", *_SUMS).repartition(*KEYS, "cycle").sortWithinPartitions(*KEYS, "cycle", "_stretch")
    texts = ("entry_quantity", "exit_quantity", "entry_price", "exit_price", "fee", "official_pnl", "recomputed_pnl", "net_pnl")
    return _mapped(parts, _composed, f"{key}, cycle long, side string, opening_id string, opened_at {at}, closed_at {at}, " + ", ".join(f"{c} string" for c in texts))


# --- products ----------------------------------------------------------------------------------------------


def exact_wealth(periods: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys``, seq, wealth, total_return: the running product of to_nav / from_nav by ``seq`` (from 1 on, without holes) and that less 1, as
    texts. ``periods``: keys, seq, from_nav, to_nav, decimals or integers; a key with a value that is not positive is NON_POSITIVE_NAV in
    ``error_code``, without numbers.

    Products of stretches are made first, then those before each stretch, then the rows': a key's rows need not meet in one task.
    """
    keys, width = list(keys), len(keys)
    kinds = {c: t for c, t in periods.dtypes}
    key = ", ".join(f"{k} {kinds[k]}" for k in keys)
    bad = periods.groupBy(*keys).agg(F.min(F.least("from_nav", "to_nav") <= 0).alias("_some"), F.max(F.coalesce(F.least("from_nav", "to_nav") <= 0, F.lit(True))).alias("_bad")).filter("_bad").drop("_some", "_bad")
    rows = periods.join(bad, keys, "left_anti").select(*keys, F.floor((F.col("seq") - 1) / STRETCH).alias("_stretch"), F.col("seq").cast("long").alias("seq"), "from_nav", "to_nav")
    rows = rows.repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_stretch", "seq")

    def factor(before: Any, after: Any) -> Decimal:
        return _WIDE.divide(_decimal(after), _decimal(before))

    def products(it: Iterator[tuple[Any, ...]]) -> Iterator[tuple[Any, ...]]:
        at, product = None, _ONE
        for r in it:
            if at != r[: width + 1]:
                if at is not None:
                    yield (*at, str(product))
                at, product = r[: width + 1], _ONE
            product = _WIDE.multiply(product, factor(*r[-2:]))
        if at is not None:
            yield (*at, str(product))

    def before(it: Iterator[tuple[Any, ...]]) -> Iterator[tuple[Any, ...]]:
        at, product = None, _ONE
        for r in it:
            if at != r[:width]:
                at, product = r[:width], _ONE
            yield (*r[: width + 1], str(product))
            product = _WIDE.multiply(product, Decimal(r[-1]))

    def running(it: Iterator[tuple[Any, ...]]) -> Iterator[tuple[Any, ...]]:
        at, product = None, _ONE
        for r in it:
            if at != r[: width + 1]:
                at, product = r[: width + 1], Decimal(r[-1])
            product = _WIDE.multiply(product, factor(r[-3], r[-2]))
            yield (*r[:width], r[width + 1], text(product), text(_WIDE.subtract(product, _ONE)))

    parts = _mapped(rows, products, f"{key}, _stretch long, product string").repartition(*keys).sortWithinPartitions(*keys, "_stretch")
    starts = _mapped(parts, before, f"{key}, _stretch long, _start string")
    whole = rows.join(starts, [*keys, "_stretch"]).select(*keys, "_stretch", "seq", "from_nav", "to_nav", "_start").repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_stretch", "seq")
    out = _mapped(whole, running, f"{key}, seq long, wealth string, total_return string")
    return out.withColumn("error_code", F.lit(None).cast("string")).unionByName(bad.withColumn("error_code", F.lit("NON_POSITIVE_NAV")), allowMissingColumns=True)


def exact_return(periods: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys``, n_periods, total_return, error_code: the last row of ``exact_wealth`` of each key."""
    rows = exact_wealth(periods, keys)
    return rows.groupBy(*keys).agg(F.count("seq").alias("n_periods"), F.max_by("total_return", "seq").alias("total_return"), F.max("error_code").alias("error_code"))


# --- sums of two limbs -------------------------------------------------------------------------------------

_LIMB, _PLACES, _DIGITS = 25, 18, 50
#: Fixed value: amounts that events may have, plain, not negative, below 10^32, of at most 18 places.
WIDE_AMOUNT = r"^(0|[1-9][0-9]{0,31})(\.[0-9]{1,18})?$"


def limbs(amount: Column) -> Column:
    """The two 25-digit halves of a plain text amount times 10^18; null if it is no such amount."""
    whole, part = F.substring_index(amount, ".", 1), F.when(amount.contains("."), F.substring_index(amount, ".", -1)).otherwise("")
    digits = F.lpad(F.concat(whole, F.rpad(part, _PLACES, "0")), _DIGITS, "0")
    halves = F.struct(F.substring(digits, 1, _LIMB).cast("decimal(25,0)").alias("hi"), F.substring(digits, _LIMB + 1, _LIMB).cast("decimal(25,0)").alias("lo"))
    return F.when(amount.rlike(WIDE_AMOUNT), halves)


def wide_sum(limb: Column) -> Column:
    """Aggregate: the sum of ``limbs`` as text; of up to 10^10 rows, null if there is none. Sums of both halves combine before the shuffle."""
    hi, lo = F.sum(limb["hi"]).cast("decimal(36,0)"), F.sum(limb["lo"]).cast("decimal(36,0)")
    base = F.lit("1" + "0" * _LIMB).cast("decimal(26,0)")
    carry = F.floor(lo / base).cast("decimal(12,0)")
    digits = F.concat((hi + carry).cast("decimal(37,0)").cast("string"), F.lpad((lo - carry * base).cast("decimal(26,0)").cast("string"), _LIMB, "0"))
    whole = F.regexp_replace(F.substring(digits, F.lit(1), F.length(digits) - _PLACES), "^0+(?=.)", "")
    return F.regexp_replace(F.concat(whole, F.lit("."), F.right(digits, F.lit(_PLACES))), r"\.?0+$", "")


def exact_cells(events: DataFrame, members: DataFrame, *, minutes: int = 15) -> DataFrame:
    """Per cohort, coin, bucket and cell (TOTAL or a semantic): n_events, the sorted wallets and their number, and the exact notional.

    ``events``: coin, ts, wallet, direction, event_type, notional as text; ``members``: cohort, wallet, at most 200 of a cohort, so lists
    of wallets stay short however many events a bucket has. An amount that is no plain decimal below 10^32 makes its cells' notional null and counts
    in n_invalid.
    """
    rows = events.join(members.select("cohort", "wallet"), "wallet").withColumns({"bucket": bucket_start(F.col("ts"), minutes), "cell": semantic(F.col("direction"), F.col("event_type")), "_l": limbs(F.col("notional"))})
    sets = rows.groupingSets([["cohort", "coin", "bucket", "cell"], ["cohort", "coin", "bucket"]], "cohort", "coin", "bucket", "cell")
    out = sets.agg(F.grouping("cell").alias("_total"), F.count(F.lit(1)).alias("n_events"), F.sort_array(F.collect_set("wallet")).alias("wallets"), wide_sum(F.col("_l")).alias("_sum"), F.count_if(F.col("_l").isNull()).alias("n_invalid"))
    return out.select("cohort", "coin", "bucket", F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col("cell")).alias("cell"), "n_events", F.size("wallets").alias("n_wallets"), "wallets", F.when(F.col("n_invalid") == 0, F.col("_sum")).alias("notional"), "n_invalid")
