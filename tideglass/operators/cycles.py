"""Position cycles from executions, for all wallets and coins at once.

Each execution carries its start position, so cycles are cut by running sums. Keys are (wallet, coin), and a key may
hold most of all rows: rows are dealt by (wallet, coin, day) instead. Windows run within a day; what a day needs
of those before it (has the history been flat, where did it end, did it jump, how many cycles have begun) comes
from one row per key and day. The average entry price is a recurrence (closing leaves it as it was), but a linear one: the
legs of a cycle that fall on ``FOLDED`` executions of a key in a row are folded to a map of the price they begin with, and a
cycle's maps are then composed. No array is longer than that, or than a cycle has such stretches. Executions without a time come first in their key; those without a wallet
or coin take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relational import by_day

KEYS = ("wallet", "coin")
#: Executions of a key whose legs are folded together.
FOLDED = 4096
_BLOCK = (*KEYS, "_day")


def _order(upto_current: bool = False):
    w = Window.partitionBy(*_BLOCK).orderBy("ts", "id")
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow) if upto_current else w


def _earlier():
    """The days of a key before the present one."""
    return Window.partitionBy(*KEYS).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)


def duplicate_ids(fills: DataFrame) -> DataFrame:
    """Ids that occur more than once; such input is an error."""
    return fills.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def input_errors(fills: DataFrame, *, free: bool = False) -> DataFrame:
    """wallet, error_code: wallets whose executions cannot be used, DUPLICATE_EVENT if an id occurs twice, else INVALID_INPUT if a price or
    a size is not positive or a start position is null; ``free`` allows prices of zero. The operators below do not fail on such rows, but what they make of them means nothing."""
    priced = F.col("price") >= 0 if free else F.col("price") > 0
    positive = F.coalesce(priced & (F.col("size") > 0) & F.col("start_position").isNotNull(), F.lit(False))
    ids = fills.groupBy("wallet", "id").agg(F.count(F.lit(1)).alias("_n"), F.max(~positive).alias("_bad"))
    found = ids.groupBy("wallet").agg((F.max("_n") > 1).alias("_twice"), F.max("_bad").alias("_bad")).filter("_twice OR _bad")
    return found.select("wallet", F.when(F.col("_twice"), "DUPLICATE_EVENT").otherwise("INVALID_INPUT").alias("error_code"))


def _dated(fills: DataFrame) -> DataFrame:
    """Adds ``_day``, ``after``, and ``_flat`` and ``_end``: was the key flat before this day, where did its last day end."""
    rows = fills.withColumns({"_day": F.coalesce(F.col("ts").cast("date"), F.to_date(F.lit("0001-01-01"))), "after": F.col("start_position") + F.col("delta")})
    days = rows.groupBy(*_BLOCK).agg(F.max(F.col("start_position") == 0).alias("_f"), F.max_by("after", F.struct("ts", "id")).alias("_a"))
    days = days.select(*_BLOCK, F.coalesce(F.max("_f").over(_earlier()), F.lit(False)).alias("_flat"), F.last("_a").over(_earlier()).alias("_end"))
    return rows.join(days, list(_BLOCK))


def with_trust(fills: DataFrame) -> DataFrame:
    """Adds ``trusted``: from the first execution that starts flat. What precedes it has no known beginning."""
    rows = _dated(fills)
    return rows.withColumn("trusted", F.col("_flat") | F.max(F.col("start_position") == 0).over(_order(True))).select(*fills.columns, "trusted")


def prefix_report(fills: DataFrame) -> DataFrame:
    """Per key: executions skipped before the first flat start, when they begin and when trust begins."""
    return with_trust(fills).groupBy(*KEYS).agg(
        F.count_if(~F.col("trusted")).alias("n_skipped"), F.count_if("trusted").alias("n_trusted"),
        F.min("ts").alias("first_at"), F.min(F.when(F.col("trusted"), F.col("ts"))).alias("trusted_from"),
    )


def with_continuity(fills: DataFrame) -> DataFrame:
    """Trusted rows with ``after``, ``broken`` (here the position jumped), ``kept`` (no jump so far), ``_discontinued`` (the key
    jumps somewhere), ``_stretch`` (its number in the key by ``FOLDED``) and ``_opened`` (cycles begun up to here)."""
    start = F.col("start_position")
    flat = F.coalesce(F.max(start == 0).over(_order(True).rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = _dated(fills).withColumn("_before", F.col("_flat") | flat).filter(F.col("_before") | (start == 0))
    rows = rows.withColumn("broken", F.col("_before") & (start != F.coalesce(F.lag("after").over(_order()), F.col("_end"))))
    rows = rows.withColumn("_jumped", F.max("broken").over(_order(True)))
    opens = (~F.col("_jumped") & ((start == 0) | (F.signum("start_position") * F.signum("after") < 0))).cast("int")
    rows = rows.withColumn("_open", opens)
    days = rows.groupBy(*_BLOCK).agg(F.max("broken").alias("_b"), F.sum("_open").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    days = days.select(*_BLOCK, F.coalesce(F.sum("_rows").over(_earlier()), F.lit(0)).alias("_past"), F.coalesce(F.max("_b").over(_earlier()), F.lit(False)).alias("_lost"), F.coalesce(F.sum("_n").over(_earlier()), F.lit(0)).alias("_begun"), F.max("_b").over(Window.partitionBy(*KEYS)).alias("_discontinued"))
    rows = rows.join(days, list(_BLOCK)).withColumn("_opened", F.col("_begun") + F.sum("_open").over(_order(True)))
    stretch = F.floor((F.col("_past") + F.row_number().over(_order()) - 1) / FOLDED)
    return rows.select(*fills.columns, "after", "broken", (~F.col("_lost") & ~F.col("_jumped")).alias("kept"), "_discontinued", stretch.alias("_stretch"), "_opened")


def legs(fills: DataFrame) -> DataFrame:
    """One row per open or close leg: cycle number, role, size, fee and official profit.

    An execution that flips the position closes one cycle and opens the next: the close leg has the whole
    official profit and its share of the fee. An opening leg's official profit does not count.
    """
    rows = with_continuity(fills).filter("kept")
    start, after, size = F.col("start_position"), F.col("after"), F.col("size")
    opens, flips = start == 0, F.signum("start_position") * F.signum("after") < 0
    closing = (start != 0) & (F.signum("start_position") != F.signum("delta"))
    closed = F.least(F.abs(start), size)
    close = F.struct(F.lit("CLOSE").alias("role"), (F.col("_opened") - flips.cast("int")).alias("cycle"), closed.alias("size"), F.abs(start).alias("_held"), F.try_divide(F.col("fee") * closed, size).alias("fee"), F.col("closed_pnl").alias("closed_pnl"))
    rest = F.when(flips, size - closed).otherwise(size)
    open_ = F.struct(F.lit("OPEN").alias("role"), F.col("_opened").alias("cycle"), rest.alias("size"), F.when(flips, F.abs(start) * 0).otherwise(F.abs(start)).alias("_held"), F.when(flips, F.col("fee") - F.try_divide(F.col("fee") * closed, size)).otherwise(F.col("fee")).alias("fee"), (F.col("closed_pnl") * 0).alias("closed_pnl"))
    parts = F.when(flips, F.array(close, open_)).when(closing, F.array(close)).otherwise(F.array(open_))
    out = rows.select(*KEYS, "id", "ts", "side", "price", "after", "_discontinued", "_stretch", (opens & (F.col("closed_pnl") != 0)).alias("unexpected_pnl"), F.posexplode(parts).alias("leg", "_p"))
    return out.select(*KEYS, "id", "ts", "side", "price", "leg", "_p.*", F.when((F.col("_p.role") == "CLOSE") & (F.col("after") == 0) | (F.col("_p.role") == "CLOSE") & (F.signum("after") != F.when(F.col("side") == "SELL", 1).otherwise(-1)), F.lit(True)).otherwise(F.lit(False)).alias("ends"), "unexpected_pnl", "_discontinued", "_stretch")


def _folded(sorted_legs: Column) -> Column:
    """What the legs of one stretch make of the average entry price e that they begin with: the price ``by`` x e + ``entry`` and
    the recomputed profit ``gain`` - ``per`` x e."""

    def step(acc: Column, leg: Column) -> Column:
        is_open, held = leg["role"] == "OPEN", leg["held"].cast("double")
        size, price = leg["size"].cast("double"), leg["price"].cast("double")
        grown = held + size
        sign = F.when(leg["side"] == "SELL", 1.0).otherwise(-1.0)
        return F.struct(
            F.when(is_open, F.try_divide(held, grown) * acc["by"]).otherwise(acc["by"]).alias("by"),
            F.when(is_open, F.try_divide(held * acc["entry"] + size * price, grown)).otherwise(acc["entry"]).alias("entry"),
            F.when(is_open, acc["gain"]).otherwise(acc["gain"] + sign * (price - acc["entry"]) * size).alias("gain"),
            F.when(is_open, acc["per"]).otherwise(acc["per"] + sign * acc["by"] * size).alias("per"),
        )

    one = F.struct(F.lit(1.0).alias("by"), F.lit(0.0).alias("entry"), F.lit(0.0).alias("gain"), F.lit(0.0).alias("per"))
    return F.aggregate(sorted_legs, one, step)


def _composed(parts: Column) -> Column:
    """The entry price and recomputed profit of a cycle from its stretches' folds in order."""
    zero = F.struct(F.lit(0.0).alias("entry"), F.lit(0.0).alias("gain"))
    return F.aggregate(parts, zero, lambda acc, d: F.struct((d["f"]["by"] * acc["entry"] + d["f"]["entry"]).alias("entry"), (acc["gain"] + d["f"]["gain"] - d["f"]["per"] * acc["entry"]).alias("gain")))


def cycles(fills: DataFrame) -> DataFrame:
    """One row per cycle. The open cycle of a key whose position jumped is left out, its closed cycles stay."""
    item = F.struct("ts", "id", "leg", "role", "side", "size", "price", F.col("_held").alias("held"))
    at, closing = F.struct("ts", "id", "leg"), F.col("role") == "CLOSE"
    parts = legs(fills).groupBy(*KEYS, "cycle", "_stretch").agg(
        F.array_sort(F.collect_list(item)).alias("_legs"), F.min("ts").alias("opened_at"), F.max(F.when(F.col("ends"), F.col("ts"))).alias("closed_at"),
        F.min(at).alias("_at"), F.min_by("side", at).alias("_side"), F.min_by("id", at).alias("_id"), F.count_distinct("id").alias("n_fills"), F.sum("fee").alias("fee"), F.sum("closed_pnl").alias("official_pnl"),
        F.sum(F.when(~closing, F.col("size"))).alias("_in"), F.sum(F.when(closing, F.col("size"))).alias("_out"), F.sum(F.when(closing, F.col("size") * F.col("price"))).alias("_paid"),
        F.max("unexpected_pnl").alias("unexpected_opening_pnl"), F.max("_discontinued").alias("_discontinued"),
    ).withColumn("_f", _folded(F.col("_legs"))).drop("_legs")
    rows = parts.groupBy(*KEYS, "cycle").agg(
        F.array_sort(F.collect_list(F.struct("_stretch", F.col("_f").alias("f")))).alias("_parts"), F.min("opened_at").alias("opened_at"), F.max("closed_at").alias("closed_at"),
        F.min_by("_side", "_at").alias("_first_side"), F.min_by("_id", "_at").alias("opening_id"), F.sum("n_fills").alias("n_fills"), F.sum("fee").alias("fee"), F.sum("official_pnl").alias("official_pnl"),
        F.sum("_in").alias("entry_quantity"), F.coalesce(F.sum("_out"), F.lit(0)).alias("exit_quantity"), F.try_divide(F.sum("_paid"), F.sum("_out")).alias("exit_price"),
        F.max("unexpected_opening_pnl").alias("unexpected_opening_pnl"), F.max("_discontinued").alias("_discontinued"),
    )
    rows = rows.withColumn("_f", _composed(F.col("_parts"))).filter(F.col("closed_at").isNotNull() | ~F.col("_discontinued"))
    return rows.select(
        *KEYS, "cycle", F.concat_ws(":", "coin", F.col("cycle").cast("string"), F.col("opening_id").cast("string")).alias("cycle_id"),
        F.when(F.col("_first_side") == "BUY", "LONG").otherwise("SHORT").alias("side"), F.when(F.col("closed_at").isNull(), "OPEN").otherwise("CLOSED").alias("state"),
        "opened_at", "closed_at", "n_fills", "entry_quantity", "exit_quantity", F.col("_f.entry").alias("entry_price"), "exit_price", "fee", "official_pnl",
        F.col("_f.gain").alias("recomputed_pnl"), "unexpected_opening_pnl",
    )


def profit(cycles: DataFrame, funding: DataFrame | None = None) -> DataFrame:
    """Adds funding, net profit (official - fee + funding) and whether official and recomputed profit differ."""
    if funding is None:
        out = cycles.withColumn("funding", F.lit(0.0))
    else:
        sums = funding.filter("allocation = 'ALLOCATED'").groupBy(*KEYS, "cycle").agg(F.sum("amount").alias("funding"))
        out = cycles.join(sums, [*KEYS, "cycle"], "left").withColumn("funding", F.coalesce("funding", F.lit(0.0)))
    net = F.col("official_pnl") - F.col("fee") + F.col("funding")
    return out.withColumns({"net_pnl": net, "closed_pnl_mismatch": F.abs(F.col("official_pnl") - F.col("recomputed_pnl")) > 1e-9})


def allocate_funding(funding: DataFrame, cycles: DataFrame) -> DataFrame:
    """Each payment (wallet, coin, funding_id, ts, amount) with the one cycle it falls strictly inside.

    A payment at the very instant at which a cycle opens or closes is CYCLE_BOUNDARY_AMBIGUOUS, one in no
    cycle NO_TRUSTED_CYCLE, one in several MULTIPLE_CYCLE_CANDIDATES. Instead of a range join the payments and
    the cycles' ends are put into one order per key and day, with the sums of the days before: a running count of cycles begun less those ended tells how many are
    open, and the running sum of their numbers, taken likewise, which one it is if there is one.
    """
    opened = cycles.select(*KEYS, F.col("opened_at").alias("ts"), F.col("cycle").cast("long").alias("_c"), F.lit(1).alias("_edge"))
    closed = cycles.filter("closed_at is not null").select(*KEYS, F.col("closed_at").alias("ts"), (-F.col("cycle").cast("long")).alias("_c"), F.lit(-1).alias("_edge"))
    both = funding.withColumns({"_edge": F.lit(0), "_c": F.lit(0).cast("long")}).unionByName(opened, allowMissingColumns=True).unionByName(closed, allowMissingColumns=True)
    both = by_day(both, KEYS, "ts", "_day", {"_e": F.sum("_edge"), "_s": F.sum("_c")}, {"_open_before": F.coalesce(F.sum("_e").over(_earlier()), F.lit(0)), "_which_before": F.coalesce(F.sum("_s").over(_earlier()), F.lit(0))})
    day = Window.partitionBy(*_BLOCK).orderBy("ts")
    before = day.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_boundary", F.max(F.abs("_edge")).over(day.rangeBetween(Window.currentRow, Window.currentRow)) == 1)
    both = both.withColumns({"_open": F.col("_open_before") + F.sum("_edge").over(before), "_which": F.col("_which_before") + F.sum("_c").over(before)}).filter("_edge = 0")
    state = F.when(F.col("_boundary"), "CYCLE_BOUNDARY_AMBIGUOUS").when(F.col("_open") == 1, "ALLOCATED").when(F.col("_open") > 1, "MULTIPLE_CYCLE_CANDIDATES").otherwise("NO_TRUSTED_CYCLE")
    return both.withColumn("allocation", state).withColumn("cycle", F.when(F.col("allocation") == "ALLOCATED", F.col("_which"))).drop("_edge", "_c", "_boundary", "_open", "_which", "_day", "_open_before", "_which_before")


def transitions(fills: DataFrame) -> DataFrame:
    """Behaviour events: POSITION_OPEN, _INCREASE, _REDUCE or _CLOSE with direction and size; a flip is two."""
    start, after = F.col("start_position"), F.col("start_position") + F.col("delta")
    rows = fills.withColumn("_after", after)

    def event(kind: str, direction: Column, before: Column, to: Column) -> Column:
        return F.struct(F.lit(f"POSITION_{kind}").alias("event_type"), direction.alias("direction"), before.alias("position_before"), to.alias("position_after"), F.abs(to - before).alias("quantity"))

    def way(p: Column) -> Column:
        return F.when(p > 0, "LONG").otherwise("SHORT")

    zero = start * 0
    flips = F.signum("start_position") * F.signum("_after") < 0
    one = (
        F.when(start == 0, event("OPEN", way(F.col("_after")), start, F.col("_after"))).when(F.col("_after") == 0, event("CLOSE", way(start), start, zero))
        .when(F.abs("_after") > F.abs(start), event("INCREASE", way(start), start, F.col("_after"))).otherwise(event("REDUCE", way(start), start, F.col("_after")))
    )
    parts = F.when(flips, F.array(event("CLOSE", way(start), start, zero), event("OPEN", way(F.col("_after")), zero, F.col("_after")))).otherwise(F.array(one))
    out = rows.select(*KEYS, "id", "ts", "price", F.posexplode(parts).alias("ordinal", "_e"))
    return out.select(*KEYS, "id", "ts", "ordinal", "_e.*", (F.col("price") * F.col("_e.quantity")).alias("notional"))
