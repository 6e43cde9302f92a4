"""Cohort weights, 15-minute behaviour buckets, signals and their changes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from decimal import ROUND_HALF_EVEN, Context, Decimal
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import bucket_start, semantic
from ..scratch import materialise

SEMANTICS = tuple(f"{d}_{k}" for d in ("LONG", "SHORT") for k in ("OPEN", "INCREASE", "REDUCE", "CLOSE"))
BUCKET_MINUTES = 15
MOST_MEMBERS = 200


def bucket_totals(events: DataFrame, *, minutes: int = BUCKET_MINUTES) -> DataFrame:
    """Per coin and bucket: events, distinct wallets and notional."""
    return events.groupBy("coin", bucket_start(F.col("ts"), minutes).alias("bucket")).agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("wallet").alias("n_wallets"), F.sum("notional").alias("notional"))


def bucket_cells(events: DataFrame, *, minutes: int = BUCKET_MINUTES) -> DataFrame:
    """The total of each bucket and its semantic cells, by grouping sets in one pass; the total is named TOTAL."""
    rows = events.select("coin", bucket_start(F.col("ts"), minutes).alias("bucket"), semantic(F.col("direction"), F.col("event_type")).alias("cell"), "wallet", "notional")
    cells = rows.groupingSets([["coin", "bucket", "cell"], ["coin", "bucket"]], "coin", "bucket", "cell")
    return cells.agg(F.grouping("cell").alias("_total"), F.count(F.lit(1)).alias("n_events"), F.count_distinct("wallet").alias("n_wallets"), F.sum("notional").alias("notional")).withColumn("cell", F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col("cell"))).drop("_total")


def fail_closed(required: DataFrame, totals: DataFrame, issues: DataFrame, keys: Sequence[str] = ("coin", "bucket")) -> DataFrame:
    """Per required bucket: BLOCKED with null totals if any issue exists, EMPTY with zeros, or VALID."""
    codes = issues.groupBy(*keys).agg(F.array_sort(F.collect_set("issue")).alias("issues"))
    rows = required.join(totals, list(keys), "left").join(codes, list(keys), "left")
    blocked = F.size(F.coalesce("issues", F.array().cast("array<string>"))) > 0
    state = F.when(blocked, "BLOCKED").when(F.col("n_events").isNull(), "EMPTY").otherwise("VALID")
    values = {c: F.when(~blocked, F.coalesce(c, F.lit(0))) for c in ("n_events", "n_wallets", "notional")}
    return rows.withColumn("state", state).withColumns(values).withColumn("issues", F.concat_ws(",", "issues"))


def oversized(members: DataFrame, most: int = MOST_MEMBERS) -> DataFrame:
    """Cohorts (all of ``members`` are one without such a column) of more than ``most`` members: n_members and error_code TOO_MANY_MEMBERS.
    The operators leave such cohorts out and compute the others."""
    sizes = members.groupBy(*_cohort_of(members)).agg(F.count(F.lit(1)).alias("n_members")).filter(F.col("n_members") > most)
    return sizes.withColumn("error_code", F.lit("TOO_MANY_MEMBERS"))


def _cohort_of(members: DataFrame) -> list[str]:
    return [c for c in members.columns if c == "cohort"]


def bounded_members(members: DataFrame) -> DataFrame:
    """The members of cohorts that are not oversized, written down."""
    members = materialise(members, "members")
    cohort = _cohort_of(members)
    if cohort:
        return members.join(oversized(members), cohort, "left_anti")
    return members.limit(0) if members.limit(MOST_MEMBERS + 1).count() > MOST_MEMBERS else members


def _sides(events: DataFrame, minutes: int) -> DataFrame:
    """Per coin, bucket and wallet the events that buy and that sell."""
    buying = (F.col("direction") == "LONG") == F.col("event_type").isin("POSITION_OPEN", "POSITION_INCREASE")
    return events.groupBy("coin", bucket_start(F.col("ts"), minutes).alias("bucket"), "wallet").agg(F.count_if(buying).alias("n_buy"), F.count_if(~buying).alias("n_sell"))


def _with_strengths(rows: DataFrame) -> DataFrame:
    buy = F.when(F.col("n_buy") == 0, 0.0).when(F.col("n_sell") == 0, 1.0).otherwise(0.5)
    sell = F.when(F.col("n_sell") == 0, 0.0).when(F.col("n_buy") == 0, 1.0).otherwise(0.5)
    return rows.withColumns({"buy": F.col("weight") * buy, "sell": F.col("weight") * sell})


class Frames(NamedTuple):
    """Every row of ``keys`` with every bucket of its coin: the rows that signals have, not written out. The buckets of all coins are broadcast,
    8 bytes each, so what is missing in a table is made by the tasks that hold its keys, without a shuffle of the frames."""

    keys: DataFrame
    #: coin, _buckets: its buckets in order.
    buckets: DataFrame

    def select(self, *columns: str) -> DataFrame:
        return self._spread(self.keys, F.col("_buckets")).select(*columns)

    def missing(self, held: DataFrame, basis: Sequence[str]) -> DataFrame:
        """The frames that ``held`` (basis, bucket) lacks; ``basis`` names a row of ``keys``."""
        own = held.groupBy(*basis).agg(F.collect_set("bucket").alias("_held"))
        # by number, since each of these few rows becomes as many as its coin has buckets: they are not put together for being small
        tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = self.keys.join(own, list(basis), "left").repartition(tasks, *basis)
        return self._spread(rows, F.array_except("_buckets", F.coalesce("_held", F.array().cast(own.schema["_held"].dataType))))

    def consecutive(self, sums: DataFrame, basis: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        """Each frame but a coin's first with the one before it in the coin's list. First those of which ``sums`` (basis, bucket and numbers) has either: its
        columns, the same with ``previous_`` before their names, and ``previous_bucket``, zeros where it lacks one. Then basis and bucket of those of which it has neither."""
        own, place, rest = [c for c in sums.columns if c not in (*basis, "bucket")], [*basis, "bucket"], F.size("_buckets") - 1
        steps = F.broadcast(self.buckets.select("coin", F.explode(F.arrays_zip(F.slice("_buckets", 1, rest).alias("b"), F.slice("_buckets", 2, rest).alias("c"))).alias("_s")).select("coin", F.col("_s.b").alias("previous_bucket"), F.col("_s.c").alias("bucket")))
        before = sums.withColumnsRenamed({c: f"previous_{c}" for c in ("bucket", *own)}).join(steps, ["coin", "previous_bucket"]).drop("previous_bucket")
        both = sums.unionByName(before, allowMissingColumns=True).groupBy(*place).agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for o in own for c in (o, f"previous_{o}")))
        both = materialise(both.join(steps, ["coin", "bucket"]), "pairs")
        later = self.buckets.withColumn("_buckets", F.slice("_buckets", 2, rest))
        return both, Frames(self.keys, later).missing(both, basis)

    def _spread(self, rows: DataFrame, buckets: Column) -> DataFrame:
        return rows.join(F.broadcast(self.buckets), "coin").select(*self.keys.columns, F.explode(buckets).alias("bucket"))


def _bucket_lists(sides: DataFrame) -> DataFrame:
    return sides.select("coin", "bucket").distinct().groupBy("coin").agg(F.sort_array(F.collect_list("bucket")).alias("_buckets"))


def _frames(weights: DataFrame, sides: DataFrame) -> Frames:
    """Each bucket with each cohort."""
    lists, cohort = _bucket_lists(sides), _cohort_of(weights)
    if not cohort:
        return Frames(lists.select("coin"), lists)
    return Frames(weights.select(*cohort).distinct().withColumn("coin", F.explode(lists.agg(F.collect_list("coin")).scalar())), lists)


def participations(weights: DataFrame, events: DataFrame, *, minutes: int = BUCKET_MINUTES) -> tuple[DataFrame, Frames]:
    """Per coin, bucket and cohort member that took part its weight split over buying and selling, half on each side if it did both;
    and the frames of ``signals``: each coin, bucket and cohort, whether any member took part or not.

    Events meet weights by wallet; members that took no part make no rows. Oversized cohorts are left out.
    """
    weights, sides = bounded_members(weights), materialise(_sides(events, minutes), "sides")
    return _with_strengths(sides.join(weights, "wallet")), _frames(weights, sides)


def contributions(weights: DataFrame, events: DataFrame, *, minutes: int = BUCKET_MINUTES) -> DataFrame:
    """``participations`` with a row for every member of a cohort in every bucket, as receipts list them: members without events count with 0.
    Other columns of ``weights``, such as its cohort, are kept. For signals take ``participations``, which is far smaller."""
    weights, sides = bounded_members(weights), materialise(_sides(events, minutes), "sides")
    lists, basis = _bucket_lists(sides), [*_cohort_of(weights), "wallet", "coin"]
    took = materialise(sides.join(weights, "wallet"), "took-part")
    rest = Frames(weights.crossJoin(F.broadcast(lists.select("coin"))), lists).missing(took, basis)
    none = F.lit(0).cast("long")
    return _with_strengths(took).unionByName(_with_strengths(rest.withColumns({"n_buy": none, "n_sell": none})))


def _framed(sums: DataFrame, frames: Frames | None, basis: Sequence[str], told: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``told`` of the sums of every frame, zeros where there are none; those are constants of the plan."""
    if frames is None:
        return told(sums)
    sums = materialise(sums, "sums")
    own = [c for c in sums.columns if c not in (*basis, "bucket")]
    rest = frames.missing(sums, basis).select(*basis, "bucket", *(F.lit(0).cast(sums.schema[c].dataType).alias(c) for c in own))
    return told(sums).unionByName(told(rest))


def signals(parts: DataFrame, frames: Frames | None = None, *, anchor: int = 2, digits: int = 9, basis: Sequence[str] = ("coin",)) -> DataFrame:
    """Strengths (to ``digits`` places, so that equal sums are equal in whatever order they were added), net, mass, agreement, breadth and
    confidence of each bucket on its basis, from ``participations``, or from ``contributions``, which needs no frames."""
    took = (F.col("n_buy") + F.col("n_sell")) > 0
    strengths = (F.round(F.sum(c), digits).alias(f"{c}_strength") for c in ("buy", "sell"))
    sums = parts.groupBy(*basis, "bucket").agg(*strengths, F.count_if(took).alias("n_wallets"), F.count_if((F.col("n_buy") > 0) & (F.col("n_sell") == 0)).alias("n_buy_only"), F.count_if((F.col("n_sell") > 0) & (F.col("n_buy") == 0)).alias("n_sell_only"), F.count_if((F.col("n_sell") > 0) & (F.col("n_buy") > 0)).alias("n_mixed"))

    def told(s: DataFrame) -> DataFrame:
        s = s.withColumns({"net_signal": F.col("buy_strength") - F.col("sell_strength"), "mass": F.col("buy_strength") + F.col("sell_strength")})
        agreement = F.when(F.col("mass") == 0, 0.0).otherwise(F.greatest("buy_strength", "sell_strength") / F.col("mass"))
        s = s.withColumns({"agreement": agreement, "breadth": F.col("n_wallets") / (F.col("n_wallets") + anchor)})
        return s.withColumn("confidence", F.bround(F.col("mass") * F.col("agreement") * F.col("breadth"), digits)).withColumn("state", F.when(F.col("mass") == 0, "NO_SIGNAL").otherwise("VALID"))

    return _framed(sums, frames, basis, told)


def exact_confidence(parts: DataFrame, frames: Frames | None = None, *, anchor: int = 2, basis: Sequence[str] = ("coin",), units: int = 1_000_000_000) -> DataFrame:
    """For receipts: strengths, net and confidence as decimals, the confidence to 18 places, half to even.

    ``parts``, of ``participations`` or ``contributions``, has ``weight_units``, whole parts of ``units``. Mass times agreement is the larger strength, so the
    confidence is that times the breadth n / (n + anchor).
    """
    weight = F.col("weight_units").cast("decimal(10,0)") / F.lit(units).cast("decimal(10,0)")
    half = (weight / F.lit(2).cast("decimal(1,0)")).cast("decimal(21,19)")
    buy = F.when(F.col("n_buy") == 0, 0).when(F.col("n_sell") == 0, 2).otherwise(1).cast("decimal(1,0)")
    sell = F.when(F.col("n_sell") == 0, 0).when(F.col("n_buy") == 0, 2).otherwise(1).cast("decimal(1,0)")
    sums = parts.groupBy(*basis, "bucket").agg(F.sum(half * buy).cast("decimal(21,19)").alias("buy_strength"), F.sum(half * sell).cast("decimal(21,19)").alias("sell_strength"), F.count_if(F.col("n_buy") + F.col("n_sell") > 0).cast("decimal(5,0)").alias("_n"))
    share = F.greatest("buy_strength", "sell_strength") * F.col("_n") / (F.col("_n") + F.lit(anchor)).cast("decimal(5,0)")
    return _framed(sums, frames, basis, lambda s: s.withColumns({"net_signal": F.col("buy_strength") - F.col("sell_strength"), "confidence": F.bround(share, 18)}).drop("_n"))


def change_label(before: Column, now: Column) -> Column:
    return (
        F.when((before < 0) & (now > 0), "BULLISH_REVERSAL").when((before > 0) & (now < 0), "BEARISH_REVERSAL")
        .when((before > 0) & (now > before), "BUY_ACCELERATING").when((before > 0) & (now < before), "BUY_WEAKENING")
        .when((before < 0) & (now < before), "SELL_ACCELERATING").when((before < 0) & (now > before), "SELL_WEAKENING").otherwise("NONE")
    )


def direction_changes(signals: DataFrame, *, minutes: int = BUCKET_MINUTES, basis: Sequence[str] = ("coin",)) -> DataFrame:
    """Each signal against that of the bucket right before it on the same basis; a missing bucket never matches."""
    order = Window.partitionBy(*basis).orderBy("bucket")
    rows = signals.withColumns({"_before": F.lag("net_signal").over(order), "_at": F.lag("bucket").over(order)})
    rows = rows.filter(F.col("_at") + F.make_dt_interval(mins=F.lit(minutes)) == F.col("bucket"))
    now, before = F.col("net_signal"), F.col("_before")
    label = change_label(before, now)
    emerged = (before == 0) & (now != 0)
    reason = F.when(label != "NONE", "EXACT_NET_TRANSITION").when(emerged & (now > 0), "DIRECTION_EMERGED_BUY").when(emerged, "DIRECTION_EMERGED_SELL").otherwise("UNCHANGED_NET")
    return rows.select(*basis, "bucket", before.alias("previous_net"), now.alias("current_net"), (now - before).alias("delta"), label.alias("event_type"), reason.alias("reason"))


def raw_weight(win_rate: Column, profit_factor: Column, n_cycles: Column, top_share: Column) -> Column:
    quality = (win_rate + profit_factor / (profit_factor + 1)) / 2
    return quality * (n_cycles / (n_cycles + 30)) * (1 - top_share)


def normalised_weights(members: DataFrame, *, raw: str = "raw", member: str = "wallet", cohort: Sequence[str] = (), units: int = 1_000_000_000) -> DataFrame:
    """Weights of ``units`` equal parts that sum to one in each cohort: floors, then the largest remainders,
    ties to the smaller member."""
    total = F.sum(raw).over(Window.partitionBy(*cohort))
    share = F.when(total > 0, F.col(raw) / total).otherwise(1 / F.count(F.lit(1)).over(Window.partitionBy(*cohort)))
    rows = members.withColumn("_x", share * units).withColumn("_floor", F.floor("_x"))
    left = F.lit(units) - F.sum("_floor").over(Window.partitionBy(*cohort))
    place = F.row_number().over(Window.partitionBy(*cohort).orderBy(F.desc(F.round(F.col("_x") - F.col("_floor"), 6)), member))
    return rows.withColumn("weight_units", (F.col("_floor") + (place <= left).cast("int")).cast("long")).withColumn("weight", F.col("weight_units") / units).drop("_x", "_floor")


def exact_weights(members: DataFrame, cohort: str = "cohort") -> DataFrame:
    """The same with decimals of 80 digits and 18 places for receipts: cohort, wallet, raw_weight, weight as text.

    A cohort has at most 200 members by its definition, so each group is small; a larger one is one row with ``error_code``. Metrics come as text.
    """
    large = oversized(members.withColumnRenamed(cohort, "cohort")).select(F.col("cohort").alias(cohort), "error_code")
    ctx = Context(prec=80, rounding=ROUND_HALF_EVEN)
    unit = Decimal(10) ** 18

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("wallet").reset_index(drop=True)
        raw = []
        for r in pdf.itertuples():
            win, factor, top, n = Decimal(r.win_rate), Decimal(r.profit_factor), Decimal(r.top_trade_share), Decimal(int(r.n_cycles))
            quality = ctx.divide(ctx.add(win, ctx.divide(factor, ctx.add(factor, 1))), 2)
            value = ctx.multiply(ctx.multiply(quality, ctx.divide(n, n + 30)), 1 - top)
            raw.append(value.quantize(Decimal(1).scaleb(-36), context=ctx))
        total = sum(raw, Decimal(0))
        exact = [ctx.divide(ctx.multiply(x, unit), total) if total else ctx.divide(unit, len(raw)) for x in raw]
        floors = [int(x) for x in exact]
        rest = int(unit) - sum(floors)
        for i in sorted(range(len(exact)), key=lambda i: (floors[i] - exact[i], pdf["wallet"][i]))[:rest]:
            floors[i] += 1
        text = [format((Decimal(f) / unit).normalize(ctx), "f") for f in floors]
        return pd.DataFrame({cohort: pdf[cohort], "wallet": pdf["wallet"], "raw_weight": [format(x.normalize(ctx), "f") for x in raw], "weight": text})

    kind = members.schema[cohort].dataType.simpleString()
    told = members.join(large, cohort, "left_anti").groupBy(cohort).applyInPandas(kernel, f"{cohort} {kind}, wallet string, raw_weight string, weight string")
    return told.unionByName(large, allowMissingColumns=True)


def only_chain(begin: float, start: Sequence[float], after: Sequence[float]) -> tuple[list[int] | None, str | None]:
    """The one order in which executions lead on from ``begin``, each used once, or why there is none.

    An order is an Euler path over positions, found in linear time. Another exists exactly if a position is met
    three times, or if the stretches between the two meetings of two positions cross.
    """
    out: dict[float, list[int]] = {}
    for i in reversed(range(len(start))):
        out.setdefault(start[i], []).append(i)
    stack: list[tuple[float, int]] = [(begin, -1)]
    path = []
    while stack:
        at, edge = stack[-1]
        if out.get(at):
            i = out[at].pop()
            stack.append((after[i], i))
        else:
            path.append(edge)
            stack.pop()
    path = path[-2::-1]
    met = [begin, *(after[i] for i in path)]
    if len(path) != len(start) or any(start[i] != at for i, at in zip(path, met, strict=False)):
        return None, "IMPOSSIBLE_TRANSITION"
    times = Counter(met)
    if max(times.values()) > 2:
        return None, "ORDERING_AMBIGUOUS"
    opened: list[float] = []
    for at in met:
        if times[at] == 2 and opened and opened[-1] == at:
            opened.pop()
        elif times[at] == 2:
            opened.append(at)
    return (None, "ORDERING_AMBIGUOUS") if opened else (path, None)


def causal_order(fills: DataFrame) -> DataFrame:
    """Executions of one (wallet, coin, instant) in the one order in which each starts where the last ended.

    Where a group ends follows from its positions alone, being started from once less than arrived at, so what
    it begins with is known from windows over one row per group and a task takes one group at a time. Adds
    ``place`` and ``issue``: MISSING_BOUNDARY if nothing of a key's first group starts flat, ORDERING_AMBIGUOUS if several
    orders fit, IMPOSSIBLE_TRANSITION if none does; the key's later groups are then left without a place.
    """
    key, group = ["wallet", "coin"], ["wallet", "coin", "ts"]
    rows = fills.select(*group, "id", "start_position", (F.col("start_position") + F.col("delta")).alias("_after"))
    ends = rows.select(*group, F.explode(F.array(F.struct(F.col("start_position").alias("p"), F.lit(1).alias("n")), F.struct(F.col("_after").alias("p"), F.lit(-1).alias("n")))).alias("_e")).select(*group, "_e.*")
    net = ends.groupBy(*group, "p").agg(F.sum("n").alias("_net"), F.count_if(F.col("n") > 0).alias("_starts"))
    own = F.col("_starts") > 0
    groups = net.groupBy(*group).agg(F.sum("_starts").alias("_n"), F.max(own & (F.col("p") == 0)).alias("_flat"), F.min(F.when(own, F.col("p"))).alias("_least"), F.min(F.when(F.col("_net") < 0, F.col("p"))).alias("_last"))
    order = Window.partitionBy(*key).orderBy("ts")
    groups = groups.withColumn("_first", F.row_number().over(order) == 1)
    begin = F.when(F.col("_flat"), F.col("_least") * 0)
    end = F.coalesce("_last", F.when(F.col("_first"), begin))
    groups = groups.withColumn("_end", end).withColumn("_begin", F.when(F.col("_first"), begin).otherwise(F.last("_end", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))))
    rows = rows.join(groups.select(*group, "_n", "_begin"), group)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        begin = pdf["_begin"].iloc[0]
        path, issue = (None, "MISSING_BOUNDARY") if pd.isna(begin) else only_chain(begin, pdf["start_position"].tolist(), pdf["_after"].tolist())
        place = [None] * len(pdf)
        for n, i in enumerate(path or ()):
            place[i] = n
        return pd.DataFrame({"wallet": pdf["wallet"], "coin": pdf["coin"], "id": pdf["id"], "ts": pdf["ts"], "place": pd.array(place, "Int32"), "issue": issue})

    fits = F.coalesce(F.col("start_position") == F.col("_begin"), F.lit(False))
    lone = rows.filter("_n = 1").select("wallet", "coin", "id", "ts", F.when(fits, 0).alias("place"), F.when(F.col("_begin").isNull(), "MISSING_BOUNDARY").when(~fits, "IMPOSSIBLE_TRANSITION").alias("issue"))
    several = rows.filter("_n > 1").groupBy(*group).applyInPandas(kernel, "wallet long, coin string, id long, ts timestamp_ntz, place int, issue string")
    lost = F.first("issue", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return lone.union(several).withColumn("issue", lost).withColumn("place", F.when(F.col("issue").isNull(), F.col("place")))
