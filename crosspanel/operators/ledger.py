"""Ledgers: as-of joins, maturation, costs, deadlines, witnesses, journals, checks and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, value: str, name: str) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before its timestamp. Both sides are
    dealt once by ``by`` and walked in time order: no range join."""
    a = left.select(F.col(by), F.col(left_ts).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.struct(*left.columns).alias("_row"))
    b = right.where(F.col(value).isNotNull()).select(F.col(by), F.col(right_ts).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("_last", F.last("_value", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", F.col("_last").alias(name))


def cost_of(side: Column, fee_bps: float = 6.0, slippage_bps: float = 4.0, short_extra_bps: float = 10.0) -> Column:
    """Round-trip cost of a side."""
    return F.lit(2 * (fee_bps + slippage_bps) / 10_000) + F.when(side == "SHORT", F.lit(short_extra_bps / 10_000)).otherwise(0.0)


def side_return(side: Column, entry: Column, exit_: Column) -> Column:
    """Return by side: shorts gain when the price falls."""
    raw = exit_ / F.nullif(entry, F.lit(0.0)) - 1
    return F.when(side == "SHORT", -raw).otherwise(raw)


def matured(recommendations: DataFrame, prices: DataFrame) -> DataFrame:
    """Recommendations (entity, side, entry_time, target_time) whose target lies within the price
    history, with as-of entry and exit prices, gross and net return."""
    last = prices.agg(F.max("ts").alias("_latest"))
    due = recommendations.join(F.broadcast(last), F.col("target_time") <= F.col("_latest")).drop("_latest")
    priced = as_of(as_of(due, prices, "entity", "entry_time", "ts", "close", "entry_price"), prices, "entity", "target_time", "ts", "close", "exit_price")
    gross = side_return(F.col("side"), F.col("entry_price"), F.col("exit_price"))
    return priced.select("*", gross.alias("gross_return"), cost_of(F.col("side")).alias("cost_return"), (gross - cost_of(F.col("side"))).alias("net_return"))


def pending(observations: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    return observations.join(outcomes.select(*keys), keys, "left_anti")


def backfilled(ledger: DataFrame) -> DataFrame:
    """Costs that old rows lack: gross from the realised return, cost by side, net from both."""
    gross = F.coalesce("gross_return", "realized_return")
    cost = F.coalesce("cost_return", cost_of(F.col("side")))
    return ledger.withColumns({"gross_return": gross, "cost_return": cost, "net_return": F.coalesce("net_return", gross - cost)})


def violations(ledger: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Rows that break a ledger invariant, one row for each rule broken."""
    rules = {
        "net": F.abs(F.col("net_return") - (F.col("gross_return") - F.col("cost_return"))) > tolerance,
        "cost": F.abs(F.col("cost_return") - cost_of(F.col("side"))) > tolerance,
        "order": F.col("target_time") <= F.col("entry_time"),
        "price": (F.col("entry_price") <= 0) | (F.col("exit_price") <= 0),
        "missing": F.col("gross_return").isNull(),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return ledger.withColumn("rule", F.explode(broken))


def slots(first: str, last: str, hours: int) -> Column:
    """Fixed slot grid, as an array."""
    return F.sequence(F.expr(f"TIMESTAMP_NTZ '{first}'"), F.expr(f"TIMESTAMP_NTZ '{last}'"), F.expr(f"INTERVAL {hours} HOURS"))


def captured(grid: DataFrame, records: DataFrame, minutes: int) -> DataFrame:
    """Status of each slot: recorded if a record came within the deadline, late or missed else."""
    joined = grid.join(records.select("slot", "recorded_at"), "slot", "left")
    timely = (F.col("recorded_at") >= F.col("slot")) & (F.col("recorded_at") <= F.col("slot") + F.make_interval(mins=F.lit(minutes)))
    g = joined.groupBy("slot").agg(F.min(F.when(timely, F.col("recorded_at"))).alias("recorded_at"), F.count("recorded_at").alias("n"))
    return g.withColumn("status", F.when(F.col("recorded_at").isNotNull(), "recorded").when(F.col("n") > 0, "late").otherwise("missed"))


def maturity(slot: Column, now: Column, exit_hours: int = 7, settle_hours: int = 1, grace_hours: int = 48) -> Column:
    """waiting until the exit has settled, due until the grace ends, expired after it."""
    ready = slot + F.make_interval(hours=F.lit(exit_hours + settle_hours))
    return F.when(now < ready, "waiting").when(now <= slot + F.make_interval(hours=F.lit(exit_hours + grace_hours)), "due").otherwise("expired")


def first_witness(records: DataFrame, key: str = "slot") -> DataFrame:
    """Of the records of a slot the first (then the least digest) counts."""
    order = Window.partitionBy(key).orderBy("recorded_at", "digest")
    return records.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def journal(events: DataFrame) -> DataFrame:
    """Changes of state: (case, sequence, at, state, error). A first success is no change, and
    repeats of the last state are left out. ``events``: case, at, error (null if it went well)."""
    w = Window.partitionBy("case").orderBy("at")
    state = F.when(F.col("error").isNotNull(), "error").otherwise("recovered")
    seen = F.max(F.col("error").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    e = events.withColumn("state", state).where(F.col("case").isNotNull()).withColumn("_seen", seen).where("_seen = 1")
    change = F.lag("state").over(w).isNull() | (F.lag("state").over(w) != F.col("state")) | ~F.lag("error").over(w).eqNullSafe(F.col("error"))
    e = e.withColumn("_change", change).where("_change")
    return e.select("case", F.row_number().over(w).cast("bigint").alias("sequence"), "at", "state", "error")


def replayed(stored: DataFrame, recomputed: DataFrame, keys: list[str], values: list[str], rtol: float = 1e-8, atol: float = 1e-10) -> DataFrame:
    """Rows that differ between what was stored and what is recomputed, with the reason."""
    both = stored.select(*keys, *[F.col(v).alias(f"{v}_old") for v in values], F.lit(1).alias("_old")).join(recomputed.select(*keys, *[F.col(v).alias(f"{v}_new") for v in values], F.lit(1).alias("_new")), keys, "full")
    differs = F.lit(False)
    for v in values:
        old, new = F.col(f"{v}_old"), F.col(f"{v}_new")
        differs = differs | (old.isNull() != new.isNull()) | F.coalesce(F.abs(old - new) > atol + rtol * F.abs(new), F.lit(False))
    reason = F.when(F.col("_new").isNull(), "not_recomputed").when(F.col("_old").isNull(), "not_stored").when(differs, "differs")
    return both.withColumn("reason", reason).where("reason IS NOT NULL").drop("_old", "_new")


def exact_returns(prices: DataFrame, slots_: DataFrame, lag_hours: int, horizon_hours: int) -> DataFrame:
    """Two-point returns at exact times: (slot, entity, ret, status). A price that is missing,
    repeated, not positive or not finite makes the pair invalid; nothing is filled."""
    def leg(name: str, hours: int) -> DataFrame:
        at = slots_.select("slot", (F.col("slot") + F.make_interval(hours=F.lit(hours))).alias("ts"))
        good = (F.count("*") == 1) & (F.min("close") > 0) & ~F.isnan(F.min("close")) & (F.max("close") < float("inf"))
        return prices.join(at, "ts").groupBy("slot", "entity").agg(F.when(good, F.min("close")).alias(name))

    both = leg("entry", lag_hours).join(leg("exit", lag_hours + horizon_hours), ["slot", "entity"], "full")
    ret = F.col("exit") / F.col("entry") - 1
    return both.select("slot", "entity", ret.alias("ret"), F.when(ret.isNull(), "invalid").otherwise("evaluated").alias("status"))
