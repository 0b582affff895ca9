"""Baskets and their economics: top-k, buffered selection, turnover, costs, P&L, contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.columns import by_time, ratio, t_stat
from crosspanel.operators.chains import carried

NAMES = "array<string>"


def top_k(scores: DataFrame, k: int, ascending: bool = False, *by: str) -> DataFrame:
    """The ``k`` best (or worst) rows of each key by score, ties by name, with their place."""
    order = [F.asc("score") if ascending else F.desc("score"), F.asc("entity")]
    return scores.where("score IS NOT NULL").withColumn("place", F.row_number().over(Window.partitionBy(*(by or ("ts",))).orderBy(*order))).where(F.col("place") <= k)


def ranked_slots(scores: DataFrame, depth: int, *by: str) -> DataFrame:
    """One row per slot: the ``depth`` best and worst names in order. One shuffle ranks both ends;
    only they are gathered, not the whole cross-section."""
    w = Window.partitionBy(*by, "ts")
    ends = scores.where("score IS NOT NULL").select(
        *by, "ts", "entity", F.row_number().over(w.orderBy(F.desc("score"), "entity")).alias("high"), F.row_number().over(w.orderBy("score", "entity")).alias("low")
    ).where((F.col("high") <= depth) | (F.col("low") <= depth))
    named = lambda place: F.array_sort(F.collect_list(F.when(F.col(place) <= depth, F.struct(place, "entity"))))["entity"]
    return ends.groupBy(*by, "ts").agg(named("high").alias("best"), named("low").alias("worst"))


def buffered(slots: DataFrame, long_n: int, short_n: int, buffer: int, *by: str) -> DataFrame:
    """Buffered selection: a held name stays while it is among the first n + buffer. What is held
    depends on the slot before: each strategy's slots are gone through in order, with the last baskets
    as the only state. Returns by, ts, longs, shorts, prev_longs, prev_shorts."""

    def step(state, slot):  # noqa: ANN001, ANN202
        held_l, held_s = state or ([], [])
        best, worst = slot["best"] or [], slot["worst"] or []
        if buffer <= 0 or not (held_l or held_s):
            longs, shorts = best[:long_n], worst[:short_n]
        else:
            stay = [m for m in best[: long_n + buffer] if m in held_l]
            longs = (stay + [m for m in best[:long_n] if m not in stay])[:long_n]
            stay = [m for m in worst[: short_n + buffer] if m in held_s and m not in longs]
            shorts = (stay + [m for m in worst[:short_n] if m not in stay and m not in longs])[:short_n]
        return (longs, shorts), [(*[slot[c] for c in by], slot["ts"], longs, shorts, held_l, held_s)]

    kinds = {f.name: f.dataType.simpleString() for f in slots.schema}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in (*by, "ts")], *[f"{c} {NAMES}" for c in ("longs", "shorts", "prev_longs", "prev_shorts")]])
    return carried(slots.select(*by, "ts", "best", "worst"), list(by), ["ts"], step, schema)


def new_share(now: str, before: str) -> Column:
    """Share of a basket that was not held before; 0 for an empty basket."""
    return F.coalesce(F.size(F.array_except(now, before)) / F.nullif(F.size(now), F.lit(0)), F.lit(0.0))


def positions(baskets: DataFrame, returns: DataFrame, fee: float, short_extra: float = 0.0) -> DataFrame:
    """(ts, side, rank, entity, raw_return, gross, net) of each position with a return; a slot's
    costs are shared by the side's positions. ``returns``: ts, entity, ret."""
    turnover = (new_share("longs", "prev_longs") + new_share("shorts", "prev_shorts")) / 2
    cost = baskets.withColumn("cost", turnover * 2 * fee)
    legs = F.explode(F.array(F.struct(F.lit("long").alias("side"), F.col("longs").alias("names")), F.struct(F.lit("short").alias("side"), F.col("shorts").alias("names")))).alias("leg")
    rows = cost.select("ts", "cost", legs).select("ts", "cost", "leg.side", F.posexplode("leg.names").alias("rank", "entity"))
    held = rows.join(returns.where("ret IS NOT NULL"), ["ts", "entity"]).withColumn("n", F.count("*").over(Window.partitionBy("ts", "side")))
    gross = F.when(F.col("side") == "long", F.col("ret")).otherwise(-F.col("ret")) / F.col("n")
    share = F.col("cost") / F.col("n") + F.when(F.col("side") == "short", F.lit(short_extra) / F.col("n")).otherwise(0.0)
    return held.select("ts", "side", (F.col("rank") + 1).alias("rank"), "entity", F.col("ret").alias("raw_return"), gross.alias("gross"), (gross - share).alias("net"))


def periods(baskets: DataFrame, returns: DataFrame, fee: float, short_extra: float = 0.0) -> DataFrame:
    """(ts, gross, turnover, cost, net) of each slot: mean long return less mean short return; a
    leg without returns counts as 0, both legs halve the turnover."""
    turnover = (new_share("longs", "prev_longs") + new_share("shorts", "prev_shorts")) / 2
    base = baskets.select("ts", turnover.alias("turnover"), F.size("shorts").alias("n_short"), "longs", "shorts")
    legs = base.select("ts", F.explode(F.concat(F.transform("longs", lambda m: F.struct(m.alias("entity"), F.lit(1).alias("sign"))), F.transform("shorts", lambda m: F.struct(m.alias("entity"), F.lit(-1).alias("sign"))))).alias("p")).select("ts", "p.*")
    ret = legs.join(returns, ["ts", "entity"]).groupBy("ts").agg(F.avg(F.when(F.col("sign") == 1, F.col("ret"))).alias("long_ret"), F.avg(F.when(F.col("sign") == -1, F.col("ret"))).alias("short_ret"))
    gross = F.coalesce("long_ret", F.lit(0.0)) - F.coalesce("short_ret", F.lit(0.0))
    cost = F.col("turnover") * 2 * fee + F.when(F.col("n_short") > 0, F.lit(short_extra)).otherwise(0.0)
    return base.join(ret, "ts", "left").select("ts", gross.alias("gross"), "turnover", cost.alias("cost"), (gross - cost).alias("net"))


def drawdowns(pnl: DataFrame, *by: str) -> DataFrame:
    """Equity by compounding, and its drawdown from the highest so far."""
    w = Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    e = pnl.withColumn("equity", F.product(1 + F.col("net")).over(w))
    return e.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def pnl_stats(pnl: DataFrame, periods_per_year: float, *by: str) -> DataFrame:
    """Compound return, annualised Sharpe, drawdown, hit, turnover and cost of a P&L series."""
    spread = F.nullif(F.stddev_samp("net"), F.lit(0.0))
    return drawdowns(pnl, *by).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("gross").alias("mean_gross"), F.avg("net").alias("mean_net"), F.percentile("net", 0.5).alias("median_net"),
        (F.product(1 + F.col("net")) - 1).alias("total"), (F.avg("net") / spread * periods_per_year**0.5).alias("sharpe"), t_stat("net").alias("tstat"),
        F.min("drawdown").alias("max_drawdown"), F.avg((F.col("net") > 0).cast("double")).alias("win"), F.avg("turnover").alias("turnover"), F.avg("cost").alias("cost"),
        F.percentile("net", 0.05).alias("p05"), F.min("net").alias("worst"),
    )


def beta_to(pnl: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Beta of a P&L series to the benchmark's returns (ts, bench)."""
    both = pnl.join(benchmark, "ts").where("bench IS NOT NULL")
    return both.agg(F.when(F.count("*") > 3, ratio(F.covar_samp("net", "bench"), F.var_samp("bench"))).alias("beta"))


def position_summary(rows: DataFrame) -> DataFrame:
    """Each name's part in its side: periods, ranks, contributions and shares of the side's total."""
    g = rows.groupBy("side", "entity").agg(F.count("*").alias("periods"), F.avg("rank").alias("mean_rank"), F.avg("raw_return").alias("mean_return"), F.max("raw_return").alias("worst_return"), F.min("raw_return").alias("best_return"), F.sum("gross").alias("gross"), F.sum("net").alias("net"), F.sum((F.col("gross") > 0).cast("bigint")).alias("positive"))
    side = Window.partitionBy("side")
    return g.select("*", ratio(F.col("gross"), F.sum("gross").over(side)).alias("gross_share"), ratio(F.col("net"), F.sum("net").over(side)).alias("net_share"), (F.col("positive") / F.col("periods")).alias("positive_rate"))


def concentration(summary: DataFrame) -> DataFrame:
    """Distinct names of each side and the shares of its 1, 3 and 5 largest contributors."""
    place = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("gross"), "entity"))
    return summary.withColumn("place", place).groupBy("side").agg(F.count("*").alias("names"), *[F.sum(F.when(F.col("place") <= k, F.col("gross_share"))).alias(f"top{k}") for k in (1, 3, 5)])


def long_economics(scores: DataFrame, returns: DataFrame, active: DataFrame, top: int, cost: float) -> DataFrame:
    """Top-n slots: (ts, n_picks, turnover, gross, net). A missing return voids the slot, the next
    rank never steps in; a slot where ``active`` (ts, active) does not hold resets the holdings."""
    slots = top_k(scores, top).join(returns, ["ts", "entity"], "left").groupBy("ts").agg(F.count("*").alias("n_picks"), F.count("ret").alias("n_ret"), F.avg("ret").alias("mean_ret"), F.collect_set("entity").alias("picks"))
    slots = slots.join(active, "ts", "left").withColumn("active", F.coalesce("active", F.lit(False)))
    before = F.lag(F.when(F.col("active"), F.col("picks"))).over(Window.orderBy("ts"))  # one row a slot
    s = slots.withColumn("before", F.coalesce(before, F.array().cast(NAMES))).where("active")
    gross = F.when(F.col("n_ret") == F.col("n_picks"), F.col("mean_ret"))
    turnover = new_share("picks", "before")
    return s.select("ts", "n_picks", turnover.alias("turnover"), gross.alias("gross"), (gross - turnover * cost).alias("net"))


def quality_shorts(candidates: DataFrame, n: int, entry_sigma: float, stay_sigma: float, least_net: float) -> DataFrame:
    """Shorts by score with thresholds that are milder for held names, slot by slot.
    ``candidates``: ts, entity, score, sigma, expected_net, consensus. Returns ts and shorts."""
    c = candidates.where("score < 0").withColumn("place", F.row_number().over(by_time().orderBy("score", "entity")))
    c = c.where((F.col("consensus") | (F.col("sigma") >= 2)) & (F.col("sigma") >= min(entry_sigma, stay_sigma)) & (F.col("expected_net") >= min(0.0, least_net)))
    slots = candidates.select("ts").distinct().join(c.groupBy("ts").agg(F.array_sort(F.collect_list(F.struct("place", "entity", "sigma", "expected_net"))).alias("names")), "ts", "left")

    def step(held, slot):  # noqa: ANN001, ANN202
        held = held or []
        fits = lambda x: x["sigma"] >= stay_sigma and x["expected_net"] >= 0 if x["entity"] in held else x["sigma"] >= entry_sigma and x["expected_net"] >= least_net
        shorts = [x["entity"] for x in slot["names"] or [] if x["sigma"] is not None and x["expected_net"] is not None and fits(x)][:n]
        return shorts, [(slot["ts"], shorts)]

    return carried(slots, [], ["ts"], step, f"ts {slots.schema['ts'].dataType.simpleString()}, shorts {NAMES}")


def daily(legs: DataFrame, value: str) -> DataFrame:
    """Returns compounded by day; days in between without any count as 0."""
    d = legs.groupBy(F.to_date("ts").alias("day")).agg((F.product(1 + F.col(value)) - 1).alias("ret"))
    span = d.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return span.join(d, "day", "left").select("day", F.coalesce("ret", F.lit(0.0)).alias("ret"))
