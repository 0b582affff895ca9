"""Reports on a ledger of realised trades (side, entity, entry_time, realized_pct, net_pct)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.columns import t_stat, wilson
from crosspanel.operators.evaluation import rank_ic


def realized_stats(history: DataFrame) -> DataFrame:
    """Per side: averages, hit with its Wilson interval, spread, plain and window-clustered t."""
    windows = history.groupBy("side", "entry_time").agg(F.avg("net_pct").alias("window_net"), F.avg("realized_pct").alias("window_gross"))
    clustered = windows.groupBy("side").agg(F.count("*").alias("n_windows"), t_stat("window_net").alias("tstat_clustered"), F.avg("window_net").alias("avg_net_per_window"), F.avg("window_gross").alias("avg_gross_per_window"))
    g = history.groupBy("side").agg(F.count("*").alias("n"), F.avg("realized_pct").alias("avg"), F.avg("net_pct").alias("avg_net"), F.sum((F.col("net_pct") > 0).cast("bigint")).alias("wins"), F.sum((F.col("realized_pct") > 0).cast("bigint")).alias("gross_wins"), F.stddev_samp("net_pct").alias("std"), t_stat("net_pct").alias("tstat"))
    low, high = wilson(F.col("wins"), F.col("n"))
    return g.join(clustered, "side").select("*", (100 * F.col("wins") / F.col("n")).alias("win_pct"), (100 * F.col("gross_wins") / F.col("n")).alias("gross_win_pct"), (100 * low).alias("win_ci_lo"), (100 * high).alias("win_ci_hi"), (F.col("avg_net") / F.nullif(F.col("std"), F.lit(0.0))).alias("sharpe"))


def cohorts(history: DataFrame) -> DataFrame:
    """Every trade counts in ``all`` and in its own cohort by its actionable flag."""
    own = F.when(F.col("actionable"), "actionable").when(~F.col("actionable"), "watch").otherwise("unknown")
    return history.withColumn("cohort", F.explode(F.array(F.lit("all"), own))).groupBy("side", "cohort").agg(F.count("*").alias("n"), F.avg("net_pct").alias("avg_net"), F.avg((F.col("net_pct") > 0).cast("double")).alias("hit"))


def daily_series(history: DataFrame, value: str = "realized_pct") -> DataFrame:
    """Per side and day: trades, hit, mean, additive cumulation, and drawdown from a peak of at
    least zero."""
    d = history.groupBy("side", F.to_date("entry_time").alias("day")).agg(F.count("*").alias("n_trades"), F.avg((F.col(value) > 0).cast("double")).alias("hit_rate"), F.avg(value).alias("mean_pct"))
    w = Window.partitionBy("side").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("cum_pct", F.sum("mean_pct").over(w))
    return d.withColumn("drawdown_pct", F.col("cum_pct") - F.greatest(F.lit(0.0), F.max("cum_pct").over(w)))


def strategy_comparison(history: DataFrame) -> DataFrame:
    """Shorts alone against shorts and watched longs together, by day, and their totals."""
    arms = F.explode(F.when(F.col("side") == "SHORT", F.array(F.lit("short_only"), F.lit("long_short"))).when(F.col("side") == "WATCH_LONG", F.array(F.lit("long_short"))).otherwise(F.array().cast("array<string>"))).alias("arm")
    armed = history.select("entry_time", F.col("net_pct").alias("realized_pct"), arms).withColumnRenamed("arm", "side")
    d = daily_series(armed)
    return d.groupBy(F.col("side").alias("strategy")).agg(F.count("*").alias("n_days"), F.max_by("cum_pct", "day").alias("final_cum"), F.min("drawdown_pct").alias("max_drawdown"), F.avg("mean_pct").alias("daily_mean"), (F.avg("mean_pct") / F.nullif(F.stddev_samp("mean_pct"), F.lit(0.0))).alias("daily_sharpe"))


def _half_even(x: Column) -> Column:
    """Nearest whole number, halves to even."""
    low = F.floor(x)
    return F.when(x - low > 0.5, low + 1).when(x - low < 0.5, low).otherwise(low + low % 2)


def percentiles(history: DataFrame, points: tuple[int, ...] = (2, 5, 25, 75, 95, 98), value: str = "realized_pct") -> DataFrame:
    """Nearest-rank percentiles, the upper median and the extremes of each side."""
    r = history.select("side", F.col(value).alias("v"), (F.row_number().over(Window.partitionBy("side").orderBy(value)) - 1).alias("i"), F.count("*").over(Window.partitionBy("side")).alias("n"))
    at = {f"p{p}": _half_even(F.lit(p / 100) * (F.col("n") - 1)) for p in points} | {"median": F.floor(F.col("n") / 2)}
    return r.groupBy("side").agg(F.first("n").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), *[F.max(F.when(F.col("i") == k, F.col("v"))).alias(c) for c, k in at.items()])


def histogram(history: DataFrame, bins: int = 12, value: str = "realized_pct") -> DataFrame:
    """Counts in equal bins between the 2nd and 98th percentile (the extremes for fewer than 50
    trades); what lies outside counts in the outer bins."""
    p = percentiles(history, (2, 98), value)
    low, high = F.when(F.col("n") >= 50, F.col("p2")).otherwise(F.col("min")), F.when(F.col("n") >= 50, F.col("p98")).otherwise(F.col("max"))
    p = p.select("side", low.alias("lo"), high.alias("hi")).withColumn("width", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0))
    at = F.least(F.greatest(F.floor((F.col(value) - F.col("lo")) / F.col("width")), F.lit(0)), F.lit(bins - 1))
    counted = history.join(F.broadcast(p), "side").groupBy("side", at.alias("bin")).agg(F.count("*").alias("count"))
    return p.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("bin", F.col("bin").cast("bigint")).join(counted, ["side", "bin"], "left").select("side", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_low"), F.coalesce("count", F.lit(0)).alias("count"))


def monthly_returns(series: DataFrame) -> DataFrame:
    return series.groupBy("side", F.year("day").cast("bigint").alias("year"), F.month("day").cast("bigint").alias("month")).agg(F.sum("mean_pct").alias("return_pct"), F.count("*").alias("n_days"), F.sum("n_trades").alias("n_trades"))


def rolling_weighted(series: DataFrame, rows: int = 7) -> DataFrame:
    """Mean and hit over the last ``rows`` days that traded, weighted by trades."""
    w = Window.partitionBy("side").orderBy("day").rowsBetween(1 - rows, 0)
    n = F.sum("n_trades").over(w)
    return series.select("side", "day", n.alias("window_n"), (F.sum(F.col("mean_pct") * F.col("n_trades")).over(w) / n).alias("rolling_mean"), (F.sum(F.col("hit_rate") * F.col("n_trades")).over(w) / n).alias("rolling_hit"))


def best_worst(history: DataFrame, k: int, keys: list[str], value: str = "realized_pct") -> DataFrame:
    """The ``k`` best and worst trades of each side; ties by ``keys``."""
    best = F.row_number().over(Window.partitionBy("side").orderBy(F.desc(value), *keys))
    worst = F.row_number().over(Window.partitionBy("side").orderBy(F.asc(value), *keys))
    top = history.withColumn("place", best).where(F.col("place") <= k).withColumn("kind", F.lit("best"))
    return top.unionByName(history.withColumn("place", worst).where(F.col("place") <= k).withColumn("kind", F.lit("worst")))


def reliability(history: DataFrame, least: int = 5, trusted: float = 0.6, untrusted: float = 0.4) -> DataFrame:
    """Hit rate of each entity with enough trades, and a trust tag."""
    g = history.where("realized_pct IS NOT NULL").groupBy("entity").agg(F.count("*").alias("n"), F.avg((F.col("realized_pct") > 0).cast("double")).alias("hit_rate"), F.avg("realized_pct").alias("mean_pct")).where(F.col("n") >= least)
    return g.withColumn("trust", F.when(F.col("hit_rate") >= trusted, "trusted").when(F.col("hit_rate") <= untrusted, "untrusted").otherwise(""))


def worst_share(values: DataFrame, value: str, share: float, *by: str) -> DataFrame:
    """Mean of the worst ``share`` of the values (at least one)."""
    w = Window.partitionBy(*by)
    r = values.withColumn("_i", F.row_number().over(w.orderBy(value))).withColumn("_n", F.greatest(F.lit(1), F.ceil(F.count("*").over(w) * share)))
    return r.where("_i <= _n").groupBy(*by).agg(F.avg(value).alias("worst_mean"), F.count("*").alias("worst_n"))


def left_out(parts: DataFrame, by: str, costs_bps: tuple[float, ...] = (0, 10, 20, 30)) -> DataFrame:
    """Means of baskets without each entity in turn, at each further cost. ``parts``: ``by``, ts, entity,
    part (what the position adds to its slot's result, in percent) and weight (its share of the slot).

    The weight of an entity left out stays in cash: its part and its costs go, the others are not scaled
    up. Sums are additive, so that one pass gives every mean by subtraction: by, entity (null for all of
    them), cost_bps, n_slots, mean and, for an entity, what it contributed.
    """
    slots = parts.groupBy(by).agg(F.count_distinct("ts").alias("n_slots"))
    sums = parts.groupBy(by, "entity").agg(F.sum("part").alias("part"), F.sum("weight").alias("weight"))
    all_of = sums.groupBy(by).agg(F.sum("part").alias("all_part"), F.sum("weight").alias("all_weight"))
    nobody = all_of.select(by, F.lit(None).cast(parts.schema["entity"].dataType).alias("entity"), F.lit(0.0).alias("part"), F.lit(0.0).alias("weight"))
    rows = sums.unionByName(nobody).join(all_of, by).join(slots, by).withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in costs_bps])))
    net = lambda part, weight: (part - weight * F.col("cost_bps") / 100) / F.col("n_slots")
    return rows.select(by, "entity", "cost_bps", "n_slots", net(F.col("all_part") - F.col("part"), F.col("all_weight") - F.col("weight")).alias("mean"), F.when(F.col("entity").isNotNull(), net(F.col("part"), F.col("weight"))).alias("contribution"))


def compared_replay(saved: DataFrame, replayed: DataFrame, actual: DataFrame, places: int = 5, tolerance: float = 1e-4, least: int = 10) -> DataFrame:
    """Saved scores against those made anew (both ts, entity, score), slot by slot, with the returns
    ``actual`` (ts, entity, ret).

    Returns ts, n_saved, n_replay, n_common, the names added and removed, how many common scores differ
    by more than ``tolerance`` and the largest difference (the replay is rounded to the ``places`` of the
    saved ones), rank correlations of either pool and of the common names with what came of them and with
    each other, and a status: insufficient (fewer than ``least`` common names), members, scores, or same.
    A slot that one side lacks is insufficient.
    """
    one = saved.select("ts", "entity", F.col("score").alias("saved"))
    both = one.join(replayed.select("ts", "entity", F.col("score").alias("replay")), ["ts", "entity"], "full").join(actual.select("ts", "entity", "ret"), ["ts", "entity"], "left")
    in_both = F.col("saved").isNotNull() & F.col("replay").isNotNull()
    apart = F.when(in_both, F.abs(F.col("saved") - F.round("replay", places)))
    names = lambda missing, there: F.array_sort(F.collect_list(F.when(F.col(missing).isNull() & F.col(there).isNotNull(), F.col("entity"))))
    slots = both.groupBy("ts").agg(
        F.count("saved").alias("n_saved"), F.count("replay").alias("n_replay"), F.count_if(in_both).alias("n_common"), names("saved", "replay").alias("added"), names("replay", "saved").alias("removed"),
        F.count_if(apart > tolerance).alias("n_changed"), F.max(apart).alias("largest"),
    )
    common = both.where(in_both)
    pairs = (("replay_ic", both, "replay", "ret"), ("saved_common_ic", common, "saved", "ret"), ("replay_common_ic", common, "replay", "ret"), ("agreement", common, "saved", "replay"))
    for name, rows, a, b in pairs:
        slots = slots.join(rank_ic(rows, a, b, ("ts",), least).select("ts", F.col("ic").alias(name)), "ts", "left")
    moved = (F.size("added") > 0) | (F.size("removed") > 0)
    return slots.withColumn("status", F.when(F.col("n_common") < least, "insufficient").when(moved, "members").when(F.col("n_changed") > 0, "scores").otherwise("same"))
