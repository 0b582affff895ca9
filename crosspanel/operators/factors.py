"""Factors, cross-sectional scores, forward returns and regimes over a filled panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.columns import by_entity, by_time, change, clipped, finite, full, ratio


def price_factors(panel: DataFrame) -> DataFrame:
    """Reversal, inverse volatility, range contraction and order flow, in one pass per entity."""
    w = by_entity()
    close, volume = F.col("close"), F.col("volume")
    one = panel.withColumn("r1", change(close, 1, w))
    body = volume * F.when(close >= F.col("open"), 1.0).otherwise(-1.0)
    return one.select(
        "ts", "entity", "open", "close", "volume", "r1",
        (-F.col("r1")).alias("reversal_1h"),
        (-change(close, 4, w)).alias("reversal_4h"),
        (-full(F.stddev_samp, F.col("r1"), 24)).alias("volatility_inv_24h"),
        (-full(F.avg, ratio(F.col("high") - F.col("low"), close), 12)).alias("range_contraction_12h"),
        (-ratio(full(F.sum, body, 6), full(F.sum, volume, 6))).alias("order_flow_bear"),
    )


def venue_factors(one: DataFrame, two: DataFrame) -> DataFrame:
    """Second venue against the first, on the timestamps both have: lead of the last return, log
    premium, and the premium's z-score over 24 rows, negated."""
    both = one.select("ts").distinct().join(two.select("ts").distinct(), "ts", "left_semi")
    joined = one.select("ts", "entity", F.col("close").alias("px1")).join(both, "ts", "left_semi").join(two.select("ts", "entity", F.col("close").alias("px2")), ["ts", "entity"], "left")
    w = by_entity()
    premium = F.when((F.col("px1") > 0) & (F.col("px2") > 0), F.ln(F.col("px1") / F.col("px2")))
    lagged = joined.withColumn("premium", premium).withColumn("lead_1h", change(F.col("px2"), 1, w) - change(F.col("px1"), 1, w))
    z = ratio(F.col("premium") - full(F.avg, F.col("premium"), 24), full(F.stddev_samp, F.col("premium"), 24))
    return lagged.select("ts", "entity", "lead_1h", (-F.col("premium")).alias("premium_inv"), (-z).alias("premium_z_24h"))


def calendar_flags(ts: Column, shift_hours: int = 9) -> tuple[Column, Column]:
    """Day-of-week flag and quiet-or-busy-hour flag on a shifted clock."""
    local = ts + F.make_interval(hours=F.lit(shift_hours))
    day, hour = F.weekday(local), F.hour(local)
    return F.when(day < 3, 1.0).when(day > 3, -1.0).otherwise(0.0), F.when(hour.isin(7, 8, 9, 22, 23, 0, 1), 1.0).otherwise(0.0)


def global_factors(panel: DataFrame, benchmark: str, momentum: int = 168, volatility: int = 168, season: int = 24) -> DataFrame:
    """One row per ts: the benchmark's momentum and volatility, and the median of the others'
    returns less the benchmark's."""
    w = by_entity()
    r = panel.select("ts", "entity", "close", change(F.col("close"), 1, w).alias("r1"), change(F.col("close"), season, w).alias("rs"), change(F.col("close"), momentum, w).alias("rm"))
    r = r.withColumn("vol", full(F.stddev_samp, F.col("r1"), volatility) * (volatility**0.5))
    is_bench = F.col("entity") == benchmark
    return r.groupBy("ts").agg(
        F.max(F.when(is_bench, F.col("rm"))).alias("bench_momentum"), F.max(F.when(is_bench, F.col("vol"))).alias("bench_volatility"),
        (F.percentile(F.when(~is_bench, F.col("rs")), 0.5) - F.max(F.when(is_bench, F.col("rs")))).alias("season_index"),
    )


def zscored(frame: DataFrame, columns: list[str], bound: float = 3.0) -> DataFrame:
    """Per-timestamp z-scores, cut at ``bound``; NULL where the cross-section has no spread."""
    w = by_time()
    return frame.select(*[clipped((F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_samp(c).over(w), F.lit(0.0)), bound).alias(c) if c in columns else F.col(c) for c in frame.columns])


def forward_return(price: str, horizon: int, lag: int = 0) -> Column:
    """Return from ``lag`` rows ahead to ``lag + horizon`` rows ahead."""
    w = by_entity()
    return ratio(F.lead(price, lag + horizon).over(w), F.lead(price, lag).over(w)) - 1


def with_benchmark(panel: DataFrame, value: str, benchmark: str, name: str) -> DataFrame:
    """The benchmark's value at each ts, for every entity; the benchmark is one row per ts."""
    return panel.withColumn(name, F.max(F.when(F.col("entity") == benchmark, F.col(value))).over(by_time()))


def betas(panel: DataFrame, benchmark: str, rows: int = 168) -> DataFrame:
    """(ts, entity, r1, rb, beta): covariance with the benchmark's return over its variance."""
    r = with_benchmark(panel.withColumn("r1", change(F.col("close"), 1, by_entity())), "r1", benchmark, "rb")
    w = by_entity().rowsBetween(1 - rows, 0)
    both = F.col("r1").isNotNull() & F.col("rb").isNotNull()
    enough = F.sum(both.cast("bigint")).over(w) == rows
    beta = F.covar_samp("r1", "rb").over(w) / F.nullif(F.var_samp(F.when(both, F.col("rb"))).over(w), F.lit(0.0))
    return r.select("*", F.when(enough, beta).alias("beta"))


def residual_returns(panel: DataFrame, benchmark: str, horizon: int, rows: int = 168, lag: int = 0) -> DataFrame:
    """Forward return less beta times the benchmark's forward return."""
    b = betas(panel, benchmark, rows).withColumn("forward", forward_return("close", horizon, lag))
    b = with_benchmark(b, "forward", benchmark, "bench_forward")
    return b.select("ts", "entity", "beta", "forward", (F.col("forward") - F.col("beta") * F.col("bench_forward")).alias("residual"))


def purged_split(frame: DataFrame, share: float, horizon_hours: int) -> DataFrame:
    """split: holdout for the last share of timestamps; purged where the horizon reaches into it."""
    slots = frame.select("ts").distinct().withColumn("n", F.row_number().over(Window.orderBy("ts"))).withColumn("all", F.count("*").over(Window.partitionBy()))
    size = F.greatest(F.lit(1), F.floor(F.col("all") * share + 1e-9))
    slots = slots.withColumn("start", F.max(F.when(F.col("n") == F.col("all") - size + 1, F.col("ts"))).over(Window.partitionBy()))
    split = F.when(F.col("ts") >= F.col("start"), "holdout").when(F.col("ts") + F.make_interval(hours=F.lit(horizon_hours)) < F.col("start"), "train").otherwise("purged")
    return frame.join(slots.select("ts", split.alias("split")), "ts")


def dense_hours(bars: DataFrame, entity: str) -> DataFrame:
    """One entity's close on every clock hour from its first to its last; gaps and bad prices NULL."""
    one = bars.where(F.col("entity") == entity)
    span = one.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).where("lo IS NOT NULL")
    clock = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("ts"))
    return clock.join(one.select("ts", F.when(finite(F.col("close")) > 0, F.col("close")).alias("close")), "ts", "left").withColumn("entity", F.lit(entity))


def regimes(dense: DataFrame, momentum: int = 168, volatility: int = 168, trend: int = 720) -> DataFrame:
    """Benchmark regime on the dense clock: direction and volatility against its own past median,
    which never looks ahead; ``unknown`` until all three are there."""
    w = by_entity()
    r = dense.select("ts", "entity", change(F.col("close"), momentum, w).alias("ret"), change(F.col("close"), trend, w).alias("ret_trend"), change(F.col("close"), 1, w).alias("r1"))
    r = r.withColumn("vol", full(F.stddev_samp, F.col("r1"), volatility))
    past = by_entity().rowsBetween(-trend, -1)
    r = r.withColumn("vol_reference", F.when(F.count("vol").over(past) >= volatility, F.percentile("vol", 0.5).over(past)))
    known = F.col("ret").isNotNull() & F.col("vol").isNotNull() & F.col("vol_reference").isNotNull()
    label = F.concat_ws("_", F.when(F.col("ret") >= 0, "bull").otherwise("bear"), F.when(F.col("vol") >= F.col("vol_reference"), "highvol").otherwise("lowvol"))
    bull = (F.col("ret") > 0) & (F.col("ret_trend").isNull() | (F.col("ret_trend") > -0.10))
    return r.select("ts", "ret", "ret_trend", "vol", "vol_reference", F.when(known, label).otherwise("unknown").alias("regime"), F.coalesce(bull, F.lit(False)).alias("bull"))


def listing_age(panel: DataFrame, most_days: int = 60) -> DataFrame:
    """Days since an entity's first close, at most ``most_days``."""
    first = F.min(F.when(F.col("close").isNotNull(), F.col("ts"))).over(Window.partitionBy("entity"))
    days = (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(first.cast("timestamp"))) / 86400.0
    return panel.select("ts", "entity", F.when(F.col("ts") >= first, F.least(days, F.lit(float(most_days)))).alias("listing_age_days"))
