"""Evaluation of scores: rank correlation per timestamp, decay, stability, drift, gates, baskets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.columns import average_rank, by_time, correlation, t_stat
from crosspanel.sources.tables import kept_table


def rank_ic(frame: DataFrame, score: str, target: str, keys: tuple[str, ...] = ("ts",), least: int = 5, distinct: int = 1) -> DataFrame:
    """Spearman correlation of score and target for each key: keys, n, ic. NULL with fewer than
    ``distinct`` values on a side; keys with fewer than ``least`` rows are left out."""
    rows = frame.where(F.col(score).isNotNull() & F.col(target).isNotNull()).select(*keys, F.col(score).alias("s"), F.col(target).alias("t"))
    ranked = rows.select(*keys, "s", "t", average_rank("s", *keys).alias("rs"), average_rank("t", *keys).alias("rt"))
    ic = F.when((F.count_distinct("s") >= distinct) & (F.count_distinct("t") >= distinct), correlation("rs", "rt")) if distinct > 1 else correlation("rs", "rt")
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), ic.alias("ic")).where(F.col("n") >= least)


def pooled_ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the average rank of ``column`` over all of them: ranges of values are dealt out and
    written, ranked within, and shifted by the rows of the ranges before. Equal values share a range; the
    driver sees a count for each range."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept_table(rows.repartitionByRange(ranges, column).withColumn("_range", F.spark_partition_id()), "ranks")
    before, shifts = 0, []
    for r in sorted(dealt.groupBy("_range").count().collect(), key=lambda r: r["_range"]):
        shifts.append((r["_range"], before))
        before += r["count"]
    table = rows.sparkSession.createDataFrame(shifts, "_range int, _before bigint")
    return dealt.join(F.broadcast(table), "_range").withColumn(name, F.col("_before") + average_rank(column, "_range")).drop("_range", "_before")


def pooled_ic(frame: DataFrame, score: str, target: str) -> DataFrame:
    """n and Spearman correlation of score and target over all rows together."""
    rows = frame.where(F.col(score).isNotNull() & F.col(target).isNotNull()).select(F.col(score).alias("s"), F.col(target).alias("t"))
    return pooled_ranks(pooled_ranks(rows, "s", "rs"), "t", "rt").agg(F.count("*").alias("n"), correlation("rs", "rt").alias("ic"))


def summary(ics: DataFrame, *by: str) -> DataFrame:
    """Mean, spread, t and number of an IC series."""
    return ics.where("ic IS NOT NULL").groupBy(*by).agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), t_stat("ic").alias("t_stat"), F.count("*").alias("n"))


def decay(frame: DataFrame, score: str, targets: dict[int, str], least: int = 5) -> DataFrame:
    """IC summary at several horizons, in one pass: the frame is unpivoted, not rerun."""
    pairs = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).alias("target")) for h, c in targets.items()])).alias("p")
    long = frame.select("ts", "entity", F.col(score).alias("score"), pairs).select("ts", "score", "p.*")
    return summary(rank_ic(long, "score", "target", ("horizon", "ts"), least), "horizon")


def best_horizon(decayed: DataFrame) -> DataFrame:
    """The horizon of largest absolute mean IC (the shorter one on ties)."""
    return decayed.agg(F.max_by("horizon", F.struct(F.abs("mean_ic"), -F.col("horizon"))).alias("horizon"), F.max(F.abs("mean_ic")).alias("abs_ic"))


def factor_ics(frame: DataFrame, factors: list[str], target: str, least: int = 10, distinct: int = 2) -> DataFrame:
    """(factor, ts, n, ic) of many factors by one unpivot and one grouping."""
    long = frame.select("ts", "entity", target, *factors).unpivot(["ts", "entity", target], factors, "factor", "value")
    return rank_ic(long, "value", target, ("factor", "ts"), least, distinct)


def sign(x: Column) -> Column:
    return F.coalesce(F.signum(x), F.lit(0.0))


def rolling_tag(rolling_ic: Column, rolling_t: Column, full_ic: Column) -> Column:
    flip = (sign(rolling_ic) != 0) & (sign(full_ic) != 0) & (sign(rolling_ic) != sign(full_ic))
    return F.when(flip, "FLIP").when((F.abs(rolling_ic) > 0.05) & (F.abs(rolling_t) > 1.5), "FRESH").when((full_ic != 0) & (F.abs(rolling_ic) < F.abs(full_ic) / 2), "STALE").otherwise("")


def gate_label(mean_ic: Column, t: Column) -> Column:
    return F.when((F.abs(mean_ic) > 0.05) & (F.abs(t) > 1.5), "PASS").when(F.abs(mean_ic) > 0.02, "WEAK").otherwise("FAIL")


def stability_tag(full: Column, first: Column, second: Column) -> Column:
    f, a, b = sign(full), sign(first), sign(second)
    return (
        F.when((a != 0) & (b != 0) & (a != b), "FLIP")
        .when((f != 0) & (((a != 0) & (a != f)) | ((b != 0) & (b != f))), "DRIFT")
        .when(second.isNotNull() & (F.abs(second) < F.abs(full) / 2), "DECAY")
        .otherwise("STABLE")
    )


def rolling(ics: DataFrame, last: int, *by: str) -> DataFrame:
    """IC over the last ``last`` timestamps against all of them, tagged."""
    recent = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ts"))) <= last
    r = ics.where("ic IS NOT NULL").withColumn("recent", F.when(recent, F.col("ic")))
    out = r.groupBy(*by).agg(F.avg("recent").alias("rolling_ic"), t_stat("recent").alias("rolling_t"), F.avg("ic").alias("full_ic"), t_stat("ic").alias("full_t"))
    return out.withColumn("tag", rolling_tag(F.col("rolling_ic"), F.col("rolling_t"), F.col("full_ic"))).withColumn("gate", gate_label(F.col("full_ic"), F.col("full_t")))


def halves(ics: DataFrame, *by: str) -> DataFrame:
    """IC of the first and second half of the timestamps, and a stability tag."""
    w = Window.partitionBy(*by)
    r = ics.where("ic IS NOT NULL").withColumn("half", F.when(F.row_number().over(w.orderBy("ts")) <= F.greatest(F.lit(1), F.ceil(F.count("*").over(w) / 2)), 1).otherwise(2))
    out = r.groupBy(*by).agg(F.avg("ic").alias("full_ic"), F.avg(F.when(F.col("half") == 1, F.col("ic"))).alias("first_ic"), F.avg(F.when(F.col("half") == 2, F.col("ic"))).alias("second_ic"), F.count("*").alias("n"))
    return out.withColumn("tag", stability_tag(F.col("full_ic"), F.col("first_ic"), F.col("second_ic")))


def drift(ics: DataFrame, recent: int = 24, least: int = 10) -> DataFrame:
    """For each factor: mean IC of the last ``recent`` slots against that of all, and a status."""
    r = ics.where("ic IS NOT NULL").withColumn("back", F.row_number().over(Window.partitionBy("factor").orderBy(F.desc("ts"))))
    g = r.groupBy("factor").agg(F.avg(F.when(F.col("back") <= recent, F.col("ic"))).alias("ic_recent"), F.avg("ic").alias("ic_all"), F.count("*").alias("n_slots"))
    drop = F.when(F.abs("ic_all") < 1e-6, 0.0).otherwise(1 - F.abs("ic_recent") / F.nullif(F.abs("ic_all"), F.lit(0.0)))
    flipped = (F.col("ic_recent") * F.col("ic_all") < 0) & (F.abs("ic_all") > 0.02)
    status = F.when(F.col("n_slots") < least, "insufficient_data").when(flipped, "SIGN_FLIP").when(drop > 0.5, "DRIFT").otherwise("OK")
    return g.select("factor", "ic_recent", "ic_all", "n_slots", (drop * 100).alias("drop_pct"), status.alias("status"))


def tail_gate(ics: DataFrame, freeze: float, warn: float, lookback: int = 7, *by: str) -> DataFrame:
    """State of the IC gate from the run of low values at the end of the series."""
    r = ics.where("ic IS NOT NULL").withColumn("back", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ts"))))
    last_ok = F.min(F.when(F.col("ic") >= freeze, F.col("back")))
    g = r.groupBy(*by).agg(F.coalesce(last_ok - 1, F.count("*")).alias("trailing_low"), F.min(F.when(F.col("back") <= lookback, F.col("ic"))).alias("least_recent"), F.max_by("ic", "ts").alias("last_ic"))
    status = F.when(F.col("trailing_low") >= 3, "LIQUIDATE").when(F.col("trailing_low") >= 2, "FREEZE").when(F.col("least_recent") < F.greatest(F.lit(freeze), F.lit(warn)), "WARN").otherwise("OK")
    return g.withColumn("status", status)


def score_diagnostics(scores: DataFrame, long_n: int, short_n: int) -> DataFrame:
    """Separation of the scores at each timestamp: spread, top-bottom gap, gaps at the cuts."""
    w = by_time()
    r = scores.where("score IS NOT NULL").withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "entity"))).withColumn("n", F.count("*").over(w))

    def at(place: Column) -> Column:
        return F.max(F.when(F.col("place") == place, F.col("score")))

    g = r.groupBy("ts").agg(
        F.first("n").alias("n"), F.stddev_samp("score").alias("score_std"),
        (F.avg(F.when(F.col("place") <= long_n, F.col("score"))) - F.avg(F.when(F.col("place") > F.col("n") - short_n, F.col("score")))).alias("top_bottom_gap"),
        F.when(F.first("n") > long_n, at(F.lit(long_n)) - at(F.lit(long_n + 1))).alias("long_cut_gap"),
        F.when(F.first("n") > short_n, at(F.col("n") - short_n) - at(F.col("n") - short_n + 1)).alias("short_cut_gap"),
    )
    spread = F.nullif(F.col("score_std"), F.lit(0.0))
    return g.select("*", *[(F.col(c) / spread).alias(f"{c}_z") for c in ("top_bottom_gap", "long_cut_gap", "short_cut_gap")])


def ic_contributions(frame: DataFrame, score: str, target: str) -> DataFrame:
    """(ts, entity, contribution): products of centred ranks that sum to the IC of the timestamp."""
    w = by_time()
    rows = frame.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    r = rows.select("ts", "entity", average_rank(score, "ts").alias("rs"), average_rank(target, "ts").alias("rt"))
    both = (F.col("rs") - F.avg("rs").over(w)) * (F.col("rt") - F.avg("rt").over(w))
    return r.select("ts", "entity", (both / F.nullif(F.stddev_pop("rs").over(w) * F.stddev_pop("rt").over(w) * F.count("*").over(w), F.lit(0.0))).alias("contribution"))


def monthly(ics: DataFrame) -> DataFrame:
    """IC by month, labelled with the month's last day."""
    return summary(ics.withColumn("month", F.last_day(F.to_date("ts"))), "month")


def stability_audit(rows: DataFrame) -> DataFrame:
    """(part, n, mean_ic, std_ic, positive) of a walk-forward's IC (ts, retrain, ic) over all slots, by
    fold, by half (the first n // 2 slots and the rest) and by month, in one grouping."""
    known = rows.where("ic IS NOT NULL")
    calendar = known.select("ts").distinct().withColumn("nth", F.row_number().over(Window.orderBy("ts"))).withColumn("slots", F.count("*").over(Window.partitionBy()))  # a row for each slot
    half = F.when(F.col("nth") <= F.floor(F.col("slots") / 2), "half:first").otherwise("half:second")
    parts = F.array(F.lit("all"), F.concat(F.lit("fold:"), F.col("retrain").cast("string")), half, F.concat(F.lit("month:"), F.date_format(F.last_day(F.to_date("ts")), "yyyy-MM-dd")))
    named = known.join(calendar, "ts").select("ic", F.explode(parts).alias("part"))
    return named.groupBy("part").agg(F.count("*").alias("n"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"))


def autocorrelation(values: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, spread, plain and autocorrelation-corrected t of a series ordered by ts; the effective
    number is kept between 1 and n."""
    w = Window.partitionBy(*by)
    r = values.where(F.col(value).isNotNull()).withColumn("d", F.col(value) - F.avg(value).over(w))
    r = r.withColumn("prev", F.lag("d").over(w.orderBy("ts")))
    g = r.groupBy(*by).agg(F.count("*").alias("n"), F.max_by(value, "ts").alias("last"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.sum(F.col("d") * F.col("prev")).alias("num"), F.sum(F.col("d") * F.col("d")).alias("den"), F.avg((F.round(value, 12) < 0).cast("double")).alias("neg"))
    rho = F.when((F.col("n") >= 3) & (F.col("den") > 0), F.col("num") / F.nullif(F.col("den"), F.lit(0.0)))
    g = g.withColumn("lag1", rho)
    usable = (F.abs("lag1") < 1) & (F.col("std") > 0)
    g = g.withColumn("n_eff", F.when(usable, F.least(F.greatest(F.col("n") * (1 - F.col("lag1")) / (1 + F.col("lag1")), F.lit(1.0)), F.col("n").cast("double"))))
    spread = F.nullif(F.col("std"), F.lit(0.0))
    return g.select(*by, "n", "last", "mean", "std", (F.col("mean") / (spread / F.sqrt("n"))).alias("tstat"), (F.col("mean") / (spread / F.sqrt("n_eff"))).alias("tstat_ac"), "lag1", "n_eff", (100 * F.col("neg")).alias("neg_pct"))
