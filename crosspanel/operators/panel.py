"""Panel construction: grid, forward fill, coverage, universe, warm-up, anchors, preflight."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.columns import by_entity, by_time, full
from crosspanel.operators.chains import carried

FIELDS = ("open", "high", "low", "close", "volume")


def grid(bars: DataFrame) -> DataFrame:
    """Every ts that any entity has, for every entity. The list of entities is what is broadcast:
    it grows with the universe, not with time."""
    return bars.select("ts").distinct().crossJoin(bars.select("entity").distinct())


def forward_filled(bars: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Bars on the grid, each field filled forward, never back."""
    w = by_entity().rowsBetween(Window.unboundedPreceding, 0)
    return grid(bars).join(bars, ["ts", "entity"], "left").select("ts", "entity", *[F.last(f, ignorenulls=True).over(w).alias(f) for f in fields])


def complete(panel: DataFrame, coverage: float = 1.0) -> DataFrame:
    """Rows of entities whose filled close is there on at least this share of the grid."""
    share = F.avg(F.col("close").isNotNull().cast("double")).over(Window.partitionBy("entity"))
    return panel.withColumn("_share", share).where(F.col("_share") >= coverage).drop("_share")


def ordinal(panel: DataFrame) -> DataFrame:
    """The panel's timestamps, numbered from 1. Timestamps are few: one window over them is small."""
    return panel.select("ts").distinct().withColumn("ordinal", F.row_number().over(Window.orderBy("ts")))


def warmed(panel: DataFrame, rows: int) -> DataFrame:
    """Without the first ``rows`` timestamps of the grid."""
    return panel.join(ordinal(panel).where(F.col("ordinal") > rows).select("ts"), "ts", "left_semi")


def traded_value(rows: int = 24) -> Column:
    return full(F.sum, F.col("close") * F.col("volume"), rows)


def liquid_universe(panel: DataFrame, top: int, rows: int = 24) -> DataFrame:
    """(ts, entity, traded_value, liquidity_rank) of the ``top`` entities by traded value over
    ``rows`` rows; all with a value if ``top`` is not positive. Ties go by name."""
    valued = panel.select("ts", "entity", traded_value(rows).alias("traded_value")).where("traded_value IS NOT NULL")
    ranked = valued.withColumn("liquidity_rank", F.row_number().over(by_time().orderBy(F.desc("traded_value"), "entity")))
    return ranked.where(F.col("liquidity_rank") <= top) if top > 0 else ranked


def coverage(universe: DataFrame) -> DataFrame:
    """Average, least and most entities at a timestamp."""
    return universe.groupBy("ts").count().agg(F.avg("count").alias("avg_n"), F.min("count").alias("min_n"), F.max("count").alias("max_n"), F.count("*").alias("n_ts"))


def within(frame: DataFrame, universe: DataFrame) -> DataFrame:
    return frame.join(universe.select("ts", "entity"), ["ts", "entity"], "left_semi")


def anchored(ts: str, hours: tuple[int, ...]) -> Column:
    """Whether a timestamp is exactly one of the anchor hours."""
    return F.hour(ts).isin(*hours) & (F.col(ts) == F.date_trunc("hour", ts).cast("timestamp_ntz"))


def non_overlapping(slots: DataFrame, hours: int) -> DataFrame:
    """Greedy choice of slots (ts): each at least ``hours`` after the last one chosen, which is all
    that is remembered."""
    gap = timedelta(hours=hours)

    def step(last, slot):  # noqa: ANN001, ANN202
        ts = slot["ts"]
        return (ts, [(ts,)]) if last is None or ts >= last + gap else (last, [])

    kind = slots.schema["ts"].dataType.simpleString()
    return carried(slots.select("ts").where("ts IS NOT NULL").distinct(), [], ["ts"], step, f"ts {kind}")


def every(frame: DataFrame, step: int) -> DataFrame:
    """Rows at every ``step``-th timestamp."""
    return frame.join(ordinal(frame).where((F.col("ordinal") - 1) % step == 0).select("ts"), "ts", "left_semi")


def neutral(frame: DataFrame, factors: list[str], target: str) -> DataFrame:
    """Missing factors become 0; rows without a target or with nothing but zeros go."""
    filled = frame.where(F.col(target).isNotNull()).fillna(0.0, factors)
    return filled.where(F.greatest(*[F.abs(F.col(f)) for f in factors], F.lit(0.0)) > 0)


def volume_universe(bars: DataFrame, least: float, benchmark: str) -> DataFrame:
    """Entities whose median daily volume reaches ``least``, and always the benchmark."""
    daily = bars.groupBy("entity", F.to_date("ts").alias("day")).agg(F.sum("volume").alias("volume"))
    return daily.groupBy("entity").agg(F.percentile("volume", 0.5).alias("median_volume")).where((F.col("median_volume") >= least) | (F.col("entity") == benchmark))


def null_shares(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Percentage of nulls of each column, with a status: WARN over half, EXPECTED if any."""
    shares = frame.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in columns])
    long = shares.unpivot([], columns, "feature", "null_pct")
    return long.withColumn("status", F.when(F.col("null_pct") > 50, "WARN").when(F.col("null_pct") > 0, "EXPECTED").otherwise("OK"))


def churn(universe: DataFrame, least_previous: int = 50) -> DataFrame:
    """Entities added and removed at each timestamp against the one before, and their share; no
    share if the universe before had fewer than ``least_previous``."""
    slots = ordinal(universe)
    now = universe.join(slots, "ts").select("entity", "ordinal")
    before = now.select("entity", (F.col("ordinal") + 1).alias("ordinal"), F.lit(1).alias("was"))
    both = now.withColumn("is", F.lit(1)).join(before, ["entity", "ordinal"], "full").groupBy("ordinal").agg(
        F.count("is").alias("n_now"), F.count("was").alias("n_before"), F.sum((F.col("is").isNotNull() & F.col("was").isNull()).cast("bigint")).alias("added"), F.sum((F.col("is").isNull() & F.col("was").isNotNull()).cast("bigint")).alias("removed")
    )
    share = F.when(F.col("n_before") >= least_previous, F.greatest("added", "removed") / F.nullif(F.col("n_now"), F.lit(0)))
    return both.join(slots, "ordinal").select("ts", "n_now", "n_before", "added", "removed", share.alias("churn"))


def membership_changes(universe: DataFrame) -> DataFrame:
    """Who came, who went and how many stayed at each timestamp against the one before: ts, added,
    removed (sorted names), n_common. At the first timestamp all come."""
    slots = ordinal(universe)
    now = universe.select("ts", "entity").distinct().join(slots, "ts").select("entity", "ordinal", F.lit(1).alias("is"))
    before = now.select("entity", (F.col("ordinal") + 1).alias("ordinal"), F.lit(1).alias("was"))
    names = lambda there, missing: F.array_sort(F.collect_list(F.when(F.col(there).isNotNull() & F.col(missing).isNull(), F.col("entity"))))
    both = now.join(before, ["entity", "ordinal"], "full").groupBy("ordinal").agg(names("is", "was").alias("added"), names("was", "is").alias("removed"), F.count_if(F.col("is").isNotNull() & F.col("was").isNotNull()).alias("n_common"))
    return both.join(slots, "ordinal").select("ts", "added", "removed", "n_common")
