"""Calibration of scores into expected outcomes, and the predictions made with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.columns import by_entity, by_time, change

#: Lower bounds of the buckets of absolute score in batch deviations; each ends where the next begins.
BOUNDS = (0.0, 0.5, 1.0, 1.5, 2.0)


def sigma(score: str) -> Column:
    """Absolute score in deviations of its timestamp's whole batch."""
    return F.abs(score) / F.nullif(F.stddev_samp(score).over(by_time()), F.lit(0.0))


def bucket(value: Column, bounds: tuple[float, ...] = BOUNDS) -> Column:
    out = F.lit(None).cast("int")
    for i, low in enumerate(bounds):
        out = F.when(value >= low, i).otherwise(out)
    return out


def calibrate(samples: DataFrame, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """Outcomes per bucket of sigma. ``samples``: ts, score, ret; deviations count the whole batch,
    also rows whose return is missing. A score of zero hits only a return of zero."""
    s = samples.where("score IS NOT NULL").withColumn("sigma", sigma("score")).where("ret IS NOT NULL AND sigma IS NOT NULL").withColumn("bucket", bucket(F.col("sigma"), bounds))
    hit = (F.signum("score") == F.signum("ret")).cast("double")
    return s.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(hit).alias("hit_rate"), (100 * F.avg(F.signum("score") * F.col("ret"))).alias("mean_signed_pct"), (100 * F.avg(F.abs("ret"))).alias("mean_abs_pct"), (100 * F.coalesce(F.stddev_samp("ret"), F.lit(0.0))).alias("std_pct"))


def realized_volatility(panel: DataFrame, horizon: int, rows: int = 72) -> DataFrame:
    """Population deviation of the last ``rows`` returns of each entity, scaled to the horizon."""
    r = panel.select("ts", "entity", change(F.col("close"), 1, by_entity()).alias("r"))
    back = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("ts")))
    return r.withColumn("back", back).where(F.col("back") <= rows).groupBy("entity").agg((F.stddev_pop("r") * horizon**0.5).alias("volatility"))


def predict(scores: DataFrame, calibration: DataFrame, volatility: DataFrame) -> DataFrame:
    """Direction, sigma, tier and size, expected outcome and its 95 % band for each score of one
    batch. The band comes from the entity's own volatility, else from the bucket's spread."""
    s = scores.where("score IS NOT NULL").withColumn("sigma", F.abs("score") / F.nullif(F.stddev_samp("score").over(Window.partitionBy()), F.lit(0.0))).where("sigma IS NOT NULL")  # one batch: one row an entity
    s = s.withColumn("bucket", bucket(F.col("sigma"))).join(F.broadcast(calibration.drop("n")), "bucket", "left").join(volatility, "entity", "left")
    direction = F.when(F.col("score") > 0, 1).otherwise(-1)
    expected = direction * F.col("mean_signed_pct")
    spread = F.coalesce(F.col("volatility") * 100, F.col("std_pct"))
    tier = F.when(F.col("sigma") >= 2, "strong").when(F.col("sigma") >= 1, "normal").when(F.col("sigma") >= 0.5, "weak").otherwise("noise")
    size = F.when(F.col("sigma") >= 2, 3.0).when(F.col("sigma") >= 1, 2.0).when(F.col("sigma") >= 0.5, 1.0).otherwise(0.0)
    return s.select("entity", "score", direction.alias("direction"), "sigma", tier.alias("tier"), size.alias("size_pct"), F.col("hit_rate").alias("direction_prob"), expected.alias("expected_pct"), (expected - 1.96 * spread).alias("ci_low"), (expected + 1.96 * spread).alias("ci_high"))


def consensus(one: DataFrame, two: DataFrame) -> DataFrame:
    """``one`` with a flag: the other model predicts the same direction for the entity, not zero."""
    other = two.select("entity", F.col("direction").alias("_other"))
    return one.join(other, "entity", "left").withColumn("consensus", F.coalesce((F.col("direction") == F.col("_other")) & (F.col("direction") != 0), F.lit(False))).drop("_other")
