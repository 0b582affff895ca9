"""Resampling and planning statistics."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Words of the generator's stream that one task draws at a time.
PORTION = 1 << 18


def drawn_starts(spark: SparkSession, n: int, count: int, seed: int) -> DataFrame:
    """(at, start): the first ``count`` whole numbers below ``n`` that NumPy's generator of this seed
    draws, made in tasks. Each advances the generator to its own portion of 32-bit words; a word that
    the bounded draw rejects shifts all that follow, so that accepted words are counted first."""

    def accepted(portion: int) -> np.ndarray:
        state = np.random.PCG64(seed)
        state.advance(portion * (PORTION // 2))
        words = state.random_raw(PORTION // 2).astype("<u8").view("<u4").astype(np.uint64)
        scaled = words * np.uint64(n)
        good = (scaled & np.uint64(0xFFFFFFFF)) >= np.uint64(((1 << 32) - n) % n)
        return (scaled >> np.uint64(32))[good].astype(np.int64)

    def counts(batches):  # noqa: ANN001, ANN202
        for got in batches:
            yield pd.DataFrame({"portion": got["id"], "n": [len(accepted(int(p))) for p in got["id"]]})

    if n == 1:
        return spark.range(count).select(F.col("id").alias("at"), F.lit(0).cast("bigint").alias("start"))
    portions = math.ceil(count / PORTION * 1.001) + 1 if n < 1 << 20 else 2 * math.ceil(count / PORTION) + 1
    sizes = spark.range(portions, numPartitions=portions).mapInPandas(counts, "portion bigint, n bigint").toPandas().sort_values("portion")  # a row a portion
    first = dict(zip(sizes["portion"].tolist(), (sizes["n"].cumsum() - sizes["n"]).tolist(), strict=True))

    def values(batches):  # noqa: ANN001, ANN202
        for got in batches:
            for p in got["id"]:
                start = accepted(int(p))
                at = first[int(p)] + np.arange(len(start))
                yield pd.DataFrame({"at": at[at < count], "start": start[at < count]})

    return spark.range(portions, numPartitions=portions).mapInPandas(values, "at bigint, start bigint")


def block_bootstrap(values: DataFrame, value: str, order: str, block: int = 4, draws: int = 2000, seed: int = 42, by: str | None = None) -> DataFrame:
    """Mean and 95 % interval of the mean by circular moving blocks, for each series ``by``.

    The starts are those of NumPy's generator, drawn in tasks; series of equal length share them. Sums of
    all circular blocks are made once, so that a draw joins one row a block, and the last block of a draw
    is cut to the series' length. Series are numbered within, one row a value.
    """
    spark = values.sparkSession
    key = F.col(by) if by else F.lit(0)
    w = Window.partitionBy("series")
    data = values.where(F.col(value).isNotNull()).select(key.alias("series"), F.col(value).alias("v"), F.col(order).alias("o"))
    data = data.select("series", "v", (F.row_number().over(w.orderBy("o")) - 1).cast("bigint").alias("i"), F.count("*").over(w).alias("n"))
    around = data.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).withColumn("start", F.pmod(F.col("i") - F.col("o"), F.col("n")))
    left = F.col("n") - (F.ceil(F.col("n") / block) - 1) * block  # elements of the last block
    inside = F.col("o") < F.least(F.lit(block), F.col("n"))
    sums = around.where(inside | (F.col("n") < block)).groupBy("series", "n", "start").agg(F.sum("v").alias("all"), F.sum(F.when(F.col("o") < left, F.col("v"))).alias("rest"))
    means = None
    for r in data.select("n").distinct().collect():  # the lengths of the series
        blocks = math.ceil(r.n / block)
        starts = drawn_starts(spark, r.n, draws * blocks, seed)
        hit = starts.select(F.floor(F.col("at") / blocks).alias("draw"), (F.col("at") % blocks == blocks - 1).alias("last"), "start").join(sums.where(F.col("n") == r.n), "start")
        part = hit.groupBy("series", "draw").agg((F.sum(F.when(F.col("last"), F.col("rest")).otherwise(F.col("all"))) / r.n).alias("mean"))
        means = part if means is None else means.unionAll(part)
    name = by or "series"
    if means is None:
        return spark.createDataFrame([], f"{name} {values.schema[by].dataType.simpleString() if by else 'int'}, n bigint, mean double, low double, high double")
    bounds = means.groupBy("series").agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    plain = data.groupBy("series").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    return plain.join(bounds, "series").select(F.col("series").alias(name), "n", "mean", "low", "high")


def block_variance(values: DataFrame, value: str, order: str, length: int) -> DataFrame:
    """Variance of circular block sums over the block length."""
    d = values.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), (F.row_number().over(Window.orderBy(order)) - 1).alias("i"))
    d = d.withColumn("n", F.count("*").over(Window.partitionBy()))
    spread = d.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("start", F.pmod(F.col("i") - F.col("o"), F.col("n")))
    return spread.groupBy("start").agg(F.sum("v").alias("total")).agg((F.var_samp("total") / length).alias("variance"))


def power_table(values: DataFrame, value: str, order: str, effects: tuple[float, ...] = (0.1, 0.25, 0.5), alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Windows needed to see an effect, from the largest of the plain and the block variances."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    plain = values.agg(F.var_samp(value).alias("variance"))
    variance = plain.unionByName(block_variance(values, value, order, 4)).unionByName(block_variance(values, value, order, 8)).agg(F.max("variance").alias("variance"))
    grid = values.sparkSession.createDataFrame([(e, m) for e in effects for m in (1.0, 1.5, 2.0)], "effect double, multiplier double")
    n = F.greatest(F.lit(8), F.ceil(F.lit(z * z) * F.col("variance") * F.col("multiplier") / (F.col("effect") * F.col("effect"))))
    return grid.crossJoin(variance).withColumn("n_windows", (F.ceil(n / 4) * 4).cast("bigint")).withColumn("calendar_days", F.ceil(F.col("n_windows") / 3.6).cast("bigint"))


def trial_groups(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Mean and number of the values by regime, by thirds of the trial (of its distinct ``order``, which
    is as long as the calendar) and by hour of day."""
    thirds = rows.select(order).distinct().withColumn("third", F.ntile(3).over(Window.orderBy(order)).cast("string"))
    named = rows.join(thirds, order).withColumn("group", F.explode(F.array(F.concat(F.lit("regime:"), F.col("regime")), F.concat(F.lit("third:"), F.col("third")), F.concat(F.lit("hour:"), F.hour("ts").cast("string")))))
    return named.groupBy("group").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def attribution(picks: DataFrame, value: str) -> DataFrame:
    """Each name's part of the mean basket result: contributions sum to the mean of slot means."""
    size = F.count("*").over(Window.partitionBy("ts"))
    slots = picks.select("ts").distinct().agg(F.count("*").alias("slots"))
    part = picks.withColumn("part", F.col(value) / size)
    return part.groupBy("entity").agg(F.sum("part").alias("part"), F.count("*").alias("n")).crossJoin(slots).select("entity", "n", (F.col("part") / F.col("slots")).alias("contribution"))
