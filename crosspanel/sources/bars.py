"""Bars (ts, entity, open, high, low, close, volume) derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.sources.tables import table


def hourly(spark: SparkSession, sf_dir: str, entities: int = 10, venue: int | None = None) -> DataFrame:
    """Hourly bars of ``events``: users in ten groups; ``venue`` takes the events of one parity."""
    e = table(spark, sf_dir, "events")
    e = e.where(F.col("event_id") % 2 == venue) if venue is not None else e
    order = F.struct("ts", "event_id")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), (F.col("user_id") % entities).cast("string").alias("entity")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume")
    ).withColumnRenamed("hour", "ts")


def traded(spark: SparkSession, sf_dir: str, unit: str = "week", entities: int = 40, venue: int | None = None) -> DataFrame:
    """Weekly or daily bars of ``lineitem``: parts in forty groups, price per piece."""
    li = table(spark, sf_dir, "lineitem")
    li = li.where(F.col("l_linenumber") % 2 == venue) if venue is not None else li
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return li.groupBy(F.date_trunc(unit, "l_shipdate").cast("timestamp_ntz").alias("ts"), (F.col("l_partkey") % entities).cast("string").alias("entity")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum("l_quantity").alias("volume")
    )
