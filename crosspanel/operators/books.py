"""Order books, funding and quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consumed(levels: Column, quantity: Column) -> Column:
    """Value of taking ``quantity`` from the levels (array of price, size) in order; NULL if they do
    not suffice."""

    def take(state: Column, level: Column) -> Column:
        part = F.least(state["left"], level["size"])
        return F.struct((state["left"] - part).alias("left"), (state["value"] + part * level["price"]).alias("value"))

    start = F.struct(quantity.cast("double").alias("left"), F.lit(0.0).alias("value"))
    return F.aggregate(levels, start, take, lambda s: F.when(s["left"] <= quantity * 1e-12, s["value"]))


def well_formed(levels: Column, descending: bool) -> Column:
    """1 to 50 levels, all positive, prices strictly ordered."""
    pairs = F.zip_with(F.slice(levels, 1, F.size(levels) - 1), F.slice(levels, 2, F.size(levels)), lambda a, b: (a["price"] > b["price"]) if descending else (a["price"] < b["price"]))
    return F.size(levels).between(1, 50) & F.forall(levels, lambda x: (x["price"] > 0) & (x["size"] > 0)) & F.forall(pairs, lambda ok: ok)


def depth_cost(books: DataFrame, notional: float, fee_bps: float) -> DataFrame:
    """Net result of a short of ``notional``: sold into the entry bids, bought back from the exit
    asks. ``books``: key, bids, asks."""
    bid, ask = F.element_at("bids", 1)["price"], F.element_at("asks", 1)["price"]
    b = books.withColumn("quantity", notional / bid)
    b = b.withColumn("proceeds", consumed(F.col("bids"), F.col("quantity"))).withColumn("expense", consumed(F.col("asks"), F.col("quantity")))
    gross = 1 - F.col("expense") / F.col("proceeds")
    valid = well_formed(F.col("bids"), True) & well_formed(F.col("asks"), False)
    status = F.when(~valid, "invalid").when(gross.isNull(), "insufficient_depth").otherwise("evaluated")
    ok = status == "evaluated"
    return b.select("key", status.alias("status"), F.when(ok, 100 * (gross - fee_bps / 10_000)).alias("net_pct"), F.when(ok, 10_000 * (1 - ask / bid - gross)).alias("additional_bps"), F.when(ok, F.col("proceeds") / F.col("quantity")).alias("entry_vwap"), F.when(ok, F.col("expense") / F.col("quantity")).alias("exit_vwap"))


def overlapping(spans: DataFrame, points: DataFrame, by: str, seconds: int) -> DataFrame:
    """Rows of ``spans`` (by, lo, hi, ...) joined with those of ``points`` (by, from_at, to_at, ...) whose
    intervals overlap, as a struct column ``point``.

    Time is cut into buckets of ``seconds``; both sides go to every bucket that they touch, and a pair
    counts in the first bucket that both have, so that it is met once. Rows met grow with what overlaps,
    as long as intervals are of the order of a bucket; a null end leaves an interval out.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / seconds)
    left = spans.withColumn("_bucket", F.explode(F.sequence(bucket("lo"), bucket("hi"))))
    right = points.select(by, F.struct(*points.columns).alias("point"), F.explode(F.sequence(bucket("from_at"), bucket("to_at"))).alias("_bucket"))
    first = F.greatest(bucket("lo"), bucket("point.from_at")) == F.col("_bucket")
    return left.join(right, [by, "_bucket"]).where(first & (F.col("lo") <= F.col("point.to_at")) & (F.col("point.from_at") <= F.col("hi"))).drop("_bucket")


def funding(held: DataFrame, rates: DataFrame, most_gap_hours: int, boundary_seconds: int) -> DataFrame:
    """Sum of the rates in (entry, exit] of each position (key, entity, entry_at, exit_at), with a
    status: unbracketed if the history does not surround it, gap if rates are too far apart,
    boundary_uncertain if a settlement is too near to either end."""
    w = Window.partitionBy("entity").orderBy("at")
    r = rates.select("entity", "at", "rate", F.lead("at").over(w).alias("next_at"))
    span = r.groupBy("entity").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    seconds = lambda a, b: F.abs(F.unix_timestamp(a.cast("timestamp")) - F.unix_timestamp(b.cast("timestamp")))
    margin = F.make_interval(secs=F.lit(boundary_seconds))
    wide = held.where(F.col("entry_at") <= F.col("exit_at")).select("key", "entity", "entry_at", "exit_at", (F.col("entry_at") - margin).alias("lo"), (F.col("exit_at") + margin).alias("hi"))
    gap = seconds(F.col("next_at"), F.col("at")) > most_gap_hours * 3600
    settled = r.select("entity", F.col("at").alias("from_at"), F.col("at").alias("to_at"), "at", "rate", F.lit(False).alias("gap"))
    gaps = r.where(gap).select("entity", F.col("at").alias("from_at"), F.col("next_at").alias("to_at"), F.lit(None).cast(r.schema["at"].dataType).alias("at"), F.lit(None).cast("double").alias("rate"), F.lit(True).alias("gap"))
    size = max(3600, most_gap_hours * 3600)
    j = overlapping(wide, settled.unionAll(gaps), "entity", size).select("key", "entry_at", "exit_at", "point.*")
    inside = (F.col("at") > F.col("entry_at")) & (F.col("at") <= F.col("exit_at"))
    overlaps = F.col("gap") & (F.col("from_at") < F.col("exit_at")) & (F.col("to_at") > F.col("entry_at"))
    edge = F.least(seconds(F.col("at"), F.col("entry_at")), seconds(F.col("at"), F.col("exit_at"))) <= boundary_seconds
    g = j.groupBy("key").agg(F.sum(F.when(inside, F.col("rate"))).alias("rate_sum"), F.count(F.when(inside, 1)).alias("n"), F.max(overlaps.cast("int")).alias("gap"), F.max(edge.cast("int")).alias("edge"))
    out = held.join(span, "entity", "left").join(g, "key", "left")
    bracketed = (F.col("first_at") <= F.col("entry_at")) & (F.col("exit_at") <= F.col("last_at"))
    status = F.when(~F.coalesce(bracketed, F.lit(False)), "unbracketed").when(F.col("gap") == 1, "gap").when(F.col("edge") == 1, "boundary_uncertain").otherwise("observed")
    return out.select("key", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"), F.when(status == "observed", F.coalesce("rate_sum", F.lit(0.0)) * 10_000).alias("rate_sum_bps"))


def quote_checks(quotes: DataFrame) -> DataFrame:
    """One row for each rule that a quote (key, bid, ask, bid_size, ask_size) breaks."""
    rules = {"bid": ~(F.col("bid") > 0), "ask": ~(F.col("ask") > 0), "crossed": F.col("bid") > F.col("ask"), "size": ~((F.col("bid_size") > 0) & (F.col("ask_size") > 0))}
    return quotes.withColumn("rule", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in rules.items()]))))
