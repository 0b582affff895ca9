"""Roll-ups of a forecast's life: what was due, recorded, delivered, evaluated, compared, quoted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.columns import finite
from crosspanel.operators.evaluation import rank_ic


def _later(c: Column | str, minutes: int) -> Column:
    return (F.col(c) if isinstance(c, str) else c) + F.make_interval(mins=F.lit(minutes))


def audit_windows(slots: DataFrame, signals: DataFrame, outcomes: DataFrame, comparisons: DataFrame, deliveries: DataFrame, errors: DataFrame, now: Column, grace_minutes: int = 45, deadline_hours: int = 55, warn: float = 0.03) -> DataFrame:
    """A row for each slot that was due: how far its forecast came.

    ``signals``: slot, status (recorded, missed), n_names; ``outcomes``: slot, status (evaluated,
    invalid), reason, saved_ic; ``comparisons``: slot, legacy_ic, measured; ``deliveries``: slot, complete
    (several rows a slot: one is enough); ``errors``: slot (null: all slots), stage (signal, history,
    history_row, comparison, measurement). Of the first three one row a slot is expected.
    """
    everywhere = errors.where("slot IS NULL").agg(F.collect_set("stage").alias("_all"))  # one row
    stages = errors.where("slot IS NOT NULL").groupBy("slot").agg(F.collect_set("stage").alias("_own"))
    sent = deliveries.groupBy("slot").agg(F.max("complete").alias("_sent"))
    w = slots.select("slot").distinct()
    w = w.join(signals.select("slot", F.col("status").alias("_signal"), "n_names"), "slot", "left").join(outcomes.select("slot", F.col("status").alias("_outcome"), "reason", "saved_ic"), "slot", "left")
    w = w.join(comparisons.select("slot", "legacy_ic", "measured"), "slot", "left").join(sent, "slot", "left").join(stages, "slot", "left").crossJoin(everywhere)
    found = F.array_union("_all", F.coalesce("_own", F.array().cast("array<string>")))
    failed = lambda *names: F.arrays_overlap(found, F.array(*[F.lit(n) for n in names]))
    overdue = now > _later("slot", deadline_hours * 60)
    reach = lambda broken, there: F.when(broken, "error").when(there, "available").when(overdue, "missing").otherwise("waiting")
    legacy = reach(failed("history", "history_row", "comparison"), F.col("legacy_ic").isNotNull())
    measurement = reach(failed("measurement"), F.coalesce("measured", F.lit(False)))
    gap = F.col("saved_ic") - F.col("legacy_ic")
    return w.select(
        "slot", F.coalesce("_outcome", "_signal", F.when(failed("signal"), "source_error").otherwise("awaiting_signal")).alias("status"), F.coalesce("_signal", F.lit("")).alias("signal"), "reason", "saved_ic", F.coalesce("n_names", F.lit(0)).alias("n_names"),
        "legacy_ic", gap.alias("difference"), F.coalesce(F.abs(gap) >= warn, F.lit(False)).alias("warns"), legacy.alias("legacy_status"), measurement.alias("measurement_status"),
        F.when((legacy == "error") | (measurement == "error"), "error").otherwise(legacy).alias("comparison_status"),
        F.when(F.coalesce("_sent", F.lit(False)), "verified").when(now <= _later("slot", grace_minutes), "waiting").otherwise("unverified").alias("delivery"),
        (_later("slot", grace_minutes) < now).alias("closed"), (F.size(found) > 0).alias("faulty"),
    )


def audit_summary(windows: DataFrame) -> DataFrame:
    """One row over :func:`audit_windows`: counts, the mean IC of what was evaluated, the operational
    issues and a status, attention if there is any."""
    evaluated = F.col("status") == "evaluated"
    of = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    last = lambda value, where: F.max_by(F.when(where, value), F.when(where, F.col("slot")))
    done = F.col("status").isin("evaluated", "invalid")
    out = windows.agg(
        F.count("*").alias("scheduled"), of(F.col("signal") == "recorded").alias("recorded"), of(evaluated).alias("evaluated"), of(F.col("signal") == "missed").alias("missed"), of(F.col("status") == "invalid").alias("invalid"),
        of(F.col("status").isin("recorded", "awaiting_signal", "source_error")).alias("pending"), of(evaluated & F.col("legacy_ic").isNotNull()).alias("compared"), of(F.col("warns")).alias("differences"),
        of(F.col("delivery") == "verified").alias("delivery_verified"), of(F.col("status") == "source_error").alias("source_errors"), of(evaluated & (F.col("comparison_status") == "error")).alias("comparison_errors"),
        of(evaluated & (F.col("legacy_status") == "missing")).alias("legacy_missing"), F.avg(F.when(evaluated, F.col("saved_ic"))).alias("mean_saved_ic"),
        last(F.col("status"), F.col("closed")).alias("_closed"), last(F.col("delivery"), F.col("closed")).alias("_sent"), last(F.col("status"), done).alias("_done"), F.max("faulty").alias("_faulty"),
    )
    issues = F.array_compact(F.array(
        F.when(F.col("_closed") == "missed", F.lit("latest_signal_missing")), F.when(F.col("_sent") == "unverified", F.lit("latest_delivery_unverified")), F.when(F.col("_done") == "invalid", F.lit("latest_outcome_invalid")),
        F.when(F.col("_faulty"), F.lit("input_errors_active")), F.when(F.col("legacy_missing") > 0, F.lit("legacy_comparison_missing")),
    ))
    return out.withColumn("issues", issues).withColumn("status", F.when(F.size("issues") > 0, "attention").otherwise("monitoring")).drop("_closed", "_sent", "_done", "_faulty")


def quote_status(intents: DataFrame, quotes: DataFrame) -> DataFrame:
    """(slot, phase, status, n_errors) of the quotes of each slot's names: observed if every name has
    exactly one that holds, else invalid; waiting if there is none. ``intents``: slot, entity; ``quotes``:
    slot, phase (entry, exit), entity, bid, ask, bid_size, ask_size, age (seconds)."""
    sound = (finite(F.col("bid")) > 0) & (F.col("bid") <= finite(F.col("ask"))) & (finite(F.col("bid_size")) > 0) & (finite(F.col("ask_size")) > 0) & F.col("age").between(-5, 60)
    per = quotes.groupBy("slot", "phase", "entity").agg(F.count("*").alias("_n"), F.min(F.coalesce(sound, F.lit(False))).alias("_sound"))
    due = intents.select("slot", "entity", F.explode(F.array(F.lit("entry"), F.lit("exit"))).alias("phase"))
    met = due.join(per, ["slot", "phase", "entity"], "left").groupBy("slot", "phase").agg(F.count("_n").alias("_there"), F.count_if(F.coalesce((F.col("_n") != 1) | ~F.col("_sound"), F.lit(True))).alias("n_errors"))
    return met.select("slot", "phase", F.when(F.col("_there") == 0, "waiting").when(F.col("n_errors") > 0, "invalid").otherwise("observed").alias("status"), "n_errors")


def venue_windows(intents: DataFrame, quotes: DataFrame, fee_bps: float, least: int = 10) -> DataFrame:
    """What the quotes of a second venue say of each slot's forecast. ``intents``: slot, entity, score,
    raw (the first venue's return), model, selected (whether the name is in either basket).

    Returns slot, entry and exit status, status (evaluated where both are observed, invalid where one is,
    else observing), n_names, rank ICs with the quoted mid returns and with the first venue's, their mean
    gap in percentage points, and the mean quoted short returns after ``fee_bps`` of the model's and of the
    selected basket, in percent, and their difference.
    """
    states = quote_status(intents, quotes)
    phase = lambda p: F.max(F.when(F.col("phase") == p, F.col("status")))
    status = F.when((F.col("entry") == "observed") & (F.col("exit") == "observed"), "evaluated").when((F.col("entry") == "invalid") | (F.col("exit") == "invalid"), "invalid").otherwise("observing")
    slots = states.groupBy("slot").agg(phase("entry").alias("entry"), phase("exit").alias("exit")).withColumn("status", status)
    good = intents.join(slots.where("status = 'evaluated'").select("slot"), "slot", "left_semi")
    side = lambda p, n: quotes.where(F.col("phase") == p).select("slot", "entity", F.col("bid").alias(f"bid{n}"), F.col("ask").alias(f"ask{n}"))
    rows = good.join(side("entry", 1), ["slot", "entity"]).join(side("exit", 2), ["slot", "entity"])
    rows = rows.withColumn("mid", (F.col("bid2") + F.col("ask2")) / (F.col("bid1") + F.col("ask1")) - 1).withColumn("short", 1 - F.col("ask2") / F.col("bid1") - fee_bps / 10_000)
    mean = lambda member: 100 * F.avg(F.when(F.col(member), F.col("short")))
    out = rows.groupBy("slot").agg(F.count("*").alias("n_names"), (100 * F.avg(F.col("mid") - F.col("raw"))).alias("mid_gap_pp"), mean("model").alias("model_short_pct"), mean("selected").alias("selected_short_pct"))
    ics = [rank_ic(rows, "score", c, ("slot",), least).select("slot", F.col("ic").alias(n)) for n, c in (("venue_ic", "mid"), ("same_pool_ic", "raw"))]
    out = slots.join(out, "slot", "left").join(ics[0], "slot", "left").join(ics[1], "slot", "left")
    return out.withColumn("selected_minus_model_pp", F.col("selected_short_pct") - F.col("model_short_pct"))


def venue_summary(windows: DataFrame) -> DataFrame:
    """One row over :func:`venue_windows`: slots by status, and attention if the last one is invalid."""
    count = lambda s: F.count_if(F.col("status") == s)
    out = windows.agg(F.count("*").alias("recorded"), count("evaluated").alias("evaluated"), count("invalid").alias("invalid"), count("observing").alias("observing"), F.max_by("status", "slot").alias("_last"))
    return out.withColumn("status", F.when(F.col("_last") == "invalid", "attention").otherwise("observing")).drop("_last")


def execution_summary(windows: DataFrame, funding: DataFrame, basket: int = 5) -> DataFrame:
    """Funding of the baskets of each slot. ``windows``: slot, entity, model, selected; ``funding``: slot,
    entity, status, rate_sum_bps. A basket's mean needs ``basket`` names, all of them observed. Returns
    slot, both means, how many records there are and how many of them are uncertain."""
    met = windows.join(funding.where("status = 'observed'").select("slot", "entity", "rate_sum_bps"), ["slot", "entity"], "left")
    mean = lambda member: F.when((F.count_if(member) == basket) & (F.count_if(F.col(member) & F.col("rate_sum_bps").isNotNull()) == basket), F.avg(F.when(F.col(member), F.col("rate_sum_bps"))))
    records = funding.groupBy("slot").agg(F.count("*").alias("records"), F.count_if(F.col("status") != "observed").alias("uncertain"))
    out = met.groupBy("slot").agg(mean("model").alias("model_funding_bps"), mean("selected").alias("selected_funding_bps"))
    return out.join(records, "slot", "left").fillna(0, ["records", "uncertain"])


def witness_faults(witnesses: DataFrame, members: DataFrame, features: list[str], now: Column, least: int = 10, grace_minutes: int = 45) -> DataFrame:
    """(id, fault) for each rule of its contract that a saved forecast breaks. ``witnesses``: id, schema,
    horizon, signal_at, recorded_at, timely, digest; ``members``: id, entity, score, inputs (a map from
    feature to value, null where it was missing) and actual.

    Faults: contract (another schema or horizon, or recorded before its signal or after ``now``), digest
    (not 64 hex digits), size (fewer than ``least`` names), repeated (a name twice), score (not finite),
    features (not exactly those expected), input (a value that is no finite number), outcome (a return
    that a forecast cannot know), timely (the label does not fit the times).
    """
    holds = lambda c: F.coalesce(c, F.lit(False))
    wrong = lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False))
    expected = F.array_sort(F.array(*[F.lit(f) for f in features]))
    each = members.groupBy("id").agg(
        F.count("*").alias("n"), F.count_distinct("entity").alias("names"), F.max(F.col("score").isNull() | wrong(F.col("score"))).alias("bad_score"),
        F.max(~holds(F.array_sort(F.map_keys("inputs")) == expected)).alias("bad_features"), F.max(F.exists(F.map_values("inputs"), wrong)).alias("bad_input"), F.max(F.col("actual").isNotNull()).alias("knows"),
    )
    w = witnesses.join(each, "id", "left")
    between = (F.col("signal_at") <= F.col("recorded_at")) & (F.col("recorded_at") <= now)
    timely = F.col("recorded_at") <= _later("signal_at", grace_minutes)
    rules = {
        "contract": holds((F.col("schema") == 1) & (F.col("horizon") == 6) & between), "digest": holds(F.col("digest").rlike("^[0-9a-f]{64}$")), "size": F.coalesce("n", F.lit(0)) >= least, "repeated": holds(F.coalesce(F.col("n") == F.col("names"), F.lit(True))),
        "score": ~F.coalesce("bad_score", F.lit(False)), "features": ~F.coalesce("bad_features", F.lit(False)), "input": ~F.coalesce("bad_input", F.lit(False)), "outcome": ~F.coalesce("knows", F.lit(False)), "timely": holds(F.col("timely") == timely),
    }
    return w.select("id", F.explode(F.array_compact(F.array(*[F.when(~ok, F.lit(n)) for n, ok in rules.items()]))).alias("fault"))
