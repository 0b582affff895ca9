"""Walk-forward training, holdout measures, trials and the audits that compare saved with live results."""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.operators import boosting
from crosspanel.operators.chains import carried
from crosspanel.operators.evaluation import rank_ic
from crosspanel.operators.panel import anchored, non_overlapping
from crosspanel.operators.portfolio import buffered, long_economics, new_share, ranked_slots


def slot_moments(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """Sums and products of the features and the target at each slot, over the rows that have all of
    them: a row of fixed width for each slot, whatever the size of the cross-section."""
    names = [*features, target]
    sums = [F.sum(c).alias(f"s_{i}") for i, c in enumerate(names)]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"m_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    return rows.dropna(subset=names).groupBy("slot").agg(F.count("*").alias("n"), *sums, *products)


def fold_models(moments: DataFrame, slots: int, features: list[str], train: int, test: int, gap: int = 0, alpha: float = 1.0, least: int = 100) -> DataFrame:
    """Ridge models by fold: columns fold, retrain (from 1), n, weights (in the features' order) and
    intercept. Fold f trains on the slots from f * test on, ``train`` of them, and is tested ``gap``
    slots after the last of these, if all its test slots are there; a fold of fewer than ``least``
    rows has no model. Only rows of moments are copied to the folds, never rows of the panel; the
    small systems are solved where these rows are."""
    k = len(features)
    last = (slots - train - gap - test) // test
    first = F.greatest(F.lit(0), F.ceil((F.col("slot") - train + 1) / test))
    until = F.least(F.floor(F.col("slot") / test), F.lit(last))
    dealt = moments.where(first <= until).withColumn("fold", F.explode(F.sequence(first.cast("int"), until.cast("int")))).drop("slot")
    summed = dealt.groupBy("fold").agg(*[F.sum(c).alias(c) for c in moments.columns if c != "slot"]).where(F.col("n") >= least)
    summed = summed.withColumn("retrain", F.row_number().over(Window.orderBy("fold")))  # a row for each fold

    def solve(batches):  # noqa: ANN001, ANN202
        for got in batches:
            out = []
            for r in got.to_dict("records"):
                mean = np.array([r[f"s_{i}"] for i in range(k + 1)]) / r["n"]
                gram = np.array([[r[f"m_{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) - r["n"] * np.outer(mean, mean)
                w = np.linalg.solve(gram[:k, :k] + alpha * np.eye(k), gram[:k, k])
                out.append((r["fold"], r["retrain"], r["n"], w.tolist(), float(mean[k] - mean[:k] @ w)))
            yield pd.DataFrame(out, columns=["fold", "retrain", "n", "weights", "intercept"])

    return summed.mapInPandas(solve, "fold int, retrain int, n bigint, weights array<double>, intercept double")


def scored_by(rows: DataFrame, models: DataFrame, features: list[str]) -> DataFrame:
    """Rows that have all features, with the score of their fold's model."""
    score = F.col("intercept")
    for i, f in enumerate(features):
        score = score + F.col(f) * F.col("weights")[i]
    return rows.dropna(subset=features).join(models, "fold").withColumn("score", score).drop("weights", "intercept", "n")


def walk_forward(frame: DataFrame, features: list[str], target: str, train: int, test: int, gap: int = 0, least: int = 100, calendar: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Models by fold, and the rows of each fold's test slots with their scores (columns slot, fold,
    retrain, score). Slots are numbered over ``calendar``, by default the timestamps of ``frame``. With a
    ``gap`` that covers the horizon a model never sees a target that is realised in its test slots."""
    calendar = calendar if calendar is not None else frame
    times = calendar.select("ts").distinct()
    slots = times.count()
    numbers = times.withColumn("slot", F.row_number().over(Window.orderBy("ts")) - 1)  # a row for each timestamp
    rows = frame.join(numbers, "ts")
    models = fold_models(slot_moments(rows, features, target), slots, features, train, test, gap, least=least)
    tested = rows.withColumn("fold", F.floor((F.col("slot") - train - gap) / test).cast("int")).where("fold >= 0")
    return models, scored_by(tested, models, features)


def boosted_walk(frame: DataFrame, features: list[str], target: str, train: int, test: int, calendar: DataFrame, rounds: int = boosting.ROUNDS, depth: int = boosting.DEPTH, gap: int = 0) -> DataFrame:
    """The rows of each fold's test slots with the scores of boosted trees of its training slots. The
    folds are trained together, on bins that all of them share."""
    times = calendar.select("ts").distinct()
    slots = times.count()
    rows = frame.join(times.withColumn("slot", F.row_number().over(Window.orderBy("ts")) - 1), "ts")  # a row for each timestamp
    last = (slots - train - gap - test) // test
    first, until = F.greatest(F.lit(0), F.ceil((F.col("slot") - train + 1) / test)), F.least(F.floor(F.col("slot") / test), F.lit(last))
    dealt = rows.where(first <= until).withColumn("fold", F.explode(F.sequence(first.cast("int"), until.cast("int"))))
    models, edges = boosting.train(dealt, "fold", features, target, depth, rounds)
    tested = rows.withColumn("fold", F.floor((F.col("slot") - train - gap) / test).cast("int")).where((F.col("fold") >= 0) & (F.col("fold") <= last))
    return boosting.scored(tested, models, edges, "fold", features).where("score IS NOT NULL")


def trading_slots(tested: DataFrame, train: int, test: int, gap: int, every: int) -> DataFrame:
    """Of the tested rows those of every ``every``-th slot of their fold."""
    return tested.where((F.col("slot") - train - gap - F.col("fold") * test) % every == 0)


def traded_slots(tested: DataFrame, long_n: int, short_n: int, buffer: int, fee: float, short_extra: float, actual: str = "residual", least_ic: int = 6) -> DataFrame:
    """A row for each slot of the tested rows (ts, entity, retrain, score, ret and ``actual``) that has
    names enough for both baskets: retrain, returns of the legs, gross, turnover, cost, net, and the rank
    IC of the scores with what was realised. Baskets are carried from slot to slot across retrains; a
    leg without returns counts as 0; the short leg pays ``short_extra``."""
    w = Window.partitionBy("ts")
    full = tested.withColumn("_names", F.count("*").over(w)).where(F.col("_names") >= max(5, long_n + short_n)).drop("_names")
    baskets = buffered(ranked_slots(full, max(long_n, short_n) + buffer), long_n, short_n, buffer)
    turnover = (new_share("longs", "prev_longs") + new_share("shorts", "prev_shorts")) / 2
    held = full.join(baskets, "ts")  # the baskets of a slot, beside each of its rows
    of = lambda side: F.avg(F.when(F.array_contains(side, F.col("entity")), F.col("ret")))
    legs = held.groupBy("ts", "retrain", "longs", "shorts", turnover.alias("turnover")).agg(of("longs").alias("long_ret"), of("shorts").alias("short_ret"))
    legs = legs.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("long_ret", "short_ret")})
    cost, extra = F.col("turnover") * 2 * fee, F.when(F.size("shorts") > 0, F.lit(short_extra)).otherwise(0.0)
    gross = F.col("long_ret") - F.col("short_ret")
    ics = rank_ic(full, "score", actual, ("ts",), least_ic).select("ts", "ic")
    return legs.join(ics, "ts", "left").select("ts", "retrain", "longs", "shorts", "long_ret", "short_ret", gross.alias("gross"), "turnover", cost.alias("cost"), extra.alias("short_cost"), (gross - cost - extra).alias("net"), "ic")


def holdout_slots(times: DataFrame, fraction: float, anchors: tuple[int, ...], hours: int) -> DataFrame:
    """The timestamps (ts) of the last ``fraction`` of the calendar that are exact anchors and do not
    overlap over a horizon of ``hours``."""
    slots = times.select("ts").distinct()
    start = int(slots.count() * (1.0 - fraction))
    late = slots.withColumn("slot", F.row_number().over(Window.orderBy("ts")) - 1).where(F.col("slot") >= start)  # a row for each timestamp
    return non_overlapping(late.where(anchored("ts", anchors)), hours)


def holdout_measures(scores: DataFrame, returns: DataFrame, slots: DataFrame, active: DataFrame | None = None, top: int = 5, cost: float = 0.002, least: int = 5) -> DataFrame:
    """One row on scores over holdout slots (see :func:`holdout_slots`): exact and mature slots (with
    ``least`` returns), those the regime gate ``active`` (ts, active) leaves open, rank IC, and the
    economics of the ``top`` names. A closed gate empties the basket, so that the next one is new
    throughout; a missing return of a pick voids its slot. ``scores``: ts, entity, score; ``returns``: ts,
    entity, ret."""
    mature = slots.join(returns.groupBy("ts").agg(F.count("ret").alias("_n")).where(F.col("_n") >= least).select("ts"), "ts", "left_semi")
    gate = active.select("ts", "active") if active is not None else mature.select("ts", F.lit(True).alias("active"))
    opened = mature.join(gate.where("active"), "ts", "left_semi")
    at = lambda frame: frame.join(mature, "ts", "left_semi")
    ics = rank_ic(scores.join(opened, "ts", "left_semi").join(returns, ["ts", "entity"]), "score", "ret", ("ts",), least)
    traded = long_economics(at(scores), at(returns), at(gate), top, cost).where((F.col("n_picks") == top) & F.col("gross").isNotNull())
    hits = lambda c: F.avg((F.col(c) > 0).cast("double"))
    economics = traded.agg(
        F.count("*").alias("n_top"), F.avg("gross").alias("gross"), F.avg("net").alias("net"), F.avg("turnover").alias("turnover"), hits("net").alias("net_hit"), hits("gross").alias("gross_hit"),
    )
    counts = [slots.agg(F.count("*").alias("n_exact")), mature.agg(F.count("*").alias("n_mature")), opened.agg(F.count("*").alias("n_active")), ics.agg(F.count("ic").alias("n_ic"), F.avg("ic").alias("ic")), economics]
    return reduce(DataFrame.crossJoin, counts)  # one row each


def latest_complete(frame: DataFrame, least: int = 5, anchors: tuple[int, ...] | None = None) -> DataFrame:
    """Rows with score and return at the last timestamp, of those at the ``anchors`` hours if any are
    named, at which ``least`` entities or more have a return."""
    due = frame if anchors is None else frame.where(F.hour("ts").isin(*anchors))
    last = due.groupBy("ts").agg(F.count("ret").alias("_n")).where(F.col("_n") >= least).agg(F.max("ts").alias("ts"))
    return frame.where(F.col("score").isNotNull() & F.col("ret").isNotNull()).join(last, "ts")


def trial_summary(windows: DataFrame, by: str, scheduled: int) -> DataFrame:
    """Where each trial stands. ``windows``: by, slot, status (recorded, missed), outcome (matured,
    another word if it is invalid, null while pending), model and control (net returns).

    Counts of the windows, means of both arms and of their paired excess over the matured ones, in
    percent, and a status: ready_for_review if all that were scheduled matured, incomplete_evidence
    if all of them ended, collecting before.
    """
    done = F.col("outcome") == "matured"
    mean = lambda x: 100 * F.avg(F.when(done, x))
    out = windows.groupBy(by).agg(
        F.count_if(F.col("status") == "recorded").alias("n_recorded"), F.count_if(done).alias("n_matured"), F.count_if(F.col("status") == "missed").alias("n_missed"),
        F.count_if(F.col("outcome").isNotNull() & ~done).alias("n_invalid"), F.count("outcome").alias("_ended"),
        mean(F.col("model")).alias("model_pct"), mean(F.col("control")).alias("control_pct"), mean(F.col("model") - F.col("control")).alias("paired_excess_pct"),
    )
    status = F.when(F.col("n_matured") == scheduled, "ready_for_review").when(F.col("_ended") + F.col("n_missed") == scheduled, "incomplete_evidence").otherwise("collecting")
    return out.select(by, F.lit(scheduled).alias("n_scheduled"), "n_recorded", "n_matured", "n_missed", "n_invalid", (F.col("n_recorded") - F.col("_ended")).alias("n_pending"), "model_pct", "control_pct", "paired_excess_pct", status.alias("status"))


def by_context(windows: DataFrame, by: str, context: str) -> DataFrame:
    """Matured windows and the model's mean net return, in percent, for each context of each trial."""
    named = F.coalesce(F.col(context), F.lit("unknown")).alias(context)
    return windows.where("outcome = 'matured'").groupBy(by, named).agg(F.count("*").alias("n_windows"), (100 * F.avg("model")).alias("mean_net_pct"))


def trial_decision(summary: DataFrame, now: Column, earliest: Column, deadline: Column, intact: Column) -> DataFrame:
    """``summary`` (see :func:`trial_summary`, with the interval ``low``, ``high`` of the excess where it
    is complete) with the columns terminal and code.

    A trial is terminal if it ended and its earliest date has come, or at its deadline. Integrity comes
    first; then completeness: a missing or invalid window is insufficient evidence, never dropped; then
    the interval decides. A complete trial without an interval is an integrity failure.
    """
    terminal = ((now >= earliest) & F.col("status").isin("ready_for_review", "incomplete_evidence")) | (now >= deadline)
    whole = (F.col("n_matured") == F.col("n_scheduled")) & (F.col("n_missed") == 0) & (F.col("n_invalid") == 0)
    usable = (F.col("low") <= F.col("high")) & ~F.isnan("low") & ~F.isnan("high") & (F.abs("low") < float("inf")) & (F.abs("high") < float("inf"))
    sound = F.coalesce(intact, F.lit(False))
    code = (
        F.when(~sound & terminal, "integrity_failure").when(~sound, "integrity_blocked").when(~terminal, "collecting").when(~whole, "insufficient_evidence")
        .when(~F.coalesce(usable, F.lit(False)), "integrity_failure").when(F.col("low") > 0, "relative_edge").when(F.col("high") < 0, "baseline_better").otherwise("inconclusive")
    )
    return summary.withColumn("terminal", terminal).withColumn("code", code)


def broken_rules(frame: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys, rule) for each rule that a row breaks; a rule that gives null is broken."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return frame.select(*keys, F.explode(names).alias("rule"))


def compared_series(one: DataFrame, two: DataFrame, key: str, value: str, warn: float = 0.03) -> DataFrame:
    """Two series side by side: their difference, and whether it calls for a look; a missing side is
    no difference."""
    both = one.select(key, F.col(value).alias("one")).join(two.select(key, F.col(value).alias("two")), key, "full")
    apart = F.abs(F.col("one") - F.col("two"))
    return both.select(key, "one", "two", apart.alias("apart"), F.coalesce(apart >= warn, F.lit(False)).alias("warns"))


def consistent_sign(side: Column, ledger: Column, report: Column, tolerance: float = 0.001) -> Column:
    """Whether a reported move agrees with the ledger's return by side: in sign, and within a tolerance."""
    signed = F.when(side == "SHORT", -report).otherwise(report)
    flipped = ((ledger > 0) != (signed > 0)) & (F.abs(ledger) > 1e-6)
    return ~flipped & (F.abs(ledger - signed) <= tolerance)


def latest_known(slots: DataFrame, reviews: DataFrame, by: str) -> DataFrame:
    """``slots`` (by, slot_at, known_at) with the last of ``reviews`` (by, review_at, recorded_at,
    verdict) that was made by the slot's time and recorded by the time known.

    Reviews and slots of a key are merged in order of their times. A review that was recorded no
    earlier than a later one can never be the answer again: what is held is the staircase of the others,
    in which review and recording times both rise, and a search by the time known finds the answer.
    """
    kind = reviews.schema["verdict"].dataType.simpleString()
    kinds = {f.name: f.dataType.simpleString() for f in slots.schema}
    no = lambda t: F.lit(None).cast(t)
    made = reviews.where("review_at IS NOT NULL AND recorded_at IS NOT NULL").select(by, F.col("review_at").alias("at"), F.lit(0).alias("asks"), F.col("recorded_at").alias("known"), "verdict", no(f"struct<{','.join(f'`{c}`:{t}' for c, t in kinds.items())}>").alias("slot"))
    asked = slots.select(by, F.col("slot_at").alias("at"), F.lit(1).alias("asks"), F.col("known_at").alias("known"), no(kind).alias("verdict"), F.struct(*slots.columns).alias("slot"))

    def step(state, row):  # noqa: ANN001, ANN202
        recorded, verdicts = state or ([], [])
        if row["asks"]:
            known = row["known"]
            at = bisect_right(recorded, known) if known is not None and row["at"] is not None else 0
            return (recorded, verdicts), [(*[row["slot"][c] for c in kinds], verdicts[at - 1] if at else None)]
        while recorded and recorded[-1] >= row["known"]:
            recorded.pop()
            verdicts.pop()
        recorded.append(row["known"])
        verdicts.append(row["verdict"])
        return (recorded, verdicts), []

    schema = ", ".join([*[f"`{c}` {t}" for c, t in kinds.items()], f"verdict {kind}"])
    return carried(made.unionByName(asked), [by], ["at", "asks", "known", "verdict"], step, schema)


def tagged(rows: DataFrame, tags: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with their reliability tag, empty where there is none."""
    return rows.join(tags, keys, "left").withColumn("tag", F.coalesce("tag", F.lit("")))


def by_content(reports: DataFrame, witnesses: DataFrame, column: str) -> DataFrame:
    """Reports joined to the witnesses of the same content, by its digest."""
    digest = F.sha2(F.col(column), 256)
    return reports.withColumn("digest", digest).join(witnesses.select(digest.alias("digest"), F.col("id").alias("witness")), "digest")


def rebalance_clock(ts: Column, every: int, anchor: int) -> tuple[Column, Column]:
    """Whether a time's hour of day is a rebalance slot, and the time of the next slot after it. Every
    hour is one if ``every`` is not positive."""
    hour = F.date_trunc("hour", ts)
    if every <= 0:
        return F.lit(True), hour + F.make_interval(hours=F.lit(1))
    since = F.pmod(F.hour(ts) - anchor, F.lit(every))
    ahead = F.sequence(F.lit(1), F.lit(max(every, 24)))
    due = lambda n: F.pmod(F.hour(hour + F.make_interval(hours=n)) - anchor, F.lit(every)) == 0
    return since == 0, hour + F.make_interval(hours=F.element_at(F.filter(ahead, due), 1))


def without_outliers(frame: DataFrame, target: str, bound: float = 0.5) -> DataFrame:
    """Rows whose target is within the bound."""
    return frame.where(F.abs(F.col(target)) <= bound)


def universe_audit(picks: DataFrame, bars: DataFrame, low_volume: float) -> DataFrame:
    """How often each side picked each entity, with the median of the entity's daily volume and a flag
    where that is low. ``picks``: ts, side, entity; ``bars``: ts, entity, volume."""
    daily = bars.groupBy("entity", F.to_date("ts").alias("day")).agg(F.sum("volume").alias("volume"))
    volume = daily.groupBy("entity").agg(F.percentile("volume", 0.5).alias("median_volume"))
    seen = picks.groupBy("side", "entity").agg(F.countDistinct("ts").alias("appearances"))
    place = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("appearances"), "entity"))
    return seen.join(volume, "entity", "left").select("side", "entity", "appearances", place.alias("place"), "median_volume", F.coalesce(F.col("median_volume") < low_volume, F.lit(True)).alias("low"))


def grid_status(expected: DataFrame, seen: DataFrame, slot: str) -> DataFrame:
    """Slots of a grid by status: on time, late, missing; and rows outside the grid."""
    met = expected.withColumn("_due", F.lit(True)).join(seen.groupBy(slot).agg(F.min("late").alias("late")), slot, "full")
    status = F.when(F.col("_due").isNull(), "unexpected").when(F.col("late").isNull(), "missing").when(F.col("late"), "late").otherwise("on_time")
    return met.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
