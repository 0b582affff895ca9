"""State machines over evidence: weekly rotation, gate shadow, stages, deadlines, selection trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STATE = "struct<policy:string,candidate:string,streak:int,changed:timestamp_ntz>"


def weekly_evidence(records: DataFrame, lookback_days: int = 28) -> DataFrame:
    """(review_at, regime, n_windows, n_days, difference) for every Monday: the outcomes of the
    ``lookback_days`` before it that were recorded in time and evaluated before it.
    ``records``: signal_at, recorded_at, evaluated_at, regime, model_net, baseline_net."""
    timely = records.where((F.col("recorded_at") >= F.col("signal_at")) & (F.col("recorded_at") <= F.col("signal_at") + F.expr("INTERVAL 45 MINUTES")) & (F.col("evaluated_at") >= F.col("signal_at") + F.expr("INTERVAL 8 HOURS")))
    # a record counts at the few Mondays that follow its evaluation within the lookback
    monday = F.date_trunc("week", F.col("evaluated_at")).cast("timestamp_ntz") + F.expr("INTERVAL 7 DAYS")
    last = F.col("signal_at") + F.make_interval(days=F.lit(lookback_days))
    at = timely.withColumn("monday", monday).where(F.col("monday") <= last).withColumn("review_at", F.explode(F.sequence("monday", last, F.expr("INTERVAL 7 DAYS"))))
    return at.groupBy("review_at", "regime").agg(F.count("*").alias("n_windows"), F.count_distinct(F.to_date("signal_at")).alias("n_days"), F.avg(F.col("model_net") - F.col("baseline_net")).alias("difference"))


def rotation(evidence: DataFrame, reviews: DataFrame, least_windows: int, least_days: int, advantage: float, reviews_needed: int = 2, cooldown_days: int = 14) -> DataFrame:
    """Policy of each regime at each weekly review, by a fold over its reviews: a change needs the
    same candidate at consecutive reviews and no change within the cooldown. ``reviews``: review_at."""
    regimes = evidence.select("regime").distinct()
    rows = reviews.crossJoin(F.broadcast(regimes)).join(evidence, ["review_at", "regime"], "left")

    def step(acc: Column, r: Column) -> Column:
        s = acc["state"]
        ready = F.coalesce((r["n_windows"] >= least_windows) & (r["n_days"] >= least_days), F.lit(False))
        candidate = F.when(ready & (s["policy"] == "model") & (r["difference"] <= -advantage), "reversal").when(ready & (s["policy"] == "reversal") & (r["difference"] >= advantage), "model").otherwise(s["policy"])
        wants = candidate != s["policy"]
        consecutive = F.coalesce(r["review_at"] == acc["at"] + F.expr("INTERVAL 7 DAYS"), F.lit(False))
        streak = F.when(wants, F.when(consecutive & (s["candidate"] == candidate), s["streak"]).otherwise(0) + 1).otherwise(0)
        cooling = F.coalesce(r["review_at"] < s["changed"] + F.make_interval(days=F.lit(cooldown_days)), F.lit(False))
        change = wants & (streak >= reviews_needed) & ~cooling
        reason = F.when(~ready, "insufficient_data").when(change, "changed").when(wants & cooling, "cooldown").when(wants, "await_confirmation").otherwise("retain")
        state = F.struct(F.when(change, candidate).otherwise(s["policy"]).alias("policy"), candidate.alias("candidate"), F.when(change, 0).otherwise(streak).cast("int").alias("streak"), F.when(change, r["review_at"]).otherwise(s["changed"]).alias("changed"))
        out = F.struct(r["review_at"].alias("review_at"), state["policy"].alias("policy"), state["streak"].alias("streak"), reason.alias("reason"))
        return F.struct(r["review_at"].alias("at"), state.alias("state"), F.array_append(acc["out"], out).alias("out"))

    first = F.struct(F.lit("model").alias("policy"), F.lit("model").alias("candidate"), F.lit(0).alias("streak"), F.lit(None).cast("timestamp_ntz").alias("changed")).cast(_STATE)
    start = F.struct(F.lit(None).cast("timestamp_ntz").alias("at"), first.alias("state"), F.array().cast("array<struct<review_at:timestamp_ntz,policy:string,streak:int,reason:string>>").alias("out"))
    folded = rows.groupBy("regime").agg(F.array_sort(F.collect_list(F.struct("review_at", "n_windows", "n_days", "difference"))).alias("reviews"))
    return folded.select("regime", F.explode(F.aggregate("reviews", start, step, lambda a: a["out"])).alias("r")).select("regime", "r.*")


def blended_net(weight: Column, before: Column, model_net: Column, baseline_net: Column, switch_bps: float = 10.0) -> Column:
    """Net of a blend, less the cost of changing its weight, in percent."""
    return (1 - weight) * model_net + weight * baseline_net - F.abs(weight - before) * switch_bps / 100


def gate_shadow(grid: DataFrame, windows: DataFrame, now: Column, hours: int = 8) -> DataFrame:
    """Whether the last three matured slots can be compared. ``grid``: slot; ``windows``: slot,
    status, ic, model."""
    last = grid.where(F.col("slot") <= now - F.make_interval(hours=F.lit(hours))).orderBy(F.desc("slot")).limit(3)
    g = last.join(windows, "slot", "left").agg(F.count("*").alias("n"), F.count(F.when((F.col("status") == "evaluated") & F.col("ic").isNotNull(), 1)).alias("n_good"), F.count_distinct("model").alias("n_models"), F.min("ic").alias("least_ic"))
    reasons = F.array_compact(F.array(F.when(F.col("n") < 3, F.lit("fewer_than_three_matured_slots")), F.when(F.col("n_good") < F.col("n"), F.lit("incomplete_consecutive_scores")), F.when((F.col("n") > 0) & (F.col("n_models") != 1), F.lit("model_cohort_not_constant"))))
    return g.select("n", "least_ic", F.when(F.size(reasons) == 0, "comparable").otherwise("unavailable").alias("status"), F.array_join(reasons, ",").alias("reasons"))


def stages(evidence: DataFrame, now: Column) -> DataFrame:
    """Status of each stage (slot, stage, passed, terminal, deadline): passed, failed once it is
    terminal or past its deadline, waiting else."""
    return evidence.withColumn("status", F.when(F.col("passed"), "passed").when(F.col("terminal") | (now > F.col("deadline")), "failed").otherwise("waiting"))


def cycles(staged: DataFrame, now: Column) -> DataFrame:
    g = staged.groupBy("slot").agg(F.max((F.col("status") == "waiting").cast("int")).alias("open"), F.min((F.col("status") == "passed").cast("int")).alias("clean"))
    return g.select("slot", F.when(now < F.col("slot"), "awaiting_future").when(F.col("open") == 1, "observing").when(F.col("clean") == 1, "complete").otherwise("closed_with_gaps").alias("status"))


def deadlines(items: DataFrame, now: Column) -> DataFrame:
    """Status of each deadline (id, due, done, remind_days array) and the nearest reminder due."""
    left = (F.unix_timestamp(F.col("due").cast("timestamp")) - F.unix_timestamp(now.cast("timestamp"))) / 86_400
    status = F.when(F.col("done"), "done").when(left <= 0, "overdue").otherwise("pending")
    remind = F.when(status == "pending", F.array_min(F.filter("remind_days", lambda n: left <= n)))
    return items.select("id", status.alias("status"), left.alias("days_left"), remind.alias("remind"))


def selection_trace(scores: DataFrame, n: int = 5) -> DataFrame:
    """Why each name was or was not selected. ``scores``: ts, entity, score, tradable, selected,
    previous; low scores are selected."""
    w = Window.partitionBy("ts").orderBy("score")
    pool = Window.partitionBy("ts", "tradable")
    r = scores.withColumn("rank", F.rank().over(w)).withColumn("eligible_rank", F.when(F.col("tradable"), F.rank().over(pool.orderBy("score")))).withColumn("_place", F.when(F.col("tradable"), F.row_number().over(pool.orderBy("score", "entity"))))
    pure = F.coalesce(F.col("_place") <= n, F.lit(False))
    reason = (
        F.when(~F.col("tradable"), "not_tradable")
        .when(F.col("selected") & F.col("previous") & ~pure & (F.col("eligible_rank") > n), "buffer_retained")
        .when(F.col("selected") & ~pure & (F.col("eligible_rank") <= n), "selected_tie")
        .when(F.col("selected"), "selected_rank")
        .otherwise("outside_selection")
    )
    return r.withColumn("reason", reason).drop("_place")
