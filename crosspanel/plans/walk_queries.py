"""Walk-forward, holdout, trial and audit queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.functions.columns import by_entity, six, stamp
from crosspanel.operators import evaluation as ev
from crosspanel.operators import factors as fa
from crosspanel.operators import models as mo
from crosspanel.operators import statistics as sx
from crosspanel.operators import walkforward as wf
from crosspanel.plans.audit_queries import FACTORS, RIDGE, learnable
from crosspanel.plans.ledger_queries import EXTRA, FEE, FOLD, PERIODS, SLOTS, WEEKLY, baskets, recursive
from crosspanel.plans.panel_queries import REGIME, TS, VENUES, factors_a, panel_a, regime_a, scored, shown, sql, venues
from crosspanel.sources.tables import kept_table, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
XY = FACTORS[:2]
P = ("b", "panel", "factors")
ZS = RIDGE.partition("\nm AS")[0].rstrip(", ")

#: The ten factors of one model: of the price, of the second venue, of the calendar.
TEN = [*FACTORS, "lead_1h", "premium_inv", "premium_z_24h", "dow_bull", "hour_vol"]
TRAIN, TEST, GAP, HORIZON = 96, 24, 0, 6
GOOD = " AND ".join(f"f{i} IS NOT NULL" for i in range(10))
_z = lambda c: f"CASE WHEN {c} IS NOT NULL AND stddev_samp({c}) OVER t > 0 THEN least(greatest(({c} - avg({c}) OVER t) / nullif(stddev_samp({c}) OVER t, 0), -3), 3) END"
UNIFIED = f"""urb AS (SELECT ts, entity, open, close, r1, max(r1) FILTER (entity = '1') OVER (PARTITION BY ts) AS rb FROM factors),
ube AS (SELECT *, CASE WHEN sum((r1 IS NOT NULL AND rb IS NOT NULL)::INT) OVER w = 48 THEN covar_samp(r1, rb) OVER w / nullif(var_samp(CASE WHEN r1 IS NOT NULL THEN rb END) OVER w, 0) END AS beta FROM urb WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS 47 PRECEDING)),
ufw AS (SELECT *, lead(close, 6) OVER e / nullif(close, 0) - 1 AS ret, lead(open, 13) OVER e / nullif(lead(open, 1) OVER e, 0) - 1 AS ret12, lead(open, 7) OVER e / nullif(lead(open, 1) OVER e, 0) - 1 AS ret6 FROM ube WINDOW e AS (PARTITION BY entity ORDER BY ts)),
ure AS (SELECT ts, entity, ret, ret12, ret6, ret - beta * max(ret) FILTER (entity = '1') OVER (PARTITION BY ts) AS residual FROM ufw),
uj AS (SELECT * FROM factors LEFT JOIN venue USING (ts, entity) JOIN ure USING (ts, entity)),
uni AS (SELECT ts, entity, {", ".join(f"{_z(c)} AS f{i}" for i, c in enumerate(TEN[:8]))},
  CASE WHEN isodow(ts + INTERVAL 9 HOUR) < 4 THEN 1.0::DOUBLE WHEN isodow(ts + INTERVAL 9 HOUR) > 4 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS f8, CASE WHEN hour(ts + INTERVAL 9 HOUR) IN (7, 8, 9, 22, 23, 0, 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f9,
  ret, ret12, ret6, residual, CASE WHEN abs(residual) <= 0.5 THEN residual END AS target FROM uj WINDOW t AS (PARTITION BY ts))"""
FOLDS = f"""cal AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS o FROM (SELECT DISTINCT ts FROM uni WHERE {GOOD} AND target IS NOT NULL)),
folds AS (SELECT unnest(range((SELECT greatest(0, floor((count(*) - {TRAIN + GAP + TEST}) / {TEST})::BIGINT + 1) FROM cal))) AS fold),
tr AS (SELECT fold, {", ".join(f"f{i}" for i in range(10))}, target FROM uni JOIN cal USING (ts) JOIN folds ON o >= fold * {TEST} AND o < fold * {TEST} + {TRAIN} WHERE {GOOD} AND target IS NOT NULL),
fm AS (SELECT fold, count(*) AS n, [{", ".join(f"avg(f{i})" for i in range(10))}] AS mean, avg(target) AS my,
  [{", ".join("[" + ", ".join([*[f"covar_pop(f{i}, f{j}) * count(*)" + (" + 1" if i == j else "") for j in range(10)], f"covar_pop(f{i}, target) * count(*)"]) + "]" for i in range(10))}] AS m FROM tr GROUP BY fold HAVING count(*) >= 100),
ga(fold, k, m) AS (SELECT fold, 1, m FROM fm UNION ALL
  SELECT fold, k + 1, [CASE WHEN i = k THEN [v / m[k][k] FOR v IN m[k]] ELSE [m[i][j] - m[i][k] / m[k][k] * m[k][j] FOR j IN range(1, 12)] END FOR i IN range(1, 11)] FROM ga WHERE k <= 10),
fw AS (SELECT fold, n, row_number() OVER (ORDER BY fold) AS retrain, [r[11] FOR r IN ga.m] AS w, my - list_dot_product(mean, [r[11] FOR r IN ga.m]) AS intercept FROM ga JOIN fm USING (fold) WHERE k = 11),
te AS (SELECT fold, retrain, o, ts, entity, ret, ret12, ret6, residual, f0, intercept + list_dot_product([{", ".join(f"f{i}" for i in range(10))}], w) AS score, (f0 + f1 + f2 + f3 + f4) / 5 AS live FROM uni JOIN cal USING (ts) JOIN fw ON fold = (o - {TRAIN + GAP}) // {TEST} WHERE o >= {TRAIN + GAP} AND {GOOD})"""
_tied = lambda c, keys: f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0::DOUBLE"


def spearman_sql(name: str, rows: str, keys: str, one: str, two: str, least: int = 5) -> str:
    """A common table expression (keys, n, ic) of rank correlations by keys."""
    return f"""{name}_r AS (SELECT {keys}, {_tied(one, keys)} AS rs, {_tied(two, keys)} AS rt FROM (SELECT {keys}, {one}, {two} FROM {rows} WHERE {one} IS NOT NULL AND {two} IS NOT NULL)),
{name} AS (SELECT {keys}, count(*) AS n, covar_pop(rs, rt) / nullif(stddev_pop(rs) * stddev_pop(rt), 0) AS ic FROM {name}_r GROUP BY {keys} HAVING count(*) >= {least})"""


WALK = ("a", "panel", "factors", VENUES, UNIFIED, FOLDS)
#: What is traded every six hours of a fold; named as the SQL of the baskets wants it.
TRADED = f"""weekly AS (SELECT * FROM te WHERE (o - {TRAIN + GAP} - fold * {TEST}) % {HORIZON} = 0 QUALIFY count(*) OVER (PARTITION BY ts) >= 6)"""


def query(name: str, oracle: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def unified(s: SparkSession, d: str) -> DataFrame:
    """The ten factors, scored over the cross-section but for the calendar's, with the returns to come
    and the training target: the residual, where it is no outlier."""
    panel = panel_a(s, d)
    w = by_entity()
    after = lambda h: F.lead("open", 1 + h).over(w) / F.nullif(F.lead("open", 1).over(w), F.lit(0.0)) - 1
    prices = fa.price_factors(panel).withColumn("ret12", after(12)).withColumn("ret6", after(6))
    real = fa.residual_returns(panel, "1", HORIZON, rows=48).select("ts", "entity", F.col("forward").alias("ret"), "residual")
    joined = prices.join(venues(s, d), ["ts", "entity"], "left").join(real, ["ts", "entity"])
    dow, hour = fa.calendar_flags(F.col("ts"))
    z = fa.zscored(joined.select("ts", "entity", *TEN[:8], "ret", "ret12", "ret6", "residual"), TEN[:8])
    return z.select("*", dow.alias("dow_bull"), hour.alias("hour_vol"), F.when(F.abs("residual") <= 0.5, F.col("residual")).alias("target"))


def walked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Models by fold and tested rows. The frame is written once: the calendar, the moments and the
    tested rows are all read from it."""
    frame = kept_table(unified(s, d), "unified")
    return wf.walk_forward(frame, TEN, "target", TRAIN, TEST, GAP, calendar=frame.dropna(subset=[*TEN, "target"]))


def fold_ics(tested: DataFrame, score: str) -> DataFrame:
    return ev.rank_ic(tested, score, "residual", ("fold", "ts"))


@query("walkforward_ridge", recursive(*WALK, body=f"SELECT fold::INT AS fold, retrain::INT AS retrain, n, round(intercept, 6) + 0.0::DOUBLE AS intercept, {', '.join(f'round(w[{i + 1}], 6) + 0.0::DOUBLE AS {c}' for i, c in enumerate(TEN))} FROM fw"))
def walkforward_ridge(s: SparkSession, d: str) -> DataFrame:
    models, _ = walked(s, d)
    return models.select("fold", "retrain", "n", six(F.col("intercept")).alias("intercept"), *[six(F.col("weights")[i]).alias(c) for i, c in enumerate(TEN)])


FIC = spearman_sql("fic", "te", "fold, ts", "score", "residual")
LIC = spearman_sql("lic", "te", "fold, ts", "live", "residual")


@query("walkforward_ic", recursive(*WALK, FIC, body="SELECT fold::INT AS fold, count(*) AS slots, round(avg(ic), 6) + 0.0::DOUBLE AS ic FROM fic GROUP BY fold"))
def walkforward_ic(s: SparkSession, d: str) -> DataFrame:
    _, tested = walked(s, d)
    return fold_ics(tested, "score").groupBy("fold").agg(F.count("*").alias("slots"), six(F.avg("ic")).alias("ic"))


@query("walkforward_boosted", None)
def walkforward_boosted(s: SparkSession, d: str) -> DataFrame:
    """Rank IC by fold of boosted trees: 10 rounds, of the 300 that the operator takes by default."""
    frame = kept_table(unified(s, d), "unified")
    tested = wf.boosted_walk(frame, TEN, "target", TRAIN, TEST, frame.dropna(subset=[*TEN, "target"]), rounds=10)
    return fold_ics(tested, "score").groupBy("fold").agg(F.count("*").alias("slots"), six(F.avg("ic")).alias("ic"))


def traded(tested: DataFrame) -> DataFrame:
    """Three names a side, two more as buffer, every six hours."""
    return wf.traded_slots(wf.trading_slots(tested, TRAIN, TEST, GAP, HORIZON), 3, 3, 2, FEE, EXTRA)


TIC = spearman_sql("tic", "weekly", "ts", "score", "residual", 6)
SLOT_VALUES = ["long_ret", "short_ret", "gross", "turnover", "cost", "short_cost", "net", "ic"]


@query("walkforward_slots", recursive(*WALK, TRADED, TIC, SLOTS, FOLD, PERIODS, body=f"""SELECT strftime(net.ts, '%Y-%m-%d %H:%M') AS ts, retrain::INT AS retrain, array_to_string(longs, ',') AS longs, array_to_string(shorts, ',') AS shorts,
round(coalesce(lret, 0), 6) + 0.0::DOUBLE AS long_ret, round(coalesce(sret, 0), 6) + 0.0::DOUBLE AS short_ret, round(gross, 6) + 0.0::DOUBLE AS gross, round(turnover, 6) AS turnover, round(turnover * 2 * 0.001::DOUBLE, 6) + 0.0::DOUBLE AS cost,
CASE WHEN len(shorts) > 0 THEN 0.001::DOUBLE ELSE 0 END AS short_cost, round(net, 6) + 0.0::DOUBLE AS net, round(ic, 6) + 0.0::DOUBLE AS ic FROM net JOIN fold USING (ts) JOIN (SELECT DISTINCT ts, retrain FROM weekly) USING (ts) LEFT JOIN lr USING (ts) LEFT JOIN tic USING (ts)"""))
def walkforward_slots(s: SparkSession, d: str) -> DataFrame:
    _, tested = walked(s, d)
    out = traded(tested).select("*", *[F.array_join(c, ",").alias(f"{c}_") for c in ("longs", "shorts")])
    return out.select(stamp(F.col("ts")).alias("ts"), "retrain", F.col("longs_").alias("longs"), F.col("shorts_").alias("shorts"), *[six(F.col(c)).alias(c) for c in SLOT_VALUES])


@query("stability_audit", recursive(*WALK, TRADED, TIC, """si AS (SELECT ts, retrain, ic, row_number() OVER (ORDER BY ts) AS nth, count(*) OVER () AS slots FROM (SELECT DISTINCT ts, retrain FROM weekly) JOIN tic USING (ts) WHERE ic IS NOT NULL),
sp AS (SELECT ic, unnest(['all', 'fold:' || retrain, CASE WHEN nth <= slots // 2 THEN 'half:first' ELSE 'half:second' END, 'month:' || strftime(last_day(ts), '%Y-%m-%d')]) AS part FROM si)""",
    body="SELECT part, count(*) AS n, round(avg(ic), 6) + 0.0::DOUBLE AS mean_ic, round(stddev_samp(ic), 6) AS std_ic, round(avg((ic > 0)::INT), 6) AS positive FROM sp GROUP BY part"))
def stability_audit(s: SparkSession, d: str) -> DataFrame:
    _, tested = walked(s, d)
    out = ev.stability_audit(traded(tested))
    return out.select("part", "n", *[six(F.col(c)).alias(c) for c in ("mean_ic", "std_ic", "positive")])


#: What is done to a fold's measurements, so that every branch of the gate is met: name, IC of the
#: candidate and of the live model, horizon, periods, net.
CASES = [
    ("as_is", "ic", "live", "6", "n", "net"), ("no_candidate", "NULL", "live", "6", "n", "net"), ("not_a_number", "'NaN'", "live", "6", "n", "net"), ("no_live", "ic + 1", "NULL", "6", "n", "net"), ("worse", "0.5", "0.6", "6", "n", "net"),
    ("poor_short", "ic + 1", "live", "6", "n", "-1"), ("poor_long", "ic + 1", "live", "12", "n", "-1"), ("no_net", "ic + 1", "live", "12", "n", "NULL"), ("few_periods", "ic + 1", "live", "12", "9", "1"), ("earns", "ic + 1", "live", "12", "10", "1"), ("forced", "NULL", "live", "12", "0", "NULL"),
]


@query("promotion_gate", recursive(*WALK, FIC, LIC, TRADED, SLOTS, FOLD, PERIODS, f"""g AS (SELECT fold, avg(fic.ic) AS ic, avg(lic.ic) AS live FROM fic JOIN lic USING (fold, ts) GROUP BY fold),
e AS (SELECT fold, count(*) AS n, avg(net) AS net FROM net JOIN (SELECT DISTINCT ts, fold FROM weekly) USING (ts) GROUP BY fold),
c AS ({" UNION ALL ".join(f"SELECT fold, '{name}' AS planted, ({ic})::DOUBLE AS ic, ({live})::DOUBLE AS live, {h} AS h, {n} AS n, ({net})::DOUBLE AS net FROM g JOIN e USING (fold)" for name, ic, live, h, n, net in CASES)})""",
    body="""SELECT fold::INT AS fold, planted, CASE WHEN planted = 'forced' THEN 'promote' WHEN ic IS NULL OR isnan(ic) OR round(ic, 6) < 0.04 THEN 'below_floor' WHEN live IS NOT NULL AND round(round(ic, 6) - round(live, 6), 6) < -0.015 THEN 'worse'
WHEN h = 12 AND NOT coalesce(n >= 10 AND round(net, 6) > 0, false) THEN 'economics' ELSE 'promote' END AS verdict FROM c"""))  # fmt: skip
def promotion_gate(s: SparkSession, d: str) -> DataFrame:
    _, tested = walked(s, d)
    tested = kept_table(tested.withColumn("live", sum((F.col(c) for c in FACTORS[1:]), F.col(FACTORS[0])) / 5), "tested")
    ics = fold_ics(tested, "score").join(fold_ics(tested, "live").select("fold", "ts", F.col("ic").alias("live")), ["fold", "ts"])
    g = ics.groupBy("fold").agg(F.avg("ic").alias("ic"), F.avg("live").alias("live"))
    e = traded(tested).join(tested.select("ts", "fold").distinct(), "ts").groupBy("fold").agg(F.count("*").alias("n"), F.avg("net").alias("net"))
    planted = F.explode(F.array(*[F.struct(F.lit(name).alias("planted"), F.expr(f"double({ic})").alias("ic"), F.expr(f"double({live})").alias("live"), F.expr(f"int({h})").alias("h"), F.expr(f"bigint({n})").alias("n"), F.expr(f"double({net})").alias("net")) for name, ic, live, h, n, net in CASES]))
    c = g.join(e, "fold").select("fold", planted.alias("c")).select("fold", "c.*")
    rounded = lambda x: F.round(x, 6)
    # a difference of two rounded values is rounded again, so that it does not miss the bound by a bit
    verdict = mo.promotion(rounded("ic"), rounded("live"), F.col("h"), F.col("n"), rounded("net"), F.col("planted") == "forced", delta=-0.0150001)
    return c.select("fold", "planted", verdict.alias("verdict"))


HOLD = f"""hx AS (SELECT ts FROM (SELECT DISTINCT ts FROM te) QUALIFY row_number() OVER (ORDER BY ts) - 1 >= floor(count(*) OVER () * 0.4)),
hs(side, h, anchors) AS (VALUES ('long', 12, [11, 23]), ('short', 6, [5, 11, 17, 23])),
hr AS (SELECT side, ts, entity, CASE side WHEN 'long' THEN score ELSE -score END AS score, CASE side WHEN 'long' THEN ret12 ELSE -ret6 END AS ret FROM te JOIN hx USING (ts), hs WHERE list_contains(anchors, hour(ts))),
hm AS (SELECT side, ts, coalesce(bull OR side = 'short', false) AS active FROM hr LEFT JOIN regime USING (ts) GROUP BY side, ts, bull HAVING count(hr.ret) >= 5),
ho AS (SELECT hr.* FROM hr JOIN hm USING (side, ts)),
hp AS (SELECT side, ts, active, list(entity ORDER BY score DESC, entity)[1:5] AS picks, count(*) AS n FROM ho JOIN hm USING (side, ts) GROUP BY side, ts, active),
hq AS (SELECT *, coalesce(lag(CASE WHEN active THEN picks END) OVER (PARTITION BY side ORDER BY ts), []) AS before FROM hp),
hv AS (SELECT hq.side, hq.ts, len(list_filter(picks, lambda m: NOT list_contains(before, m)))::DOUBLE / len(picks) AS turnover, avg(ret) AS gross FROM hq JOIN ho ON hq.side = ho.side AND hq.ts = ho.ts AND list_contains(picks, entity) WHERE active AND len(picks) = 5 GROUP BY ALL HAVING count(ret) = 5)"""
HIC = spearman_sql("hic", "(SELECT ho.* FROM ho JOIN hm USING (side, ts) WHERE active)", "side, ts", "score", "ret")


@query("holdout_bundle", recursive(*WALK, REGIME.replace("h AS (SELECT ts, close", "rh AS (SELECT ts, close").replace("FROM h)", "FROM rh)").replace("LEFT JOIN h ", "LEFT JOIN rh "), HOLD, HIC, body="""SELECT side, n_exact, n_mature, n_active, n_ic, round(ic, 6) + 0.0::DOUBLE AS ic, n_top, round(gross, 6) + 0.0::DOUBLE AS gross, round(net, 6) + 0.0::DOUBLE AS net, round(turnover, 6) + 0.0::DOUBLE AS turnover, round(net_hit, 6) + 0.0::DOUBLE AS net_hit, round(gross_hit, 6) + 0.0::DOUBLE AS gross_hit FROM
(SELECT side, count(DISTINCT ts) AS n_exact FROM hr GROUP BY side) JOIN (SELECT side, count(*) AS n_mature, count(*) FILTER (active) AS n_active FROM hm GROUP BY side) USING (side) JOIN (SELECT side, count(ic) AS n_ic, avg(ic) AS ic FROM hic GROUP BY side) USING (side)
JOIN (SELECT side, count(*) AS n_top, avg(gross) AS gross, avg(gross - turnover * 0.002::DOUBLE) AS net, avg(turnover) AS turnover, avg((gross - turnover * 0.002::DOUBLE > 0)::INT) AS net_hit, avg((gross > 0)::INT) AS gross_hit FROM hv GROUP BY side) USING (side)"""))
def holdout_bundle(s: SparkSession, d: str) -> DataFrame:
    _, tested = walked(s, d)
    tested = kept_table(tested, "tested")
    active = regime_a(s, d).select("ts", F.col("bull").alias("active"))
    out = []
    for side, hours, anchors, sign in (("long", 12, (11, 23), 1), ("short", 6, (5, 11, 17, 23), -1)):
        slots = wf.holdout_slots(tested, 0.6, anchors, hours)
        signed = tested.select("ts", "entity", (sign * F.col("score")).alias("score"), (sign * F.col(f"ret{hours}")).alias("ret"))
        measured = wf.holdout_measures(signed.drop("ret"), signed.drop("score"), slots, active if side == "long" else None)
        out.append(measured.select(F.lit(side).alias("side"), "n_exact", "n_mature", "n_active", "n_ic", six(F.col("ic")).alias("ic"), "n_top", *[six(F.col(c)).alias(c) for c in ("gross", "net", "turnover", "net_hit", "gross_hit")]))
    return out[0].unionAll(out[1]).where("n_mature > 0 AND n_ic > 0 AND n_top > 0")  # a side that was never measured is left out


SCORE = "mt - mx * wx - my * wy + coalesce(x, 0) * wx + coalesce(y, 0) * wy"


def ridged(s: SparkSession, d: str) -> tuple[DataFrame, dict[str, float]]:
    f = learnable(s, d)
    return f, mo.ridge(f, XY, "target")


#: One model of all rows.
WHOLE = FOLDS[FOLDS.index("tr AS") :].replace(f"JOIN cal USING (ts) JOIN folds ON o >= fold * {TEST} AND o < fold * {TEST} + {TRAIN} WHERE", ", (SELECT 0 AS fold) WHERE")
WHOLE = WHOLE[: WHOLE.index("te AS")] + f"al AS (SELECT round(target, 9) + 0.0::DOUBLE AS target, intercept + list_dot_product([{', '.join(f'f{i}' for i in range(10))}], w) AS score, 0 AS one FROM uni, fw WHERE {GOOD} AND target IS NOT NULL)"


@query("insample_ic", recursive(*WALK[:-1], WHOLE, spearman_sql("aic", "al", "one", "score", "target"), body="SELECT n, round(ic, 6) + 0.0::DOUBLE AS ic FROM aic"))
def insample_ic(s: SparkSession, d: str) -> DataFrame:
    f = kept_table(unified(s, d).dropna(subset=[*TEN, "target"]), "unified")
    rows = f.select(mo.linear_score(mo.ridge(f, TEN, "target")).alias("score"), (F.round("target", 9) + F.lit(0.0)).alias("target"))  # the benchmark's own residual is zero but for rounding
    return ev.pooled_ic(rows, "score", "target").select("n", six(F.col("ic")).alias("ic"))


LAST = "lc AS (SELECT * FROM scored WHERE score IS NOT NULL AND ts = (SELECT max(ts) FROM (SELECT ts FROM scored WHERE hour(ts) IN (5, 11, 17, 23) GROUP BY ts HAVING count(fwd) >= 5)))"


@query("latest_ic", sql("a", "panel", "factors", "scored", LAST, spearman_sql("li", "lc", "ts", "score", "fwd"), body=f"SELECT {TS}, n, round(ic, 6) + 0.0::DOUBLE AS ic FROM li"))
def latest_ic(s: SparkSession, d: str) -> DataFrame:
    f = scored(factors_a(s, d)).select("ts", "entity", "score", F.col("fwd").alias("ret"))
    return shown(ev.rank_ic(wf.latest_complete(f, 5, (5, 11, 17, 23)), "score", "ret"), ["ts", "n"], ["ic"])


@query("ensemble_scores", sql(*P, RIDGE, body=f"SELECT {TS}, entity, round((({SCORE}) + list_avg([x, y])) / 2, 6) + 0.0::DOUBLE AS score FROM zs, w"))
def ensemble_scores(s: SparkSession, d: str) -> DataFrame:
    f, weights = ridged(s, d)
    return shown(f.select("ts", "entity", mo.ensemble([mo.linear_score(weights), mo.equal_weight(XY)]).alias("score")), ["ts", "entity"], ["score"])


@query("feature_shock", sql(*P, RIDGE, body=f"SELECT {TS}, round(avg(abs(wx * (x - md))), 6) + 0.0::DOUBLE AS moved FROM zs JOIN (SELECT ts, median(x) AS md FROM zs GROUP BY ts) USING (ts), w GROUP BY zs.ts"))
def feature_shock(s: SparkSession, d: str) -> DataFrame:
    f, weights = ridged(s, d)
    moved = mo.sensitivity(f, weights, XY[0], "ts").groupBy("ts").agg(F.avg(F.abs("delta")).alias("moved"))
    return shown(moved, ["ts"], ["moved"])


@query("flipped_features", sql(*P, ZS, body=f"SELECT {TS}, entity, round(-x, 6) + 0.0::DOUBLE AS momentum, round(y, 6) + 0.0::DOUBLE AS kept FROM zs"))
def flipped_features(s: SparkSession, d: str) -> DataFrame:
    f = learnable(s, d).select("ts", "entity", F.col(XY[0]).alias("reversal"), F.col(XY[1]).alias("kept"))
    return shown(mo.renamed_features(f, ["momentum", "kept"], {"momentum": "reversal"}), ["ts", "entity"], ["momentum", "kept"])


@query("outlier_rows", sql(*P, ZS, body=f"SELECT {TS}, count(*) AS n FROM zs WHERE abs(target) <= 0.5 GROUP BY zs.ts"))
def outlier_rows(s: SparkSession, d: str) -> DataFrame:
    return wf.without_outliers(learnable(s, d), "target").groupBy(stamp(F.col("ts")).alias("ts")).agg(F.count("*").alias("n"))


#: Trials by line number: a week is a window, missed where nothing was ordered on its first day, invalid
#: where something came back, pending at the end; three trials are planted without a fault.
WEEKS = """w0 AS (SELECT l_linenumber AS trial, (datediff('day', DATE '1995-01-02', l_shipdate::DATE) // 7)::BIGINT AS slot, avg(l_discount::DOUBLE) AS model, avg(l_tax::DOUBLE) AS control, bool_or(l_returnflag = 'R') AS back, max(l_returnflag) AS context FROM lineitem WHERE l_shipdate >= DATE '1995-01-02' GROUP BY ALL),
w AS (SELECT trial, slot, context, CASE WHEN trial < 4 OR slot % 17 <> 3 THEN 'recorded' ELSE 'missed' END AS status, CASE WHEN trial < 4 THEN 'matured' WHEN slot % 17 = 3 OR slot = 39 AND trial < 6 THEN NULL WHEN slot % 5 = 1 AND back THEN 'invalid' ELSE 'matured' END AS outcome,
  model + CASE trial WHEN 2 THEN -0.05::DOUBLE WHEN 3 THEN -0.01::DOUBLE ELSE 0 END AS model, control FROM w0 WHERE slot < 40),
ts AS (SELECT trial, 40 AS n_scheduled, count(*) FILTER (status = 'recorded') AS n_recorded, count(*) FILTER (outcome = 'matured') AS n_matured, count(*) FILTER (status = 'missed') AS n_missed, count(*) FILTER (outcome <> 'matured') AS n_invalid, count(outcome) AS ended,
  100 * avg(model) FILTER (outcome = 'matured') AS model_pct, 100 * avg(control) FILTER (outcome = 'matured') AS control_pct, 100 * avg(model - control) FILTER (outcome = 'matured') AS paired_excess_pct FROM w GROUP BY trial),
summary AS (SELECT *, n_recorded - ended AS n_pending, CASE WHEN n_matured = 40 THEN 'ready_for_review' WHEN ended + n_missed = 40 THEN 'incomplete_evidence' ELSE 'collecting' END AS status FROM ts)"""
PCT = ["model_pct", "control_pct", "paired_excess_pct"]
COUNTS = ["n_scheduled", "n_recorded", "n_matured", "n_missed", "n_invalid", "n_pending"]


def trial_windows(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").where("l_shipdate >= DATE '1995-01-02'")
    slot = F.floor(F.datediff("l_shipdate", F.lit("1995-01-02")) / 7)
    w = li.groupBy(F.col("l_linenumber").alias("trial"), slot.alias("slot")).agg(F.avg(F.col("l_discount").cast("double")).alias("model"), F.avg(F.col("l_tax").cast("double")).alias("control"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("back"), F.max("l_returnflag").alias("context"))
    sound, missed = F.col("trial") < 4, F.col("slot") % 17 == 3
    outcome = F.when(sound, "matured").when(missed | ((F.col("slot") == 39) & (F.col("trial") < 6)), F.lit(None)).when((F.col("slot") % 5 == 1) & (F.col("back") == 1), "invalid").otherwise("matured")
    moved = F.col("model") + F.when(F.col("trial") == 2, -0.05).when(F.col("trial") == 3, -0.01).otherwise(0.0)
    return w.where("slot < 40").select("trial", "slot", "context", F.when(sound | ~missed, "recorded").otherwise("missed").alias("status"), outcome.alias("outcome"), moved.alias("model"), "control")


@query("trial_summary", f"WITH {WEEKS} SELECT trial, {', '.join(COUNTS)}, {', '.join(f'round({c}, 6) + 0.0::DOUBLE AS {c}' for c in PCT)}, status FROM summary")
def trial_summary(s: SparkSession, d: str) -> DataFrame:
    return wf.trial_summary(trial_windows(s, d), "trial", 40).select("trial", *COUNTS, *[six(F.col(c)).alias(c) for c in PCT], "status")


@query("trial_contexts", f"WITH {WEEKS} SELECT trial, context, count(*) AS n_windows, round(100 * avg(model), 6) + 0.0::DOUBLE AS mean_net_pct FROM w WHERE outcome = 'matured' GROUP BY trial, context")
def trial_contexts(s: SparkSession, d: str) -> DataFrame:
    return wf.by_context(trial_windows(s, d), "trial", "context").select("trial", "context", "n_windows", six(F.col("mean_net_pct")).alias("mean_net_pct"))


#: Evidence and day of decision, so that each code is met: intact, day, whether an interval is there.
STATES = [("sound", "true", "1996-02-01", "true"), ("early", "true", "1995-06-01", "true"), ("late", "true", "1997-06-01", "true"), ("broken", "false", "1995-06-01", "true"), ("broken_late", "NULL", "1997-06-01", "true"), ("no_interval", "true", "1996-02-01", "false")]


@query("trial_decision", f"""WITH {WEEKS}, st(planted, intact, day, has) AS (VALUES {', '.join(f"('{n}', {i}, DATE '{t}', {h})" for n, i, t, h in STATES)}),
d AS (SELECT *, CASE WHEN has THEN paired_excess_pct - 0.3 END AS low, CASE WHEN has THEN paired_excess_pct + 0.3 END AS high, (day >= DATE '1996-01-01' AND status IN ('ready_for_review', 'incomplete_evidence')) OR day >= DATE '1997-01-01' AS terminal FROM summary, st)
SELECT trial, planted, terminal, CASE WHEN NOT coalesce(intact, false) THEN CASE WHEN terminal THEN 'integrity_failure' ELSE 'integrity_blocked' END WHEN NOT terminal THEN 'collecting' WHEN n_matured <> 40 OR n_missed > 0 OR n_invalid > 0 THEN 'insufficient_evidence'
WHEN low IS NULL THEN 'integrity_failure' WHEN low > 0 THEN 'relative_edge' WHEN high < 0 THEN 'baseline_better' ELSE 'inconclusive' END AS code FROM d""")
def trial_decision(s: SparkSession, d: str) -> DataFrame:
    planted = F.explode(F.array(*[F.struct(F.lit(n).alias("planted"), F.expr(f"boolean({i})").alias("intact"), F.expr(f"DATE '{t}'").alias("day"), F.expr(h).alias("has")) for n, i, t, h in STATES]))
    summed = wf.trial_summary(trial_windows(s, d), "trial", 40).select("*", planted.alias("p")).select("*", "p.*")
    bound = lambda by: F.when(F.col("has"), F.col("paired_excess_pct") + by)
    decided = wf.trial_decision(summed.withColumn("low", bound(-0.3)).withColumn("high", bound(0.3)), F.col("day"), F.lit("1996-01-01").cast("date"), F.lit("1997-01-01").cast("date"), F.col("intact"))
    return decided.select("trial", "planted", "terminal", "code")


@query("trial_intervals", None)
def trial_intervals(s: SparkSession, d: str) -> DataFrame:
    """The interval of the paired excess of each complete trial: 2000 draws of circular blocks of four."""
    w = trial_windows(s, d).where("trial < 4").withColumn("excess", 100 * (F.col("model") - F.col("control")))
    return sx.block_bootstrap(w, "excess", "slot", by="trial").select("trial", "n", *[six(F.col(c)).alias(c) for c in ("mean", "low", "high")])


@query("witness_rules", """WITH w AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice::DOUBLE END AS v, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS side, o_orderkey % 13 > 0 AS timely FROM orders)
SELECT rule, count(*) AS n, min(id) AS first FROM (SELECT id, unnest([CASE WHEN NOT isfinite(v) THEN 'finite' END, CASE WHEN side IS NULL OR side NOT IN ('O', 'F') THEN 'side' END, CASE WHEN NOT timely THEN 'timely' END]) AS rule FROM w) WHERE rule IS NOT NULL GROUP BY rule""")
def witness_rules(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    w = table(s, d, "orders").select(k.alias("id"), F.when(k % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice").cast("double")).alias("v"), F.when(k % 11 != 0, F.col("o_orderstatus")).alias("side"), (k % 13 > 0).alias("timely"))
    rules = {"finite": ~F.isnan("v") & (F.abs("v") < float("inf")), "side": F.col("side").isin("O", "F"), "timely": F.col("timely")}
    return wf.broken_rules(w, rules, ["id"]).groupBy("rule").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("ic_compare", """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, avg(value) FILTER (event_id % 2 = 0) AS one, avg(value) FILTER (event_id % 3 = 0) AS two FROM events GROUP BY 1), p AS (SELECT day, CASE WHEN day <> '2024-01-05' THEN one END AS one, CASE WHEN day NOT IN ('2024-01-10', '2024-01-20') THEN two END AS two FROM e)
SELECT day, round(abs(one - two), 6) + 0.0::DOUBLE AS apart, coalesce(round(abs(one - two), 6) >= 0.5, false) AS warns FROM p WHERE one IS NOT NULL OR two IS NOT NULL""")
def ic_compare(s: SparkSession, d: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    means = table(s, d, "events").groupBy(day.alias("day")).agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("one"), F.avg(F.when(F.col("event_id") % 3 == 0, F.col("value"))).alias("two"))
    one, two = (means.where(F.col(c).isNotNull() & ~F.col("day").isin(*gone)).select("day", F.col(c).alias("v")) for c, gone in (("one", ["2024-01-05"]), ("two", ["2024-01-10", "2024-01-20"])))
    return wf.compared_series(one, two, "day", "v", 0.4999995).select("day", six(F.col("apart")).alias("apart"), "warns")


@query("sign_check", """WITH r AS (SELECT l_returnflag = 'R' AS short, round(l_discount::DOUBLE - 0.05, 9) AS ledger, round(l_tax::DOUBLE - 0.04, 9) AS report FROM lineitem), c AS (SELECT short, ledger, CASE WHEN short THEN -report ELSE report END AS signed FROM r)
SELECT CASE WHEN short THEN 'SHORT' ELSE 'LONG' END AS side, abs(ledger - signed) <= 0.0200001::DOUBLE AND NOT ((ledger > 0) <> (signed > 0) AND abs(ledger) > 1e-6) AS agrees, count(*) AS n FROM c GROUP BY 1, 2""")
def sign_check(s: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("l_returnflag") == "R", "SHORT").otherwise("LONG")
    move = lambda c, by: F.round(F.col(c).cast("double") - by, 9)
    agrees = wf.consistent_sign(side, move("l_discount", 0.05), move("l_tax", 0.04), 0.0200001)
    return table(s, d, "lineitem").groupBy(side.alias("side"), agrees.alias("agrees")).agg(F.count("*").alias("n"))


@query("reviews_known", """SELECT c.c_custkey AS id, coalesce(arg_max(o_orderpriority, (o_orderdate, o_orderkey)), 'none') AS verdict FROM customer c LEFT JOIN orders o ON o_custkey = c_custkey AND o_orderdate <= TIMESTAMP '1996-01-01' AND o_orderdate + to_days((o_orderkey % 60)::INT) <= TIMESTAMP '1996-01-15' GROUP BY 1""")
def reviews_known(s: SparkSession, d: str) -> DataFrame:
    # of reviews of one time the greatest key counts
    last = F.struct(F.lit("1996-01-01").cast("timestamp_ntz").alias("at"), F.lit((1 << 63) - 1).alias("key"))
    slots = table(s, d, "customer").select(F.col("c_custkey").alias("id"), last.alias("slot_at"), F.lit("1996-01-15").cast("timestamp_ntz").alias("known_at"))
    at = F.col("o_orderdate").cast("timestamp_ntz")
    reviews = table(s, d, "orders").select(F.col("o_custkey").alias("id"), F.struct(at.alias("at"), F.col("o_orderkey").alias("key")).alias("review"), (at + F.make_interval(days=(F.col("o_orderkey") % 60).cast("int"))).alias("recorded_at"), F.col("o_orderpriority").alias("verdict"))
    return wf.latest_known(slots, reviews.withColumnRenamed("review", "review_at"), "id").select("id", F.coalesce("verdict", F.lit("none")).alias("verdict"))


@query("tagged_orders", "SELECT o_orderstatus AS side, CASE WHEN n_name < 'F' THEN 'proven' ELSE '' END AS tag, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")
def tagged_orders(s: SparkSession, d: str) -> DataFrame:
    tags = table(s, d, "nation").where("n_name < 'F'").select(F.col("n_nationkey").alias("c_nationkey"), F.lit("proven").alias("tag"))
    rows = table(s, d, "orders").join(table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderstatus", "c_nationkey")
    return wf.tagged(rows, tags, ["c_nationkey"]).groupBy(F.col("o_orderstatus").alias("side"), "tag").agg(F.count("*").alias("n"))


@query("content_join", "SELECT a.doc_id AS report, b.doc_id AS witness FROM documents a JOIN documents b ON sha256(a.text) = sha256(b.text) WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1")
def content_join(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    reports, witnesses = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("report"), "text"), docs.where("doc_id % 2 = 1").select(F.col("doc_id").alias("id"), "text")
    return wf.by_content(reports, witnesses, "text").select("report", "witness")


@query("rebalance_slots", "SELECT (hour(ts) - 11) % 12 = 0 AS due, count(*) AS n, strftime(min(date_trunc('hour', ts) + to_hours((12 - (hour(ts) + 1) % 12)::INT)), '%Y-%m-%d %H:%M') AS next, count(*) AS always FROM events GROUP BY 1")
def rebalance_slots(s: SparkSession, d: str) -> DataFrame:
    due, after = wf.rebalance_clock(F.col("ts"), 12, 11)
    always, _ = wf.rebalance_clock(F.col("ts"), 0, 11)
    rows = table(s, d, "events").select(due.alias("due"), after.alias("next"), always.alias("always"))
    return rows.groupBy("due").agg(F.count("*").alias("n"), F.date_format(F.min("next"), "yyyy-MM-dd HH:mm").alias("next"), F.count_if("always").alias("always"))


@query("universe_counts", recursive("b", "panel", "factors", WEEKLY, SLOTS, FOLD, """pk AS (SELECT ts, 'long' AS side, unnest(longs) AS entity FROM fold UNION ALL SELECT ts, 'short', unnest(shorts) FROM fold),
dv AS (SELECT entity, quantile_cont(v, 0.5) AS median_volume FROM (SELECT (l_partkey % 40)::VARCHAR AS entity, l_shipdate::DATE AS day, sum(l_quantity::DOUBLE) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1)""",
    body="SELECT side, entity, count(DISTINCT ts) AS appearances, row_number() OVER (PARTITION BY side ORDER BY count(DISTINCT ts) DESC, entity) AS place, round(any_value(median_volume), 6) AS median_volume, coalesce(any_value(median_volume) < 31, true) AS low FROM pk LEFT JOIN dv USING (entity) GROUP BY side, entity"))
def universe_counts(s: SparkSession, d: str) -> DataFrame:
    held = baskets(s, d)
    picks = held.select("ts", F.lit("long").alias("side"), F.explode("longs").alias("entity")).unionAll(held.select("ts", F.lit("short"), F.explode("shorts")))
    bars = table(s, d, "lineitem").select(F.col("l_shipdate").alias("ts"), (F.col("l_partkey") % 40).cast("string").alias("entity"), F.col("l_quantity").cast("double").alias("volume"))
    return wf.universe_audit(picks, bars, 31).select("side", "entity", "appearances", F.col("place").cast("bigint").alias("place"), F.round("median_volume", 6).alias("median_volume"), "low")


@query("grid_counts", """WITH g AS (SELECT unnest(range(0, 2600)) AS slot), s AS (SELECT (datediff('day', DATE '1992-01-01', o_orderdate::DATE))::BIGINT AS slot, min((o_orderkey % 4 = 0)::INT) = 1 AS late FROM orders GROUP BY 1)
SELECT CASE WHEN g.slot IS NULL THEN 'unexpected' WHEN late IS NULL THEN 'missing' WHEN late THEN 'late' ELSE 'on_time' END AS status, count(*) AS n FROM g FULL JOIN s ON g.slot = s.slot GROUP BY 1""")
def grid_counts(s: SparkSession, d: str) -> DataFrame:
    seen = table(s, d, "orders").select(F.datediff("o_orderdate", F.lit("1992-01-01")).cast("bigint").alias("slot"), (F.col("o_orderkey") % 4 == 0).alias("late"))
    return wf.grid_status(s.range(2600).withColumnRenamed("id", "slot"), seen, "slot")


@query("health_sides", "SELECT o_orderstatus AS side, count(*) FILTER (o_orderdate > m - INTERVAL 30 DAY) AS last_30, count(*) FILTER (o_orderdate > m - INTERVAL 7 DAY) AS last_7, round(avg(o_totalprice::DOUBLE) FILTER (o_orderdate > m - INTERVAL 30 DAY), 4) AS mean FROM orders, (SELECT max(o_orderdate) AS m FROM orders) GROUP BY 1")
def health_sides(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    o = o.crossJoin(F.broadcast(o.agg(F.max("o_orderdate").alias("m")))).withColumn("age", F.datediff("m", "o_orderdate"))
    return o.groupBy(F.col("o_orderstatus").alias("side")).agg(F.count_if(F.col("age") < 30).alias("last_30"), F.count_if(F.col("age") < 7).alias("last_7"), F.round(F.avg(F.when(F.col("age") < 30, F.col("o_totalprice").cast("double"))), 4).alias("mean"))
