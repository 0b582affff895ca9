"""Calibration, book, state, statistics, model and streaming queries with their SQL."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosspanel.functions.columns import dirty_bool, six, stamp
from crosspanel.operators import books as bo
from crosspanel.operators import calibration as ca
from crosspanel.operators import factors as fa
from crosspanel.operators import ledger as le
from crosspanel.operators import models as mo
from crosspanel.operators import portfolio as po
from crosspanel.operators import state as st
from crosspanel.operators import statistics as sx
from crosspanel.plans.ledger_queries import P, recommendations, recursive, weekly_scores
from crosspanel.plans.panel_queries import FACTORS, TS, factors_a, ics_a, panel_b, shown, six_sql, sql
from crosspanel.sources.bars import hourly
from crosspanel.sources.tables import scratch, table
from crosspanel.streaming import events as se

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def at(text: str):  # noqa: ANN201
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


CAL = """sg AS (SELECT *, abs(score) / nullif(stddev_samp(score) OVER (PARTITION BY ts), 0) AS sigma FROM weekly WHERE score IS NOT NULL),
sb AS (SELECT *, CASE WHEN sigma >= 2 THEN 4 WHEN sigma >= 1.5 THEN 3 WHEN sigma >= 1 THEN 2 WHEN sigma >= 0.5 THEN 1 ELSE 0 END AS bucket FROM sg WHERE ret IS NOT NULL AND sigma IS NOT NULL),
cal AS (SELECT bucket, count(*) AS n, avg((sign(score) = sign(ret))::INT) AS hit_rate, 100 * avg(sign(score) * ret) AS mean_signed_pct, 100 * avg(abs(ret)) AS mean_abs_pct, 100 * coalesce(stddev_samp(ret), 0) AS std_pct FROM sb GROUP BY bucket)"""
CALS = ["hit_rate", "mean_signed_pct", "mean_abs_pct", "std_pct"]


@query("sigma_calibration", sql(*P, CAL, body=f"SELECT bucket, n, {six_sql(*CALS)} FROM cal"))
def sigma_calibration(s, d):  # noqa: ANN001, ANN201
    return shown(ca.calibrate(weekly_scores(s, d)), ["bucket", "n"], CALS)


def latest(frame: DataFrame) -> DataFrame:
    return frame.join(F.broadcast(frame.agg(F.max("ts").alias("ts"))), "ts", "left_semi")


PRED = """vol AS (SELECT entity, stddev_pop(r) * sqrt(6.0::DOUBLE) AS volatility FROM (SELECT entity, close / nullif(lag(close) OVER e, 0) - 1 AS r, row_number() OVER (PARTITION BY entity ORDER BY ts DESC) AS back FROM panel WINDOW e AS (PARTITION BY entity ORDER BY ts)) WHERE back <= 72 GROUP BY entity),
lt AS (SELECT *, abs(score) / nullif(stddev_samp(score) OVER (), 0) AS sigma FROM weekly WHERE ts = (SELECT max(ts) FROM weekly) AND score IS NOT NULL),
lb AS (SELECT *, CASE WHEN sigma >= 2 THEN 4 WHEN sigma >= 1.5 THEN 3 WHEN sigma >= 1 THEN 2 WHEN sigma >= 0.5 THEN 1 ELSE 0 END AS bucket, CASE WHEN score > 0 THEN 1 ELSE -1 END AS direction FROM lt),
pd AS (SELECT lb.entity, direction, sigma, CASE WHEN sigma >= 2 THEN 'strong' WHEN sigma >= 1 THEN 'normal' WHEN sigma >= 0.5 THEN 'weak' ELSE 'noise' END AS tier, direction * mean_signed_pct AS expected_pct, direction * mean_signed_pct - 1.96::DOUBLE * coalesce(volatility * 100, std_pct) AS ci_low FROM lb LEFT JOIN cal USING (bucket) LEFT JOIN vol ON vol.entity = lb.entity)"""


@query("predict_batch", sql(*P, CAL, PRED, body=f"SELECT entity, direction, tier, {six_sql('sigma', 'expected_pct', 'ci_low')} FROM pd"))
def predict_batch(s, d):  # noqa: ANN001, ANN201
    w = weekly_scores(s, d)
    p = ca.predict(latest(w).select("entity", "score"), ca.calibrate(w), ca.realized_volatility(panel_b(s, d), 6))
    return shown(p, ["entity", "direction", "tier"], ["sigma", "expected_pct", "ci_low"])


@query("consensus", sql("b", "panel", "factors", body="SELECT entity, CASE WHEN reversal_1h > 0 THEN 1 ELSE -1 END AS direction, reversal_1h IS NOT NULL AND reversal_4h IS NOT NULL AND (reversal_1h > 0) = (reversal_4h > 0) AS consensus FROM factors WHERE ts = (SELECT max(ts) FROM factors)"))
def consensus(s, d):  # noqa: ANN001, ANN201
    f = latest(fa.price_factors(panel_b(s, d)))
    way = lambda c: f.where(F.col(c).isNotNull()).select("entity", F.when(F.col(c) > 0, 1).otherwise(-1).alias("direction"))
    return ca.consensus(way("reversal_1h"), way("reversal_4h"))


def six_hours(ts):  # noqa: ANN001, ANN201
    """The six-hour slot a timestamp lies in."""
    return (F.date_trunc("day", ts).cast("timestamp_ntz") + F.make_interval(hours=(F.floor(F.hour(ts) / 6) * 6).cast("int"))).alias("slot")


SLOT6 = "date_trunc('day', ts) + to_hours((hour(ts) // 6 * 6)::INT)"


@query("capture_deadline", f"""WITH grid AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 6 HOUR)) AS slot), rec AS (SELECT {SLOT6} AS slot, ts FROM events WHERE event_type = 'signup'),
g AS (SELECT slot, min(CASE WHEN ts >= slot AND ts <= slot + INTERVAL 45 MINUTE THEN ts END) AS r, count(ts) AS n FROM grid LEFT JOIN rec USING (slot) GROUP BY slot)
SELECT strftime(slot, '%Y-%m-%d %H:%M') AS slot, CASE WHEN r IS NOT NULL THEN 'recorded' WHEN n > 0 THEN 'late' ELSE 'missed' END AS status FROM g""")
def capture_deadline(s, d):  # noqa: ANN001, ANN201
    grid = s.range(1).select(F.explode(le.slots("2024-01-01 00:00:00", "2024-01-30 00:00:00", 6)).alias("slot"))
    rec = table(s, d, "events").where("event_type = 'signup'").select(six_hours(F.col("ts")), F.col("ts").alias("recorded_at"))
    return le.captured(grid, rec, 45).select(stamp(F.col("slot")).alias("slot"), "status")


@query("first_witness", f"SELECT strftime({SLOT6}, '%Y-%m-%d %H:%M') AS slot, arg_min(event_id, ts) AS event_id FROM events GROUP BY 1")
def first_witness(s, d):  # noqa: ANN001, ANN201
    rec = table(s, d, "events").select(six_hours(F.col("ts")), F.col("ts").alias("recorded_at"), F.col("event_id").alias("digest"))
    return le.first_witness(rec).select(stamp(F.col("slot")).alias("slot"), F.col("digest").alias("event_id"))


@query("maturity", f"""WITH s AS (SELECT DISTINCT {SLOT6} AS slot FROM events) SELECT CASE WHEN TIMESTAMP '2024-01-20 12:00' < slot + INTERVAL 8 HOUR THEN 'waiting' WHEN TIMESTAMP '2024-01-20 12:00' <= slot + INTERVAL 55 HOUR THEN 'due' ELSE 'expired' END AS status, count(*) AS n FROM s GROUP BY 1""")
def maturity(s, d):  # noqa: ANN001, ANN201
    slots = table(s, d, "events").select(six_hours(F.col("ts"))).distinct()
    return slots.groupBy(le.maturity(F.col("slot"), at("2024-01-20 12:00:00")).alias("status")).agg(F.count("*").alias("n"))


@query("event_journal", """WITH e AS (SELECT user_id AS c, ts, CASE WHEN event_type = 'error' THEN 'e' || (event_id % 3) END AS error FROM events),
f AS (SELECT *, CASE WHEN error IS NULL THEN 'recovered' ELSE 'error' END AS state, max((error IS NOT NULL)::INT) OVER (PARTITION BY c ORDER BY ts) AS seen FROM e),
g AS (SELECT *, lag(state) OVER w AS ps, lag(error) OVER w AS pe FROM f WHERE seen = 1 WINDOW w AS (PARTITION BY c ORDER BY ts))
SELECT c AS "case", row_number() OVER (PARTITION BY c ORDER BY ts) AS sequence, state, error FROM g WHERE ps IS NULL OR ps <> state OR pe IS DISTINCT FROM error""")
def event_journal(s, d):  # noqa: ANN001, ANN201
    e = table(s, d, "events").select(F.col("user_id").alias("case"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), (F.col("event_id") % 3).cast("string"))).alias("error"))
    return le.journal(e).select("case", "sequence", "state", "error")


@query("exact_returns", sql("a", "sl AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-05 05:00', TIMESTAMP '2024-01-25 05:00', INTERVAL 6 HOUR)) AS slot)", "x AS (SELECT slot, entity, close AS e FROM sl JOIN bars ON ts = slot + INTERVAL 1 HOUR)", "y AS (SELECT slot, entity, close AS f FROM sl JOIN bars ON ts = slot + INTERVAL 7 HOUR)",
    body="SELECT strftime(slot, '%Y-%m-%d %H:%M') AS slot, entity, round(f / e - 1, 6) + 0.0::DOUBLE AS ret, CASE WHEN f / e IS NULL THEN 'invalid' ELSE 'evaluated' END AS status FROM x FULL JOIN y USING (slot, entity)"))
def exact_returns(s, d):  # noqa: ANN001, ANN201
    slots = s.range(1).select(F.explode(le.slots("2024-01-05 05:00:00", "2024-01-25 05:00:00", 6)).alias("slot"))
    return le.exact_returns(hourly(s, d), slots, 1, 6).select(stamp(F.col("slot")).alias("slot"), "entity", six(F.col("ret")).alias("ret"), "status")


BOOK = """lv AS (SELECT l_orderkey AS key, l_linenumber % 2 AS side, l_extendedprice / l_quantity AS price, l_quantity AS size FROM lineitem),
bk AS (SELECT key, count(*) FILTER (side = 1) AS nb, count(*) FILTER (side = 0) AS na, count(DISTINCT price) FILTER (side = 1) AS db, count(DISTINCT price) FILTER (side = 0) AS da, max(price) FILTER (side = 1) AS bid, min(price) FILTER (side = 0) AS ask FROM lv GROUP BY key),
q AS (SELECT *, 20000.0::DOUBLE / bid AS qty FROM bk WHERE nb > 0 AND na > 0),
cu AS (SELECT lv.key, side, price, size, qty, coalesce(sum(size) OVER (PARTITION BY lv.key, side ORDER BY CASE side WHEN 1 THEN -price ELSE price END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lv JOIN q USING (key)),
tk AS (SELECT key, sum(least(size, greatest(0, qty - before)) * price) FILTER (side = 1) AS proceeds, sum(least(size, greatest(0, qty - before)) * price) FILTER (side = 0) AS expense, sum(size) FILTER (side = 1) AS tb, sum(size) FILTER (side = 0) AS ta FROM cu GROUP BY key),
rs AS (SELECT key, CASE WHEN nb > db OR na > da THEN 'invalid' WHEN tb < qty - qty * 1e-12 OR ta < qty - qty * 1e-12 THEN 'insufficient_depth' ELSE 'evaluated' END AS status, proceeds, expense, qty, bid, ask FROM q JOIN tk USING (key))"""


@query("book_vwap", sql(BOOK, body="""SELECT key, status, round(CASE WHEN status = 'evaluated' THEN 100 * (1 - expense / proceeds - 0.0022::DOUBLE) END, 6) + 0.0::DOUBLE AS net_pct, round(CASE WHEN status = 'evaluated' THEN proceeds / qty END, 7) AS entry_vwap FROM rs"""))
def book_vwap(s, d):  # noqa: ANN001, ANN201
    lv = table(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") % 2 == 1).alias("bid"), F.struct((F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size")).alias("level"))
    b = lv.groupBy("key").agg(F.sort_array(F.collect_list(F.when(F.col("bid"), F.col("level"))), asc=False).alias("bids"), F.sort_array(F.collect_list(F.when(~F.col("bid"), F.col("level")))).alias("asks"))
    books = b.where((F.size("bids") > 0) & (F.size("asks") > 0))
    return bo.depth_cost(books, 20_000.0, 22.0).select("key", "status", six(F.col("net_pct")).alias("net_pct"), F.round("entry_vwap", 7).alias("entry_vwap"))


@query("funding_window", sql("a", """held AS (SELECT entity || '/' || strftime(day, '%m-%d') AS key, entity, day + INTERVAL 330 MINUTE AS a, day + INTERVAL 750 MINUTE AS b FROM (SELECT DISTINCT entity FROM bars), (SELECT unnest(generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS day)),
rt AS (SELECT entity, ts AS tm, close / 1e6 AS rate, lead(ts) OVER (PARTITION BY entity ORDER BY ts) AS nx FROM bars WHERE hour(ts) % 2 = 0), sp AS (SELECT entity, min(tm) AS lo, max(tm) AS hi FROM rt GROUP BY entity),
j AS (SELECT key, coalesce(sum(rate) FILTER (tm > a AND tm <= b), 0) AS rate, count(*) FILTER (tm > a AND tm <= b) AS n, coalesce(bool_or(tm < b AND nx > a AND epoch(nx) - epoch(tm) > 5 * 3600), false) AS gap, coalesce(bool_or(least(abs(epoch(tm) - epoch(a)), abs(epoch(tm) - epoch(b))) <= 1800), false) AS edge FROM held JOIN rt USING (entity) GROUP BY key),
o AS (SELECT held.key, coalesce(j.n, 0) AS n, j.rate, CASE WHEN NOT coalesce(lo <= a AND b <= hi, false) THEN 'unbracketed' WHEN gap THEN 'gap' WHEN edge THEN 'boundary_uncertain' ELSE 'observed' END AS status FROM held LEFT JOIN sp USING (entity) LEFT JOIN j ON held.key = j.key)""",
    body="SELECT key, status, round(CASE WHEN status = 'observed' THEN rate * 10000 END, 6) AS rate_sum_bps FROM o"))
def funding_window(s, d):  # noqa: ANN001, ANN201
    b = hourly(s, d)
    days = s.range(1).select(F.explode(le.slots("2023-12-31 00:00:00", "2024-01-30 00:00:00", 24)).alias("day"))
    held = b.select("entity").distinct().crossJoin(days)
    held = held.select(F.concat_ws("/", "entity", F.date_format("day", "MM-dd")).alias("key"), "entity", (F.col("day") + F.expr("INTERVAL 330 MINUTES")).alias("entry_at"), (F.col("day") + F.expr("INTERVAL 750 MINUTES")).alias("exit_at"))
    rates = b.where(F.hour("ts") % 2 == 0).select("entity", F.col("ts").alias("at"), (F.col("close") / 1e6).alias("rate"))
    return bo.funding(held, rates, 5, 1800).select("key", "status", F.round("rate_sum_bps", 6).alias("rate_sum_bps"))


@query("quote_rules", """WITH q AS (SELECT l_extendedprice * (1 - l_discount) - 5000 AS bid, l_extendedprice * (1 - 2 * l_tax) - 4000 AS ask, l_quantity - 1 AS bs, l_quantity - 2 AS sz FROM lineitem)
SELECT 'bid' AS rule, count(*) AS n FROM q WHERE NOT bid > 0 UNION ALL SELECT 'ask', count(*) FROM q WHERE NOT ask > 0 UNION ALL SELECT 'crossed', count(*) FROM q WHERE bid > ask UNION ALL SELECT 'size', count(*) FROM q WHERE NOT (bs > 0 AND sz > 0)""")
def quote_rules(s, d):  # noqa: ANN001, ANN201
    li = table(s, d, "lineitem")
    q = li.select(F.col("l_orderkey").alias("key"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) - 5000).alias("bid"), (F.col("l_extendedprice") * (1 - 2 * F.col("l_tax")) - 4000).alias("ask"), (F.col("l_quantity") - 1).alias("bid_size"), (F.col("l_quantity") - 2).alias("ask_size"))
    return bo.quote_checks(q).groupBy("rule").agg(F.count("*").alias("n"))


PICKS = """pk AS (SELECT ts, entity, ret FROM weekly WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ts ORDER BY score, entity) <= 5), ok AS (SELECT * FROM pk WHERE ret IS NOT NULL)"""


def picked(s: SparkSession, d: str) -> DataFrame:
    return po.top_k(weekly_scores(s, d), 5, True).where("ret IS NOT NULL")


@query("trial_groups", sql(*P, PICKS, "ws AS (SELECT ts, avg(ret) AS m FROM ok GROUP BY ts), wk AS (SELECT *, ntile(3) OVER (ORDER BY ts) AS third, CASE WHEN month(ts) <= 6 THEN 'first' ELSE 'second' END AS regime FROM ws)",
    body="""SELECT "group", count(*) AS n, round(avg(m), 6) + 0.0::DOUBLE AS mean FROM (SELECT m, unnest(['regime:' || regime, 'third:' || third, 'hour:' || hour(ts)]) AS "group" FROM wk) GROUP BY 1"""))
def trial_groups(s, d):  # noqa: ANN001, ANN201
    w = picked(s, d).groupBy("ts").agg(F.avg("ret").alias("m")).withColumn("regime", F.when(F.month("ts") <= 6, "first").otherwise("second"))
    return shown(sx.trial_groups(w, "m", "ts"), ["group", "n"], ["mean"])


@query("coin_attribution", sql(*P, PICKS, body="SELECT entity, count(*) AS n, round(sum(ret / c) / (SELECT count(DISTINCT ts) FROM ok), 6) + 0.0::DOUBLE AS contribution FROM (SELECT *, count(*) OVER (PARTITION BY ts) AS c FROM ok) GROUP BY entity"))
def coin_attribution(s, d):  # noqa: ANN001, ANN201
    return shown(sx.attribution(picked(s, d), "ret"), ["entity", "n"], ["contribution"])


@query("selection_trace", sql(*P, """tr AS (SELECT ts, entity, score, entity::INT % 5 <> 0 AS tradable FROM weekly WHERE score IS NOT NULL),
sel AS (SELECT *, tradable AND row_number() OVER (PARTITION BY ts, tradable ORDER BY score, entity DESC) <= 6 AS selected FROM tr), pv AS (SELECT *, coalesce(lag(selected) OVER (PARTITION BY entity ORDER BY ts), false) AS previous FROM sel),
rk AS (SELECT *, rank() OVER (PARTITION BY ts, tradable ORDER BY score) AS er, row_number() OVER (PARTITION BY ts, tradable ORDER BY score, entity) AS place FROM pv)""",
    body="SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT tradable THEN 'not_tradable' WHEN selected AND previous AND place > 5 AND er > 5 THEN 'buffer_retained' WHEN selected AND place > 5 AND er <= 5 THEN 'selected_tie' WHEN selected THEN 'selected_rank' ELSE 'outside_selection' END AS reason FROM rk) GROUP BY reason"))
def selection_trace(s, d):  # noqa: ANN001, ANN201
    t = weekly_scores(s, d).where("score IS NOT NULL").select("ts", "entity", "score", (F.col("entity").cast("int") % 5 != 0).alias("tradable"))
    t = t.withColumn("selected", F.col("tradable") & (F.row_number().over(Window.partitionBy("ts", "tradable").orderBy("score", F.desc("entity"))) <= 6))
    t = t.withColumn("previous", F.coalesce(F.lag("selected").over(Window.partitionBy("entity").orderBy("ts")), F.lit(False)))
    return st.selection_trace(t).groupBy("reason").agg(F.count("*").alias("n"))


ROT = """rec AS (SELECT ts AS sig, ts + to_minutes((event_id % 60)::INT) AS rec, ts + INTERVAL 9 HOUR AS ev, event_type AS regime, value % 10 AS m, (value * 7) % 10 AS b FROM events WHERE event_type IN ('view', 'click', 'purchase')),
ok AS (SELECT * FROM rec WHERE rec <= sig + INTERVAL 45 MINUTE), mon AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-08', TIMESTAMP '2024-02-12', INTERVAL 7 DAY)) AS review_at),
evd AS (SELECT review_at, regime, count(*) AS n, count(DISTINCT sig::DATE) AS days, avg(m - b) AS diff FROM mon JOIN ok ON ev < review_at AND sig >= review_at - INTERVAL 10 DAY GROUP BY 1, 2),
rv AS (SELECT review_at, regime, n, days, diff, row_number() OVER (PARTITION BY regime ORDER BY review_at) AS k FROM mon CROSS JOIN (SELECT DISTINCT regime FROM evd) LEFT JOIN evd USING (review_at, regime)),
fold(k, regime, review_at, policy, candidate, streak, changed, reason) AS (SELECT 0::BIGINT, regime, NULL::TIMESTAMP, 'model', 'model', 0, NULL::TIMESTAMP, '' FROM (SELECT DISTINCT regime FROM rv)
UNION ALL SELECT k, regime, review_at, CASE WHEN chg THEN cand ELSE policy END, cand, CASE WHEN chg THEN 0 ELSE stk END, CASE WHEN chg THEN review_at ELSE changed END,
  CASE WHEN NOT ready THEN 'insufficient_data' WHEN chg THEN 'changed' WHEN cand <> policy AND cool THEN 'cooldown' WHEN cand <> policy THEN 'await_confirmation' ELSE 'retain' END FROM (
SELECT *, cand <> policy AND stk >= 2 AND NOT cool AS chg FROM (
SELECT *, CASE WHEN cand <> policy THEN CASE WHEN coalesce(review_at = last + INTERVAL 7 DAY, false) AND oldcand = cand THEN streak ELSE 0 END + 1 ELSE 0 END AS stk FROM (
SELECT r.k, r.regime, r.review_at, f.review_at AS last, f.policy, f.candidate AS oldcand, f.streak, f.changed, coalesce(r.n >= 20 AND r.days >= 3, false) AS ready, coalesce(r.review_at < f.changed + INTERVAL 14 DAY, false) AS cool,
  CASE WHEN coalesce(r.n >= 20 AND r.days >= 3, false) AND f.policy = 'model' AND r.diff <= -0.01 THEN 'reversal' WHEN coalesce(r.n >= 20 AND r.days >= 3, false) AND f.policy = 'reversal' AND r.diff >= 0.01 THEN 'model' ELSE f.policy END AS cand FROM fold f JOIN rv r ON r.k = f.k + 1 AND r.regime = f.regime))))"""


@query("weekly_rotation", recursive(ROT, body="SELECT regime, strftime(review_at, '%Y-%m-%d') AS review_at, policy, streak, reason FROM fold WHERE k > 0"))
def weekly_rotation(s, d):  # noqa: ANN001, ANN201
    e = table(s, d, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    rec = e.select(F.col("ts").alias("signal_at"), (F.col("ts") + F.make_interval(mins=(F.col("event_id") % 60).cast("int"))).alias("recorded_at"), (F.col("ts") + F.expr("INTERVAL 9 HOURS")).alias("evaluated_at"), F.col("event_type").alias("regime"), (F.col("value") % 10).alias("model_net"), ((F.col("value") * 7) % 10).alias("baseline_net"))
    reviews = s.range(1).select(F.explode(le.slots("2024-01-08 00:00:00", "2024-02-12 00:00:00", 168)).alias("review_at"))
    evidence = st.weekly_evidence(rec, 10)
    return st.rotation(evidence, reviews, 20, 3, 0.01).select("regime", F.date_format("review_at", "yyyy-MM-dd").alias("review_at"), "policy", "streak", "reason")


@query("gate_shadow", sql("a", "panel", "factors", "scored", "ics", "l AS (SELECT ts, ic FROM ics WHERE ts <= TIMESTAMP '2024-01-25 12:00' - INTERVAL 8 HOUR ORDER BY ts DESC LIMIT 3)",
    body="SELECT count(*) AS n, round(min(ic), 6) + 0.0::DOUBLE AS least_ic, CASE WHEN count(*) = 3 AND count(ic) = 3 THEN 'comparable' ELSE 'unavailable' END AS status FROM l"))
def gate_shadow(s, d):  # noqa: ANN001, ANN201
    ics = ics_a(s, d).select(F.col("ts").alias("slot"), F.lit("evaluated").alias("status"), "ic", F.lit("m").alias("model"))
    return shown(st.gate_shadow(ics.select("slot"), ics, at("2024-01-25 12:00:00")), ["n", "status"], ["least_ic"])


@query("stage_acceptance", """WITH st AS (SELECT l_orderkey AS k, CASE WHEN l_returnflag <> 'R' THEN 'passed' WHEN l_linestatus = 'F' OR TIMESTAMP '1998-06-01' > l_shipdate + INTERVAL 30 DAY THEN 'failed' ELSE 'waiting' END AS status FROM lineitem)
SELECT status, count(*) AS n FROM (SELECT k, CASE WHEN bool_or(status = 'waiting') THEN 'observing' WHEN bool_and(status = 'passed') THEN 'complete' ELSE 'closed_with_gaps' END AS status FROM st GROUP BY k) GROUP BY status""")
def stage_acceptance(s, d):  # noqa: ANN001, ANN201
    li = table(s, d, "lineitem")
    ev = li.select(F.expr("TIMESTAMP_NTZ '1990-01-01 00:00:00'").alias("begun"), F.col("l_orderkey").alias("key"), (F.col("l_returnflag") != "R").alias("passed"), (F.col("l_linestatus") == "F").alias("terminal"), (F.col("l_shipdate") + F.expr("INTERVAL 30 DAYS")).alias("deadline"))
    staged = st.stages(ev, at("1998-06-01 00:00:00")).groupBy("key", "begun").agg(F.max((F.col("status") == "waiting").cast("int")).alias("open"), F.min((F.col("status") == "passed").cast("int")).alias("clean"))
    status = F.when(F.col("open") == 1, "observing").when(F.col("clean") == 1, "complete").otherwise("closed_with_gaps")
    return staged.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("deadlines", """WITH x AS (SELECT o_orderkey AS id, (epoch(o_orderdate) - epoch(TIMESTAMP '1998-02-01')) / 86400.0::DOUBLE AS left_, o_orderstatus = 'F' AS done FROM orders)
SELECT id, CASE WHEN done THEN 'done' WHEN left_ <= 0 THEN 'overdue' ELSE 'pending' END AS status, round(left_, 6) + 0.0::DOUBLE AS days_left, coalesce(CASE WHEN NOT done AND left_ > 0 THEN list_min(list_filter([1, 3, 7, 30], lambda n: left_ <= n)) END, -1) AS remind FROM x""")
def deadlines(s, d):  # noqa: ANN001, ANN201
    items = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("due"), (F.col("o_orderstatus") == "F").alias("done"), F.array(*[F.lit(n) for n in (1, 3, 7, 30)]).alias("remind_days"))
    return st.deadlines(items, at("1998-02-01 00:00:00")).select("id", "status", six(F.col("days_left")).alias("days_left"), F.coalesce("remind", F.lit(-1)).alias("remind"))


@query("dirty_values", """SELECT count(*) FILTER (t IN ('true', '1', 'yes', 'y', 't')) AS n_true, count(*) FILTER (t IN ('false', '0', 'no', 'n', 'f', '')) AS n_false, count(*) FILTER (NOT (t IN ('true', '1', 'yes', 'y', 't') OR t IN ('false', '0', 'no', 'n', 'f', ''))) AS n_null
FROM (SELECT lower(trim([' True', '0', 'maybe', 'YES '][1 + event_id % 4])) AS t FROM events)""")
def dirty_values(s, d):  # noqa: ANN001, ANN201
    raw = F.element_at(F.array(*[F.lit(x) for x in (" True", "0", "maybe", "YES ")]), (F.col("event_id") % 4 + 1).cast("int"))
    e = table(s, d, "events").select(dirty_bool(raw).alias("b"))
    return e.agg(F.count(F.when(F.col("b"), 1)).alias("n_true"), F.count(F.when(~F.col("b"), 1)).alias("n_false"), F.count(F.when(F.col("b").isNull(), 1)).alias("n_null"))


@query("event_props", "SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def event_props(s, d):  # noqa: ANN001, ANN201
    e = table(s, d, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"))


Z2 = (NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.8)) ** 2
POWER = f"""v AS (SELECT avg(ret) * 100 AS v, row_number() OVER (ORDER BY ts) - 1 AS i FROM ok GROUP BY ts), c AS (SELECT count(*) AS n FROM v),
bs AS (SELECT len, sum(v.v) AS total FROM (SELECT unnest([4, 8]) AS len) JOIN (SELECT unnest(range(8)) AS o) ON o < len CROSS JOIN v CROSS JOIN c GROUP BY len, (v.i - o + n) % n), bv AS (SELECT var_samp(total) / len AS variance FROM bs GROUP BY len UNION ALL SELECT var_samp(v) FROM v),
pt AS (SELECT effect, multiplier, 4 * ceil(greatest(8, ceil({Z2!r}::DOUBLE * (SELECT max(variance) FROM bv) * multiplier / (effect * effect))) / 4) AS n FROM (SELECT unnest([0.1::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE]) AS effect), (SELECT unnest([1.0::DOUBLE, 1.5::DOUBLE, 2.0::DOUBLE]) AS multiplier))"""


@query("power_table", sql(*P, PICKS, POWER, body="SELECT effect, multiplier, n::BIGINT AS n_windows FROM pt"))
def power_table(s, d):  # noqa: ANN001, ANN201
    w = picked(s, d).groupBy("ts").agg((F.avg("ret") * 100).alias("v"))
    return sx.power_table(w, "v", "ts").select("effect", "multiplier", "n_windows")


@query("block_bootstrap_ci", None)
def block_bootstrap_ci(s, d):  # noqa: ANN001, ANN201
    w = picked(s, d).groupBy("ts").agg(F.avg("ret").alias("v"))
    return shown(sx.block_bootstrap(w, "v", "ts"), ["n"], ["mean", "low", "high"])


@query("equal_weight_scores", sql("a", "panel", "factors", body=f"SELECT {TS}, entity, round(list_avg([reversal_1h, reversal_4h, order_flow_bear]), 6) + 0.0::DOUBLE AS score FROM factors"))
def equal_weight_scores(s, d):  # noqa: ANN001, ANN201
    return shown(factors_a(s, d).select("ts", "entity", mo.equal_weight(["reversal_1h", "reversal_4h", "order_flow_bear"]).alias("score")), ["ts", "entity"], ["score"])


def learnable(s: SparkSession, d: str) -> DataFrame:
    f = fa.price_factors(panel_b(s, d)).withColumn("target", fa.forward_return("close", 1))
    return fa.zscored(f.select("ts", "entity", "target", *FACTORS[:2]), FACTORS[:2])


RIDGE = """zs AS (SELECT ts, entity, lead(close) OVER (PARTITION BY entity ORDER BY ts) / nullif(close, 0) - 1 AS target, CASE WHEN reversal_1h IS NOT NULL AND stddev_samp(reversal_1h) OVER t > 0 THEN least(greatest((reversal_1h - avg(reversal_1h) OVER t) / stddev_samp(reversal_1h) OVER t, -3), 3) END AS x,
  CASE WHEN reversal_4h IS NOT NULL AND stddev_samp(reversal_4h) OVER t > 0 THEN least(greatest((reversal_4h - avg(reversal_4h) OVER t) / stddev_samp(reversal_4h) OVER t, -3), 3) END AS y FROM factors WINDOW t AS (PARTITION BY ts)),
m AS (SELECT regr_sxx(x, x) AS xx, regr_sxx(y, y) AS yy, regr_sxy(x, y) AS xy, regr_sxy(target, x) AS tx, regr_sxy(target, y) AS ty, avg(x) AS mx, avg(y) AS my, avg(target) AS mt FROM zs WHERE target IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL),
w AS (SELECT (tx * (yy + 1) - ty * xy) / ((xx + 1) * (yy + 1) - xy * xy) AS wx, (ty * (xx + 1) - tx * xy) / ((xx + 1) * (yy + 1) - xy * xy) AS wy, mx, my, mt FROM m)"""


@query("ridge_scores", sql("b", "panel", "factors", RIDGE, body=f"SELECT {TS}, entity, round(mt - mx * wx - my * wy + coalesce(x, 0) * wx + coalesce(y, 0) * wy, 6) + 0.0::DOUBLE AS score FROM zs, w"))
def ridge_scores(s, d):  # noqa: ANN001, ANN201
    f = learnable(s, d)
    return shown(f.select("ts", "entity", mo.linear_score(mo.ridge(f, FACTORS[:2], "target")).alias("score")), ["ts", "entity"], ["score"])


@query("gbt_scores", None)
def gbt_scores(s, d):  # noqa: ANN001, ANN201
    f = learnable(s, d).dropna(subset=FACTORS[:2])
    return shown(mo.boosted(f, FACTORS[:2], "target", depth=3, rounds=5).transform(f), ["ts", "entity"], ["score"])


def stream(s: SparkSession, d: str, files_per_trigger: int | None = 4) -> DataFrame:
    return se.source(s, f"{d}/event[s].parquet", files_per_trigger=files_per_trigger)


def finished(out: DataFrame, name: str) -> DataFrame:
    return se.run_once(out, f"{name}_out", scratch(out.sparkSession, name), "append" if name in ("stream_dedup", "stream_late") else "complete")


@query("stream_tumbling", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(s, d):  # noqa: ANN001, ANN201
    return finished(se.tumbling(stream(s, d)), "stream_tumbling").select(stamp(F.col("start")).alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sliding", "SELECT strftime(w, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1")
def stream_sliding(s, d):  # noqa: ANN001, ANN201
    return finished(se.sliding(stream(s, d)), "stream_sliding").select(stamp(F.col("start")).alias("start"), "n")


@query("stream_session", """WITH g AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 30 MINUTE, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), h AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM h GROUP BY user_id, k""")
def stream_session(s, d):  # noqa: ANN001, ANN201
    return finished(se.sessions(stream(s, d)), "stream_session").select("user_id", stamp(F.col("start")).alias("start"), "n")


@query("stream_dedup", "SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id")
def stream_dedup(s, d):  # noqa: ANN001, ANN201
    seen = finished(se.first_seen(stream(s, d).select("at", "user_id", "event_type"), ["user_id", "event_type"], "60 days"), "stream_dedup")
    return seen.groupBy("user_id").agg(F.count("*").alias("n"))


@query("stream_late", "SELECT event_id % 90 > 45 AS late, count(*) AS n FROM events GROUP BY 1")
def stream_late(s, d):  # noqa: ANN001, ANN201
    e = stream(s, d).withColumn("recorded_at", F.col("at") + F.make_interval(mins=(F.col("event_id") % 90).cast("int")))
    return finished(se.split_late(e, "recorded_at", 45).select("event_id", "late"), "stream_late").groupBy("late").agg(F.count("*").alias("n"))


@query("recommended_sides", "SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'SHORT' WHEN o_orderpriority = '5-LOW' THEN 'WATCH_LONG' ELSE 'LONG' END AS side, count(*) AS n FROM orders GROUP BY 1")
def recommended_sides(s, d):  # noqa: ANN001, ANN201
    return recommendations(s, d).groupBy("side").agg(F.count("*").alias("n"))


OPEN = """m AS (SELECT event_id AS id, ts, event_id % 60 > 45 AS late, CASE WHEN event_id % 7 = 3 THEN 0 ELSE 1 END AS entries, CASE WHEN event_id % 9 = 4 THEN 0 WHEN event_id % 13 = 5 THEN 2 ELSE 1 END AS exits, value + 1 AS entry, value + 1 + (event_id % 11 - 5)::DOUBLE / 100 AS leave FROM events),
wm AS (SELECT max(CASE WHEN exits > 0 THEN ts + INTERVAL 7 HOUR WHEN entries > 0 THEN ts + INTERVAL 1 HOUR ELSE ts END + to_minutes(id % 60)) - INTERVAL 2 HOUR AS now FROM m)"""


@query("stream_maturation", f"""WITH {OPEN}, o AS (SELECT id, CASE WHEN late THEN 'late' WHEN entries = 1 AND exits = 1 THEN CASE WHEN now > ts + INTERVAL 8 HOUR THEN 'matured' END WHEN now > ts + INTERVAL 55 HOUR THEN CASE WHEN entries > 0 AND exits > 0 THEN 'invalid' ELSE 'expired' END END AS status, leave / entry - 1 AS ret FROM m, wm)
SELECT status, count(*) AS n, round(avg(CASE WHEN status = 'matured' THEN ret END), 6) + 0.0::DOUBLE AS ret FROM (SELECT status, ret FROM o WHERE status IS NOT NULL UNION ALL SELECT 'recorded', NULL FROM m WHERE NOT late) GROUP BY status""")
def stream_maturation(s, d):  # noqa: ANN001, ANN201
    """Signals and their prices, replayed from the events: some are recorded late, some lack a price, some
    have one twice. The table's files are in no order of time, so that all make one batch: split, all but
    the first would be behind the watermark."""
    e, k = stream(s, d, files_per_trigger=None), F.col("event_id")
    message = lambda kind, hours, price: F.struct(F.lit(kind).alias("kind"), (F.col("at") + F.make_interval(hours=F.lit(hours))).alias("at"), price.alias("open"))
    first, last = F.col("value") + 1, F.col("value") + 1 + (k % 11 - 5).cast("double") / 100
    entry, leave = message("entry", 1, first), message("exit", 7, last)
    several = F.array_compact(F.array(message("signal", 0, F.lit(None).cast("double")), F.when(k % 7 != 3, entry), F.when(k % 9 != 4, leave), F.when((k % 9 != 4) & (k % 13 == 5), leave)))
    messages = e.select(k.alias("id"), F.explode(several).alias("m")).select("id", "m.*")
    messages = messages.withColumn("recorded_at", F.col("at") + F.make_interval(mins=(F.col("id") % 60).cast("int")))
    out = se.run_once(se.maturation(messages), "stream_maturation_out", scratch(s, "stream_maturation"))
    return out.groupBy("status").agg(F.count("*").alias("n"), six(F.avg("ret")).alias("ret"))
