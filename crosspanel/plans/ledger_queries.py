"""Portfolio, ledger and report queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosspanel.functions.columns import six, stamp
from crosspanel.operators import factors as fa
from crosspanel.operators import ledger as le
from crosspanel.operators import portfolio as po
from crosspanel.operators import reporting as re
from crosspanel.plans.panel_queries import T, TS, panel_b, shown, six_sql, sql
from crosspanel.sources.bars import traded
from crosspanel.sources.tables import append_missing, broken_envelopes, enveloped, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FEE, EXTRA = 0.001, 0.001


def query(name: str, oracle: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def weekly_scores(s: SparkSession, d: str) -> DataFrame:
    """ts, entity, score and the next week's return over the weekly panel."""
    f = fa.price_factors(panel_b(s, d)).select("ts", "entity", "close", F.col("reversal_1h").alias("score"))
    return f.withColumn("ret", fa.forward_return("close", 1) * 0.01)  # the synthetic prices jump too much to compound


WEEKLY = """weekly AS (SELECT ts, entity, reversal_1h AS score, (lead(close) OVER (PARTITION BY entity ORDER BY ts) / nullif(close, 0) - 1) * 0.01::DOUBLE AS ret FROM factors)"""
SLOTS = """lists AS (SELECT ts, row_number() OVER (ORDER BY ts) AS k, list(entity ORDER BY score DESC, entity)[1:5] AS b, list(entity ORDER BY score, entity)[1:5] AS w FROM weekly WHERE score IS NOT NULL GROUP BY ts)"""
FOLD = """fold(k, ts, longs, shorts, prev_longs, prev_shorts) AS (SELECT k, ts, b[1:3], w[1:3], []::VARCHAR[], []::VARCHAR[] FROM lists WHERE k = 1
UNION ALL SELECT k, ts, fl, (ks || list_filter(w[1:3], lambda m: NOT list_contains(ks, m) AND NOT list_contains(fl, m)))[1:3], longs, shorts FROM (
SELECT *, list_filter(w, lambda m: list_contains(shorts, m) AND NOT list_contains(fl, m)) AS ks FROM (
SELECT *, (kl || list_filter(b[1:3], lambda m: NOT list_contains(kl, m)))[1:3] AS fl FROM (
SELECT l.k, l.ts, l.b, l.w, f.longs, f.shorts, list_filter(l.b, lambda m: list_contains(f.longs, m)) AS kl FROM fold f JOIN lists l ON l.k = f.k + 1))))"""
PERIODS = """legs AS (SELECT ts, 'long' AS side, unnest(longs) AS entity, generate_subscripts(longs, 1) AS place FROM fold UNION ALL SELECT ts, 'short', unnest(shorts), generate_subscripts(shorts, 1) FROM fold),
lr AS (SELECT ts, avg(ret) FILTER (side = 'long') AS lret, avg(ret) FILTER (side = 'short') AS sret FROM legs JOIN weekly USING (ts, entity) GROUP BY ts),
tn AS (SELECT ts, (coalesce(len(list_filter(longs, lambda m: NOT list_contains(prev_longs, m)))::DOUBLE / nullif(len(longs), 0), 0) + coalesce(len(list_filter(shorts, lambda m: NOT list_contains(prev_shorts, m)))::DOUBLE / nullif(len(shorts), 0), 0)) / 2 AS turnover, len(shorts) AS ns FROM fold),
pnl AS (SELECT ts, coalesce(lret, 0) - coalesce(sret, 0) AS gross, turnover, turnover * 2 * 0.001::DOUBLE + CASE WHEN ns > 0 THEN 0.001::DOUBLE ELSE 0 END AS cost FROM tn LEFT JOIN lr USING (ts)),
net AS (SELECT *, gross - cost AS net FROM pnl)"""
POS = """pr AS (SELECT l.ts, l.side, l.entity, l.place, ret, count(*) OVER (PARTITION BY l.ts, l.side) AS n, turnover * 2 * 0.001::DOUBLE AS cost FROM legs l JOIN weekly USING (ts, entity) JOIN tn USING (ts) WHERE ret IS NOT NULL),
pos AS (SELECT ts, side, entity, place, ret, CASE side WHEN 'long' THEN ret ELSE -ret END / n AS gross, CASE side WHEN 'long' THEN ret ELSE -ret END / n - cost / n - CASE side WHEN 'short' THEN 0.001::DOUBLE / n ELSE 0 END AS net FROM pr)"""


def recursive(*parts: str, body: str) -> str:
    return sql(*parts, body=body).replace("WITH ", "WITH RECURSIVE ", 1)


def baskets(s: SparkSession, d: str) -> DataFrame:
    return po.buffered(po.ranked_slots(weekly_scores(s, d), 5), 3, 3, 2)


def weekly_periods(s: SparkSession, d: str) -> DataFrame:
    return po.periods(baskets(s, d), weekly_scores(s, d).select("ts", "entity", "ret"), FEE, EXTRA)


def weekly_positions(s: SparkSession, d: str) -> DataFrame:
    return po.positions(baskets(s, d), weekly_scores(s, d).select("ts", "entity", "ret"), FEE, EXTRA)


P = ("b", "panel", "factors", WEEKLY)


@query("topk_basket", sql(*P, body=f"SELECT {TS}, entity, place FROM (SELECT ts, entity, row_number() OVER (PARTITION BY ts ORDER BY score, entity) AS place FROM weekly WHERE score IS NOT NULL) WHERE place <= 5"))
def topk_basket(s, d):  # noqa: ANN001, ANN201
    return po.top_k(weekly_scores(s, d), 5, True).select(stamp(F.col("ts")).alias("ts"), "entity", F.col("place").cast("bigint").alias("place"))


@query("buffered_basket", recursive(*P, SLOTS, FOLD, body=f"SELECT {TS}, array_to_string(longs, ',') AS longs, array_to_string(shorts, ',') AS shorts FROM fold"))
def buffered_basket(s, d):  # noqa: ANN001, ANN201
    return baskets(s, d).select(stamp(F.col("ts")).alias("ts"), F.array_join("longs", ",").alias("longs"), F.array_join("shorts", ",").alias("shorts"))


@query("walkforward_periods", recursive(*P, SLOTS, FOLD, PERIODS, body=f"SELECT {TS}, {six_sql('gross', 'turnover', 'cost', 'net')} FROM net"))
def walkforward_periods(s, d):  # noqa: ANN001, ANN201
    return shown(weekly_periods(s, d), ["ts"], ["gross", "turnover", "cost", "net"])


EQ = """eq AS (SELECT *, exp(sum(ln(1 + net)) OVER (ORDER BY ts)) AS equity FROM net), dd AS (SELECT *, equity / max(equity) OVER (ORDER BY ts) - 1 AS drawdown FROM eq)"""
STATS = ["mean_gross", "mean_net", "median_net", "sharpe", "tstat", "max_drawdown", "win", "turnover", "cost", "p05", "worst"]


@query("pnl_stats", recursive(*P, SLOTS, FOLD, PERIODS, EQ, body=f"""SELECT count(*) AS n, round(avg(gross), 6) + 0.0::DOUBLE AS mean_gross, round(avg(net), 6) + 0.0::DOUBLE AS mean_net, round(quantile_cont(net, 0.5), 6) AS median_net, round(avg(net) / stddev_samp(net) * sqrt(52.0::DOUBLE), 6) AS sharpe,
round({T.format('net')}, 6) AS tstat, round(min(drawdown), 6) + 0.0::DOUBLE AS max_drawdown, round(avg((net > 0)::INT), 6) AS win, round(avg(turnover), 6) AS turnover, round(avg(cost), 6) AS cost, round(quantile_cont(net, 0.05), 6) AS p05, round(min(net), 6) AS worst FROM dd"""))
def pnl_stats(s, d):  # noqa: ANN001, ANN201
    return shown(po.pnl_stats(weekly_periods(s, d), 52.0), ["n"], STATS)


@query("position_summary", recursive(*P, SLOTS, FOLD, PERIODS, POS, f"ps AS (SELECT side, entity, count(*) AS periods, avg(place) AS mean_rank, avg(ret) AS mean_return, sum(gross) AS gross, sum(net) AS net FROM pos GROUP BY 1, 2)",
    body=f"SELECT side, entity, periods, {six_sql('mean_rank', 'mean_return', 'gross', 'net')}, round(gross / nullif(sum(gross) OVER (PARTITION BY side), 0), 6) + 0.0::DOUBLE AS gross_share FROM ps"))
def position_summary(s, d):  # noqa: ANN001, ANN201
    return shown(po.position_summary(weekly_positions(s, d)), ["side", "entity", "periods"], ["mean_rank", "mean_return", "gross", "net", "gross_share"])


@query("strategy_concentration", recursive(*P, SLOTS, FOLD, PERIODS, POS, "ps AS (SELECT side, entity, sum(gross) AS gross FROM pos GROUP BY 1, 2), pk AS (SELECT *, gross / nullif(sum(gross) OVER (PARTITION BY side), 0) AS share, row_number() OVER (PARTITION BY side ORDER BY gross DESC, entity) AS place FROM ps)",
    body="SELECT side, count(*) AS names, round(sum(share) FILTER (place <= 1), 6) + 0.0::DOUBLE AS top1, round(sum(share) FILTER (place <= 3), 6) + 0.0::DOUBLE AS top3, round(sum(share) FILTER (place <= 5), 6) + 0.0::DOUBLE AS top5 FROM pk GROUP BY side"))
def strategy_concentration(s, d):  # noqa: ANN001, ANN201
    return shown(po.concentration(po.position_summary(weekly_positions(s, d))), ["side", "names"], ["top1", "top3", "top5"])


@query("strategy_summary", recursive(*P, SLOTS, FOLD, PERIODS, "bench AS (SELECT ts, ret AS bench FROM weekly WHERE entity = '0' AND ret IS NOT NULL)",
    body="SELECT round(covar_samp(net, bench) / nullif(var_samp(bench), 0), 6) + 0.0::DOUBLE AS beta FROM net JOIN bench USING (ts)"))
def strategy_summary(s, d):  # noqa: ANN001, ANN201
    bench = weekly_scores(s, d).where("entity = '0'").select("ts", F.col("ret").alias("bench"))
    return shown(po.beta_to(weekly_periods(s, d), bench), [], ["beta"])


@query("leg_daily", recursive(*P, SLOTS, FOLD, PERIODS, "dl AS (SELECT ts::DATE AS day, exp(sum(ln(1 + net))) - 1 AS ret FROM net GROUP BY 1), cal AS (SELECT unnest(generate_series((SELECT min(day) FROM dl), (SELECT max(day) FROM dl), INTERVAL 1 DAY))::DATE AS day)",
    body="SELECT strftime(day, '%Y-%m-%d') AS day, round(coalesce(ret, 0), 6) + 0.0::DOUBLE AS ret FROM cal LEFT JOIN dl USING (day)"))
def leg_daily(s, d):  # noqa: ANN001, ANN201
    return po.daily(weekly_periods(s, d), "net").select(F.date_format("day", "yyyy-MM-dd").alias("day"), six(F.col("ret")).alias("ret"))


LONG = """act AS (SELECT ts, coalesce(reversal_4h < 0, false) AS active FROM factors WHERE entity = '0'),
tp AS (SELECT ts, entity, ret FROM weekly WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ts ORDER BY score DESC, entity) <= 5),
sl AS (SELECT ts, count(*) AS n_picks, count(ret) AS n_ret, avg(ret) AS mean_ret, list(entity) AS picks FROM tp GROUP BY ts),
sa AS (SELECT sl.*, coalesce(active, false) AS active FROM sl LEFT JOIN act USING (ts)),
sb AS (SELECT *, coalesce(lag(CASE WHEN active THEN picks END) OVER (ORDER BY ts), []::VARCHAR[]) AS before FROM sa),
sc AS (SELECT ts, n_picks, len(list_filter(picks, lambda m: NOT list_contains(before, m)))::DOUBLE / n_picks AS turnover, CASE WHEN n_ret = n_picks THEN mean_ret END AS gross FROM sb WHERE active)"""


@query("long_economics", sql(*P, LONG, body=f"SELECT {TS}, n_picks, {six_sql('turnover', 'gross')}, round(gross - turnover * 0.002::DOUBLE, 6) + 0.0::DOUBLE AS net FROM sc"))
def long_economics(s, d):  # noqa: ANN001, ANN201
    w = weekly_scores(s, d)
    active = fa.price_factors(panel_b(s, d)).where("entity = '0'").select("ts", F.coalesce(F.col("reversal_4h") < 0, F.lit(False)).alias("active"))
    return shown(po.long_economics(w.select("ts", "entity", "score"), w.select("ts", "entity", "ret"), active, 5, 0.002), ["ts", "n_picks"], ["turnover", "gross", "net"])


QUALITY = """cand AS (SELECT ts, entity, score, abs(score) / nullif(stddev_samp(score) OVER (PARTITION BY ts), 0) AS sigma, entity::INT % 2 = 0 AS consensus FROM weekly WHERE score IS NOT NULL),
qs AS (SELECT s.ts, row_number() OVER (ORDER BY s.ts) AS k, coalesce(c.names, []) AS names FROM (SELECT DISTINCT ts FROM cand) s LEFT JOIN (SELECT ts, list({'m': entity, 's': sigma, 'e': sigma * 0.01::DOUBLE - 0.005::DOUBLE} ORDER BY score, entity) AS names FROM cand
  WHERE score < 0 AND (consensus OR sigma >= 2) AND sigma >= 0.5 AND sigma * 0.01::DOUBLE - 0.005::DOUBLE >= 0 GROUP BY ts) c USING (ts)),
qf(k, ts, shorts) AS (SELECT 0::BIGINT, NULL::TIMESTAMP, []::VARCHAR[] UNION ALL SELECT q.k, q.ts, list_transform(list_filter(q.names, lambda x: CASE WHEN list_contains(f.shorts, x.m) THEN x.s >= 0.5 AND x.e >= 0 ELSE x.s >= 1.0 AND x.e >= 0.002 END), lambda x: x.m)[1:4] FROM qf f JOIN qs q ON q.k = f.k + 1)"""


@query("quality_basket", recursive(*P, QUALITY, body=f"SELECT {TS}, array_to_string(shorts, ',') AS shorts FROM qf WHERE k > 0"))
def quality_basket(s, d):  # noqa: ANN001, ANN201
    w = weekly_scores(s, d).where("score IS NOT NULL")
    sigma = F.abs("score") / F.nullif(F.stddev_samp("score").over(Window.partitionBy("ts")), F.lit(0.0))
    c = w.select("ts", "entity", "score", sigma.alias("sigma"), (F.col("entity").cast("int") % 2 == 0).alias("consensus")).withColumn("expected_net", F.col("sigma") * 0.01 - 0.005)
    return po.quality_shorts(c, 4, 1.0, 0.5, 0.002).select(stamp(F.col("ts")).alias("ts"), F.array_join("shorts", ",").alias("shorts"))


# --- ledger over orders, priced by the weekly bars ---

SIDES = """recs AS (SELECT o_orderkey, (o_custkey % 40)::VARCHAR AS entity, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'SHORT' WHEN o_orderpriority = '5-LOW' THEN 'WATCH_LONG' ELSE 'LONG' END AS side,
  o_orderdate AS entry_time, o_orderdate + to_days((7 * (1 + o_orderkey % 4))::INT) AS target_time, CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' THEN false END AS actionable FROM orders)"""
MATURED = """due AS (SELECT * FROM recs WHERE target_time <= (SELECT max(ts) FROM bars)),
priced AS (SELECT d.*, x.close AS entry_price, y.close AS exit_price FROM due d ASOF LEFT JOIN bars x ON d.entity = x.entity AND d.entry_time >= x.ts ASOF LEFT JOIN bars y ON d.entity = y.entity AND d.target_time >= y.ts),
led AS (SELECT *, CASE side WHEN 'SHORT' THEN -(exit_price / nullif(entry_price, 0) - 1) ELSE exit_price / nullif(entry_price, 0) - 1 END AS gross_return, CASE side WHEN 'SHORT' THEN 0.003::DOUBLE ELSE 0.002::DOUBLE END AS cost_return FROM priced),
hist AS (SELECT *, gross_return - cost_return AS net_return, gross_return AS realized_pct, gross_return - cost_return AS net_pct FROM led WHERE gross_return IS NOT NULL)"""
L = ("b", SIDES, MATURED)


def recommendations(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    side = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "SHORT").when(F.col("o_orderpriority") == "5-LOW", "WATCH_LONG").otherwise("LONG")
    target = F.col("o_orderdate") + F.make_interval(days=(7 * (1 + F.col("o_orderkey") % 4)).cast("int"))
    return o.select("o_orderkey", (F.col("o_custkey") % 40).cast("string").alias("entity"), side.alias("side"), F.col("o_orderdate").alias("entry_time"), target.alias("target_time"), F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("actionable"))


def ledger(s: SparkSession, d: str) -> DataFrame:
    return le.matured(recommendations(s, d), traded(s, d))


def history(s: SparkSession, d: str) -> DataFrame:
    return ledger(s, d).where("gross_return IS NOT NULL").withColumns({"realized_pct": F.col("gross_return"), "net_pct": F.col("net_return")})


@query("ledger_mature", sql(*L, body=f"SELECT o_orderkey, side, {six_sql('gross_return', 'cost_return')}, round(gross_return - cost_return, 6) + 0.0::DOUBLE AS net_return FROM led"))
def ledger_mature(s, d):  # noqa: ANN001, ANN201
    return shown(ledger(s, d), ["o_orderkey", "side"], ["gross_return", "cost_return", "net_return"])


@query("ledger_pending", sql("b", SIDES, body="SELECT o_orderkey FROM recs WHERE NOT (target_time <= (SELECT max(ts) FROM bars WHERE ts <= (SELECT max(ts) FROM bars) - INTERVAL 1200 DAY))"))
def ledger_pending(s, d):  # noqa: ANN001, ANN201
    """What is still open to one who knows no price of the last 1200 days."""
    bars, r = traded(s, d), recommendations(s, d)
    last = bars.agg(F.max("ts").alias("last"))  # one row
    known = bars.join(F.broadcast(last), F.col("ts") <= F.col("last") - F.expr("INTERVAL 1200 DAYS")).drop("last")
    return le.pending(r, le.matured(r, known), ["o_orderkey"]).select("o_orderkey")


@query("ledger_append", sql(SIDES, body="SELECT entity, side, strftime(entry_time, '%Y-%m-%d') AS entry FROM recs WHERE entry_time >= TIMESTAMP '1998-01-01' GROUP BY ALL HAVING NOT bool_or(o_orderkey % 3 = 0)"))
def ledger_append(s, d):  # noqa: ANN001, ANN201
    r = recommendations(s, d).where("entry_time >= TIMESTAMP_NTZ '1998-01-01 00:00:00'").select("entity", "side", F.date_format("entry_time", "yyyy-MM-dd").alias("entry"), "o_orderkey")
    return append_missing(r.where("o_orderkey % 3 = 0"), r, ["entity", "side", "entry"]).select("entity", "side", "entry")


@query("ledger_costs", sql(*L, body="SELECT side, count(*) AS n, round(avg(gross_return - CASE WHEN o_orderkey % 2 = 0 THEN 0.001::DOUBLE ELSE cost_return END), 6) AS mean_net FROM led GROUP BY side"))
def ledger_costs(s, d):  # noqa: ANN001, ANN201
    old = ledger(s, d).withColumn("realized_return", F.col("gross_return"))
    even = F.col("o_orderkey") % 2 == 0
    old = old.withColumns({"gross_return": F.lit(None).cast("double"), "cost_return": F.when(even, 0.001), "net_return": F.lit(None).cast("double")})
    return shown(le.backfilled(old).groupBy("side").agg(F.count("*").alias("n"), F.avg("net_return").alias("mean_net")), ["side", "n"], ["mean_net"])


@query("ledger_invariants", sql(*L, """bad AS (SELECT o_orderkey, side, gross_return, CASE WHEN o_orderkey % 50 = 0 THEN 0.1::DOUBLE ELSE cost_return END AS cost_return, gross_return - cost_return AS net_return FROM led)""",
    body="""SELECT rule, count(*) AS n FROM (SELECT 'net' AS rule FROM bad WHERE abs(net_return - (gross_return - cost_return)) > 1e-9 UNION ALL SELECT 'cost' FROM bad WHERE abs(cost_return - CASE side WHEN 'SHORT' THEN 0.003::DOUBLE ELSE 0.002::DOUBLE END) > 1e-9 UNION ALL SELECT 'missing' FROM bad WHERE gross_return IS NULL) GROUP BY rule"""))
def ledger_invariants(s, d):  # noqa: ANN001, ANN201
    bad = ledger(s, d).withColumn("cost_return", F.when(F.col("o_orderkey") % 50 == 0, F.lit(0.1)).otherwise(F.col("cost_return")))
    return le.violations(bad).groupBy("rule").agg(F.count("*").alias("n"))


@query("replay_diff", sql(*L, body="SELECT o_orderkey, 'differs' AS reason FROM led WHERE o_orderkey % 97 = 0 AND gross_return IS NOT NULL UNION ALL SELECT o_orderkey, 'not_recomputed' FROM led WHERE o_orderkey % 97 = 1 UNION ALL SELECT o_orderkey, 'not_stored' FROM led WHERE o_orderkey % 97 = 2"))
def replay_diff(s, d):  # noqa: ANN001, ANN201
    stored, new = ledger(s, d).where("o_orderkey % 97 <> 2"), ledger(s, d).where("o_orderkey % 97 <> 1")
    stored = stored.withColumn("gross_return", F.col("gross_return") + F.when(F.col("o_orderkey") % 97 == 0, 0.01).otherwise(0.0))
    return le.replayed(stored, new, ["o_orderkey"], ["gross_return"]).select("o_orderkey", "reason")


@query("sealed_rows", "SELECT count(*) AS n, count(*) FILTER (c_custkey % 97 = 5 OR c_custkey % 89 = 3) AS n_broken, min(c_custkey) FILTER (c_custkey % 97 = 5 OR c_custkey % 89 = 3) AS first_broken FROM customer")
def sealed_rows(s, d):  # noqa: ANN001, ANN201
    """Rows sealed with their checksum, of which some were changed and some lost their seal afterwards."""
    sealed, k = enveloped(table(s, d, "customer"), ["c_custkey"]), F.col("c_custkey")
    payload = F.when(k % 97 == 5, F.concat(F.substring("payload", 1, 20), F.lit("x"), F.substring("payload", 22, 1 << 20))).otherwise(F.col("payload"))
    handled = sealed.select("c_custkey", payload.alias("payload"), F.when(k % 89 != 3, F.col("sha256")).alias("sha256"))
    broken = broken_envelopes(handled).agg(F.count("*").alias("n_broken"), F.min("c_custkey").alias("first_broken"))
    return handled.agg(F.count("*").alias("n")).crossJoin(broken)  # one row each


LEFT_OUT = """lp AS (SELECT side, ts, entity, 100 * CASE side WHEN 'long' THEN ret ELSE -ret END / n AS part, 1.0::DOUBLE / n AS weight FROM pr),
ls AS (SELECT side, count(DISTINCT ts) AS n_slots, sum(part) AS all_part, sum(weight) AS all_weight FROM lp GROUP BY side),
lo AS (SELECT side, entity, sum(part) AS part, sum(weight) AS weight FROM lp GROUP BY side, entity UNION ALL SELECT side, NULL, 0, 0 FROM ls)"""


@query("leave_one_out", recursive(*P, SLOTS, FOLD, PERIODS, POS, LEFT_OUT, body="""SELECT side, entity, cost_bps::DOUBLE AS cost_bps, n_slots, round((all_part - part - (all_weight - weight) * cost_bps / 100) / n_slots, 6) + 0.0::DOUBLE AS mean,
CASE WHEN entity IS NOT NULL THEN round((part - weight * cost_bps / 100) / n_slots, 6) + 0.0::DOUBLE END AS contribution FROM lo JOIN ls USING (side), (SELECT unnest([0, 10, 20, 30]) AS cost_bps)"""))
def leave_one_out(s, d):  # noqa: ANN001, ANN201
    size = F.count("*").over(Window.partitionBy("ts", "side"))
    signed = F.when(F.col("side") == "long", F.col("raw_return")).otherwise(-F.col("raw_return"))
    parts = weekly_positions(s, d).select("side", "ts", "entity", (100 * signed / size).alias("part"), (F.lit(1.0) / size).alias("weight"))
    return shown(re.left_out(parts, "side"), ["side", "entity", "cost_bps", "n_slots"], ["mean", "contribution"])


#: Saved scores and their replay: one with an entity less, with a new one, with changed scores, in some weeks.
REPLAY = """sv AS (SELECT ts, entity, round(score, 5) AS score FROM weekly WHERE score IS NOT NULL AND NOT (extract(week FROM ts) % 8 = 1 AND entity = '7')),
rv AS (SELECT ts, entity, score + CASE WHEN extract(week FROM ts) % 8 = 3 AND entity IN ('3', '5') THEN 0.01::DOUBLE ELSE 0 END AS score FROM weekly WHERE score IS NOT NULL AND NOT (extract(week FROM ts) % 8 = 2 AND entity IN ('2', '9')) AND NOT (extract(week FROM ts) % 8 = 5 AND entity >= '2')),
bo AS (SELECT coalesce(sv.ts, rv.ts) AS ts, coalesce(sv.entity, rv.entity) AS entity, sv.score AS saved, rv.score AS replay FROM sv FULL JOIN rv ON sv.ts = rv.ts AND sv.entity = rv.entity),
bt AS (SELECT bo.*, ret FROM bo LEFT JOIN weekly USING (ts, entity)),
rs AS (SELECT ts, count(saved) AS n_saved, count(replay) AS n_replay, count(saved + replay) AS n_common, coalesce(string_agg(entity, ',' ORDER BY entity) FILTER (saved IS NULL), '') AS added, coalesce(string_agg(entity, ',' ORDER BY entity) FILTER (replay IS NULL), '') AS removed,
  count(*) FILTER (abs(saved - round(replay, 5)) > 0.0001::DOUBLE) AS n_changed FROM bt GROUP BY ts)"""


def _ranked(name, where, a, b):  # noqa: ANN001, ANN202
    tied = lambda c: f"rank() OVER (PARTITION BY ts ORDER BY {c}) + (count(*) OVER (PARTITION BY ts, {c}) - 1) / 2.0::DOUBLE"
    return f"""{name}_r AS (SELECT ts, {tied(a)} AS x, {tied(b)} AS y FROM (SELECT ts, {a}, {b} FROM bt WHERE {where} AND {a} IS NOT NULL AND {b} IS NOT NULL)), {name} AS (SELECT ts, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS ic FROM {name}_r GROUP BY ts HAVING count(*) >= 10)"""


COMMON = "saved IS NOT NULL AND replay IS NOT NULL"
REPLAY_ICS = {"replay_ic": ("true", "replay", "ret"), "saved_common_ic": (COMMON, "saved", "ret"), "replay_common_ic": (COMMON, "replay", "ret"), "agreement": (COMMON, "saved", "replay")}


@query("replay_compare", sql(*P, REPLAY, *[_ranked(f"q_{n}", *x) for n, x in REPLAY_ICS.items()], body=f"""SELECT strftime(rs.ts, '%Y-%m-%d %H:%M') AS ts, n_saved, n_replay, n_common, added, removed, n_changed, CASE WHEN n_common < 10 THEN 'insufficient' WHEN added <> '' OR removed <> '' THEN 'members' WHEN n_changed > 0 THEN 'scores' ELSE 'same' END AS status,
{', '.join(f'round(q_{n}.ic, 6) + 0.0::DOUBLE AS {n}' for n in REPLAY_ICS)} FROM rs {' '.join(f'LEFT JOIN q_{n} ON q_{n}.ts = rs.ts' for n in REPLAY_ICS)}"""))
def replay_compare(s, d):  # noqa: ANN001, ANN201
    w = weekly_scores(s, d)
    week, of = F.weekofyear("ts") % 8, F.col("entity")
    good = w.where("score IS NOT NULL")
    saved = good.where(~((week == 1) & (of == "7"))).select("ts", "entity", F.round("score", 5).alias("score"))
    replayed = good.where(~((week == 2) & of.isin("2", "9")) & ~((week == 5) & (of >= "2"))).withColumn("score", F.col("score") + F.when((week == 3) & of.isin("3", "5"), 0.01).otherwise(0.0))
    out = re.compared_replay(saved, replayed, w)
    return out.select(stamp(F.col("ts")).alias("ts"), "n_saved", "n_replay", "n_common", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"), "n_changed", "status", *[six(F.col(c)).alias(c) for c in REPLAY_ICS])


RE = ["avg", "avg_net", "std", "tstat", "tstat_clustered", "avg_net_per_window", "win_pct", "win_ci_lo", "win_ci_hi", "sharpe"]


@query("realized_stats", sql(*L, f"""w AS (SELECT side, entry_time, avg(net_pct) AS wn FROM hist GROUP BY 1, 2), cw AS (SELECT side, count(*) AS n_windows, {T.format('wn')} AS tc, avg(wn) AS aw FROM w GROUP BY side),
g AS (SELECT side, count(*) AS n, avg(realized_pct) AS av, avg(net_pct) AS an, count(*) FILTER (net_pct > 0)::DOUBLE AS k, stddev_samp(net_pct) AS std, {T.format('net_pct')} AS tstat FROM hist GROUP BY side)""",
    body="""SELECT side, n, n_windows, round(av, 6) + 0.0::DOUBLE AS avg, round(an, 6) + 0.0::DOUBLE AS avg_net, round(std, 6) AS std, round(tstat, 6) + 0.0::DOUBLE AS tstat, round(tc, 6) + 0.0::DOUBLE AS tstat_clustered, round(aw, 6) + 0.0::DOUBLE AS avg_net_per_window, round(100 * k / n, 6) AS win_pct,
round(100 * greatest(0, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS win_ci_lo, round(100 * least(1, (k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS win_ci_hi,
round(an / nullif(std, 0), 6) + 0.0::DOUBLE AS sharpe FROM g JOIN cw USING (side)"""))  # fmt: skip
def realized_stats(s, d):  # noqa: ANN001, ANN201
    return shown(re.realized_stats(history(s, d)), ["side", "n", "n_windows"], RE)


@query("cohorts", sql(*L, body="SELECT side, cohort, count(*) AS n, round(avg(net_pct), 6) + 0.0::DOUBLE AS avg_net, round(avg((net_pct > 0)::INT), 6) AS hit FROM (SELECT *, unnest(['all', CASE WHEN actionable THEN 'actionable' WHEN NOT actionable THEN 'watch' ELSE 'unknown' END]) AS cohort FROM hist) GROUP BY 1, 2"))
def cohorts(s, d):  # noqa: ANN001, ANN201
    return shown(re.cohorts(history(s, d)), ["side", "cohort", "n"], ["avg_net", "hit"])


DAILY = """ds AS (SELECT side, entry_time::DATE AS day, count(*) AS n_trades, avg((realized_pct > 0)::INT) AS hit_rate, avg(realized_pct) AS mean_pct FROM hist GROUP BY 1, 2),
dc AS (SELECT *, sum(mean_pct) OVER (PARTITION BY side ORDER BY day) AS cum_pct FROM ds), dx AS (SELECT *, cum_pct - greatest(0, max(cum_pct) OVER (PARTITION BY side ORDER BY day)) AS drawdown_pct FROM dc)"""


@query("daily_series", sql(*L, DAILY, body=f"SELECT side, strftime(day, '%Y-%m-%d') AS day, n_trades, {six_sql('hit_rate', 'mean_pct', 'cum_pct', 'drawdown_pct')} FROM dx"))
def daily_series(s, d):  # noqa: ANN001, ANN201
    return shown(re.daily_series(history(s, d)).withColumn("day", F.date_format("day", "yyyy-MM-dd")), ["side", "day", "n_trades"], ["hit_rate", "mean_pct", "cum_pct", "drawdown_pct"])


@query("monthly", sql(*L, DAILY, body="SELECT side, year(day) AS year, month(day) AS month, round(sum(mean_pct), 6) + 0.0::DOUBLE AS return_pct, count(*) AS n_days, sum(n_trades)::BIGINT AS n_trades FROM ds GROUP BY 1, 2, 3"))
def monthly(s, d):  # noqa: ANN001, ANN201
    return shown(re.monthly_returns(re.daily_series(history(s, d))), ["side", "year", "month", "n_days", "n_trades"], ["return_pct"])


@query("rolling_weighted", sql(*L, DAILY, body="SELECT side, strftime(day, '%Y-%m-%d') AS day, (sum(n_trades) OVER w)::BIGINT AS window_n, round(sum(mean_pct * n_trades) OVER w / sum(n_trades) OVER w, 6) + 0.0::DOUBLE AS rolling_mean, round(sum(hit_rate * n_trades) OVER w / sum(n_trades) OVER w, 6) AS rolling_hit FROM ds WINDOW w AS (PARTITION BY side ORDER BY day ROWS 6 PRECEDING)"))
def rolling_weighted(s, d):  # noqa: ANN001, ANN201
    r = re.rolling_weighted(re.daily_series(history(s, d))).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return shown(r, ["side", "day", "window_n"], ["rolling_mean", "rolling_hit"])


@query("shadow_compare", sql(*L, """arms AS (SELECT 'short_only' AS strategy, entry_time::DATE AS day, net_pct FROM hist WHERE side = 'SHORT' UNION ALL SELECT 'long_short', entry_time::DATE, net_pct FROM hist WHERE side IN ('SHORT', 'WATCH_LONG')),
ad AS (SELECT strategy, day, avg(net_pct) AS m FROM arms GROUP BY 1, 2), ac AS (SELECT *, sum(m) OVER (PARTITION BY strategy ORDER BY day) AS c FROM ad), ax AS (SELECT *, c - greatest(0, max(c) OVER (PARTITION BY strategy ORDER BY day)) AS dd FROM ac)""",
    body="SELECT strategy, count(*) AS n_days, round(arg_max(c, day), 6) + 0.0::DOUBLE AS final_cum, round(min(dd), 6) + 0.0::DOUBLE AS max_drawdown, round(avg(m), 6) + 0.0::DOUBLE AS daily_mean, round(avg(m) / nullif(stddev_samp(m), 0), 6) + 0.0::DOUBLE AS daily_sharpe FROM ax GROUP BY strategy"))
def shadow_compare(s, d):  # noqa: ANN001, ANN201
    return shown(re.strategy_comparison(history(s, d)), ["strategy", "n_days"], ["final_cum", "max_drawdown", "daily_mean", "daily_sharpe"])


PCT = """pk AS (SELECT side, realized_pct AS v, row_number() OVER (PARTITION BY side ORDER BY realized_pct) - 1 AS i, count(*) OVER (PARTITION BY side) AS n FROM hist),
pp AS (SELECT side, max(n) AS n, min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_samp(v) AS std, """ + ", ".join(f"max(v) FILTER (i = round_even({p / 100}::DOUBLE * (n - 1), 0)) AS p{p}" for p in (2, 5, 25, 75, 95, 98)) + ", max(v) FILTER (i = n // 2) AS median FROM pk GROUP BY side)"
PC = ["min", "max", "mean", "std", "p5", "p25", "p75", "p95", "median"]


@query("return_percentiles", sql(*L, PCT, body=f"SELECT side, n, {six_sql(*PC)} FROM pp"))
def return_percentiles(s, d):  # noqa: ANN001, ANN201
    return shown(re.percentiles(history(s, d)), ["side", "n"], PC)


@query("histogram", sql(*L, PCT, "hb AS (SELECT side, CASE WHEN n >= 50 THEN p2 ELSE min END AS lo, (CASE WHEN n >= 50 THEN p98 ELSE max END - CASE WHEN n >= 50 THEN p2 ELSE min END) / 12 AS width FROM pp)",
    body="SELECT b.side, bin, round(lo + bin * width, 6) + 0.0::DOUBLE AS bin_low, (SELECT count(*) FROM hist h WHERE h.side = b.side AND least(greatest(floor((realized_pct - lo) / width), 0), 11) = bin) AS count FROM (SELECT *, unnest(range(12)) AS bin FROM hb) b"))
def histogram(s, d):  # noqa: ANN001, ANN201
    return shown(re.histogram(history(s, d)), ["side", "bin", "count"], ["bin_low"])


@query("best_worst", sql(*L, body="SELECT side, 'best' AS kind, o_orderkey, round(realized_pct, 6) AS realized_pct FROM hist QUALIFY row_number() OVER (PARTITION BY side ORDER BY realized_pct DESC, o_orderkey) <= 5 UNION ALL SELECT side, 'worst', o_orderkey, round(realized_pct, 6) FROM hist QUALIFY row_number() OVER (PARTITION BY side ORDER BY realized_pct, o_orderkey) <= 5"))
def best_worst(s, d):  # noqa: ANN001, ANN201
    return re.best_worst(history(s, d), 5, ["o_orderkey"]).select("side", "kind", "o_orderkey", F.round("realized_pct", 6).alias("realized_pct"))


@query("reliability_tags", sql(*L, body="SELECT entity, count(*) AS n, round(avg((realized_pct > 0)::INT), 6) AS hit_rate, CASE WHEN avg((realized_pct > 0)::INT) >= 0.6 THEN 'trusted' WHEN avg((realized_pct > 0)::INT) <= 0.4 THEN 'untrusted' ELSE '' END AS trust FROM hist GROUP BY entity HAVING count(*) >= 5"))
def reliability_tags(s, d):  # noqa: ANN001, ANN201
    return shown(re.reliability(history(s, d)), ["entity", "n", "trust"], ["hit_rate"])


@query("worst_decile", sql(*L, "wd AS (SELECT side, net_pct, row_number() OVER (PARTITION BY side ORDER BY net_pct) AS i, greatest(1, ceil(count(*) OVER (PARTITION BY side) * 0.1::DOUBLE)) AS k FROM hist)", body="SELECT side, count(*) AS worst_n, round(avg(net_pct), 6) AS worst_mean FROM wd WHERE i <= k GROUP BY side"))
def worst_decile(s, d):  # noqa: ANN001, ANN201
    return shown(re.worst_share(history(s, d), "net_pct", 0.1, "side"), ["side", "worst_n"], ["worst_mean"])


