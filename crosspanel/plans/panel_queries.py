"""Panel, factor and evaluation queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.functions.columns import dirty_number, dirty_time, six, stamp
from crosspanel.operators import evaluation as ev
from crosspanel.operators import factors as fa
from crosspanel.operators import panel as pa
from crosspanel.sources import tables
from crosspanel.sources.bars import hourly, traded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Common table expressions that the SQL of the queries is put together from.
CTE = {
    "a": """bars AS (SELECT date_trunc('hour', ts) AS ts, (user_id % 10)::VARCHAR AS entity, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)""",
    "b": """bars AS (SELECT date_trunc('week', l_shipdate)::TIMESTAMP AS ts, (l_partkey % 40)::VARCHAR AS entity,
  first(p ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS open, max(p) AS high, min(p) AS low,
  last(p ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY 1, 2)""",
    "panel": """grid AS (SELECT * FROM (SELECT DISTINCT ts FROM bars), (SELECT DISTINCT entity FROM bars)),
panel AS (SELECT ts, entity, last_value(open IGNORE NULLS) OVER w AS open, last_value(high IGNORE NULLS) OVER w AS high, last_value(low IGNORE NULLS) OVER w AS low,
  last_value(close IGNORE NULLS) OVER w AS close, last_value(volume IGNORE NULLS) OVER w AS volume FROM grid LEFT JOIN bars USING (ts, entity)
  WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING))""",
    "factors": """r AS (SELECT *, close / nullif(lag(close) OVER e, 0) - 1 AS r1, close / nullif(lag(close, 4) OVER e, 0) - 1 AS r4,
  volume * CASE WHEN close >= open THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS body FROM panel WINDOW e AS (PARTITION BY entity ORDER BY ts)),
factors AS (SELECT ts, entity, open, close, volume, r1, -r1 AS reversal_1h, -r4 AS reversal_4h,
  -CASE WHEN count(r1) OVER w24 = 24 THEN stddev_samp(r1) OVER w24 END AS volatility_inv_24h,
  -CASE WHEN count((high - low) / nullif(close, 0)) OVER w12 = 12 THEN avg((high - low) / nullif(close, 0)) OVER w12 END AS range_contraction_12h,
  -CASE WHEN count(body) OVER w6 = 6 THEN (sum(body) OVER w6) / nullif(CASE WHEN count(volume) OVER w6 = 6 THEN sum(volume) OVER w6 END, 0) END AS order_flow_bear FROM r
  WINDOW w24 AS (PARTITION BY entity ORDER BY ts ROWS 23 PRECEDING), w12 AS (PARTITION BY entity ORDER BY ts ROWS 11 PRECEDING), w6 AS (PARTITION BY entity ORDER BY ts ROWS 5 PRECEDING))""",
    "scored": """scored AS (SELECT ts, entity, close, CASE WHEN reversal_1h IS NOT NULL AND stddev_samp(reversal_1h) OVER t > 0 THEN least(greatest((reversal_1h - avg(reversal_1h) OVER t) / nullif(stddev_samp(reversal_1h) OVER t, 0), -3), 3) END AS score,
  lead(close, 6) OVER e / nullif(close, 0) - 1 AS fwd FROM factors WINDOW t AS (PARTITION BY ts), e AS (PARTITION BY entity ORDER BY ts))""",
    "ics": """ranked AS (SELECT ts, score, fwd, rank() OVER (PARTITION BY ts ORDER BY score) + (count(*) OVER (PARTITION BY ts, score) - 1) / 2.0::DOUBLE AS rs,
  rank() OVER (PARTITION BY ts ORDER BY fwd) + (count(*) OVER (PARTITION BY ts, fwd) - 1) / 2.0::DOUBLE AS rt FROM scored WHERE score IS NOT NULL AND fwd IS NOT NULL),
ics AS (SELECT ts, count(*) AS n, covar_pop(rs, rt) / nullif(stddev_pop(rs) * stddev_pop(rt), 0) AS ic FROM ranked GROUP BY ts HAVING count(*) >= 5)""",
}
TS = "strftime(ts, '%Y-%m-%d %H:%M') AS ts"


def sql(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(CTE.get(p, p) for p in parts) + "\n" + body


def query(name: str, oracle: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def six_sql(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c.split('.')[-1]}" for c in columns)


def shown(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*[stamp(F.col(k)).alias(k) if k == "ts" else F.col(k) for k in keys], *[six(F.col(v)).alias(v) for v in values])


def panel_a(spark: SparkSession, sf: str) -> DataFrame:
    return pa.forward_filled(hourly(spark, sf))


def panel_b(spark: SparkSession, sf: str) -> DataFrame:
    return pa.forward_filled(traded(spark, sf))


def factors_a(spark: SparkSession, sf: str) -> DataFrame:
    return fa.price_factors(panel_a(spark, sf))


def scored(factors: DataFrame, horizon: int = 6) -> DataFrame:
    f = factors.select("ts", "entity", "close", "reversal_1h").withColumn("fwd", fa.forward_return("close", horizon))
    return fa.zscored(f, ["reversal_1h"]).withColumnRenamed("reversal_1h", "score")


def ics_a(spark: SparkSession, sf: str) -> DataFrame:
    return ev.rank_ic(scored(factors_a(spark, sf)), "score", "fwd")


OHLCV = ["open", "high", "low", "close", "volume"]
#: Prices per piece end by the seventh decimal or never: eight places leave no ties.
for _name, _cte, _bars in (("bars_hourly", "a", hourly), ("bars_weekly", "b", traded)):
    query(_name, sql(_cte, body=f"SELECT {TS}, entity, " + ", ".join(f"round({c}, 8) AS {c}" for c in OHLCV) + " FROM bars"))(
        lambda s, d, _bars=_bars: _bars(s, d).select(stamp(F.col("ts")).alias("ts"), "entity", *[F.round(c, 8).alias(c) for c in OHLCV])
    )


@query("latest_ts", sql("a", body="SELECT strftime(max(ts), '%Y-%m-%d %H:%M') AS latest FROM bars WHERE entity IN ('1', '3')"))
def latest_ts(s, d):  # noqa: ANN001, ANN201
    return tables.latest(hourly(s, d), ["1", "3"]).select(stamp(F.col("latest")).alias("latest"))


@query("ranged_scan", sql("a", body=f"SELECT {TS}, entity, {six_sql('close')} FROM bars WHERE entity IN ('0', '4') AND ts >= (SELECT max(ts) FROM bars) - INTERVAL 7 DAY"))
def ranged_scan(s, d):  # noqa: ANN001, ANN201
    b = hourly(s, d)
    return shown(tables.ranged(b, 7, ["0", "4"], against=b), ["ts", "entity"], ["close"])


@query("cutoff_scan", sql("a", body=f"SELECT {TS}, entity, {six_sql('close')} FROM bars WHERE ts <= TIMESTAMP '2024-01-20 06:00' AND ts >= TIMESTAMP '2024-01-15 06:00'"))
def cutoff_scan(s, d):  # noqa: ANN001, ANN201
    return shown(tables.until(hourly(s, d), F.expr("TIMESTAMP_NTZ '2024-01-20 06:00:00'"), 5), ["ts", "entity"], ["close"])


@query("fresh_universe", sql("a", body="""SELECT entity, strftime(max(ts), '%Y-%m-%d %H:%M') AS last_ts FROM bars WHERE NOT contains(entity, '9')
GROUP BY entity HAVING max(ts) >= (SELECT max(ts) FROM bars WHERE NOT contains(entity, '9')) - INTERVAL 1 DAY"""))
def fresh_universe(s, d):  # noqa: ANN001, ANN201
    return tables.fresh_entities(hourly(s, d), 1, exclude="9").select("entity", stamp(F.col("last_ts")).alias("last_ts"))


@query("venue_freshness", sql("b", """last AS (SELECT entity, max(ts) AS last_ts FROM bars GROUP BY entity)""", body="""SELECT count(*) AS n, count(*) FILTER (last_ts >= (SELECT max(last_ts) FROM last) - INTERVAL 7 DAY) AS n_fresh,
(count(*) FILTER (last_ts >= (SELECT max(last_ts) FROM last) - INTERVAL 7 DAY))::DOUBLE / count(*) >= 0.9 AS complete FROM last"""))
def venue_freshness(s, d):  # noqa: ANN001, ANN201
    b = traded(s, d)
    fresh = tables.fresh_entities(b, 7).agg(F.count("*").alias("n_fresh"))
    return b.agg(F.count_distinct("entity").alias("n")).crossJoin(F.broadcast(fresh)).select("n", "n_fresh", (F.col("n_fresh") / F.col("n") >= 0.9).alias("complete"))


@query("upsert_bars", sql("a", "old AS (SELECT ts, entity, close FROM bars WHERE ts < TIMESTAMP '2024-01-11')", "new AS (SELECT ts, entity, close + 1 AS close FROM bars WHERE ts >= TIMESTAMP '2024-01-10')",
    body=f"SELECT {TS}, entity, {six_sql('close')} FROM (SELECT * FROM new UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.ts = old.ts AND new.entity = old.entity))"))
def upsert_bars(s, d):  # noqa: ANN001, ANN201
    b = hourly(s, d).select("ts", "entity", "close")
    old, new = b.where("ts < TIMESTAMP_NTZ '2024-01-11 00:00:00'"), b.where("ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00'").withColumn("close", F.col("close") + 1)
    return shown(tables.merge(old, new, ["ts", "entity"]), ["ts", "entity"], ["close"])


@query("grid_ffill", sql("a", "panel", body=f"SELECT {TS}, entity, {six_sql(*OHLCV)} FROM panel"))
def grid_ffill(s, d):  # noqa: ANN001, ANN201
    return shown(panel_a(s, d), ["ts", "entity"], OHLCV)


@query("complete_entities", sql("a", "panel", body="SELECT entity, count(*) AS n_rows FROM panel GROUP BY entity HAVING bool_and(close IS NOT NULL)"))
def complete_entities(s, d):  # noqa: ANN001, ANN201
    return pa.complete(panel_a(s, d)).groupBy("entity").agg(F.count("*").alias("n_rows"))


@query("warmup_drop", sql("a", "panel", "slots AS (SELECT ts, row_number() OVER (ORDER BY ts) AS k FROM (SELECT DISTINCT ts FROM panel))", body=f"SELECT {TS}, entity, {six_sql('close')} FROM panel JOIN slots USING (ts) WHERE k > 480"))
def warmup_drop(s, d):  # noqa: ANN001, ANN201
    return shown(pa.warmed(panel_a(s, d), 480), ["ts", "entity"], ["close"])


LIQUID = """valued AS (SELECT ts, entity, CASE WHEN count(close * volume) OVER w = 24 THEN sum(close * volume) OVER w END AS tv FROM panel WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS 23 PRECEDING)),
liquid AS (SELECT ts, entity, round(ln(tv), 8) AS log_value, row_number() OVER (PARTITION BY ts ORDER BY tv DESC, entity) AS liquidity_rank FROM valued WHERE tv IS NOT NULL QUALIFY liquidity_rank <= {n})"""


@query("liquidity_topn", sql("b", "panel", LIQUID.format(n=10), body=f"SELECT {TS}, entity, log_value, liquidity_rank FROM liquid"))
def liquidity_topn(s, d):  # noqa: ANN001, ANN201
    return pa.liquid_universe(panel_b(s, d), 10).select(stamp(F.col("ts")).alias("ts"), "entity", F.round(F.ln("traded_value"), 8).alias("log_value"), F.col("liquidity_rank").cast("bigint").alias("liquidity_rank"))


@query("liquidity_coverage", sql("a", "panel", LIQUID.format(n=5), body="SELECT avg(c) AS avg_n, min(c) AS min_n, max(c) AS max_n, count(*) AS n_ts FROM (SELECT count(*) AS c FROM liquid GROUP BY ts)"))
def liquidity_coverage(s, d):  # noqa: ANN001, ANN201
    return pa.coverage(pa.liquid_universe(panel_a(s, d), 5))


KS = (1, 4, 24, 168)
@query("returns_k", sql("a", "panel", body=f"SELECT {TS}, entity, " + ", ".join(f"round(close / nullif(lag(close, {k}) OVER e, 0) - 1, 6) + 0.0::DOUBLE AS r{k}" for k in KS) + " FROM panel WINDOW e AS (PARTITION BY entity ORDER BY ts)"))
def returns_k(s, d):  # noqa: ANN001, ANN201
    from crosspanel.functions.columns import by_entity, change

    return shown(panel_a(s, d).select("ts", "entity", *[change(F.col("close"), k, by_entity()).alias(f"r{k}") for k in KS]), ["ts", "entity"], [f"r{k}" for k in KS])


FACTORS = ["reversal_1h", "reversal_4h", "volatility_inv_24h", "range_contraction_12h", "order_flow_bear"]
for _name, _fields in (("reversal", FACTORS[:2]), ("volatility_inv", FACTORS[2:3]), ("range_contraction", FACTORS[3:4]), ("order_flow", FACTORS[4:])):
    query(_name, sql("a", "panel", "factors", body=f"SELECT {TS}, entity, {six_sql(*_fields)} FROM factors"))(lambda s, d, _fields=_fields: shown(factors_a(s, d), ["ts", "entity"], _fields))


VENUES = """v1 AS (SELECT date_trunc('hour', ts) AS ts, (user_id % 10)::VARCHAR AS entity, arg_max(value, (ts, event_id)) AS close FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
v2 AS (SELECT date_trunc('hour', ts) AS ts, (user_id % 10)::VARCHAR AS entity, arg_max(value, (ts, event_id)) AS close FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2),
p1 AS (SELECT ts, entity, last_value(close IGNORE NULLS) OVER w AS px FROM (SELECT * FROM (SELECT DISTINCT ts FROM v1), (SELECT DISTINCT entity FROM v1)) LEFT JOIN v1 USING (ts, entity) WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING)),
p2 AS (SELECT ts, entity, last_value(close IGNORE NULLS) OVER w AS px FROM (SELECT * FROM (SELECT DISTINCT ts FROM v2), (SELECT DISTINCT entity FROM v2)) LEFT JOIN v2 USING (ts, entity) WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING)),
both_v AS (SELECT p1.ts, p1.entity, p1.px AS px1, p2.px AS px2 FROM p1 LEFT JOIN p2 ON p1.ts = p2.ts AND p1.entity = p2.entity WHERE p1.ts IN (SELECT ts FROM p2)),
v AS (SELECT ts, entity, px2 / nullif(lag(px2) OVER e, 0) - 1 - (px1 / nullif(lag(px1) OVER e, 0) - 1) AS lead_1h, CASE WHEN px1 > 0 AND px2 > 0 THEN ln(px1 / px2) END AS premium FROM both_v WINDOW e AS (PARTITION BY entity ORDER BY ts)),
venue AS (SELECT ts, entity, lead_1h, -premium AS premium_inv, -CASE WHEN count(premium) OVER w = 24 THEN (premium - avg(premium) OVER w) / nullif(stddev_samp(premium) OVER w, 0) END AS premium_z_24h
  FROM v WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS 23 PRECEDING))"""


def venues(s, d):  # noqa: ANN001, ANN201
    return fa.venue_factors(pa.forward_filled(hourly(s, d, venue=0)), pa.forward_filled(hourly(s, d, venue=1)))


for _name, _field in (("venue_lead", "lead_1h"), ("venue_premium", "premium_inv"), ("premium_z", "premium_z_24h")):
    query(_name, sql(VENUES, body=f"SELECT {TS}, entity, {six_sql(_field)} FROM venue"))(lambda s, d, _field=_field: shown(venues(s, d), ["ts", "entity"], [_field]))


@query("calendar_flags", sql("a", body=f"""SELECT DISTINCT {TS}, CASE WHEN isodow(ts + INTERVAL 9 HOUR) < 4 THEN 1.0::DOUBLE WHEN isodow(ts + INTERVAL 9 HOUR) > 4 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS dow_bull,
CASE WHEN hour(ts + INTERVAL 9 HOUR) IN (7, 8, 9, 22, 23, 0, 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hour_vol FROM bars"""))
def calendar_flags(s, d):  # noqa: ANN001, ANN201
    dow, hour = fa.calendar_flags(F.col("ts"))
    return hourly(s, d).select("ts").distinct().select(stamp(F.col("ts")).alias("ts"), dow.alias("dow_bull"), hour.alias("hour_vol"))


@query("macro_globals", sql("a", "panel", """g AS (SELECT ts, entity, close / nullif(lag(close) OVER e, 0) - 1 AS r1, close / nullif(lag(close, 24) OVER e, 0) - 1 AS rs, close / nullif(lag(close, 168) OVER e, 0) - 1 AS rm FROM panel WINDOW e AS (PARTITION BY entity ORDER BY ts)),
h AS (SELECT *, CASE WHEN count(r1) OVER w = 168 THEN stddev_samp(r1) OVER w END * sqrt(168) AS vol FROM g WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS 167 PRECEDING))""",
    body=f"""SELECT {TS}, round(max(rm) FILTER (entity = '1'), 6) + 0.0::DOUBLE AS bench_momentum, round(max(vol) FILTER (entity = '1'), 6) AS bench_volatility,
round(quantile_cont(rs, 0.5) FILTER (entity <> '1') - max(rs) FILTER (entity = '1'), 6) + 0.0::DOUBLE AS season_index FROM h GROUP BY ts"""))  # fmt: skip
def macro_globals(s, d):  # noqa: ANN001, ANN201
    return shown(fa.global_factors(panel_a(s, d), "1"), ["ts"], ["bench_momentum", "bench_volatility", "season_index"])


@query("listing_age", sql("a", "panel", body=f"""SELECT {TS}, entity, round(CASE WHEN ts >= f THEN least((epoch(ts) - epoch(f)) / 86400.0::DOUBLE, 60.0::DOUBLE) END, 6) AS listing_age_days
FROM (SELECT *, min(CASE WHEN close IS NOT NULL THEN ts END) OVER (PARTITION BY entity) AS f FROM panel)"""))
def listing_age(s, d):  # noqa: ANN001, ANN201
    return shown(fa.listing_age(panel_a(s, d)), ["ts", "entity"], ["listing_age_days"])


BETA = """ret AS (SELECT ts, entity, close, close / nullif(lag(close) OVER (PARTITION BY entity ORDER BY ts), 0) - 1 AS r1 FROM panel),
rb AS (SELECT *, max(r1) FILTER (entity = '0') OVER (PARTITION BY ts) AS rb FROM ret),
beta AS (SELECT ts, entity, close, CASE WHEN sum((r1 IS NOT NULL AND rb IS NOT NULL)::INT) OVER w = 52 THEN covar_samp(r1, rb) OVER w / nullif(var_samp(CASE WHEN r1 IS NOT NULL THEN rb END) OVER w, 0) END AS beta
  FROM rb WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS 51 PRECEDING)),
fwd AS (SELECT *, lead(close, 4) OVER e / nullif(lead(close, 1) OVER e, 0) - 1 AS forward FROM beta WINDOW e AS (PARTITION BY entity ORDER BY ts)),
res AS (SELECT ts, entity, beta, forward, forward - beta * max(forward) FILTER (entity = '0') OVER (PARTITION BY ts) AS residual FROM fwd)"""
for _name, _fields in (("rolling_beta", ["beta"]), ("residual_return", ["residual"]), ("forward_return_lag", ["forward"])):
    query(_name, sql("b", "panel", BETA, body=f"SELECT {TS}, entity, {six_sql(*_fields)} FROM res"))(lambda s, d, _fields=_fields: shown(fa.residual_returns(panel_b(s, d), "0", 3, rows=52, lag=1), ["ts", "entity"], _fields))


Z = ["reversal_1h", "volatility_inv_24h"]
@query("zscore_clip", sql("b", "panel", "factors", body=f"SELECT {TS}, entity, " + ", ".join(f"CASE WHEN {z} IS NOT NULL AND stddev_samp({z}) OVER t > 0 THEN round(least(greatest(({z} - avg({z}) OVER t) / nullif(stddev_samp({z}) OVER t, 0), -3), 3), 6) + 0.0::DOUBLE END AS {z}" for z in Z) + " FROM factors WINDOW t AS (PARTITION BY ts)"))
def zscore_clip(s, d):  # noqa: ANN001, ANN201
    return shown(fa.zscored(fa.price_factors(panel_b(s, d)), Z), ["ts", "entity"], Z)


@query("purged_split", sql("a", "slots AS (SELECT ts, row_number() OVER (ORDER BY ts) AS n, count(*) OVER () AS c FROM (SELECT DISTINCT ts FROM bars))", "st AS (SELECT ts AS start FROM slots WHERE n = c - greatest(1, floor(c * 0.2 + 1e-9)) + 1)",
    body=f"SELECT {TS}, CASE WHEN ts >= start THEN 'holdout' WHEN ts + INTERVAL 12 HOUR < start THEN 'train' ELSE 'purged' END AS split FROM slots, st"))
def purged_split(s, d):  # noqa: ANN001, ANN201
    return fa.purged_split(hourly(s, d).select("ts").distinct(), 0.2, 12).select(stamp(F.col("ts")).alias("ts"), "split")


@query("neutral_fill", sql("a", "panel", "factors", body=f"""SELECT {TS}, entity, round(coalesce(reversal_4h, 0), 6) + 0.0::DOUBLE AS reversal_4h, round(coalesce(volatility_inv_24h, 0), 6) + 0.0::DOUBLE AS volatility_inv_24h FROM factors
WHERE reversal_1h IS NOT NULL AND greatest(abs(coalesce(reversal_4h, 0)), abs(coalesce(volatility_inv_24h, 0))) > 0"""))
def neutral_fill(s, d):  # noqa: ANN001, ANN201
    return shown(pa.neutral(factors_a(s, d), ["reversal_4h", "volatility_inv_24h"], "reversal_1h"), ["ts", "entity"], ["reversal_4h", "volatility_inv_24h"])


@query("exact_anchors", "SELECT event_id FROM events WHERE hour(ts) IN (5, 11, 17, 23) AND ts = date_trunc('minute', ts) UNION ALL SELECT -1 - count(*) FROM (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events) WHERE hour(h) IN (5, 11, 17, 23)")
def exact_anchors(s, d):  # noqa: ANN001, ANN201
    e = tables.table(s, d, "events")
    slots = hourly(s, d).select("ts").distinct().where(pa.anchored("ts", (5, 11, 17, 23))).agg((-1 - F.count("*")).alias("event_id"))
    return e.where(F.hour("ts").isin(5, 11, 17, 23) & (F.col("ts") == F.date_trunc("minute", "ts").cast("timestamp_ntz"))).select("event_id").unionAll(slots)


@query("nonoverlap_slots", """WITH RECURSIVE slots AS (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM events WHERE hour(ts) IN (5, 9, 11, 17, 23)),
picked(ts) AS (SELECT min(ts) FROM slots UNION ALL SELECT (SELECT min(s.ts) FROM slots s WHERE s.ts >= p.ts + INTERVAL 6 HOUR) FROM picked p WHERE p.ts IS NOT NULL)
SELECT strftime(ts, '%Y-%m-%d %H:%M') AS ts FROM picked WHERE ts IS NOT NULL""")
def nonoverlap_slots(s, d):  # noqa: ANN001, ANN201
    slots = hourly(s, d).select("ts").distinct().where(pa.anchored("ts", (5, 9, 11, 17, 23)))
    return pa.non_overlapping(slots, 6).select(stamp(F.col("ts")).alias("ts"))


@query("every_kth", sql("a", "slots AS (SELECT ts, row_number() OVER (ORDER BY ts) AS k FROM (SELECT DISTINCT ts FROM bars))", body=f"SELECT {TS}, entity, {six_sql('close')} FROM bars JOIN slots USING (ts) WHERE (k - 1) % 6 = 0"))
def every_kth(s, d):  # noqa: ANN001, ANN201
    return shown(pa.every(hourly(s, d), 6), ["ts", "entity"], ["close"])


@query("volume_universe", sql("a", "daily AS (SELECT entity, ts::DATE AS day, sum(volume) AS v FROM bars GROUP BY 1, 2)", body="SELECT entity, round(quantile_cont(v, 0.5), 6) AS median_volume FROM daily GROUP BY entity HAVING quantile_cont(v, 0.5) >= 35 OR entity = '0'"))
def volume_universe(s, d):  # noqa: ANN001, ANN201
    return pa.volume_universe(hourly(s, d), 35, "0").select("entity", F.round("median_volume", 6).alias("median_volume"))


@query("spearman_ic", sql("a", "panel", "factors", "scored", "ics", body=f"SELECT {TS}, n, round(ic, 6) + 0.0::DOUBLE AS ic FROM ics"))
def spearman_ic(s, d):  # noqa: ANN001, ANN201
    return shown(ics_a(s, d), ["ts", "n"], ["ic"])


SUMMARY = "round(avg(ic), 6) + 0.0::DOUBLE AS mean_ic, round(stddev_samp(ic), 6) AS std_ic, round(avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0), 6) + 0.0::DOUBLE AS t_stat, count(*) AS n"
SUMMED = ["mean_ic", "std_ic", "t_stat"]


@query("ic_summary", sql("a", "panel", "factors", "scored", "ics", body=f"SELECT {SUMMARY} FROM ics WHERE ic IS NOT NULL"))
def ic_summary(s, d):  # noqa: ANN001, ANN201
    return shown(ev.summary(ics_a(s, d)), ["n"], SUMMED)


DECAY = """h AS (SELECT ts, entity, reversal_1h AS score, unnest([1, 3, 6, 12]) AS horizon, unnest([lead(close, 1) OVER e / close - 1, lead(close, 3) OVER e / close - 1, lead(close, 6) OVER e / close - 1, lead(close, 12) OVER e / close - 1]) AS fwd FROM factors WINDOW e AS (PARTITION BY entity ORDER BY ts)),
hr AS (SELECT horizon, ts, rank() OVER (PARTITION BY horizon, ts ORDER BY score) + (count(*) OVER (PARTITION BY horizon, ts, score) - 1) / 2.0::DOUBLE AS rs, rank() OVER (PARTITION BY horizon, ts ORDER BY fwd) + (count(*) OVER (PARTITION BY horizon, ts, fwd) - 1) / 2.0::DOUBLE AS rt FROM h WHERE score IS NOT NULL AND fwd IS NOT NULL),
hi AS (SELECT horizon, ts, covar_pop(rs, rt) / nullif(stddev_pop(rs) * stddev_pop(rt), 0) AS ic FROM hr GROUP BY 1, 2 HAVING count(*) >= 5),
decayed AS (SELECT horizon, """ + SUMMARY + " FROM hi WHERE ic IS NOT NULL GROUP BY horizon)"


def decayed(s, d):  # noqa: ANN001, ANN201
    f = factors_a(s, d).select("ts", "entity", F.col("reversal_1h").alias("score"), *[fa.forward_return("close", h).alias(f"f{h}") for h in (1, 3, 6, 12)])
    return ev.decay(f, "score", {h: f"f{h}" for h in (1, 3, 6, 12)})


@query("ic_decay", sql("a", "panel", "factors", DECAY, body="SELECT * FROM decayed"))
def ic_decay(s, d):  # noqa: ANN001, ANN201
    return shown(decayed(s, d), ["horizon", "n"], SUMMED)


@query("ic_best_horizon", sql("a", "panel", "factors", DECAY, body="SELECT arg_max(horizon, abs(mean_ic)) AS horizon, round(max(abs(mean_ic)), 6) AS abs_ic FROM decayed"))
def ic_best_horizon(s, d):  # noqa: ANN001, ANN201
    return shown(ev.best_horizon(decayed(s, d)), ["horizon"], ["abs_ic"])


LABELS = {
    "rolling": "CASE WHEN sign(r) <> 0 AND sign(f) <> 0 AND sign(r) <> sign(f) THEN 'FLIP' WHEN abs(r) > 0.05 AND abs(rt) > 1.5 THEN 'FRESH' WHEN f <> 0 AND abs(r) < abs(f) / 2 THEN 'STALE' ELSE '' END",
    "gate": "CASE WHEN abs(f) > 0.05 AND abs(ft) > 1.5 THEN 'PASS' WHEN abs(f) > 0.02 THEN 'WEAK' ELSE 'FAIL' END",
    "half": "CASE WHEN sign(a) <> 0 AND sign(b) <> 0 AND sign(a) <> sign(b) THEN 'FLIP' WHEN sign(f) <> 0 AND ((sign(a) <> 0 AND sign(a) <> sign(f)) OR (sign(b) <> 0 AND sign(b) <> sign(f))) THEN 'DRIFT' WHEN b IS NOT NULL AND abs(b) < abs(f) / 2 THEN 'DECAY' ELSE 'STABLE' END",
}
T = "avg({0}) / nullif(stddev_samp({0}) / sqrt(count({0})), 0)"


@query("ic_rolling_tag", sql("a", "panel", "factors", "scored", "ics", f"k AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY ts DESC) <= 48 THEN ic END AS rec FROM ics WHERE ic IS NOT NULL), m AS (SELECT avg(rec) AS r, {T.format('rec')} AS rt, avg(ic) AS f, {T.format('ic')} AS ft FROM k)",
    body=f"SELECT round(r, 6) + 0.0::DOUBLE AS rolling_ic, round(rt, 6) + 0.0::DOUBLE AS rolling_t, round(f, 6) + 0.0::DOUBLE AS full_ic, {LABELS['rolling']} AS tag, {LABELS['gate']} AS gate FROM m"))
def ic_rolling_tag(s, d):  # noqa: ANN001, ANN201
    return shown(ev.rolling(ics_a(s, d), 48), ["tag", "gate"], ["rolling_ic", "rolling_t", "full_ic"])


@query("ic_stability", sql("a", "panel", "factors", "scored", "ics", "k AS (SELECT ic, row_number() OVER (ORDER BY ts) <= greatest(1, ceil(count(*) OVER () / 2)) AS early FROM ics WHERE ic IS NOT NULL), m AS (SELECT avg(ic) AS f, avg(ic) FILTER (early) AS a, avg(ic) FILTER (NOT early) AS b, count(*) AS n FROM k)",
    body=f"SELECT n, round(f, 6) + 0.0::DOUBLE AS full_ic, round(a, 6) + 0.0::DOUBLE AS first_ic, round(b, 6) + 0.0::DOUBLE AS second_ic, {LABELS['half']} AS tag FROM m"))
def ic_stability(s, d):  # noqa: ANN001, ANN201
    return shown(ev.halves(ics_a(s, d)), ["n", "tag"], ["full_ic", "first_ic", "second_ic"])


@query("ic_gate", sql("a", "panel", "factors", "scored", "ics", "k AS (SELECT ts, ic, row_number() OVER (ORDER BY ts DESC) AS back FROM ics WHERE ic IS NOT NULL), m AS (SELECT coalesce(min(back) FILTER (ic >= 0.3) - 1, count(*)) AS low, min(ic) FILTER (back <= 7) AS least, arg_max(ic, ts) AS last FROM k)",
    body="SELECT low AS trailing_low, round(least, 6) + 0.0::DOUBLE AS least_recent, round(last, 6) + 0.0::DOUBLE AS last_ic, CASE WHEN low >= 3 THEN 'LIQUIDATE' WHEN low >= 2 THEN 'FREEZE' WHEN least < 0.4 THEN 'WARN' ELSE 'OK' END AS status FROM m"))
def ic_gate(s, d):  # noqa: ANN001, ANN201
    g = ev.tail_gate(ics_a(s, d), 0.3, 0.4).withColumn("trailing_low", F.col("trailing_low").cast("bigint"))
    return shown(g, ["trailing_low", "status"], ["least_recent", "last_ic"])


@query("factor_drift", sql("b", "panel", "factors", """x AS (SELECT f.factor, f.ts, f.value, f.fwd FROM (SELECT ts, unnest(['reversal_1h', 'reversal_4h', 'volatility_inv_24h']) AS factor, unnest([reversal_1h, reversal_4h, volatility_inv_24h]) AS value, lead(close, 2) OVER (PARTITION BY entity ORDER BY ts) / close - 1 AS fwd FROM factors) f WHERE value IS NOT NULL AND fwd IS NOT NULL),
xr AS (SELECT factor, ts, value, fwd, rank() OVER (PARTITION BY factor, ts ORDER BY value) + (count(*) OVER (PARTITION BY factor, ts, value) - 1) / 2.0::DOUBLE AS rs, rank() OVER (PARTITION BY factor, ts ORDER BY fwd) + (count(*) OVER (PARTITION BY factor, ts, fwd) - 1) / 2.0::DOUBLE AS rt FROM x),
xi AS (SELECT factor, ts, CASE WHEN count(DISTINCT value) >= 2 AND count(DISTINCT fwd) >= 2 THEN covar_pop(rs, rt) / nullif(stddev_pop(rs) * stddev_pop(rt), 0) END AS ic FROM xr GROUP BY 1, 2 HAVING count(*) >= 10),
xk AS (SELECT factor, ic, row_number() OVER (PARTITION BY factor ORDER BY ts DESC) AS back FROM xi WHERE ic IS NOT NULL),
xm AS (SELECT factor, avg(ic) FILTER (back <= 24) AS r, avg(ic) AS f, count(*) AS n_slots FROM xk GROUP BY factor)""",
    body="""SELECT factor, n_slots, round(r, 6) + 0.0::DOUBLE AS ic_recent, round(f, 6) + 0.0::DOUBLE AS ic_all, CASE WHEN n_slots < 10 THEN 'insufficient_data' WHEN r * f < 0 AND abs(f) > 0.02 THEN 'SIGN_FLIP'
WHEN CASE WHEN abs(f) < 1e-6 THEN 0 ELSE 1 - abs(r) / abs(f) END > 0.5 THEN 'DRIFT' ELSE 'OK' END AS status FROM xm"""))  # fmt: skip
def factor_drift(s, d):  # noqa: ANN001, ANN201
    f = fa.price_factors(panel_b(s, d)).withColumn("fwd", fa.forward_return("close", 2))
    return shown(ev.drift(ev.factor_ics(f, FACTORS[:3], "fwd")), ["factor", "n_slots", "status"], ["ic_recent", "ic_all"])


@query("audit_monthly_ic", sql("b", "panel", "factors", "scored", "ics", body=f"SELECT strftime(last_day(ts::DATE), '%Y-%m-%d') AS month, {SUMMARY} FROM ics WHERE ic IS NOT NULL GROUP BY 1"))
def audit_monthly_ic(s, d):  # noqa: ANN001, ANN201
    ics = ev.rank_ic(scored(fa.price_factors(panel_b(s, d))), "score", "fwd")
    return shown(ev.monthly(ics).withColumn("month", F.date_format("month", "yyyy-MM-dd")), ["month", "n"], SUMMED)


@query("ic_autocorr", sql("a", "panel", "factors", "scored", "ics", """c AS (SELECT ts, ic, ic - avg(ic) OVER () AS d FROM ics WHERE ic IS NOT NULL), l AS (SELECT *, lag(d) OVER (ORDER BY ts) AS p FROM c),
m AS (SELECT count(*) AS n, arg_max(ic, ts) AS last, avg(ic) AS mean, stddev_samp(ic) AS std, sum(d * p) / nullif(sum(d * d), 0) AS lag1, avg((round(ic, 12) < 0)::INT) AS neg FROM l),
q AS (SELECT *, CASE WHEN abs(lag1) < 1 AND std > 0 THEN least(greatest(n * (1 - lag1) / (1 + lag1), 1), n) END AS n_eff FROM m)""",
    body="""SELECT n, round(last, 6) + 0.0::DOUBLE AS last, round(mean, 6) + 0.0::DOUBLE AS mean, round(std, 6) AS std, round(mean / (std / sqrt(n)), 6) + 0.0::DOUBLE AS tstat, round(mean / (std / sqrt(n_eff)), 6) + 0.0::DOUBLE AS tstat_ac,
round(lag1, 6) + 0.0::DOUBLE AS lag1, round(n_eff, 6) AS n_eff, round(100 * neg, 6) AS neg_pct FROM q"""))  # fmt: skip
def ic_autocorr(s, d):  # noqa: ANN001, ANN201
    return shown(ev.autocorrelation(ics_a(s, d), "ic"), ["n"], ["last", "mean", "std", "tstat", "tstat_ac", "lag1", "n_eff", "neg_pct"])


@query("score_diagnostics", sql("b", "panel", "factors", """sc AS (SELECT ts, entity, reversal_1h AS score, row_number() OVER (PARTITION BY ts ORDER BY reversal_1h DESC, entity) AS place, count(*) OVER (PARTITION BY ts) AS n FROM factors WHERE reversal_1h IS NOT NULL),
dg AS (SELECT ts, max(n) AS n, stddev_samp(score) AS score_std, avg(score) FILTER (place <= 5) - avg(score) FILTER (place > n - 5) AS top_bottom_gap,
CASE WHEN max(n) > 5 THEN max(score) FILTER (place = 5) - max(score) FILTER (place = 6) END AS long_cut_gap, CASE WHEN max(n) > 5 THEN max(score) FILTER (place = n - 5) - max(score) FILTER (place = n - 4) END AS short_cut_gap FROM sc GROUP BY ts)""",
    body=f"SELECT {TS}, n, {six_sql('score_std', 'top_bottom_gap', 'long_cut_gap', 'short_cut_gap')}, round(top_bottom_gap / nullif(score_std, 0), 6) + 0.0::DOUBLE AS top_bottom_gap_z FROM dg"))
def score_diagnostics(s, d):  # noqa: ANN001, ANN201
    f = fa.price_factors(panel_b(s, d)).select("ts", "entity", F.col("reversal_1h").alias("score"))
    return shown(ev.score_diagnostics(f, 5, 5), ["ts", "n"], ["score_std", "top_bottom_gap", "long_cut_gap", "short_cut_gap", "top_bottom_gap_z"])


@query("rank_contributions", sql("b", "panel", "factors", "scored", "ics", """ce AS (SELECT ts, entity, rank() OVER (PARTITION BY ts ORDER BY score) + (count(*) OVER (PARTITION BY ts, score) - 1) / 2.0::DOUBLE AS rs, rank() OVER (PARTITION BY ts ORDER BY fwd) + (count(*) OVER (PARTITION BY ts, fwd) - 1) / 2.0::DOUBLE AS rt FROM scored WHERE score IS NOT NULL AND fwd IS NOT NULL)""",
    body=f"SELECT {TS}, entity, round((rs - avg(rs) OVER t) * (rt - avg(rt) OVER t) / nullif(stddev_pop(rs) OVER t * stddev_pop(rt) OVER t * count(*) OVER t, 0), 6) + 0.0::DOUBLE AS contribution FROM ce WINDOW t AS (PARTITION BY ts)"))
def rank_contributions(s, d):  # noqa: ANN001, ANN201
    return shown(ev.ic_contributions(scored(fa.price_factors(panel_b(s, d))), "score", "fwd"), ["ts", "entity"], ["contribution"])


REGIME = """h AS (SELECT ts, close FROM bars WHERE entity = '1'), clock AS (SELECT unnest(generate_series((SELECT min(ts) FROM h), (SELECT max(ts) FROM h), INTERVAL 1 HOUR)) AS ts),
dn AS (SELECT ts, CASE WHEN close > 0 THEN close END AS close FROM clock LEFT JOIN h USING (ts)),
dr AS (SELECT ts, close / lag(close, 48) OVER e - 1 AS ret, close / lag(close, 240) OVER e - 1 AS ret_trend, close / lag(close) OVER e - 1 AS r1 FROM dn WINDOW e AS (ORDER BY ts)),
dv AS (SELECT *, CASE WHEN count(r1) OVER (ORDER BY ts ROWS 23 PRECEDING) = 24 THEN stddev_samp(r1) OVER (ORDER BY ts ROWS 23 PRECEDING) END AS vol FROM dr),
dm AS (SELECT *, CASE WHEN count(vol) OVER p >= 24 THEN quantile_cont(vol, 0.5) OVER p END AS vol_reference FROM dv WINDOW p AS (ORDER BY ts ROWS BETWEEN 240 PRECEDING AND 1 PRECEDING)),
regime AS (SELECT ts, ret, vol, vol_reference, CASE WHEN ret IS NULL OR vol IS NULL OR vol_reference IS NULL THEN 'unknown' ELSE CASE WHEN ret >= 0 THEN 'bull' ELSE 'bear' END || '_' || CASE WHEN vol >= vol_reference THEN 'highvol' ELSE 'lowvol' END END AS regime,
coalesce(ret > 0 AND (ret_trend IS NULL OR ret_trend > -0.1), false) AS bull FROM dm)"""


def regime_a(s, d):  # noqa: ANN001, ANN201
    return fa.regimes(fa.dense_hours(hourly(s, d), "1"), 48, 24, 240)


@query("regime_quadrant", sql("a", REGIME, body=f"SELECT {TS}, regime, {six_sql('ret', 'vol', 'vol_reference')} FROM regime"))
def regime_quadrant(s, d):  # noqa: ANN001, ANN201
    return shown(regime_a(s, d), ["ts", "regime"], ["ret", "vol", "vol_reference"])


@query("regime_bull", sql("a", REGIME, body=f"SELECT {TS}, bull FROM regime"))
def regime_bull(s, d):  # noqa: ANN001, ANN201
    return regime_a(s, d).select(stamp(F.col("ts")).alias("ts"), "bull")


@query("regime_slice", sql("a", "panel", "factors", "scored", "ics", REGIME, body="SELECT regime, count(*) AS n, round(avg(ic), 6) + 0.0::DOUBLE AS mean_ic, round(avg((round(ic, 12) > 0)::INT), 6) AS hit FROM ics JOIN regime USING (ts) WHERE ic IS NOT NULL GROUP BY regime"))
def regime_slice(s, d):  # noqa: ANN001, ANN201
    joined = ics_a(s, d).where("ic IS NOT NULL").join(regime_a(s, d).select("ts", "regime"), "ts")
    return shown(joined.groupBy("regime").agg(F.count("*").alias("n"), F.avg("ic").alias("mean_ic"), F.avg((F.round("ic", 12) > 0).cast("double")).alias("hit")), ["regime", "n"], ["mean_ic", "hit"])


@query("preflight_nan", sql("a", "panel", "factors", body="SELECT unnest(['reversal_1h', 'volatility_inv_24h']) AS feature, unnest([round(avg((reversal_1h IS NULL)::INT) * 100, 6), round(avg((volatility_inv_24h IS NULL)::INT) * 100, 6)]) AS null_pct FROM factors"))
def preflight_nan(s, d):  # noqa: ANN001, ANN201
    return shown(pa.null_shares(factors_a(s, d), ["reversal_1h", "volatility_inv_24h"]), ["feature"], ["null_pct"])


@query("feature_health", sql("b", "panel", "factors", "n AS (SELECT unnest(['reversal_4h', 'range_contraction_12h', 'order_flow_bear']) AS feature, unnest([avg((reversal_4h IS NULL)::INT), avg((range_contraction_12h IS NULL)::INT), avg((order_flow_bear IS NULL)::INT)]) * 100 AS p FROM factors)",
    body="SELECT feature, round(p, 6) AS null_pct, CASE WHEN p > 50 THEN 'WARN' WHEN p > 0 THEN 'EXPECTED' ELSE 'OK' END AS status FROM n"))
def feature_health(s, d):  # noqa: ANN001, ANN201
    return shown(pa.null_shares(fa.price_factors(panel_b(s, d)), ["reversal_4h", "range_contraction_12h", "order_flow_bear"]), ["feature", "status"], ["null_pct"])


@query("universe_churn", sql("b", "panel", LIQUID.format(n=10), """sl AS (SELECT ts, row_number() OVER (ORDER BY ts) AS k FROM (SELECT DISTINCT ts FROM liquid)), cur AS (SELECT entity, k FROM liquid JOIN sl USING (ts)),
ch AS (SELECT coalesce(c.k, p.k + 1) AS k, count(c.k) AS n_now, count(p.k) AS n_before, count(*) FILTER (p.k IS NULL) AS added, count(*) FILTER (c.k IS NULL) AS removed FROM cur c FULL JOIN cur p ON c.entity = p.entity AND c.k = p.k + 1 GROUP BY 1)""",
    body=f"SELECT {TS}, n_now, n_before, added, removed, round(CASE WHEN n_before >= 5 THEN greatest(added, removed) / nullif(n_now, 0)::DOUBLE END, 6) AS churn FROM ch JOIN sl USING (k)"))
def universe_churn(s, d):  # noqa: ANN001, ANN201
    return shown(pa.churn(pa.liquid_universe(panel_b(s, d), 10), 5), ["ts", "n_now", "n_before", "added", "removed"], ["churn"])


@query("universe_members", sql("b", "panel", LIQUID.format(n=10), """sl AS (SELECT ts, row_number() OVER (ORDER BY ts) AS k FROM (SELECT DISTINCT ts FROM liquid)), ml AS (SELECT k, ts, list(entity ORDER BY entity) AS m FROM liquid JOIN sl USING (ts) GROUP BY k, ts), mp AS (SELECT a.ts, a.m, coalesce(b.m, []) AS p FROM ml a LEFT JOIN ml b ON a.k = b.k + 1)""",
    body=f"SELECT {TS}, array_to_string(list_filter(m, lambda x: NOT list_contains(p, x)), ',') AS added, array_to_string(list_filter(p, lambda x: NOT list_contains(m, x)), ',') AS removed, len(list_filter(m, lambda x: list_contains(p, x))) AS n_common FROM mp"))
def universe_members(s, d):  # noqa: ANN001, ANN201
    out = pa.membership_changes(pa.liquid_universe(panel_b(s, d), 10))
    return out.select(stamp(F.col("ts")).alias("ts"), F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"), "n_common")


@query("within_universe", sql("b", "panel", "factors", LIQUID.format(n=10), body=f"SELECT strftime(f.ts, '%Y-%m-%d %H:%M') AS ts, f.entity, {six_sql('reversal_1h')} FROM factors f SEMI JOIN liquid l ON f.ts = l.ts AND f.entity = l.entity"))
def within_universe(s, d):  # noqa: ANN001, ANN201
    panel = panel_b(s, d)
    return shown(pa.within(fa.price_factors(panel), pa.liquid_universe(panel, 10)), ["ts", "entity"], ["reversal_1h"])


@query("venue_range", """WITH a AS (SELECT date_trunc('hour', ts) AS ts, (user_id % 10)::VARCHAR AS entity, arg_max(value, (ts, event_id)) AS close FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2), b AS (SELECT max(date_trunc('hour', ts)) AS last FROM events WHERE event_id % 2 = 0 AND user_id % 10 IN (1, 3))
SELECT entity, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M') AS first, round(avg(close), 6) AS close FROM a, b WHERE ts >= last - INTERVAL 5 DAY GROUP BY entity""")
def venue_range(s, d):  # noqa: ANN001, ANN201
    """The second venue's bars of the five days up to the last bar of two entities of the first."""
    two, one = hourly(s, d, venue=1), hourly(s, d, venue=0).where(F.col("entity").isin("1", "3"))
    return tables.ranged(two, 5, against=one).groupBy("entity").agg(F.count("*").alias("n"), stamp(F.min("ts")).alias("first"), F.round(F.avg("close"), 6).alias("close"))


@query("spelled_values", """WITH e AS (SELECT event_id % 12 AS spelling, date_trunc('minute', ts) AS m, ts::DATE AS d, value FROM events)
SELECT spelling, count(*) AS n, strftime(max(CASE WHEN spelling IN (9, 10) THEN NULL WHEN spelling IN (4, 5, 7) THEN d::TIMESTAMP ELSE m END), '%Y-%m-%d %H:%M') AS last, round(sum(CASE WHEN spelling = 3 OR spelling = 8 THEN NULL ELSE value END), 4) AS total FROM e GROUP BY spelling""")
def spelled_values(s, d):  # noqa: ANN001, ANN201
    """Times and values of the events, spelled in twelve ways and read again."""
    k, t = F.col("event_id") % 12, F.date_trunc("minute", "ts").cast("timestamp_ntz")
    f = lambda pattern, by=0: F.date_format(t + F.make_interval(hours=F.lit(by)), pattern)
    forms = [f("yyyy-MM-dd'T'HH:mm:ss'Z'"), F.concat(F.lit("  "), f("yyyy-MM-dd HH:mm:ss")), f("yyyy-MM-dd HH:mm"), f("yyyy-MM-dd'T'HH:mm:ss.SSS'+0900'", 9), f("yyyy-MM-dd"), f("yyyy/MM/dd"), f("yyyyMMdd'T'HHmmss"), f("yyyyMMdd"), f("yyyy-MM-dd HH:mm:ss.SSSSSS'-05:30'", -5), F.lit("2024-02-30 10:00"), F.lit("soon"), f("yyyy-MM-dd'T'HH:mm'Z'")]
    half = F.when(k == 8, F.expr("INTERVAL -30 MINUTES")).otherwise(F.expr("INTERVAL 0 MINUTES"))
    spelled = F.element_at(F.array(*forms), (k + 1).cast("int"))
    number = F.when(k == 3, F.lit("NaN")).when(k == 8, F.lit("n/a")).when(k == 5, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))).otherwise(F.col("value").cast("string"))
    read = tables.table(s, d, "events").select(k.alias("spelling"), (dirty_time(spelled) + half).alias("at"), dirty_number(number).alias("v"))
    return read.groupBy("spelling").agg(F.count("*").alias("n"), stamp(F.max("at")).alias("last"), F.round(F.sum("v"), 4).alias("total"))
