"""Roll-ups over planted lives of forecasts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.functions.columns import six, stamp
from crosspanel.operators import audits as au
from crosspanel.plans.panel_queries import sql
from crosspanel.plans.walk_queries import spearman_sql
from crosspanel.sources.bars import hourly
from crosspanel.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NOW = "2024-01-29 03:00:00"


def query(name: str, oracle: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


#: Every six hours a slot; what became of it follows from the sum of its events' numbers.
LIVES = f"""g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 05:00:00', TIMESTAMP '{NOW}', INTERVAL 6 HOUR)) AS slot),
h AS (SELECT date_trunc('hour', ts) AS slot, sum(event_id)::BIGINT AS k, count(*) AS n FROM events GROUP BY 1),
sg AS (SELECT slot, k, n, CASE WHEN k % 11 = 3 THEN 'missed' ELSE 'recorded' END AS status FROM h WHERE k % 5 > 0),
oc AS (SELECT slot, CASE WHEN k % 7 = 2 THEN 'invalid' ELSE 'evaluated' END AS status, CASE WHEN k % 7 = 2 THEN 'missing_prices' END AS reason, CASE WHEN k % 7 <> 2 THEN (k % 100)::DOUBLE / 100 - 0.5 END AS saved_ic FROM sg WHERE status = 'recorded' AND k % 9 > 0),
cm AS (SELECT slot, CASE WHEN k % 8 > 0 THEN (k % 100)::DOUBLE / 100 - 0.5 + ((k % 9) - 4)::DOUBLE / 100 END AS legacy_ic, k % 3 > 0 AS measured FROM h WHERE k % 4 > 0),
er AS (SELECT slot, CASE k % 13 WHEN 1 THEN 'history' WHEN 2 THEN 'measurement' WHEN 3 THEN 'signal' ELSE 'comparison' END AS stage FROM h WHERE k % 13 BETWEEN 1 AND 4),
aw AS (SELECT g.slot, coalesce(oc.status, sg.status, CASE WHEN er.stage = 'signal' THEN 'source_error' ELSE 'awaiting_signal' END) AS status, coalesce(sg.status, '') AS signal, reason, saved_ic, coalesce(sg.n, 0) AS n_names, legacy_ic, saved_ic - legacy_ic AS difference,
  coalesce(round(abs(saved_ic - legacy_ic), 9) >= 0.03, false) AS warns, TIMESTAMP '{NOW}' > g.slot + INTERVAL 55 HOUR AS overdue, er.stage,
  CASE WHEN er.stage IN ('history', 'comparison') THEN 'error' WHEN legacy_ic IS NOT NULL THEN 'available' WHEN overdue THEN 'missing' ELSE 'waiting' END AS legacy_status,
  CASE WHEN er.stage = 'measurement' THEN 'error' WHEN measured THEN 'available' WHEN overdue THEN 'missing' ELSE 'waiting' END AS measurement_status,
  CASE WHEN h.k % 6 > 0 THEN 'verified' WHEN TIMESTAMP '{NOW}' <= g.slot + INTERVAL 45 MINUTE THEN 'waiting' ELSE 'unverified' END AS delivery, g.slot + INTERVAL 45 MINUTE < TIMESTAMP '{NOW}' AS closed
  FROM g LEFT JOIN h USING (slot) LEFT JOIN sg USING (slot) LEFT JOIN oc USING (slot) LEFT JOIN cm USING (slot) LEFT JOIN er USING (slot)),
ax AS (SELECT *, CASE WHEN 'error' IN (legacy_status, measurement_status) THEN 'error' ELSE legacy_status END AS comparison_status FROM aw)"""


def audited(s: SparkSession, d: str) -> DataFrame:
    at = lambda c: F.expr(f"TIMESTAMP_NTZ '{c}'")
    h = table(s, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("slot")).agg(F.sum("event_id").alias("k"), F.count("*").alias("n"))
    k = F.col("k")
    ic = (k % 100).cast("double") / 100 - 0.5
    slots = s.range(1).select(F.explode(F.sequence(at("2024-01-01 05:00:00"), at(NOW), F.expr("INTERVAL 6 HOURS"))).alias("slot"))
    signals = h.where(k % 5 > 0).select("slot", "k", F.when(k % 11 == 3, "missed").otherwise("recorded").alias("status"), F.col("n").alias("n_names"))
    bad = k % 7 == 2
    outcomes = signals.where((F.col("status") == "recorded") & (k % 9 > 0)).select("slot", F.when(bad, "invalid").otherwise("evaluated").alias("status"), F.when(bad, F.lit("missing_prices")).alias("reason"), F.when(~bad, ic).alias("saved_ic"))
    comparisons = h.where(k % 4 > 0).select("slot", F.when(k % 8 > 0, ic + ((k % 9) - 4).cast("double") / 100).alias("legacy_ic"), (k % 3 > 0).alias("measured"))
    deliveries = h.select("slot", (k % 6 > 0).alias("complete"))
    errors = h.where((k % 13).between(1, 4)).select("slot", F.element_at(F.array(*[F.lit(x) for x in ("history", "measurement", "signal", "comparison")]), (k % 13).cast("int")).alias("stage"))
    return au.audit_windows(slots, signals, outcomes, comparisons, deliveries, errors, at(NOW), warn=0.03 - 1e-9)


STATES = ["status", "signal", "reason", "n_names", "warns", "legacy_status", "measurement_status", "comparison_status", "delivery"]


@query("audit_windows", f"WITH {LIVES} SELECT strftime(slot, '%Y-%m-%d %H:%M') AS slot, {', '.join(STATES)}, round(saved_ic, 6) + 0.0::DOUBLE AS saved_ic, round(difference, 6) + 0.0::DOUBLE AS difference FROM ax")
def audit_windows(s: SparkSession, d: str) -> DataFrame:
    return audited(s, d).select(stamp(F.col("slot")).alias("slot"), *STATES, six(F.col("saved_ic")).alias("saved_ic"), six(F.col("difference")).alias("difference"))


COUNTED = ["scheduled", "recorded", "evaluated", "missed", "invalid", "pending", "compared", "differences", "delivery_verified", "source_errors", "comparison_errors", "legacy_missing"]


@query("audit_rollup", f"""WITH {LIVES}, c AS (SELECT count(*) AS scheduled, count(*) FILTER (signal = 'recorded') AS recorded, count(*) FILTER (status = 'evaluated') AS evaluated, count(*) FILTER (signal = 'missed') AS missed, count(*) FILTER (status = 'invalid') AS invalid,
count(*) FILTER (status IN ('recorded', 'awaiting_signal', 'source_error')) AS pending, count(*) FILTER (status = 'evaluated' AND legacy_ic IS NOT NULL) AS compared, count(*) FILTER (warns) AS differences, count(*) FILTER (delivery = 'verified') AS delivery_verified,
count(*) FILTER (status = 'source_error') AS source_errors, count(*) FILTER (status = 'evaluated' AND comparison_status = 'error') AS comparison_errors, count(*) FILTER (status = 'evaluated' AND legacy_status = 'missing') AS legacy_missing, avg(saved_ic) FILTER (status = 'evaluated') AS ic,
arg_max(status, slot) FILTER (closed) AS lc, arg_max(delivery, slot) FILTER (closed) AS ld, arg_max(status, slot) FILTER (status IN ('evaluated', 'invalid')) AS lo, coalesce(bool_or(stage IS NOT NULL), false) AS faulty FROM ax),
i AS (SELECT *, list_filter([CASE WHEN lc = 'missed' THEN 'latest_signal_missing' END, CASE WHEN ld = 'unverified' THEN 'latest_delivery_unverified' END, CASE WHEN lo = 'invalid' THEN 'latest_outcome_invalid' END, CASE WHEN faulty THEN 'input_errors_active' END, CASE WHEN legacy_missing > 0 THEN 'legacy_comparison_missing' END], lambda x: x IS NOT NULL) AS issues FROM c)
SELECT {', '.join(COUNTED)}, round(ic, 6) + 0.0::DOUBLE AS mean_saved_ic, array_to_string(issues, ',') AS issues, CASE WHEN len(issues) > 0 THEN 'attention' ELSE 'monitoring' END AS status FROM i""")
def audit_rollup(s: SparkSession, d: str) -> DataFrame:
    return au.audit_summary(audited(s, d)).select(*COUNTED, six(F.col("mean_saved_ic")).alias("mean_saved_ic"), F.array_join("issues", ",").alias("issues"), "status")


#: Quotes of the second venue around the first one's bars: some are crossed, stale, missing or twice there.
VENUE = """bx AS (SELECT ts, entity, open, high, low, close, volume, (hour(ts) * 7 + entity::BIGINT * 3 + dayofmonth(ts)) % 97 AS k FROM bars),
it AS (SELECT ts AS slot, entity, close - open AS score, close / open - 1 AS raw, entity IN ('1', '2', '3') AS model, entity IN ('3', '4') AS selected FROM bx WHERE hour(ts) % 6 = 5),
qt AS (SELECT slot, phase, entity, CASE WHEN k = 0 THEN high + 1 ELSE low END AS bid, high AS ask, volume AS bid_size, volume AS ask_size, CASE WHEN k = 1 THEN 61 ELSE 5 END AS age FROM (SELECT it.slot, 'entry' AS phase, bx.* FROM it JOIN bx ON bx.ts = it.slot AND bx.entity = it.entity UNION ALL
  SELECT it.slot, 'exit', bx.* FROM it JOIN bx ON bx.ts = it.slot + INTERVAL 6 HOUR AND bx.entity = it.entity), range(2) r(copy) WHERE k <> 2 AND (copy = 0 OR k = 3)),
qp AS (SELECT slot, phase, entity, count(*) AS n, bool_and(bid > 0 AND bid <= ask AND bid_size > 0 AND age BETWEEN -5 AND 60) AS sound FROM qt GROUP BY ALL),
qs AS (SELECT slot, phase, CASE WHEN count(n) = 0 THEN 'waiting' WHEN count(*) FILTER (n IS NULL OR n <> 1 OR NOT sound) > 0 THEN 'invalid' ELSE 'observed' END AS status FROM (SELECT * FROM it, (VALUES ('entry'), ('exit')) p(phase)) LEFT JOIN qp USING (slot, phase, entity) GROUP BY slot, phase),
vs AS (SELECT slot, max(status) FILTER (phase = 'entry') AS entry, max(status) FILTER (phase = 'exit') AS exit, CASE WHEN entry = 'observed' AND exit = 'observed' THEN 'evaluated' WHEN 'invalid' IN (entry, exit) THEN 'invalid' ELSE 'observing' END AS status FROM qs GROUP BY slot),
vr AS (SELECT it.*, (b.bid + b.ask) / (a.bid + a.ask) - 1 AS mid, 1 - b.ask / a.bid - 0.0012::DOUBLE AS short FROM it JOIN vs ON vs.slot = it.slot AND vs.status = 'evaluated' JOIN qt a ON a.slot = it.slot AND a.entity = it.entity AND a.phase = 'entry' JOIN qt b ON b.slot = it.slot AND b.entity = it.entity AND b.phase = 'exit'),
vm AS (SELECT slot, count(*) AS n_names, 100 * avg(mid - raw) AS mid_gap_pp, 100 * avg(short) FILTER (model) AS model_short_pct, 100 * avg(short) FILTER (selected) AS selected_short_pct FROM vr GROUP BY slot)"""
VALUES = ["venue_ic", "same_pool_ic", "mid_gap_pp", "model_short_pct", "selected_short_pct", "selected_minus_model_pp"]


def venue(s: SparkSession, d: str) -> DataFrame:
    bars = hourly(s, d).withColumn("k", (F.hour("ts") * 7 + F.col("entity").cast("bigint") * 3 + F.dayofmonth("ts")) % 97)
    k, of = F.col("k"), F.col("entity")
    intents = bars.where(F.hour("ts") % 6 == 5).select(F.col("ts").alias("slot"), "entity", (F.col("close") - F.col("open")).alias("score"), (F.col("close") / F.col("open") - 1).alias("raw"), of.isin("1", "2", "3").alias("model"), of.isin("3", "4").alias("selected"))
    copies = F.explode(F.when(k == 2, F.array().cast("array<int>")).when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    quoted = bars.select("ts", "entity", F.when(k == 0, F.col("high") + 1).otherwise(F.col("low")).alias("bid"), F.col("high").alias("ask"), F.col("volume").alias("bid_size"), F.col("volume").alias("ask_size"), F.when(k == 1, 61).otherwise(5).alias("age"), copies.alias("copy"))
    due = intents.select("slot", "entity", F.explode(F.array(F.struct(F.lit("entry").alias("phase"), F.col("slot").alias("ts")), F.struct(F.lit("exit").alias("phase"), (F.col("slot") + F.expr("INTERVAL 6 HOURS")).alias("ts")))).alias("p")).select("slot", "entity", "p.*")
    return au.venue_windows(intents, due.join(quoted, ["ts", "entity"]), 12.0, 5)


@query("venue_windows", sql("a", VENUE, spearman_sql("ci", "vr", "slot", "score", "mid"), spearman_sql("cr", "vr", "slot", "score", "raw"), body="""SELECT strftime(vs.slot, '%Y-%m-%d %H:%M') AS slot, entry, exit, status, n_names, round(ci.ic, 6) + 0.0::DOUBLE AS venue_ic, round(cr.ic, 6) + 0.0::DOUBLE AS same_pool_ic, round(mid_gap_pp, 6) + 0.0::DOUBLE AS mid_gap_pp,
round(model_short_pct, 6) + 0.0::DOUBLE AS model_short_pct, round(selected_short_pct, 6) + 0.0::DOUBLE AS selected_short_pct, round(selected_short_pct - model_short_pct, 6) + 0.0::DOUBLE AS selected_minus_model_pp FROM vs LEFT JOIN vm USING (slot) LEFT JOIN ci USING (slot) LEFT JOIN cr USING (slot)"""))
def venue_windows(s: SparkSession, d: str) -> DataFrame:
    return venue(s, d).select(stamp(F.col("slot")).alias("slot"), "entry", "exit", "status", "n_names", *[six(F.col(c)).alias(c) for c in VALUES])


@query("venue_rollup", sql("a", VENUE, body="SELECT count(*) AS recorded, count(*) FILTER (status = 'evaluated') AS evaluated, count(*) FILTER (status = 'invalid') AS invalid, count(*) FILTER (status = 'observing') AS observing, CASE WHEN arg_max(status, slot) = 'invalid' THEN 'attention' ELSE 'observing' END AS status FROM vs"))
def venue_rollup(s: SparkSession, d: str) -> DataFrame:
    return au.venue_summary(venue(s, d))


@query("execution_rollup", sql("a", """w AS (SELECT ts AS slot, entity, (entity::BIGINT + dayofmonth(ts)) % 10 < 5 AS model, entity IN ('0', '2', '4', '6', '8') AS selected, hour(ts) * 3 + entity::BIGINT AS k, close FROM bars WHERE hour(ts) % 6 = 5),
fu AS (SELECT slot, entity, CASE k % 31 WHEN 0 THEN 'gap' WHEN 1 THEN 'boundary_uncertain' ELSE 'observed' END AS status, close AS rate FROM w WHERE k % 37 > 0),
j AS (SELECT w.*, CASE WHEN fu.status = 'observed' THEN rate END AS rate FROM w LEFT JOIN fu USING (slot, entity)), r AS (SELECT slot, count(*) AS records, count(*) FILTER (status <> 'observed') AS uncertain FROM fu GROUP BY slot)""",
    body="""SELECT strftime(slot, '%Y-%m-%d %H:%M') AS slot, round(CASE WHEN count(*) FILTER (model) = 5 AND count(rate) FILTER (model) = 5 THEN avg(rate) FILTER (model) END, 6) + 0.0::DOUBLE AS model_funding_bps,
round(CASE WHEN count(*) FILTER (selected) = 5 AND count(rate) FILTER (selected) = 5 THEN avg(rate) FILTER (selected) END, 6) + 0.0::DOUBLE AS selected_funding_bps, coalesce(any_value(records), 0) AS records, coalesce(any_value(uncertain), 0) AS uncertain FROM j LEFT JOIN r USING (slot) GROUP BY slot"""))  # fmt: skip
def execution_rollup(s: SparkSession, d: str) -> DataFrame:
    b, of = hourly(s, d).where(F.hour("ts") % 6 == 5), F.col("entity").cast("bigint")
    k = F.hour("ts") * 3 + of
    windows = b.select(F.col("ts").alias("slot"), "entity", ((of + F.dayofmonth("ts")) % 10 < 5).alias("model"), F.col("entity").isin("0", "2", "4", "6", "8").alias("selected"))
    funding = b.where(k % 37 > 0).select(F.col("ts").alias("slot"), "entity", F.when(k % 31 == 0, "gap").when(k % 31 == 1, "boundary_uncertain").otherwise("observed").alias("status"), F.col("close").alias("rate_sum_bps"))
    out = au.execution_summary(windows, funding)
    return out.select(stamp(F.col("slot")).alias("slot"), six(F.col("model_funding_bps")).alias("model_funding_bps"), six(F.col("selected_funding_bps")).alias("selected_funding_bps"), "records", "uncertain")


@query("witness_faults", """WITH m AS (SELECT o_custkey % 200 AS id, o_orderkey, 'n' || (o_orderkey % 2000)::VARCHAR AS entity, o_totalprice::DOUBLE AS price, o_custkey, o_orderdate FROM orders),
e AS (SELECT id, count(*) AS n, count(DISTINCT entity) AS names, bool_or(o_orderkey % 1009 = 7) AS bad_score, bool_or(o_orderkey % 1013 = 9) AS bad_features, bool_or(o_orderkey % 1019 = 11) AS bad_input, bool_or(o_orderkey % 1021 = 13) AS knows FROM m WHERE id % 50 <> 17 OR o_orderkey % 40 = 1 GROUP BY id),
w AS (SELECT unnest(range(200)) AS id), f AS (SELECT w.id, unnest([CASE WHEN w.id % 41 = 3 OR w.id % 43 = 5 THEN 'contract' END, CASE WHEN w.id % 37 = 2 THEN 'digest' END, CASE WHEN coalesce(n, 0) < 10 THEN 'size' END, CASE WHEN n <> names THEN 'repeated' END, CASE WHEN bad_score THEN 'score' END, CASE WHEN bad_features THEN 'features' END,
  CASE WHEN bad_input THEN 'input' END, CASE WHEN knows THEN 'outcome' END, CASE WHEN (w.id % 47 <> 7) <> (CASE WHEN w.id % 43 = 5 THEN true ELSE w.id % 5 > 0 END) THEN 'timely' END]) AS fault FROM w LEFT JOIN e USING (id))
SELECT fault, count(*) AS n, min(id)::BIGINT AS first FROM f WHERE fault IS NOT NULL GROUP BY fault""")
def witness_faults(s: SparkSession, d: str) -> DataFrame:
    i, o = F.col("id"), F.col("o_orderkey")
    at = lambda t: F.expr(f"TIMESTAMP_NTZ '{t}'")
    minutes = F.when(i % 43 == 5, -5).when(i % 5 > 0, 30).otherwise(50)
    w = s.range(200).select("id", F.when(i % 41 == 3, 2).otherwise(1).alias("schema"), F.lit(6).alias("horizon"), at("2024-01-01 05:00:00").alias("signal_at"), (at("2024-01-01 05:00:00") + F.make_interval(mins=minutes)).alias("recorded_at"), (i % 47 != 7).alias("timely"), F.when(i % 37 == 2, F.lit("x")).otherwise(F.sha2(i.cast("string"), 256)).alias("digest"))
    m = table(s, d, "orders").withColumn("id", F.col("o_custkey") % 200).where((i % 50 != 17) | (o % 40 == 1))
    inputs = F.create_map(F.lit("a"), F.when(o % 1019 == 11, F.lit(float("inf"))).otherwise(1.0), F.when(o % 1013 == 9, F.lit("c")).otherwise("b"), F.lit(None).cast("double"))
    members = m.select("id", F.concat(F.lit("n"), (o % 2000).cast("string")).alias("entity"), F.when(o % 1009 == 7, F.lit(float("nan"))).otherwise(F.col("o_totalprice").cast("double")).alias("score"), inputs.alias("inputs"), F.when(o % 1021 == 13, 1.0).alias("actual"))
    return au.witness_faults(w, members, ["a", "b"], at("2024-01-02 00:00:00")).groupBy("fault").agg(F.count("*").alias("n"), F.min("id").alias("first"))
