"""Hand-computed cases and metamorphic checks of single operators."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from crosspanel.operators import books, calibration, evaluation, factors, ledger, models, panel, portfolio, reporting, state, statistics
from crosspanel.sources import tables
from crosspanel.streaming import events

T0 = datetime(2024, 1, 1)
BAR = "ts timestamp_ntz, entity string, open double, high double, low double, close double, volume double"


def hours(n: int) -> datetime:
    return T0 + timedelta(hours=n)


def bars(spark, rows):
    """rows of (hour, entity, close)"""
    return spark.createDataFrame([(hours(h), e, c, c, c, c, 1.0) for h, e, c in rows], BAR)


def test_forward_fill_never_fills_back(spark):
    p = panel.forward_filled(bars(spark, [(0, "a", 1.0), (2, "a", 3.0), (1, "b", 5.0), (2, "b", 6.0)]))
    got = {(r.ts, r.entity): r.close for r in p.collect()}
    assert got[hours(1), "a"] == 1.0 and got[hours(0), "b"] is None and got[hours(2), "b"] == 6.0
    assert [r.entity for r in panel.complete(p).select("entity").distinct().collect()] == ["a"]


def test_window_needs_all_its_rows(spark):
    rows = [(h, "a", 100.0 + h % 5) for h in range(30)]
    got = factors.price_factors(panel.forward_filled(bars(spark, rows))).orderBy("ts").collect()
    assert got[23].volatility_inv_24h is None and got[24].volatility_inv_24h is not None
    assert got[0].reversal_1h is None and got[1].reversal_1h == pytest.approx(-0.01)


def test_purged_split(spark):
    f = spark.createDataFrame([(hours(h),) for h in range(100)], "ts timestamp_ntz")
    got = {r.ts: r.split for r in factors.purged_split(f, 0.2, 12).collect()}
    assert got[hours(80)] == "holdout" and got[hours(67)] == "train" and got[hours(68)] == "purged" and got[hours(79)] == "purged"


@pytest.mark.parametrize(("n", "share", "size"), [(100, 0.2, 20), (11, 0.2, 2), (4, 0.01, 1)])
def test_holdout_size(spark, n, share, size):
    f = spark.createDataFrame([(hours(h),) for h in range(n)], "ts timestamp_ntz")
    assert factors.purged_split(f, share, 0).where("split = 'holdout'").count() == size


def test_forward_return_with_lag(spark):
    p = bars(spark, [(i, "a", 100 * 1.1**i) for i in range(6)])
    got = [r.f for r in p.select("ts", factors.forward_return("open", 2, 1).alias("f")).orderBy("ts").collect()]
    assert got[0] == pytest.approx(133.1 / 110 - 1) and got[3:] == [None] * 3


def test_zscore_is_cut_and_null_without_spread(spark):
    f = spark.createDataFrame([(T0, str(i), float(i % 3), 1.0) for i in range(50)] + [(T0, "x", 1e6, 1.0)], "ts timestamp_ntz, entity string, v double, c double")
    got = factors.zscored(f, ["v", "c"]).collect()
    assert max(r.v for r in got) == 3.0 and all(r.c is None for r in got)


def test_neutral_fill(spark):
    f = spark.createDataFrame([("A", None, 1.0, 1.0), ("B", 2.0, None, 1.0), ("C", None, None, None), ("D", None, None, 1.0)], "e string, a double, b double, y double")
    assert sorted((r.e, r.a, r.b) for r in panel.neutral(f, ["a", "b"], "y").collect()) == [("A", 0.0, 1.0), ("B", 2.0, 0.0)]


def test_constant_factor_has_no_ic(spark):
    f = spark.createDataFrame([(T0, str(i), 0.5, float(i)) for i in range(50)], "ts timestamp_ntz, entity string, s double, t double")
    assert evaluation.rank_ic(f, "s", "t").first().ic is None
    assert evaluation.rank_ic(f.withColumn("s", -F.col("t")), "s", "t").first().ic == pytest.approx(-1)


def test_contributions_sum_to_the_ic(spark):
    f = spark.createDataFrame([(T0, str(i), float(i * 7 % 11), float(i * 5 % 13)) for i in range(12)], "ts timestamp_ntz, entity string, s double, t double")
    assert evaluation.ic_contributions(f, "s", "t").agg(F.sum("contribution")).first()[0] == pytest.approx(evaluation.rank_ic(f, "s", "t").first().ic)


def test_regime_labels_do_not_look_ahead(spark):
    rows = [(h, "a", 100 * math.exp(0.01 * math.sin(h / 7) + 0.0001 * h)) for h in range(300)]
    long = factors.regimes(factors.dense_hours(bars(spark, rows), "a"), 24, 24, 72)
    short = factors.regimes(factors.dense_hours(bars(spark, rows[:200]), "a"), 24, 24, 72)
    a = {r.ts: r.regime for r in long.collect()}
    b = {r.ts: r.regime for r in short.collect()}
    assert all(a[t] == v for t, v in b.items()) and set(a.values()) > {"unknown"}


def test_regime_gap_is_unknown(spark):
    rows = [(h, "a", 100.0 + math.sin(h)) for h in range(200) if h != 190]
    got = {r.ts: r for r in factors.regimes(factors.dense_hours(bars(spark, rows), "a"), 24, 24, 72).collect()}
    assert got[hours(191)].regime == "unknown" and got[hours(191)].vol is None and got[hours(185)].regime != "unknown"


def test_non_overlapping_slots(spark):
    at = [5, 8, 11, 17, 23, 29, 35]
    s = spark.createDataFrame([(hours(h),) for h in at] * 2, "ts timestamp_ntz")
    assert sorted(r.ts for r in panel.non_overlapping(s, 6).collect()) == [hours(h) for h in (5, 11, 17, 23, 29, 35)]


def test_costs_and_sides(spark):
    d = spark.createDataFrame([("SHORT", 100.0, 90.0), ("LONG", 100.0, 110.0)], "side string, a double, b double")
    got = d.select(ledger.cost_of(F.col("side")), ledger.side_return(F.col("side"), F.col("a"), F.col("b"))).collect()
    assert [tuple(round(x, 9) for x in r) for r in got] == [(0.003, 0.1), (0.002, 0.1)]


@pytest.mark.parametrize(("notional", "status", "net", "entry"), [(100.0, "evaluated", 9.78, 100.0), (200.0, "evaluated", None, 99.5), (500.0, "insufficient_depth", None, None)])
def test_depth_walk(spark, notional, status, net, entry):
    b = spark.createDataFrame([("k", [(100.0, 1.0), (99.0, 1.0)], [(90.0, 1.0), (91.0, 1.0)])], "key string, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>")
    r = books.depth_cost(b, notional, 22.0).first()
    assert r.status == status
    assert net is None or r.net_pct == pytest.approx(net)
    assert r.entry_vwap == (pytest.approx(entry) if entry else None)


def test_unordered_book_is_invalid(spark):
    b = spark.createDataFrame([("k", [(99.0, 1.0), (100.0, 1.0)], [(90.0, 1.0)])], "key string, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>")
    assert books.depth_cost(b, 10.0, 0.0).first().status == "invalid"


@pytest.mark.parametrize("bad", [0.0, -1.0, float("nan"), float("inf"), None, "twice", "missing"])
def test_bad_prices_make_a_pair_invalid(spark, bad):
    rows = [(1, "a", 100.0)] + ([(7, "a", bad)] if not isinstance(bad, str) else [(7, "a", 110.0)] * 2 if bad == "twice" else [])
    slots = spark.createDataFrame([(hours(0),)], "slot timestamp_ntz")
    r = ledger.exact_returns(bars(spark, rows), slots, 1, 6).first()
    assert r.status == "invalid" and r.ret is None


def test_as_of_takes_the_last_value_at_or_before(spark):
    left = spark.createDataFrame([(1, "a", hours(3)), (2, "a", hours(0)), (3, "b", hours(9))], "id int, entity string, at timestamp_ntz")
    got = ledger.as_of(left, bars(spark, [(1, "a", 1.0), (3, "a", 3.0), (4, "a", 4.0)]), "entity", "at", "ts", "close", "px")
    assert sorted((r.id, r.px) for r in got.collect()) == [(1, 3.0), (2, None), (3, None)]


def test_buffer_keeps_a_held_name(spark):
    a, b = [("a", 3.0), ("b", 2.0), ("c", 1.0), ("d", 0.0)], [("c", 3.0), ("a", 2.5), ("b", 1.0), ("d", 0.0)]
    s = spark.createDataFrame([(hours(h), e, v) for h, slot in enumerate((a, b)) for e, v in slot], "ts timestamp_ntz, entity string, score double")
    got = {r.ts: r.longs for r in portfolio.buffered(portfolio.ranked_slots(s, 3), 1, 0, 1).collect()}
    assert got == {hours(0): ["a"], hours(1): ["a"]}
    got = {r.ts: r.longs for r in portfolio.buffered(portfolio.ranked_slots(s, 3), 1, 0, 0).collect()}
    assert got[hours(1)] == ["c"]


def test_long_economics(spark):
    s = spark.createDataFrame([(T0, "a", 1.0), (T0, "b", 0.5)], "ts timestamp_ntz, entity string, score double")
    r = spark.createDataFrame([(T0, "a", 0.1)], "ts timestamp_ntz, entity string, ret double")
    act = spark.createDataFrame([(T0, True)], "ts timestamp_ntz, active boolean")
    one = portfolio.long_economics(s, r, act, 1, 0.002).first()
    assert (one.gross, one.net) == (pytest.approx(0.1), pytest.approx(0.098))
    assert portfolio.long_economics(s, r, act, 2, 0.002).first().gross is None  # a missing return voids the slot


def test_weekly_rotation_needs_two_reviews_and_cools_down(spark):
    rec = [(datetime(2024, 1, 1) + timedelta(hours=6 * i), 0.0, 1.0) for i in range(40)]
    r = spark.createDataFrame([(t, t + timedelta(minutes=5), t + timedelta(hours=9), "bull", m, b) for t, m, b in rec], "signal_at timestamp_ntz, recorded_at timestamp_ntz, evaluated_at timestamp_ntz, regime string, model_net double, baseline_net double")
    reviews = spark.createDataFrame([(datetime(2024, 1, d),) for d in (8, 15, 22)], "review_at timestamp_ntz")
    got = [(x.policy, x.reason) for x in state.rotation(state.weekly_evidence(r), reviews, 10, 3, 0.5).orderBy("review_at").collect()]
    assert got[:2] == [("model", "await_confirmation"), ("reversal", "changed")] and got[2][1] == "retain"


def test_blend(spark):
    assert spark.range(1).select(state.blended_net(F.lit(0.25), F.lit(0.0), F.lit(1.0), F.lit(2.0))).first()[0] == pytest.approx(1.225)


def test_net_and_gross_wins_differ(spark):
    h = spark.createDataFrame([("SHORT", T0, 0.10, -0.10), ("SHORT", hours(1), 0.20, -0.05)], "side string, entry_time timestamp_ntz, realized_pct double, net_pct double")
    r = reporting.realized_stats(h).first()
    assert (r.gross_win_pct, r.win_pct) == (100.0, 0.0)


def test_bootstrap_matches_numpy(spark):
    import numpy as np

    v = [math.sin(i) for i in range(30)]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double")
    r = statistics.block_bootstrap(d, "v", "i", 4, 50).first()
    starts = np.random.default_rng(42).integers(0, 30, size=(50, 8))
    means = np.array(v)[((starts[:, :, None] + np.arange(4)) % 30).reshape(50, -1)[:, :30]].mean(axis=1)
    assert (r.low, r.high) == (pytest.approx(np.quantile(means, 0.025)), pytest.approx(np.quantile(means, 0.975)))


def test_attribution_sums_to_the_basket_mean(spark):
    p = spark.createDataFrame([(hours(h), e, float(h + ord(e))) for h in range(3) for e in "abc"], "ts timestamp_ntz, entity string, r double")
    total = statistics.attribution(p, "r").agg(F.sum("contribution")).first()[0]
    assert total == pytest.approx(p.groupBy("ts").agg(F.avg("r").alias("m")).agg(F.avg("m")).first()[0])


def test_ridge_solves_the_penalised_system(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = x @ [2.0, -1.0] + 0.5
    f = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    w = models.ridge(f, ["a", "b"], "y", 3.0)
    xc = x - x.mean(axis=0)
    want = np.linalg.solve(xc.T @ xc + 3.0 * np.eye(2), xc.T @ (y - y.mean()))
    assert [w["a"], w["b"]] == pytest.approx(list(want))


def test_calibration_counts_zero_scores_as_hits_of_zero_returns(spark):
    s = spark.createDataFrame([(T0, 0.0, 0.0), (T0, 1.0, 0.1), (T0, -1.0, None)], "ts timestamp_ntz, score double, ret double")
    got = {r.bucket: (r.n, r.hit_rate) for r in calibration.calibrate(s).collect()}
    assert got == {0: (1, 1.0), 2: (1, 1.0)}


def test_row_order_does_not_matter(spark):
    rows = [(h, e, 100.0 + h * (1 + ord(e) % 3)) for h in range(40) for e in "abcdefg"]
    a, b = bars(spark, rows), bars(spark, rows[::-1])
    ic = lambda x: sorted((r.ts, round(r.ic or 0, 9)) for r in evaluation.rank_ic(factors.price_factors(panel.forward_filled(x)).withColumn("f", factors.forward_return("close", 2)), "reversal_1h", "f").collect())
    assert ic(a) == ic(b)


def test_upsert_and_append(spark):
    old, new = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y", 2.0), (2, "z", 3.0)], "k int, v string, w double")
    assert sorted((r.k, r.v) for r in tables.merge(old, new, ["k"]).collect()) == [(1, "y"), (2, "z")]
    assert sorted((r.k, r.v) for r in tables.merge(old, new, ["k"], "old").collect()) == [(1, "x"), (2, "z")]
    assert [r.k for r in tables.append_missing(old, new, ["k"]).collect()] == [2]


def test_sinks_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for form in ("parquet", "json", "csv"):
        tables.write_result(d, str(tmp_path / form), form)
        got = tables.read_csv(spark, str(tmp_path / form), "k int, v string") if form == "csv" else spark.read.schema("k int, v string").format(form).load(str(tmp_path / form))
        assert sorted((r.k, r.v) for r in got.collect()) == [(1, "a"), (2, None)]
    sealed = tables.enveloped(d, ["k"])
    assert tables.broken_envelopes(sealed).count() == 0
    assert tables.broken_envelopes(sealed.withColumn("payload", F.concat("payload", F.lit(" ")))).count() == 2


def test_foreach_batch_appends_once(spark, tmp_path):
    d = spark.createDataFrame([(1, 0.5), (2, 0.7)], "k int, net double")
    for _ in range(2):
        events.append_matured(d, str(tmp_path / "ledger"), ["k"])
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_streams_are_written_to_files(spark, tmp_path, mode):
    d = spark.createDataFrame([(i, datetime(2024, 1, 1, i), i % 3, "view", 1.0, "{}") for i in range(12)], events.EVENT)
    d.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = events.source(spark, str(tmp_path / "events"), files_per_trigger=1)
    stream = stream.select("user_id") if mode == "append" else stream.groupBy("user_id").count()
    for rows in (stream, stream.where("user_id > 5")):
        out = events.run_once(rows, f"files_{mode}", str(tmp_path / f"checkpoint-{rows is stream}"), mode)
        want = {} if rows is not stream else {0: 4, 1: 4, 2: 4}
        count = F.count("*") if mode == "append" else F.sum("count")
        assert {r.user_id: r.n for r in out.groupBy("user_id").agg(count.alias("n")).collect()} == want
        assert out.inputFiles() and not spark.catalog.tableExists(f"files_{mode}")
