"""Walk-forward, trial and audit operators against hand-computed cases."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import evaluation as ev
from crosspanel.operators import models as mo
from crosspanel.operators import reporting as rp
from crosspanel.operators import statistics as sx
from crosspanel.operators import walkforward as wf


def at(hours: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def panel(seed: int, slots: int, entities: int):
    draw = np.random.default_rng(seed)
    return [(at(t), f"e{e}", *(float(x) for x in draw.normal(size=5))) for t in range(slots) for e in range(entities)]


SCHEMA = "ts timestamp_ntz, entity string, x double, y double, target double, ret double, residual double"


def fitted(part):
    x, y = part[:, :2], part[:, 2]
    centred = x - x.mean(axis=0)
    w = np.linalg.solve(centred.T @ centred + np.eye(2), centred.T @ (y - y.mean()))
    return w, y.mean() - x.mean(axis=0) @ w


def test_folds_train_before_they_test(spark):
    rows = panel(1, 33, 6)
    models, tested = wf.walk_forward(spark.createDataFrame(rows, SCHEMA), ["x", "y"], "target", 12, 5, 2, least=10)
    got = {r.fold: r for r in models.collect()}
    assert sorted(got) == [0, 1, 2] and [got[f].retrain for f in sorted(got)] == [1, 2, 3]  # test slots 14.., 19.., 24..; from 29 on there are too few
    for fold, m in got.items():
        part = np.array([r[2:5] for i, r in enumerate(rows) if fold * 5 <= i // 6 < fold * 5 + 12])
        w, b = fitted(part)
        assert m.n == len(part) and np.allclose(m.weights, w) and np.isclose(m.intercept, b)
    scored = tested.collect()
    assert {r.slot for r in scored} == set(range(14, 29))
    for r in scored:
        assert r.fold == (r.slot - 14) // 5 and np.isclose(r.score, got[r.fold].intercept + got[r.fold].weights[0] * r.x + got[r.fold].weights[1] * r.y)


def test_folds_of_few_rows_have_no_model(spark):
    rows = [(*r[:2], None if i < 40 else r[2], *r[3:]) for i, r in enumerate(panel(2, 30, 5))]
    frame = spark.createDataFrame(rows, SCHEMA)
    models, tested = wf.walk_forward(frame, ["x", "y"], "target", 10, 5, least=30)
    assert {r.fold: r.retrain for r in models.collect()} == {1: 1, 2: 2, 3: 3}  # the first slots lack a feature
    assert tested.where("x IS NULL OR fold = 0").count() == 0


def test_trading_carries_baskets_across_retrains(spark):
    rows = panel(3, 60, 9)
    _, tested = wf.walk_forward(spark.createDataFrame(rows, SCHEMA), ["x", "y"], "target", 20, 10, least=10)
    got = wf.traded_slots(wf.trading_slots(tested, 20, 10, 0, 4), 2, 2, 1, 0.001, 0.002).orderBy("ts").collect()
    values = {(r[0], r[1]): r for r in rows}
    longs, shorts, seen = [], [], []
    for fold in range(4):
        w, b = fitted(np.array([r[2:5] for i, r in enumerate(rows) if fold * 10 <= i // 9 < fold * 10 + 20]))
        for slot in range(20 + fold * 10, 30 + fold * 10, 4):
            score = {f"e{e}": b + w @ np.array(values[at(slot), f"e{e}"][2:4]) for e in range(9)}
            best = sorted(score, key=lambda m: (-score[m], m))
            worst = sorted(score, key=lambda m: (score[m], m))
            if not longs:
                new_l, new_s = best[:2], worst[:2]
            else:
                stay = [m for m in best[:3] if m in longs]
                new_l = (stay + [m for m in best[:2] if m not in stay])[:2]
                stay = [m for m in worst[:3] if m in shorts and m not in new_l]
                new_s = (stay + [m for m in worst[:2] if m not in stay and m not in new_l])[:2]
            mean = lambda names: np.mean([values[at(slot), m][5] for m in names])  # noqa: B023, E731
            turnover = (sum(m not in longs for m in new_l) / 2 + sum(m not in shorts for m in new_s) / 2) / 2
            rank = lambda x: np.argsort(np.argsort(x))
            ic = np.corrcoef(rank([score[f"e{e}"] for e in range(9)]), rank([values[at(slot), f"e{e}"][6] for e in range(9)]))[0, 1]
            seen.append((at(slot), fold + 1, new_l, new_s, mean(new_l) - mean(new_s), turnover, mean(new_l) - mean(new_s) - turnover * 0.002 - 0.002, ic))
            longs, shorts = new_l, new_s
    assert [(r.ts, r.retrain, r.longs, r.shorts) for r in got] == [x[:4] for x in seen]
    assert np.allclose([(r.gross, r.turnover, r.net, r.ic) for r in got], [x[4:] for x in seen])


def test_rank_ic_is_not_pearson(spark):
    rows = [(1, float(i), float(np.exp(i))) for i in range(8)]
    f = spark.createDataFrame(rows, "ts int, s double, t double")
    assert ev.rank_ic(f, "s", "t").first().ic == pytest.approx(1.0) and f.agg(F.corr("s", "t")).first()[0] < 0.8
    draw = np.random.default_rng(0)
    a, b = draw.normal(size=900).round(1), draw.normal(size=900).round(1)
    average = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    pooled = ev.pooled_ic(spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a double, b double"), "a", "b").first()
    assert pooled.n == 900 and pooled.ic == pytest.approx(np.corrcoef(average(a), average(b))[0, 1])


def test_holdout_gate_empties_the_basket(spark):
    hours = range(0, 24 * 10)
    names = [f"e{i}" for i in range(7)]
    scores = spark.createDataFrame([(at(h), n, float((i * 7 + h // 24) % 11)) for h in hours for i, n in enumerate(names)], "ts timestamp_ntz, entity string, score double")
    returns = spark.createDataFrame([(at(h), n, 0.01 * (i - 2) if h < 24 * 9 else None) for h in hours for i, n in enumerate(names)], "ts timestamp_ntz, entity string, ret double")
    slots = wf.holdout_slots(scores, 0.5, (11, 23), 12)
    assert [r.ts for r in slots.orderBy("ts").collect()] == [at(24 * d + h) for d in range(5, 10) for h in (11, 23)]
    active = spark.createDataFrame([(at(24 * d + h), (d, h) != (6, 23)) for d in range(5, 10) for h in (11, 23)], "ts timestamp_ntz, active boolean")
    got = wf.holdout_measures(scores, returns, slots, active, top=2, cost=0.1).first()
    assert (got.n_exact, got.n_mature, got.n_active, got.n_ic, got.n_top) == (10, 8, 7, 7, 7)
    picks = {d: sorted(names, key=lambda n: (-((names.index(n) * 7 + d) % 11), n))[:2] for d in range(5, 9)}
    order = [(d, h) for d in range(5, 9) for h in (11, 23)]
    held, turnover = [], []
    for d, h in order:
        if (d, h) == (6, 23):
            held = []
            continue
        turnover.append(sum(p not in held for p in picks[d]) / 2)
        held = picks[d]
    assert got.turnover == pytest.approx(np.mean(turnover)) and got.gross - got.net == pytest.approx(0.1 * np.mean(turnover))


def test_gate_fails_closed(spark):
    nan = float("nan")
    cases = {
        (0.05, 0.06, 6, 0, None, False): "promote", (0.05, 0.07, 6, 0, None, False): "worse", (0.039, 0.0, 6, 0, None, False): "below_floor", (None, 0.01, 6, 20, 1.0, False): "below_floor",
        (nan, 0.01, 6, 20, 1.0, False): "below_floor", (0.05, nan, 6, 20, 1.0, False): "worse", (0.05, None, 6, 0, None, False): "promote", (0.05, 0.05, 12, 10, 0.001, False): "promote", (0.05, 0.05, 12, 9, 0.001, False): "economics",
        (0.05, 0.05, 12, 10, 0.0, False): "economics", (0.05, 0.05, 12, 10, None, False): "economics", (0.05, 0.05, 12, 10, nan, False): "economics", (0.05, 0.05, 6, 10, -1.0, False): "promote", (None, None, 12, 0, None, True): "promote",
    }
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, new double, old double, h int, n int, net double, force boolean")
    got = frame.select("i", mo.promotion(F.col("new"), F.col("old"), F.col("h"), F.col("n"), F.col("net"), F.col("force")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == list(cases.values())


def test_importances_and_sensitivities(spark):
    assert mo.importances([{"a": 1.0, "b": -3.0, "intercept": 9.0}, {"b": 2.0}, {"a": 0.0}]) == pytest.approx({"a": 0.25 / 3, "b": 1.75 / 3})
    f = spark.createDataFrame([(1, "p", 1.0, 5.0), (1, "q", 2.0, 5.0), (1, "r", 4.0, 8.0)], "ts int, entity string, a double, b double")
    got = {(r.entity, r.feature): r.delta for r in mo.sensitivities(f, {"a": 2.0, "b": -1.0, "intercept": 3.0}, "ts").collect()}
    assert got == {("p", "a"): -2.0, ("q", "a"): 0.0, ("r", "a"): 4.0, ("p", "b"): 0.0, ("q", "b"): 0.0, ("r", "b"): -3.0}


def windows(spark, rows):
    return spark.createDataFrame(rows, "trial string, slot int, status string, outcome string, model double, control double")


def test_trial_states(spark):
    whole = [("a", i, "recorded", "matured", 0.02 + i, 0.01) for i in range(4)]
    gone = [("b", i, "recorded", "matured", 0.0, 0.0) for i in range(2)] + [("b", 2, "missed", None, None, None), ("b", 3, "recorded", "invalid_prices", None, None)]
    going = [("c", 0, "recorded", "matured", 1.0, 2.0), ("c", 1, "recorded", None, None, None)]
    got = {r.trial: r for r in wf.trial_summary(windows(spark, whole + gone + going), "trial", 4).collect()}
    assert {t: r.status for t, r in got.items()} == {"a": "ready_for_review", "b": "incomplete_evidence", "c": "collecting"}
    assert [(r.n_recorded, r.n_matured, r.n_missed, r.n_invalid, r.n_pending) for r in (got["a"], got["b"], got["c"])] == [(4, 4, 0, 0, 0), (3, 2, 1, 1, 0), (2, 1, 0, 0, 1)]
    assert got["a"].paired_excess_pct == pytest.approx(151.0) and got["c"].paired_excess_pct == -100.0
    state = lambda status, matured=4, missed=0, low=0.1, high=0.2, day=5, intact=True: (status, 4, matured, missed, 0, low, high, day, intact)
    cases = [
        (state("ready_for_review"), "relative_edge"), (state("ready_for_review", low=-0.2, high=-0.1), "baseline_better"), (state("ready_for_review", low=-0.2), "inconclusive"), (state("ready_for_review", day=1), "collecting"),
        (state("collecting", matured=3), "collecting"), (state("collecting", matured=3, day=9), "insufficient_evidence"), (state("incomplete_evidence", matured=3, missed=1), "insufficient_evidence"), (state("ready_for_review", low=None), "integrity_failure"),
        (state("ready_for_review", low=0.3), "integrity_failure"), (state("collecting", intact=False, day=1), "integrity_blocked"), (state("ready_for_review", intact=None), "integrity_failure"),
    ]
    frame = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, status string, n_scheduled int, n_matured int, n_missed int, n_invalid int, low double, high double, day int, intact boolean")
    got = wf.trial_decision(frame, F.col("day"), F.lit(3), F.lit(8), F.col("intact")).orderBy("i").collect()
    assert [r.code for r in got] == [c for _, c in cases]


def test_rules_and_series(spark):
    frame = spark.createDataFrame([(1, 1.0, "LONG"), (2, float("nan"), "UP"), (3, None, None)], "id int, v double, side string")
    rules = {"finite": ~F.isnan("v") & (F.abs("v") < 9), "side": F.col("side").isin("LONG", "SHORT")}
    assert sorted(map(tuple, wf.broken_rules(frame, rules, ["id"]).collect())) == [(2, "finite"), (2, "side"), (3, "finite"), (3, "side")]
    one, two = (spark.createDataFrame(r, "k int, v double") for r in ([(1, 0.10), (2, 0.10), (3, 0.1)], [(1, 0.11), (2, 0.20), (4, 0.1)]))
    assert {r.k: r.warns for r in wf.compared_series(one, two, "k", "v").collect()} == {1: False, 2: True, 3: False, 4: False}
    moves = [("LONG", 0.5, 0.01, False), ("LONG", 0.0105, 0.01, True), ("LONG", 0.0004, -0.0004, False), ("SHORT", 0.01, -0.0095, True), ("SHORT", 0.01, 0.01, False), ("LONG", 0.0, 0.0005, True), ("LONG", 0.01, 0.0111, False)]
    got = spark.createDataFrame(moves, "side string, ledger double, report double, agrees boolean").select(wf.consistent_sign(F.col("side"), F.col("ledger"), F.col("report")).alias("got"), "agrees").collect()
    assert all(r.got == r.agrees for r in got)


def test_reviews_need_both_times(spark):
    slots = spark.createDataFrame([(1, 10, 12), (2, 10, 12), (3, 10, 12), (4, None, 3), (None, 10, 12)], "id int, slot_at int, known_at int")
    reviews = spark.createDataFrame([(1, 5, 6, "old"), (1, 9, 11, "new"), (1, 11, 11, "after"), (2, 9, 13, "too late"), (4, 1, 1, "x"), (2, None, 1, "no time")], "id int, review_at int, recorded_at int, verdict string")
    assert {r.id: r.verdict for r in wf.latest_known(slots, reviews, "id").collect()} == {1: "new", 2: None, 3: None, 4: None, None: None}


def test_reviews_of_one_key_against_brute_force(spark):
    draw = random.Random(6)
    made = [(7, (a := draw.randint(0, 4000)), a + draw.randint(0, 900), f"v{i}") for i in range(10_000)]
    asked = [(7, (a := draw.randint(0, 4500)), a + draw.randint(-50, 600)) for _ in range(400)]
    got = wf.latest_known(spark.createDataFrame(asked, "id int, slot_at int, known_at int"), spark.createDataFrame(made, "id int, review_at int, recorded_at int, verdict string"), "id").collect()
    assert len(got) == 400
    for r in got:
        fits = [m[1:] for m in made if m[1] <= r.slot_at and m[2] <= r.known_at]
        assert r.verdict == (max(fits)[2] if fits else None)


def test_grid_clock_and_latest(spark):
    seen = spark.createDataFrame([(0, False), (1, True), (1, False), (2, True), (9, False)], "slot bigint, late boolean")
    assert {r.status: r.n for r in wf.grid_status(spark.range(4).withColumnRenamed("id", "slot"), seen, "slot").collect()} == {"on_time": 2, "late": 1, "missing": 1, "unexpected": 1}
    due, after = wf.rebalance_clock(F.col("ts"), 12, 11)
    got = spark.createDataFrame([(at(11),), (at(12.5),), (at(22.9),), (at(23.2),)], "ts timestamp_ntz").select(due.alias("due"), after.alias("next")).collect()
    assert [(r.due, r.next) for r in got] == [(True, at(23)), (False, at(23)), (False, at(23)), (True, at(35))]
    always, _ = wf.rebalance_clock(F.col("ts"), 0, 11)
    assert spark.createDataFrame([(at(3),)], "ts timestamp_ntz").select(always.alias("due")).first().due is True
    frame = spark.createDataFrame([(at(5), 1.0, 1.0)] * 5 + [(at(6), 1.0, 1.0)] * 5 + [(at(11), 1.0, 1.0)] * 4 + [(at(11), 1.0, None)], "ts timestamp_ntz, score double, ret double")
    assert {r.ts for r in wf.latest_complete(frame).collect()} == {at(6)} and {r.ts for r in wf.latest_complete(frame, 5, (5, 11)).collect()} == {at(5)}


def test_universe_by_side_and_daily_volume(spark):
    picks = spark.createDataFrame([(at(1), "long", "a"), (at(2), "long", "a"), (at(1), "short", "b"), (at(1), "long", "b"), (at(3), "short", "c")], "ts timestamp_ntz, side string, entity string")
    bars = spark.createDataFrame([(at(24 * d + h), "a", v) for d, v in enumerate((1.0, 2.0, 30.0)) for h in (1, 2)] + [(at(1), "b", 9.0)], "ts timestamp_ntz, entity string, volume double")
    got = {(r.side, r.entity): (r.appearances, r.place, r.median_volume, r.low) for r in wf.universe_audit(picks, bars, 5.0).collect()}
    assert got == {("long", "a"): (2, 1, 4.0, True), ("long", "b"): (1, 2, 9.0, False), ("short", "b"): (1, 1, 9.0, False), ("short", "c"): (1, 2, None, True)}


@pytest.mark.parametrize(("n", "portion"), [(1, 1 << 18), (7, 1 << 18), (103, 1 << 10), (5000, 1 << 12)])
def test_bootstrap_equals_numpy(spark, monkeypatch, n, portion):
    monkeypatch.setattr(sx, "PORTION", portion)
    data = np.random.default_rng(9).normal(size=n)
    draws = 2000 if n < 1000 else 40
    rng = np.random.default_rng(42)
    starts = rng.integers(0, n, size=(draws, int(np.ceil(n / 4))))
    index = ((starts[:, :, None] + np.arange(4)) % n).reshape(draws, -1)[:, :n]
    low, high = np.quantile(data[index].mean(axis=1), [0.025, 0.975])
    got = sx.block_bootstrap(spark.createDataFrame(list(enumerate(data.tolist())), "i int, v double"), "v", "i", draws=draws).first()
    assert got.n == n and np.allclose([got.mean, got.low, got.high], [data.mean(), low, high])


def test_drawn_starts_pass_rejected_words(spark, monkeypatch):
    monkeypatch.setattr(sx, "PORTION", 256)
    n = (1 << 31) + 11  # nearly half of the words are rejected
    want = np.random.default_rng(5).integers(0, n, size=2000)
    got = [r.start for r in sx.drawn_starts(spark, n, 2000, 5).orderBy("at").collect()]
    assert got == want.tolist()


def test_left_out_weights_stay_in_cash(spark):
    parts = spark.createDataFrame([("m", 1, "a", 2.0, 0.5), ("m", 1, "b", 1.0, 0.5), ("m", 2, "a", -1.0, 1.0)], "side string, ts int, entity string, part double, weight double")
    got = {(r.entity, r.cost_bps): (r.mean, r.contribution) for r in rp.left_out(parts, "side", (0, 20)).collect()}
    assert got == {(None, 0.0): (1.0, None), ("a", 0.0): (0.5, 0.5), ("b", 0.0): (0.5, 0.5), (None, 20.0): (pytest.approx(0.8), None), ("a", 20.0): (pytest.approx(0.45), pytest.approx(0.35)), ("b", 20.0): (pytest.approx(0.35), pytest.approx(0.45))}


def test_replay_finds_each_change(spark):
    names = [f"e{i:02}" for i in range(14)]
    base = [(t, n, (i * 5 % 14) / 7) for t in range(5) for i, n in enumerate(names)]
    saved = [r for r in base if not (r[0] == 1 and r[1] == "e03")]
    replay = [(t, n, s + (0.5 if (t, n) == (3, "e05") else 1e-7)) for t, n, s in base if not (t == 2 and n == "e04") and not (t == 4 and n > "e08")]
    actual = [(t, n, float(i)) for t in range(5) for i, n in enumerate(names)]
    frame = lambda rows, c: spark.createDataFrame(rows, f"ts int, entity string, {c} double")
    got = {r.ts: r for r in rp.compared_replay(frame([(t, n, round(s, 5)) for t, n, s in saved], "score"), frame(replay, "score"), frame(actual, "ret")).collect()}
    assert {t: r.status for t, r in got.items()} == {0: "same", 1: "members", 2: "members", 3: "scores", 4: "insufficient"}
    assert got[1].added == ["e03"] and got[2].removed == ["e04"] and (got[3].n_changed, got[3].largest) == (1, pytest.approx(0.5)) and got[4].n_common == 9
    assert got[0].agreement == pytest.approx(1.0) and got[4].agreement is None and got[3].saved_common_ic != got[3].replay_common_ic


def test_stability_by_fold_half_and_month(spark):
    rows = [(at(24 * 5 * i), i // 3 + 1, v) for i, v in enumerate((0.1, -0.2, 0.3, 0.5, None, 0.2, -0.1, 0.4))]
    got = {r.part: (r.n, round(r.mean_ic, 6), round(r.positive, 6)) for r in ev.stability_audit(spark.createDataFrame(rows, "ts timestamp_ntz, retrain int, ic double")).collect()}
    assert got == {
        "all": (7, round(1.2 / 7, 6), round(5 / 7, 6)), "fold:1": (3, round(0.2 / 3, 6), round(2 / 3, 6)), "fold:2": (2, 0.35, 1.0), "fold:3": (2, 0.15, 0.5), "half:first": (3, round(0.2 / 3, 6), round(2 / 3, 6)), "half:second": (4, 0.25, 0.75),
        "month:2024-01-31": (6, round(0.8 / 6, 6), round(4 / 6, 6)), "month:2024-02-29": (1, 0.4, 1.0),
    }
