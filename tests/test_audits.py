"""Roll-ups against hand-made lives of forecasts."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crosspanel.operators import audits as au


def at(hours: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def lives(spark, errors=(), now=100.0):
    make = spark.createDataFrame
    slots = make([(at(h),) for h in (0, 6, 12, 18, 90, 99.5)], "slot timestamp_ntz")
    signals = make([(at(0), "recorded", 12), (at(6), "missed", 0), (at(12), "recorded", 11), (at(90), "recorded", 13)], "slot timestamp_ntz, status string, n_names int")
    outcomes = make([(at(0), "evaluated", None, 0.2), (at(12), "invalid", "missing_prices", None)], "slot timestamp_ntz, status string, reason string, saved_ic double")
    comparisons = make([(at(0), 0.15, False)], "slot timestamp_ntz, legacy_ic double, measured boolean")
    deliveries = make([(at(0), False), (at(0), True), (at(6), True), (at(12), False)], "slot timestamp_ntz, complete boolean")
    faults = make([(None if h is None else at(h), s) for h, s in errors], "slot timestamp_ntz, stage string")
    return au.audit_windows(slots, signals, outcomes, comparisons, deliveries, faults, F.expr(f"TIMESTAMP_NTZ '{at(now)}'"))


def test_windows_and_summary(spark):
    w = {(r.slot - at(0)).total_seconds() / 3600: r for r in lives(spark, [(18, "signal"), (12, "measurement")]).collect()}
    assert {h: r.status for h, r in w.items()} == {0: "evaluated", 6: "missed", 12: "invalid", 18: "source_error", 90: "recorded", 99.5: "awaiting_signal"}
    assert {h: r.legacy_status for h, r in w.items()} == {0: "available", 6: "missing", 12: "missing", 18: "missing", 90: "waiting", 99.5: "waiting"}
    assert (w[0].measurement_status, w[12].measurement_status, w[12].comparison_status, w[0].comparison_status) == ("missing", "error", "error", "available")
    assert {h: r.delivery for h, r in w.items()} == {0: "verified", 6: "verified", 12: "unverified", 18: "unverified", 90: "unverified", 99.5: "waiting"}
    assert w[0].warns and w[0].difference == pytest.approx(0.05) and not w[12].warns
    s = au.audit_summary(lives(spark, [(18, "signal")])).first()
    assert (s.scheduled, s.recorded, s.evaluated, s.missed, s.invalid, s.pending, s.compared, s.differences, s.source_errors, s.legacy_missing) == (6, 3, 1, 1, 1, 3, 1, 1, 1, 0)
    assert s.issues == ["latest_delivery_unverified", "latest_outcome_invalid", "input_errors_active"] and s.status == "attention"
    assert au.audit_summary(lives(spark, [(None, "history")])).first().comparison_errors == 1  # a fault without a slot is everywhere
    none = au.audit_summary(lives(spark).limit(0)).first()
    assert (none.scheduled, none.issues, none.status, none.mean_saved_ic) == (0, [], "monitoring", None)


def quotes(spark, rows):
    return spark.createDataFrame(rows, "slot int, phase string, entity string, bid double, ask double, bid_size double, ask_size double, age int")


def test_quotes_need_one_sound_row_each(spark):
    intents = spark.createDataFrame([(s, e) for s in range(7) for e in "ab"], "slot int, entity string")
    sound = lambda s, p, e, bid=9.0, ask=10.0, size=1.0, age=0: (s, p, e, bid, ask, size, size, age)
    rows = [sound(0, p, e) for p in ("entry", "exit") for e in "ab"]
    rows += [sound(1, "entry", "a"), sound(1, "entry", "b", bid=11.0), sound(2, "entry", "a"), sound(2, "entry", "b", age=61), sound(3, "entry", "a"), sound(3, "entry", "a"), sound(3, "entry", "b")]
    rows += [sound(4, "entry", "a"), sound(5, "entry", "a", ask=float("nan")), sound(5, "entry", "b", size=0.0), sound(6, "entry", "a", bid=10.0), sound(6, "entry", "b", age=-5)]
    got = {(r.slot, r.phase): (r.status, r.n_errors) for r in au.quote_status(intents, quotes(spark, rows)).collect()}
    assert {s: got[s, "entry"] for s in range(7)} == {0: ("observed", 0), 1: ("invalid", 1), 2: ("invalid", 1), 3: ("invalid", 1), 4: ("invalid", 1), 5: ("invalid", 2), 6: ("observed", 0)}
    assert got[0, "exit"] == ("observed", 0) and got[1, "exit"][0] == "waiting"


def test_venue_windows_and_summary(spark):
    names = "abcde"
    intents = spark.createDataFrame([(s, e, float(i), 0.01 * i, e in "ab", e in "bc") for s in (1, 2) for i, e in enumerate(names)], "slot int, entity string, score double, raw double, model boolean, selected boolean")
    rows = [(1, "entry", e, 99.0, 101.0, 1.0, 1.0, 0) for e in names] + [(1, "exit", e, 99.0 + i, 101.0 + i, 1.0, 1.0, 0) for i, e in enumerate(names)] + [(2, "entry", "a", -1.0, 1.0, 1.0, 1.0, 0)]
    got = {r.slot: r for r in au.venue_windows(intents, quotes(spark, rows), 10.0, 5).collect()}
    r = got[1]
    assert (r.status, r.n_names, r.venue_ic, r.same_pool_ic) == ("evaluated", 5, pytest.approx(1.0), pytest.approx(1.0)) and got[2].status == "invalid" and got[2].venue_ic is None
    short = lambda i: 100 * (1 - (101.0 + i) / 99.0 - 0.001)
    assert r.model_short_pct == pytest.approx((short(0) + short(1)) / 2) and r.selected_minus_model_pp == pytest.approx(short(2) / 2 - short(0) / 2) and r.mid_gap_pp == pytest.approx(0.0)
    s = au.venue_summary(au.venue_windows(intents, quotes(spark, rows), 10.0, 5)).first()
    assert (s.recorded, s.evaluated, s.invalid, s.observing, s.status) == (2, 1, 1, 0, "attention")


def test_funding_of_whole_baskets_only(spark):
    windows = spark.createDataFrame([(s, e, e in "ab", e in "bc") for s in (1, 2) for e in "abc"], "slot int, entity string, model boolean, selected boolean")
    funding = spark.createDataFrame([(1, "a", "observed", 1.0), (1, "b", "observed", 3.0), (1, "c", "gap", 9.0)], "slot int, entity string, status string, rate_sum_bps double")
    got = {r.slot: tuple(r)[1:] for r in au.execution_summary(windows, funding, 2).collect()}
    assert got == {1: (2.0, None, 3, 1), 2: (None, None, 0, 0)}


def test_witness_contract(spark):
    good = dict(schema=1, horizon=6, signal_at=at(0), recorded_at=at(0.5), timely=True, digest="a" * 64)
    cases = {
        1: ({}, {}), 2: ({"horizon": 12}, {}), 3: ({"recorded_at": at(-1)}, {}), 4: ({"recorded_at": at(30)}, {}), 5: ({"digest": "A" * 64}, {}), 6: ({}, {"n": 9}), 7: ({}, {"name": "e0"}), 8: ({}, {"score": None}),
        9: ({}, {"inputs": {"x": 1.0}}), 10: ({}, {"inputs": {"x": float("inf"), "y": None}}), 11: ({}, {"actual": 0.1}), 12: ({"recorded_at": at(1)}, {}), 13: ({"timely": None}, {}),
    }
    witnesses = spark.createDataFrame([(i, *{**good, **w}.values()) for i, (w, _) in cases.items()], "id int, schema int, horizon int, signal_at timestamp_ntz, recorded_at timestamp_ntz, timely boolean, digest string")
    rows = []
    for i, (_, m) in cases.items():
        for k in range(m.get("n", 10)):
            odd = k == 3
            rows.append((i, m["name"] if odd and "name" in m else f"e{k}", m["score"] if odd and "score" in m else float(k), m["inputs"] if odd and "inputs" in m else {"x": 1.0, "y": None}, m.get("actual") if odd else None))
    members = spark.createDataFrame(rows, "id int, entity string, score double, inputs map<string,double>, actual double")
    got: dict[int, list[str]] = {}
    for r in au.witness_faults(witnesses, members, ["y", "x"], F.expr(f"TIMESTAMP_NTZ '{at(24)}'")).collect():
        got.setdefault(r.id, []).append(r.fault)
    assert got == {2: ["contract"], 3: ["contract"], 4: ["contract", "timely"], 5: ["digest"], 6: ["size"], 7: ["repeated"], 8: ["score"], 9: ["features"], 10: ["input"], 11: ["outcome"], 12: ["timely"], 13: ["timely"]}
