"""CSV files checked one by one, upserts that keep the largest, intervals in buckets, maturing signals."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from crosspanel.functions.columns import dirty_number, dirty_time
from crosspanel.operators import books
from crosspanel.operators.chains import carried
from crosspanel.operators.panel import membership_changes
from crosspanel.sources import tables
from crosspanel.streaming import events as se

START = dt.datetime(2024, 1, 1)


def test_short_csv_files_are_skipped_whole(spark, tmp_path):
    (tmp_path / "good.csv").write_text("id,market,price\n1,a,2.5\n2,b,x\n")
    (tmp_path / "turned.csv").write_text('"price","extra","market","id"\n7,z,"c, d",3\n')
    (tmp_path / "short.csv").write_text("id,market\n9,q\n")
    (tmp_path / "broken.csv").write_bytes(b"\x00\xff\x13\n\x00,\n")
    (tmp_path / "head.csv").write_text("id,market,price\n")
    rows, report = tables.read_csv_files(spark, f"{tmp_path}/*.csv", "id bigint, market string, price double")
    assert sorted(tuple(r)[:3] for r in rows.collect()) == [(1, "a", 2.5), (2, "b", None), (3, "c, d", 7.0)]
    got = {r.file: (r.status, r.missing) for r in report.collect()}
    assert {f: s for f, (s, _) in got.items()} == {"good.csv": "read", "turned.csv": "read", "short.csv": "short", "broken.csv": "short", "head.csv": "read"}
    assert got["short.csv"][1] == ["price"] and {r.source_file for r in rows.collect()} == {"good.csv", "turned.csv"}


def test_upsert_keeps_the_largest(spark):
    old = spark.createDataFrame([(1, 5.0, "a"), (2, 1.0, "b")], "k int, high double, name string")
    new = spark.createDataFrame([(1, 4.0, "c", 1), (2, 3.0, None, 2), (3, None, "d", 3)], "k int, high double, name string, more int")
    got = sorted(map(tuple, tables.merge_largest(old, new, ["k"], ["high"]).collect()))
    assert got == [(1, 5.0, "c", 1), (2, 3.0, None, 2), (3, None, "d", 3)]


def test_overlaps_against_brute_force(spark):
    draw = random.Random(2)
    when = lambda lo=0, hi=500_000: START + dt.timedelta(seconds=draw.randint(lo, hi))
    spans = [(i, draw.choice("ab"), (a := when()), a + dt.timedelta(seconds=draw.randint(0, 20_000))) for i in range(150)]
    points = [(draw.choice("ab"), (a := when()), a + dt.timedelta(seconds=draw.choice([0, 0, 100, 30_000])), i) for i in range(300)]
    points += [("a", START, START + dt.timedelta(days=6), 900), ("a", None, None, 901)]
    got = books.overlapping(spark.createDataFrame(spans, "key int, entity string, lo timestamp_ntz, hi timestamp_ntz"), spark.createDataFrame(points, "entity string, from_at timestamp_ntz, to_at timestamp_ntz, n int"), "entity", 3600)
    want = sorted((s[0], p[3]) for s in spans for p in points if s[1] == p[0] and p[1] is not None and s[2] <= p[2] and p[1] <= s[3])
    assert sorted((r.key, r.point.n) for r in got.collect()) == want


def test_chains_carry_their_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.createDataFrame([(c, i) for c in "abc" for i in range(50)], "chain string, i int")
        step = lambda state, r: ((state or 0) + r["i"], [(r["chain"], r["i"], (state or 0) + r["i"])])
        got = {(r.chain, r.i): r.total for r in carried(rows.repartition(5), ["chain"], ["i"], step, "chain string, i int, total int").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(c, i): sum(range(i + 1)) for c in "abc" for i in range(50)}
    assert carried(rows.limit(0), [], ["i"], step, "chain string, i int, total int").count() == 0


HOURS = {"signal": 0, "entry": 1, "exit": 7}
MESSAGE = "id bigint, kind string, at timestamp, recorded_at timestamp, open double"


def messages(key: int, hour: float, late_minutes: int = 10, **prices):
    out = [(key, "signal", START + dt.timedelta(hours=hour), START + dt.timedelta(hours=hour, minutes=late_minutes), None)]
    for kind, values in prices.items():
        kind = "exit" if kind == "leave" else kind
        out += [(key, kind, (t := START + dt.timedelta(hours=hour + HOURS[kind])), t, v) for v in values]
    return out


def test_signals_mature_across_a_restart(spark, tmp_path):
    first = messages(1, 0, entry=[10.0], leave=[11.0]) + messages(2, 0, late_minutes=46, entry=[1.0], leave=[1.0]) + messages(3, 1, entry=[5.0]) + messages(4, 2, entry=[5.0], leave=[6.0, 6.0]) + messages(5, 3, leave=[-1.0], entry=[2.0])
    second = [m for m in messages(6, 20, entry=[4.0], leave=[5.0])] + [(3, "exit", START + dt.timedelta(hours=8), START + dt.timedelta(hours=21), 4.0)]  # told late, but before its deadline
    third = messages(7, 90, entry=[1.0], leave=[2.0])
    source, checkpoint, out = f"{tmp_path}/in", f"{tmp_path}/state", f"{tmp_path}/out"
    schema = spark.createDataFrame([], MESSAGE).schema
    for part in (first, second, third):  # each start goes on from the checkpoint of the one before
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        se.maturation(stream, "1 hour").writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    got = sorted((r.id, r.status, r.ret and round(r.ret, 6)) for r in spark.read.parquet(out).collect())
    recorded = [(i, "recorded", None) for i in (1, 3, 4, 5, 6, 7)]
    assert got == sorted([*recorded, (1, "matured", 0.1), (2, "late", None), (3, "matured", -0.2), (4, "invalid", None), (5, "invalid", None), (6, "matured", 0.25)], key=lambda r: (r[0], r[1]))


def test_signals_of_a_group_do_not_mix(spark, tmp_path):
    """Every kind of signal many times over, dealt into few groups and into many, over four starts."""
    kinds = [
        (dict(entry=[10.0], leave=[11.0]), ["matured", "recorded"]), (dict(late_minutes=46, entry=[1.0], leave=[1.0]), ["late"]), (dict(entry=[5.0]), ["expired", "recorded"]),
        (dict(entry=[5.0], leave=[6.0, 6.0]), ["invalid", "recorded"]), (dict(entry=[0.0], leave=[2.0]), ["invalid", "recorded"]), (dict(entry=[float("nan")], leave=[2.0]), ["invalid", "recorded"]), ({}, ["expired", "recorded"]),
    ]
    keys = [*range(-35, 35), None]
    parts = [[m for k in keys if (k or 0) % 2 == odd for m in messages(k, (k or 0) % 5 + 20 * odd, **kinds[(k or 0) % 7][0])] for odd in (0, 1)]
    parts += [messages(100, 150), [(k, "exit", START, START + dt.timedelta(hours=151), 1.0) for k in range(-35, 35)]]  # prices after the end change nothing
    schema = spark.createDataFrame([], MESSAGE).schema
    for groups in (2, 1024):
        source, checkpoint, out = (f"{tmp_path}/{groups}/{x}" for x in ("in", "state", "out"))
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
            run = se.maturation(spark.readStream.schema(schema).parquet(source), "1 hour", groups=groups).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", out).start()
            run.awaitTermination()
            assert all(p["stateOperators"][0]["numRowsTotal"] <= groups + 1 for p in run.recentProgress)
        got = spark.read.parquet(out).collect()
        for k in keys:
            assert sorted(r.status for r in got if r.id == k) == kinds[(k or 0) % 7][1], (groups, k)
        assert {round(r.ret, 6) for r in got if r.status == "matured"} == {0.1}
        assert [r.ret for r in got if r.status != "matured" and r.ret is not None] == []


def test_a_replay_of_many_files_loses_nothing(spark, tmp_path):
    """The files are in no order of time; taken four at a time, the later ones would be behind the watermark."""
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(16).write.parquet(f"{tmp_path}/events.parquet")
    replay = __spark_entry__.queries()["stream_maturation"]
    whole, parts = ({tuple(r) for r in replay(spark, d).collect()} for d in (sf, str(tmp_path)))
    assert dict((status, n) for status, n, _ in parts)["recorded"] == events.where("event_id % 60 <= 45").count()
    assert parts == whole


def test_spelled_times_and_numbers(spark):
    good = {
        "2024-03-01T10:20:30Z": (10, 20, 30, 0), "2024-03-01 10:20:30": (10, 20, 30, 0), " 2024-03-01T10:20 ": (10, 20, 0, 0), "2024-03-01 10:20:30.5": (10, 20, 30, 500_000), "2024-03-01T10:20:30.123456789Z": (10, 20, 30, 123_456), "2024-03-01T19:20:30+09:00": (10, 20, 30, 0),
        "2024-03-01 05:20:30 -0500": (10, 20, 30, 0), "2024-03-01": (0, 0, 0, 0), "2024/03/01 10:20:30": (10, 20, 30, 0), "20240301T102030": (10, 20, 30, 0), "20240301": (0, 0, 0, 0),
    }
    bad = ["", "2024-02-30", "2024-13-01", "soon", "10:20", "2024-03-01 25:00:00", None, "2024-03-01T10:20:30Zx"]
    numbers = {"1.5": 1.5, " -2 ": -2.0, "1e3": 1000.0, "NaN": None, "inf": None, "1,000": None, "": None, "x": None, None: None}
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "Asia/Seoul"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            got = {r.t: r.at for r in spark.createDataFrame([(t,) for t in [*good, *bad]], "t string").select("t", dirty_time(F.col("t")).alias("at")).collect()}
            for t, (h, m, s, u) in good.items():
                assert got[t] == dt.datetime(2024, 3, 1, h, m, s, u), t
            assert all(got[t] is None for t in bad)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert {r.t: r.v for r in spark.createDataFrame([(t,) for t in numbers], "t string").select("t", dirty_number(F.col("t")).alias("v")).collect()} == numbers


def test_membership_changes(spark):
    rows = [(1, "a"), (1, "b"), (2, "b"), (2, "c"), (2, "d"), (4, "b"), (4, "b")]
    got = {r.ts: (r.added, r.removed, r.n_common) for r in membership_changes(spark.createDataFrame(rows, "ts int, entity string")).collect()}
    assert got == {1: (["a", "b"], [], 0), 2: (["c", "d"], ["a"], 1), 4: ([], ["c", "d"], 1)}
