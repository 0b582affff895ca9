"""Streaming forms: windows under watermarks, sessions, deduplication, late rows, maturation."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, path: str, schema: str = EVENT, files_per_trigger: int | None = 4) -> DataFrame:
    """A stream over parquet files as they appear, with event time for watermarks. ``files_per_trigger``
    None takes all there are at once: files that are not in the order of time would else be late."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
    return reader.parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    g = events.withWatermark("at", late).groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    g = events.withWatermark("at", late).groupBy(F.window("at", size, slide)).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    g = events.withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def split_late(events: DataFrame, recorded: str, minutes: int) -> DataFrame:
    """Rows with a flag: recorded after the deadline. Both kinds stay, so that late ones can be
    written apart."""
    return events.withColumn("late", F.col(recorded) > F.col("at") + F.make_interval(mins=F.lit(minutes)))


def run_once(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run over all there is and return what was written: a Parquet table of its own beside the
    checkpoint, which the executors write and read. In append mode the sink's log tells which files
    count; in complete mode each batch writes the whole result anew."""
    spark = stream.sparkSession
    path = f"{checkpoint.rstrip('/')}-{table}-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(path)  # there may be no batch at all
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def append_matured(batch: DataFrame, ledger_path: str, keys: list[str]) -> None:
    """For foreachBatch: append the rows whose keys the ledger lacks; a batch that runs again adds
    nothing."""
    spark = batch.sparkSession
    try:
        ledger = spark.read.parquet(ledger_path)
    except Exception as e:  # the first batch finds no ledger
        if "PATH_NOT_FOUND" not in str(e):
            raise
        ledger = batch.limit(0)
    batch.join(ledger.select(*keys), keys, "left_anti").dropDuplicates(keys).write.mode("append").parquet(ledger_path)


HOUR_MS = 3_600_000
#: Groups of ids that share a row of state and a call: one call for each id would take milliseconds an id.
GROUPS = 1024
#: What stands in a state for a signal that did not come yet, and for one that ended as late.
_NONE, _ENDED = -(1 << 62), 1 - (1 << 62)
_KINDS = ("signal", "entry", "exit")
_STATUS = ("recorded", "late", "matured", "invalid", "expired")
_STATE = "id array<bigint>, signal_ms array<bigint>, entry array<double>, exit array<double>, entries array<bigint>, exits array<bigint>, timer_ms array<bigint>"
_TYPES = ("i8", "i8", "f8", "f8", "i8", "i8", "i8")
_MESSAGE = ("id", "kind", "open", "at_ms", "recorded_ms")
_OUTCOME = "id bigint, status tinyint, ret double"


def maturation(messages: DataFrame, late: str = "2 hours", grace_minutes: int = 45, exit_hours: int = 7, deadline_hours: int = 55, groups: int = GROUPS) -> DataFrame:
    """Outcomes of signals as time passes: rows (id, status, ret) in append mode.

    ``messages``: id, kind (signal, entry, exit), at (what it tells of), recorded_at (when it was told;
    time passes by it), open. A signal that was
    recorded more than ``grace_minutes`` after its time is ``late`` and ends there; another is ``recorded``
    once, and its state waits. An hour after the exit, by the watermark, it is ``matured`` with its return
    if it has exactly one usable price at either end; else it may still mature until its deadline, when it
    is ``invalid`` (prices that repeat or are no positive numbers) or ``expired`` (prices missing). Prices
    that no signal comes for go at their deadline; a signal without a time counts as none.

    Ids are dealt by hash into ``groups``, whose messages are worked on together as arrays. A group's state
    holds a place of fixed width, with a timer of its own, for each of its open signals; the group is woken
    at the first of them. Timers are on the time of recording, so that a restart from the checkpoint goes on
    where it was; ``groups`` must stay the same over a checkpoint.
    """
    grace, ripe, deadline = grace_minutes * 60_000, (exit_hours + 1) * HOUR_MS, deadline_hours * HOUR_MS

    def step(key, batches, state):  # noqa: ANN001, ANN202
        now = state.getCurrentWatermarkMs()
        held = [np.asarray(x, dtype=t) for x, t in zip(state.get if state.exists else [[]] * len(_TYPES), _TYPES, strict=True)]
        got = [] if state.hasTimedOut else [[b[c].to_numpy() for c in _MESSAGE] for b in batches]
        mid, kind, price, at, told = (np.concatenate(x) for x in zip(*got, strict=True)) if got else [np.empty(0)] * 5
        n_held = len(held[0])
        ids, where = np.unique(np.concatenate([held[0], mid.astype("i8")]), return_inverse=True)
        was, of = where[:n_held], where[n_held:]
        empty = (0, _NONE, np.nan, np.nan, 0, 0, 0)
        _, signal, entry, leave, entries, exits, timer = rows = [np.full(len(ids), e, dtype=t) for e, t in zip(empty, _TYPES, strict=True)]
        for row, old in zip(rows, held, strict=True):
            row[was] = old
        rows[0] = ids

        out: list[tuple[np.ndarray, str]] = []
        signals = np.flatnonzero((kind == 0) & ~np.isnan(at))
        came, first = np.unique(of[signals], return_index=True)  # of several signals the first counts
        new = signal[came] == _NONE
        came, first = came[new], signals[first[new]]
        overdue = told[first] > at[first] + grace
        signal[came] = np.where(overdue, _ENDED, at[first].astype("i8"))
        out += [(came[overdue], "late"), (came[~overdue], "recorded")]
        for code, last, count in ((1, entry, entries), (2, leave, exits)):
            last[of[kind == code]] = price[kind == code]  # of several prices the last stays
            count += np.bincount(of[kind == code], minlength=len(ids))

        touched = np.zeros(len(ids), dtype=bool)
        touched[of] = True
        newest = np.full(len(ids), _NONE)
        np.maximum.at(newest, of[~np.isnan(at)], at[~np.isnan(at)].astype("i8"))
        waits = signal <= _ENDED  # kept for a while, so that what follows finds that it ended
        timer = np.where(touched, np.where(waits, np.maximum(now + 1, newest + deadline), signal + ripe), timer)
        over = np.where(touched, ~waits & (now >= timer), timer < now)
        settled = over & ~waits
        with np.errstate(invalid="ignore"):
            usable = (entry > 0) & (entry < np.inf) & (leave > 0) & (leave < np.inf)
        matured = settled & (entries == 1) & (exits == 1) & usable
        due = settled & ~matured & (now >= signal + deadline)
        out += [(np.flatnonzero(matured), "matured"), (np.flatnonzero(due & (entries > 0) & (exits > 0)), "invalid"), (np.flatnonzero(due & ((entries == 0) | (exits == 0))), "expired")]
        rows[6] = np.where(settled, signal + deadline, timer)
        stay = ~(matured | due | (over & waits))
        if stay.any():
            state.update(tuple(row[stay].tolist() for row in rows))
            state.setTimeoutTimestamp(int(max(rows[6][stay].min(), now, 1)))
        elif state.exists:
            state.remove()
        at_rows = np.concatenate([x for x, _ in out])
        if len(at_rows):
            with np.errstate(over="ignore"):
                ret = [(leave[x] / entry[x] - 1) if status == "matured" else np.full(len(x), np.nan) for x, status in out]
            code = np.concatenate([np.full(len(x), _STATUS.index(status), dtype="i1") for x, status in out])
            shown = ids[at_rows] if key[0] >= 0 else [None] * len(at_rows)
            yield pd.DataFrame({"id": shown, "status": code, "ret": np.concatenate(ret)})

    kind = F.coalesce(F.array_position(F.array(*map(F.lit, _KINDS)), F.col("kind")) - 1, F.lit(-1)).cast("tinyint")
    ms = lambda c: F.unix_millis(c).cast("double")  # noqa: E731  # exact, and NaN where it is null
    group = F.when(F.col("id").isNull(), -1).otherwise(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))  # rows without an id are one signal
    columns = [F.coalesce("id", F.lit(0)).alias("id"), kind.alias("kind"), F.col("open").cast("double").alias("open"), ms("at").alias("at_ms"), ms("recorded_at").alias("recorded_ms")]
    marked = messages.withWatermark("recorded_at", late).select(group.alias("group"), "recorded_at", *columns)
    done = marked.groupBy("group").applyInPandasWithState(step, _OUTCOME, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return done.select("id", F.get(F.array(*map(F.lit, _STATUS)), F.col("status")).alias("status"), "ret")
