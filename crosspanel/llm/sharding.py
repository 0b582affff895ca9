"""Balanced sharding of linked documents.

Documents with equal texts are linked. Every document starts in a shard drawn from its id and text; then, in
rounds of joins, linked documents ask for the shard that holds most of their neighbours. A shard
admits no more than its quota of movers, as a share of those who ask; groups that fit whole go ahead
of larger ones. A last exact step moves the rows beyond a quota into the free places. Counts of
shards differ by one row at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.llm.common import written

#: Rows of a link that meet their link's label in one task.
PER_TASK = 1000
#: Runs of slots that are numbered on their own before their offsets are summed.
RUNS = 256


def _pick(values: list[float], at: Column) -> Column:
    """The value of a short driver-side list at a column's number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int") + 1)


def _counts(df: DataFrame, column: str, shards: int) -> list[int]:
    found = {r[column]: r["n"] for r in df.groupBy(column).agg(F.count("*").alias("n")).collect()}
    return [found.get(i, 0) for i in range(shards)]


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard: the first ``rows % shards`` take one more."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def _shares(flow: dict[tuple[int, int], int], free: list[int], shards: int) -> list[float]:
    """For each shard, the share of those who ask for it that there is room for: what is free and
    what those leave who are admitted elsewhere."""
    into = [sum(n for (_, b), n in flow.items() if b == s) for s in range(shards)]
    share = [1.0 if into[s] else 0.0 for s in range(shards)]
    for _ in range(50):
        room = [free[s] + sum(n * share[b] for (a, b), n in flow.items() if a == s) for s in range(shards)]
        share = [min(share[s], max(0.0, room[s]) / into[s]) if into[s] else 0.0 for s in range(shards)]
    return share


def _flow(df: DataFrame, a: str, b: str) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """Rows whose shards ``a`` and ``b`` differ, by both: of links that fit whole and of others."""
    found = df.where(F.col(a) != F.col(b)).groupBy("fits", F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n")).collect()
    whole, part = ({(r.a, r.b): r.n for r in found if r.fits == fits} for fits in (True, False))
    return whole, part


def propagate(linked: DataFrame, free: list[int], shards: int, rounds: int) -> DataFrame:
    """Label propagation of ``linked`` (row, draw, link, members, label) under ``free`` places for each
    shard beyond its linked rows. Each round: counts per link and label, the fullest label of each
    link, proposals, and admission of the share of proposals for which there is room.

    Links whose other rows all fit into a shard's free places are admitted whole, and ahead of
    larger ones, which share what is left row by row. A link that is refused tries its next label
    in the next round."""
    linked = linked.withColumn("tried", F.lit(None).cast("int"))
    for turn in range(rounds):
        counts = linked.groupBy("link", "label").agg(F.count("*").alias("n"), F.max("members").alias("members"), F.max("tried").alias("tried"))
        counts = counts.withColumn("fits", F.col("members") - F.col("n") <= _pick(free, F.col("label")))
        fresh = ~F.col("fits") | F.col("tried").isNull() | (F.col("tried") != F.col("label"))
        best = counts.groupBy("link").agg(F.max("members").alias("members"), F.max(F.struct("fits", fresh.alias("fresh"), "n", F.pmod(F.xxhash64("link", "label"), F.lit(1 << 20)).alias("draw"), "label")).alias("best"))
        salts = F.ceil(F.col("members") / PER_TASK)  # a link that very many rows share is joined in parts
        best = best.select("link", F.col("best.label").alias("wish"), F.col("best.fits").alias("fits"), F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"))
        asked = linked.withColumn("salt", F.pmod("row", salts)).join(best, ["link", "salt"]).drop("salt")
        whole, part = _flow(asked, "label", "wish")
        if not whole and not part:
            break
        share = _shares(whole, free, shards)
        left = list(free)
        for (a, b), n in whole.items():
            left[a] += int(n * share[b])
            left[b] -= math.ceil(n * share[b])
        rest = _shares(part, left, shards)
        draw = F.pmod(F.when(F.col("fits"), F.xxhash64("link", F.lit(f"admit {turn}"))).otherwise(F.xxhash64("draw", F.lit(f"admit {turn}"))), F.lit(1 << 30)) / float(1 << 30)
        admitted = draw < F.when(F.col("fits"), _pick(share, F.col("wish"))).otherwise(_pick(rest, F.col("wish")))
        label = F.when(admitted, F.col("wish")).otherwise(F.col("label"))
        tried = F.when(F.col("fits") & ~admitted, F.col("wish"))
        moved = written(asked.select("row", "draw", "link", "members", label.alias("label"), tried.alias("tried"), F.col("label").alias("was"), "fits"), "labels")
        joined, spread = _flow(moved, "was", "label")
        for out in (joined, spread):
            for (a, b), n in out.items():
                free[a] += n
                free[b] -= n
        linked = moved.drop("was", "fits")
        if sum(joined.values()) == sum(whole.values()) and sum(spread.values()) * 1000 <= sum(part.values()):
            break
    return linked


def balanced_shards(docs: DataFrame, shards: int = 16, rounds: int = 4, slack: float = 0.25) -> DataFrame:
    """Put every row of ``docs`` into a shard: law ``rows``, counts at most one apart.

    Returns doc_id, size (UTF-8 bytes of the text plus one), text_crc32, law, shard, slot (gapless
    from 0 in each shard) and grown_shard (null under this law). Null texts have size 1 and the
    checksum of no bytes, and are linked with each other and with empty texts; repeated rows each
    get a place; an empty table gives none; other columns are not read. ``slack``: share of a
    quota that shards may run over during the rounds; the last step sets it right. The result depends
    on the rows alone, not on the files or partitions that they come in. Texts of any length count
    with all their bytes; ties between shards go by a hash of doc_id and text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("link"), F.monotonically_increasing_id().alias("row")).withColumn("draw", F.xxhash64("doc_id", "link")),
        "rows",
    )  # the row number only tells rows apart: all choices are drawn from doc_id and text
    n = rows.count()
    target = quotas(n, shards)
    start = F.pmod(F.xxhash64("draw", F.lit("start")), F.lit(shards)).cast("int")
    several = written(rows.groupBy("link").agg(F.count("*").alias("members")).where("members > 1"), "links")
    linked = written(rows.select("row", "draw", "link", start.alias("label")).join(several, "link"), "linked")
    begun = _counts(rows.select(start.alias("label")), "label", shards)
    labels = propagate(linked, [int(t * (1 + slack)) + 1 - b for t, b in zip(target, begun, strict=True)], shards, rounds)
    placed = rows.drop("link").join(labels.select("row", "label", "members"), "row", "left")
    rank = F.when(F.col("label").isNull(), 2).when(F.col("members") > n // shards, 1).otherwise(0)
    placed = placed.select("doc_id", "size", "text_crc32", "row", "draw", F.coalesce("label", start).alias("label"), rank.alias("kind"))
    # slots are numbered in short runs; linked rows come first, so that rows beyond a quota are single
    # ones, or else rows of groups that no shard holds whole
    run = (F.pmod(F.xxhash64("draw", F.lit("run")), F.lit(RUNS)) + F.col("kind") * RUNS).cast("int")
    placed = written(placed.withColumn("run", run), "placed")
    per_run = placed.groupBy("label", "run").agg(F.count("*").alias("n"))
    before = per_run.select("label", "run", (F.sum("n").over(Window.partitionBy("label").orderBy("run")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("label", "run").orderBy("draw", "doc_id", "size", "text_crc32")) - 1
    ranked = placed.withColumn("local", local).join(F.broadcast(before), ["label", "run"]).withColumn("rank", F.col("before") + F.col("local"))
    have = _counts(placed, "label", shards)
    over = [max(0, h - t) for h, t in zip(have, target, strict=True)]
    room = [max(0, t - h) for h, t in zip(have, target, strict=True)]
    over_before = [sum(over[:i]) for i in range(shards)]
    room_before = [sum(room[:i]) for i in range(shards)]
    stays = F.col("rank") < _pick(target, F.col("label"))
    nth = F.col("rank") - _pick(target, F.col("label")) + _pick(over_before, F.col("label"))
    new = F.lit(shards - 1)
    for s in reversed(range(shards)):
        new = F.when((nth >= room_before[s]) & (nth < room_before[s] + room[s]), F.lit(s)).otherwise(new)
    free_slot = [min(h, t) for h, t in zip(have, target, strict=True)]
    ranked = ranked.withColumn("shard", F.when(stays, F.col("label")).otherwise(new).cast("int"))
    slot = F.when(stays, F.col("rank")).otherwise(_pick(free_slot, F.col("shard")) + nth - _pick(room_before, F.col("shard")))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
