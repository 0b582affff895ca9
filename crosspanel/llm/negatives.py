"""Hard negatives by a pivot table.

One more component makes all candidates equally long, so that a larger inner product with an anchor
is a smaller Euclidean distance. Distances to a few pivots are stored with every candidate; by the
triangle inequality they bracket its distance from an anchor, and so its score. Candidates lie in
blocks ordered by label and nearest pivot; a block is sent only anchors whose scores it may hold,
and within it only candidates whose brackets reach the wanted scores are checked exactly, in whole
numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.llm.common import written

#: Candidates of a block and anchors of a line, the work of one task, and the bytes they may take.
ROW_BLOCK, ANCHOR_LINE, BLOCK_BYTES = 32_768, 8192, 32 << 20
#: Blocks whose distances are summed up on the driver; more blocks are summed up in groups.
SUMMARIES = 1 << 16
#: Pivots, picked from so many rows, those with the smallest hashes.
PIVOTS, PIVOT_SAMPLE = 16, 512
#: Anchors and candidates bracketed at a time.
ANCHORS, ROWS = 256, 4096
#: What rounding may take from a distance, as a share of the lengths involved.
SLACK = 1e-7
_LARGE = 1 << 62


def lengthened(y: np.ndarray, squared: float) -> np.ndarray:
    """Candidates with a last component that gives all of them the squared length ``squared``."""
    y = y.astype(np.float64)
    return np.column_stack([y, np.sqrt(np.maximum(0, squared - (y * y).sum(axis=1)))])


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.column_stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in pivots]) if len(pivots) else np.zeros((len(points), 0))


def farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the points, each as far as can be from those before it."""
    picked = [0]
    near = ((points - points[0]) ** 2).sum(axis=1)
    while len(picked) < min(count, len(points)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[picked[-1]]) ** 2).sum(axis=1))
    return points[picked]


def bracket(to_pivots: np.ndarray, nearest: np.ndarray, farthest: np.ndarray, length: np.ndarray, squared: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of each anchor with candidates whose distances to the pivots lie from
    ``nearest`` to ``farthest``: arrays of anchors by candidates."""
    low = np.zeros((len(to_pivots), len(nearest)))
    high = np.full(low.shape, np.inf)
    for p in range(to_pivots.shape[1]):
        d = to_pivots[:, p, None]
        np.maximum(low, d - farthest[None, :, p], out=low)
        np.maximum(low, nearest[None, :, p] - d, out=low)
        np.minimum(high, d + farthest[None, :, p], out=high)
    slack = SLACK * (length + math.sqrt(squared) + 1)[:, None]
    both = (length**2)[:, None] + squared
    return (both - (high + slack) ** 2) / 2, (both - np.maximum(0, low - slack) ** 2) / 2


def exact(a: np.ndarray, b: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers of the ``wanted`` pairs, row by row."""
    size = (int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if wanted.mean() > 0.1 and a.shape[1] * size[0] * size[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T)[wanted].astype(np.int64)
    at, of = np.nonzero(wanted)
    out = np.empty(len(at), dtype=np.int64)
    for s in range(0, len(at), 1 << 16):
        part = slice(s, s + (1 << 16))
        out[part] = np.einsum("ij,ij->i", a[at[part]].astype(np.int64), b[of[part]].astype(np.int64))
    return out


class Best:
    """The k best candidates of each anchor and slot: higher scores first, then smaller ids."""

    def __init__(self, anchors: int, slots: int, k: int) -> None:
        self.score = np.full((anchors, slots, k), -_LARGE, dtype=np.int64)
        self.id = np.full((anchors, slots, k), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, slot: int, score: np.ndarray, ids: np.ndarray) -> None:
        worst, last = self.score[at, slot, -1], self.id[at, slot, -1]
        good = (score > worst) | ((score == worst) & (ids < last))
        at, score, ids = at[good], score[good], ids[good]
        if not len(at):
            return
        touched, k = np.unique(at), self.score.shape[2]
        all_at = np.concatenate([at, np.repeat(touched, k)])
        all_score = np.concatenate([score, self.score[touched, slot].ravel()])
        all_id = np.concatenate([ids, self.id[touched, slot].ravel()])
        order = np.lexsort((all_id, -all_score, all_at))
        pick = order[np.searchsorted(all_at[order], touched)[:, None] + np.arange(k)]
        self.score[touched, slot], self.id[touched, slot] = all_score[pick], all_id[pick]


def search_block(rows: dict, asked: dict, low: np.ndarray, high: np.ndarray, same: bool, k: int, squared: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of a block for each anchor and slot, of those with the anchor's label (``same``)
    or another one, and with a score from ``low`` to ``high`` (anchors by slots): anchor, slot, id, score."""
    best = Best(len(asked["id"]), low.shape[1], k)
    length = np.sqrt((asked["y"].astype(np.float64) ** 2).sum(axis=1))
    open_slots = low <= high
    for top in range(0, len(length), ANCHORS):
        line = slice(top, top + ANCHORS)
        ceiling = np.where(open_slots[line], high[line], -_LARGE).max(axis=1, initial=-_LARGE)
        for begin in range(0, len(rows["id"]), ROWS):
            part = slice(begin, begin + ROWS)
            fits = (asked["label"][line, None] == rows["label"][None, part]) == same
            fits &= asked["id"][line, None] != rows["id"][None, part]
            if not fits.any():
                continue
            least, most = bracket(asked["d"][line], rows["d"][part], rows["d"][part], length[line], squared)
            floor = np.where(open_slots[line], np.maximum(low[line], best.score[line, :, -1]), _LARGE).min(axis=1, initial=_LARGE)
            fits &= (most >= floor[:, None]) & (least <= ceiling[:, None])
            at, of = np.nonzero(fits)
            if not len(at):
                continue
            score = exact(asked["y"][line], rows["y"][part], fits)
            for slot in range(low.shape[1]):
                inside = (score >= low[line][at, slot]) & (score <= high[line][at, slot])
                best.add(at[inside] + top, slot, score[inside], rows["id"][part][of[inside]])
    found = best.score > -_LARGE
    at, slot, _ = np.nonzero(found)
    return at, slot, best.id[found], best.score[found]


def _matrix(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def quantised(df: DataFrame, id_column: str, column: str, label: str, scale: int) -> DataFrame:
    """id, label and whole-numbered components of the rows that can take part."""
    v = F.col(f"`{column}`").cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(f"`{id_column}`").isNotNull() & F.col(f"`{label}`").isNotNull() & v.isNotNull() & ~odd & (F.size(v) > 0))
    # F.floor ends at the bounds of bigint, which are out of range below
    return rows.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.transform(v, lambda x: F.floor(x * scale)).alias("y"))


def mine_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_column: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of the same label, the ``negatives`` best
    rows of another label whose score is from ``low`` to ``high`` percent of the positive's.

    A component x counts as floor(``scale`` * x); a score is the inner product with the anchor, in
    whole numbers; higher scores come first, ties by smaller id. Returns anchor_id, positive_id, rank,
    negative_id, positive_score and negative_score. Rows without id or label, and vectors that are
    null, empty, hold null or non-finite components, have another length than most, or are so large
    that a score may pass the range of bigint, take no part. A row is no candidate of an anchor of its
    own id; of repeated anchor ids the smallest label and vector count, repeated candidates each
    count. Fewer rows than asked for are all returned; empty tables give no rows; other columns,
    whatever their names, are not read.

    Anchors meet all candidates in blocks: a candidate travels once for each ``ANCHOR_LINE`` anchors,
    an anchor to each block that its labels and brackets do not rule out.
    """
    spark = vectors.sparkSession
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    base, asked = (quantised(df, id_column, column, label, scale) for df in (vectors, anchors))
    # a row for each length of vectors
    usual = base.groupBy(F.size("y").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not usual:
        return spark.createDataFrame([], schema)
    dim = usual[0].dim
    limit = min((1 << 31) - 1, math.isqrt(((1 << 62) - 1) // dim))

    def within(df: DataFrame) -> DataFrame:
        fits = (F.size("y") == dim) & (F.array_max("y") <= limit) & (F.array_min("y") >= -limit)
        return df.where(fits).withColumn("y", F.col("y").cast("array<int>"))

    base = within(base)
    asked = within(asked).groupBy("id").agg(F.min(F.struct("label", "y")).alias("a")).select("id", "a.*")
    length = F.aggregate("y", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, squared = base.agg(F.count("*"), F.max(length)).first()
    n_anchors = asked.count()
    if not n or not n_anchors:
        return spark.createDataFrame([], schema)
    sample = base.select("y").orderBy(F.xxhash64("id"), "y").limit(PIVOT_SAMPLE).collect()  # bounded
    pivots = farthest_first(lengthened(np.array([r.y for r in sample], dtype=np.int64), squared), PIVOTS)
    width = len(pivots)

    def measured(candidate: bool):  # noqa: ANN202
        def run(batches):  # noqa: ANN001, ANN202
            for batch in batches:
                y = _matrix(batch.column(2), np.int64)
                points = lengthened(y, squared) if candidate else np.column_stack([y.astype(np.float64), np.zeros(len(y))])
                d = distances(points, pivots)
                table = pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), width).cast(pa.list_(pa.float64()))
                near = d.argmin(axis=1) if len(d) else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, table, pa.array(near.astype(np.int32))], names=["id", "label", "y", "d", "near"])

        return run

    kind = "id bigint, label string, y array<int>, d array<double>, near int"
    fit = max(1, min(ROW_BLOCK, BLOCK_BYTES // (4 * dim + 8 * width + 32)))
    blocks, lines = math.ceil(n / fit), math.ceil(n_anchors / min(ANCHOR_LINE, fit))
    index = base.mapInArrow(measured(candidate=True), kind).withColumn("row", F.monotonically_increasing_id())
    index = index.repartitionByRange(blocks, "label", "near", F.element_at("d", F.col("near") + 1), "id", "row").withColumn("block", F.spark_partition_id())
    index = written(index.drop("row", "near"), "pivots")
    query = written(asked.mapInArrow(measured(candidate=False), kind).drop("near"), "anchors")

    per_group = math.ceil(blocks / SUMMARIES)
    bounds = [f(F.element_at("d", p + 1)).alias(f"{name}_{p}") for name, f in (("least", F.min), ("most", F.max)) for p in range(width)]
    groups = index.groupBy(F.floor(F.col("block") / per_group).alias("group")).agg(F.min("label").alias("first"), F.max("label").alias("last"), F.max("block").alias("end"), *bounds)
    groups = sorted(groups.collect(), key=lambda r: r.group)  # SUMMARIES rows at most
    first, last = (np.array([r[c] for r in groups], dtype=object) for c in ("first", "last"))
    nearest = np.array([[r[f"least_{p}"] for p in range(width)] for r in groups])
    farthest = np.array([[r[f"most_{p}"] for p in range(width)] for r in groups])
    members = [list(range(r.group * per_group, r.end + 1)) for r in groups]

    def sent(same: bool):  # noqa: ANN202
        """The blocks that may hold what each anchor looks for."""

        def run(batches):  # noqa: ANN001, ANN202
            for batch in batches:
                for at in range(0, len(batch), ANCHORS):
                    part = batch.slice(at, ANCHORS)
                    labels = np.array(part.column("label").to_pylist(), dtype=object)
                    inside = (first[None] <= labels[:, None]) & (labels[:, None] <= last[None])
                    if same:
                        meets = inside
                    else:
                        y, d = _matrix(part.column("y"), np.float64), _matrix(part.column("d"), np.float64)
                        least, most = bracket(d, nearest, farthest, np.sqrt((y * y).sum(axis=1)), squared)
                        meets = np.zeros(inside.shape, dtype=bool)
                        for i, found in enumerate(part.column("positives").to_pylist()):
                            for p in found:
                                meets[i] |= (most[i] >= p["score"] * low / 100) & (least[i] <= p["score"] * high / 100)
                        meets &= ~((first[None] == last[None]) & (first[None] == labels[:, None]))
                    targets = [[b for g in np.nonzero(m)[0] for b in members[g]] for m in meets]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(targets, pa.list_(pa.int32()))], names=[*part.schema.names, "blocks"])

        return run

    def met(query: DataFrame, same: bool, k: int) -> DataFrame:
        """A row (anchor_id, slot, id, score) for the k best of each block."""
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in query.schema)
        right = query.mapInArrow(sent(same), f"{fields}, blocks array<int>").withColumn("block", F.explode("blocks")).drop("blocks")
        right = right.withColumn("line", F.pmod(F.xxhash64("id"), F.lit(lines)).cast("int"))
        left = index.withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))))
        out = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

        def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return out.empty_table()
            codes = {x: i for i, x in enumerate(sorted({*left["label"].to_pylist(), *right["label"].to_pylist()}))}
            rows, queries = ({"id": t["id"].to_numpy(), "label": np.array([codes[x] for x in t["label"].to_pylist()]), "y": _matrix(t["y"], np.int32), "d": _matrix(t["d"], np.float64)} for t in (left, right))
            if not same:
                held = [[p["score"] for p in x] for x in right["positives"].to_pylist()]
                floor, ceiling = np.full((len(held), positives), 1, dtype=np.int64), np.zeros((len(held), positives), dtype=np.int64)
                for i, scores in enumerate(held):
                    for s, p in enumerate(scores):
                        floor[i, s], ceiling[i, s] = -(-low * p // 100), high * p // 100
            else:
                floor, ceiling = np.full((len(right), 1), -_LARGE + 1), np.full((len(right), 1), _LARGE - 1)
            at, slot, ids, score = search_block(rows, queries, floor, ceiling, same, k, squared)
            return pa.table([queries["id"][at], slot.astype(np.int32), ids, score], schema=out)

        found = left.groupBy("block", "line").cogroup(right.groupBy("block", "line")).applyInArrow(search, "anchor_id bigint, slot int, id bigint, score bigint")
        rank = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    # each anchor with its positives, then the negatives of each of these
    near = met(query, True, positives).groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    near = written(query.join(near.withColumnRenamed("anchor_id", "id"), "id"), "positives")
    far = met(near, False, negatives)
    of = near.select(F.col("id").alias("anchor_id"), F.posexplode("positives").alias("slot", "p"))
    joined = far.join(of, ["anchor_id", "slot"])
    return joined.select("anchor_id", F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def moved_labels(vectors: DataFrame, moves: Column, to: Column, label: str = "label") -> DataFrame:
    """``vectors`` with the label ``to`` where ``moves``."""
    return vectors.withColumn(label, F.when(moves, to).otherwise(F.col(label)))
