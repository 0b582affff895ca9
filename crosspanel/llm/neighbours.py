"""Nearest neighbours by randomly rotated one-bit codes.

A vector, less the mean of all vectors, is rotated at random and kept as one sign bit per dimension,
with two scalars: its length, and the share of it that the bits keep. From the packed bits an inner
product with a query is estimated, with a bound on the error; vectors whose upper bound reaches the
k-th best score so far are reranked by their exact inner product. All vectors are indexed, none is
sampled; queries and candidates meet in blocks of fixed size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates and queries of a block, the work of one task, and the bytes that their vectors may take.
CANDIDATE_BLOCK, QUERY_BLOCK, BLOCK_BYTES = 32_768, 8192, 32 << 20
#: Candidates and queries estimated at a time.
CHUNK, LINE = 4096, 1024
#: Components this many times the usual size are kept out of the codes: such vectors are always reranked.
WILD = 1e12
#: Width of the error bound in standard deviations of the estimate.
EPSILON = 2.8


_NONE = np.iinfo(np.int64).max


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def encode(vectors: np.ndarray, scale: float, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, length (infinite if out of all proportion) and kept share of each vector,
    in units of ``scale``."""
    vectors = vectors / scale
    wild = np.abs(vectors).max(axis=1) > WILD
    rest = (np.where(wild[:, None], 0.0, vectors) - mean) @ turn
    norm = np.linalg.norm(rest, axis=1)
    kept = np.abs(rest).sum(axis=1) / np.maximum(norm, 1e-300) / math.sqrt(vectors.shape[1])
    return np.packbits(rest > 0, axis=1), np.where(wild, np.inf, norm), np.where(norm > 0, kept, 1.0)


def search_block(ids: np.ndarray, vectors: np.ndarray, bits: np.ndarray, norm: np.ndarray, kept: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, scale: float, mean: np.ndarray, turn: np.ndarray, k: int, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of one block for each of its queries: query row, id, score."""
    dim = vectors.shape[1]
    q = queries.astype(np.float64)
    most = np.abs(q).max(axis=1)
    unit = q / most[:, None]
    turned = (unit @ turn).astype(np.float32)
    q_mean, q_norm = unit @ mean, np.linalg.norm(unit, axis=1)
    best_score = np.full((len(q), k), -np.inf)
    best_id = np.full((len(q), k), _NONE)
    wild = ~np.isfinite(norm)
    norm = np.where(wild, 0.0, norm)
    rounding = 1e-5 * (1 + norm + np.linalg.norm(mean))
    spread = np.where(wild, np.inf, epsilon * norm * np.sqrt(np.maximum(0, 1 - kept**2)) / kept / math.sqrt(max(1, dim - 1)) + rounding)
    for lo in range(0, len(ids), CHUNK):
        part = slice(lo, lo + CHUNK)
        signs = np.unpackbits(bits[part], axis=1, count=dim).astype(np.float32) * 2 - 1
        share = (norm[part] / (math.sqrt(dim) * kept[part])).astype(np.float32)
        for top in range(0, len(q), LINE):
            line = slice(top, top + LINE)
            estimate = turned[line] @ signs.T
            estimate *= share
            estimate += q_mean[line, None].astype(np.float32)
            own = query_ids[line, None] == ids[part][None, :]
            estimate[own] = -np.inf
            rows = np.arange(len(estimate))
            # the candidates that look best come first and set the bar for the rest
            first = min(2 * k, estimate.shape[1])
            front = np.argpartition(-estimate, first - 1, axis=1)[:, :first] if first < estimate.shape[1] else np.tile(np.arange(first), (len(rows), 1))
            found = own, ids[part], vectors[part], q[line], best_score[line], best_id[line], k
            _rerank(np.repeat(rows, first), front.ravel(), *found)
            upper = estimate + (spread[part][None, :] * q_norm[line, None]).astype(np.float32)
            upper[own] = -np.inf
            np.put_along_axis(upper, front, -np.inf, axis=1)
            # where fewer than k are found so far the bar is -inf, which those of the front must not pass again
            bar = best_score[line, -1:] / most[line, None] / scale
            at, candidate = np.nonzero((upper >= bar) & (upper > -np.inf))
            for s in range(0, len(at), 1 << 18):
                _rerank(at[s : s + (1 << 18)], candidate[s : s + (1 << 18)], *found)
    found = best_id != _NONE
    return np.nonzero(found)[0], best_id[found], best_score[found]


def _rerank(at: np.ndarray, candidate: np.ndarray, own: np.ndarray, ids: np.ndarray, vectors: np.ndarray, q: np.ndarray, best_score: np.ndarray, best_id: np.ndarray, k: int) -> None:
    """Exact scores of the pairs, merged into the best so far (ties to the smaller id)."""
    keep = ~own[at, candidate]
    at, candidate = at[keep], candidate[keep]
    if not len(at):
        return
    with np.errstate(over="ignore", invalid="ignore"):
        score = np.einsum("ij,ij->i", q[at], vectors[candidate].astype(np.float64))
    good = score >= best_score[at, -1]
    at, candidate, score = at[good], candidate[good], score[good]
    touched = np.unique(at)
    all_at = np.concatenate([at, np.repeat(touched, k)])
    all_score = np.concatenate([score, best_score[touched].ravel()])
    all_id = np.concatenate([ids[candidate], best_id[touched].ravel()])
    order = np.lexsort((all_id, -all_score, all_at))
    all_at, all_score, all_id = all_at[order], all_score[order], all_id[order]
    begin = np.searchsorted(all_at, touched)
    pick = begin[:, None] + np.arange(k)
    best_score[touched], best_id[touched] = all_score[pick], all_id[pick]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", column: str = "embedding", epsilon: float = EPSILON) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` for each row of ``queries``, by largest inner product.

    Returns query_id, rank, vec_id and score (the exact inner product in double precision),
    nearest first, ties to the smaller id. A query's own id is no candidate. Rows without an id,
    and vectors that are null, zero, hold null or non-finite components or have another length
    than most, take no part. Of repeated query ids the smallest vector counts; repeated candidates
    each count. Fewer than ``k`` candidates are all returned; empty tables give no rows; other
    columns, whatever their names, are not read. Vectors of doubles stay doubles; products beyond
    the range of doubles are infinite, and a pair whose product is no number is left out.

    Queries meet all codes in blocks: a vector travels once for each ``QUERY_BLOCK`` queries.
    """
    floats = all(df.schema[column].dataType.simpleString() == "array<float>" for df in (vectors, queries))
    kind = "float" if floats else "double"

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(column).cast("array<double>")
        odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        good = F.col(id_column).isNotNull() & F.col(column).isNotNull() & ~odd & F.exists(v, lambda x: x != 0)
        return df.where(good).select(F.col(id_column).cast("bigint").alias("id"), F.col(column).cast(f"array<{kind}>").alias("v"))

    spark = vectors.sparkSession
    base, asked = usable(vectors), usable(queries)
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    sizes = base.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.percentile_approx(largest, 0.5).alias("scale")).orderBy(F.desc("n"), "dim").limit(1).collect()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, n, scale = sizes[0]
    base, asked = base.where(F.size("v") == dim), asked.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    usual = F.transform("v", lambda x: x.cast("double") / scale)
    sums = base.where(largest / scale <= WILD).select(F.posexplode(usual)).groupBy("pos").agg(F.avg("col").alias("mean")).collect()
    mean = np.array([r["mean"] for r in sorted(sums, key=lambda r: r.pos)])
    turn = rotation(dim)
    fit = max(1, BLOCK_BYTES // (8 * dim))
    columns = max(1, math.ceil(n / min(CANDIDATE_BLOCK, fit)))
    lines = max(1, math.ceil(asked.count() / min(QUERY_BLOCK, fit)))

    def index(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            bits, norm, kept = encode(matrix(batch.column(1), dim).astype(np.float64), scale, mean, turn)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(norm), pa.array(kept)], names=["id", "v", "bits", "norm", "kept"])

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        query_ids = right["id"].to_numpy()
        bits = np.frombuffer(b"".join(left["bits"].to_pylist()), dtype=np.uint8).reshape(len(left), -1)
        at, ids, score = search_block(left["id"].to_numpy(), matrix(left["v"], dim), bits, left["norm"].to_numpy(), left["kept"].to_numpy(), query_ids, matrix(right["v"], dim), scale, mean, turn, k, epsilon)
        return pa.table({"query_id": query_ids[at], "vec_id": ids, "score": score})

    indexed = base.mapInArrow(index, f"id bigint, v array<{kind}>, bits binary, norm double, kept double")
    # the row number keeps an id that very many rows share from filling one block
    left = indexed.withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(columns))).withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))))
    right = asked.withColumn("line", F.pmod(F.xxhash64("id"), F.lit(lines)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(columns - 1).cast("bigint"))))
    found = left.groupBy("block", "line").cogroup(right.groupBy("block", "line")).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
